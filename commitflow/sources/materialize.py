"""A10: content-addressed tables: the folder name is a digest of the configuration."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: Folder of tables that are being built.
ATTEMPTS = "attempts"


def config_digest(config: dict[str, Any]) -> str:
    """sha256 of the sorted items."""
    return hashlib.sha256(str(tuple(sorted(config.items()))).encode()).hexdigest()


def _files(spark: SparkSession, path: str):
    """The path's file system and the path, as Hadoop objects."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _published(spark: SparkSession, home: str) -> DataFrame | None:
    fs, done = _files(spark, f"{home}/data/_SUCCESS")
    return spark.read.parquet(f"{home}/data") if fs.exists(done) else None


def _publish(spark: SparkSession, attempt: str, home: str) -> None:
    """Give the finished folder ``attempt`` its name, unless another one has it already."""
    context = spark.sparkContext
    jvm = context._jvm.org.apache.hadoop.fs
    fs, source = _files(spark, attempt)
    _, target = _files(spark, home)
    names = jvm.FileContext.getFileContext(source.toUri(), context._jsc.hadoopConfiguration())
    try:
        # A rename without the overwrite option fails where the name is taken.
        names.rename(source, target, context._gateway.new_array(getattr(jvm, "Options$Rename"), 0))
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" not in error.java_exception.toString():
            raise


def materialize(
    spark: SparkSession, build: Callable[[], DataFrame], root: str, config: dict[str, Any]
) -> DataFrame:
    """Read the table for ``config`` below ``root``, building it first when it is not there.

    A build writes a folder of its own, the data and then ``config.json``, and a rename gives the whole
    folder the table's name. Of builders at the same time the first to get there wins, and all of them
    read its rows. A build that breaks off leaves no table, so the next one starts anew; nothing that a
    reader may hold is overwritten. Where a rename of folders is no single step (object stores), keep
    ``root`` on a file system.
    """
    digest = config_digest(config)
    home = f"{root.rstrip('/')}/{digest}"
    found = _published(spark, home)
    if found is None:
        attempt = f"{root.rstrip('/')}/{ATTEMPTS}/{digest}-{uuid.uuid4().hex}"
        build().write.parquet(f"{attempt}/data")
        pairs = [(k, repr(v)) for k, v in sorted(config.items())]
        settings = spark.createDataFrame(pairs, "key string, value string").coalesce(1)
        settings.write.json(f"{attempt}/config.json")
        _publish(spark, attempt, home)
        found = _published(spark, home)
        if found is None:
            raise FileExistsError(f"{home} holds something else than a finished table")
    return found
