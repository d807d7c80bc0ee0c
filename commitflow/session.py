"""Session helpers shared by the entry point, the benchmark and the tests."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def local_session(master: str = "local[8]", app: str = "commitflow", **conf) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one named in ``spark.checkpoint.dir``.

    A temporary folder is used only where the setting is absent and the master is local, as in tests:
    on a cluster each machine would write to a disk of its own.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="commitflow-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/commitflow-{label}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Send the package to the Python workers, unless they find it on their path anyway.

    The archive is made in a folder of the driver, from where Spark hands it to every executor.
    """
    context = spark.sparkContext
    on_path = str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if on_path or context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    path = Path(tempfile.mkdtemp(prefix="commitflow-")) / "commitflow.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(ROOT.glob("commitflow/**/*.py")):
            archive.write(file, str(file.relative_to(ROOT)))
    context.addPyFile(str(path))
