"""Tables of a job that several of its steps read, kept in the folder all executors share."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once and read again: later steps neither recompute nor keep its lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key with more than one in so many of all rows is joined apart.
HOT_SHARES = 64


def join_sized(rows: DataFrame, table: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of ``rows`` with a table of one row a key that tells in ``size`` how many rows have the key.

    At most ``HOT_SHARES`` keys can hold that share of all rows; these few rows are sent to every task and their matches stay
    where they are. Only the other keys cross an exchange. ``table`` is read twice: write it first.
    """
    total = table.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    is_hot = F.col(size) * HOT_SHARES > total
    hot = F.broadcast(table.where(is_hot).drop(size))
    cold = rows.join(hot.select(key), key, "left_anti").join(table.where(~is_hot).drop(size), key)
    return rows.join(hot, key).unionByName(cold)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def crcs(ids: np.ndarray, counts: np.ndarray) -> list[int]:
    """Unsigned crc32 of each run of ids, as little-endian unsigned 32-bit integers."""
    data = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    ends = np.cumsum(counts) * 4
    return [zlib.crc32(data[e - 4 * c : e]) for e, c in zip(ends.tolist(), counts.tolist())]


def binaries(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Runs of an array's items as binary values, without a copy per value."""
    size = data.dtype.itemsize
    offsets = np.concatenate([[0], np.cumsum(counts) * size]).astype(np.int64)
    raw = np.ascontiguousarray(data)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]
    ).cast(pa.binary())
