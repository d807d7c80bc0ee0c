"""Approximate nearest neighbours by cross-polytope hashing.

A table's pseudo-rotation multiplies by random signs and a fast Hadamard transform, three times over. A
vector hashes to the signed axis nearest to its rotated self. A query looks into the buckets of several
axes next to it in every table; all vectors found there are compared by their exact cosine.

Equal vectors are one entry with its smallest ids, as many as a query can need, so a vector that fills
the table fills no bucket. Buckets above a size are dealt out in parts that each meet all their queries.
A query that finds too few searches every bucket of one table, which is exact.

Vectors that are null, zero, of another dimension, or hold null or non-finite components take no part,
nor do null ids. Repeated ids of one vector count once; an empty table gives no rows. Ties go to the
smaller id, also among any number of vectors that differ only in length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Tables, and buckets that a query looks into in each.
TABLES, PROBES = 16, 6
#: Candidates and queries of a group at most; queries compared at a time.
PART, QUERIES = 20_000, 256
#: Cosines this close count as equal until they are measured exactly.
SLACK = 1e-9


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of every row (a power of two long), by halving."""
    n, d = x.shape
    h = 1
    while h < d:
        pairs = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotated(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    """The rows of ``x``, padded to a power of two and turned by the table's pseudo-rotation."""
    d = 1 << max(0, int(x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), d))
    y[:, : x.shape[1]] = x
    signs = np.random.default_rng([seed, table]).integers(0, 2, (3, d)) * 2 - 1
    for s in signs:
        y = hadamard(y * s)
    return y


def nearest_axes(y: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` nearest signed axes of every row, nearest first; axis k is 2k, its opposite 2k + 1."""
    both = np.stack([-y, y], 2).reshape(len(y), -1)
    count = min(count, both.shape[1])
    if count == 1:
        return both.argmin(1)[:, None]
    near = np.argpartition(both, count - 1, axis=1)[:, :count]
    return np.take_along_axis(near, np.argsort(np.take_along_axis(both, near, 1), axis=1, kind="stable"), 1)


def valid(vector: Column) -> Column:
    """Whether a vector can take part."""
    fine = F.forall(vector, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _matrices(series: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in series])


def search(
    df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES,
    probes: int = PROBES, seed: int = 5, part: int = PART,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best found for every row that ``is_query`` picks."""
    rows = df.withColumn("__query", F.coalesce(is_query, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), "__query"
    ).where(F.col("id").isNotNull() & valid(F.col("v")))
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return df.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("v") == common["d"])
    axes = 2 << max(0, int(common["d"] - 1).bit_length())
    # A query needs at most ``k`` ids of a vector beside its own; the limit is applied before the exchange.
    order = Window.partitionBy(F.xxhash64("v"), "v").orderBy("id")
    ranked = rows.select("id", "v").distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    entries = written(ranked.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "ann-entries")
    queries = written(rows.where("__query").select("id", "v").dropDuplicates(["id"]), "ann-queries")
    found = written(_best(_compared(entries, queries, k, tables, probes, axes, seed, part), k), "ann-found")
    enough = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    short = queries.join(enough, queries.id == enough.query_id, "left_anti")
    if short.isEmpty():
        return found
    exact = _best(_compared(entries, short, k, 1, axes, axes, seed, part), k)
    return found.join(short, found.query_id == short.id, "left_anti").unionByName(exact)


def _best(pairs: DataFrame, k: int) -> DataFrame:
    once = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _compared(entries: DataFrame, queries: DataFrame, k: int, tables: int, probes: int, axes: int, seed: int, part: int) -> DataFrame:
    """(query_id, vec_id, score): in every bucket a query looks into, its ``k`` best."""

    def sizes(count: int, column: str):
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((tables, axes), np.int64)
            for batch in batches:
                x = _matrix(batch.column(column))
                for t in range(tables):
                    total[t] += np.bincount(nearest_axes(rotated(x, t, seed), count).ravel(), minlength=axes)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(tables * axes)), pa.array(total.ravel())], ["bucket", "n"])

        return of

    def parts(frame: DataFrame, count: int) -> np.ndarray:
        """In how many parts each bucket is dealt out: one number a table and axis."""
        summed = frame.select("v").mapInArrow(sizes(count, "v"), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
        out = np.ones(tables * axes, np.int64)
        for r in summed.collect():
            out[r["bucket"]] = max(1, -(-r["n"] // part))
        return out

    many, few = parts(entries, 1), parts(queries, probes)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ids, key = _matrix(batch.column("v")), batch.column("ids"), np.asarray(batch.column("ids").flatten().take(batch.column("ids").offsets.slice(0, batch.num_rows)))
            for t in range(tables):
                bucket = nearest_axes(rotated(x, t, seed), 1)[:, 0] + t * axes
                # An entry stands in one part of the candidates, for every part of the queries.
                copies = few[bucket]
                at = np.repeat(np.arange(len(x)), copies)
                q = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
                c = (key % many[bucket])[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[at]), pa.array(c), pa.array(q), batch.column("v").take(pa.array(at)), ids.take(pa.array(at))], ["bucket", "c", "q", "v", "ids"]
                )

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ids = _matrix(batch.column("v")), batch.column("id").to_numpy()
            for t in range(tables):
                bucket = (nearest_axes(rotated(x, t, seed), probes) + t * axes).ravel()
                row = np.repeat(np.arange(len(x)), len(bucket) // max(1, len(x)))
                copies = many[bucket]
                at = np.repeat(np.arange(len(bucket)), copies)
                c = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
                q = (ids[row] % few[bucket])[at]
                take = pa.array(row[at])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[at]), pa.array(c), pa.array(q), batch.column("v").take(take), batch.column("id").take(take)], ["bucket", "c", "q", "v", "id"]
                )

    def compared(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(left) and len(right):
            a, b = _matrices(left["v"]), _matrices(right["v"])
            na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
            scaled, ids = a / na[:, None], left["ids"].tolist()
            least = np.array([x[0] for x in ids])
            # The best ``k + 1`` entries hold ``k`` ids other than the query's own; all that tie with the last take part.
            last = max(0, len(a) - k - 1)
            for at in range(0, len(b), QUERIES):
                block = b[at : at + QUERIES]
                near = block @ scaled.T
                bound = np.partition(near, last, axis=1)[:, last] - SLACK * nb[at : at + QUERIES]
                for i, row in enumerate(near):
                    hits = np.flatnonzero(row >= bound[i])
                    # The exact measure on the original vectors, the same in every bucket.
                    score = (a[hits] * block[i]).sum(1) / (na[hits] * nb[at + i])
                    best = np.lexsort((least[hits], -score))[: k + 1]
                    own = int(right["id"].iloc[at + i])
                    pairs = sorted((-s, int(x)) for s, h in zip(score[best].tolist(), hits[best].tolist()) for x in ids[h] if x != own)
                    found.extend((own, x, -s) for s, x in pairs[:k])
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    left = entries.mapInArrow(indexed, "bucket long, c long, q long, v array<double>, ids array<long>")
    right = queries.mapInArrow(asked, "bucket long, c long, q long, v array<double>, id long")
    keys = ("bucket", "c", "q")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compared, "query_id long, vec_id long, score double")
