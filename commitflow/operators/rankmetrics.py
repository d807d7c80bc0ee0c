"""Ranking metrics over token scores in long form (section J)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

IGNORED = -100


def top_k_ids(scores: Column, k: int) -> Column:
    """Ids of the ``k`` largest scores; equal scores rank the lower id first, NaN and null last."""

    @F.arrow_udf("array<int>")
    def best(arrays: pa.Array) -> pa.Array:
        flat = arrays.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
        low = np.nan_to_num(-flat, nan=np.inf, posinf=np.inf, neginf=-np.inf)
        ends = np.cumsum(arrays.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        out, start = [], 0
        for end in ends.tolist():
            row, start = low[start:end], end
            ids = np.arange(len(row))
            if 0 < k < len(row):
                # Selection instead of a sort; ids that tie with the last place come in order.
                last = row[np.argpartition(row, k - 1)[k - 1]]
                ids = np.flatnonzero(row <= last)
            out.append(ids[np.argsort(row[ids], kind="stable")][:k].astype(np.int32))
        return pa.array(out, pa.list_(pa.int32()))

    return F.when(scores.isNotNull(), best(F.coalesce(scores, F.array())))


def with_top_k(df: DataFrame, k: int, scores: str = "scores", name: str = "top_ids") -> DataFrame:
    return df.withColumn(name, top_k_ids(F.col(scores), k))


def check_ranked(df: DataFrame, k: int, col: str = "top_ids") -> DataFrame:
    """Every position has at least ``k`` candidates and no example repeats a position."""
    short = F.count_if((F.size(col) < k) | F.col(col).isNull())
    places = df.groupBy("example_id", "pos").agg(F.count("*").alias("n"), short.alias("short"))
    found = places.agg(F.sum("short").alias("short"), F.count_if(F.col("n") > 1).alias("repeated")).first()
    if found["short"]:
        raise ValueError(f"{found['short']} positions have fewer than {k} candidates")
    if found["repeated"]:
        raise ValueError("an example has several predictions for one position")
    return df


def _per_example(
    df: DataFrame, gain: Column, shift: bool, ignore: int, by: Sequence[str]
) -> DataFrame:
    """Mean over examples of the summed gain per counted label; null without counted labels.

    With ``shift`` the prediction at ``t`` meets the label at ``t + 1``. Positions of one example are
    a sequence of bounded length, so the window is small.
    """
    keys = [*by, "example_id"]
    if shift:
        w = W.partitionBy(*keys).orderBy("pos")
        df = df.withColumn("label", F.lead("label").over(w)).filter(F.col("label").isNotNull())
    counted = F.col("label") != ignore
    per = df.groupBy(*keys).agg(
        F.try_divide(
            F.sum(F.when(counted, gain).otherwise(F.lit(0.0))), F.count_if(counted)
        ).alias("__v")
    )
    return per.groupBy(*by).agg(F.avg("__v").alias("value"))


def accuracy_at_k(
    df: DataFrame, k: int, shift: bool = False, ignore: int = IGNORED, by: Sequence[str] = ()
) -> DataFrame:
    """J1."""
    hit = F.array_contains(F.slice("top_ids", 1, k), F.col("label")).cast("double")
    out = _per_example(df, hit, shift, ignore, by)
    return out.withColumnRenamed("value", f"accuracy_{k}")


def mrr_at_k(
    df: DataFrame, k: int, shift: bool = False, ignore: int = IGNORED, by: Sequence[str] = ()
) -> DataFrame:
    """J2."""
    at = F.array_position(F.slice("top_ids", 1, k), F.col("label"))
    gain = F.when(at > 0, F.lit(1.0) / at).otherwise(F.lit(0.0))
    return _per_example(df, gain, shift, ignore, by).withColumnRenamed("value", f"mrr_{k}")
