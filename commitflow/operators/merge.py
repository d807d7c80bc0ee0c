"""Joins between answers, predictions and vocabularies (section E), and concatenation (F1)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import with_row_index


def merge_responses(
    df: DataFrame,
    answers: DataFrame,
    id_col: str = "custom_id",
    order_cols: Sequence[str] = ("file", "block", "line"),
) -> DataFrame:
    """Replace ``message`` by the answer with the same id; the last answer read wins.

    Rows without an answer are dropped. Answers are reduced to one row per id before the join.
    """
    latest = answers.groupBy(id_col).agg(
        F.max_by("content", F.struct(*order_cols)).alias("__answer")
    )
    return df.join(latest, id_col).withColumn("message", F.col("__answer")).drop("__answer")


def merge_by_position(
    left: DataFrame,
    right: DataFrame,
    cols: Sequence[str],
    left_order: Sequence[str],
    right_order: Sequence[str],
    drop: Sequence[str] = ("diff", "message"),
) -> DataFrame:
    """Put ``cols`` of ``right`` beside ``left`` row by row; row counts must agree."""
    n, m = left.count(), right.count()
    if n != m:
        raise ValueError(f"row counts differ: {n} and {m}")
    a = with_row_index(left.drop(*drop), left_order, "row_idx")
    b = with_row_index(right, right_order, "row_idx").select("row_idx", *cols)
    return a.join(b, "row_idx")


def combine_predictions(frames: dict[str, DataFrame], key: str = "row_idx") -> DataFrame:
    """Predictions of several experiments in one table: ``input``, experiments, ``target``.

    Every frame has ``key, input, prediction, target``; the first gives ``input`` and ``target``.
    """
    names = list(frames)
    first = frames[names[0]].select(
        key, "input", F.col("prediction").alias(names[0]), "target"
    )
    rest = [frames[n].select(key, F.col("prediction").alias(n)) for n in names[1:]]
    joined = reduce(lambda a, b: a.join(b, key), rest, first)
    return joined.select(key, "input", *names, "target")


def combine_by_group(frames: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """One value column per experiment, lined up by a (possibly null) group key."""
    out = None
    for name, df in frames.items():
        part = df.select(F.col(key), F.col(value).alias(name))
        if out is None:
            out = part
            continue
        # With a null-safe key, absence is told by a marker, not by the key itself.
        a, b = out.withColumn("__a", F.lit(1)), part.withColumn("__b", F.lit(1))
        cond = a[key].eqNullSafe(b[key])
        out = a.join(b, cond, "full").select(
            F.when(a["__a"].isNotNull(), a[key]).otherwise(b[key]).alias(key),
            *[a[c] for c in out.columns if c != key],
            b[name],
        )
    return out


def align_vocab(a: DataFrame, b: DataFrame, key: str = "word", count: str = "n") -> DataFrame:
    """E5: union of two vocabularies, missing counts are zero."""
    left = a.select(F.col(key), F.col(count).alias("n_a"))
    right = b.select(F.col(key), F.col(count).alias("n_b"))
    return left.join(right, key, "full").na.fill(0, ["n_a", "n_b"])


def pending(requests: DataFrame, done: DataFrame, key: str = "batch_id") -> DataFrame:
    """Requests whose batch has no non-empty output yet."""
    finished = done.filter(F.col("content").isNotNull() & (F.col("content") != ""))
    return requests.join(finished.select(key).distinct(), key, "left_anti")


def concat(frames: Sequence[DataFrame], part: str = "part") -> DataFrame:
    """tables below each other; ``part`` keeps the order of the inputs."""
    marked = [df.withColumn(part, F.lit(i)) for i, df in enumerate(frames)]
    return reduce(lambda x, y: x.unionByName(y), marked)
