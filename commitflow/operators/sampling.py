"""Deterministic sampling and splitting (section F).

Random order is a hash of the row's id and a seed: the same rows are picked whatever the
partitioning, and a recomputed task picks them again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import first_rows, hash_order, take_first, with_row_index


def sample_n(
    df: DataFrame, n: int, id_cols: Sequence[str], seed: int, keep_index: bool = False
) -> DataFrame:
    """``n`` random rows; ``keep_index`` adds their original position."""
    if keep_index:
        df = with_row_index(df, id_cols, "original_idx")
    return _first_shuffled(df, n, id_cols, seed)


def _first_shuffled(df: DataFrame, n: int, id_cols: Sequence[str], seed: int) -> DataFrame:
    keyed = df.withColumn("__h", hash_order(id_cols, seed))
    return take_first(keyed, n, ["__h", *id_cols]).drop("__h")


def sample_like(df: DataFrame, other: DataFrame, id_cols: Sequence[str], seed: int) -> DataFrame:
    """as many rows as ``other`` has."""
    return _first_shuffled(df, other.count(), id_cols, seed)


def pick_row(df: DataFrame, i: int, order_cols: Sequence[str], seed: int = 0) -> DataFrame:
    """row ``i``; ``-1`` picks one by the seeded order."""
    if i == -1:
        return sample_n(df, 1, order_cols, seed)
    return with_row_index(df, order_cols).filter(F.col("row_idx") == i)


def head_n(df: DataFrame, n: int, order_cols: Sequence[str]) -> DataFrame:
    """the first ``n`` rows of the table (the operator itself is a row limit)."""
    return take_first(df, n, order_cols)


def split_random(
    df: DataFrame, test_frac: float, id_cols: Sequence[str], seed: int
) -> DataFrame:
    """``split`` is ``test`` for exactly ``floor(test_frac * n)`` rows, else ``train``."""
    keyed = df.withColumn("__h", hash_order(id_cols, seed))
    in_test = first_rows(keyed, lambda n: int(n * test_frac), ["__h", *id_cols])
    label = F.when(in_test, F.lit("test")).otherwise(F.lit("train"))
    return keyed.withColumn("split", label).drop("__h")
