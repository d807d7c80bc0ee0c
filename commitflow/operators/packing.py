"""Packing token rows into blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import running_total, with_row_index


def pack_sequences(
    df: DataFrame,
    block: int,
    order_col: str,
    ids: str = "input_ids",
    group: str | None = None,
    eos: int | None = None,
    keep_tail: bool = True,
) -> DataFrame:
    """``group, block, input_ids``: the rows of a group joined in order and cut into blocks.

    ``eos`` goes between rows, not behind the last one. A running token count tells each row which
    blocks it touches; only slices travel, and a block gathers at most ``block`` tokens whatever the
    size of its group.
    """
    group_col = F.col(group) if group else F.lit(0)
    base = df.select(group_col.alias("group"), F.col(order_col).alias("__o"), F.col(ids).alias("__t"))
    lead = 0 if eos is None else 1
    if eos is not None:
        # The end token goes before every row; the one before a group's first row gets position -1.
        base = base.withColumn("__t", F.concat(F.array(F.lit(eos)), "__t"))
    base = base.withColumn("__n", F.size("__t"))
    keys = ["group"] if group else []
    summed = running_total(base, "__n", ["__o"], keys, "__end").withColumn(
        "__end", F.col("__end") - lead
    )
    touched = (
        summed.withColumn("__start", F.col("__end") - F.col("__n"))
        .withColumn("__from", F.greatest("__start", F.lit(0)))
        .filter(F.col("__end") > F.col("__from"))
        .withColumn(
            "block",
            F.explode(
                F.sequence(F.floor(F.col("__from") / block), F.floor((F.col("__end") - 1) / block))
            ),
        )
    )
    lo = F.greatest(F.col("block") * block - F.col("__start"), F.lit(0)).cast("int")
    hi = F.least((F.col("block") + 1) * block - F.col("__start"), F.col("__n")).cast("int")
    slices = touched.select(
        "group",
        "block",
        F.struct(
            (F.col("__start") + lo).alias("at"), F.slice("__t", lo + 1, hi - lo).alias("part")
        ).alias("s"),
    )
    packed = slices.groupBy("group", "block").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["part"])).alias(
            "input_ids"
        )
    )
    return packed if keep_tail else packed.filter(F.size("input_ids") == block)


def map_groups(df: DataFrame, batch: int, order_col: str, name: str = "group") -> DataFrame:
    """Groups of ``batch`` consecutive rows, the unit within which rows are packed."""
    idx = with_row_index(df, [order_col], "__idx")
    return idx.withColumn(name, F.floor(F.col("__idx") / batch).cast("bigint")).drop("__idx")
