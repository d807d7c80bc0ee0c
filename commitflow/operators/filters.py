"""Row filters over commit tables (section B)."""

from __future__ import annotations

import math
import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .rows import cut_condition, first_cut, take_cut


def languages_pass(langs: Sequence[str] | None, empty_passes: bool = True) -> Column:
    if not langs:
        return F.lit(empty_passes)
    return F.col("language").isin(*langs)


def all_changes_in(types: Sequence[str] | None) -> Column:
    """True when every change has one of ``types``; a commit without changes passes."""
    if not types:
        return F.lit(True)
    return F.forall("mods", lambda m: m["change_type"].isin(*types))


def filter_languages(
    df: DataFrame, langs: Sequence[str] | None, empty_passes: bool = True
) -> DataFrame:
    """B1: ``empty_passes`` chooses what an empty list means: no filter, or nothing passes."""
    return df.filter(languages_pass(langs, empty_passes))


def filter_change_types(df: DataFrame, types: Sequence[str] | None) -> DataFrame:
    """B2."""
    return df.filter(all_changes_in(types))


def filter_commits(
    df: DataFrame, langs: Sequence[str], types: Sequence[str] | None
) -> DataFrame:
    """An empty language list lets nothing through, an empty type list everything."""
    return df.filter(languages_pass(langs, empty_passes=False) & all_changes_in(types))


def only_change_type(df: DataFrame, change_type: str) -> DataFrame:
    """B4."""
    return df.filter(F.forall("mods", lambda m: m["change_type"] == change_type))


def cap_modify_only(
    df: DataFrame,
    fraction: float | None,
    order_cols: Sequence[str],
    types: Sequence[str] | None = None,
    dedupe_empty: bool = True,
) -> DataFrame:
    """Keep commits without any MODIFY, then the first share of the MODIFY-only ones.

    Mixed commits are dropped. A commit without changes counts as both; with ``dedupe_empty`` it is
    kept once, on the first side. ``part`` (0, 1) then ``order_cols`` gives the output order.
    """
    if fraction is None or fraction >= 1 or (types and "MODIFY" not in types):
        return df.withColumn("part", F.lit(0))
    plain = F.forall("mods", lambda m: m["change_type"] != "MODIFY")
    modify = F.forall("mods", lambda m: m["change_type"] == "MODIFY")
    # The share is taken before duplicates are removed, so both settings keep the same commits.
    cut = first_cut(df.filter(modify), lambda n: math.ceil(n * fraction), order_cols)
    chosen = cut_condition(cut)
    if chosen is not None and dedupe_empty:
        # A commit without changes is on the first side already.
        return df.withColumn("part", F.when(plain, 0).when(modify & chosen, 1)).filter("part is not null")
    head = take_cut(df.filter(modify), cut)
    if dedupe_empty:
        head = head.filter(F.size("mods") > 0)
    return df.filter(plain).withColumn("part", F.lit(0)).unionByName(head.withColumn("part", F.lit(1)))


def filter_exact_length(
    df: DataFrame, col: str, n: int, observation: Observation | None = None
) -> DataFrame:
    """Rows whose array has exactly ``n`` entries; ``observation`` reports both counts."""
    keep = F.size(col) == n
    if observation is not None:
        df = df.observe(
            observation,
            F.count(F.lit(1)).alias("rows_before"),
            F.count_if(keep).alias("rows_after"),
        )
    return df.filter(keep)


def drop_null(df: DataFrame, *cols: str) -> DataFrame:
    """B7."""
    return df.dropna(subset=list(cols))


def skip_completed(df: DataFrame, start_batch: int, batch_col: str = "batch_id") -> DataFrame:
    """B8."""
    return df.filter(F.col(batch_col) >= start_batch)


def drop_invalid_scores(df: DataFrame, *cols: str) -> DataFrame:
    """Drop rows whose score arrays hold NaN or an infinity."""
    for c in cols:
        bad = F.exists(
            c, lambda s: F.isnan(s) | (F.abs(s) == F.lit(float("inf")).cast("double"))
        )
        df = df.filter(~bad)
    return df


def require_non_empty(df: DataFrame) -> DataFrame:
    """B10."""
    if df.isEmpty():
        raise ValueError("no rows left")
    return df


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def require_placeholders(template: str, names: Sequence[str]) -> str:
    """The template must name every field."""
    found = {f for _, f, _, _ in string.Formatter().parse(template) if f}
    missing = [n for n in names if n not in found]
    if missing:
        raise ValueError(f"template lacks placeholders: {missing}")
    return template
