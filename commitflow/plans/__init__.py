"""Whole plans built from the operators, and the registered queries."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODULES = ("commit_queries", "prompt_queries", "stats_queries", "metric_queries", "sequence_queries")


def all_registries():
    return [importlib.import_module(f"{__name__}.{m}").R for m in MODULES]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For language ``en``: how change types and rendered diff lengths distribute."""
    from ..functions import text as tx
    from ..operators.changes import render_diff
    from ..operators.filters import filter_commits
    from .views import commits

    kept = render_diff(filter_commits(commits(spark, sf_dir), ["en"], None))
    return (
        kept.select(
            F.length("diff").alias("n"),
            tx.token_count(F.col("diff")).alias("tokens"),
            F.explode(F.array_distinct("mods.change_type")).alias("change_type"),
        )
        .groupBy("change_type")
        .agg(
            F.count("*").alias("commits"),
            F.avg("n").alias("mean_chars"),
            F.percentile("n", F.lit(0.5)).alias("median_chars"),
            F.sum("tokens").alias("tokens"),
        )
    )
