"""Bounded samples of labelled documents, and models fitted on them inside one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc_mod

#: Characters of a document that may take part in fitting; longer ones are only scored. Together with ``per_class``
#: it bounds what the fitting task holds.
MOST_CHARS = 1 << 20
#: What a classifier adds to its documents.
NAMES = ("held_out", "score", "predicted")


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, mod: int, held_out: int, per_class: int, most_chars: int = MOST_CHARS
) -> DataFrame:
    """(text, y, weight): at most ``per_class`` training documents of either label, chosen by a hash.

    Labelled documents of more than ``most_chars`` characters take no part. ``weight`` restores each label's share among all training labels. Held-out documents never take part.
    """
    train = labels.where((crc_mod("doc_id", mod) != held_out) & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y"))
    train = train.groupBy("doc_id").agg(F.max("y").alias("y"))
    totals = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    ranked = [train.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    # At most twice ``per_class`` ids, so they may be sent to every task.
    chosen = F.broadcast(ranked[0].unionByName(ranked[1]))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.length("text") <= most_chars)
    weight = F.lit(1.0)
    for y, n in totals.items():
        weight = F.when(F.col("y") == y, F.lit(max(1.0, n / per_class))).otherwise(weight)
    return texts.join(chosen, "doc_id").select("text", "y", weight.alias("weight"))


def fitted(sample: DataFrame, fit: Callable[[pd.DataFrame], bytes]) -> bytes:
    """The model that ``fit`` makes of the whole sample, in one task on an executor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        rows = pd.concat(held) if held else pd.DataFrame({"text": [], "y": [], "weight": []})
        # The order of rows must not depend on how Spark read them.
        rows = rows.sort_values(["y", "text"]).reset_index(drop=True)
        yield pd.DataFrame({"model": [fit(rows)]})

    # An exchange, not a coalesce: the tables are scanned by many tasks, and only the sample reaches this one.
    row = sample.repartition(1).mapInPandas(run, "model binary").first()
    # Spark leaves out the task where it sees that the sample is empty.
    return bytes(row["model"]) if row else fit(pd.DataFrame({"text": [], "y": [], "weight": []}))
