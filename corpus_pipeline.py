"""A training-data pipeline: quality, toxicity, near-duplicates, packing.

Each stage takes the documents that the one before it kept, as Parquet read again. All but the last return
documents with their columns; the last returns the pieces of the packed sequences. Documents whose text is
null count as empty; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitflow.llm.packing import pack
from commitflow.llm.quality import quality_scores
from commitflow.llm.queries import vocabulary
from commitflow.llm.shared import written
from commitflow.llm.simhash import near_documents
from commitflow.llm.toxicity import toxicity_scores


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


#: Private names of what the classifiers add, so that columns of the input stay as they are.
SCORES = ("__held_out", "__score", "__predicted")
ROW = "__row"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network scores 0.3 or more; it is fitted on the given labels."""
    return quality_scores(docs, _labels(spark, sf_dir), names=SCORES).where("__predicted = 1").drop(*SCORES)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no sentence makes toxic: scores below 0.7."""
    return toxicity_scores(docs, _labels(spark, sf_dir), names=SCORES).where("__predicted = 0").drop(*SCORES)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the first by id (null ids last), of repeated ids any one.

    Near copies share 0.8 or more of their five-word shingles, as wide fingerprints estimate it.
    Rows are numbered in a table that is written first, and removed by their number: an id that stands on several texts loses
    only those that are copies. The rows to be removed are written too, so Spark knows their size when it chooses the join.
    """
    rows = written(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("id"), F.col(ROW).alias("row"))
    found = near_documents(rows.select(place.alias("place"), "text"), id_col="place")
    others = written(found.where("place.row <> component_id.row").select(F.col("place.row").alias(ROW)), "near-copies")
    return rows.join(others, ROW, "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return pack(docs, vocabulary("byte_bpe_50k.json"), 2048, end_id=1)


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_copies", near_copies), ("packing", packing)]

#: A fitted network, a trie join and greedy packing are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
