"""One registered query for each operator, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.registry import Registry
from .collocations import collocations_sql
from .credentials import scan_sql

R = Registry()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file; a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


@R.add("op4_simhash_trie")
def op4_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), budget=4)


@R.add("op7_bpe_tree")
def op7_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_tree import digests, encode

    path = vocabulary("word_bpe_49k.json")
    return digests(encode(table(spark, sf_dir, "documents"), path), path)


@R.add("op9_bit_planes")
def op9_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bitplanes import round_trip

    return round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)


@R.add("op2_retrieval_packing")
def op2_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 2048, end_id=1)


#: Base 32 of a SHA-1: five bits a letter.
BASE32_SQL = (
    "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1"
    " + 16*cast(substr(bits, 5*i+1, 1) as int) + 8*cast(substr(bits, 5*i+2, 1) as int) + 4*cast(substr(bits, 5*i+3, 1) as int)"
    " + 2*cast(substr(bits, 5*i+4, 1) as int) + cast(substr(bits, 5*i+5, 1) as int) as int), 1)), '')"
)


@R.add(
    "op5_warc_chain",
    "with p as (select page_id, coalesce(html, '') as h from pages), m as (select h, max(page_id) as last from p group by h),"
    " b as (select page_id, h, last, cast(cast(unhex(sha1(h)) as bit) as varchar) as bits from p join m using (h))"
    f" select page_id, strlen(h) as payload_bytes, {BASE32_SQL} as payload_digest,"
    " case when page_id = last then 'response' else 'revisit' end as record_type,"
    " case when page_id <> last then last end as refers_to from b",
)
def op5_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).drop("url")


@R.add("op10_spotsigs")
def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spotsigs import edited_likeness

    return edited_likeness(table(spark, sf_dir, "documents"))


@R.add("op1_quality_network")
def op1_quality_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    found = quality_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


@R.add("op8_toxicity_instances")
def op8_toxicity_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_scores

    found = toxicity_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


@R.add("op6_hidden_markov")
def op6_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hmm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


@R.add("op3_cross_polytope")
def op3_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .crosspolytope import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@R.add("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


@R.add("op11_credential_links", scan_sql())
def op11_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .credentials import scan

    return scan(table(spark, sf_dir, "documents"))


@R.add("op12_phrase_cycles", collocations_sql())
def op12_phrase_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


@R.add("op13_conversation_runs")
def op13_conversation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import damaged, digests

    return digests(damaged(table(spark, sf_dir, "conversations"))).withColumnRenamed("id", "conv_id")
