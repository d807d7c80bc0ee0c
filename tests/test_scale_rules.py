"""Answers that must not depend on size: no caps, no switches."""

import pytest
from pyspark.sql import functions as F

from commitflow import session
from commitflow.operators import bpe, filters, sequences, stats, textmetrics
from commitflow.sources import files


@pytest.mark.parametrize("limit", [10, 0])
def test_both_lookups_agree_on_repeated_and_null_ids(spark, monkeypatch, limit):
    monkeypatch.setattr(sequences, "MAX_BROADCAST_WORDS", limit)
    rows = [(1, ["a"]), (1, ["x", "a", None]), (None, ["a", "b"]), (None, ["a", "b"]), (2, None), (3, [])]
    df = spark.createDataFrame(rows, "id int, w array<string>")
    vocab = spark.createDataFrame([("a", 5), ("b", 6)], "word string, id int")
    got = sorted(((r["id"] or 0, r["input_ids"]) for r in sequences.encode(df, "w", vocab).collect()), key=str)
    want = [(1, [5]), (1, [4, 5, 4]), (0, [5, 6]), (0, [5, 6]), (2, None), (3, [])]
    assert got == sorted(want, key=str)
    back = sequences.decode(spark.createDataFrame([([5, 6, 2, -100],)], "x array<int>"), "x", vocab)
    assert back.first()["text"] == "a b"


def test_only_frequent_words_are_copied(spark):
    rows = [(i, ["the", f"w{i % 50}", "the", None if i % 7 else "rare"]) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, w array<string>").repartition(3)
    table = {"the": 5, **{f"w{i}": 6 + i for i in range(50)}}
    vocab = spark.createDataFrame(list(table.items()), "word string, id int")
    out = sequences.encode_joined(df, "w", vocab)
    got = {r["id"]: r["input_ids"] for r in out.collect()}
    assert got == {i: [table.get(w, sequences.UNK) for w in words] for i, words in rows}
    entries = df.select(F.explode("w").alias("k"))
    heavy = {r["k"]: r["__parts"] for r in sequences.heavy_entries(entries, "k", 20).collect()}
    # 800 of 1258 words are the same one, 58 (every seventh row) another: 13 and no more than 1 of 20 shares.
    assert heavy == {"the": 13}
    assert sequences.heavy_entries(entries.limit(0), "k", 20).count() == 0


@pytest.mark.parametrize("dedupe", [True, False])
def test_the_class_cap_reads_its_rows_twice(spark, tmp_path, dedupe):
    kinds = [["MODIFY"], ["ADD"], [], ["MODIFY", "ADD"], None]
    rows = [(i, None if kinds[i % 5] is None else [(k,) for k in kinds[i % 5]]) for i in range(100)]
    spark.createDataFrame(rows, "i int, mods array<struct<change_type:string>>").write.parquet(f"{tmp_path}/t")
    out = filters.cap_modify_only(spark.read.parquet(f"{tmp_path}/t"), 0.25, ["i"], dedupe_empty=dedupe)
    got = sorted((r["part"], r["i"]) for r in out.collect())
    # Of 40 commits without any other change the first 10 stay: every fifth and those without changes in turn.
    first = sorted(i for i, _ in rows if i % 5 in (0, 2))[:10]
    want = [(0, i) for i, _ in rows if i % 5 in (1, 2)] + [(1, i) for i in first if not dedupe or i % 5 == 0]
    assert got == sorted(want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == (1 if dedupe else 2)


def test_a_large_dictionary_is_not_sent(spark, monkeypatch):
    monkeypatch.setattr(sequences, "MAX_BROADCAST_BYTES", 3)
    df = spark.createDataFrame([(["abc", "abcd"],)], "w array<string>")
    vocab = spark.createDataFrame([("abcd", 5)], "word string, id int")
    out = sequences.encode(df, "w", vocab)
    assert out.first()["input_ids"] == [4, 5] and "Join" in out._jdf.queryExecution().toString()


def test_first_seen_is_exact_for_any_row_number(spark):
    df = spark.createDataFrame([(1 << 62, "late one"), (3, "early two one"), (5, "two")], "i long, t string")
    seen = stats.word_counts(df, "t", "i")
    at = stats.seen_at(F.col("first_seen"))
    got = {r["word"]: (r["n"], r["row"], r["pos"]) for r in seen.select("word", "n", at[0].alias("row"), at[1].alias("pos")).collect()}
    assert got == {"late": (1, 1 << 62, 0), "one": (2, 3, 2), "early": (1, 3, 0), "two": (2, 3, 1)}
    assert [r["word"] for r in stats.top_k(seen, 4).collect()] == ["two", "one", "early", "late"]


def test_byte_pairs_merge_runs_one_by_one(spark):
    df = spark.createDataFrame([("aaaa " * 100 + "bc " * 90,)], "t string")
    _, merges = bpe.train_bpe(df.withColumn("t", F.regexp_replace("t", " ", "\n")), ["t"], vocab_size=12)
    assert merges[:3] == [("61", "61"), ("6161", "6161"), ("62", "63")]


def test_summary_level_rouge_stems(spark):
    df = spark.createDataFrame([(1, "running dogs\nplayed", "run dog\nplaying")], "id int, prediction string, target string")
    plain = textmetrics.rouge_lsum(df).first()
    stemmed = textmetrics.rouge_lsum(df, stem=True).first()
    assert stemmed["f"] > plain["f"] if "f" in stemmed.asDict() else list(stemmed)[-1] > list(plain)[-1]


def test_text_log_keeps_every_row_by_default(spark, tmp):
    df = spark.range(60_000).select("id", F.lit("t").alias("target"))
    files.append_text_log(df, f"{tmp}/log", 1, ["id"])
    assert spark.read.parquet(f"{tmp}/log").count() == 60_000


def test_metric_tables(spark, tmp):
    total, each = spark.createDataFrame([("all", 1.5)], "m string, v double"), spark.range(3)
    files.write_metrics(total, each, f"{tmp}/m")
    assert spark.read.csv(f"{tmp}/m_each", header=True).count() == 3


class _Cluster:
    """A session on a cluster that names no shared folder."""

    class sparkContext:  # noqa: N801
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return {}

    class conf:  # noqa: N801
        @staticmethod
        def get(key, default=None):
            return default


def test_no_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(_Cluster)


def test_top_ids_settle_ties_and_odd_scores(spark):
    from commitflow.operators.rankmetrics import top_k_ids

    rows = [([1.0, 3.0, 3.0, 2.0, 3.0],), ([float("nan"), None, 1.0],), ([],), (None,), ([5.0, 5.0],)]
    got = spark.createDataFrame(rows, "s array<double>").select(top_k_ids(F.col("s"), 2)).collect()
    assert [r[0] for r in got] == [[1, 2], [2, 0], [], None, [0, 1]]


def test_long_rows_are_compared_in_blocks(spark):
    from commitflow.functions import kernels

    df = spark.range(1).select(
        F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: F.array(i % 7 + 1.0, i % 5 + 1.0)).alias("a"),
        F.array(F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(7.0), F.lit(1.0))).alias("b"),
    )
    got = df.select(kernels.greedy_cosine(F.col("a"), F.col("b")).alias("s")).select("s.*").first()
    assert abs(got["recall"] - 1) < 1e-12 and 0.8 < got["precision"] < 1
