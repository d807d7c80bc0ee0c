import random

import pytest
from pyspark.sql import functions as F

from commitflow.operators import merge, rows, sampling


def numbered(spark, n=1000, parts=4):
    return spark.range(n, numPartitions=parts).select(
        "id", F.pmod(F.xxhash64("id"), F.lit(1000)).cast("int").alias("v")
    )


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_row_index_is_total_order(spark, small_buckets, parts):
    df = numbered(spark, 1000, parts)
    got = rows.with_row_index(df, ["v", "id"]).collect()
    want = sorted((r["v"], r["id"]) for r in df.collect())
    assert sorted((r["row_idx"], r["v"], r["id"]) for r in got) == [
        (i, v, k) for i, (v, k) in enumerate(want)
    ]


def test_row_index_nulls_and_text(spark, small_buckets):
    data = [(None if i % 7 == 0 else f"k{i % 13}", i) for i in range(300)]
    df = spark.createDataFrame(data, "k string, i int").repartition(5)
    got = sorted((r["row_idx"], r["k"] or "", r["i"]) for r in rows.with_row_index(df, ["k", "i"]).collect())
    want = sorted((k or "", i) for k, i in data)
    assert [(k, i) for _, k, i in got] == want
    assert [n for n, _, _ in got] == list(range(300))


def test_row_index_empty(spark):
    assert rows.with_row_index(spark.range(0), ["id"]).count() == 0


def test_running_total_with_hot_key(spark, small_buckets):
    data = [(None if i % 10 == 0 else "hot" if i % 3 else f"k{i % 5}", i, i % 7) for i in range(900)]
    df = spark.createDataFrame(data, "k string, i int, n int").repartition(6)
    got = {r["i"]: r["running"] for r in rows.running_total(df, "n", ["i"], ["k"]).collect()}
    sums, want = {}, {}
    for k, i, n in data:
        sums[k] = sums.get(k, 0) + n
        want[i] = sums[k]
    assert got == want


def test_running_total_without_key(spark, small_buckets):
    df = spark.range(500, numPartitions=7).withColumn("n", F.col("id") % 5)
    got = {r["id"]: r["running"] for r in rows.running_total(df, "n", ["id"]).collect()}
    at = 0
    for i in range(500):
        at += i % 5
        assert got[i] == at


def greedy(sizes, max_tokens, max_entries):
    out, batch, tokens, entries = [], 0, 0, 0
    for n in sizes:
        if entries and (tokens + n > max_tokens or entries >= max_entries):
            batch, tokens, entries = batch + 1, 0, 0
        out.append(batch)
        tokens, entries = tokens + n, entries + 1
    return out


@pytest.mark.parametrize("segment", [10, 37, 1000])
def test_batches_match_a_plain_loop(spark, small_buckets, segment):
    rng = random.Random(segment)
    sizes = [rng.choice([0, 1, 3, 9, 30, 70]) for _ in range(700)]
    df = spark.createDataFrame(list(enumerate(sizes)), "i int, n int").repartition(4)
    out = rows.batch_by_tokens(df, ["i"], "n", 50, 10, segment_rows=segment)
    got = [r["batch_id"] for r in out.orderBy("i").collect()]
    assert got == greedy(sizes, 50, 10)


def test_batches_per_group(spark, small_buckets):
    rng = random.Random(3)
    data = [("train" if i % 3 else "test", i, rng.randint(0, 20)) for i in range(400)]
    df = spark.createDataFrame(data, "split string, i int, n int").repartition(4)
    out = rows.batch_by_tokens(df, ["i"], "n", 50, 8, by="split", segment_rows=16)
    got = {(r["split"], r["i"]): r["batch_id"] for r in out.collect()}
    for split in ("train", "test"):
        mine = [(i, n) for s, i, n in data if s == split]
        want = greedy([n for _, n in mine], 50, 8)
        assert [got[split, i] for i, _ in mine] == want


@pytest.mark.parametrize("fan", [3, 256])
def test_batches_over_a_thousand_segments(spark, monkeypatch, fan):
    monkeypatch.setattr(rows, "FAN", fan)
    rng = random.Random(fan)
    sizes = [rng.choice([0, 1, 2, 4, 9, 60]) for _ in range(8_003)]
    data = [("a", i, n) for i, n in enumerate(sizes)] + [(None, i, n) for i, n in enumerate(sizes[:17])]
    df = spark.createDataFrame(data, "g string, i int, n int").repartition(4)
    out = rows.batch_by_tokens(df, ["i"], "n", 50, 8, by="g", segment_rows=8)
    got = {(r["g"], r["i"]): r["batch_id"] for r in out.collect()}
    assert [got["a", i] for i in range(len(sizes))] == greedy(sizes, 50, 8)
    assert [got[None, i] for i in range(17)] == greedy(sizes[:17], 50, 8)


def test_bisect(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 9)], "batch_id string, i int")
    failed = spark.createDataFrame([("a",), ("b",)], "batch_id string")
    got = {(r["i"], r["batch_id"]) for r in rows.bisect_batches(df, failed, "i").collect()}
    assert got == {
        (0, "a_split_0"), (1, "a_split_0"), (2, "a_split_1"), (3, "a_split_1"), (4, "a_split_1"), (9, "b"),
    }


def test_shards_are_named_by_offset(spark):
    got = rows.shard_fixed(spark.range(5), 2, ["id"]).orderBy("id").collect()
    assert [r["shard"] for r in got] == ["000000", "000000", "000002", "000002", "000004"]


def test_sampling_does_not_depend_on_partitions(spark, small_buckets):
    a, b = numbered(spark, 500, 1), numbered(spark, 500, 16)
    ids = lambda df: {r["id"] for r in df.collect()}
    assert ids(sampling.sample_n(a, 50, ["id"], 1)) == ids(sampling.sample_n(b, 50, ["id"], 1))
    assert ids(sampling.sample_n(a, 50, ["id"], 1)) != ids(sampling.sample_n(a, 50, ["id"], 2))
    sa, sb = (sampling.split_random(x, 0.2, ["id"], 9) for x in (a, b))
    test = lambda df: ids(df.filter("split = 'test'"))
    assert test(sa) == test(sb) and len(test(sa)) == 100
    assert sampling.sample_like(a, spark.range(33), ["id"], 4).count() == 33
    assert sampling.pick_row(a, -1, ["id"], 4).count() == 1


def test_shuffled_batches_keep_the_short_one(spark, small_buckets):
    out = rows.assign_batches(numbered(spark, 105), 10, ["id"], shuffle=True, seed=1)
    sizes = sorted(r["count"] for r in out.groupBy("batch_id").count().collect())
    assert sizes == [5] + [10] * 10


def test_merge_by_position_checks_counts(spark):
    with pytest.raises(ValueError):
        merge.merge_by_position(
            spark.range(3), spark.range(2).withColumnRenamed("id", "x"), ["x"], ["id"], ["x"], drop=[]
        )


@pytest.mark.parametrize("n", [0, 1, 7, 250, 299, 300, 400])
def test_take_first_is_a_prefix(spark, small_buckets, n):
    data = [(None if i % 7 == 0 else f"k{i % 13}", i) for i in range(300)]
    df = spark.createDataFrame(data, "k string, i int").repartition(5)
    got = sorted((r["k"] or "", r["i"]) for r in rows.take_first(df, n, ["k", "i"]).collect())
    assert got == sorted((k or "", i) for k, i in data)[:n]


def test_many_ranges_use_the_search(spark, monkeypatch):
    monkeypatch.setattr(rows, "ROWS_PER_BUCKET", 10)
    data = [(None if i % 9 == 0 else f"k{i % 17}", i) for i in range(1000)]
    df = spark.createDataFrame(data, "k string, i int").repartition(5)
    got = sorted((r["row_idx"], r["k"] or "", r["i"]) for r in rows.with_row_index(df, ["k", "i"]).collect())
    assert [(k, i) for _, k, i in got] == sorted((k or "", i) for k, i in data)


def test_many_ranges_are_bounded_in_seconds(spark):
    df = spark.range(60_000, numPartitions=8).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(1 << 40)))
    bucketed, n = rows.range_buckets(df, ["k", "id"], buckets=2500)
    assert 2300 < n <= 2500
    got = bucketed.groupBy("__bucket").agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("__bucket").collect()
    assert all(a["hi"] <= b["lo"] for a, b in zip(got, got[1:])) and max(r["n"] for r in got) < 200


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9])
def test_first_rows_are_exactly_n_on_equal_keys(spark, n):
    df = spark.createDataFrame([(k, i) for i, k in enumerate("aaabbb")], "k string, i int")
    got = sorted(r["k"] for r in rows.take_first(df, n, ["k"]).collect())
    assert got == list("aaabbb"[:n])


def test_a_condition_cannot_part_equal_keys(spark):
    df = spark.createDataFrame([("a",), ("a",)], "k string")
    with pytest.raises(ValueError, match="does not identify a row"):
        rows.first_rows(df, 1, ["k"])


def test_token_batches_keep_null_groups(spark):
    df = spark.createDataFrame([("a", 1, 5), (None, 2, 5), (None, 3, 5), ("null", 4, 5)], "g string, i int, n int")
    got = rows.batch_by_tokens(df, ["i"], "n", max_tokens=5, max_entries=2, by="g", segment_rows=2)
    assert sorted((r["i"], r["batch_id"]) for r in got.collect()) == [(1, 0), (2, 0), (3, 1), (4, 0)]
