import numpy as np
from conftest import SF
from pyspark.sql import functions as F

from commitflow.llm.crosspolytope import hadamard, nearest_axes, rotated, search

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k):
    """Exact neighbours of every row whose id is divisible by 50."""
    kept = []
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and any(v):
            kept.append((i, np.array(v, np.float32).astype(float)))
    kept = [x for x in kept if len(x[1]) == len(kept[0][1])]
    out = {}
    for q, a in kept:
        if q % 50 == 0:
            score = {i: float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))) for i, b in kept if i != q}
            out[q] = sorted(((-round(s, 12), i) for i, s in score.items()))[:k]
    return out


def found(df, **options):
    out = {}
    for r in search(df, F.col("vec_id") % 50 == 0, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((-round(r.score, 12), r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def test_hadamard_and_rotation_keep_lengths_and_angles():
    x = np.random.default_rng(1).normal(size=(5, 48))
    y = rotated(x, 3, 1)
    assert y.shape == (5, 64) and np.allclose(x @ x.T, y @ y.T)
    assert np.allclose(hadamard(np.eye(2)), np.array([[1, 1], [1, -1]]) / np.sqrt(2))
    assert nearest_axes(np.array([[0.1, -3.0, 2.0, 0.0]]), 3).tolist() == [[3, 4, 0]]
    assert nearest_axes(np.array([[0.1, -3.0, 2.0, 0.0]]), 1).tolist() == [[3]]


def test_recall_on_the_given_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    want, got = brute([(r.vec_id, r.embedding) for r in df.collect()], 5), found(df)
    assert want.keys() == got.keys()
    assert sum(len({i for _, i in want[q]} & {i for _, i in got[q]}) for q in want) >= 0.9 * 5 * len(want)


def test_ties_copies_and_vectors_that_take_no_part(spark):
    r = np.random.default_rng(2)
    rows = [(k, r.normal(size=8).tolist()) for k in range(1, 60)]
    # A vector that fills the table, scaled and opposite ones, and rows left out.
    rows += [(100 + k, rows[0][1]) for k in range(40)] + [(200, [2 * x for x in rows[0][1]]), (250, [-x for x in rows[0][1]])]
    rows += [(300, None), (350, [0.0] * 8), (400, [float("nan")] * 8), (450, [1.0] * 7 + [None]), (500, [float("inf")] * 8), (None, [1.0] * 8), (550, [1.0] * 3), (600, [])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as id", "2 as v", "3 as bucket").repartition(3)
    # All buckets are looked into, so the answer must be exact; small parts split the buckets.
    for part in (20_000, 3):
        got = found(df, tables=1, probes=16, part=part)
        want = brute(rows, 5)
        assert got.keys() == want.keys()
        for q in want:
            assert [s for s, _ in got[q]] == [s for s, _ in want[q]]
        assert [i for _, i in got[150]] if 150 in got else True
        assert got[100] == want[100]


def test_ties_of_many_scaled_copies(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=8).astype(np.float32).astype(float)
    rows = [(950 + k, (base * 2.0**k).tolist()) for k in range(51)] + [(k, r.normal(size=8).tolist()) for k in range(1, 50)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute(rows, 5)
    assert [i for _, i in want[950]] == [951, 952, 953, 954, 955]
    for options in ({}, {"tables": 1, "probes": 16}, {"tables": 1, "probes": 16, "part": 7}):
        got = found(df, **options)
        assert got[950] == want[950] and got[1000] == want[1000]


def test_few_candidates_are_all_found(spark):
    rows = [(0, [1.0, 0.0]), (1, [-1.0, 0.1]), (2, [0.0, -1.0])]
    assert {i for _, i in found(spark.createDataFrame(rows, SCHEMA), tables=1, probes=1)[0]} == {1, 2}
    assert found(spark.createDataFrame([(0, [1.0])], SCHEMA)) == {}
    assert found(spark.createDataFrame([], SCHEMA)) == {}
    twice = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.5])], SCHEMA)
    assert [i for _, i in found(twice)[0]] == [1]
