import random

import numpy as np
import pytest
import xxhash
from helpers import ODD, documents, words

from commitflow.llm import simhash
from commitflow.llm.components import components
from commitflow.llm.simhash import fingerprint, near_documents, near_duplicates, trie_links, wide_fingerprint


def plain(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", "one", "a b c", "a b c d", "A b C d\x0be É a b c d a b c d", words(3, 300)])
def test_fingerprint(text):
    assert fingerprint(text) == plain(text)


@pytest.mark.parametrize("leaf", [1, 4, 16])
@pytest.mark.parametrize("kind", ["random", "dense", "near"])
def test_links_are_all_pairs_within_the_budget(monkeypatch, leaf, kind):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "CHUNK", 64)
    r = np.random.default_rng(4)
    for n in (0, 1, 2, 7, 300):
        one = np.uint64(1)
        keys = {
            "random": r.integers(0, 1 << 64, n, np.uint64),
            "dense": r.integers(0, 1 << 9, n, np.uint64),
            "near": (one << r.integers(0, 64, n, np.uint64)) ^ (one << r.integers(0, 64, n, np.uint64)),
        }[kind]
        keys = np.unique(keys)
        near = np.bitwise_count(keys[:, None] ^ keys[None, :]) <= 4
        found = [(min(a, b), max(a, b)) for u, v in trie_links(keys, None, 4, 0, 0) for a, b in zip(u.tolist(), v.tolist())]
        assert sorted(found) == sorted(zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1)))))
        a, b = np.sort(keys[::2]), np.sort(keys[1::2])
        assert sum(len(u) for u, _ in trie_links(a, b, 4, 0, 0)) == int((np.bitwise_count(a[:, None] ^ b[None, :]) <= 4).sum())


def brute(rows):
    prints = [plain(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                label[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    return sorted((k is None, k, f"{p:016x}", least.get(root(i))) for i, ((k, _), p) in enumerate(zip(rows, prints)))


def near_copies():
    base = words(9, 200).split()
    return [(100 + k, " ".join(base[:k] + ["changed"] * (k % 3) + base[k + k % 3 :])) for k in range(40)]


@pytest.mark.parametrize("least", [simhash.LEAST_LEAVES, 4])
def test_near_duplicates_against_brute_force(spark, monkeypatch, least):
    # Few leaves a subtree: the trie is cut, and pairs of subtrees of different depth meet.
    monkeypatch.setattr(simhash, "LEAST_LEAVES", least)
    rows = ODD + near_copies() + [(200 + k, words(k, 30)) for k in range(40)]
    df = documents(spark, rows, extra=("fp", "id", "component_id", "least", "root", "node")).repartition(5)
    found = near_duplicates(df)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((r[0] is None, *r) for r in found.collect()) == brute(rows)


def test_empty(spark):
    assert near_duplicates(documents(spark, [])).collect() == []


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 102), (102, 101), (7, 7), (None, 3), (60, 61), (61, 60)]
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    want = {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100, 60: 60, 61: 60}
    assert len(found) == len(want) and dict(map(tuple, found)) == want


def union_find(links):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def test_components_of_a_path_alone(spark):
    # After one round 10 and 5 stand below 1 and 2 both, and no node stands in between.
    found = components(spark.createDataFrame([(1, 10), (10, 5), (5, 11), (11, 2)], "a long, b long")).collect()
    assert sorted(map(tuple, found)) == [(k, 1) for k in (1, 2, 5, 10, 11)]


@pytest.mark.parametrize("seed", [0, 1, 75, 332, 519])
def test_components_of_small_random_graphs(spark, seed):
    r = random.Random(seed)
    links = [x for x in ((r.randrange(20), r.randrange(20)) for _ in range(20)) if x[0] != x[1]]
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted(map(tuple, found)) == sorted(union_find(links).items())


def test_one_large_component_is_joined_apart(spark):
    """20 000 fingerprints of one component: no task gets them all."""
    from pyspark.sql import functions as F

    from commitflow.llm.components import components
    from commitflow.llm.shared import join_sized

    hub = spark.range(1, 20_001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    chain = spark.range(30_000, 30_100).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    roots = components(hub.unionByName(chain))
    got = {(r.root, r.n) for r in roots.groupBy("root").agg(F.count("*").alias("n")).collect()}
    assert got == {(0, 20_001), (30_000, 101)}
    rows = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    table = rows.groupBy("k").agg(F.max("id").alias("top"), F.count("*").alias("n"))
    found = join_sized(rows, table, "k", "n")
    want = rows.join(table.drop("n"), "k")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and "BroadcastHashJoin" in found._jdf.queryExecution().toString()


def plain_wide(text):
    """One bit after another, from the shingles' hashes stretched by the mixing function."""
    w = (text or "").encode().lower().split()
    shingles = {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    most, counts = (1 << 64) - 1, [0] * 512
    for s in shingles:
        for j in range(8):
            x = (xxhash.xxh64_intdigest(s, 42) + (j + 1) * 0x9E3779B97F4A7C15) & most
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & most
            x = (x ^ x >> 27) * 0x94D049BB133111EB & most
            x ^= x >> 31
            for b in range(64):
                counts[64 * j + b] += x >> b & 1
    return np.packbits([2 * c > len(shingles) for c in counts]).tobytes()


@pytest.mark.parametrize("text", [None, "", "one", "a b c d e", "A b C d\x0be É a b c d a b c d", words(3, 300)])
def test_wide_fingerprint(text):
    assert wide_fingerprint(text) == plain_wide(text)


def test_wide_fingerprint_of_a_long_text():
    # More shingles than counters of a byte hold at a time.
    text = " ".join(str(k) for k in range(40_000))
    assert wide_fingerprint(text) == plain_wide(text)


@pytest.mark.parametrize("n", [0, 1, 40, 500])
def test_links_over_leading_bits(n):
    r = np.random.default_rng(n)
    lead = np.sort(r.integers(0, 1 << 9, n, np.uint64) << np.uint64(3))
    keys = lead << np.uint64(40) | np.arange(n, dtype=np.uint64)
    near = np.bitwise_count(lead[:, None] ^ lead[None, :]) <= 2
    found = [(min(a, b), max(a, b)) for u, v in trie_links(keys, None, 2, 0, 0, 24) for a, b in zip(u.tolist(), v.tolist())]
    assert sorted(found) == sorted(zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1)))))


def jaccard(a, b, width=5):
    a, b = (
        {" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set() for w in (x.lower().split() for x in (a, b))
    )
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(text, edits, seed):
    r, w = random.Random(seed), text.split()
    for at in r.sample(range(len(w)), edits):
        w[at] = f"edit{seed}x{at}"
    return " ".join(w)


@pytest.mark.parametrize("keys", [simhash.TRIE_KEYS, 64])
def test_near_documents_finds_similar_texts_only(spark, monkeypatch, keys):
    # Few keys a trie: routing bits part the table, and more tries make up for them.
    monkeypatch.setattr(simhash, "TRIE_KEYS", keys)
    rows = []
    for k in range(300):
        base = " ".join(f"{w}{k}" for w in words(k, 200).split())
        rows += [(2 * k, base), (2 * k + 1, edited(base, (1, 2, 4, 16, 30)[k % 5], k))]
    text = dict(rows)
    found = {r.doc_id: r.component_id for r in near_documents(documents(spark, rows).repartition(4)).collect()}
    assert len(found) == len(rows)
    alike = {k: jaccard(text[k], text[k + 1]) for k in range(0, 600, 2)}
    similar = [k for k, j in alike.items() if j >= 0.8]
    unlike = [k for k, j in alike.items() if j < 0.65]
    assert len(similar) >= 170 and len(unlike) >= 60
    assert sum(found[k + 1] == k for k in similar) >= 0.9 * len(similar)
    assert not any(found[k + 1] == k for k in unlike)
    assert all(found[k] == k for k in alike)


def test_near_documents_of_odd_rows(spark):
    rows = ODD + [(100 + k, words(9, 200) + " end" * (k % 2)) for k in range(30)] + [(None, words(9, 200))]
    df = documents(spark, rows, extra=("print", "id", "class", "least", "root", "copies", "node")).repartition(3)
    found = near_documents(df)
    assert found.columns == ["doc_id", "component_id"] and found.count() == len(rows)
    got = {(r.doc_id, r.component_id) for r in found.collect()}
    assert {(100 + k, 100) for k in range(30)} | {(None, 100)} <= got
    assert near_documents(documents(spark, [])).collect() == []


def test_a_dense_cluster_is_one_component(spark):
    base = words(5, 300)
    rows = [(k, edited(base, k % 4, k)) for k in range(3000)] + [(5000 + k, words(k, 100)) for k in range(50)]
    found = {r.doc_id: r.component_id for r in near_documents(documents(spark, rows)).collect()}
    assert sum(found[k] == 0 for k in range(3000)) >= 2970
    assert all(found[5000 + k] >= 5000 for k in range(50))
