import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from helpers import words
from pyspark.sql import functions as F

from commitflow.llm import collocations as C
from commitflow.llm.collocations import collocations, collocations_sql, frequent_phrases, pack, read_words, unpack

SCHEMA = "doc_id long, lang string, text string"
FOLD = str.maketrans(C._UPPER, C._LOWER)


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD))]


def counts(rows, longest):
    f, n = Counter(), Counter()
    for _, lang, text in rows:
        lang = lang or "und" if lang is None else lang
        for ws in pieces(text):
            n[lang] += len(ws)
            for s in range(1, longest + 1):
                f.update((lang, tuple(ws[i : i + s])) for i in range(len(ws) - s + 1))
    return f, n


def want(rows, threshold, longest, top, inside=50):
    f, n = counts(rows, longest)
    found = {}
    cands = {k: a for k, a in f.items() if len(k[1]) >= 2 and a >= threshold}
    around = Counter()
    for (lang, p), a in cands.items():
        for s in range(2, len(p)):
            for i in range(len(p) - s + 1):
                around[lang, p[i : i + s]] = max(around[lang, p[i : i + s]], a)
    for (lang, p), a in cands.items():
        if around[lang, p] and 100 * around[lang, p] >= inside * a:
            continue
        score, k = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    out = []
    for lang, mine in found.items():
        for rank, (score, a, p, left, right) in enumerate(sorted(mine)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def corpus(seed, docs=120):
    r = random.Random(seed)
    said = ["a", "b", "New", "York", "city", "é", "ÀB", "the", "of", "x"]
    text = lambda: "".join(r.choice(said) + r.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(r.randint(0, 60)))
    rows = [(i, r.choice(["en", "de", None, ""]), text()) for i in range(docs)]
    return rows + [(None, "en", None), (1, "und", "new york city " * 30), (1, "und", "new york city " * 30), (5, "fr", "one two"), (6, "xx", "")]


@pytest.mark.parametrize("shards, longest, slots", [(1, 2, None), (4, 3, None), (3, 4, 64)])
def test_against_brute_force(spark, shards, longest, slots):
    """Few slots activate phrases without need; the rows stay the same."""
    rows = corpus(shards)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    threshold, top = (10, 2000) if slots else (3, 7)
    got = collocations(df, threshold, longest, top, shards=shards, slots=slots).collect()
    assert sorted(map(tuple, got)) == want(rows, threshold, longest, top)


def test_phrases_that_become_frequent_late(spark):
    """Words that reach the threshold in the last shards: their phrases need a second and third round."""
    rows = [(i, "en", "red green blue" if i % 2 else words(i, 30)) for i in range(24)]
    got = {(r.n, r.phrase): r.f for r in frequent_phrases(spark.createDataFrame(rows, SCHEMA).repartition(1), 12, 3, shards=6).collect()}
    assert got[3, "red green blue"] == got[2, "red green"] == got[1, "blue"] == 12


def test_one_frequent_phrase_holds_a_third(spark):
    rows = [(i, "en", "the same line again") for i in range(3000)] + [(i, "en", words(i, 8)) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    assert sorted(map(tuple, collocations(df, 10, 3, 50).collect())) == want(rows, 10, 3, 50)


def test_sql_twin(spark):
    rows = corpus(8)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, lang varchar, text varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    got = sorted(map(tuple, collocations(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == sorted(con.execute(collocations_sql()).fetchall()) and got


def test_large_counts_are_exact(spark):
    """Counts whose products pass 64 bits."""
    counted = spark.createDataFrame([("en", 1, "a", 3_000_000_000_000), ("en", 1, "b", 2_999_999_999_999), ("en", 2, "a b", 2_999_999_999_998), ("en", 0, "", 10**13)], "lang string, n int, phrase string, f long")
    old, C.frequent_phrases = C.frequent_phrases, lambda *a, **k: counted
    try:
        (r,) = collocations(counted).collect()
    finally:
        C.frequent_phrases = old
    a, left, right = 2_999_999_999_998, 3_000_000_000_000, 2_999_999_999_999
    assert (r.a, r.l, r.r, r.score) == (a, left, right, 10**6 * a * a // (left * right))


def test_pack_round_trip():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 48, 1000, dtype=np.uint64))
    for k, c in ((keys, np.arange(len(keys)) + 1), (keys[:1], np.array([1 << 40]))):
        a, b = unpack(pack(k, c))
        assert (a == k).all() and (b == c).all()


def test_chunks_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(C, "CHUNK", 50)
    texts = [words(1, 200).replace(" c", ". c"), "short", "", "x" * 300, "a b c " * 40]
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de", "en", "en", "en"]), pa.array(texts)], ["lang", "text"])
    got = Counter()
    for lang, text in C._texts(iter([batch])):
        for ws in pieces(text.decode()):
            got.update((lang, *ws[i : i + 3]) for i in range(len(ws) - 2))
    want = Counter()
    for lang, text in zip(batch["lang"].to_pylist(), texts):
        for ws in pieces(text):
            want.update((lang, *ws[i : i + 3]) for i in range(len(ws) - 2))
    assert got == want


def test_words_of_a_chunk():
    w = read_words("en", "A b\t c.D,,e é!\n".encode())
    assert [w.distinct[c].decode() for c in w.codes] == ["a", "b", "c", "d", "e", "é"]
    assert w.ends.tolist() == [False, False, True, True, False, True]
    assert len(read_words("en", b"").codes) == len(read_words("en", b" .,\n").codes) == 0


def test_odd_tables(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collocations(spark.createDataFrame([(1, None, None), (2, "en", "  \t.")], SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, "en", "One two. " * 400_000)], SCHEMA).select("*", *(F.lit("c").alias(c) for c in ("n", "phrase", "shard", "f", "a")))
    assert [tuple(r) for r in collocations(df).collect()] == [("en", 1, "one two", 400_000, 400_000, 400_000, 800_000, 1_000_000)]
