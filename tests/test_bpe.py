"""Byte pairs: batches of merges equal one-by-one training, whatever the driver's sample foresees."""

import random
from collections import Counter

import numpy as np
import pytest
import regex
from conftest import SF
from test_sequences import bpe_plain

from commitflow.operators import bpe
from commitflow.operators.changes import render_diff
from commitflow.plans import views


def plain(texts, n):
    return bpe_plain(Counter(w for t in texts if t for w in regex.findall(bpe.WORD, t)), n)


def random_texts(seed, n=40):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randint(1, 9)))
    return [" ".join(word() for _ in range(r.randint(0, 30))) for _ in range(n)] + [None, "", "aaaaaaaaaaaaa aaaa", "abababab abab"]


@pytest.mark.parametrize("sample", [0, 7, 400_000])
def test_any_sample_gives_the_same_merges(spark, monkeypatch, sample):
    monkeypatch.setattr(bpe, "SAMPLE_WORDS", sample)
    monkeypatch.setattr(bpe, "MOST_AHEAD", 30)
    monkeypatch.setattr(bpe, "LEAST_AHEAD", 3)
    monkeypatch.setattr(bpe, "REWRITE_AFTER", 12)
    texts = random_texts(2)
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    vocab, merges = bpe.train_bpe(df, ["text"], vocab_size=50)
    assert merges == plain(texts, len(merges)) and len(vocab) == 50


def test_vocabulary_holds_each_symbol_once(spark):
    r = random.Random(11)
    texts = ["\n".join("".join(r.choice("aab") for _ in range(r.randint(1, 14))) for _ in range(40)) for _ in range(20)]
    vocab, merges = bpe.train_bpe(spark.createDataFrame([(t,) for t in texts], "text string"), ["text"], vocab_size=200)
    assert merges == plain(texts, len(merges))
    assert len(vocab) == 200 == 5 + len({b for t in texts for b in t.encode()}) + len({a + b for a, b in merges})


def test_given_texts(spark):
    d = render_diff(views.commits(spark, SF)).select("diff", "message").limit(40).cache()
    texts = [t for r in d.collect() for t in r]
    _, merges = bpe.train_bpe(d, ["diff", "message"], vocab_size=200)
    assert len(merges) > 60 and merges == plain(texts, len(merges))


def test_least_count_and_nothing_to_merge(spark):
    df = spark.createDataFrame([("ab ab ab cd",)], "text string")
    vocab, merges = bpe.train_bpe(df, ["text"], min_count=2)
    assert merges == [("61", "62"), ("20", "6162")] and "6364" not in vocab
    empty = spark.createDataFrame([(None,), ("",)], "text string")
    assert bpe.train_bpe(empty, ["text"]) == ({t: i for i, t in enumerate(bpe.SPECIAL_TOKENS)}, [])


def test_changes_follow_the_words():
    """The counts after each merge equal a recount of the words."""
    r = random.Random(4)
    words = [np.array([r.choice([97, 98, 99]) for _ in range(r.randint(1, 12))], "<i4") for _ in range(200)]
    held = bpe.WordSymbols([w.tobytes() for w in words], list(range(1, 201)))
    counts = Counter(dict(zip(*(c.tolist() for c in held.first_changes))))
    for new in range(256, 290):
        code = max(counts, key=lambda c: (counts[c], c))
        a, b = code >> 32, code & 0xFFFFFFFF
        for c, change in bpe._listed(held.merge(a, b, new)):
            counts[c] += change
        recount = Counter()
        for n, w in enumerate(held.words(), 1):
            s = np.frombuffer(w, "<i4").tolist()
            for x, y in zip(s, s[1:]):
                recount[(x << 32) | y] += n
        assert {c: n for c, n in counts.items() if n} == recount


def test_words_behind_the_cut_stay_in_the_jvm(spark):
    df = spark.createDataFrame([("ab ab ab ab ab",), ("",), (None,), ("ab",)], "t string")
    vocab = {t: i for i, t in enumerate([*bpe.SPECIAL_TOKENS, "61", "62", "20", "6162", "206162"])}
    merges = [("61", "62"), ("20", "6162")]
    out = bpe.encode_fixed(df.where("t is not null"), "t", vocab, merges, 4)
    assert "slice(" in out._jdf.queryExecution().analyzed().toString()
    assert [r.input_ids for r in out.collect()] == [[1, 8, 9, 9], [1, 2, 0, 0], [1, 8, 2, 0]]


def test_rounds_are_few_where_words_are_long(spark, monkeypatch):
    """what a round settles depends on the counts of pairs, not on a sample that rare and long words are not in."""
    r = random.Random(7)
    texts = ["".join(r.choice("abcd") for _ in range(80)) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    passes = []
    one = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, *a, **k: passes.append(1) or one(self, *a, **k))
    vocab, merges = bpe.train_bpe(df, ["text"], vocab_size=160)
    assert merges == plain(texts, len(merges)) and len(vocab) == 160
    assert len(passes) < 10


def test_a_symbol_made_again_ends_a_round():
    """its pairs stand on several pairs of the round's beginning, some of them not live: they are counted anew."""
    words = [np.frombuffer(w, np.uint8).astype("<i4").tobytes() for w in (b"abc", b"xabc", b"ab")]
    for known, want in (("78", [("61", "62"), ("6162", "63"), ("78", "616263")]), ("616263", [("61", "62"), ("6162", "63")])):
        symbols = bpe._Symbols()
        symbols.of(known)
        made = bpe._played(bpe.WordSymbols(words, [3, 2, 9]), symbols, 2, lambda merge: True)
        assert [(symbols.texts[a], symbols.texts[b]) for a, b, _ in made] == want


def test_words_are_those_of_the_regex(spark):
    """whole batches are cut at once, and the words are those that the JVM finds text by text."""
    r = random.Random(5)
    letters = "abstmdrevl'' \n\t\x0b\r .,1é２\u00a0\u3000\x85\x1cß漢😀\ufeff"
    odd = [None, "", "'", "'s", " 's", "a's", "'r", "'re", "''re", "'ll'd", "x \n 's", "a ", "  ", "\n'v"]
    texts = odd + ["".join(r.choice(letters) for _ in range(r.randint(0, 12))) for _ in range(2000)]
    df = spark.createDataFrame([(t, "it's") for t in texts], "t string, u string")
    words = df.select(bpe.F.explode(bpe.pre_words(bpe.F.col("t"))).alias("w")).groupBy("w").count().collect()
    want = Counter({x["w"].encode(): x["count"] for x in words}) + Counter({b"it": len(texts), b"'s": len(texts)})
    found = bpe.word_table(df, ["t", "u"]).collect()
    assert {np.frombuffer(x.symbols, "<i4").astype(np.uint8).tobytes(): x.n for x in found} == want
    assert len(found) == len(want)


def test_fixed_entries_of_long_texts(spark):
    """what is looked for in the head of a text is what the whole text gives."""
    r = random.Random(3)
    odd = ["a" * 500, "é" * 200 + " a's " * 9, " " * 300 + "x", "ab'r" * 40, "", "a b c d e f g", "漢字" * 90 + "'re it's"]
    texts = odd + ["".join(r.choice("ab' \nreé") for _ in range(r.randint(0, 300))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    vocab, merges = bpe.train_bpe(df, ["t"], vocab_size=40)
    rank = {m: i for i, m in enumerate(merges)}

    def ids(word):
        parts = [f"{b:02x}" for b in word.encode()]
        while found := [p for p in zip(parts, parts[1:]) if p in rank]:
            best, out = min(found, key=rank.get), []
            while parts:
                n = 2 if tuple(parts[:2]) == best else 1
                out, parts = [*out, "".join(parts[:n])], parts[n:]
            parts = out
        return [vocab[p] for p in parts]

    for length in (1, 3, 8, 40):
        out = bpe.encode_fixed(df, "t", vocab, merges, length).select("t", "input_ids", bpe.pre_words(bpe.F.col("t")).alias("w")).collect()
        for x in out:
            assert x.input_ids == [*([1] + [i for w in x.w for i in ids(w)] + [2]), *[0] * length][:length]
