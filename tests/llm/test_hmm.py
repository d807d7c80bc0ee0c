import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from helpers import ODD, documents, words

from commitflow.llm.hmm import Model, _segments, baum_welch, expected_counts, log_likelihood, score_documents

WORD = re.compile("[^\x20\x09-\x0d]+")


def random_model(r, states, symbols):
    start, move, emit = r.random(states), r.random((states, states)), r.random((symbols, states))
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def paths(model, x):
    """(states, probability) of every path that emits ``x``."""
    for s in itertools.product(range(len(model.start)), repeat=len(x)):
        p = model.start[s[0]] * model.emit[x[0], s[0]]
        for a, b, o in zip(s, s[1:], x[1:]):
            p *= model.move[a, b] * model.emit[o, b]
        yield s, p


def test_likelihood_and_counts_sum_over_all_paths():
    r = np.random.default_rng(5)
    model = random_model(r, 3, 4)
    seqs = [r.integers(0, 4, n) for n in (1, 5, 2, 5, 3)]
    flat, sizes = np.concatenate(seqs), np.array([len(s) for s in seqs])
    total = [sum(p for _, p in paths(model, x)) for x in seqs]
    assert np.allclose(log_likelihood(model, flat, sizes), np.log(total))
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((4, 3))
    for x, t in zip(seqs, total):
        for s, p in paths(model, x):
            start[s[0]] += p / t
            for a, b in zip(s, s[1:]):
                move[a, b] += p / t
            for o, a in zip(x, s):
                emit[o, a] += p / t
    for got, want in zip(expected_counts(model, flat, sizes), (start, move, emit)):
        assert np.allclose(got, want)


def test_long_sequences_do_not_underflow():
    model = random_model(np.random.default_rng(1), 2, 3)
    score = log_likelihood(model, np.zeros(50_000, np.int64), np.array([50_000]))
    assert np.isfinite(score).all() and score[0] < -1000


def test_updates_raise_the_likelihood(spark):
    from commitflow.llm.hmm import _squeezed

    r = np.random.default_rng(2)
    seqs = [(r.integers(0, 3, 60) + 3 * (k % 2)).astype("<u2") for k in range(40)]
    df = spark.createDataFrame([(k, len(s), bytearray(_squeezed(s))) for k, s in enumerate(seqs)], "doc_id long, n_tokens long, symbols binary")
    flat, sizes = np.concatenate(seqs).astype(np.int64), np.full(40, 60)
    counts = np.bincount(flat, minlength=6).astype(float)
    model, before = Model.first(counts, 2), -np.inf
    for _ in range(6):
        now = log_likelihood(model, flat, sizes).sum()
        assert now > before - 1
        before, model = now, baum_welch(df.repartition(3), model, counts)
    # Two kinds of sequence: more than the entropy of six symbols.
    assert log_likelihood(model, flat, sizes).sum() > len(flat) * math.log(1 / 5)


def test_segments():
    assert _segments(np.array([5, 0, 3, 7]), 3).tolist() == [3, 2, 3, 3, 3, 1]


def brute(rows):
    docs, train = [], Counter()
    for k, text in rows:
        held = k is not None and zlib.crc32(str(k).encode()) % 7 == 2
        tokens = [*(w.encode().lower() for w in WORD.findall(text or "")), b" "]
        docs.append((k, held, tokens))
        if not held:
            train.update(tokens)
    n, v = train.total(), len(train)
    return sorted(
        (k is None, k, held, len(t), sum(train[w] > 0 for w in t), n, round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in t), 6))
        for k, held, t in docs
    )


@pytest.mark.parametrize("block", [40, 32 << 20])
def test_scores(spark, monkeypatch, block):
    from commitflow.llm import hmm

    monkeypatch.setattr(hmm, "BLOCK", block)
    rows = ODD + [(100 + k, words(k % 5, 20) + " \x0bZ\x0c É" * (k % 2)) for k in range(40)]
    df = documents(spark, rows, extra=("block", "codes", "word", "symbol", "held_out")).repartition(3)
    found = score_documents(df).collect()
    got = sorted((r.doc_id is None, r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found)
    assert got == brute(rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)


def test_empty_and_no_training_documents(spark):
    assert score_documents(documents(spark, [])).collect() == []
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    (r,) = score_documents(documents(spark, [(held, "a b")])).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0) and math.isfinite(r.score)


def test_the_model_beats_the_base_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = score_documents(docs).where("held_out").select("n_tokens", "score", "base_score").collect()
    tokens, score, base = (sum(r[i] for r in held) for i in range(3))
    assert len(held) > 10 and score / tokens > base / tokens + 0.1
    assert sum(r.score > r.base_score for r in held) >= 0.9 * len(held)


def test_words_of_a_block_are_split_a_part_at_a_time(monkeypatch):
    import pyarrow as pa
    import pyarrow.compute as pc

    from commitflow.llm import hmm

    texts = pa.array(["A b  a", None, " c b ", "", "d" * 50 + " a", "b e"])
    whole = hmm._words(texts)
    sizes = []
    split = pc.ascii_split_whitespace
    monkeypatch.setattr(hmm, "SPLIT", 8)
    monkeypatch.setattr(hmm.pc, "ascii_split_whitespace", lambda x: sizes.append(len(x)) or split(x))
    words, code, counts = hmm._words(texts)
    assert max(sizes) < len(texts) and sum(sizes) == len(texts)
    assert words.equals(whole[0]) and code.tolist() == whole[1].tolist() and counts.tolist() == whole[2].tolist()
    assert [words[c].as_py() for c in code.tolist()] == ["a", "b", "a", "c", "b", "d" * 50, "a", "b", "e"]
    assert counts.tolist() == [3, 0, 2, 0, 2, 2]
    assert [len(x) for x in hmm._words(pa.array([], pa.string()))] == [0, 0, 0]
    # Rows of a slice are those of a copy.
    rows = [f"Ab C{k} \u00e9 x{k % 7}" for k in range(1000)]
    cut, copy = hmm._words(pa.array(rows).slice(900)), hmm._words(pa.array(rows[900:]))
    assert cut[0].equals(copy[0]) and cut[1].tolist() == copy[1].tolist() and cut[2].tolist() == copy[2].tolist()
