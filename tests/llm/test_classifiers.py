import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from conftest import SF
from helpers import ODD, documents, words

from commitflow.llm.labelled import labelled_sample
from commitflow.llm.quality import CELL, STEP, WIDTH, Network, fit_network, quality_scores, repeated, symbols
from commitflow.llm.toxicity import Words, features, fit, fit_words, offending_sentences, toxicity_scores


def sample(good, bad):
    rows = [(t, 1, 1.0) for t in good] + [(t, 0, 1.0) for t in bad]
    return pd.DataFrame(rows, columns=["text", "y", "weight"])


def auc(y, s):
    order = pd.Series(s).rank().to_numpy()
    y = np.asarray(y)
    return (order[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def direct(network, text):
    """The network's answer for one text, position by position."""
    x, cells = symbols([text])
    answers = []
    for i in range(0, int(cells[0]) * CELL, STEP):
        answers.append(sum(network.embed[x[i + w]] @ network.kernel[w] for w in range(WIDTH)))
    by_cell = np.array(answers).reshape(int(cells[0]), -1, len(network.bias)).max(1)
    chunk = np.maximum(by_cell, np.concatenate([by_cell[1:], by_cell[-1:]]))
    active = np.maximum(chunk + network.bias, 0)
    return 1 / (1 + np.exp(-(np.concatenate([active.max(0), active.mean(0)]) @ network.out + network.base)))


def test_network_covers_the_whole_text():
    network = Network()
    network.out[:] = 1
    texts = [b"", b"a", b"x" * 63, b"y" * 64, b"z" * 200, words(1, 300).encode()]
    got = network.scores(texts)
    assert np.allclose(got, [direct(network, t)[0] for t in texts], atol=1e-5)
    assert np.allclose(got, [network.scores([t])[0] for t in texts], atol=1e-6)
    assert np.allclose(Network.loaded(network.saved()).scores(texts), got)
    assert network.scores([]).tolist() == []
    # A change anywhere, the last byte too, is seen by some filter.
    x = symbols([b"z" * 200])[0]
    y = symbols([b"z" * 199 + b"!"])[0]
    assert (x != y).any() and not np.allclose(network.cells(x)[0], network.cells(y)[0])


def test_gradient_lowers_the_loss():
    rows = sample([words(k, 60) for k in range(30)], [" | ".join(words(k, 60).split()) for k in range(100, 130)])
    network = Network()
    texts, y = [t.encode() for t in rows["text"]], rows["y"].to_numpy(float)

    def loss():
        p = network.scores(texts)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    before = loss()
    for _ in range(60):
        network.learn(texts, y, np.ones(len(y)), 0.01)
    assert loss() < before / 2


def test_repeated():
    seen = repeated(np.frombuffer(b"abcdefg-abcdefg-xyz", np.uint8))
    assert np.flatnonzero(seen).tolist() == [13, 14, 15]
    assert not repeated(np.frombuffer(b"abc", np.uint8)).any()


def test_fits_agree_and_need_two_labels():
    rows = sample([words(k, 40) for k in range(20)], ["&&& " + words(k, 40) for k in range(50, 70)])
    assert fit_network(rows, 1) == fit_network(rows, 1)
    for only, side in ((rows[rows.y == 1], 1), (rows[rows.y == 0], 0)):
        assert (Network.loaded(fit_network(only.reset_index(drop=True))).scores([b"a", b""]) > 0.5).all() == bool(side)
    assert Network.loaded(fit_network(rows[:0])).scores([b"a"]).tolist() == [0.5]


def labelled(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    return docs, spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet")


def test_sample_never_holds_out_rows_and_is_bounded(spark):
    docs, labels = labelled(spark)
    found = labelled_sample(docs, labels, "quality", 5, 0, 20).collect()
    assert len(found) == 40 and {r.y for r in found} == {0, 1}
    held = {r.doc_id for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    texts = {r.text for r in docs.where(docs.doc_id.isin(*held)).collect()}
    free = {r.text for r in docs.where(~docs.doc_id.isin(*held)).collect()}
    assert not {r.text for r in found} & (texts - free)


@pytest.mark.parametrize(("scores", "label", "mod", "held", "least"), [(quality_scores, "quality", 5, 0, 0.97), (toxicity_scores, "toxic", 3, 1, 0.75)])
def test_held_out_documents(spark, scores, label, mod, held, least):
    docs, labels = labelled(spark)
    found = scores(docs.selectExpr("*", "true as held_out", "1 as predicted"), labels).join(labels, "doc_id").toPandas()
    assert (found["held_out"] == [zlib.crc32(str(k).encode()) % mod == held for k in found["doc_id"]]).all()
    out = found[found["held_out"]]
    assert auc(out[label], out["score"]) > least
    assert ((found["score"] >= 0) & (found["score"] <= 1)).all()
    clean = out[(out["quality"] == 1) & (out["toxic"] == 0)]
    kept = clean["predicted"] == (1 if label == "quality" else 0)
    assert kept.mean() > 0.98


@pytest.mark.parametrize("scores", [quality_scores, toxicity_scores])
def test_odd_rows(spark, scores):
    docs = documents(spark, ODD, extra=("score", "y", "weight", "model"))
    for labels in ([], [(4, 1, 1), (5, 0, 0), (None, 1, None), (77, None, 1), (4, 1, 1)]):
        found = scores(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
        assert sorted(map(str, ((r.doc_id, r.text) for r in found))) == sorted(map(str, ODD))
        by_text = {}
        for r in found:
            assert 0 <= r.score <= 1 and by_text.setdefault(r.text or "", r.score) == r.score
    assert scores(documents(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def test_noisy_or_learns_the_offending_sentences():
    r = np.random.default_rng(3)
    vocab = [words(k, 1) + str(k) for k in range(200)]
    vocab = ["".join(c for c in w if c.isalpha()) + "abcdefghij"[k % 10] * 3 for k, w in enumerate(vocab)]

    def text(bad):
        said = [" ".join(r.choice(vocab, 8)) for _ in range(6)]
        if bad:
            said[int(r.integers(6))] += " vile" + r.choice(["", "ly", "ness"])
        return ". ".join(said) + "."

    bad, good = [text(True) for _ in range(60)], [text(False) for _ in range(200)]
    rows = pd.DataFrame([(t, 1, 1.0) for t in bad] + [(t, 0, 1.0) for t in good], columns=["text", "y", "weight"])
    model = Words(fit_words(rows))
    score = model.scores(pa.array([text(True) for _ in range(50)] + [text(False) for _ in range(50)]))
    assert (score[:50] > 0.7).all() and (score[50:] < 0.3).all()
    t = text(True)
    found = model.locate(t)
    assert len(found) == 1 and "vile" in t[found[0][0] : found[0][1]]
    assert model.locate("") == [] and model.scores(pa.array([None, "", "..."], pa.string())).tolist()[0] == 0


def test_offending_sentences(spark):
    docs, labels = labelled(spark)
    model = fit(docs, labels)
    found = offending_sentences(docs, model).toPandas()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(found) and all(texts[r.doc_id][r.start : r.end] == r.sentence for r in found.itertuples())
    assert offending_sentences(documents(spark, ODD), model).count() >= 0


def test_features():
    assert features("stupid") == ["stupid", "stup*", "stupi*"] and features("a") == ["a"]


def test_the_fit_scans_nothing(spark):
    """The tables are read by their own tasks; only the sample crosses an exchange to the fitting task."""
    from commitflow.llm import labelled

    plans = []
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    sample = labelled.labelled_sample(docs, labels, "quality", 5, 0, 50)
    plans.append(sample.repartition(1).mapInPandas(lambda b: b, sample.schema)._jdf.queryExecution().executedPlan().toString())
    assert labelled.fitted(sample, lambda rows: str(len(rows)).encode()) == str(sample.count()).encode()
    top = plans[0][: plans[0].index("Exchange")]
    assert "MapInPandas" in top and "Scan" not in top and "Coalesce" not in top
