import shutil

import corpus_pipeline
import public_tokenizers
import pytest
from conftest import SF
from helpers import DOCS, documents, words
from test_simhash import jaccard
from tokenizers import Tokenizer


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_copies", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        out.append(docs)
    return out


def test_decisions_take_effect(spark, stages):
    for before, after in zip(stages, stages[1:]):
        assert after.columns == before.columns
        assert set(map(tuple, after.collect())) <= set(map(tuple, before.collect()))
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[2].collect()}
    clean = [k for k, r in labels.items() if r.quality == 1 and r.toxic == 0]
    assert sum(k in kept for k in clean) >= 0.97 * len(clean)
    poor = [k for k, r in labels.items() if r.quality == 0]
    assert sum(k in kept for k in poor) <= 0.3 * len(poor)


def test_one_of_each_group_stays(stages):
    """Against the exact Jaccard of five-word shingles of all pairs."""
    text = {r.doc_id: r.text or "" for r in stages[2].collect()}
    after = {r.doc_id for r in stages[3].collect()}
    ids = sorted(text)
    pairs = [(a, b, jaccard(text[a], text[b])) for i, a in enumerate(ids) for b in ids[i + 1 :]]
    similar = [(a, b) for a, b, j in pairs if j >= 0.8]
    assert similar and sum(a in after and b in after for a, b in similar) <= 0.1 * len(similar)
    close = {}
    for a, b, j in pairs:
        if j >= 0.65:
            close.setdefault(b, []).append(a)
            close.setdefault(a, []).append(b)
    # Whatever goes has a similar text, and the first of a group stays.
    assert all(k in close for k in ids if k not in after)
    assert all(k in after for k in ids if k not in close)


def test_run_packs_what_was_kept(spark, stages):
    rows = corpus_pipeline.run(spark, SF).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r.doc_id: len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in stages[3].collect()}
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


def test_odd_and_empty_tables(spark, tmp):
    shutil.copy(f"{SF}/labels.parquet", f"{tmp}/labels.parquet")
    for rows in ([], [(1, None, None, None, None), (None, "x y", "en", None, 3), (2, "", "", "", 0), (2, "", "", "", 0)]):
        docs = documents(spark, rows, DOCS, extra=("score", "fp"))
        for _, stage in corpus_pipeline.STAGES:
            found = stage(spark, docs, tmp)
            docs = found if found.columns == docs.columns else docs
            found.collect()


def test_columns_of_the_input_stay_as_they_are(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "'mine' as score", "doc_id as predicted", "true as held_out")
    want = {r.doc_id: tuple(r) for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns[-3:] == ["score", "predicted", "held_out"]
    found = docs.collect()
    assert found and all(tuple(r) == want[r.doc_id] for r in found)


def test_one_row_of_each_group_with_repeated_and_null_ids(spark):
    a, b, c = words(1, 80), words(2, 80), words(3, 80)
    rows = [(1, b), (5, a), (5, b), (1, b), (None, c), (None, c), (7, c), (None, words(4, 80))]
    found = corpus_pipeline.near_copies(spark, documents(spark, rows).repartition(3), SF).collect()
    assert sorted(map(tuple, found), key=str) == sorted([(1, b), (5, a), (7, c), rows[-1]], key=str)
