import hashlib
import re

import pytest
from helpers import ODD, documents, words
from pyspark.sql import functions as F

from commitflow.llm.spotsigs import ANCHORS, edited_likeness, likeness, with_signatures

TEXTS = ["", "the of", "The house of the rising sun is in New Orleans", "a-b c, THE; sun and the moon", "|||", words(2, 200), "der Hund und die Katze é"]


def chains(spark, text):
    """Signatures before hashing, word by word."""
    said = [w for w in re.split(r"[^\w]+|_", text.lower()) if w]
    content = [i for i, w in enumerate(said) if w not in ANCHORS]
    hashes = {r.w: r.h for r in spark.createDataFrame([(w,) for w in set(said)], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(8)).alias("h")).collect()} if said else {}
    out = set()
    for k, i in enumerate(content):
        after = said[content[k + 1]] if k + 1 < len(content) else None
        if hashes[said[i]] == 0:
            out.add((f"_{said[i]}", after))
        elif i == 0:
            out.add((f"^_{said[i]}", after))
        elif said[i - 1] in ANCHORS:
            out.add((f"{said[i - 1]}_{said[i]}", after))
    return out


@pytest.mark.parametrize("text", TEXTS)
def test_signatures(spark, text):
    got = with_signatures(spark.createDataFrame([(text,)], "text string"), "text", "s").first()["s"]
    want = chains(spark, text)
    assert got == sorted(set(got))
    if want:
        rows = spark.createDataFrame(list(want), "a string, b string").select(F.xxhash64("a", "b").alias("h")).collect()
        assert set(got) == {r.h for r in rows}
    else:
        assert len(got) == 1


def test_likeness(spark):
    df = spark.createDataFrame([([1, 2, 3], [2, 3, 4, 5]), ([1], [1]), ([1], [2])], "a array<long>, b array<long>")
    assert [r[0] for r in df.select(likeness(F.col("a"), F.col("b"))).collect()] == [0.4, 1.0, 0.0]
    assert [r[0] for r in df.select(likeness(F.col("a"), F.col("b"), 0.5)).collect()] == [0.0, 1.0, 0.0]


def want(rows):
    rows = [(k, t or "") for k, t in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for i, (k, t) in enumerate(rows):
        following, n = rows[(i + 1) % len(rows)][1], len(t) // 4
        out.append((k, len(t), hashlib.sha256((t[: len(t) - n] + following[:n]).encode()).hexdigest()))
    return out


def test_edited_texts(spark):
    rows = [r for r in ODD if r[0] != 4] + [(100 + k, words(k, 40)) for k in range(50)]
    df = documents(spark, rows, extra=("key", "bucket", "guest", "edited", "signatures", "next_text")).repartition(4)
    found = edited_likeness(df).collect()
    got = sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in found), key=lambda r: (r[0] is not None, r[0] or 0))
    assert got == want(rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    long = [r for r in found if r.n_chars > 150]
    assert sum(r.near_edited for r in long) / len(long) > 0.4 and max(r.near_next for r in long) < 0.2


def test_equal_texts_have_equal_fingerprints(spark):
    found = edited_likeness(documents(spark, ODD + [(60, words(1, 4000)), (61, None)])).collect()
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r.fingerprint)
    assert by[7] == by[60] and by[1] == by[2] == by[61] and len(by[4]) == 3
    assert next(r for r in found if r.doc_id == 60).near_next < 0.1
    assert next(r for r in found if r.doc_id == 1).near_next == 1.0


def test_one_row_and_none(spark):
    assert edited_likeness(documents(spark, [])).collect() == []
    (r,) = edited_likeness(documents(spark, [(1, "the sun and the moon shine")])).collect()
    assert r.near_next == 1.0


def test_plan_is_native(spark):
    plan = edited_likeness(documents(spark, ODD))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
