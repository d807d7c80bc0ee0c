import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from commitflow.functions import text as tx
from commitflow.operators import bpe, packing, sequences, spans

IDS = "id int, batch_id int, input_ids array<int>"


def test_pad_inputs_golden(spark):
    rows = [(0, 0, list(range(5, 105))), (1, 0, list(range(5, 50)))]
    out = sequences.pad_inputs(spark.createDataFrame(rows, IDS), 512).orderBy("id").collect()
    assert [len(r["input_ids"]) for r in out] == [102, 102]
    assert out[1]["input_ids"] == [1, *range(5, 50), 2] + [0] * 55
    assert out[1]["attention_mask"] == [1] * 47 + [0] * 55


def test_pad_inputs_truncates(spark):
    df = spark.createDataFrame([(0, 0, list(range(5, 1024)))], IDS)
    ids = sequences.pad_inputs(df, 512).first()["input_ids"]
    assert ids == [1, *range(5, 515), 2]


@pytest.mark.parametrize("shift", [False, True])
def test_decoder_labels_golden(spark, shift):
    rows = [(0, 0, list(range(128))), (1, 0, [0, 1, 2])]
    df = spark.createDataFrame(rows, "id int, batch_id int, msg_ids array<int>")
    a, b = sequences.decoder_labels(df, 200, shift, start_id=9).orderBy("id").collect()
    assert a["labels"] == [1, *range(128), 2]
    assert b["labels"] == [1, 0, 1, 2, 2] + [-100] * 125
    if shift:
        assert a["decoder_ids"] == [9, 1, *range(128)]
        assert b["decoder_ids"] == [9, 1, 0, 1, 2] + [0] * 125
    else:
        assert b["decoder_ids"] == [1, 0, 1, 2, 2] + [0] * 125
    assert b["decoder_mask"] == [1] * 5 + [0] * 125


@pytest.mark.parametrize(
    "message, n, context, target, prefix",
    [
        ("Sort keys before saving", 2, "", "rt keys before saving", "So"),
        ("Sort keys before saving", 4, "", " keys before saving", "Sort"),
        ("Sort keys before saving", 5, "Sort ", "keys before saving", ""),
        ("Sort keys before saving", 7, "Sort", "ys before saving", " ke"),
        ("docs(api): explain limits of v2.3.1-beta", 7, "",
         "i): explain limits of v2.3.1-beta", "docs(ap"),
        ("docs(api): explain limits of v2.3.1-beta", 10, "",
         " explain limits of v2.3.1-beta", "docs(api):"),
        ("docs(api): explain limits of v2.3.1-beta", 31,
         "docs(api): explain limits of", ".3.1-beta", " v2"),
    ],
)
def test_completion_cut_golden(spark, message, n, context, target, prefix):
    df = spark.createDataFrame([(message,)], "message string")
    out = sequences.completion_context(df, None, 512, context_len=n).first()
    assert (out["context"], out["target"], out["prefix"]) == (context, target, prefix)


@pytest.mark.parametrize("ratio", [0.0, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 1.0])
def test_completion_parts_rebuild_the_message(spark, ratio):
    texts = ["fix(core): handle empty input", "a", "Add tests for the parser module"]
    df = spark.createDataFrame([(t,) for t in texts], "message string")
    for r in sequences.completion_context(df, ratio, 512).collect():
        assert r["context"] + r["prefix"] + r["target"] == r["message"]


def test_generation_inputs_pad_left(spark):
    df = spark.createDataFrame([(0, 0, [7, 8]), (1, 0, [])], "id int, batch_id int, context_ids array<int>")
    out = sequences.generation_inputs(df).orderBy("id").collect()
    assert [r["context_ids"] for r in out] == [[1, 7, 8], [0, 0, 1]]
    assert out[1]["decoder_mask"] == [0, 0, 1]


def test_encode_both_ways_and_decode(spark):
    texts = spark.createDataFrame([(0, ["a", "b", "a"]), (1, ["zz"]), (2, [])], "id int, w array<string>")
    vocab = sequences.build_vocab(texts.filter("id = 0"), "w")
    assert {r["word"]: r["id"] for r in vocab.collect()} == {"a": 5, "b": 6}
    want = {0: [5, 6, 5], 1: [4], 2: []}
    for out in (sequences.encode(texts, "w", vocab), sequences.encode_joined(texts, "w", vocab)):
        assert {r["id"]: r["input_ids"] for r in out.collect()} == want
    ids = spark.createDataFrame([(0, [1, 5, 6, -100, 2])], "id int, x array<int>")
    assert sequences.decode(ids, "x", vocab).first()["text"] == "a b"


def test_special_tokens():
    clm = sequences.special_tokens({"eos": 2, "sep": None}, 50, "clm")
    assert (clm["pad"], clm["sep"]) == (2, 50)
    assert sequences.special_tokens({"eos": 2, "sep": 2}, 50, "clm")["sep"] == 50
    assert sequences.special_tokens({"eos": 2, "sep": 3}, 50, "clm")["sep"] == 3
    assert sequences.special_tokens({"eos": 2}, 50, "seq2seq")["pad"] == 50
    assert sequences.special_tokens({"eos": 2, "pad": 0}, 50, "mlm")["pad"] == 0


@pytest.mark.parametrize("eos", [None, 99])
def test_packing_keeps_every_token(spark, small_buckets, eos):
    rng = random.Random(1)
    rows = [(i, i // 40, [i] * rng.choice([0, 1, 5, 23])) for i in range(120)]
    df = spark.createDataFrame(rows, "i int, g int, ids array<int>").repartition(5)
    out = packing.pack_sequences(df, 16, "i", "ids", group="g", eos=eos).orderBy("group", "block")
    got = {}
    for r in out.collect():
        assert len(r["input_ids"]) <= 16
        got.setdefault(r["group"], []).extend(r["input_ids"])
    for g in range(3):
        want = []
        for k, (i, _, ids) in enumerate(r for r in rows if r[1] == g):
            want += ([eos] if eos is not None and k else []) + ids
        assert got[g] == want
    full = packing.pack_sequences(df, 16, "i", "ids", group="g", eos=eos, keep_tail=False)
    assert {len(r["input_ids"]) for r in full.collect()} == {16}


def test_span_lengths():
    assert spans.span_lengths(512, 0.15, 3.0) == (568, 114)
    raw, target = spans.span_lengths(128, 0.5, 3.0)
    assert target <= 128 and raw > 0


def test_span_masks_have_exact_counts_and_rebuild(spark):
    rows = [(i, 0, list(range(100, 100 + n))) for i, n in enumerate([568, 568, 40, 5, 2, 1])]
    df = spark.createDataFrame(rows, IDS)
    masked = spans.span_mask(df, 0.15, 3.0, seed=3, id_cols=["id"])
    again = spans.span_mask(df.repartition(6), 0.15, 3.0, seed=3, id_cols=["id"])
    masks = {r["id"]: r["mask"] for r in masked.collect()}
    assert masks == {r["id"]: r["mask"] for r in again.collect()}
    runs = lambda m: sum(a and not b for a, b in zip(m, [False, *m]))
    assert (sum(masks[0]), runs(masks[0])) == (85, 28)
    assert masks[0] != masks[1] and not masks[0][0]
    assert masks[5] == [False]
    for r in spans.corrupt_spans(masked, 32100, 2).collect():
        assert r["input_ids"][-1] == 2 and r["labels"][-1] == 2
        if r["id"] < 2:
            assert (len(r["input_ids"]), len(r["labels"])) == (512, 114)
        # Sentinel k of the input stands for the tokens behind sentinel k of the labels.
        rebuilt, labels = [], r["labels"][:-1]
        starts = [i for i, t in enumerate(labels) if t > 32000]
        chunks = {
            labels[i]: labels[i + 1 : j] for i, j in zip(starts, [*starts[1:], len(labels)])
        }
        for t in r["input_ids"][:-1]:
            rebuilt += chunks[t] if t > 32000 else [t]
        assert rebuilt == rows[r["id"]][2]


def bpe_plain(words, n_merges):
    words = {tuple(f"{b:02x}" for b in w.encode()): c for w, c in words.items()}
    merges = []
    for _ in range(n_merges):
        pairs = Counter()
        for parts, c in words.items():
            for p in zip(parts, parts[1:]):
                pairs[p] += c
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        merges.append(best)
        merged = Counter()
        for parts, c in words.items():
            out, i = [], 0
            while i < len(parts):
                if parts[i : i + 2] == best:
                    out.append("".join(best))
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            merged[tuple(out)] += c
        words = merged
    return merges


def test_byte_pairs_match_one_by_one_training(spark):
    texts = ["low lower lowest", "new newer newest wider aaaa aaaaa", "é lower é", "low low"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    vocab, merges = bpe.train_bpe(df, ["text"], vocab_size=60)
    import regex

    words = Counter(w for t in texts for w in regex.findall(bpe.WORD, t))
    assert merges == bpe_plain(words, len(merges))
    out = bpe.encode_fixed(df, "text", vocab, merges, 20).collect()
    back = {i: s for s, i in vocab.items()}
    for r in out:
        assert len(r["input_ids"]) == 20 and r["input_ids"][0] == vocab["<s>"]
        body = [back[i] for i in r["input_ids"] if not back[i].startswith("<")]
        text = bytes.fromhex("".join(body)).decode("utf-8", "ignore")
        assert r["text"].startswith(text) and text


def test_byte_pairs_query_takes_diffs_and_messages(spark, monkeypatch):
    from commitflow.operators.changes import render_diff
    from commitflow.plans import sequence_queries, views
    from conftest import SF

    # The training itself takes long at this size: only what it is asked for is looked at, and bytes are encoded.
    asked = []
    vocab = {t: i for i, t in enumerate([*bpe.SPECIAL_TOKENS, *(f"{b:02x}" for b in range(256))])}
    monkeypatch.setattr(bpe, "train_bpe", lambda df, cols, vocab_size=3000: asked.append((cols, vocab_size)) or (vocab, []))
    found = {r.doc_id: r for r in sequence_queries.k5(spark, SF).collect()}
    assert asked == [(["diff", "message"], 3000)]
    rows = render_diff(views.commits(spark, SF)).select("doc_id", "diff", "message").collect()
    assert len(rows) == len(found)
    for r in rows:
        for ids, text in ((found[r.doc_id].input_ids, r.diff), (found[r.doc_id].target_ids, r.message)):
            want = [1, *(b + 5 for b in text.encode()), 2] + [0] * 100
            assert [int(x) for x in ids.split(",")] == want[:100]


def test_lookups_hold_a_part_of_a_batch(spark, monkeypatch):
    df = spark.createDataFrame([(1, ["a", "b", None, "x", "a"]), (2, []), (3, None), (4, ["b"] * 7)], "k int, w array<string>")
    table = spark.createDataFrame([("a", 7), ("b", 8)], "word string, id int")
    sizes = []
    made = F.arrow_udf
    # The function itself, as a worker calls it.
    monkeypatch.setattr(F, "arrow_udf", lambda kind: lambda f: sizes.append(f) or made(kind)(f))
    sequences.encode(df, "w", table)
    look = sizes.pop()
    monkeypatch.setattr(sequences, "ENTRIES", 4)
    taken = []
    take = sequences.pc.take
    monkeypatch.setattr(sequences.pc, "take", lambda a, b: taken.append(len(b)) or take(a, b))
    import pyarrow as pa

    rows = [["a", "b", None, "x", "a"], [], ["b"] * 7]
    got = look(pa.array([["no"], *rows], pa.list_(pa.string())).slice(1))
    assert got.to_pylist() == [[7, 8, 4, 4, 7], [], [8] * 7] and taken == [4, 4, 4]
    assert look(pa.array([[]], pa.list_(pa.string()))).to_pylist() == [[]]


def test_joined_lookup_joins_distinct_entries_only(spark, monkeypatch):
    """a word of many rows crosses the join once a block of rows; what repeats or is null stays as it was."""
    seen = []
    one = sequences.heavy_entries
    monkeypatch.setattr(sequences, "heavy_entries", lambda e, *a: seen.append(e.count()) or one(e, *a))
    rows = [(i % 3, None if i == 5 else ["a", "b", None, "c"] * 50) for i in range(40)]
    df = spark.createDataFrame(rows, "i int, w array<string>").coalesce(2)
    table = spark.createDataFrame([("a", 7), ("b", 8), ("b", 9)], "word string, id int")
    got = sequences.encode_joined(df, "w", table).collect()
    assert seen[0] <= 6
    assert sorted((r.i, r.w is None) for r in got) == sorted((i, w is None) for i, w in rows)
    assert all(r.input_ids == (r.w and [7, 8, 9, 4, 4] * 50) for r in got)


def test_words_are_those_of_split(spark):
    """the plain split and the one for rare blanks find the same words as Python."""
    texts = ["", " ", "\n", "a  b\nc ", "\ta\x0bb", "a\x1cb c　d  ", "é\r\nf", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", tx.words(F.col("t")).alias("w")).collect()
    assert all(r.w == (None if r.t is None else r.t.split()) for r in got)


def test_spans_are_cut_and_replaced_over_whole_batches(spark):
    """no expression walks the entries one by one, and the cuts are those of Spark's own hash."""
    rows = [(g, None if g == 3 else [g + k for k in range(n)]) for g, n in enumerate((0, 1, 2, 9, 40, 700))]
    df = spark.createDataFrame(rows, "g int, input_ids array<int>")
    masked = spans.span_mask(df, 0.15, 3.0, 5, ["g"])
    out = spans.corrupt_spans(masked, 100, 2)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "array_position" not in plan
    h = F.expr("transform(sequence(1, 594), i -> struct(xxhash64(5, 5, 0, i) as h, i))").alias("h")
    cuts = sorted(x["i"] for x in sorted(spark.range(1).select(h).first()["h"])[:34])
    for r in out.collect():
        if r.input_ids is None:
            assert r.mask is None and r.labels is None
            continue
        ids = dict(rows)[r.g]
        inputs, labels, k, j = [], [], 0, 0
        for i, (x, m) in enumerate(zip(ids, r.mask)):
            first = i == 0 or r.mask[i - 1] != m
            k, j = k + (m and first), j + (not m and first)
            inputs += [x] if not m else [100 - k] if first else []
            labels += [x] if m else [100 - j] if first else []
        assert r.input_ids == inputs + [2] and r.labels == labels + [2]
        if r.g == 5:
            clean = [i for i, m in enumerate(r.mask) if not m]
            assert [n for n in range(1, len(clean)) if clean[n] - clean[n - 1] > 1] == cuts
