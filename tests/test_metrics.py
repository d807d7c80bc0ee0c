import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from commitflow.functions import kernels
from commitflow.functions.porter import stem
from commitflow.operators import rankmetrics, textmetrics


def pairs(spark, rows, many=False):
    kind = "array<string>" if many else "string"
    data = [(i, p, t) for i, (p, t) in enumerate(rows)]
    return spark.createDataFrame(data, f"id int, prediction string, target {kind}")


def test_bleu_with_two_references(spark):
    refs = ["there is a cat on the mat", "a cat is on the mat"]
    df = pairs(spark, [("the cat is on the mat", refs)], many=True)
    assert textmetrics.corpus_bleu(df).first()["bleu"] == pytest.approx(0.7598, abs=1e-4)


def test_bleu_of_equal_text_is_one(spark):
    df = pairs(spark, [("a b c d e", "a b c d e"), ("x, y. z w", "x, y. z w")])
    assert textmetrics.corpus_bleu(df).first()["bleu"] == pytest.approx(1.0)
    assert textmetrics.sacre_bleu(df).first()["bleu"] == pytest.approx(100.0)
    none = pairs(spark, [("a b", "c d"), ("", "x")])
    assert textmetrics.corpus_bleu(none).first()["bleu"] == 0.0
    assert textmetrics.sacre_bleu(none).first()["bleu"] == 0.0


def test_sentence_bleu_smoothing(spark):
    # 1-grams 3/4, 2-grams 1/3, no 3- and 4-grams: 1/(2*2) and 1/(4*1).
    df = pairs(spark, [("a b x d", "a b c d")])
    want = 100 * (3 / 4 * 1 / 3 * 1 / 4 * 1 / 4) ** 0.25
    got = textmetrics.sacre_bleu(df, level="row").first()["bleu"]
    assert got == pytest.approx(want)


def test_rouge_known_values(spark):
    df = pairs(spark, [("My name is John", "Is your name John")])
    value = lambda d: d.first()["fmeasure"]
    assert value(textmetrics.rouge_n(df, 1)) == pytest.approx(0.75)
    assert value(textmetrics.rouge_n(df, 2)) == 0.0
    assert value(textmetrics.rouge_l(df)) == pytest.approx(0.5)
    assert value(textmetrics.rouge_lsum(df)) == pytest.approx(0.5)


def test_rouge_best_and_average(spark):
    df = pairs(spark, [("a b c", ["a b c", "x y z"])], many=True)
    assert textmetrics.rouge_n(df, 1).first()["fmeasure"] == 1.0
    assert textmetrics.rouge_n(df, 1, accumulate="avg").first()["fmeasure"] == 0.5


def test_rouge_stemming(spark):
    df = pairs(spark, [("fixing failing tests", "fixed failed test")])
    assert textmetrics.rouge_n(df, 1).first()["fmeasure"] == 0.0
    assert textmetrics.rouge_n(df, 1, stem=True).first()["fmeasure"] == 1.0


def test_porter_words():
    want = {
        "caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "agreed": "agre",
        "plastered": "plaster", "motoring": "motor", "conflated": "conflat", "hopping": "hop",
        "falling": "fall", "filing": "file", "happy": "happi", "enjoy": "enjoy", "dying": "die",
        "relational": "relat", "rational": "ration", "formalize": "formal", "hopefulness": "hope",
        "electricity": "electr", "adjustable": "adjust", "probate": "probat", "controlling": "control",
        "adoption": "adopt", "generously": "gener", "sky": "sky", "was": "wa", "by": "by",
    }
    assert {w: stem(w) for w in want} == want


def lcs_brute(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev, row = row, [0]
        for j, y in enumerate(b, 1):
            row.append(prev[j - 1] + 1 if x == y else max(prev[j], row[-1]))
    return row[-1]


def distance_brute(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
    return row[-1]


def words(rng, n):
    return [rng.choice("abcd") for _ in range(rng.randint(0, n))]


def test_lcs_and_distance_match_tables():
    rng = random.Random(5)
    for _ in range(500):
        a, b = words(rng, 12), words(rng, 12)
        assert kernels.lcs_length(a, b) == lcs_brute(a, b)
        assert len(kernels._lcs_positions(b, a)) == lcs_brute(a, b)
        table = kernels.EditTable(a, b)
        assert table.distance == distance_brute(a, b)
        _, hyp_wrong, ref_wrong = table.alignment()
        assert len(hyp_wrong) == len(a) and len(ref_wrong) == len(b)


def refs_of(row):
    return row[1:]


def test_clipped_counts_match_counters():
    rng = random.Random(6)
    rows = [[words(rng, 9) for _ in range(rng.randint(2, 4))] for _ in range(200)]
    left, right = pa.array([r[0] for r in rows]), pa.array([r[1:] for r in rows])
    counts = kernels.clipped_counts(left, right, 4)
    grams = lambda s, n: Counter(tuple(s[i : i + n]) for i in range(len(s) - n + 1))
    for r, (p, *refs) in enumerate(rows):
        for n in range(1, 5):
            union = Counter()
            for ref in refs:
                union |= grams(ref, n)
            got = tuple(counts[r, k * 4 + n - 1] for k in range(3))
            assert got == ((grams(p, n) & union).total(), grams(p, n).total(), union.total())
        near = min((abs(len(p) - len(x)), i) for i, x in enumerate(refs_of(rows[r])))[1]
        assert tuple(counts[r, -2:]) == (len(p), len(refs_of(rows[r])[near]))
    texts = pa.array(["abab", "", "é"])
    by_char = kernels.clipped_counts(texts, pa.array([["ab"], ["x"], ["é", "z"]]), 2)
    assert by_char.tolist() == [
        [2, 1, 4, 3, 2, 1, 4, 2], [0, 0, 0, 0, 1, 0, 0, 1], [1, 0, 1, 0, 2, 0, 1, 1],
    ]
    assert kernels._row_ranges(left, right)[-1][1] == len(rows)


@pytest.mark.parametrize(
    "hyp, ref, edits",
    [
        ("a b c d", "a b c d", 0),
        ("c d a b", "a b c d", 1),  # one block move
        ("a b c", "a b c d", 1),
        ("x y z", "a b c", 3),
        ("", "a b", 2),
    ],
)
def test_edit_rate(hyp, ref, edits):
    assert kernels.edit_rate(hyp.split(), ref.split()) == (edits, len(ref.split()))


def test_edit_rate_never_exceeds_the_distance():
    rng = random.Random(7)
    for _ in range(200):
        a, b = words(rng, 10), words(rng, 10)
        assert kernels.edit_rate(a, b)[0] <= max(distance_brute(a, b), 0)


def test_ter_columns(spark):
    df = pairs(spark, [("c d a b", "a b c d"), ("Hello, World!", "hello world"), ("x", "")])
    rows = [r["ter"] for r in textmetrics.ter(df, level="row").orderBy("id").collect()]
    assert rows == [25.0, 0.0, 100.0]
    assert textmetrics.ter(df).first()["ter"] == pytest.approx(100 * 2 / 6)


def test_meteor_known_value():
    hyp = "it is a guide to action which ensures that the military always obeys the commands of the party"
    ref = "it is a guide to action that ensures that the military will forever heed party commands"
    assert kernels.meteor_score(hyp.split(), ref.split()) == pytest.approx(0.6944, abs=1e-4)
    assert kernels.meteor_score(["a"], ["b"]) == 0.0
    assert kernels.meteor_score(["car"], ["auto"], {"car": {"auto"}}) == pytest.approx(0.5)


def test_chrf_of_equal_and_different_text(spark):
    df = pairs(spark, [("abc def", "abcdef"), ("abcdef", "uvwxyz")])
    rows = [r["chrf"] for r in textmetrics.chrf(df, level="row").orderBy("id").collect()]
    assert rows == [pytest.approx(100.0), 0.0]


def test_evaluation_tables_agree_with_single_metrics(spark):
    df = pairs(spark, [("fix the parser", "fix parser bug"), ("add a test case now", "add a test case now")])
    vec = F.array(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)))
    df = df.withColumn("pred_vecs", vec).withColumn("ref_vecs", vec)
    total = textmetrics.evaluate_total(df).first()
    assert total["BLEU"] == pytest.approx(textmetrics.sacre_bleu(df).first()["bleu"])
    assert total["CHRF"] == pytest.approx(textmetrics.chrf(df).first()["chrf"])
    assert total["TER"] == pytest.approx(textmetrics.ter(df).first()["ter"])
    assert total["METEOR"] == pytest.approx(textmetrics.meteor(df).first()["meteor"])
    assert total["BERT-F1"] == pytest.approx(1.0)
    each = textmetrics.evaluate_each(df, keep=["id"]).orderBy("id").collect()
    assert each[1]["BLEU"] == pytest.approx(100.0) and each[1]["TER"] == 0.0


def test_bundle_agrees_with_single_metrics(spark):
    df = pairs(spark, [("fix the parser", "fix parser bug"), ("a b c d e", "a b c d e")])
    df = df.withColumn("split", F.lit("test"))
    got = textmetrics.text_metrics(df).first()
    assert got["sacre_bleu1"] == pytest.approx(textmetrics.corpus_bleu(df, 1).first()["bleu"])
    assert got["sacre_bleu4"] == pytest.approx(textmetrics.corpus_bleu(df, 4).first()["bleu"])
    assert got["rouge2"] == pytest.approx(textmetrics.rouge_n(df, 2).first()["fmeasure"])
    assert got["rougeL"] == pytest.approx(textmetrics.rouge_l(df).first()["fmeasure"])
    wide = textmetrics.prefixed_metrics(textmetrics.text_metrics(df), ["test"])
    assert wide.first()["test/rougeL"] == pytest.approx(got["rougeL"])


def ranked(spark, rows):
    return spark.createDataFrame(rows, "example_id int, pos int, label int, scores array<double>")


def test_ranking(spark):
    rows = [
        (1, 0, 0, [0.9, 0.5, 0.1]),
        (1, 1, 2, [0.9, 0.5, 0.5]),
        (1, 2, -100, [0.0, 0.0, 0.0]),
        (2, 0, -100, [1.0, 0.0, 0.0]),
    ]
    df = rankmetrics.with_top_k(ranked(spark, rows), 2)
    assert [r["top_ids"] for r in df.orderBy("example_id", "pos").collect()][1] == [0, 1]
    # Example 2 has no counted label: it is null, not zero.
    assert rankmetrics.accuracy_at_k(df, 1).first()["accuracy_1"] == 0.5
    assert rankmetrics.mrr_at_k(df, 2).first()["mrr_2"] == 0.5
    # Shifted: the prediction at 0 meets the label 2, the one at 1 an ignored label.
    assert rankmetrics.accuracy_at_k(df, 2, shift=True).first()["accuracy_2"] == 0.0
    rankmetrics.check_ranked(df, 2)
    with pytest.raises(ValueError):
        rankmetrics.check_ranked(df, 3)
    with pytest.raises(ValueError):
        rankmetrics.check_ranked(df.union(df), 2)


def test_one_line_scores_alike_on_both_ways(spark):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice("abcd") for _ in range(rng.randint(1, 12)))
    rows = [(i, text(), text()) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, prediction string, target string")
    lines = textmetrics.rouge_rows(df, "Lsum").orderBy("id").collect()
    assert lines == textmetrics.rouge_rows(df, "L").orderBy("id").collect()
    for _, a, b in rows:
        a, b = a.split(), b.split()
        assert len(kernels._lcs_positions(b, a)) == kernels.lcs_length(a, b)


def moved_rows(rng, n):
    """Pairs of which one is the other with words dropped, added and moved; some pass a machine word."""
    rows = []
    for _ in range(n):
        ref = [rng.choice("abcdefgh") for _ in range(rng.choice([0, 1, 5, 12, 30, 64, 65, 90]))]
        hyp = list(ref)
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(hyp))
            block, hyp = hyp[at : at + 3], hyp[:at] + hyp[at + 3 :]
            to = rng.randint(0, len(hyp))
            hyp[to:to] = block if rng.random() < 0.7 else [rng.choice("xyz")]
        rows.append((hyp, ref))
    return rows


def lists(rows):
    return pa.array(rows, pa.list_(pa.string()))


def test_whole_batches_are_measured_at_once(monkeypatch):
    rows = moved_rows(random.Random(8), 300)
    a, b = kernels._both_sides(lists([h for h, _ in rows]), lists([r for _, r in rows]))
    assert kernels._lcs_lengths(a, b).tolist() == [lcs_brute(h, r) for h, r in rows]
    assert kernels._distances(a, b).tolist() == [distance_brute(h, r) for h, r in rows]
    got = kernels._meteor_scores(lists([h for h, _ in rows]), lists([r for _, r in rows]))
    assert got.tolist() == [kernels.meteor_score(h, r) for h, r in rows]
    # No short row is walked alone.
    monkeypatch.setattr(kernels, "lcs_length", None)
    monkeypatch.setattr(kernels, "distance", None)
    short = [(h, r) for h, r in rows if min(len(h), len(r)) <= 64]
    a, b = kernels._both_sides(lists([h for h, _ in short]), lists([r for _, r in short]))
    assert kernels._lcs_lengths(a, b).tolist() == [lcs_brute(h, r) for h, r in short]
    assert kernels._distances(a, b).tolist() == [distance_brute(h, r) for h, r in short]


def edit_rate_by_all_moves(hyp, ref):
    """The edit rate with every allowed move tried in full."""
    shifts = trials = 0
    while True:
        score = distance_brute(hyp, ref)
        align, hyp_wrong, ref_wrong = kernels.EditTable(hyp, ref).alignment()
        best = None
        for h in range(len(hyp)):
            for r in range(max(0, h - 50), min(len(ref), h + 51)):
                for size in range(1, 11):
                    if hyp[h : h + size] != ref[r : r + size] or h + size > len(hyp) or r + size > len(ref):
                        break
                    if trials >= 1000:
                        break
                    if not any(hyp_wrong[h : h + size]) or not any(ref_wrong[r : r + size]) or h <= align[r] < h + size:
                        continue
                    last = -1
                    for k in range(r - 1, r + size):
                        to = 0 if k < 0 else align[k] + 1
                        if to != last:
                            last = to
                            trials += 1
                            words = kernels._moved(hyp, h, size, to)
                            rank = (score - distance_brute(words, ref), size, -h, -to)
                            best = max(best or (rank, words), (rank, words), key=lambda x: x[0])
        if best is None or best[0][0] <= 0 or trials >= 1000:
            return shifts + score
        shifts, hyp = shifts + 1, best[1]


def test_edit_rate_tries_no_move_in_vain(monkeypatch):
    rows = [(h, r) for h, r in moved_rows(random.Random(9), 120) if 0 < len(r) <= 30]
    assert [kernels.edit_rate(h, r) for h, r in rows] == [(edit_rate_by_all_moves(h, r), len(r)) for h, r in rows]
    # Dropped words only: no block can save an edit, so no alignment is made.
    monkeypatch.setattr(kernels, "EditTable", None)
    ref = [str(i % 50) for i in range(3000)]
    hyp = [w for i, w in enumerate(ref) if i % 5 != 4]
    assert kernels.edit_rate(hyp, ref) == (600, 3000)


def test_too_many_moves_are_not_measured(monkeypatch):
    monkeypatch.setattr(kernels, "_best_move", None)
    rng = random.Random(10)
    hyp, ref = ([rng.choice("ab") for _ in range(400)] for _ in range(2))
    assert kernels.edit_rate(hyp, ref) == (kernels.EditTable(hyp, ref).distance, 400)


def test_sentence_unions_match_every_pair(monkeypatch):
    rng = random.Random(11)
    rows = []
    for _ in range(60):
        refs = [[rng.choice("abcdefgh") for _ in range(rng.choice([0, 2, 9, 30, 70]))] for _ in range(rng.randint(0, 5))]
        preds = [moved_rows(rng, 1)[0][0] if rng.random() < 0.5 or not refs else list(rng.choice(refs)) for _ in range(rng.randint(0, 4))]
        rows.append((preds, refs))

    def by_pairs(preds, refs):
        have, hits = Counter(t for s in preds for t in s), 0
        for s in refs:
            for at in set().union(*(kernels._lcs_positions(s, p) for p in preds)):
                hits += have[s[at]] > 0
                have[s[at]] -= 1
        return hits

    kind = pa.list_(pa.list_(pa.string()))
    hits, n_pred, n_ref = kernels._lsum(pa.array([p for p, _ in rows], kind), pa.array([r for _, r in rows], kind), False)
    assert hits.tolist() == [by_pairs(p, r) for p, r in rows]
    assert n_pred.tolist() == [sum(map(len, p)) for p, _ in rows] and n_ref.tolist() == [sum(map(len, r)) for _, r in rows]
    # Sentences that stand on both sides are followed with no other one.
    monkeypatch.setattr(kernels, "_lcs_positions", None)
    monkeypatch.setattr(kernels, "_mark_common", None)
    same = [[rng.choice("abcdefgh") for _ in range(70)] for _ in range(300)]
    assert kernels._lsum(pa.array([same], kind), pa.array([same[5:]], kind), False)[0].tolist() == [295 * 70]


def test_pieces_are_split_as_whole_texts(spark):
    texts = [
        "a.b, c &amp; d's x's  y'S 3.5-4 -- (e) . ,x 'tis\tq's\tz 7. .8 <skipped>end-\nof line\n-two &quot;w&quot;.",
        "Éa. b'S ", "", " ", "it's", ".,.,", "1,2.3, 4-5", "x .y\u0085,z\x1c.w",
    ]
    df = pairs(spark, [(t, t) for t in texts])
    from commitflow.functions import text as tx

    ways = [
        (tx.prepare_13a(F.col("target"), True), tx.tokenize_13a(F.col("target"), True), tx.split_13a),
        (tx.prepare_ter(F.col("target")), tx.ter_words(F.col("target")), tx.split_ter),
        (F.lower("target"), tx.rouge_words(F.col("target")), tx.split_rouge),
    ]
    for ready, whole, split in ways:
        for row in df.select(ready.alias("t"), whole.alias("w")).collect():
            assert [w for piece in row["t"].split(" ") for w in split(piece)] == row["w"]
    lines = [("a b\n\nc d e", "c d\na b x"), ("", "a"), ("\n", "b\nb"), ("A-b c", "a b c")]
    both = pairs(spark, lines).withColumn("split", F.lit("test"))
    got = textmetrics.text_metrics(both).first()
    for name, kind in (("rouge1", 1), ("rouge2", 2), ("rougeL", "L"), ("rougeLsum", "Lsum")):
        assert got[name] == pytest.approx(textmetrics.rouge_rows(both, kind).agg(F.avg("fmeasure")).first()[0])


def test_ngrams_share_one_sort_and_common_pieces_are_not_split(monkeypatch):
    rng = random.Random(4)
    # Many rows of many words, few long rows, and units behind the end of a row.
    for n_rows, size, kinds in ((3000, 12, 5000), (3, 3000, 2000), (40, 3, 2), (1, 0, 1)):
        sides = [[[f"w{rng.randrange(kinds)}" for _ in range(rng.randint(0, size))] for _ in range(n_rows)] for _ in range(2)]
        left, right = lists(sides[0]), pa.array([[r] for r in sides[1]], pa.list_(pa.list_(pa.string())))
        want = kernels.clipped_counts(left, right, 4)
        grams = lambda s, n: Counter(tuple(s[i : i + n]) for i in range(len(s) - n + 1))
        for row, p, t in zip(want.tolist(), *sides):
            both = [(grams(p, n), grams(t, n)) for n in range(1, 5)]
            assert row[:4] == [(a & b).total() for a, b in both]
            assert row[4:] == [*(a.total() for a, _ in both), *(b.total() for _, b in both), len(p), len(t)]
        # Where no machine word holds an n-gram, each order is numbered alone.
        with monkeypatch.context() as m:
            m.setattr(kernels, "_matches", lambda *a: None)
            assert kernels.clipped_counts(left, right, 4).tolist() == want.tolist()
    # One number for all orders of an n-gram, and no split of a piece of letters only.
    from commitflow.functions import text as tx

    seen = []
    one = kernels._matches
    monkeypatch.setattr(kernels, "_matches", lambda *a: seen.append(1) or one(*a))
    plain = tx.Split.lists
    monkeypatch.setattr(tx.Split, "lists", lambda self, x: seen.extend(x.to_pylist()) or plain(self, x))
    pieces = pa.array([["ab", "x,y", "ab"]])
    counts = kernels.clipped_counts(pieces, pa.array([[["ab", "x", ",", "y"]]]), 2, split=tx.split_13a)
    assert seen.count(1) == 1 and set(seen) == {1, "x,y", ","}
    assert counts.tolist() == [[4, 3, 5, 4, 4, 3, 5, 4]]


def test_texts_are_read_as_the_column_expressions_read_them(spark):
    from commitflow.functions import text as tx

    odd = "".join(chr(c) for c in range(1, 0x3100))
    texts = ["a_b \u0870x\u0871 c\u2028d", "It's\tx\x0by\x1cz \U0001f600é1", "", odd, "  two  blanks "]
    df = pairs(spark, [(t, t + " end") for t in texts])
    tokens = df.select(*[textmetrics._meteor_tokens(F.lower(c)).alias(c) for c in ("prediction", "target")]).collect()
    got = textmetrics.meteor(df, level="row").select("meteor").collect()
    assert [r[0] for r in got] == [kernels.meteor_score(t["prediction"], t["target"]) for t in tokens]
    squeezed = df.select(*[F.array_join(tx.words(F.col(c)), "").alias(c) for c in ("prediction", "target")])
    assert textmetrics.chrf(df).first() == textmetrics.chrf(squeezed).first()
    lengths, _ = kernels._units([pa.array(texts)], False, None, False)
    assert lengths.tolist() == [len(r[0]) for r in squeezed.select("prediction").collect()]


def test_what_both_sides_begin_and_end_with_is_not_sorted(monkeypatch):
    """n-grams inside a shared beginning or end are matches without being counted."""
    seen = []
    one = kernels._matches
    monkeypatch.setattr(kernels, "_matches", lambda lengths, *a: seen.append(int(lengths.sum())) or one(lengths, *a))
    long = "".join(random.Random(7).choice("abcde") for _ in range(400))
    rows = [(long, long), (long + "x" + long, long + long), ("aaaa", "aaa"), (long[50:], long), ("", long), ("é☃b", "é☃")]
    texts, refs = pa.array([p for p, _ in rows]), pa.array([[t] for _, t in rows])
    counts = kernels.clipped_counts(texts, refs, 6)
    for (pred, ref), got in zip(rows, counts.tolist()):
        for n in range(1, 7):
            have, want = (Counter(x[i : i + n] for i in range(len(x) - n + 1)) for x in (pred, ref))
            assert got[n - 1] == (have & want).total()
            assert got[5 + n] == have.total() and got[11 + n] == want.total()
    assert sum(seen) < 600
