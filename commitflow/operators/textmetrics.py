"""Text-similarity metrics over ``(id, prediction, target)`` tables (section I).

Per-row counts come first, in the row's own task; corpus values are sums of those counts, so the only
shuffle is that of partial sums. ``target`` is one reference (text) or several (array of texts).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels
from ..functions import text as tx

ROUGE_FIELDS = ("precision", "recall", "fmeasure")
CHRF_ORDER, CHRF_BETA = 6, 2


def _text(df: DataFrame, col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def _references(df: DataFrame, target: str, split) -> Column:
    """References as an array of what ``split`` makes of each."""
    if isinstance(df.schema[target].dataType, T.ArrayType):
        return F.transform(target, split)
    return F.array(split(_text(df, target)))


def _sums(field: str, n: int) -> list[Column]:
    return [F.sum(f"{field}_{i}").alias(f"{field}_{i}") for i in range(n)]


# ---------------------------------------------------------------- BLEU


def tokenize_13a(df: DataFrame, col: str, lowercase: bool = False, name: str = "tokens"):
    """I1."""
    return df.withColumn(name, tx.tokenize_13a(F.col(col), lowercase))


def _bleu_counts(df: DataFrame, pred: str, target: str, n: int, lowercase: bool) -> Column:
    ready = lambda c: tx.prepare_13a(c, lowercase)
    return kernels.ngram_counts(ready(_text(df, pred)), _references(df, target, ready), n, split=tx.split_13a)


def _brevity(pred_len: Column, ref_len: Column) -> Column:
    penalty = F.exp(1 - F.try_divide(ref_len.cast("double"), pred_len.cast("double")))
    return F.when(pred_len > ref_len, F.lit(1.0)).otherwise(F.coalesce(penalty, F.lit(0.0)))


def _bleu(
    match: list[Column],
    total: list[Column],
    pred_len: Column,
    ref_len: Column,
    weights: Sequence[float] | None,
    smooth: bool,
) -> Column:
    """Range 0 to 1; without smoothing one order without a match gives 0."""
    n = len(match)
    weights = list(weights or [1.0 / n] * n)
    if len(weights) != n:
        raise ValueError(f"{n} weights are needed")
    bump = [F.lit(1 if smooth and i else 0) for i in range(n)]
    logs = [
        F.lit(w) * F.ln(F.try_divide((m + b).cast("double"), (t + b).cast("double")))
        for m, t, b, w in zip(match, total, bump, weights)
    ]
    zero = F.least(*match) == 0 if n > 1 else match[0] == 0
    score = _brevity(pred_len, ref_len) * F.exp(reduce(lambda a, b: a + b, logs))
    return F.when(zero, F.lit(0.0)).otherwise(F.coalesce(score, F.lit(0.0)))


def corpus_bleu(
    df: DataFrame,
    n: int = 4,
    weights: Sequence[float] | None = None,
    smooth: bool = False,
    lowercase: bool = False,
    by: Sequence[str] = (),
    pred: str = "prediction",
    target: str = "target",
) -> DataFrame:
    """BLEU over all rows (per ``by`` group), from summed n-gram counts."""
    counts = df.select(
        *by, _bleu_counts(df, pred, target, n, lowercase).alias("c")
    ).select(*by, "c.*")
    sums = counts.groupBy(*by).agg(
        *_sums("match", n),
        *_sums("pred", n),
        F.sum("pred_len").alias("pred_len"),
        F.sum("ref_len").alias("ref_len"),
    )
    score = _bleu(
        [F.col(f"match_{i}") for i in range(n)],
        [F.col(f"pred_{i}") for i in range(n)],
        F.col("pred_len"),
        F.col("ref_len"),
        weights,
        smooth,
    )
    return sums.select(*by, score.alias("bleu"))


def _sacre_bleu(
    match: list[Column], total: list[Column], pred_len: Column, ref_len: Column
) -> Column:
    """Range 0 to 100: the k-th order without a match counts as ``1 / (2^k total)``."""
    zeros, logs = F.lit(0), []
    for m, t in zip(match, total):
        zeros = zeros + (m == 0).cast("int")
        logs.append(
            F.when(m == 0, -F.ln(F.pow(F.lit(2.0), zeros) * t)).otherwise(
                F.ln(m.cast("double") / t)
            )
        )
    bad = (reduce(lambda a, b: a + b, match) == 0) | (F.least(*total) == 0)
    brevity = F.when(pred_len >= ref_len, F.lit(1.0)).otherwise(_brevity(pred_len, ref_len))
    score = 100 * brevity * F.exp(reduce(lambda a, b: a + b, logs) / len(match))
    return F.when(bad, F.lit(0.0)).otherwise(score)


def sacre_bleu(
    df: DataFrame,
    level: str = "corpus",
    by: Sequence[str] = (),
    pred: str = "prediction",
    target: str = "target",
    name: str = "bleu",
) -> DataFrame:
    """Lower-cased BLEU-4 with exponential smoothing, over all rows or per row."""
    n = 4
    counts = _bleu_counts(df, pred, target, n, True)
    if level == "row":
        c = lambda f, i: F.col(f"__c.{f}_{i}")
        score = _sacre_bleu(
            [c("match", i) for i in range(n)],
            [c("pred", i) for i in range(n)],
            F.col("__c.pred_len"),
            F.col("__c.ref_len"),
        )
        return df.withColumn("__c", counts).withColumn(name, score).drop("__c")
    sums = (
        df.select(*by, counts.alias("c"))
        .select(*by, "c.*")
        .groupBy(*by)
        .agg(
            *_sums("match", n),
            *_sums("pred", n),
            F.sum("pred_len").alias("pred_len"),
            F.sum("ref_len").alias("ref_len"),
        )
    )
    score = _sacre_bleu(
        [F.col(f"match_{i}") for i in range(n)],
        [F.col(f"pred_{i}") for i in range(n)],
        F.col("pred_len"),
        F.col("ref_len"),
    )
    return sums.select(*by, score.alias(name))


# ---------------------------------------------------------------- ROUGE


def _prf(hits: Column, n_pred: Column, n_ref: Column) -> Column:
    """Precision, recall and F, all zero when either side is empty."""
    p = F.coalesce(F.try_divide(hits.cast("double"), n_pred), F.lit(0.0))
    r = F.coalesce(F.try_divide(hits.cast("double"), n_ref), F.lit(0.0))
    f = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    some = (n_pred > 0) & (n_ref > 0)
    zero = F.lit(0.0)
    return F.struct(
        *[F.when(some, c).otherwise(zero).alias(n) for c, n in zip((p, r, f), ROUGE_FIELDS)]
    )


def _rouge_rows(
    df: DataFrame, target: str, score, accumulate: str, id_cols: Sequence[str], by: Sequence[str]
) -> DataFrame:
    """Row scores; several references are reduced to the best F or to the average."""
    many = isinstance(df.schema[target].dataType, T.ArrayType)
    rows = df.withColumn(target, F.explode(target)) if many else df
    scored = rows.withColumn("__c", score(rows)).select(
        *id_cols, *by, _prf(F.col("__c.hits"), F.col("__c.pred_len"), F.col("__c.ref_len")).alias("s")
    )
    if not many:
        return scored.select(*id_cols, *by, "s.*")
    keys = [*id_cols, *by]
    if accumulate == "best":
        best = scored.groupBy(*keys).agg(F.max_by("s", "s.fmeasure").alias("s"))
        return best.select(*keys, "s.*")
    if accumulate != "avg":
        raise ValueError("accumulate is best or avg")
    return scored.groupBy(*keys).agg(*[F.avg(f"s.{f}").alias(f) for f in ROUGE_FIELDS])


def _ngram_hits(pred: Column, ref: Column, n: int, stem: bool) -> Column:
    c = kernels.ngram_counts(pred, F.array(ref), n, stem, tx.split_rouge)
    return F.struct(
        c[f"match_{n - 1}"].alias("hits"),
        c[f"pred_{n - 1}"].alias("pred_len"),
        c[f"ref_{n - 1}"].alias("ref_len"),
    )


def rouge_rows(
    df: DataFrame,
    kind: int | str,
    accumulate: str = "best",
    stem: bool = False,
    id_cols: Sequence[str] = ("id",),
    by: Sequence[str] = (),
    pred: str = "prediction",
    target: str = "target",
) -> DataFrame:
    """Per-row ROUGE: ``kind`` is an n-gram order, ``"L"`` or ``"Lsum"``."""

    def score(rows: DataFrame) -> Column:
        p, r = _text(rows, pred), _text(rows, target)
        if kind == "Lsum":
            lines = lambda c: F.transform(
                F.filter(F.split(c, "\n"), lambda s: F.trim(s) != ""), tx.rouge_words
            )
            return kernels.lsum_counts(lines(p), lines(r), stem)
        p, r = F.lower(p), F.lower(r)
        if kind == "L":
            return kernels.lcs_counts(p, r, stem, tx.split_rouge)
        return _ngram_hits(p, r, int(kind), stem)

    return _rouge_rows(df, target, score, accumulate, id_cols, by)


def _mean_rouge(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.avg(f).alias(f) for f in ROUGE_FIELDS])


def rouge_n(df: DataFrame, n: int, by: Sequence[str] = (), **kw) -> DataFrame:
    """Mean precision, recall and F of ROUGE-n over rows."""
    return _mean_rouge(rouge_rows(df, n, by=by, **kw), by)


def rouge_l(df: DataFrame, by: Sequence[str] = (), **kw) -> DataFrame:
    """I5, I7."""
    return _mean_rouge(rouge_rows(df, "L", by=by, **kw), by)


def rouge_lsum(df: DataFrame, by: Sequence[str] = (), **kw) -> DataFrame:
    """Sentences are lines."""
    return _mean_rouge(rouge_rows(df, "Lsum", by=by, **kw), by)


# ---------------------------------------------------------------- chrF, TER, METEOR, embeddings


def _chrf_counts(df: DataFrame, pred: str, target: str, order: int) -> Column:
    return kernels.ngram_counts(_text(df, pred), _references(df, target, lambda c: c), order, blanks=False)


def _chrf(counts: list[tuple[Column, Column, Column]], beta: float) -> Column:
    """``counts`` per order: matches, prediction n-grams, reference n-grams."""
    zero = F.lit(0.0)
    both = [(p > 0) & (r > 0) for _, p, r in counts]
    share = lambda m, n, ok: F.when(ok, m.cast("double") / n).otherwise(zero)
    add = lambda cs: reduce(lambda a, b: a + b, cs)
    used = add([ok.cast("int") for ok in both])
    prec = F.try_divide(add([share(m, p, ok) for (m, p, _), ok in zip(counts, both)]), used)
    rec = F.try_divide(add([share(m, r, ok) for (m, _, r), ok in zip(counts, both)]), used)
    b2 = beta * beta
    return F.coalesce(
        100 * F.try_divide((1 + b2) * prec * rec, b2 * prec + rec), F.lit(0.0)
    )


def _countable(c: Column, order: int) -> list[Column]:
    """Prediction n-grams count only where the reference has n-grams of that order."""
    return [
        F.when(c[f"ref_{i}"] > 0, c[f"pred_{i}"]).otherwise(F.lit(0))
        for i in range(order)
    ]


def chrf(
    df: DataFrame,
    order: int = CHRF_ORDER,
    beta: float = CHRF_BETA,
    level: str = "corpus",
    by: Sequence[str] = (),
    pred: str = "prediction",
    target: str = "target",
    name: str = "chrf",
) -> DataFrame:
    """I8."""
    counted = df.withColumn("__c", _chrf_counts(df, pred, target, order))
    c = F.col("__c")
    if level == "row":
        at = lambda f, i: c[f"{f}_{i}"]
        hyp = _countable(c, order)
        parts = [(at("match", i), hyp[i], at("ref", i)) for i in range(order)]
        return counted.withColumn(name, _chrf(parts, beta)).drop("__c")
    sums = counted.groupBy(*by).agg(*_chrf_sums(order))
    return sums.select(*by, _chrf(_chrf_summed(order), beta).alias(name))


def _chrf_sums(order: int) -> list[Column]:
    c = F.col("__c")
    out = []
    for i, hyp in enumerate(_countable(c, order)):
        out.append(F.sum(c[f"match_{i}"]).alias(f"__m{i}"))
        out.append(F.sum(hyp).alias(f"__p{i}"))
        out.append(F.sum(c[f"ref_{i}"]).alias(f"__r{i}"))
    return out


def _chrf_summed(order: int) -> list[tuple[Column, Column, Column]]:
    return [(F.col(f"__m{i}"), F.col(f"__p{i}"), F.col(f"__r{i}")) for i in range(order)]


def _ter_share(edits: Column, ref_len: Column) -> Column:
    share = F.try_divide(edits.cast("double"), ref_len)
    return 100 * F.coalesce(share, F.when(edits > 0, F.lit(1.0)).otherwise(F.lit(0.0)))


def _edit_counts(df: DataFrame, pred: str, target: str) -> Column:
    return kernels.edit_counts(tx.prepare_ter(_text(df, pred)), tx.prepare_ter(_text(df, target)), tx.split_ter)


def ter(
    df: DataFrame,
    level: str = "corpus",
    by: Sequence[str] = (),
    pred: str = "prediction",
    target: str = "target",
    name: str = "ter",
) -> DataFrame:
    """Edits per reference word, times 100."""
    counted = df.withColumn(
        "__t", _edit_counts(df, pred, target)
    )
    if level == "row":
        score = _ter_share(F.col("__t.edits"), F.col("__t.ref_len"))
        return counted.withColumn(name, score).drop("__t")
    return counted.groupBy(*by).agg(
        _ter_share(F.sum("__t.edits"), F.sum("__t.ref_len")).alias(name)
    )


def _meteor_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0))


def meteor(
    df: DataFrame,
    synonyms: dict[str, set[str]] | None = None,
    level: str = "corpus",
    by: Sequence[str] = (),
    pred: str = "prediction",
    target: str = "target",
    name: str = "meteor",
) -> DataFrame:
    """Per row, or the mean over rows. ``synonyms`` is a small parameter; none ships."""
    sides = F.lower(_text(df, pred)), F.lower(_text(df, target))
    if synonyms:
        score = kernels.meteor(*(_meteor_tokens(c) for c in sides), synonyms)
    else:
        # Spark and Arrow know the same letters up to here; other texts reach the kernel as tokens between blanks.
        other = lambda c: c.rlike(r"[^\x00-\x{52f}]")
        ready = (F.when(other(c), F.array_join(_meteor_tokens(c), " ")).otherwise(c) for c in sides)
        score = kernels.meteor(*ready, split=tx.split_meteor)
    scored = df.withColumn(name, score)
    return scored if level == "row" else scored.groupBy(*by).agg(F.avg(name).alias(name))


def greedy_embedding_score(
    df: DataFrame,
    pred_vecs: str = "pred_vecs",
    ref_vecs: str = "ref_vecs",
    level: str = "corpus",
    by: Sequence[str] = (),
) -> DataFrame:
    """Greedy cosine matching of token vectors that the caller supplies."""
    fields = ("precision", "recall", "f1")
    scored = df.withColumn("__g", kernels.greedy_cosine(F.col(pred_vecs), F.col(ref_vecs)))
    rows = scored.select(*df.columns, *[F.col(f"__g.{f}").alias(f"bert_{f}") for f in fields])
    if level == "row":
        return rows
    return rows.groupBy(*by).agg(*[F.avg(f"bert_{f}").alias(f"bert_{f}") for f in fields])


# ---------------------------------------------------------------- bundles

COLUMNS = {
    "bleu": "BLEU",
    "chrf": "CHRF",
    "ter": "TER",
    "bert_precision": "BERT-P",
    "bert_recall": "BERT-R",
    "bert_f1": "BERT-F1",
    "meteor": "METEOR",
}


def _named(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    return df.select(*keep, *[F.col(c).alias(n) for c, n in COLUMNS.items() if c in df.columns])


def evaluate_each(
    df: DataFrame, keep: Sequence[str] = (), pred: str = "prediction", target: str = "target"
) -> DataFrame:
    """All metrics per row in one pass; the embedding scores when vectors are present."""
    kw = {"level": "row", "pred": pred, "target": target}
    out = meteor(ter(chrf(sacre_bleu(df, **kw), **kw), **kw), **kw)
    if {"pred_vecs", "ref_vecs"} <= set(df.columns):
        out = greedy_embedding_score(out, level="row")
    return _named(
        out, [*keep, F.col(target).alias("reference"), F.col(pred).alias("predicts")]
    )


def evaluate_total(
    df: DataFrame, by: Sequence[str] = (), pred: str = "prediction", target: str = "target"
) -> DataFrame:
    """One row of corpus metrics; every count comes from the same pass over the rows."""
    n = 4
    counted = (
        df.withColumn("__b", _bleu_counts(df, pred, target, n, True))
        .withColumn("__c", _chrf_counts(df, pred, target, CHRF_ORDER))
        .withColumn("__t", _edit_counts(df, pred, target))
    )
    counted = meteor(counted, level="row", pred=pred, target=target, name="meteor")
    vectors = {"pred_vecs", "ref_vecs"} <= set(df.columns)
    if vectors:
        counted = greedy_embedding_score(counted, level="row")
    means = ["meteor", *(f"bert_{f}" for f in ("precision", "recall", "f1") if vectors)]
    sums = counted.groupBy(*by).agg(
        *[F.sum(f"__b.match_{i}").alias(f"__bm{i}") for i in range(n)],
        *[F.sum(f"__b.pred_{i}").alias(f"__bp{i}") for i in range(n)],
        F.sum("__b.pred_len").alias("__bpl"),
        F.sum("__b.ref_len").alias("__brl"),
        *_chrf_sums(CHRF_ORDER),
        F.sum("__t.edits").alias("__e"),
        F.sum("__t.ref_len").alias("__el"),
        *[F.avg(m).alias(m) for m in means],
    )
    scores = sums.select(
        *by,
        _sacre_bleu(
            [F.col(f"__bm{i}") for i in range(n)],
            [F.col(f"__bp{i}") for i in range(n)],
            F.col("__bpl"),
            F.col("__brl"),
        ).alias("bleu"),
        _chrf(_chrf_summed(CHRF_ORDER), CHRF_BETA).alias("chrf"),
        _ter_share(F.col("__e"), F.col("__el")).alias("ter"),
        *means,
    )
    return _named(scores, by)


def text_metrics(
    df: DataFrame,
    by: str = "split",
    pred: str = "prediction",
    target: str = "target",
) -> DataFrame:
    """BLEU-1, BLEU-4 and the ROUGE F values per split, from one pass over the rows."""
    n = 4
    counted = df.select(
        by,
        _bleu_counts(df, pred, target, n, False).alias("b"),
        kernels.rouge_counts(F.lower(_text(df, pred)), F.lower(_text(df, target)), tx.split_rouge).alias("g"),
    )
    at = lambda f, i: F.col(f"g.{f}_{i}")
    lengths = F.col("g.pred_len"), F.col("g.ref_len")
    rows = counted.select(
        by,
        "b",
        *[
            _prf(at("match", i), at("pred", i), at("ref", i))["fmeasure"].alias(f"rouge{i + 1}")
            for i in range(2)
        ],
        _prf(F.col("g.lcs"), *lengths)["fmeasure"].alias("rougeL"),
        _prf(F.col("g.lsum"), *lengths)["fmeasure"].alias("rougeLsum"),
    )
    rouges = ("rouge1", "rouge2", "rougeL", "rougeLsum")
    sums = rows.groupBy(by).agg(
        *[F.sum(f"b.match_{i}").alias(f"m{i}") for i in range(n)],
        *[F.sum(f"b.pred_{i}").alias(f"p{i}") for i in range(n)],
        F.sum("b.pred_len").alias("pl"),
        F.sum("b.ref_len").alias("rl"),
        *[F.avg(c).alias(c) for c in rouges],
    )
    bleu = lambda k: _bleu(
        [F.col(f"m{i}") for i in range(k)],
        [F.col(f"p{i}") for i in range(k)],
        F.col("pl"),
        F.col("rl"),
        None,
        False,
    )
    return sums.select(by, bleu(1).alias("sacre_bleu1"), bleu(4).alias("sacre_bleu4"), *rouges)


def prefixed_metrics(metrics: DataFrame, splits: Sequence[str], by: str = "split") -> DataFrame:
    """The same values as one row of ``<split>/<metric>`` columns."""
    values = [c for c in metrics.columns if c != by]
    return metrics.agg(
        *[
            F.max(F.when(F.col(by) == s, F.col(c))).alias(f"{s}/{c}")
            for s in splits
            for c in values
        ]
    )


def compare_models(
    df: DataFrame, models: Sequence[str], target: str = "target", metrics: Sequence[str] = ()
) -> DataFrame:
    """Mean of the row metrics per model, one row per metric and one column per model."""
    names = list(metrics or COLUMNS.values())
    long = df.select(target, *models).unpivot([target], list(models), "model", "prediction")
    each = evaluate_each(long, keep=["model"], target=target)
    names = [n for n in names if n in each.columns]
    means = each.groupBy("model").agg(*[F.avg(F.col(f"`{n}`")).alias(n) for n in names])
    per_metric = means.unpivot(["model"], [F.col(f"`{n}`") for n in names], "metric", "mean")
    return per_metric.groupBy("metric").pivot("model", list(models)).agg(F.first("mean"))

