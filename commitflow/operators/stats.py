"""Corpus and result statistics (section H)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .merge import align_vocab, concat
from .rows import top_k

# The labels of the five length bins.
BIN_LABELS = ("Very Short", "Short", "Medium", "Long", "Very Long")


def first_word_accuracy(df: DataFrame, pred: str, target: str = "target") -> DataFrame:
    """H2: share of rows whose predicted first word equals the target's; null equals null."""
    pairs = df.select(
        tx.first_word(F.col(target)).alias("first_word"), tx.first_word(F.col(pred)).alias("p")
    )
    hit = F.col("first_word").eqNullSafe(F.col("p")).cast("int")
    return pairs.groupBy("first_word").agg(F.avg(hit).alias("accuracy"))


def first_word_confusion(
    df: DataFrame, pred: str, idx_col: str, target: str = "target"
) -> DataFrame:
    """H3: predicted first words per target word with counts; ``first_seen`` gives their order."""
    pairs = df.select(
        tx.first_word(F.col(target)).alias("first_word"),
        tx.first_word(F.col(pred)).alias("predicted"),
        F.col(idx_col).alias("i"),
    )
    return pairs.groupBy("first_word", "predicted").agg(
        F.count("*").alias("n"), F.min("i").alias("first_seen")
    )


def change_type_counts(df: DataFrame) -> DataFrame:
    """H4: changes per type over all commits, most frequent first."""
    return (
        df.select(F.explode("mods.change_type").alias("change_type"))
        .groupBy("change_type")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "change_type")
    )


def _seen(idx: Column, pos: Column) -> Column:
    """Row and word position as one decimal number: exact for every 64-bit row and 32-bit position,
    and the aggregate still keeps a buffer that it can change in place."""
    return idx.cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + pos.cast("decimal(10,0)")


def seen_at(first_seen: Column) -> tuple[Column, Column]:
    """The row and the word position of ``first_seen``."""
    pos = F.pmod(first_seen, F.lit(1 << 32).cast("decimal(10,0)"))
    return ((first_seen - pos) / F.lit(1 << 32).cast("decimal(10,0)")).cast("bigint"), pos.cast("bigint")


def word_counts(
    df: DataFrame, col: str, idx_col: str, stopwords: Sequence[str] = ()
) -> DataFrame:
    """H5, H6: ``word, n, first_seen`` without punctuation and stop words.

    The stop-word list is a parameter (short by nature), so it is a filter before the exchange.
    """
    words = df.select(
        F.col(idx_col).alias("i"), F.posexplode(tx.plain_words(F.col(col))).alias("pos", "word")
    )
    if stopwords:
        words = words.filter(~F.col("word").isin(*stopwords))
    return words.groupBy("word").agg(
        F.count("*").alias("n"), F.min(_seen(F.col("i"), F.col("pos"))).alias("first_seen")
    )


def compare_top_words(
    frames: dict[str, DataFrame],
    k: int,
    col: str,
    idx_col: str,
    stopwords: Sequence[str] = (),
) -> DataFrame:
    """H7: the top ``k`` words of several subsets below each other."""
    tops = [
        top_k(word_counts(df, col, idx_col, stopwords), k).withColumn("dataset", F.lit(name))
        for name, df in frames.items()
    ]
    return concat(tops).drop("part", "first_seen")


def kl_divergence(
    a: DataFrame, b: DataFrame, eps: float = 1e-10, key: str = "word", count: str = "n"
) -> DataFrame:
    """H8: both directions, natural logarithm, ``eps`` added to every count.

    With ``A = sum(n_a + eps)``, ``sum p ln(p/q) = sum((n_a + eps) ln((n_a + eps)/(n_b + eps)))/A
    - ln A + ln B``: one pass over the joined vocabulary, totals included.
    """
    x, y = F.col("n_a") + F.lit(eps), F.col("n_b") + F.lit(eps)
    sums = align_vocab(a, b, key, count).agg(
        F.sum(x).alias("a"),
        F.sum(y).alias("b"),
        F.sum(x * F.ln(x / y)).alias("xy"),
        F.sum(y * F.ln(y / x)).alias("yx"),
    )
    ratio = F.ln(F.col("b") / F.col("a"))
    return sums.select(
        (F.col("xy") / F.col("a") + ratio).alias("kl_ab"),
        (F.col("yx") / F.col("b") - ratio).alias("kl_ba"),
    )


def length_stats(
    df: DataFrame, cols: Sequence[str] = ("message", "diff"), approx: bool = False
) -> DataFrame:
    """H9: mean, min, max and median length per column, rounded half-even to 2 digits.

    The exact median keeps one counter per distinct length; ``approx`` bounds that as well.
    """
    lengths = df.select(
        *[F.coalesce(F.length(c), F.lit(0)).alias(c) for c in cols]
    ).unpivot([], list(cols), "field", "n")
    middle = (
        F.percentile_approx("n", F.lit(0.5), F.lit(10_000)).cast("double")
        if approx
        else F.percentile("n", F.lit(0.5))
    )
    return lengths.groupBy("field").agg(
        F.bround(F.avg("n"), 2).alias("mean"),
        F.min("n").alias("min"),
        F.max("n").alias("max"),
        F.bround(middle, 2).alias("median"),
    )


def unk_stats(df: DataFrame, cols: Sequence[str], unk: int, max_len: int) -> DataFrame:
    """Tokens, unknown tokens and their share per column after the cut to ``max_len - 2``."""
    sizes = [
        F.struct(
            F.lit(c).alias("field"),
            F.least(F.size(c), F.lit(max_len - 2)).alias("n"),
            F.size(F.filter(tx.take(F.col(c), max_len - 2), lambda t: t == unk)).alias("u"),
        )
        for c in cols
    ]
    total, unknown = F.sum("c.n"), F.sum("c.u")
    share = F.coalesce(F.try_divide(unknown, total) * 100, F.lit(0.0))
    return (
        df.select(F.explode(F.array(*sizes)).alias("c"))
        .groupBy(F.col("c.field").alias("field"))
        .agg(
            total.alias("total_tokens"),
            unknown.alias("unknown_tokens"),
            F.bround(share, 2).alias("unk_percentage"),
        )
    )


def mean_scores(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Sum and mean of each score column, one row."""
    return df.agg(
        *[F.sum(c).alias(f"{c}_sum") for c in cols], *[F.avg(c).alias(f"{c}_mean") for c in cols]
    )


def judge_averages(df: DataFrame) -> DataFrame:
    """H12."""
    return df.agg(
        F.avg("tiny_score").alias("tiny_average"),
        F.avg("baseline_score").alias("baseline_average"),
        F.count("tiny_score").alias("sample_count"),
    )


def _long(df: DataFrame, cols: Sequence[str], var: str, value: str) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [], list(cols), var, value
    )


#: Ranges a value span is cut into, a round.
SPAN_RANGES = 1024


def exact_quantiles(df: DataFrame, cols: Sequence[str], points: Sequence[float]) -> dict[str, list[float] | None]:
    """Linear quantiles of each column, exact, in bounded memory; None for a column without values.

    A round counts the values of every span that holds a wanted rank in ``SPAN_RANGES`` ranges and goes on with the range
    that has the rank, from its smallest to its largest value, until these are equal. A task holds one counter a range,
    however many distinct values there are. Order: minus infinity, numbers, infinity, NaN.
    """
    long = _long(df, cols, "field", "x").where(F.col("x").isNotNull())
    x, inf = F.col("x"), F.lit(float("inf"))
    finite = ~F.isnan("x") & (x != inf) & (x != -inf)
    heads = long.groupBy("field").agg(
        F.count("*").alias("n"), F.count_if(x == -inf).alias("below"), F.count_if(finite).alias("finite"), F.count_if(F.isnan("x")).alias("nan"),
        F.min(F.when(finite, x)).alias("low"), F.max(F.when(finite, x)).alias("high"),
    ).collect()
    found: dict[tuple[str, int], float] = {}
    # (field, rank) -> (smallest and largest value of the span, values before it)
    spans: dict[tuple[str, int], tuple[float, float, int]] = {}
    for r in heads:
        for rank in {k(p * (r["n"] - 1)) for p in points for k in (math.floor, math.ceil)}:
            if rank < r["below"]:
                found[r["field"], rank] = -math.inf
            elif rank < r["below"] + r["finite"]:
                spans[r["field"], rank] = (r["low"], r["high"], r["below"])
            else:
                found[r["field"], rank] = math.inf if rank < r["n"] - r["nan"] else math.nan
    while spans:
        for key in [k for k, (low, high, _) in spans.items() if low == high]:
            found[key] = spans.pop(key)[0]
        wanted = sorted({(field, *span) for (field, _), span in spans.items()})
        if not wanted:
            break
        number = F.lit(None).cast("int")
        place = F.lit(None).cast("int")
        for i, (field, low, high, _) in enumerate(wanted):
            here = (F.col("field") == field) & x.between(low, high)
            # Halves, so that no difference of two doubles overflows.
            half = high / 2 - low / 2
            share = (x / 2 - low / 2) / half * SPAN_RANGES if half else F.when(x > low, float(SPAN_RANGES)).otherwise(0.0)
            number = F.when(here, i).otherwise(number)
            place = F.when(here, F.least(F.floor(share), F.lit(SPAN_RANGES - 1)).cast("int")).otherwise(place)
        counted = long.where(finite).select(number.alias("span"), place.alias("range"), "x").where("span is not null")
        ranges = counted.groupBy("span", "range").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
        for key, span in list(spans.items()):
            at, before = wanted.index((key[0], *span)), span[2]
            for r in sorted((r for r in ranges if r["span"] == at), key=lambda r: r["range"]):
                if key[1] < before + r["n"]:
                    spans[key] = (r["low"], r["high"], before)
                    break
                before += r["n"]
    out: dict[str, list[float] | None] = dict.fromkeys(cols)
    for r in heads:
        values = []
        for p in points:
            at = p * (r["n"] - 1)
            low, high = (found[r["field"], k(at)] for k in (math.floor, math.ceil))
            same = low == high or math.floor(at) == math.ceil(at)
            values.append(low if same else (math.ceil(at) - at) * low + (at - math.floor(at)) * high)
        out[r["field"]] = values
    return out


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, min, linear quartiles and max per column."""
    quartiles = exact_quantiles(df, cols, (0.25, 0.5, 0.75))
    rows = [(c, *(q or (None, None, None))) for c, q in quartiles.items()]
    # One row a column.
    table = F.broadcast(df.sparkSession.createDataFrame(rows, "field string, q25 double, q50 double, q75 double"))
    out = _long(df, cols, "field", "x").groupBy("field").agg(
        F.count("x").alias("count"),
        F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
    )
    return out.join(table, "field").select("field", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def quantile_bins(
    df: DataFrame,
    col: str,
    q: int = 5,
    labels: Sequence[str] = BIN_LABELS,
    name: str = "bin",
) -> DataFrame:
    """Equal-frequency bins with linear quantile edges, closed on the right.

    The ``q + 1`` edges are read once and become constants. Repeated edges are an error.
    """
    edges = exact_quantiles(df, [col], [i / q for i in range(q + 1)])[col]
    if edges is None:
        return df.withColumn(name, F.lit(None).cast("string"))
    if len(set(edges)) != len(edges):
        raise ValueError(f"bin edges repeat: {edges}")
    label = F.when(F.col(col) <= edges[1], F.lit(labels[0]))
    for i in range(1, q):
        label = label.when(F.col(col) <= edges[i + 1], F.lit(labels[i]))
    return df.withColumn(name, label)


def binned_stats(df: DataFrame, bin_col: str, full: Sequence[str], mean: Sequence[str]) -> DataFrame:
    """Mean, deviation and count (or only the mean) per bin, rounded half-even to 3 digits."""
    aggs = []
    for c in full:
        aggs += [
            F.bround(F.avg(c), 3).alias(f"{c}_mean"),
            F.bround(F.stddev_samp(c), 3).alias(f"{c}_std"),
            F.count(c).alias(f"{c}_count"),
        ]
    aggs += [F.bround(F.avg(c), 3).alias(f"{c}_mean") for c in mean]
    return df.groupBy(bin_col).agg(*aggs)


def correlations(df: DataFrame, x: str, ys: Sequence[str]) -> DataFrame:
    """H15."""
    return df.agg(*[F.corr(x, y).alias(y) for y in ys])


def win_rates(df: DataFrame, diff_col: str = "score_difference") -> DataFrame:
    """Percentages of wins, losses and ties."""
    share = lambda c: (F.avg(c.cast("int")) * 100)
    d = F.col(diff_col)
    return df.agg(
        share(d > 0).alias("tiny_wins"),
        share(d < 0).alias("baseline_wins"),
        share(d == 0).alias("ties"),
    )


def melt_scores(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per model and score."""
    return df.select(*cols).unpivot([], list(cols), "model", "score")


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Equal-width bins between the smallest and largest value; the last one is closed."""
    low, high = df.agg(F.min(col).cast("double"), F.max(col).cast("double")).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, n bigint")
    if low == high:  # as the usual plotting libraries do
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    at = F.least(F.floor((F.col(col) - low) / width), F.lit(bins - 1)).cast("int")
    counts = df.filter(F.col(col).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return all_bins.join(counts, "bin", "left").select(
        "bin",
        (F.lit(low) + F.col("bin") * width).alias("lower"),
        (F.lit(low) + (F.col("bin") + 1) * width).alias("upper"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def box_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Five-number summary per model."""
    return describe(df, cols).select(
        F.col("field").alias("model"), "min", "q25", "q50", "q75", "max"
    )


def score_difference(df: DataFrame) -> DataFrame:
    """Positive when the tiny model wins."""
    return df.withColumn("score_difference", F.col("tiny_score") - F.col("baseline_score"))
