"""Position-dependent operators without a single-partition window.

The shared idea: cut the sort key into ranges whose bounds are fixed once, from a small sample, and
then treated as constants. The range a row falls in is a pure function of its key, so recomputing a
lost task gives the same answer. Each range gets its own window; the totals before a range come from
one small aggregate over the narrow key columns. Bounds only steer balance, never the result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..session import shared_dir

# Ranges at most: one number a range is kept by the driver, and one counter by each task.
MAX_BUCKETS = 1 << 15
ROWS_PER_BUCKET = 1_000_000
MIN_ROWS_PER_BUCKET = 2_000
SAMPLES_PER_BUCKET = 20
UNROLLED_BOUNDS = 32
BUCKET = "__bucket"


def _bucket_count(df: DataFrame, n: int) -> int:
    wanted = max(
        -(-n // ROWS_PER_BUCKET),
        min(df.sparkSession.sparkContext.defaultParallelism, -(-n // MIN_ROWS_PER_BUCKET)),
    )
    return max(1, min(MAX_BUCKETS, wanted))


def range_buckets(
    df: DataFrame, order_cols: Sequence[str], buckets: int | None = None
) -> tuple[DataFrame, int]:
    """Add ``__bucket``: rows of a lower bucket sort before rows of a higher one.

    ``order_cols`` should identify a row, so that no range can be flooded by one repeated key.
    """
    key = F.struct(*[F.col(c) for c in order_cols])
    keys = df.select(key.alias("k"))
    n = keys.count()
    buckets = buckets or _bucket_count(df, n)
    if buckets <= 1 or n == 0:
        return df.withColumn(BUCKET, F.lit(0)), 1
    # About ``wanted`` narrow keys, picked where they are; one task sorts them.
    wanted = buckets * SAMPLES_PER_BUCKET
    sample = keys if wanted >= n else keys.sample(fraction=wanted / n, seed=17)
    step = max(1, min(wanted, n) // buckets)
    picked = (
        sample.agg(F.array_sort(F.collect_list("k")).alias("ks"))
        .select(F.filter("ks", lambda x, i: i % step == step - 1).alias("ks"))
        # Sorted, so equal bounds are neighbours.
        .select(F.filter("ks", lambda x, i: (i == 0) | ~x.eqNullSafe(F.get("ks", i - 1))).alias("ks"))
        .select("ks", F.to_json("ks").alias("js"))
        .first()
    )
    bounds = picked["ks"]
    if not bounds:
        return df.withColumn(BUCKET, F.lit(0)), 1
    if len(bounds) <= UNROLLED_BOUNDS:
        passed = [_at_or_above(df, order_cols, b).cast("int") for b in bounds]
        return df.withColumn(BUCKET, reduce(lambda x, y: x + y, passed)), len(bounds) + 1
    # Binary search: the number of bounds at or below the key.
    table = F.from_json(F.lit(picked["js"]), T.ArrayType(keys.schema["k"].dataType))
    steps = [1 << b for b in reversed(range(len(bounds).bit_length()))]
    bucket = F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, s: F.when(F.get(table, at + s - 1) <= key, at + s).otherwise(at),
    )
    return df.withColumn(BUCKET, bucket), len(bounds) + 1


def _at_or_above(df: DataFrame, cols: Sequence[str], key: Sequence) -> Column:
    """Whether a row sorts at or after ``key`` (nulls first), as plain comparisons of columns."""
    out = F.lit(True)
    for c, v in reversed(list(zip(cols, key))):
        if v is None:
            out = F.col(c).isNotNull() | out
        else:
            value = F.lit(v).cast(df.schema[c].dataType)
            above = F.coalesce(F.col(c) > value, F.lit(False))
            out = above | (F.col(c).eqNullSafe(value) & out)
    return out


def _constants(values: Sequence[int]) -> Column:
    return F.split(F.lit(",".join(str(v) for v in values)), ",").cast("array<bigint>")


def with_row_index(df: DataFrame, order_cols: Sequence[str], name: str = "row_idx") -> DataFrame:
    """G1: stable 0-based global row index in ``order_cols`` order."""
    bucketed, n = range_buckets(df, order_cols)
    w = W.partitionBy(BUCKET).orderBy(*order_cols)
    local = F.row_number().over(w).cast("bigint") - 1
    if n > 1:
        # At most MAX_BUCKETS rows reach the driver.
        counts = dict(bucketed.groupBy(BUCKET).count().collect())
        starts, at = [], 0
        for b in range(n):
            starts.append(at)
            at += counts.get(b, 0)
        local = local + F.get(_constants(starts), F.col(BUCKET))
    return bucketed.withColumn(name, local).drop(BUCKET)


def first_cut(
    df: DataFrame, n: int | Callable[[int], int], order_cols: Sequence[str]
) -> tuple[Column, Column, int, int] | None:
    """Where the first ``n`` rows end: rows before the last key, rows with it, how many of those are
    wanted, and how many there are. None keeps every row."""
    # The keys are read several times below; the rows once, and again only by the caller's filter.
    shared_dir(df.sparkSession)
    keys, ranges = range_buckets(df.select(*order_cols).checkpoint(), order_cols)
    counts = dict(keys.groupBy(BUCKET).count().collect())
    if callable(n):
        n = n(sum(counts.values()))
    if n <= 0:
        return F.lit(False), F.lit(False), 0, 0
    before = 0
    for b in range(ranges):
        if before + counts.get(b, 0) >= n:
            break
        before += counts.get(b, 0)
    else:
        return None
    here = keys.filter(F.col(BUCKET) == b)
    ahead = here.orderBy(*order_cols).limit(n - before)
    last = ahead.agg(F.max(F.struct(*order_cols)).alias("k")).first()["k"]
    same = reduce(
        lambda x, y: x & y,
        [
            F.col(c).eqNullSafe(F.lit(v).cast(df.schema[c].dataType))
            for c, v in zip(order_cols, last)
        ],
    )
    below = ~_at_or_above(df, order_cols, last)
    found = here.agg(F.count_if(same).alias("same"), F.count_if(below).alias("below")).first()
    return below, same, n - before - found["below"], found["same"]


def cut_condition(cut: tuple[Column, Column, int, int] | None) -> Column | None:
    """What holds for the rows before a cut; None if it parts rows of one key."""
    if cut is None:
        return F.lit(True)
    below, same, wanted, there = cut
    return below | same if wanted == there else None


def first_rows(
    df: DataFrame, n: int | Callable[[int], int], order_cols: Sequence[str]
) -> Column:
    """Condition that holds for exactly the first ``n`` rows in ``order_cols`` order.

    ``n`` may be a function of the row count, which is known on the way. Only the narrow key is
    ranged and counted, and only the one range with the ``n``-th key is sorted; the rows themselves
    are filtered where they are, without an exchange. No condition can part rows of one key, so it is
    an error if the cut falls between such rows; ``take_first`` can part them.
    """
    chosen = cut_condition(first_cut(df, n, order_cols))
    if chosen is None:
        raise ValueError(f"{list(order_cols)} does not identify a row: several share the last key")
    return chosen


def take_first(
    df: DataFrame, n: int | Callable[[int], int], order_cols: Sequence[str]
) -> DataFrame:
    """Exactly the first ``n`` rows in ``order_cols`` order; of rows that share the last key, any."""
    return take_cut(df, first_cut(df, n, order_cols))


def take_cut(df: DataFrame, cut: tuple[Column, Column, int, int] | None) -> DataFrame:
    """The rows before a cut, as many as it says."""
    chosen = cut_condition(cut)
    if chosen is not None:
        return df.filter(chosen)
    below, same, wanted, _ = cut
    return df.filter(below).unionByName(df.filter(same).limit(wanted))


def running_total(
    df: DataFrame,
    value: str,
    order_cols: Sequence[str],
    keys: Sequence[str] = (),
    name: str = "running",
) -> DataFrame:
    """Inclusive running sum of ``value`` per ``keys``; one hot key is spread over many ranges."""
    keys = list(keys)
    bucketed, n = range_buckets(df, [*keys, *order_cols])
    groups = [*keys, BUCKET]
    partial = bucketed.groupBy(*groups).agg(F.sum(value).cast("bigint").alias("__part"))
    w = W.partitionBy(*groups).orderBy(*order_cols).rowsBetween(W.unboundedPreceding, 0)
    here = F.sum(value).over(w)
    if not keys:
        # At most MAX_BUCKETS rows reach the driver.
        totals = dict(partial.collect())
        starts, at = [], 0
        for b in range(n):
            starts.append(at)
            at += totals.get(b) or 0
        before = F.get(_constants(starts), F.col(BUCKET)) if n > 1 else F.lit(0)
        return bucketed.withColumn(name, (here + before).cast("bigint")).drop(BUCKET)
    # A key holds at most one row per range here, so this window stays within MAX_BUCKETS rows.
    earlier = W.partitionBy(*keys).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    carry = partial.select(
        *[F.col(k).alias(f"__c{i}") for i, k in enumerate(groups)],
        F.coalesce(F.sum("__part").over(earlier), F.lit(0)).alias("__carry"),
    )
    match = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"__c{i}")) for i, k in enumerate(groups)],
    )
    joined = bucketed.join(carry, match)
    return joined.withColumn(name, (here + F.col("__carry")).cast("bigint")).drop(
        BUCKET, "__carry", *[f"__c{i}" for i in range(len(groups))]
    )


def hash_order(cols: Sequence[str], seed: int) -> Column:
    """A fixed pseudo-random sort key of a row: the MD5 of its id columns and the seed, as other
    engines can compute it too. Nulls count as empty text."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]
    return F.md5(F.concat_ws("|", *texts, F.lit(str(seed))).cast("binary"))


def with_shuffled_index(
    df: DataFrame, id_cols: Sequence[str], seed: int, name: str = "row_idx"
) -> DataFrame:
    """Row index in a seeded pseudo-random order that does not depend on partitioning."""
    keyed = df.withColumn("__h", hash_order(id_cols, seed))
    return with_row_index(keyed, ["__h", *id_cols], name).drop("__h")


def assign_batches(
    df: DataFrame,
    size: int,
    order_cols: Sequence[str],
    shuffle: bool = False,
    seed: int = 0,
    name: str = "batch_id",
) -> DataFrame:
    """Consecutive batches of ``size`` rows; the short last batch is kept."""
    idx = "__idx"
    rows = (
        with_shuffled_index(df, order_cols, seed, idx)
        if shuffle
        else with_row_index(df, order_cols, idx)
    )
    return rows.withColumn(name, F.floor(F.col(idx) / F.lit(size)).cast("bigint")).drop(idx)


def shard_fixed(df: DataFrame, size: int, order_cols: Sequence[str]) -> DataFrame:
    """Shards of ``size`` rows named by their 6-digit start offset."""
    start = F.floor(F.col("row_idx") / F.lit(size)).cast("bigint") * size
    text = start.cast("string")
    return with_row_index(df, order_cols).withColumn(
        "shard", F.when(F.length(text) < 6, F.lpad(text, 6, "0")).otherwise(text)
    )


def shard_size(tokens_per_day: int, max_prompt: int) -> int:
    return tokens_per_day // max_prompt


#: Exit maps of neighbouring segments that one task composes.
FAN = 256


def _next_starts(n: np.ndarray, max_tokens: int, max_entries: int) -> np.ndarray:
    """For every row, where the next batch begins if a batch begins at that row."""
    prefix = np.concatenate([[0], np.cumsum(n)])
    i = np.arange(len(n))
    fits = np.searchsorted(prefix, prefix[:-1] + max_tokens, side="right") - 1
    return np.minimum(np.minimum(np.maximum(fits, i + 1), i + max_entries), len(n))


def _walk_exits(maps: pd.DataFrame, at: np.ndarray, batch: np.ndarray):
    """For segments in order, where each of the starts ``at`` of the first one enters them, and the
    batches before; at last where it leaves. Nothing follows a start behind the last segment's end."""
    for leave, count in zip(maps["leave"], maps["count"]):
        yield at, batch
        here = at < len(leave)
        step = np.where(here, at, 0)
        if len(leave):
            batch = np.where(here, batch + np.asarray(count)[step], batch)
            at = np.where(here, np.asarray(leave)[step], at)
    yield at, batch


def _follow_exits(maps: DataFrame) -> DataFrame:
    """``__g, seg, entry, first_batch`` of every segment of the exit maps ``__g, seg, leave, count``.

    Exit maps compose: those of ``FAN`` neighbouring segments are one map of the same size. They are
    composed level by level until a group has one block, whose first start is its first row; then
    each block hands the entries to its parts. A task holds ``FAN`` maps, the driver none.
    """
    maps = maps.checkpoint()
    top = maps.agg(F.max("seg")).first()[0]
    if top is None:
        return maps.select("__g", "seg", F.lit(0).alias("entry"), F.lit(0).cast("bigint").alias("first_batch"))
    block = F.floor(F.col("seg") / FAN).cast("bigint")

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seg")
        starts = np.arange(len(pdf["leave"].iloc[0]))
        *_, (leave, count) = _walk_exits(pdf, starts, np.zeros(len(starts), np.int64))
        return pd.DataFrame(
            {"__g": [pdf["__g"].iloc[0]], "seg": [pdf["block"].iloc[0]], "leave": [leave], "count": [count]}
        )

    def enter(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seg")
        first = pdf[["entry", "first_batch"]].iloc[0].to_numpy(np.int64)
        entered = list(_walk_exits(pdf, first[:1], first[1:]))[:-1]
        return pdf[["__g", "seg"]].assign(
            entry=[int(at[0]) for at, _ in entered], first_batch=[int(batch[0]) for _, batch in entered]
        )

    levels = [maps]
    while top > 0:
        blocks = levels[-1].withColumn("block", block).groupBy("__g", "block")
        levels.append(blocks.applyInPandas(compose, "__g string, seg bigint, leave array<int>, count array<bigint>").checkpoint())
        top //= FAN
    entries = levels.pop().select("__g", "seg", F.lit(0).alias("entry"), F.lit(0).cast("bigint").alias("first_batch"))
    while levels:
        known = entries.withColumnRenamed("seg", "block")
        parts = levels.pop().withColumn("block", block).join(known, ["__g", "block"])
        entries = parts.groupBy("__g", "block").applyInPandas(enter, "__g string, seg bigint, entry int, first_batch bigint")
    return entries


def batch_by_tokens(
    df: DataFrame,
    order_cols: Sequence[str],
    tokens_col: str,
    max_tokens: int = 5000,
    max_entries: int = 500,
    by: str | None = None,
    segment_rows: int = 200_000,
) -> DataFrame:
    """Greedy batches in input order, closed when the next row would exceed either limit.

    A row larger than the limit forms a batch of its own; empty batches are never emitted.

    Where a batch may start depends on every row before it, so the rows are cut into segments of
    ``segment_rows``. A batch holds at most ``max_entries`` rows, hence only that many rows of a
    segment can be its first start; each segment maps every one of them to the first start of the
    next segment. These maps are composed block by block (``_follow_exits``), and each segment then
    marks its own starts.
    """
    if segment_rows < max_entries:
        raise ValueError("segment_rows must be at least max_entries")
    spark = df.sparkSession
    shared_dir(spark)
    # Marked, so that a null group is a group like any other.
    group = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("null")) if by else F.lit("")
    narrow = df.select(
        group.alias("__g"), F.col(tokens_col).cast("bigint").alias("n"), *order_cols
    )
    if by:
        counted = narrow.withColumn("__one", F.lit(1))
        indexed = running_total(counted, "__one", order_cols, ["__g"], "__idx")
        indexed = indexed.withColumn("__idx", F.col("__idx") - 1).drop("__one")
    else:
        indexed = with_row_index(narrow, order_cols, "__idx")
    seg = F.floor(F.col("__idx") / segment_rows).cast("bigint")
    # Read twice below; a few numbers per row.
    rows = indexed.withColumn("__seg", seg).checkpoint()
    # Each segment also sees the first rows of its successor.
    ahead = (F.col("__idx") % segment_rows < max_entries) & (F.col("__seg") > 0)
    seen = rows.select(
        "__g",
        "__idx",
        "n",
        *order_cols,
        F.col("__seg").alias("own"),
        F.explode(
            F.when(ahead, F.array("__seg", F.col("__seg") - 1)).otherwise(F.array("__seg"))
        ).alias("seg"),
    )

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__idx")
        seg_id = int(pdf["seg"].iloc[0])
        size = int((pdf["own"] == seg_id).sum())
        nxt = _next_starts(pdf["n"].to_numpy(), max_tokens, max_entries)
        leave, count = [0] * size, [0] * size
        for i in range(size - 1, -1, -1):
            j = int(nxt[i])
            leave[i], count[i] = (j - size, 1) if j >= size else (leave[j], count[j] + 1)
        head = min(size, max_entries)
        return pd.DataFrame(
            {
                "__g": [pdf["__g"].iloc[0]],
                "seg": [seg_id],
                "leave": [leave[:head]],
                "count": [count[:head]],
            }
        )

    maps = seen.drop(*order_cols).groupBy("__g", "seg").applyInPandas(
        exits, "__g string, seg bigint, leave array<int>, count array<int>"
    )
    # A group of one segment starts at its first row; only longer ones are followed.
    longer = rows.filter(F.col("__idx") == segment_rows).select("__g").distinct()
    plan = _follow_exits(maps.join(longer, "__g", "left_semi"))

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__idx")
        seg_id = int(pdf["seg"].iloc[0])
        own = (pdf["own"] == seg_id).to_numpy()
        size = int(own.sum())
        nxt = _next_starts(pdf["n"].to_numpy(), max_tokens, max_entries)
        start = np.zeros(size, dtype=np.int64)
        at = int(pdf["entry"].iloc[0])
        while at < size:
            start[at] = 1
            at = int(nxt[at])
        # Rows before the entry belong to the batch opened in the previous segment.
        ids = int(pdf["first_batch"].iloc[0]) + np.cumsum(start) - 1
        return pdf.loc[own, ["__g", *order_cols]].assign(batch_id=ids)

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in order_cols)
    marked = (
        seen.join(plan, ["__g", "seg"], "left")
        .fillna(0, ["entry", "first_batch"])
        .groupBy("__g", "seg")
        .applyInPandas(mark, f"__g string, {kinds}, batch_id bigint")
    )
    keys = marked.select(
        F.col("__g").alias("__mg"),
        *[F.col(c).alias(f"__m{i}") for i, c in enumerate(order_cols)],
        "batch_id",
    )
    match = reduce(
        lambda x, y: x & y,
        [F.col(c).eqNullSafe(F.col(f"__m{i}")) for i, c in enumerate(order_cols)],
        group.eqNullSafe(F.col("__mg")),
    )
    return df.join(keys, match).select(*df.columns, "batch_id")


def bisect_batches(
    df: DataFrame, failed: DataFrame, order_col: str, batch_col: str = "batch_id"
) -> DataFrame:
    """Rows of a failed batch move to ``<id>_split_0`` (first ``n // 2`` rows) or ``_split_1``.

    A batch of one row cannot be halved and keeps its id. Batches are bounded by their builder.
    """
    w = W.partitionBy(batch_col)
    marks = failed.select(batch_col).distinct()
    # Only failed batches are numbered; all others stay where they are.
    others = df.join(marks, batch_col, "left_anti").select(*df.columns)
    ranked = (
        df.join(marks, batch_col, "left_semi")
        .select(*df.columns)
        .withColumn("__n", F.count(F.lit(1)).over(w))
        .withColumn("__rn", F.row_number().over(w.orderBy(order_col)))
    )
    half = F.floor(F.col("__n") / 2)
    new_id = F.when(
        F.col("__n") > 1,
        F.concat(
            F.col(batch_col),
            F.when(F.col("__rn") <= half, F.lit("_split_0")).otherwise(F.lit("_split_1")),
        ),
    ).otherwise(F.col(batch_col))
    split = ranked.withColumn(batch_col, new_id).drop("__n", "__rn")
    return others.withColumn(batch_col, F.col(batch_col).cast("string")).unionByName(split)


def top_k(
    counts: DataFrame,
    k: int,
    by: Sequence[str] = (),
    count_col: str = "n",
    tie_cols: Sequence[str] = ("first_seen",),
) -> DataFrame:
    """The ``k`` largest counts, ties in first-seen order; per ``by`` group when given."""
    order = [F.desc(count_col), *[F.asc(c) for c in tie_cols]]
    if not by:
        return counts.orderBy(*order).limit(k)
    w = W.partitionBy(*by).orderBy(*order)
    # A rank filter over a window is cut to k rows per group before the exchange as well.
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def sort_by(df: DataFrame, *keys: str) -> DataFrame:
    """G4."""
    return df.orderBy(*keys)


def running_tokens(
    df: DataFrame,
    keys: Sequence[str] = ("run", "split", "epoch"),
    step: str = "step",
    tokens_col: str = "tokens",
) -> DataFrame:
    """Tokens processed so far per run, split and epoch."""
    return running_total(df, tokens_col, [step], keys, "tokens_so_far")


def extremes(df: DataFrame, length_col: str, idx_col: str, keep: Sequence[str]) -> DataFrame:
    """Shortest and longest example; the first one wins a tie."""
    picked = F.struct(*[F.col(c) for c in keep], F.col(length_col), F.col(idx_col))
    low = F.struct(F.col(length_col), F.col(idx_col))
    high = F.struct(F.col(length_col), -F.col(idx_col))
    both = df.agg(F.min_by(picked, low).alias("a"), F.max_by(picked, high).alias("b"))
    return both.select(
        F.explode(
            F.array(
                F.struct(F.lit("shortest").alias("kind"), F.col("a").alias("r")),
                F.struct(F.lit("longest").alias("kind"), F.col("b").alias("r")),
            )
        ).alias("e")
    ).select("e.kind", "e.r.*")
