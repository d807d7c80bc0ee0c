"""Span corruption (K13 to K15), over whole Arrow batches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def span_lengths(input_len: int, density: float, mean_span: float) -> tuple[int, int]:
    """Raw tokens that fit an input of ``input_len`` after corruption, and the target length."""

    def lengths(raw: int) -> tuple[int, int]:
        noise = round(raw * density)
        spans = round(noise / mean_span)
        return raw - noise + spans + 1, noise + spans + 1

    raw = input_len
    while lengths(raw + 1)[0] <= input_len:
        raw += 1
    target = lengths(raw)[1]
    if density == 0.5 and target > lengths(raw)[0]:
        return raw - 1, target - 1
    return raw, target


# The primes of Spark's ``xxhash64``.
_P1, _P2, _P3, _P5 = (
    np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)
)
# Entries of rows that are masked or corrupted at a time.
ENTRIES = 1 << 18


def _hash_on(before: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of one more integer, given that of the values before it."""
    u = np.uint64
    h = (before.view(u) + _P5 + u(4)) ^ (i.astype(u) * _P1)
    h = ((h << u(23)) | (h >> u(41))) * _P2 + _P3
    h = (h ^ (h >> u(33))) * _P2
    h = (h ^ (h >> u(29))) * _P3
    return (h ^ (h >> u(32))).view(np.int64)


def _pieces(before: np.ndarray, items: int, parts: int) -> np.ndarray:
    """Lengths of ``parts`` random non-empty pieces of ``items``: cuts are the smallest hashes."""
    spots = np.arange(1, items)
    cuts = np.sort(spots[np.argsort(_hash_on(before, spots), kind="stable")[: parts - 1]])
    return np.diff(cuts, prepend=0, append=items)


def _alternating(noise: pa.Array, clean: pa.Array, spans: pa.Array, of_noise: pa.Array, of_clean: pa.Array) -> pa.Array:
    """Masks of ``clean`` and ``noise`` positions in turns; null where there are no spans."""
    sizes = [pc.fill_null(x, 0).to_numpy(zero_copy_only=False) for x in (noise, clean, spans)]
    hashes = [x.to_numpy(zero_copy_only=False) for x in (of_noise, of_clean)]
    some = sizes[2] > 0
    runs, lengths = [np.zeros(0, np.int64)], np.zeros(len(some), np.int64)
    for r in np.flatnonzero(some).tolist():
        n, c, parts = (int(x[r]) for x in sizes)
        pair = _pieces(hashes[1][r : r + 1], c, parts), _pieces(hashes[0][r : r + 1], n, parts)
        runs.append(np.stack(pair, 1).ravel())
        lengths[r] = c + n
    run = np.concatenate(runs)
    mask = np.repeat(np.arange(len(run)) % 2 == 1, run)
    starts = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
    return pa.ListArray.from_arrays(starts, pa.array(mask), mask=pa.array(~some))


def span_mask(
    df: DataFrame,
    density: float,
    mean_span: float,
    seed: int,
    id_cols: Sequence[str],
    ids: str = "input_ids",
    name: str = "mask",
) -> DataFrame:
    """``true`` on noise. Counts are fixed by the length; only the cuts are random.

    Spans alternate, starting without noise. The cuts hash the row id and ``seed``, so a retried
    task draws the same mask. Rows too short for both kinds stay unmasked.
    """
    n = F.size(ids)
    staged = (
        df.withColumn(
            "__noise",
            F.least(F.greatest(F.bround(n * F.lit(density)).cast("int"), F.lit(1)), n - 1),
        )
        .withColumn("__clean", n - F.col("__noise"))
        .withColumn(
            "__spans",
            F.least(
                F.greatest(F.bround(F.col("__noise") / F.lit(mean_span)).cast("int"), F.lit(1)),
                "__noise",
                "__clean",
            ),
        )
    )
    # What the hash of a cut begins with: the row and the side, 1 for noise.
    before = lambda side: F.xxhash64(*[F.col(c) for c in id_cols], F.lit(seed), F.lit(side))
    spans = F.when(n >= 2, F.col("__spans"))
    turns = F.arrow_udf(_alternating, "array<boolean>")(F.col("__noise"), F.col("__clean"), spans, before(1), before(0))
    mask = F.when(n < 2, F.array_repeat(F.lit(False), n)).otherwise(turns)
    return staged.withColumn(name, mask).drop("__noise", "__clean", "__spans")


def _entries(lists: pa.Array, width: np.ndarray, fill) -> tuple[np.ndarray, np.ndarray]:
    """The entries of lists, each filled up to its width, and whether they are there and not null."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten()
    at = np.arange(len(values)) + np.repeat(np.cumsum(width) - width - np.cumsum(sizes) + sizes, sizes)
    out, there = np.full(int(width.sum()), fill), np.zeros(int(width.sum()), bool)
    out[at] = pc.fill_null(values, fill).to_numpy(zero_copy_only=False)
    there[at] = pc.is_valid(values).to_numpy(zero_copy_only=False)
    return out, there


def _with_sentinels(
    x: np.ndarray, there: np.ndarray, masked: np.ndarray, kept: np.ndarray, width: np.ndarray, vocab_len: int, eos: int
) -> tuple[np.ndarray, np.ndarray]:
    """Entries and lengths of rows whose runs of masked positions became sentinels: the k-th run gets sentinel k."""
    firsts = (np.cumsum(width) - width)[width > 0]
    begins = masked.copy()
    begins[1:] &= ~masked[:-1]
    begins[firsts] = masked[firsts]
    seen = np.concatenate([[0], np.cumsum(begins)])
    rank = seen[1:] - np.repeat(seen[np.cumsum(width) - width], width)
    stay = (kept & there) | begins
    upto = np.concatenate([[0], np.cumsum(stay)])
    sizes = np.diff(upto[np.concatenate([[0], np.cumsum(width)])])
    out = np.full(int(sizes.sum()) + len(width), eos, x.dtype)
    values = np.where(begins, vocab_len - rank, x)[stay]
    out[np.arange(len(values)) + np.repeat(np.arange(len(width)), sizes)] = values
    return out, sizes + 1


def _corrupt(ids: pa.Array, mask: pa.Array, vocab_len: int, eos: int) -> list[pa.Array]:
    sizes = [pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False) for c in (ids, mask)]
    width = np.maximum(*sizes).astype(np.int64)
    x, there = _entries(ids, width, 0)
    on, known = _entries(mask, width, False)
    on, off = on & known, ~on & known
    none = pc.or_(ids.is_null(), mask.is_null())
    out = []
    for masked, kept in ((on, off), (off, on)):
        values, lengths = _with_sentinels(x, there, masked, kept, width, vocab_len, eos)
        starts = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
        out.append(pa.ListArray.from_arrays(starts, pa.array(values, ids.type.value_type), mask=none))
    return out


def corrupt_spans(
    df: DataFrame,
    vocab_len: int,
    eos: int,
    ids: str = "input_ids",
    mask: str = "mask",
    input_len: int | None = None,
    target_len: int | None = None,
) -> DataFrame:
    """Each noise span becomes a falling sentinel id; the labels use the complement mask.

    Given lengths are checked; a row that misses them is an error.
    """
    whole = df.select(F.concat(F.col(ids), F.array(F.lit(eos))).alias("x")).schema["x"].dataType.elementType.simpleString()

    @F.arrow_udf(f"ids array<{whole}>, labels array<{whole}>")
    def corrupt(values: pa.Array, masks: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)
        edges = (np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // ENTRIES)) + 1).tolist()
        parts = [
            _corrupt(values.slice(a, b - a), masks.slice(a, b - a), vocab_len, eos)
            for a, b in zip([0, *edges], [*edges, len(values)])
        ]
        return pa.StructArray.from_arrays([pa.concat_arrays(p) for p in zip(*parts)], names=["ids", "labels"])

    out = df.withColumn("__c", corrupt(F.col(ids).cast(f"array<{whole}>"), F.col(mask)))
    out = out.withColumn("labels", F.col("__c.labels")).withColumn(ids, F.col("__c.ids")).drop("__c")
    for col, want in ((ids, input_len), ("labels", target_len)):
        if want is not None:
            wrong = F.raise_error(F.lit(f"{col} does not have {want} entries")).cast("array<int>")
            out = out.withColumn(col, F.when(F.size(col) == want, F.col(col)).otherwise(wrong))
    return out
