"""Arrow functions for what column expressions cannot do well inside one row.

Each one reduces a pair of texts to a few numbers; Spark sums and averages them. No row sees another
row, so there is no shuffle before the final, tiny aggregate. Whole texts are always used.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .porter import stem
from .text import BLANK_CHARS, Split

# Limits in the definition of the edit rate.
MAX_SHIFT_SIZE, MAX_SHIFT_DISTANCE, MAX_SHIFT_TRIALS = 10, 50, 1000
# Weights in the definition of METEOR.
METEOR_ALPHA, METEOR_BETA, METEOR_GAMMA = 0.9, 3.0, 0.5


_BLANK = np.zeros(0x3002, bool)
_BLANK[[ord(c) for c in BLANK_CHARS]] = True

# Units counted at a time: their hash tables fit a core's cache.
UNITS_PER_CHUNK = 1 << 16
# Characters of texts that are split at a time.
TEXT_PER_CHUNK = 1 << 19


def _flat(parts: list[pa.Array]) -> pa.Array:
    """The entries of several arrays of lists, end to end."""
    # An empty array from the JVM may lack the buffers that a concatenation reads.
    full = [x for x in (p.flatten() for p in parts) if len(x)]
    return pa.concat_arrays(full) if full else pa.array([], parts[0].type.value_type)


def _split_units(pieces: pa.Array, split: Split) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """How many units each piece has, their numbers, piece by piece, and the distinct units by number."""
    plain = pc.match_substring_regex(pieces, split.plain)
    is_plain = plain.to_numpy(zero_copy_only=False).astype(bool)
    odd = split.lists(pieces.filter(pc.invert(plain)))
    units = _flat([odd])
    full = pc.not_equal(units, "").to_numpy(zero_copy_only=False).astype(bool)
    owner = np.repeat(np.arange(len(odd)), np.diff(odd.offsets.to_numpy()))[full]
    counts = np.ones(len(pieces), np.int64)
    counts[~is_plain] = np.bincount(owner, minlength=len(odd))
    whole = pieces.filter(plain)
    coded = pa.concat_arrays([whole, units.filter(pa.array(full)).cast(pieces.type)]).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    numbers = np.empty(len(code), np.int64)
    at_plain = np.repeat(is_plain, counts)
    numbers[at_plain], numbers[~at_plain] = code[: len(whole)], code[len(whole) :]
    return counts, numbers, coded.dictionary


def _coded(parts: list[pa.Array], split: Split | None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Lengths of token lists, the number of every token, and the distinct tokens; with ``split`` the lists hold pieces."""
    sizes = np.concatenate([np.diff(p.offsets.to_numpy()) for p in parts]).astype(np.int64)
    coded = _flat(parts).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if split is None:
        return sizes, code, coded.dictionary
    counts, numbers, words = _split_units(coded.dictionary, split)
    each = counts[code]
    lengths = np.bincount(np.repeat(np.arange(len(sizes)), sizes), each, len(sizes)).astype(np.int64)
    piece, place = _places(each)
    return lengths, numbers[(np.cumsum(counts) - counts)[code][piece] + place], words


def _units(
    parts: list[pa.Array], stemmed: bool, split: Split | None = None, blanks: bool = True
) -> tuple[np.ndarray, np.ndarray]:
    """Sequence lengths, and one number per unit such that equal units have equal numbers.

    A part is an array of token lists, or of texts (then characters are the units, without ``blanks`` those that are
    none). With ``split`` the lists hold
    pieces, each distinct one of which is split into its units once.
    """
    if split is not None or pa.types.is_list(parts[0].type):
        lengths, numbers, words = _coded(parts, split)
        if stemmed:
            stems = [stem(w) if len(w) > 3 else w for w in words.to_pylist()]
            numbers = pd.factorize(np.array(stems, dtype=object))[0][numbers].astype(np.int64)
        return lengths, numbers
    lengths, units = _code_points(parts)
    if not blanks:
        kept = ~_BLANK[units if units.itemsize == 1 else np.minimum(units, len(_BLANK) - 1)]
        ends = np.concatenate([[0], np.cumsum(kept)])[np.cumsum(lengths)]
        lengths, units = np.diff(ends, prepend=0), units[kept]
    return lengths, units.astype(np.int64)


def _code_points(parts: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of texts in characters, and all their characters end to end."""
    lengths = [pc.utf8_length(p).to_numpy(zero_copy_only=False).astype(np.int64) for p in parts]
    ends = [pa.array([0, len(p)], pa.int32()) for p in parts]
    joined = [pc.binary_join(pa.ListArray.from_arrays(e, p), "")[0].as_py().encode() for e, p in zip(ends, parts)]
    data = b"".join(joined)
    sizes = np.concatenate(lengths)
    if len(data) == sizes.sum():
        return sizes, np.frombuffer(data, np.uint8)
    return sizes, np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)


def clipped_counts(
    pred: pa.Array, refs: pa.Array, max_n: int, stemmed: bool = False, split: Split | None = None, blanks: bool = True
) -> np.ndarray:
    """Per row: matches, prediction n-grams and reference n-grams of every order, and both lengths.

    Every n-gram gets a number that is unique within its row, by extending the number of its first
    ``n - 1`` units with the last one; counting is then integer work over all rows at once.
    """
    n_refs = np.diff(refs.offsets.to_numpy()).astype(np.int64)
    return _clipped(*_units([pred, refs.flatten()], stemmed, split, blanks), n_refs, max_n)


def _codes_in_row(row: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Numbers of units that are unique within their row only, from 0."""
    keys = row * (int(codes.max()) + 1) + codes
    order = np.argsort(keys)
    ids = np.concatenate([[0], np.cumsum(np.diff(keys[order]) != 0)])
    rows = row[order]
    first = np.concatenate([[True], np.diff(rows) != 0])
    out = np.empty(len(codes), np.int64)
    out[order] = ids - ids[first][np.cumsum(first) - 1]
    return out


def _matches(lengths: np.ndarray, units: np.ndarray, n_rows: int, max_n: int) -> np.ndarray | None:
    """Clipped matches of every order against one reference a row; null where an n-gram fits no machine word.

    A number holds the row, ``max_n`` units (0: behind the end) and the side. Sorted once, the n-grams of every
    order stand side by side.
    """
    row = np.repeat(np.tile(np.arange(n_rows), 2), lengths)
    free = 62 - n_rows.bit_length()
    codes = _without_gaps(units)
    bits = (int(codes.max()) + 1).bit_length()
    if bits * max_n > free:
        codes = _codes_in_row(row, codes)
        bits = (int(codes.max()) + 1).bit_length()
        if bits * max_n > free:
            return None
    # Every sequence is followed by as many zeros as an n-gram may reach behind its end.
    at = np.arange(len(units)) + np.repeat(np.arange(2 * n_rows) * (max_n - 1), lengths)
    spread = np.zeros(len(units) + (2 * n_rows + 1) * (max_n - 1), np.int64)
    spread[at] = codes + 1
    size = len(spread) - max_n + 1
    grams = spread[:size].copy()
    for k in range(1, max_n):
        grams <<= bits
        grams |= spread[k : size + k]
    row <<= bits * max_n
    keys = grams[at]
    keys |= row
    keys <<= 1
    keys[lengths[:n_rows].sum() :] |= 1
    keys.sort()
    # Where an entry begins, and how many of the reference's n-grams stand before it; both with the end.
    begins, wanted = np.arange(len(keys) + 1), np.zeros(len(keys) + 1, np.int64)
    np.cumsum(keys & 1, out=wanted[1:])
    keys >>= 1
    bounds = np.arange(n_rows + 1) << (bits * max_n)
    last = (1 << bits) - 1
    out = np.zeros((n_rows, max_n), np.int64)
    # From the longest n-grams on: an order's entries are runs of those of the order above.
    for n in range(max_n, 0, -1):
        shift = bits * (max_n - n)
        apart = keys[1:] ^ keys[:-1]
        starts = np.flatnonzero(np.concatenate([[True], apart >= (1 << shift), [True]]))
        begins, wanted, keys = begins[starts], wanted[starts], keys[starts[:-1]]
        want = np.diff(wanted)
        both = np.minimum(want, np.diff(begins) - want)
        both[(keys >> shift) & last == 0] = 0
        sums = np.concatenate([[0], np.cumsum(both)])
        out[:, n - 1] = np.diff(sums[np.searchsorted(keys, bounds)])
    return out


def _without_ends(
    lengths: np.ndarray, units: np.ndarray, n_rows: int, context: int
) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and units of both sides without what they begin and end with alike, but for ``context`` units of it.

    N-grams of at most one unit more that lie in what is left out are the same ones on both sides, so each is a match.
    """
    starts = np.cumsum(lengths) - lengths
    a = Sequences(units, starts[:n_rows], lengths[:n_rows])
    b = Sequences(units, starts[n_rows:], lengths[n_rows:])
    inner, _, same = _trimmed(a, b)
    front = inner.starts - a.starts
    skip, back = np.maximum(front - context, 0), np.maximum(same - front - context, 0)
    left = lengths - np.tile(skip + back, 2)
    return left, Sequences(units, starts + np.tile(skip, 2), left).units()[2]


def _without_gaps(units: np.ndarray) -> np.ndarray:
    """Numbers from 0 on, equal ones for equal units."""
    most = int(units.max())
    if most > max(len(units), 1 << 16):
        return pd.factorize(units)[0].astype(np.int64)
    seen = np.zeros(most + 1, bool)
    seen[units] = True
    return (np.cumsum(seen) - 1)[units]


def _clipped(lengths: np.ndarray, units: np.ndarray, n_refs: np.ndarray, max_n: int) -> np.ndarray:
    n_rows = len(n_refs)
    out = np.zeros((n_rows, 3 * max_n + 2), dtype=np.int64)
    ref_row = np.repeat(np.arange(n_rows), n_refs)
    seq_row = np.concatenate([np.arange(n_rows), ref_row])
    nth = np.arange(len(ref_row)) - np.repeat(np.cumsum(n_refs) - n_refs, n_refs)
    seq_side = np.concatenate([np.zeros(n_rows, dtype=np.int64), nth + 1])
    n_sides = int(seq_side.max(initial=0)) + 1
    # The reference nearest in length; the earlier one of equals.
    out[:, -2] = lengths[:n_rows]
    gap = np.abs(lengths[n_rows:] - lengths[ref_row])
    order = np.lexsort((nth, gap, ref_row))[::-1]
    out[ref_row[order], -1] = lengths[n_rows:][order]
    if not len(units):
        return out
    if (n_refs == 1).all():
        left, held = _without_ends(lengths, units, n_rows, max_n - 1)
        matches = _matches(left, held, n_rows, max_n) if len(held) else np.zeros((n_rows, max_n), np.int64)
        if matches is not None:
            sizes = lambda x: np.maximum(x[:, None] - np.arange(max_n), 0)
            have = sizes(lengths[:n_rows])
            out[:, :max_n] = matches + have - sizes(left[:n_rows])
            out[:, max_n : 2 * max_n] = have
            out[:, 2 * max_n : 3 * max_n] = sizes(lengths[n_rows:])
            return out
    row_of, side_of = np.repeat(seq_row, lengths), np.repeat(seq_side, lengths)
    ends = np.repeat(np.cumsum(lengths), lengths)
    single = pd.factorize(row_of * (int(units.max()) + 1) + units)[0].astype(np.int64)
    at, ids = np.arange(len(units)), single
    for n in range(1, max_n + 1):
        if n > 1:
            fits = at + n <= ends[at]
            at, ids = at[fits], ids[fits]
            if not len(at):
                break
            longer = ids * (int(single.max()) + 1) + single[at + n - 1]
            ids = pd.factorize(longer)[0].astype(np.int64)
        grams = int(ids.max()) + 1
        counts = np.bincount(ids * n_sides + side_of[at], minlength=grams * n_sides)
        counts = counts.reshape(grams, n_sides)
        have, want = counts[:, 0], counts[:, 1:].max(axis=1, initial=0)
        row_of_gram = np.empty(grams, dtype=np.int64)
        row_of_gram[ids] = row_of[at]
        for k, values in enumerate((np.minimum(have, want), have, want)):
            column = np.bincount(row_of_gram, weights=values, minlength=n_rows)
            out[:, k * max_n + n - 1] = column
    return out


def _row_ranges(pred: pa.Array, refs: pa.Array, units: int = UNITS_PER_CHUNK) -> list[tuple[int, int]]:
    """Row ranges of about so many units, so that long texts do not pile up in memory."""
    def sizes(part: pa.Array) -> np.ndarray:
        if pa.types.is_list(part.type):
            return np.diff(part.offsets.to_numpy()).astype(np.int64)
        return pc.utf8_length(part).to_numpy(zero_copy_only=False).astype(np.int64)

    ref_ends = np.concatenate([[0], np.cumsum(sizes(refs.flatten()))])
    bounds = refs.offsets.to_numpy() - refs.offsets[0].as_py()
    total = np.cumsum(sizes(pred) + np.diff(ref_ends[bounds]))
    cuts = np.flatnonzero(np.diff(total // units)) + 1
    edges = [0, *cuts.tolist(), len(pred)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if b > a]


def ngram_fields(max_n: int) -> list[str]:
    sides = [f"{side}_{i}" for side in ("match", "pred", "ref") for i in range(max_n)]
    return [*sides, "pred_len", "ref_len"]


def _pieces(texts: pa.Array) -> pa.Array:
    return pc.split_pattern(texts, " ")


def ngram_counts(
    pred: Column, refs: Column, max_n: int, stemmed: bool = False, split: Split | None = None, blanks: bool = True
) -> Column:
    """Clipped n-gram matches against an array of references.

    ``pred`` is a token array or a text (then characters are the units, blanks too or not), ``refs`` an array of these.
    With ``split`` the units are what it makes of a text's pieces between blanks.
    Fields: ``match_i``, ``pred_i``, ``ref_i`` per order, ``pred_len`` and ``ref_len`` (of the
    reference nearest in length).
    """
    names = ngram_fields(max_n)

    @F.arrow_udf(", ".join(f"{n} bigint" for n in names))
    def count(preds: pa.Array, references: pa.Array) -> pa.Array:
        if split is not None:
            starts = pa.array(references.offsets.to_numpy() - references.offsets[0].as_py(), pa.int32())
            preds, references = _pieces(preds), pa.ListArray.from_arrays(starts, _pieces(references.flatten()))
        parts = [
            clipped_counts(preds.slice(a, b - a), references.slice(a, b - a), max_n, stemmed, split, blanks)
            for a, b in _row_ranges(preds, references)
        ]
        table = np.concatenate(parts) if parts else np.zeros((0, len(names)), dtype=np.int64)
        return pa.StructArray.from_arrays([pa.array(c) for c in table.T], names=names)

    return count(pred, refs)


def lcs_length(a: Sequence, b: Sequence) -> int:
    """Bit-parallel longest common subsequence: one machine-word-parallel step per token of ``b``."""
    where: dict = defaultdict(int)
    for i, token in enumerate(a):
        where[token] |= 1 << i
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        hit = row & where.get(token, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def distance(a: Sequence, b: Sequence) -> int:
    """Bit-parallel edit distance: one step per token of ``b``."""
    steps = EditSteps(a)
    state = steps.first
    for token in b:
        state = steps.after(state, token)
    return state[2]


class Sequences:
    """Runs of one array of numbers; equal units have equal numbers."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.codes, self.starts, self.sizes = codes, starts, sizes

    def at(self, rows: np.ndarray) -> Sequences:
        return Sequences(self.codes, self.starts[rows], self.sizes[rows])

    def units(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, place in the row, and code of all units, row by row."""
        row, place = _places(self.sizes)
        return row, place, self.codes[self.starts[row] + place]

    def one(self, i: int) -> list[int]:
        return self.codes[self.starts[i] : self.starts[i] + self.sizes[i]].tolist()


def _places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _both_sides(
    left: pa.Array, right: pa.Array, stemmed: bool = False, split: Split | None = None
) -> tuple[Sequences, Sequences]:
    sizes, codes = _units([left, right], stemmed, split)
    starts, n = np.cumsum(sizes) - sizes, len(left)
    return Sequences(codes, starts[:n], sizes[:n]), Sequences(codes, starts[n:], sizes[n:])


def _trimmed(a: Sequences, b: Sequences) -> tuple[Sequences, Sequences, np.ndarray]:
    """Both sides without their common beginning and end, and how many units these have."""
    codes, same = a.codes, np.zeros(len(a.sizes), np.int64)
    for back in (False, True):
        row, place = _places(np.minimum(a.sizes, b.sizes))
        pick = lambda x: codes[x.starts[row] + (x.sizes[row] - 1 - place if back else place)]
        at = np.flatnonzero(pick(a) != pick(b))
        n = np.minimum(a.sizes, b.sizes)
        # The first place of every row at which the sides differ.
        at = at[np.diff(row[at], prepend=-1) > 0]
        n[row[at]] = place[at]
        skip = 0 if back else n
        a, b = (Sequences(codes, x.starts + skip, x.sizes - n) for x in (a, b))
        same += n
    return a, b, same


# Longest sequences whose steps are taken for many rows at once; the shorter one has to fit a machine word.
WORD_BITS, MOST_STEPS = 64, 512


def _hits(a: Sequences, b: Sequences) -> np.ndarray:
    """For every unit of ``b``, row by row, the places of the row's ``a`` that hold it, as bits."""
    (row_a, place, code_a), (row_b, _, code_b) = a.units(), b.units()
    most = int(max(code_a.max(initial=0), code_b.max(initial=0))) + 1
    ids = pd.factorize(np.concatenate([row_a * most + code_a, row_b * most + code_b]))[0]
    masks = np.zeros(len(ids) + 1, np.uint64)
    np.bitwise_or.at(masks, ids[: len(row_a)], np.uint64(1) << place.astype(np.uint64))
    return masks[ids[len(row_a) :]]


def _in_step(a: Sequences, b: Sequences) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """For the t-th units of ``b``: the order of the rows, how many have one, and its places in ``a``."""
    hits, order = _hits(a, b), np.argsort(-b.sizes, kind="stable")
    starts, sizes = (np.cumsum(b.sizes) - b.sizes)[order], b.sizes[order]
    for t in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -t, "left"))
        yield order, n, hits[starts[:n] + t]


def _low_bits(sizes: np.ndarray) -> np.ndarray:
    n = sizes.astype(np.uint64)
    return np.where(n == 0, np.uint64(0), ~np.uint64(0) >> (np.uint64(64) - np.maximum(n, np.uint64(1))))


def _lcs_in_step(a: Sequences, b: Sequences) -> np.ndarray:
    rows = np.full(len(a.sizes), ~np.uint64(0))
    order = np.arange(len(a.sizes))
    for order, n, same in _in_step(a, b):
        row = rows[:n]
        hit = row & same
        rows[:n] = (row + hit) | (row - hit)
    out = np.empty(len(rows), np.int64)
    out[order] = np.bitwise_count(~rows & _low_bits(a.sizes[order]))
    return out


def _distance_in_step(a: Sequences, b: Sequences) -> np.ndarray:
    ups, downs = np.full(len(a.sizes), ~np.uint64(0)), np.zeros(len(a.sizes), np.uint64)
    one, order = np.uint64(1), np.argsort(-b.sizes, kind="stable")
    far, last = a.sizes[order], (a.sizes[order] - 1).astype(np.uint64)
    for _, n, same in _in_step(a, b):
        up, down = ups[:n], downs[:n]
        diagonal = (((same & up) + up) ^ up) | same | down
        right_up, right_down = down | ~(diagonal | up), up & diagonal
        far[:n] += ((right_up >> last[:n]) & one).astype(np.int64) - ((right_down >> last[:n]) & one).astype(np.int64)
        right_up = (right_up << one) | one
        ups[:n] = (right_down << one) | ~(diagonal | right_up)
        downs[:n] = right_up & diagonal
    out = np.empty(len(far), np.int64)
    out[order] = far
    return out


def _measured(a: Sequences, b: Sequences, in_step: Callable, alone: Callable, empty: np.ndarray) -> np.ndarray:
    """A symmetric measure of all rows: ``empty`` where a side is, many short rows at once, long ones one by one."""
    turn = a.sizes > b.sizes
    low = Sequences(a.codes, np.where(turn, b.starts, a.starts), np.where(turn, b.sizes, a.sizes))
    high = Sequences(a.codes, np.where(turn, a.starts, b.starts), np.where(turn, a.sizes, b.sizes))
    out = empty.copy()
    short = (low.sizes <= WORD_BITS) & (high.sizes <= MOST_STEPS)
    rows = np.flatnonzero(short & (low.sizes > 0))
    if len(rows):
        out[rows] = in_step(low.at(rows), high.at(rows))
    for i in np.flatnonzero(~short & (low.sizes > 0)).tolist():
        out[i] = alone(low.one(i), high.one(i))
    return out


def _lcs_lengths(a: Sequences, b: Sequences) -> np.ndarray:
    a, b, same = _trimmed(a, b)
    return same + _measured(a, b, _lcs_in_step, lcs_length, np.zeros(len(same), np.int64))


def _distances(a: Sequences, b: Sequences) -> np.ndarray:
    a, b, _ = _trimmed(a, b)
    return _measured(a, b, _distance_in_step, distance, np.maximum(a.sizes, b.sizes))


def _list_ranges(left: pa.Array, right: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Rows of two arrays of lists, some at a time, so that long ones do not pile up in memory."""
    sizes = sum(np.diff(x.offsets.to_numpy()).astype(np.int64) for x in (left, right))
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // UNITS_PER_CHUNK)) + 1
    edges = [0, *cuts.tolist(), len(left)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield left.slice(a, b - a), right.slice(a, b - a)


def _pairs(
    kernel: Callable[[pa.Array, pa.Array], Sequence[np.ndarray]],
    names: list[str],
    lists: Callable[[pa.Array], pa.Array] = lambda x: x,
):
    """Arrow function from a kernel over two arrays of lists that returns a column of integers a name."""

    @F.arrow_udf(", ".join(f"{n} bigint" for n in names))
    def apply(left: pa.Array, right: pa.Array) -> pa.Array:
        parts = [kernel(a, b) for a, b in _list_ranges(lists(left), lists(right))]
        columns = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in range(len(names))]
        return pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=names)

    return apply


def lcs_counts(pred: Column, ref: Column, stemmed: bool = False, split: Split | None = None) -> Column:
    """``hits``, ``pred_len``, ``ref_len`` of the longest common subsequence.

    Both sides are token arrays; with ``split`` texts, whose words are what it makes of their pieces between blanks.
    """

    def kernel(preds, refs):
        a, b = _both_sides(preds, refs, stemmed, split)
        return _lcs_lengths(a, b), a.sizes, b.sizes

    lists = _pieces if split is not None else lambda x: x
    return _pairs(kernel, ["hits", "pred_len", "ref_len"], lists)(pred, ref)


def _lcs_positions(ref: list, pred: list) -> set[int]:
    """Positions of ``ref`` on one longest common subsequence with ``pred``."""
    # table[j] packs the row differences of the first j tokens of ref: its zero bits are steps.
    where: dict = defaultdict(int)
    for i, token in enumerate(pred):
        where[token] |= 1 << i
    full = (1 << len(pred)) - 1
    table = [full]
    for token in ref:
        row = table[-1]
        hit = row & where.get(token, 0)
        table.append(((row + hit) | (row - hit)) & full)

    def length(j: int, i: int) -> int:
        return i - (table[j] & ((1 << i) - 1)).bit_count()

    i, j, found = len(pred), len(ref), set()
    while i and j:
        if pred[i - 1] == ref[j - 1]:
            found.add(j - 1)
            i, j = i - 1, j - 1
        elif length(j, i - 1) > length(j - 1, i):
            i -= 1
        else:
            j -= 1
    return found


# Pairs of sentences whose common subsequences are followed at once.
PAIRS_TOGETHER = 4096


def _mark_common(refs: Sequences, preds: Sequences, marks: np.ndarray, firsts: np.ndarray) -> None:
    """Mark the places of each reference on one longest common subsequence, as ``_lcs_positions`` takes it.

    ``firsts``: where each reference begins in ``marks``. Predictions fit a machine word.
    """
    order = np.argsort(-refs.sizes, kind="stable")
    refs, preds, firsts = refs.at(order), preds.at(order), firsts[order]
    table = np.full((int(refs.sizes.max()) + 1, len(order)), ~np.uint64(0))
    for t, (_, n, same) in enumerate(_in_step(preds, refs)):
        row = table[t, :n]
        hit = row & same
        table[t + 1, :n] = (row + hit) | (row - hit)
    k, i, j = np.arange(len(order)), preds.sizes.copy(), refs.sizes.copy()
    while True:
        on = (i > 0) & (j > 0)
        if not on.all():
            k, i, j = k[on], i[on], j[on]
        if not len(k):
            return
        equal = preds.codes[preds.starts[k] + i - 1] == refs.codes[refs.starts[k] + j - 1]
        marks[(firsts[k] + j - 1)[equal]] = True
        shorter = i - 1 - np.bitwise_count(table[j, k] & _low_bits(i - 1)).astype(np.int64)
        earlier = i - np.bitwise_count(table[j - 1, k] & _low_bits(i)).astype(np.int64)
        left = equal | (shorter > earlier)
        j = j - (equal | ~left)
        i = i - left


def _union_marks(preds: Sequences, pred_rows: np.ndarray, refs: Sequences, ref_rows: np.ndarray) -> np.ndarray:
    """Which units of the references, one after the other, are on a common subsequence with a prediction's sentence."""
    firsts = np.cumsum(refs.sizes) - refs.sizes
    marks = np.zeros(int(refs.sizes.sum()), bool)
    wait: list[tuple[int, int]] = []

    def follow() -> None:
        if wait:
            r, p = np.array(wait).T
            _mark_common(refs.at(r), preds.at(p), marks, firsts[r])
            wait.clear()

    ends = np.searchsorted(pred_rows, np.arange(int(ref_rows.max(initial=-1)) + 2))
    bounds = np.searchsorted(ref_rows, np.arange(int(ref_rows.max(initial=-1)) + 2))
    for row in np.unique(ref_rows).tolist():
        # Equal sentences count once: the union holds their places already.
        held = {tuple(preds.one(p)): p for p in range(ends[row], ends[row + 1])}
        holders: dict[int, list] = defaultdict(list)
        for words in held:
            for token in set(words):
                holders[token].append(words)
        first_like: dict[tuple, int] = {}
        copies: list[tuple[int, int]] = []
        for r in range(bounds[row], bounds[row + 1]):
            ref = tuple(refs.one(r))
            if ref in held:
                marks[firsts[r] : firsts[r] + len(ref)] = True
                continue
            if ref in first_like:
                copies.append((first_like[ref], r))
                continue
            first_like[ref] = r
            shared = Counter(w for token in set(ref) for w in holders.get(token, ()))
            if len(shared) == 1 or all(len(w) <= WORD_BITS for w in shared) and len(ref) <= MOST_STEPS:
                pending = [w for w in shared if len(w) <= WORD_BITS and len(ref) <= MOST_STEPS]
                wait.extend((r, held[w]) for w in pending)
                rest = [w for w in shared if not (len(w) <= WORD_BITS and len(ref) <= MOST_STEPS)]
            else:
                rest = [w for w, _ in shared.most_common()]
            # Places that a sentence could still add.
            open_at: dict[int, set[int]] = defaultdict(set)
            for at, token in enumerate(ref):
                open_at[token].add(at)
            for words in rest:
                if not any(open_at.get(token) for token in set(words)):
                    continue
                for at in _lcs_positions(list(ref), list(words)):
                    marks[firsts[r] + at] = True
                    open_at[ref[at]].discard(at)
            if len(wait) >= PAIRS_TOGETHER:
                follow()
        if copies:
            follow()
            for a, r in copies:
                marks[firsts[r] : firsts[r] + refs.sizes[r]] = marks[firsts[a] : firsts[a] + refs.sizes[a]]
    follow()
    return marks


def _lsum(preds: pa.Array, refs: pa.Array, stemmed: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pred_rows, ref_rows = (np.repeat(np.arange(len(x)), np.diff(x.offsets.to_numpy())) for x in (preds, refs))
    return _lsum_of(len(preds), *_both_sides(preds.flatten(), refs.flatten(), stemmed), pred_rows, ref_rows)


def _lsum_of(
    n: int, p: Sequences, r: Sequences, pred_rows: np.ndarray, ref_rows: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hits and both lengths of ``n`` rows, from the sentences of both sides, row by row."""
    n_pred, n_ref = (np.bincount(at, x.sizes, n).astype(np.int64) for at, x in ((pred_rows, p), (ref_rows, r)))
    hits = np.zeros(n, np.int64)
    single = (np.bincount(pred_rows, minlength=n) == 1) & (np.bincount(ref_rows, minlength=n) == 1)
    # The union is one subsequence, whose words both sides have.
    hits[single] = _lcs_lengths(p.at(np.flatnonzero(single[pred_rows])), r.at(np.flatnonzero(single[ref_rows])))
    if not single.all():
        of_p, of_r = np.flatnonzero(~single[pred_rows]), np.flatnonzero(~single[ref_rows])
        p, r, pred_rows, ref_rows = p.at(of_p), r.at(of_r), pred_rows[of_p], ref_rows[of_r]
        marks = _union_marks(p, pred_rows, r, ref_rows)
        (at_p, _, code_p), (at_r, _, code_r) = p.units(), r.units()
        most = int(max(code_p.max(initial=0), code_r.max(initial=0))) + 1
        keys = np.concatenate([pred_rows[at_p] * most + code_p, (ref_rows[at_r] * most + code_r)[marks]])
        # A word counts as often as the prediction has it, at most.
        ids, found = pd.factorize(keys)
        have = np.bincount(ids[: len(at_p)], minlength=len(found))
        used = np.bincount(ids[len(at_p) :], minlength=len(found))
        hits += np.bincount(found // most, np.minimum(have, used), n).astype(np.int64)
    return hits, n_pred, n_ref


def _sentence_ranges(preds: pa.Array, refs: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    """As ``_list_ranges``, by the words of the sentences."""
    sizes = np.zeros(len(preds), np.int64)
    for x in (preds, refs):
        words = np.concatenate([[0], np.cumsum(np.diff(x.flatten().offsets.to_numpy()))])
        ends = x.offsets.to_numpy() - x.offsets[0].as_py()
        sizes += np.diff(words[ends])
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // UNITS_PER_CHUNK)) + 1
    edges = [0, *cuts.tolist(), len(preds)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield preds.slice(a, b - a), refs.slice(a, b - a)


def lsum_counts(pred: Column, ref: Column, stemmed: bool = False) -> Column:
    """Union-LCS hits over sentences; both sides are arrays of token arrays."""

    def kernel(preds, refs):
        parts = [_lsum(a, b, stemmed) for a, b in _sentence_ranges(preds, refs)]
        return [np.concatenate([p[k] for p in parts]) for k in range(3)]

    return _pairs(kernel, ["hits", "pred_len", "ref_len"])(pred, ref)


def rouge_counts(pred: Column, ref: Column, split: Split) -> Column:
    """Counts of ROUGE-1, -2, -L and -Lsum over two texts from one read; sentences are lines.

    ``match_i``, ``pred_i`` and ``ref_i`` as in ``ngram_counts``, then ``lcs`` and ``lsum`` hits, ``pred_len`` and
    ``ref_len``. Words are what ``split`` makes of a line's pieces between blanks.
    """

    def kernel(preds, refs):
        n = len(preds)
        lines = [pc.split_pattern(x, "\n") for x in (preds, refs)]
        rows = [np.repeat(np.arange(n), np.diff(x.offsets.to_numpy())) for x in lines]
        sides = _both_sides(*(_pieces(x.flatten()) for x in lines), False, split)
        # The words of a row's lines lie side by side.
        sizes = [np.bincount(at, x.sizes, n).astype(np.int64) for at, x in zip(rows, sides)]
        lengths = np.concatenate(sizes)
        grams = _clipped(lengths, sides[0].codes, np.ones(n, np.int64), 2)
        starts = np.cumsum(lengths) - lengths
        whole = [Sequences(sides[0].codes, starts[i * n : (i + 1) * n], sizes[i]) for i in range(2)]
        full = [x.sizes > 0 for x in sides]
        hits, _, _ = _lsum_of(n, *(x.at(np.flatnonzero(f)) for x, f in zip(sides, full)), *(at[f] for at, f in zip(rows, full)))
        return [*grams[:, :6].T, _lcs_lengths(*whole), hits, *sizes]

    names = [f"{side}_{i}" for side in ("match", "pred", "ref") for i in range(2)]

    @F.arrow_udf(", ".join(f"{n} bigint" for n in [*names, "lcs", "lsum", "pred_len", "ref_len"]))
    def count(preds: pa.Array, refs: pa.Array) -> pa.Array:
        one = pa.ListArray.from_arrays(pa.array(np.arange(len(refs) + 1), pa.int32()), refs)
        parts = [kernel(preds.slice(a, b - a), refs.slice(a, b - a)) for a, b in _row_ranges(preds, one, TEXT_PER_CHUNK)]
        columns = [np.concatenate([np.zeros(0, np.int64), *(p[k] for p in parts)]) for k in range(10)]
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], names=[*names, "lcs", "lsum", "pred_len", "ref_len"])

    return count(pred, ref)


class EditTable:
    """Edit distances between ``hyp`` and every prefix of ``ref``, packed in big integers.

    Column ``j`` keeps the vertical differences as bits, so any cell is two bit counts away.
    """

    def __init__(self, hyp: Sequence, ref: Sequence):
        self.hyp, self.ref = hyp, ref
        where: dict = defaultdict(int)
        for i, token in enumerate(hyp):
            where[token] |= 1 << i
        full = (1 << len(hyp)) - 1
        up, down = full, 0
        self.columns = [(up, down)]
        for token in ref:
            same = where.get(token, 0)
            diagonal = ((((same & up) + up) ^ up) | same | down) & full
            right_up = ((down | ~(diagonal | up)) << 1) | 1
            right_down = (up & diagonal) << 1
            up = (right_down | ~(diagonal | right_up)) & full
            down = right_up & diagonal & full
            self.columns.append((up, down))

    def cell(self, i: int, j: int) -> int:
        up, down = self.columns[j]
        mask = (1 << i) - 1
        return j + (up & mask).bit_count() - (down & mask).bit_count()

    @property
    def distance(self) -> int:
        return self.cell(len(self.hyp), len(self.ref))

    def alignment(self) -> tuple[dict[int, int], list[bool], list[bool]]:
        """Hypothesis position of every reference word, and which words of each side are wrong."""
        i, j = len(self.hyp), len(self.ref)
        align, hyp_wrong, ref_wrong = {}, [False] * i, [False] * j
        here = self.distance
        while i or j:
            if i and j:
                same = self.hyp[i - 1] == self.ref[j - 1]
                before = self.cell(i - 1, j - 1)
                if before + (not same) == here:
                    i, j, here = i - 1, j - 1, before
                    align[j] = i
                    hyp_wrong[i] = ref_wrong[j] = not same
                    continue
            if i and self.cell(i - 1, j) + 1 == here:
                i, here = i - 1, here - 1
                hyp_wrong[i] = True
            else:
                j, here = j - 1, here - 1
                align[j] = i - 1
                ref_wrong[j] = True
        return align, hyp_wrong, ref_wrong


class EditSteps:
    """Edit distances between the prefixes of a text and all of ``ref``, a word of the text at a time.

    A state holds the differences along ``ref`` as bits, and the distance to its end.
    """

    def __init__(self, ref: Sequence):
        self.where: dict = defaultdict(int)
        for j, token in enumerate(ref):
            self.where[token] |= 1 << j
        self.full = (1 << len(ref)) - 1
        self.end = 1 << len(ref)
        self.first = (self.full, 0, len(ref))

    def after(self, state: tuple[int, int, int], token) -> tuple[int, int, int]:
        up, down, far = state
        same = self.where.get(token, 0)
        diagonal = ((((same & up) + up) ^ up) | same | down) & self.full
        right_up = ((down | (self.full & ~(diagonal | up))) << 1) | 1
        right_down = (up & diagonal) << 1
        if right_up & self.end:
            far += 1
        if right_down & self.end:
            far -= 1
        return (right_down | ~(diagonal | right_up)) & self.full, right_up & diagonal & self.full, far


def _target(start: int, size: int, to: int) -> int:
    """Where a moved block begins among the other words."""
    return to if to <= start else max(start, to - size) if to > start + size else to


def _moved(words: list, start: int, size: int, to: int) -> list:
    block, rest = words[start : start + size], words[:start] + words[start + size :]
    at = _target(start, size, to)
    return rest[:at] + block + rest[at:]


def _best_move(hyp: list, states: list, steps: EditSteps, tried: set[tuple[int, int, int]], most: int) -> tuple[list | None, int]:
    """The words after the move that saves most edits, null if none does, and how many; of equals the longest, then the first block.

    A move saves at most ``most`` edits, and at most two a word of the block.
    """
    score, best, found = states[-1][2], (0,), None
    for h, size, to in sorted(tried, key=lambda x: (-x[1], x[0], x[2])):
        if (min(2 * size, most), size, -h, -to) <= best:
            continue
        words, at = _moved(hyp, h, size, to), _target(h, size, to)
        # Words before the move are those of ``hyp``; where the states meet again behind it, nothing is saved.
        begin, end = min(h, at), max(h, at) + size
        state = states[begin]
        for i in range(begin, len(words)):
            state = steps.after(state, words[i])
            if i + 1 >= end and state == states[i + 1]:
                state = states[-1]
                break
        rank = (score - state[2], size, -h, -to)
        if rank[0] > 0 and rank > best:
            best, found = rank, words
    return found, best[0]


def edit_rate(hyp: list, ref: list) -> tuple[int, int]:
    """Word edits including block shifts chosen greedily, and the reference length."""
    if not ref:
        return len(hyp), 0
    places: dict = defaultdict(list)
    for j, token in enumerate(ref):
        places[token].append(j)
    # Moves keep the words, so this many edits stay.
    least = max(len(hyp), len(ref)) - (Counter(hyp) & Counter(ref)).total()
    steps, shifts, trials = EditSteps(ref), 0, 0
    while True:
        states = [steps.first]
        for token in hyp:
            states.append(steps.after(states[-1], token))
        score = states[-1][2]
        if score == least:
            return shifts + score, len(ref)
        align, hyp_wrong, ref_wrong = EditTable(hyp, ref).alignment()
        tried = set()
        for h, r, size in _matching_blocks(hyp, ref, places, hyp_wrong, ref_wrong):
            if h <= align[r] < h + size:
                continue
            last = -1
            for k in range(r - 1, r + size):
                to = 0 if k < 0 else align[k] + 1
                if to == last:
                    continue
                last = to
                tried.add((h, size, to))
                trials += 1
            # With too many trials no move of this round counts.
            if trials >= MAX_SHIFT_TRIALS:
                return shifts + score, len(ref)
        best, saved = _best_move(hyp, states, steps, tried, score - least)
        if best is None:
            return shifts + score, len(ref)
        shifts += 1
        if score - saved == least:
            return shifts + least, len(ref)
        hyp = best


def _next_true(flags: list[bool]) -> list[int]:
    """For every place the first true one from it on."""
    out, last = [0] * len(flags), len(flags) + MAX_SHIFT_SIZE
    for i in range(len(flags) - 1, -1, -1):
        if flags[i]:
            last = i
        out[i] = last
    return out


def _matching_blocks(hyp: list, ref: list, places: dict, hyp_wrong: list[bool], ref_wrong: list[bool]):
    """Equal blocks of both sides that start near each other and hold wrong words of both, shorter ones first."""
    next_h, next_r = _next_true(hyp_wrong), _next_true(ref_wrong)
    for h in range(len(hyp)):
        if next_h[h] - h >= MAX_SHIFT_SIZE:
            continue
        near = places.get(hyp[h], ())
        for r in near[bisect_left(near, h - MAX_SHIFT_DISTANCE) : bisect_right(near, h + MAX_SHIFT_DISTANCE)]:
            least = max(next_h[h] - h, next_r[r] - r) + 1
            for size in range(1, MAX_SHIFT_SIZE + 1):
                if h + size > len(hyp) or r + size > len(ref):
                    break
                if hyp[h + size - 1] != ref[r + size - 1]:
                    break
                if size >= least:
                    yield h, r, size


def edit_counts(pred: Column, ref: Column, split: Split) -> Column:
    """``edits`` and ``ref_len`` of the edit rate; words are what ``split`` makes of a text's pieces between blanks."""

    def kernel(preds, refs):
        a, b = _both_sides(preds, refs, False, split)
        edits = _distances(a, b)
        # Moves keep the words: where the distance is what these leave, no move saves an edit.
        (row_a, _, code_a), (row_b, _, code_b) = a.units(), b.units()
        most = int(max(code_a.max(initial=0), code_b.max(initial=0))) + 1
        ids, found = pd.factorize(np.concatenate([row_a * most + code_a, row_b * most + code_b]))
        shared = np.minimum(*(np.bincount(x, minlength=len(found)) for x in (ids[: len(row_a)], ids[len(row_a) :])))
        least = np.maximum(a.sizes, b.sizes) - np.bincount(found // most, shared, len(edits)).astype(np.int64)
        for i in np.flatnonzero((edits > least) & (b.sizes > 0)).tolist():
            edits[i] = edit_rate(a.one(i), b.one(i))[0]
        return edits, b.sizes

    return _pairs(kernel, ["edits", "ref_len"], _pieces)(pred, ref)


def meteor_score(hyp: list, ref: list, synonyms: dict[str, set[str]] | None = None) -> float:
    """Exact, stem, then synonym matches, each taken from the end; fewer chunks score higher."""
    left_h, left_r = dict(enumerate(hyp)), dict(enumerate(ref))
    pairs: list[tuple[int, int]] = []

    def match(key_h: Callable[[str], Iterable[str]], key_r: Callable[[str], str]) -> None:
        places: dict = defaultdict(list)
        for j in sorted(left_r):
            places[key_r(left_r[j])].append(j)
        for i in sorted(left_h, reverse=True):
            options = [places[k] for k in key_h(left_h[i]) if places.get(k)]
            if options:
                j = max(options, key=lambda o: o[-1]).pop()
                pairs.append((i, j))
                del left_h[i], left_r[j]

    match(lambda w: (w,), lambda w: w)
    match(lambda w: (stem(w),), stem)
    if synonyms:
        match(lambda w: {w} | synonyms.get(w, set()), lambda w: w)
    if not pairs:
        return 0.0
    pairs.sort()
    chunks = 1 + sum(
        (i2 - i1, j2 - j1) != (1, 1) for (i1, j1), (i2, j2) in zip(pairs, pairs[1:])
    )
    precision, recall = len(pairs) / len(hyp), len(pairs) / len(ref)
    mean = precision * recall / (METEOR_ALPHA * precision + (1 - METEOR_ALPHA) * recall)
    return mean * (1 - METEOR_GAMMA * (chunks / len(pairs)) ** METEOR_BETA)


def _matched_from_end(
    row_h: np.ndarray, key_h: np.ndarray, row_r: np.ndarray, key_r: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Units of both sides that belong together: a row's k-th last unit of a key with the other side's k-th last.

    Units come row by row, in order.
    """
    most = int(max(key_h.max(initial=0), key_r.max(initial=0))) + 1
    ids, found = pd.factorize(np.concatenate([row_h * most + key_h, row_r * most + key_r]))
    sides = []
    for x in (ids[: len(row_h)], ids[len(row_h) :]):
        order = np.argsort(x, kind="stable")[::-1]
        counts = np.bincount(x, minlength=len(found))
        sides.append((order, counts))
    both = np.minimum(sides[0][1], sides[1][1])
    out = []
    for order, counts in sides:
        sizes = counts[::-1]
        group, nth = _places(sizes)
        out.append(order[nth < both[::-1][group]])
    return out[0], out[1]


def _meteor_scores(preds: pa.Array, refs: pa.Array, split: Split | None = None) -> np.ndarray:
    """``meteor_score`` of all rows of token lists (with ``split`` of lists of pieces), without synonyms."""
    n = len(preds)
    sizes, codes, words = _coded([preds, refs], split)
    n_hyp, n_ref = sizes[:n], sizes[n:]
    (row_h, at_h), (row_r, at_r) = _places(n_hyp), _places(n_ref)
    code_h, code_r = codes[: len(row_h)], codes[len(row_h) :]
    h, r = _matched_from_end(row_h, code_h, row_r, code_r)
    left_h, left_r = np.ones(len(row_h), bool), np.ones(len(row_r), bool)
    left_h[h], left_r[r] = False, False
    # Stems can match only in rows that have words left on both sides.
    open_rows = (np.bincount(row_h[left_h], minlength=n) > 0) & (np.bincount(row_r[left_r], minlength=n) > 0)
    left_h, left_r = np.flatnonzero(left_h & open_rows[row_h]), np.flatnonzero(left_r & open_rows[row_r])
    used, code = np.unique(np.concatenate([code_h[left_h], code_r[left_r]]), return_inverse=True)
    found = [stem(w) for w in words.take(pa.array(used)).to_pylist()]
    stems = pd.factorize(np.array(found, dtype=object))[0].astype(np.int64)[code]
    more_h, more_r = _matched_from_end(row_h[left_h], stems[: len(left_h)], row_r[left_r], stems[len(left_h) :])
    h, r = np.concatenate([h, left_h[more_h]]), np.concatenate([r, left_r[more_r]])
    order = np.argsort(h)
    h, r = h[order], r[order]
    pairs = np.bincount(row_h[h], minlength=n)
    onward = (np.diff(row_h[h]) == 0) & (np.diff(at_h[h]) == 1) & (np.diff(at_r[r]) == 1)
    chunks = pairs - np.bincount(row_h[h][1:][onward], minlength=n)
    out = np.zeros(n)
    some = np.flatnonzero(pairs)
    precision, recall = pairs[some] / n_hyp[some], pairs[some] / n_ref[some]
    mean = precision * recall / (METEOR_ALPHA * precision + (1 - METEOR_ALPHA) * recall)
    parts = np.array([x**METEOR_BETA for x in (chunks[some] / pairs[some]).tolist()])
    out[some] = mean * (1 - METEOR_GAMMA * parts)
    return out


def meteor(
    pred: Column, ref: Column, synonyms: dict[str, set[str]] | None = None, split: Split | None = None
) -> Column:
    """``meteor_score`` of token arrays, or, without synonyms, of texts: then tokens are what ``split`` makes of them."""

    @F.arrow_udf("double")
    def score(preds: pa.Array, refs: pa.Array) -> pa.Array:
        if not synonyms:
            lists = (preds, refs) if split is None else (_pieces(preds), _pieces(refs))
            parts = [_meteor_scores(a, b, split) for a, b in _list_ranges(*lists)]
            return pa.array(np.concatenate([np.zeros(0), *parts]), pa.float64())
        rows = zip(preds.to_pylist(), refs.to_pylist())
        return pa.array([meteor_score(p, r, synonyms) for p, r in rows], pa.float64())

    return score(pred, ref)


# Cosines held at a time.
COSINES = 1 << 20


def greedy_cosine(pred: Column, ref: Column) -> Column:
    """``precision``, ``recall``, ``f1`` of best cosine matches between two arrays of vectors."""

    @F.pandas_udf("precision double, recall double, f1 double")
    def score(preds: pd.Series, refs: pd.Series) -> pd.DataFrame:
        rows = []
        for p, r in zip(preds, refs):
            if p is None or r is None or len(p) == 0 or len(r) == 0:
                rows.append((0.0, 0.0, 0.0))
                continue
            a, b = (np.stack([np.asarray(v, dtype=np.float64) for v in m]) for m in (p, r))
            a /= np.linalg.norm(a, axis=1, keepdims=True)
            b /= np.linalg.norm(b, axis=1, keepdims=True)
            # A block of rows at a time; only the best match of each row and column is kept.
            step, rows_best, best = max(1, COSINES // len(b)), 0.0, np.full(len(b), -np.inf)
            for at in range(0, len(a), step):
                near = a[at : at + step] @ b.T
                rows_best += near.max(axis=1).sum()
                np.maximum(best, near.max(axis=0), out=best)
            prec, rec = rows_best / len(a), best.mean()
            rows.append((prec, rec, 2 * prec * rec / (prec + rec) if prec + rec else 0.0))
        return pd.DataFrame(rows, columns=["precision", "recall", "f1"])

    return score(pred, ref)
