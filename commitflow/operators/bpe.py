"""Byte-level pair encoding (K5): trained over the distinct-word table, many merges a round.

A round counts the pairs of all words and calls the most frequent ones live. A pair that is not live cannot take part in
a merge while the best count is at least that of the last live pair: what a merge makes is no more frequent than the pair
it stands on. So words fall apart between their live runs, and equal runs are counted together: the driver trains on the
distinct runs of the whole corpus, with exact counts, until the best one is below that of the last live pair. Tasks then
make a round's merges in the distinct runs of their words and put the results back. How many pairs are live decides how
many merges a round settles, never which ones.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

# Fixed value: how text is cut into words before byte pairs are counted.
WORD = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
SPECIAL_TOKENS = ("<pad>", "<s>", "</s>", "<unk>", "<mask>")
#: Distinct runs that the driver trains on at a time; with more, fewer pairs are live.
SAMPLE_WORDS = 400_000
#: Pairs that are live in a round at most, and in the first round.
MOST_AHEAD, LEAST_AHEAD = 2048, 16
#: Settled merges, or rounds, after which the words are written anew.
REWRITE_AFTER, REWRITE_ROUNDS = 1024, 3
#: Symbols that a task works on at a time, and bytes of text whose words it counts together.
CHUNK_SYMBOLS, CHUNK_BYTES = 1 << 22, 1 << 23
#: Kinds of characters, as WORD tells them apart.
OTHER, BLANK, LETTER, NUMBER = range(4)
#: Characters that an entry of a fixed length is looked for in before the whole text.
HEADS = (8, 64)
Merge = tuple[int, int, int]
#: Live pairs of a round, as codes, and its merges.
Round = tuple[np.ndarray, list[Merge]]


def pre_words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def character_kinds(spark: SparkSession) -> np.ndarray:
    """The kind of every code point, asked of the JVM's regexes, which cut the texts elsewhere."""
    regex = spark.sparkContext._jvm.java.util.regex.Pattern
    points = np.delete(np.arange(0x110000), np.s_[0xD800:0xE000])
    text = "".join(map(chr, points.tolist()))
    # A character for each, which the next ones leave alone.
    for sign, mark in ((r"\p{L}", "L"), (r"\p{N}", "0"), (r"\s", " "), (r"[^L0 ]", "-")):
        text = regex.compile(sign).matcher(text).replaceAll(mark)
    marks = np.frombuffer(text.encode(), np.uint8)
    kinds = np.full(0x110000, OTHER, np.uint8)
    for mark, kind in (("L", LETTER), ("0", NUMBER), (" ", BLANK)):
        kinds[points[marks == ord(mark)]] = kind
    return kinds


def word_starts(points: np.ndarray, firsts: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where the matches of WORD begin in the code points of texts set end to end, whose first ones are ``firsts``.

    Every character is part of a match.
    """
    n = len(points)
    kind = kinds[points]
    apart = np.zeros(n + 1, bool)
    apart[firsts] = apart[n] = True
    begins = apart.copy()
    begins[1:n] |= kind[1:] != kind[:-1]
    # The last blank in front of something else stands alone; a space goes with what follows.
    last = np.flatnonzero((kind[: n - 1] == BLANK) & begins[1:n] & ~apart[1:n])
    begins[last] = True
    begins[last[points[last] == ord(" ")] + 1] = False
    quotes = np.flatnonzero((points[: n - 1] == ord("'")) & begins[: n - 1] & begins[1:n] & ~apart[1:n])
    one = points[quotes + 1]
    more = np.where(apart[np.minimum(quotes + 2, n)], 0, points[np.minimum(quotes + 2, n - 1)])
    sizes = 2 * np.isin(one, [ord(c) for c in "stmd"])
    for a, b in ("re", "ve", "ll"):
        sizes[(one == ord(a)) & (more == ord(b))] = 3
    quotes, sizes = quotes[sizes > 0], sizes[sizes > 0]
    begins[quotes + 1] = False
    begins[quotes + sizes] = True
    return np.flatnonzero(begins[:n])


def _flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of binary or text values; nulls are left out."""
    array = array.drop_null().cast(pa.binary())
    if not len(array):
        return np.zeros(1, np.int32), np.zeros(0, np.uint8)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int32)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data


def _binaries(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _words_of(texts: pa.Array, kinds: np.ndarray) -> pa.Array:
    offsets, data = _flat(texts)
    if not len(data):
        return pa.array([], pa.binary())
    if data.max() < 128:
        places, points = None, data
    else:
        try:
            text = data.tobytes().decode()
        except UnicodeDecodeError:
            # As in the JVM, what is no UTF-8 is a replacement character.
            values = [t.decode("utf-8", "replace") for t in texts.drop_null().cast(pa.binary()).to_pylist()]
            offsets, data = _flat(pa.array(values, pa.string()))
            text = "".join(values)
        places, points = np.flatnonzero((data & 0xC0) != 0x80), np.frombuffer(text.encode("utf-32-le"), np.uint32)
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    starts = word_starts(points, firsts if places is None else np.searchsorted(places, firsts), kinds)
    return _binaries(np.append(starts if places is None else places[starts], len(data)), data)


def word_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct words of all columns with counts; a word's symbols are 32-bit numbers, at first those of its bytes."""
    spark = df.sparkSession
    kinds = spark.sparkContext.broadcast(character_kinds(spark))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _blocks_of_text(batches):
            found = _words_of(texts, kinds.value).value_counts()
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "n"])

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = _flat(batch["word"])
            symbols = _binaries(4 * offsets, data.astype("<i4").view(np.uint8))
            yield pa.RecordBatch.from_arrays([symbols, batch["n"]], ["symbols", "n"])

    texts = df.select(*[F.col(c).cast("string") for c in cols])
    counted = texts.mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.mapInArrow(widen, "symbols binary, n bigint")


def _blocks_of_text(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Array]:
    """The texts of all columns, so many at a time that they are worth counting together."""
    held, size = [], 0
    for batch in batches:
        for column in batch.columns:
            # A batch of long texts is taken in parts.
            step = max(1, len(column) * CHUNK_BYTES // max(1, column.nbytes))
            for at in range(0, len(column), step):
                held.append(column.slice(at, step).cast(pa.binary()))
                size += held[-1].nbytes
                if size >= CHUNK_BYTES:
                    yield pa.concat_arrays(held)
                    held, size = [], 0
    if held:
        yield pa.concat_arrays(held)


class WordSymbols:
    """Words as runs of one symbol array, with an index from pairs to the words that hold or held them."""

    def __init__(self, words: Sequence[bytes] | pa.Array, counts: Sequence[int]) -> None:
        offsets, data = _flat(words if isinstance(words, pa.Array) else pa.array(words, pa.binary()))
        self.sizes = np.diff(offsets).astype(np.int64) // 4
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.symbols = data.view("<i4").astype(np.int64)
        self.counts = np.asarray(counts, np.int64)
        self._index: dict[int, list[np.ndarray]] = {}
        codes, owners = self._pairs(*self._gather(np.arange(len(self.sizes))))
        self.first_changes = _summed(codes, self.counts[owners])
        self._file(codes, owners)

    def _gather(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of some words, end to end, and whose each is."""
        sizes = self.sizes[words]
        owners = np.repeat(words, sizes)
        places = np.arange(len(owners)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.starts[words], sizes)
        return self.symbols[places], owners

    @staticmethod
    def _pairs(symbols: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = owners[1:] == owners[:-1]
        return ((symbols[:-1] << 32) | symbols[1:])[inside], owners[1:][inside]

    def _file(self, codes: np.ndarray, owners: np.ndarray) -> None:
        order = np.lexsort((owners, codes))
        codes, owners = codes[order], owners[order]
        new = np.ones(len(codes), bool)
        new[1:] = (codes[1:] != codes[:-1]) | (owners[1:] != owners[:-1])
        codes, owners = codes[new], owners[new]
        cuts = np.flatnonzero(np.diff(codes, prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(codes)]):
            self._index.setdefault(int(codes[a]), []).append(owners[a:b])

    def merge(self, a: int, b: int, to: int, changes: bool = True) -> tuple[np.ndarray, np.ndarray] | None:
        """Replace the pair left to right; (pair, change of its count) where asked for."""
        held = self._index.pop((a << 32) | b, None)
        if held is None:
            return None
        symbols, owners = self._gather(np.unique(np.concatenate(held)))
        at = np.flatnonzero((symbols[:-1] == a) & (symbols[1:] == b) & (owners[1:] == owners[:-1]))
        if a == b and len(at):
            # In a run of equal symbols every second place begins a pair.
            runs = np.concatenate([[True], np.diff(at) > 1])
            first = at[runs][np.cumsum(runs) - 1]
            at = at[(at - first) % 2 == 0]
        if not len(at):
            return None
        # Words that held the pair once need not any more.
        touched = np.isin(owners, owners[at])
        place = np.cumsum(touched) - 1
        symbols, owners, at = symbols[touched], owners[touched], place[at]
        before, whose = self._pairs(symbols, owners)
        left = np.ones(len(symbols), bool)
        left[at + 1] = False
        symbols[at] = to
        symbols, owners = symbols[left], owners[left]
        words, sizes = np.unique(owners, return_counts=True)
        self.sizes[words] = sizes
        places = np.arange(len(owners)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.starts[words], sizes)
        self.symbols[places] = symbols
        after, holders = self._pairs(symbols, owners)
        new = (after >> 32 == to) | (after & 0xFFFFFFFF == to)
        self._file(after[new], holders[new])
        if changes:
            return _summed(np.concatenate([before, after]), np.concatenate([-self.counts[whose], self.counts[holders]]))
        return None

    def words(self) -> list[bytes]:
        flat = self.symbols.astype("<i4")
        return [flat[s : s + n].tobytes() for s, n in zip(self.starts.tolist(), self.sizes.tolist())]


def _summed(codes: np.ndarray, amounts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs with the sum of their amounts, zeros left out."""
    encoded = pa.array(codes).dictionary_encode()
    found = encoded.dictionary.to_numpy()
    sums = np.zeros(len(found), np.int64)
    np.add.at(sums, encoded.indices.to_numpy(), amounts)
    return found[sums != 0], sums[sums != 0]


def _listed(changes: tuple[np.ndarray, np.ndarray] | None) -> list[tuple[int, int]]:
    return [] if changes is None else list(zip(changes[0].tolist(), changes[1].tolist()))


class FlatWords:
    """Words as one symbol array, without an index: for merges that few distinct runs take part in."""

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> None:
        self.symbols, self.sizes, self.counts = symbols, sizes, counts

    def _lasts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - 1

    def pair_counts(self) -> tuple[np.ndarray, np.ndarray]:
        inside = np.ones(len(self.symbols), bool)
        inside[self._lasts()] = False
        at = np.flatnonzero(inside)
        codes = (self.symbols[at].astype(np.int64) << 32) | self.symbols[at + 1]
        return _summed(codes, np.repeat(self.counts, self.sizes - 1))

    def runs(self, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Where the runs of live pairs begin, how long they are, and the runs themselves."""
        # Entry i + 1 of ``held``: symbol i and the next one are a live pair of one word.
        held = np.zeros(len(self.symbols) + 1, bool)
        held[1:-1] = self._live(live)
        held[self._lasts() + 1] = False
        begins = np.flatnonzero(held[1:] & ~held[:-1])
        sizes = np.flatnonzero(held[:-1] & ~held[1:]) - begins + 1
        symbols = self.symbols[held[1:] | held[:-1]]
        return begins, sizes, _binaries(4 * np.append(0, np.cumsum(sizes)), symbols.astype("<i4").view(np.uint8))

    def _live(self, live: np.ndarray) -> np.ndarray:
        """Whether neighbouring symbols are a live pair, ends of words not looked at."""
        most = int(self.symbols.max(initial=0)) + 1
        lefts, rights = np.unique(live >> 32), np.unique(live & 0xFFFFFFFF)
        if len(lefts) * len(rights) > CHUNK_SYMBOLS:
            return np.isin((self.symbols[:-1].astype(np.int64) << 32) | self.symbols[1:], live)
        table = np.zeros((len(lefts) + 1, len(rights) + 1), bool)
        table[np.searchsorted(lefts, live >> 32), np.searchsorted(rights, live & 0xFFFFFFFF)] = True
        left, right = np.full(most, len(lefts), np.int32), np.full(most, len(rights), np.int32)
        left[lefts[lefts < most]] = np.flatnonzero(lefts < most)
        right[rights[rights < most]] = np.flatnonzero(rights < most)
        return table.ravel()[left[self.symbols[:-1]] * (len(rights) + 1) + right[self.symbols[1:]]]

    def apply(self, live: np.ndarray, merges: Sequence[Merge]) -> None:
        """Make a round's merges: in each distinct run once."""
        begins, sizes, runs = self.runs(live)
        if not len(begins):
            return
        runs = runs.dictionary_encode()
        which = runs.indices.to_numpy(zero_copy_only=False)
        distinct = WordSymbols(runs.dictionary, np.ones(len(runs.dictionary), np.int64))
        for merge in merges:
            distinct.merge(*merge, changes=False)
        now = distinct.sizes[which]
        symbols, _ = distinct._gather(which)
        inside = np.arange(len(symbols)) - np.repeat(np.cumsum(now) - now, now)
        self.symbols[np.repeat(begins, now) + inside] = symbols
        gone = sizes - now
        left = np.ones(len(self.symbols), bool)
        inside = np.arange(gone.sum()) - np.repeat(np.cumsum(gone) - gone, gone)
        left[np.repeat(begins + now, gone) + inside] = False
        self.sizes = np.add.reduceat(left, self._lasts() - self.sizes + 1, dtype=np.int64)
        self.symbols = self.symbols[left]


def _chunks(batches: Iterable[pa.RecordBatch], settled: Sequence[Round]) -> Iterator[FlatWords]:
    """The words, some at a time, behind the settled merges."""
    held, size = [], 0

    def chunk() -> FlatWords:
        symbols = np.concatenate([data for _, data, _ in held]).view("<i4").astype(np.int32)
        sizes, counts = (np.concatenate(x) for x in list(zip(*[(s, n) for s, _, n in held])))
        words = FlatWords(symbols, sizes, counts)
        for live, merges in settled:
            words.apply(live, merges)
        return words

    for batch in batches:
        offsets, data = _flat(batch["symbols"])
        if not len(data):
            continue
        held.append((np.diff(offsets).astype(np.int64) // 4, data, batch["n"].to_numpy()))
        size += len(data) // 4
        if size >= CHUNK_SYMBOLS:
            yield chunk()
            held, size = [], 0
    if held:
        yield chunk()


def pair_counts(words: DataFrame, settled: Sequence[Round]) -> DataFrame:
    """(a, b, n): the pairs of all words behind the settled merges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, settled):
            codes, sums = chunk.pair_counts()
            columns = [(codes >> 32).astype(np.int32), (codes & 0xFFFFFFFF).astype(np.int32), sums]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "n"])

    return words.mapInArrow(run, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


def live_runs(words: DataFrame, settled: Sequence[Round], live: np.ndarray) -> DataFrame:
    """(symbols, n): the distinct runs of live pairs behind the settled merges, with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, settled):
            begins, _, runs = chunk.runs(live)
            runs = runs.dictionary_encode()
            of = np.repeat(chunk.counts, chunk.sizes)[begins]
            sums = np.zeros(len(runs.dictionary), np.int64)
            np.add.at(sums, runs.indices.to_numpy(zero_copy_only=False), of)
            yield pa.RecordBatch.from_arrays([runs.dictionary, pa.array(sums)], ["symbols", "n"])

    return words.mapInArrow(run, "symbols binary, n bigint").groupBy("symbols").agg(F.sum("n").alias("n"))


def apply_merges(words: DataFrame, settled: Sequence[Round]) -> DataFrame:
    """The words behind the settled merges; those that are one symbol by then hold no pair and are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, settled):
            many = chunk.sizes > 1
            symbols, sizes = chunk.symbols[np.repeat(many, chunk.sizes)], chunk.sizes[many]
            data = _binaries(4 * np.append(0, np.cumsum(sizes)), symbols.astype("<i4").view(np.uint8))
            yield pa.RecordBatch.from_arrays([data, pa.array(chunk.counts[many])], ["symbols", "n"])

    return words.mapInArrow(run, "symbols binary, n bigint")


class _Counts:
    """Pair counts, and the most frequent pair; equal counts are settled by the pair's hex texts."""

    def __init__(self, texts: list[str]) -> None:
        self.texts, self.of, self._heap = texts, {}, []

    def add(self, pair: tuple[int, int], change: float) -> None:
        n = self.of.get(pair, 0) + change
        self.of[pair] = n
        if n > 0:
            heapq.heappush(self._heap, (-n, self.texts[pair[0]], self.texts[pair[1]], pair))

    def top(self) -> tuple[tuple[int, int], float] | None:
        while self._heap:
            n, _, _, pair = self._heap[0]
            if self.of.get(pair) == -n:
                return pair, -n
            heapq.heappop(self._heap)
        return None


class _Symbols:
    """Numbers of symbols by their hex text: bytes first, then what merges make."""

    def __init__(self) -> None:
        self.texts = [f"{b:02x}" for b in range(256)]
        self._known = {t: i for i, t in enumerate(self.texts)}

    def joined(self, pair: tuple[int, int]) -> int:
        return self.of(self.texts[pair[0]] + self.texts[pair[1]])

    def of(self, text: str) -> int:
        if text not in self._known:
            self._known[text] = len(self.texts)
            self.texts.append(text)
        return self._known[text]


def _played(runs: WordSymbols, symbols: _Symbols, least: int, more: Callable[[Merge], bool]) -> list[Merge]:
    """The merges that follow, as long as the best count is at least ``least`` and ``more``, told of each, wants another.

    A round ends at a merge whose symbol there was before: its pairs stand on more than one pair of the round's beginning.
    """
    counts = _Counts(symbols.texts)
    for code, n in _listed(runs.first_changes):
        counts.add((code >> 32, code & 0xFFFFFFFF), n)
    out: list[Merge] = []
    while (best := counts.top()) and best[1] >= least:
        known = len(symbols.texts)
        merge = (*best[0], symbols.joined(best[0]))
        out.append(merge)
        if not more(merge) or merge[2] < known:
            break
        for code, change in _listed(runs.merge(*merge)):
            counts.add((code >> 32, code & 0xFFFFFFFF), change)
    return out


def train_bpe(
    df: DataFrame,
    cols: Sequence[str],
    vocab_size: int = 3000,
    min_count: int = 1,
    specials: Sequence[str] = SPECIAL_TOKENS,
) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """Vocabulary (specials, bytes, merges; hex symbols) and the merge list, as one-by-one training gives them.

    Equal counts are settled by the hex text of the pair. Training stops at ``vocab_size`` or when no pair is left
    (or none of at least ``min_count``).
    """
    spark = df.sparkSession

    def kept(table: DataFrame) -> DataFrame:
        path = scratch_path(spark, "byte-pairs")
        table.write.parquet(path)
        return spark.read.schema("symbols binary, n bigint").parquet(path)

    words = kept(word_table(df, cols))
    symbols = _Symbols()

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(256, bool)
        for batch in batches:
            seen[_flat(batch["symbols"])[1].view("<i4")] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen).astype(np.int32))], ["s"])

    alphabet = sorted(r["s"] for r in words.mapInArrow(single, "s int").distinct().collect())
    vocab = {t: i for i, t in enumerate([*specials, *(symbols.texts[s] for s in alphabet)])}
    merges: list[tuple[str, str]] = []

    def more(merge: Merge) -> bool:
        merges.append((symbols.texts[merge[0]], symbols.texts[merge[1]]))
        vocab.setdefault(symbols.texts[merge[2]], len(vocab))
        return len(vocab) < vocab_size

    settled: list[Round] = []
    ahead = LEAST_AHEAD
    while len(vocab) < vocab_size:
        pairs = pair_counts(words, settled).toArrow()
        codes = (pairs["a"].to_numpy().astype(np.int64) << 32) | pairs["b"].to_numpy()
        n = pairs["n"].to_numpy()
        if not len(n) or n.max() < max(min_count, 1):
            break
        ranked = np.sort(n)[::-1]
        while True:
            # With all pairs live, none is left that could come in between.
            least = max(min_count, 1, int(ranked[ahead - 1]) if ahead < len(ranked) else 1)
            live = codes[n >= least]
            found = live_runs(words, settled, live).limit(SAMPLE_WORDS + 1).toArrow()
            if len(found) <= SAMPLE_WORDS or least == ranked[0]:
                break
            ahead = min(ahead, int((ranked > least).sum()), max(1, ahead // 4))
        if len(found) <= SAMPLE_WORDS:
            runs = WordSymbols(found["symbols"].combine_chunks(), found["n"].to_numpy())
            made = _played(runs, symbols, least, more)
            if 2 * len(found) <= SAMPLE_WORDS:
                ahead = min(MOST_AHEAD, 2 * ahead)
        else:
            # Too many runs even of the pairs with the best count: the first of them alone.
            a, b = min(((c >> 32, c & 0xFFFFFFFF) for c in live.tolist()), key=lambda p: (symbols.texts[p[0]], symbols.texts[p[1]]))
            made = [(a, b, symbols.joined((a, b)))]
            more(made[0])
            live = np.array([(a << 32) | b])
        settled.append((live, made))
        if sum(len(made) for _, made in settled) >= REWRITE_AFTER or len(settled) >= REWRITE_ROUNDS:
            words, settled = kept(apply_merges(words, settled)), []
    return vocab, merges


class WordEncoder:
    """Ids of words: their pairs are merged in the order of training, all words side by side."""

    def __init__(self, vocab: dict[str, int], merges: Sequence[tuple[str, str]], unk: int) -> None:
        number = _Symbols()
        pairs = {(number.of(a), number.of(b)): rank for rank, (a, b) in enumerate(merges)}
        self.size = 1 << 32
        found = sorted((a * self.size + b, rank, number.joined((a, b))) for (a, b), rank in pairs.items())
        self.codes, self.ranks, made = (np.array(x, np.int64) for x in (zip(*found) if found else ([], [], [])))
        self.last = len(merges)
        self.made = np.zeros(self.last + 1, np.int64)
        self.made[self.ranks] = made
        self.ids = np.array([vocab.get(t, unk) for t in number.texts], np.int32)

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words end to end, and how many each has."""
        offsets, data = _flat(words)
        symbols, sizes, names = data.astype(np.int64), np.diff(offsets).astype(np.int64), np.arange(len(offsets) - 1)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(names) and len(self.codes):
            ends = np.cumsum(sizes)
            ranks = np.full(len(symbols), self.last)
            codes = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            ranks[:-1] = np.where(self.codes[at] == codes, self.ranks[at], self.last)
            ranks[ends - 1] = self.last
            best = np.minimum.reduceat(ranks, ends - sizes)
            going = best < self.last
            here = np.repeat(going, sizes)
            done.append((names[~going], sizes[~going], symbols[~here]))
            names, sizes, best, symbols, ranks = names[going], sizes[going], best[going], symbols[here], ranks[here]
            hits = np.flatnonzero(ranks == np.repeat(best, sizes))
            if not len(hits):
                break
            # In a run of equal symbols every second place begins a pair.
            first = np.concatenate([[True], np.diff(hits) > 1])
            hits = hits[(hits - hits[first][np.cumsum(first) - 1]) % 2 == 0]
            symbols[hits] = self.made[ranks[hits]]
            left = np.ones(len(symbols), bool)
            left[hits + 1] = False
            sizes = np.add.reduceat(left, np.cumsum(sizes) - sizes, dtype=np.int64)
            symbols = symbols[left]
        done.append((names, sizes, symbols))
        names, sizes, symbols = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(names)
        places = _spread((np.cumsum(sizes) - sizes)[order], sizes[order])
        return self.ids[symbols[places]], sizes[order]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs with these starts and sizes, end to end."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - starts, sizes)


def encode_fixed(
    df: DataFrame,
    col: str,
    vocab: dict[str, int],
    merges: Sequence[tuple[str, str]],
    length: int,
    name: str = "input_ids",
    pad: str = "<pad>",
    bos: str = "<s>",
    eos: str = "</s>",
    unk: str = "<unk>",
) -> DataFrame:
    """Ids of ``<s> text </s>``, cut or padded to ``length``.

    The vocabulary has at most ``vocab_size`` entries; each task merges a distinct word once.
    """
    model = df.sparkSession.sparkContext.broadcast((vocab, list(merges)))
    held: list[WordEncoder] = []

    @F.arrow_udf("array<int>")
    def encode(words: pa.Array) -> pa.Array:
        if words.null_count:
            raise TypeError("a text is null")
        ids_of = model.value[0]
        if not held:
            held.append(WordEncoder(*model.value, ids_of[unk]))
        distinct = words.flatten().dictionary_encode()
        ids, sizes = held[0].encode(distinct.dictionary)
        which = distinct.indices.to_numpy(zero_copy_only=False)
        each = sizes[which]
        ids = ids[_spread((np.cumsum(sizes) - sizes)[which], each)]
        # Ids of every row, from those of its words.
        ends = np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))
        upto = np.concatenate([[0], np.cumsum(each)])[ends]
        counts = np.diff(upto, prepend=0)
        out = np.full((len(words), max(length, 0) + 1), ids_of[pad], np.int32)
        out[:, 0] = ids_of[bos]
        rows, places = np.repeat(np.arange(len(words)), counts), _spread(np.ones(len(words), np.int64), counts)
        seen = places < out.shape[1]
        out[rows[seen], places[seen]] = ids[seen]
        out[np.arange(len(words)), np.minimum(counts + 1, out.shape[1] - 1)] = ids_of[eos]
        out = out[:, : max(length, 0)]
        return pa.ListArray.from_arrays(np.arange(len(words) + 1, dtype=np.int32) * out.shape[1], pa.array(out.ravel()))

    # A word has one id at least: words behind the cut do not leave the JVM. Where two more words follow in the
    # head of a text, its first ones are those of the whole text.
    text, most = F.col(col), max(length, 1)
    words = pre_words(F.substring(text, 1, HEADS[0] * most))
    for size, longer in zip(HEADS, (*HEADS[1:], None)):
        df = df.withColumn("__head", words)
        enough = (F.length(text) <= size * most) | (F.size("__head") >= most + 2)
        words = F.when(enough, F.col("__head")).otherwise(pre_words(F.substring(text, 1, longer * most) if longer else text))
    return df.withColumn(name, encode(F.slice(words, 1, most))).drop("__head")
