"""Phrase collocations by dynamic itemset counting, and their scores per language.

The corpus is dealt into shards, written once. A step scans one shard, round and round. Words count from the first
step on; a phrase becomes active at the boundary after which both its subphrases (all words but the last, all but the first)
have reached the threshold, counts in the scans it shares with words and with phrases of other lengths, and is finished
after one full cycle of shards. The job ends when nothing is active.

While counting, a phrase is a 48-bit key. A task reduces a chunk of texts to sorted distinct keys with counts, packed
per bucket of the key space as differences; buckets are merged with those of the steps before, so no phrase,
however common, is more than one entry a chunk. How much a bucket holds is set by the size of the corpus. What has
reached the threshold, and at which boundary, is a table of bytes for each length, ``PLACES`` places a key: that is all that
is sent to the tasks. It grows with the corpus up to ``MOST_SLOTS`` bytes. Where places are shared, a phrase is activated without
need, never too late, and counts stay true. A last scan spells out the phrases whose keys reached the threshold and counts them by
their texts, so keys that coincide change nothing.

Texts are lower-cased (A-Z) and split into pieces, pieces into words; phrases lie inside a piece. A candidate's
score is the least over its cuts in two parts of ``10**6 a a / (l r)``, in exact decimals. Joins with counts treat the
few parts that a large share of all candidates has in common apart, by a broadcast of at most ``SHARES`` rows.

Nulls: a null text is empty, a null language ``und``. Repeated rows count again. Empty texts have no words, and a table
without any gives no rows. Other columns are not read. Equal scores and counts are ordered by the phrase's bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .shared import written

#: Bytes of text that a task reduces at a time.
CHUNK = 16 << 20
#: Text a bucket of keys stands for.
BUCKET_BYTES = 16 << 20
KEY_BITS = 48
#: The table that tells when a key reached the threshold: text an entry stands for, least and most entries, places of a key.
SLOT_BYTES = 128
LEAST_SLOTS, MOST_SLOTS = 1 << 20, 1 << 26
PLACES = 3
NEVER = 255
#: A part that more than one in so many candidates have is joined apart.
SHARES = 64
#: Parts of a language that are cut to the best phrases before the last cut.
RANKED_PARTS = 32

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = re.compile(rb"[.,;:!?\x0a-\x0d]")
_WORD, _GAP, _END = 0, 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = _GAP
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = _END
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


@dataclass(frozen=True)
class Words:
    """The words of a chunk in one language: distinct ones, the number of each place's word, and where pieces end."""

    distinct: list[bytes]
    codes: np.ndarray
    ends: np.ndarray
    keys: np.ndarray

    def phrase_ok(self, n: int) -> np.ndarray:
        """Places where a phrase of ``n`` words begins."""
        places = max(0, len(self.codes) - n + 1)
        ok = np.ones(places, bool)
        for k in range(n - 1):
            ok &= ~self.ends[k : k + places]
        return ok


def read_words(lang: str, text: bytes) -> Words:
    raw = np.frombuffer(text + b"\n", np.uint8)
    kinds = _CLASS[raw]
    in_word = kinds == _WORD
    edges = np.diff(in_word.astype(np.int8), prepend=0)
    starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    # One separator behind every word stays, as a blank, so that words lie end to end.
    keep = in_word.copy()
    keep[stops] = True
    data = np.where(in_word, _FOLD[raw], 0x20).astype(np.uint8)[keep]
    offsets = np.concatenate([[0], np.cumsum(stops - starts + 1)]).astype(np.int64)
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    coded = array.dictionary_encode()
    marks = np.flatnonzero(kinds == _END)
    # A piece ends behind a word where the next mark stands before the next word.
    following = marks[np.searchsorted(marks, stops)] if len(stops) else stops
    ends = following < np.append(starts[1:], len(raw) + 1) if len(stops) else np.zeros(0, bool)
    distinct = [w[:-1] for w in coded.dictionary.to_pylist()]
    prefix = lang.encode() + b"\0"
    hashes = np.fromiter((xxhash.xxh64_intdigest(prefix + w) for w in distinct), np.uint64, len(distinct))
    return Words(distinct, coded.indices.to_numpy().astype(np.int64), ends, hashes >> np.uint64(64 - KEY_BITS))


def _mixed(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """A 64-bit mix of two keys."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + b
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(30))


def _longer(keys: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """Keys of the phrases of ``n`` words from those one word shorter."""
    places = max(0, len(words) - n + 1)
    return _mixed(keys[:places], words[n - 1 : n - 1 + places]) >> np.uint64(64 - KEY_BITS)


def _slots(keys: np.ndarray, slots: int) -> list[np.ndarray]:
    """The places of each key, one array a place: bits of one mix."""
    mixed, bits = _mixed(keys, np.uint64(1)), slots.bit_length() - 1
    shifts = [round(k * (64 - bits) / (PLACES - 1)) for k in range(PLACES)]
    return [((mixed >> np.uint64(s)) & np.uint64(slots - 1)).astype(np.int64) for s in shifts]


def _reached(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The boundary at which each key is known to have reached the threshold, or ``NEVER``."""
    return reduce(np.maximum, (table[at] for at in _slots(keys, len(table))))


def _totals(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sum of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(keys) else counts


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys as differences, and counts: byte planes, compressed."""
    both = np.concatenate([np.diff(keys, prepend=np.uint64(0)).astype("<u8"), counts.astype("<u8")])
    return zstandard.compress(both.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    both = np.ascontiguousarray(raw.T).view("<u8").ravel()
    half = len(both) // 2
    return np.cumsum(both[:half], dtype=np.uint64), both[half:].astype(np.int64)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(language, texts) of about ``CHUNK`` bytes; a longer text is cut behind the end of a piece."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.large_binary())):
            data = text.as_py()
            while len(data) > CHUNK and (cut := _BREAK.search(data, CHUNK)):
                yield lang, data[: cut.end()]
                data = data[cut.end() :]
            held.setdefault(lang, []).append(data)
            size += len(data)
            if size >= CHUNK:
                yield from ((k, b"\n".join(v)) for k, v in held.items())
                held, size = {}, 0
    yield from ((k, b"\n".join(v)) for k, v in held.items())


def _step(batches: Iterator[pa.RecordBatch], step: int, shards: int, buckets: int, tables: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases that are active in this step, one row a length, first step and bucket."""
    shift = np.uint64(KEY_BITS - buckets.bit_length() + 1)
    for lang, text in _texts(batches):
        words = read_words(lang, text)
        out = []
        singles = words.keys[words.codes]
        keys = singles
        for n in range(1, len(tables) + 1):
            if n == 1:
                first, chosen = None, words.keys if step < shards else singles[:0]
            else:
                # Looked up once a distinct word, or a place of a phrase.
                before = _reached(words.keys, tables[0])[words.codes] if n == 2 else _reached(keys, tables[n - 2])
                keys = _longer(keys, singles, n)
                first = np.maximum(before[: len(keys)], before[1 : len(keys) + 1])
                # Active phrases that have not been through a full cycle.
                now = words.phrase_ok(n) & (first <= step) & (first.astype(np.int16) > step - shards)
                chosen, first = keys[now], first[now]
            for begun in [0] if first is None else np.unique(first).tolist():
                if first is None:
                    found, counts = _totals(chosen, np.bincount(words.codes, minlength=len(words.keys))[: len(chosen)])
                else:
                    found, counts = np.unique(chosen[first == begun], return_counts=True)
                owners = (found >> shift).astype(np.int64)
                cuts = np.flatnonzero(np.diff(owners, prepend=-1))
                for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(found)]):
                    out.append((n, begun, int(owners[a]), pack(found[a:b], counts[a:b]), False))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _PARTIAL)], _PARTIAL_NAMES)


_PARTIAL = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.bool_())
_PARTIAL_NAMES = ["n", "begun", "bucket", "counts", "old"]
_STATE = "n int, begun int, bucket int, counts binary, slots array<int>"


def _merge(rows: pa.Table, threshold: int, tables: list[np.ndarray]) -> pa.Table:
    """One bucket's counts after a step, and the slots of the keys that reached the threshold in it."""
    old, parts = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), []
    for data, is_old in zip(rows["counts"].to_pylist(), rows["old"].to_pylist()):
        parts.append(unpack(data))
        old = parts[-1] if is_old else old
    keys, counts = _totals(*(np.concatenate(c) for c in zip(*parts)))
    known = np.zeros(len(keys), np.int64)
    known[np.searchsorted(keys, old[0])] = old[1]
    table = tables[rows["n"][0].as_py() - 1]
    slots = np.unique(np.concatenate(_slots(keys[(counts >= threshold) & (known < threshold)], len(table))))
    slots = slots[table[slots] == NEVER].astype(np.int32)
    heads = [rows[c].slice(0, 1).combine_chunks() for c in ("n", "begun", "bucket")]
    return pa.table([*heads, pa.array([pack(keys, counts)], pa.binary()), pa.array([slots], pa.list_(pa.int32()))], ["n", "begun", "bucket", "counts", "slots"])


def _spelled(batches: Iterator[pa.RecordBatch], tables: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(lang, n, phrase, f) of a chunk for the phrases whose keys reached the threshold; n = 0 counts all words."""
    for lang, text in _texts(batches):
        words = read_words(lang, text)
        if not len(words.codes):
            continue
        spelling = pa.array(words.distinct, pa.binary())
        size = len(words.distinct)
        singles = words.keys[words.codes]
        keys = singles
        parts = [(0, pa.array([b""]), np.array([len(words.codes)]))]
        common = np.flatnonzero(_reached(words.keys, tables[0]) != NEVER)
        parts.append((1, spelling.take(pa.array(common)), np.bincount(words.codes, minlength=size)[common]))
        for n in range(2, len(tables) + 1):
            keys = _longer(keys, singles, n)
            at = np.flatnonzero(words.phrase_ok(n) & (_reached(keys, tables[n - 1]) != NEVER))
            number = words.codes[at]
            for k in range(1, n):
                # Numbers of distinct beginnings, then with the next word: exact, whatever the keys.
                number = (np.unique(number, return_inverse=True)[1].ravel() if k > 1 else number) * size + words.codes[at + k]
            _, firsts, counts = np.unique(number, return_index=True, return_counts=True)
            taken = [spelling.take(pa.array(words.codes[at[firsts] + k])) for k in range(n)]
            parts.append((n, pc.binary_join_element_wise(*taken, b" "), counts))
        for n, phrases, counts in parts:
            if len(phrases):
                columns = [pa.repeat(pa.scalar(lang), len(phrases)), pa.repeat(pa.scalar(n, pa.int32()), len(phrases)), phrases.cast(pa.string()), pa.array(counts, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "n", "phrase", "f"])


def _closed(tables: list[np.ndarray]) -> list[bytes]:
    """The tables as they are sent: most entries are ``NEVER``, so they compress well."""
    return [zstandard.compress(t.tobytes(), 1) for t in tables]


@lru_cache(1)
def _opened(sent: tuple[bytes, ...]) -> list[np.ndarray]:
    """The tables in a task; a worker that runs several tasks of a step unpacks them once."""
    return [np.frombuffer(zstandard.decompress(t), np.uint8) for t in sent]


def _power(n: float) -> int:
    """The next power of two."""
    return 1 << int(np.ceil(np.log2(max(1, n))))


def _set(table: np.ndarray, blocks: np.ndarray, bits: np.ndarray, boundary: int) -> None:
    """Mark the slots that Spark gives as 64-bit words; marked ones keep their boundary."""
    flags = np.unpackbits(bits.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, bit = np.nonzero(flags)
    slots = blocks[row] * 64 + bit
    slots = slots[table[slots] == NEVER]
    table[slots] = boundary


def frequent_phrases(df: DataFrame, threshold: int = 10, longest: int = 3, shards: int = 4, lang_col: str = "lang", text_col: str = "text", slots: int | None = None) -> DataFrame:
    """(lang, n, phrase, f): every phrase of up to ``longest`` words with at least ``threshold`` occurrences in a
    language, exactly; the row with n = 0 counts all words."""
    if shards * longest >= NEVER:
        raise ValueError("too many shards for the boundary numbers")
    spark = df.sparkSession
    path = scratch_path(spark, "shards")
    rows = df.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        (F.monotonically_increasing_id() % shards).cast("int").alias("shard"),
    )
    rows.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    dealt = spark.read.schema("lang string, text string, shard int").parquet(path)
    total = dealt.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # No fewer than eight, so that a small corpus is merged in parallel as well.
    buckets = max(8, _power(total / BUCKET_BYTES))
    slots = slots or min(MOST_SLOTS, max(LEAST_SLOTS, _power(total / SLOT_BYTES)))
    tables = [np.full(slots, NEVER, np.uint8) for _ in range(longest)]
    latest = [-shards] * longest
    state, step = None, 0
    # Words count in the first cycle; what their subphrases activated last is active for a cycle from then on.
    while step < shards or any(boundary > step - shards for boundary in latest[:-1]):
        state = _scan(spark, dealt, state, step, shards, buckets, tables, threshold)
        step += 1
        bit = F.expr("shiftleft(cast(1 as bigint), slot & 63)")
        reached = state.select("n", F.explode("slots").alias("slot")).groupBy("n", F.shiftright("slot", 6).alias("block")).agg(F.bit_or(bit).alias("bits")).toArrow()
        for part in reached.to_batches(max_chunksize=1 << 14):
            numbers, blocks, bits = (c.to_numpy(zero_copy_only=False) for c in part.columns)
            for n in np.unique(numbers).tolist():
                _set(tables[n - 1], blocks[numbers == n].astype(np.int64), bits[numbers == n], step)
                latest[n - 1] = step
    sent = spark.sparkContext.broadcast(tuple(_closed(tables)))
    spelled = dealt.select("lang", "text").mapInArrow(lambda b: _spelled(b, _opened(sent.value)), "lang string, n int, phrase string, f bigint")
    counted = spelled.groupBy("lang", "n", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= threshold) | (F.col("n") == 0))
    found = written(counted, "phrases")
    sent.destroy()
    return found


def _scan(spark: SparkSession, dealt: DataFrame, state: DataFrame | None, step: int, shards: int, buckets: int, tables: list[np.ndarray], threshold: int) -> DataFrame:
    """The unfinished counts after one step, written."""
    sent = spark.sparkContext.broadcast(tuple(_closed(tables)))
    shard = dealt.where(F.col("shard") == step % shards).select("lang", "text")
    new = shard.mapInArrow(lambda b: _step(b, step, shards, buckets, _opened(sent.value)), "n int, begun int, bucket int, counts binary, old boolean")
    if state is not None:
        unfinished = state.where(F.col("begun") + shards > step).select("n", "begun", "bucket", "counts", F.lit(True).alias("old"))
        new = new.unionByName(unfinished)
    merged = written(new.groupBy("n", "begun", "bucket").applyInArrow(lambda t: _merge(t, threshold, _opened(sent.value)), _STATE), "phrase-counts")
    # The result is written, so nobody asks for the tables again; the driver's copy goes as well.
    sent.destroy()
    return merged


def _with_count(rows: DataFrame, counted: DataFrame, part: str, out: str) -> DataFrame:
    """``rows`` with the count of the phrase in column ``part``.

    At most ``SHARES`` parts can each have that share of all rows; these are sent to every task, the rest is joined by key.
    """
    total = rows.count()
    common = rows.groupBy("lang", part).count().where(F.col("count") * SHARES > total).select("lang", part)
    counts = counted.select("lang", F.col("phrase").alias(part), F.col("f").alias(out))
    hot = F.broadcast(written(common.join(counts, ["lang", part]), "hot-parts"))
    rest = rows.join(hot.select("lang", part), ["lang", part], "left_anti").join(counts, ["lang", part])
    return rows.join(hot, ["lang", part]).unionByName(rest)


def collocations(
    df: DataFrame, threshold: int = 10, longest: int = 3, top: int = 2000, inside: int = 50, shards: int = 4, lang_col: str = "lang", text_col: str = "text", slots: int | None = None
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words.

    A phrase inside a longer one that has at least ``inside`` percent of its occurrences is left out.
    """
    counted = frequent_phrases(df, threshold, longest, shards, lang_col, text_col, slots)
    phrases = counted.where("n >= 2")
    cut = F.explode(F.sequence(F.lit(1), F.col("n") - 1))
    heads = phrases.select("lang", "phrase", F.col("n").alias("words"), F.col("f").alias("a"), cut.alias("k"))
    cuts = heads.withColumn("head", F.expr("substring_index(phrase, ' ', k)")).withColumn("tail", F.expr("substring_index(phrase, ' ', k - words)"))
    cuts = _with_count(written(cuts, "cuts"), counted.where("n >= 1"), "head", "l")
    cuts = _with_count(written(cuts, "cuts"), counted.where("n >= 1"), "tail", "r")
    wide = "cast({} as decimal(18,0))"
    score = F.expr(f"({wide.format('a')} * {wide.format('a')} * 1000000bd) div ({wide.format('l')} * {wide.format('r')})")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("least"))
    # Every shorter phrase inside a candidate, with the most frequent candidate around it.
    parts = F.split("phrase", " ")
    within = F.expr("flatten(transform(sequence(2, n - 1), s -> transform(sequence(1, n - s + 1), i -> array_join(slice(parts, i, s), ' '))))")
    around = phrases.where("n > 2").withColumn("parts", parts).select("lang", F.explode(within).alias("phrase"), F.col("f").alias("longer"))
    around = around.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(around, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {inside} * a")
    totals = counted.where("n = 0").select("lang", F.col("f").alias("n"))
    # A language's phrases are ranked in parts first, so the last cut sees a bounded number of them.
    order = [F.desc("least.score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANKED_PARTS)).alias("part")
    first = kept.select("lang", "phrase", "a", "least", part)
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    ranked = first.withColumn("rank", best).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "least.l", "least.r", "n", "least.score")


def collocations_sql(threshold: int = 10, top: int = 2000, inside: int = 50) -> str:
    """Phrases of two and three words of ``documents`` in SQL."""
    return (
        "with pieces as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as ws from (select coalesce(lang, 'und') as lang,"
        f" unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents)),"
        " totals as (select lang, sum(len(ws)) as n from pieces group by 1),"
        " f as (select lang, s, phrase, count(*) as f from (select lang, s, array_to_string(ws[i:i+s-1], ' ') as phrase from"
        " (select lang, ws, s, unnest(range(1, len(ws) - s + 2)) as i from pieces, unnest([1, 2, 3]) as u(s)))"
        f" group by 1, 2, 3 having count(*) >= {threshold}),"
        " parts as (select lang, s, phrase, f as a, string_split(phrase, ' ') as p from f where s >= 2),"
        " cuts as (select *, array_to_string(p[1:k], ' ') as head, array_to_string(p[k+1:], ' ') as tail from parts, unnest([1, 2]) as u(k) where k < s),"
        " scored as (select c.lang, c.phrase, c.a, k, x.f as l, y.f as r, (1000000 * cast(a as hugeint) * a) // (cast(x.f as hugeint) * y.f) as score"
        " from cuts c join f x on x.lang = c.lang and x.phrase = c.head join f y on y.lang = c.lang and y.phrase = c.tail),"
        " least as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),"
        " around as (select lang, array_to_string(p[i:i+1], ' ') as phrase, max(a) as longer from parts, unnest([1, 2]) as u(i) where s = 3 group by 1, 2),"
        f" ranked as (select t.lang, row_number() over (partition by t.lang order by score desc, a desc, encode(t.phrase)) as rank, t.phrase, a, l, r, score"
        f" from least t left join around o on o.lang = t.lang and o.phrase = t.phrase where longer is null or 100 * longer < {inside} * a)"
        " select lang, rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from ranked join totals using (lang)"
        f" where rank <= {top}"
    )
