"""Lexical retrieval packing: documents that share rare tokens share a window.

Documents are dealt into shards by a min-hash of their id pairs, so related ones tend to meet, and a
shard that grows too large is split by Spark. Each shard builds a BM25 inverted index over its own
documents' token ids. Starting from a seed document, the index returns the best unused neighbours,
which fill the window greedily; a document that does not fit is cut, and its rest seeds the next
window. So only a shard's last window can be short: it is laid out as windows whose sizes are powers
of two, which need no padding.

Nulls: a null text counts as empty and holds only the end id; a null id keeps its row. Repeated ids
and texts keep every row. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import binaries, crcs
from .tokens import blocks, encoder

#: Ids of a shard's index: what a task holds in memory at a time.
SHARD_IDS = 4_000_000
#: Terms of a seed that query the index: those of most weight.
QUERY_TERMS = 12
K1, B = 1.2, 0.75


def tokenize(df: DataFrame, tokenizer: str, id_col: str, text_col: str, end_id: int, keep_blanks: bool) -> DataFrame:
    """(id, n, ids, place): the ids of every document with the end id, and its min-hash."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            ids, counts = encoder(tokenizer, keep_blanks).encode(block.column("text").combine_chunks())
            ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
            counts = counts + 1
            yield pa.RecordBatch.from_arrays(
                [block.column("id").combine_chunks(), pa.array(counts), binaries(_narrow(ids), counts), pa.array(min_hash(ids, counts))],
                ["id", "n", "ids", "place"],
            )

    return rows.mapInArrow(of, f"id {kind}, n long, ids binary, place long")


def _narrow(ids: np.ndarray) -> np.ndarray:
    """Three bytes an id: enough for every public vocabulary."""
    return np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 4)[:, :3]).view("V3").reshape(-1)


def _widen(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(data, np.uint8).reshape(-1, 3)
    return out.view("<u4").reshape(-1)


def min_hash(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The least hash of each document's pairs of neighbouring ids."""
    if not len(counts):
        return np.zeros(0, np.int64)
    following = np.append(ids[1:], 0).astype(np.uint64)
    h = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (following * np.uint64(0xC2B2AE3D27D4EB4F))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.minimum.reduceat(h, np.cumsum(counts) - counts).view(np.int64)


class Index:
    """A BM25 inverted index over the documents of one shard, by token id."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray) -> None:
        n = len(counts)
        doc = np.repeat(np.arange(n, dtype=np.int64), counts)
        # Postings in the order of terms, then documents; equal neighbours are one posting.
        keys = np.sort((ids.astype(np.int64) * n) + doc)
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        tf = np.diff(np.append(new, len(keys)))
        keys = keys[new]
        term, self.doc = keys // n, (keys % n).astype(np.int32)
        start = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
        self.bounds = np.append(start, len(term))
        df = np.diff(self.bounds)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * counts / max(counts.mean(), 1)) if n else np.zeros(0)
        self.weight = (np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[self.doc])).astype(np.float32)
        # The same postings by document: the query terms of each are its heaviest.
        number = np.repeat(np.arange(len(df)), df)
        order = np.lexsort((-self.weight, self.doc))
        per_doc = np.bincount(self.doc, minlength=n)
        first = np.cumsum(per_doc) - per_doc
        self.terms, self.first, self.per_doc = number[order].astype(np.int32), first, per_doc
        self.n = n

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a query term with ``seed``, best score first, ties by position."""
        at = self.first[seed]
        query = self.terms[at : at + min(QUERY_TERMS, self.per_doc[seed])]
        score = np.zeros(self.n, np.float32)
        for t in query.tolist():
            a, b = self.bounds[t], self.bounds[t + 1]
            if b - a > 1:
                score[self.doc[a:b]] += self.weight[a:b]
        score *= unused
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


def pack_shard(ids: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Pieces (document, start, length, sequence, offset) of one shard's documents."""
    index = Index(ids, counts)
    unused = np.ones(len(counts), bool)
    order = iter(np.argsort(-counts, kind="stable").tolist())
    rest: tuple[int, int] | None = None
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence = offset = 0
    left = int(counts.sum())
    while left:
        room = min(window, left)
        if room < window:
            room = 1 << (room.bit_length() - 1)
        if rest is None:
            seed = next(d for d in order if unused[d])
            unused[seed] = False
            rest = (seed, 0)
        seed = rest[0]
        found: Iterator[int] | None = None
        offset = 0
        while offset < room:
            if rest is None:
                if found is None:
                    found = iter(index.neighbours(seed, unused).tolist())
                d = next(found, -1)
                if d < 0:
                    d = next(x for x in order if unused[x])
                unused[d] = False
                rest = (d, 0)
            d, start = rest
            length = min(int(counts[d]) - start, room - offset)
            pieces.append((d, start, length, sequence, offset))
            offset += length
            rest = (d, start + length) if start + length < counts[d] else None
        left -= room
        sequence += 1
    return np.array(pieces, np.int64).reshape(-1, 5)


def pack(
    df: DataFrame, tokenizer: str, window: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1,
    keep_blanks: bool = True, shard_ids: int = SHARD_IDS, with_ids: bool = False,
) -> DataFrame:
    """One row a piece: document, place in it, checksum, sequence and place in that; with its ids if asked."""
    rows = tokenize(df, tokenizer, id_col, text_col, end_id, keep_blanks)
    kind = rows.schema["id"].dataType.simpleString()
    # Dealt by min-hash; a place that holds very many documents is split, small ones are put together.
    dealt = rows.hint("rebalance", "place").sortWithinPartitions("place", "id", "ids")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
        docs: list[pa.Array] = []
        parts: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        size = 0
        for block in blocks(batches, "ids", 3 * shard_ids // 4):
            docs.append(block.column("id").combine_chunks())
            parts.append(_widen(b"".join(block.column("ids").to_pylist())))
            counts.append(block.column("n").to_numpy())
            size += len(parts[-1])
            if size >= shard_ids:
                yield docs, np.concatenate(parts), np.concatenate(counts)
                docs, parts, counts, size = [], [], [], 0
        if docs:
            yield docs, np.concatenate(parts), np.concatenate(counts)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sequences are numbered in a task, behind the task's own number.
        sequence = TaskContext.get().partitionId() << 36
        for docs, ids, counts in shards(batches):
            pieces = pack_shard(ids, counts, window)
            doc, start, length, number, offset = pieces.T
            first = np.cumsum(counts) - counts
            at = first[doc] + start
            # One checksum a piece: pieces are slices of the shard's ids.
            held = np.concatenate([ids[a : a + n] for a, n in zip(at.tolist(), length.tolist())])
            columns = [
                pa.concat_arrays(docs).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crcs(held, length), pa.int64()),
                pa.array(counts[doc]), pa.array(sequence + number), pa.array(offset),
            ]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(binaries(held, length))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
            sequence += int(number[-1]) + 1

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return dealt.mapInArrow(packed, schema + ", ids binary" * with_ids)
