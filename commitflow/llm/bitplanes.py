"""Token ids in files of compressed planes, in the order of the documents' ids.

A file holds blocks of a fixed number of ids. A block is transposed into planes, byte ``k`` (or bit
``k``) of every id together, and each plane is compressed with zstandard, so that the slowly varying
high planes shrink to almost nothing. A chunk index at the end gives every block's place and plane
sizes, so a reader can open any block alone.

    ids-planes-1 | blocks: planes ... | ids of documents | counts of documents | chunk index | trailer

Files are named after the task attempt that wrote them, and only those in the manifest, which Spark
commits, are read; a lost task leaves nothing but an unread file.

Nulls: a null text holds only the end id; a null id sorts first. Repeated ids keep every row, ordered
by text. An empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .shared import partitions, written
from .tokens import blocks, encoder

MAGIC = b"ids-planes-1\n"
#: Ids of a block, and bytes of a trailer: offsets and sizes of the three sections, flags, magic.
BLOCK_IDS = 1 << 16
TRAILER = struct.Struct("<QQQQQB13s")


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of one block, lowest first; all-zero planes above the highest id are left out."""
    data = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    top = int(ids.max()).bit_length() if len(ids) else 0
    if not bits:
        return [data[:, k].tobytes() for k in range((top + 7) // 8)]
    spread = np.unpackbits(data, axis=1, bitorder="little")
    return [np.packbits(spread[:, k], bitorder="little").tobytes() for k in range(top)]


def from_planes(planes: list[bytes], count: int, bits: bool) -> np.ndarray:
    """The ids of a block from its planes."""
    if not bits:
        data = np.zeros((count, 4), np.uint8)
        for k, plane in enumerate(planes):
            data[:, k] = np.frombuffer(plane, np.uint8)
    else:
        spread = np.zeros((count, 32), np.uint8)
        for k, plane in enumerate(planes):
            spread[:, k] = np.unpackbits(np.frombuffer(plane, np.uint8), count=count, bitorder="little")
        data = np.packbits(spread, axis=1, bitorder="little")
    return data.reshape(-1).view("<u4")


class PlaneWriter:
    """Writes one file; ids may come in pieces of any size."""

    def __init__(self, out, bits: bool = False, block_ids: int = BLOCK_IDS, level: int = 3) -> None:
        self.out, self.bits, self.block_ids = out, bits, block_ids
        self.zip = zstandard.ZstdCompressor(level=level)
        self.at = out.write(MAGIC)
        self.held: list[np.ndarray] = []
        self.size = 0
        self.index: list[bytes] = []
        self.docs: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, docs: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(np.asarray(docs, "<i8"))
        self.counts.append(np.asarray(counts, "<u8"))
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.block_ids:
            data = np.concatenate(self.held)
            full = len(data) // self.block_ids * self.block_ids
            for k in range(0, full, self.block_ids):
                self._block(data[k : k + self.block_ids])
            self.held, self.size = [data[full:]], len(data) - full

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def _block(self, ids: np.ndarray) -> None:
        start = self.at
        sizes = [self._put(self.zip.compress(p)) for p in to_planes(ids, self.bits)]
        self.index.append(struct.pack(f"<QIB{len(sizes)}I", start, len(ids), len(sizes), *sizes))

    def close(self) -> None:
        if self.size:
            self._block(np.concatenate(self.held))
        docs = np.concatenate([np.zeros(0, "<i8"), *self.docs])
        counts = np.concatenate([np.zeros(0, "<u8"), *self.counts])
        start = self.at
        sizes = [self._put(self.zip.compress(x)) for x in (docs.tobytes(), counts.tobytes(), b"".join(self.index))]
        self._put(TRAILER.pack(start, *sizes, len(docs), self.bits, MAGIC))


class PlaneReader:
    """Reads one file: its documents, and any block alone."""

    def __init__(self, file) -> None:
        self.file = file
        self.unzip = zstandard.ZstdDecompressor()
        size = file.size()
        start, docs, counts, index, n, bits, magic = TRAILER.unpack(self._read(size - TRAILER.size, TRAILER.size))
        if magic != MAGIC or self._read(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a file of id planes")
        self.bits = bool(bits)
        self.docs = np.frombuffer(self._section(start, docs), "<i8")
        self.counts = np.frombuffer(self._section(start + docs, counts), "<u8").astype(np.int64)
        if len(self.docs) != n or len(self.counts) != n:
            raise ValueError("the document sections do not match the trailer")
        self.index: list[tuple[int, int, tuple[int, ...]]] = []
        data, at = self._section(start + docs + counts, index), 0
        while at < len(data):
            offset, count, planes = struct.unpack_from("<QIB", data, at)
            self.index.append((offset, count, struct.unpack_from(f"<{planes}I", data, at + 13)))
            at += 13 + 4 * planes

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def _section(self, at: int, size: int) -> bytes:
        return self.unzip.decompress(self._read(at, size)) if size else b""

    def block(self, k: int) -> np.ndarray:
        at, count, sizes = self.index[k]
        data, planes = self._read(at, sum(sizes)), []
        for size in sizes:
            planes.append(self.unzip.decompress(data[:size]))
            data = data[size:]
        return from_planes(planes, count, self.bits)

    def documents(self) -> Iterator[tuple[int, int, int]]:
        """(number in the file, ids before it, crc32 of its ids), block by block in bounded memory."""
        left, crc, at, k = 0, 0, 0, -1
        data = memoryview(b"")
        for doc, count in enumerate(self.counts.tolist()):
            left, crc = 4 * count, 0
            while left:
                if not len(data):
                    k += 1
                    data = memoryview(self.block(k)).cast("B")
                part = data[:left]
                crc = zlib.crc32(part, crc)
                left -= len(part)
                data = data[len(part) :]
            yield doc, at, crc
            at += count


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_ids(
    df: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1,
    bits: bool = False, block_ids: int = BLOCK_IDS, keep_blanks: bool = False,
) -> DataFrame:
    """Write the ids of every text below ``folder``, ordered by id; the manifest, one row a file."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # Equal ids are parted by their text, so that one id never fills a task.
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(partitions(spark), "id", tie).sortWithinPartitions("id", tie)
    lowest = np.iinfo(np.int64).min

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part = task.partitionId()
        path = f"{folder}/ids-{part:07d}-{task.taskAttemptId()}.planes"
        files, name = _opened(path)
        files.create_dir(name.rpartition("/")[0])
        n_docs = n_ids = 0
        with files.open_output_stream(name) as out:
            writer = PlaneWriter(out, bits, block_ids)
            for block in blocks(batches):
                texts = block.column("text").combine_chunks()
                ids, counts = encoder(tokenizer, keep_blanks).encode(texts)
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(counts), end_id)
                    counts = counts + 1
                docs = block.column("id").combine_chunks().fill_null(lowest).to_numpy()
                writer.add(docs, counts, ids)
                n_docs, n_ids = n_docs + len(docs), n_ids + len(ids)
            writer.close()
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "docs": [n_docs], "ids": [n_ids]})

    return written(ordered.mapInArrow(write, "part long, path string, docs long, ids long"), "ids-manifest")


def read_ids(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from its file."""
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row a file: the window is over the list of files, never over ids.
    based = manifest.withColumn("base", F.coalesce(F.sum("ids").over(upto), F.lit(0)))
    lowest = np.iinfo(np.int64).min
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                files, name = _opened(path)
                with files.open_input_file(name) as file:
                    reader = PlaneReader(file)
                    found = np.array(list(reader.documents()), np.int64).reshape(-1, 3)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(reader.docs, mask=reader.docs == lowest), pa.array(found[:, 1] + base),
                         pa.array(reader.counts), pa.array(found[:, 2])],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    files = based.select("path", "base").repartition(partitions(manifest.sparkSession))
    return files.mapInArrow(read, schema)


def round_trip(df: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write the ids of all texts to files in the shared folder, and read them back."""
    return read_ids(write_ids(df, tokenizer, scratch_path(df.sparkSession, "ids"), **options))
