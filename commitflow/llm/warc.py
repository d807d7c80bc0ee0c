"""WARC archives: writing records, and reading them back from byte ranges that know no record bounds.

Reading deals every file out in ranges. A task looks for the version line in its range: each place is a
candidate record, whose header tells where its successor must stand. Following those links inside the
range gives, for each candidate, the first place behind the range. Pointer jumping over these links
from each file's start then leaves exactly one true entry a range: a version line inside a payload may
look like a record, but no chain from the start leads to it. Only from verified entries are records
read.

Of records with equal payloads of at least ``least_bytes`` the one with the largest id is a response,
the others are revisits that refer to it and carry no payload. Nulls: a null payload counts as empty; a
null id keeps its row and is never referred to while another id has the payload; a null url gives no
target header. Repeated ids keep every row; among equal payloads all rows with the largest id are
responses. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .shared import partitions, written

VERSION = b"WARC/1.1\r\n"
#: Bytes of a range, and of a file before the next is begun.
RANGE_BYTES, FILE_BYTES = 8 << 20, 1 << 30
#: Bytes read at once behind a range for the header that its last candidate may begin; longer ones are read on to their end.
HEADER_BYTES = 1 << 16
_LENGTH = re.compile(rb"\r\nContent-Length: (\d{1,18})\r\n")
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_type(pages: DataFrame, id_col: str, payload_col: str, least_bytes: int) -> DataFrame:
    """(id, url, payload, refers_to): the response's id for revisits, else null.

    Only digests that occur more than once are joined, with Spark's own choice of a checked broadcast
    or a join that it can split.
    """
    # Two digests and the length: equal keys are equal payloads.
    keyed = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"),
    ).withColumn("key", F.concat(F.sha1(F.col("payload").cast("binary")), F.xxhash64("payload").cast("string"), F.octet_length("payload").cast("string")))
    large = keyed.where(F.octet_length("payload") >= least_bytes)
    repeated = large.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("response")).where("n > 1").drop("n")
    repeated = written(repeated, "repeated")
    typed = keyed.join(repeated, "key", "left")
    other = F.col("response").isNotNull() & ~F.col("id").eqNullSafe(F.col("response")) & (F.octet_length("payload") >= least_bytes)
    return typed.select("id", "url", "payload", F.when(other, F.col("response")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record with its blank lines. A revisit holds the HTTP header alone."""
    kind = b"response" if refers_to is None else b"revisit"
    block = HTTP + (payload if refers_to is None else b"")
    lines = [
        b"WARC-Type: " + kind,
        b"WARC-Record-ID: <urn:page:%s>" % (b"" if page_id is None else b"%d" % page_id),
        b"WARC-Date: 2000-01-01T00:00:00Z",
        b"WARC-Payload-Digest: sha1:" + base32_sha1(payload).encode(),
        b"X-Payload-Length: %d" % len(payload),
    ]
    if url is not None:
        lines.append(b"WARC-Target-URI: " + re.sub(rb"[\r\n]", b" ", url.encode()))
    if refers_to is not None:
        lines.append(b"WARC-Refers-To: <urn:page:%d>" % refers_to)
        lines.append(b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return VERSION + b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_warc(
    pages: DataFrame, folder: str, id_col: str = "page_id", payload_col: str = "html", least_bytes: int = 0, file_bytes: int = FILE_BYTES
) -> DataFrame:
    """Write the pages below ``folder``; the list of files (path, bytes), without those of lost tasks."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{folder}/pages-{task.partitionId():07d}-{task.taskAttemptId()}"
        files, where = _opened(folder)
        files.create_dir(where)
        out, path, size, number = None, "", 0, 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "payload", "refers_to"))):
                data = record(row[0], row[1], row[2].encode(), row[3])
                if out is not None and size + len(data) > file_bytes:
                    out.close()
                    done.append((path, size))
                    out = None
                if out is None:
                    path, size, number = f"{name}-{number:05d}.warc", 0, number + 1
                    out = files.open_output_stream(_opened(path)[1])
                size += out.write(data)
        if out is not None:
            out.close()
            done.append((path, size))
        yield pa.RecordBatch.from_pydict({"path": [p for p, _ in done], "bytes": [n for _, n in done]}, pa.schema([("path", pa.string()), ("bytes", pa.int64())]))

    return written(with_type(pages, id_col, payload_col, least_bytes).mapInArrow(write, "path string, bytes long"), "warc-files")


def candidates(data: bytes, start: int, own: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, successor) of every version line that begins within the first ``own`` bytes.

    ``data``: the bytes from ``start`` on, to the end of the last header that begins in them.
    """
    places, following = [], []
    at = data.find(VERSION)
    end, length = -1, None
    while 0 <= at < own:
        # Version lines before one end of a header share it, and the first length between: each byte is searched once.
        if end < at:
            end = data.find(b"\r\n\r\n", at)
            length = None
            if end < 0:
                break
        if length is None or length.start() < at:
            length = _LENGTH.search(data, at, end + 2)
        if length:
            places.append(start + at)
            following.append(start + end + 4 + int(length[1]) + 4)
            at = data.find(VERSION, at + 1)
        else:
            # None of the version lines before this end has a length.
            at = data.find(VERSION, end)
    return np.array(places, np.int64), np.array(following, np.int64)


def _headers(file, data: bytes, own: int) -> bytes:
    """``data`` and what ``file`` holds behind it, up to the end of the header that may begin last in ``own``."""
    last = data.rfind(VERSION, 0, own + len(VERSION) - 1)
    if last < 0 or data.find(b"\r\n\r\n", last) >= 0:
        return data
    parts, seam, size = [data], data[-3:], HEADER_BYTES
    while more := file.read(size):
        parts.append(more)
        if b"\r\n\r\n" in seam + more:
            break
        seam, size = (seam + more)[-3:], min(2 * size, RANGE_BYTES)
    return b"".join(parts)


def exits(places: np.ndarray, following: np.ndarray, end: int) -> np.ndarray:
    """Where the chain from each candidate leaves the range; -1 where it ends at no candidate."""
    out = following.copy()
    for k in range(len(places) - 1, -1, -1):
        if following[k] < end:
            at = int(np.searchsorted(places, following[k]))
            out[k] = out[at] if at < len(places) and places[at] == following[k] else -1
    return out


def entries(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, start, stop, entry): the first true record of every range that has one.

    ``stop`` is the end of the range; records that begin before it belong to it.
    """
    spark = files.sparkSession
    ranges = files.where("bytes > 0").select(
        "path", "bytes", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(range_bytes))).alias("start")
    ).repartition(partitions(spark), "path", "start")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "start"))):
                files_, name = _opened(path)
                own = min(range_bytes, size - start)
                with files_.open_input_file(name) as file:
                    file.seek(start)
                    data = _headers(file, file.read(range_bytes + HEADER_BYTES + len(VERSION)), own)
                places, following = candidates(data, start, own)
                leave = exits(places, following, start + own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(places), pa.string()), pa.array(places), pa.array(leave)], ["path", "place", "exit"]
                )

    links = written(ranges.mapInArrow(scan, "path string, place long, exit long"), "warc-links")
    # Only candidates that a chain can enter matter: a file's start, and places where a chain leaves a range.
    starts = files.select("path", F.lit(0).cast("long").alias("place"))
    entered = links.select("path", F.col("exit").alias("place")).where("place >= 0").unionByName(starts).distinct()
    jump = written(links.join(entered, ["path", "place"]), "warc-jumps")
    reached = written(starts, "warc-reached")
    count = reached.count()
    while True:
        # Reached places and those one jump on; the jumps double.
        onward = reached.join(jump, ["path", "place"]).select("path", F.col("exit").alias("place"))
        reached = written(reached.unionByName(onward).distinct(), "warc-reached")
        now = reached.count()
        if now == count:
            break
        count = now
        further = jump.select("path", "place", F.col("exit").alias("via")).join(
            jump.select("path", F.col("place").alias("via"), "exit"), ["path", "via"], "left"
        )
        # A chain that cannot go on stays at its last place, the end of the file.
        jump = written(further.select("path", "place", F.coalesce("exit", "via").alias("exit")), "warc-jumps")
    # Every chain must reach the end of its file: records behind a break would be missing.
    ends = files.where("bytes > 0").select("path", F.col("bytes").alias("place"))
    broken = ends.join(reached, ["path", "place"], "left_anti").select("path").first()
    if broken:
        raise ValueError(f"{broken.path}: the chain of records does not end at the end of the file")
    true = reached.join(links.select("path", "place"), ["path", "place"], "left_semi").distinct()
    start = F.col("place") - F.col("place") % range_bytes
    return true.groupBy("path", start.alias("start")).agg(F.min("place").alias("entry")).withColumn("stop", F.col("start") + range_bytes)


def _header(name: bytes, head: bytes) -> bytes | None:
    found = re.search(rb"\r\n" + name + rb": ([^\r\n]*)", head)
    return found[1] if found else None


def read_warc(files: DataFrame, range_bytes: int = RANGE_BYTES, with_payload: bool = False) -> DataFrame:
    """Every record: page_id, url, record_type, refers_to, payload_bytes, payload_digest (and payload).

    A response's length and digest are those of the payload that was read, checked against its header.
    """
    fields = [
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
    ][: 7 if with_payload else 6]
    schema = pa.schema(fields)

    def number(value: bytes | None) -> int | None:
        digits = re.fullmatch(rb"<urn:page:(-?\d+)>", value or b"")
        return int(digits[1]) if digits else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, entry, stop in zip(*(batch.column(c).to_pylist() for c in ("path", "entry", "stop"))):
                rows = []
                for head, block in records(path, entry, stop):
                    kind = (_header(b"WARC-Type", head) or b"").decode()
                    digest = (_header(b"WARC-Payload-Digest", head) or b"").decode().removeprefix("sha1:")
                    url = _header(b"WARC-Target-URI", head)
                    payload = block.partition(b"\r\n\r\n")[2]
                    size = int(_header(b"X-Payload-Length", head) or len(payload))
                    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
                        raise ValueError(f"{path}: a payload differs from its digest")
                    row = (number(_header(b"WARC-Record-ID", head)), None if url is None else url.decode(), size, digest, kind, number(_header(b"WARC-Refers-To", head)), payload)
                    rows.append(row[: len(fields)])
                    if len(rows) == 512:
                        yield _batch(rows, schema)
                        rows = []
                yield _batch(rows, schema)

    spark = files.sparkSession
    dealt = entries(files, range_bytes).select("path", "entry", "stop").repartition(partitions(spark), "path", "entry")
    text = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return dealt.mapInArrow(read, text + ", payload binary" * with_payload)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def records(path: str, entry: int, stop: int) -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of the records that begin from ``entry`` on and before ``stop``."""
    files, name = _opened(path)
    with files.open_input_file(name) as file:
        at = entry
        file.seek(at)
        data = file.read(stop - entry + HEADER_BYTES)
        base = at
        while at < stop and at - base < len(data):
            end = data.find(b"\r\n\r\n", at - base)
            while end < 0:
                more = file.read(max(HEADER_BYTES, len(data)))
                if not more:
                    raise ValueError(f"{path}: the header at {at} does not end")
                data += more
                end = data.find(b"\r\n\r\n", at - base)
            head = data[at - base : end]
            length = int(_LENGTH.search(head + b"\r\n")[1])
            first = end + 4
            if first + length > len(data):
                file.seek(base + len(data))
                data += file.read(first + length - len(data))
            yield head, data[first : first + length]
            at = base + first + length + 4


def round_trip(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least_bytes: int = 0, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Write the pages to archives in the shared folder, and read them back."""
    files = write_warc(pages, scratch_path(pages.sparkSession, "warc"), id_col, payload_col, least_bytes)
    return read_warc(files, range_bytes)
