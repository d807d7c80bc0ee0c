from collections import Counter

import numpy as np
import pytest

from commitflow.llm.warc import VERSION, base32_sha1, candidates, exits, read_warc, record, records, round_trip, write_warc

SCHEMA = "page_id long, url string, html string"
TRAP = "<p>" + record(7, "http://x", b"hello", None).decode() + "</p>" + VERSION.decode() + "Content-Length: 5\r\n\r\n"
PAGES = [
    (1, None, None), (2, "u", ""), (None, "u", "zz"), (3, None, TRAP), (4, "v", TRAP * 300), (5, "v", TRAP), (6, "q\r\nX: y", "zz"),
    (6, "q", "zz"), (7, "ü", "é中"), (8, "a", "b"), (None, None, None), (None, "n", "only null"), (None, "n", "only null"),
]


def want(pages, least):
    texts = [p[2] or "" for p in pages]
    out = Counter()
    for k, _, html in pages:
        data = (html or "").encode()
        ids = [p[0] for p, t in zip(pages, texts) if t == (html or "") and p[0] is not None]
        revisit = len(data) >= least and len(ids) > 0 and k != max(ids)
        out[(k, len(data), base32_sha1(data), "revisit" if revisit else "response", max(ids) if revisit else None)] += 1
    return out


def got(df):
    return Counter(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))


@pytest.mark.parametrize("range_bytes", [300, 5000, 8 << 20])
def test_round_trip(spark, range_bytes):
    # Small ranges: most begin inside a record, many inside a payload that holds version lines.
    df = spark.createDataFrame(PAGES, SCHEMA).selectExpr("*", "1 as id", "2 as key", "3 as payload").repartition(2)
    assert got(round_trip(df, range_bytes=range_bytes)) == want(PAGES, 0)


def test_least_bytes(spark):
    assert got(round_trip(spark.createDataFrame(PAGES, SCHEMA), least_bytes=3)) == want(PAGES, 3)


def test_files_roll_and_keep_payloads(spark, tmp):
    pages = [(k, f"u{k}", f"<html>{k}</html>" * k) for k in range(30)]
    files = write_warc(spark.createDataFrame(pages, SCHEMA).coalesce(1), tmp + "/w", file_bytes=2000)
    assert files.count() > 5
    found = read_warc(files, 700, with_payload=True).collect()
    assert sorted((r.page_id, r.url, r.payload.decode()) for r in found) == pages


def test_empty(spark):
    assert round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_chains_leave_a_range_only_by_candidates():
    good = record(1, "u", TRAP.encode(), None)
    data = good + good
    places, following = candidates(data, 1000, len(data))
    assert {1000, 1000 + len(good)} < set(places.tolist()) and len(places) > 4
    out = dict(zip(places.tolist(), exits(places, following, 1000 + len(data)).tolist()))
    assert out[1000] == out[1000 + len(good)] == 1000 + len(data)
    assert exits(np.array([0, 9]), np.array([5, 20]), 15).tolist() == [-1, 20]


@pytest.mark.parametrize("range_bytes", [5000, 70_000, 8 << 20])
def test_urls_longer_than_a_header_read(spark, tmp, range_bytes):
    long = "data:text/html," + "x%0D" * 50_000
    pages = [(k, long if k in (3, 7) else f"u{k}", f"<html>{k}</html>" * k) for k in range(12)]
    files = write_warc(spark.createDataFrame(pages, SCHEMA).coalesce(1), tmp + "/w")
    found = read_warc(files, range_bytes, with_payload=True).collect()
    assert sorted((r.page_id, r.url, r.payload.decode()) for r in found) == pages


def test_records_behind_a_short_read(tmp):
    data = record(1, "u", b"a", None) + record(2, "x" * 300_000, b"b", None)
    with open(tmp + "/w.warc", "wb") as file:
        file.write(data)
    assert [block[-1:] for _, block in records("file://" + tmp + "/w.warc", 0, len(record(1, "u", b"a", None)) + 1)] == [b"a", b"b"]


def test_candidates_of_one_header():
    # A payload may hold version lines whose header ends only with that of the next record.
    data = VERSION * 3 + b"X: 1\r\nContent-Length: 5\r\n" + VERSION + b"Content-Length: 7\r\n\r\n" + VERSION + b"a\r\n\r\n" + record(1, "u", b"a", None)
    end = data.index(b"\r\n\r\n")
    places, following = candidates(data, 0, len(data))
    want = [(0, 5), (10, 5), (20, 5), (data.index(VERSION, 31), 7)]
    assert list(zip(places.tolist(), following.tolist()))[:4] == [(p, end + 8 + n) for p, n in want]
    assert places.tolist()[4:] == [data.rindex(VERSION)]


def test_a_broken_chain_is_an_error(spark, tmp):
    data = record(1, "u", b"a", None) + b"no record\r\n\r\n" + record(2, "u", b"b", None)
    with open(tmp + "/w.warc", "wb") as file:
        file.write(data)
    files = spark.createDataFrame([("file://" + tmp + "/w.warc", len(data))], "path string, bytes long")
    with pytest.raises(ValueError, match="does not end"):
        read_warc(files)
