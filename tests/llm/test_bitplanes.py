import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import ODD, documents
from tokenizers import Tokenizer

from commitflow.llm.bitplanes import PlaneReader, PlaneWriter, from_planes, round_trip, to_planes

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("top", [1, 200, 50_000, 1 << 20, (1 << 32) - 1])
def test_planes(bits, top):
    r = np.random.default_rng(1)
    for n in (0, 1, 7, 1000):
        ids = r.integers(0, top, n, np.uint32)
        assert np.array_equal(from_planes(to_planes(ids, bits), n, bits), ids)
    assert to_planes(np.zeros(9, np.uint32), bits) == []


class File(io.BytesIO):
    def size(self):
        return len(self.getvalue())


@pytest.mark.parametrize("bits", [False, True])
def test_file(bits):
    r = np.random.default_rng(2)
    docs = [r.integers(0, 60_000, n, np.uint32) for n in (3, 0, 100, 1, 35, 0)]
    out = File()
    writer = PlaneWriter(out, bits, block_ids=16)
    for k, d in enumerate(docs):
        writer.add(np.array([k - 2]), np.array([len(d)]), d)
    writer.close()
    reader = PlaneReader(out)
    assert reader.docs.tolist() == list(range(-2, 4)) and reader.counts.tolist() == [len(d) for d in docs]
    assert [c for _, _, c in reader.documents()] == [zlib.crc32(d.tobytes()) for d in docs]
    assert np.array_equal(reader.block(2), np.concatenate(docs)[32:48])
    with pytest.raises(ValueError, match="not a file"):
        PlaneReader(File(b"x" * 200))


def want(rows):
    t, out, start = Tokenizer.from_file(PATH), [], 0
    for k, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("bits", [False, True])
def test_round_trip(spark, bits):
    rows = [r for r in ODD if r[0] != 4] + [(50, "same"), (50, "same")]
    df = documents(spark, rows, extra=("id", "part", "start", "path")).repartition(4)
    found = round_trip(df, PATH, bits=bits, block_ids=64)
    assert sorted(map(tuple, found.collect()), key=lambda r: r[1]) == want(rows)


def test_repeated_ids_keep_every_row(spark):
    found = round_trip(documents(spark, ODD), PATH).where("doc_id = 4").collect()
    assert sorted(r.n_tokens for r in found) == sorted(n for k, _, n, _ in want(ODD) if k == 4)


def test_empty(spark):
    assert round_trip(documents(spark, []), PATH).collect() == []
