import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import ODD, documents, words
from tokenizers import Tokenizer

from commitflow.llm.packing import Index, pack, pack_shard

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_bm25_scores():
    docs = [[5, 5, 9], [5, 7], [7, 8, 9, 9], [1], [5, 9]]
    index = Index(np.array([i for d in docs for i in d]), np.array([len(d) for d in docs]))
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    scores = np.zeros(n)
    for t in set(docs[0]):
        df = sum(t in d for d in docs)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        for k, d in enumerate(docs):
            tf = d.count(t)
            scores[k] += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
    unused = np.array([False, True, True, True, True])
    got = index.neighbours(0, unused).tolist()
    assert got == [k for k in np.argsort(-scores, kind="stable").tolist() if unused[k] and scores[k] > 0]


@pytest.mark.parametrize("window", [1, 8, 2048])
def test_shard(window):
    r = np.random.default_rng(3)
    counts = r.integers(1, 60, 50)
    pieces = pack_shard(r.integers(0, 40, int(counts.sum())), counts, window)
    for d in range(50):
        own = pieces[pieces[:, 0] == d]
        own = own[np.argsort(own[:, 1])]
        assert own[0, 1] == 0 and (own[1:, 1] == own[:-1, 1] + own[:-1, 2]).all() and own[:, 2].sum() == counts[d]
    for s in range(pieces[-1, 3] + 1):
        own = pieces[pieces[:, 3] == s]
        size = int(own[:, 2].sum())
        assert (own[:, 4] == np.cumsum(own[:, 2]) - own[:, 2]).all()
        assert size == window or size & (size - 1) == 0


def test_related_documents_share_a_window():
    rare = [np.array([1000 + g, 2000 + g, 3000 + g]) for g in range(8)]
    docs = [np.concatenate([rare[k % 8], np.arange(5)]) for k in range(32)]
    pieces = pack_shard(np.concatenate(docs), np.full(32, 8), 32)
    for s in range(8):
        assert len({int(d) % 8 for d in pieces[pieces[:, 3] == s][:, 0]}) == 1


def test_pack(spark):
    rows = ODD + [(100 + k, words(k, 40 * (k % 9))) for k in range(60)]
    df = documents(spark, rows, extra=("n", "ids", "place", "offset")).repartition(4)
    found = pack(df, PATH, 256, shard_ids=2000, with_ids=True).collect()
    t = Tokenizer.from_file(PATH)
    want = sorted(((k is None, k), [*t.encode(x or "", add_special_tokens=False).ids, 1]) for k, x in rows)
    pieces, got = {}, []
    for r in found:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32
        pieces.setdefault(r.sequence_id, []).append(r)
    for own in pieces.values():
        own.sort(key=lambda r: r.offset)
        size = sum(r.length for r in own)
        assert [r.offset for r in own] == [sum(r.length for r in own[:k]) for k in range(len(own))]
        assert size == 256 or size < 256 and size & (size - 1) == 0
    # Repeated ids are told apart by their length.
    by = {}
    for r in found:
        by.setdefault((r.doc_id is None, r.doc_id), []).append(r)
    for key, own in by.items():
        if sum(k == key for k, _ in want) == 1:
            own.sort(key=lambda r: r.start)
            got.append((key, [i for r in own for i in np.frombuffer(r.ids, "<u4").tolist()]))
        else:
            assert sum(r.length for r in own) == sum(len(x) for k, x in want if k == key)
    assert sorted(got) == [w for w in want if sum(k == w[0] for k, _ in want) == 1]


def test_empty(spark):
    assert pack(documents(spark, []), PATH).collect() == []
