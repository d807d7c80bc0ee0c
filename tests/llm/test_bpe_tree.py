import hashlib
import random

import public_tokenizers
import pytest
from helpers import ODD, documents
from tokenizers import Tokenizer

from commitflow.llm.bpe_tree import TreeEncoder, digests, encode

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("alphabet", ["ab", "a", "theing", "abcdefghijklmnopqrstuvwxyz", "éèà", "!?.,"])
def test_tree_is_the_librarys_encoding(alphabet):
    whole, tree, r = Tokenizer.from_file(PATH), TreeEncoder(PATH, leaf=8), random.Random(2)
    for _ in range(40):
        text = "".join(r.choices(alphabet, k=r.randint(1, 600)))
        assert [i for s in tree.pre_tokens(text) for i, _ in tree.tree(s)] == whole.encode(text, add_special_tokens=False).ids


def library(rows):
    t = Tokenizer.from_file(PATH)
    out = []
    for k, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        shown = " ".join(map(str, ids))
        decoded = t.decode(ids, skip_special_tokens=False)
        out.append((k is None, k, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (shown, decoded))))
    return sorted(out)


@pytest.mark.parametrize(("leaf", "long"), [(256, 1 << 16), (16, 400)])
def test_digests(spark, leaf, long):
    # The second case deals all but short texts out as fragments, and cuts unsplit runs.
    rows = ODD + [(20, "Ab" * 5000 + " tail " + "é!" * 900), (21, "word " * 2000)]
    df = documents(spark, rows, extra=("id", "ids", "row", "piece")).repartition(3)
    found = digests(encode(df, PATH, leaf=leaf, long=long), PATH)
    assert sorted((r[0] is None, *r) for r in found.collect()) == library(rows)


def test_empty(spark):
    assert digests(encode(documents(spark, []), PATH), PATH).collect() == []
