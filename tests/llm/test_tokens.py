import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from commitflow.llm.tokens import UnitEncoder, blocks, ragged

NAMES = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]
ENCODERS = {n: UnitEncoder(public_tokenizers.path(n), k) for n, k in NAMES}
ODD = st.text(alphabet=st.sampled_from(list("aB é'\n\t\r  ,.1|<>endoftextİſ́\x1c\x0b　")), max_size=40)


def check(name, texts):
    encoder = ENCODERS[name]
    ids, counts = encoder.encode(pa.array(texts, pa.string()))
    want = encoder.whole([t or "" for t in texts])
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("name", ENCODERS)
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), ODD, st.text(max_size=30)), max_size=5))
def test_ids_are_the_librarys(name, texts):
    check(name, texts)


@pytest.mark.parametrize("name", ENCODERS)
def test_blanks_and_special_tokens(name):
    check(name, ["a  b", " a", "a ", "x <|endoftext|> y", "<|endoftext|>", "it's don't\nA\n\nb", None, "", "a\rb"])


def test_forgets_runs():
    encoder = UnitEncoder(public_tokenizers.path("word_bpe_49k.json"), False, max_runs=3)
    for text in ("one two three four five", "six one seven", "one"):
        assert encoder.encode(pa.array([text]))[0].tolist() == encoder.whole([text])[0]


def test_blocks_keep_all_rows_in_order():
    table = pa.table({"text": ["a" * k for k in range(50)], "n": range(50)})
    for most in (1, 30, 10_000):
        found = list(blocks(table.to_batches(max_chunksize=7), "text", most))
        assert [x for b in found for x in b.column("n").to_pylist()] == list(range(50))


def test_ragged():
    assert ragged(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
    assert ragged(np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []
