"""Exact token ids of whole texts, each distinct unit of a block of texts encoded once.

A byte-pair tokenizer never joins symbols across the blanks at which its pre-tokenizer cuts, so a
text can be cut there, every distinct unit be encoded by the ``tokenizers`` library, and the ids be
gathered with array operations. The ids equal those of the library on the whole text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Spark already runs a task on every core; the library's own threads would only wait for each other.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Texts that are not cut at every blank: runs of blanks, blanks at either end, blank characters
#: outside ASCII and control characters that some engines take for blanks.
_UNEVEN = (
    r"\s\s|^\s|\s$|[\r\x0b\x1c-\x1f]"
    r"|[\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{206f}\x{3000}\x{feff}]"
)
#: A unit made of one run of Latin letters and perhaps one run of marks: two pre-tokens, whatever the
#: vocabulary, and already in composed form.
_PLAIN = r"^(?P<run>[ \r]?[A-Za-zß-öø-ÿÀ-ÖØ-Þ]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"
#: Distinct runs kept in a worker between blocks; they are learnt anew after that.
MAX_RUNS = 300_000
#: Characters encoded together.
BLOCK_CHARS = 8 << 20


def _byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if chr(b).isprintable() and b not in (32, 173)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTE_SYMBOLS = {b: c for b, c in _byte_symbols().items() if b != 10}


class UnitEncoder:
    """Encodes texts with the tokenizer in ``path``.

    ``keep_blanks``: the tokenizer's ids depend on blanks (byte-level vocabularies); otherwise its
    pre-tokenizer drops them (vocabularies with word ends).
    """

    def __init__(self, path: str, keep_blanks: bool, max_runs: int = MAX_RUNS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = "|".join(map(re.escape, self.added))
        self.keep_blanks, self.max_runs = keep_blanks, max_runs
        self._clear()

    def _clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.starts = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def whole(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text by the library itself."""
        if not texts:
            return []
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def units(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The units of all texts in one array, and the number of units of each text.

        With ``keep_blanks`` a unit stands for itself behind one space, but for two kinds: one that
        begins with a line end, and the first of a text, which begins with a carriage return.
        """
        if self.keep_blanks:
            lines = pc.replace_substring(texts, "\n", " \n")
            marked = pc.binary_join_element_wise(pa.scalar("\r", lines.type), lines, pa.scalar("", lines.type))
            lists = pc.split_pattern(marked, " ")
        else:
            lists = pc.ascii_split_whitespace(texts)
        return lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)

    def _spelled(self, unit: str) -> str:
        """The characters that a unit stands for."""
        if not self.keep_blanks or unit[:1] == "\n":
            return unit
        return unit[1:] if unit[:1] == "\r" else " " + unit

    def _numbered(self, runs: pa.Array, plain: bool) -> np.ndarray:
        """The number of every run (a pre-token, or a unit that is not ``plain``), new ones learnt."""
        coded = runs.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        known = self.codes
        # Pre-tokens carry a mark, so that they never meet a unit of the same spelling.
        names = distinct if plain else ["\0" + u for u in distinct]
        fresh = [i for i, u in enumerate(names) if u not in known]
        if fresh:
            first = len(known)
            known.update((names[i], first + k) for k, i in enumerate(fresh))
            spelled = [self._spelled(distinct[i]) for i in fresh]
            self._append(self._by_model(spelled) if plain else self.whole(spelled))
        table = np.fromiter(map(known.__getitem__, names), np.int64, len(names))
        return table[coded.indices.to_numpy(zero_copy_only=False)]

    def _by_model(self, runs: list[str]) -> list[list[int]]:
        """Ids of pre-tokens by the library's model alone: they need no further cutting."""
        # No pre-token that comes here holds a line end, so line ends can part them.
        symbols = "\n".join(runs).encode().decode("latin-1").translate(_BYTE_SYMBOLS).split("\n")
        tokenize = self.model.tokenize
        return [[t.id for t in tokenize(s)] for s in symbols]

    def _append(self, ids: list[list[int]]) -> None:
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum()))
        self.starts = np.concatenate([self.starts, np.cumsum(counts) - counts + len(self.flat)])
        self.counts = np.concatenate([self.counts, counts])
        self.flat = np.concatenate([self.flat, flat])

    def _even(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that may be cut at each blank: units, then their pre-tokens, then ids."""
        if len(self.codes) > self.max_runs:
            self._clear()
        units, per_text = self.units(texts)
        coded = units.dictionary_encode()
        distinct = coded.dictionary
        parts = pc.extract_regex(distinct, _PLAIN)
        special = pc.match_substring_regex(distinct, self.special) if self.special else pa.scalar(False)
        plain = pc.and_not(parts.is_valid(), special)
        is_plain = plain.to_numpy(zero_copy_only=False)
        head = np.zeros(len(distinct), np.int64)
        tail = np.zeros(len(distinct), np.int64)
        parts = parts.filter(plain)
        runs = parts.field("run")
        head[is_plain] = self._numbered(runs if self.keep_blanks else pc.utf8_lower(runs), True)
        head[~is_plain] = self._numbered(distinct.filter(pc.invert(plain)), False)
        # Marks follow their run directly, as the first pre-token of a text does.
        marks = parts.field("marks")
        if self.keep_blanks:
            marks = pc.binary_join_element_wise(pa.scalar("\r", marks.type), marks, pa.scalar("", marks.type))
        tail[is_plain] = self._numbered(marks, True)
        code = coded.indices.to_numpy(zero_copy_only=False)
        pair = np.empty((len(code), 2), np.int64)
        pair[:, 0], pair[:, 1] = head[code], tail[code]
        counts = self.counts[pair]
        counts[:, 1] *= is_plain[code]
        counts = counts.ravel()
        ids = self.flat[ragged(self.starts[pair.ravel()], counts)]
        upto = np.concatenate([[0], np.cumsum(counts.reshape(-1, 2).sum(1))])
        last = np.cumsum(per_text)
        return ids, upto[last] - upto[last - per_text]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: empty) in one array, and the number of ids of each text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.keep_blanks:
            return self._even(texts)
        uneven = pc.match_substring_regex(texts, _UNEVEN).to_numpy(zero_copy_only=False)
        ids, counts = self._even(texts.filter(pa.array(~uneven)))
        if not uneven.any():
            return ids, counts
        more = self.whole(texts.filter(pa.array(uneven)).to_pylist())
        order = np.argsort(np.concatenate([np.flatnonzero(~uneven), np.flatnonzero(uneven)]))
        counts = np.concatenate([counts, np.fromiter(map(len, more), np.int64, len(more))])
        ids = np.concatenate([ids, np.fromiter(chain.from_iterable(more), np.uint32)])
        starts = np.cumsum(counts) - counts
        return ids[ragged(starts[order], counts[order])], counts[order]


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions ``starts[i] .. starts[i] + counts[i] - 1`` of every i, one after the other."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


_encoders: dict[tuple[str, bool], UnitEncoder] = {}


def encoder(path: str, keep_blanks: bool) -> UnitEncoder:
    """One encoder a worker process, so that later tasks find its units."""
    key = (path, keep_blanks)
    if key not in _encoders:
        _encoders[key] = UnitEncoder(path, keep_blanks)
    return _encoders[key]


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = BLOCK_CHARS) -> Iterator[pa.Table]:
    """The rows of the batches in order, dealt into tables that hold about ``most`` bytes of ``column``."""
    rows: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        # Lengths count the bytes of this batch's own rows; a batch that is too large is cut.
        length = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        upto = np.cumsum(length.astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(upto[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(upto, before + most - size, "right")))
            rows.append(batch.slice(at, end - at))
            size += int(upto[end - 1]) - before
            at = end
            if size >= most or at < batch.num_rows:
                yield pa.Table.from_batches(rows)
                rows, size = [], 0
    if rows:
        yield pa.Table.from_batches(rows)
