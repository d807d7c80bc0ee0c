"""Byte-pair encoding by tree concatenation, and decoding.

A text without a place to cut is halved until its pieces are short, the pieces are encoded on their
own, and neighbours are joined up the tree. At a join only a window of ids can change: it is encoded
anew and widened until its first and last id are those that stood there before. As every pair of
neighbouring ids is then one that some encoding has produced side by side, the result is the encoding
of the whole.

Spark deals long texts out as fragments: cut at blanks where there are any, and inside a pre-token
where there are none. Fragments are encoded by many tasks, and joined per text in order.

Nulls: a null text counts as empty: no ids, and the digests of the empty string. A null id, repeated
ids and repeated texts keep every row. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import binaries
from .tokens import UnitEncoder, blocks

#: Symbols of a leaf of the tree, and characters above which a text is dealt out as fragments.
LEAF, LONG = 256, 1 << 16


class TreeEncoder:
    """Encodes symbol strings (byte-level characters) that no pre-tokenizer cuts."""

    def __init__(self, path: str, leaf: int = LEAF) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        config = json.loads(self.tokenizer.to_str())
        self.closing = self.tokenizer.model
        config["model"]["end_of_word_suffix"] = None
        self.inner = Tokenizer.from_str(json.dumps(config)).model
        self.leaf = leaf
        self.suffix = self.closing.end_of_word_suffix or ""

    def piece(self, symbols: str, last: bool) -> list[tuple[int, str]]:
        """(id, its symbols) of a short piece; ``last``: the pre-token ends with it."""
        found = [(t.id, t.value) for t in (self.closing if last else self.inner).tokenize(symbols)]
        if last and found and self.suffix:
            found[-1] = (found[-1][0], found[-1][1].removesuffix(self.suffix))
        return found

    def tree(self, symbols: str, last: bool = True) -> list[tuple[int, str]]:
        """(id, symbols) of a pre-token of any length."""
        if len(symbols) <= self.leaf:
            return self.piece(symbols, last)
        half = len(symbols) // 2
        return self.join(self.tree(symbols[:half], False), self.tree(symbols[half:], last), last)

    def join(self, left: list[tuple[int, str]], right: list[tuple[int, str]], last: bool) -> list[tuple[int, str]]:
        """The ids of two neighbouring pieces together; ``last``: the pre-token ends with the right one."""
        if not left or not right:
            return left or right
        width = 2
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            inside = "".join(s for _, s in left[a:]) + "".join(s for _, s in right[:b])
            again = self.piece(inside, last and b == len(right))
            if (a == 0 or again[0] == left[a]) and (b == len(right) or again[-1] == right[b - 1]):
                return left[:a] + again + right[b:]
            width *= 2

    def pre_tokens(self, text: str) -> list[str]:
        """The symbol strings of a text's pre-tokens."""
        if self.tokenizer.normalizer is not None:
            text = self.tokenizer.normalizer.normalize_str(text)
        return [s for s, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]


class TreeUnits(UnitEncoder):
    """As its base, but units longer than a leaf go through the tree."""

    def __init__(self, path: str, keep_blanks: bool, leaf: int = LEAF) -> None:
        super().__init__(path, keep_blanks)
        self.path, self.leaf = path, leaf

    @cached_property
    def forest(self) -> TreeEncoder:
        """Made for the first long unit: it holds further copies of the vocabulary."""
        return TreeEncoder(self.path, self.leaf)

    def whole(self, texts: list[str]) -> list[list[int]]:
        short = [i for i, t in enumerate(texts) if len(t) <= self.leaf or any(a in t for a in self.added)]
        found: list[list[int]] = [[] for _ in texts]
        for i, ids in zip(short, super().whole([texts[i] for i in short]), strict=True):
            found[i] = ids
        for i in set(range(len(texts))) - set(short):
            found[i] = [x for s in self.forest.pre_tokens(texts[i]) for x, _ in self.forest.tree(s)]
        return found


_units: dict[tuple[str, bool, int], TreeUnits] = {}


def _encoder(path: str, keep_blanks: bool, leaf: int) -> TreeUnits:
    key = (path, keep_blanks, leaf)
    if key not in _units:
        _units[key] = TreeUnits(path, keep_blanks, leaf)
    return _units[key]


def encode(
    df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep_blanks: bool = False,
    leaf: int = LEAF, long: int = LONG,
) -> DataFrame:
    """(id, ``ids``: little-endian unsigned 32-bit ids) of every text."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            ids, counts = _encoder(tokenizer, keep_blanks, leaf).encode(block.column("text").combine_chunks())
            yield pa.RecordBatch.from_arrays([block.column("id").combine_chunks(), binaries(ids.astype("<u4"), counts)], ["id", "ids"])

    is_long = F.coalesce(F.length("text") > long, F.lit(False))
    short = rows.where(~is_long).mapInArrow(of, f"id {kind}, ids binary")
    if keep_blanks:
        # Blanks belong to ids here; only the units inside a task are cut.
        return short.unionByName(rows.where(is_long).mapInArrow(of, f"id {kind}, ids binary"))
    return short.unionByName(_encode_long(rows.where(is_long), kind, tokenizer, leaf, long))


def cut_long(text: str, long: int, units: TreeUnits) -> Iterator[tuple[str, int, str]]:
    """Fragments of a text: ("text", 1, words with their blanks), or ("symbols", ends pre-token, symbols)."""
    held: list[str] = []
    size = 0
    for word in text.encode().split():
        unit = word.decode()
        if len(unit) > long and not any(a in unit for a in units.added):
            if held:
                yield "text", 1, " ".join(held)
                held, size = [], 0
            for symbols in units.forest.pre_tokens(unit):
                for at in range(0, len(symbols), long):
                    yield "symbols", int(at + long >= len(symbols)), symbols[at : at + long]
            continue
        held.append(unit)
        size += len(unit) + 1
        if size >= long:
            yield "text", 1, " ".join(held)
            held, size = [], 0
    if held:
        yield "text", 1, " ".join(held)


def _encode_long(rows: DataFrame, kind: str, tokenizer: str, leaf: int, long: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _encoder(tokenizer, False, leaf)
        for batch in batches:
            for i in range(batch.num_rows):
                found = list(cut_long(batch.column("text")[i].as_py(), long // 4, units)) or [("text", 1, "")]
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array([i] * n)), batch.column("row").take(pa.array([i] * n)), pa.array(range(n)),
                     *(pa.array(x) for x in zip(*found))],
                    ["id", "row", "k", "kind", "last", "piece"],
                )

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _encoder(tokenizer, False, leaf)
        for batch in batches:
            found = []
            for what, last, piece in zip(*(batch.column(c).to_pylist() for c in ("kind", "last", "piece"))):
                if what == "text":
                    found.append(units.encode(pa.array([piece]))[0].tolist())
                else:
                    found.append([x for x, _ in units.forest.tree(piece, bool(last))])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "row", "k", "kind", "last")), pa.array(found, pa.list_(pa.int64()))],
                ["id", "row", "k", "kind", "last", "piece_ids"],
            )

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        units = _encoder(tokenizer, False, leaf)
        symbols = units.tokenizer.id_to_token
        out: list[int] = []
        open_: list[list[tuple[int, str]]] = []
        for what, last, ids in group.sort_values("k")[["kind", "last", "piece_ids"]].itertuples(index=False):
            if what == "text":
                out.extend(int(x) for x in ids)
                continue
            open_.append([(int(x), symbols(int(x))) for x in ids])
            if last:
                x, s = open_[-1][-1]
                open_[-1][-1] = (x, s.removesuffix(units.forest.suffix))
                out.extend(x for x, _ in join_all(open_, units.forest.join))
                open_ = []
        data = np.array(out, "<u4").tobytes()
        return pd.DataFrame({"id": group["id"].iloc[:1], "ids": [data]})

    # The row's own number keeps repeated and null ids apart; it is fixed by the scan.
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    pieces = numbered.mapInArrow(cut, f"id {kind}, row long, k long, kind string, last long, piece string")
    dealt = pieces.repartition("row", "k")
    encoded = dealt.mapInArrow(leaves, f"id {kind}, row long, k long, kind string, last long, piece_ids array<long>")
    return encoded.groupBy("row").applyInPandas(joined, f"id {kind}, ids binary")


def join_all(pieces: list, join: Callable) -> list:
    """Join the pieces of one pre-token pairwise, level by level; the last piece ends it."""
    while len(pieces) > 1:
        n = len(pieces)
        pieces = [join(pieces[i], pieces[i + 1], i + 2 >= n) if i + 1 < n else pieces[i] for i in range(0, n, 2)]
    return pieces[0]


def decoder(path: str) -> Callable[[list[int]], str]:
    """Decodes as the library does, special tokens kept; vocabularies without a decoder by a table."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    if tokenizer.decoder is not None:
        return lambda ids: tokenizer.decode(ids, skip_special_tokens=False)
    table = {i: t for t, i in tokenizer.get_vocab(with_added_tokens=True).items()}
    return lambda ids: " ".join(map(table.__getitem__, ids))


def digests(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded texts, which it decodes."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = decoder(tokenizer)
        decimal = [str(i) for i in range(1 << 16)]
        for batch in batches:
            n, shown, texts = [], [], []
            for data in batch.column("ids"):
                ids = np.frombuffer(data.as_buffer(), "<u4").tolist()
                n.append(len(ids))
                spelled = " ".join([decimal[i] if i < 65536 else str(i) for i in ids])
                shown.append(hashlib.sha256(spelled.encode()).hexdigest())
                texts.append(hashlib.sha256(decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(shown), pa.array(texts)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = encoded.schema["id"].dataType.simpleString()
    return encoded.mapInArrow(of, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
