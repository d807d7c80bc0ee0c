"""Conversation structure repair: the cheapest edits that make roles alternate, by run-length dynamic programming.

A conversation is well formed where the initials of its roles read ``(s?(ua)+)?``. Its rows, in order, are symbols
of a role and a fault; equal neighbours are one run. A symbol's effect is a min-plus matrix over four states
(nothing yet, after system, user, assistant), and a run's is a power of it, put together from cached squares. The
costs to the end are taken backwards over the runs, then the choices are unrolled forwards.

Keep costs 0, Rerole to user or assistant 3, Delete 4 (the only edit of a blank or duplicate row), Insert of an empty
user or assistant row 3; a truncated row that stays adds 3. Among the cheapest edit lists that with the least text counts.

Two exchanges carry rows. The first moves a few numbers a row: a conversation's symbols are read in order, a run at a
time, and only its runs are held, which are no more than the letters of its audit. A first occurrence is found by an
aggregate over (conversation, role and text) and joins the order as a mark before its row, so no list of seen
texts is held. The second moves texts, behind the audit of their conversation; they are hashed or given out as they pass.
A SHA-256 reads its text from end to end, so a conversation's texts pass one task, one Arrow batch at a time; the sort
in front of it spills.

Nulls in role, text and in the key of the damage count as one space; a null turn comes first. Rows of one turn are ordered by role, then
by the first ``TIE_CHARS`` characters of the text, then by a digest of both; equal rows are alike. A null conversation id is a
conversation like any other. Roles are told by their first character. A conversation without rows has zeros and empty texts. An empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant")
BLANKS = " \t\n\v\f\r"
TIE_CHARS = 64

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: 0 nothing yet, 1 + r after a row of role r. The role that follows next, other than a leading system row.
FOLLOWS = (1, 1, 2, 1)
ENDS = (0, 3)
_FAR = 1 << 40
#: Roles within symbols; 3 is any other. Faults: none, truncated, to be deleted.
OTHER = 3
FINE, CUT, LOST = 0, 1, 2
Vector = tuple[int, int, int, int]


def _keeps(state: int, role: int) -> bool:
    return role == FOLLOWS[state] or (role == 0 and state == 0)


def _edits(symbol: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, state behind) of the edits that take one row of this symbol, letters ascending."""
    role, fault = divmod(symbol, 3)
    yield "D", DELETE, state
    if fault != LOST:
        stays = TRUNCATED if fault == CUT else 0
        if _keeps(state, role):
            yield "K", KEEP + stays, 1 + role
        yield "R", REROLE + stays, 1 + FOLLOWS[state]


def _inserted(vector: Vector) -> Vector:
    """Costs to the end where rows may be inserted first."""
    found = list(vector)
    # At most two insertions reach any state that insertions reach.
    for _ in range(2):
        for state in range(4):
            found[state] = min(found[state], INSERT + found[1 + FOLLOWS[state]])
    return tuple(found)


def _times(matrix: tuple[Vector, ...], vector: Vector) -> Vector:
    return tuple(min(m + v for m, v in zip(line, vector)) for line in matrix)


class Repairs:
    """Least costs and audits of rows given as runs of symbols; matrices and choices are kept between conversations."""

    BLOCK = 4096

    def __init__(self) -> None:
        self._powers: dict[tuple[int, int], tuple[Vector, ...]] = {}
        self._ids: dict[Vector, int] = {}
        self._vectors: list[Vector] = []
        self._back: dict[tuple[int, int, int], tuple[int, int]] = {}
        self._choice: dict[tuple[int, int, int], tuple[str, int]] = {}

    def _power(self, symbol: int, k: int) -> tuple[Vector, ...]:
        """The transition of ``2**k`` rows: entry (from, to), insertions before each row included."""
        if (symbol, k) not in self._powers:
            if k:
                half = self._power(symbol, k - 1)
                columns = [_times(half, column) for column in zip(*half)]
            else:
                units = [tuple(0 if s == t else _FAR for s in range(4)) for t in range(4)]
                columns = [_inserted(tuple(min(c + u[b] for _, c, b in _edits(symbol, s)) for s in range(4))) for u in units]
            self._powers[symbol, k] = tuple(zip(*columns))
        return self._powers[symbol, k]

    def _id(self, vector: Vector) -> tuple[int, int]:
        """(number of the vector less its least entry, that entry)."""
        least = min(vector)
        shifted = tuple(v - least for v in vector)
        if shifted not in self._ids:
            self._ids[shifted] = len(self._vectors)
            self._vectors.append(shifted)
        return self._ids[shifted], least

    def _before(self, symbol: int, length: int, behind: int) -> tuple[int, int]:
        """Costs to the end before a run, from those behind it."""
        known = self._back.get((symbol, length, behind))
        if known is None:
            vector, k, left = self._vectors[behind], 0, length
            while left:
                if left & 1:
                    vector = _times(self._power(symbol, k), vector)
                left, k = left >> 1, k + 1
            known = self._back[symbol, length, behind] = self._id(vector)
        return known

    def _choose(self, symbol: int, state: int, behind: int) -> tuple[str, int]:
        """Letters up to and with the row's own edit, and the state behind it."""
        known = self._choice.get((symbol, state, behind))
        if known is None:
            after = self._vectors[behind]
            here = _times(self._power(symbol, 0), after)
            letters, now = "", state
            while True:
                edits = list(_edits(symbol, now))
                edits.insert(1, ("I", INSERT, -1))
                for letter, cost, then in edits:
                    rest = here[1 + FOLLOWS[now]] if letter == "I" else after[then]
                    if cost + rest == here[now]:
                        break
                letters += letter
                if letter != "I":
                    break
                now = 1 + FOLLOWS[now]
            known = self._choice[symbol, state, behind] = (letters, then)
        return known

    def audit(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[int, str]:
        """(cost, edits) of a conversation whose rows are these runs."""
        end, cost = self._id(_inserted(tuple(0 if s in ENDS else _FAR for s in range(4))))
        behind = array("q", bytes(8 * len(symbols)))
        at = end
        for i in range(len(symbols) - 1, -1, -1):
            behind[i] = at
            at, more = self._before(int(symbols[i]), int(lengths[i]), at)
            cost += more
        cost += self._vectors[at][0]
        state, said = 0, []
        for i, (symbol, length) in enumerate(zip(symbols.tolist(), lengths.tolist())):
            for done in range(0, length, self.BLOCK):
                # Inside a run only one block's costs are unrolled at a time.
                size = min(self.BLOCK, length - done)
                left = length - done - size
                costs = [behind[i] if not left else self._before(symbol, left, behind[i])[0]]
                for _ in range(size - 1):
                    costs.append(self._before(symbol, 1, costs[-1])[0])
                for c in reversed(costs):
                    letters, state = self._choose(symbol, state, c)
                    said.append(letters)
                said = ["".join(said)]
        while state not in ENDS:
            said.append("I")
            state = 1 + FOLLOWS[state]
        return cost, "".join(said)


def damaged(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows after planted faults, by crc32 of ``conv:turn`` modulo 20; dropped rows stay with ``mark`` 2."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv_col).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), space))
    fault = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), space) for c in (role_col, text_col))
    return df.select(
        F.col(conv_col).alias("id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.when(fault == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(fault == 0, F.array(F.lit(2))).when(fault == 3, F.array(F.lit(1), F.lit(1))).otherwise(F.array(F.lit(1)))).alias("mark"),
    )


def undamaged(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows of a table in the form that ``repairs`` takes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col))
    return df.select(F.col(conv_col).alias("id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.lit(1).alias("mark"))


def _keyed(rows: DataFrame) -> DataFrame:
    """With the keys of conversation and place: marked, so that a null id is a conversation like any other."""
    key = F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit(""))
    digest = F.unhex(F.md5(F.concat("role", F.lit("\0"), "text").cast("binary")))
    return rows.select("*", key.alias("key"), F.substring("text", 1, TIE_CHARS).alias("tie"), digest.alias("digest"))


def _in_order(df: DataFrame, *first: str) -> DataFrame:
    return df.repartition("key").sortWithinPartitions("key", *first, "turn", "role", "tie", "digest", "mark")


def _symbol() -> Column:
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER)
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(end == "", LOST).when(F.right(end, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(CUT)
    return (role * 3 + fault).cast("byte")


FOUND = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
_LEGAL = ((0, 1), (1, 2), (2, 1))


class _Reader:
    """The symbols of one conversation as they pass: runs, counts and turns."""

    def __init__(self, id_value: pa.Array) -> None:
        self.id = id_value
        self.symbols: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.counts = [0, 0, 0]
        self.illegal = self.distinct = 0
        self.first = self.last = None
        self.initial = -1

    def read(self, symbols: np.ndarray, repeated: np.ndarray, turns: np.ndarray) -> None:
        """Rows in order; ``repeated`` marks duplicates, ``turns`` are the known ones."""
        if len(turns):
            steps = int((turns[1:] != turns[:-1]).sum())
            self.distinct += steps + (self.last is None or turns[0] != self.last)
            self.first = turns[0] if self.first is None else self.first
            self.last = turns[-1]
        if not len(symbols):
            return
        roles, faults = symbols // 3, symbols % 3
        self.counts[0] += int((faults == LOST).sum())
        self.counts[1] += int(repeated.sum())
        self.counts[2] += int(((faults == CUT) & ~repeated).sum())
        left = np.concatenate([[self.initial], roles[:-1]])
        legal = np.zeros(len(roles), bool)
        for a, b in _LEGAL:
            legal |= (left == a) & (roles == b)
        self.illegal += int((~legal & (left >= 0)).sum())
        self.initial = roles[-1]
        symbols = np.where(repeated, roles * 3 + LOST, symbols)
        starts = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
        lengths = np.diff(np.append(starts, len(symbols)))
        symbols = symbols[starts].astype(np.int8)
        if self.symbols and self.symbols[-1][-1] == symbols[0]:
            self.lengths[-1][-1] += lengths[0]
            symbols, lengths = symbols[1:], lengths[1:]
        if len(symbols):
            self.symbols.append(symbols)
            self.lengths.append(lengths)

    def found(self, repairs: Repairs) -> tuple:
        none = np.zeros(0, np.int64)
        cost, audit = repairs.audit(np.concatenate([none, *self.symbols]), np.concatenate([none, *self.lengths]))
        gaps = int(self.last) - int(self.first) + 1 - self.distinct if self.first is not None else 0
        return gaps, *self.counts, self.illegal, cost, audit


def _same_as_before(keys: pa.Array, last: str | None) -> tuple[np.ndarray, bool]:
    """Where another key begins in a batch of sorted rows, and whether its first row goes on with ``last``."""
    codes = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return starts, keys[0].as_py() == last


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    repairs, open_one, last, marked = Repairs(), None, None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        done = []
        starts, goes_on = _same_as_before(batch["key"], last)
        marks = batch["mark"].to_numpy(zero_copy_only=False)
        symbols = batch["symbol"].to_numpy(zero_copy_only=False).astype(np.int64)
        turns = batch["turn"]
        known = turns.is_valid().to_numpy(zero_copy_only=False)
        turns = turns.fill_null(0).to_numpy(zero_copy_only=False)
        # The mark of a first occurrence stands right before its row.
        behind_mark = np.concatenate([[marked], marks[:-1] == 0])
        repeated = (marks == 1) & (symbols % 3 != LOST) & ~behind_mark
        for k, (a, b) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(marks)])):
            if k or not goes_on:
                if open_one is not None:
                    done.append(open_one)
                open_one = _Reader(batch["id"].slice(a, 1))
            rows = marks[a:b] == 1
            open_one.read(symbols[a:b][rows], repeated[a:b][rows], turns[a:b][rows & known[a:b]])
        last, marked = batch["key"][-1].as_py(), bool(marks[-1] == 0)
        if done:
            yield _table(done, repairs)
    if open_one is not None:
        yield _table([open_one], repairs)


def _table(done: list[_Reader], repairs: Repairs) -> pa.RecordBatch:
    columns = list(zip(*(r.found(repairs) for r in done)))
    names = [f.split()[0] for f in FOUND.split(", ")]
    arrays = [pa.array(c, pa.string() if n == "audit" else pa.int64()) for n, c in zip(names, columns)]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([r.id for r in done]), *arrays], ["id", *names])


def repairs(rows: DataFrame) -> DataFrame:
    """(id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation of ``damaged`` or ``undamaged`` rows."""
    narrow = _keyed(rows).select("id", "key", "turn", "role", "tie", "digest", "mark", _symbol().alias("symbol"))
    # The earliest turn of every text said; a null turn is the earliest.
    first = F.min(F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn")))
    said = narrow.where((F.col("mark") == 1) & (F.col("symbol") % 3 != LOST)).groupBy("key", "digest")
    marks = said.agg(first.alias("first"), F.max("id").alias("id"), F.max("role").alias("role"), F.max("tie").alias("tie"))
    marks = marks.select("id", "key", F.col("first.turn").alias("turn"), "role", "tie", "digest", F.lit(0).alias("mark"), F.lit(0).cast("byte").alias("symbol"))
    return _in_order(narrow.unionByName(marks)).select("id", "key", "turn", "mark", "symbol").mapInArrow(
        _audits, f"id {rows.schema['id'].dataType.simpleString()}, {FOUND}"
    )


class _Replay:
    """The rows that a conversation's edits leave, one at a time."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, 0

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            role = FOLLOWS[self.state]
            yield ROLES[role], ""
            self.at, self.state = self.at + 1, 1 + role

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = {"s": 1, "u": 2, "a": 3}[role[0]]
            yield role, text
        elif edit == "R":
            to = FOLLOWS[self.state]
            self.state = 1 + to
            yield ROLES[to], text


def _replayed(batches: Iterator[pa.RecordBatch], give: str) -> Iterator[pa.RecordBatch]:
    """Follow every audit over its rows: a digest a conversation, or the rows themselves."""
    replay = digest = found = None
    count = 0

    def take(rows, out: list) -> None:
        nonlocal count
        for role, text in rows:
            if give == "rows":
                out.append((found, count, role, text))
            else:
                digest.update(f"{chr(10) if count else ''}{role}:{text}".encode())
            count += 1

    def close(out: list) -> None:
        if replay is not None:
            take(replay.inserted(), out)
            if give != "rows":
                out.append((found, digest.hexdigest()))

    def table(out: list) -> pa.RecordBatch:
        heads = pa.Table.from_batches([o[0] for o in out]).combine_chunks().to_batches()[0]
        if give != "rows":
            return pa.RecordBatch.from_arrays([*heads.columns, pa.array([o[1] for o in out], pa.string())], [*heads.schema.names, "repaired_sha256"])
        more = [pa.array([o[k] for o in out], kind) for k, kind in ((1, pa.int64()), (2, pa.string()), (3, pa.string()))]
        return pa.RecordBatch.from_arrays([heads["id"], *more], ["id", "position", "role", "text"])

    names = ["id", *(f.split()[0] for f in FOUND.split(", "))]
    for batch in batches:
        out: list = []
        heads = batch.select(names)
        columns = (batch[c].to_pylist() for c in ("mark", "audit", "role", "text"))
        for i, (mark, audit, role, text) in enumerate(zip(*columns)):
            if mark == 0:
                close(out)
                replay, digest, found, count = _Replay(audit), hashlib.sha256(), heads.slice(i, 1), 0
            else:
                take(replay.row(role, text or ""), out)
        if out:
            yield table(out)
    out = []
    close(out)
    if out:
        yield table(out)


def _behind_audits(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Rows in order, behind a row with the audit of their conversation."""
    kept = F.when(F.rtrim(F.col("text"), F.lit(BLANKS)) != "", F.col("text"))
    moved = _keyed(rows.where("mark = 1")).select("id", "key", "turn", "role", "tie", "digest", "mark", kept.alias("text"))
    key = F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit(""))
    heads = audits.select("*", key.alias("key"), F.lit(0).alias("mark"))
    return _in_order(moved.unionByName(heads, allowMissingColumns=True), "mark").select("mark", "role", "text", *audits.columns)


def digests(rows: DataFrame) -> DataFrame:
    """``repairs`` with ``repaired_sha256``: the digest of the repaired ``role:text`` lines."""
    audits = repairs(rows)
    kind = audits.schema["id"].dataType.simpleString()
    return _behind_audits(rows, audits).mapInArrow(lambda b: _replayed(b, "digests"), f"id {kind}, {FOUND}, repaired_sha256 string")


def repaired(rows: DataFrame) -> DataFrame:
    """(id, position, role, text): the rows of every conversation after its cheapest edits."""
    audits = repairs(rows)
    kind = audits.schema["id"].dataType.simpleString()
    return _behind_audits(rows, audits).mapInArrow(lambda b: _replayed(b, "rows"), f"id {kind}, position bigint, role string, text string")
