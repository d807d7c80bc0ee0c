import hashlib
import random
import sys
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from commitflow.llm.conversations import Repairs, damaged, digests, repaired, repairs, undamaged

SCHEMA = "conv_id long, turn long, role string, text string"
sys.setrecursionlimit(100_000)
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
NAMES = {"u": "user", "a": "assistant"}


def best(rows):
    """Least (cost, edits) over every edit list, rows as (initial, fault)."""

    @lru_cache(None)
    def go(i, state, inserts):
        found = [(0, "")] if i == len(rows) and state in ("", "a") else []
        follows = "a" if state == "u" else "u"
        if inserts < 3:
            c, e = go(i, follows, inserts + 1)
            found.append((c + 3, "I" + e))
        if i < len(rows):
            initial, fault = rows[i]
            c, e = go(i + 1, state, 0)
            found.append((c + 4, "D" + e))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if initial == follows or (initial == "s" and state == ""):
                    c, e = go(i + 1, initial, 0)
                    found.append((c + more, "K" + e))
                c, e = go(i + 1, follows, 0)
                found.append((c + 3 + more, "R" + e))
        return min(found) if found else (1 << 40, "")

    return go(0, "", 0)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        role, text = show(role), show(text)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def want(rows, damaging=True):
    """Everything from the rows of one conversation."""
    rows = damage(rows) if damaging else [(c, t, *(" " if v is None else v for v in (r, x))) for c, t, r, x in rows]
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, faults = set(), []
    for _, _, role, text in rows:
        end = text.rstrip(" \t\n\v\f\r")
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end[-1] in ".!?" else "truncated")
        seen.add((role, text))
    initials = [r[2][:1] for r in rows]
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit = best(tuple(zip(initials, faults)))
    lines, state, left = [], "", iter(rows)
    for edit in audit:
        follows = "a" if state == "u" else "u"
        row = None if edit == "I" else next(left)
        if edit == "D":
            continue
        state = row[2][0] if edit == "K" else follows
        lines.append(f"{row[2] if edit == 'K' else NAMES[follows]}:{row[3] if row else ''}")
    sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)


def grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(tuple(r))
    return out


def check(found, rows, damaging=True):
    got = {r["id"]: tuple(r[c] for c in COLUMNS) for r in found}
    assert got == {conv: want(r, damaging) for conv, r in grouped(rows).items()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_tables(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet")
    check(digests(damaged(df)).collect(), [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def rows_of(seed, conversations=60):
    r = random.Random(seed)
    out = []
    for conv in range(conversations):
        for _ in range(r.randint(1, 14)):
            out.append((conv, r.choice([None, *range(9)]), r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "admin"]),
                        r.choice(["a.", "b", "c!", " \n", "", None, "d? \t", "é", "a."])))
    return out


def test_random_conversations(spark):
    for damaging in (True, False):
        rows = rows_of(3 + damaging)
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        check(digests((damaged if damaging else undamaged)(df)).collect(), rows, damaging)


def test_runs_against_every_edit_list():
    r, repair = random.Random(1), Repairs()
    kinds = ["", "truncated", "blank"]
    for _ in range(400):
        rows = [x for _ in range(r.randint(0, 5)) for x in [(r.choice("suax"), r.choice(kinds))] * r.randint(1, 6)]
        runs = []
        for role, fault in rows:
            symbol = "suax".index(role) * 3 + kinds.index(fault)
            if runs and runs[-1][0] == symbol:
                runs[-1][1] += 1
            else:
                runs.append([symbol, 1])
        symbols, lengths = np.array(runs, np.int64).reshape(-1, 2).T
        assert repair.audit(symbols, lengths) == best(tuple(rows))


def test_long_runs():
    repair = Repairs()
    # Of n user rows: (Keep, Insert) costs 3 a row, so does a Rerole of every second one with half the rows.
    cost, audit = repair.audit(np.array([3]), np.array([100_000]))
    assert cost == 50_000 * 3 and audit == "KR" * 50_000
    cost, audit = repair.audit(np.array([5, 3]), np.array([1_000_001, 1]))
    assert cost == 4 * 1_000_001 + 3 and audit == "D" * 1_000_001 + "KI"


def test_one_hot_conversation_and_batches(spark):
    """A conversation over many Arrow batches, its runs and first occurrences across their ends."""
    rows = [(1, t, "user" if t % 7 else "assistant", f"t{t % 50}.") for t in range(700)] + [(2, 0, "user", "x."), (None, None, "user", "y.")]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        check(digests(damaged(spark.createDataFrame(rows, SCHEMA))).collect(), rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_repaired_rows(spark):
    rows = rows_of(9)
    got = repaired(undamaged(spark.createDataFrame(rows, SCHEMA))).orderBy("id", "position").collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r)
    for conv, mine in grouped(rows).items():
        left = by.get(conv, [])
        initials = "".join(r.role[0] for r in left)
        body = initials[1:] if initials[:1] == "s" else initials
        assert body == "ua" * (len(body) // 2) and (body or not initials) and [r.position for r in left] == list(range(len(left)))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in left).encode()).hexdigest() == want(mine, False)[-1]


def test_odd_tables(spark):
    assert digests(damaged(spark.createDataFrame([], SCHEMA))).collect() == []
    # Conversation and turn of a row that the damage drops.
    turn = next(t for t in range(100) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(5, turn, "user", "x")], SCHEMA)
    clashing = df.select("*", *(F.lit("c").alias(c) for c in ("id", "mark", "key", "symbol", "audit", "digest", "tie")))
    (r,) = digests(damaged(clashing)).collect()
    assert (r.id, r.gaps, r.blank, r.cost, r.audit, r.repaired_sha256) == (5, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    names = spark.createDataFrame([("a", 1, "user", "x" * 2_000_000 + "."), ("a", 2, "assistant", "y.")], "conv_id string, turn long, role string, text string")
    (r,) = digests(undamaged(names)).collect()
    assert (r.id, r.cost, r.audit) == ("a", 0, "KK")
    assert repairs(undamaged(names)).columns == ["id", *COLUMNS[:-1]]
