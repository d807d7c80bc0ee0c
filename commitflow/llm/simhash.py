"""SimHash fingerprints, and a binary-trie self-join that links those a few bits apart.

The distinct fingerprints are the leaves of a binary trie. A join walks pairs of its nodes together,
adds up the bits in which the two paths differ, and drops a pair as soon as they exceed the budget.
Spark deals the work out: the top of the trie is cut into subtrees of bounded size, one walk over
their pairs decides which can still hold links, and each such pair is one group. Links inside a task
are reduced to a spanning forest, so that a dense cluster costs at most one link a leaf and task.

``near_duplicates`` links fingerprints within a few bits. ``near_documents`` links texts by the
similarity of their shingles: texts at 0.8 differ in about 10 bits of 64, a budget at which one trie
would prune nothing. It takes fingerprints of 512 bits and joins several tries, each over a few of
these bits with a small budget; a pair found in any of them is measured on all 512. Their number
follows from the share of pairs to be found, and grows slowly with the number of texts.

Nulls: a null text counts as empty; texts without words have fingerprint zero and are linked like any
other; a null id keeps its row and its fingerprint. Repeated ids and texts keep every row. An empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, forest
from .shared import join_sized, written

#: Leaves of a subtree: about a 32nd of all, between these bounds.
LEAST_LEAVES, MOST_LEAVES = 4096, 1 << 20
#: Node pairs walked at a time, links kept before they are reduced to a forest, keys of a trie's leaf.
CHUNK, HELD, LEAF = 1 << 14, 1 << 19, 16
#: Bits of a wide fingerprint; of these a trie's keys take ``KEY_BITS`` with ``KEY_BUDGET`` errors. A trie
#: of more than about ``TRIE_KEYS`` keys is parted by further bits, which must be equal.
WIDE, KEY_BITS, KEY_BUDGET, TRIE_KEYS = 512, 24, 2, 1 << 18
#: Standard deviations that a pair's differing bits may lie above those expected at the least similarity.
MARGIN = 1.5


def fingerprint(text: str | None, width: int = 4) -> int:
    """The 64-bit fingerprint of one text: bits set in over half of its shingles' hashes."""
    hashes = shingle_hashes(text, width)
    return bits_over_half(hashes) if len(hashes) else 0


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each shingle of ``width`` words, or of the whole sequence where there are fewer."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - width + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1])
    stops = ends[-n:] if len(words) >= width else ends[-1:]
    return np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts.tolist(), stops.tolist())), np.uint64, n)


def bits_over_half(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def wide_fingerprint(text: str | None, width: int = 5) -> bytes:
    """The ``WIDE`` bits of one text: those set in over half of its distinct shingles' hashes."""
    hashes = np.unique(shingle_hashes(text, width))
    counts = np.zeros((WIDE // 64, 8, 8), np.int64)
    steps = np.arange(1, WIDE // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ones = np.uint64(0x0101010101010101)
    for at in range(0, len(hashes), 255 * 64):
        # Each shingle's hash is stretched to WIDE bits by a mixing function.
        x = hashes[at : at + 255 * 64, None] + steps
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        for bit in range(8):
            # Eight counters of a byte share a word: 255 additions fit.
            lanes = np.add.reduceat((x >> np.uint64(bit)) & ones, np.arange(0, len(x), 255), axis=0)
            counts[:, :, bit] += lanes.view(np.uint8).reshape(len(lanes), -1, 8).sum(axis=0, dtype=np.int64)
    return np.packbits((2 * counts > len(hashes)).reshape(-1)).tobytes()


def with_fingerprint(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ``fp``) of every row; ``fp`` holds the 64 bits in a signed long."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["id", "fp"])

    kept = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(of, f"id {kept.schema['id'].dataType.simpleString()}, fp long")


class Trie:
    """The binary trie over sorted distinct keys, from bit ``depth`` on; one level a time.

    Leaves hold up to ``LEAF`` keys. A level has the children of its inner nodes, one for each side:
    the child's number among the next level's inner nodes, ``~leaf`` for a leaf, or ``NONE``.
    """

    NONE = np.iinfo(np.int64).min

    def __init__(self, keys: np.ndarray, depth: int = 0) -> None:
        self.levels: list[np.ndarray] = []
        lows, sizes, leaves = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        low, high = np.array([0]), np.array([len(keys)])
        if len(keys) <= LEAF:
            lows, sizes, low, high = [low], [high], low[:0], high[:0]
        for bit in range(63 - depth, -1, -1):
            if not len(low):
                break
            # Keys below a node are sorted: those with the bit follow those without it.
            with_bit = np.concatenate([[0], np.cumsum((keys >> np.uint64(bit)) & np.uint64(1))]).astype(np.int64)
            cut = high - (with_bit[high] - with_bit[low])
            starts, size = np.stack([low, cut], 1), np.stack([cut - low, high - cut], 1)
            leaf, inner = (size > 0) & (size <= LEAF), size > LEAF
            child = np.full((len(low), 2), self.NONE, np.int64)
            n = int(leaf.sum())
            child[leaf] = ~np.arange(leaves, leaves + n)
            child[inner] = np.arange(int(inner.sum()))
            lows.append(starts[leaf])
            sizes.append(size[leaf])
            leaves += n
            self.levels.append(child)
            low, high = starts[inner], starts[inner] + size[inner]
        self.low, self.size = np.concatenate(lows), np.concatenate(sizes)
        self.padded = np.concatenate([keys, np.zeros(LEAF, np.uint64)])
        self.root = -1 if len(keys) <= LEAF else 0


def trie_links(a: np.ndarray, b: np.ndarray | None, budget: int, depth: int, spent: int, bits: int = 64) -> Iterator[tuple]:
    """Chunks of links (position in ``a``, in ``b``) between the sorted keys of two subtrees of one depth.

    ``b`` None joins ``a`` with itself, each pair once. ``spent``: differing bits above the subtrees.
    Only the leading ``bits`` count; those behind them tell equal keys apart.
    """
    left = Trie(a, depth)
    right = left if b is None else Trie(b, depth)
    if not len(a) or b is not None and not len(b):
        return
    stack = [(0, np.array([left.root]), np.array([right.root]), np.array([spent], np.int8))]
    while stack:
        level, i, j, d = stack.pop()
        if len(i) > CHUNK:
            half = len(i) // 2
            stack.append((level, i[half:], j[half:], d[half:]))
            i, j, d = i[:half], j[:half], d[:half]
        leaf = (i < 0) & (j < 0)
        if leaf.any():
            u, v = _leaf_links(left, right, ~i[leaf], ~j[leaf], budget, b is None, bits)
            if len(u):
                yield u, v
            i, j, d = i[~leaf], j[~leaf], d[~leaf]
        if not len(i):
            continue
        found = []
        both = (i >= 0) & (j >= 0)
        p, q, e = i[both], j[both], d[both]
        cp, cq = left.levels[level][p] if len(p) else None, right.levels[level][q] if len(q) else None
        for x in (0, 1) if len(p) else ():
            for y in (0, 1):
                u, v, f = cp[:, x], cq[:, y], e + np.int8(x != y and depth + level < bits)
                keep = (u != Trie.NONE) & (v != Trie.NONE) & (f <= budget)
                if b is None and (x, y) == (1, 0):
                    keep &= p != q  # the mirror of (0, 1) inside one node
                found.append((u[keep], v[keep], f[keep]))
        # A leaf waits for the other side to reach one; bits below it count when its keys are compared.
        for wait in (i < 0, j < 0):
            if wait.any():
                p, q, e = i[wait], j[wait], d[wait]
                for x in (0, 1):
                    u, v = (p, right.levels[level][q][:, x]) if p[0] < 0 else (left.levels[level][p][:, x], q)
                    keep = (u != Trie.NONE) & (v != Trie.NONE)
                    found.append((u[keep], v[keep], e[keep]))
        stack.append((level + 1, *(np.concatenate(z) for z in zip(*found))))


def _leaf_links(left: Trie, right: Trie, i: np.ndarray, j: np.ndarray, budget: int, own: bool, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the keys of pairs of leaves."""
    at, unused = np.arange(LEAF), np.uint64(64 - bits)
    u, v = left.low[i][:, None] + at, right.low[j][:, None] + at
    near = np.bitwise_count((left.padded[u][:, :, None] ^ right.padded[v][:, None, :]) >> unused) <= budget
    pair, x, y = np.nonzero(near)
    keep = (x < left.size[i[pair]]) & (y < right.size[j[pair]])
    u, v = left.low[i[pair[keep]]] + x[keep], right.low[j[pair[keep]]] + y[keep]
    if own:
        # A leaf meets itself: each pair of its keys once.
        once = (i != j)[pair[keep]] | (u < v)
        u, v = u[once], v[once]
    return u, v


def _subtrees(prints: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(first key, depth) of subtrees that part the key space; those above the size bound are split.

    Only counts of heavy nodes reach the driver: at most 16 children for every ``LEAST_LEAVES`` (or a
    32nd of all) keys and level.
    """
    most = min(MOST_LEAVES, max(LEAST_LEAVES, total // 32))
    done: list[tuple[int, int]] = []
    heavy: list[int] = [0]
    if total <= most:
        return np.array([0], np.uint64), np.array([0])
    for depth in range(4, 65, 4):
        node = F.shiftrightunsigned("fp", 64 - depth)
        rows = prints
        if depth > 4:
            rows = prints.where(F.shiftrightunsigned("fp", 68 - depth).isin(heavy))
        sizes = {int(r.node) % (1 << 64): r.n for r in rows.groupBy(node.alias("node")).agg(F.count("*").alias("n")).collect()}
        split = []
        for parent in heavy:
            for child in range(16 * (parent % (1 << 64)), 16 * (parent % (1 << 64)) + 16):
                if sizes.get(child, 0) > most and depth < 64:
                    split.append(child)
                else:
                    done.append((child << (64 - depth), depth))
        heavy = split
        if not heavy:
            break
    done.sort()
    return np.array([x for x, _ in done], np.uint64), np.array([d for _, d in done])


def _subtree_pairs(first: np.ndarray, depth: np.ndarray, budget: int) -> list[list[tuple[int, int]]]:
    """For each subtree the (pair id, side) of every pair of subtrees within the budget.

    Subtrees of different depth meet at the shallower depth, as in a walk from the root.
    """
    n = len(first)
    of: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for i in range(n):
        j = np.arange(i, n)
        shared = np.minimum(depth[i], depth[j]).astype(np.uint64)
        differing = np.where(shared == 0, np.uint64(0), (first[i] ^ first[j]) >> (np.uint64(64) - np.maximum(shared, np.uint64(1))))
        for k in j[np.bitwise_count(differing) <= budget].tolist():
            pair = i * n + k
            of[i].append((pair, 0))
            if k != i:
                of[k].append((pair, 1))
    return of


def fingerprint_links(prints: DataFrame, budget: int = 4) -> DataFrame:
    """(a, b): links whose components are those of all pairs of distinct ``fp`` within ``budget`` bits."""
    spark = prints.sparkSession
    first, depth = _subtrees(prints, prints.count())
    of = _subtree_pairs(first, depth, budget)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each task sends its keys of a subtree, as one array, to every pair of that subtree."""
        keys = [np.asarray(b.column(0)).view(np.uint64) for b in batches]
        if not keys:
            return
        key = np.sort(np.concatenate(keys))
        node = np.searchsorted(first, key, "right") - 1
        for x in np.unique(node).tolist():
            data = key[node == x].tobytes()
            pairs, sides = zip(*of[x])
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs, pa.int64()), pa.array(sides, pa.int32()), pa.array([data] * len(pairs), pa.binary())],
                ["pair", "side", "keys"],
            )

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        pair = int(group["pair"].iloc[0])
        i, j = divmod(pair, len(first))
        sides = [
            np.sort(np.frombuffer(b"".join(group.loc[group["side"] == s, "keys"]), np.uint64)) for s in ((0, 1) if i != j else (0,))
        ]
        a, b = sides[0], sides[1] if i != j else None
        shared = int(min(depth[i], depth[j]))
        spent = int((int(first[i] ^ first[j]) >> (64 - shared)).bit_count()) if shared else 0
        nodes = a if b is None else np.concatenate([a, b])
        label = np.arange(len(nodes))
        held: list[tuple] = []
        size = 0
        for u, v in trie_links(a, b, budget, shared, spent):
            held.append((u, v if b is None else v + len(a)))
            size += len(u)
            if size > HELD:
                label, held, size = forest(label, held), [], 0
        label = forest(label, held)
        own = np.flatnonzero(label != np.arange(len(nodes)))
        return pd.DataFrame({"a": nodes[own].view(np.int64), "b": nodes[label[own]].view(np.int64)})

    placed_rows = prints.select("fp").mapInArrow(placed, "pair long, side int, keys binary")
    return placed_rows.groupBy("pair").applyInPandas(joined, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 4) -> DataFrame:
    """(id, fingerprint, component_id) of every row: the smallest id linked to it, directly or not."""
    prints = written(with_fingerprint(df, id_col, text_col), "prints")
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("least")), "fingerprints")
    linked = components(fingerprint_links(distinct, budget))
    # Fingerprints without a link are their own component; only linked ones are joined.
    named = distinct.join(linked, distinct.fp == linked.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = written(named, "named")
    least = written(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size")), "component-ids")
    # A large component is one root.
    smallest = join_sized(named, least, "root", "size").select("fp", "component_id")
    out = prints.join(smallest, "fp")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def differing_share(similarity: float) -> float:
    """Expected share of differing bits of two texts whose shingle sets have this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def wide_limit(similarity: float) -> int:
    """Differing bits of ``WIDE`` up to which a pair counts as similar."""
    p = differing_share(similarity)
    return int(WIDE * p + MARGIN * math.sqrt(WIDE * p * (1 - p)))


def trie_bits(total: int, similarity: float, recall: float) -> tuple[int, list[np.ndarray]]:
    """(routing bits, the bits of each trie's keys, routing bits first).

    A pair at the least similarity meets in one trie with probability ``one``; so many tries are taken that it meets in
    any with probability ``recall``. Up to ``WIDE`` bits the tries share none.
    """
    route = max(0, math.ceil(math.log2(max(1, total) / TRIE_KEYS)))
    p = differing_share(similarity)
    one = (1 - p) ** route * sum(math.comb(KEY_BITS, k) * p**k * (1 - p) ** (KEY_BITS - k) for k in range(KEY_BUDGET + 1))
    tries = max(1, math.ceil(math.log(1 - recall) / math.log(1 - one)))
    rng, taken = np.random.default_rng(1), []
    while len(taken) < tries:
        order = rng.permutation(WIDE)
        taken += [order[k : k + route + KEY_BITS] for k in range(0, WIDE - route - KEY_BITS + 1, route + KEY_BITS)]
    return route, taken[:tries]


def _number(prints: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The number that the given bits of each fingerprint (a row of bytes) spell."""
    out = np.zeros(len(prints), np.uint64)
    for bit in bits.tolist():
        out = out << np.uint64(1) | ((prints[:, bit // 8] >> np.uint8(7 - bit % 8)) & np.uint8(1)).astype(np.uint64)
    return out


def wide_links(classes: DataFrame, similarity: float, recall: float) -> DataFrame:
    """(a, b): links between the ``class`` numbers of similar distinct ``print`` values.

    A group is one trie, or the part of it with equal routing bits. It holds about ``TRIE_KEYS`` keys whatever the table's
    size, and each fingerprint goes to one group a trie.
    """
    route, tries = trie_bits(classes.count(), similarity, recall)
    limit = wide_limit(similarity)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = np.asarray(batch.column(0))
            prints = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, WIDE // 8)
            groups, nodes, data = [], [], []
            for t, bits in enumerate(tries):
                part = _number(prints, bits[:route])
                order = np.argsort(part, kind="stable")
                values, starts = np.unique(part[order], return_index=True)
                for value, rows in zip(values.tolist(), np.split(order, starts[1:])):
                    groups.append(t << route | value)
                    nodes.append(numbers[rows].tobytes())
                    data.append(prints[rows].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(groups, pa.int64()), pa.array(nodes, pa.binary()), pa.array(data, pa.binary())],
                ["part", "nodes", "prints"],
            )

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        bits = tries[int(group["part"].iloc[0]) >> route][route:]
        nodes = np.frombuffer(b"".join(group["nodes"]), np.int64)
        prints = np.frombuffer(b"".join(group["prints"]), np.uint8).reshape(-1, WIDE // 8)
        key = _number(prints, bits)
        order = np.argsort(key, kind="stable")
        unused = np.uint64(64 - KEY_BITS)
        key = key[order] << unused | np.arange(len(key), dtype=np.uint64)
        nodes, words = nodes[order], prints[order].view(np.uint64)
        label, held, size = np.arange(len(nodes)), [], 0
        for u, v in trie_links(key, None, KEY_BUDGET, 0, 0, KEY_BITS):
            for at in range(0, len(u), HELD):
                x, y = u[at : at + HELD], v[at : at + HELD]
                # Those that are linked already need no measuring.
                apart = label[x] != label[y]
                x, y = x[apart], y[apart]
                near = np.bitwise_count(words[x] ^ words[y]).sum(axis=1, dtype=np.int64) <= limit
                held.append((x[near], y[near]))
                size += int(near.sum())
                if size > HELD // 8:
                    label, held, size = forest(label, held), [], 0
        label = forest(label, held)
        own = np.flatnonzero(label != np.arange(len(nodes)))
        return pd.DataFrame({"a": nodes[own], "b": nodes[label[own]]})

    rows = classes.select("class", "print").mapInArrow(placed, "part long, nodes binary, prints binary")
    return rows.groupBy("part").applyInPandas(joined, "a long, b long")


def near_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, recall: float = 0.97
) -> DataFrame:
    """(id, component_id) of every row: the smallest id among texts linked to it, directly or not.

    Texts are linked where the Jaccard similarity of their shingles of ``width`` words, as estimated from wide
    fingerprints, is ``similarity`` or more. The estimate's limit lies ``MARGIN`` standard deviations below, so that pairs at
    the limit are found; at 0.8 some pairs from 0.72 on are linked too. Texts without words are copies of each other.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [wide_fingerprint(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary())], ["id", "print"])

    kept = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    prints = written(kept.mapInArrow(of, f"id {kept.schema['id'].dataType.simpleString()}, print binary"), "wide-prints")
    classes = prints.groupBy("print").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    classes = written(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    linked = components(wide_links(classes, similarity, recall))
    root = F.coalesce("root", "class").alias("root")
    named = written(classes.join(linked, classes["class"] == linked.node, "left").select("print", "least", "copies", root), "wide-named")
    least = written(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size")), "wide-ids")
    smallest = written(join_sized(named, least, "root", "size").select("print", "copies", "component_id"), "smallest")
    # Many copies of a text are one fingerprint.
    return join_sized(prints, smallest, "print", "copies").select(F.col("id").alias(id_col), "component_id")
