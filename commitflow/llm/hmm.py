"""A hidden Markov language model over whole texts.

Every word has a symbol: frequent words their own, the others one for their ending, and a document's end
has one too. States emit symbols, and a symbol emits its words by their counts, one share kept for
unknown words. So what a state must learn is bounded, while the counts of words grow with the corpus: they
are summed over all training documents and joined back to each block's distinct words, never to a
driver's table.

Baum-Welch runs as Spark jobs: tasks walk forward and backward over the symbols of their documents and
emit expected counts, which are summed per symbol. The first pass updates the model after each of several
slices of the corpus, the later passes after all of it; every training document takes part in each pass.
Training walks in segments of a document; scoring is the scaled forward recursion over the whole text.

Nulls: a null text counts as empty: its only token is the end. A null id keeps its row and counts as not
held out. Repeated rows keep their number and weight. An empty table gives no rows; a table without
training documents scores every token as unknown.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc_mod, written
from .tokens import blocks

#: Latent states, words with a symbol of their own, symbols of endings, characters of an ending.
STATES, OWN, ENDINGS, ENDING = 6, 4096, 2048, 3
#: Slices of the first pass, passes over the whole corpus behind it, tokens of a training segment.
SLICES, PASSES, SEGMENT = 6, 2, 256
#: Characters whose distinct words are looked up together; segments walked together.
BLOCK, TOGETHER = 32 << 20, 2048
#: Bytes of a block whose words are split at a time; rows of words that leave a task at a time.
SPLIT, ROWS = 2 << 20, 1 << 15
#: Pseudo-counts of a state's emissions (shared by the symbols' frequencies) and transitions.
PRIOR, STICKY = 50.0, 10.0


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of the texts, the number of each word in order, and each text's words."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    edges = [0, *(np.flatnonzero(np.diff(size // SPLIT)) + 1).tolist(), len(texts)]
    sizes, coded = [], []
    # Single words are held of a part only: beside them a block keeps a number a word.
    for a, b in zip(edges, edges[1:]):
        # Arrow lowers a slice wrongly once it is cast.
        part = pc.ascii_lower(pc.fill_null(texts.slice(a, b - a), "")).cast(pa.large_string())
        lists = pc.ascii_split_whitespace(part)
        sizes.append(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
        coded.append(lists.flatten().dictionary_encode())
        del part, lists
    found = pa.chunked_array(coded).unify_dictionaries()
    counts, words = np.concatenate(sizes), found.chunk(0).dictionary
    code = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in found.chunks])
    del coded, found
    # A blank at either end of a text leaves an empty piece; pieces are dropped by number, not copied.
    empty = pc.index(words, "").as_py()
    if empty >= 0:
        full = code != empty
        counts = np.bincount(np.repeat(np.arange(len(counts), dtype=np.int32), counts)[full], minlength=len(counts))
        code = code[full]
        code = code - (code > empty)
        words = words.filter(pc.not_equal(words, ""))
    return words, code, counts


def _pieces(docs: DataFrame, mod: int, held_out: int) -> DataFrame:
    """Two kinds of rows: documents with the numbers of their words, and a block's distinct words."""
    kept = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.coalesce(crc_mod("doc_id", mod) == held_out, F.lit(False)).alias("held_out"),
    )
    names = ["block", "doc_id", "held_out", "codes", "word", "code", "n"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for k, table in enumerate(blocks(batches, "text", BLOCK)):
            words, code, counts = _words(table.column("text").combine_chunks())
            held = table.column("held_out").combine_chunks().to_numpy(zero_copy_only=False)
            train = np.bincount(code[np.repeat(~held, counts)], minlength=len(words))
            # Frequent words first: small numbers, which compress well.
            order = np.argsort(-np.bincount(code, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[order] = np.arange(len(words), dtype=np.uint32)
            n = len(held)
            ends = np.cumsum(counts)
            columns = [
                pa.array(np.full(n, part + k)), table.column("doc_id").combine_chunks(), pa.array(held),
                pa.array([_squeezed(x) for x in np.split(rank[code], ends[:-1])] if n else [], pa.binary()),
                pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)
            m = len(words)
            columns = [
                pa.array(np.full(m, part + k)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_()), pa.nulls(m, pa.binary()),
                words.cast(pa.string()), pa.array(rank.astype(np.int64)), pa.array(train),
            ]
            found = pa.RecordBatch.from_arrays(columns, names)
            for at in range(0, m, ROWS):
                yield found.slice(at, ROWS)
            # Workers are used again by later stages: they give back what the block took.
            del table, words, code, counts, held, train, order, rank, columns, found
            pa.default_memory_pool().release_unused()

    return kept.mapInArrow(of, "block long, doc_id long, held_out boolean, codes binary, word string, code long, n long")


def _squeezed(values: np.ndarray) -> bytes:
    """Integers as compressed planes of bytes."""
    import zstandard

    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes(), 1)


def _unsqueezed(data: bytes, width: int) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(-1)


@dataclass
class Alphabet:
    """Totals of the training tokens, and what each symbol stands for."""

    tokens: int  # N, ends included
    distinct: int  # V, the end included
    documents: int
    #: Denominator of a word's share in its symbol: counts, distinct words and one for unknown ones.
    totals: np.ndarray
    #: Training tokens of every symbol.
    counts: np.ndarray

    @property
    def end(self) -> int:
        return OWN + ENDINGS


def _alphabet(counted: DataFrame, documents: int) -> tuple[DataFrame, Alphabet]:
    """(word, c, symbol) of all words, and the totals. ``counted``: (word, c), once each."""
    # Words by size of their count, in a few hundred classes: where the ``OWN`` most frequent begin.
    size = F.floor(F.log2("c") * 16)
    sizes = counted.where("c > 0").groupBy(size.alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("size")).collect()
    least, n = None, 0
    for r in sizes:
        n += r["n"]
        if n > OWN:
            break
        least = r["size"]
    # At most ``OWN`` words, so they may be sent to every task.
    frequent = counted.where((F.col("c") > 0) & (size >= least)).select("word").collect() if least is not None else []
    own = sorted(r["word"] for r in frequent)
    table = counted.sparkSession.createDataFrame([(w, k) for k, w in enumerate(own)], "word string, own int")
    # Characters from the end, so that "-s" and "-es" of short words differ from whole short words.
    ending = F.lit(OWN) + F.pmod(F.crc32(F.encode(F.right("word", F.lit(ENDING)), "UTF-8")), F.lit(ENDINGS)).cast("int")
    symbols = written(counted.join(F.broadcast(table), "word", "left").select("word", "c", F.coalesce("own", ending).alias("symbol")), "hmm-words")
    sums = symbols.groupBy("symbol").agg(F.sum("c").alias("c"), F.count_if(F.col("c") > 0).alias("v")).collect()
    totals, counts = np.ones(OWN + ENDINGS + 1), np.zeros(OWN + ENDINGS + 1)
    distinct = int(documents > 0)
    for r in sums:
        distinct += r["v"]
        counts[r["symbol"]] = r["c"]
        if r["symbol"] >= OWN:
            totals[r["symbol"]] = r["c"] + r["v"] + 1
    counts[-1] = documents
    return symbols, Alphabet(int(counts.sum()), distinct, documents, totals, counts)


def _symbols(docs: DataFrame, found: DataFrame, alphabet: Alphabet) -> DataFrame:
    """Documents with their symbols, and what their words are worth beside them."""
    unit = float(np.log10(alphabet.tokens + alphabet.distinct + 1))
    totals, end = alphabet.totals, alphabet.end
    end_base = float(np.log10(alphabet.documents + 1)) - unit
    end_known = int(alphabet.documents > 0)

    def of(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        size = int(right["code"].max()) + 1 if len(right) else 0
        symbol, c = np.zeros(size, np.int64), np.zeros(size)
        at = right["code"].to_numpy()
        symbol[at], c[at] = right["symbol"].to_numpy(), right["c"].to_numpy()
        base = np.log10(c + 1) - unit
        # A word of its own symbol adds nothing to it; others their share.
        share = np.where(symbol < OWN, 0.0, np.log10((c + 1) / totals[symbol]))
        out = []
        for codes in left["codes"]:
            k = _unsqueezed(codes, 4)
            out.append((len(k) + 1, int((c[k] > 0).sum()) + end_known, base[k].sum() + end_base, share[k].sum(), _squeezed(np.append(symbol[k], end).astype("<u2"))))
        made = pd.DataFrame(out, columns=["n_tokens", "n_known", "base_score", "words_score", "symbols"])
        return pd.concat([left[["doc_id", "held_out"]].reset_index(drop=True), made], axis=1)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, words_score double, symbols binary"
    return docs.groupBy("block").cogroup(found.groupBy("of_block")).applyInPandas(of, schema)


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbols x states

    @staticmethod
    def first(counts: np.ndarray, states: int) -> Model:
        """Symbols by frequency in every state, nudged apart at random; states tend to stay."""
        r = np.random.default_rng(11)
        emit = ((counts + 0.1) / (counts.sum() + 0.1 * len(counts)))[:, None] * np.exp(r.normal(0, 1.0, (len(counts), states)))
        move = np.full((states, states), 0.1 / states) + np.eye(states) * 0.9
        return Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    def updated(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, counts: np.ndarray) -> Model:
        """The model that expected counts give, with pseudo-counts."""
        if not start.sum():
            return self
        shared = PRIOR * (counts + 0.1) / (counts.sum() + 0.1 * len(counts))
        states = len(start)
        move = move + STICKY * (np.eye(states) * 0.9 + 0.1 / states)
        emit = emit + shared[:, None]
        return Model((start + 1) / (start + 1).sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def log_likelihood(model: Model, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Natural log of each sequence's probability by the scaled forward recursion, all sequences in step."""
    order = np.argsort(-counts, kind="stable")
    starts, sizes = (np.cumsum(counts) - counts)[order], counts[order]
    out = np.zeros(len(counts))
    alpha = np.empty((0, len(model.start)))
    for t in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -t, "left"))  # sequences longer than t
        before = np.broadcast_to(model.start, (n, len(model.start))) if t == 0 else alpha[:n] @ model.move
        alpha = before * model.emit[flat[starts[:n] + t]]
        scale = alpha.sum(1)
        alpha /= scale[:, None]
        out[:n] += np.log(scale)
    result = np.empty(len(counts))
    result[order] = out
    return result


def expected_counts(model: Model, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions over the sequences (forward and backward, scaled)."""
    k, m = len(model.start), len(model.emit)
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((m, k))
    order = np.argsort(-counts, kind="stable")
    for a in range(0, len(order), TOGETHER):
        part = order[a : a + TOGETHER]
        starts, sizes = (np.cumsum(counts) - counts)[part], counts[part]
        sizes = sizes[sizes > 0]
        if not len(sizes):
            continue
        steps = int(sizes[0])
        active = np.searchsorted(-sizes, -np.arange(steps), "left")
        symbol = [flat[starts[: active[t]] + t] for t in range(steps)]
        alphas, scales = [], []
        for t in range(steps):
            before = np.broadcast_to(model.start, (active[0], k)) if t == 0 else alphas[-1][: active[t]] @ model.move
            alpha = before * model.emit[symbol[t]]
            scale = alpha.sum(1, keepdims=True)
            alphas.append(alpha / scale)
            scales.append(scale)
        beta = np.ones((active[-1], k))
        gammas = [alphas[-1] * beta]
        for t in range(steps - 2, -1, -1):
            onward = beta * model.emit[symbol[t + 1]] / scales[t + 1]
            move += alphas[t][: active[t + 1]].T @ onward
            beta = np.ones((active[t], k))
            beta[: active[t + 1]] = onward @ model.move.T
            gammas.append(alphas[t] * beta)
        start += gammas[-1].sum(0)
        gamma, seen = np.concatenate(gammas[::-1]), np.concatenate(symbol)
        for s in range(k):
            emit[:, s] += np.bincount(seen, gamma[:, s], m)
    return start, move * model.move, emit


def _sequences(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    found = [_unsqueezed(x, 2) for x in batch.column("symbols").to_pylist()]
    return np.concatenate([np.zeros(0, "<u2"), *found]).astype(np.int64), np.array([len(x) for x in found], np.int64)


def _segments(counts: np.ndarray, longest: int) -> np.ndarray:
    """Sizes of the segments of sequences, at most ``longest`` each, in order."""
    pieces = -(-counts // longest)
    sizes = np.full(int(pieces.sum()), longest, np.int64)
    last = np.cumsum(pieces) - 1
    sizes[last[pieces > 0]] = (counts - (pieces - 1) * longest)[pieces > 0]
    return sizes


def baum_welch(sequences: DataFrame, model: Model, counts: np.ndarray) -> Model:
    """One update from the expected counts over all rows of ``sequences``."""
    states, symbols = len(model.start), len(model.emit)
    columns = [f"s{k}" for k in range(states)]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows: a symbol's emissions, then a state's moves, then the starts.
        total = np.zeros((symbols + states + 1, states))
        for batch in batches:
            flat, sizes = _sequences(batch)
            start, move, emit = expected_counts(model, flat, _segments(sizes, SEGMENT))
            total += np.concatenate([emit, move, start[None]])
        row = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(row), *(pa.array(total[row, k]) for k in range(states))], ["row", *columns])

    schema = "row long, " + ", ".join(f"{c} double" for c in columns)
    summed = sequences.select("symbols").mapInArrow(of, schema).groupBy("row").agg(*(F.sum(c).alias(c) for c in columns))
    total = np.zeros((symbols + states + 1, states))
    # One row a symbol or state, whatever the corpus.
    for r in summed.collect():
        total[r["row"]] = [r[c] for c in columns]
    return model.updated(total[-1], total[symbols:-1], total[:symbols], counts)


def fit(sequences: DataFrame, counts: np.ndarray, states: int = STATES, slices: int = SLICES, passes: int = PASSES) -> Model:
    """Baum-Welch over all rows: one pass in slices, then passes over the whole."""
    model = Model.first(counts, states)
    for k in range(slices):
        model = baum_welch(sequences.where(F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(slices)) == k), model, counts)
    for _ in range(passes):
        model = baum_welch(sequences, model, counts)
    return model


def score_documents(docs: DataFrame, mod: int = 7, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    pieces = written(_pieces(docs, mod, held_out), "hmm-pieces")
    texts, words = pieces.where("codes is not null").select("block", "doc_id", "held_out", "codes"), pieces.where("word is not null").select("block", "word", "code", "n")
    documents = texts.where("not held_out").count()
    symbols, alphabet = _alphabet(words.groupBy("word").agg(F.sum("n").alias("c")), documents)
    found = words.select(F.col("block").alias("of_block"), "word", "code").join(symbols, "word").select("of_block", "code", "symbol", "c")
    sequences = written(_symbols(texts, found, alphabet), "hmm-symbols")
    model = fit(sequences.where("not held_out"), alphabet.counts)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes = _sequences(batch)
            score = log_likelihood(model, flat, sizes) / np.log(10) + batch.column("words_score").to_numpy()
            kept = [batch.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    scored = sequences.mapInArrow(of, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(alphabet.tokens).cast("long"))
