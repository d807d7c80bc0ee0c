"""Quality by a byte-level convolutional network in numpy.

Learned filters run over every byte of a document. Their answers are max-pooled over overlapping chunks
that cover the whole text; the greatest and the mean chunk answer of each filter are combined into one
probability. Beside its value, a byte carries one bit: whether it ends a stretch that stands a few
bytes before as well, so that filters can see repetition.

Nulls: a null text counts as empty and gets the score of padding alone. Null ids keep their row and count
as not held out. Repeated rows score alike. An empty table gives no rows; without labels the score is 0.5.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import MOST_CHARS, NAMES, fitted, labelled_sample
from .shared import crc_mod
from .tokens import blocks

#: Filters, their width and step in bytes, channels of a byte's embedding, and half a chunk in bytes.
FILTERS, WIDTH, STEP, CHANNELS, CELL = 16, 6, 2, 8, 64
#: Lags at which a byte's last ``MATCH`` bytes count as repeated.
LAGS, MATCH = range(2, 33), 6
#: Documents of either label that a model is fitted on at most, and passes over them.
PER_CLASS, EPOCHS, BATCH, RATE = 2000, 10, 48, 0.01
#: Bytes convolved at a time.
PIECE = 1 << 18


def symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array of symbols (byte, or 256 + byte if repeated), and the cells of each.

    A text's first cell begins with one filter's width of padding, so no filter sees two texts at once.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    cells = -(-(sizes + WIDTH) // CELL)
    starts = (np.cumsum(cells) - cells) * CELL + WIDTH
    out = np.zeros(int(cells.sum()) * CELL + WIDTH, np.int16)
    for text, start in zip(texts, starts.tolist()):
        data = np.frombuffer(text, np.uint8)
        out[start : start + len(data)] = data
        if len(data) > MATCH:
            out[start : start + len(data)][repeated(data)] += 256
    return out, cells


def repeated(data: np.ndarray) -> np.ndarray:
    """Whether the ``MATCH`` bytes up to each byte equal those some lag before it."""
    seen = np.zeros(len(data), bool)
    for lag in LAGS:
        if lag + MATCH > len(data):
            break
        same = data[lag:] == data[:-lag]
        run = same[MATCH - 1 :].copy()
        for k in range(1, MATCH):
            run &= same[MATCH - 1 - k : -k]
        seen[lag + MATCH - 1 :] |= run
    return seen


class Network:
    """The network's weights, its answers, and one step of learning."""

    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        self.embed = r.normal(0, 0.5, (512, CHANNELS)).astype(np.float32)
        self.kernel = r.normal(0, (WIDTH * CHANNELS) ** -0.5, (WIDTH, CHANNELS, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = r.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.base = np.zeros(1, np.float32)
        self.moments: list[tuple[np.ndarray, np.ndarray]] = []
        self.steps = 0

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.kernel, self.bias, self.out, self.base]

    def saved(self) -> bytes:
        held = io.BytesIO()
        np.savez(held, *self.weights())
        return held.getvalue()

    @staticmethod
    def loaded(data: bytes) -> Network:
        network = Network()
        with np.load(io.BytesIO(data)) as kept:
            network.embed, network.kernel, network.bias, network.out, network.base = (kept[f"arr_{k}"] for k in range(5))
        return network

    def cells(self, x: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The greatest answer of each filter in every cell, and where it stands."""
        # An embedding followed by a filter is one table a filter position: a lookup a byte.
        table = np.matmul(self.embed, self.kernel)
        n = (len(x) - WIDTH) // CELL
        best = np.empty((n, FILTERS), np.float32)
        where = np.empty((n, FILTERS), np.int64) if places else None
        step = max(1, PIECE // CELL)
        for a in range(0, n, step):
            b = min(n, a + step)
            part = x[a * CELL : b * CELL + WIDTH]
            count = (b - a) * CELL // STEP
            answer = table[0][part[0 : count * STEP : STEP]]
            for w in range(1, WIDTH):
                answer += table[w][part[w : w + count * STEP : STEP]]
            answer = answer.reshape(b - a, CELL // STEP, FILTERS)
            best[a:b] = answer.max(1)
            if where is not None:
                where[a:b] = answer.argmax(1) * STEP + np.arange(a, b)[:, None] * CELL
        return best, where

    @staticmethod
    def chunks(best: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every cell the chunk of it and the next cell of its document: the cell that holds the maximum."""
        last = np.cumsum(cells) - 1
        following = np.minimum(np.arange(len(best)) + 1, np.repeat(last, cells))
        pick = np.where(best[following] > best, following[:, None], np.arange(len(best))[:, None])
        return np.take_along_axis(best, pick, 0), pick

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x, cells = symbols(texts)
        pooled, _ = self.chunks(self.cells(x)[0], cells)
        return self._combined(pooled, cells)[0]

    def _combined(self, pooled: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        first = np.cumsum(cells) - cells
        active = np.maximum(pooled + self.bias, 0)
        top = np.maximum.reduceat(active, first, axis=0)
        mean = np.add.reduceat(active, first, axis=0) / cells[:, None]
        # Row by row, so that a text scores alike whatever stands beside it.
        logit = (np.concatenate([top, mean], 1) * self.out).sum(1) + self.base
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30).astype(np.float64))), active, top, mean

    def learn(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray, rate: float) -> None:
        """One step of Adam on the weighted log loss."""
        x, cells = symbols(texts)
        best, where = self.cells(x, True)
        pooled, pick = self.chunks(best, cells)
        p, active, top, mean = self._combined(pooled, cells)
        d = ((p - y) * weight / weight.sum()).astype(np.float32)
        g_out = np.concatenate([d @ top, d @ mean])
        doc = np.repeat(np.arange(len(cells)), cells)
        # Back through the two pools: a share for every chunk, and one for a document's greatest.
        g = (d[:, None] * self.out[FILTERS:] / cells[:, None])[doc]
        is_top = active == top[doc]
        ties = np.maximum(np.add.reduceat(is_top, np.cumsum(cells) - cells, axis=0, dtype=np.float32), 1)
        g = (g + (d[:, None] * self.out[:FILTERS] / ties)[doc] * is_top) * (active > 0)
        g_bias = g.sum(0)
        at = np.take_along_axis(where, pick, 0)
        hit = np.abs(g) > 0
        f = np.broadcast_to(np.arange(FILTERS), g.shape)[hit]
        at, g = at[hit], g[hit]
        g_embed, g_kernel = np.zeros_like(self.embed), np.zeros_like(self.kernel)
        for w in range(WIDTH):
            s = x[at + w].astype(np.int64)
            g_table = np.bincount(s * FILTERS + f, g, 512 * FILTERS).reshape(512, FILTERS).astype(np.float32)
            g_kernel[w] = self.embed.T @ g_table
            g_embed += g_table @ self.kernel[w].T
        self._adam([g_embed, g_kernel, g_bias, g_out, np.array([d.sum()], np.float32)], rate)

    def _adam(self, grads: list[np.ndarray], rate: float) -> None:
        if not self.moments:
            self.moments = [(np.zeros_like(w), np.zeros_like(w)) for w in self.weights()]
        self.steps += 1
        for w, g, (m, v) in zip(self.weights(), grads, self.moments):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)


def fit_network(rows: pd.DataFrame, epochs: int = EPOCHS) -> bytes:
    """The saved weights of a network fitted on (text, y, weight)."""
    network = Network()
    texts = [t.encode() for t in rows["text"]]
    y, weight = rows["y"].to_numpy(np.float64), rows["weight"].to_numpy(np.float64)
    if len(set(y.tolist())) < 2:
        # One label or none teaches nothing but its share.
        network.out[:] = 0
        network.base[:] = (6.0 if y[0] else -6.0) if len(y) else 0.0
        return network.saved()
    r = np.random.default_rng(1)
    # Batches hold either label, whatever its share; weights restore the shares.
    groups = [r.permutation(np.flatnonzero(y == k)) for k in (0, 1)]
    steps = max(30, len(y) // BATCH) * epochs
    for step in range(steps):
        take = np.concatenate([g[np.arange(step * BATCH // 2, (step + 1) * BATCH // 2) % len(g)] for g in groups])
        rate = RATE * min(1, 2 * (1 - step / steps))
        share = np.array([weight[y == k].sum() / weight.sum() for k in (0, 1)])
        network.learn([texts[i] for i in take], y[take], np.sqrt(share)[y[take].astype(int)], rate)
    return network.saved()


def quality_scores(
    docs: DataFrame, labels: DataFrame, label: str = "quality", mod: int = 5, held_out: int = 0, threshold: float = 0.3,
    per_class: int = PER_CLASS, most_chars: int = MOST_CHARS, names: tuple[str, str, str] = NAMES,
) -> DataFrame:
    """``docs`` with held_out, score and predicted (or ``names``), which replace columns of these names. Fitted on at most ``per_class`` documents a label."""
    model = fitted(labelled_sample(docs, labels, label, mod, held_out, per_class, most_chars), fit_network)
    return scored(docs, model, mod, held_out, threshold, names)


def scored(docs: DataFrame, model: bytes, mod: int, held_out: int, threshold: float, names: tuple[str, str, str] = NAMES) -> DataFrame:
    """The columns of ``docs`` (but those of the same names), and a fitted network's answers under ``names``."""
    kept = docs.drop(*names)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network.loaded(model)
        for block in blocks(batches, "text", 4 << 20):
            texts = [b"" if t is None else t.encode() for t in block.column("text").to_pylist()]
            score = pa.chunked_array([pa.array(network.scores(texts), pa.float64())])
            yield from block.append_column(names[1], score).to_batches()

    schema = kept.withColumn(names[1], F.lit(0.0)).schema
    out = kept.withColumn("text", F.col("text").cast("string")).mapInArrow(of, schema)
    return out.withColumn(names[0], F.coalesce(crc_mod("doc_id", mod) == held_out, F.lit(False))).withColumn(
        names[2], (F.col(names[1]) >= threshold).cast("int")
    )
