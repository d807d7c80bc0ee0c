"""Toxicity by multiple-instance learning: a document is toxic if at least one sentence is.

A sentence's probability comes from its words: a bias and the weights of words and of word beginnings.
A document's is the noisy-or of its sentences', one minus the product of their complements, and only
documents carry labels; the gradient of that product tells the sentences apart. The same weights then
locate the offending sentences.

Nulls: a null text counts as empty: it has no sentence, so it scores 0. Null ids keep their row and
count as not held out. Repeated rows score alike. An empty table gives no rows; without toxic labels every
score is 0.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import MOST_CHARS, NAMES, fitted, labelled_sample
from .shared import crc_mod
from .tokens import blocks

#: Documents of either label that a model is fitted on at most, and passes over them.
PER_CLASS, EPOCHS, RATE, DECAY = 4000, 200, 2.0, 1e-4
#: Lengths of the word beginnings that are features beside the word itself.
STARTS = (4, 5, 6)
#: A feature must stand in so many toxic documents, and be so many times as frequent as in others.
LEAST_TOXIC, LEAST_RATIO = 4, 8.0
_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")
_NO_LETTER = r"[^\p{L}]+"


def features(word: str) -> list[str]:
    """The features of one lower-case word: itself, and its beginnings with a mark."""
    return [word, *(word[:n] + "*" for n in STARTS if len(word) > n)]


def sentence_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the number of each word in order, and the (text, sentence) number of each."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    # A mark of its own stands at each sentence end; then blanks alone part words.
    marked = pc.replace_substring_regex(texts, r"[.!?\n]+", " \x01 ")
    lists = pc.ascii_split_whitespace(marked)
    words = lists.flatten().dictionary_encode()
    code = words.indices.to_numpy(zero_copy_only=False)
    spelled = pc.replace_substring_regex(pc.utf8_lower(words.dictionary), _NO_LETTER, "")
    per_text = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(texts)), per_text)
    is_end = np.asarray(pc.equal(words.dictionary, "\x01"))[code] if len(code) else np.zeros(0, bool)
    # Pieces without a letter are no words; a sentence of such alone is none.
    kept = ~is_end & np.asarray(pc.greater(pc.binary_length(spelled), 0))[code] if len(code) else is_end
    # A new text begins a new sentence too.
    breaks = is_end.astype(np.int64)
    if len(code):
        breaks[1:] += text[1:] != text[:-1]
    return spelled, code[kept], np.stack([text, np.cumsum(breaks)], 1)[kept]


def noisy_or(logit: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """log of the probability that no sentence of each document is toxic."""
    return -np.bincount(doc, np.logaddexp(0, logit), n)


def fit_words(rows: pd.DataFrame, epochs: int = EPOCHS) -> bytes:
    """Weights of features (JSON), fitted on (text, y, weight) through the noisy-or."""
    y, weight = rows["y"].to_numpy(np.float64), rows["weight"].to_numpy(np.float64)
    if not (y == 1).any():
        return json.dumps({"bias": None, "weights": {}}).encode()
    spelled, code, place = sentence_words(pa.array(rows["text"].tolist(), pa.large_string()))
    words = spelled.to_pylist()
    # Candidates: features that stand in several toxic documents, and rarely in others.
    pairs = np.unique(place[:, 0] * len(words) + code) if len(code) else np.zeros(0, np.int64)
    toxic = np.bincount(pairs % max(1, len(words)), y[pairs // max(1, len(words))], len(words))
    clean = np.bincount(pairs % max(1, len(words)), minlength=len(words)) - toxic
    in_toxic: Counter[str] = Counter()
    in_clean: Counter[str] = Counter()
    for w, t, c in zip(words, toxic.tolist(), clean.tolist()):
        for f in features(w) if w else ():
            in_toxic[f] += t
            in_clean[f] += c
    share = max(1.0, (y == 1).sum()) / max(1.0, (y == 0).sum())
    names = sorted(f for f, t in in_toxic.items() if t >= LEAST_TOXIC and t >= LEAST_RATIO * share * (in_clean[f] + 0.5))
    number = {f: k for k, f in enumerate(names)}
    of_word = [[number[f] for f in features(w) if f in number] for w in words]
    per_word = np.fromiter(map(len, of_word), np.int64, len(words))
    # (sentence, feature) of every occurrence; sentences without one share the bias alone.
    sentences, sentence = np.unique(place[:, 1], return_inverse=True)
    doc = np.zeros(len(sentences), np.int64)
    doc[sentence] = place[:, 0]
    hit = np.flatnonzero(per_word[code])
    feature = np.fromiter((k for c in code[hit].tolist() for k in of_word[c]), np.int64, int(per_word[code[hit]].sum()))
    at = np.repeat(sentence[hit], per_word[code[hit]])
    once = np.unique(at * max(1, len(names)) + feature)
    at, feature = once // max(1, len(names)), once % max(1, len(names))
    w, bias = np.full(len(names), 0.5), -6.0
    past, past_bias = np.full(len(names), 1e-6), 1e-6
    for _ in range(epochs):
        logit = bias + np.bincount(at, w[feature], len(sentences))
        none = noisy_or(logit, doc, len(y))
        # d loss / d sentence logit: p(sentence) * (1 for clean documents, -odds of none for toxic ones).
        pull = np.where(y == 1, -np.exp(none) / np.maximum(-np.expm1(none), 1e-12), 1.0) * weight / weight.sum()
        g = pull[doc] / (1 + np.exp(-logit))
        g_w, g_bias = np.bincount(feature, g[at], len(names)) + DECAY * w / max(1, len(names)), g.sum()
        past, past_bias = past + g_w**2, past_bias + g_bias**2
        w, bias = w - RATE * g_w / np.sqrt(past), bias - RATE * g_bias / np.sqrt(past_bias)
    return json.dumps({"bias": float(bias), "weights": {f: float(v) for f, v in zip(names, w)}}).encode()


class Words:
    """A fitted model: scores of documents, and their offending sentences."""

    def __init__(self, model: bytes) -> None:
        kept = json.loads(model)
        self.bias, self.weights = kept["bias"], kept["weights"]
        self.by_start = {f[:-1] for f in self.weights if f[-1:] == "*"}

    def weigh(self, word: str) -> dict[str, float]:
        return {f: self.weights[f] for f in features(word) if f in self.weights}

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.bias is None:
            return np.zeros(len(texts))
        spelled, code, place = sentence_words(texts)
        # Few words carry a weight: those whose spelling or beginning is a feature.
        found = np.zeros(len(spelled), bool)
        whole = pa.array([f for f in self.weights if f[-1:] != "*"], spelled.type)
        found |= np.asarray(pc.is_in(spelled, whole))
        for n in STARTS:
            starts = pa.array([s for s in self.by_start if len(s) == n], spelled.type)
            found |= np.asarray(pc.is_in(pc.utf8_slice_codeunits(spelled, 0, n), starts))
        n_sentences = int(place[-1, 1]) + 1 if len(place) else 0
        seen = np.zeros(n_sentences, bool)
        seen[place[:, 1]] = True
        doc = np.zeros(n_sentences, np.int64)
        doc[place[:, 1]] = place[:, 0]
        logit = np.full(n_sentences, self.bias)
        hits: dict[int, dict[str, float]] = {}
        chosen = np.flatnonzero(found)
        weighed = dict(zip(chosen.tolist(), map(self.weigh, spelled.take(pa.array(chosen)).to_pylist())))
        for k in np.flatnonzero(found[code]).tolist():
            # A feature counts once a sentence.
            hits.setdefault(int(place[k, 1]), {}).update(weighed[int(code[k])])
        for sentence, weights in hits.items():
            logit[sentence] += sum(weights.values())
        return -np.expm1(noisy_or(logit[seen], doc[seen], len(texts)))

    def locate(self, text: str, least: float = 0.5) -> list[tuple[int, int, float]]:
        """(start, end, probability) of the sentences at or above ``least``."""
        found = []
        for m in _SENTENCE.finditer(text) if self.bias is not None else ():
            words = [re.sub(r"[\W\d_]+", "", w.lower()) for w in m[0].split()]
            logit = self.bias + sum({f: v for w in words for f, v in self.weigh(w).items()}.values())
            p = float(1 / (1 + np.exp(-logit)))
            if p >= least and any(words):
                found.append((m.start(), m.end(), p))
        return found


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", mod: int = 3, held_out: int = 1, per_class: int = PER_CLASS, most_chars: int = MOST_CHARS) -> bytes:
    """A model fitted on at most ``per_class`` documents of either label."""
    return fitted(labelled_sample(docs, labels, label, mod, held_out, per_class, most_chars), fit_words)


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", mod: int = 3, held_out: int = 1, threshold: float = 0.7,
    per_class: int = PER_CLASS, most_chars: int = MOST_CHARS, names: tuple[str, str, str] = NAMES,
) -> DataFrame:
    """``docs`` with held_out, score and predicted (or ``names``), which replace columns of these names."""
    model = fit(docs, labels, label, mod, held_out, per_class, most_chars)
    kept = docs.drop(*names)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(model)
        for block in blocks(batches):
            score = pa.chunked_array([pa.array(words.scores(block.column("text").combine_chunks()), pa.float64())])
            yield from block.append_column(names[1], score).to_batches()

    schema = kept.withColumn(names[1], F.lit(0.0)).schema
    out = kept.withColumn("text", F.col("text").cast("string")).mapInArrow(of, schema)
    return out.withColumn(names[0], F.coalesce(crc_mod("doc_id", mod) == held_out, F.lit(False))).withColumn(
        names[2], (F.col(names[1]) >= threshold).cast("int")
    )


def offending_sentences(docs: DataFrame, model: bytes, least: float = 0.5) -> DataFrame:
    """(doc_id, start, end, probability, sentence) of every offending sentence."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words(model)
        for batch in batches:
            found = [(i, a, b, p, t[a:b]) for i, t in zip(batch["doc_id"], batch["text"]) if t for a, b, p in words.locate(t, least)]
            yield pd.DataFrame(found, columns=["doc_id", "start", "end", "probability", "sentence"])

    return rows.mapInPandas(of, f"doc_id {kind}, start long, end long, probability double, sentence string")
