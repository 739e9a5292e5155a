"""Toxicity of texts: a bag of subword embeddings, averaged into a linear softmax.

A text is the bag of the hashed character n-grams of its words. Its vector is the average of the
n-grams' embeddings; a softmax over two classes is linear in it. Embeddings and output weights are
learned jointly by stochastic gradient descent in numpy, on at most `sample_docs` labelled rows, so
a misspelling of a toxic word, never seen, shares most of its n-gram vectors with the word. As the
layer is linear, scoring needs one number for each bucket, its embedding's part of the log odds.

Long texts dilute an average. The bag is therefore also averaged over windows of WINDOW words, and
a text is as toxic as its most toxic window: in training, the window that scores highest stands for
its text. A word counts once in a window, and a window as LEAST_GRAMS n-grams at least, so that a
word said over and over doesn't make a window of its own weight.

Null and empty texts, and texts without letters, have an empty bag: their score is the share of
toxic rows learned from, under a half. Repeated rows and equal texts get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procweave.llm.langid import sampled
from procweave.llm.ngrams import words_of
from procweave.llm.text import slices

ORDERS, BUCKETS, DIMENSIONS, WINDOW, LEAST_GRAMS = (3, 4, 5, 6), 1 << 17, 8, 8, 60
SAMPLE_DOCS, CLEAN_WINDOWS, LEAST_WINDOWS, RATE, SEED = 5000, 16, 100_000, 0.5, 11
#: Bytes of a text beyond which it isn't learned from, so that what the driver holds is bounded.
TEXT_BYTES = 1 << 16
#: Passes over the sample: more of a small one.
EPOCHS, LEAST_TEXTS, MOST_EPOCHS = 12, 60_000, 40


@dataclass
class Bags:
    """Windows of words in order: the text of each, its n-grams' number, and all their buckets."""

    text: np.ndarray
    count: np.ndarray
    bucket: np.ndarray


def windows_of(words) -> np.ndarray:
    """The window of each word, counted on through the texts."""
    place = np.arange(len(words.doc)) - np.searchsorted(words.doc, words.doc)
    cut = np.diff(words.doc, prepend=-1) != 0
    return np.cumsum(cut | (place % WINDOW == 0)) - 1


def fresh_words(words, window: np.ndarray) -> np.ndarray:
    """Whether each word is its window's first of its kind: a word said again adds nothing."""
    _, first = np.unique(np.stack([window.astype(np.uint64), words.ids()]), axis=1, return_index=True)
    out = np.zeros(len(window), bool)
    out[first] = True
    return out


def bags_of(texts: list[str], most: np.ndarray, rng: np.random.Generator, step: int = 100) -> Bags:
    """The windows to learn from: of each text, at most `most` at random."""
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))]
    for k in range(0, len(texts), step):
        words = words_of(texts[k : k + step])
        if not len(words.doc):
            continue
        window = windows_of(words)
        text = words.doc[np.flatnonzero(np.diff(window, prepend=-1))] + k
        draw = rng.random(len(text))
        order = np.lexsort((draw, text))
        rank = np.empty(len(text), np.int64)
        rank[order] = np.arange(len(text)) - np.searchsorted(text[order], text[order])
        keep = rank < most[text]
        holder = np.repeat(np.arange(len(window)), words.size + 2)
        used = fresh_words(words, window) & keep[window]
        grams = [(holder[at], b.astype(np.int32)) for at, b in words.grams(ORDERS, BUCKETS)]
        of, bucket = (np.concatenate(x) for x in zip(*grams, strict=True))
        bucket, of = bucket[used[of]], window[of[used[of]]]
        found.append((text[keep], np.bincount(of, minlength=len(text))[keep], bucket[np.argsort(of, kind="stable")]))
    return Bags(*(np.concatenate(x) for x in zip(*found, strict=True)))


@dataclass
class Model:
    odds: np.ndarray  # bucket: its part of the log odds
    bias: float
    prior: float  # the log odds of the learned rows, for empty bags

    def scores(self, texts: list[str | None]) -> np.ndarray:
        words = words_of(texts)
        out = np.full(len(texts), -np.inf)
        if len(words.doc):
            window = windows_of(words)
            fresh = fresh_words(words, window)
            total = np.bincount(window, weights=words.sums(ORDERS, self.odds) * fresh)
            count = np.bincount(window, weights=words.counts(ORDERS) * fresh)
            first = np.flatnonzero(np.diff(window, prepend=-1))
            np.maximum.at(out, words.doc[first], total / np.maximum(count, LEAST_GRAMS))
        out = np.where(np.isfinite(out), out + self.bias, self.prior)
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def gradients(vectors: np.ndarray, out: np.ndarray, bias: np.ndarray, bucket: np.ndarray, of: np.ndarray, size: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the weighed log loss of bags, by embeddings (the buckets, their gradients), output weights and bias.

    bucket: the bags' n-grams; of: the bag of each; size: what a bag's sum is divided by."""
    n, dimensions = len(size), vectors.shape[1]
    hidden = np.stack([np.bincount(of, weights=vectors[bucket, d], minlength=n) for d in range(dimensions)], axis=1).astype(out.dtype) / size
    logits = hidden @ out + bias
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(n), labels] -= 1
    p = (p * weight[:, None]).astype(out.dtype)
    g_hidden = (p @ out.T) / size
    u, inverse = np.unique(bucket, return_inverse=True)
    g_v = np.stack([np.bincount(inverse, weights=g_hidden[of, d], minlength=len(u)) for d in range(dimensions)], axis=1).astype(out.dtype)
    return u, g_v, hidden.T @ p, p.sum(axis=0)


def fit(texts: list[str], toxic: np.ndarray, epochs: int | None = None, rate: float = RATE, seed: int = SEED) -> Model:
    """Embeddings and softmax weights, learned together by Adagrad on windows.

    Each epoch but the first, the window that scores highest stands for its text, beside random
    windows of the texts that aren't toxic. Of those, CLEAN_WINDOWS windows at random (more
    where there are few texts) are learned from; scoring always takes whole texts."""
    epochs = epochs or max(EPOCHS, min(MOST_EPOCHS, LEAST_TEXTS // max(len(texts), 1)))
    rng = np.random.default_rng(seed)
    bags = bags_of(texts, np.where(toxic == 1, 1 << 30, max(CLEAN_WINDOWS, LEAST_WINDOWS // max(len(texts), 1))), rng)
    n, bucket, begin = len(bags.text), bags.bucket, np.concatenate([[0], np.cumsum(bags.count)])
    # embeddings start at 0, so that n-grams never learned say nothing; the output weights break the tie
    vectors = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    out = rng.uniform(-1, 1, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen_v, seen_o, seen_b = np.full(BUCKETS, 1e-6, np.float32), np.full_like(out, 1e-6), np.full_like(bias, 1e-6)
    labels = toxic.astype(np.int64)[bags.text]
    first = np.searchsorted(bags.text, np.unique(bags.text))
    weight = np.where(labels == 1, 0.5 / max(toxic.mean(), 1e-3), 0.5 / max(1 - toxic.mean(), 1e-3)) if len(toxic) else np.ones(0)

    def gather(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = bags.count[rows]
        at = np.repeat(begin[rows] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
        return bucket[at], np.repeat(np.arange(len(rows)), size)

    def log_odds() -> np.ndarray:
        flat = np.concatenate([vectors @ (out[:, 1] - out[:, 0]), np.zeros(1, np.float32)])
        total = np.add.reduceat(flat[np.append(bucket, BUCKETS)], begin[:-1]) if n else np.zeros(0)
        return np.where(bags.count > 0, total / np.maximum(bags.count, LEAST_GRAMS), 0)

    for epoch in range(epochs):
        if epoch == 0:
            rows = np.flatnonzero(bags.count > 0)
            rows = rows[(labels[rows] == 1) | (rng.random(len(rows)) < 0.3)]
        else:
            value = np.where(bags.count > 0, log_odds(), -np.inf)
            best = np.maximum.reduceat(value, first)
            of = np.repeat(np.arange(len(first)), np.diff(first, append=n))
            rows = np.flatnonzero((value == best[of]) & np.isfinite(value))
            # of clean texts, a random window too, so that usual n-grams stay at zero
            more = rng.choice(n, min(n, len(first)))
            rows = np.concatenate([rows, more[(labels[more] == 0) & (bags.count[more] > 0)]])
        rows = rng.permutation(rows)
        for k in range(0, len(rows), 64):
            part = rows[k : k + 64]
            b, of = gather(part)
            size = np.maximum(bags.count[part], LEAST_GRAMS).astype(np.float32)[:, None]
            u, g_v, g_out, g_bias = gradients(vectors, out, bias, b, of, size, labels[part], weight[part])
            seen_o += g_out**2
            seen_b += g_bias**2
            seen_v[u] += (g_v**2).mean(axis=1)
            out -= rate * g_out / np.sqrt(seen_o)
            bias -= rate * g_bias / np.sqrt(seen_b)
            vectors[u] -= rate * g_v / np.sqrt(seen_v[u])[:, None]
    odds = vectors @ (out[:, 1] - out[:, 0])
    rate_toxic = float(np.clip(toxic.mean(), 1e-3, 0.499))
    return Model(odds.astype(np.float64), float(bias[1] - bias[0]), float(np.log(rate_toxic / (1 - rate_toxic))))


def train(labelled: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from at most sample_docs rows with a text, of up to TEXT_BYTES, and a 0 or 1. Rows that lack either don't count.

    Where all labels are alike, every text gets their share, kept off 0 and 1; without labels, as if all were 0."""
    rows = sampled(labelled.where((F.octet_length(text) <= TEXT_BYTES) & F.col(label).isin(0, 1)), key, sample_docs).select(F.col(key).cast("string").alias("k"), text, label).toPandas()
    rows = rows.sort_values(["k", text], kind="stable")
    if rows[label].nunique() < 2:
        share = 0.999 if len(rows) and rows[label].iat[0] == 1 else 0.001
        log_odds = float(np.log(share / (1 - share)))
        return Model(np.zeros(BUCKETS), log_odds, log_odds)
    return fit(rows[text].tolist(), rows[label].to_numpy())


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", more: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, score, predicted) for each row, with the columns `more` between."""
    more = more or {}
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a number for each bucket

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__pw_text"):
            found = shared.value.scores(batch.column("__pw_text").to_pylist())
            kept = [c for c in batch.schema.names if c != "__pw_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pa.float64()), pa.array((found >= 0.5).astype(np.int32))], [*kept, "score", "predicted"])

    given = docs.select(F.col(doc_id).alias("doc_id"), *[c.alias(n) for n, c in more.items()], F.col(text).alias("__pw_text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema if f.name != "__pw_text")
    return given.mapInArrow(score, f"{kinds}, score double, predicted int")
