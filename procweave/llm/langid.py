"""Language of texts, and of spans within them.

Letters' script ranges narrow each word's candidates to the languages whose training words used
the script; scripts that no language used leave all. A word's score for a language is the mean
log probability of its character n-grams under the language, weighed by their number; Viterbi over
a text's words then finds the labels of the highest total, each change of language costing a
penalty, so a short foreign-looking word inside a span doesn't break it. A text's language is the
one with most letters in its spans; its score is that share, weighed by how clearly the words'
scores prefer it.

Training counts n-grams of a bounded sample of labelled texts: at most `sample_docs` rows, and
the counts, of a fixed number of buckets, are added up on the driver. Texts without a letter, and
null texts, are `und` with score 0, and so are all texts if there was nothing to learn from. Repeated rows and equal texts get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procweave.llm.ngrams import SCRIPT_NAMES, words_of
from procweave.llm.text import slices

ORDERS, BUCKETS = (1, 2, 3, 4), 1 << 16
SAMPLE_DOCS, SMOOTHING, PENALTY = 3000, 0.5, 12.0
#: A share of a language's training words that must use a script for the language to be its candidate.
SCRIPT_SHARE = 0.01


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # bucket x language: log probabilities
    scripts: np.ndarray  # script x language: whether a candidate
    penalty: float = PENALTY

    def word_scores(self, texts: list[str | None]):
        """The words of texts, and their scores by language; -inf for languages that the script rules out."""
        words = words_of(texts)
        scores = words.sums(ORDERS, self.weights) / len(ORDERS)
        scores[~self.scripts[words.script]] = -np.inf
        return words, scores

    def viterbi(self, doc: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """The best label of each word. Texts are walked in step, one word of each at a time."""
        n = len(doc)
        if not n:
            return np.zeros(0, np.int64)
        begin = np.flatnonzero(np.diff(doc, prepend=-1))
        length = np.diff(begin, append=n)
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        stay = np.zeros((n, scores.shape[1]), bool)
        source = np.zeros(n, np.int64)
        best = scores[begin].copy()
        for t in range(1, int(length[0])):
            live = int(np.searchsorted(-length, -t, side="left"))  # texts of more than t words come first
            now, at = best[:live], begin[:live] + t
            top = now.argmax(axis=1)
            change = now[np.arange(live), top] - self.penalty
            keep = now >= change[:, None]
            stay[at], source[at] = keep, top
            best[:live] = np.where(keep, now, change[:, None]) + scores[at]
        labels = np.zeros(n, np.int64)
        last = best.argmax(axis=1)
        for t in range(int(length[0]) - 1, -1, -1):
            live = int(np.searchsorted(-length, -t, side="left"))
            at = begin[:live] + t
            labels[at] = last[:live]
            last[:live] = np.where(stay[at, last[:live]], last[:live], source[at]) if t else last[:live]
        return labels

    def spans(self, texts: list[str | None]) -> tuple[list[str], list[float], list[list[tuple[str, int, int, int]]]]:
        """Each text's language, score, and runs (language, words, start, end) of equal labels; a run goes from its
        first word's first character to its last word's end."""
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
        words, scores = self.word_scores(texts)
        labels = self.viterbi(words.doc, scores)
        k, n = len(self.languages), len(texts)
        letters = np.bincount(words.doc * k + labels, weights=words.size, minlength=n * k).reshape(n, k)
        total = letters.sum(axis=1)
        best = letters.argmax(axis=1)
        # how much better, by letter, the whole text is explained by its language than by the next
        finite = np.where(np.isfinite(scores), scores, -50.0)
        evidence = np.stack([np.bincount(words.doc, weights=finite[:, j], minlength=n) for j in range(k)], axis=1).astype(np.float64)
        rest = evidence.copy()
        rest[np.arange(n), best] = -np.inf
        margin = evidence[np.arange(n), best] - (rest.max(axis=1) if k > 1 else evidence[np.arange(n), best] - 50)
        sure = 1 / (1 + np.exp(-np.clip(margin, -50, 50)))
        share = letters[np.arange(n), best] / np.maximum(total, 1)
        names = [self.languages[b] if t else "und" for b, t in zip(best.tolist(), total.tolist(), strict=True)]
        score = np.where(total > 0, share * (1 + sure) / 2, 0.0).tolist()
        runs: list[list[tuple[str, int, int, int]]] = [[] for _ in texts]
        if len(labels):
            cut = np.flatnonzero((np.diff(labels, prepend=-1) != 0) | (np.diff(words.doc, prepend=-1) != 0))
            for a, size in zip(cut.tolist(), np.diff(cut, append=len(labels)).tolist(), strict=True):
                last = a + size - 1
                runs[int(words.doc[a])].append((self.languages[int(labels[a])], size, int(words.begin[a]), int(words.begin[last] + words.size[last])))
        return names, score, runs


def sampled(labelled: DataFrame, key: str, rows: int) -> DataFrame:
    """About `rows` rows, at most, spread by a hash of the key."""
    n = labelled.count()
    part = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1_000_003)) < int(1_000_003 * min(1.0, 0.9 * rows / max(n, 1))) + 1
    return labelled.where(part).limit(rows)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from rows with a text and a language. Without any, it knows no language and calls all texts und."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for batch in slices(batches, text):
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            words = words_of(texts)
            names = np.array(langs, object)[words.doc] if len(words.doc) else np.array([], object)
            holder = np.repeat(np.arange(len(words.doc)), words.size + 2)
            for name in set(langs):
                mine = names == name
                own, used = grams.setdefault(name, np.zeros(BUCKETS, np.int64)), scripts.setdefault(name, np.zeros(len(SCRIPT_NAMES), np.int64))
                used += np.bincount(words.script[mine], minlength=len(SCRIPT_NAMES))
                for at, buckets in words.grams(ORDERS, BUCKETS):
                    own += np.bincount(buckets[mine[holder[at]]], minlength=BUCKETS)
        names = sorted(grams)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([grams[n].tobytes() for n in names], pa.binary()), pa.array([scripts[n].tobytes() for n in names], pa.binary())], ["lang", "grams", "scripts"])

    # texts are read of the sampled rows' files alone, once
    rows = sampled(labelled.where(F.col(lang).isNotNull()), key, sample_docs).where(F.col(text).isNotNull()).select(text, lang)
    counted: dict[str, list[np.ndarray]] = {}
    for r in rows.coalesce(2).mapInArrow(count, "lang string, grams binary, scripts binary").collect():
        got = [np.frombuffer(r[c], np.int64) for c in ("grams", "scripts")]
        counted[r["lang"]] = [a + b for a, b in zip(counted[r["lang"]], got, strict=True)] if r["lang"] in counted else got
    if not counted:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((len(SCRIPT_NAMES), 0), bool))
    languages = sorted(counted)
    grams = np.stack([counted[x][0] for x in languages], axis=1) + SMOOTHING
    used = np.stack([counted[x][1] for x in languages], axis=1)
    scripts = used > SCRIPT_SHARE * np.maximum(used.sum(axis=0), 1)
    scripts[~scripts.any(axis=1)] = True
    return Model(languages, np.log(grams / grams.sum(axis=0)), scripts)


def identified(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", more: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, lang_pred, score, spans) for each row; spans are runs of words, (lang, words, start, end), places in characters."""
    more = more or {}
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as BUCKETS x languages

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__pw_text"):
            names, score, runs = shared.value.spans(batch.column("__pw_text").to_pylist())
            spans = pa.array([[dict(zip(("lang", "words", "start", "end"), x, strict=True)) for x in r] for r in runs], pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])))
            kept = [c for c in batch.schema.names if c != "__pw_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(names, pa.string()), pa.array(score, pa.float64()), spans], [*kept, "lang_pred", "score", "spans"])

    given = docs.select(F.col(doc_id).alias("doc_id"), *[c.alias(n) for n, c in more.items()], F.col(text).alias("__pw_text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema if f.name != "__pw_text")
    return given.mapInArrow(label, f"{kinds}, lang_pred string, score double, spans array<struct<lang:string,words:int,start:int,end:int>>")
