"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's probability is a logistic function of
its distinct words; the document's is a noisy-or, 1 - prod(1 - p), of one background
sentence and of what its ``STRONGEST`` distinct sentences have above the background.
All sentences are read, but neither their number nor repeats move the score: a product
over all of them tends to 1 with the length alone.  Only documents are labelled; the
gradient of the document's likelihood trains the word weights, and the trained sentence
scores then locate the offending sentences.

Training: a bounded sample, at most ``max_toxic`` and ``max_clean`` labelled rows drawn by
id hash and at most ``max_chars`` characters of whole texts of each label (a text of over a 64th
of that isn't drawn), on the driver; features (words and their beginnings) that a significance test
tells apart by label.  Scoring reads every whole text in one pass and shuffles nothing;
what it ships is the weights, at most ``max_features`` of them.

Null and empty texts are a bag with no sentence and get the score of one clean
sentence.  Rows without labels are scored like any other; null ids too.  Of rows that
repeat an id, training takes one, the text that sorts first; each is scored.  Texts of any length
are scored whole, in time linear in them.  An empty table gives no row, and a model without any
labelled text rejects nothing.  Columns other than doc_id and text are not read; keep_clean passes
all of them on as they are.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_of_id

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
THRESHOLD = 0.7
STRONGEST = 3


class _Weights(dict):
    """word -> weight of the word and of its beginning; a bounded cache."""

    def __init__(self, features: dict[str, float], room: int = 500_000):
        self.features, self.room = features, room

    def __missing__(self, word: str) -> float:
        value = sum(self.features.get(f, 0.0) for f in features_of(word))
        if len(self) >= self.room:
            self.clear()
        self[word] = value
        return value

    def __reduce__(self):
        return _Weights, (self.features, self.room)


def features_of(word: str) -> list[str]:
    """The word and, of longer ones, its first five letters: inflections of one stem share it."""
    return [word, word[:5] + "*"] if len(word) > 5 else [word]


class Model:
    """Feature weights and bias of the sentence score."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = _Weights(weights), bias

    def sentences(self, text: str) -> Iterator[tuple[int, int, float]]:
        """Start, end and probability of each sentence; the offending ones come high."""
        get = self.weights.__getitem__
        for m in SENTENCE.finditer(text):
            z = self.bias + sum(map(get, set(WORD.findall(m[0].lower()))))
            yield m.start(), m.end(), 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def score(self, text: str) -> float:
        """Noisy-or of the background and of what the strongest sentences have above it."""
        get, bias = self.weights.__getitem__, self.bias
        strong = heapq.nlargest(STRONGEST, (z for s in bag(text) if (z := sum(map(get, s))) > 0.0))
        background = math.log1p(math.exp(bias))  # -log(1 - p)
        rest = background + sum(math.log1p(math.exp(min(30.0, bias + z))) - background for z in strong)
        return min(1.0, max(0.0, -math.expm1(-rest)))


def bag(text: str) -> list[frozenset[str]]:
    """The distinct words of each sentence; sentences of the same words count once."""
    return list(dict.fromkeys(frozenset(WORD.findall(s)) for s in SENTENCE.findall(text.lower())))


def screened(texts: list[str], y: np.ndarray, min_docs: int, z_least: float, max_features: int) -> dict[str, int]:
    """Features of which documents of the two labels have significantly different shares, by the z of a two-sample test."""
    df, tox = Counter(), Counter()
    for text, label in zip(texts, y):
        own = {f for w in set(WORD.findall(text.lower())) for f in features_of(w)}
        df.update(own)
        if label:
            tox.update(own)
    n, pos = len(y), float(y.sum())
    kept = []
    for f, k in df.items():
        if k >= min_docs:
            share = k / n
            z = (tox[f] / pos - (k - tox[f]) / (n - pos)) / math.sqrt(share * (1 - share) * (1 / pos + 1 / (n - pos)) + 1e-12)
            if abs(z) >= z_least:
                kept.append((-abs(z), f))
    return {f: k for k, (_, f) in enumerate(sorted(kept)[:max_features])}


def objective(w: np.ndarray, b: float, word: np.ndarray, sent: np.ndarray, doc: np.ndarray, y: np.ndarray, l2: float) -> tuple[float, np.ndarray, float]:
    """Mean negative log likelihood of the documents' labels, with its gradient by weights and bias.

    word, sent: a feature and the sentence that has it; doc: the document of each sentence.
    """
    n_s, n_d = len(doc), len(y)
    above = np.bincount(sent, w[word], n_s)
    order = np.lexsort((-above, doc))
    place = np.empty(n_s, int)
    place[order] = np.arange(n_s) - np.searchsorted(doc, doc)  # within the document, strongest first
    on = (above >= 0) & (place < STRONGEST)
    p, p0 = (1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in (b + above, b))
    least = np.log1p(-p0)
    log_clean = least + np.bincount(doc, np.where(on, np.log1p(-np.minimum(p, 1 - 1e-12)) - least, 0.0), n_d)  # the chance that no sentence is toxic
    clean = np.exp(log_clean)
    loss = -np.where(y == 1, np.log(np.maximum(1 - clean, 1e-9)), log_clean).sum() / n_d + 0.5 * l2 * (w * w).sum() / n_d
    pull = np.where(y == 1, -clean / np.maximum(1 - clean, 1e-9), 1.0)
    g = pull[doc] * np.where(on, p, 0.0)
    dw = (np.bincount(word, g[sent], len(w)) + l2 * w) / n_d
    db = (g - pull[doc] * np.where(on, p0, 0.0)).sum() / n_d + p0 * pull.sum() / n_d
    return float(loss), dw, float(db)


def train(texts: list[str], labels: list[int], min_docs: int = 8, z_least: float = 4.5, max_features: int = 50_000, rounds: int = 200, l2: float = 0.5, rate: float = 0.3) -> Model:
    """Full-batch Adagrad on the noisy-or likelihood over screened features; sentences without any are background."""
    y = np.array(labels, float)
    p = min(0.5, max(0.001, float(y.mean()) if len(y) else 0.001))
    if not 0 < y.sum() < len(y):
        return Model({}, math.log(p / (1 - p)))
    vocab = screened(texts, y, min_docs, z_least, max_features)
    word, sent, doc = array("i"), array("i"), array("i")
    for d, text in enumerate(texts):
        for s in bag(text):
            found = [vocab[f] for w in s for f in features_of(w) if f in vocab]
            if found:
                word.extend(found)
                sent.extend([len(doc)] * len(found))
                doc.append(d)
    word, sent, doc = np.array(word, int), np.array(sent, int), np.array(doc, int)
    w, b = np.zeros(len(vocab)), -5.0
    gw, gb = np.full(len(vocab), 1e-8), 1e-8
    for _ in range(rounds):
        _, dw, db = objective(w, b, word, sent, doc, y, l2)
        gw += dw * dw
        gb += db * db
        w -= rate * dw / np.sqrt(gw)
        b -= rate * db / math.sqrt(gb)
    names = list(vocab)
    return Model({names[k]: float(w[k]) for k in np.flatnonzero(np.abs(w) > 1e-3)}, float(b))


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = 3000, max_clean: int = 6000, max_chars: int = 1 << 25, **options) -> Model:
    """Train on labelled rows of docs whose crc32 of the id, mod 3, is not 1."""
    marked = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_of_id() % 3 != 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = [marked.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, max_toxic), (0, max_clean))]
    sample = drawn[0].unionByName(drawn[1])
    once = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))  # an id that repeats trains once
    size = F.coalesce(F.length("text"), F.lit(0))
    so_far = F.sum(size).over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id"))  # over the rows drawn
    once = once.filter(size <= max_chars // 64).withColumn("so_far", so_far).filter(F.col("so_far") <= max_chars)
    rows = once.select("doc_id", "text", "toxic").toArrow().sort_by("doc_id")  # bounded in rows and characters
    return train([t or "" for t in rows.column("text").to_pylist()], rows.column("toxic").to_pylist(), **options)


def toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD, sentence_threshold: float = 0.5) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, and where predicted the worst sentence (worst_start, worst_end) and offending: all of sentence_threshold or more, and the worst."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    arrow_id = docs.select("doc_id").limit(0).toArrow().schema.field(0).type
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score, worst, found = [], [], []
            for t in b.column(2):
                text = t.as_py() or ""
                score.append(s := model.score(text))
                every = list(model.sentences(text)) if s >= threshold else []
                worst.append(max(every, key=lambda x: x[2], default=(None, None)))
                found.append([{"start": x[0], "end": x[1]} for x in every if x[2] >= sentence_threshold or x == worst[-1]])
            columns = [b.column(0).cast(arrow_id), b.column(1), pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32()), pa.array([x[0] for x in worst], pa.int64()), pa.array([x[1] for x in worst], pa.int64()), pa.array(found, spans)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted", "worst_start", "worst_end", "offending"])

    return docs.select("doc_id", (crc_of_id() % 3 == 1).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, worst_start bigint, worst_end bigint, offending array<struct<start:bigint,end:bigint>>")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that the model rejects; whole rows pass through one step, nothing is joined."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([model.score(t.as_py() or "") < threshold for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
