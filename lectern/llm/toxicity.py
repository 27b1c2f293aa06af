"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the character n-grams it holds (present or not, which does not
fade in long texts), within words and across word edges. The ratio of an n-gram
is ``log((a + p) / |a + p|) - log((a + q) / |a + q|)``, with ``p`` and ``q`` the numbers of toxic
and clean texts that hold it. Features are multiplied by their ratios; a logistic
regression with a ridge is then fitted on the scaled features.

1. Each task adds up, over its own texts, how many of either label hold each of
   ``BUCKETS`` hashed n-grams; a shuffle adds those counts up. What reaches the
   driver has the size of the buckets, whatever the data.
2. The ``features`` n-grams that tell the labels apart best (chi-square) stay.
3. L-BFGS on the driver asks for value and gradient; every partition sums those over
   its own rows, so what is merged has the size of the features.

Learning uses at most ``max_train`` labelled rows (20,000 by default), the ones with the
smallest hash of their id: a documented bound on the sample, so that its labels may be
broadcast. Scoring covers every row and reads whole texts.

Defined results: null text counts as empty; texts without any kept n-gram get the score
of the intercept. Labels that are null, or whose row has a null id, teach nothing; an id with
contradicting labels teaches its greater one; an id that repeats in the documents
teaches by its smallest text. With no usable label, or labels of one kind only, every
score is that label's mean (0.5 if there is none). ``score`` and ``predicted`` replace
columns of those names; other columns pass through. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import map_text
from lectern.llm.language import _symbols as word_symbols

ORDERS = (3, 4, 5, 6)
BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
FEATURES = 1024
#: An n-gram that fewer texts of the sample hold tells nothing.
LEAST_TEXTS = 3
SMOOTHING = 1.0
RIDGE = 1.0
MAX_TRAIN = 20_000
MOST_STEPS = 40
#: Tasks that share the sample.
PARTS = 6
#: Texts are hashed in pieces of about so many characters, so that a task's memory does not grow with them.
PIECE = 1_000_000
#: So many texts are counted at a time.
LOT = 200
#: Odd factors of the hash of n-grams and of its last mixing step.
FACTOR, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _pieces(texts: list) -> Iterator[list[tuple[int, np.ndarray]]]:
    """(row, part of its symbols) in lots of about ``PIECE``; parts of one text overlap by the longest n-gram less one."""
    lot, size = [], 0
    for row, text in enumerate(texts):
        symbols = word_symbols(text or "")
        for at in range(0, max(1, len(symbols) - max(ORDERS) + 1), PIECE):
            lot.append((row, symbols[at : at + PIECE + max(ORDERS) - 1]))
            size += len(lot[-1][1])
            if size >= PIECE:
                yield lot
                lot, size = [], 0
    if lot:
        yield lot


def hashed_grams(texts: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of every n-gram of ``texts``, lot by lot, repeats included; what is no letter is an edge between words."""
    for lot in _pieces(texts):
        codes = np.concatenate([s for _, s in lot]).astype(np.uint64)
        rows = np.repeat(np.array([r for r, _ in lot], np.int32), [len(s) for _, s in lot])
        gram = np.zeros(len(codes), np.uint64)
        for n in range(1, max(ORDERS) + 1):
            if len(codes) < n:
                break
            gram = gram[: len(codes) - n + 1] * FACTOR + codes[n - 1 :]
            if n in ORDERS:
                same = rows[: len(gram)] == rows[n - 1 :]
                mixed = (gram[same] + np.uint64(n)) * MIX
                mixed = (mixed ^ (mixed >> np.uint64(29))) * FACTOR
                yield rows[: len(gram)][same], (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted different ``values``."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def held_features(texts: list, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of each feature that a text holds, once each; ``place`` maps buckets to features, -1 to none."""
    found = []
    size = BUCKETS if place is None else int(place.max(initial=0)) + 1
    for rows, buckets in hashed_grams(texts):
        if place is not None:
            own = place[buckets]
            some = own >= 0
            rows, buckets = rows[some], own[some]
        found.append(distinct(rows.astype(np.int64) * size + buckets))
    pairs = distinct(np.concatenate(found)) if found else np.empty(0, np.int64)
    return pairs // size, pairs % size


@dataclass(frozen=True)
class ToxicityModel:
    place: np.ndarray
    weights: np.ndarray
    intercept: float

    def score(self, texts: list) -> np.ndarray:
        rows, features = held_features(texts, self.place)
        return sigmoid(self.intercept + np.bincount(rows, self.weights[features], minlength=len(texts)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``text, label`` -> how many texts of each label hold each bucket."""
    held = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, LOT):
            part = batch.slice(at, LOT)
            label = part.column(1).to_numpy().astype(bool)
            rows, buckets = held_features(part.column(0).to_pylist())
            for k in (0, 1):
                np.add.at(held[k], buckets[label[rows] == bool(k)], 1)
    some = np.flatnonzero(held.any(0))
    yield pa.record_batch([pa.array(some, pa.int64()), pa.array(held[1, some]), pa.array(held[0, some])], ["bucket", "toxic", "clean"])


def _sparse(place) -> Callable:
    """Rows ``text, label`` -> ``features, label``; ``place`` is a broadcast table of all buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, features = held_features(batch.column(0).to_pylist(), place.value)
            ends = np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.record_batch([pa.ListArray.from_arrays(pa.array(ends), pa.array(features.astype(np.int32))), batch.column(1)], ["features", "label"])

    return run


def _losses(scale: np.ndarray, weights: np.ndarray) -> Callable:
    """Rows ``features, label`` -> one row: the partition's part of the loss and of its gradient; the last weight is the intercept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, gradient = 0.0, np.zeros(len(weights))
        for batch in batches:
            column = batch.column(0)
            rows, features, y = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy()), column.flatten().to_numpy(), batch.column(1).to_numpy().astype(float)
            x = scale[features]
            z = weights[-1] + np.bincount(rows, x * weights[features], minlength=len(y))
            loss += float((np.logaddexp(0, z) - y * z).sum())
            off = sigmoid(z) - y
            gradient[:-1] += np.bincount(features, x * off[rows], minlength=len(scale))
            gradient[-1] += off.sum()
        yield pa.record_batch([pa.array([loss]), pa.array([gradient.tobytes()])], ["loss", "gradient"])

    return run


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int = MOST_STEPS, memory: int = 8, enough: float = 1e-3) -> np.ndarray:
    """L-BFGS with a halving line search for a convex ``f`` (value and gradient)."""
    value, slope = f(x)
    first = np.linalg.norm(slope)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.linalg.norm(slope) <= enough * max(first, 1.0):
            break
        way, kept = slope.copy(), []
        for s, y in reversed(past):
            a = s @ way / (s @ y)
            kept.append(a)
            way -= a * y
        way *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(first, 1.0)
        for (s, y), a in zip(past, reversed(kept)):
            way += (a - y @ way / (s @ y)) * s
        length = 1.0
        while True:
            new = x - length * way
            new_value, new_slope = f(new)
            if new_value <= value - 1e-4 * length * (slope @ way) or length < 1e-6:
                break
            length /= 2
        s, y = new - x, new_slope - slope
        if s @ y > 1e-12:
            past = [*past, (s, y)][-memory:]
        x, value, slope = new, new_value, new_slope
    return x


def train(docs: DataFrame, labels: DataFrame, eligible: Column, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", max_train: int = MAX_TRAIN, features: int = FEATURES, ridge: float = RIDGE) -> ToxicityModel | float:
    """Fit on the rows of ``docs`` that have a label and are ``eligible`` (a condition on ``doc_id``).

    Returns a model, or a constant score where the labels allow none.
    """
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & eligible).groupBy(doc_id).agg(F.max((F.col(label) > 0).cast("int")).alias("__label"))
    sample = known.orderBy(F.xxhash64(doc_id), doc_id).limit(max_train)
    rows = docs.select(F.col(doc_id), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(sample), doc_id)
    once = rows.groupBy(doc_id).agg(F.min("text").alias("text"), F.first("__label").alias("label")).select("text", "label")
    # bounded by max_train; a few even partitions, so that as few sums are merged
    once = once.repartition(PARTS).persist()
    try:
        n, toxic = once.agg(F.count("*"), F.sum("label")).first()
        if not n or toxic in (0, n):
            return 0.5 if not n else toxic / n
        counted = once.mapInArrow(_counts, "bucket long, toxic long, clean long").groupBy("bucket").agg(F.sum("toxic").alias("p"), F.sum("clean").alias("q"))
        table = counted.where(F.col("p") + F.col("q") >= LEAST_TEXTS).toPandas()
        bucket, p, q = (table[c].to_numpy() for c in ("bucket", "p", "q"))
        if not len(bucket):
            return toxic / n
        clean = n - toxic
        gap = (p * clean - q * toxic) ** 2 / np.maximum((p + q) * (n - p - q), 1)
        chosen = np.lexsort((bucket, -gap))[:features]
        bucket, p, q = bucket[chosen], p[chosen], q[chosen]
        a, b = SMOOTHING + p, SMOOTHING + q
        scale = np.log(a / a.sum()) - np.log(b / b.sum())
        place = np.full(BUCKETS, -1, np.int32)
        place[bucket] = np.arange(len(bucket))
        sparse = once.mapInArrow(_sparse(docs.sparkSession.sparkContext.broadcast(place)), "features array<int>, label int").persist()
        try:

            def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
                parts = sparse.mapInArrow(_losses(scale, w), "loss double, gradient binary").collect()
                own = w.copy()
                own[-1] = 0.0
                return sum(r.loss for r in parts) + ridge / 2 * float(own @ own), sum(np.frombuffer(r.gradient) for r in parts) + ridge * own

            begun = np.zeros(len(scale) + 1)
            begun[-1] = np.log(toxic / clean)
            w = minimise(loss, begun)
        finally:
            sparse.unpersist()
        return ToxicityModel(place, w[:-1] * scale, float(w[-1]))
    finally:
        once.unpersist()


def score_toxicity(docs: DataFrame, model: ToxicityModel | float, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""

    def start():
        def work(texts: list) -> list[pa.Array]:
            score = np.full(len(texts), model) if isinstance(model, float) else model.score(texts)
            return [pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))]

        return work

    return map_text(docs, text, "score double, predicted int", start, keep_text)
