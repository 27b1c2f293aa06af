"""A quality classifier over document statistics.

Every text becomes a short vector of statistics (lengths, character classes,
repetition, compressibility). Random Fourier features approximate a Gaussian
kernel over the standardised statistics; ridge scores come from normal
equations that each partition sums over its own rows, so what is merged has the
size of the feature map and not of the data. Scores of rows that a half-model
has not seen are then calibrated by isotonic regression.

Learning uses at most ``max_train`` labelled rows (20,000 by default), the ones
with the smallest hash of their id: a documented bound on the sample, so that the
sample's labels may be broadcast. Scoring covers every row.

Defined results: null text counts as empty and is scored like any other. Labels
that are null, or whose row has a null id, teach nothing; an id with contradicting
labels counts with their mean; an id that repeats in the documents teaches once per row.
With no usable label, or labels of one kind only, every score is that label's
mean (0.5 if there is none). ``score`` and ``predicted`` replace columns of those names.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import map_text

MAX_TRAIN = 20_000
FEATURES = 256
RIDGE = 1.0
SEED = 20_240
BINS = 1024

STATISTICS = (
    "log_chars", "log_words", "mean_word", "long_words", "short_words", "unique_words", "top_word", "top_ten_words", "adjacent_repeats",
    "unique_trigrams", "log_lines", "unique_lines", "mean_line", "short_lines", "digits", "upper", "lower", "stops", "commas", "shouts",
    "other_marks", "brackets", "spaces", "beyond_ascii", "entropy", "compressed", "capital_words", "ended_lines",
)


def _classes() -> np.ndarray:
    """Rows: sets of byte values whose shares are statistics."""
    sets = [b"0123456789", bytes(range(65, 91)), bytes(range(97, 123)), b".?", b",;:", b"!", b"\"'#$%&*+-/=@\\^_`|~", b"()[]{}<>", b" \t\r\n", bytes(range(128, 256))]
    table = np.zeros((len(sets), 256))
    for row, members in enumerate(sets):
        table[row, list(members)] = 1
    return table


CLASSES = _classes()


def statistics(text: str | None) -> list[float]:
    """The document statistics named in ``STATISTICS``."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n, w, k = max(1, len(raw)), max(1, len(words)), max(1, len(lines))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = counts / n
    present = share[share > 0]
    common = Counter(words).most_common(10)
    top = [c for _, c in common] or [0]
    trigrams = max(1, len(words) - 2)
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        float(sizes.mean()) if len(words) else 0.0,
        float((sizes > 12).sum()) / w,
        float((sizes < 3).sum()) / w,
        len(set(words)) / w,
        top[0] / w,
        sum(top) / w,
        sum(map(operator.eq, words, words[1:])) / w,
        len(set(zip(words, words[1:], words[2:]))) / trigrams,
        np.log1p(len(lines)),
        len(set(lines)) / k,
        np.log1p(n / k),
        sum(len(x) < 20 for x in lines) / k,
        *(CLASSES @ share),
        float(-(present * np.log2(present)).sum()),
        len(zlib.compress(raw, 1)) / n,
        sum(x[0].isupper() for x in words) / w,
        sum(x.rstrip()[-1] in ".!?\"')" for x in lines) / k,
    ]


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return feature_map(stats, self.mean, self.scale, self.frequencies, self.phases) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.levels), 0.0, 1.0)


def feature_map(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray, frequencies: np.ndarray, phases: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised statistics, and a constant."""
    z = np.clip((stats - mean) / scale, -6, 6)
    wave = np.sqrt(2.0 / len(phases)) * np.cos(z @ frequencies + phases)
    return np.hstack([wave, np.ones((len(z), 1))])


def isotonic(x: np.ndarray, total: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins ``x`` (ascending); returns each block's centre and its smoothed mean."""
    blocks: list[list[float]] = []
    for at, n, p in zip(x, total, positive):
        blocks.append([at * n, n, p])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 1], np.maximum.accumulate((b[:, 2] + 0.5) / (b[:, 1] + 1.0))


def _statistics_columns():
    def start():
        def work(texts: list) -> list[pa.Array]:
            return [pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))]

        return work

    return start


def _partial_sums(mean, scale, frequencies, phases):
    """Each partition's normal equations, one row for each half of the sample."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(phases) + 1
        gram, moment = np.zeros((2, width, width)), np.zeros((2, width))
        for batch in batches:
            stats = np.array(batch.column(0).to_pylist(), float)
            y, half = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            phi = feature_map(stats, mean, scale, frequencies, phases)
            for h in (0, 1):
                own = phi[half == h]
                gram[h] += own.T @ own
                moment[h] += own.T @ y[half == h]
        for h in (0, 1):
            for row in range(width):
                yield pa.record_batch([pa.array([h], pa.int32()), pa.array([row], pa.int32()), pa.array([gram[h, row].tolist() + [moment[h, row]]])], ["half", "row", "sums"])

    return sums


def _scores(weights: list[np.ndarray], mean, scale, frequencies, phases):
    """Each sample row scored by the half-model that has not seen it, in counts by bin."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            phi = feature_map(np.array(batch.column(0).to_pylist(), float), mean, scale, frequencies, phases)
            half = batch.column(2).to_numpy()
            raw = np.where(half == 0, phi @ weights[1], phi @ weights[0])
            yield pa.record_batch([pa.array(raw), batch.column(1)], ["raw", "label"])

    return score


def train(docs: DataFrame, labels: DataFrame, eligible: Column, text: str = "text", doc_id: str = "doc_id", label: str = "quality", max_train: int = MAX_TRAIN, features: int = FEATURES, ridge: float = RIDGE) -> QualityModel | float:
    """Fit on the rows of ``docs`` that have a label and are ``eligible`` (a condition on ``doc_id``).

    Returns a model, or a constant score where the labels allow none.
    """
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & eligible).groupBy(doc_id).agg(F.avg(F.col(label).cast("double")).alias("__label"))
    sample = known.orderBy(F.xxhash64(doc_id), doc_id).limit(max_train)
    rows = docs.select(F.col(doc_id), F.col(text).alias("text")).join(F.broadcast(sample), doc_id)
    half = F.pmod(F.xxhash64(F.col(doc_id), F.lit("half")), F.lit(2)).cast("int").alias("half")
    measured = map_text(rows.select("text", F.col("__label").alias("label"), half), "text", "stats array<double>", _statistics_columns(), keep_text=False)
    # bounded by max_train; a few even partitions, so that as few sums are merged
    measured = measured.select("stats", "label", "half").repartition(8).persist()
    try:
        size = len(STATISTICS)
        sums = [F.sum(F.col("stats")[i]) for i in range(size)] + [F.sum(F.col("stats")[i] * F.col("stats")[i]) for i in range(size)]
        n, mean_label, least, most, *s = measured.agg(F.count("label"), F.avg("label"), F.min("label"), F.max("label"), *sums).first()
        if not n or least == most:
            return 0.5 if not n else float(mean_label)
        mean = np.array(s[:size]) / n
        scale = np.sqrt(np.maximum(np.array(s[size:]) / n - mean**2, 0))
        scale[scale < 1e-9] = 1.0
        random = np.random.default_rng(SEED)
        frequencies = random.normal(0, 1 / np.sqrt(2 * size), (size, features))
        phases = random.uniform(0, 2 * np.pi, features)
        width = features + 1
        parts = measured.mapInArrow(_partial_sums(mean, scale, frequencies, phases), "half int, row int, sums array<double>")
        merged = parts.groupBy("half", "row").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(width + 1)]).alias("sums"))
        table = np.zeros((2, width, width + 1))
        for r in merged.collect():
            table[r.half, r.row] = r.sums
        solve = lambda t: np.linalg.solve(t[:, :width] + ridge * np.eye(width), t[:, width])
        halves = [solve(table[0]), solve(table[1])]
        unseen = measured.mapInArrow(_scores(halves, mean, scale, frequencies, phases), "raw double, label double")
        bins = unseen.groupBy(F.floor(F.col("raw") * BINS).alias("bin")).agg(F.avg("raw").alias("at"), F.count("*").alias("n"), F.sum("label").alias("p")).orderBy("bin").collect()
        knots, levels = isotonic(np.array([b["at"] for b in bins]), np.array([b["n"] for b in bins], float), np.array([b["p"] for b in bins], float))
        return QualityModel(mean, scale, frequencies, phases, solve(table.sum(0)), knots, levels)
    finally:
        measured.unpersist()


def _scorer(model: QualityModel | float):
    def start():
        def work(texts: list) -> list[pa.Array]:
            if isinstance(model, float):
                score = np.full(len(texts), model)
            else:
                score = model.score(np.array([statistics(t) for t in texts], float).reshape(-1, len(STATISTICS)))
            return [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]

        return work

    return start


def score_quality(docs: DataFrame, model: QualityModel | float, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    return map_text(docs, text, "score double, predicted int", _scorer(model), keep_text)
