"""Language identification by rank-order n-gram profiles.

Each language's profile is the list of its most frequent character n-grams in
descending order. A document gets such a list too, and the out-of-place distance
sums, over the document's n-grams, how far each stands from its place in the
profile; an n-gram that the profile lacks costs the profile's full length.

Counting the training text is a Spark aggregation: every task counts the n-grams
of its own batches per language, a shuffle adds the counts up, and a ranking
window keeps the first ``profile_size`` per language. The profiles (languages x
``profile_size`` rows) are all that reaches the driver, whatever the input.

Defined results: null text, or text without a letter, is ``und`` with score 0.
Rows with null or empty language, or null text, teach nothing. Ties in frequency go to
the smaller n-gram code, ties in distance to the alphabetically first language.
Repeated rows count as often as they occur. With no training rows every document
is ``und``. Columns of the input other than id, text and language are ignored by
``train_profiles`` and carried along by ``predict_language``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import map_text

PROFILE_SIZE = 500
ORDERS = (1, 2, 3)
#: Code points take 21 bits, so three of them fit in one signed 64-bit code.
BITS = 21
#: Stands for a word's beginning and end; a symbol of its own, so that " a" and "a" have different codes.
EDGE = 1
FLUSH_CODES = 4_000_000

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """True at each code point that is a letter; built once in each worker."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def _symbols(text: str) -> np.ndarray:
    """Lower-cased code points with every run of other characters as one ``EDGE``."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    points = np.where(_letter_table()[points], points, EDGE)
    points = np.concatenate(([EDGE], points, [EDGE]))
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != EDGE) | (points[:-1] != EDGE)
    return points[keep]


def ngram_codes(text: str, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """One code per n-gram occurrence; word ends count as a symbol, n-grams do not span words."""
    s = _symbols(text)
    if len(s) < 3:
        return np.empty(0, np.int64)
    found = []
    for n in orders:
        if len(s) < n:
            continue
        width = len(s) - n + 1
        code = np.zeros(width, np.int64)
        whole = np.ones(width, bool)
        for k in range(n):
            part = s[k : k + width]
            code = (code << BITS) | part
            if 0 < k < n - 1:
                whole &= part != EDGE
        if n == 1:
            whole = s != EDGE
        found.append(code[whole])
    return np.concatenate(found)


def _ranked(codes: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, most frequent first."""
    values, counts = np.unique(codes, return_counts=True)
    if len(values) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        near = counts >= least
        values, counts = values[near], counts[near]
    return values[np.lexsort((values, -counts))][:size]


def _counter(orders: tuple[int, ...]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def flush():
            for lang, parts in held.items():
                values, counts = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.record_batch([pa.array([lang] * len(values)), pa.array(values), pa.array(counts)], ["lang", "code", "n"])

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = ngram_codes(text, orders)
                if len(codes):
                    held.setdefault(lang, []).append(codes)
                    size += len(codes)
                if size > FLUSH_CODES:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    return count


def train_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", profile_size: int = PROFILE_SIZE, orders: tuple[int, ...] = ORDERS) -> dict[str, np.ndarray]:
    """Language -> its n-gram codes, most frequent first."""
    learn = docs.where(F.col(text).isNotNull() & (F.col(lang) != "")).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    counts = learn.mapInArrow(_counter(orders), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    rows = counts.withColumn("place", F.row_number().over(place)).where(F.col("place") <= profile_size).select("lang", "code", "place").collect()
    profiles: dict[str, list[int]] = {}
    for row in sorted(rows, key=lambda r: (r.lang, r.place)):
        profiles.setdefault(row.lang, []).append(row.code)
    return {k: np.array(v, np.int64) for k, v in sorted(profiles.items())}


def out_of_place(document: np.ndarray, codes: np.ndarray, places: np.ndarray) -> int:
    """Distance of a ranked document to one profile (``codes`` ascending, ``places`` theirs)."""
    at = np.minimum(np.searchsorted(codes, document), len(codes) - 1)
    known = codes[at] == document
    distance = np.abs(places[at] - np.arange(len(document)))
    return int(np.where(known, distance, len(codes)).sum())


def _classifier(profiles: dict[str, np.ndarray], profile_size: int, orders: tuple[int, ...]):
    def start():
        names, tables = list(profiles), []
        for codes in profiles.values():
            order = np.argsort(codes)
            tables.append((codes[order], order))

        def classify(texts: list) -> list[pa.Array]:
            langs, scores, margins = [], [], []
            for text in texts:
                document = _ranked(ngram_codes(text, orders), profile_size) if text and names else ()
                if len(document) == 0:
                    langs.append("und"), scores.append(0.0), margins.append(0.0)
                    continue
                cost = np.array([out_of_place(document, c, p) / (len(document) * len(c)) for c, p in tables])
                best = int(cost.argmin())
                second = float(np.delete(cost, best).min()) if len(cost) > 1 else 1.0
                langs.append(names[best])
                scores.append(float(min(1.0, max(0.0, 1.0 - cost[best]))))
                margins.append(second - float(cost[best]))
            return [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64())]

        return classify

    return start


def predict_language(docs: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", profile_size: int = PROFILE_SIZE, orders: tuple[int, ...] = ORDERS, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (1 less the relative distance) and ``margin`` to the runner-up.

    Columns of those names in ``docs`` are replaced.
    """
    return map_text(docs, text, "lang_pred string, score double, margin double", _classifier(profiles, profile_size, orders), keep_text)


#: A text whose score is under this share of what nearly all known texts reach is of no learned language.
LEVEL_SHARE, LEVEL_QUANTILE = 0.7, 0.001


def least_score(known: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", lang: str = "lang", profile_size: int = PROFILE_SIZE, orders: tuple[int, ...] = ORDERS) -> float:
    """A level for ``score`` that texts of the learned languages practically never miss; 0 without any.

    It is taken from all rows of ``known``, texts that have not been learned from, whose ``lang`` is the predicted one.
    """
    rows = known.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    right = predict_language(rows, profiles, "text", profile_size, orders, keep_text=False).where(F.col("lang") == F.col("lang_pred"))
    return LEVEL_SHARE * (right.agg(F.percentile_approx("score", F.lit(LEVEL_QUANTILE), F.lit(10_000))).first()[0] or 0.0)
