"""Periodic runs of words: stretches that repeat one short period several times over.

A run is a stretch of consecutive words whose smallest period is ``q`` (words ``q``
apart are identical), that holds at least ``min_exponent`` periods and ``min_length``
words, and that no neighbouring word extends keeping that period.

1. Mask. A run of length ``n`` and period ``q`` overlaps itself ``q`` words further on, so
   that each of its ``k``-grams stands in the text again as long as ``n >= 2q + k - 1``. The
   greatest ``k`` for which that holds for every admissible run follows from the two
   limits (5 for exponent 4 and 6 words). Stretches in which every ``k`` words in a row
   occur again in the text survive; no run reaches out of one. Equality of ``k``-grams is
   exact: ranks of pairs of ranks, not hashes.
2. Main-Lorentz on the survivors only. A block is halved; four Z-functions give, for
   each period, how far words that far apart agree to both sides of the middle; halves
   follow. A run is found in the smallest block that holds it. What a neighbouring word
   extends is a part of a run that a larger block finds, and is dropped. Of several
   periods of one stretch the smallest stays.

The work is linear in the words, and n log n in those that survive; a task holds one
batch of texts. Rows are independent, so nothing is shuffled.

Defined results: words are what stands between blanks, tabs, line ends and the like
(``WORD``). Null and empty texts have no words and no runs, and collapse to empty text.
Equal texts have equal results; repeated rows are treated alike; texts are read whole.
Added columns (``n_words``, ``runs``, ``collapsed``) replace columns of those names; others
pass through. An empty table gives an empty one.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm.common import map_text

#: Words are the longest matches of this.
WORD = r"[^\x20\x09-\x0D]+"
MIN_EXPONENT, MIN_LENGTH = 4, 6


def repeated_gram(min_exponent: int, min_length: int) -> int:
    """The greatest ``k`` for which every ``k``-gram of every admissible run stands in the text twice."""
    return max(1, min(max(min_length, min_exponent * q) - 2 * q + 1 for q in range(1, min_length + 2)))


def numbered(words: list[str]) -> np.ndarray:
    """A number for each word, the same for equal words."""
    known: dict[str, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def surviving(codes: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Stretches ``[start, end)`` all of whose ``k``-grams occur again among ``codes``."""
    if len(codes) <= k:
        return []
    gram, size = codes, 1
    while size < k:  # the rank of a longer gram is that of the pair of its first and last parts
        step = min(size, k - size)
        first = gram[: len(gram) - step]
        gram = np.unique(first * (int(gram.max()) + 1) + gram[step:], return_inverse=True)[1]
        size += step
    again = np.concatenate(([False], np.bincount(gram)[gram] > 1, [False]))
    edges = np.flatnonzero(again[1:] != again[:-1])
    return [(int(a), int(b) + k - 1) for a, b in zip(edges[::2], edges[1::2])]


def z_values(s: list[int], upto: int) -> list[int]:
    """For each place up to ``upto``: how many elements from there on equal the first ones."""
    n, left, right = len(s), 0, 0
    z = [n] + [0] * upto
    for i in range(1, min(upto + 1, n)):
        m = min(right - i, z[i - left]) if i < right else 0
        while i + m < n and s[m] == s[i + m]:
            m += 1
        if i + m > right:
            left, right = i, i + m
        z[i] = m
    return z


def _across(w: list[int], lo: int, mid: int, hi: int, exponent: int) -> list[tuple[int, int, int]]:
    """``start, end, period`` of the stretches in ``w[lo:hi]`` that cross ``mid`` and may be runs."""
    most = min((hi - lo) // exponent, mid - lo, hi - mid)
    u, v = w[lo:mid][::-1], w[mid:hi]
    ahead, behind = z_values(v, most), z_values(u, most)
    to_left = z_values([*v[:most], -1, *w[mid - most : mid]], 2 * most)  # beginnings of v in the end of u
    to_right = z_values([*u[:most], -1, *v[:most][::-1]], 2 * most)  # endings of u in the beginning of v
    found = []
    for p in range(1, most + 1):
        back = to_right[2 * most + 1 - p]
        back = back if back < p else p + behind[p]
        if ahead[p] + back >= (exponent - 1) * p:
            found.append((mid - back, mid + p + ahead[p], p))
        on = to_left[2 * most + 1 - p]
        if on < p and on + behind[p] >= (exponent - 1) * p:
            found.append((mid - p - behind[p], mid + on, p))
    return found


def main_lorentz(w: list[int], exponent: int, length: int) -> dict[tuple[int, int], int]:
    """``(start, end) -> smallest period`` of all runs in ``w``."""
    found: dict[tuple[int, int], int] = {}
    blocks = [(0, len(w))]
    while blocks:
        lo, hi = blocks.pop()
        if hi - lo < length:
            continue
        mid = (lo + hi) // 2
        blocks += [(lo, mid), (mid, hi)]
        for start, end, p in _across(w, lo, mid, hi, exponent):
            extended = start > 0 and w[start - 1] == w[start - 1 + p] or end < len(w) and w[end] == w[end - p]
            if not extended and end - start >= length:
                found[start, end] = min(p, found.get((start, end), p))
    return found


def runs_of(words: list[str], exponent: int = MIN_EXPONENT, length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """``start, length, period`` of each run, by start, then period."""
    if len(words) < length:
        return []
    codes = numbered(words)
    found = []
    for lo, hi in surviving(codes, repeated_gram(exponent, length)):
        for (start, end), p in main_lorentz(codes[lo:hi].tolist(), exponent, length).items():
            found.append((lo + start, end - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """``words`` less those that a run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, n, p in runs:
        keep[start + p : start + n] = False
    return [words[i] for i in np.flatnonzero(keep)]


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find_runs(docs: DataFrame, text: str = "text", min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed``, the text with each run cut to one period."""
    if min_exponent < 2 or min_length < 2:
        raise ValueError("runs have at least two periods and two words")

    def start():
        words_in = re.compile(WORD).findall

        def work(texts: list) -> list[pa.Array]:
            sizes, runs, collapsed = [], [], []
            for t in texts:
                words = words_in(t or "")
                found = runs_of(words, min_exponent, min_length)
                sizes.append(len(words))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                collapsed.append(" ".join(kept_words(words, found)))
            return [pa.array(sizes, pa.int64()), pa.array(runs, RUNS), pa.array(collapsed, pa.string())]

        return work

    return map_text(docs, text, "n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string", start, keep_text)
