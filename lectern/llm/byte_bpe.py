"""Byte-level BPE encoding and decoding in padded numpy matrices.

A text is split by the tokenizer's pattern, and each match is encoded by itself.
Matches that a task has not met yet are gathered, put into buckets by length and
laid out as rows of a padded matrix of ids, one per byte. In each round every row
merges its leftmost pair of the smallest rank: pair ranks come from a hash table in
numpy arrays (open addressing), the merged row closes up by one place, and rows
without a pair left leave the matrix. Only the two pairs beside a merge are
looked up again. Decoding gathers the bytes of all ids of a batch at once.

A match longer than ``MATRIX_WIDTH`` bytes would cost the square of its length in
a matrix; it takes the same merges from a heap of pairs in n log n instead.

Defined results: null text counts as empty and has no ids; special tokens do not
exist, their spelling is ordinary text. Added columns replace columns of their
names; repeated rows give repeated results. An empty table gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm.common import map_text

MATRIX_WIDTH = 256
BUCKETS = (4, 8, 12, 16, 24, 32, 64, 128, MATRIX_WIDTH)
ROWS = 16_384
#: Matches of at most ``MATRIX_WIDTH`` bytes that a worker keeps.
CACHE = 150_000
#: Characters of text whose matches are held at once.
STEP = 500_000
NONE = np.int32(2**31 - 1)


class PairTable:
    """(left id, right id) -> merged id, by open addressing with linear probing."""

    EMPTY = np.int64(-1)

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.shift = 64 - max(4, int(4 * len(left)).bit_length())
        size = 1 << (64 - self.shift)
        self.mask = size - 1
        self.keys = np.full(size, self.EMPTY)
        self.values = np.full(size, NONE)
        keys, values = self._key(left, right), merged.astype(np.int32)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] == self.EMPTY
            self.keys[at[free]] = keys[free]  # of several for one slot the last stays
            done = self.keys[at] == keys
            self.values[at[done]] = values[done]
            keys, values, at = keys[~done], values[~done], (at[~done] + 1) & self.mask

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.int64) << 32 | right.astype(np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        return (mixed >> np.uint64(self.shift)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, ``NONE`` where a pair has none."""
        shape = left.shape
        keys = self._key(left, right).ravel()
        at = self._slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], NONE)
        open_ = np.flatnonzero((held != keys) & (held != self.EMPTY))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            held = self.keys[at[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (held != self.EMPTY)]
        return out.reshape(shape)


class ByteBPE:
    """Encoder and decoder for a rank table of byte strings, with the pattern that splits texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.split = regex.compile(pattern).findall
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        self.pairs = PairTable(np.array(left, np.int32), np.array(right, np.int32), np.array(merged, np.int32))
        size = max(ranks.values()) + 1
        spelled, decimal = [b""] * size, [b"%d," % k for k in range(size)]
        for token, rank in ranks.items():
            spelled[rank] = token
        self.spelled, self.decimal = Gather(spelled), Gather(decimal)
        self.known: dict[str, bytes] = {}
        self.long: list[str] = []

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    def _matrix(self, matches: list[bytes], width: int) -> list[bytes]:
        """Ids (as bytes of unsigned 32-bit integers) of matches of at most ``width`` bytes."""
        sizes = np.fromiter(map(len, matches), np.int64, len(matches))
        raw = np.frombuffer(b"".join(m.ljust(width, b"\0") for m in matches), np.uint8).reshape(len(matches), width)
        ids = self.byte_ids[raw]
        column = np.arange(width)
        ids[column >= sizes[:, None]] = -1
        rank = np.full((len(matches), max(1, width - 1)), NONE, np.int32)
        if width > 1:
            inside = column[1:] < sizes[:, None]
            rank[inside] = self.pairs.find(ids[:, :-1][inside], ids[:, 1:][inside])
        rows, out = np.arange(len(matches)), [b""] * len(matches)

        def leave(done: np.ndarray) -> None:
            for row, own, n in zip(rows[done], ids[done].astype("<u4"), sizes[done]):
                out[row] = own[:n].tobytes()

        while len(rows):
            at = rank.argmin(axis=1)
            line = np.arange(len(rows))
            best = rank[line, at]
            done = best == NONE
            if done.any():
                leave(done)
                go = ~done
                ids, rank, rows, sizes, at, best = ids[go], rank[go], rows[go], sizes[go], at[go], best[go]
                line = np.arange(len(rows))
                if not len(rows):
                    break
            ids[line, at] = best
            # the merged row closes up; what falls off at its end was padding or has moved
            take = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, take + (take > at[:, None]), axis=1)
            if ids.shape[1] == 1:
                rank = np.full((len(rows), 1), NONE, np.int32)
            else:
                take = np.arange(rank.shape[1] - 1)
                rank = np.take_along_axis(rank, take + (take >= at[:, None]), axis=1)
            sizes = sizes - 1
            before = np.flatnonzero(at > 0)
            rank[before, at[before] - 1] = self.pairs.find(ids[before, at[before] - 1], ids[before, at[before]])
            after = np.flatnonzero(at + 1 < sizes)
            rank[after, at[after]] = self.pairs.find(ids[after, at[after]], ids[after, at[after] + 1])
            last = at + 1 == sizes  # the merge reached the row's end: no pair starts there
            edge = np.flatnonzero(last & (at < rank.shape[1]))
            rank[edge, at[edge]] = NONE
        return out

    def _heap(self, match: bytes) -> bytes:
        """The same merges for one long match, from a heap of (rank, place)."""
        ids = self.byte_ids[np.frombuffer(match, np.uint8)].tolist()
        n, ranks, names = len(ids), self.ranks, [match[k : k + 1] for k in range(len(match))]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n

        def offer(k: int) -> None:
            if 0 <= k and after[k] < n:
                rank = ranks.get(names[k] + names[after[k]])
                if rank is not None:
                    heapq.heappush(queue, (rank, k, names[k], names[after[k]]))

        queue: list[tuple[int, int, bytes, bytes]] = []
        for k in range(n - 1):
            offer(k)
        while queue:
            rank, k, a, b = heapq.heappop(queue)
            if not alive[k] or names[k] != a or after[k] >= n or names[after[k]] != b:
                continue
            gone = after[k]
            names[k], ids[k], alive[gone] = a + b, rank, False
            after[k] = after[gone]
            if after[k] < n:
                before[after[k]] = k
            offer(k)
            offer(before[k])
        return np.array([i for i, live in zip(ids, alive) if live], "<u4").tobytes()

    def learn(self, matches: set[str]) -> None:
        """Encode matches that are not known yet."""
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for match in matches:
            raw = match.encode("utf-8", "surrogatepass")
            width = next((w for w in BUCKETS if len(raw) <= w), 0)
            if width:
                by_width.setdefault(width, []).append((match, raw))
            else:
                self.known[match] = self._heap(raw)
                self.long.append(match)
        for width, found in by_width.items():
            for start in range(0, len(found), ROWS):
                part = found[start : start + ROWS]
                self.known.update(zip((m for m, _ in part), self._matrix([r for _, r in part], width)))

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text as an array of unsigned 32-bit integers."""
        out: list[np.ndarray] = []
        start = 0
        while start < len(texts):
            split, size = [], 0
            while start < len(texts) and (not split or size < STEP):
                split.append(self.split(texts[start] or ""))
                size += len(texts[start] or "")
                start += 1
            met = set().union(*split)
            fresh = met.difference(self.known)
            if len(self.known) + len(fresh) > CACHE:  # begins anew between splits only: all matches of one are held, however many
                self.known, fresh = {}, met
            self.learn(fresh)
            find = self.known.__getitem__
            out += [np.frombuffer(b"".join(map(find, matches)), "<u4") for matches in split]
            while self.long:  # of any length, so they stay for their split only; what is kept is bounded in bytes as well
                self.known.pop(self.long.pop(), None)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return self.spelled.join(ids)


class Gather:
    """Byte strings by number, joined for whole arrays of numbers."""

    def __init__(self, strings: list[bytes]):
        self.flat = np.frombuffer(b"".join(strings), np.uint8)
        self.sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def join(self, numbers: np.ndarray) -> bytes:
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[numbers] - (ends - sizes), sizes) + np.arange(total)].tobytes()


_loaded: dict[tuple[str, str], ByteBPE] = {}


def load(path: str, pattern: str) -> ByteBPE:
    """One encoder per file in each worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBPE.from_file(path, pattern)
    return _loaded[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` and ``decoded``, the text that the ids spell."""

    def start():
        bpe = load(path, pattern)

        def work(texts: list) -> list[pa.Array]:
            ids = bpe.encode_batch(texts)
            return [pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())), pa.array([bpe.decode(i).decode("utf-8", "replace") for i in ids])]

        return work

    return map_text(docs, text, "ids array<int>, decoded string", start)


def encode_digests(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` less the text, with the number of ids and digests of ids and decoded bytes."""

    def start():
        bpe = load(path, pattern)

        def work(texts: list) -> list[pa.Array]:
            counts, id_sums, byte_sums = [], [], []
            for k in range(0, len(texts), 256):
                for ids in bpe.encode_batch(texts[k : k + 256]):
                    counts.append(len(ids))
                    id_sums.append(hashlib.sha256(bpe.decimal.join(ids)[:-1]).hexdigest())
                    byte_sums.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            return [pa.array(counts, pa.int64()), pa.array(id_sums), pa.array(byte_sums)]

        return work

    return map_text(docs, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", start, keep_text=False)
