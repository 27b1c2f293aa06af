"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences.

Documents are tokenised in Arrow batches and end with an end token; only longer
ones than a sequence are cut, with the remainder in the first piece. Pieces have
whole lengths from 1 to the capacity, so what decides the packing is the number
of pieces of each length: a table of at most ``capacity`` rows. Best-fit
decreasing runs over that table: a segment tree over remaining capacities finds
the tightest open sequence in logarithmic time, and pieces of one length that
would go to equally full sequences are placed together. The plan is exactly that
of best-fit decreasing over single pieces, its size depends on the capacity
alone, and neither documents nor pieces pass through the driver.

Each piece then learns its rank among pieces of its length: counts per length and
salt bucket, running totals of those, and a ranking window within each bucket,
so that a length which a third of all pieces share is spread over many tasks.
The rank finds its place in the broadcast plan by binary search.

Defined results: null or empty text is a piece of the end token alone. Repeated
rows are packed as often as they occur; a null id is packed like any other.
``capacity`` must be at least 1. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import cut_lineage

CAPACITY = 1024
END_TOKEN = 2
#: A run of so many blanks is not for the rank-based encoder, which fails between 600,000 and 1,000,000.
LONG_RUN = 100_000
BLANKS = re.compile(r"(?<!\s)\s{%d}" % LONG_RUN)
BUCKET_ROWS = 100_000
LEAST_BUCKETS = 32

_encoders: dict[str, object] = {}


def byte_level_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and ids of a byte-level BPE vocabulary in the tokenizers library's JSON form."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    model = json.load(open(path, encoding="utf-8"))
    added = added_tokens(path)
    return {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in added}


def added_tokens(path: str) -> dict[str, int]:
    """Spelling and id of the tokens that a vocabulary in the tokenizers library's JSON form adds to its merges."""
    return {t["content"]: t["id"] for t in json.load(open(path, encoding="utf-8")).get("added_tokens", [])}


def encoder(path: str):
    """text -> ids, loaded once in each worker.

    Both files of the public vocabulary hold the same merges in the same order; the
    rank-based encoder gives the ids that the tokenizers library gives (the tests
    compare them) in under a third of its time. Added tokens that a text spells out
    have their own ids, as there. The rank-based encoder's pattern fails on very
    long runs of blanks: texts with one go to an encoder that has no such limit.
    """
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        if path.endswith(".json"):
            ranks, added = byte_level_ranks(path), added_tokens(path)
        else:
            with open(path, "rb") as lines:
                ranks, added = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, {}
        fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        slow = functools.cache(lambda: _patient(path))

        def encode(text: str) -> list[int]:
            if len(text) >= LONG_RUN and BLANKS.search(text):
                return slow()(text)
            return fast.encode(text, allowed_special="all")

        _encoders[path] = encode
    return _encoders[path]


def _patient(path: str):
    """text -> ids at any length of a run, several times slower."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        return lambda text: whole.encode(text, add_special_tokens=False).ids
    import public_tokenizers

    from lectern.llm import byte_bpe

    own = byte_bpe.load(path, public_tokenizers.PATTERN)
    return lambda text: own.encode_batch([text])[0].tolist()


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than the capacity."""
    first = length % capacity or min(length, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, length, capacity)]


def tokenise_pieces(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end: int = END_TOKEN, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and the ids if asked for."""
    rows = docs.select(F.col(doc_id), F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            owner, piece, start, size, crc, tokens = [], [], [], [], [], []
            for k, value in enumerate(batch.column(1).to_pylist()):
                ids = np.array(encode(value or "") + [end], "<u4")
                for p, (s, n) in enumerate(cuts(len(ids), capacity)):
                    part = ids[s : s + n]
                    owner.append(k), piece.append(p), start.append(s), size.append(n), crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        tokens.append(part.astype(np.int64))
            out = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
            names = [batch.schema[0].name, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out.append(pa.array(tokens, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(out, names + ["ids"] * with_ids)

    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"`{doc_id}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


class CapacityTree:
    """Segment tree over remaining capacities: which of them some open sequence has."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = bytearray(2 * self.leaves)

    def set(self, at: int, is_open: bool) -> None:
        k = at + self.leaves
        self.open[k] = is_open
        while k > 1:
            k >>= 1
            self.open[k] = self.open[2 * k] | self.open[2 * k + 1]

    def tightest(self, least: int) -> int:
        """The smallest open remaining capacity of at least ``least``, or -1."""
        k = least + self.leaves
        while not self.open[k]:
            while k & 1:  # a right child: go up until there is a right sibling
                k >>= 1
                if k <= 1:
                    return -1
            k += 1
        while k < self.leaves:
            k = 2 * k if self.open[2 * k] else 2 * k + 1
        return k - self.leaves


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, list[tuple[int, int, int, int]]]:
    """length -> runs (first rank, first sequence, pieces in each sequence, offset of the first), by rank.

    A run holds ranks up to the next run's first; rank r of a run is in sequence
    first + (r - first rank) // pieces, after (r - first rank) % pieces of its kind.
    """
    tree, bins, made = CapacityTree(capacity), [[] for _ in range(capacity + 1)], 0
    runs: dict[int, list[tuple[int, int, int, int]]] = {}

    def put(remaining: int, first: int, many: int) -> None:
        if many:
            bins[remaining].append((first, many))
            tree.set(remaining, True)

    for length in sorted(counts, reverse=True):
        rank, left, out = 0, counts[length], runs.setdefault(length, [])
        while left:
            room = tree.tightest(length)
            if room < 0:
                room, first = capacity, made
                each = capacity // length
                many = -(-left // each)
                made += many
            else:
                first, many = bins[room].pop()
                if not bins[room]:
                    tree.set(room, False)
                each = room // length
            full = min(many, left // each)
            last = left - full * each if full < many else 0
            last = min(last, each)
            used = full + (last > 0)
            out.append((rank, first, each, capacity - room))
            put(room - each * length, first, full)
            put(room - last * length, first + full, int(last > 0))
            put(room, first + used, many - used)
            rank += full * each + last
            left -= full * each + last
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY, buckets: int | None = None) -> DataFrame:
    """``pieces`` (any columns, with ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    ``pieces`` is read several times: pass a written or checkpointed table.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if buckets is None:
        buckets = max(LEAST_BUCKETS, -(-max(histogram.values(), default=0) // BUCKET_ROWS))
    runs = {n: np.array(r, np.int64).T for n, r in plan(histogram, capacity).items()}
    shared = pieces.sparkSession.sparkContext.broadcast(runs)
    keys = [F.col(c) for c in pieces.columns]
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    counted = salted.groupBy("length", "__salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("length", "__salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    # all columns order the rows, so that a task that runs again ranks them alike
    place = Window.partitionBy("length", "__salt").orderBy(*keys)
    ranked = salted.withColumn("__rank", F.row_number().over(place) - 1).join(starts, ["length", "__salt"])
    ranked = ranked.select(*keys, (F.col("__rank") + F.col("__before")).alias("__rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            size = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("__rank")).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for length in np.unique(size):
                own = size == length
                first_rank, first, each, base = table[int(length)]
                at = np.searchsorted(first_rank, rank[own], "right") - 1
                step = rank[own] - first_rank[at]
                sequence[own] = first[at] + step // each[at]
                offset[own] = base[at] + step % each[at] * length
            kept = [f.name for f in batch.schema if f.name != "__rank"]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in kept] + [pa.array(sequence), pa.array(offset)], kept + ["sequence_id", "offset"])

    from pyspark.sql.types import LongType, StructType

    schema = StructType(list(pieces.schema.fields)).add("sequence_id", LongType()).add("offset", LongType())
    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end: int = END_TOKEN, with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` with their places; the pieces are checkpointed so that tokenising happens once."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    return pack(cut_lineage(tokenise_pieces(docs, path, text, doc_id, capacity, end, with_ids)), capacity)
