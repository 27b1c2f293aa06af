"""Ranked lexical search over a bit-sliced impact index.

A term's impact on a document is an integer: its weight times a saturated term
frequency that is damped by the document's length. The index cuts the documents into
blocks; for each block and term it holds one bitmap for each binary digit of the
impacts. A query adds its terms' bitmaps up by bitwise carry arithmetic, 64 documents
at a time, which gives the digits of all scores of the block; the best documents are
found by going down from the most significant digit: those that have it, if there
are enough of them, else those and the best of the rest. Scores are exact.

1. Postings: one pass over the whole texts counts each document's terms and keeps the
   frequencies of the terms asked for. It is written once, to the checkpoint folder.
2. Corpus statistics over all documents (number, terms, document frequencies) from that table.
3. Blocks of up to ``BLOCK`` documents become rows of the index, ordered by id. Terms of
   few documents in a block are lists of places and impacts until a query needs their bitmaps.
4. Every block answers all queries with its ``k`` best each; two ranking windows, first
   by groups of blocks, then over those, keep the ``k`` best of all.

A text is read, and a block built, in one task; no list of a term's documents ever
meets in one place, however common the term is. Queries come in batches of about
``MAX_TERMS`` (query, term) pairs, the only thing that is sent to every task; a further
batch reads the documents again.

Defined results: null and empty texts hold no term, count nowhere and are not found;
queries without a known term get no row, those with a null id are one query. Terms of rows that repeat a query id are taken
together; of repeated rows in the documents each is a document of its own. Equal
scores go to the smaller id; a null id comes last. Only A-Z are lower-cased. Other columns are ignored.
An empty table on either side gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lectern.llm.common import cut_lineage

BLOCK = 16_384
MAX_TERMS = 100_000
#: Blocks are ranked in so many groups before the last ranking.
GROUPS = 64

#: Bytes of a term as they are, A-Z lower-cased, all others blank; bytes from 0x80 on belong to characters beyond ASCII.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of ``text`` in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impacts(tf: np.ndarray, weights: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What terms add to the scores of documents of ``n`` terms; all in 64-bit integers."""
    m = 100 - 50 + (50 * n * documents) // total
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def _postings(vocabulary):
    """``doc_id, n, terms, tfs`` of each document that has a term: how many it has, and its frequencies of the vocabulary's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(vocabulary.value)}
        for batch in batches:
            rows, sizes, terms, tfs = [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                found = terms_of(text)
                if found:
                    own = [(number[t], c) for t, c in Counter(found).items() if t in number]
                    rows.append(row)
                    sizes.append(len(found))
                    terms.append([t for t, _ in own])
                    tfs.append([c for _, c in own])
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.record_batch([ids, pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    return run


def bit_slices(places: np.ndarray, values: np.ndarray, words: int) -> np.ndarray:
    """Row ``i``: the bitmap, in ``words`` of 64 bits, of the places whose value has digit ``i``."""
    digits = int(values.max()).bit_length() if len(values) else 0
    flags = np.zeros((digits, words * 64), bool)
    flags[:, places] = (values >> np.arange(digits)[:, None]) & 1
    return np.packbits(flags, axis=1, bitorder="little").view("<u8")


def add_slices(total: list[np.ndarray], bits: np.ndarray) -> None:
    """Add ``bits`` to the digits in ``total``, carrying from each digit to the next."""
    carry = None
    for i in range(len(total) + 1 + len(bits)):
        if i >= len(bits) and (carry is None or not carry.any()):
            break
        if i == len(total):
            total.append(np.zeros_like(bits[0]))
        own = total[i]
        if i >= len(bits):
            total[i], carry = own ^ carry, own & carry
        elif carry is None:
            total[i], carry = own ^ bits[i], own & bits[i]
        else:
            half = own ^ bits[i]
            total[i], carry = half ^ carry, (own & bits[i]) | (half & carry)


def _places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def best_places(total: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` places of greatest value above 0, of equal ones the first, and their values."""
    if not total:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    rest = np.bitwise_or.reduce(total)
    sure = np.zeros_like(rest)
    for digit in reversed(total):
        having = sure | (rest & digit)
        n = int(np.bitwise_count(having).sum())
        if n < k:
            sure, rest = having, rest & ~digit
        else:
            rest = rest & digit
            if n == k:
                break
    first = _places(sure)
    places = np.concatenate([first, _places(rest)[: max(0, k - len(first))]])
    values = np.zeros(len(places), np.int64)
    for i, digit in enumerate(total):
        values |= ((digit[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << i
    return places, values


def _packed(places: np.ndarray, values: np.ndarray, words: int) -> bytes:
    """A term's impacts in a block: bitmaps by digit, or places and values where those are shorter."""
    digits = int(values.max()).bit_length()
    if 12 * len(places) < 8 * words * digits:
        return b"\0" + places.astype("<i4").tobytes() + values.astype("<i8").tobytes()
    return b"\1" + bit_slices(places, values, words).tobytes()


def _unpacked(data: bytes, words: int) -> np.ndarray:
    if data[0]:
        return np.frombuffer(data, "<u8", offset=1).reshape(-1, words)
    n = (len(data) - 1) // 12
    return bit_slices(np.frombuffer(data, "<i4", n, 1), np.frombuffer(data, "<i8", n, 1 + 4 * n), words)


def _blocks(weights, documents: int, total: int, block: int):
    """Postings -> rows of the index: ``docs`` in order of id, ``terms``, and ``lists``, what each term adds."""

    def indexed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        ids = rows.column(0).combine_chunks()
        order = np.lexsort((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        lists = rows.column(2).combine_chunks()
        sizes = lists.value_lengths().to_numpy()
        terms, tfs = lists.flatten().to_numpy(), rows.column(3).combine_chunks().flatten().to_numpy()
        at, n = np.repeat(place, sizes), np.repeat(rows.column(1).to_numpy(), sizes)
        values = impacts(tfs, weights.value[terms], n, documents, total)
        keep = values > 0
        terms, at, values = terms[keep], at[keep], values[keep]
        by_term = np.argsort(terms, kind="stable")
        terms, at, values = terms[by_term], at[by_term], values[by_term]
        starts = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1]))) if len(terms) else np.empty(0, np.int64)
        words = -(-len(order) // 64)
        packed = [_packed(at[a:b], values[a:b], words) for a, b in zip(starts, [*starts[1:], len(terms)])]
        return pa.record_batch([pa.array([ids.take(pa.array(order)).to_pylist()], pa.list_(pa.int64())), pa.array([terms[starts].tolist()], pa.list_(pa.int32())), pa.array([packed], pa.list_(pa.binary()))], ["docs", "terms", "lists"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, block - size)
                batch = batch.slice(part.num_rows)
                held.append(part)
                size += part.num_rows
                if size == block:
                    yield indexed(held)
                    held, size = [], 0
        if size:
            yield indexed(held)

    return run


def _answers(queries, k: int):
    """Rows of the index -> ``item, doc_id, score, salt``: each query's ``k`` best of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, terms, lists in zip(*(batch.column(i) for i in range(3))):
                ids = docs.values
                words = -(-len(ids) // 64)
                number, packed = {t: i for i, t in enumerate(terms.as_py())}, lists.values
                items, found, scores = [], [], []
                for item, wanted in enumerate(queries.value):
                    total: list[np.ndarray] = []
                    for t in wanted:
                        if t in number:
                            add_slices(total, _unpacked(packed[number[t]].as_py(), words))
                    places, values = best_places(total, k)
                    items.append(np.full(len(places), item, np.int32))
                    found.append(places)
                    scores.append(values)
                own = ids.take(pa.array(np.concatenate(found), pa.int64()))
                salt = np.full(len(own), (ids[0].as_py() or 0) % GROUPS, np.int32)
                yield pa.record_batch([pa.array(np.concatenate(items)), own, pa.array(np.concatenate(scores)), pa.array(salt)], ["item", "doc_id", "score", "salt"])

    return run


def _batches(queries: DataFrame, query_id: str, text: str, max_terms: int) -> Iterator[list]:
    """Lists of (query id, its terms), each of about ``max_terms`` terms in all."""
    once = queries.select(F.col(query_id).alias("id"), F.col(text).alias("text"))
    chars = once.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = 1 + chars // (2 * max_terms)  # a term has one character, and one between it and the next, at least
    for part in range(parts):
        rows = once.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).collect() if parts > 1 else once.collect()
        united: dict = {}
        for r in rows:
            united.setdefault(r.id, set()).update(terms_of(r.text))
        if any(united.values()):
            yield [(i, sorted(t)) for i, t in united.items() if t]


def search(docs: DataFrame, queries: DataFrame, k: int = 50, text: str = "text", doc_id: str = "doc_id", query_id: str = "item_id", query_text: str = "text", block: int = BLOCK, max_terms: int = MAX_TERMS) -> DataFrame:
    """``query_id, rank, doc_id, score``: each query's ``k`` best documents with a score above 0."""
    spark = docs.sparkSession
    id_type = queries.schema[query_id].dataType
    schema = StructType([StructField(query_id, id_type), StructField("rank", IntegerType())])
    out = None
    for batch in _batches(queries, query_id, query_text, max_terms):
        vocabulary = sorted({t for _, terms in batch for t in terms})
        number = {t: i for i, t in enumerate(vocabulary)}
        send = spark.sparkContext.broadcast
        postings = cut_lineage(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_postings(send(vocabulary)), "doc_id long, n long, terms array<int>, tfs array<long>"))
        documents, total = postings.agg(F.count("*"), F.sum("n")).first()
        if not documents:
            continue
        weights = np.zeros(len(vocabulary), np.int64)
        for r in postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # as many rows as the batch has terms
            weights[r["t"]] = weight(documents, r["count"])
        # a block is better full: as many tasks as there are blocks, or a quarter of their size at least
        packed = postings.coalesce(max(8, -(-4 * documents // block)))
        index = packed.mapInArrow(_blocks(send(weights), documents, total, block), "docs array<long>, terms array<int>, lists array<binary>")
        found = index.mapInArrow(_answers(send([[number[t] for t in terms] for _, terms in batch]), k), "item int, doc_id long, score long, salt int")
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        for keys in (["item", "salt"], ["item"]):
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(batch)], StructType([StructField("item", IntegerType()), StructField(query_id, id_type)]))
        answer = found.join(F.broadcast(names), "item").select(query_id, "rank", "doc_id", "score")
        out = answer if out is None else out.unionByName(answer)
    return out if out is not None else spark.createDataFrame([], schema).select(query_id, "rank", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("score"))
