"""Near copies by the exact Jaccard similarity of their word shingles.

Two texts link if their sets of ``WORDS`` (5)-word shingles have a Jaccard
similarity of ``NUM / DEN`` (0.8) or more, and groups are the connected components
of the links. Nothing is estimated: every filter below is a bound that no such
pair can miss.

SimHash first: a set's fingerprint has the bits that most of its shingles' hashes set. Fingerprints
within 2 bits meet at the anchors of the covering code of ``simhash`` and make groups as there; each set of such a group is then
held against the group's smallest one by the exact similarity, and what passes is linked. Near copies may differ in up to some
11 bits, which no code that can be searched covers, so the search goes on among sets that no link has joined yet:

Prefix filter: all sets are put into one order, shingles that are common in a
sample last. Of two sets that are similar enough, the first n - ceil(0.8 n) + 1
shingles of each share one, so the holders of one shingle are a list in which pairs
meet. Lists with the same holders give the same pairs, so one of them stands for all.
The sample decides the order, and by that the cost, never the result.

Hub rounds: a list is not joined with itself. In each round its smallest set is the
hub, compared with the others of the list that are not in its group yet. Jaccard
distance is a metric: a set within 0.2 of a hub and one more than 0.4 away from it
cannot link, and sets that have met in one group need no further pair. So a list of
many copies costs a few passes over it. After the first, rounds go on while they halve what
is left and that is more than ``FEW`` comparisons a row; then the rest of each list is compared by
a join whose condition holds the bounds, so that only pairs that may link leave it.

Bitmap filter: a bitmap holds the parity of the shingles in each of its hash
classes, two or more for each shingle. Two bitmaps differ in at most as many bits as
the sets differ in shingles; a larger one folds to the size of a smaller one. Their sizes' difference is such a bound too. Only
pairs that pass are settled by the shingles of their texts.

Words, short texts and null ids are as in ``simhash``; texts without words are
copies of each other. Repeated rows are one set. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut_lineage, map_text, slices
from lectern.llm import simhash
from lectern.llm.simhash import SEED, components, first_of_each

WORDS = 5
NUM, DEN = 4, 5
#: Texts whose shingles are counted for the order, the least count of a common one, and how many are used at most.
SAMPLE, COMMON, MOST_COMMON = 5_000, 6, 100_000
#: As many keys of texts or lists are broadcast at most.
BROADCAST_ROWS = 200_000
#: Rounds of hubs at most (a bit of an int each), and how many comparisons a row of a list may have left for a join.
HUBS, FEW = 24, 1_000
TEXTS_A_FILE = 2_000
#: Texts or pairs of which a task holds Python objects at once.
AT_ONCE = 500
#: Ratio of a band of set sizes, a little over 1 / 0.8 so that rounding cannot part two that may link.
BAND = 1.26
#: Bits of the bitmap that such a join compares before it gives out a pair.
SMALL = 512


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the different shingles of one text."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.array([], "<u8")
    parts = [b" ".join(tokens)] if len(tokens) <= words else map(b" ".join, zip(*(tokens[k:] for k in range(words))))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, SEED) for s in parts), "<u8"))


def _sets():
    return lambda texts: [pa.array([shingles(t).view("<i8") for t in texts], pa.list_(pa.int64()))]


def _name(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).view(np.int64))


def bitmap(found: np.ndarray, classes: int = 0) -> bytes:
    """Parities of the shingles by hash class; the number of classes is a power of two, by default at least 64 and twice the shingles."""
    classes = classes or max(64, 1 << max(0, 2 * len(found) - 1).bit_length())
    odd = np.bincount((found & np.uint64(classes - 1)).astype(np.int64), minlength=classes) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differing(one: bytes, two: bytes) -> int:
    """At most the number of shingles that only one of the two bitmaps' sets has."""
    a, b = np.frombuffer(one, "<u8"), np.frombuffer(two, "<u8")
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _marks(common: np.ndarray, counts: np.ndarray):
    """Start of a task that gives each text its set's name, size, fingerprint, prefix and bitmap."""

    def start():
        def work(texts: list) -> list[pa.Array]:
            names, sizes, prints, prefixes, bitmaps, small = [], [], [], [], [], []
            for text in texts:
                found = shingles(text)
                n = len(found)
                seen = np.zeros(n, np.int64)
                if len(common) and n:
                    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
                    seen = np.where(common[at] == found, counts[at], 0)
                first = n - -(-NUM * n // DEN) + 1 if n else 0
                names.append(_name(found)), sizes.append(n), bitmaps.append(bitmap(found))
                prints.append(simhash.bits_of(found))
                small.append(np.frombuffer(bitmap(found, SMALL), "<i8"))
                prefixes.append(found[np.lexsort((found, seen))[:first]].view("<i8"))
            longs = pa.list_(pa.int64())
            return [pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(prefixes, longs), pa.array(small, longs), pa.array(bitmaps, pa.binary())]

        return work

    return start


def common_shingles(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, counts) of shingles that many texts of a sample have; bounded by ``MOST_COMMON``."""
    share = max(1, docs.count() // SAMPLE)
    some = docs.select(F.col(text).alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(share)) == 0)
    sets = map_text(some, "t", "found array<long>", _sets, keep_text=False, at_once=AT_ONCE)
    counted = sets.select(F.explode("found").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    rows = counted.orderBy(F.desc("n"), "h").limit(MOST_COMMON).collect()
    hashes = np.array([r["h"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.array([r["n"] for r in rows], np.int64)[order]


def _bounded(table: DataFrame) -> DataFrame:
    """A written ``table`` of keys, to be broadcast if it has no more than ``BROADCAST_ROWS`` rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _band(n: Column) -> Column:
    """A long with one bit set, of the set size's band: sizes within 0.8 of each other lie in one band or in neighbouring ones. Bands 64 apart share a bit."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.floor(F.log(F.greatest(n, F.lit(1))) / F.log(F.lit(BAND))), F.lit(64)).cast("int"))


def meetings(sets: DataFrame, known: DataFrame) -> DataFrame:
    """``token, sid, lab``: the lists of sets (sid, n, prefix) that share a shingle of their prefixes, each list of holders once; ``known`` has sets' groups (sid, label).

    A list in which no two sizes are within 0.8 of each other, or whose sets all are in one group already, has no pair left to find and goes.
    """
    held = sets.withColumn("band", _band(F.col("n"))).select("band", F.explode("prefix").alias("token"))
    seen = F.col("seen")
    beside = seen.bitwiseAND(F.call_function("shiftleft", seen, F.lit(1)).bitwiseOR(F.shiftrightunsigned(seen, 63))) != 0
    shared = held.groupBy("token").agg(F.count("*").alias("c"), F.bit_or("band").alias("seen")).where((F.col("c") > 1) & ((F.col("c") > F.bit_count(seen)) | beside))
    shared = cut_lineage(shared.select("token"))
    own = sets.select("sid", "prefix").join(known, "sid", "left").select("sid", F.coalesce("label", "sid").alias("lab"), F.explode("prefix").alias("token"))
    meeting = cut_lineage(own.join(_bounded(shared), "token").select("token", "sid", "lab"))
    holders = meeting.groupBy("token").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("sid")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "sid")).alias("y"), (F.min("lab") < F.max("lab")).alias("open")).where("open")
    once = cut_lineage(holders.groupBy("c", "x", "y").agg(F.min("token").alias("token")).select("token"))
    return meeting.join(_bounded(once), "token").select("token", "sid", "lab")


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, AT_ONCE):
        one, two = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        both = one + two
        unlike = np.fromiter(map(differing, batch.column(4).to_pylist(), batch.column(5).to_pylist()), np.int64, len(both))
        unlike = np.maximum(unlike, np.abs(one - two))
        # distances of at most 0.2 and of more than 0.4, told from a bound from below
        close, far = (NUM + DEN) * unlike <= (DEN - NUM) * both, 4 * unlike > both
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(close), pa.array(far)], ["a", "b", "close", "far"])


def bounded_distance(pairs: DataFrame, sets: DataFrame, most: int | None = None) -> DataFrame:
    """``a, b, close, far`` of pairs (a, b): whether the bitmaps of ``sets`` let them link, or prove more than twice that distance."""
    of = lambda s: sets.select(F.col("sid").alias(s), F.col("n").alias(f"{s}_n"), F.col("bits").alias(f"{s}_bits"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "a_n", "b_n", "a_bits", "b_bits")
    return cut_lineage(both.mapInArrow(_bounds, "a long, b long, close boolean, far boolean"), most)


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, AT_ONCE):
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            one, two = shingles(x), shingles(y)
            both = len(np.intersect1d(one, two, assume_unique=True))
            keep.append((NUM + DEN) * both >= NUM * (len(one) + len(two)))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def similar(pairs: DataFrame, marked: DataFrame, keyed: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets whose texts are near copies: one text of each set is looked up by its key (t1, t2)."""
    n = pairs.count()
    asked = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    spoken = cut_lineage(marked.join(asked, "sid", "left_semi").groupBy("sid").agg(F.min(F.struct("t1", "t2")).alias("t")).select("sid", "t.t1", "t.t2"), 2 * n)
    texts = cut_lineage(keyed.select("t1", "t2", "__text").join(_bounded(spoken), ["t1", "t2"]).groupBy("sid").agg(F.first("__text").alias("text")), 2 * n, TEXTS_A_FILE)
    left, right = (texts.select(F.col("sid").alias(s), F.col("text").alias(f"{s}_text")) for s in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "a_text", "b_text")
    return cut_lineage(both.mapInArrow(_similar, "a long, b long"), n, TEXTS_A_FILE)


def _differing(a: str, b: str) -> Column:
    total = F.lit(0)
    for k in range(SMALL // 64):
        total = total + F.bit_count(F.get(F.col(a), F.lit(k)).bitwiseXOR(F.get(F.col(b), F.lit(k))))
    return total


def rest_of_lists(own: DataFrame, sets: DataFrame) -> DataFrame:
    """Different pairs (a, b) of rows of one list that neither have met in a group nor are too far apart by what is known."""
    rows = own.select("token", "sid", "lab", "near", "far").join(sets.select("sid", "n", "small"), "sid")
    a, b = rows.alias("a"), rows.alias("b")
    open_ = (F.col("a.token") == F.col("b.token")) & (F.col("a.sid") < F.col("b.sid")) & (F.col("a.lab") != F.col("b.lab"))
    told = (F.col("a.near").bitwiseAND(F.col("b.far")) == 0) & (F.col("a.far").bitwiseAND(F.col("b.near")) == 0)
    sizes = (NUM * F.col("a.n") <= DEN * F.col("b.n")) & (NUM * F.col("b.n") <= DEN * F.col("a.n"))
    near = (NUM + DEN) * _differing("a.small", "b.small") <= (DEN - NUM) * (F.col("a.n") + F.col("b.n"))
    return a.join(b, open_ & told & sizes & near).select(F.col("a.sid").alias("a"), F.col("b.sid").alias("b")).distinct()


def _ordered(one: str, two: str) -> list:
    return [F.least(one, two).alias("a"), F.greatest(one, two).alias("b")]


def fingerprint_links(sets: DataFrame, settle) -> DataFrame:
    """Links (a, b) between the smallest set of each SimHash group of ``sets`` (sid, fp, n, bits) and its others, as far as ``settle`` keeps them."""
    prints = cut_lineage(sets.groupBy("fp").agg(F.min("sid").alias("least")))
    member = components(simhash.links(prints.select("fp"))).withColumnRenamed("label", "print")
    grouped = cut_lineage(prints.join(member, "fp", "left").select("fp", "least", F.coalesce("print", "fp").alias("print")))
    head = grouped.groupBy("print").agg(F.min("least").alias("head"))
    named = grouped.join(head, "print").select("fp", "head")
    pairs = sets.select("sid", "fp").join(named, "fp").where(F.col("sid") != F.col("head")).select(*_ordered("head", "sid"))
    return settle(bounded_distance(pairs, sets).where("close").select("a", "b"))


def group_labels(rows: DataFrame, sets: DataFrame, settle, links: DataFrame | None = None) -> DataFrame | None:
    """``sid, label`` of all sets that link to another; ``rows`` are lists (token, sid), ``settle`` keeps the pairs that link, ``links`` are known.

    If ``rows`` have ``lab``, that is what ``links`` make of their sets.

    A row's bits ``near`` and ``far`` say for each round whether its set links to the hub, or is too far from
    it to link to a set that does.
    """
    rows, links, label, before = cut_lineage(rows.withColumns({"near": F.lit(0), "far": F.lit(0)})), links, None, float("inf")
    if links is not None and "lab" not in rows.columns:
        label = components(links).withColumnRenamed("fp", "sid")
    most = rows.count()
    for turn in range(HUBS + 1):
        if "lab" in rows.columns:
            own = rows
        else:
            own = rows.withColumn("lab", F.col("sid")) if label is None else rows.join(label, "sid", "left").withColumn("lab", F.coalesce("label", "sid")).drop("label")
        first = F.min(F.struct("sid", "lab", "near", "far")).alias("hub")
        lists = own.groupBy("token", "lab").agg(F.count("*").alias("k"), first).groupBy("token").agg(F.count("*").alias("labels"), F.sum("k").alias("c"), F.sum(F.col("k") * F.col("k")).alias("q"), F.min("hub").alias("hub")).where("labels > 1")
        lists = cut_lineage(lists.select("token", "c", ((F.col("c") * F.col("c") - F.col("q")) / 2).alias("left"), F.col("hub.sid").alias("hub"), F.col("hub.lab").alias("h_lab"), F.col("hub.near").alias("h_near"), F.col("hub.far").alias("h_far")), most)
        held, left = lists.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum("left"), F.lit(0.0))).first()
        if not held:
            break
        last = turn == HUBS or turn > 0 and (left <= FEW * held or 2 * left > before)
        own, before = own.join(lists, "token"), left
        if last:
            pairs = rest_of_lists(own, sets)
        else:
            may = (F.col("near").bitwiseAND(F.col("h_far")) == 0) & (F.col("far").bitwiseAND(F.col("h_near")) == 0)
            pairs = own.where((F.col("lab") != F.col("h_lab")) & may).select(*_ordered("sid", "hub")).distinct()
        verdict = bounded_distance(pairs, sets, None if last else most)  # a row has one hub
        found = settle(verdict.where("close").select("a", "b"))
        links = found if links is None else links.unionByName(found)
        label = components(links).withColumnRenamed("fp", "sid")
        if last:
            break
        told = verdict.where("close or far").join(found.withColumn("link", F.lit(True)), ["a", "b"], "left").select("a", "b", "far", F.coalesce("link", F.lit(False)).alias("link"))
        bit = F.lit(1 << turn)
        met = own.where(F.col("sid") != F.col("hub")).select("token", "sid", "near", "far", *_ordered("sid", "hub")).join(told.withColumnRenamed("far", "is_far"), ["a", "b"], "left")
        rows = cut_lineage(met.select("token", "sid", F.when(F.col("link"), F.col("near").bitwiseOR(bit)).otherwise(F.col("near")).alias("near"), F.when(F.col("is_far"), F.col("far").bitwiseOR(bit)).otherwise(F.col("far")).alias("far")), most)
    if label is None and links is not None:
        label = components(links).withColumnRenamed("fp", "sid")
    return label


def grouped(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: its key (``id`` and two hashes of its text) and ``label``, the same within a group of near copies."""
    keyed = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), F.col(text).alias("__text"))
    marks = _marks(*common_shingles(docs, text))
    whole = cut_lineage(map_text(keyed, "__text", "sid long, n long, fp long, prefix array<long>, small array<long>, bits binary", marks, keep_text=False, at_once=AT_ONCE))
    marked = whole.select("id", "t1", "t2", "sid")
    sets = cut_lineage(whole.groupBy("sid").agg(*[F.first(c).alias(c) for c in ("n", "fp", "prefix", "small", "bits")]))
    settle = lambda pairs: similar(pairs, marked, keyed)
    links = fingerprint_links(sets, settle)
    # each such link leads from its group's smallest set, so these are stars, which need no search for components
    known = links.select(F.col("b").alias("sid"), F.col("a").alias("label")).union(links.select("a", "a").distinct())
    label = group_labels(meetings(sets, known), sets.select("sid", "n", "small", "bits"), settle, links)
    if label is None:
        return marked.withColumn("label", F.col("sid"))
    return marked.join(label, "sid", "left").withColumn("label", F.coalesce("label", "sid"))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group: the smallest id (null ids last), then the smaller text hash."""
    return first_of_each(docs, grouped(docs, text, doc_id), text, doc_id)
