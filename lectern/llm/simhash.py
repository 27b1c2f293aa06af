"""Near-duplicate groups by SimHash fingerprints, compared per anchor of a covering code.

A fingerprint has a bit for each of the 64 hash bits that most of the text's word
shingles set. Two fingerprints link at ``THRESHOLD`` (2) or fewer differing bits,
and groups are the connected components of the links.

Anchor-point covering. The anchors are the codewords of a covering code on each
32-bit half: the [31, 26] Hamming code, whose covering radius is 1, with the
half's last bit carried along. Two fingerprints within 2 bits differ by at most
1 bit in one of the halves; there, the anchor next to the first is within
covering radius 1 plus 1 of the second. So each fingerprint has one home anchor
in each half and is replicated to every anchor within distance 2 of it (16 or 17
of 2**27), and a join by anchor meets every link: homes on one side, replicas on
the other, then the exact bit count. Nothing is missed and nothing is estimated.

Only different fingerprints take part (copies share one row), so a group of a
million copies costs one fingerprint. Components come from joins over the links
with the smallest id handed down and pointer jumping, written to the checkpoint
folder in each round; no links, labels or fingerprints reach the driver.

Defined results: A-Z is lower-cased, words are runs without blanks or controls
9-13; a text with fewer words than a shingle has its whole sequence as one
shingle. Null, empty and blank texts have fingerprint zero and link like any
other. Null ids get a component but never name one, unless all of it is null.
Rows that repeat keep their repeats. Added columns replace columns of their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import LEAST_FILES, ROWS_A_FILE, cut_lineage, map_text, without

SHINGLE = 3
THRESHOLD = 2
SEED = 42
BLOCK = 65_536
MAX_ROUNDS = 40


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """The 64-bit SimHash of one text, as an unsigned integer."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*(tokens[k:] for k in range(words))))
    digest = xxhash.xxh64_intdigest
    return bits_of(np.fromiter((digest(s, SEED) for s in shingles), "<u8"))


def bits_of(hashes: np.ndarray) -> int:
    """The bits that more than half of the 64-bit ``hashes`` set; 0 for none."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), BLOCK):
        part = hashes[start : start + BLOCK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = 2 * ones > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(words: int):
    def start():
        def work(texts: list) -> list[pa.Array]:
            values = np.array([fingerprint(t, words) for t in texts], np.uint64)
            return [pa.array(values.view(np.int64))]

        return work

    return start


def with_fingerprints(docs: DataFrame, text: str = "text", words: int = SHINGLE, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``__fp``, the fingerprint as a signed long of the same bits."""
    return map_text(docs, text, "__fp long", _fingerprints(words), keep_text)


def _parity(value: Column) -> Column:
    return F.bit_count(value) % 2


#: Bit k of mask j is set where bit j of k + 1 is: the columns of the [31, 26] Hamming code's check matrix.
CHECKS = [sum(1 << k for k in range(31) if (k + 1) >> j & 1) for j in range(5)]


def _syndrome(half: Column) -> Column:
    """0 for a codeword, else 1 + the place of the bit that leads to one."""
    total = F.lit(0)
    for j, mask in enumerate(CHECKS):
        total = total + _parity(half.bitwiseAND(F.lit(mask))) * F.lit(1 << j)
    return total.cast("int")


def _flip(half: Column, place: Column) -> Column:
    """``half`` with bit ``place`` - 1 turned over; place 0 turns nothing."""
    return F.when(place == 0, half).otherwise(half.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), place - 1)))


def anchors(fingerprints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(homes, replicas): rows ``side, anchor, fp`` for distinct fingerprints ``fp``."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(F.col("fp"), 32)
    halves = fingerprints.select("fp", F.posexplode(F.array(low, high)).alias("side", "half")).withColumn("s", _syndrome(F.col("half")))
    homes = halves.select("side", _flip(F.col("half"), F.col("s")).alias("anchor"), "fp")
    # Codewords within distance 2 of the half: its home; for each bit i, the codeword after turning i and
    # one more bit, the places i and j with i xor j = s counted once; the home with the carried bit turned.
    near = F.filter(
        F.transform(F.sequence(F.lit(1), F.lit(31)), lambda i: F.when((i != F.col("s")) & (i < i.bitwiseXOR(F.col("s"))), _flip(_flip(F.col("half"), i), i.bitwiseXOR(F.col("s"))))),
        lambda a: a.isNotNull(),
    )
    carried = _flip(F.col("half"), F.col("s")).bitwiseXOR(F.lit(1 << 31))
    reach = F.concat(F.array(_flip(F.col("half"), F.col("s")), carried), near)
    replicas = halves.select("side", F.explode(reach).alias("anchor"), "fp")
    return homes, replicas


def links(fingerprints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs ``a < b`` (as signed longs) of different fingerprints within ``threshold`` bits."""
    if not 0 <= threshold <= 2:
        raise ValueError("the anchors of this code cover thresholds up to 2")
    homes, replicas = anchors(fingerprints)
    h, r = homes.alias("h"), replicas.alias("r")
    close = (F.col("h.side") == F.col("r.side")) & (F.col("h.anchor") == F.col("r.anchor")) & (F.col("h.fp") < F.col("r.fp")) & (F.bit_count(F.col("h.fp").bitwiseXOR(F.col("r.fp"))) <= threshold)
    return h.join(r, close).select(F.col("h.fp").alias("a"), F.col("r.fp").alias("b"))


def components(pairs: DataFrame) -> DataFrame:
    """(fp, label) for every fingerprint in ``pairs`` (a, b): the smallest one in its connected component.

    Every round hands each node, and the node its label names, the smallest label
    among its neighbours, then its label's own label (pointer jumping), so that
    long chains take a logarithmic number of rounds.
    """
    edges = cut_lineage(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("b", "a")).distinct())
    most = edges.count()  # and no more nodes than that
    edges = edges.coalesce(max(LEAST_FILES, -(-most // ROWS_A_FILE)))
    state = cut_lineage(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p")), most)
    for _ in range(MAX_ROUNDS):
        seen = edges.join(state.select(F.col("u").alias("v"), F.col("p").alias("q")), "v").groupBy("u").agg(F.min("q").alias("q"))
        offered = state.join(seen, "u").select("u", "p", F.least("p", "q").alias("m"))
        hooks = offered.select(F.col("p").alias("u"), "m").union(offered.select("u", "m")).groupBy("u").agg(F.min("m").alias("m"))
        hooked = state.join(hooks, "u").select("u", F.col("p").alias("old"), F.least("p", "m").alias("p"))
        jump = hooked.select(F.col("u").alias("p"), F.col("p").alias("g"))
        after = cut_lineage(hooked.join(jump, "p").select("u", "old", F.least("p", "g").alias("p")), most)
        changed = after.where(F.col("old") != F.col("p")).limit(1).count()
        state = after.select("u", "p")
        if not changed:
            return state.select(F.col("u").alias("fp"), F.col("p").alias("label"))
    raise RuntimeError("components have not settled; raise MAX_ROUNDS")


def _grouped(docs: DataFrame, text: str, doc_id: str, words: int, threshold: int) -> DataFrame:
    """Per row: its key (``id`` and two hashes of its text), ``__fp`` and ``component_id``."""
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), F.col(text).alias("__text"))
    marked = cut_lineage(with_fingerprints(rows, "__text", words, keep_text=False))
    smallest = cut_lineage(marked.groupBy("__fp").agg(F.min("id").alias("smallest")))
    member = components(links(smallest.select(F.col("__fp").alias("fp")), threshold)).withColumnRenamed("fp", "__fp")
    # the label is a fingerprint; a component's name is the smallest id of its members
    grouped = smallest.join(member, "__fp", "left").select("__fp", "smallest", F.coalesce("label", "__fp").alias("label"))
    named = grouped.groupBy("label").agg(F.min("smallest").alias("component_id"))
    table = grouped.join(named, "label").select("__fp", "component_id", "label")
    return marked.join(table, "__fp")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: its id, ``fingerprint`` (16 hex digits) and ``component_id``."""
    hexed = F.lower(F.lpad(F.hex("__fp"), 16, "0"))
    return _grouped(docs, text, doc_id, words, threshold).select(F.col("id").alias(doc_id), hexed.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the smallest id (null ids last), then the smaller text hash."""
    return first_of_each(docs, _grouped(docs, text, doc_id, words, threshold), text, doc_id)


def first_of_each(docs: DataFrame, grouped: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``docs`` with one row of each ``label`` in ``grouped`` (id, t1, t2, label)."""
    key = F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("id"), F.col("t1").alias("t1"), F.col("t2").alias("t2"))
    best = grouped.groupBy("label", key.alias("k")).agg(F.count("*").alias("rows"))
    best = best.groupBy("label").agg(F.min_by(F.struct("k", "rows"), "k").alias("b")).select(F.col("b.k.id").alias("__id"), F.col("b.k.t1").alias("__t1"), F.col("b.k.t2").alias("__t2"), F.col("b.rows").alias("__rows"))
    own = without(docs, "__id", "__t1", "__t2", "__rows")
    rows = own.withColumns({"__t1": F.xxhash64(text), "__t2": F.xxhash64(F.lit(1), text)})
    same = (F.col("d.__t1") == F.col("b.__t1")) & (F.col("d.__t2") == F.col("b.__t2")) & F.col(f"d.`{doc_id}`").eqNullSafe(F.col("b.__id"))
    kept = rows.alias("d").join(best.alias("b"), same).select("d.*", "b.__rows")
    once = kept.where(F.col("__rows") == 1).select(*own.columns)
    # only a chosen row that occurs again needs a further pass
    again = kept.where(F.col("__rows") > 1).dropDuplicates(["__t1", "__t2", doc_id]).select(*own.columns)
    return once.unionByName(again)
