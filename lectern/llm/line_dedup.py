"""Cross-site boilerplate removal by the number of sites that show a line.

A line's spread is the number of distinct sites it occurs on. HyperLogLog
sketches of the sites are built per line hash before the shuffle and merged after
it, so a line on a third of all rows costs a small sketch per task. Where the
estimate is too near the threshold to decide, the distinct sites of just those
lines are counted exactly. The tables of such lines are written once and counted:
a small one is broadcast, so that the lines stay where they are; a large one is
shuffled like the lines, and adaptive execution splits a hot line between tasks. Lines on ``min_sites`` or more sites go from every
document but the one with the smallest id (``keep_first``), so that copies of a
page do not erase its text altogether.

Main path: DataFrame functions only.

Defined results: lines are split at line feeds and compared without surrounding
blanks; blank lines are never removed. Null text stays null, a document whose
lines all go has empty text. A null site is a site of its own. A null id is larger than any other when the
first document is chosen; rows that repeat an id and a text are treated alike.
Added columns replace columns of their names; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut_lineage, without

MIN_SITES = 8
LG_CONFIG = 12
#: Relative error of one HyperLogLog estimate with 2**12 registers is near 0.02; five of those decide alone.
MARGIN = 0.1
#: A table of lines is broadcast up to this many rows (three numbers each, some 25 MB), else joined by a shuffle.
BROADCAST_ROWS = 250_000


def _lines(docs: DataFrame, text: str, doc_id: str, site: str) -> DataFrame:
    """One row per line that is not blank: the row's key, position, line hash, site and id."""
    # xxhash64 over (seed column, value) gives two independent halves of a 128-bit key
    rows = docs.where(F.col(text).isNotNull()).select(*row_key(text), F.col(doc_id).alias("__id"), F.coalesce(F.concat(F.lit("s"), F.col(site).cast("string")), F.lit("")).alias("__site"), F.posexplode(F.split(F.col(text), "\n")).alias("__at", "__line"))
    line = F.trim(F.col("__line"), F.lit(" \t\r"))
    rows = rows.withColumn("__line", line).where(F.col("__line") != "")
    return rows.select("__t1", "__t2", "__id", "__site", "__at", F.xxhash64("__line").alias("__h1"), F.xxhash64(F.lit(1), "__line").alias("__h2"))


def row_key(text: str) -> list[Column]:
    return [F.xxhash64(text).alias("__t1"), F.xxhash64(F.lit(1), text).alias("__t2")]


def boilerplate_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """Line hashes (``__h1``, ``__h2``) on ``min_sites`` or more sites, and the smallest id that shows each."""
    lines = _lines(docs, text, doc_id, site)
    spread = lines.groupBy("__h1", "__h2").agg(F.hll_sketch_agg("__site", F.lit(LG_CONFIG)).alias("sketch"), F.count("*").alias("rows"), F.min("__id").alias("__first"))
    low, high = min_sites - 1 - MARGIN * min_sites, min_sites + MARGIN * min_sites
    # a line has no more sites than rows, which settles most lines without the sketch
    estimate = spread.where(F.col("rows") >= min_sites).withColumn("sites", F.hll_sketch_estimate("sketch")).where(F.col("sites") >= low)
    estimate = cut_lineage(estimate.select("__h1", "__h2", "__first", "sites"))
    sure = estimate.where(F.col("sites") > high).select("__h1", "__h2", "__first")
    near = estimate.where(F.col("sites") <= high).select("__h1", "__h2", "__first")
    exact = lines.select("__h1", "__h2", "__site").join(_bounded(near), ["__h1", "__h2"]).groupBy("__h1", "__h2", "__site").agg(F.first("__first").alias("__first"))
    counted = exact.groupBy("__h1", "__h2").agg(F.count("*").alias("n"), F.first("__first").alias("__first")).where(F.col("n") >= min_sites)
    return sure.unionByName(counted.select("__h1", "__h2", "__first"))


def _bounded(table: DataFrame) -> DataFrame:
    """A written ``table``, to be broadcast if it has no more than ``BROADCAST_ROWS`` rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def remove_boilerplate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", site: str = "source", min_sites: int = MIN_SITES, keep_first: bool = True) -> DataFrame:
    """``docs`` with boilerplate lines cut out of ``text``, and ``lines_total`` and ``lines_removed``."""
    lines = _lines(docs, text, doc_id, site)
    spread = cut_lineage(boilerplate_lines(docs, text, doc_id, site, min_sites))
    found = lines.join(_bounded(spread), ["__h1", "__h2"])
    if keep_first:
        found = found.where(~F.col("__id").eqNullSafe(F.col("__first")))
    # rows that repeat an id and a text share one set of positions
    cut = found.groupBy("__t1", "__t2", "__id").agg(F.collect_set("__at").alias("__cut"))
    own = without(docs, "lines_total", "lines_removed")
    # the row travels as one struct, so that none of its columns can meet a name used here
    rows = own.select(F.struct("*").alias("row"), *row_key(text), F.col(doc_id).alias("__id"))
    same = F.col("r.__t1").eqNullSafe(F.col("c.__t1")) & F.col("r.__t2").eqNullSafe(F.col("c.__t2")) & F.col("r.__id").eqNullSafe(F.col("c.__id"))
    joined = rows.alias("r").join(cut.alias("c"), same, "left").select("r.row", F.col(f"r.row.`{text}`").alias("text"), F.col("c.__cut").alias("cut"))
    # the split lines are a column of their own, so that the lambda below looks them up and does not split again
    split = joined.withColumn("parts", F.split("text", "\n"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("cut")), lambda i: F.element_at("parts", i + 1))
    left = F.when(F.col("cut").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return split.select(
        *[left.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in own.columns],
        F.when(F.col("text").isNull(), 0).otherwise(F.size("parts")).alias("lines_total"),
        F.coalesce(F.size("cut"), F.lit(0)).alias("lines_removed"),
    )
