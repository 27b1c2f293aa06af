"""Greedy batches under a budget, over a whole table in order.

Rows are taken in order; a row that does not fit in the open batch begins the next one. That is a fold, but not one
that needs a single task: a range of rows maps how full the open batch is at its beginning to how full it is at its end,
and how many batches begin in between. Only the first rows of a range, as many as fit in one batch, can tell
entries apart, so that this map is a table of at most ``most`` rows.

1. Rows are cut into ranges of their order, between quantiles of it.
2. Each range makes its map, going from the last row to the first.
3. The maps are applied one after the other. This is the only step in order; it sees ``most`` numbers of a range at most,
   one range at a time.
4. Each range numbers its batches from the entry it now knows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 1600
#: A range's rows, with the columns they carry, are held by one task.
ROWS_A_RANGE = 50_000


def estimated_tokens(c: Column) -> Column:
    """Half the characters, one at least; null counts as empty."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(c, F.lit(""))) / 2)).cast("long")


def _next_starts(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the first row that does not fit in a batch which begins with it; and the sums before each row."""
    before = np.concatenate(([0], np.cumsum(sizes)))
    n = len(sizes)
    start = np.searchsorted(before, before[:n] + most, side="right") - 1
    return np.maximum(start, np.arange(n) + 1), before


def range_map(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``upto, begun, fill``: an entry that leaves room for less than ``upto[j]`` (and no less than for ``upto[j - 1]``) begins ``begun[j]`` batches and leaves the last one ``fill[j]`` full.

    The last line is for entries with room for the whole range; its ``fill`` is the range's sum, to be added to the entry.
    """
    starts, before = _next_starts(sizes, most)
    n, after, sums = len(sizes), starts.tolist(), before.tolist()
    begun, fill = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        at = after[i]
        begun[i], fill[i] = (begun[at] + 1, fill[at]) if at < n else (1, sums[n] - sums[i])
    first = min(int(np.searchsorted(before[1:], most, side="right")) + 1, n)  # rows that may be the first not to fit
    return np.append(before[1 : first + 1], np.iinfo(np.int64).max), np.append(begun[:first], 0), np.append(fill[:first], before[n])


def _make_maps(most: int):
    def make(group: pa.Table) -> pa.Table:
        sizes = group.column("__n").to_numpy()[np.lexsort((group.column("__tie").to_numpy(), group.column("__at").to_numpy()))]
        upto, begun, fill = range_map(sizes, most)
        return pa.table({"__range": pa.array([group.column("__range")[0].as_py()], pa.int32()), "upto": pa.array([upto.tolist()]), "begun": pa.array([begun.tolist()]), "fill": pa.array([fill.tolist()])})

    return make


def _chain_maps(most: int):
    """Maps in order of their range -> ``__range, __fill, __batch``: how full the open batch is when the range begins, and its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fill, batch = 0, 0
        for rows in batches:
            out = []
            for r in rows.to_pylist():
                out.append((r["__range"], fill, batch))
                if not fill:  # the table's first row, which begins batch 0
                    batch, fill = batch + r["begun"][0] - 1, r["fill"][0]
                    continue
                line = int(np.searchsorted(r["upto"], most - fill, side="right"))
                batch += r["begun"][line]
                fill = r["fill"][line] + (fill if line == len(r["upto"]) - 1 else 0)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64()))], ["__range", "__fill", "__batch"])

    return run


def _number(most: int, names: list[str]):
    def number(group: pa.Table) -> pa.Table:
        order = np.lexsort((group.column("__tie").to_numpy(), group.column("__at").to_numpy()))
        sizes = group.column("__n").to_numpy()[order]
        fill, batch = group.column("__fill")[0].as_py(), group.column("__batch")[0].as_py()
        after, before = _next_starts(sizes, most)
        at = int(np.searchsorted(before[1:], most - fill, side="right")) if fill else int(after[0])
        own = np.zeros(len(sizes), np.int64)
        while at < len(sizes):
            own[at] = 1
            at = int(after[at])
        placed = np.empty(len(sizes), np.int64)
        placed[order] = batch + np.cumsum(own)
        return pa.table([group.column(n) for n in names] + [pa.array(placed)], [*names, "batch"])

    return number


def budget_batches(rows: DataFrame, order: str, size: Column, most: int = MOST, tie: str | None = None, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """``rows`` with ``batch`` (from 0): consecutive rows in ``order`` (a whole number, then ``tie``) of together at most ``most``; a larger row is a batch of its own.

    A null ``order`` comes first. Rows of one order value stay in one range, so the order should be nearly unique.
    ``size`` of less than 1 counts as 1. An empty table gives an empty one.
    """
    names = [c for c in rows.columns if c.lower() != "batch"]
    sized = rows.select(*names, F.coalesce(F.col(order).cast("long"), F.lit(-(2**63))).alias("__at"), F.coalesce(F.col(tie).cast("long") if tie else None, F.lit(0)).alias("__tie") if tie else F.lit(0).cast("long").alias("__tie"), F.greatest(size.cast("long"), F.lit(1).cast("long")).alias("__n"))
    parts = max(1, -(-sized.count() // rows_a_range))
    bounds = sized.agg(F.percentile_approx("__at", [k / parts for k in range(1, parts)], 10_000)).first()[0] if parts > 1 else []
    bounds = sorted(set(bounds))
    place = sum((F.when(F.col("__at") > b, 1).otherwise(0) for b in bounds), F.lit(0)) if len(bounds) < 64 else F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("__at")))
    placed = sized.withColumn("__range", place.cast("int"))
    maps = placed.select("__range", "__at", "__tie", "__n").groupBy("__range").applyInArrow(_make_maps(most), "__range int, upto array<long>, begun array<long>, fill array<long>")
    entries = maps.repartition(1).sortWithinPartitions("__range").mapInArrow(_chain_maps(most), "__range int, __fill long, __batch long")
    joined = placed.join(F.broadcast(entries), "__range")  # one small row for each range
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in names)
    return joined.groupBy("__range").applyInArrow(_number(most, names), f"{schema}, batch long")
