"""Operation: throughput from event logs, pipeline state, library listings, capacity."""

from __future__ import annotations

import math
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import nfc
from lectern.operators.ranges import PARTS, in_ranges

ZONES = ((300_000, "GREEN"), (700_000, "YELLOW"))
#: Memory of one row held by a single process, in KB, with and without the term index.
ROW_KB = {"plain": 4.81, "indexed": 23.9}


def throughput(events: DataFrame, done: Column, by: list[str] | None = None, ts: str = "ts", gap: float = 60.0, parts: int = PARTS) -> DataFrame:
    """Active seconds (gaps between events of at most ``gap``), finished items and items per second.

    ``by`` splits the log; without it the log is one sequence. Either is cut into ranges of rows: each range sums its own
    gaps, and the gap between two ranges comes from their ends, so that one busy hour or user is spread over tasks.
    """
    by = by or []
    at = F.unix_micros(ts) / 1e6
    rows = in_ranges(events.where(F.col(ts).isNotNull()).withColumns({"__at": at, "__done": done}), F.col("__at"), parts)
    short = lambda g: F.when((g > 0) & (g <= gap), g).otherwise(0.0)
    own = rows.withColumn("__gap", F.col("__at") - F.lag("__at").over(Window.partitionBy(*by, "__range").orderBy("__at")))
    sums = own.groupBy(*by, "__range").agg(F.sum(short(F.col("__gap"))).alias("a"), F.count(F.when(F.col("__done"), 1)).alias("d"), F.min("__at").alias("lo"), F.max("__at").alias("hi"))
    # a row for each range of a group
    across = sums.withColumn("b", F.col("lo") - F.lag("hi").over(Window.partitionBy(*by).orderBy("__range") if by else Window.orderBy("__range")))
    out = (across.groupBy(*by) if by else across.groupBy()).agg(F.coalesce(F.sum(F.col("a") + F.coalesce(short(F.col("b")), F.lit(0.0))), F.lit(0.0)).alias("active_s"), F.coalesce(F.sum("d"), F.lit(0)).alias("finished"))
    return out.select(*by, F.round("active_s", 3).alias("active_s"), "finished", F.when((F.col("active_s") > 0) & (F.col("finished") > 0), F.round(F.col("finished") / F.col("active_s"), 6)).alias("per_second"))


def progress(events: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``run_id, event, status, done, ts``: where each step of each run stands, by its latest event, merged into what was ``known``.

    ``events``: run_id, event, status, delta, ts. ``done`` sums the deltas of all events and what was known before; of events at one
    time the greatest (status, delta) counts. Applied once for each batch of events, as an upsert.
    """
    now = events.groupBy("run_id", "event").agg(F.max_by("status", F.struct("ts", "status", "delta")).alias("status"), F.coalesce(F.sum("delta"), F.lit(0)).alias("done"), F.max("ts").alias("ts"))
    if known is None:
        return now
    both = now.unionByName(known.select("run_id", "event", "status", "done", "ts"))
    return both.groupBy("run_id", "event").agg(F.max_by("status", F.struct("ts", "status")).alias("status"), F.sum("done").alias("done"), F.max("ts").alias("ts"))


def event_counts(events: DataFrame, name: str = "event", status: str = "status", prefix: str = "") -> DataFrame:
    """Events and finished ones by name, of those whose name begins with ``prefix``."""
    return events.where(F.col(name).startswith(prefix)).groupBy(name).agg(F.count("*").alias("n"), F.count(F.when(F.col(status) == "DONE", 1)).alias("done"))


STAGES = ("extract", "clean", "chunk", "index", "query")


def pipeline_status(done: dict[str, int], total: int) -> list[dict]:
    """State of the five stages from counts of documents that have passed each."""
    out = []
    for stage in STAGES:
        n = done.get(stage, 0)
        status = "IDLE" if not total or not n else "DONE" if n >= total else "RUNNING"
        out.append({"stage": stage, "status": status, "progress": min(100, math.floor(100 * n / total)) if total else 0, "detail": f"{n}/{total}"})
    return out


def capacity(rows: int) -> dict:
    """The zone a single process would be in with so many rows, and its memory in MB."""
    zone = next((name for most, name in ZONES if rows <= most), "RED")
    return {"rows": rows, "zone": zone, "plain_mb": round(rows * ROW_KB["plain"] / 1024, 1), "indexed_mb": round(rows * ROW_KB["indexed"] / 1024, 1)}


def stage_states(counts: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep, stage, status, progress`` of the five stages, from a row of counts for each batch.

    ``counts``: total (files), processed (files), parsed and chunked (events), covered (documents that passages come from),
    passages, indexed (boolean). Null counts are 0. What a stage has left behind counts before what the events say; a stage is
    ``active`` once the one before it has begun.
    """
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("total", "processed", "parsed", "chunked", "covered", "passages")}
    percent = lambda x: F.least(F.lit(100), F.floor(100 * x / F.greatest(n["total"], F.lit(1)))).cast("int")
    named = lambda status, progress: F.struct(status.alias("status"), progress.cast("int").alias("progress"))
    said = lambda status, progress=0: named(F.lit(status), F.lit(progress))
    follows = lambda before: F.when(before["status"] == "pending", said("pending")).otherwise(said("active"))
    extract = (
        F.when((n["total"] > 0) & (n["processed"] >= n["total"]), said("complete", 100))
        .when(n["parsed"] > 0, named(F.lit("active"), percent(n["parsed"])))
        .when(n["processed"] > 0, named(F.lit("active"), percent(n["processed"])))
        .otherwise(said("pending"))
    )
    whole = extract["status"] == "complete"
    chunk = (
        F.when((n["passages"] > 0) & (n["covered"] > 0), named(F.when(percent(n["covered"]) >= 100, "complete").otherwise("active"), percent(n["covered"])))
        .when(whole, named(F.when(n["chunked"] < n["total"], "active").otherwise("complete"), percent(n["chunked"])))
        .when(n["chunked"] > 0, named(F.lit("active"), percent(n["chunked"])))
        .otherwise(follows(extract))
    )
    embed = F.when(n["passages"] > 0, said("complete", 100)).when(chunk["status"] == "complete", said("active", 30)).otherwise(follows(chunk))
    index = F.when(F.coalesce(F.col("indexed"), F.lit(False)), said("complete", 100)).when(embed["status"] == "complete", said("active", 50)).otherwise(follows(embed))
    stages = {"extract": extract, "chunk": chunk, "embedding": embed, "indexing": index, "search": said("complete", 100)}
    rows = F.array(*[F.struct(F.lit(k).alias("stage"), x["status"].alias("status"), x["progress"].alias("progress")) for k, x in stages.items()])
    return counts.select(*(keep or []), F.inline(rows))


def capacities(df: DataFrame, rows: str) -> DataFrame:
    """``df`` with the ``zone`` a single process would be in with its ``rows``, and its memory in MB (see ``capacity``); null rows are 0."""
    n = F.coalesce(F.col(rows), F.lit(0))
    zone = F.lit("RED")
    for most, name in reversed(ZONES):
        zone = F.when(n <= most, name).otherwise(zone)
    return df.withColumns({"zone": zone, **{f"{k}_mb": F.round(n * kb / 1024, 1) for k, kb in ROW_KB.items()}})


def library_search(docs: DataFrame, needle: str, columns: list[str], kind: tuple[str, str] | None = None) -> DataFrame:
    """Documents with ``needle`` in any of the columns (without regard to case or composition), of one type if given."""
    hit, needle = F.lit(not needle), unicodedata.normalize("NFC", needle).lower()
    for c in columns:
        hit = hit | F.lower(nfc(F.coalesce(F.col(c).cast("string"), F.lit("")))).contains(needle)
    found = docs.where(hit)
    return found.where(F.col(kind[0]) == kind[1]) if kind else found


def page(docs: DataFrame, number: int, size: int = 20, *order: Column) -> DataFrame:
    """One page of a listing; a number beyond the last page gives the last."""
    last = max(1, -(-docs.count() // size))
    return docs.orderBy(*order).offset((min(max(number, 1), last) - 1) * size).limit(size)


def latest(log: DataFrame, n: int, *order: Column) -> DataFrame:
    """The last ``n`` rows of a log, newest first."""
    return log.orderBy(*order).limit(n)
