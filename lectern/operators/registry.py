"""Document identity over time: ingest decisions, versions, upserts and purges.

A registry is a table, one row per document: ``document_id, file_hash, source_file,
ingest_status, retry_count, max_retries, last_content_hash, supersedes,
superseded_by, ord``. Changing it makes a new table; write that to a new place and
switch, never over the one being read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import content_hash, document_id
from lectern.operators.lineage import cut

REGISTRY = (
    "document_id string, file_hash string, source_file string, ingest_status string, retry_count int, max_retries int, last_content_hash string, "
    "supersedes string, superseded_by string, ord long"
)
STATES = ("PROCESSED", "FAILED", "ABANDONED")


def identify(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with ``document_id`` and ``file_hash`` of the content."""
    return docs.withColumns({"document_id": document_id(F.col(text), F.col(source)), "file_hash": content_hash(F.col(text))})


def migrate(registry: DataFrame) -> DataFrame:
    """An older registry in today's columns, with defaults for what it lacks."""
    empty = registry.sparkSession.createDataFrame([], REGISTRY)
    full = empty.unionByName(registry, allowMissingColumns=True)
    return full.withColumns({"ingest_status": F.coalesce("ingest_status", F.lit("PROCESSED")), "retry_count": F.coalesce("retry_count", F.lit(0)), "max_retries": F.coalesce("max_retries", F.lit(3)), "last_content_hash": F.coalesce("last_content_hash", "file_hash")})


def decision(known: Column, status: Column, retries: Column, most: Column, last: Column, current: Column) -> Column:
    return (
        F.when(~known, "PROCESS")
        .when(status == "ABANDONED", "SKIP")
        .when((status == "FAILED") & (retries < most), "RETRY")
        .when(status == "FAILED", "REPROCESS")
        .when(last.isNull(), "PROCESS")
        .when(last == current, "SKIP")
        .otherwise("REPROCESS")
    )


def classify(incoming: DataFrame, registry: DataFrame) -> DataFrame:
    """``incoming`` (with ``document_id, file_hash``) plus ``matched`` and ``decision``.

    A row is known by its id, else by its hash (the earliest record that has it): two
    equi-joins and a coalesce, never a join on either condition.
    """
    fields = ["document_id", "ingest_status", "retry_count", "max_retries", "last_content_hash"]
    record = F.struct(*fields)
    by_id = registry.groupBy("document_id").agg(F.min_by(record, "ord").alias("__a"))
    by_hash = registry.where(F.col("file_hash").isNotNull()).groupBy("file_hash").agg(F.min_by(record, "ord").alias("__b"))
    found = incoming.join(by_id, "document_id", "left").join(by_hash, "file_hash", "left").withColumn("__r", F.coalesce("__a", "__b"))
    r = F.col("__r")
    made = decision(r.isNotNull(), F.coalesce(r["ingest_status"], F.lit("PROCESSED")), F.coalesce(r["retry_count"], F.lit(0)), F.coalesce(r["max_retries"], F.lit(3)), r["last_content_hash"], F.col("file_hash"))
    return found.withColumns({"matched": r["document_id"], "decision": made}).drop("__a", "__b", "__r")


def register(registry: DataFrame, incoming: DataFrame) -> DataFrame:
    """``registry`` with the incoming documents it knows neither by id nor by hash; of several alike the first."""
    first = Window.partitionBy("document_id").orderBy("ord")
    new = incoming.join(registry.select("document_id"), "document_id", "left_anti").join(registry.select("file_hash"), "file_hash", "left_anti")
    once = new.withColumn("__n", F.row_number().over(first)).where(F.col("__n") == 1).drop("__n")
    return registry.unionByName(once, allowMissingColumns=True)


def upsert(table: DataFrame, changed: DataFrame, key: str = "document_id") -> DataFrame:
    """All rows of the keys in ``changed`` replaced by its rows."""
    return table.join(changed.select(key).distinct(), key, "left_anti").unionByName(changed)


def purge(table: DataFrame, registry: DataFrame) -> DataFrame:
    """``table`` without the documents that have been superseded."""
    return table.join(registry.where(F.col("superseded_by").isNotNull()).select("document_id"), "document_id", "left_anti")


def supersede(registry: DataFrame, source: str = "source_file", parts: int = 256) -> DataFrame:
    """Versions of one source linked in order: each row's ``supersedes`` and ``superseded_by``.

    Rows are linked within ``parts`` ranges of ``ord``; the ends of the ranges, ``parts`` rows for a source at most, are
    linked across. So a source with a third of all rows is spread over many tasks.
    """
    low, high = registry.agg(F.min("ord"), F.max("ord")).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // parts))
    rows = registry.drop("supersedes", "superseded_by").withColumn("__part", F.floor((F.coalesce("ord", F.lit(low or 0)) - (low or 0)) / width))
    line = Window.partitionBy(source, "__part").orderBy("ord", "document_id")
    order = F.struct(F.col("ord").isNotNull(), "ord", "document_id")
    ends = rows.groupBy(source, "__part").agg(F.min_by("document_id", order).alias("first"), F.max_by("document_id", order).alias("last"))
    across = Window.partitionBy(source).orderBy("__part")
    ends = ends.select(F.col(source).alias("__source"), F.col("__part").alias("__p"), F.lag("last").over(across).alias("__before"), F.lead("first").over(across).alias("__after"))
    linked = rows.withColumns({"__lag": F.lag("document_id").over(line), "__lead": F.lead("document_id").over(line)})
    joined = linked.join(ends, F.col(source).eqNullSafe(F.col("__source")) & (F.col("__part") == F.col("__p")))
    return joined.withColumns({"supersedes": F.coalesce("__lag", "__before"), "superseded_by": F.coalesce("__lead", "__after")}).drop("__part", "__p", "__source", "__before", "__after", "__lag", "__lead")


def chain(registry: DataFrame, start: str, most: int = 10_000) -> DataFrame:
    """``document_id, position`` of the whole version chain of ``start``, oldest first; cycles end where they began.

    The two walks follow one row a step, so this is for one document; ``supersede`` orders all chains at once.
    """
    spark = registry.sparkSession
    walk = lambda column: spark.sql(
        f"WITH RECURSIVE walk(id, step, seen) MAX RECURSION LEVEL {most} AS (SELECT :start, 0, array(:start) UNION ALL "
        f"SELECT r.{column}, w.step + 1, array_append(w.seen, r.{column}) FROM walk w JOIN {{reg}} r ON r.document_id = w.id WHERE r.{column} IS NOT NULL AND NOT array_contains(w.seen, r.{column})) SELECT id, step FROM walk",
        args={"start": start}, reg=registry,
    )
    older = walk("supersedes").select("id", (-F.col("step")).alias("step"))
    every = older.unionByName(walk("superseded_by")).groupBy("id").agg(F.min_by("step", F.abs("step")).alias("step"))
    return every.join(registry.select(F.col("document_id").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("document_id"), (F.row_number().over(Window.orderBy("step")) - 1).alias("position"))


def version_positions(registry: DataFrame) -> DataFrame:
    """``document_id, chain, position`` of every version: the oldest version of its chain, and how many are older.

    Pointers to older versions double their reach in each round, so the joins are logarithmic in the longest chain. A version that replaces one
    the registry does not know is the oldest. Versions on a circle, or that replace one on it, have the position -1 and the
    smallest id they lead to as their chain. Of rows that repeat an id the smallest pointer counts; null ids have no row.
    """
    once = registry.where(F.col("document_id").isNotNull()).groupBy("document_id").agg(F.min("supersedes").alias("older"))
    known = once.select(F.col("document_id").alias("older"), F.lit(True).alias("known"))
    state = cut(once.join(known, "older", "left").select("document_id", F.when(F.col("known"), F.col("older")).otherwise(F.col("document_id")).alias("at"), F.when(F.col("known"), 1).otherwise(0).cast("long").alias("position"), F.col("known").isNull().alias("done"), F.when(F.col("known"), F.col("older")).otherwise(F.col("document_id")).alias("least")))
    for _ in range(state.count().bit_length()):
        if not state.where(~F.col("done")).limit(1).count():
            break
        ahead = state.select(F.col("document_id").alias("at"), F.col("at").alias("next"), F.col("position").alias("more"), F.col("done").alias("arrived"), F.col("least").alias("least_ahead"))
        going = state.where(~F.col("done")).join(ahead, "at").select("document_id", F.col("next").alias("at"), (F.col("position") + F.col("more")).alias("position"), F.col("arrived").alias("done"), F.least("least", "least_ahead").alias("least"))
        state = cut(state.where("done").unionByName(going))
    return state.select("document_id", F.when(F.col("done"), F.col("at")).otherwise(F.col("least")).alias("chain"), F.when(F.col("done"), F.col("position")).otherwise(-1).alias("position"))


def digests(chunks: DataFrame, text: str = "content") -> DataFrame:
    """``document_id, chunks, digest``: what a document's chunks are, in whatever order they come; a sum of their own digests, so that no document is gathered."""
    part = F.conv(F.substring(F.sha2(F.concat_ws("\0", F.col("chunk_index").cast("string"), F.coalesce(F.col(text), F.lit(""))).cast("binary"), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return chunks.groupBy("document_id").agg(F.count("*").alias("chunks"), F.sum(part).cast("string").alias("digest"))


#: States in which a document's chunks ought to be in the index.
TO_INDEX = ("PROCESSED", "TSU_READY", "INDEXED")


def reconcile(registry: DataFrame, wanted: DataFrame, indexed: DataFrame) -> DataFrame:
    """``document_id, action, before, after``: what makes the index agree with registry and chunks.

    ``registry``: document_id, pipeline_state, superseded_by; ``wanted`` and ``indexed``: document_id, digest (see ``digests``). Actions:
    ``insert``, ``replace``, ``delete`` (superseded, no longer registered, or without chunks; a tombstone with a null ``after``) and ``mark`` (the index is
    right, the state is not INDEXED yet). Documents in other states stay as they are. What agrees has no row, so a second run gives none.
    """
    state = registry.where(F.col("document_id").isNotNull()).groupBy("document_id").agg(F.max(F.struct(F.col("superseded_by").isNotNull().alias("gone"), F.col("pipeline_state").alias("state"))).alias("r"))
    every = state.join(indexed.select("document_id", F.col("digest").alias("before")), "document_id", "full").join(wanted.select("document_id", F.col("digest").alias("after")), "document_id", "left")
    gone = F.col("r").isNull() | F.col("r.gone")
    due = F.coalesce(F.col("r.state").isin(*TO_INDEX), F.lit(False))
    action = (
        F.when(gone, F.when(F.col("before").isNotNull(), "delete"))
        .when(~due, None)
        .when(F.col("after").isNull(), F.when(F.col("before").isNotNull(), "delete"))
        .when(F.col("before").isNull(), "insert")
        .when(F.col("before") != F.col("after"), "replace")
        .when(F.col("r.state") != "INDEXED", "mark")
    )
    return every.withColumn("action", action).where(F.col("action").isNotNull()).select("document_id", "action", "before", F.when(F.col("action") != "delete", F.col("after")).alias("after"))


def apply_actions(actions: DataFrame, registry: DataFrame, chunks: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index, registry) after ``actions``: rows of changed documents replaced by their chunks, states set to INDEXED.

    ``index`` has the columns of ``chunks``. Applying a log that has been applied before, whole or in part, gives the same.
    """
    changed = actions.where(F.col("action") != "mark").select("document_id")
    new = chunks.join(actions.where(F.col("action").isin("insert", "replace")).select("document_id"), "document_id", "left_semi")
    done = actions.where(F.col("action") != "delete").select("document_id").distinct().withColumn("__now", F.lit(True))
    marked = registry.join(done, "document_id", "left").withColumn("pipeline_state", F.when(F.col("__now"), "INDEXED").otherwise(F.col("pipeline_state"))).drop("__now")
    return index.join(changed, "document_id", "left_anti").unionByName(new.select(*index.columns)), marked


def pending(registry: DataFrame, states: DataFrame) -> DataFrame:
    """Registered documents that are processed but not yet indexed (``states``: document_id, pipeline_state)."""
    return registry.join(states.where(F.col("pipeline_state") == "PROCESSED"), "document_id", "left_semi")


def backfill(existing: DataFrame, extracted: DataFrame, key: str = "document_id") -> DataFrame:
    """Missing titles and authors filled from ``extracted`` where those are usable, with ``changed``."""
    usable = lambda c, junk: F.when((F.length(F.trim(c)) > 1) & ~F.lower(F.trim(c)).isin(*junk) & ~c.rlike(r"(?i)\.(docx?|pdf|indd|qxd)$"), F.trim(c))
    new = extracted.select(key, usable(F.col("title"), ("untitled", "unknown")).alias("__title"), usable(F.col("author"), ("unknown", "admin", "user", "author")).alias("__author"))
    joined = existing.join(new, key, "left")
    changed = (F.col("title").isNull() & F.col("__title").isNotNull()) | (F.col("author").isNull() & F.col("__author").isNotNull())
    return joined.withColumns({"changed": F.coalesce(changed, F.lit(False)), "title": F.coalesce("title", "__title"), "author": F.coalesce("author", "__author")}).drop("__title", "__author")
