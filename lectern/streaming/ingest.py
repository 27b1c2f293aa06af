"""Incremental ingest and event analytics as Structured Streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators import registry as reg
from lectern.sources import sinks

EVENTS = "event string, status string, delta int, note string, run_id string, ts timestamp"


def ingest(spark: SparkSession, inbox: str, root: str, checkpoint: str, schema: str = "name string, source string, text string") -> StreamingQuery:
    """Take in what is new below ``inbox`` (JSON lines) and stop; running it again changes nothing.

    Each batch adds the documents whose content is not known yet as a folder of its own, without rewriting what is
    there; the checkpoint makes each file count once, the content hash each document.
    """
    stream = spark.readStream.schema(schema).json(inbox)

    def merge(batch: DataFrame, batch_id: int) -> None:
        # of files with one content the first by name counts, whatever order they are read in
        first = F.min_by(F.struct("*"), F.struct(*batch.columns)).alias("d")
        docs = reg.identify(batch, "text", "source").groupBy(F.col("document_id").alias("__id")).agg(first).select("d.*")
        # a batch that runs again after a failure writes its own folder again
        if sinks._exists(spark, root, ""):
            known = documents(spark, root).where(F.col("batch") != batch_id).select("document_id")
            docs = docs.join(known, "document_id", "left_anti")
        docs.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def documents(spark: SparkSession, root: str) -> DataFrame:
    """What has been taken in, with the ``batch`` that brought it; only columns that are used are read."""
    return spark.read.option("basePath", root).parquet(f"{root}/batch=*")


def activity(events: DataFrame, gap: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Active seconds per session of events (a gap over ``gap`` ends it), on a stream or a table.

    A session window ends ``gap`` after its last event, so the active time is last minus first.
    """
    sessions = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap)).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"), F.count(F.when((F.col("status") == "DONE") & F.col("event").startswith("parse_completed"), 1)).alias("finished"))
    return sessions.select("first", "last", "n", "finished", ((F.unix_micros("last") - F.unix_micros("first")) / 1e6).alias("active_s"))


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).json(path)
