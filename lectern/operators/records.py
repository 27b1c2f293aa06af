"""Records kept about documents and research sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import content_hash, document_id

#: The version of the processing that records name.
PROCESSING_VERSION = "1.1.x"
TYPES = {
    "title": "string", "author": "string", "book": "string", "chapter": "int", "page": "int", "batch_id": "string", "language": "string", "noise_score": "double",
    "noise_mode": "string", "source_type": "string", "is_ocr": "boolean", "chunk_count": "int", "pipeline_state": "string",
}
DEFAULTS = {"language": "en", "noise_score": 0.0, "noise_mode": "-", "is_ocr": False, "chunk_count": 0}


def metadata_records(docs: DataFrame, text: str = "text", source: str = "source_file", at: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The full record of each document: identity, structure and processing, with ``keep`` columns in front.

    A field that ``docs`` has under its name is taken over, null where unknown; the five with a default get it where null. The type of
    the source is the file name's ending (none: empty) unless given. ``at`` is the time of the record, now if not given.
    """
    has = lambda name: F.col(name) if name in docs.columns else F.lit(None)
    ending = F.when(F.col(source).contains("."), F.substring_index(source, ".", -1)).otherwise("")
    fields = []
    for name, kind in TYPES.items():
        value = has(name).cast(kind)
        if name in DEFAULTS:
            value = F.coalesce(value, F.lit(DEFAULTS[name]))
        if name == "source_type":
            value = F.coalesce(F.nullif(value, F.lit("")), ending, F.lit(""))
        fields.append(value.alias(name))
    identity = document_id(F.col(text), F.col(source))
    stamp = F.date_format(at if at is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    return docs.select(*keep, identity.alias("document_id"), F.col(source).alias("source_file"), content_hash(F.col(text)).alias("file_hash"), stamp.alias("created_at"), F.lit(PROCESSING_VERSION).alias("processing_version"), *fields, identity.alias("chunk_id_prefix"))


def incomplete_records(records: DataFrame) -> DataFrame:
    """Records that may not be registered, with the ``lacks`` of each: document_id, file_hash or created_at is null or empty."""
    names = ("document_id", "file_hash", "created_at")
    lacks = F.filter(F.array(*[F.when(F.coalesce(F.col(n), F.lit("")) == "", F.lit(n)) for n in names]), lambda x: x.isNotNull())
    return records.withColumn("lacks", lacks).where(F.size("lacks") > 0)


def session_id(at: Column | None = None) -> Column:
    """A new session's name: the time to the second and eight random digits, so that sessions of one second differ."""
    return F.concat(F.date_format(at if at is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-"), F.substring(F.uuid(), 1, 8))


def session_entries(results: DataFrame, citations: DataFrame, by: list[str], at: Column | None = None) -> DataFrame:
    """An entry for each question of a session (``by``): ``timestamp`` and ``result_refs`` in order of rank, without any content.

    ``results``: by, rank, tsu_id, document_id, as many a question as its ranking was cut to; ``citations``: by, tsu_id, citation_id,
    of several for one passage the greatest. A reference holds what is known of the three ids; one without any is left out.
    """
    named = citations.where("tsu_id IS NOT NULL").groupBy(*by, "tsu_id").agg(F.max("citation_id").alias("citation_id"))
    rows = results.select(*by, "rank", "tsu_id", "document_id").join(named, [*by, "tsu_id"], "left")
    ref = F.struct("rank", "tsu_id", "document_id", "citation_id")
    known = F.coalesce("tsu_id", "document_id", "citation_id").isNotNull()
    grouped = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.when(known, ref))).alias("r"))
    stamp = F.date_format(at if at is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    return grouped.select(*by, stamp.alias("timestamp"), F.transform("r", lambda x: F.struct(x["tsu_id"].alias("tsu_id"), x["document_id"].alias("document_id"), x["citation_id"].alias("citation_id"))).alias("result_refs"))
