"""Writers. A table is replaced by writing a new version beside it and naming that one current."""

from __future__ import annotations

import hashlib
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def manifest(df: DataFrame, key: str = "document_id") -> DataFrame:
    """One row: rows, documents and a digest of the rows that does not depend on their order."""
    row = F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in df.columns])
    return df.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("documents"), F.hex(F.bit_xor(row)).alias("digest_xor"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("digest_sum"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("written_at"))


def replace_table(df: DataFrame, root: str) -> str:
    """Write ``df`` as a new version below ``root`` and add it to the version list; readers see whole versions only.

    Versions are ordered by the time they were finished and then by name, so that two writers cannot share a place.
    """
    spark, version = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{root}/v-{version}")
    spark.createDataFrame([(time.time_ns(), f"v-{version}")], "n long, version string").coalesce(1).write.mode("append").parquet(f"{root}/versions")
    return version


def _exists(spark: SparkSession, root: str, below: str = "/versions") -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}{below}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def versions(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("n long, version string").parquet(f"{root}/versions")


def read_table(spark: SparkSession, root: str) -> DataFrame:
    """The latest version of a table."""
    row = versions(spark, root).agg(F.max_by("version", F.struct("n", "version")).alias("v")).first()
    return spark.read.parquet(f"{root}/{row.v}")


def markdown(docs: DataFrame) -> DataFrame:
    """``stem, value``: each document as text with a header of title, language and noise."""
    header = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("title: "), "title"), F.concat(F.lit("language: "), "language"), F.concat(F.lit("noise: "), F.col("noise").cast("string")), F.lit("---"), F.lit(""), "text")
    return docs.select("stem", header.alias("value"))


def write_markdown(docs: DataFrame, path: str) -> None:
    """The documents as a table of texts; not a file each, which no file system bears at scale."""
    markdown(docs).write.mode("overwrite").parquet(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks (stem, chunk_index, chunk) as JSON lines, and beside them one line of meta data for each document."""
    chunks.write.mode("overwrite").json(f"{path}/chunks")
    meta = chunks.groupBy("stem").agg(F.count("*").alias("chunks"), F.sum(F.length("chunk")).alias("characters"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.sha2(F.col("chunk").cast("binary"), 256))), ",").cast("binary"), 256).alias("digest"))
    meta.write.mode("overwrite").json(f"{path}/meta")


def chunk_markdown(chunks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``doc, value``: a document's chunks (bounded by its length) under numbered headings."""
    block = F.concat(F.lit("## Chunk "), (F.col("chunk_index") + 1).cast("string"), F.lit("\n\n"), "chunk")
    return chunks.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("chunk_index", block.alias("b")))).alias("x")).select(doc, F.array_join("x.b", "\n\n").alias("value"))


def mark_processed(names: DataFrame, path: str) -> None:
    """Add names to a list of processed files, each once."""
    spark = names.sparkSession
    new = names.select("name").distinct()
    if _exists(spark, path, ""):
        new = new.join(spark.read.schema("name string").json(path), "name", "left_anti")
    new.write.mode("append").json(path)


def write_report(rows: DataFrame, summary: DataFrame, path: str) -> None:
    """A benchmark's rows as CSV with a header, and its summary (a few rows) as JSON."""
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/rows")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``name, size, sha256`` of every file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def backup_table(df: DataFrame, path: str) -> bool:
    """Copy a table and compare the copy's manifest with its own; True if nothing differs."""
    df.write.mode("overwrite").parquet(path)
    told = lambda x: x.select("rows", "digest_xor", "digest_sum").first()
    key = df.columns[0]
    return told(manifest(df, key)) == told(manifest(df.sparkSession.read.parquet(path), key))


def fingerprint(tables: dict[str, DataFrame], settings: dict[str, str]) -> str:
    """One digest of an evaluation's tables (order of rows apart) and settings."""
    parts = [f"{name}={'-'.join(map(str, manifest(df, df.columns[0]).select('rows', 'digest_xor', 'digest_sum').first()))}" for name, df in sorted(tables.items())]
    parts += [f"{k}={v}" for k, v in sorted(settings.items())]
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def changed(docs: DataFrame, stored: DataFrame, key: str = "name") -> DataFrame:
    """Rows whose content differs from the stored hash, or that are new."""
    hashed = docs.withColumn("hash", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    return hashed.join(stored.select(key, F.col("hash").alias("__h")), key, "left").where(F.col("__h").isNull() | (F.col("__h") != F.col("hash"))).drop("__h")


def fill_cache(texts: DataFrame, cache: DataFrame, embed, text: str = "text") -> DataFrame:
    """``cache`` (hash, text, vector) with the texts it lacks, each different one embedded once by ``embed`` (a column function)."""
    hashed = texts.select(F.substring(F.sha2(F.col(text).cast("binary"), 256), 1, 16).alias("hash"), F.col(text).alias("text")).where(F.col(text).isNotNull())
    missing = hashed.groupBy("hash").agg(F.min("text").alias("text")).join(cache.select("hash"), "hash", "left_anti")
    return cache.unionByName(missing.select("hash", F.substring("text", 1, 500).alias("text"), embed(F.col("text")).alias("vector")))
