"""Copies of source files as a data source to write to: originals are only read, and a failed job leaves nothing behind.

Each attempt of a task writes into a folder of its own below a staging folder beside the copies. Only when all tasks are
done does the driver move the files of the attempts that counted, and then delete the staging folder with what failed
attempts left there. Places are what pyarrow's file systems know: paths that all machines share, or URIs.
"""

from __future__ import annotations

import posixpath
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "name string, content binary"
STAGING = "_staging-"


def place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of ``path``."""
    scheme, _, rest = path.partition(":/")
    if scheme == path or scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/") if rest else path
    return fs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    """The folder of an attempt; empty if it had no rows."""

    folder: str | None


class CopyWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.staging = path.rstrip("/"), f"{path.rstrip('/')}/{STAGING}{uuid.uuid4().hex}"
        system, staging = place(self.staging)
        system.create_dir(staging, recursive=True)

    def write(self, rows: Iterator[Row]) -> Written:
        folder = None
        for row in rows:
            system, staging = place(self.staging)
            if folder is None:
                folder = f"{staging}/{uuid.uuid4().hex}"
                system.create_dir(folder, recursive=False)  # fails once the job was given up
            with system.open_output_stream(f"{folder}/{posixpath.basename(row.name)}") as out:
                out.write(row.content or b"")
        return Written(folder)

    def commit(self, messages: list[Written | None]) -> None:
        system, target = place(self.path)
        for folder in [m.folder for m in messages if m is not None and m.folder]:
            for found in system.get_file_info(fs.FileSelector(folder)):
                system.move(found.path, f"{target}/{found.base_name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, staging = place(self.staging)
        for wait in (0.1, 0.5, 2.0, None):  # tasks of a failed job may write until they are stopped
            try:
                if system.get_file_info(staging).type == fs.FileType.Directory:
                    system.delete_dir(staging)
                return
            except OSError:
                if wait is None:
                    raise
                time.sleep(wait)


class FileCopies(DataSource):
    """``df.write.format("file_copies").mode("append").save(path)`` for rows of (name, content)."""

    @classmethod
    def name(cls) -> str:
        return "file_copies"

    def writer(self, schema: StructType, overwrite: bool) -> CopyWriter:
        if overwrite:
            raise ValueError("copies are added to a folder; nothing in it is deleted")
        if schema.fieldNames() != ["name", "content"]:
            raise ValueError(f"rows of {SCHEMA} are copied, not of {schema.simpleString()}")
        return CopyWriter(self.options["path"])


def _parent(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"/[^/]*$", ""), "^file:/+", "/")


def copy_files(files: DataFrame, target: str) -> DataFrame:
    """Copy ``files`` (path, content) into the folder ``target`` and return ``name, size, sha256, same`` of the copies as read again.

    A file that already lies in ``target`` stays as it is; another of its name there is replaced. Two files of one name are
    an error before anything is written, as are null contents. Times of the originals are not carried over. Spark's listing
    leaves out files without any byte, so those are not among ``files`` nor copied.
    """
    spark: SparkSession = files.sparkSession
    spark.dataSource.register(FileCopies)
    name = F.element_at(F.split("path", "/"), -1)
    home = target.rstrip("/")
    home = "/" + home.partition(":/")[2].lstrip("/") if home.startswith("file:/") else home
    rows = files.where(_parent(F.col("path")) != home).select(name.alias("name"), "content")
    odd = rows.groupBy("name").agg(F.count("*").alias("n"), F.count("content").alias("known")).where("n > 1 OR known < n").agg(F.min("name").alias("name")).first().name
    if odd is not None:
        raise ValueError(f"more than one file named {odd}, or one without content")
    rows.write.format("file_copies").mode("append").save(target)
    told = rows.select("name", F.sha2("content", 256).alias("__sha"))
    there = spark.read.format("binaryFile").load(target).select(name.alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    return told.join(there, "name", "left").select("name", "size", "sha256", F.coalesce(F.col("sha256") == F.col("__sha"), F.lit(False)).alias("same"))
