"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a small table that share a file, and the least number of files.
ROWS_A_FILE, LEAST_FILES = 50_000, 8


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it; a session on one machine without one gets a new folder."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="lectern-checkpoint-")


def cut_lineage(df: DataFrame, rows: int | None = None, rows_a_file: int = ROWS_A_FILE) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from there.

    Where a bound on its ``rows`` is known, it takes as many files as it needs, not one for each shuffle partition.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only a
    session without one (a test on one machine) gets a folder of its own.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return (df if rows is None else df.coalesce(max(LEAST_FILES, -(-rows // rows_a_file)))).checkpoint(eager=True)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns an operator is about to add."""
    lowered = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in lowered])


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows, so that what is made of a part, not of a batch, is held as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: Rows of texts that Spark hands to a task's Python at once: a batch, its copies in both processes and what is kept of them all count.
ROWS_A_BATCH = 1_000


def small_batches(spark: SparkSession) -> None:
    """From now on this session hands rows to Python by at most ``ROWS_A_BATCH``; a smaller number of its own stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ROWS_A_BATCH:
        spark.conf.set(name, str(ROWS_A_BATCH))


def map_text(df: DataFrame, text: str, added: str, start: Callable, keep_text: bool = True, at_once: int | None = None) -> DataFrame:
    """``df`` with the columns ``added`` (a DDL string), worked out from column ``text`` in Arrow batches.

    ``start()`` runs once in each task and returns a function from a list of texts to the
    added columns as Arrow arrays, of at most ``at_once`` texts at a time (by default a
    batch). Columns of ``df`` that have an added column's name go.
    """
    small_batches(df.sparkSession)
    new = StructType.fromDDL(added)
    own = without(df, *new.names)
    kept = [f for f in own.schema.fields if keep_text or f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches if at_once is None else slices(batches, at_once):
            columns = work(batch.column(batch.schema.get_field_index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(f.name)) for f in kept] + columns, [f.name for f in kept] + new.names)

    return own.mapInArrow(run, StructType(kept + new.fields))
