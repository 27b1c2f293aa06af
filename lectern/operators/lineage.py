"""Cutting a plan that grows with each round of an iteration, and spreading a small input over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the folder that the cluster names in ``spark.checkpoint.dir``, and read from there.

    A session on one machine that names none works in its own warehouse folder; on a cluster the setting must be there.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or f"{df.sparkSession.conf.get('spark.sql.warehouse.dir')}/lectern-checkpoints")
    return df.checkpoint(eager=True)


#: Inputs up to this estimated size are dealt out to all cores: a shuffle of a bounded size.
SPREAD_BYTES = 256 << 20


#: Estimated bytes of input whose rows, once taken apart, one task groups.
PART_BYTES = 8 << 20
#: Estimates from here on stand for tables of unknown size (lists of the driver, RDDs).
UNKNOWN_BYTES = 1 << 50


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts_of(df: DataFrame) -> int:
    """How many partitions a shuffle of what ``df`` is taken apart into needs: the session's own number for small inputs and those of
    unknown size, more as the input grows, so that a task's share does not."""
    size = estimated_bytes(df)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES) if size < UNKNOWN_BYTES else 1)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out evenly if it is so small that its files may keep few cores busy; a larger one as it is, without a shuffle."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if estimated_bytes(df) <= SPREAD_BYTES else df
