"""The way of each document from NEW to INDEXED or FAILED, as a stateful stream.

What can be worked out row by row is worked out before the state: identity, chunks, their number. The state of a file is a
handful of values, kept by key in Spark's state store: which content it last had, where that content got to, how often it failed.
Failures set a timer with a wait that doubles; when it expires the step is tried again with what the state holds. A restart goes on from
the checkpoint with states and timers; a file that comes again with the same content changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lectern.functions import chunk
from lectern.functions.text import strip
from lectern.operators import registry

STATE = "document_id string, file_hash string, chunks int, state string, tries int, reason string"
STEPS = "source_file string, document_id string, file_hash string, chunks int, state string, reached string, tries int, reason string, replaces string"
MOST_TRIES, DELAY_MS = 3, 2_000
#: The provider that holds states with timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Takes (document_id, file_hash, chunks, tries before) and returns why the document cannot be indexed just now, or None.
Attempt = Callable[[str, str, int, int], str | None]


def always(document_id: str, file_hash: str, chunks: int, tries: int) -> str | None:
    return None


class Lifecycle(StatefulProcessor):
    """One file's documents: a new content goes through the steps, a known one is passed over, a failed one waits for its timer."""

    def __init__(self, attempt: Attempt, most_tries: int, delay_ms: int) -> None:
        self.attempt, self.most_tries, self.delay_ms = attempt, most_tries, delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("document", STATE)

    def _step(self, key, document_id: str, file_hash: str, chunks: int, tries: int, replaces: str | None, now: int) -> tuple:
        if chunks == 0:  # no wait will change an empty text
            state, reached, reason, tries = "FAILED", "IDENTIFIED", "no text", self.most_tries
        else:
            reason = self.attempt(document_id, file_hash, chunks, tries)
            state, reached, tries = ("INDEXED", "INDEXED", 0) if reason is None else ("FAILED", "PROCESSED", tries + 1)
        self.held.update((document_id, file_hash, chunks, state, tries, reason))
        if state == "FAILED" and tries < self.most_tries:
            self.handle.registerTimer(now + self.delay_ms * 2 ** (tries - 1))
        return (key[0], document_id, file_hash, chunks, state, reached, tries, reason, replaces)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        # of several contents of one file in a batch the one with the greatest order (then hash) is last
        came = pd.concat(list(rows)).sort_values(["ord", "file_hash"], kind="stable")
        for r in came.itertuples():
            before = self.held.get()
            if before is not None and before[1] == r.file_hash:
                continue
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            out.append(self._step(key, r.document_id, r.file_hash, int(r.chunks), 0, None if before is None else before[0], timerValues.getCurrentProcessingTimeInMs()))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in STEPS.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before, out = self.held.get(), []
        if before is not None and before[3] == "FAILED" and before[4] < self.most_tries:
            out = [self._step(key, before[0], before[1], before[2], before[4], None, timerValues.getCurrentProcessingTimeInMs())]
        yield pd.DataFrame(out, columns=[c.split()[0] for c in STEPS.split(", ")])

    def close(self) -> None:
        pass


def document_steps(files: DataFrame, attempt: Attempt = always, most_tries: int = MOST_TRIES, delay_ms: int = DELAY_MS) -> DataFrame:
    """A stream of (source_file, text, and ord, a number that grows with newer contents) -> one row for each try: the state it ended in, how far it got, how often it failed and why.

    ``replaces`` is the document the file held before, whose rows in the index are superseded. Null texts count as empty; null file names are one file.
    The session's state store must be ``STORE``.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = registry.identify(files.withColumn("text", text), "text", "source_file")
    pieces = F.when(F.length(strip(F.col("text"))) > 0, F.greatest(F.size(chunk.paragraph_chunks(F.col("text"))), F.lit(1))).otherwise(0)
    light = rows.select(F.coalesce("source_file", F.lit("")).alias("source_file"), "document_id", "file_hash", F.coalesce(F.col("ord"), F.lit(0)).alias("ord"), pieces.cast("int").alias("chunks"))
    return light.groupBy("source_file").transformWithStateInPandas(Lifecycle(attempt, most_tries, delay_ms), outputStructType=STEPS, outputMode="Update", timeMode="ProcessingTime")
