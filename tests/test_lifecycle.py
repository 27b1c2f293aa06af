"""Budget batches, reconciliation, versions, table functions and the stateful document pipeline."""

import json
import random
import time

import pytest
from helpers import SF
from pyspark.sql import functions as F

from lectern.functions import chunk, tables
from lectern.operators import batches, corpus, registry
from lectern.operators.structure import first_contained
from lectern.streaming import lifecycle


def plain_batches(sizes, most):
    out, batch, fill = [], 0, 0
    for n in sizes:
        if fill and fill + n > most:
            batch, fill = batch + 1, 0
        out.append(batch)
        fill += n
    return out


@pytest.mark.parametrize("most, rows_a_range, biggest", [(50, 10, 20), (50, 7, 120), (1, 5, 3), (1000, 40, 30), (100, 10_000, 60)])
def test_budget_batches_by_fold(spark, most, rows_a_range, biggest):
    rng = random.Random(most)
    sizes = [rng.randrange(-1, biggest) for _ in range(400)]
    ids = rng.sample(range(-300, 3000), 400)
    rows = [(i, n, "x", "clash") for i, n in zip(ids, sizes)]
    df = spark.createDataFrame(rows, "id long, n long, other string, Batch string").repartition(5)
    got = {r.id: r.batch for r in batches.budget_batches(df, "id", F.col("n"), most, rows_a_range=rows_a_range).collect()}
    ordered = sorted(zip(ids, sizes))
    assert got == dict(zip([i for i, _ in ordered], plain_batches([max(1, n) for _, n in ordered], most)))


def test_budget_batches_odd_rows(spark):
    df = spark.createDataFrame([(None, None), (None, 5), (1, 900), (2, 1), (3, None)], "id long, n long")
    got = sorted((r.id is not None, r.id or 0, r.batch) for r in batches.budget_batches(df, "id", F.col("n"), 10, rows_a_range=2).collect())
    assert got == [(False, 0, 0), (False, 0, 0), (True, 1, 1), (True, 2, 2), (True, 3, 2)]
    assert batches.budget_batches(df.limit(0), "id", F.col("n")).count() == 0


def test_positions_of_versions(spark):
    older = {"a1": None, "a2": "a1", "a3": "a2", "b2": "gone", "b3": "b2", "c1": "c3", "c2": "c1", "c3": "c2", "d": "c2", "s": "s"} | {f"x{k:04d}": f"x{k - 1:04d}" if k else None for k in range(700)}
    df = spark.createDataFrame([*older.items(), (None, "a1"), ("a2", "a1")], "document_id string, supersedes string")
    got = {r.document_id: (r.chain, r.position) for r in registry.version_positions(df).collect()}
    want = {"a1": ("a1", 0), "a2": ("a1", 1), "a3": ("a1", 2), "b2": ("b2", 0), "b3": ("b2", 1), "c1": ("c1", -1), "c2": ("c1", -1), "c3": ("c1", -1), "d": ("c1", -1), "s": ("s", -1)}
    assert got == want | {f"x{k:04d}": ("x0000", k) for k in range(700)}
    assert registry.version_positions(df.limit(0)).count() == 0


def test_reconcile_twice_changes_nothing(spark):
    reg = spark.createDataFrame([("new", "PROCESSED", None), ("same", "INDEXED", None), ("right", "TSU_READY", None), ("edited", "INDEXED", None), ("old", "INDEXED", "new"), ("bare", "PROCESSED", None), ("lost", "INDEXED", None), ("bad", "FAILED", None), (None, "PROCESSED", None)], "document_id string, pipeline_state string, superseded_by string")
    chunk_row = "document_id string, chunk_index int, content string"
    chunks = spark.createDataFrame([("new", 0, "n"), ("new", 1, "m"), ("same", 0, "s"), ("same", 1, None), ("right", 0, "r"), ("edited", 0, "after"), ("old", 0, "o"), ("bad", 0, "b"), ("stray", 0, "x")], chunk_row)
    index = spark.createDataFrame([("same", 1, None), ("same", 0, "s"), ("right", 0, "r"), ("edited", 0, "before"), ("old", 0, "o"), ("lost", 0, "l"), ("bad", 0, "was"), ("ghost", 0, "g")], chunk_row)
    log = registry.reconcile(reg, registry.digests(chunks), registry.digests(index))
    assert {r.document_id: r.action for r in log.collect()} == {"new": "insert", "right": "mark", "edited": "replace", "old": "delete", "lost": "delete", "ghost": "delete"}
    assert {r.document_id for r in log.where("after IS NULL").collect()} == {"old", "lost", "ghost"}
    after, marked = registry.apply_actions(log, reg, chunks, index)
    rows = sorted(map(str, after.collect()))
    assert {r.document_id: r.pipeline_state for r in marked.where("document_id IS NOT NULL").collect()} == {"new": "INDEXED", "same": "INDEXED", "right": "INDEXED", "edited": "INDEXED", "old": "INDEXED", "bare": "PROCESSED", "lost": "INDEXED", "bad": "FAILED"}
    assert registry.reconcile(marked, registry.digests(chunks), registry.digests(after)).count() == 0
    again, _ = registry.apply_actions(log, marked, chunks, after)
    assert sorted(map(str, again.collect())) == rows


def test_repaired_books(spark):
    rows = [("TSU-GEN-1", "Romans notes.txt", None, "GEN", "of Mark"), ("TSU-GEN-2", "a.txt", "on 1 Kings", "GEN", ""), ("TSU-GEN-3", "b.txt", None, "GEN", "Mark and Genesis"), ("TSU-GEN-4", "b.txt", None, "GEN", "Genesis"), ("TSU-UNK-5", "b.txt", None, "UNK", "Mark"), ("TSU-UNK-6", "b.txt", None, "UNK", "Mark"),
            ("TSU-EXO-7", "c.txt", None, "EXO", None), ("TSU-UNK-8", None, None, "UNK", "none here"), ("TSU-UNK-9", "d.txt", None, "UNK", "Luke"), ("TSU-UNK-10", "d.txt", None, "UNK", "Acts")]
    got = {r.tsu_id: (r.new_book, r.decided_by, r.new_id) for r in corpus.repair_books(spark.createDataFrame(rows, "tsu_id string, source_file string, title string, book_id string, content string")).collect()}
    assert got["TSU-GEN-1"] == ("ROM", "rule", "TSU-ROM-1") and got["TSU-GEN-2"][:2] == ("1KI", "rule")
    assert {got[f"TSU-{x}"][:2] for x in ("GEN-3", "GEN-4", "UNK-5")} == {("GEN", "vote")}  # two votes each, and Genesis comes first
    assert got["TSU-EXO-7"][:2] == ("EXO", "record") and got["TSU-UNK-8"][:2] == ("UNK", "none") and got["TSU-UNK-9"][0] == got["TSU-UNK-10"][0] == "LUK"


def test_table_functions(spark):
    tables.add_chunker("shouting", lambda text, size, overlap: [w.upper() for w in text.split()[:size]])
    tables.add_headings("org", lambda text: [(line.count("*"), line.strip("* "), 0) for line in text.split("\n") if line.startswith("*")])
    tables.register(spark)
    spark.createDataFrame([(1, "one two three"), (2, None), (3, " "), (4, "# A\ntext\n## B c ##\n* x")], "id long, t string").createOrReplaceTempView("texts")
    rows = lambda sql: [tuple(r) for r in spark.sql(sql).collect()]
    assert rows("SELECT id, chunk_index, chunk FROM texts, LATERAL chunk(t, 'shouting', 2, 0) ORDER BY id, chunk_index")[:2] == [(1, 0, "ONE"), (1, 1, "TWO")]
    assert rows("SELECT id, level, title FROM texts, LATERAL headings_of(t, 'md') ORDER BY id, heading_index") == [(4, 1, "A"), (4, 2, "B c")]
    assert rows("SELECT level, title FROM texts, LATERAL headings_of(t, 'org')") == [(1, "x")] and rows("SELECT title FROM texts, LATERAL headings_of(t, 'pdf')") == []
    with pytest.raises(Exception, match="no strategy"):
        spark.sql("SELECT * FROM texts, LATERAL chunk(t, 'unheard of', 2, 0)").collect()


def test_boundaries_look_ahead(spark):
    """Every paragraph of every document against a plain fold; titles are words of some of the paragraphs."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("text IS NOT NULL").collect()}
    rows, want = [], {}
    for doc_id, text in docs.items():
        parts = text.split("\n")
        titles = [" ".join(p.split()[:2]) for p in parts[::3] if len(p.split()) > 1]
        rows += [(doc_id, "t", k, t) for k, t in enumerate(titles)] + [(doc_id, "p", k, p) for k, p in enumerate(parts)]
        cursor = 0
        for k, p in enumerate(parts):
            step = first_contained(titles[cursor : cursor + 5], p)
            met = None if step is None else titles[cursor + step]
            cursor += 0 if step is None else step + 1
            score = chunk.boundary_score_of(p, step is not None, chunk.LEAST)
            want[doc_id, k] = (met, score, score >= chunk.BOUNDARY_LEAST)
    tables.register(spark)
    spark.createDataFrame(rows, "doc_id long, kind string, at long, text string").repartition(6).createOrReplaceTempView("lines_of")
    got = {(r.doc_id, r["at"]): (r.met, r.score, r.is_boundary) for r in spark.sql("SELECT * FROM boundaries(TABLE(lines_of) PARTITION BY doc_id ORDER BY (kind DESC, at))").collect()}
    assert got == want and sum(m is not None for m, _, _ in want.values()) > 100


def drop(folder, name, rows):
    (folder / f".{name}").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows))
    (folder / f".{name}").rename(folder / name)


def run_steps(spark, inbox, out, checkpoint, attempt, until, seconds=90, **options):
    stream = spark.readStream.schema("source_file string, text string, ord long").json(str(inbox))
    steps = lifecycle.document_steps(stream, attempt, **options)
    query = steps.writeStream.foreachBatch(lambda df, n: df.withColumn("batch_no", F.lit(n)).write.mode("append").parquet(str(out))).option("checkpointLocation", str(checkpoint)).outputMode("update").trigger(processingTime="500 milliseconds").start()
    end = time.time() + seconds
    try:
        while time.time() < end:
            assert query.exception() is None, query.exception()
            if out.exists() and list(out.glob("*.parquet")) and until(rows := [r.asDict() for r in spark.read.parquet(str(out)).collect()]):
                return rows
            time.sleep(0.5)
        raise AssertionError("the stream has not come to an end")
    finally:
        query.stop()


def test_documents_go_from_new_to_indexed(spark, tmp_path):
    """Tries with timers, a restart from the checkpoint, replays, late and newer contents of one file."""
    inbox, out, checkpoint = tmp_path / "inbox", tmp_path / "out", tmp_path / "checkpoint"
    inbox.mkdir()
    text = "A paragraph that is long enough to be kept as one piece of its own, with some more words at its end. " * 3
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", lifecycle.STORE)
    try:
        drop(inbox, "1.json", [{"source_file": "good", "text": text, "ord": 1}, {"source_file": "empty", "text": " ", "ord": 1}, {"source_file": "slow", "text": text + "slow", "ord": 1}, {"source_file": "never", "text": text + "never", "ord": 1}, {"text": text + "nameless"}])
        slow = lambda document_id, file_hash, chunks, tries: None
        from lectern.functions.text import content_hash

        hashes = {n: spark.range(1).select(content_hash(F.lit(text + n))).first()[0] for n in ("slow", "never")}
        fails = {hashes["slow"]: 2, hashes["never"]: 99}
        attempt = lambda document_id, file_hash, chunks, tries, fails=fails: "service is down" if tries < fails.get(file_hash, 0) else None
        states = lambda rows, name: [(r["state"], r["tries"]) for r in sorted(rows, key=lambda r: (r["batch_no"], r["tries"])) if r["source_file"] == name]
        rows = run_steps(spark, inbox, out, checkpoint, attempt, lambda rows: states(rows, "never")[-1:] == [("FAILED", 3)] and states(rows, "slow")[-1:] == [("INDEXED", 0)], delay_ms=700)
        assert states(rows, "good") == [("INDEXED", 0)] and states(rows, "") == [("INDEXED", 0)] and states(rows, "empty") == [("FAILED", 3)]
        assert states(rows, "slow") == [("FAILED", 1), ("FAILED", 2), ("INDEXED", 0)] and states(rows, "never") == [("FAILED", 1), ("FAILED", 2), ("FAILED", 3)]
        assert {r["reason"] for r in rows if r["source_file"] == "never"} == {"service is down"} and {r["reached"] for r in rows if r["source_file"] == "empty"} == {"IDENTIFIED"}
        # after a restart: the same content again, a newer one, and a batch with two contents of one file
        drop(inbox, "2.json", [{"source_file": "good", "text": text, "ord": 2}, {"source_file": "slow", "text": text + "newer", "ord": 3}, {"source_file": "slow", "text": text + "between", "ord": 2}, {"source_file": "last", "text": text, "ord": 1}])
        rows = run_steps(spark, inbox, out, checkpoint, slow, lambda rows: states(rows, "last") == [("INDEXED", 0)], delay_ms=700)
        assert states(rows, "good") == [("INDEXED", 0)] and len(states(rows, "slow")) == 5
        newest = [r for r in rows if r["source_file"] == "slow" and r["replaces"]]
        assert len(newest) == 2 and len({r["document_id"] for r in newest} | {newest[0]["replaces"], newest[1]["replaces"]}) == 3
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
