"""Records of documents and sessions, logs of one object, stages."""

import json
import re

from pyspark.sql import functions as F

from lectern.functions.text import nfkc
from lectern.operators import monitor, records, structure
from lectern.sources import readers


def test_metadata_records(spark):
    docs = spark.createDataFrame([(1, "text\r\nx", "a.b.pdf", None, 3), (2, None, "plain", "ko", None)], "i int, text string, source_file string, language string, page int")
    one, two = records.metadata_records(docs, keep=("i",)).orderBy("i").collect()
    assert (one.source_type, one.language, one.page, one.is_ocr, one.noise_mode) == ("pdf", "en", 3, False, "-") and one.document_id == one.file_hash[:32] == one.chunk_id_prefix
    assert (two.source_type, two.language, two.document_id) == ("", "ko", "empty_plain") and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d", two.created_at)
    told = records.metadata_records(docs.withColumn("source_type", F.lit("scan")))
    assert {r.source_type for r in told.collect()} == {"scan"} and records.incomplete_records(told).count() == 0
    lacking = records.incomplete_records(told.withColumn("file_hash", F.lit("")).withColumn("created_at", F.lit(None).cast("string")))
    assert {tuple(r.lacks) for r in lacking.collect()} == {("file_hash", "created_at")}


def test_sessions_and_their_log(spark, tmp_path):
    ids = [r.s for r in spark.range(50).select(records.session_id(F.lit("2024-01-01 10:00:00").cast("timestamp")).alias("s")).collect()]
    assert len(set(ids)) == 50 and all(re.fullmatch(r"2024-01-01T10:00:00-[0-9a-f]{8}", s) for s in ids)
    results = spark.createDataFrame([("q", 2, "t2", None), ("q", 1, "t1", "d1"), ("q", 3, None, None), ("p", 1, None, None)], "query string, rank int, tsu_id string, document_id string")
    cited = spark.createDataFrame([("q", "t1", "[1]"), ("q", "t1", "[0]"), ("q", None, "[9]")], "query string, tsu_id string, citation_id string")
    got = {r["query"]: [tuple(x) for x in r.result_refs] for r in records.session_entries(results, cited, ["query"]).collect()}
    assert got == {"q": [("t1", "d1", "[1]"), ("t2", None, None)], "p": []}
    (tmp_path / "s.json").write_text(json.dumps({"sessions": [{"session_id": "a", "created_at": "t", "queries": [{"query": "x", "timestamp": "u", "result_refs": [{"tsu_id": "T"}]}, {"query": "y"}]}, {"session_id": "b", "queries": []}]}))
    (tmp_path / "t.json").write_text("{broken")
    rows = sorted((r.session_id, r.at if r.at is not None else -1, r["query"], r.result_refs and r.result_refs[0].tsu_id) for r in readers.read_sessions(spark, str(tmp_path)).collect())
    assert rows == [("a", 0, "x", "T"), ("a", 1, "y", None), ("b", -1, None, None)]


def test_failures_contents_and_the_newest_summary(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"failures": [{"source_file": "a", "stage": "extract", "reason": "r", "retry_count": 2}, None, {"source_file": "b"}]}))
    assert [(r.ord, r.source_file, r.retry_count) for r in readers.read_failures(spark, str(tmp_path / "f.json")).collect()] == [(0, "a", 2), (2, "b", None)]
    (tmp_path / "l.jsonl").write_text('{"content": "x", "other": 1}\n\n{"content": ""}\nbroken\n{"id": 2}\n{"content": "y"}\n')
    assert [r.content for r in readers.read_contents(spark, str(tmp_path / "l.jsonl")).collect()] == ["x", "y"]
    (tmp_path / "none").mkdir()
    assert readers.read_newest(spark, str(tmp_path / "none"), "mrr double").count() == 0
    (tmp_path / "none" / "s.json").write_text('{\n"mrr": 0.5}')
    assert readers.read_newest(spark, str(tmp_path / "none"), "mrr double").first().mrr == 0.5


def test_stages_by_hand(spark):
    columns = "b string, total int, processed int, parsed int, chunked int, covered int, passages int, indexed boolean"
    counts = [("new", 10, 0, 0, 0, 0, 0, False), ("begun", 10, 3, 0, 0, 0, 0, None), ("read", 10, 10, 4, 0, 0, 0, False), ("cut", 10, 10, 0, 10, 0, 0, False), ("kept", 8, 8, 0, 1, 9, 5, False), ("none", None, None, None, None, None, None, None)]
    got: dict = {}
    for r in monitor.stage_states(spark.createDataFrame(counts, columns), ["b"]).collect():
        got.setdefault(r.b, []).append(f"{r.status[0]}{r.progress}")
    assert got == {"new": ["p0", "p0", "p0", "p0", "c100"], "begun": ["a30", "a0", "a0", "a0", "c100"], "read": ["c100", "a0", "a0", "a0", "c100"], "cut": ["c100", "c100", "a30", "a0", "c100"], "kept": ["c100", "c100", "c100", "a50", "c100"], "none": ["p0", "p0", "p0", "p0", "c100"]}
    zones = monitor.capacities(spark.createDataFrame([(None,), (300_000,), (300_001,), (700_001,)], "n long"), "n").collect()
    assert [z.zone for z in zones] == ["GREEN", "GREEN", "YELLOW", "RED"] and zones[1].plain_mb == monitor.capacity(300_000)["plain_mb"]


def test_compatible_text_and_suspicious_boundaries(spark):
    rows = spark.createDataFrame([("Ａｂ① ﬁ",), ("plain",), (None,)], "t string").select(nfkc(F.col("t")).alias("t")).collect()
    assert [r.t for r in rows] == ["Ab1 fi", "plain", None]
    scored = spark.createDataFrame([(1, "x\ny" + "z" * 400, True), (1, "w" * 400, False), (1, "v", True)], "doc_id int, text string, is_boundary boolean")
    (row,) = structure.suspicious_boundaries(scored).collect()
    assert row.n == 403 and row.preview == "x y" + "z" * 77 and structure.boundary_density(scored).first().percent == 66.67
