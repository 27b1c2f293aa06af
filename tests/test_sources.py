import hashlib
import io
import json
import zipfile

from pyspark.sql import functions as F

from lectern.operators import monitor, reports
from lectern.sources import readers, sinks
from lectern.streaming import ingest


def test_files(spark, tmp_path):
    docx, epub = io.BytesIO(), io.BytesIO()
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>Para</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    with zipfile.ZipFile(epub, "w") as z:
        z.writestr("c1.xhtml", "<html><head><title>t</title></head><body><p>One</p></body></html>")
    for name, raw in {"a.docx": docx.getvalue(), "b.epub": epub.getvalue(), "c.html": b"<p>x</p><script>n</script>y", "d.rtf": rb"{\rtf1{\fonttbl{\f0 Arial;}}Hi\par there\'e9}", "e.txt": "안녕".encode("cp949"), "f.md": b"# T", "g.docx": b"broken", "h.pdf": b"%PDF", "i.xyz": b"no", "j.txt": b" "}.items():
        (tmp_path / name).write_bytes(raw)
    files = readers.scan_directory(spark, str(tmp_path), content=True)
    assert files.count() == 9
    got = {r.name: (r.text, r.problem) for r in readers.extract_text(files).collect()}
    assert got["a.docx"][0] == "Para\na\tb" and got["b.epub"][0] == "One" and got["c.html"][0] == "x\ny" and got["d.rtf"][0] == "Hi\nthereé"
    assert got["e.txt"][0] == "안녕" and got["g.docx"][1].startswith("BadZipFile") and got["h.pdf"][1] == "no parser for pdf" and got["j.txt"][1] == "empty"
    assert readers.extract_text(files.where("ext = 'pdf'"), lambda raw: "paged").first().text == "paged"
    done = spark.createDataFrame([("a.docx",)], "name string")
    assert readers.unprocessed(files, done).count() == 8


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": "x"}\n\n$schema\n{broken\n{"a": 2}\n')
    rows = readers.read_json_lines(spark, str(tmp_path / "x.jsonl"), "a int, b string").orderBy("a").collect()
    assert [tuple(r) for r in rows] == [(1, "x"), (2, None)]
    (tmp_path / "gold.json").write_text(json.dumps({"queries": [{"id": "Q1", "question": "q"}]}))
    assert readers.read_gold(spark, str(tmp_path / "gold.json")).first().id == "Q1"
    (tmp_path / "c.txt").write_text("[chunk 1]\none\nmore\n[chunk 2]\ntwo\n")
    assert [r.chunk for r in readers.read_chunk_files(spark, str(tmp_path / "c.txt")).orderBy("chunk_index").collect()] == ["one\nmore", "two"]


def test_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    sinks.replace_table(spark.range(3), root)
    sinks.replace_table(spark.range(5), root)
    assert sinks.read_table(spark, root).count() == 5
    a, b = (sinks.manifest(spark.range(50).repartition(n).withColumnRenamed("id", "document_id")).first() for n in (1, 7))
    assert (a.rows, a.digest_xor, a.digest_sum) == (50, b.digest_xor, b.digest_sum)


def test_cache_and_changes(spark):
    texts = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "text string")
    empty = spark.createDataFrame([], "hash string, text string, vector array<double>")
    filled = sinks.fill_cache(texts, empty, lambda c: F.array(F.length(c).cast("double")))
    assert filled.count() == 2 and sinks.fill_cache(texts, filled, lambda c: F.array(F.lit(0.0))).count() == 2
    docs = spark.createDataFrame([("x", "1"), ("y", "2")], "name string, text string")
    stored = sinks.changed(docs, spark.createDataFrame([], "name string, hash string"))
    assert stored.count() == 2 and sinks.changed(docs, stored.where("name = 'x'")).count() == 1


def test_ingest_twice(spark, tmp_path):
    inbox, root, checkpoint = (str(tmp_path / n) for n in ("in", "table", "cp"))
    put = lambda rows: spark.createDataFrame(rows, "name string, source string, text string").write.mode("append").json(inbox)
    put([("a", "s", "hello"), ("b", "s", "hello")])
    ingest.ingest(spark, inbox, root, checkpoint).awaitTermination(120)
    put([("c", "s", "other"), ("d", "s", "hello ")])
    for _ in range(2):
        ingest.ingest(spark, inbox, root, checkpoint).awaitTermination(120)
    rows = ingest.documents(spark, root).collect()
    assert len(rows) == 2 and {r.text.strip() for r in rows} == {"hello", "other"}


def test_sessions(spark):
    events = spark.createDataFrame([("parse_completed", "DONE", "2024-01-01 00:00:00"), ("x", "DONE", "2024-01-01 00:00:50"), ("parse_completed:y", "DONE", "2024-01-01 02:00:00")], "event string, status string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = ingest.activity(events).orderBy("first").collect()
    assert [(r.n, r.finished, r.active_s) for r in rows] == [(2, 1, 50.0), (1, 1, 0.0)]


def test_epub_spine_and_properties(spark, tmp_path):
    epub, docx = io.BytesIO(), io.BytesIO()
    page = lambda t: f"<html><body><p>{t}</p></body></html>"
    with zipfile.ZipFile(epub, "w") as z:
        z.writestr("OEBPS/a.xhtml", page("last")), z.writestr("OEBPS/b c.xhtml", page("first")), z.writestr("OEBPS/z.xhtml", page("unnamed"))
        z.writestr("OEBPS/content.opf", '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="i1" href="a.xhtml"/><item id="i2" href="b%20c.xhtml"/></manifest><spine><itemref idref="i2"/><itemref idref="i1"/></spine></package>')
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("docProps/core.xml", '<p:coreProperties xmlns:p="x" xmlns:dc="y"><dc:title> A Title </dc:title><dc:creator>Someone</dc:creator></p:coreProperties>')
    assert readers.epub_text(epub.getvalue()) == "first\n\nlast\n\nunnamed"
    files = spark.createDataFrame([("docx", docx.getvalue()), ("docx", b"broken"), ("txt", b"x")], "ext string, content binary")
    assert [(r.title, r.author) for r in readers.embedded_metadata(files).collect()] == [("A Title", "Someone"), (None, None), (None, None)]


def test_small_files(spark, tmp_path):
    (tmp_path / "B.md").write_text("---\ntitle: T\n---\n# body\ntext"), (tmp_path / "a.txt").write_text("x"), (tmp_path / "state.json").write_text(json.dumps({"processed": ["a", "b", "a"]}))
    assert [r.name for r in readers.scan_directory(spark, str(tmp_path)).collect()] == ["a.txt", "B.md"]
    assert {r.name for r in readers.read_processed(spark, str(tmp_path / "state.json")).collect()} == {"a", "b"}
    row = readers.read_markdown(spark, str(tmp_path)).first()
    assert row.front == {"title": "T"} and row.body == "# body\ntext"
    raw = spark.createDataFrame([("My Book.pdf", "/raw/My Book.pdf")], "name string, path string")
    assert readers.resolve_sources(spark.createDataFrame([("My_Book.md",), ("x.md",)], "name string"), raw).where("raw_path is not null").count() == 1
    assert readers.discover(spark, str(tmp_path), 1).first().name == "B.md" and readers.newest(spark, str(tmp_path)).endswith("state.json")
    digests = {r.name: r.sha256 for r in sinks.file_digests(spark, str(tmp_path), "*.txt").collect()}
    assert digests == {"a.txt": hashlib.sha256(b"x").hexdigest()}


def test_writers(spark, tmp_path):
    docs = spark.createDataFrame([("s1", "T", "en", 3.0, "body")], "stem string, title string, language string, noise double, text string")
    sinks.write_markdown(docs, str(tmp_path / "md"))
    assert spark.read.parquet(str(tmp_path / "md")).first().value == "---\ntitle: T\nlanguage: en\nnoise: 3.0\n---\n\nbody"
    chunks = spark.createDataFrame([("s1", 1, "two"), ("s1", 0, "one"), ("s2", 0, "x")], "stem string, chunk_index int, chunk string")
    sinks.write_chunks(chunks, str(tmp_path / "chunks"))
    assert {(r.stem, r.chunks, r.characters) for r in spark.read.json(str(tmp_path / "chunks/meta")).collect()} == {("s1", 2, 6), ("s2", 1, 1)}
    assert sinks.chunk_markdown(chunks, "stem").where("stem = 's1'").first().value == "## Chunk 1\n\none\n\n## Chunk 2\n\ntwo"
    for _ in range(2):
        sinks.mark_processed(spark.createDataFrame([("a",), ("b",), ("a",)], "name string"), str(tmp_path / "done"))
    assert sorted(r.name for r in spark.read.json(str(tmp_path / "done")).collect()) == ["a", "b"]
    sinks.write_report(chunks, spark.createDataFrame([(1,)], "n int"), str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report/rows")).count() == 3
    sinks.write_json_lines(chunks, str(tmp_path / "lines")), sinks.append(chunks, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 6
    assert sinks.backup_table(chunks, str(tmp_path / "copy")) and spark.read.parquet(str(tmp_path / "copy")).count() == 3
    one = sinks.fingerprint({"c": chunks}, {"k": "10"})
    assert one == sinks.fingerprint({"c": chunks.repartition(3)}, {"k": "10"}) != sinks.fingerprint({"c": chunks}, {"k": "5"})
    known = sinks.manifest(chunks, "stem")
    assert reports.stale(known, "other") and not reports.stale(known, "-".join(known.select("digest_xor", "digest_sum").first()))


def test_event_log_and_stream(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log/e.jsonl").write_text('{"event": "parse_completed", "status": "DONE", "ts": "2024-01-01T00:00:00"}\n{"event": "x", "status": "OPEN", "ts": "2024-01-01T00:00:05"}\n')
    assert readers.read_event_log(spark, str(tmp_path / "log")).count() == 2
    query = ingest.event_stream(spark, str(tmp_path / "log")).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert monitor.event_counts(spark.table("seen"), prefix="parse_").first().done == 1
    assert monitor.latest(spark.table("seen"), 1, F.desc("ts")).first().event == "x"
    names = spark.createDataFrame([("\u1112\u1161\u11ab글",), ("other",)], "name string")
    assert monitor.library_search(names, "한", ["name"]).count() == 1


def test_registry_of_one_object(spark, tmp_path):
    import json

    from lectern.sources import readers

    docs = {"d1": {"document_id": "d1", "file_hash": "h1", "source_file": "a.txt", "chunk_count": 3, "ingest_status": "FAILED", "retry_count": 2}, "d2": {"source_file": "b.txt", "file_hash": "h2", "unheard": [1]}, "d3": None}
    (tmp_path / "registry.json").write_text(json.dumps({"version": 1, "documents": docs}, indent=1))
    (tmp_path / "other.json").write_text("[1, 2")
    got = {r.document_id: r for r in readers.read_registry(spark, str(tmp_path)).collect()}
    assert set(got) == {"d1", "d2"} and got["d1"].chunk_count == 3 and (got["d1"].ingest_status, got["d1"].retry_count) == ("FAILED", 2)
    assert (got["d2"].ingest_status, got["d2"].retry_count, got["d2"].max_retries, got["d2"].last_content_hash, got["d2"].ord) == ("PROCESSED", 0, 3, "h2", 1)


def test_metrics_with_latency(spark):
    from lectern.operators import evaluation

    ranked = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (2, 1, 7)], "query_id long, rank int, doc_id long")
    gold = spark.createDataFrame([(1, 6), (2, 8)], "query_id long, doc_id long")
    times = spark.createDataFrame([(1, 10.0), (1, 30.0), (2, 5.0), (3, 900.0)], "query_id long, latency_ms double")
    row = evaluation.retrieval_metrics(ranked, gold, latency=times).first()
    assert (row.n, row.mrr, row.latency_ms) == (2, 0.25, 12.5)
