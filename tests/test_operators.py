import hashlib

import pytest
from pyspark.sql import functions as F

from lectern.operators import corpus, evaluation, monitor, registry, reports, retrieval, structure


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_lexical_score_traps(spark):
    docs = frame(spark, [(1, "grace grace grace grace grace"), (2, "grace and other words"), (3, None), (4, "nothing")], "doc_id long, text string")
    q = frame(spark, [(7, "grace"), (8, "은혜"), (9, None)], "query_id long, question string")
    got = {(r.query_id, r.doc_id): r.bm25 for r in retrieval.lexical_scores(docs, q).collect()}
    assert set(got) == {(7, 2)} and 0 < got[7, 2] <= 1  # five occurrences make the idf negative


def test_diversity_backfills(spark):
    ranked = frame(spark, [(1, d, s, 1.0 - d / 10) for d, s in enumerate("aaaab")], "query_id long, doc_id long, source string, score double")
    got = retrieval.diversify(ranked, 4, 2, "source", F.desc("score"), F.col("doc_id")).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [0, 1, 4, 2]


REFS = "array<struct<book_id:string,chapter:int>>"


def test_filters_fall_back(spark):
    rows = frame(spark, [(1, "GEN", 3, "f"), (2, "GEN", None, "f"), (3, "EXO", 3, "g")], "doc_id long, book_id string, chapter int, source_file string")
    asked = frame(spark, [(1, ["GEN"], [("GEN", 4)]), (2, ["GEN"], [("GEN", 2)]), (3, ["LUK"], []), (4, [], [("GEN", 3)]), (5, ["GEN", "EXO"], [("GEN", 3)]), (6, ["GEN"], [])], f"query_id long, books array<string>, refs {REFS}")
    got = {}
    for r in retrieval.metadata_filter(rows, asked).collect():
        got.setdefault(r.query_id, set()).add(r.doc_id)
    assert got == {1: {1}, 2: {1, 2}, 5: {1}, 6: {1, 2}}  # no fit, and no book asked for, leave everything
    assert {r.query_id for r in retrieval.pool_of(asked, rows).where("narrow").collect()} == {1, 2, 5, 6}
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert ids(retrieval.file_scope(rows, rows.where("doc_id = 1"), ["g"])) == [3]
    assert ids(retrieval.file_scope(rows, rows, ["none"])) == []


def test_alignment_and_cosine(spark):
    rows = frame(spark, [([("GEN", 1)], False, "GEN", 1, ""), ([("GEN", 2)], False, "GEN", 1, ""), ([], False, "GEN", 1, ""), ([], False, "GEN", 1, "MY GEN.PDF"), ([], True, "GEN", 1, "GEN"), ([], False, None, 1, "")], f"q {REFS}, p boolean, book string, chapter int, file string")
    got = [r[0] for r in rows.select(retrieval.alignment(F.col("q"), F.col("p"), F.col("book"), F.col("chapter"), F.col("file"))).collect()]
    assert got == [0.8, 0.3, 0.1, 0.5, 0.0, 0.0]
    v = frame(spark, [([3.0, 4.0], [6.0, 8.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [round(r[0], 9) for r in v.select(retrieval.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0]
    assert v.select(retrieval.l2_normalise(F.col("a"))).first()[0] == pytest.approx([0.6, 0.8])


def test_hybrid_falls_back_to_the_whole_pool(spark):
    """A question without lexical hits ranks all passages of its book, with half a lexical part; a scope narrows further."""
    rows = [(1, "은혜와 믿음에 대한 글", "a", "ROM", 5, None), (2, "grace abounds here", "b", "ROM", 8, 1.0), (3, "faith alone", "c", "MRK", 1, None)]
    docs = frame(spark, rows, "doc_id long, text string, source string, book_id string, chapter int, confidence double")
    asked = frame(spark, [(1, "로마서 은혜"), (2, "grace"), (3, "은혜")], "query_id long, question string")
    got = {}
    for r in retrieval.rank_hybrid(docs, asked).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert {k: sorted(v) for k, v in got.items()} == {1: [1, 2], 2: [2], 3: [1, 2, 3]}
    assert {(r.query_id, r.doc_id) for r in retrieval.rank_hybrid(docs, asked, files=["c"]).collect()} == {(1, 3), (2, 3), (3, 3)}
    assert retrieval.rank_hybrid(docs, asked, k=500).count() == 6


def test_decisions(spark):
    reg = frame(spark, [("a", "ha", "s", "PROCESSED", 0, 3, "ha", None, None, 1), ("b", "hb", "s", "FAILED", 1, 3, None, None, None, 2), ("c", "hc", "s", "FAILED", 3, 3, None, None, None, 3), ("d", "hd", "s", "ABANDONED", 0, 3, "x", None, None, 4), ("e", "he", "s", "PROCESSED", 0, 3, None, None, None, 5), ("f", "hf", "s", "PROCESSED", 0, 3, "old", None, None, 6)], registry.REGISTRY)
    new = frame(spark, [(x, f"h{x}") for x in "abcdef"] + [("z", "ha"), ("y", "new"), (None, None)], "document_id string, file_hash string")
    got = {r.document_id: (r.matched, r.decision) for r in registry.classify(new, reg).collect()}
    assert got == {"a": ("a", "SKIP"), "b": ("b", "RETRY"), "c": ("c", "REPROCESS"), "d": ("d", "SKIP"), "e": ("e", "PROCESS"), "f": ("f", "REPROCESS"), "z": ("a", "SKIP"), "y": (None, "PROCESS"), None: (None, "PROCESS")}
    assert registry.register(reg, new.where("document_id = 'y'").withColumn("ord", F.lit(9).cast("long"))).count() == 7
    assert registry.migrate(reg.drop("max_retries", "ingest_status")).where("ingest_status = 'PROCESSED' AND max_retries = 3").count() == 6


def test_versions_and_purge(spark):
    reg = registry.supersede(frame(spark, [("a", "s", 1), ("b", "s", 2), ("c", "s", 3), ("x", "t", 1)], "document_id string, source_file string, ord long"))
    assert [(r.document_id, r.position) for r in registry.chain(reg, "b").orderBy("position").collect()] == [("a", 0), ("b", 1), ("c", 2)]
    left = registry.purge(frame(spark, [("a",), ("c",), ("x",), ("q",)], "document_id string"), reg)
    assert sorted(r[0] for r in left.collect()) == ["c", "q", "x"]
    table = frame(spark, [("a", 1), ("b", 2)], "document_id string, v int")
    assert sorted(map(tuple, registry.upsert(table, frame(spark, [("b", 9), ("n", 3)], "document_id string, v int")).collect())) == [("a", 1), ("b", 9), ("n", 3)]


def test_backfill(spark):
    old = frame(spark, [("a", None, "A"), ("b", None, None)], "document_id string, title string, author string")
    new = frame(spark, [("a", "Good title", "B"), ("b", "untitled", "admin")], "document_id string, title string, author string")
    got = {r.document_id: (r.title, r.author, r.changed) for r in registry.backfill(old, new).collect()}
    assert got == {"a": ("Good title", "A", True), "b": (None, None, False)}


def test_metrics(spark):
    ranked = frame(spark, [(1, 1, 10), (1, 2, 11), (2, 1, 20)], "query_id long, rank int, doc_id long")
    gold = frame(spark, [(1, 11), (3, 1)], "query_id long, doc_id long")
    row = evaluation.retrieval_metrics(ranked, gold).first()
    assert (row.n, row.p_at_1, row.mrr, row.p_at_5) == (2, 0.0, 0.25, 0.1) and row.ndcg == pytest.approx(0.315465)


def test_gold_with_short_questions(spark):
    docs = frame(spark, [(1, "one two three four five six seven eight nine"), (2, "tiny needle here"), (3, None)], "doc_id long, text string")
    q = frame(spark, [(1, "wo three four five six seven eight ni"), (2, "needle"), (3, "absent words here"), (4, None)], "query_id long, question string")
    assert sorted(map(tuple, evaluation.verbatim_gold(q, docs).collect())) == [(1, 1), (2, 2)]


def test_nearest_and_delta(spark):
    points = frame(spark, [("d", 10), ("d", 100), ("e", 5)], "doc string, at long")
    targets = frame(spark, [("d", 30), ("d", 100)], "doc string, at long")
    got = {(r.doc, r["at"]): r.distance for r in evaluation.nearest_distance(points, targets, ["doc"]).collect()}
    assert got == {("d", 10): 20.0, ("d", 100): 0.0, ("e", 5): None}
    assert evaluation.boundary_delta(points, targets, ["doc"], tolerance=15).first().confirmed == 1


def test_sample_is_exact_and_stable(spark):
    rows = frame(spark, [("a" if k % 3 else None, k) for k in range(30)], "s string, id long")
    first = sorted(map(tuple, evaluation.stratified(rows, "s", "id", 0.2).collect()), key=str)
    assert len(first) == 6 and first == sorted(map(tuple, evaluation.stratified(rows.repartition(3), "s", "id", 0.2).collect()), key=str)


def test_throughput(spark):
    events = frame(spark, [("2024-01-01 00:59:50", 1), ("2024-01-01 01:00:10", 1), ("2024-01-01 01:01:10", 0), ("2024-01-01 03:00:00", 1)], "ts string, d int").withColumn("ts", F.col("ts").cast("timestamp"))
    row = monitor.throughput(events, F.col("d") == 1).first()
    assert (row.active_s, row.finished) == (80.0, 3)
    assert monitor.capacity(500_000)["zone"] == "YELLOW" and monitor.pipeline_status({"extract": 5}, 10)[0]["progress"] == 50


def test_headings(spark):
    marked = frame(spark, [(1, 1, 1, "A"), (1, 2, 2, "B"), (1, 3, None, None), (1, 4, 1, "C"), (1, 5, 3, "D")], "doc_id long, at int, level int, title string")
    assert [r.path for r in structure.heading_paths(marked).orderBy("at").collect()] == [["A"], ["A", "B"], ["A", "B"], ["C"], ["C", "D"]]
    chunks = frame(spark, [(1, 0, "Intro text"), (1, 1, "Part One begins"), (1, 2, "more"), (1, 3, "Part Two here\nINTRODUCTION"), (1, 4, "a Sub Part of it"), (1, 5, "Part Three"), (2, 0, None)], "doc_id long, chunk_index int, chunk string")
    heads = frame(spark, [(1, 1, "Part One", 1), (1, 2, "## Part Two", 1), (1, 3, "INTRO", 2), (1, 4, "Sub Part", 2), (1, 5, "x", 1), (1, 6, "Part Three", 1)], "doc_id long, at int, title string, level int")
    got = structure.assign_headings(chunks, heads).orderBy("doc_id", "chunk_index").collect()
    assert [r.path for r in got] == [[], ["Part One"], ["Part One"], ["## Part Two"], ["## Part Two", "Sub Part"], ["Part Three"], []] and [r.depth for r in got][4] == 2


def test_page_headings(spark):
    schema = "doc_id long, text string, size double, bold boolean, page int, is_block_top boolean"
    body = [(d, "body text that is rather long and ends somewhere.", 10.0, False, 1, False) for d in (1, 2, 3) for _ in range(5)]
    large = [(1, t, 14.0, False, 2, True) for t in ("Big Title", "Another Title", "Third Title", "1 2 3 4 ab")]
    bold = [(2, t, 10.0, True, 2, False) for t in ("Bold One", "Bold Two", "Bold Three")] + [(3, "Lonely", 20.0, True, 1, True)]
    spans = frame(spark, body + large + bold, schema)
    profile = {r.doc_id: (r.body, r.size_hits, r.bold_hits, r.signal) for r in structure.page_profile(spans).collect()}
    assert profile == {1: (10.0, 3, 0, "size"), 2: (10.0, 0, 3, "bold"), 3: (10.0, 1, 0, None)}
    got = {r.text: (r.signal, r.confidence, r.validity) for r in structure.page_headings(spans).collect()}
    share = 8 / 9
    assert got.keys() == {"Big Title", "Another Title", "Third Title", "Bold One", "Bold Two", "Bold Three"}
    assert got["Big Title"] == ("size", pytest.approx(0.5 * 0.8 + 0.4 * share + 0.02, abs=1e-4), round(share, 4)) and got["Bold One"][1] == pytest.approx(0.5 * 0.8 + 0.4 * 7 / 8 + 0.01, abs=1e-4)


def test_boundary_candidates(spark):
    long = "a paragraph that goes on and on without any end to it, over more than eighty characters in all"
    rows = frame(spark, [("A heading", True), (long, False), (long + ".", False), ("Romans 5:3 " + long, False), ("", False), ("   ", True), (long + " 하였다", False), ("x" * 60 + " Romans 5:3 " + long, False)], "text string, met boolean")
    assert [r.score for r in structure.boundary_candidates(rows, heading="met").collect()] == [70.0, 30.0, 40.0, 45.0, -60.0, 40.0, 40.0, 30.0]


def test_hierarchical_chunks():
    from lectern.functions import chunk

    p = [("Heading", 0), ("x " * 60, 9), ("y " * 400, 140), ("Heading Two", 950), ("z" * 2000, 970), ("end", 2980)]
    starts = [True, False, False, True, False, False]
    got = chunk.hierarchical_chunks_of(p, starts, 1000, 80)
    assert [at for _, at in got] == [0, 950, 970, 1970, 2980] and got[0][0].startswith("Heading\n\nx") and [len(c) for c, _ in got[2:4]] == [1000, 1000]
    text = "First part is here.\n\nSecond part is here."
    assert chunk.candidates_of(text) == [("First part is here. Second part is here.", 0)] or len(chunk.candidates_of(text)) == 2
    assert chunk.offsets_in("abc def ghi def", ["def", "ghi", "none"]) == [4, 8]
    assert chunk.token_batches([100, 3000, 400, 0]) == [0, 0, 1, 1]


def test_structure_report(spark):
    docs = frame(spark, [(1, "\n\n".join(f"제목 {k}\n본문 문장이 여기에 있다. " + "긴 문장이 이어진다. " * 20 for k in range(6))), (2, "w" * 4000), (3, None)], "doc_id long, text string")
    heads = frame(spark, [(1, k, f"제목 {k}") for k in range(6)], "doc_id long, at int, title string")
    got = {r.profile: r for r in structure.structure_metrics(structure.structured_chunks(docs, heads)).collect()}
    assert got["B"].docs == 1 and got["B"].outlier_ratio == 1.0 and got["A"].docs == 2 and 0 <= got["A"].recovery_rate <= 1


def test_corpus_pieces(spark):
    names = frame(spark, [("열왕기하 주석.pdf",), ("Mark commentary.docx",), ("nothing.txt",), ("로마서.pdf",)], "n string")
    assert [r[0] for r in names.select(corpus.book_of_file(F.col("n"))).collect()][:2] == ["2KI", "MRK"]
    assert [r[0] for r in names.select(corpus.document_type(F.col("n"))).collect()] == ["general", "technical", "general", "general"]
    reg = frame(spark, [("d1", "Romans.md", 3), ("d2", "plain.md", 1), ("d3", "none.md", 0)], "document_id string, source_file string, chunk_count int")
    texts = frame(spark, [("Romans.md", 0, "# One\nRomans 8:1-2 and Romans 8:5"), ("Romans.md", 1, "## Two\nbody text, more of it.")], "source_file string, chunk_index int, chunk string")
    whole = frame(spark, [("plain.md", "the whole"), ("Romans.md", "not used")], "source_file string, text string")
    rows = corpus.chunk_rows(reg, texts, whole)
    got = {r.tsu_id: r for r in corpus.passages(reg, rows, corpus.atx_paths(rows)).collect()}
    first = got["TSU-ROM-d1_chunk_00000"]
    assert len(got) == 4 and (first.book_id, first.chapter, first.verse_start, first.verse_end, first.confidence) == ("ROM", 8, 1, 2, 1.0) and first.heading_path == ["One"]
    assert got["TSU-ROM-d1_chunk_00001"].heading_path == ["One", "Two"] and got["TSU-ROM-d1_chunk_00002"].content == "" and got["TSU-UNK-d2_chunk_00000"].content == "the whole"
    assert frame(spark, [("TSU-GEN-d1_chunk_00000",)], "t string").select(corpus.rebuilt_id(F.col("t"), F.lit("ROM"))).first()[0] == "TSU-ROM-d1_chunk_00000"


def test_states(spark):
    reg = frame(spark, [("a", "PROCESSED", 1, None), ("b", "FAILED", 0, "old"), ("c", "FAILED", 2, "old")], "document_id string, ingest_status string, retry_count int, pipeline_state string")
    after = corpus.transition(reg, frame(spark, [("a", "FAILED", "bad"), ("b", "PROCESSED", None)], "document_id string, status string, reason string"))
    assert {r.document_id: (r.ingest_status, r.retry_count, r.last_failure_reason) for r in after.collect()} == {"a": ("FAILED", 2, "bad"), "b": ("PROCESSED", 0, None), "c": ("FAILED", 2, None)}
    assert {r.document_id: r.pipeline_state for r in corpus.set_state(reg, reg.where("document_id = 'a'"), "INDEXED").collect()} == {"a": "INDEXED", "b": "old", "c": "old"}
    with pytest.raises(ValueError, match="invalid"):
        corpus.set_state(reg, reg, "GONE")
    failed = frame(spark, [("a", 0, "2024-01-01 00:00:00"), ("b", 1, "2024-01-01 00:00:00"), ("c", 3, "2024-01-01 00:00:00")], "document_id string, retry_count int, at string").withColumn("failed_at", F.col("at").cast("timestamp"))
    assert [r.document_id for r in corpus.retry_due(failed, F.lit("2024-01-01 00:00:03").cast("timestamp")).collect()] == ["a"]
    states = frame(spark, [("a", "PROCESSED"), ("b", "INDEXED")], "document_id string, pipeline_state string")
    assert [r.document_id for r in registry.pending(reg.drop("pipeline_state"), states).collect()] == ["a"]


def test_medians_and_samples_and_versions_by_brute_force(spark):
    import random

    rng = random.Random(1)
    rows = [(rng.choice("ab") if k % 50 else None, rng.randrange(40) / 4, k) for k in range(4001)]
    df = frame(spark, rows, "g string, v double, id long")
    for r in evaluation.exact_median(df, "v", ["g"]).collect():
        own = sorted(v for g, v, _ in rows if g == r.g)
        assert r.median == (own[(len(own) - 1) // 2] + own[len(own) // 2]) / 2
    order = lambda i: hashlib.md5(f"{i}|42".encode()).hexdigest()
    want = {(g, i) for s in ("a", "b", None) for g, i in sorted(((g, i) for g, _, i in rows if g == s), key=lambda x: order(x[1]))[: max(1, round(0.07 * sum(g == s for g, _, _ in rows)))]}
    assert {(r.g, r.id) for r in evaluation.stratified(df, "g", "id", 0.07).collect()} == want
    reg = df.select(F.concat(F.lit("d"), "id").alias("document_id"), F.col("g").alias("source_file"), F.col("id").alias("ord"))
    got = {r.document_id: (r.supersedes, r.superseded_by) for r in registry.supersede(reg, parts=37).collect()}
    for s in ("a", "b", None):
        own = [f"d{i}" for g, _, i in rows if g == s]
        assert all(got[d] == (own[k - 1] if k else None, own[k + 1] if k + 1 < len(own) else None) for k, d in enumerate(own))
    near = evaluation.band_join(df.select("g", F.col("id").alias("x")), df.select("g", F.col("id").alias("y")), ["g"], "x", 7, "y")
    assert near.count() == sum(a[0] == b[0] and a[0] is not None for a in rows for b in rows[max(0, a[2] - 7) : a[2] + 8])


def test_vector_search_with_odd_vectors(spark):
    rows = [(k, [float(k % 7 + 1), 1.0]) for k in range(40)] + [(50, None), (51, [0.0, 0.0]), (52, [1.0]), (53, [None, 1.0])]
    table = frame(spark, rows, "vec_id long, embedding array<double>")
    asked = table.where("vec_id in (0, 50, 51, 53)").select(F.col("vec_id").alias("query_id"), "embedding")
    got = retrieval.vector_topk(table, asked, 5).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 7), (0, 14), (0, 21), (0, 28), (0, 35)]
    assert retrieval.vector_topk(table, asked.limit(0), 5).count() == 0


def test_small_reports(spark):
    files = frame(spark, [("a.md", 10), ("b_chunks.txt", 20), ("c.bin", 30), ("D.MD", 5)], "name string, length long")
    assert {r.kind: (r.files, r.bytes) for r in reports.file_groups(files).collect()} == {"md": (2, 15), "chunks": (1, 20), "other": (1, 30)}
    log = frame(spark, [(k, float(k)) for k in range(300)], "ts long, latency_ms double")
    assert tuple(reports.session_latency(log).first()) == (200, 199.5)
    assert tuple(reports.progress(frame(spark, [(100,), (50,), (0,)], "progress int")).first()) == (3, 1, 50.0)
    assert reports.best_parameters(frame(spark, [(1, 5.0), (2, 3.0), (3, 3.0)], "size int, cost double"), ["size"], "cost").first().size == 2
    assert reports.eligible(frame(spark, [("q", "GEN"), ("", "GEN"), ("q", None)], "question string, book_id string")).count() == 1
    shown = frame(spark, [(0.5, 0.25, 0.125, 0.5)], "a double, b double, c double, d double").select(reports.explanation(*map(F.col, "abcd"))).first()[0]
    assert shown.startswith("bm25=0.500×0.30=0.150 | vector=0.250×0.25=0.062") and shown.endswith("total=0.255")
    assert tuple(r[0] for r in frame(spark, [("x" * 3602,), ("x" * 3601,)], "t string").select(corpus.oversized(F.col("t"))).collect()) == (True, False)


def test_answers_and_chunking_compared(spark):
    docs = frame(spark, [(1, "grace and mercy abound here. " * 20, "s"), (2, "the law of kings. " * 30, "t"), (3, None, "u")], "doc_id long, text string, source string")
    got = {r.query_id: r for r in reports.answer(docs, frame(spark, [(1, "mercy"), (2, "law")], "query_id long, question string"), 2).collect()}
    assert [x.doc_id for x in got[1].results][0] in (1, 2) and len(got[1].citations) == len(got[1].results) and got[2].themes
    rows = {r.strategy: r for r in reports.compare_chunking(docs).collect()}
    assert len(rows) == 5 and rows["fixed_500"].chunks >= rows["fixed_1500"].chunks and rows["fixed_500"].covered == pytest.approx(2 / 3, abs=1e-6)


def test_response_package(spark):
    ranked = frame(spark, [(1, 2, 11, 0.5), (1, 1, 10, 0.9)], "query_id long, rank int, doc_id long, final double")
    cited = frame(spark, [(1, 1, 10, "s", "text")], "query_id long, rank int, doc_id long, source string, excerpt string")
    summary = frame(spark, [(1, ["law"])], "query_id long, themes array<string>")
    asked = frame(spark, [(1, "what"), (2, "none")], "query_id long, question string")
    got = {r.query_id: r for r in reports.response(ranked, cited, summary, asked).collect()}
    assert [x.doc_id for x in got[1].results] == [10, 11] and got[1].citations[0].excerpt == "text" and got[1].themes == ["law"] and got[2].results == [] and got[2].themes == []


def test_plans_stay_small(spark):
    """Ranking windows prune before the shuffle, and filters reach the scan."""
    from helpers import SF

    from lectern.plans.queries import QUERIES

    plan = QUERIES["bm25_top100"](spark, SF)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in QUERIES["library_search"](spark, SF)._jdf.queryExecution().toString()
