"""Operators made of joins: tool calls, neighbours, SimHash, URLs, lines, and the pipeline."""

import itertools

import numpy as np
import pytest
import xxhash
from helpers import SF, rows_of
from pyspark.sql import functions as F
from test_near_copies import plain_kept

import __spark_entry__ as entry
import corpus_pipeline
from lectern.llm import line_dedup, neighbours, queries, simhash, tool_calls, url_reputation

TEN = sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0]))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
@pytest.mark.parametrize("size", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_same_rows_as_sql(spark, name, size):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{size}/{t}.parquet'")
    assert rows_of(queries.queries()[name](spark, size).toPandas()) == rows_of(con.execute(queries.oracle_sql()[name]).fetchdf())


def test_all_queries():
    assert [int(n[2:].split("_")[0]) for n in TEN] == list(range(1, 14))


def test_op1_levels_cycles_and_validation(spark):
    schemas = spark.createDataFrame([("f", "n", "integer", True), ("f", "s", "string", False)], "name string, param string, type string, required boolean")
    call = "conv_id long, turn long, call_id string, name string, arguments string, needs array<string>"
    calls = spark.createDataFrame(
        [(1, 0, "a", "f", '{"s":"x","n":1}', None), (1, 1, "b", "f", '{"n":"q"}', ["a", "a"]), (1, 2, "c", "f", None, ["b", "zz"]), (1, 3, "d", "g", "[1]", ["e"]), (1, 4, "e", "f", '{"n":2,"k":null}', ["d"]), (1, 4, "h", "f", '{"n":3}', ["e"]),
         (1, 9, "a", "f", "{}", None), (None, 0, "a", "f", "{}", None), (2, 0, None, "f", "{}", None)],
        call,
    )
    results = spark.createDataFrame([(1, 1, "a", "done"), (1, 5, "a", "again"), (1, 2, "b", None), (9, 0, "q", "lost")], "conv_id long, turn long, call_id string, content string")
    got = {r.call_id: r for r in tool_calls.link_tool_calls(calls, results, schemas).collect()}
    assert {k: r.level for k, r in got.items()} == {"a": 0, "b": 1, "c": 2, "d": -1, "e": -1, "h": -1}
    assert got["a"].duplicates == 2 and got["a"].message == '{"arguments":{"n":1,"s":"x"},"errors":[],"id":"a","level":0,"name":"f","result":"done"}'
    assert got["b"].errors == ["type:n"] and got["c"].errors == ["missing:n", "no_result", "unknown_dependency"]
    assert got["d"].errors[0] == "not_an_object" and got["e"].errors == ["unknown:k", "no_result", "dependency_cycle"]
    assert tool_calls.link_tool_calls(calls.limit(0), results.limit(0), schemas).count() == 0


ARGUMENTS = {
    '{"n":"5","s":7}': (["type:n", "type:s"], '{"n":"5","s":7}'),
    '{"o":{"z":1,"a":[{"y":2,"x":null}]},"n":2,"s":{}}': (["type:s"], '{"n":2,"o":{"a":[{"x":null,"y":2}],"z":1},"s":{}}'),
    '{"n":1,"n":2}': (["not_an_object"], "{}"),
    '{"n":2.50,"f":2.50,"l":[1, "a"],"b":true}': (["type:n"], '{"b":true,"f":2.5,"l":[1,"a"],"n":2.5}'),
    '{"n":5.0,"f":"x","l":{},"b":1,"o":[]}': (["type:b", "type:f", "type:l", "type:o"], '{"b":1,"f":"x","l":{},"n":5,"o":[]}'),
    '{"n":1,"s":null,"a b.c":0}': (["unknown:a b.c"], '{"a b.c":0,"n":1,"s":null}'),
    '"text"': (["not_an_object"], "{}"),
    '{"n":1': (["not_an_object"], "{}"),
    '{"n":1,"s":"' + "long " * 20_000 + '"}': ([], '{"n":1,"s":"' + "long " * 20_000 + '"}'),
}


def test_op1_types_and_canonical_json(spark):
    kinds = {"n": "integer", "f": "number", "s": "string", "b": "boolean", "o": "object", "l": "array"}
    schemas = spark.createDataFrame([("f", p, t, p == "n") for p, t in kinds.items()], "name string, param string, type string, required boolean")
    calls = spark.createDataFrame([(1, 0, str(k), "f", a, None, "x", "y") for k, a in enumerate(ARGUMENTS)], "conv_id long, turn long, call_id string, name string, arguments string, needs array<string>, errors string, level string")
    results = spark.createDataFrame([(1, 1, str(k), "ok") for k in range(len(ARGUMENTS))], "conv_id long, turn long, call_id string, content string")
    got = {int(r.call_id): r for r in tool_calls.link_tool_calls(calls, results, schemas).collect()}
    for k, (errors, written) in enumerate(ARGUMENTS.values()):
        assert got[k].errors == errors and got[k].message.startswith('{"arguments":' + written + ',"errors":[')


def plain_levels(needs):
    """Levels by repeated passes; what never settles is -1."""
    level = {c: 0 for c in needs if not needs[c]}
    while True:
        ready = {c: 1 + max(level[x] for x in needs[c]) for c in needs if c not in level and all(x in level for x in needs[c])}
        if not ready:
            return level | {c: -1 for c in needs if c not in level}
        level |= ready


@pytest.mark.parametrize("seed", range(2))
def test_op1_levels_by_brute_force(spark, seed):
    """Chains, calls with several dependencies, circles of both, and a call that needs itself."""
    rng = np.random.default_rng(seed)
    needs = {f"c{k}": {f"c{int(x)}" for x in rng.integers(max(0, k - 6), k, rng.integers(0, 3))} if k else set() for k in range(160)}
    needs |= {f"d{k}": {f"d{k - 1}"} if k else set() for k in range(700)} | {"e0": {"e1"}, "e1": {"e0"}, "e2": {"e1"}, "e3": {"e2", "c5"}, "e4": {"e3"}, "e5": {"e5"}, "e6": {"d699", "c159", "e7"}, "e7": {"d10"}}
    calls = spark.createDataFrame([(1, c) for c in needs], "conv_id long, call_id string")
    edges = spark.createDataFrame([(1, c, x) for c, xs in needs.items() for x in xs], "conv_id long, call_id string, needs string")
    rows = tool_calls.levels(calls, edges).collect()
    assert len(rows) == len(needs) and {r.call_id: r.level for r in rows} == plain_levels(needs)


def ladder(n):
    return {f"c{k}": {f"c{k - s}" for s in (1, 2) if k >= s} for k in range(n)}


def diamonds(n):
    return {"j0": set()} | {x: y for k in range(n) for x, y in ((f"a{k}", {f"j{k}"}), (f"b{k}", {f"j{k}"}), (f"j{k + 1}", {f"a{k}", f"b{k}", f"j{k}"}))}


@pytest.mark.parametrize("needs, most", [(ladder(24), 40), (ladder(2_000), 55), (diamonds(400), 55), ({f"c{k}": {f"c{j}" for j in range(max(0, k - 5), k)} for k in range(300)}, 50)])
def test_op1_ladders_in_few_rounds(spark, monkeypatch, needs, most):
    """However long a ladder is, its levels take a logarithmic number of written tables."""
    made = []
    monkeypatch.setattr(tool_calls, "cut_lineage", lambda df, f=tool_calls.cut_lineage: made.append(1) or f(df))
    calls = spark.createDataFrame([(1, k, c) for k, c in enumerate(needs)], "conv_id long, turn long, call_id string")
    edges = spark.createDataFrame([(1, c, x) for c, xs in needs.items() for x in xs], "conv_id long, call_id string, needs string")
    rows = tool_calls.levels(calls, edges).collect()
    assert {r.call_id: r.level for r in rows} == plain_levels(needs) and len(rows) == len(needs)
    assert len(made) <= most


@pytest.mark.parametrize("seed", range(3))
def test_op1_any_graph_with_turns(spark, seed):
    """Random graphs with circles, needs of later calls and of the call itself."""
    rng = np.random.default_rng(seed)
    needs = {(v, f"c{k}"): {f"c{int(x)}" for x in rng.integers(0, 14, rng.integers(0, 3))} if rng.random() < 0.3 else {f"c{int(x)}" for x in rng.integers(0, k, rng.integers(0, 4))} if k else set() for v in range(12) for k in range(14)}
    calls = spark.createDataFrame([(v, k, c) for k, (v, c) in enumerate(needs)], "conv_id long, turn long, call_id string")
    edges = spark.createDataFrame([(v, c, x) for (v, c), xs in needs.items() for x in xs], "conv_id long, call_id string, needs string")
    want = {(v, c): n for v in range(12) for c, n in plain_levels({c: xs for (w, c), xs in needs.items() if w == v}).items()}
    assert {(r.conv_id, r.call_id): r.level for r in tool_calls.levels(calls, edges).collect()} == want


def exact_top(table, k=20):
    out = {}
    for q in [i for i in table if i % 20 == 0]:
        scored = sorted((-float(np.dot(table[q], table[i])), i) for i in table if i != q)
        out[q] = [i for _, i in scored[:k]]
    return out


def test_op6_recall_and_scores(spark):
    table = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect() if r.embedding is not None}
    rows = entry.queries()["op6_nearest_neighbours"](spark, "/root/testdata/sf0.01").collect()
    want, got = exact_top(table), {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert r.score == pytest.approx(float(np.dot(table[r.query_id], table[r.vec_id])), abs=1e-12)
    assert got.keys() == want.keys() and np.mean([len(set(got[q]) & set(want[q])) / len(want[q]) for q in want]) >= 0.9


def recall(got, vectors, k=20):
    """Mean share of the true nearest among those found, by numpy."""
    shares = []
    for q in got:
        sim = vectors @ vectors[q]
        sim[q] = -np.inf
        shares.append(len(set(np.argpartition(-sim, k)[:k].tolist()) & set(got[q])) / k)
    return float(np.mean(shares))


def found_lists(rows):
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
    return got


def test_op6_descent_and_search_in_many_small_blocks(spark):
    """10,000 vectors in blocks of 32: the first graph is poor, descent and search make it good, and long vectors change nothing."""
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(10_000, 12)) + 2 * rng.normal(size=(40, 12))[rng.integers(0, 40, 10_000)]
    vectors[[5, 77, 1000]] *= np.array([[10.0], [1_000.0], [1e150]])
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = found_lists(neighbours.nearest(table, F.col("id") % 100 == 0, block=32).collect())
    assert len(got) == 100 and all(len(v) == 20 for v in got.values()) and recall(got, vectors) >= 0.9
    own = vectors[np.arange(10_000) % 3 > 0]
    length = np.log2(np.linalg.norm(own / np.abs(own).max(1)[:, None], axis=1)) + np.log2(np.abs(own).max(1))
    rest = spark.createDataFrame([(k, int(np.floor(n)), float(n), (v / 2.0**n).tolist()) for k, (v, n) in enumerate(zip(own, length))], "id long, band int, log_length double, direction array<double>")
    codes = neighbours.cut_lineage(neighbours._code(rest, [0.0] * 12))
    changed = [neighbours.neighbour_graph(codes, 12 + neighbours.EXTRA, block=32, rounds=n).agg(F.sum("sim")).first()[0] for n in (0, 2)]
    assert changed[1] > changed[0]


@pytest.mark.parametrize("share, times", [(0.01, 10.0), (0.1, 10.0), (0.5, 3.0), (0.1, 1_000.0)])
def test_op6_mixed_lengths(spark, share, times):
    """Some of 20,000 vectors several times longer than the rest, as of two models in one table."""
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(20_000, 32))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors[rng.permutation(20_000)[: int(share * 20_000)]] *= times
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    assert recall(found_lists(neighbours.nearest(table, F.col("id") % 100 == 0).collect()), vectors) >= 0.9


def test_op6_ties_copies_and_unusable_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=4) * (1 + i % 3)]) for i in range(60)]
    rows += [(100 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(60)]
    usable = dict(rows)
    rows += [rows[5], (200, None), (201, [0.0] * 4), (202, [1.0, None, 1.0, 1.0]), (203, [float("nan")] * 4), (204, [1.0]), (None, [1.0] * 4), (205, []), (206, [float("inf"), 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).withColumn("id", F.lit("clash"))
    got = {}
    for r in neighbours.nearest(df, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == exact_top({i: np.array(v) for i, v in usable.items()})
    assert neighbours.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r)[:3] for r in neighbours.nearest(few, F.col("id") % 20 == 0).collect()] == [(0, 1, 1)]


def plain_fingerprint(text, words=3):
    tokens = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ")
    tokens = [t for t in tokens if t]
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + words]) for i in range(len(tokens) - words + 1)] or [" ".join(tokens)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    parent = {i: i for i in fps}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 2:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in fps}


def test_op7_query_by_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    fps = {i: plain_fingerprint(t) for i, t in docs.items()}
    want = plain_components(fps)
    rows = entry.queries()["op7_simhash_near_dedup"](spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{fps[i]:016x}", want[i]) for i in docs}


def test_op7_links_meet_at_every_pair_of_bits(spark):
    """A code of random fingerprints with one and two bits turned: no link is lost, three bits do not link."""
    rng = np.random.default_rng(5)
    values = [int(x) for x in rng.integers(-(2**63), 2**63, 40)]
    near = [v ^ (1 << int(a)) ^ (1 << int(b)) for v in values for a, b in rng.integers(0, 63, (6, 2))]
    far = [v ^ 0b111 << int(a) for v in values for a in rng.integers(0, 60, 2)]
    every = sorted(set(values + near + far + [0, -1, 1, 3, 7, -(2**63)]))
    mask = 2**64 - 1
    want = {(a, b) for a, b in itertools.combinations(every, 2) if ((a ^ b) & mask).bit_count() <= 2}
    got = [tuple(r) for r in simhash.links(spark.createDataFrame([(v,) for v in every], "fp long")).collect()]
    assert set(got) == want


def test_op7_chain_and_odd_rows(spark, odd):
    path = spark.createDataFrame([(k, k + 1) for k in range(300)], "a long, b long")
    assert {r.label for r in simhash.components(path).collect()} == {0}
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and len({r.component_id for r in rows if r.fingerprint == "0" * 16}) == 1
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len({r.component_id if r.component_id is not None else "null" for r in rows})
    assert simhash.keep_one(odd.limit(0)).count() == 0


def test_op9_rules_and_bounds(spark):
    urls = ["http://WWW.Example.com/en/x", "http://example.com/en/1", "http://a.example.com/EN/", "ftp://x.net/fr/?q", "http://x.net/fr", "nothing", None, "http://notcom/en/", "http://bad.org/1", "http://bad.org#x", "://"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("verdict", F.lit("clash"))
    more = spark.createDataFrame([(100 + k, f"http://bad.org/{k}", "c", "c") for k in range(200)] + [(400 + k, f"http://good.org/{k}", "c", "c") for k in range(200)], "page_id long, url string, host string, verdict string")
    outcomes = spark.createDataFrame([(100 + k, 0) for k in range(200)] + [(400 + k, 1) for k in range(200)] + [(0, None)], "page_id long, good int")
    got = {r.page_id: r for r in url_reputation.judge(pages.unionByName(more), outcomes, queries.URL_RULES).collect()}
    assert [(got[k].rule, got[k].verdict) for k in (0, 1, 2, 3, 4)] == [("www.example.com/en/", "allow"), ("example.com/en/", "block"), ("com/", "allow"), ("net/fr/", "block"), (None, got[4].verdict)]
    assert (got[5].host, got[5].path, got[6].host, got[9].path) == ("", "", "", "") and got[8].verdict == "block" and got[450].verdict == "allow" and len(got) == 411
    assert url_reputation.judge(pages, outcomes.limit(0), queries.URL_RULES).where("rule is null and verdict = 'block'").count() == 0
    assert url_reputation.judge(pages.limit(0), outcomes, queries.URL_RULES).count() == 0


def test_op10_thresholds_and_odd_rows(spark, odd):
    rows = [(k, f"keep {k}\nshared line\nrare", f"s{k}" if k else None) for k in range(8)] + [(20 + k, "seven only", f"s{k}") for k in range(7)] + [(40, None, "x"), (41, "", "x"), (42, "shared line", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in line_dedup.remove_boilerplate(docs).collect()}
    assert got[0] == "keep 0\nshared line\nrare" and got[3] == "keep 3" and got[42] == "" and got[20] == "seven only" and got[40] is None and got[41] == ""
    out = line_dedup.remove_boilerplate(odd, min_sites=2)
    assert out.count() == odd.count() and set(odd.columns) <= set(out.columns)
    assert line_dedup.remove_boilerplate(odd.limit(0)).count() == 0


def test_op10_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(k, f"own {k}\nshared", f"s{k}", "x", "y", "z") for k in range(9)], "doc_id long, text string, source string, __t1 string, __cut string, row string")
    got = line_dedup.remove_boilerplate(docs)
    assert got.columns == [*docs.columns, "lines_total", "lines_removed"]
    assert {(r.doc_id, r.text, r["__t1"], r["__cut"], r["row"]) for r in got.collect()} == {(k, f"own {k}" + "\nshared" * (k == 0), "x", "y", "z") for k in range(9)}


def test_lines_by_shuffle_and_by_broadcast_agree(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"own {k}\nshared {k % 3}\nhot", f"s{k % 12}") for k in range(60)], "doc_id long, text string, source string")
    rows = lambda: sorted(map(tuple, line_dedup.remove_boilerplate(docs, min_sites=4).collect()))
    small = rows()
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", -1)
    assert rows() == small and any(r[-1] == 2 for r in small)


@pytest.mark.parametrize("name", ["op1_tool_call_linking", "op10_line_dedup"])
def test_native_plans(spark, name):
    plan = queries.queries()[name](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_pipeline_by_hand(spark, tmp_path):
    """Each stage decides as its operator does, keeps the columns of documents, and loses nothing else."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept <= {r.doc_id for r in before.select("doc_id").collect()}
        if name == "near_duplicates":
            assert kept == plain_kept({r.doc_id: r.text for r in before.collect()})
        if name == "language_id":
            assert kept == {i for i, t in text.items() if any(c.isalpha() for c in t or "")}
    assert {r.doc_id for r in before.collect()} == kept and len(corpus_pipeline.STAGES) == 5


def test_language_stage_rejects_what_is_no_language(spark):
    """Letter junk and unknown scripts go, every clean document stays."""
    from lectern.llm import language

    rng = np.random.default_rng(3)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*corpus_pipeline.COLUMNS)
    junk = [" ".join("".join(rng.choice(list("qxzwkjvñß"), rng.integers(2, 9))) for _ in range(n)) for n in (5, 20, 80, 400) for _ in range(5)] + ["".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), n)) for n in (30, 300, 3000)] + ["Ελληνικά κείμενα με πολλές λέξεις", "русский текст и много слов", "漢字かな交じり文"]
    planted = spark.createDataFrame([(10_000_000 + k, t, None if k % 2 else "en", "junk", len(t)) for k, t in enumerate(junk)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, docs.unionByName(planted), SF).collect()}
    assert kept == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    profiles = language.train_profiles(docs)
    assert language.least_score(docs.limit(0), profiles) == 0.0 and language.least_score(docs, {}) == 0.0
    scores = sorted(r.score for r in language.predict_language(docs, profiles).where("lang = lang_pred").collect())
    assert language.LEVEL_SHARE * scores[0] <= language.least_score(docs, profiles) <= language.LEVEL_SHARE * scores[len(scores) // 100]


def test_pipeline_leaves_its_last_table_only(spark):
    from pathlib import Path

    from lectern.llm.common import shared_folder

    shared = Path(shared_folder(spark).removeprefix("file:"))
    before = set(shared.glob("pipeline-*"))
    rows = corpus_pipeline.run(spark, SF)
    (own,) = set(shared.glob("pipeline-*")) - before
    assert [p.name for p in own.iterdir()] == ["4-best_fit_packing"] and rows.count() > 100
