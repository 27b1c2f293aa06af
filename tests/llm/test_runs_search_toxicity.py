"""Periodic runs, impact search and toxicity against brute force, on odd rows, and in accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import impact_index, periodic_runs, queries, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, exponent=4, length=6):
    """Every maximal stretch of every period, smallest periods first."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(length, exponent * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=60) | st.lists(st.sampled_from("abc"), max_size=40).map(lambda x: x * 5) | st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=7).map(lambda x: x * 4), max_size=6).map(lambda x: sum(x, [])))
def test_op11_runs_by_brute_force(words):
    assert periodic_runs.runs_of(words) == plain_runs(words)


@pytest.mark.parametrize("exponent, length", [(2, 2), (2, 6), (3, 3), (3, 10), (4, 2), (5, 6)])
def test_op11_other_limits(exponent, length):
    rng = random.Random(exponent * 10 + length)
    for _ in range(150):
        words = [rng.choice("ab") for _ in range(rng.randrange(40))] + [rng.choice("abcd") for _ in range(rng.randrange(1, 6))] * rng.randrange(7)
        assert periodic_runs.runs_of(words, exponent, length) == plain_runs(words, exponent, length)


def test_op11_one_word_for_ever():
    assert periodic_runs.runs_of(["x"] * 30_000) == [(0, 30_000, 1)]
    assert periodic_runs.runs_of(["a", "b", "c"] * 20_000 + ["a", "z"]) == [(0, 60_001, 3)]


def plain_row(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_op11_query_by_brute_force(spark):
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    # periods of long texts are too many to try one by one
    want = {r.doc_id: plain_row(r.doc_id, r.text) for r in docs if len(r.text) < 9000}
    got = {r.doc_id: tuple(r) for r in queries.op11_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs) and sum(w[1] > 0 for w in want.values()) > 3
    assert {k: got[k] for k in want} == want


def test_op11_odd_rows(spark, odd):
    out = periodic_runs.find_runs(odd.withColumn("Runs", F.lit(1)))
    rows = out.collect()
    assert len(rows) == odd.count() and "Runs" not in out.columns and out.columns.count("runs") == 1
    for r in rows:
        words = WORD.findall(r.text or "")
        assert r.n_words == len(words) and [tuple(x) for x in r.runs] == (plain_runs(words) if len(words) < 100 else [(0, 7 * 3000, 7)])
    assert {r.collapsed for r in rows if r.n_words > 100} == {"the quick brown fox jumps over it"}
    assert periodic_runs.find_runs(odd.limit(0)).count() == 0
    planted = {r.doc_id: r.text for r in queries.with_planted_runs(odd).collect()}
    assert planted[0] is None and len(planted) == len({r.doc_id for r in rows})


def plain_search(docs, items, k):
    counts = [(i, Counter(re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    total, df = sum(sum(c.values()) for _, c in counts), Counter(t for _, c in counts for t in c)
    out = {}
    for item, text in items:
        out.setdefault(item, set()).update(re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
    rows = []
    for item, terms in out.items():
        scored = []
        for i, c in counts:
            m = 50 + 50 * sum(c.values()) * len(counts) // total
            s = sum(math.floor(1000 * math.log((2 * len(counts) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scored.append((-s, i is None, i, s))
        rows += [(item, r, i, s) for r, (_, _, i, s) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(rows, key=str)


@pytest.mark.parametrize("block, max_terms, k", [(64, 100_000, 5), (16_384, 30, 50), (7, 100_000, 3)])
def test_op12_by_brute_force(spark, block, max_terms, k):
    rng = random.Random(3)
    words = ["Über", "ÄX", "the", "THE", "a1", "b-c", "漢字", "rare", "x" * 3000] + [f"w{i}" for i in range(30)]
    docs = [(i if i != 17 else None, " ".join(rng.choices(words, k=rng.randrange(0, 60)))) for i in range(300)]
    docs += [(400 + i, "same same text") for i in range(120)] + [(900, None), (901, ""), (902, " ,;\0 "), (5, "same")]
    items = [(1, "the same TEXT"), (2, "über rare w3 w4 w5"), (3, None), (4, "unknown"), (5, "the"), (None, "rare"), (2, "w6"), (6, "")]
    docs_df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash"))
    items_df = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("clash"))
    got = impact_index.search(docs_df, items_df, k=k, block=block, max_terms=max_terms)
    assert sorted(map(tuple, got.collect()), key=str) == plain_search(docs, items, k)
    assert impact_index.search(docs_df.limit(0), items_df).count() == 0 == impact_index.search(docs_df, items_df.limit(0)).count()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**40), min_size=130, max_size=130), min_size=1, max_size=6), st.integers(1, 140))
def test_op12_carries_and_descent(columns, k):
    total, places = [], np.arange(130)
    for c in columns:
        c = np.array(c, np.int64) * (places % 3 > 0)
        for data in (impact_index._packed(places, c | 1, 3), impact_index._packed(places[:3], c[:3] + 1, 3)):
            impact_index.add_slices(total, impact_index._unpacked(data, 3))
    want = sum((np.array(c, np.int64) * (places % 3 > 0)) | 1 for c in columns)
    want[:3] += sum(np.array(c, np.int64)[:3] * (places[:3] % 3 > 0) + 1 for c in columns)
    at, values = impact_index.best_places(total, k)
    order = np.lexsort((places, -want))[:k]
    assert sorted(at) == sorted(order) and (want[at] == values).all()


def test_op13_accuracy(spark):
    sf = SF.replace("sf0.001", "sf0.1")
    got = queries.op13_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.toxic).mean() > 0.97 and held[held.toxic == 0].predicted.mean() < 0.01 and held[held.toxic == 1].predicted.mean() > 0.8


def test_op13_features_by_brute_force():
    texts = ["Abc  d!e", "", "ÄÖ1x ÄÖ", "zz" * 40, "one two   three four five six seven"]
    plain = []
    for t in texts:
        s = "\x01" + "\x01".join(re.findall(r"[^\W\d_]+", t.lower())) + "\x01"
        plain.append(len({s[i : i + n] for n in toxicity.ORDERS for i in range(len(s) - n + 1)}) if len(s) > 1 else 0)
    for piece in (toxicity.PIECE, 9):
        old, toxicity.PIECE = toxicity.PIECE, piece
        try:
            rows, features = toxicity.held_features(texts)
        finally:
            toxicity.PIECE = old
        assert np.bincount(rows, minlength=len(texts)).tolist() == plain
        if piece != 9:
            whole = (rows.tolist(), features.tolist())
    assert (rows.tolist(), features.tolist()) == whole


def test_op13_minimum():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(30, 8))
    h, b = a.T @ a + np.eye(8), rng.normal(size=8)
    x = toxicity.minimise(lambda w: (float(w @ h @ w / 2 - b @ w), h @ w - b), np.zeros(8), steps=100, enough=1e-9)
    assert np.allclose(x, np.linalg.solve(h, b), atol=1e-6)


def test_op13_odd_rows(spark, odd):
    label = "doc_id long, toxic int"
    for rows, score in (([], 0.5), ([(4, None), (None, 1)], 0.5), ([(4, 1), (5, 1)], 1.0), ([(4, 0)], 0.0)):
        model = toxicity.train(odd, spark.createDataFrame(rows, label), F.lit(True))
        assert model == score
        assert {r.score for r in toxicity.score_toxicity(odd, model).collect()} == {score}
    model = toxicity.train(odd, spark.createDataFrame([(i, i % 2) for i in range(10)] + [(4, 1)], label), F.lit(True))
    out = toxicity.score_toxicity(odd, model)
    got = out.collect()
    assert len(got) == odd.count() and "clash" not in {r.score for r in got} and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert len({r.score for r in got if r.text == "Same text here for all of us"}) == 1
    assert toxicity.score_toxicity(odd.limit(0), model).count() == 0
