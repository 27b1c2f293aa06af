"""The pipeline's near copies against brute-force Jaccard over five-word shingles."""

import itertools
import random

import numpy as np
import pytest

import corpus_pipeline
from lectern.llm import near_copies


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(texts):
    """Smallest id of each component of pairs with a similarity of 0.8 or more."""
    sets, parent = {i: plain_shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        if x == y or 5 * len(x & y) >= 4 * len(x | y):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return {find(i) for i in texts}


@pytest.fixture(scope="module")
def edited():
    """Texts with 0 to 8 words exchanged, so that similarities lie on both sides of 0.8; a passage that all share."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(4000)}"
    passage, texts = [f"common{k}" for k in range(30)], [None, "", " ", "one", "One", "a b c d e", "a b c d e f"]
    for n in (12, 40, 90, 200, 400):
        for _ in range(6):
            base = [word() for _ in range(n)]
            for edits in (0, 0, 1, 2, 4, 8):
                copy = list(base)
                for at in rng.sample(range(n), edits):
                    copy[at] = word()
                texts.append(" ".join(copy + passage * (n >= 90)))
    return dict(enumerate(texts))


@pytest.mark.parametrize(("common", "few", "hubs"), [(2, 1_000, 24), (6, 0, 24), (6, 0, 0)])
def test_stage_keeps_what_brute_force_keeps(spark, edited, monkeypatch, common, few, hubs):
    monkeypatch.setattr(near_copies, "COMMON", common)
    monkeypatch.setattr(near_copies, "FEW", few)
    monkeypatch.setattr(near_copies, "HUBS", hubs)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in edited.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()]
    assert len(kept) == len(set(kept)) and set(kept) == plain_kept(edited)


def test_odd_rows(spark, odd):
    kept = near_copies.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len({frozenset(plain_shingles(r.text)) for r in odd.collect()})
    assert near_copies.keep_one(odd.limit(0)).count() == 0


def test_bounds_never_exceed_the_difference():
    rng = np.random.default_rng(1)
    for n, m, common in [(0, 1, 0), (1, 1, 1), (5, 900, 5), (60, 70, 50), (130, 129, 120), (4000, 3000, 2900)]:
        both = rng.integers(0, 2**63, n + m - common, dtype=np.uint64)
        one, two = both[:n], both[n - common :]
        assert near_copies.differing(near_copies.bitmap(one), near_copies.bitmap(two)) <= n + m - 2 * common


def test_one_large_group_emits_few_pairs(spark, monkeypatch):
    """A chain-free group of 400 copies with one word exchanged each: pairs in proportion to the group, one document kept."""
    base = [f"w{k}" for k in range(120)]
    texts = [" ".join(base[:at] + [f"x{k}"] + base[at + 1 :]) for k in range(400) for at in [k % 118]]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    seen = []
    settle = near_copies.bounded_distance
    monkeypatch.setattr(near_copies, "bounded_distance", lambda pairs, *more: seen.append(pairs.count()) or settle(pairs, *more))
    assert [r.doc_id for r in near_copies.keep_one(docs).collect()] == [0]
    assert sum(seen) < 20 * len(texts)


@pytest.mark.parametrize("k", range(5))
def test_stages_with_odd_rows(spark, odd, k):
    """Nulls, empty and very long texts, repeated rows, clashing columns, and an empty table, for each stage of the pipeline."""
    from helpers import SF

    name, stage = corpus_pipeline.STAGES[k]
    got = stage(spark, odd, SF)
    rows, ids = got.collect(), {r.doc_id for r in odd.collect()}
    assert {r.doc_id for r in rows} <= ids
    if k < 4:
        assert got.columns == corpus_pipeline.COLUMNS
    if name == "language_id":  # letterless texts go, all others are near enough to a language, and stay as often as they occur
        assert sorted(str(r.text) for r in rows) == sorted(r.text for r in odd.collect() if any(c.isalpha() for c in r.text or ""))
    if name == "line_dedup":
        assert len(rows) == odd.count() and all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
    if name == "best_fit_packing":
        assert {r.doc_id for r in rows} == ids
    assert stage(spark, odd.limit(0), SF).count() == 0


def test_stage_begins_with_fingerprints(spark, edited, monkeypatch):
    """SimHash groups are looked for first, their links are near copies, and the search beyond them starts from these."""
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in edited.items()], "doc_id long, text string, lang string, source string, n_chars long")
    given, label = [], near_copies.group_labels
    monkeypatch.setattr(near_copies, "group_labels", lambda rows, sets, settle, links=None: given.append(links.collect()) or label(rows, sets, settle, links))
    kept = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()}
    (links,) = given
    sets = {near_copies._name(s): s for s in map(near_copies.shingles, edited.values())}
    assert len(links) > 5 and kept == plain_kept(edited)
    for a, b in links:
        both = len(np.intersect1d(sets[a], sets[b]))
        assert 9 * both >= 4 * (len(sets[a]) + len(sets[b]))


def test_lists_without_a_possible_pair_go(spark):
    """Of lists that share a shingle, those whose sizes are too far apart or whose sets are one group already make no rows; sizes just within 0.8 stay."""
    rows = [(1, 10, [7]), (2, 100, [7]), (3, 40, [8]), (4, 50, [8]), (5, 60, [9]), (6, 61, [9]), (7, 80, [5]), (8, 100, [5]), (9, 1000, [5]), (10, 1, [4]), (11, 10**9, [4])]
    sets = spark.createDataFrame(rows, "sid long, n long, prefix array<long>")
    known = spark.createDataFrame([(5, 5), (6, 5), (7, 7)], "sid long, label long")
    assert sorted((r.token, r.sid, r.lab) for r in near_copies.meetings(sets, known).collect()) == [(5, 7, 7), (5, 8, 8), (5, 9, 9), (8, 3, 3), (8, 4, 4)]


def test_sizes_within_bounds_share_or_neighbour_a_band(spark):
    """Every two sizes whose ratio is 0.8 or more have one band or neighbouring ones."""
    sizes = [n for k in range(1, 30_000) for n in (4 * k, 5 * k)]
    bands = [r.b for r in spark.createDataFrame([(n,) for n in sizes], "n long").select(near_copies._band(near_copies.F.col("n")).alias("b")).collect()]
    place = [(b % 2**64).bit_length() for b in bands]
    assert all((y - x) % 64 in (0, 1) for x, y in zip(place[::2], place[1::2]))


def test_tasks_hold_few_rows_as_objects():
    """A batch is worked on in parts, however many rows Spark puts into it."""
    import pyarrow as pa

    from lectern.llm.common import slices

    batches = [pa.record_batch([pa.array(range(n))], ["x"]) for n in (0, 3, 10)]
    parts = list(slices(iter(batches), 4))
    assert [p.num_rows for p in parts] == [3, 4, 4, 2] and [x for p in parts for x in p.column(0).to_pylist()] == [*range(3), *range(10)]
