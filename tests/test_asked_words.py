"""What the ranking needs of a passage is worked out once and holds only what questions can meet."""

from pyspark.sql import functions as F

from lectern.functions import references
from lectern.operators import retrieval
from test_once import times


def test_texts_are_lower_cased_once(spark):
    assert times(spark, retrieval.usability(F.col("t")), "lower") == 1
    assert times(spark, retrieval.usability(F.col("t")), "regexp_count") == 1


def test_parts_that_hold_others_go():
    assert references.least_parts(["created", "create", "form", "create"]) == ["create", "form"]


def test_passages_keep_only_words_that_questions_have(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "grace and peace and more grace"), (2, None), (3, "nothing asked here")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, ["grace", "peace", "hope"]), (2, [])], "query_id long, q_words array<string>")
    whole = retrieval.passage_features(docs)
    for most in (5_000, 2):
        monkeypatch.setattr(retrieval, "MOST_WORDS", most)
        rows = retrieval.asked_words_only(whole, asked)
        kept = {r.doc_id: (sorted(r.d_words), r.d_size) for r in rows.collect()}
        if most == 5_000:
            assert kept == {1: (["grace", "peace"], 4), 2: ([], 0), 3: ([], 3)}
        none = F.array().cast("array<string>")
        score = lambda words, n: retrieval.theme_relevance(none, none, F.col("q_words"), words, n)
        both = rows.join(whole.select("doc_id", F.col("d_words").alias("all")), "doc_id").crossJoin(asked)
        assert all(r.a == r.b for r in both.select(score(F.col("d_words"), F.col("d_size")).alias("a"), score(F.col("all"), None).alias("b")).collect())
