"""Scores whose value lies next to a half are rounded as the SQL rounds them, once."""

from pyspark.sql import functions as F

from lectern.functions import quality, text
from lectern.operators import corpus, evaluation, structure


def test_noise_next_to_a_half(spark):
    rows = spark.createDataFrame([("x" * 981 + "!" * 19,), ("x" * 957 + "!" * 43,)], "t string")
    assert [r[0] for r in rows.select(quality.noise_score(F.col("t"))).collect()] == [6.7, 15.1]


def test_mean_noise_next_to_a_half(spark):
    rows = spark.createDataFrame([(1, k, "w" * 100, 11.1 if k == 0 else 0.0) for k in range(48)], "doc_id long, chunk_index int, chunk string, noise double")
    assert evaluation.chunk_quality(rows, F.col("noise")).first().avg_noise == 0.2313


def test_heading_confidence_is_rounded_once(spark):
    body = [(1, "body text that is rather long and ends somewhere.", 10.0, False, 0, False)] * 5
    large = [(1, "Headings hereA12", 14.0, False, 0, True)] * 4
    spans = spark.createDataFrame(body + large, "doc_id long, text string, size double, bold boolean, page int, is_block_top boolean")
    shares = [r.c for r in structure.page_headings(spans).select(text.rounded(F.col("confidence"), 2).alias("c")).collect()]
    # 13 letters of 16 at strength 0.8: a value just below 0.745
    assert shares == [0.74] * 4


def test_reference_over_a_chunks_end(spark):
    reg = spark.createDataFrame([("d1", "2 kings notes.txt", 3)], "document_id string, source_file string, chunk_count int")
    t = "See 2 Kings 19:4-6. x"
    texts = spark.createDataFrame([("2 kings notes.txt", k, t[7 * k : 7 * k + 7], t[7 * k + 7 :]) for k in range(3)], "source_file string, chunk_index int, chunk string, ahead string")
    rows = corpus.chunk_rows(reg, texts, spark.createDataFrame([], "source_file string, text string"))
    got = {r.chunk_index: (r.content, r.chapter, r.verse_start, r.verse_end, r.confidence, r.candidates) for r in corpus.passages(reg.drop("chunk_count"), rows).collect()}
    assert got == {0: ("See 2 K", 19, 4, 6, 1.0, 2), 1: ("ings 19", None, None, None, None, None), 2: (":4-6. x", None, None, None, None, None)}
