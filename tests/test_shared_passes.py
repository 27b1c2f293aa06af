"""Steps that several results look at run once, and cheaper passes give the same rows."""

from helpers import SF
from lectern.functions import quality, text
from lectern.plans.queries import QUERIES
from pyspark.sql import functions as F

ODD = [
    None, "", " \t\r\n", "a", "12\n\nPage 7\nreal line here\n", "PAGE 7\nx\n--\n", "T he m em bers of to be or not to be so x", "x  to be  of it", "A to be or, to be b e f ore", "hyphen-\nated wor-\n  ds", "!!!!\n\n\n\n????....", "||| ~~~ ¦¦ ^^ ·· →→\n\n###\nend",
    "a\x0bb\x0cc\x1cd e\x85f\rg\r\nh", "\U00010400 T he \U00010400A bc", "한국어 문장이다. T he\n1\n12\n١٢\n", "tab\tand\ttabs\n\n\n\n\nlast @@@@ ####",
]


def test_noise_scores_are_the_single_scores(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "k int, t string")
    c, cut = F.col("t"), F.lit(0.25)
    single = [quality.noise_score(c, kind, scan, cut) for kind, scan in (("pdf", False), ("pdf", True), ("html", False), ("", False))]
    for r in rows.select("k", quality.noise_scores(c, cut).alias("n"), F.array(*single).alias("want")).collect():
        assert [r.n.pdf, r.n.scan, r.n.rich, r.n.other] == r.want, ODD[r.k]


def test_word_splits_in_one_pass(spark):
    one = F.col("t")
    old = F.regexp_replace(one, rf"(?<![{text.WORD}])([A-Z]) ([a-z]{{2,}})(?![{text.WORD}])", "$1$2")
    old = F.regexp_replace(old, rf"(?<![{text.WORD}])([b-hj-z]) ([a-z]{{1,2}})(?![{text.WORD}])", "$1$2")
    for _ in range(5):
        old = F.regexp_replace(old, r"(?<=[a-z]) ([a-z]{1,3})(?= [a-z])", "$1")
    rows = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("text").alias("t")).union(spark.createDataFrame([(t,) for t in ODD], "t string"))
    assert rows.where(~text.repair_word_splits(one).eqNullSafe(old)).count() == 0


def test_a_paged_text_is_normalised_once(spark):
    plan = QUERIES["noise_score_paged"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"[ \x{00A0}]+") == 1
