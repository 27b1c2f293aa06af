"""Values that are themselves worked out are worked out once, however often an expression looks at them."""

from pyspark.sql import functions as F

from lectern.functions import chunk, text


def times(spark, column, name):
    """How often ``name`` stands in the plan of ``column``."""
    rows = spark.createDataFrame([("a\fb",)], "t string").select(column.alias("x"))
    return rows._jdf.queryExecution().analyzed().toString().count(f"{name}(")


def test_windows_look_at_one_text(spark):
    assert times(spark, chunk.structure_chunks(F.initcap("t")), "initcap") == 1
    assert times(spark, chunk.fixed_windows(F.initcap("t")), "initcap") == 1


def test_front_pages_are_cut_and_judged_once(spark):
    assert times(spark, text.split_front_pages(F.col("t")), "split") == 2  # the text into pages, a page into lines


def test_front_pages_of_odd_texts(spark):
    short = "\f".join(["a"] * 20)
    rows = [(0, None), (1, ""), (2, "no page"), (3, "\f"), (4, "Copyright\fISBN"), (5, "Copyright\fA body of a page that is long\fPreface"), (6, short)]
    got = spark.createDataFrame(rows, "k int, t string").select("k", text.split_front_pages(F.col("t")).alias("p")).select("k", "p.front", "p.body").orderBy("k").collect()
    assert [(r.front, r.body) for r in got] == [
        ("", ""), ("", ""), ("", "no page"), ("", ""), ("Copyright", "ISBN"), ("Copyright\n\nPreface", "A body of a page that is long"), ("\n\n".join("a" * 15), "\n\n".join("a" * 5)),
    ]
