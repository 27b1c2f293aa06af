from lectern import lexicon
from lectern.functions import references
from pyspark.sql import functions as F

FAR = "word " * 60


def test_references_are_found_beside_their_colons(spark):
    texts = [
        None, "", "no colon Romans 8", "Romans 8:3", FAR + "Romans 8:3" + FAR, FAR + "Rom 1:2 John 3:4-5" + FAR + "1:2" + FAR + "First: Rom5:3", FAR + "Romans" + " " * 200 + "8:3 " + FAR, FAR + "xRom 5:3, yRom5:3 " + FAR, "Romans 8:1" + FAR + "5:3",
        FAR + "Mark" + "\n" * 45 + "123456789:4-999999999" + FAR, FAR + "Mark 1234567890:4" + FAR, FAR + "2" + " John 3:4" + FAR, "a:" * 50 + FAR + ":Acts 1:2:3", FAR + "요3:16" + FAR + "고린도후서 2:4 \U0001f600" + FAR, "8:3 " + FAR + "Rom", "Romans " + FAR + "8:3",
    ]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    c = F.col("t")
    whole = lambda names, blanks, before: rf"(?i){before}({'|'.join(sorted(names, key=lambda n: (-len(n), n)))})\s{blanks}([0-9]{{1,9}}):([0-9]{{1,9}})(?:-([0-9]{{1,9}}))?"
    for names, pattern in ((lexicon.NAME_TO_BOOK, whole(lexicon.NAME_TO_BOOK, "+", "")), (lexicon.ALIAS_TO_BOOK, whole(lexicon.ALIAS_TO_BOOK, "*", r"(?<![\p{L}\p{N}_])"))):
        found = lambda x: F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(pattern), F.lit(0))
        near = references.near_colons(c, names)
        for r in rows.select("k", found(c).alias("want"), found(near).alias("got"), F.length(near).alias("n")).collect():
            assert r.got == r.want, texts[r.k]
            assert r.k != 4 or r.n < len(texts[4]) / 2
