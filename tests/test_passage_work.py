"""What a passage's text costs: names share their beginnings, a seam is searched once, and a whole text is judged once for all of its chunks."""

import random
import re

import pandas as pd
from helpers import SF
from pyspark.sql import functions as F

from lectern import lexicon
from lectern.functions import quality, references
from lectern.operators import corpus
from lectern.plans import extended


def test_whole_texts_are_judged_once(spark, monkeypatch):
    judged = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def counted(texts: pd.Series) -> pd.Series:
        judged.add(len(texts))
        return texts.map(lambda t: "NORMAL_CONTENT")

    monkeypatch.setattr(quality, "noise_type", counted)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text <> ''")
    want = docs.selectExpr("sum(if(doc_id % 5 = 0, 1, doc_id % 4 + 1)) AS texts", "sum(doc_id % 4 + 1) AS passages").first()
    rows = extended.passage_records(spark, SF).toPandas()
    assert (judged.value, len(rows)) == (want.texts, want.passages) and want.texts < want.passages


def test_each_text_is_shuffled_once(spark):
    """Chunks' texts and whole texts go to their documents; nothing else moves them, not even the registry where it is too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = extended.passage_records(spark, SF)
        plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [re.findall(r"(\w+)#", columns) for columns in re.findall(r"\) Exchange\nInput[^:]*: \[(.*)\]", plan)]
    assert len(moved) > 5 and sorted(c for columns in moved for c in columns if c in ("text", "whole", "chunk", "content")) == ["chunk", "chunk"]


def test_a_seam_is_searched_once(spark):
    rows = spark.createDataFrame([("a", "b")], "t string, ahead string").select(references.cut_reference(F.col("t"), F.col("ahead")).alias("x"))
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert plan.lower().count("regexp_extract(") + plan.count("RLIKE(") == 1


def test_names_share_beginnings():
    rng = random.Random(3)
    for _ in range(200):
        names = {"".join(rng.choices("ab. 1", k=rng.randrange(1, 5))) for _ in range(rng.randrange(1, 9))}
        plain = "|".join(map(re.escape, sorted(names, key=lambda n: (-len(n), n))))
        text = "".join(rng.choices("ab. 1", k=60))
        assert re.findall(references.one_of(names), text) == re.findall(plain, text)
    assert references.one_of([]) == "" and re.fullmatch(references.one_of(["", "ab"]), "")


def test_references_over_seams_by_brute_force(spark):
    rng, names = random.Random(4), [*lexicon.NAME_TO_BOOK, "rom", "요", "고후"]
    rows = []
    for k in range(300):
        ref = rng.choice(names).title() + rng.choice(["", " ", "\n", " " * 20]) + f"{rng.choice([1, 23, 123456789])}:{rng.choice([4, 56])}" + rng.choice(["", "-7", "-"])
        at = rng.randrange(len(ref) + 1)
        rows.append((k, rng.choice(["", "word 3:4 ", "x" * 90]) + ref[:at], ref[at:] + rng.choice(["", " and 5:6", "." * 90])))
    rows += [(300, None, "1:2"), (301, "Romans", None), (302, "Romans 8", ":3"), (303, "Romans 8:3", "4"), (304, "Romans 8:3", "-4"), (305, "Romans 8:3", "")]
    every = "|".join(sorted({*lexicon.NAME_TO_BOOK, *lexicon.ALIAS_TO_BOOK}, key=lambda n: (-len(n), n)))
    whole = re.compile(rf"(?i)(?:{every})\s*[0-9]{{1,9}}:[0-9]{{1,9}}(?:-[0-9]{{1,9}})?")

    def wanted(text, ahead):
        if text is None:
            return ""
        head, ahead = text[-references.LONGEST :], (ahead or "")[: references.LONGEST]
        for at in range(len(head)):
            found = whole.match(head + ahead, at)
            if found and found.end() > len(head):
                return ahead[: found.end() - len(head)]
        return ""

    got = spark.createDataFrame(rows, "k int, t string, ahead string").select("k", references.cut_reference(F.col("t"), F.col("ahead")).alias("cut")).collect()
    assert {r.k: r.cut for r in got} == {k: wanted(t, a) for k, t, a in rows}


def test_odd_texts_have_their_types(spark):
    texts = {
        "\n".join(["a title" + " " * 50 + "here"] * 2): "NORMAL_CONTENT",  # its lines are short once blanks are joined, not before
        "a title\nwith a line": "HEADER_FOOTER",
        "\x85 NASA　and words ": "ABBREVIATION",
        "xNASA NASAx " + "word " * 20 + ".": "NORMAL_CONTENT",
        "אב text of a line that is no title, as it ends.": "NORMAL_CONTENT",
        "אבג": "ORIGINAL_LANGUAGE",
        "Page\u000b12": "PAGE_NUMBER",
        "see (Smith x1999) and so on, at length.": "NORMAL_CONTENT",
        "see (Smith, 1999) and so on, at length.": "BIBLIOGRAPHY",
        "é!¹_" * 9 + "!?" * 9: "OCR_FRAGMENT",
    }
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", quality.noise_type(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == texts
    assert spark.range(1).select(quality.caps_density(F.lit("ABC de ABCDEFG FG_ XY, Z ÉAB")).alias("x")).first().x == 2 / 7


def test_rows_of_both_forms_give_the_same_passages(spark):
    reg = spark.createDataFrame([("d1", "romans.md", 3), ("d2", "plain.md", 2), ("d3", None, 1), ("d4", "none.md", 0)], "document_id string, source_file string, chunk_count int")
    texts = spark.createDataFrame([("romans.md", 0, "Romans 8:1"), ("romans.md", 1, None), ("other.md", 0, "no document")], "source_file string, chunk_index int, chunk string")
    whole = spark.createDataFrame([("plain.md", "Mark 1:2"), ("romans.md", "not used")], "source_file string, text string")
    by_text, by_chunk = corpus.chunk_texts(reg, texts, whole), corpus.chunk_rows(reg, texts, whole)
    assert sorted((r.document_id, r.chunk_index, r.content) for r in by_chunk.collect()) == [("d1", 0, "Romans 8:1"), ("d1", 1, ""), ("d1", 2, ""), ("d2", 0, "Mark 1:2"), ("d2", 1, "Mark 1:2"), ("d3", 0, "")]
    assert by_text.count() == 5
    rows = [sorted(map(tuple, corpus.passages(reg, x.withColumn("n", F.length("content"))).drop("source_file", "title", "author", "language", "source_type").fillna("-").fillna(-1).collect())) for x in (by_text, by_chunk)]
    assert rows[0] == rows[1] and [r[-1] for r in rows[0]] == [10, 0, 0, 8, 8, 0]
