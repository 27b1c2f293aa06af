import pytest
from pyspark.sql import functions as F

from lectern.functions import chunk, quality, references, text


def one(spark, value, *columns):
    row = spark.createDataFrame([(value,)], "t string").select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


@pytest.fixture(autouse=True, scope="module")
def column(spark):
    global T
    T = F.col("t")


def test_cleanup(spark):
    assert one(spark, "a\r\nb\t\tc\xa0 d\n\n\n\ne  ", text.normalise_basic(T)) == "a\nb c d\n\ne"
    assert one(spark, "exam-\nple and", text.normalise_extracted(T)) == "example and"
    assert one(spark, "T he m em bers", text.repair_word_splits(T)).startswith("The")
    assert one(spark, "body\n 12 \nPage 3\nmore", text.clean_paged(T)) == "body\n\nmore"
    assert one(spark, None, text.normalise_basic(T)) == ""


def test_tokens_and_keywords(spark):
    assert one(spark, "Well-known, it's A  test.", text.tokens(T)) == ["wellknown", "its", "a", "test"]
    assert one(spark, "What does the Grace of grace mean for éabc x", text.keywords(T)) == ["grace", "mean"]
    assert one(spark, None, text.keywords(T)) == []


def test_identity(spark):
    a = one(spark, "x\r\ny\n\n\n\nz ", text.document_id(T, F.lit("s")))
    assert a == one(spark, " x\ny\n\nz", text.document_id(T, F.lit("s"))) and len(a) == 32
    assert one(spark, "  ", text.document_id(T, F.lit("s"))) == "empty_s"
    assert one(spark, a, text.chunk_id(T, F.lit(7))) == f"{a}_chunk_00007"


def test_markup(spark):
    assert [tuple(h) for h in one(spark, "# One #\ntext\n### Three\n####### no", text.headings(T))] == [(1, "One"), (3, "Three")]
    assert one(spark, "intro\n# A\nx\n## B\ny", text.sections(T)) == ["intro", "# A\nx", "## B\ny"]
    assert one(spark, "---\ntitle: A: b\nlang: en\n---\nbody", text.front_matter(T)) == {"title": "A: b", "lang": "en"}
    assert one(spark, "<head><title>no</title></head><p>a &amp; b</p><script>x()</script>c", text.strip_tags(T)) == "a & b\nc"
    assert one(spark, "My file (1).pdf", text.safe_stem(T)) == "My_file_1_"
    assert one(spark, "x", text.size_text(F.lit(1536))) == "1.5 KB"


def test_front_pages(spark):
    long = "This is body prose. " * 40
    front, body = one(spark, f"Copyright 1990\f{long}\fPreface\f{long}", text.split_front_pages(T))
    assert front == "Copyright 1990\n\nPreface" and body == f"{long.strip()}\n\n{long.strip()}"
    assert tuple(one(spark, "Copyright\fISBN", text.split_front_pages(T))) == ("Copyright", "ISBN")
    assert tuple(one(spark, "no pages", text.split_front_pages(T))) == ("", "no pages")
    assert one(spark, f"{long}\f이 책의 인쇄 장소", text.split_front_pages(T))[0] == "이 책의 인쇄 장소"


def test_paged_leftovers(spark):
    value = "\ue000fulfil-\nment of\nthe law.\nNext\nline\n  l \nT he m em bers\x01\u200bof 교회\n를 위한 \f page"
    got = one(spark, value, text.postprocess_paged(T))
    assert "fulfilmentofthe law.\n\nNext line" in got and "교회를 위한" in got and "\f" in got and "\ue000" not in got and "\x01" not in got
    assert one(spark, "한글", text.nfc(T)) == "한글" and one(spark, None, text.nfc(T)) is None
    assert [one(spark, 70.0, f(F.lit(s))) for s, f in ((70.0, quality.noise_level), (16.0, quality.noise_level), (61.0, quality.noise_label), (3.0, quality.noise_label))] == ["high", "low", "high", "good"]


@pytest.mark.parametrize(
    "value, kind",
    [("", "PAGE_NUMBER"), (None, "PAGE_NUMBER"), (" Page 12 ", "PAGE_NUMBER"), ("as shown (Dillard, 1987) in full sentences here.", "BIBLIOGRAPHY"), ("KHAT Kurzer KVHS Korte ABC", "ABBREVIATION"),
     ("#$%^&*@! #$%^ &*()#$% ^&*", "OCR_FRAGMENT"), ("A short title\nby someone", "HEADER_FOOTER"), ("A whole sentence stands here, and it ends.", "NORMAL_CONTENT"), ("בראשית ברא", "ORIGINAL_LANGUAGE")],
)
def test_noise_types(spark, value, kind):
    assert one(spark, value, quality.noise_type(T)) == kind
    assert one(spark, kind, quality.noise_policy(T)["policy"]) == quality.NOISE_TYPES[kind][0]


def test_noise_and_language(spark):
    assert one(spark, "", quality.noise_score(T)) == 100.0
    assert one(spark, "Clean words in a plain line without marks", quality.noise_score(T)) == 3.0
    for kind in ("pdf", "html", "other"):
        assert 3.0 <= one(spark, "Line one ends\nline two!!! ends.\n12\nx", quality.noise_score(T, kind, True)) <= 100.0
    assert [one(spark, v, quality.script_language(T)) for v in ("안녕하세요 world", "こんにちは", "中文文本", "שלום", "λόγος", "plain", "", None)] == ["ko", "ja", "zh", "he", "el", "en", "en", "en"]


def test_references(spark):
    refs = one(spark, "see Genesis 1:2-3 and 1 John 4:8, Prov 3:5", references.references(T))
    assert [tuple(r) for r in refs] == [("GEN", 1, 2, 3), ("1JN", 4, 8, None), ("PRO", 3, 5, None)]
    assert [r.book_id for r in one(spark, "2 John 1:5", references.passage_references(T))] == ["JHN"]
    assert [tuple(r) for r in one(spark, "Romans 8, Romans 8 and Mark 2:1", references.chapter_references(T))] == [("ROM", 8, 0, None)]
    assert one(spark, "Explain grace", references.intent(T)) == "exegesis"
    assert one(spark, "covenant", references.intent(T)) == "theological" and one(spark, "xyz", references.intent(T)) == "unknown"
    assert one(spark, "asking of mercy", references.themes(T)) == ["mercy", "kingdom"]
    best = one(spark, "Mark 99:1, Romans 8:1-2 and Romans 8:5", references.evidence(references.references(T), F.lit("ROM")))
    assert best.score == 1.0 and best.ref.verse_start == 1
    assert one(spark, "no reference", references.evidence(references.references(T), F.lit("ROM"))) is None
    assert one(spark, "1 Samuel and Luke, actually", references.names_in(T)) == ["LUK", "ACT"] and one(spark, "요한복음을 읽고", references.names_in(T)) == ["JHN"]
    assert one(spark, "First Samuel and Second Kings, 3John", references.books_of_question(T)) == ["3JN", "2KI", "1SA"]
    both = one(spark, "Rom5:3 and John 3:16-17", references.question_references(T))
    assert [tuple(r) for r in both] == [("JHN", 3, 16, 17), ("ROM", 5, 3, None), ("JHN", 3, 16, 17)]
    parsed = one(spark, "Explain 1 Kings 8 and Romans 5:3 on mercy", references.parse(T))
    assert parsed.intent == "exegesis" and parsed.books == ["ROM", "1KI"] and [tuple(r) for r in parsed.refs] == [("ROM", 5, 3, None), ("1KI", 8, 0, None)] and parsed.themes[0] == "mercy"
    assert one(spark, "Genesis 2:1", references.evidence(references.references(T), F.lit("GEN"))).score == 0.4  # no limit is known for this book
    assert one(spark, None, references.reference_text(F.lit("GEN"), F.lit(1), F.lit(0), F.lit(None).cast("int"))) == "GEN 1"


def test_windows(spark):
    value = "word " * 500
    pieces = one(spark, value, chunk.fixed_windows(T, 100, 10, 20))
    want, start = [], 0
    while start < len(value):
        p = value[start : start + 100]
        if start + 100 < len(value) and p.rfind(" ") > 50:
            p = p[: p.rfind(" ")]
        if len(p.strip()) >= 20:
            want.append(p.strip())
        start += 90
    assert pieces == want
    assert one(spark, None, chunk.fixed_windows(T)) == [] and one(spark, "", chunk.fixed_windows(T)) == []
    parts = one(spark, "# A\n" + "x" * 60 + "\n# B\n" + "y" * 60, chunk.structure_chunks(T))
    assert [p[:3] for p in parts] == ["# A", "# B"]
    assert one(spark, "One is here. Two is here. Three is here.", chunk.sentence_chunks(T, 25, 5)) == ["One is here.\n\nTwo is here.", "Three is here."]


def test_paragraph_chunks():
    paragraph = "A sentence of some length stands here and goes on. " * 4
    whole = "\n\n".join(f"{k} {paragraph}" for k in range(12))
    chunks = chunk.paragraph_chunks_of(whole, 600, 60, 80)
    assert all(80 <= len(c) <= 600 for c in chunks) and all(f"{k} A sentence" in " ".join(chunks) for k in range(12))
    assert chunk.paragraph_chunks_of("short", 600, 60, 80) == [] and chunk.paragraph_chunks_of(None) == []
    long = chunk.paragraph_chunks_of("word " * 1000, 300, 30, 80)
    assert max(map(len, long)) <= 300 + 80 and " ".join(long).split() == ["word"] * 1000
    assert chunk.hard_slices("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]
    assert chunk.word_tail("one two three", 8) == "three" and chunk.word_tail("abcdefghij", 4) == ""
    assert chunk.paragraphs_of("a line\nwraps on\n\nnext") == ["a line wraps on", "next"]
    assert chunk.sentences_of("- first\n\n- second\n\nplain words\n\nend here.") == ["- first", "- second", "plain words end here."]


def test_recursive_chunks_and_reflow(spark):
    body = "\n\n".join(" ".join(f"word{k}{j}" for j in range(30)) + "." for k in range(8))
    got = chunk.recursive_chunks_of(body, 300, 40, 20)
    assert max(map(len, got)) <= 300 and all(w in " ".join(got) for w in body.split())
    assert chunk.recursive_chunks_of("x" * 700, 300, 0, 20) == ["x" * 300, "x" * 300, "x" * 100] and chunk.recursive_chunks_of(None) == []
    assert chunk.reflow_of("a line\nwraps here.\n\nnext") == "a line wraps here.\n\nnext" and chunk.reflow_of(" ") == " "
    by = [one(spark, "One is here. " * 40, chunk.chunks_by(kind, T, 200, 20)) for kind in ("fixed", "semantic", "structure", "other")]
    assert by[0] == by[2] == by[3] and by[0] != by[1] and all(len(c) <= 200 for c in by[0])
    assert one(spark, body, F.size(chunk.recursive_chunks(300, 40, 20)(T))) == len(got) and one(spark, "a\nb", chunk.reflow(T)) == "a b"


PARSED = {
    "Mt 5:3": (["MAT"], [("MAT", 5, 3, None)]),
    "Jn 3:16 and 1 Cor 13:4": (["JHN", "1CO"], [("JHN", 3, 16, None), ("1CO", 13, 4, None)]),
    "Phil 4:13": (["PHP"], [("PHP", 4, 13, None)]),
    "롬 8:28": (["ROM"], [("ROM", 8, 28, None)]),
    "요3:16": (["JHN"], [("JHN", 3, 16, None)]),
    "필요3:16": ([], []),
    "누가복음 2장": (["LUK"], [("LUK", 2, 0, None)]),
    "로마서 8장 28절": (["ROM"], [("ROM", 8, 28, 28)]),
    "요한복음 3장 16절": (["JHN"], [("JHN", 3, 16, 16)]),
    "롬 8장과 Romans 8": (["ROM"], [("ROM", 8, 0, None)]),
    "Romans 8:28 and Romans 8": (["ROM"], [("ROM", 8, 28, None)]),
    "마가복음은 무엇인가": (["MRK"], []),
    "이것이 필요한가": ([], []),
    "에스 라": (["EZR", "EST"], []),
    "II Peter": (["1PE", "2PE"], []),
    "1 King and 2 Corinthian": (["1KI", "2CO"], []),
    "First Thessalonian": (["1TH"], []),
    "데살로니가전서": (["1TH"], []),
    "아가서": (["SOT"], []),
    "romance of the market": (["MRK", "ROM"], []),
    "Song of Solomon": (["SOL"], []),
    "": ([], []),
}


def test_names_of_all_kinds(spark):
    rows = spark.createDataFrame([(t,) for t in PARSED] + [(None,)], "t string").select("t", references.parse(F.col("t")).alias("p")).collect()
    got = {r.t: (r.p.books, [tuple(x) for x in r.p.refs]) for r in rows}
    assert got == PARSED | {None: ([], [])}


def test_longest_claim_is_global():
    from lectern.functions import names

    find = names.finder((("a b", "SHORT"), ("b c d", "LONG"), ("c d", "INSIDE"), ("x", "X"), ("b c d", "LATER")))
    assert find.claimed("a b c d") == ["LONG"] and find.claimed("a b cd x") == ["SHORT", "X"] and find.claimed("ax") == []
    assert find.longest("zzab c dz") == "LONG" and find.longest("") is None and names.finder(()).claimed("a b") == []


def test_names_by_brute_force():
    import random

    from lectern.functions import names

    rng = random.Random(5)
    for _ in range(300):
        pairs = tuple((" ".join("".join(rng.choices("ab", k=rng.randrange(1, 3))) for _ in range(rng.randrange(1, 4))), f"c{k % 4}") for k in range(8))
        text = " ".join("".join(rng.choices("ab", k=rng.randrange(1, 4))) for _ in range(12))
        taken, found = set(), []
        for name, code in sorted(dict(reversed(pairs)).items(), key=lambda p: (-len(p[0]), [n for n, _ in pairs].index(p[0]))):
            for at in range(len(text)):
                own = set(range(at, at + len(name)))
                if text.startswith(name, at) and (at == 0 or text[at - 1] == " ") and not own & taken:
                    taken |= own
                    if code not in found:
                        found.append(code)
        assert names.finder(pairs).claimed(text) == found
