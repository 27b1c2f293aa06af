"""Paged files and copies."""

import hashlib

import pytest

from lectern.operators import structure
from lectern.sources import copies, paged, readers

HAND = rb"""%PDF-1.4
1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj
2 0 obj <</Type/Pages/Kids[3 0 R 2 0 R]/Resources<</Font<</A 5 0 R /B 6 0 R>>>>>> endobj
3 0 obj <</Type/Page/Contents[4 0 R]>> endobj
4 0 obj <</Length 9>> stream
q 2 0 0 2 0 0 cm BI /W 1 ID (( EI BT /A 6 Tf 14 TL 10 300 Td (Hel\(lo) Tj 40 0 Td [(wor) -20 (ld) -300 (x)] TJ T* /B 6 Tf (caf\351) Tj (b) ' ET Q
BT /B 10 Tf 1 0 0 1 0 100 Tm <41 4> Tj ET
endstream endobj
5 0 obj <</BaseFont/Times-Bold>> endobj
6 0 obj <</BaseFont/Times>> endobj
trailer <</Root 1 0 R /Info <</Author (Me \050x\051)>>>> startxref
"""


def test_lines_of_a_file_written_by_hand():
    """Scales, escapes, placed anew on one line, inline images, a tree that leads back to itself."""
    assert list(paged.lines_of(HAND)) == [(0, "Hel(lo world x", 12.0, True, True), (0, "café", 12.0, False, False), (0, "b", 12.0, False, False), (0, "A@", 10.0, False, True)]
    assert paged.page_properties(HAND) == (None, "Me (x)")


@pytest.mark.parametrize("text", ["", "\n\n", "a", "제목 😀\n# Bold (one)\n\n<<x>> \\ )", "\n".join(f"line {k} " + "x" * (k % 90) for k in range(1000))])
def test_written_and_read_back(text):
    rows = list(paged.lines_of(paged.paged_bytes(text, 7, title="책 (하나)")))
    want = [(k // 7, x.removeprefix("# ").strip(), 14.0 if x.startswith("# ") else 10.0, x.startswith("# ")) for k, x in enumerate(text.split("\n")) if x.strip()]
    assert [r[:4] for r in rows] == want
    assert paged.page_properties(paged.paged_bytes(text, title="책 (하나)")) == ("책 (하나)", None)


def test_packed_objects_and_filters():
    import base64
    import zlib

    inner = b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]>>", b"<</Type/Page/Contents 4 0 R>>"
    heads = " ".join(f"{k} {sum(len(x) + 1 for x in inner[: k - 1])}" for k in (1, 2, 3)).encode() + b" "
    packed = zlib.compress(heads + b" ".join(inner))
    shown = base64.a85encode(zlib.compress(b"BT /F 9 Tf (deep) Tj ET")) + b"~>"
    raw = b"%%PDF-1.5\n9 0 obj <</Type/ObjStm/N 3/First %d/Filter/FlateDecode>> stream\n%s\nendstream endobj\n" % (len(heads), packed)
    raw += b"4 0 obj <</Filter[/A85 /Fl]>> stream\n" + shown + b"\nendstream endobj\n8 0 obj <</Type/XRef/Root 1 0 R>> stream\n\nendstream endobj\n"
    assert [x[1] for x in paged.lines_of(raw)] == ["deep"]
    with pytest.raises(ValueError, match="filter /DCTDecode"):
        list(paged.lines_of(raw.replace(b"[/A85 /Fl]", b"/DCTDecode")))
    with pytest.raises(ValueError, match="encrypted"):
        paged.PagedFile(raw.replace(b"/Root 1", b"/Encrypt 5 0 R/Root 1"))


def test_damaged_files_keep_a_row_and_spans_give_headings(spark, tmp_path):
    body = "\n".join(("# Chapter heading" if k % 10 == 0 else f"an ordinary line of the book, number {k}, long enough to be body text") for k in range(60))
    good = paged.paged_bytes(body, title="T")
    for name, raw in {"a.pdf": good, "b.pdf": b"no pages", "c.pdf": good[: len(good) // 2], "d.PDF": paged.paged_bytes(""), "e.txt": b"text"}.items():
        (tmp_path / name).write_bytes(raw)
    spans = paged.page_spans(spark, str(tmp_path)).cache()
    problems = {r.path.split("/")[-1]: r.problem for r in spans.where("problem IS NOT NULL").collect()}
    assert set(problems) == {"b.pdf", "c.pdf", "d.PDF"} and problems["b.pdf"] == "ValueError: not a paged file" and problems["d.PDF"] == "no text"
    lines = spans.where("problem IS NULL").withColumnRenamed("path", "doc_id")
    row = structure.page_profile(lines).first()
    assert (row.body, row.size_hits, row.signal) == (10.0, 6, "size")
    assert structure.page_headings(lines).count() == 6
    files = readers.scan_directory(spark, str(tmp_path), content=True)
    texts = {r.name: r.text for r in readers.extract_text(files, paged.first_readable(paged.page_text, lambda raw: "other")).collect()}
    assert texts["a.pdf"].count(paged.PAGE_BREAK) == 1 and texts["b.pdf"] == "other" and texts["e.txt"] == "text"
    assert {r.name: r.title for r in readers.embedded_metadata(files).collect()}["a.pdf"] == "T"


def test_copies_are_whole_or_absent(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    (source / "deep").mkdir(parents=True)
    target.mkdir()
    wanted = {"a.txt": b"one", "b.bin": bytes(range(256)) * 1000, "c.md": b"\n", "한글.md": b"x"}
    for k, (name, raw) in enumerate(wanted.items()):
        (source / ("deep" if k % 2 else "") / name).write_bytes(raw)
    scan = lambda: readers.scan_directory(spark, str(source), ("txt", "bin", "md"), recursive=True, content=True)
    files = scan()
    for _ in range(2):  # a second copy replaces the first
        rows = copies.copy_files(files, str(target)).collect()
        assert {r.name: (r.size, r.sha256, r.same) for r in rows} == {n: (len(x), hashlib.sha256(x).hexdigest(), True) for n, x in wanted.items()}
        assert sorted(p.name for p in target.iterdir()) == sorted(wanted)
    assert copies.copy_files(readers.scan_directory(spark, str(target), content=True), str(target)).count() == 0
    (source / "deep" / "a.txt").write_bytes(b"two")
    with pytest.raises(ValueError, match="a.txt"):
        copies.copy_files(scan(), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_a_task_that_dies_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(copies.FileCopies)
    from pyspark.sql import functions as F

    @F.udf("binary")
    def dies(k):
        if k == 30:
            raise RuntimeError("killed")
        return b"x"

    rows = spark.range(0, 40, 1, 4).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), dies("id").alias("content"))
    with pytest.raises(Exception, match="killed"):
        rows.write.format("file_copies").mode("append").save(str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or not list((tmp_path / "out").iterdir())
    with pytest.raises(Exception, match="nothing in it is deleted"):
        rows.write.format("file_copies").mode("overwrite").save(str(tmp_path / "out"))
