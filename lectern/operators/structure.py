"""Headings over chunks, fonts of paged text, boundary candidates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import chunk, references
from lectern.functions.quality import BOUNDARY_LEAST, boundary_score
from lectern.functions.text import lines, strip


def heading_paths(marked: DataFrame, doc: str = "doc_id", order: str = "at") -> DataFrame:
    """``marked`` (doc, order, level, title; level null for plain chunks) with ``path`` and ``depth``.

    A heading of level L is in force while no later heading of level up to L has come. For
    each level the last heading is carried forward by a window; it counts if it is
    newer than the last heading of every smaller level.
    """
    line = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(F.when(F.col("level") == n, F.struct(F.col(order).alias("at"), F.col("title"))), True).over(line).alias(f"__h{n}") for n in range(1, 7)]
    rows = marked.select("*", *last)
    valid = []
    for n in range(1, 7):
        newer = [F.coalesce(F.col(f"__h{n}.at") > F.col(f"__h{m}.at"), F.lit(True)) for m in range(1, n)]
        on = F.col(f"__h{n}").isNotNull()
        for c in newer:
            on = on & c
        valid.append(F.when(on, F.col(f"__h{n}.title")))
    path = F.filter(F.array(*valid), lambda t: t.isNotNull())
    return rows.withColumn("path", path).withColumn("depth", F.size("path")).drop(*[f"__h{n}" for n in range(1, 7)])


LOOKAHEAD = 5
LEAST_HEADING = 2
# What makes a line of paged text a heading.
LETTERS, MOST_LETTERS, LEAST_RATIO, LARGER, LEAST_HITS = "[가-힣A-Za-z]", 80, 0.6, 1.15, 3


def plain_line(text: str | None) -> str:
    """A line as headings and chunks are compared: without number signs, with breaks and blanks joined."""
    return "\n\n".join(chunk.paragraphs_of(re.sub(r"^#{1,6}[ \t]+", "", (text or "").strip())))


def first_contained(titles: list[str], line: str) -> int | None:
    """Which of the titles stands in ``line`` as whole words, the first one that does."""
    return next((k for k, t in enumerate(titles) if t and re.search(rf"(?<!\w){re.escape(t)}(?!\w)", line)), None)


def assign_headings(chunks: DataFrame, headings: DataFrame) -> DataFrame:
    """``doc_id, chunk_index, path, depth, level``: known headings matched to chunks in order.

    A cursor over the document's headings looks for the next ``LOOKAHEAD`` titles in each line of a chunk and moves
    behind the first that stands there; found headings form a stack that a heading of the same or a smaller level
    cuts back. Headings and chunks of one document come as one ordered stream, headings first, so that a row is
    held once: only the titles of the document at hand stay in memory.
    """
    stream = headings.select("doc_id", F.lit(0).alias("kind"), F.col("at").cast("long").alias("at"), F.col("title").alias("text"), F.col("level").cast("int").alias("level"))
    stream = stream.unionByName(chunks.select("doc_id", F.lit(1).alias("kind"), F.col("chunk_index").cast("long").alias("at"), F.col("chunk").alias("text"), F.lit(None).cast("int").alias("level")))
    ordered = stream.repartition("doc_id").sortWithinPartitions("doc_id", "kind", "at")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, known, stack, cursor = object(), [], [], 0
        for batch in batches:
            out: list[tuple] = []
            for owner, kind, at, text, level in zip(*(c.to_pylist() for c in batch.columns)):
                if owner != doc:
                    doc, known, stack, cursor = owner, [], [], 0
                if kind == 0:
                    if len((text or "").strip()) >= LEAST_HEADING:
                        known.append((level, text, plain_line(text)))
                    continue
                for line in (text or "").splitlines():
                    step = first_contained([h[2] for h in known[cursor : cursor + LOOKAHEAD]], plain_line(line)) if cursor < len(known) else None
                    if step is not None:
                        own = known[cursor + step]
                        cursor += step + 1
                        stack = [h for h in stack if h[0] < own[0]] + [own]
                out.append((owner, at, [h[1] for h in stack], len(stack), stack[-1][0] if stack else None))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.int32()))], ["doc_id", "chunk_index", "path", "depth", "level"])

    return ordered.mapInArrow(fold, "doc_id long, chunk_index int, path array<string>, depth int, level int")


def heading_source(source_type: Column) -> Column:
    """Which kind of headings a source type has: number signs in text, spans in paged files, none elsewhere."""
    kind = F.lower(source_type)
    return F.when(kind.isin("md", "txt"), "atx").when(kind == "pdf", "spans").otherwise("none")


def letter_ratio(c: Column) -> Column:
    text = strip(F.coalesce(c, F.lit("")))
    return F.when(F.length(text) > 0, F.regexp_count(text, F.lit(LETTERS)) / F.greatest(F.length(text), F.lit(1))).otherwise(0.0)


def page_profile(spans: DataFrame) -> DataFrame:
    """Per document of ``spans`` (doc_id, text, size, bold, page, is_block_top): the body size, how many lines are plausible
    headings by size and by weight, and the ``signal`` that has more (null below ``LEAST_HITS``).

    The body size is that of most characters, among equals the one on the earliest page.
    """
    lines = spans.where(F.col("text") != "")
    sizes = lines.groupBy("doc_id", "size").agg(F.sum(F.length("text")).alias("n"), F.min("page").alias("page"))
    body = sizes.groupBy("doc_id").agg(F.max_by("size", F.struct("n", -F.col("page"), -F.col("size"))).alias("body"))
    plausible = (F.length("text") < MOST_LETTERS) & (letter_ratio(F.col("text")) >= LEAST_RATIO)
    hits = lambda on: F.count(F.when(plausible & on, 1))
    counted = lines.join(body, "doc_id").groupBy("doc_id").agg(F.first("body").alias("body"), hits(F.col("size") > F.col("body") * LARGER).alias("size_hits"), hits(F.col("bold") & (F.col("size") == F.col("body"))).alias("bold_hits"))
    signal = F.when(F.greatest("size_hits", "bold_hits") < LEAST_HITS, F.lit(None).cast("string")).when(F.col("bold_hits") >= F.col("size_hits"), "bold").otherwise("size")
    return counted.withColumn("signal", signal)


def page_headings(spans: DataFrame) -> DataFrame:
    """Spans that are headings by their document's signal, with ``signal``, ``validity`` and ``confidence`` 0 to 1."""
    own = spans.where(F.col("text") != "").join(page_profile(spans), "doc_id").where(F.col("signal").isNotNull())
    validity, n = letter_ratio(F.col("text")), F.length("text")
    by_size = F.col("signal") == "size"
    on = F.when(by_size, F.col("size") > F.col("body") * LARGER).otherwise(F.col("bold") & (F.col("size") == F.col("body")))
    strength = F.when(by_size, F.when(F.col("body") > 0, F.greatest(F.lit(0.0), F.least((F.col("size") / F.col("body") - 1.0) / 0.5, F.lit(1.0)))).otherwise(0.0)).otherwise(0.8)
    bonus = F.when((n < 40) & F.col("is_block_top"), 0.02).when((n < 40) | F.col("is_block_top"), 0.01).otherwise(0.0)
    # not rounded: who shows it in fewer places rounds once
    sure = F.greatest(F.lit(0.0), F.least(0.5 * strength + 0.4 * F.col("validity") + bonus, F.lit(1.0)))
    fits = own.withColumn("validity", validity).where((n < MOST_LETTERS) & (F.col("validity") >= LEAST_RATIO) & on)
    return fits.withColumn("confidence", sure).withColumn("validity", F.round("validity", 4)).select(*spans.columns, "signal", "validity", "confidence")


HEAD = 50


def boundary_features(text: Column, heading: Column | None = None, least: int = chunk.LEAST) -> dict[str, Column]:
    """The boolean features of a candidate boundary: its text, and whether it holds the next heading."""
    plain = strip(F.coalesce(text, F.lit("")))
    every = lines(plain)
    last = F.when(F.size(every) > 0, F.element_at(every, -1)).otherwise("")
    return {
        "heading": F.coalesce(heading, F.lit(False)) if heading is not None else F.lit(False),
        "paragraph": plain != "",
        "tiny": F.length(plain) < least,
        "sentence_end": last.rlike(chunk.SENTENCE_MARK.pattern) | last.rlike(chunk.KOREAN_END.pattern),
        "reference": F.size(references.question_references(F.substring(plain, 1, HEAD))) > 0,
    }


def boundary_candidates(paragraphs: DataFrame, text: str = "text", heading: str | None = None, least: float = BOUNDARY_LEAST) -> DataFrame:
    """``paragraphs`` with ``score`` and ``is_boundary``; ``heading`` names a boolean column, where headings are known."""
    score = boundary_score(boundary_features(F.col(text), F.col(heading) if heading else None))
    return paragraphs.withColumn("score", score).withColumn("is_boundary", F.col("score") >= least)


#: A boundary longer than this was probably not cut where it should have been.
SUSPICIOUS = 300


def boundary_density(scored: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``doc, matched, candidates, percent`` of scored candidates (``is_boundary``)."""
    counts = scored.groupBy(doc).agg(F.count(F.when(F.col("is_boundary"), 1)).alias("matched"), F.count("*").alias("candidates"))
    return counts.withColumn("percent", F.round(100.0 * F.col("matched") / F.col("candidates"), 2))


def suspicious_boundaries(scored: DataFrame, text: str = "text", most: int = SUSPICIOUS) -> DataFrame:
    """Scored candidates that count as boundaries although longer than ``most``, with their ``n`` characters and a ``preview`` of 80 on one line."""
    found = scored.where(F.col("is_boundary") & (F.length(text) > most))
    return found.withColumns({"n": F.length(text), "preview": F.translate(F.substring(text, 1, 80), "\n", " ")}).drop(text)


CAP = int(chunk.SIZE * 1.5)


def structured_chunks(docs: DataFrame, headings: DataFrame, text: str = "text", size: int = chunk.SIZE, least: int = chunk.LEAST) -> DataFrame:
    """Per document: ``paragraphs``, ``boundaries`` (offsets), ``chunks`` of the hierarchical builder and ``existing`` ones' offsets.

    A document's headings (title, in order) are one short list; a document is one row.
    """
    titles = headings.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "title"))).alias("hs"))
    rows = docs.select("doc_id", F.col(text).alias("text")).join(titles, "doc_id", "left").select("doc_id", "text", F.col("hs.title").alias("titles"))
    spot = pa.list_(pa.struct([("text", pa.string()), ("at", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, known in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                paragraphs = chunk.candidates_of(value)
                found = chunk.boundaries_of(paragraphs, [plain_line(t) for t in known or []], first_contained, least)
                own = chunk.hierarchical_chunks_of(paragraphs, found, size, least)
                whole = "\n\n".join(p for p, _ in paragraphs)
                old = chunk.offsets_in(whole, chunk.paragraph_chunks_of(value, size))
                outliers = sum(len(p) > CAP and len(chunk.sentences_of(p)) < 2 for p, _ in paragraphs)
                out.append(([{"text": p, "at": k} for p, k in paragraphs], [k for (_, k), on in zip(paragraphs, found) if on], [{"text": c, "at": k} for c, k in own], old, outliers))
            columns = list(zip(*out)) or [()] * 5
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, t) for c, t in zip(columns, (spot, ints, spot, ints, pa.int32()))], ["doc_id", "paragraphs", "boundaries", "chunks", "existing", "outliers"])

    spots = "array<struct<text:string,at:int>>"
    return rows.mapInArrow(run, f"doc_id long, paragraphs {spots}, boundaries array<int>, chunks {spots}, existing array<int>, outliers int")


def structure_metrics(structured: DataFrame, tolerance: int = 50) -> DataFrame:
    """Per profile (B if a document has an overlong paragraph, else A): how many boundaries that the existing chunks miss
    the hierarchical ones recover, the share of chunks that begin at a boundary, and of paragraphs that cannot be split."""
    starts = F.transform("chunks", lambda c: c["at"])
    beyond = lambda b, targets: F.coalesce(F.array_min(F.transform(targets, lambda t: F.abs(t - b))), F.lit(10**9)) > tolerance
    missed = F.filter("boundaries", lambda b: beyond(b, F.col("existing")))
    rows = structured.select(
        F.when(F.exists("paragraphs", lambda p: F.length(p["text"]) > CAP), "B").otherwise("A").alias("profile"), missed.alias("missed"), starts.alias("starts"), "boundaries", F.size("chunks").alias("chunks"), F.size("paragraphs").alias("paragraphs"), "outliers"
    ).withColumns({"recovered": F.size(F.filter("missed", lambda b: ~beyond(b, F.col("starts")))), "semantic": F.size(F.filter("starts", lambda s: F.array_contains("boundaries", s)))})
    total = lambda c: F.sum(c).cast("long")
    sums = rows.groupBy("profile").agg(F.count("*").alias("docs"), total(F.size("missed")).alias("missed"), total("recovered").alias("recovered"), total("chunks").alias("chunks"), total("semantic").alias("semantic"), total("paragraphs").alias("paragraphs"), total("outliers").alias("outliers"))
    rate = lambda part, whole: F.when(F.col(whole) > 0, F.round(F.col(part) / F.col(whole), 6)).otherwise(0.0)
    return sums.withColumns({"recovery_rate": rate("recovered", "missed"), "semantic_ratio": rate("semantic", "chunks"), "outlier_ratio": rate("outliers", "paragraphs")})
