"""From registered documents and their chunks to the passages that are searched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import lexicon
from lectern.functions import quality, references
from lectern.functions.names import books_claimed, longest_name
from lectern.functions.text import chunk_id, nfc, strip
from lectern.operators import structure

UNKNOWN = "UNK"
# States of a document on its way to the index.
PIPELINE_STATES = ("NEW", "IDENTIFIED", "EXTRACTED", "PROCESSED", "TSU_READY", "INDEXED", "FAILED")


def book_of_file(name: Column, names: dict[str, str] | None = None) -> Column:
    """The book that a file is named after: the longest name of at least two characters in it, null without one."""
    return longest_name(F.lower(nfc(name)), None if names is None else list(names.items()))


def document_type(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.rlike("commentary|anchor|manual|technical"), "technical").when(low.rlike("law|legal|contract|covenant"), "legal").otherwise("general")


def chunk_texts(registry: DataFrame, texts: DataFrame, whole: DataFrame) -> DataFrame:
    """``document_id, chunk_indexes, content`` of registered documents with chunks: each chunk's text, else the whole document's once for all of its chunks.

    ``registry``: document_id, source_file, chunk_count; ``texts``: source_file, chunk_index, chunk and, where known, ``ahead``
    (what follows the chunk in its document), which is handed on; ``whole``: source_file, text.
    A document with any chunk text takes no whole text: what lies beyond it is empty. Each text is shuffled once, as it is settled before
    texts are joined whether a document has chunk texts.
    """
    wanted = registry.where(F.col("chunk_count") > 0).select("document_id", "source_file", "chunk_count")
    known = texts.select("source_file").distinct()
    every = F.sequence(F.lit(0), F.col("chunk_count") - 1)
    ahead = {"ahead": F.lit(None).cast("string")} if "ahead" in texts.columns else {}
    in_parts = wanted.join(known, "source_file", "left_semi").select("document_id", "source_file", F.explode(every).alias("chunk_index")).join(texts.select("source_file", "chunk_index", "chunk", *ahead), ["source_file", "chunk_index"], "left")
    as_whole = wanted.join(known, "source_file", "left_anti").join(whole.select("source_file", F.col("text").alias("chunk")), "source_file", "left").withColumns(ahead)
    rows = lambda found, indexes: found.select("document_id", indexes.alias("chunk_indexes"), F.coalesce("chunk", F.lit("")).alias("content"), *ahead)
    return rows(in_parts, F.array("chunk_index")).unionByName(rows(as_whole, every))


def chunk_rows(registry: DataFrame, texts: DataFrame, whole: DataFrame) -> DataFrame:
    """``chunk_texts`` with a row for each chunk, its ``chunk_index`` in place of all."""
    found = chunk_texts(registry, texts, whole)
    return found.select("document_id", F.explode("chunk_indexes").alias("chunk_index"), *[c for c in found.columns if c not in ("document_id", "chunk_indexes")])


def passages(registry: DataFrame, rows: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """One record per chunk: identifiers, book, chapter and verses with their evidence, noise class, headings.

    ``registry``: document_id, source_file and, where known, book, title, author, language, source_type; ``rows`` as of
    ``chunk_texts`` or ``chunk_rows``, where a reference that runs over a chunk's end into ``ahead`` counts for the chunk in which it begins; further
    columns are handed on; ``paths``: document_id, chunk_index, path, depth of paged documents. Elsewhere the text's own headings count.
    What follows from contents is worked out before chunks are told apart and the registry is joined: once for a whole text, and contents that nobody takes are not shuffled.
    """
    more = [c for c in rows.columns if c not in ("document_id", "chunk_index", "chunk_indexes", "content", "ahead")]
    about = registry
    for name in ("book", "title", "author", "language", "source_type"):
        if name not in about.columns:
            about = about.withColumn(name, F.lit(None).cast("string"))
    about = about.select("document_id", "source_file", "title", "author", "language", "source_type", F.coalesce("book", book_of_file(F.col("source_file")), F.lit(UNKNOWN)).alias("book_id"))
    content = F.col("content")
    read = F.concat(content, references.cut_reference(content, F.col("ahead"))) if "ahead" in rows.columns else content
    found = rows.withColumns({"refs": references.question_references(read), "noise": quality.noise_type(content)})
    index = F.explode("chunk_indexes").alias("chunk_index") if "chunk_indexes" in rows.columns else "chunk_index"
    own = found.select("document_id", index, "content", "refs", "noise", *more).join(about, "document_id")
    known = F.col("book_id") != UNKNOWN
    best = F.when(known, references.evidence(F.col("refs"), F.col("book_id")))
    own = own.withColumns({"best": best, "chunk_id": chunk_id(F.col("document_id"), F.col("chunk_index"))})
    ref = F.col("best.ref")
    verse = ref["verse_start"] > 0
    record = own.select(
        F.concat(F.lit("TSU-"), "book_id", F.lit("-"), "chunk_id").alias("tsu_id"), "document_id", "chunk_id", "chunk_index", "content", F.when(known, F.col("book_id")).alias("book_id"), ref["chapter"].alias("chapter"),
        F.when(verse, ref["verse_start"]).alias("verse_start"), F.when(verse, ref["verse_end"]).alias("verse_end"), F.col("best.score").alias("confidence"), F.when(known & (F.size("refs") > 0), F.size("refs")).alias("candidates"),
        "title", "author", "source_file", "language", "source_type", F.col("noise").alias("noise_type"), quality.noise_policy(F.col("noise"))["quality_score"].alias("quality_score"), quality.noise_policy(F.col("noise"))["section_type"].alias("section_type"), *more,
    )
    if paths is None:
        return record
    return record.join(paths.select("document_id", "chunk_index", F.col("path").alias("heading_path"), F.col("depth").alias("heading_depth")), ["document_id", "chunk_index"], "left")


def atx_paths(rows: DataFrame) -> DataFrame:
    """``document_id, chunk_index, path, depth`` by the number-sign headings in the chunks of ``chunk_rows`` themselves."""
    from lectern.functions.text import headings

    found = rows.select("document_id", "chunk_index", F.posexplode_outer(headings(F.col("content"))).alias("at", "h")).select("document_id", F.struct("chunk_index", F.coalesce("at", F.lit(-1)).alias("at")).alias("at"), F.col("h.level").alias("level"), F.col("h.title").alias("title"), "chunk_index")
    placed = structure.heading_paths(found, "document_id", "at")
    return placed.groupBy("document_id", "chunk_index").agg(F.max_by(F.struct("path", "depth"), "at").alias("p")).select("document_id", "chunk_index", "p.path", "p.depth")


# Patterns of book names in file names and titles, in the order in which they are tried.
BOOK_RULES = [
    (r"마태복음", "MAT"), (r"로마서", "ROM"), (r"고린도후서|고린도전", "2CO"), (r"1\s*kings?", "1KI"), (r"2\s*kings?", "2KI"), (r"1\s*chronicles?", "1CH"), (r"2\s*chronicles?", "2CH"), (r"1\s*peter", "1PE"), (r"2\s*peter", "2PE"),
    (r"1\s*thessalonians?", "1TH"), (r"2\s*thessalonians?", "2TH"), (r"1\s*corinthians?|1\s*코린트", "1CO"), (r"2\s*corinthians?|2\s*코린트", "2CO"), (r"romans?", "ROM"), (r"mathew?|matthew?", "MAT"), (r"john|요한|יוחנן", "JHN"),
]


def book_by_rules(c: Column, rules: list[tuple[str, str]] = BOOK_RULES) -> Column:
    """The book of the first rule whose pattern the lower-cased text shows, null without one."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.coalesce(*[F.when(low.rlike(pattern), code) for pattern, code in rules], F.lit(None).cast("string"))


def repair_books(records: DataFrame, rules: list[tuple[str, str]] = BOOK_RULES, text: str = "content", head: int | None = None) -> DataFrame:
    """``records`` (tsu_id, source_file, title, book_id and ``text``) with ``new_book``, ``decided_by`` and ``new_id``.

    A file's book is that of the first rule its title and name show; else the one that most of its passages name first (by full or
    longer names; of equally many the first in canonical order); else the one it had; else unknown. Votes are counted by file and book before files are
    compared, so a file with a third of all passages is not gathered. ``head`` limits a vote to a passage's first characters.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    named = F.get(books_claimed(content if head is None else F.substring(content, 1, head)), 0)
    place = F.create_map(*[F.lit(x) for pair in zip(lexicon.BOOKS, range(len(lexicon.BOOKS))) for x in pair])
    votes = records.select("source_file", named.alias("voted")).where(F.col("voted").isNotNull()).groupBy("source_file", "voted").agg(F.count("*").alias("n"))
    won = votes.groupBy("source_file").agg(F.min_by("voted", F.struct(-F.col("n"), place[F.col("voted")])).alias("voted"))
    ruled = records.withColumn("__rule", book_by_rules(F.concat_ws(" ", "title", "source_file"), rules))
    joined = ruled.alias("r").join(won.alias("w"), F.col("r.source_file") == F.col("w.source_file"), "left").select("r.*", F.col("w.voted").alias("__vote"))
    kept = F.when(F.col("book_id") != UNKNOWN, F.col("book_id"))
    joined = joined.withColumns({
        "new_book": F.coalesce("__rule", "__vote", kept, F.lit(UNKNOWN)),
        "decided_by": F.when(F.col("__rule").isNotNull(), "rule").when(F.col("__vote").isNotNull(), "vote").when(kept.isNotNull(), "record").otherwise("none"),
    })
    return joined.withColumn("new_id", rebuilt_id(F.col("tsu_id"), F.col("new_book"))).drop("__rule", "__vote")


def rebuilt_id(tsu_id: Column, book: Column) -> Column:
    """A passage's identifier with another book."""
    return F.concat(F.lit("TSU-"), book, F.lit("-"), F.regexp_extract(tsu_id, "^TSU-[^-]*-(.*)$", 1))


def validate_chunks(chunks: DataFrame, declared: DataFrame, doc: str = "doc_id", text: str = "chunk", least: int = 80) -> DataFrame:
    """Per document: chunks, empty and short ones, and whether they are ``valid`` (none empty, as many as ``declared`` (doc, chunks))."""
    plain = strip(F.coalesce(F.col(text), F.lit("")))
    counts = chunks.groupBy(doc).agg(F.count("*").alias("total"), F.count(F.when(plain == "", 1)).alias("empty"), F.count(F.when((plain != "") & (F.length(plain) < least), 1)).alias("short"))
    joined = declared.select(doc, F.col("chunks").alias("declared")).join(counts, doc, "left").fillna(0, ["total", "empty", "short"])
    return joined.withColumn("valid", (F.col("total") > 0) & (F.col("empty") == 0) & (F.col("total") == F.col("declared")))


def worth_indexing(chunks: DataFrame, noise: Column, text: str = "chunk", least: int = 80, most_noise: float = 60.0) -> DataFrame:
    """Chunks that are long and clean enough."""
    return chunks.where((F.length(strip(F.coalesce(F.col(text), F.lit("")))) >= least) & (noise < most_noise))


def oversized(c: Column, most: int = 1800) -> Column:
    """Whether a text is estimated (two characters a token) to be too long for the embedding service."""
    return F.floor(F.length(c) / 2) > most


def set_state(registry: DataFrame, keys: DataFrame, state: str) -> DataFrame:
    """``registry`` with ``pipeline_state`` of the documents in ``keys`` set; an unknown state raises."""
    if state not in PIPELINE_STATES:
        raise ValueError(f"invalid pipeline state {state!r}")
    marked = registry.join(keys.select("document_id").distinct().withColumn("__now", F.lit(True)), "document_id", "left")
    return marked.withColumn("pipeline_state", F.when(F.col("__now"), state).otherwise(F.col("pipeline_state"))).drop("__now")


def transition(registry: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``registry`` after ``outcomes`` (document_id, status, reason): a success clears failures, a failure counts one more try."""
    joined = registry.join(outcomes.groupBy("document_id").agg(F.max(F.struct("status", "reason")).alias("__o")), "document_id", "left")
    status = F.col("__o.status")
    tries = F.coalesce("retry_count", F.lit(0))
    reason = F.col("last_failure_reason") if "last_failure_reason" in registry.columns else F.lit(None).cast("string")
    return joined.withColumns({
        "ingest_status": F.coalesce(status, F.col("ingest_status")),
        "retry_count": F.when(status == "PROCESSED", 0).when(status == "FAILED", tries + 1).otherwise(tries),
        "last_failure_reason": F.when(status == "PROCESSED", F.lit(None).cast("string")).when(status == "FAILED", F.col("__o.reason")).otherwise(reason),
    }).drop("__o")


def retry_due(failures: DataFrame, now: Column, base: float = 2.0, most: int = 3) -> DataFrame:
    """Failed documents (document_id, retry_count, failed_at) that may be tried again: fewer than ``most`` tries, each wait twice the last."""
    wait = base * F.pow(F.lit(2.0), F.col("retry_count"))
    return failures.where((F.col("retry_count") < most) & (F.unix_micros(now) / 1e6 >= F.unix_micros("failed_at") / 1e6 + wait))
