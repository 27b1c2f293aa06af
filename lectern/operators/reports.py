"""Small aggregates over corpora, caches, gold sets and runs: one table each."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern import lexicon
from lectern.functions import chunk, tables
from lectern.functions.references import themes
from lectern.operators import retrieval
from lectern.operators.retrieval import top


def confidence_coverage(passages: DataFrame) -> DataFrame:
    """One row: passages with and without evidence, and its mean."""
    return passages.agg(F.count("confidence").alias("with_confidence"), (F.count("*") - F.count("confidence")).alias("without"), F.coalesce(F.round(F.avg("confidence"), 4), F.lit(0.0)).alias("mean"))


def completeness(ranked: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows, and for each column the share that is not null."""
    return ranked.agg(F.count("*").alias("rows"), *[F.when(F.count("*") > 0, F.round(F.count(c) / F.count("*"), 6)).otherwise(0.0).alias(c) for c in columns])


def chapter_density(passages: DataFrame) -> DataFrame:
    return passages.where(F.col("book_id").isNotNull() & F.col("chapter").isNotNull()).groupBy("book_id", "chapter").agg(F.count("*").alias("n"))


def select_chapters(density: DataFrame, least: int = 3, limits: dict[str, int] | None = None) -> DataFrame:
    """``density`` with ``canonical`` (a chapter that the book has) and ``selected`` (dense enough as well)."""
    last = F.create_map(*[F.lit(x) for pair in (limits or lexicon.CHAPTERS).items() for x in pair])
    canonical = F.coalesce(F.col("chapter").between(1, last[F.col("book_id")]), F.lit(False))
    return density.withColumn("canonical", canonical).withColumn("selected", F.col("canonical") & (F.col("n") >= least))


def gold_issues(gold: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """``id, issue`` of gold questions (id, question, book_id, chapter) with an unknown book, an impossible chapter or the words of an earlier one."""
    last = F.create_map(*[F.lit(x) for pair in (limits or lexicon.CHAPTERS).items() for x in pair])
    first = gold.groupBy(F.col("question").alias("__question")).agg(F.min("id").alias("__first"))
    joined = gold.join(first, F.col("question").eqNullSafe(F.col("__question")))
    found = F.array(
        F.when(last[F.col("book_id")].isNull(), "book"),
        F.when(~F.coalesce(F.col("chapter").between(1, last[F.col("book_id")]), F.lit(False)), "chapter"),
        F.when(F.col("id") != F.col("__first"), "duplicate"),
    )
    return joined.select("id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("issue"))


def eligible(gold: DataFrame) -> DataFrame:
    """Gold questions that say what they expect."""
    return gold.where(F.col("question").isNotNull() & (F.col("question") != "") & F.col("book_id").isNotNull())


def theme_summary(ranked: DataFrame, docs: DataFrame, most: int = 3, themes_of: dict[str, list[str]] | None = None) -> DataFrame:
    """``query_id, themes``: the commonest themes of each question's first ``most`` results, the lexicon's order among equals."""
    order = F.create_map(*[F.lit(x) for k, name in enumerate(themes_of or lexicon.THEMES) for x in (name, k)])
    first = ranked.where(F.col("rank") <= most).join(docs.select("doc_id", themes(F.col("text"), themes_of).alias("__t")), "doc_id")
    # first seen: by the rank that shows a theme first, then by the lexicon
    shown = first.select("query_id", "rank", F.explode("__t").alias("theme")).groupBy("query_id", "theme").agg(F.count("*").alias("n"), F.min("rank").alias("at"))
    chosen = top(shown.withColumn("k", order[F.col("theme")]), most, ["query_id"], F.desc("n"), F.col("at"), F.col("k"), name="place")
    return chosen.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "theme"))).alias("x")).select("query_id", F.col("x.theme").alias("themes"))


def explanation(bm25: Column, vector: Column, domain: Column, confidence: Column) -> Column:
    """How a hybrid score came about, in words."""
    adjust = 0.9 + 0.1 * confidence
    base = 0.30 * bm25 + 0.25 * vector + 0.45 * domain
    # ties are rounded to even, which the format alone would not
    return F.format_string(
        "bm25=%.3f×0.30=%.3f | vector=%.3f×0.25=%.3f | theological=%.3f×0.45=%.3f | base=%.3f × evidence_adj=%.3f | total=%.3f",
        *[F.bround(x, 3) for x in (bm25, 0.30 * bm25, vector, 0.25 * vector, domain, 0.45 * domain, base, adjust, base * adjust)],
    )


def response(ranked: DataFrame, cited: DataFrame, summary: DataFrame, asked: DataFrame) -> DataFrame:
    """One package per question: its text, results, citations (at most ``k`` each) and themes; a question without results has empty lists."""
    packed = lambda df, name, *fields: df.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", *fields))).alias(name))
    rows = asked.select("query_id", "question").join(packed(ranked, "results", "doc_id", "final"), "query_id", "left").join(packed(cited, "citations", "doc_id", "source", "excerpt"), "query_id", "left").join(summary, "query_id", "left")
    return rows.withColumns({c: F.coalesce(F.col(c), F.array()) for c in ("results", "citations", "themes")})


def answer(docs: DataFrame, questions: DataFrame, k: int = 10, **options) -> DataFrame:
    """The response package of every question, straight from documents: ranking, citations, themes. ``options`` go to ``rank_hybrid``."""
    ranked = retrieval.rank_hybrid(docs, questions, k, **options)
    return response(ranked, retrieval.citations(ranked, docs), theme_summary(ranked, docs), questions)


def compare_chunking(docs: DataFrame, strategies: dict[str, tuple[str, int, int]] | None = None, text: str = "text") -> DataFrame:
    """Per strategy: chunks, mean length, and the share of documents that give any."""
    rows = None
    for name, (kind, size, overlap) in (strategies or chunk.STRATEGIES).items():
        own = docs.select(F.lit(name).alias("strategy"), chunk.chunks_by(kind, F.col(text), size, overlap).alias("chunks"))
        rows = own if rows is None else rows.unionByName(own)
    length = F.aggregate("chunks", F.lit(0).cast("long"), lambda n, c: n + F.length(c))
    sums = rows.groupBy("strategy").agg(F.count("*").alias("docs"), F.sum(F.size("chunks")).alias("chunks"), F.sum(length).alias("characters"), F.count(F.when(F.size("chunks") > 0, 1)).alias("some"))
    return sums.select("strategy", "docs", "chunks", F.when(F.col("chunks") > 0, F.round(F.col("characters") / F.col("chunks"), 2)).alias("mean_length"), F.round(F.col("some") / F.col("docs"), 6).alias("covered"))


MOST_CELLS = 1_000


def strategy_grid(docs: DataFrame, grid: list[tuple[str, int, int]], by: str, text: str = "text", short: int = 80) -> DataFrame:
    """``by, strategy, size, overlap, chunks, mean_length, short_ratio, best`` of every cell of a grid of chunk strategies (see ``tables.CHUNKERS``).

    The grid's rows stand beside each document, which is read once for all of them. The best cell of each kind of document has the
    smallest share of chunks under ``short`` characters, then the fewest chunks, then comes first by name, size and overlap. Null and
    blank texts have no chunks; a kind without any chunk has no best cell. A grid has at most ``MOST_CELLS`` cells.
    """
    if len(set(grid)) > MOST_CELLS:
        raise ValueError(f"a grid of more than {MOST_CELLS} cells")
    chunkers = {name: tables.known(tables.CHUNKERS, name) for name, _, _ in grid}

    @F.arrow_udf("struct<chunks: bigint, characters: bigint, short: bigint>")
    def measured(texts: pa.Array, names: pa.Array, sizes: pa.Array, overlaps: pa.Array) -> pa.Array:
        rows = []
        for t, name, size, overlap in zip(*(c.to_pylist() for c in (texts, names, sizes, overlaps))):
            lengths = [len(c) for c in chunkers[name](t, size, overlap)] if t and t.strip() else []
            rows.append({"chunks": len(lengths), "characters": sum(lengths), "short": sum(n < short for n in lengths)})
        return pa.array(rows, pa.struct([(n, pa.int64()) for n in ("chunks", "characters", "short")]))

    cells = F.array(*[F.struct(F.lit(s).alias("strategy"), F.lit(n).alias("size"), F.lit(o).alias("overlap")) for s, n, o in sorted(set(grid))])
    beside = docs.select(F.col(by).alias(by), F.col(text).alias("__text"), F.explode(cells).alias("cell")).select(by, "__text", "cell.*")
    sums = beside.select(by, "strategy", "size", "overlap", measured("__text", "strategy", "size", "overlap").alias("m")).groupBy(by, "strategy", "size", "overlap").agg(*[F.sum(f"m.{n}").alias(n) for n in ("chunks", "characters", "short")])
    some = F.col("chunks") > 0
    ratio = F.when(some, F.round(F.col("short") / F.col("chunks"), 6))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.asc_nulls_last("short_ratio"), "chunks", "strategy", "size", "overlap"))
    rows = sums.select(by, "strategy", "size", "overlap", "chunks", F.when(some, F.round(F.col("characters") / F.col("chunks"), 4)).alias("mean_length"), ratio.alias("short_ratio"))
    return rows.withColumn("best", (place == 1) & F.col("short_ratio").isNotNull())


def shares(df: DataFrame, by: str) -> DataFrame:
    """``by, n, percent`` of all rows."""
    counts = df.groupBy(by).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("__all")))).select(by, "n", F.round(100.0 * F.col("n") / F.col("__all"), 2).alias("percent"))  # one row


def file_groups(files: DataFrame) -> DataFrame:
    """Files (name, length) by kind: how many and how large."""
    kind = F.when(F.lower("name").endswith(".md"), "md").when(F.col("name").endswith("_chunks.txt"), "chunks").otherwise("other")
    return files.groupBy(kind.alias("kind")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def index_size(files: DataFrame) -> DataFrame:
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count("*").alias("files"), F.max("modificationTime").alias("newest"))


def progress(rows: DataFrame, value: str = "progress") -> DataFrame:
    return rows.agg(F.count("*").alias("items"), F.count(F.when(F.col(value) >= 100, 1)).alias("finished"), F.round(F.avg(value), 2).alias("mean"))


def session_latency(log: DataFrame, newest: int = 200, at: str = "ts", latency: str = "latency_ms") -> DataFrame:
    """Mean latency of the ``newest`` queries (the feature's own limit)."""
    return log.orderBy(F.desc(at)).limit(newest).agg(F.count("*").alias("queries"), F.round(F.avg(latency), 3).alias("mean_ms"))


def chunk_stats(lengths: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """Least, upper median and greatest length per group; a group's lengths are counted first, so equal ones are one row."""
    counts = lengths.groupBy(*by, n).agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(*by).orderBy(n))
    every = F.sum("__c").over(Window.partitionBy(*by))
    placed = counts.withColumns({"__upto": upto, "__all": every})
    # the value at place n // 2 from 0
    return placed.groupBy(*by).agg(F.min(n).alias("least"), F.min(F.when(F.col("__upto") > F.floor(F.col("__all") / 2), F.col(n))).alias("median"), F.max(n).alias("most"))


def best_parameters(scores: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The one row of a parameter grid that is least by ``order``, then by its parameters."""
    return scores.orderBy(*order, *keys).limit(1)


def versions_and_failures(versions: DataFrame, failures: DataFrame) -> DataFrame:
    """Everything known of each source file: its versions, its failures, or both."""
    return versions.join(failures, "source_file", "full")


def health(passages: DataFrame, registry: DataFrame, cache: DataFrame) -> DataFrame:
    """``check, value, ok``: passages, documents, documents without passages, passages without a known document, cached vectors."""
    have = passages.select("document_id").distinct()
    row = lambda name, df, good: df.agg(F.count("*").alias("value")).select(F.lit(name).alias("check"), "value", good(F.col("value")).alias("ok"))
    some, none = (lambda v: v > 0), (lambda v: v == 0)
    out = row("passages", passages, some).unionByName(row("documents", registry, some)).unionByName(row("documents_without_passages", registry.join(have, "document_id", "left_anti"), none))
    return out.unionByName(row("passages_without_document", passages.join(registry.select("document_id").distinct(), "document_id", "left_anti"), none)).unionByName(row("cached_vectors", cache, some))


def stale(current: DataFrame, remembered: str | None) -> bool:
    """Whether a table's manifest (one row) has another digest than the one remembered."""
    row = current.select(F.concat_ws("-", "digest_xor", "digest_sum")).first()
    return row is None or row[0] != remembered
