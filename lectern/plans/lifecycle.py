"""Registered queries on the life of documents: table functions, budget batches, reconciliation, versions, repaired books."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern import lexicon
from lectern.functions import tables
from lectern.operators import batches, corpus, registry
from lectern.plans.extended import CLAIM_MAP, CLAIMS, CODES, NAMES, pick, sql_pick
from lectern.plans.queries import documents, query


@query("SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, length(c) AS n, md5(c) AS digest FROM (SELECT doc_id, i, text[i + 1:i + 1000] AS c FROM (SELECT doc_id, text, unnest(range(0, greatest(1, length(text) - 120), 880)) AS i FROM documents WHERE trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''))")
def chunk_by_name(spark, sf_dir):
    """Chunks of every document by a strategy that SQL names."""
    tables.register(spark)
    documents(spark, sf_dir).select("doc_id", "text").createOrReplaceTempView("lectern_documents")
    return spark.sql("SELECT d.doc_id, c.chunk_index, length(c.chunk) AS n, md5(c.chunk) AS digest FROM lectern_documents d, LATERAL chunk(d.text, 'windows', 1000, 120) c")


@query(
    """WITH RECURSIVE s AS (SELECT doc_id, greatest(1, length(coalesce(text, '')) // 2) AS n, row_number() OVER (ORDER BY doc_id) AS rn FROM documents),
f(rn, fill, batch) AS (SELECT rn, n, CAST(0 AS BIGINT) FROM s WHERE rn = 1 UNION ALL SELECT s.rn, CASE WHEN f.fill + s.n > 1600 THEN s.n ELSE f.fill + s.n END, f.batch + CASE WHEN f.fill + s.n > 1600 THEN 1 ELSE 0 END FROM f JOIN s ON s.rn = f.rn + 1)
SELECT s.doc_id, s.n AS tokens, f.batch FROM s JOIN f ON f.rn = s.rn"""
)
def token_batches(spark, sf_dir):
    """Documents in order of their ids, in batches of at most 1600 estimated tokens for an embedding service."""
    rows = documents(spark, sf_dir).select("doc_id", batches.estimated_tokens(F.col("text")).alias("tokens"))
    # ranges of a hundredth of the default, so that the hand-over takes part at the smallest size as well
    return batches.budget_batches(rows, "doc_id", F.col("tokens"), rows_a_range=500)


STATES = ["PROCESSED", "INDEXED", "FAILED", "INDEXED", "NEW", "PROCESSED", "INDEXED"]


def _snapshots(spark, sf_dir):
    """Registry, chunks and index of the documents: states by turns; every ninth superseded, every eleventh not registered, every fifth never indexed, every fourth changed since."""
    i, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    docs = documents(spark, sf_dir).select("doc_id", F.concat(F.lit("d"), i.cast("string")).alias("document_id"), text.alias("text"))
    reg = docs.where(i % 11 != 10).select("document_id", pick(STATES, i).alias("pipeline_state"), F.when(i % 9 == 8, "later").alias("superseded_by"))
    lines = docs.where(i % 13 != 12).select("doc_id", "document_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))
    chunks = lines.select("document_id", "chunk_index", "content")
    old = F.when(F.col("doc_id") % 4 == 3, F.concat(F.col("content"), F.lit(" old"))).otherwise(F.col("content"))
    return reg, chunks, lines.where(F.col("doc_id") % 5 != 4).select("document_id", "chunk_index", old.alias("content"))


@query(
    f"""WITH d AS (SELECT doc_id, 'd' || doc_id AS document_id, coalesce(text, '') AS text, doc_id % 11 <> 10 AS known, {sql_pick(STATES, 'doc_id')} AS state, doc_id % 9 = 8 AS gone, doc_id % 13 <> 12 AS chunked, doc_id % 13 <> 12 AND doc_id % 5 <> 4 AS indexed, doc_id % 4 = 3 AS changed FROM documents)
SELECT document_id, CASE WHEN NOT known OR gone THEN CASE WHEN indexed THEN 'delete' END WHEN state NOT IN ('PROCESSED', 'INDEXED') THEN NULL WHEN NOT chunked THEN NULL WHEN NOT indexed THEN 'insert' WHEN changed THEN 'replace' WHEN state <> 'INDEXED' THEN 'mark' END AS action
FROM d WHERE action IS NOT NULL"""
)
def reconcile_actions(spark, sf_dir):
    """What makes an index agree with registry and chunks; lines stand for chunks."""
    reg, chunks, index = _snapshots(spark, sf_dir)
    return registry.reconcile(reg, registry.digests(chunks), registry.digests(index)).select("document_id", "action")


@query(
    f"""WITH d AS (SELECT doc_id, 'd' || doc_id AS document_id, coalesce(text, '') AS text, doc_id % 11 <> 10 AS known, {sql_pick(STATES, 'doc_id')} AS state, doc_id % 9 = 8 AS gone, doc_id % 13 <> 12 AS chunked, doc_id % 13 <> 12 AND doc_id % 5 <> 4 AS indexed, doc_id % 4 = 3 AS changed FROM documents),
r AS (SELECT *, known AND NOT gone AND state IN ('PROCESSED', 'INDEXED') AS due FROM d)
SELECT document_id, len(string_split(text, chr(10))) AS rows, md5(CASE WHEN NOT due AND changed THEN array_to_string(list_transform(string_split(text, chr(10)), lambda x: x || ' old'), chr(10)) ELSE text END) AS digest
FROM r WHERE CASE WHEN due THEN chunked ELSE known AND NOT gone AND indexed END"""
)
def reconciled_index(spark, sf_dir):
    """The index after the actions, each document as its chunks in order."""
    reg, chunks, index = _snapshots(spark, sf_dir)
    after, _ = registry.apply_actions(registry.reconcile(reg, registry.digests(chunks), registry.digests(index)), reg, chunks, index)
    rows = after.groupBy("document_id").agg(F.count("*").alias("rows"), F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("c"))
    return rows.select("document_id", "rows", F.md5(F.array_join("c.content", "\n").cast("binary")).alias("digest"))


@query("SELECT printf('v%09d', doc_id) AS document_id, printf('v%09d', doc_id % 10) AS chain, CASE WHEN doc_id % 10 = 9 THEN -1 ELSE doc_id // 10 END AS position FROM documents")
def version_positions(spark, sf_dir):
    """Places of all versions: ids ten apart are versions of one document; those that end in nine lead into a circle."""
    i = F.col("doc_id")
    name = lambda k: F.format_string("v%09d", k)
    older = F.when(i >= 10, name(i - 10)).when(i == 9, name(F.lit(19).cast("long")))
    return registry.version_positions(documents(spark, sf_dir).select(name(i).alias("document_id"), older.alias("supersedes")))


FILE_OF = f"CASE WHEN doc_id % 8 = 0 THEN 'First volume of 2 Kings.pdf' WHEN doc_id % 8 = 1 THEN '요한복음 강해.docx' ELSE 'volume ' || (doc_id % 8) || '_' || coalesce(source, 'none') || '.txt' END"
# the longest spelling in a text claims first; of those only the first is needed
LONGEST = "{map}[[{claims}][list_min(list_transform(list_distinct(regexp_extract_all(trim(regexp_replace(lower(body), '[0-9]+장|[0-9]+\\s*:?\\s*[0-9]*', '', 'g')), '(?:^|[^\\p{{L}}\\p{{N}}])({alternatives})', 1)), lambda n: list_position([{claims}], n)))]]".format(map=CLAIM_MAP, claims=", ".join(f"'{c}'" for c in CLAIMS), alternatives="|".join(CLAIMS))


@query(
    f"""WITH d AS (SELECT doc_id, {FILE_OF} AS f, {sql_pick(CODES, 'doc_id')} AS book, CASE WHEN doc_id % 4 = 2 THEN 'On ' || {sql_pick(NAMES, '(doc_id % 8)')} || '. ' ELSE '' END || coalesce(text, '') AS body FROM documents),
v AS (SELECT *, {LONGEST} AS voted FROM d), n AS (SELECT f, voted, count(*) AS n FROM v WHERE voted IS NOT NULL GROUP BY ALL), w AS (SELECT f, voted FROM n QUALIFY row_number() OVER (PARTITION BY f ORDER BY n DESC, list_position([{', '.join(f"'{b}'" for b in lexicon.BOOKS)}], voted)) = 1),
r AS (SELECT v.doc_id, v.f, book, w.voted, CASE WHEN f LIKE '%2 Kings%' THEN '2KI' WHEN f LIKE '%요한%' THEN 'JHN' END AS rule FROM v LEFT JOIN w USING (f))
SELECT doc_id, coalesce(rule, voted, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE book END, 'UNK') AS new_book, CASE WHEN rule IS NOT NULL THEN 'rule' WHEN voted IS NOT NULL THEN 'vote' WHEN doc_id % 3 <> 0 THEN 'record' ELSE 'none' END AS decided_by, 'TSU-' || coalesce(rule, voted, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE book END, 'UNK') || '-' || doc_id AS new_id FROM r"""
)
def repaired_books(spark, sf_dir):
    """Books of passages set right by their files' names, else by what most passages of the file name; passages are whole texts."""
    i = F.col("doc_id")
    file = F.when(i % 8 == 0, "First volume of 2 Kings.pdf").when(i % 8 == 1, "요한복음 강해.docx").otherwise(F.concat(F.lit("volume "), (i % 8).cast("string"), F.lit("_"), F.coalesce("source", F.lit("none")), F.lit(".txt")))
    body = F.concat(F.when(i % 4 == 2, F.concat(F.lit("On "), pick(NAMES, i % 8), F.lit(". "))).otherwise(""), F.coalesce("text", F.lit("")))
    book = F.when(i % 3 != 0, pick(CODES, i)).otherwise(corpus.UNKNOWN)
    rows = documents(spark, sf_dir).select("doc_id", F.concat(F.lit("TSU-"), book, F.lit("-"), i.cast("string")).alias("tsu_id"), file.alias("source_file"), F.lit(None).cast("string").alias("title"), book.alias("book_id"), body.alias("content"))
    return corpus.repair_books(rows).select("doc_id", "new_book", "decided_by", "new_id")
