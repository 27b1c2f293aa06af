"""Registered queries on records, stages, boundaries and paged files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from lectern.functions import text
from lectern.operators import monitor, records, structure
from lectern.operators.lineage import spread
from lectern.plans.extended import KOREAN_ENDS
from lectern.plans.queries import IDENT, S_LINES, S_STRIP, documents, query, table
from lectern.sources import paged

AT = "2024-01-01 00:00:00"


@query(
    f"""SELECT doc_id, CASE WHEN c = '' THEN 'empty_' || f ELSE sha256(c)[1:32] END AS document_id, f AS source_file, sha256(c) AS file_hash, '2024-01-01T00:00:00' AS created_at, '1.1.x' AS processing_version,
CAST(NULL AS VARCHAR) AS title, CAST(NULL AS VARCHAR) AS author, CASE WHEN doc_id % 3 = 0 THEN 'MRK' END AS book, CAST(CASE WHEN doc_id % 3 = 0 THEN doc_id % 16 + 1 END AS INTEGER) AS chapter, CAST(NULL AS INTEGER) AS page, CAST(NULL AS VARCHAR) AS batch_id,
coalesce(lang, 'en') AS language, 0.0 AS noise_score, '-' AS noise_mode, CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'md' WHEN 2 THEN '' ELSE 'gz' END AS source_type, FALSE AS is_ocr, CAST(len(string_split(c, chr(10))) AS INTEGER) AS chunk_count, CAST(NULL AS VARCHAR) AS pipeline_state,
CASE WHEN c = '' THEN 'empty_' || f ELSE sha256(c)[1:32] END AS chunk_id_prefix
FROM (SELECT doc_id, lang, 'file ' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.md' WHEN 2 THEN '' ELSE '.tar.gz' END AS f, {IDENT} AS c FROM documents)"""
)
def metadata_records(spark, sf_dir):
    """The record of every document; lines stand for chunks, every third document is known to be of a book."""
    i = F.col("doc_id")
    ending = F.when(i % 4 == 0, ".pdf").when(i % 4 == 1, ".md").when(i % 4 == 2, "").otherwise(".tar.gz")
    docs = documents(spark, sf_dir).select(
        "doc_id", "text", F.concat(F.lit("file "), i.cast("string"), ending).alias("source_file"), F.col("lang").alias("language"), F.when(i % 3 == 0, "MRK").alias("book"), F.when(i % 3 == 0, i % 16 + 1).alias("chapter"),
        F.size(F.split(text.normalise_identity(F.col("text")), "\n")).alias("chunk_count"),
    )
    return records.metadata_records(docs, at=F.lit(AT).cast("timestamp"), keep=("doc_id",))


@query(
    """WITH r AS (SELECT doc_id // 10 AS q, doc_id % 10 AS rank, CASE WHEN doc_id % 7 <> 6 THEN 'T' || doc_id END AS tsu_id, CASE WHEN doc_id % 5 <> 4 THEN source END AS document_id, CASE WHEN doc_id % 7 <> 6 AND doc_id % 2 = 0 THEN '[' || (doc_id % 10 + 1) || ']' END AS citation_id FROM documents)
SELECT q, '2024-01-01T00:00:00' AS timestamp, count(*) FILTER (tsu_id IS NOT NULL OR document_id IS NOT NULL) AS refs,
coalesce(string_agg(coalesce(tsu_id, '') || '|' || coalesce(document_id, '') || '|' || coalesce(citation_id, ''), ',' ORDER BY rank) FILTER (tsu_id IS NOT NULL OR document_id IS NOT NULL), '') AS listed FROM r GROUP BY q"""
)
def session_entries(spark, sf_dir):
    """Entries of a session in which each question's results are ten documents; some are not passages, some not cited."""
    i = F.col("doc_id")
    rows = documents(spark, sf_dir).select(F.floor(i / 10).alias("q"), (i % 10).alias("rank"), F.when(i % 7 != 6, F.concat(F.lit("T"), i.cast("string"))).alias("tsu_id"), F.when(i % 5 != 4, F.col("source")).alias("document_id"), i.alias("i"))
    cited = rows.where("i % 2 = 0").select("q", "tsu_id", F.format_string("[%d]", F.col("rank") + 1).alias("citation_id"))
    found = records.session_entries(rows, cited, ["q"], F.lit(AT).cast("timestamp"))
    listed = F.array_join(F.transform("result_refs", lambda r: F.concat(F.coalesce(r["tsu_id"], F.lit("")), F.lit("|"), F.coalesce(r["document_id"], F.lit("")), F.lit("|"), F.coalesce(r["citation_id"], F.lit("")))), ",")
    return found.select("q", "timestamp", F.size("result_refs").cast("long").alias("refs"), listed.alias("listed"))


@query(
    """WITH c AS (SELECT user_id % 40 AS batch, count(*) AS total, count(*) FILTER (event_id % (user_id % 4 + 1) = 0) AS processed, count(*) FILTER (user_id % 3 <> 0 AND event_id % 3 = 0) AS parsed, count(*) FILTER (user_id % 5 = 0) AS chunked,
count(*) FILTER (user_id % 6 = 5 AND event_id % (user_id % 40 // 20 + 1) = 0) AS covered, count(*) FILTER (user_id % 6 = 5) AS passages, user_id % 40 % 11 = 10 AS indexed FROM {events} GROUP BY ALL),
e AS (SELECT *, CASE WHEN total > 0 AND processed >= total THEN 'complete' WHEN parsed > 0 OR processed > 0 THEN 'active' ELSE 'pending' END AS s1, CASE WHEN total > 0 AND processed >= total THEN 100 WHEN parsed > 0 THEN least(100, 100 * parsed // total) ELSE least(100, 100 * processed // total) END AS p1 FROM c),
k AS (SELECT *, CASE WHEN passages > 0 AND covered > 0 THEN CASE WHEN covered >= total THEN 'complete' ELSE 'active' END WHEN s1 = 'complete' THEN CASE WHEN chunked < total THEN 'active' ELSE 'complete' END WHEN chunked > 0 OR s1 <> 'pending' THEN 'active' ELSE 'pending' END AS s2,
CASE WHEN passages > 0 AND covered > 0 THEN least(100, 100 * covered // total) WHEN s1 = 'complete' OR chunked > 0 THEN least(100, 100 * chunked // total) ELSE 0 END AS p2 FROM e),
m AS (SELECT *, CASE WHEN passages > 0 THEN 'complete' WHEN s2 = 'pending' THEN 'pending' ELSE 'active' END AS s3, CASE WHEN passages > 0 THEN 100 WHEN s2 = 'complete' THEN 30 ELSE 0 END AS p3 FROM k),
x AS (SELECT *, CASE WHEN indexed THEN 'complete' WHEN s3 = 'pending' THEN 'pending' ELSE 'active' END AS s4, CASE WHEN indexed THEN 100 WHEN s3 = 'complete' THEN 50 ELSE 0 END AS p4 FROM m)
SELECT batch, unnest(['extract', 'chunk', 'embedding', 'indexing', 'search']) AS stage, unnest([s1, s2, s3, s4, 'complete']) AS status, CAST(unnest([p1, p2, p3, p4, 100]) AS INTEGER) AS progress FROM x""".replace("{events}", "events")
)
def stage_states(spark, sf_dir):
    """The five stages of forty batches, counted from the events of their users."""
    u, e = F.col("user_id"), F.col("event_id")
    n = lambda on: F.count(F.when(on, 1))
    counts = table(spark, sf_dir, "events").groupBy((u % 40).alias("batch")).agg(
        F.count("*").alias("total"), n(e % (u % 4 + 1) == 0).alias("processed"), n((u % 3 != 0) & (e % 3 == 0)).alias("parsed"), n(u % 5 == 0).alias("chunked"),
        n((u % 6 == 5) & (e % (F.floor(u % 40 / 20) + 1) == 0)).alias("covered"), n(u % 6 == 5).alias("passages"), F.first(u % 40 % 11 == 10).alias("indexed"),
    )
    return monitor.stage_states(counts, ["batch"])


@query("SELECT source, sum(length(text)) AS n, CASE WHEN coalesce(sum(length(text)), 0) <= 300000 THEN 'GREEN' WHEN sum(length(text)) <= 700000 THEN 'YELLOW' ELSE 'RED' END AS zone, round(coalesce(sum(length(text)), 0) * 4.81 / 1024, 1) AS plain_mb, round(coalesce(sum(length(text)), 0) * 23.9 / 1024, 1) AS indexed_mb FROM documents GROUP BY source")
def capacities(spark, sf_dir):
    """What a single process would need for a source of as many rows as its texts have characters."""
    return monitor.capacities(documents(spark, sf_dir).groupBy("source").agg(F.sum(F.length("text")).alias("n")), "n")


SCORED = f"""p AS (SELECT doc_id, pos - 1 AS pos, {S_STRIP('t')} AS t FROM (SELECT doc_id, unnest(x) AS t, generate_subscripts(x, 1) AS pos FROM (SELECT doc_id, string_split_regex(text, '\\n\\n+') AS x FROM documents WHERE text IS NOT NULL))), l AS (SELECT *, {S_LINES('t')} AS ls FROM p),
f AS (SELECT *, CASE WHEN t <> '' THEN 30.0 ELSE 0.0 END + CASE WHEN length(t) < 80 THEN -60.0 ELSE 0.0 END + CASE WHEN len(ls) > 0 AND (regexp_matches(ls[-1], '[.!?。！？]') OR regexp_matches(ls[-1], '{KOREAN_ENDS}')) THEN 10.0 ELSE 0.0 END + CASE WHEN len(ls) > 1 AND length(ls[1]) < 60 THEN 100.0 ELSE 0.0 END AS score FROM l)"""


def scored(spark, sf_dir):
    """Paragraphs as candidates; a short first line before others is taken for a heading."""
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", r"\n\n+")).alias("pos", "text")).withColumn("text", text.strip(F.col("text")))
    every = text.lines(F.col("text"))
    return structure.boundary_candidates(rows.withColumn("met", (F.size(every) > 1) & (F.length(F.get(every, F.lit(0))) < 60)), "text", "met").drop("met")


@query(f"WITH {SCORED} SELECT doc_id, count(*) FILTER (score >= 50) AS matched, count(*) AS candidates, round(100.0 * count(*) FILTER (score >= 50) / count(*), 2) AS percent FROM f GROUP BY doc_id")
def boundary_density(spark, sf_dir):
    return structure.boundary_density(scored(spark, sf_dir))


@query(f"WITH {SCORED} SELECT doc_id, pos, score, TRUE AS is_boundary, length(t) AS n, translate(t[1:80], chr(10), ' ') AS preview FROM f WHERE score >= 50 AND length(t) > 300")
def suspicious_boundaries(spark, sf_dir):
    return structure.suspicious_boundaries(scored(spark, sf_dir))


@F.pandas_udf(BinaryType())
def as_paged(texts: pd.Series) -> pd.Series:
    return texts.map(paged.paged_bytes)


def marked(sql: bool):
    """Texts whose lines at 7, 14, ... begin with the mark of larger and bold ones."""
    if sql:
        return "list_transform(string_split(translate(text, chr(13), ''), chr(10)), lambda l, i: CASE WHEN i % 7 = 0 THEN '# ' || l ELSE l END)"
    return F.array_join(F.transform(F.split(F.translate("text", "\r", ""), "\n"), lambda l, i: F.when((i + 1) % 7 == 0, F.concat(F.lit("# "), l)).otherwise(l)), "\n")


@query(
    f"""WITH x AS (SELECT doc_id, {marked(True)} AS ls FROM documents WHERE text IS NOT NULL), y AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) - 1 AS pos FROM x),
z AS (SELECT doc_id, pos, l LIKE '# %' AS bold, {S_STRIP("CASE WHEN l LIKE '# %' THEN l[3:] ELSE l END")} AS t FROM y)
SELECT doc_id, pos // 40 AS page, count(*) AS lines, count(*) FILTER (bold) AS bold, round(max(CASE WHEN bold THEN 14.0 ELSE 10.0 END), 1) AS largest, md5(string_agg(t, chr(10) ORDER BY pos)) AS digest FROM z WHERE t <> '' GROUP BY ALL"""
)
def paged_lines(spark, sf_dir):
    """Every text written as a paged file of forty lines a page and read back: lines, weight, size and text of each page."""
    files = spread(documents(spark, sf_dir)).where("text IS NOT NULL").select("doc_id", as_paged(marked(False)).alias("content"))
    lines = paged.spans_of(files, "doc_id").where("text IS NOT NULL")
    # a page has at most forty lines
    held = F.array_sort(F.collect_list(F.struct("line", "text")))["text"]
    return lines.groupBy("doc_id", "page").agg(F.count("*").alias("lines"), F.count(F.when(F.col("bold"), 1)).alias("bold"), F.max("size").alias("largest"), F.md5(F.array_join(held, "\n").cast("binary")).alias("digest"))
