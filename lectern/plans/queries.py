"""Registered queries of the library itself, each over its whole tables, with the SQL that gives the same rows."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import lexicon
from lectern.functions import chunk, quality, references
from lectern.functions.text import WORD, WS, content_hash, document_id, keywords, lines, normalise_basic, short_hash, strip_tags
from lectern.operators import evaluation, monitor, registry, retrieval, structure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


# --- SQL pieces -----------------------------------------------------------------------------------

PUNCT = string.punctuation.replace("'", "''")
STOPS = ", ".join(f"'{w}'" for w in lexicon.STOP_WORDS)
S_STRIP = lambda x: f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"
S_TOKENS = lambda x: f"list_filter(string_split_regex(translate(lower(coalesce({x}, '')), '{PUNCT}', ''), '[{WS}]+'), lambda t: t <> '')"
S_WORDS = lambda x: f"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[{WORD}]+'), lambda w: regexp_full_match(w, '[a-z]{{3,}}'))"
S_COUNT = lambda x, p: f"len(regexp_extract_all({x}, '{p}'))"
S_BASIC = lambda x: S_STRIP(f"regexp_replace(regexp_replace(translate(replace(coalesce({x}, ''), chr(13) || chr(10), chr(10)), chr(13) || chr(9), chr(10) || ' '), '[ \\x{{00A0}}]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")
S_LINES = lambda x: f"list_filter(list_transform(string_split_regex({x}, '\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda l: {S_STRIP('l')}), lambda l: l <> '')"

PLAIN_QUESTIONS = "q AS (SELECT item_id AS query_id, text AS question FROM benchmark),"
BM25_OF_Q = f"""
qt AS (
  SELECT query_id, w AS term, min(p) AS pos FROM (SELECT query_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM (SELECT query_id, {S_WORDS("question")} AS ws FROM q)) WHERE w NOT IN ({STOPS}) GROUP BY query_id, w
),
qk AS (SELECT query_id, term FROM qt QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos) <= 20),
dt AS (SELECT doc_id, len(ts) AS doc_len, unnest(ts) AS term FROM (SELECT doc_id, {S_TOKENS("text")} AS ts FROM documents)),
tf AS (SELECT doc_id, term, doc_len, count(*) AS tf FROM dt WHERE term IN (SELECT term FROM qk) GROUP BY ALL),
s AS (SELECT query_id, doc_id, avg((ln(2.0 / (tf + 1)) + 1.0) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * doc_len / greatest(doc_len, 100.0)))) AS s FROM tf JOIN qk USING (term) GROUP BY query_id, doc_id),
bm AS (SELECT query_id, doc_id, round(least(ln(1 + greatest(s, 0.0)) / ln(2.0), 1.0), 6) AS bm25 FROM s WHERE round(least(ln(1 + greatest(s, 0.0)) / ln(2.0), 1.0), 6) > 0)"""

BM25 = PLAIN_QUESTIONS + BM25_OF_Q

DIVERSE = """
once AS (SELECT h.*, d.source FROM bm h JOIN documents d USING (doc_id) QUALIFY row_number() OVER (PARTITION BY query_id, md5(d.text[1:200])[1:8] ORDER BY bm25 DESC, doc_id) = 1),
nth AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY bm25 DESC, doc_id) > 2 AS over FROM once),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY over, bm25 DESC, doc_id) AS rank, doc_id, source, bm25 FROM nth QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY over, bm25 DESC, doc_id) <= 10)"""

TFIDF = f"""
n AS (SELECT count(*) AS n FROM documents),
allt AS (SELECT doc_id, unnest({S_TOKENS("text")}) AS term FROM documents),
cnt AS (SELECT doc_id, term, count(*) AS tf FROM allt GROUP BY ALL),
idf AS (SELECT term, count(*) AS df, ln(((SELECT n FROM n) + 1) / (count(*) + 1)) + 1 AS idf FROM cnt GROUP BY term),
dw AS (SELECT doc_id, term, (0.5 + 0.5 * tf / max(tf) OVER (PARTITION BY doc_id)) * idf AS w FROM cnt JOIN idf USING (term)),
dn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM dw GROUP BY doc_id),
qc AS (SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest({S_TOKENS("question")}) AS term FROM q) GROUP BY ALL),
qm AS (SELECT query_id, term, tf, max(tf) OVER (PARTITION BY query_id) AS mx FROM qc),
qw AS (SELECT query_id, term, (0.5 + 0.5 * tf / mx) * idf AS qw FROM qm JOIN idf USING (term)),
qn AS (SELECT query_id, sqrt(sum(qw * qw)) AS qnorm FROM qw GROUP BY query_id),
cs AS (SELECT query_id, doc_id, round(dot / (norm * qnorm), 6) AS cosine FROM (SELECT query_id, doc_id, sum(w * qw) AS dot FROM dw JOIN qw USING (term) GROUP BY ALL) JOIN dn USING (doc_id) JOIN qn USING (query_id))"""

GOLD = "gold AS (SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) AND b.text <> '')"

PER_QUERY = """
judged AS (SELECT r.query_id, r.rank, CASE WHEN g.doc_id IS NULL THEN 0 ELSE 1 END AS hit FROM ranked r LEFT JOIN gold g ON g.query_id = r.query_id AND g.doc_id = r.doc_id),
pq AS (
  SELECT query_id, sum(hit) FILTER (rank <= 1) AS hit1, coalesce(sum(hit) FILTER (rank <= 5), 0) AS hit5, sum(hit) AS hits, coalesce(1.0 / min(rank) FILTER (hit = 1), 0.0) AS rr, coalesce(sum(1 / log2(rank + 1.0)) FILTER (hit = 1), 0.0) AS dcg
  FROM judged GROUP BY query_id
),
m AS (SELECT *, CASE WHEN hits > 0 THEN dcg / list_sum(list_transform(range(1, CAST(hits AS BIGINT) + 1), lambda i: 1 / log2(i + 1.0))) ELSE 0.0 END AS ndcg FROM pq)"""

AVERAGES = "count(*) AS n, round(avg(CAST(hit1 AS DOUBLE)), 6) AS p_at_1, round(avg(hit5 / 5.0), 6) AS p_at_5, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, round(avg(hits / 10.0), 6) AS hit_rate"


# --- retrieval ------------------------------------------------------------------------------------


@query(f"WITH {BM25},{DIVERSE} SELECT * FROM ranked")
def retrieval_topk(spark, sf_dir):
    """Flagship: questions ranked against all documents, deduplicated, at most two per source, ten each."""
    return retrieval.topk(documents(spark, sf_dir), questions(spark, sf_dir))


@query(f"WITH {BM25} SELECT query_id, doc_id, bm25, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id) AS rank FROM bm QUALIFY rank <= 100")
def bm25_top100(spark, sf_dir):
    return retrieval.top(retrieval.lexical_scores(documents(spark, sf_dir), questions(spark, sf_dir)), 100, ["query_id"], F.desc("bm25"), F.col("doc_id"))


@query(f"WITH {PLAIN_QUESTIONS}{TFIDF} SELECT query_id, doc_id, cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, doc_id) AS rank FROM cs QUALIFY rank <= 10")
def tfidf_cosine_topk(spark, sf_dir):
    return retrieval.top(retrieval.tfidf_scores(documents(spark, sf_dir), questions(spark, sf_dir), k=10), 10, ["query_id"], F.desc("cosine"), F.col("doc_id"))


@query(
    """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL),
c AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_inner_product(q.e, v.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(v.e, v.e))), 6) AS cosine FROM v JOIN v AS q ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM c QUALIFY rank <= 10"""
)
def vector_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where((F.col("vec_id") % 100 == 0) & F.col("embedding").isNotNull()).select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.vector_topk(rows, asked)


S_THEMES = lambda x: "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(coalesce({x}, '')), '{'|'.join(w)}') THEN '{n}' END" for n, w in lexicon.THEMES.items()) + "], lambda t: t IS NOT NULL)"
ACADEMIC = " + ".join(f"CASE WHEN contains(lower(coalesce(text, '')), '{t}') THEN 1 ELSE 0 END" for t in lexicon.ACADEMIC_TERMS)
FEATURES = f"""
f AS (
  SELECT doc_id, source, md5(text[1:200])[1:8] AS head, {S_THEMES("text")} AS dth, list_distinct({S_WORDS("text[1:1000]")}) AS dwords, length(coalesce(text, '')) AS len,
    len(regexp_extract_all(coalesce(text, ''), '[.!?]')) AS marks, {ACADEMIC} AS terms
  FROM documents
),
fu AS (
  SELECT *, CASE WHEN len = 0 THEN 0.0 ELSE least((CASE WHEN len BETWEEN 200 AND 800 THEN 0.5 WHEN len >= 100 THEN 0.3 ELSE 0.0 END + CASE WHEN marks >= 2 THEN 0.3 WHEN marks = 1 THEN 0.15 ELSE 0.0 END + CASE WHEN terms >= 3 THEN 0.2 WHEN terms >= 1 THEN 0.1 ELSE 0.0 END) * 0.75, 1.0) END AS usable
  FROM f
),
qf AS (SELECT query_id, {S_THEMES("question")} AS qth, list_distinct({S_WORDS("question")}) AS qwords FROM q)"""
# needs q (query_id, question), qb (query_id, books, refs, score_refs), p (doc_id, book_id, chapter, confidence)
S_FITS = "(list_contains(qb.books, p.book_id) AND (len(qb.refs) = 0 OR len(list_filter(qb.refs, lambda r: r.b = p.book_id AND abs(coalesce(p.chapter, 0) - r.c) <= 2)) > 0))"
HYBRID = f"""
narrow AS (SELECT DISTINCT qb.query_id FROM qb JOIN p ON {S_FITS}),
pool AS (SELECT qb.*, narrow.query_id IS NOT NULL AS narrow FROM qb LEFT JOIN narrow ON narrow.query_id = qb.query_id),
lex AS (SELECT bm.query_id, bm.doc_id, bm.bm25 FROM bm JOIN pool qb ON qb.query_id = bm.query_id JOIN p ON p.doc_id = bm.doc_id WHERE NOT qb.narrow OR coalesce({S_FITS}, false)),
hundred AS (SELECT query_id, doc_id FROM lex QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id) <= 100),
bare AS (SELECT qb.query_id, p.doc_id FROM pool qb JOIN p ON NOT qb.narrow OR coalesce({S_FITS}, false) WHERE qb.query_id NOT IN (SELECT query_id FROM lex)),
pair AS (SELECT query_id, doc_id, bm25 FROM lex UNION ALL SELECT query_id, doc_id, 0.0 FROM bare),
seen AS (SELECT * FROM hundred UNION ALL SELECT * FROM bare),
scored AS (SELECT pair.*, coalesce(cs.cosine, 0.0) AS cosine FROM pair LEFT JOIN (SELECT cs.* FROM cs JOIN seen USING (query_id, doc_id)) cs ON cs.query_id = pair.query_id AND cs.doc_id = pair.doc_id),{FEATURES},
dom AS (
  SELECT s.*, source, head, coalesce(p.confidence, 0.5) AS confidence, round(CAST(0.45 AS DOUBLE) * CAST(CASE WHEN p.book_id IS NULL THEN 0.0 WHEN len(qb.score_refs) = 0 THEN CASE WHEN contains(upper(coalesce(source, '')), p.book_id) THEN 0.5 ELSE 0.1 END
    ELSE least(coalesce(list_sum(list_transform(qb.score_refs, lambda r: CASE WHEN r.b = p.book_id AND r.c = coalesce(p.chapter, 1) THEN 0.8 WHEN r.b = p.book_id AND abs(r.c - coalesce(p.chapter, 1)) = 1 THEN 0.3 ELSE 0.0 END)), 0.0), 1.0) END AS DOUBLE)
    + 0.35 * least(0.6 * CASE WHEN list_has_any(qth, dth) THEN 1.0 WHEN len(qth) + len(dth) > 0 THEN 0.5 ELSE 0.0 END
    + 0.4 * CASE WHEN len(qwords) > 0 AND len(dwords) > 0 THEN len(list_intersect(qwords, dwords)) / len(list_distinct(list_concat(qwords, dwords))) ELSE 0.0 END, 1.0) + 0.20 * usable, 4) AS domain
  FROM scored s JOIN fu USING (doc_id) JOIN qf USING (query_id) JOIN qb ON qb.query_id = s.query_id JOIN p ON p.doc_id = s.doc_id
),
fin AS (
  SELECT *, round((0.30 * CASE WHEN max(bm25) OVER w > 0 THEN bm25 / max(bm25) OVER w ELSE 0.5 END + 0.25 * CASE WHEN max(cosine) OVER w > 0 THEN cosine / max(cosine) OVER w ELSE 0.0 END + 0.45 * domain) * (0.9 + 0.1 * confidence), 4) AS final
  FROM dom WINDOW w AS (PARTITION BY query_id)
),
uniq AS (SELECT * FROM fin QUALIFY row_number() OVER (PARTITION BY query_id, head ORDER BY final DESC, doc_id) = 1),
capped AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY final DESC, doc_id) > 2 AS over FROM uniq)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY over, final DESC, doc_id) AS rank, doc_id, source, bm25, cosine, domain, final FROM capped QUALIFY rank <= 10"""
NO_BOOKS = "qb AS (SELECT query_id, CAST([] AS VARCHAR[]) AS books, CAST([] AS STRUCT(b VARCHAR, c INTEGER)[]) AS refs, CAST([] AS STRUCT(b VARCHAR, c INTEGER)[]) AS score_refs FROM q), p AS (SELECT doc_id, CAST(NULL AS VARCHAR) AS book_id, CAST(NULL AS INTEGER) AS chapter, CAST(NULL AS DOUBLE) AS confidence FROM documents)"


@query(f"WITH {BM25},{TFIDF},{NO_BOOKS},{HYBRID}")
def hybrid_rank(spark, sf_dir):
    """The whole ranking over documents without known places: lexical hits or else all, cosines of the first hundred, domain score, evidence factor."""
    return retrieval.rank_hybrid(documents(spark, sf_dir), questions(spark, sf_dir))


@query(f"WITH {BM25},{DIVERSE} SELECT query_id, rank, doc_id, r.source, d.text[1:200] AS excerpt FROM ranked r JOIN documents d USING (doc_id)")
def citations(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return retrieval.citations(retrieval.topk(docs, questions(spark, sf_dir)), docs)


@query(f"WITH {BM25},{DIVERSE} SELECT query_id, string_agg('[' || rank || '] (' || coalesce(r.source, 'unknown') || ')' || chr(10) || d.text[1:200], chr(10) || chr(10) ORDER BY rank) AS context FROM ranked r JOIN documents d USING (doc_id) GROUP BY query_id")
def context_blocks(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return retrieval.context_blocks(retrieval.citations(retrieval.topk(docs, questions(spark, sf_dir)), docs))


@query("SELECT doc_id, md5(text[1:200])[1:8] AS head FROM documents QUALIFY row_number() OVER (PARTITION BY head ORDER BY doc_id) = 1")
def dedup_first_wins(spark, sf_dir):
    heads = documents(spark, sf_dir).select("doc_id", short_hash(F.substring("text", 1, 200)).alias("head"))
    return heads.groupBy("head").agg(F.min("doc_id").alias("doc_id"))


@query(f"WITH {BM25}, k AS (SELECT query_id, term, pos FROM qt QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos) <= 20) SELECT q.query_id, count(term) AS n, coalesce(string_agg(term, ' ' ORDER BY pos), '') AS keywords FROM q LEFT JOIN k ON k.query_id = q.query_id GROUP BY q.query_id")
def question_keywords(spark, sf_dir):
    rows = questions(spark, sf_dir).select("query_id", keywords(F.col("question")).alias("k"))
    return rows.select("query_id", F.size("k").alias("n"), F.array_join("k", " ").alias("keywords"))


INTENT_SQL = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(text, ''), '(?i){p.replace(chr(39), chr(39) * 2)}') THEN '{n}'" for n, p in [*lexicon.INTENTS.items(), lexicon.FALLBACK_INTENT]) + " ELSE 'unknown' END"


@query(f"SELECT {INTENT_SQL} AS intent, role, count(*) AS n FROM conversations GROUP BY ALL")
def intent_counts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy(references.intent(F.col("text")).alias("intent"), "role").agg(F.count("*").alias("n"))


@query(f"SELECT theme, count(*) AS n FROM (SELECT unnest({S_THEMES('text')}) AS theme FROM documents) GROUP BY theme")
def theme_counts(spark, sf_dir):
    return documents(spark, sf_dir).select(F.explode(references.themes(F.col("text"))).alias("theme")).groupBy("theme").agg(F.count("*").alias("n"))


@query(f"""WITH {BM25}, asked AS (SELECT query_id, count(*) AS asked FROM qk GROUP BY query_id), met AS (SELECT query_id, count(DISTINCT term) AS hits FROM qk WHERE term IN (SELECT term FROM tf) GROUP BY query_id)
SELECT q.query_id, coalesce(hits, 0) AS hits, coalesce(asked, 0) AS asked, CASE WHEN coalesce(asked, 0) = 0 THEN 0.5 WHEN coalesce(hits, 0) >= 2 THEN 0.0 ELSE round(1.0 - coalesce(hits, 0) / asked, 4) END AS negative FROM q LEFT JOIN asked ON asked.query_id = q.query_id LEFT JOIN met ON met.query_id = q.query_id""")
def negative_questions(spark, sf_dir):
    """How sure it is that the corpus has nothing on a question."""
    q = questions(spark, sf_dir)
    terms = retrieval.question_terms(q)
    known = retrieval.term_counts(documents(spark, sf_dir), terms=terms).select("term").distinct()
    met = terms.join(known, "term").groupBy("query_id").agg(F.count_distinct("term").alias("hits"))
    asked = terms.groupBy("query_id").agg(F.count("*").alias("asked"))
    rows = q.select("query_id").join(asked, "query_id", "left").join(met, "query_id", "left").select("query_id", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("asked", F.lit(0)).alias("asked"))
    return rows.withColumn("negative", retrieval.negative_confidence(F.col("hits"), F.col("asked")))


# --- text, noise, language ------------------------------------------------------------------------

SYM = rf"[^{WORD}{WS}]"
NOISE_TXT = f"CASE WHEN {S_STRIP('coalesce(text, $$$$)')} = '' THEN 100.0 ELSE least(100.0, round(greatest((sym * 25 + short * 12) * 14, 3.0), 1)) END"
NOISE_FROM = f"""(SELECT *, CASE WHEN length(c) > 0 THEN {S_COUNT('c', SYM)} / length(c) ELSE 0.0 END AS sym, CASE WHEN len(ls) > 0 THEN len(list_filter(ls, lambda l: length(l) <= 3)) / len(ls) ELSE 0.0 END AS short FROM (SELECT doc_id, text, c, {S_LINES('c')} AS ls FROM (SELECT doc_id, text, {S_BASIC('text')} AS c FROM documents)))"""


@query(f"SELECT doc_id, {NOISE_TXT} AS noise FROM {NOISE_FROM}")
def noise_score_txt(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", quality.noise_score(F.col("text"), "txt").alias("noise"))


@query()
def noise_score_paged(spark, sf_dir):
    """The scores of the other file types, by sentence and by line (not expressible without look-around and back-references)."""
    rows = documents(spark, sf_dir).select("doc_id", "text", chunk.sentences("text").alias("s"))
    scored = rows.select("doc_id", quality.noise_scores(F.col("text"), chunk.broken_sentence_ratio(F.col("s"))).alias("n"))
    return scored.select("doc_id", *[F.col("n")[k].alias(k) for k in ("pdf", "scan", "rich", "other")])


NOISE_TYPE = f"""CASE WHEN {S_STRIP("coalesce(text, $$$$)")} = '' THEN 'PAGE_NUMBER'
  WHEN {S_COUNT("text", "[\\x{0590}-\\x{05FF}]")} >= 3 OR {S_COUNT("text", "[\\x{0370}-\\x{03FF}]")} >= 3 THEN 'ORIGINAL_LANGUAGE'
  WHEN regexp_matches({S_STRIP("text")}, '(?i)^(page\\s+)?[0-9]+$') THEN 'PAGE_NUMBER'
  WHEN regexp_matches(text, '\\(([^()]*[^()\\p{{L}}\\p{{N}}_])?(19|20)[0-9]{{2}}([^()\\p{{L}}\\p{{N}}_][^()]*)?\\)') THEN 'BIBLIOGRAPHY'
  WHEN len(list_filter(regexp_extract_all(text, '[{WORD}]+'), lambda w: regexp_full_match(w, '[A-Z]{{2,6}}'))) / greatest(len(list_filter(string_split_regex(text, '[{WS}]+'), lambda x: x <> '')), 1) >= 0.08 THEN 'ABBREVIATION'
  WHEN {NOISE_TXT} >= 60 THEN 'OCR_FRAGMENT'
  WHEN len(ls) BETWEEN 1 AND 4 AND len(list_filter(ls, lambda l: length(l) > 48 OR regexp_matches(l, '[.!?。！？]'))) = 0 THEN 'HEADER_FOOTER' ELSE 'NORMAL_CONTENT' END"""


@query(f"SELECT noise_type, count(*) AS n FROM (SELECT {NOISE_TYPE} AS noise_type FROM {NOISE_FROM}) GROUP BY noise_type")
def noise_class_counts(spark, sf_dir):
    return documents(spark, sf_dir).groupBy(quality.noise_type(F.col("text")).alias("noise_type")).agg(F.count("*").alias("n"))


@query(
    "SELECT doc_id, CASE " + " ".join(f"WHEN {S_COUNT('t', f'[{chars}]')} > 0.1 * total AND total > 0 THEN '{n}'" for n, chars in quality.SCRIPTS.items())
    + f" ELSE 'en' END AS language FROM (SELECT doc_id, coalesce(text, '') AS t, {S_COUNT('coalesce(text, $$$$)', f'[^{WS}]')} AS total FROM documents)"
)
def script_language(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", quality.script_language(F.col("text")).alias("language"))


@query(f"SELECT doc_id, length(c) AS n, md5(c) AS digest, len({S_LINES('c')}) AS lines FROM (SELECT doc_id, {S_BASIC('text')} AS c FROM documents)")
def text_cleanup(spark, sf_dir):
    c = normalise_basic(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", c.alias("c")).select("doc_id", F.length("c").alias("n"), F.md5(F.col("c").cast("binary")).alias("digest"), F.size(lines(F.col("c"))).alias("lines"))


@query(f"SELECT term, count(*) AS df, round(ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1, 6) AS idf FROM (SELECT unnest(list_distinct({S_TOKENS('text')})) AS term FROM documents) GROUP BY term")
def tokenize_df(spark, sf_dir):
    return retrieval.idf(documents(spark, sf_dir)).select("term", "df", F.round("idf", 6).alias("idf"))


HTML = "html"
for _tag in ("script", "style", "noscript", "head"):
    HTML = f"regexp_replace({HTML}, '(?is)<{_tag}[^>]*>.*?</{_tag}>', '', 'g')"
HTML = f"regexp_replace({HTML}, '(?s)<[^>]*>', chr(10), 'g')"
for _a, _b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    HTML = f"replace({HTML}, '{_a}', '{_b}')"
HTML = f"array_to_string(list_filter(list_transform(string_split({HTML}, chr(10)), lambda l: {S_STRIP('l')}), lambda l: l <> ''), chr(10))"


@query(f"SELECT page_id, length(t) AS n, md5(t) AS digest FROM (SELECT page_id, {HTML} AS t FROM pages)")
def html_text(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", strip_tags(F.col("html")).alias("t"))
    return rows.select("page_id", F.length("t").alias("n"), F.md5(F.col("t").cast("binary")).alias("digest"))


# --- chunks and structure -------------------------------------------------------------------------

WINDOW = """SELECT doc_id, i, t, text[i:i + 999] AS p, i + 999 < t AS inner_ FROM (SELECT doc_id, text, length(text) AS t, unnest(range(1, length(text) + 1, 900)) AS i FROM documents)"""


@query(f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, length(c) AS n, md5(c) AS digest FROM (SELECT doc_id, i, {S_STRIP('CASE WHEN inner_ AND strpos(reverse(p), $$ $$) > 0 AND length(p) - strpos(reverse(p), $$ $$) > 500 THEN p[1:length(p) - strpos(reverse(p), $$ $$)] ELSE p END')} AS c FROM ({WINDOW})) WHERE length(c) >= 50")
def fixed_chunks(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(chunk.fixed_windows(F.col("text"))).alias("chunk_index", "c"))
    return rows.select("doc_id", "chunk_index", F.length("c").alias("n"), F.md5(F.col("c").cast("binary")).alias("digest"))


HEAD = "^(#{1,3}[ \\t]+[^\\n]+|[0-9]+[.)][ \\t]+[^\\n]+)$"
MARKED = f"regexp_replace(t, '(?m)^(#{{1,3}}[ \\t]+[^\\n]|[0-9]+[.)][ \\t]+[^\\n])', chr(1) || '\\1', 'g')"
FIXED_OF = lambda source: f"SELECT k, row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS chunk_index, c FROM (SELECT k, i, {S_STRIP('CASE WHEN inner_ AND strpos(reverse(p), $$ $$) > 0 AND length(p) - strpos(reverse(p), $$ $$) > 500 THEN p[1:length(p) - strpos(reverse(p), $$ $$)] ELSE p END')} AS c FROM (SELECT k, i, t, text[i:i + 999] AS p, i + 999 < t AS inner_ FROM (SELECT k, text, length(text) AS t, unnest(range(1, length(text) + 1, 900)) AS i FROM ({source})))) WHERE length(c) >= 50"


@query(f"""WITH s AS (SELECT page_id AS k, {HTML} AS t FROM pages), h AS (SELECT *, len(regexp_extract_all(t, '(?m){HEAD}')) AS heads FROM s),
parts AS (SELECT k, generate_subscripts(x, 1) AS pos, unnest(x) AS c FROM (SELECT k, list_filter(list_transform(list_filter(string_split({MARKED}, chr(1)), lambda y: regexp_matches(y, '(?m){HEAD}')), lambda y: {S_STRIP('y')}), lambda y: length(y) >= 50) AS x FROM h WHERE heads > 1)),
every AS (SELECT k, pos - 1 AS chunk_index, c FROM parts UNION ALL {FIXED_OF("SELECT k, t AS text FROM h WHERE heads <= 1")})
SELECT k AS page_id, chunk_index, length(c) AS n, md5(c) AS digest FROM every""")
def structure_chunks(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(chunk.structure_chunks(strip_tags(F.col("html")))).alias("chunk_index", "c"))
    return rows.select("page_id", "chunk_index", F.length("c").alias("n"), F.md5(F.col("c").cast("binary")).alias("digest"))


@query()
def paragraph_chunks(spark, sf_dir):
    """The production chunker: an ordered fold over each text; tests/ compares it with plain cases."""
    rows = chunk.paragraph_rows(documents(spark, sf_dir)).withColumnRenamed("chunk", "c")
    return rows.select("doc_id", "chunk_index", F.length("c").alias("n"), F.md5(F.col("c").cast("binary")).alias("digest"))


NOISE_C = NOISE_TXT.replace("coalesce(text, $$$$)", "chunk")


@query(f"""WITH ch AS ({FIXED_OF("SELECT doc_id AS k, text FROM documents")}), n AS (SELECT *, list_distinct(list_filter(string_split_regex(chunk, '\\s+'), lambda x: x <> '')) AS ws FROM (SELECT k, chunk_index, c AS chunk, {S_BASIC('c')} AS c, {S_LINES(S_BASIC('c'))} AS ls FROM ch)),
m AS (SELECT *, CASE WHEN length(c) > 0 THEN {S_COUNT('c', SYM)} / length(c) ELSE 0.0 END AS sym, CASE WHEN len(ls) > 0 THEN len(list_filter(ls, lambda l: length(l) <= 3)) / len(ls) ELSE 0.0 END AS short, lag(ws) OVER (PARTITION BY k ORDER BY chunk_index) AS last FROM n),
f AS (SELECT k, chunk, {NOISE_C} AS noise, CASE WHEN last IS NULL OR len(list_distinct(list_concat(ws, last))) = 0 THEN 0.0 ELSE len(list_intersect(ws, last)) / len(list_distinct(list_concat(ws, last))) END AS dup FROM m)
SELECT k AS doc_id, count(*) AS chunks, round(avg(noise), 4) AS avg_noise, max(noise) AS max_noise, round(avg(dup), 4) AS avg_overlap, round(avg(CASE WHEN length(trim(chunk)) < 80 THEN 1.0 ELSE 0.0 END), 4) AS short_ratio, max(noise) <= 18 AND round(avg(dup), 4) <= 0.3 AND round(avg(CASE WHEN length(trim(chunk)) < 80 THEN 1.0 ELSE 0.0 END), 4) <= 0.2 AS passed FROM f GROUP BY k""")
def chunk_quality(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(chunk.fixed_windows(F.col("text"))).alias("chunk_index", "chunk"))
    return evaluation.chunk_quality(rows, quality.noise_score(F.col("chunk"), "txt"))


@query(
    """
WITH h AS (SELECT page_id, generate_subscripts(x, 1) AS nth, unnest(x) AS tag FROM (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>') AS x FROM pages)),
l AS (SELECT page_id, nth, CAST(tag[3:3] AS INTEGER) AS level, regexp_replace(tag, '(?s)<[^>]*>', '', 'g') AS title FROM h),
w AS (SELECT a.page_id, a.nth, b.level, b.title, b.nth AS bat FROM l a JOIN l b ON a.page_id = b.page_id AND b.nth <= a.nth AND NOT EXISTS (SELECT 1 FROM l c WHERE c.page_id = a.page_id AND c.nth > b.nth AND c.nth <= a.nth AND c.level <= b.level))
SELECT page_id, nth, string_agg(title, ' / ' ORDER BY level) AS path, count(*) AS depth FROM w GROUP BY page_id, nth"""
)
def heading_paths(spark, sf_dir):
    tags = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("(?is)<h[1-6][^>]*>.*?</h[1-6]>"), 0)).alias("p", "tag"))
    marked = tags.select("page_id", (F.col("p") + 1).alias("nth"), F.substring("tag", 3, 1).cast("int").alias("level"), F.regexp_replace("tag", "(?s)<[^>]*>", "").alias("title"))
    return structure.heading_paths(marked, "page_id", "nth").select("page_id", "nth", F.array_join("path", " / ").alias("path"), F.col("depth").cast("long").alias("depth"))


@query(
    """
WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '')) AS ws FROM conversations),
l AS (SELECT conv_id, turn, ws, lag(ws) OVER (PARTITION BY conv_id ORDER BY turn) AS last FROM w)
SELECT conv_id, turn, CASE WHEN last IS NULL OR len(list_distinct(list_concat(ws, last))) = 0 THEN 0.0 ELSE round(len(list_intersect(ws, last)) / len(list_distinct(list_concat(ws, last))), 6) END AS overlap FROM l"""
)
def adjacent_jaccard(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.round(evaluation.adjacent_jaccard(F.col("text"), ["conv_id"], "turn"), 6).alias("overlap"))


# --- identity and registry ------------------------------------------------------------------------

IDENT = S_STRIP("regexp_replace(translate(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g')")
IDENTIFIED = f"SELECT doc_id, source, c, CASE WHEN c = '' THEN 'empty_' || source ELSE sha256(c)[1:32] END AS document_id, sha256(c) AS file_hash FROM (SELECT doc_id, source, {IDENT} AS c FROM documents)"


@query(f"SELECT doc_id, document_id, file_hash FROM ({IDENTIFIED})")
def identity_hash(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", document_id(F.col("text"), F.col("source")).alias("document_id"), content_hash(F.col("text")).alias("file_hash"))


@query(f"SELECT document_id, count(*) AS copies, min(doc_id) AS first_doc, count(DISTINCT source) AS sources FROM ({IDENTIFIED}) GROUP BY document_id HAVING count(*) > 1")
def duplicate_docs(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", "source", document_id(F.col("text"), F.col("source")).alias("document_id"))
    return rows.groupBy("document_id").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"), F.count_distinct("source").alias("sources")).where("copies > 1")


def _registry(docs: DataFrame) -> DataFrame:
    """A registry made of labelled documents: toxic ones failed, low quality ones changed since."""
    return docs.where(F.col("quality").isNotNull()).select(
        "document_id", "file_hash", F.col("source").alias("source_file"), F.when(F.col("toxic") == 1, "FAILED").otherwise("PROCESSED").alias("ingest_status"), (F.col("doc_id") % 5).cast("int").alias("retry_count"), F.lit(3).alias("max_retries"),
        F.when(F.col("quality") == 0, F.lit("changed")).otherwise(F.col("file_hash")).alias("last_content_hash"), F.lit(None).cast("string").alias("supersedes"), F.lit(None).cast("string").alias("superseded_by"), F.col("doc_id").alias("ord"),
    )


@query(
    f"""
WITH d AS (SELECT i.doc_id, document_id, file_hash, quality, toxic FROM ({IDENTIFIED}) i LEFT JOIN labels l ON l.doc_id = i.doc_id),
r AS (SELECT document_id, file_hash, CASE WHEN toxic = 1 THEN 'FAILED' ELSE 'PROCESSED' END AS st, doc_id % 5 AS retries, CASE WHEN quality = 0 THEN 'changed' ELSE file_hash END AS last FROM d WHERE quality IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY doc_id) = 1)
SELECT decision, count(*) AS n FROM (SELECT CASE WHEN r.document_id IS NULL THEN 'PROCESS' WHEN st = 'FAILED' AND retries < 3 THEN 'RETRY' WHEN st = 'FAILED' THEN 'REPROCESS' WHEN last = d.file_hash THEN 'SKIP' ELSE 'REPROCESS' END AS decision FROM d LEFT JOIN r ON r.document_id = d.document_id) GROUP BY decision"""
)
def registry_merge_decision(spark, sf_dir):
    docs = registry.identify(documents(spark, sf_dir)).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    incoming = docs.select("doc_id", "document_id", "file_hash")
    return registry.classify(incoming, _registry(docs)).groupBy("decision").agg(F.count("*").alias("n"))


VERSIONS = f"SELECT *, lag(document_id) OVER w AS supersedes, lead(document_id) OVER w AS superseded_by FROM (SELECT document_id, source, min(doc_id) AS ord FROM ({IDENTIFIED}) GROUP BY document_id, source) WINDOW w AS (PARTITION BY source ORDER BY ord, document_id)"


def _versions(spark, sf_dir):
    docs = registry.identify(documents(spark, sf_dir))
    return registry.supersede(docs.groupBy("document_id", F.col("source").alias("source_file")).agg(F.min("doc_id").alias("ord")))


@query(f"SELECT document_id, source AS source_file, ord, supersedes, superseded_by FROM ({VERSIONS})")
def version_chains(spark, sf_dir):
    """Documents of one source as versions of each other, linked in order."""
    return _versions(spark, sf_dir).select("document_id", "source_file", "ord", "supersedes", "superseded_by")


@query(f"SELECT doc_id, document_id FROM ({IDENTIFIED}) i WHERE document_id NOT IN (SELECT document_id FROM ({VERSIONS}) WHERE superseded_by IS NOT NULL)")
def superseded_purge(spark, sf_dir):
    docs = registry.identify(documents(spark, sf_dir)).select("doc_id", "document_id")
    return registry.purge(docs, _versions(spark, sf_dir))


@query("SELECT doc_id, source, lang, length(text) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT d.doc_id, 'labelled' AS source, lang, length(text) FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
def upsert_documents(spark, sf_dir):
    """Documents that have labels replaced by new rows, the others kept."""
    docs = documents(spark, sf_dir).select("doc_id", "source", "lang", F.length("text").alias("n"))
    new = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").withColumn("source", F.lit("labelled")).select("doc_id", "source", "lang", "n")
    return registry.upsert(docs, new, "doc_id")


# --- evaluation -----------------------------------------------------------------------------------


@query(f"WITH {GOLD} SELECT * FROM gold")
def verbatim_gold(spark, sf_dir):
    return evaluation.verbatim_gold(questions(spark, sf_dir), documents(spark, sf_dir))


@query(f"WITH {BM25},{DIVERSE},{GOLD},{PER_QUERY} SELECT {AVERAGES} FROM m")
def retrieval_metrics(spark, sf_dir):
    docs, q = documents(spark, sf_dir), questions(spark, sf_dir)
    return evaluation.retrieval_metrics(retrieval.topk(docs, q), evaluation.verbatim_gold(q, docs))


@query(f"WITH {BM25},{DIVERSE},{GOLD},{PER_QUERY}, a AS (SELECT m.*, {INTENT_SQL} AS intent, CASE WHEN length(text) > 200 THEN 'long' ELSE 'short' END AS length FROM m JOIN benchmark ON item_id = query_id) SELECT intent, length, {AVERAGES}, grouping(intent, length) AS grouping FROM a GROUP BY GROUPING SETS ((intent), (length), (intent, length), ())")
def metrics_grouping_sets(spark, sf_dir):
    docs, q = documents(spark, sf_dir), questions(spark, sf_dir)
    about = q.select("query_id", references.intent(F.col("question")).alias("intent"), F.when(F.length("question") > 200, "long").otherwise("short").alias("length"))
    return evaluation.metrics_by(retrieval.topk(docs, q), evaluation.verbatim_gold(q, docs), about, [["intent"], ["length"], ["intent", "length"], []])


@query(f"WITH {BM25},{DIVERSE}, e AS (SELECT r.rank, l.quality FROM ranked r LEFT JOIN labels l ON l.doc_id = r.doc_id) SELECT k, round(count(quality) / count(*), 6) AS covered, round(avg(CAST(quality AS DOUBLE)), 6) AS reliability FROM e JOIN (SELECT unnest([1, 5, 10]) AS k) ON rank <= k GROUP BY k")
def evidence_at_k(spark, sf_dir):
    ranked = retrieval.topk(documents(spark, sf_dir), questions(spark, sf_dir))
    return evaluation.evidence_at(ranked, table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("confidence")))


@query("SELECT CAST(floor(n_chars / 50) * 50 AS BIGINT) AS bucket, count(*) AS n FROM documents GROUP BY bucket")
def length_histogram(spark, sf_dir):
    return evaluation.histogram(documents(spark, sf_dir), F.col("n_chars"), 50)


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '|42'), doc_id) AS r, greatest(1, round(count(*) OVER (PARTITION BY lang) * 0.1)) AS want FROM documents) WHERE r <= want")
def stratified_sample(spark, sf_dir):
    return evaluation.stratified(documents(spark, sf_dir).select("doc_id", "lang"), "lang", "doc_id", 0.1)


@query("WITH c AS (SELECT sha256(text) AS h, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY h), k AS (SELECT DISTINCT sha256(text) AS h FROM (SELECT text FROM documents WHERE source = 'src0' UNION ALL SELECT text FROM benchmark) WHERE text IS NOT NULL) SELECT CAST(sum(n) AS BIGINT) AS total, count(c.h) AS distinct_keys, count(c.h) FILTER (k.h IS NOT NULL) AS matched, count(c.h) FILTER (k.h IS NULL) AS missing, count(k.h) FILTER (c.h IS NULL) AS orphaned, round(100.0 * count(c.h) FILTER (k.h IS NOT NULL) / count(c.h), 2) AS percent FROM c FULL JOIN k ON c.h = k.h")
def cache_coverage(spark, sf_dir):
    """A cache that knows one source's texts, and benchmark texts that no document has."""
    hashed = lambda df: df.where(F.col("text").isNotNull()).select(F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    docs = documents(spark, sf_dir)
    return evaluation.coverage(hashed(docs), hashed(docs.where(F.col("source") == "src0")).unionByName(hashed(table(spark, sf_dir, "benchmark"))))


@query(
    """
WITH p AS (SELECT user_id, event_id, CAST(epoch_us(ts) AS DOUBLE) / 1e6 AS at FROM events WHERE event_type = 'click'), t AS (SELECT user_id, CAST(epoch_us(ts) AS DOUBLE) / 1e6 AS at FROM events WHERE event_type = 'view')
SELECT event_id, round(least(abs(p.at - (SELECT max(t.at) FROM t WHERE t.user_id = p.user_id AND t.at <= p.at)), abs((SELECT min(t.at) FROM t WHERE t.user_id = p.user_id AND t.at >= p.at) - p.at)), 3) AS distance FROM p"""
)
def nearest_event(spark, sf_dir):
    """Seconds from each click to the user's nearest view."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    clicks, views = events.where("event_type = 'click'").drop("event_type"), events.where("event_type = 'view'").select("user_id", "at")
    return evaluation.nearest_distance(clicks, views, ["user_id"]).select("event_id", F.round("distance", 3).alias("distance"))


@query("SELECT o.o_orderkey, o.o_custkey, count(*) AS near FROM orders o JOIN orders p ON o.o_custkey = p.o_custkey AND o.o_orderkey <> p.o_orderkey AND abs(o.o_orderkey - p.o_orderkey) <= 200 GROUP BY ALL")
def band_join(spark, sf_dir):
    """Orders of one customer whose keys differ by at most 200: an equi-join with a band as its residual."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    p = o.select(F.col("o_orderkey").alias("k"), "o_custkey")
    near = evaluation.band_join(o, p, ["o_custkey"], "o_orderkey", 200, "k").where(F.col("o_orderkey") != F.col("k"))
    return near.groupBy("o_orderkey", "o_custkey").agg(F.count("*").alias("near"))


@query("WITH a AS (SELECT lang AS metric, avg(n_chars) / 1000 AS v FROM documents WHERE doc_id % 2 = 0 GROUP BY lang), b AS (SELECT lang AS metric, avg(n_chars) / 1000 AS v FROM documents WHERE doc_id % 2 = 1 GROUP BY lang) SELECT coalesce(a.metric, b.metric) AS metric, round(a.v, 6) AS now, round(b.v, 6) AS then, round(round(a.v, 6) - round(b.v, 6), 6) AS delta, CASE WHEN a.v IS NULL OR b.v IS NULL THEN 'missing' WHEN round(round(a.v, 6) - round(b.v, 6), 6) < -0.05 THEN 'regressed' WHEN round(round(a.v, 6) - round(b.v, 6), 6) > 0.05 THEN 'improved' ELSE 'stable' END AS status FROM a FULL JOIN b ON a.metric = b.metric")
def regression_flags(spark, sf_dir):
    """Mean length by language in even against odd documents, as two runs to compare."""
    side = lambda r: documents(spark, sf_dir).where(F.col("doc_id") % 2 == r).groupBy(F.col("lang").alias("metric")).agg(F.round(F.avg("n_chars") / 1000, 6).alias("value"))
    return evaluation.regression(side(0), side(1))


@query("SELECT l_returnflag, round(avg(l_extendedprice), 2) AS mean, round(median(l_extendedprice), 2) AS median, min(l_extendedprice) AS least, max(l_extendedprice) AS most, round(avg(CAST(l_discount > 0.05 AS DOUBLE)), 6) AS success FROM lineitem GROUP BY l_returnflag")
def timing_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("ok", F.col("l_discount") > 0.05)
    return evaluation.timing(rows, "l_extendedprice", "ok", ["l_returnflag"]).withColumns({"mean": F.round("mean", 2), "median": F.round("median", 2)})


# --- operation ------------------------------------------------------------------------------------

GAPS = "SELECT user_id, event_type, epoch_us(ts) AS at, (epoch_us(ts) - lag(epoch_us(ts)) OVER ({p} ORDER BY ts)) / 1e6 AS gap FROM events WHERE ts IS NOT NULL"


@query(f"SELECT round(coalesce(sum(gap) FILTER (gap > 0 AND gap <= 300), 0.0), 3) AS active_s, count(*) FILTER (event_type = 'purchase') AS finished, round(count(*) FILTER (event_type = 'purchase') / sum(gap) FILTER (gap > 0 AND gap <= 300), 6) AS per_second FROM ({GAPS.format(p='')})")
def throughput(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return monitor.throughput(events, F.col("event_type") == "purchase", gap=300)


@query(f"SELECT user_id, round(coalesce(sum(gap) FILTER (gap > 0 AND gap <= 3600), 0.0), 3) AS active_s, count(*) FILTER (event_type = 'purchase') AS finished, CASE WHEN sum(gap) FILTER (gap > 0 AND gap <= 3600) > 0 AND count(*) FILTER (event_type = 'purchase') > 0 THEN round(count(*) FILTER (event_type = 'purchase') / sum(gap) FILTER (gap > 0 AND gap <= 3600), 6) END AS per_second FROM ({GAPS.format(p='PARTITION BY user_id')}) GROUP BY user_id")
def throughput_by_user(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return monitor.throughput(events, F.col("event_type") == "purchase", ["user_id"], gap=3600)


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value > 10) AS done FROM events GROUP BY event_type")
def event_counts(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("status", F.when(F.col("value") > 10, "DONE").otherwise("OPEN"))
    return monitor.event_counts(events, "event_type")


@query("SELECT doc_id, source, lang, n_chars FROM documents WHERE (contains(lower(coalesce(source, '')), 'src1') OR contains(lower(coalesce(lang, '')), 'src1')) AND lang = 'en'")
def library_search(spark, sf_dir):
    return monitor.library_search(documents(spark, sf_dir).select("doc_id", "source", "lang", "n_chars"), "SRC1", ["source", "lang"], ("lang", "en"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 20 OFFSET 40")
def library_page(spark, sf_dir):
    return monitor.page(documents(spark, sf_dir).select("doc_id", "n_chars"), 3, 20, F.desc_nulls_last("n_chars"), F.col("doc_id"))


@query("SELECT lang, source, count(*) AS n, round(avg(n_chars), 2) AS mean_chars, grouping(lang, source) AS level FROM documents GROUP BY GROUPING SETS ((lang), (source), (lang, source), ())")
def corpus_breakdown(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return docs.groupingSets([[F.col("lang")], [F.col("source")], [F.col("lang"), F.col("source")], []], F.col("lang"), F.col("source")).agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 2).alias("mean_chars"), F.grouping_id().alias("level"))
