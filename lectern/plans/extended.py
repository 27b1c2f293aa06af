"""Further registered queries: places and references, structure, corpus building, gold sets, reports.

The tables have no places or paged text of their own; where an operator needs them, they follow from ids by plain
arithmetic that the SQL repeats, so that every row has a known right answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import lexicon
from lectern.functions import names, quality, references, text
from lectern.operators import corpus, evaluation, registry, reports, retrieval, structure
from lectern.plans.queries import BM25, BM25_OF_Q, DIVERSE, HYBRID, IDENTIFIED, NOISE_FROM, NOISE_TXT, NOISE_TYPE, S_BASIC, S_COUNT, S_LINES, S_STRIP, SYM, TFIDF, documents, query, questions, table

CODES = list(lexicon.CHAPTERS)
NAMES = [lexicon.BOOKS[c] for c in CODES]
N = len(CODES)


def pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def sql_pick(values: list[str], at: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][CAST({at} % {len(values)} AS INTEGER) + 1]"


def placed_documents(spark, sf_dir) -> DataFrame:
    """Documents with a book, a chapter (1 to 20) and a confidence (null for every third)."""
    i = F.col("doc_id")
    return documents(spark, sf_dir).select("doc_id", "text", "source", pick(CODES, i).alias("book_id"), (i % 20 + 1).cast("int").alias("chapter"), F.when(i % 3 != 0, (i % 10) / 10.0).alias("confidence"))


PLACED = f"p AS (SELECT doc_id, {sql_pick(CODES, 'doc_id')} AS book_id, CAST(doc_id % 20 + 1 AS INTEGER) AS chapter, CASE WHEN doc_id % 3 <> 0 THEN (doc_id % 10) / 10.0 END AS confidence FROM documents)"


#: What questions begin with, by turns; the references that are in it, and those of them that a passage's reading finds. "c" is a chapter of 1 to 40, so that some fit no passage.
KINDS = [
    ("", [], []),
    ("Concerning Romans {c}:3 ", [("ROM", "c", 3, None)], [("ROM", "c")]),
    ("See Mk {c}:4-6, ", [("MRK", "c", 4, 6)], []),
    ("요한복음 {c}장 16절은 ", [("JHN", "c", 16, 16)], []),
    ("로마서 {c}장에서 ", [("ROM", "c", 0, None)], []),
    ("First Corinthians and II Kings on ", [], []),
    ("Mark {c} and Acts {c} on ", [("MRK", "c", 0, None), ("ACT", "c", 0, None)], []),
    ("요3:16 ", [("JHN", 3, 16, None)], []),
    ("필요한가 마가복음을 ", [], []),
    ("고후 {c}장과 역대하의 ", [("2CO", "c", 0, None)], []),
    ("Is 2 Cor {c}:1 or Acts {c}:2 ", [("ACT", "c", 2, None), ("2CO", "c", 1, None)], [("ACT", "c")]),
]


def placed_questions(spark, sf_dir) -> DataFrame:
    """Questions that begin by turns with references and names of all kinds, as ``KINDS`` has them."""
    q = questions(spark, sf_dir)
    i = F.col("query_id")
    about = F.replace(pick([k for k, _, _ in KINDS], i), F.lit("{c}"), (i % 40 + 1).cast("string"))
    return q.withColumn("question", F.concat(about, F.col("question")))


def _sql_structs(rows: list[dict]) -> str:
    return "[" + ", ".join("{" + ", ".join(f"'{k}': '{v}'" for k, v in r.items()) + "}" for r in rows) + "]"


def _sql_refs(at: int) -> str:
    """Per kind its references as a list of structs; all lists have one type."""
    value = lambda x: "c" if x == "c" else "CAST(NULL AS INTEGER)" if x is None else f"'{x}'" if isinstance(x, str) else f"CAST({x} AS INTEGER)"
    ref = lambda r: "{" + ", ".join(f"'{k}': {value(x) if k != 'b' else chr(39) + x + chr(39)}" for k, x in zip("bcvw", r)) + "}"
    return "CASE query_id % " + str(len(KINDS)) + " " + " ".join(f"WHEN {k} THEN [{', '.join(map(ref, kind[at]))}]" for k, kind in enumerate(KINDS) if kind[at]) + " ELSE [] END"


CLAIMS = sorted(dict.fromkeys(n for n, _ in lexicon.SPELLINGS if len(n) > 1), key=lambda n: -len(n))
CLAIM_MAP = "MAP {" + ", ".join(f"'{n}': '{c}'" for n, c in {n: c for n, c in reversed(lexicon.SPELLINGS) if len(n) > 1}.items()) + "}"
PLACED_Q = f"q AS (SELECT item_id AS query_id, replace({sql_pick([k for k, _, _ in KINDS], 'item_id')}, '{{c}}', CAST(item_id % 40 + 1 AS VARCHAR)) || text AS question FROM benchmark),"
NAMED = f"list_distinct(list_transform(regexp_extract_all(trim(regexp_replace(low, '[0-9]+장|[0-9]+\\s*:?\\s*[0-9]*', '', 'g')), '(?:^|[^\\p{{L}}\\p{{N}}])({'|'.join(CLAIMS)})', 1), lambda n: {CLAIM_MAP}[n]))"
BY_NUMBER = _sql_structs([{"c": c, "p": p.pattern} for p, c in names.NUMBERED])
FULL_KOREAN = _sql_structs([{"c": c, "n": n} for n, c in lexicon.KOREAN_FULL.items()])
SPELLED_KOREAN = _sql_structs([{"c": c, "n": n} for n, c in lexicon.ALIAS_TO_BOOK.items() if len(n) > 1 and n[0] >= "가"])
ANYWHERE = _sql_structs([{"c": c, "n": n} for n, c in [*lexicon.NUMBERED_NAMES.items(), *lexicon.KOREAN_NUMBERED.items()]])
PLACED_QB = f"""named AS (SELECT query_id, CAST(query_id % 40 + 1 AS INTEGER) AS c, low, {NAMED} AS claimed, list_transform(list_filter({BY_NUMBER}, lambda x: regexp_matches(low, x.p)), lambda x: x.c) AS numbered, list_transform(list_filter({FULL_KOREAN}, lambda x: contains(low, x.n)), lambda x: x.c) AS full_korean,
  list_transform(list_filter({SPELLED_KOREAN}, lambda x: contains(low, x.n) AND (instr(low, x.n) = 1 OR NOT regexp_matches(low[instr(low, x.n) - 1], '[\\p{{L}}\\p{{N}}]'))), lambda x: x.c) AS korean, list_transform(list_filter({ANYWHERE}, lambda x: contains(low, x.n) AND length(x.n) >= CASE WHEN regexp_matches(low, '[가-힣]') THEN 6 ELSE 3 END), lambda x: x.c) AS anywhere
  FROM (SELECT query_id, lower(coalesce(question, '')) AS low FROM q)),
qb AS (SELECT query_id, refs, score_refs, list_distinct(list_concat(list_transform(refs, lambda r: r.b), claimed, numbered, full_korean, korean, anywhere)) AS books FROM (SELECT *, {_sql_refs(1)} AS refs, {_sql_refs(2)} AS score_refs FROM named))"""


@query(f"WITH {PLACED_Q}{BM25_OF_Q},{TFIDF},{PLACED_QB},{PLACED},{HYBRID}")
def hybrid_rank_places(spark, sf_dir):
    """The whole ranking with books, chapter bands, alignment and evidence."""
    return retrieval.rank_hybrid(placed_documents(spark, sf_dir), placed_questions(spark, sf_dir))


@query(f"WITH {PLACED_Q}{PLACED_QB},{PLACED} SELECT qb.query_id, count(*) AS n, min(p.doc_id) AS first_doc FROM qb JOIN p ON list_contains(qb.books, p.book_id) AND (len(qb.refs) = 0 OR len(list_filter(qb.refs, lambda r: r.b = p.book_id AND abs(p.chapter - r.c) <= 2)) > 0) GROUP BY qb.query_id")
def metadata_pool(spark, sf_dir):
    """How many passages each question's books and references leave."""
    pairs = retrieval.metadata_filter(placed_documents(spark, sf_dir), retrieval.asked_questions(placed_questions(spark, sf_dir)))
    return pairs.groupBy("query_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query(f"WITH {PLACED_Q}{PLACED_QB} SELECT query_id, array_to_string(list_sort(books), ' ') AS books, coalesce(array_to_string(list_transform(refs, lambda r: r.b || ' ' || r.c || CASE WHEN r.v > 0 THEN ':' || r.v || coalesce('-' || r.w, '') ELSE '' END), ' '), '') AS refs FROM qb")
def parse_questions(spark, sf_dir):
    """Books and references that each question names."""
    rows = retrieval.asked_questions(placed_questions(spark, sf_dir))
    shown = F.transform("refs", lambda r: references.reference_text(r["book_id"], r["chapter"], r["verse_start"], r["verse_end"]))
    return rows.select("query_id", F.array_join(F.array_sort("books"), " ").alias("books"), F.array_join(shown, " ").alias("refs"))


def cited_text(i: Column) -> Column:
    """Passages that cite two places: one of a book that is known, once or twice, and one beyond its last chapter."""
    first = F.concat(pick(NAMES, i), F.lit(" "), (i % 16 + 1).cast("string"), F.lit(":4"), F.when(i % 3 == 0, "-6").otherwise(""))
    return F.concat(F.lit("as in "), pick(NAMES, i + 3), F.lit(" 99:1 and "), first, F.when(i % 2 == 0, F.concat(F.lit("; again "), first)).otherwise(""), F.lit(" it says"))


@query(
    f"""WITH c AS (SELECT doc_id, {sql_pick(CODES, 'doc_id')} AS own, {sql_pick(CODES, '(doc_id + 3)')} AS other, CAST(doc_id % 16 + 1 AS INTEGER) AS ch FROM documents),
s AS (SELECT doc_id, own, other, ch, round(CASE WHEN ch <= MAP {{{', '.join(f"'{b}': {n}" for b, n in lexicon.CHAPTERS.items())}}}[own] THEN 0.3 ELSE 0.0 END + 0.2 + CASE WHEN doc_id % 3 = 0 THEN 0.1 ELSE 0.0 END + 0.2 + CASE WHEN doc_id % 5 = 0 THEN 0.2 ELSE 0.0 END, 4) AS mine, 0.4 AS theirs FROM c)
SELECT doc_id, CASE WHEN mine > theirs THEN mine ELSE theirs END AS score, CASE WHEN mine > theirs THEN own || ' ' || ch || ':4' || CASE WHEN doc_id % 3 = 0 THEN '-6' ELSE '' END ELSE other || ' 99:1' END AS ref FROM s"""
)
def best_evidence(spark, sf_dir):
    """The reference with most evidence in whole texts that cite two places in their middle; every fifth passage's file is of the first one's book."""
    i = F.col("doc_id")
    half = F.floor(F.length("text") / 2).cast("int")
    body = lambda begin, n: F.coalesce(F.substring("text", begin, n), F.lit(""))
    t = F.concat(body(F.lit(1), half), F.lit(" "), cited_text(i), F.lit(" "), body(half + 1, F.length("text")))
    rows = documents(spark, sf_dir).select("doc_id", t.alias("t"), F.when(i % 5 == 0, pick(CODES, i)).alias("book"))
    # found once, in a column that the evidence looks at many times
    found = rows.select("doc_id", "book", references.question_references(F.col("t")).alias("refs"))
    best = found.select("doc_id", references.evidence(F.col("refs"), F.col("book")).alias("e"))
    r = F.col("e.ref")
    return best.select("doc_id", "e.score", references.reference_text(r["book_id"], r["chapter"], r["verse_start"], r["verse_end"]).alias("ref"))


# --- structure ------------------------------------------------------------------------------------


def spans(spark, sf_dir) -> DataFrame:
    """Lines of documents as lines of pages, every other one cut after its eighth word: every seventh is larger, every fifth bold; documents with an even id have no larger ones."""
    rows = documents(spark, sf_dir).where(F.col("text").isNotNull()).select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "text"))
    at, even = F.col("at"), F.col("doc_id") % 2 == 0
    return rows.select("doc_id", F.when(at % 2 == 0, F.col("text")).otherwise(F.substring_index("text", " ", 8)).alias("text"), F.when((at % 7 == 3) & ~even, 14.0).otherwise(10.0).alias("size"), (at % 5 == 1).alias("bold"), F.floor(at / 40).cast("int").alias("page"), (at % 3 == 0).alias("is_block_top"))


SPANS = """sp AS (SELECT doc_id, CASE WHEN pos % 2 = 0 THEN text ELSE array_to_string(string_split(text, ' ')[1:8], ' ') END AS text, CASE WHEN pos % 7 = 3 AND doc_id % 2 = 1 THEN 14.0 ELSE 10.0 END AS size, pos % 5 = 1 AS bold, pos // 40 AS page, pos % 3 = 0 AS top
  FROM (SELECT doc_id, unnest(x) AS text, generate_subscripts(x, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)) WHERE text <> ''),
bs AS (SELECT doc_id, size, sum(length(text)) AS n, min(page) AS page FROM sp GROUP BY ALL), body AS (SELECT doc_id, size AS body FROM bs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, page, size) = 1),
ln AS (SELECT sp.*, body, CASE WHEN length(trim(text)) > 0 THEN len(regexp_extract_all(text, '[가-힣A-Za-z]')) / length({strip}) ELSE 0.0 END AS ratio FROM sp JOIN body USING (doc_id)),
pr AS (SELECT doc_id, body, count(*) FILTER (length(text) < 80 AND ratio >= 0.6 AND size > body * 1.15) AS size_hits, count(*) FILTER (length(text) < 80 AND ratio >= 0.6 AND bold AND size = body) AS bold_hits FROM ln GROUP BY ALL),
pf AS (SELECT *, CASE WHEN greatest(size_hits, bold_hits) < 3 THEN NULL WHEN bold_hits >= size_hits THEN 'bold' ELSE 'size' END AS signal FROM pr)""".replace("{strip}", S_STRIP("text"))


@query(f"WITH {SPANS} SELECT * FROM pf")
def page_profiles(spark, sf_dir):
    return structure.page_profile(spans(spark, sf_dir)).select("doc_id", "body", "size_hits", "bold_hits", "signal")


@query(
    f"""WITH {SPANS}, c AS (SELECT ln.*, signal FROM ln JOIN pf USING (doc_id) WHERE length(text) < 80 AND ratio >= 0.6 AND CASE signal WHEN 'size' THEN size > ln.body * 1.15 WHEN 'bold' THEN bold AND size = ln.body END)
SELECT signal, round(0.5 * CASE WHEN signal = 'size' THEN least((size / body - 1.0) / 0.5, 1.0) ELSE 0.8 END + 0.4 * ratio + 0.1 * CASE WHEN length(text) < 40 AND top THEN 0.2 WHEN length(text) < 40 OR top THEN 0.1 ELSE 0.0 END, 2) AS confidence, count(*) AS n FROM c GROUP BY ALL"""
)
def page_headings(spark, sf_dir):
    """Confidences of headings in lines taken as pages."""
    found = structure.page_headings(spans(spark, sf_dir))
    return found.groupBy("signal", text.rounded(F.col("confidence"), 2).alias("confidence")).agg(F.count("*").alias("n"))


KOREAN_ENDS = "(다|니다|요|이다|했다|하였다|됩니다|입니다|같다|라고|하며|하면|하지만|그래서|그러나)$"


@query(
    f"""WITH p AS (SELECT doc_id, {S_STRIP('t')} AS t FROM (SELECT doc_id, unnest(string_split_regex(text, '\\n\\n+')) AS t FROM documents)), l AS (SELECT *, {S_LINES('t')} AS ls FROM p),
f AS (SELECT *, CASE WHEN t <> '' THEN 30.0 ELSE 0.0 END + CASE WHEN length(t) < 80 THEN -60.0 ELSE 0.0 END + CASE WHEN len(ls) > 0 AND (regexp_matches(ls[-1], '[.!?。！？]') OR regexp_matches(ls[-1], '{KOREAN_ENDS}')) THEN 10.0 ELSE 0.0 END + CASE WHEN length(t) % 3 = 0 THEN 100.0 ELSE 0.0 END AS score FROM l)
SELECT score, score >= 50 AS is_boundary, count(*) AS n FROM f GROUP BY ALL"""
)
def boundary_scores(spark, sf_dir):
    """Scores of paragraphs as boundaries; every third length stands for a heading that was found."""
    rows = documents(spark, sf_dir).select("doc_id", F.explode(F.split("text", r"\n\n+")).alias("text"))
    rows = rows.withColumn("text", text.strip(F.col("text"))).withColumn("met", F.length("text") % 3 == 0)
    return structure.boundary_candidates(rows, "text", "met").groupBy("score", "is_boundary").agg(F.count("*").alias("n"))


@query()
def structure_report(spark, sf_dir):
    """Hierarchical chunks of all documents against the production chunks, by profile; the first words of every tenth line are the headings."""
    docs = documents(spark, sf_dir)
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).where("at % 10 = 0")
    heads = lines.select("doc_id", "at", F.array_join(F.slice(F.split("line", " "), 1, 3), " ").alias("title"))
    return structure.structure_metrics(structure.structured_chunks(docs, heads))


MD = "'# Title ' || doc_id || chr(10) || coalesce(text, '') || chr(10) || '## End' || chr(10) || 'last'"


def marked_down(spark, sf_dir) -> DataFrame:
    t = F.concat(F.lit("# Title "), F.col("doc_id").cast("string"), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n## End\nlast"))
    return documents(spark, sf_dir).select("doc_id", t.alias("t"))


@query(f"WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace({MD}, '(?m)^(#{{1,3}}[ \\t])', chr(1) || '\\1', 'g'), chr(1)), lambda x: {S_STRIP('x')}), lambda x: x <> '') AS x FROM documents) SELECT doc_id, len(x) AS sections, md5(x[1]) AS first_digest, md5(x[-1]) AS last_digest FROM s")
def markdown_sections(spark, sf_dir):
    rows = marked_down(spark, sf_dir).select("doc_id", text.sections(F.col("t")).alias("x"))
    digest = lambda at: F.md5(F.element_at("x", at).cast("binary"))
    return rows.select("doc_id", F.size("x").alias("sections"), digest(1).alias("first_digest"), digest(-1).alias("last_digest"))


@query(f"SELECT doc_id, array_to_string(list_transform(h, lambda x: length(regexp_extract(x, '^#+')) || ':' || regexp_replace(regexp_replace(x, '^#{{1,6}}[ \\t]+', ''), '[ \\t]*#*[ \\t]*$', '')), '|') AS headings FROM (SELECT doc_id, regexp_extract_all({MD}, '(?m)^(#{{1,6}}[ \\t]+.+?[ \\t]*#*[ \\t]*)$') AS h FROM documents)")
def markdown_headings(spark, sf_dir):
    rows = marked_down(spark, sf_dir).select("doc_id", text.headings(F.col("t")).alias("h"))
    return rows.select("doc_id", F.array_join(F.transform("h", lambda h: F.concat(h["level"].cast("string"), F.lit(":"), h["title"])), "|").alias("headings"))


@query("SELECT doc_id, 'Doc: ' || doc_id AS title, source AS source, doc_id % 2 = 0 AS known FROM documents")
def front_matter(spark, sf_dir):
    """Keys of a header in front of each text; a repeated key keeps its last value."""
    i = F.col("doc_id").cast("string")
    t = F.concat(F.lit("---\ntitle: old\nsource:  "), F.coalesce("source", F.lit("")), F.lit(" \n"), F.when(F.col("doc_id") % 2 == 0, "known: yes\n").otherwise("no pair here\n"), F.lit("title: Doc: "), i, F.lit("\n---\n"), F.coalesce("text", F.lit("")))
    m = text.front_matter(F.col("t"))
    return documents(spark, sf_dir).select("doc_id", t.alias("t")).select("doc_id", m["title"].alias("title"), F.nullif(m["source"], F.lit("")).alias("source"), m["known"].isNotNull().alias("known"))


# without look-around, which the checking engine lacks
FRONT_WORDS = text.FRONT_WORDS.replace(f"(?<![{text.WORD}])", f"(^|[^{text.WORD}])").replace(f"(?![{text.WORD}])", f"($|[^{text.WORD}])")
FRONT_PAGE = f"({S_STRIP('p')} = '' OR regexp_matches({S_STRIP('p')}, '{FRONT_WORDS}') OR (length({S_STRIP('p')}) < 400 AND len(list_filter({S_LINES('p')}, lambda x: length(x) <= 3)) / greatest(len({S_LINES('p')}), 1) > 0.3))"


@query(
    f"""WITH l AS (SELECT doc_id, string_split(CASE WHEN doc_id % 3 = 0 THEN 'Copyright ' || doc_id || chr(10) || 'a' || chr(10) ELSE '' END || coalesce(text, ''), chr(10)) AS ls FROM documents),
g AS (SELECT doc_id, k, array_to_string(ls[3 * k + 1:3 * k + 3], chr(10)) AS p, len(ls) > 3 AS several FROM (SELECT doc_id, ls, unnest(range(CAST(ceil(len(ls) / 3) AS BIGINT))) AS k FROM l)),
j AS (SELECT *, k < {text.MAX_FRONT_PAGES} AND {FRONT_PAGE} AS front FROM g), w AS (SELECT *, CASE WHEN bool_and(front) OVER (PARTITION BY doc_id) THEN k = 0 ELSE front END AS f, {S_STRIP('p')} AS q FROM j)
SELECT doc_id, md5(CASE WHEN bool_or(several) THEN coalesce(string_agg(q, chr(10) || chr(10) ORDER BY k) FILTER (f AND q <> ''), '') ELSE '' END) AS front, md5(CASE WHEN bool_or(several) THEN coalesce(string_agg(q, chr(10) || chr(10) ORDER BY k) FILTER (NOT f AND q <> ''), '') ELSE string_agg(p, '') END) AS body, count(*) AS pages FROM w GROUP BY doc_id"""
)
def front_pages(spark, sf_dir):
    """Front matter and body of all documents, three lines a page; every third has a line of copyright in front."""
    i = F.col("doc_id")
    head = F.when(i % 3 == 0, F.concat(F.lit("Copyright "), i.cast("string"), F.lit("\na\n"))).otherwise("")
    rows = documents(spark, sf_dir).select("doc_id", F.split(F.concat(head, F.coalesce("text", F.lit(""))), "\n").alias("ls"))
    rows = rows.withColumn("pages", F.transform(F.sequence(F.lit(0), F.ceil(F.size("ls") / 3).cast("int") - 1), lambda k: F.array_join(F.slice("ls", 3 * k + 1, 3), "\n")))
    found = rows.select("doc_id", F.size("pages").cast("long").alias("pages"), text.split_front_pages(F.array_join("pages", "\f")).alias("p"))
    digest = lambda c: F.md5(F.col(c).cast("binary"))
    return found.select("doc_id", digest("p.front").alias("front"), digest("p.body").alias("body"), "pages")


# --- corpus ---------------------------------------------------------------------------------------

FILE = f"CASE WHEN doc_id % 3 = 0 THEN lower({sql_pick(NAMES, 'doc_id')}) || ' notes ' ELSE 'volume ' END || doc_id || '.txt'"
OF_NOISE = lambda field: f"MAP {{{', '.join(f"{chr(39)}{n}{chr(39)}: {chr(39) + str(p[field]) + chr(39) if isinstance(p[field], str) else p[field]}" for n, p in quality.NOISE_TYPES.items())}}}[noise_type]"


@query(
    f"""WITH r AS (SELECT doc_id, lang, source, 'd' || doc_id AS document_id, {FILE} AS f, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE doc_id % 4 + 1 END AS n, CASE WHEN doc_id % 3 = 0 THEN {sql_pick(CODES, 'doc_id')} END AS b, CAST(doc_id % 30 + 1 AS INTEGER) AS ch,
  CASE WHEN doc_id % 2 = 0 THEN 'See ' || {sql_pick(NAMES, 'doc_id')} || ' ' || (doc_id % 30 + 1) || ':4-6. ' ELSE '' END || coalesce(text, '') AS whole FROM documents),
k AS (SELECT *, unnest(range(n)) AS i, CAST(ceil(length(whole) / n) AS BIGINT) AS step FROM r WHERE n > 0),
c AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN whole ELSE whole[step * i + 1:step * (i + 1)] END AS text, doc_id % 2 = 0 AND (i = 0 OR doc_id % 5 = 0) AS cited FROM k),
m AS (SELECT *, CASE WHEN length(c) > 0 THEN {S_COUNT('c', SYM)} / length(c) ELSE 0.0 END AS sym, CASE WHEN len(ls) > 0 THEN len(list_filter(ls, lambda l: length(l) <= 3)) / len(ls) ELSE 0.0 END AS short FROM (SELECT *, {S_LINES('c')} AS ls FROM (SELECT *, {S_BASIC('text')} AS c FROM c))),
t AS (SELECT *, b IS NOT NULL AND cited AS known, {NOISE_TYPE} AS noise_type FROM m)
SELECT 'TSU-' || coalesce(b, 'UNK') || '-' || document_id || '_chunk_0000' || i AS tsu_id, document_id, document_id || '_chunk_0000' || i AS chunk_id, CAST(i AS INTEGER) AS chunk_index, md5(text) AS digest, b AS book_id, CASE WHEN known THEN ch || ':4-6' ELSE '' END AS verses,
  CASE WHEN known THEN CASE WHEN ch <= MAP {{{', '.join(f"'{b}': {n}" for b, n in lexicon.CHAPTERS.items())}}}[b] THEN 1.0 ELSE 0.7 END END AS confidence, CASE WHEN known THEN 2 ELSE 0 END AS candidates, 'Volume ' || doc_id AS title, source AS author, f AS source_file, lang AS language, 'txt' AS source_type,
  noise_type, {OF_NOISE(1)} AS quality_score, {OF_NOISE(2)} AS section_type FROM t"""
)
def passage_records(spark, sf_dir):
    """Every column of the passages of registered documents: equal parts of the whole text, or the whole text for each part of every fifth; empty documents have none.

    Every other text begins with a reference; every third file is named after a book.
    """
    i = F.col("doc_id")
    name = F.concat(F.when(i % 3 == 0, F.concat(F.lower(pick(NAMES, i)), F.lit(" notes "))).otherwise("volume "), i.cast("string"), F.lit(".txt"))
    body = F.coalesce("text", F.lit(""))
    cited = F.when(i % 2 == 0, F.concat(F.lit("See "), pick(NAMES, i), F.lit(" "), (i % 30 + 1).cast("string"), F.lit(":4-6. "))).otherwise("")
    reg = documents(spark, sf_dir).select(
        "doc_id", F.concat(F.lit("d"), i.cast("string")).alias("document_id"), name.alias("source_file"), F.concat(cited, body).alias("text"), F.when(body == "", 0).otherwise(i % 4 + 1).cast("int").alias("chunk_count"), F.concat(F.lit("Volume "), i.cast("string")).alias("title"), F.col("source").alias("author"), F.col("lang").alias("language"),
        F.lit("txt").alias("source_type"),
    )
    parts = reg.where((i % 5 != 0) & (F.col("chunk_count") > 0)).withColumn("step", F.ceil(F.length("text") / F.col("chunk_count")).cast("int")).select("source_file", "text", "step", F.explode(F.sequence(F.lit(0), F.col("chunk_count") - 1)).alias("chunk_index"))
    chunks = parts.select("source_file", "chunk_index", F.substring("text", F.col("step") * F.col("chunk_index") + 1, F.col("step")).alias("chunk"), F.substring("text", F.col("step") * (F.col("chunk_index") + 1) + 1, F.lit(references.LONGEST)).alias("ahead"))
    rows = corpus.chunk_texts(reg.select("document_id", "source_file", "chunk_count"), chunks, reg.select("source_file", "text"))
    records = corpus.passages(reg.drop("doc_id", "text", "chunk_count"), rows.withColumn("digest", F.md5(F.col("content").cast("binary"))))
    verses = F.coalesce(F.format_string("%d:%d-%d", "chapter", "verse_start", "verse_end"), F.lit(""))
    shown = records.withColumns({"verses": F.when(F.col("chapter").isNull(), "").otherwise(verses), "candidates": F.coalesce("candidates", F.lit(0))})
    return shown.drop("content", "chapter", "verse_start", "verse_end")


@query("WITH c AS (SELECT conv_id, text FROM conversations), n AS (SELECT conv_id, count(*) AS total, count(*) FILTER (trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(13)) = '') AS empty, count(*) FILTER (trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(13)) <> '' AND length(trim(text, chr(32) || chr(9) || chr(10) || chr(13))) < 80) AS short FROM c GROUP BY conv_id) SELECT conv_id, total + conv_id % 2 AS declared, total, empty, short, empty = 0 AND conv_id % 2 = 0 AS valid FROM n")
def chunk_validation(spark, sf_dir):
    """Turns taken as chunks; every other conversation declares one too many."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("text").alias("chunk"))
    declared = rows.groupBy("conv_id").agg((F.count("*") + F.col("conv_id") % 2).alias("chunks"))
    return corpus.validate_chunks(rows, declared, "conv_id").select("conv_id", "declared", "total", "empty", "short", "valid")


@query(f"SELECT doc_id, {NOISE_TXT} AS noise FROM {NOISE_FROM} WHERE length({S_STRIP('coalesce(text, $$$$)')}) >= 80 AND {NOISE_TXT} < 60")
def worth_indexing(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.col("text").alias("chunk")).withColumn("noise", quality.noise_score(F.col("chunk"), "txt"))
    return corpus.worth_indexing(rows, F.col("noise")).select("doc_id", "noise")


@query(f"WITH i AS ({IDENTIFIED}), old AS (SELECT DISTINCT document_id, file_hash FROM i WHERE doc_id % 3 = 0), new AS (SELECT document_id, min(doc_id) AS doc FROM i WHERE document_id NOT IN (SELECT document_id FROM old) AND file_hash NOT IN (SELECT file_hash FROM old) GROUP BY document_id) SELECT document_id, doc AS ord FROM new")
def register_new(spark, sf_dir):
    """Documents that a registry of every third one does not know, each once."""
    docs = registry.identify(documents(spark, sf_dir)).select("document_id", "file_hash", F.col("source").alias("source_file"), F.col("doc_id").alias("ord"))
    known = registry.migrate(docs.where("ord % 3 = 0").dropDuplicates(["document_id"]).withColumn("ord", F.lit(-1).cast("long")))
    return registry.register(known, docs).where("ord >= 0").select("document_id", "ord")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'kept' WHEN doc_id % 5 = 0 THEN NULL ELSE source END AS title, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS author, coalesce(doc_id % 2 = 1 AND doc_id % 5 <> 0 AND source IS NOT NULL OR doc_id % 3 <> 0 AND lang IS NOT NULL, false) AS changed FROM documents")
def metadata_backfill(spark, sf_dir):
    """Titles and authors filled in where something usable was found."""
    i = F.col("doc_id")
    old = documents(spark, sf_dir).select("doc_id", F.when(i % 2 == 0, "kept").alias("title"), F.lit(None).cast("string").alias("author"))
    new = documents(spark, sf_dir).select("doc_id", F.when(i % 5 == 0, "untitled").otherwise(F.col("source")).alias("title"), F.when(i % 3 == 0, "admin").otherwise(F.col("lang")).alias("author"))
    return registry.backfill(old, new, "doc_id").select("doc_id", "title", "author", "changed")


# --- evaluation and reports -----------------------------------------------------------------------


@query("WITH p AS (SELECT event_id, user_id, CAST(epoch_us(ts) AS DOUBLE) / 1e6 AS at FROM events WHERE event_type = 'click'), t AS (SELECT user_id, CAST(epoch_us(ts) AS DOUBLE) / 1e6 AS at FROM events WHERE event_type = 'view'), d AS (SELECT event_id, min(abs(p.at - t.at)) AS d FROM p LEFT JOIN t ON t.user_id = p.user_id GROUP BY event_id) SELECT count(*) AS points, count(*) FILTER (d <= 3600) AS confirmed, round(count(*) FILTER (d <= 3600) / count(*), 6) AS confirmed_rate, round((count(*) - count(*) FILTER (d <= 3600)) / count(*), 6) AS orphaned_rate FROM d")
def boundary_delta(spark, sf_dir):
    """Clicks with a view of the same user within an hour."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return evaluation.boundary_delta(events.where("event_type = 'click'"), events.where("event_type = 'view'").select("user_id", "at"), ["user_id"], tolerance=3600)


@query("WITH m AS (SELECT l_returnflag, l_linestatus, round(avg(CAST(l_discount AS DOUBLE)), 6) AS score FROM lineitem GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY score DESC, l_returnflag, l_linestatus) = 1 AS best FROM m")
def best_combinations(spark, sf_dir):
    """The best status for each flag by mean discount."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_discount").cast("double").alias("score"))
    return evaluation.best_combination(rows, ["l_returnflag", "l_linestatus"], "score", ["l_returnflag"])


TEMPLATES = [("exegesis", "en", "Explain {name}"), ("comparison", "en", "Compare {name} with others"), ("exegesis", "ko", "{name} 설명")]
TEMPLATE_ROWS = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in TEMPLATES)
@query(f"SELECT printf('Q%05d', row_number() OVER (ORDER BY b, l, i, t)) AS id, replace(t, '{{name}}', n) AS question, b AS book_id, i AS intent, l AS language FROM (SELECT DISTINCT source || '-' || lang AS b, source AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL) AS books CROSS JOIN (VALUES {TEMPLATE_ROWS}) AS tm(i, l, t)")
def gold_questions(spark, sf_dir):
    """Questions by templates on every source and language that documents come from, which take the books' place."""
    books = documents(spark, sf_dir).select(F.concat(F.col("source"), F.lit("-"), F.col("lang")).alias("book_id"), F.col("source").alias("name")).where(F.col("book_id").isNotNull()).distinct()
    return evaluation.gold_questions(books, spark.createDataFrame(TEMPLATES, "intent string, language string, template string"))


@query(f"WITH {PLACED}, d AS (SELECT book_id, chapter, count(*) AS n FROM p GROUP BY ALL), c AS (SELECT *, chapter <= MAP {{{', '.join(f"'{b}': {n}" for b, n in lexicon.CHAPTERS.items())}}}[book_id] AS canonical FROM d) SELECT *, canonical AND n >= 3 AS selected FROM c")
def chapter_selection(spark, sf_dir):
    return reports.select_chapters(reports.chapter_density(placed_documents(spark, sf_dir)))


@query(f"WITH g AS (SELECT item_id AS id, {sql_pick(CODES + ['XXX'], 'item_id')} AS b, CAST(item_id % 30 + 1 AS INTEGER) AS c, question FROM (SELECT item_id, text AS question FROM benchmark UNION ALL SELECT item_id + 1000000, text FROM benchmark WHERE item_id % 4 = 1)), f AS (SELECT *, min(id) OVER (PARTITION BY question) AS first, MAP {{{', '.join(f"'{b}': {n}" for b, n in lexicon.CHAPTERS.items())}}}[b] AS most FROM g) SELECT id, 'book' AS issue FROM f WHERE most IS NULL UNION ALL SELECT id, 'chapter' FROM f WHERE NOT coalesce(c <= most, false) UNION ALL SELECT id, 'duplicate' FROM f WHERE id <> first")
def gold_issues(spark, sf_dir):
    i = F.col("item_id")
    """Whole questions; every fourth comes a second time."""
    asked = table(spark, sf_dir, "benchmark").select("item_id", "text")
    asked = asked.unionByName(asked.where(i % 4 == 1).withColumn("item_id", i + 1_000_000))
    gold = asked.select(i.alias("id"), pick([*CODES, "XXX"], i).alias("book_id"), (i % 30 + 1).cast("int").alias("chapter"), F.col("text").alias("question"))
    return reports.gold_issues(gold)


@query(f"WITH {PLACED} SELECT count(confidence) AS with_confidence, count(*) - count(confidence) AS without, round(avg(confidence), 4) AS mean FROM p")
def confidence_coverage(spark, sf_dir):
    return reports.confidence_coverage(placed_documents(spark, sf_dir))


@query(f"WITH {BM25},{DIVERSE} SELECT count(*) AS rows, round(count(l.quality) / count(*), 6) AS quality, round(count(l.toxic) / count(*), 6) AS toxic FROM ranked r LEFT JOIN labels l ON l.doc_id = r.doc_id")
def evidence_completeness(spark, sf_dir):
    ranked = retrieval.topk(documents(spark, sf_dir), questions(spark, sf_dir)).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return reports.completeness(ranked, ["quality", "toxic"])


#: Themes that the tables' own prose shows, word beginnings and word ends of its languages.
OWN_THEMES = {"waters": ["ereth", "onea"], "roads": ["ingon", "nden"], "houses": ["ñas", "menter"], "fires": ["éré", "eaux"], "trees": ["ung", "heit"], "stones": ["thesh", "lybl"]}
S_OWN = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(coalesce(text, '')), '{'|'.join(w)}') THEN '{n}' END" for n, w in OWN_THEMES.items()) + "], lambda t: t IS NOT NULL)"
THEME_ORDER = "MAP {" + ", ".join(f"'{n}': {k}" for k, n in enumerate(OWN_THEMES)) + "}"


@query(f"WITH {BM25},{DIVERSE}, t AS (SELECT query_id, rank, unnest({S_OWN}) AS theme FROM ranked JOIN documents USING (doc_id) WHERE rank <= 3), c AS (SELECT query_id, theme, count(*) AS n, min(rank) AS pos FROM t GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, pos, {THEME_ORDER}[theme]) AS place FROM c) SELECT query_id, string_agg(theme, ' ' ORDER BY place) AS themes FROM k WHERE place <= 3 GROUP BY query_id")
def theme_summary(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return reports.theme_summary(retrieval.topk(docs, questions(spark, sf_dir)), docs, themes_of=OWN_THEMES).select("query_id", F.array_join("themes", " ").alias("themes"))


GRID = [(s, n, o) for s in ("windows", "lines") for n in (500, 1000, 1500) for o in (0, 120)]
GRID_ROWS = ", ".join(f"('{s}', {n}, {o})" for s, n, o in GRID)


@query(
    f"""WITH g AS (SELECT * FROM (VALUES {GRID_ROWS}) AS g(strategy, size, overlap)), d AS (SELECT lang, text FROM documents WHERE trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''),
c AS (SELECT lang, strategy, size, overlap, unnest(CASE WHEN strategy = 'lines' THEN list_filter(string_split(text, chr(10)), lambda x: x <> '') ELSE list_transform(range(0, greatest(1, length(text) - overlap), size - overlap), lambda i: text[i + 1:i + size]) END) AS chunk FROM d, g),
s AS (SELECT lang, strategy, size, overlap, count(*) AS chunks, round(avg(length(chunk)), 4) AS mean_length, round(count(*) FILTER (length(chunk) < 80) / count(*), 6) AS short_ratio FROM c GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY lang ORDER BY short_ratio, chunks, strategy, size, overlap) = 1 AS best FROM s"""
)
def strategy_grid(spark, sf_dir):
    """Twelve chunk strategies on three axes over all documents, and the best for each language."""
    return reports.strategy_grid(documents(spark, sf_dir), GRID, "lang")


@query("SELECT lang, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percent FROM documents GROUP BY lang")
def language_shares(spark, sf_dir):
    return reports.shares(documents(spark, sf_dir), "lang")


@query("SELECT lang, min(n_chars) AS least, list_sort(list(n_chars))[count(*) // 2 + 1] AS median, max(n_chars) AS most FROM documents WHERE n_chars IS NOT NULL GROUP BY lang")
def length_stats(spark, sf_dir):
    """Least, upper median and greatest length by language."""
    return reports.chunk_stats(documents(spark, sf_dir).where(F.col("n_chars").isNotNull()).select("lang", "n_chars"), ["lang"], "n_chars")


@query("SELECT coalesce(a.source, b.source) AS source_file, coalesce(versions, 0) AS versions, coalesce(failed, 0) AS failed FROM (SELECT source, count(*) AS versions FROM documents WHERE doc_id % 2 = 0 AND source IS NOT NULL GROUP BY source) a FULL JOIN (SELECT source, count(*) AS failed FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND source IS NOT NULL GROUP BY source) b ON a.source = b.source")
def provenance(spark, sf_dir):
    """Versions and failures of each source, whichever there are."""
    docs = documents(spark, sf_dir).where(F.col("source").isNotNull()).withColumnRenamed("source", "source_file")
    failed = docs.join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id").groupBy("source_file").agg(F.count("*").alias("failed"))
    return reports.versions_and_failures(docs.where("doc_id % 2 = 0").groupBy("source_file").agg(F.count("*").alias("versions")), failed).fillna(0)


@query("WITH d AS (SELECT doc_id FROM documents WHERE doc_id % 2 = 0), r AS (SELECT doc_id FROM documents WHERE doc_id % 3 = 0) SELECT 'passages' AS check, count(*) AS value, count(*) > 0 AS ok FROM d UNION ALL SELECT 'documents', count(*), count(*) > 0 FROM r UNION ALL SELECT 'documents_without_passages', count(*), count(*) = 0 FROM r WHERE doc_id NOT IN (SELECT doc_id FROM d) UNION ALL SELECT 'passages_without_document', count(*), count(*) = 0 FROM d WHERE doc_id NOT IN (SELECT doc_id FROM r) UNION ALL SELECT 'cached_vectors', count(*), count(*) > 0 FROM embeddings")
def health_report(spark, sf_dir):
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("document_id"))
    return reports.health(docs.where("document_id % 2 = 0"), docs.where("document_id % 3 = 0"), table(spark, sf_dir, "embeddings"))


@query(f"WITH {BM25},{DIVERSE}, g AS (SELECT item_id AS query_id, item_id % 7 AS m FROM benchmark), gold AS (SELECT r.query_id, r.doc_id FROM ranked r JOIN g USING (query_id) WHERE r.rank % 7 = g.m UNION ALL SELECT item_id, -1 FROM benchmark), h AS (SELECT r.query_id, r.rank, CASE WHEN gold.doc_id IS NULL THEN 0 ELSE 1 END AS hit FROM ranked r LEFT JOIN gold ON gold.query_id = r.query_id AND gold.doc_id = r.doc_id), e AS (SELECT query_id, least(count(*), 10) AS many FROM gold GROUP BY query_id), sc AS (SELECT query_id, coalesce(sum(1 / log2(rank + 1.0)) FILTER (hit = 1), 0.0) AS dcg FROM h GROUP BY query_id) SELECT count(*) AS n, round(avg(dcg / list_sum(list_transform(range(1, many + 1), lambda i: 1 / log2(i + 1.0)))), 6) AS ndcg FROM sc JOIN e USING (query_id)")
def ndcg_of_expected(spark, sf_dir):
    """nDCG against as many hits as a gold set expects: every seventh rank, and one document that is never found."""
    q = questions(spark, sf_dir)
    ranked = retrieval.topk(documents(spark, sf_dir), q)
    gold = ranked.where(F.col("rank") % 7 == F.col("query_id") % 7).select("query_id", "doc_id").unionByName(q.select("query_id", F.lit(-1).cast("long").alias("doc_id")))
    return evaluation.retrieval_metrics(ranked, gold, expected_ideal=True).select("n", "ndcg")
