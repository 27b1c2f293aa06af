"""One registered query per training-data operator, each over its whole table.

``queries()`` and ``oracle_sql()`` are what ``__spark_entry__`` adds to its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import byte_bpe, impact_index, language, line_dedup, neighbours, packing, periodic_runs, quality, simhash, tool_calls, toxicity, transport_stream, url_reputation
from lectern.llm.common import fold, read_table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


TOOL_SCHEMAS = [("answer", "n_chars", "integer", True), ("answer", "question", "string", True)]


def op1_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.calls_of_conversations(read_table(spark, sf_dir, "conversations"))
    schemas = spark.createDataFrame(TOOL_SCHEMAS, "name string, param string, type string, required boolean")
    linked = tool_calls.link_tool_calls(calls, results, schemas)
    return linked.select("conv_id", "turn", "call_id", F.col("level").cast("long").alias("level"), "duplicates", F.array_join("errors", ",").alias("errors"), "message")


OP1_SQL = """
WITH RECURSIVE u AS (
  SELECT conv_id, turn, min(CASE WHEN text IS NULL THEN '{}' ELSE '{"n_chars":' || length(text) || ',"question":' || to_json(text) || '}' END) AS arguments, count(*) AS duplicates, bool_or(text IS NULL) AS no_text
  FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn
),
r AS (SELECT conv_id, turn - 1 AS turn, min(text) AS result, true AS answered FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
lv(conv_id, turn, level) AS (
  SELECT c.conv_id, c.turn, CAST(0 AS BIGINT) FROM u c LEFT JOIN u p ON p.conv_id = c.conv_id AND p.turn = c.turn // 2 AND c.turn > 0 WHERE p.turn IS NULL
  UNION ALL
  SELECT c.conv_id, c.turn, lv.level + 1 FROM lv JOIN u c ON c.conv_id = lv.conv_id AND c.turn > 0 AND c.turn // 2 = lv.turn
),
e AS (
  SELECT u.conv_id, u.turn, 't' || u.turn AS call_id, lv.level, u.duplicates, u.arguments, r.result,
    list_filter([CASE WHEN u.no_text THEN 'missing:n_chars' END, CASE WHEN u.no_text THEN 'missing:question' END, CASE WHEN r.answered IS NULL THEN 'no_result' END, CASE WHEN u.turn > 0 AND p.turn IS NULL THEN 'unknown_dependency' END], lambda x: x IS NOT NULL) AS errors
  FROM u JOIN lv ON lv.conv_id = u.conv_id AND lv.turn = u.turn LEFT JOIN r ON r.conv_id = u.conv_id AND r.turn = u.turn LEFT JOIN u p ON p.conv_id = u.conv_id AND p.turn = u.turn // 2
)
SELECT conv_id, turn, call_id, level, duplicates, coalesce(array_to_string(errors, ','), '') AS errors,
  '{"arguments":' || arguments || ',"errors":[' || coalesce(array_to_string(list_transform(errors, lambda x: '"' || x || '"'), ','), '') || '],"id":"' || call_id || '","level":' || level || ',"name":"answer","result":' || coalesce(to_json(result), 'null') || '}' AS message
FROM e
"""


def op2_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport_stream.media_digests(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 5) == 0
    profiles = language.train_profiles(docs.where(~held_out))
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return language.predict_language(rows, profiles, keep_text=False)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.encode_digests(docs, tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = quality.train(docs, labels, ~held_out)
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return quality.score_quality(rows, model, keep_text=False)


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


URL_RULES = [
    url_reputation.Rule("allow", "com", "/"),
    url_reputation.Rule("block", "example.com", "/en/"),
    url_reputation.Rule("allow", "www.example.com", "/en/"),
    url_reputation.Rule("block", "net", "/es/"),
    url_reputation.Rule("block", "net", "/fr/"),
]


def op9_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled outcomes are the labels whose id is a page's: good is quality 1 and not toxic."""
    labels = read_table(spark, sf_dir, "labels").where(F.col("quality").isNotNull())
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int").alias("good"))
    judged = url_reputation.judge(read_table(spark, sf_dir, "pages").select("page_id", "url"), outcomes, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def _strength_sql(name: str, table: str, good: str, seen: str) -> str:
    return f"""{name}_sums AS (SELECT sum(CAST({seen} AS DOUBLE)) AS n, sum(CAST({good} AS DOUBLE)) AS s, count(*) AS m, sum(CAST({good} AS DOUBLE) * {good} / {seen}) AS q FROM {table} WHERE {seen} > 0),
{name} AS (
  SELECT least(greatest(coalesce(CASE WHEN m > 1 AND (q - n * (s / n) * (s / n) - (s / n) * (1 - s / n) * (m - 1)) / n > 0 THEN (s / n) * (1 - s / n) / ((q - n * (s / n) * (s / n) - (s / n) * (1 - s / n) * (m - 1)) / n) - 1 END, 1000.0), 1.0), 1000.0) AS k, coalesce(s / n, 1.0) AS p
  FROM {name}_sums
)"""


OP9_SQL = f"""
WITH placed AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{url_reputation.UPPER}', '{url_reputation.LOWER}'), '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
),
outcome AS (SELECT doc_id AS page_id, CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END AS good FROM labels WHERE quality IS NOT NULL),
hosts AS (
  SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix, CAST(coalesce(sum(good), 0) AS BIGINT) AS good, count(good) AS seen
  FROM placed p LEFT JOIN outcome o ON p.page_id = o.page_id GROUP BY host
),
domains AS (SELECT domain, suffix, CAST(sum(good) AS BIGINT) AS d_good, CAST(sum(seen) AS BIGINT) AS d_seen FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, CAST(sum(d_good) AS BIGINT) AS s_good, CAST(sum(d_seen) AS BIGINT) AS s_seen FROM domains GROUP BY suffix),
{_strength_sql("sp", "suffixes", "s_good", "s_seen")},
{_strength_sql("dp", "domains", "d_good", "d_seen")},
{_strength_sql("hp", "hosts", "good", "seen")},
means AS (
  SELECT h.host, h.seen, hp.k AS k, (hp.k * ((dp.k * ((sp.k * sp.p + s.s_good) / (sp.k + s.s_seen)) + d.d_good) / (dp.k + d.d_seen)) + h.good) / (hp.k + h.seen) AS mean
  FROM hosts h JOIN domains d ON d.domain = h.domain JOIN suffixes s ON s.suffix = d.suffix CROSS JOIN sp CROSS JOIN dp CROSS JOIN hp
),
bound AS (SELECT host, mean + {url_reputation.Z} * sqrt(mean * (1 - mean) / (k + seen + 1)) AS upper FROM means),
ruled AS (
  SELECT p.page_id, p.host, p.path, b.upper, CASE
    WHEN (p.host = 'www.example.com' OR ends_with(p.host, '.www.example.com')) AND starts_with(p.path, '/en/') THEN 'www.example.com/en/'
    WHEN (p.host = 'example.com' OR ends_with(p.host, '.example.com')) AND starts_with(p.path, '/en/') THEN 'example.com/en/'
    WHEN (p.host = 'net' OR ends_with(p.host, '.net')) AND starts_with(p.path, '/fr/') THEN 'net/fr/'
    WHEN (p.host = 'net' OR ends_with(p.host, '.net')) AND starts_with(p.path, '/es/') THEN 'net/es/'
    WHEN (p.host = 'com' OR ends_with(p.host, '.com')) AND starts_with(p.path, '/') THEN 'com/' END AS rule
  FROM placed p JOIN bound b ON b.host = p.host
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN upper < {url_reputation.LEAST_GOOD} THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.remove_boilerplate(read_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", F.col("lines_total").cast("long").alias("lines_total"), F.col("lines_removed").cast("long").alias("lines_removed"), F.length("text").cast("long").alias("chars_kept"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


OP10_SQL = f"""
WITH docs AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents),
lines AS (
  SELECT doc_id, coalesce('s' || source, '') AS site, unnest(range(len(parts))) AS at, unnest(list_transform(parts, lambda x: trim(x, chr(32) || chr(9) || chr(13)))) AS line FROM docs
),
spread AS (
  SELECT line, min(doc_id) AS first_id FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {line_dedup.MIN_SITES}
),
cut AS (SELECT l.doc_id, list(l.at) AS ats FROM lines l JOIN spread s ON l.line = s.line WHERE l.doc_id <> s.first_id GROUP BY l.doc_id),
kept AS (
  SELECT d.doc_id, len(d.parts) AS lines_total, coalesce(len(c.ats), 0) AS lines_removed,
    CASE WHEN c.ats IS NULL THEN d.text ELSE coalesce(array_to_string(list_filter(list_transform(range(len(d.parts)), lambda i: CASE WHEN list_contains(c.ats, i) THEN NULL ELSE d.parts[i + 1] END), lambda x: x IS NOT NULL), chr(10)), '') END AS text
  FROM docs d LEFT JOIN cut c ON d.doc_id = c.doc_id
)
SELECT doc_id, CAST(lines_total AS BIGINT) AS lines_total, CAST(lines_removed AS BIGINT) AS lines_removed, CAST(length(text) AS BIGINT) AS chars_kept, md5(text) AS text_md5 FROM kept
"""


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` where every tenth document, by a hash of its id, repeats its words with some period from some word on."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(periodic_runs.WORD), F.lit(0)))
    # the words are a column of their own, so that the lambda below looks them up and does not split again
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("words")).withColumn("n", F.size("words"))
    a = F.col("g") % F.col("n")
    placed = rows.withColumn("a", F.when(F.col("n") > 0, a)).withColumn("p", F.when(F.col("n") > 0, 1 + F.floor((F.col("n") - a) / (3 + F.col("g") % 8))))
    source = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    planted = F.array_join(F.transform("words", lambda w, i: F.get("words", source(i).cast("int"))), " ")
    return placed.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(with_planted_runs(read_table(spark, sf_dir, "documents")), keep_text=False)
    # the first of equal ratios stays: runs come by start, then period
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    found = found.withColumn("best", F.aggregate("runs", none, better))
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_index.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ts FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark),
c AS (SELECT count(*) AS docs, CAST(sum(len(ts)) AS BIGINT) AS total FROM d WHERE len(ts) > 0),
p AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM (SELECT rid, doc_id, CAST(len(ts) AS BIGINT) AS n, unnest(ts) AS term FROM d) GROUP BY rid, doc_id, n, term),
w AS (SELECT term, CAST(floor(1000 * ln((2.0 * docs + 2) / (2.0 * count(*) + 1))) AS BIGINT) AS w FROM p, c WHERE term IN (SELECT term FROM q) GROUP BY term, docs),
s AS (
  SELECT q.item_id, p.rid, p.doc_id, CAST(sum(w.w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // total)))) AS BIGINT) AS score
  FROM p JOIN w ON w.term = p.term JOIN q ON q.term = p.term, c GROUP BY q.item_id, p.rid, p.doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, rid) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, rid) <= 50
"""


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = toxicity.train(docs, labels, ~held_out)
    return toxicity.score_toxicity(docs.select("doc_id", held_out.alias("held_out"), "text"), model, keep_text=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_tool_call_linking": op1_tool_call_linking,
        "op2_transport_stream": op2_transport_stream,
        "op3_language_id": op3_language_id,
        "op4_byte_bpe": op4_byte_bpe,
        "op5_quality_classifier": op5_quality_classifier,
        "op6_nearest_neighbours": op6_nearest_neighbours,
        "op7_simhash_near_dedup": op7_simhash_near_dedup,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_url_reputation": op9_url_reputation,
        "op10_line_dedup": op10_line_dedup,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_impact_search": op12_impact_search,
        "op13_toxicity": op13_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_tool_call_linking": OP1_SQL, "op9_url_reputation": OP9_SQL, "op10_line_dedup": OP10_SQL, "op12_impact_search": OP12_SQL}
