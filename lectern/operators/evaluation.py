"""Quality of retrieval and of structure: metrics, coverage, histograms, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import rounded
from lectern.operators.ranges import PARTS, in_ranges
from lectern.operators.retrieval import small

SHINGLE = 5
# Greatest noise, mean overlap and share of short chunks up to which a document's chunks pass.
MOST_NOISE, MOST_OVERLAP, MOST_SHORT = 18.0, 0.30, 0.20


def verbatim_gold(questions: DataFrame, docs: DataFrame, question: str = "question", text: str = "text") -> DataFrame:
    """``query_id, doc_id`` where the document holds the question's text verbatim.

    An equi-join on a run of ``SHINGLE`` words from the question's inside finds the candidates, and a substring test
    settles them; questions of fewer words than a run and its neighbours are compared in a broadcast join of a checked size.
    """
    split = lambda c: F.split(c, r"\s+")
    run = lambda w, i: F.xxhash64(F.array_join(F.slice(w, i, SHINGLE), " "))
    asked = questions.select("query_id", F.col(question).alias("__q")).where(F.length("__q") > 0).withColumn("__w", split(F.col("__q")))
    # the first word may begin, and the last end, inside a document's word
    long = asked.where(F.size("__w") >= SHINGLE + 2).select("query_id", "__q", run(F.col("__w"), F.lit(2)).alias("__h"))
    runs = docs.select("doc_id", split(F.col(text)).alias("__w")).where(F.size("__w") >= SHINGLE)
    runs = runs.select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("__w") - SHINGLE + 1), lambda i: run(F.col("__w"), i)))).alias("__h"))
    met = runs.join(small(long), "__h").select("query_id", "__q", "doc_id").distinct()
    found = met.join(docs.select("doc_id", text), "doc_id").where(F.col(text).contains(F.col("__q"))).select("query_id", "doc_id")
    short = asked.where(F.size("__w") < SHINGLE + 2).select("query_id", "__q")
    if not short.limit(1).count():
        return found
    return found.unionByName(docs.select("doc_id", text).join(small(short), F.col(text).contains(F.col("__q"))).select("query_id", "doc_id"))


def judged(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """Ranked rows with ``hit``."""
    return ranked.join(gold.select("query_id", "doc_id").distinct().withColumn("__hit", F.lit(1)), ["query_id", "doc_id"], "left").withColumn("hit", F.coalesce("__hit", F.lit(0))).drop("__hit")


def per_query(judged_rows: DataFrame, k: int = 10, gold: DataFrame | None = None) -> DataFrame:
    """Per question: hits at 1 and 5, reciprocal rank, nDCG at ``k``, hits in ``k``.

    The ideal has the hits found in ``k``; with ``gold`` (query_id, doc_id) it has as many as are expected, at most ``k``.
    """
    rank, hit = F.col("rank"), F.col("hit")
    gain = F.sum(F.when((hit == 1) & (rank <= k), 1 / F.log2(rank + 1.0)).otherwise(0.0))
    rows = judged_rows.groupBy("query_id").agg(
        F.sum(F.when(rank <= 1, hit).otherwise(0)).alias("hit1"), F.sum(F.when(rank <= 5, hit).otherwise(0)).alias("hit5"), F.sum(F.when(rank <= k, hit).otherwise(0)).alias("hits"),
        F.min(F.when(hit == 1, rank)).alias("first"), gain.alias("dcg"),
    )
    if gold is None:
        rows = rows.withColumn("many", F.col("hits"))
    else:
        expected = gold.select("query_id", "doc_id").distinct().groupBy("query_id").agg(F.least(F.count("*"), F.lit(k)).alias("many"))
        rows = rows.join(expected, "query_id", "left").withColumn("many", F.coalesce("many", F.lit(0)))
    ideal = F.aggregate(F.when(F.col("many") > 0, F.sequence(F.lit(1), F.col("many").cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return rows.select("query_id", "hit1", "hit5", "hits", F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"), F.when(ideal > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"))


def _averages(k: int) -> list[Column]:
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return [F.count("*").alias("n"), mean(F.col("hit1").cast("double"), "p_at_1"), mean(F.col("hit5") / 5.0, "p_at_5"), mean(F.col("rr"), "mrr"), mean(F.col("ndcg"), "ndcg"), mean(F.col("hits") / float(k), "hit_rate")]


def retrieval_metrics(ranked: DataFrame, gold: DataFrame, k: int = 10, expected_ideal: bool = False, latency: DataFrame | None = None) -> DataFrame:
    """One row of averages over the questions that got a result; ``expected_ideal`` takes the ideal of nDCG from the gold set.

    ``latency`` (query_id, latency_ms; several rows of a question count with their mean) adds the mean time of those questions.
    """
    rows = per_query(judged(ranked, gold), k, gold if expected_ideal else None)
    if latency is None:
        return rows.agg(*_averages(k))
    times = latency.groupBy("query_id").agg(F.avg("latency_ms").alias("latency_ms"))
    return rows.join(times, "query_id", "left").agg(*_averages(k), F.round(F.avg("latency_ms"), 3).alias("latency_ms"))


def metrics_by(ranked: DataFrame, gold: DataFrame, attributes: DataFrame, sets: list[list[str]], k: int = 10) -> DataFrame:
    """The averages for several groupings in one pass; a column that a grouping lacks is null, ``grouping`` tells which."""
    names = sorted({c for s in sets for c in s})
    rows = per_query(judged(ranked, gold), k).join(attributes.select("query_id", *names), "query_id")
    columns = [[F.col(c) for c in s] for s in sets]
    return rows.groupingSets(columns, *map(F.col, names)).agg(*_averages(k), F.grouping_id().alias("grouping"))


def evidence_at(ranked: DataFrame, evidence: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """``k, covered, reliability``: share of ranked rows up to ``k`` with evidence, and its mean confidence without nulls."""
    joined = ranked.join(evidence.select("doc_id", "confidence"), "doc_id", "left")
    rows = joined.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where(F.col("rank") <= F.col("k"))
    return rows.groupBy("k").agg(F.round(F.count("confidence") / F.count("*"), 6).alias("covered"), F.round(F.avg("confidence"), 6).alias("reliability"))


def coverage(corpus: DataFrame, cache: DataFrame, key: str = "hash") -> DataFrame:
    """One row: rows, distinct keys, matched, missing, orphaned keys and the percentage covered."""
    have = corpus.groupBy(key).agg(F.count("*").alias("rows"))
    both = have.join(cache.select(key).distinct().withColumn("__c", F.lit(1)), key, "full")
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    here, there = F.col("rows").isNotNull(), F.col("__c").isNotNull()
    out = both.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("total"), n(here, "distinct_keys"), n(here & there, "matched"), n(here & ~there, "missing"), n(there & ~here, "orphaned"))
    return out.withColumn("percent", F.when(F.col("distinct_keys") > 0, F.round(100.0 * F.col("matched") / F.col("distinct_keys"), 2)).otherwise(0.0))


def histogram(df: DataFrame, value: Column, width: int) -> DataFrame:
    """``bucket, n`` of ``width``-wide buckets, named by their lower end."""
    return df.groupBy((F.floor(value / width) * width).alias("bucket")).agg(F.count("*").alias("n"))


def stratified(df: DataFrame, stratum: str, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """``max(1, round(n * fraction))`` rows of each stratum, the same ones at every run.

    Rows stand in the order of a hash. Its first three digits make 4,096 classes, whose counts tell which are taken
    whole; only the class at the edge is ranked, so no task sorts a stratum.
    """
    marked = df.withColumn("__h", F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))).withColumn("__c", F.substring("__h", 1, 3))
    before = Window.partitionBy(stratum).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(stratum)
    counts = marked.groupBy(stratum, "__c").agg(F.count("*").alias("__n"))  # at most 4,096 rows for each stratum
    counts = counts.select(F.col(stratum).alias("__s"), F.col("__c").alias("__k"), "__n", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.greatest(F.lit(1.0), F.round(F.sum("__n").over(whole) * fraction)).alias("__want"))
    part = marked.join(counts.where(F.col("__before") < F.col("__want")), F.col(stratum).eqNullSafe(F.col("__s")) & (F.col("__c") == F.col("__k")))
    inside = F.col("__before") + F.col("__n") <= F.col("__want")
    place = F.row_number().over(Window.partitionBy(stratum).orderBy("__h", key))
    edge = part.where(~inside).withColumn("__r", place).where(F.col("__before") + F.col("__r") <= F.col("__want"))
    return part.where(inside).select(*df.columns).unionByName(edge.select(*df.columns))


def band_join(left: DataFrame, right: DataFrame, by: list[str], at: str, width: int, right_at: str) -> DataFrame:
    """Rows of both sides with equal ``by`` whose places differ by at most ``width``.

    The equi-join is on the key and a class of ``width`` places; the right side is given out for its own class and both
    neighbours, so that a hot key costs what lies near each row, not its square.
    """
    one = left.withColumn("__b", F.floor(F.col(at) / width))
    two = right.withColumn("__b", F.explode(F.array(*[F.floor(F.col(right_at) / width) + k for k in (-1, 0, 1)])))
    return one.join(two, [*by, "__b"]).where(F.abs(F.col(at) - F.col(right_at)) <= width).drop("__b")


def nearest_distance(points: DataFrame, targets: DataFrame, by: list[str], at: str = "at", parts: int = PARTS) -> DataFrame:
    """``points`` with ``distance`` to the nearest target of their group: both streams merged and looked at in both directions.

    Groups are cut into ranges of their order; the last target before a range and the first one behind it come from a row for each
    group and range, so a group with most of the rows is spread over tasks.
    """
    both = points.withColumn("__t", F.lit(None).cast("double")).unionByName(targets.select(*by, at, F.col(at).cast("double").alias("__t")), allowMissingColumns=True).withColumn("__p", F.col("__t").isNull())
    both = in_ranges(both, F.col(at).cast("double"), parts)
    line = Window.partitionBy(*by, "__range").orderBy(at, "__p")
    ends = both.groupBy(*by, "__range").agg(F.min("__t").alias("lo"), F.max("__t").alias("hi"))
    order = Window.partitionBy(*by).orderBy("__range")
    ends = ends.select(*[F.col(c).alias(f"__of_{c}") for c in by], F.col("__range").alias("__r"), F.last("hi", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("__lower"), F.first("lo", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("__upper"))
    own = both.withColumns({"__before": F.last("__t", True).over(line.rowsBetween(Window.unboundedPreceding, 0)), "__after": F.first("__t", True).over(line.rowsBetween(0, Window.unboundedFollowing))}).where("__p")
    joined = own.join(ends, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in by] + [F.col("__range") == F.col("__r")])
    gap = F.least(F.abs(F.col(at) - F.coalesce("__before", "__lower")), F.abs(F.coalesce("__after", "__upper") - F.col(at)))
    return joined.withColumn("distance", gap).drop("__t", "__p", "__range", "__r", "__lower", "__upper", "__before", "__after", *[f"__of_{c}" for c in by])


def boundary_delta(points: DataFrame, targets: DataFrame, by: list[str], at: str = "at", tolerance: float = 50) -> DataFrame:
    """One row: points, how many have a target within ``tolerance``, and both rates."""
    near = nearest_distance(points, targets, by, at)
    row = near.agg(F.count("*").alias("points"), F.count(F.when(F.col("distance") <= tolerance, 1)).alias("confirmed"))
    rate = lambda c: F.when(F.col("points") > 0, F.round(c / F.col("points"), 6)).otherwise(0.0)
    return row.withColumns({"confirmed_rate": rate(F.col("confirmed")), "orphaned_rate": rate(F.col("points") - F.col("confirmed"))})


def regression(current: DataFrame, baseline: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """``metric, value`` against a baseline: ``delta`` and ``status`` (improved, regressed, stable, missing)."""
    both = current.select("metric", F.col("value").alias("now")).join(baseline.select("metric", F.col("value").alias("then")), "metric", "full")
    delta = F.round(F.col("now") - F.col("then"), 6)
    return both.select("metric", "now", "then", delta.alias("delta"), F.when(delta.isNull(), "missing").when(delta < -tolerance, "regressed").when(delta > tolerance, "improved").otherwise("stable").alias("status"))


def exact_median(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``by, median``: exact, though no task sorts a group.

    Approximate quantiles (with a rank error of a thousandth) enclose the median; the rows below are counted, and only
    the two hundredths between are ranked.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("__v"))
    bounds = rows.groupBy(*by).agg(F.percentile_approx("__v", F.array(F.lit(0.49), F.lit(0.51)), F.lit(1000)).alias("__q"), F.count("*").alias("__n"))
    bounds = bounds.select(*[F.col(c).alias(f"__{c}") for c in by], "__q", "__n")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    near = rows.join(bounds, same).where(F.col("__v") <= F.col("__q")[1])
    below = F.count(F.when(F.col("__v") < F.col("__q")[0], 1))
    held = near.groupBy(*by).agg(below.alias("__below")).select(*[F.col(c).alias(f"__of_{c}") for c in by], "__below")
    ranked = near.where(F.col("__v") >= F.col("__q")[0]).withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy("__v")))
    placed = ranked.join(held, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in by])
    place = F.col("__below") + F.col("__r")
    return placed.where((place == F.floor((F.col("__n") + 1) / 2)) | (place == F.floor(F.col("__n") / 2) + 1)).groupBy(*by).agg(F.avg("__v").alias("median"))


def timing(df: DataFrame, value: str, ok: str, by: list[str]) -> DataFrame:
    """Mean, median, extremes of a time and the share of successes per group."""
    rows = df.groupBy(*by).agg(F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.round(F.avg(F.col(ok).cast("double")), 6).alias("success"))
    middle = exact_median(df, value, by).select(*[F.col(c).alias(f"__{c}") for c in by], F.round("median", 6).alias("median"))
    return rows.join(middle, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], "left").select(*by, "mean", "median", "least", "most", "success")


def chunk_quality(chunks: DataFrame, noise: Column, doc: str = "doc_id", index: str = "chunk_index", text: str = "chunk", least: int = 80) -> DataFrame:
    """Per document: mean and greatest noise, mean overlap of adjacent chunks, share of short ones, and whether all is well (``passed``)."""
    marked = chunks.withColumns({"__noise": noise, "__dup": adjacent_jaccard(F.col(text), [doc], index)})
    return marked.groupBy(doc).agg(F.count("*").alias("chunks"), rounded(F.avg("__noise"), 4).alias("avg_noise"), F.max("__noise").alias("max_noise"), rounded(F.avg("__dup"), 4).alias("avg_overlap"), rounded(F.avg((F.length(F.trim(text)) < least).cast("double")), 4).alias("short_ratio")).withColumn("passed", (F.col("max_noise") <= MOST_NOISE) & (F.col("avg_overlap") <= MOST_OVERLAP) & (F.col("short_ratio") <= MOST_SHORT))


def adjacent_jaccard(text: Column, by: list[str], order: str) -> Column:
    """Word-set similarity to the row before; 0 for the first."""
    here = F.array_distinct(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))
    last = F.lag(here).over(Window.partitionBy(*by).orderBy(order))
    union = F.size(F.array_union(here, last))
    return F.when(last.isNull() | (union == 0), 0.0).otherwise(F.size(F.array_intersect(here, last)) / F.greatest(union, F.lit(1)))


def best_combination(results: DataFrame, keys: list[str], score: str, by: list[str] | None = None) -> DataFrame:
    """Mean score of each combination with ``best`` on the highest (the first by key among equals), overall or for each ``by``.

    There are as many rows as combinations, however many results.
    """
    means = results.groupBy(*keys).agg(F.round(F.avg(score), 6).alias("score"))
    return means.withColumn("best", F.row_number().over(Window.partitionBy(*(by or [])).orderBy(F.desc("score"), *keys)) == 1)


def gold_questions(books: DataFrame, templates: DataFrame) -> DataFrame:
    """``id, question, book_id, intent, language``: every template (a stated handful) with every selected book, numbered in order of book, language and intent."""
    rows = books.crossJoin(small(templates))
    before = Window.orderBy("book_id").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("book_id").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))  # a row for each book
    numbered = rows.withColumn("__r", F.row_number().over(Window.partitionBy("book_id").orderBy("language", "intent", "template"))).join(counts, "book_id")
    return numbered.select(F.format_string("Q%05d", F.col("__before") + F.col("__r")).alias("id"), F.replace("template", F.lit("{name}"), F.col("name")).alias("question"), "book_id", "intent", "language")
