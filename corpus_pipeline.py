"""A corpus cleaning pipeline of five stages, from raw documents to packed sequences.

Every stage takes what its predecessor kept (as a table written to Parquet and
read again), lets its own decisions take effect, and all but the last return the
columns of ``documents``; further columns that ``documents`` may have are left out.

Defined results, for every stage: an empty table gives an empty one. Null and empty
texts have no letter and go in the first stage; handed to a later one, they are scored
like empty texts, have no lines, are copies of each other, and are packed as an end
token. Null ids, sources and languages pass (a null language is filled in). Repeated
rows pass until the near-duplicate stage, which keeps one. Texts of any length are
read whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import language, line_dedup, near_copies, packing, quality
from lectern.llm.common import fold, read_table, shared_folder
from lectern.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose calibrated chance of label 1 is lower than this go.
LEAST_QUALITY = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or too far from every language, go; null ``lang`` is filled in with the prediction.

    How far is too far follows from documents of known language that the profiles have not seen (see ``language.least_score``).
    """
    unseen = fold(F.col("doc_id"), 5) == 0
    profiles = language.train_profiles(docs.where(~unseen))
    least = language.least_score(docs.where(unseen), profiles)
    known = language.predict_language(docs, profiles).where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below ``LEAST_QUALITY`` go."""
    model = quality.train(docs, read_table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    return quality.score_quality(docs, model).where(F.col("score") >= LEAST_QUALITY).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sites go from all documents but the first that shows them."""
    cleaned = line_dedup.remove_boilerplate(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: SimHash fingerprints, settled at 0.8 or more of five-word shingles, then what lies beyond their radius."""
    return near_copies.keep_one(docs).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in training sequences."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_stage),
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("best_fit_packing", packing_stage),
]

#: Learned models and tokenisers are beyond SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, starting from ``documents``; their tables but the last are deleted once the last is written."""
    docs, folder = read_table(spark, sf_dir, "documents"), f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    paths = [f"{folder}/{k}-{name}" for k, (name, _) in enumerate(STAGES)]
    for path, (_, stage) in zip(paths, STAGES):
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    for path in paths[:-1]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return docs
