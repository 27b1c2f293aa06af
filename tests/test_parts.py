"""What one task groups does not grow with the input."""

from helpers import SF
from pyspark.sql import functions as F

from lectern.operators import lineage, retrieval


def test_lexical_grouping_takes_more_tasks_as_the_input_grows(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    asked = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    session = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert lineage.parts_of(docs) == session
    want = sorted(map(tuple, retrieval.topk(docs, asked).collect()))
    monkeypatch.setattr(lineage, "PART_BYTES", 1 + lineage.estimated_bytes(docs) // (4 * session))
    scores = retrieval.lexical_scores(docs, asked)
    assert lineage.parts_of(docs) == 4 * session == scores.rdd.getNumPartitions()
    assert sorted(map(tuple, retrieval.topk(docs, asked).collect())) == want


def test_vector_search_in_blocks_of_rows(spark, monkeypatch):
    """As many similarities at once as stated, whatever the batch holds; the rows are the same."""
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    asked = table.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    rows = lambda: sorted(map(tuple, retrieval.vector_topk(table, asked).collect()))
    want = rows()
    monkeypatch.setattr(retrieval, "CELLS", 100)
    assert rows() == want and len(want) == 10 * asked.count()


def test_vector_search_memory():
    """The matrix of one block stays below ``CELLS``, measured on a batch that would need forty times as much."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    batch = pa.record_batch([pa.array(np.arange(10_000)), pa.array(list(rng.normal(size=(10_000, 4))), pa.list_(pa.float64()))], ["id", "v"])
    ids, matrix = np.arange(2_048), rng.normal(size=(2_048, 4))
    tracemalloc.start()
    found = [part.num_rows for part in retrieval.nearest_of([batch], ids, matrix, 10)]
    assert tracemalloc.get_traced_memory()[1] < 12 * 8 * retrieval.CELLS < 8 * 10_000 * 2_048 and found == [10 * 2_048]
    tracemalloc.stop()


def test_paragraph_chunks_are_handed_on_in_parts(spark):
    """Rows as of the arrays, and no batch of much more than the characters stated."""
    import pyarrow as pa

    from lectern.functions import chunk

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = docs.select("doc_id", F.posexplode(chunk.paragraph_chunks("text")).alias("chunk_index", "chunk"))
    assert sorted(map(tuple, chunk.paragraph_rows(docs).collect())) == sorted(map(tuple, want.collect()))
    long = pa.record_batch([pa.array(range(40)), pa.array(["one two three. " * 20_000] * 39 + [None])], ["doc_id", "text"])
    parts = list(chunk.chunks_in_rows([long]))
    assert len(parts) > 5 and all(sum(map(len, p.column(2).to_pylist())) < chunk.CHARACTERS + 400_000 for p in parts)
