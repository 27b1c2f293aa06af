"""Texts reach Python in small batches, whatever the session's default."""

import pyarrow as pa

from lectern.llm.common import map_text


def test_texts_come_in_small_batches(spark):
    def start():
        return lambda texts: [pa.array([len(texts)] * len(texts), pa.int64())]

    rows = spark.range(2_500).coalesce(1).selectExpr("cast(id as string) as t")
    assert max(r.n for r in map_text(rows, "t", "n long", start).collect()) <= 1_000
