import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

LONG = "the quick brown fox jumps over it " * 3000
TEXTS = [None, "", "   ", "A", "Same text here for all of us", "Same text here for all of us", "Same text here for all of us", "ünïcödé 漢字 🙂 text", LONG, "line one\nline two\n\nline one"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns whose names operators use."""
    rows = [(k if k != 3 else None, t, "en" if k % 2 else None, f"src{k % 3}" if k != 5 else None, None if t is None else len(t)) for k, t in enumerate(TEXTS)]
    rows.append(rows[4])
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("score", "units", "Margin", "predicted", "fingerprint", "length", "lines_total", "ids", "host"):
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit("clash"))
    return df
