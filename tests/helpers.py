import os

import pandas as pd

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or v is pd.NA or v != v:
        return "null"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(cell, v)) + "]"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, (int, float)):
        return f"{v:.6g}" if isinstance(v, float) and v != int(v) else str(int(v))
    return str(v)


def rows_of(frame):
    names = sorted(frame.columns)
    return names, sorted("|".join(map(cell, r)) for r in frame[names].itertuples(index=False, name=None))
