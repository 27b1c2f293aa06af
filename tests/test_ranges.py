"""Ordered groups in ranges: one hot user and one hot hour against brute force, and spread over tasks."""

import bisect
import random

from pyspark.sql import functions as F

from lectern.operators import evaluation, monitor
from lectern.operators.ranges import in_ranges


def hot_events(spark, n=60_000):
    rng = random.Random(8)
    rows = [("hot" if rng.random() < 0.9 else f"u{rng.randrange(40)}" if rng.random() < 0.95 else None, 1_700_000_000 + int(abs(rng.gauss(0, 1800))) + (86_400 * rng.randrange(5) if rng.random() < 0.2 else 0), rng.random() < 0.3) for _ in range(n)]
    rows += [("alone", 1_700_000_000, False), ("pair", 1_700_000_000, True), ("pair", 1_700_400_000, False)]
    df = spark.createDataFrame(rows, "user string, s long, hit boolean").withColumn("ts", F.timestamp_seconds("s")).withColumn("event_id", F.monotonically_increasing_id()).repartition(8).cache()
    return rows, df


def test_throughput_and_nearest_of_a_hot_user(spark):
    rows, df = hot_events(spark)
    users = {}
    for user, s, hit in rows:
        users.setdefault(user, []).append((s, hit))

    def active(times, gap):
        times = sorted(times)
        return float(sum(b - a for a, b in zip(times, times[1:]) if 0 < b - a <= gap))

    got = {r.user: (r.active_s, r.finished) for r in monitor.throughput(df, F.col("hit"), ["user"], gap=120).collect()}
    assert got == {u: (active([s for s, _ in v], 120), sum(h for _, h in v)) for u, v in users.items()}
    (row,) = monitor.throughput(df, F.col("hit"), gap=5).collect()
    assert (row.active_s, row.finished) == (active([s for _, s, _ in rows], 5), sum(h for _, _, h in rows))
    assert monitor.throughput(df.limit(0), F.col("hit")).first().active_s == 0.0 and monitor.throughput(df.limit(0), F.col("hit"), ["user"]).count() == 0

    points, targets = df.where("NOT hit").select("user", "event_id", F.col("s").cast("double").alias("at")), df.where("hit").select("user", F.col("s").cast("double").alias("at"))
    near = evaluation.nearest_distance(points, targets, ["user"])
    marks = {u: sorted(s for s, h in v if h) for u, v in users.items()}
    want = []
    for u, s, h in rows:
        if not h:
            k = bisect.bisect_left(marks[u], s)
            want.append((str(u), s, min((abs(s - t) for t in marks[u][max(0, k - 1) : k + 1]), default=None)))
    assert sorted(map(str, want)) == sorted(str((str(r.user), int(r["at"]), None if r.distance is None else int(r.distance))) for r in near.collect())
    largest = in_ranges(df, F.col("s")).groupBy("user", "__range").count().agg(F.max("count")).first()[0]
    assert largest < len(rows) / 25


def test_progress_is_an_upsert(spark):
    row = "run_id string, event string, status string, delta int, ts timestamp"
    at = lambda k: __import__("datetime").datetime(2024, 1, 1, 0, k)
    one = spark.createDataFrame([("r", "parse", "STARTED", None, at(0)), ("r", "parse", "DONE", 3, at(2)), ("r", "chunk", "STARTED", 1, at(3)), (None, "parse", "DONE", 2, at(1))], row)
    two = spark.createDataFrame([("r", "chunk", "DONE", 4, at(5)), ("r", "parse", "STARTED", 1, at(1)), ("s", "parse", "FAILED", 0, at(4))], row)
    first = monitor.progress(one)
    got = {(r.run_id, r.event): (r.status, r.done) for r in monitor.progress(two, first).collect()}
    assert got == {("r", "parse"): ("DONE", 4), ("r", "chunk"): ("DONE", 5), ("s", "parse"): ("FAILED", 0), (None, "parse"): ("DONE", 2)}
