"""Streams that stop and go on, batches that are repeated, and rows that come late."""

import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from colloquy.operators import usage
from colloquy.sources.shared import fresh_path
from colloquy.streaming import jobs

EVENTS = "event_id long, event_type string, user_id long, timestamp timestamp"
JOBS = "user_id long, status string, duration_ms double, total_ms double, analysis_in long, analysis_out long, correction_in long, correction_out long, compute_s double, timestamp timestamp"
DAY = datetime(2024, 1, 1)


def some_events(n, seed):
    rng = random.Random(seed)
    kinds = [usage.CREATED, usage.DELETED, usage.DELETED, "click"]
    return [(seed * 10_000 + i, rng.choice(kinds), rng.choice([1, 1, 1, 2, 3, None]), DAY + timedelta(minutes=rng.randint(0, 9000))) for i in range(n)]


def test_counters_go_on_from_the_checkpoint(spark):
    """A second run starts from the state that the first left; a batch counts in order of time, whatever the order of its rows."""
    path, sink, offsets = (fresh_path(spark, n) for n in ("source", "stats", "offsets"))
    batches = [some_events(400, 1), some_events(300, 2)]
    for rows in batches:
        df = spark.createDataFrame(rows, EVENTS)
        df.coalesce(1).write.mode("append").parquet(path)
        jobs.run(jobs.user_stats(jobs.read_events(spark, path, df.schema)), jobs.to_folder(sink), offsets, "update")
    got = {r["user_id"]: (r["existing"], r["created"], r["deleted"], r["last_activity_at"]) for r in jobs.latest(spark.read.parquet(sink), "user_id").collect()}
    for u in (1, 2, 3):
        existing = created = deleted = 0
        for rows in batches:
            for _, kind, _, _ in sorted((r for r in rows if r[2] == u), key=lambda r: (r[3], r[0])):
                created, deleted = created + (kind == usage.CREATED), deleted + (kind == usage.DELETED)
                existing = max(0, existing + (kind == usage.CREATED) - (kind == usage.DELETED))
        assert got[u] == (existing, created, deleted, max(r[3] for rows in batches for r in rows if r[2] == u))
    assert set(got) == {1, 2, 3}


def test_daily_rollup_takes_batches_late_and_twice(spark):
    metrics = spark.createDataFrame([(1, "success", 60000.0, 10.0, 1, 1, 1, 1, 2.0, DAY + timedelta(days=2)), (2, "failed", 0.0, 0.0, None, None, None, None, None, DAY + timedelta(days=9))], JOBS)
    parts, sink = fresh_path(spark, "parts"), fresh_path(spark, "daily")
    first, second = (spark.createDataFrame(some_events(300, s), EVENTS) for s in (3, 4))
    late = second.filter(F.col("timestamp") < F.lit(DAY + timedelta(days=1)))
    for n, df in ((0, first), (1, late), (1, late), (2, second.limit(0))):
        jobs.daily_rollup(df, n, metrics, parts, sink)
    files = lambda: {f"{at}/{f}": os.stat(f"{at}/{f}").st_mtime_ns for at, _, names in os.walk(sink) for f in names if "date=" in at}
    before = files()
    jobs.daily_rollup(late, 1, metrics, parts, sink)
    after = files()
    # only the day that the batch touches was written anew
    assert {p for p in before if p not in after or after[p] != before[p]} == {p for p in before if "date=2024-01-01" in p}
    every = first.unionByName(late)
    want = {r["date"]: (r["created"], r["deleted"], r["succeeded"]) for r in usage.daily_stats(every, metrics).collect()}
    daily = usage.with_idle_days(spark.read.parquet(sink)).withColumn("date", F.date_format("date", "yyyy-MM-dd"))
    assert {r["date"]: (r["created"], r["deleted"], r["succeeded"]) for r in daily.collect()} == want
    sums = spark.read.parquet(parts)
    rolling = {r["user_id"]: (r["created_7d"], r["deleted_7d"]) for r in usage.rolling_from_parts(sums, "2024-01-09 02:00:00").collect()}
    recent = every.filter(F.col("timestamp") >= F.lit(datetime(2024, 1, 2, 2))).groupBy("user_id").agg(F.count_if(F.col("event_type") == usage.CREATED), F.count_if(F.col("event_type") == usage.DELETED)).collect()
    assert rolling == {r[0]: (r[1], r[2]) for r in recent if r[0] is not None}
    total = usage.global_from_parts(sums, "2024-01-09 02:00:00").first()
    assert total["users"] == 3 and total["created"] == every.filter(F.col("user_id").isNotNull() & (F.col("event_type") == usage.CREATED)).count()
