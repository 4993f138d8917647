"""Interval join, as-of merge and split counters against plain loops, with hot keys."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from colloquy.operators import pricing, ranges, segments, usage


def test_points_meet_every_interval_that_holds_them(spark):
    rng = random.Random(5)
    spans = [(k, i, a := rng.randint(-2000, 5000), a + rng.choice([0, -3, 1, 2, 7, 64, 65, 900, 100_000])) for k in range(2) for i in range(150)]
    points = [(rng.randint(0, 2), rng.choice([None, rng.randint(-2500, 6000)])) for _ in range(400)]
    a = spark.createDataFrame([(k, i, t) for i, (k, t) in enumerate(points)], "k long, p long, t long")
    b = spark.createDataFrame(spans, "k long, i long, a long, b long")
    got = sorted((r["p"], r["i"]) for r in ranges.points_in_intervals(a, b, ["k"], "t", "a", "b").collect())
    want = sorted((p, i) for p, (k, t) in enumerate(points) for j, i, x, y in spans if t is not None and j == k and x <= t < y)
    assert got == want and len(want) > 500
    assert ranges.points_in_intervals(a, b.filter("false"), ["k"], "t", "a", "b").count() == 0


def plays(spans, t):
    inside = [(abs(a - t), i) for i, (a, b) in enumerate(spans) if a <= t < b]
    if inside:
        return min(inside)[1]
    gap = [i for i, (a, b) in enumerate(spans) if t > 0 and b <= t and (i + 1 == len(spans) or t < spans[i + 1][0])]
    return max(gap, default=-1)


def test_active_segment_is_the_loop(spark):
    rng = random.Random(7)
    talks = {c: sorted((a := rng.randint(0, 3000), a + rng.choice([0, 5, 80, 700])) for _ in range(rng.choice([0, 1, 25]))) for c in range(12)}
    probes = [(c, p, rng.randint(-200, 4000), rng.choice([-100, 0, 100])) for c in range(12) for p in range(60)]
    s = spark.createDataFrame([(c, i, a, b) for c, spans in talks.items() for i, (a, b) in enumerate(spans)], "conversation_id long, segment_index long, start_ms long, end_ms long")
    p = spark.createDataFrame(probes, "conversation_id long, probe_id long, position_ms long, offset_ms int")
    got = {(r["conversation_id"], r["probe_id"]): r["segment_index"] for r in segments.active_segment(p, s).collect()}
    assert got == {(c, k): plays(talks[c], t + o) for c, k, t, o in probes}


def test_one_conversation_of_many_segments(spark):
    """Every probe of a long recording meets a few segments, not all."""
    n = 200_000
    s = spark.range(n).select(F.lit(1).cast("long").alias("conversation_id"), F.col("id").alias("segment_index"), (F.col("id") * 100).alias("start_ms"), (F.col("id") * 100 + 60).alias("end_ms"))
    p = spark.range(n).select(F.lit(1).cast("long").alias("conversation_id"), F.col("id").alias("probe_id"), (F.col("id") * 100 + 70).alias("position_ms"), F.lit(0).alias("offset_ms"))
    assert segments.active_segment(p, s).filter("segment_index <> probe_id").count() == 0


def test_prices_as_of_are_the_loop(spark):
    """Two models with many versions, a moment with a third of the probes, times before all versions, expired ones."""
    rng = random.Random(9)
    day = datetime(2024, 1, 1)
    prices = [(f"p{i}", rng.choice(["tokens-a", "recogniser", "other"]), "tokens", float(i), None, None, day + timedelta(hours=rng.randint(0, 400)), rng.choice([None, day + timedelta(hours=rng.randint(0, 500))])) for i in range(120)]
    hot = day + timedelta(hours=200)
    probes = [(i, hot if i % 3 == 0 else None if i % 50 == 1 else day + timedelta(minutes=rng.randint(-600, 30_000))) for i in range(900)]
    a = spark.createDataFrame(probes, "conversation_id long, timestamp timestamp")
    b = spark.createDataFrame(prices, "pricing_id string, model string, service string, input_price double, output_price double, second_price double, effective_from timestamp, effective_until timestamp")
    got = {r["conversation_id"]: (r["tok_pricing_id"], r["rec_pricing_id"]) for r in pricing.prices_asof(a, b, {"tokens-a": "tok", "recogniser": "rec"}).collect()}

    def valid(model, t):
        past = [p for p in prices if t is not None and p[1] == model and p[6] <= t]
        if not past:
            return None
        p = max(past, key=lambda p: (p[6], p[0]))
        return None if p[7] is not None and p[7] <= t else p[0]

    assert got == {i: (valid("tokens-a", t), valid("recogniser", t)) for i, t in probes}
    none = pricing.prices_asof(a, b.filter("false"), {"tokens-a": "tok"})
    assert none.count() == len(probes) and none.filter("tok_pricing_id IS NOT NULL").count() == 0


def test_a_hot_users_counter_is_the_loop(spark):
    """One user with most events is cut into ranges, which count on from each other."""
    rng = random.Random(3)
    kinds = [usage.CREATED, usage.DELETED, usage.DELETED, "click"]
    rows = [(i, rng.choice([0, 0, 0, 1, None]), rng.choice(kinds[:2] if 500 < i < 900 else kinds), datetime(2024, 1, 1) + timedelta(seconds=rng.randint(0, 3000))) for i in range(1500)]
    df = spark.createDataFrame(rows, "event_id int, user_id int, event_type string, timestamp timestamp")
    assert usage.hot_ranges(df, split=50).first()["bounds"]
    got = {r["event_id"]: r["existing"] for r in usage.clamped_counter(df, split=50).collect()}
    for u in (0, 1, None):
        n = 0
        for i, _, kind, _ in sorted((r for r in rows if r[1] == u), key=lambda r: (r[3], r[0])):
            n = max(0, n + (kind == usage.CREATED) - (kind == usage.DELETED))
            assert got[i] == n
    assert len(got) == len(rows)
