"""Usage analytics: event log to per-user, rolling, daily and global statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numbers import exact_sum, exact_sum_if, hours, json_number, round_half_up
from ..sources.shared import fresh_path

CREATED, DELETED, COMPLETED, FAILED = "conversation_created", "conversation_deleted", "processing_completed", "processing_failed"


#: A user with more than a thousandth of all events, and with so many, is cut into ranges of time of about so many.
HOT, SPLIT = 1000, 200_000


def hot_ranges(events: DataFrame, split: int = SPLIT) -> DataFrame | None:
    """(user_id, bounds) of users with too many events for a task: times that cut them into ranges of like size. None: there are no such users.

    No more than HOT users can each have a HOT-th of all events, and their ranges are no more than twice as many.
    """
    counts = events.groupBy("user_id").agg(F.count("*").alias("n"))
    total, top = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max(F.when(F.col("user_id").isNotNull(), F.col("n"))), F.lit(0))).first()
    most = max(total // HOT, split)
    if top <= most:
        return None
    k = F.ceil(F.col("n") / F.lit(float(most))).cast("int")
    hot = counts.filter((F.col("n") > most) & F.col("user_id").isNotNull()).withColumn("k", k)
    micros = F.unix_micros(F.col("timestamp").cast("timestamp"))
    # a hundred quantiles a user at the least; as many as there are to be ranges at the most
    at = events.select("user_id", micros.alias("us")).join(F.broadcast(hot.select("user_id")), "user_id")
    steps = max([100, *(r["k"] for r in hot.select("k").collect())])
    cuts = at.groupBy("user_id").agg(F.percentile_approx("us", [i / steps for i in range(1, steps)], 10 * steps).alias("cuts"))
    return cuts.join(hot, "user_id").select("user_id", F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda i: F.element_at("cuts", F.greatest(F.lit(1), (i * steps / F.col("k")).cast("int"))))).alias("bounds"))


def clamped_counter(events: DataFrame, split: int = SPLIT) -> DataFrame:
    """Running +1/-1 count per user that never falls below 0: S - min(0, least S so far).

    A hot user's events are counted in ranges of time, each in a task of its own. A range is summed up by its
    sum and the least sum within it; those of earlier ranges, a few rows a user, give each range its start.
    """
    step = F.when(F.col("event_type") == CREATED, 1).when(F.col("event_type") == DELETED, -1).otherwise(0)
    ranges = hot_ranges(events, split)
    if ranges is None:
        order = W.partitionBy("user_id").orderBy("timestamp", "event_id").rowsBetween(W.unboundedPreceding, 0)
        s = events.withColumn("_s", F.sum(step).over(order))
        return s.withColumn("existing", (F.col("_s") - F.least(F.lit(0), F.min("_s").over(order))).cast("long")).drop("_s")
    bounds = fresh_path(events.sparkSession, "bounds")
    ranges.write.parquet(bounds)
    hot = F.broadcast(events.sparkSession.read.parquet(bounds))
    micros = F.unix_micros(F.col("timestamp").cast("timestamp"))
    part = F.coalesce(F.size(F.filter("bounds", lambda b: b < micros)), F.lit(0))
    e = events.join(hot, "user_id", "left").withColumn("_range", F.when(F.col("bounds").isNotNull(), part).otherwise(F.lit(0))).withColumn("_split", F.col("bounds").isNotNull()).drop("bounds")
    order = W.partitionBy("user_id", "_range").orderBy("timestamp", "event_id").rowsBetween(W.unboundedPreceding, 0)
    s = e.withColumn("_s", F.sum(step).over(order)).withColumn("_m", F.min("_s").over(order))
    before = W.partitionBy("user_id").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ends = e.filter("_split").withColumn("_s", F.sum(step).over(order)).groupBy("user_id", "_range").agg(F.max_by("_s", F.struct("timestamp", "event_id")).alias("_sum"), F.min("_s").alias("_least"))
    starts = ends.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    starts = starts.select("user_id", "_range", "_before", F.least(F.lit(0), F.min(F.col("_before") + F.col("_least")).over(before)).alias("_lowest"))
    # two ranges for each that a hot user can have: a bounded table
    s = s.join(F.broadcast(starts), ["user_id", "_range"], "left")
    base, low = F.coalesce("_before", F.lit(0)), F.coalesce("_lowest", F.lit(0))
    existing = base + F.col("_s") - F.least(F.lit(0), low, base + F.col("_m"))
    return s.select(*events.columns, existing.cast("long").alias("existing"))


def user_lifetime(events: DataFrame) -> DataFrame:
    """The fold of each user's events. Unknown types count nothing but move the last activity."""
    rows = clamped_counter(events.filter(F.col("user_id").isNotNull()))
    kind, done = F.col("event_type"), F.col("event_type") == COMPLETED
    count = lambda k, name: F.count_if(kind == k).alias(name)
    return rows.groupBy("user_id").agg(
        count(CREATED, "created"), count(DELETED, "deleted"), count(COMPLETED, "succeeded"), count(FAILED, "failed"),
        F.max_by("existing", F.struct("timestamp", "event_id")).alias("existing"),
        round_half_up(exact_sum_if(done, hours(json_number(F.col("metadata"), "durationMs"))), 3).alias("audio_hours"),
        round_half_up(exact_sum_if(done, json_number(F.col("metadata"), "estimatedCostUsd")), 6).alias("cost_usd"),
        F.min("timestamp").alias("first_activity_at"), F.max("timestamp").alias("last_activity_at"),
    )


def rolling_windows(events: DataFrame, jobs: DataFrame, as_of: str, days: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Per user, counts and sums of the last days: one conditional aggregation over each table."""
    now = F.lit(as_of).cast("timestamp")
    since = {d: now - F.expr(f"INTERVAL {d} DAYS") for d in days}
    at, kind, ok = F.col("timestamp"), F.col("event_type"), F.col("status") == "success"
    e = events.filter(F.col("user_id").isNotNull()).groupBy("user_id").agg(*[F.count_if((at >= since[d]) & (kind == k)).alias(f"{n}_{d}d") for d in days for k, n in ((CREATED, "created"), (DELETED, "deleted"))])
    aggs = []
    for d in days:
        new = at >= since[d]
        aggs += [F.count_if(new & ok).alias(f"succeeded_{d}d"), F.count_if(new & ~ok).alias(f"failed_{d}d")]
        aggs += [round_half_up(exact_sum_if(new & ok, hours(F.col("duration_ms"))), 3).alias(f"audio_hours_{d}d"), round_half_up(exact_sum_if(new & ok, F.col("compute_s") * 0.0023), 6).alias(f"cost_usd_{d}d")]
    j = jobs.groupBy("user_id").agg(*aggs)
    return e.join(j, "user_id", "left").na.fill(0)


def job_days(jobs: DataFrame) -> DataFrame:
    """What the jobs of each UTC day come to."""
    ok = F.col("status") == "success"
    tokens = sum((F.coalesce(F.col(c), F.lit(0)) for c in ("analysis_in", "analysis_out", "correction_in", "correction_out")), F.lit(0))
    return jobs.groupBy(F.to_date("timestamp").alias("date")).agg(
        F.countDistinct("user_id").alias("active_users"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"),
        round_half_up(exact_sum_if(ok, hours(F.col("duration_ms"))), 3).alias("audio_hours"), F.sum(tokens).cast("long").alias("tokens"),
        round_half_up(exact_sum(F.col("compute_s"))).alias("compute_s"), round_half_up(exact_sum(F.col("compute_s") * 0.0023), 6).alias("cost_usd"),
        round_half_up(F.coalesce(exact_sum_if(ok, F.col("total_ms")) / F.nullif(F.count_if(ok), F.lit(0)), F.lit(0.0))).alias("mean_ms"),
    )


def with_idle_days(daily: DataFrame) -> DataFrame:
    """A row for each day from the first to the last, zeros where there was none."""
    span = daily.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    return span.filter("a is not null").select(F.explode(F.sequence("a", "b")).alias("date")).join(daily, "date", "left").na.fill(0)


def daily_stats(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """A row for each UTC day from the first to the last, idle days included."""
    day = F.to_date("timestamp").alias("date")
    first = events.filter(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.to_date(F.min("timestamp")).alias("date")).groupBy("date").agg(F.count("*").alias("new_users"))
    e = events.groupBy(day).agg(F.count_if(F.col("event_type") == CREATED).alias("created"), F.count_if(F.col("event_type") == DELETED).alias("deleted"))
    span = events.agg(F.min(F.to_date("timestamp")).alias("a"), F.max(F.to_date("timestamp")).alias("b"))
    days = span.filter("a is not null").select(F.explode(F.sequence("a", "b")).alias("date"))
    out = days.join(first, "date", "left").join(e, "date", "left").join(job_days(jobs), "date", "left").na.fill(0)
    return out.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


def activity_parts(events: DataFrame) -> DataFrame:
    """Sums by day, hour and user that may be added up in any order: what the views below rest on."""
    at = F.col("timestamp").cast("timestamp")
    return events.groupBy(F.to_date(at).alias("date"), F.hour(at).alias("hour"), "user_id").agg(F.count_if(F.col("event_type") == CREATED).alias("created"), F.count_if(F.col("event_type") == DELETED).alias("deleted"), F.count("*").alias("events"), F.max(at).alias("last_at"))


def daily_from_parts(parts: DataFrame, jobs: DataFrame) -> DataFrame:
    """Days with activity or jobs, from sums of activity and the jobs themselves."""
    e = parts.groupBy("date").agg(F.sum("created").alias("created"), F.sum("deleted").alias("deleted"))
    return e.join(job_days(jobs), "date", "left").na.fill(0)


def rolling_from_parts(parts: DataFrame, as_of: str, days: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Per user, the activity of the last days before a full hour; hours stand or fall as a whole."""
    now = F.lit(as_of).cast("timestamp")
    at = F.col("date").cast("timestamp") + F.make_interval(hours=F.col("hour"))
    return parts.filter("user_id IS NOT NULL").groupBy("user_id").agg(*[F.coalesce(F.sum(F.when(at >= now - F.expr(f"INTERVAL {d} DAYS"), F.col(c))), F.lit(0)).cast("long").alias(f"{c}_{d}d") for d in days for c in ("created", "deleted")])


def global_from_parts(parts: DataFrame, as_of: str) -> DataFrame:
    """One row over all users: how many, how many of late, and what they did."""
    now = F.lit(as_of).cast("timestamp")
    users = parts.filter("user_id IS NOT NULL").groupBy("user_id").agg(F.max("last_at").alias("last"), F.sum("created").alias("created"), F.sum("deleted").alias("deleted"))
    active = lambda d: F.count_if(F.col("last") >= now - F.expr(f"INTERVAL {d} DAYS"))
    return users.agg(F.count("*").alias("users"), active(7).alias("active_7d"), active(30).alias("active_30d"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("created", "deleted")])


def usage_levels(events: DataFrame) -> DataFrame:
    """Counts and sums of users, of days and of all, from one scan and one exchange: a row for each, named by ``level``."""
    kind, done = F.col("event_type"), F.col("event_type") == COMPLETED
    numbers = [F.when(done, hours(json_number(F.col("metadata"), "durationMs"))).alias("h"), F.when(done, json_number(F.col("metadata"), "estimatedCostUsd")).alias("usd")]
    rows = events.filter("user_id IS NOT NULL").select("user_id", F.to_date("timestamp").alias("date"), "timestamp", kind, *numbers)
    count = lambda k, name: F.count_if(kind == k).alias(name)
    sets = rows.groupingSets([["user_id"], ["date"], []], "user_id", "date")
    out = sets.agg(
        F.grouping_id().alias("_level"), count(CREATED, "created"), count(DELETED, "deleted"), count(COMPLETED, "succeeded"), count(FAILED, "failed"),
        round_half_up(exact_sum(F.col("h")), 3).alias("audio_hours"), round_half_up(exact_sum(F.col("usd")), 6).alias("cost_usd"), F.min("timestamp").alias("first_activity_at"), F.max("timestamp").alias("last_activity_at"),
    )
    level = F.when(F.col("_level") == 1, "user").when(F.col("_level") == 2, "day").otherwise("all")
    # the set of all rows has a row even where there are none
    return out.filter("first_activity_at IS NOT NULL").select(level.alias("level"), *[c for c in out.columns if c != "_level"])


def latest_jobs(jobs: DataFrame, n: int | None = 1000) -> DataFrame:
    """The newest jobs, the greater id first of equals; None: all."""
    return jobs if n is None else jobs.orderBy(F.desc("timestamp"), F.desc("conversation_id")).limit(n)


def global_stats(users: DataFrame, jobs: DataFrame, as_of: str, max_jobs: int | None = 1000) -> DataFrame:
    """One row over the users' lifetimes and the latest jobs."""
    now = F.lit(as_of).cast("timestamp")
    active = lambda d: F.count_if(F.col("last_activity_at") >= now - F.expr(f"INTERVAL {d} DAYS"))
    u = users.agg(F.count("*").alias("users"), active(7).alias("active_7d"), active(30).alias("active_30d"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("created", "deleted", "existing")])
    ok = F.col("status") == "success"
    both = lambda a, b: F.coalesce(F.sum(F.coalesce(F.col(a), F.lit(0)) + F.coalesce(F.col(b), F.lit(0))), F.lit(0)).cast("long")
    j = latest_jobs(jobs, max_jobs).agg(
        F.count("*").alias("jobs"), round_half_up(F.coalesce(100.0 * F.count_if(ok) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), 1).alias("success_percent"),
        round_half_up(F.coalesce(exact_sum_if(ok, F.coalesce("total_ms", F.lit(0.0))) / F.nullif(F.count_if(ok), F.lit(0)), F.lit(0.0))).alias("mean_ms"),
        round_half_up(exact_sum_if(ok, hours(F.col("duration_ms"))), 2).alias("audio_hours"),
        both("analysis_in", "correction_in").alias("input_tokens"), both("analysis_out", "correction_out").alias("output_tokens"),
        round_half_up(exact_sum(F.col("compute_s"))).alias("compute_s"), round_half_up(exact_sum(F.col("compute_s") * 0.0023), 2).alias("cost_usd"),
    )
    return u.crossJoin(j)  # one row each


def top_users(users: DataFrame, n: int = 100) -> DataFrame:
    return users.orderBy(F.desc("last_activity_at"), F.desc("user_id")).limit(n).select("user_id", "created", "existing", "audio_hours", "cost_usd")


def recent_jobs(jobs: DataFrame, n: int, condition: Column) -> DataFrame:
    """The newest n and of these the wanted: the filter stays above the limit."""
    return latest_jobs(jobs, n).filter(condition)


def distinct_users(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.countDistinct(F.nullif(F.col("user_id").cast("string"), F.lit(""))).alias("users"))


def day_window(events: DataFrame, as_of: str) -> DataFrame:
    """Events of the day before ``as_of``: from its midnight to the next, half open."""
    today = F.date_trunc("day", F.lit(as_of).cast("timestamp"))
    return events.filter((F.col("timestamp") >= today - F.expr("INTERVAL 1 DAY")) & (F.col("timestamp") < today))


def usage_summary(windows: DataFrame) -> DataFrame:
    """Jobs and hours of each user's windows, in long form."""
    part = lambda d: F.struct(F.lit(f"{d}d").alias("window"), (F.col(f"succeeded_{d}d") + F.col(f"failed_{d}d")).alias("jobs"), F.col(f"audio_hours_{d}d").alias("audio_hours"), F.col(f"cost_usd_{d}d").alias("cost_usd"))
    return windows.select("user_id", F.inline(F.array(part(7), part(30))))


def token_millions(stats: DataFrame) -> DataFrame:
    """Tokens in millions, to two decimals: in, out and both."""
    million = lambda c: round_half_up(c / 1_000_000.0, 2)
    a, b = F.col("input_tokens"), F.col("output_tokens")
    return stats.select(million(a + b).alias("tokens_m"), million(a).alias("input_m"), million(b).alias("output_m"))


def activity_union(lifecycle: DataFrame, processing: DataFrame) -> DataFrame:
    """One feed of both writers."""
    cols = ["event_id", "event_type", "user_id", "conversation_id", "timestamp"]
    return lifecycle.select(*cols).unionByName(processing.select(*cols))
