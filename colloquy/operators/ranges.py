"""Joins on ranges without nested loops: points in intervals, and the last of many versions as of a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.shared import fresh_path


def _bits(width: Column) -> Column:
    """The least k for which 2^k is at least the width."""
    return F.when(width <= 1, F.lit(0)).otherwise(F.length(F.bin(width - 1))).cast("int")


def points_in_intervals(points: DataFrame, intervals: DataFrame, on: list[str], at: str, start: str, end: str) -> DataFrame:
    """Pairs of a point and an interval ``[start, end)`` of the same ``on`` that holds it; longs, all columns of both.

    Intervals fall into classes by width, and time into buckets as wide as the class: an interval touches two
    at most, and a point has one a class. So pairs meet by equal keys, and of those that meet at least about a
    quarter match. Only classes that occur are looked at; there are 63 at most. Empty intervals and null points match nothing.
    """
    width = F.col(end) - F.col(start)
    wide = intervals.filter(width > 0).withColumn("_class", _bits(width))
    classes = sorted(r[0] for r in wide.select("_class").distinct().collect())
    shift = lambda x, k: F.call_function("shiftright", x.cast("long"), k)
    buckets = F.array_distinct(F.array(shift(F.col(start), F.col("_class")), shift(F.col(end) - 1, F.col("_class"))))
    kept = wide.withColumn("_bucket", F.explode(buckets))
    probes = points.withColumn("_class", F.explode(F.array(*[F.lit(k).cast("int") for k in classes]).cast("array<int>"))).withColumn("_bucket", shift(F.col(at), F.col("_class")))
    return probes.join(kept, [*on, "_class", "_bucket"]).filter((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop("_class", "_bucket")


def ranged(rows: DataFrame, order: list[str], name: str, tasks: int | None = None) -> DataFrame:
    """``rows`` stored in ranges of ``order``, with the number of its range in ``_range``: ranges rise with the order and are of like size."""
    spark = rows.sparkSession
    path = fresh_path(spark, name)
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(tasks, *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    return spark.read.parquet(path)


def last_before(probes: DataFrame, versions: DataFrame, at: str, since: str, kinds: dict[str, Column], tasks: int | None = None) -> DataFrame:
    """Adds to each probe, for every name in ``kinds``, the last version of that kind with ``since`` not after ``at``, as a struct.

    Probes and versions are put in one order of time and cut into ranges; equal times of a hot moment are
    spread by a hash. Within a range the last version is carried forward; the last one of all ranges before comes from a
    table with a row for each range. ``versions`` have one row for each kind and time; ``kinds`` are conditions on them.
    """
    row = F.struct(*probes.columns)
    what = F.struct(*versions.columns)
    none = lambda df, c: F.lit(None).cast(df.select(c.alias("x")).schema["x"].dataType)
    a = probes.select(F.col(at).alias("_at"), F.lit(1).alias("_side"), F.xxhash64(row).alias("_salt"), row.alias("_row"), none(versions, what).alias("_version"), *[F.lit(False).alias(f"_is_{k}") for k in kinds])
    b = versions.select(F.col(since).alias("_at"), F.lit(0).alias("_side"), F.lit(0).cast("long").alias("_salt"), none(probes, row).alias("_row"), what.alias("_version"), *[F.coalesce(c, F.lit(False)).alias(f"_is_{k}") for k, c in kinds.items()])
    both = ranged(a.unionByName(b), ["_at", "_side", "_salt"], "asof", tasks)
    order = ["_at", "_side", "_salt"]
    lasts = both.filter("_side = 0").groupBy("_range").agg(*[F.max_by(F.when(F.col(f"_is_{k}"), F.col("_version")), F.when(F.col(f"_is_{k}"), F.col("_at"))).alias(f"_last_{k}") for k in kinds])
    every = both.select("_range").distinct().join(lasts, "_range", "left")
    # a row for each range stands in this window
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    carried = every.select("_range", *[F.last(f"_last_{k}", True).over(before).alias(f"_carried_{k}") for k in kinds])
    inside = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = both.select("*", *[F.last(F.when(F.col(f"_is_{k}"), F.col("_version")), True).over(inside).alias(f"_in_{k}") for k in kinds]).filter("_side = 1")
    out = out.join(F.broadcast(carried), "_range", "left")
    return out.select("_row.*", *[F.coalesce(F.col(f"_in_{k}"), F.col(f"_carried_{k}")).alias(k) for k in kinds])
