"""The nightly job: users, days and the whole, brought up to date in tables that readers see whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import ingest, snapshots
from ..sources.shared import fresh_path
from . import usage


def nightly(events: DataFrame, jobs: DataFrame, as_of: str, root: str) -> None:
    """Merges users and the global row by key, and replaces days, below ``root``. A run that is repeated changes no figure."""
    spark = events.sparkSession
    path = fresh_path(spark, "users")
    usage.user_lifetime(events).write.parquet(path)
    life = spark.read.parquet(path)
    rows = life.join(usage.rolling_windows(events, jobs, as_of), "user_id", "left")
    snapshots.write(spark, f"{root}/users", rows, "user_id", at="updated_at")
    ingest.replace_days(usage.daily_stats(events, jobs), f"{root}/daily")
    snapshots.write(spark, f"{root}/global", usage.global_stats(life, jobs, as_of).withColumn("id", F.lit("all")), "id", at="updated_at")
