"""Stored documents as tables: access, validity, normal form, upserts, differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The states that a conversation may have.
STATUSES = ("processing", "needs_review", "complete", "failed")


def conversations_for_user(conversations: DataFrame, user: int) -> DataFrame:
    return conversations.filter(F.col("user_id") == user).orderBy(F.desc("created_at"), F.desc("conversation_id"))


def row_access(rows: DataFrame, user: int, admin: bool) -> DataFrame:
    """Owners see their rows, admins all."""
    return rows.filter((F.col("user_id") == user) | F.lit(admin))


def conversation_validity(rows: DataFrame) -> DataFrame:
    """How many rows break each rule."""
    missing = lambda c: F.count_if(F.col(c).isNull())
    bad = F.count_if(F.col("status").isNull() | ~F.col("status").isin(*STATUSES))
    wide = rows.agg(missing("conversation_id").alias("conversation_id"), missing("user_id").alias("user_id"), missing("title").alias("title"), missing("created_at").alias("created_at"), bad.alias("status"))
    return wide.unpivot([], wide.columns, "rule", "failures")


def doc_normalise(rows: DataFrame, lists: list[str]) -> DataFrame:
    """Timestamps as ISO strings; missing lists are empty."""
    iso = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return rows.withColumns({"created_at": iso} | {c: F.coalesce(c, F.array()) for c in lists})


def keyed_upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Merge by id: a supplied field replaces, a missing one stays; new ids are added."""
    cols = [c for c in old.columns if c != key]
    n = new.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in cols])
    j = old.join(n, F.col(key) == F.col("_k"), "full_outer")
    return j.select(F.coalesce(key, "_k").alias(key), *[F.coalesce(f"_{c}", c).alias(c) for c in cols])


def snapshot_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change) of added, removed and modified rows; rows are compared by all other columns."""
    cols = [c for c in before.columns if c != key]
    a = before.select(F.col(key).alias("_a"), F.struct(*cols).alias("_old"))
    b = after.select(F.col(key).alias("_b"), F.struct(*cols).alias("_new"))
    j = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "modified")
    return j.select(F.coalesce("_a", "_b").alias(key), change.alias("change"), "_old", "_new").filter("change is not null")


def lifecycle_events(diff: DataFrame, key: str = "conversation_id") -> DataFrame:
    """Created and deleted events with their metadata; rows without user are not recorded."""
    row = F.coalesce("_new", "_old")
    created = F.col("change") == "added"
    meta = F.when(created, F.to_json(F.struct(row["title"].alias("title"), row["status"].alias("status")))).otherwise(F.to_json(F.struct(row["title"].alias("title"), row["title"].isNotNull().alias("hadAudioUrl"))))
    kind = F.when(created, "conversation_created").otherwise("conversation_deleted")
    return diff.filter("change in ('added', 'removed')").select(key, kind.alias("event_type"), row["user_id"].alias("user_id"), meta.alias("metadata")).filter("user_id is not null")
