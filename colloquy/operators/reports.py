"""Display projections of jobs and daily rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import round_half_up


def fixed(x: Column, places: int) -> Column:
    """Fixed decimals, after rounding half up, so that all engines print the same."""
    return F.format_string(f"%.{places}f", round_half_up(x, places))


def took(ms: Column) -> Column:
    """ms, s, m or h by magnitude."""
    return F.when(ms < 1000, F.concat(F.floor(ms + 0.5).cast("string"), F.lit("ms"))).when(ms < 60_000, F.concat(fixed(ms / 1000.0, 1), F.lit("s"))).when(ms < 3_600_000, F.concat(fixed(ms / 60_000.0, 1), F.lit("m"))).otherwise(F.concat(fixed(ms / 3_600_000.0, 1), F.lit("h")))


def money(usd: Column) -> Column:
    """Six, four or two decimals by magnitude; nothing is a dash."""
    usd = round_half_up(usd, 6)
    return F.when(usd == 0, "-").when(usd < 0.01, F.concat(F.lit("$"), fixed(usd, 6))).when(usd < 1, F.concat(F.lit("$"), fixed(usd, 4))).otherwise(F.concat(F.lit("$"), fixed(usd, 2)))


def clock(ms: Column) -> Column:
    """m:ss"""
    return F.concat(F.floor(ms / 60_000).cast("string"), F.lit(":"), F.lpad((F.floor(ms / 1000) % 60).cast("string"), 2, "0"))


def size(n: Column) -> Column:
    """Bytes as B, KB, MB or GB."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, F.concat(fixed(n / 1024.0, 1), F.lit(" KB"))).when(n < 1024**3, F.concat(fixed(n / 1024.0**2, 1), F.lit(" MB"))).otherwise(F.concat(fixed(n / 1024.0**3, 2), F.lit(" GB")))


def title_of(name: Column) -> Column:
    """A file's name without its extension."""
    return F.regexp_replace(name, r"\.[^./]+$", "")


def badge(status: Column) -> Column:
    """How a transcript got its times, or a dash."""
    return F.when(status == "aligned", "Aligned").when(status == "fallback", "Fallback").otherwise("-")


def drift_label(ms: Column, ratio: Column) -> Column:
    """The drift in percent with its sign; nothing where there is none."""
    percent = fixed((ratio - 1) * 100, 1)
    text = F.when(ratio > 1, F.concat(F.lit("+"), percent, F.lit("%"))).otherwise(F.concat(percent, F.lit("%")))
    return F.when(F.coalesce(ms, F.lit(0)).cast("double") * F.coalesce(ratio, F.lit(0.0)) == 0, "").otherwise(text)


def recording_labels(rows: DataFrame) -> DataFrame:
    """In: bytes, file_name, alignment_status, drift_ms, drift_ratio."""
    return rows.select("conversation_id", size(F.col("bytes")).alias("size"), title_of(F.col("file_name")).alias("title"), badge(F.col("alignment_status")).alias("badge"), drift_label(F.col("drift_ms"), F.col("drift_ratio")).alias("drift"))


def job_report(jobs: DataFrame) -> DataFrame:
    return jobs.select(
        "conversation_id", "status", took(F.col("total_ms")).alias("took"), money(F.coalesce("compute_s", F.lit(0.0)) * 0.0023).alias("cost"), clock(F.col("duration_ms")).alias("length"),
        F.date_format("timestamp", "MM/dd").alias("day"), F.concat(F.left(F.col("conversation_id").cast("string"), F.lit(3)), F.lit("...")).alias("short_id"),
    )


def chart_series(daily: DataFrame) -> DataFrame:
    """The daily table in long form, hours to two decimals."""
    wide = daily.select("date", F.col("succeeded").cast("double").alias("succeeded"), F.col("failed").cast("double").alias("failed"), round_half_up(F.col("audio_hours"), 2).alias("audio_hours"))
    return wide.unpivot(["date"], ["succeeded", "failed", "audio_hours"], "series", "value")
