"""The chain that an upload goes through, for all uploads in one plan, with a channel for those that fail.

Every record carries a result or an error. A recogniser response that cannot be read, or holds no speech, fails
its conversation, which leaves as zeroed metrics and a failed event; the others go on. Corrections that cannot
be read are none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources import ingest
from . import mentions, segments

FIGURES = ("segments", "speakers", "duration_ms", "corrections", "terms", "occurrences")


def read(uploads: DataFrame) -> DataFrame:
    """(conversation_id, user_id, segments, error) of each upload: one of the last two is null."""
    parsed = F.from_json("asr", ingest.ASR).getField("segments")
    rows = uploads.select("conversation_id", "user_id", parsed.alias("segments"), F.try_parse_json("asr").isNotNull().alias("_json"))
    spoken = F.exists("segments", lambda s: F.trim(F.coalesce(s["text"], F.lit(""))) != "")
    error = F.when(~F.col("_json"), "response is not JSON").when(F.col("segments").isNull() | ~F.coalesce(spoken, F.lit(False)), "no segments")
    return rows.select("conversation_id", "user_id", F.when(error.isNull(), F.col("segments")).alias("segments"), error.alias("error"))


def processed(uploads: DataFrame, terms: DataFrame, observed: Observation | None = None) -> DataFrame:
    """A row for each upload: status, error, figures, speaker names and the stored document.

    In: conversation_id, user_id, asr and corrections as text; terms as for term_occurrences. ``observed`` takes
    the numbers of uploads, failed ones and segments as the rows go by.
    """
    channel = read(uploads)
    raw = segments.asr_segments(ingest.asr_segments(channel.filter("error IS NULL").select("conversation_id", "segments"), ingest.SECONDS))
    names = segments.speaker_numbering(raw)
    fixed = segments.apply_reassign(raw, ingest.corrections_parse(uploads.select("conversation_id", F.col("corrections").alias("response"))))
    named = segments.segment_speaker(fixed, names)
    whole = segments.boundary_repair(raw).drop("speaker_id").join(fixed.select("conversation_id", "segment_index", "speaker_id", "corrected"), ["conversation_id", "segment_index"])
    documents = segments.assemble(whole)
    people = named.groupBy("conversation_id").agg(F.array_sort(F.collect_set("display_name")).alias("speaker_names"))
    counts = whole.groupBy("conversation_id").agg(F.count("*").alias("segments"), F.countDistinct("speaker_id").alias("speakers"), F.max_by("end_ms", "segment_index").alias("duration_ms"), F.count_if("corrected").alias("corrections"))
    found = mentions.term_occurrences(whole, terms).groupBy("conversation_id").agg(F.countDistinct("term_id").alias("terms"), F.count("*").alias("occurrences"))
    out = channel.select("conversation_id", "user_id", "error")
    for part in (counts, found, people, documents.select("conversation_id", F.col("segments").alias("document"))):
        out = out.join(part, "conversation_id", "left")
    status = F.when(F.col("error").isNull(), "complete").otherwise("failed")
    out = out.select("conversation_id", "user_id", status.alias("status"), "error", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in FIGURES], "speaker_names", "document")
    if observed is not None:
        out = out.observe(observed, F.count(F.lit(1)).alias("uploads"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum("segments").alias("segments"))
    return out


def event_type() -> Column:
    return F.when(F.col("status") == "complete", "processing_completed").otherwise("processing_failed")


def events(done: DataFrame) -> DataFrame:
    """An activity event for each upload, with its figures or its error as metadata."""
    meta = F.when(F.col("status") == "complete", F.to_json(F.struct(F.col("duration_ms").alias("durationMs"), F.col("segments").alias("segmentCount")))).otherwise(F.to_json(F.struct(F.col("error").alias("errorMessage"))))
    return done.select("conversation_id", event_type().alias("event_type"), "user_id", meta.alias("metadata"))
