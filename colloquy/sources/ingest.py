"""Reading what recognisers and models wrote: inventories, nested JSON, responses, logs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ASR = "segments array<struct<text string, start string, end string, speaker string, words array<struct<word string, start double, end double>>>>"
ANALYSIS = (
    "title string, topics array<struct<title string, startSegmentIndex bigint, endSegmentIndex bigint, type string>>, terms array<struct<id string, term string, definition string, aliases array<string>>>, "
    "people array<struct<name string, affiliation string>>, speakerNotes array<struct<speakerId string, inferredName string, role string, notes string>>"
)
CORRECTIONS = "corrections array<struct<segmentIndex int, newSpeaker string, reason string>>"
MOST_AUDIO = 100 * 1024 * 1024
AUDIO = ("mp3", "wav", "m4a", "aac", "ogg", "oga", "flac", "webm", "mp4", "opus")


def audio_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Recordings at audio/{user}/{conversation}.{ext} below 100 MB.

    The pattern of the path lists no folder beyond its depth, the source skips files by their length, and
    contents are not read.
    """
    files = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/audio/*/*").select("path", "length", "modificationTime")
    return inventory(files.filter(F.col("length") < MOST_AUDIO))


def write_files(rows: DataFrame, root: str) -> int:
    """Writes ``content`` of each row to ``path`` below a folder that all tasks reach; a repeated task writes the same files. Returns their number."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                store.create_dir(f"{base}/{path}".rpartition("/")[0])
                with store.open_output_stream(f"{base}/{path}") as f:
                    f.write(content)
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]}, pa.schema([("n", pa.int64())]))

    return rows.select("path", F.col("content").cast("binary")).mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def inventory(files: DataFrame) -> DataFrame:
    p = F.regexp_extract("path", r"/?audio/([^/]+)/([^/]+)$", 1)
    name = F.regexp_extract("path", r"/?audio/([^/]+)/([^/]+)$", 2)
    ext = F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit("mp3"))
    rows = files.select("path", F.col("length"), p.alias("user_id"), F.substring_index(name, ".", 1).alias("conversation_id"), ext.alias("ext"))
    return rows.filter((F.col("user_id") != "") & (F.col("length") < MOST_AUDIO) & F.col("ext").isin(*AUDIO))


#: Seconds as they are written, up to 10**15: 32.55 is 32550 ms, where the nearest double floors to 32549.
SECONDS = "decimal(24,9)"


def asr_segments(raw: DataFrame, seconds: str = "double") -> DataFrame:
    """Segments of recogniser output (conversation_id, segments): blank ones drop out, order stays, bad numbers are 0."""
    s = raw.select("conversation_id", F.posexplode("segments").alias("_i", "s")).filter(F.trim(F.coalesce("s.text", F.lit(""))) != "")
    number = lambda c: F.coalesce(F.col(c).try_cast(seconds), F.lit(0).cast(seconds))
    n = F.row_number().over(W.partitionBy("conversation_id").orderBy("_i")) - 1
    return s.select("conversation_id", n.cast("long").alias("segment_index"), F.trim("s.text").alias("text"), number("s.start").alias("start_s"), number("s.end").alias("end_s"), F.col("s.speaker").alias("speaker_id"))


def words_of(nested: DataFrame) -> DataFrame:
    """Flat words with a running index over all segments that have words."""
    s = nested.select("conversation_id", F.posexplode("segments").alias("_i", "_s")).filter(F.col("_s.words").isNotNull())
    w = s.select("conversation_id", "_i", F.posexplode("_s.words").alias("_j", "_w"))
    n = F.row_number().over(W.partitionBy("conversation_id").orderBy("_i", "_j")) - 1
    return w.select("conversation_id", n.cast("long").alias("word_index"), "_w.word", F.col("_w.start").alias("start_s"), F.col("_w.end").alias("end_s"))


def unfenced(text: Column) -> Column:
    """A response without its code fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def analysis_parse(responses: DataFrame) -> DataFrame:
    """Typed analyses; a response that does not parse fails the job."""
    return responses.select("conversation_id", F.from_json(unfenced(F.col("response")), ANALYSIS, {"mode": "FAILFAST"}).alias("a")).select("conversation_id", "a.*")


def corrections_parse(responses: DataFrame) -> DataFrame:
    """Reassignments; a response that does not parse gives none."""
    parsed = F.from_json(unfenced(F.col("response")), CORRECTIONS).getField("corrections")
    empty = F.array().cast("array<struct<segmentIndex int, newSpeaker string, reason string>>")
    c = responses.select("conversation_id", F.posexplode(F.coalesce(parsed, empty)).alias("ordinal", "c"))
    return c.select("conversation_id", "ordinal", F.lit("reassign").alias("action"), F.col("c.segmentIndex").alias("segment_index"), F.col("c.newSpeaker").alias("new_speaker"), F.col("c.reason").alias("reason"))


def append_log(rows: DataFrame, path: str, at: str = "timestamp") -> None:
    """Appends rows below ``path`` by date; nothing is replaced."""
    rows.withColumn("date", F.to_date(at)).write.mode("append").partitionBy("date").parquet(path)


def replace_days(rows: DataFrame, path: str) -> None:
    """Writes daily rows; a day that is there already is replaced, others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
