"""Queries that run the streaming jobs and the readers over files written from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import usage
from ..operators.nightly import nightly
from ..operators.segments import step_percent
from ..sources import ingest, snapshots
from ..sources.shared import fresh_path
from ..streaming import jobs
from . import analytics as an
from . import fixtures as fx
from .fixtures import with_views
from .registry import query


def _source(spark, rows, name="source"):
    path = fresh_path(spark, name)
    rows.write.parquet(path)
    return path


def _events(spark, sf):
    rows = fx.user_events(spark, sf)
    return jobs.read_events(spark, _source(spark, rows), rows.schema)


@query("event_stream", with_views("user_event", "SELECT strftime(\"timestamp\", '%Y-%m-%d') AS date, count(*) AS events, count(DISTINCT user_id) AS users FROM user_event GROUP BY 1"))
def event_stream(spark, sf):
    sink = fresh_path(spark, "log")
    jobs.append_events(_events(spark, sf), sink, fresh_path(spark, "offsets"))
    return spark.read.parquet(sink).groupBy(F.date_format("date", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"))


@query("user_stats_stream", with_views("user_event", an.LIFETIME + " SELECT user_id, existing, created, deleted FROM life"))
def user_stats_stream(spark, sf):
    sink = fresh_path(spark, "stats")
    jobs.run(jobs.user_stats(_events(spark, sf)), jobs.to_folder(sink), fresh_path(spark, "offsets"), "update")
    return jobs.latest(spark.read.parquet(sink), "user_id").select("user_id", "existing", "created", "deleted")


@query("latest_snapshot", with_views("user_event", 'SELECT user_id, arg_max(event_type, ROW("timestamp", event_id)) AS event_type, max("timestamp") AS "timestamp" FROM user_event GROUP BY 1'))
def latest_snapshot(spark, sf):
    sink = fresh_path(spark, "latest")
    stream = jobs.latest_by(_events(spark, sf), "user_id", ["timestamp", "event_id"], ["event_type", "timestamp"])
    jobs.run(stream, jobs.to_folder(sink), fresh_path(spark, "offsets"), "update")
    return jobs.latest(spark.read.parquet(sink), "user_id").select("user_id", "event_type", "timestamp")


def _progress(spark, rows):
    """The latest step of each conversation with its percent, and the error that a failed one gives."""
    sink = fresh_path(spark, "progress")
    rows = rows.withColumn("error", F.when(F.col("step") == "failed", F.concat(F.lit("failed at step "), F.col("position").cast("string"))))
    steps = jobs.read_events(spark, _source(spark, rows), rows.schema).withColumn("percent", step_percent(F.col("step")))
    stream = jobs.latest_by(steps, "conversation_id", ["position"], ["step", "position", "percent", "error"])
    jobs.run(stream, jobs.to_folder(sink), fresh_path(spark, "offsets"), "update")
    return jobs.latest(spark.read.parquet(sink), "conversation_id").select("conversation_id", "step", F.col("position").cast("long").alias("position"), "percent", "error")


_PROGRESS = """SELECT *, CASE step WHEN 'uploading' THEN 15 WHEN 'transcribing' THEN 40 WHEN 'analyzing' THEN 60 WHEN 'aligning' THEN 85 WHEN 'finalizing' THEN 95 WHEN 'complete' THEN 100 ELSE 0 END AS percent,
CASE WHEN step = 'failed' THEN 'failed at step ' || position END AS error FROM (SELECT conversation_id, arg_max(step, position) AS step, max(position) AS position FROM {} GROUP BY 1)"""


@query("progress_stream", with_views("progress_event", _PROGRESS.format("progress_event")))
@query("progress_stream_all", with_views("progress_event_all", _PROGRESS.format("progress_event_all")))
def progress_stream(spark, sf):
    """Every user's; the second name is an earlier round's for the same."""
    return _progress(spark, fx.steps(spark, sf))


@query("lifecycle_stream", with_views("conversation snapshot_a snapshot_b", """SELECT conversation_id, 'conversation_created' AS event_type, user_id FROM snapshot_a
UNION ALL SELECT conversation_id, 'conversation_created', user_id FROM snapshot_b WHERE conversation_id NOT IN (SELECT conversation_id FROM snapshot_a)
UNION ALL SELECT conversation_id, 'conversation_deleted', user_id FROM snapshot_a WHERE conversation_id NOT IN (SELECT conversation_id FROM snapshot_b)"""))  # fmt: skip
def lifecycle_stream(spark, sf):
    a, b = fx.snapshots(spark, sf)
    path, state, sink, offsets = (fresh_path(spark, n) for n in ("snapshots", "state", "events", "offsets"))
    for rows in (a, b):  # the second snapshot arrives after the first was handled
        rows.write.mode("append").parquet(path)
        jobs.snapshot_events(jobs.read_events(spark, path, a.schema), state, sink, offsets, "conversation_id")
    return spark.read.parquet(sink).select("conversation_id", "event_type", "user_id")


def _rolled_up(spark, sf):
    """(sums, days) after the events came in three batches that do not follow time, so that most rows are late."""
    rows = fx.user_events(spark, sf)
    path, parts, sink = (fresh_path(spark, n) for n in ("source", "parts", "daily"))
    rows.repartition(3, "event_id").write.parquet(path)
    metrics = fx.job_metrics(spark, sf)
    jobs.run(jobs.read_events(spark, path, rows.schema, files=1), lambda df, n: jobs.daily_rollup(df, n, metrics, parts, sink), fresh_path(spark, "offsets"))
    return spark.read.parquet(parts), spark.read.parquet(sink)


@query("daily_rollup_stream", with_views("user_event job_metric", an.DAILY + " SELECT date, created, deleted, succeeded, audio_hours FROM daily"))
def daily_rollup_stream(spark, sf):
    """Each batch is summed up by day and user; only the days that it touches are made anew."""
    out = usage.with_idle_days(_rolled_up(spark, sf)[1].select("date", "created", "deleted", "succeeded", "audio_hours"))
    return out.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query("rolling_rollup_stream", with_views("user_event job_metric", an.ROLLING + " SELECT user_id, created_7d, deleted_7d, created_30d, deleted_30d FROM roll"))
def rolling_rollup_stream(spark, sf):
    """Activity of the last days from the sums of the batches, without the log."""
    return usage.rolling_from_parts(_rolled_up(spark, sf)[0], fx.AS_OF)


@query("global_rollup_stream", with_views("user_event", f"""SELECT count(*) AS users, count(*) FILTER (last >= TIMESTAMP '{fx.AS_OF}' - INTERVAL 7 DAY) AS active_7d, count(*) FILTER (last >= TIMESTAMP '{fx.AS_OF}' - INTERVAL 30 DAY) AS active_30d, coalesce(sum(created), 0)::BIGINT AS created, coalesce(sum(deleted), 0)::BIGINT AS deleted
FROM (SELECT user_id, max("timestamp") AS last, count(*) FILTER (event_type = 'conversation_created') AS created, count(*) FILTER (event_type = 'conversation_deleted') AS deleted FROM user_event WHERE user_id IS NOT NULL GROUP BY 1)"""))  # fmt: skip
def global_rollup_stream(spark, sf):
    return usage.global_from_parts(_rolled_up(spark, sf)[0], fx.AS_OF)


@query("log_append", with_views("user_event", "SELECT strftime(\"timestamp\", '%Y-%m-%d') AS date, 2 * count(*) AS events FROM user_event GROUP BY 1"))
def log_append(spark, sf):
    sink, rows = fresh_path(spark, "log"), fx.user_events(spark, sf)
    for _ in range(2):
        ingest.append_log(rows, sink)
    return spark.read.parquet(sink).groupBy(F.date_format("date", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("events"))


@query("asr_ingest", with_views("segment", "SELECT conversation_id, segment_index, trim(text) AS text, start_ms / 1000.0::DOUBLE AS start_s, speaker_id FROM segment"))
def asr_ingest(spark, sf):
    """Recogniser JSON written from the segments, blank ones between, and read back by schema."""
    s = fx.segments(spark, sf)
    part = lambda text, start: F.struct(text.alias("text"), start.cast("string").alias("start"), F.lit("x").alias("end"), F.col("speaker_id").alias("speaker"))
    pair = F.array(part(F.col("text"), F.col("start_ms") / 1000.0), part(F.lit("  "), F.lit(0.0)))
    rows = s.groupBy("conversation_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("segment_index", pair.alias("p")))), lambda x: x["p"])).alias("segments"))
    path = fresh_path(spark, "asr")
    rows.write.json(path)
    raw = spark.read.schema(f"conversation_id bigint, {ingest.ASR}").json(path)
    return ingest.asr_segments(raw).select("conversation_id", "segment_index", "text", "start_s", "speaker_id")


@query("analysis_parse", with_views("segment", "SELECT conversation_id, 'talk ' || conversation_id AS title, count(*)::BIGINT AS n_topics FROM segment GROUP BY conversation_id"))
def analysis_parse(spark, sf):
    n = fx.segments(spark, sf).groupBy("conversation_id").agg(F.collect_list(F.struct(F.lit("t").alias("title"), F.col("segment_index").alias("startSegmentIndex"))).alias("topics"))
    body = F.to_json(F.struct(F.concat(F.lit("talk "), F.col("conversation_id").cast("string")).alias("title"), "topics"))
    responses = n.select("conversation_id", F.concat(F.lit("```json\n"), body, F.lit("\n```")).alias("response"))
    return ingest.analysis_parse(responses).select("conversation_id", "title", F.size("topics").cast("long").alias("n_topics"))


@query("corrections_parse", with_views("segment correction", "SELECT conversation_id, 'reassign' AS action, segment_index::INT AS segment_index, new_speaker FROM correction WHERE conversation_id % 5 <> 0"))
def corrections_parse(spark, sf):
    c = fx.corrections(spark, sf).groupBy("conversation_id").agg(F.collect_list(F.struct(F.col("segment_index").alias("segmentIndex"), F.col("new_speaker").alias("newSpeaker"))).alias("corrections"))
    body = F.when(F.col("conversation_id") % 5 == 0, "no JSON {").otherwise(F.concat(F.lit("```\n"), F.to_json(F.struct("corrections")), F.lit("\n```")))
    return ingest.corrections_parse(c.select("conversation_id", body.alias("response"))).select("conversation_id", "action", "segment_index", "new_speaker")


@query("audio_inventory", with_views("conversation", "SELECT conversation_id::VARCHAR AS conversation_id, user_id::VARCHAR AS user_id, CASE WHEN conversation_id % 3 = 0 THEN 'wav' ELSE 'mp3' END AS ext, duration_ms AS length FROM conversation WHERE conversation_id % 4 <> 0 AND duration_ms < 104857600"))
def audio_inventory(spark, sf):
    """A listing made from the conversations, every fourth path of the wrong depth."""
    c = fx.conversations(spark, sf)
    name = F.concat(F.col("conversation_id").cast("string"), F.when(F.col("conversation_id") % 3 == 0, ".v2.WAV").otherwise(""))
    deep = F.when(F.col("conversation_id") % 4 == 0, "old/").otherwise("")
    files = c.select(F.concat(F.lit("store/audio/"), F.col("user_id").cast("string"), F.lit("/"), deep, name).alias("path"), F.col("duration_ms").alias("length"))
    return ingest.inventory(files).select("conversation_id", "user_id", "ext", "length")


@query("audio_scan", with_views("segment", """SELECT conversation_id::VARCHAR AS conversation_id, (conversation_id % 9)::VARCHAR AS user_id, CASE WHEN conversation_id % 3 = 0 THEN 'wav' ELSE 'mp3' END AS ext, strlen(text)::BIGINT AS length
FROM segment WHERE segment_index = 0 AND conversation_id % 4 <> 0 AND conversation_id % 6 <> 1"""))  # fmt: skip
def audio_scan(spark, sf):
    """A file for each conversation, some too deep and some of another kind, written to the shared folder and scanned."""
    c, root = F.col("conversation_id"), fresh_path(spark, "store")
    name = F.concat(c.cast("string"), F.when(c % 6 == 1, ".txt").when(c % 3 == 0, ".v2.WAV").otherwise(""))
    path = F.concat(F.lit("audio/"), (c % 9).cast("string"), F.lit("/"), F.when(c % 4 == 0, "old/").otherwise(""), name)
    ingest.write_files(fx.segments(spark, sf).filter("segment_index = 0").select(path.alias("path"), F.col("text").alias("content")), root)
    return ingest.audio_inventory(spark, root).select("conversation_id", "user_id", "ext", "length")


@query("versioned_upsert", with_views("conversation snapshot_a snapshot_b", """SELECT coalesce(a.conversation_id, b.conversation_id) AS conversation_id, coalesce(b.user_id, a.user_id) AS user_id, coalesce(b.title, a.title) AS title, coalesce(b.status, a.status) AS status, b.conversation_id IS NOT NULL AS changed
FROM snapshot_a a FULL JOIN snapshot_b b ON a.conversation_id = b.conversation_id"""))  # fmt: skip
def versioned_upsert(spark, sf):
    """One snapshot replaces an empty table, the next is merged into it; rows that it touched are the later ones."""
    root = fresh_path(spark, "table")
    a, b = fx.snapshots(spark, sf)
    snapshots.write(spark, root, a, "conversation_id", merge=False, at="updated_at")
    first = snapshots.read(spark, root, "updated_at timestamp").agg(F.max("updated_at")).first()[0]
    snapshots.write(spark, root, b, "conversation_id", at="updated_at")
    rows = snapshots.read(spark, root, "conversation_id long, user_id long, title string, status string, updated_at timestamp")
    return rows.select("conversation_id", "user_id", "title", "status", (F.col("updated_at") > F.lit(first)).alias("changed"))


@query("nightly_rollup", with_views("user_event job_metric", an.LIFETIME + an.ROLLING.replace("e AS (", "e1 AS (").replace("FROM e LEFT JOIN j ", "FROM e1 LEFT JOIN j1 ").replace("\nj AS (", "\nj1 AS (").replace("SELECT e.*, ", "SELECT e1.*, ").replace("coalesce(j.", "coalesce(j1.") + an.DAILY + """ SELECT 'user' AS kind, user_id::VARCHAR AS key, life.created, life.succeeded::DOUBLE AS succeeded, roll.cost_usd_30d AS cost_usd FROM life JOIN roll USING (user_id)
UNION ALL SELECT 'day', date, created, succeeded, cost_usd FROM daily UNION ALL SELECT 'all', 'all', sum(created)::BIGINT, NULL, NULL FROM life"""))  # fmt: skip
def nightly_rollup(spark, sf):
    """The whole job, run twice over the same log, and what its tables then hold."""
    root = fresh_path(spark, "nightly")
    for _ in range(2):
        nightly(fx.user_events(spark, sf), fx.job_metrics(spark, sf), fx.AS_OF, root)
    users = snapshots.read(spark, f"{root}/users", "user_id long, created long, succeeded long, cost_usd_30d double").select(F.lit("user").alias("kind"), F.col("user_id").cast("string").alias("key"), "created", F.col("succeeded").cast("double").alias("succeeded"), F.col("cost_usd_30d").alias("cost_usd"))
    days = spark.read.parquet(f"{root}/daily").select(F.lit("day"), F.date_format("date", "yyyy-MM-dd"), "created", F.col("succeeded").cast("double"), "cost_usd")
    whole = snapshots.read(spark, f"{root}/global", "id string, created long").select(F.lit("all"), "id", "created", F.lit(None).cast("double"), F.lit(None).cast("double"))
    return users.union(days).union(whole)
