"""The given tables seen as tables of recordings, activity and prices.

Every view is lazy and made of columns of the given tables alone; ``SQL`` states the same views for the
SQL twins of the queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

AS_OF = "2024-01-31 02:00:00"

#: Token prices are per million, the recogniser's per second; the third token price lies in the future.
PRICES = [
    ("pr1", "tokens-a", "tokens", 0.075, 0.30, None, "2023-12-01", None),
    ("pr2", "tokens-a", "tokens", 0.10, 0.40, None, "2024-01-10", None),
    ("pr3", "tokens-a", "tokens", 9.0, 9.0, None, "2030-01-01", None),
    ("pr4", "recogniser", "time", None, None, 0.0023, "2024-01-05", "2024-01-08"),
    ("pr5", "recogniser", "time", None, None, 0.0030, "2024-01-20", None),
]
TERMS = [("t_that", "that", ["this"]), ("t_with", "with", ["from"]), ("t_tion", "tion", []), ("t_plus", "C++", [""])]
PEOPLE = [("p_0", "The the", "North Hall"), ("p_1", "The and", None), ("p_2", "That andingntou", "Harbour"), ("p_3", "Zoe", "The north")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    kinds = F.when(kind == "signup", "conversation_created").when(kind == "view", "conversation_deleted").when(kind == "purchase", "processing_completed").when(kind == "error", "processing_failed").otherwise(kind)
    ms = (F.col("value") * 60000).cast("string")
    ms = F.when(k % 10 == 0, F.concat(F.lit('"'), ms, F.lit('"'))).otherwise(ms)
    metadata = F.when(kind == "purchase", F.concat(F.lit('{"durationMs": '), ms, F.lit(', "estimatedCostUsd": '), (F.col("value") / 1000).cast("string"), F.lit("}")))
    return e.select("event_id", kinds.alias("event_type"), "user_id", F.col("event_id").alias("conversation_id"), metadata.alias("metadata"), F.col("ts").alias("timestamp"))


def job_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "error"))
    ok = F.col("event_type") == "purchase"
    k = F.get_json_object("props", "$.k").cast("int")
    zero = lambda x, other=0.0: F.when(ok, x).otherwise(F.lit(other))
    return e.select(
        F.col("event_id").alias("conversation_id"), "user_id", F.when(ok, "success").otherwise("failed").alias("status"),
        zero(F.col("value") * 60000).alias("duration_ms"), zero(F.col("value") * 100).alias("total_ms"),
        F.when(ok, k * 1000).cast("long").alias("analysis_in"), F.when(ok, k * 100).cast("long").alias("analysis_out"),
        F.when(ok, k * 200).cast("long").alias("correction_in"), F.when(ok, k * 20).cast("long").alias("correction_out"),
        F.when(ok, F.col("value")).alias("compute_s"), F.when(ok & (k % 2 == 1), F.col("value") / 2).alias("diarisation_s"), F.col("ts").alias("timestamp"),
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    s = F.col("o_orderstatus")
    status = F.when(F.col("o_orderkey") % 100 == 0, "unknown").when(s == "F", "complete").when(s == "O", "processing").otherwise("needs_review")
    title = F.when(F.col("o_orderkey") % 150 != 0, F.concat(F.lit("rec_"), F.col("o_orderkey").cast("string"), F.lit(".mp3")))
    return o.select(F.col("o_orderkey").alias("conversation_id"), F.col("o_custkey").alias("user_id"), title.alias("title"), status.alias("status"), F.col("o_orderdate").alias("created_at"), (F.col("o_totalprice") * 10).cast("long").alias("duration_ms"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """150 ms a word, in order of turns."""
    c = table(spark, sf_dir, "conversations")
    n = F.size(F.split(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), " ")).cast("long")
    before = F.coalesce(F.sum("n_words").over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = c.select("conv_id", "turn", "role", "text", n.alias("n_words")).withColumn("before", before)
    return rows.select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("segment_index"), F.col("role").alias("speaker_id"), (150 * F.col("before")).alias("start_ms"), (150 * (F.col("before") + F.col("n_words"))).alias("end_ms"), "text")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word every 150 ms, numbered through the conversation; every 97th has a bad end."""
    s = segments(spark, sf_dir).select("conversation_id", "segment_index", (F.col("start_ms") / 150).cast("long").alias("at"), F.posexplode(F.split(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), " ")).alias("i", "word"))
    index = F.col("at") + F.col("i")
    return s.select("conversation_id", "segment_index", index.alias("word_index"), "word", (index * 0.15).alias("start_s"), F.when(index % 97 == 96, 0.0).otherwise(index * 0.15 + 0.14).alias("end_s"))


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reassignments to ``system``, some of them invalid."""
    s = segments(spark, sf_dir)
    good = s.filter("segment_index % 3 = 1").select("conversation_id", F.col("segment_index").alias("ordinal"), "segment_index", F.lit("user").alias("new_speaker"))
    late = s.filter("segment_index % 6 = 1").select("conversation_id", (F.col("segment_index") + 1000).alias("ordinal"), "segment_index", F.lit("assistant").alias("new_speaker"))
    bad = s.filter("segment_index = 0").select("conversation_id", F.lit(5000).cast("long").alias("ordinal"), F.lit(999).cast("long").alias("segment_index"), F.lit("user").alias("new_speaker"))
    unknown = s.filter("segment_index = 2").select("conversation_id", F.lit(6000).cast("long").alias("ordinal"), "segment_index", F.lit("nobody").alias("new_speaker"))
    return good.union(late).union(bad).union(unknown)


def prices(spark: SparkSession, sf_dir: str = "") -> DataFrame:
    rows = spark.createDataFrame(PRICES, "pricing_id string, model string, service string, input_price double, output_price double, second_price double, effective_from string, effective_until string")
    return rows.withColumn("effective_from", F.col("effective_from").cast("timestamp")).withColumn("effective_until", F.col("effective_until").cast("timestamp"))


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary, which all conversations share, with its order."""
    return spark.createDataFrame([(i, *t) for i, t in enumerate(TERMS)], "ordinal int, term_id string, display string, aliases array<string>")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i, *p) for i, p in enumerate(PEOPLE)], "ordinal int, person_id string, name string, affiliation string")


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation_id")).distinct()
    rows = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(f"top_{i}").alias("topic_id"), F.lit(a).cast("long").alias("start_index"), F.lit(b).cast("long").alias("end_index"), F.lit(t).alias("type")) for i, (a, b, t) in enumerate([(0, 1, "main"), (2, 4, "main"), (2, 3, "tangent")])])
    return ids.select("conversation_id", F.inline(rows))


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = conversations(spark, sf_dir).select("conversation_id", "user_id", "title", "status")
    a = c.filter("conversation_id % 10 <> 0")
    b = c.filter("conversation_id % 10 <> 1").withColumn("status", F.when(F.col("conversation_id") % 10 == 2, "changed").otherwise(F.col("status")))
    return a, b


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    names = F.array(*[F.lit(s) for s in ("pending", "uploading", "transcribing", "analyzing", "aligning", "finalizing", "complete", "failed")])
    rank = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("conversation_id"), F.element_at(names, (rank % 8 + 1).cast("int")).alias("step"), F.col("ts").alias("started_at"), rank.alias("position"))


def _literal(v: object) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else "[" + ", ".join(f"'{x}'" for x in v) + "]::VARCHAR[]" if isinstance(v, list) else repr(v)


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)


#: The views in SQL, each resting on earlier ones at most.
SQL: dict[str, str] = {
    "user_event": """SELECT event_id, CASE event_type WHEN 'signup' THEN 'conversation_created' WHEN 'view' THEN 'conversation_deleted'
        WHEN 'purchase' THEN 'processing_completed' WHEN 'error' THEN 'processing_failed' ELSE event_type END AS event_type, user_id, event_id AS conversation_id,
        CASE WHEN event_type = 'purchase' THEN '{"durationMs": ' || CASE WHEN json_extract(props, '$.k')::INT % 10 = 0 THEN '"' || (value * 60000)::VARCHAR || '"' ELSE (value * 60000)::VARCHAR END
          || ', "estimatedCostUsd": ' || (value / 1000)::VARCHAR || '}' END AS metadata, ts AS "timestamp" FROM events""",
    "job_metric": """SELECT event_id AS conversation_id, user_id, CASE WHEN event_type = 'purchase' THEN 'success' ELSE 'failed' END AS status,
        CASE WHEN event_type = 'purchase' THEN value * 60000 ELSE 0 END AS duration_ms, CASE WHEN event_type = 'purchase' THEN value * 100 ELSE 0 END AS total_ms,
        CASE WHEN event_type = 'purchase' THEN k * 1000 END AS analysis_in, CASE WHEN event_type = 'purchase' THEN k * 100 END AS analysis_out,
        CASE WHEN event_type = 'purchase' THEN k * 200 END AS correction_in, CASE WHEN event_type = 'purchase' THEN k * 20 END AS correction_out,
        CASE WHEN event_type = 'purchase' THEN value END AS compute_s, CASE WHEN event_type = 'purchase' AND k % 2 = 1 THEN value / 2 END AS diarisation_s, ts AS "timestamp"
        FROM (SELECT *, json_extract(props, '$.k')::INT AS k FROM events WHERE event_type IN ('purchase', 'error'))""",
    "conversation": """SELECT o_orderkey AS conversation_id, o_custkey AS user_id, CASE WHEN o_orderkey % 150 <> 0 THEN 'rec_' || o_orderkey || '.mp3' END AS title,
        CASE WHEN o_orderkey % 100 = 0 THEN 'unknown' WHEN o_orderstatus = 'F' THEN 'complete' WHEN o_orderstatus = 'O' THEN 'processing' ELSE 'needs_review' END AS status,
        o_orderdate AS created_at, trunc(o_totalprice * 10)::BIGINT AS duration_ms FROM orders""",
    "segment0": r"""SELECT conv_id AS conversation_id, turn AS segment_index, role AS speaker_id, text, string_split(trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), ' ') AS w FROM conversations""",
    "segment": """SELECT conversation_id, segment_index, speaker_id, (150 * b)::BIGINT AS start_ms, (150 * (b + len(w)))::BIGINT AS end_ms, text, w
        FROM (SELECT *, coalesce(sum(len(w)) OVER (PARTITION BY conversation_id ORDER BY segment_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM segment0)""",
    "word": """SELECT conversation_id, segment_index, x AS word_index, word, x * 0.15::DOUBLE AS start_s, CASE WHEN x % 97 = 96 THEN 0 ELSE x * 0.15::DOUBLE + 0.14::DOUBLE END AS end_s
        FROM (SELECT conversation_id, segment_index, start_ms // 150 + i - 1 AS x, word FROM (SELECT *, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM segment))""",
    "correction": """SELECT conversation_id, segment_index AS ordinal, segment_index, 'user' AS new_speaker FROM segment WHERE segment_index % 3 = 1
        UNION ALL SELECT conversation_id, segment_index + 1000, segment_index, 'assistant' FROM segment WHERE segment_index % 6 = 1
        UNION ALL SELECT conversation_id, 5000, 999, 'user' FROM segment WHERE segment_index = 0 UNION ALL SELECT conversation_id, 6000, segment_index, 'nobody' FROM segment WHERE segment_index = 2""",
    "pricing": f"""SELECT pricing_id, model, service, input_price::DOUBLE AS input_price, output_price::DOUBLE AS output_price, second_price::DOUBLE AS second_price, effective_from::TIMESTAMP AS effective_from, effective_until::TIMESTAMP AS effective_until
        FROM (VALUES {_values(PRICES)}) t(pricing_id, model, service, input_price, output_price, second_price, effective_from, effective_until)""",
    "term": f"SELECT * FROM (VALUES {_values([(i, *t) for i, t in enumerate(TERMS)])}) t(ordinal, term_id, display, aliases)",
    "person": f"SELECT * FROM (VALUES {_values([(i, *p) for i, p in enumerate(PEOPLE)])}) t(ordinal, person_id, name, affiliation)",
    "topic": """SELECT conversation_id, t.* FROM (SELECT DISTINCT conv_id AS conversation_id FROM conversations),
        (VALUES (0, 'top_0', 0, 1, 'main'), (1, 'top_1', 2, 4, 'main'), (2, 'top_2', 2, 3, 'tangent')) t(ordinal, topic_id, start_index, end_index, type)""",
    "snapshot_a": "SELECT conversation_id, user_id, title, status FROM conversation WHERE conversation_id % 10 <> 0",
    "snapshot_b": "SELECT conversation_id, user_id, title, CASE WHEN conversation_id % 10 = 2 THEN 'changed' ELSE status END AS status FROM conversation WHERE conversation_id % 10 <> 1",
    "progress_event": """SELECT user_id AS conversation_id, ['pending', 'uploading', 'transcribing', 'analyzing', 'aligning', 'finalizing', 'complete', 'failed'][p % 8 + 1] AS step, ts AS started_at, p AS position
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p FROM events)""",
    "progress_event_all": """SELECT user_id AS conversation_id, ['pending', 'uploading', 'transcribing', 'analyzing', 'aligning', 'finalizing', 'complete', 'failed'][p % 8 + 1] AS step, ts AS started_at, p AS position
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p FROM events)""",
}
_NEEDS = {"segment": ["segment0"], "word": ["segment0", "segment"], "correction": ["segment0", "segment"], "snapshot_a": ["conversation"], "snapshot_b": ["conversation"]}


def with_views(views: str, body: str) -> str:
    """``body`` after the named views (and what they rest on) as common table expressions; a body that starts with a comma adds its own."""
    wanted = {v for name in views.split() for v in [*_NEEDS.get(name, []), name]}
    head = ",\n".join(f"{v} AS ({q})" for v, q in SQL.items() if v in wanted)
    body = body.strip()
    if body.startswith(","):
        return f"WITH RECURSIVE {head}{body}"
    return f"WITH {head} {body}"
