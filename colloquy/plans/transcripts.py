"""Queries of transcripts, mentions, collections and alignment over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import alignment as al
from ..operators import collections as co
from ..operators import mentions as me
from ..operators import segments as se
from . import fixtures as fx
from .fixtures import with_views
from .registry import query

_R = lambda x, k: f"(floor(({x}) * 1e{k} + 0.5) / 1e{k})"
_SEG = "conversation_id, segment_index"
_ESC = r"regexp_replace(a, '([.*+?^${}()|\[\]\\])', '\\\1', 'g')"
_MATCH = """m AS (SELECT *, regexp_extract_all(text, pat) AS ms, string_split_regex(text, pat) AS ps FROM p),
o AS (SELECT * EXCLUDE (ms, ps, pat, text), list_sum(list_transform(ps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: len(x))), 0) AS start_char, len(ms[i]) AS n
FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m))"""
OCCURRENCES = rf""", p AS (SELECT {_SEG}, text, ordinal, term_id, '(?i)\b(?:' || list_aggregate(list_transform(list_filter([display] || aliases, lambda a: a <> ''), lambda a: {_ESC}), 'string_agg', '|') || ')\b' AS pat FROM segment, term),
{_MATCH}, occ AS (SELECT conversation_id, 'occ_' || (row_number() OVER (PARTITION BY conversation_id ORDER BY segment_index, ordinal, start_char) - 1) AS occurrence_id, segment_index, term_id, start_char::BIGINT AS start_char, (start_char + n)::BIGINT AS end_char FROM o)"""
MENTIONS = rf""", q AS (SELECT {_SEG}, text, person_id, '(?i)\b(?:' || name || ')\b' AS full_pat, CASE WHEN name LIKE '% %' AND len(string_split(name, ' ')[1]) > 2 THEN '(?i)\b(?:' || string_split(name, ' ')[1] || ')\b' END AS first_pat FROM segment, person),
p AS (SELECT {_SEG}, text, person_id, CASE WHEN NOT regexp_matches(text, full_pat) AND first_pat IS NOT NULL THEN first_pat ELSE full_pat END AS pat FROM q),
{_MATCH}, men AS (SELECT {_SEG}, person_id, start_char::BIGINT AS start_char, (start_char + n)::BIGINT AS end_char FROM o)"""
BOTH = OCCURRENCES + MENTIONS.replace("p AS", "p2 AS").replace("FROM p)", "FROM p2)").replace("m AS (", "m2 AS (", 1).replace("FROM m)", "FROM m2)").replace("o AS (SELECT * EX", "o2 AS (SELECT * EX").replace("FROM o)", "FROM o2)")
REPAIR = rf""", f AS (SELECT *, lag(speaker_id) OVER w AS prev, regexp_extract(trim(text), '(?s)^(.+?[.!?])\s+([A-Z].*)', 1) AS frag, regexp_extract(trim(text), '(?s)^(.+?[.!?])\s+([A-Z].*)', 2) AS rest FROM segment WINDOW w AS (PARTITION BY conversation_id ORDER BY segment_index)),
g AS (SELECT *, coalesce(prev <> speaker_id, false) AND frag <> '' AND len(frag) <= 80 AND len(rest) >= 20 AND NOT (len(frag) > 40 AND regexp_matches(frag, '(?i)^({"|".join(se.STARTERS)})\s')) AS moves FROM f),
h AS (SELECT *, CASE WHEN moves THEN start_ms + floor((end_ms - start_ms) * len(frag)::DOUBLE / len(text))::BIGINT END AS cut FROM g),
i AS (SELECT *, lead(CASE WHEN moves THEN frag END) OVER w AS nf, lead(cut) OVER w AS ne FROM h WINDOW w AS (PARTITION BY conversation_id ORDER BY segment_index)),
repaired AS (SELECT {_SEG}, speaker_id, coalesce(cut, start_ms) AS start_ms, coalesce(ne, end_ms) AS end_ms, CASE WHEN nf IS NOT NULL THEN rtrim(CASE WHEN moves THEN rest ELSE text END) || ' ' || nf WHEN moves THEN rest ELSE text END AS text FROM i)"""
NUMBERED = "spk AS (SELECT conversation_id, speaker_id, 'Speaker ' || row_number() OVER (PARTITION BY conversation_id ORDER BY speaker_id) AS display_name, (row_number() OVER (PARTITION BY conversation_id ORDER BY speaker_id) - 1) % 5 AS color_index FROM (SELECT DISTINCT conversation_id, speaker_id FROM segment))"


def _seg(spark, sf):
    return fx.segments(spark, sf)


def _occ(spark, sf):
    return me.term_occurrences(_seg(spark, sf), fx.terms(spark, sf))


def _men(spark, sf):
    return me.person_mentions(_seg(spark, sf), fx.people(spark, sf))


# collections


@query("conversations_for_user", with_views("conversation", "SELECT conversation_id, title, status FROM conversation WHERE user_id = 370"))
def conversations_for_user(spark, sf):
    return co.conversations_for_user(fx.conversations(spark, sf), 370).select("conversation_id", "title", "status")


@query("row_access", with_views("conversation", "SELECT conversation_id, user_id, 'user' AS seen_by FROM conversation WHERE user_id = 899 UNION ALL SELECT conversation_id, user_id, 'admin' FROM conversation"))
def row_access(spark, sf):
    c = fx.conversations(spark, sf).select("conversation_id", "user_id")
    return co.row_access(c, 899, False).withColumn("seen_by", F.lit("user")).union(co.row_access(c, 899, True).withColumn("seen_by", F.lit("admin")))


@query("conversation_validity", with_views("conversation", """SELECT 'conversation_id' AS rule, count(*) FILTER (conversation_id IS NULL) AS failures FROM conversation UNION ALL SELECT 'user_id', count(*) FILTER (user_id IS NULL) FROM conversation UNION ALL SELECT 'title', count(*) FILTER (title IS NULL) FROM conversation
UNION ALL SELECT 'created_at', count(*) FILTER (created_at IS NULL) FROM conversation UNION ALL SELECT 'status', count(*) FILTER (status NOT IN ('processing', 'needs_review', 'complete', 'failed')) FROM conversation"""))  # fmt: skip
def conversation_validity(spark, sf):
    return co.conversation_validity(fx.conversations(spark, sf))


@query("doc_normalise", with_views("conversation", "SELECT conversation_id, strftime(created_at, '%Y-%m-%dT%H:%M:%S.000Z') AS created_at, CASE WHEN conversation_id % 3 = 0 THEN 1 ELSE 0 END AS n_topics FROM conversation"))
def doc_normalise(spark, sf):
    c = fx.conversations(spark, sf).select("conversation_id", "created_at", F.when(F.col("conversation_id") % 3 == 0, F.array("title")).alias("topics"))
    return co.doc_normalise(c, ["topics"]).select("conversation_id", "created_at", F.size("topics").alias("n_topics"))


@query("keyed_upsert", with_views("conversation snapshot_a snapshot_b", "SELECT coalesce(a.conversation_id, b.conversation_id) AS conversation_id, coalesce(b.user_id, a.user_id) AS user_id, coalesce(b.title, a.title) AS title, coalesce(b.status, a.status) AS status FROM snapshot_a a FULL JOIN snapshot_b b ON a.conversation_id = b.conversation_id"))
def keyed_upsert(spark, sf):
    return co.keyed_upsert(*fx.snapshots(spark, sf), "conversation_id")


_DIFF = "coalesce(a.conversation_id, b.conversation_id) AS conversation_id, CASE WHEN a.conversation_id IS NULL THEN 'added' WHEN b.conversation_id IS NULL THEN 'removed' WHEN a.user_id IS DISTINCT FROM b.user_id OR a.title IS DISTINCT FROM b.title OR a.status IS DISTINCT FROM b.status THEN 'modified' END AS change"


@query("snapshot_diff", with_views("conversation snapshot_a snapshot_b", f"SELECT * FROM (SELECT {_DIFF} FROM snapshot_a a FULL JOIN snapshot_b b ON a.conversation_id = b.conversation_id) WHERE change IS NOT NULL"))
def snapshot_diff(spark, sf):
    return co.snapshot_diff(*fx.snapshots(spark, sf), "conversation_id").select("conversation_id", "change")


@query("lifecycle_events", with_views("conversation snapshot_a snapshot_b", """SELECT conversation_id, CASE WHEN c = 'b' THEN 'conversation_created' ELSE 'conversation_deleted' END AS event_type, user_id,
CASE WHEN c = 'b' THEN '{' || coalesce('"title":"' || title || '",', '') || '"status":"' || status || '"}' ELSE '{' || coalesce('"title":"' || title || '",', '') || '"hadAudioUrl":' || CASE WHEN title IS NULL THEN 'false}' ELSE 'true}' END END AS metadata
FROM (SELECT *, 'b' AS c FROM snapshot_b WHERE conversation_id NOT IN (SELECT conversation_id FROM snapshot_a) UNION ALL SELECT *, 'a' FROM snapshot_a WHERE conversation_id NOT IN (SELECT conversation_id FROM snapshot_b))"""))  # fmt: skip
def lifecycle_events(spark, sf):
    return co.lifecycle_events(co.snapshot_diff(*fx.snapshots(spark, sf), "conversation_id"))


# segments


@query("asr_segments_build", with_views("segment", f"SELECT {_SEG}, CASE WHEN segment_index % 5 = 4 THEN 'SPEAKER_00' ELSE speaker_id END AS speaker_id, floor(start_ms / 1000.0::DOUBLE * 1000)::BIGINT AS start_ms, floor(end_ms / 1000.0::DOUBLE * 1000)::BIGINT AS end_ms FROM segment"))
def asr_segments_build(spark, sf):
    s = _seg(spark, sf)
    raw = s.select("conversation_id", "segment_index", F.when(F.col("segment_index") % 5 != 4, F.col("speaker_id")).alias("speaker_id"), (F.col("start_ms") / 1000.0).alias("start_s"), (F.col("end_ms") / 1000.0).alias("end_s"), "text")
    return se.asr_segments(raw).drop("text")


@query("word_ingest", with_views("word", "SELECT conversation_id, word_index, word, start_s, end_s FROM word"))
def word_ingest(spark, sf):
    from ..sources.ingest import words_of

    w = fx.words(spark, sf)
    inner = w.groupBy("conversation_id", "segment_index").agg(F.array_sort(F.collect_list(F.struct("word_index", "word", F.col("start_s").alias("start"), F.col("end_s").alias("end")))).alias("words"))
    nested = inner.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("segment_index", "words"))).alias("segments"))
    return words_of(nested)


@query("boundary_repair", with_views("segment", REPAIR + " SELECT * FROM repaired"))
def boundary_repair(spark, sf):
    return se.boundary_repair(_seg(spark, sf))


@query("speaker_numbering", with_views("segment", f", {NUMBERED} SELECT * FROM spk"))
def speaker_numbering(spark, sf):
    return se.speaker_numbering(_seg(spark, sf))


@query("segment_speaker", with_views("segment", f", {NUMBERED} SELECT {_SEG}, speaker_id, coalesce(display_name, speaker_id) AS display_name, coalesce(color_index, 0) AS color_index FROM segment LEFT JOIN (SELECT * FROM spk WHERE speaker_id <> 'system') USING (conversation_id, speaker_id)"))
def segment_speaker(spark, sf):
    s = _seg(spark, sf)
    return se.segment_speaker(s, se.speaker_numbering(s).filter("speaker_id <> 'system'"))


@query("speaker_naming", with_views("segment person", f""", {NUMBERED}, n AS (SELECT * FROM (VALUES ('assistant', 'The the', 'host', NULL), ('user', NULL, 'guest', NULL), ('system', NULL, NULL, 'notes')) t(speaker_id, inferred_name, role, notes))
SELECT conversation_id, speaker_id, CASE WHEN inferred_name IS NOT NULL AND lower(trim(inferred_name)) NOT IN (SELECT lower(trim(name)) FROM person) THEN inferred_name ELSE display_name END || CASE WHEN role IS NOT NULL THEN ' (' || role || ')' WHEN inferred_name IS NULL AND notes IS NOT NULL THEN ' (' || notes || ')' ELSE '' END AS display_name FROM spk LEFT JOIN n USING (speaker_id)"""))  # fmt: skip
def speaker_naming(spark, sf):
    notes = spark.createDataFrame([("assistant", "The the", "host", None, 0), ("user", None, "guest", None, 1), ("system", None, None, "notes", 2), ("user", "Zed", None, None, 3)], "speaker_id string, inferred_name string, role string, notes string, ordinal int")
    return se.speaker_naming(se.speaker_numbering(_seg(spark, sf)), notes, fx.people(spark, sf))


_REASSIGN = f"""k AS (SELECT DISTINCT conversation_id, speaker_id FROM segment), l AS (SELECT conversation_id, segment_index, arg_max(new_speaker, ordinal) AS ns FROM correction c WHERE EXISTS (SELECT 1 FROM k WHERE k.conversation_id = c.conversation_id AND k.speaker_id = c.new_speaker) GROUP BY 1, 2),
rea AS (SELECT {_SEG}, coalesce(ns, speaker_id) AS speaker_id, coalesce(ns <> speaker_id, false) AS corrected FROM segment LEFT JOIN l USING ({_SEG}))"""


@query("apply_reassign", with_views("segment correction", f", {_REASSIGN} SELECT * FROM rea"))
def apply_reassign(spark, sf):
    return se.apply_reassign(_seg(spark, sf), fx.corrections(spark, sf))


def _split(i: int, of: str) -> str:
    """One split of the first piece in SQL; the piece after it goes into columns of its own."""
    return f"""h{i} AS (SELECT *, coalesce(b{i}, k) AS bb{i}, coalesce(f{i}, CASE WHEN ns = 2 THEN CASE WHEN coalesce(b{i}, k) = lo THEN hi ELSE lo END END) AS ff{i} FROM {of}),
j{i} AS (SELECT *, coalesce(at{i} > 0 AND at{i} < len(x) AND ff{i} IS NOT NULL, false) AS ok{i}, trim(left(x, at{i})) AS l{i} FROM h{i}), m{i} AS (SELECT *, a + floor((b - a) * (len(l{i})::DOUBLE / len(x)))::BIGINT AS cut{i} FROM j{i}),
o{i} AS (SELECT * REPLACE (CASE WHEN ok{i} THEN l{i} ELSE x END AS x, CASE WHEN ok{i} THEN cut{i} ELSE b END AS b, CASE WHEN ok{i} THEN bb{i} ELSE k END AS k), trim(substring(x, at{i} + 1)) AS x{i}, cut{i} AS a{i}, b AS e{i} FROM m{i})"""


@query("apply_splits", with_views("segment", f""", pp AS (SELECT conversation_id, count(DISTINCT speaker_id) AS ns, min(speaker_id) AS lo, max(speaker_id) AS hi FROM segment GROUP BY 1),
s0 AS (SELECT conversation_id, segment_index AS old, text AS x, start_ms AS a, end_ms AS b, speaker_id AS k, ns, lo, hi, [0, 0, 20, 30][segment_index % 4 + 1] AS at1, CASE WHEN segment_index % 4 = 3 THEN 'user' END AS b1, CASE WHEN segment_index % 4 = 3 THEN 'assistant' END AS f1, CASE WHEN segment_index % 4 >= 2 THEN [8, 100000][segment_index % 4 - 1] END AS at2, NULL::VARCHAR AS b2, 'system' AS f2 FROM segment JOIN pp USING (conversation_id)),
{_split(1, "s0")}, {_split(2, "o1")}, v AS (SELECT conversation_id, old, 0 AS part, k AS speaker_id, a AS start_ms, b AS end_ms, x AS text FROM o2 UNION ALL SELECT conversation_id, old, 1, ff2, a2, e2, x2 FROM o2 WHERE ok2 UNION ALL SELECT conversation_id, old, 2, ff1, a1, e1, x1 FROM o2 WHERE ok1)
SELECT conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY old, part) - 1 AS segment_index, speaker_id, start_ms, end_ms, text FROM v"""))  # fmt: skip
def apply_splits(spark, sf):
    """Splits with and without speakers, twice in a segment, and out of bounds."""
    s = _seg(spark, sf)
    i, none = F.col("segment_index") % 4, F.lit(None).cast("string")
    row = lambda n, at, before, after: F.struct(F.lit(n).alias("ordinal"), at.alias("split_at_char"), before.alias("speaker_before"), after.alias("speaker_after"))
    named = lambda name: F.when(i == 3, F.lit(name))
    first = row(0, F.when(i == 2, 20).when(i == 3, 30).otherwise(0), named("user"), named("assistant"))
    second = row(1, F.when(i == 2, 8).when(i == 3, 100000), none, F.lit("system"))
    return se.apply_splits(s, s.select("conversation_id", "segment_index", F.inline(F.array(first, second))))


@query("topic_markers", with_views("segment topic", f"SELECT {_SEG}, t.topic_id FROM segment LEFT JOIN (SELECT conversation_id, start_index AS segment_index, arg_min(topic_id, ordinal) AS topic_id FROM topic GROUP BY 1, 2) t USING ({_SEG})"))
def topic_markers(spark, sf):
    return se.topic_markers(_seg(spark, sf), fx.topics(spark, sf))


_PROBE = """pseg AS (SELECT conversation_id, segment_index, start_ms, CASE WHEN segment_index % 5 = 0 THEN end_ms + 400 WHEN segment_index % 6 = 0 THEN greatest(end_ms - 300, start_ms + 1) ELSE end_ms END AS end_ms FROM segment),
probe AS (SELECT conversation_id, segment_index * 100 + k * 10 + j AS probe_id, CASE k WHEN 0 THEN start_ms - 1 WHEN 1 THEN start_ms WHEN 2 THEN end_ms WHEN 3 THEN end_ms + 10 ELSE 0 END + [-500, 0, 500][j + 1] AS t FROM pseg, range(0, 5) a(k), range(0, 3) b(j))"""


@query("active_segment", with_views("segment", f""", {_PROBE}, s AS (SELECT *, lead(start_ms) OVER (PARTITION BY conversation_id ORDER BY segment_index) AS nxt FROM pseg),
x AS (SELECT p.conversation_id, p.probe_id, s.segment_index AS i, p.t >= s.start_ms AND p.t < s.end_ms AS inside, p.t > 0 AND s.end_ms <= p.t AND (nxt IS NULL OR p.t < nxt) AS gap, abs(s.start_ms - p.t) AS d FROM probe p JOIN s ON s.conversation_id = p.conversation_id)
SELECT conversation_id, probe_id, coalesce(arg_min(i, ROW(d, i)) FILTER (inside), max(i) FILTER (gap), -1) AS segment_index FROM x GROUP BY 1, 2"""))  # fmt: skip
def active_segment(spark, sf):
    end = F.when(F.col("segment_index") % 5 == 0, F.col("end_ms") + 400).when(F.col("segment_index") % 6 == 0, F.greatest(F.col("end_ms") - 300, F.col("start_ms") + 1)).otherwise(F.col("end_ms"))
    s = _seg(spark, sf).select("conversation_id", "segment_index", "start_ms", end.alias("end_ms"))
    at = F.array(F.col("start_ms") - 1, F.col("start_ms"), F.col("end_ms"), F.col("end_ms") + 10, F.lit(0).cast("long"))
    p = s.select("conversation_id", "segment_index", F.posexplode(at).alias("k", "position_ms"))
    p = p.select("*", F.posexplode(F.array(F.lit(-500), F.lit(0), F.lit(500))).alias("j", "offset_ms")).select("conversation_id", (F.col("segment_index") * 100 + F.col("k") * 10 + F.col("j")).alias("probe_id"), "position_ms", "offset_ms")
    return se.active_segment(p, s)


@query("speaker_distribution", with_views("segment", f"SELECT conversation_id, speaker_id, count(*) AS segments, {_R('100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY conversation_id)', 0)} AS percent FROM segment GROUP BY 1, 2"))
def speaker_distribution(spark, sf):
    return se.speaker_distribution(_seg(spark, sf))


@query("conversation_summary", with_views("segment correction topic term person", BOTH + f""", {_REASSIGN} SELECT s.*, 3 AS topics, c.corrections, coalesce(terms, 0) AS terms, coalesce(occurrences, 0) AS occurrences, coalesce(people, 0) AS people
FROM (SELECT conversation_id, count(*) AS segments, count(DISTINCT speaker_id) AS speakers, arg_max(end_ms, segment_index) AS duration_ms FROM segment GROUP BY 1) s JOIN (SELECT conversation_id, count(*) FILTER (corrected) AS corrections FROM rea GROUP BY 1) c USING (conversation_id)
LEFT JOIN (SELECT conversation_id, count(DISTINCT term_id) AS terms, count(*) AS occurrences FROM occ GROUP BY 1) USING (conversation_id) LEFT JOIN (SELECT conversation_id, count(DISTINCT person_id) AS people FROM men GROUP BY 1) USING (conversation_id)"""))  # fmt: skip
def conversation_summary(spark, sf):
    s = _seg(spark, sf)
    return se.conversation_summary(s, fx.topics(spark, sf), se.apply_reassign(s, fx.corrections(spark, sf)), _occ(spark, sf), _men(spark, sf))


@query("transcript_text", with_views("segment", f", {NUMBERED} SELECT conversation_id, string_agg('[' || segment_index || '] ' || display_name || ': ' || text, chr(10) || chr(10) ORDER BY segment_index) AS transcript, any_value(l.speakers) AS speakers FROM segment JOIN spk USING (conversation_id, speaker_id) JOIN (SELECT conversation_id, string_agg(speaker_id || ' (' || display_name || ')', ', ' ORDER BY speaker_id) AS speakers FROM spk GROUP BY 1) l USING (conversation_id) GROUP BY 1"))
def transcript_text(spark, sf):
    s = _seg(spark, sf)
    return se.transcript_text(s, se.speaker_numbering(s))


@query("transcript_input_stats", with_views("segment", r"SELECT conversation_id, sum(len(text))::BIGINT AS chars, sum(len(string_split_regex(text, '\s+')))::BIGINT AS words, arg_max(end_ms, segment_index) AS duration_ms FROM segment GROUP BY 1"))
def transcript_input_stats(spark, sf):
    return se.input_stats(_seg(spark, sf), tx.word_count(F.col("text")))


_AUDIO = "au AS (SELECT conversation_id, arg_max(end_ms, segment_index) * (90 + conversation_id % 20) // 100 AS audio_ms, CASE WHEN conversation_id % 7 = 0 THEN 'aligned' ELSE 'pending' END AS alignment_status FROM segment GROUP BY 1)"
_DRIFT = f"""{_AUDIO}, l AS (SELECT conversation_id, arg_max(end_ms, segment_index) AS last_end, count(*) AS n, sum(end_ms - start_ms) AS total FROM segment GROUP BY 1),
dr AS (SELECT conversation_id, abs(audio_ms - last_end) AS drift_ms, audio_ms / last_end::DOUBLE AS ratio, {_R("coalesce(100.0::DOUBLE * abs(audio_ms - last_end) / nullif(audio_ms, 0), 0)", 1)} AS percent, CASE WHEN audio_ms > last_end THEN 'short' WHEN audio_ms < last_end THEN 'long' ELSE 'none' END AS direction,
abs(audio_ms - last_end) > 1000 AND alignment_status NOT IN ('aligned', 'fallback') AS corrects, {_R("total / n::DOUBLE", 0)} AS mean_ms FROM l JOIN au USING (conversation_id))"""


def _drift(spark, sf):
    s = _seg(spark, sf)
    c = s.groupBy("conversation_id").agg(F.max_by("end_ms", "segment_index").alias("e")).select("conversation_id", F.expr("e * (90 + conversation_id % 20) div 100").alias("duration_ms"), F.when(F.col("conversation_id") % 7 == 0, "aligned").otherwise("pending").alias("alignment_status"))
    return se.drift_metrics(s, c)


@query("drift_metrics", with_views("segment", f", {_DRIFT} SELECT * FROM dr"))
def drift_metrics(spark, sf):
    return _drift(spark, sf)


@query("drift_correction", with_views("segment", f", {_DRIFT} SELECT {_SEG}, CASE WHEN corrects THEN floor(start_ms * ratio + 0.5)::BIGINT ELSE start_ms END AS start_ms, CASE WHEN corrects THEN floor(end_ms * ratio + 0.5)::BIGINT ELSE end_ms END AS end_ms FROM segment JOIN dr USING (conversation_id)"))
def drift_correction(spark, sf):
    return se.drift_correction(_seg(spark, sf), _drift(spark, sf))


@query("step_timeline", with_views("progress_event", """SELECT conversation_id, position, step, lead(started_at) OVER w AS completed_at, (epoch_us(lead(started_at) OVER w) - epoch_us(started_at)) // 1000 AS duration_ms,
CASE step WHEN 'uploading' THEN 15 WHEN 'transcribing' THEN 40 WHEN 'analyzing' THEN 60 WHEN 'aligning' THEN 85 WHEN 'finalizing' THEN 95 WHEN 'complete' THEN 100 ELSE 0 END AS percent FROM progress_event WINDOW w AS (PARTITION BY conversation_id ORDER BY position)"""))  # fmt: skip
def step_timeline(spark, sf):
    return se.step_timeline(fx.steps(spark, sf))


@query("step_timeline_all", with_views("progress_event_all", """SELECT conversation_id, position, step, lead(started_at) OVER w AS completed_at, (epoch_us(lead(started_at) OVER w) - epoch_us(started_at)) // 1000 AS duration_ms,
CASE step WHEN 'uploading' THEN 15 WHEN 'transcribing' THEN 40 WHEN 'analyzing' THEN 60 WHEN 'aligning' THEN 85 WHEN 'finalizing' THEN 95 WHEN 'complete' THEN 100 ELSE 0 END AS percent FROM progress_event_all WINDOW w AS (PARTITION BY conversation_id ORDER BY position)"""))  # fmt: skip
def step_timeline_all(spark, sf):
    return se.step_timeline(fx.steps(spark, sf))


_FLAT = with_views("segment", f"SELECT {_SEG}, speaker_id, start_ms, end_ms, text FROM segment")


@query("doc_flatten", _FLAT)
def doc_flatten(spark, sf):
    return se.flatten(se.assemble(_seg(spark, sf)))


@query("doc_assemble", with_views("segment", "SELECT conversation_id, count(*) AS n, string_agg(speaker_id, ',' ORDER BY segment_index) AS speakers FROM segment GROUP BY 1"))
def doc_assemble(spark, sf):
    d = se.assemble(_seg(spark, sf))
    return d.select("conversation_id", F.size("segments").alias("n"), F.array_join("segments.speaker_id", ",").alias("speakers"))


# mentions


@query("term_occurrences", with_views("segment term", OCCURRENCES + " SELECT * FROM occ"))
def term_occurrences(spark, sf):
    return _occ(spark, sf)


@query("occurrence_numbering", with_views("segment term", OCCURRENCES + " SELECT conversation_id, count(*) AS n, max(regexp_extract(occurrence_id, '[0-9]+')::BIGINT) AS last FROM occ GROUP BY 1"))
def occurrence_numbering(spark, sf):
    return _occ(spark, sf).groupBy("conversation_id").agg(F.count("*").alias("n"), F.max(F.regexp_extract("occurrence_id", "[0-9]+", 0).cast("long")).alias("last"))


@query("person_mentions", with_views("segment person", MENTIONS + " SELECT * FROM men"))
def person_mentions(spark, sf):
    return _men(spark, sf)


@query("person_segments", with_views("segment person", MENTIONS + " SELECT conversation_id, person_id, string_agg(DISTINCT segment_index::VARCHAR, ',' ORDER BY lpad(segment_index::VARCHAR, 9, '0')) AS segments, count(*) AS mentions FROM men GROUP BY 1, 2"))
def person_segments(spark, sf):
    p = me.person_segments(_men(spark, sf))
    return p.withColumn("segments", F.array_join(F.col("segments").cast("array<string>"), ","))


@query("mention_navigation", with_views("segment term", OCCURRENCES + """ SELECT conversation_id, term_id, occurrence_id, first_value(occurrence_id) OVER a AS first_id, coalesce(lead(occurrence_id) OVER w, first_value(occurrence_id) OVER a) AS next_id, coalesce(lag(occurrence_id) OVER w, last_value(occurrence_id) OVER a) AS previous_id FROM occ
WINDOW w AS (PARTITION BY conversation_id, term_id ORDER BY segment_index, start_char), a AS (PARTITION BY conversation_id, term_id ORDER BY segment_index, start_char ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""))  # fmt: skip
def mention_navigation(spark, sf):
    return me.mention_navigation(_occ(spark, sf))


@query("segment_occurrences", with_views("segment term person", BOTH + f""" SELECT {_SEG}, coalesce(a.t, '') AS terms, coalesce(b.t, '') AS people FROM segment LEFT JOIN (SELECT {_SEG}, string_agg(term_id, ',' ORDER BY start_char, term_id) AS t FROM occ GROUP BY ALL) a USING ({_SEG}) LEFT JOIN (SELECT {_SEG}, string_agg(person_id, ',' ORDER BY start_char, person_id) AS t FROM men GROUP BY ALL) b USING ({_SEG})"""))
def segment_occurrences(spark, sf):
    return me.segment_occurrences(_seg(spark, sf), _occ(spark, sf), _men(spark, sf))


_SPANS = f""", sp AS (SELECT *, row_number() OVER (PARTITION BY {_SEG} ORDER BY start_char, k, id, end_char) AS n FROM (SELECT {_SEG}, 'term' AS kind, term_id AS id, start_char, end_char, 0 AS k FROM occ UNION ALL SELECT {_SEG}, 'person', person_id, start_char, end_char, 1 FROM men)),
keep AS (SELECT {_SEG}, n, kind, id, start_char, end_char, true AS kept, end_char AS upto, 0::BIGINT AS before FROM sp WHERE n = 1
UNION ALL SELECT s.conversation_id, s.segment_index, s.n, s.kind, s.id, s.start_char, s.end_char, s.start_char >= k.upto, CASE WHEN s.start_char >= k.upto THEN s.end_char ELSE k.upto END, k.upto FROM keep k JOIN sp s ON s.conversation_id = k.conversation_id AND s.segment_index = k.segment_index AND s.n = k.n + 1),
parts AS (SELECT {_SEG}, kind, id, start_char AS start, end_char AS "end" FROM keep WHERE kept UNION ALL SELECT {_SEG}, 'plain', NULL, before, start_char FROM keep WHERE kept AND start_char > before
UNION ALL SELECT {_SEG}, 'plain', NULL, coalesce(u, 0), len(text) FROM segment LEFT JOIN (SELECT {_SEG}, max(upto) AS u FROM keep GROUP BY ALL) USING ({_SEG}) WHERE len(text) > coalesce(u, 0))"""


@query("highlight_spans", with_views("segment term person", BOTH + _SPANS + " SELECT * FROM parts"))
def highlight_spans(spark, sf):
    return me.highlight_spans(_seg(spark, sf), _occ(spark, sf), _men(spark, sf))


@query("active_term_spans", with_views("segment term person", BOTH + _SPANS + " SELECT *, id = 't_that' AS active FROM parts WHERE kind <> 'plain'"))
def active_term_spans(spark, sf):
    return me.active_term_spans(highlight_spans(spark, sf), "t_that")


@query("viewer_dataset", with_views("segment term person topic", BOTH + _SPANS + f", {NUMBERED} SELECT s.conversation_id, s.segment_index, coalesce(k.display_name, s.speaker_id) AS display_name, coalesce(k.color_index, 0) AS color_index, t.topic_id, t.topic_type, coalesce(p.n, 0) AS n_parts, coalesce(p.parts, '') AS parts FROM segment s LEFT JOIN spk k USING (conversation_id, speaker_id) LEFT JOIN (SELECT conversation_id, start_index AS segment_index, arg_min(topic_id, ordinal) AS topic_id, arg_min(type, ordinal) AS topic_type FROM topic GROUP BY 1, 2) t USING ({_SEG}) LEFT JOIN (SELECT {_SEG}, count(*) AS n, string_agg(start || '-' || \"end\" || ':' || coalesce(id, kind), ' ' ORDER BY start) AS parts FROM parts GROUP BY ALL) p USING ({_SEG})"))
def viewer_dataset(spark, sf):
    """All that a reader's page shows of a segment."""
    s, key = _seg(spark, sf), ["conversation_id", "segment_index"]
    shown = F.concat(F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), F.lit(":"), F.coalesce("id", "kind"))
    parts = highlight_spans(spark, sf).groupBy(*key).agg(F.count("*").alias("n_parts"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", shown.alias("p")))), lambda x: x["p"]), " ").alias("parts"))
    named = se.segment_speaker(s, se.speaker_numbering(s)).select(*key, "display_name", "color_index")
    topics = fx.topics(spark, sf)
    marked = se.topic_markers(s, topics).join(topics.select("conversation_id", "topic_id", F.col("type").alias("topic_type")), ["conversation_id", "topic_id"], "left")
    return named.join(marked, key, "left").join(parts, key, "left").na.fill(0, ["n_parts"]).na.fill("", ["parts"])


_ASKED = "SELECT DISTINCT conversation_id, '{0}' AS asked, term_id AS id FROM occ JOIN term USING (term_id) WHERE contains(lower(display), '{0}') OR len(list_filter(aliases, lambda a: contains(lower(a), '{0}'))) > 0 UNION ALL SELECT DISTINCT conversation_id, '{0}', person_id FROM men JOIN person USING (person_id) WHERE contains(lower(name), '{0}') OR coalesce(contains(lower(affiliation), '{0}'), false)"


@query("context_search", with_views("segment term person", BOTH + " " + " UNION ALL ".join(_ASKED.format(q) for q in ("th", "north"))))
def context_search(spark, sf):
    """The terms and people of each conversation that the search texts find, people by name or affiliation."""
    own = lambda rows, entries, key: rows.select("conversation_id", key).distinct().join(entries, key)
    terms, people = own(_occ(spark, sf), fx.terms(spark, sf), "term_id"), own(_men(spark, sf), fx.people(spark, sf), "person_id")

    def found(q):
        t = me.context_search(terms, q, ["display"], ["aliases"]).select("conversation_id", F.lit(q).alias("asked"), F.col("term_id").alias("id"))
        return t.union(me.context_search(people, q, ["name", "affiliation"], []).select("conversation_id", F.lit(q), "person_id"))

    return found("th").union(found("north"))


# text functions

_NORM = lambda c: rf"trim(regexp_replace(regexp_replace(lower({c}), '[^A-Za-z0-9_\s]', '', 'g'), '\s+', ' ', 'g'))"
_GRAMS = lambda c: f"CASE WHEN len({c}) <= 3 THEN [{c}] ELSE list_distinct(list_transform(range(1, len({c}) - 1), lambda i: substring({c}, i, 3))) END"
_PAIR = f"nx AS (SELECT {_SEG}, {_NORM('text')} AS a, coalesce({_NORM('lead(text) OVER (PARTITION BY conversation_id ORDER BY segment_index)')}, '') AS b FROM segment)"
_PAIRS = f"{_PAIR}, gx AS (SELECT *, {_GRAMS('a')} AS ga, {_GRAMS('b')} AS gb, list_filter(string_split(a, ' '), lambda w: w <> '') AS ta, list_filter(string_split(b, ' '), lambda w: w <> '') AS tb FROM nx)"
_EDIT = lambda a, b: f"CASE WHEN greatest(len({a}), len({b})) = 0 THEN 1 ELSE 1 - levenshtein({a}, {b}) / nullif(greatest(len({a}), len({b})), 0)::DOUBLE END"
_JAC = "len(list_intersect(ga, gb)) / len(list_distinct(ga || gb))::DOUBLE"


def _pairs(spark, sf):
    from pyspark.sql import Window as W

    nxt = F.lead("text").over(W.partitionBy("conversation_id").orderBy("segment_index"))
    return _seg(spark, sf).select("conversation_id", "segment_index", tx.normal(F.col("text")).alias("a"), F.coalesce(tx.normal(nxt), F.lit("")).alias("b"))


@query("text_normalise", with_views("segment", f"SELECT {_SEG}, {_NORM('text')} AS text FROM segment"))
def text_normalise(spark, sf):
    return _seg(spark, sf).select("conversation_id", "segment_index", tx.normal(F.col("text")).alias("text"))


@query("word_count", with_views("segment", rf"SELECT {_SEG}, len(string_split_regex(text, '\s+')) AS n FROM segment"))
def word_count(spark, sf):
    return _seg(spark, sf).select("conversation_id", "segment_index", tx.word_count(F.col("text")).alias("n"))


@query("char_ngrams", with_views("segment", f", {_PAIRS} SELECT {_SEG}, len(ga) AS n, list_aggregate(list_sort(ga), 'string_agg', '|') AS grams FROM gx"))
def char_ngrams(spark, sf):
    g = _pairs(spark, sf).select("conversation_id", "segment_index", tx.char_ngrams(F.col("a")).alias("g"))
    return g.select("conversation_id", "segment_index", F.size("g").alias("n"), F.array_join(F.array_sort("g"), "|").alias("grams"))


@query("ngram_sets", with_views("segment", f", {_PAIRS} SELECT {_SEG}, len(list_intersect(ga, gb)) AS shared, len(list_distinct(ga || gb)) AS total FROM gx"))
def ngram_sets(spark, sf):
    # columns of their own, so that each is computed once
    g = _pairs(spark, sf).select("conversation_id", "segment_index", tx.char_ngrams(F.col("a")).alias("ga"), tx.char_ngrams(F.col("b")).alias("gb"))
    return g.select("conversation_id", "segment_index", F.size(F.array_intersect("ga", "gb")).alias("shared"), F.size(F.array_union("ga", "gb")).alias("total"))


@query("ngram_jaccard", with_views("segment", f", {_PAIRS} SELECT {_SEG}, {_JAC} AS score FROM gx"))
def ngram_jaccard(spark, sf):
    return ngram_sets(spark, sf).select("conversation_id", "segment_index", tx.jaccard(F.col("shared"), F.col("total")).alias("score"))


@query("edit_ratio", with_views("segment", f", {_PAIRS} SELECT {_SEG}, {_EDIT('a', 'b')} AS score FROM gx"))
def edit_ratio(spark, sf):
    return _pairs(spark, sf).select("conversation_id", "segment_index", tx.edit_ratio(F.col("a"), F.col("b")).alias("score"))


_SCORE = lambda: f"""CASE WHEN a = '' OR b = '' THEN 0 ELSE 0.30::DOUBLE * (2.0::DOUBLE * len(list_intersect(list_distinct(ta), list_distinct(tb))) / (len(list_distinct(ta)) + len(list_distinct(tb)))) + 0.25::DOUBLE * ({_EDIT("coalesce(list_aggregate(list_sort(ta), 'string_agg', ' '), '')", "coalesce(list_aggregate(list_sort(tb), 'string_agg', ' '), '')")})
+ 0.20::DOUBLE * (len(list_intersect(ga, gb)) / least(len(ga), len(gb))::DOUBLE) + 0.15::DOUBLE * ({_EDIT("a", "b")}) + 0.10::DOUBLE * ({_JAC}) END"""  # noqa: E731


@query("span_score", with_views("segment", f", {_PAIRS} SELECT {_SEG}, {_R(_SCORE(), 6)} AS score FROM gx"))
def span_score(spark, sf):
    from ..functions.numbers import round_half_up

    return tx.with_span_score(_pairs(spark, sf), "a", "b", "score").select("conversation_id", "segment_index", round_half_up(F.col("score"), 6).alias("score"))


@query("regex_escape", with_views("segment", rf"SELECT {_SEG}, regexp_replace(text, '([.*+?^${{}}()|\[\]\\])', '\\\1', 'g') AS text FROM segment"))
def regex_escape(spark, sf):
    return _seg(spark, sf).select("conversation_id", "segment_index", tx.regex_escape(F.col("text")).alias("text"))


# alignment

#: Segments with disturbed times: some too early, some too long, some too slow.
_TIMED = """tm AS (SELECT conversation_id, segment_index, CASE WHEN segment_index % 5 = 3 THEN greatest(0, start_ms - 9000) ELSE start_ms END AS start_ms, CASE WHEN segment_index % 5 = 3 THEN greatest(0, start_ms - 9000) + end_ms - start_ms WHEN segment_index % 4 = 2 THEN end_ms + 4000 WHEN segment_index % 7 = 6 THEN start_ms + 5 ELSE end_ms END AS end_ms,
len(w) AS n_words, (segment_index * 37 % 100) / 100.0::DOUBLE AS confidence, CASE WHEN segment_index % 3 = 0 THEN 'match' ELSE 'interpolated' END AS method FROM segment)"""


def _timed(spark, sf):
    i, a, b = F.col("segment_index"), F.col("start_ms"), F.col("end_ms")
    early = F.greatest(F.lit(0), a - 9000)
    start = F.when(i % 5 == 3, early).otherwise(a)
    end = F.when(i % 5 == 3, early + b - a).when(i % 4 == 2, b + 4000).when(i % 7 == 6, a + 5).otherwise(b)
    return _seg(spark, sf).select("conversation_id", "segment_index", start.cast("long").alias("start_ms"), end.cast("long").alias("end_ms"), ((b - a) / 150).cast("long").alias("n_words"), (i * 37 % 100 / 100.0).alias("confidence"), F.when(i % 3 == 0, "match").otherwise("interpolated").alias("method"))


@query("valid_words", with_views("word", "SELECT conversation_id, count(*) FILTER (end_s > start_s AND end_s > 0) AS valid, count(*) FILTER (NOT (end_s > start_s AND end_s > 0)) AS rejected FROM word GROUP BY 1"))
def valid_words(spark, sf):
    w = fx.words(spark, sf)
    n = w.groupBy("conversation_id").agg(F.count("*").alias("n"))
    v = al.valid_words(w).groupBy("conversation_id").agg(F.count("*").alias("valid"))
    return n.join(v, "conversation_id", "left").na.fill(0).select("conversation_id", "valid", (F.col("n") - F.col("valid")).alias("rejected"))


@query("word_duration_stats", with_views("word", f"""SELECT conversation_id, {_R("avg(ms)", 3)} AS mean_ms, min(ms) AS min_ms, max(ms) AS max_ms, count(*) FILTER (ms < 100) AS lt_100, count(*) FILTER (ms >= 100 AND ms < 300) AS lt_300, count(*) FILTER (ms >= 300 AND ms < 600) AS lt_600, count(*) FILTER (ms >= 600 AND ms < 1000) AS lt_1000, count(*) FILTER (ms >= 1000) AS more
FROM (SELECT conversation_id, {_R("(end_s - start_s) * 1000", 0)} AS ms FROM word WHERE end_s > start_s AND end_s > 0) GROUP BY 1"""))  # fmt: skip
def word_duration_stats(spark, sf):
    return al.word_duration_stats(al.valid_words(fx.words(spark, sf)))


@query("overlap_clip", with_views("segment", f""", {_TIMED}, l AS (SELECT *, lead(start_ms) OVER (PARTITION BY conversation_id ORDER BY segment_index) AS nx FROM tm)
SELECT {_SEG}, start_ms, CASE WHEN end_ms > nx + 2000 THEN greatest(start_ms + 100, nx - 100) ELSE end_ms END AS end_ms, CASE WHEN end_ms > nx + 2000 THEN confidence * 0.9::DOUBLE ELSE confidence END AS confidence, CASE WHEN end_ms > nx + 2000 THEN method || '_clipped' ELSE method END AS method FROM l"""))  # fmt: skip
def overlap_clip(spark, sf):
    return al.overlap_clip(_timed(spark, sf))


@query("overflow_scale", with_views("segment", f""", {_TIMED}, {_AUDIO}, z AS (SELECT *, last_value(end_ms) OVER (PARTITION BY conversation_id ORDER BY segment_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS le FROM tm JOIN au USING (conversation_id)), y AS (SELECT *, CASE WHEN le > audio_ms THEN audio_ms / le::DOUBLE END AS k FROM z)
SELECT {_SEG}, CASE WHEN k IS NOT NULL THEN floor(start_ms * k)::BIGINT ELSE start_ms END AS start_ms, CASE WHEN k IS NOT NULL THEN least(floor(end_ms * k)::BIGINT, audio_ms) ELSE end_ms END AS end_ms, CASE WHEN k IS NOT NULL THEN confidence * 0.8::DOUBLE ELSE confidence END AS confidence, CASE WHEN k IS NOT NULL THEN method || '_scaled' ELSE method END AS method FROM y"""))  # fmt: skip
def overflow_scale(spark, sf):
    s = _seg(spark, sf).groupBy("conversation_id").agg(F.max_by("end_ms", "segment_index").alias("e")).select("conversation_id", F.expr("e * (90 + conversation_id % 20) div 100").alias("audio_ms"))
    return al.overflow_scale(_timed(spark, sf).join(s, "conversation_id"))


@query("monotonic_repair", with_views("segment", f""", {_TIMED}, nn AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY segment_index) AS n FROM tm),
rr AS (SELECT conversation_id, 0::BIGINT AS n, 0::BIGINT AS segment_index, 0::BIGINT AS start_ms, 0::BIGINT AS end_ms, 0::DOUBLE AS confidence, '' AS method FROM (SELECT DISTINCT conversation_id FROM tm)
UNION ALL SELECT conversation_id, n, segment_index, CASE WHEN bad AND n > 1 THEN pe + 50 ELSE a END, CASE WHEN bad THEN (CASE WHEN n > 1 THEN pe + 50 ELSE a END) + 150 * n_words ELSE b END, CASE WHEN bad THEN 0.3::DOUBLE WHEN back THEN confidence * 0.9::DOUBLE ELSE confidence END, CASE WHEN bad THEN 'duration_fallback' WHEN back THEN method || '_fixed' ELSE method END
FROM (SELECT *, (b - a) / greatest(n_words, 1)::DOUBLE < 20 OR (b - a) / greatest(n_words, 1)::DOUBLE > 800 AS bad FROM (SELECT *, CASE WHEN back THEN pe ELSE start_ms END AS a, CASE WHEN back THEN pe + end_ms - start_ms ELSE end_ms END AS b FROM (SELECT x.*, r.end_ms AS pe, x.start_ms < r.end_ms - 2000 AS back FROM rr r JOIN nn x ON x.conversation_id = r.conversation_id AND x.n = r.n + 1))))
SELECT {_SEG}, start_ms, end_ms, confidence, method FROM rr WHERE n > 0"""))  # fmt: skip
def monotonic_repair(spark, sf):
    return al.monotonic_repair(_timed(spark, sf))


@query("alignment_quality", with_views("segment", f", {_TIMED} SELECT conversation_id, {_R('avg(confidence::DECIMAL(18,6))::DOUBLE', 3)} AS mean, min(confidence) AS least, max(confidence) AS greatest, count(*) FILTER (confidence >= 0.75) AS high, count(*) FILTER (confidence >= 0.5 AND confidence < 0.75) AS medium, count(*) FILTER (confidence < 0.5) AS low, count(*) FILTER (method = 'match') AS matched, {_R('100.0::DOUBLE * count(*) FILTER (method = ' + chr(39) + 'match' + chr(39) + ') / count(*)', 1)} AS percent FROM tm GROUP BY 1"))
def alignment_quality(spark, sf):
    return al.alignment_quality(_timed(spark, sf))


@query("quality_levels", with_views("segment", f""", {_TIMED}, rg AS (SELECT *, method AS m, sum((method = 'match')::INT) OVER (PARTITION BY conversation_id ORDER BY segment_index) AS region_id FROM tm)
SELECT CASE WHEN grouping(region_id) = 0 THEN 'region' WHEN grouping(method) = 0 THEN 'method' ELSE 'conversation' END AS level, conversation_id, region_id::BIGINT AS region_id, method, count(*) AS segments, {_R('avg(confidence::DECIMAL(18,6))::DOUBLE', 3)} AS mean, min(confidence) AS least, max(confidence) AS greatest, count(*) FILTER (confidence >= 0.75) AS high,
count(*) FILTER (confidence >= 0.5 AND confidence < 0.75) AS medium, count(*) FILTER (confidence < 0.5) AS low, count(*) FILTER (m = 'match') AS matched, {_R("100.0::DOUBLE * count(*) FILTER (m = 'match') / count(*)", 1)} AS percent
FROM rg GROUP BY GROUPING SETS ((conversation_id), (conversation_id, region_id), (conversation_id, method))"""))  # fmt: skip
def quality_levels(spark, sf):
    """Quality of conversations, regions and methods in one scan."""
    from pyspark.sql import Window as W

    region = F.sum((F.col("method") == "match").cast("long")).over(W.partitionBy("conversation_id").orderBy("segment_index"))
    return al.quality_levels(_timed(spark, sf).withColumn("region_id", region))


@query("anchor_stats", with_views("segment", f""", {_TIMED}, s AS (SELECT *, CASE WHEN segment_index % 4 <> 1 THEN confidence END AS score, coalesce(segment_index / nullif(max(segment_index) OVER (PARTITION BY conversation_id), 0)::DOUBLE, 0) AS p FROM tm), a AS (SELECT *, n_words BETWEEN 2 AND 20 AS fits, coalesce(n_words BETWEEN 2 AND 20 AND score >= 0.75, false) AS an FROM s)
SELECT conversation_id, count(*) FILTER (an) AS anchors, {_R("100.0::DOUBLE * count(*) FILTER (an) / count(*)", 1)} AS rate, count(*) FILTER (n_words < 2) AS too_short, count(*) FILTER (n_words > 20) AS too_long, count(*) FILTER (fits AND score IS NULL) AS no_match, count(*) FILTER (fits AND score < 0.75) AS low_score, coalesce(max(p) FILTER (an) <= 0.3, false) AS clustered,
{_R("coalesce(100.0::DOUBLE * (max(segment_index) FILTER (an) - min(segment_index) FILTER (an)) / count(*), 0)", 1)} AS coverage, {_R("avg(score::DECIMAL(18,6)) FILTER (an)", 3)} AS mean_confidence FROM a GROUP BY 1"""))  # fmt: skip
def anchor_stats(spark, sf):
    return al.anchor_stats(_timed(spark, sf).withColumn("score", F.when(F.col("segment_index") % 4 != 1, F.col("confidence"))))


_ANCHORED = """an AS (SELECT conversation_id, segment_index, segment_index % 3 = 1 AS is_anchor, start_ms // 150 AS word_start, end_ms // 150 AS word_end, max(end_ms // 150) OVER (PARTITION BY conversation_id) AS n_total, len(w) AS n_words FROM segment),
rg AS (SELECT *, sum(is_anchor::INT) OVER w AS region_id, last_value(CASE WHEN is_anchor THEN word_end END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, first_value(CASE WHEN is_anchor THEN word_start END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM an WINDOW w AS (PARTITION BY conversation_id ORDER BY segment_index)),
re AS (SELECT conversation_id, segment_index, region_id::BIGINT AS region_id, coalesce(a, 0) AS from_word, coalesce(b, n_total) AS to_word, n_words FROM rg WHERE NOT is_anchor)"""


def _anchored(spark, sf):
    from pyspark.sql import Window as W

    a, b = (F.col("start_ms") / 150).cast("long"), (F.col("end_ms") / 150).cast("long")
    return _seg(spark, sf).select("conversation_id", "segment_index", (F.col("segment_index") % 3 == 1).alias("is_anchor"), a.alias("word_start"), b.alias("word_end"), F.max(b).over(W.partitionBy("conversation_id")).alias("n_total"), (b - a).alias("n_words"))


@query("alignment_regions", with_views("segment", f", {_ANCHORED} SELECT * EXCLUDE (n_words) FROM re"))
def alignment_regions(spark, sf):
    return al.alignment_regions(_anchored(spark, sf))


@query("proportional_interpolation", with_views("segment", f""", {_ANCHORED}, q AS (SELECT *, 150 * from_word AS rs, 150 * to_word AS re_, sum(n_words) OVER r AS t, coalesce(sum(n_words) OVER (r ORDER BY segment_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM re WINDOW r AS (PARTITION BY conversation_id, region_id)),
e AS (SELECT *, least(rs + floor((b + n_words) / t::DOUBLE * (re_ - rs))::BIGINT, re_) AS e, rs + floor(b / t::DOUBLE * (re_ - rs))::BIGINT AS s FROM q) SELECT {_SEG}, region_id, least(s, e - 50) AS start_ms, e AS end_ms FROM e"""))  # fmt: skip
def proportional_interpolation(spark, sf):
    a = _anchored(spark, sf)
    r = al.alignment_regions(a).join(a.select("conversation_id", "segment_index", "n_words"), ["conversation_id", "segment_index"])
    return al.proportional_interpolation(r.withColumns({"region_start": 150 * F.col("from_word"), "region_end": 150 * F.col("to_word")}))


@query("alignment_durations", with_views("segment", f", {_TIMED} SELECT conversation_id, b AS before_ms, a AS after_ms, a - b AS difference_ms FROM (SELECT conversation_id, arg_max(end_ms, segment_index) AS b FROM segment GROUP BY 1) JOIN (SELECT conversation_id, arg_max(end_ms, segment_index) AS a FROM tm GROUP BY 1) USING (conversation_id)"))
def alignment_durations(spark, sf):
    """The length of each conversation before and after its times were changed."""
    return se.duration_difference(_seg(spark, sf), _timed(spark, sf))


@query("realign_zip", with_views("segment", f", {_TIMED} SELECT s.conversation_id, s.segment_index, s.speaker_id, t.start_ms, t.end_ms, 'aligned' AS alignment_status, (avg(t.confidence::DECIMAL(18,6)) OVER (PARTITION BY s.conversation_id))::DOUBLE < 0.55 AS low_confidence, arg_max(t.end_ms, s.segment_index) OVER (PARTITION BY s.conversation_id) AS duration_ms FROM segment s JOIN tm t USING ({_SEG})"))
def realign_zip(spark, sf):
    return se.realign(_seg(spark, sf), _timed(spark, sf))


@query("alignment_status", with_views("segment", f", {_TIMED} SELECT {_SEG}, coalesce(t.start_ms, s.start_ms) AS start_ms, coalesce(t.end_ms, s.end_ms) AS end_ms, coalesce(t.confidence, 0) AS confidence, coalesce(t.method, 'original') AS method, CASE WHEN count(t.start_ms) OVER (PARTITION BY conversation_id) > 0 THEN 'aligned' ELSE 'fallback' END AS status FROM segment s LEFT JOIN (SELECT * FROM tm WHERE conversation_id % 4 <> 0) t USING ({_SEG})"))
def alignment_status(spark, sf):
    return al.alignment_status(_seg(spark, sf), _timed(spark, sf).filter("conversation_id % 4 <> 0"))


def hints(spark, sf):
    """Segments without every seventh word, with times that drift, and their expected first word."""
    s = _seg(spark, sf)
    t = F.split(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), " ")
    kept = F.filter(t, lambda w, i: i % 7 != 6)
    n = F.size(kept).cast("long")
    return s.select("conversation_id", "segment_index", F.array_join(kept, " ").alias("text"), F.floor(F.col("start_ms") * 0.93).cast("long").alias("start_ms"), F.floor(F.col("end_ms") * 0.93).cast("long").alias("end_ms"), n.alias("n_words"), F.floor(F.col("start_ms") / 150 * 0.93).cast("long").alias("expected"))


_HINT = "hn AS (SELECT conversation_id, segment_index, list_aggregate(list_filter(w, lambda x, i: (i - 1) % 7 <> 6), 'string_agg', ' ') AS text, len(list_filter(w, lambda x, i: (i - 1) % 7 <> 6)) AS n, floor(start_ms / 150 * 0.93::DOUBLE)::BIGINT AS expected FROM segment)"
_EVERY = f""", {_HINT}, cand AS (SELECT * FROM (SELECT *, unnest(list_distinct([n, n - 1, n + 1, n - 2, n + 2, floor(n * 0.7::DOUBLE)::BIGINT])) AS size FROM (SELECT conversation_id, segment_index, n, unnest(range(greatest(expected - 5, 0), expected + 3 * n + 51)) AS start FROM hn WHERE n > 0))
JOIN (SELECT conversation_id, count(*) AS total FROM word GROUP BY 1) USING (conversation_id) WHERE size > 0 AND start + size <= total)"""


def _scores(cand: str, p: str, least: str) -> str:
    """Scores of the spans of ``cand`` that can reach ``least``: those whose shared words leave less are dropped first, then those whose shared 3-grams and lengths do."""
    dice = "2.0::DOUBLE * wb / (da + db)"
    known = f"0.30::DOUBLE * ({dice}) + 0.20::DOUBLE * (gb2 / least(xa, xb)::DOUBLE) + 0.10::DOUBLE * (gb2 / (xa + xb - gb2)::DOUBLE)"
    score = _R(f"""0.30::DOUBLE * ({dice}) + 0.25::DOUBLE * ({_EDIT("sa", "sb")}) + 0.20::DOUBLE * (gb2 / least(xa, xb)::DOUBLE) + 0.15::DOUBLE * ({_EDIT("a", "b")}) + 0.10::DOUBLE * (gb2 / (xa + xb - gb2)::DOUBLE)""", 6)
    words = "list_filter(said[start + 1:start + size], lambda w: w <> '')"

    def measured(rows: str) -> str:
        return f"""(SELECT * EXCLUDE (ga, gb, ta, tb), list_aggregate(list_sort(ta), 'string_agg', ' ') AS sa, list_aggregate(list_sort(tb), 'string_agg', ' ') AS sb, len(ga) AS xa, len(gb) AS xb, len(list_intersect(ga, gb)) AS gb2
FROM (SELECT *, {_GRAMS("b")} AS gb FROM (SELECT r.*, a, ga, ta, {words} AS tb, list_aggregate({words}, 'string_agg', ' ') AS b FROM ({rows}) r JOIN {p}hx USING ({_SEG}) JOIN {p}sd USING (conversation_id))))"""

    # edit distances are most of the work: parts of a union run side by side
    spread = lambda select, by: " UNION ALL ".join(f"{select} {'AND' if ' WHERE ' in select else 'WHERE'} ({by}) % 16 = {k}" for k in range(16))
    return f"""{p}hx AS MATERIALIZED (SELECT {_SEG}, a, {_GRAMS("a")} AS ga, ta, list_distinct(ta) AS dta FROM (SELECT *, list_filter(string_split(a, ' '), lambda w: w <> '') AS ta FROM (SELECT {_SEG}, {_NORM("text")} AS a FROM hn)) WHERE a <> ''),
{p}sd AS MATERIALIZED (SELECT conversation_id, list({_NORM("word")} ORDER BY word_index) AS said FROM word GROUP BY 1),
{p}di AS MATERIALIZED (SELECT * EXCLUDE (dta, dtb), len(dta) AS da, len(dtb) AS db, len(list_intersect(dta, dtb)) AS wb
FROM (SELECT c.*, dta, list_distinct({words}) AS dtb FROM {cand} c JOIN {p}hx USING ({_SEG}) JOIN {p}sd USING (conversation_id) WHERE start + size <= len(said)) WHERE len(dtb) > 0),
{p}ms AS MATERIALIZED {measured(f"SELECT * FROM {p}di WHERE 0.30::DOUBLE * ({dice}) + 0.70001::DOUBLE >= {least}")},
{p}bd AS (SELECT *, {known} + 0.25::DOUBLE * (1 - abs(len(a) - len(b)) / greatest(len(a), len(b))::DOUBLE) + 0.15::DOUBLE * (1 - greatest(abs(len(a) - len(b)), ceil((greatest(xa, xb) - gb2) / 3.0::DOUBLE)) / greatest(len(a), len(b))::DOUBLE) AS bound FROM {p}ms),
{p}sc AS MATERIALIZED ({spread(f"SELECT {_SEG}, n, start, size, {score} AS score FROM {p}bd WHERE bound + 0.00001::DOUBLE >= {least}", "start * 7 + size")})"""


#: Ranges of anchors, their spans, and the heaviest chain of each conversation, span by span.
_AT = "(SELECT CASE WHEN c < total THEN greatest(c - 1, 0) ELSE total - 1 END FROM (SELECT count(*) FILTER (WHERE x.start_s < {t}) AS c FROM word x WHERE x.conversation_id = h.conversation_id))"
_SIX = "unnest(list_distinct([n, n - 1, n + 1, n - 2, n + 2, floor(n * 0.7::DOUBLE)::BIGINT])) AS size"
_ANCHORS = f""", {_HINT.replace("AS expected FROM", "AS expected, floor(start_ms * 0.93::DOUBLE)::BIGINT AS hs, floor(end_ms * 0.93::DOUBLE)::BIGINT AS he FROM")},
tw AS (SELECT conversation_id, count(*) AS total FROM word GROUP BY 1),
ra AS MATERIALIZED (SELECT conversation_id, segment_index, n, total, {_AT.format(t="greatest(h.hs - 30000, 0) / 1000.0::DOUBLE")} AS a, {_AT.format(t="(h.he + 30000) / 1000.0::DOUBLE")} AS b FROM hn h JOIN tw USING (conversation_id) WHERE n BETWEEN 2 AND 20),
rb AS (SELECT conversation_id, segment_index, n, total, CASE WHEN segment_index < 5 THEN 0 ELSE a END AS lo, CASE WHEN segment_index < 5 THEN total WHEN b - a < n + 10 THEN least(total, a + n + 20) ELSE b END AS hi FROM ra),
c1 AS (SELECT * FROM (SELECT *, {_SIX} FROM (SELECT {_SEG}, n, hi, unnest(range(lo, hi)) AS start FROM rb)) WHERE size > 0 AND start + size <= hi),
{_scores("c1", "p", "0.75::DOUBLE")},
lone AS (SELECT * FROM ra WHERE conversation_id NOT IN (SELECT conversation_id FROM psc WHERE score >= 0.75)),
c2 AS (SELECT * FROM (SELECT *, {_SIX} FROM (SELECT {_SEG}, n, total AS hi, unnest(range(0, total)) AS start FROM lone)) WHERE size > 0 AND start + size <= hi),
{_scores("c2", "q", "0.75::DOUBLE")},
sp AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY segment_index, start, size) AS k FROM (SELECT * FROM psc WHERE score >= 0.75 UNION ALL SELECT * FROM qsc WHERE score >= 0.75)),
ch AS (SELECT conversation_id, 0::BIGINT AS k, []::STRUCT(w BIGINT, e BIGINT, k BIGINT, g BIGINT, p BIGINT)[] AS f FROM (SELECT DISTINCT conversation_id FROM sp)
UNION ALL SELECT s.conversation_id, s.k, ch.f || [(SELECT {{'w': round(s.score * 1e6)::BIGINT + coalesce(v.w, 0), 'e': s.start + s.size, 'k': s.k, 'g': s.segment_index, 'p': coalesce(v.k, 0)}}
FROM (SELECT list_sort(list_transform(list_filter(ch.f, lambda x: x.g < s.segment_index AND x.e <= s.start), lambda x: {{'w': -x.w, 'e': x.e, 'k': x.k}}))[1] AS o), (SELECT 1), LATERAL (SELECT -o.w AS w, o.k AS k) v)]
FROM ch JOIN sp s ON s.conversation_id = ch.conversation_id AND s.k = ch.k + 1),
fin AS (SELECT conversation_id, f FROM ch QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY k DESC) = 1),
bk AS (SELECT conversation_id, f, list_sort(list_transform(f, lambda x: {{'w': -x.w, 'e': x.e, 'k': x.k}}))[1].k AS k FROM fin
UNION ALL SELECT conversation_id, f, f[k].p FROM bk WHERE f[k].p > 0)"""


@query("span_candidates", with_views("segment word", _EVERY + f" SELECT {_SEG}, n, start, size FROM cand"))
@query("span_candidates_all", with_views("segment word", _EVERY + f" SELECT {_SEG}, n, start, size FROM cand"))
def span_candidates(spark, sf):
    """The spans of segments of any length; the second name is an earlier round's for the same."""
    return al.span_candidates(hints(spark, sf), fx.words(spark, sf))


# DuckDB takes some 25 ms for a distance of two long segments, so SQL does not end on whole tables; tests hold
# the search against scoring every span.
@query("best_match")
@query("best_match_all")
def best_match(spark, sf):
    """The best span of every segment; the second name is an earlier round's for the same."""
    return al.matches_in(al.in_band(hints(spark, sf)), al.blocks(fx.words(spark, sf)))


@query("anchor_selection", with_views("segment word", _ANCHORS + f" SELECT sp.{_SEG.replace(', ', ', sp.')}, sp.start, sp.size, sp.score FROM bk JOIN sp USING (conversation_id, k)"))
def anchor_selection(spark, sf):
    w = fx.words(spark, sf)
    return al.anchor_selection(al.anchor_spans(hints(spark, sf), w, al.blocks(w)))


@query("align_transcripts")
def align_transcripts(spark, sf):
    return al.aligned_transcripts(hints(spark, sf), fx.words(spark, sf))


@query("alignment_report")
def alignment_report(spark, sf):
    """The alignment judged by conversation, region and method: the end of the chain."""
    return al.aligned_quality(al.aligned_transcripts(hints(spark, sf), fx.words(spark, sf)))


@query("transcript_pipeline", with_views("segment correction term", REPAIR + f", {_REASSIGN}, {NUMBERED} SELECT r.conversation_id, r.segment_index, a.speaker_id, coalesce(k.display_name, a.speaker_id) AS display_name, r.start_ms, r.end_ms, r.text FROM repaired r JOIN rea a USING ({_SEG}) LEFT JOIN spk k ON k.conversation_id = r.conversation_id AND k.speaker_id = a.speaker_id"))
def transcript_pipeline(spark, sf):
    """Repair, corrections and speaker names in one plan."""
    s, key = _seg(spark, sf), ["conversation_id", "segment_index"]
    fixed = se.apply_reassign(s, fx.corrections(spark, sf)).select(*key, "speaker_id")
    named = se.segment_speaker(fixed, se.speaker_numbering(s)).select(*key, "speaker_id", "display_name")
    return se.boundary_repair(s).drop("speaker_id").join(named, key)


#: Recordings whose recogniser output is broken, and those in which nobody speaks.
_BROKEN, _SILENT = 3, 5


def uploads(spark, sf):
    """What the recogniser and the model wrote for each conversation: one in seven is no JSON, one in eleven has blank segments only."""
    s = _seg(spark, sf)
    c = F.col("conversation_id")
    text = F.when(c % 11 == _SILENT, F.lit("  ")).otherwise(F.col("text"))
    part = F.struct(text.alias("text"), (F.col("start_ms") / 1000.0).cast("string").alias("start"), (F.col("end_ms") / 1000.0).cast("string").alias("end"), F.col("speaker_id").alias("speaker"))
    asr = s.groupBy("conversation_id").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("segment_index", part.alias("p")))), lambda x: x["p"]).alias("segments"))).alias("asr"))
    fixes = fx.corrections(spark, sf).groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", F.col("segment_index").alias("segmentIndex"), F.col("new_speaker").alias("newSpeaker")))).alias("corrections"))
    body = F.to_json(F.struct("corrections"))
    rows = asr.join(fixes, "conversation_id", "left")
    return rows.select("conversation_id", (c % 13).alias("user_id"), F.when(c % 7 == _BROKEN, F.substring("asr", 1, 40)).otherwise(F.col("asr")).alias("asr"), F.when(c % 5 == 0, "no JSON {").otherwise(body).alias("corrections"))


@query("upload_chain", with_views("segment correction term", REPAIR + f""", k AS (SELECT DISTINCT conversation_id, speaker_id FROM segment), l AS (SELECT conversation_id, segment_index, arg_max(new_speaker, ordinal) AS ns FROM correction c WHERE conversation_id % 5 <> 0 AND EXISTS (SELECT 1 FROM k WHERE k.conversation_id = c.conversation_id AND k.speaker_id = c.new_speaker) GROUP BY 1, 2),
rea AS (SELECT {_SEG}, coalesce(ns, speaker_id) AS speaker_id, coalesce(ns <> speaker_id, false) AS corrected FROM segment LEFT JOIN l USING ({_SEG})),
p AS (SELECT {_SEG}, text, ordinal, term_id, '(?i)\\b(?:' || list_aggregate(list_transform(list_filter([display] || aliases, lambda a: a <> ''), lambda a: {_ESC}), 'string_agg', '|') || ')\\b' AS pat FROM repaired, term),
{_MATCH}, oc AS (SELECT conversation_id, count(DISTINCT term_id) AS terms, count(*) AS occurrences FROM o GROUP BY 1),
g AS (SELECT conversation_id, count(*) AS segments, count(DISTINCT rea.speaker_id) AS speakers, arg_max(r.end_ms, segment_index) AS duration_ms, count(*) FILTER (corrected) AS corrections FROM repaired r JOIN rea USING ({_SEG}) GROUP BY 1),
e AS (SELECT *, CASE WHEN conversation_id % 7 = {_BROKEN} THEN 'response is not JSON' WHEN conversation_id % 11 = {_SILENT} THEN 'no segments' END AS error FROM g LEFT JOIN oc USING (conversation_id))
SELECT conversation_id, conversation_id % 13 AS user_id, CASE WHEN error IS NULL THEN 'complete' ELSE 'failed' END AS status, error, CASE WHEN error IS NULL THEN 'processing_completed' ELSE 'processing_failed' END AS event_type,
CASE WHEN error IS NULL THEN segments ELSE 0 END AS segments, CASE WHEN error IS NULL THEN speakers ELSE 0 END AS speakers, CASE WHEN error IS NULL THEN duration_ms ELSE 0 END AS duration_ms, CASE WHEN error IS NULL THEN corrections ELSE 0 END AS corrections,
CASE WHEN error IS NULL THEN coalesce(terms, 0) ELSE 0 END AS terms, CASE WHEN error IS NULL THEN coalesce(occurrences, 0) ELSE 0 END AS occurrences, CASE WHEN error IS NULL THEN segments ELSE 0 END AS stored FROM e""".replace("g AS (SELECT conversation_id, count(*) AS segments", "g2 AS (SELECT conversation_id, count(*) AS segments").replace("FROM g LEFT JOIN oc", "FROM g2 LEFT JOIN oc")))  # fmt: skip
def upload_chain(spark, sf):
    """All steps from recogniser output to stored document in one plan; a broken response fails its conversation alone."""
    from ..operators import uploads as up

    done = up.processed(uploads(spark, sf), fx.terms(spark, sf))
    return done.select("conversation_id", "user_id", "status", "error", up.event_type().alias("event_type"), "segments", "speakers", "duration_ms", "corrections", "terms", "occurrences", F.coalesce(F.size("document"), F.lit(0)).cast("long").alias("stored"))
