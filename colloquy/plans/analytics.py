"""Queries of usage analytics, prices and reports over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pricing, reports, usage
from . import fixtures as fx
from .fixtures import AS_OF, with_views
from .registry import query

_R = lambda x, k: f"(floor(({x}) * 1e{k} + 0.5) / 1e{k})"
_SUM = lambda x: f"coalesce(sum(CAST({x} AS DECIMAL(18,6)))::DOUBLE, 0)"
_NUM = lambda c: f"CASE WHEN json_type(metadata, '$.{c}') IN ('DOUBLE', 'BIGINT', 'UBIGINT') AND json_extract(metadata, '$.{c}')::DOUBLE <> 0 THEN json_extract(metadata, '$.{c}')::DOUBLE END"

_ROLL_E = ", ".join(f"count(*) FILTER (\"timestamp\" >= TIMESTAMP '{AS_OF}' - INTERVAL {d} DAY AND event_type = 'conversation_{k}')::BIGINT AS {k}_{d}d" for d in (7, 30) for k in ("created", "deleted"))
_new = lambda d, s: f"\"timestamp\" >= TIMESTAMP '{AS_OF}' - INTERVAL {d} DAY AND status = '{s}'"
_ROLL_J = ", ".join(
    f"count(*) FILTER ({_new(d, 'success')})::BIGINT AS succeeded_{d}d, count(*) FILTER ({_new(d, 'failed')})::BIGINT AS failed_{d}d, "
    f"{_R(_SUM(f'CASE WHEN {_new(d, "success")} THEN duration_ms / 3600000.0::DOUBLE END'), 3)} AS audio_hours_{d}d, {_R(_SUM(f'CASE WHEN {_new(d, "success")} THEN compute_s * 0.0023::DOUBLE END'), 6)} AS cost_usd_{d}d"
    for d in (7, 30)
)
_ROLL_COLS = [f"{c}_{d}d" for d in (7, 30) for c in ("succeeded", "failed", "audio_hours", "cost_usd")]
ROLLING = f""", e AS (SELECT user_id, {_ROLL_E} FROM user_event WHERE user_id IS NOT NULL GROUP BY user_id),
j AS (SELECT user_id, {_ROLL_J} FROM job_metric GROUP BY user_id),
roll AS (SELECT e.*, {", ".join(f"coalesce(j.{c}, 0) AS {c}" for c in _ROLL_COLS)} FROM e LEFT JOIN j USING (user_id))"""

CLAMP = """, s AS (SELECT *, sum(CASE event_type WHEN 'conversation_created' THEN 1 WHEN 'conversation_deleted' THEN -1 ELSE 0 END) OVER w AS s FROM user_event WINDOW w AS (PARTITION BY user_id ORDER BY "timestamp", event_id ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, (s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY "timestamp", event_id ROWS UNBOUNDED PRECEDING)))::BIGINT AS existing FROM s)"""
LIFETIME = CLAMP + f""",
life AS (SELECT user_id, count(*) FILTER (event_type = 'conversation_created')::BIGINT AS created, count(*) FILTER (event_type = 'conversation_deleted')::BIGINT AS deleted,
count(*) FILTER (event_type = 'processing_completed')::BIGINT AS succeeded, count(*) FILTER (event_type = 'processing_failed')::BIGINT AS failed,
arg_max(existing, ROW("timestamp", event_id)) AS existing,
{_R(_SUM(f"CASE WHEN event_type = 'processing_completed' THEN {_NUM('durationMs')} / 3600000.0::DOUBLE END"), 3)} AS audio_hours,
{_R(_SUM(f"CASE WHEN event_type = 'processing_completed' THEN {_NUM('estimatedCostUsd')} END"), 6)} AS cost_usd,
min("timestamp") AS first_activity_at, max("timestamp") AS last_activity_at FROM c WHERE user_id IS NOT NULL GROUP BY user_id)"""
DAILY = f""", f AS (SELECT d AS date, count(*) AS new_users FROM (SELECT min("timestamp")::DATE AS d FROM user_event WHERE user_id IS NOT NULL GROUP BY user_id) GROUP BY 1),
e AS (SELECT "timestamp"::DATE AS date, count(*) FILTER (event_type = 'conversation_created') AS created, count(*) FILTER (event_type = 'conversation_deleted') AS deleted FROM user_event GROUP BY 1),
j AS (SELECT "timestamp"::DATE AS date, count(DISTINCT user_id) AS active_users, count(*) FILTER (status = 'success') AS succeeded, count(*) FILTER (status = 'failed') AS failed,
{_R(_SUM("CASE WHEN status = 'success' THEN duration_ms / 3600000.0::DOUBLE END"), 3)} AS audio_hours,
sum(coalesce(analysis_in, 0) + coalesce(analysis_out, 0) + coalesce(correction_in, 0) + coalesce(correction_out, 0)) AS tokens,
{_R(_SUM("compute_s"), 0)} AS compute_s, {_R(_SUM("compute_s * 0.0023::DOUBLE"), 6)} AS cost_usd,
{_R("coalesce(" + _SUM("CASE WHEN status = 'success' THEN total_ms END") + " / nullif(count(*) FILTER (status = 'success'), 0), 0)", 0)} AS mean_ms FROM job_metric GROUP BY 1),
days AS (SELECT unnest(generate_series(min("timestamp")::DATE, max("timestamp")::DATE, INTERVAL 1 DAY))::DATE AS date FROM user_event),
daily AS (SELECT strftime(days.date, '%Y-%m-%d') AS date, coalesce(new_users, 0)::BIGINT AS new_users, coalesce(created, 0)::BIGINT AS created, coalesce(deleted, 0)::BIGINT AS deleted,
coalesce(active_users, 0)::BIGINT AS active_users, coalesce(succeeded, 0)::BIGINT AS succeeded, coalesce(failed, 0)::BIGINT AS failed, coalesce(audio_hours, 0) AS audio_hours,
coalesce(tokens, 0)::BIGINT AS tokens, coalesce(compute_s, 0) AS compute_s, coalesce(cost_usd, 0) AS cost_usd, coalesce(mean_ms, 0) AS mean_ms
FROM days LEFT JOIN f USING (date) LEFT JOIN e USING (date) LEFT JOIN j USING (date))"""
_LATEST = lambda n: f'(SELECT * FROM job_metric ORDER BY "timestamp" DESC, conversation_id DESC LIMIT {n})'
GLOBAL = LIFETIME + f""" SELECT u.*, j.* FROM (SELECT count(*) AS users, count(*) FILTER (last_activity_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS active_7d,
count(*) FILTER (last_activity_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) AS active_30d, sum(created)::BIGINT AS created, sum(deleted)::BIGINT AS deleted, sum(existing)::BIGINT AS existing FROM life) u,
(SELECT count(*) AS jobs, {_R("coalesce(100.0::DOUBLE * count(*) FILTER (status = 'success') / nullif(count(*), 0), 0)", 1)} AS success_percent,
{_R("coalesce(" + _SUM("CASE WHEN status = 'success' THEN total_ms END") + " / nullif(count(*) FILTER (status = 'success'), 0), 0)", 0)} AS mean_ms,
{_R(_SUM("CASE WHEN status = 'success' THEN duration_ms / 3600000.0::DOUBLE END"), 2)} AS audio_hours,
sum(coalesce(analysis_in, 0) + coalesce(correction_in, 0))::BIGINT AS input_tokens, sum(coalesce(analysis_out, 0) + coalesce(correction_out, 0))::BIGINT AS output_tokens,
{_R(_SUM("compute_s"), 0)} AS compute_s, {_R(_SUM("compute_s * 0.0023::DOUBLE"), 2)} AS cost_usd FROM {_LATEST(1000)}) j"""


def _life(spark, sf):
    return usage.user_lifetime(fx.user_events(spark, sf))


def _roll(spark, sf):
    return usage.rolling_windows(fx.user_events(spark, sf), fx.job_metrics(spark, sf), AS_OF)


def _daily(spark, sf):
    return usage.daily_stats(fx.user_events(spark, sf), fx.job_metrics(spark, sf))


@query("rolling_windows", with_views("user_event job_metric", ROLLING + " SELECT * FROM roll"))
def rolling_windows(spark, sf):
    return _roll(spark, sf)


@query("user_lifetime", with_views("user_event", LIFETIME + " SELECT * FROM life"))
def user_lifetime(spark, sf):
    return _life(spark, sf)


@query("clamped_counter", with_views("user_event", CLAMP + " SELECT event_id, user_id, existing FROM c"))
def clamped_counter(spark, sf):
    return usage.clamped_counter(fx.user_events(spark, sf)).select("event_id", "user_id", "existing")


@query("daily_stats", with_views("user_event job_metric", DAILY + " SELECT * FROM daily"))
def daily_stats(spark, sf):
    return _daily(spark, sf)


@query("daily_series", with_views("user_event job_metric", DAILY + " SELECT date, succeeded, failed FROM daily WHERE date BETWEEN '2024-01-10' AND '2024-01-20' ORDER BY date"))
def daily_series(spark, sf):
    return _daily(spark, sf).filter(F.col("date").between("2024-01-10", "2024-01-20")).select("date", "succeeded", "failed").orderBy("date")


@query("global_stats", with_views("user_event job_metric", GLOBAL))
def global_stats(spark, sf):
    return usage.global_stats(_life(spark, sf), fx.job_metrics(spark, sf), AS_OF)


@query("top_users", with_views("user_event", LIFETIME + " SELECT user_id, created, existing, audio_hours, cost_usd FROM life ORDER BY last_activity_at DESC, user_id DESC LIMIT 100"))
def top_users(spark, sf):
    return usage.top_users(_life(spark, sf))


@query("latest_jobs", with_views("job_metric", f'SELECT conversation_id, user_id, status, "timestamp" FROM {_LATEST(50)}'))
def latest_jobs(spark, sf):
    return usage.latest_jobs(fx.job_metrics(spark, sf), 50).select("conversation_id", "user_id", "status", "timestamp")


@query("recent_jobs", with_views("job_metric", f"SELECT conversation_id, user_id, status FROM {_LATEST(50)} WHERE status = 'failed'"))
def recent_jobs(spark, sf):
    return usage.recent_jobs(fx.job_metrics(spark, sf), 50, F.col("status") == "failed").select("conversation_id", "user_id", "status")


@query("distinct_users", with_views("job_metric", "SELECT count(DISTINCT nullif(user_id::VARCHAR, '')) AS users FROM job_metric"))
def distinct_users(spark, sf):
    return usage.distinct_users(fx.job_metrics(spark, sf))


@query("time_window_filter", with_views("user_event", "SELECT event_id, event_type, user_id FROM user_event WHERE \"timestamp\" >= TIMESTAMP '2024-01-30' AND \"timestamp\" < TIMESTAMP '2024-01-31'"))
def time_window_filter(spark, sf):
    return usage.day_window(fx.user_events(spark, sf), AS_OF).select("event_id", "event_type", "user_id")


@query("usage_summary", with_views("user_event job_metric", ROLLING + " SELECT user_id, '7d' AS \"window\", succeeded_7d + failed_7d AS jobs, audio_hours_7d AS audio_hours, cost_usd_7d AS cost_usd FROM roll UNION ALL SELECT user_id, '30d', succeeded_30d + failed_30d, audio_hours_30d, cost_usd_30d FROM roll"))
def usage_summary(spark, sf):
    return usage.usage_summary(_roll(spark, sf))


@query("activity_union", with_views("user_event", "SELECT event_id, event_type, user_id, conversation_id, \"timestamp\" FROM user_event WHERE event_type IN ('conversation_created', 'conversation_deleted', 'processing_completed', 'processing_failed')"))
def activity_union(spark, sf):
    e = fx.user_events(spark, sf)
    return usage.activity_union(e.filter(F.col("event_type").isin(usage.CREATED, usage.DELETED)), e.filter(F.col("event_type").isin(usage.COMPLETED, usage.FAILED)))


@query("json_number_guard", with_views("user_event", f"SELECT event_id, {_NUM('durationMs')} AS duration_ms, {_NUM('estimatedCostUsd')} AS cost_usd FROM user_event WHERE metadata IS NOT NULL"))
def json_number_guard(spark, sf):
    from ..functions.numbers import json_number

    e = fx.user_events(spark, sf).filter("metadata is not null")
    return e.select("event_id", json_number(F.col("metadata"), "durationMs").alias("duration_ms"), json_number(F.col("metadata"), "estimatedCostUsd").alias("cost_usd"))


@query("unit_conversions", with_views("job_metric", f"SELECT conversation_id, {_R('duration_ms / 3600000.0::DOUBLE', 3)} AS audio_hours, {_R('total_ms / 1000.0::DOUBLE', 2)} AS seconds, {_R('(coalesce(analysis_in, 0) + coalesce(correction_in, 0)) / 1e6', 6)} AS input_m FROM job_metric"))
def unit_conversions(spark, sf):
    from ..functions.numbers import hours, round_half_up

    tokens = F.coalesce("analysis_in", F.lit(0)) + F.coalesce("correction_in", F.lit(0))
    return fx.job_metrics(spark, sf).select("conversation_id", round_half_up(hours(F.col("duration_ms")), 3).alias("audio_hours"), round_half_up(F.col("total_ms") / 1000.0, 2).alias("seconds"), round_half_up(tokens / 1e6, 6).alias("input_m"))


# prices

PRICED = """, jp AS (SELECT j.*, CASE WHEN p.effective_until IS NULL OR p.effective_until > j."timestamp" THEN p.pricing_id END AS tok_id, CASE WHEN p.effective_until IS NULL OR p.effective_until > j."timestamp" THEN p.input_price END AS tok_in,
CASE WHEN p.effective_until IS NULL OR p.effective_until > j."timestamp" THEN p.output_price END AS tok_out FROM job_metric j ASOF LEFT JOIN (SELECT * FROM pricing WHERE model = 'tokens-a') p ON j."timestamp" >= p.effective_from),
jr AS (SELECT jp.*, CASE WHEN p.effective_until IS NULL OR p.effective_until > jp."timestamp" THEN p.pricing_id END AS rec_id, CASE WHEN p.effective_until IS NULL OR p.effective_until > jp."timestamp" THEN p.second_price END AS rec_s
FROM jp ASOF LEFT JOIN (SELECT * FROM pricing WHERE model = 'recogniser') p ON jp."timestamp" >= p.effective_from)"""
COSTS = PRICED + f""", parts AS (SELECT conversation_id, user_id, "timestamp", ((coalesce(analysis_in, 0) + coalesce(correction_in, 0)) * coalesce(tok_in, 0.075::DOUBLE) + (coalesce(analysis_out, 0) + coalesce(correction_out, 0)) * coalesce(tok_out, 0.30::DOUBLE)) / 1e6 AS t,
coalesce(compute_s, 0) * coalesce(rec_s, 0.0023::DOUBLE) AS r, coalesce(diarisation_s, 0) * 0.0015::DOUBLE AS d FROM jr),
cost AS (SELECT conversation_id, user_id, "timestamp", {_R("t", 6)} AS tokens_usd, {_R("r", 6)} AS recogniser_usd, {_R("d", 6)} AS diariser_usd, {_R("t + r + d", 6)} AS total_usd FROM parts)"""
BREAKDOWN = (
    COSTS
    + f""", b AS (SELECT * FROM (SELECT 'tokens' AS service, sum(tokens_usd::DECIMAL(18,6))::DOUBLE AS cost_usd FROM cost UNION ALL SELECT 'recogniser', sum(recogniser_usd::DECIMAL(18,6))::DOUBLE FROM cost
UNION ALL SELECT 'diariser', sum(diariser_usd::DECIMAL(18,6))::DOUBLE FROM cost) WHERE cost_usd > 0), b2 AS (SELECT *, {_R("100 * cost_usd / sum(cost_usd) OVER ()", 1)} AS percent FROM b)
SELECT *, CASE WHEN percent >= 5 THEN service ELSE '' END AS label FROM b2"""
)


@query("price_asof", with_views("job_metric pricing", PRICED + " SELECT conversation_id, tok_id, tok_in, rec_id, rec_s FROM jr"))
def price_asof(spark, sf):
    j = pricing.prices_asof(fx.job_metrics(spark, sf), fx.prices(spark), {"tokens-a": "tok", "recogniser": "rec"})
    return j.select("conversation_id", F.col("tok_pricing_id").alias("tok_id"), F.col("tok_input_price").alias("tok_in"), F.col("rec_pricing_id").alias("rec_id"), F.col("rec_second_price").alias("rec_s"))


@query("job_cost", with_views("job_metric pricing", COSTS + " SELECT * FROM cost"))
def job_cost(spark, sf):
    return pricing.job_cost(fx.job_metrics(spark, sf), fx.prices(spark))


@query("cost_breakdown", with_views("job_metric pricing", BREAKDOWN))
def cost_breakdown(spark, sf):
    return pricing.cost_breakdown(job_cost(spark, sf))


@query("billing", with_views("job_metric pricing", COSTS + f" SELECT user_id, count(*) AS jobs, {_R('sum(total_usd::DECIMAL(18,6))::DOUBLE', 6)} AS total_usd FROM cost GROUP BY user_id"))
def billing(spark, sf):
    from ..functions.numbers import exact_sum, round_half_up

    return job_cost(spark, sf).groupBy("user_id").agg(F.count("*").alias("jobs"), round_half_up(exact_sum(F.col("total_usd")), 6).alias("total_usd"))


# Prices tied to the jobs that they priced: the queries' work grows with the jobs.
@query("pricing_history", with_views("job_metric pricing", PRICED + """, h AS (SELECT model, pricing_id, effective_from, row_number() OVER (PARTITION BY model ORDER BY effective_from DESC, pricing_id DESC) AS position FROM pricing),
u AS (SELECT id, count(*) AS jobs FROM (SELECT tok_id AS id FROM jr UNION ALL SELECT rec_id FROM jr) GROUP BY id)
SELECT model, pricing_id, effective_from, position, position = 1 AS is_current, coalesce(jobs, 0)::BIGINT AS jobs FROM h LEFT JOIN u ON id = pricing_id"""))  # fmt: skip
def pricing_history(spark, sf):
    used = price_asof(spark, sf).select(F.explode(F.array("tok_id", "rec_id")).alias("pricing_id")).groupBy("pricing_id").agg(F.count("*").alias("jobs"))
    return pricing.pricing_history(fx.prices(spark)).join(used, "pricing_id", "left").na.fill(0, ["jobs"])


@query("pricing_validity", with_views("job_metric", """SELECT conversation_id AS pricing_id, CASE WHEN trim(coalesce(m, '')) = '' THEN 'model' WHEN s = 'tokens' AND i IS NULL AND o IS NULL THEN 'token price' WHEN s = 'time' AND p IS NULL THEN 'second price' END AS error
FROM (SELECT conversation_id, CASE WHEN conversation_id % 7 = 0 THEN ' ' ELSE 'm' END AS m, CASE WHEN status = 'success' THEN 'tokens' ELSE 'time' END AS s, CASE WHEN analysis_in > 50000 THEN compute_s END AS i, diarisation_s AS o, CASE WHEN user_id % 2 = 0 THEN 0.1 END AS p FROM job_metric)"""))  # fmt: skip
def pricing_validity(spark, sf):
    j = fx.job_metrics(spark, sf)
    rows = j.select(F.col("conversation_id").alias("pricing_id"), F.when(F.col("conversation_id") % 7 == 0, " ").otherwise("m").alias("model"), F.when(F.col("status") == "success", "tokens").otherwise("time").alias("service"), F.when(F.col("analysis_in") > 50000, F.col("compute_s")).alias("input_price"), F.col("diarisation_s").alias("output_price"), F.when(F.col("user_id") % 2 == 0, 0.1).alias("second_price"))
    return pricing.pricing_validity(rows)


# reports

@query("job_report", with_views("job_metric", f""", r AS (SELECT *, {_R("total_ms / 1000.0::DOUBLE", 1)} AS s, {_R("total_ms / 60000.0::DOUBLE", 1)} AS m, {_R("total_ms / 3600000.0::DOUBLE", 1)} AS h, {_R("coalesce(compute_s, 0) * 0.0023::DOUBLE", 6)} AS usd FROM job_metric)
SELECT conversation_id, status, CASE WHEN total_ms < 1000 THEN floor(total_ms + 0.5)::BIGINT || 'ms' WHEN total_ms < 60000 THEN printf('%.1f', s) || 's' WHEN total_ms < 3600000 THEN printf('%.1f', m) || 'm' ELSE printf('%.1f', h) || 'h' END AS took,
CASE WHEN usd = 0 THEN '-' WHEN usd < 0.01 THEN '$' || printf('%.6f', usd) WHEN usd < 1 THEN '$' || printf('%.4f', {_R("usd", 4)}) ELSE '$' || printf('%.2f', {_R("usd", 2)}) END AS cost,
floor(duration_ms / 60000)::BIGINT || ':' || lpad((floor(duration_ms / 1000)::BIGINT % 60)::VARCHAR, 2, '0') AS length, strftime("timestamp", '%m/%d') AS day, left(conversation_id::VARCHAR, 3) || '...' AS short_id FROM r"""))  # fmt: skip
def job_report(spark, sf):
    return reports.job_report(fx.job_metrics(spark, sf))


@query("chart_series", with_views("user_event job_metric", DAILY + f""" SELECT date, 'succeeded' AS series, succeeded::DOUBLE AS value FROM daily UNION ALL SELECT date, 'failed', failed::DOUBLE FROM daily UNION ALL SELECT date, 'audio_hours', {_R("audio_hours", 2)} FROM daily"""))
def chart_series(spark, sf):
    return reports.chart_series(_daily(spark, sf))


@query("usage_rollup", with_views("user_event job_metric", LIFETIME + ROLLING + " SELECT life.user_id, life.created, life.existing, life.audio_hours, roll.created_7d, roll.succeeded_30d, roll.cost_usd_30d FROM life JOIN roll USING (user_id)"))
def usage_rollup(spark, sf):
    """Lifetimes and windows side by side, as the nightly job writes them."""
    life = _life(spark, sf).select("user_id", "created", "existing", "audio_hours")
    return life.join(_roll(spark, sf).select("user_id", "created_7d", "succeeded_30d", "cost_usd_30d"), "user_id")


_DONE = "CASE WHEN event_type = 'processing_completed' THEN {} END"


@query("usage_levels", with_views("user_event", f"""SELECT CASE WHEN grouping(user_id) = 0 THEN 'user' WHEN grouping(date) = 0 THEN 'day' ELSE 'all' END AS level, user_id, date, count(*) FILTER (event_type = 'conversation_created') AS created, count(*) FILTER (event_type = 'conversation_deleted') AS deleted,
count(*) FILTER (event_type = 'processing_completed') AS succeeded, count(*) FILTER (event_type = 'processing_failed') AS failed, {_R(_SUM(_DONE.format("(" + _NUM("durationMs") + ") / 3600000.0::DOUBLE")), 3)} AS audio_hours, {_R(_SUM(_DONE.format(_NUM("estimatedCostUsd"))), 6)} AS cost_usd,
min("timestamp") AS first_activity_at, max("timestamp") AS last_activity_at FROM (SELECT user_id, strftime("timestamp", '%Y-%m-%d') AS date, event_type, metadata, "timestamp" FROM user_event WHERE user_id IS NOT NULL) GROUP BY GROUPING SETS ((user_id), (date), ())"""))  # fmt: skip
def usage_levels(spark, sf):
    """Users, days and all in one pass, as the nightly job needs them."""
    return usage.usage_levels(fx.user_events(spark, sf)).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query("billing_breakdown", with_views("job_metric pricing", COSTS + f""", u AS (SELECT user_id, count(*) AS jobs, sum(tokens_usd::DECIMAL(18,6))::DOUBLE AS t, sum(recogniser_usd::DECIMAL(18,6))::DOUBLE AS r, sum(diariser_usd::DECIMAL(18,6))::DOUBLE AS d FROM cost GROUP BY user_id),
v AS (SELECT user_id, jobs, 'tokens' AS service, t AS cost_usd, t + r + d AS total FROM u UNION ALL SELECT user_id, jobs, 'recogniser', r, t + r + d FROM u UNION ALL SELECT user_id, jobs, 'diariser', d, t + r + d FROM u),
w AS (SELECT user_id, jobs, service, cost_usd, {_R("100 * cost_usd / total", 1)} AS percent FROM v WHERE cost_usd > 0) SELECT *, CASE WHEN percent >= 5 THEN service ELSE '' END AS label FROM w"""))  # fmt: skip
def billing_breakdown(spark, sf):
    """From the price of each job's time to each user's bill by service."""
    return pricing.user_breakdown(job_cost(spark, sf))


@query("token_summary", with_views("job_metric", f"""SELECT {_R("(i + o) / 1000000.0::DOUBLE", 2)} AS tokens_m, {_R("i / 1000000.0::DOUBLE", 2)} AS input_m, {_R("o / 1000000.0::DOUBLE", 2)} AS output_m
FROM (SELECT sum(coalesce(analysis_in, 0) + coalesce(correction_in, 0)) AS i, sum(coalesce(analysis_out, 0) + coalesce(correction_out, 0)) AS o FROM job_metric)"""))  # fmt: skip
def token_summary(spark, sf):
    """Tokens of all jobs, in millions."""
    return usage.token_millions(usage.global_stats(fx.user_events(spark, sf).limit(0).transform(usage.user_lifetime), fx.job_metrics(spark, sf), AS_OF, None))


_BYTES = "CASE conversation_id % 4 WHEN 0 THEN duration_ms % 1024 WHEN 1 THEN duration_ms WHEN 2 THEN duration_ms * 100 ELSE duration_ms * 3000 END"


@query("recording_labels", with_views("conversation", f"""SELECT conversation_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f', {_R("b / 1024.0::DOUBLE", 1)}) || ' KB' WHEN b < 1073741824 THEN printf('%.1f', {_R("b / 1048576.0::DOUBLE", 1)}) || ' MB' ELSE printf('%.2f', {_R("b / 1073741824.0::DOUBLE", 2)}) || ' GB' END AS size,
regexp_replace(title, '\\.[^./]+$', '') AS title, CASE status WHEN 'complete' THEN 'Aligned' WHEN 'needs_review' THEN 'Fallback' ELSE '-' END AS badge,
CASE WHEN conversation_id % 3 = 0 THEN '' ELSE CASE WHEN r > 1 THEN '+' ELSE '' END || printf('%.1f', {_R("(r - 1) * 100", 1)}) || '%' END AS drift
FROM (SELECT *, {_BYTES} AS b, (90 + conversation_id % 21) / 100.0::DOUBLE AS r FROM conversation)"""))  # fmt: skip
def recording_labels(spark, sf):
    """Size, title, badge and drift as lists of recordings show them."""
    c = F.col("conversation_id")
    status = F.when(F.col("status") == "complete", "aligned").when(F.col("status") == "needs_review", "fallback")
    rows = fx.conversations(spark, sf).select("conversation_id", F.expr(_BYTES).alias("bytes"), F.col("title").alias("file_name"), status.alias("alignment_status"), (c % 3).alias("drift_ms"), ((90 + c % 21) / 100.0).alias("drift_ratio"))
    return reports.recording_labels(rows)
