"""Versioned prices: as-of lookup, job cost, breakdown, history and validity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numbers import round_half_up
from .ranges import last_before

#: Prices where none is known, per million tokens and per second.
DEFAULTS = {"input_price": 0.075, "output_price": 0.30, "recogniser": 0.0023, "diariser": 0.0015}


PRICE = ["pricing_id", "input_price", "output_price", "second_price"]


def prices_asof(probes: DataFrame, prices: DataFrame, models: dict[str, str]) -> DataFrame:
    """Adds, under the prefix that ``models`` gives each model, the price valid at each probe's timestamp.

    The latest price that began by then counts, of equal times the greatest id; if it has expired the price is null,
    without going back to older ones. All models are looked up in one pass over the probes in order of time.
    """
    wanted = prices.filter(F.col("model").isin(list(models)))
    one = wanted.groupBy("model", "effective_from").agg(F.max_by(F.struct("pricing_id", "input_price", "output_price", "second_price", "effective_until"), "pricing_id").alias("p")).select("model", "effective_from", "p.*")
    out = last_before(probes, one, "timestamp", "effective_from", {f"_{prefix}": F.col("model") == model for model, prefix in models.items()})
    valid = lambda p: F.col(f"_{p}.effective_until").isNull() | (F.col(f"_{p}.effective_until") > F.col("timestamp"))
    return out.select(*probes.columns, *[F.when(valid(p), F.col(f"_{p}.{c}")).alias(f"{p}_{c}") for p in models.values() for c in PRICE])


def price_asof(probes: DataFrame, prices: DataFrame, model: str, prefix: str) -> DataFrame:
    return prices_asof(probes, prices, {model: prefix})


def job_cost(jobs: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of each job by the prices of its own time, the total from unrounded parts."""
    j = prices_asof(jobs, prices, {"tokens-a": "tok", "recogniser": "rec"})
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    per = lambda c, d: F.coalesce(F.col(c), F.lit(DEFAULTS[d]))
    tokens = ((zero("analysis_in") + zero("correction_in")) * per("tok_input_price", "input_price") + (zero("analysis_out") + zero("correction_out")) * per("tok_output_price", "output_price")) / 1e6
    rec, dia = zero("compute_s") * per("rec_second_price", "recogniser"), zero("diarisation_s") * F.lit(DEFAULTS["diariser"])
    parts = j.select("conversation_id", "user_id", "timestamp", tokens.alias("t"), rec.alias("r"), dia.alias("d"))
    return parts.select("conversation_id", "user_id", "timestamp", round_half_up(F.col("t"), 6).alias("tokens_usd"), round_half_up(F.col("r"), 6).alias("recogniser_usd"), round_half_up(F.col("d"), 6).alias("diariser_usd"), round_half_up(F.col("t") + F.col("r") + F.col("d"), 6).alias("total_usd"))


def cost_breakdown(costs: DataFrame) -> DataFrame:
    """A row for each service that cost something, with its share; small shares carry no label."""
    sums = costs.agg(*[F.sum(F.col(f"{s}_usd").cast("decimal(18,6)")).cast("double").alias(s) for s in ("tokens", "recogniser", "diariser")])
    rows = sums.unpivot([], ["tokens", "recogniser", "diariser"], "service", "cost_usd").filter("cost_usd > 0")
    # three rows at most stand in this window
    share = round_half_up(100 * F.col("cost_usd") / F.sum("cost_usd").over(W.partitionBy(F.lit(0)).orderBy("service").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), 1)
    rows = rows.withColumn("percent", share)
    return rows.withColumn("label", F.when(F.col("percent") >= 5, F.col("service")).otherwise(F.lit("")))


def user_breakdown(costs: DataFrame) -> DataFrame:
    """What each user's jobs cost by service, with the service's share of the user's total; small shares carry no label."""
    sums = costs.groupBy("user_id").agg(F.count("*").alias("jobs"), *[F.sum(F.col(f"{s}_usd").cast("decimal(18,6)")).cast("double").alias(s) for s in ("tokens", "recogniser", "diariser")])
    rows = sums.withColumn("_total", F.col("tokens") + F.col("recogniser") + F.col("diariser")).unpivot(["user_id", "jobs", "_total"], ["tokens", "recogniser", "diariser"], "service", "cost_usd").filter("cost_usd > 0")
    rows = rows.withColumn("percent", round_half_up(100 * F.col("cost_usd") / F.col("_total"), 1)).drop("_total")
    return rows.withColumn("label", F.when(F.col("percent") >= 5, F.col("service")).otherwise(F.lit("")))


def pricing_history(prices: DataFrame) -> DataFrame:
    """Prices by model, newest first; the newest is flagged current even if it lies in the future."""
    n = F.row_number().over(W.partitionBy("model").orderBy(F.desc("effective_from"), F.desc("pricing_id")))
    return prices.select("model", "pricing_id", "effective_from", n.cast("long").alias("position"), (n == 1).alias("is_current"))


def pricing_validity(prices: DataFrame) -> DataFrame:
    """The first rule that a price breaks, or null."""
    error = (
        F.when(F.trim(F.coalesce("model", F.lit(""))) == "", "model")
        .when((F.col("service") == "tokens") & F.col("input_price").isNull() & F.col("output_price").isNull(), "token price")
        .when((F.col("service") == "time") & F.col("second_price").isNull(), "second price")
    )
    return prices.select("pricing_id", error.alias("error"))
