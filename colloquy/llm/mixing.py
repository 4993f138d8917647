"""Mixing sources to target weights, natively: hash-random order, distributed prefix sums, exact cuts.

Sources in order of code point (null last) weigh ``weights`` in turn and share all words. A target stops
at ``max_epochs`` times its source's words; what is over goes to the others by weight. A source whose
target is e whole passes and a rest takes every document e times, and of one more pass the documents in
hash-random order up to the rest, the last one cut at the exact word.

Nulls: a null text has no words and a null source is a source of its own. Empty table: no rows. Ties and
repeated rows: order by key, id, words; rows that tie in all three are interchangeable. Texts of any length
are counted whole. Rows without an id, or that share one, are rows of their own in the order of the one key
that their id gives. Other columns are ignored by :func:`mix` and carried along by :func:`apply_mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, range_bits, hash_key, partitions, prefix_sums, stored, word_count

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to targets. One row per source goes in: windows here see that small table only.

    Water-filling in closed form: in rising order of cap / weight, a source keeps its cap if the level
    reached with all earlier ones capped lies above its cap / weight.
    """
    order = W.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sources.select("source", "source_size", "rows", weigh.alias("w"), (F.col("source_size") * F.lit(float(max_epochs))).alias("cap"))
    fill = W.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    every = W.partitionBy(F.lit(0))
    levels = ranked.select(
        "*",
        F.sum("source_size").over(every).alias("total"),
        F.coalesce(F.sum("cap").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("capped"),
        F.sum("w").over(fill.rowsBetween(0, W.unboundedFollowing)).alias("open_w"),
    ).withColumn("level", (F.col("total") - F.col("capped")) / F.col("open_w"))
    # the first source that the level does not fill sets the level of all after it
    first = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(every)
    level = F.coalesce(first.getField("level"), F.lit(float("inf")))
    return levels.select("source", "source_size", "rows", F.least(F.col("cap"), level * F.col("w")).alias("target"))


def _planned(sized: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """Adds source_size, target, epochs (whole passes) and part (words of one more pass) to each sized row."""
    spark = sized.sparkSession
    sources = stored(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), weights, max_epochs).withColumnRenamed("source", "_source"), "targets")
    sized = sized.join(sources, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    bits = range_bits(F.col("rows"), sized.count(), partitions(spark))
    placed = prefix_sums(sized, ["source"], "key", ["doc_id", "size"], {"before": "size"}, bits)
    budget = F.floor(F.col("target") + F.lit(1e-6))
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - F.col("epochs") * F.col("source_size")
    return (
        placed.withColumn("epochs", whole)
        .withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before"))).cast("long"))
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 4) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes of the document), epochs, part."""
    sized = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).withColumn("key", hash_key(seed, F.col("doc_id"))), "sized")
    plan = _planned(sized, weights, max_epochs)
    return plan.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"), "epochs", "part")


def first_words(text: Column, n: Column) -> Column:
    """The first n words of a text, joined by one blank."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), n.cast("int")), " ")


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 4) -> DataFrame:
    """The mixed corpus itself, with the columns of ``docs``: each document as often as the mix takes it.

    A document of which a pass takes only some words stands once more with those words; one that is not
    taken at all goes. Rows are numbered in a stored copy, so repeated rows and ids stay apart.
    """
    names = docs.columns
    rows = stored(docs.select(F.struct(*names).alias("_row"), F.monotonically_increasing_id().alias("_id")), "mix-rows")
    sized = stored(rows.select(F.col("_id").alias("doc_id"), F.col("_row.source").alias("source"), word_count(F.col("_row.text")).alias("size"), hash_key(seed, F.col("_row.doc_id")).alias("key")), "sized")
    plan = _planned(sized, weights, max_epochs).filter("epochs > 0 or part > 0").select(F.col("doc_id").alias("_id"), "size", "epochs", "part")
    whole = F.expr("array_repeat(size, cast(epochs as int))")
    copies = F.when(F.col("part") > 0, F.concat(whole, F.array("part"))).otherwise(whole)
    out = rows.join(plan, "_id").select("_row", "size", F.explode(copies).alias("_words"))
    uncut = F.col("_words") == F.col("size")
    cols = {n: F.col("_row").getField(n) for n in names}
    cols["text"] = F.when(uncut, cols["text"]).otherwise(first_words(cols["text"], F.col("_words")))
    if "n_chars" in cols:
        cols["n_chars"] = F.when(uncut, cols["n_chars"]).otherwise(F.length(cols["text"])).cast(docs.schema["n_chars"].dataType)
    return out.select(*[c.alias(n) for n, c in cols.items()])
