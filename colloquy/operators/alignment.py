"""Aligning transcript segments to word timings.

Candidate spans are all those of a band of positions around a segment's expected place. Good spans of short
segments are chained to anchors, the others are looked for between those, and what is still open is interpolated and repaired.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numbers import round_half_up
from ..functions.text import normal, with_span_score
from ..sources.shared import fresh_path
from . import folds, spans

#: Thresholds of the score, fixed values: an anchor, a match at all, and one that is taken at once.
ANCHOR, MATCH, SURE = 0.75, 0.40, 0.95
#: Fixed values of the anchor search: words of an anchor, segments looked for everywhere, time to either side of the others.
ANCHOR_WORDS, GLOBAL, WINDOW_MS = (2, 20), 5, 30_000


def _conv():
    """The window over a conversation in order."""
    return W.partitionBy("conversation_id").orderBy("segment_index")


def valid_words(words: DataFrame) -> DataFrame:
    return words.filter((F.col("end_s") > F.col("start_s")) & (F.col("end_s") > 0))


def word_duration_stats(words: DataFrame) -> DataFrame:
    """Mean, least and greatest word duration in ms, and a histogram of five bins."""
    ms = round_half_up((F.col("end_s") - F.col("start_s")) * 1000)
    w = words.select("conversation_id", ms.alias("ms"))
    edges = [("lt_100", None, 100), ("lt_300", 100, 300), ("lt_600", 300, 600), ("lt_1000", 600, 1000), ("more", 1000, None)]
    bins = [F.count_if((F.lit(True) if a is None else F.col("ms") >= a) & (F.lit(True) if b is None else F.col("ms") < b)).alias(n) for n, a, b in edges]
    return w.groupBy("conversation_id").agg(round_half_up(F.avg("ms"), 3).alias("mean_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"), *bins)


def in_band(hints: DataFrame) -> DataFrame:
    """Adds the band of a segment's starts: from 5 words before to 3n + 50 after its expected first word."""
    return hints.withColumns({"first": F.greatest(F.col("expected") - 5, F.lit(0)), "last": F.col("expected") + 3 * F.col("n_words") + 50, "stop": F.lit(None).cast("long")})


def span_candidates(hints: DataFrame, words: DataFrame) -> DataFrame:
    """(conversation, segment, n, start word, size) of every span that may be a segment's, whatever its length."""
    total = words.groupBy("conversation_id").agg(F.count("*").alias("total"))
    h = in_band(hints).filter("n_words > 0").join(total, "conversation_id").withColumn("last", F.least("last", F.col("total") - 1)).filter("first <= last")
    n = F.col("n_words").cast("long").alias("n")
    rows = h.select("conversation_id", "segment_index", n, "total", F.explode(F.sequence(F.col("first").cast("long"), F.col("last").cast("long"))).alias("start"))
    rows = rows.select("*", F.explode(spans.size_column(F.col("n"))).alias("size")).filter("size > 0 AND start + size <= total")
    return rows.select("conversation_id", "segment_index", "n", "start", "size")


def scored(candidates: DataFrame, hints: DataFrame, words: DataFrame) -> DataFrame:
    """Adds the score of each given span, natively; :func:`spans.search` finds the best without scoring all."""
    said = words.groupBy("conversation_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("word_index", "word"))), lambda x: x["word"]).alias("said"))
    text = hints.select("conversation_id", "segment_index", normal(F.col("text")).alias("wanted"))
    j = candidates.join(text, ["conversation_id", "segment_index"]).join(said, "conversation_id").filter(F.col("start") + F.col("size") <= F.size("said"))
    span = normal(F.array_join(F.slice("said", (F.col("start") + 1).cast("int"), F.col("size").cast("int")), " "))
    tasks = int(hints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    j = j.select("conversation_id", "segment_index", "n", "start", "size", "wanted", span.alias("span")).repartition(tasks, "conversation_id", "segment_index", "start", "size")
    return with_span_score(j, "wanted", "span", "score").select("conversation_id", "segment_index", "n", "start", "size", round_half_up(F.col("score"), 6).alias("score"))


def best_match(found: DataFrame, least: float = MATCH) -> DataFrame:
    """The highest score of each segment; of near-perfect ones the first in (size, start)."""
    sure = F.col("score") >= SURE
    order = F.struct(~sure, F.when(sure, 0.0).otherwise(-F.col("score")), "size", "start")
    top = found.filter(F.col("score") >= least).groupBy("conversation_id", "segment_index").agg(F.min_by(F.struct("n", "start", "size", "score"), order).alias("b"))
    return top.select("conversation_id", "segment_index", "b.*")


def matches_in(banded: DataFrame, said: DataFrame) -> DataFrame:
    """The best span of each segment in its band (``first``, ``last``, ``stop``), if it is a match at all; ``said`` are blocks of words."""
    return best_match(spans.search(banded, said, MATCH, SURE))


def word_at(times: DataFrame, words: DataFrame) -> DataFrame:
    """Adds ``word``, the one before the first that starts at ``at_s`` or later (the first word at least, the last at most), to rows with a conversation.

    Words and times of a conversation are sorted together; a running count gives each time its word.
    """
    w = words.select("conversation_id", F.col("start_s").alias("at_s"), F.lit(1).alias("_w"), F.lit(None).alias("_row"))
    t = times.select("conversation_id", "at_s", F.lit(0).alias("_w"), F.struct(*times.columns).alias("_row"))
    both = t.unionByName(w.withColumn("_row", F.lit(None).cast(t.schema["_row"].dataType)))
    by = W.partitionBy("conversation_id").orderBy("at_s", "_w")
    whole = W.partitionBy("conversation_id")
    before, total = F.sum("_w").over(by.rowsBetween(W.unboundedPreceding, -1)), F.sum("_w").over(whole)
    counted = both.select("_row", F.coalesce(before, F.lit(0)).alias("_n"), total.alias("_total")).filter("_row IS NOT NULL")
    place = F.when(F.col("_n") < F.col("_total"), F.greatest(F.col("_n") - 1, F.lit(0))).otherwise(F.greatest(F.col("_total") - 1, F.lit(0)))
    return counted.select("_row.*", place.cast("long").alias("word"), F.col("_total").cast("long").alias("total"))


def anchor_ranges(hints: DataFrame, words: DataFrame, everywhere: bool = False) -> DataFrame:
    """Where anchors are looked for: all words for the first segments, else 30 s to either side of the hint's times.

    A range of fewer than n + 10 words is widened to n + 20. Only segments of 2 to 20 words are anchors.
    """
    h = hints.filter(F.col("n_words").between(*ANCHOR_WORDS)).select("conversation_id", "segment_index", "text", F.col("n_words").cast("long").alias("n_words"), "start_ms", "end_ms")
    ends = F.array(F.struct(F.lit(0).alias("side"), (F.greatest(F.col("start_ms") - WINDOW_MS, F.lit(0)) / 1000.0).alias("at_s")), F.struct(F.lit(1).alias("side"), ((F.col("end_ms") + WINDOW_MS) / 1000.0).alias("at_s")))
    times = word_at(h.select("conversation_id", "segment_index", F.inline(ends)), words)
    found = times.groupBy("conversation_id", "segment_index").agg(F.max(F.when(F.col("side") == 0, F.col("word"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("word"))).alias("b"), F.max("total").alias("total"))
    j = h.join(found, ["conversation_id", "segment_index"])
    whole = F.lit(everywhere) | (F.col("segment_index") < GLOBAL)
    first = F.when(whole, F.lit(0)).otherwise(F.col("a")).cast("long")
    stop = F.when(whole, F.col("total")).when(F.col("b") - F.col("a") < F.col("n_words") + 10, F.least("total", F.col("a") + F.col("n_words") + 20)).otherwise(F.col("b")).cast("long")
    return j.withColumns({"first": first, "stop": stop}).withColumn("last", F.col("stop") - 1).select("conversation_id", "segment_index", "text", "n_words", "first", "last", "stop")


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def blocks(words: DataFrame) -> DataFrame:
    """Blocks of words, stored: searches read them again."""
    return _kept(spans.blocks(words), "blocks")


def anchor_spans(hints: DataFrame, words: DataFrame, said: DataFrame) -> DataFrame:
    """Every span good enough for an anchor; of conversations without one in the ranges, from all of their words."""
    near = _kept(spans.search(anchor_ranges(hints, words), said, ANCHOR), "anchors")
    none = hints.join(near.select("conversation_id").distinct(), "conversation_id", "left_anti")
    return near.unionByName(spans.search(anchor_ranges(none, words, everywhere=True), said, ANCHOR))


def heaviest(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Of (conversation, segment, start, size, score) in order the chain of greatest score in total: one span a segment, each after the last one's end.

    A frontier holds, for chains so far, the ends at which a greater total is reached, so that the best chain that
    ends before a span is found by bisection. Equal totals: the chain that ends first, then the earlier span.
    """
    taken, total, parent = [], [], []
    ends, best, at = [], [], []
    waiting: list[int] = []

    def settle() -> None:
        # spans of one segment do not follow each other, so they join the frontier together
        for k in waiting:
            end, w = taken[k][2] + taken[k][3], total[k]
            i = bisect_right(ends, end)
            if i and best[i - 1] >= w:
                continue
            i = bisect_left(ends, end)
            j = i
            while j < len(ends) and best[j] <= w:
                j += 1
            ends[i:j], best[i:j], at[i:j] = [end], [w], [k]
        waiting.clear()

    for row in rows:
        if taken and row[1] != taken[-1][1]:
            settle()
        i = bisect_right(ends, row[2]) - 1
        taken.append(row)
        # totals are exact: scores have six places
        total.append(round(row[4] * 1e6) + (best[i] if i >= 0 else 0))
        parent.append(at[i] if i >= 0 else -1)
        waiting.append(len(taken) - 1)
    settle()
    k, chain = at[-1] if at else -1, []
    while k >= 0:
        chain.append(taken[k])
        k = parent[k]
    yield from reversed(chain)


def anchor_selection(found: DataFrame) -> DataFrame:
    """The heaviest chain of spans of each conversation, in place of the first good one of each segment in turn."""
    kinds = ", ".join(f"{c} {found.schema[c].dataType.simpleString()}" for c in ("conversation_id", "segment_index"))
    return folds.in_order(found.select("conversation_id", "segment_index", "start", "size", "score"), "conversation_id", ["segment_index", "start", "size"], heaviest, f"{kinds}, {spans.FOUND}")


def alignment_regions(segments: DataFrame) -> DataFrame:
    """Numbers the runs of segments between anchors and gives them the word range between those.

    In: is_anchor, word_start, word_end (of anchors) and n_total (words of the conversation).
    """
    before = _conv().rowsBetween(W.unboundedPreceding, -1)
    after = _conv().rowsBetween(1, W.unboundedFollowing)
    a = F.when(F.col("is_anchor"), F.col("word_end"))
    b = F.when(F.col("is_anchor"), F.col("word_start"))
    rows = segments.select("conversation_id", "segment_index", "is_anchor", "n_total", F.sum(F.col("is_anchor").cast("long")).over(_conv()).alias("region_id"), F.last(a, True).over(before).alias("_a"), F.first(b, True).over(after).alias("_b"))
    return rows.filter(~F.col("is_anchor")).select("conversation_id", "segment_index", "region_id", F.coalesce("_a", F.lit(0)).cast("long").alias("from_word"), F.coalesce("_b", "n_total").cast("long").alias("to_word"))


def proportional_interpolation(rows: DataFrame) -> DataFrame:
    """Times by cumulative share of words in the region; an even split without words; at least 50 ms."""
    by = W.partitionBy("conversation_id", "region_id").orderBy("segment_index")
    whole = W.partitionBy("conversation_id", "region_id")
    total, before = F.sum("n_words").over(whole), F.coalesce(F.sum("n_words").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    count, place = F.count("*").over(whole), F.row_number().over(by) - 1
    share = lambda up: F.when(F.col("_t") > 0, (F.col("_w") + (F.col("n_words") if up else 0)) / F.nullif(F.col("_t"), F.lit(0)).cast("double")).otherwise((F.col("_p") + (1 if up else 0)) / F.col("_c").cast("double"))
    r = rows.select("*", total.alias("_t"), before.alias("_w"), count.alias("_c"), place.alias("_p"))
    at = lambda s: F.col("region_start") + F.floor(s * (F.col("region_end") - F.col("region_start"))).cast("long")
    end = F.least(at(share(True)), F.col("region_end"))
    return r.select("conversation_id", "segment_index", "region_id", F.least(at(share(False)), end - 50).alias("start_ms"), end.alias("end_ms"))


def _repaired(rows: Iterable[tuple]) -> Iterator[tuple]:
    end, first = 0, True
    for conversation, segment, a, b, n, confidence, method in rows:
        if a < end - 2000:
            a, b, confidence, method = end, end + b - a, confidence * 0.9, f"{method}_fixed"
        if not 20 <= (b - a) / float(max(n, 1)) <= 800:
            a = a if first else end + 50
            b, confidence, method = a + 150 * n, 0.3, "duration_fallback"
        yield conversation, segment, a, b, confidence, method
        end, first = b, False


def monotonic_repair(rows: DataFrame) -> DataFrame:
    """Left to right: what starts over 2 s before the last end is moved there; an impossible pace gets 150 ms a word."""
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("conversation_id", "segment_index"))
    ordered = rows.select("conversation_id", "segment_index", F.col("start_ms").cast("long"), F.col("end_ms").cast("long"), F.col("n_words").cast("long"), F.col("confidence").cast("double"), "method")
    return folds.in_order(ordered, "conversation_id", ["segment_index"], _repaired, f"{kinds}, start_ms long, end_ms long, confidence double, method string")


def _once(method: Column, tail: str) -> Column:
    return F.when(method.contains(tail), method).otherwise(F.concat(method, F.lit(tail)))


def overlap_clip(rows: DataFrame) -> DataFrame:
    """An end over 2 s past the next start is clipped to 100 ms before it."""
    nxt = F.lead("start_ms").over(_conv())
    clip = F.coalesce(F.col("end_ms") > nxt + 2000, F.lit(False))
    return rows.select("conversation_id", "segment_index", "start_ms", F.when(clip, F.greatest(F.col("start_ms") + 100, nxt - 100)).otherwise(F.col("end_ms")).alias("end_ms"), F.when(clip, F.col("confidence") * 0.9).otherwise(F.col("confidence")).alias("confidence"), F.when(clip, _once(F.col("method"), "_clipped")).otherwise(F.col("method")).alias("method"))


def overflow_scale(rows: DataFrame) -> DataFrame:
    """If the last end lies past the recording, all times shrink to it. In: audio_ms."""
    last = F.last("end_ms").over(_conv().rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    r = rows.withColumn("_k", F.when(last > F.col("audio_ms"), F.col("audio_ms") / last.cast("double")))
    at = lambda c: F.when(F.col("_k").isNotNull(), F.floor(F.col(c) * F.col("_k")).cast("long")).otherwise(F.col(c))
    over = F.col("_k").isNotNull()
    return r.select("conversation_id", "segment_index", at("start_ms").alias("start_ms"), F.when(over, F.least(at("end_ms"), F.col("audio_ms"))).otherwise(F.col("end_ms")).alias("end_ms"), F.when(over, F.col("confidence") * 0.8).otherwise(F.col("confidence")).alias("confidence"), F.when(over, _once(F.col("method"), "_scaled")).otherwise(F.col("method")).alias("method"))


def alignment_status(original: DataFrame, aligned: DataFrame) -> DataFrame:
    """The aligned times, or the original ones with confidence 0 where a conversation has none."""
    a = aligned.select("conversation_id", "segment_index", F.col("start_ms").alias("_a"), F.col("end_ms").alias("_b"), F.col("confidence").alias("_c"), F.col("method").alias("_m"))
    j = original.join(a, ["conversation_id", "segment_index"], "left")
    got = F.count("_a").over(W.partitionBy("conversation_id"))
    return j.select("conversation_id", "segment_index", F.coalesce("_a", "start_ms").alias("start_ms"), F.coalesce("_b", "end_ms").alias("end_ms"), F.coalesce("_c", F.lit(0.0)).alias("confidence"), F.coalesce("_m", F.lit("original")).alias("method"), F.when(got > 0, "aligned").otherwise("fallback").alias("status"))


def alignment_quality(rows: DataFrame) -> DataFrame:
    c = F.col("confidence")
    matched = F.count_if(F.col("method").startswith("match"))
    return rows.groupBy("conversation_id").agg(round_half_up(F.avg(c.cast("decimal(18,6)")).cast("double"), 3).alias("mean"), F.min(c).alias("least"), F.max(c).alias("greatest"), F.count_if(c >= 0.75).alias("high"), F.count_if((c >= 0.5) & (c < 0.75)).alias("medium"), F.count_if(c < 0.5).alias("low"), matched.alias("matched"), round_half_up(100.0 * matched / F.count("*"), 1).alias("percent"))


def quality_levels(rows: DataFrame) -> DataFrame:
    """Confidence and counts of conversations, of their regions and of their methods, from one scan; in: region_id."""
    c, matched = F.col("confidence"), F.count_if(F.col("method").startswith("match"))
    # counted by method and grouped by it: a grouping column is null in the sets without it
    rows = rows.withColumn("_by", F.col("method"))
    sets = rows.groupingSets([["conversation_id"], ["conversation_id", "region_id"], ["conversation_id", "_by"]], "conversation_id", "region_id", "_by")
    out = sets.agg(F.grouping_id().alias("_level"), F.count("*").alias("segments"), round_half_up(F.avg(c.cast("decimal(18,6)")).cast("double"), 3).alias("mean"), F.min(c).alias("least"), F.max(c).alias("greatest"), F.count_if(c >= 0.75).alias("high"), F.count_if((c >= 0.5) & (c < 0.75)).alias("medium"), F.count_if(c < 0.5).alias("low"), matched.alias("matched"), round_half_up(100.0 * matched / F.count("*"), 1).alias("percent"))
    level = F.when(F.col("_level") == 3, "conversation").when(F.col("_level") == 1, "region").otherwise("method")
    return out.select(level.alias("level"), "conversation_id", "region_id", F.col("_by").alias("method"), *[x for x in out.columns if x not in ("conversation_id", "region_id", "_by", "_level")])


def anchor_stats(rows: DataFrame) -> DataFrame:
    """In: n_words, score (null if no span was found) of every segment."""
    n = F.col("n_words")
    fits = n.between(2, 20)
    anchor = fits & (F.col("score") >= ANCHOR)
    place = F.col("segment_index") / F.nullif(F.max("segment_index").over(W.partitionBy("conversation_id")), F.lit(0)).cast("double")
    r = rows.withColumn("_a", F.coalesce(anchor, F.lit(False))).withColumn("_p", F.coalesce(place, F.lit(0.0)))
    k = F.count_if("_a")
    return r.groupBy("conversation_id").agg(
        k.alias("anchors"), round_half_up(100.0 * k / F.count("*"), 1).alias("rate"), F.count_if(n < 2).alias("too_short"), F.count_if(n > 20).alias("too_long"), F.count_if(fits & F.col("score").isNull()).alias("no_match"),
        F.count_if(fits & (F.col("score") < ANCHOR)).alias("low_score"), F.coalesce(F.max(F.when(F.col("_a"), F.col("_p"))) <= 0.3, F.lit(False)).alias("clustered"),
        round_half_up(F.coalesce(100.0 * (F.max(F.when(F.col("_a"), F.col("segment_index"))) - F.min(F.when(F.col("_a"), F.col("segment_index")))) / F.count("*"), F.lit(0.0)), 1).alias("coverage"),
        round_half_up(F.avg(F.when(F.col("_a"), F.col("score")).cast("decimal(18,6)")).cast("double"), 3).alias("mean_confidence"),
    )


def region_bands(hints: DataFrame, anchors: DataFrame, total: DataFrame) -> DataFrame:
    """Where segments between anchors are looked for: a band of 3n + 60 words about the place that their share of the region's words gives, within the region."""
    a = anchors.select("conversation_id", "segment_index", F.col("start").alias("word_start"), (F.col("start") + F.col("size")).alias("word_end"))
    h = hints.join(a, ["conversation_id", "segment_index"], "left").join(total, "conversation_id").withColumn("is_anchor", F.col("word_start").isNotNull())
    text = hints.select("conversation_id", "segment_index", "text", F.col("n_words").cast("long").alias("n_words"))
    r = alignment_regions(h).join(text, ["conversation_id", "segment_index"])
    whole = W.partitionBy("conversation_id", "region_id")
    by = whole.orderBy("segment_index").rowsBetween(W.unboundedPreceding, -1)
    share = F.coalesce(F.sum("n_words").over(by), F.lit(0)) / F.greatest(F.sum("n_words").over(whole), F.lit(1)).cast("double")
    place = F.col("from_word") + F.floor(share * (F.col("to_word") - F.col("from_word"))).cast("long")
    margin = (F.floor(1.5 * F.col("n_words")) + 30).cast("long")
    r = r.withColumn("_at", place)
    return r.withColumns({"first": F.greatest("from_word", F.col("_at") - margin), "last": F.least(F.col("to_word") - 1, F.col("_at") + margin), "stop": F.col("to_word")}).drop("_at")


def aligned_transcripts(hints: DataFrame, words: DataFrame) -> DataFrame:
    """The whole chain: anchors, a search between them, interpolation of the rest, repairs.

    In: hints (conversation_id, segment_index, text, start_ms, end_ms, n_words), words. Matches between
    anchors that are out of order give way to the heaviest chain. What is still unmatched lies between its
    neighbours' words in proportion to its own.
    """
    # both are read by every step of the chain
    hints, words = _kept(hints, "hints"), _kept(words, "words")
    good, said = valid_words(words), blocks(words)
    total = words.groupBy("conversation_id").agg(F.count("*").alias("n_total"), F.max("end_s").alias("audio_s"))
    anchors = _kept(anchor_selection(anchor_spans(hints, words, said)), "chain")
    between = matches_in(region_bands(hints, anchors, total), said).drop("n")
    one = _kept(anchor_selection(anchors.unionByName(between)), "matches").select("conversation_id", "segment_index", F.struct("start", "size", "score").alias("m"))
    times = lambda p: good.select(F.col("conversation_id").alias(f"{p}_c"), F.col("word_index").alias(f"{p}_w"), F.col("start_s").alias(f"{p}_s"), F.col("end_s").alias(f"{p}_e"))
    h = hints.join(one, ["conversation_id", "segment_index"], "left").join(total, "conversation_id")
    h = h.withColumns({"is_anchor": F.col("m").isNotNull(), "word_start": F.col("m.start"), "word_end": F.col("m.start") + F.col("m.size")})
    regions = alignment_regions(h)
    ms = lambda s: F.floor(s * 1000).cast("long")
    open_ = h.filter("not is_anchor").drop("m", "word_start", "word_end").join(regions, ["conversation_id", "segment_index"])
    # words come every so often; a region's bounds are the times of its first and last word
    a, b = times("a"), times("b")
    open_ = open_.join(a, (F.col("conversation_id") == F.col("a_c")) & (F.col("from_word") == F.col("a_w")), "left")
    open_ = open_.join(b, (F.col("conversation_id") == F.col("b_c")) & (F.col("to_word") - 1 == F.col("b_w")), "left")
    open_ = open_.withColumn("region_start", F.coalesce(ms(F.col("a_s")), ms(F.col("from_word") * F.col("audio_s") / F.col("n_total")))).withColumn("region_end", F.greatest(F.coalesce(ms(F.col("b_e")), ms(F.col("to_word") * F.col("audio_s") / F.col("n_total"))), F.col("region_start") + 50))
    filled = proportional_interpolation(open_).select("conversation_id", "segment_index", "start_ms", "end_ms").withColumns({"confidence": F.lit(0.5), "method": F.lit("interpolated")})
    hit = h.filter("is_anchor")
    hit = hit.join(a, (F.col("conversation_id") == F.col("a_c")) & (F.col("word_start") == F.col("a_w")), "left")
    hit = hit.join(b, (F.col("conversation_id") == F.col("b_c")) & (F.col("word_end") - 1 == F.col("b_w")), "left")
    hit = hit.select("conversation_id", "segment_index", F.coalesce(ms(F.col("a_s")), ms(F.col("word_start") * F.col("audio_s") / F.col("n_total"))).alias("start_ms"), F.coalesce(ms(F.col("b_e")), ms(F.col("word_end") * F.col("audio_s") / F.col("n_total"))).alias("end_ms"), F.col("m.score").alias("confidence"), F.lit("match").alias("method"))
    rows = hit.unionByName(filled).join(hints.select("conversation_id", "segment_index", F.col("n_words").cast("long").alias("n_words")), ["conversation_id", "segment_index"])
    fixed = overlap_clip(monotonic_repair(rows)).join(total.select("conversation_id", ms(F.col("audio_s")).alias("audio_ms")), "conversation_id")
    return alignment_status(hints, overflow_scale(fixed))


def aligned_quality(aligned: DataFrame) -> DataFrame:
    """Quality of aligned rows by conversation, method and region; a region begins with each match."""
    region = F.sum(F.col("method").startswith("match").cast("long")).over(_conv())
    return quality_levels(aligned.withColumn("region_id", region))
