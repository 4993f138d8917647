"""Transcript segments: building, repair, speakers, corrections, lookups and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numbers import round_half_up
from .ranges import points_in_intervals

#: Words that begin a sentence rather than end one.
STARTERS = "I You We They He She It The A An This That So But And Or If When What How Why Where Who".split()
_FRAGMENT = r"(?s)^(.+?[.!?])\s+([A-Z].*)"


def _conv():
    """The window over a conversation in order."""
    return W.partitionBy("conversation_id").orderBy("segment_index")


def asr_segments(raw: DataFrame) -> DataFrame:
    """Seconds to whole milliseconds, of decimals exactly; a missing speaker gets the first default id."""
    ms = lambda c: F.floor(F.coalesce(F.col(c), F.lit(0)) * 1000).cast("long")
    return raw.select("conversation_id", "segment_index", F.coalesce("speaker_id", F.lit("SPEAKER_00")).alias("speaker_id"), ms("start_s").alias("start_ms"), ms("end_s").alias("end_ms"), F.trim("text").alias("text"))


def boundary_repair(segments: DataFrame) -> DataFrame:
    """Moves a leading sentence fragment to the end of the previous speaker's segment.

    Each step reads fields that no other step changes, so neighbours in one window suffice.
    """
    t = F.trim("text")
    frag, rest = F.regexp_extract(t, _FRAGMENT, 1), F.regexp_extract(t, _FRAGMENT, 2)
    starts = frag.rlike(rf"(?i)^({'|'.join(STARTERS)})\s")
    moves = F.lag("speaker_id").over(_conv()).isNotNull() & (F.lag("speaker_id").over(_conv()) != F.col("speaker_id")) & (frag != "") & (F.length(frag) <= 80) & (F.length(rest) >= 20) & ~((F.length(frag) > 40) & starts)
    s = segments.select("*", moves.alias("_m"), frag.alias("_f"), rest.alias("_r"))
    cut = F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) * F.length("_f") / F.length("text")).cast("long")
    s = s.withColumn("_cut", F.when(F.col("_m"), cut))
    s = s.withColumns({"_next": F.lead(F.when(F.col("_m"), F.col("_f"))).over(_conv()), "_end": F.lead("_cut").over(_conv())})
    text = F.when(F.col("_m"), F.col("_r")).otherwise(F.col("text"))
    text = F.when(F.col("_next").isNotNull(), F.concat(F.rtrim(text), F.lit(" "), F.col("_next"))).otherwise(text)
    return s.select("conversation_id", "segment_index", "speaker_id", F.coalesce("_cut", "start_ms").alias("start_ms"), F.coalesce("_end", "end_ms").alias("end_ms"), text.alias("text"))


def speaker_numbering(segments: DataFrame) -> DataFrame:
    """Speakers of each conversation in order of id: Speaker 1..n, colour by rank modulo five; where none is known, one default speaker."""
    n = F.row_number().over(W.partitionBy("conversation_id").orderBy("speaker_id"))
    known = segments.groupBy("conversation_id").agg(F.collect_set("speaker_id").alias("_ids"))
    ids = known.select("conversation_id", F.explode(F.when(F.size("_ids") == 0, F.array(F.lit("SPEAKER_00"))).otherwise(F.col("_ids"))).alias("speaker_id"))
    return ids.select("conversation_id", "speaker_id", F.concat(F.lit("Speaker "), n.cast("string")).alias("display_name"), ((n - 1) % 5).cast("long").alias("color_index"))


def segment_speaker(segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """Each segment's speaker name and colour; an unknown speaker shows its id in colour 0."""
    named = speakers.select("conversation_id", "speaker_id", "display_name", "color_index")
    return segments.join(named, ["conversation_id", "speaker_id"], "left").select("conversation_id", "segment_index", "speaker_id", F.coalesce("display_name", "speaker_id").alias("display_name"), (F.coalesce("color_index", F.lit(0)) % 5).cast("long").alias("color_index"))


def speaker_naming(speakers: DataFrame, notes: DataFrame, people: DataFrame) -> DataFrame:
    """The inferred name, unless it is one of the people talked about; role or notes are added."""
    first = notes.withColumn("_n", F.row_number().over(W.partitionBy("speaker_id").orderBy("ordinal"))).filter("_n = 1").drop("_n", "ordinal")
    known = people.select(F.lower(F.trim("name")).alias("_known")).distinct()
    s = speakers.join(first, "speaker_id", "left").join(known, F.lower(F.trim("inferred_name")) == F.col("_known"), "left")
    name = F.when(F.col("inferred_name").isNotNull() & F.col("_known").isNull(), F.col("inferred_name")).otherwise(F.col("display_name"))
    tail = F.when(F.col("role").isNotNull(), F.concat(F.lit(" ("), F.col("role"), F.lit(")"))).when(F.col("inferred_name").isNull() & F.col("notes").isNotNull(), F.concat(F.lit(" ("), F.col("notes"), F.lit(")"))).otherwise(F.lit(""))
    return s.select("conversation_id", "speaker_id", F.concat(name, tail).alias("display_name"))


def apply_reassign(segments: DataFrame, corrections: DataFrame) -> DataFrame:
    """Later corrections override; those of unknown speakers or segments fall away."""
    known = segments.select("conversation_id", F.col("speaker_id").alias("new_speaker")).distinct()
    valid = corrections.join(known, ["conversation_id", "new_speaker"], "left_semi")
    last = valid.groupBy("conversation_id", "segment_index").agg(F.max_by("new_speaker", "ordinal").alias("new_speaker"))
    out = segments.join(last, ["conversation_id", "segment_index"], "left")
    return out.select("conversation_id", "segment_index", F.coalesce("new_speaker", "speaker_id").alias("speaker_id"), F.coalesce(F.col("new_speaker") != F.col("speaker_id"), F.lit(False)).alias("corrected"))


def apply_splits(segments: DataFrame, splits: DataFrame) -> DataFrame:
    """Splits segments at characters: trimmed texts, time by share of characters, all renumbered.

    Several splits of one segment are made in order of ``ordinal``, each in what stands before the last. The
    part before keeps its speaker unless ``speaker_before`` names one; ``speaker_after``, if missing, is the
    other of a conversation's two speakers. Splits outside the text, or after which nobody is known to speak,
    are skipped.
    """
    key = ["conversation_id", "segment_index"]
    per = splits.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("ordinal", F.col("split_at_char").cast("long").alias("at"), "speaker_before", "speaker_after"))).alias("splits"))
    speakers = segments.groupBy("conversation_id").agg(F.countDistinct("speaker_id").alias("n_speakers"), F.min("speaker_id").alias("one"), F.max("speaker_id").alias("two"))
    s = segments.join(per, key, "left").join(speakers, "conversation_id")
    part = lambda t, a, b, k: F.struct(t.alias("text"), a.alias("start_ms"), b.alias("end_ms"), k.alias("speaker_id"))
    none = F.expr("cast(array() as array<struct<text:string,start_ms:bigint,end_ms:bigint,speaker_id:string>>)")

    def cut(state: Column, x: Column) -> Column:
        head, text = state["head"], state["head"]["text"]
        speaker = F.coalesce(x["speaker_before"], head["speaker_id"])
        after = F.coalesce(x["speaker_after"], F.when(F.col("n_speakers") == 2, F.when(speaker == F.col("one"), F.col("two")).otherwise(F.col("one"))))
        at = x["at"].cast("int")
        left = F.trim(F.left(text, at))
        time = head["start_ms"] + F.floor((head["end_ms"] - head["start_ms"]) * (F.length(left) / F.length(text))).cast("long")
        ok = (at > 0) & (at < F.length(text)) & after.isNotNull()
        made = F.struct(part(left, head["start_ms"], time, speaker).alias("head"), F.concat(F.array(part(F.trim(F.substring(text, at + 1, F.length(text))), time, head["end_ms"], after)), state["rest"]).alias("rest"))
        return F.when(ok, made).otherwise(state)

    whole = F.struct(part(F.col("text"), F.col("start_ms"), F.col("end_ms"), F.col("speaker_id")).alias("head"), none.alias("rest"))
    done = s.withColumn("done", F.when(F.col("splits").isNull(), whole).otherwise(F.aggregate("splits", whole, cut)))
    rows = done.select("conversation_id", F.col("segment_index").alias("old_index"), F.posexplode(F.concat(F.array("done.head"), F.col("done.rest"))).alias("part", "p"))
    n = F.row_number().over(W.partitionBy("conversation_id").orderBy("old_index", "part")) - 1
    return rows.select("conversation_id", n.cast("long").alias("segment_index"), "p.speaker_id", "p.start_ms", "p.end_ms", "p.text")


def topic_markers(segments: DataFrame, topics: DataFrame) -> DataFrame:
    """The topic that starts at each segment; of several the first in list order."""
    first = topics.groupBy("conversation_id", F.col("start_index").alias("segment_index")).agg(F.min_by("topic_id", "ordinal").alias("topic_id"))
    return segments.join(first, ["conversation_id", "segment_index"], "left").select("conversation_id", "segment_index", "topic_id")


def active_segment(probes: DataFrame, segments: DataFrame) -> DataFrame:
    """For each probe time the segment that plays: containing it, the nearest start of several; in a gap, the last that ended; else -1.

    A gap lasts from a segment's end to the start of the next, so both rules ask in which interval a point lies;
    after the last segment's end there is but that one to look at.
    """
    key = ["conversation_id", "probe_id"]
    t = probes.select(*key, (F.col("position_ms") + F.col("offset_ms")).cast("long").alias("t"))
    s = segments.select("conversation_id", "segment_index", F.col("start_ms").cast("long").alias("a"), F.col("end_ms").cast("long").alias("b"), F.lead("start_ms").over(_conv()).cast("long").alias("next"))
    spans = s.select("conversation_id", "segment_index", F.inline(F.array(F.struct(F.lit(0).alias("kind"), F.col("a").alias("from"), F.col("b").alias("to")), F.struct(F.lit(1).alias("kind"), F.col("b").alias("from"), F.col("next").alias("to")))))
    hit = points_in_intervals(t, spans, ["conversation_id"], "t", "from", "to").filter("kind = 0 OR t > 0").select(*key, "kind", "segment_index", F.abs(F.col("from") - F.col("t")).alias("far"))
    last = s.filter("next IS NULL").select("conversation_id", "segment_index", "b")
    after = t.filter("t > 0").join(last, "conversation_id").filter("b <= t").select(*key, F.lit(1).alias("kind"), "segment_index", F.lit(0).cast("long").alias("far"))
    none = t.select(*key, F.lit(None).cast("int").alias("kind"), F.lit(None).cast(segments.schema["segment_index"].dataType).alias("segment_index"), F.lit(None).cast("long").alias("far"))
    inside, gap, i = F.col("kind") == 0, F.col("kind") == 1, F.col("segment_index")
    best = F.min_by(F.when(inside, i), F.when(inside, F.struct("far", "segment_index")))
    return none.unionByName(hit).unionByName(after).groupBy(*key).agg(F.coalesce(best, F.max(F.when(gap, i)), F.lit(-1)).cast("long").alias("segment_index"))


def speaker_distribution(segments: DataFrame) -> DataFrame:
    n = segments.groupBy("conversation_id", "speaker_id").agg(F.count("*").alias("segments"))
    return n.withColumn("percent", round_half_up(100.0 * F.col("segments") / F.sum("segments").over(W.partitionBy("conversation_id"))))


def conversation_summary(segments: DataFrame, topics: DataFrame, corrected: DataFrame, occurrences: DataFrame, mentions: DataFrame) -> DataFrame:
    """Counts by conversation, terms and people as they are found in it; its length is the end of the last segment in order."""
    s = segments.groupBy("conversation_id").agg(F.count("*").alias("segments"), F.countDistinct("speaker_id").alias("speakers"), F.max_by("end_ms", "segment_index").alias("duration_ms"))
    t = topics.groupBy("conversation_id").agg(F.count("*").alias("topics"))
    c = corrected.groupBy("conversation_id").agg(F.count_if("corrected").alias("corrections"))
    o = occurrences.groupBy("conversation_id").agg(F.countDistinct("term_id").alias("terms"), F.count("*").alias("occurrences"))
    m = mentions.groupBy("conversation_id").agg(F.countDistinct("person_id").alias("people"))
    for part in (t, c, o, m):
        s = s.join(part, "conversation_id", "left")
    return s.na.fill(0)


def transcript_text(segments: DataFrame, names: DataFrame) -> DataFrame:
    """``[i] name: text`` lines, an empty line between, and the speakers as ``id (name)``."""
    rows = segment_speaker(segments, names).select("conversation_id", "segment_index", "display_name").join(segments.select("conversation_id", "segment_index", "text"), ["conversation_id", "segment_index"])
    line = F.concat(F.lit("["), F.col("segment_index").cast("string"), F.lit("] "), F.col("display_name"), F.lit(": "), F.col("text"))
    lines = F.array_sort(F.collect_list(F.struct("segment_index", line.alias("line"))))
    text = rows.groupBy("conversation_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n\n").alias("transcript"))
    shown = F.array_sort(F.collect_list(F.struct("speaker_id", F.concat("speaker_id", F.lit(" ("), "display_name", F.lit(")")).alias("shown"))))
    listed = names.groupBy("conversation_id").agg(F.array_join(F.transform(shown, lambda x: x["shown"]), ", ").alias("speakers"))
    return text.join(listed, "conversation_id", "left")


def input_stats(segments: DataFrame, words: Column) -> DataFrame:
    return segments.groupBy("conversation_id").agg(F.sum(F.length("text")).alias("chars"), F.sum(words).alias("words"), F.max_by("end_ms", "segment_index").alias("duration_ms"))


def duration_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """The length of each conversation by its segments before and after their times were changed, and the difference."""
    end = lambda df, name: df.groupBy("conversation_id").agg(F.max_by("end_ms", "segment_index").alias(name))
    j = end(before, "before_ms").join(end(after, "after_ms"), "conversation_id")
    return j.select("conversation_id", "before_ms", "after_ms", (F.col("after_ms") - F.col("before_ms")).alias("difference_ms"))


def drift_metrics(segments: DataFrame, conversations: DataFrame, ratio_of: str = "duration_ms") -> DataFrame:
    """How far the last segment's end lies from the recording's length, and whether to correct it."""
    s = segments.groupBy("conversation_id").agg(F.max_by("end_ms", "segment_index").alias("last_end"), F.count("*").alias("n"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("total"))
    j = s.join(conversations.select("conversation_id", F.col(ratio_of).alias("audio_ms"), "alignment_status"), "conversation_id")
    drift = F.col("audio_ms") - F.col("last_end")
    ratio = F.coalesce(F.col("audio_ms") / F.nullif(F.col("last_end"), F.lit(0)).cast("double"), F.lit(1.0))
    fixes = (F.abs(drift) > 1000) & ~F.col("alignment_status").isin("aligned", "fallback")
    way = F.when(drift > 0, "short").when(drift < 0, "long").otherwise("none")
    mean = round_half_up(F.col("total") / F.col("n").cast("double"))
    return j.select("conversation_id", F.abs(drift).alias("drift_ms"), ratio.alias("ratio"), round_half_up(F.coalesce(100.0 * F.abs(drift) / F.nullif(F.col("audio_ms"), F.lit(0)), F.lit(0.0)), 1).alias("percent"), way.alias("direction"), fixes.alias("corrects"), mean.alias("mean_ms"))


def drift_correction(segments: DataFrame, drift: DataFrame) -> DataFrame:
    """Times scaled by the ratio, rounded half up, where the drift is to be corrected."""
    at = lambda c: F.when(F.col("corrects"), F.floor(F.col(c) * F.col("ratio") + 0.5).cast("long")).otherwise(F.col(c))
    return segments.join(drift.select("conversation_id", "ratio", "corrects"), "conversation_id", "left").select("conversation_id", "segment_index", at("start_ms").alias("start_ms"), at("end_ms").alias("end_ms"))


#: Percent of a whole run that each step stands for.
STEP_PERCENT = {"pending": 0, "uploading": 15, "transcribing": 40, "analyzing": 60, "aligning": 85, "finalizing": 95, "complete": 100, "failed": 0}


def step_percent(step: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for kv in STEP_PERCENT.items() for v in kv]), step).cast("long")


def step_timeline(steps: DataFrame) -> DataFrame:
    """When each step ended and how long it took; the last stays open."""
    nxt = F.lead("started_at").over(W.partitionBy("conversation_id").orderBy("position"))
    return steps.select("conversation_id", "position", "step", nxt.alias("completed_at"), F.floor((F.unix_micros(nxt.cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1000).cast("long").alias("duration_ms"), step_percent(F.col("step")).alias("percent"))


def assemble(segments: DataFrame) -> DataFrame:
    """One nested document a conversation."""
    parts = F.array_sort(F.collect_list(F.struct("segment_index", "speaker_id", "start_ms", "end_ms", "text")))
    return segments.groupBy("conversation_id").agg(parts.alias("segments"))


def flatten(documents: DataFrame) -> DataFrame:
    return documents.select("conversation_id", F.inline("segments"))


def realign(original: DataFrame, timed: DataFrame, gate: float = 0.55) -> DataFrame:
    """New times onto the originals by position, and the length that the last of them gives; a mean confidence below the gate only warns."""
    j = original.select("conversation_id", "segment_index", "speaker_id").join(timed.select("conversation_id", "segment_index", "start_ms", "end_ms", "confidence"), ["conversation_id", "segment_index"])
    mean = F.avg(F.col("confidence").cast("decimal(18,6)")).over(W.partitionBy("conversation_id")).cast("double")
    length = F.max_by("end_ms", "segment_index").over(W.partitionBy("conversation_id"))
    return j.select("conversation_id", "segment_index", "speaker_id", "start_ms", "end_ms", F.lit("aligned").alias("alignment_status"), (mean < gate).alias("low_confidence"), length.alias("duration_ms"))
