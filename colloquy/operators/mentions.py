"""Where terms and people are mentioned, highlighted and navigated."""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import matches, whole_word


#: Letters outside ASCII that case-insensitive matching takes for ASCII ones.
_ODD = "[\u0130\u0131\u017f\u212a]"


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _text_keys(text: Column) -> Column:
    """What a phrase found in the text may go by: each token, each other character, and two keys for odd letters."""
    found = F.array_distinct(F.regexp_extract_all(_ascii_lower(text), F.lit(r"(?s)\w+|\W"), F.lit(0)))
    return F.concat(found, F.array(F.lit("any text")), F.when(text.rlike(_ODD), F.array(F.lit("any phrase"))).otherwise(F.expr("cast(array() as array<string>)")))


def _phrase_keys(phrase: Column) -> Column:
    """The phrase's first token, which stands as a token wherever the phrase is found; without one its first character, if that has no case."""
    token, first = F.regexp_extract(_ascii_lower(phrase), r"\w+", 0), F.left(phrase, F.lit(1))
    caseless = (F.lower(first) == first) & (F.upper(first) == first)
    key = F.when(phrase.rlike(_ODD), "any text").when(token != "", token).when(caseless, first).otherwise(F.lit("any text"))
    return F.array(key, F.lit("any phrase"))


#: A dictionary of no more keys than this goes to the texts; a larger one meets them in a shuffle.
SMALL = 2000


def _candidates(segments: DataFrame, phrases: DataFrame, phrase: str, ident: str, small: int = SMALL) -> DataFrame:
    """Segments beside each entry of which a phrase may stand in them, met by equal keys.

    The keys of a small dictionary are tested in each text's own row, so neither texts nor tokens are shuffled.
    Else only ids and tokens are exploded; the pairs then meet the texts once.
    """
    keys = phrases.select(ident, F.explode(_phrase_keys(F.col(phrase))).alias("_key")).distinct()
    s = segments.select("conversation_id", "segment_index", "text")
    known = keys.groupBy("_key").agg(F.array_sort(F.collect_set(ident)).alias("_ids")).limit(small + 1).collect()
    if not known:
        return s.withColumn(ident, F.lit(None).cast(phrases.schema[ident].dataType)).limit(0)
    if len(known) <= small and sum(len(r["_ids"]) for r in known) <= small:
        by_key = F.map_from_entries(F.array(*[F.struct(F.lit(r["_key"]), F.lit(r["_ids"])) for r in known]))
        here = F.filter(_text_keys(F.col("text")), lambda k: F.array_contains(F.lit([r["_key"] for r in known]), k))
        ids = F.array_distinct(F.flatten(F.transform(here, lambda k: F.element_at(by_key, k))))
        return s.withColumn(ident, F.explode(ids))
    said = segments.select(F.col("conversation_id").alias("_c"), F.col("segment_index").alias("_i"), F.explode(_text_keys(F.col("text"))).alias("_key"))
    pairs = said.join(keys, "_key").select("_c", "_i", ident).distinct()
    return s.join(pairs, s["conversation_id"].eqNullSafe(pairs["_c"]) & s["segment_index"].eqNullSafe(pairs["_i"])).drop("_c", "_i")


def _patterned(segments: DataFrame, entries: DataFrame, ident: str, small: int) -> DataFrame:
    """What :func:`_found` gives, by patterns."""
    e = entries.withColumns({"_pattern": whole_word(F.col("names")), "_other": whole_word(F.col("others"))})
    phrases = e.select("ordinal", F.explode(F.concat("names", F.coalesce("others", F.expr("cast(array() as array<string>)")))).alias("_phrase")).filter("_phrase <> ''")
    near = _candidates(segments, phrases, "_phrase", "ordinal", small).join(e.drop("names", "others"), "ordinal").withColumn("_m", matches(F.col("text"), F.col("_pattern")))
    spans = F.when((F.size("_m") == 0) & F.col("_other").isNotNull(), matches(F.col("text"), F.col("_other"))).otherwise(F.col("_m"))
    return near.select("conversation_id", "segment_index", "ordinal", ident, F.inline(spans))


_WORD = frozenset(string.ascii_lowercase + string.digits + "_")


def plain_spans(text: str, names: list[str]) -> list[tuple[int, int]]:
    """The disjoint whole-word matches of any of the names, leftmost first, the earlier name of those that start together; all in lower case."""
    hits = []
    for rank, name in enumerate(names):
        opens, closes = name[0] in _WORD, name[-1] in _WORD
        at = text.find(name)
        while at >= 0:
            end = at + len(name)
            if ((at > 0 and text[at - 1] in _WORD) != opens) and ((end < len(text) and text[end] in _WORD) != closes):
                hits.append((at, rank, end))
            at = text.find(name, at + 1)
    hits.sort()
    out, upto = [], 0
    for start, _, end in hits:
        if start >= upto:
            out.append((start, end))
            upto = end
    return out


def _read(segments: DataFrame, entries: DataFrame, rows: pa.Table, ident: str) -> DataFrame:
    """What :func:`_found` gives, for entries in ASCII and texts without odd letters: both in lower case, names are looked for as they stand."""
    key = ["conversation_id", "segment_index"]
    names = [([n.lower() for n in r["names"] if n], None if r["others"] is None else [n.lower() for n in r["others"] if n]) for r in rows.to_pylist()]
    of = {c: rows.column(c).combine_chunks() for c in ("ordinal", ident)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, entry, starts, ends = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                text = text.lower()
                for k, (first, second) in enumerate(names):
                    spans = plain_spans(text, first)
                    if not spans and second is not None:
                        spans = plain_spans(text, second)
                    for start, end in spans:
                        at.append(i)
                        entry.append(k)
                        starts.append(start)
                        ends.append(end)
            columns = [batch.column(c).take(pa.array(at, pa.int64())) for c in key] + [of[c].take(pa.array(entry, pa.int64())) for c in ("ordinal", ident)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], [*key, "ordinal", ident, "start", "end"])

    kinds = [(c, segments.schema[c].dataType.simpleString()) for c in key] + [(c, entries.schema[c].dataType.simpleString()) for c in ("ordinal", ident)]
    return segments.select(*key, "text").mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in kinds) + ", start int, end int")


def _found(segments: DataFrame, entries: DataFrame, ident: str, small: int = SMALL) -> DataFrame:
    """(conversation_id, segment_index, ordinal, id, start, end) of the whole-word matches of an entry's ``names``, or where there are none of its ``others`` (null: nothing else).

    A small dictionary in ASCII is read off each text in its own row. Patterns, which cost some hundred times as
    much, are left to larger dictionaries, other letters and the few texts with letters that match ASCII ones.
    """
    e = entries.select("ordinal", ident, "names", "others").filter("names IS NOT NULL")
    table = e.limit(small + 1).toArrow()
    rows = table.to_pylist()
    if sum(len(r["names"]) + len(r["others"] or []) for r in rows) > small or len(rows) > small:
        return _patterned(segments, e, ident, small)
    ascii_ = lambda r: all(n is None or n.isascii() for n in [*r["names"], *(r["others"] or [])])
    plain, rest = [i for i, r in enumerate(rows) if ascii_(r)], [r for r in rows if not ascii_(r)]
    odd = F.col("text").rlike(_ODD)
    out = _patterned(segments.filter(odd), e, ident, small)
    if plain:
        out = out.unionByName(_read(segments.filter(~odd), e, table.take(plain), ident))
    if rest:
        out = out.unionByName(_patterned(segments.filter(~odd), segments.sparkSession.createDataFrame(rest, e.schema), ident, small))
    return out


def term_occurrences(segments: DataFrame, terms: DataFrame, small: int = SMALL) -> DataFrame:
    """Every whole-word match of a term or alias in every segment, numbered through each conversation."""
    t = terms.select("ordinal", "term_id", F.concat(F.array("display"), "aliases").alias("names"), F.lit(None).cast("array<string>").alias("others"))
    found = _found(segments, t, "term_id", small)
    n = F.row_number().over(W.partitionBy("conversation_id").orderBy("segment_index", "ordinal", "start")) - 1
    return found.select("conversation_id", F.concat(F.lit("occ_"), n.cast("string")).alias("occurrence_id"), "segment_index", "term_id", F.col("start").cast("long").alias("start_char"), F.col("end").cast("long").alias("end_char"))


def person_mentions(segments: DataFrame, people: DataFrame) -> DataFrame:
    """Full-name matches; where a segment has none, those of a first name of more than two letters."""
    first = F.split("name", " ")[0]
    two = F.col("name").contains(" ") & (F.length(first) > 2)
    p = people.filter("name IS NOT NULL").select("ordinal", "person_id", F.array("name").alias("names"), F.when(two, F.array(first)).alias("others"))
    return _found(segments, p, "person_id").select("conversation_id", "segment_index", "person_id", F.col("start").cast("long").alias("start_char"), F.col("end").cast("long").alias("end_char"))


def person_segments(mentions: DataFrame) -> DataFrame:
    """The segments that mention each person, in order, each once, and the number of mentions."""
    grouped = mentions.groupBy("conversation_id", "person_id").agg(F.array_sort(F.collect_set("segment_index")).alias("segments"), F.count("*").alias("mentions"))
    return grouped.select("conversation_id", "person_id", "segments", "mentions")


def segment_occurrences(segments: DataFrame, occurrences: DataFrame, mentions: DataFrame) -> DataFrame:
    """How many term and person spans each segment has, and the ids in order."""
    o = occurrences.groupBy("conversation_id", "segment_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_char", "term_id"))), lambda x: x["term_id"]), ",").alias("terms"))
    m = mentions.groupBy("conversation_id", "segment_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_char", "person_id"))), lambda x: x["person_id"]), ",").alias("people"))
    return segments.select("conversation_id", "segment_index").join(o, ["conversation_id", "segment_index"], "left").join(m, ["conversation_id", "segment_index"], "left").na.fill("")


def highlight_spans(segments: DataFrame, occurrences: DataFrame, mentions: DataFrame) -> DataFrame:
    """Disjoint parts of each text: plain, term or person. Of overlapping spans the first to start stays, a term before a person."""
    spans = occurrences.select("conversation_id", "segment_index", F.lit("term").alias("kind"), F.col("term_id").alias("id"), "start_char", "end_char", F.lit(0).alias("_k"))
    spans = spans.unionByName(mentions.select("conversation_id", "segment_index", F.lit("person").alias("kind"), F.col("person_id").alias("id"), "start_char", "end_char", F.lit(1).alias("_k")))
    per = spans.groupBy("conversation_id", "segment_index").agg(F.array_sort(F.collect_list(F.struct("start_char", "_k", "id", "end_char", "kind"))).alias("spans"))
    s = segments.select("conversation_id", "segment_index", "text").join(per, ["conversation_id", "segment_index"], "left")
    none = F.expr("cast(array() as array<struct<kind:string,id:string,start:bigint,end:bigint>>)")
    part = lambda kind, i, a, b: F.struct(kind.alias("kind"), i.alias("id"), a.alias("start"), b.alias("end"))
    plain = lambda a, b: F.when(b > a, F.array(part(F.lit("plain"), F.lit(None).cast("string"), a, b))).otherwise(none)
    # a column of its own: it is read more than once
    s = s.withColumn("_st", F.aggregate(
        F.coalesce("spans", F.expr("cast(array() as array<struct<start_char:bigint,_k:int,id:string,end_char:bigint,kind:string>>)")),
        F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")),
        lambda st, x: F.when(x["start_char"] < st["at"], st).otherwise(F.struct(x["end_char"].alias("at"), F.concat(st["out"], plain(st["at"], x["start_char"]), F.array(part(x["kind"], x["id"], x["start_char"], x["end_char"]))).alias("out"))),
    ))
    parts = F.concat(F.col("_st.out"), plain(F.col("_st.at"), F.length("text").cast("long")))
    return s.select("conversation_id", "segment_index", F.inline(parts))


def active_term_spans(spans: DataFrame, selected: str) -> DataFrame:
    return spans.filter("kind <> 'plain'").withColumn("active", F.col("id") == selected)


def mention_navigation(occurrences: DataFrame) -> DataFrame:
    """First, next and previous mention of each term, around the end."""
    w = W.partitionBy("conversation_id", "term_id").orderBy("segment_index", "start_char")
    all_of = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first, last = F.first("occurrence_id").over(all_of), F.last("occurrence_id").over(all_of)
    return occurrences.select("conversation_id", "term_id", "occurrence_id", first.alias("first_id"), F.coalesce(F.lead("occurrence_id").over(w), first).alias("next_id"), F.coalesce(F.lag("occurrence_id").over(w), last).alias("previous_id"))


def context_search(rows: DataFrame, query: str, fields: list[str], lists: list[str]) -> DataFrame:
    """Rows of which a field, or an element of a list, contains the text in any case; an empty text finds all."""
    q = F.lit(query.lower())
    hit = F.lit(query == "")
    for f in fields:
        hit = hit | F.coalesce(F.lower(f).contains(q), F.lit(False))
    for f in lists:
        hit = hit | F.coalesce(F.exists(f, lambda x: F.lower(x).contains(q)), F.lit(False))
    return rows.filter(hit)
