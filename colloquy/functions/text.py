"""Column functions over text: normal form, counts, n-grams, similarity, whole-word matches with offsets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .edits import distances

#: Unicode blanks that count as white space here; they become plain blanks first.
BLANKS = "                 　﻿"
#: An ASCII word boundary, which Java's own is not.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def plain_blanks(text: Column) -> Column:
    return F.translate(text, BLANKS, " " * len(BLANKS))


def normal(text: Column) -> Column:
    """Lower case, nothing but ASCII word characters, single blanks between words."""
    kept = F.regexp_replace(F.lower(plain_blanks(text)), r"[^A-Za-z0-9_\s]", "")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def word_count(text: Column) -> Column:
    """Pieces between runs of white space: an empty text has one, blanks at an edge add one."""
    return F.size(F.split(text, r"\s+")).cast("long")


def char_ngrams(text: Column, n: int = 3) -> Column:
    """The distinct runs of n characters; a shorter text is its own.

    One pass of a pattern that looks n characters ahead: taking each run out of the text by its number would
    count the characters before it again.
    """
    grams = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1)))
    return F.when(F.length(text) <= n, F.array(text)).otherwise(grams)


def jaccard(shared: Column, total: Column) -> Column:
    """Shared over all elements, by their numbers; two empty sets are alike."""
    return F.when(total == 0, F.lit(1.0)).otherwise(shared / F.nullif(total, F.lit(0)).cast("double"))


def edit_ratio(a: Column, b: Column) -> Column:
    """1 less the edits over the greater length; two empty texts are alike."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / F.nullif(longest, F.lit(0)).cast("double"))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


#: The weights of the five measures of a span's likeness.
TOKENS, SORTED, INSIDE, WHOLE, GRAMS = 0.30, 0.25, 0.20, 0.15, 0.10


def _grams_of(text: str) -> set[str]:
    return {text} if len(text) <= 3 else {text[i : i + 3] for i in range(len(text) - 2)}


def _counts(a: str, b: str) -> tuple[int, ...]:
    """What two texts share: distinct 3-grams of either, of both, distinct tokens of either, of both."""
    ga, gb, ta, tb = _grams_of(a), _grams_of(b), set(a.split(" ")) - {""}, set(b.split(" ")) - {""}
    return len(ga), len(gb), len(ga & gb), len(ta), len(tb), len(ta & tb)


def _in_order(text: str) -> str:
    return " ".join(sorted(w for w in text.split(" ") if w))


#: Pairs measured at once.
PAIRS = 10_000


def _likeness(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for left, right in pairs:
        parts = []
        for at in range(0, len(left), PAIRS):
            x, y = left.iloc[at : at + PAIRS].tolist(), right.iloc[at : at + PAIRS].tolist()
            x, y = [v or "" for v in x], [v or "" for v in y]
            xs, ys = [_in_order(v) for v in x], [_in_order(v) for v in y]
            part = pd.DataFrame([_counts(*p) for p in zip(x, y)], columns=["x", "y", "both", "own", "said", "words"])
            edits = distances(x + xs, y + ys)
            parts.append(part.assign(plain=edits[: len(x)], sorted=edits[len(x) :], longest=[max(map(len, p)) for p in zip(xs, ys)]))
        yield pd.concat(parts) if parts else pd.DataFrame(columns=["x", "y", "both", "own", "said", "words", "plain", "sorted", "longest"])


def with_span_score(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Adds the likeness of two columns of normal texts in [0, 1]: five measures, weighted; an empty side gives 0.

    What is counted of a pair is a column on the way, so that it is counted once, and many pairs together: a
    distance of two texts takes a step for 64 cells of its table, where Spark's own takes one for each.
    """
    count = F.pandas_udf(_likeness, "x int, y int, both int, own int, said int, words int, plain int, sorted int, longest int")
    steps = df.withColumn("_n", count(F.col(a), F.col(b)))
    n = lambda c: F.col("_n")[c]
    ratio = lambda edits, longest: F.when(longest == 0, F.lit(1.0)).otherwise(1 - edits / F.nullif(longest, F.lit(0)).cast("double"))
    dice = F.coalesce(2.0 * n("words") / F.nullif(n("own") + n("said"), F.lit(0)), F.lit(0.0))
    inside = F.coalesce(n("both") / F.nullif(F.least(n("x"), n("y")), F.lit(0)).cast("double"), F.lit(0.0))
    shared = jaccard(n("both"), n("x") + n("y") - n("both"))
    score = TOKENS * dice + SORTED * ratio(n("sorted"), n("longest")) + INSIDE * inside + WHOLE * ratio(n("plain"), F.greatest(F.length(a), F.length(b))) + GRAMS * shared
    none = F.col(a).isNull() | F.col(b).isNull()
    return steps.withColumn(name, F.when((F.col(a) == "") | (F.col(b) == ""), F.lit(0.0)).when(none, F.lit(None).cast("double")).otherwise(score)).drop("_n")


def regex_escape(text: Column) -> Column:
    return F.regexp_replace(text, r"[.*+?^${}()|\[\]\\]", r"\\$0")


def whole_word(alternatives: Column) -> Column:
    """A pattern that finds any of the alternatives, as written and escaped, as whole words in any case; empty ones are left out.

    They are looked for before the edge, which is dear and holds at every second place or so of a text.
    """
    any_of = F.array_join(F.transform(F.filter(alternatives, lambda a: a != ""), regex_escape), "|")
    return F.concat(F.lit("(?iu)(?="), any_of, F.lit(f"){EDGE}(?:"), any_of, F.lit(f"){EDGE}"))


def matches(text: Column, pattern: Column) -> Column:
    """(start, end) of each disjoint match, leftmost first, end exclusive.

    Between matches lie the pieces of a split at the pattern; offsets are the running lengths of both. Both are
    zipped before, as what stands in a lambda is computed for every match.
    """
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    zipped = F.zip_with(F.split(text, pattern, -1), found, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("n")))
    spans = F.aggregate(
        zipped,
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("out")),
        # the last piece has no match after it
        lambda s, m: F.when(m["n"].isNull(), s).otherwise(F.struct((s["at"] + m["gap"] + m["n"]).alias("at"), F.concat(s["out"], F.array(F.struct((s["at"] + m["gap"]).alias("start"), (s["at"] + m["gap"] + m["n"]).alias("end")))).alias("out"))),
    )
    return spans["out"]
