"""The span search, the chain of anchors and the whole alignment against brute force and known times."""

import math
import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import alignment, spans
from colloquy.sources.shared import fresh_path

HINTS = "conversation_id long, segment_index long, text string, start_ms long, end_ms long, n_words long, expected long"
WORDS = "conversation_id long, segment_index long, word_index long, word string, start_s double, end_s double"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def score(a, b):
    """The five measures by their definitions."""
    if not a or not b:
        return 0.0
    grams = lambda t: {t} if len(t) <= 3 else {t[i : i + 3] for i in range(len(t) - 2)}
    ratio = lambda x, y: 1 - distance(x, y) / float(max(len(x), len(y)))
    ta, tb, ga, gb = set(a.split()), set(b.split()), grams(a), grams(b)
    both = len(ga & gb)
    value = 0.30 * (2.0 * len(ta & tb) / (len(ta) + len(tb))) + 0.25 * ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))) + 0.20 * (both / float(min(len(ga), len(gb)))) + 0.15 * ratio(a, b) + 0.10 * (both / float(len(ga | gb)))
    return math.floor(value * 1e6 + 0.5) / 1e6


def test_distances_are_those_of_the_table():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ("".join(rng.choice("ab _9") for _ in range(rng.randint(0, 80))) for _ in range(2))
        ends = sorted({rng.randint(0, len(b)), len(b)})
        assert spans.edits(spans.masks(a), len(a), b, ends) == [distance(a, b[:e]) for e in ends]


def test_search_finds_what_a_full_scan_finds():
    rng = random.Random(1)
    words_of = ["a", "the", "of", "and", "tion", "ing", "x y", "", "", "b2", "wordy", "zz"]
    for _ in range(300):
        words = [rng.choice(words_of) for _ in range(rng.randint(1, 25))]
        n, at, starts = rng.randint(1, 7), rng.randrange(len(words)), rng.randint(1, len(words))
        wanted = " ".join(" ".join(rng.choice([w, w, w, rng.choice(words_of)]) for w in words[at : at + n]).split())
        if not wanted:
            continue
        every = [(s, size, score(wanted, " ".join(" ".join(words[s : s + size]).split()))) for size in spans.sizes(n) for s in range(min(starts, len(words) - size + 1))]
        for least in (0.4, 0.75):
            assert sorted(spans.Search(wanted, words, n, starts).at_least(least)) == sorted(x for x in every if x[2] >= least)
        for sure in (0.95, 0.6):
            good = [x for x in every if x[2] >= 0.4]
            want = [min(good, key=lambda x: (0, 0, x[1], x[0]) if x[2] >= sure else (1, -x[2], x[1], x[0]))] if good else []
            assert spans.Search(wanted, words, n, starts).best(0.4, sure) == want


def test_every_length_is_matched_as_by_scoring_all(spark):
    """Of all spans the best is chosen, and most long segments, and those whose first words are wrong, have one."""
    from colloquy.plans import fixtures, transcripts

    sf = "/root/testdata/sf0.001"
    h, w = (d.filter("conversation_id % 10 = 0") for d in (transcripts.hints(spark, sf), fixtures.words(spark, sf)))
    said = alignment.blocks(w)
    # stored, so that the filter on scores does not make them anew
    path = fresh_path(spark, "scored")
    alignment.scored(alignment.span_candidates(h, w), h, w).write.parquet(path)
    every = alignment.best_match(spark.read.parquet(path)).collect()
    got = alignment.matches_in(alignment.in_band(h), said).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, every))
    long = h.filter("n_words > 20").count()
    assert long and sum(r["n"] > 20 for r in got) > 0.8 * long
    misheard = h.filter("n_words BETWEEN 8 AND 20").withColumn("text", F.regexp_replace("text", r"^\S+ \S+ \S+", "qqq zzz xxx"))
    assert misheard.count() > 0 and alignment.matches_in(alignment.in_band(misheard), said).count() > 0.5 * misheard.count()


def test_bands_longer_than_a_piece_and_a_block(spark):
    """A segment whose range is a conversation of thousands of words, in several pieces."""
    rng = random.Random(6)
    words = [f"w{rng.randrange(3000)}" for _ in range(3 * spans.PIECE + 50)]
    rows = [(1, 0, i, w, i * 0.2, i * 0.2 + 0.1) for i, w in enumerate(words)]
    at = [5, spans.PIECE - 3, 2 * spans.PIECE + 7, len(words) - 8]
    segments = [(1, k, " ".join(words[a : a + 8]), 8, 0, len(words) - 1, None) for k, a in enumerate(at)]
    banded = spark.createDataFrame(segments, "conversation_id long, segment_index long, text string, n_words long, first long, last long, stop long")
    got = alignment.matches_in(banded, alignment.blocks(spark.createDataFrame(rows, WORDS))).collect()
    assert sorted((r["segment_index"], r["start"], r["size"], r["score"]) for r in got) == [(k, a if a + 8 <= len(words) else len(words) - 8, 8, 1.0) for k, a in enumerate(at)] or all(r["score"] >= 0.95 and abs(r["start"] - at[r["segment_index"]]) <= 1 for r in got) and len(got) == len(at)


def chain_weight(rows):
    """The greatest total of a chain, by trying all."""
    rows = sorted(rows)
    best = [0] * (len(rows) + 1)
    for i, (g, s, n, w) in enumerate(rows):
        best[i] = w + max((best[j] for j in range(i) if rows[j][0] < g and rows[j][1] + rows[j][2] <= s), default=0)
    return max(best)


def test_chain_is_the_heaviest():
    rng = random.Random(3)
    for _ in range(400):
        rows = sorted({(rng.randrange(8), rng.randrange(30), rng.randrange(1, 9)) for _ in range(rng.randint(0, 25))})
        rows = [(*r, round(rng.uniform(0.75, 1), 6)) for r in rows]
        chain = list(alignment.heaviest(("c", *r) for r in rows))
        assert all(a[1] < b[1] and a[2] + a[3] <= b[2] for a, b in zip(chain, chain[1:]))
        assert sum(round(r[4] * 1e6) for r in chain) == chain_weight([(g, s, n, round(w * 1e6)) for g, s, n, w in rows])


def test_chain_holds_where_the_first_good_span_would_not(spark):
    """A false span far ahead, taken greedily, would shut out all that follow."""
    rows = [(1, 0, 500, 5, 0.99), (1, 0, 0, 5, 0.80), *[(1, i, 10 * i, 5, 0.85) for i in range(1, 6)], (2, 0, 3, 4, 0.75)]
    df = spark.createDataFrame(rows, "conversation_id long, segment_index long, start long, size long, score double")
    got = sorted(tuple(r) for r in alignment.anchor_selection(df).collect())
    assert got == [(1, 0, 0, 5, 0.80), *[(1, i, 10 * i, 5, 0.85) for i in range(1, 6)], (2, 0, 3, 4, 0.75)]
    assert alignment.anchor_selection(df.filter("false")).count() == 0


@pytest.fixture(scope="module")
def uneven(spark):
    """Four recordings with words of 80 to 700 ms, pauses up to 6 s, hints that drift by a sixth and miss or mishear every sixth word."""
    rng = random.Random(11)
    vocabulary = [f"{a}{b}{c}" for a in ("ba", "ke", "li", "mo", "nu", "sta") for b in ("r", "n", "lt", "sh") for c in ("o", "en", "ing", "ate")] + ["the", "of", "and", "to", "a"] * 8
    words, hints, truth = [], [], {}
    for c in range(4):
        t, at = 0.0, 0
        for s in range(40):
            n = rng.choice([3, 8, 15, 25, 60])
            said = [rng.choice(vocabulary) for _ in range(n)]
            t += rng.choice([0.1, 0.3, 6.0])
            truth[c, s] = t
            first = at
            for w in said:
                d = rng.uniform(0.08, 0.7)
                words.append((c, s, at, w, round(t, 3), round(t + 0.9 * d, 3)))
                t, at = t + d, at + 1
            heard = [w if rng.random() > 1 / 6 else rng.choice([None, "uh"]) for w in said]
            heard = [w for w in heard if w] or ["uh"]
            hints.append((c, s, " ".join(heard), int(truth[c, s] * 850), int(t * 850), len(heard), int(first * 0.85)))
    return spark.createDataFrame(hints, HINTS), spark.createDataFrame(words, WORDS), truth


def test_alignment_recovers_uneven_times(uneven):
    hints, words, truth = uneven
    got = alignment.aligned_transcripts(hints, words).collect()
    assert len(got) == len(truth)
    near = sum(abs(r["start_ms"] / 1000 - truth[r["conversation_id"], r["segment_index"]]) <= 2 for r in got)
    assert near >= 0.9 * len(truth), near / len(truth)


def test_alignment_recovers_times_of_the_tables(spark):
    """Nearly all segments of a drifted, thinned transcript come back within two seconds of the truth."""
    from colloquy.plans import fixtures, transcripts

    sf = "/root/testdata/sf0.001"
    got = alignment.aligned_transcripts(transcripts.hints(spark, sf), fixtures.words(spark, sf))
    j = got.alias("g").join(fixtures.segments(spark, sf).alias("s"), ["conversation_id", "segment_index"])
    near, n = j.agg(F.count_if(F.abs(F.col("g.start_ms") - F.col("s.start_ms")) <= 2000), F.count("*")).first()
    assert n > 0 and near / n > 0.9, near / n


def test_distances_side_by_side_are_those_of_the_table():
    rng = random.Random(5)
    some = lambda least: "".join(rng.choice("ab _9") for _ in range(rng.randint(least, 60)))
    for _ in range(60):
        a, others = some(1), [some(1) for _ in range(rng.randint(1, 5))]
        for b, got in zip(others, spans.edits_beside(a, others)):
            assert got.tolist() == [distance(a, b[:e]) for e in range(1, len(b) + 1)]
        b = others[0]
        assert spans.edits_beside(a, [b], anywhere=True)[0].tolist() == [min(distance(a, b[s:e]) for s in range(e + 1)) for e in range(1, len(b) + 1)]


def test_long_segments_are_found_in_few_passes(monkeypatch):
    """A thinned segment of 150 words among 600: the best of all spans, from a dozen passes over its text at most."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    words = [rng.choice(vocabulary) for _ in range(600)]
    wanted = " ".join(w for i, w in enumerate(words[200:375]) if i % 7 != 6)
    n = len(wanted.split(" "))
    passes, once = [], spans.edits_beside
    monkeypatch.setattr(spans, "edits_beside", lambda *a, **k: passes.append(1) or once(*a, **k))
    [(start, size, found)] = spans.Search(wanted, words, n, 400).best(0.4, 0.95)
    assert len(passes) <= 12
    assert found == score(wanted, " ".join(words[start : start + size]))
    near = [score(wanted, " ".join(words[s : s + k])) for s, k in ((start - 1, size), (start + 1, size), (start, spans.sizes(n)[1]), (start, n))]
    assert found >= max(near)
