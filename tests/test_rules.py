"""Rules where engines differ, and folds against plain loops."""

import random
import time

from pyspark.sql import functions as F

from colloquy.functions import numbers, text
from colloquy.operators import alignment, mentions, segments, usage


def one(spark, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])


def test_rounding_goes_up_at_half(spark):
    r = one(spark, a=-2.5, b=2.5).select(numbers.round_half_up(F.col("a")), numbers.round_half_up(F.col("b"))).first()
    assert tuple(r) == (-2.0, 3.0)


def test_json_number(spark):
    rows = spark.createDataFrame([('{"x": 5.5}',), ('{"x": "5"}',), ('{"x": 0}',), ("no json",), (None,)], "j string")
    assert [r[0] for r in rows.select(numbers.json_number(F.col("j"), "x")).collect()] == [5.5, None, None, None, None]


def test_normal_form(spark):
    r = one(spark, t="  Été, C++ is　it! ").select(text.normal(F.col("t"))).first()
    assert r[0] == "t c is it"


def test_whole_word_edges_are_ascii(spark):
    df = one(spark, t="éx x xé X_ x").select(text.matches(F.col("t"), text.whole_word(F.array(F.lit("x"), F.lit("")))).alias("m"))
    assert [(m["start"], m["end"]) for m in df.first()["m"]] == [(1, 2), (3, 4), (5, 6), (11, 12)]


def test_clamped_counter_is_the_loop(spark):
    rng = random.Random(1)
    kinds = [usage.CREATED, usage.DELETED, "click"]
    rows = [(i, u, rng.choice(kinds), f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}") for u in range(3) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id int, user_id int, event_type string, timestamp string")
    got = {(r["user_id"], r["event_id"]): r["existing"] for r in usage.clamped_counter(df).collect()}
    for u in range(3):
        n = 0
        for i, _, kind, _ in (r for r in rows if r[1] == u):
            n = max(0, n + (kind == usage.CREATED) - (kind == usage.DELETED))
            assert got[u, i] == n


def test_monotonic_repair_is_the_loop(spark):
    rng = random.Random(2)
    rows = [(c, i, (a := rng.randrange(60_000)), a + rng.randrange(1, 20_000), rng.randrange(0, 30), 0.8, "match") for c in range(20) for i in range(12)]
    df = spark.createDataFrame(rows, "conversation_id long, segment_index long, start_ms long, end_ms long, n_words long, confidence double, method string")
    got = {(r["conversation_id"], r["segment_index"]): (r["start_ms"], r["end_ms"], r["method"]) for r in alignment.monotonic_repair(df).collect()}
    for c in range(20):
        end = 0
        for k, (_, i, a, b, n, _, m) in enumerate(r for r in rows if r[0] == c):
            if a < end - 2000:
                a, b, m = end, end + b - a, m + "_fixed"
            if not 20 <= (b - a) / max(n, 1) <= 800:
                a = end + 50 if k else a
                b, m = a + 150 * n, "duration_fallback"
            assert got[c, i] == (a, b, m)
            end = b


def test_progress_covers_every_user(spark):
    from colloquy.plans import QUERIES

    sf = "/root/testdata/sf0.01"
    events = spark.read.parquet(f"{sf}/events.parquet")
    assert events.filter("user_id >= 20").count() > 0
    assert QUERIES["step_timeline_all"](spark, sf).count() == events.count()
    got = QUERIES["progress_stream_all"](spark, sf).agg(F.sum(F.col("position") + 1)).first()[0]
    assert got == events.count()


def test_empty_segments(spark):
    none = spark.createDataFrame([], "conversation_id long, segment_index long, speaker_id string, start_ms long, end_ms long, text string")
    assert segments.boundary_repair(none).count() == 0
    assert segments.speaker_numbering(none).count() == 0


def test_terms_meet_texts_by_keys(spark):
    """The equal-key join finds what every term's pattern finds in every text, letters of odd case included."""
    said = ["The kit, a KIT and a \u212ait", "C++ or c++; Su\u017f su\u017f SUS", "x\u0130 caf\u00e9 CAF\u00c9 na\u00efve", "\u65e5\u672c\u8a9e a\u65e5\u672c b", "", "-- a -- b_c d.e"]
    names = ["kit", "C++", "sus", "x", "caf\u00e9", "caf", "\u65e5\u672c", "--", "d.e", "b_c", "the kit", "\u00e9"]
    rows = spark.createDataFrame([("c", i, t) for i, t in enumerate(said)], "conversation_id string, segment_index int, text string")
    terms = spark.createDataFrame([(i, f"t{i}", n, ["", "zz"]) for i, n in enumerate(names)], "ordinal int, term_id string, display string, aliases array<string>")
    found = [{(r["segment_index"], r["term_id"], r["start_char"], r["end_char"]) for r in mentions.term_occurrences(rows, terms, small).collect()} for small in (2000, 0)]
    got = found[0]
    assert found[0] == found[1]
    every = rows.crossJoin(terms.select("term_id", text.whole_word(F.array("display")).alias("p")))
    want = {tuple(r) for r in every.select("segment_index", "term_id", F.inline(text.matches(F.col("text"), F.col("p")))).collect()}
    assert got == want and len(want) > 8


def test_splits_in_order(spark):
    """Two splits of one segment, the second in what stands before the first; three speakers leave nothing to infer."""
    rows = spark.createDataFrame([("a", 0, "p", 0, 100, "one two three"), ("a", 1, "q", 100, 200, "four"), ("b", 0, "p", 0, 10, "x y"), ("b", 1, "q", 10, 20, "z"), ("b", 2, "r", 20, 30, "w")], "conversation_id string, segment_index int, speaker_id string, start_ms long, end_ms long, text string")
    cuts = spark.createDataFrame([("a", 0, 0, 7, None, None), ("a", 0, 1, 3, None, "r"), ("a", 1, 0, 9, None, None), ("b", 0, 0, 1, None, None)], "conversation_id string, segment_index int, ordinal int, split_at_char int, speaker_before string, speaker_after string")
    got = [(r["conversation_id"], r["segment_index"], r["speaker_id"], r["text"]) for r in segments.apply_splits(rows, cuts).orderBy("conversation_id", "segment_index").collect()]
    assert got == [("a", 0, "p", "one"), ("a", 1, "r", "two"), ("a", 2, "q", "three"), ("a", 3, "q", "four"), ("b", 0, "p", "x y"), ("b", 1, "q", "z"), ("b", 2, "r", "w")]


def test_ngrams_of_a_long_text_are_taken_in_one_pass(spark):
    df = one(spark, t="abcab𝒳a", s="ab", e="").select(*[text.char_ngrams(F.col(c)).alias(c) for c in "tse"])
    assert list(df.first()) == [["abc", "bca", "cab", "ab𝒳", "b𝒳a"], ["ab"], [""]]
    began = time.time()
    long = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda i: F.hex(i)), " ").alias("t"))
    n = long.select(F.size(text.char_ngrams(F.col("t")))).first()[0]
    whole = " ".join(f"{i:X}" for i in range(1, 60_001))
    assert n == len({whole[i : i + 3] for i in range(len(whole) - 2)}) and time.time() - began < 15


def test_many_matches_in_a_text_are_split_once(spark):
    # the text was split anew for each match
    began, k = time.time(), 15_000
    m = spark.range(1).select(F.concat(F.repeat(F.lit("x, "), k), F.lit("y")).alias("t")).select(text.matches(F.col("t"), text.whole_word(F.array(F.lit("x")))).alias("m")).first()["m"]
    assert [(a["start"], a["end"]) for a in m] == [(3 * i, 3 * i + 1) for i in range(k)] and time.time() - began < 30


def test_small_ascii_dictionary_is_read_without_patterns(spark):
    """The same as patterns find, odd letters and non-ASCII names included, but no pattern runs over texts without such letters."""
    rng = random.Random(5)
    bits = ["the", "The", "THE north", "north", "c++", "C++x", "é", "_", " ", " ", ", ", "k\u212aa", "ka", "\u0130s", "is", "zoé", "😀", "a-b", "A-B a", "\n"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(14)) for _ in range(300)] + ["", None]
    rows = spark.createDataFrame([(i // 7, i % 7, t) for i, t in enumerate(texts)], "conversation_id string, segment_index int, text string")
    names = [["the", "the north"], ["the north", "the"], ["C++", "", None], ["a-b", "b a"], ["Zoé", "is"], ["kka", "ka"], [""], ["-"], None]
    entries = spark.createDataFrame([(i, f"t{i}", n, ["north"] if i % 2 else None) for i, n in enumerate(names)], "ordinal int, term_id string, names array<string>, others array<string>")
    new = mentions._found(rows, entries, "term_id")
    old = mentions._patterned(rows, entries.filter("names IS NOT NULL"), "term_id", mentions.SMALL)
    got, want = sorted(map(tuple, new.collect())), sorted(map(tuple, old.collect()))
    assert got == want and len(got) > 500
    plain = mentions._found(rows, entries.filter("ordinal < 4"), "term_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plain


def test_distances_of_many_pairs_are_those_of_each(spark):
    from colloquy.functions import edits

    rng = random.Random(11)
    text_ = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    sizes = [0, 1, 2, 3, 4, 63, 64, 65, 127, 128, 129, 200, 700]
    pairs = [(text_(m, letters), text_(n, letters)) for letters in ("ab", "abc de", "é😀漢 x") for m in sizes for n in sizes]
    pairs += [(a, a[:k] + "q" + a[k + 1 :]) for a, _ in pairs[-60:] for k in (0, len(a) // 2)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    want = [r[0] for r in rows.orderBy("i").select(F.levenshtein("a", "b")).collect()]
    assert edits.distances(*map(list, zip(*pairs))).tolist() == want


def test_long_pairs_are_scored_soon(spark):
    """Two texts of 6,000 characters took a step for each of 36 million cells."""
    rng = random.Random(12)
    rows = spark.createDataFrame([(i, *[" ".join("".join(rng.choice("abcde") for _ in range(5)) for _ in range(1000)) for _ in range(2)]) for i in range(12)] + [(99, None, "a"), (98, "", "a"), (97, None, "")], "i int, a string, b string")
    text.with_span_score(rows.limit(1), "a", "b", "s").collect()
    start = time.perf_counter()
    got = {r["i"]: r["s"] for r in text.with_span_score(rows.coalesce(1), "a", "b", "s").collect()}
    took = time.perf_counter() - start
    assert all(0 < got[i] < 1 for i in range(12)) and got[99] is None and got[98] == got[97] == 0
    start = time.perf_counter()
    rows.coalesce(1).select(F.levenshtein("a", "b") + F.levenshtein("b", "a")).collect()
    assert took < time.perf_counter() - start
