"""Null and shared ids, repeated rows, very long texts and clashing columns, operator by operator."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import mixing, nearest, packing, pages, quality, sharding, wordpieces
from colloquy.llm.queries import tokenizer_path

LONG = "word " * 60_000
TEXTS = ["one two three", "one two three", None, "", "\u00e9t\u00e9 \U0001f600 end", LONG, "one two three"]
IDS = [1, 1, 2, None, None, None, 1]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", s, 7, 1, 2, "x", 3) for i, t, s in zip(IDS, TEXTS, ["a", "a", None, "b", "a", "b", "a"])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long, n_words long, shard int, law string, piece int")


def words(t):
    return len((t or "").split(" ")) - (t or "").split(" ").count("")


def test_quality_counts_each_row(odd):
    got = sorted(((r["doc_id"], r["n_words"]) for r in quality.score(odd).collect()), key=str)
    assert got == sorted(zip(IDS, map(words, TEXTS)), key=str)


def test_mixing_counts_each_row(odd):
    got = mixing.mix(odd).collect()
    assert sorted(((r["doc_id"], r["size"]) for r in got), key=str) == sorted(zip(IDS, map(words, TEXTS)), key=str)
    by_source = {}
    for r in got:
        assert r["taken"] <= 3 * r["size"]
        by_source.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    assert all(abs(sum(taken) - target) <= 1 for (_, target), taken in by_source.items())


def test_token_counts_of_each_row(odd):
    got = sorted(((r["doc_id"], r["n_words"]) for r in wordpieces.token_counts(odd, tokenizer_path()).collect()), key=str)
    assert got == sorted(zip(IDS, map(words, TEXTS)), key=str)


def test_shards_of_each_row(odd):
    got = sharding.shard_by_key(odd).collect()
    data = [(t or "").encode() for t in TEXTS]
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == sorted(((i, len(d) + 16, zlib.crc32(d)) for i, d in zip(IDS, data)), key=str)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # equal ids share a shard, null ids as one key
    assert len({(r["doc_id"], r["shard"]) for r in got}) == 3


def test_pieces_of_each_row(odd):
    got = packing.pack(odd, tokenizer_path()).collect()
    assert sum(r["piece"] == 0 for r in got) == len(TEXTS)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024


def test_neighbours_of_rows_without_id(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v, 0, 1) for i, v in enumerate(rng.normal(size=(60, 8)).tolist())]
    rows += [(None, rows[0][1], 0, 1), rows[20], rows[20]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score int")
    got = nearest.search(df).collect()
    assert {r["query_id"] for r in got} == {0, 20, 40} and not any(r["vec_id"] is None or r["vec_id"] == r["query_id"] for r in got)
    assert all(len({r["vec_id"] for r in got if r["query_id"] == q}) == 20 for q in (0, 20, 40))


def test_empty_tables(odd, spark):
    none = odd.filter(F.lit(False))
    for found in (quality.score(none), mixing.mix(none), wordpieces.token_counts(none, tokenizer_path()), sharding.shard_by_key(none), packing.pack(none, tokenizer_path())):
        assert found.count() == 0
    assert nearest.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_quotes_in_tags():
    """Quotes bind a value only where it begins with one."""
    article = "<article><h1>Head</h1><p>First {} text.</p><p>The rest of it, long enough.</p></article>"
    for inside in ("<a href=it's>link</a>", "<a title='a > b'>link</a>", '<a title="it\'s > b" href=x>link</a>', "<b it's>link</b>", "<a href = 'x'>link</a>", '<a href=a="b>link</a>', "<br class=>link"):
        assert pages.extract(f"<html><body><nav>menu</nav>{article.format(inside)}</body></html>", None) == "Head First link text. The rest of it, long enough.", inside
    assert pages.extract('<p>' + '<a href="' * 2000, None) == ""
