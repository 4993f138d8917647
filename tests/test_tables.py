"""Versioned tables, scans of files and the failure channel of uploads."""

import json
import os

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from colloquy.operators import uploads
from colloquy.sources import ingest, snapshots
from colloquy.sources.shared import fresh_path

KEYED = "id long, a string, b long"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_writes_copy_what_they_touch(spark):
    root = fresh_path(spark, "table")
    first = spark.createDataFrame([(i, f"a{i}", i) for i in range(500)], KEYED)
    assert snapshots.read(spark, root, KEYED).count() == 0
    assert snapshots.write(spark, root, first, "id", merge=False) == 1
    before = snapshots.manifest(spark, root)[1]
    changed = spark.createDataFrame([(3, None, 33), (1000, "new", None)], KEYED)
    assert snapshots.write(spark, root, changed, "id") == 2
    after = snapshots.manifest(spark, root)[1]
    assert 1 <= sum(after[b] != p for b, p in before.items()) <= 2
    want = {i: (i, f"a{i}", i) for i in range(500)} | {3: (3, "a3", 33), 1000: (1000, "new", None)}
    assert rows_of(snapshots.read(spark, root, KEYED)) == sorted(want.values())
    # a full replace takes missing fields as they are
    snapshots.write(spark, root, changed, "id", merge=False)
    want[3] = (3, None, 33)
    assert sorted(map(str, rows_of(snapshots.read(spark, root, KEYED).filter("id IN (2, 3)")))) == sorted(map(str, (want[2], want[3])))


def test_a_failed_write_leaves_the_version_before(spark):
    root = fresh_path(spark, "table")
    snapshots.write(spark, root, spark.createDataFrame([(1, "x", 1)], KEYED), "id")
    bad = spark.createDataFrame([(1, "y", 0)], KEYED).withColumn("b", F.when(F.col("b") == 0, F.raise_error(F.lit("no"))).otherwise(F.col("b")).cast("long"))
    with pytest.raises(Exception, match="no"):
        snapshots.write(spark, root, bad, "id")
    assert snapshots.manifest(spark, root)[0] == 1 and rows_of(snapshots.read(spark, root, KEYED)) == [(1, "x", 1)]
    # another writer has taken the next version
    with pytest.raises(RuntimeError, match="another"):
        snapshots._commit(spark, root, 1, {})
    assert rows_of(snapshots.read(spark, root, KEYED)) == [(1, "x", 1)]


def test_scan_takes_recordings_alone(spark):
    root = fresh_path(spark, "store")
    files = ["audio/u1/c1.mp3", "audio/u1/c2", "audio/u2/c3.part.OGG", "audio/u2/deep/c4.mp3", "audio/c5.mp3", "audio/u3/c6.txt", "other/u1/c7.mp3"]
    assert ingest.write_files(spark.createDataFrame([(f, "x" * (i + 1)) for i, f in enumerate(files)], "path string, content string"), root) == len(files)
    assert os.path.exists(f"{root}/{files[3]}")
    got = ingest.audio_inventory(spark, root).select("user_id", "conversation_id", "ext", "length")
    assert rows_of(got) == [("u1", "c1", "mp3", 1), ("u1", "c2", "mp3", 2), ("u2", "c3", "ogg", 3)]


def test_a_broken_upload_fails_alone(spark):
    good = '{"segments": [{"text": "Hello there, this is a plain talk.", "start": "0", "end": "2.5", "speaker": "A"}, {"text": " ", "start": "9"}, {"text": "Fine, C++ it is.", "start": "x", "end": "4", "speaker": null}]}'
    cases = [(1, 7, good, '{"corrections": [{"segmentIndex": 1, "newSpeaker": "A"}]}'), (2, 7, good[:50], None), (3, 8, '{"segments": []}', None), (4, 8, "{}", None), (5, 9, None, None), (6, 9, good, "no JSON {"), (7, None, '{"segments": [{"text": null}]}', None)]
    rows = spark.createDataFrame(cases, "conversation_id long, user_id long, asr string, corrections string")
    terms = spark.createDataFrame([(0, "t", "plain", [])], "ordinal int, term_id string, display string, aliases array<string>")
    seen = Observation()
    done = {r["conversation_id"]: r for r in uploads.processed(rows, terms, seen).collect()}
    assert {i: r["error"] for i, r in done.items()} == {1: None, 2: "response is not JSON", 3: "no segments", 4: "no segments", 5: "response is not JSON", 6: None, 7: "no segments"}
    assert (done[1]["segments"], done[1]["speakers"], done[1]["corrections"], done[1]["terms"]) == (2, 1, 1, 1)
    assert (done[6]["segments"], done[6]["speakers"], done[6]["corrections"]) == (2, 2, 0) and len(done[6]["document"]) == 2
    assert all(done[i]["segments"] == done[i]["duration_ms"] == 0 and done[i]["document"] is None for i in (2, 3, 4, 5, 7))
    assert seen.get == {"uploads": 7, "failed": 5, "segments": 4}
    kinds = {r["conversation_id"]: (r["event_type"], r["metadata"]) for r in uploads.events(uploads.processed(rows, terms)).collect()}
    assert kinds[2] == ("processing_failed", '{"errorMessage":"response is not JSON"}') and kinds[1][0] == "processing_completed"


def test_milliseconds_of_an_upload_are_those_written(spark):
    at = ["32.55", "64.35", "1.001", "1.2874999999E2", "NaN", "1e300", "no", None]
    asr = json.dumps({"segments": [{"text": "said", "start": a, "end": a, "speaker": "A"} for a in at]})
    rows = spark.createDataFrame([(1, 1, asr, None)], "conversation_id long, user_id long, asr string, corrections string")
    terms = spark.createDataFrame([(0, "t", "none", [])], "ordinal int, term_id string, display string, aliases array<string>")
    assert [s["end_ms"] for s in uploads.processed(rows, terms).first()["document"]] == [32550, 64350, 1001, 128749, 0, 0, 0, 0]
