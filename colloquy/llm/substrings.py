"""Removal of passages that were there before, with a count-min prefilter.

A window is ``n`` (20) consecutive words of a document. A word goes if it lies in a window whose words
also start earlier: in a document of smaller id, or earlier in the same one.

1. Whole copies. Documents of the same words are grouped by a 128-bit digest; of each group only that of the
   smallest id goes on, since every window of the others (of ``n`` words or more) was there before.
2. Sketch. Each partition counts its windows in a sparse two-row count-min sketch. A window is counted
   under its anchor, the 8-word run in it of least hash, once for each place of the anchor; equal windows
   have equal anchors at different places, so the count is never below the window's own. Tasks that hold
   a stretch of the sketch each add up what the partitions send, as a stream.
3. Exact pass. Windows estimated at two or more are grouped by a 128-bit hash, first within a task, where
   all but the first of a kind are settled, then by one shuffle: no window is lost, and a window as
   frequent as may be sends one row a task.

The sketch is the only thing of the corpus's size that is broadcast: two rows of 2^16 to 2^28 bits, 64 MB at
most. Where the corpus fills that, :func:`_dealt` takes its place: the sketch is a distributed table of as
many cells as the corpus asks for, and each text gets the list of its own anchors that were counted twice or
more. The results are the same.

Nulls: a null text has no words; each row without an id is a document of its own after all others. Rows
that share an id are one document in the order of documents: of the same window at the same place in two of
them neither is the earlier, at different places the one at the later place goes, and each row loses what
its own text says. Repeated rows give equal results. An empty table gives no rows. Texts of any length are
read whole. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import keyed, partitions, stored, text_batches, unkeyed, with_group
from .shingles import Words, digests, mixed, portions

WINDOW, ANCHOR = 20, 8
ROWS, LEAST_BITS, MOST_BITS = 2, 16, 28
#: Cells of a row for each expected anchor, and bytes of text for each anchor (7 words).
SPARE, BYTES = 4, 40
STRETCH_BITS = 14
_SLICE = 1 << 22


def _anchors(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(first words of the windows that a text holds, the place of each window's anchor)."""
    valid = np.flatnonzero(words.valid(WINDOW))
    if not len(valid):
        return valid, valid
    grams = words.runs(ANCHOR)
    span = WINDOW - ANCHOR + 1
    at = np.empty(len(words.starts) - WINDOW + 1, dtype=np.int64)
    for lo in range(0, len(at), _SLICE):
        g = grams[lo : lo + _SLICE + span - 1]
        # high bits of the hash, then the place: least hash, leftmost of equals
        key = (g & ~np.uint64((1 << 24) - 1)) | np.arange(len(g), dtype=np.uint64)
        width = 1
        least = key
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[: len(key) - span + 1], least[span - width : span - width + len(key) - span + 1])
        at[lo : lo + len(least)] = (least & np.uint64((1 << 24) - 1)).astype(np.int64) + lo
    return valid, at[valid]


def _cells(grams: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mixed(grams ^ np.uint64(0x5851F42D4C957F2D * (row + 1) & (1 << 64) - 1)) >> np.uint64(64 - bits)).astype(np.int64)


def _sketch(bits: int):
    """Per partition: (row, stretch, cells seen once, cells seen more often), cells as 16-bit places."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            grams = np.concatenate(found)
            for row in range(ROWS):
                cells, n = np.unique(_cells(grams, row, bits), return_counts=True)
                cuts = np.searchsorted(cells, np.arange(0, (1 << bits) + 1, 1 << STRETCH_BITS))
                low = (cells & ((1 << STRETCH_BITS) - 1)).astype("<u2")
                many = n > 1
                got = [(k, low[a:b][~many[a:b]].tobytes(), low[a:b][many[a:b]].tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(got), pa.int32()), *[pa.array([g[j] for g in got], t) for j, t in enumerate((pa.int32(), pa.binary(), pa.binary()))]], names=["row", "stretch", "ones", "many"])

        found: list[np.ndarray] = []
        for batch in batches:
            for part in portions(batch, "text"):
                words = Words(part.column("text"))
                _, at = _anchors(words)
                if len(at):
                    found.append(words.runs(ANCHOR)[at[np.flatnonzero(np.diff(at, prepend=-1))]])
            if sum(map(len, found)) > 4_000_000:
                yield from sent(found)
                found = []
        if found:
            yield from sent(found)

    return count


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the stretches dealt to this task: a byte a cell, 16 kB a stretch; bits of cells of two or more."""
    held: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for row, stretch, ones, many in zip(*[c.to_pylist() for c in batch.columns]):
            cells = held.setdefault((row, stretch), np.zeros(1 << STRETCH_BITS, np.uint8))
            cells[np.frombuffer(many, "<u2")] = 2
            once = np.frombuffer(ones, "<u2")
            cells[once] = np.minimum(cells[once] + 1, 2)
    got = [(row, stretch, np.packbits(cells > 1).tobytes()) for (row, stretch), cells in held.items() if (cells > 1).any()]
    yield pa.RecordBatch.from_arrays([pa.array([g[j] for g in got], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["row", "stretch", "bits"])


def _candidates(shared, bits: int):
    """Windows estimated repeated: settled (runs of windows whose like came before in this task) or open.

    ``shared`` is the broadcast sketch, or None where each row brings the anchors of its text that are repeated.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = [np.frombuffer(b, np.uint8) for b in shared.value] if shared else []

        def hits(part: pa.RecordBatch, grams: np.ndarray, owner: np.ndarray) -> np.ndarray:
            hit = np.ones(len(grams), dtype=bool)
            if shared:
                for row in range(ROWS):
                    cells = _cells(grams, row, bits)
                    hit &= (sketch[row][cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).astype(bool)
                return hit
            bounds = np.searchsorted(owner, np.arange(part.num_rows + 1))
            for i, own in enumerate(part.column("anchors")):
                a, b = bounds[i : i + 2]
                hit[a:b] = np.isin(grams[a:b].view(np.int64), own.values.to_numpy()) if own.is_valid else False
            return hit

        def sent(found: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            a, b, doc, row, pos = (np.concatenate([f[k] for f in found]) for k in range(5))
            order = np.lexsort((pos, doc, b, a))
            a, b, doc, row, pos = (x[order] for x in (a, b, doc, row, pos))
            new = np.ones(len(a), dtype=bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            # what stands where the first of its kind stands (an id given twice) is not after it
            first = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
            again = (doc != doc[first]) | (pos != pos[first])
            d, r, p = doc[again], row[again], pos[again]
            order = np.lexsort((p, r, d))
            d, r, p = d[order], r[order], p[order]
            same = (d[1:] == d[:-1]) & (r[1:] == r[:-1])
            once = np.ones(len(d), dtype=bool)
            once[1:] = ~(same & (p[1:] == p[:-1]))
            d, r, p = d[once], r[once], p[once]
            start = np.ones(len(d), dtype=bool)
            start[1:] = (d[1:] != d[:-1]) | (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1)
            starts = np.flatnonzero(start)
            runs = np.diff(np.append(starts, len(d)))
            yield _batch(True, mixed(d[starts].view(np.uint64) + p[starts].astype(np.uint64)), np.zeros(len(starts), np.uint64), d[starts], r[starts], p[starts], runs)
            yield _batch(False, a[~again], b[~again], doc[~again], row[~again], pos[~again], np.ones((~again).sum(), np.int64))

        found: list[tuple[np.ndarray, ...]] = []
        held = 0
        for batch in batches:
            for part in portions(batch, "text"):
                words = Words(part.column("text"), 2)
                at, anchor = _anchors(words)
                if not len(at):
                    continue
                owner = np.searchsorted(words.bounds, at, side="right") - 1
                hit = hits(part, words.runs(ANCHOR)[anchor], owner)
                at, owner = at[hit], owner[hit]
                ids, rows = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "row"))
                found.append((words.runs(WINDOW, 0)[at], words.runs(WINDOW, 1)[at], ids[owner], rows[owner], at - words.bounds[owner]))
                held += len(at)
            if held > 3_000_000:
                yield from sent(found)
                found, held = [], 0
        if held:
            yield from sent(found)

    return look


def _batch(settled: bool, a: np.ndarray, b: np.ndarray, doc: np.ndarray, row: np.ndarray, pos: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), settled)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(doc), pa.array(row), pa.array(pos.astype(np.int32)), pa.array(n.astype(np.int32))], names=["settled", "a", "b", "doc_id", "row", "pos", "n"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, row, anchor, many) of each text's distinct anchors; many: it stands at two places of the text."""
    for batch in batches:
        for part in portions(batch, "text"):
            words = Words(part.column("text"))
            _, at = _anchors(words)
            at = at[np.flatnonzero(np.diff(at, prepend=-1))]
            owner = np.searchsorted(words.bounds, at, side="right") - 1
            grams = words.runs(ANCHOR)[at] if len(at) else np.zeros(0, np.uint64)
            order = np.lexsort((grams, owner))
            owner, grams = owner[order], grams[order]
            new = np.ones(len(owner), dtype=bool)
            new[1:] = (owner[1:] != owner[:-1]) | (grams[1:] != grams[:-1])
            starts = np.flatnonzero(new)
            ids = pa.array(owner[starts])
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(ids), part.column("row").take(ids), pa.array(grams[starts].view(np.int64)), pa.array(np.diff(np.append(starts, len(owner))) > 1)], names=["doc_id", "row", "anchor", "many"])


def _dealt(first: DataFrame, total: int) -> DataFrame:
    """The texts with the list of their anchors that a sketch of any size counts as repeated.

    The sketch is a table of its cells: counts are summed in each task and merged by the shuffle. A text's
    anchors meet the cells counted twice or more, those of a hot cell by broadcast, and come back to the text.
    """
    places = first.select("doc_id", "row", "text").mapInArrow(_places, "doc_id long, row long, anchor long, many boolean")
    places = stored(places.withColumn("cell", F.pmod(F.xxhash64("anchor"), F.lit(SPARE * total // BYTES + 1))), "places")
    cells = places.groupBy("cell").agg((F.max("many") | (F.count("*") > 1)).alias("again"), F.count("*").alias("n")).filter("again").drop("again")
    twice = with_group(places, stored(cells, "cells"), ["cell"], "n", places.count())
    own = twice.groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(F.collect_set("anchor").alias("anchors"))
    return first.join(own, (F.col("doc_id") == F.col("_id")) & (F.col("row") == F.col("_row"))).select("doc_id", "row", "text", "anchors")


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in portions(batch, "text"):
            n, a, b = digests(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(a), pa.array(b), pc.binary_length(part.column("text")).cast(pa.int64())], names=["doc_id", "n_words", "a", "b", "bytes"])


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds half of the digest, which tells the rows of one id apart."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(digests(batch.column("text"))[1]), batch.column("text")], names=["doc_id", "row", "text"])


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_words, n_removed, kept_sha256 from text and the runs of its covered windows."""
    for batch in batches:
        rows = []
        for text, pos, n in zip(batch.column("text"), batch.column("at").to_pylist(), batch.column("n").to_pylist()):
            words = (text.as_py() or "").encode().split()
            if pos:
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                for p, k in zip(pos, n):
                    gone[min(p, len(words))] += 1
                    gone[min(p + k + WINDOW - 1, len(words))] -= 1
                kept = [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]
            else:
                kept = words
            rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.string()))]], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def sketch_bits(total_bytes: int) -> int:
    return max(LEAST_BITS, (SPARE * total_bytes // BYTES).bit_length())


def _sketched(first: DataFrame, bits: int):
    """The merged sketch, broadcast."""
    spark = first.sparkSession
    parts = first.mapInArrow(_sketch(bits), "row int, stretch int, ones binary, many binary")
    merged = parts.repartition(partitions(spark), "row", "stretch").mapInArrow(_merged, "row int, stretch int, bits binary")
    table = [bytearray(1 << bits - 3) for _ in range(ROWS)]
    size = 1 << STRETCH_BITS - 3
    for r in merged.toLocalIterator():
        table[r["row"]][r["stretch"] * size : (r["stretch"] + 1) * size] = r["bits"]
    return spark.sparkContext.broadcast([bytes(r) for r in table])


def remove_repeats(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document; a sketch of over 2^most_bits cells is not broadcast."""
    text_batches(docs.sparkSession)
    rows, first_without = keyed(docs.select("doc_id", "text"))
    docs = rows.select(F.col("_key").alias("doc_id"), F.coalesce("_row.text", F.lit("")).alias("text"))
    prints = stored(docs.mapInArrow(_prints, "doc_id long, n_words long, a long, b long, bytes long"), "prints")
    total, n = prints.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    # rows that share an id but not their words are told apart by their text; elsewhere the id is enough
    shared = not prints.groupBy("doc_id").agg((F.max("a") != F.min("a")).alias("differ")).filter("differ").isEmpty()
    prints = prints.withColumn("row", F.col("a") if shared else F.lit(0).cast("long"))
    groups = prints.filter(F.col("n_words") >= WINDOW).groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    later = with_group(prints, groups, ["a", "b"], "copies", n).filter("doc_id > first")
    copies = stored(later.select("doc_id", "row", "n_words"), "copies")
    first = docs.mapInArrow(_told, "doc_id long, row long, text string") if shared else docs.select("doc_id", F.lit(0).cast("long").alias("row"), "text")
    gone = copies.select(F.col("doc_id").alias("_id"), F.col("row").alias("_gone")).distinct()
    first = first.join(gone, (F.col("doc_id") == F.col("_id")) & (F.col("row") == F.col("_gone")), "left_anti")

    bits = sketch_bits(total)
    kind = "settled boolean, a long, b long, doc_id long, row long, pos int, n int"
    if bits <= most_bits:
        windows = first.mapInArrow(_candidates(_sketched(first, bits), bits), kind)
    else:
        windows = _dealt(first, total).mapInArrow(_candidates(None, bits), kind)
    rank = F.rank().over(W.partitionBy("a", "b", "settled").orderBy("doc_id", "pos"))
    repeated = windows.withColumn("_rank", rank).filter(F.col("settled") | (F.col("_rank") > 1))
    runs = repeated.groupBy("doc_id", "row").agg(F.collect_list(F.struct("pos", "n")).alias("runs")).select(F.col("doc_id").alias("_id"), F.col("row").alias("_own"), F.col("runs.pos").alias("at"), F.col("runs.n").alias("n"))
    runs = stored(runs, "runs")
    out = first.join(runs, (F.col("doc_id") == F.col("_id")) & (F.col("row") == F.col("_own")), "left").select("doc_id", "text", "at", "n").mapInArrow(_finished, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    empty = copies.select("doc_id", "n_words", F.col("n_words").alias("n_removed"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"))
    return out.unionByName(empty).withColumn("doc_id", unkeyed("doc_id", first_without))
