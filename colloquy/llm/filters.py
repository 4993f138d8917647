"""Audit of five document filters: what each removes, in every order in which they can be applied.

A document is reduced to a mask of the filters that it fails. Four of them read its text alone; the fifth,
a copy of a text with a smaller id, is found with compressed tries: every task inserts its whole texts into
a radix trie whose terminals hold the least id, and hands on one row for each of its distinct texts. Those
are dealt into ranges of text by prefixes, which grow where too much text lies under one of them, and each
range goes into one more trie, whose terminals then hold the least id of all. Masks are counted by part and
label; what a step of an order removes follows from the counts of at most 32 masks.

Nulls: a null text is empty, a null lang is the part "". A row without doc_id comes after all ids, so it is
a copy of any text that a row with an id has, and such rows are no copies of each other. Ties: rows that
share id and text are none either, and each is counted. Labels: a document has quality 1 (or toxic 1) if any
of its rows in ``labels`` says so; one without labels has neither. Empty texts are a text like others. Texts
of any length are inserted whole. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, partitions, stored, text_batches

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 200, 50, 3
SIGNS = re.compile(r"[#$%&*|]")
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
COPY = 1 << FILTERS.index("E")
_WORD = re.compile(WORD)

#: Characters of text in a task's trie at a time, before the shuffle; and in a range, about, after it.
PORTION, RANGE = 32 << 20, 64 << 20
#: Characters of a prefix at first; a prefix with too much text under it is looked at with so many times as many.
PREFIX, LONGER = 8, 4
#: No id: later than all.
LATE = 1 << 63

ROWS = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64())])
MARKED = pa.schema([("text", pa.string()), ("size", pa.int64()), *ROWS])


def text_mask(text: str) -> int:
    """The filters of A to D that a text fails, a bit each."""
    words = _WORD.findall(text)
    capitals = text.encode("utf-8", "surrogatepass")
    capitals = len(capitals) - len(capitals.translate(None, CAPITALS))
    failed = (len(words) < MIN_WORDS, 100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words), 100 * capitals > MAX_CAPITAL_PERCENT * len(text), SIGNS.search(text) is not None)
    return sum(1 << i for i, f in enumerate(failed) if f)


class Node:
    """An edge of the trie, ``ref[start:end]``, and what hangs below it; ``rows`` are those of the text that ends here."""

    __slots__ = ("ref", "start", "end", "below", "least", "rows")

    def __init__(self, ref: str, start: int, end: int):
        self.ref, self.start, self.end = ref, start, end
        self.below: dict[str, Node] | None = None
        self.least, self.rows = LATE + 1, None


def alike(a: str, i: int, b: str, j: int, n: int) -> int:
    """How many of the ``n`` characters from ``a[i]`` and ``b[j]`` on are the same, up to the first that differ."""
    if a[i : i + n] == b[j : j + n]:
        return n
    same, step = 0, 16
    while a[i + same : i + min(n, same + step)] == b[j + same : j + min(n, same + step)]:
        same += step
        step *= 2
    high = min(n, same + step)
    while same + 1 < high:
        mid = (same + high) // 2
        if a[i + same : i + mid] == b[j + same : j + mid]:
            same = mid
        else:
            high = mid
    return same


class Trie:
    """A compressed trie of whole texts. Edges point into the texts, so characters are held once."""

    def __init__(self) -> None:
        self.root, self.size = Node("", 0, 0), 0

    def terminal(self, text: str) -> Node:
        """The node at which a text ends, made if there is none."""
        node, at, n = self.root, 0, len(text)
        while at < n:
            child = node.below.get(text[at]) if node.below else None
            if child is None:
                child = Node(text, at, n)
                if node.below is None:
                    node.below = {}
                node.below[text[at]] = child
                self.size += n - at
                return child
            length = child.end - child.start
            same = alike(text, at, child.ref, child.start, min(length, n - at))
            if same < length:
                fork = Node(child.ref, child.start, child.start + same)
                node.below[text[at]] = fork
                child.start += same
                fork.below = {child.ref[child.start] : child}
                child = fork
            node, at = child, at + same
        return node

    def add(self, node: Node, key: int, row: tuple) -> None:
        if node.rows is None:
            node.rows = []
            self.size += 64
        node.least = min(node.least, key)
        node.rows.append((key, *row))
        self.size += 16

    def terminals(self) -> Iterator[tuple[str, Node]]:
        """(text, node) of every text inserted, by a walk over the trie."""
        todo = [self.root]
        while todo:
            node = todo.pop()
            if node.rows is not None:
                # an edge ends as far into the text it points to as it lies below the root
                yield node.ref[: node.end], node
            if node.below:
                todo.extend(node.below.values())


def _key(doc_id: int | None) -> int:
    return LATE if doc_id is None else doc_id


def _id(key: int) -> int | None:
    return None if key == LATE else key


def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Masks of a task's rows: with their text those that no smaller id in the portion has, without it the copies."""

    def found(trie: Trie) -> Iterator[pa.RecordBatch]:
        out = []
        for text, node in trie.terminals():
            mask = node.rows[0][2]
            counts: dict[tuple, int] = {}
            for key, part, _ in node.rows:
                counts[key, part] = counts.get((key, part), 0) + 1
            for (key, part), n in counts.items():
                first = key == node.least
                out.append((text if first else None, len(text) + 64 if first else 0, _id(key), part, mask if first else mask | COPY, n))
            if len(out) >= 1000:
                yield _batch(out, MARKED)
                out = []
        yield _batch(out, MARKED)

    trie = Trie()
    for batch in batches:
        for doc_id, text, part in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part"))):
            node = trie.terminal(text)
            mask = node.rows[0][2] if node.rows else text_mask(text)
            trie.add(node, _key(doc_id), (part, mask))
            if trie.size >= PORTION:
                yield from found(trie)
                trie = Trie()
    yield from found(trie)


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same for a range of texts from all tasks: every row is a copy but those of the least id."""
    trie = Trie()
    for batch in batches:
        for text, *row in zip(*(batch.column(c).to_pylist() for c in ("text", "doc_id", "part", "mask", "n"))):
            trie.add(trie.terminal(text), _key(row[0]), tuple(row[1:]))
    out = []
    for _, node in trie.terminals():
        out.extend((_id(key), part, mask | COPY if key > node.least else mask, n) for key, part, mask, n in node.rows)
        if len(out) >= 10_000:
            yield _batch(out, ROWS)
            out = []
    yield _batch(out, ROWS)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _under(depth: int) -> Column:
    return F.xxhash64(F.substring("text", 1, depth))


def by_prefix(open_: DataFrame, ranges: int) -> DataFrame:
    """Deals texts into ``ranges`` ranges by their first characters and by a prefix with little text under it.

    A prefix that holds over a quarter of a range is heavy, of which there are at most four a range; only
    texts under heavy ones are looked at with a longer prefix. A text that ends within its prefix stays.
    """
    total = open_.agg(F.sum("size")).first()[0] or 0
    share, depth, keyed = max(1, total // (4 * ranges)), PREFIX, open_.withColumn("_depth", F.lit(PREFIX))
    while True:
        longer = F.length("text") > depth
        sizes = keyed.filter((F.col("_depth") == depth) & longer).groupBy(_under(depth).alias(f"_h{depth}")).agg(F.sum("size").alias("size"))
        heavy = stored(sizes.filter(F.col("size") > share).select(f"_h{depth}"), "heavy")
        if heavy.isEmpty():
            break
        seen = F.broadcast(heavy.withColumn("_heavy", F.lit(True)))
        keyed = keyed.withColumn(f"_h{depth}", F.when((F.col("_depth") == depth) & longer, _under(depth))).join(seen, f"_h{depth}", "left")
        keyed = keyed.withColumn("_depth", F.when(F.col("_heavy"), depth * LONGER).otherwise(F.col("_depth"))).drop("_heavy", f"_h{depth}")
        depth *= LONGER
    key = F.xxhash64(F.expr("substring(text, 1, _depth)"))
    return keyed.withColumns({"_first": F.substring("text", 1, PREFIX), "_key": key}).repartitionByRange(ranges, "_first", "_key").select(*open_.columns)


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, n): the filters that each document fails on its own, bit i for the i-th letter of FILTERS.

    ``n`` counts rows that are the same in all of these.
    """
    spark = docs.sparkSession
    text_batches(spark)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))
    marked = stored(plain.mapInArrow(mark, "text string, size long, doc_id long, part string, mask int, n long"), "marked")
    open_ = marked.filter("text IS NOT NULL")
    size = open_.agg(F.sum("size")).first()[0] or 0
    ranges = max(partitions(spark), -(-size // RANGE))
    settled = by_prefix(open_, ranges).select("text", "doc_id", "part", "mask", "n").mapInArrow(settle, "doc_id long, part string, mask int, n long")
    both = settled.unionByName(marked.filter("text IS NULL").select("doc_id", "part", "mask", "n"))
    return both.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))


def orders() -> list[tuple[str, int, int, int]]:
    """(order, step, filter bit, bits of the filters before it) of every step of every order."""
    return [(order := "".join(p), i + 1, 1 << FILTERS.index(p[i]), sum(1 << FILTERS.index(f) for f in p[:i])) for p in permutations(FILTERS) for i in range(len(p))]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order and step, with what its filter does there."""
    spark = docs.sparkSession
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    counted = failures(docs).join(known, "doc_id", "left").groupBy("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(F.sum("n").alias("n"))
    # a filter and the set of those before it: 80 pairs, whatever the order within the set
    pairs = sorted({(bit, before) for _, _, bit, before in orders()})
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("bit"), F.lit(s).alias("before")) for b, s in pairs]))
    rows = counted.select("*", each.alias("at")).select("part", "mask", "good", "toxic", "n", "at.bit", "at.before")
    fails, early = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(F.lit(0))).cast("long")
    per = rows.groupBy("part", "bit", "before").agg(
        count(~fails & ~early).alias("kept"), count(fails & ~early).alias("removed"), count(fails & early).alias("redundant"), count(F.col("mask") == F.col("bit")).alias("unique_fails"),
        count(fails & ~early & (F.col("good") == 1)).alias("good_lost"), count(fails & ~early & (F.col("toxic") == 1)).alias("toxic_lost"),
    )
    # so many orders have just this set before the filter
    times = F.create_map(*[F.lit(x) for s in {before for _, before in pairs} for x in (s, factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count()))])
    shares = per.groupBy("part", "bit").agg(F.sum(F.col("removed") * times[F.col("before")]).cast("long").alias("shapley"))
    steps = spark.createDataFrame(orders(), "filter_order string, step int, bit int, before int")
    out = per.join(F.broadcast(steps), ["bit", "before"]).join(shares, ["part", "bit"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
