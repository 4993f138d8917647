"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set is its distinct runs of five lower-cased words. Its sketch is the k least hashes of the
set, which is the whole set where it has no more: 48 to find who may be alike, and 4096, for those who
may, to tell whether they are.

1. Documents of the same words (128 bits of a cryptographic digest) become one class, known by its smallest
   id; only classes go on.
2. Inverted lists of the retained values give how many classes retain each value. Two sets of Jaccard
   similarity 0.85 (``percent``; the pipeline links from 0.80) retain at least ``_shared`` of 48 values in common (six standard deviations below
   the mean), so in the order rarest first they share one of the first 48 - shared + 1. A class
   whose values are mostly its own can have no partner and ends here; the others stand in the lists of
   those first values alone, and lists of the same classes are one.
3. Those who stand in lists are read again for the larger sketch. A list of up to a block's size is a task's
   small matrix product. A longer one is cut into blocks, each of which takes in the list's pivots, a few
   members drawn by hash; what the pivots join needs no further look. Only members outside the list's largest
   component so far then meet all its blocks, where they are no more than a block. Where they are more, the list's
   members have a passage in common rather than being alike (a licence, a frame): they are listed anew by
   their first 512 values, as in step 2, and meet in those lists. The union-sketch estimate (exact where both sketches are whole
   sets) drops pairs more than six standard deviations below the threshold: one linked pair in a thousand
   million. Of pairs that are sure to be linked a block gives a spanning forest; of those in doubt, all between
   different trees. So a group of copies gives about as many rows as it has members.
4. Pairs with a larger set than the sketch are confirmed on the full sets. Where a forest's estimated edge
   fails that, the pairs of its block are taken anew without estimates, all confirmed. Links are merged to
   components by rounds of neighbour-minimum and pointer jumping over stored tables.

Nulls and empty texts have an empty set and no links. Each row without an id is a document of its own after
all others. Rows that share an id are compared as texts of their own, and all answer to the one id: the
smallest id of a component is taken over the rows' ids. Ties: a component is known by its smallest id (null,
where none of its rows has one). Empty table: no rows. Texts of any length are read whole. Other columns,
whatever their names, are ignored by :func:`components` and carried along by :func:`keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, keyed, partitions, stored, text_batches, with_group
from .shingles import Words, digests, portions

#: The least Jaccard similarity of a link, in percent, unless the caller names another.
SHINGLE, PERCENT = 5, 85
SKETCH, LISTED, BLOCK = 4096, 48, 512
#: Values that take the place of the LISTED where a long list's members are mostly not linked.
WIDE = 512
#: Members of a long list that all its blocks take in, about.
PIVOTS = 16
#: Standard deviations of an estimate that a pair may lie below (or must lie above) the threshold.
SIGMAS = 6
EXACT, SURE, DOUBT = 0, 1, 2


def _shared(n: Column, percent: int = PERCENT, listed: int = LISTED) -> Column:
    """Values among the first ``listed`` of a set of n that any linked set retains among its own first."""
    p, k = percent / 100, F.least(n, F.lit(listed))
    slack = SIGMAS * F.sqrt(k * F.lit(p * (1 - p)) * (1 - k / n / 2))
    # of so small a set the partner's sketch is its whole set
    return F.when(n * 100 <= percent * listed, F.ceil(n * percent / 100)).otherwise(F.greatest(F.lit(1), F.floor(k * F.lit(p) - slack))).cast("int")


def _sets(column: pa.Array, low: np.ndarray | None = None) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; of fewer words, the digest of all (or of ``low``, if it is known)."""
    w = Words(column, 1, fold=True)
    grams = w.runs(SHINGLE)
    if low is None and (np.diff(w.bounds) < SHINGLE).any():
        low = digests(column, fold=True)[1]
    out = []
    for i, (a, b) in enumerate(zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist())):
        out.append(np.unique(grams[a : b - SHINGLE + 1]) if b - a >= SHINGLE else low[i : i + 1][: b - a].view(np.uint64))
    return out


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in portions(batch, "text"):
            _, a, b = digests(part.column("text"), fold=True)
            sets = _sets(part.column("text"), a)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(a), pa.array(b), pa.array([s[:LISTED].view(np.int64) for s in sets], pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "a", "b", "low"],
            )


def _full(most: int | None):
    """(_id, n_shingles, sketch) with at most so many of the least hashes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "text"):
                sets = _sets(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s[:most].tobytes() for s in sets], pa.binary())], names=["_id", "n_shingles", "sketch"])

    return read


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over a stretch of values at a time."""
    values, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    column = np.cumsum(count > 1) - 1
    keep = count[place] > 1
    owner, place = owner[keep], column[place[keep]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for lo in range(0, int(place[-1]) + 1 if len(place) else 0, 4096):
        a, b = np.searchsorted(place, (lo, lo + 4096))
        m = np.zeros((len(sets), min(4096, int(place[-1]) + 1 - lo)), dtype=np.float32)
        m[owner[a:b], place[a:b] - lo] = 1
        out += m @ m.T
    return out.astype(np.int64)


def _trees(linked: np.ndarray) -> np.ndarray:
    """The first member of each member's tree under a symmetric relation."""
    root = np.full(len(linked), -1)
    for i in range(len(linked)):
        if root[i] < 0:
            front = np.zeros(len(linked), dtype=bool)
            front[i] = True
            reached = front.copy()
            while front.any():
                front = linked[front].any(axis=0) & ~reached
                reached |= front
            root[reached] = i
    return root


def block_pairs(ids: np.ndarray, side: np.ndarray, n: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT, trust: bool = True) -> list[tuple[int, int, int]]:
    """(x, y, kind): sure links as a forest, EXACT or SURE (by estimate), and pairs in DOUBT between its trees.

    ``side`` tells which of the two blocks of the pair a member stands in; 2 if it is one block. Without
    ``trust`` no estimate is sure, so all pairs that may be linked are in doubt.
    """
    shared = _overlaps(sets)
    whole = n <= SKETCH
    last = np.array([np.uint64((1 << 64) - 1) if w else s[-1] for s, w in zip(sets, whole)], dtype=np.uint64)
    # how many of i's retained values lie within j's reach; both sides count up to the lesser reach
    within = np.stack([np.searchsorted(s, last, side="right") for s in sets])
    own = within.diagonal()
    lesser = last[:, None] <= last[None, :]
    union = np.where(lesser, own[:, None] + within.T, within + own[None, :]) - shared
    estimate = shared / np.maximum(union, 1)
    both = whole[:, None] & whole[None, :]
    t = percent / 100
    slack = SIGMAS * np.sqrt(t * (1 - t) / np.maximum(union, 1))
    exact = both & (100 * shared >= percent * union) & (union > 0)
    likely = ~both & (estimate >= t - slack) & (100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :]))
    other = (side[:, None] != side[None, :]) | (side[:, None] == 2)
    exact, likely = exact & other, likely & other
    sure = exact | likely & (estimate >= np.minimum(1, t + slack)) if trust else exact
    root = _trees(sure)
    out = []
    seen = np.zeros(len(ids), dtype=bool)
    for r in np.unique(root):
        front = np.array([r])
        seen[r] = True
        while len(front):
            reach = sure[front]
            new = np.flatnonzero(reach.any(axis=0) & ~seen)
            for v in new.tolist():
                u = front[int(reach[:, v].argmax())]
                out.append((int(ids[u]), int(ids[v]), EXACT if exact[u, v] else SURE))
            seen[new] = True
            front = new
    x, y = np.nonzero(np.triu(likely & ~sure & (root[:, None] != root[None, :]), 1))
    out += [(int(ids[i]), int(ids[j]), DOUBT) for i, j in zip(x, y)]
    return [(min(a, b), max(a, b), s) for a, b, s in out if a != b]


def _blocks(percent: int, trust: bool):
    """Reads rows sorted by (list, i, j) and compares the members of each such pair of blocks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(rows: list[pa.RecordBatch]) -> list[tuple[int, ...]]:
            t = pa.Table.from_batches(rows)
            _, first = np.unique(t.column("doc_id").to_numpy(), return_index=True)
            if len(first) < 2:
                return []
            t = t.take(first)
            i, j, own = (t.column(c).to_numpy() for c in ("i", "j", "own"))
            found = block_pairs(t.column("doc_id").to_numpy(), np.where(i == j, 2, own == i), t.column("n_shingles").to_numpy(), [np.frombuffer(s, np.uint64) for s in t.column("sketch").to_pylist()], percent, trust)
            return [(*f, *key) for f in found]

        def batch(found: list[tuple[int, ...]]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(kinds)], names=["x", "y", "kind", "list", "i", "j"])

        held: list[pa.RecordBatch] = []
        key, out = None, []
        for b in batches:
            k = np.stack([b.column(c).to_numpy() for c in ("list", "i", "j")])
            cuts = [0, *(np.flatnonzero((np.diff(k) != 0).any(axis=0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                if (now := tuple(k[:, lo].tolist())) != key and held:
                    out += compared(held)
                    held = []
                key = now
                held.append(b.slice(lo, hi - lo))
            if len(out) > 50_000:
                yield batch(out)
                out = []
        if held:
            out += compared(held)
        yield batch(out)

    return read


def _confirmed(percent: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for s, t in zip(b.column("set_x").to_pylist(), b.column("set_y").to_pylist()):
                s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y"), pa.array(ok, pa.bool_())], names=["x", "y", "linked"])

    return read


def merged(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of stored links (x, y): root is the smallest node reachable."""
    edges = links.select("x", "y").union(links.select(F.col("y"), F.col("x")))
    label = stored(edges.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("root")), "labels")
    while True:
        # the least root among a node's neighbours, then the root of that root
        roots = label.select("node", "root")
        near = edges.join(roots, edges["y"] == roots["node"]).groupBy("x").agg(F.min("root").alias("near"))
        lower = roots.join(near, roots["node"] == near["x"]).select("node", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        # hooking: what a node learns, its old root learns too
        hooks = lower.groupBy(F.col("old").alias("_old")).agg(F.min("root").alias("_hook"))
        lower = lower.join(hooks, lower["root"] == hooks["_old"], "left").select("node", F.least("root", F.coalesce("_hook", "root")).alias("root"), "old")
        up = lower.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        new = stored(lower.join(up, lower["root"] == up["_n"], "left").select("node", F.least("root", F.coalesce("_r", "root")).alias("root"), "old"), "labels")
        dropped(label)
        if new.filter("root <> old").isEmpty():
            return new.select("node", "root")
        label = new


def _first_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_shingles, low) of sketches, with their first WIDE values."""
    for b in batches:
        low = [np.frombuffer(s, np.int64)[:WIDE] for s in b.column("sketch").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("n_shingles"), pa.array(low, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "low"])


def _lists(reps: DataFrame, percent: int, values: int = LISTED) -> DataFrame:
    """(list, doc_id, members) of classes that may have a partner; lists of two or more, each set of members once."""
    rows = reps.select("doc_id", F.explode("low").alias("value"))
    common = rows.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    held = rows.join(common, "value").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("v"))
    held = held.join(reps.select("doc_id", F.col("n_shingles").alias("n")), "doc_id")
    # of the first places, those of values that no other class retains come first and need no list
    need, size = _shared(F.col("n"), percent, values), F.least("n", F.lit(values))
    room = (size - need + 1) - (size - F.size("v"))
    listed = held.withColumn("room", room.cast("int")).filter("room > 0").select("doc_id", F.explode(F.slice("v", F.lit(1), F.col("room"))).alias("e")).select("doc_id", F.col("e.value").alias("list"))
    listed = stored(listed, "listed")
    sizes = listed.groupBy("list").agg(F.count("*").alias("members"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("print")).filter("members > 1")
    once = sizes.groupBy("members", "print").agg(F.min("list").alias("list")).select("list", "members")
    return with_group(listed, once, ["list"], "members", listed.count())


def _pairs_of(docs: DataFrame, sketched: DataFrame, rows: DataFrame, percent: int, trust: bool = True) -> DataFrame:
    """Confirmed links (x, y) among the members of each (list, i, j) of ``rows``."""
    n = partitions(docs.sparkSession)
    full = rows.join(sketched, F.col("doc_id") == F.col("_id")).select("list", "i", "j", "own", "doc_id", "n_shingles", "sketch")
    found = full.repartition(n, "list", "i", "j").sortWithinPartitions("list", "i", "j").mapInArrow(_blocks(percent, trust), "x long, y long, kind int, list long, i int, j int")
    found = stored(found, "pairs")
    doubt = found.filter(F.col("kind") > EXACT).select("x", "y").distinct()
    exact = found.filter(F.col("kind") == EXACT).select("x", "y").distinct()
    if doubt.isEmpty():
        return stored(exact, "links")
    wanted = stored(doubt.select(F.col("x").alias("_w")).union(doubt.select("y")).distinct(), "wanted")
    sets = docs.join(wanted, F.col("doc_id") == F.col("_w"), "left_semi").mapInArrow(_full(None), "_id long, n_shingles long, sketch binary")
    sets = stored(sets, "sets")
    pairs = doubt.join(sets, F.col("x") == F.col("_id")).select("x", "y", F.col("sketch").alias("set_x")).join(sets, F.col("y") == F.col("_id")).select("x", "y", "set_x", F.col("sketch").alias("set_y"))
    judged = stored(pairs.mapInArrow(_confirmed(percent), "x long, y long, linked boolean"), "judged")
    links = exact.union(judged.filter("linked").select("x", "y"))
    # an estimated edge that fails may have stood for others of its block
    failed = judged.filter("not linked").select(F.col("x").alias("_x"), F.col("y").alias("_y"))
    again = stored(found.filter(F.col("kind") == SURE).join(failed, (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y"))).select(F.col("list").alias("_l"), F.col("i").alias("_a"), F.col("j").alias("_b")).distinct(), "again")
    if trust and not again.isEmpty():
        anew = rows.join(again, (F.col("list") == F.col("_l")) & (F.col("i") == F.col("_a")) & (F.col("j") == F.col("_b")), "left_semi")
        links = links.union(_pairs_of(docs, sketched, anew, percent, trust=False))
    return stored(links, "links")


def _blocks_of(n: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / F.lit(BLOCK))).cast("int")


def _drawn(salt: int, n: Column) -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(salt)), n).cast("int")


def _mains(known: DataFrame) -> DataFrame:
    """(_l, _main, _n, _rest) of the lists of (list, doc_id, root) with members outside their largest component."""
    parts = known.groupBy("list", "root").agg(F.count("*").alias("n"))
    main = parts.groupBy(F.col("list").alias("_l")).agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("all"))
    return stored(main.select("_l", F.col("m.root").alias("_main"), F.col("m.n").alias("_n"), (F.col("all") - F.col("m.n")).alias("_rest")).filter("_rest > 0"), "main")


def _of_lists(known: DataFrame, main: DataFrame) -> DataFrame:
    """``known`` of these lists, each row with its list's _main, _n and _rest."""
    return with_group(known, main.select(F.col("_l").alias("list"), "_main", "_n", "_rest"), ["list"], "_n", known.count())


def _meeting(found: DataFrame) -> DataFrame:
    """Rows for :func:`_pairs_of`: members outside the main component meet all of the list."""
    outside = F.col("root") != F.col("_main")
    of_rest, of_main = _blocks_of(F.col("_rest")), _blocks_of(F.col("_n"))
    own = F.when(outside, _drawn(8, of_rest)).otherwise(of_rest + _drawn(9, of_main))
    others = F.when(outside, F.sequence(F.lit(0), of_rest + of_main - 1)).otherwise(F.sequence(F.lit(0), of_rest - 1))
    rows = found.select("list", "doc_id", own.alias("own"), F.explode(others).alias("o"))
    return rows.select("list", "doc_id", "own", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"))


def remaining(sketched: DataFrame, long: DataFrame, joined: DataFrame, percent: int) -> DataFrame | None:
    """The rows that long lists still have to compare, once ``joined`` tells what their pivots and blocks joined.

    Where the rest outside the main component is more than a block, its members share a passage rather than
    being alike. All members of such lists are then listed anew by their first WIDE values, so that those with
    a quarter of a text of their own end here, and others meet who may be alike instead of the whole list.
    """
    root = joined.select("node", "root")
    rooted = lambda lists: stored(lists.join(root, F.col("doc_id") == F.col("node"), "left").select("list", "doc_id", F.coalesce("root", "doc_id").alias("root")), "known")
    known = rooted(long)
    main = _mains(known)
    if main.isEmpty():
        return None
    few = main.filter(F.col("_rest") <= BLOCK)
    rows = _meeting(_of_lists(known, few))
    many = main.filter(F.col("_rest") > BLOCK)
    if many.isEmpty():
        return rows
    members = stored(_of_lists(known, many).select(F.col("doc_id").alias("_m")).distinct(), "shared-passages")
    first = sketched.join(members, F.col("_id") == F.col("_m"), "left_semi").mapInArrow(_first_values, "doc_id long, n_shingles long, low array<long>")
    anew = rooted(_lists(stored(first, "first-values"), percent, WIDE))
    return rows.unionByName(_meeting(_of_lists(anew, _mains(anew))))


def links(docs: DataFrame, sketches: DataFrame, copies: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (x, y) that join the linked classes."""
    later = copies.select(F.col("doc_id").alias("_id"))
    reps = sketches.filter("n_shingles > 0").join(later, F.col("doc_id") == F.col("_id"), "left_anti")
    lists = stored(_lists(reps, percent), "lists")
    used = stored(lists.select(F.col("doc_id").alias("_u")).distinct(), "used")
    sketched = docs.join(used, F.col("doc_id") == F.col("_u"), "left_semi").mapInArrow(_full(SKETCH), "_id long, n_shingles long, sketch binary")
    sketched = stored(sketched, "sketched")
    block = _blocks_of(F.col("members"))
    rows = lists.select("list", "doc_id", _drawn(5, block).alias("own"))
    long = lists.filter(F.col("members") > BLOCK)
    pivots = long.filter(_drawn(6, F.ceil(F.col("members") / F.lit(PIVOTS))) == 0).select("list", "doc_id", F.explode(F.sequence(F.lit(0), block - 1)).alias("own"))
    rows = rows.unionByName(pivots).select("list", "doc_id", "own", F.col("own").alias("i"), F.col("own").alias("j"))
    first = _pairs_of(docs, sketched, rows, percent)
    if long.isEmpty():
        return first
    rows = remaining(sketched, long, merged(first), percent)
    return first if rows is None else stored(first.union(_pairs_of(docs, sketched, rows, percent)), "links")


def _classes(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; no id is null or shared."""
    text_batches(docs.sparkSession)
    sketches = stored(docs.mapInArrow(_sketches, "doc_id long, n_shingles long, a long, b long, low array<long>"), "sketches")
    groups = sketches.filter("n_shingles > 0").groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    copies = with_group(sketches.select("doc_id", "a", "b", "n_shingles"), groups, ["a", "b"], "copies", sketches.count())
    copies = stored(copies.filter("doc_id > first AND n_shingles > 0").select("doc_id", "first"), "copies")
    found = merged(links(docs, sketches, copies, percent))
    first = copies.select(F.col("doc_id").alias("_id"), "first")
    known = sketches.select("doc_id", "n_shingles").join(first, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "n_shingles", F.coalesce("first", "doc_id").alias("class"))
    known = stored(known, "classes")
    sizes = known.groupBy("class").agg(F.count("*").alias("n"))
    roots = found.join(sizes, F.col("node") == F.col("class")).select("class", "root", "n")
    linked = with_group(known, stored(roots, "roots"), ["class"], "n", sketches.count()).select("doc_id", "n_shingles", F.col("root").alias("component_id"))
    alone = known.join(found, F.col("class") == F.col("node"), "left_anti").select("doc_id", "n_shingles", F.col("class").alias("component_id"))
    return linked.unionByName(alone)


def _texts(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("_key").alias("doc_id"), F.coalesce("_row.text", F.lit("")).alias("text"))


def components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    rows, first = keyed(docs.select("doc_id", "text"), apart=True)
    out = _classes(_texts(rows), percent)
    if first is not None:
        # some keys are not ids: a component goes by the least id of its rows
        ids = rows.select(F.col("_key"), F.col("_row.doc_id").cast("long").alias("_own"))
        out = stored(out.join(ids, F.col("doc_id") == F.col("_key")).drop("_key"), "by-key")
        named = stored(out.groupBy("component_id").agg(F.min("_own").alias("_least"), F.count("*").alias("_n")), "named")
        out = with_group(out, named, ["component_id"], "_n", out.count()).select(F.col("_own").alias("doc_id"), "n_shingles", F.col("_least").alias("component_id"), (F.col("doc_id") == F.col("component_id")).alias("_one"))
        return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull() & F.col("_one")).alias("kept"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents less all but one of each group: a row goes only because its text is near another's."""
    rows, _ = keyed(docs, apart=True)
    found = _classes(_texts(rows), percent)
    gone = stored(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")), "gone")
    left = rows.join(gone, F.col("_key") == F.col("_gone"), "left_anti")
    return left.select(*[F.col("_row").getField(n).alias(n) for n in docs.columns])
