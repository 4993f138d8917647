"""Approximate nearest neighbours by inner product over balanced posting lists.

Inner product becomes distance by one more component that gives all vectors the greatest norm. A bounded
sample is split by balanced k-means into as many lists as the table needs; each list's centroid is a node
of a neighbour graph, which every task holds in memory and searches by beam. A vector goes to its nearest
list and to others nearly as near (boundary vectors), a query to all lists within a distance ratio of its
nearest. The ratio is set on the sample, so that exact neighbours there are found with the wanted recall.

Lists are cut into blocks of vectors and of queries, each pair of blocks is one small matrix product, and
the best of all blocks are merged by query. Of equal vectors only the ``k`` + 1 smallest ids stand in the
lists: a query's answer cannot hold another, so a vector repeated without bound costs no more than that.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part, nor do rows without id; rows that share an id are one vector. Fewer than k candidates: all of them.
Products beyond the range of doubles are infinite, or not a number and then the farthest.
Ties go to the smaller id. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import hash_key, partitions, stored

K, EVERY = 20, 20
#: Vectors of the sample that the index is fitted on; vectors wanted in a list; lists at most.
SAMPLE, LIST, MOST_LISTS = 20_000, 512, 2048
#: A vector stands in up to COPIES lists within NEAR times its least distance.
COPIES, NEAR = 3, 1.05
#: Recall on the sample that sets the ratio of a query's lists; lists that the graph search keeps in sight.
RECALL, BEAM = 0.97, 512
BLOCK, QUERIES = 4096, 1024


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def balanced(x: np.ndarray, leaves: int, rng: np.random.Generator, ways: int = 8) -> np.ndarray:
    """Centroids of about ``leaves`` groups of like size, by k-means split again where a group is large."""
    todo, done, most = [np.arange(len(x))], [], max(1, -(-len(x) // leaves))
    while todo:
        at = todo.pop()
        if len(at) <= most * 1.3 or len(at) < 2:
            done.append(x[at].mean(axis=0))
            continue
        k = int(min(ways, max(2, round(len(at) / most)), len(at)))
        c, room = x[rng.choice(at, k, replace=False)], -(-len(at) * 5 // (4 * k))
        for _ in range(6):
            d = _distances(x[at], c)
            # nearest first, but no group above its room: the rest take their next choice
            own, left = np.full(len(at), -1), np.full(k, room)
            for choice in np.argsort(d, axis=1).T:
                for g in range(k):
                    want = np.flatnonzero((own < 0) & (choice == g))
                    take = want[np.argsort(d[want, g], kind="stable")[: left[g]]]
                    own[take], left[g] = g, left[g] - len(take)
            c = np.stack([x[at[own == g]].mean(axis=0) if (own == g).any() else c[g] for g in range(k)])
        todo += [at[own == g] for g in range(k) if (own == g).any()] if (np.bincount(own, minlength=k) < len(at)).all() else [at[::2], at[1::2]]
    return np.array(done, dtype=np.float32)


class Index:
    """Centroids, their neighbour graph, and the ratio that selects a query's lists."""

    def __init__(self, sample: np.ndarray, total: int, norm2: float, k: int = K, seed: int = 9, scale: float = 1.0):
        """``norm2`` is the greatest squared norm of the vectors times ``scale``, which brings them into the range of float32."""
        rng = np.random.default_rng(seed)
        self.norm2, self.scale = norm2, scale
        sample = sample * scale
        x = self.raised(sample)
        self.centroids = balanced(x, int(np.clip(-(-total // LIST), 1, min(MOST_LISTS, len(x)))), rng)
        d = _distances(self.centroids, self.centroids)
        # sixteen nearest and four at random: the latter keep the graph in one piece
        near = np.argsort(d, axis=1)[:, 1:17]
        self.graph = np.concatenate([near, rng.integers(0, len(d), (len(d), 4))], axis=1).astype(np.int32)
        self.ratio = self._ratio(sample, x, k, rng)

    def raised(self, v: np.ndarray) -> np.ndarray:
        return np.concatenate([v, np.sqrt(np.maximum(self.norm2 - (v * v).sum(axis=1), 0))[:, None]], axis=1).astype(np.float32)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(lists, distances) of a beam search of the graph for each query, nearest first."""
        n, c = len(q), self.centroids
        beam = min(beam, len(c))
        start = np.unique(np.linspace(0, len(c) - 1, min(len(c), max(8, beam // 4))).astype(np.int64))
        seen = np.zeros((n, len(c)), dtype=bool)
        seen[:, start] = True
        ids = np.tile(start, (n, 1))
        dist = _distances(q, c[start])
        opened = np.zeros(ids.shape, dtype=bool)
        for _ in range(len(c)):
            order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
            ids, dist, opened = (np.take_along_axis(m, order, 1) for m in (ids, dist, opened))
            wait = np.where(opened | ~np.isfinite(dist), np.inf, dist)
            at = np.argsort(wait, axis=1, kind="stable")[:, :4]
            live = np.isfinite(np.take_along_axis(wait, at, 1))
            if not live.any():
                break
            np.put_along_axis(opened, at, True, 1)
            new = self.graph[np.take_along_axis(ids, at, 1)].reshape(n, -1).astype(np.int64)
            fresh = np.repeat(live, self.graph.shape[1], axis=1) & ~np.take_along_axis(seen, new, 1)
            # of one list named twice in a row, the first counts
            order = np.argsort(new, axis=1, kind="stable")
            in_order = np.take_along_axis(new, order, 1)
            again = np.zeros(new.shape, dtype=bool)
            np.put_along_axis(again, order[:, 1:], in_order[:, 1:] == in_order[:, :-1], 1)
            fresh &= ~again
            rows, cols = np.nonzero(fresh)
            seen[rows, new[rows, cols]] = True
            far = np.full(new.shape, np.inf, dtype=np.float32)
            far[rows, cols] = np.sqrt(((q[rows] - c[new[rows, cols]]) ** 2).sum(axis=1))
            ids, dist = np.concatenate([ids, new], 1), np.concatenate([dist, far], 1)
            opened = np.concatenate([opened, np.zeros(new.shape, dtype=bool)], 1)
        return ids, dist

    def homes(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of every list a vector stands in."""
        ids, dist = self.search(self.raised(v), 4 * COPIES + 4)
        ok = (dist[:, :COPIES] <= NEAR * dist[:, :1]) & np.isfinite(dist[:, :COPIES])
        rows, cols = np.nonzero(ok)
        return rows, ids[rows, cols]

    def asked(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of every list a query reads."""
        q = np.concatenate([q, np.zeros((len(q), 1))], axis=1).astype(np.float32)
        ids, dist = self.search(q, BEAM)
        ok = (dist <= self.ratio * dist[:, :1]) & np.isfinite(dist)
        rows, cols = np.nonzero(ok)
        lists = ids[rows, cols]
        # a beam that the ratio fills may have left lists out: those queries look at every centroid
        full = np.flatnonzero(ok.all(axis=1)) if ok.shape[1] < len(self.centroids) else np.zeros(0, np.int64)
        if len(full):
            d = _distances(q[full], self.centroids)
            more, every = np.nonzero(d <= self.ratio * np.minimum(dist[full, :1], d.min(axis=1, keepdims=True)))
            rest = ~np.isin(rows, full)
            rows, lists = np.concatenate([rows[rest], full[more]]), np.concatenate([lists[rest], every])
        return rows, lists

    def _ratio(self, sample: np.ndarray, x: np.ndarray, k: int, rng: np.random.Generator) -> float:
        """The least ratio by which sampled queries find their exact neighbours in the sample."""
        at = rng.choice(len(sample), min(256, len(sample)), replace=False)
        s = sample[at] @ sample.T
        s[np.arange(len(at)), at] = -np.inf
        best = np.argsort(-s, axis=1)[:, : min(k, len(sample) - 1)]
        if not best.shape[1]:
            return 1.0
        q = np.concatenate([sample[at], np.zeros((len(at), 1))], axis=1).astype(np.float32)
        to = _distances(q, self.centroids)
        need = np.full(best.shape, np.inf)
        # in portions, as in tasks: a search holds its beams in memory
        found = [self.homes(sample[lo : lo + 1024]) for lo in range(0, len(sample), 1024)]
        rows = np.concatenate([r + 1024 * k for k, (r, _) in enumerate(found)])
        lists = np.concatenate([f[1] for f in found])
        by_row = np.split(lists, np.searchsorted(rows, np.arange(1, len(sample))))
        for i in range(len(at)):
            for j, b in enumerate(best[i]):
                need[i, j] = to[i, by_row[b]].min() / max(to[i].min(), 1e-9)
        return float(np.quantile(need, RECALL)) + 1e-6


def _rows(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _spread(shared, query: bool):
    """(list, id, v) of each list that a vector stands in, or that a query reads."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows, lists = (index.asked if query else index.homes)(_rows(part.column("v")) * index.scale)
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), part.column("vec_id").take(at), part.column("v").take(at)], names=["list", "id", "v"])

    return spread


def best_of(ids: np.ndarray, v: np.ndarray, asked: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, list[int], list[float]]]:
    """For each query the k nearest of one block, with scores that do not depend on the block."""
    ids, first = np.unique(ids, return_index=True)
    v = v[first]
    with np.errstate(over="ignore", invalid="ignore"):
        rough = np.nan_to_num(q @ v.T, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
    rough[asked[:, None] == ids[None, :]] = -np.inf
    out = []
    for i, query in enumerate(asked.tolist()):
        m = min(k, len(ids))
        bar = np.partition(rough[i], len(ids) - m)[len(ids) - m]
        at = np.flatnonzero((rough[i] >= bar - 1e-9 * (1 + abs(bar)) if np.isfinite(bar) else np.full(len(ids), True)) & (ids != query))
        with np.errstate(over="ignore", invalid="ignore"):
            score = (v[at] * q[i]).sum(axis=1)
        order = np.lexsort((ids[at], -score))[:k]
        if len(order):
            out.append((query, ids[at][order].tolist(), score[order].tolist()))
    return out


def _found(rows: list[tuple[int, list[int], list[float]]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=["query_id", "ids", "scores"])


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows of one key each, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        k = np.stack([b.column(c).to_numpy() for c in keys])
        cuts = [0, *(np.flatnonzero((np.diff(k) != 0).any(axis=0)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                now = tuple(k[:, lo])
                if held and now != last:
                    yield pa.Table.from_batches(held)
                    held = []
                last = now
                held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _searched(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["list", "vb", "qb"]):
            asks = t.column("asks").to_numpy()
            ids, v = t.column("id").to_numpy(), _rows(t.column("v"))
            if asks.any() and not asks.all():
                yield _found(best_of(ids[~asks], v[~asks], ids[asks], v[asks], k))

    return search


def _merged(k: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["query_id"]):
            ids, scores = (t.column(c).combine_chunks().flatten().to_numpy() for c in ("ids", "scores"))
            ids, first = np.unique(ids, return_index=True)
            scores = scores[first]
            order = np.lexsort((ids, -scores))[:k]
            n = len(order)
            yield pa.RecordBatch.from_arrays([pa.array([t.column("query_id")[0].as_py()] * n, pa.int64()), pa.array(np.arange(1, n + 1, dtype=np.int32)), pa.array(ids[order]), pa.array(scores[order])], names=["query_id", "rank", "vec_id", "score"])

    return merge


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).filter(ok)
    rows = rows.filter(F.exists("v", lambda x: x != 0))
    most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == F.lit(most["n"] if most else 0))


def search(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each query (ids divisible by ``every``)."""
    spark = vectors.sparkSession
    n = partitions(spark)
    rows = stored(valid(vectors), "vectors")
    total, top = rows.agg(F.count("*"), F.max(F.array_max(F.transform("v", F.abs)))).first()
    empty = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], empty)
    # a power of two, so that no digit is lost; the greatest component comes to lie between a half and one
    scale = 2.0 ** min(1000, -math.frexp(top)[1])
    norm2 = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x * F.lit(scale)) * (x * F.lit(scale))))).first()[0]
    sample = rows.orderBy(hash_key(9, F.col("vec_id")), "vec_id").limit(SAMPLE).select("v").toArrow().column("v")
    index = Index(_rows(sample), total, norm2, k, scale=scale)
    shared = spark.sparkContext.broadcast(index)
    # of equal vectors, the k + 1 smallest ids; each task drops the others before the shuffle
    few = rows.withColumn("_n", F.row_number().over(W.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id"))).filter(F.col("_n") <= k + 1)
    posted = stored(few.select("vec_id", "v").mapInArrow(_spread(shared, False), "list int, id long, v array<double>"), "postings")
    asked = rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    asked = stored(asked.select("vec_id", "v").mapInArrow(_spread(shared, True), "list int, id long, v array<double>"), "asked")

    def blocks(df: DataFrame, size: int):
        """Blocks of each list: as many numbers as there are lists, 2048 or so at most."""
        count = {r["list"]: r["count"] for r in df.groupBy("list").count().collect()}
        return F.element_at(F.array(*[F.lit(-(-count.get(i, 1) // size)) for i in range(len(index.centroids))]), F.col("list") + 1)

    vb, qb = blocks(posted, BLOCK), blocks(asked, QUERIES)
    own = lambda m: F.pmod(F.xxhash64("id", F.lit(3)), m).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), m - 1))
    left = posted.select("list", own(vb).alias("vb"), each(qb).alias("qb"), F.lit(False).alias("asks"), "id", "v")
    right = asked.select("list", each(vb).alias("vb"), own(qb).alias("qb"), F.lit(True).alias("asks"), "id", "v")
    found = left.union(right).repartition(n, "list", "vb", "qb").sortWithinPartitions("list", "vb", "qb").mapInArrow(_searched(k), "query_id long, ids array<long>, scores array<double>")
    return found.repartition(n, "query_id").sortWithinPartitions("query_id").mapInArrow(_merged(k), empty)
