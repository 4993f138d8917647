"""Short codes of vectors: each of eight parts becomes the number of its nearest codebook entry.

Components are integers, floor(4096 x). The codebook of a part starts as that part of the 16 vectors of
least id and is refined in six rounds: a job over all vectors assigns each part to its nearest entry, adds
up the parts of each entry in the task, and Spark adds up the tasks' sums. Only those reach the driver, a
number for each entry and place. Sums are exact: they leave a task in pieces of 30 bits.

The nearest entry comes from a geometric near-neighbour access tree (GNAT) over a part's entries. A node
holds split points, each with a subtree of the entries nearest to it, and for every split point the range of
its distances to each subtree. A query's distance to one split point rules a whole subtree out where every
entry of its range must be strictly farther than the best so far; roots are rounded so that this errs to
the safe side, and what is left is compared in integers, with ties to the lower entry.

Vectors that are null or hold null or non-finite components are left out, as are those of another length
than most have (of lengths equally frequent, the greater), without components, or of a length that eight does not divide. Fewer
than 16 vectors give as many entries. Equal ids are rows of their own, in order of their components; a null
id comes last. Null labels count as equal. Components of any finite size are taken exactly; an error, or a
sum of errors, beyond a long is the greatest long. Empty table: no rows. Other columns are ignored. The
table is read once a round: pass a stored one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, with_group

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Split points of a node of the tree; rows taken at a time.
SPLITS, ROWS = 4, 2000
#: Components below this are taken as machine integers, whose squares over 2^6 components fit; others as unbounded ones.
PLAIN = 1 << 27
LONGEST = (1 << 63) - 1
#: More than the rounding error of a root in double precision, as a share of it.
SLACK = 1e-12
LIMB = 30

_isqrt = np.frompyfunc(math.isqrt, 1, 1)


def integers(x: np.ndarray) -> np.ndarray:
    """floor(4096 x), exactly: as int64, or as Python's integers if a component is large."""
    if not x.size or np.abs(x).max() < PLAIN / SCALE:
        return np.floor(x * float(SCALE)).astype(np.int64)
    # from 2^53 on a double is an integer, which may not be scaled as a double
    return np.array([[int(c) * SCALE if abs(c) >= 2.0**53 else math.floor(c * SCALE) for c in row] for row in x.tolist()], dtype=object).reshape(x.shape)


def roots(squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers not above and not below the square roots."""
    if squares.dtype == object:
        r = _isqrt(squares)
        return r, r + 1
    r = np.sqrt(squares.astype(np.float64))
    return r * (1 - SLACK), r * (1 + SLACK)


def squared(x: np.ndarray, entry: np.ndarray) -> np.ndarray:
    d = x - entry
    return (d * d).sum(axis=1)


class Gnat:
    """The tree over some entries of a codebook: split points, subtrees, and the ranges between them."""

    def __init__(self, entries: np.ndarray, at: list[int]):
        self.entries = entries
        self.splits = [at[0]]
        far = squared(entries[at], entries[at[0]])
        while len(self.splits) < min(SPLITS, len(at)):
            # the entry farthest from all split points is the next
            rest = [(far[i], -a) for i, a in enumerate(at) if a not in self.splits]
            self.splits.append(-max(rest)[1])
            far = np.minimum(far, squared(entries[at], entries[self.splits[-1]]))
        groups: list[list[int]] = [[] for _ in self.splits]
        to = [squared(entries, entries[s]) for s in self.splits]
        for a in at:
            if a not in self.splits:
                groups[min(range(len(self.splits)), key=lambda i: to[i][a])].append(a)
        self.below = [Gnat(entries, g) if g else None for g in groups]
        whole = [[s, *g] for s, g in zip(self.splits, groups)]
        self.low = [[roots(np.array([to[i][w].min()], dtype=entries.dtype))[0][0] for w in whole] for i in range(len(whole))]
        self.high = [[roots(np.array([to[i][w].max()], dtype=entries.dtype))[1][0] for w in whole] for i in range(len(whole))]

    def search(self, x: np.ndarray, rows: np.ndarray, best: np.ndarray, own: np.ndarray) -> None:
        """Betters ``best`` (squared distance) and ``own`` (entry) of the given rows of ``x``."""
        left = np.ones((len(rows), len(self.splits)), dtype=bool)
        for i, s in enumerate(self.splits):
            here = np.flatnonzero(left[:, i])
            if not len(here):
                continue
            at = rows[here]
            d = squared(x[at], self.entries[s])
            nearer = ((d < best[at]) | ((d == best[at]) & (s < own[at]))).astype(bool)
            best[at[nearer]], own[at[nearer]] = d[nearer], s
            down, up = roots(d)
            reach = roots(best[at])[1]
            for j in range(len(self.splits)):
                if j != i:
                    out = (self.low[i][j] > up + reach) | (down > self.high[i][j] + reach)
                    left[here[out.astype(bool)], j] = False
        for j, tree in enumerate(self.below):
            if tree is not None and left[:, j].any():
                tree.search(x, rows[left[:, j]], best, own)

Codebooks = list[list[list[int]]]


def nearest(codebooks: Codebooks) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """From whole integer vectors to the entries of their parts and the squared distances to them."""
    large = max((abs(c) for book in codebooks for e in book for c in e), default=0) >= PLAIN
    wide = len(codebooks[0][0]) > 64
    trees: dict[type, list[Gnat]] = {}

    def assign(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind = object if large or wide and _unsafe(x) or x.dtype == object else np.int64
        if kind not in trees:
            trees[kind] = [Gnat(np.array(book, dtype=kind), list(range(len(book)))) for book in codebooks]
        x = x.astype(kind)
        width = x.shape[1] // PARTS
        own = np.full((len(x), PARTS), ENTRIES, dtype=np.int64)
        error = np.zeros((len(x), PARTS), dtype=kind)
        for p, tree in enumerate(trees[kind]):
            part = np.ascontiguousarray(x[:, p * width : (p + 1) * width])
            first = tree.splits[0]
            best, mine = squared(part, tree.entries[first]), np.full(len(x), first, dtype=np.int64)
            tree.search(part, np.arange(len(x)), best, mine)
            own[:, p], error[:, p] = mine, best
        return own, error

    def _unsafe(x: np.ndarray) -> bool:
        most = max(int(np.abs(x).max()), *(abs(c) for book in codebooks for e in book for c in e))
        return (2 * most) ** 2 * (x.shape[1] // PARTS) >= LONGEST

    return assign


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, integer vectors) of slices of a batch."""
    for at in range(0, batch.num_rows, ROWS):
        column = batch.column("_vector").slice(at, ROWS)
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        yield at, integers(flat.reshape(len(column), -1))


def limbs(value: int) -> list[int]:
    """Pieces of 30 bits of a number, least first, each with its sign."""
    sign, value, out = (-1 if value < 0 else 1), abs(value), []
    while value:
        out.append(sign * (value & ((1 << LIMB) - 1)))
        value >>= LIMB
    return out


def _sums(codebooks: Codebooks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign, sums, counts = nearest(codebooks), {}, {}
        for batch in batches:
            for _, x in _vectors(batch):
                own, _ = assign(x)
                width = x.shape[1] // PARTS
                for p in range(PARTS):
                    part = x[:, p * width : (p + 1) * width]
                    for e in np.unique(own[:, p]).tolist():
                        mine = own[:, p] == e
                        counts[p, e] = counts.get((p, e), 0) + int(mine.sum())
                        got = [int(c) for c in part[mine].sum(axis=0)]
                        sums[p, e] = [a + b for a, b in zip(sums[p, e], got)] if (p, e) in sums else got
        rows = [(p, e, -1, i, v) for (p, e), n in counts.items() for i, v in enumerate(limbs(n))]
        rows += [(p, e, place, i, v) for (p, e), s in sums.items() for place, c in enumerate(s) for i, v in enumerate(limbs(c))]
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(("part", "entry", "place", "limb", "value"), (list(c) for c in zip(*rows)))), pa.schema([(c, pa.int32()) for c in ("part", "entry", "place", "limb")] + [("value", pa.int64())]))

    return add


def _refined(vectors: DataFrame, codebooks: Codebooks) -> Codebooks:
    """Each entry replaced by the floored mean of its parts; entries that no part is nearest to stay."""
    parts = vectors.select("_vector").mapInArrow(_sums(codebooks), "part int, entry int, place int, limb int, value long")
    sums: dict[tuple[int, int, int], int] = {}
    for r in parts.groupBy("part", "entry", "place", "limb").agg(F.sum("value").alias("value")).collect():
        at = (r["part"], r["entry"], r["place"])
        sums[at] = sums.get(at, 0) + (r["value"] << (LIMB * r["limb"]))
    return [[[sums.get((p, e, i), 0) // sums[p, e, -1] for i in range(len(entry))] if (p, e, -1) in sums else entry for e, entry in enumerate(book)] for p, book in enumerate(codebooks)]


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows whose vector counts, with it as doubles in ``_vector``."""
    broken = F.exists("_vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    rows = rows.withColumn("_vector", F.col(vector).cast("array<double>")).filter(F.col("_vector").isNotNull() & ~F.coalesce(broken, F.lit(True)))
    common = rows.groupBy(F.size("_vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    n = common["n"] if common and common["n"] % PARTS == 0 else 0
    return rows.filter((F.size("_vector") == n) & (F.lit(n) > 0))


def fit(vectors: DataFrame) -> Codebooks:
    """The codebooks after all rounds; in: vec_id and ``_vector``. None for an empty table."""
    first = vectors.select("vec_id", "_vector").orderBy(F.asc_nulls_last("vec_id"), "_vector").limit(ENTRIES).collect()
    if not first:
        return []
    start = [[int(c) for c in integers(np.array([r["_vector"]], dtype=np.float64))[0]] for r in first]
    width = len(start[0]) // PARTS
    codebooks = [[v[p * width : (p + 1) * width] for v in start] for p in range(PARTS)]
    for _ in range(ROUNDS):
        codebooks = _refined(vectors, codebooks)
    return codebooks


def digest(codebooks: Codebooks) -> str:
    return hashlib.sha256(",".join(str(c) for book in codebooks for entry in book for c in entry).encode()).hexdigest()


def coded(vectors: DataFrame, codebooks: Codebooks) -> DataFrame:
    """Adds ``code`` and ``error`` to vec_id and label."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign = nearest(codebooks)
        for batch in batches:
            codes, errors = [], []
            for _, x in _vectors(batch):
                own, error = assign(x)
                codes.extend("".join(f"{e:02x}" for e in row) for row in own.tolist())
                errors.extend(min(LONGEST, sum(row)) for row in error.tolist())
            kept = [batch.column(c) for c in ("vec_id", "label")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(codes, pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    kinds = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    return vectors.select("vec_id", "label", "_vector").mapInArrow(write, f"{kinds}, code string, error long")


def encode(rows: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each vector that counts."""
    vectors = usable(rows).select("vec_id", "label", "_vector")
    codebooks = fit(vectors)
    codes = stored((coded(vectors, codebooks) if codebooks else vectors.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))), "codes")
    # null labels are a label of their own
    codes = codes.withColumns({"_none": F.col("label").isNull(), "_label": F.coalesce(F.col("label").cast("string"), F.lit(""))})
    errors = stored(codes.groupBy("_none", "_label").agg(F.count("*").alias("_n"), F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long").alias("label_error")), "label-errors")
    total = errors.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    out = with_group(codes, errors, ["_none", "_label"], "_n", total)
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


def sql() -> str:
    """The same in SQL, a block of tables for each round, every part against every entry."""
    near = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"
    blocks = [
        "k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT vec_id, j, v[j * (len(v) // {PARTS}) + 1 : (j + 1) * (len(v) // {PARTS})] AS x FROM k, range({PARTS}) r(j))",
        f"b0 AS MATERIALIZED (SELECT j, e, x AS c FROM (SELECT j, x, row_number() OVER (PARTITION BY j ORDER BY vec_id) - 1 AS e FROM p) WHERE e < {ENTRIES})",
    ]
    for r in range(ROUNDS + 1):
        blocks.append(f"a{r} AS MATERIALIZED (SELECT vec_id, j, any_value(x) AS x, min({{'d': {near}, 'e': e}}) AS m FROM p JOIN b{r} USING (j) GROUP BY vec_id, j)")
        if r < ROUNDS:
            blocks.append(f"s{r} AS (SELECT j, m.e AS e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, (SELECT max(len(x)) + 1 FROM p)) q(i) GROUP BY ALL)")
            blocks.append(f"u{r} AS (SELECT j, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{r} GROUP BY j, e)")
            blocks.append(f"b{r + 1} AS MATERIALIZED (SELECT b.j, b.e, coalesce(u.c, b.c) AS c FROM b{r} b LEFT JOIN u{r} u ON u.j = b.j AND u.e = b.e)")
    blocks.append(f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY j, e)) AS codebooks_sha256 FROM b{ROUNDS})")
    blocks.append(f"z AS (SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY j) AS code, sum(m.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id)")
    tail = "SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM z JOIN k USING (vec_id), h"
    return "WITH " + ",\n".join(blocks) + "\n" + tail
