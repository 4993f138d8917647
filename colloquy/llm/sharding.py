"""Sharding by a hierarchical weighted hash tree, natively.

A topology is a tree region > rack > shard. A row descends it: at each level every child draws
-ln(u) / weight from a hash of (doc_id, child), and the least draw wins, so a child is chosen in
proportion to its weight (the number of shards below it). When the weight of a child changes, no draw of
another child changes: rows move into or out of that subtree only.

Law ``key``: doc_id and the shard count decide. The first ``capacity`` shards fill the base tree; each
one more opens a region of its own, so it can only take rows, and only into itself. That holds at the
base tree's size and above; below it the tree is cut off at the shard count, and a shard that joins a
rack that is not full can move rows within that rack too.

Nulls: a null doc_id hashes as a key of its own; a null text has no bytes and the CRC of none. Repeated
rows land on one shard and get different slots, as do texts of one id; which of them gets which is of no
matter where they are alike. Texts of any length are read whole. Other columns, whatever their names, are
ignored. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import range_bits, hash_key, partitions, prefix_sums, stored

TREE = (2, 4, 5)
SHARDS = 40


def topology(n_shards: int, tree: tuple[int, int, int] = TREE) -> list[list[list[int]]]:
    """Regions of racks of shards for a shard count."""
    regions, racks, size = tree
    base = min(n_shards, regions * racks * size)
    out = [[[s for s in range((r * racks + k) * size, (r * racks + k + 1) * size) if s < base] for k in range(racks)] for r in range(regions)]
    out = [[rack for rack in region if rack] for region in out]
    return [r for r in out if r] + [[[s]] for s in range(base, n_shards)]


def _draw(key: Column, level: str, child: int, weight: int) -> Column:
    """An exponential draw of rate ``weight``; 53 bits of hash give u in (0, 1)."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(level), F.lit(child)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.ln(u) / float(weight)


def _least(draws: list[Column]) -> Column:
    """Position of the least draw."""
    if len(draws) == 1:
        return F.lit(0)
    return (F.array_position(F.array(*draws), F.array_min(F.array(*draws))) - 1).cast("int")


def _descend(df: DataFrame, key: str, n_shards: int, out: str, tree: tuple[int, int, int]) -> DataFrame:
    """Adds the shard in three steps, so that a row draws only among the children of the node it reached."""
    regions = topology(n_shards, tree)
    weight = lambda node: sum(map(len, node)) if isinstance(node[0], list) else len(node)
    df = df.withColumn("_region", _least([_draw(F.col(key), "region", i, weight(r)) for i, r in enumerate(regions)]))
    rack = F.lit(None).cast("int")
    for i, r in enumerate(regions):
        rack = F.when(F.col("_region") == i, _least([_draw(F.col(key), f"rack{i}", j, weight(k)) for j, k in enumerate(r)])).otherwise(rack)
    df = df.withColumn("_rack", rack)
    # a rack's shards draw by their own number; the node only offers its list
    lists = F.create_map(*[c for i, r in enumerate(regions) for j, k in enumerate(r) for c in (F.lit(i * 1_000_000 + j), F.array(*[F.lit(s) for s in k]))])
    shards = F.element_at(lists, F.col("_region") * 1_000_000 + F.col("_rack"))
    draws = F.transform(shards, lambda s: F.struct((-F.ln((F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit("shard"), s), 11).cast("double") + 0.5) / float(1 << 53))).alias("draw"), s.alias("shard")))
    return df.withColumn(out, F.array_min(draws).getField("shard").cast("int")).drop("_region", "_rack")


def shard_by_key(docs: DataFrame, n_shards: int = SHARDS, tree: tuple[int, int, int] = TREE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (the shard if there were one more)."""
    spark = docs.sparkSession
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select("doc_id", (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).cast("long").alias("text_crc32"))
    rows = _descend(_descend(rows, "doc_id", n_shards, "shard", tree), "doc_id", n_shards + 1, "grown_shard", tree)
    rows = stored(rows.withColumn("key", hash_key(8, F.col("doc_id"))).withColumn("one", F.lit(1)), "shards")
    n = rows.count()
    bits = range_bits(max(1, n // n_shards), n, partitions(spark))
    out = prefix_sums(rows, ["shard"], "key", ["doc_id", "text_crc32", "size"], {"slot": "one"}, bits)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
