"""What the operators share: the word pattern, the shared folder, distributed prefix sums."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A word: anything but blank, tab, newline, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local session that names none gets one; a cluster must name its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    That cuts the lineage (a lost executor repeats reads, not the work), and gives the table a known
    size, so that Spark broadcasts it in later joins only below its own threshold.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def keyed(docs: DataFrame, apart: bool = False) -> tuple[DataFrame, int | None]:
    """(_row, _key) of every row, and the least key that is not a doc_id (None: all are).

    The key is the doc_id; rows without one get keys of their own after all ids, the last longs there are.
    With ``apart`` so do all but one of the rows that share an id, so that each row is told from every other.
    Those rows alone are stored, so that their keys stay the same however often the table is read.
    """
    row, known = F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long")
    odd, plain = docs.filter(known.isNull()), docs.filter(known.isNotNull())
    if apart:
        ids = docs.select(known.alias("_shared")).filter("_shared IS NOT NULL").groupBy("_shared").count().filter("count > 1").select("_shared")
        ids = stored(ids, "shared-ids")
        if not ids.isEmpty():
            odd = odd.unionByName(plain.join(ids, known == F.col("_shared"), "left_semi"))
            plain = plain.join(ids, known == F.col("_shared"), "left_anti")
    if odd.isEmpty():
        return docs.select(row, known.alias("_key")), None
    rows = stored(odd.select(row, F.monotonically_increasing_id().alias("_id")), "without-id")
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    before = F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # one row for each task that wrote some of them
    parts = stored(rows.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).select("_part", before.alias("_before"), "n"), "without-id-parts")
    first = (1 << 63) - 1 - parts.agg(F.sum("n")).first()[0]
    if (docs.agg(F.max(known)).first()[0] or 0) >= first:
        raise ValueError("doc_id leaves no room above it for the rows without one")
    late = rows.join(parts, part == F.col("_part")).select("_row", (F.lit(first) + F.col("_before") + place).alias("_key"))
    if apart:
        own = late.withColumn("_own", F.col("_row.doc_id").cast("long"))
        chiefs = stored(own.filter("_own IS NOT NULL").groupBy("_own").agg(F.min("_key").alias("_chief"), F.count("*").alias("_n")), "chiefs")
        led = with_group(own.filter("_own IS NOT NULL"), chiefs, ["_own"], "_n", chiefs.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0])
        late = led.select("_row", F.when(F.col("_key") == F.col("_chief"), F.col("_own")).otherwise(F.col("_key")).alias("_key")).unionByName(own.filter("_own IS NULL").select("_row", "_key"))
    return plain.select(row, known.alias("_key")).unionByName(late), first


def unkeyed(key: str, first: int | None) -> Column:
    """The doc_id that a key of :func:`keyed`, called without ``apart``, stands for."""
    return F.col(key) if first is None else F.when(F.col(key) < first, F.col(key))


#: A group with more than so large a part of all rows is hot; there are no more than so many such groups.
HOT = 1000


def with_group(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """``rows`` joined to ``groups`` (a row for each value of ``on``, with its ``size``), no group in one task.

    Of ``total`` rows no more than HOT groups can each hold more than total / HOT, so those few go out as a
    broadcast; in the shuffle that joins the rest no value has more rows than that.
    """
    most = max(1, total // HOT)
    hot = stored(groups.filter(F.col(size) > most), "hot")
    cold = groups.filter(F.col(size) <= most)
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on))


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables that no later result reads."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches for documents: Spark's 10,000 rows of whole texts hold tens of MB several times a task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text, natively; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_key(seed: int, *cols: Column) -> Column:
    """A uniform key in [0, 2^62): equal rows get equal keys in every run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 2)


def range_bits(count: Column | int, rows: int, partitions: int, most: int = 50_000) -> Column:
    """How many leading key bits split a group of ``count`` of all ``rows`` into ranges of a task's share.

    A range gets about the rows of one partition, ``most`` at the outside, and a small group stays whole:
    all groups together have no more ranges than twice the partitions, rows / ``most`` and the groups.
    """
    share = float(max(1, min(most, rows // max(1, partitions))))
    return F.greatest(F.lit(0), F.ceil(F.log2(F.lit(count) / F.lit(share)) if isinstance(count, int) else F.log2(count / F.lit(share)))).cast("int")


def prefix_sums(df: DataFrame, group: list[str], key: str, ties: list[str], sums: dict[str, str], bits: Column) -> DataFrame:
    """Exclusive running sums in key order within each group, without gathering a group in one task.

    ``key`` comes from :func:`hash_key`, so its leading ``bits`` (one number for a group) cut a hot group
    into ranges of equal expected size. Totals per (group, range) give each range its offset; the running
    sum proper is a window inside a range. ``sums`` maps new column to summed column. Rows that tie in
    key and ``ties`` are interchangeable.
    """
    ranged = df.withColumn("_range", F.call_function("shiftrightunsigned", F.col(key), F.lit(62) - F.coalesce(bits, F.lit(0))))
    by = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = ranged.groupBy(*group, "_range").agg(*[F.sum(c).alias(f"_total_{n}") for n, c in sums.items()])
    offsets = stored(totals.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_range").alias("_r"), *[F.coalesce(F.sum(f"_total_{n}").over(by), F.lit(0)).alias(f"_offset_{n}") for n in sums]), "offsets")
    on = F.col("_range") == F.col("_r")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    inside = W.partitionBy(*group, "_range").orderBy(key, *ties).rowsBetween(W.unboundedPreceding, -1)
    out = ranged.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_inside_{n}") for n, c in sums.items()])
    out = out.join(offsets, on, "left")
    return out.select(*df.columns, *[(F.col(f"_inside_{n}") + F.col(f"_offset_{n}")).cast("long").alias(n) for n in sums])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
