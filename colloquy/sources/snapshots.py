"""A keyed table in versions: writers copy what they touch, readers see one version whole.

Rows lie in buckets of their key's hash. A write makes new files for the buckets that its rows fall into, below
a folder of its own, and then a manifest that names the folder of every bucket. The manifest comes last and under
a name that must not exist, so a write that fails, or loses against another, leaves the version before.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.collections import keyed_upsert

BUCKETS = 64


def _files(spark: SparkSession, path: str):
    """(file system, path) for a folder, by Hadoop's own."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def manifest(spark: SparkSession, root: str) -> tuple[int, dict[int, str]]:
    """The newest version and the folder of each of its buckets; version 0 has none."""
    fs, folder = _files(spark, f"{root}/manifests")
    if not fs.exists(folder):
        return 0, {}
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    newest = max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit()), default=0)
    if not newest:
        return 0, {}
    # one short line, whatever the table's size: a folder for each bucket
    line = spark.read.text(f"{root}/manifests/{newest}.json").first()[0]
    return newest, {int(b): path for b, path in json.loads(line).items()}


def read(spark: SparkSession, root: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
    """The newest version, or some of its buckets; an empty table has the given schema."""
    _, paths = manifest(spark, root)
    wanted = [p for b, p in sorted(paths.items()) if buckets is None or b in buckets]
    if not wanted:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*wanted)


def _commit(spark: SparkSession, root: str, version: int, paths: dict[int, str]) -> None:
    fs, draft = _files(spark, f"{root}/manifests/_draft-{version}")
    _, final = _files(spark, f"{root}/manifests/{version}.json")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(paths).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        raise RuntimeError(f"version {version} of {root} was written by another; read again and retry")


def write(spark: SparkSession, root: str, rows: DataFrame, key: str, merge: bool = True, at: str | None = None) -> int:
    """Replaces rows by key, or with ``merge`` only the fields that are not null; new keys are added. Returns the new version.

    ``at`` names the column that takes the time of the change in the rows that change (updated_at). A key stands once in ``rows``.
    """
    version, paths = manifest(spark, root)
    if at:
        rows = rows.withColumn(at, F.current_timestamp())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    touched = sorted(r[0] for r in rows.select(_bucket(key).alias("b")).distinct().collect())
    old = read(spark, root, schema, touched)
    if merge:
        new = keyed_upsert(old, rows, key)
    else:
        new = old.join(rows.select(key), key, "left_anti").select(*rows.columns).unionByName(rows)
    data = f"{root}/data/{version + 1}"
    new.withColumn("_bucket", _bucket(key)).repartition("_bucket").write.partitionBy("_bucket").mode("overwrite").parquet(data)
    _commit(spark, root, version + 1, paths | {b: f"{data}/_bucket={b}" for b in touched})
    return version + 1
