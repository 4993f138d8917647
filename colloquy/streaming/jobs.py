"""Structured Streaming jobs over event files. Each runs on what is there and stops (availableNow).

Sinks are folders; a job writes each batch under its number, so that a batch that is repeated after a
failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.collections import lifecycle_events, snapshot_diff
from ..operators.usage import CREATED, DELETED, activity_parts, daily_from_parts
from ..sources.ingest import replace_days

COUNTERS = StructType().add("existing", "long").add("created", "long").add("deleted", "long").add("last", "timestamp")
COUNTED = "user_id long, existing long, created long, deleted long, last_activity_at timestamp"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_events(spark: SparkSession, path: str, schema: StructType, files: int | None = None) -> DataFrame:
    """The files of a folder as a stream; ``files`` bounds those of one batch."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", files) if files else r).parquet(path)


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Runs the stream to the end of its input, batch by batch; its state lies in RocksDB, so it may exceed memory."""
    spark, key = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
        q.awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def append_events(events: DataFrame, sink: str, checkpoint: str) -> None:
    """The append-only log, partitioned by date, written exactly once by the file sink."""
    q = events.withColumn("date", F.to_date("timestamp")).writeStream.partitionBy("date").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(sink)
    q.awaitTermination()


class Counters(StatefulProcessor):
    """The counters of a user; the existing count never falls below 0.

    A batch's rows come in pieces, of which only time, id and step are kept, 17 bytes an event. In order of time
    the count is the running sum, less what would have gone below 0: the least running sum, if that is negative.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("counters", COUNTERS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        existing, created, deleted, last = self.state.get() if self.state.exists() else (0, 0, 0, None)
        at, ids, steps = [], [], []
        for piece in rows:
            at.append(piece["timestamp"].to_numpy("datetime64[us]").astype(np.int64))
            ids.append(piece["event_id"].to_numpy(np.int64))
            steps.append((piece["event_type"] == CREATED).to_numpy(np.int8) - (piece["event_type"] == DELETED).to_numpy(np.int8))
            newest = piece["timestamp"].max().to_pydatetime()
            last = newest if last is None else max(last, newest)
        step = np.concatenate(steps)[np.lexsort((np.concatenate(ids), np.concatenate(at)))]
        sums = existing + np.cumsum(step, dtype=np.int64)
        existing = int(sums[-1] - min(0, sums.min()))
        created, deleted = created + int((step == 1).sum()), deleted + int((step == -1).sum())
        self.state.update((existing, created, deleted, last))
        yield pd.DataFrame({"user_id": [key[0]], "existing": [existing], "created": [created], "deleted": [deleted], "last_activity_at": [last]})

    def close(self) -> None:
        pass


def user_stats(events: DataFrame) -> DataFrame:
    """A row for each user of a batch with the state so far; a batch counts in order of time and id."""
    rows = events.filter("user_id is not null").select(F.col("user_id").cast("long").alias("user_id"), F.col("event_id").cast("long").alias("event_id"), "event_type", F.col("timestamp").cast("timestamp").alias("timestamp"))
    return rows.groupBy("user_id").transformWithStateInPandas(Counters(), COUNTED, "Update", "None")


def to_folder(sink: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch under its number."""
    return lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{sink}/n={n}")


def latest(rows: DataFrame, key: str, order: str = "batch") -> DataFrame:
    """The newest row of each key over all batches of a sink."""
    best = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (key, "n")]), order).alias("r"))
    return best.select(key, "r.*")


def latest_by(events: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """Running latest values of each key (update mode)."""
    return events.groupBy(key).agg(F.max(F.struct(*order, *[v for v in values if v not in order])).alias("r")).select(key, *[F.col(f"r.{v}").alias(v) for v in values])


def snapshot_events(snapshots: DataFrame, state: str, sink: str, checkpoint: str, key: str) -> None:
    """For each batch, a whole snapshot, the differences to the one before as lifecycle events."""

    def each(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        now = df.select("conversation_id", "user_id", "title", "status")
        before = spark.read.parquet(f"{state}/n={n - 1}") if n else now.limit(0)
        lifecycle_events(snapshot_diff(before, now, key)).write.mode("overwrite").parquet(f"{sink}/n={n}")
        now.write.mode("overwrite").parquet(f"{state}/n={n}")

    run(snapshots, each, checkpoint)


def daily_rollup(batch: DataFrame, n: int, metrics: DataFrame, parts: str, sink: str) -> None:
    """Adds a batch to the daily figures, with work that follows the batch and the days that it touches.

    The batch is summed up by day and user under its own number, so a repeated batch replaces itself. Days that
    it touches, late ones included, are made anew from the sums of all batches for them, and replace themselves.
    """
    spark = batch.sparkSession
    activity_parts(batch).withColumn("n", F.lit(n)).write.partitionBy("date", "n").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(parts)
    mine = spark.read.parquet(parts).filter(F.col("n") == n)
    # the days of a batch are few, and named to the reader so that it opens no others
    days = [r[0] for r in mine.select("date").distinct().collect()]
    if days:
        touched = spark.read.parquet(parts).filter(F.col("date").isin(days))
        replace_days(daily_from_parts(touched, metrics.filter(F.to_date("timestamp").isin(days))), sink)
