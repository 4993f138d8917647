"""Folds over the rows of a group in order, for rules in which a row depends on the result for the one before."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a result at a time.
ROWS = 5000


def in_order(df: DataFrame, group: str, order: list[str], fold: Callable[[Iterable[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """``fold`` of each group's rows, as tuples of ``df``'s columns in ``order``; it yields tuples of ``schema``.

    Groups are dealt to tasks and sorted there by Spark, which spills; a task then reads one after another and
    holds no more of a group than the fold does.
    """
    spark = df.sparkSession
    columns, out = df.columns, to_arrow_schema(StructType.fromDDL(schema))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, todo, ready = columns.index(group), rows(batches), []
        row = next(todo, None)
        while row is not None:
            key, last = row[at], [row]

            def of_key() -> Iterator[tuple]:
                while last[0] is not None and last[0][at] == key:
                    yield last[0]
                    last[0] = next(todo, None)

            mine = of_key()
            for r in fold(mine):
                ready.append(r)
                if len(ready) >= ROWS:
                    yield _batch(ready, out)
                    ready = []
            for _ in mine:
                pass  # what the fold left
            row = last[0]
        yield _batch(ready, out)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, group).sortWithinPartitions(group, *order).mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
