"""Tables of other stores: any JDBC address, and SQLite files through the standard library."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A table by key ranges, one query a task; what filters Spark can push down the store applies.

    ``driver`` and credentials come as options; lost connections are tested
    before use where the driver can.
    """
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts).option("fetchsize", 10_000)
    return r.options(**options).load()


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, parts: int = 8, wait_ms: int = 30_000) -> DataFrame:
    """A table of a SQLite file that all executors reach, in ranges of row ids.

    Opened read-only with a busy timeout, so that a writer in write-ahead mode
    is not disturbed; rows come in steps. An empty table gives no rows.
    """
    fields = T.StructType.fromDDL(schema)
    names = ", ".join(f'"{f.name}"' for f in fields)

    def connect() -> sqlite3.Connection:
        con = sqlite3.connect(f"file:{path}?mode=ro", uri=True, timeout=wait_ms / 1000)
        con.execute(f"PRAGMA busy_timeout = {wait_ms}")
        return con

    con = connect()
    low, high = con.execute(f'SELECT min(rowid), max(rowid) FROM "{table}"').fetchone()
    con.close()
    if low is None:
        return spark.createDataFrame([], fields)
    width = (high - low) // parts + 1
    ranges = spark.createDataFrame([(low + i * width, low + (i + 1) * width) for i in range(parts)], "a long, b long").repartition(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(fields)
        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns)):
                con = connect()
                cur = con.execute(f'SELECT {names} FROM "{table}" WHERE rowid >= ? AND rowid < ?', (a, b))
                while rows := cur.fetchmany(10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
                con.close()

    return ranges.mapInArrow(run, fields)
