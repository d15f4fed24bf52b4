"""Incremental inputs with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tallyloom.operators.sequences import latest


def tail(spark: SparkSession, folder: str, schema: StructType, fmt: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    """An append-only folder as a stream; offsets live in the query's checkpoint."""
    r = spark.readStream.schema(schema).format(fmt)
    if per_trigger:
        r = r.option("maxFilesPerTrigger", per_trigger)
    return r.load(folder)


def run_now(df: DataFrame, out: str, checkpoint: str, mode: str = "append", fmt: str = "parquet") -> StreamingQuery:
    """Take all there is, then stop."""
    return df.writeStream.outputMode(mode).format(fmt).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(df: DataFrame, at: str, width: str, keys: Sequence[str], late: str = "1 hour") -> DataFrame:
    """Counts and sums of ``value`` per window and keys, with a watermark."""
    d = df.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return d.groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n", "total")


def sessions(df: DataFrame, at: str, gap: str, keys: Sequence[str], late: str = "1 hour") -> DataFrame:
    """Session windows per keys, with a watermark."""
    d = df.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return d.groupBy(F.session_window(at, gap), *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys, "n")


def once_only(df: DataFrame, at: str, keys: Sequence[str], late: str = "1 hour") -> DataFrame:
    """Each key once while its watermark lasts."""
    return df.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


#: Parts of an upserted table by key; a batch rewrites only those it touches.
BUCKETS = 64


def _versions(spark: SparkSession, path: str) -> dict[str, list[tuple[int, str]]]:
    """Whole versions (batch, folder) of each bucket, oldest first."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out: dict[str, list[tuple[int, str]]] = {}
    for batch in fs.listStatus(root) if fs.exists(root) else []:
        folder = batch.getPath()
        # a batch that failed half-way left no mark of success
        if folder.getName().startswith("batch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")):
            for s in fs.listStatus(folder):
                if "=" in s.getPath().getName():
                    out.setdefault(s.getPath().getName(), []).append((int(folder.getName()[6:]), s.getPath().toString()))
    return {k: sorted(v) for k, v in out.items()}


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """An upserted table as of its last whole batch; None before the first."""
    newest = [v[-1][1] for v in _versions(spark, path).values()]
    return spark.read.parquet(*newest) if newest else None


def upsert(path: str, keys: Sequence[str], version: Sequence[str], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: last write wins by key; a batch replayed changes nothing.

    The table lies in buckets by key. A batch writes new versions of the
    buckets it touches and leaves the others; the last version before it stays
    until the next, so a failed write leaves the table whole.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        number = F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("upsert_bucket")
        batch = batch.persist()
        touched = {f"upsert_bucket={r[0]}" for r in batch.select(number).distinct().collect()}
        before = {k: [x for x in v if x[0] < batch_id] for k, v in _versions(spark, path).items() if k in touched}
        old = [v[-1][1] for v in before.values() if v]
        now = spark.read.parquet(*old).unionByName(batch) if old else batch
        latest(now, keys, version).withColumn("upsert_bucket", number).repartition("upsert_bucket").write.mode("overwrite").partitionBy("upsert_bucket").parquet(f"{path}/batch={batch_id}")
        batch.unpersist()
        jvm = spark.sparkContext._jvm
        fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for v in before.values():
            for _, folder in v[:-1]:
                fs.delete(jvm.org.apache.hadoop.fs.Path(folder), True)

    return apply


def job_status(n_items: str = "n_items", n_failed: str = "n_failed"):
    """completed, partial or failed."""
    return F.when(F.col(n_failed) == 0, "completed").when(F.col(n_failed) < F.col(n_items), "partial").otherwise("failed")
