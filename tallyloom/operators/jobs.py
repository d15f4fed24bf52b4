"""Work lists, results and snapshots of repeated runs."""

from __future__ import annotations

import signal
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def realigned(items: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Items with their results; an item without one fails the job."""
    r = results.withColumn("_found", F.lit(True))
    return items.join(r, key, "left").withColumn("_ok", F.when(F.col("_found"), True).otherwise(F.raise_error(F.concat(F.lit("no result for "), F.col(key).cast("string"))).cast("boolean"))).filter("_ok").drop("_found", "_ok")


def pending(items: DataFrame, done: DataFrame, key: Sequence[str], overwrite: bool = False) -> DataFrame:
    """Items not done yet, or all."""
    return items if overwrite else items.join(done.select(*key).distinct(), list(key), "left_anti")


def last_attempt(attempts: DataFrame, key: Sequence[str], attempt: str) -> DataFrame:
    """The last attempt of each item and how many there were; ties by the other columns."""
    rest = [c for c in attempts.columns if c not in key]
    g = attempts.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(attempt, *(c for c in rest if c != attempt))).alias("_r"), F.count("*").alias("n_attempts"))
    return g.select(*key, "_r.*", "n_attempts")


def signature(df: DataFrame, updated: str) -> DataFrame:
    """Count and newest change: equal signatures mean nothing to export."""
    return df.agg(F.count("*").alias("n"), F.max(updated).alias("newest"))


def with_fallback(primary: DataFrame, fallback: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of the primary source, and of the fallback for keys it lacks."""
    return primary.unionByName(fallback.join(primary.select(*key).distinct(), list(key), "left_anti"))


def invalid_resources(df: DataFrame, failures: Column, limit: int, now: Column) -> DataFrame:
    """Resources to remove: too many failures, or expired."""
    return df.filter((failures >= limit) | (F.col("expires_at").isNotNull() & (F.col("expires_at") < now)))


def until_stable(step: Callable[[int], int], most: int = 20) -> int:
    """Run passes until what remains is nothing or no longer shrinks; returns what remains."""
    left = step(0)
    for i in range(1, most):
        if left == 0:
            break
        now = step(i)
        if now >= left:
            return now
        left = now
    return left


def matching_job(jobs: DataFrame, ids: Sequence[str], force: bool) -> DataFrame:
    """Newest job whose JSON asks for exactly these ids with this switch."""
    v = F.from_json("requested", "video_ids array<string>, force boolean")
    same = (v["video_ids"] == F.array(*map(F.lit, ids))) & (F.coalesce(v["force"], F.lit(False)) == F.lit(force))
    return jobs.filter(same).agg(F.max("id").alias("id"))


def listing_counts(files: DataFrame, folder: str, name: str, sidecar: str = "._") -> DataFrame:
    """``n_files`` per folder, without sidecars; a folder of sidecars alone has no row."""
    return files.filter(~F.startswith(F.col(name), F.lit(sidecar))).groupBy(folder).agg(F.count("*").alias("n_files"))


def progress(rows: DataFrame, key: str, order: str, is_root: Column) -> DataFrame:
    """What a job resumes from, per key: the last row in order, the counters, and both as JSON with sorted names."""
    g = rows.groupBy(key).agg(F.max(order).alias(f"last_{order}"), F.count("*").alias("comment_count"), F.count_if(is_root).alias("root_comment_count"))
    g = g.withColumn("reply_count", F.col("comment_count") - F.col("root_comment_count"))
    return g.withColumn("cursor", F.to_json(F.struct("comment_count", F.col(f"last_{order}").cast("string").alias("cursor"), "reply_count", "root_comment_count")))


def until_repeated(pages: DataFrame, key: str, order: str, cursor: str) -> DataFrame:
    """Pages of each key before the first whose cursor was met before; a NULL cursor repeats nothing.

    The stop is found from the first two places of each cursor, so no task
    sorts a key's pages.
    """
    two = pages.filter(F.col(cursor).isNotNull()).groupBy(key, cursor).agg(F.min(order).alias("_first"))
    again = pages.join(two, [key, cursor]).filter(F.col(order) > F.col("_first")).groupBy(key).agg(F.min(order).alias("_stop"))
    return pages.join(again, key, "left").filter(F.col("_stop").isNull() | (F.col(order) < F.col("_stop"))).drop("_stop")


def in_turn(available: DataFrame, order: str, cursors: Sequence[int]) -> DataFrame:
    """``cursor`` and the resource whose turn it is; of none available no row."""
    spark = available.sparkSession
    ranked = available.withColumn("_i", F.row_number().over(Window.orderBy(order)) - 1)  # resources are a list of configuration
    turns = spark.createDataFrame([(c,) for c in cursors], "cursor int").withColumn("_i", F.col("cursor") % F.nullif(available.agg(F.count("*")).scalar(), F.lit(0)))
    return ranked.join(F.broadcast(turns), "_i").select("cursor", order)


def backoff(attempt: Column, base: float, doubling: bool, most: float) -> Column:
    """Seconds to wait before an attempt, from 1: linear or doubling, up to a bound."""
    wait = F.lit(base) * (F.pow(F.lit(2.0), attempt - 1) if doubling else attempt)
    return F.least(wait, F.lit(most))


def with_cooldown(events: DataFrame, key: str, order: str, at: str, failed: str, threshold: int = 3, cooldown: float = 300.0) -> DataFrame:
    """Breaker of each resource over its events in order: ``failure_count``, ``cooldown_until``, ``available``.

    A failure counts on; at the threshold, and at every failure beyond it, the
    resource cools down from then on. A success resets both. ``available``
    tells whether the resource could be used when the event came. ``at`` is in
    seconds. Counts come from two running sums; nothing is held per resource.
    """
    w = Window.partitionBy(key).orderBy(at, order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    d = events.withColumn("_f", F.coalesce(F.col(failed).cast("int"), F.lit(0))).withColumn("_era", F.sum(1 - F.col("_f")).over(upto))
    d = d.withColumn("failure_count", F.sum("_f").over(Window.partitionBy(key, "_era").orderBy(at, order).rowsBetween(Window.unboundedPreceding, 0)))
    until = F.when((F.col("_f") == 1) & (F.col("failure_count") >= threshold), F.col(at) + F.lit(cooldown))
    d = d.withColumn("cooldown_until", until)
    before = F.lag("cooldown_until").over(w)
    return d.withColumn("available", before.isNull() | (F.col(at) >= before)).drop("_f", "_era")


def snapshot_due(now: DataFrame, last: DataFrame, at: float, last_at: float, gap: float) -> bool:
    """Whether to export: enough time has passed and the signature has changed."""
    return at - last_at >= gap and now.exceptAll(last).count() > 0


def _limited(fn: Callable[[object], object], value: object, seconds: float) -> object:
    """The function's value, or a TimeoutError once the seconds are over."""

    def over(*_: object) -> None:
        raise TimeoutError(f"longer than {seconds:g} s")

    before = signal.signal(signal.SIGALRM, over)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        return fn(value)
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def isolated(items: DataFrame, fn: Callable[[object], object], key: str, value: str, seconds: float = 600.0) -> DataFrame:
    """``key``, ``result``, ``error_type``, ``message``: an item that fails or hangs does not end the job.

    ``fn`` takes a value and returns a string or None; what it raises is kept
    with the item, and so is a TimeoutError after ``seconds``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    r = _limited(fn, v, seconds)
                    rows.append((k, None if r is None else str(r), None, None))
                except Exception as e:  # whatever one item raises is its own
                    rows.append((k, None, type(e).__name__, str(e)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=[key, "result", "error_type", "message"])

    return items.select(F.col(key).cast("string").alias(key), value).mapInArrow(run, f"{key} string, result string, error_type string, message string")
