"""Deterministic samples, quotas and splits, ordered by a hash of the id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.stats import quantiles


def hash_order(*parts: Column, seed: int = 42) -> Column:
    """An order like a seeded shuffle, the same in every engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(p.cast("string") for p in parts)))


def top_or_other(df: DataFrame, col: str, k: int = 50, out: str = "video_group", missing: str = "MISSING") -> DataFrame:
    """The k most frequent values, every other one OTHER, a blank one MISSING."""
    value = F.coalesce(F.nullif(F.trim(F.col(col).cast("string")), F.lit("")), F.lit(missing))
    d = df.withColumn("_v", value)
    # k rows: a broadcast of fixed size
    top = d.groupBy("_v").agg(F.count("*").alias("_c")).orderBy(F.desc("_c"), "_v").limit(k).select("_v", F.lit(True).alias("_top"))
    return d.join(F.broadcast(top), "_v", "left").withColumn(out, F.when(F.col("_top"), F.col("_v")).otherwise("OTHER")).drop("_v", "_top")


def quantile_bins(df: DataFrame, value: str, q: int = 5, out: str = "bin") -> DataFrame:
    """Right-closed quantile bins from 0, the lowest edge included, equal edges merged.

    Edges are exact quantiles with linear interpolation, got from the counts
    of distinct values.
    """
    # a scalar subquery of q + 1 numbers
    e = quantiles(df, value, [i / q for i in range(q + 1)]).agg(F.max(F.array_distinct("q"))).scalar()
    inner = df.withColumn("_e", F.slice(e, 2, F.greatest(F.size(e) - 1, F.lit(0))))
    return inner.withColumn(out, F.aggregate("_e", F.lit(0), lambda acc, x: acc + F.when(F.col(value) > x, 1).otherwise(0))).drop("_e")


def largest_remainder(sizes: DataFrame, key: str, size: str, n: int) -> DataFrame:
    """``key``, ``size``, ``quota``: n rows shared over the groups; ties by key."""
    total = sizes.agg(F.sum(size)).scalar()
    d = sizes.withColumn("_raw", F.col(size).cast("double") / total * F.lit(float(n))).withColumn("_floor", F.floor("_raw").cast("long"))
    # groups are strata, few beside the rows; one task ranks them
    rest = F.lit(n) - d.agg(F.sum("_floor")).scalar()
    rank = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("_raw") - F.col("_floor"), 9)), key))
    return d.select(key, size, (F.col("_floor") + F.when(rank <= rest, 1).otherwise(0)).alias("quota"))


def stratified_sample(df: DataFrame, stratum: str, row_id: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by largest-remainder quotas over the strata, each stratum's first by hash order."""
    quotas = largest_remainder(df.groupBy(stratum).agg(F.count("*").alias("_size")), stratum, "_size", n)
    ranked = df.withColumn("_h", hash_order(F.col(row_id), seed=seed)).withColumn("_n", F.row_number().over(Window.partitionBy(stratum).orderBy("_h", row_id)))
    return ranked.join(quotas.select(stratum, "quota"), stratum).filter(F.col("_n") <= F.col("quota")).drop("_h", "_n", "quota")


def stratified_split(df: DataFrame, label: str, row_id: str, ratios: Sequence[float] = (0.8, 0.1, 0.1), names: Sequence[str] = ("train", "valid", "test"), seed: int = 42, least: int = 3) -> DataFrame:
    """Add ``split``: each label's rows in hash order, cut at the rounded shares.

    A label with fewer than ``least`` rows, one for each part, is an error.
    """
    if abs(sum(ratios) - 1.0) > 1e-8 or min(ratios) <= 0:
        raise ValueError("ratios must be positive and sum to one")
    n = F.count("*").over(Window.partitionBy(label))
    rank = F.row_number().over(Window.partitionBy(label).orderBy(hash_order(F.col(row_id), seed=seed), row_id))
    cut, share = F.lit(names[-1]), 1.0
    for name, r in list(zip(names, ratios))[-2::-1]:
        share = sum(ratios[: list(names).index(name) + 1])
        cut = F.when(rank <= F.floor(n * F.lit(round(share, 9)) + F.lit(0.5)), name).otherwise(cut)
    return df.withColumn("split", F.when(n < least, F.raise_error(F.concat(F.lit("too few rows of label "), F.coalesce(F.col(label).cast("string"), F.lit("NULL")))).cast("string")).otherwise(cut))


def batches(df: DataFrame, order: Sequence[str], size: int, part: Sequence[str] = ()) -> DataFrame:
    """Add ``batch``: rows in order, so many a batch, from 0."""
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))


def annotation_sample(df: DataFrame, video: str, month: str, length: str, row_id: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by strata of the 50 most frequent videos, month and quintile of length; all rows if there are no more.

    Adds ``stratum``. Quotas are by largest remainder and never exceed a
    stratum, so nothing is left to fill up.
    """
    d = quantile_bins(top_or_other(df, video), length, 5)
    d = d.withColumn("stratum", F.concat_ws("|", "video_group", F.coalesce(month, F.lit("MISSING")), F.col("bin").cast("string")))
    few = df.agg(F.count("*") <= n).scalar()
    quotas = largest_remainder(d.groupBy("stratum").agg(F.count("*").alias("_size")), "stratum", "_size", n)
    ranked = d.withColumn("_n", F.row_number().over(Window.partitionBy("stratum").orderBy(hash_order(F.col(row_id), seed=seed), row_id)))
    return ranked.join(quotas.select("stratum", "quota"), "stratum").filter(few | (F.col("_n") <= F.col("quota"))).drop("_n", "quota", "bin", "video_group")
