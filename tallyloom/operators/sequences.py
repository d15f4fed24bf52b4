"""Segments, blocks and versions of ordered rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_bits(c: Column) -> Column:
    """A 64-bit picture hash in hex, however spelled, as a signed long."""
    digits = F.lower(F.regexp_replace(F.trim(c), "^0[xX]", ""))
    half = lambda at: F.conv(F.substring(digits, at, 8), 16, 10).cast("long")
    return F.when(digits.rlike("^[0-9a-f]{16}$"), F.shiftleft(half(1), 32).bitwiseOR(half(9)))


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two hashes differ."""
    return F.bit_count(a.bitwiseXOR(b))


#: Positions of one block of an ordered sequence.
BLOCK = 4096


def _in_blocks(df: DataFrame, order: Sequence[str], block: int) -> DataFrame:
    """Add ``_blk``: the first order column, a whole number, cuts a sequence into blocks."""
    return df.withColumn("_blk", F.floor(F.col(order[0]) / F.lit(block)).cast("long"))


def with_previous(df: DataFrame, part: Sequence[str], order: Sequence[str], cols: Sequence[str], block: int = BLOCK) -> DataFrame:
    """Add ``_prev``: a struct of the columns of the row just before, NULL on the first row.

    Windows run over a group's blocks, and over one row a block, so a group of
    any length is many tasks. Rows with a NULL in ``part`` or the first order
    column are left out; ``_blk`` stays.
    """
    d = _in_blocks(df.dropna(subset=[*part, order[0]]), order, block)
    row = F.struct(*cols)
    w = Window.partitionBy(*part, "_blk").orderBy(*order)
    last = d.groupBy(*part, "_blk").agg(F.max_by(row, F.struct(*order)).alias("_last"))
    edge = last.select(*part, "_blk", F.lag("_last").over(Window.partitionBy(*part).orderBy("_blk")).alias("_edge"))
    first = F.row_number().over(w) == 1
    d = d.withColumns({"_first": first, "_in": F.lag(row).over(w)}).join(edge, [*part, "_blk"])
    return d.withColumn("_prev", F.when(F.col("_first"), F.col("_edge")).otherwise(F.col("_in"))).drop("_first", "_in", "_edge")


def running(df: DataFrame, part: Sequence[str], order: Sequence[str], value: Column, out: str, highest: bool = False, before: bool = False) -> DataFrame:
    """Add the running sum, or maximum, of ``value`` in order; ``before`` leaves the row itself out.

    ``df`` has ``_blk``. Of a block only its total goes on to the next.
    """
    total = F.max if highest else F.sum
    d = df.withColumn("_v", value)
    w = Window.partitionBy(*part, "_blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    per = d.groupBy(*part, "_blk").agg(total("_v").alias("_t"))
    ahead = per.select(*part, "_blk", total("_t").over(Window.partitionBy(*part).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)).alias("_ahead"))
    d = d.withColumn("_here", total("_v").over(w)).join(ahead, [*part, "_blk"])
    both = F.greatest("_here", "_ahead") if highest else F.coalesce("_here", F.lit(0)) + F.coalesce("_ahead", F.lit(0))
    return d.withColumn(out, both).drop("_v", "_here", "_ahead")


def islands(df: DataFrame, part: Sequence[str], order: Sequence[str | Column], breaks: Column, out: str = "island") -> DataFrame:
    """Number the runs of rows between breaks, from 1; ``breaks`` may use ``F.lag`` over the same order.

    One window per group: for groups that are short beside the data.
    """
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn("_brk", F.when(F.coalesce(breaks, F.lit(True)), 1).otherwise(0)).withColumn(out, F.sum("_brk").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_brk")


def adjacent_segments(df: DataFrame, part: Sequence[str], order: Sequence[str], phash: str, threshold: int = 12, block: int = BLOCK) -> DataFrame:
    """Segments of rows whose hash is within the threshold of the one just before; a NULL hash breaks.

    The first order column is a whole number; rows without it or their group are left out.
    """
    d = with_previous(df, part, order, [phash], block)
    near = hamming(F.col(phash), F.col(f"_prev.{phash}")) <= threshold
    return running(d, part, order, F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1), "segment").drop("_prev", "_blk")


def timeline_blocks(df: DataFrame, part: Sequence[str], order: Sequence[str], labels: Sequence[str], start: str, end: str, duration: str, tolerance: float = 0.2, block: int = BLOCK) -> DataFrame:
    """Blocks of rows with the same labels, starting at most ``tolerance`` after the block's end so far.

    Two levels of islands: runs of equal labels, and within a run a break
    where the start lies beyond the running maximum of the ends before. The
    first order column cuts a sequence into pieces of that width.
    """
    d = with_previous(df, part, order, labels, block)
    same = F.col("_prev").isNotNull()
    for c in labels:
        same = same & F.col(c).eqNullSafe(F.col(f"_prev.{c}"))
    d = running(d, part, order, F.when(same, 0).otherwise(1), "_run")
    d = running(d, [*part, "_run"], order, F.col(end), "_so_far", highest=True, before=True)
    gap = F.col("_so_far").isNull() | (F.col(start) > F.col("_so_far") + F.lit(tolerance))
    cut = running(d, part, order, F.when(gap, 1).otherwise(0), "_b")
    out = cut.groupBy(*part, "_b", *labels).agg(F.min(start).alias("start_time"), F.max(end).alias("end_time"), F.sum(duration).alias("duration_seconds"), F.count("*").alias("slice_count"))
    return out.withColumn("block_index", F.col("_b") - 1).drop("_b")


def representative(df: DataFrame, part: Sequence[str], best: Column, tie: Sequence[str]) -> DataFrame:
    """The best row of each group, first by the tie columns."""
    return top_per_group(df, part, [best.desc_nulls_last(), *tie], 1)


def top_per_group(df: DataFrame, part: Sequence[str], order: Sequence, k: int) -> DataFrame:
    """The first k rows of each group in a total order."""
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")


def keep_first(df: DataFrame, key: Column, order: Sequence[str]) -> DataFrame:
    """One row a key, the first in order: a reduction with map-side combine, no sort of a key's rows."""
    at = F.struct(*order)
    return df.groupBy(key.alias("_k")).agg(F.min_by(F.struct(*df.columns), at).alias("_r")).select("_r.*")


def latest(df: DataFrame, key: Sequence[str], version: Sequence[str]) -> DataFrame:
    """The last version of each key; ties by the whole row."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*version, *(c for c in rest if c not in version))).alias("_r")).select(*key, "_r.*")


def label_shares(df: DataFrame, part: str, label: str, weight: str) -> DataFrame:
    """Weight and share of each label in its group, and whether it is the group's main one (ties: first by name)."""
    per = df.groupBy(part, label).agg(F.sum(weight).alias("weight"))
    w = Window.partitionBy(part)
    ranked = per.withColumn("share", F.when(F.sum("weight").over(w) > 0, F.col("weight") / F.sum("weight").over(w)).otherwise(F.lit(0.0)))
    return ranked.withColumn("is_main", (F.row_number().over(w.orderBy(F.desc("weight"), label)) == 1).cast("int"))


def breaker_states(df: DataFrame, part: str, order: Sequence[str], failed: Column, threshold: int = 3) -> DataFrame:
    """Failures in a row so far, reset by a success, and whether the breaker is open."""
    w = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("_f", failed.cast("int")).withColumn("_era", F.sum(1 - F.col("_f")).over(w))
    inner = Window.partitionBy(part, "_era").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("failure_count", F.sum("_f").over(inner)).withColumn("is_open", (F.col("failure_count") >= threshold).cast("int")).drop("_f", "_era")
