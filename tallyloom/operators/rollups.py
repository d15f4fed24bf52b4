"""Aggregates and tables of counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.stats import quantiles

MISSING = "<NA>"


def frequency(df: DataFrame, col: Column) -> DataFrame:
    """``level``, ``n``, ``share``; trimmed, a blank or NULL level is ``<NA>``."""
    level = F.coalesce(F.nullif(F.trim(col.cast("string")), F.lit("")), F.lit(MISSING))
    n = df.groupBy(level.alias("level")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / n.agg(F.sum("n")).scalar().cast("double"))


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row a column: n, missing, mean, sample sd, median, quartiles, extremes.

    Quantiles interpolate linearly between order statistics; of a column
    without values they are NULL.
    """
    x = {c: F.col(c).cast("double") for c in cols}
    # moments of all columns in one scan, and one of a long form for the quantiles
    one = {c: F.struct(F.count(v).alias("n"), (F.count("*") - F.count(v)).alias("missing"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("low"), F.max(v).alias("high")) for c, v in x.items()}
    row = df.agg(*(s.alias(f"_{i}") for i, s in enumerate(one.values())))
    long = row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(f"_{i}").alias("s")) for i, c in enumerate(cols)))).alias("r")).select("r.variable", "r.s.*")
    values = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), v.alias("v")) for c, v in x.items()))).alias("r")).select("r.*")
    q = F.broadcast(quantiles(values, "v", (0.25, 0.5, 0.75), ["variable"]))  # a row per column
    return long.join(q, "variable", "left").select("variable", "n", "missing", "mean", "sd", F.col("q")[1].alias("median"), F.col("q")[0].alias("p25"), F.col("q")[2].alias("p75"), "low", "high")


def crosstab(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Every pair of levels, with count, row and column share and expected count; empty cells have 0.

    The grid is of distinct levels; only counts are joined to it.
    """
    level = lambda c: F.coalesce(c.cast("string"), F.lit(MISSING))
    n = df.groupBy(level(a).alias("a"), level(b).alias("b")).agg(F.count("*").alias("n"))
    # a's and b's levels as arrays: a grid without a join
    levels = n.agg(F.collect_set("a").alias("as_"), F.collect_set("b").alias("bs"))
    grid = levels.select(F.explode("as_").alias("a"), "bs").select("a", F.explode("bs").alias("b"))
    d = grid.join(n, ["a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rows, cols, every = (F.sum("n").over(Window.partitionBy(*k)) for k in (["a"], ["b"], [F.lit(0)]))
    return d.select("a", "b", "n", (F.col("n") / rows.cast("double")).alias("row_share"), (F.col("n") / cols.cast("double")).alias("col_share"), (rows.cast("double") * cols / every).alias("expected"))


def binary_metrics(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """tp, fp, fn, tn, accuracy, precision, recall, f1 (0 where undefined) and kappa over rows with both labels."""
    d = df.filter(F.col(truth).isin(0, 1) & F.col(guess).isin(0, 1))
    cell = lambda t, g: F.count_if((F.col(truth) == t) & (F.col(guess) == g))
    c = d.agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"), F.count("*").alias("n"))
    div = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)
    tp, fp, fn, tn, n = (F.col(x) for x in ("tp", "fp", "fn", "tn", "n"))
    po = div(tp + tn, n)
    pe = div((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    m = c.withColumns({"accuracy": po, "precision": div(tp, tp + fp), "recall": div(tp, tp + fn), "kappa": F.when(pe == 1, F.lit(None)).otherwise((po - pe) / (F.lit(1.0) - pe))})
    p, r = F.col("precision"), F.col("recall")
    return m.withColumn("f1", F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r)))


def class_report(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Precision, recall, f1 and support of each class, and macro and weighted means."""
    d = df.filter(F.col(truth).isNotNull() & F.col(guess).isNotNull())
    d = d.select(truth, guess, F.explode(F.array_distinct(F.array(truth, guess))).alias("k"))
    per = d.groupBy("k").agg(F.count_if((F.col(truth) == F.col("k")) & (F.col(guess) == F.col("k"))).alias("tp"), F.count_if(F.col(guess) == F.col("k")).alias("n_guess"), F.count_if(F.col(truth) == F.col("k")).alias("support"))
    return _report(per)


def _report(per: DataFrame) -> DataFrame:
    div = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)
    per = per.withColumns({"precision": div(F.col("tp"), F.col("n_guess")), "recall": div(F.col("tp"), F.col("support"))})
    p, r = F.col("precision"), F.col("recall")
    per = per.withColumn("f1", F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r)))
    cls = per.select(F.col("k").cast("string").alias("class"), "precision", "recall", "f1", "support")
    w = F.col("support") / F.sum("support").over(Window.partitionBy(F.lit(0)))
    means = per.withColumn("w", w).agg(*(F.avg(x).alias(f"m_{x}") for x in ("precision", "recall", "f1")), *(F.sum(F.col(x) * F.col("w")).alias(f"w_{x}") for x in ("precision", "recall", "f1")), F.sum("support").alias("support"))
    avg = lambda name, k: means.select(F.lit(name).alias("class"), *(F.col(f"{k}_{x}").alias(x) for x in ("precision", "recall", "f1")), "support")
    return cls.unionByName(avg("macro avg", "m")).unionByName(avg("weighted avg", "w"))


def mode_by(df: DataFrame, part: Sequence[str], value: str, order: str) -> DataFrame:
    """Most frequent value of each group; of equal ones the first met by ``order``."""
    per = df.groupBy(*part, value).agg(F.count("*").alias("_n"), F.min(order).alias("_o"))
    return per.groupBy(*part).agg(F.max_by(F.struct(value, "_n"), F.struct(F.col("_n"), -F.col("_o"))).alias("_m")).select(*part, F.col(f"_m.{value}").alias(value), F.col("_m._n").alias("n"))


def box_numbers(df: DataFrame, group: str, value: str) -> DataFrame:
    """Per group: low, p25, median, p75, high, and how many values lie outside the fences."""
    q = quantiles(df, value, (0.0, 0.25, 0.5, 0.75, 1.0), [group])
    q = q.select(group, *(F.col("q")[i].alias(k) for i, k in enumerate(("low", "p25", "median", "p75", "high"))))
    counts = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_n")).join(q, group)
    reach = 1.5 * (F.col("p75") - F.col("p25"))
    outside = (F.col(value) < F.col("p25") - reach) | (F.col(value) > F.col("p75") + reach)
    return counts.groupBy(group, "low", "p25", "median", "p75", "high").agg(F.sum(F.when(outside, F.col("_n")).otherwise(0)).alias("n_outside"))
