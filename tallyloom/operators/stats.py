"""Tests and regressions from distributed sufficient statistics.

Rows are only ever reduced: to counts, rank sums or k by k arrays. What
reaches the driver has the size of the model, not of the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import checkpointed

# ---- distribution functions, for single values ----


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    log_front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1.0 - total * math.exp(log_front)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return math.exp(log_front) * h


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_p(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def f_p(f: float, d1: float, d2: float) -> float:
    return beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def t_p(t: float, df: float) -> float:
    """Two-sided."""
    return beta_i(df / 2, 0.5, df / (df + t * t))


def normal_p(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


def with_p(df: DataFrame, p: Callable[..., float], cols: Sequence[str], out: str = "p_value") -> DataFrame:
    """Add a p-value to a handful of rows of statistics."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + f", {out} double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            yield x.assign(**{out: [None if any(v is None or v != v for v in r) else p(*r) for r in zip(*(x[c] for c in cols))]})

    return df.mapInPandas(run, schema)


# ---- ranks ----


def _ranked(counts: DataFrame, value: str, buckets: int, by: Sequence[str] = ()) -> DataFrame:
    """Add ``_upto`` to distinct values with ``n``: how many rows of a group are not greater.

    Distinct values are spread over ranges, so that no task ranks them all,
    and a group of any size is many tasks. The ranges are kept in the
    checkpoint folder: they must be the same for all that follows.
    """
    d = checkpointed(counts.repartitionByRange(buckets, *by, value).withColumn("_b", F.spark_partition_id()))
    per = d.groupBy(*by, "_b").agg(F.sum("n").alias("_t"))
    # a row per group and range
    before = per.withColumn("_before", F.coalesce(F.sum("_t").over(Window.partitionBy(*(by or (F.lit(0),))).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(*by, "_b", "_before")
    # without groups it has as many rows as ranges, else the planner decides by its size
    before = before if by else F.broadcast(before)
    upto = F.sum("n").over(Window.partitionBy(*by, "_b").orderBy(value))
    return d.join(before, [*by, "_b"]).withColumn("_upto", F.col("_before") + upto).drop("_b", "_before")


def value_counts(df: DataFrame, value: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """``n`` rows of each distinct value, reduced before any shuffle; NULL values are left out."""
    n = F.sum(weight) if weight else F.count("*")
    return df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(n.alias("n"))


def mid_ranks(df: DataFrame, value: str, buckets: int = 64, weight: str | None = None) -> DataFrame:
    """``value``, ``n``, ``mid_rank`` of each distinct value; ties share the mean rank; NULL has none.

    With ``weight`` a row stands for so many.
    """
    d = _ranked(value_counts(df, value, weight=weight), value, buckets)
    return d.select(value, "n", (F.col("_upto") - (F.col("n") - 1) / 2.0).alias("mid_rank"))


def quantiles(df: DataFrame, value: str, ps: Sequence[float], by: Sequence[str] = (), buckets: int = 64) -> DataFrame:
    """``by``, and ``q``: the exact quantiles, interpolated linearly between order statistics.

    Distinct values are counted and ranked in buckets: no task holds a group.
    A group without values has no row; without groups and values there is none.
    """
    d = _ranked(value_counts(df.select(*by, F.col(value).cast("double").alias("_v")), "_v", by), "_v", buckets, by)
    total = d.groupBy(*by).agg(F.sum("n").alias("_total")) if by else d.agg(F.sum("n").alias("_total"))
    # order statistics are numbered from 0; a value covers n of them
    d = d.join(total, list(by)) if by else d.withColumn("_total", total.scalar())
    at = [(F.col("_total") - 1) * F.lit(float(p)) for p in ps]
    covers = lambda i: (F.col("_upto") - F.col("n") <= i) & (i < F.col("_upto"))
    picked = [F.max(F.when(covers(f(h)), F.col("_v"))).alias(f"_{i}{k}") for i, h in enumerate(at) for k, f in (("lo", F.floor), ("hi", F.ceil))]
    near = d.groupBy(*by, "_total").agg(*picked)
    q = [F.col(f"_{i}lo") + (h - F.floor(h)) * (F.col(f"_{i}hi") - F.col(f"_{i}lo")) for i, h in enumerate(at)]
    return near.select(*by, F.array(*q).alias("q"))


def chi_square(cells: DataFrame) -> DataFrame:
    """statistic, df, p and Cramér's V from a full grid with n and expected."""
    s = cells.agg(F.sum((F.col("n") - F.col("expected")) ** 2 / F.col("expected")).alias("statistic"), F.count_distinct("a").alias("r"), F.count_distinct("b").alias("k"), F.sum("n").alias("total"))
    s = s.select("statistic", ((F.col("r") - 1) * (F.col("k") - 1)).cast("long").alias("df"), F.sqrt(F.col("statistic") / (F.col("total") * (F.least("r", "k") - 1))).alias("cramers_v"))
    return with_p(s, chi2_p, ["statistic", "df"])


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """H with tie correction, degrees of freedom, p.

    Rows are reduced to counts per (group, value) once; values are ranked and
    weighted, not rows.
    """
    counts = checkpointed(value_counts(df.filter(F.col(group).isNotNull()), value, [group]))
    ranks = mid_ranks(counts, value, weight="n")
    g = counts.join(ranks.select(value, "mid_rank"), value).groupBy(group).agg(F.sum(F.col("mid_rank") * F.col("n")).alias("r"), F.sum("n").alias("n"))
    a = g.agg(F.sum(F.col("r") ** 2 / F.col("n")).alias("s"), F.sum("n").alias("n"), F.count("*").alias("k"))
    # ties need the counts alone, not the ranks
    ties = counts.groupBy(value).agg(F.sum("n").alias("n")).agg(F.sum(F.col("n").cast("double") ** 3 - F.col("n"))).scalar()
    n = F.col("n").cast("double")
    one = a.withColumn("ties", ties)
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / (1 - F.col("ties") / (n**3 - n))
    return with_p(one.select(h.alias("statistic"), (F.col("k") - 1).cast("long").alias("df")), chi2_p, ["statistic", "df"])


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way F, both degrees of freedom, p."""
    x = F.col(value).cast("double")
    g = df.filter(F.col(group).isNotNull() & x.isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v"))
    a = g.agg(F.sum("n").alias("n"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("m") ** 2).alias("sq"))
    between = F.col("sq") - F.col("n") * F.col("grand") ** 2
    d1, d2 = F.col("k") - 1, F.col("n") - F.col("k")
    out = a.select((between / d1 / (F.col("within") / d2)).alias("statistic"), d1.cast("long").alias("df1"), d2.cast("long").alias("df2"))
    return with_p(out, f_p, ["statistic", "df1", "df2"])


def wilcoxon_pairs(df: DataFrame, group: str, value: str) -> DataFrame:
    """Rank-sum W of each pair of groups, normal p with continuity and ties, Holm-adjusted.

    Counts per (group, value) are formed once; a pair ranks values, not rows.
    """
    counts = df.filter(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    # a row goes to the pairs of its group with every other level of the factor
    levels = counts.agg(F.collect_set(group)).scalar()
    d = counts.withColumn("_other", F.explode(F.array_except(levels, F.array(group)))).withColumns({"group_a": F.least(group, "_other"), "group_b": F.greatest(group, "_other")})
    v = d.groupBy("group_a", "group_b", value).agg(F.sum(F.when(F.col(group) == F.col("group_a"), F.col("n")).otherwise(0)).alias("na"), F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("group_a", "group_b").orderBy(value))
    v = v.withColumn("rank", upto - (F.col("n") - 1) / 2.0)
    s = v.groupBy("group_a", "group_b").agg(F.sum(F.col("rank") * F.col("na")).alias("r"), F.sum("na").cast("double").alias("na"), F.sum("n").cast("double").alias("n"), F.sum(F.col("n").cast("double") ** 3 - F.col("n")).alias("ties"))
    na, nb, n = F.col("na"), F.col("n") - F.col("na"), F.col("n")
    s = s.withColumn("w", F.col("r") - na * (na + 1) / 2)
    z = F.col("w") - na * nb / 2
    sd = F.sqrt(na * nb / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    s = s.select("group_a", "group_b", "w", ((z - F.signum(z) * 0.5) / sd).alias("z"))
    p = with_p(s, normal_p, ["z"])
    m, rank = F.count("*").over(Window.partitionBy(F.lit(0))), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("p_value", "group_a", "group_b"))
    step = p.withColumn("_s", F.least(F.lit(1.0), (m - rank + 1) * F.col("p_value"))).withColumn("_i", rank)
    return step.withColumn("p_holm", F.max("_s").over(Window.partitionBy(F.lit(0)).orderBy("_i"))).drop("_s", "_i")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """rho, S, t and the p of the t approximation, over counts of distinct pairs."""
    pairs = checkpointed(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n")))
    rx, ry = mid_ranks(pairs, "x", weight="n").select("x", F.col("mid_rank").alias("rx")), mid_ranks(pairs, "y", weight="n").select("y", F.col("mid_rank").alias("ry"))
    total = pairs.agg(F.sum("n")).scalar()
    # ranks about their mean, which is known, so that the sums stay small
    centre = (total + 1) / 2.0
    d = pairs.join(rx, "x").join(ry, "y").withColumns({"rx": F.col("rx") - centre, "ry": F.col("ry") - centre})
    w = F.col("n").cast("double")
    a = d.agg(F.sum(w).alias("n"), F.sum(w * F.col("rx") * F.col("ry")).alias("xy"), F.sum(w * F.col("rx") ** 2).alias("xx"), F.sum(w * F.col("ry") ** 2).alias("yy"))
    a = a.select("n", (F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).alias("rho"))
    n, rho = F.col("n"), F.col("rho")
    out = a.select("rho", ((n**3 - n) * (1 - rho) / 6).alias("s"), (rho * F.sqrt((n - 2) / (1 - rho**2))).alias("t"), (n - 2).alias("df"))
    return with_p(out, t_p, ["t", "df"])


# ---- regression ----


def reduce_arrays(df: DataFrame, fn: Callable[[pd.DataFrame], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Sum the arrays that ``fn`` makes of each batch; only the sums reach the driver."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for f in frames:
            if len(f):
                for k, v in fn(f).items():
                    total[k] = total.get(k, 0) + np.asarray(v, float)
        for k, v in total.items():
            v = np.atleast_1d(v)
            yield pd.DataFrame({"k": k, "shape": [list(v.shape)] * v.size, "i": np.arange(v.size), "v": v.ravel()})

    parts = df.mapInPandas(run, "k string, shape array<int>, i long, v double").groupBy("k", "shape", "i").agg(F.sum("v").alias("v"))
    out: dict[str, np.ndarray] = {}
    for r in parts.collect():  # as many numbers as the model's arrays have
        out.setdefault(r.k, np.zeros(r.shape)).ravel()[r.i] = r.v
    return out


def ols_hc3(df: DataFrame, y: str, xs: Sequence[str]) -> pd.DataFrame:
    """Least squares with an intercept and HC3 errors: term, estimate, se, t, p, low, high; attrs r2, adj_r2, n.

    Rows with a NULL are left out. ``xs`` are numeric columns, dummies included.
    """
    d = df.select(F.col(y).cast("double").alias("y"), *(F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(xs))).dropna()
    k = len(xs) + 1

    def design(f: pd.DataFrame) -> np.ndarray:
        return np.column_stack([np.ones(len(f)), *(f[f"x{i}"] for i in range(k - 1))])

    def gram(f: pd.DataFrame) -> dict:
        x = design(f)
        return {"xx": x.T @ x, "xy": x.T @ f.y, "n": len(f), "y": f.y.sum(), "yy": (f.y**2).sum()}

    g = reduce_arrays(d, gram)
    inv = np.linalg.pinv(g["xx"])
    beta = inv @ g["xy"]

    def meat(f: pd.DataFrame) -> dict:
        x = design(f)
        e = f.y.to_numpy() - x @ beta
        h = np.einsum("ij,jk,ik->i", x, inv, x)
        return {"m": (x * ((e / (1 - h)) ** 2)[:, None]).T @ x, "rss": (e**2).sum()}

    m = reduce_arrays(d, meat)
    n = float(g["n"][0])
    se = np.sqrt(np.diag(inv @ m["m"] @ inv))
    t = beta / se
    q = t_quantile(0.975, n - k)
    out = pd.DataFrame({"term": ["(Intercept)", *xs], "estimate": beta, "se": se, "t": t, "p_value": [t_p(v, n - k) for v in t], "low": beta - q * se, "high": beta + q * se})
    tss = float(g["yy"][0] - g["y"][0] ** 2 / n)
    r2 = 1 - float(m["rss"][0]) / tss
    out.attrs.update(r2=r2, adj_r2=1 - (1 - r2) * (n - 1) / (n - k), n=int(n))
    return out


def t_quantile(p: float, df: float) -> float:
    lo, hi = 0.0, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - t_p(mid, df) / 2 < p else (lo, mid)
    return (lo + hi) / 2


def _digamma(x: np.ndarray) -> np.ndarray:
    x, r = np.array(x, float), 0.0
    for _ in range(8):
        r, x = r - 1 / x, x + 1
    i = 1 / (x * x)
    return r + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i / 252))


def _trigamma(x: np.ndarray) -> np.ndarray:
    x, r = np.array(x, float), 0.0
    for _ in range(8):
        r, x = r + 1 / (x * x), x + 1
    i = 1 / (x * x)
    return r + 1 / x + i / 2 + i / x * (1 / 6 - i * (1 / 30 - i / 42))


def negative_binomial(df: DataFrame, y: str, xs: Sequence[str], offset: str | None = None, rounds: int = 40) -> pd.DataFrame:
    """Log-link negative binomial: term, estimate, se, irr, low, high, p; attrs theta, n.

    Fisher scoring for the coefficients and Newton steps for theta, on sums.
    """
    d = df.select(F.col(y).cast("double").alias("y"), (F.col(offset).cast("double") if offset else F.lit(0.0)).alias("o"), *(F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(xs))).dropna().persist()
    k = len(xs) + 1
    start = reduce_arrays(d, lambda f: {"y": f.y.sum(), "e": np.exp(f.o).sum(), "n": len(f)})
    beta = np.zeros(k)
    beta[0] = math.log(max(float(start["y"][0]), 0.5) / float(start["e"][0]))
    theta = 1.0
    for _ in range(rounds):

        def sums(f: pd.DataFrame, beta=beta, theta=theta) -> dict:
            x = np.column_stack([np.ones(len(f)), *(f[f"x{i}"] for i in range(k - 1))])
            mu = np.exp(np.clip(x @ beta + f.o.to_numpy(), -30, 30))
            yv = f.y.to_numpy()
            w = mu / (1 + mu / theta)
            score = _digamma(yv + theta) - _digamma(np.array(theta)) + math.log(theta) + 1 - np.log(theta + mu) - (yv + theta) / (mu + theta)
            info = -_trigamma(yv + theta) + _trigamma(np.array(theta)) - 1 / theta + 2 / (mu + theta) - (yv + theta) / (mu + theta) ** 2
            return {"g": x.T @ ((yv - mu) / (1 + mu / theta)), "h": (x * w[:, None]).T @ x, "s": score.sum(), "i": info.sum()}

        a = reduce_arrays(d, sums)
        step = np.linalg.pinv(a["h"]) @ a["g"]
        move = float(a["s"][0]) / float(a["i"][0]) if a["i"][0] > 0 else 0.0
        beta, old = beta + step, theta
        theta = min(max(theta + move, theta / 3), theta * 3)
        if np.abs(step).max() < 1e-8 and abs(theta - old) < 1e-7 * theta:
            break
    d.unpersist()
    se = np.sqrt(np.diag(np.linalg.pinv(a["h"])))
    out = pd.DataFrame({"term": ["(Intercept)", *xs], "estimate": beta, "se": se, "irr": np.exp(beta), "low": np.exp(beta - 1.959964 * se), "high": np.exp(beta + 1.959964 * se), "p_value": [normal_p(z) for z in beta / se]})
    out.attrs.update(theta=theta, n=int(start["n"][0]))
    return out


def fractional_logit(df: DataFrame, y: str, xs: Sequence[str], rounds: int = 50) -> pd.DataFrame:
    """Logit model of a share between 0 and 1: term, estimate, se, z, p; robust errors; attr n.

    Newton steps on sums; rows with a NULL are left out.
    """
    d = df.select(F.col(y).cast("double").alias("y"), *(F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(xs))).dropna()
    k = len(xs) + 1
    beta = np.zeros(k)

    def parts(f: pd.DataFrame, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.column_stack([np.ones(len(f)), *(f[f"x{i}"] for i in range(k - 1))])
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        return x, p, f.y.to_numpy() - p

    for _ in range(rounds):

        def sums(f: pd.DataFrame, beta=beta) -> dict:
            x, p, e = parts(f, beta)
            return {"h": (x * (p * (1 - p))[:, None]).T @ x, "g": x.T @ e, "n": len(f)}

        a = reduce_arrays(d, sums)
        step = np.linalg.pinv(a["h"]) @ a["g"]
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break

    def last(f: pd.DataFrame, beta=beta) -> dict:
        x, p, e = parts(f, beta)
        return {"h": (x * (p * (1 - p))[:, None]).T @ x, "m": (x * (e**2)[:, None]).T @ x}

    a = {**a, **reduce_arrays(d, last)}
    bread = np.linalg.pinv(a["h"])
    se = np.sqrt(np.diag(bread @ a["m"] @ bread))
    out = pd.DataFrame({"term": ["(Intercept)", *xs], "estimate": beta, "se": se, "z": beta / se, "p_value": [normal_p(z) for z in beta / se]})
    out.attrs["n"] = int(a["n"][0])
    return out


def interactions(df: DataFrame, a: Sequence[str], b: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Products of each column of one set with each of the other, named ``a:b``."""
    made = {f"{x}:{y}": F.col(f"`{x}`").cast("double") * F.col(f"`{y}`").cast("double") for x in a for y in b}
    return df.withColumns(made), list(made)


def anova_two_way(df: DataFrame, a: str, b: str, value: str) -> pd.DataFrame:
    """Two-way F tests, each main effect given the other (type II), and the interaction.

    Only counts, sums and sums of squares per cell reach the driver: as many
    numbers as the two factors have level pairs.
    """
    x = F.col(value).cast("double")
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & x.isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q")).toPandas()
    n, m = cells.n.to_numpy(float), (cells.s / cells.n).to_numpy(float)
    within = float((cells.q - cells.s**2 / cells.n).sum())
    da = pd.get_dummies(cells.a, drop_first=True).to_numpy(float)
    db = pd.get_dummies(cells.b, drop_first=True).to_numpy(float)
    one = np.ones((len(cells), 1))

    def lack(parts: list[np.ndarray]) -> tuple[float, int]:
        d = np.column_stack(parts)
        w = np.sqrt(n)[:, None]
        beta, _, rank, _ = np.linalg.lstsq(d * w, m * w[:, 0], rcond=None)
        return float((n * (m - d @ beta) ** 2).sum()), int(rank)

    (ra, ka), (rb, kb), (rab, kab) = lack([one, da]), lack([one, db]), lack([one, da, db])
    rest = n.sum() - len(cells)
    rows = [(a, rb - rab, kab - kb), (b, ra - rab, kab - ka), (f"{a}:{b}", rab, len(cells) - kab)]
    out = pd.DataFrame(rows, columns=["effect", "sum_sq", "df"])
    out["statistic"] = [s / k / (within / rest) if k and rest > 0 else float("nan") for s, k in zip(out.sum_sq, out.df)]
    out["p_value"] = [f_p(f, k, rest) if f == f else float("nan") for f, k in zip(out.statistic, out.df)]
    return out


def dummies(df: DataFrame, col: str, levels: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """0/1 columns for all levels but the first, which is the reference."""
    names = [f"{col}_{i}" for i in range(1, len(levels))]
    return df.withColumns({n: (F.col(col) == v).cast("double") for n, v in zip(names, levels[1:])}), names


def winsorize(df: DataFrame, col: str, p: float = 0.01, out: str = "winsorized") -> DataFrame:
    """Values drawn in to the p and 1 - p quantiles."""
    q = checkpointed(quantiles(df, col, (p, 1 - p)))
    lo, hi = q.select(F.col("q")[0]).scalar(), q.select(F.col("q")[1]).scalar()
    return df.withColumn(out, F.greatest(F.least(F.col(col), hi), lo))


def impute_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NULL values replaced by the column's median, or 0 if it has none."""
    for c in cols:
        m = quantiles(df, c, (0.5,)).agg(F.coalesce(F.max(F.col("q")[0]), F.lit(0.0))).scalar()
        df = df.withColumn(c, F.coalesce(F.col(c).cast("double"), m))
    return df
