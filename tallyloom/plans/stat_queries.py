"""Tests, regressions and classifiers."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import learning as ML
from tallyloom.operators import rollups as R
from tallyloom.operators import stats as T
from tallyloom.operators.sampling import stratified_split
from tallyloom.plans.views import comments, labels
from tallyloom.session import checkpointed, shared_folder, table
from tallyloom.streaming import streams


def order_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with line and return counts, rate, status and priority."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("returns"), F.round(F.avg("l_quantity"), 9).alias("quantity"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey").withColumn("rate", F.col("returns") / F.col("lines"))


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def chi_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Independence of order status and priority."""
    x = T.chi_square(R.crosstab(table(spark, sf_dir, "orders"), F.col("o_orderstatus"), F.col("o_orderpriority")))
    return _rounded(x, statistic=6, cramers_v=9, p_value=9)


def chi_square_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its p-value, printed."""
    from tallyloom.functions.text import p_value_text

    x = T.chi_square(R.crosstab(table(spark, sf_dir, "orders"), F.col("o_orderstatus"), F.col("o_orderpriority")))
    return x.select("df", p_value_text(F.col("p_value")).alias("p_text"))


def kruskal_wallis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H of return rates over priorities."""
    return _rounded(T.kruskal(order_returns(spark, sf_dir), "o_orderpriority", "rate"), statistic=5, p_value=8)


def anova_oneway(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F of return rates over priorities."""
    return _rounded(T.anova(order_returns(spark, sf_dir), "o_orderpriority", "rate"), statistic=6, p_value=8)


def anova_twoway(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return rates by status and priority, and their interaction."""
    out = spark.createDataFrame(T.anova_two_way(order_returns(spark, sf_dir), "o_orderstatus", "o_orderpriority", "rate"))
    return _rounded(out, sum_sq=6, statistic=5, p_value=6)


def wilcoxon_holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank sums of return rates for each pair of statuses, p-values adjusted."""
    return _rounded(T.wilcoxon_pairs(order_returns(spark, sf_dir), "o_orderstatus", "rate"), w=4, z=6, p_value=6, p_holm=6)


def wilcoxon_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank sums alone."""
    return wilcoxon_holm(spark, sf_dir).select("group_a", "group_b", "w")


def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of lines and mean quantity of an order."""
    s = T.spearman(order_returns(spark, sf_dir), "lines", "quantity")
    # S has up to fifteen digits before the point
    return s.select(F.round("rho", 8).alias("rho"), F.log10("s").alias("log10_s"), F.round("t", 5).alias("t"), F.round("p_value", 6).alias("p_value")).withColumn("log10_s", F.round("log10_s", 7))


def winsorized_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean price per flag, drawn in to the 1 % and 99 % quantiles."""
    w = T.winsorize(table(spark, sf_dir, "lineitem"), "l_extendedprice")
    return w.groupBy("l_returnflag").agg(F.round(F.avg("winsorized"), 4).alias("mean"))


def median_imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean likes per source with missing ones set to the median."""
    return T.impute_median(comments(spark, sf_dir, "source"), ["likes"]).groupBy("source").agg(F.round(F.avg("likes"), 6).alias("mean_likes"))


def _terms(spark: SparkSession, x: pd.DataFrame, more: dict) -> DataFrame:
    return spark.createDataFrame(x.assign(**more))


def ols_hc3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return rate on priority dummies, log price and lines, with HC3 errors."""
    d, names = T.dummies(order_returns(spark, sf_dir).withColumn("log_price", F.log1p("o_totalprice")), "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])
    d = d.withColumn("lines_d", F.col("lines").cast("double"))
    present = [n for n, v in d.agg(*(F.sum(n).alias(n) for n in names)).first().asDict().items() if v]
    fit = T.ols_hc3(d, "rate", [*present, "log_price", "lines_d"])
    return _terms(spark, fit, {"r2": fit.attrs["r2"], "n": fit.attrs["n"]})


def ols_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refits: orders with returns only, winsorised rate, counts, orders of four lines or more."""
    base = order_returns(spark, sf_dir).withColumns({"log_price": F.log1p("o_totalprice"), "urgent": (F.col("o_orderpriority") == "1-URGENT").cast("double")})
    out = None
    for name, d, y in (("nonzero", base.filter("returns > 0"), "rate"), ("winsorised", T.winsorize(base, "rate"), "winsorized"), ("count", base.withColumn("log_returns", F.log1p("returns")), "log_returns"), ("four lines", base.filter("lines >= 4"), "rate")):
        fit = T.ols_hc3(d, y, ["urgent", "log_price"])
        one = _terms(spark, fit, {"model": name, "r2": fit.attrs["r2"], "n": fit.attrs["n"]})
        out = one if out is None else out.unionByName(one)
    return out


def neg_binomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns on quantity, urgency and their interaction, with lines as exposure."""
    d = order_returns(spark, sf_dir).withColumns({"log_lines": F.log(F.col("lines").cast("double")), "q": F.col("quantity") / 10, "urgent": (F.col("o_orderpriority") == "1-URGENT").cast("double")})
    d, both = T.interactions(d, ["q"], ["urgent"])
    fit = T.negative_binomial(d, "returns", ["q", "urgent", *both], "log_lines")
    return _terms(spark, fit, {"theta": fit.attrs["theta"], "n": fit.attrs["n"]})


def fractional_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return rate as a share, on urgency and log price."""
    d = order_returns(spark, sf_dir).withColumns({"log_price": F.log1p("o_totalprice"), "urgent": (F.col("o_orderpriority") == "1-URGENT").cast("double")})
    fit = T.fractional_logit(d, "rate", ["urgent", "log_price"])
    return _terms(spark, fit, {"n": fit.attrs["n"]})


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = labels(spark, sf_dir).filter("record_table = 'comments'").select(F.col("record_id").cast("long").alias("id"), F.coalesce("adjudicated", F.when(F.col("a") == F.col("b"), F.col("a"))).alias("label")).filter("label is not null").groupBy("id").agg(F.max("label").alias("label"))
    return comments(spark, sf_dir).filter("text is not null").join(lab, "id").select("id", "text", "label")


def _trained(spark: SparkSession, sf_dir: str, fit) -> DataFrame:
    d = stratified_split(ML.char_grams(_labelled(spark, sf_dir), "text"), "label", "id").persist()
    t = ML.TfIdf(d.filter("split = 'train'"))
    model = fit(t.transform(d.filter("split = 'train'")))
    s = ML.scored(model, t.transform(d.filter("split = 'test'")))
    # one row, kept so that the split can be let go
    out = checkpointed(R.binary_metrics(s, "label", "pred_label"))
    d.unpersist()
    return out


def tfidf_logreg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out metrics of the tf-idf logistic baseline."""
    return _trained(spark, sf_dir, ML.logistic)


def tfidf_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out metrics of the tf-idf support vector baseline."""
    return _trained(spark, sf_dir, ML.support_vectors)


def _stream_out(spark: SparkSession, df: DataFrame, mode: str = "append") -> DataFrame:
    # results go where the cluster shares files
    out = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    streams.run_now(df, f"{out}/data", f"{out}/log", mode).awaitTermination()
    done = checkpointed(spark.read.parquet(f"{out}/data"))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return done


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events")
    return spark.readStream.schema(d.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per day and type by a stream with a watermark; windows still open at the end are not out yet."""
    w = streams.tumbling(_event_stream(spark, sf_dir), "ts", "1 day", ["event_type"])
    return _stream_out(spark, w).select(F.unix_seconds("window_start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by a stream, each id once."""
    return _stream_out(spark, streams.once_only(_event_stream(spark, sf_dir), "ts", ["event_id"])).groupBy("event_type").agg(F.count("*").alias("n"))


_O = """r AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice, count(*) AS lines, count(*) FILTER (l_returnflag = 'R') AS returns, round(avg(l_quantity), 9) AS quantity, count(*) FILTER (l_returnflag = 'R')::DOUBLE / count(*) AS rate
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4)"""
#: Terms of the upper chi-square tail for an even number of degrees of freedom.
_CHI2 = "exp(-x / 2) * (SELECT sum(pow(x / 2, i) / gamma(i + 1)) FROM generate_series(0, df // 2 - 1) AS t(i))"
#: Two-sided tails by Simpson's rule over [0, |z|]: of the normal and, with d degrees of freedom, of t.
_STEPS = "generate_series(0, 2000) AS t(i)"
_SIMPSON = "CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
_NORMAL = f"1 - 2 * (SELECT sum({_SIMPSON} * exp(-pow(abs(z) * i / 2000.0::DOUBLE, 2) / 2)) FROM {_STEPS}) * abs(z) / 6000.0::DOUBLE / sqrt(2 * pi())"
_T = f"1 - 2 * (SELECT sum({_SIMPSON} * pow(1 + pow(abs(t) * i / 2000.0::DOUBLE, 2) / d, -(d + 1) / 2)) FROM generate_series(0, 2000) AS g(i)) * abs(t) / 6000.0::DOUBLE * exp(lgamma((d + 1) / 2) - lgamma(d / 2)) / sqrt(d * pi())"
_CELLS = """WITH n AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2), ra AS (SELECT a, sum(n) AS r FROM n GROUP BY 1), cb AS (SELECT b, sum(n) AS c FROM n GROUP BY 1), t AS (SELECT sum(n)::DOUBLE AS t FROM n),
        e AS (SELECT coalesce(n, 0) AS n, r::DOUBLE * c / t AS e FROM ra CROSS JOIN cb CROSS JOIN t LEFT JOIN n USING (a, b)), x AS (SELECT sum((n - e) * (n - e) / e) AS x FROM e), k AS (SELECT (SELECT count(*) FROM ra) AS ka, (SELECT count(*) FROM cb) AS kb),
        s AS (SELECT x, (ka - 1) * (kb - 1) AS df, sqrt(x / (t * (least(ka, kb) - 1))) AS v FROM x, k, t)"""
ORACLE = {
    "chi_square": f"{_CELLS} SELECT round(x, 6) AS statistic, CAST(df AS BIGINT) AS df, round(v, 9) AS cramers_v, round({_CHI2}, 9) AS p_value FROM s",
    "chi_square_p": f"{_CELLS}, p AS (SELECT df, {_CHI2} AS p FROM s) SELECT CAST(df AS BIGINT) AS df, CASE WHEN p < 0.001 THEN '<0.001' ELSE printf('%.3f', p) END AS p_text FROM p",
    "kruskal_wallis": f"""WITH {_O}, k AS (SELECT o_orderpriority AS g, rate, rank() OVER (ORDER BY rate) + (count(*) OVER (PARTITION BY rate) - 1) / 2.0::DOUBLE AS mr FROM r), n AS (SELECT count(*)::DOUBLE AS n FROM k),
        s AS (SELECT sum(q * q / c) AS s, count(*) AS m FROM (SELECT g, sum(mr) AS q, count(*) AS c FROM k GROUP BY 1)), t AS (SELECT sum(c::DOUBLE * c * c - c) AS t FROM (SELECT rate, count(*) AS c FROM k GROUP BY 1)),
        h AS (SELECT (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - t / (n * n * n - n)) AS x, m - 1 AS df FROM s, n, t)
        SELECT round(x, 5) AS statistic, CAST(df AS BIGINT) AS df, round({_CHI2}, 8) AS p_value FROM h""",
    "anova_oneway": f"""WITH {_O}, g AS (SELECT o_orderpriority AS g, count(*) AS n, avg(rate) AS m, var_pop(rate) AS v FROM r GROUP BY 1), a AS (SELECT sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS gm FROM g),
        f AS (SELECT (sum(g.n * (g.m - gm) * (g.m - gm)) / (any_value(a.k) - 1)) / (sum(g.n * g.v) / (any_value(a.n) - any_value(a.k))) AS f, (any_value(a.k) - 1)::DOUBLE AS d1, (any_value(a.n) - any_value(a.k))::DOUBLE AS d2 FROM g, a),
        x AS (SELECT *, d2 / (d2 + d1 * f) AS x FROM f)
        SELECT round(f, 6) AS statistic, CAST(d1 AS BIGINT) AS df1, CAST(d2 AS BIGINT) AS df2,
               round(pow(x, d2 / 2) * (SELECT sum(exp(lgamma(d2 / 2 + i) - lgamma(d2 / 2) - lgamma(i + 1.0)) * pow(1 - x, i)) FROM generate_series(0, CAST(d1 AS BIGINT) // 2 - 1) AS t(i)), 8) AS p_value FROM x""",
    "wilcoxon_holm": f"""WITH {_O}, l AS (SELECT DISTINCT o_orderstatus AS g FROM r), p AS (SELECT x.g AS group_a, y.g AS group_b FROM l x JOIN l y ON x.g < y.g),
        d AS (SELECT group_a, group_b, o_orderstatus AS g, rank() OVER w + (count(*) OVER (PARTITION BY group_a, group_b, rate) - 1) / 2.0::DOUBLE AS mr, count(*) OVER (PARTITION BY group_a, group_b, rate)::DOUBLE AS c FROM p JOIN r ON o_orderstatus IN (group_a, group_b) WINDOW w AS (PARTITION BY group_a, group_b ORDER BY rate)),
        s AS (SELECT group_a, group_b, sum(mr) FILTER (g = group_a) AS ra, count(*) FILTER (g = group_a)::DOUBLE AS na, count(*)::DOUBLE AS n, sum(c * c - 1) AS ties FROM d GROUP BY 1, 2),
        w AS (SELECT *, ra - na * (na + 1) / 2 AS w, n - na AS nb FROM s), k AS (SELECT *, w - na * nb / 2 AS e FROM w),
        z AS (SELECT group_a, group_b, w, (e - sign(e) * 0.5) / sqrt(na * nb / 12 * (n + 1 - ties / (n * (n - 1)))) AS z FROM k), q AS (SELECT *, {_NORMAL} AS p FROM z),
        h AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, group_a, group_b) + 1) * p) AS hs, row_number() OVER (ORDER BY p, group_a, group_b) AS i FROM q)
        SELECT group_a, group_b, round(w, 4) AS w, round(z, 6) AS z, round(p, 6) AS p_value, round(max(hs) OVER (ORDER BY i), 6) AS p_holm FROM h""",
    "anova_twoway": f"""WITH {_O}, x AS (SELECT o_orderstatus AS a, o_orderpriority AS b, rate AS v FROM r), c AS (SELECT a, b, count(*)::DOUBLE AS n, avg(v) AS m, var_pop(v) * count(*) AS w FROM x GROUP BY 1, 2),
        -- each factor given the other by alternating fits of the cell means
        la AS (SELECT list(DISTINCT a ORDER BY a) AS xs FROM c), total AS (SELECT sum(n) AS n, sum(w) AS w, count(*) AS cells, count(DISTINCT a) AS ka, count(DISTINCT b) AS kb FROM c),
        ma AS (SELECT a, sum(n * m) / sum(n) AS e FROM c GROUP BY 1), mb AS (SELECT b, sum(n * m) / sum(n) AS e FROM c GROUP BY 1),
        ra AS (SELECT sum(n * (m - e) * (m - e)) AS s FROM c JOIN ma USING (a)), rb AS (SELECT sum(n * (m - e) * (m - e)) AS s FROM c JOIN mb USING (b)),
        {{fits}}
        f AS (SELECT sum(c.n * (c.m - x.e - y.e) * (c.m - x.e - y.e)) AS s FROM c JOIN a{{last}} x USING (a) JOIN b{{last}} y USING (b)),
        o AS (SELECT 'o_orderstatus' AS effect, rb.s - f.s AS sum_sq, ka - 1 AS df FROM rb, f, total UNION ALL SELECT 'o_orderpriority', ra.s - f.s, kb - 1 FROM ra, f, total UNION ALL SELECT 'o_orderstatus:o_orderpriority', f.s, cells - ka - kb + 1 FROM f, total),
        q AS (SELECT effect, sum_sq, df, sum_sq / df / (w / (n - cells)) AS st, n - cells AS d2, df::DOUBLE AS d1 FROM o, total), x2 AS (SELECT *, d2 / (d2 + d1 * st) AS x FROM q)
        SELECT effect, round(sum_sq, 6) AS sum_sq, CAST(df AS BIGINT) AS df, round(st, 5) AS statistic,
               round(pow(x, d2 / 2) * (SELECT sum(exp(lgamma(d2 / 2 + i) - lgamma(d2 / 2) - lgamma(i + 1.0)) * pow(1 - x, i)) FROM generate_series(0, CAST(d1 AS BIGINT) // 2 - 1) AS t(i)), 6) AS p_value FROM x2""".format(
        fits=" ".join(f"a{i} AS (SELECT a, sum(c.n * (c.m - {'0' if i == 0 else 'y.e'})) / sum(c.n) AS e FROM c {'' if i == 0 else f'JOIN b{i - 1} y USING (b)'} GROUP BY 1), b{i} AS (SELECT b, sum(c.n * (c.m - x.e)) / sum(c.n) AS e FROM c JOIN a{i} x USING (a) GROUP BY 1)," for i in range(12)), last=11
    ),
    "wilcoxon_w": f"""WITH {_O}, l AS (SELECT DISTINCT o_orderstatus AS g FROM r), p AS (SELECT x.g AS group_a, y.g AS group_b FROM l x JOIN l y ON x.g < y.g),
        d AS (SELECT group_a, group_b, o_orderstatus AS g, rank() OVER (PARTITION BY group_a, group_b ORDER BY rate) + (count(*) OVER (PARTITION BY group_a, group_b, rate) - 1) / 2.0::DOUBLE AS mr FROM p JOIN r ON o_orderstatus IN (group_a, group_b))
        SELECT group_a, group_b, round(sum(mr) FILTER (g = group_a) - count(*) FILTER (g = group_a) * (count(*) FILTER (g = group_a) + 1) / 2.0::DOUBLE, 4) AS w FROM d GROUP BY 1, 2""",
    "spearman": f"""WITH {_O}, k AS (SELECT rank() OVER (ORDER BY lines) + (count(*) OVER (PARTITION BY lines) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY quantity) + (count(*) OVER (PARTITION BY quantity) - 1) / 2.0::DOUBLE AS b FROM r)
        , s AS (SELECT corr(a, b) AS rho, count(*)::DOUBLE AS n FROM k), u AS (SELECT *, rho * sqrt((n - 2) / (1 - rho * rho)) AS t, n - 2 AS d FROM s)
        SELECT round(rho, 8) AS rho, round(log10((n * n * n - n) * (1 - rho) / 6), 7) AS log10_s, round(t, 5) AS t, round({_T}, 6) AS p_value FROM u""",
    "stream_tumbling": """WITH w AS (SELECT date_trunc('day', ts) AS d, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2)
        SELECT CAST(epoch(d) AS BIGINT) AS window_start, event_type, n, total FROM w WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
    "stream_once": "SELECT event_type, count(*) AS n FROM (SELECT DISTINCT ON (event_id) event_id, event_type FROM events) GROUP BY 1",
    "winsorized_mean": "WITH q AS (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem) SELECT l_returnflag, round(avg(greatest(least(l_extendedprice, hi), lo)), 4) AS mean FROM lineitem, q GROUP BY 1",
    "median_imputed": "WITH c AS (SELECT id, source, like_count AS likes FROM comments QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, level DESC NULLS LAST, text DESC NULLS LAST, like_count DESC NULLS LAST) = 1) SELECT source, round(avg(coalesce(likes, (SELECT coalesce(median(likes), 0) FROM c))), 6) AS mean_likes FROM c GROUP BY 1",
}
QUERIES = {f.__name__: f for f in (chi_square, chi_square_p, kruskal_wallis, anova_oneway, anova_twoway, wilcoxon_holm, wilcoxon_w, spearman, winsorized_mean, median_imputed, ols_hc3, ols_robustness, neg_binomial, fractional_logit, tfidf_logreg, tfidf_svm, stream_tumbling, stream_once)}
