"""Labels, samples, counts, sets, time and scalars over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.operators import rollups as R
from tallyloom.operators.stats import quantiles
from tallyloom.operators import sampling as P
from tallyloom.operators.sequences import latest, top_per_group
from tallyloom.plans.views import SQL_COMMENTS, SQL_LABELS, SQL_VIDEOS, comments, labels, videos
from tallyloom.session import table


def label_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the annotators' normalised labels."""
    return labels(spark, sf_dir).groupBy("a", "b", "adjudicated").agg(F.count("*").alias("n"))


def kappa_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells, accuracy, precision, recall, f1 and kappa of one annotator against the other."""
    m = R.binary_metrics(labels(spark, sf_dir), "a", "b")
    return m.select("tp", "fp", "fn", "tn", "n", *(F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "f1", "kappa")))


def confusion_adjudicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two by two table of annotator a against the adjudicated label, empty cells kept."""
    d = labels(spark, sf_dir).filter("a is not null and adjudicated is not null")
    return R.crosstab(d, F.col("adjudicated"), F.col("a")).select("a", "b", "n")


def disagreement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows on which the annotators differ."""
    return labels(spark, sf_dir).filter("a <> b").select("record_table", "record_id", "a", "b")


def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall, f1 and support per class of annotator b against the adjudicated label."""
    r = R.class_report(labels(spark, sf_dir), "adjudicated", "b")
    return r.select("class", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")), "support")


def error_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten comments of each source with the most likes among those whose annotator erred."""
    e = labels(spark, sf_dir).filter("record_table = 'comments' and adjudicated is not null and a is not null and a <> adjudicated").select(F.col("record_id").cast("long").alias("id")).distinct()
    d = comments(spark, sf_dir, "source").join(e, "id").select("id", "source", "likes")
    return top_per_group(d, ["source"], [F.desc_nulls_last("likes"), "id"], 10)


def top_liked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty most liked comments: sort and limit in one step."""
    return comments(spark, sf_dir).select("id", "likes").orderBy(F.desc_nulls_last("likes"), "id").limit(20)


def video_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments of the fifty busiest videos, all others as one."""
    return P.top_or_other(comments(spark, sf_dir), "video_id", 50).groupBy("video_group").agg(F.count("*").alias("n"))


def length_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments per quintile of length."""
    d = comments(spark, sf_dir).filter("text is not null").select("id", F.length("text").alias("len"))
    return P.quantile_bins(d, "len").groupBy("bin").agg(F.count("*").alias("n"), F.min("len").alias("low"), F.max("len").alias("high"))


def largest_remainder_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quota of each document source in a sample of 500."""
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.count_distinct("doc_id").alias("size"))
    return P.largest_remainder(d, "source", "size", 500)


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 300 documents by source and kind."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("|", "source", "text_kind").alias("stratum")).distinct()
    return P.stratified_sample(d, "stratum", "doc_id", 300).select("doc_id", "stratum")


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjudicated rows split 80, 10, 10 within each label."""
    d = labels(spark, sf_dir).filter("adjudicated is not null").select(F.concat_ws("/", "record_table", "record_id").alias("rid"), "adjudicated").distinct()
    # the smallest tables hold a label or two
    return P.stratified_split(d, "adjudicated", "rid", least=0).select("rid", "adjudicated", "split")


def task_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of a video in batches of four."""
    d = table(spark, sf_dir, "slices").select("video_id", "run_name", "segment_index").distinct()
    return P.batches(d, ["run_name", "segment_index"], 4, ["video_id"]).groupBy("video_id").agg(F.max("batch").alias("last_batch"))


def freq_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequency and share of document languages, blanks as one level."""
    f = R.frequency(table(spark, sf_dir, "documents"), F.col("lang"))
    return f.select("level", "n", F.round("share", 9).alias("share"))


def numeric_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Description of line item measures."""
    d = R.describe(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return d.select("variable", "n", "missing", *(F.round(c, 6).alias(c) for c in ("mean", "sd", "median", "p25", "p75", "low", "high")))


def combo_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, median and quartiles of order totals by status and priority."""
    d = table(spark, sf_dir, "orders").select(F.concat_ws(" × ", "o_orderstatus", "o_orderpriority").alias("combo"), "o_totalprice")
    g = d.groupBy("combo").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean")).join(quantiles(d, "o_totalprice", (0.25, 0.5, 0.75), ["combo"]), "combo", "left")
    return g.select("combo", "n", "mean", *(F.round(F.col("q")[i], 4).alias(k) for i, k in enumerate(("p25", "median", "p75"))))


def crosstab_full_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order status by priority: counts, shares, expected."""
    c = R.crosstab(table(spark, sf_dir, "orders"), F.col("o_orderstatus"), F.col("o_orderpriority"))
    return c.select("a", "b", "n", *(F.round(k, 6).alias(k) for k in ("row_share", "col_share", "expected")))


def mean_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute distance of event values from the global mean, per type."""
    d = table(spark, sf_dir, "events")
    m = d.agg(F.avg("value")).scalar()
    return d.withColumn("i", F.abs(F.col("value") - m)).groupBy("event_type").agg(F.round(F.avg("i"), 6).alias("mean_deviation"))


def year_month_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per month."""
    return table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def day_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per day since the first."""
    d = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d"))
    return d.withColumn("day_index", F.datediff("d", d.agg(F.min("d")).scalar())).groupBy("day_index").agg(F.count("*").alias("n"))


def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last event of each user: an upsert's result."""
    return latest(table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_type"), ["user_id"], ["at", "event_id"])


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the number in their JSON."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    return table(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def stats_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digg and share counts from the videos' JSON, 0 where missing."""
    p = F.try_parse_json("stats")
    num = lambda k: F.coalesce(F.try_variant_get(p, f"$.{k}", "long"), F.lit(0))
    return videos(spark, sf_dir).select("id", num("digg_count").alias("diggs"), num("share_count").alias("shares"))


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links in comments by scheme and host, with distinct paths."""
    d = comments(spark, sf_dir).select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(https?://[A-Za-z0-9./_-]+)"), F.lit(1))).alias("u"))
    u = d.select(X.url_parts(F.col("u")).alias("p"))
    return u.groupBy(F.col("p.scheme").alias("scheme"), F.col("p.host").alias("host")).agg(F.count("*").alias("n"), F.count_distinct("p.path").alias("n_paths"))


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe names of parts."""
    return table(spark, sf_dir, "part").select("p_partkey", X.slug(F.col("p_name")).alias("slug"), F.upper(F.trim("p_brand")).alias("brand"))


def prefix_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document sources by known prefix, else the text before the underscore."""
    return table(spark, sf_dir, "documents").groupBy(X.prefix_source(F.col("source"), ("transcript", "press_digest")).alias("origin")).agg(F.count("*").alias("n"))


def first_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First supplier of each nation with a positive balance."""
    return table(spark, sf_dir, "supplier").filter("s_acctbal > 0").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("s_suppkey"))


def orders_without_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders no line item belongs to."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), "k", "left_anti").withColumnRenamed("k", "o_orderkey")


def dimension_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, suppliers and their balances per region: chained joins of small tables."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("nc"), F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).alias("cc"))
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("ns"))
    j = n.join(c, n.n_nationkey == c.c_nationkey, "left").join(s, n.n_nationkey == s.s_nationkey, "left")
    return j.groupBy("r_name").agg(F.coalesce(F.sum("nc"), F.lit(0)).alias("n_customers"), F.coalesce(F.sum("ns"), F.lit(0)).alias("n_suppliers"), F.coalesce(F.sum("cc"), F.lit(0)).alias("balance_cents"))


def math_primitives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log1p, sqrt, sigmoid and clamp of line item measures, summed per flag."""
    d = table(spark, sf_dir, "lineitem").withColumns({"lg": F.log1p("l_extendedprice"), "sq": F.sqrt("l_quantity"), "sg": X.sigmoid(F.col("l_quantity") / 10 - 2), "cl": F.greatest(F.least(F.col("l_discount"), F.lit(0.08)), F.lit(0.02))})
    return d.groupBy("l_returnflag").agg(*(F.round(F.avg(c), 6).alias(c) for c in ("lg", "sq", "sg", "cl")))


def softmax_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax over three scores of a line item: mean confidence and share below 0.6."""
    s = X.softmax([F.col("l_discount") * 20, F.col("l_tax") * 20, F.col("l_quantity") / 25])
    d = table(spark, sf_dir, "lineitem").select("l_linestatus", F.greatest(*s).alias("p"))
    return d.groupBy("l_linestatus").agg(F.round(F.avg("p"), 6).alias("confidence"), F.round(F.avg((F.col("p") < 0.6).cast("double")), 6).alias("low_share"))


def row_bind_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of two dimensions in one table with a tag."""
    a = table(spark, sf_dir, "region").select(F.lit("region").alias("kind"), F.col("r_regionkey").cast("long").alias("k"), F.col("r_name").alias("name"))
    return a.unionByName(table(spark, sf_dir, "nation").select(F.lit("nation").alias("kind"), F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name")))


def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with and without orders, and orders' customers not in the table."""
    c, o = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    n = lambda d, tag: d.agg(F.count("*").alias("n")).select(F.lit(tag).alias("part"), "n")
    return n(c.intersect(o), "both").unionByName(n(c.subtract(o), "customers only")).unionByName(n(o.subtract(c), "orders only"))


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items per flag and status, in cents to be exact."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.sum(cents).alias("cents"), F.round(F.avg("l_discount"), 9).alias("mean_discount"))


def rollup_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by year and status with subtotals."""
    d = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y"), "o_orderstatus")
    return d.rollup("y", "o_orderstatus").agg(F.count("*").alias("n"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and values per day and type: the batch twin of the tumbling stream."""
    d = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return d.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.unix_seconds("window.start").alias("window_start"), "event_type", "n", "total")


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user with gaps of at most six hours: the batch twin of the session stream."""
    d = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = d.groupBy(F.session_window("ts", "6 hours"), "user_id").agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


def tail_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events after the first half of the log by id: count, span, and value per type."""
    d = table(spark, sf_dir, "events")
    last = d.agg(F.floor((F.min("event_id") + F.max("event_id")) / 2)).scalar()
    return d.filter(F.col("event_id") > last).groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and newest update of each content table."""
    out = None
    for name, col in (("videos", "updated_at"), ("comments", "updated_at"), ("comment_rows", "exported_at"), ("documents", "collected_at")):
        d = table(spark, sf_dir, name).agg(F.count("*").alias("n"), F.unix_micros(F.max(F.col(col).cast("timestamp"))).alias("newest_us")).select(F.lit(name).alias("name"), "n", "newest_us")
        out = d if out is None else out.unionByName(d)
    return out


def fallback_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos with comments of the primary source, and of the fallback only where the primary has none."""
    c = comments(spark, sf_dir, "source")
    p = c.filter("source = 'primary'").groupBy("video_id").agg(F.count("*").alias("n")).withColumn("used", F.lit("primary"))
    f = c.filter("source = 'fallback'").groupBy("video_id").agg(F.count("*").alias("n")).withColumn("used", F.lit("fallback"))
    every = p.unionByName(f.join(p.select("video_id"), "video_id", "left_anti"))
    return every.groupBy("used").agg(F.count("*").alias("n_videos"), F.sum("n").alias("n_comments"))


def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct part types of each brand in order of first appearance."""
    d = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("first"))
    return d.groupBy("p_brand").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "p_type"))), lambda x: x["p_type"]), "|").alias("types"))


def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers in turn: place in their nation and slot of three."""
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.pmod(F.row_number().over(w) - 1, F.lit(3)).alias("slot"))


_S = "coalesce(nullif(trim({c}::VARCHAR), ''), '{m}')"
ORACLE = {
    "label_normalize": f"WITH {SQL_LABELS} SELECT a, b, adjudicated, count(*) AS n FROM l GROUP BY 1, 2, 3",
    "kappa_agreement": f"""WITH {SQL_LABELS}, k AS (SELECT count(*) FILTER (a = 1 AND b = 1) AS tp, count(*) FILTER (a = 0 AND b = 1) AS fp, count(*) FILTER (a = 1 AND b = 0) AS fn, count(*) FILTER (a = 0 AND b = 0) AS tn, count(*) AS n FROM l WHERE a IS NOT NULL AND b IS NOT NULL),
        m AS (SELECT *, (tp + tn)::DOUBLE / n AS po, ((tp + fp)::DOUBLE * (tp + fn) + (fn + tn)::DOUBLE * (fp + tn)) / (n::DOUBLE * n) AS pe, tp::DOUBLE / (tp + fp) AS p, tp::DOUBLE / (tp + fn) AS r FROM k)
        SELECT tp, fp, fn, tn, n, round(po, 9) AS accuracy, round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / (p + r), 9) AS f1, round((po - pe) / (1 - pe), 9) AS kappa FROM m""",
    "confusion_adjudicated": f"""WITH {SQL_LABELS}, d AS (SELECT adjudicated::VARCHAR AS x, a::VARCHAR AS y FROM l WHERE a IS NOT NULL AND adjudicated IS NOT NULL)
        SELECT g.x AS a, h.y AS b, (SELECT count(*) FROM d WHERE d.x = g.x AND d.y = h.y) AS n FROM (SELECT DISTINCT x FROM d) g, (SELECT DISTINCT y FROM d) h""",
    "disagreement_rows": f"WITH {SQL_LABELS} SELECT record_table, record_id, a, b FROM l WHERE a <> b",
    "class_report": f"""WITH {SQL_LABELS}, d AS (SELECT adjudicated AS t, b AS g FROM l WHERE adjudicated IS NOT NULL AND b IS NOT NULL),
        k AS (SELECT c, count(*) FILTER (t = c AND g = c) AS tp, count(*) FILTER (g = c) AS ng, count(*) FILTER (t = c) AS support FROM d, (SELECT unnest([0, 1]) AS c) GROUP BY 1),
        m AS (SELECT c, CASE WHEN ng = 0 THEN 0.0 ELSE tp::DOUBLE / ng END AS p, CASE WHEN support = 0 THEN 0.0 ELSE tp::DOUBLE / support END AS r, support FROM k),
        f AS (SELECT *, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f FROM m)
        SELECT c::VARCHAR AS class, round(p, 9) AS precision, round(r, 9) AS recall, round(f, 9) AS f1, support FROM f
        UNION ALL SELECT 'macro avg', round(avg(p), 9), round(avg(r), 9), round(avg(f), 9), CAST(sum(support) AS BIGINT) FROM f
        UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 9), round(sum(r * support) / sum(support), 9), round(sum(f * support) / sum(support), 9), CAST(sum(support) AS BIGINT) FROM f""",
    "error_topk": f"""WITH {SQL_COMMENTS}, {SQL_LABELS}, e AS (SELECT DISTINCT record_id::BIGINT AS id FROM l WHERE record_table = 'comments' AND a <> adjudicated)
        SELECT id, source, likes FROM c JOIN e USING (id) QUALIFY row_number() OVER (PARTITION BY source ORDER BY likes DESC NULLS LAST, id) <= 10""",
    "top_liked": f"WITH {SQL_COMMENTS} SELECT id, likes FROM c ORDER BY likes DESC NULLS LAST, id LIMIT 20",
    "video_groups": f"""WITH {SQL_COMMENTS}, d AS (SELECT {_S.format(c="video_id", m="MISSING")} AS v FROM c), t AS (SELECT v FROM d GROUP BY 1 ORDER BY count(*) DESC, v LIMIT 50)
        SELECT CASE WHEN v IN (SELECT v FROM t) THEN v ELSE 'OTHER' END AS video_group, count(*) AS n FROM d GROUP BY 1""",
    "length_bins": f"""WITH {SQL_COMMENTS}, d AS (SELECT length(text) AS len FROM c WHERE text IS NOT NULL),
        e AS (SELECT list_distinct(quantile_cont(len::DOUBLE, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS q FROM d), u AS (SELECT list_sort(q) AS q FROM e),
        b AS (SELECT len, CAST(len(list_filter(u.q[2:], lambda x: d.len > x)) AS INT) AS bin FROM d, u)
        SELECT bin, count(*) AS n, CAST(min(len) AS INT) AS low, CAST(max(len) AS INT) AS high FROM b GROUP BY 1""",
    "largest_remainder_quota": """WITH s AS (SELECT source, count(DISTINCT doc_id) AS size FROM documents GROUP BY 1), r AS (SELECT *, size::DOUBLE / (SELECT sum(size) FROM s) * 500.0::DOUBLE AS raw FROM s),
        k AS (SELECT *, row_number() OVER (ORDER BY round(raw - floor(raw), 9) DESC, source) AS n FROM r)
        SELECT source, size, CAST(floor(raw) AS BIGINT) + CASE WHEN n <= 500 - (SELECT sum(floor(raw)) FROM r) THEN 1 ELSE 0 END AS quota FROM k""",
    "stratified_sample": """WITH d AS (SELECT DISTINCT doc_id, source || '|' || text_kind AS stratum FROM documents), s AS (SELECT stratum, count(*) AS size FROM d GROUP BY 1),
        r AS (SELECT *, size::DOUBLE / (SELECT sum(size) FROM s) * 300.0::DOUBLE AS raw FROM s), k AS (SELECT *, row_number() OVER (ORDER BY round(raw - floor(raw), 9) DESC, stratum) AS n FROM r),
        q AS (SELECT stratum, floor(raw) + CASE WHEN n <= 300 - (SELECT sum(floor(raw)) FROM r) THEN 1 ELSE 0 END AS quota FROM k),
        h AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42|' || doc_id), doc_id) AS n FROM d)
        SELECT doc_id, stratum FROM h JOIN q USING (stratum) WHERE n <= quota""",
    "stratified_split": f"""WITH {SQL_LABELS}, d AS (SELECT DISTINCT record_table || '/' || record_id AS rid, adjudicated FROM l WHERE adjudicated IS NOT NULL),
        h AS (SELECT *, row_number() OVER (PARTITION BY adjudicated ORDER BY md5('42|' || rid), rid) AS k, count(*) OVER (PARTITION BY adjudicated) AS n FROM d)
        SELECT rid, adjudicated, CASE WHEN k <= floor(n * 0.8::DOUBLE + 0.5) THEN 'train' WHEN k <= floor(n * 0.9::DOUBLE + 0.5) THEN 'valid' ELSE 'test' END AS split FROM h""",
    "task_batches": "SELECT video_id, CAST(floor((count(*) - 1) / 4) AS BIGINT) AS last_batch FROM (SELECT DISTINCT video_id, run_name, segment_index FROM slices) GROUP BY 1",
    "freq_table": f"WITH d AS (SELECT {_S.format(c='lang', m='<NA>')} AS level FROM documents) SELECT level, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM d), 9) AS share FROM d GROUP BY 1",
    "numeric_describe": " UNION ALL ".join(f"SELECT '{c}' AS variable, count({c}) AS n, count(*) - count({c}) AS missing, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd, round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.75), 6) AS p75, round(min({c}), 6) AS low, round(max({c}), 6) AS high FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount")),
    "combo_quantiles": "SELECT o_orderstatus || ' × ' || o_orderpriority AS combo, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.25), 4) AS p25, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.75), 4) AS p75 FROM orders GROUP BY 1",
    "crosstab_full_grid": """WITH g AS (SELECT a, b FROM (SELECT DISTINCT o_orderstatus AS a FROM orders), (SELECT DISTINCT o_orderpriority AS b FROM orders)),
        n AS (SELECT a, b, count(o_orderkey) AS n FROM g LEFT JOIN orders ON o_orderstatus = a AND o_orderpriority = b GROUP BY 1, 2)
        SELECT a, b, n, round(n / (sum(n) OVER (PARTITION BY a))::DOUBLE, 6) AS row_share, round(n / (sum(n) OVER (PARTITION BY b))::DOUBLE, 6) AS col_share,
               round((sum(n) OVER (PARTITION BY a))::DOUBLE * sum(n) OVER (PARTITION BY b) / sum(n) OVER (), 6) AS expected FROM n""",
    "mean_deviation": "SELECT event_type, round(avg(abs(value - (SELECT avg(value) FROM events))), 6) AS mean_deviation FROM events GROUP BY 1",
    "year_month_counts": "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1",
    "day_index": "SELECT CAST(date_diff('day', (SELECT min(o_orderdate)::DATE FROM orders), o_orderdate::DATE) AS INT) AS day_index, count(*) AS n FROM orders GROUP BY 1",
    "latest_version": "SELECT user_id, event_id, epoch_us(ts) AS at, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "json_props": "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1",
    "stats_json": f"WITH {SQL_VIDEOS} SELECT id, coalesce(TRY_CAST(json_extract_string(CASE WHEN json_valid(stats) THEN stats END, '$.digg_count') AS BIGINT), 0) AS diggs, coalesce(TRY_CAST(json_extract_string(CASE WHEN json_valid(stats) THEN stats END, '$.share_count') AS BIGINT), 0) AS shares FROM v",
    "url_parts": f"""WITH {SQL_COMMENTS}, u AS (SELECT unnest(regexp_extract_all(text, 'https?://[A-Za-z0-9./_-]+')) AS u FROM c)
        SELECT regexp_extract(u, '^([a-z]+)://', 1) AS scheme, regexp_extract(u, '://([^/]+)', 1) AS host, count(*) AS n, count(DISTINCT regexp_extract(u, '://[^/]+(.*)$', 1)) AS n_paths FROM u GROUP BY 1, 2""",
    "slugs": "SELECT p_partkey, regexp_replace(p_name, '[^A-Za-z0-9_-]', '_', 'g') AS slug, upper(trim(p_brand)) AS brand FROM part",
    "prefix_source": "SELECT CASE WHEN source LIKE 'transcript%' THEN 'transcript' WHEN source LIKE 'press!_digest%' ESCAPE '!' THEN 'press_digest' ELSE split_part(source, '_', 1) END AS origin, count(*) AS n FROM documents GROUP BY 1",
    "first_available": "SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier WHERE s_acctbal > 0 GROUP BY 1",
    "orders_without_lines": "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "dimension_rollup": """WITH c AS (SELECT c_nationkey AS k, count(*) AS n, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS cc FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1)
        SELECT r_name, CAST(coalesce(sum(c.n), 0) AS BIGINT) AS n_customers, CAST(coalesce(sum(s.n), 0) AS BIGINT) AS n_suppliers, CAST(coalesce(sum(cc), 0) AS BIGINT) AS balance_cents
        FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN c ON c.k = n_nationkey LEFT JOIN s ON s.k = n_nationkey GROUP BY 1""",
    "math_primitives": "SELECT l_returnflag, round(avg(ln(1 + l_extendedprice)), 6) AS lg, round(avg(sqrt(l_quantity)), 6) AS sq, round(avg(1 / (1 + exp(-(l_quantity / 10 - 2)))), 6) AS sg, round(avg(greatest(least(l_discount, 0.08::DOUBLE), 0.02::DOUBLE)), 6) AS cl FROM lineitem GROUP BY 1",
    "softmax_confidence": """WITH d AS (SELECT l_linestatus, l_discount * 20 AS x, l_tax * 20 AS y, l_quantity / 25 AS z FROM lineitem), e AS (SELECT l_linestatus, exp(x - greatest(x, y, z)) AS x, exp(y - greatest(x, y, z)) AS y, exp(z - greatest(x, y, z)) AS z FROM d),
        p AS (SELECT l_linestatus, greatest(x, y, z) / (x + y + z) AS p FROM e) SELECT l_linestatus, round(avg(p), 6) AS confidence, round(avg((p < 0.6)::INT::DOUBLE), 6) AS low_share FROM p GROUP BY 1""",
    "row_bind_tagged": "SELECT 'region' AS kind, r_regionkey::BIGINT AS k, r_name AS name FROM region UNION ALL SELECT 'nation', n_nationkey::BIGINT, n_name FROM nation",
    "set_ops": """SELECT 'both' AS part, count(*) AS n FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)
        UNION ALL SELECT 'customers only', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'orders only', count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)""",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, round(avg(l_discount), 9) AS mean_discount FROM lineitem GROUP BY 1, 2",
    "rollup_cube": "SELECT CAST(year(o_orderdate) AS INT) AS y, o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (year(o_orderdate), o_orderstatus)",
    "event_windows": "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "event_sessions": """WITH p AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        g AS (SELECT user_id, sum(brk) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM p), n AS (SELECT user_id, s, count(*) AS n FROM g GROUP BY 1, 2) SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM n GROUP BY 1""",
    "tail_increment": "SELECT event_type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events WHERE event_id > (SELECT floor((min(event_id) + max(event_id)) / 2) FROM events) GROUP BY 1",
    "dashboard": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, epoch_us(max({c})) AS newest_us FROM {t}" for t, c in (("videos", "updated_at"), ("comments", "updated_at"), ("comment_rows", "exported_at"), ("documents", "collected_at"))),
    "fallback_source": f"""WITH {SQL_COMMENTS}, g AS (SELECT video_id, source, count(*) AS n FROM c GROUP BY 1, 2), p AS (SELECT * FROM g WHERE source = 'primary')
        SELECT source AS used, count(*) AS n_videos, CAST(sum(n) AS BIGINT) AS n_comments FROM g WHERE source = 'primary' OR (source = 'fallback' AND video_id NOT IN (SELECT video_id FROM p)) GROUP BY 1""",
    "ordered_distinct": "SELECT p_brand, string_agg(p_type, '|' ORDER BY f) AS types FROM (SELECT p_brand, p_type, min(p_partkey) AS f FROM part GROUP BY 1, 2) GROUP BY 1",
    "round_robin": "SELECT s_suppkey, CAST((row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) % 3 AS INT) AS slot FROM supplier",
}
QUERIES = {f.__name__: f for f in (label_normalize, kappa_agreement, confusion_adjudicated, disagreement_rows, class_report, error_topk, top_liked, video_groups, length_bins, largest_remainder_quota, stratified_sample, stratified_split, task_batches, freq_table, numeric_describe, combo_quantiles, crosstab_full_grid, mean_deviation, year_month_counts, day_index, latest_version, json_props, stats_json, url_parts, slugs, prefix_source, first_available, orders_without_lines, dimension_rollup, math_primitives, softmax_confidence, row_bind_tagged, set_ops, pricing_summary, rollup_cube, event_windows, event_sessions, tail_increment, dashboard, fallback_source, ordered_distinct, round_robin)}
