"""Record-level parsing and job bookkeeping over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import lexicon as L
from tallyloom.functions import records as C
from tallyloom.functions import text as X
from tallyloom.operators import jobs as J
from tallyloom.plans.comment_queries import _sent
from tallyloom.plans.views import SQL_COMMENTS, SQL_SLICES, SQL_VIDEOS, comments, slices, videos
from tallyloom.session import table


def switch_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotators' tokens read as switches."""
    t = table(spark, sf_dir, "abuse_labels").select(F.explode(F.array("label_annotator_a", "label_annotator_b")).alias("t"))
    return t.groupBy(C.optional_bool(F.col("t")).cast("int").alias("switch")).agg(F.count("*").alias("n"))


def positive_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comment levels as written, read as positive whole numbers."""
    t = table(spark, sf_dir, "comment_rows").select("level", C.optional_int(F.col("level")).alias("number"))
    return t.groupBy("level", "number").agg(F.count("*").alias("n"))


def local_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a time in the plain local notations, and their earliest and latest instant."""
    t = comments(spark, sf_dir, "published_at").select(F.unix_seconds(C.local_time(F.col("published_at"))).alias("s"))
    return t.agg(F.count("s").alias("n"), F.min("s").alias("first"), F.max("s").alias("last"))


def month_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos per month of publication, missing ones apart."""
    return videos(spark, sf_dir).groupBy(C.month_or_missing(F.col("published_at")).alias("month")).agg(F.count("*").alias("n"))


def first_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First three tags of each video as one string."""
    return videos(spark, sf_dir).select("id", C.joined_list(C.cues(F.from_json("tags", "array<string>"))).alias("tags3"))


def like_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries of each comment, and likes of the last."""
    t = table(spark, sf_dir, "comments").select("id", "updated_at", F.coalesce("like_count", F.lit(-1)).alias("likes"))
    return J.last_attempt(t, ["id"], "updated_at").filter("n_attempts > 1").select("id", "likes", "n_attempts")


def slice_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices by status, one that is missing inferred from earlier runs of the segment."""
    s = slices(spark, sf_dir)
    n = s.groupBy("video_id", "segment_index").agg(F.count("*").alias("runs"))
    return s.join(n, ["video_id", "segment_index"]).groupBy(C.inferred_status(F.col("status"), F.col("runs") - 1).alias("state")).agg(F.count("*").alias("n"))


def table_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signature of the video table."""
    return J.signature(table(spark, sf_dir, "videos").withColumn("us", F.unix_micros(F.col("updated_at").cast("timestamp"))), "us")


def image_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image paths by root: under the run if the slice succeeded, else under the archive."""
    p = C.resolved_path(F.col("image_path"), [("/runs", F.col("status") == "success"), ("/archive", F.col("status") == "failed")])
    t = table(spark, sf_dir, "slices").filter("image_path is not null").select("slice_id", "run_name", p.alias("p")).distinct()
    return t.groupBy(F.split("p", "/")[1].alias("root")).agg(F.count("*").alias("n"), F.min("p").alias("first"))


def payload_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments whose payload names an address or a level two reply."""
    t = table(spark, sf_dir, "comments").select("id", "raw_json").distinct()
    return t.groupBy(C.holds_any(F.col("raw_json"), ("洺津", '"LV": 2')).cast("int").alias("hit")).agg(F.count("*").alias("n"))


def payload_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level in the JSON payload against the column."""
    lv = F.try_variant_get(F.try_parse_json("raw_json"), "$.lv", "int")
    t = comments(spark, sf_dir, "raw_json").select("level", lv.alias("lv"))
    return t.groupBy("level", "lv").agg(F.count("*").alias("n"))


def report_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and texts of a source's documents in id order, as a digest per block; ``report_texts`` holds the texts."""
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "source", F.md5("text").alias("n")).distinct()
    # a report line per document: a digest per slice of ids keeps any group small
    part = d.groupBy("source", F.floor(F.col("doc_id") / 512).alias("block")).agg(F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "n"))), lambda x: F.concat_ws(":", x["doc_id"].cast("string"), x["n"])), "\n")).alias("digest"), F.count("*").alias("n_documents"))
    return part.withColumn("block", F.col("block").cast("long"))


def report_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report itself: heads and whole texts of a source's documents in id order, one part per block of 512 ids."""
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "source", "text").distinct()
    section = lambda x: F.concat(F.lit("## "), F.coalesce(x["doc_id"].cast("string"), F.lit("")), F.lit("\n\n"), x["text"], F.lit("\n\n---\n"))
    part = d.groupBy("source", F.floor(F.col("doc_id") / 512).cast("long").alias("block")).agg(F.sort_array(F.collect_list(F.struct("doc_id", "text"))).alias("d"))
    return part.select("source", "block", F.size("d").cast("long").alias("n_documents"), F.array_join(F.transform("d", section), "\n").alias("report"))


def video_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos by optional conditions: those not given do not filter."""
    return C.matching(videos(spark, sf_dir), {"platform": "douyin", "author_name": None}).select("id")


def confidence_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices by arousal read as a confidence: what is no level is low."""
    return slices(spark, sf_dir).groupBy(X.confidence_label(F.col("arousal_label")).alias("confidence")).agg(F.count("*").alias("n"))


def rebuilt_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of anger of every comment: as given for odd ids, for even ones from the label and its own."""
    d = comments(spark, sf_dir).select("id", (1.0 - L.polarity(F.coalesce("text", F.lit("")))).alias("a"))
    d = d.withColumns({"label": (F.col("a") >= 0.5).cast("int"), "prob": F.greatest("a", 1.0 - F.col("a")), "given": F.when(F.col("id") % 2 == 1, F.col("a"))})
    return d.select("id", F.round(X.anger_probability(F.col("label"), F.col("prob"), F.col("given")), 9).alias("anger_prob"))


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses from lines of which some are blank, comments or without a scheme; in order, each once."""
    k = F.col("s_suppkey")
    line = F.when(k % 5 == 0, F.lit("  ")).when(k % 5 == 1, F.concat(F.lit("# off "), k.cast("string"))).when(k % 5 == 2, F.concat(F.lit(" host"), (k % 50).cast("string"), F.lit(":8080 "))).otherwise(F.concat(F.lit("socks5://u:p@host"), (k % 50).cast("string"), F.lit(":1080")))
    d = table(spark, sf_dir, "supplier").select(k, X.endpoint(line).alias("address")).filter("address is not null")
    return d.groupBy("address").agg(F.min("s_suppkey").alias("place"))


def slice_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts of slices from whole milliseconds back to seconds."""
    d = slices(spark, sf_dir).select("video_id", F.floor(F.col("start_second") * 1000).alias("ms"))
    return d.groupBy("video_id").agg(F.round(F.max(C.millis_to_seconds(F.col("ms"))), 3).alias("last_start"))


def cooled_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos whose last change lies before the middle of all changes, missing ones included, as resources that may be used again."""
    v = videos(spark, sf_dir).select("id", F.col("updated_at").cast("timestamp").alias("t"))
    middle = v.agg(F.timestamp_micros(F.floor((F.min(F.unix_micros("t")) + F.max(F.unix_micros("t"))) / 2).cast("long"))).scalar()
    return v.filter(C.available(F.col("t"), middle, F.col("id") % 7 == 0)).select("id")



def author_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments per author, with names seen and the share of replies."""
    c = comments(spark, sf_dir, "author_platform_id")
    return c.groupBy("author_platform_id").agg(F.count("*").alias("n"), F.round(X.safe_ratio(F.count_if(F.col("level") == 2), F.count("*")), 9).alias("reply_share"))


ORACLE = {
    "switch_tokens": "WITH t AS (SELECT lower(trim(unnest([label_annotator_a, label_annotator_b]))) AS t FROM abuse_labels) SELECT CASE WHEN t IN ('true', '1', 'yes', 'y', 'on') THEN 1 WHEN t IN ('false', '0', 'no', 'n', 'off') THEN 0 END AS switch, count(*) AS n FROM t GROUP BY 1",
    "positive_numbers": "SELECT level, CASE WHEN regexp_full_match(trim(level), '[0-9]+') AND CAST(trim(level) AS BIGINT) > 0 THEN CAST(trim(level) AS BIGINT) END AS number, count(*) AS n FROM comment_rows GROUP BY 1, 2",
    "local_times": f"""WITH {SQL_COMMENTS}, t AS (SELECT CASE WHEN regexp_full_match(trim(published_at), '\\d{{4}}[-/]\\d\\d[-/]\\d\\d( \\d\\d:\\d\\d(:\\d\\d)?)?') THEN TRY_CAST(replace(trim(published_at), '/', '-') || CASE WHEN length(trim(published_at)) = 16 THEN ':00' ELSE '' END AS TIMESTAMP) END AS w FROM c)
        SELECT count(w) AS n, CAST(epoch(min(w)) - 28800 AS BIGINT) AS first, CAST(epoch(max(w)) - 28800 AS BIGINT) AS last FROM t""",
    "month_counts": f"WITH {SQL_VIDEOS} SELECT coalesce(strftime(published_at, '%Y-%m'), 'MISSING') AS month, count(*) AS n FROM v GROUP BY 1",
    "first_tags": f"WITH {SQL_VIDEOS} SELECT id, array_to_string(list_slice(list_filter(list_transform(coalesce(from_json(tags, '[\"VARCHAR\"]'), []), lambda x: trim(x)), lambda x: x <> ''), 1, 3), '|') AS tags3 FROM v",
    "like_changes": "SELECT id, arg_max(coalesce(like_count, -1), (updated_at, coalesce(like_count, -1))) AS likes, count(*) AS n_attempts FROM comments GROUP BY 1 HAVING count(*) > 1",
    "slice_status": f"""WITH {SQL_SLICES}, n AS (SELECT *, count(*) OVER (PARTITION BY video_id, segment_index) AS runs FROM s)
        SELECT coalesce(nullif(lower(trim(status)), ''), CASE WHEN runs > 1 THEN 'failed' ELSE 'pending' END) AS state, count(*) AS n FROM n GROUP BY 1""",
    "table_signatures": "SELECT count(*) AS n, epoch_us(max(updated_at)) AS newest FROM videos",
    "image_paths": """WITH t AS (SELECT DISTINCT slice_id, run_name, CASE WHEN image_path LIKE '/%' THEN image_path WHEN status = 'success' THEN '/runs/' || image_path WHEN status = 'failed' THEN '/archive/' || image_path ELSE '/runs/' || image_path END AS p FROM slices WHERE image_path IS NOT NULL)
        SELECT split_part(p, '/', 2) AS root, count(*) AS n, min(p) AS first FROM t GROUP BY 1""",
    "payload_words": """WITH t AS (SELECT DISTINCT id, lower(coalesce(raw_json, '')) AS r, raw_json FROM comments) SELECT CAST(contains(r, '洺津') OR contains(r, '"lv": 2') AS INT) AS hit, count(*) AS n FROM t GROUP BY 1""",
    "payload_levels": """WITH c AS (SELECT id, level, raw_json FROM comments QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, level DESC NULLS LAST) = 1)
        SELECT level, TRY_CAST(json_extract_string(CASE WHEN json_valid(raw_json) THEN raw_json END, '$.lv') AS INT) AS lv, count(*) AS n FROM c GROUP BY 1, 2""",
    "report_by_source": "WITH d AS (SELECT DISTINCT doc_id, source, md5(text) AS n FROM documents WHERE text IS NOT NULL) SELECT source, CAST(floor(doc_id / 512) AS BIGINT) AS block, md5(string_agg(doc_id || ':' || n, chr(10) ORDER BY doc_id, n)) AS digest, count(*) AS n_documents FROM d GROUP BY 1, 2",
    "report_texts": "WITH d AS (SELECT DISTINCT doc_id, source, text FROM documents WHERE text IS NOT NULL) SELECT source, CAST(floor(doc_id / 512) AS BIGINT) AS block, count(*) AS n_documents, string_agg('## ' || coalesce(CAST(doc_id AS VARCHAR), '') || chr(10) || chr(10) || text || chr(10) || chr(10) || '---' || chr(10), chr(10) ORDER BY doc_id NULLS FIRST, text) AS report FROM d GROUP BY 1, 2",
    "confidence_levels": f"WITH {SQL_SLICES} SELECT CASE WHEN lower(trim(arousal_label)) IN ('low', 'medium', 'high') THEN lower(trim(arousal_label)) ELSE 'low' END AS confidence, count(*) AS n FROM s GROUP BY 1",
    "rebuilt_probabilities": f"""WITH {SQL_COMMENTS}, t AS (SELECT id, coalesce(text, '') AS text FROM c)
        SELECT id, round(1.0::DOUBLE - CASE WHEN trim(text) = '' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE / (1.0::DOUBLE + exp(-{_sent(L.POLARITY)})) END, 9) AS anger_prob FROM t""",
    "endpoints": """WITH l AS (SELECT s_suppkey AS k, CASE s_suppkey % 5 WHEN 0 THEN '  ' WHEN 1 THEN '# off ' || s_suppkey WHEN 2 THEN ' host' || (s_suppkey % 50) || ':8080 ' ELSE 'socks5://u:p@host' || (s_suppkey % 50) || ':1080' END AS l FROM supplier),
        a AS (SELECT k, CASE WHEN contains(l, '://') THEN trim(l) ELSE 'http://' || trim(l) END AS address FROM l WHERE trim(l) <> '' AND NOT starts_with(trim(l), '#')) SELECT address, min(k) AS place FROM a GROUP BY 1""",
    "slice_seconds": f"WITH {SQL_SLICES} SELECT video_id, round(max(round(floor(start_second * 1000) / 1000, 3)), 3) AS last_start FROM s GROUP BY 1",
    "cooled_down": f"WITH {SQL_VIDEOS}, m AS (SELECT floor((min(epoch_us(updated_at)) + max(epoch_us(updated_at))) / 2) AS m FROM v) SELECT id FROM v, m WHERE id % 7 <> 0 AND (updated_at IS NULL OR epoch_us(updated_at) <= m)",
    "video_filter": f"WITH {SQL_VIDEOS} SELECT id FROM v WHERE lower(trim(platform)) = 'douyin'",
    "author_sources": f"WITH {SQL_COMMENTS} SELECT author_platform_id, count(*) AS n, round(count(*) FILTER (level = 2)::DOUBLE / count(*), 9) AS reply_share FROM c GROUP BY 1",
}
QUERIES = {f.__name__: f for f in (switch_tokens, positive_numbers, local_times, month_counts, first_tags, like_changes, slice_status, table_signatures, image_paths, payload_words, payload_levels, report_by_source, report_texts, video_filter, confidence_levels, rebuilt_probabilities, endpoints, slice_seconds, cooled_down, author_sources)}
