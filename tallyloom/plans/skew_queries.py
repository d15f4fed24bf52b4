"""p4: per-key results where a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.keys import blank_to_null, video_key
from tallyloom.operators.dense_counts import dense_aggregate, heavy_keys
from tallyloom.session import table

SHARE = 0.03


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with at least 3 % of the keyed rows of either table."""
    rows, comments = table(spark, sf_dir, "comment_rows"), table(spark, sf_dir, "comments")
    out = None
    for name, df, key in (("comment_rows.platform_video_id", rows, video_key(F.col("platform_video_id"))), ("comments.root_comment_platform_id", comments, blank_to_null(F.col("root_comment_platform_id")))):
        part = heavy_keys(df, key, SHARE).select(F.lit(name).alias("key_column"), "key_value")
        out = part if out is None else out.unionByName(part)
    return out


def p4_video_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, replies, non-blank texts, text length and export span of each video."""
    df = table(spark, sf_dir, "comment_rows")
    reply = F.regexp_replace(F.trim("level"), r"\.0$", "") == "2"
    text = blank_to_null(F.col("text_raw"))
    at = F.unix_micros(F.col("exported_at").cast("timestamp"))
    sums = {"n_rows": F.lit(1), "n_replies": reply.cast("int"), "n_texts": text.isNotNull().cast("int"), "n_chars": F.length(F.col("text_raw"))}
    return dense_aggregate(df, video_key(F.col("platform_video_id")), sums=sums, mins={"first_us": at}, maxs={"last_us": at}).withColumnRenamed("key_value", "platform_video_id")


def p4_thread_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies, likes and the most liked count of each thread."""
    df = table(spark, sf_dir, "comments")
    likes = F.col("like_count")
    return dense_aggregate(df, blank_to_null(F.col("root_comment_platform_id")), sums={"n_rows": F.lit(1), "n_likes": likes}, maxs={"most_likes": likes}).withColumnRenamed("key_value", "root_comment_platform_id")


_VIDEO = "regexp_replace(trim(platform_video_id), '\\.0$', '')"
_KEYED = "lower(k) NOT IN ('', 'nan', 'none', 'null', '<na>')"

ORACLE = {
    "p4_found": f"""
        WITH r AS (SELECT 'comment_rows.platform_video_id' AS key_column, {_VIDEO} AS k FROM comment_rows
                   UNION ALL SELECT 'comments.root_comment_platform_id', trim(root_comment_platform_id) FROM comments),
             c AS (SELECT key_column, k, count(*) AS n FROM r WHERE k IS NOT NULL AND {_KEYED} GROUP BY 1, 2),
             t AS (SELECT key_column, sum(n) AS total FROM c GROUP BY 1)
        SELECT c.key_column, c.k AS key_value FROM c JOIN t USING (key_column) WHERE c.n >= 0.03 * t.total""",
    "p4_video_rollup": f"""
        WITH r AS (SELECT {_VIDEO} AS k, * FROM comment_rows)
        SELECT k AS platform_video_id, count(*) AS n_rows,
               count(*) FILTER (regexp_replace(trim(level), '\\.0$', '') = '2') AS n_replies,
               count(*) FILTER (lower(trim(text_raw)) NOT IN ('', 'nan', 'none', 'null', '<na>')) AS n_texts,
               CAST(coalesce(sum(length(text_raw)), 0) AS BIGINT) AS n_chars,
               min(epoch_us(exported_at)) AS first_us, max(epoch_us(exported_at)) AS last_us
        FROM r WHERE k IS NOT NULL AND {_KEYED} GROUP BY 1""",
    "p4_thread_rollup": f"""
        WITH r AS (SELECT trim(root_comment_platform_id) AS k, like_count FROM comments)
        SELECT k AS root_comment_platform_id, count(*) AS n_rows, CAST(coalesce(sum(like_count), 0) AS BIGINT) AS n_likes,
               CAST(max(like_count) AS BIGINT) AS most_likes
        FROM r WHERE k IS NOT NULL AND {_KEYED} GROUP BY 1""",
}
QUERIES = {"p4_found": p4_found, "p4_video_rollup": p4_video_rollup, "p4_thread_rollup": p4_thread_rollup}
