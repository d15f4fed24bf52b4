"""Domain views over the test tables, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.keys import blank_to_null, video_key
from tallyloom.functions.text import binary_label
from tallyloom.operators.sequences import latest
from tallyloom.session import table


def comments(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """One row per comment, the last delivered; columns id, video_id, level, text, likes and those named."""
    d = table(spark, sf_dir, "comments").select("id", "video_id", "level", "text", F.col("like_count").alias("likes"), "updated_at", *more)
    return latest(d, ["id"], ["updated_at"])


def comment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per exported comment: id, video key, parent, level, text."""
    d = table(spark, sf_dir, "comment_rows").select("comment_row_id", video_key(F.col("platform_video_id")).alias("video"), blank_to_null(F.col("parent_comment_id")).alias("parent"), F.regexp_replace(F.trim("level"), r"\.0$", "").alias("level"), F.coalesce(blank_to_null(F.col("text_clean")), blank_to_null(F.col("text_raw")), F.lit("")).alias("text"), "exported_at")
    return latest(d, ["comment_row_id"], ["exported_at"])


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per video, the last updated."""
    return latest(table(spark, sf_dir, "videos"), ["id"], ["updated_at"])


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of both annotators as 1, 0 or NULL, and the adjudicated one."""
    t = table(spark, sf_dir, "abuse_labels")
    # numbers came as text, and two tokens are this table's own
    token = lambda c: F.coalesce(binary_label(F.col(c)), binary_label(F.col(c).try_cast("double"), numeric=True), F.when(F.trim(c) == "辱骂", 1).when(F.trim(c) == "正常", 0))
    return t.select("record_table", "record_id", token("label_annotator_a").alias("a"), token("label_annotator_b").alias("b"), F.col("adjudicated_label").alias("adjudicated")).distinct()


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices without repeats, of every run."""
    return table(spark, sf_dir, "slices").select("video_id", "run_name", "segment_index", "start_second", "end_second", "duration_seconds", "phash_hex", "visual_label", "arousal_label", "status").distinct()


_T = "coalesce(CASE WHEN lower(trim({c})) IN ('1','anger','angry','愤怒','是','yes','y','true','t','pos','positive','辱骂') OR TRY_CAST({c} AS DOUBLE) = 1 THEN 1 WHEN lower(trim({c})) IN ('0','non-anger','non_anger','nonanger','非愤怒','否','no','n','false','f','neg','negative','正常') OR TRY_CAST({c} AS DOUBLE) = 0 THEN 0 END)"
SQL_COMMENTS = """c AS (SELECT id, video_id, level, text, like_count AS likes, updated_at, source, author_platform_id, published_at, parent_comment_id, platform_comment_id, root_comment_platform_id FROM comments
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, level DESC NULLS LAST, text DESC NULLS LAST, like_count DESC NULLS LAST) = 1)"""
_BLANK = "CASE WHEN lower(trim({c})) NOT IN ('', 'nan', 'none', 'null', '<na>') THEN trim({c}) END"
SQL_ROWS = (
    "r AS (SELECT comment_row_id, "
    + _BLANK.format(c="regexp_replace(trim(platform_video_id), '\\.0$', '')")
    + " AS video, "
    + _BLANK.format(c="parent_comment_id")
    + " AS parent, regexp_replace(trim(level), '\\.0$', '') AS level, coalesce("
    + _BLANK.format(c="text_clean")
    + ", "
    + _BLANK.format(c="text_raw")
    + """, '') AS text, exported_at FROM comment_rows
    QUALIFY row_number() OVER (PARTITION BY comment_row_id ORDER BY exported_at DESC NULLS LAST, 2 DESC NULLS LAST, 3 DESC NULLS LAST, 4 DESC NULLS LAST, 5 DESC NULLS LAST) = 1)"""
)
SQL_VIDEOS = """v AS (SELECT * FROM videos QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) = 1)"""
SQL_LABELS = "l AS (SELECT DISTINCT record_table, record_id, " + _T.format(c="label_annotator_a") + " AS a, " + _T.format(c="label_annotator_b") + " AS b, adjudicated_label AS adjudicated FROM abuse_labels)"
SQL_SLICES = "s AS (SELECT DISTINCT video_id, run_name, segment_index, start_second, end_second, duration_seconds, phash_hex, visual_label, arousal_label, status FROM slices)"
#: White space as the cleaners see it, for a class of DuckDB's patterns.
SQL_SPACE = "\\s\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
#: The key that lines and sections are compared by.
_KEY = "regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


def sql_sections(pairs: list[tuple[str, str]]) -> str:
    """SQL of ``compose_sections``."""
    given = "list_filter([" + ", ".join(f"{{'l': '{label}', 'b': coalesce({c}, ''), 'k': {_KEY.format(x=f'''coalesce({c}, '')''')}}}" for label, c in pairs) + "], lambda s: s.k <> '')"
    kept = f"list_filter({given}, lambda s, i: list_position(list_transform({given}, lambda y: y.k), s.k) = i)"
    return f"array_to_string(list_transform({kept}, lambda s: '【' || s.l || '】' || chr(10) || s.b), chr(10) || chr(10))"


def sql_lines(text: str) -> str:
    """SQL of ``dedup_lines``: kept lines so far, with their keys, reduced from the left."""
    lines = f"list_filter(list_transform(regexp_split_to_array(coalesce({text}, ''), '[\\r\\n]+'), lambda x: regexp_replace(x, '^[{SQL_SPACE}]+|[{SQL_SPACE}]+$', '', 'g')), lambda x: x <> '')"
    keyed = f"list_filter(list_transform({lines}, lambda x: [{{'l': x, 'k': {_KEY.format(x='x')}}}]), lambda x: x[1].k <> '')"
    seen = "len(list_filter(acc, lambda a: a.k = x[1].k OR (length(a.k) >= 24 AND length(x[1].k) >= 24 AND (contains(a.k, x[1].k) OR contains(x[1].k, a.k))))) > 0"
    kept = f"list_reduce({keyed}, lambda acc, x: CASE WHEN {seen} THEN acc ELSE list_concat(acc, x) END, [{{'l': '', 'k': ''}}][:0])"
    return f"array_to_string(list_transform({kept}, lambda a: a.l), chr(10))"
