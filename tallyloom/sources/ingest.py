"""Readers: mixed files to canonical tables."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.text import clean

ENCODINGS = ("utf-8-sig", "utf-8", "gb18030", "gbk")
#: The canonical columns and the headers that stand for them, most wanted first.
ALIASES = {
    "id": ("id", "ID", "comment_id", "cid", "note_id", "msg_id"),
    "raw_text": ("raw_text", "text", "content", "comment", "评论", "评论内容", "正文", "message"),
    "time": ("time", "created_at", "create_time", "timestamp", "发布时间", "日期"),
    "post_id": ("post_id", "postid", "帖子id", "note_id", "aweme_id"),
    "video_id": ("video_id", "videoid", "视频id", "item_id", "aweme_id"),
    "user_id": ("user_id", "userid", "uid", "作者id", "用户id"),
    "parent_id": ("parent_id", "reply_to", "root_id", "上级评论id"),
    "likes": ("likes", "like_count", "点赞", "点赞数", "upvotes"),
}


def header_key(name: str) -> str:
    """A header without white space, ``_`` and ``-``, in lower case."""
    return re.sub(r"[\s_-]", "", name).lower()


def find_column(names: Sequence[str], wanted: Sequence[str]) -> str | None:
    """The column of the first alias present; of equal headers the last."""
    at = {header_key(n): n for n in names}
    return next((at[header_key(w)] for w in wanted if header_key(w) in at), None)


def guess_text_column(df: DataFrame) -> str | None:
    """The string column with the largest share of non-blank values, the first on a tie."""
    names = [n for n, t in df.dtypes if t == "string"]
    if not names:
        return None
    share = df.agg(*(F.avg(F.when(F.trim(F.col(f"`{n}`")) != "", 1.0).otherwise(0.0)).alias(str(i)) for i, n in enumerate(names))).first()
    return max(enumerate(names), key=lambda x: ((share[x[0]] or 0.0), -x[0]))[1]


def canonical(df: DataFrame, aliases: dict[str, Sequence[str]] = ALIASES, numeric: Sequence[str] = ("likes",)) -> DataFrame:
    """The canonical columns, the cleaned text after the raw one; what is missing or no number is NULL.

    Without any of the headers of a text the column with the largest share of
    filled strings is taken.
    """
    out = []
    for target, wanted in aliases.items():
        c = find_column(df.columns, wanted)
        if c is None and target == "raw_text":
            c = guess_text_column(df)
        x = F.col(f"`{c}`") if c else F.lit(None)
        out.append((x.cast("string").try_cast("double") if target in numeric else x.cast("string")).alias(target))
        if target == "raw_text" and "clean_text" not in aliases:
            out.append(clean(x.cast("string")).alias("clean_text"))
    return df.select(*out)


def read_any(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """csv, parquet, json or xlsx by suffix; the binary sheets before xlsx have no reader here."""
    kind = fmt or path.rsplit(".", 1)[-1].lower()
    if kind == "xlsx":
        from tallyloom.sources.sheets import read_sheets, sheet_rows

        # the header of one workbook; the rows are read by tasks
        folder, name = path.rsplit("/", 1)
        first = spark.read.format("binaryFile").load(path).select("content").first()
        header = [h for h in (sheet_rows(bytes(first.content)) or [[]])[0] if h]
        return read_sheets(spark, folder, header, name).drop("file", "row_index")
    if kind == "xls":
        raise ValueError("xls is not supported: save as xlsx or csv")
    if kind == "csv":
        return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if kind in ("parquet", "json", "orc", "text"):
        return spark.read.format(kind).load(path)
    raise ValueError(f"unknown format: {kind}")


def read_csv_folder(spark: SparkSession, folder: str, columns: Sequence[str]) -> DataFrame:
    """CSV files of one folder in any of the known encodings, with file name and row number.

    A file is decoded whole by one task, so files should stay well below a
    task's memory; large ones come in one known encoding through ``read_any``.
    """
    import csv
    import io

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path", "content")
    schema = "file string, row_index long, " + ", ".join(f"`{c}` string" for c in columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f.path, f.content):
                text = None
                for e in ENCODINGS:
                    try:
                        text = bytes(content).decode(e)
                        break
                    except UnicodeDecodeError:
                        continue
                if text is None:
                    text = bytes(content).decode("utf-8", "replace")
                rows = list(csv.DictReader(io.StringIO(text)))
                yield pd.DataFrame({"file": path.rsplit("/", 1)[-1], "row_index": range(1, len(rows) + 1), **{c: [r.get(c) for r in rows] for c in columns}})

    return files.mapInPandas(run, schema)


def latest_json_per_key(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """JSON documents found below a folder, of each key the file changed last."""
    d = spark.read.option("recursiveFileLookup", True).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    at = d.select("*", F.col("_metadata.file_modification_time").alias("_at"), F.col("_metadata.file_path").alias("_path"))
    return at.groupBy(key).agg(F.max_by(F.struct(*d.columns), F.struct("_at", "_path")).alias("_r")).select("_r.*")


def from_payload(df: DataFrame, payload: str) -> DataFrame:
    """Video records of JSON payloads, with alternates of each field."""
    p = F.try_parse_json(F.col(payload))
    text = lambda *paths: F.coalesce(*(F.try_variant_get(p, f"$.{x}", "string") for x in paths))
    number = lambda *paths: F.coalesce(*(F.try_variant_get(p, f"$.{x}", "long") for x in paths))
    return df.select(text("aweme_id", "video_id").alias("platform_video_id"), text("desc", "title").alias("title"), text("author.uid", "author_id").alias("author_id"), text("author.nickname", "author_name").alias("author_name"), number("statistics.digg_count", "stats.digg_count").alias("likes"), F.timestamp_seconds(F.nullif(number("create_time"), F.lit(0))).alias("published_at")).filter("platform_video_id is not null")


def wanted_rows(df: DataFrame, key: str, remove: str = "remove") -> DataFrame:
    """Rows with a filled key that are not marked to be removed; a missing mark keeps the row."""
    keep = F.lit(True) if remove not in df.columns else F.coalesce(F.trim(F.col(remove).cast("string")), F.lit("")) != "1"
    return df.filter(keep & F.col(key).isNotNull() & (F.trim(F.col(key).cast("string")) != ""))


def with_auto_ids(df: DataFrame, key: str, row: str = "row_index") -> DataFrame:
    """A blank key becomes ``auto_`` and the row's number in its file."""
    filled = F.nullif(F.trim(F.col(key).cast("string")), F.lit(""))
    return df.withColumn(key, F.coalesce(filled, F.concat(F.lit("auto_"), F.col(row).cast("string"))))


def json_or_csv(spark: SparkSession, json_folder: str, csv_folder: str, key: str, columns: Sequence[str]) -> DataFrame:
    """Latest JSON documents per key; of a folder without any the rows of its CSV files instead."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(json_folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = fs.listFiles(path, True) if fs.exists(path) else None
    while files is not None and files.hasNext():
        if files.next().getPath().getName().endswith(".json"):
            d = latest_json_per_key(spark, json_folder, key)
            return d.select(*(F.col(c) if c in d.columns else F.lit(None).cast("string").alias(c) for c in columns))
    return read_csv_folder(spark, csv_folder, columns).select(*columns)
