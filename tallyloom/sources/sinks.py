"""Writers: tables, partitioned exports, reports, snapshots with retention."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """CSV with a header of sorted columns, lists and maps as JSON; without columns the header is ``empty``."""
    if not df.columns:
        df = df.select(F.lit(None).cast("string").alias("empty"))
    cols = [(F.to_json(c) if t.startswith(("array", "map", "struct")) else F.col(c)).alias(("﻿" if bom and i == 0 else "") + c) for i, (c, t) in enumerate(sorted(df.dtypes))]
    df.select(*cols).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_by(df: DataFrame, column: str, path: str, fmt: str = "csv") -> None:
    """One folder per value of a column."""
    df.write.mode("overwrite").partitionBy(column).option("header", True).format(fmt).save(path)


def write_nested(df: DataFrame, key: str, path: str, order: str | None = None, piece: int = 10_000) -> None:
    """JSON documents per key, its rows as arrays in a folder of the key.

    With ``order`` (a whole number) a document spans so many of its values, so
    a key with a third of all rows is many documents; ``piece`` numbers them.
    """
    rest = [c for c in df.columns if c != key]
    part = F.floor(F.col(order) / F.lit(piece)) if order else F.lit(0)
    df.groupBy(key, part.alias("piece")).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("items")).write.mode("overwrite").partitionBy(key).json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A one-row report as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_merged(parts: DataFrame, order: Sequence[str], text: str, path: str) -> None:
    """Parts of one report as text; the files read one after the other by name give it in order."""
    parts.orderBy(*order).select(text).write.mode("overwrite").text(path)


def bundles(df: DataFrame, key: str, metadata: Mapping[str, str]) -> DataFrame:
    """``json``, ``txt`` and ``md`` of each item.

    ``metadata`` maps columns to their labels in the markdown; they are merged
    into the JSON under that name. Besides ``text``, the columns audio_path,
    segments (array of start, end, text) and raw_result are used if there.
    """
    strip = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\A\s+|\s+\z", "")
    said = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    fields = [c for c in df.columns if c != key and c not in metadata]
    if metadata:
        fields.append(F.struct(*metadata).alias("metadata"))
    as_json = lambda c: F.to_json(c, {"pretty": "true", "ignoreNullFields": "false"})
    md = [F.lit("# 视频文本提取结果")]
    if metadata:
        md.append(F.concat_ws("\n", *(F.concat(F.lit(f"- {label}："), said(F.col(c))) for c, label in metadata.items())))
    md += [F.lit("## 全文"), strip(F.col("text"))]
    if "audio_path" in df.columns:
        md.append(F.when(F.col("audio_path") != "", F.concat(F.lit("## 音频路径\n\n"), F.col("audio_path"))))
    if "segments" in df.columns:
        line = lambda x, i: F.concat((i + 1).cast("string"), F.lit(". ["), said(x["start"]), F.lit(" - "), said(x["end"]), F.lit("] "), strip(x["text"]))
        md.append(F.when(F.size("segments") > 0, F.concat(F.lit("## 分段\n\n"), F.array_join(F.transform("segments", line), "\n"))))
    if "raw_result" in df.columns:
        raw = F.col("raw_result") if dict(df.dtypes)["raw_result"] == "string" else as_json(F.col("raw_result"))
        md.append(F.when(raw != "", F.concat(F.lit("## 原始结果\n\n```json\n"), raw, F.lit("\n```"))))
    return df.select(key, as_json(F.struct(*fields)).alias("json"), strip(F.col("text")).alias("txt"), F.concat_ws("\n\n", *md).alias("md"))


def write_bundles(df: DataFrame, key: str, metadata: Mapping[str, str], path: str) -> None:
    """Per format a folder, in it one of the key for each item with its whole text."""
    out = bundles(df, key, metadata)
    for kind in ("json", "txt", "md"):
        out.select(key, kind).write.mode("overwrite").partitionBy(key).text(f"{path}/{kind}")


def write_snapshot(df: DataFrame, folder: str, version: str, keep: int = 5) -> None:
    """A versioned snapshot and a copy called latest; all but the last versions are removed."""
    df.write.mode("overwrite").parquet(f"{folder}/archive/{version}")
    df.sparkSession.read.parquet(f"{folder}/archive/{version}").write.mode("overwrite").parquet(f"{folder}/latest")
    jvm = df.sparkSession.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{folder}/archive")
    fs = root.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
    for s in sorted((s.getPath() for s in fs.listStatus(root)), key=lambda p: p.getName(), reverse=True)[keep:]:
        fs.delete(s, True)


def quarantine(df: DataFrame, ok: str) -> tuple[DataFrame, DataFrame]:
    """Rows that hold a condition, and those that do not or cannot tell."""
    good = F.coalesce(F.expr(ok), F.lit(False))
    return df.filter(good), df.filter(~good)


def write_both(df: DataFrame, path: str) -> None:
    """The same rows as CSV with a byte-order mark and as parquet, computed once."""
    df.write.mode("overwrite").parquet(f"{path}/parquet")
    write_csv(df.sparkSession.read.parquet(f"{path}/parquet"), f"{path}/csv", bom=True)


def write_decided(df: DataFrame, column: str, path: str) -> None:
    """A CSV folder per decision and a JSON summary of the counts."""
    write_by(df, column, f"{path}/by_{column}")
    write_report(df.groupBy(column).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(column, "n")))).alias("counts")), f"{path}/summary")


def write_failures(items: DataFrame, key: str, path: str) -> DataFrame:
    """Items with an ``error_type`` go to a quarantine table; the others come back."""
    failed = items.filter("error_type is not null")
    failed.select(F.col(key).cast("string").alias("item_id"), "error_type", "message", F.current_timestamp().alias("failed_at")).write.mode("append").parquet(path)
    return items.filter("error_type is null").drop("error_type", "message")


def point_to_run(spark: SparkSession, root: str, run: str, summary: dict[str, object]) -> None:
    """A one-row table that names the latest run and its summary; replaced as a whole."""
    row = [(run, {k: str(v) for k, v in summary.items()})]
    spark.createDataFrame(row, "run string, summary map<string,string>").coalesce(1).write.mode("overwrite").json(f"{root}/latest_run")
