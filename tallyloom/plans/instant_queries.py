"""p5: mixed timestamp notations as one instant each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.instants import even_span, normalize_instants
from tallyloom.session import table

def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    # one row per capture site; the planner broadcasts it if its size allows
    return table(spark, sf_dir, "capture_sites").groupBy("capture_site").agg(F.min("tz_name").alias("tz_name"), F.min("date_order").alias("date_order"))


def _instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for name, rid, value, at in (
        ("comments", F.col("id"), F.col("published_at"), F.unix_micros(F.col("created_at").cast("timestamp"))),
        ("text_records", F.col("text_record_id"), F.col("publish_time"), F.col("text_record_id")),
    ):
        df = table(spark, sf_dir, name)
        parts.append(df.select(F.concat(F.lit(f"{name}/"), rid.cast("string")).alias("rid"), value.alias("value"), "capture_site", at.alias("at"), F.lit(even_span(df, at)).alias("span")))
    every = parts[0].unionByName(parts[1]).join(_sites(spark, sf_dir), "capture_site", "left")
    source = F.concat_ws("/", F.split("rid", "/")[0], F.col("capture_site"))
    found = normalize_instants(every, F.col("rid"), F.col("value"), source, F.col("at"), F.col("tz_name"), F.col("date_order"), F.col("span"))
    names = F.split("record_id", "/", 2)
    return found.select(names[0].alias("record_table"), names[1].alias("record_id"), "epoch_ms", "n_readings")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instant of every readable comment and text record time."""
    return _instants(spark, sf_dir).drop("n_readings")


def p5_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records per table and site: all, those with a readable time, those with several readings of it."""
    found = _instants(spark, sf_dir)
    comments = table(spark, sf_dir, "comments").select(F.lit("comments").alias("record_table"), F.col("id").cast("string").alias("record_id"), "capture_site")
    records = table(spark, sf_dir, "text_records").select(F.lit("text_records").alias("record_table"), F.col("text_record_id").cast("string").alias("record_id"), "capture_site")
    every = comments.unionByName(records).groupBy("record_table", "record_id").agg(F.min("capture_site").alias("capture_site"))
    joined = every.join(found, ["record_table", "record_id"], "left")
    return joined.groupBy("record_table", "capture_site").agg(F.count("*").alias("n_records"), F.count("epoch_ms").alias("n_readable"), F.count_if(F.col("n_readings") > 1).alias("n_several"))


QUERIES = {"p5_found": p5_found, "p5_formats": p5_formats}
