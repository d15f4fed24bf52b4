"""Queries of the training-data operators and the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.keys import video_key
from tallyloom.llm import abuse, bpe, canon, cuts, leaks, pii, runs, scans
from tallyloom.session import table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of near-identical slices, first and last segment of each."""
    return runs.collapse_runs(table(spark, sf_dir, "slices")).select("video_id", "first_segment_index", "last_segment_index")


def p6_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every slice's run, with its count and duration."""
    out = runs.collapse_runs(table(spark, sf_dir, "slices"), singles=True)
    return out.withColumn("duration_seconds", F.round(F.col("end_second") - F.col("start_second"), 3))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document's whole text."""
    return bpe.encode_corpus(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the items they leak."""
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items with the number of documents that carry them."""
    found = leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.groupBy("item_id").agg(F.count("*").alias("n_documents"), F.round(F.max("share"), 4).alias("most_share"))


def _raw_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "comments").select(F.lit("comments").alias("record_table"), F.col("id").cast("string").alias("record_id"), "text")
    b = table(spark, sf_dir, "comment_rows").select(F.lit("comment_rows").alias("record_table"), F.col("comment_row_id").cast("string").alias("record_id"), F.col("text_raw").alias("text"))
    return a.unionByName(b)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of personal information present in each comment."""
    return pii.find_pii(_raw_texts(spark, sf_dir))


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every comment with placeholders for personal information."""
    return pii.redact_texts(_raw_texts(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of scan noise present in each record's texts."""
    return scans.find_noise(table(spark, sf_dir, "text_records"))


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame text and subtitle as continuous paragraphs."""
    return scans.repair_texts(table(spark, sf_dir, "text_records"))


def _look_keys(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame]]:
    comments, records = table(spark, sf_dir, "comments"), table(spark, sf_dir, "text_records")
    return [
        ("comments", canon.look_keys(comments, F.col("id"), F.col("video_id"), F.col("text"))),
        ("text_records", canon.look_keys(records, F.col("text_record_id"), video_key(F.col("video_id")), F.col("ocr_text"))),
    ]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records of one video whose texts look the same but differ."""
    a, b = (canon.same_looks(k).select(F.lit(name).alias("record_table"), "*") for name, k in _look_keys(spark, sf_dir))
    return a.unionByName(b)


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one video whose texts look like another's, with their class."""
    a, b = (canon.look_classes(k).select(F.lit(name).alias("record_table"), "*") for name, k in _look_keys(spark, sf_dir))
    return a.unionByName(b)


def p3_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of both tables in its one form; rows that come out equal once."""
    a = table(spark, sf_dir, "comments").select(F.lit("comments").alias("record_table"), F.col("id"), F.col("text"))
    b = table(spark, sf_dir, "text_records").select(F.lit("text_records").alias("record_table"), F.col("text_record_id").alias("id"), F.col("ocr_text").alias("text"))
    return canon.with_canonical(a.unionByName(b), "text", "canonical", ["record_table", "id"], canon.one_form).distinct()


def _comment_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "comments").select(F.lit("comments").alias("record_table"), F.col("id").cast("string").alias("record_id"), "text")
    b = table(spark, sf_dir, "comment_rows").select(F.lit("comment_rows").alias("record_table"), F.col("comment_row_id").cast("string").alias("record_id"), F.col("text_clean").alias("text"))
    return a.unionByName(b)


def _model(spark: SparkSession, sf_dir: str):
    return abuse.train(*abuse.labelled_sample(table(spark, sf_dir, "abuse_labels"), _comment_texts(spark, sf_dir)))


def p7_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every comment of both tables."""
    return abuse.score(_comment_texts(spark, sf_dir), _model(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abusive comments of both tables."""
    return p7_scores(spark, sf_dir).filter(F.col("score") >= abuse.THRESHOLD).select("record_table", "record_id")


def p7_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of abusive comments per source."""
    comments = table(spark, sf_dir, "comments").select(F.col("id").cast("string").alias("record_id"), "source").groupBy("record_id").agg(F.min("source").alias("source"))
    # filtered before scoring: the other table is read for the labels only
    scored = abuse.score(_comment_texts(spark, sf_dir).filter("record_table = 'comments'"), _model(spark, sf_dir))
    both = comments.join(scored, "record_id").groupBy("source").agg(F.count("*").alias("n_comments"), F.sum((F.col("score") >= abuse.THRESHOLD).cast("int")).alias("n_abusive"))
    return both.withColumn("share_abusive", F.round(F.col("n_abusive") / F.col("n_comments"), 6))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text was cut."""
    return cuts.find_cuts(table(spark, sf_dir, "documents")).select("doc_id")


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of cut documents per source."""
    return cuts.cut_rates(table(spark, sf_dir, "documents"))


_RUNS = """
    WITH s AS (SELECT DISTINCT ON (video_id, run_name, segment_index) video_id, run_name, segment_index, start_second, end_second,
                      regexp_replace(lower(trim(phash_hex)), '^0x', '') AS h
               FROM slices WHERE video_id IS NOT NULL AND run_name IS NOT NULL AND segment_index IS NOT NULL
               ORDER BY video_id, run_name, segment_index, start_second, end_second, h),
         l AS (SELECT s.*, ('0x' || substr(h, 1, 8))::BIGINT AS a, ('0x' || substr(h, 9, 8))::BIGINT AS b
               FROM s JOIN (SELECT video_id, max(run_name) AS run_name FROM slices GROUP BY 1) USING (video_id, run_name)),
         p AS (SELECT *, lag(a) OVER w AS pa, lag(b) OVER w AS pb, lag(end_second) OVER w AS pe FROM l WINDOW w AS (PARTITION BY video_id ORDER BY segment_index)),
         g AS (SELECT *, sum(CASE WHEN bit_count(xor(a, pa)) + bit_count(xor(b, pb)) <= 8 AND start_second - pe <= 1.000000001 THEN 0 ELSE 1 END)
                         OVER (PARTITION BY video_id ORDER BY segment_index) AS n FROM p)
    SELECT video_id, min(segment_index) AS first_segment_index, max(segment_index) AS last_segment_index, {more} FROM g GROUP BY video_id, n {having}"""

ORACLE = {
    "p6_found": "SELECT video_id, first_segment_index, last_segment_index FROM (" + _RUNS.format(more="count(*) AS c", having="HAVING count(*) > 1") + ")",
    "p6_runs": _RUNS.format(more="count(*) AS slice_count, min(start_second) AS start_second, max(end_second) AS end_second, round(max(end_second) - min(start_second), 3) AS duration_seconds", having=""),
}
QUERIES = {"p1_found": p1_found, "p1_redacted": p1_redacted, "p2_found": p2_found, "p2_repaired": p2_repaired, "p6_found": p6_found, "p6_runs": p6_runs, "p3_found": p3_found, "p3_classes": p3_classes, "p3_canonical": p3_canonical, "p7_found": p7_found, "p7_scores": p7_scores, "p7_rates": p7_rates, "p10_found": p10_found, "p10_rates": p10_rates, "p8_ids": p8_ids, "p9_found": p9_found, "p9_items": p9_items}
