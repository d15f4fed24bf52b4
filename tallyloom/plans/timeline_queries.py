"""Slices, frames and text records: segments, blocks, roll-ups."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.functions.keys import blank_to_null
from tallyloom.operators import sequences as S
from tallyloom.operators.pictures import picture_features
from tallyloom.plans.views import SQL_SLICES, SQL_VIDEOS, slices, sql_lines, sql_sections, videos
from tallyloom.session import table


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = slices(spark, sf_dir)
    last = d.groupBy("video_id").agg(F.max("run_name").alias("run_name"))
    return d.join(last, ["video_id", "run_name"], "left_semi")


def frame_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of slices whose hash is within 12 bits of the one before: bounds, members, sharpest (longest) slice."""
    d = _latest(spark, sf_dir).withColumn("h", S.hash_bits(F.col("phash_hex")))
    seg = S.adjacent_segments(d, ["video_id"], ["segment_index"], "h", 12)
    best = F.max_by("segment_index", F.struct(F.coalesce("duration_seconds", F.lit(-1.0)), -F.col("segment_index")))
    return seg.groupBy("video_id", F.col("segment").cast("long").alias("segment")).agg(F.count("*").alias("n_frames"), F.min("start_second").alias("start_second"), F.max("end_second").alias("end_second"), best.alias("representative"), F.array_join(F.sort_array(F.collect_list("segment_index")), "|").alias("members"))


def timeline_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of successful slices with the same labels and at most 0.2 s between them."""
    d = _latest(spark, sf_dir).filter("status = 'success' and start_second is not null and end_second is not null")
    d = d.withColumns({"v": F.coalesce("visual_label", F.lit("")), "a": F.coalesce("arousal_label", F.lit(""))})
    b = S.timeline_blocks(d, ["video_id"], ["start_second", "end_second", "segment_index"], ["v", "a"], "start_second", "end_second", "duration_seconds")
    return b.select("video_id", F.col("block_index").cast("long").alias("block_index"), "v", "a", "start_time", "end_time", F.round("duration_seconds", 3).alias("duration_seconds"), "slice_count")


def timeline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of time of each visual label in a video, and its main label."""
    d = _latest(spark, sf_dir).filter("visual_label is not null").withColumn("ms", F.round(F.coalesce("duration_seconds", F.lit(0.0)) * 1000).cast("long"))
    return S.label_shares(d, "video_id", "visual_label", "ms").select("video_id", "visual_label", F.col("weight").alias("ms"), F.round("share", 9).alias("share"), "is_main")


def representative_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest slice of each video, the first on ties."""
    return S.representative(_latest(spark, sf_dir), ["video_id"], F.col("duration_seconds"), ["segment_index"]).select("video_id", "segment_index", "duration_seconds")


def slice_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slice ids rebuilt from video and segment number against those given."""
    d = table(spark, sf_dir, "slices").select("slice_id", F.format_string("%s__segment_%04d", "video_id", "segment_index").alias("rebuilt")).distinct()
    return d.groupBy((F.col("slice_id") == F.col("rebuilt")).cast("int").alias("same")).agg(F.count("*").alias("n"))


def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest run of each video with its slices and successes."""
    return _latest(spark, sf_dir).groupBy("video_id", "run_name").agg(F.count("*").alias("n_slices"), F.count_if(F.col("status") == "success").alias("n_success"))


def pending_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of the latest runs with neither success nor skip: an anti join on those done."""
    d = _latest(spark, sf_dir).select("video_id", "run_name", "segment_index", "status")
    done = d.filter(F.col("status").isin("success", "skipped")).select("video_id", "run_name", "segment_index")
    return d.join(done, ["video_id", "run_name", "segment_index"], "left_anti").select("video_id", "segment_index").distinct()


def status_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """completed, partial or failed, per video's latest run."""
    from tallyloom.streaming.streams import job_status

    g = _latest(spark, sf_dir).groupBy("video_id").agg(F.count("*").alias("n_items"), F.count_if(F.col("status") == "failed").alias("n_failed"))
    return g.withColumn("job_status", job_status())


def unresolved_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that failed in some run and succeeded in none."""
    d = slices(spark, sf_dir)
    ok = d.filter("status = 'success'").select("video_id", "segment_index").distinct()
    return d.filter("status = 'failed'").select("video_id", "segment_index").distinct().join(ok, ["video_id", "segment_index"], "left_anti")


def compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices over segments of each video."""
    f = frame_segments(spark, sf_dir)
    return f.groupBy("video_id").agg(F.sum("n_frames").alias("frames"), F.count("*").alias("segments")).withColumn("ratio", F.round(X.safe_ratio(F.col("segments"), F.col("frames")), 9))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.latest(table(spark, sf_dir, "text_records").select("text_record_id", "video_id", "title", "title_text", "transcript_text", "subtitle_text", "ocr_text"), ["text_record_id"], ["video_id"])


def ocr_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per video and piece of 4,096 record ids: records, records with frame text, coverage, the texts in order as a digest.

    The pieces of a video in order are its whole text; no cell holds more than
    a piece, whatever the video.
    """
    d = _records(spark, sf_dir).select("video_id", "text_record_id", F.trim(F.regexp_replace(F.coalesce(blank_to_null(F.col("ocr_text")), F.lit("")), r"[ \t\n]+", " ")).alias("t"))
    filled = F.col("t") != ""
    g = d.groupBy("video_id", F.floor(F.col("text_record_id") / 4096).alias("piece")).agg(F.count("*").alias("n_records"), F.count_if(filled).alias("n_texts"), F.sort_array(F.collect_list(F.when(filled, F.struct("text_record_id", "t")))).alias("ts"))
    return g.select("video_id", "piece", "n_records", "n_texts", F.round(F.col("n_texts") / F.col("n_records"), 9).alias("coverage"), F.md5(F.array_join(F.transform("ts", lambda x: x["t"]), "\n")).alias("digest"))


def text_material(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First filled of title columns, and length and digest of each text, of every record joined to its video."""
    r = _records(spark, sf_dir)
    v = videos(spark, sf_dir).select(F.col("platform_video_id").alias("video_id"), F.col("title").alias("video_title")).groupBy("video_id").agg(F.max("video_title").alias("video_title"))
    j = r.join(v, "video_id", "left")
    first = F.coalesce(blank_to_null(F.col("title_text")), blank_to_null(F.col("title")), blank_to_null(F.col("video_title")), F.lit(""))
    whole = F.concat_ws("\n", F.coalesce("transcript_text", F.lit("")), F.coalesce("subtitle_text", F.lit("")))
    return j.select("text_record_id", first.alias("best_title"), F.coalesce(F.length("transcript_text"), F.lit(0)).alias("n_transcript"), F.coalesce(F.length("subtitle_text"), F.lit(0)).alias("n_subtitle"), F.md5(whole).alias("digest"))


def composed_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled sections of every record, a repeated one dropped."""
    r = _records(spark, sf_dir)
    return r.select("text_record_id", X.compose_sections([("title", F.col("title")), ("title_text", F.col("title_text")), ("transcript", F.col("transcript_text")), ("subtitle", F.col("subtitle_text"))]).alias("material"))


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame texts with repeated lines dropped, first wins."""
    r = _records(spark, sf_dir).filter("ocr_text is not null")
    return r.select("text_record_id", X.dedup_lines(F.col("ocr_text")).alias("text"))


def near_same(a: str, b: str, ratio: float = 0.96, least: int = 24) -> bool:
    """Equal keys, containment of long ones, or a high match ratio."""
    if a == b or (len(a) >= least and len(b) >= least and (a in b or b in a)):
        return True
    m = difflib.SequenceMatcher(None, a, b)
    return m.real_quick_ratio() >= ratio and m.quick_ratio() >= ratio and m.ratio() >= ratio


def fuzzy_chunks(chunks: list[str]) -> list[str]:
    """Chunks in order; one like a kept one is dropped, or replaces it if longer."""
    keys: list[str] = []
    out: list[str] = []
    for c in chunks:
        k = "".join(x for x in c.lower() if x.isalnum())
        if not k:
            continue
        for i, seen in enumerate(keys):
            if near_same(seen, k):
                if len(k) > len(seen):
                    keys[i], out[i] = k, c
                break
        else:
            keys.append(k)
            out.append(c)
    return out


def chunk_dedup_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame texts with near-repeated lines dropped; order decides, so a row is done at once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"text_record_id": f.text_record_id, "text": ["\n".join(fuzzy_chunks([x.strip() for x in t.splitlines() if x.strip()])) for t in f.ocr_text]})

    return _records(spark, sf_dir).filter("ocr_text is not null").select("text_record_id", "ocr_text").mapInPandas(run, "text_record_id long, text string")


def vector_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors drawn as pictures of 8 by 8 tiles: hash and sharpness of each."""
    e = table(spark, sf_dir, "embeddings")
    pixels = F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda i: F.element_at("embedding", (F.floor(i / 128) * 8 + F.floor(F.pmod(i, F.lit(32)) / 4) + 1).cast("int")) * 100)
    return picture_features(e.select("vec_id", pixels.alias("pixels")).dropDuplicates(["vec_id"]), "vec_id", "pixels").withColumn("sharpness", F.round("sharpness", 4))


def embedding_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of vectors by the signs of their 64 numbers, within 32 bits of the one before, per label."""
    bit = F.aggregate(F.transform("embedding", lambda x: (x > 0).cast("long")), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(x))
    d = table(spark, sf_dir, "embeddings").select("vec_id", "label", bit.alias("h"))
    return S.adjacent_segments(d, ["label"], ["vec_id"], "h", 32).groupBy("label", F.col("segment").cast("long").alias("segment")).agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"))


def breaker_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user: failures in a row (refunds) and openings of the breaker at three."""
    d = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    first = d.agg(F.min("event_type")).scalar()
    b = S.breaker_states(d, "user_id", ["ts", "event_id"], F.col("event_type") == first, 3)
    return b.groupBy("user_id").agg(F.max("failure_count").alias("longest"), F.sum("is_open").alias("n_open"))


_L = SQL_SLICES + ", t AS (SELECT s.* FROM s JOIN (SELECT video_id, max(run_name) AS run_name FROM s GROUP BY 1) USING (video_id, run_name))"
_H = "regexp_replace(lower(trim(phash_hex)), '^0x', '')"
_SEG = f"""{_L}, h AS (SELECT *, ('0x' || substr({_H}, 1, 8))::BIGINT AS x, ('0x' || substr({_H}, 9, 8))::BIGINT AS y FROM t),
    p AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM h WINDOW w AS (PARTITION BY video_id ORDER BY segment_index)),
    g AS (SELECT *, sum(CASE WHEN bit_count(xor(x, px)) + bit_count(xor(y, py)) <= 12 THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY segment_index) AS segment FROM p),
    f AS (SELECT video_id, CAST(segment AS BIGINT) AS segment, count(*) AS n_frames, min(start_second) AS start_second, max(end_second) AS end_second,
                 arg_max(segment_index, (coalesce(duration_seconds, -1.0), -segment_index)) AS representative, string_agg(segment_index::VARCHAR, '|' ORDER BY segment_index) AS members FROM g GROUP BY 1, 2)"""
_R = "r AS (SELECT DISTINCT ON (text_record_id) * FROM text_records ORDER BY text_record_id, video_id DESC NULLS LAST, title DESC NULLS LAST, title_text DESC NULLS LAST)"
_B = "CASE WHEN lower(trim({c})) NOT IN ('', 'nan', 'none', 'null', '<na>') THEN trim({c}) END"

ORACLE = {
    "composed_sections": "WITH " + _R + " SELECT text_record_id, " + sql_sections([("title", "title"), ("title_text", "title_text"), ("transcript", "transcript_text"), ("subtitle", "subtitle_text")]) + " AS material FROM r",
    "line_dedup": "WITH " + _R + " SELECT text_record_id, " + sql_lines("ocr_text") + " AS text FROM r WHERE ocr_text IS NOT NULL",
    "frame_segments": f"WITH {_SEG} SELECT * FROM f",
    "compression": f"WITH {_SEG} SELECT video_id, CAST(sum(n_frames) AS BIGINT) AS frames, count(*) AS segments, round(count(*)::DOUBLE / sum(n_frames), 9) AS ratio FROM f GROUP BY 1",
    "timeline_blocks": f"""WITH {_L}, d AS (SELECT *, coalesce(visual_label, '') AS v, coalesce(arousal_label, '') AS a FROM t WHERE status = 'success' AND start_second IS NOT NULL AND end_second IS NOT NULL),
        p AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR v <> lag(v) OVER w OR a <> lag(a) OVER w THEN 1 ELSE 0 END AS brk FROM d WINDOW w AS (PARTITION BY video_id ORDER BY start_second, end_second, segment_index)),
        q AS (SELECT *, sum(brk) OVER (PARTITION BY video_id ORDER BY start_second, end_second, segment_index) AS run FROM p),
        m AS (SELECT *, max(end_second) OVER (PARTITION BY video_id, run ORDER BY start_second, end_second, segment_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sofar FROM q),
        b AS (SELECT *, sum(CASE WHEN sofar IS NULL OR start_second > sofar + 0.2::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY start_second, end_second, segment_index) AS n FROM m)
        SELECT video_id, CAST(n - 1 AS BIGINT) AS block_index, v, a, min(start_second) AS start_time, max(end_second) AS end_time, round(sum(duration_seconds), 3) AS duration_seconds, count(*) AS slice_count FROM b GROUP BY video_id, n, v, a""",
    "timeline_summary": f"""WITH {_L}, g AS (SELECT video_id, visual_label, CAST(sum(CAST(round(coalesce(duration_seconds, 0.0) * 1000) AS BIGINT)) AS BIGINT) AS ms FROM t WHERE visual_label IS NOT NULL GROUP BY 1, 2)
        SELECT video_id, visual_label, ms, round(CASE WHEN sum(ms) OVER w > 0 THEN ms / (sum(ms) OVER w)::DOUBLE ELSE 0.0 END, 9) AS share,
               CASE WHEN row_number() OVER (PARTITION BY video_id ORDER BY ms DESC, visual_label) = 1 THEN 1 ELSE 0 END AS is_main FROM g WINDOW w AS (PARTITION BY video_id)""",
    "representative_slice": f"WITH {_L} SELECT video_id, segment_index, duration_seconds FROM t QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY duration_seconds DESC NULLS LAST, segment_index) = 1",
    "slice_ids": "SELECT CAST(slice_id = printf('%s__segment_%04d', video_id, segment_index) AS INT) AS same, count(*) AS n FROM (SELECT DISTINCT slice_id, video_id, segment_index FROM slices) GROUP BY 1",
    "latest_run": f"WITH {_L} SELECT video_id, run_name, count(*) AS n_slices, count(*) FILTER (status = 'success') AS n_success FROM t GROUP BY 1, 2",
    "pending_slices": f"WITH {_L} SELECT DISTINCT video_id, segment_index FROM t WHERE (video_id, segment_index) NOT IN (SELECT (video_id, segment_index) FROM t WHERE status IN ('success', 'skipped'))",
    "status_ladder": f"""WITH {_L}, g AS (SELECT video_id, count(*) AS n_items, count(*) FILTER (status = 'failed') AS n_failed FROM t GROUP BY 1)
        SELECT *, CASE WHEN n_failed = 0 THEN 'completed' WHEN n_failed < n_items THEN 'partial' ELSE 'failed' END AS job_status FROM g""",
    "unresolved_failures": "SELECT DISTINCT video_id, segment_index FROM slices f WHERE status = 'failed' AND NOT EXISTS (SELECT 1 FROM slices o WHERE o.status = 'success' AND o.video_id = f.video_id AND o.segment_index = f.segment_index)",
    "ocr_rollup": f"""WITH {_R}, d AS (SELECT video_id, text_record_id, trim(regexp_replace(coalesce({_B.format(c="ocr_text")}, ''), '[ \\t\\n]+', ' ', 'g')) AS t FROM r)
        SELECT video_id, CAST(floor(text_record_id / 4096) AS BIGINT) AS piece, count(*) AS n_records, count(*) FILTER (t <> '') AS n_texts, round(count(*) FILTER (t <> '')::DOUBLE / count(*), 9) AS coverage,
               md5(coalesce(string_agg(t, chr(10) ORDER BY text_record_id) FILTER (t <> ''), '')) AS digest FROM d GROUP BY 1, 2""",
    "text_material": f"""WITH {_R}, {SQL_VIDEOS}, w AS (SELECT platform_video_id AS video_id, max(title) AS video_title FROM v GROUP BY 1)
        SELECT text_record_id, coalesce({_B.format(c="title_text")}, {_B.format(c="r.title")}, {_B.format(c="video_title")}, '') AS best_title,
               CAST(coalesce(length(transcript_text), 0) AS INT) AS n_transcript, CAST(coalesce(length(subtitle_text), 0) AS INT) AS n_subtitle, md5(coalesce(transcript_text, '') || chr(10) || coalesce(subtitle_text, '')) AS digest FROM r LEFT JOIN w USING (video_id)""",
    "embedding_frames": """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings),
        p AS (SELECT *, lag(b) OVER (PARTITION BY label ORDER BY vec_id) AS pb FROM e),
        g AS (SELECT *, sum(CASE WHEN list_sum(list_transform(list_zip(b, pb), lambda z: CAST(z[1] <> z[2] AS INT))) <= 32 AND pb IS NOT NULL THEN 0 ELSE 1 END) OVER (PARTITION BY label ORDER BY vec_id) AS segment FROM p)
        SELECT label, CAST(segment AS BIGINT) AS segment, count(*) AS n, min(vec_id) AS first_id, max(vec_id) AS last_id FROM g GROUP BY 1, 2""",
    "breaker_islands": """WITH d AS (SELECT *, CAST(event_type = (SELECT min(event_type) FROM events) AS INT) AS f FROM events),
        e AS (SELECT *, sum(1 - f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS era FROM d),
        c AS (SELECT user_id, sum(f) OVER (PARTITION BY user_id, era ORDER BY ts, event_id) AS n FROM e)
        SELECT user_id, CAST(max(n) AS BIGINT) AS longest, CAST(sum(CASE WHEN n >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS n_open FROM c GROUP BY 1""",
}
QUERIES = {f.__name__: f for f in (frame_segments, timeline_blocks, timeline_summary, representative_slice, slice_ids, latest_run, pending_slices, status_ladder, unresolved_failures, compression, ocr_rollup, text_material, composed_sections, line_dedup, chunk_dedup_fuzzy, vector_pictures, embedding_frames, breaker_islands)}
