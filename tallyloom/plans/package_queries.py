"""Samples, packages, documents and bookkeeping that hand results on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import lexicon as L
from tallyloom.functions import records as C
from tallyloom.functions import text as X
from tallyloom.functions.keys import blank_to_null, video_key
from tallyloom.operators import jobs as J
from tallyloom.operators import rollups as R
from tallyloom.operators import sampling as P
from tallyloom.operators.sequences import keep_first
from tallyloom.plans.comment_queries import _sent
from tallyloom.plans.views import SQL_COMMENTS, SQL_VIDEOS, comments, sql_lines, sql_sections, videos
from tallyloom.session import table

#: Rows of the annotation sample, and ids that one piece of a nested document spans.
SAMPLE, PIECE = 1000, 10_000


def annotation_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample for annotators by video (the 50 with most comments), month and quintile of length."""
    d = comments(spark, sf_dir).filter("text is not null and trim(text) <> ''").select("id", "video_id", F.length("text").alias("n_chars"), F.coalesce(F.date_format("updated_at", "yyyy-MM"), F.lit("MISSING")).alias("month"))
    return P.annotation_sample(d, "video_id", "month", "n_chars", "id", SAMPLE).select("id", "stratum")


def video_research_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per video: comments, share and mean probability of anger, share of confident anger, mean likes."""
    d = comments(spark, sf_dir).select("id", "video_id", "likes", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("anger_prob", 1.0 - L.polarity(F.col("text")))
    sure = F.greatest("anger_prob", 1.0 - F.col("anger_prob")) >= 0.6
    d = d.withColumn("label", (F.col("anger_prob") >= 0.5).cast("double")).withColumn("high", F.when(sure, F.col("label")).otherwise(0.0))
    return d.groupBy("video_id").agg(F.count("id").alias("n_comments"), F.round(F.avg("label"), 9).alias("anger_rate"), F.round(F.avg("anger_prob"), 9).alias("mean_anger_prob"), F.round(F.avg("high"), 9).alias("high_confidence_anger_rate"), F.round(F.avg(F.col("likes").cast("double")), 9).alias("mean_likes"))


def _first_of(d: DataFrame, key: str, order: str) -> DataFrame:
    return keep_first(d, F.col(key), [order])


def text_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text package of every video of the universe: the transcripts' videos, else those of frame texts, else all.

    Reference, transcript and frame texts are left-joined to the universe; of
    several records of a video the first counts.
    """
    r = table(spark, sf_dir, "text_records").groupBy("text_record_id").agg(*(F.max(c).alias(c) for c in ("video_id", "title_text", "transcript_text", "subtitle_text", "ocr_text"))).withColumn("video_id", video_key(F.col("video_id"))).filter("video_id is not null")
    ref = videos(spark, sf_dir).select(video_key(F.col("platform_video_id")).alias("video_id"), "id", F.coalesce("title", F.lit("")).alias("title")).filter("video_id is not null")
    ref = _first_of(ref, "video_id", "id").select("video_id", "title")
    said = _first_of(r.filter(blank_to_null(F.col("transcript_text")).isNotNull()), "video_id", "text_record_id").select("video_id", "title_text", "transcript_text", "subtitle_text")
    seen = _first_of(r.filter(blank_to_null(F.col("ocr_text")).isNotNull()), "video_id", "text_record_id").select("video_id", "ocr_text")
    # which universe holds is decided by two scalar subqueries
    any_said, any_seen = (d.agg(F.count("*") > 0).scalar() for d in (said, seen))
    ids = said.select("video_id", F.lit("transcript").alias("scope")).unionByName(seen.filter(~any_said).select("video_id", F.lit("ocr").alias("scope"))).unionByName(ref.filter(~any_said & ~any_seen).select("video_id", F.lit("reference").alias("scope")))
    j = ids.join(ref, "video_id", "left").join(said, "video_id", "left").join(seen, "video_id", "left")
    material = X.compose_sections([("标题", F.col("title_text")), ("转写", F.col("transcript_text")), ("字幕", F.col("subtitle_text")), ("画面", F.col("ocr_text"))])
    j = j.withColumn("material", material)
    name = X.slug(F.col("video_id"))
    return j.select("video_id", "scope", F.coalesce("title", F.lit("")).alias("title"), F.length("material").alias("text_length_chars"), F.md5("material").alias("digest"), F.concat(F.lit("packages/json/"), name, F.lit(".json")).alias("package_json_path"), F.concat(F.lit("packages/txt/"), name, F.lit(".txt")).alias("package_txt_path"))


def video_text_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every video with the counts of its frame texts; 0 and coverage 0.0 where there are none."""
    v = videos(spark, sf_dir).select("id", video_key(F.col("platform_video_id")).alias("video_id"))
    r = table(spark, sf_dir, "text_records").select("text_record_id", video_key(F.col("video_id")).alias("video_id"), blank_to_null(F.col("ocr_text")).isNotNull().cast("int").alias("filled")).groupBy("text_record_id").agg(F.max("video_id").alias("video_id"), F.max("filled").alias("filled"))
    g = r.filter("video_id is not null").groupBy("video_id").agg(F.count("*").alias("n"), F.sum("filled").alias("k"))
    j = v.join(g, "video_id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_records"), F.coalesce("k", F.lit(0)).alias("n_texts"))
    return j.withColumn("coverage", F.round(X.safe_ratio(F.col("n_texts"), F.col("n_records")), 9))


def comment_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots with their replies nested, orphans apart, as JSON in pieces of bounded size.

    A piece spans ``PIECE`` reply ids, so a thread of any size is many cells.
    Replies are ordered by level and id and carry the text they answer.
    """
    c = comments(spark, sf_dir, "platform_comment_id", "root_comment_platform_id").select("id", "level", "video_id", "platform_comment_id", "root_comment_platform_id", F.coalesce("text", F.lit("")).alias("text"))
    roots = c.filter("level = 1").select(F.col("platform_comment_id").alias("root_comment_platform_id"), "video_id", F.col("id").alias("root_id"), F.col("text").alias("root_text"))
    roots = roots.groupBy("root_comment_platform_id", "video_id").agg(F.min(F.struct("root_id", "root_text")).alias("r")).select("root_comment_platform_id", "video_id", "r.*")
    rep = c.filter("level = 2").join(roots, ["root_comment_platform_id", "video_id"], "left")
    entry = F.struct("level", "id", "text", F.coalesce("root_text", F.lit("")).alias("reply_to"))
    g = rep.groupBy("video_id", "root_id", F.floor(F.col("id") / F.lit(PIECE)).alias("piece")).agg(F.count("*").alias("n_replies"), F.to_json(F.sort_array(F.collect_list(entry))).alias("replies"))
    return g.select("video_id", "root_id", "piece", "n_replies", F.when(F.col("root_id").isNull(), "orphans").otherwise("replies").alias("kind"), F.md5("replies").alias("digest"))


def record_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every comment as one line of JSON: levels as words, times in ISO form."""
    c = comments(spark, sf_dir, "source")
    at = F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    row = F.struct("id", X.level_label(F.col("level")).alias("level"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("likes", F.lit(0)).alias("likes"), F.coalesce(at, F.lit("")).alias("updated_at"))
    return c.select("id", F.to_json(row).alias("record"))


def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 documents by id, repeats removed: a prefix is the feature here."""
    return table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.max("n_chars").alias("n_chars")).orderBy("doc_id").limit(500)


def listing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files per folder, without the sidecars whose names begin with ``._``."""
    p = table(spark, sf_dir, "slices").select("image_path").filter("image_path is not null").distinct()
    name, folder = F.element_at(F.split("image_path", "/"), -1), F.regexp_replace("image_path", "/?[^/]*$", "")
    return J.listing_counts(p.select(folder.alias("folder"), name.alias("name")), "folder", "name")


def picked_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address to download for each video: play, download, then bit rate lists of the payload, else the column."""
    v = videos(spark, sf_dir).select("id")
    link = lambda k: F.concat(F.lit(f'"https://{k}.example.net/'), F.col("id").cast("string"), F.lit('"'))
    play = F.when(F.col("id") % 3 == 0, F.concat(F.lit('["ftp://x", '), link("play"), F.lit("]"))).otherwise(F.lit("[]"))
    rate = F.when(F.col("id") % 3 == 1, F.concat(F.lit('[{"play_addr": {"url_list": []}}, {"play_addr": {"url_list": ['), link("rate"), F.lit("]}}]"))).otherwise(F.lit("null"))
    raw = F.concat(F.lit('{"video": {"play_addr": {"url_list": '), play, F.lit('}, "bit_rate": '), rate, F.lit("}}"))
    d = v.select("id", raw.alias("raw"), F.when(F.col("id") % 6 == 2, F.lit("http://own.example.net/")).otherwise("none").alias("own"))
    return d.select("id", C.picked_url(F.col("raw"), F.col("own")).alias("url"))


def flat_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of result pages: an item's own record, else the first of its mix; others dropped."""
    v = videos(spark, sf_dir).select("id", F.floor(F.col("id") / 5).alias("page"))
    item = F.when(F.col("id") % 4 == 0, F.concat(F.lit('{"aweme_mix_info": {"mix_items": [{"aweme_id": "'), F.col("id").cast("string"), F.lit('"}, {"aweme_id": "x"}]}}'))).when(F.col("id") % 4 == 1, F.lit("{}")).otherwise(F.concat(F.lit('{"aweme_info": {"aweme_id": "'), F.col("id").cast("string"), F.lit('"}}')))
    pages = v.groupBy("page").agg(F.concat(F.lit('{"data": ['), F.array_join(F.collect_list(item), ","), F.lit("]}")).alias("payload"))
    return C.flat_pages(pages, "payload").select("page", F.get_json_object("record", "$.aweme_id").cast("long").alias("id"))


def crawl_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cursor of each video's comments with the counters to resume from."""
    c = comments(spark, sf_dir).filter("video_id is not null")
    return J.progress(c, "video_id", "id", F.col("level") == 1)


def cursor_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each user's log up to the first cursor that was met before."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.get_json_object("props", "$.k").alias("cursor"))
    return J.until_repeated(e, "user_id", "event_id", "cursor").groupBy("user_id").agg(F.count("*").alias("n_pages"), F.max("event_id").alias("last_page"))


def picked_resource(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier whose turn it is at each of ten cursors, without those disabled or excluded."""
    s = table(spark, sf_dir, "supplier").filter("s_acctbal > 0 and s_nationkey not in (3, 7)").select(F.col("s_suppkey").alias("id"))
    return J.in_turn(s, "id", range(10))


def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waits before each attempt at the slices that failed: linear and doubling, up to a minute."""
    s = table(spark, sf_dir, "slices").filter("status = 'failed'").select("slice_id").distinct()
    d = s.select("slice_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("attempt"))
    return d.groupBy("attempt").agg(F.count("*").alias("n"), F.max(J.backoff(F.col("attempt"), 2.0, False, 60.0)).alias("linear_s"), F.max(J.backoff(F.col("attempt"), 2.0, True, 20.0)).alias("doubling_s"))


def least_confident(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 comments of least confidence, a report for review."""
    d = comments(spark, sf_dir).select("id", L.polarity(F.coalesce("text", F.lit(""))).alias("p"))
    return d.select("id", F.round(F.greatest("p", 1 - F.col("p")), 9).alias("confidence")).orderBy("confidence", "id").limit(100)


def box_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a box plot of likes by level needs: five numbers and the points outside the fences."""
    d = comments(spark, sf_dir).filter("likes is not null and level is not null").select("level", F.col("likes").cast("double").alias("likes"))
    return R.box_numbers(d, "level", "likes").select("level", *(F.round(c, 6).alias(c) for c in ("low", "p25", "median", "p75", "high")), "n_outside")


def merged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and frame text of each record as one text, repeated lines dropped."""
    r = table(spark, sf_dir, "text_records").groupBy("text_record_id").agg(F.max("title_text").alias("a"), F.max("ocr_text").alias("b"))
    return r.select("text_record_id", F.md5(X.merged_lines(F.col("a"), F.col("b"))).alias("digest"))


_TEXT = "max({c}) AS {c}"
_VIDEO = "CASE WHEN lower(regexp_replace(trim({c}), '\\.0$', '')) NOT IN ('', 'nan', 'none', 'null', '<na>') THEN regexp_replace(trim({c}), '\\.0$', '') END"
_FILLED = "lower(trim({c})) NOT IN ('', 'nan', 'none', 'null', '<na>')"

ORACLE = {
    "annotation_sample": f"""WITH {SQL_COMMENTS}, d AS (SELECT id, coalesce(nullif(trim(video_id::VARCHAR), ''), 'MISSING') AS v, length(text) AS n_chars, coalesce(strftime(updated_at, '%Y-%m'), 'MISSING') AS month FROM c WHERE text IS NOT NULL AND trim(text) <> ''),
        top AS (SELECT v FROM d GROUP BY 1 ORDER BY count(*) DESC, v LIMIT 50), e AS (SELECT DISTINCT unnest([quantile_cont(n_chars, 0.2), quantile_cont(n_chars, 0.4), quantile_cont(n_chars, 0.6), quantile_cont(n_chars, 0.8), quantile_cont(n_chars, 1.0)]) AS e, quantile_cont(n_chars, 0.0) AS lo FROM d),
        s AS (SELECT id, CASE WHEN v IN (FROM top) THEN v ELSE 'OTHER' END || '|' || month || '|' || (SELECT count(*) FROM e WHERE e > lo AND n_chars > e) AS stratum FROM d),
        z AS (SELECT stratum, count(*) AS size FROM s GROUP BY 1), r AS (SELECT *, size::DOUBLE / (SELECT sum(size) FROM z) * {SAMPLE}.0::DOUBLE AS raw FROM z), k AS (SELECT *, row_number() OVER (ORDER BY round(raw - floor(raw), 9) DESC, stratum) AS n FROM r),
        q AS (SELECT stratum, CASE WHEN (SELECT sum(size) FROM z) <= {SAMPLE} THEN size ELSE floor(raw) + CASE WHEN n <= {SAMPLE} - (SELECT sum(floor(raw)) FROM r) THEN 1 ELSE 0 END END AS quota FROM k),
        h AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42|' || id), id) AS n FROM s) SELECT id, stratum FROM h JOIN q USING (stratum) WHERE n <= quota""",
    "video_research_table": f"""WITH {SQL_COMMENTS}, t AS (SELECT id, video_id, likes, coalesce(text, '') AS text FROM c), p AS (SELECT *, 1.0::DOUBLE - CASE WHEN trim(text) = '' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE / (1.0::DOUBLE + exp(-{_sent(L.POLARITY)})) END AS a FROM t),
        k AS (SELECT *, CASE WHEN a >= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM p)
        SELECT video_id, count(id) AS n_comments, round(avg(y), 9) AS anger_rate, round(avg(a), 9) AS mean_anger_prob, round(avg(CASE WHEN greatest(a, 1 - a) >= 0.6 THEN y ELSE 0.0::DOUBLE END), 9) AS high_confidence_anger_rate, round(avg(likes::DOUBLE), 9) AS mean_likes FROM k GROUP BY 1""",
    "text_universe": f"""WITH {SQL_VIDEOS}, r0 AS (SELECT text_record_id, max(video_id) AS video_id, {", ".join(_TEXT.format(c=c) for c in ("title_text", "transcript_text", "subtitle_text", "ocr_text"))} FROM text_records GROUP BY 1),
        r AS (SELECT * REPLACE ({_VIDEO.format(c="video_id")} AS video_id) FROM r0), ref AS (SELECT DISTINCT ON (k) k AS video_id, coalesce(title, '') AS title FROM (SELECT {_VIDEO.format(c="platform_video_id")} AS k, id, title FROM v) WHERE k IS NOT NULL ORDER BY k, id),
        said AS (SELECT DISTINCT ON (video_id) video_id, title_text, transcript_text, subtitle_text FROM r WHERE video_id IS NOT NULL AND {_FILLED.format(c="transcript_text")} ORDER BY video_id, text_record_id),
        seen AS (SELECT DISTINCT ON (video_id) video_id, ocr_text FROM r WHERE video_id IS NOT NULL AND {_FILLED.format(c="ocr_text")} ORDER BY video_id, text_record_id),
        ids AS (SELECT video_id, 'transcript' AS scope FROM said UNION ALL SELECT video_id, 'ocr' FROM seen WHERE NOT EXISTS (FROM said) UNION ALL SELECT video_id, 'reference' FROM ref WHERE NOT EXISTS (FROM said) AND NOT EXISTS (FROM seen)),
        m AS (SELECT video_id, scope, coalesce(title, '') AS title, {sql_sections([("标题", "title_text"), ("转写", "transcript_text"), ("字幕", "subtitle_text"), ("画面", "ocr_text")])} AS material FROM ids LEFT JOIN ref USING (video_id) LEFT JOIN said USING (video_id) LEFT JOIN seen USING (video_id))
        SELECT video_id, scope, title, CAST(length(material) AS INT) AS text_length_chars, md5(material) AS digest, 'packages/json/' || regexp_replace(video_id, '[^A-Za-z0-9_-]', '_', 'g') || '.json' AS package_json_path, 'packages/txt/' || regexp_replace(video_id, '[^A-Za-z0-9_-]', '_', 'g') || '.txt' AS package_txt_path FROM m""",
    "video_text_base": f"""WITH {SQL_VIDEOS}, r AS (SELECT text_record_id, max({_VIDEO.format(c="video_id")}) AS video_id, max(coalesce({_FILLED.format(c="ocr_text")}, false)::INT) AS f FROM text_records GROUP BY 1), g AS (SELECT video_id, count(*) AS n, sum(f) AS k FROM r WHERE video_id IS NOT NULL GROUP BY 1)
        SELECT id, coalesce(n, 0) AS n_records, CAST(coalesce(k, 0) AS BIGINT) AS n_texts, round(CASE WHEN coalesce(n, 0) = 0 THEN 0.0::DOUBLE ELSE k::DOUBLE / n END, 9) AS coverage FROM v LEFT JOIN g ON g.video_id = {_VIDEO.format(c="v.platform_video_id")}""",
    "comment_documents": f"""WITH {SQL_COMMENTS}, b AS (SELECT id, level, video_id, platform_comment_id AS p, root_comment_platform_id AS q, coalesce(text, '') AS text FROM c),
        roots AS (SELECT DISTINCT ON (p, video_id) p, video_id, id AS root_id, text AS root_text FROM b WHERE level = 1 ORDER BY p, video_id, id),
        r AS (SELECT b.*, root_id, root_text FROM b LEFT JOIN roots ON roots.p = b.q AND roots.video_id = b.video_id WHERE level = 2)
        SELECT video_id, root_id, CAST(floor(id / {PIECE}) AS BIGINT) AS piece, count(*) AS n_replies, CASE WHEN root_id IS NULL THEN 'orphans' ELSE 'replies' END AS kind,
               md5(to_json(list({{'level': level, 'id': id, 'text': text, 'reply_to': coalesce(root_text, '')}} ORDER BY id))::VARCHAR) AS digest FROM r GROUP BY 1, 2, 3""",
    "record_json": f"""WITH {SQL_COMMENTS} SELECT id, to_json({{'id': id, 'level': CASE level WHEN 1 THEN 'root' WHEN 2 THEN 'reply' ELSE level || '-level' END, 'source': coalesce(source, ''), 'likes': coalesce(likes, 0), 'updated_at': coalesce(strftime(updated_at, '%Y-%m-%dT%H:%M:%S+00:00'), '')}})::VARCHAR AS record FROM c""",
    "first_rows": "SELECT doc_id, max(n_chars) AS n_chars FROM documents GROUP BY 1 ORDER BY 1 LIMIT 500",
    "listing_counts": "WITH p AS (SELECT DISTINCT image_path AS p FROM slices WHERE image_path IS NOT NULL), k AS (SELECT regexp_replace(p, '/?[^/]*$', '') AS folder, regexp_extract(p, '[^/]*$') AS name FROM p) SELECT folder, count(*) AS n_files FROM k WHERE NOT starts_with(name, '._') GROUP BY 1",
    "picked_urls": f"WITH {SQL_VIDEOS} SELECT id, CASE WHEN id % 3 = 0 THEN 'https://play.example.net/' || id WHEN id % 3 = 1 THEN 'https://rate.example.net/' || id WHEN id % 6 = 2 THEN 'http://own.example.net/' END AS url FROM v",
    "flat_pages": f"WITH {SQL_VIDEOS} SELECT CAST(floor(id / 5) AS BIGINT) AS page, id FROM v WHERE id % 4 <> 1",
    "crawl_progress": f"""WITH {SQL_COMMENTS}, g AS (SELECT video_id, max(id) AS last_id, count(*) AS n, count(*) FILTER (level = 1) AS k FROM c WHERE video_id IS NOT NULL GROUP BY 1)
        SELECT video_id, last_id, n AS comment_count, k AS root_comment_count, n - k AS reply_count, '{{"comment_count":' || n || ',"cursor":"' || last_id || '","reply_count":' || (n - k) || ',"root_comment_count":' || k || '}}' AS cursor FROM g""",
    "cursor_guard": """WITH e AS (SELECT user_id, event_id, json_extract_string(props, '$.k') AS k FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY event_id) AS i FROM e), s AS (SELECT user_id, min(event_id) AS stop FROM o WHERE i > 1 AND k IS NOT NULL GROUP BY 1)
        SELECT user_id, count(*) AS n_pages, max(event_id) AS last_page FROM e LEFT JOIN s USING (user_id) WHERE stop IS NULL OR event_id < stop GROUP BY 1""",
    "picked_resource": "WITH s AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier WHERE s_acctbal > 0 AND s_nationkey NOT IN (3, 7)) SELECT CAST(c AS INT) AS cursor, id FROM s, generate_series(0, 9) AS t(c) WHERE i = c % n",
    "retry_schedule": "SELECT CAST(a AS INT) AS attempt, count(*) AS n, least(2.0::DOUBLE * a, 60) AS linear_s, least(2.0::DOUBLE * pow(2, a - 1), 20) AS doubling_s FROM (SELECT DISTINCT slice_id FROM slices WHERE status = 'failed'), generate_series(1, 5) AS t(a) GROUP BY a",
    "least_confident": f"""WITH {SQL_COMMENTS}, t AS (SELECT id, coalesce(text, '') AS text FROM c), p AS (SELECT id, CASE WHEN trim(text) = '' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE / (1.0::DOUBLE + exp(-{_sent(L.POLARITY)})) END AS p FROM t)
        SELECT id, round(greatest(p, 1 - p), 9) AS confidence FROM p ORDER BY confidence, id LIMIT 100""",
    "box_table": f"""WITH {SQL_COMMENTS}, d AS (SELECT level, likes::DOUBLE AS x FROM c WHERE likes IS NOT NULL AND level IS NOT NULL), q AS (SELECT level, min(x) AS low, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS p75, max(x) AS high FROM d GROUP BY 1)
        SELECT level, round(low, 6) AS low, round(p25, 6) AS p25, round(median, 6) AS median, round(p75, 6) AS p75, round(high, 6) AS high, (SELECT count(*) FROM d WHERE d.level = q.level AND (x < p25 - 1.5 * (p75 - p25) OR x > p75 + 1.5 * (p75 - p25))) AS n_outside FROM q""",
    "merged_lines": f"WITH r AS (SELECT text_record_id, max(title_text) AS a, max(ocr_text) AS b FROM text_records GROUP BY 1), m AS (SELECT text_record_id, coalesce(a, '') || chr(10) || coalesce(b, '') AS t FROM r) SELECT text_record_id, md5({sql_lines('t')}) AS digest FROM m",
}
QUERIES = {f.__name__: f for f in (annotation_sample, video_research_table, text_universe, video_text_base, comment_documents, record_json, first_rows, listing_counts, picked_urls, flat_pages, crawl_progress, cursor_guard, picked_resource, retry_schedule, least_confident, box_table, merged_lines)}
