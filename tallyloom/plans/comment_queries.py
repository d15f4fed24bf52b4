"""Comments: cleaning, scoring, roll-ups, trees, curation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import lexicon as L
from tallyloom.functions import text as X
from tallyloom.operators.rollups import mode_by
from tallyloom.operators.sequences import keep_first, top_per_group
from tallyloom.plans.views import SQL_COMMENTS, SQL_LABELS, SQL_ROWS, SQL_SPACE, SQL_VIDEOS, comment_rows, comments, labels, videos
from tallyloom.session import table

#: Vocabulary of the curation ladder.
CURATION = L.CurationTerms(
    strong=tuple("吸毒记录封存 吸毒记录 吸毒封存 吸毒人员 吸食、注射毒品 吸食、注射 哪位少爷吸了 法工委回应 人大法工委 娱乐场所 不得进娱乐场所 不得进入娱乐场所 封存不是删除".split()),
    support=tuple("违法记录封存 治安违法记录封存 记录封存 毒品犯罪 官方回应吸毒记录封存".split()),
    context=tuple("禁毒 涉毒 毒品 缉毒 戒毒 入刑 封存 吸毒 拘留".split()),
    noise=tuple("校园霸凌 校园欺凌 犬只伤人 烈性犬 养犬 网暴 骂人 诽谤 造谣 寻衅滋事 卖淫 未成年人 孩子 正当防卫 网络暴力 犯罪记录封存 轻微犯罪记录封存".split()),
    strong_queries=tuple("吸毒记录封存 吸毒记录 哪位少爷吸了 吸毒入刑 吸毒记录封存政策".split()),
    broad_queries=("记录封存", "治安管理处罚法"),
)


def video_anger_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per video: labelled comments, anger rate, mean likes (the flagship)."""
    lab = labels(spark, sf_dir).filter("record_table = 'comments'").select(F.col("record_id").cast("long").alias("id"), F.coalesce("adjudicated", F.when(F.col("a") == F.col("b"), F.col("a"))).alias("label")).groupBy("id").agg(F.max("label").alias("label"))
    d = comments(spark, sf_dir).join(lab, "id")
    return d.groupBy("video_id").agg(F.count("id").alias("n_comments"), F.round(F.avg(F.col("label").cast("double")), 9).alias("anger_rate"), F.round(F.avg(F.col("likes").cast("double")), 9).alias("mean_likes"))


def anger_share_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: comments, labelled ones (left join), share of angry among them, 0 where none."""
    lab = labels(spark, sf_dir).filter("record_table = 'comments'").select(F.col("record_id").cast("long").alias("id"), F.col("adjudicated").alias("label")).groupBy("id").agg(F.max("label").alias("label"))
    d = comments(spark, sf_dir, "source").join(lab, "id", "left")
    g = d.groupBy("source").agg(F.count("*").alias("n_comments"), F.count("label").alias("n_labelled"), F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("n_angry"))
    return g.withColumn("anger_share", F.round(X.safe_ratio(F.col("n_angry"), F.col("n_labelled")), 9))


def comment_count_by_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments of each video, none included."""
    n = comments(spark, sf_dir).groupBy("video_id").agg(F.count("*").alias("n_comments"))
    return videos(spark, sf_dir).select(F.col("id").alias("video_id")).join(n, "video_id", "left").withColumn("n_comments", F.coalesce("n_comments", F.lit(0)))


def zero_comment_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos without a comment: an anti join."""
    return videos(spark, sf_dir).select("id").join(table(spark, sf_dir, "comments").select(F.col("video_id").alias("id")), "id", "left_anti")


def zero_comment_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as outer join, group and HAVING count = 0, with level-1 comments only."""
    c = table(spark, sf_dir, "comments").filter("level = 1").select("video_id", F.col("id").alias("cid"))
    v = videos(spark, sf_dir).select("id")
    return v.join(c, v.id == c.video_id, "left").groupBy("id").agg(F.count("cid").alias("n")).filter("n = 0").select("id")


def clean_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, blank, symbol-only and repeated texts after cleaning."""
    d = comments(spark, sf_dir).select(X.clean(F.col("text")).alias("t"))
    per = d.groupBy("t").agg(F.count("*").alias("n")).withColumn("blank", F.coalesce(F.col("t") == "", F.lit(True)))
    sym = F.when(~F.col("blank"), X.symbol_only(F.col("t"))).otherwise(F.lit(False))
    return per.agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("n_blank"), F.sum(F.when(sym, F.col("n")).otherwise(0)).alias("n_symbol_only"), F.sum(F.when(~F.col("blank"), F.col("n") - 1).otherwise(0)).alias("n_repeated"), F.count_if(~F.col("blank")).alias("n_kept"))


def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First comment of each text over all videos."""
    d = comments(spark, sf_dir).filter("text is not null and trim(text) <> ''").select("id", "video_id", "text")
    return keep_first(d, F.trim("text"), ["id"]).select("id", "video_id")


def dedup_per_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First comment of each text within a video."""
    d = comments(spark, sf_dir).filter("text is not null and trim(text) <> ''").select("id", "video_id", "text")
    return keep_first(d, F.struct("video_id", F.trim("text")), ["id"]).groupBy("video_id").agg(F.count("*").alias("n_texts"))


def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """md5 ids of every comment."""
    return comments(spark, sf_dir).select("id", X.stable_id(F.lit("comments"), F.col("id"), F.coalesce("text", F.lit(""))).alias("stable_id"))


def symbol_only_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of every table, and those of marks, emoji and digits-free symbols alone."""
    columns = {"comments": ("text", "author_name"), "comment_rows": ("text_raw", "text_clean"), "documents": ("text",), "text_records": ("title", "ocr_text", "subtitle_text"), "videos": ("title", "description", "tags", "stats")}
    # every line of a text is judged, so that marks between paragraphs count too
    parts = [table(spark, sf_dir, t).select(F.lit(f"{t}.{c}").alias("field"), F.explode(F.split(F.col(c), "[\n.。!！?？]")).alias("piece")) for t, cs in columns.items() for c in cs]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    piece = X.clean(F.col("piece"))
    return every.filter(piece != "").groupBy("field").agg(F.count("*").alias("n_pieces"), F.count_if(X.symbol_only(piece)).alias("n_symbol_only"))


def sentiment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentiment and stance of every exported comment."""
    t = F.col("text")
    d = comment_rows(spark, sf_dir).select("comment_row_id", "text").withColumns({"sentiment_score": F.round(L.sentiment_score(t), 6), "stance_score": L.stance_score(t), "has_target": X.any_term(t, L.DEFAULT.target).cast("int")})
    return d.select("comment_row_id", "sentiment_score", L.sentiment_label(F.col("sentiment_score")).alias("sentiment"), "stance_score", L.stance_label(F.col("stance_score")).alias("stance"), "has_target")


def video_polarization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per video: counts by label, mean and population sd of the score, ratios, balance, confrontation."""
    t = F.col("text")
    d = comment_rows(spark, sf_dir).filter("video is not null").withColumns({"score": L.sentiment_score(t), "st": L.stance_score(t), "hit": X.any_term(t, L.DEFAULT.target).cast("int")})
    d = d.withColumns({"label": L.sentiment_label(F.col("score")), "stance": L.stance_label(F.col("st"))})
    g = d.groupBy("video").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("level") == "1").alias("level1"),
        F.count_if(F.col("level") == "2").alias("level2"),
        F.count_if(F.col("label") == "positive").alias("positive"),
        F.count_if(F.col("label") == "negative").alias("negative"),
        F.count_if(F.col("stance") == "support").alias("support"),
        F.count_if(F.col("stance") == "oppose").alias("oppose"),
        F.round(F.avg("score"), 6).alias("mean"),
        F.round(F.stddev_pop("score"), 6).alias("sd"),
        F.round(F.avg(F.col("hit").cast("double")), 6).alias("target_ratio"),
    )
    s, o = F.col("support"), F.col("oppose")
    return g.withColumns({"non_neutral_ratio": F.round(X.safe_ratio(F.col("positive") + F.col("negative"), F.col("total")), 6), "balance": F.round(X.safe_ratio(F.abs(s - o), s + o), 6), "confrontation": F.round(X.safe_ratio(2 * F.least(s, o), s + o), 6)})


def _spread(key: Column, row_id: Column) -> Column:
    """A join key of strings in which rows without one are told apart, so that no task gets them all."""
    return F.coalesce(key.cast("string"), F.concat(F.lit("\u0000"), row_id.cast("string")))


def polarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per video: mean polarity, mean and sd of intensity, pairs of reply and parent and their transmissibility."""
    d = comment_rows(spark, sf_dir).select("comment_row_id", "video", "parent", X.mask_links(F.col("text")).alias("t")).select("comment_row_id", "video", "parent", L.polarity(F.col("t")).alias("p"))
    mean = d.agg(F.avg("p")).scalar()
    d = d.withColumn("i", L.intensity(F.col("p"), mean))
    parent = d.select(F.col("comment_row_id").alias("own"), F.col("p").alias("pp"))
    # rows without a parent go to many tasks by a key that matches nothing
    j = d.join(parent, _spread(F.col("parent"), F.col("comment_row_id")) == F.col("own"), "left").withColumn("tr", L.transmissibility(F.col("pp"), F.col("p")))
    return j.groupBy("video").agg(F.count("*").alias("total"), F.round(F.avg("p"), 6).alias("polarity"), F.round(F.avg("i"), 6).alias("intensity"), F.round(F.stddev_pop("i"), 6).alias("intensity_sd"), F.count("tr").alias("n_pairs"), F.round(F.coalesce(F.avg("tr"), F.lit(0.0)), 6).alias("transmissibility"))


def category_stance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per video: mean cosine with each category, most frequent label (first met on ties), mean strength and gap."""
    d = comment_rows(spark, sf_dir).filter("video is not null")
    cos = L.category_cosines(F.col("text"), L.CATEGORIES)
    d = d.withColumns({f"c_{k}": v for k, v in cos.items()})
    d = d.withColumn("st", L.stance_of({k: F.col(f"c_{k}") for k in cos})).withColumn("seq", F.col("comment_row_id").cast("long"))
    d = d.select("video", "seq", *(f"c_{k}" for k in cos), F.col("st.label").alias("label"), F.col("st.strength").alias("strength"), F.col("st.gap").alias("gap"), F.col("st.polarization").alias("pol"))
    means = d.groupBy("video").agg(*(F.round(F.avg(f"c_{k}"), 6).alias(f"mean_{k}") for k in cos), F.round(F.avg("strength"), 6).alias("mean_strength"), F.round(F.avg("gap"), 6).alias("mean_gap"), F.round(F.avg("pol"), 6).alias("mean_polarization"))
    return means.join(mode_by(d, ["video"], "label", "seq").select("video", F.col("label").alias("top_label")), "video")


def comment_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per root comment and piece of 10,000 ids: replies in order of id, as one string.

    A thread with a third of all replies is many pieces of bounded size.
    """
    c = comments(spark, sf_dir, "parent_comment_id", "platform_comment_id", "root_comment_platform_id")
    roots = c.filter("level = 1").select("platform_comment_id", F.col("id").alias("root_id"))
    rep = c.filter("level = 2 and root_comment_platform_id is not null").select("id", F.col("root_comment_platform_id").alias("platform_comment_id"))
    return rep.join(roots, "platform_comment_id").groupBy("root_id", F.floor(F.col("id") / 10_000).alias("piece")).agg(F.count("*").alias("n_replies"), F.array_join(F.sort_array(F.collect_list("id")), ",").alias("reply_ids"))


def orphan_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies whose root is not among the comments."""
    c = comments(spark, sf_dir, "platform_comment_id", "root_comment_platform_id")
    roots = c.filter("level = 1").select(F.col("platform_comment_id").alias("root_comment_platform_id"))
    return c.filter("level = 2").join(roots, "root_comment_platform_id", "left_anti").select("id")


def parent_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments by own and parent's level label; a missing parent counts apart."""
    c = comments(spark, sf_dir, "parent_comment_id")
    p = c.select(F.col("id").cast("string").alias("own"), F.col("level").alias("pl"))
    j = c.select("id", "level", "parent_comment_id").join(p, _spread(F.col("parent_comment_id"), F.col("id")) == F.col("own"), "left")
    return j.groupBy(X.level_label(F.col("level")).alias("level_label"), F.coalesce(X.level_label(F.col("pl")), F.lit("none")).alias("parent_label")).agg(F.count("*").alias("n"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per video and tag."""
    return videos(spark, sf_dir).select("id", "title", "description", F.explode(F.from_json("tags", "array<string>")).alias("tag")).distinct()


def videos_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos hit by any of some tags, once each: a semi join through the bridge."""
    hits = tags(spark, sf_dir).filter(F.col("tag").isin("记录封存", "普法日记")).select("id")
    return videos(spark, sf_dir).join(hits, "id", "left_semi").select("id", "platform_video_id")


def tag_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted distinct tags of each video, empty where none."""
    per = tags(spark, sf_dir).groupBy("id").agg(F.sort_array(F.collect_set("tag")).alias("ts"))
    return videos(spark, sf_dir).select("id").join(per, "id", "left").select("id", F.coalesce(F.array_join("ts", "|"), F.lit("")).alias("tag_set"), F.coalesce(F.size("ts"), F.lit(0)).alias("n_tags"))


def curation_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision and rung of each video by title, description and tags as queries."""
    per = tags(spark, sf_dir).groupBy("id").agg(F.collect_set("tag").alias("qs"))
    v = videos(spark, sf_dir).select("id", X.joined_fields(F.col("title"), F.col("description")).alias("t")).join(per, "id", "left")
    c = L.curation(F.col("t"), F.coalesce("qs", F.array().cast("array<string>")), CURATION)
    return v.withColumn("c", c).select("id", "c.decision", "c.rung", F.array_join(X.matched_terms(F.col("t"), CURATION.noise), "|").alias("noise_terms"))


def curation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos per decision."""
    return curation_ladder(spark, sf_dir).groupBy("decision").agg(F.count("*").alias("n"))


def time_range_null_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos published in a range, both ends included; a NULL time passes."""
    at = F.col("published_at")
    lo, hi = (F.timestamp_seconds(F.lit(s)) for s in (1756684800, 1767225599))
    return videos(spark, sf_dir).filter(at.isNull() | at.between(lo, hi)).select("id")


def gram_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency of Han 2-grams and 3-grams, at least 20, the 200 most frequent (a top-k report)."""
    d = comments(spark, sf_dir).select(F.explode(X.ngrams(F.coalesce("text", F.lit("")), 2, 3)).alias("term"))
    return d.groupBy("term").agg(F.count("*").alias("df")).filter("df >= 20").orderBy(F.desc("df"), "term").limit(200)


def lexicon_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Han 2-grams that go with the seeds of a category: co-occurrence over the root of both counts, the best 20 each."""
    seeds = {"law": ("法律", "条文", "封存"), "public": ("评论区", "网上", "大家")}
    texts = comments(spark, sf_dir).select("id", F.coalesce("text", F.lit("")).alias("t"))
    d = texts.withColumn("grams", X.ngrams(F.col("t"), 2, 2))
    every = [s for v in seeds.values() for s in v]
    df = d.select(F.explode("grams").alias("term")).groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") >= 20).filter(~F.col("term").isin(*every))
    cats = d.withColumn("category", F.explode(F.filter(F.array(*(F.when(X.any_term(F.col("t"), v), F.lit(k)) for k, v in seeds.items())), lambda x: x.isNotNull())))
    n = cats.groupBy("category").agg(F.count("*").alias("n_seed"))
    co = cats.select("category", F.explode("grams").alias("term")).groupBy("category", "term").agg(F.count("*").alias("co"))
    s = co.join(df, "term").join(n, "category").withColumn("similarity", F.round(F.col("co") / F.sqrt(F.col("df").cast("double") * F.col("n_seed")), 9)).filter("similarity > 0.08")
    return top_per_group(s, ["category"], [F.desc("similarity"), F.desc("term")], 20).select("category", "term", "similarity")


def gram_frequency_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency of Han 2-grams to 4-grams, at least 20, the 200 most frequent (a top-k report)."""
    d = comments(spark, sf_dir).select(F.explode(X.ngrams(F.coalesce("text", F.lit("")), 2, 4)).alias("term"))
    return d.groupBy("term").agg(F.count("*").alias("df")).filter("df >= 20").orderBy(F.desc("df"), "term").limit(200)


def expanded_terms(texts: DataFrame, categories: dict[str, tuple[str, ...]], least: int = 20, top: int = 20) -> DataFrame:
    """``category``, ``term``, ``similarity``: Han 2-grams to 4-grams of the texts ``t`` that go with the category's terms.

    One aggregation counts a term's texts and those of each category among them.
    """
    d = texts.select("t", *(X.any_term(F.col("t"), v).cast("long").alias(f"in_{k}") for k, v in categories.items()))
    seeds = [s for v in categories.values() for s in v]
    co = d.select(F.explode(X.ngrams(F.col("t"), 2, 4)).alias("term"), *(f"in_{k}" for k in categories)).groupBy("term").agg(F.count("*").alias("df"), *(F.sum(f"in_{k}").alias(f"co_{k}") for k in categories))
    co = co.filter(F.col("df") >= least).filter(~F.col("term").isin(*seeds))
    n = d.agg(*(F.sum(f"in_{k}").alias(f"n_{k}") for k in categories))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("category"), F.col(f"co_{k}").alias("co"), F.col(f"n_{k}").alias("n_seed")) for k in categories)))
    s = co.crossJoin(F.broadcast(n)).select("term", "df", each.alias("x")).select("term", "df", "x.*").filter("co > 0")
    s = s.withColumn("similarity", F.round(F.col("co") / F.sqrt(F.col("df").cast("double") * F.col("n_seed")), 9)).filter("similarity > 0.08")
    return top_per_group(s, ["category"], [F.desc("similarity"), F.desc("term")], top).select("category", "term", "similarity")


def lexicon_expansion_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Han 2-grams to 4-grams that go with the lexicon's categories: co-occurrence over the root of both counts, the best 20 each."""
    return expanded_terms(comments(spark, sf_dir).select(F.coalesce("text", F.lit("")).alias("t")), L.CATEGORIES)


def mask_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments with links, mentions and topics after masking, and distinct masked texts."""
    t = X.mask_for_analysis(F.col("text"))
    d = comments(spark, sf_dir).select(t.alias("t"))
    return d.agg(F.count_if(F.contains("t", F.lit("<URL>"))).alias("n_links"), F.count_if(F.contains("t", F.lit("<MENTION>"))).alias("n_mentions"), F.count_if(F.contains("t", F.lit("<TOPIC:"))).alias("n_topics"), F.count_distinct("t").alias("n_texts"), F.sum(F.length("t")).alias("n_chars"))


def canonical_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments in the canonical columns, by header aliases."""
    from tallyloom.sources.ingest import canonical

    raw = table(spark, sf_dir, "comments").withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))
    return canonical(raw).distinct()


def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of NULLs of each column of the exported comments."""
    d = table(spark, sf_dir, "comment_rows")
    a = d.agg(F.count("*").alias("n"), *(F.count(c).alias(f"k_{c}") for c in d.columns))
    return a.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.round(1 - F.col(f"k_{c}") / F.col("n"), 9).alias("null_share")) for c in d.columns))).alias("x")).select("x.*")


_WS = SQL_SPACE
_CLEAN = "trim(regexp_replace(regexp_replace(text, '[\\x{FEFF}\\x{200B}\\x{200D}]', '', 'g'), '[" + _WS + "]+', ' ', 'g'))"


def _n(terms, t="text") -> str:
    return "(" + (" + ".join(f"(length({t}) - length(replace({t}, '{w}', ''))) // {len(w)}" for w in terms) or "0") + ")"


def _any(terms, t="text") -> str:
    return "(" + (" OR ".join(f"contains({t}, '{w}')" for w in terms) or "false") + ")"


def _sent(lex: L.Lexicon, t="text") -> str:
    turned = " + ".join(f"2 * ({_n([n + w for w in lex.negative], t)} - {_n([n + w for w in lex.positive], t)})" for n in lex.negators)
    raw = f"CAST({_n(lex.positive, t)} - {_n(lex.negative, t)} + {turned} AS DOUBLE)"
    return f"(CASE WHEN contains({t}, '!') OR contains({t}, '！') THEN {raw} * CAST(1.1 AS DOUBLE) ELSE {raw} END)"


def _stance(lex: L.Lexicon, t="text") -> str:
    return f"CAST({_n(lex.support, t)} - {_n(lex.oppose, t)} + CASE WHEN {_any(lex.target, t)} THEN {_n(lex.positive, t)} - {_n(lex.negative, t)} ELSE 0 END AS DOUBLE)"


_TAGS = "g AS (SELECT DISTINCT id, title, description, unnest(from_json(tags, '[\"VARCHAR\"]')) AS tag FROM v)"
_cats = {k: f"(CASE WHEN nn = 0 THEN 0.0::DOUBLE ELSE {_n(v)} / (sqrt(nn) * sqrt({len(v)}::DOUBLE)) END)" for k, v in L.CATEGORIES.items()}
_every = sorted({t for v in L.CATEGORIES.values() for t in v})
_norm = " + ".join(f"power({_n([t])}, 2)" for t in _every)
_strong = f"({_any(CURATION.strong, 't')} OR ({_any(CURATION.drug, 't')} AND {_any(CURATION.action, 't')}))"
_sq = "list_has_any(qs, [" + ", ".join(f"'{q}'" for q in CURATION.strong_queries) + "])"
_bq = "list_has_any(qs, [" + ", ".join(f"'{q}'" for q in CURATION.broad_queries) + "])"
_rung = f"CASE WHEN noise AND NOT (strong OR support OR (sq AND ctx)) THEN 1 WHEN strong THEN 2 WHEN support THEN 3 WHEN sq AND ctx THEN 4 WHEN sq THEN 5 WHEN bq THEN 6 ELSE 7 END"
_LADDER = f"""WITH {SQL_VIDEOS}, {_TAGS}, q AS (SELECT id, list(DISTINCT tag) AS qs FROM g GROUP BY 1),
    t AS (SELECT v.id, concat_ws(' ', nullif(trim(title), ''), nullif(trim(description), '')) AS t, coalesce(qs, []) AS qs FROM v LEFT JOIN q USING (id)),
    f AS (SELECT id, t, {_any(CURATION.noise, 't')} AS noise, {_strong} AS strong, {_any(CURATION.support, 't')} AS support, {_any(CURATION.context, 't')} AS ctx, {_sq} AS sq, {_bq} AS bq FROM t),
    d AS (SELECT id, {_rung} AS rung, noise, array_to_string(list_filter([{", ".join(f"'{w}'" for w in CURATION.noise)}], lambda x: contains(t, x)), '|') AS noise_terms FROM f),
    k AS (SELECT id, CASE WHEN rung IN (2, 3, 4) THEN CASE WHEN noise THEN 'review' ELSE 'keep' END ELSE 'drop' END AS decision, rung, noise_terms FROM d)"""
_GRAM = "list_distinct(flatten(list_transform(regexp_extract_all(coalesce(text, ''), '[\\x{{4E00}}-\\x{{9FFF}}]+'), lambda x: {parts})))"
_part = lambda n: f"(CASE WHEN length(x) >= {n} THEN list_transform(range(1, length(x) - {n} + 2), lambda i: substr(x, i, {n})) ELSE [] END)"
_GRAMS = _GRAM.format(parts=" || ".join(_part(n) for n in (2, 3, 4)))

ORACLE = {
    "video_anger_rollup": f"""WITH {SQL_COMMENTS}, {SQL_LABELS},
        k AS (SELECT CAST(record_id AS BIGINT) AS id, max(coalesce(adjudicated, CASE WHEN a = b THEN a END)) AS label FROM l WHERE record_table = 'comments' GROUP BY 1)
        SELECT video_id, count(*) AS n_comments, round(avg(CAST(label AS DOUBLE)), 9) AS anger_rate, round(avg(CAST(likes AS DOUBLE)), 9) AS mean_likes FROM c JOIN k USING (id) GROUP BY 1""",
    "anger_share_by_source": f"""WITH {SQL_COMMENTS}, {SQL_LABELS},
        k AS (SELECT CAST(record_id AS BIGINT) AS id, max(adjudicated) AS label FROM l WHERE record_table = 'comments' GROUP BY 1)
        SELECT source, count(*) AS n_comments, count(label) AS n_labelled, CAST(coalesce(sum(label), 0) AS BIGINT) AS n_angry,
               round(CASE WHEN count(label) = 0 THEN 0.0::DOUBLE ELSE coalesce(sum(label), 0)::DOUBLE / count(label) END, 9) AS anger_share FROM c LEFT JOIN k USING (id) GROUP BY 1""",
    "comment_count_by_video": f"WITH {SQL_COMMENTS}, {SQL_VIDEOS} SELECT v.id AS video_id, count(c.id) AS n_comments FROM v LEFT JOIN c ON c.video_id = v.id GROUP BY 1",
    "zero_comment_videos": "SELECT DISTINCT id FROM videos WHERE id NOT IN (SELECT video_id FROM comments WHERE video_id IS NOT NULL)",
    "zero_comment_having": f"WITH {SQL_VIDEOS} SELECT v.id FROM v LEFT JOIN comments c ON c.video_id = v.id AND c.level = 1 GROUP BY 1 HAVING count(c.id) = 0",
    "dedup_keep_first": f"WITH {SQL_COMMENTS} SELECT id, video_id FROM c WHERE trim(text) <> '' QUALIFY row_number() OVER (PARTITION BY trim(text) ORDER BY id) = 1",
    "dedup_per_video": f"WITH {SQL_COMMENTS} SELECT video_id, count(DISTINCT trim(text)) AS n_texts FROM c WHERE trim(text) <> '' GROUP BY 1",
    "stable_ids": f"WITH {SQL_COMMENTS} SELECT id, substr(md5('comments::' || id || '::' || coalesce(text, '')), 1, 16) AS stable_id FROM c",
    "symbol_only_comments": " UNION ALL ".join(
        f"SELECT '{t}.{c}' AS field, count(*) AS n_pieces, count(*) FILTER (regexp_matches(p, '^[\\p{{P}}\\p{{S}}\\p{{Z}}\\s]*$')) AS n_symbol_only FROM (SELECT {_CLEAN.replace('text', 'x')} AS p FROM (SELECT unnest(regexp_split_to_array({c}, '[\n.。!！?？]')) AS x FROM {t})) WHERE p <> '' HAVING count(*) > 0"
        for t, c in (("comments", "text"), ("comments", "author_name"), ("comment_rows", "text_raw"), ("comment_rows", "text_clean"), ("documents", "text"), ("text_records", "title"), ("text_records", "ocr_text"), ("text_records", "subtitle_text"), ("videos", "title"), ("videos", "description"), ("videos", "tags"), ("videos", "stats"))
    ),
    "clean_stats": f"""WITH {SQL_COMMENTS}, k AS (SELECT {_CLEAN} AS t FROM c), p AS (SELECT t, count(*) AS n, t IS NULL OR t = '' AS blank FROM k GROUP BY 1)
        SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(coalesce(sum(n) FILTER (blank), 0) AS BIGINT) AS n_blank, CAST(coalesce(sum(n) FILTER (NOT blank AND regexp_matches(t, '^[\\p{{P}}\\p{{S}}\\p{{Z}}\\s]*$')), 0) AS BIGINT) AS n_symbol_only,
               CAST(coalesce(sum(n - 1) FILTER (NOT blank), 0) AS BIGINT) AS n_repeated, count(*) FILTER (NOT blank) AS n_kept FROM p""",
    "sentiment_scores": f"""WITH {SQL_ROWS}, k AS (SELECT comment_row_id, round({_sent(L.DEFAULT)}, 6) AS sentiment_score, {_stance(L.DEFAULT)} AS stance_score, CAST({_any(L.DEFAULT.target)} AS INT) AS has_target FROM r)
        SELECT *, CASE WHEN sentiment_score > 0.5 THEN 'positive' WHEN sentiment_score < -0.5 THEN 'negative' ELSE 'neutral' END AS sentiment,
               CASE WHEN stance_score >= 1 THEN 'support' WHEN stance_score <= -1 THEN 'oppose' ELSE 'neutral' END AS stance FROM k""",
    "video_polarization": f"""WITH {SQL_ROWS}, k AS (SELECT video, level, {_sent(L.DEFAULT)} AS score, {_stance(L.DEFAULT)} AS st, {_any(L.DEFAULT.target)} AS hit FROM r WHERE video IS NOT NULL),
        a AS (SELECT video, count(*) AS total, count(*) FILTER (level = '1') AS level1, count(*) FILTER (level = '2') AS level2, count(*) FILTER (score > 0.5) AS positive, count(*) FILTER (score < -0.5) AS negative,
                     count(*) FILTER (st >= 1) AS support, count(*) FILTER (st <= -1) AS oppose, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS sd, round(avg(hit::INT::DOUBLE), 6) AS target_ratio FROM k GROUP BY 1)
        SELECT *, round((positive + negative)::DOUBLE / total, 6) AS non_neutral_ratio, round(CASE WHEN support + oppose = 0 THEN 0.0 ELSE abs(support - oppose)::DOUBLE / (support + oppose) END, 6) AS balance,
               round(CASE WHEN support + oppose = 0 THEN 0.0 ELSE 2 * least(support, oppose)::DOUBLE / (support + oppose) END, 6) AS confrontation FROM a""",
    "polarity_pairs": f"""WITH {SQL_ROWS}, m AS (SELECT comment_row_id, video, parent, trim(regexp_replace(regexp_replace(text, 'https?://\\S+|www\\.\\S+', ' <URL> ', 'g'), '\\s+', ' ', 'g')) AS text FROM r),
        k AS (SELECT comment_row_id, video, parent, CASE WHEN text = '' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE / (1.0::DOUBLE + exp(-{_sent(L.POLARITY)})) END AS p FROM m),
        i AS (SELECT k.*, abs(k.p - (SELECT avg(p) FROM k)) AS i, 1.0::DOUBLE - abs(q.p - k.p) AS tr FROM k LEFT JOIN k q ON q.comment_row_id = k.parent)
        SELECT video, count(*) AS total, round(avg(p), 6) AS polarity, round(avg(i), 6) AS intensity, round(stddev_pop(i), 6) AS intensity_sd, count(tr) AS n_pairs, round(coalesce(avg(tr), 0.0), 6) AS transmissibility FROM i GROUP BY 1""",
    "category_stance": f"""WITH {SQL_ROWS}, n AS (SELECT video, CAST(comment_row_id AS BIGINT) AS seq, text, CAST({_norm} AS DOUBLE) AS nn FROM r WHERE video IS NOT NULL),
        k AS (SELECT video, seq, {", ".join(f"{v} AS c_{c}" for c, v in _cats.items())} FROM n),
        t AS (SELECT *, greatest(c_state, c_freedom, c_populism) AS top, list_reverse_sort([c_state, c_freedom, c_populism]) AS o, c_state + c_freedom + c_populism AS total FROM k),
        e AS (SELECT *, CASE WHEN top < 0.05 THEN 'neutral' WHEN c_state = top THEN 'state' WHEN c_freedom = top THEN 'freedom' ELSE 'populism' END AS label, o[1] - o[2] AS gap,
                     CASE WHEN top < 0.05 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE + (c_state / total * ln(c_state / total + 1e-12) + c_freedom / total * ln(c_freedom / total + 1e-12) + c_populism / total * ln(c_populism / total + 1e-12)) / ln(3.0::DOUBLE) END AS pol FROM t),
        a AS (SELECT video, round(avg(c_state), 6) AS mean_state, round(avg(c_freedom), 6) AS mean_freedom, round(avg(c_populism), 6) AS mean_populism, round(avg(top), 6) AS mean_strength, round(avg(gap), 6) AS mean_gap, round(avg(pol), 6) AS mean_polarization FROM e GROUP BY 1),
        b AS (SELECT video, label AS top_label FROM (SELECT video, label, count(*) AS n, min(seq) AS f FROM e GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY video ORDER BY n DESC, f) = 1)
        SELECT * FROM a JOIN b USING (video)""",
    "comment_trees": f"""WITH {SQL_COMMENTS} SELECT p.id AS root_id, CAST(floor(q.id / 10000) AS BIGINT) AS piece, count(*) AS n_replies, string_agg(q.id::VARCHAR, ',' ORDER BY q.id) AS reply_ids
        FROM c q JOIN c p ON p.platform_comment_id = q.root_comment_platform_id AND p.level = 1 WHERE q.level = 2 GROUP BY 1, 2""",
    "orphan_replies": f"WITH {SQL_COMMENTS} SELECT id FROM c q WHERE level = 2 AND NOT EXISTS (SELECT 1 FROM c p WHERE p.level = 1 AND p.platform_comment_id = q.root_comment_platform_id)",
    "parent_levels": f"""WITH {SQL_COMMENTS} SELECT CASE q.level WHEN 1 THEN 'root' WHEN 2 THEN 'reply' ELSE q.level || '-level' END AS level_label,
        coalesce(CASE p.level WHEN 1 THEN 'root' WHEN 2 THEN 'reply' ELSE p.level || '-level' END, 'none') AS parent_label, count(*) AS n FROM c q LEFT JOIN c p ON p.id = q.parent_comment_id GROUP BY 1, 2""",
    "videos_by_tag": f"WITH {SQL_VIDEOS}, {_TAGS} SELECT id, platform_video_id FROM v WHERE id IN (SELECT id FROM g WHERE tag IN ('记录封存', '普法日记'))",
    "tag_sets": f"WITH {SQL_VIDEOS}, {_TAGS}, a AS (SELECT id, string_agg(tag, '|' ORDER BY tag) AS s, count(*) AS n FROM g GROUP BY 1) SELECT v.id, coalesce(s, '') AS tag_set, CAST(coalesce(n, 0) AS INT) AS n_tags FROM v LEFT JOIN a USING (id)",
    "curation_ladder": _LADDER + " SELECT * FROM k",
    "curation_counts": _LADDER + " SELECT decision, count(*) AS n FROM k GROUP BY 1",
    "time_range_null_pass": f"WITH {SQL_VIDEOS} SELECT id FROM v WHERE published_at IS NULL OR epoch_us(published_at) BETWEEN 1756684800000000 AND 1767225599000000",
    "gram_frequency": f"WITH {SQL_COMMENTS}, g AS (SELECT unnest({_GRAM.format(parts=_part(2) + ' || ' + _part(3))}) AS term FROM c) SELECT term, count(*) AS df FROM g GROUP BY 1 HAVING count(*) >= 20 ORDER BY df DESC, term LIMIT 200",
    "lexicon_expansion": f"""WITH {SQL_COMMENTS}, d AS (SELECT id, coalesce(text, '') AS t, {_GRAM.format(parts=_part(2))} AS grams FROM c),
        df AS (SELECT term, count(*) AS df FROM (SELECT unnest(grams) AS term FROM d) GROUP BY 1 HAVING count(*) >= 20),
        k AS (SELECT 'law' AS category, grams FROM d WHERE {_any(("法律", "条文", "封存"), "t")} UNION ALL SELECT 'public', grams FROM d WHERE {_any(("评论区", "网上", "大家"), "t")}),
        n AS (SELECT category, count(*) AS n FROM k GROUP BY 1), co AS (SELECT category, term, count(*) AS co FROM (SELECT category, unnest(grams) AS term FROM k) GROUP BY 1, 2),
        s AS (SELECT category, term, round(co / sqrt(df::DOUBLE * n), 9) AS similarity FROM co JOIN df USING (term) JOIN n USING (category) WHERE term NOT IN ('法律', '条文', '封存', '评论区', '网上', '大家'))
        SELECT * FROM s WHERE similarity > 0.08 QUALIFY row_number() OVER (PARTITION BY category ORDER BY similarity DESC, term DESC) <= 20""",
    "gram_frequency_whole": f"WITH {SQL_COMMENTS}, g AS (SELECT unnest({_GRAMS}) AS term FROM c) SELECT term, count(*) AS df FROM g GROUP BY 1 HAVING count(*) >= 20 ORDER BY df DESC, term LIMIT 200",
    "lexicon_expansion_whole": f"""WITH {SQL_COMMENTS}, d AS (SELECT id, coalesce(text, '') AS t, {_GRAMS} AS grams FROM c),
        df AS (SELECT term, count(*) AS df FROM (SELECT unnest(grams) AS term FROM d) GROUP BY 1 HAVING count(*) >= 20),
        k AS ({" UNION ALL ".join(f"SELECT '{k}' AS category, grams FROM d WHERE {_any(v, 't')}" for k, v in L.CATEGORIES.items())}),
        n AS (SELECT category, count(*) AS n FROM k GROUP BY 1), co AS (SELECT category, term, count(*) AS co FROM (SELECT category, unnest(grams) AS term FROM k) GROUP BY 1, 2),
        s AS (SELECT category, term, round(co / sqrt(df::DOUBLE * n), 9) AS similarity FROM co JOIN df USING (term) JOIN n USING (category) WHERE term NOT IN ({", ".join(f"'{t}'" for t in _every)}))
        SELECT * FROM s WHERE similarity > 0.08 QUALIFY row_number() OVER (PARTITION BY category ORDER BY similarity DESC, term DESC) <= 20""",
    "mask_counts": f"""WITH {SQL_COMMENTS}, u AS (SELECT regexp_replace(coalesce(text, ''), '(?i)https?://[^{_WS}]+|www\\.[^{_WS}]+', ' <URL> ', 'g') AS t FROM c),
        m AS (SELECT regexp_replace(t, '@[A-Za-z0-9_\\-\\x{{4E00}}-\\x{{9FFF}}]+', ' <MENTION> ', 'g') AS t FROM u),
        k AS (SELECT trim(regexp_replace(regexp_replace(t, '#([^#{_WS}]+)#?', ' <TOPIC:\\1> ', 'g'), '[{_WS}]+', ' ', 'g')) AS t FROM m)
        SELECT count(*) FILTER (contains(t, '<URL>')) AS n_links, count(*) FILTER (contains(t, '<MENTION>')) AS n_mentions, count(*) FILTER (contains(t, '<TOPIC:')) AS n_topics, count(DISTINCT t) AS n_texts, CAST(sum(length(t)) AS BIGINT) AS n_chars FROM k""",
    "canonical_projection": f"""SELECT DISTINCT id::VARCHAR AS id, text AS raw_text, {_CLEAN} AS clean_text, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS time, CAST(NULL AS VARCHAR) AS post_id,
        video_id::VARCHAR AS video_id, CAST(NULL AS VARCHAR) AS user_id, CAST(NULL AS VARCHAR) AS parent_id, like_count::DOUBLE AS likes FROM comments""",
    "missing_fields": "SELECT unnest([" + ", ".join(f"{{'field': '{c}', 'null_share': round(1 - count({c})::DOUBLE / count(*), 9)}}" for c in ("comment_row_id", "video_id", "platform_video_id", "parent_comment_id", "level", "text_raw", "text_clean", "exported_at")) + "], recursive := true) FROM comment_rows",
}
QUERIES = {f.__name__: f for f in (video_anger_rollup, anger_share_by_source, comment_count_by_video, zero_comment_videos, zero_comment_having, clean_stats, dedup_keep_first, dedup_per_video, stable_ids, symbol_only_comments, sentiment_scores, video_polarization, polarity_pairs, category_stance, comment_trees, orphan_replies, parent_levels, videos_by_tag, tag_sets, curation_ladder, curation_counts, time_range_null_pass, gram_frequency, gram_frequency_whole, lexicon_expansion, lexicon_expansion_whole, mask_counts, canonical_projection, missing_fields)}
