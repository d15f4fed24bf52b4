"""Scalars and scores on the known vectors."""

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import lexicon as L
from tallyloom.functions import text as X


def _one(spark, expr, *values, schema="t string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(expr).collect()]


def test_sentiment_vectors(spark):
    texts = ["我支持前科封存，应该给改过自新的人一次机会！", "反对封存，这就是纵容，必须严惩，零容忍。", "今天天气不错，晚饭吃什么？", "不支持", "并不支持", "不同意", "", None]
    got = _one(spark, F.round(L.sentiment_score(F.col("t")), 6), *texts)
    assert got[:7] == [3.3, -4, 0, -1, -3, -2, 0] and got[7] is None
    assert _one(spark, L.stance_score(F.col("t")), *texts[:5]) == [4, -7, 0, 0, 0]
    assert _one(spark, L.stance_label(L.stance_score(F.col("t"))), *texts[:3]) == ["support", "oppose", "neutral"]
    p = _one(spark, L.polarity(F.col("t")), "支持,合理,有必要", "")
    assert p[0] == pytest.approx(0.952574, abs=1e-6) and p[1] == 0.5


def test_stance_vectors(spark):
    df = spark.createDataFrame([(0.8, 0.2, 0.1), (0.01, 0.01, 0.01), (0.1, 0.7, 0.2), (0.1, 0.2, 0.7)], "state double, freedom double, populism double")
    r = [x[0] for x in df.select(L.stance_of({c: F.col(c) for c in df.columns})).collect()]
    assert [x.label for x in r] == ["state", "neutral", "freedom", "populism"]
    assert r[0].gap == pytest.approx(0.6) and r[0].polarization == pytest.approx(0.308630, abs=1e-6) and r[1].polarization == 0


def test_cleaning(spark):
    assert _one(spark, X.clean(F.col("t")), "﻿ a　b​c\n d ", "   ", None) == ["a bc d", "", None]
    assert _one(spark, X.compare_key(F.col("t")), "你好，World_1!") == ["你好world1"]
    assert _one(spark, X.symbol_only(F.col("t")), "！！😂", "哈", "[笑哭]") == [True, False, False]
    assert _one(spark, X.mask_for_analysis(F.col("t")), "看 https://x.y/z @某人 #话题# 完", None) == ["看 <URL> <MENTION> <TOPIC:话题> 完", ""]
    assert _one(spark, X.clean_block(F.col("t")), "a\t b\n\n\n\nc", "nan") == ["a b\n\nc", ""]


def test_labels_and_ids(spark):
    assert _one(spark, X.binary_label(F.col("t")), "愤怒", "是", "Yes", "1", "t", "pos", "Positive", "否", "n", "0", "f", "NEG", "non_anger", "nonanger", "2", "maybe", "0.5", "1.0", None) == [1] * 7 + [0] * 7 + [None] * 5
    assert _one(spark, X.stable_id(F.lit("f.csv"), F.lit(1), F.col("t")), "你好") == ["a3888a6517539771"]
    assert _one(spark, X.level_label(F.col("t")), 1, 2, 3, schema="t int") == ["root", "reply", "3-level"]
    assert _one(spark, X.prefix_source(F.col("t"), ("monosans", "manual")), "monosans_http_x", "manual_1", "foo_bar") == ["monosans", "manual", "foo"]
    assert _one(spark, X.closed_label(F.col("t"), ("支持",), {"赞成": "支持"}), " 支　持", "赞成", "x") == ["支持", "支持", None]


def test_lines_sections_grams(spark):
    assert _one(spark, X.dedup_lines(F.col("t")), "a\nA!\n\nb", "", None) == ["a\nb", "", ""]
    assert _one(spark, X.compose_sections([("x", F.col("t")), ("y", F.lower("t")), ("z", F.lit("k"))]), "Ab") == ["【x】\nAb\n\n【z】\nk"]
    assert sorted(_one(spark, X.ngrams(F.col("t"), 2, 3), "我爱你a好")[0]) == ["我爱", "我爱你", "爱你"]


def test_json_and_urls(spark):
    assert _one(spark, X.recover_json(F.col("t")), 'x [1,2] y', '{"a":1}', "no") == ["[1,2]", '{"a":1}', None]
    u = _one(spark, X.url_parts(F.col("t")), "http://a.b:80/c?d=1", "a.b/c")
    assert (u[0].host, u[0].port, u[0].query, u[1].host, u[1].scheme) == ("a.b", 80, "d=1", "a.b", "http")


def test_curation_ladder(spark):
    t = L.CurationTerms(strong=("吸毒记录",), support=("记录封存",), context=("封存",), noise=("校园霸凌", "犯罪记录封存"), strong_queries=("q1",), broad_queries=("q2",))
    rows = [("吸毒记录 说明", []), ("吸毒记录 校园霸凌", []), ("犯罪记录封存", []), ("校园霸凌", []), ("封存", ["q1"]), ("x", ["q1"]), ("x", ["q2"]), ("x", [])]
    df = spark.createDataFrame(rows, "t string, q array<string>")
    got = [(r[0].decision, r[0].rung) for r in df.select(L.curation(F.col("t"), F.col("q"), t)).collect()]
    assert got == [("keep", 2), ("review", 2), ("review", 3), ("drop", 1), ("keep", 4), ("drop", 5), ("drop", 6), ("drop", 7)]
