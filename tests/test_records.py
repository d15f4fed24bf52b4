"""Single-record functions and job bookkeeping."""

import json

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import records as C
from tallyloom.operators import jobs as J
from tallyloom.plans import record_queries
from tallyloom.sources import sinks


def _one(spark, expr, *values, schema="t string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(expr).collect()]


def test_settings(spark):
    assert _one(spark, C.optional_bool(F.col("t")), " Yes", "off", "x", None) == [True, False, None, None]
    assert _one(spark, C.optional_int(F.col("t")), "3", "0", "-1", "a", None) == [3, None, None, None, None]
    assert C.alias_map({" a ": "b　c", "": "x"}) == {"a": "bc"} and C.alias_map(None) == {}


def test_times(spark):
    s = lambda e: F.unix_seconds(e)
    assert _one(spark, s(C.local_time(F.col("t"))), "2025-01-01 08:00:00", "2025/01/01 08:00", "2025/01/01", "bad", None) == [1735689600, 1735689600, 1735660800, None, None]
    assert _one(spark, s(C.iso_time(F.col("t"))), "2025-01-01T00:00:00Z", "2025-01-01T08:00:00+08:00", "2025-01-01", "2025-01-01T00:00:00", "x", None) == [1735689600] * 4 + [None] * 2
    r = _one(spark, C.time_range(F.col("t")), "2025-01-01:", ":2025-01-02", "2025-01-01")
    assert [(x.start is None, x.end is None) for x in r] == [(False, True), (True, False), (False, True)]
    assert _one(spark, s(C.epoch_time(F.col("t"))), 0, 5, None, schema="t long") == [None, 5, None]
    assert _one(spark, C.millis_to_seconds(F.col("t")), 1234, schema="t long") == [1.234]


def test_json(spark):
    assert _one(spark, C.json_cues(F.col("t"), "$.c"), '{"c":[" a ","","b","c","d"]}', "{}", None) == [["a", "b", "c"], [], []]
    assert _one(spark, F.size(C.envelope_items(F.col("t"))), "[1,2]", '{"results":[1]}', '{"data":[1,2,3]}') == [2, 1, 3]
    assert _one(spark, C.message_text(F.col("t")), '{"choices":[{"message":{"content":" hi "}}]}', '{"choices":[{"message":{"content":[{"type":"text","text":"a"},{"text":"b"}]}}]}', "{}") == ["hi", "a\nb", None]
    assert _one(spark, C.shares_json(F.array(F.lit("a"), F.lit("b")), F.array(F.lit(0.2), F.lit(0.8))), "x") == ['{"b":0.8,"a":0.2}']
    assert _one(spark, C.resolved_path(F.col("t"), [("/r", F.lit(False)), ("/s", F.lit(True))]), "/abs", "p") == ["/abs", "/s/p"]


def test_jobs(spark):
    items = spark.createDataFrame([(1,), (2,)], "k int")
    res = spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(Exception, match="no result for 2"):
        J.realigned(items, res, "k").collect()
    assert [r.k for r in J.pending(items, res, ["k"]).collect()] == [2]
    assert J.pending(items, res, ["k"], overwrite=True).count() == 2
    both = J.with_fallback(res, spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), ["k"]).collect()
    assert {(r.k, r.v) for r in both} == {(1, "a"), (2, "y")}
    jobs = spark.createDataFrame([(1, '{"video_ids":["a","b"],"force":false}'), (2, '{"video_ids":["b"],"force":true}'), (3, '{"video_ids":["a","b"]}')], "id int, requested string")
    assert J.matching_job(jobs, ["a", "b"], False).first().id == 3
    left = iter([5, 3, 3])
    assert J.until_stable(lambda i: next(left)) == 3


def _documents(spark, rows, folder) -> str:
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(folder / "documents.parquet"))
    return str(folder)


def test_report_holds_the_texts(spark, tmp_path):
    a = _documents(spark, [(2, "乙\n二", "s"), (1, "甲", "s"), (600, "丙", "s"), (1, "甲", "s"), (3, None, "s")], tmp_path / "a")
    b = _documents(spark, [(2, "丁\n二", "s"), (1, "甲", "s"), (600, "丙", "s")], tmp_path / "b")
    got = {r.block: (r.n_documents, r.report) for r in record_queries.report_texts(spark, a).collect()}
    assert got == {0: (2, "## 1\n\n甲\n\n---\n\n## 2\n\n乙\n二\n\n---\n"), 1: (1, "## 600\n\n丙\n\n---\n")}
    assert got[0] != {r.block: (r.n_documents, r.report) for r in record_queries.report_texts(spark, b).collect()}[0]
    sinks.write_merged(record_queries.report_texts(spark, a), ["source", "block"], "report", str(tmp_path / "r"))
    assert "".join(f.read_text() for f in sorted((tmp_path / "r").glob("part-*"))) == got[0][1] + "\n" + got[1][1] + "\n"


def test_bundle_of_three_formats(spark, tmp_path):
    rows = [("v1", "  全文 ", "a.wav", [(0.0, 1.5, " 句 ")], None, "题", None), ("v2", None, None, [], '{"x": 1}', None, "丁")]
    df = spark.createDataFrame(rows, "id string, text string, audio_path string, segments array<struct<start double, end double, text string>>, raw_result string, title string, author string")
    sinks.write_bundles(df, "id", {"author": "作者", "title": "标题"}, str(tmp_path / "o"))
    read = lambda kind, k: next((tmp_path / "o" / kind / f"id={k}").glob("part-*")).read_text()
    assert read("txt", "v1") == "全文\n" and read("txt", "v2") == "\n"
    assert read("md", "v1") == "# 视频文本提取结果\n\n- 作者：\n- 标题：题\n\n## 全文\n\n全文\n\n## 音频路径\n\na.wav\n\n## 分段\n\n1. [0.0 - 1.5] 句\n"
    assert read("md", "v2") == '# 视频文本提取结果\n\n- 作者：丁\n- 标题：\n\n## 全文\n\n\n\n## 原始结果\n\n```json\n{"x": 1}\n```\n'
    one = json.loads(read("json", "v1"))
    assert one["text"] == "  全文 " and one["metadata"] == {"author": None, "title": "题"} and one["segments"] == [{"start": 0.0, "end": 1.5, "text": " 句 "}]
