"""Connectors, sinks and bookkeeping on small cases."""

import json
import sqlite3
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import records as C
from tallyloom.functions import text as X
from tallyloom.operators import jobs as J
from tallyloom.operators import rollups as R
from tallyloom.operators import sampling as P
from tallyloom.operators import stats as T
from tallyloom.sources import ingest, sheets, sinks, tables


def test_sheets_round_trip(spark, tmp_path):
    rows = [("1", "真是 <气> & 死", 2.5), ("2", None, None), ("3", "a\nb", 7.0)]
    df = spark.createDataFrame(rows, "id string, text string, n double").coalesce(1)
    sheets.write_sheets(df, str(tmp_path / "out"), ["id"], rows=2)
    books = sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: r.name)
    assert [r.name for r in books] == ["00000.xlsx", "00001.xlsx"]
    (tmp_path / "in").mkdir()
    for r in books:
        (tmp_path / "in" / r.name).write_bytes(r.content)
    got = sheets.read_sheets(spark, str(tmp_path / "in"), ["id", "text", "n", "missing"]).orderBy("id").collect()
    assert [(r.id, r.text, r.n, r.missing, r.row_index) for r in got] == [("1", "真是 <气> & 死", "2.5", None, 1), ("2", None, None, None, 2), ("3", "a\nb", "7.0", None, 1)]
    assert ingest.read_any(spark, str(tmp_path / "in" / "00000.xlsx")).columns == ["id", "text", "n"]
    with pytest.raises(ValueError):
        ingest.read_any(spark, "x.xls")


def test_shared_strings_are_read(tmp_path):
    path = tmp_path / "s.xlsx"
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><t>id</t></si><si><r><t>te</t></r><r><t>xt</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row></sheetData></worksheet>')
    assert sheets.sheet_rows(path.read_bytes()) == [["id", None, "text"]]


def test_sqlite_by_ranges(spark, tmp_path):
    path = tmp_path / "t.db"
    con = sqlite3.connect(path)
    con.execute("PRAGMA journal_mode = WAL")
    con.execute("CREATE TABLE v (id INTEGER PRIMARY KEY, name TEXT, n REAL)")
    con.execute("CREATE TABLE none (id INTEGER)")
    con.executemany("INSERT INTO v VALUES (?, ?, ?)", [(i, None if i % 7 == 0 else f"名{i}", i / 2) for i in range(3, 500, 2)])
    con.commit()
    con.close()
    df = tables.read_sqlite(spark, str(path), "v", "id long, name string, n double", parts=5)
    assert df.count() == 249 and df.filter("name is null").count() == len([i for i in range(3, 500, 2) if i % 7 == 0])
    assert df.filter("id = 9").first().name == "名9"
    assert tables.read_sqlite(spark, str(path), "none", "id long").count() == 0


def test_rows_wanted_and_ids(spark):
    df = spark.createDataFrame([("1", "a", 1), ("0", "b", 2), (None, " ", 3), ("1", None, 4), (None, "c", 5)], "remove string, id string, row_index int")
    assert [r.id for r in ingest.wanted_rows(df, "id").orderBy("row_index").collect()] == ["b", "c"]
    assert ingest.wanted_rows(df.drop("remove"), "id").count() == 3
    assert [r.id for r in ingest.with_auto_ids(df, "id").orderBy("row_index").collect()] == ["a", "b", "auto_3", "auto_4", "c"]


def test_json_or_csv(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "a.csv").write_text("id,name\n1,x\n", "utf-8")
    (tmp_path / "json" / "deep").mkdir(parents=True)
    got = lambda: [tuple(r) for r in ingest.json_or_csv(spark, str(tmp_path / "json"), str(tmp_path / "csv"), "id", ["id", "name"]).collect()]
    assert got() == [("1", "x")]
    (tmp_path / "json" / "deep" / "b.json").write_text(json.dumps({"id": "9", "name": "y"}))
    assert got() == [("9", "y")]


def test_both_forms_and_decisions(spark, tmp_path):
    df = spark.createDataFrame([("a", "keep", [1, 2]), ("b", "drop", None), ("c", "keep", [])], "id string, decision string, tags array<int>")
    sinks.write_both(df, str(tmp_path / "both"))
    text = "".join(p.read_text("utf-8") for p in (tmp_path / "both" / "csv").glob("part*.csv"))
    assert "decision,id,tags" in text and "[1,2]" in text and text.startswith("﻿")
    assert spark.read.parquet(str(tmp_path / "both" / "parquet")).count() == 3
    sinks.write_decided(df.drop("tags"), "decision", str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d" / "summary")).select("counts.keep", "counts.drop").first() == (2, 1)
    assert sorted(p.name for p in (tmp_path / "d" / "by_decision").glob("decision=*")) == ["decision=drop", "decision=keep"]
    sinks.write_csv(spark.createDataFrame([()], ""), str(tmp_path / "e"))
    assert any("empty" in p.read_text() for p in (tmp_path / "e").glob("part*.csv"))
    sinks.write_nested(spark.range(25).select(F.lit("k").alias("k"), "id"), "k", str(tmp_path / "n"), "id", 10)
    assert sorted((r.piece, len(r["items"])) for r in spark.read.json(str(tmp_path / "n")).collect()) == [(0, 10), (1, 10), (2, 5)]
    sinks.point_to_run(spark, str(tmp_path), "run_7", {"n": 3})
    assert spark.read.json(str(tmp_path / "latest_run")).first().run == "run_7"


def _odd(v):
    if v == 5:
        time.sleep(30)
    if v % 2 == 0:
        raise ValueError(f"even {v}")
    return v * 10


def test_items_fail_alone(spark, tmp_path):
    out = J.isolated(spark.range(6).select("id", F.col("id").alias("v")), _odd, "id", "v", 0.5)
    good = sinks.write_failures(out, "id", str(tmp_path / "bad"))
    assert sorted((r.id, r.result) for r in good.collect()) == [("1", "10"), ("3", "30")]
    bad = spark.read.parquet(str(tmp_path / "bad"))
    assert sorted((r.item_id, r.error_type, r.message) for r in bad.collect()) == [*((str(i), "ValueError", f"even {i}") for i in (0, 2, 4)), ("5", "TimeoutError", "longer than 0.5 s")]
    one, two = spark.createDataFrame([(3, 9)], "n int, newest int"), spark.createDataFrame([(4, 9)], "n int, newest int")
    assert [J.snapshot_due(a, one, at, 0, 60) for a, at in ((one, 100), (two, 30), (two, 60))] == [False, False, True]


def test_cooldown(spark):
    # resource a: three failures at 0, 10, 20 s: it cools down until 320 s; a success resets
    rows = [("a", 1, 0.0, 1), ("a", 2, 10.0, 1), ("a", 3, 20.0, 1), ("a", 4, 100.0, 1), ("a", 5, 500.0, 0), ("a", 6, 510.0, 1), ("b", 7, 0.0, None)]
    got = {r.i: (r.failure_count, r.cooldown_until, r.available) for r in J.with_cooldown(spark.createDataFrame(rows, "k string, i int, at double, f int"), "k", "i", "at", "f").collect()}
    assert got == {1: (1, None, True), 2: (2, None, True), 3: (3, 320.0, True), 4: (4, 400.0, False), 5: (0, None, True), 6: (1, None, True), 7: (0, None, True)}


def test_guard_turns_and_waits(spark):
    pages = spark.createDataFrame([("v", 1, "a"), ("v", 2, "b"), ("v", 3, "a"), ("v", 4, "c"), ("w", 5, None), ("w", 6, None)], "k string, i int, c string")
    assert sorted(r.i for r in J.until_repeated(pages, "k", "i", "c").collect()) == [1, 2, 5, 6]
    three = spark.createDataFrame([(10,), (20,), (30,)], "id int")
    assert [(r.cursor, r.id) for r in J.in_turn(three, "id", range(4)).orderBy("cursor").collect()] == [(0, 10), (1, 20), (2, 30), (3, 10)]
    assert J.in_turn(three.limit(0), "id", range(2)).count() == 0
    files = spark.createDataFrame([("d", "a.jpg"), ("d", "._a.jpg"), ("e", "._x")], "d string, n string")
    assert [tuple(r) for r in J.listing_counts(files, "d", "n").collect()] == [("d", 1)]


def test_payload_lists_and_pages(spark):
    raw = ['{"video": {"play_addr": {"url_list": [null, "x", "http://a"]}}}', '{"video": {"download_addr": {"url_list": ["http://b"]}}}', '{"video": {"bit_rate": [{}, {"play_addr": {"url_list": ["http://c"]}}]}}', "not json", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    assert [r.u for r in df.orderBy("i").select(C.picked_url(F.col("raw"), F.lit("http://own")).alias("u")).collect()] == ["http://a", "http://b", "http://c", "http://own", "http://own"]
    page = '{"data": [{"aweme_info": {"aweme_id": "1"}}, {"aweme_mix_info": {"mix_items": [{"aweme_id": "2"}, {"aweme_id": "3"}]}}, {"x": 1}, {"aweme_info": {}}]}'
    got = C.flat_pages(spark.createDataFrame([(1, page), (2, None), (3, '{"data": []}')], "p int, payload string"), "payload").collect()
    assert [(r.p, json.loads(r.record)["aweme_id"]) for r in got] == [(1, "1"), (1, "2")]


def test_merged_lines_and_boxes(spark):
    df = spark.createDataFrame([("甲\n乙", "乙\n　丙 "), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(X.merged_lines(F.col("a"), F.col("b"))).collect()] == ["甲\n乙\n丙", ""]
    d = spark.createDataFrame([("g", float(v)) for v in (1, 2, 3, 4, 100)] + [("h", None)], "g string, v double")
    assert [tuple(r) for r in R.box_numbers(d, "g", "v").collect()] == [("g", 1.0, 2.0, 3.0, 4.0, 100.0, 1)]


def test_quantiles_by_group_and_without_rows(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    values = {g: np.round(rng.gamma(2, 50, n), k) for g, n, k in (("a", 400, 0), ("b", 7, 3), ("c", 1, 1))}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [("d", None)]
    ps = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.q for r in T.quantiles(df, "v", ps, ["g"], buckets=8).collect()}
    assert set(got) == set("abc")
    for g, vs in values.items():
        assert np.allclose(got[g], np.quantile(vs, ps))
    whole = T.quantiles(df, "v", ps).first().q
    assert np.allclose(whole, np.quantile(np.concatenate(list(values.values())), ps))
    assert T.quantiles(df.limit(0), "v", ps).count() == 0


def test_annotation_sample_takes_quotas_or_all(spark):
    df = spark.range(300).select("id", (F.col("id") % 3).cast("string").alias("v"), F.lit(None).cast("string").alias("m"), (F.col("id") % 40).alias("n"))
    got = P.annotation_sample(df, "v", "m", "n", "id", 50)
    assert got.count() == 50 and {r.stratum.split("|")[1] for r in got.collect()} == {"MISSING"}
    assert P.annotation_sample(df, "v", "m", "n", "id", 500).count() == 300
