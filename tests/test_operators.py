"""Sequences, samples, tables, statistics, sources and streams."""

import json
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import rollups as R
from tallyloom.operators import sampling as P
from tallyloom.operators import sequences as S
from tallyloom.operators import stats as T
from tallyloom.plans.comment_queries import expanded_terms
from tallyloom.operators import pictures
from tallyloom.plans.timeline_queries import fuzzy_chunks
from tallyloom.sources import ingest, sinks
from tallyloom.streaming import streams


def test_adjacent_segments(spark):
    df = spark.createDataFrame([(0, "0f"), (1, "0e"), (2, "ff"), (3, None)], "i int, h string").withColumns({"g": F.lit(1), "p": S.hash_bits(F.lpad("h", 16, "0"))})
    got = S.adjacent_segments(df, ["g"], ["i"], "p", 1).groupBy("segment").count().orderBy("segment").collect()
    assert [r["count"] for r in got] == [2, 1, 1]
    assert spark.range(1).select(S.hamming(S.hash_bits(F.lit("0xFFFFFFFFFFFFFFFF")), S.hash_bits(F.lit("8000000000000001")))).first()[0] == 62


def test_timeline_blocks(spark):
    v1 = [(0, 1, "A"), (1, 2, "A"), (2.2, 3, "A"), (3.5, 4, "A"), (4, 5, "B")]
    v2 = [(0, 10, "A"), (1, 2, "A"), (5, 6, "A")]
    rows = [(v, float(a), float(b), k) for v, x in (("v1", v1), ("v2", v2)) for a, b, k in x]
    df = spark.createDataFrame(rows, "v string, s double, e double, l string").withColumn("d", F.col("e") - F.col("s"))
    got = S.timeline_blocks(df, ["v"], ["s", "e"], ["l"], "s", "e", "d").orderBy("v", "block_index").collect()
    assert [(r.v, r.start_time, r.end_time, r.slice_count) for r in got] == [("v1", 0, 3, 3), ("v1", 3.5, 4, 1), ("v1", 4, 5, 1), ("v2", 0, 10, 3)]
    assert got[0].duration_seconds == pytest.approx(2.8) and got[3].duration_seconds == 12
    assert S.timeline_blocks(df.limit(0), ["v"], ["s", "e"], ["l"], "s", "e", "d").count() == 0


def test_sequences_do_not_depend_on_their_blocks(spark):
    rng = random.Random(6)
    rows, at = [], 0.0
    for i in range(200):
        at += rng.choice([0.0, 0.1, 0.5, 1.0])
        rows.append((rng.choice("vw"), i if rng.random() < 0.9 else i + 1000, at, at + rng.choice([0.1, 1.0, 4.0]), rng.choice("AB"), rng.choice([None, 1, 3, 7, 1 << 40])))
    df = spark.createDataFrame(rows, "v string, i int, s double, e double, a string, h long").withColumn("d", F.col("e") - F.col("s"))
    seg = lambda block: sorted((r.v, r.i, r.segment) for r in S.adjacent_segments(df, ["v"], ["i"], "h", 2, block).collect())
    tl = lambda block: sorted(tuple(r) for r in S.timeline_blocks(df, ["v"], ["i"], ["a"], "s", "e", "d", 0.2, block).drop("duration_seconds").collect())
    assert seg(3) == seg(64) == seg(10**6) and tl(3) == tl(50) == tl(10**6)
    # a plain loop
    want = []
    for v in "vw":
        last, n = None, 0
        for r in sorted((r for r in rows if r[0] == v), key=lambda r: r[1]):
            n += last is None or r[5] is None or (last ^ r[5]).bit_count() > 2
            last = r[5]
            want.append((v, r[1], n))
    assert seg(7) == sorted(want)


def test_breaker(spark):
    df = spark.createDataFrame([("u", i, f) for i, f in enumerate([1, 1, 1, 0, 1])], "u string, i int, f int")
    got = S.breaker_states(df, "u", ["i"], F.col("f") == 1).orderBy("i").collect()
    assert [(r.failure_count, r.is_open) for r in got] == [(1, 0), (2, 0), (3, 1), (0, 0), (1, 0)]


def test_largest_remainder_and_split(spark):
    df = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "k string, n long")
    assert {r.k: r.quota for r in P.largest_remainder(df, "k", "n", 4).collect()} == {"a": 2, "b": 1, "c": 1}
    rows = spark.range(100).select("id", (F.col("id") % 2).alias("y"))
    counts = {(r.y, r.split): r["count"] for r in P.stratified_split(rows, "y", "id").groupBy("y", "split").count().collect()}
    assert counts == {(y, s): n for y in (0, 1) for s, n in (("train", 40), ("valid", 5), ("test", 5))}
    with pytest.raises(ValueError):
        P.stratified_split(rows, "y", "id", (0.5, 0.1, 0.1))


def test_split_needs_a_row_for_each_part(spark):
    df = spark.createDataFrame([(i, i % 40 == 0) for i in range(80)], "i int, y boolean")
    with pytest.raises(Exception, match="too few rows of label true"):
        P.stratified_split(df, "y", "i").collect()
    assert P.stratified_split(df, "y", "i", least=2).filter("split = 'train'").count() == 64


def test_quantile_bins_match_qcut(spark):
    x = [1, 1, 1, 1, 2, 3, 4, 5, 6, 7, 8, 8, 9]
    got = [r.bin for r in P.quantile_bins(spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, v int"), "v").orderBy("i").collect()]
    assert got == pd.qcut(pd.Series(x), 5, duplicates="drop", labels=False).tolist()


def test_kappa(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (None, 1)], "a int, b int")
    m = R.binary_metrics(df, "a", "b").first()
    assert (m.kappa, m.tn, m.fp, m.fn, m.tp) == (0.5, 2, 0, 1, 1)


def test_golden_chi_square(spark):
    n = [31, 20, 17, 20, 134, 45, 27, 115, 52]
    rows = [(f"r{i // 3}", f"c{i % 3}", k) for i, k in enumerate(n)]
    df = spark.createDataFrame(rows, "a string, b string, k int").withColumn("x", F.explode(F.array_repeat(F.lit(1), F.col("k"))))
    r = T.chi_square(R.crosstab(df, F.col("a"), F.col("b"))).first()
    assert (r.statistic, r.df, r.cramers_v) == (pytest.approx(52.856836, abs=1e-6), 4, pytest.approx(0.239434, abs=1e-6))
    assert r.p_value == pytest.approx(9.1302939e-11, rel=1e-6)
    assert T.f_p(20.6315081704, 2, 465) == pytest.approx(2.6022e-09, rel=1e-4)
    assert T.t_quantile(0.975, 462) == pytest.approx(1.96511, abs=1e-4)


def test_mid_ranks(spark):
    x = [3, 1, 1, 2, 2, 2, None]
    got = {r.v: r.mid_rank for r in T.mid_ranks(spark.createDataFrame([(v,) for v in x], "v int"), "v").collect()}
    assert got == {1: 1.5, 2: 4.0, 3: 6.0}


def test_ols_hc3_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    y = 1 + x @ [2, -1] + rng.normal(size=200) * (1 + abs(x[:, 0]))
    fit = T.ols_hc3(spark.createDataFrame(pd.DataFrame({"y": y, "a": x[:, 0], "b": x[:, 1]})), "y", ["a", "b"])
    d = np.column_stack([np.ones(200), x])
    inv = np.linalg.inv(d.T @ d)
    beta = inv @ d.T @ y
    h = np.einsum("ij,jk,ik->i", d, inv, d)
    meat = (d * (((y - d @ beta) / (1 - h)) ** 2)[:, None]).T @ d
    assert np.allclose(fit.estimate, beta) and np.allclose(fit.se, np.sqrt(np.diag(inv @ meat @ inv)))


def test_negative_binomial_recovers(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=4000)
    mu = np.exp(0.5 + 0.7 * x)
    y = rng.poisson(rng.gamma(2.0, mu / 2.0))
    fit = T.negative_binomial(spark.createDataFrame(pd.DataFrame({"y": y.astype(float), "x": x})), "y", ["x"])
    assert fit.estimate.tolist() == pytest.approx([0.5, 0.7], abs=0.08) and fit.attrs["theta"] == pytest.approx(2.0, rel=0.15)


def test_fractional_logit_and_interactions(spark):
    rng = np.random.default_rng(5)
    f = pd.DataFrame({"a": rng.integers(0, 2, 3000).astype(float), "x": rng.normal(size=3000)})
    d, names = T.interactions(spark.createDataFrame(f.assign(y=0.0)), ["a"], ["x"])
    assert names == ["a:x"] and d.filter(F.abs(F.col("a:x") - F.col("a") * F.col("x")) > 1e-12).count() == 0
    mu = 1 / (1 + np.exp(-(0.3 - 0.8 * f.x + 0.5 * f.a * f.x)))
    f["y"] = rng.beta(5 * mu, 5 * (1 - mu))
    d, names = T.interactions(spark.createDataFrame(f), ["a"], ["x"])
    fit = T.fractional_logit(d, "y", ["a", "x", *names])
    design = np.column_stack([np.ones(3000), f.a, f.x, f.a * f.x])
    beta = np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        beta += np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design, design.T @ (f.y - p))
    assert fit.estimate.tolist() == pytest.approx(beta.tolist(), abs=1e-7)
    p = 1 / (1 + np.exp(-design @ beta))
    bread = np.linalg.inv((design * (p * (1 - p))[:, None]).T @ design)
    meat = (design * ((f.y - p) ** 2).to_numpy()[:, None]).T @ design
    assert fit.se.tolist() == pytest.approx(np.sqrt(np.diag(bread @ meat @ bread)).tolist(), rel=1e-7)


def test_two_way_anova_by_residuals(spark):
    rng = np.random.default_rng(3)
    f = pd.DataFrame({"a": rng.choice(list("xyz"), 300), "b": rng.choice(list("uv"), 300)})
    f["v"] = (f.a == "x") * 1.0 + (f.b == "u") * 0.5 + rng.normal(size=300)
    got = T.anova_two_way(spark.createDataFrame(f), "a", "b", "v").set_index("effect")

    def rss(*parts):
        d = np.column_stack([np.ones(300), *(p.to_numpy(float) for p in parts)])
        return float(((f.v - d @ np.linalg.lstsq(d, f.v, rcond=None)[0]) ** 2).sum())

    a, b, ab = pd.get_dummies(f.a), pd.get_dummies(f.b), pd.get_dummies(f.a + f.b)
    full = rss(ab)
    want = {"a": (rss(b) - rss(a, b), 2), "b": (rss(a) - rss(a, b), 1), "a:b": (rss(a, b) - full, 2)}
    for k, (ss, df) in want.items():
        assert got.loc[k, "df"] == df and got.loc[k, "statistic"] == pytest.approx(ss / df / (full / 294), rel=1e-8)


def test_describe_and_winsor(spark):
    d = R.describe(spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "v double"), ["v"]).first()
    assert (d.n, d.missing, d.median, d.p25, d.p75) == (4, 1, 2.5, 1.75, 3.25)
    assert T.impute_median(spark.createDataFrame([(1.0,), (None,), (3.0,)], "v double"), ["v"]).agg(F.sum("v")).first()[0] == 6


def test_fuzzy_and_pictures():
    long = "这是一段足够长的文字用来测试包含关系是否被识别出来没有问题"
    assert fuzzy_chunks(["a", "A.", long[:25], long, ""]) == ["a", long]
    p = np.arange(1024).reshape(32, 32) % 251


def test_pictures_by_definition(spark):
    rng = np.random.default_rng(4)
    p = rng.random((3, 32, 32)) * 255
    got = pictures.picture_hashes(p.reshape(3, -1))
    for k in range(3):
        c = np.zeros((8, 8))
        for u in range(8):
            for v in range(8):
                wave = np.outer(np.cos(np.pi * u * (2 * np.arange(32) + 1) / 64), np.cos(np.pi * v * (2 * np.arange(32) + 1) / 64))
                c[u, v] = (p[k] * wave).sum() * (1 if u else 0.5**0.5) * (1 if v else 0.5**0.5) / 16
        flat = c.ravel()
        assert f"{got[k]:064b}" == "".join("1" if x > np.median(flat[1:]) else "0" for x in flat)
    lap = np.zeros((4, 6))
    q = rng.random((1, 4, 6))
    e = np.pad(q[0], 1, mode="edge")
    for i in range(4):
        for j in range(6):
            lap[i, j] = e[i, j + 1] + e[i + 2, j + 1] + e[i + 1, j] + e[i + 1, j + 2] - 4 * e[i + 1, j + 1]
    assert pictures.sharpness(q)[0] == pytest.approx(lap.var()) and pictures.sharpness(np.ones((2, 5, 5))).tolist() == [0, 0]
    rows = [(1, p[0].ravel().tolist()), (2, None), (3, [1.0]), (4, [None] * 1024)]
    out = {r.id: (r.phash_hex, r.sharpness) for r in pictures.picture_features(spark.createDataFrame(rows, "id long, px array<double>"), "id", "px").collect()}
    assert out[1][0] == f"{got[0]:016x}" and [out[i] for i in (2, 3, 4)] == [(None, None)] * 3


def test_ingest(spark, tmp_path):
    assert ingest.find_column(["Comment ID", "内容", "like_count"], ("commentid",)) == "Comment ID"
    df = spark.createDataFrame([("1", "好", "x"), ("2", "", "3")], "cid string, `正文` string, `like count` string")
    got = ingest.canonical(df).orderBy("id").collect()
    assert [(r.id, r.raw_text, r.likes, r.user_id) for r in got] == [("1", "好", None, None), ("2", "", 3.0, None)]
    assert ingest.guess_text_column(df) == "cid"
    (tmp_path / "a.csv").write_bytes("﻿id,内容\n1,你好\n".encode())
    (tmp_path / "b.csv").write_bytes("id,内容\n2,您好\n".encode("gb18030"))
    rows = ingest.read_csv_folder(spark, str(tmp_path), ["id", "内容"]).orderBy("id").collect()
    assert [(r.file, r.row_index, r.id, r["内容"]) for r in rows] == [("a.csv", 1, "1", "你好"), ("b.csv", 1, "2", "您好")]
    with pytest.raises(ValueError):
        ingest.read_any(spark, "x.xlsx")
    p = json.dumps({"aweme_id": "abc123", "author": {"uid": "u1", "nickname": "alice"}, "statistics": {"digg_count": 10}, "create_time": 1735689600})
    r = ingest.from_payload(spark.createDataFrame([(p,), ("broken",)], "p string"), "p").collect()
    assert [(x.platform_video_id, x.author_name, x.likes) for x in r] == [("abc123", "alice", 10)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, [1]), ("b", 2, [2])], "k string, v int, l array<int>")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["k", "l", "v"]
    sinks.write_by(df.drop("l"), "k", str(tmp_path / "d"))
    assert {x for x in os.listdir(tmp_path / "d") if "=" in x} == {"k=a", "k=b"}
    sinks.write_nested(df, "k", str(tmp_path / "n"))
    for v in ("v1", "v2", "v3"):
        sinks.write_snapshot(df, str(tmp_path / "s"), v, keep=2)
    assert sorted(os.listdir(tmp_path / "s" / "archive")) == ["v2", "v3"]
    good, bad = sinks.quarantine(df.withColumn("v", F.nullif("v", F.lit(2))), "v > 0")
    assert (good.count(), bad.count()) == (1, 1)


def test_upsert_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = spark.createDataFrame([(1, 1, "a")], "k int, ver int, x string").schema
    for rows in ([(1, 1, "a"), (2, 1, "b")], [(1, 2, "c"), (1, 1, "old")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        streams.tail(spark, src, schema).writeStream.foreachBatch(streams.upsert(out, ["k"], ["ver"])).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert {(r.k, r.x) for r in streams.current(spark, out).collect()} == {(1, "c"), (2, "b")}
    # the second batch rewrote the bucket of its key alone
    assert len(os.listdir(f"{out}/batch=0")) > 1 and sum("=" in x for x in os.listdir(f"{out}/batch=1")) == 1
    assert streams.current(spark, str(tmp_path / "none")) is None


def test_expansion_reaches_four_characters(spark):
    texts = ["法律援助中心来了", "法律援助中心好", "讲权利也讲援助中心", "法律", "权利abc援助", "", "无关的话"] * 3
    cats = {"state": ("法律", "零容忍"), "freedom": ("权利",)}
    grams = [{t[i : i + n] for t in "".join(c if "\u4e00" <= c <= "\u9fff" else " " for c in x).split() for n in (2, 3, 4) for i in range(len(t) - n + 1)} for x in texts]
    want = set()
    for k, v in cats.items():
        hit = [any(s in x for s in v) for x in texts]
        for g in set().union(*grams) - {s for v in cats.values() for s in v}:
            df, co = sum(g in x for x in grams), sum(g in x and h for x, h in zip(grams, hit))
            if df >= 4 and co and co / (df * sum(hit)) ** 0.5 > 0.08:
                want.add((k, g, round(co / (df * sum(hit)) ** 0.5, 9)))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {tuple(r) for r in expanded_terms(df, cats, least=4, top=1000).collect()}
    assert got == want and {len(t) for _, t, _ in got} == {2, 3, 4}


def test_named_gram_queries_count_four_characters(spark, tmp_path):
    from tallyloom.plans import comment_queries as Q

    rows = [(i, 1, 1, "援助中心讲法律", 0, None) for i in range(25)]
    spark.createDataFrame(rows, "id long, video_id long, level int, text string, like_count long, updated_at timestamp").write.parquet(str(tmp_path / "comments.parquet"))
    assert ("援助中心", 25) in {tuple(r) for r in Q.gram_frequency_whole(spark, str(tmp_path)).collect()}
    assert ("state", "援助中心", 1.0) in {tuple(r) for r in Q.lexicon_expansion_whole(spark, str(tmp_path)).collect()}
