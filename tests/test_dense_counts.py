"""Per-key aggregates against pandas, with skew, NULLs, ties and no rows at all."""

import pandas as pd
from pyspark.sql import functions as F

from tallyloom.functions.keys import video_key
from tallyloom.operators import dense_counts as D


def _frame(spark, rows):
    return spark.createDataFrame(rows, "k string, v long, key_value string, n_rows string")


def test_skewed_keys_match_pandas(spark):
    rows = [("hot", i, "x", "y") for i in range(500)] + [(f"k{i % 37}", i, None, None) for i in range(300)] + [(None, 5, "x", "y")] * 7
    df = _frame(spark, rows).repartition(7)
    got = {r.key_value: (r.n, r.s, r.lo, r.hi) for r in D.dense_aggregate(df, F.col("k"), {"n": F.lit(1), "s": F.col("v")}, {"lo": F.col("v")}, {"hi": F.col("v")}).collect()}
    want = pd.DataFrame(rows, columns=["k", "v", "a", "b"]).dropna(subset=["k"]).groupby("k").v.agg(["size", "sum", "min", "max"])
    assert got == {k: tuple(map(int, r)) for k, r in zip(want.index, want.to_numpy())}


def test_flush_keeps_every_key(spark, monkeypatch):
    monkeypatch.setattr(D, "FLUSH_KEYS", 3)
    df = spark.range(1000).select((F.col("id") % 50).cast("string").alias("k"))
    assert {r.n_rows for r in D.dense_aggregate(df, F.col("k"), {"n_rows": F.lit(1)}).collect()} == {20}


def test_large_values_add_exactly(spark):
    big = 2**53
    rows = [("a", v, None, None) for v in (big, 1, 1, -big, big, 3)] + [("b", -(2**62), None, None), ("b", 2**62 + 7, None, None)]
    got = {r.key_value: r.s for r in D.dense_aggregate(_frame(spark, rows), F.col("k"), {"s": F.col("v")}).collect()}
    assert got == {"a": big + 5, "b": 7}


def test_null_values_and_empty_table(spark):
    df = _frame(spark, [("a", None, None, None), ("a", None, None, None)])
    r = D.dense_aggregate(df, F.col("k"), {"s": F.col("v")}, {"lo": F.col("v")}, {"hi": F.col("v")}).collect()
    assert [tuple(x) for x in r] == [("a", 0, None, None)]
    assert D.heavy_keys(df.limit(0), F.col("k"), 0.03).count() == 0
    assert D.heavy_keys(_frame(spark, [(None, 1, None, None)]), F.col("k"), 0.03).count() == 0


def test_heavy_keys_keep_ties_at_the_threshold(spark):
    df = _frame(spark, [("a", 1, None, None)] * 2 + [("b", 1, None, None)] * 2 + [("c", 1, None, None)] * 16)
    assert {r.key_value for r in D.heavy_keys(df, F.col("k"), 0.1).collect()} == {"a", "b", "c"}


def test_video_keys(spark):
    df = spark.createDataFrame([("123.0",), (" 77 ",), ("nan",), ("",), (None,), (" 5.0 ",)], "v string")
    assert [r[0] for r in df.select(video_key(F.col("v"))).collect()] == ["123", "77", None, None, None, "5"]
