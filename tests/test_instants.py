"""Timestamps against a plain reading by zoneinfo, and the path through ambiguous ones."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from tallyloom.operators import instants as I


def _ms(d):
    return int(d.timestamp() * 1000 // 1)


def _read(spark, rows):
    df = spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], "id string, value string, tz string, o string")
    out = I.normalize_instants(df, F.col("id"), F.col("value"), F.col("tz"), F.col("id").cast("long"), F.col("tz"), F.col("o"), 1000)
    got = {r.record_id: r.epoch_ms for r in out.collect()}
    return [got.get(str(i)) for i in range(len(rows))]


def test_notations(spark):
    utc = lambda *a: _ms(datetime(*a, tzinfo=timezone.utc))
    sh, ny, be, sy = ("Asia/Shanghai", "ymd"), ("America/New_York", "mdy"), ("Europe/Berlin", "dmy"), ("Australia/Sydney", "dmy")
    cases = [
        (("2026-02-03T22:26:30.576Z", *sh), utc(2026, 2, 3, 22, 26, 30) + 576),
        (("2025-12-08T00:36:40+08:00", *ny), utc(2025, 12, 7, 16, 36, 40)),
        (("1771985208", *ny), 1771985208000),
        (("1762671319697", *sh), 1762671319697),
        (("1769532223769582", *sh), 1769532223769),
        (("1768250892.623", *sh), 1768250892623),
        (("2025-10-29 02:13:25.957526+0000", *sh), utc(2025, 10, 29, 2, 13, 25) + 957),
        (("2026-04-27 07:03:15", *sh), utc(2026, 4, 26, 23, 3, 15)),
        (("20250905T071215Z", *be), utc(2025, 9, 5, 7, 12, 15)),
        (("2026-02-21 04:10", *sh), utc(2026, 2, 20, 20, 10)),
        (("2025-12-02T19:03:33+08:00[Asia/Shanghai]", *sh), utc(2025, 12, 2, 11, 3, 33)),
        (("2026/1/19 13:40", *sh), utc(2026, 1, 19, 5, 40)),
        (("23.11.2025 16:05", *be), utc(2025, 11, 23, 15, 5)),
        (("03/07/2026 9:05 AM", *ny), utc(2026, 3, 7, 14, 5)),
        (("03/07/2026 12:05 AM", *ny), utc(2026, 3, 7, 5, 5)),
        (("03/07/2026 9:05", *sy), utc(2026, 7, 2, 23, 5)),
        (("2026年3月18日 06时03分", *sh), utc(2026, 3, 17, 22, 3)),
        (("2025年10月4日 上午6:11", *sh), utc(2025, 10, 3, 22, 11)),
        (("2026年3月15日 下午12:44", *sh), utc(2026, 3, 15, 4, 44)),
        (("2026年1月10日 晚上10:03", *sh), utc(2026, 1, 10, 14, 3)),
        (("2025年9月12日 凌晨0:37", *sh), utc(2025, 9, 11, 16, 37)),
        (("Sat, 10 Jan 2026 15:06:01 +0800", *ny), utc(2026, 1, 10, 7, 6, 1)),
        (("Oct 26, 2025 02:51:20 CEST", *be), utc(2025, 10, 26, 0, 51, 20)),
        (("Jan 17, 2026 07:25:39 AEDT", *sy), utc(2026, 1, 16, 20, 25, 39)),
        (("２０２６-02-03 01:02:03", *sh), utc(2026, 2, 2, 17, 2, 3)),
        # twice: the earlier instant; never: forward by the gap
        (("2025-10-26 02:30:00", *be), utc(2025, 10, 26, 0, 30)),
        (("2026-03-08 02:30:00", *ny), utc(2026, 3, 8, 7, 30)),
        *(((v, *sh), None) for v in (None, "", "  ", "nan", "未知", "0", "2026-02-30 08:00:00", "13/13/2026 10:00", "2026-01-01 25:00:00", "0000-00-00 00:00:00")),
    ]
    assert _read(spark, [c for c, _ in cases]) == [w for _, w in cases]


def test_wall_times_match_zoneinfo_over_the_changes(spark):
    rows, want = [], []
    for tz, start in (("Europe/Berlin", datetime(2025, 10, 26)), ("America/New_York", datetime(2025, 11, 2)), ("Australia/Sydney", datetime(2026, 4, 5)), ("Europe/Berlin", datetime(2026, 3, 29)), ("America/New_York", datetime(2026, 3, 8))):
        for m in range(0, 300, 20):
            w = start + timedelta(minutes=m)
            rows.append((w.strftime("%Y-%m-%d %H:%M:%S"), tz, "ymd"))
            want.append(_ms(w.replace(tzinfo=ZoneInfo(tz), fold=0)))
    assert _read(spark, rows) == want


def test_path_prefers_the_same_notation_and_no_jump_back():
    day = 86_400_000
    options = [[("dmy", 100 * day, 0.0)], [("dmy", 101 * day, 0.0), ("mdy", 40 * day, 0.5)], [("mdy", 102 * day, 0.0), ("dmy", 10 * day, 0.0)]]
    assert I.choose(options) == [0, 0, 0]
    assert I.choose([]) == []
    # by brute force over all paths
    import itertools

    def cost(path):
        total, last = 0.0, None
        for o, i in zip(options, path):
            total += o[i][2]
            if last:
                total += I.SWITCH * (last[0] != o[i][0]) + I.BACKWARD * (o[i][1] < last[1] - 3_600_000)
            last = o[i]
        return total

    best = min(itertools.product(*(range(len(o)) for o in options)), key=cost)
    assert cost(I.choose(options)) == cost(best)


def test_no_site_keeps_the_source_order_and_empty_table(spark):
    rows = [("25/01/2026 10:00", None, None), ("03/02/2026 10:00", None, None), ("27/02/2026 10:00", None, None)]
    got = _read(spark, rows)
    assert got[1] == _ms(datetime(2026, 2, 3, 10, tzinfo=timezone.utc))
    assert _read(spark, [(None, None, None)]) == [None]


def test_path_decides_whatever_the_blocks(spark, monkeypatch):
    """Without a site's rules; the same path for every cut, and that of the whole sequence."""
    import random

    monkeypatch.setattr(I, "GROUP_BLOCKS", 3)
    rng = random.Random(8)
    rows, day = [], datetime(2026, 1, 1)
    for i in range(240):
        day += timedelta(hours=rng.randrange(2, 40))
        # the second source has no value with one reading
        src = "b" if i % 3 else "a"
        fmt = rng.choice(["%d/%m/%Y %H:%M", "%m/%d/%Y %H:%M", "%d.%m.%Y %H:%M"])
        d = day.day % 12 + 1
        shown = day.replace(day=d % 12 + 1 if d == day.month else d) if src == "b" or i % 5 else day
        rows.append((f"{i:03d}", shown.strftime(fmt), src, i))
    df = spark.createDataFrame(rows, "id string, value string, src string, n long")
    args = [F.col("id"), F.col("value"), F.col("src"), F.col("n"), F.lit(None).cast("string"), F.lit(None).cast("string")]
    got = [{r.record_id: r.epoch_ms for r in I.normalize_instants(df, *args, span).collect()} for span in (5, 17, 100_000)]
    assert got[0] == got[1] == got[2] and len(got[0]) == len(rows)
    read = {r.id: r.readings for r in I.with_readings(df.select("id", "value", F.lit(None).cast("string").alias("tz"), F.lit(None).cast("string").alias("date_order"))).select("id", "readings").collect()}
    assert min(len(read[i]) for i, _, s, _ in rows if s == "b") > 1
    for src in "ab":
        own = [i for i, _, s, _ in rows if s == src]
        options = [I._useful(i, read[i]) for i in own]
        assert [o[k][1] for o, k in zip(options, I.choose(options))] == [got[0][i] for i in own]


def test_every_reading_is_there_and_rules_cost(spark):
    df = spark.createDataFrame([("03/02/2026 10:00", "UTC", "dmy"), ("1771985208", "UTC", "ymd"), ("2025-10-26 02:30:00", "Europe/Berlin", "dmy"), ("Jan 17, 2026 07:25 CST", "Asia/Shanghai", "ymd")], "value string, tz string, date_order string")
    got = {r.value: [(x.fmt, x.cost) for x in r.readings] for r in I.with_readings(df).collect()}
    rule = I.AGAINST_RULE
    assert got["03/02/2026 10:00"] == [("dmy", 0.0), ("mdy", rule)]
    assert got["1771985208"] == [("epoch_s", 0.0), ("epoch_ms", rule), ("epoch_us", rule), ("epoch_ns", rule)]
    assert got["2025-10-26 02:30:00"] == [("iso", 0.0), ("iso", rule)]
    assert got["Jan 17, 2026 07:25 CST"] == [("named", 0.0), ("named", rule)]


def test_repeats_count_once_and_clashing_columns(spark):
    df = spark.createDataFrame([("1", "1771985208", "x", "y"), ("1", "1771985208", "x", "y"), (None, "1771985208", "x", "y")], "record_id string, value string, at string, s string")
    out = I.normalize_instants(df, F.col("record_id"), F.col("value"), F.lit("src"), F.lit(1), F.lit("UTC"), F.lit("ymd"), 10)
    assert [tuple(r) for r in out.collect()] == [("1", 1771985208000, 4)]
