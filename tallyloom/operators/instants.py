"""One instant for timestamps of many notations, precisions and zones.

Every value gets an array of all its valid interpretations with their costs,
built from built-in expressions: both orders of day and month, every unit of a
bare number, both instants of a wall time that occurs twice, every meaning of
an abbreviation. What a rule of the source speaks against costs more than a
path can gain elsewhere; where no rule speaks, a Viterbi pass over the source's
record order decides, in which a switch of notation and a jump back in time
cost extra.

A source's order is cut into blocks. A block settles what lies between two
values with one interpretation; what is open at its edges is settled with the
costs that reach it from both sides. These come from a scan over the blocks'
min-plus matrices, in two levels, so that the path is that of the whole source
wherever the cuts lie.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.session import checkpointed

#: English month names as written in mail dates.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: Zone abbreviations and their offsets in minutes. Those with
#: more than one meaning list every one.
ABBREVIATIONS = {
    "UTC": (0,), "GMT": (0,), "Z": (0,), "WET": (0,), "WEST": (60,), "CET": (60,), "CEST": (120,), "EET": (120,), "EEST": (180,), "MSK": (180,),
    "EST": (-300,), "EDT": (-240,), "CDT": (-300,), "MST": (-420,), "MDT": (-360,), "PST": (-480,), "PDT": (-420,), "CST": (480, -360),
    "IST": (330, 60, 120), "BST": (60,), "JST": (540,), "KST": (540,), "HKT": (480,), "SGT": (480,), "AEST": (600,), "AEDT": (660,), "ACST": (570,), "ACDT": (630,), "AWST": (480,), "NZST": (720,), "NZDT": (780,),
}
#: Costs of the path: a later one of several equal readings, a switch of
#: notation, a jump back by more than an hour.
LATER_READING, SWITCH, BACKWARD = 0.5, 1.0, 2.0
#: What one reading can gain for the values before and after it, and the cost of
#: a reading that a rule speaks against, which is more.
_MOST_GAIN = 2 * (SWITCH + BACKWARD)
AGAINST_RULE = _MOST_GAIN + 1.0
_BACK_MS, _DAY_MS = 3_600_000, 86_400_000
#: Bare numbers are read up to this instant (the year 2200).
_LATEST_MS = 7_258_118_400_000
#: Records of a source in a block, on average, and blocks in a group.
BLOCK_RECORDS, GROUP_BLOCKS = 16_384, 1024
#: Decides between paths of equal cost, alike for all cuts; too small to outweigh one.
_TIE = 1e-7
_CANDIDATES = T.ArrayType(T.StructType([T.StructField("fmt", T.StringType()), T.StructField("ms", T.LongType()), T.StructField("cost", T.DoubleType())]))

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_ZONE = r"(Z|z|UTC|GMT|[+-]\d{2}:?\d{2}|[+-]\d{2})?"
_ISO = rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:[T ]+{_TIME})?\s*{_ZONE}(?:\[([A-Za-z_+\-/0-9]+)\])?$"
_BASIC = r"^(\d{4})(\d{2})(\d{2})[T ]?(\d{2})(\d{2})(?:(\d{2}))?(?:[.,](\d{1,9}))?\s*(Z|z|[+-]\d{2}:?\d{2})$|^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})?$"
_YMD = rf"^(\d{{4}})[/.](\d{{1,2}})[/.](\d{{1,2}})(?:[T ]+{_TIME})?\s*([AaPp])?[Mm.]*\s*{_ZONE}$"
_XXY = rf"^(\d{{1,2}})([/.\-])(\d{{1,2}})[/.\-](\d{{4}})(?:,?[T ]+{_TIME})?\s*([AaPp])?[Mm.]*\s*{_ZONE}$"
_HAN = r"^(\d{4})年(\d{1,2})月(\d{1,2})[日号]\s*(凌晨|清晨|早上|上午|中午|下午|傍晚|晚上|夜里)?\s*(?:(\d{1,2})[:时点](\d{1,2})?分?(?::?(\d{1,2})秒?)?)?$"
_MAIL = r"^(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})\s+([A-Za-z]{3})[a-z]*\.?\s+(\d{4})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([+-]\d{4}|[A-Za-z]{1,5})?$"
_NAMED = r"^([A-Za-z]{3})[a-z]*\.?\s+(\d{1,2}),?\s+(\d{4}),?\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([AaPp][Mm])?\s*([+-]\d{2}:?\d{2}|[A-Za-z]{1,5})?$"


def _fields(s: Column, guard: Column, pattern: str, n: int) -> Column:
    """Groups of a whole-string match as an array; NULL where it does not match.

    ``guard`` looks at a character or two, so that most patterns are not tried.
    """
    joined = "\u0001".join(f"${i}" for i in range(1, n + 1))
    return F.when(guard & s.rlike(pattern), F.split(F.regexp_replace(s, pattern, joined), "\u0001", n))


def _int(c: Column) -> Column:
    return F.when(c != "", c.cast("int"))


def _wall(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column, frac: Column | None = None) -> Column:
    """Milliseconds of a wall time read as UTC; NULL for an impossible one."""
    real = (y >= 1) & h.between(0, 23) & mi.between(0, 59) & s.between(0, 59)
    at = F.try_make_timestamp(y, mo, d, h, mi, s.cast("decimal(16,6)"), F.lit("UTC"))
    ms = F.unix_millis(at)
    if frac is not None:
        ms = ms + F.rpad(F.substring(F.coalesce(frac, F.lit("")), 1, 3), 3, "0").cast("long")
    return F.when(real, ms)


def _offset(z: Column) -> Column:
    """Minutes of a numeric offset."""
    digits = F.regexp_replace(z, "[^0-9]", "")
    minutes = F.substring(digits, 1, 2).cast("int") * 60 + F.when(F.length(digits) >= 4, F.substring(digits, 3, 2).cast("int")).otherwise(0)
    return F.when(z.rlike(r"^[+-]\d"), F.when(z.startswith("-"), -minutes).otherwise(minutes))


def _local(ms: Column, tz: Column) -> Column:
    """The instant of a wall time: the earlier of two, a missing one moved forward by the gap."""
    return F.unix_millis(F.to_utc_timestamp(F.timestamp_millis(ms), tz))


def _again(ms: Column, first: Column, tz: Column) -> Column:
    """The later instant of a wall time that occurs twice, by the offset in force a day later; else NULL."""
    later = ms - ((ms + _DAY_MS) - _local(ms + _DAY_MS, tz))
    twice = (later > first) & (F.unix_millis(F.from_utc_timestamp(F.timestamp_millis(later), tz)) == ms)
    return F.when(twice, later)


def _reading(fmt: str, ms: Column, cost: Column | float = 0.0) -> Column:
    cost = F.lit(cost) if isinstance(cost, float) else cost
    return F.struct(F.lit(fmt).alias("fmt"), ms.cast("long").alias("ms"), cost.cast("double").alias("cost"))


def _half_day(h: Column, half: Column) -> Column:
    """24-hour value of an hour with an a or p mark."""
    m = F.lower(F.coalesce(half, F.lit("")))
    return F.when((m == "p") & (h < 12), h + 12).when((m == "a") & (h == 12), 0).otherwise(h)


def _zoned(ms: Column, z: Column, tz: Column) -> Column:
    """Instant by a written zone, else by the source's."""
    minutes = F.when(F.upper(z).isin("Z", "UTC", "GMT"), 0).otherwise(_offset(z))
    return F.when(z != "", ms - minutes * 60_000).otherwise(_local(ms, tz))


def with_readings(df: DataFrame) -> DataFrame:
    """Add ``readings``: all valid readings of ``value`` as an array of (fmt, ms, cost).

    ``tz`` is the source's zone, ``date_order`` its order of numeric dates
    (ymd, dmy, mdy); either may be NULL. Without a zone a wall time is read as
    UTC. With an order the other one costs ``AGAINST_RULE``, and so do the
    later of two instants, a unit that does not fit a bare number's size and a
    meaning of an abbreviation other than the source's. NULL, blanks, words,
    zero and impossible dates give an empty array. The steps are separate
    projections so that no parsed field is computed twice.
    """
    c = F.col
    s = F.trim(F.regexp_replace(F.translate("value", "０１２３４５６７８９：／－．　", "0123456789:/-. "), "[\u200b-\u200f\u2060\ufeff]", ""))
    df = df.withColumns({"s": s, "zone": F.coalesce(c("tz"), F.lit("UTC"))})
    fifth, digit = F.substring("s", 5, 1), lambda k: F.substring("s", k, 1).between("0", "9")
    word = F.substring("s", 1, 1) >= "A"
    guards = {"iso": fifth == "-", "bas": digit(5), "ymd": fifth.isin("/", "."), "xxy": F.substring("s", 2, 1).isin("/", ".", "-") | F.substring("s", 3, 1).isin("/", ".", "-"), "han": fifth == "年", "mail": digit(1) & (F.instr("s", " ") > 0) | word, "nam": word}
    df = df.withColumns({name: _fields(c("s"), guards[name], pattern, n) for name, pattern, n in (("iso", _ISO, 9), ("bas", _BASIC, 14), ("ymd", _YMD, 9), ("xxy", _XXY, 10), ("han", _HAN, 7), ("mail", _MAIL, 7), ("nam", _NAMED, 8))} | {"num": F.when(c("s").rlike(r"^\d{1,19}(\.\d{1,9})?$"), F.split("s", r"\."))})
    f, b, y, x, h, m, n, num = (c(k) for k in ("iso", "bas", "ymd", "xxy", "han", "mail", "nam", "num"))
    zero = F.lit(0)
    part, hh = h[3], F.coalesce(_int(h[4]), zero)
    han_h = F.when(part.isin("下午", "傍晚", "晚上", "夜里") & (hh < 12), hh + 12).when(part.isin("凌晨", "清晨", "早上") & (hh == 12), 0).when((part == "中午") & (hh < 3), hh + 12).otherwise(hh)
    # constant tables as SQL text: one parsed expression instead of many calls
    names = F.expr("array(" + ", ".join(f"'{m}'" for m in MONTHS) + ")")
    month = lambda k: F.array_position(names, F.lower(k)).cast("int")
    clock = (_half_day(F.coalesce(_int(x[4]), zero), x[8]), F.coalesce(_int(x[5]), zero), F.coalesce(_int(x[6]), zero), x[7])
    df = df.withColumns(
        {
            "w_iso": _wall(_int(f[0]), _int(f[1]), _int(f[2]), F.coalesce(_int(f[3]), zero), F.coalesce(_int(f[4]), zero), F.coalesce(_int(f[5]), zero), f[6]),
            "z_iso": F.coalesce(f[7], F.lit("")),
            "n_iso": F.when(f[8] != "", f[8]),
            "w_bz": _wall(_int(b[0]), _int(b[1]), _int(b[2]), _int(b[3]), _int(b[4]), F.coalesce(_int(b[5]), zero), b[6]),
            "z_bz": F.coalesce(b[7], F.lit("")),
            "w_bl": _wall(_int(b[8]), _int(b[9]), _int(b[10]), _int(b[11]), _int(b[12]), F.coalesce(_int(b[13]), zero)),
            "w_ymd": _wall(_int(y[0]), _int(y[1]), _int(y[2]), _half_day(F.coalesce(_int(y[3]), zero), y[7]), F.coalesce(_int(y[4]), zero), F.coalesce(_int(y[5]), zero), y[6]),
            "z_ymd": F.coalesce(y[8], F.lit("")),
            "w_dmy": _wall(_int(x[3]), _int(x[2]), _int(x[0]), *clock),
            "w_mdy": _wall(_int(x[3]), _int(x[0]), _int(x[2]), *clock),
            "z_xxy": F.coalesce(x[9], F.lit("")),
            "w_han": _wall(_int(h[0]), _int(h[1]), _int(h[2]), han_h, F.coalesce(_int(h[5]), zero), F.coalesce(_int(h[6]), zero)),
            # a mail date and a named date never match at once
            "w_abb": F.coalesce(_wall(_int(m[2]), month(m[1]), _int(m[0]), _int(m[3]), _int(m[4]), F.coalesce(_int(m[5]), zero)), _wall(_int(n[2]), month(n[0]), _int(n[1]), _half_day(_int(n[3]), F.substring(n[6], 1, 1)), _int(n[4]), F.coalesce(_int(n[5]), zero))),
            "z_abb": F.coalesce(m[6], n[7], F.lit("")),
            "whole": F.try_element_at(num, F.lit(1)).try_cast("long"),
            "frac": F.rpad(F.substring(F.coalesce(F.try_element_at(num, F.lit(2)), F.lit("")), 1, 3), 3, "0").cast("long"),
        }
    )
    whole, zone = c("whole"), c("zone")
    cut = lambda by: ((whole - whole % by) / by).cast("long")
    unit = F.when(whole < 10**11, "s").when(whole < 10**14, "ms").when(whole < 10**17, "us").otherwise("ns")
    units = {"s": F.when(whole < 10**15, whole * 1000 + c("frac")), "ms": whole, "us": cut(1000), "ns": cut(10**6)}
    order = c("date_order")
    meanings = F.expr("map(" + ", ".join(f"'{k}', array({', '.join(map(str, o))})" for k, o in ABBREVIATIONS.items()) + ")")
    meant = F.transform(meanings[F.upper("z_abb")], lambda o: c("w_abb") - o * 60_000)
    # wall times without a zone of their own, one at most of a value but for the two orders
    df = df.withColumns(
        {
            "l_one": F.coalesce(F.when(c("z_iso") == "", c("w_iso")), F.when(c("z_bz") == "", F.coalesce("w_bz", "w_bl")), F.when(c("z_ymd") == "", c("w_ymd")), c("w_han"), F.when(c("z_abb") == "", c("w_abb"))),
            "l_dmy": F.when(c("z_xxy") == "", c("w_dmy")),
            "l_mdy": F.when((c("z_xxy") == "") & ~c("w_mdy").eqNullSafe(c("w_dmy")), c("w_mdy")),
            "own": _local(c("w_abb"), zone),
            "meant": F.when(c("w_abb").isNull() | (c("z_abb") == ""), F.array().cast("array<bigint>")).when(c("z_abb").rlike("^[+-]"), F.array(c("w_abb") - _offset(c("z_abb")) * 60_000)).otherwise(F.coalesce(meant, F.array().cast("array<bigint>"))),
            "at_zone": F.coalesce("n_iso", "zone"),
            "o_dmy": F.when(order == "mdy", AGAINST_RULE).otherwise(0.0),
            "o_mdy": F.when(order == "dmy", AGAINST_RULE).when(order == "mdy", 0.0).otherwise(LATER_READING),
            # of a date whose day and month agree both orders are one reading
            "m_xxy": F.when(~c("w_mdy").eqNullSafe(c("w_dmy")), c("w_mdy")),
            "kind": F.when(c("w_iso").isNotNull(), "iso").when(c("w_ymd").isNotNull(), "ymd").when(c("w_han").isNotNull(), "han").when(c("w_abb").isNotNull(), "named").otherwise("basic"),
        }
    )
    df = df.withColumns({f"f_{k}": _local(c(f"l_{k}"), c("at_zone")) for k in ("one", "dmy", "mdy")})
    df = df.withColumns({f"g_{k}": _again(c(f"l_{k}"), c(f"f_{k}"), c("at_zone")) for k in ("one", "dmy", "mdy")})
    # of several meanings of an abbreviation, one that agrees with the source's zone is the rule
    ruled = (F.size("meant") > 1) & F.array_contains("meant", c("own"))
    words = F.transform("meant", lambda v, i: F.struct(F.lit("named").alias("fmt"), v.cast("long").alias("ms"), F.when(ruled, F.when(v == c("own"), 0.0).otherwise(AGAINST_RULE)).otherwise(i * LATER_READING).cast("double").alias("cost")))
    one = lambda ms, extra=0.0: F.struct(c("kind").alias("fmt"), ms.cast("long").alias("ms"), F.lit(extra).cast("double").alias("cost"))
    zoned = F.coalesce(*(F.when(c(z) != "", _zoned(c(w), c(z), zone)) for w, z in (("w_iso", "z_iso"), ("w_bz", "z_bz"), ("w_ymd", "z_ymd"))))
    offset = F.when(c("z_xxy") != "", F.when(F.upper("z_xxy").isin("Z", "UTC", "GMT"), 0).otherwise(_offset(c("z_xxy"))) * 60_000)
    plain = F.array(
        one(zoned), one(c("f_one")), one(c("g_one"), AGAINST_RULE),
        *(_reading(k, F.coalesce(c(f"f_{k}"), c(w) - offset), c(f"o_{k}")) for k, w in (("dmy", "w_dmy"), ("mdy", "m_xxy"))),
        *(_reading(k, c(f"g_{k}"), c(f"o_{k}") + AGAINST_RULE) for k in ("dmy", "mdy")),
        *(_reading(f"epoch_{k}", F.when((whole > 0) & ((unit == k) | (ms <= _LATEST_MS)), ms), F.when(unit == k, 0.0).otherwise(AGAINST_RULE)) for k, ms in units.items()),
    )
    return df.withColumn("readings", F.coalesce(F.filter(F.concat(words, plain), lambda r: r["ms"].isNotNull()), F.array().cast(_CANDIDATES)))


# A reading is (fmt, ms, cost), a state (fmt, ms); costs of a vector are those up to a state.

Reading = tuple[str, int, float]


def _step(a: tuple, b: tuple) -> float:
    return SWITCH * (a[0] != b[0]) + BACKWARD * (b[1] < a[1] - _BACK_MS)


def choose(readings: list[list[Reading]], before: list[Reading] | None = None, after: list[Reading] | None = None) -> list[int]:
    """Indices of the cheapest path through consecutive values' readings.

    ``before`` and ``after`` are the states on either side with the costs of
    reaching them from there. Ties go to the earlier reading in the array.
    """
    values = [v for v in (before, *readings, after) if v]
    if not values:
        return []
    costs = [o[2] for o in values[0]]
    back: list[list[int]] = []
    for last, options in zip(values, values[1:]):
        now, links = [], []
        for o in options:
            steps = [costs[i] + _step(s, o) for i, s in enumerate(last)]
            link = min(range(len(steps)), key=steps.__getitem__)
            now.append(steps[link] + o[2])
            links.append(link)
        costs = now
        back.append(links)
    at = min(range(len(costs)), key=costs.__getitem__)
    path = [at]
    for links in reversed(back):
        at = links[at]
        path.append(at)
    path.reverse()
    return path[bool(before) : len(path) - bool(after)]


def _useful(record_id: str, options: list[dict]) -> list[Reading]:
    """The readings without those that no path can make up for."""
    if len(options) == 1:
        return [(options[0]["fmt"], options[0]["ms"], 0.0)]
    least = min(o["cost"] for o in options)
    kept = [o for o in options if o["cost"] - least <= _MOST_GAIN]
    # equal paths are told apart by the record, not by where a block ends
    salt = zlib.crc32(record_id.encode()) / 2**32
    return [(o["fmt"], o["ms"], o["cost"] - least + _TIE * i * (1 + salt)) for i, o in enumerate(kept)]


class Summary:
    """States of the first and last value of a stretch and the cost of the cheapest path between each two."""

    def __init__(self, first: list, last: list, m: list[list[float]]):
        self.first, self.last, self.m = first, last, m

    @staticmethod
    def of(values: list[list[Reading]]) -> Summary:
        """Of consecutive values, at least one."""
        inf = float("inf")
        m = [[o[2] if i == j else inf for j, o in enumerate(values[0])] for i in range(len(values[0]))]
        for last, options in zip(values, values[1:]):
            steps = [[_step(a, b) + b[2] for b in options] for a in last]
            m = [[min(c + step[j] for c, step in zip(row, steps)) for j in range(len(options))] for row in m]
        return Summary([o[:2] for o in values[0]], [o[:2] for o in values[-1]], m)

    def then(self, other: Summary) -> Summary:
        link = [[_step(a, b) for b in other.first] for a in self.last]
        over = [[min(row[j] + link[j][k] for j in range(len(link))) for k in range(len(other.first))] for row in self.m]
        return Summary(self.first, other.last, [[min(row[k] + other.m[k][n] for k in range(len(other.first))) for n in range(len(other.last))] for row in over])

    def forward(self, before: list[Reading] | None) -> list[Reading]:
        """States of the last value with the costs of reaching them."""
        start = [min(b[2] + _step(b, f) for b in before) for f in self.first] if before else [0.0] * len(self.first)
        return _levelled(self.last, [min(s + row[j] for s, row in zip(start, self.m)) for j in range(len(self.last))])

    def backward(self, after: list[Reading] | None) -> list[Reading]:
        """States of the first value with the costs of what follows from them."""
        end = [min(a[2] + _step(x, a) for a in after) for x in self.last] if after else [0.0] * len(self.last)
        return _levelled(self.first, [min(c + e for c, e in zip(row, end)) for row in self.m])


def _levelled(states: list, costs: list[float]) -> list[Reading]:
    least = min(costs)
    return [(*s, c - least) for s, c in zip(states, costs)]


_ROWS = "tag int, record_id string, epoch_ms long, n_readings int, source string, block long, at long, data binary"
_TYPES = (pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary())
_NAMES = [x.split()[0] for x in _ROWS.split(", ")]
#: Rows of the steps: settled, open, a stretch's summary, what reaches a stretch.
_DONE, _OPEN, _SUMMARY, _CONTEXT = range(4)


def _batched(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _TYPES)], names=_NAMES)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _TYPES)], names=_NAMES)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _settle_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Settle sorted rows between fixed values of a block; hand on the rest and a summary.

    Open rows carry the fixed value on their inner side: that after the head,
    that before the tail, none in a block without fixed values.
    """

    def rows() -> Iterator[tuple]:
        for (source, block), group in groupby(_rows(batches), lambda r: r[:2]):
            fixed: list[Reading] | None = None
            head: Summary | None = None
            run: list[tuple] = []
            number = 0

            def kept_open(before: list | None, after: list | None, run=run, source=source, block=block) -> Iterator[tuple]:
                for rid, at, n, options in run:
                    yield _OPEN, rid, None, n, source, block, at, pickle.dumps((before, after, options))

            for _, _, rid, found in group:
                if not found:
                    continue
                options = _useful(rid, found)
                number += 1
                if len(options) > 1:
                    run.append((rid, number, len(found), options))
                    continue
                if not fixed:
                    head = Summary.of([*(o for *_, o in run), options])
                    yield from kept_open(None, options)
                elif run:
                    for (r, _, n, o), k in zip(run, choose([o for *_, o in run], fixed, options)):
                        yield _DONE, r, o[k][1], n, source, block, None, None
                run.clear()
                fixed = options
                yield _DONE, rid, options[0][1], len(found), source, block, None, None
            yield from kept_open(fixed, None)
            if number:
                tail = Summary.of([*([fixed] if fixed else ()), *(o for *_, o in run)])
                # what lies between two fixed values adds the same to every path
                whole = Summary(head.first, tail.last, [[row[0] + c for c in tail.m[0]] for row in head.m]) if head else tail
                yield _SUMMARY, None, None, 0, source, block, None, pickle.dumps(whole)

    return _batched(rows())


def _compose_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One summary of each sorted group; ``block`` comes out as the group's number."""

    def rows() -> Iterator[tuple]:
        for (source, number), members in groupby(_rows(batches), lambda r: r[:2]):
            whole: Summary | None = None
            for *_, data in members:
                s = pickle.loads(data)
                whole = s if whole is None else whole.then(s)
            yield _SUMMARY, None, None, 0, source, number, None, pickle.dumps(whole)

    return _batched(rows())


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each summary of a sorted group, the costs that reach it from both sides.

    A row of the group's own context, if any, comes first.
    """

    def rows() -> Iterator[tuple]:
        for (source, _), members in groupby(_rows(batches), lambda r: r[:2]):
            before = after = None
            found: list[tuple[int, Summary]] = []
            for _, _, tag, number, data in members:
                if tag == _CONTEXT:
                    before, after = pickle.loads(data)
                else:
                    found.append((number, pickle.loads(data)))
            reach = []
            for _, s in found:
                reach.append(before)
                before = s.forward(before)
            for (number, s), b in zip(reversed(found), reversed(reach)):
                yield _CONTEXT, None, None, 0, source, number, -1, pickle.dumps((b, after))
                after = s.backward(after)

    return _batched(rows())


def _settle_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Settle what is open at a block's edges; the block's context comes first."""

    def rows() -> Iterator[tuple]:
        for _, members in groupby(_rows(batches), lambda r: r[:2]):
            reach: tuple = (None, None)
            runs: dict[bool, list[tuple]] = {}
            sides: dict[bool, tuple] = {}
            for source, block, at, rid, n, data in members:
                if at < 0:
                    reach = pickle.loads(data)
                    continue
                before, after, options = pickle.loads(data)
                runs.setdefault(before is None, []).append((rid, n, options))
                sides[before is None] = (before, after)
            for side, run in runs.items():
                before, after = (inner or outer for inner, outer in zip(sides[side], reach))
                for (rid, n, o), k in zip(run, choose([o for *_, o in run], before, after)):
                    yield _DONE, rid, o[k][1], n, source, block, None, None

    return _batched(rows())


def even_span(df: DataFrame, order: Column, records: int = BLOCK_RECORDS) -> int:
    """Width of ``order`` that holds so many rows on average; of an empty table 1."""
    r = df.select(order.cast("long").alias("at")).agg(F.min("at"), F.max("at"), F.count("at")).first()
    return max(1, int((r[1] - r[0]) * records // r[2])) if r[2] else 1


def normalize_instants(df: DataFrame, record_id: Column, value: Column, source: Column, order: Column, tz: Column, date_order: Column, span: int | Column) -> DataFrame:
    """``record_id``, ``epoch_ms``, ``n_readings`` of each record with a readable time.

    ``source`` names the sequence a record belongs to and ``order`` (long) its
    place there; ``span`` cuts a source's sequence into blocks of that width,
    so that a source with a third of all rows is many tasks. The result does
    not depend on it. Records are taken once however often they repeat (the
    smallest value string wins). NULL ids give no row; NULL order sorts first,
    and records of equal order follow by id. An empty table gives no row.
    """
    span = F.lit(span) if isinstance(span, int) else span
    raw = df.select(record_id.cast("string").alias("record_id"), value.cast("string").alias("value"), source.cast("string").alias("source"), order.cast("long").alias("at"), tz.alias("tz"), date_order.alias("date_order"), span.cast("long").alias("span"))
    # ids of repeats meet in one task anyway; the value is short
    once = raw.filter("record_id is not null and value is not null").groupBy("record_id").agg(F.min(F.struct("value", "at", "source", "tz", "date_order", "span")).alias("r")).select("record_id", "r.*")
    at = F.coalesce("at", F.lit(0))
    read = once.select("record_id", F.coalesce("source", F.lit("")).alias("source"), at.alias("at"), F.floor(at / F.col("span")).cast("long").alias("block"), "value", "tz", "date_order")
    # no filter on readings: pushed below the projections it would repeat every step
    ordered = with_readings(read).select("record_id", "source", "block", "at", "readings").repartition("source", "block").sortWithinPartitions("source", "block", "at", "record_id").select("source", "block", "record_id", "readings")
    parts = checkpointed(ordered.mapInArrow(_settle_blocks, _ROWS))

    # the scan: summaries of blocks to those of groups, to the source, and back
    c = F.col
    blocks = parts.filter(c("tag") == _SUMMARY).select("source", F.floor(c("block") / F.lit(GROUP_BLOCKS)).cast("long").alias("part"), "tag", "block", "data")
    groups = blocks.select("source", "part", "block", "data").repartition("source", "part").sortWithinPartitions("source", "part", "block").mapInArrow(_compose_groups, _ROWS)
    above = groups.select("source", F.lit(0).cast("long").alias("part"), "tag", "block", "data").repartition("source").sortWithinPartitions("source", "block").mapInArrow(_contexts, _ROWS)
    below = blocks.unionByName(above.select("source", c("block").alias("part"), "tag", "block", "data"))
    reach = below.repartition("source", "part").sortWithinPartitions("source", "part", F.desc("tag"), "block").mapInArrow(_contexts, _ROWS)
    open_ = parts.filter(c("tag") == _OPEN).unionByName(reach).select("source", "block", "at", "record_id", "n_readings", "data")
    settled = open_.repartition("source", "block").sortWithinPartitions("source", "block", "at").mapInArrow(_settle_open, _ROWS)
    return parts.filter(c("tag") == _DONE).unionByName(settled).select("record_id", "epoch_ms", "n_readings")
