"""Settings, times, lists and JSON of single records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens of switches, and the notations of local times, first success wins.
ON, OFF = ("true", "1", "yes", "y", "on"), ("false", "0", "no", "n", "off")
LOCAL_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd")


def optional_bool(c: Column) -> Column:
    """true, false, or NULL for anything else."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin(*ON), True).when(t.isin(*OFF), False)


def optional_int(c: Column) -> Column:
    """A positive whole number, else NULL."""
    n = F.trim(c.cast("string")).try_cast("long")
    return F.when(n > 0, n)


def alias_map(aliases: Mapping[str, str] | None) -> dict[str, str]:
    """Aliases without any spaces; blank keys and values are dropped."""
    strip = lambda s: str(s).strip().replace(" ", "").replace("　", "")
    return {strip(k): strip(v) for k, v in (aliases or {}).items() if strip(k) and strip(v)}


def local_time(c: Column, tz: str = "Asia/Shanghai") -> Column:
    """Instant of a local time in the first notation that fits."""
    t = F.trim(c)
    # a parser may take a prefix for the whole: the shape must fit too
    shapes = {f: "^" + "".join(r"\d" if x.isalpha() else x for x in f) + "$" for f in LOCAL_FORMATS}
    wall = F.coalesce(*(F.when(t.rlike(s), F.try_to_timestamp(t, F.lit(f)).cast("timestamp_ntz")) for f, s in shapes.items()))
    return F.to_utc_timestamp(wall.cast("timestamp"), tz)


def iso_time(c: Column) -> Column:
    """Instant of an ISO time; one without a zone is UTC."""
    t = F.trim(c)
    zoned = t.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & t.contains(":")
    return F.coalesce(F.when(zoned, t.try_cast("timestamp")), F.when(~zoned, F.concat(F.when(F.length(t) == 10, F.concat(t, F.lit("T00:00:00"))).otherwise(t), F.lit("Z")).try_cast("timestamp")))


def time_range(c: Column) -> Column:
    """Struct of start and end from ``start:end`` of dates, either end open; no colon is a start."""
    t = F.trim(c)
    parts = F.split(t, ":", 2)
    end = F.when(F.size(parts) > 1, parts[1])
    return F.struct(iso_time(F.nullif(F.trim(parts[0]), F.lit(""))).alias("start"), iso_time(F.nullif(F.trim(end), F.lit(""))).alias("end"))


def epoch_time(c: Column) -> Column:
    """Instant of epoch seconds; 0 is NULL."""
    return F.timestamp_seconds(F.nullif(c.cast("long"), F.lit(0)))


def month_or_missing(c: Column) -> Column:
    """Month of a time, MISSING where it has none."""
    return F.coalesce(F.date_format(c.try_cast("timestamp"), "yyyy-MM"), F.lit("MISSING"))


def millis_to_seconds(c: Column) -> Column:
    return F.round(c.cast("double") / 1000, 3)


def cues(c: Column, most: int = 3) -> Column:
    """First non-blank strings of a list, trimmed; a NULL list is empty."""
    kept = F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.slice(kept, 1, most), F.array().cast("array<string>"))


def json_cues(c: Column, path: str, most: int = 3) -> Column:
    """The cues of a list inside a JSON text."""
    return cues(F.try_variant_get(F.try_parse_json(c), path, "array<string>"), most)


def envelope_items(c: Column) -> Column:
    """The list in a JSON text: itself, or under items, results or data."""
    v = F.try_parse_json(c)
    return F.coalesce(*(F.try_variant_get(v, p, "array<variant>") for p in ("$", "$.items", "$.results", "$.data")))


def message_text(c: Column) -> Column:
    """Content of the first choice of a reply: a string, or its text parts by line."""
    v = F.try_parse_json(c)
    parts = F.try_variant_get(v, "$.choices[0].message.content", "array<variant>")
    text = F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.try_variant_get(p, "$", "string"))), "\n")
    return F.trim(F.coalesce(text, F.try_variant_get(v, "$.choices[0].message.content", "string")))


def joined_list(c: Column, by: str = "|") -> Column:
    """A list as one string."""
    return F.array_join(c, by)


def shares_json(labels: Column, shares: Column) -> Column:
    """A map of shares, greatest first, as JSON."""
    pairs = F.reverse(F.array_sort(F.arrays_zip(shares.alias("s"), labels.alias("l"))))
    return F.to_json(F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["l"], p["s"]))))


def resolved_path(path: Column, roots: Sequence[tuple[str, Column]]) -> Column:
    """An absolute path, else under the first root that has it, else under the first root.

    ``roots`` pairs a root with a column that says whether the path is there.
    """
    at = lambda root: F.concat(F.lit(root.rstrip("/") + "/"), path)
    out = at(roots[0][0])
    for root, there in list(roots)[::-1]:
        out = F.when(F.coalesce(there, F.lit(False)), at(root)).otherwise(out)
    return F.when(path.startswith("/"), path).otherwise(out)


def inferred_status(status: Column, attempts: Column) -> Column:
    """The status given, else failed if there were attempts, else pending."""
    s = F.nullif(F.lower(F.trim(status)), F.lit(""))
    return F.coalesce(s, F.when(F.coalesce(attempts, F.lit(0)) > 0, "failed").otherwise("pending"))


def holds_any(c: Column, words: Sequence[str]) -> Column:
    """Whether a payload mentions any of the words, case aside."""
    t = F.lower(F.coalesce(c, F.lit("")))
    return F.exists(F.array(*(F.lit(w.lower()) for w in words)), lambda w: F.contains(t, w))


def available(cooldown_until: Column, now: Column, disabled: Column | None = None) -> Column:
    """Whether a resource may be used: not disabled, no cooldown or one that is over."""
    free = cooldown_until.isNull() | (cooldown_until <= now)
    return free if disabled is None else free & ~F.coalesce(disabled, F.lit(False))


def picked_url(raw: Column, own: Column) -> Column:
    """First http address of the play, download and bit rate lists of a payload, else the column's own."""
    listed = lambda c, path: F.coalesce(F.from_json(F.get_json_object(c, path), "array<string>"), F.array().cast("array<string>"))
    rates = F.flatten(F.transform(listed(raw, "$.video.bit_rate"), lambda x: listed(x, "$.play_addr.url_list")))
    every = F.concat(listed(raw, "$.video.play_addr.url_list"), listed(raw, "$.video.download_addr.url_list"), rates)
    return F.coalesce(F.try_element_at(F.filter(every, lambda u: F.startswith(u, F.lit("http"))), F.lit(1)), F.when(F.startswith(own, F.lit("http")), own))


def flat_pages(pages: DataFrame, payload: str, items: str = "$.data") -> DataFrame:
    """One row per item of a page with ``record`` as JSON: its own, else the first of its mix; none without either."""
    item = F.explode(F.from_json(F.get_json_object(payload, items), "array<string>")).alias("_item")
    d = pages.select(*(c for c in pages.columns if c != payload), item)
    filled = lambda c: F.when(~c.isin("{}", "null"), c)
    mixed = F.try_element_at(F.from_json(F.get_json_object("_item", "$.aweme_mix_info.mix_items"), "array<string>"), F.lit(1))
    return d.withColumn("record", F.coalesce(filled(F.get_json_object("_item", "$.aweme_info")), mixed)).filter("record is not null").drop("_item")


def matching(df: DataFrame, wanted: dict[str, str | None]) -> DataFrame:
    """Rows whose columns, trimmed and in lower case, are as wanted; a condition that is not given does not filter."""
    for column, value in wanted.items():
        if value is not None and value.strip():
            df = df.filter(F.lower(F.trim(F.col(column))) == value.strip().lower())
    return df
