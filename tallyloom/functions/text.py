"""Text scalars as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the cleaners see it: Unicode, not only ASCII.
SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

#: Links, mentions, and topics with or without a closing mark.
LINK = "(?i)" + r"https?://[^{s}]+|www\.[^{s}]+".replace("{s}", SPACE[1:-1])
MENTION = r"@[A-Za-z0-9_\-\x{4E00}-\x{9FFF}]+"
TOPIC = r"#([^#{s}]+)#?".replace("{s}", SPACE[1:-1])


def clean(c: Column) -> Column:
    """Drop byte-order and zero-width marks, collapse white space, strip."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[\x{FEFF}\x{200B}\x{200D}]", ""), SPACE + "+", " "))


def clean_block(c: Column, words_as_null: bool = True) -> Column:
    """Spaces and tabs collapsed, blank lines capped at one, "nan" and "none" blank."""
    t = F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("　"), F.lit(" ")), r"\r\n?", "\n"), r"[ \t]+", " ")
    t = F.trim(F.regexp_replace(t, r"\n{3,}", "\n\n"))
    t = F.regexp_replace(t, r"^\s+|\s+$", "")
    if words_as_null:
        t = F.when(F.lower(t).isin("nan", "none"), "").otherwise(t)
    return F.coalesce(t, F.lit(""))


def compare_key(c: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def symbol_only(c: Column) -> Column:
    """Whether a text holds nothing but punctuation, symbols and white space."""
    return F.coalesce(c.rlike(r"(?U)^[\p{P}\p{S}\s]*$"), F.lit(True))


def mask_for_analysis(c: Column) -> Column:
    """Links, mentions and #topics# replaced by tags; NULL becomes empty."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), LINK, " <URL> ")
    t = F.regexp_replace(t, MENTION, " <MENTION> ")
    t = F.regexp_replace(t, TOPIC, r" <TOPIC:$1> ")
    return F.trim(F.regexp_replace(t, SPACE + "+", " "))


def mask_links(c: Column) -> Column:
    """Links replaced by a tag, spaces collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), LINK, " <URL> "), SPACE + "+", " "))


def count_term(c: Column, term: str) -> Column:
    """Non-overlapping occurrences of one term."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(term), F.lit("")))) / F.lit(len(term))).cast("int")


def _quoted(t: str) -> str:
    """A SQL string literal; a constant array parsed at once is much cheaper to build than by calls."""
    return "'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'"


def weigh_terms(c: Column, weights: Sequence[tuple[str, int]], guard: str | None = None) -> Column:
    """Occurrences of each term times its weight, summed; give it a column, not an expression.

    One loop over a literal array, so that a lexicon of any length is one
    small piece of code; a text with none of the terms skips it. ``guard`` is
    a pattern found wherever a term is, if there is one tighter than the terms.
    """
    if not weights:
        return F.lit(0)
    table = F.expr("array(" + ", ".join(f"named_struct('t', {_quoted(t)}, 'w', {w}, 'n', {len(t)})" for t, w in weights) + ")")
    total = F.aggregate(table, F.lit(0), lambda acc, x: acc + x["w"] * ((F.length(c) - F.length(F.replace(c, x["t"], F.lit("")))) / x["n"]).cast("int"))
    # the shortest terms that all others contain decide whether to look at all
    short: list[str] = []
    for t in sorted({t for t, _ in weights}, key=lambda t: (len(t), t)):
        if not any(s in t for s in short):
            short.append(t)
    return F.when(c.rlike(guard or "|".join(re.escape(t) for t in short)), total).otherwise(F.when(c.isNotNull(), F.lit(0)))


def count_terms(c: Column, terms: Sequence[str]) -> Column:
    """Non-overlapping occurrences of each term, summed over the terms."""
    return weigh_terms(c, [(t, 1) for t in terms])


def matched_terms(c: Column, terms: Sequence[str]) -> Column:
    """The terms a text contains, in the order given."""
    every = F.expr("array(" + ", ".join(map(_quoted, terms)) + ")") if terms else F.array().cast("array<string>")
    return F.filter(every, lambda t: F.contains(c, t))


def any_term(c: Column, terms: Sequence[str]) -> Column:
    """Whether a text contains any of the terms."""
    return F.size(matched_terms(c, terms)) > 0


def stable_id(*parts: Column) -> Column:
    """First 16 hex digits of the md5 of the parts joined by ``::``."""
    return F.substring(F.md5(F.concat_ws("::", *(p.cast("string") for p in parts))), 1, 16)


def lines(c: Column) -> Column:
    """Non-blank lines, trimmed."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[\r\n]+"), lambda x: F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")), lambda x: x != "")


def dedup_lines(c: Column) -> Column:
    """Lines whose key was not seen before, by exact key or containment of long ones; first wins."""
    keyed = F.transform(lines(c), lambda x: F.struct(x.alias("line"), compare_key(x).alias("key")))

    def step(acc: Column, x: Column) -> Column:
        seen = F.exists(acc, lambda a: (a["key"] == x["key"]) | ((F.length(a["key"]) >= 24) & (F.length(x["key"]) >= 24) & (F.contains(a["key"], x["key"]) | F.contains(x["key"], a["key"]))))
        return F.when(seen | (x["key"] == ""), acc).otherwise(F.concat(acc, F.array(x)))

    none = F.array().cast("array<struct<line:string,key:string>>")
    return F.array_join(F.transform(F.aggregate(keyed, none, step), lambda x: x["line"]), "\n")


def merged_lines(*texts: Column) -> Column:
    """Texts one below the other with repeated lines dropped."""
    return dedup_lines(F.concat_ws("\n", *(F.coalesce(t, F.lit("")) for t in texts)))


def compose_sections(sections: Sequence[tuple[str, Column]]) -> Column:
    """Labelled sections joined by blank lines; one whose key was seen is dropped."""
    given = F.filter(F.array(*(F.struct(F.lit(label).alias("label"), F.coalesce(c, F.lit("")).alias("body"), compare_key(F.coalesce(c, F.lit(""))).alias("key")) for label, c in sections)), lambda s: s["key"] != "")
    none = F.array().cast("array<struct<label:string,body:string,key:string>>")
    kept = F.aggregate(given, none, lambda acc, s: F.when(F.exists(acc, lambda a: a["key"] == s["key"]), acc).otherwise(F.concat(acc, F.array(s))))
    return F.array_join(F.transform(kept, lambda s: F.concat(F.lit("【"), s["label"], F.lit("】\n"), s["body"])), "\n\n")


def slug(c: Column) -> Column:
    """Safe file name: anything but letters, digits, ``_`` and ``-`` becomes ``_``."""
    return F.regexp_replace(c, "[^A-Za-z0-9_-]", "_")


def first_filled(*cols: Column) -> Column:
    """First column that is not blank after cleaning, else empty."""
    return F.coalesce(*(F.nullif(clean(c), F.lit("")) for c in cols), F.lit(""))


def joined_fields(*cols: Column) -> Column:
    """Non-blank trimmed fields joined by one space."""
    return F.concat_ws(" ", *(F.nullif(F.trim(c), F.lit("")) for c in cols))


def ngrams(c: Column, low: int, high: int, chunk: str = r"[\x{4E00}-\x{9FFF}]+") -> Column:
    """Distinct n-grams of each maximal chunk of the class, n from low to high."""
    chunks = F.regexp_extract_all(c, F.lit(f"({chunk})"), F.lit(1))

    def of_length(x: Column, n: int) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.length(x) - n + 1), lambda i: F.substring(x, i, F.lit(n)))
        return F.when(F.length(x) >= n, parts).otherwise(F.array().cast("array<string>"))

    def grams(x: Column) -> Column:
        return F.concat(*(of_length(x, n) for n in range(low, high + 1)))

    return F.array_distinct(F.flatten(F.transform(chunks, grams)))


def closed_label(c: Column, allowed: Sequence[str], aliases: dict[str, str] | None = None) -> Column:
    """Label of a closed vocabulary after stripping spaces and aliases; else NULL."""
    t = F.translate(c, " 　", "")
    for a, b in (aliases or {}).items():
        t = F.when(t == a, b).otherwise(t)
    return F.when(t.isin(*allowed), t)


def confidence_label(c: Column) -> Column:
    """high, medium or low; blank and unknown are low."""
    t = F.lower(F.trim(c))
    return F.when(t.isin("low", "medium", "high"), t).otherwise("low")


#: Tokens of binary labels.
TRUE_TOKENS = ("1", "anger", "angry", "愤怒", "是", "yes", "y", "true", "t", "pos", "positive")
FALSE_TOKENS = ("0", "non-anger", "non_anger", "nonanger", "非愤怒", "否", "no", "n", "false", "f", "neg", "negative")


def binary_label(c: Column, numeric: bool = False) -> Column:
    """1, 0 or NULL from a token in any of several languages, or from a number that is 1 or 0."""
    if numeric:
        return F.when(c == 1, 1).when(c == 0, 0)
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin(*TRUE_TOKENS), 1).when(t.isin(*FALSE_TOKENS), 0)


def level_label(c: Column) -> Column:
    """root, reply or the number with ``-level``."""
    return F.when(c == 1, "root").when(c == 2, "reply").otherwise(F.concat(c.cast("string"), F.lit("-level")))


def prefix_source(c: Column, known: Sequence[str]) -> Column:
    """First of the known prefixes a label starts with, else the text before ``_``."""
    out = F.split(c, "_", 2)[0]
    for p in reversed(known):
        out = F.when(c.startswith(p), p).otherwise(out)
    return out


def endpoint(c: Column, scheme: str = "http") -> Column:
    """Endpoint with a scheme; blank lines and comments are NULL."""
    t = F.trim(c)
    return F.when((t == "") | t.startswith("#"), F.lit(None)).when(t.contains("://"), t).otherwise(F.concat(F.lit(f"{scheme}://"), t))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, or 0.0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def sigmoid(c: Column, limit: float = 30.0) -> Column:
    """Logistic function of a value clipped to the limits."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(c.cast("double"), F.lit(limit)), F.lit(-limit))))


def softmax(scores: Sequence[Column]) -> list[Column]:
    """Softmax over a row's scores, stable against large ones."""
    top = F.greatest(*scores)
    parts = [F.exp(s - top) for s in scores]
    total = sum(parts[1:], parts[0])
    return [p / total for p in parts]


def recover_json(c: Column) -> Column:
    """The text, its outermost ``[...]`` or its outermost ``{...}``: the first that parses."""
    tries = (c, F.regexp_extract(c, r"(\[[\s\S]*\])", 1), F.regexp_extract(c, r"(\{[\s\S]*\})", 1))
    return F.coalesce(*(F.when(F.try_parse_json(t).isNotNull() & (F.trim(t) != ""), t) for t in tries))


def url_parts(c: Column) -> Column:
    """Scheme, host, port, path, query of an address; a missing scheme is read as http."""
    full = F.when(c.contains("://"), c).otherwise(F.concat(F.lit("http://"), c))
    part = lambda p: F.try_parse_url(full, F.lit(p))
    return F.struct(part("PROTOCOL").alias("scheme"), part("HOST").alias("host"), F.nullif(F.regexp_extract(full, r"^[a-z]+://[^/]*:(\d+)", 1), F.lit("")).cast("int").alias("port"), part("PATH").alias("path"), part("QUERY").alias("query"))


def p_value_text(c: Column) -> Column:
    """A p-value as it is printed."""
    return F.when(c.isNull(), "NA").when(c < 0.001, "<0.001").otherwise(F.format_string("%.3f", c))


def anger_probability(label: Column, prob: Column, anger: Column) -> Column:
    """The given probability, else rebuilt from the label and its own."""
    return F.coalesce(anger, F.when(label == 1, prob).when(label == 0, 1.0 - prob))
