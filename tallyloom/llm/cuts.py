"""Texts cut by a field limit or a broken transfer.

Lengths in characters and in bytes are counted per source; the hazard of every
length (texts that end there out of those that get as far) is tested against
that of its neighbours, with control of the false discovery rate over all of
them. Endings are classed by what stands last. Two rules flag a text:

``limit``: it stands at a significant length, or at a byte limit less the
character that no longer fitted, and its ending is incomplete. There a link,
tag or heading is incomplete too.

``transfer``: a transfer breaks at any length, so no hazard shows it; the
ending alone decides, by an unfinished sentence or the debris of a cut.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lengths on either side that a hazard is held against.
NEIGHBOURS = 25
#: The false discovery rate, and how many times the neighbours' hazard and what
#: share of the texts reaching it a limit stops at least. The last two judge a
#: discovery's size after the test: with enough texts any cluster is significant.
FDR, TIMES, STOPPED = 0.001, 5.0, 0.2
#: Bytes that a character broken by a byte limit takes off, or adds as its replacement.
BROKEN = 3

_END = "。！？!?.．｡‼⁇⁈"
#: White space and invisible characters that may follow the end.
_BLANK = " \t\n\r\f\v\u00a0\u3000\u200b\u200c\u2060\ufeff"
_CLOSE = "”’\"'」』）)】》〉\\]»"
#: Debris of a cut: a broken character, half an entity, escape or tag, a
#: marker that more follows.
DEBRIS = r"(\x{FFFD}+|&[A-Za-z]{1,7}|&#[0-9xX]?[0-9A-Fa-f]{0,5}|\\u[0-9A-Fa-f]{0,3}|\\x[0-9A-Fa-f]?|<\/?[A-Za-z]{0,10}|%[0-9A-Fa-f]?|(…|\.{3}|。{3})\s*[\[【(（]?\s*(展开|展开全文|全文|更多|查看更多|查看全文|阅读全文|未完|待续|未完待续|more|read more|see more|show more|continue reading|continued|ver más|leer más)\s*[\]】)）]?|[\[【(（]\s*(more|truncated|cut|未完|待续|未完待续|下文略)\s*[\]】)）])$"
#: Endings that are complete without a full stop, on the last line.
_EMOJI = r"[\x{2190}-\x{21FF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{1F000}-\x{1FAFF}\x{FE0F}\x{200D}\x{2764}]"
TAG = r"(^|[\s。！？.!?…])#[^\s#]+#?$"
LINK = r"https?://[^\s]+$|www\.[^\s]+$"
SIGNATURE = r"(^|[\n\s。！？.!?])(——|—|--|–)\s*[^\n。！？]{1,30}$"
COUNTER = r"(^|[\n\s。！？.!?…])(赞|点赞|转发|评论|收藏|回复|浏览|阅读|播放|分享|likes?|views?|replies|shares?|me gusta|respuestas)\s*[:：]?\s*[0-9][0-9,.]*\s*(万|k|K)?$|(^|[\n。！？.!?…])\s*[0-9][0-9,.]*\s*(赞|点赞|转发|评论|收藏|回复|浏览|阅读|播放|likes?|views?|replies|shares?)$"
CLOSING = r"[（(\[【]\s*(完|全文完|本文完|终|end|the end|fin|fine)\s*[）)\]】]$|(^|\n)\s*(完|全文完|end|the end|fin)$"


def ending(text: Column) -> Column:
    """Class of a text's end: debris, sentence, dots, emoji, tag, link, signature, counter, closing, heading or open."""
    # a link or tag is the last token, however long; what else ends a text is short
    whole = F.rtrim(text, F.lit(_BLANK))
    token = F.reverse(F.split(F.reverse(whole), r"\s", 2)[0])
    tail = F.substring(whole, -160, 160)
    has = lambda p: tail.rlike(p)
    return (
        F.when(has("(?i)" + DEBRIS), "debris")
        .when(has("(?i)" + CLOSING), "closing")
        .when(has(rf"(…|\.{{3}}|。{{3}})[{_CLOSE}]?$"), "dots")
        .when(has(rf"[{_END}][{_CLOSE}]*$"), "sentence")
        .when(has(_EMOJI + r"$"), "emoji")
        .when(has(r"[\[［][^\[\]\s]{1,6}[\]］]$"), "emoji")
        .when(token.rlike(LINK), "link")
        .when(token.rlike(TAG), "tag")
        .when(has("(?i)" + COUNTER), "counter")
        .when(has(SIGNATURE), "signature")
        # a text without any sentence end or comma is a heading
        .when(~text.rlike(rf"[{_END}…，,；;][\s\S]*\S") & ~has("[，,、；;：:]$"), "heading")
        .otherwise("open")
    )


def _poisson_tail(n: int, mean: float) -> float:
    """P(X >= n) of a Poisson variable, its terms summed from n on."""
    if mean <= 0:
        return 0.0 if n > 0 else 1.0
    term = math.exp(-mean + n * math.log(mean) - math.lgamma(n + 1))
    total, k = 0.0, n
    while term > total * 1e-12 and k < n + 10_000:
        total += term
        k += 1
        term *= mean / k
    return min(1.0, total)


def significant_lengths(lengths: DataFrame, fdr: float = FDR, neighbours: int = NEIGHBOURS) -> DataFrame:
    """``source``, ``unit``, ``length``: lengths at which more texts end than near it.

    ``lengths`` has source, unit, length and n, one row per length met; each
    of them is tested. Empty input gives no row.
    """
    # windows run over distinct lengths, not over texts; units keep apart
    to_end = Window.partitionBy("source", "unit").orderBy("length").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    near = Window.partitionBy("source", "unit").orderBy("length").rangeBetween(-neighbours, neighbours)
    hazards = lengths.withColumn("at_risk", F.sum("n").over(to_end)).withColumn("near_n", F.sum("n").over(near) - F.col("n"))
    # hazard of the neighbours: ends near it over those that got to its start
    first_risk = F.max("at_risk").over(near)
    hazards = hazards.withColumn("expected", (F.col("near_n") + 1.0) / (2 * neighbours) * F.col("at_risk") / F.greatest((first_risk + F.col("at_risk")) / 2.0, F.lit(1.0)))

    def tails(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(p=[_poisson_tail(int(n), float(e)) for n, e in zip(f.n, f.expected)])

    p = hazards.select("source", "unit", "length", "n", "at_risk", "expected").mapInPandas(tails, "source string, unit string, length long, n long, at_risk long, expected double, p double")
    # Benjamini and Hochberg: all p up to the greatest rank that holds
    by_p = Window.partitionBy("source", "unit").orderBy("p", "length")
    every = Window.partitionBy("source", "unit")
    ranked = p.withColumn("rank", F.row_number().over(by_p)).withColumn("tests", F.count("*").over(every))
    ranked = ranked.withColumn("last", F.max(F.when(F.col("p") <= F.lit(fdr) * F.col("rank") / F.col("tests"), F.col("rank"))).over(every))
    found = ranked.filter(F.col("rank") <= F.col("last"))
    return found.filter((F.col("n") >= TIMES * F.col("expected")) & (F.col("n") >= F.lit(STOPPED) * F.col("at_risk"))).select("source", "unit", "length")


def classed(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``source``, both lengths and the class of the ending, one row per doc_id."""
    text = F.col("text").cast("string")
    d = documents.filter(F.col("doc_id").isNotNull() & text.isNotNull() & (F.trim(text) != ""))
    d = d.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.length(text).cast("long").alias("chars"), F.octet_length(text).cast("long").alias("bytes"), ending(text).alias("ending"))
    return d.groupBy("doc_id").agg(F.min(F.struct("source", "chars", "bytes", "ending")).alias("r")).select("doc_id", "r.*")


def judged(documents: DataFrame, fdr: float = FDR) -> DataFrame:
    """``doc_id``, ``source``, ``ending`` and ``rule``: limit, transfer, or NULL for a text that was not cut."""
    d = classed(documents)
    lengths = d.select("source", F.explode(F.create_map(F.lit("chars"), "chars", F.lit("bytes"), "bytes")).alias("unit", "length")).groupBy("source", "unit", "length").agg(F.count("*").alias("n"))
    limits = significant_lengths(lengths, fdr)
    # a byte limit also explains the lengths that a broken character leaves
    spread = F.when(F.col("unit") == "bytes", F.sequence(F.lit(-BROKEN), F.lit(BROKEN - 1))).otherwise(F.array(F.lit(0)))
    limits = limits.select("source", "unit", "length", F.explode(spread).alias("off")).groupBy("source", "unit", (F.col("length") + F.col("off")).alias("length")).agg(F.bool_or(F.col("off") == 0).alias("exact"))
    mark = lambda unit: limits.filter(F.col("unit") == unit).select("source", F.col("length").alias(unit), F.col("exact").alias(f"{unit}_limit"))
    # few rows: the planner broadcasts them if their size at run time allows
    at = d.join(mark("chars"), ["source", "chars"], "left").join(mark("bytes"), ["source", "bytes"], "left")
    near, exact = F.col("chars_limit").isNotNull() | F.col("bytes_limit").isNotNull(), F.coalesce("chars_limit", F.lit(False)) | F.coalesce("bytes_limit", F.lit(False))
    broken = F.col("ending").isin("debris", "open")
    # what looks complete is cut only at the very length of a limit
    rule = F.when((near & broken) | (exact & F.col("ending").isin("link", "tag", "heading")), "limit").when(broken, "transfer")
    return at.select("doc_id", "source", "ending", rule.alias("rule"))


def find_cuts(documents: DataFrame, fdr: float = FDR) -> DataFrame:
    """``doc_id``, ``source``, ``ending``, ``rule`` of the texts that were cut.

    NULL and blank texts are not cut. A document delivered again counts once
    (smallest source, length). A NULL source is one source. At a significant
    length a link, tag or heading that ends there counts as cut; complete
    sentences, emoji, closing notes, counters and signatures do not. An empty
    table gives no row.
    """
    return judged(documents, fdr).filter("rule is not null")


def cut_rates(documents: DataFrame, fdr: float = FDR) -> DataFrame:
    """``source``, ``n_documents``, ``n_cut``, ``n_limit``, ``share_cut``; documents with text only."""
    n = judged(documents, fdr).groupBy("source").agg(F.count("*").alias("n_documents"), F.count("rule").alias("n_cut"), F.count_if(F.col("rule") == "limit").alias("n_limit"))
    return n.withColumn("share_cut", F.round(F.col("n_cut") / F.col("n_documents"), 6))
