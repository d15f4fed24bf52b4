"""Lexicon scores as Column expressions; the vocabulary is a parameter."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.text import any_term, count_terms, matched_terms, sigmoid, weigh_terms


@dataclass(frozen=True)
class Lexicon:
    """Terms of a sentiment and stance score."""

    positive: tuple[str, ...]
    negative: tuple[str, ...]
    support: tuple[str, ...] = ()
    oppose: tuple[str, ...] = ()
    target: tuple[str, ...] = ()
    negators: tuple[str, ...] = ()


#: The default vocabulary.
DEFAULT = Lexicon(
    positive=tuple("支持 赞成 同意 合理 理性 有必要 应该 应当 给机会 改过自新 人性化 公平 进步".split()),
    negative=tuple("反对 不同意 不该 不能 不应 纵容 洗白 太轻 太宽松 荒唐 离谱 恶心 愤怒 严惩 零容忍".split()),
    support=tuple("支持封存 赞成封存 同意封存 应该封存 应当封存 有必要封存 前科封存有必要 给一次机会 改过自新 教育挽救".split()),
    oppose=tuple("反对封存 不同意封存 不该封存 不能封存 不应封存 封存就是纵容 封存等于洗白 必须严惩 零容忍 从重处罚".split()),
    target=tuple("封存 前科 违法记录 治安管理处罚法 吸毒记录".split()),
    negators=tuple("不 没 无 别 未 并不".split()),
)
#: The vocabulary of the three categories and of the polarity beside them.
CATEGORIES = {
    "state": tuple("国家利益 法治 法律 禁毒 治理 秩序 公共安全 零容忍 严惩 执法 司法".split()),
    "freedom": tuple("自由权利 权利 人权 平等 隐私 机会 复归 歧视 改过自新 前科封存 记录封存".split()),
    "populism": tuple("老百姓 特权 权贵 双标 资本 阶层 普通人 民意 网友 愤怒 不公平".split()),
}
POLARITY = Lexicon(
    positive=tuple("支持 赞成 同意 合理 公平 有必要 应该 应当 机会 改过自新 进步 理性".split()),
    negative=tuple("反对 不同意 不该 不能 不应 纵容 洗白 离谱 荒唐 愤怒 恶心 严惩 零容忍".split()),
    negators=DEFAULT.negators,
)


def raw_sentiment(c: Column, lex: Lexicon) -> Column:
    """Positive less negative hits; each negator with a term takes the term's side back.

    Overlapping terms count once each, as the score is defined.
    """
    base = [(t, 1) for t in lex.positive] + [(t, -1) for t in lex.negative]
    turned = [(n + t, -2 * w) for n in lex.negators for t, w in base]
    if not turned:
        return weigh_terms(c, base).cast("double")
    # few texts hold a negated term: one scan spares the loop over all pairs
    either = lambda terms: "(?:" + "|".join(re.escape(t) for t in terms) + ")"
    return (weigh_terms(c, base) + weigh_terms(c, turned, either(lex.negators) + either([t for t, _ in base]))).cast("double")


def sentiment_score(c: Column, lex: Lexicon = DEFAULT) -> Column:
    """Raw sentiment, a tenth more with an exclamation mark."""
    raw = raw_sentiment(c, lex)
    return F.when(F.contains(c, F.lit("!")) | F.contains(c, F.lit("！")), raw * F.lit(1.1).cast("double")).otherwise(raw)


def sentiment_label(score: Column) -> Column:
    return F.when(score > 0.5, "positive").when(score < -0.5, "negative").otherwise("neutral")


def stance_score(c: Column, lex: Lexicon = DEFAULT) -> Column:
    """Support less oppose phrases, and with a target term the generic cues too."""
    phrases = count_terms(c, lex.support) - count_terms(c, lex.oppose)
    cues = F.when(any_term(c, lex.target), count_terms(c, lex.positive) - count_terms(c, lex.negative)).otherwise(0)
    return (phrases + cues).cast("double")


def stance_label(score: Column) -> Column:
    return F.when(score >= 1, "support").when(score <= -1, "oppose").otherwise("neutral")


def polarity(c: Column, lex: Lexicon = POLARITY) -> Column:
    """Logistic of the sentiment score; a blank text is 0.5."""
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(0.5)).otherwise(sigmoid(sentiment_score(c, lex), 700.0))


def intensity(value: Column, mean: Column) -> Column:
    return F.abs(value - mean)


def transmissibility(parent: Column, reply: Column) -> Column:
    return F.lit(1.0) - F.abs(parent - reply)


def category_cosines(c: Column, categories: dict[str, Sequence[str]]) -> dict[str, Column]:
    """Cosine of the term counts with each category's indicator."""
    every = sorted({t for terms in categories.values() for t in terms})
    hits = F.aggregate(F.transform(matched_terms(c, every), lambda t: (F.length(c) - F.length(F.replace(c, t, F.lit("")))) / F.length(t)), F.lit(0.0), lambda acc, n: acc + n * n)
    norm = F.sqrt(hits)
    return {k: F.when(norm == 0, F.lit(0.0)).otherwise(count_terms(c, terms) / (norm * F.sqrt(F.lit(float(len(set(terms))))))) for k, terms in categories.items()}


def stance_of(scores: dict[str, Column], least: float = 0.05, eps: float = 1e-12) -> Column:
    """Struct of label, strength, gap and polarization.

    The label is the first of the highest scores, neutral below ``least``;
    the gap is to the second; polarization is one less the entropy of the
    shares over its maximum, 0 for neutral.
    """
    names, cols = list(scores), list(scores.values())
    top = F.greatest(*cols)
    label = F.lit(names[-1])
    for n, s in list(zip(names, cols))[-2::-1]:
        label = F.when(s == top, n).otherwise(label)
    ordered = F.sort_array(F.array(*cols), asc=False)
    total = sum(cols[1:], cols[0])
    share = [s / total for s in cols]
    entropy = -sum((p * F.log(p + F.lit(eps)) for p in share[1:]), share[0] * F.log(share[0] + F.lit(eps)))
    low = top < least
    return F.struct(
        F.when(low, "neutral").otherwise(label).alias("label"),
        top.alias("strength"),
        (ordered[0] - ordered[1]).alias("gap"),
        F.when(low, F.lit(0.0)).otherwise(F.lit(1.0) - entropy / F.log(F.lit(float(len(cols))))).alias("polarization"),
    )


@dataclass(frozen=True)
class CurationTerms:
    """Terms of the curation ladder."""

    strong: tuple[str, ...]
    support: tuple[str, ...]
    context: tuple[str, ...]
    noise: tuple[str, ...]
    strong_queries: tuple[str, ...] = ()
    broad_queries: tuple[str, ...] = ()
    drug: tuple[str, ...] = ("吸毒", "毒品")
    action: tuple[str, ...] = ("封存", "娱乐场所", "法工委", "少爷", "拘留")


def curation(text: Column, queries: Column, t: CurationTerms) -> Column:
    """Struct of decision (keep, review, drop) and rung of the ladder (1 to 7)."""
    some = lambda terms: any_term(text, terms)
    asked = lambda terms: F.arrays_overlap(queries, F.array(*map(F.lit, terms))) if terms else F.lit(False)
    noise, support, context = some(t.noise), some(t.support), some(t.context)
    strong = some(t.strong) | (some(t.drug) & some(t.action))
    sq, bq = F.coalesce(asked(t.strong_queries), F.lit(False)), F.coalesce(asked(t.broad_queries), F.lit(False))
    graded = lambda rung: F.struct(F.when(noise, "review").otherwise("keep").alias("decision"), F.lit(rung).alias("rung"))
    drop = lambda rung: F.struct(F.lit("drop").alias("decision"), F.lit(rung).alias("rung"))
    return F.when(noise & ~(strong | support | (sq & context)), drop(1)).when(strong, graded(2)).when(support, graded(3)).when(sq & context, graded(4)).when(sq, drop(5)).when(bq, drop(6)).otherwise(drop(7))


__all__ = ["CATEGORIES", "DEFAULT", "POLARITY", "CurationTerms", "Lexicon", "category_cosines", "curation", "intensity", "matched_terms", "polarity", "raw_sentiment", "sentiment_label", "sentiment_score", "stance_label", "stance_of", "stance_score", "transmissibility"]
