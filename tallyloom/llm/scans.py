"""Text read from frames and scanned pages, repaired into paragraphs.

Running headers and footers are lines at page edges that repeat, perhaps not
exactly; page numbers are lines that only number the page. Edges are those of
the text, of form feeds and of page numbers. Where a text has no such mark
inside, a header must stand at the text's own edge and begin a paragraph
wherever it repeats. What is left is
joined line by line: a word split with a dividing mark is joined unless the
corpus knows it as a compound, and a character that was misread is put right
where the corpus knows the corrected word and hardly the other.

Vocabulary counts are taken over all texts: words and compounds of alphabetic
scripts, and of Han text the trigrams around characters that are easily
confused.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.canon import canonical, readable
from tallyloom.session import checkpointed

#: What a scanner reads (left) for what stands there (right).
HAN_MISREAD = "入人 兑说 彔录 老者 汜记 着看 朋期 朋明 祛法 冬条 问间 冈网 冶治 末未 卦封 曰日 仔存 津律 休体 己已 巳已 土士 天夭 千干 于干 拔拨 侯候 茶荼 折拆 戊戌".split()
LATIN_MISREAD = "0:o 1:i 1:l 5:s 9:g 6:b 8:b 2:z c:e rn:m li:h vv:w cl:d ii:u".split()
_HAN = {}
for _p in HAN_MISREAD:
    _HAN.setdefault(_p[0], []).append(_p[1])
_LATIN = [tuple(p.split(":")) for p in LATIN_MISREAD]
_CONFUSED = re.compile("[" + "".join(sorted(frozenset(_HAN) | {y for v in _HAN.values() for y in v})) + "]")

#: A corrected form must be met so often, and so many times as often.
LEAST_WORD, TIMES_WORD, LEAST_HAN, TIMES_HAN = 5, 10, 3, 3
#: The same for the pair with one neighbour, where the trigram is too rare.
LEAST_PAIR, TIMES_PAIR = 8, 10
#: Decisions that are sent to every task at most; more are joined instead.
MOST_SENT = 300_000
#: Likeness of two lines that are one header.
ALIKE = 0.75

_MARK = "-‐‑­¬⁃﹣－"
_BREAK = re.compile(rf"([^\W\d_]+(?:[0-9]+[^\W\d_]+)*)([{_MARK}])[ \t]*\n[ \t]*([^\W\d_][\w]*)")
_SOFT = re.compile(r"\xad(?=[ \t]*\r?\n)")
#: A line that ends with a mark at all; few do, and finding the word is dear.
_MARKED = re.compile(rf"[{_MARK}][ \t]*\n")
_LATIN_TEXT = re.compile("[a-zà-ÿ]", re.I)
_TIMING = re.compile(r"^\s*(\d+\s*\n)?\s*\d{1,2}:\d{2}(:\d{2})?[.,]\d{1,3}\s*-->.*$", re.M)
_WORD = re.compile(r"[a-zà-öø-ÿ0-9]+(?:-[a-zà-öø-ÿ0-9]+)*")
_PART = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9]+")
_IDEOGRAPH = "一-鿿"
_HAN_CHAR = re.compile(f"[{_IDEOGRAPH}]")
_BRACKETED = re.compile(r"[(（].*?[)）]")
_NUM = r"[0-9OolI]{1,4}"
_PAGE = tuple(
    re.compile(p, re.I)
    for p in (
        rf"[-—–·•~∙*]+\s*({_NUM})\s*[-—–·•~∙*]+",
        rf"(?:p|pp|pg|page|pág|página)\s*[.:]?\s*({_NUM})(?:\s*(?:of|/|de)\s*{_NUM})?",
        rf"第\s*({_NUM})\s*[页頁]\s*[,/ ]*(?:共\s*{_NUM}\s*[页頁])?",
        rf"[\[(【]\s*({_NUM})\s*[\])】]",
        rf"({_NUM})\s*/\s*{_NUM}",
        rf"({_NUM})\s*[页頁]",
    )
)
_DIGIT = re.compile("[0-9OolI]")
_BARE = re.compile(r"[0-9]{1,4}")
_FILLED = re.compile(r"([\s\-–—·•~∙*.=_]{1,2})\1{2,}")
_SENTENCE = re.compile(r"[。！？；，、!?;,:]|\.(\s|$)")
_ENDS = re.compile(r"[。！？.!?…”\"’)）】]\s*$")


def _han_line(t: str) -> bool:
    return _HAN_CHAR.search(t) is not None


def _alike(spots: list[tuple[int, str]]) -> list[list[int]]:
    """Lines in groups whose keys are alike, each compared with the first of the groups.

    Alike keys share at least half as many letter pairs as they have letters,
    less one, so only groups that do are compared letter by letter.
    """
    same: dict[str, list[int]] = {}
    for i, key in spots:
        same.setdefault(key, []).append(i)
    groups: list[tuple[str, list[int]]] = []
    by_pair: dict[str, list[int]] = {}
    for key, members in same.items():
        pairs = {key[j : j + 2] for j in range(len(key) - 1)}
        shared = Counter(g for p in pairs for g in by_pair.get(p, ()))
        for g in sorted(shared):
            first = groups[g][0]
            if abs(len(first) - len(key)) <= max(3, len(key) // 8) and shared[g] * 4 >= len(key) - 4 and difflib.SequenceMatcher(None, first, key, autojunk=False).ratio() >= ALIKE:
                groups[g][1].extend(members)
                break
        else:
            for p in pairs:
                by_pair.setdefault(p, []).append(len(groups))
            groups.append((key, list(members)))
    return [m for _, m in groups]


class Page:
    """The lines of one text with what each is: body, header, number or blank."""

    def __init__(self, text: str):
        # a soft hyphen at a line's end divides a word; elsewhere it is invisible
        t = readable(_SOFT.sub("¬", text)).replace("\r\n", "\n").replace("\r", "\n")
        self.timed = "-->" in t
        if self.timed:
            t = re.sub(r"\n{2,}", "\n", _TIMING.sub("", t))
        self.lines: list[str] = []
        self.edge: list[bool] = []
        #: First lines of the pages that form feeds begin.
        self.feeds: set[int] = set()
        for k, page in enumerate(t.split("\f")):
            rows = page.split("\n")
            if k:
                self.feeds.add(len(self.lines))
            self.lines += rows
            full = [i for i, r in enumerate(rows) if r.strip()]
            ends = set(full[:2] + full[-2:])
            for i in range(len(rows)):
                beside = (i > 0 and not rows[i - 1].strip()) or (i + 1 < len(rows) and not rows[i + 1].strip())
                self.edge.append(i in ends or beside)
        self.kind = ["blank" if not x.strip() else "body" for x in self.lines]
        self._numbers()
        self._headers()

    def _numbers(self) -> None:
        bare: list[tuple[int, int]] = []
        values: set[int] = set()
        for i, x in enumerate(self.lines):
            s = x.strip()
            if self.kind[i] != "body" or self.timed:
                continue
            if len(s) > 24:
                # longer only by runs of dashes, dots or spaces
                s = _FILLED.sub(r"\1", s) if _FILLED.search(s) else ""
            if not 0 < len(s) <= 24 or not _DIGIT.search(s):
                continue
            # a letter of another script may stand for the Latin one
            s = canonical(s)
            if any(p.fullmatch(s) for p in _PAGE):
                self.kind[i] = "number"
            elif _BARE.fullmatch(s):
                bare.append((i, int(s)))
                values.add(int(s))
        for i, v in bare:
            # a bare number counts by sequence, or at an edge if no year
            if v - 1 in values or v + 1 in values or (self.edge[i] and v < 1000):
                self.kind[i] = "number"

    def _page_edges(self) -> tuple[set[int], bool]:
        """The two outer lines of each page, and whether the text has a mark of pages inside."""
        ends: set[int] = set()
        page: list[int] = []
        marks = 0
        for i, k in enumerate(self.kind):
            if i in self.feeds or k == "number":
                if page:
                    ends.update(page[:2] + page[-2:])
                marks += bool(page)
                page = []
            if k == "body":
                page.append(i)
        ends.update(page[:2] + page[-2:])
        return ends, marks > (not page)

    def _headers(self) -> None:
        edges, marked = self._page_edges()
        spots = []
        dotted: set[int] = set()
        for i, x in enumerate(self.lines):
            s = x.strip()
            # most lines have a mark of a sentence in them
            if self.kind[i] != "body" or len(s) < 2 or marked and i not in edges:
                continue
            # a dot at the end of an outer line may stand for a lost character of a header met elsewhere
            plain = s.rstrip(".") if i in edges else s
            if plain != s:
                dotted.add(i)
            if _SENTENCE.search(_BRACKETED.sub("", plain) if "(" in s or "（" in s else plain):
                continue
            before = next((k for k in range(i - 1, -1, -1) if self.kind[k] != "number"), None)
            after = next((k for k in range(i + 1, len(self.lines)) if self.kind[k] != "number"), None)
            starts = before is None or self.kind[before] == "blank" or bool(_ENDS.search(self.lines[before])) or i in edges
            follows = after is not None and self.kind[after] == "body" and self.lines[after].lstrip()[:1].islower()
            key = "".join(c for c in s.lower() if c.isalnum())
            digits = sum(c.isdigit() for c in key)
            # codes and numbered items repeat without being headers
            if starts and not follows and len(key) - digits >= 4 and digits * 3 <= len(key) * (i in edges or self.edge[i]):
                spots.append((i, key))
        for members in _alike(spots):
            if len(members) > 1 and not edges.isdisjoint(members) and not dotted.issuperset(members):
                for i in members:
                    self.kind[i] = "header"

    def body(self) -> str:
        """Lines that are neither header nor number, blank ones kept."""
        return "\n".join(x.rstrip() for x, k in zip(self.lines, self.kind) if k in ("body", "blank"))


def _han_text(body: str) -> str:
    return re.sub(r"[ \t]*\n[ \t]*", "", body)


def _trigrams(s: str) -> Iterator[tuple[int, str]]:
    for m in _CONFUSED.finditer(s):
        i = m.start()
        yield i, (s[i - 1] if i else "^") + m[0] + (s[i + 1] if i + 1 < len(s) else "$")


def _unbroken(body: str, by) -> str:
    return _BREAK.sub(by, body) if _MARKED.search(body) else body


def _compounds(body: str) -> Iterator[tuple[str, str, str]]:
    """(mark, joined word, compound) of each word split over two lines."""
    if not _MARKED.search(body):
        return
    for m in _BREAK.finditer(body):
        yield m[2], (m[1] + m[3]).lower(), f"{m[1]}-{m[3]}".lower()


def vocabulary(texts: list[str]) -> Counter:
    """Counts of what decisions are made on: w: words, t: trigrams, j: split words."""
    n: Counter = Counter()
    for text in texts:
        body = Page(text).body() if "\n" in text else readable(text)
        for mark, joined, compound in _compounds(body):
            if mark == "-":
                n["j:" + joined + "|" + compound] += 1
        if _LATIN_TEXT.search(body):
            n.update("w:" + w for w in _WORD.findall(_unbroken(body, " ").lower()))
        if _han_line(text):
            n.update("t:" + g for _, g in _trigrams(_han_text(body)))
    return n


def alternatives(word: str) -> set[str]:
    """Words that a scanner may have misread as this one."""
    out = set()
    if len(word) < 4 or "-" in word:
        return out
    for bad, good in _LATIN:
        if bad in word:
            out.add(word.replace(bad, good))
            i = word.find(bad)
            while i >= 0:
                out.add(word[:i] + good + word[i + len(bad) :])
                i = word.find(bad, i + 1)
    if any(c.isdigit() for c in word):
        base = [word]
        for c in sorted({c for c in word if c.isdigit()}):
            base = [b.replace(c, g) for b in base for bad, g in _LATIN if bad == c] or base
        out.update(base)
    return {x for x in out if x != word and x.isalpha()}


def corpus_counts(texts: DataFrame) -> DataFrame:
    """``key``, ``n`` over all texts of the column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def sent() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["key", "n"])
            total.clear()
            return b

        for b in batches:
            total.update(vocabulary([x for x in b.column(0).to_pylist() if x]))
            if len(total) > 200_000:
                yield sent()
        if total:
            yield sent()

    return texts.select("text").filter("text is not null").mapInArrow(run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))


def decisions(counts: DataFrame) -> DataFrame:
    """``form``, ``alt``: words and trigrams to put right, and compounds to keep (alt "=")."""

    def options(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                kind, form = key[:2], key[2:]
                if kind == "w:":
                    rows += [(key, "w:" + a, n) for a in alternatives(form)]
                elif kind == "t:":
                    rows += [(key, f"t:{form[0]}{a}{form[2]}", n) for a in _HAN.get(form[1], ())]
                elif kind == "j:":
                    joined, compound = form.split("|")
                    rows.append(("w:" + joined, "w:" + compound, 0))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))], names=["form", "alt", "n_form"])

    opt = counts.mapInArrow(options, "form string, alt string, n_form long")
    known = opt.join(counts.select(F.col("key").alias("alt"), F.col("n").alias("n_alt")), "alt", "left").withColumn("n_alt", F.coalesce("n_alt", F.lit(0)))
    compound, word = F.col("alt").contains("-"), F.col("form").startswith("w:")
    # compounds against the joined word
    joined = counts.select(F.col("key").alias("form"), F.col("n").alias("n_joined"))
    keep = known.filter(compound & (F.col("n_alt") > 0)).join(joined, "form", "left").filter(F.col("n_alt") > F.coalesce("n_joined", F.lit(0))).select(F.col("alt").alias("form"), F.lit("=").alias("alt")).distinct()
    words = known.filter(word & ~compound & (F.col("n_alt") >= LEAST_WORD) & (F.col("n_alt") >= TIMES_WORD * F.col("n_form")))
    # Han: the trigram decides, else a pair of which the other side does not object
    han = known.filter(~word)
    tri = counts.filter(F.col("key").startswith("t:"))
    for side, at in (("l", 3), ("r", 4)):
        pairs = tri.groupBy(F.substring("key", at, 2).alias("pair")).agg(F.sum("n").alias("n"))
        for which in ("form", "alt"):
            n = pairs.select(F.col("pair").alias(f"{side}_{which}"), F.col("n").alias(f"n_{side}_{which}"))
            han = han.withColumn(f"{side}_{which}", F.substring(which, at, 2)).join(n, f"{side}_{which}", "left").withColumn(f"n_{side}_{which}", F.coalesce(f"n_{side}_{which}", F.lit(0)))
    c = F.col
    sure = lambda a: (c(f"n_{a}_alt") >= LEAST_PAIR) & (c(f"n_{a}_alt") >= TIMES_PAIR * c(f"n_{a}_form"))
    fine = lambda a: c(f"n_{a}_alt") >= c(f"n_{a}_form") - 1
    han = han.filter((c("n_alt") >= LEAST_HAN) & (c("n_alt") >= TIMES_HAN * c("n_form")) | (sure("l") & fine("r")) | (sure("r") & fine("l")))
    fix = words.select("form", "alt", "n_alt").unionByName(han.select("form", "alt", (c("n_alt") + c("n_l_alt") + c("n_r_alt")).alias("n_alt"))).groupBy("form").agg(F.max_by("alt", F.struct("n_alt", "alt")).alias("alt"))
    return fix.unionByName(keep)


def _paragraphs(body: str, by) -> Iterator[str]:
    """Paragraphs of one line, split words joined as given."""
    for para in re.split(r"\n\s*\n", _unbroken(body, by)):
        # Han lines join without a space, others with one
        t = re.sub(rf"(?<=[{_IDEOGRAPH}，。、；：！？”》）0-9,;:!?)])[ \t]*\n[ \t]*(?=[{_IDEOGRAPH}“《（，。0-9,;:!?(])", "", para.strip())
        yield re.sub(r"\s*\n\s*", " ", t)


def tokens(text: str) -> set[str]:
    """Forms of a text that a decision may be about: all that noise_kinds and repair look up."""
    body = Page(text).body()
    out = {"w:" + c for _, _, c in _compounds(body)}
    words = set(_WORD.findall(_unbroken(body, lambda m: m[1] + m[3] + "\n").lower()))
    grams = {g for _, g in _trigrams(_han_text(body))}
    # a split word may be joined with its mark or without
    for by in (lambda m: m[1] + m[3], lambda m: m[1] + "-" + m[3]):
        for t in _paragraphs(body, by):
            words.update(w.lower() for w in _PART.findall(t))
            if _han_line(t):
                grams.update(g for _, g in _trigrams(t))
    out.update("w:" + w for w in words if alternatives(w))
    out.update("t:" + g for g in grams if g[1] in _HAN)
    return out


def noise_kinds(text: str | None, decided: dict[str, str]) -> set[str]:
    """Kinds of noise present in a text."""
    if not text or not text.strip() or text.strip().lower() in ("nan", "none"):
        return set()
    page = Page(text)
    kinds = set()
    if "header" in page.kind:
        kinds.add("running_header")
    if "number" in page.kind:
        kinds.add("page_number")
    body = page.body()
    for mark, _, compound in _compounds(body):
        if mark != "-" or decided.get("w:" + compound) != "=":
            kinds.add("hyphen_break")
            break
    plain = _unbroken(body, lambda m: m[1] + m[3] + "\n")
    if _LATIN_TEXT.search(plain) and any(decided.get("w:" + w, "=") != "=" for w in _WORD.findall(plain.lower())):
        kinds.add("misread")
    elif _han_line(body) and any("t:" + g in decided for _, g in _trigrams(_han_text(body))):
        kinds.add("misread")
    return kinds


def repair(text: str | None, decided: dict[str, str]) -> str | None:
    """The text as continuous paragraphs; NULL stays NULL."""
    if not text or not text.strip():
        return text

    def joined(m: re.Match) -> str:
        keep = m[2] == "-" and decided.get(f"w:{m[1]}-{m[3]}".lower()) == "="
        return m[1] + ("-" if keep else "") + m[3]

    def word(m: re.Match) -> str:
        alt = decided.get("w:" + m[0].lower(), "=")
        if alt == "=":
            return m[0]
        return alt[2:].upper() if m[0].isupper() and len(m[0]) > 2 else alt[2:3].upper() + alt[3:] if m[0][:1].isupper() else alt[2:]

    out = []
    for t in _paragraphs(Page(text).body(), joined):
        if _han_line(t):
            chars = list(t)
            for i, g in _trigrams(t):
                alt = decided.get("t:" + g)
                if alt:
                    chars[i] = alt[3]
            # marks beside Han characters are full-width
            t = re.sub(rf"(?<=[{_IDEOGRAPH}”》])[,;:!?(]|(?<=[0-9])[,;:!?](?=[{_IDEOGRAPH}])|[)](?=[{_IDEOGRAPH}，。])|(?<=[{_IDEOGRAPH}])[)]", lambda m: chr(ord(m[0]) + 0xFEE0), "".join(chars))
        t = _PART.sub(word, t)
        if t:
            out.append(t)
    return "\n\n".join(out)


def _texts(records: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    one = records.select(F.col("text_record_id").cast("long").alias("text_record_id"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields))).alias("x")).select("text_record_id", "x.*")
    return one.filter("text_record_id is not null and text is not null")


def _decide(records: DataFrame, corpus: tuple[str, ...]) -> DataFrame:
    texts = records.select(F.explode(F.array(*(F.col(c).cast("string") for c in corpus))).alias("text"))
    return checkpointed(decisions(checkpointed(corpus_counts(texts))))


def _with_decisions(texts: DataFrame, decided: DataFrame, apply, schema: str, most: int) -> DataFrame:
    """Run ``apply(texts, decided) -> columns`` over rows with the decisions they need."""
    spark = texts.sparkSession
    if decided.count() <= most:
        sent = spark.sparkContext.broadcast({r.form: r.alt for r in decided.toLocalIterator()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from apply(b.column(0), b.column(1), b.column(2).to_pylist(), lambda i: sent.value)

        return texts.mapInArrow(run, schema)

    # beyond the bound each text gets the decisions about its own forms by a join
    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, f, k) for i, f, t in zip(*(c.to_pylist() for c in b.columns)) for k in tokens(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))], names=["text_record_id", "field", "form"])

    # several texts of one record share their forms; a decision is the same for all
    own = texts.mapInArrow(forms, "text_record_id long, field string, form string").distinct().join(decided, "form").groupBy("text_record_id", "field").agg(F.map_from_entries(F.collect_list(F.struct("form", "alt"))).alias("own"))
    both = texts.join(own, ["text_record_id", "field"], "left").select("text_record_id", "field", "text", "own")

    def run_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maps = [dict(x or ()) for x in b.column(3).to_pylist()]
            yield from apply(b.column(0), b.column(1), b.column(2).to_pylist(), maps.__getitem__)

    return both.mapInArrow(run_own, schema)


FIELDS, CORPUS = ("ocr_text", "subtitle_text"), ("ocr_text", "subtitle_text", "transcript_text", "title_text")


def find_noise(records: DataFrame, fields: tuple[str, ...] = FIELDS, corpus: tuple[str, ...] = CORPUS, most: int = MOST_SENT) -> DataFrame:
    """``text_record_id``, ``field``, ``noise_kind``: kinds present in each record's field.

    NULL, blank and "nan" texts have none. A record delivered again counts
    once, with the kinds of all its texts. Rows with a NULL id are left out.
    """

    def apply(ids, names, texts, decided) -> Iterator[pa.RecordBatch]:
        rows = [(i, f, k) for j, (i, f, t) in enumerate(zip(ids.to_pylist(), names.to_pylist(), texts)) for k in sorted(noise_kinds(t, decided(j)))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))], names=["text_record_id", "field", "noise_kind"])

    return _with_decisions(_texts(records, fields), _decide(records, corpus), apply, "text_record_id long, field string, noise_kind string", most).distinct()


def repair_texts(records: DataFrame, fields: tuple[str, ...] = FIELDS, corpus: tuple[str, ...] = CORPUS, most: int = MOST_SENT) -> DataFrame:
    """``text_record_id``, ``field``, ``text``: every text as continuous paragraphs; equal rows once.

    NULL texts and rows with a NULL id are left out, blank texts stay as they are.
    """

    def apply(ids, names, texts, decided) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([ids, names, pa.array([repair(t, decided(j)) for j, t in enumerate(texts)], pa.string())], names=["text_record_id", "field", "text"])

    return _with_decisions(_texts(records, fields), _decide(records, corpus), apply, "text_record_id long, field string, text string", most).distinct()
