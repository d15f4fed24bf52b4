"""One form for texts that look the same.

Quick-check properties of the code points tell where a text may be unstable:
a code point is stable if normalization leaves it alone, it composes with
nothing before it, it is visible and no look-alike. Only maximal unstable
stretches, with the one character before them as boundary context, are
normalized and spliced back; everything else is copied.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.session import checkpointed

#: Letters of other scripts and the Latin letters they look like.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХҮԌԚԜѴаеорсухѕіјһԁԛԝѵӏ", "ABESIJKMHOPCTYXYGQWVaeopcyxsijhdqwvl"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανρυιγϲϳ", "ABEZHIKMNOPTYXoavpuiycj"))
OTHER = {a: b for a, b in ("ɑa", "ɡg", "օo", "սu", "հh", "ոn", "ցg", "ՕO", "ՍU", "ᎪA", "ᎬE", "ᎻH", "ᎢT", "ᎷM", "ᏃZ", "ᏢP", "ᏟC", "ᏴB", "ꓐB", "ꓑP", "ꓓD", "ꓔT", "ꓖG", "ꓗK", "ꓚC", "ꓜZ", "ꓝF", "ꓟM", "ꓠN", "ꓡL", "ꓢS", "ꓣR", "ꓦV", "ꓧH", "ꓪW", "ꓫX", "ꓬY", "ꓮA", "ꓰE", "ꓲI", "ꓳO")}
LOOKALIKES = CYRILLIC | GREEK | OTHER
#: Invisible characters outside the format category.
INVISIBLE = "͏ᅟᅠ឴឵ㅤﾠ" + "".join(map(chr, (*range(0x180B, 0x1810), *range(0xFE00, 0xFE10))))
_FOLD = str.maketrans(LOOKALIKES)
#: Back from a Latin letter to the first letter of a script that looks like it.
_BACK = tuple((re.compile(f"[{lo}-{hi}]"), str.maketrans({v: k for k, v in reversed(list(t.items()))})) for lo, hi, t in (("\u0400", "\u052f", CYRILLIC), ("\u0370", "\u03ff", GREEK)))
_OTHER_SCRIPT = re.compile("[\u0370-\u03ff\u0400-\u052f]")
_RARE = re.compile("[" + "".join(OTHER) + "]")
_LETTERS = re.compile(r"[^\W\d_]+")
_LATIN_LETTER = re.compile("[A-Za-z]")
#: Latin letters that no letter of another script looks like.
_LATIN_ONLY = re.compile("[" + "".join(c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" if c not in frozenset(LOOKALIKES.values())) + "]")
_segment: re.Pattern | None = None


def _invisible(c: str) -> bool:
    return unicodedata.category(c) == "Cf" or c in INVISIBLE or 0xE0100 <= ord(c) <= 0xE01EF


def unstable(c: str) -> bool:
    """Whether normalizing may change the code point or what stands before it."""
    if c == " " or "!" <= c <= "~":
        return False
    if unicodedata.combining(c) or _invisible(c) or c in LOOKALIKES or unicodedata.category(c) == "Zs":
        return True
    if not unicodedata.is_normalized("NFKC", c):
        return True
    # precomposed letters over a look-alike base
    whole = unicodedata.normalize("NFKD", c)
    return len(whole) > 1 and whole[0] in LOOKALIKES


def segments() -> re.Pattern:
    """Unstable stretches with one character of context before them."""
    global _segment
    if _segment is None:
        # marks and vowels that compose with what stands before them
        joins = set()
        # what composes beyond the basic plane lies there with both its parts
        for n in range(0x10000):
            parts = unicodedata.decomposition(chr(n)).split()
            if len(parts) == 2 and parts[0][0] != "<":
                joins.add(chr(int(parts[1], 16)))
        ranges, start = [], None
        for n in range(0xA0, 0x10000):
            c = chr(n)
            if 0xD800 <= n <= 0xDFFF or 0xAC00 <= n <= 0xD7A3 or 0x4E00 <= n <= 0x9FFF:
                bad = False
            else:
                bad = unstable(c) or c in joins or 0x1161 <= n <= 0x11FF
            if bad and start is None:
                start = n
            elif not bad and start is not None:
                ranges.append((start, n - 1))
                start = None
        if start is not None:
            ranges.append((start, 0xFFFF))
        # one range for all beyond: a matcher keeps those as a list it walks for every character
        ranges.append((0x10000, sys.maxunicode))
        cls = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)
        _segment = re.compile(f"[^{cls}]?[{cls}]+")
    return _segment


@functools.lru_cache(maxsize=200_000)
def _normalized(segment: str, fold: bool = True) -> str:
    seen = "".join(c for c in segment if not _invisible(c))
    t = unicodedata.normalize("NFKD", "".join(" " if unicodedata.category(c) == "Zs" else c for c in seen))
    t = unicodedata.normalize("NFC", t.translate(_FOLD) if fold else t)
    return "".join(c for c in t if not _invisible(c))


def canonical(text: str | None) -> str | None:
    """The key by which texts look the same; NULL stays NULL, an empty text empty.

    Look-alike letters become Latin ones wherever they stand: it serves to
    compare and is not meant to be read.
    """
    if text is None or text.isascii():
        return text
    return segments().sub(lambda m: _normalized(m[0]), text)


def _at_home(word: str) -> str:
    """A word in the script of those of its letters that have no look-alike, Latin if none."""
    base = unicodedata.normalize("NFD", word).translate(_FOLD)
    if not _LATIN_ONLY.search(base):
        for script, back in _BACK:
            if script.search(base):
                base = base.translate(back)
                break
    return unicodedata.normalize("NFC", base)


def one_form(text: str | None) -> str | None:
    """The text as handed on: equal for texts that look the same, every word in one script.

    A word comes out in the script of its unmistakable letters, so Cyrillic
    and Greek words stay what they are, and look-alikes inside a Latin word
    become Latin.
    """
    t = canonical(text)
    if t is None or not _OTHER_SCRIPT.search(t):
        return t
    return _LETTERS.sub(lambda m: _at_home(m[0]) if _OTHER_SCRIPT.search(m[0]) else m[0], t)


def readable(text: str | None) -> str | None:
    """As ``one_form``, but a word that is wholly of another script is left as it is."""
    if text is None or text.isascii():
        return text
    t = segments().sub(lambda m: _normalized(m[0], False), text)
    if not _OTHER_SCRIPT.search(t):
        # what is left are look-alikes of rare scripts
        return t.translate(_FOLD) if _RARE.search(t) else t
    return _LETTERS.sub(lambda m: _at_home(m[0]) if _LATIN_LETTER.search(m[0]) and not m[0].isascii() else m[0], t)


def with_canonical(df: DataFrame, text: str, out: str = "canonical", keep: list[str] | None = None, form=canonical) -> DataFrame:
    """The columns ``keep`` (default: all) and the given form of ``text``."""
    picked = df.select(*(keep or df.columns), F.col(text).cast("string").alias(out)) if out not in (keep or df.columns) else None
    if picked is None:
        raise ValueError(f"the input already has a column {out}")
    schema = picked.schema
    at = len(schema) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = pa.array([form(t) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(at)), done], names=b.schema.names)

    return picked.mapInArrow(run, schema)


def look_keys(df: DataFrame, record_id: Column, group: Column, text: Column) -> DataFrame:
    """``id``, ``g``, ``form``, ``raw``: digests of group, form and text of each record that can look like another.

    NULL, blank and "nan" or "none" texts, and NULL ids or groups, are left
    out. Kept in the checkpoint folder: what follows reads it more than once.
    """
    rows = df.select(record_id.cast("long").alias("id"), group.cast("string").alias("g"), text.cast("string").alias("t")).filter("id is not null and g is not null and t is not null")
    forms = with_canonical(rows, "t", "canonical", ["id", "g", "t"])
    blank = F.lower(F.trim("canonical")).isin("", "nan", "none", "null")
    digest = lambda c: F.unhex(F.md5(c))
    return checkpointed(forms.filter(~blank & ~F.col("canonical").rlike(r"^\s*$")).select("id", F.xxhash64("g").alias("g"), digest("canonical").alias("form"), digest("t").alias("raw")))


def same_looks(keys: DataFrame) -> DataFrame:
    """``id_a``, ``id_b``: different records of a group whose texts look the same but differ.

    ``keys`` are look_keys. A record delivered again counts once. Of two texts
    with one form at least one is not in that form, so the join takes the rows
    changed by normalization against all rows, on the group and the digest.
    ``look_classes`` gives the same relation with one row a record.
    """
    a = keys.filter("raw <> form").select("g", "form", F.col("id").alias("ia"), F.col("raw").alias("ra")).distinct()
    b = keys.select("g", "form", F.col("id").alias("ib"), F.col("raw").alias("rb"))
    pairs = a.join(b, ["g", "form"]).filter("ra <> rb and ia <> ib")
    return pairs.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).distinct()


def look_classes(keys: DataFrame) -> DataFrame:
    """``id``, ``class_id``, ``n_forms``: records of the classes that hold more than one string.

    The class of a record is the smallest id in it. No pairs are formed, so a
    text copied a million times costs a million rows. A record with several
    texts is in the class of each.
    """
    # copies meet as one row of counts; a hot text is reduced before any shuffle
    strings = keys.groupBy("g", "form", "raw").agg(F.min("id").alias("first"))
    classes = strings.groupBy("g", "form").agg(F.min("first").alias("class_id"), F.count("*").alias("n_forms")).filter("n_forms > 1")
    return keys.select("id", "g", "form").join(classes, ["g", "form"]).select("id", "class_id", "n_forms").distinct()
