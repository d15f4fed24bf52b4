"""Evaluation passages inside corpus documents.

SimHash fingerprints of windows sized by the item, one for every offset of item
and document, over hashed character shingles of the text without case, width,
punctuation, spacing or invisible characters. Four 16-bit blocks index the
fingerprints; two that differ in at most three bits agree in a block, so the
lookup misses none within the radius. Windows grow with the item up to the
length of a verification shingle: a longer one would differ in more bits as soon
as a word in it is changed, and nothing is verified without one shingle in
common, whose window has the same fingerprint on both sides.

A pair is verified by shingles weighted by one over the number of passages that
hold them, counted over all items. Of each item the rarest shingles are looked
up, so many that the others together are too light to be accepted: every
acceptable pair is a candidate.
"""

from __future__ import annotations

import hashlib
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import checkpointed

RADIUS, BLOCKS, SHINGLE = 3, 4, 4
#: By script (Han, kana and hangul are dense) and compared length of the item up
#: to which a row holds: verification shingle, longest stock phrase, and the gap
#: that a changed word leaves. Short items are verified by shorter shingles.
DENSE = ((40, 4, 14, 4), (sys.maxsize, 6, 14, 6))
ALPHABETIC = ((60, 8, 34, 12), (120, 11, 34, 14), (sys.maxsize, 14, 34, 16))
#: Least weight of an item's own wording that a document must carry.
SHARE = 0.4
#: Compared characters of items in one part of the index, of documents and of
#: fingerprints in one step. They bound memory and change no result.
PART_CHARS, STEP_CHARS, STEP_PAIRS = 1_000_000, 200_000, 2_000_000

_kept: np.ndarray | None = None


def _table() -> np.ndarray:
    """For each code point, whether comparison keeps it."""
    global _kept
    if _kept is None:
        _kept = np.fromiter((chr(c).isalnum() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _kept


def folded(text: str | None) -> np.ndarray:
    """Code points of the text as compared."""
    if not text:
        return np.zeros(0, np.uint32)
    t = text if text.isascii() else unicodedata.normalize("NFKC", text)
    points = np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return points[_table()[points]]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the k-character shingles, one per start."""
    n = len(points) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + points[i : i + n].astype(np.uint64) + np.uint64(1)
    return _mix(h)


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)


def _fingerprints(sums: np.ndarray, width: int) -> np.ndarray:
    return np.packbits(sums >= (width + 1) // 2, axis=1).view("<u8").ravel()


def windows(points: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of the k-character windows at every offset."""
    h = shingle_hashes(points, SHINGLE)
    width = k - SHINGLE + 1
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    bits = _bits(h)
    # bytes suffice: a window has far fewer than 255 shingles
    total = bits[:n].copy()
    for i in range(1, width):
        total += bits[i : i + n]
    return _fingerprints(total, width)


def kind_of(points: np.ndarray) -> tuple[int, int, int]:
    """Shingle, phrase and gap for an item, by its script and length."""
    dense = np.mean((points >= 0x2E80) & (points < 0xE000) | (points >= 0x20000)) > 0.3
    k, phrase, gap = next(row[1:] for row in (DENSE if dense else ALPHABETIC) if len(points) <= row[0])
    # of an item hardly longer than a phrase the share decides alone
    return k, min(phrase, max(k, int(SHARE * len(points))) - 1), gap


@dataclass
class Item:
    key: str
    kind: tuple[int, int, int]
    shingles: np.ndarray
    weights: np.ndarray
    #: A character weighs as the heaviest of the shingles over it; all together.
    total: float
    #: Which shingles are looked up.
    looked: np.ndarray


def _spread(values: np.ndarray, k: int) -> np.ndarray:
    """For each character, the greatest value of the k-character shingles over it."""
    out = np.zeros(len(values) + k - 1)
    for i in range(k):
        out[i : i + len(values)] = np.maximum(out[i : i + len(values)], values)
    return out


def _near(values: np.ndarray, reach: int) -> np.ndarray:
    """For each character, the greatest value within so many characters."""
    padded = np.pad(values, reach)
    return np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1).max(axis=1)


def item_of(key: str, points: np.ndarray, shared: dict[int, int], share: float = SHARE) -> Item:
    """``shared`` holds, for shingle hashes in more than one passage, in how many."""
    kind = kind_of(points)
    h = shingle_hashes(points, kind[0])
    held = np.array([shared.get(x, 1) for x in h.view(np.int64).tolist()])
    weights = 1.0 / held
    total = _spread(weights, kind[0]).sum() if len(h) else 0.0
    looked = np.ones(len(h), bool)
    # the most common ones, while all of them are too light to be accepted
    for n in sorted({n for n in held.tolist() if n > 1}, reverse=True):
        common = held >= n
        # changed words between them count too, at most as what stands near
        if _near(_spread(np.where(common, weights, 0), kind[0]), kind[2]).sum() >= share * total:
            break
        looked = ~common
    return Item(key, kind, h, weights, total, looked)


class Index:
    """Fingerprints and weighted shingles of one part of the items."""

    def __init__(self, rows: list[tuple[str, np.ndarray, dict[int, int]]], share: float = SHARE):
        self.items: list[Item] = []
        prints: dict[int, list] = {}
        for key, points, shared in rows:
            x = item_of(key, points, shared, share)
            if len(x.shingles):
                w = np.unique(windows(points, x.kind[0])[x.looked])
                prints.setdefault(x.kind[0], []).append((w, np.full(len(w), len(self.items), np.int32)))
                self.items.append(x)
        self.tables = {}
        for k, found in prints.items():
            known, owner = (np.concatenate(v) for v in zip(*found))
            blocks = []
            for b in range(BLOCKS):
                value = (known >> np.uint64(16 * b)).astype(np.uint16)
                order = np.argsort(value, kind="stable").astype(np.int32)
                blocks.append((order, np.searchsorted(value[order], np.arange(65537)).astype(np.int32)))
            self.tables[k] = (known, owner, blocks)

    def candidates(self, prints: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, item) pairs whose fingerprints lie within the radius, in bounded steps."""
        known, owner, blocks = self.tables[k]
        for b, (order, starts) in enumerate(blocks):
            value = (prints >> np.uint64(16 * b)).astype(np.uint16).astype(np.int32)
            lo, n = starts[value], (starts[value + 1] - starts[value]).astype(np.int64)
            step = np.cumsum(n) // STEP_PAIRS
            for some in np.split(np.arange(len(n)), np.flatnonzero(np.diff(step)) + 1):
                m = n[some]
                if not m.sum():
                    continue
                w = np.repeat(some, m)
                e = order[np.arange(len(w)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo[some], m)]
                near = np.bitwise_count(known[e] ^ prints[w]) <= RADIUS
                yield w[near], owner[e[near]]

    def share(self, at: int, doc: np.ndarray) -> float:
        """Weight of the item's own wording in the document's long enough stretches.

        ``doc`` holds the sorted distinct hashes of the document's shingles.
        """
        x = self.items[at]
        k, phrase, gap = x.kind
        if not len(doc):
            return 0.0
        j = np.searchsorted(doc, x.shingles)
        j[j == len(doc)] = 0
        hit = doc[j] == x.shingles
        carried = _spread(np.where(hit, x.weights, 0), k)
        # stretches, bridging the gap a changed word leaves
        at_ = np.flatnonzero(carried)
        if not len(at_):
            return 0.0
        own = 0.0
        for s in np.split(at_, np.flatnonzero(np.diff(at_) > gap) + 1):
            if s[-1] - s[0] + 1 > phrase:
                # what is carried weighs by the shingles in common, and a changed
                # word as the lighter of its neighbours
                own += carried[s].sum() + (np.minimum(carried[s[1:]], carried[s[:-1]]) * (np.diff(s) - 1)).sum()
        return float(own / x.total)


def document_candidates(index: Index, docs: list[np.ndarray]) -> list[set[int]]:
    """Items near some window of each document; long documents are looked up piece by piece."""
    found: list[set[int]] = [set() for _ in docs]
    for k in index.tables:
        # pieces of documents, those of one step together; a piece overlaps the next by a window
        step, held = [], 0
        pieces = [(d, p[i : i + STEP_CHARS + k - 1]) for d, p in enumerate(docs) for i in range(0, len(p), STEP_CHARS)]
        for n, (d, p) in enumerate(pieces):
            step.append((d, p))
            held += len(p)
            if held < STEP_CHARS and n + 1 < len(pieces):
                continue
            joined = np.concatenate([p for _, p in step])
            doc_of = np.repeat([d for d, _ in step], [len(p) for _, p in step])
            # windows over the seam of two documents are dropped
            piece_of = np.repeat(np.arange(len(step)), [len(p) for _, p in step])
            prints = windows(joined, k)
            start = np.flatnonzero(piece_of[k - 1 :] == piece_of[: len(prints)]) if len(prints) else np.zeros(0, np.int64)
            for w, item in index.candidates(prints[start], k):
                pairs = np.unique(doc_of[start[w]].astype(np.int64) * len(index.items) + item)
                for pair in pairs.tolist():
                    found[pair // len(index.items)].add(pair % len(index.items))
            step, held = [], 0
    return found


def leaked(index: Index, docs: list[np.ndarray], share: float = SHARE) -> list[list[tuple[str, float]]]:
    """(key, share) of the passages each folded text leaks."""
    out = []
    for p, items in zip(docs, document_candidates(index, docs)):
        sets: dict[int, np.ndarray] = {}
        hits = []
        for at in sorted(items):
            k = index.items[at].kind[0]
            if k not in sets:
                sets[k] = np.unique(shingle_hashes(p, k))
            s = index.share(at, sets[k])
            if s >= share:
                hits.append((index.items[at].key, s))
        out.append(hits)
    return out


def passages(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of equal passages (``key``, ``form``, ``shared``) and their members (``key``, ``item_id``).

    ``form`` is the compared text, ``shared`` the shingle hashes that more
    passages hold with how many those are, over all items.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms = [folded(t).tobytes() for t in b.column(1).to_pylist()]
            keys = [hashlib.md5(f).hexdigest() for f in forms]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.string()), pa.array(forms, pa.binary())], names=["item_id", "key", "form"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("passage").cast("string").alias("passage")).filter("item_id is not null and passage is not null")
    every = checkpointed(rows.mapInArrow(fold, "item_id long, key string, form binary").filter("length(form) > 0"))
    classes = every.groupBy("key").agg(F.any_value("form").alias("form"))

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = sorted({row[1] for row in DENSE + ALPHABETIC})
        for b in batches:
            for key, form in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                points = np.frombuffer(form, np.uint32)
                own = kind_of(points)[0]
                for k in lengths:
                    h = np.unique(shingle_hashes(points, k)).view(np.int64)
                    if len(h):
                        yield pa.RecordBatch.from_arrays([pa.array([key] * len(h)), pa.array(np.full(len(h), k, np.int32)), pa.array(h), pa.array(np.full(len(h), k == own))], names=["key", "k", "h", "own"])

    held = classes.mapInArrow(shingles, "key string, k int, h long, own boolean")
    common = held.groupBy("k", "h").agg(F.count("*").alias("n")).filter("n > 1")
    shared = held.filter("own").join(common, ["k", "h"]).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("h", "n"))).alias("shared"))
    return classes.join(shared, "key", "left"), every.select("key", "item_id").distinct()


def _parts(items: DataFrame, part_chars: int, share: float) -> tuple[list[Broadcast], DataFrame]:
    """Broadcast parts of the index, each of bounded size, and the members of their classes."""
    spark = items.sparkSession
    classes, members = passages(items)
    classes = checkpointed(classes)
    total = classes.agg(F.sum(F.length("form") / 4)).first()[0] or 0
    n = int(total // part_chars) + 1
    parts = []
    for i in range(n):
        # one part at a time reaches the driver; a broadcast lies on disk there
        own = classes.filter(F.pmod(F.xxhash64("key"), F.lit(n)) == i).orderBy("key").collect()
        if own:
            parts.append(spark.sparkContext.broadcast(Index([(r.key, np.frombuffer(bytes(r.form), np.uint32), r.shared or {}) for r in own], share)))
    return parts, members


def find_leaks(documents: DataFrame, items: DataFrame, share: float = SHARE, part_chars: int = PART_CHARS) -> DataFrame:
    """``doc_id``, ``item_id``, ``share``: documents that carry items' passages.

    NULL and empty texts or passages leak nothing; NULL ids are left out. Rows
    delivered again, and copies, come out once per doc_id and item, with the
    greatest share. An id with several passages leaks if one of them does;
    items with equal passages leak together. The corpus is read once: a task
    takes the parts of the index one after the other, each of about
    ``part_chars`` characters, and lets go of each before the next.
    """
    parts, members = _parts(items, part_chars, share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(ids: list, docs: list) -> Iterator[pa.RecordBatch]:
            for part in parts:
                hits = [(d, i, s) for d, h in zip(ids, leaked(part.value, docs, share)) for i, s in h]
                if len(parts) > 1:
                    part.__dict__.pop("_value", None)
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*hits), (pa.int64(), pa.string(), pa.float64()))], names=["doc_id", "key", "share"])

        # several parts are loaded again for every group of documents, so these are larger then
        most = STEP_CHARS * (1 if len(parts) < 2 else 20)
        ids: list[int] = []
        docs: list[np.ndarray] = []
        held = 0
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids.append(d)
                docs.append(folded(t.as_py()))
                held += len(docs[-1])
                if held >= most:
                    yield from done(ids, docs)
                    ids, docs, held = [], [], 0
        if docs:
            yield from done(ids, docs)

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    found = texts.mapInArrow(run, "doc_id long, key string, share double").groupBy("doc_id", "key").agg(F.max("share").alias("share"))
    return found.join(members, "key").groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))
