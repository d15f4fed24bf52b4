"""Byte-level BPE ids of whole texts with a public vocabulary.

Pieces of the public pre-tokenizer are merged over a segment tree: a leaf
holds the rank of the pair that starts at a byte, an inner node the smaller
of its children with the left one first on ties, so the root yields the
leftmost lowest-rank merge; a merge updates two or three leaves and their
paths. Many pieces are merged at once, one tree per matrix row.

Exact short cuts keep the trees few: a piece is cut wherever no token of the
vocabulary can span the cut, and the ids of a part are remembered.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import checkpointed

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the public pre-tokenizer pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Remembered parts of a worker before it starts afresh; bounds its memory.
REMEMBER = 400_000
#: No pair: above every id, and so small that rank and place share 63 bits for any string.
_NONE = np.int64(1 << 31)
#: Repeated keys that are broadcast at most, and characters encoded in one step.
MOST_REPEATED, STEP_CHARS = 1_000_000, 2_000_000


def load_ranks(folder: str = TOKENIZERS, name: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes to rank, from a ranks file of base64 and number per line."""
    with open(os.path.join(folder, name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Ids of byte strings under a vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        token = {r: t for t, r in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # ways to form a token of two others, as sorted keys for searchsorted
        pairs: dict[int, int] = {}
        for t, r in ranks.items():
            for i in range(1, len(t)):
                a, b = ranks.get(t[:i]), ranks.get(t[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = r
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.token = token
        # what tokens hold around a cut between two characters: up to three
        # bytes on either side
        self.cross: set[tuple[bytes, bytes]] = set()
        for t in ranks:
            for i in range(1, len(t)):
                if t[i] & 0xC0 != 0x80:
                    self.cross.add((t[max(0, i - 4) : i], t[i : i + 4]))
        self.joint: dict[tuple[str, str], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def may_join(self, left: str, right: str) -> bool:
        """Whether some token could span the cut between two characters.

        Judged by the bytes of the two characters alone, so a yes may be
        wrong, a no may not.
        """
        key = (left, right)
        hit = self.joint.get(key)
        if hit is None:
            a, b = left.encode(), right.encode()
            # a token holds a suffix of the left character, or all of it and more, then the like on the right
            lefts = {a[i:] for i in range(len(a))}
            rights = {b[: i + 1] for i in range(len(b))}
            hit = self.joint[key] = any((x, y) in self._near for x in lefts for y in rights)
        return hit

    @property
    def _near(self) -> set[tuple[bytes, bytes]]:
        near = self.__dict__.get("near")
        if near is None:
            # of each crossing, what lies inside the two characters at the cut
            near = set()
            for l, r in self.cross:
                i = len(l) - 1
                while i > 0 and l[i] & 0xC0 == 0x80:
                    i -= 1
                j = 1
                while j < len(r) and r[j] & 0xC0 == 0x80:
                    j += 1
                near.add((l[i:], r[:j]))
            self.near = near
        return near

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.merged[at], _NONE)

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each byte string by repeated leftmost lowest-rank merges."""
        out: list[tuple[int, ...]] = [()] * len(pieces)
        sizes: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            sizes.setdefault(max(1, (len(p) - 1).bit_length()), []).append(i)
        for bits, members in sizes.items():
            # a tree matrix holds at most four million leaves
            step = max(1, (4 << 20) >> bits)
            for at in range(0, len(members), step):
                part = members[at : at + step]
                for i, ids in zip(part, self._merge_block([pieces[i] for i in part], 1 << bits)):
                    out[i] = ids
        return out

    def _merge_block(self, pieces: list[bytes], width: int) -> list[tuple[int, ...]]:
        n = len(pieces)
        ids = np.full((n, width), -1, np.int64)
        for i, p in enumerate(pieces):
            ids[i, : len(p)] = self.byte_ids[np.frombuffer(p, np.uint8)]
        span = np.arange(width)
        after = np.tile(np.minimum(span + 1, width), (n, 1))
        before = np.tile(span - 1, (n, 1))
        # tree[1] is the root, leaves are tree[width:]; a node's value is rank and then place
        tree = np.full((n, 2 * width), _NONE * width, np.int64)
        first = np.full((n, width), _NONE, np.int64)
        first[:, :-1] = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        tree[:, width:] = first * width + span
        for level in range(width.bit_length() - 2, -1, -1):
            lo = 1 << level
            tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
        rows = np.flatnonzero(tree[:, 1] < _NONE * width)

        def put(r: np.ndarray, leaf: np.ndarray, rank: np.ndarray) -> None:
            node = leaf + width
            tree[r, node] = rank * width + leaf
            while node.size and node[0] > 1:
                node >>= 1
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])

        def at(r: np.ndarray, c: np.ndarray) -> np.ndarray:
            inside = (c >= 0) & (c < width)
            return np.where(inside, ids[r, np.where(inside, c, 0)], -1)

        while rows.size:
            best = tree[rows, 1]
            i = best % width
            j = after[rows, i]
            nxt = after[rows, j]
            prev = before[rows, i]
            ids[rows, i] = best // width
            ids[rows, j] = -1
            after[rows, i] = nxt
            ok = nxt < width
            before[rows[ok], nxt[ok]] = i[ok]
            put(rows, j, np.full(len(rows), _NONE, np.int64))
            put(rows, i, self.pair_ranks(ids[rows, i], at(rows, nxt)))
            ok = prev >= 0
            put(rows[ok], prev[ok], self.pair_ranks(ids[rows[ok], prev[ok]], ids[rows[ok], i[ok]]))
            rows = rows[tree[rows, 1] < _NONE * width]
        return [tuple(r[r >= 0].tolist()) for r in ids]

    def parts(self, piece: str) -> list[str]:
        """The piece cut wherever no token can span the cut."""
        out, start, joint = [], 0, self.joint
        for i in range(1, len(piece)):
            pair = (piece[i - 1], piece[i])
            hit = joint.get(pair)
            if hit is None:
                hit = self.may_join(*pair)
            if not hit:
                out.append(piece[start:i])
                start = i
        out.append(piece[start:])
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; of an empty or NULL one, none."""
        if len(self.known) > REMEMBER:
            self.known.clear()
        if len(self.joint) > 4 * REMEMBER:
            self.joint.clear()
        find, known = _pattern().findall, self.known
        split = [find(t) if t else [] for t in texts]
        fresh = {p for pieces in split for p in pieces if p not in known}
        cut = {p: self.parts(p) for p in fresh}
        todo = list({x for xs in cut.values() for x in xs if x not in known})
        done = dict(zip(todo, self.merge([x.encode() for x in todo])))
        for p, xs in cut.items():
            if len(xs) == 1:
                known[p] = done[p]
            else:
                ids: list[int] = []
                for x in xs:
                    v = done.get(x)
                    ids += known[x] if v is None else v
                cut[p] = tuple(ids)
        known.update(done)
        known.update({p: v for p, v in cut.items() if isinstance(v, tuple)})
        out = []
        for pieces in split:
            ids = []
            for p in pieces:
                ids += known[p]
            out.append(ids)
        return out


_compiled = None
_encoders: dict[str, Encoder] = {}


def _encoder(key: str, ranks: dict[bytes, int]) -> Encoder:
    """One encoder a worker process, kept over its tasks."""
    if key not in _encoders:
        _encoders[key] = Encoder(ranks)
    return _encoders[key]


def _pattern():
    global _compiled
    if _compiled is None:
        _compiled = regex.compile(PATTERN)
    return _compiled


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, name: str = VOCABULARY, most: int = MOST_REPEATED) -> DataFrame:
    """``key`` and ``ids`` (array of int) of each document, whole text.

    NULL and empty texts give an empty list. Every row is encoded; rows that
    come out equal are one. So a key delivered again comes out once, and
    different texts under one key, or under a NULL key, all come out. Extra
    columns are not read. An empty table gives no row.

    Only rows whose key is repeated are shuffled. Their keys are broadcast up
    to ``most`` of them, and joined beyond that.
    """
    # a vocabulary file has a fixed size, here about a megabyte
    ranks = documents.sparkSession.sparkContext.broadcast(load_ranks(folder, name))
    kind = documents.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(f"{folder}/{name}", ranks.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            # steps of bounded length, whatever the documents' lengths
            ends, held = [0], 0
            for i, t in enumerate(texts):
                held += len(t or "")
                if held > STEP_CHARS or i - ends[-1] >= 500:
                    ends.append(i + 1)
                    held = 0
            if ends[-1] < len(texts):
                ends.append(len(texts))
            for at, end in zip(ends, ends[1:]):
                ids = encoder.encode(texts[at:end])
                flat = np.fromiter((i for x in ids for i in x), np.int32)
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, end - at), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))], names=[key, "ids"])

    rows = documents.select(key, F.col(text).cast("string").alias(text))
    repeated = checkpointed(rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(F.col(key).alias("repeated_key")))
    if repeated.count() <= most:
        repeated = F.broadcast(repeated)
    same = rows[key].eqNullSafe(repeated["repeated_key"])
    schema = f"{key} {kind.simpleString()}, ids array<int>"
    once = rows.join(repeated, same, "left_anti").mapInArrow(run, schema)
    again = rows.join(repeated, same, "left_semi").mapInArrow(run, schema).distinct()
    return once.unionByName(again)
