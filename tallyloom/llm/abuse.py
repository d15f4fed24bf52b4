"""Scores for abusive, hateful or sexual content.

A text is the bag of its character n-grams, hashed to buckets. Bucket vectors
are averaged into a linear softmax; vectors and softmax are trained jointly
in numpy, so spellings never seen share the vectors of the n-grams they have
in common with known ones. The average is taken per clause and the text's
score is that of its worst clause, so that a long text does not dilute one.
As the softmax is linear in the average, a trained model is one number a
bucket.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.canon import canonical

#: Labelled rows a model is fitted on at most, in order of a hash of their id.
MAX_LABELS = 20_000
BITS, DIM, EPOCHS, BATCH, RATE, DECAY = 17, 12, 12, 512, 0.05, 1e-6
GRAMS = (1, 2, 3, 4, 5)
THRESHOLD = 0.4
#: Clauses whose score a worker remembers.
REMEMBER = 300_000
#: Tokens the annotators use.
YES = ("1", "1.0", "yes", "y", "true", "t", "是", "辱骂", "abusive")
NO = ("0", "0.0", "no", "n", "false", "f", "否", "正常", "normal", "ok")

_LINK = re.compile(r"https?://[!-~]+|<url>")
#: Latin words with digits or signs in place of letters.
_LEET = re.compile(r"(?=[a-z0-9$@]*[a-z])(?=[a-z]*[013457$@])[a-z0-9$@]{3,}")
_LETTERS = str.maketrans("013457$@", "oieastsa")
#: Marks put between the letters of a word to hide it.
_INSIDE_HAN = re.compile(r"(?<=[一-鿿])[\s*·•._\-/|~×☺-➿︀-️\U0001f300-\U0001faff]+(?=[一-鿿])")
_INSIDE_WORD = re.compile(r"(?<![a-z])([a-z])((?:[*·•._\-/|~\s]{1,2}[a-z](?![a-z]))+)")
_INNER = re.compile(r"(?<=[a-z])[*·•|~☺-➿\U0001f300-\U0001faff]+(?=[a-z])")
_LATIN = re.compile("[a-z]")
_LONG = re.compile(r"([a-z])\1{2,}")
_CLAUSE = re.compile(r"[。！？!?；;\n…，,]+|(?<=[a-z0-9])\.+(?:\s|$)")
_SPACE = re.compile(r"[^\w《》“”\"]+")


def clauses(text: str | None) -> list[str]:
    """Clauses of a text as compared: one form, lower case, hiding marks undone."""
    if not text:
        return []
    t = canonical(text).lower()
    if "http" in t or "<url>" in t:
        t = _LINK.sub(" ", t)
    t = _INSIDE_HAN.sub("", t)
    if _LATIN.search(t):
        t = _LEET.sub(lambda m: m[0].translate(_LETTERS), t.replace(" @ ", " a "))
        t = _INSIDE_WORD.sub(lambda m: m[1] + re.sub("[^a-z]", "", m[2]), t)
        t = _LONG.sub(r"\1", _INNER.sub("", t))
    out = []
    for c in _CLAUSE.split(t):
        c = _SPACE.sub(" ", c).strip()
        if c:
            out.append(f" {c} ")
    return out


def gram_ids(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of all n-grams of the strings, and the start of each string's."""
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(parts)), sizes)
    left = ends[owner] - np.arange(len(points)) if len(points) else np.zeros(0, np.int64)
    h = np.zeros(len(points), np.uint64)
    ids, owners = [], []
    for n in range(1, GRAMS[-1] + 1):
        h = h * np.uint64(0x100000001B3)
        h[: len(h) - n + 1] += points[n - 1 :] + np.uint64(7)
        if n in GRAMS:
            ok = left >= n
            x = h[ok] ^ np.uint64(n * 0x9E3779B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            ids.append((x >> np.uint64(64 - BITS)).astype(np.int64))
            owners.append(owner[ok])
    ids, owners = np.concatenate(ids), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    starts = np.searchsorted(owners[order], np.arange(len(parts)))
    return ids[order], starts


class Model:
    """One logit contribution a bucket."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self.known: dict[str, float] = {}

    def means(self, flat: list[str]) -> np.ndarray:
        """Mean contribution of each clause; clauses recur, so they are remembered."""
        known = self.known
        if len(known) > REMEMBER:
            known.clear()
        fresh = list({c for c in flat if c not in known})
        if fresh:
            ids, starts = gram_ids(fresh)
            known.update(zip(fresh, (np.add.reduceat(self.weights[ids], starts) / np.diff(np.append(starts, len(ids)))).tolist()))
        return np.fromiter(map(known.__getitem__, flat), np.float64, len(flat))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Score in 0..1 of each text; 0 for a NULL, blank or word-less one."""
        out = np.zeros(len(texts))
        parts = [clauses(t) for t in texts]
        flat = [c for p in parts for c in p]
        if not flat:
            return out
        mean = self.means(flat)
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        worst = np.full(len(texts), -np.inf)
        np.maximum.at(worst, owner, mean)
        some = np.isfinite(worst)
        out[some] = 1 / (1 + np.exp(-np.clip(worst[some] + self.bias, -30, 30)))
        return out


def train(texts: list[str], labels: list[int], seed: int = 7, epochs: int = EPOCHS) -> Model:
    """Fit bucket vectors and softmax; the worst clause stands for its text."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.float64)
    parts = [clauses(t) or [" "] for t in texts]
    ids, starts = gram_ids([c for p in parts for c in p])
    ends = np.append(starts[1:], len(ids))
    first = np.cumsum([0, *map(len, parts)])
    e = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
    w = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
    b = np.zeros(2, np.float32)
    # squared gradients for Adagrad steps
    ge, gw, gb = np.full(1 << BITS, 1e-4, np.float32), np.full((DIM, 2), 1e-4, np.float32), np.full(2, 1e-4, np.float32)
    share = max(1e-3, y.mean()) if len(y) else 0.5
    cost = np.where(y == 1, 0.5 / share, 0.5 / max(1e-3, 1 - share)) ** 0.5
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            spans = [(k, c) for k, r in enumerate(rows) for c in range(first[r], first[r + 1])]
            owner = np.array([k for k, _ in spans])
            cl = np.array([c for _, c in spans])
            size = ends[cl] - starts[cl]
            flat = np.concatenate([ids[starts[c] : ends[c]] for c in cl])
            offs = np.cumsum(size) - size
            mean = np.add.reduceat(e[flat], offs) / size[:, None].astype(np.float32)
            z = mean @ w + b
            d = z[:, 1] - z[:, 0]
            top = np.full(len(rows), -np.inf, np.float32)
            np.maximum.at(top, owner, d)
            # early on all clauses learn, later the worst one
            if epoch == 0:
                pick, target, c = np.arange(len(cl)), y[rows][owner], cost[rows][owner] / np.bincount(owner)[owner]
            else:
                pick = np.flatnonzero(d == top[owner])
                pick = pick[np.unique(owner[pick], return_index=True)[1]]
                target, c = y[rows], cost[rows]
            p = 1 / (1 + np.exp(-np.clip(d[pick], -30, 30)))
            g = (c * (p - target)).astype(np.float32)
            dz = np.stack([-g, g], 1)
            gm = dz @ w.T
            grad_w, grad_b = mean[pick].T @ dz / len(rows), dz.sum(0) / len(rows)
            per = gm / size[pick, None].astype(np.float32)
            sel = np.concatenate([np.arange(offs[k], offs[k] + size[k]) for k in pick])
            f = flat[sel]
            rep = np.repeat(np.arange(len(pick)), size[pick])
            u, inv = np.unique(f, return_inverse=True)
            acc = np.stack([np.bincount(inv, weights=per[rep, j], minlength=len(u)) for j in range(DIM)], 1).astype(np.float32)
            ge[u] += (acc**2).mean(1)
            e[u] -= RATE * acc / np.sqrt(ge[u])[:, None] + DECAY * e[u]
            gw += grad_w**2
            gb += grad_b**2
            w -= RATE * grad_w / np.sqrt(gw)
            b -= RATE * grad_b / np.sqrt(gb)
    direction = w[:, 1] - w[:, 0]
    return Model((e @ direction).astype(np.float64), float(b[1] - b[0]))


def resolved_labels(labels: DataFrame) -> DataFrame:
    """``record_table``, ``record_id``, ``label``: the adjudicated label, else what both annotators say.

    Rows on which the annotators disagree, or of which a token is unknown or
    NULL, without adjudication, are left out; so are NULL ids.
    """
    token = lambda c: F.when(F.lower(F.trim(c)).isin(*YES), 1).when(F.lower(F.trim(c)).isin(*NO), 0)
    a, b = token("label_annotator_a"), token("label_annotator_b")
    label = F.coalesce(F.when(F.col("adjudicated_label").isin(0, 1), F.col("adjudicated_label")), F.when(a == b, a))
    return labels.select("record_table", F.col("record_id").cast("string").alias("record_id"), label.cast("int").alias("label")).filter("label is not null and record_id is not null and record_table is not null").groupBy("record_table", "record_id").agg(F.max("label").alias("label"))


def labelled_sample(labels: DataFrame, texts: DataFrame, most: int = MAX_LABELS) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``most`` labelled rows, in order of a hash of their id."""
    some = resolved_labels(labels).withColumn("h", F.md5(F.concat_ws("/", "record_table", "record_id"))).orderBy("h").limit(most)
    # the sample is bounded by most: ids and labels only are broadcast
    rows = texts.join(F.broadcast(some), ["record_table", "record_id"]).groupBy("h").agg(F.max("text").alias("text"), F.max("label").alias("label")).filter("text is not null").orderBy("h").collect()
    return [r.text for r in rows], [r.label for r in rows]


def score(texts: DataFrame, model: Model) -> DataFrame:
    """``record_table``, ``record_id``, ``score`` of each record; a NULL, blank or word-less text scores 0.

    A record delivered again counts once, with its highest score. Rows with a
    NULL id are left out.
    """
    shared = texts.sparkSession.sparkContext.broadcast(model)  # one double a bucket, a megabyte

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(shared.value.scores(part.column(2).to_pylist()))], names=["record_table", "record_id", "score"])

    scored = texts.select("record_table", "record_id", "text").filter("record_id is not null").mapInArrow(run, "record_table string, record_id string, score double")
    return scored.groupBy("record_table", "record_id").agg(F.max("score").alias("score"))
