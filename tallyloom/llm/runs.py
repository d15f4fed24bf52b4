"""Runs of near-identical consecutive events, by regex over symbol strings.

Events are made canonical (an event within the distance of the one just
before, and close enough in time, takes its symbol; any other takes the next
symbol), symbols become Unicode code points, the code points of an entity
are one string, and a backreference regex finds the repetitions. Spans map
back to positions and times. An entity's sequence is cut into blocks of
positions, so one entity with a third of all events is many tasks; runs that
touch a block's edge are joined afterwards from the edge runs alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.keys import video_key
from tallyloom.session import checkpointed

#: Positions of one block of an entity's sequence.
BLOCK = 4096
#: Pairs of a video and an earlier run that are broadcast at most.
MOST_STALE = 200_000
#: Symbols cycle through so many code points from FIRST on; neighbours differ.
FIRST, SYMBOLS = 0x4E00, 0x4000
RUN = re.compile(r"(.)\1*", re.S)
_OUT = "video_id string, run_name string, block long, first_segment_index int, last_segment_index int, slice_count long, start_second double, end_second double, first_hash long, last_hash long, last_end double, at_head boolean, at_tail boolean"
_EPS = 1e-9


def _spans(video: list, run: list, block: np.ndarray, seg: np.ndarray, start: np.ndarray, end: np.ndarray, phash: np.ndarray, known: np.ndarray, bits: int, gap: float, singles: bool) -> pa.RecordBatch:
    """Runs of whole blocks; rows are sorted and repeats removed."""
    n = len(seg)
    video_a, run_a = np.array(video, object), np.array(run, object)
    same = np.zeros(n, bool)
    same[1:] = (video_a[1:] == video_a[:-1]) & (run_a[1:] == run_a[:-1]) & (block[1:] == block[:-1])
    follows = same.copy()
    x = phash[1:] ^ phash[:-1]
    with np.errstate(invalid="ignore"):
        near = start[1:] - end[:-1] <= gap + _EPS
    follows[1:] &= known[1:] & known[:-1] & (np.bitwise_count(x.view(np.uint64)) <= bits) & near
    canonical = np.cumsum(~follows)
    text = (FIRST + canonical % SYMBOLS).astype(np.uint32).tobytes().decode("utf-32-le")
    spans = np.array([m.span() for m in RUN.finditer(text)], np.int64).reshape(-1, 2)
    a, z = spans[:, 0], spans[:, 1] - 1
    head = ~same[a]
    tail = np.ones(len(a), bool)
    tail[:-1] = head[1:]
    keep = (z > a) | head | tail | singles
    a, z, head, tail = a[keep], z[keep], head[keep], tail[keep]
    top = np.maximum.reduceat(np.where(np.isnan(end), -np.inf, end), spans[:, 0])[keep] if n else np.zeros(0)
    low = np.minimum.reduceat(np.where(np.isnan(start), np.inf, start), spans[:, 0])[keep] if n else np.zeros(0)
    nothing = lambda v, bad: pa.array(v, pa.float64(), mask=bad)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(video_a[a], pa.string()), pa.array(run_a[a], pa.string()), pa.array(block[a], pa.int64()), pa.array(seg[a].astype(np.int32)), pa.array(seg[z].astype(np.int32)), pa.array(z - a + 1, pa.int64()),
            nothing(low, np.isinf(low)), nothing(top, np.isinf(top)), pa.array(phash[a], pa.int64(), mask=~known[a]), pa.array(phash[z], pa.int64(), mask=~known[z]), nothing(end[z], np.isnan(end[z])), pa.array(head), pa.array(tail),
        ],
        names=[f.split()[0] for f in _OUT.split(", ")],
    )


def block_runs(bits: int, gap: float, singles: bool):
    """A function for ``mapInArrow`` over rows sorted by entity, block and position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def emit(t: pa.Table) -> Iterator[pa.RecordBatch]:
            if not t.num_rows:
                return
            c = {k: t.column(k).combine_chunks() for k in t.column_names}
            seg = c["segment_index"].to_numpy(zero_copy_only=False).astype(np.int64)
            video, rname, block = c["video_id"].to_pylist(), c["run_name"].to_pylist(), c["block"].to_numpy(zero_copy_only=False)
            first = np.ones(len(seg), bool)
            va, ra = np.array(video, object), np.array(rname, object)
            first[1:] = (seg[1:] != seg[:-1]) | (va[1:] != va[:-1]) | (ra[1:] != ra[:-1])
            known = ~np.asarray(c["h"].is_null())
            num = lambda k: c[k].cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(first)
            yield _spans(va[at].tolist(), ra[at].tolist(), block[at], seg[at], num("start_second")[at], num("end_second")[at], c["h"].fill_null(0).to_numpy(zero_copy_only=False)[at].astype(np.int64), known[at], bits, gap, singles)

        for b in batches:
            t = pa.Table.from_batches([b])
            if held is not None:
                t = pa.concat_tables([held, t])
            if not t.num_rows:
                continue
            # the last block may go on in the next batch
            k = t.num_rows - 1
            last = [t.column(n)[k].as_py() for n in ("video_id", "run_name", "block")]
            lo, hi = 0, k
            keys = [t.column(n) for n in ("video_id", "run_name", "block")]
            while lo < hi:
                mid = (lo + hi) // 2
                if [x[mid].as_py() for x in keys] == last:
                    hi = mid
                else:
                    lo = mid + 1
            # rows are sorted, so the last block's rows are one stretch at the end
            yield from emit(t.slice(0, lo))
            held = t.slice(lo)
        if held is not None:
            yield from emit(held)

    return run


def collapse_runs(slices: DataFrame, bits: int = 8, gap: float = 1.0, block: int = BLOCK, singles: bool = False) -> DataFrame:
    """One row per run of two or more slices in the latest run_name of each video.

    Columns video_id, first_segment_index, last_segment_index, slice_count,
    start_second, end_second. Ids compare, and come out, trimmed and without a
    trailing ``.0``. Rows without video_id, run_name or segment_index
    are left out. Of rows repeating a segment of a video and run, one is kept
    (smallest start, end, hash). A NULL or unreadable hash and a NULL time
    continue nothing and are not continued. ``singles`` keeps runs of one
    slice too. An empty table gives no rows.
    """
    digits = F.lower(F.regexp_replace(F.trim("phash_hex"), "^0[xX]|[^0-9a-fA-F]", ""))
    # two halves: an unsigned 64-bit value has no type of its own
    half = lambda at: F.conv(F.substring(digits, at, 8), 16, 10).cast("long")
    h = F.when(F.length(digits) == 16, F.shiftleft(half(1), 32).bitwiseOR(half(9)))
    rows = slices.select(video_key(F.col("video_id")).alias("video_id"), "run_name", "segment_index", F.col("start_second").cast("double").alias("start_second"), F.col("end_second").cast("double").alias("end_second"), h.alias("h"))
    rows = rows.filter("video_id is not null and run_name is not null and segment_index is not null")
    # earlier runs go first: what they hold is neither sorted nor matched. They
    # are few beside the rows, so that no row is shuffled for it up to the bound
    pairs = checkpointed(rows.select("video_id", "run_name").distinct())
    latest = pairs.groupBy("video_id").agg(F.max("run_name").alias("last"))
    stale = pairs.join(latest, "video_id").filter("run_name < last").select("video_id", "run_name")
    if stale.count() <= MOST_STALE:
        stale = F.broadcast(stale)
    rows = rows.join(stale, ["video_id", "run_name"], "left_anti").withColumn("block", F.floor(F.col("segment_index") / F.lit(block)).cast("long"))
    ordered = rows.repartition("video_id", "run_name", "block").sortWithinPartitions("video_id", "run_name", "block", "segment_index", "start_second", "end_second", "h")
    # runs only, read three times below
    parts = checkpointed(ordered.mapInArrow(block_runs(bits, gap, singles), _OUT))

    # inner runs are done; those at a block's edge may go on in the next block
    w = Window.partitionBy("video_id", "run_name").orderBy("block", "first_segment_index")
    before = lambda c: F.lag(c).over(w)
    joins = F.col("at_head") & before("at_tail") & (F.bit_count(F.col("first_hash").bitwiseXOR(before("last_hash"))) <= bits) & (F.col("start_second") - before("last_end") <= gap + _EPS)
    edge = parts.filter("at_head or at_tail").withColumn("n", F.sum(F.when(joins, 0).otherwise(1)).over(w))
    edge = edge.groupBy("video_id", "run_name", "n").agg(F.min("first_segment_index").alias("first_segment_index"), F.max("last_segment_index").alias("last_segment_index"), F.sum("slice_count").alias("slice_count"), F.min("start_second").alias("start_second"), F.max("end_second").alias("end_second")).drop("n")
    inner = parts.filter("not at_head and not at_tail").select(*edge.columns)
    every = edge.unionByName(inner)
    if not singles:
        every = every.filter("slice_count > 1")
    return every.drop("run_name")
