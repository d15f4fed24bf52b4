"""Per-key aggregates that do not depend on how rows spread over keys.

Each input split dictionary-encodes its keys and reduces its rows into dense
numpy arrays (``bincount`` for counts, scatter-reduce for extremes). A split
then sends one array entry per distinct key it met, in blocks chosen by the
key's hash, so a key with a third of all rows costs as many shuffled entries
as there are splits. The reducers sum the array blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Entries a split holds before it sends its arrays on; bounds worker memory.
FLUSH_KEYS = 200_000
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class Accumulator:
    """Dense arrays over a growing dictionary of keys."""

    def __init__(self, sums: int, mins: int, maxs: int):
        self.codes: dict = {}
        self.sums, self.mins, self.maxs = ([np.zeros(0, np.int64)] * n for n in (sums, mins, maxs))

    def _grow(self) -> None:
        n = len(self.codes)
        for arrays, fill in ((self.sums, 0), (self.mins, _HIGH), (self.maxs, _LOW)):
            for i, a in enumerate(arrays):
                if len(a) < n:
                    arrays[i] = np.concatenate([a, np.full(max(n, 2 * len(a)) - len(a), fill, np.int64)])

    def add(self, keys: pa.Array, sums: Sequence, mins: Sequence, maxs: Sequence) -> None:
        """Reduce one batch; value arrays are aligned with the keys, NULL counts as nothing."""
        encoded = keys.dictionary_encode()
        local = encoded.indices.to_numpy(zero_copy_only=False)
        into = np.array([self.codes.setdefault(k, len(self.codes)) for k in encoded.dictionary.to_pylist()], np.int64)
        self._grow()
        size = len(into)
        for i, v in enumerate(sums):
            self.sums[i][into] += _exact_sums(local, v, size)
        for arrays, values, ufunc, fill in ((self.mins, mins, np.minimum, _HIGH), (self.maxs, maxs, np.maximum, _LOW)):
            for i, v in enumerate(values):
                part = np.full(size, fill, np.int64)
                ufunc.at(part, local, v)
                arrays[i][into] = ufunc(arrays[i][into], part)

    def drain(self) -> tuple[list, list[np.ndarray]]:
        keys, n = list(self.codes), len(self.codes)
        out = [a[:n].copy() for a in (*self.sums, *self.mins, *self.maxs)]
        self.__init__(len(self.sums), len(self.mins), len(self.maxs))
        return keys, out


def _exact_sums(local: np.ndarray, v: np.ndarray, size: int) -> np.ndarray:
    """Sums of 64-bit integers per code; bincount adds doubles, so large values go in two halves."""
    v = v.astype(np.int64)
    if not len(v) or max(abs(int(v.min())), abs(int(v.max()))) * len(v) < 1 << 53:
        return np.bincount(local, weights=v, minlength=size).astype(np.int64)
    low, high = (np.bincount(local, weights=h, minlength=size).astype(np.int64) for h in (v & 0xFFFFFFFF, v >> 32))
    return (high << 32) + low


def _values(batch: pa.RecordBatch, names: Sequence[str], missing: int) -> list[np.ndarray]:
    return [batch.column(n).fill_null(missing).to_numpy(zero_copy_only=False) for n in names]


def dense_aggregate(df: DataFrame, key: Column, sums: dict[str, Column] | None = None, mins: dict[str, Column] | None = None, maxs: dict[str, Column] | None = None, blocks: int | None = None) -> DataFrame:
    """Per-key sums, minima and maxima of integer expressions.

    Returns ``key_value`` (string), one long column per expression, in the
    order sums, mins, maxs. Rows whose key is NULL are left out. A NULL value
    adds nothing to a sum and takes no part in an extreme; a key whose values
    are all NULL has sum 0 and extreme NULL. Repeated rows count as often as
    they stand in the input. An empty table gives an empty result. Columns of
    the input may bear any name: only the given expressions are read.
    """
    sums, mins, maxs = sums or {}, mins or {}, maxs or {}
    names = [*sums, *mins, *maxs]
    n_sum, n_min, n_max = len(sums), len(mins), len(maxs)
    blocks = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    picked = df.select(key.cast("string").alias("key_value"), *(c.cast("long").alias(n) for n, c in (sums | mins | maxs).items())).filter("key_value is not null")
    schema = T.StructType([T.StructField("key_value", T.StringType()), *(T.StructField(n, T.LongType()) for n in names)])

    def reduce_split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = Accumulator(n_sum, n_min, n_max)

        def sent() -> pa.RecordBatch:
            keys, arrays = acc.drain()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array(a, pa.int64()) for a in arrays)], names=["key_value", *names])

        for b in batches:
            if b.num_rows:
                acc.add(b.column("key_value"), _values(b, names[:n_sum], 0), _values(b, names[n_sum : n_sum + n_min], _HIGH), _values(b, names[n_sum + n_min :], _LOW))
            if len(acc.codes) > FLUSH_KEYS:
                yield sent()
        if acc.codes:
            yield sent()

    def sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a block is a hash range of keys, sorted: only the last key of a batch
        # may go on, so memory is one batch, however many keys there are
        acc = Accumulator(n_sum, n_min, n_max)
        for b in batches:
            if not b.num_rows:
                continue
            acc.add(b.column("key_value"), _values(b, names[:n_sum], 0), _values(b, names[n_sum : n_sum + n_min], _HIGH), _values(b, names[n_sum + n_min :], _LOW))
            keys, arrays = acc.drain()
            if len(keys) > 1:
                yield pa.RecordBatch.from_arrays([pa.array(keys[:-1], pa.string()), *(pa.array(a[:-1], pa.int64()) for a in arrays)], names=["key_value", *names])
            last = [a[-1:] for a in arrays]
            acc.add(pa.array(keys[-1:], pa.string()), last[:n_sum], last[n_sum : n_sum + n_min], last[n_sum + n_min :])
        keys, arrays = acc.drain()
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array(a, pa.int64()) for a in arrays)], names=["key_value", *names])

    partial = picked.mapInArrow(reduce_split, schema)
    total = partial.repartition(blocks, "key_value").sortWithinPartitions("key_value").mapInArrow(sum_blocks, schema)
    return total.select("key_value", *list(sums), *(F.when(F.col(n) != _HIGH, F.col(n)).alias(n) for n in mins), *(F.when(F.col(n) != _LOW, F.col(n)).alias(n) for n in maxs))


def heavy_keys(df: DataFrame, key: Column, share: float) -> DataFrame:
    """Keys holding at least ``share`` of the rows whose key is not NULL.

    Columns ``key_value``, ``n_rows``. Ties at the threshold are all kept. An
    empty table, or one with NULL keys only, gives no rows.
    """
    counts = dense_aggregate(df, key, sums={"n_rows": F.lit(1)})
    # a scalar subquery of one long, over the same exchange
    total = counts.agg(F.sum("n_rows")).scalar()
    return counts.filter(F.col("n_rows") >= F.lit(share) * total)
