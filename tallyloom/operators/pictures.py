"""Hashes and sharpness of grey pictures, a batch of pictures at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Side of the picture that is hashed, and of the low frequencies kept of it.
SIDE, LOW = 32, 8


def _low_frequencies() -> np.ndarray:
    """Cosine coefficients as one matrix from pixels to the low frequencies, both in rows.

    The orthonormal transform of the second type is separable: a coefficient's
    weights are the product of a wave down and a wave across.
    """
    waves = np.array([[np.cos(np.pi * u * (2 * x + 1) / (2 * SIDE)) for x in range(SIDE)] for u in range(LOW)])
    waves *= np.where(np.arange(LOW) == 0, np.sqrt(1 / SIDE), np.sqrt(2 / SIDE))[:, None]
    return np.einsum("ux,vy->xyuv", waves, waves).reshape(SIDE * SIDE, LOW * LOW)


def picture_hashes(pixels: np.ndarray) -> np.ndarray:
    """64-bit hashes of pictures (n, 32 * 32): which low frequencies exceed the median of all but the first."""
    c = pixels.astype(float) @ _low_frequencies()
    bits = c > np.median(c[:, 1:], axis=1, keepdims=True)
    return np.packbits(bits, axis=1).view(">u8").ravel()


def sharpness(pictures: np.ndarray) -> np.ndarray:
    """Variance of the Laplacian of pictures (n, height, width): second differences down and across, edges repeated."""
    p = pictures.astype(float)
    total = sum(np.diff(np.concatenate([p.take([0], axis), p, p.take([-1], axis)], axis), n=2, axis=axis) for axis in (1, 2))
    return total.reshape(len(p), -1).var(axis=1)


def picture_features(df: DataFrame, key: str, pixels: str) -> DataFrame:
    """``key``, ``phash_hex``, ``sharpness`` of pictures of 32 by 32 grey values in rows.

    A picture that is NULL, holds a NULL or has another size gets NULLs. An
    empty table gives no row; extra columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = b.column(1).to_pylist()
            good = [i for i, p in enumerate(given) if p is not None and len(p) == SIDE * SIDE and None not in p]
            hashes: list[str | None] = [None] * len(given)
            sharp: list[float | None] = [None] * len(given)
            if good:
                x = np.array([given[i] for i in good], float)
                for i, h, s in zip(good, picture_hashes(x).tolist(), sharpness(x.reshape(-1, SIDE, SIDE)).tolist()):
                    hashes[i], sharp[i] = f"{h:016x}", s
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hashes, pa.string()), pa.array(sharp, pa.float64())], names=[key, "phash_hex", "sharpness"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(pixels).cast("array<double>").alias(pixels)).mapInArrow(run, f"{key} {kind}, phash_hex string, sharpness double")
