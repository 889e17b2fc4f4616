"""Pixel evidence of decoded images, in Arrow batches.

Spark's `image` source decodes JPEG and PNG into BGR bytes. One UDF turns the bytes of an image into a few
numbers and small gray grids; fingerprints of the grids are built-in expressions again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filetrail.functions.fingerprints import ahash, dhash, phash, whash
from filetrail.operators.grids import BLOCK, SEARCH, THIN_SIDE

PIXEL_SCHEMA = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in ("min_flat_std", "mean_residual_noise", "chromatic_aberration_px")]
    + [T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("square32", "square8", "row9", "square64")]
)


def gray_levels(pixels: np.ndarray) -> np.ndarray:
    """Gray levels of a BGR(A) or one-channel image, in the same fixed-point form as `luma`."""
    if pixels.shape[2] < 3:
        return pixels[:, :, 0].astype(np.int64)
    b, g, r = (pixels[:, :, i].astype(np.int64) for i in range(3))
    return (r * 19595 + g * 38470 + b * 7471 + 32768) >> 16


def shrink(gray: np.ndarray, rows: int, cols: int) -> list[float]:
    """Area means on a rows x cols grid; cells of small images repeat the nearest pixel."""
    def edges(size: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        start = np.arange(parts) * size // parts
        return start, np.maximum(start + 1, (np.arange(parts) + 1) * size // parts)

    sums = np.zeros((gray.shape[0] + 1, gray.shape[1] + 1))
    sums[1:, 1:] = gray.cumsum(0).cumsum(1)
    y0, y1 = edges(gray.shape[0], rows)
    x0, x1 = edges(gray.shape[1], cols)
    total = sums[np.ix_(y1, x1)] - sums[np.ix_(y0, x1)] - sums[np.ix_(y1, x0)] + sums[np.ix_(y0, x0)]
    return (total / np.outer(y1 - y0, x1 - x0)).ravel().tolist()


def flat_std(gray: np.ndarray, block: int = BLOCK) -> float:
    h, w = gray.shape
    if h < block or w < block:
        return float(gray.std())
    cut = gray[: h // block * block, : w // block * block].astype(float)
    return float(cut.reshape(h // block, block, w // block, block).std(axis=(1, 3)).min())


def residual(gray: np.ndarray) -> float:
    padded = np.pad(gray.astype(np.uint8), 1, mode="edge")
    total = 0
    for top in range(0, gray.shape[0], 256):  # in stripes, so that the nine shifted copies stay small
        part = gray[top:top + 256]
        around = np.lib.stride_tricks.sliding_window_view(padded[top:top + len(part) + 2], (3, 3))
        middle = np.partition(around.reshape(*part.shape, 9), 4, axis=2)[:, :, 4]
        total += int(np.abs(part - middle).sum())
    return total / gray.size


def misalignment(pixels: np.ndarray) -> float | None:
    if pixels.shape[2] < 3:
        return None
    step = max(1, min(pixels.shape[:2]) // THIN_SIDE)
    blue, green, red = (
        np.hypot(*np.gradient(pixels[::step, ::step, i].astype(float))) for i in range(3)
    )
    reach = range(-SEARCH, SEARCH + 1)

    def shift(edges: np.ndarray) -> float:
        _, dy, dx = min(
            (float(((np.roll(edges, (dy, dx), (0, 1)) - green) ** 2).mean()), dy, dx) for dy in reach for dx in reach
        )
        return float(np.hypot(dy, dx))

    return round((shift(red) + shift(blue)) / 2, 4)


@F.pandas_udf(PIXEL_SCHEMA)
def pixel_evidence(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.DataFrame:
    """Statistics that fail on an image (too small, odd channel count) come out NULL, one by one."""
    def attempt(work, *args):
        try:
            return work(*args)
        except (ValueError, IndexError):
            return None

    rows = []
    for h, w, c, raw in zip(height, width, channels, data):
        pixels = np.frombuffer(raw, np.uint8).reshape(h, w, c)
        gray = gray_levels(pixels)
        noise = attempt(residual, gray)
        rows.append((
            flat_std(gray), None if noise is None else round(noise, 4), attempt(misalignment, pixels),
            shrink(gray, 32, 32), shrink(gray, 8, 8), shrink(gray, 8, 9), shrink(gray, 64, 64),
        ))
    return pd.DataFrame(rows, columns=PIXEL_SCHEMA.names)


def image_evidence(images: DataFrame, key: str = "path") -> DataFrame:
    """Per decoded image: size, flatness, diagnostics and the four fingerprints as hex.

    `images` comes from `spark.read.format("image")`; rows that did not decode are dropped by the source
    option `dropInvalid` or have height -1 and are left out here.
    """
    decoded = images.filter("image.height > 0").select(
        # Local paths are spelled file:/// here and file:/ by the file source.
        F.regexp_replace("image.origin", "^file:/+", "file:/").alias(key), "image.height", "image.width",
        pixel_evidence("image.height", "image.width", "image.nChannels", "image.data").alias("p"),
    )
    return decoded.select(
        key, "width", "height", "p.min_flat_std", "p.mean_residual_noise", "p.chromatic_aberration_px",
        phash(F.col("p.square32"), 32).alias("phash"),
        dhash(F.col("p.row9"), 8, 9).alias("dhash"),
        ahash(F.col("p.square8"), 64).alias("ahash"),
        whash(F.col("p.square64"), 64).alias("whash"),
    )
