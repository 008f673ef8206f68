"""Picture kernels in numpy, run in Arrow batches: what SQL expressions can't do."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frame geometry and limits of the fingerprint.
SIDE, LOW, CROP_MOST, CROP_DARK, CROP_SHRINK, BLANK_SIGMA = 32, 8, 16, 24.0, 0.08, 10.0
HUES, SATURATIONS = 30, 32

_COSINES = np.cos(np.pi * np.outer(np.arange(LOW), 2 * np.arange(SIDE) + 1) / (2 * SIDE))


def coefficients(picture: np.ndarray) -> np.ndarray:
    """The low 8 by 8 block of the cosine transform of a 32 by 32 picture, row by row."""
    return (_COSINES @ picture @ _COSINES.T).reshape(-1)


def hash_of(values: np.ndarray) -> int:
    """Bit i where value i exceeds the median of values 1 to 63, as a signed long."""
    bits = values > np.median(values[1:])
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def orientations(picture: np.ndarray) -> list[int]:
    """Hashes of a square picture, plain and mirrored, each in four turns."""
    return [hash_of(coefficients(np.rot90(side, turn))) for side in (picture, picture[:, ::-1]) for turn in range(4)]


def resized(picture: np.ndarray, top: float, left: float, height: float, width: float, side: int = SIDE) -> np.ndarray:
    """Bilinear samples of a box at pixel centres, clamped to the picture."""

    def weights(start, length, limit):
        at = np.clip(start + (np.arange(side) + 0.5) * length / side - 0.5, 0, limit - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, limit - 1), at - low

    y0, y1, fy = weights(top, height, picture.shape[0])
    x0, x1, fx = weights(left, width, picture.shape[1])
    rows = picture[y0] * (1 - fy)[:, None] + picture[y1] * fy[:, None]
    return rows[:, x0] * (1 - fx) + rows[:, x1] * fx


def cropped(frame: np.ndarray) -> np.ndarray:
    """The frame without dark bars and an edge of 8 %, as 32 by 32."""

    def dark(lines):
        return next((k for k in range(min(CROP_MOST, len(lines))) if lines[k].mean() >= CROP_DARK), min(CROP_MOST, len(lines)))

    top, bottom, left, right = dark(frame), dark(frame[::-1]), dark(frame.T), dark(frame.T[::-1])
    height, width = frame.shape[0] - top - bottom, frame.shape[1] - left - right
    if height <= 0 or width <= 0:
        top, left, (height, width) = 0, 0, frame.shape
    return resized(frame.astype(float), top + CROP_SHRINK * height, left + CROP_SHRINK * width, height * (1 - 2 * CROP_SHRINK), width * (1 - 2 * CROP_SHRINK))


def fingerprint(frame: np.ndarray) -> tuple[int, int, bool]:
    """(hash, mirrored hash, usable) of one second's grey frame."""
    small = cropped(frame)
    return hash_of(coefficients(small)), hash_of(coefficients(small[:, ::-1])), bool(small.std() >= BLANK_SIGMA)


def frame_fingerprints(frames: DataFrame, side: int = 64) -> DataFrame:
    """frames (folder, video_id, sec, pixels) to fingerprints; frames of another size are left out."""

    def run(batches):
        for pdf in batches:
            pdf = pdf[[len(p or b"") == side * side for p in pdf.pixels]]
            made = [fingerprint(np.frombuffer(p, np.uint8).reshape(side, side)) for p in pdf.pixels]
            out = pdf[["folder", "video_id", "sec"]].copy()
            out["hash"], out["mirror_hash"], out["usable"] = ([m[k] for m in made] for k in range(3))
            yield out

    return frames.mapInPandas(run, "folder string, video_id long, sec int, hash long, mirror_hash long, usable boolean")


def _hsv_histogram(height: int, width: int, data: bytes) -> np.ndarray:
    pixels = np.frombuffer(data, np.uint8).reshape(height * width, -1)[:, :3].astype(float)
    b, g, r = pixels.T
    high, low = pixels.max(axis=1), pixels.min(axis=1)
    span = high - low
    safe = np.where(span > 0, span, 1)
    hue = np.where(high == r, (g - b) / safe % 6, np.where(high == g, (b - r) / safe + 2, (r - g) / safe + 4)) * 30
    hue = np.where(span > 0, hue, 0)
    saturation = np.where(high > 0, span / np.where(high > 0, high, 1), 0) * 255
    counts, _, _ = np.histogram2d(hue, saturation, bins=(HUES, SATURATIONS), range=((0, 180), (0, 256)))
    least, most = counts.min(), counts.max()
    return ((counts - least) / (most - least) if most > least else counts * 0).reshape(-1).astype(np.float32)


def hsv_histogram(height: Column, width: Column, data: Column) -> Column:
    """30 by 32 hue and saturation counts of BGR pixels, scaled to [0, 1]."""

    @F.pandas_udf("array<float>")
    def run(h: pd.Series, w: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([_hsv_histogram(*row) for row in zip(h, w, d, strict=True)])

    return run(height, width, data)


def picture_hashes(height: Column, width: Column, data: Column) -> Column:
    """The eight orientation hashes of BGR pictures."""

    @F.pandas_udf("array<long>")
    def run(h: pd.Series, w: pd.Series, d: pd.Series) -> pd.Series:
        def one(height, width, data):
            pixels = np.frombuffer(data, np.uint8).reshape(height, width, -1)[:, :, :3].astype(float)
            grey = pixels @ np.array([0.114, 0.587, 0.299])
            return orientations(resized(grey, 0, 0, height, width))

        return pd.Series([one(*row) for row in zip(h, w, d, strict=True)])

    return run(height, width, data)
