"""Page images as arrays of grey values: degradation as old scans show it, what a page's profile needs, and PNG bytes.

Rendering text needs a font library and recognising it a model; both are plugged in. What is done to an image is planned from a seed
by column expressions, so the plan of a whole table can be read, counted and compared without touching an image.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .sampling import draw

#: Kinds of degradation, of which two to four are chosen; erosion and dilation exclude each other, erosion wins. Fixed values.
KINDS = ["blur", "noise", "erosion", "dilation", "contrast"]
#: Degrees of rotation to either side, share of speckles, bounds of contrast and brightness.
ROTATION, SPECKLES, CONTRAST, BRIGHTNESS = 2.0, 0.004, (0.5, 0.8), (30, 80)
#: Grey values below this are ink.
DARK = 128


def degradation_plan(key: Column, seed: int = 42) -> Column:
    """struct<kinds, angle>: which degradations an image gets, in order of application, and its rotation in degrees."""
    count = (2 + F.floor(draw(seed, key, F.lit("count")) * 3)).cast("int")
    order = F.array_sort(F.array(*[F.struct(draw(seed, key, F.lit(kind)).alias("u"), F.lit(kind).alias("kind")) for kind in KINDS]))
    chosen = F.transform(F.slice(order, F.lit(1), count), lambda s: s["kind"])
    applied = F.filter(F.array(*map(F.lit, ("blur", "erosion", "dilation", "noise", "contrast"))), lambda k: F.array_contains(chosen, k) & ~((k == "dilation") & F.array_contains(chosen, F.lit("erosion"))))
    return F.struct(applied.alias("kinds"), ((draw(seed, key, F.lit("angle")) * 2 - 1) * ROTATION).alias("angle"))


def _neighbours(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """All shifts of an image within a window, edges repeated: one layer a shift."""
    up, left = (rows - 1) // 2, (columns - 1) // 2
    wide = np.pad(image, ((up, rows - 1 - up), (left, columns - 1 - left)), mode="edge")
    h, w = image.shape
    return np.stack([wide[i : i + h, j : j + w] for i in range(rows) for j in range(columns)])


def rotated(image: np.ndarray, degrees: float) -> np.ndarray:
    """The image turned about its middle on white ground; each pixel takes the nearest one it came from."""
    h, w = image.shape
    turn, (cy, cx) = np.deg2rad(degrees), ((h - 1) / 2, (w - 1) / 2)
    y, x = np.mgrid[:h, :w].astype(float)
    from_x = np.rint(np.cos(turn) * (x - cx) - np.sin(turn) * (y - cy) + cx).astype(int)
    from_y = np.rint(np.sin(turn) * (x - cx) + np.cos(turn) * (y - cy) + cy).astype(int)
    inside = (from_x >= 0) & (from_x < w) & (from_y >= 0) & (from_y < h)
    out = np.full_like(image, 255)
    out[inside] = image[from_y[inside], from_x[inside]]
    return out


def degraded(image: np.ndarray, kinds: list[str], angle: float, seed: int) -> np.ndarray:
    """A grey image (uint8) after the planned degradations; speckles, strengths and blur follow the seed."""
    rng = np.random.default_rng(seed)
    for kind in kinds:
        if kind == "blur":
            k = int(rng.choice([3, 5]))
            image = np.rint(_neighbours(image, *((k, k) if rng.random() > 0.5 else (1, k))).mean(axis=0)).astype(np.uint8)
        elif kind == "erosion":
            image = _neighbours(image, 2, 2).min(axis=0)
        elif kind == "dilation":
            image = _neighbours(image, 2, 2).max(axis=0)
        elif kind == "noise":
            image = image.copy()
            n = int(np.ceil(SPECKLES * image.size / 2))
            for value in (255, 0):
                image.flat[rng.integers(0, image.size, n)] = value
        elif kind == "contrast":
            image = np.clip(image * rng.uniform(*CONTRAST) + rng.integers(BRIGHTNESS[0], BRIGHTNESS[1] + 1), 0, 255).astype(np.uint8)
    return rotated(image, angle)


def grey(image: np.ndarray) -> np.ndarray:
    """Grey values of an image that may have colours."""
    return image if image.ndim == 2 else np.rint(image[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def skew(image: np.ndarray, most: float = 5.0, step: float = 0.1) -> float:
    """Degrees by which lines of ink lean: the turn under which rows differ most in ink; 0 with under 5 dark points or a lean under 0.3."""
    y, x = np.nonzero(image < DARK)
    if len(y) < 5:
        return 0.0

    def sharpness(degrees: float) -> float:
        rows = np.rint(y - np.tan(np.deg2rad(degrees)) * x).astype(int)
        return float((np.bincount(rows - rows.min()).astype(float) ** 2).sum())

    best = max(np.arange(-most, most + step / 2, step).tolist(), key=lambda d: (sharpness(d), -abs(d)))
    return best if abs(best) >= 0.3 else 0.0


def binarised(image: np.ndarray, window: int = 31, offset: int = 10) -> np.ndarray:
    """Black where a pixel is darker than the mean around it by ``offset``, else white."""
    half = window // 2
    sums = np.pad(np.pad(image.astype(float), half, mode="edge").cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
    h, w = image.shape
    mean = (sums[window : window + h, window : window + w] - sums[:h, window : window + w] - sums[window : window + h, :w] + sums[:h, :w]) / window**2
    return np.where(image > mean - offset, 255, 0).astype(np.uint8)


def preprocessed(image: np.ndarray) -> np.ndarray:
    """The chain that historical scans go through before recognition: grey, straightened, black and white."""
    flat = grey(image)
    lean = skew(flat)
    return binarised(rotated(flat, lean) if lean else flat)


def dark_ratio(image: np.ndarray) -> float:
    """The share of ink."""
    return float((grey(image) < DARK).mean()) if image.size else 0.0


def png(image: np.ndarray) -> bytes:
    """A grey image (uint8) as a PNG file."""
    h, w = image.shape

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = np.concatenate((np.zeros((h, 1), np.uint8), image), axis=1).tobytes()  # each row without a filter
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
