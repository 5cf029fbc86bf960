"""Pixels as numpy arrays: resampling, crops, box suppression, alignment, model input. For analysers and pandas functions."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from .geometry import MAX_SIDE, PAD, THUMBNAIL

# Places of eyes, nose and mouth corners in an aligned face of 112 x 112.
ALIGNED = 112
TEMPLATE = np.array([[38.2946, 51.6963], [73.5318, 51.5014], [56.0252, 71.7366], [41.5493, 92.3655], [70.7299, 92.2041]])
OVERLAP, MOST_BOXES = 0.2, 100


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The mean of the pixels that each new pixel covers (area resampling), any number of channels."""
    image = image if image.ndim == 3 else image[:, :, None]
    h, w = image.shape[:2]
    total = np.pad(np.cumsum(np.cumsum(image.astype(np.float64), axis=0), axis=1), ((1, 0), (1, 0), (0, 0)))
    y, x = np.linspace(0, h, height + 1), np.linspace(0, w, width + 1)
    y0, x0 = np.floor(y[:-1] + 1e-9).astype(int), np.floor(x[:-1] + 1e-9).astype(int)
    y1, x1 = np.maximum(np.ceil(y[1:] - 1e-9).astype(int), y0 + 1), np.maximum(np.ceil(x[1:] - 1e-9).astype(int), x0 + 1)
    sums = total[np.ix_(y1, x1)] - total[np.ix_(y0, x1)] - total[np.ix_(y1, x0)] + total[np.ix_(y0, x0)]
    return np.rint(sums / np.outer(y1 - y0, x1 - x0)[:, :, None]).clip(0, 255).astype(np.uint8)


def downscaled(image: np.ndarray, most: int = MAX_SIDE) -> tuple[np.ndarray, float]:
    """The picture no larger than ``most`` on a side, and the factor."""
    h, w = image.shape[:2]
    if max(h, w) <= most:
        return image, 1.0
    f = min(most / w, most / h)
    return resized(image, max(1, int(h * f)), max(1, int(w * f))), f


def cropped(image: np.ndarray, x: int, y: int, w: int, h: int, pad: float = PAD, box: int = THUMBNAIL) -> np.ndarray:
    """A box with a margin, cut at the edges, shrunk to fit ``box``."""
    dx, dy = int(w * pad), int(h * pad)
    part = image[max(0, y - dy) : min(image.shape[0], y + h + dy), max(0, x - dx) : min(image.shape[1], x + w + dx)]
    if not part.size:
        return part
    f = min(1.0, box / part.shape[1], box / part.shape[0])
    return resized(part, max(1, round(part.shape[0] * f)), max(1, round(part.shape[1] * f)))


def suppressed(boxes: np.ndarray, scores: np.ndarray, overlap: float = OVERLAP, most: int = MOST_BOXES) -> list[int]:
    """Rows of ``boxes`` (x, y, w, h) to keep: the surest first, none that overlaps a kept one by more than ``overlap``."""
    keep: list[int] = []
    for i in np.argsort(-scores, kind="stable").tolist():
        x, y, w, h = boxes[i]
        for k in keep:
            kx, ky, kw, kh = boxes[k]
            both = max(0, min(x + w, kx + kw) - max(x, kx)) * max(0, min(y + h, ky + kh) - max(y, ky))
            if both > overlap * (w * h + kw * kh - both):
                break
        else:
            keep.append(i)
            if len(keep) == most:
                break
    return keep


def similarity(source: np.ndarray, target: np.ndarray = TEMPLATE) -> np.ndarray | None:
    """The 2 x 3 matrix of the turn, scale and shift that brings points closest to ``target``; None if they coincide."""
    a, b = source - source.mean(axis=0), target - target.mean(axis=0)
    size = (a**2).sum()
    if size < 1e-9:
        return None
    c, s = (a * b).sum() / size, (a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]).sum() / size
    m = np.array([[c, -s], [s, c]])
    return np.column_stack((m, target.mean(axis=0) - m @ source.mean(axis=0)))


def robust_similarity(source: np.ndarray, target: np.ndarray = TEMPLATE) -> np.ndarray | None:
    """``similarity`` of the points that agree: of the matrices that two points each give, the one whose squared errors have the least
    median says which do (those within 2.5 deviations); a point that was found in the wrong place has no say."""
    best, least = None, np.inf
    for pair in combinations(range(len(source)), 2):
        m = similarity(source[list(pair)], target[list(pair)])
        if m is None:
            continue
        errors = ((source @ m[:, :2].T + m[:, 2] - target) ** 2).sum(axis=1)
        median = float(np.median(errors))
        if median < least:
            best, least = errors, median
    if best is None:
        return None
    deviation = 1.4826 * (1 + 5 / max(1, len(source) - 2)) * np.sqrt(least)
    agree = best <= max((2.5 * deviation) ** 2, 1e-9)
    return similarity(source[agree], target[agree])


def aligned(image: np.ndarray, landmarks: np.ndarray, size: int = ALIGNED) -> np.ndarray:
    """The face brought to the template by its five points (nearest pixels), of which some may be wrong; without a fit the
    square of the template's size around the points' centre, cut at the edges."""
    points = np.asarray(landmarks, dtype=np.float64)
    m = robust_similarity(points, TEMPLATE * (size / ALIGNED))
    h, w = image.shape[:2]
    if m is None:
        (x, y), half = points.mean(axis=0), ALIGNED // 2
        part = image[max(0, int(y - half)) : min(h, int(y + half)), max(0, int(x - half)) : min(w, int(x + half))]
        return resized(part if part.size else image, size, size)
    inverse = np.linalg.inv(m[:, :2])
    ys, xs = np.mgrid[0:size, 0:size]
    at = (np.stack((xs.ravel(), ys.ravel())) - m[:, 2:]).T @ inverse.T
    px, py = np.rint(at[:, 0]).astype(int), np.rint(at[:, 1]).astype(int)
    inside = (px >= 0) & (px < w) & (py >= 0) & (py < h)
    out = np.zeros((size * size, image.shape[2]), dtype=np.uint8)
    out[inside] = image[py[inside], px[inside]]
    return out.reshape(size, size, -1)


def model_input(bgr: np.ndarray) -> np.ndarray:
    """RGB from -1 to 1, channels first."""
    return (bgr[:, :, ::-1].astype(np.float32) / 127.5 - 1.0).transpose(2, 0, 1)


_THUMB = StructType([StructField("height", IntegerType()), StructField("width", IntegerType()), StructField("data", BinaryType())])


@F.pandas_udf(_THUMB)
def thumbnails(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series, x: pd.Series, y: pd.Series, w: pd.Series, h: pd.Series) -> pd.DataFrame:
    """Thumbnails of boxes in rows of Spark's image source, as raw bytes in the source's channel order."""
    out = []
    for ih, iw, c, d, *box in zip(height, width, channels, data, x, y, w, h, strict=True):
        try:
            t = cropped(np.frombuffer(d, dtype=np.uint8).reshape(ih, iw, c), *map(int, box))
            out.append((t.shape[0], t.shape[1], t.tobytes()))
        except (TypeError, ValueError):
            out.append((None, None, None))
    return pd.DataFrame(out, columns=["height", "width", "data"]).astype({"height": "Int32", "width": "Int32"})
