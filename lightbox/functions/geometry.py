"""Boxes and picture sizes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of detection and thumbnails.
MAX_SIDE, MIN_FACE, PAD, THUMBNAIL = 4096, 40, 0.20, 150


def downscale_factor(width: Column, height: Column, most: int = MAX_SIDE) -> Column:
    """1 where both sides fit, else the factor that makes the longer one fit."""
    return F.when((width > most) | (height > most), F.least(F.lit(most) / width, F.lit(most) / height)).otherwise(F.lit(1.0))


def downscaled(side: Column, factor: Column) -> Column:
    return F.greatest(F.lit(1), (side * factor).cast("int"))


def rescaled(x: Column, factor: Column) -> Column:
    """A detector's coordinate in the original picture, truncated, never negative."""
    return F.greatest(F.lit(0), (x / factor).cast("int"))


def large_enough(w: Column, h: Column, least: int = MIN_FACE) -> Column:
    return (w >= least) & (h >= least)


def crop(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, pad: float = PAD) -> dict[str, Column]:
    """The box with a margin on each side, cut at the picture's edges."""
    dx, dy = (w * pad).cast("int"), (h * pad).cast("int")
    return {
        "crop_left": F.greatest(F.lit(0), x - dx), "crop_top": F.greatest(F.lit(0), y - dy),
        "crop_right": F.least(width, x + w + dx), "crop_bottom": F.least(height, y + h + dy),
    }


def fitted(width: Column, height: Column, box: int = THUMBNAIL) -> dict[str, Column]:
    """Thumbnail sides: shrunk to fit the box, never enlarged."""
    f = F.least(F.lit(1.0), F.lit(box) / width, F.lit(box) / height)
    return {"thumb_w": F.greatest(F.lit(1), F.round(width * f).cast("int")), "thumb_h": F.greatest(F.lit(1), F.round(height * f).cast("int"))}
