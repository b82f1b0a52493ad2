"""Geometry of boxes and distances of hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _side(c: Column) -> Column:
    return F.greatest(c, F.lit(0))


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    """The columns ``x, y, width, height``, of a struct or table if a prefix names one."""
    return tuple(F.col(f"{prefix}{n}") for n in ("x", "y", "width", "height"))


def overlap(a, b) -> Column:
    """Area common to two boxes, as a long; sides below zero count as zero."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = a, b
    w = F.least(ax + _side(aw), bx + _side(bw)) - F.greatest(ax, bx)
    h = F.least(ay + _side(ah), by + _side(bh)) - F.greatest(ay, by)
    return _side(w).cast("bigint") * _side(h)


def area(a) -> Column:
    return _side(a[2]).cast("bigint") * _side(a[3])


def iou(a, b) -> Column:
    """Intersection over union; 0 where the union is empty, null where a side or corner is null."""
    common = overlap(a, b)
    union = area(a) + area(b) - common
    return F.when(union > 0, common / union).when(union <= 0, F.lit(0.0))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def clamped(a, image_width: Column, image_height: Column) -> Column:
    """A box within an image of the given size, as a struct."""
    x, y, w, h = a
    x = F.greatest(F.lit(0), F.least(x, image_width - 1))
    y = F.greatest(F.lit(0), F.least(y, image_height - 1))
    return F.struct(x.alias("x"), y.alias("y"), F.least(w, image_width - x).alias("width"), F.least(h, image_height - y).alias("height"))


def media_box(width: Column, height: Column, image_area: Column, median_width: Column, median_height: Column, median_area: Column) -> Column:
    """Whether a box without text is rather an image or sticker, by its size against the medians of text boxes (0 if
    there are none). Pixels are looked at separately, in ``images.flat``."""
    w, h = _side(width), _side(height)
    size, least, aspect = w.cast("bigint") * h, F.least(w, h), w / F.greatest(h, F.lit(1))
    larger = lambda value, median, times: (median > 0) & (value >= median * times)
    no_text = (median_width == 0) & (median_height == 0) & (median_area == 0)
    bigger = larger(w, median_width, 1.6) | larger(h, median_height, 1.6) | larger(size, median_area, 2.4) | (no_text & ((least >= 30) | (size >= 900)))
    sticker = aspect.between(0.4, 2.5) & (least >= 20) & (size >= 400)
    seen = (least >= 10) & ((size / F.greatest(image_area, F.lit(1)) >= 0.0001) | (size >= 100))
    return F.coalesce(seen & (bigger | sticker) & aspect.between(0.2, 5.0), F.lit(False))


def media_kind(width: Column, height: Column, image_width: Column, image_height: Column) -> Column:
    """``sticker`` or ``image`` of a box that holds media."""
    w, h = _side(width), _side(height)
    side = F.bround(F.least(image_width, image_height) * 0.38, 0)
    share = w.cast("bigint") * h / F.greatest(image_width.cast("bigint") * image_height, F.lit(1))
    small = (w / F.greatest(h, F.lit(1))).between(0.75, 1.35) & F.least(w, h).between(40, 340) & (F.greatest(w, h) <= side) & (share <= 0.10)
    return F.when(small, "sticker").otherwise("image")


def enhanced_confidence(confidence: Column, quality: Column) -> Column:
    return F.least(confidence * 0.7 + quality * 0.3, F.lit(1.0))


def hit_band(rate: Column, good: float = 0.7, bad: float = 0.3) -> Column:
    """``good``, ``bad`` or ``warn`` of a rate, held between 0 and 1; null and NaN count as 0. Good is tested first."""
    r = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(rate, F.lit(0.0)), F.lit(0.0))))
    return F.when(r >= good, "good").when(r <= bad, "bad").otherwise("warn")


def rate(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 where the whole is zero or null."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
