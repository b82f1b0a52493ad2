"""Measures of images, on numpy arrays and as Arrow functions over raw pixels.

An image is a struct ``height, width, channels, pixels`` with one byte for each sample, rows from the top. A null image or
one whose bytes don't fit its size gives null. Sizes are reduced by area means.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

IMAGE = "struct<height:int,width:int,channels:int,pixels:binary>"


def grey(a: np.ndarray) -> np.ndarray:
    """Brightness from 0 to 255, whole numbers as floats."""
    if a.ndim == 2 or a.shape[2] == 1:
        return a.reshape(a.shape[:2]).astype(float)
    return np.rint(a[..., :3].astype(float) @ np.array([0.299, 0.587, 0.114]))


def _weights(size: int, out: int) -> np.ndarray:
    """``out x size`` shares of the old cells in each new one."""
    edges = np.linspace(0, size, out + 1)
    left = np.maximum(edges[:-1, None], np.arange(size)[None])
    right = np.minimum(edges[1:, None], np.arange(1, size + 1)[None])
    w = np.clip(right - left, 0, None)
    return w / w.sum(axis=1, keepdims=True)


def shrink(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """The image at another size, each cell the mean of the area it covers."""
    rows, cols = _weights(a.shape[0], height), _weights(a.shape[1], width)
    return np.einsum("hi,ij...,wj->hw...", rows, a.astype(float), cols)


def difference_hash(a: np.ndarray) -> int:
    """64 bits of whether a cell is brighter than the one to its right, lowest bit first, as a signed long."""
    cells = np.rint(shrink(grey(a), 8, 9))
    bits = (cells[:, :-1] > cells[:, 1:]).ravel()
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def cache_key(a: np.ndarray) -> str:
    """Key of the recogniser's cache: the bits of whether a cell is darker than the one to its right, highest bit first,
    with the reduced size and mean. Not to be mixed with ``difference_hash``."""
    cells = np.rint(shrink(grey(a), 8, 9))
    bits = (cells[:, 1:] > cells[:, :-1]).ravel()
    return f"DH:{int.from_bytes(np.packbits(bits).tobytes(), 'big'):016x}-{a.shape[1]}x{a.shape[0]}-{int(cells.mean()):03d}"


def _blur(a: np.ndarray, size: int = 7, sigma: float = 1.5) -> np.ndarray:
    x = np.arange(size) - size // 2
    k = np.exp(-(x**2) / (2 * sigma**2))
    k /= k.sum()
    p = np.pad(a, size // 2, mode="reflect")
    p = sum(w * p[i : i + a.shape[0]] for i, w in enumerate(k))
    return sum(w * p[:, i : i + a.shape[1]] for i, w in enumerate(k))


def structural_similarity(a: np.ndarray, b: np.ndarray) -> float | None:
    """Mean structural similarity in a Gaussian window of 7; None for different sizes, which are never alike."""
    x, y = grey(a), grey(b)
    if x.shape != y.shape or min(x.shape) < 4:
        return None
    mx, my = _blur(x), _blur(y)
    vx, vy, cov = _blur(x * x) - mx * mx, _blur(y * y) - my * my, _blur(x * y) - mx * my
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return float((((2 * mx * my + c1) * (2 * cov + c2)) / ((mx * mx + my * my + c1) * (vx + vy + c2))).mean())


def similar(a: np.ndarray, b: np.ndarray, threshold: float = 0.92) -> bool:
    s = structural_similarity(a, b)
    return s is not None and s >= threshold


def quality(a: np.ndarray) -> float:
    """From 0 to 1: two fifths sharpness, the rest contrast and closeness to middle brightness."""
    g = grey(a)
    p = np.pad(g, 1, mode="reflect") if min(g.shape) > 1 else np.pad(g, 1, mode="edge")
    curve = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g
    sharp, contrast = min(curve.var() / 1000, 1), min(g.std() / 128, 1)
    return float(0.4 * sharp + 0.3 * contrast + 0.3 * (1 - abs(g.mean() - 128) / 128))


def palette(a: np.ndarray, colours: int = 32) -> np.ndarray:
    """Numbers of pixels of each of up to ``colours`` boxes of similar colours, largest first (median cut)."""
    flat, counts = np.unique(a.reshape(-1, a.shape[2] if a.ndim == 3 else 1)[:, :3], axis=0, return_counts=True)
    boxes = [(flat.astype(int), counts)]
    while len(boxes) < colours:
        spread = [np.ptp(c, axis=0).max() * (len(c) > 1) for c, _ in boxes]
        k = int(np.argmax(spread))
        if spread[k] == 0:
            break
        c, n = boxes.pop(k)
        order = np.argsort(c[:, np.ptp(c, axis=0).argmax()], kind="stable")
        c, n = c[order], n[order]
        cut = min(max(1, int(np.searchsorted(np.cumsum(n), n.sum() / 2)) + 1), len(c) - 1)
        boxes += [(c[:cut], n[:cut]), (c[cut:], n[cut:])]
    return np.array(sorted((int(n.sum()) for _, n in boxes), reverse=True))


def colour_shares(a: np.ndarray) -> dict[str, float]:
    """Shares of the largest, the second and the five largest of 32 colours, on the image reduced to 80 pixels a side."""
    h, w = a.shape[:2]
    if h * w > 6400:
        k = 80 / max(h, w)
        a = a[np.linspace(0, h - 1, max(1, int(h * k))).astype(int)][:, np.linspace(0, w - 1, max(1, int(w * k))).astype(int)]
    n = palette(a)
    total = n.sum()
    return {"top1": float(n[0] / total), "top2": float(n[1] / total) if len(n) > 1 else 0.0, "top5": float(n[:5].sum() / total)}


def plain_background(a: np.ndarray) -> bool:
    """Whether one colour holds the image and few others are in it, as in a bubble of text."""
    s = colour_shares(a)
    return s["top1"] > 0.60 and s["top5"] > 0.90 and s["top2"] < 0.22


def statistics(a: np.ndarray) -> dict[str, float]:
    """Mean, deviation, extremes, contrast and number of colours."""
    colours = len(np.unique(a.reshape(-1, a.shape[2] if a.ndim == 3 else 1), axis=0))
    low, high = int(a.min()), int(a.max())
    return {"mean": float(a.mean()), "std": float(a.std()), "min": low, "max": high, "contrast": high - low, "colours": colours}


def content_box(a: np.ndarray, tolerance: int = 15, padding: int = 15) -> tuple[int, int, int, int]:
    """``x, y, width, height`` of what differs from the top left pixel, with a margin; all of a plain image."""
    h, w = a.shape[:2]
    apart = np.abs(a.astype(int) - a[0, 0].astype(int))
    apart = apart[..., :3].sum(axis=2) if apart.ndim == 3 else apart
    ys, xs = np.nonzero(apart > tolerance)
    if h < 2 or w < 2 or not len(ys):
        return 0, 0, w, h
    x, y = max(0, int(xs.min()) - padding), max(0, int(ys.min()) - padding)
    return x, y, min(min(w, int(xs.max()) + padding) - x + 1, w - x), min(min(h, int(ys.max()) + padding) - y + 1, h - y)


def edges(g: np.ndarray, low: float, high: float) -> np.ndarray:
    """Thin edges of a grey image: gradients above ``high``, and those above ``low`` that touch them."""
    p = np.pad(g, 1, mode="edge")
    dx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    dy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    m = np.abs(dx) + np.abs(dy)
    q = np.pad(m, 1)
    side = lambda i, j: q[1 + i : 1 + i + g.shape[0], 1 + j : 1 + j + g.shape[1]]
    steep, flat = np.abs(dy) > 2.414 * np.abs(dx), np.abs(dy) < 0.414 * np.abs(dx)
    same = (dx * dy) > 0
    one = np.where(flat, side(0, -1), np.where(steep, side(-1, 0), np.where(same, side(-1, -1), side(-1, 1))))
    two = np.where(flat, side(0, 1), np.where(steep, side(1, 0), np.where(same, side(1, 1), side(1, -1))))
    peak = (m > one) & (m >= two)
    weak, found = peak & (m > low), peak & (m > high)
    while True:
        r = np.pad(found, 1)
        grown = weak & np.logical_or.reduce([r[1 + i : 1 + i + g.shape[0], 1 + j : 1 + j + g.shape[1]] for i in (-1, 0, 1) for j in (-1, 0, 1)])
        if grown.sum() == found.sum():
            return found
        found = grown


def flat(a: np.ndarray) -> bool:
    """Whether a crop holds nothing but a plain surface."""
    g = grey(a)
    dense = edges(g, 50, 150).mean()
    return bool((colour_shares(a)["top1"] > 0.95 and g.std() < 3.0) or (dense < 0.001 and g.std() < 3.0))


def _otsu(g: np.ndarray) -> float:
    n = np.bincount(g.astype(int).ravel(), minlength=256).astype(float)
    below, total = np.cumsum(n), n.sum()
    mass = np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mass[-1] * below / total - mass) ** 2 / (below * (total - below))
    return float(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def valid_picture(a: np.ndarray) -> bool:
    """Whether an image is a picture and no bubble, plain block or piece of the chat window.

    Entropy, the share of the main colour, the number of colours, edges and the window's own colours decide; the limits
    are fixed values.
    """
    h, w = a.shape[:2]
    if min(h, w) < 30:
        return False
    if max(h, w) > 1000 or h * w > 800_000:
        return True
    rgb = np.repeat(a.reshape(h, w, -1), 3, axis=2) if a.ndim == 2 or a.shape[2] == 1 else a[..., :3]
    g = grey(rgb)
    p = np.bincount(g.astype(int).ravel(), minlength=256) / g.size
    p = p[p > 0]
    entropy, content = float(-(p * np.log2(p)).sum()), g.std() > 3.5
    small = np.rint(shrink(rgb, 64, 64))
    colours, counts = np.unique(small.reshape(-1, 3), axis=0, return_counts=True)
    variety, main = len(colours) / 4096, counts.max() / 4096
    sg = grey(small)
    middle = float(np.median(sg))
    dense = float(edges(sg, max(0, 0.66 * middle), min(255, 1.33 * middle)).mean())
    dark = float((sg <= _otsu(sg)).mean())
    aspect = w / h
    rescued = 0.75 <= aspect <= 1.35 and min(h, w) >= 60 and dense >= 0.05 and (dark >= 0.06 or variety >= 0.02)
    kept = content or rescued
    part = lambda low, high: float(((small >= low) & (small <= high)).all(axis=2).mean())
    night, night_grey, day, white = part(20, 30), part(39, 49), part(240, 250), part(250, 255)
    green = part(np.array([139, 226, 95]), np.array([159, 246, 115]))
    dark_window, light_window = night + night_grey + green, day + white + green
    window = green > 0.01 and ((dark_window > 0.7 and night > 0.2) or (light_window > 0.7 and (day > 0.2 or white > 0.4)))
    surface = main > 0.7 and dark < 0.12 and aspect > 1.25 and (white > 0.7 or day > 0.7 or night > 0.6 or night_grey > 0.6)
    plain = (
        (entropy < 2.4 and main > 0.80 and variety < 0.010)
        or (entropy < 2.8 and main > 0.75 and variety < 0.015 and dense < 0.05)
        or surface
        or (light_window > 0.7 and (day > 0.3 or white > 0.55) and dense < 0.08)
    )
    strip = main > 0.85 and variety < 0.06 and 0.01 <= dark <= 0.25 and dense <= 0.22 and aspect >= 1.2 and not rescued
    if window or strip or (plain and not kept):
        return False
    if entropy < 3.0:
        return bool(content or variety >= 0.02 or dense >= 0.10)
    return not (entropy < 4.2 and main > 0.75 and variety < 0.02 and dense < 0.08)


def pixels(image) -> np.ndarray | None:
    """The array of an image struct given as a dict; None if it is null or its bytes don't fit."""
    if image is None or image["pixels"] is None or None in (image["height"], image["width"], image["channels"]):
        return None
    shape = (image["height"], image["width"], image["channels"])
    raw = np.frombuffer(image["pixels"], np.uint8)
    return raw.reshape(shape) if min(shape) > 0 and raw.size == np.prod(shape) else None


def measure(kernel: Callable, kind: str | DataType, *images: Column) -> Column:
    """A kernel over one or more image columns, in Arrow batches; null where an image is."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    spark_type = _parse_datatype_string(kind) if isinstance(kind, str) else kind
    arrow_type = to_arrow_type(spark_type)

    def one(row):
        arrays = [pixels(x) for x in row]
        return None if any(a is None for a in arrays) else kernel(*arrays)

    def run(*columns: pa.Array) -> pa.Array:
        return pa.array([one(row) for row in zip(*(c.to_pylist() for c in columns))], arrow_type)

    run.__annotations__ = {"columns": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, spark_type)(*images)
