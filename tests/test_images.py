"""Measures of pictures, on arrays made here."""

import numpy as np
from pyspark.sql import functions as F

from chatloom.functions import images


def circle(size=100, colour=(255, 0, 0)):
    a = np.full((size, size, 3), 255, np.uint8)
    y, x = np.mgrid[:size, :size]
    a[(x - size / 2) ** 2 + (y - size / 2) ** 2 < (size / 3) ** 2] = colour
    return a


def line(size=100):
    a = np.full((size, size, 3), 255, np.uint8)
    a[np.arange(size), np.arange(size)] = a[np.arange(size - 1), np.arange(1, size)] = (0, 128, 0)
    return a


def distance(a, b):
    return ((images.difference_hash(a) ^ images.difference_hash(b)) & (1 << 64) - 1).bit_count()


def test_hashes():
    a, b = circle(), circle()
    b[50, 50] = (0, 0, 0)
    assert distance(a, a) == 0 and distance(a, b) <= 5 and distance(a, line()) > 5
    assert images.cache_key(a).startswith("DH:") and images.cache_key(a) != images.cache_key(circle(90))
    # brighter to the left is one hash's bit, to the right the other's
    ramp = np.tile(np.arange(0, 180, 2, dtype=np.uint8), (80, 1))
    assert images.difference_hash(ramp) == 0 and images.difference_hash(ramp[:, ::-1]) == -1
    assert images.cache_key(ramp).startswith("DH:ffffffffffffffff")


def test_similarity_and_quality():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (300, 400), dtype=np.uint8)
    b = np.clip(a + rng.normal(0, 3, a.shape), 0, 255).astype(np.uint8)
    assert images.structural_similarity(a, b) >= 0.9 and images.structural_similarity(a, a) > 0.9999
    assert not images.similar(np.zeros((50, 50), np.uint8), np.full((50, 50), 255, np.uint8), 0.95)
    assert images.structural_similarity(a, a[:10]) is None and not images.similar(a, a[:10])
    assert 0 <= images.quality(np.zeros((9, 9), np.uint8)) < images.quality(a) <= 1


def test_content():
    plain = np.full((80, 300, 3), (149, 236, 105), np.uint8)
    assert images.plain_background(plain) and images.flat(plain) and not images.valid_picture(plain)
    photo = np.random.default_rng(2).integers(0, 256, (120, 120, 3), dtype=np.uint8)
    assert images.valid_picture(photo) and not images.flat(photo) and not images.plain_background(photo)
    assert not images.valid_picture(photo[:20]) and images.valid_picture(np.zeros((1200, 50, 3), np.uint8))
    a = np.zeros((100, 100, 3), np.uint8)
    a[40:60, 30:50] = 200
    assert images.content_box(a) == (15, 25, 50, 50) and images.content_box(plain) == (0, 0, 300, 80)
    shares = images.colour_shares(a)
    assert shares["top1"] == 0.96 and abs(shares["top5"] - 1) < 1e-9
    assert images.statistics(a) == {"mean": 8.0, "std": a.std(), "min": 0, "max": 200, "contrast": 200, "colours": 2}


def test_columns(spark):
    a = circle(40)
    rows = [(1, (40, 40, 3, bytearray(a.tobytes()))), (2, None), (3, (40, 40, 3, bytearray(b"short")))]
    df = spark.createDataFrame(rows, f"i int, image {images.IMAGE}").orderBy("i")
    got = df.select(images.measure(images.difference_hash, "bigint", F.col("image")).alias("h"), images.measure(images.structural_similarity, "double", F.col("image"), F.col("image")).alias("s")).collect()
    assert got[0].h == images.difference_hash(a) and got[0].s > 0.999 and got[1].h is None and got[2].h is None
