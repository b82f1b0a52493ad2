"""Hashes and boxes that lie close together."""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chatloom.functions import boxes
from chatloom.functions.boxes import hamming
from chatloom.functions.text import strip, text
from chatloom.runtime import discard, materialise


def _bands(within: int, rows: int, bits: int = 64) -> int:
    """Number of bands for ``rows`` hashes: keys of about log2(rows) bits, so that buckets stay small, in no more bands
    than are needed for one to be equal."""
    return max(1, min(within + 1, int(bits // max(log2(max(rows, 2)), 8))))


def _probes(bits: int, flips: int) -> list[int]:
    """All masks of ``bits`` bits with at most ``flips`` of them set."""
    out = [0]
    for _ in range(flips):
        out = sorted({m | (1 << i) for m in out for i in range(bits)} | set(out))
    return out


def hamming_pairs(hashes: DataFrame, ident: str, value: str, within: int = 5, bands: int | None = None) -> DataFrame:
    """``a, b, distance`` (a < b) of all pairs of different 64-bit hashes at most ``within`` bits apart. Exact; nulls are
    left out. Equal hashes stand as the first of them; ``hamming_classes`` gives the members.

    The bits are cut into bands; of two hashes within the distance, one band differs in at most ``within // bands`` bits,
    so one side is looked up by its bands and the other by its bands with so many bits flipped. The bands get wider as
    the table grows, so that buckets stay small.
    """
    classes = hamming_classes(hashes, ident, value)
    some = classes.filter(F.col(ident) == F.col("first")).select(F.col("first").alias("i"), F.col(value).alias("v"))
    some = materialise(some, "hashes")
    bands = bands or _bands(within, some.count())
    flips, edges = within // bands, [64 * i // bands for i in range(bands + 1)]

    def keys(name: str, masks: bool) -> DataFrame:
        parts = []
        for i, (low, high) in enumerate(zip(edges, edges[1:])):
            width = high - low
            mask = (1 << width) - 1
            part = F.shiftrightunsigned("v", low).bitwiseAND(F.lit(mask if mask < 1 << 63 else -1))
            flipped = [m - (1 << 64) if m >= 1 << 63 else m for m in (_probes(width, flips) if masks else [0])]
            keyed = F.transform(F.lit(flipped).cast("array<bigint>"), lambda m: part.bitwiseXOR(m))  # noqa: B023
            parts.append(F.transform(keyed, lambda k: F.struct(F.lit(i).alias("band"), k.alias("key"))))  # noqa: B023
        return some.select(F.col("i").alias(name), F.col("v").alias(f"v{name}"), F.explode(F.concat(*parts)).alias("k")).select(name, f"v{name}", "k.band", "k.key")

    near = keys("a", False).join(keys("b", True), ["band", "key"]).filter("a < b")
    near = near.withColumn("distance", hamming(F.col("va"), F.col("vb"))).filter(F.col("distance") <= within)
    return near.select("a", "b", "distance").distinct()


def hamming_classes(hashes: DataFrame, ident: str, value: str) -> DataFrame:
    """The hashes that are not null with ``first``, the lowest id with the same hash. Copies are counted before the
    shuffle, and joined by hash with one row for each."""
    some = hashes.filter(F.col(value).isNotNull()).select(ident, value)
    return some.join(some.groupBy(value).agg(F.min(ident).alias("first")), value)


def first_of_near(hashes: DataFrame, ident: str, value: str, within: int = 5) -> DataFrame:
    """The ids kept when hashes are taken in order of ``ident`` and one is dropped if a kept one lies within the distance.

    In each round the live ids without a live earlier neighbour are kept and their neighbours dropped, which equals the
    sequential rule. Each round is a written table of links; ids without links never take part.
    """
    pairs = materialise(hamming_pairs(hashes, ident, value, within), "links")
    firsts = hamming_classes(hashes, ident, value).filter(F.col(ident) == F.col("first")).select(F.col("first").alias(ident))
    dropped = None
    live = pairs.select("a", "b")
    while not live.isEmpty():
        # those that are the first of every live link they have part in
        later = live.select(F.col("b").alias("a")).distinct()
        kept = live.select("a").distinct().join(later, "a", "left_anti")
        gone = materialise(live.join(kept, "a", "left_semi").select("b").distinct(), "gone")
        dropped = gone if dropped is None else dropped.union(gone)
        ends = gone.select(F.col("b").alias("a"))
        done, live = live, materialise(live.join(gone, "b", "left_anti").join(ends, "a", "left_anti"), "live")
        discard(done)
    return firsts if dropped is None else firsts.join(dropped.select(F.col("b").alias(ident)), ident, "left_anti")


def iou_pairs(left: DataFrame, right: DataFrame, group: str, least: float = 0.65) -> DataFrame:
    """``group, a, b, iou`` of the pairs of boxes of a group that overlap by at least ``least``.

    Both sides hold ``group, id, x, y, width, height``. Boxes are joined through the grid cells they touch, of a size
    taken from each pair's own extent: two boxes that overlap so far share a cell of the side of the larger one.
    """
    def cells(df: DataFrame, name: str, both: bool) -> DataFrame:
        side = F.greatest("width", "height", F.lit(1))
        level = F.floor(F.log2(side.cast("double"))).cast("int")
        # the other box may be larger or smaller by one over the threshold
        reach = int(log2(1 / least)) + 1 if both else 0
        at = df.select(group, F.col("id").alias(name), F.struct("x", "y", "width", "height").alias(f"{name}box"), F.explode(F.sequence(level - reach, level + reach)).alias("level"))
        at = at.withColumn("cell", F.pow(F.lit(2.0), F.col("level") + 1))
        span = lambda low, size: F.sequence(F.floor(low / F.col("cell")), F.floor((low + size) / F.col("cell")))
        at = at.withColumn("cx", F.explode(span(F.col(f"{name}box.x"), F.greatest(F.col(f"{name}box.width"), F.lit(0)))))
        return at.withColumn("cy", F.explode(span(F.col(f"{name}box.y"), F.greatest(F.col(f"{name}box.height"), F.lit(0))))).drop("cell")

    near = cells(left, "a", False).join(cells(right, "b", True), [group, "level", "cx", "cy"])
    near = near.withColumn("iou", boxes.iou(boxes.box("abox."), boxes.box("bbox."))).filter(F.col("iou") >= least)
    return near.select(group, "a", "b", "iou").distinct()


def without_overlaps(regions: DataFrame, shot: str = "shot_id", most: float = 0.7) -> DataFrame:
    """``shot, x, y, width, height`` of the boxes kept when those of a screenshot are taken from the largest on and one is
    dropped if a kept one covers more than ``most`` of it. Among equal areas the order is that of ``region_seq``."""
    size = F.col("width").cast("bigint") * F.col("height")
    item = F.struct((-size).alias("rank"), "region_seq", "x", "y", "width", "height")
    shots = regions.filter(F.col(shot).isNotNull()).groupBy(shot).agg(F.sort_array(F.collect_list(item)).alias("xs"))
    parts = lambda s: (s["x"], s["y"], s["width"], s["height"])
    covered = lambda kept, r: F.exists(kept, lambda k: (boxes.overlap(parts(k), parts(r)) > 0) & (boxes.overlap(parts(k), parts(r)) / boxes.area(parts(r)) > most))
    kept = F.aggregate("xs", F.slice("xs", 1, 0), lambda kept, r: F.when(covered(kept, r), kept).otherwise(F.array_append(kept, r)))
    return shots.select(shot, F.explode(kept).alias("r")).select(shot, "r.x", "r.y", "r.width", "r.height")


def top_regions(regions: DataFrame, most: int = 50, shot: str = "shot_id") -> DataFrame:
    """The regions of each screenshot, or of one with more than ``most``: the largest, and then, in places reserved for
    them, the best of the others by squareness and area. Small ones and repeated boxes get no reserved place."""
    reserve = min(12, max(4, int(most * 0.25)))
    large = max(0, most - reserve)
    w, h = F.greatest(F.col("width"), F.lit(0)), F.greatest(F.col("height"), F.lit(0))
    size = w.cast("bigint") * h
    shots = Window.partitionBy(shot)
    rows = regions.filter(F.col(shot).isNotNull()).withColumns({"_n": F.count(F.lit(1)).over(shots), "_size": size})
    rows = rows.withColumn("_rank", F.row_number().over(shots.orderBy(F.desc("_size"), "region_seq", "x", "y", "confidence")))
    score = F.when(F.col("_size") > 0, F.least(w, h) / F.greatest(w, h) * F.col("_size")).otherwise(0.0)
    rows = rows.withColumns({"_score": score, "_media": (F.col("_rank") > large) & (F.least(w, h) >= 20) & (F.col("_size") >= 400)})
    rows = rows.withColumns({
        "_place": F.row_number().over(Window.partitionBy(shot, "_media").orderBy(F.desc("_score"), "_rank")),
        "_same": F.row_number().over(Window.partitionBy(shot, "x", "y", "width", "height").orderBy("_rank")),
    })
    kept = (F.col("_n") <= most) | (F.col("_rank") <= large) | (F.col("_media") & (F.col("_place") <= reserve) & (F.col("_same") == 1))
    return rows.filter(kept).drop("_n", "_size", "_rank", "_score", "_media", "_place", "_same")


def closest_title(regions: DataFrame, title: str, shot: str = "shot_id", least: float = 0.8) -> DataFrame:
    """``shot, text, score`` of the region of each screenshot that fits a title best: 1 where one holds the other, else
    the ratio of matching blocks; none below ``least``. Of equal scores the first by ``region_seq`` counts.

    Only texts whose length lets them reach the score, and hold no part of the title, go through Python.
    """
    import difflib

    import pyarrow as pa

    wanted = title.strip().lower()

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([difflib.SequenceMatcher(None, wanted, t).ratio() if t else 0.0 for t in texts.to_pylist()], pa.float64())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    low = F.lower(strip(text("text")))
    rows = regions.filter(F.col(shot).isNotNull()).withColumn("_t", low).filter("_t <> ''")
    within = F.col("_t").contains(wanted) | F.contains(F.lit(wanted), F.col("_t"))
    possible = F.lit(2.0) * F.least(F.length("_t"), F.lit(len(wanted))) / (F.length("_t") + len(wanted)) >= least
    rows = rows.withColumn("_in", within).filter(F.col("_in") | possible)
    ratio = F.arrow_udf(run, "double")(F.when(~F.col("_in"), F.col("_t")))
    rows = rows.withColumn("_score", ratio).withColumn("_score", F.when(F.col("_in"), 1.0).otherwise(F.col("_score"))).filter(F.col("_score") >= least)
    best = F.min(F.struct((-F.col("_score")).alias("s"), "region_seq", "text"))
    return rows.groupBy(shot).agg(best.alias("b")).select(shot, "b.text", (-F.col("b.s")).alias("score"))


def media_regions(regions: DataFrame, image_width: Column, image_height: Column, shot: str = "shot_id") -> DataFrame:
    """Regions without text that are media by their size against the text boxes of their screenshot, with ``kind``, and
    not covered by a text box (intersection over union of 0.65 or more)."""
    rows = regions.filter(F.col(shot).isNotNull())
    written = strip(text("text")) != ""
    texts, empty = rows.filter(written), rows.filter(~written)
    size = F.col("width").cast("bigint") * F.col("height")
    half = lambda c: F.coalesce(F.percentile(c, F.lit(0.5)), F.lit(0.0))
    typical = texts.groupBy(shot).agg(half("width").alias("mw"), half("height").alias("mh"), half(size).alias("ma"))
    seen = empty.join(typical, shot, "left").fillna(0.0, ["mw", "mh", "ma"])
    w, h = F.col("width"), F.col("height")
    seen = seen.filter(boxes.media_box(w, h, image_width.cast("bigint") * image_height, F.col("mw"), F.col("mh"), F.col("ma")))
    seen = seen.withColumn("kind", boxes.media_kind(w, h, image_width, image_height)).drop("mw", "mh", "ma")
    one = seen.withColumn("id", F.xxhash64("region_seq", "x", "y", "width", "height"))
    box = ["x", "y", "width", "height"]
    covered = iou_pairs(one.select(shot, "id", *box), texts.select(shot, F.lit(0).alias("id"), *box), shot).select(shot, F.col("a").alias("id"))
    return one.join(covered, [shot, "id"], "left_anti").drop("id")
