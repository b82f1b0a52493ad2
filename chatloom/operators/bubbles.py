"""From recognised lines to bubbles: lines of a screenshot that stand close together, and what a bubble holds.

A screenshot's lines are few, as a screen bounds them, so that windows by ``shot_id`` are small. Lines without a
screenshot (null) are left out. Sides and places that are null count as 0, a null text as empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chatloom.functions.text import strip, text
from chatloom.functions.times import is_separator
from chatloom.schema import OTHER, OWN


@dataclass(frozen=True)
class Layout:
    """Distances in pixels by which lines and bubbles belong together. ``split_x`` parts own from other bubbles; without
    it the middle of the screenshot's text does."""

    line_gap: int = 12
    indent: int = 40
    split_x: int | None = None
    most_bubbles: int = 5
    card_lines: tuple[int, int] = (3, 12)
    card_gap: float = 0.6
    card_deviation: float = 15.0
    compat: bool = True

    @property
    def bubble_gap(self) -> int:
        return max(self.line_gap * 5, 60)


ORDER = ("y", "x", "region_seq", "width", "height", "confidence", "text")


def clean(regions: DataFrame) -> DataFrame:
    """Regions with a screenshot, without nulls in text, place and size; ``type`` null is ``text``."""
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("x", "y", "width", "height", "region_seq")}
    rows = regions.filter("shot_id is not null")
    return rows.withColumns({**zero, "text": text("text"), "type": F.coalesce("type", F.lit("text"))})


def numbered(regions: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Cleaned regions with ``bubble``, from 1 within the screenshot: a line joins the bubble of the line before it, from
    top to bottom and left to right, if it lies close below and starts at about the same place."""
    order = Window.partitionBy("shot_id").orderBy(*ORDER)
    rows = clean(regions).withColumns({"_bottom": F.lag(F.col("y") + F.col("height")).over(order), "_x": F.lag("x").over(order)})
    apart = (F.col("y") - F.col("_bottom") > layout.line_gap) | (F.abs(F.col("x") - F.col("_x")) > layout.indent)
    rows = rows.withColumn("bubble", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(order).cast("int"))
    return rows.drop("_bottom", "_x")


def split_line(regions: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Numbered regions with ``split_x``: half of where the rightmost text ends, or the middle line's left edge where
    that is not above 0."""
    if layout.split_x is not None:
        return regions.withColumn("split_x", F.lit(layout.split_x))
    shot = Window.partitionBy("shot_id")
    right = F.max(F.col("x") + F.col("width")).over(shot)
    lefts = F.sort_array(F.collect_list("x").over(shot))
    middle = F.element_at(lefts, F.floor(F.size(lefts) / 2).cast("int") + 1)
    return regions.withColumn("split_x", F.when(right > 0, F.floor(right * 0.5)).otherwise(middle).cast("int"))


def bubbles(regions: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """One row for each bubble: ``shot_id, bubble, lines`` (stripped, blank ones left out) ``, content, raw_text,
    confidence`` (mean of those known, 0 if none is) ``, center_x, x, y, width, height`` (of the box around it)
    ``, sender, is_time, regions``."""
    rows = split_line(numbered(regions, layout), layout)
    region = F.struct("y", "x", "region_seq", "width", "height", "confidence", "text", "type")
    center = F.col("x") + F.greatest("width", F.lit(1)) / 2
    low, high = F.min("x"), F.max(F.col("x") + F.col("width"))
    top, bottom = F.min("y"), F.max(F.col("y") + F.col("height"))
    out = rows.groupBy("shot_id", "bubble").agg(
        F.sort_array(F.collect_list(region)).alias("regions"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"), F.avg(center).alias("center_x"),
        low.alias("x"), top.alias("y"), F.greatest(F.lit(1), high - low).alias("width"), F.greatest(F.lit(1), bottom - top).alias("height"), F.max("split_x").alias("split_x"),
    )
    out = out.withColumns({
        "lines": F.filter(F.transform("regions", lambda r: strip(r["text"])), lambda x: x != ""),
        "raw_text": F.array_join(F.transform("regions", lambda r: r["text"]), " "),
        "sender": F.when(F.col("center_x") >= F.col("split_x"), OWN).otherwise(OTHER),
    })
    out = out.withColumn("content", F.array_join("lines", "\n"))
    return out.withColumn("is_time", is_separator(F.col("content"), layout.compat)).drop("split_x")
