"""From bubbles to messages.

How many bubbles a message takes depends on what they turn out to be, so a message's start depends on all before it. Here
every bubble is read as if a message began there: the bubbles it may take, the type it would get, and how many bubbles
that uses up. Which of these are messages follows from hopping through the numbers of bubbles used, over one small array
for each screenshot. All of it stays in built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chatloom.functions.cards import CARD_HINTS, compact_card, quote_meta, share_card, without_quote
from chatloom.functions.kinds import IMAGE_HINTS, SYSTEM_HINTS, VOICE_HINTS, empty_kind, garbage, image_with_text, merges_as_text, own_log, sticker_text, text_kind
from chatloom.functions.text import filled, has_any
from chatloom.functions.times import is_separator, parse_relative
from chatloom.schema import SYSTEM_SENDER

from .bubbles import Layout, bubbles


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(values), F.lit(1))


def _box(regions: Column) -> Column:
    low, high = F.array_min(F.transform(regions, lambda r: r["x"])), F.array_max(F.transform(regions, lambda r: r["x"] + r["width"]))
    top, bottom = F.array_min(F.transform(regions, lambda r: r["y"])), F.array_max(F.transform(regions, lambda r: r["y"] + r["height"]))
    return F.struct(low.alias("x"), top.alias("y"), (high - low).alias("width"), (bottom - top).alias("height"))


def _pictured(regions: Column, content: Column) -> Column:
    box = _box(regions)
    tallest = F.array_max(F.transform(regions, lambda r: r["height"]))
    confidence = _mean(F.transform(regions, lambda r: F.coalesce(r["confidence"], F.lit(0.0))))
    return image_with_text(tallest, box["height"], box["width"], F.size(regions), confidence, content)


def _marked(regions: Column, *types: str) -> Column:
    return F.exists(regions, lambda r: r["type"].isin(*types))


def is_compact(regions: Column, layout: Layout = Layout()) -> Column:
    """Whether lines (ordered from the top) form a card: a few, close together, starting at the same place."""
    n = F.size(regions)
    gaps = F.zip_with(F.slice(regions, 1, F.greatest(n - 1, F.lit(0))), F.slice(regions, 2, F.greatest(n, F.lit(1))), lambda a, b: F.greatest(F.lit(0), b["y"] - a["y"] - a["height"]))
    height = F.greatest(F.lit(1.0), _mean(F.transform(regions, lambda r: r["height"].cast("double"))))
    xs = F.transform(regions, lambda r: r["x"].cast("double"))
    middle = _mean(xs)
    deviation = F.sqrt(F.greatest(F.lit(0.0), _mean(F.transform(xs, lambda x: x * x)) - middle * middle))
    return n.between(*layout.card_lines) & (F.coalesce(F.array_max(gaps), F.lit(0)) / height <= layout.card_gap) & (deviation <= layout.card_deviation)


def _taken(run: Column, layout: Layout) -> Column:
    """How many of the bubbles, from the first on, may be one message."""
    first = run[0]

    def step(state: Column, k: Column) -> Column:
        last, now = F.get(run, k - 1), F.get(run, k)
        near = (now["y"] - last["y"] - last["height"] <= layout.bubble_gap) & (F.abs(now["center_x"] - first["center_x"]) <= layout.indent * 2)
        joins = state["open"] & ~now["is_time"] & (now["sender"] == first["sender"]) & near
        return F.struct((state["n"] + joins.cast("int")).alias("n"), joins.alias("open"))

    begin = F.struct(F.lit(1).alias("n"), (~first["is_time"]).alias("open"))
    return F.when(F.size(run) < 2, 1).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(run) - 1, F.lit(1))), begin, step)["n"])


def parse(regions: DataFrame, run_time: Column, layout: Layout = Layout()) -> DataFrame:
    """Messages of screenshots: ``shot_id, place, id`` (``shot_id#place``) and the columns of a message up to its region.

    ``run_time`` is the reference for relative times and the time before the first separator; it may use
    ``shot_id`` only. The id is the place, so that parsing again gives the same; a screenshot seen twice
    gives its messages twice. Screenshots without regions give none.
    """
    found = bubbles(regions, layout)
    order = Window.partitionBy("shot_id").orderBy("bubble")
    ahead = order.rowsBetween(0, layout.most_bubbles - 1)
    info = F.struct("lines", "content", "raw_text", "confidence", "center_x", "x", "y", "width", "height", "sender", "is_time", "regions")
    rows = found.withColumn("run", F.collect_list(info).over(ahead))
    rows = rows.withColumn("taken", _taken(F.col("run"), layout)).withColumn("run", F.slice("run", 1, F.col("taken")))
    rows = rows.select(
        "shot_id", "bubble", "taken", "sender", "lines", "content", "raw_text", "confidence", "x", "y", "width", "height", "regions",
        F.flatten(F.transform("run", lambda b: b["lines"])).alias("all_lines"), F.flatten(F.transform("run", lambda b: b["regions"])).alias("all_regions"),
        F.array_join(F.transform("run", lambda b: b["raw_text"]), " ").alias("all_raw"), _mean(F.transform("run", lambda b: b["confidence"])).alias("all_confidence"),
        F.exists("run", lambda b: has_any(b["content"], IMAGE_HINTS + VOICE_HINTS + SYSTEM_HINTS)).alias("hinted"),
    )
    rows = rows.withColumn("all_text", F.array_join("all_lines", "\n"))
    all_regions, all_text = F.col("all_regions"), F.col("all_text")
    rows = rows.withColumns({
        "card": share_card(all_text),
        "poster": ~_marked(all_regions, "sticker") & filled(all_text) & ~sticker_text(all_text) & _pictured(all_regions, all_text),
        "joined": (F.col("taken") >= 2) & ~F.col("hinted") & merges_as_text(F.col("all_lines")),
        "compact": is_compact(F.sort_array(all_regions), layout) & (has_any(all_text, CARD_HINTS) | F.lower(all_text).contains("bilibili") | has_any(all_text, ("http://", "https://"))),
        "single": F.array_join(without_quote(F.col("lines")), "\n"),
    })
    how = F.when(F.col("poster"), "poster").when(F.col("card").isNotNull(), "card").when(F.col("joined"), "joined").when(F.col("compact"), "compact")
    how = how.when(own_log(F.col("single")), "skip").otherwise("single")
    rows = rows.withColumns({"how": how, "noise": garbage(F.col("single"))})
    rows = rows.withColumn("uses", F.when(F.col("how").isin("poster", "card", "joined", "compact"), F.col("taken")).otherwise(1))
    # empty once it is noise, before its type is looked for
    rows = rows.withColumn("body", F.when(F.col("noise"), "").otherwise(F.col("single")))
    body, marked = F.col("body"), F.col("regions")
    separator = is_separator(body, layout.compat)
    without_text = empty_kind(F.col("width"), F.col("height"), _marked(marked, "image", "sticker"), _marked(marked, "sticker"), F.col("noise"))
    with_text = F.when(_marked(marked, "sticker"), "sticker").when(_marked(marked, "image"), "image").when(_pictured(marked, body), "image").otherwise(text_kind(body))
    # the sticker's test sees the text as it was before noise was taken out
    alone = F.when(separator, "system").when(sticker_text(F.col("single")), "sticker").when(filled(body), with_text).otherwise(without_text)
    joined_text = F.array_join(without_quote(F.col("all_lines")), "\n")
    how, many = F.col("how"), F.col("how").isin("poster", "card", "joined", "compact")
    box = F.struct("x", "y", "width", "height")
    rows = rows.select(
        "shot_id", "bubble", "uses", "how",
        F.when((how == "single") & separator, SYSTEM_SENDER).otherwise(F.col("sender")).alias("sender"),
        F.when(how == "poster", F.when(garbage(all_text), "").otherwise(all_text)).when(how == "joined", joined_text).when(many, all_text).otherwise(body).alias("content"),
        F.when(how == "poster", "image").when(how.isin("card", "compact"), "share").when(how == "joined", F.when(filled(joined_text), "text").otherwise("unknown")).otherwise(alone).alias("message_type"),
        F.when(many, F.col("all_confidence")).otherwise(F.col("confidence")).alias("confidence_score"),
        F.when(many, F.col("all_raw")).otherwise(F.col("raw_text")).alias("raw_ocr_text"),
        F.when(how == "card", F.col("card")).when(how == "compact", compact_card(all_text)).alias("share_card"),
        F.when(how == "joined", quote_meta(F.col("all_lines"))).when((how == "single") & ~separator, quote_meta(F.col("lines"))).alias("quote_meta"),
        F.when(how == "poster", _box(all_regions)).when((how == "single") & ~separator, box).alias("original_region"),
        ((how == "single") & separator).alias("separator"),
    )
    each = F.struct("bubble", "uses", "how", "sender", "content", "message_type", "confidence_score", "raw_ocr_text", "share_card", "quote_meta", "original_region", "separator")
    shots = rows.groupBy("shot_id").agg(F.sort_array(F.collect_list(F.struct("bubble", each.alias("m")))).alias("ms")).withColumn("_run", run_time)
    hop = lambda s, m: F.when(m["m"]["bubble"] < s["next"], s).otherwise(F.struct((m["m"]["bubble"] + m["m"]["uses"]).alias("next"), F.array_append(s["starts"], m["m"]["bubble"]).alias("starts")))
    begin = F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("starts"))
    shots = shots.withColumn("starts", F.aggregate("ms", begin, hop)["starts"])
    kept = F.filter("ms", lambda m: F.array_contains("starts", m["m"]["bubble"]) & (m["m"]["how"] != "skip"))
    out = shots.select("shot_id", "_run", F.posexplode(kept).alias("_p", "_m")).select("shot_id", "_run", (F.col("_p") + 1).alias("place"), "_m.m.*")
    seen = Window.partitionBy("shot_id").orderBy("place")
    time = F.when(F.col("separator"), parse_relative(F.col("content"), F.col("_run")))
    out = out.withColumn("timestamp", F.coalesce(F.last(time, True).over(seen), F.col("_run")))
    return out.select(
        "shot_id", "place", F.concat_ws("#", "shot_id", "place").alias("id"), "sender", "content", "message_type", "timestamp", "confidence_score", "raw_ocr_text",
        F.lit(None).cast("timestamp_ntz").alias("message_time"), "share_card", "quote_meta", "original_region",
    )
