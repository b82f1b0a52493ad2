"""Summaries of messages, regions, runs and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chatloom.functions.boxes import rate
from chatloom.functions.text import strip, text
from chatloom.schema import OTHER, OWN

from .scan import BLOCK, run_length, running_sum, until_run


def sender_counts(messages: DataFrame) -> DataFrame:
    """``own, other, total``: rows of 我, of 对方, and all."""
    count = lambda who: F.count_if(F.coalesce(F.col("sender") == who, F.lit(False)))
    return messages.agg(count(OWN).alias("own"), count(OTHER).alias("other"), F.count(F.lit(1)).alias("total"))


def session_summary(messages: DataFrame) -> DataFrame:
    """``span, longest_streak, longest_gap`` in days over the distinct days with messages; zeros without rows."""
    days = messages.filter("timestamp is not null").select(F.to_date("timestamp").alias("d")).distinct()
    order = Window.orderBy("d")  # days only: one row each
    islands = days.withColumn("gap", F.datediff("d", F.lag("d").over(order))).withColumn("k", F.date_sub("d", F.row_number().over(order)))
    runs = islands.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("gap") != 1, F.col("gap") - 1)).alias("gap"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    whole = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    return runs.agg(whole(F.datediff(F.max("hi"), F.min("lo")) + 1).alias("span"), whole(F.max("n")).alias("longest_streak"), whole(F.max("gap")).alias("longest_gap"))


def days_by(messages: DataFrame, *keys: str) -> DataFrame:
    """Distinct days with messages of each group, and the days from the first to the last."""
    day = F.to_date("timestamp")
    span = F.coalesce(F.datediff(F.max(day), F.min(day)) + 1, F.lit(0))
    # days are made distinct before they are counted, so that a large group is counted in parts
    return messages.groupBy(*keys, day.alias("_d")).agg(F.lit(1)).groupBy(*keys).agg(F.count("_d").alias("days"), F.coalesce(F.datediff(F.max("_d"), F.min("_d")) + 1, F.lit(0)).alias("span")) if keys else messages.agg(F.count_distinct(day).alias("days"), span.alias("span"))


def recognised(regions: DataFrame, shot: str = "shot_id") -> DataFrame:
    """``shot, text, confidence, regions``: a screenshot's texts, one a line in their order, and the mean confidence of
    those known (0 if none is). Regions without text give no line."""
    rows = regions.filter(F.col(shot).isNotNull() & (strip(text("text")) != ""))
    ordered = F.sort_array(F.collect_list(F.struct("region_seq", "y", "x", "text")))
    out = rows.groupBy(shot).agg(ordered.alias("xs"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"), F.count(F.lit(1)).alias("regions"))
    return out.select(shot, F.array_join(F.transform("xs", lambda x: x["text"]), "\n").alias("text"), "confidence", "regions")


def text_medians(regions: DataFrame, *keys: str) -> DataFrame:
    """Exact medians of width, height and area of the regions with text; 0 without any."""
    rows = regions.filter(strip(text("text")) != "")
    half = lambda c: F.coalesce(F.percentile(c, F.lit(0.5)), F.lit(0.0))
    area = F.col("width").cast("bigint") * F.col("height")
    return rows.groupBy(*keys).agg(half("width").alias("width"), half("height").alias("height"), half(area).alias("area"))


def latency(calls: DataFrame, key: str, time: Column, hit: Column) -> DataFrame:
    """``key, calls, average, hits, misses, hit_rate`` of calls with a time in milliseconds and whether they hit; an
    unknown hit is neither. Zero where there is nothing to divide by."""
    hits, misses = F.count_if(F.coalesce(hit, F.lit(False))), F.count_if(F.coalesce(~hit, F.lit(False)))
    out = calls.groupBy(key).agg(F.count(F.lit(1)).alias("calls"), F.sum(time).alias("_t"), hits.alias("hits"), misses.alias("misses"))
    return out.select(key, "calls", rate(F.col("_t"), F.col("calls")).alias("average"), "hits", "misses", rate(F.col("hits"), F.col("hits") + F.col("misses")).alias("hit_rate"))


def scroll_statistics(states: DataFrame, key: str, time: Column, messages: Column) -> DataFrame:
    """``key, scrolls, messages, seconds, per_minute, per_scroll`` of scroll states; rates are 0 without time."""
    out = states.groupBy(key).agg(F.count(F.lit(1)).alias("scrolls"), F.coalesce(F.sum(messages), F.lit(0)).alias("messages"), F.min(time).alias("_a"), F.max(time).alias("_b"))
    span = F.coalesce(F.unix_seconds(F.col("_b").cast("timestamp")) - F.unix_seconds(F.col("_a").cast("timestamp")), F.lit(0))
    out = out.withColumn("seconds", span)
    return out.select(key, "scrolls", "messages", "seconds", rate(F.col("scrolls") * 60, F.col("seconds")).alias("per_minute"), rate(F.col("messages"), F.col("scrolls")).alias("per_scroll"))


def active(counts: DataFrame, keys: list[str], value: str, least: float) -> DataFrame:
    """The rows whose ``value`` reaches their group's threshold: the median and three times the median distance from it,
    but ``least`` at the lowest. ``threshold`` is added; a null value is left out."""
    rows = counts.filter(F.col(value).isNotNull())
    middle = rows.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("_m"))
    apart = rows.join(middle, keys).groupBy(*keys).agg(F.first("_m").alias("_m"), F.percentile(F.abs(F.col(value) - F.col("_m")), F.lit(0.5)).alias("_mad"))
    limits = apart.select(*keys, F.greatest(F.col("_m") + 3 * F.col("_mad"), F.lit(float(least))).alias("threshold"))
    return rows.join(limits, keys).filter(F.col(value) >= F.col("threshold"))


def batches(messages: DataFrame, key: Column, batch: str = "file_ord", order: str = "seq", block: int = BLOCK) -> DataFrame:
    """``batch, parsed, new, hit_rate, misses, total``: of each batch its rows, those whose key no earlier row has, their
    share, how many batches in a row up to here brought nothing new, and how many new rows came up to here.

    Only each key's first row is new, found by aggregation; a null batch is left out.
    """
    rows = messages.filter(F.col(batch).isNotNull())
    first = rows.groupBy(key.alias("_k")).agg(F.min(F.struct(batch, order))[batch].alias(batch)).groupBy(batch).agg(F.count(F.lit(1)).alias("new"))
    out = rows.groupBy(batch).agg(F.count(F.lit(1)).alias("parsed")).join(first, batch, "left").fillna(0, ["new"])
    out = out.withColumn("hit_rate", rate(F.col("new"), F.col("parsed")))
    out = run_length(out, [], batch, F.col("new") == 0, "misses", block)
    return running_sum(out, [], batch, F.col("new"), "total", block)


def batches_until(found: DataFrame, most_misses: int | None = 3, most_messages: int | None = None, batch: str = "file_ord", block: int = BLOCK) -> DataFrame:
    """The batches a scan takes: it ends with the batch that makes ``most_misses`` in a row without anything new, or once
    it has ``most_messages``, which it may pass by what the last batch brings."""
    if most_misses is not None:
        found = until_run(found, [], batch, F.col("new") == 0, most_misses, block)
    return found if most_messages is None else found.filter(F.col("total") - F.col("new") < most_messages)


def by_text_order(df: DataFrame, column: str, descending: bool = False, name: str = "place") -> DataFrame:
    """Rows of a report with their place when sorted by a column as text, nulls as empty; other columns break ties."""
    shown = F.coalesce(F.col(column).cast("string"), F.lit(""))
    rest = [F.col(c).cast("string") for c in df.columns if c != column]
    return df.withColumn(name, F.row_number().over(Window.orderBy(shown.desc() if descending else shown.asc(), *rest)))


def preview(df: DataFrame, rows: int = 5, order: str | None = None) -> DataFrame:
    """The first rows by ``order``, or by ``seq``: a top-k, of which no task keeps more than ``rows``."""
    by = [F.col(order).asc_nulls_last(), F.col("seq")] if order else [F.col("seq")]
    return df.orderBy(*by).limit(rows)
