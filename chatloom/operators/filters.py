"""Filters of messages and regions. Each is a plain predicate, so that it can reach the scan."""

from __future__ import annotations

import logging
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions import boxes
from chatloom.functions.text import filled, strip, text
from chatloom.functions.times import only_time_merge, only_time_storage
from chatloom.schema import SYSTEM_SENDER, TYPES

_log = logging.getLogger(__name__)


def message_filter(df: DataFrame, sender: str | None = None, start: datetime | None = None, end: datetime | None = None, types: list[str] | None = None, contains: str | None = None, min_confidence: float | None = None) -> DataFrame:
    """Messages that meet all criteria given: parts of sender and content in any letter case, times from ``start`` to
    ``end`` inclusive, types, and a least confidence.

    None, an empty text and an empty list are no criterion; a least confidence of 0 is one. A null sender or content
    counts as empty; a null time, type or confidence meets no criterion.
    """
    tests: list[Column] = []
    if sender:
        tests.append(F.lower(text("sender")).contains(sender.lower()))
    if start:
        tests.append(F.col("timestamp") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        tests.append(F.col("timestamp") <= F.lit(end).cast("timestamp_ntz"))
    if types:
        tests.append(F.col("message_type").isin(*types))
    if contains:
        tests.append(F.lower(text("content")).contains(contains.lower()))
    if min_confidence is not None:
        tests.append(F.col("confidence_score") >= float(min_confidence))
    for t in tests:
        df = df.filter(t)
    return df


def read_criteria(start: str | None = None, end: str | None = None, types: str | None = None) -> dict:
    """Criteria from texts as given on a command line. One that can't be read is left out with a warning; one unknown
    type leaves out the whole list."""

    def time(name: str, value: str | None) -> datetime | None:
        try:
            return datetime.fromisoformat(value) if value else None
        except ValueError:
            _log.warning("%s is no time and is ignored: %s", name, value)
            return None

    named = [t.strip().lower() for t in (types or "").split(",") if t.strip()]
    if not set(named) <= set(TYPES):
        _log.warning("types hold an unknown one and are ignored: %s", types)
        named = []
    return {"start": time("start", start), "end": time("end", end), "types": named or None}


def without_system(df: DataFrame) -> DataFrame:
    """Messages that are neither of type system nor sent by the system; null types and senders stay."""
    system = (F.col("message_type") == "system") | (strip(text("sender")) == SYSTEM_SENDER)
    return df.filter(~F.coalesce(system, F.lit(False)))


def without_times(df: DataFrame, merge: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """Messages that are more than a time, by the storage's forms (with ``extra`` patterns) or the merge's."""
    return df.filter(~(only_time_merge(F.col("content")) if merge else only_time_storage(F.col("content"), extra)))


def without_empty(df: DataFrame) -> DataFrame:
    return df.filter(filled(F.col("content")))


def without_fields(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """The rows without the named columns; names that are no column are ignored."""
    return df.drop(*fields)


def confident(regions: DataFrame, least: float = 0.7, column: str = "confidence") -> DataFrame:
    """Rows with at least the confidence; a null one counts as 0."""
    # above 0 no null can meet it, and the plain comparison reaches the scan
    return regions.filter(F.col(column) >= least if least > 0 else F.coalesce(F.col(column), F.lit(0.0)) >= least)


def output_filter(df: DataFrame, system: bool = True, times: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """What is left out before anything is saved. Comes before deduplication, so that no index holds a key of it."""
    if system:
        df = without_system(df)
    return without_times(df, extra=extra) if times else df


def image_candidates(df: DataFrame) -> DataFrame:
    """Messages with a region that are images, stickers, or unknown and blank."""
    kind = F.col("message_type")
    return df.filter(F.col("original_region").isNotNull() & (kind.isin("image", "sticker") | ((kind == "unknown") & ~filled(F.col("content")))))


def crops(df: DataFrame, image_width: Column, image_height: Column, least: int = 50, region: str = "original_region") -> DataFrame:
    """Rows with ``crop``, the region held within the image; those with a side of ``least`` or less are left out."""
    cut = df.withColumn("crop", boxes.clamped(boxes.box(f"{region}."), image_width, image_height))
    return cut.filter((F.col("crop.width") > least) & (F.col("crop.height") > least))


def summary_holds(pages: DataFrame, messages: str, keyword: str, first: int = 5) -> DataFrame:
    """Pages with ``found``: whether the keyword is in the contents of their first messages, in any letter case."""
    contents = F.transform(F.slice(F.col(messages), 1, first), lambda m: text(m["content"]))
    return pages.withColumn("found", F.coalesce(F.lower(F.array_join(contents, " ")).contains(keyword.lower()), F.lit(False)))
