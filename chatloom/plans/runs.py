"""Whole runs, with the parameters of the programs they stand for. Each is made of stages that can be used alone.

A stage is a function from rows to rows; ``pipeline`` puts stages together and can write each one's result as a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import datetime
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.functions.keys import stable_key
from chatloom.operators.bubbles import Layout
from chatloom.operators.dedup import first_wins
from chatloom.operators.fill import message_times
from chatloom.operators.filters import confident, message_filter, read_criteria, without_empty
from chatloom.operators.merge import merge
from chatloom.operators.parse import parse
from chatloom.operators.privacy import report, scan
from chatloom.operators.stats import batches, batches_until, sender_counts, session_summary
from chatloom.runtime import materialise
from chatloom.sinks.files import append, save, save_merged, write_report
from chatloom.sources.files import discover, read_exports, read_text
from chatloom.sources.settings import Settings
from chatloom.streaming.tail import Tail, read_stream

T = TypeVar("T")
Stage = Callable[[DataFrame], DataFrame]


def pipeline(rows: DataFrame, *stages: Stage, written: bool = False) -> DataFrame:
    """The rows after all stages; ``written`` puts each stage's result into a table of the shared folder."""
    for i, stage in enumerate(stages):
        rows = stage(rows)
        if written:
            rows = materialise(rows, f"stage-{i}")
    return rows


def first_filled(attempts: Iterable[Callable[[], DataFrame]]) -> DataFrame | None:
    """The first result that has rows; the last one if none has, None without attempts."""
    found = None
    for attempt in attempts:
        found = attempt()
        if not found.isEmpty():
            break
    return found


def with_place(messages: DataFrame) -> DataFrame:
    """Parsed messages with ``seq``, their place among all by screenshot and place: a hash of the screenshot's name in the
    high bits keeps it unique without a global sort, as long as names differ in it."""
    high = F.shiftleft(F.pmod(F.xxhash64("shot_id"), F.lit(1 << 42)), 20)
    return messages.withColumn("seq", high + F.col("place"))


def run_extraction(regions: DataFrame, settings: Settings, now: datetime, sender: str | None = None, start: str | None = None, end: str | None = None, types: str | None = None, contains: str | None = None, min_confidence: float | None = None, prefix: str = "extraction", formats: list[str] | None = None, layout: Layout = Layout()) -> tuple[DataFrame, list[str]]:
    """Parse screenshots, filter by criteria given as texts, and save; the messages before the save's own filters, and the
    paths written. Nothing is written for no messages."""
    found = with_place(parse(confident(regions, settings.confidence), F.lit(now).cast("timestamp_ntz"), layout))
    found = materialise(message_filter(found, sender=sender, contains=contains, min_confidence=min_confidence, **read_criteria(start, end, types)), "extracted")
    return found, [] if found.isEmpty() else save(found, settings, prefix, now, formats)


def run_scan(messages: DataFrame, settings: Settings, batch: str = "file_ord", most_misses: int = 3, most_messages: int | None = None, skip_empty: bool = True, live: str | None = None, live_format: str = "json", on_batch: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """The new messages of a scan's batches up to where it ends: by batches without anything new, or by their number.

    ``live`` is a folder that they are appended to, blank ones left out if ``skip_empty``; ``on_batch`` is called with
    the same rows.
    """
    key = stable_key(F.col("id"), F.col("sender"), F.col("timestamp"), F.col("content"))
    taken = batches_until(batches(messages, key, batch), most_misses, most_messages, batch)
    rows = materialise(first_wins(messages.join(taken.select(batch), batch, "left_semi"), key), "scanned")
    shown = without_empty(rows) if skip_empty else rows
    if live:
        append(shown, settings, live, live_format)
    if on_batch:
        on_batch(shown)
    return rows


def run_auto_scan(messages: DataFrame, settings: Settings, now: datetime, group: str = "src_file", upwards: bool = True, prefix: str = "auto_scan", formats: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Fill message times from separators, save, and sum up: ``own, other, total, span, longest_streak, longest_gap`` of
    the messages before the save's filters."""
    timed = message_times(messages, F.lit(now).cast("timestamp_ntz"), [group], upwards=upwards)
    paths = save(timed, settings, prefix, now, formats)
    counts, spans = (f(messages).withColumn("_one", F.lit(1)) for f in (sender_counts, session_summary))
    return counts.join(spans, "_one").drop("_one"), paths


def run_timeline(spark: SparkSession, inbox: str, folder: str, checkpoint: str, every: str | None = None, keep: Stage | None = None, on_batch: Callable[[DataFrame, int], None] | None = None) -> Tail:
    """Append what is new in a folder of JSON Lines to a table: all that is there, or, with a time, until stopped."""
    tail = Tail(folder, keep, on_batch)
    tail.start(read_stream(spark, inbox), checkpoint, every).awaitTermination()
    return tail


def merge_exports(spark: SparkSession, inputs: list[str], directory: str, prefix: str, formats: str = "json,csv", exclude_fields: str = "", exclude_time_only: bool = False, aggressive: bool = False, single: bool = False) -> list[str]:
    """Merge exported files into one; the paths written. ValueError without input files."""
    if not discover(spark, inputs):
        raise ValueError(f"no JSON files in {inputs}")
    named = tuple(f.strip().lower() for f in formats.split(",") if f.strip())
    fields = tuple(f.strip() for f in exclude_fields.split(",") if f.strip())
    rows = merge(read_exports(spark, inputs), exclude_time_only, aggressive)
    return save_merged(rows, directory, prefix, named, fields, single)


def privacy_scan(spark: SparkSession, base: str, exact: tuple[str, ...] = (), fail_on_warning: bool = False, report_path: str | None = None) -> tuple[DataFrame, bool]:
    """Hits in the text files below a folder, and whether they are reason to fail; a report is written where there are
    any and a path is given."""
    hits = materialise(scan(read_text(spark, base), ["file_path"], exact), "hits")
    if report_path and not hits.isEmpty():
        write_report(report(hits), report_path)
    failing = hits if fail_on_warning else hits.filter("level = 'error'")
    return hits, not failing.isEmpty()
