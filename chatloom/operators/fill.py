"""Times carried from separators to the messages that follow them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions.times import is_strict_time, is_time_like, parse_relative, scan_time, seconds

from .dedup import first_wins
from .scan import BLOCK, last_known


def message_times(df: DataFrame, run_time: Column, group: list[str], order: str = "seq", upwards: bool = False, block: int = BLOCK) -> DataFrame:
    """Messages with ``message_time``: the time of the latest separator before them, or ``run_time``.

    System messages that look like a time are separators and get their own time; other system messages get null.
    ``upwards`` is for messages captured from the newest to the oldest. Nothing is taken over from other groups.
    """
    system = F.coalesce(F.col("message_type") == "system", F.lit(False))
    mark = system & is_time_like(F.col("content"))
    rows = df.withColumns({"_run": run_time, "_order": (-F.col(order) if upwards else F.col(order)).cast("bigint")})
    rows = last_known(rows, group, "_order", F.when(mark, parse_relative(F.col("content"), F.col("_run"))), "_time", block)
    known = F.coalesce("_time", "_run")
    return rows.withColumn("message_time", F.when(~system | mark, known)).drop("_run", "_order", "_time")


def real_times(df: DataFrame, file_time: Column, group: list[str], order: str = "seq", block: int = BLOCK) -> DataFrame:
    """Messages with ``real_time`` as text: every message gets the time of the latest time message before it, or of
    itself, and ``file_time`` before the first. Time messages become system messages, whatever type they had."""
    mark = is_strict_time(F.col("content"))
    rows = df.withColumn("_file", file_time)
    rows = last_known(rows, group, order, F.when(mark, parse_relative(F.col("content"), F.col("_file"), periods=False)), "_time", block)
    kind = F.when(mark, "system").otherwise(F.col("message_type"))
    return rows.withColumns({"message_type": kind, "real_time": seconds(F.coalesce("_time", "_file"))}).drop("_file", "_time")


def merged_by_real_time(df: DataFrame, file_time: Column | None = None, group: tuple[str, ...] = ("src_file",), block: int = BLOCK) -> DataFrame:
    """All files as one, by real time: the first of each sender, content and real time, nulls being equal to each other.

    The order is that of the real times as texts, then of the rows.
    """
    rows = real_times(df, file_time if file_time is not None else scan_time(F.col("src_file")), list(group), block=block)
    key = F.struct("sender", "content", "real_time")
    return first_wins(rows, key, "seq").orderBy("real_time", "seq")

