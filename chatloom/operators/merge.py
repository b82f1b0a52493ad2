"""Merge of exports: filter, first wins, order; and unions of files, scans and chats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions.keys import content_key, merge_key, second, stable_key
from chatloom.functions.times import read_stamp
from chatloom.schema import MERGE_FIRST, SYSTEM_SENDER

from .dedup import first_wins, two_keys
from .filters import without_times


def _as_text(df: DataFrame) -> bool:
    return dict(df.dtypes)["timestamp"] == "string"


def key_of(df: DataFrame, null_id: str = "") -> Column:
    """The merge's key of rows whose ``timestamp`` is a time or, as in exports, a text."""
    return merge_key(F.col("id"), F.col("sender"), second(F.col("timestamp"), _as_text(df)), F.col("content"), null_id)


def order_of(df: DataFrame) -> list[Column]:
    """What merged rows are ordered by: time to the second and then ``seq``; times that can't be read come last, by their
    text, null as empty."""
    if not _as_text(df):
        # the text of a time without a zone is the same in every session
        return [F.col("timestamp").isNull(), F.substring(F.col("timestamp").cast("string"), 1, 19), F.col("seq")]
    stamp = second(F.col("timestamp"), True)
    return [read_stamp(stamp).isNull(), stamp, F.col("seq")]


def merge(df: DataFrame, exclude_time_only: bool = False, aggressive: bool = False, null_id: str = "") -> DataFrame:
    """The first row by ``seq`` of each key, in order.

    ``aggressive`` drops a row too if a kept one has its sender and content. Null texts and ids count as empty.
    """
    rows = without_times(df, merge=True) if exclude_time_only else df
    key = key_of(df, null_id)
    kept = two_keys(rows, key, content_key(F.col("sender"), F.col("content"))) if aggressive else first_wins(rows, key)
    return kept.orderBy(*order_of(kept))


def merge_columns(df: DataFrame) -> list[str]:
    """Columns of a merged CSV: the common ones first, the others in alphabetical order."""
    return [c for c in MERGE_FIRST if c in df.columns] + sorted(set(df.columns) - set(MERGE_FIRST))


def union(frames: list[DataFrame]) -> DataFrame:
    """All rows of frames whose columns may differ; a missing column is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def scans_together(scans: list[DataFrame]) -> DataFrame:
    """Repeated scans as one: the first row of each stable key."""
    rows = union(scans)
    return first_wins(rows, stable_key(F.col("id"), F.col("sender"), F.col("timestamp"), F.col("content")))


def chats_together(df: DataFrame, chat: Column, chat_order: Column, started: Column) -> DataFrame:
    """Several chats as one list: before each chat a system message that names it, then its rows without those whose
    stable key came before. Columns: ``chat_ord, place`` (0 for the marker, else ``seq``) and those of the messages."""
    rows = df.withColumns({"_chat": chat, "chat_ord": chat_order})
    heads = rows.groupBy("_chat", "chat_ord").agg(F.min(started).alias("timestamp"))
    title = F.concat(F.lit("=== 会话："), F.coalesce("_chat", F.lit("")), F.lit(" ==="))
    marks = heads.select(
        "chat_ord", F.lit(0).cast("bigint").alias("place"), F.concat(F.lit("SYS-"), F.coalesce("_chat", F.lit("")), F.lit("-"), F.unix_seconds(F.col("timestamp").cast("timestamp"))).alias("id"),
        F.lit(SYSTEM_SENDER).alias("sender"), title.alias("content"), F.lit("system").alias("message_type"), "timestamp", F.lit(1.0).alias("confidence_score"), title.alias("raw_ocr_text"),
    )
    both = marks.unionByName(rows.withColumn("place", F.col("seq")).drop("_chat"), allowMissingColumns=True)
    key = stable_key(F.col("id"), F.col("sender"), F.col("timestamp"), F.col("content"))
    return first_wins(both, key, F.struct("chat_ord", "place"))
