"""Messages as lines of text, CSV and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions.text import filled, lines, text
from chatloom.functions.times import iso
from chatloom.schema import CSV_FIELDS

# Notes for media without text, labels of a share card by field, and titles of a Markdown export.
NO_STICKER_TEXT, NO_IMAGE_TEXT = "表情包未识别出文字", "图片未识别出文字"
LABELS = (("platform", "平台"), ("title", "标题"), ("body", "正文"), ("source", "来源"), ("up_name", "UP主"), ("play_count", "播放量"), ("canonical_url", "链接"))
MARKDOWN_TITLE, MERGE_TITLE = "# WeChat Chat Export", "# 合并导出（部分片段）"


def exported(df: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Messages in the form of an export: times as ISO text, without the region and the columns that keep their place."""
    out = df.withColumns({c: iso(F.col(c)) for c in ("timestamp", "message_time") if c in df.columns and dict(df.dtypes)[c] != "string"})
    return out.drop("original_region", "src_file", "file_ord", "seq", *exclude)


def shown_content() -> Column:
    """The content, or a note for a blank sticker or image; null as empty."""
    blank = ~filled(F.col("content"))
    return F.when(blank & (F.col("message_type") == "sticker"), NO_STICKER_TEXT).when(blank & (F.col("message_type") == "image"), NO_IMAGE_TEXT).otherwise(text("content"))


def _details(prefix: str) -> Column:
    """Lines of a share card's fields that are not empty; a body gives one for each of its lines."""
    card = F.col("share_card")
    parts = []
    for name, label in LABELS:
        value, head = card[name], f"{prefix}{label}："
        if name == "body":
            parts.append(F.transform(lines(value), lambda x: F.concat(F.lit(head), x)))  # noqa: B023
        else:
            shown = F.when(value.isNotNull(), F.concat(F.lit(head), value.cast("string"))) if name == "play_count" else F.when(text(value) != "", F.concat(F.lit(head), value))
            parts.append(F.array(shown))
    all_of = F.array_compact(F.concat(*parts))
    return F.when((F.col("message_type") == "share") & card.isNotNull(), all_of).otherwise(F.array().cast("array<string>"))


def _quote(first: str, second: str, end: str) -> Column:
    quote = F.col("quote_meta")
    head = F.concat(F.lit(first), text(quote["original_sender_label"]), F.lit(end), text(quote["original_nickname"]))
    both = F.array_compact(F.array(head, F.when(text(quote["quoted_text"]) != "", F.concat(F.lit(second), quote["quoted_text"]))))
    return F.when(quote.isNotNull(), both).otherwise(F.array().cast("array<string>"))


def text_line() -> Column:
    """``[time] sender (type): content``, quotes before and a share's fields after it; the message's own time counts, if
    known, else that of its capture. Nulls are empty."""
    time = text(F.coalesce(iso(F.col("message_time")), iso(F.col("timestamp"))))
    line = F.concat(F.lit("["), time, F.lit("] "), text("sender"), F.lit(" ("), text("message_type"), F.lit("): "), shown_content())
    return F.array_join(F.concat(_quote("引用> ", "引用> ", "："), F.array(line), _details("")), "\n")


def markdown_line() -> Column:
    """The same as a Markdown list item, with both times where both are known."""
    own, capture = iso(F.col("message_time")), text(iso(F.col("timestamp")))
    time = F.when(own.isNotNull(), F.concat(own, F.lit(" (Capture: "), capture, F.lit(")"))).otherwise(capture)
    line = F.concat(F.lit("- ["), time, F.lit("] **"), text("sender"), F.lit("** ("), text("message_type"), F.lit("): "), shown_content())
    return F.array_join(F.concat(_quote("> 引用（", "> ", "）："), F.array(line), _details("  - ")), "\n")


def merge_line(timestamp: Column) -> Column:
    """``- [time] sender: content`` of a merged export; nulls are empty."""
    return F.concat(F.lit("- ["), text(timestamp), F.lit("] "), text("sender"), F.lit(": "), text("content"))


def csv_value(c: Column) -> Column:
    """A CSV field, quoted where it must be; null is empty."""
    return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text(c))


def csv_line(columns: list[str] | tuple[str, ...] = CSV_FIELDS) -> Column:
    """A CSV row of the columns, numbers as Spark writes them."""
    return F.concat_ws(",", *[csv_value(F.col(c).cast("string")) for c in columns])


def json_line(df: DataFrame) -> Column:
    """A compact JSON object of the row; null fields are left out."""
    return F.to_json(F.struct(*df.columns))
