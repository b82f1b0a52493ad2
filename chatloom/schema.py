"""Schemas of the records, and the fixed names of types and export fields."""

from __future__ import annotations

SHARE_CARD = "struct<platform:string,title:string,body:string,source:string,up_name:string,play_count:bigint,canonical_url:string>"
QUOTE_META = "struct<original_nickname:string,original_sender_label:string,quoted_text:string>"
BOX = "struct<x:int,y:int,width:int,height:int>"
#: A message with the columns that keep its place: file, file order and ``seq``.
MESSAGE = (
    "id string, sender string, content string, message_type string, timestamp timestamp_ntz, confidence_score double, raw_ocr_text string, "
    f"message_time timestamp_ntz, share_card {SHARE_CARD}, quote_meta {QUOTE_META}, original_region {BOX}, src_file string, file_ord int, seq bigint"
)
#: A message as exported: times are ISO strings, and ``original_region`` is never written.
EXPORT = (
    "id string, sender string, content string, message_type string, timestamp string, confidence_score double, raw_ocr_text string, "
    f"message_time string, share_card {SHARE_CARD}, quote_meta {QUOTE_META}"
)
REGION = "shot_id string, region_seq int, text string, x int, y int, width int, height int, confidence double, type string"
HEARTBEAT = "timestamp string, status string, messages int, attempts int, cpu_percent double, memory_mb double"

# Message types, fields of a CSV export, and those of one that is appended to.
TYPES = ("text", "image", "sticker", "voice", "system", "share", "unknown")
CSV_FIELDS = ("id", "sender", "content", "message_type", "timestamp", "confidence_score", "raw_ocr_text")
CSV_APPEND_FIELDS = ("id", "sender", "content", "message_type", "timestamp", "message_time", "confidence_score", "raw_ocr_text")
#: Fields that come first in a merged CSV; the others follow in alphabetical order.
MERGE_FIRST = ("id", "sender", "content", "message_type", "timestamp", "confidence_score")
FORMATS = ("json", "csv", "txt", "md")
SYSTEM_SENDER, OWN, OTHER = "系统", "我", "对方"
