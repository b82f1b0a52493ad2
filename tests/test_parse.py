"""Screenshots to messages: known cases."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from chatloom.operators.bubbles import Layout, bubbles
from chatloom.operators.parse import parse

NOW = datetime(2025, 12, 6, 10, 53, 39)
SCHEMA = "shot_id string, region_seq int, text string, x int, y int, width int, height int, confidence double, type string"


def column(*texts, x=100, width=200, step=40, height=30):
    return [(t, x, 100 + i * step, width, height) for i, t in enumerate(texts)]


CASES = {
    "none": ([], Layout(), []),
    "one": ([("你好", 100, 120, 200, 40)], Layout(15, 50), [("text", None, "你好")]),
    "two": ([("第一行", 300, 200, 240, 30), ("第二行", 305, 210, 240, 30), ("另外一条消息", 50, 320, 240, 30)], Layout(15, 50), [("text", "我", "第一行\n第二行"), ("text", "对方", "另外一条消息")]),
    "sides": ([("对方消息", 50, 100, 200, 30), ("我的消息", 260, 110, 200, 30)], Layout(15, 50, split_x=200), [("text", "对方", "对方消息"), ("text", "我", "我的消息")]),
    "types": (column("[图片]", "[语音] 15秒", "你已添加为好友", "普通文本消息", step=50), Layout(15, 50), [("image", None, "[图片]"), ("voice", None, "[语音] 15秒"), ("system", None, "你已添加为好友"), ("text", None, "普通文本消息")]),
    "time": ([("星期五 23:53", 100, 100, 200, 30)], Layout(), [("system", "系统", "星期五 23:53")]),
    "sticker": ([("晚安呀", 100, 100, 90, 30)], Layout(), [("sticker", None, "晚安呀")]),
    "empty": ([("", 100, 100, 300, 300)], Layout(), [("image", None, "")]),
    "marked": ([("", 120, 160, 140, 140, 0.9, "sticker")], Layout(), [("sticker", None, "")]),
    "marked image": ([(None, 120, 160, 220, 160, 0.9, "image")], Layout(), [("image", None, "")]),
    "poster": ([("BIG TITLE", 100, 100, 300, 60), ("subtitle", 100, 170, 300, 20)], Layout(), [("image", None, "BIG TITLE\nsubtitle")]),
    "share": (column("小红书", "秋日咖啡指南", "在微风里", "来源：小红书", "https://x.example/1"), Layout(15, 50), [("share", None, "小红书\n秋日咖啡指南\n在微风里\n来源：小红书\nhttps://x.example/1")]),
    "quote": (column("好友A🙂", "明天见", "好的", "12:30"), Layout(15, 50), [("sticker", None, "明天见\n好的")]),
    "log": (column("[INFO] Run logs"), Layout(), []),
    # a bare time is noise by the rules, before it could be a separator
    "bare time": (column("13:20", width=60), Layout(), [("unknown", None, "")]),
    "noise": (column("4:8080/#", width=40), Layout(), [("unknown", None, "")]),
}


def shots(spark, regions, shot="s"):
    rows = [(shot, i, *(r + (0.9, "text"))[:7]) if len(r) == 5 else (shot, i, *r) for i, r in enumerate(regions)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    regions, layout, wanted = CASES[name]
    got = parse(shots(spark, regions), F.lit(NOW).cast("timestamp_ntz"), layout).orderBy("place").collect()
    assert [(r.message_type, s and r.sender, r.content) for r, (_, s, _) in zip(got, wanted, strict=True)] == [(t, s, c) for t, s, c in wanted]


def test_context_time_and_merged_bubbles(spark):
    regions = [("昨天 10:00", 300, 10, 80, 20), ("第一句话说到这里", 50, 100, 200, 20), ("第二句话接着说", 55, 150, 200, 20), ("我的回答", 560, 300, 200, 20), ("昨天 13:20", 300, 400, 80, 20), ("后来的话语", 50, 500, 200, 20)]
    got = parse(shots(spark, regions), F.lit(NOW).cast("timestamp_ntz")).orderBy("place").collect()
    assert [r.content for r in got] == ["昨天 10:00", "第一句话说到这里\n第二句话接着说", "我的回答", "昨天 13:20", "后来的话语"]
    assert [r.timestamp for r in got] == [datetime(2025, 12, 5, 10)] * 3 + [datetime(2025, 12, 5, 13, 20)] * 2
    assert [r.id for r in got] == [f"s#{i}" for i in range(1, 6)]
    assert got[1].confidence_score == pytest.approx(0.9) and got[1].raw_ocr_text == "第一句话说到这里 第二句话接着说"


def test_nulls(spark):
    rows = [("s", None, None, None, None, None, None, None, None), (None, 1, "x", 1, 1, 1, 1, 0.5, "text")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert bubbles(df).count() == 1
    assert [r.message_type for r in parse(df, F.lit(NOW).cast("timestamp_ntz")).collect()] == ["unknown"]
    assert parse(df.limit(0), F.lit(NOW).cast("timestamp_ntz")).count() == 0
