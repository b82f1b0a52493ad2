"""Functions of texts, times and keys: known cases, nulls and empty texts."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from chatloom.functions import boxes, cards, keys, kinds, text, times


def of(spark, f, values, schema="c string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).coalesce(1).select(f(F.col("c"))).collect()]


def test_time_only(spark):
    texts = ["10月21日23:47", "18：15", "星期五 23:53", "下午 3:05", "3.14", "-", "昨天 23:47:01", "早上 9:00", "晚上7:22", "2024-10-21", "...", "日", "", None, "12 o'clock"]
    assert of(spark, times.only_time_storage, texts) == [c == "T" for c in "TFFTFFTFFFFTFFF"]
    assert of(spark, times.only_time_merge, texts) == [c == "T" for c in "TTTTTTFTFTTTFFF"]
    assert of(spark, lambda c: times.only_time_storage(c, ("=+",)), ["=== x", None]) == [True, False]


def test_relative_time(spark):
    ref = datetime(2025, 12, 6, 10, 53, 39)
    cases = {
        "2025年12月01日 08:05": datetime(2025, 12, 1, 8, 5), "9月28日 晚上7:22": datetime(2025, 9, 28, 19, 22), "昨天 23:47": datetime(2025, 12, 5, 23, 47), "星期一 10:00": datetime(2025, 12, 1, 10),
        "星期六 10:00": datetime(2025, 11, 29, 10), "凌晨12:30": datetime(2025, 12, 6, 0, 30), "中午1:00": datetime(2025, 12, 6, 1), "今天 10:00": ref, "周三 20:15": ref, "other": ref, None: ref, "昨天 25:00": ref, "13月1日 1:00": ref, "１２:３０": datetime(2025, 12, 6, 12, 30),
    }
    assert of(spark, lambda c: times.parse_relative(c, F.lit(ref).cast("timestamp_ntz")), cases) == list(cases.values())
    merged = {"2025年1月2日 3:04": datetime(2025, 1, 2, 3, 4), "2025年1月2日 3：04": ref, "1月2日 3：04": datetime(2025, 1, 2, 3, 4), "晚上7:22": ref}
    assert of(spark, lambda c: times.parse_relative(c, F.lit(ref).cast("timestamp_ntz"), False), merged) == list(merged.values())


def test_lines_and_stamps(spark):
    assert of(spark, times.is_time_line, ["10:00", "下午3:05", "|3:05", "昨天 9:00", "", None]) == [True, False, True, True, False, False]
    assert of(spark, lambda c: times.is_time_line(c, False), ["下午3:05", "|3:05", "周三 20:15"]) == [True, False, True]
    assert of(spark, times.is_separator, ["星期五 23:53", "星期五23:53", "昨天 23:47", "ok", "1:00\n2:00\n3:00", "", None, "  "]) == [True, True, True, False, False, False, False, True]
    assert of(spark, times.norm_stamp, ["2024-1-5 3:4:5.678", "2024-01-05T03:04:05", "soon", "", None]) == ["2024-01-05T03:04:05", "2024-01-05T03:04:05", "soon", "", ""]
    assert of(spark, lambda c: times.iso(times.scan_time(c)), ["auto_20251206_105339.json", "x", None]) == ["2025-12-06T10:53:39", None, None]
    assert of(spark, times.iso, [datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 0, 0, 5), None], "c timestamp_ntz") == ["2024-01-01T00:00:00", "2024-01-01T00:00:00.000005", None]


def test_keys(spark):
    rows = spark.createDataFrame([("abc", "B", "x"), ("", "Bob", "  Hi  "), (None, None, None)], "id string, sender string, content string").coalesce(1).withColumn("t", F.lit(datetime(2024, 10, 2, 8, 30)).cast("timestamp_ntz"))
    a = [F.col("id"), F.col("sender"), F.col("t"), F.col("content")]
    assert [r[0] for r in rows.select(keys.stable_key(*a)).collect()] == ["abc", "Bob|2024-10-02T08:30:00|Hi", "|2024-10-02T08:30:00|"]
    merged = lambda null: [r[0] for r in rows.select(keys.merge_key(a[0], a[1], keys.second(a[2]), a[3], null)).collect()]
    assert merged("") == ["id:abc", "bob|2024-10-02T08:30:00|Hi", "|2024-10-02T08:30:00|"]
    assert merged("None")[2] == "id:None"


def test_kinds(spark):
    assert of(spark, kinds.sticker_text, ["晚安呀", "哈哈哈哈", "😄", "。。", "111", "long text here", "", None]) == [True, True, True, True, False, False, False, False]
    assert of(spark, kinds.text_kind, ["[图片]", "[语音] 15秒", "你已添加为好友", "普通文本消息", " ", None, "IMAGE"]) == ["image", "voice", "system", "text", "unknown", "unknown", "text"]
    assert of(spark, kinds.garbage, ["4:8080/#", "输出目录 x", "#$%", "12345", "text (0.85)", "0.BS", "hello", " ", "", None]) == [True, True, True, False, True, True, False, True, False, False]
    cases = [("搞好了", 0.5), ("搞好了", 0.2), ("x^", 0.8), ("这是一段测试文本", 0.3), ("Hello", 0.5), ("Hi", 0.5), (None, None)]
    rows = spark.createDataFrame(cases, "t string, c double").coalesce(1)
    assert [r[0] for r in rows.select(kinds.read_as_image(F.col("t"), F.col("c"))).collect()] == [False, True, True, False, False, True, True]


def test_cards(spark):
    red = "小红书\n秋日咖啡指南\n在微风里\n来源：小红书\nhttps://x.example/1"
    bili = "哔哩哔哩\n视觉之旅\nUP主：阿B\n播放量：12.3万\n来源：哔哩哔哩\nhttps://b.example/2"
    chat = "我在小红书看到\n一个\n好的\n攻略"
    label = "装修攻略\n省钱\n小红书"
    got = of(spark, cards.share_card, [red, bili, chat, label, "", None])
    assert tuple(got[0]) == ("小红书", "秋日咖啡指南", "在微风里", "小红书", None, None, "https://x.example/1")
    assert (got[1].up_name, got[1].play_count, got[1].title) == ("阿B", 123000, "视觉之旅")
    assert got[2] is None and got[4] is None and got[5] is None
    assert (got[3].platform, got[3].title) == ("小红书", "装修攻略")
    assert of(spark, cards.play_count, ["1,234", "1.5亿", "none", None]) == [1234, 150_000_000, None, None]
    meta = of(spark, lambda c: cards.quote_meta(text.lines(c)), ["好友A🙂\n明天见\n好的\n12:30", "我😄\n请查看\n13:20\n稍后", "a\nb", "10:00\nb\nc"])
    assert [m and tuple(m) for m in meta] == [("好友A🙂", "对方", "明天见"), ("我😄", "我", "请查看"), None, None]
    assert of(spark, lambda c: F.array_join(cards.without_quote(text.lines(c)), "|"), ["好友\n明天见\n好的\n12:30", "a\nb"]) == ["明天见|好的", "a|b"]


def test_privacy_and_sizes(spark):
    found = of(spark, lambda c: F.transform(text.privacy_hits(c, ("secret",)), lambda h: h["pattern"]), ["电话13812345678", "x 13812345678, a@b.cc", "身份证号：123456", "/Users/me/x", "A SECRET", "", "138123456789"])
    assert found == [[], ["CN_mobile", "email"], ["id_number_like"], ["mac_users_path"], ["secret"], [], []]
    assert of(spark, text.parse_size, ["10MB", "1.5kb", " 2 GB ", "77", "x", None]) == [10485760, 1536, 2 << 30, 77, 10485760, 10485760]
    assert of(spark, text.norm_text, ["a​：  b　\n", None]) == ["a: b", ""]


@pytest.mark.parametrize("a, b, wanted", [((0, 0, 10, 10), (0, 0, 10, 10), 1.0), ((0, 0, 10, 10), (5, 0, 10, 10), 1 / 3), ((0, 0, 0, 0), (0, 0, 0, 0), 0.0), ((0, 0, 5, 5), (9, 9, 5, 5), 0.0)])
def test_iou(spark, a, b, wanted):
    cols = lambda t: tuple(F.lit(v) for v in t)
    assert spark.range(1).select(boxes.iou(cols(a), cols(b))).first()[0] == pytest.approx(wanted)


def test_rates(spark):
    assert of(spark, boxes.hit_band, [0.7, 0.3, 0.5, None, float("nan"), 2.0], "c double") == ["good", "bad", "warn", "bad", "bad", "good"]
    assert spark.range(1).select(boxes.rate(F.lit(0), F.lit(0))).first()[0] == 0.0
