"""What a text or a bubble is: sticker, image, voice, system, garbage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_of, filled, has_any, strip, text

# Words and patterns by which texts are classed.
IMAGE_HINTS = ("[图片]", "图片", "photo", "image", "img")
VOICE_HINTS = ("[语音]", "语音", "voice", "audio")
SYSTEM_HINTS = ("你已添加", "已成为你的朋友", "系统消息", "joined", "left", "invited")
STICKER_WORDS = ("晚安", "早安", "哈哈", "收到", "好的", "OK", "ok", "谢谢", "加油", "开心", "难过", "流泪", "再见", "拜拜", "打卡")
LOG_WORDS = ("[WARNING]", "[INFO]", "[ERROR]", "[DEBUG]", "[HARNING]", "[CRITICAL]", "services.message_parser", "confidence text", "运行日志", "Run logs", "Image detection:", "Low confidence text")
GARBAGE_TEXTS = ("4:8080/#", "p-diveintotheprotocolsdefiningthepos")
GARBAGE_WORDS = ("4:8080", "最大滚动", "全量模式", "输出目录", "fUsers/", "格式：", "前缀：", "SPM范围", "聊天区域", "激动控制", "aut", "圜口标题")
POSTER_WORDS = ("USDT", "LBank", "合约", "中奖", "扫码", "二维码", "海报", "发件人", "截图", "详情", "点击", "长按")
NO_MERGE_WORDS = ("小红书", "哔哩哔哩", "bilibili", "小程序", "微信小程序", "来源：")
SYMBOLS = r"""\A[0-9:/.#@$%^&*()_+\-=\[\]{}|;<>?~`'" ]*\z"""
TEXT_CALL = r"(?:text|txt|conf).*[(（].*[)）]"
TEXT_WORDS = ("text", "itext", "tcxt", "confidence")
SHORT_CODE = r"\A[()0-9a-zA-Z.: ]{1,10}\z"
PLAIN_CHARS = r"""\A[a-zA-Z0-9.,;'"?!\-]+\z"""
EMOJI = r"[\x{1F001}-\x{10FFFF}]"
HAN = r"[\x{4E00}-\x{9FFF}]"
STICKER_LENGTH, MERGE_LENGTH = 8, 400


def sticker_text(content: Column) -> Column:
    """Whether a text is a sticker's: at most 8 characters, and a mood word, one character repeated, or an emoji."""
    t = strip(text(content))
    one = (F.length(t) > 0) & (F.replace(t, F.substring(t, 1, 1), F.lit("")) == "") & ~t.rlike(PLAIN_CHARS)
    return (F.length(t) <= STICKER_LENGTH) & (has_any(t, STICKER_WORDS) | one | t.rlike(EMOJI))


def text_kind(content: Column) -> Column:
    """The type a text's words hint at, in the letter case they are listed in; ``unknown`` for blank and null."""
    t = text(content)
    kind = F.when(has_any(t, IMAGE_HINTS), "image").when(has_any(t, VOICE_HINTS), "voice").when(has_any(t, SYSTEM_HINTS), "system")
    return kind.when(filled(t), "text").otherwise("unknown")


def own_log(content: Column) -> Column:
    """Whether a text is the capturing program's own log."""
    return has_any(text(content), LOG_WORDS)


def garbage(content: Column) -> Column:
    """Whether a text is noise of the recogniser or of the program's window. Null and empty aren't, white space is."""
    t = strip(text(content))
    low = F.lower(t)
    signs = (F.length(t) < 8) & t.rlike(SYMBOLS) & ~F.replace(t, F.lit(" "), F.lit("")).rlike("^[0-9]+$")
    call = has_any(low, ("text", "conf", "txt")) & (low.rlike(TEXT_CALL) | low.isin(*TEXT_WORDS))
    code = t.rlike(SHORT_CODE) & has_any(low, ("0.b", "o.b"))
    return (text(content) != "") & any_of([t.isin(*GARBAGE_TEXTS), has_any(t, GARBAGE_WORDS), signs, call, code])


def read_as_image(content: Column, confidence: Column) -> Column:
    """Whether a recognised text is rather an image: by confidence, length, and whether it holds Han characters.

    A null confidence counts as 0, a null text as empty.
    """
    t, c = strip(text(content)), F.coalesce(confidence, F.lit(0.0))
    n, han = F.length(t), t.rlike(HAN)
    unsure = F.when(n >= 5, F.when(han, c < 0.2).otherwise(c < 0.4)).otherwise(F.when(han, c < 0.3).otherwise(F.lit(True)))
    tiny = (n <= 2) & ~t.rlike(r"\A\p{Nd}+\z") & ~han
    signs = (n < 5) & ~han & ~t.rlike(r"\A[\p{L}\p{N}]+\z")
    return F.when(c < 0.6, unsure).otherwise(tiny | signs)


def merges_as_text(lines: Column) -> Column:
    """Whether lines of neighbouring bubbles make one text: two or more, no link, no platform's name, at most 400 characters."""
    joined = F.array_join(lines, "\n")
    low = F.lower(joined)
    size = F.length(joined) - F.greatest(F.size(lines) - 1, F.lit(0))
    return (F.size(lines) >= 2) & ~has_any(low, ("http://", "https://")) & ~has_any(joined, NO_MERGE_WORDS) & (size <= MERGE_LENGTH)


def image_with_text(tallest: Column, height: Column, width: Column, count: Column, confidence: Column, content: Column) -> Column:
    """Whether a bubble with text is an image, by the first rule that applies: its tallest line, height, box width,
    number of lines, mean confidence and text."""
    n = F.length(strip(text(content)))
    area = width * height
    sparse = (height > 150) & (height / F.greatest(count, F.lit(1)) > 60)
    poster = has_any(text(content), POSTER_WORDS) & (height >= 120)
    small = (area >= 900) & (area <= 40000) & (n < 8) & (confidence < 0.6)
    later = any_of([sparse, poster, (area > 40000) & (n < 30), height > 300, small])
    return F.coalesce((tallest >= 60) | ((count <= 10) & later), F.lit(False))


def empty_kind(width: Column, height: Column, has_image: Column, has_sticker: Column, was_garbage: Column) -> Column:
    """The type of a bubble without text, from its box and what its regions were marked as."""
    area, aspect = width * height, width / F.greatest(height, F.lit(1))
    shaped = (F.least(width, height) >= 40) & (area >= 2000) & aspect.between(0.2, 5.0)
    square = aspect.between(0.8, 1.25) & (area <= 25000)
    media = F.when(was_garbage & ~has_image & (aspect > 3.0), "unknown").when(square, "sticker").otherwise("image")
    return F.when(has_sticker, "sticker").when(has_image | shaped, media).otherwise("unknown")
