"""Share cards and quotes inside a message's text, as structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, has_any, let, lines, strip, text
from .times import is_time_line

# Platforms and labels of a share card.
RED, BILI, BILI_EN, MINI = "小红书", "哔哩哔哩", "bilibili", "微信小程序"
CARD_HINTS = ("小红书", "哔哩哔哩", "bilibili", "小程序", "微信小程序", "星巴克", "礼物", "查收", "点击打开", "来源")
SOURCE, UP, PLAYS, NO_PLATFORM, MINI_SOURCE = "来源", "UP主", "播放量", "分享", "星巴克"
URL = rf"https?://[^{WS}]+"
#: What every text with a card holds.
MAY_BE_CARD = "https?://|来源|小红书|哔哩哔哩|bilibili|小程序"


def play_count(c: Column) -> Column:
    """The first number of a text, with ``万`` or ``亿``, rounded half to even; null without one."""
    t = F.replace(strip(text(c)), F.lit(","), F.lit(""))
    pattern = rf"([0-9]+(?:\.[0-9]+)?)[{WS}]*([万亿]?)"
    unit = F.regexp_extract(t, pattern, 2)
    value = F.regexp_extract(t, pattern, 1).try_cast("double")
    return F.bround(value * F.when(unit == "万", 10_000).when(unit == "亿", 100_000_000).otherwise(1), 0).cast("bigint")


def _labelled(line: Column, label: str) -> Column:
    return line.startswith(f"{label}：") | line.startswith(f"{label}:")


def _value(line: Column) -> Column:
    """What follows the first full-width colon, or the first colon without one; null if nothing does."""
    at = F.when(line.contains("："), F.instr(line, "：")).otherwise(F.instr(line, ":"))
    raw = F.substring(line, at + 1, F.length(line))
    return F.when(raw != "", strip(raw))


def _last(ls: Column, label: str) -> Column:
    """The last line that begins with a label, null without one."""
    return F.try_element_at(F.filter(ls, lambda x: _labelled(x, label)), F.lit(-1))


def platform_of(ls: Column) -> Column:
    """The platform named by a line of its own or by a link; null without one."""
    low = F.lower(F.array_join(ls, "\n"))
    alone = lambda name: F.array_contains(ls, name)
    bili = F.when(alone(BILI), BILI).otherwise(BILI_EN)
    return (
        F.when(alone(RED) | low.contains("xiaohongshu.com"), RED)
        .when(alone(BILI) | alone(BILI_EN) | low.contains("bilibili.com"), bili)
        .when(alone(MINI) | alone("小程序") | low.contains("miniapp"), MINI)
    )


def share_card(content: Column) -> Column:
    """The share card in a text, or null: a link, a source, or a platform's line among three or more make one."""
    return F.when(text(content).rlike(MAY_BE_CARD), let(lines(content), _card_of))


def _card_of(ls: Column) -> Column:
    joined = F.array_join(ls, "\n")
    return let(F.struct(platform_of(ls).alias("p"), F.nullif(F.regexp_extract(joined, URL, 0), F.lit("")).alias("url"), joined.alias("j")), lambda x: _card(ls, x["p"], x["url"], x["j"]))


def _card(ls: Column, platform: Column, url: Column, joined: Column) -> Column:
    named = F.coalesce(F.array_contains(ls, platform), F.lit(False))
    shared = (F.size(ls) > 0) & (url.isNotNull() | joined.contains(SOURCE) | (named & (F.size(ls) >= 3)))
    source, up = _value(_last(ls, SOURCE)), _value(_last(ls, UP))
    plays = play_count(_value(_last(ls, PLAYS)))
    mini = F.when((platform == MINI) & joined.contains(MINI_SOURCE), MINI_SOURCE)
    origin = F.coalesce(F.nullif(source, F.lit("")), mini, platform)
    rest = F.filter(ls, lambda x: ~(_labelled(x, SOURCE) | _labelled(x, UP) | _labelled(x, PLAYS) | x.startswith("http://") | x.startswith("https://")))

    def titled(rest: Column) -> Column:
        first = F.try_element_at(rest, F.lit(1))
        led = F.coalesce((first == platform) & (F.size(rest) >= 2), F.lit(False))
        title = F.when(led, F.try_element_at(rest, F.lit(2))).otherwise(F.coalesce(first, F.try_element_at(ls, F.lit(1))))
        body = F.nullif(F.array_join(F.slice(rest, F.when(led, 3).otherwise(2), F.size(rest) + 1), "\n"), F.lit(""))
        return F.struct(
            F.coalesce(platform, F.lit(NO_PLATFORM)).alias("platform"), title.alias("title"), body.alias("body"), origin.alias("source"),
            up.alias("up_name"), plays.alias("play_count"), url.alias("canonical_url"),
        )

    return F.when(shared, let(rest, titled))


def compact_card(content: Column) -> Column:
    """The card of a compact block without the signs of a share: its first line is the title."""
    ls = lines(content)
    t = text(content)
    platform = F.when(t.contains(RED), RED).when(t.contains(BILI) | F.lower(t).contains(BILI_EN), BILI).when(has_any(t, ("小程序", MINI_SOURCE)), MINI)
    body = F.when(F.size(ls) > 1, F.array_join(F.slice(ls, 2, F.size(ls)), "\n"))
    none = F.lit(None).cast("string")
    return F.struct(
        F.coalesce(platform, F.lit(NO_PLATFORM)).alias("platform"), F.coalesce(F.try_element_at(ls, F.lit(1)), F.lit("")).alias("title"), body.alias("body"),
        platform.alias("source"), none.alias("up_name"), F.lit(None).cast("bigint").alias("play_count"), F.nullif(F.regexp_extract(t, URL, 0), F.lit("")).alias("canonical_url"),
    )


def quoted(ls: Column) -> Column:
    """Whether lines begin with a quote: three or more, and neither of the first two a time."""
    return (F.size(ls) >= 3) & ~is_time_line(F.try_element_at(ls, F.lit(1))) & ~is_time_line(F.try_element_at(ls, F.lit(2)))


def quote_meta(ls: Column) -> Column:
    """Nickname, label and text of the quote that stripped, non-blank lines begin with; null without one.

    As in the reference any three lines do, so that the first line of a plain text is taken for a nickname.
    """
    nickname = strip(F.translate(F.try_element_at(ls, F.lit(1)), "<>", ""))
    label = F.when(nickname.startswith("我"), "我").otherwise("对方")
    meta = F.struct(nickname.alias("original_nickname"), label.alias("original_sender_label"), F.try_element_at(ls, F.lit(2)).alias("quoted_text"))
    return F.when(quoted(ls), meta)


def without_quote(ls: Column) -> Column:
    """The lines without the quote's nickname and later times; all lines where there is no quote."""
    rest = F.filter(F.slice(ls, 3, F.size(ls) + 1), lambda x: ~is_time_line(x))
    return F.when(quoted(ls), F.concat(F.slice(ls, 2, 1), rest)).otherwise(ls)
