"""Time texts of a chat: separators, relative times, and ISO strings. A reference time is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, any_of, filled, lines, norm_text, strip, text

D, S = r"\p{Nd}", f"[{WS}]*"
CLOCK = rf"{D}{{1,2}}:{D}{{2}}(?::{D}{{2}})?"
DAY = "[一二三四五六日天]"

# Forms of a text that is only a time, in the storage of the reference.
STORAGE_FORMS = (
    rf"(?:{D}{{4}}年)?{S}{D}{{1,2}}月{S}{D}{{1,2}}日{S}(?:{CLOCK})?{S}",
    CLOCK,
    f"星期{DAY}",
    f"周{DAY}",
    rf"(?:昨天|今天|前天){S}{CLOCK}",
    "昨天|今天|前天",
    rf"(?:上午|下午|中午|凌晨|傍晚|晚间){S}{CLOCK}",
    rf"(?:AM|PM){S}{CLOCK}",
)
# The same in its merge.
MERGE_FORMS = (
    rf"{D}{{4}}年{D}{{1,2}}月{D}{{1,2}}日",
    rf"{D}{{1,2}}月{D}{{1,2}}日(?:{S}{CLOCK})?",
    CLOCK,
    f"(?:星期|周){DAY}(?:{S}{CLOCK})?",
    rf"(?:昨天|今天|前天)(?:{S}{D}{{1,2}}:{D}{{2}})?",
    rf"(?:下午|上午|中午|凌晨|傍晚|晚间|早上|早晨){S}{CLOCK}",
    rf"(?:AM|PM){S}{CLOCK}",
)
# Characters of a text that may be only a time, and those of which it must hold one.
STORAGE_LOOSE, STORAGE_NEEDS = rf"\A[0-9{WS}:年/月日.-]+\z", "[年月日:]"
MERGE_LOOSE, MERGE_NEEDS = rf"\A[0-9{WS}:./\-年月日星期周]+\z", "[年月日周:/.-]|星期"
# Parts of the day, and the forms of a time line; in its class of one character the reference lists words.
PERIODS = "凌晨|早上|上午|中午|下午|晚上"
_ONE = "[凌晨|早上|上午|中午|下午|晚上]"
TIME_LINE = rf"\A(?:{D}{{4}}年)?(?:{D}{{1,2}}月{D}{{1,2}}日|昨天|今天|前天)?{S}{_ONE}?{S}{D}{{1,2}}[:：]{D}{{2}}\z"
TIME_LINE_WORDS = rf"\A(?:{D}{{4}}年)?(?:{D}{{1,2}}月{D}{{1,2}}日|昨天|今天|前天|(?:星期|周){DAY})?{S}(?:{PERIODS})?{S}{D}{{1,2}}[:：]{D}{{2}}\z"
WEEKDAY_LINE = rf"\A{S}(?:星期|周){DAY}{S}{_ONE}?{S}[0-2]?{D}:{D}{{2}}{S}\z"
SEPARATOR_CHARS = rf"[0-9{WS}:年/月日号\-.今天昨天前天星期周一二三四五六日天凌晨早上午中午下午晚上]"
TIME_LIKE = rf"{D}{{1,2}}:{D}{{2}}|昨天|今天|星期|年.+月.+日"
# Forms that set the time in the script that merges by real time.
STRICT_FORMS = (
    rf"{D}{{4}}年{D}{{1,2}}月{D}{{1,2}}日{S}{D}{{1,2}}[:：]{D}{{1,2}}",
    rf"{D}{{1,2}}月{D}{{1,2}}日{S}{D}{{1,2}}[:：]{D}{{1,2}}",
    rf"昨天{S}{D}{{1,2}}[:：]{D}{{1,2}}",
    rf"星期{DAY}{S}{D}{{1,2}}[:：]{D}{{1,2}}",
    rf"{D}{{1,2}}[:：]{D}{{1,2}}",
)


def whole(forms) -> str:
    """A pattern for texts that have one of the forms from end to end."""
    return rf"\A(?:{'|'.join(forms)})\z"


#: All characters that such texts are made of; a cheap test that most texts fail at their first one.
ONLY_TIME_CHARS = rf"\A[{WS}\p{{Nd}}\x{{200B}}-\x{{200F}}:：/.\-年月日星期周一二三四五六天昨今前上下午中凌晨傍晚间早AMP]+\z"


def _one_of(forms, loose: str, needs: str) -> str:
    """A pattern for the forms, or for a loose text that holds what it needs."""
    return rf"\A(?:{'|'.join(forms)}|(?=[\s\S]*?(?:{needs})){loose.removeprefix(chr(92) + 'A').removesuffix(chr(92) + 'z')})\z"


def only_time_storage(content: Column, extra: tuple[str, ...] = ()) -> Column:
    """Whether a text is only a time, by the storage's forms; ``extra`` patterns are matched from the text's start."""
    c = text(content)
    forms = c.rlike(ONLY_TIME_CHARS) & strip(c).rlike(_one_of(STORAGE_FORMS, STORAGE_LOOSE, STORAGE_NEEDS))
    more = [(strip(c) != "") & strip(c).rlike(rf"\A(?:{p})") for p in extra if p]
    return any_of([forms, *more])


def only_time_merge(content: Column) -> Column:
    """Whether a text is only a time, by the merge's forms, which differ from the storage's."""
    return text(content).rlike(ONLY_TIME_CHARS) & norm_text(content).rlike(_one_of(MERGE_FORMS, MERGE_LOOSE, MERGE_NEEDS))


def is_time_line(line: Column, compat: bool = True) -> Column:
    """Whether a line is a time stamp. ``compat`` keeps to one character between date and time, by which ``下午3:05`` is
    none; without it the parts of the day and weekdays count as words."""
    return strip(text(line)).rlike(TIME_LINE if compat else TIME_LINE_WORDS)


def is_separator(content: Column, compat: bool = True) -> Column:
    """Whether a message of up to two lines is a time separator. A text of white space only counts, null and empty don't."""
    t = strip(text(content))
    ls = lines(content)
    weekday = lambda x: x.rlike(WEEKDAY_LINE)
    each = F.forall(ls, lambda x: is_time_line(x, compat) | weekday(x))
    pure = ~filled(F.regexp_replace(t, SEPARATOR_CHARS, "")) if compat else F.lit(True)
    return (text(content) != "") & (F.size(ls) <= 2) & ((each & pure) | weekday(t))


def is_time_like(content: Column) -> Column:
    return text(content).rlike(TIME_LIKE)


def is_strict_time(content: Column) -> Column:
    return strip(text(content)).rlike(whole(STRICT_FORMS))


def _hour(hour: Column, period: Column) -> Column:
    late = period.isin("下午", "晚上") & (hour < 12)
    return F.when(late, hour + 12).when((period == "凌晨") & (hour == 12), 0).otherwise(hour)


def parse_relative(content: Column, ref: Column, periods: bool = True) -> Column:
    """The time a text names, seen from ``ref``; ``ref`` itself where it names none or an impossible one.

    A date without a year gets the year of ``ref``, even if that lies ahead; the weekday of ``ref`` means a week ago.
    ``periods=False`` reads the forms of the merge script: no parts of the day, and a full date needs the ASCII colon.
    """
    t = F.translate(strip(text(content)), "０１２３４５６７８９", "0123456789")
    part = rf"(?:({PERIODS}){S})?" if periods else "()"
    dated = rf"\A(?:(?:([0-9]{{4}})年)?([0-9]{{1,2}})月([0-9]{{1,2}})日|(昨天)|星期({DAY})){S}{part}([0-9]{{1,2}})([:：])([0-9]{{1,2}})"
    plain = rf"\A{part}([0-9]{{1,2}})[:：]([0-9]{{1,2}})\z"
    group = lambda i: F.regexp_extract(t, dated, i)
    number = lambda i: group(i).try_cast("int")
    hour = _hour(number(7), group(6))
    target = F.instr(F.lit("一二三四五六日"), F.translate(group(5), "天", "日")) - 1
    back = F.pmod(F.weekday(ref) - target, F.lit(7))
    day = F.date_sub(F.to_date(ref), F.when(group(4) != "", 1).otherwise(F.when(back == 0, 7).otherwise(back)))
    by_date = group(3) != ""
    zero = F.lit(0)
    date_form = F.try_make_timestamp_ntz(F.coalesce(number(1), F.year(ref)), number(2), number(3), hour, number(9), zero)
    back_form = F.try_make_timestamp_ntz(F.year(day), F.month(day), F.dayofmonth(day), hour, number(9), zero)
    named = F.when(by_date, date_form).otherwise(back_form)
    if not periods:
        named = F.when((group(1) == "") | (group(8) == ":"), named)
    h = _hour(F.regexp_extract(t, plain, 2).try_cast("int"), F.regexp_extract(t, plain, 1))
    today = F.try_make_timestamp_ntz(F.year(ref), F.month(ref), F.dayofmonth(ref), h, F.regexp_extract(t, plain, 3).try_cast("int"), zero)
    return F.coalesce(F.when(t.rlike(dated), named).when(t.rlike(plain), today), ref)


def iso(ts: Column) -> Column:
    """ISO text of a time: without a fraction where that is zero, else with six digits; null stays null."""
    return F.regexp_replace(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")


def seconds(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


_STAMP = r"\A([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})T([0-9]{1,2}):([0-9]{1,2}):([0-9]{1,2})\z"


def read_stamp(stamp: Column) -> Column:
    """The time of a normalised stamp, null where it can't be read; months to seconds may have one digit."""
    g = [F.regexp_extract(stamp, _STAMP, i).try_cast("int") for i in range(1, 7)]
    return F.when(stamp.rlike(_STAMP) & (g[5] < 60), F.try_make_timestamp_ntz(*g))


def norm_stamp(stamp: Column) -> Column:
    """A time string as ISO to the second: cut at the first ``.``, with ``T``; as it is where it can't be read."""
    s = F.split_part(strip(text(stamp)), F.lit("."), F.lit(1))
    s = F.when(s.contains("T"), s).otherwise(F.translate(s, " ", "T"))
    return F.coalesce(F.date_format(read_stamp(s), "yyyy-MM-dd'T'HH:mm:ss"), s)


def scan_time(file_name: Column) -> Column:
    """The time in a file name as ``20251206_105339``, null without one."""
    part = F.regexp_extract(text(file_name), "([0-9]{8}_[0-9]{6})", 1)
    return F.try_to_timestamp(part, F.lit("yyyyMMdd_HHmmss")).cast("timestamp_ntz")
