"""Text as the engine compares it: white space, lines, and tests that need no more than the text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and line ends of Unicode text, for use within a character class and as an alternative.
WS = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINE_END = r"\r\n|[\n\r\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
STRIP = rf"\A[{WS}]+|[{WS}]+\z"
#: The same characters one by one.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: What a word is made of, for word limits that hold beside Han text too.
WORD = r"\p{L}\p{N}_"

# Patterns of the privacy scan by name, with their level.
PRIVACY = (
    ("CN_mobile", "error", rf"(?:^|[^{WORD}])1[3-9]\p{{Nd}}{{9}}(?:$|[^{WORD}])"),
    ("email", "error", rf"(?:(?:^|[^{WORD}])[A-Za-z0-9_]|[{WORD}][.%+-])[A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}(?:$|[^{WORD}])"),
    ("id_number_like", "error", rf"(?:身份证号|身份证号码|银行卡号|护照号|社保号|ID[{WS}]*(?:No|Number)?)[{WS}]*[:：]?[{WS}]*\p{{Nd}}{{5,}}"),
    ("mac_users_path", "warning", r"/Users/[^/]+/"),
)


def any_of(tests) -> Column:
    return reduce(lambda a, b: a | b, tests)


def let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text(c: Column | str) -> Column:
    """The column, null as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(SPACES))


def filled(c: Column) -> Column:
    """True where a text holds more than white space; false for null."""
    return F.coalesce(c.rlike(rf"[^{WS}]"), F.lit(False))


def has_any(c: Column, words) -> Column:
    """True where a text contains one of the words, as they are."""
    return any_of(c.contains(w) for w in words)


def lines(c: Column) -> Column:
    """The stripped lines of a text that are not blank; none for null."""
    return F.filter(F.transform(F.split(text(c), LINE_END), strip), lambda x: x != "")


def norm_text(c: Column) -> Column:
    """Without zero-width and direction characters, ``：`` as ``:``, white space as single spaces; null as empty."""
    # what has no counterpart is deleted
    plain = F.translate(text(c), "：\u200b\u200c\u200d\u200e\u200f", ":")
    return F.regexp_replace(strip(plain), rf"[{WS}]+", " ")


def privacy_hits(line: Column, exact: tuple[str, ...] = ()) -> Column:
    """``array<struct<level, pattern>>`` of what a line holds; ``exact`` texts count in any letter case, as errors."""
    plain = [(w, "error", F.lower(line).contains(w.lower())) for w in exact]
    tests = plain + [(name, level, line.rlike(p)) for name, level, p in PRIVACY]
    hits = F.array(*[F.when(test, F.struct(F.lit(level).alias("level"), F.lit(name).alias("pattern"))) for name, level, test in tests])
    return F.filter(hits, lambda x: x.isNotNull())


def char_jaccard(a: Column, b: Column) -> Column:
    """Similarity of two texts as sets of characters; 0 where one is null or empty."""
    x, y = F.split(text(a), ""), F.split(text(b), "")
    some = (text(a) != "") & (text(b) != "")
    return F.when(some, F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(F.lit(0.0))


def parse_size(c: Column) -> Column:
    """Bytes of a size like ``10MB``; 10 MB where it can't be read, as in the logging of the reference."""
    s = F.upper(strip(text(c)))
    number = F.regexp_replace(s, "(?:KB|MB|GB)$", "")
    unit = F.when(s.endswith("KB"), 1 << 10).when(s.endswith("MB"), 1 << 20).when(s.endswith("GB"), 1 << 30)
    scaled = F.when(strip(number).rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)$"), strip(number).try_cast("double") * unit)
    whole = F.when(s.rlike("^[+-]?[0-9]+$"), s.try_cast("bigint"))
    return F.coalesce(F.when(unit.isNull(), whole).otherwise(scaled.cast("bigint")), F.lit(10 << 20).cast("bigint"))
