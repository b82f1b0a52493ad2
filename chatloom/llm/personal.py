"""Problem 1: personal data in message texts is found; ``surrogates`` replaces it.

A text is read in a plain form (compatibility characters as ordinary ones, invisible characters left out) that keeps the
place of every character, so that values are found however written and only their own characters are replaced.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Family names of one character, then of two.
FAMILY = (
    "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔曹严华金魏陶姜戚谢邹喻柏窦章苏潘葛奚范彭郎鲁韦昌马苗凤方俞任袁柳酆鲍史唐费廉岑薛雷贺倪汤滕殷罗毕郝邬安常乐于傅皮卞齐康伍余元卜顾孟黄"
    "穆萧尹姚邵湛汪祁毛禹狄贝明臧计伏成戴谈宋茅庞熊纪舒屈项祝董梁杜阮蓝闵席季麻强贾路娄危江童颜郭梅盛林刁钟徐邱骆高夏蔡田樊胡凌霍虞万支柯昝管卢莫经房裘缪干解应宗丁宣邓郁单杭洪包诸左石崔吉龚程"
    "邢裴陆荣翁荀羊於惠甄曲封芮羿储靳汲邴糜松井段富巫乌焦巴弓牧隗谷车侯宓蓬全郗班仰秋仲伊宫宁仇栾暴甘厉戎祖武符刘景詹束龙叶幸司韶郜黎蓟薄印宿白怀蒲邰从鄂索咸籍赖卓蔺屠蒙池乔阴闻莘党翟谭贡劳逄姬申"
    "扶堵冉宰郦雍璩桑桂濮牛寿通边扈燕冀浦尚农温别庄晏柴瞿阎充慕连茹习宦艾鱼容向古易慎戈廖庾终暨居衡步都耿满弘匡国文寇广禄阙东欧殳沃利蔚越夔隆师巩厍聂晁勾敖融冷訾辛阚那简饶曾沙丰关蒯相查后荆红游竺权逯盖益桓公仉岳肖"
)
FAMILY_2 = "欧阳|司马|上官|诸葛|东方|皇甫|尉迟|公孙|令狐|慕容|司徒|夏侯|长孙|宇文|端木|独孤|南宫|闻人|澹台|轩辕|钟离|申屠|淳于|单于|太史"
_ZH = rf"(?:{FAMILY_2}|[{FAMILY}])[一-鿿]{{1,2}}"
_W = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
_NAME = rf"(?:(?!(?:the|a|an|my|me|us|it|and|for|has|is)\b){_W}[ \t]+(?:[^\W\d_]\.?[ \t]+)?(?!(?:has|is|the|and|with|at|in|on|when|for|please|by|near)\b){_W}|(?!(?:the|a|an)\b){_W},[ \t]*(?!(?:the|a|an|has|is|and|text|ring|my)\b){_W}(?:[ \t]+[^\W\d_]\.)?)"
_KIND_OF_STREET = r"(?:street|str|st|road|rd|avenue|ave|lane|ln|close|crescent|cres|terrace|drive|dr|court|ct|square|sq|place|pl|boulevard|blvd|row|mews|grove|hill|walk|way|gardens)"
_SMALL = r"(?:the|a|an|in|on|at|of|is|was|are|to|by|and|or|for|min|minutes|hours?|days?|people|from|into|near|past|with|other|more)"
_S = r"[\s.\-]{0,3}"
_FREE, _ENDS = r"(?<![A-Za-z0-9])(?<!\d[.\-])", r"(?![A-Za-z0-9])(?![.\-]\d)"

#: Kind and pattern, in the order in which they take their characters; a group ``v`` (``w``, ``x``) is the value
#: where the pattern is wider. Links only take theirs.
PATTERNS = [
    ("", r"https?://[A-Za-z0-9./_?=&%#~-]+"),
    ("email", r"(?<![A-Za-z0-9_.+-])[A-Za-z0-9](?:[A-Za-z0-9_+\-]|\.(?=[A-Za-z0-9_])|\s+dot\s+)*?(?:\s?@\s?|\s?[(\[{]\s?at\s?[)\]}]\s?|\s+at\s+(?=[\w-]+\s+dot\s))[A-Za-z0-9-]+(?:(?:\.|\s+dot\s+|\s?[(\[{]\s?dot\s?[)\]}]\s?)[A-Za-z0-9-]+)+"),
    ("id_number", rf"{_FREE}(?<!单号)[1-9]\d{{5}}[\s\-]?(?:19|20)\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])[\s\-]?\d{{3}}[\dXx]{_ENDS}"),
    ("id_number", rf"{_FREE}[A-Za-z]{{2}}\s?\d\d\s?\d\d\s?\d\d\s?[A-Da-d]{_ENDS}"),
    ("id_number", rf"{_FREE}\d{{3}}[- ]\d\d[- ]\d{{4}}{_ENDS}"),
    ("id_number", rf"(?:passport|social|insurance|\bid\b|identity|证件|身份证|护照|实名)[^\d\n]{{0,24}}?(?<![A-Za-z0-9])(?P<v>[A-Za-z]{{0,2}}\d{{7,9}}){_ENDS}"),
    ("id_number", rf"{_FREE}[EPGep]\d{{8}}{_ENDS}"),
    ("phone", rf"{_FREE}(?:(?:\+|00)\s?86{_S})?1[3-9]\d(?:{_S}\d){{8}}{_ENDS}"),
    ("phone", rf"{_FREE}(?:\(0\d{{2,3}}\)|0\d{{2,3}})[\s\-]{{0,2}}[2-9]\d{{3}}[\s\-]?\d{{3,4}}{_ENDS}"),
    ("phone", rf"{_FREE}(?:(?:\+|00)\s?44{_S}(?:\(0\)\s?)?|0)[1-9]\d{{1,4}}(?:{_S}\d){{7,8}}{_ENDS}"),
    ("phone", rf"{_FREE}(?:\+?1{_S})?(?:\(\d{{3}}\)\s?|\d{{3}}[.\- ])\d{{3}}[.\- ]\d{{4}}{_ENDS}"),
    ("phone", rf"(?<![A-Za-z0-9+])\+[1-9]\d{{0,2}}(?:[\s.\-/]{{0,2}}(?:\(0\)|\d)){{7,12}}{_ENDS}"),
    ("address", rf"(?<![\w.:])(?:(?:flat|unit|apt\.?|apartment)\s+\d+[a-z]?,?\s+)?\d{{1,4}}[a-z]?,?\s+(?:(?!{_SMALL}\b){_W}\s+){{1,3}}{_KIND_OF_STREET}\b\.?(?!\s+(?:{_W}\s+)?(?:rules|guide|minutes|yearbook|inventory)\b)"),
    ("address", rf"(?<!\w){_W}(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|damm)\s+\d{{1,4}}\s?[a-z]?(?!\w)"),
    ("address", r"(?:寄到|地址是|地址[:：]|我住|住在|送到)?(?P<v>(?:[一-鿿]{2,4}?[市州])?(?:[一-鿿]{2,5}?区)?[一-鿿]{1,5}(?:路|街|大道|巷|胡同|道)\s?\d+\s?号(?!线|桌|车|门口|楼?公交)(?:[一-鿿]{2,6}\s?\d+\s?[栋幢座]\s?(?:\d+\s?单元)?\s?\d+\s?室?)?)"),
    ("address", r"(?:寄到|地址是|地址[:：]|我住|住在|送到)?(?P<v>(?:[一-鿿]{2,4}?[市州])?(?:[一-鿿]{2,5}?区)?[一-鿿]{1,5}(?:路|街|大道|巷|胡同|道)\s?\d+\s?弄\s?\d+\s?号\s?\d*\s?室?)"),
    ("address", r"(?:寄到|地址是|地址[:：]|我住|住在|送到)?(?P<v>[一-鿿]{2,8}\s?\d+\s?(?:栋|幢|座|号楼)\s?(?:\d+\s?单元)?\s?\d+\s?室)"),
    ("address", r"(?<![一-鿿])(?:寄到|地址是|地址[:：]|我住|住在|送到)?(?P<v>(?!取件码|快递|订单|单号|版本|编号)[一-鿿]{3,14}(?<!码)(?<!号)(?<!单)\d{1,3}-\d{1,2}-\d{3,4}(?![\d\-]))"),
    ("name", rf"(?:联系人|收件人|收货人|姓名|名字)\s?[:：是]?\s?(?P<v>{_ZH})(?![一-鿿])"),
    ("name", rf"(?:(?<=找)(?P<v>{_ZH})(?=拿|取|要|问)|(?<![一-鿿])(?P<w>{_ZH})(?=说[他她])|(?<=和)(?P<x>{_ZH})(?=约))"),
    ("name", rf"(?<![一-鿿])(?P<v>{_ZH})(?=(?:先生|女士)(?![一-鿿]*店))"),
    ("name", rf"(?:\bname\s*:|\bask\s+for\b|\bsay\s+hi\s+to\b|\bbooking\s+is\s+under\b|\bcontact\s*:)\s*(?P<v>{_NAME})"),
    ("name", rf"(?<![\w,])(?P<v>{_NAME})(?=\s+has\s+the\s+keys)"),
    ("name", rf"\b(?:(?:Mr|Ms|Mrs|Dr)\.?|Herr|Frau)\s+(?P<v>{_W}\s+{_W})"),
]
#: What a text must hold for a pattern of a kind to be tried, by the pattern's kind and place; cheaper than the patterns.
_DIGITS = re.compile(r"(?:[0-9][^0-9]{0,3}){7}")
_LETTERED = re.compile(r"[a-z]{1,2}\s?[0-9]{2}\s?[0-9]{2}\s?[0-9]{2}", re.I)
_MARKS = {
    "email": re.compile(r"@|[(\[{\s]at[)\]}\s]", re.I),
    "id_number": re.compile(f"{_DIGITS.pattern}|{_LETTERED.pattern}", re.I),
    "phone": _DIGITS,
    "address": re.compile(rf"[0-9]\s?(?:号|弄|栋|幢|座|-)|[0-9][0-9a-z,\s].*?{_KIND_OF_STREET}\b|(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|damm)\s+[0-9]", re.I | re.S),
    "name": re.compile(r"人|名|找|说|约|先生|女士|name|ask|say|under|keys|contact|\b(?:mr|ms|mrs|dr|herr|frau)\b", re.I),
    "": re.compile("http", re.I),
}
_COMPILED = [(kind, re.compile(p, re.I)) for kind, p in PATTERNS]
_ANY = re.compile(r"[0-9@]|人|名|找|说|约|先生|女士|at|name|ask|say|under|keys|contact|mr|ms|dr|herr|frau", re.I)
KINDS = ("email", "phone", "id_number", "address", "name")


def plain(text: str) -> tuple[str, list[int] | None]:
    """The text in plain form, and the place in ``text`` of each of its characters (None: the same)."""
    if text.isascii():
        return text, None
    out, at = [], []
    for i, c in enumerate(text):
        if c > "\x7f" and not "一" <= c <= "鿿":
            if unicodedata.category(c) == "Cf":
                continue
            for x in unicodedata.normalize("NFKC", c):
                out.append(x)
                at.append(i)
        else:
            out.append(c)
            at.append(i)
    return "".join(out), at


def spans(text: str) -> list[tuple[int, int, str]]:
    """``start, end, kind`` of the values in a text, in order and apart from each other."""
    flat, at = plain(text)
    if not _ANY.search(flat):
        return []
    tried = {kind for kind, mark in _MARKS.items() if mark.search(flat)}
    if tried <= {""}:
        return []
    found: list[tuple[int, int, str]] = []
    for kind, pattern in _COMPILED:
        if kind not in tried:
            continue
        for m in pattern.finditer(flat):
            start, end = next((m.span(g) for g in ("v", "w", "x") if m.groupdict().get(g)), m.span())
            i = bisect_right(found, (start, end, "~"))
            if (i and found[i - 1][1] > start) or (i < len(found) and found[i][0] < end):
                continue
            found.insert(i, (start, end, kind))
    return [(s, e, k) if at is None else (at[s], at[e - 1] + 1, k) for s, e, k in found if k]


def masked(text: str) -> str:
    """The text with each value as a placeholder of its kind."""
    out, last = [], 0
    for start, end, kind in spans(text):
        out += [text[last:start], f"[{kind.upper()}]"]
        last = end
    return "".join(out) + text[last:]


def masked_column(text: Column) -> Column:
    """A text with placeholders; null stays null."""
    import pyarrow as pa

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([masked(t) if t else t for t in texts.to_pylist()], pa.string())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, StringType())(text)


def mask(messages: DataFrame) -> DataFrame:
    """The messages with placeholders in ``content``."""
    return messages.withColumn("content", masked_column(F.col("content")))
