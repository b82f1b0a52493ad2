"""Problem 3: one consistent form for text that looks the same.

Texts that may hold something to change are exploded into segments, and the segments concerned into positioned code
points; a broadcast join with the character table decomposes compatibility forms of letters and digits and finds
look-alikes, spaces and invisible characters; combining marks are ordered by class; clusters are recomposed by a second
broadcast join, and the strings rebuilt. Both tables follow from the Unicode database, and so have a fixed size.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chatloom.runtime import materialise

# Letters of other alphabets (Cyrillic, Greek, Armenian, Cherokee, Coptic, phonetic) that look like Latin
# ones, then those Latin ones.
LOOK_ALIKE = dict(
    zip(
        "АВЕКМНОРСТУХІЈЅԌԚԜаеорсухіјѕһԁԛԝӏѵѴΑΒΕΖΗΙΚΜΝΟΡΤΥΧανοριυϲϳͿϹօոսհցզյՕՍԼՏᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃⲞⲟⲤⲥⲢⲣɡɑɩᴏᴄᴠᴡᴢ",
        "ABEKMHOPCTYXIJSGQWaeopcyxijshdqwlvVABEZHIKMNOPTYXavopiucjJConuhgqjOULSABCDEHJKLMPRSTVWZOoCcPpgaiocvwz",
    )
)
#: Alphabets that count as foreign within a Latin word.
FOREIGN = ("GREEK", "CYRILLIC", "ARMENIAN", "CHEROKEE", "COPTIC")
# Signs of the radicals supplement without a decomposition of their own, then the characters they look like.
RADICALS = dict(zip("⺁⺎⺏⺐⺟⺠⺩⺪⻁⻃⻄⻅⻆⻉⻋⻌⻓⻔⻘⻙⻚⻛⻜⻝⻢⻣⻤⻥⻦⻧⻨⻩⻪⻬⻮⻯⻰⻳", "厂兀尣尢母民王疋虎覀西见角贝车辶长门青韦页风飞食马骨鬼鱼鸟卤麦黄黾齐齿竜龙龟"))
# Characters without a shape of their own, beside the format characters (class Cf).
SHAPELESS = "͏ᅟᅠ឴឵ㅤﾠ"
# Line ends beside the ordinary ones, and the flag that tag characters belong to.
LINE_ENDS = "\x0b\x0c\x85\u2028\u2029"
JOINER, FLAG = "\u200d", 0x1F3F4
WORD = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}\p{Cf}]*|[^\p{L}\p{N}]+"


def _rewritten(c: str) -> str | None:
    """What a compatibility form of a letter or digit decomposes to; None for other characters."""
    if c in RADICALS:
        return RADICALS[c]
    kind = unicodedata.category(c)
    if kind[0] not in "LN" and kind != "So":
        return None
    plain = unicodedata.normalize("NFKC", c)
    if plain == c or not all(unicodedata.category(x)[0] in "LNM" for x in plain):
        return None
    return unicodedata.normalize("NFKD", c)


@lru_cache(maxsize=1)
def characters() -> list[tuple[int, str, str]]:
    """``cp, kind, to`` of the characters that matter: kinds are x (invisible), j (joiner), t (tag), s (space or line
    end), r (rewritten), d (decomposed for recomposition), a (look-alike of a Latin letter), g (other letter of such an
    alphabet), l (Latin), e (emoji), m (mark)."""
    out = []
    for cp in [*range(0x20), *range(0x7F, sys.maxunicode + 1)]:
        if 0x3400 <= cp <= 0x9FFF or 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xF8FF or 0x20000 <= cp <= 0x2F7FF or cp > 0xE01EF:
            continue
        c = chr(cp)
        if c in "\t\n\r":
            continue
        if c in LINE_ENDS:
            out.append((cp, "s", "\n"))
            continue
        if cp < 0xA0 or 0xFE00 <= cp <= 0xFE0E or 0xE0100 <= cp:
            out.append((cp, "x", ""))
            continue
        if 0xE0020 <= cp <= 0xE007F:
            out.append((cp, "t", c))
            continue
        kind = unicodedata.category(c)
        if kind == "Cn":
            continue
        name = unicodedata.name(c, "") if kind[0] in "L" else ""
        if c == JOINER:
            out.append((cp, "j", c))
        elif c in SHAPELESS or kind == "Cf" and not 0x600 <= cp <= 0x8FF and cp != 0x110BD:
            out.append((cp, "x", ""))
        elif kind == "Zs":
            out.append((cp, "s", " "))
        elif (to := _rewritten(c)) is not None:
            out.append((cp, "r", to))
        elif c in LOOK_ALIKE:
            out.append((cp, "a", c))
        elif name.startswith(FOREIGN):
            out.append((cp, "g", unicodedata.normalize("NFD", c)))
        elif name.startswith("LATIN"):
            out.append((cp, "l", unicodedata.normalize("NFD", c)))
        elif kind == "So" or 0x1F3FB <= cp <= 0x1F3FF or cp == 0xFE0F:
            out.append((cp, "e", c))
        elif kind[0] == "M":
            out.append((cp, "m", unicodedata.normalize("NFD", c)))
        elif kind[0] == "L" and unicodedata.normalize("NFD", c) != c:
            out.append((cp, "d", unicodedata.normalize("NFD", c)))
    return out


def _java(cps) -> str:
    """A Java character class of code points, as ranges."""
    out, start, last = [], None, None
    for cp in [*sorted(cps), None]:
        if start is not None and cp != last + 1:
            out.append(f"\\x{{{start:X}}}-\\x{{{last:X}}}")
            start = None
        if cp is not None and start is None:
            start = cp
        last = cp
    return "".join(out)


@lru_cache(maxsize=1)
def gate() -> str:
    """A pattern that finds a superset of what may change: characters to drop or rewrite, marks, and look-alikes that
    touch a Latin letter or something to rewrite."""
    touched = _java(cp for cp, kind, _ in characters() if kind in "xjtsr")
    alike = _java(map(ord, LOOK_ALIKE))
    latin = rf"\p{{IsLatin}}&&[^{alike}]"
    common = r"(?=[^\x09\x0A\x0D\x20-\x7E一-鿿，。？！：])"
    return rf"{common}(?:[{touched}\x{{1161}}-\x{{1175}}]|\p{{M}}|[{alike}](?:[{latin}]|(?<=[{latin}][{alike}])|[\p{{L}}\p{{N}}\p{{M}}\p{{Cf}}]*[{latin}]|(?<=[{latin}][\p{{L}}\p{{N}}\p{{M}}\p{{Cf}}]{{1,200}})))"


def tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The character table ``cp, kind, to, alike`` and the composition table ``cluster, composed``."""
    chars = [(cp, kind, to, LOOK_ALIKE.get(chr(cp))) for cp, kind, to in characters()]
    whole = {}
    for cp, _, _ in characters():
        c = chr(cp)
        apart = unicodedata.normalize("NFD", c)
        if apart != c and unicodedata.normalize("NFC", apart) == c:
            whole[apart] = c
    return (
        spark.createDataFrame(chars, "cp int, kind string, to string, alike string"),
        spark.createDataFrame(sorted(whole.items()), "cluster string, composed string"),
    )


@lru_cache(maxsize=1)
def _classes() -> str:
    """Combining classes that are not 0, as ``cp:class`` pairs."""
    return ",".join(f"{cp}:{k}" for cp in range(0x300, 0x1F000) if (k := unicodedata.combining(chr(cp))))


def consistent(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``*keys, text, unified`` of the texts that may change; all others are in the consistent form already.

    ``keys`` must identify a row. Null and empty texts are never changed. Emoji with their joiners and selectors,
    full-width punctuation, composed letters and words wholly in another alphabet stay; a look-alike becomes Latin only
    in a word with more Latin letters than letters of such alphabets that cannot be taken for Latin.
    """
    spark = texts.sparkSession
    chars, compose = tables(spark)
    classes = spark.createDataFrame([(int(a), int(b)) for a, b in (x.split(":") for x in _classes().split(","))], "mark int, ccc int")
    some = texts.select(*keys, F.col(text_col).alias("text")).filter(F.col("text").rlike(gate()))
    # the texts are scanned once; everything below keeps to this partitioning
    some = materialise(some, "loose").repartition(*keys)
    segs = some.select(*keys, F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s){WORD}"), F.lit(0))).alias("_s", "seg"))
    loose = F.col("seg").rlike(gate())
    points = segs.select(*keys, "_s", loose.alias("_loose"), F.posexplode(F.when(loose, F.regexp_extract_all("seg", F.lit("(?s)."), F.lit(0))).otherwise(F.array("seg"))).alias("_p", "c"))
    points = points.withColumn("cp", F.when(F.col("_loose"), F.ascii("c")))
    points = points.join(F.broadcast(chars), "cp", "left")
    seg = Window.partitionBy(*keys, "_s")
    line = seg.orderBy("_p")
    plain = F.col("cp").between(65, 90) | F.col("cp").between(97, 122)
    latin = F.count_if(F.coalesce(plain, F.lit(False)) | F.coalesce((F.col("kind") == "l") | ((F.col("kind") == "r") & F.col("to").rlike(r"\p{IsLatin}")), F.lit(False)))
    foreign = F.count_if(F.coalesce(F.col("kind") == "g", F.lit(False)))
    flag = F.max(F.coalesce(F.col("cp") == FLAG, F.lit(False)))
    points = points.withColumns({"_latin": latin.over(seg), "_foreign": foreign.over(seg), "_flag": flag.over(seg), "_before": F.lag("kind").over(line), "_after": F.lead("kind").over(line)})
    new = (
        F.when(F.col("kind").isNull(), F.col("c"))
        .when(F.col("kind") == "j", F.when((F.col("_before") == "e") & (F.col("_after") == "e"), F.col("c")).otherwise(""))
        .when(F.col("kind") == "t", F.when(F.col("_flag"), F.col("c")).otherwise(""))
        .when((F.col("kind") == "a") & (F.col("_latin") > F.col("_foreign")), F.col("alike"))
        .when(F.col("kind") == "a", F.col("c"))
        .otherwise(F.col("to"))
    )
    parts = points.select(*keys, "_s", "_p", "_loose", F.posexplode(F.when(F.col("_loose"), F.regexp_extract_all(new, F.lit("(?s)."), F.lit(0))).otherwise(F.array("c"))).alias("_d", "c"))
    parts = parts.withColumn("mark", F.when(F.col("_loose"), F.ascii("c"))).join(F.broadcast(classes), "mark", "left")
    order = Window.partitionBy(*keys, "_s").orderBy("_p", "_d")
    # a cluster begins at each character of class 0; vowels and finals of Hangul follow their consonant
    follows = F.col("ccc").isNotNull() | F.coalesce(F.col("mark").between(0x1161, 0x1175) | F.col("mark").between(0x11A8, 0x11C2), F.lit(False))
    parts = parts.withColumn("_k", F.sum(F.when(follows, 0).otherwise(1)).over(order))
    inside = F.sort_array(F.collect_list(F.struct(F.coalesce("ccc", F.lit(0)).alias("ccc"), "_p", "_d", "c")))
    clusters = parts.groupBy(*keys, "_s", "_k").agg(F.array_join(F.transform(inside, lambda x: x["c"]), "").alias("cluster"), F.max("_loose").alias("_loose"))
    # marks beyond what composes with the base stay behind it, in their order
    lead = F.when(F.col("_loose") & (F.length("cluster") > 2), F.substring("cluster", 1, 2))
    short = compose.select(F.col("cluster").alias("_lead"), F.col("composed").alias("_short"))
    clusters = clusters.withColumn("_lead", lead).join(F.broadcast(compose), "cluster", "left").join(F.broadcast(short), "_lead", "left")
    code = [F.ascii(F.substring("cluster", i, 1)) for i in (1, 2, 3)]
    syllable = (code[0] - 0x1100) * 588 + (code[1] - 0x1161) * 28 + F.when(F.length("cluster") == 3, code[2] - 0x11A7).otherwise(0) + 0xAC00
    hangul = F.col("_loose") & F.col("cluster").rlike("^[\\u1100-\\u1112][\\u1161-\\u1175][\\u11A8-\\u11C2]?$")
    out = F.coalesce("composed", F.concat("_short", F.expr("substring(cluster, 3)")), F.when(hangul, _char(syllable)), F.col("cluster"))
    rebuilt = clusters.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_s", "_k", out.alias("o")))).alias("xs"))
    rebuilt = rebuilt.select(*keys, F.array_join(F.transform("xs", lambda x: x["o"]), "").alias("unified"))
    return some.join(rebuilt, keys, "left").withColumn("unified", F.coalesce("unified", F.lit("")))


def _char(cp):
    """The character of a code point in the basic plane beyond U+0800."""
    utf8 = [F.shiftright(cp, 12) + 0xE0, F.shiftright(cp, 6).bitwiseAND(F.lit(63)) + 0x80, cp.bitwiseAND(F.lit(63)) + 0x80]
    return F.decode(F.unhex(F.concat(*[F.hex(b) for b in utf8])), "UTF-8")


def fields(messages: DataFrame, names: tuple[str, ...] = ("content", "sender"), key: str = "seq") -> DataFrame:
    """``seq, field, text`` of the named fields, one row each; nulls are left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("text")) for n in names])).alias("x")
    return messages.select(F.col(key).alias("seq"), pairs).select("seq", "x.field", "x.text").filter("text is not null")


def changed(messages: DataFrame, names: tuple[str, ...] = ("content", "sender")) -> DataFrame:
    """``seq, field, text, unified`` of the fields that are not in the consistent form."""
    return consistent(fields(messages, names), ["seq", "field"]).filter("unified <> text")


def unify(messages: DataFrame, names: tuple[str, ...] = ("content", "sender")) -> DataFrame:
    """The messages with the named fields in the consistent form. Only messages with something that may change are
    shuffled; all others go straight out."""
    loose = reduce(lambda a, b: a | b, [F.coalesce(F.col(n).rlike(gate()), F.lit(False)) for n in names])
    some = materialise(messages.filter(loose), "loose")
    new = changed(some, names).groupBy("seq").pivot("field", list(names)).agg(F.first("unified"))
    new = new.select(F.col("seq"), *[F.col(n).alias(f"_new_{n}") for n in names])
    out = some.join(new, "seq", "left").withColumns({n: F.coalesce(f"_new_{n}", n) for n in names})
    return out.drop(*[f"_new_{n}" for n in names]).unionByName(messages.filter(~loose))
