"""Surrogates for personal data: other values of the same type, script, gender and format.

Values are found by ``personal``, brought to one form for all the ways they are written, and each different value gets a
keyed surrogate of its own. Surrogates that two values share, that were given before, or that are a value of the corpus,
are drawn again, so that different people stay different. A mention is then rewritten in the format it had: its
separators, letter case, width of characters, order of names.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from chatloom.runtime import discard, materialise, skew_join

from .personal import _KIND_OF_STREET, FAMILY, FAMILY_2, plain, spans

#: The key of the surrogates; who knows it can draw them again. To be given by the caller outside of tests.
KEY = b"surrogates"
# Parts of invented names by gender, and characters of given names and places that carry no meaning here.
HAN_GIVEN = {"f": "婷娜丽芳娟雅琳萍燕雪梅兰玉莉倩颖洁薇蓉瑶", "m": "伟强军勇杰涛磊刚明辉鹏飞超斌浩宇龙峰建国", "n": "安宁文清和平思远之初一然子亦书知行言若景"}
HAN_PLACE = "青云明月松竹梅兰东西南北长安和平新华永兴金银石泉柳杨桃李河湖江海山峰林田"
LATIN_GIVEN = {
    "f": "Alice Clara Edith Flora Greta Hanna Irene Julia Karin Laura Maria Norma Olive Paula Rosa Sofia Tessa Viola Wilma Zelda".split(),
    "m": "Albert Bruno Conrad David Edgar Felix Georg Henry Ivan Jacob Konrad Louis Martin Nolan Oscar Peter Robert Simon Thomas Victor".split(),
    "n": "Ashley Blair Casey Devon Emery Frankie Jordan Kelly Lee Morgan Noel Parker Quinn Reese Robin Sidney Taylor Val Winter Yael".split(),
}
LATIN_BEGIN = "Ash Barn Black Brad Brook Carl Clay Cliff Cold Dal Dun East Elm Fair Fen Field Gar Glen Hart Haw Hill Holm Kings Lang Lind Mar Mill New North Oak".split()
LATIN_END = "bourne bridge bury by combe cote den field ford gate ham hurst land ley low mere minster more ridge shaw stead stone thorpe ton vale ward wick wood worth".split()
DOMAINS = "example.com example.net example.org mail.example post.example inbox.example".split()
_HAN_KEPT = "省市州县区镇乡路街大道巷胡同弄号栋幢座楼单元室苑园小花公寓村里庭家城府湾"
_UNIT = re.compile(rf"(?:flat|unit|apt|apartment|{_KIND_OF_STREET}|straße|strasse|weg|gasse|allee|platz|ring|damm)$", re.I)
_TOKEN = re.compile(r"[^\W\d_]+|\d+")
_AT = re.compile(r"\s*[(\[{]?\s*(?:@|\bat\b)\s*[)\]}]?\s*", re.I)
_DOT = re.compile(r"\s*[(\[{]\s*dot\s*[)\]}]\s*|\s+dot\s+|\.", re.I)
_COUNTRY = re.compile(r"^(?:\+|00)\s?(?:86|44)[\s.\-]*(?:\(0\)\s?)?")
_CONSONANTS, _VOWELS = "bcdfghjklmnprstvw", "aeiou"


class Stream:
    """Numbers drawn from a key and a value, the same in every run."""

    def __init__(self, key: bytes, *parts: object):
        self.seed, self.at, self.left = hashlib.blake2b("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), key=key[:64], digest_size=32).digest(), 0, 0

    def below(self, n: int) -> int:
        self.at += 1
        return int.from_bytes(hashlib.blake2b(self.at.to_bytes(4, "big"), key=self.seed, digest_size=8).digest(), "big") % n

    def one(self, of) -> str:
        return of[self.below(len(of))]

    def digits(self, n: int, first: str = "0123456789") -> str:
        return "".join(self.one(first if i == 0 else "0123456789") for i in range(n))


def _flat(value: str) -> str:
    return plain(value)[0]


def canonical(kind: str, value: str) -> str:
    """One form for all the ways a value is written."""
    v = _flat(value).strip()
    if kind == "phone":
        return re.sub(r"\D", "", _COUNTRY.sub("0" if re.match(r"(?:\+|00)\s?44", v) else "", v))
    if kind == "id_number":
        return re.sub(r"[\W_]", "", v).upper()
    if kind == "email":
        left, right = _AT.split(v, maxsplit=1)
        return f"{_DOT.sub('.', left)}@{_DOT.sub('.', right)}".lower()
    if kind == "name" and not re.search("[一-鿿]", v):
        last, comma, first = v.partition(",")
        return " ".join(_TOKEN.findall(f"{first} {last}" if comma else v)).lower()
    return " ".join(_TOKEN.findall(v)).lower() if not re.search("[一-鿿]", v) else re.sub(r"\s", "", v)


def gender(kind: str, value: str) -> str:
    """``f``, ``m`` or ``n`` (open) of a name, by the characters or the ending of the given name."""
    if kind != "name":
        return "n"
    if re.search("[一-鿿]", value):
        given = value[2:] if re.match(FAMILY_2, value) else value[1:]
        f, m = (sum(c in HAN_GIVEN[g] for c in given) for g in "fm")
        return "f" if f > m else "m" if m > f else "n"
    first = value.split()[0].capitalize() if value.split() else ""
    for g in "fm":
        if first in LATIN_GIVEN[g]:
            return g
    return "f" if first.endswith(("a", "ine", "elle", "ie")) else "n"


def _latin_family(s: Stream) -> str:
    return s.one(LATIN_BEGIN) + s.one(LATIN_END)


def _check_digit(first17: str) -> str:
    weights = [2 ** (17 - i) % 11 for i in range(17)]
    return "10X98765432"[sum(int(d) * w for d, w in zip(first17, weights)) % 11]


def draw(kind: str, value: str, attempt: int, key: bytes = KEY) -> str:
    """The surrogate of a canonical value at an attempt, in canonical form. Later attempts have more to draw from."""
    s = Stream(key, kind, value, attempt)
    # where all values of a format are taken, longer ones are not
    more = s.digits(max(0, attempt - 5))
    if kind == "phone":
        return value[:3] + s.digits(max(0, len(value) - 3)) + more
    if kind == "id_number":
        if len(value) == 18:
            head = s.digits(6, "123456789") + f"{1950 + s.below(60)}{1 + s.below(12):02d}{1 + s.below(28):02d}" + s.digits(3)
            return head + _check_digit(head) + more
        return more + "".join(s.one("0123456789") if c.isdigit() else c if i == len(value) - 1 else s.one("ABCEGHJKLMNPRSTWXYZ") for i, c in enumerate(value))
    if kind == "email":
        local = value.partition("@")[0]
        return "".join(s.one("0123456789") if c.isdigit() else s.one(_VOWELS if i % 2 else _CONSONANTS) if c.isalpha() else c for i, c in enumerate(local)) + more + "@" + s.one(DOMAINS)
    han = re.search("[一-鿿]", value)
    if kind == "name":
        g = gender(kind, value)
        if han:
            double = re.match(FAMILY_2, value)
            family = s.one(FAMILY_2.split("|")) if double else s.one(FAMILY[:200])
            return family + "".join(s.one(HAN_GIVEN[g] + (HAN_GIVEN["n"] if attempt > 3 else "")) for _ in range(max(1, len(value) - len(family)) + attempt // 12))
        words = value.split()
        middle = [s.one("abcdefghjklmnprstw") for w in words[1:-1] if len(w) == 1]
        family = _latin_family(s) + (f"-{_latin_family(s)}" if attempt > 8 else "")
        return " ".join([s.one(LATIN_GIVEN[g]).lower(), *middle, family.lower().replace("-", " ")])
    if han:
        return "".join(s.one("123456789" if not i or not value[i - 1].isdigit() else "0123456789") if c.isdigit() else s.one(HAN_PLACE) if "一" <= c <= "鿿" and c not in _HAN_KEPT else c for i, c in enumerate(value)) + more
    return more + " ".join(s.digits(len(w), "123456789") if w.isdigit() else w if _UNIT.match(w) or len(w) == 1 else _latin_family(s).lower() for w in value.split())


def _cased(word: str, like: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word.lower() if like.islower() else "-".join(w.capitalize() for w in word.split("-"))


def _wide(c: str, like: str) -> str:
    """A character in the width of another."""
    return chr(ord(c) + 0xFEE0) if "！" <= like <= "～" and "!" <= c <= "~" else c


def _by_character(mention: str, new: str) -> str:
    """The mention with its letters and digits taken from ``new``, in order; marks between them stay."""
    out, rest = [], iter(re.sub(r"[\W_]", "", new))
    for c in mention:
        if c.isalnum() and unicodedata.category(c) != "Cf":
            n = next(rest, "")
            n = n.lower() if unicodedata.normalize("NFKC", c).islower() else n.upper() if unicodedata.normalize("NFKC", c).isupper() else n
            out.append(_wide(n, c) if n else "")
        elif unicodedata.category(c) != "Cf":
            out.append(c)
    return "".join(out) + "".join(rest)


def rewrite(kind: str, mention: str, new: str) -> str:
    """A surrogate in the format of a mention."""
    flat = _flat(mention)
    if kind == "phone":
        head = _COUNTRY.match(flat)
        keep = head.end() if head and len(flat) == len(mention) else 0
        return mention[:keep] + _by_character(mention[keep:], new[1:] if keep and new.startswith("0") else new)
    if kind == "email":
        at = _AT.search(flat)
        dots = _DOT.search(flat, at.end())
        local, domain = new.split("@")
        wide = any("！" <= c <= "～" for c in mention)
        before = flat[: at.start()]
        dot = _DOT.search(before)
        local = local.replace(".", dot.group()) if dot else local
        out = _cased(local, before) + at.group() + _cased(domain, before).replace(".", dots.group() if dots else ".")
        out = out.lower() if not before.isupper() else out
        return "".join(_wide(c, "ａ") for c in out) if wide and mention != flat and "ａ" <= mention[:1] <= "ｚ" else out
    if kind == "id_number" or re.search("[一-鿿]", new):
        return _by_character(mention, new)
    if kind == "name":
        words = new.split()
        last, comma, _ = flat.partition(",")
        like = _TOKEN.findall(flat)
        style = like[-1] if like else "Aa"
        words = [_cased(w, style) for w in words]
        return f"{words[-1]}, {' '.join(words[:-1])}" if comma else " ".join(words)
    words, at, out = iter(new.split()), 0, []
    for m in _TOKEN.finditer(flat):
        w = next(words, "")
        out += [flat[at : m.start()], w if w.isdigit() else _cased(w, m.group())]
        at = m.end()
    return "".join(out) + flat[at:]


ENTITY = "struct<start:int,end:int,kind:string,value:string>"


def tagged(messages: DataFrame) -> DataFrame:
    """``seq, content, entities``: the values found in each text, with their places and canonical forms."""
    import pyarrow as pa

    shape = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([[{"start": a, "end": b, "kind": k, "value": canonical(k, t[a:b])} for a, b, k in spans(t)] if t else [] for t in texts.to_pylist()], shape)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return messages.select("seq", "content", F.arrow_udf(run, f"array<{ENTITY}>")("content").alias("entities"))


def _drawn(values: DataFrame, key: bytes) -> DataFrame:
    import pyarrow as pa

    def run(kinds: pa.Array, canon: pa.Array, attempts: pa.Array) -> pa.Array:
        return pa.array([draw(k, v, n, key) for k, v, n in zip(kinds.to_pylist(), canon.to_pylist(), attempts.to_pylist())], pa.string())

    run.__annotations__ = {"kinds": pa.Array, "canon": pa.Array, "attempts": pa.Array, "return": pa.Array}
    return values.withColumn("surrogate", F.arrow_udf(run, StringType())("kind", "value", "attempt"))


def assign(values: DataFrame, key: bytes = KEY, rounds: int = 64) -> DataFrame:
    """``kind, value, surrogate``, one to one: of the values that draw the same surrogate the lowest keeps it, if no value
    of an earlier round has it and it is no value of the corpus; the others draw again. Each round is a written table."""
    values = materialise(values.select("kind", "value").distinct(), "values")
    pending, done = values.withColumn("attempt", F.lit(0)), None
    real = values.select("kind", F.col("value").alias("surrogate"))
    for _ in range(rounds):
        drawn = materialise(_drawn(pending, key), "drawn")
        first = drawn.groupBy("kind", "surrogate").agg(F.min("value").alias("value")).join(real, ["kind", "surrogate"], "left_anti")
        if done is not None:
            first = first.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = materialise(first.select("kind", "value", "surrogate"), "won")
        done = won if done is None else done.unionByName(won)
        before, pending = pending, materialise(drawn.join(won, ["kind", "value"], "left_anti").select("kind", "value", (F.col("attempt") + 1).alias("attempt")), "pending")
        discard(drawn)
        discard(before)
        if pending.isEmpty():
            return done
    raise RuntimeError("values are left without a surrogate; raise the number of rounds")


def placements(found: DataFrame, key: bytes = KEY) -> DataFrame:
    """``seq, start, end, kind, surrogate`` of every value in ``tagged`` rows. A value that fills a third of all places is
    joined in parts."""
    name = F.md5(F.concat_ws("\x1f", "kind", "value"))
    places = materialise(found.select("seq", F.explode("entities").alias("e")).select("seq", "e.*").withColumn("name", name), "places")
    given = assign(places, key).select(name.alias("name"), "surrogate")
    return skew_join(places, given, "name").select("seq", "start", "end", "kind", "surrogate")


def found(messages: DataFrame, key: bytes = KEY) -> DataFrame:
    """``seq, kind`` of the values in ``content`` that were given a surrogate, each once."""
    return placements(tagged(messages).select("seq", "entities"), key).select("seq", "kind").distinct()


def replaced(messages: DataFrame, key: bytes = KEY) -> DataFrame:
    """``seq, content``: all messages, values replaced by their surrogates. Texts without values are not shuffled; null
    stays null."""
    import pyarrow as pa

    rows = materialise(tagged(messages), "tagged")
    some = rows.filter(F.size("entities") > 0)
    pieces = placements(some, key).groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind", "surrogate"))).alias("ps"))

    def run(texts: pa.Array, pieces: pa.Array) -> pa.Array:
        out = []
        for t, ps in zip(texts.to_pylist(), pieces.to_pylist()):
            parts, last = [], 0
            for p in ps or ():
                parts += [t[last : p["start"]], rewrite(p["kind"], t[p["start"] : p["end"]], p["surrogate"])]
                last = p["end"]
            out.append("".join(parts) + t[last:])
        return pa.array(out, pa.string())

    run.__annotations__ = {"texts": pa.Array, "pieces": pa.Array, "return": pa.Array}
    new = some.join(pieces, "seq").select("seq", F.arrow_udf(run, StringType())("content", "ps").alias("content"))
    return rows.filter(F.size("entities") == 0).select("seq", "content").unionByName(new)
