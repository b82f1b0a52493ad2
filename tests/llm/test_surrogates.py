"""Problem 1: surrogates keep type, format, script and gender; one value has one surrogate, and no two share one."""

import re

import pytest

from chatloom.llm import surrogates as S
from chatloom.llm.personal import spans

SAME = {
    "phone": ["16183263893", "１６１ ８３２６ ３８９３", "+86 16183263893", "161-8326-3893"],
    "id_number": ["191322195301255364", "191322 19530125 5364"],
    "email": ["lena.w@example.com", "lena dot w (at) example dot com", "LENA.W@EXAMPLE.COM"],
    "name": ["Barnaby Harrowgate", "Harrowgate, Barnaby", "BARNABY HARROWGATE"],
    "address": ["96 Coopers Street", "96 coopers street"],
}


@pytest.mark.parametrize("kind", SAME)
def test_one_form(kind):
    assert len({S.canonical(kind, v) for v in SAME[kind]}) == 1


@pytest.mark.parametrize("kind, mention", [(k, v) for k, vs in SAME.items() for v in vs] + [("name", "臧星野"), ("name", "欧阳婷"), ("address", "望江州东篱区三棱路121号拾光小区15栋922室"), ("id_number", "QQ 82 87 25 B"), ("phone", "(555) 555-0115")])
def test_format_stays(kind, mention):
    value = S.canonical(kind, mention)
    new = S.draw(kind, value, 0)
    out = S.rewrite(kind, mention, new)
    assert new != value and S.canonical(kind, out) == new
    if kind in ("phone", "id_number"):
        assert re.sub(r"\w", "x", out) == re.sub(r"\w", "x", mention)
    if kind in ("email", "name", "address"):
        assert mention.isupper() == out.isupper() and ("," in mention) == ("," in out)


def test_traits():
    assert S.gender("name", "欧阳婷") == "f" and S.gender("name", S.draw("name", "欧阳婷", 0)) == "f" and len(S.draw("name", "欧阳婷", 0)) == 3
    assert S.gender("name", "greta holm") == "f" and S.gender("name", S.draw("name", "greta holm", 0)) == "f"
    drawn = S.draw("id_number", "191322195301255364", 0)
    assert S._check_digit(drawn[:17]) == drawn[17] and S._check_digit("11010519491231002") == "X"
    assert S.draw("phone", "16183263893", 0) != S.draw("phone", "16183263893", 0, b"other") and S.draw("phone", "16183263893", 0) != S.draw("phone", "16183263893", 1)


def test_texts(spark):
    rows = [(1, "我的号码１６１８３２６３８９３。谢谢"), (2, "call +86 161 8326 3893 or mail lena.w@example.com"), (3, "plain"), (4, None), (5, ""), (6, "身份证号191322195301255364，收件人屠素商。")]
    df = spark.createDataFrame(rows, "seq bigint, content string")
    assert {(r.seq, r.kind) for r in S.found(df).collect()} == {(1, "phone"), (2, "phone"), (2, "email"), (6, "id_number"), (6, "name")}
    out = {r.seq: r.content for r in S.replaced(df).collect()}
    assert (out[3], out[4], out[5]) == ("plain", None, "") and out[1].startswith("我的号码") and out[1].endswith("。谢谢")
    phone = [S.canonical("phone", out[n][a:b]) for n in (1, 2) for a, b, k in spans(out[n]) if k == "phone"]
    assert phone[0] == phone[1] != "16183263893" and "lena" not in out[2]
    assert S.found(df.limit(0)).count() == 0 and S.replaced(df.limit(0)).count() == 0


def test_no_two_values_share_one(spark):
    names = [f"{a} {b}" for a in ("greta", "clara", "flora") for b in (f"holm{i}" for i in range(400))]
    values = [("name", n) for n in names] + [("name", S.draw("name", names[0], 0)), ("phone", "123")] + [("phone", f"123{i}") for i in range(10)]
    got = S.assign(spark.createDataFrame(values + values, "kind string, value string")).collect()
    assert {(r.kind, r.value) for r in got} == set(values) and len(got) == len(set(values))
    assert len({(r.kind, r.surrogate) for r in got}) == len(got)
    # ten numbers that fill their format get longer ones
    assert not {(r.kind, r.surrogate) for r in got if r.kind == "name"} & set(values)
