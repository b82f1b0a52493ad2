"""Problem 3: texts that look the same become equal, others stay."""

import pytest

from chatloom.llm.unify import LOOK_ALIKE, changed, unify

CASES = {
    "ｆｕｌｌ　１２": "full 12", "été": "été", "a​b⁠c﻿": "abc", "a b c": "a b c", "pаypаl": "paypal", "ﬁne": "fine", "⽇本": "日本",
    "x\U000e0020y": "xy", "a︎b": "ab", "字\U000e0100": "字", "a b": "a\nb", "a b\x85c": "a\nb\nc", "be\x07ll": "bell", "pօssword": "password".replace("a", "o"), "Ꭺpple": "Apple", "ɡood": "good",
    "А4size": "A4size", "ạ́": "ạ́", "한": "한", "Д1tаble": "Д1table",
}
SAME = ["été", "，。：！（）", "Москва", "Κόσμος", "👨‍👩‍👧", "❤️", "🏴\U000e0067\U000e0062\U000e007f", "tab\tline\nend\r\n", "", None, "naïve 日本語 12", "Зебра"]


def test_table():
    assert len(LOOK_ALIKE) > 90 and all(v.isascii() and not k.isascii() for k, v in LOOK_ALIKE.items())


def test_cases(spark):
    texts = [*CASES, *SAME]
    df = spark.createDataFrame([(i, t, t, "kept") for i, t in enumerate(texts)], "seq bigint, content string, sender string, field string")
    got = {(r.seq, r.field): r.unified for r in changed(df).collect()}
    assert got == {(i, f): CASES[t] for i, t in enumerate(texts) if t in CASES for f in ("content", "sender")}
    out = {r.seq: r for r in unify(df).collect()}
    assert [out[i].content for i in range(len(texts))] == [CASES.get(t, t) for t in texts] == [out[i].sender for i in range(len(texts))]
    assert unify(df.limit(0)).count() == 0 and changed(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [30000])
def test_long_text(spark, n):
    df = spark.createDataFrame([(1, "а" + "b" * 150 + " " + "x " * n + "ｚ", None)], "seq bigint, content string, sender string")
    assert unify(df).first().content == "a" + "b" * 150 + " " + "x " * n + "z"
