"""Problem 4: furniture, split words and misread characters of a page."""

import pytest

from chatloom.llm.counts import Counts, of_texts
from chatloom.llm.scanned import in_one_line, noise, readable, train

CLEAN = ["The borrowed wardrobe was weighed after lunch.", "The wooden basket got soaked on the balcony.", "The wardrobe and the basket were hidden in the wooden shed.", "今天在天台上的衣柜还在晾。", "昨天在雨棚下的篮子找到了。"]
PAGE = "— Coopers Library Rules —\nThe borrowed wardr0be was wei-\nghed after lunch, and then the\n[7]\nwooden basket got soaked on the\nbalcony and the wardrobe was\nhidden in the shed."


@pytest.fixture(scope="module")
def editor():
    return train(CLEAN * 60 + [PAGE] * 2)


def test_furniture(editor):
    lines, kinds, page = editor.furniture(PAGE)
    assert page
    assert kinds == {"header", "page_number"}
    assert len(lines) == 5


def test_all_kinds(editor):
    assert noise(PAGE, editor) == {"hyphen", "misread", "header", "page_number"}


def test_readable(editor):
    assert readable(PAGE, editor) == "The borrowed wardrobe was weighed after lunch, and then the wooden basket got soaked on the balcony and the wardrobe was hidden in the shed."


def test_bare_numbers_of_a_chat_stay(editor):
    assert noise("0873\n12\nok", editor) == set()
    assert readable("0873\n12\nok", editor) == "0873\n12\nok"


def test_han_characters(editor):
    assert noise("昨夭在雨棚下的篮子找到了。", editor) == {"misread"}
    assert noise("昨天在雨棚下的篮子找到了。", editor) == set()


def test_counts():
    counts = of_texts([in_one_line("a wei-\nghed w0rd, a weighed w0rd"), "昨天\n今天", "昨天今天 w0rd"])
    assert (counts.word("weighed"), counts.word("w0rd"), counts.word("a"), counts.word("ghed"), counts.word("none")) == (2, 3, 2, 0, 0)
    assert counts.run("昨天今") == 0 and of_texts(["昨天今天"] * 3).run("昨天今") == 3 and counts.run("昨") == 0


def test_counts_and_queries_on_tables(spark):
    from chatloom.llm.scanned import noises, paragraphs

    rows = [(i, None, t) for i, t in enumerate(CLEAN * 60)] + [(900, PAGE, None), (901, None, None), (902, "", ""), (903, PAGE, PAGE)]
    df = spark.createDataFrame(rows, "seq bigint, raw_ocr_text string, content string").repartition(3)
    assert {(r.seq, r.noise) for r in noises(df).collect() if r.seq >= 900} == {(s, k) for s in (900, 903) for k in ("hyphen", "misread", "header", "page_number")}
    out = {r.seq: r.text for r in paragraphs(df).collect()}
    assert out[901] is None and out[902] == "" and out[900] == out[903] and out[900].startswith("The borrowed wardrobe was weighed after lunch") and len(out) == len(rows)


def test_misreadings_of_a_large_corpus():
    # each misreading stands 200 times in 16 million words: as rare among them as twice in 160 000
    wrong = "昨夭在雨棚下的篮子找到了。"
    counts = of_texts([in_one_line(t) for t in CLEAN * 6000 + [PAGE, wrong] * 2])
    large = Counts(*(tuple(t.astype("uint32") * 100 for t in tables) for tables in (counts.words, counts.runs)))
    assert large.word("wardr0be") == 200
    editor = train(CLEAN * 60 + [PAGE] * 2, large)
    assert noise(PAGE, editor) == {"hyphen", "misread", "header", "page_number"}
    assert noise(wrong, editor) == {"misread"}
    assert all(noise(t, editor) == set() for t in CLEAN)


def test_counts_of_partitions_are_added_whole(spark):
    from chatloom.llm.counts import of_corpus

    df = spark.createDataFrame([("wooden 昨天今天",)] * 1200, "text string").repartition(3)
    counts = of_corpus(df, in_one_line)
    assert (counts.word("wooden"), counts.run("昨天今")) == (1200, 1200)
