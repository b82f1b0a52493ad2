"""Problem 9: subjects of texts from a few labelled ones."""

import pytest

from chatloom.llm.subjects import LEAST_SHARE, sentences, shares, train

TALK = ["The kettle was swapped by the pond.", "The ladder is waiting in the hall.", "今天在街角的雨伞找到了。"]
FOOD = ["The others simmered the dumpling soup.", "The others chopped herbs for the soup.", "大家教我做红烧茄子。"]
LAW = ["The others appealed against the verdict.", "The others cited the contract in court.", "大家就判决书提出异议。"]
TITLES = {"food": ["Food", "美食"], "law": ["Law", "法律"]}


@pytest.fixture(scope="module")
def fitted():
    docs = [(" ".join(FOOD + TALK), {"food"}), (" ".join(LAW + TALK), {"law"}), (" ".join(TALK), {"none"})]
    return train(docs * 5, TITLES)


def found(text, fitted):
    vocabulary, weights, specific, names = fitted
    return {n for n, x in zip(names, shares([text], vocabulary, weights, specific, len(names))[0]) if x >= LEAST_SHARE}


def test_none_one_and_several(fitted):
    assert found(" ".join(TALK), fitted) == set()
    assert found(FOOD[0] + " " + TALK[0], fitted) == {"food"}
    assert found(FOOD[1] + " " + LAW[0] + " " + TALK[1], fitted) == {"food", "law"}
    assert found(LAW[2] + TALK[2], fitted) == {"law"}


def test_a_passing_remark_is_no_subject(fitted):
    assert found(" ".join(TALK[:2] * 5 + FOOD[:1]), fitted) == set()


def test_null_and_empty(fitted):
    assert found(None, fitted) == found("", fitted) == set()


def test_speakers_and_line_breaks_are_no_sentences():
    assert sentences("[10:17] 一口锅: 新来的到最后记\n录变化！\n> Echo 17:43\nThey were cl-\neaned up.") == ["新来的到最后记录变化", "They were cleaned up"]
