"""Problem 8: shares, caps and sums of a mixture, with a source that holds most documents."""

import pytest

from chatloom.llm.mixing import mixture, plan, shares, sized


@pytest.fixture(scope="module")
def tables(spark):
    docs = [(i, "word " * (1 + i % 7), "big") for i in range(3000)] + [(5000 + i, "word " * (2 + i % 3), "small") for i in range(100)] + [(9000, None, "big"), (9001, "", "small"), (9002, "word", None)]
    targets = [("big", 0.6, 1), ("small", 0.3, 4), ("none", 0.1, 2)]
    return sized(spark.createDataFrame(docs, "doc_id bigint, text string, source string")), spark.createDataFrame(targets, "source string, target_share double, max_repeat int")


def test_shares_hold(tables):
    sizes, targets = tables
    planned = plan(sizes, targets)
    mixed = mixture(sizes, planned)
    got = {r.source: r for r in shares(mixed, planned).collect()}
    assert got["big"].actual_share == pytest.approx(2 / 3, abs=0.01) and got["small"].actual_share == pytest.approx(1 / 3, abs=0.01) and got["none"].actual_share == 0
    assert got["small"].most_copies == 4 and got["big"].most_copies == 1
    assert {r.doc_id for r in mixed.collect()} == {r.doc_id for r in mixture(sizes, plan(sizes, targets)).collect()}


def test_a_large_total_stops_at_the_caps(tables):
    sizes, targets = tables
    planned = plan(sizes, targets, 10**9)
    rows = mixture(sizes, planned).collect()
    assert {(r.source, r.copies) for r in rows} == {("big", 1), ("small", 4)} and len(rows) == 3100


def test_empty(tables):
    sizes, targets = tables
    assert mixture(sizes.limit(0), plan(sizes.limit(0), targets)).count() == 0
    assert mixture(sizes, plan(sizes, targets.limit(0))).count() == 0
