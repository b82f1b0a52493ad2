"""Problem 5: copies by brute force, over one filter and over many."""

import random
import re
from datetime import datetime, timedelta

import pytest

from chatloom.llm.exact import BITS_PER_ROW, _repeats, collapse, copies

SCHEMA = "seq bigint, sender string, content string, timestamp timestamp, message_type string, copies string"


def rows_of(n=3000):
    rng = random.Random(2)
    base = datetime(2024, 1, 1)
    rows = [(i, "Ann", f"text {i} of all", base, "text", "x") for i in range(n)]
    for i in range(n, n + 300):
        j = rng.randrange(n)
        rows.append((i, "ANN ", f"Text, {j}   of—all!", base + timedelta(microseconds=5), rng.choice(["share", "text", None]), None))
    rows += [(n + 300, None, None, None, None, None), (n + 301, "", "", None, "text", None), (n + 302, "", "  ", base, "text", None)]
    rows += [(n + 400 + i, "b", c, base, t, None) for i, (c, t) in enumerate([("one\ntwo", "share"), ("two\none\n\n", "share"), ("one two", "text"), ("TWO one", None), ("two\nthree\none", "share")])]
    return rows + [(n + 500 + i, "hot", "same", base, "text", None) for i in range(1000)]


def groups_by_hand(rows):
    clean = lambda s: re.sub(r"[\W_]", "", (s or "").lower())
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for seq, who, text, at, kind, _ in rows:
        head = (clean(who), at and at.replace(microsecond=0))
        keys = [("p", *head, clean(text))]
        if kind == "share":
            keys.append(("l", *head, tuple(sorted(filter(None, map(clean, text.splitlines()))))))
        for k in keys:
            parent[root(k)] = root(("row", seq))
    out = {}
    for r in rows:
        out.setdefault(root(("row", r[0])), []).append(r[0])
    return sorted(out.values())


@pytest.mark.parametrize("most", [1 << 28, 1 << 15])
def test_copies(spark, most):
    rows = rows_of()
    wanted = groups_by_hand(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(8).drop("copies")
    got = {(r.seq, r.lowest, r.copies) for r in copies(df, most=most).collect()}
    assert got == {(s, min(g), len(g)) for g in wanted if len(g) > 1 for s in g}
    kept = collapse(df, most=most)
    assert {(r.seq, r.copies) for r in kept.collect()} == {(min(g), len(g)) for g in wanted}
    assert copies(df.limit(0), most=most).count() == 0 and collapse(df.limit(0)).count() == 0


def test_few_others_pass_the_filter(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA).repartition(16)
    true = sum(len(g) for g in groups_by_hand(rows) if len(g) > 1)
    for most in (1 << 28, len(rows) * BITS_PER_ROW // 12):
        assert true <= _repeats(df, "seq", most)[0].count() <= true + 0.02 * len(rows)
