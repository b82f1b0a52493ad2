"""Problem 2: pairs and groups by brute force; large classes of copies; recall."""

import random

from pyspark.sql import functions as F

from chatloom.llm.near import alike_pairs, band_keys, candidates, crowded, groups

SCHEMA = "seq bigint, content string, raw_ocr_text string, message_type string"


def texts(n=120, seed=6):
    rng = random.Random(seed)
    bases = ["".join(rng.choice("abcdefghijkl") for _ in range(160)) for _ in range(12)]
    out = []
    for i in range(n):
        t = rng.choice(bases)
        for _ in range(rng.randrange(10)):
            k = rng.randrange(len(t))
            t = t[:k] + rng.choice(["", "z", "qq"]) + t[k + rng.randrange(3) :]
        out.append(t)
    return out


def brute(rows):
    import re

    grams = {}
    for seq, content, raw, *_ in rows:
        t = re.sub(r"[\W_]", "", ((content or "").strip() and content or raw or "").lower())
        if len(t) >= 100:
            grams[seq] = {t[k : k + 5] for k in range(len(t) - 4)}
    return {(a, b) for a in grams for b in grams if a < b and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.6}, set(grams)


def rows_of():
    rows = [(i, t if i % 3 else "  ", t.upper() + "!", "text") for i, t in enumerate(texts())]
    rows += [(200 + i, rows[1][1], None, "text") for i in range(4)]
    return rows + [(300, None, None, None), (301, "short", "", "text"), (302, "", "", "x")]


def test_pairs_and_groups(spark):
    rows = rows_of()
    wanted, compared = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.seq_a, r.seq_b) for r in alike_pairs(df).collect()}
    assert got <= wanted and len(got) >= 0.99 * len(wanted)
    parent = {x: x for x in compared}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in sorted(got):
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    links = {x: sum(x in p for p in got) for x in compared}
    assert {(r.seq, r.group, r.links) for r in groups(df).collect()} == {(x, root(x), links[x]) for x in compared}
    assert alike_pairs(df.limit(0)).count() == 0 and groups(df.limit(0)).count() == 0


def test_large_classes_stand_as_their_first(spark):
    base = texts(1)[0]
    other = base[:80] + "zz" + base[82:]
    third = base[:40] + "qq" + base[42:]
    rows = [(i, base, None, "t") for i in range(6)] + [(10 + i, other, None, "t") for i in range(7)] + [(30, third, None, "t")]
    wanted, _ = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert {(r.seq_a, r.seq_b) for r in alike_pairs(df, expand=100).collect()} == wanted
    got = {(r.seq_a, r.seq_b) for r in alike_pairs(df, expand=5).collect()}
    star = {(0, i) for i in range(1, 6)} | {(10, 10 + i) for i in range(1, 7)}
    assert got == star | {(0, 10)} | {(i, 30) for i in [*range(6), *range(10, 17)]}
    assert {(r.seq, r.links) for r in groups(df).collect()} == {(r[0], 13) for r in rows}
    assert df.select(F.col("seq")).count() == 14


def test_unlike_texts_that_share_runs_are_no_candidates(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghijkl") for _ in range(n))
    common = word(70)
    texts = [common + word(130) for _ in range(600)]
    texts += [texts[i][:150] + "zz" + texts[i][152:] for i in range(60)]
    reps = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "rep bigint, text string")
    got = {(r.a, r.b) for r in candidates(band_keys(reps), 0.6).collect()}
    alike = {(i, 600 + i) for i in range(60)}
    assert alike <= got and len(got - alike) < 20


def test_blocks_of_a_crowded_key_lose_no_pair(spark):
    rng = random.Random(4)
    base = texts(1)[0]
    rows = [(i, base[: (k := rng.randrange(10, 150))] + "z" * rng.randrange(1, 4) + base[k + 1 :]) for i in range(90)]
    reps = spark.createDataFrame(rows, "rep bigint, text string")
    hot = crowded(reps, block=20, one_in=1)
    assert hot.count() > 10
    whole, cut = ({(r.a, r.b) for r in candidates(band_keys(reps), 0.6, h).collect()} for h in (None, hot))
    assert cut == whole and len(whole) > 3900
