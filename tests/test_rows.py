"""Operators that keep rows: against sequential programs, with small blocks, nulls, ties and empty tables."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chatloom.operators import dedup, fill, filters, merge, near, scan, stats


def test_scans_equal_windows(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i * 3, rng.choice([None, 1, 2, 5]), rng.random() < 0.6) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, n bigint, v bigint, flag boolean")
    got = scan.last_known(df, ["g"], "n", F.col("v"), "last", block=16)
    got = scan.running_sum(got, ["g"], "n", F.col("v"), "sum", block=16)
    got = scan.run_length(got, ["g"], "n", F.col("flag"), "run", block=16)
    w = Window.partitionBy("g").orderBy("n")
    want = df.withColumns({"last": F.last("v", True).over(w), "sum": F.coalesce(F.sum("v").over(w), F.lit(0))})
    assert sorted(map(repr, got.select("g", "n", "last", "sum").collect())) == sorted(map(repr, want.select("g", "n", "last", "sum").collect()))
    runs, state = {}, {}
    for g, n, _, flag in rows:
        state[g] = state.get(g, 0) + 1 if flag else 0
        runs[n] = state[g]
    assert {r.n: r.run for r in got.collect()} == runs
    stop = {}
    for g in ("a", "b", None):
        stop[g] = next((n for h, n, _, _ in rows if h == g and runs[n] == 3), 10**9)
    assert {r.n for r in scan.until_run(df, ["g"], "n", F.col("flag"), 3, 16).collect()} == {n for g, n, _, _ in rows if n <= stop[g]}
    assert scan.last_known(df.limit(0), [], "n", F.col("v"), "x").count() == 0


def test_first_wins(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), (None, 3, "c"), (None, 4, "d"), ("k", 1, "a")], "k string, seq bigint, x string")
    assert sorted(r.x for r in dedup.first_wins(df, F.col("k")).collect()) == ["a", "c"]
    assert dedup.first_wins(df.limit(0), F.col("k")).count() == 0


@pytest.mark.parametrize("rows, kept", [([("k1", "a1"), ("k2", "a1"), ("k2", "a2")], [0, 2]), ([("k1", "a1"), ("k1", "a2"), ("k2", "a2")], [0, 2]), ([], [])])
def test_two_keys_cases(spark, rows, kept):
    df = spark.createDataFrame([(i, k, a) for i, (k, a) in enumerate(rows)], "seq bigint, k string, a string")
    assert sorted(r.seq for r in dedup.two_keys(df, F.col("k"), F.col("a")).collect()) == kept


def test_two_keys_is_sequential(spark):
    rng = random.Random(5)
    rows = [(i, f"k{rng.randrange(60)}", f"a{rng.randrange(60)}") for i in range(400)]
    used, want = set(), []
    for i, k, a in rows:
        if k not in used and a not in used:
            used |= {k, a}
            want.append(i)
    df = spark.createDataFrame(rows, "seq bigint, k string, a string")
    assert sorted(r.seq for r in dedup.two_keys(df, F.col("k"), F.col("a")).collect()) == want


def test_near_hashes(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = []
    for _ in range(300):
        v = rng.choice(base)
        for _ in range(rng.randrange(6)):
            v ^= 1 << rng.randrange(64)
        values.append(v)
    values += values[:3]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([*enumerate(signed), (999, None)], "i bigint, h bigint")
    firsts = {}
    for i, v in enumerate(values):
        firsts.setdefault(v, i)
    pairs = {(min(i, j), max(i, j)) for v, i in firsts.items() for w, j in firsts.items() if i < j and (v ^ w).bit_count() <= 5}
    for bands in (None, 3, 2):
        assert {(r.a, r.b) for r in near.hamming_pairs(df, "i", "h", 5, bands).collect()} == pairs
    kept = []
    for i, v in enumerate(values):
        if all((v ^ values[j]).bit_count() > 5 for j in kept):
            kept.append(i)
    assert sorted(r.i for r in near.first_of_near(df, "i", "h", 5).collect()) == kept
    assert near.first_of_near(df.limit(0), "i", "h").count() == 0


def test_boxes(spark):
    rng = random.Random(4)
    rows = [("s", i, rng.randrange(40), rng.randrange(40), rng.randrange(1, 30), rng.randrange(1, 30)) for i in range(60)]
    df = spark.createDataFrame(rows, "shot_id string, region_seq int, x int, y int, width int, height int")

    def common(a, b):
        return max(0, min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2])) * max(0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]))

    kept = []
    for r in sorted(rows, key=lambda r: (-r[4] * r[5], r[1])):
        if all(common(r, k) / (r[4] * r[5]) <= 0.7 for k in kept):
            kept.append(r)
    assert sorted(tuple(r)[1:] for r in near.without_overlaps(df).collect()) == sorted(r[2:] for r in kept)
    one = df.withColumnRenamed("region_seq", "id")
    want = {(a[1], b[1]) for a in rows for b in rows if common(a, b) / (a[4] * a[5] + b[4] * b[5] - common(a, b)) >= 0.65}
    assert {(r.a, r.b) for r in near.iou_pairs(one, one, "shot_id").collect()} == want
    titles = spark.createDataFrame([("s", 0, "产品讨论群（3）"), ("s", 1, "产品讨论"), ("t", 0, None), ("t", 1, "xyz")], "shot_id string, region_seq int, text string")
    assert [tuple(r) for r in near.closest_title(titles, "产品讨论").collect()] == [("s", "产品讨论群（3）", 1.0)]


def test_message_filter(spark):
    rows = [(1, "Alice", "Hello Bob", "text", 0.3), (2, "Bob", "Hi Alice", "image", 0.8), (3, "Carol", "Other", "text", 0.95), (4, None, None, None, None)]
    df = spark.createDataFrame(rows, "seq int, sender string, content string, message_type string, confidence_score double").withColumn("timestamp", F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("seq")))
    seqs = lambda **kw: sorted(r.seq for r in filters.message_filter(df, **kw).collect())
    assert seqs(sender="ali", contains="hi") == [] and seqs(sender="bob") == [2]
    assert seqs(start=datetime(2024, 1, 1, 0, 0, 2), end=datetime(2024, 1, 1, 0, 0, 3), types=["text"]) == [3]
    assert seqs(min_confidence=0.8) == [2, 3] and seqs(min_confidence=0) == [1, 2, 3]
    assert seqs() == [1, 2, 3, 4] and seqs(sender="", types=[]) == [1, 2, 3, 4]
    assert filters.read_criteria("2024-01-01", "never", "text, IMAGE") == {"start": datetime(2024, 1, 1), "end": None, "types": ["text", "image"]}
    assert filters.read_criteria(types="text,poem")["types"] is None


def test_message_times(spark):
    run = datetime(2025, 12, 6, 10, 53, 39)
    rows = [("f", 1, "text", "a"), ("f", 2, "system", "昨天 10:00"), ("f", 3, "text", "b"), ("f", 4, "system", "joined"), ("f", 5, None, None), (None, 6, "text", "c")]
    df = spark.createDataFrame(rows, "src_file string, seq bigint, message_type string, content string")
    yesterday = datetime(2025, 12, 5, 10)
    got = {r.seq: r.message_time for r in fill.message_times(df, F.lit(run).cast("timestamp_ntz"), ["src_file"], block=2).collect()}
    assert got == {1: run, 2: yesterday, 3: yesterday, 4: None, 5: yesterday, 6: run}
    up = {r.seq: r.message_time for r in fill.message_times(df, F.lit(run).cast("timestamp_ntz"), ["src_file"], upwards=True, block=2).collect()}
    assert up[1] == yesterday and up[3] == run
    real = {r.seq: (r.message_type, r.real_time) for r in fill.real_times(df, F.lit(run).cast("timestamp_ntz"), ["src_file"], block=2).collect()}
    assert real[1] == ("text", "2025-12-06 10:53:39") and real[2] == ("system", "2025-12-05 10:00:00") and real[4][1] == "2025-12-05 10:00:00"


def at(day, second=0, micro=0):
    return datetime(2024, 1, day, 12, 0, second, micro)


def test_merge(spark):
    schema = "id string, sender string, content string, timestamp timestamp, seq bigint"
    rows = [
        ("m2", "A", "late", at(3), 1), ("m1", "A", "early", at(1), 2), ("m2", "B", "same id", at(1), 3),
        ("", "Bob", " Hi​  there ", at(2, 0, 5), 4), (None, "bob", "Hi there", at(2, 0, 9), 5), (None, None, None, None, 6),
        ("t", "A", "星期五 23:53", at(1), 7), ("u", "A", "昨天", at(1), 8), ("v", "A", "12", at(1), 9), ("w", "a", "late", at(4), 10),
    ]
    df = spark.createDataFrame(rows, schema)
    assert [r.seq for r in merge.merge(df, exclude_time_only=True).collect()] == [2, 9, 4, 1, 10, 6]
    assert [r.seq for r in merge.merge(df, exclude_time_only=True, aggressive=True).collect()] == [2, 9, 4, 1, 6]
    text = spark.createDataFrame([("1", "a", "x", "soon", 1), ("2", "a", "y", "2024-1-5 3:4:5", 2), ("3", "a", "z", None, 3)], "id string, sender string, content string, timestamp string, seq bigint")
    assert [r.seq for r in merge.merge(text).collect()] == [2, 3, 1]
    assert merge.merge(df.limit(0)).count() == 0


def test_summaries(spark):
    df = spark.createDataFrame([(None, s, "x", at(d), i) for i, (s, d) in enumerate([("我", 1), ("对方", 2), (None, 3), ("我", 7), ("我", 8)])], "id string, sender string, content string, timestamp timestamp, seq bigint")
    assert tuple(stats.session_summary(df).first()) == (8, 3, 3)
    assert tuple(stats.sender_counts(df).first()) == (3, 1, 5)
    assert tuple(stats.session_summary(df.limit(0)).first()) == (0, 0, 0)
    assert tuple(stats.sender_counts(df.limit(0)).first()) == (0, 0, 0)


def test_batches(spark):
    rows = [(b, b * 10 + i, k) for b, ks in enumerate(["ab", "a", "b", "", "aa", "c"]) for i, k in enumerate(ks)]
    found = stats.batches(spark.createDataFrame(rows, "file_ord int, seq bigint, k string"), F.col("k"), block=2)
    assert [(r.file_ord, r.parsed, r.new, r.misses, r.total) for r in found.orderBy("file_ord").collect()] == [(0, 2, 2, 0, 2), (1, 1, 0, 1, 2), (2, 1, 0, 2, 2), (4, 2, 0, 3, 2), (5, 1, 1, 0, 3)]
    assert sorted(r.file_ord for r in stats.batches_until(found, 3).collect()) == [0, 1, 2, 4]
    assert sorted(r.file_ord for r in stats.batches_until(found, None, 2).collect()) == [0]
