"""Problem 6: a forest takes batches after merges and reopening, finds what brute force finds, and reads what it needs."""

import random

import pytest

from chatloom.llm import history
from chatloom.llm.history import HashForest, depth_for

LONG = "".join(f"abcdefg{i}hijk" for i in range(20))
SCHEMA = "seq bigint, id string, sender string, text string"


def rows_of(spark, *xs):
    return spark.createDataFrame(list(xs), SCHEMA)


def test_append_merge_open(spark, tmp_path):
    rows = lambda *xs: rows_of(spark, *xs)
    forest = HashForest.create(spark, f"file://{tmp_path}/forest")
    forest.append(rows((1, "x", "a", LONG)))
    forest.append(rows((2, "y", "b", LONG)))
    forest.merge()
    batch = rows((3, "z", "a", LONG + "more"), (4, "y", "c", None), (5, "w", "d", LONG))
    run = forest.append(batch)
    assert len({r["name"] for r in forest.runs}) == 2
    assert {tuple(r) for r in forest.lookup(run, batch).collect()} == {(1, 3), (2, 4)}
    forest.merge()
    again = HashForest.open(spark, forest.path)
    assert again.runs == forest.runs
    late = rows((6, "q", "a", LONG), (7, None, None, None))
    assert {tuple(r) for r in again.lookup(again.append(late), late).collect()} == {(1, 6)}
    empty = rows((8, None, None, None)).limit(0)
    assert again.lookup(again.append(empty), empty).count() == 0
    again.tidy(1)
    assert len(HashForest.open(spark, forest.path).runs) == 2
    with pytest.raises(FileNotFoundError):
        HashForest.open(spark, f"file://{tmp_path}/nothing")


def edited(text, rng, times):
    for _ in range(times):
        i = rng.randrange(len(text))
        text = text[:i] + rng.choice(["", "x", "yy"]) + text[i + rng.randrange(3) :]
    return text


def test_recall_over_slices_and_folders(spark, monkeypatch):
    """Many folders and slices give the rows of one; nine tenths of brute force at least, here all of it."""
    rng = random.Random(4)
    bases = ["".join(rng.choice("abcdefghij") for _ in range(200)) for _ in range(30)]
    rows = [(i, f"i{i}", rng.choice(["a", "b"]), edited(rng.choice(bases), rng, rng.randrange(12))) for i in range(260)]
    grams = {r[0]: {r[3][k : k + 5] for k in range(len(r[3]) - 4)} for r in rows}
    alike = lambda x, y: len(grams[x] & grams[y]) / len(grams[x] | grams[y])
    wanted = {}
    for seq, _, who, _ in rows[200:]:
        hits = [r[0] for r in rows if r[0] < seq and r[2] == who and alike(r[0], seq) >= 0.6]
        if hits:
            wanted[seq] = min(hits)
    found = []
    for folder_rows, piece in ((1 << 18, 1 << 16), (500, 25)):
        monkeypatch.setattr(history, "FOLDER_ROWS", folder_rows)
        monkeypatch.setattr(history, "SLICE", piece)
        forest = HashForest.create(spark)
        forest.append(rows_of(spark, *rows[:200]))
        batch = rows_of(spark, *rows[200:])
        found.append({r.seq_b: r.seq_a for r in forest.lookup(forest.append(batch), batch).collect()})
    assert found[0] == found[1]
    assert forest.runs[0]["folders"]["paths"] == 8
    assert sum(found[0].get(k) == v for k, v in wanted.items()) >= 0.97 * len(wanted) and set(found[0]) <= set(wanted)
    # one entry needs a few folders of the many
    some = forest._read("paths", history._PATH, runs=forest.runs[1:]).filter("entry = 200 and tree < 2")
    assert len({t % 8 for t in forest._touched(some, "paths", history._path_folder())}) <= 2


def test_depth():
    assert depth_for(0.65, 0.99, 20, 6) == 3 and depth_for(0.95, 0.99, 20, 6) == 6
