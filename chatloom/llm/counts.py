"""Counts of words and runs of characters over a whole corpus, in tables of fixed size."""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of each table, and the highest count told apart: each key adds to two cells and has the lower one's count, so that
#: a table takes 2 x 16 MB whatever the size of the corpus. Counts are never too low; with more keys than cells they grow.
CELLS, MOST = 1 << 22, 255
#: Words and runs of a corpus up to which counts are compared as they are; those of a larger one are brought down to it, but
#: the better known of two keys to ``SEEN`` times at least, so that a rare word stays known.
WORDS_AS_THEY_ARE, RUNS_AS_THEY_ARE, SEEN = 1 << 20, 1 << 21, 8
#: A word, in which signs may stand for letters.
WORDS = re.compile(r"(?:[^\W_]|[!|@$](?=[^\W\d_]))(?:[^\W_]|[!|@$](?=[^\W\d_])|['’](?=[^\W\d_]))*")
_HAN_LOW, _HAN_HIGH = 0x4E00, 0x9FFF


def _cells(key: str) -> tuple[int, int]:
    raw = key.encode("utf-8", "surrogatepass")
    one = crc32(raw)
    return one % CELLS, crc32(raw, one ^ 0x5BD1E995) % CELLS


def _run_cells(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of runs of three characters, given as code points."""
    h = (a.astype(np.uint64) << np.uint64(42)) | (b.astype(np.uint64) << np.uint64(21)) | c.astype(np.uint64)
    out = []
    for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        x = h * np.uint64(odd)
        out.append(((x ^ (x >> np.uint64(29))) * np.uint64(odd) >> np.uint64(40)).astype(np.int64) % CELLS)
    return out[0], out[1]


class Counts:
    """Looks counts up; what was asked for lately is kept."""

    def __init__(self, words: tuple[np.ndarray, np.ndarray], runs: tuple[np.ndarray, np.ndarray]):
        self.words, self.runs = words, runs
        #: how many times the corpus is larger than one whose counts are compared as they are
        self.word_scale = max(1.0, float(words[0].sum(dtype=np.int64)) / WORDS_AS_THEY_ARE)
        self.run_scale = max(1.0, float(runs[0].sum(dtype=np.int64)) / RUNS_AS_THEY_ARE)
        self._seen: dict[str, int] = {}

    def word(self, w: str) -> int:
        """How often a word, in lower case, is in the corpus; a single time counts as none."""
        n = self._seen.get(w)
        if n is None:
            if len(self._seen) > 200_000:
                self._seen.clear()
            i, j = _cells(w)
            n = self._seen[w] = min(int(self.words[0][i]), int(self.words[1][j]))
        return n if n > 1 else 0

    def run(self, r: str) -> int:
        """How often three characters with a Han one among the first two are in the corpus."""
        n = self._seen.get(r)
        if n is None:
            if len(self._seen) > 200_000:
                self._seen.clear()
            if len(r) < 3:
                n = 0
            else:
                i, j = _run_cells(*(np.array([ord(c)]) for c in r))
                n = min(int(self.runs[0][i[0]]), int(self.runs[1][j[0]]))
            self._seen[r] = n
        return n if n > 1 else 0


def leveled(scale: float, *counts: int) -> list[int]:
    """Counts of keys to compare, as they would be in a corpus ``scale`` times smaller, or in one less small in which the
    best known of them is still found ``SEEN`` times. Misreadings become as common as the corpus is large, so that what
    tells them apart is how common a word is beside another one."""
    by = min(scale, max(1.0, max(counts) / SEEN))
    return [n if n > 1 else 0 for n in (min(int(n / by), MOST) for n in counts)]


def _add(texts: list[str], words: list[np.ndarray], runs: list[np.ndarray]) -> None:
    seen = Counter()
    for t in texts:
        seen.update(w for w in WORDS.findall(t.lower()) if w.isascii())
    for w, n in seen.items():
        for table, cell in zip(words, _cells(w)):
            table[cell] += n
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) < 3:
        return
    han = (codes >= _HAN_LOW) & (codes <= _HAN_HIGH)
    at = np.flatnonzero((han[:-2] | han[1:-1]) & (codes[:-2] != 10) & (codes[1:-1] != 10) & (codes[2:] != 10))
    for table, cells in zip(runs, _run_cells(codes[at], codes[at + 1], codes[at + 2])):
        table += np.bincount(cells, minlength=CELLS).astype(np.uint32)


def of_texts(texts: list[str]) -> Counts:
    """Counts of a few texts."""
    words, runs = ([np.zeros(CELLS, np.uint32) for _ in range(2)] for _ in range(2))
    _add(texts, words, runs)
    return Counts(tuple(words), tuple(runs))


def of_corpus(texts: DataFrame, prepare) -> Counts:
    """Counts of all texts (the one column), each brought into one line by ``prepare`` first. Each partition fills tables
    of its own and sends the cells it touched; the sums come to the driver, a number of fixed size for each cell."""
    import pyarrow as pa

    def fill(batches):
        tables = [np.zeros(CELLS, np.uint32) for _ in range(4)]
        for batch in batches:
            _add([prepare(t) for t in batch.column(0).to_pylist() if t], tables[:2], tables[2:])
        for k, table in enumerate(tables):
            cells = np.flatnonzero(table)
            for start in range(0, len(cells), 100_000):
                some = cells[start : start + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(some + k * CELLS, pa.int32()), pa.array(table[some], pa.int64())], names=["cell", "n"])

    sums = texts.mapInArrow(fill, "cell int, n bigint").groupBy("cell").agg(F.least(F.sum("n"), F.lit((1 << 31) - 1)).cast("int").alias("n")).toArrow()
    flat = np.zeros(4 * CELLS, np.uint32)
    flat[sums.column(0).to_numpy()] = sums.column(1).to_numpy()
    parts = flat.reshape(4, CELLS)
    return Counts((parts[0], parts[1]), (parts[2], parts[3]))
