"""Problem 6: new batches against all accepted history, by a persisted prefix-tree hash forest."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from math import ceil, log2

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.runtime import discard, materialise, parts, scratch_path

from .exact import letters_digits
from .near import LEAST_CHARS, THRESHOLD, WIDTH, message_text, verified

#: Trees and their depth; a level is two bytes of a signature permutation, behind four bytes of a hash of the sender.
TREES, DEPTH, LEVEL, LEAD = 20, 6, 2, 4
#: Similarity above which the recall target holds.
AT, RECALL = 0.65, 0.99
#: Rows of a folder of a run, about; most folders of a run; entries of a batch whose ranges are broadcast at once, which
#: bounds them to about 40 MB; runs up to which none are merged.
FOLDER_ROWS, FOLDERS, SLICE, RUNS = 1 << 18, 1 << 12, 1 << 16, 16
#: Entries, and ids, that are broadcast at once to fetch theirs from the history: 16 MB each, about.
FETCHED, FETCHED_IDS = 1 << 20, 1 << 18
_ENTRY = "entry bigint, sender string, text string"
_PATH = "tree int, path binary, entry bigint, size int"


def depth_for(at: float = AT, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """Levels of prefix to compare: from the full depth ranges are widened, one level at a time, until a pair of
    similarity ``at`` shares the prefix of some tree with the probability ``recall``. As the lowest of all repeated rows
    is wanted, no entry may stop before that level, however many it has found."""
    while depth > 1 and 1 - (1 - at**depth) ** trees < recall:
        depth -= 1
    return depth


def entries(messages: DataFrame) -> DataFrame:
    """``seq, id, sender, text`` for the search: sender in canonical form (null stays null), text null if too short."""
    known = F.col("sender").isNotNull()
    rows = messages.select(
        "seq",
        F.when(F.trim("id") != "", F.col("id")).alias("id"),
        F.when(known, letters_digits(F.col("sender"))).alias("sender"),
        # a raw text that is too short stays so
        F.when(known & (F.greatest(F.length("content"), F.length("raw_ocr_text")) >= LEAST_CHARS), message_text(F.col("content"), F.col("raw_ocr_text"))).alias("text"),
    )
    return rows.withColumn("text", F.when(F.length("text") >= LEAST_CHARS, F.col("text")))


def _held(rows: DataFrame, keys: DataFrame, column: str, most: int) -> DataFrame:
    """The rows whose ``column`` is among ``keys`` (distinct, of that one column), which are broadcast ``most`` at a time;
    the rows are read once for each time, and only those held are ever shuffled."""
    slices = max(1, ceil(keys.count() / most))
    out = None
    for s in range(slices):
        some = keys.filter(F.pmod(F.xxhash64(column, F.lit(5)), F.lit(slices)) == s) if slices > 1 else keys
        part = rows.join(F.broadcast(some), column, "left_semi")
        out = part if out is None else out.unionByName(part)
    return out


def _paths(rows: DataFrame, trees: int, depth: int) -> DataFrame:
    """``tree, path, entry, size``: the entry's signature permutation for each tree, led by a hash of its sender, as bytes
    whose order is the order of the tree's leaves, and its number of shingles."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        from .signatures import mix, probminhash, shingles

        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                texts = part.column(2).to_pylist()
                owner, element, _ = shingles(texts, WIDTH)
                sig = mix(probminhash(owner, element, None, len(texts), trees * depth)).astype(np.uint16).astype(">u2")
                lead = part.column(1).to_numpy().astype(">i4")
                raw = np.empty((len(texts), trees, LEAD + LEVEL * depth), np.uint8)
                raw[:, :, :LEAD] = lead.view(np.uint8).reshape(-1, 1, LEAD)
                raw[:, :, LEAD:] = sig.reshape(len(texts), trees, depth).view(np.uint8).reshape(len(texts), trees, LEVEL * depth)
                offsets = np.arange(0, raw.size + 1, raw.shape[2], dtype=np.int32)
                paths = pa.Array.from_buffers(pa.binary(), len(texts) * trees, [None, pa.py_buffer(offsets), pa.py_buffer(raw.tobytes())])
                sizes = np.bincount(owner, minlength=len(texts)).astype("int32")
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(trees, dtype=np.int32), len(texts))), paths, pa.array(np.repeat(part.column(0).to_numpy(), trees)), pa.array(np.repeat(sizes, trees))], names=["tree", "path", "entry", "size"])

    return rows.select("entry", F.hash("sender").alias("lead"), "text").mapInArrow(run, _PATH)


def _folder(*keys: str):
    """Number of the folder of a row among ``FOLDERS``; a run with fewer takes it modulo its own number."""
    return F.pmod(F.xxhash64(*keys), F.lit(FOLDERS)).cast("int")


def _path_folder():
    return F.pmod(F.xxhash64("tree", F.substring("path", 1, LEAD + LEVEL)), F.lit(FOLDERS)).cast("int")


def _located(paths: DataFrame, ranges, width: int, least: float) -> DataFrame:
    """``a, b``: for each of the batch's ranges, the earlier entries of the sorted paths that lie in it and whose sizes
    allow the similarity. ``ranges``: broadcast keys (tree and prefix, sorted), entries and sizes."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        keys, mine, sizes = ranges.value
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.empty((batch.num_rows, 1 + width), np.uint8)
            raw[:, 0] = batch.column(0).to_numpy()
            data = batch.column(1)
            full = np.frombuffer(data.buffers()[2], np.uint8)[np.frombuffer(data.buffers()[1], np.int32)[data.offset] :]
            raw[:, 1:] = full[: batch.num_rows * (len(data[0].as_py()))].reshape(batch.num_rows, -1)[:, :width]
            found = raw.view(f"S{1 + width}").ravel()
            # a batch of rows may hold the end of one file and the start of another, each sorted
            order = np.argsort(found, kind="stable")
            found, other, other_size = found[order], batch.column(2).to_numpy()[order], batch.column(3).to_numpy()[order]
            low, high = np.searchsorted(keys, found[0], "left"), np.searchsorted(keys, found[-1], "right")
            left, right = np.searchsorted(found, keys[low:high], "left"), np.searchsorted(found, keys[low:high], "right")
            hit = np.flatnonzero(right > left)
            total, begin = np.cumsum(right[hit] - left[hit]), 0
            while begin < len(hit):  # a crowded prefix comes out in parts
                end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + 500_000, "right")))
                some = hit[begin:end]
                count = right[some] - left[some]
                place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(left[some], count)
                a, n = np.repeat(mine[low:high][some], count), np.repeat(sizes[low:high][some], count)
                b, m = other[place], other_size[place]
                good = (b < a) & (np.minimum(n, m) >= least * np.maximum(n, m))
                if good.any():
                    yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], names=["a", "b"])
                begin = end

    return paths.mapInArrow(run, "a bigint, b bigint")


@dataclass
class HashForest:
    """Runs of sorted signatures, with the entries and ids they stand for, in a folder all executors share.

    A run holds ``tree, path, entry, size`` in folders by the first level of the path, sorted within; ``entry, sender,
    text`` once for each different text of a sender, ``entry`` being its lowest ``seq``; and ``id, lowest``, both
    in folders by a hash. The numbers of folders follow the run's size, so that what a batch reads depends on the batch.
    Adding a batch writes a new run and leaves the others as they are; ``merge`` makes one run of several, reading
    signatures but no text anew. A manifest lists the runs; ``open`` reads it.
    """

    spark: SparkSession
    path: str
    trees: int = TREES
    depth: int = DEPTH
    runs: list[dict] = field(default_factory=list)
    made: int = 0  # runs and manifests written so far; goes on over merges, so that no name is used twice

    @classmethod
    def create(cls, spark: SparkSession, path: str | None = None, **kw) -> HashForest:
        return cls(spark, path or scratch_path(spark, "forest"), **kw)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> HashForest:
        """The forest that was last written to a folder."""
        forest = cls(spark, path)
        names = [n for n in forest._names(path) if n.startswith("manifest-")]
        if not names:
            raise FileNotFoundError(f"no forest in {path}")
        found = json.loads(spark.read.text(f"{path}/{max(names)}", wholetext=True).first()[0])
        forest.trees, forest.depth, forest.runs, forest.made = found["trees"], found["depth"], found["runs"], found["made"]
        return forest

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        p, fs = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _next(self, kind: str) -> str:
        self.made += 1
        return f"{self.path}/{kind}-{self.made - 1:08d}"

    def _save(self) -> None:
        """A manifest of its own for each change; the one with the highest number holds."""
        p, fs = self._fs(self._next("manifest"))
        out = fs.create(p, False)
        out.write(bytearray(json.dumps({"trees": self.trees, "depth": self.depth, "runs": self.runs, "made": self.made}).encode()))
        out.close()

    @staticmethod
    def _folders(rows: int) -> int:
        return min(FOLDERS, 1 << ceil(log2(max(1.0, rows / FOLDER_ROWS))))

    def _write(self, df: DataFrame, path: str, folders: int, number, *order: str) -> None:
        rows = df.withColumn("folder", F.pmod(number, F.lit(folders)))
        if order and folders == 1:
            # few rows: sorted files of whole trees, without a look at the rows beforehand
            rows = rows.repartition(min(8, parts(self.spark)), order[0]).sortWithinPartitions(*order)
        elif order:
            rows = rows.repartitionByRange(parts(self.spark), "folder", *order).sortWithinPartitions("folder", *order)
        elif folders > 1:
            rows = rows.repartition(parts(self.spark), "folder", F.pmod(F.monotonically_increasing_id(), F.lit(8)))
        rows.write.partitionBy("folder").option("compression", "zstd").parquet(path)

    def append(self, rows: DataFrame) -> dict:
        """Take in the accepted ``rows`` of ``entries`` as a new run."""
        run = self._next("run")
        digest = F.unhex(F.md5(F.concat_ws("\x1f", "sender", "text")))
        long = materialise(rows.filter("text is not null").select("seq", "sender", "text", digest.alias("digest")), "long")
        first = long.groupBy("digest").agg(F.min("seq").alias("seq"))
        stored = materialise(long.join(first.select("seq"), "seq").select(F.col("seq").alias("entry"), "sender", "text"), "stored")
        made = {"name": run, "entries": stored.count()}
        made["folders"] = {"entries": self._folders(made["entries"]), "paths": self._folders(made["entries"] * self.trees)}
        paths = _paths(stored, self.trees, self.depth)
        if made["folders"]["paths"] > 1:  # a range partitioning reads its rows twice
            paths = materialise(paths, "paths")
        self._write(paths, f"{run}/paths", made["folders"]["paths"], _path_folder(), "tree", "path")
        self._write(stored, f"{run}/entries", made["folders"]["entries"], _folder("entry"))
        ids = materialise(rows.filter("id is not null").groupBy("id").agg(F.min("seq").alias("lowest")), "ids")
        made["folders"]["ids"] = self._folders(ids.count())
        self._write(ids, f"{run}/ids", made["folders"]["ids"], _folder("id"))
        for step in (long, stored, paths, ids):
            discard(step)
        self.runs.append(made)
        self._save()
        return made

    def _read(self, what: str, schema: str, touched: set[int] | None = None, runs: list[dict] | None = None) -> DataFrame:
        """Rows of the runs, from the folders with the given numbers; of all folders without them."""
        some = []
        for run in self.runs if runs is None else runs:
            count = run["folders"][what]
            mine = None if touched is None else {t % count for t in touched}
            base = f"{run['name']}/{what}"
            some += [f"{base}/{n}" for n in self._names(base) if n.startswith("folder=") and (mine is None or int(n[7:]) in mine)]
        return self.spark.read.schema(schema).parquet(*some) if some else self.spark.createDataFrame([], schema)

    def _touched(self, df: DataFrame, what: str, number) -> set[int] | None:
        """Numbers of the folders that rows of a batch need; None for all, where no run has many."""
        if all(r["folders"][what] == 1 for r in self.runs):
            return None
        return {r[0] for r in df.select(number).distinct().collect()}

    def merge(self, runs: list[dict] | None = None) -> dict:
        """One run of several, or of all; entries with equal text of a sender stay side by side, which changes no result."""
        old = self.runs if runs is None else runs
        run = self._next("run")
        made = {"name": run, "entries": sum(r["entries"] for r in old)}
        made["folders"] = {"entries": self._folders(made["entries"]), "paths": self._folders(made["entries"] * self.trees)}
        self._write(self._read("paths", _PATH, runs=old), f"{run}/paths", made["folders"]["paths"], _path_folder(), "tree", "path")
        self._write(self._read("entries", _ENTRY, runs=old), f"{run}/entries", made["folders"]["entries"], _folder("entry"))
        ids = materialise(self._read("ids", "id string, lowest bigint", runs=old).groupBy("id").agg(F.min("lowest").alias("lowest")), "ids")
        made["folders"]["ids"] = self._folders(ids.count())
        self._write(ids, f"{run}/ids", made["folders"]["ids"], _folder("id"))
        self.runs = [r for r in self.runs if r not in old] + [made]
        self._save()
        return made

    def tidy(self, most: int = RUNS) -> None:
        """Merge the smaller half of the runs where there are more than ``most``."""
        if len(self.runs) > most:
            self.merge(sorted(self.runs, key=lambda r: r["entries"])[: max(2, len(self.runs) // 2)])

    def locate(self, run: dict, least: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
        """``a, b``, distinct: entries of a run and the earlier entries, of all runs, in the ranges of their prefixes.

        The ranges of ``SLICE`` entries at a time are sorted and broadcast; each sorted piece of the history is searched
        for where they begin and end, and nothing of the history is shuffled.
        """
        width = LEAD + LEVEL * depth_for(AT, recall, self.trees, self.depth)
        mine = self._read("paths", _PATH, runs=[run])
        slices = max(1, ceil(run["entries"] / SLICE))
        found = None
        for s in range(slices):
            some = mine.filter(F.pmod(F.xxhash64("entry", F.lit(3)), F.lit(slices)) == s) if slices > 1 else mine
            key = F.concat(F.unhex(F.lpad(F.hex(F.col("tree").cast("bigint")), 2, "0")), F.substring("path", 1, width))
            table = some.select(key.alias("k"), F.col("entry"), F.col("size")).toArrow()
            ranges = self._sorted(table, width)
            pairs = _located(self._read("paths", _PATH, self._touched(some, "paths", _path_folder())), self.spark.sparkContext.broadcast(ranges), width, least)
            pairs = materialise(pairs.distinct(), "located")
            found = pairs if found is None else found.unionByName(pairs)
        return found

    @staticmethod
    def _sorted(table, width: int):
        import numpy as np

        keys = np.frombuffer(b"".join(table.column(0).to_pylist()), f"S{1 + width}")
        order = np.argsort(keys, kind="stable")
        return keys[order], table.column(1).to_numpy()[order], table.column(2).to_numpy()[order]

    def lookup(self, run: dict, rows: DataFrame, least: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
        """``seq_a, seq_b``: each of the batch's ``rows`` that repeats an earlier row, with the lowest row it repeats.

        The rows must have been appended, as ``run``: their signatures are then at hand. What is located is verified
        exactly, with the texts of the located entries' folders only. The batch's different texts are looked up once,
        whatever the number of their copies.
        """
        pairs = self.locate(run, least, recall)
        mine = self._read("entries", _ENTRY, runs=[run])
        left = mine.select(F.col("entry").alias("a"), F.col("sender").alias("left_sender"), F.col("text").alias("left_text"))
        wanted = materialise(pairs.select(F.col("b").alias("entry")).distinct(), "wanted")
        right = _held(self._read("entries", _ENTRY, self._touched(wanted, "entries", _folder("entry"))), wanted, "entry", FETCHED).select(F.col("entry").alias("b"), F.col("sender").alias("right_sender"), F.col("text").alias("right_text"))
        alike = verified(pairs, left, right, least, same=("left_sender", "right_sender"))
        low = alike.groupBy("a").agg(F.min("b").alias("low"))
        digest = F.md5(F.concat_ws("\x1f", "sender", "text"))
        firsts = mine.select(F.col("entry").alias("a"), digest.alias("digest")).join(low, "a", "left").select("digest", F.least("a", "low").alias("text_low"))
        known = rows.filter("id is not null")
        asked = materialise(known.select("id").distinct(), "asked")
        ids = _held(self._read("ids", "id string, lowest bigint", self._touched(asked, "ids", _folder("id"))), asked, "id", FETCHED_IDS).groupBy("id").agg(F.min("lowest").alias("id_low"))
        out = rows.select("seq", "id", F.when(F.col("text").isNotNull(), digest).alias("digest")).join(firsts, "digest", "left").join(ids, "id", "left")
        return out.select(F.least("text_low", "id_low").alias("seq_a"), F.col("seq").alias("seq_b")).filter("seq_a < seq_b")


def repeats(history: DataFrame, incoming: DataFrame, path: str | None = None, batch: str = "batch_no") -> DataFrame:
    """``seq_a, seq_b`` of the rows of ``incoming`` that repeat rows of ``history`` or earlier rows of ``incoming``.

    The history is taken in once; then the batches, in the order of their number, are each taken in and looked up, as
    they would be one day after the other. Rows without a number are a batch before the first.
    """
    forest = HashForest.create(history.sparkSession, path)
    forest.append(entries(history))
    rows = materialise(incoming.select("seq", "id", "sender", "content", "raw_ocr_text", F.col(batch).alias("_batch")), "incoming")
    found = None
    for (number,) in rows.select("_batch").distinct().orderBy(F.col("_batch").asc_nulls_first()).collect():
        one = materialise(entries(rows.filter(F.col("_batch").eqNullSafe(F.lit(number)))), "batch")
        result = materialise(forest.lookup(forest.append(one), one), "repeats")
        found = result if found is None else found.unionByName(result)
        forest.tidy()
    return rows.select(F.col("seq").alias("seq_a"), F.col("seq").alias("seq_b")).limit(0) if found is None else found


def accepted(history: DataFrame, incoming: DataFrame) -> DataFrame:
    """The rows of ``incoming`` that repeat nothing."""
    return incoming.join(repeats(history, incoming).select(F.col("seq_b").alias("seq")), "seq", "left_anti")
