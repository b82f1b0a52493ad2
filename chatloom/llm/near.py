"""Problem 2: near-duplicate records by ProbMinHash, banding and exact verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from chatloom.runtime import blank, discard, group_lowest, materialise, skew_join

from .exact import letters_digits

WIDTH, LEAST_CHARS, THRESHOLD = 5, 100, 0.6
#: 40 bands of 5 registers: two texts with similarity 0.65 share a band with a probability of 0.993, 0.8 of 0.99999.
BANDS, ROWS = 40, 5
#: Texts of a bucket that are paired within one group; larger buckets are cut into blocks, and all pairs of blocks taken.
BLOCK = 4096
#: Registers of which one bit goes with each band key, to tell unlike texts of a bucket apart without their texts.
SKETCH = 192
#: Classes of exact copies up to this size are written out pair by pair, larger ones as links to their first member.
EXPAND = 100


def message_text(content: Column, raw: Column) -> Column:
    """The text of a message: content, or the recognised text where content is null or blank; letters and digits only,
    in lower case. Null where both are null or blank."""
    return letters_digits(F.when(~blank(content), content).otherwise(raw))


def classes(texts: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Of ``seq, key, text``: all rows ``seq, digest``, and the first row of each class of copies ``rep, key, text, size``."""
    rows = materialise(texts.withColumn("digest", F.unhex(F.md5(F.concat_ws("\x1f", "key", "text")))), name)
    first = rows.groupBy("digest").agg(F.min("seq").alias("rep"), F.count(F.lit(1)).alias("size"))
    # joined on seq, which no hot class can crowd
    reps = first.drop("digest").join(rows.select(F.col("seq").alias("rep"), "key", "text"), "rep")
    return rows.select("seq", "digest"), materialise(reps, f"{name}-reps")


def band_keys(reps: DataFrame, ident: str = "rep", width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``ident, runs, key, bits``: a row for each band of each text; ``runs`` is the number of its distinct shingles, and
    ``bits`` one bit of each of its first ``SKETCH`` registers, or of all of fewer."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        from .signatures import fold, probminhash, shingles

        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                texts = [t or "" for t in part.column(1).to_pylist()]
                owner, element, _ = shingles(texts, width)
                winners = probminhash(owner, element, None, len(texts), bands * rows)
                sizes = np.bincount(owner, minlength=len(texts)).astype("int32")
                some = sizes > 0
                keys = fold(winners[some], rows).view("int64")
                sketch = np.packbits((winners[some, :SKETCH] & np.uint64(1)).astype(bool), axis=1)
                ids = part.column(0).to_numpy()[some]
                bits = pa.FixedSizeBinaryArray.from_buffers(pa.binary(sketch.shape[1]), len(ids) * bands, [None, pa.py_buffer(np.repeat(sketch, bands, axis=0))])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, bands)), pa.array(np.repeat(sizes[some], bands)), pa.array(keys.ravel()), bits.cast(pa.binary())], names=[ident, "runs", "key", "bits"])

    return reps.select(ident, "text").mapInArrow(run, f"{ident} bigint, runs int, key bigint, bits binary")


def crowded(reps: DataFrame, block: int = BLOCK, one_in: int = 64) -> DataFrame:
    """``key, _blocks``: the band keys that about more than ``block`` texts share, judged by one text in ``one_in``. Which
    keys are listed decides only how the work is divided, never which pairs are found."""
    some = band_keys(reps.filter(F.pmod(F.xxhash64("rep"), F.lit(one_in)) == 0))
    sizes = some.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") * one_in > block)
    return materialise(sizes.select("key", F.ceil(F.col("_n") * one_in / block).cast("int").alias("_blocks")), "crowded")


def candidates(keyed: DataFrame, least: float, hot: DataFrame | None = None) -> DataFrame:
    """``a, b`` (a < b), distinct: texts that share a band key, whose sizes allow the similarity ``least``, and whose bits
    don't rule it out (``signatures.agreeing``).

    Unrelated texts that share some runs meet in a band now and then, and their number grows with the square of the
    texts, so they are told apart here, where a pair costs nanoseconds, and neither shuffled nor compared. Texts of a key
    lie side by side in a sorted partition. A key in ``hot`` is cut into blocks by a hash, and each pair of its blocks is
    a group of its own, so that no group grows with the data and no pair is lost.
    """
    import pyarrow as pa

    def run(batches):
        from .signatures import meetings

        for a, b in meetings(batches, least):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    rows = keyed.select(F.col("key").alias("g"), "rep", "runs", F.lit(0).alias("side"), "bits")
    if hot is not None and not hot.isEmpty():
        rows = keyed.join(F.broadcast(hot), "key", "left").withColumn("_i", F.pmod(F.xxhash64("rep"), F.coalesce("_blocks", F.lit(1))).cast("int"))
        rows = rows.withColumn("_j", F.explode(F.sequence(F.lit(0), F.coalesce("_blocks", F.lit(1)) - 1)))
        group = F.when(F.col("_blocks").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("_i", "_j"), F.greatest("_i", "_j")))
        rows = rows.select(group.alias("g"), "rep", "runs", F.signum(F.col("_i") - F.col("_j")).cast("int").alias("side"), "bits")
    near = rows.repartition("g").sortWithinPartitions("g", "rep")
    return near.mapInArrow(run, "a bigint, b bigint").distinct()


def similarity(a: Column, b: Column, width: int = WIDTH) -> Column:
    import pyarrow as pa

    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        from .signatures import jaccard

        # rows come in the order of the right side, whose shingles are kept from one to the next
        return pa.array(jaccard(zip(right.to_pylist(), left.to_pylist()), width), pa.float64())

    run.__annotations__ = {"left": pa.Array, "right": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, DoubleType())(a, b)


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame, least: float, width: int = WIDTH, same: tuple[str, str] | None = None) -> DataFrame:
    """The pairs ``a, b`` whose texts are alike, exactly, with ``similarity``; ``same`` names columns that must be equal.

    left: ``a, left_text``; right: ``b, right_text``."""
    both = pairs.join(left, "a").join(right, "b")
    if same:
        both = both.filter(F.col(same[0]) == F.col(same[1]))
    scored = both.select("a", "b", similarity(F.col("left_text"), F.col("right_text"), width).alias("similarity"))
    return scored.filter(F.col("similarity") >= least)


def texts_of(messages: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``seq, key, text`` of the messages long enough to compare; shorter, null and blank ones belong to no group."""
    rows = messages.select("seq", F.lit("").alias("key"), message_text(F.col("content"), F.col("raw_ocr_text")).alias("text"))
    return rows.filter(F.length("text") >= least_chars)


def links(messages: DataFrame, least: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows ``seq, digest``, first rows ``rep, size``, and links ``a, b, similarity`` between first rows."""
    members, reps = classes(texts_of(messages), "texts")
    pairs = candidates(band_keys(reps), least, crowded(reps))
    found = verified(pairs, reps.select(F.col("rep").alias("a"), F.col("text").alias("left_text")), reps.select(F.col("rep").alias("b"), F.col("text").alias("right_text")), least)
    return members, reps.drop("text", "key"), materialise(found, "links")


def alike_pairs(messages: DataFrame, least: float = THRESHOLD, expand: int = EXPAND) -> DataFrame:
    """``seq_a, seq_b`` of all pairs of messages that are alike.

    Copies of one text are linked with each other, and links between different texts hold for all their copies. A class
    of more than ``expand`` copies stands, for links among its own copies and with other such classes, as its first row,
    and its copies as links to that row; no link between different texts is lost by this.
    """
    members, reps, found = links(messages, least)
    copied = materialise(group_lowest(members, ["digest"], "seq", "rep", "size").select("rep", "size", "seq"), "copies")
    large = F.col("size") > expand
    star = copied.filter(large & (F.col("seq") != F.col("rep"))).select(F.col("rep").alias("seq_a"), F.col("seq").alias("seq_b"))
    small = copied.filter(~large).select("rep", "seq")
    inside = small.alias("x").join(small.alias("y"), F.expr("x.rep = y.rep and x.seq < y.seq")).select(F.col("x.seq").alias("seq_a"), F.col("y.seq").alias("seq_b"))
    crowd = reps.filter(large).select("rep")
    sides = found.select("a", "b").join(crowd.select(F.col("rep").alias("a"), F.lit(True).alias("la")), "a", "left").join(crowd.select(F.col("rep").alias("b"), F.lit(True).alias("lb")), "b", "left")
    sides = sides.withColumn("both", F.coalesce(F.col("la") & F.col("lb"), F.lit(False)))
    one, two = (copied.select(F.col("rep").alias(k), F.col("seq").alias(f"s{k}")) for k in "ab")
    across = sides.filter("not both").join(one, "a", "left").join(two, "b", "left").select(F.coalesce("sa", "a").alias("x"), F.coalesce("sb", "b").alias("y"))
    across = across.unionByName(sides.filter("both").select(F.col("a").alias("x"), F.col("b").alias("y")))
    return across.select(F.least("x", "y").alias("seq_a"), F.greatest("x", "y").alias("seq_b")).unionByName(inside).unionByName(star)


def groups(messages: DataFrame, least: float = THRESHOLD, rounds: int = 50) -> DataFrame:
    """``seq, group, links``: every compared message with the lowest ``seq`` it is connected with (alone, its own), and
    the number of messages it is alike with.

    Labels spread along links until none changes; each round also jumps to the label of the label, so the rounds grow
    with the logarithm of the longest chain. Each round is a written table, of which the last two are kept.
    """
    members, reps, found = links(messages, least)
    edges = materialise(found.select("a", "b").union(found.select("b", "a")), "edges")
    labels = materialise(edges.select(F.col("a").alias("v")).distinct().withColumn("g", F.col("v")), "labels")
    for _ in range(rounds):
        near = skew_join(edges, labels.select(F.col("v").alias("b"), "g"), "b").groupBy(F.col("a").alias("v")).agg(F.min("g").alias("m"))
        low = materialise(labels.join(near, "v").select("v", F.least("g", "m").alias("g2"), "g"), "low")
        jump = skew_join(low, low.select(F.col("v").alias("g2"), F.col("g2").alias("far")), "g2", "left")
        new = materialise(jump.select("v", F.least("g2", F.coalesce("far", "g2")).alias("g"), F.col("g").alias("old")), "labels")
        changed = new.filter("g <> old").limit(1).count()
        discard(low)
        discard(labels)
        labels = new
        if not changed:
            break
    else:
        raise RuntimeError("labels still change; raise the number of rounds")
    copied = group_lowest(members, ["digest"], "seq", "rep", "size").select("seq", F.col("rep").alias("first"))
    rows = materialise(members.join(copied, "seq", "left").select("seq", F.coalesce("first", "seq").alias("rep")), "rows")
    degree = edges.join(reps.select(F.col("rep").alias("b"), "size"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("size").alias("others"))
    known = reps.join(degree, "rep", "left").join(labels.select(F.col("v").alias("rep"), "g"), "rep", "left")
    known = known.select("rep", F.coalesce("g", "rep").alias("group"), (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    return skew_join(rows, known, "rep").select("seq", "group", "links")
