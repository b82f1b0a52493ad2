"""Problem 5: duplicates hidden by formatting, found through merged Bloom filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.runtime import group_lowest, materialise, parts, scratch_path

#: Bits of a block, bits for each hash, and the most bits of one filter (2**28 are 32 MB). More hashes than one filter
#: takes are cut into shards by hash, each with a filter of its own, so that the bits for each hash stay the same.
BLOCK_BITS = 2048
BITS_PER_ROW, FILTER_BITS, PROBES = 16, 1 << 28, 3


def letters_digits(text: Column) -> Column:
    """Lower case without anything but letters and digits; null as empty."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def canonical(content: Column, sender: Column, timestamp: Column, message_type: Column) -> tuple[Column, Column]:
    """What two records share that differ only in form: a string for all, and one for shares (null for others).

    Both hold the sender without case, white space and punctuation, and the time to the second. The first adds the
    content in the same form, the second its lines so, in sorted order, blank ones left out. Records are copies if either
    is equal. Null counts as empty text; a null time equals only a null time.
    """
    share = F.lower(F.coalesce(message_type, F.lit(""))) == "share"
    lines = F.filter(F.transform(F.split(F.coalesce(content, F.lit("")), r"\R"), letters_digits), lambda x: x != "")
    second = F.coalesce(F.date_format(timestamp, "yyyy-MM-dd HH:mm:ss"), F.lit("-"))
    who = letters_digits(sender)
    plain = F.concat_ws("\x1f", who, second, letters_digits(content))
    return plain, F.when(share & (F.size(lines) > 1), F.concat_ws("\x1f", F.lit("s"), who, second, F.array_join(F.array_sort(lines), "\n")))


def _shape(hashes: int, most: int = FILTER_BITS) -> tuple[int, int]:
    """Number of shards, and of blocks in each one's filter."""
    shards = max(1, -(-hashes * BITS_PER_ROW // most))
    return shards, max(1, -(-hashes * BITS_PER_ROW // (shards * BLOCK_BITS)))


def _address(h: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block of a hash, and its bits within the block."""
    return F.pmod(F.shiftrightunsigned(h, 20), F.lit(blocks)).cast("int"), [F.pmod(F.xxhash64(h, F.lit(i)), F.lit(BLOCK_BITS)).cast("short") for i in range(PROBES)]


def _shard(h: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(h, F.lit(-1)), F.lit(shards)).cast("int")


def repeat_filter(hashes: DataFrame, blocks: int) -> DataFrame:
    """``block, bits``: a Bloom filter, in blocks, of the hashes ``h`` seen at least twice.

    Every partition fills one filter of hashes seen and one of those seen again, both of fixed size, and sends the blocks
    it touched, as places of bits or packed, whichever is shorter. Merging keeps a bit as repeated if one side had it so,
    or if both sides have seen it.
    """
    import numpy as np
    import pyarrow as pa

    size = BLOCK_BITS // 8

    def sent(bits: np.ndarray) -> bytes:
        places = np.flatnonzero(np.unpackbits(bits, bitorder="little"))
        return places.astype("<u2").tobytes() if 2 * len(places) < size else bits.tobytes()

    def received(raw: bytes) -> np.ndarray:
        if len(raw) == size:
            return np.frombuffer(raw, np.uint8)
        out = np.zeros(BLOCK_BITS, np.uint8)
        out[np.frombuffer(raw, "<u2")] = 1
        return np.packbits(out, bitorder="little")

    def fill(batches):
        once, more = np.zeros((blocks, size), np.uint8), np.zeros((blocks, size), np.uint8)
        for batch in batches:
            h, first, count = np.unique(batch.column(0).to_numpy(), return_index=True, return_counts=True)
            block = batch.column(1).to_numpy()[first]
            bits = np.stack([batch.column(2 + i).to_numpy()[first] for i in range(PROBES)])
            byte, mask = bits >> 3, (1 << (bits & 7)).astype(np.uint8)
            again = ((once[block, byte] & mask) != 0).all(axis=0) | (count > 1)
            blocks_of = np.broadcast_to(block, byte.shape)
            np.bitwise_or.at(once, (blocks_of, byte), mask)
            np.bitwise_or.at(more, (blocks_of[:, again], byte[:, again]), mask[:, again])
        touched = np.flatnonzero(once.any(axis=1))
        for start in range(0, len(touched), 10_000):
            some = touched[start : start + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([sent(once[b]) for b in some], pa.binary()), pa.array([sent(more[b]) for b in some], pa.binary())], names=["block", "once", "more"])

    def merge(batches):
        once: dict[int, np.ndarray] = {}
        more: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, o, m in zip(*(batch.column(i).to_pylist() for i in range(3))):
                o, m = received(o), received(m)
                if b in once:
                    m = more[b] | m | (once[b] & o)
                    o = once[b] | o
                once[b], more[b] = o, m
        keys = [b for b in more if more[b].any()]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([more[b].tobytes() for b in keys], pa.binary())], names=["block", "bits"])

    block, bits = _address(F.col("h"), blocks)
    cols = hashes.select("h", block.alias("_b"), *[b.alias(f"_p{i}") for i, b in enumerate(bits)])
    local = cols.mapInArrow(fill, "block int, once binary, more binary")
    return local.repartition(parts(hashes.sparkSession), "block").mapInArrow(merge, "block int, bits binary")


def held(h: Column, blocks: int, bits: Column) -> Column:
    """Whether a block's bits hold a hash; null where there is no block or hash."""
    places = _address(h, blocks)[1]

    def bit(p: Column) -> Column:
        byte = F.ascii(F.decode(F.substring(bits, F.shiftright(p.cast("int"), 3) + 1, F.lit(1)), "ISO-8859-1"))
        return byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (p.cast("int") % 8) + 1)) != 0

    test = bit(places[0])
    for p in places[1:]:
        test = test & bit(p)
    return test


def with_filter(rows: DataFrame, column: str, filtered: DataFrame, blocks: int, name: str) -> DataFrame:
    """The rows with ``name``, whether the filter may hold their hash; false without one. No shuffle: the filter is
    broadcast, of ``FILTER_BITS`` at most."""
    found = F.broadcast(filtered.select(F.col("block").alias("_b"), F.col("bits").alias("_bits")))
    rows = rows.withColumn("_b", _address(F.col(column), blocks)[0]).join(found, "_b", "left")
    return rows.withColumn(name, F.coalesce(held(F.col(column), blocks, F.col("_bits")), F.lit(False))).drop("_b", "_bits")


def digests(messages: DataFrame, seq: str = "seq") -> DataFrame:
    """The messages with ``digest, lines`` of their canonical forms and hashes ``h, hl`` of these."""
    plain, lines = canonical(F.col("content"), F.col("sender"), F.col("timestamp"), F.col("message_type"))
    rows = messages.withColumns({"digest": F.unhex(F.sha2(plain, 256)), "lines": F.unhex(F.sha2(lines, 256))})
    return rows.withColumns({"h": F.xxhash64("digest"), "hl": F.when(F.col("lines").isNotNull(), F.xxhash64("lines"))})


def _one_form(found: DataFrame) -> DataFrame:
    """Rows ``seq, digest``: shares that differ in the order of their lines get the lowest digest they are linked with.

    Only digests that share their lines with another one take part. Labels go from digests to lines and back until none
    changes; each round is a written table.
    """
    pairs = found.filter("lines is not null").select("digest", "lines").distinct()
    several = pairs.groupBy("lines").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("lines")
    links = materialise(pairs.join(several, "lines", "left_semi"), "links")
    if links.isEmpty():
        return found.select("seq", "digest")
    labels = materialise(links.groupBy("digest").agg(F.min("digest").alias("label")), "labels")
    while True:
        low = links.join(labels, "digest").groupBy("lines").agg(F.min("label").alias("low"))
        new = links.join(low, "lines").groupBy("digest").agg(F.min("low").alias("low"))
        new = materialise(labels.join(new, "digest").select("digest", F.least("label", "low").alias("label"), (F.col("low") < F.col("label")).alias("less")), "labels")
        labels = new.select("digest", "label")
        if not new.filter("less").limit(1).count():
            break
    # a label for each digest, of which copies have one; a hot one is split at run time
    return found.join(labels, "digest", "left").select("seq", F.coalesce("label", "digest").alias("digest"))


def _repeats(messages: DataFrame, seq: str, most: int = FILTER_BITS) -> tuple[DataFrame, DataFrame | None, int]:
    """Possible repeats as a table ``seq, digest, lines``, and the filter and its blocks if one took all hashes."""
    rows = digests(messages, seq).select(F.col(seq).alias("seq"), "digest", "lines", "h", "hl")
    both = lambda df: df.select(F.explode(F.array_compact(F.array("h", "hl"))).alias("h"))
    rows = materialise(rows, "digests")
    shards, blocks = _shape(rows.select((F.count("h") + F.count("hl")).alias("n")).first()[0], most)

    if shards == 1:
        filtered = materialise(repeat_filter(both(rows), blocks), "filter")
        some = with_filter(with_filter(rows, "h", filtered, blocks, "_p"), "hl", filtered, blocks, "_l").filter("_p or _l")
        return materialise(some.select("seq", "digest", "lines"), "repeats"), filtered, blocks
    found = None
    hashed = both(rows).withColumn("shard", _shard(F.col("h"), shards))
    path = scratch_path(rows.sparkSession, "shards")
    hashed.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    for s in range(shards):
        mine = rows.sparkSession.read.schema("h bigint").parquet(f"{path}/shard={s}")
        filtered = materialise(repeat_filter(mine, blocks), "filter")
        for column in ("h", "hl"):
            part = rows.filter(F.col(column).isNotNull() & (_shard(F.col(column), shards) == s))
            part = materialise(with_filter(part, column, filtered, blocks, "_p").filter("_p").select("seq", "digest", "lines"), "repeats")
            found = part if found is None else found.unionByName(part)
    return materialise(found.distinct(), "repeats"), None, blocks


def copies(messages: DataFrame, seq: str = "seq", most: int = FILTER_BITS) -> DataFrame:
    """``seq, lowest, copies`` of each row that has copies, ``lowest`` being the first of its group.

    Only possible repeats are shuffled, by a digest of the whole canonical form; every other record stands alone. Groups
    are joined through ``group_lowest``, so one that holds a third of all rows is spread like any other.
    """
    found, _, _ = _repeats(messages, seq, most)
    return _grouped(found)


def _grouped(found: DataFrame) -> DataFrame:
    return group_lowest(materialise(_one_form(found), "forms"), ["digest"], "seq", "lowest", "copies").select("seq", "lowest", "copies")


def collapse(messages: DataFrame, seq: str = "seq", most: int = FILTER_BITS) -> DataFrame:
    """One record for each group of copies, its first, with the number of copies (1 for a record without others).

    Rows that the filter does not hold go straight out. The others are joined with their groups; where the hashes took
    several filters, all rows are, by ``seq``.
    """
    found, filtered, blocks = _repeats(messages, seq, most)
    groups = materialise(_grouped(found), "groups").withColumnRenamed("seq", seq)
    columns = messages.columns
    if filtered is None:
        rows = messages.join(groups, seq, "left")
        alone = None
    else:
        hashed = digests(messages, seq)
        tested = with_filter(with_filter(hashed, "h", filtered, blocks, "_p"), "hl", filtered, blocks, "_l")
        alone = tested.filter("not (_p or _l)").select(*columns, F.lit(1).cast("bigint").alias("copies"))
        rows = tested.filter("_p or _l").select(*columns).join(groups, seq, "left")
    kept = rows.filter(f"lowest is null or lowest = `{seq}`").select(*columns, F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies"))
    return kept if alone is None else alone.unionByName(kept)
