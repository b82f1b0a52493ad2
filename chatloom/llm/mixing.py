"""Problem 8: mixing sources to target shares by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chatloom.runtime import materialise, parts

from .bpe import TOKENIZERS
from .encode import count_column


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``doc_id, source, tokens`` of every document with a source, written once.

    Documents without tokens (null and empty texts) add nothing to a mixture and are left out.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), count_column(F.col(text_col), tokenizer, folder).alias("tokens"))
    return materialise(rows.filter("source is not null and tokens > 0"), "sizes")


def plan(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row for each target source: size, wanted tokens, and the expected copies of each of its documents.

    ``total_tokens`` None takes the largest total at which every source that has documents can hold its share within
    its ``max_repeat``; shares are of the sources that have documents. A larger total lets some sources stop at their
    cap, which the report shows.
    """
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    t = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeat").alias("max_repeat"))
    rows = t.join(have, "source", "left").withColumns({"tokens": F.coalesce("tokens", F.lit(0)), "docs": F.coalesce("docs", F.lit(0))})
    usable = (F.col("tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeat") > 0)
    rows = rows.withColumn("share", F.when(usable, F.col("target_share")))
    # over the target sources only: as many rows as mix_targets has
    everything = Window.partitionBy(F.lit(0))
    rows = rows.withColumn("share", F.col("share") / F.sum("share").over(everything))
    reach = F.min(F.col("max_repeat") * F.col("tokens") / F.col("share")).over(everything)
    total = F.lit(float(total_tokens)) if total_tokens is not None else reach
    rows = rows.withColumn("wanted", F.coalesce(F.col("share") * total, F.lit(0.0)))
    return rows.withColumn("expected", F.least(F.col("max_repeat").cast("double"), F.coalesce(F.col("wanted") / F.nullif(F.col("tokens"), F.lit(0)), F.lit(0.0))))


def running_sum(df: DataFrame, group: str, order: list, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over all earlier rows of the group and the row itself, in ``order``, for groups of any size.

    Rows are range-partitioned by group and order, summed within each partition, and shifted by the sums of the
    partitions before. Only one number for each partition and group goes to a single task.
    """
    ranged = df.repartitionByRange(parts(df.sparkSession), group, *order).withColumn("_part", F.spark_partition_id())
    ranged = materialise(ranged, "ranged")
    sums = ranged.groupBy("_part", group).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select("_part", group, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_shift"))
    within = Window.partitionBy("_part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.withColumn(out, F.sum(value).over(within)).join(F.broadcast(shift), ["_part", group]).withColumn(out, F.col(out) + F.col("_shift")).drop("_part", "_shift")


#: Expected copies are counted in units of 1/UNIT, as whole numbers, so that sums do not depend on their order.
UNIT = 1_000_000_000


def mixture(sizes: DataFrame, planned: DataFrame, seed: int = 17) -> DataFrame:
    """``doc_id, source, tokens, copies`` of the documents in the mixture.

    Within its source each document adds its expected copies to a running sum that begins at one random offset, and is
    emitted once for each whole number the sum crosses: copies are the expected number rounded up or down, so none
    exceeds ``max_repeat``, and those of a source add up to the expected total within one. Documents are taken in order
    of their size, ties by a keyed hash, which keeps the tokens of the sample close to their share as well.
    """
    unit = F.round(F.col("expected") * UNIT).cast("long")
    chosen = planned.filter("expected > 0").select("source", unit.alias("_each"))
    rows = sizes.join(F.broadcast(chosen), "source").withColumn("_tie", F.xxhash64("doc_id", F.lit(seed)))
    rows = running_sum(rows, "source", ["tokens", "_tie", "doc_id"], "_each", "_upto")
    start = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(UNIT))
    upto = F.col("_upto") + start
    # whole numbers throughout: sums of up to 9e9 expected copies of a source fit
    whole = F.expr(f"_from div {UNIT}L"), F.expr(f"(_from - _each) div {UNIT}L")
    rows = rows.withColumn("_from", upto)
    copies = whole[0] - whole[1]
    return rows.select("doc_id", "source", "tokens", copies.cast("int").alias("copies")).filter("copies > 0")


def shares(mixed: DataFrame, planned: DataFrame) -> DataFrame:
    """Target and actual share of each target source, with what was used of it; sources without documents reach 0."""
    used = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("most_copies"), F.count(F.lit(1)).alias("used_docs"))
    total = F.sum(F.coalesce("used_tokens", F.lit(0))).over(Window.partitionBy(F.lit(0)))
    return planned.join(used, "source", "left").select(
        "source", "target_share", "max_repeat", "docs", "tokens",
        F.coalesce("used_docs", F.lit(0)).alias("used_docs"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"),
        F.coalesce(F.round(F.coalesce("used_tokens", F.lit(0)) / F.nullif(total, F.lit(0)), 6), F.lit(0.0)).alias("actual_share"),
    )
