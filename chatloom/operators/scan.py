"""Running values over ordered rows, split into blocks so that no group is one task.

The order is a whole number that rises within the group, as ``seq`` does. Rows are cut into blocks of ``block`` numbers;
a first pass reduces each block to one row, a window over those carries values from block to block, and the rows
themselves are only windowed within their block. A group may be null, and ``group`` may be empty for the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 1 << 17


def _cut(df: DataFrame, group: list[str], order: str, block: int) -> DataFrame:
    # a struct is never null, so that null groups join too
    keys = F.struct(*[F.col(g).alias(f"g{i}") for i, g in enumerate(group)]) if group else F.struct(F.lit(0).alias("g0"))
    return df.withColumns({"_g": keys, "_b": F.floor(F.col(order) / F.lit(block)).cast("bigint")})


def _within(order: str):
    return Window.partitionBy("_g", "_b").orderBy(order)


def _before():
    return Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)


def last_known(df: DataFrame, group: list[str], order: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """The rows with ``name``: the latest ``value`` that is not null, of the row itself or one before it; null if none is."""
    rows = _cut(df.withColumn("_v", value), group, order, block)
    tails = rows.groupBy("_g", "_b").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(order))).alias("_tail"))
    carried = tails.select("_g", "_b", F.last("_tail", True).over(_before()).alias("_carry"))
    out = rows.join(carried, ["_g", "_b"])
    return out.withColumn(name, F.coalesce(F.last("_v", True).over(_within(order)), F.col("_carry"))).drop("_g", "_b", "_v", "_carry")


def running_sum(df: DataFrame, group: list[str], order: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """The rows with ``name``: the sum of ``value`` up to and with the row; nulls count as 0."""
    rows = _cut(df.withColumn("_v", F.coalesce(value, F.lit(0))), group, order, block)
    sums = rows.groupBy("_g", "_b").agg(F.sum("_v").alias("_sum"))
    carried = sums.select("_g", "_b", F.coalesce(F.sum("_sum").over(_before()), F.lit(0)).alias("_carry"))
    out = rows.join(carried, ["_g", "_b"])
    return out.withColumn(name, F.sum("_v").over(_within(order)) + F.col("_carry")).drop("_g", "_b", "_v", "_carry")


def run_length(df: DataFrame, group: list[str], order: str, flag: Column, name: str, block: int = BLOCK) -> DataFrame:
    """The rows with ``name``: how many rows in a row, this one being the last, have the flag; 0 without it or if null."""
    on = F.coalesce(flag, F.lit(False))
    rows = running_sum(df.withColumn("_on", on), group, order, F.lit(1), "_place", block)
    rows = last_known(rows, group, order, F.when(~F.col("_on"), F.col("_place")), "_off", block)
    return rows.withColumn(name, F.when(F.col("_on"), F.col("_place") - F.coalesce("_off", F.lit(0))).otherwise(0).cast("bigint")).drop("_on", "_place", "_off")


def until_run(df: DataFrame, group: list[str], order: str, flag: Column, times: int = 3, block: int = BLOCK) -> DataFrame:
    """The rows up to and with the one that ends the first run of ``times`` flagged rows; all rows of a group without one."""
    rows = run_length(df, group, order, flag, "_run", block)
    rows = running_sum(rows, group, order, F.when(F.col("_run") >= times, 1).otherwise(0), "_stops", block)
    # the stopping row is the first that counts
    return rows.filter((F.col("_stops") == 0) | ((F.col("_stops") == 1) & (F.col("_run") >= times))).drop("_run", "_stops")
