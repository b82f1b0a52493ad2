"""Rows that repeat others: first wins by one key, by two keys at once, and against an index of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.runtime import discard, materialise


def first_wins(df: DataFrame, key: Column, order: str | Column = "seq") -> DataFrame:
    """The first row by ``order`` of each key; rows without a key (null) are one group.

    An aggregation, so that the copies of a key shrink to one row before the shuffle, however many there are. Of rows
    with the same ``order`` the least by its columns is kept.
    """
    first = F.min(F.struct(F.col(order) if isinstance(order, str) else order, F.struct("*").alias("row")))
    return df.groupBy(key.alias("_key")).agg(first.alias("_first")).select("_first.row.*")


def unseen(df: DataFrame, index: DataFrame, key: Column) -> DataFrame:
    """The rows whose key is not in ``index`` (a column ``key``). Left as a plain anti join: broadcast if the index is
    small, else by sort and merge, where skewed keys are split at run time."""
    return df.withColumn("key", key).join(index.select("key"), "key", "left_anti").drop("key")


def batch_against(df: DataFrame, index: DataFrame, key: Column, order: str = "seq") -> DataFrame:
    """What a batch adds: the first row of each key that the index does not hold."""
    return unseen(first_wins(df, key, order), index, key)


def index_of(df: DataFrame, key: Column) -> DataFrame:
    """The distinct keys of rows, as ``key``."""
    return df.select(key.alias("key")).distinct()


def two_keys(df: DataFrame, key: Column, second: Column, order: str = "seq") -> DataFrame:
    """The rows kept when rows are taken in ``order`` and one is dropped if either of its keys was used by a kept row.

    ``order`` must be unique. Rows are edges between their two keys, and the result is the greedy matching in order. In
    each round the rows that come first at both of their keys are kept, and rows that share a key with them dropped; this
    equals the sequential rule, and a round always keeps the first live row, so that it ends. Of equal pairs of keys only
    the first can be kept, so copies are gone before the first round. Each round is a written table of keys, without the
    other columns.
    """
    keyed = df.select(F.col(order).alias("_o"), F.md5(key).alias("_k1"), F.md5(second).alias("_k2"))
    live = materialise(keyed.groupBy("_k1", "_k2").agg(F.min("_o").alias("_o")), "pairs")
    kept = None
    while True:
        before = live
        firsts = [live.groupBy(k).agg(F.min("_o").alias("_o")).select("_o") for k in ("_k1", "_k2")]
        # joined by the order, which no key can crowd
        now = materialise(live.join(firsts[0], "_o", "left_semi").join(firsts[1], "_o", "left_semi"), "kept")
        kept = now.select("_o") if kept is None else kept.union(now.select("_o"))
        live = live.join(now.select("_k1"), "_k1", "left_anti").join(now.select("_k2"), "_k2", "left_anti")
        done, live = before, materialise(live, "live")
        discard(done)
        if live.isEmpty():
            break
    return df.join(kept.withColumnRenamed("_o", order), order, "left_semi")
