"""Session helpers: shared scratch tables, table loading, skew-safe representative joins."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, from ``spark.checkpoint.dir``.

    Only where the session names none (tests, one machine) a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="chatloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _release() -> None:
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            hadoop = jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session may be gone; the cluster's own cleaning has to do then
            pass
    _made.clear()


atexit.register(_release)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/chatloom/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage, survives the loss of executors and lets several consumers share one computation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete the table of a ``materialise`` that nothing reads any more, so that rounds don't fill the folder."""
    path = getattr(df, "written_to", None)
    if path:
        hadoop = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def load(spark: SparkSession, sf_dir: str, *names: str):
    """The tables ``names`` of a data folder; one DataFrame, or a tuple of them."""
    frames = tuple(spark.read.parquet(f"{sf_dir.rstrip('/')}/{n}.parquet") for n in names)
    return frames[0] if len(frames) == 1 else frames


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def group_lowest(rows: DataFrame, keys: list[str], order: str, lowest: str, count: str, hot_groups: int = 1000) -> DataFrame:
    """Rows of the groups with more than one row, each with its group's lowest ``order`` and size.

    The groups are aggregated before the shuffle. A group larger than 1/``hot_groups`` of all rows is joined back by
    broadcast, and there can be no more than ``hot_groups`` such groups; the others fit in a shuffle join, as none of
    them is large. ``rows`` is read twice and should be a written table.
    """
    sizes = materialise(rows.groupBy(*keys).agg(F.min(order).alias(lowest), F.count(F.lit(1)).alias(count)).filter(F.col(count) > 1), "groups")
    total = rows.agg(F.count(F.lit(1))).first()[0]
    limit = max(total // hot_groups, 1000)
    hot = sizes.filter(F.col(count) > limit)
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(sizes.filter(F.col(count) <= limit), keys))


def skew_join(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", hot_keys: int = 1000) -> DataFrame:
    """``rows`` joined with a table that has one row for each key, however the rows crowd on some keys.

    Keys that hold more than 1/``hot_keys`` of the rows are joined by broadcast, and there can be no more than
    ``hot_keys`` of them; the others by shuffle. ``how`` is inner, left, left_semi or left_anti. ``rows`` is read twice
    and should be a written table; null keys match nothing.
    """
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.agg(F.count(F.lit(1))).first()[0]
    hot = [r[0] for r in sizes.filter((F.col("_n") > max(total // hot_keys, 1000)) & F.col(key).isNotNull()).select(key).collect()]
    if not hot:
        return rows.join(table, key, how)
    names = rows.sparkSession.createDataFrame([(h,) for h in hot], rows.select(key).schema)
    crowded = F.broadcast(table.join(F.broadcast(names), key, "left_semi"))
    one = rows.join(F.broadcast(names), key, "left_semi").join(crowded, key, how)
    return one.unionByName(rows.join(F.broadcast(names), key, "left_anti").join(table, key, how))


def bounded_sample(rows: DataFrame, key: str, about: int) -> DataFrame:
    """About ``about`` of the rows, or all of fewer, chosen by a hash of ``key``: the same ones in every run.

    A filter, so that no more than the sample reaches the driver however many partitions there are.
    """
    total = rows.count()
    if total <= about:
        return rows
    return rows.filter(F.pmod(F.xxhash64(F.lit(7), key), F.lit(1 << 40)) < int(about / total * (1 << 40)))


def blank(c: Column) -> Column:
    """True where a text is null, empty or only Unicode white space."""
    return c.isNull() | ~c.rlike(r"(?U)\S")
