"""Messages that keep arriving: only new ones are appended, whatever was seen before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chatloom.functions.keys import stable_key
from chatloom.operators.dedup import batch_against
from chatloom.schema import MESSAGE
from chatloom.sources.files import hadoop


def _key() -> Column:
    return stable_key(F.col("id"), F.col("sender"), F.col("timestamp"), F.col("content"))


def read_stream(spark: SparkSession, folder: str, schema: str = MESSAGE, files_at_once: int | None = None) -> DataFrame:
    """JSON Lines files as they arrive in a folder."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).json(folder)


class Tail:
    """Appends new messages of a stream to a table, and their keys to an index beside it.

    Each micro-batch keeps the first row by ``seq`` of each key that the index lacks. Rows and keys of a batch go to
    folders named by its number, so that a batch done again after a failure replaces its own; the keys are written last,
    and those of the batch itself are not looked at. The index is a table, so that no state grows in memory.
    """

    def __init__(self, folder: str, keep: Callable[[DataFrame], DataFrame] | None = None, on_batch: Callable[[DataFrame, int], None] | None = None):
        self.rows, self.keys = f"{folder.rstrip('/')}/rows", f"{folder.rstrip('/')}/keys"
        self.keep, self.on_batch = keep, on_batch

    def _earlier(self, spark: SparkSession, number: int) -> DataFrame:
        path, fs = hadoop(spark, self.keys)
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        done = [f"{self.keys}/{n}" for n in names if n.startswith("batch=") and int(n[6:]) < number]
        return spark.read.schema("key string").parquet(*done) if done else spark.createDataFrame([], "key string")

    def take(self, batch: DataFrame, number: int) -> None:
        from chatloom.runtime import materialise

        spark = batch.sparkSession
        rows = self.keep(batch) if self.keep else batch
        new = materialise(batch_against(rows, self._earlier(spark, number), _key()), "tail")
        new.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.rows}/batch={number}")
        if self.on_batch:
            self.on_batch(new, number)
        new.select(_key().alias("key")).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.keys}/batch={number}")

    def start(self, stream: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
        """Run over all that is there, or, with a time such as ``2 seconds``, until stopped."""
        writer = stream.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()

    def read(self, spark: SparkSession, schema: str = MESSAGE) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{self.rows}/batch=*")


def new_only(stream: DataFrame, late: str | None = None) -> DataFrame:
    """The stream without messages whose key came before, with the state in Spark: unbounded, or, with ``late``, kept as
    long as the event time may lag. Which of a batch's copies stays is not defined; ``Tail`` keeps the first."""
    rows = stream.withColumn("key", _key())
    if late is None:
        return rows.dropDuplicates(["key"])
    return rows.withColumn("event_time", F.col("timestamp").cast("timestamp")).withWatermark("event_time", late).dropDuplicatesWithinWatermark(["key"])


def alert_stream(beats: DataFrame, cpu: float | None, memory: float | None) -> DataFrame:
    """Alerts of a stream of heartbeats: a filter, without state."""
    from chatloom.sinks.metrics import alerts

    return alerts(beats, cpu, memory)
