"""Progress events: append log, snapshot as a fold, resumable increments.

A snapshot holds for every key the last value that was present, an explicit null too. It is a
maximum per key by sequence, so batches can be folded apart and merged.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT = "seq bigint, event string, values map<string,string>"


def folded(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, key, seq, value) the last present value of each key, and `last_event`.

    events (by, seq, event, values): later sequence numbers overwrite, a null value counts as
    present. Ties of seq go to the greater value.
    """
    by = by or []
    items = events.select(*by, "seq", F.explode_outer("values").alias("key", "value")).where("key IS NOT NULL")
    last = events.select(*by, "seq", F.lit("last_event").alias("key"), F.col("event").alias("value"))
    return _latest(items.unionByName(last), by)


def _latest(items: DataFrame, by: list[str]) -> DataFrame:
    top = F.max(F.struct("seq", F.col("value").isNull().alias("n"), "value")).alias("m")
    return items.groupBy(*by, "key").agg(top).select(*by, "key", "m.seq", "m.value")


def merged(snapshot: DataFrame, more: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Two snapshots (by, key, seq, value) into one."""
    by = by or []
    return _latest(snapshot.select(*by, "key", "seq", "value").unionByName(more.select(*by, "key", "seq", "value")), by)


def append_log(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Files of JSON events are appended to a Parquet log, each once."""
    events = spark.readStream.schema(EVENT).json(source)
    return events.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_snapshot(spark: SparkSession, source: str, snapshot: str, checkpoint: str) -> StreamingQuery:
    """Folds what is new since the checkpoint into a snapshot, which is versioned by batch.

    A batch that runs again after a failure writes the same version again from the version
    before, so no event counts twice.
    """

    def fold(batch: DataFrame, number: int) -> None:
        new = folded(batch)
        if number:
            try:
                new = merged(spark.read.parquet(f"{snapshot}/v={number - 1}"), new)
            except AnalysisException:  # the version before was empty
                pass
        new.write.mode("overwrite").parquet(f"{snapshot}/v={number}")

    events = spark.readStream.schema(EVENT).json(source)
    return events.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(spark: SparkSession, snapshot: str) -> DataFrame:
    """The last version of a snapshot."""
    versions = spark.read.parquet(snapshot)
    return versions.where(F.col("v") == versions.agg(F.max("v")).first()[0]).drop("v")


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Extension: counts and sums per time window and key with a watermark, for streams and tables alike."""
    t = events.withWatermark(time, late) if events.isStreaming else events
    return t.groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")
