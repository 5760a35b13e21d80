"""Beyond parity: appending to a graph as a stream, and quality counters over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from ..plans.store import GraphStore


def append_stream(spark: SparkSession, folder: str, slots: StructType, target: str, checkpoint: str, table: str = "edges") -> StreamingQuery:
    """JSONL files that arrive in ``folder`` go to a table of the store ``target``: rows with a new id, and those without one.

    A batch reads only the stored files that may hold one of its ids, and writes one segment; its number is
    committed with it, so a batch that is tried again adds nothing.
    """

    def add(batch: DataFrame, number: int) -> None:
        store = GraphStore(spark, target)
        if number <= store.manifest["views"].get("last_batch", -1):
            return  # the batch was committed before the query stopped
        store.append(table, batch, unique=True, views={**store.manifest["views"], "last_batch": number})

    stream = spark.readStream.schema(slots).json(folder)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def quality_counters(events: DataFrame, time: str, by: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Rows of each value of ``by`` in each window, nulls as a value, on a stream with a watermark or on a batch."""
    counted = events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), by, "n")


def without_repeats(events: DataFrame, time: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """A stream without repeated keys inside the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
