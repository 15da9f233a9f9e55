"""Streams over the catalogue: current offers kept as offers arrive, and windowed counts of events with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from insumo.operators.audit import keep_first


def event_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """window_start, event_type, n, total per window; events later than `late` are dropped by the watermark."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return w.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def deduplicated(offers: DataFrame, late: str = "30 days") -> DataFrame:
    """Offers delivered twice are passed once, as long as the second comes within the watermark."""
    return offers.withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["id", "final_price", "updated_at"])


def upsert_offers(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keeps the valid offer of each id in a table under `path`: every micro-batch is merged with the last version and written
    as the next; a version is complete before it is named, so a batch that is repeated after a loss changes nothing."""

    def merge(batch: DataFrame, epoch: int) -> None:
        new = f"{path}/v={epoch}"
        rows = batch
        if epoch > 0:
            rows = batch.unionByName(spark.read.parquet(f"{path}/v={epoch - 1}"))
        keep_first(rows, ["id"], [F.col("ingest_seq").desc()]).write.mode("overwrite").parquet(new)

    w = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
