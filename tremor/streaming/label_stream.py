"""Label events as a stream: repeats dropped, statuses set, the table of latest labels kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.labels import latest, upserted
from ..sources.proxies import events_from

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Events per sliding window and type; late ones beyond the watermark are left out."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", size, slide), "event_type")
    return counted.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return grouped.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def keep_latest(events: DataFrame, table: str, checkpoint: str, late: str = "1 day"):
    """A query that upserts each batch's newest confirmed events into a table, one folder per batch, the last one named in `version`.

    The table is read in the version before, so a batch that is run again after a failure gives the same rows."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = latest(events_from(batch).where("status = 'confirmed'"), ["sample_pk"], [F.desc("timestamp"), F.desc("id")]).select("sample_pk", "timestamp", "id", "reason_key")
        if number:
            old = spark.read.schema(new.schema).parquet(f"{table}/version={number - 1}")
            newer = new.join(old.select("sample_pk", F.col("timestamp").alias("t0"), F.col("id").alias("i0")), "sample_pk", "left")
            newer = newer.where("t0 IS NULL OR struct(timestamp, id) > struct(t0, i0)").select(new.columns)
            new = upserted(old, newer, ["sample_pk"])
        new.write.mode("overwrite").parquet(f"{table}/version={number}")

    return once.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).outputMode("append")
