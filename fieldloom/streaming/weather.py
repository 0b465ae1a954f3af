"""Streaming forms of the weather sums: the same results as in batch once the watermark has passed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema, files_at_once: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def daily_weather(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(site_id, obs_date, tmax, tmin, precipitation_mm) of a stream of (user_id, ts, value), in tumbling days; later events than the watermark are left out."""
    days = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), F.col("user_id").alias("site_id"))
    out = days.agg((F.max("value") / 10).alias("tmax"), (F.min("value") / 10).alias("tmin"), (F.sum("value") / 10).alias("precipitation_mm"))
    return out.select("site_id", F.to_date("w.start").alias("obs_date"), "tmax", "tmin", "precipitation_mm")


def daily_totals(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(site_id, day, value): sums of days. The day is a window of event time, so a stream in append mode gives each day out once and forgets it when the watermark has passed: state is as large as the days still open."""
    days = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), F.col("user_id").alias("site_id")).agg(F.sum("value").alias("value"))
    return days.select("site_id", F.to_date("w.start").alias("day"), "value")


def monthly_totals(days: DataFrame) -> DataFrame:
    """(site_id, month, value) of a table of days, such as a stream of ``daily_totals`` writes. Calendar months are no fixed windows, so a stream would have to keep them for ever."""
    return days.groupBy("site_id", F.date_format("day", "yyyy-MM").alias("month")).agg(F.sum("value").alias("value"))
