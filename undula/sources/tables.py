"""Signals derived from plain event and vector tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.core import from_arrays, from_rows


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def user_series(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's event values in the order of their time."""
    return from_rows(table(spark, folder, "events"), "user_id", ["ts", "event_id"], "value", F.to_date("ts"))


def gappy(samples: DataFrame) -> DataFrame:
    """Two samples missing of every 17."""
    return samples.withColumn("value", F.when(~(F.col("idx") % 17).isin(3, 4), F.col("value")))


def spiky(samples: DataFrame) -> DataFrame:
    """A thousand added to one sample in 29."""
    return samples.withColumn("value", F.col("value") + F.when(F.col("idx") % 29 == 13, 1000.0).otherwise(0.0))


def hourly_by_type(spark: SparkSession, folder: str) -> DataFrame:
    """Mean value of each event type in each hour; hours without such an event are missing."""
    hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600)
    means = table(spark, folder, "events").groupBy(F.col("event_type").alias("rec"), hour.alias("hour")).agg(F.avg("value").alias("value"))
    span = means.groupBy().agg(F.min("hour").alias("h0"), F.max("hour").alias("h1"))
    grid = means.select("rec").distinct().join(F.broadcast(span)).select("rec", "h0", F.explode(F.sequence("h0", "h1")).alias("hour"))
    return grid.join(means, ["rec", "hour"], "left").select("rec", (F.col("hour") - F.col("h0")).alias("idx"), "value")


def daily_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The mean price of each priority's orders on each day that has some."""
    days = table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("rec"), F.col("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("value"))
    return from_rows(days, "rec", ["day"], "value", F.col("day"))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Each embedding as a recording of its components."""
    return from_arrays(table(spark, folder, "embeddings"), "vec_id", "embedding")
