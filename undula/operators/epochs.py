"""Event-locked epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def epochs(samples: DataFrame, events: DataFrame, first: int, last: int, baseline: tuple[int, int] | None = None, reject: float | None = None) -> DataFrame:
    """rec, event, label, rel and value of the samples first .. last around each event (rec, event, at, label).

    Events too near an end are dropped; the mean over the places `baseline` is taken off; epochs whose values span more
    than `reject` are dropped. Each event asks for its samples by their index, so the join is on equal keys.
    """
    n = samples.groupBy("rec").agg((F.max("idx") + 1).alias("n"))
    inside = events.join(n, "rec").where((F.col("at") + first >= 0) & (F.col("at") + last < F.col("n")))
    asked = inside.select("rec", "event", "label", "at", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("rel")).withColumn("idx", F.col("at") + F.col("rel"))
    out = asked.join(samples, ["rec", "idx"])
    if baseline or reject is not None:
        low, high = baseline or (first, last)
        span = (F.max("value") - F.min("value")).alias("span")
        stats = out.groupBy("rec", "event").agg(F.avg(F.when(F.col("rel").between(low, high), F.col("value"))).alias("base"), span)
        if reject is not None:
            stats = stats.where(F.col("span") <= reject)
        out = out.join(stats, ["rec", "event"])
        if baseline:
            out = out.withColumn("value", F.col("value") - F.col("base"))
    return out.select("rec", "event", "label", "rel", "value")


def average(cut: DataFrame, *by: str) -> DataFrame:
    """Mean, median and deviation over epochs at each place."""
    return cut.groupBy(*by, "rel").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.percentile("value", F.lit(0.5)).alias("median"), F.stddev_pop("value").alias("std"))
