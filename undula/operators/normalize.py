"""Scaling a recording; a constant one becomes 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.core import long_recordings, with_quantiles, with_stats


def _scaled(df: DataFrame, by: Column, over: Column) -> DataFrame:
    v = F.col("value")
    return df.select("rec", "idx", F.when(v.isNotNull(), F.coalesce(F.try_divide(v - by, over), F.lit(0.0))).alias("value"))


def minmax(samples: DataFrame) -> DataFrame:
    return _scaled(with_stats(samples, lo=F.min("value"), hi=F.max("value")), F.col("lo"), F.col("hi") - F.col("lo"))


def standardize(samples: DataFrame) -> DataFrame:
    """By the population deviation."""
    return _scaled(with_stats(samples, mean=F.avg("value"), std=F.stddev_pop("value")), F.col("mean"), F.col("std"))


def robust_scale(samples: DataFrame) -> DataFrame:
    """By median and interquartile range."""
    df = with_quantiles(samples, long_recordings(samples), q=("value", [0.25, 0.5, 0.75]))
    return _scaled(df, F.col("q")[1], F.col("q")[2] - F.col("q")[0])


def l2(samples: DataFrame) -> DataFrame:
    """By the Euclidean norm; missing values are left out of it."""
    return _scaled(with_stats(samples, norm=F.sqrt(F.sum(F.col("value") * F.col("value")))), F.lit(0.0), F.col("norm"))


def normalize(samples: DataFrame, method: str = "zscore") -> DataFrame:
    return {"minmax": minmax, "zscore": standardize, "robust": robust_scale, "l2": l2}[method](samples)
