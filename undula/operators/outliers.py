"""Outlier detection and removal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.core import chunked, long_recordings, over_chunks, owned, with_quantiles, with_spreads, with_stats
from undula.operators.cleaning import fill

#: From the median absolute deviation to the deviation of a normal distribution.
MAD_SCALE = 1.4826
TINY = 1e-12


def rolling_median(samples: DataFrame, window: int, name: str = "med") -> DataFrame:
    """Adds the median of the `window` samples around each (odd, 3 at least), the ends repeated: of those that are there, the mean
    of the middle two where their number is even, null where none is."""
    half = max(3, window | 1) // 2
    return owned(_median_around(chunked(samples, half, half), half, name))


def _median_around(df: DataFrame, half: int, name: str) -> DataFrame:
    """Adds the median of `half` samples to either side of each, over chunks: where there are fewer, the end's value is repeated."""
    frame = over_chunks((-half, half))
    beyond = lambda end, a, b: F.array_repeat(end("value").over(frame), (half - F.count(F.lit(1)).over(over_chunks((a, b)))).cast("int"))
    every = F.concat(F.collect_list("value").over(frame), beyond(F.first, -half, -1), beyond(F.last, 1, half))
    df = df.withColumn("around", F.sort_array(F.array_compact(every)))
    n = F.size("around")
    middle = (F.get("around", F.floor((n - 1) / 2).cast("int")) + F.get("around", F.floor(n / 2).cast("int"))) / 2
    return df.withColumn(name, F.when(n > 0, middle)).drop("around")


def zscore(samples: DataFrame, threshold: float = 3.0) -> DataFrame:
    df = with_stats(samples, mean=F.avg("value"), std=F.stddev_pop("value"))
    return df.select("rec", "idx", "value", F.coalesce(F.abs(F.col("value") - F.col("mean")) / (F.col("std") + TINY) > threshold, F.lit(False)).alias("outlier"))


def iqr(samples: DataFrame, threshold: float = 1.5) -> DataFrame:
    df = with_quantiles(samples, long_recordings(samples), q=("value", [0.25, 0.75]))
    q1, q3 = F.col("q")[0], F.col("q")[1]
    out = (F.col("value") < q1 - threshold * (q3 - q1)) | (F.col("value") > q3 + threshold * (q3 - q1))
    return df.select("rec", "idx", "value", F.coalesce(out, F.lit(False)).alias("outlier"))


def mad(samples: DataFrame, threshold: float = 3.0) -> DataFrame:
    long = long_recordings(samples)
    df = with_quantiles(samples, long, med=("value", 0.5))
    df = with_quantiles(df, long, dev=(F.abs(F.col("value") - F.col("med")), 0.5))
    score = F.abs(F.col("value") - F.col("med")) / (MAD_SCALE * F.col("dev") + TINY)
    return df.select("rec", "idx", "value", F.coalesce(score > threshold, F.lit(False)).alias("outlier"))


def _filled(samples: DataFrame, long: DataFrame | None) -> DataFrame:
    df = with_quantiles(samples, long, fill=("value", 0.5))
    return df.select("rec", "idx", F.coalesce("value", "fill").alias("value"), F.col("value").alias("raw"))


def hampel(samples: DataFrame, threshold: float = 3.0, window: int = 11) -> DataFrame:
    """Against the rolling median, by the rolling deviation, which the whole recording's spread keeps from vanishing."""
    long = long_recordings(samples)
    x = _filled(samples, long)
    x = rolling_median(x, window)
    x = x.withColumn("residual", F.abs(F.col("value") - F.col("med")))
    local = rolling_median(x.select("rec", "idx", F.col("residual").alias("value")), window, "local").select("rec", "idx", "local")
    x = with_quantiles(x, long, scale=("residual", 0.5), spread_mid=("value", 0.5))
    x = with_quantiles(x, long, spread=(F.abs(F.col("value") - F.col("spread_mid")), 0.5))
    floor = F.greatest(MAD_SCALE * F.col("scale"), 0.02 * MAD_SCALE * F.col("spread"), F.lit(TINY))
    x = x.join(local, ["rec", "idx"])
    out = F.col("residual") > threshold * F.greatest(MAD_SCALE * F.col("local"), floor)
    return x.select("rec", "idx", F.col("raw").alias("value"), (out & F.col("raw").isNotNull()).alias("outlier"))


def spike(samples: DataFrame, threshold: float = 10.0, window: int = 5) -> DataFrame:
    """Against the rolling median, by the noise between neighbours, the spread and the local slope of the median."""
    long = long_recordings(samples)
    x = spikes(_filled(samples, long), long, threshold, window)
    return x.select("rec", "idx", F.col("raw").alias("value"), (F.col("outlier") & F.col("raw").isNotNull()).alias("outlier"))


def spikes(samples: DataFrame, long: DataFrame | None, threshold: float, window: int) -> DataFrame:
    """Adds `outlier` by spike()'s rule to samples without gaps; other columns stay. All that a sample needs of those around it is
    had in one pass over chunks."""
    half = max(3, window | 1) // 2
    w, reach = over_chunks(), 2 * half + 2
    df = _median_around(chunked(samples, reach, reach), half, "med")
    df = df.withColumns({"jump": F.col("value") - F.lag("value").over(w), "m0": F.lag("med").over(w), "m1": F.lead("med").over(w)})
    df = df.withColumn("slope", F.abs(F.when(F.col("m0").isNull(), F.col("m1") - F.col("med")).when(F.col("m1").isNull(), F.col("med") - F.col("m0")).otherwise((F.col("m1") - F.col("m0")) / 2)))
    df = owned(df.withColumn("slope", F.max("slope").over(over_chunks((-half, half)))))
    df = with_spreads(df.drop("m0", "m1"), long, noise="jump", spread="value")
    scale = F.greatest(MAD_SCALE * F.col("noise") / F.sqrt(F.lit(2.0)), 0.02 * MAD_SCALE * F.col("spread"), F.coalesce("slope", F.lit(0.0)), F.lit(TINY))
    return df.select(*samples.columns, (F.abs(F.col("value") - F.col("med")) > threshold * scale).alias("outlier"))


DETECTORS = {"zscore": zscore, "iqr": iqr, "mad": mad, "hampel": hampel, "spike": spike}


def remove_outliers(samples: DataFrame, method: str = "zscore", fill_with: str = "interpolate", **parameters) -> DataFrame:
    """Replace outliers by interpolation, the recording's median, or nothing (`nan`)."""
    found = DETECTORS[method](samples, **parameters)
    if fill_with == "median":
        df = with_quantiles(found, long_recordings(samples), med=(F.when(~F.col("outlier"), F.col("value")), 0.5))
        return df.select("rec", "idx", F.when(F.col("outlier"), F.col("med")).otherwise(F.col("value")).alias("value"))
    gone = found.select("rec", "idx", F.when(~F.col("outlier"), F.col("value")).alias("value"))
    return gone if fill_with == "nan" else fill(gone, "interpolate")
