"""Missing values, cropping, clipping and offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undula.core import long_recordings, neighbours, with_quantiles, with_stats


def fill(samples: DataFrame, method: str = "interpolate", short: bool = False) -> DataFrame:
    """Repair missing values: interpolate (linear, the ends held), ffill, bfill, zero, mean, median, or drop.

    ffill and bfill leave what has no value on that side; the index is kept by all but drop, which numbers anew. interpolate
    keeps further columns, and needs less where recordings are known to be `short`, see core.neighbours().
    """
    v = F.col("value")
    if method == "interpolate":
        near = neighbours(samples, short)
        share = (F.col("idx") - F.col("prev_i")) / (F.col("next_i") - F.col("prev_i"))
        line = F.col("prev_v") + (F.col("next_v") - F.col("prev_v")) * share
        value = F.when(v.isNotNull(), v).when(F.col("prev_i").isNull(), F.col("next_v")).when(F.col("next_i").isNull(), F.col("prev_v")).otherwise(line)
        return near.select(*(value.alias(c) if c == "value" else c for c in samples.columns))
    if method in ("ffill", "bfill"):
        return neighbours(samples).select("rec", "idx", F.col("prev_v" if method == "ffill" else "next_v").alias("value"))
    if method == "zero":
        return samples.withColumn("value", F.coalesce(v, F.lit(0.0)))
    if method in ("mean", "median"):
        df = with_stats(samples, stat=F.avg("value")) if method == "mean" else with_quantiles(samples, long_recordings(samples), stat=("value", 0.5))
        return df.select("rec", "idx", F.coalesce(v, "stat").alias("value"))
    if method == "drop":
        return renumbered(samples.where("value IS NOT NULL"))
    raise ValueError(f"unknown method {method!r}")


def renumbered(samples: DataFrame) -> DataFrame:
    """Dense indices in the old order: places within chunks, plus the counts of the chunks before."""
    from undula.core import CHUNK

    df = samples.withColumn("chunk", F.floor(F.col("idx") / F.lit(CHUNK)))
    counts = df.groupBy("rec", "chunk").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("rec").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("rec", "chunk", F.coalesce(before, F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("rec", "chunk").orderBy("idx")) - 1
    return df.withColumn("place", place).join(base, ["rec", "chunk"]).select("rec", (F.col("base") + F.col("place")).alias("idx"), "value")


def drop_rows(channels: DataFrame) -> DataFrame:
    """Of channels recorded together (rec, idx alike): the instants at which no channel is missing."""
    whole = channels.groupBy("idx").agg(F.bool_and(F.col("value").isNotNull()).alias("whole")).where("whole").select("idx")
    return channels.join(whole, "idx", "left_semi")


def impute_knn(channels: DataFrame, k: int = 5) -> DataFrame:
    """Fill a missing channel value from the k instants most like it that have the channel.

    The distance of two instants is the Euclidean one over the channels that both have, scaled up by the share of channels
    shared; ties go to the earlier instant. Instants with a gap, the few, meet the others on the channels both have.
    """
    n = channels.select("rec").distinct().count()
    have = channels.where("value IS NOT NULL")
    holes = channels.where("value IS NULL").select(F.col("rec").alias("hole"), F.col("idx").alias("at"))
    gap = have.join(holes.select("at").distinct(), F.col("idx") == F.col("at"), "left_semi").select("rec", F.col("idx").alias("at"), F.col("value").alias("own"))
    pairs = gap.join(have, "rec").where("idx <> at").groupBy("at", "idx").agg(F.sum(F.pow(F.col("own") - F.col("value"), F.lit(2.0))).alias("s"), F.count("*").alias("m"))
    distance = pairs.select("at", "idx", F.sqrt(F.col("s") * n / F.col("m")).alias("d"))
    donors = holes.join(distance, "at").join(have.select(F.col("rec").alias("hole"), "idx", "value"), ["hole", "idx"])
    near = donors.withColumn("r", F.row_number().over(Window.partitionBy("hole", "at").orderBy("d", "idx"))).where(F.col("r") <= k)
    found = near.groupBy(F.col("hole").alias("rec"), F.col("at").alias("idx")).agg(F.avg("value").alias("found"))
    mean = channels.groupBy("rec").agg(F.avg("value").alias("mean"))
    return channels.join(found, ["rec", "idx"], "left").join(mean, "rec").select("rec", "idx", F.coalesce("value", "found", "mean").alias("value"))


def crop(samples: DataFrame, start: int, end: int) -> DataFrame:
    """Samples start .. end - 1, numbered from 0."""
    return samples.where((F.col("idx") >= start) & (F.col("idx") < end)).withColumn("idx", F.col("idx") - start)


def crop_annotations(annotations: DataFrame, start: float, end: float) -> DataFrame:
    """Annotations whose onset lies in [start, end), from the new start on."""
    return annotations.where((F.col("onset") >= start) & (F.col("onset") < end)).withColumn("onset", F.col("onset") - start)


def clip(samples: DataFrame, low: float, high: float) -> DataFrame:
    if low > high:
        raise ValueError("low is above high")
    v = F.col("value")
    return samples.withColumn("value", F.when(v.isNotNull(), F.greatest(F.least(v, F.lit(float(high))), F.lit(float(low)))))


def remove_dc(samples: DataFrame) -> DataFrame:
    return with_stats(samples, mean=F.avg("value")).select("rec", "idx", (F.col("value") - F.col("mean")).alias("value"))


def winsorize(samples: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Clip to two quantiles of the recording."""
    df = with_quantiles(samples, long_recordings(samples), q=("value", [low, high]))
    v = F.col("value")
    return df.select("rec", "idx", F.when(v.isNotNull(), F.greatest(F.least(v, F.col("q")[1]), F.col("q")[0])).alias("value"))


def impute(samples: DataFrame, method: str = "mean", k: int = 5) -> DataFrame:
    """fill() by any of its methods, or `knn` over channels recorded together."""
    return impute_knn(samples, k) if method == "knn" else fill(samples, method)
