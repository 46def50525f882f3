"""Realistic variations of recordings, for training.

Every random number is hashed from the seed, the recording and, where each sample has one, its index: the same call gives the
same samples, whatever the partitions and however often a task runs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.core import with_stats


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) that depends on the seed and the keys alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) / F.lit(float(1 << 40))


def normal(seed: int, *keys: Column | str) -> Column:
    """A standard normal number likewise."""
    u = 1 - uniform(seed, *keys)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * uniform(seed + 7919, *keys))


def _between(low: float | Column, high: float | Column, seed: int, name: str) -> Column:
    return F.lit(low) + (F.lit(high) - F.lit(low)) * uniform(seed, "rec", F.lit(name))


def _happens(p: float, seed: int, name: str) -> Column:
    return uniform(seed, "rec", F.lit(f"{name} happens")) < p


def _added(df: DataFrame, what: Column, p: float, seed: int, name: str) -> DataFrame:
    return df.select("rec", "idx", F.when(_happens(p, seed, name), F.col("value") + what).otherwise(F.col("value")).alias("value"))


def add_noise(samples: DataFrame, snr_db: float | Column, seed: int = 0, p: float = 1.0) -> DataFrame:
    """White noise at that ratio of the recording's power to the noise's, in decibels; in a share p of the recordings."""
    df = with_stats(samples, power=F.avg(F.col("value") * F.col("value")))
    return _added(df, F.sqrt(F.col("power") / F.pow(F.lit(10.0), F.lit(snr_db) / 10)) * normal(seed, "rec", "idx"), p, seed, "noise")


def add_powerline(samples: DataFrame, fs: float, freq: float | Column = 50.0, amplitude: float | Column = 0.1, seed: int = 0, p: float = 1.0) -> DataFrame:
    """A hum of so many deviations of the recording, at a phase of its own."""
    df = with_stats(samples, std=F.stddev_pop("value"))
    angle = 2 * math.pi * F.lit(freq) * F.col("idx") / fs + _between(0.0, 2 * math.pi, seed, "hum phase")
    return _added(df, F.lit(amplitude) * F.col("std") * F.sin(angle), p, seed, "hum")


def add_baseline_wander(samples: DataFrame, fs: float, amplitude: float | Column = 0.5, freq: float = 0.2, seed: int = 0, p: float = 1.0) -> DataFrame:
    """A slow sine of so many deviations, at 0.5 to 1.5 times the frequency."""
    df = with_stats(samples, std=F.stddev_pop("value"))
    angle = 2 * math.pi * freq * _between(0.5, 1.5, seed, "wander rate") * F.col("idx") / fs + _between(0.0, 2 * math.pi, seed, "wander phase")
    return _added(df, F.lit(amplitude) * F.col("std") * F.sin(angle), p, seed, "wander")


def _length(samples: DataFrame) -> DataFrame:
    return with_stats(samples, n=F.max("idx") + 1)


def add_spikes(samples: DataFrame, n: int = 3, amplitude: float = 5.0, seed: int = 0, p: float = 1.0) -> DataFrame:
    """n single samples of each recording off by so many deviations, up or down."""
    df = with_stats(samples, std=F.stddev_pop("value"), n=F.max("idx") + 1)
    hits = [F.col("idx") == F.floor(uniform(seed, "rec", F.lit(f"spike {k}")) * F.col("n")) for k in range(n)]
    sign = lambda k: F.when(uniform(seed, "rec", F.lit(f"sign {k}")) < 0.5, -1.0).otherwise(1.0)
    total = sum((F.when(h, sign(k)).otherwise(0.0) for k, h in enumerate(hits)), F.lit(0.0))
    return _added(df, total * amplitude * F.col("std"), p, seed, "spikes")


def dropout(samples: DataFrame, most: float = 0.1, seed: int = 0, p: float = 1.0) -> DataFrame:
    """One stretch of up to that share of each recording at 0."""
    df = _length(samples)
    length = F.floor(_between(0.0, most, seed, "drop length") * F.col("n"))
    start = F.floor(uniform(seed, "rec", F.lit("drop start")) * (F.col("n") - length + 1))
    gone = (F.col("idx") >= start) & (F.col("idx") < start + length) & _happens(p, seed, "dropout")
    return df.select("rec", "idx", F.when(gone & F.col("value").isNotNull(), 0.0).otherwise(F.col("value")).alias("value"))


def scale(samples: DataFrame, factor: float | Column) -> DataFrame:
    return samples.select("rec", "idx", (F.col("value") * F.lit(factor)).alias("value"))


def invert(samples: DataFrame, seed: int = 0, p: float = 1.0) -> DataFrame:
    return samples.select("rec", "idx", F.when(_happens(p, seed, "invert"), -F.col("value")).otherwise(F.col("value")).alias("value"))


def time_shift(samples: DataFrame, shift: int | Column) -> DataFrame:
    """Round by so many samples: what leaves at one end comes in at the other."""
    df = _length(samples)
    return df.select("rec", F.pmod(F.col("idx") + F.lit(shift), F.col("n")).cast("long").alias("idx"), "value")


def time_stretch(samples: DataFrame, factor: float | Column) -> DataFrame:
    """Faster (above 1) or slower, at the old length: sample i is read at i * factor on the lines between samples, and the last
    sample goes on where they end."""
    df = _length(samples).withColumn("f", F.lit(factor))
    at = F.least(F.col("idx") * F.col("f"), (F.col("n") - 1).cast("double"))
    asked = df.select("rec", F.col("idx").alias("to"), at.alias("at")).withColumns({"idx": F.floor("at").cast("long"), "share": F.col("at") - F.floor("at")})
    low = asked.join(samples.select("rec", "idx", F.col("value").alias("low")), ["rec", "idx"])
    high = samples.select("rec", (F.col("idx") - 1).alias("idx"), F.col("value").alias("high"))
    both = low.join(high, ["rec", "idx"], "left")
    line = F.when(F.col("share") == 0, F.col("low")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * F.col("share"))
    return both.select("rec", F.col("to").alias("idx"), line.alias("value"))


class Augmenter:
    """Several variations at random, in one order: stretch, shift, scale, inversion, wander, hum, noise, spikes, dropout. Numbers
    are the share of recordings that get one, pairs the range of its size; None and 0 leave it out."""

    def __init__(
        self, fs: float | None = None, noise_snr: tuple[float, float] | None = (15.0, 35.0), p_noise: float = 0.5, powerline: float = 0.0, wander: float = 0.0, spikes: float = 0.0, dropout: float = 0.0,
        scale_range: tuple[float, float] | None = (0.8, 1.2), max_shift: float = 0.0, stretch_range: tuple[float, float] | None = None, invert: float = 0.0, seed: int = 0,
    ):
        if (powerline or wander) and not fs:
            raise ValueError("hum and wander need a rate")
        self.fs, self.noise_snr, self.p_noise, self.powerline, self.wander, self.spikes, self.dropout = fs, noise_snr, p_noise, powerline, wander, spikes, dropout
        self.scale_range, self.max_shift, self.stretch_range, self.invert, self.seed = scale_range, max_shift, stretch_range, invert, seed

    def __call__(self, samples: DataFrame) -> DataFrame:
        s, seed = samples.select("rec", "idx", "value"), self.seed
        if self.stretch_range:
            s = time_stretch(s, F.when(_happens(0.5, seed, "stretch"), _between(*self.stretch_range, seed, "stretch")).otherwise(1.0))
        if self.max_shift:
            n = s.groupBy("rec").agg((F.max("idx") + 1).alias("n"))
            moved = F.pmod(F.col("idx") + (_between(-self.max_shift, self.max_shift, seed, "shift") * F.col("n")).cast("long"), F.col("n"))
            s = s.join(n, "rec").select("rec", moved.cast("long").alias("idx"), "value")
        if self.scale_range:
            s = scale(s, _between(*self.scale_range, seed, "scale"))
        if self.invert:
            s = invert(s, seed, self.invert)
        if self.wander:
            s = add_baseline_wander(s, self.fs, _between(0.2, 1.0, seed, "wander size"), seed=seed, p=self.wander)
        if self.powerline:
            mains = F.when(uniform(seed, "rec", F.lit("mains")) < 0.5, 50.0).otherwise(60.0)
            s = add_powerline(s, self.fs, mains, _between(0.05, 0.3, seed, "hum size"), seed, self.powerline)
        if self.noise_snr:
            s = add_noise(s, _between(*self.noise_snr, seed, "snr"), seed, self.p_noise)
        if self.spikes:
            s = add_spikes(s, 3, seed=seed, p=self.spikes)
        if self.dropout:
            s = dropout(s, seed=seed, p=self.dropout)
        return s

    def expand(self, samples: DataFrame, copies: int = 1, original: bool = True) -> DataFrame:
        """rec, copy, idx and value of so many variations of every recording, and of it itself as copy 0."""
        kind = samples.schema["rec"].dataType.simpleString()
        each = samples.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).select(F.to_json(F.struct("rec", "copy")).alias("rec"), "idx", "value")
        made = self(each).withColumn("key", F.from_json("rec", f"rec {kind}, copy int")).select("key.rec", "key.copy", "idx", "value")
        return samples.select("rec", F.lit(0).alias("copy"), "idx", "value").unionByName(made) if original else made
