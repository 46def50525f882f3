"""Fourier transforms of recordings that no task can hold.

A length that is a product of two sides is laid out as a matrix: its columns are transformed, turned by their twiddle factors and
exchanged in a shuffle, and its rows are transformed. Each line is a group of its own, no longer than SIDE, so a recording of up to
SIDE squared samples is spread over as many tasks as there are. Other lengths, such as large primes, become a convolution with a
chirp, of a length that is a power of two.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undula import core
from undula.core import shifted, stored

#: The longest line that a task transforms.
SIDE = 1 << 16
#: Coefficients of the periodic cosine windows.
COSINES = {"hann": (0.5, -0.5), "hamming": (0.54, -0.46), "blackman": (0.42, -0.5, 0.08), "boxcar": (1.0,)}


def _rows(n: Column) -> Column:
    """The shorter side of the squarest matrix of n cells, null if the other one is too long."""
    sides = F.filter(F.sequence(F.lit(1).cast("long"), F.least(F.floor(F.sqrt(n)), F.lit(SIDE))), lambda d: n % d == 0)
    rows = F.array_max(sides)
    return F.when(n / rows <= SIDE, rows)


def _lines(cells: DataFrame, inverse: bool) -> DataFrame:
    """rec, idx, re and im of rec, n, rows, idx, re and im, transformed by columns and rows; cells that aren't there are 0."""
    kind = cells.schema["rec"].dataType.simpleString()
    sign, fft = (1, lambda z: np.fft.ifft(z) * len(z)) if inverse else (-1, np.fft.fft)

    def column(own: pd.DataFrame) -> pd.DataFrame:
        n, rows = int(own["n"].iloc[0]), int(own["rows"].iloc[0])
        at = own["idx"].to_numpy()
        j = int(at[0]) % (n // rows)
        z = np.zeros(rows, complex)
        z[at // (n // rows)] = own["re"].to_numpy() + 1j * own["im"].to_numpy()
        k = np.arange(rows)
        z = fft(z) * np.exp(sign * 2j * np.pi * (k * j % n) / n)
        return pd.DataFrame({"rec": own["rec"].iloc[0], "n": n, "rows": rows, "k": k, "j": j, "re": z.real, "im": z.imag})

    def row(own: pd.DataFrame) -> pd.DataFrame:
        n, rows, k = (int(own[c].iloc[0]) for c in ("n", "rows", "k"))
        z = np.zeros(n // rows, complex)
        z[own["j"].to_numpy()] = own["re"].to_numpy() + 1j * own["im"].to_numpy()
        z = fft(z) / (n if inverse else 1)
        return pd.DataFrame({"rec": own["rec"].iloc[0], "idx": k + rows * np.arange(n // rows), "re": z.real, "im": z.imag})

    turned = cells.groupBy("rec", (F.col("idx") % (F.col("n") / F.col("rows")).cast("long")).alias("line")).applyInPandas(column, f"rec {kind}, n long, rows long, k long, j long, re double, im double")
    return turned.groupBy("rec", "k").applyInPandas(row, f"rec {kind}, idx long, re double, im double")


def _times(a: tuple[Column, Column], b: tuple[Column, Column]) -> list[Column]:
    return [(a[0] * b[0] - a[1] * b[1]).alias("re"), (a[0] * b[1] + a[1] * b[0]).alias("im")]


def _chirp(sign: int) -> tuple[Column, Column]:
    angle = F.col("idx") * F.col("idx") % (2 * F.col("n")) / F.col("n") * F.lit(np.pi)
    return F.cos(angle), sign * F.sin(angle)


def _chirped(values: DataFrame, lengths: DataFrame, inverse: bool) -> DataFrame:
    """The transform as a convolution: idx * k is (idx^2 + k^2 - (k - idx)^2) / 2."""
    sign = 1 if inverse else -1
    z = F.col("re"), F.col("im")
    padded = {"size": F.expr("shiftleft(1L, length(bin(2 * n - 1)))"), "rows": F.expr("shiftleft(1L, length(bin(2 * n - 1)) div 2)")}
    matrix = lambda df: df.select("rec", F.col("size").alias("n"), "rows", "idx", "re", "im")
    sized = lengths.withColumns(padded)
    turned = values.join(sized, "rec").select("rec", "size", "rows", "idx", *_times(z, _chirp(sign)))
    # The chirp runs from -(n - 1) to n - 1, once for each length.
    piece = F.lit(core.CHUNK)
    starts = sized.select("n", "size", "rows").distinct().withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / piece)))).repartition("n", "piece")
    half = starts.withColumn("idx", F.explode(F.sequence(F.col("piece") * piece, F.least((F.col("piece") + 1) * piece, F.col("n")) - 1)))
    both = half.withColumns(dict(zip(("re", "im"), _chirp(-sign), strict=True))).withColumn("idx", F.explode(F.when(F.col("idx") > 0, F.array("idx", F.col("size") - F.col("idx"))).otherwise(F.array("idx"))))
    chirp = _lines(matrix(both.withColumn("rec", F.col("n"))), False).select(F.col("rec").alias("n"), "idx", F.col("re").alias("cre"), F.col("im").alias("cim"))
    met = _lines(matrix(turned), False).join(sized, "rec").join(chirp, ["n", "idx"])
    folded = _lines(matrix(met.select("rec", "size", "rows", "idx", *_times(z, (F.col("cre"), F.col("cim"))))), True)
    out = folded.join(lengths, "rec").where(F.col("idx") < F.col("n"))
    out = out.select("rec", "n", "idx", *_times(z, _chirp(sign)))
    total = F.col("n") if inverse else F.lit(1)
    return out.select("rec", "idx", (F.col("re") / total).alias("re"), (F.col("im") / total).alias("im"))


def transformed(values: DataFrame, lengths: DataFrame, inverse: bool = False) -> DataFrame:
    """rec, idx, re and im: the discrete Fourier transform of rec, idx, re and im, or its inverse, over each recording's length.

    `lengths` has rec and n, one row a recording. Indices that aren't there are 0. Lengths go up to SIDE squared, or half
    of it if no two sides up to SIDE have it as their product; longer recordings raise an error.
    """
    plan = stored(lengths.select("rec", "n", _rows(F.col("n")).alias("rows")))
    odd = plan.where("rows IS NULL").drop("rows")
    out = _lines(values.join(plan.where("rows IS NOT NULL"), "rec"), inverse)
    longest = odd.agg(F.max("n")).first()[0]
    if longest is None:
        return out
    if 4 * longest > SIDE * SIDE * 2:
        raise ValueError(f"a recording of {longest} samples is too long to transform")
    return out.unionByName(_chirped(values, odd, inverse))


def long_fft(samples: DataFrame, lengths: DataFrame, fs: float, window: str) -> DataFrame:
    """What spectral.fft() gives, of the recordings in `lengths` (rec, n), which have no gaps."""
    at = F.col("idx") / F.col("n") * (2 * np.pi)
    w = sum(c * F.cos(k * at) for k, c in enumerate(COSINES[window]))
    values = samples.join(lengths, "rec").select("rec", "idx", (F.col("value") * w).alias("re"), F.lit(0.0).alias("im"))
    half = transformed(values, lengths).join(lengths, "rec").where(F.col("idx") * 2 <= F.col("n"))
    twice = F.when((F.col("idx") == 0) | (F.col("idx") * 2 == F.col("n")), 1.0).otherwise(2.0)
    size = F.hypot("re", "im") / (F.col("n") * COSINES[window][0]) * twice
    out = half.select("rec", F.col("idx").cast("int").alias("bin"), (F.col("idx") * fs / F.col("n")).alias("freq"), size.alias("magnitude"), F.atan2("im", "re").alias("phase"))
    return out.withColumn("power", F.col("magnitude") * F.col("magnitude"))


def long_hilbert(samples: DataFrame, lengths: DataFrame, fs: float) -> DataFrame:
    """What spectral.hilbert() gives, of the recordings in `lengths` (rec, n), which have no gaps."""
    values = samples.join(lengths, "rec", "left_semi").select("rec", "idx", F.col("value").alias("re"), F.lit(0.0).alias("im"))
    kept = transformed(values, lengths).join(lengths, "rec").where(F.col("idx") * 2 <= F.col("n"))
    twice = F.when((F.col("idx") == 0) | (F.col("idx") * 2 == F.col("n")), 1.0).otherwise(2.0)
    z = transformed(kept.select("rec", "idx", (F.col("re") * twice).alias("re"), (F.col("im") * twice).alias("im")), lengths, inverse=True)
    z = stored(z.select("rec", "idx", F.hypot("re", "im").alias("envelope"), F.atan2("im", "re").alias("value")))
    step = F.col("value") - F.col("prev")
    turns = shifted(z, prev=-1).withColumn("turn", F.when(step > np.pi, -1).when(step < -np.pi, 1).otherwise(0)).withColumn("chunk", F.floor(F.col("idx") / F.lit(core.CHUNK)))
    # Whole turns so far: within a chunk, and of all chunks before it, one row a chunk.
    sums = turns.groupBy("rec", "chunk").agg(F.sum("turn").alias("own"))
    before = sums.select("rec", "chunk", (F.sum("own").over(Window.partitionBy("rec").orderBy("chunk")) - F.col("own")).alias("before"))
    so_far = F.sum("turn").over(Window.partitionBy("rec", "chunk").orderBy("idx"))
    phase = turns.withColumn("so_far", so_far).join(before, ["rec", "chunk"]).select("rec", "idx", "envelope", (F.col("value") + 2 * np.pi * (F.col("so_far") + F.col("before"))).alias("value"))
    near = shifted(phase, prev=-1, next=1)
    ahead, back = F.coalesce("next", "value"), F.coalesce("prev", "value")
    rate = (ahead - back) / F.when(F.col("next").isNull() | F.col("prev").isNull(), 1.0).otherwise(2.0)
    return near.select("rec", "idx", "envelope", F.col("value").alias("phase"), (rate / (2 * np.pi) * fs).alias("frequency"))
