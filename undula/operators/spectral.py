"""Spectra: segments are made by Spark, a batch of equal segments is transformed at once, and results are averaged by Spark.

Segments with missing values are left out, as are whole recordings with gaps where all of a recording is transformed: fill
them before. A recording shorter than a segment is one segment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undula.core import long_recordings, stored, to_arrays
from undula.functions.signal import WINDOWS, analytic, mother, one_sided, wavelet_kernel
from undula.operators.fourier import long_fft, long_hilbert
from undula.operators.long_wavelet import long_wavelet


def segments(samples: DataFrame, nperseg: int, overlap: float = 0.5) -> DataFrame:
    """rec, w, values: every full segment without gaps as an array, of `nperseg` samples or of all that a recording has. Samples
    may bring the recording's length along as `n`."""
    each = samples if "n" in samples.columns else samples.join(samples.groupBy("rec").agg((F.max("idx") + 1).alias("n")), "rec")
    each = each.withColumn("win", F.least("n", F.lit(nperseg)))
    each = each.withColumn("hop", F.greatest(F.lit(1), F.col("win") - F.floor(F.col("win") * overlap)))
    first = F.greatest(F.lit(0), F.ceil((F.col("idx") - F.col("win") + 1) / F.col("hop")))
    last = F.least(F.floor(F.col("idx") / F.col("hop")), F.floor((F.col("n") - F.col("win")) / F.col("hop")))
    each = each.where(first <= last).withColumn("w", F.explode(F.sequence(first, last)))
    pairs = F.array_sort(F.collect_list(F.struct("idx", "value")))
    whole = each.groupBy("rec", "w").agg(F.transform(pairs, lambda p: p["value"]).alias("values"), F.max("win").alias("win"))
    return whole.where(F.size("values") == F.col("win")).where(F.forall("values", lambda v: v.isNotNull())).drop("win")


def whole(samples: DataFrame) -> DataFrame:
    """Recordings without gaps as arrays."""
    return to_arrays(samples).where(F.forall("values", lambda v: v.isNotNull()))


def _by_length(samples: DataFrame, short: Callable[[DataFrame], DataFrame], long: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Recordings of up to core.LONG samples by `short`, those of more without gaps by `long`, which gets their lengths, too."""
    many = long_recordings(samples)
    if many is None:
        return short(samples)
    samples = stored(samples)
    own = samples.join(many, "rec", "left_semi")
    lengths = stored(own.groupBy("rec").agg(F.count("*").alias("n"), F.count("value").alias("present")).where("n = present").drop("present"))
    return short(samples.join(many, "rec", "left_anti")).unionByName(long(own, lengths))


def _by_batch(rows: DataFrame, f: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """Each row's `values` replaced by arrays that `f` makes of all rows of a batch with the same length."""
    keys = [c for c in rows.columns if c != "values"]
    head = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, own in batch.groupby(batch["values"].map(len), sort=False):
                made = f(np.stack([np.asarray(v, float) for v in own["values"]]))
                yield own[keys].assign(**{k: list(v) for k, v in made.items()})

    return rows.mapInPandas(run, f"{head}, {schema}")


def fft(samples: DataFrame, fs: float = 1.0, window: str = "hann") -> DataFrame:
    """rec, bin, freq, magnitude (the amplitude of a sine), phase and power of whole recordings, of any length: see fourier.py."""
    return _by_length(samples, lambda s: _short_fft(s, fs, window), lambda s, lengths: long_fft(s, lengths, fs, window))


def _short_fft(samples: DataFrame, fs: float, window: str) -> DataFrame:

    def spectrum(x: np.ndarray) -> dict[str, np.ndarray]:
        w = WINDOWS[window](x.shape[1])
        z = np.fft.rfft(x * w)
        m = np.abs(z) / w.sum() * one_sided(x.shape[1])
        return {"magnitude": m, "phase": np.angle(z), "n": np.full(len(x), x.shape[1])}

    rows = _by_batch(whole(samples), spectrum, "magnitude array<double>, phase array<double>, n long")
    each = rows.select("rec", "n", F.posexplode(F.arrays_zip("magnitude", "phase")).alias("bin", "z"))
    return each.select("rec", "bin", (F.col("bin") * fs / F.col("n")).alias("freq"), "z.magnitude", "z.phase", (F.col("z.magnitude") * F.col("z.magnitude")).alias("power"))


def welch(samples: DataFrame, fs: float = 1.0, nperseg: int | None = None, overlap: float = 0.5, window: str = "hann") -> DataFrame:
    """rec, bin, freq and psd: periodograms of mean-free, half-overlapping segments, averaged over all of a recording. A segment
    has two seconds, eight samples at least, unless `nperseg` says otherwise."""

    def periodogram(x: np.ndarray) -> dict[str, np.ndarray]:
        w = WINDOWS[window](x.shape[1])
        p = np.abs(np.fft.rfft((x - x.mean(1, keepdims=True)) * w)) ** 2 / (fs * max((w * w).sum(), 1e-300)) * one_sided(x.shape[1])
        return {"p": p, "n": np.full(len(x), x.shape[1])}

    rows = _by_batch(segments(samples, nperseg or int(max(2 * fs, 8)), overlap), periodogram, "p array<double>, n long")
    each = rows.select("rec", "n", F.posexplode("p").alias("bin", "p"))
    return each.groupBy("rec", "bin", "n").agg(F.avg("p").alias("psd")).select("rec", "bin", (F.col("bin") * fs / F.col("n")).alias("freq"), "psd")


def coherence(a: DataFrame, b: DataFrame, fs: float = 1.0, nperseg: int = 256) -> DataFrame:
    """rec, bin, freq and the magnitude-squared coherence of two signals of the same recordings."""
    pairs = segments(a, nperseg).join(segments(b, nperseg).withColumnRenamed("values", "other"), ["rec", "w"])
    both = pairs.where(F.size("values") == F.size("other")).select("rec", "w", F.concat("values", "other").alias("values"))

    def cross(x: np.ndarray) -> dict[str, np.ndarray]:
        n = x.shape[1] // 2
        w = WINDOWS["hann"](n)
        za, zb = (np.fft.rfft((y - y.mean(1, keepdims=True)) * w) for y in (x[:, :n], x[:, n:]))
        z = za.conj() * zb
        return {"aa": np.abs(za) ** 2, "bb": np.abs(zb) ** 2, "re": z.real, "im": z.imag, "n": np.full(len(x), n)}

    rows = _by_batch(both, cross, "aa array<double>, bb array<double>, re array<double>, im array<double>, n long")
    each = rows.select("rec", "n", F.posexplode(F.arrays_zip("aa", "bb", "re", "im")).alias("bin", "z"))
    m = each.groupBy("rec", "bin", "n").agg(*(F.avg(f"z.{c}").alias(c) for c in ("aa", "bb", "re", "im")))
    value = F.try_divide(F.col("re") * F.col("re") + F.col("im") * F.col("im"), F.col("aa") * F.col("bb"))
    return m.select("rec", "bin", (F.col("bin") * fs / F.col("n")).alias("freq"), value.alias("coherence"))


def coherence_peak(coherence: DataFrame, low: float, high: float) -> DataFrame:
    """rec, the mean coherence over a closed band, and the frequency at which it is largest, the mean aside."""
    inside = F.col("freq").between(low, high)
    return coherence.groupBy("rec").agg(F.avg(F.when(inside, F.col("coherence"))).alias("band_mean"), F.max_by("freq", F.when(F.col("freq") > 0, F.struct("coherence", -F.col("freq")))).alias("peak_frequency"))


def band_powers(psd: DataFrame, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """Trapezoid areas of the psd over closed bands, all power, and each band's share, for every recording."""
    w = Window.partitionBy("rec").orderBy("freq")
    p = psd.withColumns({"low": F.lag("freq").over(w), "area": (F.col("psd") + F.lag("psd").over(w)) / 2 * (F.col("freq") - F.lag("freq").over(w))})
    parts = {name: F.coalesce(F.sum(F.when((F.col("low") >= lo) & (F.col("freq") <= hi), F.col("area"))), F.lit(0.0)) for name, (lo, hi) in bands.items()}
    out = p.groupBy("rec").agg(F.sum("area").alias("total_power"), F.max_by("freq", F.struct("psd", -F.col("freq"))).alias("peak_frequency"), *(c.alias(f"{n}_power") for n, c in parts.items()))
    return out.withColumns({f"{n}_share": F.col(f"{n}_power") / (F.col("total_power") + 1e-300) for n in bands})


def to_db(psd: DataFrame) -> DataFrame:
    return psd.withColumn("db", 10 * F.log10(F.col("psd") + 1e-300))


def stft(samples: DataFrame, fs: float = 1.0, nperseg: int = 256, overlap: float = 0.5) -> DataFrame:
    """rec, w, t, bin, freq, re, im and magnitude of segments around every hop, scaled so that a sine shows half its amplitude.

    A recording is continued by half a segment of zeros on both sides, and by zeros up to a full last segment, so the segment
    w is centred at w hops from the start. One shorter than a segment has segments of its own length.
    """
    n = samples.groupBy("rec").agg((F.max("idx") + 1).alias("n"), F.count_if(F.col("value").isNull()).alias("gaps")).where("gaps = 0")
    x = samples.join(n, "rec").withColumn("win", F.least("n", F.lit(nperseg)))
    x = x.withColumn("hop", F.greatest(F.lit(1), F.col("win") - F.floor(F.col("win") * overlap))).withColumn("half", F.floor(F.col("win") / 2))
    count = F.greatest(F.lit(0), F.ceil((F.col("n") + 2 * F.col("half") - F.col("win")) / F.col("hop")))
    at = F.col("idx") + F.col("half")
    first, last = F.greatest(F.lit(0), F.ceil((at - F.col("win") + 1) / F.col("hop"))), F.least(F.floor(at / F.col("hop")), count)
    each = x.where(first <= last).withColumn("w", F.explode(F.sequence(first, last))).withColumn("pos", at - F.col("w") * F.col("hop"))
    pairs = F.array_sort(F.collect_list(F.struct("pos", "value")))
    rows = each.groupBy("rec", "w", "win", "hop").agg(pairs.alias("p"))
    zero = F.array_repeat(F.lit(0.0), F.col("p")[0]["pos"].cast("int"))
    filled = F.concat(zero, F.transform("p", lambda p: p["value"]))
    rows = rows.withColumn("values", F.concat(filled, F.array_repeat(F.lit(0.0), (F.col("win") - F.size(filled)).cast("int")))).drop("p")

    def run(x: np.ndarray) -> dict[str, np.ndarray]:
        w = WINDOWS["hann"](x.shape[1])
        z = np.fft.rfft(x * w) / max(w.sum(), 1e-300)
        return {"re": z.real, "im": z.imag}

    made = _by_batch(rows, run, "re array<double>, im array<double>")
    each = made.select("rec", "w", "win", "hop", F.posexplode(F.arrays_zip("re", "im")).alias("bin", "z"))
    magnitude = F.sqrt(F.col("z.re") * F.col("z.re") + F.col("z.im") * F.col("z.im"))
    return each.select("rec", "w", (F.col("w") * F.col("hop") / fs).alias("t"), "bin", (F.col("bin") * fs / F.col("win")).alias("freq"), "z.re", "z.im", magnitude.alias("magnitude"))


def stft_mean(transform: DataFrame) -> DataFrame:
    """rec, freq and the mean magnitude over time; db is that of each point: 20 log10(magnitude + 1e-12)."""
    return transform.groupBy("rec", "freq").agg(F.avg("magnitude").alias("magnitude"))


def spectrogram_db(transform: DataFrame) -> DataFrame:
    return transform.withColumn("db", 20 * F.log10(F.col("magnitude") + 1e-12))


def hilbert(samples: DataFrame, fs: float = 1.0) -> DataFrame:
    """rec, idx, envelope, phase (unwrapped) and frequency of whole recordings, of any length: see fourier.py."""
    return _by_length(samples, lambda s: _short_hilbert(s, fs), lambda s, lengths: long_hilbert(s, lengths, fs))


def _short_hilbert(samples: DataFrame, fs: float) -> DataFrame:

    def run(x: np.ndarray) -> dict[str, np.ndarray]:
        z = analytic(x)
        phase = np.unwrap(np.angle(z))
        rate = np.gradient(phase, axis=1) if phase.shape[1] > 1 else np.zeros_like(phase)
        return {"envelope": np.abs(z), "phase": phase, "frequency": rate / (2 * np.pi) * fs}

    rows = _by_batch(whole(samples), run, "envelope array<double>, phase array<double>, frequency array<double>")
    each = rows.select("rec", F.posexplode(F.arrays_zip("envelope", "phase", "frequency")).alias("idx", "z"))
    return each.select("rec", F.col("idx").cast("long").alias("idx"), "z.envelope", "z.phase", "z.frequency")


def envelope_stats(analytic_signal: DataFrame) -> DataFrame:
    """rec and the mean and the largest envelope."""
    return analytic_signal.groupBy("rec").agg(F.avg("envelope").alias("mean_envelope"), F.max("envelope").alias("peak_envelope"))


def scale_frequencies(fs: float, n: int, n_scales: int = 64, low: float | None = None, high: float | None = None, spacing: str = "log") -> list[float]:
    """Frequencies from `low` (four periods in n samples) to `high` (0.4 fs), in equal ratios or steps."""
    low, high = low or 4 * fs / n, high or 0.4 * fs
    return (np.geomspace if spacing == "log" else np.linspace)(low, high, n_scales).tolist()


def wavelet(samples: DataFrame, freqs: list[float], fs: float = 1.0, name: str = "cmor1.5-1.0") -> DataFrame:
    """rec, freq, idx, re, im and magnitude of the continuous wavelet transform with cmor<bandwidth>-<centre>, morl, mexh or gaus1.

    The coefficient at a scale is the difference of the samples' correlation with the wavelet's integral, stretched to the
    scale, times the root of the scale; the integral is tabulated at MOTHER_POINTS points. Recordings may have any length: see
    long_wavelet.py.
    """
    mother(name)
    if not freqs or min(freqs) <= 0:
        raise ValueError("there have to be frequencies above 0")
    return _by_length(samples, lambda s: _short_wavelet(s, freqs, fs, name), lambda s, lengths: long_wavelet(s, lengths, freqs, fs, name))


def _short_wavelet(samples: DataFrame, freqs: list[float], fs: float, name: str) -> DataFrame:
    kernels = [wavelet_kernel(name, f, fs) for f in freqs]

    def run(x: np.ndarray) -> dict[str, np.ndarray]:
        n, rows = x.shape[1], []
        for root, kernel in kernels:
            size = 1 << int(n + len(kernel) - 1).bit_length()
            both = np.fft.ifft(np.fft.fft(x, size) * np.fft.fft(kernel, size))[:, : n + len(kernel) - 1]
            coefficients = -root * np.diff(both, axis=1)
            spare = (coefficients.shape[1] - n) / 2
            rows.append(coefficients[:, int(np.floor(spare)) : coefficients.shape[1] - int(np.ceil(spare))] if spare > 0 else np.pad(coefficients, ((0, 0), (0, n - coefficients.shape[1]))))
        z = np.stack(rows, 1).reshape(len(x), -1)
        return {"re": z.real, "im": z.imag if np.iscomplexobj(kernels[0][1]) else np.zeros_like(z.real), "n": np.full(len(x), n)}

    made = _by_batch(whole(samples), run, "re array<double>, im array<double>, n long")
    each = made.select("rec", "n", F.posexplode(F.arrays_zip("re", "im")).alias("k", "z"))
    freq = F.element_at(F.array(*map(F.lit, freqs)), (F.floor(F.col("k") / F.col("n")) + 1).cast("int"))
    magnitude = F.sqrt(F.col("z.re") * F.col("z.re") + F.col("z.im") * F.col("z.im"))
    return each.select("rec", freq.alias("freq"), (F.col("k") % F.col("n")).alias("idx"), "z.re", "z.im", magnitude.alias("magnitude"))


def scalogram(transform: DataFrame) -> DataFrame:
    """The power of each coefficient."""
    return transform.withColumn("power", F.col("magnitude") * F.col("magnitude"))


def over_scales(transform: DataFrame) -> DataFrame:
    """rec, idx and the mean magnitude over all frequencies: the transform as a signal."""
    return transform.groupBy("rec", "idx").agg(F.avg("magnitude").alias("value"))


def peak_frequency(spectrum: DataFrame) -> DataFrame:
    """rec and the frequency of the largest magnitude, the mean aside."""
    return spectrum.where("freq > 0").groupBy("rec").agg(F.max_by("freq", F.struct("magnitude", -F.col("freq"))).alias("peak_frequency"))


def band_power(spectrum: DataFrame, low: float, high: float) -> DataFrame:
    """rec and the sum of the power of the bins in a closed band; 0 without any."""
    return spectrum.groupBy("rec").agg(F.coalesce(F.sum(F.when(F.col("freq").between(low, high), F.col("power"))), F.lit(0.0)).alias("band_power"))


def dominant(spectrum: DataFrame, n: int = 1) -> DataFrame:
    """The n strongest bins of each recording, the mean aside."""
    w = Window.partitionBy("rec").orderBy(F.desc("magnitude"), "freq")
    return spectrum.where("freq > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
