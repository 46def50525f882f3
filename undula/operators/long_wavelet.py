"""The continuous wavelet transform of recordings that no task can hold.

Frequencies whose wavelet is no longer than core.LONG samples are taken chunk by chunk, with halos of the wavelet's length, octave
by octave, so that short wavelets don't read long halos. Longer wavelets are convolved by the Fourier transforms of fourier.py; their
integral is a step function of at most MOTHER_POINTS steps, so only its steps are handed to Spark.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula import core
from undula.core import chunked, stored
from undula.functions.signal import wavelet_kernel
from undula.operators.fourier import transformed

#: Samples in a chunk of short wavelets; chunks are at least as long as their halos.
LEAST = 1 << 13


def _by_chunks(samples: DataFrame, lengths: DataFrame, kernels: list[tuple[float, float, np.ndarray]]) -> DataFrame:
    kind = samples.schema["rec"].dataType.simpleString()
    reach = max(len(k) for _, _, k in kernels)
    size = max(LEAST, reach)
    near = chunked(samples.select("rec", "idx", "value"), reach, reach // 2 + 1, size).drop("owned").join(lengths, "rec").where((F.col("chunk") >= 0) & (F.col("chunk") * size < F.col("n")))

    def run(own: pd.DataFrame) -> pd.DataFrame:
        at, n, chunk = own["idx"].to_numpy(), int(own["n"].iloc[0]), int(own["chunk"].iloc[0])
        first, start, stop = int(at.min()), chunk * size, min((chunk + 1) * size, n)
        x = np.zeros(int(at.max()) - first + 1)
        x[at - first] = own["value"].to_numpy()
        made = []
        for freq, root, kernel in kernels:
            power = 1 << int(len(x) + len(kernel)).bit_length()
            both = np.fft.ifft(np.fft.fft(x, power) * np.fft.fft(kernel, power))
            from_ = start - first + max(0, (len(kernel) - 2) // 2)
            made.append(-root * np.diff(both[from_ : from_ + stop - start + 1]))
        z, width = np.concatenate(made), stop - start
        if not np.iscomplexobj(kernels[0][2]):
            z = z.real.astype(complex)
        freq, idx = np.repeat([k[0] for k in kernels], width), np.tile(np.arange(start, stop), len(kernels))
        return pd.DataFrame({"rec": own["rec"].iloc[0], "freq": freq, "idx": idx, "re": z.real, "im": z.imag})

    return near.groupBy("rec", "chunk").applyInPandas(run, f"rec {kind}, freq double, idx long, re double, im double")


def _by_transforms(samples: DataFrame, lengths: DataFrame, kernels: list[tuple[float, float, np.ndarray]]) -> DataFrame:
    """The kernel's steps, moved so that a coefficient stands at its sample; those too far to meet one are left out."""
    rows = []
    for freq, root, kernel in kernels:
        steps = np.diff(np.r_[0, kernel, 0])
        where = np.flatnonzero(steps)
        back = max(0, (len(kernel) - 2) // 2) + 1
        rows += [(float(freq), int(k) - back, float(-root * np.real(steps[k])), float(-root * np.imag(steps[k]))) for k in where]
    steps = samples.sparkSession.createDataFrame(rows, "freq double, s long, re double, im double")
    # Twice the length and more, so that what goes round doesn't meet.
    sized = stored(lengths.withColumn("size", F.expr("shiftleft(1L, length(bin(2 * n)))")))
    wide = sized.select("rec", F.col("size").alias("n"))
    spectra = transformed(samples.join(lengths, "rec", "left_semi").select("rec", "idx", F.col("value").alias("re"), F.lit(0.0).alias("im")), wide)
    keyed = F.to_json(F.struct("n", "freq"))
    all_freqs = F.explode(F.array(*(F.lit(float(f)) for f, _, _ in kernels)))
    each = stored(sized.select("n", "size").distinct().withColumn("freq", all_freqs).withColumn("rec", keyed))
    cells = each.join(F.broadcast(steps), "freq").where(F.abs("s") < F.col("n")).select("rec", F.pmod("s", "size").alias("idx"), "re", "im")
    kernel = transformed(cells, each.select("rec", F.col("size").alias("n"))).join(each, "rec").select("n", "freq", "idx", F.col("re").alias("kre"), F.col("im").alias("kim"))
    met = spectra.join(sized, "rec").join(kernel, ["n", "idx"])
    product = met.select("rec", "n", "size", "freq", "idx", (F.col("re") * F.col("kre") - F.col("im") * F.col("kim")).alias("re"), (F.col("re") * F.col("kim") + F.col("im") * F.col("kre")).alias("im"))
    kind = samples.schema["rec"].dataType.simpleString()
    name = F.to_json(F.struct("rec", "freq"))
    ids = sized.withColumn("freq", all_freqs).select(name.alias("key"), "rec", "freq", "n", "size")
    out = transformed(product.select(name.alias("rec"), "idx", "re", "im"), ids.select(F.col("key").alias("rec"), F.col("size").alias("n")), inverse=True)
    out = out.withColumnRenamed("rec", "key").join(ids, "key").where(F.col("idx") < F.col("n"))
    return out.select(F.col("rec").cast(kind).alias("rec"), "freq", "idx", "re", "im")


def long_wavelet(samples: DataFrame, lengths: DataFrame, freqs: list[float], fs: float, name: str) -> DataFrame:
    """What spectral.wavelet() gives, of the recordings in `lengths` (rec, n), which have no gaps."""
    near: dict[int, list] = {}
    far = []
    for f in freqs:
        root, kernel = wavelet_kernel(name, f, fs)
        if len(kernel) > core.LONG:
            far.append((f, root, kernel))
        else:
            near.setdefault(len(kernel).bit_length(), []).append((f, root, kernel))
    parts = [_by_chunks(samples, lengths, k) for k in near.values()] + ([_by_transforms(samples, lengths, far)] if far else [])
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("magnitude", F.hypot("re", "im"))
