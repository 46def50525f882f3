"""Filters: recordings are cut into chunks with halos, a batch of equal chunks is filtered at once, and the owned samples stay.

A recording too short for a filter comes out missing, and so do the samples that a gap reaches, up to all of its recording:
fill gaps before. A recursive filter that remembers more than part of a chunk has no halo: its memories are carried from
chunk to chunk, see _carried().
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula import core
from undula.core import CHUNK, chunked, stored
from undula.functions.signal import butterworth, notch, resampling_taps, savgol_taps, sections, sections_from, settle_length, steady, transition, windowed_sinc
from undula.operators.outliers import rolling_median


def chunk_rows(samples: DataFrame, before: int, after: int, size: int) -> DataFrame:
    """rec, chunk, first and values: every chunk of `size` samples as an array with its halo, and the index that it begins at."""
    pairs = F.array_sort(F.collect_list(F.struct("idx", "value")))
    rows = chunked(samples.select("rec", "idx", "value"), before, after, size).groupBy("rec", "chunk").agg(F.max("owned").alias("any"), pairs.alias("p"))
    return rows.where("any").select("rec", "chunk", F.col("p")[0]["idx"].alias("first"), F.transform("p", lambda p: p["value"]).alias("values"))


def _in_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive samples of each batch as one row: rec, first and values."""

    def cut(batch: pa.RecordBatch) -> np.ndarray:
        rec, idx = batch["rec"], batch["idx"].to_numpy()
        other = pc.fill_null(pc.not_equal(rec[1:], rec[:-1]), True).to_numpy(zero_copy_only=False)
        return np.flatnonzero(np.r_[True, other | (idx[1:] != idx[:-1] + 1)])

    for batch in batches:
        if not batch.num_rows:
            continue
        starts = cut(batch)
        if len(starts) > batch.num_rows // 8:  # out of order, most likely
            batch = batch.sort_by([("rec", "ascending"), ("idx", "ascending")])
            starts = cut(batch)
        values = pa.array(batch["value"].to_numpy(zero_copy_only=False))
        runs = pa.ListArray.from_arrays(pa.array(np.r_[starts, batch.num_rows], pa.int32()), values)
        yield pa.RecordBatch.from_arrays([batch["rec"].take(pa.array(starts)), pa.array(batch["idx"].to_numpy()[starts]), runs], names=["rec", "first", "values"])


def run_rows(samples: DataFrame, before: int, after: int, size: int) -> DataFrame:
    """As chunk_rows(), of samples of which most come one after the other: runs of them are dealt out, in a third of the bytes.
    Halos may be longer, and missing values are NaN. Samples that are in runs already are dealt out as they are."""
    runs = samples
    if "values" not in samples.columns:
        runs = samples.select("rec", F.col("idx").cast("long").alias("idx"), "value").mapInArrow(_in_runs, f"rec {samples.schema['rec'].dataType.simpleString()}, first long, values array<double>")
    last, n = F.col("first") + F.size("values") - 1, F.lit(size)
    cut = runs.withColumn("chunk", F.explode(F.sequence(F.floor((F.col("first") - after) / n), F.floor((last + before) / n))))
    own = (F.floor(F.col("first") / n) <= F.col("chunk")) & (F.col("chunk") <= F.floor(last / n))
    rows = cut.groupBy("rec", "chunk").agg(F.max(own).alias("any"), F.array_sort(F.collect_list(F.struct("first", "values"))).alias("p"))
    return rows.where("any").select("rec", "chunk", F.col("p")[0]["first"].alias("first"), F.flatten(F.transform("p", lambda p: p["values"])).alias("values"))


def written_rows(samples: DataFrame) -> DataFrame:
    """rec, chunk, first and values: run_rows() without halos, written, for what is read more than once."""
    n = F.lit(core.CHUNK)
    skip = F.greatest(F.col("chunk") * n - F.col("first"), F.lit(0)).cast("int")  # a run goes on beyond its chunk
    own = F.when((skip == 0) & (F.size("values") <= n), F.col("values")).otherwise(F.slice("values", skip + 1, n))
    return stored(run_rows(samples, 0, 0, core.CHUNK).select("rec", "chunk", (F.col("first") + skip).alias("first"), own.alias("values")))


def whole_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Of written_rows(): rec and values of each recording of one chunk, and the samples of longer ones in runs, None if there are
    none. Samples aren't dealt out for it."""
    longer = rows.where("chunk > 0").select("rec").distinct()
    if longer.isEmpty():
        return rows.select("rec", "values"), None
    return rows.join(longer, "rec", "left_anti").select("rec", "values"), rows.join(longer, "rec", "left_semi").select("rec", "first", "values")


def _chunkwise(samples: DataFrame, before: int, after: int, f: Callable[[np.ndarray], np.ndarray], chunk: int | None = None) -> DataFrame:
    """`f` over each chunk's rows of values, its halo included; missing values must be filled before."""
    size = chunk or CHUNK
    rows = chunk_rows(samples, before, after, size)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, own in batch.groupby(batch["values"].map(len), sort=False):
                made = f(np.stack([np.asarray(v, float) for v in own["values"]]))
                yield own.assign(values=list(made))

    done = rows.mapInPandas(run, f"rec {samples.schema['rec'].dataType.simpleString()}, chunk long, first long, values array<double>")
    each = done.select("rec", "chunk", "first", F.posexplode("values").alias("pos", "value"))
    each = each.select("rec", "chunk", (F.col("first") + F.col("pos")).alias("idx"), "value")
    each = each.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    return each.where(F.floor(F.col("idx") / size) == F.col("chunk")).drop("chunk")


def _both_ways(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward, each from the steady state, the ends continued by reflection through them."""
    pad = _pad(sos)
    if x.shape[1] <= pad:
        return np.full(x.shape, np.nan)
    wide = np.concatenate([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]], axis=1)
    back = sections(sos, sections(sos, wide, True)[:, ::-1], True)[:, ::-1]
    return back[:, pad:-pad]


def both_ways_each(sos: np.ndarray, rows: list[np.ndarray]) -> list[np.ndarray]:
    """_both_ways() of each of some rows of any lengths. Those up to twice as long as each other go at once, the shorter ones
    followed by zeros, which come after all that counts."""
    pad, made = _pad(sos), [np.full(len(x), np.nan) for x in rows]
    alike: dict[int, list[int]] = {}
    for i, x in enumerate(rows):
        if len(x) > pad:
            alike.setdefault(len(x).bit_length(), []).append(i)

    def passed(some: list[np.ndarray]) -> list[np.ndarray]:
        """Through the sections, and turned round."""
        size = max(map(len, some))
        y = sections(sos, np.stack([np.pad(x, (0, size - len(x))) for x in some]), True)
        return [y[i, : len(x)][::-1] for i, x in enumerate(some)]

    for places in alike.values():
        wide = [np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]) for x in map(rows.__getitem__, places)]
        for i, y in zip(places, passed(passed(wide)), strict=True):
            made[i] = y[pad:-pad]
    return made


def _recursive(samples: DataFrame, sos: np.ndarray, zero_phase: bool, chunk: int | None) -> DataFrame:
    """A halo as long as the filter remembers, to 1e-10, makes chunks independent; if it is longer than HALO of a chunk, the
    memories are carried instead."""
    reach = settle_length(sos)
    if reach > HALO * (chunk or CHUNK):
        return _carried(samples, sos, zero_phase, chunk or CHUNK)
    if zero_phase:
        return _chunkwise(samples, reach, reach, lambda x: _both_ways(sos, x), chunk)
    return _chunkwise(samples, reach, 0, lambda x: sections(sos, x), chunk)


#: The longest halo, as a share of a chunk, that is still read along with each chunk.
HALO = 0.25


def _pad(sos: np.ndarray) -> int:
    return 3 * (2 * len(sos) + 1 - min(int((sos[:, 2] == 0).sum()), int((sos[:, 4] == 0).sum())))


def _reflected(samples: DataFrame, pad: int) -> DataFrame:
    """Recordings of more than `pad` samples, continued by so many at either end by reflection through it, numbered from 0."""
    v, idx, n = F.col("value"), F.col("idx"), F.col("n")
    ends = samples.groupBy("rec").agg((F.max("idx") + 1).alias("n"), F.min_by("value", "idx").alias("head"), F.max_by("value", "idx").alias("tail"))
    each = samples.join(ends.where(n > pad), "rec")
    at = lambda i, x: F.struct(i.cast("long").alias("idx"), x.alias("value"))
    rows = F.array(at(idx + pad, v), F.when((idx >= 1) & (idx <= pad), at(pad - idx, 2 * F.col("head") - v)), F.when((idx <= n - 2) & (idx >= n - 1 - pad), at(pad + 2 * (n - 1) - idx, 2 * F.col("tail") - v)))
    return each.select("rec", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("rec", "r.idx", "r.value")


def _states_in(ends: DataFrame, sos: np.ndarray, settled: bool, back: bool) -> DataFrame:
    """(rec, chunk, state) before each chunk, from (rec, chunk, n, edge, left): what a chunk of n samples leaves in memories that
    were empty before. One row a chunk goes, in order, through the affine maps state -> transition(n) state + left; `edge` is
    the value whose steady state a recording starts from."""
    rec = ends.schema["rec"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, powers, last, z = steady(sos).reshape(-1), {}, None, None
        for batch in batches:
            states = []
            for r, n, edge, left in zip(batch["rec"], batch["n"], batch["edge"], batch["left"], strict=True):
                if z is None or r != last:
                    z, last = (first * edge if settled else np.zeros(len(first))), r
                states.append(z)
                if n not in powers:
                    powers[n] = transition(sos, n)
                z = powers[n] @ z + left
            yield batch[["rec", "chunk"]].assign(state=states)

    order = F.desc("chunk") if back else F.asc("chunk")
    return ends.select("rec", "chunk", "n", "edge", "left").repartition("rec").sortWithinPartitions("rec", order).mapInPandas(run, f"rec {rec}, chunk long, state array<double>")


def _carried(samples: DataFrame, sos: np.ndarray, zero_phase: bool, size: int) -> DataFrame:
    """The filter by a scan of its memories, whatever it remembers: chunks first tell what they leave in empty memories, the
    affine maps of a recording's chunks are composed in order, and each chunk is filtered from the memories before it; for zero
    phase the same once more from the end. So a sample is read three times at any cut-off."""
    pad = _pad(sos) if zero_phase else 0
    rec = samples.schema["rec"].dataType.simpleString()
    wide = _reflected(samples, pad) if pad else samples.select("rec", "idx", "value")
    pairs = F.array_sort(F.collect_list(F.struct("idx", F.coalesce("value", F.lit(float("nan"))).alias("value"))))
    rows = stored(wide.groupBy("rec", F.floor(F.col("idx") / size).alias("chunk")).agg(F.transform(pairs, lambda p: p["value"]).alias("values")))
    told = f"rec {rec}, chunk long, n long, edge double, left array<double>"

    def alike(batch: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
        for _, own in batch.groupby(batch["values"].map(len), sort=False):
            yield own, np.stack([np.asarray(v, float) for v in own["values"]])

    def left_by(own: pd.DataFrame, x: np.ndarray) -> dict:
        end = sections_from(sos, x, np.zeros((len(x), len(sos), 2)))[1].reshape(len(x), -1)
        return {"n": x.shape[1], "edge": x[:, 0], "left": list(end)}

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for own, x in alike(batch):
                yield own[["rec", "chunk"]].assign(**left_by(own, x))

    def passed(back: bool, probed: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for own, x in alike(batch):
                    x = x[:, ::-1] if back else x
                    y = sections_from(sos, x, np.stack([np.asarray(s, float) for s in own["state"]]).reshape(len(x), -1, 2))[0]
                    y = y[:, ::-1] if back else y
                    more = left_by(own, y[:, ::-1]) if probed else {}
                    yield own[["rec", "chunk"]].assign(**more, values=list(y))

        return run

    states = _states_in(rows.mapInPandas(probe, told), sos, zero_phase, False)
    kinds = f"{told}, values array<double>" if zero_phase else f"rec {rec}, chunk long, values array<double>"
    made = rows.join(states, ["rec", "chunk"]).mapInPandas(passed(False, zero_phase), kinds)
    if zero_phase:
        made = stored(made)
        states = _states_in(made, sos, True, True)
        made = made.select("rec", "chunk", "values").join(states, ["rec", "chunk"]).mapInPandas(passed(True, False), f"rec {rec}, chunk long, values array<double>")
    each = made.select("rec", "chunk", F.posexplode("values").alias("pos", "value")).select("rec", (F.col("chunk") * size + F.col("pos") - pad).alias("idx"), F.when(~F.isnan("value"), F.col("value")).alias("value"))
    if not pad:
        return each
    return samples.select("rec", "idx").join(each, ["rec", "idx"], "left").select("rec", "idx", "value")


def butter(samples: DataFrame, kind: str, cutoff: float | tuple[float, float], fs: float, order: int = 4, zero_phase: bool = True, chunk: int | None = None) -> DataFrame:
    """A Butterworth lowpass, highpass, bandpass or bandstop."""
    return _recursive(samples, butterworth(order, kind, cutoff, fs), zero_phase, chunk)


def notch_filter(samples: DataFrame, freq: float, fs: float, quality: float = 30.0, harmonics: int = 1, zero_phase: bool = True) -> DataFrame:
    """Take out `freq` and its harmonics below half the sampling rate."""
    for k in range(1, harmonics + 1):
        if freq * k < fs / 2:
            samples = _recursive(samples, notch(freq * k, quality, fs), zero_phase, None)
    return samples


def fir_filter(samples: DataFrame, cutoff: float | tuple[float, float], fs: float, kind: str = "lowpass", taps: int = 101) -> DataFrame:
    """A windowed-sinc filter, forward and backward; `taps` is made odd and recordings need more than 3 * taps samples."""
    h = windowed_sinc(taps | 1, kind, cutoff, fs)
    pad = 3 * len(h)

    def run(x: np.ndarray) -> np.ndarray:
        if x.shape[1] <= pad:
            return np.full(x.shape, np.nan)
        wide = np.concatenate([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]], axis=1)
        both = np.convolve(h, h[::-1])
        return np.stack([np.convolve(r, both, "same") for r in wide])[:, pad:-pad]

    return _chunkwise(samples, pad, pad, run)


def savgol(samples: DataFrame, window: int = 11, order: int = 3) -> DataFrame:
    """Least-squares polynomials over the window around each sample; at the ends, the polynomial of the first or last window."""
    window |= 1
    half, h = window // 2, savgol_taps(window, order)
    basis = np.vander(np.arange(window), order + 1)

    def run(x: np.ndarray) -> np.ndarray:
        if x.shape[1] < window:
            return np.full(x.shape, np.nan)
        out = np.stack([np.convolve(r, h[::-1], "same") for r in x])
        fit = basis @ np.linalg.pinv(basis)
        out[:, :half] = x[:, :window] @ fit[:half].T
        out[:, -half:] = x[:, -window:] @ fit[-half:].T
        return out

    return _chunkwise(samples, window, window, run)


def median_filter(samples: DataFrame, kernel: int = 5) -> DataFrame:
    return rolling_median(samples, kernel).select("rec", "idx", F.col("med").alias("value"))


def resample(samples: DataFrame, fs: float, target: float, chunk: int | None = None) -> DataFrame:
    """The samples at another rate: by up / down, the fraction nearest to target / fs with a denominator of at most 1000.

    Each new sample is a weighted sum of the old ones around it, beyond the ends of zeros; a recording of n has
    ceil(n * up / down) of them. Chunks of the new samples ask for the old ones that they need.
    """
    rate = Fraction(target / fs).limit_denominator(1000)
    up, down = rate.numerator, rate.denominator
    h = resampling_taps(up, down)
    half, size = len(h) // 2, chunk or CHUNK
    reach = half // up + 1
    n = samples.groupBy("rec").agg((F.max("idx") + 1).alias("n"))
    low, high = F.greatest(F.lit(0), F.floor((F.col("idx") - reach) * up / down / size)), F.floor((F.col("idx") + reach) * up / down / size)
    rows = samples.join(n, "rec").withColumn("chunk", F.explode(F.sequence(low, high)))
    pairs = F.array_sort(F.collect_list(F.struct("idx", "value")))
    rows = rows.groupBy("rec", "n", "chunk").agg(pairs.alias("p"))
    rows = rows.select("rec", "n", "chunk", F.col("p")[0]["idx"].alias("first"), F.transform("p", lambda p: p["value"]).alias("values"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                new = np.arange(r.chunk * size, min((r.chunk + 1) * size, -(-r.n * up // down)), dtype=np.int64)
                x, out = np.asarray(r.values, float), np.zeros(len(new))
                centre = new * down
                for k in range(-(half // up) - 1, half // up + 2):
                    old = centre // up + k
                    tap = centre - old * up + half
                    ok = (tap >= 0) & (tap < len(h)) & (old >= 0) & (old < r.n)
                    out[ok] += h[tap[ok]] * x[old[ok] - r.first]
                yield pd.DataFrame({"rec": [r.rec] * len(new), "idx": new, "value": out})

    made = rows.mapInPandas(run, f"rec {samples.schema['rec'].dataType.simpleString()}, idx long, value double")
    return made.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def frequency_response(sos: np.ndarray, fs: float, points: int = 512) -> list[tuple[float, float, float]]:
    """(frequency, magnitude, phase) of sections, to look at before a filter is used."""
    f = np.linspace(0, fs / 2, points, endpoint=False)
    e = np.exp(-2j * np.pi * np.outer(f / fs, np.arange(3)))
    h = np.prod([(e @ np.array(s[:3])) / (e @ np.r_[1.0, s[3:]]) for s in sos], axis=0)
    return list(zip(f.tolist(), np.abs(h).tolist(), np.unwrap(np.angle(h)).tolist(), strict=True))
