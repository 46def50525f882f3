"""Heartbeats: detection, scoring against known beats, and the variability of the intervals between them.

Filtering, squaring, averaging and the search for local maxima run over chunks of samples; only the few samples that may be
beats, some a second, meet the sequential rules, a stretch of SEGMENT seconds with a lead-in at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undula import core
from undula.core import chunked, from_runs, over_chunks, owned, shifted, stored
from undula.functions.signal import butterworth, settle_length
from undula.operators.filtering import _both_ways, both_ways_each, run_rows, whole_rows

#: Seconds of a recording that one task decides on, and seconds ahead of them from which it learns its thresholds. Recordings
#: up to that length are decided on as a whole.
SEGMENT, LEAD = 3 * 3600, 30
#: Samples in a level stretch whose middle counts as a peak, at most.
LEVEL = 1 << 10


def maxima(samples: DataFrame) -> DataFrame:
    """The samples higher than both neighbours; of a level stretch between lower samples, up to LEVEL samples long, the middle
    one. The ends are none."""
    w = over_chunks()
    s = chunked(samples, LEVEL, LEVEL)
    s = s.withColumns({"prev": F.lag("value").over(w), "next": F.lead("value").over(w)})
    s = s.withColumns({"rise": F.col("prev") < F.col("value"), "change": F.col("next") != F.col("value")})
    here = F.when(F.col("change"), F.struct(F.col("idx").alias("end"), (F.col("next") < F.col("value")).alias("falls")))
    s = s.withColumn("level", F.last(here, True).over(Window.partitionBy("rec", "chunk").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, 0)))
    top = owned(s).where(F.col("rise") & F.col("level.falls"))
    return top.select("rec", F.floor((F.col("idx") + F.col("level.end")) / 2).alias("idx"), "value")


def thinned(idx: np.ndarray, height: np.ndarray, distance: float) -> np.ndarray:
    """Which of the peaks stay when the highest take their surroundings: none is nearer than `distance` to a higher one."""
    stay = np.ones(len(idx), bool)
    first, last = np.searchsorted(idx, idx - distance, "right").tolist(), np.searchsorted(idx, idx + distance, "left").tolist()
    for i in np.argsort(height, kind="stable")[::-1].tolist():
        if stay[i]:
            stay[first[i] : last[i]] = False
            stay[i] = True
    return stay


def _by_stretch(candidates: DataFrame, fs: float, decide, schema: str) -> DataFrame:
    """`decide` over each stretch of a recording's candidates with their lead-in, and of its choice what lies in the stretch."""
    size, lead = int(SEGMENT * fs), int(LEAD * fs)
    last = F.floor((F.col("idx") + lead) / size)
    cut = candidates.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("idx") / size), last)))

    def run(own: pd.DataFrame) -> pd.DataFrame:
        chosen = decide(own.sort_values("idx", ignore_index=True))
        chosen = chosen[chosen["idx"] // size == own["stretch"].iloc[0]]
        return chosen[["rec", "idx"]]

    return cut.groupBy("rec", "stretch").applyInPandas(run, schema)


def highest(peaks: DataFrame, fs: float, distance: float) -> DataFrame:
    """rec, idx: the peaks that thinned() leaves of each stretch of a recording; many stretches go to a task as a batch."""
    size, lead = int(SEGMENT * fs), int(LEAD * fs)
    cut = peaks.select("rec", "idx", "value", F.explode(F.sequence(F.floor(F.col("idx") / size), F.floor((F.col("idx") + lead) / size))).alias("stretch"))
    p = F.array_sort(F.collect_list(F.struct("idx", "value")))
    rows = cut.groupBy("rec", "stretch").agg(p.alias("p")).select("rec", "stretch", F.col("p.idx").alias("at"), F.col("p.value").alias("heights"))

    def run(batches):
        for batch in batches:
            kept = [np.asarray(at)[thinned(np.asarray(at), np.asarray(h, float), distance)] for at, h in zip(batch["at"], batch["heights"], strict=True)]
            kept = [at[at // size == s] for at, s in zip(kept, batch["stretch"], strict=True)]
            if kept:
                yield pd.DataFrame({"rec": np.repeat(batch["rec"].to_numpy(), [len(at) for at in kept]), "idx": np.concatenate(kept)})

    return rows.mapInPandas(run, f"rec {peaks.schema['rec'].dataType.simpleString()}, idx long")


def _without_gaps(samples: DataFrame) -> DataFrame:
    return samples.join(samples.groupBy("rec").agg(F.count_if(F.col("value").isNull()).alias("gaps")).where("gaps = 0").select("rec"), "rec", "left_semi")


def _of_rows(rows: DataFrame, within, beyond) -> DataFrame:
    """rec, idx by `within` of a batch's recordings, of those of one chunk, and by `beyond` of the samples of longer ones. No
    samples are dealt out for the short ones; `rows` are written_rows()."""
    short, longer = whole_rows(rows)

    def run(batches):
        for batch in batches:
            if len(batch):
                made = within([np.asarray(v, float) for v in batch["values"]])
                yield pd.DataFrame({"rec": batch["rec"].repeat([len(at) for at in made]).to_numpy(), "idx": np.concatenate(made)})

    found = short.mapInPandas(run, f"rec {rows.schema['rec'].dataType.simpleString()}, idx long")
    return found if longer is None else found.unionByName(beyond(longer))


def _as_a_whole(samples: DataFrame, fs: float) -> bool:
    """Whether samples are written_rows(), and a chunk is no longer than what is decided on as a whole."""
    return "chunk" in samples.columns and core.CHUNK + int(LEAD * fs) <= int(SEGMENT * fs)


def _simple_within(x: np.ndarray, apart: float, height: float | None) -> np.ndarray:
    """simple_r_peaks() of a recording of one chunk."""
    if np.isnan(x).any():
        return np.empty(0, np.int64)
    # Level stretches that are higher than what lies on either side.
    begins = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    level, ends = x[begins], np.r_[begins[1:], len(x)] - 1
    top = np.flatnonzero(np.r_[False, level[1:] > level[:-1]] & np.r_[level[:-1] > level[1:], False])
    if height is None:
        at = 0.99 * (len(x) - 1)
        low, high = int(np.floor(at)), int(np.ceil(at))
        a, b = np.partition(x, [low, high])[[low, high]].tolist()
        height = 0.5 * (a if low == high or a == b else (high - at) * a + (at - low) * b)
    top = top[level[top] >= height]
    places = (begins[top] + ends[top]) // 2
    return places[thinned(places, level[top], apart)]


def simple_r_peaks(samples: DataFrame, fs: float, distance: float | None = None, height: float | None = None) -> DataFrame:
    """rec, idx: upright peaks at least 0.3 s apart, as high as half the 99th percentile. Recordings with gaps have none."""
    apart = distance or max(int(0.3 * fs), 1)
    if _as_a_whole(samples, fs):
        return _of_rows(samples, lambda xs: [_simple_within(x, apart, height) for x in xs], lambda s: simple_r_peaks(s, fs, distance, height))
    s = _without_gaps(from_runs(samples) if "values" in samples.columns else samples)
    least = s.groupBy("rec").agg((0.5 * F.percentile("value", F.lit(0.99)) if height is None else F.lit(float(height))).alias("least"))
    found = maxima(s).join(least, "rec").where("value >= least").select("rec", "idx", "value")
    return highest(found, fs, apart)


def _beats(own: pd.DataFrame, fs: float) -> pd.DataFrame:
    """The candidates that are beats."""
    return own.iloc[_chosen(*(own[c].to_numpy() for c in ("idx", "value", "slope")), own["first_max"].iloc[0], own["first_mean"].iloc[0], fs)]


def _chosen(idx: np.ndarray, value: np.ndarray, slope: np.ndarray, first_max: float, first_mean: float, fs: float) -> list[int]:
    """Which of the candidates, in order, are beats, by thresholds that follow the heights of beats and of noise."""
    rest, early = round(0.2 * fs), round(0.36 * fs)
    kept = np.flatnonzero(thinned(idx, value, rest))
    at, power, steep = idx[kept], value[kept], slope[kept]
    places, heights = at.tolist(), power.tolist()
    signal, noise = 0.25 * first_max, 0.5 * first_mean
    beats: list[int] = []
    gaps: list[float] = []

    def take(i: int, share: float) -> None:
        nonlocal signal
        if beats:
            gaps.append(places[i] - places[beats[-1]])
        beats.append(i)
        signal += share * (heights[i] - signal)

    for i in range(len(places)):
        bar = noise + 0.25 * (signal - noise)
        if len(gaps) >= 2 and places[i] - places[beats[-1]] > 1.66 * (sum(gaps[-8:]) / len(gaps[-8:])):  # a beat was missed: look back
            missed = np.flatnonzero((at > places[beats[-1]] + rest) & (at < places[i] - rest) & (power > bar / 2))
            if len(missed):
                take(int(missed[np.argmax(power[missed])]), 0.25)
        wave = bool(beats) and places[i] - places[beats[-1]] < early and steep[i] < 0.5 * steep[beats[-1]]
        if heights[i] > bar and not wave:
            take(i, 0.125)
        else:
            noise += 0.125 * (heights[i] - noise)
    return kept[sorted(set(beats))].tolist()


def pan_tompkins(samples: DataFrame, fs: float) -> DataFrame:
    """rec, idx: R peaks by band-pass (5-15 Hz), slope, square, 150 ms mean and thresholds that follow the signal.

    Of either polarity. Recordings with gaps or of less than two seconds have none; the rate has to be 50 Hz or more.
    """
    if fs < 50:
        raise ValueError("beats need a rate of 50 Hz or more")
    if _as_a_whole(samples, fs):
        return _of_rows(samples, lambda xs: beats_within(xs, fs), lambda s: pan_tompkins(s, fs))
    kind = samples.schema["rec"].dataType.simpleString()
    sos, size = butterworth(2, "bandpass", (5.0, 15.0), fs), core.CHUNK
    win, half, early = max(round(0.15 * fs), 1), round(0.1 * fs), int(2 * fs)
    reach = settle_length(sos) + 2 * win + half + LEVEL + 2

    def searched(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                yield _candidates(np.asarray(r.values, float), r.first, r.chunk * size, (r.chunk + 1) * size, sos, win, half, early).assign(rec=r.rec)[["rec", *PEAK]]

    # A chunk's samples are read once, and few rows leave it: its peaks, and one that tells of the chunk.
    found = stored(run_rows(samples, reach, reach, size).mapInPandas(searched, f"rec {kind}, idx long, value double, slope double, beat long, last long, gaps boolean, most double, total double, count long"))
    about = found.where("idx IS NULL").groupBy("rec").agg(F.max("last").alias("last"), F.max("gaps").alias("gaps"), F.max("most").alias("first_max"), (F.sum("total") / F.sum("count")).alias("first_mean"))
    about = about.where(~F.col("gaps") & (F.col("last") + 1 >= early) & F.col("first_max").isNotNull()).select("rec", "first_max", "first_mean")
    peaks = found.where("idx IS NOT NULL").select("rec", "idx", "value", "slope", "beat")
    beats = _by_stretch(peaks.drop("beat").join(about, "rec"), fs, lambda own: _beats(own, fs), f"rec {kind}, idx long")
    return beats.join(peaks.select("rec", "idx", "beat"), ["rec", "idx"]).select("rec", F.col("beat").alias("idx")).distinct()


#: What _candidates() tells.
PEAK = ["idx", "value", "slope", "beat", "last", "gaps", "most", "total", "count"]


def _candidates(x: np.ndarray, first: int, start: int, stop: int, sos: np.ndarray, win: int, half: int, early: int) -> pd.DataFrame:
    """Of a chunk from `start` to `stop`, whose values with their halo begin at `first`: the peaks of the mean squared slope, with the
    steepest slope before each and the place of the strongest deflection around it; and a row of the chunk's last sample, gaps,
    and of the highest mean square, their sum and number among the recording's `early` samples."""
    mine = slice(start - first, min(stop - first, len(x)))
    about = {"last": first + mine.stop - 1, "gaps": bool(np.isnan(x[mine]).any()), "most": None, "total": None, "count": None}
    band = _both_ways(sos, x[None])[0] if not np.isnan(x).any() else np.full(len(x), np.nan)
    if np.isnan(band).any() or len(x) < 2:
        return pd.DataFrame([about]).reindex(columns=PEAK).astype({"idx": "Int64", "beat": "Int64", "count": "Int64"})
    power, at, steep, beat = _peaks(band, mine, win, half)
    own = power[mine][: max(early - start, 0)]
    if len(own):
        about |= {"most": own.max(), "total": own.sum(), "count": len(own)}
    rows = pd.DataFrame({"idx": at + first, "value": power[at], "slope": steep, "beat": first + beat})
    return pd.concat([rows, pd.DataFrame([about])]).reindex(columns=PEAK).astype({"idx": "Int64", "beat": "Int64", "last": "Int64", "gaps": "boolean", "count": "Int64"})


def _peaks(band: np.ndarray, mine: slice, win: int, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The mean squared slope of a filtered stretch; and the places of its peaks that begin in `mine`, the steepest slope before
    each, and the place of the strongest deflection around it."""
    slope = np.r_[band[1] - band[0], (band[2:] - band[:-2]) / 2, band[-1] - band[-2]]
    ahead = (win - 1) // 2
    power = sliding_window_view(np.pad(slope * slope, (win - 1 - ahead, ahead)), win).sum(1) / win
    # Level stretches: a peak is one between lower samples, and its place is the stretch's middle.
    ends = np.flatnonzero(np.r_[power[1:] != power[:-1], False])
    begins = np.r_[0, ends[:-1] + 1] if len(ends) else ends
    top = (begins > 0) & (power[begins - 1] < power[begins]) & (power[np.minimum(ends + 1, len(power) - 1)] < power[begins]) & (ends - begins <= LEVEL)
    top &= (begins >= mine.start) & (begins < mine.stop)
    at = (begins[top] + ends[top]) // 2
    if not len(at):
        return power, at, np.empty(0), at
    steep = sliding_window_view(np.pad(np.abs(slope), (win, 0)), win + 1)[at].max(1)
    near = sliding_window_view(np.pad(np.abs(band), half, constant_values=-1), 2 * half + 1)[at]
    return power, at, steep, at - half + near.argmax(1)


def beats_within(x: list[np.ndarray], fs: float) -> list[np.ndarray]:
    """pan_tompkins() of whole recordings without gaps, each of up to a chunk: the beats' places of each, in order."""
    win, half, early = max(round(0.15 * fs), 1), round(0.1 * fs), int(2 * fs)
    found = []
    for band in both_ways_each(butterworth(2, "bandpass", (5.0, 15.0), fs), x):
        n = len(band)
        if n < max(early, 2) or np.isnan(band).any():
            found.append(np.empty(0, np.int64))
            continue
        power, at, steep, beat = _peaks(band, slice(0, n), win, half)
        own = power[:early]
        found.append(np.unique(beat[_chosen(at, power[at], steep, own.max(), own.sum() / len(own), fs)]))
    return found


def detect_r_peaks(samples: DataFrame, fs: float, method: str = "pantompkins", **parameters) -> DataFrame:
    """rec, idx by pan_tompkins() or simple_r_peaks() (`simple`)."""
    return {"pantompkins": pan_tompkins, "simple": simple_r_peaks}[method](samples, fs, **parameters)


def match_beats(known: DataFrame, found: DataFrame, fs: float, tolerance: float = 0.15) -> DataFrame:
    """rec, tp, fn, fp, se, ppv and f1 of found beats (rec, idx) against known ones: each known beat in turn takes the nearest
    free one within `tolerance` seconds, the earlier of two as near. Without known beats se is null, without found ones ppv 0.

    Beats of either kind that lie within the tolerance of the one before make a cluster; clusters are decided on alone, and a
    task gets an hour's.
    """
    kind, most = known.schema["rec"].dataType.simpleString(), tolerance * fs
    both = known.select("rec", "idx", F.lit(True).alias("known")).unionByName(found.select("rec", "idx", F.lit(False).alias("known")))
    w = Window.partitionBy("rec").orderBy("idx")
    starts = F.coalesce(F.col("idx") - F.lag("idx").over(w) > most, F.lit(True))
    both = both.withColumn("first", F.when(starts, F.col("idx"))).withColumn("first", F.last("first", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("hour", F.floor(F.col("first") / (3600 * fs)))

    def run(own: pd.DataFrame) -> pd.DataFrame:
        ref, det = (np.sort(own.loc[own["known"] == k, "idx"].to_numpy()) for k in (True, False))
        free, hits = np.ones(len(det), bool), 0
        for r in ref:
            a, b = np.searchsorted(det, r - most, "left"), np.searchsorted(det, r + most, "right")
            near = np.arange(a, b)[free[a:b]]
            if len(near):
                free[near[np.argmin(np.abs(det[near] - r))]] = False
                hits += 1
        return pd.DataFrame({"rec": [own["rec"].iloc[0]], "tp": [hits], "ref": [len(ref)], "det": [len(det)]})

    sums = both.groupBy("rec", "hour").applyInPandas(run, f"rec {kind}, tp long, ref long, det long").groupBy("rec").agg(*(F.sum(c).alias(c) for c in ("tp", "ref", "det")))
    se, ppv = F.try_divide("tp", "ref"), F.coalesce(F.try_divide("tp", "det"), F.lit(0.0))
    out = sums.select("rec", "tp", (F.col("ref") - F.col("tp")).alias("fn"), (F.col("det") - F.col("tp")).alias("fp"), se.alias("se"), ppv.alias("ppv"))
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("se") * F.col("ppv"), F.col("se") + F.col("ppv")), F.lit(0.0)))


def intervals(beats: DataFrame, fs: float) -> DataFrame:
    """The milliseconds between beats (rec, idx) as samples: rec, idx and value."""
    from undula.operators.cleaning import renumbered

    places = renumbered(beats.select("rec", "idx", F.col("idx").cast("double").alias("value")))
    return shifted(places, prev=-1).where("prev IS NOT NULL").select("rec", (F.col("idx") - 1).alias("idx"), ((F.col("value") - F.col("prev")) / fs * 1000).alias("value"))
