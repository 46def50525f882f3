"""Feature rows: one for each recording, or for each window of it when the key says so."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undula import core
from undula.core import chunked, ordered_means, over_chunks, owned, shifted, stored, windows

#: Relative powers of the classic EEG bands, half-open, in Hz.
BANDS = {"delta": (0.5, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0), "gamma": (30.0, 100.0)}


def _ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(otherwise))


def time_domain(samples: DataFrame) -> DataFrame:
    """The fourteen td_ features of each recording."""
    return _time_domain(shifted(samples, prev=-1, prev2=-2), samples, ["rec"])


def _time_domain(s: DataFrame, samples: DataFrame, key: list[str], at: str = "idx") -> DataFrame:
    v, d1 = F.col("value"), F.col("value") - F.col("prev")
    d2 = d1 - (F.col("prev") - F.col("prev2"))
    s = s.join(ordered_means(samples, key, at), key)
    cross = ((v - F.col("mean") < 0) != (F.col("prev") - F.col("mean") < 0)).cast("int")
    a = s.groupBy(*key).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.var_samp("value").alias("variance"), F.var_pop("value").alias("v0"),
        F.skewness("value").alias("skewness"), F.kurtosis("value").alias("kurtosis"), F.sqrt(F.avg(v * v)).alias("rms"), (F.max("value") - F.min("value")).alias("ptp"),
        F.max(F.abs("value")).alias("peak"), F.sum(cross).alias("crossings"), F.avg(F.abs("value")).alias("mav"), F.sum(F.abs(d1)).alias("wl"), F.var_pop(d1).alias("v1"), F.var_pop(d2).alias("v2"),
    )
    mobility = F.sqrt(_ratio(F.col("v1"), F.col("v0")))
    return a.select(
        *key, F.col("mean").alias("td_mean"), F.col("std").alias("td_std"), F.col("variance").alias("td_variance"), F.coalesce("skewness", F.lit(0.0)).alias("td_skewness"),
        F.coalesce("kurtosis", F.lit(0.0)).alias("td_kurtosis"), F.col("rms").alias("td_rms"), F.col("ptp").alias("td_peak_to_peak"), _ratio(F.col("peak"), F.col("rms")).alias("td_crest_factor"),
        _ratio(F.col("crossings").cast("double"), F.col("n") - 1).alias("td_zero_crossing_rate"), F.col("mav").alias("td_mean_abs_value"), F.col("wl").alias("td_waveform_length"),
        F.col("v0").alias("td_hjorth_activity"), mobility.alias("td_hjorth_mobility"), _ratio(F.sqrt(_ratio(F.col("v2"), F.col("v1"))), mobility).alias("td_hjorth_complexity"),
    )


def windowed_time_domain(samples: DataFrame, win: int, hop: int | None = None, fs: float = 1.0) -> DataFrame:
    """The td_ features of every full window, with t_start and t_end."""
    w = Window.partitionBy("rec", "w").orderBy("pos")
    each = windows(samples, win, hop)
    s = each.withColumns({"prev": F.lag("value").over(w), "prev2": F.lag("value", 2).over(w)})
    start = F.col("w") * (hop or win)
    out = _time_domain(s, each, ["rec", "w"], "pos")
    return out.select("rec", "w", (start / fs).alias("t_start"), ((start + win) / fs).alias("t_end"), *[c for c in out.columns if c.startswith("td_")])


def permutation_entropy(samples: DataFrame, order: int = 3, delay: int = 1) -> DataFrame:
    """The entropy of the orders of `order` values, `delay` apart, equal values in their order of time; in units of the largest possible."""
    if order < 2 or delay < 1:
        raise ValueError("an order has two values or more, and a delay is a sample or more")
    names = [f"_v{k}" for k in range(1, order)]
    s = shifted(samples, **{name: k * delay for k, name in enumerate(names, 1)})
    values = [F.col(c) for c in ("value", *names)]
    # Which of each pair comes first tells the order.
    pattern = F.concat(*((values[a] <= values[b]).cast("int") for a in range(order) for b in range(a + 1, order)))
    n = s.where(reduce(and_, (v.isNotNull() for v in values))).groupBy("rec", pattern.alias("pattern")).agg(F.count("*").alias("n"))
    p = n.join(n.groupBy("rec").agg(F.sum("n").alias("all")), "rec").withColumn("p", F.col("n") / F.col("all"))
    return p.groupBy("rec").agg((-F.sum(F.col("p") * F.log("p")) / math.log(math.factorial(order)) + 0.0).alias("perm_entropy"))


def higuchi_fd(samples: DataFrame, kmax: int = 10) -> DataFrame:
    """The slope of log curve length on log 1/k, for steps k up to kmax and a quarter of the length; every start of a step
    has a curve of its own."""
    steps = shifted(samples, **{f"p{k}": -k for k in range(1, kmax + 1)})
    n = samples.groupBy("rec").agg((F.max("idx") + 1).alias("n"))
    each = steps.select("rec", "idx", F.posexplode(F.array(*(F.abs(F.col("value") - F.col(f"p{k}")) for k in range(1, kmax + 1)))).alias("k", "d")).withColumn("k", F.col("k") + 1)
    each = each.join(n, "rec").where((F.col("k") <= F.floor(F.col("n") / 4)) & F.col("d").isNotNull())
    runs = F.floor((F.col("n") - F.col("m") - 1) / F.col("k"))
    curves = each.withColumn("m", F.col("idx") % F.col("k")).groupBy("rec", "k", "m", "n").agg(F.sum("d").alias("d"))
    curves = curves.withColumn("length", F.col("d") * (F.col("n") - 1) / (runs * F.col("k")) / F.col("k"))
    logs = curves.groupBy("rec", "k").agg(F.avg("length").alias("length")).where("length > 0").select("rec", F.log(1 / F.col("k")).alias("x"), F.log("length").alias("y"))
    return logs.groupBy("rec").agg(F.regr_slope("y", "x").alias("higuchi_fd"))


def summed_up(df: DataFrame, name: str) -> DataFrame:
    """A column's running sums over each recording: sums within chunks, plus those of the chunks before."""
    df = df.withColumn("chunk", F.floor(F.col("idx") / F.lit(core.CHUNK)))
    before = F.sum("part").over(Window.partitionBy("rec").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    base = df.groupBy("rec", "chunk").agg(F.sum(name).alias("part")).select("rec", "chunk", before.alias("base"))
    within = F.sum(name).over(over_chunks((Window.unboundedPreceding, 0)))
    return df.withColumn(name, within).join(base, ["rec", "chunk"]).withColumn(name, F.coalesce(F.col("base") + F.col(name), "base", name)).drop("base", "chunk")


def _left_of(cut: DataFrame, x: Column, order: int) -> DataFrame:
    """rec, scale and the mean squares that polynomials of the order leave of each segment: what the orthogonal ones on equal steps
    account for, each from the two before it, is taken off."""
    at, size = x - (F.col("scale") - 1) / 2, F.col("scale").cast("double")
    terms = [F.lit(1.0), at]
    for k in range(1, order):
        terms.append(at * terms[k] - k * k * (size * size - k * k) / (4.0 * (4 * k * k - 1)) * terms[k - 1])
    sums = [F.sum(F.col("y") * t).alias(f"y{k}") for k, t in enumerate(terms[: order + 1])] + [F.sum(t * t).alias(f"q{k}") for k, t in enumerate(terms[: order + 1])]
    fits = cut.groupBy("rec", "scale", "seg").agg(F.sum(F.col("y") * F.col("y")).alias("yy"), *sums)
    told = sum(F.col(f"y{k}") * F.col(f"y{k}") / F.col(f"q{k}") for k in range(order + 1))
    return fits.select("rec", "scale", (F.greatest(F.col("yy") - told, F.lit(0.0)) / F.col("scale")).alias("left"))


def dfa_alpha(samples: DataFrame, scales: list[int] | None = None, steps: int = 12, order: int = 1) -> DataFrame:
    """The slope of log fluctuation on log scale of the summed-up deviations from the mean, lines, or
    polynomials of another `order`, taken off each segment. Scales of no more than order + 1 samples can't be given.

    Each recording has scales of its own, `steps` of them in equal ratios from 8 to a quarter of its length n, rounded down,
    each once; below 32 samples or three scales, or where a fluctuation is 0, it has no exponent. Given `scales` are used
    for all recordings alike, at any length.
    """
    if order < 0 or min(scales or [8]) <= order + 1:
        raise ValueError("a scale needs more samples than its polynomial has coefficients")
    means = samples.groupBy("rec").agg(F.avg("value").alias("mean"), (F.max("idx") + 1).alias("n"), (F.min("value") < F.max("value")).alias("varies"))
    if scales is None:
        longest = F.floor(F.col("n") / 4)
        # What lies just below a whole number is one.
        inner = [F.floor(8 * F.pow(longest / 8, F.lit(i / (steps - 1))) + 1e-9) for i in range(1, steps - 1)]
        own = F.array_distinct(F.array(F.lit(8).cast("long"), *inner, longest))
        means = means.withColumn("scales", F.when(F.col("varies") & (F.col("n") >= 32) & (F.size(own) >= 3), own))
    else:
        means = means.withColumn("scales", F.array(*map(F.lit, scales)))
    y = summed_up(samples.join(means.where("scales IS NOT NULL"), "rec").select("rec", "idx", "n", "scales", (F.col("value") - F.col("mean")).alias("y")), "y")
    cut = y.withColumn("scale", F.explode("scales")).drop("scales").withColumn("seg", F.floor(F.col("idx") / F.col("scale"))).where((F.col("seg") + 1) * F.col("scale") <= F.col("n"))
    x = F.col("idx") - F.col("seg") * F.col("scale")
    if order == 1:
        lines = cut.groupBy("rec", "scale", "seg").agg(F.regr_sxx("y", x).alias("sxx"), F.regr_syy("y", x).alias("syy"), F.regr_sxy("y", x).alias("sxy"))
        left = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0)) / F.col("scale")
        fits = lines.select("rec", "scale", left.alias("left"))
    else:
        fits = _left_of(cut, x, order)
    f = fits.groupBy("rec", "scale").agg(F.sqrt(F.avg("left")).alias("f"))
    slope = F.regr_slope(F.log("f"), F.log("scale"))
    if scales is not None:
        return f.where("f > 0").groupBy("rec").agg(slope.alias("dfa_alpha"))
    found = f.groupBy("rec").agg(F.when(F.min("f") > 0, slope).alias("dfa_alpha"))
    return means.select("rec").join(found, "rec", "left")


def sample_entropy(samples: DataFrame, m: int = 2, r: float = 0.2) -> DataFrame:
    """-ln of the share of template pairs of length m within r standard deviations that stay so for one sample more.

    Templates meet only those whose first value lies in the same or a neighbouring cell of that width.
    """
    std = samples.groupBy("rec").agg((F.stddev_pop("value") * r).alias("tol"))
    names = [f"x{j}" for j in range(1, m + 1)]
    t = shifted(samples, **{n: j + 1 for j, n in enumerate(names)}).withColumnRenamed("value", "x0").join(std.where("tol > 0"), "rec").where(f"x{m} IS NOT NULL")
    t = t.withColumn("cell", F.floor(F.col("x0") / F.col("tol")))
    a = t.withColumn("cell", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1))).alias("a")
    b = t.alias("b")
    close = lambda j: F.abs(F.col(f"a.x{j}") - F.col(f"b.x{j}")) <= F.col("a.tol")
    on = (F.col("a.rec") == F.col("b.rec")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.idx") < F.col("b.idx"))
    for j in range(m):
        on = on & close(j)
    hits = a.join(b, on).groupBy(F.col("a.rec").alias("rec")).agg(F.count("*").alias("short"), F.sum(close(m).cast("long")).alias("long"))
    value = F.when((F.col("short") > 0) & (F.col("long") > 0), -F.log(F.col("long") / F.col("short")))
    return std.select("rec").join(hits, "rec", "left").select("rec", value.alias("sample_entropy"))


def frequency_domain(psd: DataFrame) -> DataFrame:
    """The ten fd_ features and five relative band powers of a psd table (rec, freq, psd). Without any power all bins count
    alike and bands have none; a band of one bin has that bin's share."""
    total = psd.groupBy("rec").agg(F.sum("psd").alias("total"), F.count("*").alias("bins"), F.max("freq").alias("top"))
    share = F.when(F.col("total") > 0, F.try_divide("psd", "total")).otherwise(1 / F.col("bins"))
    p = psd.join(total, "rec").withColumn("p", share)
    c = p.groupBy("rec").agg(F.sum(F.col("freq") * F.col("p")).alias("centroid"))
    p = p.join(c, "rec")
    w = Window.partitionBy("rec").orderBy("freq")
    dev = F.col("freq") - F.col("centroid")
    p = p.withColumns({"cum": F.sum("p").over(w), "area": F.coalesce((F.col("psd") + F.lag("psd").over(w)) / 2 * (F.col("freq") - F.lag("freq").over(w)), F.lit(0.0)), "low": F.lag("freq").over(w)})
    edge = lambda q: F.coalesce(F.min(F.when(F.col("cum") >= q - 1e-12, F.col("freq"))), F.max("freq"))
    whole = F.sum("area")
    step = F.try_divide(F.max("top"), F.max("bins") - 1)

    def band(low: float, high: float) -> Column:
        inside = (F.col("freq") >= low) & (F.col("freq") < high)
        area = F.sum(F.when((F.col("low") >= low) & (F.col("freq") < high), F.col("area")))
        return _ratio(F.when(F.count_if(inside) == 1, F.sum(F.when(inside, F.col("psd"))) * step).otherwise(area), whole)

    moment = lambda k: F.sum(F.pow(dev, F.lit(float(k))) * F.col("p"))
    spread = F.sqrt(moment(2))
    return p.groupBy("rec").agg(
        F.first("centroid").alias("fd_spectral_centroid"), spread.alias("fd_spectral_spread"), _ratio(moment(3), F.pow(spread, F.lit(3.0))).alias("fd_spectral_skewness"),
        _ratio(moment(4), F.pow(spread, F.lit(4.0))).alias("fd_spectral_kurtosis"), _ratio(F.exp(F.avg(F.log(F.col("psd") + 1e-300))), F.avg("psd")).alias("fd_spectral_flatness"), edge(0.85).alias("fd_spectral_rolloff"),
        _ratio(-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log2("p")).otherwise(0.0)), F.log2(F.count("*").cast("double"))).alias("fd_spectral_entropy"),
        F.max_by("freq", F.struct("psd", -F.col("freq"))).alias("fd_dominant_frequency"), edge(0.90).alias("fd_sef_90hz"), edge(0.95).alias("fd_sef_95hz"),
        *(band(lo, hi).alias(f"fd_band_{name}") for name, (lo, hi) in BANDS.items()),
    )


def local_median(samples: DataFrame, window: int = 11) -> DataFrame:
    """Adds `local`, the median of the `window` samples around each, the ends mirrored without the edge itself; of the largest
    odd window that fits where a recording is shorter, and null below five samples."""
    half = window // 2
    s = samples.join(samples.groupBy("rec").agg(F.max("idx").alias("last")), "rec")
    left = s.where(F.col("idx").between(1, half)).withColumn("idx", -F.col("idx"))
    right = s.where((F.col("idx") >= F.col("last") - half) & (F.col("idx") < F.col("last"))).withColumn("idx", 2 * F.col("last") - F.col("idx"))
    df = chunked(s.unionByName(left).unionByName(right), half, half)
    medians = [F.get(F.sort_array(F.collect_list("value").over(over_chunks((-h, h)))), F.lit(h)) for h in range(2, half + 1)]
    reach = F.least(F.lit(half), F.floor(F.col("last") / 2)).cast("int")
    df = owned(df.withColumn("local", F.get(F.array(*medians), reach - 2)))
    return df.where((F.col("idx") >= 0) & (F.col("idx") <= F.col("last"))).drop("last")


def hrv_time(rr: DataFrame, rel: float | None = 0.3, window: int = 11) -> DataFrame:
    """Time-domain variability of intervals in ms (as samples), after those outside 250-2500 ms are left out, and those
    that differ by more than a share `rel` (None: any may) from the median of the `window` beats around them, as a missed or
    an extra beat makes them; differences bridge what was left out."""
    from undula.operators.cleaning import renumbered

    beats = rr.groupBy("rec").agg((F.count("value") + 1).alias("hrv_beats"), F.count("value").alias("raw"))
    near = rr
    if rel is not None:
        near = local_median(renumbered(rr.where("value IS NOT NULL")), window)
        near = near.where(F.col("local").isNull() | (F.abs(F.col("value") - F.col("local")) <= rel * F.col("local")))
    kept = renumbered(near.where("value BETWEEN 250 AND 2500"))
    kept = stored(kept) if rel is not None else kept
    s = shifted(kept, prev=-1).withColumn("d", F.col("value") - F.col("prev"))
    hr = 60000 / F.col("value")
    low = kept.groupBy("rec").agg(F.min("value").alias("low"))
    bins = kept.join(low, "rec").groupBy("rec", F.floor((F.col("value") - F.col("low")) / 7.8125).alias("bin")).agg(F.count("*").alias("c")).groupBy("rec").agg((F.sum("c") / F.max("c")).alias("hrv_tri_index"))
    var = F.var_samp("value")
    half = F.var_samp("d") / 2
    a = s.groupBy("rec").agg(
        F.count("*").alias("used"), F.avg("value").alias("hrv_mean_rr"), F.sqrt(var).alias("hrv_sdnn"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("hrv_rmssd"),
        (100 * F.avg((F.abs("d") > 50).cast("int"))).alias("hrv_pnn50"), F.avg(hr).alias("hrv_mean_hr"), F.stddev_samp(hr).alias("hrv_sd_hr"), (F.max("value") - F.min("value")).alias("hrv_range"),
        F.sqrt(half).alias("hrv_sd1"), F.sqrt(F.greatest(2 * var - half, F.lit(0.0))).alias("hrv_sd2"),
    )
    out = beats.join(a, "rec", "left").join(bins, "rec", "left")
    artefact = F.try_divide(100 * (F.col("raw") - F.coalesce("used", F.lit(0))), "raw")
    # By the rules of floating point, as in the SQL: infinite, or no number, where all points lie on a line.
    ratio = F.when(F.col("hrv_sd2") != 0, F.try_divide("hrv_sd1", "hrv_sd2")).when(F.col("hrv_sd2") == 0, F.when(F.col("hrv_sd1") > 0, math.inf).when(F.col("hrv_sd1") == 0, math.nan))
    return out.withColumns({"hrv_sd_ratio": ratio, "hrv_artifact_pct": artefact}).drop("raw", "used")


#: The sixteen measures of hrv(), in their order.
HRV = ["beats", "mean_rr_ms", "sdnn_ms", "rmssd_ms", "pnn50_pct", "mean_hr_bpm", "sdhr_bpm", "rr_range_ms", "tri_index", "sd1_ms", "sd2_ms", "sd1_sd2", "lf_power", "hf_power", "lf_hf_ratio", "artifact_pct"]


def clean_rr(rr: DataFrame, rel: float | None = 0.3, window: int = 11) -> DataFrame:
    """Adds `keep` to intervals in ms: within 250-2500, and, in recordings of five or more, within a share `rel` of the median of
    the `window` beats around (None: any)."""
    from undula.operators.cleaning import renumbered

    s = renumbered(rr.where("value IS NOT NULL"))
    ok = F.col("value").between(250, 2500)
    if rel is None:
        return s.withColumn("keep", ok)
    near = local_median(s, window)
    return near.withColumn("keep", ok & (F.col("local").isNull() | (F.abs(F.col("value") - F.col("local")) <= rel * F.col("local")))).drop("local")


def hrv(rr: DataFrame, rel: float | None = 0.3) -> DataFrame:
    """rec and the sixteen hrv_ measures of intervals in ms (as samples), after clean_rr(); null where they can't be had: all but
    the beats below three intervals, all but the share of artefacts below three kept ones, and the powers below twenty.

    The powers are areas of the psd of the intervals over time, drawn through by lines and read at 4 Hz.
    """
    kept = stored(clean_rr(rr, rel))
    at = summed_up(kept.select("rec", "idx", "value"), "value").select("rec", "idx", (F.col("value") / 1000).alias("t"))
    counts = kept.groupBy("rec").agg(F.count("*").alias("raw"), F.count_if("keep").alias("used"))
    good = kept.join(at, ["rec", "idx"]).where("keep").select("rec", "idx", "value", "t")
    from undula.operators.cleaning import renumbered

    s = stored(shifted(renumbered(good.select("rec", "idx", "value")), prev=-1).withColumn("d", F.col("value") - F.col("prev")))
    hr, half = 60000 / F.col("value"), F.var_samp("d") / 2
    low = s.groupBy("rec").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    # The last bin is closed, as a histogram's is.
    bins = s.join(low, "rec").withColumn("bin", F.least(F.floor((F.col("value") - F.col("low")) / 7.8125), F.greatest(F.ceil((F.col("high") - F.col("low")) / 7.8125) - 1, F.lit(0))))
    tri = bins.groupBy("rec", "bin").agg(F.count("*").alias("c")).groupBy("rec").agg((F.sum("c") / F.max("c")).alias("hrv_tri_index"))
    a = s.groupBy("rec").agg(
        F.avg("value").alias("hrv_mean_rr_ms"), F.stddev_samp("value").alias("hrv_sdnn_ms"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("hrv_rmssd_ms"), (100 * F.avg((F.abs("d") > 50).cast("int"))).alias("hrv_pnn50_pct"),
        F.avg(hr).alias("hrv_mean_hr_bpm"), F.stddev_samp(hr).alias("hrv_sdhr_bpm"), (F.max("value") - F.min("value")).alias("hrv_rr_range_ms"), F.sqrt(half).alias("hrv_sd1_ms"),
        F.sqrt(F.greatest(2 * F.var_samp("value") - half, F.lit(0.0))).alias("hrv_sd2_ms"),
    ).withColumn("hrv_sd1_sd2", F.try_divide("hrv_sd1_ms", F.when(F.col("hrv_sd2_ms") > 0, F.col("hrv_sd2_ms")))).join(tri, "rec", "left")
    powers = _rhythm_powers(good, counts)
    out = counts.join(a, "rec", "left").join(powers, "rec", "left")
    raw, used = F.col("raw"), F.col("used")
    values = {"beats": (raw + 1).cast("double"), "artifact_pct": F.when(raw >= 3, 100 * (1 - used / raw))}
    return rr.select("rec").distinct().join(out, "rec", "left").select(
        "rec", *((F.coalesce(values[k], F.lit(0.0)) if k == "beats" else values[k] if k in values else F.when((raw >= 3) & (used >= 3), F.col(f"hrv_{k}"))).alias(f"hrv_{k}") for k in HRV)
    )


def _rhythm_powers(good: DataFrame, counts: DataFrame) -> DataFrame:
    from undula.operators.cleaning import renumbered
    from undula.operators.spectral import welch

    enough = good.join(counts.where("used >= 20").select("rec"), "rec", "left_semi")
    t = shifted(renumbered(enough.select("rec", "idx", F.col("t").alias("value"))), t1=1).select("rec", "idx", F.col("value").alias("t0"), "t1")
    v = shifted(renumbered(enough.select("rec", "idx", "value")), v1=1).select("rec", "idx", F.col("value").alias("v0"), "v1")
    start = enough.groupBy("rec").agg(F.min("t").alias("start"))
    pairs = t.join(v, ["rec", "idx"]).where("t1 IS NOT NULL").join(start, "rec")
    first, last = F.ceil((F.col("t0") - F.col("start")) * 4 - 1e-9), F.ceil((F.col("t1") - F.col("start")) * 4 - 1e-9) - 1
    grid = pairs.where(first <= last).withColumn("k", F.explode(F.sequence(first, last)))
    share = (F.col("start") + F.col("k") / 4 - F.col("t0")) / (F.col("t1") - F.col("t0"))
    even = stored(grid.select("rec", F.col("k").cast("long").alias("idx"), (F.col("v0") + (F.col("v1") - F.col("v0")) * share).alias("value")))
    psd = welch(even, 4.0, 256).join(even.groupBy("rec").agg(F.count("*").alias("m")).where("m >= 16").select("rec"), "rec", "left_semi")
    w = Window.partitionBy("rec").orderBy("freq")

    def area(low: float, high: float) -> Column:
        inside = (F.col("low") >= low) & (F.col("freq") < high)
        return F.sum(F.when(inside, (F.col("psd") + F.col("before")) / 2 * (F.col("freq") - F.col("low"))))

    p = psd.withColumns({"low": F.lag("freq").over(w), "before": F.lag("psd").over(w)})
    out = p.groupBy("rec").agg(area(0.04, 0.15).alias("hrv_lf_power"), area(0.15, 0.40).alias("hrv_hf_power"))
    return out.withColumn("hrv_lf_hf_ratio", F.try_divide("hrv_lf_power", F.when(F.col("hrv_hf_power") > 0, F.col("hrv_hf_power"))))


def nonlinear(samples: DataFrame) -> DataFrame:
    """rec and the four nl_ features: sample and permutation entropy, Higuchi's dimension and the fluctuation exponent."""
    out = samples.select("rec").distinct()
    for made, name in ((sample_entropy(samples), "sample_entropy"), (permutation_entropy(samples), "perm_entropy"), (higuchi_fd(samples), "higuchi_fd"), (dfa_alpha(samples), "dfa_alpha")):
        out = out.join(stored(made).withColumnRenamed(name, {"perm_entropy": "nl_permutation_entropy"}.get(name, f"nl_{name}")), "rec", "left")
    return out


def peaks(samples: DataFrame, fs: float | None = None, distance: int | None = None, height: float | None = None) -> DataFrame:
    """rec and the seven pk_ features of peaks at least 0.1 s (ten samples without a rate) apart and half a deviation above the
    mean: count, rate, height and its deviation, prominence, width at half prominence, and spread of the distances over their
    mean; all 0 without a peak.

    Peaks are local maxima, found in chunks, thinned out by height; prominence and width look at no more than PEAK_REACH
    samples to a side, which is as far as they go unless a peak towers over all of that.
    """
    from undula.operators.ecg import highest, maxima

    rate, kind = fs or 1.0, samples.schema["rec"].dataType.simpleString()
    apart = distance or max(int((fs or 100) * 0.1), 1)
    stats = samples.groupBy("rec").agg((F.max("idx") + 1).alias("n"), (F.avg("value") + 0.5 * F.stddev_pop("value") if height is None else F.lit(float(height))).alias("least"))
    high = maxima(samples).join(stats, "rec").where("value >= least").select("rec", "idx", "value")
    found = stored(highest(high, rate, apart))
    size = core.CHUNK
    pairs = F.array_sort(F.collect_list(F.struct("idx", "value")))
    chunks = chunked(samples, PEAK_REACH, PEAK_REACH, size).groupBy("rec", "chunk").agg(pairs.alias("p"))
    chunks = chunks.select("rec", "chunk", F.col("p")[0]["idx"].alias("first"), F.transform("p", lambda p: p["value"]).alias("values"))
    own = found.withColumn("chunk", F.floor(F.col("idx") / size)).groupBy("rec", "chunk").agg(F.sort_array(F.collect_list("idx")).alias("at"))

    def measured(batches):
        for batch in batches:
            made = []
            for r in batch.itertuples(index=False):
                x = np.asarray(r.values, float)
                made += [(r.rec, i + r.first, x[i], *_prominence(x, i)) for i in np.asarray(r.at) - r.first]
            yield pd.DataFrame(made, columns=["rec", "idx", "height", "prominence", "width"])

    each = stored(chunks.join(own, ["rec", "chunk"]).mapInPandas(measured, f"rec {kind}, idx long, height double, prominence double, width double"))
    gaps = shifted(_numbered(each.select("rec", "idx")), prev=-1).withColumn("gap", F.col("value") - F.col("prev")).groupBy("rec")
    gaps = gaps.agg(F.when(F.count("gap") > 1, F.try_divide(F.stddev_pop("gap"), F.avg("gap"))).alias("regularity"))
    a = each.groupBy("rec").agg(F.count("*").alias("count"), F.avg("height").alias("h"), F.stddev_pop("height").alias("s"), F.avg("prominence").alias("p"), F.avg("width").alias("w"))
    d = stats.join(a, "rec", "left").join(gaps, "rec", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return d.select(
        "rec", zero(F.col("count").cast("double")).alias("pk_count"), zero(F.col("count") * rate / F.col("n")).alias("pk_rate_hz"), zero(F.col("h")).alias("pk_mean_height"), zero(F.col("s")).alias("pk_std_height"),
        zero(F.col("p")).alias("pk_mean_prominence"), zero(F.col("w") / rate).alias("pk_mean_width"), zero(F.col("regularity")).alias("pk_regularity"),
    )


#: Samples to a side in which a peak's prominence and width are sought.
PEAK_REACH = 1 << 14


def _numbered(places: DataFrame) -> DataFrame:
    from undula.operators.cleaning import renumbered

    return renumbered(places.withColumn("value", F.col("idx").cast("double")))


def _prominence(x: np.ndarray, i: int) -> tuple[float, float]:
    """How far a peak stands out above the higher of the two lowest points on the way to higher ground, and its width at half
    of that, between the crossings on the straight lines of the samples."""
    taller = np.flatnonzero(x > x[i])
    low = taller[taller < i].max(initial=-1) + 1
    high = taller[taller > i].min(initial=len(x)) - 1
    rise = x[i] - max(x[low : i + 1].min(), x[i : high + 1].min())
    bar = x[i] - rise / 2
    left = np.flatnonzero(x[low : i + 1] < bar)
    right = np.flatnonzero(x[i : high + 1] < bar)
    a, b = float(low), float(high)
    if len(left):
        k = low + left[-1]
        a = k + (bar - x[k]) / (x[k + 1] - x[k])
    if len(right):
        k = i + right[0]
        b = k - (bar - x[k]) / (x[k - 1] - x[k])
    return float(rise), b - a


#: The categories of extract(), and those that it gives by default.
CATEGORIES, DEFAULT = ("time", "freq", "nonlinear", "peaks", "hrv"), ("time", "freq", "nonlinear", "peaks")


def extract(samples: DataFrame, fs: float | None = None, include: tuple[str, ...] | list[str] | None = None) -> DataFrame:
    """One row for each recording with the features of the categories asked for: time, freq, nonlinear, peaks and hrv.

    freq, which the default includes, and hrv need a rate: without one they raise ValueError. Recordings with gaps have null features: fill them before.
    """
    from undula.operators.ecg import intervals, pan_tompkins
    from undula.operators.spectral import welch

    include = tuple(include or DEFAULT)
    if unknown := set(include) - set(CATEGORIES):
        raise ValueError(f"unknown categories {sorted(unknown)}, there are {CATEGORIES}")
    if not fs and {"freq", "hrv"} & set(include):
        raise ValueError("freq and hrv features need a rate")
    s = stored(samples.select("rec", "idx", "value"))
    gaps = stored(s.groupBy("rec").agg(F.count_if(F.col("value").isNull()).alias("gaps")))
    s = stored(s.join(gaps.where("gaps = 0").select("rec"), "rec", "left_semi"))
    made = {
        "time": lambda: time_domain(s), "freq": lambda: frequency_domain(welch(s, fs)), "nonlinear": lambda: nonlinear(s), "peaks": lambda: peaks(s, fs),
        "hrv": lambda: hrv(intervals(pan_tompkins(s, fs), fs)),
    }
    out = gaps.select("rec")
    for category in include:
        # Each category is written by itself: in one plan all their sorts would stand in a task's memory together.
        out = out.join(stored(made[category]()), "rec", "left")
    return out


def windowed_features(samples: DataFrame, window: float, step: float | None = None, fs: float | None = None, include: tuple[str, ...] | list[str] | None = None) -> DataFrame:
    """rec, t_start, t_end and extract()'s features of each full window of so many seconds (samples without a rate), `step`
    apart: every window is a recording of its own. As for extract(), freq, which the default includes, and hrv need a rate:
    without one they raise ValueError."""
    rate = fs or 1.0
    win, hop = round(window * rate), round((step or window) * rate)
    if win < 4:
        raise ValueError("a window needs four samples or more")
    kind = samples.schema["rec"].dataType.simpleString()
    cut = windows(samples, win, hop).select(F.to_json(F.struct("rec", F.col("w").alias("w"))).alias("rec"), F.col("pos").alias("idx"), "value")
    found = extract(stored(cut), fs, include).withColumn("key", F.from_json("rec", f"rec {kind}, w long"))
    start = F.col("key.w") * hop
    return found.select(F.col("key.rec").alias("rec"), (start / rate).alias("t_start"), ((start + win) / rate).alias("t_end"), *[c for c in found.columns if c not in ("rec", "key")])
