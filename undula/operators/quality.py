"""Signal-quality checks, score and grade; one row for each recording."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undula.core import CHUNK, chunked, from_runs, long_recordings, over_chunks, owned, stored, told, windows, within_a_chunk
from undula.functions import checks as measure
from undula.functions.signal import butterworth
from undula.operators import outliers
from undula.operators.cleaning import fill
from undula.operators.ecg import beats_within, intervals, pan_tompkins
from undula.operators.filtering import both_ways_each, butter, whole_rows, written_rows
from undula.operators.spectral import welch

#: What an issue of each severity costs, and the least score of each grade.
COST = {"critical": 35, "warning": 12, "info": 3}
GRADES = ((90, "A"), (75, "B"), (60, "C"), (40, "D"))


def run_lengths(df: DataFrame, state: str, by: list[str], short: bool = False) -> DataFrame:
    """Maximal runs of consecutive rows with an equal, non-null `state`: by, first, length, state.

    Runs are found within chunks; those that touch a chunk's end are joined to their continuation by one row a chunk, unless all
    are known to be `short`, see core.within_a_chunk().
    """
    df = df.where(F.col(state).isNotNull()).withColumn("chunk", F.floor(F.col("idx") / F.lit(CHUNK)))
    own = Window.partitionBy(*by, "chunk").orderBy("idx")
    starts = (F.col("idx") - F.lag("idx").over(own) != 1) | (F.col(state) != F.lag(state).over(own))
    marked = df.withColumn("run", F.sum(F.coalesce(starts, F.lit(True)).cast("int")).over(own))
    within = marked.groupBy(*by, "chunk", "run", state).agg(F.min("idx").alias("first"), F.count("*").alias("length"))
    # A run that fills up its chunk's end goes on where the next chunk's begins; runs inside a chunk need no neighbour.
    at_start, at_end = F.col("first") == F.col("chunk") * CHUNK, F.col("first") + F.col("length") == (F.col("chunk") + 1) * CHUNK
    columns = [*by, state, "first", "length"]
    if short:
        return within.select(*columns)
    inner, outer = within.where(~at_start & ~at_end), within.where(at_start | at_end)
    w = Window.partitionBy(*by).orderBy("first")
    goes_on = (F.col("first") == F.lag(F.col("first") + F.col("length")).over(w)) & (F.col(state) == F.lag(state).over(w))
    outer = outer.withColumn("whole", F.sum((~F.coalesce(goes_on, F.lit(False))).cast("int")).over(w))
    joined = outer.groupBy(*by, "whole", state).agg(F.min("first").alias("first"), F.sum("length").alias("length"))
    return inner.select(*columns).unionByName(joined.select(*columns))


def in_runs(samples: DataFrame, **least: int) -> DataFrame:
    """Adds, for each name, whether a sample lies in a run of so many equal, present values: in_runs(s, three=3)."""
    w, most = over_chunks(), max(least.values())
    df = chunked(samples, most, most)
    df = df.withColumn("same", F.coalesce((F.col("value") == F.lag("value").over(w)).cast("int"), F.lit(0)))
    begins = {f"{k}_begins": F.sum("same").over(over_chunks((1, m - 1))) == m - 1 for k, m in least.items()}
    df = df.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in begins.items()})
    df = df.withColumns({k: F.max(f"{k}_begins").over(over_chunks((1 - m, 0))) for k, m in least.items()})
    return owned(df).drop("same", *begins)


def _eighth(idx: Column, n: Column) -> Column:
    """Of eight parts as even as can be, the longer ones first, the one that a sample lies in."""
    longer, size = n % 8, F.floor(n / 8)
    return F.when(idx < longer * (size + 1), F.floor(idx / (size + 1))).otherwise(longer + F.floor((idx - longer * (size + 1)) / size))


def _steady_corr() -> Column:
    """Correlation of the values with their index, null where they are constant."""
    v, i = F.col("value"), F.when(F.col("value").isNotNull(), F.col("idx"))
    return F.try_divide(F.covar_pop(v, i), F.sqrt(F.var_pop(v) * F.var_pop(i)))


def _judged(d: DataFrame, checks: list[tuple[str, Column]], measures: list[str]) -> DataFrame:
    """rec, n, the measures, issues (codes with severity, in the checks' order), score, grade and ok."""
    found = F.filter(F.array(*(F.when(c.isNotNull(), F.concat_ws(":", F.lit(code), c)) for code, c in checks)), lambda x: x.isNotNull())
    cost = sum((F.coalesce(F.create_map(*(F.lit(x) for kv in COST.items() for x in kv))[c], F.lit(0)) for _, c in checks), F.lit(0))
    d = d.select("rec", "n", *measures, F.array_join(found, ",").alias("issues"), F.greatest(F.lit(0), 100 - cost).alias("score"))
    grade = F.lit("F")
    for least, name in reversed(GRADES):
        grade = F.when(F.col("score") >= least, name).otherwise(grade)
    return d.withColumn("grade", grade).withColumn("ok", ~F.col("issues").contains("warning") & ~F.col("issues").contains("critical"))


#: Shares of the power, and decibels above the surroundings, from which the spectral checks speak up.
DRIFT_SHARE, HF_SHARE, MAINS_DB, MAINS_BAD_DB, MAINS_SHARE, MAINS_SIGNAL = 0.2, 0.3, 10.0, 30.0, 0.002, 0.5
#: Beats a minute and seconds between beats that are plausible, the ratio of intervals that is regular, and the least
#: correlation of beats with the median beat.
HEART_RATE, BEAT_GAP, INTERVAL_RATIO, LIKE_TEMPLATE = (40.0, 180.0), 3.0, 2.2, 0.66
#: In which order repairs are made.
FIX_ORDER = ["remove_missing", "remove_outliers", "highpass", "detrend", "notch", "remove_dc"]


def _line(f0: float, nyquist: float) -> list[Column]:
    """A line's peak, median background and power, and the bins of that background, of a psd's rows."""
    f = F.col("freq")
    peak = f.between(f0 - 1, f0 + 1)
    back = f.between(f0 - 10, f0 - 3) | f.between(f0 + 3, min(f0 + 10, nyquist))
    return [F.max(F.when(peak, F.col("psd"))), F.percentile(F.when(back, F.col("psd")), F.lit(0.5)), F.sum(F.when(peak, F.col("psd"))), F.count_if(back)]


def _db(peak: Column, back: Column, bins: Column) -> Column:
    return F.when(peak.isNotNull() & (bins >= 3), 10 * F.log10(F.greatest(peak, F.lit(1e-300)) / (back + 1e-300)))


def _lines(fs: float, mains: float | None) -> list[float]:
    return [f0 for f0 in ([mains] if mains else [50.0, 60.0]) if f0 + 3 < fs / 2]


def _heart_band(fs: float) -> np.ndarray:
    return butterworth(2, "bandpass", (0.5, min(40.0, 0.45 * fs)), fs)


def _spectral(x: DataFrame, fs: float, mains: float | None, cutoff: float | None) -> DataFrame:
    """rec, drift, hf, and of the line that stands out most its frequency, decibels, share and whether its double does too."""
    nyquist, lines = fs / 2, _lines(fs, mains)
    fine, coarse = welch(x, fs, int(max(8 * fs, 64))), welch(x, fs, int(max(2 * fs, 64)))
    total = F.sum("psd") + 1e-300
    slow = F.sum(F.when((F.col("freq") > 0) & (F.col("freq") < (cutoff or 0.0)), F.col("psd")))
    out = fine.groupBy("rec").agg((F.coalesce(slow, F.lit(0.0)) / total).alias("drift"), (F.coalesce(F.sum(F.when(F.col("freq") >= 0.8 * nyquist, F.col("psd"))), F.lit(0.0)) / total).alias("hf"))
    if not lines:
        return out.withColumns({"mains_hz": F.lit(None).cast("double"), "mains_db": F.lit(None).cast("double"), "mains_share": F.lit(None).cast("double"), "harmonics": F.lit(False)})
    parts = {f"{name}{int(f)}": c for f0 in lines for f in (f0, 2 * f0) for name, c in zip(("p", "b", "s", "n"), _line(f, nyquist if f == f0 else math.inf), strict=True)}
    m = coarse.groupBy("rec").agg(total.alias("total"), *(c.alias(k) for k, c in parts.items()))
    db = lambda f: _db(*(F.col(f"{k}{int(f)}") for k in "pbn"))
    each = [
        F.when(db(f0).isNotNull(), F.struct(
            db(f0).alias("db"), F.lit(-i).alias("turn"), F.lit(f0).alias("hz"), (F.col(f"s{int(f0)}") / F.col("total")).alias("share"),
            (F.coalesce(db(2 * f0), F.lit(0.0)) > MAINS_DB if 2 * f0 < nyquist else F.lit(False)).alias("harmonics"),
        )) for i, f0 in enumerate(lines)
    ]
    best = m.select("rec", F.array_max(F.array(*each)).alias("best"))
    return out.join(best.select("rec", F.col("best.hz").alias("mains_hz"), F.col("best.db").alias("mains_db"), F.col("best.share").alias("mains_share"), F.coalesce("best.harmonics", F.lit(False)).alias("harmonics")), "rec", "left")


def _heart(x: DataFrame, fs: float) -> DataFrame:
    """rec, beats, hr, longest and ratio of the intervals, and like, the median correlation of beats with the median beat."""
    high = min(40.0, 0.45 * fs)
    long = x.groupBy("rec").agg((F.max("idx") + 1).alias("n")).where(F.col("n") >= 3 * fs)
    y = stored(butter(x.join(long.select("rec"), "rec", "left_semi"), "bandpass", (0.5, high), fs, order=2))
    beats = stored(pan_tompkins(y, fs))
    count = long.join(beats.groupBy("rec").agg(F.count("*").alias("beats")), "rec", "left").select("rec", F.coalesce("beats", F.lit(0)).alias("beats"))
    rr = intervals(beats, fs).withColumn("value", F.col("value") / 1000)
    rhythm = rr.groupBy("rec").agg(F.avg("value").alias("mean"), F.max("value").alias("longest"), F.min("value").alias("shortest"), F.percentile("value", F.lit(0.5)).alias("middle"))
    rhythm = rhythm.select("rec", (60 / F.col("mean")).alias("hr"), "longest", F.try_divide("longest", "shortest").alias("ratio"), F.floor(F.col("middle") * fs / 2).alias("half"))
    ends = long.join(rhythm, "rec").where("half > 2")
    inside = beats.withColumnRenamed("idx", "beat").join(ends, "rec").where((F.col("beat") >= F.col("half")) & (F.col("beat") + F.col("half") <= F.col("n")))
    cut = inside.select("rec", "beat", F.explode(F.sequence(-F.col("half"), F.col("half") - 1)).alias("rel")).withColumn("idx", F.col("beat") + F.col("rel")).join(y, ["rec", "idx"])
    cut = stored(cut.select("rec", "beat", "rel", "value"))
    template = cut.groupBy("rec", "rel").agg(F.percentile("value", F.lit(0.5)).alias("template"))
    m = cut.join(template, ["rec", "rel"]).groupBy("rec", "beat").agg(F.covar_pop("value", "template").alias("xy"), F.var_pop("value").alias("xx"), F.var_pop("template").alias("yy"))
    like = m.withColumn("like", F.coalesce(F.try_divide("xy", F.sqrt(F.col("xx") * F.col("yy"))), F.lit(0.0)))
    like = like.groupBy("rec").agg(F.count("*").alias("whole"), F.percentile("like", F.lit(0.5)).alias("like")).where("whole >= 3").select("rec", "like")
    return count.join(rhythm.drop("half"), "rec", "left").join(like, "rec", "left")


def diagnose(samples: DataFrame, fs: float | None = None, mains: float | None = None, drift_cutoff: float | None = 0.5, signal_type: str | None = None) -> DataFrame:
    """All checks in their order: missing or empty, short, constant, digital, clipping, flatline, spikes, dc_offset, drift or
    trend, mains, hf_noise, nonstationary, and for signal_type `ecg` the heartbeat's; rec, n, missing, the measures, issues
    (codes with severity), score, grade and ok.

    Gaps are interpolated after the first check and spikes after theirs, so that later checks see the repaired signal. An
    empty, short (n < 32) or constant recording has no further checks, and null measures. Drift, mains and hf_noise need a
    rate `fs`, and their measures are there if it is given; a drift that two periods of the cut-off don't fit into, or without
    a rate, is looked for as a trend. drift_cutoff None drops both. `mains` is 50 or 60, by default whichever stands out more.
    """
    if signal_type not in (None, "ecg"):
        raise ValueError("signal_type has to be None or 'ecg'")
    if fs and fs >= 50 and signal_type == "ecg":
        return _reported(_measured_at_once(samples, fs, mains, drift_cutoff), fs, drift_cutoff, True)
    return _diagnosed(stored(samples.select("rec", "idx", "value")), fs, mains, drift_cutoff)


def _diagnosed(samples: DataFrame, fs: float | None, mains: float | None, drift_cutoff: float | None) -> DataFrame:
    """diagnose() of stored samples, but for the heartbeat."""
    return _reported(_measured(samples, fs, mains, drift_cutoff), fs, drift_cutoff)


#: The types of what _measured() tells of a recording.
MEASURES = {
    "n": "long", "missing": "double", "lo": "double", "hi": "double", "distinct": "long", "clipped": "long", "flat": "long", "spikes": "long", "mean": "double", "std": "double", "corr": "double",
    "spread": "double", "drift": "double", "hf": "double", "mains_hz": "double", "mains_db": "double", "mains_share": "double", "harmonics": "boolean",
    "beats": "long", "hr": "double", "longest": "double", "ratio": "double", "like": "double",
}
#: Samples of recordings that are measured side by side.
SIDE_BY_SIDE = 1 << 18


def _measured_at_once(samples: DataFrame, fs: float, mains: float | None, drift_cutoff: float | None) -> DataFrame:
    """_measured() with the heartbeat: samples are dealt out once, as runs, and written as one row a chunk. Recordings of one chunk
    are measured in one pass over those rows; only those of more go through the plan over chunks."""
    kind = samples.schema["rec"].dataType.simpleString()
    short, longer = whole_rows(written_rows(samples))
    lines, band = _lines(fs, mains), _heart_band(fs)

    def some(recs: list, xs: list[np.ndarray]) -> pd.DataFrame:
        made = [measure.repaired(x, fs) for x in xs]
        whole = [(told, x) for told, x in made if x is not None]
        hearts = [(told, x) for told, x in whole if len(x) >= 3 * fs]
        for told, x in whole:
            told |= measure.spectral(x, fs, lines, drift_cutoff, MAINS_DB)
        ys = both_ways_each(band, [x for _, x in hearts])
        for (told, _), y, beats in zip(hearts, ys, beats_within(ys, fs), strict=True):
            told |= measure.rhythm(y, beats, fs)
        out = pd.DataFrame({"rec": recs})
        return out.assign(**{c: pd.array([told.get(c) for told, _ in made], {"long": "Int64", "double": "Float64", "boolean": "boolean"}[t]) for c, t in MEASURES.items()})

    def run(batches):
        for batch in batches:
            xs, lengths = [np.asarray(v, float) for v in batch["values"]], batch["values"].map(len).to_numpy()
            part = (np.cumsum(lengths) - lengths) // SIDE_BY_SIDE
            for p in np.unique(part):
                own = np.flatnonzero(part == p)
                yield some([batch["rec"].iloc[i] for i in own], [xs[i] for i in own])

    schema = f"rec {kind}, " + ", ".join(f"{c} {t}" for c, t in MEASURES.items())
    told_of = short.mapInPandas(run, schema)
    if longer is None:
        return told_of
    return told_of.unionByName(_measured(stored(from_runs(longer)), fs, mains, drift_cutoff, True).select("rec", *(F.col(c).cast(t) for c, t in MEASURES.items())))


def _measured(samples: DataFrame, fs: float | None, mains: float | None, drift_cutoff: float | None, heart: bool = False) -> DataFrame:
    """What the checks need to know of each recording, by windows over the chunks of stored samples."""
    short, gap = within_a_chunk(samples), F.col("value").isNull()
    x = samples.withColumn("gap", gap.cast("int"))
    x = x if samples.where(gap).isEmpty() else stored(fill(x, "interpolate", short))
    # Counts of a recording's equal values tell the different ones, the lowest and the highest with their numbers, and all of them.
    equal = x.groupBy("rec", "value").agg(F.count("*").alias("times"), F.max("idx").alias("last"), F.sum("gap").alias("gaps"))
    first = stored(equal.groupBy("rec").agg(
        (F.max("last") + 1).alias("n"), (F.sum("gaps") / F.sum("times")).alias("missing"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("value").alias("distinct"),
        F.min_by("times", "value").alias("at_lo"), F.max_by("times", "value").alias("at_hi"),
    ))
    x = told(x.drop("gap"), first.where("n >= 32 AND lo < hi").drop("missing"), short)
    x = in_runs(x, three=3, long=max(5, int(0.1 * fs)) if fs else 10)
    many = F.greatest(F.lit(3.0), 0.002 * F.col("n"))
    at_edge = ((F.col("value") == F.col("lo")) & (F.col("at_lo") >= many)) | ((F.col("value") == F.col("hi")) & (F.col("at_hi") >= many))
    varied = F.col("distinct") > 16
    x = x.withColumn("clip", varied & F.col("three") & at_edge).withColumn("flat", varied & F.col("long") & ~F.col("clip"))
    x = x.select("rec", "idx", "n", "value", "clip", "flat")
    x = outliers.spikes(x, None if short else long_recordings(samples), 10.0, 5).withColumn("spike", F.col("outlier") & ~F.col("clip"))
    x = x if short else stored(x)
    x = stored(fill(x.withColumn("value", F.when(~F.col("spike"), F.col("value"))).drop("outlier"), "interpolate", short))
    whole = x.groupBy("rec").agg(
        *(F.sum(F.col(a).cast("int")).alias(b) for a, b in (("clip", "clipped"), ("flat", "flat"), ("spike", "spikes"))),
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), _steady_corr().alias("corr"),
    )
    x = x.select("rec", "idx", "n", "value")
    parts = x.where("n >= 256").groupBy("rec", _eighth(F.col("idx"), F.col("n")).alias("part"))
    parts = parts.agg(F.when(F.min("value") == F.max("value"), 0.0).otherwise(F.stddev_pop("value")).alias("d"))
    parts = parts.groupBy("rec").agg((F.max("d") / (F.min("d") + 1e-300)).alias("spread"))
    d = first.join(whole, "rec", "left").join(parts, "rec", "left")
    if fs:
        d = d.join(_spectral(x, fs, mains, drift_cutoff), "rec", "left")
    return d.join(_heart(x.drop("n"), fs), "rec", "left") if heart else d


def _reported(d: DataFrame, fs: float | None, drift_cutoff: float | None, heart: bool = False) -> DataFrame:
    """The checks of what is _measured()."""
    n, full, varied = F.col("n"), F.col("lo").isNotNull(), F.col("distinct") > 16
    seen = F.lit(bool(fs) and drift_cutoff is not None and drift_cutoff < fs / 2) & (n / F.lit(float(fs or 1)) >= 2 / (drift_cutoff or 1.0))
    trend = F.when(F.lit(drift_cutoff is not None) & ~seen & (F.col("corr") * F.col("corr") > 0.3), "warning")
    checks = [
        ("empty", F.when(~full, "critical")),
        ("missing", F.when(full & (F.col("missing") > 0.2), "critical").when(full & (F.col("missing") > 0), "warning")),
        ("short", F.when(full & (n < 32), "critical")),
        ("constant", F.when((n >= 32) & (F.col("lo") == F.col("hi")), "critical")),
        ("digital", F.when(F.col("clipped").isNotNull() & ~varied, "info")),
        ("clipping", F.when(F.col("clipped") > 0.05 * n, "critical").when(F.col("clipped") > 0, "warning")),
        ("flatline", F.when(F.col("flat") > 0.2 * n, "critical").when(F.col("flat") > 0.01 * n, "warning")),
        ("spikes", F.when(F.col("spikes") > 0, "warning")),
        ("dc_offset", F.when(F.abs("mean") > F.col("std") + 1e-300, "info")),
        ("trend", trend),
        ("nonstationary", F.when(F.col("spread") > 5, "info")),
    ]
    measures = ["missing", "clipped", "flat", "spikes", "spread"]
    if fs:
        line = (F.col("mains_db") > MAINS_DB) & (F.col("mains_share") >= MAINS_SHARE)
        bad = F.when(F.col("mains_share") > MAINS_SIGNAL, "info").when(F.col("mains_db") > MAINS_BAD_DB, "critical").otherwise("warning")
        spectral = [("mains", F.when(line, bad)), ("hf_noise", F.when(F.col("hf") > HF_SHARE, "info"))]
        checks[-2:-2] = [("drift", F.when(seen & (F.col("drift") > DRIFT_SHARE), "warning"))]
        checks[-1:-1] = spectral
        measures += ["drift", "hf", "mains_hz", "mains_db", "mains_share", "harmonics"]
    if heart:
        odd = ~F.col("hr").between(*HEART_RATE) | (F.col("longest") > BEAT_GAP)
        some = F.col("beats") >= 3
        checks += [
            ("ecg_beats", F.when(F.col("beats") < 3, "critical")), ("ecg_rhythm", F.when(some & odd, "warning")),
            ("ecg_irregular", F.when(some & ~odd & (F.col("ratio") > INTERVAL_RATIO), "info")), ("ecg_morphology", F.when(some & (F.col("like") < LIKE_TEMPLATE), "warning")),
        ]
        measures += ["beats", "hr", "longest", "ratio", "like"]
    return _judged(d, checks, measures)


def fixes(report: DataFrame, drift_cutoff: float = 0.5) -> DataFrame:
    """Adds `fixes` to diagnose()'s rows: the repairs that the issues call for, as (step, parameters as JSON), in a safe order.
    An offset needs none where a highpass or a detrending takes it off anyway."""
    has = lambda code: F.array_contains(F.transform(F.split("issues", ","), lambda x: F.split(x, ":")[0]), code)
    step = lambda name, parameters: F.struct(F.lit(name).alias("step"), (parameters if isinstance(parameters, Column) else F.lit(parameters)).alias("parameters"))
    offset = has("dc_offset") & ~has("drift") & ~has("trend")
    wanted = {
        "remove_missing": (has("missing"), '{"method": "interpolate"}'), "remove_outliers": (has("spikes"), '{"method": "spike", "threshold": 10.0, "window": 5}'),
        "highpass": (has("drift"), json.dumps({"cutoff": drift_cutoff})), "detrend": (has("trend"), '{"kind": "linear"}'), "remove_dc": (offset, "{}"),
    }
    if "mains_hz" in report.columns:
        times = F.when(F.col("harmonics"), 99).otherwise(1)
        kind = has("mains") & ~F.col("issues").contains("mains:info")
        wanted["notch"] = (kind, F.format_string('{"freq": %.1f, "harmonics": %d}', F.coalesce("mains_hz", F.lit(0.0)), times))
    each = [F.when(wanted[name][0], step(name, wanted[name][1])) for name in FIX_ORDER if name in wanted]
    return report.withColumn("fixes", F.filter(F.array(*each), lambda x: x.isNotNull()))


def timeline(samples: DataFrame, window: float = 10.0, step: float | None = None, fs: float | None = None, **checks) -> DataFrame:
    """rec, t_start, t_end, score, grade, ok and issues (codes but infos, sorted) of each full window of so many seconds
    (samples without a rate), `step` apart. Every window is a recording of its own to diagnose(), so windows run side by side."""
    rate = fs or 1.0
    win, hop = round(window * rate), round((step or window) * rate)
    if win < 32:
        raise ValueError("a window needs 32 samples or more")
    kind = samples.schema["rec"].dataType
    key = F.to_json(F.struct("rec", F.col("w").alias("w")))
    cut = windows(samples, win, hop).select(key.alias("rec"), F.col("pos").alias("idx"), "value")
    found = diagnose(cut, fs, **checks).withColumn("key", F.from_json("rec", f"rec {kind.simpleString()}, w long"))
    codes = F.filter(F.split("issues", ","), lambda x: (x != "") & ~x.endswith(":info"))
    start = F.col("key.w") * hop
    names = F.array_join(F.array_sort(F.array_distinct(F.transform(codes, lambda x: F.split(x, ":")[0]))), ",")
    return found.select(F.col("key.rec").alias("rec"), (start / rate).alias("t_start"), ((start + win) / rate).alias("t_end"), "score", "grade", "ok", names.alias("issues"))


def auto_clean(samples: DataFrame, fs: float | None = None, mains: float | None = None, drift_cutoff: float | None = 0.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The samples after the repairs that diagnose() calls for, and its reports before, with `fixes`, and after.

    Recordings with the same repairs are repaired together; of the reports only the few different lists of repairs reach the
    driver.
    """
    cleaned, before = repaired(samples, fs, mains, drift_cutoff)
    return cleaned, before, _diagnosed(cleaned, fs, mains, drift_cutoff)


def repaired(samples: DataFrame, fs: float | None = None, mains: float | None = None, drift_cutoff: float | None = 0.5) -> tuple[DataFrame, DataFrame]:
    """auto_clean() without the report after the repairs. Each repair is one pass over the recordings that call for it, whatever
    else they call for: every list has the order of FIX_ORDER."""
    from undula.plans.pipeline import STEPS

    x = stored(samples.select("rec", "idx", "value"))
    short = within_a_chunk(x)
    before = stored(fixes(_diagnosed(x, fs, mains, drift_cutoff), drift_cutoff or 0.5))
    plans = [[tuple(p) for p in r.fixes] for r in before.select("fixes").distinct().collect()]
    for repair in sorted({p for plan in plans for p in plan}, key=lambda p: (FIX_ORDER.index(p[0]), p)):
        name, parameters = repair
        own, rest = x, None
        if not all(repair in plan for plan in plans):
            called = F.exists("fixes", lambda f: (f["step"] == name) & (f["parameters"] == parameters))
            marked = told(x, before.select("rec", called.alias("called")), short)
            own, rest = (marked.where(c).select("rec", "idx", "value") for c in (F.col("called"), ~F.col("called")))
        own = STEPS[name](own, fs, **json.loads(parameters)).select("rec", "idx", "value")
        x = stored(own if rest is None else own.unionByName(rest))
    return x, before


def screen(samples: DataFrame, fs: float | None = None) -> DataFrame:
    """Fewer checks than diagnose(), on the signal as it is: gaps, length, constancy, clipping, flat runs, offset, unsteady
    spread and trend, without repairs or early exits, and with severities of its own: a first look. The query `screen` and its
    SQL hold this."""
    s = stored(samples.select("rec", "idx", "value"))
    short = within_a_chunk(s)
    basic = stored(s.groupBy("rec").agg(
        (F.max("idx") + 1).alias("n"), F.avg(F.col("value").isNull().cast("int")).alias("missing"),
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("lo"), F.max("value").alias("hi"), _steady_corr().alias("corr"),
    ))
    distinct = s.select("rec", "value").distinct().groupBy("rec").agg(F.count("value").alias("distinct"))
    # Runs of the lowest and highest value are clipping, others flat: only long runs need to know those, no sample does.
    flat_from = max(5, round(0.1 * fs)) if fs else 10
    edge = (F.col("value") == F.col("lo")) | (F.col("value") == F.col("hi"))
    runs = stored(run_lengths(s, "value", ["rec"], short).where("length >= 3")).join(basic.select("rec", "lo", "hi"), "rec")
    runs = runs.groupBy("rec").agg(F.sum(F.when(edge, F.col("length"))).alias("clipped"), F.sum(F.when(~edge & (F.col("length") >= flat_from), F.col("length"))).alias("flat"))
    part = _eighth(F.col("idx"), F.col("n"))
    parts = told(s, basic.where("n >= 256").select("rec", "n"), short)
    parts = parts.groupBy("rec", part.alias("part")).agg(F.stddev_pop("value").alias("d")).groupBy("rec").agg((F.max("d") / F.min(F.when(F.col("d") > 0, F.col("d")))).alias("spread"))
    d = basic.join(stored(distinct), "rec").join(runs, "rec", "left").join(stored(parts), "rec", "left").fillna(0, ["clipped", "flat"])
    r2 = F.col("corr") * F.col("corr")
    usable = (F.col("n") >= 32) & (F.col("std") > 0)
    fine = usable & (F.col("distinct") > 16)
    checks = [
        ("missing", F.when(F.col("missing") > 0.2, "critical").when(F.col("missing") > 0, "warning")),
        ("short", F.when(F.col("n") < 32, "warning")),
        ("constant", F.when(F.coalesce(F.col("std"), F.lit(0.0)) == 0, "critical")),
        ("digital", F.when(usable & (F.col("distinct") <= 16), "info")),
        ("clipping", F.when(fine & (F.col("clipped") > 0.05 * F.col("n")), "critical").when(fine & (F.col("clipped") >= F.greatest(F.lit(3.0), 0.002 * F.col("n"))), "warning")),
        ("flatline", F.when(fine & (F.col("flat") > 0.2 * F.col("n")), "critical").when(fine & (F.col("flat") > 0.01 * F.col("n")), "warning")),
        ("dc_offset", F.when(usable & (F.abs("mean") > F.col("std")), "info")),
        ("nonstationary", F.when(usable & (F.col("spread") > 5), "warning")),
        ("trend", F.when(usable & (r2 > 0.3), "warning")),
    ]
    return _judged(d, checks, ["missing", "clipped", "flat", "spread"])


def flat_mask(samples: DataFrame, least: int) -> DataFrame:
    """Adds `flat`: whether a sample lies in a run of `least` equal values or more."""
    runs = run_lengths(samples, "value", ["rec"]).where(F.col("length") >= least)
    spans = runs.select("rec", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("length") - 1)).alias("idx"), F.lit(True).alias("flat"))
    return samples.join(spans, ["rec", "idx"], "left").fillna(False, ["flat"])


def missing_runs(samples: DataFrame) -> DataFrame:
    """The gaps of each recording: rec, first, length."""
    return run_lengths(samples.withColumn("gap", F.when(F.col("value").isNull(), F.lit(1))), "gap", ["rec"]).select("rec", "first", "length")
