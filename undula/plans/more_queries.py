"""More signal queries: transforms, exports, variations and events with their SQL, and those that SQL can't express."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.operators import augment, cleaning, ecg, events, features, filtering, forecast, outliers, quality, spectral, statistics
from undula.plans.pipeline import Pipeline, Signals
from undula.plans.queries import GAPPY, SPIKY, TD, TIME, TYPES, USER, VECTORS, query, rounded
from undula.plans.queries import _r as r6
from undula.sources import export
from undula.sources.tables import daily_orders, gappy, hourly_by_type, spiky, user_series, vectors

#: Hourly channels without their gaps, and with gaps of their own.
HOLES = f"{TYPES}, h2 AS (SELECT rec, idx, CASE WHEN (idx + length(rec)) % 5 <> 0 THEN coalesce(value, 0) END AS value FROM c)"


@query(f"{HOLES}, w AS (SELECT idx FROM h2 GROUP BY idx HAVING bool_and(value IS NOT NULL)) SELECT rec, idx, round(value, 6) + 0.0 AS value FROM h2 JOIN w USING (idx)")
def drop_rows(spark: SparkSession, folder: str) -> DataFrame:
    value = F.when((F.col("idx") + F.length("rec")) % 5 != 0, F.coalesce("value", F.lit(0.0)))
    return rounded(cleaning.drop_rows(hourly_by_type(spark, folder).withColumn("value", value)).select("rec", "idx", "value"))


HIT = f"{SPIKY}, q AS (SELECT rec, avg(value) AS a, stddev_pop(value) AS b FROM g GROUP BY rec), o AS (SELECT rec, idx, CASE WHEN abs(value - a) / (b + 1e-12) <= 3 THEN value END AS value FROM g JOIN q USING (rec))"


@query(f"{HIT} SELECT rec, idx, round(value, 6) + 0.0 AS value FROM o")
def remove_outliers_nan(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(outliers.remove_outliers(spiky(user_series(spark, folder)), "zscore", "nan"))


@query(f"""{HIT}, n AS (SELECT rec, idx, value, last_value(CASE WHEN value IS NOT NULL THEN idx END IGNORE NULLS) OVER a AS i0, last_value(value IGNORE NULLS) OVER a AS v0,
    first_value(CASE WHEN value IS NOT NULL THEN idx END IGNORE NULLS) OVER b AS i1, first_value(value IGNORE NULLS) OVER b AS v1
  FROM o WINDOW a AS (PARTITION BY rec ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY rec ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT rec, idx, round(CASE WHEN value IS NOT NULL THEN value WHEN i0 IS NULL THEN v1 WHEN i1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (idx - i0) / (i1 - i0) END, 6) + 0.0 AS value FROM n""")
def remove_outliers_interpolate(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(outliers.remove_outliers(spiky(user_series(spark, folder)), "zscore", "interpolate"))


@query(f"""{USER}, d AS (SELECT rec, value - 2 * (idx % 30) AS d FROM s), q AS (SELECT rec, count(*) AS n, avg(d) AS m, stddev_samp(d) AS sd FROM d GROUP BY rec HAVING count(*) > 1 AND stddev_samp(d) > 0)
SELECT rec, n, round(m / (sd / sqrt(n)), 6) + 0.0 AS t, round(m / sd, 6) + 0.0 AS cohen_d FROM q""")
def ttest_paired(spark: SparkSession, folder: str) -> DataFrame:
    s = user_series(spark, folder)
    return rounded(statistics.paired_ttest(s, s.withColumn("value", (2 * (F.col("idx") % 30)).cast("double"))).where("t IS NOT NULL").drop("p", "reject"))


@query(f"{USER}, q AS (SELECT rec, regr_slope(value, idx) AS b, regr_intercept(value, idx) AS a FROM s GROUP BY rec) SELECT rec, t::DOUBLE AS t, round(a + b * t, 6) + 0.0 AS value FROM q, (SELECT unnest([0, 10, 500]) AS t)")
def predict_line(spark: SparkSession, folder: str) -> DataFrame:
    s = user_series(spark, folder)
    at = s.select("rec").distinct().withColumn("t", F.explode(F.array(F.lit(0.0), F.lit(10.0), F.lit(500.0))))
    return rounded(statistics.predict(statistics.linear_regression(s), at))


#: The spectrum of whole vectors, of any even length.
SPECTRUM = f"""{VECTORS}, w AS (SELECT rec, idx, value * (0.5 - 0.5 * cos(2 * pi() * idx / n)) AS x, n FROM s JOIN (SELECT rec, count(*) AS n FROM s GROUP BY rec) USING (rec)),
z AS (SELECT rec, bin, any_value(n) AS n, sum(x * cos(2 * pi() * bin * idx / n)) AS re, sum(x * sin(2 * pi() * bin * idx / n)) AS im FROM w, LATERAL (SELECT unnest(range(0, n // 2 + 1)) AS bin) GROUP BY 1, 2),
m AS (SELECT rec, bin, bin / n AS freq, sqrt(re * re + im * im) / (n / 2) * CASE WHEN bin IN (0, n / 2) THEN 1 ELSE 2 END AS magnitude FROM z)"""


@query(f"""{SPECTRUM} SELECT rec, round(arg_max(CASE WHEN freq > 0 THEN freq END, CASE WHEN freq > 0 THEN magnitude END), 6) + 0.0 AS peak_frequency,
  round(sum(CASE WHEN freq BETWEEN 0.1 AND 0.3 THEN magnitude * magnitude ELSE 0 END), 6) + 0.0 AS band_power FROM m GROUP BY rec""")
def fft_peak_and_band(spark: SparkSession, folder: str) -> DataFrame:
    z = spectral.fft(vectors(spark, folder))
    return rounded(spectral.peak_frequency(z).join(spectral.band_power(z, 0.1, 0.3), "rec"))


@query(f"{SPECTRUM} SELECT rec, bin::INT AS bin, row_number() OVER (PARTITION BY rec ORDER BY magnitude DESC, freq)::INT AS rank, {r6('magnitude')} FROM m WHERE freq > 0 QUALIFY rank <= 3")
def dominant_bands(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(spectral.dominant(spectral.fft(vectors(spark, folder)), 3).select("rec", "bin", "rank", "magnitude"))


#: Welch's psd with segments of 32, half of which overlap, of vectors of any length from 32 on.
PSD = f"""{VECTORS}, len AS (SELECT rec, count(*) AS n FROM s GROUP BY rec HAVING count(*) >= 32),
g AS (SELECT rec, w, idx - w * 16 AS pos, value FROM s JOIN len USING (rec), LATERAL (SELECT unnest(range(0, (n - 32) // 16 + 1)) AS w) WHERE idx BETWEEN w * 16 AND w * 16 + 31),
x AS (SELECT rec, w, pos, (value - avg(value) OVER (PARTITION BY rec, w)) * (0.5 - 0.5 * cos(2 * pi() * pos / 32)) AS x FROM g),
z AS (SELECT rec, w, bin, pow(sum(x * cos(2 * pi() * bin * pos / 32)), 2) + pow(sum(x * sin(2 * pi() * bin * pos / 32)), 2) AS p FROM x, range(0, 17) t(bin) GROUP BY 1, 2, 3),
p AS (SELECT rec, z.bin / 32 AS freq, avg(p) / 12.0 * CASE WHEN z.bin IN (0, 16) THEN 1 ELSE 2 END AS psd FROM z GROUP BY rec, z.bin)"""


@query(f"""{PSD}, a AS (SELECT rec, freq, psd, lag(freq) OVER w AS low, (psd + lag(psd) OVER w) / 2 * (freq - lag(freq) OVER w) AS area FROM p WINDOW w AS (PARTITION BY rec ORDER BY freq)),
b AS (SELECT rec, sum(area) AS total_power, arg_max(freq, psd) AS peak_frequency, sum(CASE WHEN low >= 0.1 AND freq <= 0.25 THEN area ELSE 0 END) AS mid_power FROM a GROUP BY rec)
SELECT rec, {r6('total_power', 'peak_frequency', 'mid_power')}, round(mid_power / (total_power + 1e-300), 6) + 0.0 AS mid_share FROM b""")
def psd_bands(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(spectral.band_powers(spectral.welch(vectors(spark, folder), 1.0, 32), {"mid": (0.1, 0.25)}))


@query(f"""{PSD}, t AS (SELECT rec, sum(psd) AS total, count(*) AS bins FROM p GROUP BY rec), q AS (SELECT rec, freq, psd, psd / total AS q, bins, sum(psd / total) OVER (PARTITION BY rec ORDER BY freq) AS cum FROM p JOIN t USING (rec)),
c AS (SELECT rec, sum(freq * q) AS c FROM q GROUP BY rec), d AS (SELECT rec, c, sqrt(sum(pow(freq - c, 2) * q)) AS sp, sum(pow(freq - c, 3) * q) AS m3, sum(pow(freq - c, 4) * q) AS m4, exp(avg(ln(psd + 1e-300))) / avg(psd) AS fl,
  min(CASE WHEN cum >= 0.85 - 1e-12 THEN freq END) AS ro, -sum(CASE WHEN q > 0 THEN q * log2(q) ELSE 0 END) / log2(count(*)) AS en, arg_max(freq, psd) AS dom, min(CASE WHEN cum >= 0.9 - 1e-12 THEN freq END) AS s90, min(CASE WHEN cum >= 0.95 - 1e-12 THEN freq END) AS s95
  FROM q JOIN c USING (rec) GROUP BY rec, c)
SELECT rec, round(c, 6) + 0.0 AS fd_spectral_centroid, round(sp, 6) + 0.0 AS fd_spectral_spread, round(m3 / pow(sp, 3), 6) + 0.0 AS fd_spectral_skewness, round(m4 / pow(sp, 4), 6) + 0.0 AS fd_spectral_kurtosis, round(fl, 6) + 0.0 AS fd_spectral_flatness,
  round(ro, 6) + 0.0 AS fd_spectral_rolloff, round(en, 6) + 0.0 AS fd_spectral_entropy, round(dom, 6) + 0.0 AS fd_dominant_frequency, round(s90, 6) + 0.0 AS fd_sef_90hz, round(s95, 6) + 0.0 AS fd_sef_95hz FROM d""")
def frequency_features(spark: SparkSession, folder: str) -> DataFrame:
    found = features.frequency_domain(spectral.welch(vectors(spark, folder), 1.0, 32))
    return rounded(found.select([c for c in found.columns if not c.startswith("fd_band")]))


@query(f"""{VECTORS}, n AS (SELECT rec, count(*) AS n FROM s GROUP BY rec HAVING count(*) >= 16),
g AS (SELECT rec, w, idx + 8 - w * 8 AS pos, value FROM s JOIN n USING (rec), LATERAL (SELECT unnest(range(0, ceil((n + 16 - 16) / 8)::BIGINT + 1)) AS w) WHERE idx + 8 - w * 8 BETWEEN 0 AND 15),
z AS (SELECT rec, w, bin, sum(value * (0.5 - 0.5 * cos(2 * pi() * pos / 16)) * cos(2 * pi() * bin * pos / 16)) / 8 AS re, -sum(value * (0.5 - 0.5 * cos(2 * pi() * pos / 16)) * sin(2 * pi() * bin * pos / 16)) / 8 AS im FROM g, range(0, 9) t(bin) GROUP BY 1, 2, 3)
SELECT rec, w, round(w * 8.0, 6) + 0.0 AS t, z.bin::INT AS bin, round(z.bin / 16, 6) + 0.0 AS freq, round(sqrt(re * re + im * im), 6) + 0.0 AS magnitude FROM z""")
def stft(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(spectral.stft(vectors(spark, folder), 1.0, 16).select("rec", "w", "t", "bin", "freq", "magnitude"))


@query(f"""{VECTORS}, z AS (SELECT rec, idx, (value - avg(value) OVER k) / stddev_pop(value) OVER k AS z, count(*) OVER k AS n FROM s WINDOW k AS (PARTITION BY rec)),
y AS (SELECT rec, idx, value * (idx % 3) AS value FROM s), v AS (SELECT rec, idx, (value - avg(value) OVER k) / stddev_pop(value) OVER k AS v FROM y WINDOW k AS (PARTITION BY rec))
SELECT z.rec, (z.idx - v.idx)::INT AS lag, round(sum(z * v) / any_value(n), 6) + 0.0 AS r FROM z JOIN v ON z.rec = v.rec AND abs(z.idx - v.idx) <= 6 GROUP BY 1, 2""")
def cross_correlation(spark: SparkSession, folder: str) -> DataFrame:
    s = vectors(spark, folder)
    return rounded(statistics.cross_correlation(s, s.withColumn("value", F.col("value") * (F.col("idx") % 3)), 6))


def _segments(name: str, source: str) -> str:
    return f"""{name}g AS (SELECT rec, w, idx - w * 8 AS pos, value FROM {source} JOIN n USING (rec), LATERAL (SELECT unnest(range(0, (n - 16) // 8 + 1)) AS w) WHERE idx BETWEEN w * 8 AND w * 8 + 15),
{name}x AS (SELECT rec, w, pos, (value - avg(value) OVER (PARTITION BY rec, w)) * (0.5 - 0.5 * cos(2 * pi() * pos / 16)) AS x FROM {name}g),
{name}z AS (SELECT rec, w, bin, sum(x * cos(2 * pi() * bin * pos / 16)) AS re, -sum(x * sin(2 * pi() * bin * pos / 16)) AS im FROM {name}x, range(0, 9) t(bin) GROUP BY 1, 2, 3)"""


@query(f"""{VECTORS}, n AS (SELECT rec, count(*) AS n FROM s GROUP BY rec HAVING count(*) >= 16), y AS (SELECT rec, idx, value * (1 + idx % 3) AS value FROM s), {_segments('a', 's')}, {_segments('b', 'y')},
c AS (SELECT rec, az.bin, avg(az.re * az.re + az.im * az.im) AS aa, avg(bz.re * bz.re + bz.im * bz.im) AS bb, avg(az.re * bz.re + az.im * bz.im) AS re, avg(az.re * bz.im - az.im * bz.re) AS im FROM az JOIN bz USING (rec, w, bin) GROUP BY 1, 2)
SELECT rec, bin::INT AS bin, round(bin / 16, 6) + 0.0 AS freq, round((re * re + im * im) / (aa * bb), 6) + 0.0 AS coherence FROM c WHERE bin > 0""")
def coherence(spark: SparkSession, folder: str) -> DataFrame:
    s = vectors(spark, folder)
    return rounded(spectral.coherence(s, s.withColumn("value", F.col("value") * (1 + F.col("idx") % 3)), 1.0, 16).where("bin > 0"))


@query(f"{VECTORS}, n AS (SELECT rec, count(*) AS n FROM s GROUP BY rec) SELECT rec, (idx + 5) % n AS idx, round(-1.5 * value, 6) + 0.0 AS value FROM s JOIN n USING (rec)")
def vary_shift_scale_invert(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(augment.invert(augment.scale(augment.time_shift(vectors(spark, folder), 5), 1.5)))


@query(f"""{VECTORS}, n AS (SELECT rec, count(*) AS n FROM s GROUP BY rec), a AS (SELECT rec, idx, least(idx * 1.25::DOUBLE, n - 1) AS place FROM s JOIN n USING (rec))
SELECT a.rec, a.idx, round(x.value + coalesce(y.value - x.value, 0) * (place - floor(place)), 6) + 0.0 AS value FROM a JOIN s x ON x.rec = a.rec AND x.idx = floor(place) LEFT JOIN s y ON y.rec = a.rec AND y.idx = floor(place) + 1""")
def vary_stretch(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(augment.time_stretch(vectors(spark, folder), 1.25))


@query(f"""{TYPES}, n AS (SELECT count(DISTINCT rec) AS n, max(idx) + 1 AS len FROM c), w AS (SELECT rec, w, c.idx - w * 6 AS pos, value FROM (SELECT rec, idx, coalesce(value, 0) AS value FROM c) c, n, LATERAL (SELECT unnest(range(0, (len - 12) // 6 + 1)) AS w) WHERE c.idx BETWEEN w * 6 AND w * 6 + 11),
g AS (SELECT w, rec, sum(floor(value::FLOAT + 0.001))::BIGINT AS x FROM w GROUP BY 1, 2 HAVING count(value) = 12)
SELECT w, string_agg(x::VARCHAR, ',' ORDER BY rec) AS sums FROM g GROUP BY w HAVING count(*) = (SELECT n FROM n)""")
def training_windows(spark: SparkSession, folder: str) -> DataFrame:
    channels = hourly_by_type(spark, folder).select(F.lit(1).alias("rec"), F.col("rec").alias("channel"), "idx", F.coalesce("value", F.lit(0.0)).alias("value"))
    made = export.examples(channels, 12, 6)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, v: a + F.floor(v + 0.001)).cast("string")
    return made.select("w", F.array_join(F.transform("x", total), ",").alias("sums"))


@query(f"""{USER}, n AS (SELECT rec, count(*) AS n FROM s GROUP BY rec), b AS (SELECT rec, idx * 10 // greatest(n, 10) AS bucket, idx, value FROM s JOIN n USING (rec))
SELECT rec, bucket, min(idx) AS first, round(min(value), 6) + 0.0 AS low, round(max(value), 6) + 0.0 AS high, round(avg(value), 6) + 0.0 AS mean FROM b GROUP BY 1, 2""")
def picture_points(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(export.thinned(user_series(spark, folder), 10))


@query(f"""{USER}, k AS (SELECT rec, idx * 200 AS at, idx % 7 AS k FROM s), m AS (SELECT rec, count(*) AS ref, sum((k <> 3)::INT)::BIGINT AS tp, sum((k <> 3)::INT + (k = 5)::INT)::BIGINT AS det FROM k GROUP BY rec)
SELECT rec, tp, ref - tp AS fn, det - tp AS fp, round(tp / ref, 6) + 0.0 AS se, round(CASE WHEN det > 0 THEN tp / det ELSE 0 END, 6) + 0.0 AS ppv,
  round(CASE WHEN tp > 0 THEN 2 * (tp / ref) * (tp / det) / (tp / ref + tp / det) ELSE 0 END, 6) + 0.0 AS f1 FROM m""")
def match_beats(spark: SparkSession, folder: str) -> DataFrame:
    """Beats of which one in seven isn't found, the others 12 samples late, and one in seven twice, the second time too late."""
    known = user_series(spark, folder).select("rec", "idx")
    at = F.col("idx") * 200
    late = F.when(F.col("idx") % 7 == 5, F.array(at + 12, at + 90)).when(F.col("idx") % 7 != 3, F.array(at + 12)).otherwise(F.array().cast("array<long>"))
    return rounded(ecg.match_beats(known.select("rec", at.alias("idx")), known.select("rec", F.explode(late).alias("idx")), 100.0))


@query(f"""{USER}, n AS (SELECT rec, count(*) AS n FROM s GROUP BY rec), p AS (SELECT rec, unnest([0, 10, 25]) AS a FROM n), q AS (SELECT rec, a, lead(a, 1, n) OVER (PARTITION BY rec ORDER BY a) AS b FROM p JOIN n USING (rec) WHERE a < n)
SELECT q.rec, round(a / 2, 6) + 0.0 AS start_s, round(b / 2, 6) + 0.0 AS end_s, (b - a)::BIGINT AS n, round(avg(value), 6) + 0.0 AS mean, round(stddev_pop(value), 6) + 0.0 AS std FROM q JOIN s ON s.rec = q.rec AND s.idx >= a AND s.idx < b GROUP BY q.rec, a, b""")
def segments(spark: SparkSession, folder: str) -> DataFrame:
    s = user_series(spark, folder)
    points = s.where("idx IN (10, 25)").select("rec", "idx")
    return rounded(events.segments_between(s, points, 2.0))


@query(f"""{GAPPY}, f AS (SELECT rec, idx, coalesce(value, avg(value) OVER (PARTITION BY rec)) AS value FROM g), k AS (SELECT rec, idx, greatest(least(value, 100), 5) AS value FROM f), m AS (SELECT rec, min(value) AS a, max(value) AS b FROM k WHERE idx >= 4 GROUP BY rec)
SELECT rec, round((idx - 4) / 2, 6) + 0.0 AS time, round(CASE WHEN a = b THEN 0 ELSE (value - a) / (b - a) END, 6) + 0.0 AS value FROM k JOIN m USING (rec) WHERE idx >= 4""")
def saved_plan(spark: SparkSession, folder: str) -> DataFrame:
    """A session's steps, as JSON and back, run on the recordings."""
    signals = Signals(gappy(user_series(spark, folder)), 2.0)
    plan = signals.remove_missing(method="mean").clip(low=5.0, high=100.0).crop(start=2.0).minmax().to_pipeline("demo")
    return rounded(Pipeline.from_dict(plan.to_dict()).run(signals).to_frame())


@query(f"""{USER}, x AS (SELECT rec, idx // 16 AS w, idx, value FROM s JOIN (SELECT rec, count(*) AS n FROM s GROUP BY rec) USING (rec) WHERE (idx // 16 + 1) * 16 <= n),
{TIME.format(key='rec, w')} SELECT rec, round(w * 8.0, 6) + 0.0 AS t_start, round(w * 8.0 + 8, 6) + 0.0 AS t_end, {r6(*(f'td_{t}' for t in TD))} FROM q""")
def windowed_extract(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(features.windowed_features(user_series(spark, folder), 8.0, None, 2.0, ("time",)))


# What SQL can't express: tests hold these against NumPy, brute force or theory.


#: Samples of a beat's slot and samples a second of the beats made of events: 80 beats a minute.
SLOT, BEAT_RATE = 75, 100.0


def beats(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """A heartbeat for each event of a user, as samples in runs (see core.py) and as the beats' places: every beat has a slot of its
    own, in which its place and height follow the event's value, a narrow wave and a broad low one after it."""
    s = user_series(spark, folder)
    place, height = (20 + F.pmod(F.floor(F.coalesce("value", F.lit(0.0))), F.lit(9))).cast("long"), 1 + F.pmod(F.coalesce("value", F.lit(0.0)), F.lit(10.0)) / 50
    wave = lambda j, at, width: F.exp(-F.pow((j - at) / width, F.lit(2.0)))
    each = s.select("rec", "idx", place.alias("place"), height.alias("height"))
    values = F.transform(F.sequence(F.lit(0), F.lit(SLOT - 1)), lambda j: F.col("height") * wave(j, F.col("place"), 1.5) + 0.2 * wave(j, F.col("place") + 28, 6.0))
    return each.select("rec", (F.col("idx") * SLOT).alias("first"), values.alias("values")), each.select("rec", (F.col("idx") * SLOT + F.col("place")).alias("idx"))


@query()
def bandpass(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(filtering.butter(user_series(spark, folder), "bandpass", (1.0, 20.0), 64.0))


@query()
def highpass_slow(spark: SparkSession, folder: str) -> DataFrame:
    """A cut-off so low that the filter's memories are carried over the whole recording."""
    return rounded(filtering.butter(user_series(spark, folder), "highpass", 0.005, 100.0, chunk=16))


@query()
def notch(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(filtering.notch_filter(user_series(spark, folder), 10.0, 64.0, harmonics=3))


@query()
def resample(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(filtering.resample(user_series(spark, folder), 64.0, 50.0))


#: An analytic signal by the discrete Fourier transform, its negative frequencies left out.
ANALYTIC = f"""{USER}, n AS (SELECT rec, count(*) AS n FROM s GROUP BY rec),
z AS (SELECT rec, n, bin, sum(value * cos(2 * pi() * bin * idx / n)) AS re, -sum(value * sin(2 * pi() * bin * idx / n)) AS im FROM s JOIN n USING (rec), LATERAL (SELECT unnest(range(0, n // 2 + 1)) AS bin) GROUP BY ALL),
w AS (SELECT rec, n, bin, re, im, CASE WHEN bin = 0 OR 2 * bin = n THEN 1 ELSE 2 END / n AS w FROM z),
a AS (SELECT rec, s.idx, sum(w * (re * cos(2 * pi() * bin * s.idx / n) - im * sin(2 * pi() * bin * s.idx / n))) AS re, sum(w * (re * sin(2 * pi() * bin * s.idx / n) + im * cos(2 * pi() * bin * s.idx / n))) AS im
  FROM s JOIN w USING (rec) GROUP BY ALL)"""


@query(f"{ANALYTIC} SELECT rec, idx, round(sqrt(re * re + im * im), 6) + 0.0 AS envelope FROM a")
def envelope(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(spectral.hilbert(user_series(spark, folder), 64.0).select("rec", "idx", "envelope"))


@query(f"""{USER}, n AS (SELECT rec, count(*) AS n FROM s GROUP BY rec), k AS (SELECT j, [-36, 9, 44, 69, 84, 89, 84, 69, 44, 9, -36][j + 6] / 429.0::DOUBLE AS w FROM range(-5, 6) t(j))
SELECT s.rec, s.idx, round(sum(w * y.value), 6) + 0.0 AS value FROM s JOIN n USING (rec) JOIN k ON true JOIN s y ON y.rec = s.rec AND y.idx = s.idx + j WHERE s.idx BETWEEN 5 AND n - 6 GROUP BY 1, 2""")
def savgol_interior(spark: SparkSession, folder: str) -> DataFrame:
    """Cubic over eleven samples, where all eleven are there; the weights of the SQL are the published ones."""
    s = user_series(spark, folder)
    n = s.groupBy("rec").agg(F.max("idx").alias("last"))
    return rounded(filtering.savgol(s).join(n, "rec").where("idx BETWEEN 5 AND last - 5").select("rec", "idx", "value"))


@query(f"""{USER}, n AS (SELECT rec, count(*) AS n FROM s GROUP BY rec HAVING count(*) > 33),
w AS (SELECT rec, idx, value FROM s UNION ALL SELECT rec, -idx, 2 * first_value - value FROM s JOIN (SELECT rec, arg_min(value, idx) AS first_value FROM s GROUP BY rec) USING (rec) WHERE idx BETWEEN 1 AND 33
  UNION ALL SELECT rec, 2 * (n - 1) - idx, 2 * last_value - value FROM s JOIN n USING (rec) JOIN (SELECT rec, arg_max(value, idx) AS last_value FROM s GROUP BY rec) USING (rec) WHERE idx BETWEEN n - 34 AND n - 2),
h AS (SELECT m, (CASE WHEN m = 0 THEN 0.25 ELSE sin(0.25 * pi() * m) / (pi() * m) END) * (0.54 - 0.46 * cos(2 * pi() * (m + 5) / 10)) AS h FROM range(-5, 6) t(m)), g AS (SELECT m, h / sum(h) OVER () AS h FROM h),
b AS (SELECT p.m + q.m AS m, sum(p.h * q.h) AS h FROM g p, g q GROUP BY 1)
SELECT s.rec, s.idx, round(sum(h * w.value), 6) + 0.0 AS value FROM s JOIN n USING (rec) JOIN b ON true JOIN w ON w.rec = s.rec AND w.idx = s.idx + m GROUP BY 1, 2""")
def fir_lowpass(spark: SparkSession, folder: str) -> DataFrame:
    """Eleven taps, forward and backward, of recordings that are long enough."""
    return rounded(filtering.fir_filter(user_series(spark, folder), 8.0, 64.0, taps=11).where("value IS NOT NULL"))


@query(f"{USER}, m AS (SELECT rec, avg(value) AS m FROM s GROUP BY rec) SELECT rec, idx, round(value - m, 6) + 0.0 AS value FROM s JOIN m USING (rec)")
def detrend_constant(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(statistics.detrend(user_series(spark, folder), "constant"))


@query(f"""{USER}, n AS (SELECT rec, count(*) AS n FROM s GROUP BY rec HAVING count(*) > 3), x AS (SELECT rec, idx, value, idx - (n - 1) / 2 AS x, (n * n - 1) / 12.0::DOUBLE AS m2, n FROM s JOIN n USING (rec)),
c AS (SELECT rec, avg(value) AS a, sum(x * value) / sum(x * x) AS b, sum((x * x - m2) * value) / sum((x * x - m2) * (x * x - m2)) AS c FROM x GROUP BY rec)
SELECT rec, idx, round(value - a - b * x - c * (x * x - m2), 6) + 0.0 AS value FROM x JOIN c USING (rec)""")
def detrend_quadratic(spark: SparkSession, folder: str) -> DataFrame:
    """The SQL takes off polynomials that are orthogonal to each other."""
    s = user_series(spark, folder)
    long = s.groupBy("rec").agg(F.count("*").alias("n")).where("n > 3").select("rec")
    return rounded(statistics.detrend_quadratic(s.join(long, "rec", "left_semi")).select("rec", "idx", "value"))


@query()
def wavelet(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(spectral.wavelet(vectors(spark, folder), [0.05, 0.1, 0.2]))


@query()
def quality_spectral(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(quality.fixes(quality.diagnose(user_series(spark, folder), 64.0)).withColumn("fixes", F.to_json("fixes")))


@query()
def quality_heart(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(quality.diagnose(beats(spark, folder)[0], BEAT_RATE, signal_type="ecg"))


@query()
def quality_timeline(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(quality.timeline(spiky(user_series(spark, folder)), 0.5, 0.25, 64.0))


@query()
def auto_clean(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(quality.repaired(spiky(gappy(user_series(spark, folder))))[0])


@query()
def heart_beats(spark: SparkSession, folder: str) -> DataFrame:
    return ecg.pan_tompkins(beats(spark, folder)[0], BEAT_RATE)


@query()
def heart_beats_matched(spark: SparkSession, folder: str) -> DataFrame:
    """How well both detectors find the beats that the samples were made of."""
    x, known = beats(spark, folder)
    x = filtering.written_rows(x)
    return rounded(reduce(DataFrame.unionByName, [ecg.match_beats(known, ecg.detect_r_peaks(x, BEAT_RATE, m), BEAT_RATE).withColumn("method", F.lit(m)) for m in ("pantompkins", "simple")]))


@query()
def hrv(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(features.hrv(user_series(spark, folder).withColumn("value", 700 + 2 * F.col("value"))))


@query()
def extract(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(features.extract(user_series(spark, folder), 64.0))


@query()
def normality_shapiro(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(statistics.shapiro(user_series(spark, folder)))


@query()
def normality_ks(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(statistics.ks_normal(user_series(spark, folder)))


@query()
def stationarity_adf(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(statistics.stationarity_adf(user_series(spark, folder)))


@query()
def change_points(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(events.change_points(user_series(spark, folder), least=5))


@query()
def anomaly_windows(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(events.anomaly_scores(spiky(user_series(spark, folder)), 4.0))


@query()
def forecast_holdout(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(forecast.forecast(user_series(spark, folder), 5, order=(1, 0, 1), holdout=True))


@query()
def forecast_seasonal(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(forecast.forecast(daily_orders(spark, folder), 28, order=(1, 0, 1), season=7, holdout=True))


@query()
def arima_models(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(forecast.arima(user_series(spark, folder), (1, 0, 1)).select("rec", "n", "loglik", "aic", "variance", F.col("ar")[0].alias("ar1"), F.col("ma")[0].alias("ma1"), F.col("trend")[0].alias("level")))


@query()
def wavelet_power(spark: SparkSession, folder: str) -> DataFrame:
    found = spectral.wavelet(user_series(spark, folder), [2.0, 8.0, 24.0], 64.0)
    return rounded(found.groupBy("rec", "freq").agg(F.avg(F.col("magnitude") * F.col("magnitude")).alias("power")))
