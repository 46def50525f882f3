"""The signal queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.operators import cleaning, epochs, features, normalize, outliers, quality, spectral, statistics
from undula.sources.tables import gappy, hourly_by_type, spiky, user_series, vectors

QUERIES = {}
ORACLES = {}

USER = "s AS (SELECT user_id AS rec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value FROM events)"
GAPPY = f"{USER}, g AS (SELECT rec, idx, CASE WHEN idx % 17 IN (3, 4) THEN NULL ELSE value END AS value FROM s)"
SPIKY = f"{USER}, g AS (SELECT rec, idx, value + CASE WHEN idx % 29 = 13 THEN 1000.0 ELSE 0.0 END AS value FROM s)"
TYPES = """m AS (SELECT event_type AS rec, epoch(ts)::BIGINT // 3600 AS hour, avg(value) AS value FROM (SELECT event_type, date_trunc('second', ts) AS ts, value FROM events) GROUP BY 1, 2),
h AS (SELECT min(hour) AS h0, max(hour) AS h1 FROM m),
c AS (SELECT r.rec, hour - h0 AS idx, m.value FROM (SELECT DISTINCT rec FROM m) r CROSS JOIN h CROSS JOIN LATERAL (SELECT unnest(range(h0, h1 + 1)) AS hour) LEFT JOIN m USING (rec, hour))"""
VECTORS = "s AS (SELECT vec_id AS rec, unnest(range(len(embedding))) AS idx, unnest(embedding)::DOUBLE AS value FROM embeddings)"


#: A beginning of some recordings, of another length each, as recordings of their own beside the whole ones.
BEGINNINGS = 1_000_000_000


def _beginnings(source: str, lengths: dict[int, int]) -> str:
    """SQL of the rows of `source` and, for users whose last digit is a key, of their first so many under another key."""
    some = " OR ".join(f"rec % 10 = {k} AND idx < {n}" for k, n in lengths.items())
    return f"(SELECT rec, idx, value FROM {source} UNION ALL SELECT rec + {BEGINNINGS}, idx, value FROM {source} WHERE {some})"


def with_beginnings(samples: DataFrame, lengths: dict[int, int]) -> DataFrame:
    some = F.expr(" OR ".join(f"rec % 10 = {k} AND idx < {n}" for k, n in lengths.items()))
    return samples.unionByName(samples.where(some).withColumn("rec", F.col("rec") + BEGINNINGS))


#: Added before rounding to six digits: many results lie halfway between two such numbers, where the last bit of a sum,
#: which depends on its order, would decide.
NUDGE = 1.23456789e-08


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {sql}".replace(", 6) + 0.0", f" + {NUDGE}, 6) + 0.0")
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal; -0.0 is 0.0."""
    return df.select(*(((F.round(F.col(c) + NUDGE, digits) + 0.0).alias(c) if t == "double" else F.col(c)) for c, t in df.dtypes))


def _r(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c.split('.')[-1]}" for c in columns)


def _filled(value: str) -> str:
    return f"{GAPPY} SELECT rec, idx, round({value}, 6) + 0.0 AS value FROM g"


LINE = f"""{GAPPY}, n AS (
  SELECT rec, idx, value, last_value(CASE WHEN value IS NOT NULL THEN idx END IGNORE NULLS) OVER a AS i0, last_value(value IGNORE NULLS) OVER a AS v0,
    first_value(CASE WHEN value IS NOT NULL THEN idx END IGNORE NULLS) OVER b AS i1, first_value(value IGNORE NULLS) OVER b AS v1
  FROM g WINDOW a AS (PARTITION BY rec ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY rec ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT rec, idx, CASE WHEN value IS NOT NULL THEN value WHEN i0 IS NULL THEN v1 WHEN i1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (idx - i0) / (i1 - i0) END AS value FROM n)"""


@query(f"{LINE} SELECT rec, idx, {_r('value')} FROM f")
def fill_interpolate(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(cleaning.fill(gappy(user_series(spark, folder)), "interpolate"))


@query(_filled("last_value(value IGNORE NULLS) OVER (PARTITION BY rec ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
def fill_forward(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(cleaning.fill(gappy(user_series(spark, folder)), "ffill"))


@query(_filled("first_value(value IGNORE NULLS) OVER (PARTITION BY rec ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"))
def fill_backward(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(cleaning.fill(gappy(user_series(spark, folder)), "bfill"))


@query(_filled("coalesce(value, 0)"))
def fill_zero(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(cleaning.fill(gappy(user_series(spark, folder)), "zero"))


@query(_filled("coalesce(value, avg(value) OVER (PARTITION BY rec))"))
def fill_mean(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(cleaning.fill(gappy(user_series(spark, folder)), "mean"))


@query(_filled("coalesce(value, median(value) OVER (PARTITION BY rec))"))
def fill_median(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(cleaning.fill(gappy(user_series(spark, folder)), "median"))


@query(f"{GAPPY} SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY idx) - 1 AS idx, {_r('value')} FROM g WHERE value IS NOT NULL")
def drop_missing(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(cleaning.fill(gappy(user_series(spark, folder)), "drop"))


@query(f"""{TYPES}, n AS (SELECT count(DISTINCT rec) AS n FROM c),
p AS (SELECT x.idx AS at, y.idx, sqrt(sum(pow(x.value - y.value, 2)) * (SELECT n FROM n) / count(*)) AS d
  FROM c x JOIN c y ON x.rec = y.rec AND x.idx <> y.idx WHERE x.value IS NOT NULL AND y.value IS NOT NULL AND x.idx IN (SELECT idx FROM c WHERE value IS NULL) GROUP BY 1, 2),
r AS (SELECT h.rec, h.idx, y.value, row_number() OVER (PARTITION BY h.rec, h.idx ORDER BY d, p.idx) AS k
  FROM c h JOIN p ON h.idx = p.at JOIN c y ON y.rec = h.rec AND y.idx = p.idx WHERE h.value IS NULL AND y.value IS NOT NULL),
f AS (SELECT rec, idx, avg(value) AS found FROM r WHERE k <= 5 GROUP BY 1, 2)
SELECT c.rec, c.idx, round(coalesce(value, found, avg(value) OVER (PARTITION BY c.rec)), 6) + 0.0 AS value FROM c LEFT JOIN f ON c.rec = f.rec AND c.idx = f.idx""")
def impute_knn(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(cleaning.impute_knn(hourly_by_type(spark, folder)))


@query(f"{USER} SELECT rec, idx - 10 AS idx, {_r('value')} FROM s WHERE idx >= 10 AND idx < 40")
def crop(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(cleaning.crop(user_series(spark, folder), 10, 40))


@query(f"{USER} SELECT rec, idx, round(greatest(least(value, 100), 5), 6) + 0.0 AS value FROM s")
def clip(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(cleaning.clip(user_series(spark, folder), 5, 100))


@query(f"{USER} SELECT rec, idx, round(value - avg(value) OVER (PARTITION BY rec), 6) + 0.0 AS value FROM s")
def remove_dc(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(cleaning.remove_dc(user_series(spark, folder)))


@query(f"{USER}, q AS (SELECT rec, quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.95) AS b FROM s GROUP BY rec) SELECT rec, idx, round(greatest(least(value, b), a), 6) + 0.0 AS value FROM s JOIN q USING (rec)")
def winsorize(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(cleaning.winsorize(user_series(spark, folder)))


def _normal(stats: str, value: str) -> str:
    return f"{USER}, q AS (SELECT rec, {stats} FROM s GROUP BY rec) SELECT rec, idx, round({value}, 6) + 0.0 AS value FROM s JOIN q USING (rec)"


@query(_normal("min(value) AS a, max(value) - min(value) AS b", "CASE WHEN b = 0 THEN 0 ELSE (value - a) / b END"))
def minmax(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(normalize.minmax(user_series(spark, folder)))


@query(_normal("avg(value) AS a, stddev_pop(value) AS b", "CASE WHEN b = 0 THEN 0 ELSE (value - a) / b END"))
def standardize(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(normalize.standardize(user_series(spark, folder)))


@query(_normal("median(value) AS a, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS b", "CASE WHEN b = 0 THEN 0 ELSE (value - a) / b END"))
def robust_scale(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(normalize.robust_scale(user_series(spark, folder)))


@query(_normal("sqrt(sum(value * value)) AS b", "CASE WHEN b = 0 THEN 0 ELSE value / b END"))
def l2_scale(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(normalize.l2(user_series(spark, folder)))


def _outliers(stats: str, hit: str) -> str:
    return f"{SPIKY}, q AS (SELECT rec, {stats} FROM g GROUP BY rec) SELECT rec, idx, {_r('value')}, {hit} AS outlier FROM g JOIN q USING (rec)"


@query(_outliers("avg(value) AS a, stddev_pop(value) AS b", "abs(value - a) / (b + 1e-12) > 3"))
def outliers_zscore(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(outliers.zscore(spiky(user_series(spark, folder))))


@query(_outliers("quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b", "value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)"))
def outliers_iqr(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(outliers.iqr(spiky(user_series(spark, folder))))


@query(_outliers("median(value) AS a, mad(value) AS b", "abs(value - a) / (1.4826 * b + 1e-12) > 3"))
def outliers_mad(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(outliers.mad(spiky(user_series(spark, folder))))


def _rolling(source: str, name: str, half: int) -> str:
    return f"""{name}_e AS (SELECT rec, arg_min(value, idx) AS head, arg_max(value, idx) AS tail, max(idx) AS last FROM {source} GROUP BY rec),
{name}_p AS (SELECT rec, idx, value FROM {source} UNION ALL SELECT rec, -k, head FROM {name}_e, range(1, {half + 1}) t(k) UNION ALL SELECT rec, last + k, tail FROM {name}_e, range(1, {half + 1}) t(k)),
{name} AS (SELECT * FROM (SELECT rec, idx, value, median(value) OVER (PARTITION BY rec ORDER BY idx ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING) AS med FROM {name}_p)
  WHERE idx >= 0 AND (rec, idx) IN (SELECT rec, idx FROM {source}))"""


@query(f"""{SPIKY}, {_rolling('g', 'm', 5)}, r AS (SELECT rec, idx, abs(value - med) AS value FROM m), {_rolling('r', 'l', 5)},
q AS (SELECT rec, median(abs(value - med)) AS scale, mad(value) AS spread FROM m GROUP BY rec)
SELECT rec, idx, round(m.value, 6) + 0.0 AS value, l.value > 3 * greatest(1.4826 * l.med, 1.4826 * scale, 0.02 * 1.4826 * spread, 1e-12) AS outlier FROM m JOIN l USING (rec, idx) JOIN q USING (rec)""")
def outliers_hampel(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(outliers.hampel(spiky(user_series(spark, folder))))


@query(f"""{SPIKY}, {_rolling('g', 'm', 2)}, d AS (
  SELECT rec, idx, value, med, value - lag(value) OVER w AS jump, abs(CASE WHEN lag(med) OVER w IS NULL THEN lead(med) OVER w - med WHEN lead(med) OVER w IS NULL THEN med - lag(med) OVER w ELSE (lead(med) OVER w - lag(med) OVER w) / 2 END) AS slope
  FROM m WINDOW w AS (PARTITION BY rec ORDER BY idx)),
x AS (SELECT *, max(slope) OVER (PARTITION BY rec ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS steep FROM d),
q AS (SELECT rec, mad(jump) AS noise, mad(value) AS spread FROM d GROUP BY rec)
SELECT rec, idx, {_r('value')}, abs(value - med) > 10 * greatest(1.4826 * noise / sqrt(2), 0.02 * 1.4826 * spread, coalesce(steep, 0), 1e-12) AS outlier FROM x JOIN q USING (rec)""")
def outliers_spike(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(outliers.spike(spiky(user_series(spark, folder))))


@query(f"""{SPIKY}, q AS (SELECT rec, avg(value) AS a, stddev_pop(value) AS b FROM g GROUP BY rec), o AS (SELECT rec, idx, value, abs(value - a) / (b + 1e-12) > 3 AS hit FROM g JOIN q USING (rec)),
k AS (SELECT rec, median(value) AS med FROM o WHERE NOT hit GROUP BY rec) SELECT rec, idx, round(CASE WHEN hit THEN med ELSE value END, 6) + 0.0 AS value FROM o JOIN k USING (rec)""")
def remove_outliers_median(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(outliers.remove_outliers(spiky(user_series(spark, folder)), "zscore", "median"))


@query(f"{USER}, {_rolling('s', 'm', 3)} SELECT rec, idx, round(value, 6) + 0.0 AS value, round(med, 6) + 0.0 AS med FROM m")
def rolling_median(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(outliers.rolling_median(user_series(spark, folder), 7))


@query(f"""{USER}, d AS (SELECT *, value - lag(value) OVER (PARTITION BY rec ORDER BY idx) AS d FROM s),
q AS (SELECT rec, count(*) AS n, avg(value) AS mean, median(value) AS median, stddev_samp(value) AS std, var_samp(value) AS variance,
  (sum(pow(value - m, 3)) / count(*)) / pow(var_pop(value), 1.5) AS skewness, (sum(pow(value - m, 4)) / count(*)) / pow(var_pop(value), 2) - 3 AS kurtosis, min(value) AS minimum, max(value) AS maximum,
  quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, sqrt(avg(value * value)) AS rms, mad(value) AS mad,
  20 * log10(sqrt(avg(value * value)) / (stddev_samp(d) / sqrt(2))) AS snr_db
  FROM d JOIN (SELECT rec, avg(value) AS m FROM s GROUP BY rec) USING (rec) GROUP BY rec)
SELECT rec, n, {_r('mean', 'median', 'std', 'variance', 'skewness', 'kurtosis', 'minimum', 'maximum', 'q25', 'q75', 'iqr', 'rms', 'mad', 'snr_db')} FROM q""")
def describe(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(statistics.describe(user_series(spark, folder)))


@query(f"""{USER}, d AS (SELECT s.*, value - m < 0 AS low, lag(value - m < 0) OVER (PARTITION BY rec ORDER BY idx) AS before FROM s JOIN (SELECT rec, avg(value) AS m FROM s GROUP BY rec) USING (rec))
SELECT rec, round(max(value) - min(value), 6) + 0.0 AS peak_to_peak, round(sum(value * value), 6) + 0.0 AS energy, round(sum((low <> before)::INT) / (count(*) - 1), 6) + 0.0 AS zero_crossing_rate FROM d GROUP BY rec""")
def simple_measures(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(statistics.simple_measures(user_series(spark, folder)))


@query("""m AS (SELECT event_type AS k, count(value)::DOUBLE AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1),
p AS (SELECT a.k AS group_a, b.k AS group_b, (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) AS t, pow(a.v / a.n + b.v / b.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)) AS dof,
  (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) AS cohen_d FROM m a JOIN m b ON a.k < b.k)
SELECT group_a, group_b, round(t, 6) + 0.0 AS t, round(dof, 4) AS dof, round(cohen_d, 6) + 0.0 AS cohen_d, CASE WHEN abs(cohen_d) < 0.2 THEN 'negligible' WHEN abs(cohen_d) < 0.5 THEN 'small' WHEN abs(cohen_d) < 0.8 THEN 'medium' ELSE 'large' END AS effect FROM p""")
def welch_ttest(spark: SparkSession, folder: str) -> DataFrame:
    t = statistics.welch_ttest(spark.read.parquet(f"{folder}/events.parquet"), "event_type")
    t = t.drop("p", "reject")
    return rounded(t.drop("dof")).join(t.select("group_a", "group_b", F.round("dof", 4).alias("dof")), ["group_a", "group_b"])


@query("""b AS (SELECT event_type AS g, value AS v FROM events WHERE event_type IN ('click', 'purchase') AND value IS NOT NULL),
r AS (SELECT g, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS r, count(*) OVER (PARTITION BY v) AS ties FROM b),
t AS (SELECT sum(CASE WHEN g = 'click' THEN r END) AS r1, sum((g = 'click')::INT)::DOUBLE AS n1, sum((g = 'purchase')::INT)::DOUBLE AS n2, sum(ties * ties - 1)::DOUBLE AS tie FROM r),
u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, n1 + n2 AS n FROM t)
SELECT round(u, 6) + 0.0 AS u, round(2 * u / (n1 * n2) - 1, 6) + 0.0 AS rank_biserial, round((abs(u - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12 * ((n + 1) - tie / (n * (n - 1)))), 6) + 0.0 AS z,
  CASE WHEN abs(2 * u / (n1 * n2) - 1) < 0.1 THEN 'negligible' WHEN abs(2 * u / (n1 * n2) - 1) < 0.3 THEN 'small' WHEN abs(2 * u / (n1 * n2) - 1) < 0.5 THEN 'medium' ELSE 'large' END AS effect FROM u""")
def mannwhitney(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(statistics.mannwhitney(spark.read.parquet(f"{folder}/events.parquet"), "event_type", "click", "purchase").drop("p", "reject"))


@query(f"""{USER}, q AS (SELECT rec, count(*) AS n, regr_slope(value, idx / 2.0) AS slope, regr_intercept(value, idx / 2.0) AS intercept, regr_r2(value, idx / 2.0) AS r2,
  sqrt((regr_syy(value, idx / 2.0) - pow(regr_sxy(value, idx / 2.0), 2) / regr_sxx(value, idx / 2.0)) / (count(*) - 2) / regr_sxx(value, idx / 2.0)) AS stderr FROM s GROUP BY rec)
SELECT rec, n, {_r('slope', 'intercept', 'r2', 'stderr')} FROM q""")
def linear_regression(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(statistics.linear_regression(user_series(spark, folder), 2.0).drop("p", "reject"))


@query(f"{USER}, q AS (SELECT rec, regr_slope(value, idx) AS b, regr_intercept(value, idx) AS a FROM s GROUP BY rec) SELECT rec, idx, round(value - a - b * idx, 6) + 0.0 AS value FROM s JOIN q USING (rec)")
def detrend_linear(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(statistics.detrend(user_series(spark, folder)))


PAIRS = f"{TYPES}, p AS (SELECT a.rec AS channel_a, b.rec AS channel_b, a.idx, a.value AS x, b.value AS y FROM c a JOIN c b ON a.idx = b.idx AND a.rec < b.rec WHERE a.value IS NOT NULL AND b.value IS NOT NULL)"


@query(f"{PAIRS} SELECT channel_a, channel_b, count(*) AS n, round(corr(x, y), 6) + 0.0 AS r FROM p GROUP BY 1, 2")
def correlate_pearson(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(statistics.correlate(hourly_by_type(spark, folder)).drop("p", "reject"))


@query(f"""{PAIRS}, k AS (SELECT channel_a, channel_b, rank() OVER (PARTITION BY channel_a, channel_b ORDER BY x) + (count(*) OVER (PARTITION BY channel_a, channel_b, x) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY channel_a, channel_b ORDER BY y) + (count(*) OVER (PARTITION BY channel_a, channel_b, y) - 1) / 2 AS ry FROM p)
SELECT channel_a, channel_b, count(*) AS n, round(corr(rx, ry), 6) + 0.0 AS r FROM k GROUP BY 1, 2""")
def correlate_spearman(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(statistics.correlate(hourly_by_type(spark, folder), "spearman").drop("p", "reject"))


@query(f"""{PAIRS}, d AS (SELECT a.channel_a, a.channel_b, sign(a.x - b.x) AS sx, sign(a.y - b.y) AS sy FROM p a JOIN p b ON a.channel_a = b.channel_a AND a.channel_b = b.channel_b AND a.idx < b.idx),
n AS (SELECT channel_a, channel_b, count(*) AS n FROM p GROUP BY 1, 2)
SELECT channel_a, channel_b, any_value(n) AS n, round(sum(sx * sy) / sqrt(sum(abs(sx))::DOUBLE * sum(abs(sy))), 6) + 0.0 AS r FROM d JOIN n USING (channel_a, channel_b) GROUP BY 1, 2""")
def correlate_kendall(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(statistics.correlate(hourly_by_type(spark, folder), "kendall").drop("p", "reject"))


#: Two-sided p of a t statistic and of a normal score, by Simpson's rule over 2000 steps from 0 to the statistic.
P_OF_T = """1 - 2 * (SELECT sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(1 + pow(abs({t}) * i / 2000, 2) / ({v}), -(({v}) + 1) / 2)) * abs({t}) / 6000
  FROM range(0, 2001) s(i)) * exp(lgamma((({v}) + 1) / 2) - lgamma(({v}) / 2)) / sqrt(({v}) * pi())"""
P_OF_Z = """1 - 2 * (SELECT sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(abs({z}) * i / 2000, 2) / 2)) * abs({z}) / 6000 FROM range(0, 2001) s(i)) / sqrt(2 * pi())"""


@query(f"""{USER}, q AS (SELECT rec, count(value) AS n, avg(value) AS m, stddev_samp(value) AS sd FROM s GROUP BY rec), t AS (SELECT rec, n, (m - 50) / sd * sqrt(n) AS t, n - 1 AS dof, (m - 50) / sd AS cohen_d FROM q WHERE n > 1 AND sd > 0),
p AS (SELECT *, {P_OF_T.format(t='t', v='dof::DOUBLE')} AS p FROM t)
SELECT rec, n, {_r('t')}, dof, {_r('cohen_d')}, CASE WHEN abs(cohen_d) < 0.2 THEN 'negligible' WHEN abs(cohen_d) < 0.5 THEN 'small' WHEN abs(cohen_d) < 0.8 THEN 'medium' ELSE 'large' END AS effect, {_r('p')}, p < 0.05 AS reject FROM p""")
def ttest_one_sample(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(statistics.one_sample_ttest(user_series(spark, folder), 50.0)).where("t IS NOT NULL")


@query(f"""m AS (SELECT event_type AS k, count(value)::DOUBLE AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1),
t AS (SELECT a.k AS group_a, b.k AS group_b, (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) AS t, pow(a.v / a.n + b.v / b.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)) AS dof FROM m a JOIN m b ON a.k < b.k),
p AS (SELECT *, {P_OF_T.format(t='t', v='dof')} AS p FROM t) SELECT group_a, group_b, {_r('t', 'p')}, p < 0.05 AS reject FROM p""")
def welch_ttest_p(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(statistics.welch_ttest(spark.read.parquet(f"{folder}/events.parquet"), "event_type").select("group_a", "group_b", "t", "p", "reject"))


@query(f"""b AS (SELECT event_type AS g, value AS v FROM events WHERE event_type IN ('click', 'purchase') AND value IS NOT NULL),
r AS (SELECT g, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS r, count(*) OVER (PARTITION BY v) AS ties FROM b),
t AS (SELECT sum(CASE WHEN g = 'click' THEN r END) AS r1, sum((g = 'click')::INT)::DOUBLE AS n1, sum((g = 'purchase')::INT)::DOUBLE AS n2, sum(ties * ties - 1)::DOUBLE AS tie FROM r),
u AS (SELECT r1 - n1 * (n1 + 1) / 2 AS u, n1, n2, n1 + n2 AS n, tie FROM t), z AS (SELECT u, (abs(u - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12 * ((n + 1) - tie / (n * (n - 1)))) AS z FROM u),
p AS (SELECT *, {P_OF_Z.format(z='z')} AS p FROM z) SELECT {_r('u', 'z', 'p')}, p < 0.05 AS reject FROM p""")
def mannwhitney_p(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(statistics.mannwhitney(spark.read.parquet(f"{folder}/events.parquet"), "event_type", "click", "purchase").select("u", "z", "p", "reject"))


@query(f"""{USER}, q AS (SELECT rec, count(*) AS n, regr_slope(value, idx / 2.0) AS slope,
  sqrt((regr_syy(value, idx / 2.0) - pow(regr_sxy(value, idx / 2.0), 2) / regr_sxx(value, idx / 2.0)) / (count(*) - 2) / regr_sxx(value, idx / 2.0)) AS stderr FROM s GROUP BY rec),
p AS (SELECT *, {P_OF_T.format(t='slope / stderr', v='(n - 2)::DOUBLE')} AS p FROM q WHERE n > 2) SELECT rec, n, {_r('slope', 'p')}, p < 0.05 AS reject FROM p""")
def linear_regression_p(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(statistics.linear_regression(user_series(spark, folder), 2.0).where("n > 2").select("rec", "n", "slope", "p", "reject"))


def _correlation_p(values: str) -> str:
    t = "r * sqrt((n - 2) / (1 - r * r))"
    return f"""{PAIRS}, k AS ({values}), rr AS (SELECT channel_a, channel_b, count(*) AS n, corr(x, y) AS r FROM k GROUP BY 1, 2),
pp AS (SELECT *, {P_OF_T.format(t=t, v='(n - 2)::DOUBLE')} AS p FROM rr) SELECT channel_a, channel_b, n, {_r('r', 'p')}, p < 0.05 AS reject FROM pp"""


@query(_correlation_p("SELECT * FROM p"))
def correlate_pearson_p(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(statistics.correlate(hourly_by_type(spark, folder)))


@query(_correlation_p("""SELECT channel_a, channel_b, rank() OVER (PARTITION BY channel_a, channel_b ORDER BY x) + (count(*) OVER (PARTITION BY channel_a, channel_b, x) - 1) / 2 AS x,
  rank() OVER (PARTITION BY channel_a, channel_b ORDER BY y) + (count(*) OVER (PARTITION BY channel_a, channel_b, y) - 1) / 2 AS y FROM p"""))
def correlate_spearman_p(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(statistics.correlate(hourly_by_type(spark, folder), "spearman"))


@query(f"""{PAIRS}, d AS (SELECT a.channel_a, a.channel_b, sign(a.x - b.x) AS sx, sign(a.y - b.y) AS sy FROM p a JOIN p b ON a.channel_a = b.channel_a AND a.channel_b = b.channel_b AND a.idx < b.idx),
kc AS (SELECT channel_a, channel_b, sum(sx * sy)::DOUBLE AS c, sum(abs(sx))::DOUBLE AS nx, sum(abs(sy))::DOUBLE AS ny FROM d GROUP BY 1, 2), n AS (SELECT channel_a, channel_b, count(*)::DOUBLE AS n FROM p GROUP BY 1, 2),
tx AS (SELECT channel_a, channel_b, sum(t * (t - 1) / 2) AS x2, sum(t * (t - 1) * (t - 2)) AS x3, sum(t * (t - 1) * (2 * t + 5)) AS x5 FROM (SELECT channel_a, channel_b, count(*)::DOUBLE AS t FROM p GROUP BY channel_a, channel_b, x) GROUP BY 1, 2),
ty AS (SELECT channel_a, channel_b, sum(t * (t - 1) / 2) AS y2, sum(t * (t - 1) * (t - 2)) AS y3, sum(t * (t - 1) * (2 * t + 5)) AS y5 FROM (SELECT channel_a, channel_b, count(*)::DOUBLE AS t FROM p GROUP BY channel_a, channel_b, y) GROUP BY 1, 2),
z AS (SELECT channel_a, channel_b, n::BIGINT AS n, c / sqrt(nx * ny) AS r, c / sqrt((n * (n - 1) * (2 * n + 5) - x5 - y5) / 18 + x2 * y2 / (n * (n - 1) / 2) + x3 * y3 / (9 * n * (n - 1) * (n - 2))) AS z
  FROM kc JOIN n USING (channel_a, channel_b) JOIN tx USING (channel_a, channel_b) JOIN ty USING (channel_a, channel_b)),
q AS (SELECT *, {P_OF_Z.format(z='z')} AS p FROM z) SELECT channel_a, channel_b, n, {_r('r', 'p')}, p < 0.05 AS reject FROM q""")
def correlate_kendall_p(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(statistics.correlate(hourly_by_type(spark, folder), "kendall"))


@query(f"""{USER}, m AS (SELECT rec, count(value) AS n, avg(value) AS m FROM s GROUP BY rec), e AS (SELECT rec, idx, value - m AS e, n, least(ceil(12 * pow(n / 100, 0.25)), n - 1)::BIGINT AS lags FROM s JOIN m USING (rec)),
c AS (SELECT rec, any_value(n) AS n, any_value(lags) AS lags, sum(y * y) AS eta FROM (SELECT *, sum(e) OVER (PARTITION BY rec ORDER BY idx ROWS UNBOUNDED PRECEDING) AS y FROM e) GROUP BY rec),
g AS (SELECT a.rec, sum(a.e * b.e * CASE WHEN a.idx = b.idx THEN 1 ELSE 2 * (1 - (a.idx - b.idx) / (a.lags + 1)) END) AS s FROM e a JOIN e b ON a.rec = b.rec AND a.idx - b.idx BETWEEN 0 AND a.lags GROUP BY a.rec),
k AS (SELECT rec, n, lags, CASE WHEN n >= 4 AND s > 0 THEN eta / n / s END AS kpss FROM c JOIN g USING (rec))
SELECT rec, n, lags, {_r('kpss')}, round(CASE WHEN kpss <= 0.347 THEN 0.1 WHEN kpss <= 0.463 THEN 0.1 - (kpss - 0.347) / 0.116 * 0.05 WHEN kpss <= 0.574 THEN 0.05 - (kpss - 0.463) / 0.111 * 0.025
  WHEN kpss <= 0.739 THEN 0.025 - (kpss - 0.574) / 0.165 * 0.015 WHEN kpss > 0.739 THEN 0.01 END, 6) + 0.0 AS p FROM k""")
def stationarity_kpss(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(statistics.stationarity_kpss(user_series(spark, folder)))


@query(f"""{USER}, m AS (SELECT rec, count(value)::DOUBLE AS n, (sum(pow(value - m, 3)) / count(*)) / pow(var_pop(value), 1.5) AS g, (sum(pow(value - m, 4)) / count(*)) / pow(var_pop(value), 2) AS b
  FROM s JOIN (SELECT rec, avg(value) AS m FROM s GROUP BY rec) USING (rec) GROUP BY rec HAVING count(value) >= 8),
a AS (SELECT *, g * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, -1 + sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) AS w,
  (b - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS sb FROM m),
c AS (SELECT *, asinh(y / sqrt(2 / (w - 1))) / sqrt(ln(sqrt(w))) AS z1, 6 + 8 / sb * (2 / sb + sqrt(1 + 4 / (sb * sb))) AS big FROM a),
d AS (SELECT rec, z1, (1 - 2 / (9 * big) - cbrt((1 - 2 / big) / (1 + x * sqrt(2 / (big - 4))))) / sqrt(2 / (9 * big)) AS z2 FROM c)
SELECT rec, round(z1 * z1 + z2 * z2, 6) + 0.0 AS k2, round(exp(-(z1 * z1 + z2 * z2) / 2), 6) + 0.0 AS p FROM d""")
def normality_dagostino(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(statistics.dagostino(user_series(spark, folder)).where("k2 IS NOT NULL"))


@query(f"""{VECTORS}, z AS (SELECT rec, idx, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS z, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY rec))
SELECT a.rec, (a.idx - b.idx)::INT AS lag, round(sum(a.z * b.z) / any_value(a.n), 6) + 0.0 AS r FROM z a JOIN z b ON a.rec = b.rec AND a.idx - b.idx BETWEEN 0 AND 16 GROUP BY 1, 2""")
def autocorrelation(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(statistics.autocorrelation(vectors(spark, folder), 16))


@query(f"""{VECTORS}, w AS (SELECT rec, idx, value * (0.5 - 0.5 * cos(2 * pi() * idx / n)) AS x, n FROM s JOIN (SELECT rec, count(*) AS n FROM s GROUP BY rec) USING (rec)),
z AS (SELECT rec, bin, any_value(n) AS n, sum(x * cos(2 * pi() * bin * idx / n)) AS re, sum(x * sin(2 * pi() * bin * idx / n)) AS im FROM w, range(0, 33) t(bin) GROUP BY 1, 2),
m AS (SELECT rec, bin, n, sqrt(re * re + im * im) / (n / 2) * CASE WHEN bin IN (0, 32) THEN 1 ELSE 2 END AS magnitude FROM z)
SELECT rec, bin::INT AS bin, round(bin / n, 6) + 0.0 AS freq, {_r('magnitude')}, round(magnitude * magnitude, 6) + 0.0 AS power FROM m""")
def fft(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(spectral.fft(vectors(spark, folder)).drop("phase"))


@query(f"""{VECTORS}, g AS (SELECT rec, w, idx - w * 16 AS pos, value FROM s, range(0, 3) t(w) WHERE idx BETWEEN w * 16 AND w * 16 + 31),
x AS (SELECT rec, w, pos, (value - avg(value) OVER (PARTITION BY rec, w)) * (0.5 - 0.5 * cos(2 * pi() * pos / 32)) AS x FROM g),
z AS (SELECT rec, w, bin, pow(sum(x * cos(2 * pi() * bin * pos / 32)), 2) + pow(sum(x * sin(2 * pi() * bin * pos / 32)), 2) AS p FROM x, range(0, 17) t(bin) GROUP BY 1, 2, 3)
SELECT rec, z.bin::INT AS bin, round(z.bin / 32, 6) + 0.0 AS freq, round(avg(p) / 12.0 * CASE WHEN z.bin IN (0, 16) THEN 1 ELSE 2 END, 6) + 0.0 AS psd FROM z GROUP BY rec, z.bin""")
def psd_welch(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(spectral.welch(vectors(spark, folder), 1.0, 32))


TIME = """d AS (SELECT *, value - lag(value) OVER k AS d1, value - 2 * lag(value) OVER k + lag(value, 2) OVER k AS d2, value - m < 0 AS low, lag(value - m < 0) OVER k AS before FROM x JOIN (SELECT {key}, avg(value) AS m FROM x GROUP BY ALL) USING ({key}) WINDOW k AS (PARTITION BY {key} ORDER BY idx)),
q AS (SELECT {key}, avg(value) AS td_mean, stddev_samp(value) AS td_std, var_samp(value) AS td_variance, coalesce((sum(pow(value - m, 3)) / count(*)) / nullif(pow(var_pop(value), 1.5), 0), 0) AS td_skewness,
  coalesce((sum(pow(value - m, 4)) / count(*)) / nullif(pow(var_pop(value), 2), 0) - 3, 0) AS td_kurtosis, sqrt(avg(value * value)) AS td_rms, max(value) - min(value) AS td_peak_to_peak,
  max(abs(value)) / sqrt(avg(value * value)) AS td_crest_factor, sum((low <> before)::INT) / (count(*) - 1) AS td_zero_crossing_rate, avg(abs(value)) AS td_mean_abs_value, sum(abs(d1)) AS td_waveform_length,
  var_pop(value) AS td_hjorth_activity, sqrt(var_pop(d1) / var_pop(value)) AS td_hjorth_mobility, sqrt(var_pop(d2) / var_pop(d1)) / sqrt(var_pop(d1) / var_pop(value)) AS td_hjorth_complexity FROM d GROUP BY {key})"""
TD = ["mean", "std", "variance", "skewness", "kurtosis", "rms", "peak_to_peak", "crest_factor", "zero_crossing_rate", "mean_abs_value", "waveform_length", "hjorth_activity", "hjorth_mobility", "hjorth_complexity"]


@query(f"{USER}, x AS (SELECT * FROM s), {TIME.format(key='rec')} SELECT rec, {_r(*(f'td_{t}' for t in TD))} FROM q")
def time_features(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(features.time_domain(user_series(spark, folder)))


@query(f"""{USER}, x AS (SELECT rec, w, idx, value FROM s JOIN (SELECT rec, count(*) AS n FROM s GROUP BY rec) USING (rec), LATERAL (SELECT unnest(range(0, n // 8 + 1)) AS w) WHERE idx BETWEEN w * 8 AND w * 8 + 15 AND w * 8 + 16 <= n),
{TIME.format(key='rec, w')} SELECT rec, w, round(w * 8 / 2, 6) + 0.0 AS t_start, round((w * 8 + 16) / 2, 6) + 0.0 AS t_end, {_r(*(f'td_{t}' for t in TD))} FROM q""")
def windowed_features(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(features.windowed_time_domain(user_series(spark, folder), 16, 8, 2.0))


@query(f"""{USER}, t AS (SELECT rec, value AS a, lead(value) OVER w AS b, lead(value, 2) OVER w AS c FROM s WINDOW w AS (PARTITION BY rec ORDER BY idx)),
n AS (SELECT rec, (a <= b)::INT * 4 + (a <= c)::INT * 2 + (b <= c)::INT AS k, count(*) AS n FROM t WHERE c IS NOT NULL GROUP BY 1, 2), p AS (SELECT rec, n / sum(n) OVER (PARTITION BY rec) AS p FROM n)
SELECT rec, round(-sum(p * ln(p)) / ln(6), 6) + 0.0 AS perm_entropy FROM p GROUP BY rec""")
def permutation_entropy(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(features.permutation_entropy(user_series(spark, folder)))


@query(f"""{USER}, c AS (SELECT rec, count(*) AS n FROM s GROUP BY rec), e AS (SELECT a.rec, k, a.idx % k AS m, n, abs(a.value - b.value) AS d FROM s a JOIN c USING (rec), range(1, 11) t(k), s b WHERE b.rec = a.rec AND b.idx = a.idx - k AND k <= n // 4),
l AS (SELECT rec, k, m, sum(d) * (any_value(n) - 1) / (((any_value(n) - m - 1) // k) * k) / k AS l FROM e GROUP BY 1, 2, 3), g AS (SELECT rec, ln(1 / k) AS x, ln(avg(l)) AS y FROM l GROUP BY rec, k HAVING avg(l) > 0)
SELECT rec, round(regr_slope(y, x), 6) + 0.0 AS higuchi_fd FROM g GROUP BY rec""")
def higuchi_fd(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(features.higuchi_fd(user_series(spark, folder)))


@query(f"""{USER}, c AS (SELECT rec, idx, count(*) OVER w AS n, value - avg(value) OVER w AS d FROM s WINDOW w AS (PARTITION BY rec)),
y AS (SELECT rec, idx, n, sum(d) OVER (PARTITION BY rec ORDER BY idx ROWS UNBOUNDED PRECEDING) AS y FROM c),
b AS (SELECT rec, scale, idx // scale AS seg, idx % scale AS x, y FROM y, (SELECT unnest([4, 6, 8, 12, 16]) AS scale) WHERE (idx // scale + 1) * scale <= n),
v AS (SELECT rec, scale, seg, greatest(regr_syy(y, x) - pow(regr_sxy(y, x), 2) / regr_sxx(y, x), 0) / scale AS r FROM b GROUP BY 1, 2, 3), f AS (SELECT rec, scale, sqrt(avg(r)) AS f FROM v GROUP BY 1, 2)
SELECT rec, round(regr_slope(ln(f), ln(scale)), 6) + 0.0 AS dfa_alpha FROM f WHERE f > 0 GROUP BY rec""")
def dfa_alpha_scales(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(features.dfa_alpha(user_series(spark, folder), [4, 6, 8, 12, 16]))


#: One user in ten has 20 samples, one has 38, and one has 42: none, two and three or more scales.
CUT = {3: 20, 7: 38, 9: 42}


@query(f"""{USER}, u AS {_beginnings('s', CUT)}, c AS (SELECT rec, idx, count(*) OVER w AS n, value - avg(value) OVER w AS d FROM u WINDOW w AS (PARTITION BY rec)),
n AS (SELECT rec, count(*) AS n, min(value) < max(value) AS varies FROM u GROUP BY rec),
k AS (SELECT DISTINCT rec, CASE i WHEN 0 THEN 8 WHEN 11 THEN n // 4 ELSE floor(exp(ln(8) + (ln(n // 4) - ln(8)) * i / 11) + 1e-9)::BIGINT END AS scale FROM n, range(0, 12) t(i) WHERE n >= 32 AND varies),
e AS (SELECT rec, count(*) AS m FROM k GROUP BY rec),
y AS (SELECT rec, idx, n, sum(d) OVER (PARTITION BY rec ORDER BY idx ROWS UNBOUNDED PRECEDING) AS y FROM c),
b AS (SELECT rec, scale, idx // scale AS seg, idx % scale AS x, y FROM y JOIN k USING (rec) WHERE (idx // scale + 1) * scale <= n),
v AS (SELECT rec, scale, seg, greatest(regr_syy(y, x) - pow(regr_sxy(y, x), 2) / regr_sxx(y, x), 0) / scale AS r FROM b GROUP BY 1, 2, 3), f AS (SELECT rec, scale, sqrt(avg(r)) AS f FROM v GROUP BY 1, 2),
a AS (SELECT rec, CASE WHEN min(f) > 0 THEN regr_slope(ln(f), ln(scale)) END AS alpha FROM f JOIN e USING (rec) WHERE m >= 3 GROUP BY rec)
SELECT rec, round(alpha, 6) + 0.0 AS dfa_alpha FROM n LEFT JOIN a USING (rec)""")
def dfa_alpha(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(features.dfa_alpha(with_beginnings(user_series(spark, folder), CUT)))


@query(f"""{USER}, c AS (SELECT rec, stddev_pop(value) * 0.2 AS r FROM s GROUP BY rec), t AS (SELECT rec, idx, value AS x0, lead(value) OVER w AS x1, lead(value, 2) OVER w AS x2 FROM s WINDOW w AS (PARTITION BY rec ORDER BY idx)),
h AS (SELECT a.rec, count(*) AS b, sum((abs(a.x2 - b.x2) <= r)::INT) AS a FROM t a JOIN t b ON a.rec = b.rec AND a.idx < b.idx JOIN c ON c.rec = a.rec WHERE a.x2 IS NOT NULL AND b.x2 IS NOT NULL AND abs(a.x0 - b.x0) <= r AND abs(a.x1 - b.x1) <= r GROUP BY 1)
SELECT c.rec, round(CASE WHEN a > 0 AND b > 0 THEN -ln(a / b) END, 6) + 0.0 AS sample_entropy FROM c LEFT JOIN h USING (rec)""")
def sample_entropy(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(features.sample_entropy(user_series(spark, folder)))


@query("""e AS (SELECT user_id AS rec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value, event_type AS label, event_id FROM events), n AS (SELECT rec, count(*) AS n FROM e GROUP BY rec),
c AS (SELECT e.rec, a.event_id AS event, a.label, e.idx - a.idx AS rel, e.value FROM e a JOIN n USING (rec) JOIN e ON e.rec = a.rec AND e.idx BETWEEN a.idx - 2 AND a.idx + 4 WHERE a.label = 'purchase' AND a.idx >= 2 AND a.idx + 4 < n),
k AS (SELECT rec, event, avg(CASE WHEN rel < 0 THEN value END) AS base FROM c GROUP BY 1, 2 HAVING max(value) - min(value) <= 300)
SELECT label, rel::INT AS rel, count(*) AS n, round(avg(value - base), 6) + 0.0 AS mean, round(median(value - base), 6) + 0.0 AS median, round(stddev_pop(value - base), 6) + 0.0 AS std FROM c JOIN k USING (rec, event) GROUP BY 1, 2""")
def epochs_average(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    rows = spark.read.parquet(f"{folder}/events.parquet")
    at = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    marks = rows.select(F.col("user_id").alias("rec"), F.col("event_id").alias("event"), F.col("event_type").alias("label"), at.alias("at")).where("label = 'purchase'")
    cut = epochs.epochs(user_series(spark, folder), marks, -2, 4, (-2, -1), 300.0)
    return rounded(epochs.average(cut, "label"))


@query(f"""{GAPPY}, r AS (SELECT rec, idx, idx - row_number() OVER (PARTITION BY rec ORDER BY idx) AS k FROM g WHERE value IS NULL) SELECT rec, min(idx) AS first, count(*) AS length FROM r GROUP BY rec, k""")
def missing_runs(spark: SparkSession, folder: str) -> DataFrame:
    return quality.missing_runs(gappy(user_series(spark, folder)))


FLAT = "CASE WHEN idx % 40 < 12 AND idx >= 40 THEN 77.0 WHEN value > 120 THEN 120.0 WHEN idx % 17 = 3 THEN NULL ELSE value END"


@query(f"""{USER}, g AS (SELECT rec, idx, {FLAT} AS value FROM s),
b AS (SELECT rec, max(idx) + 1 AS n, avg((value IS NULL)::INT) AS missing, count(DISTINCT value) AS d, avg(value) AS m, stddev_pop(value) AS sd, min(value) AS lo, max(value) AS hi, corr(value, idx) AS c FROM g GROUP BY rec),
e AS (SELECT rec, idx, value, value = lo OR value = hi AS edge FROM g JOIN b USING (rec) WHERE value IS NOT NULL),
r AS (SELECT rec, edge, value, idx - row_number() OVER (PARTITION BY rec, edge, value ORDER BY idx) AS k FROM e), l AS (SELECT rec, edge, value, k, count(*) AS len FROM r GROUP BY ALL),
f AS (SELECT b.*, coalesce((SELECT sum(len) FROM l WHERE l.rec = b.rec AND edge AND len >= 3), 0)::BIGINT AS clipped, coalesce((SELECT sum(len) FROM l WHERE l.rec = b.rec AND NOT edge AND len >= 10), 0)::BIGINT AS flat FROM b),
t AS (SELECT rec, idx, value, ntile(8) OVER (PARTITION BY rec ORDER BY idx) AS part FROM g JOIN b USING (rec) WHERE n >= 256),
v AS (SELECT rec, max(x) / min(CASE WHEN x > 0 THEN x END) AS spread FROM (SELECT rec, part, stddev_pop(value) AS x FROM t GROUP BY 1, 2) GROUP BY rec),
k AS (SELECT rec, n, missing, clipped, flat, spread, list_filter([CASE WHEN missing > 0.2 THEN 'missing:critical' WHEN missing > 0 THEN 'missing:warning' END, CASE WHEN n < 32 THEN 'short:warning' END,
  CASE WHEN coalesce(sd, 0) = 0 THEN 'constant:critical' END, CASE WHEN n >= 32 AND sd > 0 AND d <= 16 THEN 'digital:info' END,
  CASE WHEN n >= 32 AND d > 16 AND clipped > 0.05 * n THEN 'clipping:critical' WHEN n >= 32 AND d > 16 AND clipped >= greatest(3, 0.002 * n) THEN 'clipping:warning' END,
  CASE WHEN n >= 32 AND d > 16 AND flat > 0.2 * n THEN 'flatline:critical' WHEN n >= 32 AND d > 16 AND flat > 0.01 * n THEN 'flatline:warning' END,
  CASE WHEN n >= 32 AND abs(m) > sd THEN 'dc_offset:info' END, CASE WHEN n >= 32 AND spread > 5 THEN 'nonstationary:warning' END, CASE WHEN n >= 32 AND c * c > 0.3 THEN 'trend:warning' END], lambda x: x IS NOT NULL) AS found FROM f LEFT JOIN v USING (rec)),
z AS (SELECT *, greatest(0, 100 - list_sum(list_transform(found, lambda x: CASE WHEN x LIKE '%critical' THEN 35 WHEN x LIKE '%warning' THEN 12 ELSE 3 END) || [0]))::INT AS score FROM k)
SELECT rec, n, {_r('missing')}, clipped, flat, {_r('spread')}, array_to_string(found, ',') AS issues, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade,
  len(list_filter(found, lambda x: x NOT LIKE '%info')) = 0 AS ok FROM z""")
def screen(spark: SparkSession, folder: str) -> DataFrame:
    damaged = user_series(spark, folder).withColumn("value", F.expr(FLAT.replace("77.0", "77D").replace("120.0", "120D")))
    return rounded(quality.screen(damaged))


#: Series that are empty, constant, short, digital, spiked, clipped, flat in parts, or rising, by the user.
DAMAGE = """CASE WHEN rec % 10 = 4 THEN NULL WHEN rec % 10 = 6 THEN 42.0 WHEN rec % 10 = 7 THEN idx % 4 WHEN rec % 10 = 8 AND idx % 31 = 20 THEN 5000.0
  WHEN rec % 10 = 9 THEN value + 20 * idx WHEN rec % 2 = 1 AND idx >= 40 AND idx % 40 < 12 THEN 77.0 WHEN rec % 10 IN (1, 2, 3) THEN least(value, 90.0) WHEN idx % 17 = 3 THEN NULL ELSE value END"""


@query(f"""{USER}, u AS (SELECT rec, idx, {DAMAGE} AS value FROM {_beginnings('s', {5: 20})} t),
i AS (SELECT rec, max(idx) + 1 AS n, avg((value IS NULL)::INT) AS missing FROM u GROUP BY rec),
o AS (SELECT rec, idx, value, max(CASE WHEN value IS NOT NULL THEN idx END) OVER a AS i0, min(CASE WHEN value IS NOT NULL THEN idx END) OVER b AS i1
  FROM u WINDOW a AS (PARTITION BY rec ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY rec ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
x AS (SELECT o.rec, o.idx, CASE WHEN i0 IS NULL THEN q.value WHEN i1 IS NULL OR i0 = i1 THEN p.value ELSE p.value + (q.value - p.value) * ((o.idx - i0) / (i1 - i0)) END AS value
  FROM o LEFT JOIN u p ON p.rec = o.rec AND p.idx = i0 LEFT JOIN u q ON q.rec = o.rec AND q.idx = i1),
b AS (SELECT rec, min(value) AS lo, max(value) AS hi, count(DISTINCT value) AS d FROM x GROUP BY rec),
g AS (SELECT rec, idx, value FROM x JOIN b USING (rec) JOIN i USING (rec) WHERE n >= 32 AND lo < hi),
r AS (SELECT rec, idx, value, idx - row_number() OVER (PARTITION BY rec, value ORDER BY idx) AS k FROM g), l AS (SELECT rec, idx, value, count(*) OVER (PARTITION BY rec, value, k) AS len, count(*) OVER (PARTITION BY rec, value) AS often FROM r),
c AS (SELECT rec, idx, d > 16 AND len >= 3 AND value IN (lo, hi) AND often >= greatest(3, 0.002 * n) AS clip, d > 16 AND len >= 10 AS long FROM l JOIN b USING (rec) JOIN i USING (rec)),
{_rolling('g', 'm', 2)}, dd AS (
  SELECT rec, idx, value, med, value - lag(value) OVER w AS jump, abs(CASE WHEN lag(med) OVER w IS NULL THEN lead(med) OVER w - med WHEN lead(med) OVER w IS NULL THEN med - lag(med) OVER w ELSE (lead(med) OVER w - lag(med) OVER w) / 2 END) AS slope
  FROM m WINDOW w AS (PARTITION BY rec ORDER BY idx)),
st AS (SELECT *, max(slope) OVER (PARTITION BY rec ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS steep FROM dd),
ns AS (SELECT rec, mad(jump) AS noise, mad(value) AS wide FROM dd GROUP BY rec),
h AS (SELECT rec, idx, value, clip, long AND NOT clip AS flat, NOT clip AND abs(value - med) > 10 * greatest(1.4826 * noise / sqrt(2), 0.02 * 1.4826 * wide, steep, 1e-12) AS spike FROM st JOIN ns USING (rec) JOIN c USING (rec, idx)),
e AS (SELECT rec, idx, value, spike, max(CASE WHEN NOT spike THEN idx END) OVER a AS i0, min(CASE WHEN NOT spike THEN idx END) OVER b AS i1
  FROM h WINDOW a AS (PARTITION BY rec ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY rec ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
y AS (SELECT e.rec, e.idx, CASE WHEN i0 IS NULL THEN q.value WHEN i1 IS NULL OR i0 = i1 THEN p.value ELSE p.value + (q.value - p.value) * ((e.idx - i0) / (i1 - i0)) END AS value
  FROM e LEFT JOIN h p ON p.rec = e.rec AND p.idx = i0 LEFT JOIN h q ON q.rec = e.rec AND q.idx = i1),
z AS (SELECT rec, avg(value) AS m, stddev_pop(value) AS sd, corr(value, idx) AS co FROM y GROUP BY rec),
t AS (SELECT rec, value, ntile(8) OVER (PARTITION BY rec ORDER BY idx) AS part FROM y JOIN i USING (rec) WHERE n >= 256),
v AS (SELECT rec, max(x) / (min(x) + 1e-300) AS spread FROM (SELECT rec, part, CASE WHEN min(value) = max(value) THEN 0 ELSE stddev_pop(value) END AS x FROM t GROUP BY 1, 2) GROUP BY rec),
hc AS (SELECT rec, sum(clip::INT)::BIGINT AS clipped, sum(flat::INT)::BIGINT AS flat, sum(spike::INT)::BIGINT AS spikes FROM h GROUP BY rec),
k AS (SELECT rec, n, missing, clipped, flat, spikes, spread, list_filter([CASE WHEN lo IS NULL THEN 'empty:critical' END, CASE WHEN lo IS NULL THEN NULL WHEN missing > 0.2 THEN 'missing:critical' WHEN missing > 0 THEN 'missing:warning' END,
  CASE WHEN lo IS NOT NULL AND n < 32 THEN 'short:critical' END, CASE WHEN n >= 32 AND lo = hi THEN 'constant:critical' END, CASE WHEN clipped IS NOT NULL AND d <= 16 THEN 'digital:info' END,
  CASE WHEN clipped > 0.05 * n THEN 'clipping:critical' WHEN clipped > 0 THEN 'clipping:warning' END, CASE WHEN flat > 0.2 * n THEN 'flatline:critical' WHEN flat > 0.01 * n THEN 'flatline:warning' END, CASE WHEN spikes > 0 THEN 'spikes:warning' END,
  CASE WHEN abs(m) > sd THEN 'dc_offset:info' END, CASE WHEN co * co > 0.3 THEN 'trend:warning' END, CASE WHEN spread > 5 THEN 'nonstationary:info' END], lambda x: x IS NOT NULL) AS found FROM i JOIN b USING (rec) LEFT JOIN hc USING (rec) LEFT JOIN z USING (rec) LEFT JOIN v USING (rec)),
w AS (SELECT *, greatest(0, 100 - list_sum(list_transform(found, lambda x: CASE WHEN x LIKE '%critical' THEN 35 WHEN x LIKE '%warning' THEN 12 ELSE 3 END) || [0]))::INT AS score FROM k)
SELECT rec, n, {_r('missing')}, clipped, flat, spikes, {_r('spread')}, array_to_string(found, ',') AS issues, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade,
  len(list_filter(found, lambda x: x NOT LIKE '%info')) = 0 AS ok FROM w""")
def diagnose(spark: SparkSession, folder: str) -> DataFrame:
    damage = DAMAGE
    for number in ("42.0", "5000.0", "77.0", "90.0"):
        damage = damage.replace(number, f"{number}D")
    damaged = with_beginnings(user_series(spark, folder), {5: 20}).withColumn("value", F.expr(damage))
    return rounded(quality.diagnose(damaged))


@query(f"""{USER}, g AS (SELECT rec, idx, 200 + 5 * value AS value FROM s), b AS (SELECT rec, count(*) AS raw FROM g GROUP BY rec),
k AS (SELECT rec, idx, value, value - lag(value) OVER (PARTITION BY rec ORDER BY idx) AS d FROM g WHERE value BETWEEN 250 AND 2500),
t AS (SELECT rec, sum(c) / max(c) AS tri FROM (SELECT rec, floor((value - lo) / 7.8125) AS bin, count(*) AS c FROM k JOIN (SELECT rec, min(value) AS lo FROM k GROUP BY rec) USING (rec) GROUP BY 1, 2) GROUP BY rec),
a AS (SELECT rec, any_value(raw) + 1 AS hrv_beats, count(*) AS used, any_value(raw) AS raw, avg(value) AS hrv_mean_rr, stddev_samp(value) AS hrv_sdnn, sqrt(avg(d * d)) AS hrv_rmssd, 100 * avg((abs(d) > 50)::INT) AS hrv_pnn50, avg(60000 / value) AS hrv_mean_hr,
  stddev_samp(60000 / value) AS hrv_sd_hr, max(value) - min(value) AS hrv_range, sqrt(var_samp(d) / 2) AS hrv_sd1, sqrt(greatest(2 * var_samp(value) - var_samp(d) / 2, 0)) AS hrv_sd2, any_value(tri) AS hrv_tri_index FROM k JOIN b USING (rec) JOIN t USING (rec) GROUP BY rec),
z AS (SELECT *, hrv_sd1 / hrv_sd2 AS hrv_sd_ratio, 100 * (raw - used) / raw AS hrv_artifact_pct FROM a)
SELECT rec, hrv_beats, {_r('hrv_mean_rr', 'hrv_sdnn', 'hrv_rmssd', 'hrv_pnn50', 'hrv_mean_hr', 'hrv_sd_hr', 'hrv_range', 'hrv_sd1', 'hrv_sd2', 'hrv_tri_index', 'hrv_sd_ratio', 'hrv_artifact_pct')} FROM z""")
def hrv_time_plain(spark: SparkSession, folder: str) -> DataFrame:
    rr = user_series(spark, folder).withColumn("value", 200 + 5 * F.col("value"))
    return rounded(features.hrv_time(rr, rel=None))


#: Intervals with missed and extra beats; one user in ten has 8 of them, and one has 4.
BEATS = "CASE WHEN idx % 23 = 11 THEN 1700.0 WHEN idx % 23 IN (3, 17) THEN 314.0 WHEN idx = 0 AND rec % 4 = 1 THEN 536.0 ELSE 800 + value / 5 END"
FEW = {3: 8, 4: 4}


@query(f"""{USER}, g AS (SELECT rec, idx, {BEATS} AS value FROM {_beginnings('s', FEW)} t), b AS (SELECT rec, count(*) AS raw FROM g GROUP BY rec),
p AS (SELECT rec, idx, value FROM g UNION ALL SELECT rec, -idx, value FROM g WHERE idx BETWEEN 1 AND 5 UNION ALL SELECT rec, 2 * (raw - 1) - idx, value FROM g JOIN b USING (rec) WHERE idx BETWEEN raw - 6 AND raw - 2),
l AS (SELECT g.rec, g.idx, median(p.value) AS local FROM g JOIN b USING (rec) JOIN p ON p.rec = g.rec AND abs(p.idx - g.idx) <= least(5, (raw - 1) // 2) WHERE raw >= 5 GROUP BY 1, 2),
k AS (SELECT rec, idx, value, value - lag(value) OVER (PARTITION BY rec ORDER BY idx) AS d FROM g LEFT JOIN l USING (rec, idx) WHERE value BETWEEN 250 AND 2500 AND (local IS NULL OR abs(value - local) <= 0.3 * local)),
t AS (SELECT rec, sum(c) / max(c) AS tri FROM (SELECT rec, floor((value - lo) / 7.8125) AS bin, count(*) AS c FROM k JOIN (SELECT rec, min(value) AS lo FROM k GROUP BY rec) USING (rec) GROUP BY 1, 2) GROUP BY rec),
a AS (SELECT rec, any_value(raw) + 1 AS hrv_beats, count(*) AS used, any_value(raw) AS raw, avg(value) AS hrv_mean_rr, stddev_samp(value) AS hrv_sdnn, sqrt(avg(d * d)) AS hrv_rmssd, 100 * avg((abs(d) > 50)::INT) AS hrv_pnn50, avg(60000 / value) AS hrv_mean_hr,
  stddev_samp(60000 / value) AS hrv_sd_hr, max(value) - min(value) AS hrv_range, sqrt(var_samp(d) / 2) AS hrv_sd1, sqrt(greatest(2 * var_samp(value) - var_samp(d) / 2, 0)) AS hrv_sd2, any_value(tri) AS hrv_tri_index FROM k JOIN b USING (rec) JOIN t USING (rec) GROUP BY rec),
z AS (SELECT *, hrv_sd1 / hrv_sd2 AS hrv_sd_ratio, 100 * (raw - used) / raw AS hrv_artifact_pct FROM a)
SELECT rec, hrv_beats, {_r('hrv_mean_rr', 'hrv_sdnn', 'hrv_rmssd', 'hrv_pnn50', 'hrv_mean_hr', 'hrv_sd_hr', 'hrv_range', 'hrv_sd1', 'hrv_sd2', 'hrv_tri_index', 'hrv_sd_ratio', 'hrv_artifact_pct')} FROM z""")
def hrv_time(spark: SparkSession, folder: str) -> DataFrame:
    beats = BEATS
    for number in ("1700.0", "314.0", "536.0"):
        beats = beats.replace(number, f"{number}D")
    return rounded(features.hrv_time(with_beginnings(user_series(spark, folder), FEW).withColumn("value", F.expr(beats))))


@query(f"""{TYPES}, n AS (SELECT rec, idx, value, last_value(CASE WHEN value IS NOT NULL THEN idx END IGNORE NULLS) OVER a AS i0, last_value(value IGNORE NULLS) OVER a AS v0, first_value(CASE WHEN value IS NOT NULL THEN idx END IGNORE NULLS) OVER b AS i1, first_value(value IGNORE NULLS) OVER b AS v1
  FROM c WINDOW a AS (PARTITION BY rec ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY rec ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT rec, idx, CASE WHEN value IS NOT NULL THEN value WHEN i0 IS NULL THEN v1 WHEN i1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (idx - i0) / (i1 - i0) END AS value FROM n),
y AS (SELECT rec, idx, (value - avg(value) OVER (PARTITION BY rec)) / stddev_pop(value) OVER (PARTITION BY rec) AS value FROM f),
x AS (SELECT rec, idx // 24 AS w, idx, value FROM y WHERE (idx // 24 + 1) * 24 <= (SELECT h1 - h0 + 1 FROM h)),
{TIME.format(key='rec, w')} SELECT rec, w, round(w * 24.0, 6) + 0.0 AS t_start, round(w * 24.0 + 24, 6) + 0.0 AS t_end, {_r(*(f'td_{t}' for t in TD))} FROM q""")
def daily_profile(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: repair, standardise and describe each day of hourly signals."""
    repaired = cleaning.fill(hourly_by_type(spark, folder), "interpolate")
    return rounded(features.windowed_time_domain(normalize.standardize(repaired), 24))
