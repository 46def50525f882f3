"""Descriptive and inferential statistics.

Recordings and groups too short or too even for a figure have null in its place; nothing here fails on them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undula.core import CHUNK, chunked, dealt, long_recordings, numbered, ordered_means, quantiles, shifted, stored
from undula.functions.special import dickey_fuller, lag_rows, normal_share, p_of_dickey_fuller, p_of_ks, p_of_rank_sum, p_of_t, p_of_z, shapiro_wilk

#: Verbal cuts for Cohen's d and for correlations.
D_CUTS, R_CUTS = (0.2, 0.5, 0.8), (0.1, 0.3, 0.5)


def describe(samples: DataFrame) -> DataFrame:
    """One row a recording: n, mean, median, std and variance (ddof 1), population skewness and excess kurtosis, extremes,
    quartiles, rms, mad, and snr in dB against the noise between neighbours; the last is null for noise 0."""
    s = shifted(samples, prev=-1).where("value IS NOT NULL")
    d = F.col("value") - F.col("prev")
    long = long_recordings(samples)
    quartiles = [0.25, 0.5, 0.75]
    within = [] if long is not None else [F.percentile("value", F.array(*map(F.lit, quartiles))).alias("q")]
    stats = s.groupBy("rec").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.var_samp("value").alias("variance"), *within,
        F.skewness("value").alias("skewness"), F.kurtosis("value").alias("kurtosis"), F.min("value").alias("minimum"), F.max("value").alias("maximum"),
        F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), F.stddev_samp(d).alias("dstd"),
    )
    if long is not None:
        stats = stats.join(quantiles(samples.where("value IS NOT NULL"), "value", quartiles, long), "rec")
    away = samples.join(stats.select("rec", F.col("q")[1].alias("mid")), "rec").select("rec", F.abs(F.col("value") - F.col("mid")).alias("away"))
    mads = quantiles(away.where("away IS NOT NULL"), "away", [0.5], long, "mad").withColumn("mad", F.col("mad")[0])
    noise = F.col("dstd") / math.sqrt(2)
    return stats.join(mads, "rec").select(
        "rec", "n", "mean", F.col("q")[1].alias("median"), "std", "variance", "skewness", "kurtosis", "minimum", "maximum",
        F.col("q")[0].alias("q25"), F.col("q")[2].alias("q75"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"), "rms", "mad",
        F.when(noise > 0, 20 * F.log10(F.col("rms") / noise)).alias("snr_db"),
    )


def simple_measures(samples: DataFrame) -> DataFrame:
    """peak_to_peak, energy and zero_crossing_rate of each recording (a value equal to the mean counts as above)."""
    s = shifted(samples, prev=-1).join(ordered_means(samples, ["rec"]), "rec")
    cross = ((F.col("value") - F.col("mean") < 0) != (F.col("prev") - F.col("mean") < 0)).cast("int")
    return s.groupBy("rec").agg(
        (F.max("value") - F.min("value")).alias("peak_to_peak"), F.sum(F.col("value") * F.col("value")).alias("energy"), F.try_divide(F.sum(cross), F.count("value") - 1).alias("zero_crossing_rate")
    )


def dagostino(samples: DataFrame) -> DataFrame:
    """The K² test of normality from sample skewness and kurtosis; p from the chi-square law with two degrees of freedom. Below
    eight values, and for constant ones, both are null."""
    every = samples.select("rec").distinct()
    m = samples.where("value IS NOT NULL").groupBy("rec").agg(F.count("*").cast("double").alias("n"), F.skewness("value").alias("g1"), (F.kurtosis("value") + 3).alias("b2"))
    m = m.where("n >= 8 AND g1 IS NOT NULL AND b2 IS NOT NULL")
    n, g1, b2 = F.col("n"), F.col("g1"), F.col("b2")
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    m = m.withColumns({"y": y, "w2": -1 + F.sqrt(2 * (beta2 - 1))})
    w2 = F.col("w2")
    a = F.sqrt(2 / (w2 - 1))
    z1 = 1 / F.sqrt(F.log(F.sqrt(w2))) * F.log(F.col("y") / a + F.sqrt((F.col("y") / a) * (F.col("y") / a) + 1))
    e = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (b2 - e) / F.sqrt(var)
    sb = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    big = 6 + 8 / sb * (2 / sb + F.sqrt(1 + 4 / (sb * sb)))
    t = (1 - 2 / big) / (1 + x * F.sqrt(2 / (big - 4)))
    z2 = (1 - 2 / (9 * big) - F.signum(t) * F.pow(F.abs(t), F.lit(1.0 / 3))) / F.sqrt(2 / (9 * big))
    found = m.withColumns({"z1": z1, "z2": z2}).select("rec", (F.col("z1") * F.col("z1") + F.col("z2") * F.col("z2")).alias("k2")).withColumn("p", F.exp(-F.col("k2") / 2))
    return every.join(found, "rec", "left")


def ks_normal(samples: DataFrame) -> DataFrame:
    """rec, n, d and p of the Kolmogorov-Smirnov test against the normal law with the recording's own mean and deviation (ddof
    1); null below two values. The p is that of a law known beforehand."""
    s = samples.where("value IS NOT NULL").groupBy("rec", "value").agg(F.count("*").alias("ties"))
    stats = samples.groupBy("rec").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    s = ranked_counts(s, ["rec"], "value").join(stats.where("n >= 2"), "rec")
    s = s.withColumn("law", normal_share((F.col("value") - F.col("mean")) / (F.col("std") + 1e-12)))
    below, above = F.col("law") - F.col("before") / F.col("n"), (F.col("before") + F.col("ties")) / F.col("n") - F.col("law")
    d = s.groupBy("rec").agg(F.max(F.greatest(below, above)).alias("d"))
    return stats.select("rec", "n").join(d, "rec", "left").withColumn("p", p_of_ks(F.col("d"), F.col("n")))


def stationarity_kpss(samples: DataFrame, lags: int | None = None) -> DataFrame:
    """rec, n, lags, kpss and p of the test whose hypothesis is a steady level.

    Sums of deviations from the mean are squared and held against the long-run variance of Newey and West with Bartlett
    weights over `lags` (by default 12 (n / 100) ** 0.25, rounded up, and below n). p is read off the published table at 10, 5,
    2.5 and 1 % and held within it. Below four values and for constant ones it is null.
    """
    from undula.operators.features import summed_up

    m = samples.groupBy("rec").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
    wanted = F.lit(lags) if lags is not None else F.ceil(12 * F.pow(F.col("n") / 100, F.lit(0.25)))
    m = m.withColumn("lags", F.least(wanted, F.col("n") - 1).cast("long"))
    e = stored(samples.where("value IS NOT NULL").join(m, "rec").select("rec", "idx", (F.col("value") - F.col("mean")).alias("value")))
    eta = summed_up(e, "value").groupBy("rec").agg(F.sum(F.col("value") * F.col("value")).alias("eta"))
    most = m.where("n >= 4").agg(F.max("lags")).first()[0] or 0
    products = lag_products(e, e, 0, most).withColumnRenamed("sum", "g")
    weight = F.when(F.col("lag") == 0, 1.0).otherwise(2 * (1 - F.col("lag") / (F.col("lags") + 1.0)))
    long_run = products.join(m, "rec").where(F.col("lag") <= F.col("lags")).groupBy("rec").agg(F.sum(weight * F.col("g")).alias("s"))
    found = m.select("rec", "n", "lags").join(eta, "rec", "left").join(long_run, "rec", "left")
    n = F.col("n").cast("double")
    value = F.when((F.col("n") >= 4) & (F.col("s") > 0), F.try_divide(F.col("eta") / (n * n), F.col("s") / n))
    table = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))  # fixed values of the published table
    k, p = F.col("kpss"), F.when(F.col("kpss") <= table[0][0], table[0][1])
    for (a, pa), (b, pb) in zip(table, table[1:], strict=False):
        p = p.when(k <= b, pa + (k - a) * ((pb - pa) / (b - a)))
    return found.withColumn("kpss", value).select("rec", "n", "lags", "kpss", F.when(k.isNotNull(), p.otherwise(table[-1][1])).alias("p"))


def stationarity_adf(samples: DataFrame, lags: int | None = None) -> DataFrame:
    """rec, n, lags, adf, p and the decision `stationary` (p below 5 %) of the augmented Dickey-Fuller test with a constant.

    The lagged differences are those, up to `lags` (by default 12 (n / 100) ** 0.25, rounded up, and below half the length),
    whose regression has the least AIC on the rows that all share. Each chunk, with the values before it that its first rows
    look back to, gives one matrix of products; these are summed up over the recording, and all regressions solved from the
    sum, see dickey_fuller(). p is MacKinnon's. Gaps are left out beforehand. Null where there are too few values or they are constant.
    """
    from undula.operators.cleaning import renumbered

    kind = samples.schema["rec"].dataType.simpleString()
    every = samples.groupBy("rec").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), (F.min("value") < F.max("value")).alias("varies"))
    wanted = F.lit(lags) if lags is not None else F.ceil(12 * F.pow(F.col("n") / 100, F.lit(0.25)))
    every = stored(every.withColumn("most", F.least(wanted, F.floor(F.col("n") / 2) - 2).cast("int")))
    use = every.where("varies AND most >= 0")
    reach = (use.agg(F.max("most")).first()[0] or 0) + 1
    x = stored(renumbered(samples.where("value IS NOT NULL")).join(use.select("rec", "most", "mean"), "rec").select("rec", "idx", "most", (F.col("value") - F.col("mean")).alias("value")))
    pairs = F.array_sort(F.collect_list(F.struct("idx", "value")))
    rows = chunked(x, reach, 0, CHUNK).groupBy("rec", "most", "chunk").agg(F.max("owned").alias("any"), pairs.alias("p")).where("any")
    rows = rows.select("rec", "most", "chunk", F.col("p")[0]["idx"].alias("first"), F.transform("p", lambda p: p["value"]).alias("values"))
    size = CHUNK

    def products(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                # A row belongs to the chunk of the value that its difference leads to, and needs most + 1 values before it.
                start = max(r.chunk * size - r.most - 1 - r.first, 0)
                made = lag_rows(np.asarray(r.values, float)[start:], r.most)
                out.append((r.rec, r.most, len(made), (made.T @ made).reshape(-1).tolist()))
            yield pd.DataFrame(out, columns=["rec", "most", "used", "gram"])

    grams = stored(rows.mapInPandas(products, f"rec {kind}, most int, used long, gram array<double>"))
    used = grams.groupBy("rec", "most").agg(F.sum("used").alias("used"))
    cells = grams.select("rec", F.posexplode("gram").alias("at", "g")).groupBy("rec", "at").agg(F.sum("g").alias("g"))
    whole = cells.groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("at", "g"))).alias("cells")).select("rec", F.transform("cells", lambda c: c["g"]).alias("gram"))
    heads = x.where(F.col("idx") <= F.col("most")).groupBy("rec").agg(pairs.alias("p")).select("rec", F.transform("p", lambda p: p["value"]).alias("head"))

    def solved(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                size = r.most + 3
                found = dickey_fuller(np.asarray(r.gram, float).reshape(size, size), np.asarray(r.head, float), int(r.used)) if len(r.gram) == size * size else None
                out.append((r.rec, *(found[:2] if found else (None, None)), p_of_dickey_fuller(found[1]) if found else None))
            yield pd.DataFrame(out, columns=["rec", "lags", "adf", "p"]).astype({"lags": "Int64", "adf": "Float64", "p": "Float64"})

    found = whole.join(used, "rec").join(heads, "rec").mapInPandas(solved, f"rec {kind}, lags long, adf double, p double")
    return every.select("rec", "n").join(found, "rec", "left").withColumn("stationary", F.col("p") < 0.05)


#: Values that the Shapiro-Wilk test sees at most.
SHAPIRO_MOST = 5000


def shapiro(samples: DataFrame) -> DataFrame:
    """rec, n, used, w and p of the Shapiro-Wilk test of normality; null below three values and for constant ones.

    Of more than SHAPIRO_MOST values, so many with the least hashes of their index are used: the sample depends on the index
    alone, and what meets in a task is bounded.
    """
    kind, most = samples.schema["rec"].dataType.simpleString(), SHAPIRO_MOST
    n = samples.groupBy("rec").agg(F.count("value").alias("n"))
    draw = F.pmod(F.xxhash64("idx"), F.lit(1 << 30)) / float(1 << 30)
    # Ten deviations more than are wanted, of which the least are kept.
    some = samples.where("value IS NOT NULL").join(n, "rec").withColumn("draw", draw).where(F.col("draw") * F.col("n") < most + 10 * math.sqrt(most))
    drawn = some.groupBy("rec").agg(F.slice(F.array_sort(F.collect_list(F.struct("draw", "idx", "value"))), 1, most).alias("x"))
    drawn = drawn.select("rec", F.array_sort(F.transform("x", lambda v: v["value"])).alias("x"))

    def tested(batches):
        for batch in batches:
            found = [shapiro_wilk(np.asarray(x, float)) or (None, None) for x in batch["x"]]
            out = pd.DataFrame({"rec": batch["rec"], "used": [len(x) for x in batch["x"]], "w": [f[0] for f in found], "p": [f[1] for f in found]})
            yield out.astype({"w": "Float64", "p": "Float64"})

    return n.join(drawn.mapInPandas(tested, f"rec {kind}, used long, w double, p double"), "rec", "left").select("rec", "n", "used", "w", "p")


def moments_by(df: DataFrame, group: str, value: str = "value") -> DataFrame:
    return df.groupBy(group).agg(F.count(value).cast("double").alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))


#: Shares that the groups of a test are dealt to.
SIDES = 8


def _pairs(stats: DataFrame, key: str) -> DataFrame:
    """Every two rows of a table of one row a group, the smaller key first. The rows are dealt to SIDES shares, and each two
    shares meet under a key of their own, so that no task has to hold them all."""
    share = F.pmod(F.xxhash64(key), F.lit(SIDES)).cast("int")
    items = stats.where(F.col(key).isNotNull()).select(F.struct(F.col(key).alias("key"), *[c for c in stats.columns if c != key]).alias("s"), share.alias("share"))
    every = F.explode(F.sequence(F.lit(0), F.lit(SIDES - 1)))
    a = items.select(F.col("s").alias("a"), F.col("share").alias("i"), every.alias("j"))
    b = items.select(F.col("s").alias("b"), every.alias("i"), F.col("share").alias("j"))
    return a.join(b, ["i", "j"]).where(F.col("a.key") < F.col("b.key")).select("a", "b")


def welch_ttest(df: DataFrame, group: str, value: str = "value") -> DataFrame:
    """Welch's t, its degrees of freedom, p and Cohen's d (pooled) for every two groups; statistics from one pass of moments.

    Groups of one value and pairs of constant groups have null figures; a null group is none.
    """
    p = _pairs(moments_by(df, group, value), group)
    n1, m1, v1 = (F.col(f"a.{c}") for c in ("n", "mean", "var"))
    n2, m2, v2 = (F.col(f"b.{c}") for c in ("n", "mean", "var"))
    se2 = v1 / n1 + v2 / n2
    dof = F.try_divide(se2 * se2, F.try_divide(v1 * v1, n1 * n1 * (n1 - 1)) + F.try_divide(v2 * v2, n2 * n2 * (n2 - 1)))
    pooled = F.sqrt(F.try_divide((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2))
    d = F.try_divide(m1 - m2, pooled)
    p = p.where((n1 > 0) & (n2 > 0))
    out = p.select(F.col("a.key").alias("group_a"), F.col("b.key").alias("group_b"), F.try_divide(m1 - m2, F.sqrt(se2)).alias("t"), dof.alias("dof"), d.alias("cohen_d"), _label(d, D_CUTS).alias("effect"))
    return _decided(out, p_of_t(F.col("t"), F.col("dof")))


def _decided(tests: DataFrame, p: Column, alpha: float = 0.05) -> DataFrame:
    """Adds p and whether it rejects the hypothesis."""
    return tests.withColumn("p", p).withColumn("reject", F.col("p") < alpha)


def one_sample_ttest(samples: DataFrame, mean: float = 0.0) -> DataFrame:
    """rec, n, t, dof, Cohen's d, its label, p and reject for each recording's mean against `mean`; null figures below two
    values and for constant ones."""
    m = samples.groupBy("rec").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.stddev_samp("value").alias("std"))
    d = F.try_divide(F.col("m") - mean, F.col("std"))
    out = m.select("rec", "n", (d * F.sqrt("n")).alias("t"), (F.col("n") - 1).alias("dof"), d.alias("cohen_d"), _label(d, D_CUTS).alias("effect"))
    return _decided(out, p_of_t(F.col("t"), F.col("dof")))


def _label(x: Column, cuts: tuple[float, float, float]) -> Column:
    names = ("negligible", "small", "medium", "large")
    out = F.when(x.isNull(), None).when(F.abs(x) < cuts[0], names[0])
    for c, name in zip(cuts[1:], names[1:], strict=False):
        out = out.when(F.abs(x) < c, name)
    return out.otherwise(names[3])


def paired_ttest(a: DataFrame, b: DataFrame) -> DataFrame:
    """t of the differences of two recordings' samples at equal indices, Cohen's d, p and reject; null for fewer than two pairs
    and for equal differences."""
    d = a.join(b.withColumnRenamed("value", "other"), ["rec", "idx"]).select("rec", (F.col("value") - F.col("other")).alias("d"))
    s = d.groupBy("rec").agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("std"))
    d = F.try_divide("mean", "std")
    out = s.select("rec", "n", (d * F.sqrt("n")).alias("t"), d.alias("cohen_d"))
    return _decided(out, p_of_t(F.col("t"), F.col("n") - 1))


def ranked_counts(counts: DataFrame, key: list[str], value: str) -> DataFrame:
    """Adds `before`, how many rows of the key have a smaller value, to (key, value, ties) rows of distinct values.

    The values are dealt to tasks by ranges and added up within each range; one row a range and key is carried over. So no
    task sorts all values of a key.
    """
    df = dealt(counts, [*key, value], "part")
    own = df.groupBy(*key, "part").agg(F.sum("ties").alias("sum"))
    base = own.select(*key, "part", (F.sum("sum").over(Window.partitionBy(*key).orderBy("part")) - F.col("sum")).alias("base"))
    within = F.sum("ties").over(Window.partitionBy(*key, "part").orderBy(value)) - F.col("ties")
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in [*key, "part"]]
    x = df.withColumn("within", within).alias("x").join(base.alias("y"), same)
    return x.select("x.*", "y.base").withColumn("before", F.col("base") + F.col("within")).drop("base", "within", "part")


def ranked(df: DataFrame, key: list[str], value: str = "value") -> DataFrame:
    """Adds mid-ranks within the key and the number of ties, from the counts of distinct values: rows with equal values are
    counted before anything is sorted."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("ties"))
    ranks = ranked_counts(counts, key, value).withColumn("rank", F.col("before") + (F.col("ties") + 1) / 2).drop("before")
    return df.join(ranks, [*key, value])


def mannwhitney(df: DataFrame, group: str, first: str, second: str, value: str = "value") -> DataFrame:
    """U of the first group, rank-biserial correlation, the normal score with tie and continuity correction, p and reject. p is
    exact where a group has at most eight values and none tie. Figures are null where a group is empty, the score also where
    all values tie."""
    both = df.where(F.col(group).isin(first, second)).select(F.col(group).alias("g"), F.col(value).alias("v"), F.lit(1).alias("one"))
    r = ranked(both, ["one"], "v")
    s = r.agg(
        F.sum(F.when(F.col("g") == first, F.col("rank"))).alias("r1"), F.sum((F.col("g") == first).cast("double")).alias("n1"), F.sum((F.col("g") == second).cast("double")).alias("n2"),
        F.sum(F.col("ties").cast("double") * F.col("ties") - 1).alias("tie"),
    )
    n1, n2 = F.col("n1"), F.col("n2")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    n = n1 + n2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("tie"), n * (n - 1))))
    z = F.try_divide(F.abs(u - n1 * n2 / 2) - 0.5, sd)
    biserial = F.try_divide(2 * u, n1 * n2) - 1
    out = s.select(F.when(n1 * n2 > 0, u).alias("u"), biserial.alias("rank_biserial"), z.alias("z"), _label(biserial, R_CUTS).alias("effect"), "n1", "n2", "tie")
    return _decided(out, p_of_rank_sum(F.col("u"), F.col("n1"), F.col("n2"), F.col("z"), F.col("tie"))).drop("n1", "n2", "tie")


def linear_regression(samples: DataFrame, fs: float = 1.0) -> DataFrame:
    """slope, intercept, r², the slope's error, p and reject over time, from one pass. A single value has null figures, two have
    no error and no p."""
    s = samples.where("value IS NOT NULL").withColumn("t", F.col("idx") / fs)
    r = s.groupBy("rec").agg(
        F.count("*").alias("n"), F.regr_slope("value", "t").alias("slope"), F.regr_intercept("value", "t").alias("intercept"), F.regr_r2("value", "t").alias("r2"),
        F.regr_sxx("value", "t").alias("sxx"), F.regr_syy("value", "t").alias("syy"), F.regr_sxy("value", "t").alias("sxy"),
    )
    left = F.greatest(F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), "sxx"), F.lit(0.0))
    error = F.sqrt(F.try_divide(F.try_divide(left, F.col("n") - 2), "sxx"))
    out = r.select("rec", "n", "slope", "intercept", "r2", F.when(F.col("n") > 2, error).alias("stderr"))
    return _decided(out, p_of_t(F.try_divide("slope", "stderr"), F.col("n") - 2))


def predict(regression: DataFrame, at: DataFrame) -> DataFrame:
    """rec, t and the line's value for the times asked for (rec, t)."""
    return at.join(regression.select("rec", "slope", "intercept"), "rec").select("rec", "t", (F.col("intercept") + F.col("slope") * F.col("t")).alias("value"))


def detrend(samples: DataFrame, kind: str = "linear") -> DataFrame:
    """Take off the least-squares line, or the mean."""
    from undula.operators.cleaning import remove_dc

    if kind == "constant":
        return remove_dc(samples)
    s = samples.groupBy("rec").agg(F.regr_slope("value", "idx").alias("slope"), F.regr_intercept("value", "idx").alias("intercept"))
    return samples.join(s, "rec").select("rec", "idx", (F.col("value") - F.col("intercept") - F.col("slope") * F.col("idx")).alias("value"))


def detrend_polynomial(samples: DataFrame, order: int = 2) -> DataFrame:
    """Take off the least-squares polynomial, from sums of Legendre polynomials' products over time on [-1, 1]; these are
    nearly orthogonal there, so that high orders stay exact. A recording with no more values than coefficients becomes 0."""
    n = samples.groupBy("rec").agg(F.max("idx").alias("last"))
    s = samples.join(n, "rec").withColumn("x", F.coalesce(F.try_divide(2.0 * F.col("idx"), "last") - 1, F.lit(0.0)))
    x, v = F.col("x"), F.col("value")
    basis = [F.lit(1.0), x]
    for k in range(1, order):
        basis.append(((2 * k + 1) * x * basis[k] - k * basis[k - 1]) / (k + 1))
    names = [f"b{k}" for k in range(order + 1)]
    s = s.withColumns({b: c for b, c in zip(names, basis[: order + 1], strict=True)})
    present = s.where("value IS NOT NULL")
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(names) for b in names[i:]] + [F.sum(v * F.col(b)).alias(f"{b}_v") for b in names]
    g = present.groupBy("rec").agg(*sums)

    def solved(batches):
        for batch in batches:
            m = np.array([[batch[f"b{min(i, j)}_b{max(i, j)}"] for j in range(order + 1)] for i in range(order + 1)], float).transpose(2, 0, 1)
            y = np.array([batch[f"{b}_v"] for b in names], float).T
            yield pd.DataFrame({"rec": batch["rec"], "c": list(np.einsum("nij,nj->ni", np.linalg.pinv(m, hermitian=True), y))})

    fits = g.mapInPandas(solved, f"rec {samples.schema['rec'].dataType.simpleString()}, c array<double>")
    line = sum((F.col("c")[k] * F.col(b) for k, b in enumerate(names)), F.lit(0.0))
    return s.join(fits, "rec", "left").select("rec", "idx", (v - line).alias("value"))


def detrend_quadratic(samples: DataFrame) -> DataFrame:
    """Take off the least-squares parabola."""
    return detrend_polynomial(samples, 2)


def correlate(channels: DataFrame, method: str = "pearson") -> DataFrame:
    """channel_a, channel_b, n, r, p and reject for every two channels at their shared instants; pearson, spearman or kendall
    (tau-b). r and p are null where a channel is constant there, p also below three instants (pearson and spearman)."""
    s = channels.where("value IS NOT NULL")
    a, b = s.select(F.col("rec").alias("channel_a"), "idx", F.col("value").alias("x")), s.select(F.col("rec").alias("channel_b"), "idx", F.col("value").alias("y"))
    pairs = a.join(b, "idx").where("channel_a < channel_b")
    key = ["channel_a", "channel_b"]
    if method == "kendall":
        return _kendall(pairs, key)
    x, y = "x", "y"
    if method == "spearman":
        pairs = ranked(pairs, key, "x").withColumnRenamed("rank", "rx").drop("ties")
        pairs, x, y = ranked(pairs, key, "y").withColumnRenamed("rank", "ry"), "rx", "ry"
    elif method != "pearson":
        raise ValueError(f"unknown method {method!r}")
    # From sums, as corr() divides by a constant channel's deviation.
    m = pairs.groupBy(*key).agg(F.count("*").alias("n"), F.covar_pop(x, y).alias("xy"), F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy"))
    r = F.try_divide("xy", F.sqrt(F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xx") * F.col("yy"))))
    out = m.select(*key, "n", F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"))
    t = F.when(F.abs("r") < 1, F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("r") * F.col("r")))).otherwise(F.when(F.col("r").isNotNull() & (F.col("n") > 2), F.lit(math.inf)))
    return _decided(out, p_of_t(t, F.col("n") - 2))


#: Instants in a run of neighbouring ranks whose inversions a task counts by itself.
RUN = 1 << 16


def inversions(placed: DataFrame, key: list[str]) -> DataFrame:
    """key and `discordant`: the pairs of (key, px, py) rows with px < px' and py > py'; px are places, all different.

    Rows are cut into runs of RUN places by px and of RUN by py. A pair lies in one run of px, or in one of py and not of px,
    or in different runs of both; the first two are counted in tasks of one run, the last from how many rows each two runs
    share.
    """
    cells = placed.withColumns({"cx": F.floor(F.col("px") / RUN), "cy": F.floor(F.col("py") / RUN)})
    head = ", ".join(f"{k} {placed.schema[k].dataType.simpleString()}" for k in key)

    def counted(by: str):
        def run(own: pd.DataFrame) -> pd.DataFrame:
            own = own.sort_values("px")
            y, apart = own["py"].to_numpy(), own["cx"].to_numpy() if by == "cy" else None
            n = _inverted(y)
            if apart is not None:  # those within one run of px are the other count's
                n -= sum(_inverted(y[apart == c]) for c in np.unique(apart))
            return own[key].head(1).assign(d=n)

        return cells.groupBy(*key, by).applyInPandas(run, f"{head}, d double")

    def far(own: pd.DataFrame) -> pd.DataFrame:
        total = 0.0
        seen = np.zeros(int(own["cy"].max()) + 2)
        for _, part in own.sort_values("cx").groupby("cx"):
            above = seen.sum() - np.cumsum(seen)
            at, n = part["cy"].to_numpy(np.int64), part["n"].to_numpy(float)
            total += float((above[at] * n).sum())
            np.add.at(seen, at, n)
        return own[key].head(1).assign(d=total)

    shared = cells.groupBy(*key, "cx", "cy").agg(F.count("*").alias("n"))
    parts = counted("cx").unionByName(counted("cy")).unionByName(shared.groupBy(*key).applyInPandas(far, f"{head}, d double"))
    return parts.groupBy(*key).agg(F.sum("d").alias("discordant"))


def _inverted(y: np.ndarray) -> float:
    """The pairs i < j with y[i] > y[j], by merging runs of doubling length."""
    rank, total, width = np.unique(y, return_inverse=True)[1], 0.0, 1
    n = len(rank)
    while width < n:
        block = np.arange(n) // width
        later = block % 2 == 1
        keyed = (block // 2) * (n + 1) + rank
        left = np.sort(keyed[~later])
        ends = (block[later] // 2 + 1) * (n + 1) - 1
        total += float((np.searchsorted(left, ends, "right") - np.searchsorted(left, keyed[later], "right")).sum())
        width *= 2
    return total


def _kendall(pairs: DataFrame, key: list[str]) -> DataFrame:
    """tau-b from the inversions of y in the order of x, and p from its variance without correlation, ties allowed for."""
    pairs = stored(pairs)
    t = lambda c: F.col(c).cast("double")

    def ties(by: list[str], name: str) -> DataFrame:
        c = pairs.groupBy(*key, *by).agg(F.count("*").alias("t"))
        return c.groupBy(*key).agg(
            F.sum(t("t") * (t("t") - 1) / 2).alias(f"{name}2"), F.sum(t("t") * (t("t") - 1) * (t("t") - 2)).alias(f"{name}3"), F.sum(t("t") * (t("t") - 1) * (2 * t("t") + 5)).alias(f"{name}5"),
        )

    ranked_y = ranked_counts(pairs.groupBy(*key, "y").agg(F.count("*").alias("ties")), key, "y").select(*key, "y", F.col("before").alias("py"))
    placed = numbered(pairs, key, ["x", "y", "idx"], "px").join(ranked_y, [*key, "y"])
    d = inversions(placed.select(*key, "px", "py"), key)
    m = pairs.groupBy(*key).agg(F.count("*").alias("n")).join(ties(["x"], "x"), key).join(ties(["y"], "y"), key).join(ties(["x", "y"], "both"), key).join(d, key)
    n = t("n")
    every = n * (n - 1) / 2
    con_minus = every - F.col("x2") - F.col("y2") + F.col("both2") - 2 * F.col("discordant")
    r = F.try_divide(con_minus, F.sqrt((every - F.col("x2")) * (every - F.col("y2"))))
    var = (2 * every * (2 * n + 5) - F.col("x5") - F.col("y5")) / 18 + F.coalesce(F.try_divide(F.col("x2") * F.col("y2"), every), F.lit(0.0)) + F.coalesce(F.try_divide(F.col("x3") * F.col("y3"), 18 * every * (n - 2)), F.lit(0.0))
    z = F.try_divide(con_minus, F.sqrt(F.when(var > 0, var)))
    return _decided(m.select(*key, "n", r.alias("r"), F.when(r.isNotNull(), z).alias("z")), p_of_z(F.col("z"))).drop("z")


def strongest(correlations: DataFrame, n: int) -> DataFrame:
    return correlations.orderBy(F.abs("r").desc(), "channel_a", "channel_b").limit(n)


def autocorrelation(samples: DataFrame, max_lag: int | None = None) -> DataFrame:
    """rec, lag and the biased autocorrelation r_k / r_0 for lags 0 .. max_lag (by default a quarter of each recording's
    length); missing values count as the mean, and a constant recording has null."""
    return _lagged(samples, samples, 0, max_lag)


def cross_correlation(a: DataFrame, b: DataFrame, max_lag: int) -> DataFrame:
    """rec, lag and the correlation of a at idx + lag with b at idx, z-scored, by the shorter length; above 0, a lags b. Null
    where one is constant."""
    return _lagged(a, b, -max_lag, max_lag)


#: Samples in a piece whose products with another piece are added up at once.
PIECE = 1 << 12


def lag_products(a: DataFrame, b: DataFrame, low: int, high: int) -> DataFrame:
    """rec, lag and the sum of a(idx + lag) * b(idx) for each lag from `low` to `high`; missing values count as 0.

    Both are cut into pieces of PIECE samples; each piece of b meets the pieces of a that the lags reach, and the products of
    two pieces for all lags are one correlation. So the rows that meet are pieces, not samples times lags.
    """
    def pieces(s: DataFrame, name: str) -> DataFrame:
        pairs = F.array_sort(F.collect_list(F.struct((F.col("idx") % PIECE).alias("pos"), "value")))
        p = s.where("value IS NOT NULL").groupBy("rec", F.floor(F.col("idx") / PIECE).alias("piece")).agg(pairs.alias("p"))
        return p.select("rec", "piece", F.transform("p", lambda x: x["pos"]).alias(f"{name}_pos"), F.transform("p", lambda x: x["value"]).alias(f"{name}_value"))

    reach = F.explode(F.sequence(F.floor((F.col("piece") * PIECE + low) / PIECE), F.floor((F.col("piece") * PIECE + PIECE - 1 + high) / PIECE))).alias("other")
    met = pieces(b, "b").select("rec", "piece", "b_pos", "b_value", reach).join(pieces(a, "a").withColumnRenamed("piece", "other"), ["rec", "other"])

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                x, y = np.zeros(PIECE), np.zeros(PIECE)
                x[np.asarray(r.a_pos, int)], y[np.asarray(r.b_pos, int)] = r.a_value, r.b_value
                shift = (r.other - r.piece) * PIECE
                first, last = max(low, shift - PIECE + 1), min(high, shift + PIECE - 1)
                if first > last:
                    continue
                if last - first < 64:
                    sums = [x[max(0, k - shift) : PIECE + min(0, k - shift)] @ y[max(0, shift - k) : PIECE - max(0, k - shift)] for k in range(first, last + 1)]
                else:
                    size = 2 * PIECE
                    whole = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(y, size).conj(), size)
                    sums = whole[np.arange(first - shift, last - shift + 1) % size]
                out.append(pd.DataFrame({"rec": r.rec, "lag": np.arange(first, last + 1), "sum": sums}))
            yield pd.concat(out) if out else pd.DataFrame({"rec": [], "lag": [], "sum": []})

    parts = met.mapInPandas(run, f"rec {a.schema['rec'].dataType.simpleString()}, lag int, sum double")
    return parts.groupBy("rec", "lag").agg(F.sum("sum").alias("sum"))


def _lagged(a: DataFrame, b: DataFrame, low: int, high: int | None) -> DataFrame:
    def z(s: DataFrame) -> tuple[DataFrame, DataFrame]:
        m = s.groupBy("rec").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n"))
        return s.join(m, "rec").select("rec", "idx", F.try_divide(F.col("value") - F.col("mean"), "std").alias("value")), m.select("rec", "n", (F.col("std") > 0).alias("varies"))

    (za, ma), (zb, mb) = z(a), z(b)
    own = high is None
    if own:
        high = (ma.agg(F.max("n")).first()[0] or 0) // 4
    both = ma.join(mb.select("rec", F.col("n").alias("nb"), F.col("varies").alias("vb")), "rec")
    lags = both.withColumn("lag", F.explode(F.sequence(F.lit(low), F.lit(high))))
    lags = lags.where(F.col("lag") <= F.floor(F.col("n") / 4)) if own else lags.where((F.col("lag") < F.col("n")) & (-F.col("lag") < F.col("nb")))
    sums = lags.join(lag_products(za, zb, low, high), ["rec", "lag"], "left")
    r = F.try_divide(F.coalesce("sum", F.lit(0.0)), F.least("n", "nb"))
    return sums.select("rec", "lag", F.when(F.col("varies") & F.col("vb"), r).alias("r"))


def best_lag(correlation: DataFrame) -> DataFrame:
    return correlation.groupBy("rec").agg(F.max_by("lag", F.struct(F.abs("r"), -F.abs("lag"), "lag")).alias("best_lag"), F.max(F.abs("r")).alias("strength"))
