"""Exact quantiles by narrowing against those of one aggregate."""

import pytest
from pyspark.sql import functions as F

from undula import core
from undula.operators import cleaning, normalize, outliers, statistics

QS = [0.0, 0.3, 0.5]


@pytest.fixture(scope="module")
def samples(spark):
    """Smooth, heavy-tailed, tied, constant, gappy and short recordings, and one without a value."""
    i = F.col("id")
    kinds = {
        "even": F.sin(i * 0.37) * 10, "tail": F.exp(F.pmod(F.hash(i), F.lit(1000)) / 20.0) * F.when(i % 2 == 0, 1).otherwise(-1), "tied": F.floor(F.pmod(F.hash(i), F.lit(7)) / 3).cast("double"),
        "same": F.lit(4.0), "gaps": F.when(i % 3 > 0, i * 1.5), "none": F.lit(None).cast("double"), "mass": F.when(i % 10 < 9, 5.0).otherwise(F.rand(3)),
    }
    made = None
    for name, value in kinds.items():
        own = spark.range(3_011).select(F.lit(name).alias("rec"), i.alias("idx"), value.cast("double").alias("value"))
        made = own if made is None else made.unionByName(own)
    return made.unionByName(spark.range(5).select(F.lit("short").alias("rec"), i.alias("idx"), (i * 2.0).alias("value"))).coalesce(4).cache()


def by_rec(df):
    return {r.rec: r.q for r in df.collect()}


def test_narrowed_quantiles_are_exact(samples, monkeypatch):
    want = by_rec(samples.groupBy("rec").agg(F.percentile("value", F.array(*map(F.lit, QS))).alias("q")))
    assert by_rec(core.quantiles(samples, "value", QS, core.long_recordings(samples))) == want
    monkeypatch.setattr(core, "LONG", 500)
    monkeypatch.setattr(core, "FINISH", 50)
    got = by_rec(core.quantiles(samples, "value", QS, core.long_recordings(samples)))
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == (pytest.approx(want[k], rel=1e-12, abs=1e-12) if want[k] else want[k])


def test_a_sketch_that_errs_costs_rounds_only(samples, monkeypatch):
    want = by_rec(samples.groupBy("rec").agg(F.percentile("value", F.array(*map(F.lit, QS))).alias("q")))
    monkeypatch.setattr(core, "LONG", 500)
    monkeypatch.setattr(core, "FINISH", 400)
    monkeypatch.setattr(core, "ACCURACY", 50)  # too coarse for 200 quantiles
    got = by_rec(core.quantiles(samples.where("rec IN ('even', 'mass')"), "value", QS, core.long_recordings(samples)))
    assert all(got[k] == pytest.approx(want[k], rel=1e-12) for k in got)


@pytest.mark.parametrize("f", [outliers.mad, outliers.spike, normalize.robust_scale, cleaning.winsorize, statistics.describe])
def test_operators_with_long_recordings(samples, monkeypatch, f):
    few = samples.where("rec IN ('even', 'gaps', 'short') AND idx < 700").coalesce(2).cache()
    tidy = lambda df: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)
    want = tidy(f(few))
    monkeypatch.setattr(core, "LONG", 300)
    monkeypatch.setattr(core, "FINISH", 64)
    assert tidy(f(few)) == want
