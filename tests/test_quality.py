"""Signal quality on signals with one defect each."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from undula import core
from undula.core import from_arrays
from undula.operators import quality

NOISE = np.random.default_rng(7).normal(0, 1, 512)


def damaged(start, stop, value):
    x = NOISE.copy()
    x[start:stop] = value
    return x


SIGNALS = {
    "clean": NOISE, "spikes": damaged(100, 101, 40.0), "empty": np.full(100, np.nan), "constant": np.full(100, 0.1), "short": np.arange(10.0), "short_gap": np.array([1.0, np.nan, 3.0]),
    "digital": np.tile([-1.0, 1.0], 64), "clipping": np.minimum(damaged(50, 60, 9.0), 9.0), "flatline": damaged(200, 230, 0.5), "two_highs": damaged(300, 302, 5.0), "quiet": np.where(np.arange(512) < 64, NOISE / 20, NOISE),
    "missing": damaged(20, 40, np.nan), "offset": NOISE + 9, "trend": NOISE + np.arange(512) / 50 - 5.11,
}
ISSUES = {
    "clean": "", "spikes": "spikes:warning", "empty": "empty:critical", "constant": "constant:critical", "short": "short:critical", "short_gap": "missing:critical,short:critical", "digital": "digital:info",
    "clipping": "clipping:warning", "flatline": "flatline:warning", "two_highs": "", "quiet": "nonstationary:info", "missing": "missing:warning", "offset": "dc_offset:info", "trend": "trend:warning",
}


@pytest.mark.parametrize("chunk", [70, 1 << 16])
def test_each_defect_is_found_alone(spark, monkeypatch, chunk):
    monkeypatch.setattr(core, "CHUNK", chunk)
    s = from_arrays(spark.createDataFrame([(k, v.tolist()) for k, v in SIGNALS.items()], "rec string, values array<double>"), "rec", "values")
    rows = {r.rec: r for r in quality.diagnose(s).collect()}
    got = {k: r.issues for k, r in rows.items()}
    spiked = got.pop("two_highs")
    assert got == {k: v for k, v in ISSUES.items() if k != "two_highs"}
    assert "clipping" not in spiked
    assert (rows["spikes"].spikes, rows["spikes"].score, rows["spikes"].grade, rows["spikes"].ok) == (1, 88, "B", False)
    assert rows["flatline"].flat == 30 and rows["clipping"].clipped == 10 and rows["clipping"].spikes == 0


def test_spikes_are_gone_before_the_offset_is_measured(spark):
    x = NOISE.copy()
    x[25::50] += 3000
    s = from_arrays(spark.createDataFrame([("x", (x + 9).tolist())], "rec string, values array<double>"), "rec", "values")
    assert quality.diagnose(s).select(F.col("issues")).first()[0] == "spikes:warning,dc_offset:info"


def stages_of(spark, work):
    """How many stages have run for a piece of work, and its result's plan."""
    spark.sparkContext.setJobGroup(work.__name__, "")
    made = work()
    made.collect()
    tracker = spark.sparkContext.statusTracker()
    ids = {s for job in tracker.getJobIdsForGroup(work.__name__) for s in tracker.getJobInfo(job).stageIds}
    ran = [s for s in map(tracker.getStageInfo, ids) if s is not None and s.numCompletedTasks]
    return len(ran), made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


@pytest.fixture
def plain_joins(spark):
    """Joins as of large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture
def recordings(spark):
    return from_arrays(spark.createDataFrame([(k, v.tolist()) for k, v in SIGNALS.items()], "rec string, values array<double>"), "rec", "values")


def test_diagnosis_deals_samples_out_a_few_times(spark, plain_joins, recordings):
    def diagnosed():
        return quality.diagnose(recordings, 64.0)

    assert stages_of(spark, diagnosed)[0] < 45


def test_each_repair_is_made_once(spark, monkeypatch, recordings):
    from undula.plans import pipeline

    calls = []
    for name, f in pipeline.STEPS.items():
        monkeypatch.setitem(pipeline.STEPS, name, lambda s, fs=None, f=f, name=name, **p: (calls.append((name, str(p))), f(s, fs, **p))[1])
    both = from_arrays(spark.createDataFrame([("both", damaged(100, 101, 40.0).tolist()), ("gap", damaged(20, 40, np.nan).tolist())], "rec string, values array<double>"), "rec", "values")
    both = both.withColumn("value", F.when(~((F.col("rec") == "both") & F.col("idx").between(200, 204)), F.col("value")))
    s = recordings.unionByName(both)
    cleaned, before, after = quality.auto_clean(s)
    assert len(calls) == len(set(calls)) > 2
    want = s.where("rec IN ('clean', 'short', 'empty')")
    assert sorted(map(tuple, cleaned.where("rec IN ('clean', 'short', 'empty')").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert cleaned.count() == s.count()
    got = {r.rec: r.issues for r in after.collect()}
    assert got["both"] == got["spikes"] == got["missing"] == ""


def test_screen_sorts_samples_in_few_plans(spark, plain_joins, recordings):
    def screened():
        return quality.screen(recordings)

    assert stages_of(spark, screened)[1].count("Sort [") <= 8
