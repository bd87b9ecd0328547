"""Estimates of many transects and distances hold distinct values or a few resamples, and give what plain fits give."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wingtally.operators import estimators


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def transects(spark, n=60):
    return spark.range(n).select((F.col("id") % 2).alias("stratum"), (F.col("id") * 7 % 5 * (F.col("id") % 3)).alias("count"), (10 + F.col("id") % 6 * 1.5).alias("area_ha"))


def test_counts_are_fitted_by_distinct_pairs(spark):
    t = transects(spark)
    many = t.crossJoin(spark.range(40).select())
    once, often = ({r.stratum: r for r in estimators.zinb(d).collect()} for d in (t, many))
    for k, r in once.items():
        assert often[k].density == pytest.approx(r.density, rel=1e-4) and often[k].se == pytest.approx(r.se / 40, rel=1e-2)
    assert "HashAggregate" in plan_of(estimators.zinb(many))


def test_distances_are_fitted_by_distinct_values(spark):
    x = np.abs(np.round(np.random.RandomState(5).normal(0, 20, 3000)))
    d = spark.createDataFrame(pd.DataFrame({"stratum": 0, "distance": x, "effort_m": 1000.0}))
    out = estimators.distance_density(d, 40.0)
    assert plan_of(out).count("HashAggregate") >= 4  # of the truncation and of the distances
    got, x = out.first(), x[x <= 40]
    want = min((estimators.fit_detection(x, 40.0, m) for m in ("half-normal", "hazard-rate")), key=lambda r: r["aic"])
    assert got.n == len(x) and got.model == want["model"]
    assert (got.esw, got.aic) == pytest.approx((want["esw"], want["aic"]), rel=1e-6)
    assert got.density == pytest.approx(len(x) / (2 * want["esw"] * 1000) * 1e6, rel=1e-6)


def test_resamples_are_drawn_a_few_at_a_time(spark, monkeypatch):
    t = transects(spark, 4000).coalesce(1)
    monkeypatch.setattr(estimators, "PICKS", 10**9)
    at_once = sorted(estimators.bootstrap(t).collect())
    monkeypatch.setattr(estimators, "PICKS", 5000)
    assert sorted(estimators.bootstrap(t).collect()) == at_once


def test_a_task_holds_few_resamples():
    class Group:
        dtypes = [("stratum", "bigint")]
        orderBy = groupBy = lambda self, *keys: self
        applyInPandas = lambda self, run, schema: run

    pdf = pd.DataFrame({"stratum": 0, "count": np.arange(20_000) % 7, "area_ha": 10.0})
    tracemalloc.start()
    estimators.bootstrap(Group())(pdf)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100e6  # all at once: 480 MB
