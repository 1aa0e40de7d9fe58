"""Rounding of shown columns and frames without masks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions.windows import rounded
from tidemark.operators import frames as fr
from tidemark.queries import shown


def test_rounding_is_that_of_spark(spark):
    rng = np.random.default_rng(3)
    some = np.concatenate([rng.normal(size=4000) * 10.0 ** rng.integers(-9, 14, 4000), (2 * rng.integers(-(10**7), 10**7, 2000) + 1) / 2 / 1e5, rng.integers(-(10**6), 10**6, 500) / 1e5])
    odd = [None, float("nan"), float("inf"), float("-inf"), -0.0, 0.0, 5e-6, -5e-6, 1.000005, 2.675, 1e300, -1e17]
    table = spark.createDataFrame([(x,) for x in [*map(float, some), *odd]], "x double")
    for digits in (4, 5, 8):
        apart = table.where(~(F.round("x", digits) + 0.0).eqNullSafe(rounded("x", digits)))
        assert apart.count() == 0


def test_shown_columns_pass_decimals_at_ties_only(spark):
    plan = shown(spark.range(3).select("id", (F.col("id") / 7).alias("x")), ["id"], ["x"])._jdf.queryExecution().optimizedPlan().toString()
    assert "rint" in plan.lower()


def test_frames_with_and_without_gaps_have_the_moments_of_their_values():
    rng = np.random.default_rng(5)
    for n in (0, 1, 7, 300):
        for holes in (0, 0.1, 1):
            x, y = rng.normal(50, 2, n), rng.normal(size=n)
            x[rng.random(n) < holes], y[rng.random(n) < holes / 2] = np.nan, np.nan
            for w in (1, 5, 60):
                for other in (None, y):
                    count, first, second = fr.moments(x, w, other)
                    for i in range(n):
                        a = x[max(0, i - w + 1) : i + 1]
                        b = a if other is None else y[max(0, i - w + 1) : i + 1]
                        ok = ~(np.isnan(a) | np.isnan(b))
                        a, b = a[ok], b[ok]
                        assert count[i] == len(a)
                        if len(a):
                            np.testing.assert_allclose(second[i], ((a - a.mean()) ** 2).sum(), atol=1e-9)
                            np.testing.assert_allclose(first[i], a.mean() if other is None else ((a - a.mean()) * b).sum(), atol=1e-9)
    assert all(v.shape == (10, 4) for _, v in fr.views(np.arange(30.0), 4, 0.0, 20))


def test_exponential_means_in_stretches_are_those_of_pandas():
    rng = np.random.default_rng(6)
    for n in (0, 1, 31, 32, 33, 200):
        x = {c: rng.normal(50, 9, n) for c in ("plain", "late", "gap", "inf", "none", "still")}
        x["late"][: n // 3], x["none"][:], x["still"][:] = np.nan, np.nan, 7.1
        if n > 9:
            x["gap"][5:9], x["inf"][7] = np.nan, np.inf
        for span, least in ((10, 0), (14, 14), (1, 1)):
            got, want = fr.ewms(x, span, least), pd.DataFrame(x).ewm(span=span, adjust=False, min_periods=least).mean()
            for c in x:
                np.testing.assert_allclose(got[c], want[c].to_numpy(), rtol=1e-12)


def test_whole_columns_are_smoothed_without_pandas(monkeypatch):
    monkeypatch.setattr(fr.pd, "DataFrame", None)
    assert len(fr.ewms({"x": np.arange(40.0)}, 10)["x"]) == 40
