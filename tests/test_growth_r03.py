"""Work that grew faster than its input, or was done many times over."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation as ev
from tidemark.operators import model as md
from tidemark.operators import order
from tidemark.operators import portfolio as pf


@pytest.fixture
def counted(spark):
    """A table whose rows add to a counter each time they are made."""
    made = spark.sparkContext.accumulator(0)

    def table(rows, schema):
        def look(frames):
            for f in frames:
                made.add(len(f))
                yield f

        df = spark.createDataFrame(rows, schema)
        return df.mapInPandas(look, df.schema)

    return made, table


def test_quantiles_make_their_rows_once(counted):
    made, table = counted
    x = np.random.default_rng(1).normal(size=30_000)
    got = order.quantiles(table([(float(v),) for v in x], "x double"), {"x": [0.1, 0.9]})["x"]
    assert np.allclose(got, np.quantile(x, [0.1, 0.9])) and made.value == 30_000


def test_adjusted_p_values_in_buckets_with_ties_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(ev, "BUCKET", 20)
    rng = np.random.default_rng(3)
    p = [None if i % 50 == 7 else round(float(v), 3) for i, v in enumerate(rng.beta(0.4, 3, 700))]
    out = ev.benjamini_hochberg(spark.createDataFrame([(f"f{i}", v) for i, v in enumerate(p)], "feature string, p double"))
    assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    got = {r.feature: (r.q, r.found) for r in out.collect()}
    known = sorted((v, i) for i, v in enumerate(p) if v is not None)
    want, least = {f"f{i}": 1.0 for i, v in enumerate(p) if v is None}, 1.0
    for k in range(len(known), 0, -1):
        least = min(least, known[k - 1][0] * len(p) / k)
        want[f"f{known[k - 1][1]}"] = least
    assert {f: q for f, (q, _) in got.items()} == pytest.approx(want)
    assert {f for f, (_, found) in got.items() if found} == {f for f, q in want.items() if q <= 0.05}


def test_only_held_pairs_are_correlated(spark):
    rng = np.random.default_rng(5)
    start = dt.date(2024, 1, 1)
    r = {(f"S{s}", start + dt.timedelta(weeks=w)): float(rng.normal()) for s in range(30) for w in range(25) if (s + w) % 11}
    held = [(start + dt.timedelta(weeks=w), f"S{s}") for w in range(25) for s in ((0, 1, 2) if w < 20 else (2, 3))]
    got = {(x.a, x.b): x.corr for x in pf.held_correlations(spark.createDataFrame(held, "week date, symbol string"), spark.createDataFrame([(*k, v) for k, v in r.items()], "symbol string, week date, r double")).collect()}
    for a, b in got:
        weeks = [w for s, w in r if s == a and (b, w) in r]
        assert got[a, b] == pytest.approx(np.corrcoef([r[a, w] for w in weeks], [r[b, w] for w in weeks])[0, 1])
    assert set(got) == {("S0", "S1"), ("S0", "S2"), ("S1", "S2"), ("S2", "S3")}


def test_a_job_makes_its_rows_once(spark, counted):
    made, table = counted
    rng = np.random.default_rng(2)
    rows = [(f"S{i}", dt.date(2024, 1, 1) + dt.timedelta(days=i), float(v), int(v + rng.normal() > 0)) for i, v in enumerate(rng.normal(size=400))]
    md.fit_job(table(rows, "symbol string, date date, move double, y int"), ["move"], "y", "date", "symbol", maxIter=2, maxDepth=2)
    assert made.value == 400
