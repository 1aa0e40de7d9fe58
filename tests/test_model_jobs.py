"""Order statistics, permutations, portfolio sums, repeated keys, trading weeks and the model job."""

import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import evaluation as ev
from tidemark.operators import model as md
from tidemark.operators import order as od
from tidemark.operators import portfolio as pf
from tidemark.operators import significance as sg
from tidemark.operators import tables as tb


@pytest.mark.parametrize("kind", ["even", "ties", "tails", "one"])
def test_quantiles_are_exact_however_often_brackets_narrow(spark, kind):
    rng = np.random.default_rng(3)
    x = {"even": rng.normal(size=5_000), "ties": rng.integers(0, 4, 5_000).astype(float), "tails": np.exp(30 * rng.normal(size=5_000)), "one": np.array([7.0])}[kind]
    rows = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(7)
    ps = [0.0, 0.01, 0.333, 0.5, 0.99, 1.0]
    for most in (3, 50, 10_000):
        assert np.allclose(od.quantiles(rows, {"x": ps}, most)["x"], np.quantile(x, ps), rtol=1e-12)


def test_quantiles_of_nothing(spark):
    rows = spark.createDataFrame([(None, 1.0), (None, 3.0)], "a double, b double")
    assert od.quantiles(rows, {"a": [0.5], "b": [0.5, 0.25]}) == {"a": [None], "b": [2.0, 1.5]}
    assert od.select_ranks(rows, {"b": [0, 1, 2, -1]}) == {"b": {0: 1.0, 1: 3.0}}


def test_no_percentile_of_a_whole_table_is_left(spark):
    rows = spark.createDataFrame([(float(i), float(i % 7), dt.date(2020, 1, 1) + dt.timedelta(days=i)) for i in range(200)], "a double, b double, entry date")
    for made in (ev.winsorise(rows, ["a", "b"]), ev.date_split(rows)):
        assert "percentile" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_permutations_against_direct_ones(spark):
    rng = np.random.default_rng(5)
    y = (rng.random(300) < 0.3).astype(int)
    x, noise = y + rng.normal(0, 0.8, 300), rng.normal(size=300)
    rows = spark.createDataFrame([(i, float(x[i]), float(noise[i]), int(y[i])) for i in range(300)], "k long, x double, noise double, y int")
    got = {r.feature: r for r in sg.permutation_test(rows, "k", ["x", "noise"], "y", n=15).collect()}
    import hashlib

    def mi(v, labels):
        b = np.minimum(np.floor((v - v.min()) / (v.max() - v.min()) * 10), 9)
        out = 0.0
        for i in np.unique(b):
            for j in (0, 1):
                n = ((b == i) & (labels == j)).sum()
                if n:
                    out += n / 300 * math.log(n * 300 / ((b == i).sum() * (labels == j).sum()))
        return out

    for name, v in (("x", x), ("noise", noise)):
        at = [np.array([int(hashlib.md5(f"42:{j}:{i}".encode()).hexdigest()[:13], 16) for i in range(300)]) for j in range(15)]
        random = [mi(v, (np.argsort(np.argsort(p)) < y.sum()).astype(int)) for p in at]
        true = mi(v, y)
        assert math.isclose(got[name].mi, true, rel_tol=1e-9) and math.isclose(got[name].random_mean, np.mean(random), rel_tol=1e-9)
        assert math.isclose(got[name].p, (sum(r >= true - 1e-12 for r in random) + 1) / 16)
    assert got["x"].p == 1 / 16 and not got["noise"].found


def test_permutations_of_one_class(spark):
    assert sg.permutation_test(spark.createDataFrame([(1, 2.0, 0), (2, 3.0, 0)], "k long, x double, y int"), "k", ["x"], "y").collect() == []


def test_variance_is_the_quadratic_form(spark):
    rng = np.random.default_rng(8)
    a = rng.normal(size=(6, 20))
    corr, sigma = np.corrcoef(a), rng.uniform(0.1, 0.4, 6)
    names = [f"S{i}" for i in range(6)]
    w = rng.normal(size=(2, 6))
    weights = spark.createDataFrame([(k, names[i], float(w[k, i])) for k in range(2) for i in range(6)] + [(5, "?", 1.0)], "week int, symbol string, weight double")
    risks = spark.createDataFrame(list(zip(names, map(float, sigma), strict=True)), "symbol string, sigma double")
    pairs = spark.createDataFrame([(names[max(i, j)], names[min(i, j)], float(corr[i, j])) for i in range(6) for j in range(i + 1)], "a string, b string, corr double")
    got = {r.week: r.variance for r in pf.variance(weights, risks, pairs).collect()}
    for k in range(2):
        r = w[k] * sigma
        assert math.isclose(got[k], r @ corr @ r, rel_tol=1e-9)
        plain = {x.week: x.volatility for x in pf.variance(weights, risks).collect()}
        assert math.isclose(plain[k], math.sqrt((r * r).sum()), rel_tol=1e-9)
    assert 5 not in got


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(w=st.integers(1, 40), seed=st.integers(0, 99))
def test_rolling_drawdown(spark, w, seed):
    nav = np.exp(np.cumsum(np.random.default_rng(seed).normal(0, 0.05, 60)))
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(nav)], "week int, nav double")
    got = [r.roll_max_drawdown for r in pf.rolling_drawdown(rows, w).orderBy("week").collect()]
    for i in range(60):
        if i < w - 1:
            assert got[i] is None
        else:
            part = nav[i - w + 1 : i + 1]
            assert math.isclose(got[i], min((part[k:].min() / part[k] - 1) for k in range(w)), abs_tol=1e-12)


def test_repeated_keys_pair_up(spark):
    left = spark.createDataFrame([("A", 1, 10), ("A", 1, 11), ("A", 1, 12), ("B", 1, 13), (None, 2, 14), (None, 2, 15)], "s string, d int, x int")
    right = spark.createDataFrame([("A", 1, 1.0), ("A", 1, 2.0), ("B", 1, 3.0), ("C", 1, 4.0), (None, 2, 5.0)], "s string, d int, y double")
    got = sorted(tuple(r) for r in tb.aligned(left, right, ["s", "d"], ["x"], ["y"]).select("x", "y").collect())
    assert got == [(10, 1.0), (11, 2.0), (13, 3.0), (14, 5.0)]
    whole = tb.aligned(left, right, ["s", "d"], ["x"], ["y"], "full")
    assert whole.count() == 7 and whole.where("x is null").select("s", "occurrence", "y").collect() == [("C", 1, 4.0)]


def test_row_ids_carry_labels_of_a_panel(spark):
    panel = spark.createDataFrame([(dt.date(2020, 1, 1 + i % 5), f"S{i % 3}", i) for i in range(60)], "date date, symbol string, x int")
    ids = tb.with_row_ids(panel, ["date", "symbol"], ["x"])
    again = tb.with_row_ids(panel.orderBy(F.rand()), ["date", "symbol"], ["x"])
    assert ids.select("row_id").distinct().count() == 60
    assert ids.join(again.withColumnRenamed("x", "z"), "row_id").where("x <> z").count() == 0
    labels = ids.where("x % 4 <> 0").select("row_id", (F.col("x") % 2).alias("y"))
    assert ids.join(labels, "row_id").where("x % 2 <> y").count() == 0 and ids.join(labels, "row_id").count() == 45


def test_weeks_snap_to_days_that_exist(spark):
    d = dt.date
    days = spark.createDataFrame([(x,) for x in (d(2024, 1, 2), d(2024, 1, 5), d(2024, 1, 16), d(2024, 1, 16), None)], "date date")
    got = [tuple(r) for r in tb.trading_weeks(days).orderBy("week").collect()]
    assert got == [(d(2024, 1, 1), d(2024, 1, 2), d(2024, 1, 5), 2, d(2024, 1, 16), None), (d(2024, 1, 15), d(2024, 1, 16), d(2024, 1, 16), 1, None, d(2024, 1, 5))]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate((d(2024, 1, 1), d(2024, 1, 5), d(2024, 1, 10), d(2024, 1, 20), None))], "i int, day date")
    got = {r.i: (r.on_or_before, r.on_or_after, r.week_first, r.week_last) for r in tb.snapped(rows, "day", days).collect()}
    assert got == {0: (None, d(2024, 1, 2), d(2024, 1, 2), d(2024, 1, 5)), 1: (d(2024, 1, 5), d(2024, 1, 5), d(2024, 1, 2), d(2024, 1, 5)), 2: (d(2024, 1, 5), d(2024, 1, 16), None, None), 3: (d(2024, 1, 16), None, d(2024, 1, 16), d(2024, 1, 16)), 4: (None, None, None, None)}


def learnable(spark, n=600):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(n, 2))
    y = (x[:, 0] + 0.4 * rng.normal(size=n) > 0).astype(float)
    return spark.createDataFrame([(f"S{i % 6}", dt.date(2021, 1, 1) + dt.timedelta(days=i // 6), float(x[i, 0]), None if i % 40 == 7 else float(x[i, 1]), float(y[i])) for i in range(n)], "symbol string, date date, a double, b double, y double")


@pytest.mark.parametrize("method", ["isotonic", "platt"])
def test_a_stored_job_scores_as_it_did(spark, tmp_path, method):
    rows = learnable(spark).withColumns({"__note": F.lit("kept"), "p_old": F.lit(1.0)})
    job = md.fit_job(rows, ["a", "b"], "y", "date", "symbol", method, maxIter=3, maxDepth=3)
    assert job.settings["auc"] > 0.85 and job.settings["fit"] + job.settings["held_out"] == 600 and job.settings["held_out"] < 120
    job.save(str(tmp_path / "job"))
    back = md.load(spark, str(tmp_path / "job"))
    assert back.settings == job.settings
    key = lambda j: sorted((r.symbol, r.date, r.p, r.calibrated, r["rank"]) for r in j.ranked(rows.drop("y"), "date", "symbol", 3).collect())
    assert key(back) == key(job) and len(key(job)) == 300
    made = back.score(rows)
    assert made.columns == [*rows.columns, "p", "calibrated"]
    f = made.select("p", "calibrated").toPandas().sort_values("p")
    assert (np.diff(f["calibrated"]) >= -1e-12).all() and f["calibrated"].between(0, 1).all()


def test_jobs_need_both_classes_on_both_sides(spark):
    rows = learnable(spark, 120).withColumn("y", F.when(F.col("date") > "2021-01-17", 1.0).otherwise(F.col("y")))
    with pytest.raises(ValueError, match="held out"):
        md.fit_job(rows, ["a", "b"], "y", "date", "symbol", maxIter=1)


def test_out_of_fold_rows_and_metrics(spark):
    rows = learnable(spark).withColumn("n", (F.datediff("date", F.lit("2021-01-01")) / 25).cast("int"))
    folds = rows.where("n <= 1").withColumns({"fold": F.lit(0), "role": F.when(F.col("n") == 0, "train").otherwise("test")})
    folds = folds.unionByName(rows.where("n <= 2").withColumns({"fold": F.lit(1), "role": F.when(F.col("n") < 2, "train").otherwise("test")}))
    folds = folds.unionByName(rows.where("n = 3").withColumns({"fold": F.lit(2), "role": F.lit("test")}))  # nothing to learn from
    table, metrics = md.out_of_fold(folds, ["a", "b"], "y", "date", "symbol", maxIter=2, maxDepth=2)
    assert table.count() == folds.where("role = 'test' and fold < 2").count()
    assert {(r.fold, r.train_n) for r in metrics.collect()} == {(0, 150), (1, 300)} and all(r.auc > 0.8 for r in metrics.collect())
