"""Plans of blocks, the standard table, the drivers and factor regressions."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import factors as fc
from tidemark.operators import features as ft
from tidemark.plans import cross_section as xs
from tidemark.plans import daily as pl
from tidemark.plans.registry import DATE, PASS, Registry

BARS = ["symbol", "date", "open", "high", "low", "close", "adjclose", "volume"]


def walk(n=140, symbols=3, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(symbols):
        close = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        day = dt.date(2022, 1, 3)
        for i in range(n):
            o = close[i] * (1 + rng.normal(0, 0.005))
            rows.append((f"S{s}", day + dt.timedelta(days=i), *map(float, (o, max(o, close[i]) * 1.01, min(o, close[i]) * 0.99, close[i], close[i], rng.integers(100, 9_000)))))
    return rows


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(walk(), "symbol string, date date, open double, high double, low double, close double, adjclose double, volume double").cache()


def exchanges(table):
    return table._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(symbol")


def test_plan_prunes_and_orders():
    r = Registry()
    r.add("a", None, ["close"], ["x"])
    r.add("late", None, ["y", "z"], ["last"], PASS)
    r.add("b", None, ["x"], ["y"], PASS)
    r.add("c", None, ["x"], ["z"])
    r.add("other", None, ["close"], ["w"])
    r.add("ranked", None, ["last"], ["rank"], DATE)
    names = lambda phases: [(k, [b.name for b in blocks]) for k, blocks in phases]
    assert names(r.plan(["rank"], ["close"])) == [("window", ["a", "c"]), ("pass", ["b", "late"]), ("date", ["ranked"])]
    assert names(r.plan(["y"], ["close"])) == [("window", ["a"]), ("pass", ["b"])]
    assert names(r.plan(["late"], ["x", "z", "y"])) == [("pass", ["late"])]
    assert r.plan(["a"], ["close", "x"]) == []


def test_plans_that_cannot_be():
    r = Registry()
    r.add("a", None, ["b_out"], ["a_out"])
    r.add("b", None, ["a_out"], ["b_out"])
    with pytest.raises(ValueError, match="need each other"):
        r.plan(["a"], [])
    r.add("c", None, ["nowhere"], ["c_out"])
    with pytest.raises(ValueError, match="nothing makes"):
        r.plan(["c"], [])
    with pytest.raises(ValueError, match="taken"):
        r.add("a", None, [], ["new"])
    with pytest.raises(ValueError, match="which a makes"):
        r.add("d", None, [], ["a_out"])
    with pytest.raises(ValueError, match="no block"):
        r.plan(["unknown"], [])


def test_all_blocks_take_one_exchange(bars):
    table = pl.feature_table(bars)
    assert exchanges(table) == 1 and table._jdf.queryExecution().executedPlan().toString().count("FlatMapGroupsInArrow") == 1
    made = table.agg(*(F.count(c).alias(c) for c in table.columns)).first().asDict()
    assert len(made) > 180
    short = {"ma_200", "pct_slope_ma_200"}  # 140 rows
    assert not {c for c, n in made.items() if not n} - short


def test_a_column_brings_only_what_it_rests_on(bars):
    table = pl.feature_table(bars, ["quiet_trend"])
    assert table.columns == [*BARS, "quiet_trend"]
    assert [b.name for _, blocks in pl.standard().plan(["quiet_trend"], BARS) for b in blocks] == ["returns", "trend_windows", "volatility_windows", "volatility_smooth", "quiet_trend"]


def test_pass_values(bars):
    got = pl.feature_table(bars, ["trend", "volatility", "squeeze", "range", "divergence", "macd"]).toPandas()
    for _, f in got.sort_values("date").groupby("symbol"):
        f = f.reset_index(drop=True)
        assert np.allclose(f["trend_persist_ema"], f["trend_score_sign"].ewm(span=10, adjust=False).mean())
        assert np.allclose(f["gap_atr_ratio_raw"].dropna(), ((f["open"] - f["close"].shift()) / f["atr14"]).dropna())
        on = f["squeeze_on_20"].tolist()
        run, want = 0, []
        for x in on:
            run = run + 1 if x else 0
            want.append(min(run, 50))
        assert f["days_in_squeeze_20"].tolist() == want
        left = [float(a == 1 and b == 0) for a, b in zip([0, *on], on, strict=False)]
        assert f["squeeze_release_20"].tolist() == left
        assert set(on) == {0.0, 1.0}


def test_macd_needs_35_values(spark):
    rows = spark.createDataFrame(walk(34, 1) + [(f"L{r[0]}", *r[1:]) for r in walk(35, 1)], "symbol string, date date, open double, high double, low double, close double, adjclose double, volume double")
    n = {r.symbol: r.n for r in pl.feature_table(rows, ["macd"]).groupBy("symbol").agg(F.count("macd_histogram").alias("n")).collect()}
    assert n == {"S0": 0, "LS0": 35}


def test_user_blocks_join_a_plan(bars):
    r = pl.standard()
    r.add("mine", lambda t: t.withColumn("double_ret", 2 * F.col("ret")), ["ret"], ["double_ret"])
    pl.grouped(r, "seen", lambda f: [f["double_ret"].cumsum()], ["double_ret"], ["run"])
    r.add("place", lambda t: t.withColumn("place", F.rank().over(Window.partitionBy("date").orderBy("run"))), ["run"], ["place"], DATE)
    got = pl.feature_table(bars, ["place", "run"], r)
    assert got.columns == [*BARS, "run", "place"]
    f = got.toPandas().sort_values("date")
    for _, g in f.groupby("symbol"):
        assert np.allclose(g["run"].dropna(), (2 * np.log(g["adjclose"]).diff()).cumsum().dropna())
    assert f.groupby("date")["place"].max().max() == 3


def test_short_series_keep_simple_weekly_columns(bars):
    got = pl.higher_time_frame(bars, ["trend", "rsi"], least=30).toPandas()
    assert got["w_ma_10"].notna().any() and got["w_trend_score_granular"].isna().all()
    assert pl.higher_time_frame(bars, ["trend"], least=5).toPandas()["w_trend_score_granular"].notna().any()


@pytest.mark.parametrize(("k", "w"), [(1, 12), (2, 60), (4, 30)])
def test_ridge_against_dense_solutions(spark, k, w):
    rng = np.random.default_rng(k)
    x = rng.normal(0, 0.5, (90, k))
    y = x @ np.arange(1, k + 1) + rng.normal(0, 0.1, 90) + 0.3
    y[40], x[55, 0] = np.nan, np.nan
    rows = [("A", dt.date(2020, 1, 1) + dt.timedelta(days=i), *(None if np.isnan(v) else float(v) for v in (*x[i], y[i]))) for i in range(90)]
    xs_ = [f"x{i}" for i in range(k)]
    table = spark.createDataFrame(rows, ", ".join(["symbol string, date date", *(f"{c} double" for c in [*xs_, "y"])]))
    got = fc.rolling_ridge(table, "y", xs_, w).orderBy("date").toPandas()
    least, seen = min(w, max(20, int(w * 0.33))), 0
    for i in range(90):
        part = slice(max(0, i - w + 1), i + 1)
        ok = ~(np.isnan(y[part]) | np.isnan(x[part]).any(axis=1))
        row = got.iloc[i]
        if i < w - 1 or ok.sum() < least:
            assert np.isnan(row["alpha"])
            continue
        a, b = x[part][ok], y[part][ok]
        beta = np.linalg.solve((a - a.mean(0)).T @ (a - a.mean(0)) + 0.01 * np.eye(k), (a - a.mean(0)).T @ (b - b.mean()))
        level = b.mean() - a.mean(0) @ beta
        assert np.allclose(row[[f"beta_{c}" for c in xs_]].astype(float), beta) and np.isclose(row["alpha"], level)
        whole = not np.isnan(y[i]) and not np.isnan(x[i]).any()
        assert np.isclose(row["ridge_resid"], y[i] - level - x[i] @ beta) if whole else np.isnan(row["ridge_resid"])
        seen += 1
    assert seen > 25


def test_ridge_stays_in_the_engine(spark, bars):
    plan = fc.rolling_ridge(ft.returns(bars), "ret", ["volume", "close"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def sides(spark, bars):
    b = ft.returns(bars)
    bench = b.groupBy("date").agg(F.avg("close").alias("px")).withColumn("bench", F.lit("M"))
    bench = bench.unionByName(b.where("symbol = 'S1'").select("date", F.col("close").alias("px"), F.lit("G").alias("bench")))
    bench = bench.withColumn("bench_ret", F.log("px") - F.lag(F.log("px")).over(Window.partitionBy("bench").orderBy("date")))
    sectors = spark.createDataFrame([("S0", "x"), ("S1", "x"), ("S2", "y")], "symbol string, sector string")
    mapping = spark.createDataFrame([("S0", "G"), ("S2", "M")], "symbol string, bench string")
    return b, xs.Sides(sectors, bench.cache(), {"market": "M", "growth": "G"}, mapping)


def test_alpha_and_strength_share_an_exchange(spark, bars):
    b, s = sides(spark, bars)
    b = spark.createDataFrame(b.collect(), b.schema)
    assert exchanges(xs.daily(b, s, ["alpha", "strength"])) <= 1
    table = xs.daily(b, s, ["alpha"])
    f = table.where("symbol = 'S1'").agg(F.count("market_alpha").alias("m"), F.count("match_alpha").alias("n")).first()
    assert f.m > 0 and f.n == 0  # S1 has no best match


def test_drivers_keep_every_row(spark, bars):
    b, s = sides(spark, bars)
    for table in (xs.daily(b, s, ["momentum", "ranks", "breadth", "volatility_context"]), xs.weekly(bars, s, ["momentum", "ranks", "strength"])):
        assert table.count() == bars.count()
    got = fc.joint_factors(b.select("symbol", "date", "ret"), s.bench, s.roles, mapping=s.mapping)
    assert got.count() == bars.count() and got.where("symbol = 'S0' and w_beta_market is not null").count() > 0


def test_spread_of_four_weeks_has_values(spark):
    rows = [("A", dt.date(2020, 1, 3) + dt.timedelta(days=7 * i), float(i % 3)) for i in range(30)]
    got = ft.spread(spark.createDataFrame(rows, "symbol string, date date, x double"), "x", "p", (4, 12, 24)).orderBy("date").toPandas()
    x = pd.Series([r[2] for r in rows])
    assert np.allclose(got["p_cum_4"].dropna(), x.rolling(4, min_periods=3).sum().dropna())
    assert np.allclose(got["p_z_12"].dropna(), ((x - x.rolling(12, min_periods=10).mean()) / x.rolling(12, min_periods=10).std()).dropna())
    assert got["p_slope_4"].notna().sum() == 28 and got["p_slope_12"].notna().sum() == 25
