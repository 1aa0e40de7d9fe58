"""Blocks of a pass in arrays, against the same blocks as window functions."""

import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import windows as wn
from tidemark.operators import features as ft
from tidemark.operators import frames as fr
from tidemark.plans import daily as pl

SCHEMA = "symbol string, date date, open double, high double, low double, close double, adjclose double, volume double"


@pytest.fixture(scope="module")
def bars(spark):
    """A walk, one with gaps, one that stands still for long, one of three rows, and one of a few cents after thousands."""
    rng = np.random.default_rng(4)
    rows = []
    for s, n in (("walk", 320), ("gaps", 320), ("still", 150), ("short", 3), ("fell", 200)):
        close = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        if s == "still":
            close[40:] = 7.1
        if s == "fell":
            close[:60] *= 1e5
        for i in range(n):
            o = close[i] * (1 if s == "still" and i > 40 else 1 + rng.normal(0, 0.005))
            values = [o, max(o, close[i]) * 1.01, min(o, close[i]) * 0.99, close[i], close[i], float(rng.integers(0, 90))]
            if s == "gaps":
                values = [None if rng.random() < 0.1 else v for v in values]
            rows.append((s, dt.date(2022, 1, 3) + dt.timedelta(days=i), *(None if v is None else float(v) for v in values)))
    return spark.createDataFrame(rows, SCHEMA).cache()


MADE = {
    "trend_windows": ft.trend,
    "choppiness": ft.choppiness,
    "volatility_windows": lambda t: ft.volatility(ft.returns(t)),
    "bollinger": ft.bollinger,
    "distance": ft.distance,
    "range_windows": ft.range_breakout,
    "volume": ft.volume,
    "liquidity": ft.liquidity,
    "drawdown": ft.drawdown,
}


@pytest.mark.parametrize("name", sorted(MADE))
def test_against_window_functions(bars, name):
    makes = pl.standard().blocks[name].makes
    # windows of running sums keep a rest of the large values, so that symbol is left out where they are compared
    rows = bars if name in {"bollinger", "choppiness", "liquidity", "volume", "range_windows"} else bars.where("symbol <> 'fell'")
    got = pl.feature_table(rows, [name]).orderBy("symbol", "date").collect()
    want = MADE[name](rows).select("symbol", "date", *(F.col(c).cast("double") for c in makes)).orderBy("symbol", "date").collect()
    for c in makes:
        for a, b in zip(got, want, strict=True):
            assert a[c] == (None if b[c] is None else pytest.approx(b[c], rel=1e-6, abs=1e-7)), (c, a.symbol, a.date)


def test_all_blocks_are_one_pass_without_sliding_frames(bars):
    plan = pl.feature_table(bars)._jdf.queryExecution().executedPlan().toString()
    assert "RowFrame, -59" not in plan and "RowFrame, -19" not in plan and plan.count("+- Window") <= 1


def test_nothing_is_left_of_what_lies_before_a_frame():
    x = np.concatenate([np.full(50, 1e9), np.arange(50) % 4 * 1e-4])
    assert fr.std(x, 8, 8)[-1] == pytest.approx(np.std(x[-8:]), rel=1e-9)
    assert np.isnan(fr.zscore(np.full(40, 0.1), 20)).all()


def test_frames_in_stretches(monkeypatch):
    rng = np.random.default_rng(6)
    x = np.where(rng.random(300) < 0.2, np.nan, rng.normal(size=300))
    y = rng.normal(size=300)
    whole = [*fr.moments(x, 20), *fr.moments(x, 20, y), fr.high(x, 20), fr.total(x, 20, 5)]
    monkeypatch.setattr(fr, "HELD", 100)
    for a, b in zip(whole, [*fr.moments(x, 20), *fr.moments(x, 20, y), fr.high(x, 20), fr.total(x, 20, 5)], strict=True):
        assert np.allclose(a, b, equal_nan=True)


def test_covariance_of_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [("A", dt.date(2022, 1, 1) + dt.timedelta(days=i), *(None if rng.random() < 0.2 else float(v) for v in rng.normal(size=2))) for i in range(80)]
    table = spark.createDataFrame(rows, "symbol string, date date, y double, x double")
    frame = wn.rows(20)
    want = table.withColumns({"c": F.covar_samp("y", "x").over(frame)}).orderBy("date").collect()
    x, y = (np.array([np.nan if r[c] is None else r[c] for r in want]) for c in ("x", "y"))
    n, product, _ = fr.moments(x, 20, y)
    for r, k, p in zip(want, n, product, strict=True):
        if k > 1:
            assert p / (k - 1) == pytest.approx(r["c"], rel=1e-9)


def test_driver_blocks_against_window_functions(spark, bars):
    from tidemark.operators import panel as pn
    from tidemark.plans import cross_section as xs

    made = spark.sparkContext.accumulator(0)

    def look(frames):
        for f in frames:
            made.add(len(f))
            yield f

    # symbols whose returns stand still have no beta but for rounding
    plain = ft.returns(bars.where("symbol in ('walk', 'gaps', 'short')")).cache()
    bench = plain.groupBy("date").agg(F.avg("close").alias("px")).withColumn("bench", F.lit("M"))
    bench = bench.withColumn("bench_ret", F.log("px") - F.log(F.lag("px").over(wn.Window.partitionBy("bench").orderBy("date")))).cache()
    sectors = spark.createDataFrame([(s, "x") for s in ("walk", "gaps", "short")], "symbol string, sector string")
    mapping = spark.createDataFrame([("walk", "M")], "symbol string, bench string")
    sides = xs.Sides(sectors, bench, {"market": "M"}, mapping)
    names = ["market_beta", "market_alpha", "market_mom_20", "market_mom_20_ema10", "rs_market", "rs_market_norm", "rs_market_z20", "rs_market_slope10"]
    got = xs.daily(plain, sides, ["alpha", "strength"]).orderBy("symbol", "date").collect()
    t = pn.with_benchmark(plain, bench, "M", {"bench_ret": "market_ret", "px": "market_px"})
    t = pn.alpha_momentum(pn.beta_alpha(t, "ret", "market_ret", 60, "market_", 20), "market_alpha", "market_mom", (20,))
    t = pn.relative_strength(t, "close", "market_px", "rs_market").withColumn("__log", F.when(F.col("rs_market") > 0, F.log("rs_market")))
    t = ft.regularised_slope(t, "__log", 10, "rs_market_slope10")
    want = t.orderBy("symbol", "date").toPandas()
    want["market_mom_20_ema10"] = want.groupby("symbol")["market_mom_20"].transform(lambda x: x.ewm(span=10, adjust=False).mean())
    for c in names:
        x = np.array([np.nan if r[c] is None else r[c] for r in got])
        assert np.isfinite(x).any() and np.allclose(x, want[c].astype(float), rtol=1e-6, atol=1e-8, equal_nan=True), c
    # calendars and breadth come from the bars, not from a table whose blocks are made anew for each of them
    xs.registry(sides, base=plain).blocks["momentum"].run(plain.mapInPandas(look, plain.schema).withColumn("sector", F.lit("x"))).count()
    assert made.value == plain.count()


def test_dates_come_before_wide_passes(spark, bars):
    from tidemark.plans import cross_section as xs
    from tidemark.plans.registry import DATE, PASS

    sides = xs.Sides(spark.createDataFrame([("walk", "x")], "symbol string, sector string"), bars, {"market": "M"})
    kinds = [kind for kind, _ in xs.registry(sides).plan(["alpha", "strength", "volatility_context", "breadth", "momentum", "ranks"], ["symbol", "date", "close", "ret"])]
    assert kinds[-1] == PASS and kinds.count(PASS) == 1 and DATE in kinds


@pytest.mark.parametrize("name", ["residual_block", "sizing_chain", "best_match_spread", "weekly_joint_factors"])
def test_shared_rows_are_held(spark, small, name):
    from tidemark.queries import QUERIES

    assert re.search(r"InMemoryTableScan \[symbol#\d+, (?!bench)", QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString())
