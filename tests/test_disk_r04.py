"""Columns that a pass makes are many; what changes hands lies before the pass."""

import datetime as dt
import io
from contextlib import redirect_stdout

import numpy as np


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def some_bars(spark, symbols, n=260):
    rng, rows = np.random.default_rng(4), []
    for s, many in symbols.items():
        close = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, many or n)))
        day = dt.date(1995, 1, 2)
        for c in close:
            day += dt.timedelta(days=int(rng.integers(1, 4)))
            rows.append((s, day, float(c * 1.001), float(c * 1.02), float(c * 0.98), float(c), float(c), float(rng.integers(1, 99))))
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, adjclose double, volume double")


def test_weekly_columns_are_not_dealt(spark):
    from tidemark.operators import panel as pn
    from tidemark.plans import daily as pl

    bars = some_bars(spark, {"A": 0, None: 0, "B": 20})
    got = pl.higher_time_frame(bars, ["trend", "rsi", "quiet_trend"])
    assert "Exchange" not in plan(got).split("InArrow")[0]
    weeks = pn.resample(bars)
    made = pl.feature_table(weeks, ["trend", "rsi", "quiet_trend"])
    few = weeks.groupBy("symbol").count().where("count < 30").select("symbol").collect()
    assert [r[0] for r in few] == ["B"]
    columns = [c for c in made.columns if c not in {"symbol", "date"}]
    want = pn.as_of(bars, made, columns, ["symbol"]).toDF(*bars.columns, *(f"w_{c}" for c in columns))
    assert got.dtypes == want.dtypes
    key = lambda t: t.toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)
    got, want = key(got), key(want)
    short = want["symbol"] == "B"
    simple = {"w_ma_10", "w_rsi_14", *(f"w_{c}" for c in weeks.columns)}
    want.loc[short, [f"w_{c}" for c in columns if f"w_{c}" not in simple]] = np.nan
    assert got.equals(want)
    assert got.loc[got["symbol"].isna(), "w_trend_score_granular"].notna().any() and got.loc[short, "w_open"].notna().any()


def driven(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from tidemark.operators import features as ft
    from tidemark.plans import cross_section as xs

    bars = some_bars(spark, {"A": 0, "B": 0, "C": 30})
    b = ft.returns(spark.createDataFrame(bars.collect(), bars.schema))
    bench = b.groupBy("date").agg(F.avg("close").alias("px")).withColumn("bench", F.lit("M"))
    bench = bench.withColumn("bench_ret", F.log("px") - F.lag(F.log("px")).over(Window.partitionBy("bench").orderBy("date"))).cache()
    sectors = spark.createDataFrame([("A", "x"), ("B", "x"), ("C", "y")], "symbol string, sector string")
    return b, xs.Sides(sectors, bench, {"market": "M"}, spark.createDataFrame([("A", "M"), ("B", "M")], "symbol string, bench string"))


def test_factors_join_inside_the_pass(spark):
    from tidemark.operators import factors as fc
    from tidemark.plans import cross_section as xs

    b, sides = driven(spark)
    got = xs.daily(b, sides)
    assert "Exchange" not in plan(got).split("InArrow")[0]
    want = fc.joint_factors(b.select("symbol", "date", "ret"), sides.bench, sides.roles, mapping=sides.mapping)
    names = [c for c in want.columns if c not in {"symbol", "date"}]
    rows = lambda t, cs: [tuple(r) for r in t.select("symbol", "date", *cs).orderBy("symbol", "date").collect()]
    assert rows(got, [f"joint_{c}" for c in names]) == rows(want, names)
    assert got.where("joint_beta_market is not null").count() > 0


def test_rows_beside_a_pass(spark):
    from tidemark.operators import kernels as kn

    day = lambda k: dt.date(2020, 1, k) if k else None
    rows = spark.createDataFrame([("A", day(2), 1.0), ("A", day(1), 2.0), ("A", day(0), 4.0), ("B", day(1), 8.0)], "symbol string, date date, x double")
    beside = spark.createDataFrame([("A", day(2), 7), ("A", day(0), 8), ("C", day(1), 9)], "symbol string, date date, y int")
    got = kn.grouped(rows, [(("x",), ("run",), lambda f: [f["x"].cumsum()])], beside).collect()
    assert sorted(got, key=str) == sorted([("A", None, 4.0, 4.0, None), ("A", day(1), 2.0, 6.0, None), ("A", day(2), 1.0, 7.0, 7), ("B", day(1), 8.0, 8.0, None)], key=str)


def test_few_columns_come_to_the_pass(spark):
    from tidemark.plans import cross_section as xs

    b, sides = driven(spark)
    assert xs.daily(b.select("symbol", "date", "close", "ret"), sides, ["combo_alpha", "xsec_mom_20d_z"]).count() == b.count()
    rows, _, _ = xs.registry(sides, base=b).before_pass(b.select("symbol", "date", "close", "ret"), ["combo_alpha", "xsec_mom_20d_z"])
    assert set(rows.columns) == {"symbol", "date", "close", "ret", "xsec_mom_20d_z", "market_ret", "match_ret"}
    order = [block.name for _, blocks in xs.registry(sides).plan(["momentum", "breadth", "alpha"], b.columns) for block in blocks]
    assert order.index("momentum") < order.index("breadth")  # what is joined by date is not dealt by date


def test_blocks_of_a_date_share_an_exchange(spark):
    from tidemark.plans import cross_section as xs

    b, sides = driven(spark)
    got = plan(xs.daily(b.select("symbol", "date", "close", "ret"), sides, ["momentum", "ranks", "volatility_context"]))
    assert got.count("Exchange hashpartitioning(date") == 2  # the calendar's and the table's


def test_weekly_driver_is_not_dealt_for_days(spark):
    from tidemark.plans import cross_section as xs

    b, sides = driven(spark)
    got = xs.weekly(b.drop("ret"), sides, ["alpha", "momentum"])
    assert "Exchange" not in plan(got).split("InArrow")[0] and got.count() == b.count()
