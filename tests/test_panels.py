"""Composed sources, parameter tables, and small operators around models and portfolios."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation as ev
from tidemark.operators import panel as pn
from tidemark.operators import portfolio as pf
from tidemark.operators import quality as ql
from tidemark.operators import selection as sl
from tidemark.sources import bars as src
from tidemark.sources import panels as sp

SCHEMA = "symbol string, date date, open double, high double, low double, close double, adjclose double, volume double"


def made(spark, sizes):
    start = dt.date(2020, 1, 6)
    return spark.createDataFrame([(s, start + dt.timedelta(d), p, p, p, p, p, 1.0) for s, n, p in sizes for d in range(n)], SCHEMA)


@pytest.fixture(scope="module")
def bars(spark):
    return made(spark, [("AAA", 100, 10.0), ("BBB", 100, 20.0), ("TINY", 20, 5.0), ("XLK", 100, 30.0), ("BAD", 100, 1e6)])


def test_stock_panel_of_a_universe(spark, bars, tmp_path):
    (tmp_path / "u.csv").write_text("Symbol,Description,Sector\nAAA,alpha,Tech\nBAD,odd,Tech\nBBB,beta,\nZZZ,absent,Tech\nCCC.WS,warrant,Tech\n")
    src.write_bars_long(bars, str(tmp_path / "bars"))
    paths, universe = [str(tmp_path / "gone"), str(tmp_path / "bars")], str(tmp_path / "u.csv")
    symbols = lambda t: {r[0] for r in t.select("symbol").distinct().collect()}
    assert symbols(sp.stock_panel(spark, paths, universe)) == {"AAA", "BBB"}
    assert symbols(sp.stock_panel(spark, paths, universe, most=1)) == {"AAA"}
    named = sp.stock_panel(spark, paths, universe, sectors=True)
    assert symbols(named) == {"AAA"} and {r[0] for r in named.select("sector").distinct().collect()} == {"Tech"}
    with pytest.raises(FileNotFoundError):
        sp.stock_panel(spark, [str(tmp_path / "gone")], universe)


def test_weekly_panel_and_its_benchmarks(spark, bars):
    weekly = sp.weekly_panel(bars, symbols=["AAA", "TINY"])
    assert {r["symbol"] for r in weekly.collect()} == {"AAA"}
    whole = sp.with_benchmarks(weekly, bars, ["XLK", "AAA", "NONE"])
    counts = {r["symbol"]: r["count"] for r in whole.groupBy("symbol").count().collect()}
    assert counts["AAA"] == weekly.count() and set(counts) == {"AAA", "XLK"}
    # a weekly table is taken as it is
    assert sp.weekly_panel(bars, weekly).count() == weekly.count()
    assert sp.weekly_panel(None, weekly.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sp.weekly_panel(None)


def test_prepared_bars(spark, bars):
    stocks, funds = bars.where("symbol = 'AAA'").drop("volume"), made(spark, [("AAA", 3, 1.0), ("XLK", 3, 2.0)])
    got = sp.prepared(stocks, funds)
    assert {r["symbol"]: r["count"] for r in got.groupBy("symbol").count().collect()} == {"AAA": 100, "XLK": 3}
    assert "volume" in got.columns
    assert sp.prepared(stocks, funds, ["XLK"]).count() == 3


def test_parameters_round_trip(spark, tmp_path):
    path = str(tmp_path / "p")
    one = spark.createDataFrame([("long", 2.5, None)], "model string, multiple double, note string").withColumn("more", F.struct(F.lit(1).alias("a")))
    sp.write_parameters(one, path, "thresholds", "2020-01-01")
    sp.write_parameters(one.withColumn("multiple", F.lit(3.0)), path, "thresholds", "2020-01-08")
    assert sp.read_parameters(spark, path, "thresholds").first()["multiple"] == 3.0
    old = sp.read_parameters(spark, path, "thresholds", "2020-01-01").first()
    assert old["multiple"] == 2.5 and old["more"]["a"] == 1 and old["note"] is None
    assert spark.read.json(f"{path}/thresholds/json/2020-01-08").first()["multiple"] == 3.0


def test_composite_score_weighs_and_bounds(spark):
    folds = spark.createDataFrame([("m", 0.6, 0.4, 0.2, 0.7, 0.3), ("m", 0.8, 0.6, 0.2, 0.9, 0.1), ("flat", 0.5, 0.5, 0.25, 0.5, 0.5)], "model string, auc double, aupr double, brier double, top double, bottom double")
    got = {r["model"]: r for r in sl.composite_score(folds, ["model"]).collect()}
    stable = max(0.0, min(1.0, 1 - 5 * 0.1 / (0.7 + 1e-8)))
    assert abs(got["m"]["score"] - (0.2 * 0.7 + 0.15 * 0.5 + 0.15 * 0.2 + 0.2 * 0.8 + 0.1 * 0.6 + 0.2 * stable)) < 1e-9
    assert got["flat"]["stability"] == 1.0
    assert sl.composite_score(folds, ["model"], {"auc": 1.0}).where("model = 'flat'").first()["score"] == 0.5


def test_feature_sets_and_heads(spark):
    selected = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "x"), ("c", "odd")], "model string, feature string")
    known = spark.createDataFrame([("x",), ("y",), ("y",)], "feature string")
    got = {r["model"]: tuple(r)[1:] for r in sl.feature_sets(selected, known).collect()}
    assert got == {"a": (3, 2, 1, 0, False), "b": (1, 1, 0, 0, True), "c": (1, 1, 0, 1, False)}
    rows = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, 4.0)], "x double, y double")
    heads = {r["model"]: tuple(r)[1:] for r in sl.head_status(rows, selected).collect()}
    assert heads == {"a": (2, 0, 1), "b": (1, 0, 0), "c": (0, 1, 0)}
    assert sl.head_status(rows, selected.where("model = 'c'")).first()["n_missing"] == 1


def test_reward_by_risk_has_a_floor(spark):
    rows = spark.createDataFrame([(100.0, 110.0, 95.0), (100.0, 110.0, 100.0), (100.0, 110.0, 120.0), (0.0, 1.0, 1.0), (100.0, 110.0, None)], "entry_price double, target_price double, stop_price double")
    got = [r["reward_risk"] for r in sl.signal_levels(rows).collect()]
    assert [None if x is None else round(x, 6) for x in got] == [2.0, 100.0, 100.0, None, None]


def test_turnover_by_symbol_sums_to_turnover(spark):
    w = spark.createDataFrame([(dt.date(2020, 1, 6), "A", 0.5), (dt.date(2020, 1, 6), "B", 0.5), (dt.date(2020, 1, 13), "A", 0.7), (dt.date(2020, 1, 13), "C", 0.3)], "week date, symbol string, weight double")
    got = {(r["week"].day, r["symbol"]): round(r["change"], 9) for r in pf.turnover_by_symbol(w).collect()}
    assert got == {(6, "A"): 0.5, (6, "B"): 0.5, (13, "A"): 0.2, (13, "B"): 0.5, (13, "C"): 0.3}
    whole = {r["week"].day: r["turnover"] for r in pf.turnover(w).collect()}
    assert abs(whole[13] - 0.5) < 1e-9


def test_regimes_with_few_rows_are_left_out(spark):
    rows = spark.createDataFrame([("big", i / 20, i % 2) for i in range(11)] + [("small", 0.1, 1)] * 10, "regime string, p double, y int")
    assert [(r["regime"], r["n"]) for r in ev.by_regime(rows, "regime").collect()] == [("big", 11)]
    assert ev.by_regime(rows.where("regime = 'small'"), "regime").count() == 0


def test_fold_info_counts_what_was_purged(spark):
    d = lambda k: dt.date(2020, 1, k)
    rows = spark.createDataFrame([(d(1), d(2)), (d(2), d(9)), (d(3), d(4)), (d(8), d(9)), (d(8), d(10))], "entry date, exit date")
    folds = rows.where("entry < date '2020-01-08' and exit < date '2020-01-08'").withColumn("role", F.lit("train")).unionByName(rows.where("entry >= date '2020-01-08'").withColumn("role", F.lit("test"))).withColumn("fold", F.lit(0))
    one = ev.fold_info(rows, folds).first()
    assert (one["n_train_original"], one["n_train"], one["n_purged"], one["n_test"], one["has_leakage"]) == (3, 2, 1, 2, False)
    leaky = rows.withColumns({"fold": F.lit(0), "role": F.when(F.col("entry") < d(8), "train").otherwise("test")})
    assert ev.fold_info(rows, leaky).first()["has_leakage"]


def test_names_and_lags(spark):
    assert pn.classified(["symbol", "date", "ret", "rsi_14", "w_rsi_14", "other", "ATR14", "gold_zscore", "vol_regime"]) == (["ret", "rsi_14", "ATR14", "gold_zscore"], ["w_rsi_14"])
    rows = spark.createDataFrame([("A", dt.date(2020, 1, 6) + dt.timedelta(k), float(k), float(k)) for k in range(10)], "symbol string, date date, ret double, w_x double")
    got = pn.lags_by_name(rows, [2], [1]).orderBy("date").collect()
    assert [r["ret_lag2d"] for r in got][:4] == [None, None, 0.0, 1.0]
    # weeks end on Fridays: the sixth row begins the second
    assert [r["w_x_lag1w"] for r in got] == [None] * 5 + [4.0] * 5
    assert pn.lags_by_name(rows.drop("w_x"), [1], [1]).columns[-1] == "ret_lag1d"


def test_returns_are_asked_for(spark):
    rows = spark.createDataFrame([(1.0, "a")], "ret double, name string")
    assert ql.require_returns(rows) is rows
    with pytest.raises(ValueError):
        ql.require_returns(rows, "gone")
    with pytest.raises(TypeError):
        ql.require_returns(rows, "name")


def test_nulls_and_constants_of_the_chain(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (3.0, 2.0), (100.0, 2.0)], "x double, same double")
    cut = [r["x_w"] for r in ev.winsorise(rows, ["x"], 0.0, 0.5).collect()]
    assert cut == [1.0, None, 3.0, 3.0]
    scored = ev.standardise(rows, ["x", "same"], 1.0).collect()
    assert [r["x_z"] is None for r in scored] == [False, True, False, False] and scored[3]["x_z"] == 1.0
    assert all(r["same_z"] is None for r in scored)
