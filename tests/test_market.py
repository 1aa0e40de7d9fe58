"""Market blocks against pandas, mapping records, the sizing chain and weights per model on small fixtures."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import labels as lb
from tidemark.operators import mapping as mp
from tidemark.operators import sizing as sz
from tidemark.plans import market as mk


def days(n, start=dt.date(2020, 1, 1)):
    return [start + dt.timedelta(d) for d in range(n)]


@pytest.fixture(scope="module")
def prices():
    """90 days of the index, with gaps and a zero, of its second index and of three funds."""
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"date": days(90)} | {n: np.exp(rng.normal(0, 0.05, 90).cumsum()) * 20 for n in ("^VIX", "^VXN", "SPY", "GLD", "IEF")})
    frame.loc[[10, 11, 40], "^VIX"] = np.nan
    frame.loc[20, "^VIX"] = 0.0
    return frame


@pytest.fixture(scope="module")
def long(spark, prices):
    rows = prices.melt("date", var_name="symbol", value_name="close")
    return spark.createDataFrame([(r.symbol, r.date, None if pd.isna(r.close) else float(r.close)) for r in rows.itertuples()], "symbol string, date date, close double")


def by_date(df):
    return df.orderBy("date").toPandas().set_index("date")


def close(a, b):
    np.testing.assert_allclose(a.astype(float).to_numpy(), b.astype(float).to_numpy(), rtol=1e-9, atol=1e-9)


def test_gaps_are_carried_and_first_choice_wins(spark, prices, long):
    got = by_date(mk.carried(long, {"vix": ("VIX", "^VIX"), "bond": ("SHY", "IEF"), "none": ("XXX",)}))
    want = prices.set_index("date")["^VIX"]
    close(got["vix"], want.where(want > 0).ffill())
    close(got["bond"], prices.set_index("date")["IEF"])
    assert "none" not in got.columns
    assert mk.carried(long, {"none": ("XXX",)}).count() == 0


def test_volatility_block_equals_pandas(prices, long):
    got = by_date(mk.volatility_indices(mk.carried(long, mk.INDICES)))
    vix = prices.set_index("date")["^VIX"]
    vix, vxn = vix.where(vix > 0).ffill(), prices.set_index("date")["^VXN"]
    close(got["vix_ema10"], vix.ewm(span=10, min_periods=5).mean())
    close(got["vix_zscore_60d"], (vix - vix.rolling(60, min_periods=20).mean()) / vix.rolling(60, min_periods=20).std())
    close(got["vix_ma20_ratio"], vix / vix.rolling(20, min_periods=10).mean())
    close(got["vix_change_5d"], vix.pct_change(5, fill_method=None))
    close(got["vix_vxn_ratio"], vix / vxn)
    below = vix.rolling(252, min_periods=50).apply(lambda x: (x[-1] > x[:-1]).mean() * 100, raw=True)
    close(got["vix_percentile_252d"], below)


def test_weekly_block_is_carried_on_and_late(spark, prices, long):
    block = mk.volatility_indices(mk.weekly_last(mk.carried(long, mk.INDICES)), mk.WEEKLY)
    bars = spark.createDataFrame([("A", d, 1.0) for d in days(90)], "symbol string, date date, close double")
    got = by_date(mk.attached(bars, block, 1, True, "w_"))
    vix = prices.set_index(pd.DatetimeIndex(prices["date"]))["^VIX"]
    weekly = vix.where(vix > 0).ffill().resample("W-FRI").last()
    want = weekly.reindex(vix.index, method="ffill").shift(1)
    close(got["w_vix_level"], want)
    close(got["w_vix_ema4"], weekly.ewm(span=4, min_periods=2).mean().reindex(vix.index, method="ffill").shift(1))


def test_fund_equals_pandas(prices, long):
    got = by_date(mk.volatility_fund(mk.carried(long, {"vxx": ("GLD",)})))
    px = prices.set_index("date")["GLD"]
    step = px.diff()
    gain, loss = step.where(step > 0, 0.0).rolling(14, min_periods=7).mean(), (-step.where(step < 0, 0.0)).rolling(14, min_periods=7).mean()
    close(got["vxx_rsi_14"], 100 - 100 / (1 + gain / loss))
    close(got["vxx_ret_20d"], px.pct_change(20, fill_method=None))


def test_cross_assets_leave_out_what_lacks_a_role(prices, long):
    table = mk.carried(long, mk.ROLES)
    got = by_date(mk.cross_assets(table))
    assert list(got.columns) == ["symbol", "gold_spy_ratio", "gold_spy_ratio_zscore"]
    close(got["gold_spy_ratio"], prices.set_index("date")["GLD"] / prices.set_index("date")["SPY"])
    assert mk.cross_assets(table.drop("gold")).columns == ["symbol", "date"]


def test_published_series_come_late(spark):
    values = [float(x) for x in np.random.default_rng(2).normal(0, 1, 70)]
    table = spark.createDataFrame([("ALL", d, v) for d, v in zip(days(70), values)], "symbol string, date date, icsa double")
    got = by_date(mk.published(table, later=1))
    x = pd.Series(values, index=days(70))
    close(got["fred_icsa"], x.shift(6))
    close(got["fred_icsa_chg4w"], x.diff(20).shift(6))
    close(got["fred_icsa_z52w"], ((x - x.rolling(252, min_periods=60).mean()) / x.rolling(252, min_periods=60).std()).shift(6))
    assert "fred_dgs10" not in got.columns


def test_columns_that_are_there_stay(spark, long):
    bars = spark.createDataFrame([("A", d, 7.0) for d in days(30)], "symbol string, date date, vix_level double")
    got = mk.attached(bars, mk.volatility_indices(mk.carried(long, mk.INDICES)), 1)
    assert {r[0] for r in got.select("vix_level").distinct().collect()} == {7.0}
    assert "vix_ema10" in got.columns
    assert mk.attached(bars, bars.select("symbol", "date", "vix_level")) is bars


def test_market_table_has_all_blocks(spark, long):
    series = spark.createDataFrame([(d, 1.0 * i) for i, d in enumerate(days(90))], "date date, nfci double")
    got = mk.market_table(long, series)
    assert {"vix_level", "w_vix_level", "gold_spy_ratio", "w_gold_spy_ratio", "fred_nfci", "w_fred_nfci"} <= set(got.columns)
    assert got.count() == long.count()


# mapping


def test_record_confidence_and_reports(spark):
    universe = spark.createDataFrame([("A", "Tech", 5.0), ("B", "tech", None), ("C", "odd", 1.0), ("D", None, 1.0), ("E", "Tech", 2.0)], "symbol string, sector string, market_cap double")
    bench = spark.createDataFrame([("TECH", "XLK")], "sector string, bench string")
    equal = spark.createDataFrame([("XLK", "RYT"), ("SPY", "RSP")], "bench string, equal_bench string")
    subs = spark.createDataFrame([("A", "SMH"), ("E", "SMH"), ("C", None)], "symbol string, subsector string")
    corr = spark.createDataFrame([("A", "XLK", 0.7), ("A", "SMH", 0.8), ("A", "SPY", 0.5), ("B", "XLK", 0.65), ("C", "SPY", 0.45), ("E", "XLK", 0.7), ("E", "SMH", 0.72), ("E", "SPY", 0.9), ("E", "RYT", 0.1)], "symbol string, bench string, corr double")
    rec = mp.record(universe, bench, equal, subs, corr)
    got = {r["symbol"]: r for r in rec.collect()}
    assert set(got) == {"A", "B", "C", "E"}
    assert {k: r["confidence"] for k, r in got.items()} == {"A": "high", "B": "high", "C": "medium", "E": "medium"}
    assert got["C"]["sector_etf"] == "SPY" and got["C"]["equal_weight_etf"] == "RSP" and got["C"]["correlations"]["sector"] == 0.45
    assert got["B"]["market_cap"] == 0.0 and got["B"]["correlations"]["market"] is None and got["E"]["correlations"]["sector_ew"] == 0.1
    one = mp.report(rec).first()
    assert (one["n_symbols"], one["n_high"], one["n_medium"], one["n_low"]) == (4, 2, 2, 0)
    assert abs(one["subsector_coverage"] - 0.5) < 1e-12 and one["equal_weight_coverage"] == 1.0
    assert [r["symbol"] for r in mp.improvements(rec).collect()] == ["A"]
    assert [r["symbol"] for r in mp.reviews(rec).collect()] == ["E"]
    assert {r[0] for r in mp.required(rec).collect()} == {"SPY", "XLK", "SMH"}


def test_record_of_empty_tables(spark):
    empty = lambda s: spark.createDataFrame([], s)
    rec = mp.record(empty("symbol string, sector string, market_cap double"), empty("sector string, bench string"), empty("bench string, equal_bench string"), empty("symbol string, subsector string"), empty("symbol string, bench string, corr double"))
    assert rec.count() == 0 and mp.report(rec).first()["n_symbols"] == 0


# sizing


@pytest.fixture(scope="module")
def sizing_rows(spark):
    signals = spark.createDataFrame([("A", dt.date(2020, 1, 6), 0.4), ("B", dt.date(2020, 1, 6), 0.55), ("C", dt.date(2020, 1, 6), 0.0), ("A", dt.date(2020, 1, 13), 0.9)], "symbol string, signal_date date, probability double")
    features = spark.createDataFrame([("A", dt.date(2020, 1, 6), 1.0, 3.0, 1), ("B", dt.date(2020, 1, 6), 5.0, 3.0, -1), ("A", dt.date(2020, 1, 13), 100.0, 4.0, 0)], "symbol string, date date, atr_pct double, rsi_14 double, trend_score_sign int")
    return signals, features


def test_transform_takes_training_state_only(spark, sizing_rows, tmp_path):
    signals, features = sizing_rows
    names = ["atr_pct", "rsi_14", "beta_market"]
    state = sz.fit(signals.where("signal_date < date '2020-01-10'"), features, names)
    state.write.parquet(str(tmp_path / "state"))
    state = spark.read.parquet(str(tmp_path / "state"))
    assert {r["feature"] for r in state.collect()} == {"atr_pct", "rsi_14"}
    got = {(r["symbol"], r["signal_date"].day): r for r in sz.transform(signals, state, features, names).collect()}
    # bounds are 1.04 and 4.96; a later 100 is cut at the upper one
    low, high = 1.04, 4.96
    dev = np.std([low, high], ddof=1)
    assert abs(got["A", 6]["atr_pct"] - (low - 3) / dev) < 1e-9
    assert abs(got["A", 13]["atr_pct"] - (high - 3) / dev) < 1e-9
    # no features on that day, and a feature that never changed
    assert got["C", 6]["atr_pct"] is None
    assert got["A", 6]["rsi_14"] == 0.0


def test_clashing_columns_missing_features_and_one_call(spark, sizing_rows):
    signals, features = sizing_rows
    clash = signals.withColumn("rsi_14", F.lit(9.0))
    assert sz.merged(clash, features, ["rsi_14"]).columns[-2:] == ["rsi_14", "rsi_14_feat"]
    assert sz.transform(signals, sz.fit(signals, names=["nothing"]), names=["nothing"]).columns == signals.columns
    assert sz.sizing_features(signals, features, ["atr_pct"]).count() == 4
    assert sz.fit(signals.limit(0), features, ["atr_pct"]).count() <= 1


def test_measures_and_regimes(spark, sizing_rows):
    signals, features = sizing_rows
    rows = sz.merged(signals, features, ["atr_pct", "trend_score_sign"])
    series = spark.createDataFrame([(dt.date(2020, 1, 6), 2)], "date date, vix_regime int")
    got = {(r["symbol"], r["signal_date"].day): r for r in sz.with_measures(sz.regimes(rows, series, "signal_date")).collect()}
    assert got["A", 6]["volatility"] == 1.0 and got["A", 6]["liquidity"] == 1.0
    assert [got[k]["confidence_regime"] for k in (("A", 6), ("B", 6), ("C", 6), ("A", 13))] == ["very_low", "medium", None, "very_high"]
    assert [got[k]["trend_regime"] for k in (("A", 6), ("B", 6), ("C", 6), ("A", 13))] == ["bullish", "bearish", None, "neutral"]
    assert got["A", 6]["vix_regime"] == 2 and got["A", 13]["vix_regime"] is None
    assert sz.with_measures(signals).first()["volatility"] == 0.02


# weights per model


def test_weights_per_model_by_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = []
    for s, n in (("A", 60), ("B", 40), ("short", 20)):
        px = 50 * np.exp(rng.normal(0, 0.02, n).cumsum())
        rows += [(s, d, float(p * 1.01), float(p * 0.99), float(p), 1.0) for d, p in zip(days(n), px)]
    bars = spark.createDataFrame(rows, "symbol string, date date, high double, low double, close double, atr double")
    models = {"even": (1.0, 1.0), "long": (2.0, 1.0)}
    got = lb.model_weights(bars, models, 5).toPandas()
    assert set(got["symbol"]) == {"A", "B"}
    seen = lb.multi_touch(bars, models, 5).toPandas()
    for model in models:
        mine = got[got["model"] == model].sort_values(["symbol", "date"]).reset_index(drop=True)
        labels = seen[seen["symbol"] != "short"].sort_values(["symbol", "date"]).reset_index(drop=True)
        k = labels.groupby("symbol").cumcount()
        end = k + labels[f"h_used_{model}"]
        n = [sum((labels["symbol"] == labels["symbol"][i]) & (k <= end[i]) & (end >= k[i])) - 1 for i in range(len(labels))]
        assert mine["n_overlapping"].tolist() == n
        hit = labels[f"hit_{model}"]
        assert mine["hit"].tolist() == hit.tolist()
        w = (len(hit) / (hit.nunique() * hit.map(hit.value_counts())) / (np.array(n) + 0.5)).clip(0.01, 10)
        np.testing.assert_allclose(mine["weight_final"], (w / w.mean()).clip(0.01, 10), rtol=1e-9)
