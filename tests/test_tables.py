"""Small cases of tables, filters, running sums and folds."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import windows as wn
from tidemark.operators import evaluation as ev
from tidemark.operators import labels as lb
from tidemark.operators import quality as ql
from tidemark.operators import tables as tb
from tidemark.operators import training as tr


def test_untradeable(spark):
    rows = [("ABC", "plain shares", 1), ("ACIW", "plain", 1), ("ABCDF", "five letters", 1), ("X.W", "", 0), ("X-WS", "", 0), ("X/U", "", 0), ("X.R", "", 0), ("BAC.PRA", "", 0), ("BAC-P", "", 0), ("Q.F", "", 0), ("A", "Some Acquisition Company", 0), ("B", "An American Depositary thing", 0), ("C", "ads-x", 0), ("D", "blank check co", 0), ("E", "GE Aerospace Acquisitions", 1), ("F", None, 1)]
    df = spark.createDataFrame(rows, "symbol string, description string, good int")
    assert {r.symbol for r in ql.tradeable(df).collect()} == {s for s, _, g in rows if g}
    assert ql.tradeable(df.limit(0)).count() == 0


def test_adjusted(spark):
    df = spark.createDataFrame([(2.0, 4.0, 1.0, 2.0, 1.0, 7.0), (2.0, 4.0, 1.0, 0.0, 1.0, 7.0), (2.0, 4.0, 1.0, 2.0, None, 7.0)], "open double, high double, low double, close double, adjclose double, volume double")
    got = [(r.open, r.high, r.low, r.close, r.volume) for r in tb.adjusted(df).collect()]
    assert got == [(1.0, 2.0, 0.5, 1.0, 7.0), (2.0, 4.0, 1.0, 0.0, 7.0), (2.0, 4.0, 1.0, 2.0, 7.0)]
    assert tb.assembled(df.drop("open")).columns[-1] == "open"


def test_running(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(5, 2, 400)
    x[rng.random(400) < 0.1] = np.nan
    x[200:300] = 0.0
    frame = pd.DataFrame({"symbol": "A", "date": pd.date_range("2020-01-01", periods=400), "x": x})
    df = spark.createDataFrame([("A", d.date(), None if np.isnan(v) else float(v)) for d, v in zip(frame["date"], x, strict=True)], "symbol string, date date, x double")
    got = wn.running(df, "x", {"m": ("mean", 60, 20), "d": ("dev", 60, 20), "z": ("z", 60, 20)}).orderBy("date").toPandas()
    roll = frame["x"].rolling(60, min_periods=20)
    want_d = roll.std(ddof=0)
    np.testing.assert_allclose(got["m"].astype(float), roll.mean(), atol=1e-9)
    np.testing.assert_allclose(got["d"].astype(float), want_d, atol=1e-6)
    z = ((frame["x"] - roll.mean()) / want_d).where(want_d > 1e-9)
    np.testing.assert_allclose(got["z"].astype(float), z, atol=1e-6)
    assert got["z"][285:300].isna().all()


def _bars(spark, rows):
    return spark.createDataFrame([("A", d.date(), c, h, low, 1.0) for d, (c, h, low) in zip(pd.date_range("2020-01-01", periods=len(rows)), rows, strict=True)], "symbol string, date date, close double, high double, low double, atr double")


def test_critical_multiple_knows_the_stop(spark):
    # the entry sees +2, then its stop, then +9: only +2 counts
    rows = [(10.0, 10.0, 10.0), (11.0, 12.0, 10.5), (9.0, 11.0, 8.0), (19.0, 19.0, 9.0)]
    got = lb.before_stop(_bars(spark, rows), 1.5, 3).orderBy("date").first()
    assert got.critical == 2.0
    # the first bar already stops it out
    got = lb.before_stop(_bars(spark, [(10.0, 10.0, 10.0), (9.0, 30.0, 8.0)]), 1.5, 3).orderBy("date").first()
    assert got.critical == 0.0


def test_numbered_and_folds(spark):
    days = pd.date_range("2020-01-06", periods=40)
    rows = spark.createDataFrame([(f"S{k}", d.date(), (d + pd.Timedelta(days=3)).date(), k % 2) for d in days for k in range(5)], "symbol string, entry date, exit date, hit int")
    got = [(r["__i"], r.entry, r.symbol) for r in ev.numbered(rows, "entry", "symbol").orderBy("__i").collect()]
    assert [i for i, _, _ in got] == list(range(200)) and got == sorted(got, key=lambda x: (x[1], x[2]))
    f = tr.row_folds(rows, 3, 20).toPandas()
    for _, part in f.groupby("fold"):
        test, train = part[part["role"] == "test"], part[part["role"] == "train"]
        assert len(test) == 50 and (train["exit"] <= test["entry"].min()).all() and (train["entry"] <= test["entry"].min()).all()
    assert tr.row_folds(rows.limit(0), 3, 20).count() == 0
    w = ev.walk_forward(rows, 2, 2).toPandas()
    for _, part in w.groupby("fold"):
        assert (part[part["role"] == "train"]["exit"] < part[part["role"] == "test"]["entry"].min()).all()
    assert set(w[w["role"] == "test"].groupby("fold")["week"].nunique()) <= {1, 2}


def test_calibration(spark):
    rng = np.random.default_rng(2)
    p = rng.random(2000)
    df = spark.createDataFrame([(k, float(v), int(rng.random() < v * v)) for k, v in enumerate(p)], "id long, p double, y int")
    for method in ("isotonic", "platt"):
        got = tr.calibrated(df, df, method).toPandas()
        assert len(got) == 2000 and abs(got["calibrated"].mean() - got["y"].mean()) < 0.02
        assert ((got["calibrated"] - got["y"]) ** 2).mean() < ((got["p"] - got["y"]) ** 2).mean()


def test_sample_weights_sum_to_rows(spark):
    df = spark.createDataFrame([(1.0,), (0.001,), (None,), (3.0,)], "x double")
    for scheme in ("uniform", "overlap", "liquidity", "inverse_volatility", "atr_percent"):
        assert abs(tr.sample_weights(df, scheme, None if scheme == "uniform" else "x").agg(F.sum("weight")).first()[0] - 4) < 1e-9


def test_stored_state(spark):
    df = spark.createDataFrame([(float(v),) for v in range(100)], "x double")
    state = tr.fitted_state(df, ["x"])
    a = tr.apply_state(df, state, ["x"]).orderBy("x").toPandas()["x_wz"]
    b = tr.standard_chain(df, ["x"]).orderBy("x").toPandas()["x_wz"]
    np.testing.assert_allclose(a, b, atol=1e-9)


def test_ties_of_caches_go_by_the_whole_name(spark):
    t = lambda n, x: spark.createDataFrame([("A", n, x)], "symbol string, loaded int, x int")
    got = tb.newest({"stocks_b": t(2, 1), "stocks_a": t(2, 2), "stocks_c": t(1, 3)}).collect()
    assert [(r.x, r.source) for r in got] == [(2, "stocks_a")]


def test_casts_keep_what_does_not_fit(spark):
    t = spark.createDataFrame([(1, 5_000_000_000, 0.5, None), (2, 7, 1.5, None)], "a long, b long, c double, d long")
    got = tb.downcast(t)
    assert dict(got.dtypes) == {"a": "int", "b": "bigint", "c": "float", "d": "int"}
    assert sorted(tuple(r) for r in got.collect()) == [(1, 5_000_000_000, 0.5, None), (2, 7, 1.5, None)]


def test_rankings_and_predictions(spark, tmp_path):
    from tidemark.sources import bars as src

    ranked = spark.createDataFrame([(f"S{i}", i + 1, 1 - i / 100) for i in range(50)], "symbol string, rank int, prob double").repartition(4)
    src.write_rankings(ranked, str(tmp_path), "2024-01-05")
    for name in ("2024-01-05", "latest"):
        got = src.read_predictions(spark, str(tmp_path), name)
        assert got.columns == ["symbol", "rank", "probability"] and got.count() == 50
        csv = spark.read.option("header", True).csv(str(tmp_path / "rankings" / name))
        assert csv.count() == 50 and csv.columns == ["symbol", "rank", "prob"]


def test_small_counts_bytes(spark):
    from tidemark.operators.panel import small

    t = spark.range(1000).selectExpr("id", "id as b")
    hinted = lambda x: "broadcast" in x._jdf.queryExecution().analyzed().toString().lower() or "ResolvedHint" in x._jdf.queryExecution().analyzed().toString()
    assert hinted(small(t, 16_000)) and not hinted(small(t, 15_000))


def test_both_sides_of_entries(spark):
    rng = np.random.default_rng(9)
    x = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, 70)))
    f = pd.DataFrame({"symbol": "A", "date": pd.date_range("2023-01-02", periods=70).date, "high": x * 1.01, "low": x * 0.99, "close": x, "atr": np.where(np.arange(70) % 11 == 4, np.nan, 0.8)})
    rows = spark.createDataFrame(f)
    got = lb.both_sides(rows, 10).toPandas().sort_values("date").reset_index(drop=True)
    want, at = [], []
    for i in range(70 - 11):
        c, a = x[i], f["atr"][i]
        if a == a:
            h, lo = f["high"].to_numpy()[i + 1 : i + 11], f["low"].to_numpy()[i + 1 : i + 11]
            day = lambda hit: int(np.argmax(hit)) if hit.any() else 11
            sl, ss, tl, ts = day(lo <= c - a), day(h >= c + a), day(h >= c + 1.5 * a), day(lo <= c - 1.5 * a)
            want.append(((h.max() - c) / a, (lo.min() - c) / a, sl, ss, sl < tl, ss < ts))
            at.append(i)
    names = ["mfe_long", "mae_long", "stop_day_long", "stop_day_short", "stop_first_long", "stop_first_short"]
    assert len(got) == len(want) and np.allclose(got[names].astype(float), np.array(want, float))
    assert np.allclose(got["mfe_short"], -got["mae_long"]) and np.allclose(got["mae_short"], -got["mfe_long"])
    walk, due = [], 0
    for i in at:
        if i >= due:
            walk.append(f["date"][i])
            due = i + 3
    assert sorted(lb.both_sides(rows, 10, every=3).toPandas()["date"]) == walk
