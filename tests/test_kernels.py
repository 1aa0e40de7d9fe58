"""Recursive kernels against plain loops, and no look-ahead."""

import math

import numpy as np
import pandas as pd

from tidemark.operators import features as ft
from tidemark.operators import kernels as kn
from tidemark.operators import labels as lb
from tidemark.operators import panel as pn
from tidemark.operators import quality as ql
from tidemark.sources import bars as src
from tidemark.sources.stages import Stages


def walk(n=300, seed=3):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    high, low = close * (1 + rng.random(n) * 0.02), close * (1 - rng.random(n) * 0.02)
    return pd.DataFrame({"symbol": "A", "date": pd.bdate_range("2023-01-02", periods=n).date, "open": close, "high": high, "low": low, "close": close, "adjclose": close, "volume": rng.integers(1, 50, n).astype(float)})


def wilder_loop(x, n):
    out, y = [], None
    seen = []
    for v in x:
        if v is None or math.isnan(v):
            out.append(math.nan)
            continue
        if y is None:
            seen.append(v)
            y = sum(seen) / n if len(seen) == n else None
        else:
            y += (v - y) / n
        out.append(math.nan if y is None else y)
    return out


def test_wilder_and_rsi():
    f = walk()
    step = f["close"].diff()
    up, down = wilder_loop(step.clip(lower=0), 14), wilder_loop(-step.clip(upper=0), 14)
    want = [100 * u / (u + d) if not math.isnan(u) else math.nan for u, d in zip(up, down)]
    np.testing.assert_allclose(kn.rsi(f["close"]), want, rtol=1e-10)
    assert kn.rsi(f["close"]).dropna().between(0, 100).all()
    assert kn.wilder(f["close"][:5], 14).isna().all()


def test_macd_and_adx():
    f = walk()
    line, mark, hist = kn.macd(f["close"])
    y = s = None
    a = b = f["close"][0]
    for i, v in enumerate(f["close"]):
        if i:
            a, b = a + 2 / 13 * (v - a), b + 2 / 27 * (v - b)
        y = a - b
        s = y if i == 0 else s + 0.2 * (y - s)
        assert abs(line[i] - y) < 1e-9 and abs(hist[i] - (y - s)) < 1e-9
    value, plus, minus = kn.adx(f["high"], f["low"], f["close"])
    assert value.dropna().between(0, 100).all() and value.notna().sum() > 200


def test_hurst_matches_single_windows():
    x = walk()["close"].diff()
    got = kn.hurst(x)
    for end in (130, 200, 300):
        part = x.to_numpy()[end - 128 : end]
        assert abs(got[end - 1] - kn.rescaled_range(part)) < 1e-9


def test_no_look_ahead(spark):
    f = walk(120)
    for make in (ft.trend, ft.distance, ft.range_breakout, ft.volume, ft.liquidity, ft.drawdown, ft.squeeze):
        whole = make(spark.createDataFrame(f)).toPandas().sort_values("date").iloc[:100].reset_index(drop=True)
        part = make(spark.createDataFrame(f.iloc[:100])).toPandas().sort_values("date").reset_index(drop=True)
        pd.testing.assert_frame_equal(whole, part)


def test_entry_walk(spark):
    f = walk(120)
    from pyspark.sql import functions as F
    from tidemark.functions.windows import by_symbol

    b = lb.with_atr(spark.createDataFrame(f)).withColumn("pos", F.row_number().over(by_symbol()))
    t = lb.first_touch(b, 1.0, 1.0, 20)
    rows = {r.pos: r for r in t.collect()}
    got = sorted(r.pos for r in lb.sample_entries(t, 5).collect())
    at, want = min(rows), []
    while at <= 120:
        if at not in rows:
            at += 1
            continue
        want.append(at)
        r = rows[at]
        at += r.h_used if r.hit != 0 and r.h_used < 5 else 5
    assert got == want


def test_ridge(spark):
    f = walk(120)
    f["x"], f["y"] = f["volume"], f["close"].diff()
    from tidemark.operators.factors import rolling_ridge

    got = rolling_ridge(spark.createDataFrame(f[["symbol", "date", "x", "y"]]), "y", ["x"]).toPandas().sort_values("date").reset_index(drop=True)
    part = f.iloc[41:101].dropna()
    x, y = part["x"] - part["x"].mean(), part["y"] - part["y"].mean()
    assert abs(got["beta_x"][100] - (x * y).sum() / ((x * x).sum() + 0.01)) < 1e-9


def test_sources(spark, tmp_path):
    f = spark.createDataFrame(walk(30))
    src.write_bars_long(f, str(tmp_path / "long"))
    back = src.read_bars(spark, str(tmp_path / "long"))
    assert back.count() == 30 and set(back.columns) == {"symbol", "date", *src.METRICS}
    src.write_by_symbol(f, str(tmp_path / "by"))
    assert src.read_symbols(spark, str(tmp_path / "by"), ["A"]).count() == 30
    assert src.read_prices(spark, str(tmp_path / "by"), ["A"], start="2023-02-01", columns=["date", "close"]).count() == 8
    new = spark.createDataFrame(walk(5).assign(symbol="B"))
    assert src.upsert_missing(f, new.unionByName(f)).count() == 35
    stages = Stages(spark, str(tmp_path / "stages"))
    made = []
    for _ in range(2):
        stages.run("one", lambda: (made.append(1), f)[1])
    assert len(made) == 1
    (tmp_path / "u.csv").write_text("Symbol,Description,Sector\nAAA,Plain,Tech\nBBB.U,Unit,Tech\nCCC,Some Acquisition Corp,Fin\nAAA,Twice,Tech\n")
    u = src.read_universe(spark, str(tmp_path / "u.csv"))
    assert u.count() == 3 and [r.symbol for r in ql.tradeable(u).collect()] == ["AAA"]


def test_edges(spark):
    one = spark.createDataFrame(walk(1))
    assert ft.volatility(ft.returns(one)).count() == 1
    flat = walk(40).assign(close=5.0, high=5.0, low=5.0, open=5.0, adjclose=5.0)
    got = ft.bollinger(spark.createDataFrame(flat)).toPandas()
    assert (got["bb_width"].dropna() == 0).all() and got["bb_width_z60"].isna().all()
    assert pn.as_of(one, one.limit(0).select("symbol", "date", "open").withColumnRenamed("open", "w"), ["w"], ["symbol"]).first().w is None
    assert ft.parse_lags("1,2,5-8") == [1, 2, 5, 6, 7, 8]
