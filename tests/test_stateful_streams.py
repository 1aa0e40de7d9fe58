"""Streams with list state and timers against the same rows as a batch."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import kernels as kn
from tidemark.operators import labels as lb
from tidemark.operators import quality as ql
from tidemark.streaming import stateful as st

START = dt.datetime(2024, 1, 1)
END = ("~", START + dt.timedelta(days=900))  # a last tick of another symbol moves the watermark past all others
PRICES = "symbol string, ts timestamp, high double, low double, close double, atr double"
TICKS = "symbol string, ts timestamp, value double"


@pytest.fixture
def feed(spark, tmp_path):
    """Rows written as files of three, in a given order, and the stream that reads one file a batch."""
    st.use_state_store(spark)

    def make(rows, schema, size=40, order=None):
        rows = rows if order is None else [rows[i] for i in order]
        for k in range(0, len(rows), size):
            spark.createDataFrame(rows[k : k + size], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{k:06d}"))
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))

    return make


def drain(stream, name, tmp_path):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"c-{name}")).start()
    query.processAllAvailable()
    query.stop()
    return stream.sparkSession.table(name)


def prices(n=60, symbols=3, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(symbols):
        x = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        rows += [(f"S{s}", START + dt.timedelta(days=i), float(x[i] * 1.01), float(x[i] * 0.99), float(x[i]), 1.0 + s * 0.2) for i in range(n)]
    return sorted(rows, key=lambda r: (r[1], r[0]))


def test_barriers_equal_the_batch_labels(spark, feed, tmp_path):
    rows = prices()
    shuffled = sorted(range(len(rows)), key=lambda i: (rows[i][1] + dt.timedelta(days=int(np.random.default_rng(i).integers(0, 4))), i))
    end = [(END[0], END[1], None, None, None, None)]
    stream = st.barriers(feed([*(rows[i] for i in shuffled), *end], PRICES), 2.0, 2.0, 8, 400 * 86_400, "5 days")
    got = {(r.symbol, r.entered.date()): (r.hit, r.used, round(r.price, 9)) for r in drain(stream, "touch", tmp_path).where("reason <> 'expired'").collect()}
    batch = spark.createDataFrame(rows, PRICES).withColumn("date", F.to_date("ts"))
    want = {(r.symbol, r.date): (r.hit, r.h_used, round(r.price_hit, 9)) for r in lb.first_touch(batch, 2.0, 2.0, 8).collect() if r.hit or r.h_used == 8}
    assert got == want and len(want) > 100


def test_entries_expire_without_a_tick(spark, feed, tmp_path):
    rows = [("A", START, 10.0, 10.0, 10.0, 1.0), ("A", START + dt.timedelta(days=1), 10.1, 9.9, 10.0, 1.0), ("B", START + dt.timedelta(days=30), 5.0, 5.0, 5.0, 1.0), (END[0], END[1], None, None, None, None)]
    got = {(r.symbol, r.entered): (r.hit, r.used, r.closed, r.reason, r.price) for r in drain(st.barriers(feed(rows, PRICES, 1), 1.0, 1.0, 5, 10 * 86_400, "1 day"), "expire", tmp_path).collect()}
    day = lambda n: START + dt.timedelta(days=n)
    assert got == {("A", day(0)): (0, 1, day(10), "expired", 10.0), ("A", day(1)): (0, 0, day(11), "expired", 10.0), ("B", day(30)): (0, 0, day(40), "expired", 5.0)}


def test_ticks_later_than_the_delay_are_dropped(spark, feed, tmp_path):
    rows = [("A", START + dt.timedelta(days=d), float(d)) for d in (0, 1, 20, 30)] + [("A", START + dt.timedelta(days=2), 99.0), (END[0], END[1], 1.0)]
    got = drain(st.smoothed(feed(rows, TICKS, 1), 3, 2, "2 days"), "late", tmp_path).where("symbol = 'A'").orderBy("ts").collect()
    assert [r.value for r in got] == [0.0, 1.0, 20.0, 30.0]


def test_smoothing_and_rsi_equal_the_batch(spark, feed, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(s, START + dt.timedelta(hours=7 * i), None if i % 17 == 5 else float(v)) for s in "AB" for i, v in enumerate(100 + np.cumsum(rng.normal(size=90)))]
    rows.sort(key=lambda r: r[1])
    got = drain(st.smoothed(feed([*rows, (END[0], END[1], 1.0)], TICKS, 25), 10, 14, "1 day"), "smooth2", tmp_path).toPandas()
    for s in "AB":
        f = pd.DataFrame([r for r in rows if r[0] == s], columns=["symbol", "ts", "value"])
        x = f["value"].dropna()
        g = got[got["symbol"] == s].sort_values("ts").reset_index(drop=True)
        assert len(g) == len(f)
        assert np.allclose(g["ema"][x.index], x.ewm(span=10, adjust=False).mean())
        want = kn.rsi(x.reset_index(drop=True), 14)
        assert np.allclose(g["rsi"][x.index].to_numpy(), want.to_numpy(), equal_nan=True)


def test_symbols_turn_off_and_unknown_ones_never_pass(spark, feed, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(s, START + dt.timedelta(hours=i), float(v)) for s, top in (("A", 50), ("B", 90_000), ("C", 20), ("X", 50)) for i, v in enumerate(rng.uniform(10, top, 50))]
    rows += [("C", START + dt.timedelta(hours=60), 0.001), ("C", START + dt.timedelta(hours=61), 15.0), ("D", START, None), ("D", START + dt.timedelta(hours=1), 3.0)]
    rows.sort(key=lambda r: r[1])
    known = spark.createDataFrame([(s,) for s in "ABCD"], "symbol string")
    got = drain(st.universe(feed([*rows, (END[0], END[1], 1.0)], TICKS, 30), known, late="1 day"), "universe", tmp_path)
    batch = spark.createDataFrame(rows, TICKS).withColumnRenamed("value", "close").join(known, "symbol", "left_semi")
    good = {(r.symbol, r.ts) for r in ql.plausible_prices(batch).collect()}
    seen = {(r.symbol, r.ts) for r in got.collect()}
    assert good <= seen and {s for s, _ in good} == {"A", "D"}
    for s in ("B", "C"):
        part = [r for r in rows if r[0] == s]
        off = next(i for i, r in enumerate(part) if r[2] > 50_000 or r[2] < 0.01 or r[2] / min(q[2] for q in part[: i + 1]) > 1_000)
        assert {t for q, t in seen if q == s} == {r[1] for r in part[:off]}


class Handle:
    """State and timers of one symbol in memory."""

    def __init__(self):
        self.lists, self.timers, self.asked = {}, set(), 0

    def getListState(self, name, schema):
        held = self.lists.setdefault(name, [])
        state = type("State", (), {})()
        state.get, state.clear, state.appendList = lambda: iter(list(held)), held.clear, held.extend
        state.put = lambda rows: (held.clear(), held.extend(rows))
        return state

    def registerTimer(self, at):
        self.asked += 1
        self.timers.add(at)


def test_timers_grow_with_calls_not_with_rows():
    class Clock:
        def __init__(self, now):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: now

    handle, processor = Handle(), st.Barriers(0.5, 0.5, 50, 20 * 86_400_000)
    processor.init(handle)
    n, day = 200, 86_400_000
    rows = pd.DataFrame({"ts": [START + dt.timedelta(days=i) for i in range(n)], "high": 10.0, "low": 10.0, "close": 10.0, "atr": 1.0})
    list(processor.handleInputRows(("A",), iter([rows]), Clock(0)))
    begun, out = st.milliseconds(START), []
    for now in (begun + 99 * day, begun + 150 * day, begun + 400 * day):
        for at in sorted(t for t in handle.timers if t <= now):
            handle.timers.discard(at)
            out += list(processor.handleExpiredTimer(("A",), Clock(now), Clock(at)))
    done = pd.concat(out)
    assert handle.asked < 20  # one for each row and entry before
    assert len(done) == n and set(done["reason"]) == {"expired"} and done["entered"].is_unique
    assert not any(handle.lists.values())
