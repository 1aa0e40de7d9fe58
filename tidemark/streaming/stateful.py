"""Streams whose symbols hold state: barrier entries with deadlines, smoothing and RSI, and symbols that turn themselves off.

Rows wait in state until the watermark has passed them and are then handled in time order, so what comes out doesn't depend on the order of arrival
within the allowed delay and equals the batch. Rows that are later than the delay are dropped by the watermark. These processors need Spark's
RocksDB state store (use_state_store)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Queries that start from now on keep list state and timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def milliseconds(ts) -> int:
    """The millisecond that is not before an instant, the unit of timers."""
    return -(-pd.Timestamp(ts).value // 1_000_000)


class Ordered(StatefulProcessor):
    """Rows of a symbol, in time order once the watermark has passed them. Subclasses name the columns of a row, start (state) and step (rows in order,
    up to a time in milliseconds)."""

    row = "ts timestamp, value double"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row)
        self.columns = [c.split()[0] for c in self.row.split(", ")]
        self.start()

    def start(self) -> None:
        raise NotImplementedError

    def step(self, key: tuple, rows: pd.DataFrame, until: int) -> pd.DataFrame:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            part = frame[self.columns].dropna(subset=["ts"])
            if len(part):
                self.waiting.appendList([tuple(None if pd.isna(v) else v for v in r) for r in part.itertuples(index=False)])
                # the first row's timer handles all that the watermark has passed and sets the next one
                self.handle.registerTimer(milliseconds(part["ts"].min()))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        held = [tuple(r) for r in self.waiting.get()]
        now = [r for r in held if milliseconds(r[0]) <= until]
        if now:
            later = [r for r in held if milliseconds(r[0]) > until]
            if later:
                self.waiting.put(later)
                self.handle.registerTimer(milliseconds(min(r[0] for r in later)))
            else:
                self.waiting.clear()
        frame = pd.DataFrame(now, columns=self.columns)
        out = self.step(key, frame.sort_values(self.columns, kind="stable").reset_index(drop=True), until)
        if len(out):
            yield out

    def close(self) -> None:
        pass


class Barriers(Ordered):
    """Every row with a positive close and ATR opens an entry with barriers up and down ATRs away. It ends at the first later row that touches one (the upper
    one if both), after horizon rows, or at its deadline, whichever comes first; a deadline needs no row of the symbol."""

    row = "ts timestamp, high double, low double, close double, atr double"

    def __init__(self, up: float, down: float, horizon: int, wait_ms: int):
        self.up, self.down, self.horizon, self.wait = up, down, horizon, wait_ms

    def start(self) -> None:
        self.entries = self.handle.getListState("entries", "entered timestamp, top double, bottom double, used int, last double")

    def step(self, key, rows, until):
        held = [tuple(e) for e in self.entries.get()]
        at = np.array([pd.Timestamp(e[0]).value for e in held], np.int64)
        top, bottom, used, last = (np.array([e[i] for e in held], float) for i in (1, 2, 3, 4))
        wait, done = self.wait * 1_000_000, []

        def leave(gone: np.ndarray, hit: np.ndarray, closed, price: np.ndarray, reason: np.ndarray) -> None:
            nonlocal at, top, bottom, used, last
            for i in np.flatnonzero(gone):
                done.append((key[0], pd.Timestamp(at[i]), int(hit[i]), int(used[i]), float(price[i]), pd.Timestamp(closed[i]), reason[i]))
            at, top, bottom, used, last = (v[~gone] for v in (at, top, bottom, used, last))

        def expire(before: int, inclusive: bool) -> None:
            late = at + wait <= before if inclusive else at + wait < before
            if late.any():
                leave(late, np.zeros(len(at)), at + wait, last, np.full(len(at), "expired"))

        for r in rows.itertuples(index=False):
            now = pd.Timestamp(r.ts).value
            expire(now, inclusive=False)
            used += 1
            above = r.high >= top if r.high is not None and r.high == r.high else np.zeros(len(at), bool)
            below = r.low <= bottom if r.low is not None and r.low == r.low else np.zeros(len(at), bool)
            hit = np.where(above, 1, np.where(below, -1, 0))
            last = np.where(True, r.close if r.close == r.close else last, last)
            gone = (hit != 0) | (used >= self.horizon)
            if gone.any():
                leave(gone, hit, np.full(len(at), now), np.where(hit == 1, top, np.where(hit == -1, bottom, last)), np.where(hit == 1, "upper", np.where(hit == -1, "lower", "horizon")))
            if r.close is not None and r.atr is not None and np.isfinite(r.close) and np.isfinite(r.atr) and r.close > 0 and r.atr > 0:
                at, used, last = np.append(at, now), np.append(used, 0), np.append(last, r.close)
                top, bottom = np.append(top, r.close + self.up * r.atr), np.append(bottom, r.close - self.down * r.atr)
        expire(until * 1_000_000, inclusive=True)
        if len(at):
            self.handle.registerTimer(milliseconds(pd.Timestamp(int(at.min()) + wait)))
            self.entries.put([(pd.Timestamp(a).to_pydatetime(), float(t), float(b), int(u), float(x)) for a, t, b, u, x in zip(at, top, bottom, used, last, strict=True)])
        else:
            self.entries.clear()
        return pd.DataFrame(done, columns=["symbol", "entered", "hit", "used", "price", "closed", "reason"])


class Smoothing(Ordered):
    """Exponential mean of span and Wilder's RSI of n for each row; the state is a handful of numbers. Null values leave the state as it is and get its mean."""

    def __init__(self, span: float, n: int):
        self.alpha, self.n = 2 / (span + 1), n

    def start(self) -> None:
        self.state = self.handle.getValueState("state", "mean double, last double, steps long, up double, down double")

    def step(self, key, rows, until):
        mean, last, steps, up, down = self.state.get() if self.state.exists() else (None, None, 0, 0.0, 0.0)
        there = rows["value"].notna().to_numpy()
        x = rows["value"].to_numpy(float)[there]
        if not len(rows):
            return pd.DataFrame(columns=["symbol", "ts", "value", "ema", "rsi"])
        means, rsis = np.full(len(rows), np.nan), np.full(len(rows), np.nan)
        if len(x):
            chain = pd.Series(x if mean is None else np.concatenate(([mean], x))).ewm(alpha=self.alpha, adjust=False).mean().to_numpy()
            means[there] = chain[-len(x) :]
            move = np.diff(x, prepend=x[0] if last is None else last)
            index = np.flatnonzero(there)
            if last is None:
                move, index = move[1:], index[1:]
            gains, falls = np.maximum(move, 0), np.maximum(-move, 0)
            first = max(0, min(self.n - steps, len(move)))  # rows that only fill the plain mean
            up, down = up + gains[:first].sum(), down + falls[:first].sum()
            if steps < self.n <= steps + first:
                up, down = up / self.n, down / self.n
                rsis[index[first - 1]] = 100 * up / (up + down) if up + down > 0 else np.nan
            if len(move) > first:
                ups, downs = (pd.Series(np.concatenate(([a], b[first:]))).ewm(alpha=1 / self.n, adjust=False).mean().to_numpy()[1:] for a, b in ((up, gains), (down, falls)))
                with np.errstate(invalid="ignore", divide="ignore"):
                    rsis[index[first:]] = np.where(ups + downs > 0, 100 * ups / (ups + downs), np.nan)
                up, down = ups[-1], downs[-1]
            steps, last = steps + len(move), x[-1]
        means = pd.Series(means).ffill().fillna(np.nan if mean is None else mean).to_numpy()
        if not np.isnan(means[-1]):
            self.state.update((float(means[-1]), None if last is None else float(last), int(steps), float(up), float(down)))
        return pd.DataFrame({"symbol": key[0], "ts": rows["ts"], "value": rows["value"].astype(float), "ema": means, "rsi": rsis})


class Plausible(Ordered):
    """Rows of a symbol until its prices have left the bounds or their ratio has grown too large; from that row on the symbol is off for good."""

    def __init__(self, most: float, least: float, ratio: float):
        self.most, self.least, self.ratio = most, least, ratio

    def start(self) -> None:
        self.state = self.handle.getValueState("state", "low double, high double, off boolean")

    def step(self, key, rows, until):
        low, high, off = self.state.get() if self.state.exists() else (np.inf, -np.inf, False)
        if off or not len(rows):
            return pd.DataFrame(columns=["symbol", "ts", "value"])
        x = rows["value"].to_numpy(float)
        lows, highs = np.fmin.accumulate(np.concatenate(([low], x)))[1:], np.fmax.accumulate(np.concatenate(([high], x)))[1:]
        with np.errstate(invalid="ignore", divide="ignore"):
            bad = (highs > self.most) | (lows < self.least) | (np.isfinite(lows) & (highs / lows > self.ratio))
        n = int(np.argmax(bad)) if bad.any() else len(rows)
        self.state.update((float(lows[-1]), float(highs[-1]), bool(bad.any())))
        return rows.iloc[:n].assign(symbol=key[0])[["symbol", "ts", "value"]]


def _run(rows: DataFrame, processor: Ordered, late: str, schema: str, known: DataFrame | None = None) -> DataFrame:
    """known: the symbols that are handled; ticks of others still move the watermark."""
    kind = dict(rows.dtypes)["symbol"]
    timed = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    timed = timed if known is None else timed.join(known.select("symbol").distinct(), "symbol", "left_semi")
    return timed.groupBy("symbol").transformWithStateInPandas(statefulProcessor=processor, outputStructType=f"symbol {kind}, {schema}", outputMode="Append", timeMode="EventTime")


def barriers(bars: DataFrame, up: float, down: float, horizon: int, wait_seconds: float, late: str = "1 day") -> DataFrame:
    """bars: symbol, ts, high, low, close, atr. Each entry once it has ended: symbol, entered, hit (1, -1, 0), used (rows), price, closed, and reason (upper, lower,
    horizon, expired). At most horizon entries of a symbol are open."""
    return _run(bars.select("symbol", "ts", "high", "low", "close", "atr"), Barriers(up, down, horizon, int(wait_seconds * 1000)), late, "entered timestamp, hit int, used int, price double, closed timestamp, reason string")


def smoothed(ticks: DataFrame, span: float = 10, n: int = 14, late: str = "1 day") -> DataFrame:
    """ticks: symbol, ts, value. Each with its symbol's exponential mean (ema) and RSI."""
    return _run(ticks.select("symbol", "ts", "value"), Smoothing(span, n), late, "ts timestamp, value double, ema double, rsi double")


def universe(ticks: DataFrame, symbols: DataFrame, most: float = 50_000.0, least: float = 0.01, ratio: float = 1_000.0, late: str = "1 day") -> DataFrame:
    """ticks (symbol, ts, value) of the symbols of a static table, each symbol until its prices leave the bounds."""
    return _run(ticks.select("symbol", "ts", "value"), Plausible(most, least, ratio), late, "ts timestamp, value double", symbols)
