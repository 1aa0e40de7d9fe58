"""Streaming versions: weekly bars that are final when their Friday has passed, smoothing and barrier state per symbol."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(ticks: DataFrame) -> DataFrame:
    """Watermarks want instants, not local times."""
    return ticks.withColumn("ts", F.col("ts").cast("timestamp"))


def weekly_bars(ticks: DataFrame, late: str = "1 day") -> DataFrame:
    """ticks (symbol, ts, value): bars from Saturday to Friday; a week comes out once the watermark has passed it."""
    week = F.window("ts", "7 days", "7 days", "2 days")
    bars = _timed(ticks).withWatermark("ts", late).groupBy("symbol", week.alias("w")).agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").alias("n"))
    return bars.select("symbol", F.date_sub(F.to_date("w.end"), 1).alias("date"), "open", "high", "low", "close", "n")


def smoothed(ticks: DataFrame, span: float = 10) -> DataFrame:
    """Each tick with its symbol's exponential mean; the mean is the only state."""
    alpha = 2 / (span + 1)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        value = state.get[0] if state.exists else None
        for frame in frames:
            frame = frame.sort_values("ts")
            made = []
            for x in frame["value"]:
                value = x if value is None else value + alpha * (x - value)
                made.append(value)
            yield frame.assign(ema=made)[["symbol", "ts", "value", "ema"]]
        if value is not None:
            state.update((float(value),))

    kind = dict(ticks.dtypes)["symbol"]
    return _timed(ticks).select("symbol", "ts", "value").groupBy("symbol").applyInPandasWithState(step, f"symbol {kind}, ts timestamp, value double, ema double", "ema double", "append", "NoTimeout")


def barriers(ticks: DataFrame, up: float, down: float, horizon: int) -> DataFrame:
    """Every tick opens an entry that is held in state until a later tick of the symbol is up or down by those shares, or horizon ticks have
    passed. At most horizon entries are open for a symbol."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        entries = [list(e) for e in zip(*state.get, strict=True)] if state.exists else []
        for frame in frames:
            done = []
            for ts, x in zip(*(frame.sort_values("ts")[c] for c in ("ts", "value")), strict=True):
                still = []
                for entry in entries:
                    entry[2] += 1
                    hit = 1 if x >= entry[1] * (1 + up) else -1 if x <= entry[1] * (1 - down) else 0
                    if hit or entry[2] >= horizon:
                        done.append((key[0], pd.Timestamp(entry[0]), hit, entry[2], x))
                    else:
                        still.append(entry)
                entries = [*still, [ts.value, float(x), 0]]
            yield pd.DataFrame(done, columns=["symbol", "entered", "hit", "used", "price"])
        state.update(tuple(list(c) for c in zip(*entries, strict=True)) if entries else ([], [], []))

    kind = dict(ticks.dtypes)["symbol"]
    return _timed(ticks).select("symbol", "ts", "value").groupBy("symbol").applyInPandasWithState(step, f"symbol {kind}, entered timestamp, hit int, used int, price double", "at array<long>, px array<double>, used array<int>", "append", "NoTimeout")


def coverage(ticks: DataFrame, late: str = "1 day") -> DataFrame:
    """Per day: ticks, symbols (estimated) and the share of values there are; out when the watermark has passed the day."""
    day = F.window("ts", "1 day")
    out = _timed(ticks).withWatermark("ts", late).groupBy(day.alias("w")).agg(F.count("*").alias("n"), F.approx_count_distinct("symbol").alias("n_symbols"), F.avg(F.col("value").isNotNull().cast("double")).alias("share"))
    return out.select(F.to_date("w.start").alias("date"), "n", "n_symbols", "share")
