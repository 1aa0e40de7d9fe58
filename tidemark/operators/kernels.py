"""Recursive smoothing: values that depend on the previous output. One grouped pass per symbol makes all that are asked for.

Definitions: an exponential mean of span s takes alpha = 2 / (s + 1) from the first value on; Wilder's mean of n takes
alpha = 1 / n and begins with the plain mean of the first n values. Rows of a symbol fit one task by a wide margin: a century of daily
bars is 25,000 rows."""

from __future__ import annotations

from collections.abc import Callable, Collection

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import frames as fr


def ewm(x: pd.Series, span: float) -> pd.Series:
    return x.ewm(span=span, adjust=False).mean()


def wilder(x: pd.Series, n: int) -> pd.Series:
    """Wilder's mean; null until n values are there."""
    return pd.Series(fr.wilder(x.to_numpy(float), n), index=x.index)


def rsi(price: pd.Series, n: int = 14) -> pd.Series:
    step = price.diff()
    up, down = wilder(step.clip(lower=0), n), wilder(-step.clip(upper=0), n)
    return 100 * up / (up + down).replace(0, np.nan)


def macd(price: pd.Series, fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[pd.Series, pd.Series, pd.Series]:
    """Line, signal and histogram; null for a series of fewer than slow + signal values."""
    if price.notna().sum() < slow + signal:
        return price * np.nan, price * np.nan, price * np.nan
    line = ewm(price, fast) - ewm(price, slow)
    mark = ewm(line, signal)
    return line, mark, line - mark


def true_range(high: pd.Series, low: pd.Series, close: pd.Series) -> pd.Series:
    return pd.Series(fr.true_range({"high": high.to_numpy(float), "low": low.to_numpy(float), "close": close.to_numpy(float)}), index=close.index)


def adx(high: pd.Series, low: pd.Series, close: pd.Series, n: int = 14) -> tuple[pd.Series, pd.Series, pd.Series]:
    up, down = high.diff(), -low.diff()
    plus, minus = up.where((up > down) & (up > 0), 0.0).where(up.notna()), down.where((down > up) & (down > 0), 0.0).where(down.notna())
    width = wilder(true_range(high, low, close).where(up.notna()), n).replace(0, np.nan)
    p, m = 100 * wilder(plus, n) / width, 100 * wilder(minus, n) / width
    return wilder(100 * (p - m).abs() / (p + m).replace(0, np.nan), n), p, m


def rescaled_range(x: np.ndarray) -> float:
    """Hurst exponent of one series: slope of log R/S over log length for halving lengths; NaN below 20 values."""
    n = len(x)
    if n < 20:
        return np.nan
    sizes, values = [], []
    size = n
    while size >= 10:
        parts = x[: n // size * size].reshape(-1, size)
        run = np.cumsum(parts - parts.mean(axis=1, keepdims=True), axis=1)
        dev = parts.std(axis=1)
        ok = dev > 1e-12
        if ok.any():
            sizes.append(np.log(size))
            values.append(np.log(((run.max(axis=1) - run.min(axis=1))[ok] / dev[ok]).mean()))
        size //= 2
    return float(np.polyfit(sizes, values, 1)[0]) if len(sizes) > 1 else np.nan


def hurst(x: pd.Series, w: int = 128) -> pd.Series:
    """Rolling exponent over w rows; while fewer are there, over what there is, at least max(50, w / 2). Whole windows are made together."""
    values = x.to_numpy(float)
    out = np.full(len(values), np.nan)
    least = max(50, w // 2)
    whole = np.zeros(len(values), bool)
    if len(values) >= w:
        views = np.lib.stride_tricks.sliding_window_view(values, w)
        ok = ~np.isnan(views).any(axis=1)
        whole[w - 1 :] = ok
        sizes = [w >> k for k in range(16) if w >> k >= 10]
        curves = []
        for size in sizes:
            parts = views[ok][:, : w // size * size].reshape(-1, w // size, size)
            run = np.cumsum(parts - parts.mean(axis=2, keepdims=True), axis=2)
            dev = parts.std(axis=2)
            ratio = np.where(dev > 1e-12, (run.max(axis=2) - run.min(axis=2)) / np.where(dev > 1e-12, dev, 1), np.nan)
            count = (~np.isnan(ratio)).sum(axis=1)
            curves.append(np.log(np.where(count > 0, np.nansum(ratio, axis=1) / np.maximum(count, 1), np.nan)))
        y, t = np.stack(curves, axis=1), np.log(sizes)
        use = ~np.isnan(y)
        n = np.maximum(use.sum(axis=1), 1)
        mt = (t * use).sum(axis=1) / n
        my = np.where(use, y, 0).sum(axis=1) / n
        spread = (((t - mt[:, None]) ** 2) * use).sum(axis=1)
        slope = (np.where(use, y - my[:, None], 0) * (t - mt[:, None])).sum(axis=1) / np.where(spread > 0, spread, np.nan)
        out[w - 1 :][ok] = slope
    for end in range(least, len(values) + 1):
        if not whole[end - 1]:
            part = values[max(0, end - w) : end]
            part = part[~np.isnan(part)]
            if len(part) >= least:
                out[end - 1] = rescaled_range(part)
    return pd.Series(out, index=x.index)


#: name -> columns that it makes, of a frame with open, high, low, close and ret.
BLOCKS = {
    "ewm": (["ema_10", "ema_39"], lambda f: [ewm(f["close"], 10), ewm(f["close"], 39)]),
    "rsi": (["rsi_14", "rsi_21", "rsi_30"], lambda f: [rsi(f["close"], n) for n in (14, 21, 30)]),
    "macd": (["macd", "macd_signal", "macd_histogram", "macd_hist_deriv_ema3"], lambda f: [*(m := macd(f["close"])), ewm(m[2].diff(), 3)]),
    "atr": (["atr14", "atr_percent"], lambda f: [a := wilder(true_range(f["high"], f["low"], f["close"]), 14), a / f["close"]]),
    "adx": (["adx_14", "di_plus_14", "di_minus_14"], lambda f: list(adx(f["high"], f["low"], f["close"]))),
    "hurst": (["hurst_128", "hurst_128_ema5"], lambda f: [h := hurst(f["close"].diff()), h.ewm(halflife=5, adjust=False).mean()]),
}


def grouped(table: DataFrame, makers: list[tuple[tuple[str, ...], tuple[str, ...], Callable]], beside: DataFrame | None = None) -> DataFrame:
    """table with columns of doubles that depend on a symbol's rows before: (needs, makes, function of a frame that gives the made columns).

    All run in one pass over a symbol, in order, so later ones can need what earlier ones make. The other columns pass as Arrow; only the needed
    ones become arrays (for functions marked plain, see frames.py) or a pandas frame. beside: a table of at most one row a symbol and date, whose other
    columns join the rows in the pass (null where it has no row), so that the made columns need not be dealt for it."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    run, names = _pass(makers)
    schema = StructType([*(StructField(f.name, f.dataType) for f in table.schema), *(StructField(n, DoubleType()) for n in names)])
    if beside is None:
        return table.groupBy("symbol").applyInArrow(run, schema)
    new = [f for f in beside.schema if f.name not in {"symbol", "date"}]

    def joined(rows: pa.Table, other: pa.Table) -> pa.Table:
        if rows.num_rows:
            rows = run(rows)
        else:
            rows = pa.Table.from_arrays([*rows.columns, *(pa.array([], pa.float64()) for _ in names)], names=[*rows.column_names, *names])
        other = other.take(pc.sort_indices(other["date"], null_placement="at_start"))
        have, want = _days(other["date"]), _days(rows["date"])
        at = np.searchsorted(have, want)
        found = at < len(have)
        found[found] = (have[at[found]] == want[found]) & (want[found] != NO_DAY)
        place = pa.array(at, pa.int64(), mask=~found)
        return pa.Table.from_arrays([*rows.columns, *(other[f.name].take(place) for f in new)], names=[*rows.column_names, *(f.name for f in new)])

    schema = StructType([*schema, *(StructField(f.name, f.dataType) for f in new)])
    return _met(table, beside, joined, schema)


def _met(left: DataFrame, right: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
    # columns under new names of their own: the two tables may come from one
    return left.groupBy("symbol").cogroup(right.toDF(*right.columns).groupBy("symbol")).applyInArrow(run, schema)


#: A null among days.
NO_DAY = np.iinfo(np.int64).min


def _days(dates: pa.ChunkedArray) -> np.ndarray:
    """Dates or timestamps as whole numbers that ascend as they do; a null is the least."""
    return dates.to_numpy().astype("datetime64[us]").view(np.int64)


def _pass(makers: list[tuple[tuple[str, ...], tuple[str, ...], Callable]]) -> tuple[Callable[[pa.Table], pa.Table], list[str]]:
    """The pass over one symbol's rows that puts them in order and adds what makers make, and the names of that."""
    names = [c for _, makes, _ in makers for c in makes]
    needed = [c for c in dict.fromkeys(c for needs, _, _ in makers for c in needs) if c not in names]

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows["date"], null_placement="at_start"))
        have = {c: rows[c].to_pandas().to_numpy() for c in needed}
        for needs, makes, fn in makers:
            if getattr(fn, "plain", False):
                part = fn({c: have[c].astype(float, copy=False) for c in needs})
            else:
                part = fn(pd.DataFrame({c: have[c] for c in needs}))
            have |= {c: np.asarray(x, float) for c, x in zip(makes, part, strict=True)}
        return pa.Table.from_arrays([*rows.columns, *(pa.array(have[name], pa.float64(), from_pandas=True) for name in names)], names=[*rows.column_names, *names])

    return run, names


def grouped_as_of(table: DataFrame, coarse: DataFrame, makers: list[tuple[tuple[str, ...], tuple[str, ...], Callable]], columns: dict[str, str], least: int = 0, always: Collection[str] = ()) -> DataFrame:
    """table with columns (of coarse, or made by makers over a symbol's rows of coarse) under the names given, from the symbol's last row of coarse at or before
    the date; null where there is none. Symbols with fewer than least rows of coarse get only those of always.

    Both tables meet in the pass that makes the columns, so what changes hands are their narrow rows and not the made columns, which may be hundreds."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import DoubleType, StructField, StructType

    run, names = _pass(makers)
    kinds = {f.name: f.dataType for f in coarse.schema} | dict.fromkeys(names, DoubleType())
    schema = StructType([*(StructField(f.name, f.dataType) for f in table.schema), *(StructField(new, kinds[c]) for c, new in columns.items())])

    def carried(rows: pa.Table, other: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows["date"], null_placement="at_start"))
        made = run(other) if other.num_rows else None
        at = np.full(rows.num_rows, -1) if made is None else np.searchsorted(_days(made["__at"]), _days(rows["date"]), side="right") - 1
        place = pa.array(at, pa.int64(), mask=at < 0)
        kept = set() if made is None else {c for c in columns if made.num_rows >= least or c in always}
        kind = lambda c: pa.float64() if c in names else other.schema.field(c).type
        return pa.Table.from_arrays([*rows.columns, *(made[c].take(place) if c in kept else pa.nulls(rows.num_rows, kind(c)) for c in columns)], names=[*rows.column_names, *columns.values()])

    right = coarse.withColumn("__at", F.col("date").cast(table.schema["date"].dataType))
    return _met(table, right, carried, schema)


def recursive(bars: DataFrame, blocks: list[str]) -> DataFrame:
    """bars with the columns of the named blocks: one shuffle, one pass a symbol."""
    needs = tuple(c for c in ("high", "low", "close") if c in bars.columns)
    return grouped(bars, [(needs, tuple(BLOCKS[b][0]), BLOCKS[b][1]) for b in blocks])


def smoothed(table: DataFrame, wanted: dict[str, tuple[str, float, int]], by: str = "symbol") -> DataFrame:
    """table with exponential means: name -> (column, span, values that must be there)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("date").reset_index(drop=True)
        return frame.assign(**{k: frame[c].astype(float).ewm(span=span, adjust=False, min_periods=least).mean() for k, (c, span, least) in wanted.items()})

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema] + [f"`{k}` double" for k in wanted])
    return table.groupBy(by).applyInPandas(run, schema)


def smoothed_rsi(table: DataFrame, x: str, span: int = 14, name: str = "rsi") -> DataFrame:
    """RSI of x from exponential means of gains and losses; the first row gains and loses nothing."""
    from pyspark.sql import functions as F

    from ..functions.windows import diff, div

    step = F.coalesce(diff(x), F.lit(0.0))
    out = table.withColumn("__step", step).withColumns({"__up": F.greatest("__step", F.lit(0.0)), "__down": F.greatest(-F.col("__step"), F.lit(0.0))})
    out = smoothed(out, {"__u": ("__up", span, span), "__d": ("__down", span, span)})
    return out.withColumn(name, 100 - 100 / (1 + div("__u", "__d"))).drop("__step", "__up", "__down", "__u", "__d")
