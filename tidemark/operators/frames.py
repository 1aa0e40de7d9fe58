"""Rolling columns of one symbol's rows in numpy, for grouped passes: what features.py makes with window functions, with the same values.

A plan of many blocks as window functions copies each wide row through some twenty windows and takes every sliding frame an aggregate at a time. Here a
pass has the rows of a symbol as arrays (NaN: null) and a frame is a view of them; its sums are taken a stretch of rows at a time, so memory is bounded
by the longest frame. Deviations are those from the frame's own mean, so nothing that lies before a frame is left in it."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd

EPS = 1e-12
#: Values of frames that are held at a time.
HELD = 1 << 18

Arrays = dict[str, np.ndarray]


def plain(makes, fn: Callable[[Arrays], Arrays]) -> Callable[[Arrays], list[np.ndarray]]:
    """A pass over arrays in place of a pandas frame, that gives the columns of makes in their order."""

    def run(f: Arrays) -> list[np.ndarray]:
        with np.errstate(all="ignore"):
            made = fn(f)
        return [made[c] for c in makes]

    run.plain = True
    return run


def lag(x: np.ndarray, k: int = 1, fill: float = np.nan) -> np.ndarray:
    out = np.full(len(x), fill)
    if k < len(x):
        out[k:] = x[: len(x) - k]
    return out


def diff(x: np.ndarray, k: int = 1) -> np.ndarray:
    return x - lag(x, k)


def div(a, b) -> np.ndarray:
    """a / b, null where b is null or within EPS of 0."""
    return np.where(np.abs(b) > EPS, a / np.where(np.abs(b) > EPS, b, 1.0), np.nan)


def ratio(a, b) -> np.ndarray:
    """a / b, null where b is null or 0."""
    return np.where(b != 0, a / np.where(b != 0, b, 1.0), np.nan)


def log(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, np.log(np.where(x > 0, x, 1.0)), np.nan)


def log1p(x: np.ndarray) -> np.ndarray:
    return np.where(x > -1, np.log1p(np.where(x > -1, x, 0.0)), np.nan)


def zero(x: np.ndarray) -> np.ndarray:
    """x, 0 where it is null."""
    return np.where(np.isnan(x), 0.0, x)


def ffill(x: np.ndarray) -> np.ndarray:
    at = np.maximum.accumulate(np.where(np.isnan(x), -1, np.arange(len(x))))
    return np.where(at >= 0, x[np.maximum(at, 0)], np.nan)


def counts(x: np.ndarray, w: int) -> np.ndarray:
    """Values that are there in the last w rows."""
    c = np.cumsum(~np.isnan(x), dtype=float)
    return c - lag(c, w, 0.0)


def views(x: np.ndarray, w: int, fill: float = 0.0, first: int = 0, end: int | None = None) -> Iterator[tuple[slice, np.ndarray]]:
    """Stretches of the rows from first to end with the last w values of each; fill stands before the table."""
    end = len(x) if end is None else end
    if first >= end:
        return
    padded = np.empty(len(x) + w - 1, x.dtype)
    padded[: w - 1], padded[w - 1 :] = fill, x
    step, size = max(1, HELD // w), padded.itemsize
    for i in range(first, end, step):
        j = min(i + step, end)
        # a sliding view, which numpy's own function takes ten times as long to make
        yield slice(i, j), np.ndarray((j - i, w), x.dtype, padded, i * size, (size, size))


def total(x: np.ndarray, w: int, least: int) -> np.ndarray:
    out = np.empty(len(x))
    for at, v in views(zero(x), w):
        out[at] = v.sum(axis=1)
    return np.where(counts(x, w) >= least, out, np.nan)


def mean(x: np.ndarray, w: int, least: int | None = None) -> np.ndarray:
    n = counts(x, w)
    return total(x, w, max(1, least or max(5, w // 3))) / np.where(n > 0, n, 1.0)


def moments(x: np.ndarray, w: int, y: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, mean and sum of squared deviations of the last w rows; with y, of whole pairs: count, sum of products and sum of squares of x.

    Differences to the frame's last value come first, so equal values have no deviation at all."""
    ok = ~np.isnan(x) if y is None else ~(np.isnan(x) | np.isnan(y))
    n = counts(np.where(ok, 1.0, np.nan), w)
    m = np.where(n > 0, n, 1.0)
    x = np.where(ok, x, np.nan)
    base, x = zero(ffill(x)), zero(x)
    first, second = np.empty(len(x)), np.empty(len(x))
    last, y = (None, None) if y is None else (zero(ffill(np.where(ok, y, np.nan))), np.where(ok, y, 0.0))
    # frames from here on lack no value and need no mask
    missing = np.flatnonzero(~ok)
    full = min(len(x), (missing[-1] + w if len(missing) else w - 1))
    for begin, end in ((0, full), (full, len(x))):
        masks = views(ok.astype(float), w, 0.0, begin, end) if begin == 0 and end else None
        others = None if y is None else views(y, w, 0.0, begin, end)
        for at, v in views(x, w, 0.0, begin, end):
            mask = None if masks is None else next(masks)[1]
            d = v - base[at, None]
            if mask is not None:
                d *= mask
            middle = d.sum(axis=1) / m[at]
            d -= middle[:, None]
            if mask is not None:
                d *= mask
            second[at] = np.einsum("ij,ij->i", d, d)
            if y is None:
                first[at] = base[at] + middle
            else:
                # what a mask hides is 0 in d
                first[at] = np.einsum("ij,ij->i", d, next(others)[1] - last[at, None])
    return n, first, second


def running(x: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, mean and sum of squared deviations as differences of running sums, for frames so long that these are worth their rounding; a deviation
    within it counts as 0."""
    v = zero(x)
    n, m, q = counts(x, w), *((c := np.cumsum(t)) - lag(c, w, 0.0) for t in (v, v * v))
    there = np.where(n > 0, n, 1.0)
    m, square = m / there, q / there
    spread = square - m * m
    return n, m, np.where(spread > 1e-13 * square, spread, 0.0) * there


def std(x: np.ndarray, w: int, least: int | None = None, ddof: int = 0) -> np.ndarray:
    n, _, q = moments(x, w)
    return np.where(n >= max(1 + ddof, least or max(5, w // 3)), np.sqrt(q / np.maximum(n - ddof, 1)), np.nan)


def zscore(x: np.ndarray, w: int, least: int | None = None, ddof: int = 0, found: Callable = moments) -> np.ndarray:
    n, m, q = found(x, w)
    dev = np.sqrt(q / np.maximum(n - ddof, 1))
    ok = (n >= max(1 + ddof, least or max(5, w // 3))) & (dev > EPS)
    return np.where(ok, (x - m) / np.where(ok, dev, 1.0), np.nan)


def high(x: np.ndarray, w: int, least: int | None = None) -> np.ndarray:
    out = np.empty(len(x))
    for at, v in views(np.where(np.isnan(x), -np.inf, x), w, -np.inf):
        out[at] = v.max(axis=1)
    return np.where(counts(x, w) >= (least or max(2, w // 3)), out, np.nan)


def low(x: np.ndarray, w: int, least: int | None = None) -> np.ndarray:
    return -high(-x, w, least)


def clip(x: np.ndarray, lo: float, hi: float) -> np.ndarray:
    return np.minimum(np.maximum(x, lo), hi)


def true_range(f: Arrays) -> np.ndarray:
    before = lag(f["close"])
    return np.fmax(f["high"] - f["low"], np.fmax(np.abs(f["high"] - before), np.abs(f["low"] - before)))


def moving_averages(price: np.ndarray, periods) -> Arrays:
    return {f"ma_{p}": mean(price, p, max(5, p // 2)) for p in periods}


def trend(f: Arrays, periods, slope: int = 20, eps: float = 1e-5) -> Arrays:
    out = moving_averages(f["adjclose"], periods)
    for p in periods:
        s = div(out[f"ma_{p}"], lag(out[f"ma_{p}"], slope)) - 1
        out[f"pct_slope_ma_{p}"], out[f"sign_ma_{p}"] = s, np.where(s > eps, 1.0, np.where(s < -eps, -1.0, 0.0))
    signs = np.stack([out[f"sign_ma_{p}"] for p in periods])
    up, down = (signs > 0).sum(axis=0).astype(float), (signs < 0).sum(axis=0).astype(float)
    out["trend_score_granular"], out["trend_alignment"] = zero(div(up - down, up + down)), div(up, up + down)
    return out | {"trend_score_sign": np.sign(out["trend_score_granular"]), "trend_score_slope": diff(out["trend_score_granular"])}


def volatility(f: Arrays) -> Arrays:
    out = {f"rv_{w}": std(f["ret"], w) for w in (10, 20, 60, 100)}
    out |= {"rv_ratio_10_60": div(out["rv_10"], out["rv_60"]), "rv_ratio_20_100": div(out["rv_20"], out["rv_100"]), "rv_z_60": zscore(out["rv_20"], 60), "rv_vol_of_vol_20d": std(diff(out["rv_20"]), 20, 5)}
    return out | {"vol_regime": log1p(out["rv_ratio_20_100"])} | {f"rv{w}_slope_norm": (div(out[f"rv_{w}"], lag(out[f"rv_{w}"], 20)) - 1) / 20 for w in (60, 100)}


def distance(f: Arrays, windows) -> Arrays:
    price, ma = f["adjclose"], moving_averages(f["adjclose"], windows)
    out = {f"pct_dist_ma_{w}": div(price - ma[f"ma_{w}"], ma[f"ma_{w}"]) for w in windows}
    least = np.full(len(price), np.nan)
    for x in out.values():
        least = np.fmin(least, np.abs(x))
    out["relative_dist_20_50"] = div(ma["ma_20"] - ma["ma_50"], ma["ma_50"])
    return out | {f"{c}_z": zscore(x, 60, 20) for c, x in out.items()} | {"min_pct_dist_ma": least}


def range_breakout(f: Arrays, windows) -> Arrays:
    o, h, lo, c, v = (f[k] for k in ("open", "high", "low", "close", "volume"))
    before, wide = lag(c), h - lo
    gap = o - before
    filled = np.where(gap > 1e-12, clip((o - lo) / np.where(gap > 1e-12, gap, 1.0), 0.0, 1.0), np.where(gap < -1e-12, clip((h - o) / np.where(gap < -1e-12, -gap, 1.0), 0.0, 1.0), 0.0))
    tr = true_range(f)
    out = {"true_range": tr, "hl_range": wide, "gap_pct": div(c, before) - 1, "overnight_ret": div(o, before) - 1, "gap_fill_frac": filled, "tr_pct_close": div(tr, c), "hl_range_pct_close": div(wide, c)}
    for w in windows:
        top, bottom = high(h, w), low(lo, w)
        reach = top - bottom
        out |= {
            f"{w}d_high": top,
            f"{w}d_low": bottom,
            f"{w}d_range": reach,
            f"{w}d_range_pct_close": div(reach, c),
            f"pos_in_{w}d_range": div(c - bottom, reach),
            f"breakout_up_{w}d": (c > lag(top)).astype(float),
            f"breakout_dn_{w}d": (c < lag(bottom)).astype(float),
            f"range_expansion_{w}d": div(reach, lag(reach)) - 1,
            f"range_z_{w}d": clip(zscore(reach, 60, 20), -10.0, 10.0),
        }
    return out | {"range_x_rvol20": div(out["hl_range_pct_close"], div(v, mean(v, 20, 5)))}


def volume(f: Arrays) -> Arrays:
    c, price, v = f["close"], f["adjclose"], f["volume"]
    dollar, shock, step = price * v, zscore(v, 20), zero(np.sign(diff(price))) * v
    out = {"vol_ma_20": mean(v, 20, 5), "vol_ma_50": mean(v, 50, 10), "vol_z_20": zscore(v, 20, 5), "vol_z_60": zscore(v, 60, 15), "dollar_vol_ma_20": mean(dollar, 20, 5)}
    # a running sum is null until its first value
    obv = np.where(np.cumsum(~np.isnan(step)) > 0, np.cumsum(zero(step)), np.nan)
    out |= {"rvol_20": div(v, out["vol_ma_20"]), "rvol_50": div(v, out["vol_ma_50"]), "rdollar_vol_20": div(dollar, out["dollar_vol_ma_20"]), "obv": obv, "obv_z_60": zscore(obv, 60, 20)}
    return out | {"volume_vol_of_vol_20d": std(diff(log(v)), 20, 5), "volshock_z": shock, "volshock_dir": shock * np.sign(c - lag(c, 10))}


def liquidity(f: Arrays, windows) -> Arrays:
    o, h, lo, c, v = (f[k] for k in ("open", "high", "low", "close", "volume"))
    tiny = lambda x: np.fmax(x, 1e-8)
    before, wide = lag(c), tiny(h - lo)
    square = log(ratio(h, tiny(lo))) ** 2
    root = 3 - 2 * math.sqrt(2)
    beta, gamma = square + lag(square), log(np.fmax(h, lag(h)) / tiny(np.fmin(lo, lag(lo)))) ** 2
    a = np.where(np.isnan(before), np.nan, (np.sqrt(2 * beta) - np.sqrt(beta)) / root - np.sqrt(gamma / root))
    step, move, inside = diff(c), np.abs(o - before), np.abs(c - o)
    n, product, _ = moments(step, 20, lag(step))
    cov = np.where(n >= 10, product / np.maximum(n - 1, 1), np.nan)
    typical = (h + lo + c) / 3 * v
    out = {
        "hl_spread_proxy": ratio(wide, c),
        "cs_spread_est": np.where(np.isnan(a), np.nan, np.fmax(2 * (np.exp(a) - 1) / (1 + np.exp(a)), 0.0)),
        "roll_spread_est": np.where(np.isnan(cov), np.nan, 2 * np.sqrt(np.fmax(-cov, 0.0)) / tiny(c)),
        "overnight_ratio": move / (move + inside + 1e-8),
        "range_efficiency": np.fmin(inside / wide, 1.0),
        "upper_shadow_ratio": (h - np.fmax(o, c)) / wide,
        "lower_shadow_ratio": (np.fmin(o, c) - lo) / wide,
        "volume_direction": np.sign(c - o) * v,
        "volume_trend_10d": mean(v, 5, 2) / np.fmax(mean(v, 20, 5), 1.0),
        "pv_divergence_5d": (div(c, lag(c, 5)) - 1) - (div(v, lag(v, 5)) - 1),
        "zero_vol_pct_20d": mean(np.where(np.isnan(v), np.nan, (v == 0).astype(float)), 20, 10),
        "amihud_illiq": mean(np.abs(div(c, before) - 1) / np.fmax(c * v, 1.0) * 1e9, 5, 1),
    }
    for w in windows:
        fair = total(typical, w, w // 2) / np.fmax(total(v, w, w // 2), 1.0)
        off = (c - fair) / tiny(fair)
        out |= {f"rel_volume_{w}d": v / np.fmax(mean(v, w, w // 2), 1.0), f"vwap_dist_{w}d": off * 100, f"vwap_dist_{w}d_zscore": clip(off / tiny(std(off, 60, 20, 1)), -5.0, 5.0)}
    ill, spread = out["amihud_illiq"], out["hl_spread_proxy"]
    own = lambda x: (x - mean(x, 60, 20)) / tiny(std(x, 60, 20, 1))
    score = clip((own(spread) + own(ill) - (out["rel_volume_20d"] - 1)) / 3, -3.0, 3.0)
    level = mean(score, 20, 10)
    regime = np.where(level <= -0.5, 1.0, np.where(level <= 0.5, 2.0, np.where(np.isnan(level), np.nan, 3.0)))
    return out | {"amihud_illiq_ratio": ill / tiny(mean(ill, 20, 10)), "illiquidity_score": score, "liquidity_regime": regime}


def drawdown(f: Arrays, windows) -> Arrays:
    p = f["close"]
    top = np.fmax.accumulate(p) if len(p) else p
    k = np.arange(1, len(p) + 1, dtype=float)
    out = {"drawdown_expanding": div(p - top, top)}
    for w in windows:
        hi, lo = high(p, w), low(p, w)
        down, up = div(p - hi, hi), div(p - lo, lo)
        at = np.maximum.accumulate(np.where(p >= hi - 1e-12, k, 1.0)) if len(p) else k
        out |= {f"drawdown_{w}d": down, f"recovery_{w}d": up, f"days_since_high_{w}d": k - at, f"drawdown_{w}d_z": clip(zscore(down, 252, 60, found=running), -5.0, 5.0), f"recovery_{w}d_z": clip(zscore(up, 252, 60, found=running), -5.0, 5.0), f"drawdown_velocity_{w}d": diff(down, 5), f"days_since_high_{w}d_norm": clip((k - at) / w, 0.0, 1.0)}
        if w == 60:
            out |= {"drawdown_regime": np.where(down > -0.05, 0.0, np.where(down > -0.15, 1.0, 2.0)), "hl_range_position_60d": div(p - lo, hi - lo)}
    return out


def bollinger(f: Arrays, w: int = 20, k: float = 2.0) -> Arrays:
    width = div(2 * k * std(f["close"], w, w), mean(f["close"], w, w))
    return {"bb_width": width, "bb_width_z60": zscore(width, 60)}


def choppiness(f: Arrays, w: int = 14) -> Arrays:
    spread = high(f["high"], w, w) - low(f["low"], w, w)
    summed = div(total(true_range(f), w, w), np.where(spread > 0, 1.0, np.nan))
    return {f"chop_{w}": np.where(spread > 0, 100 * np.log10(np.where(summed > 0, summed, np.nan) / np.where(spread > 0, spread, 1.0)) / math.log10(w), np.nan)}


# recursions


def ewm(x: np.ndarray, span: float) -> np.ndarray:
    """Exponential mean of span from the first value on."""
    return pd.Series(x).ewm(span=span, adjust=False).mean().to_numpy()


def ewms(columns: Arrays, span: float, least: int = 0) -> Arrays:
    """Exponential means of several columns, null until least values are there."""
    names = list(columns)
    x = np.stack([np.asarray(columns[c], float) for c in names]) if names else np.empty((0, 0))
    k, n = x.shape
    if not x.size:
        return {c: v for c, v in zip(names, x, strict=True)}
    there = np.isfinite(x)
    start = np.where(there.any(axis=1), there.argmax(axis=1), n)
    behind = np.arange(n) - start[:, None]
    whole = (there | (behind < 0) & np.isnan(x)).all(axis=1)
    alpha = 2 / (span + 1)
    powers, square = _decay(alpha)
    step = np.where(there, x, 0.0) * alpha
    begun = np.flatnonzero(start < n)
    step[begun, start[begun]] = x[begun, start[begun]]
    out, carried = np.empty_like(x), np.zeros(k)
    for i in range(0, n, STRETCH):
        j = min(i + STRETCH, n)
        out[:, i:j] = step[:, i:j] @ square[: j - i, : j - i] + carried[:, None] * powers[1 : j - i + 1]
        carried = out[:, j - 1]
    out[behind < max(least - 1, 0)] = np.nan
    # a gap changes the weights, and an infinite value spreads in a product
    other = [c for c, w in zip(names, whole, strict=True) if not w]
    slow = pd.DataFrame({c: columns[c] for c in other}).ewm(span=span, adjust=False, min_periods=least).mean() if other else {}
    return {c: slow[c].to_numpy() if not w else v for c, w, v in zip(names, whole, out, strict=True)}


#: Rows that an exponential mean takes at a time, as one product.
STRETCH = 32


@functools.cache
def _decay(alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Powers of 1 - alpha, and what each row of a stretch leaves to the rows from it on."""
    powers = (1 - alpha) ** np.arange(STRETCH + 1)
    apart = np.subtract.outer(np.arange(STRETCH), np.arange(STRETCH)).T
    return powers, np.where(apart >= 0, powers[np.maximum(apart, 0)], 0.0)


def _seed(x: np.ndarray, n: int) -> np.ndarray | None:
    """x with the mean of its first n values in place of the n-th and null before; none if there are fewer."""
    there = np.flatnonzero(~np.isnan(x))
    if len(there) < n:
        return None
    out = x.copy()
    out[: there[n - 1]], out[there[n - 1]] = np.nan, x[there[:n]].mean()
    return out


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    """Wilder's mean; null until n values are there."""
    out = _seed(x, n)
    return np.full(len(x), np.nan) if out is None else pd.Series(out).ewm(alpha=1 / n, adjust=False).mean().to_numpy()


def seeded(x: np.ndarray, n: int) -> np.ndarray:
    """Exponential mean of span n that begins with the plain mean of the first n values."""
    out = _seed(x, n)
    return np.full(len(x), np.nan) if out is None else ewm(out, n)


def rsi(price: np.ndarray, n: int) -> np.ndarray:
    step = diff(price)
    up, down = wilder(np.maximum(step, 0.0), n), wilder(np.maximum(-step, 0.0), n)
    return ratio(100 * up, up + down)


def adx(f: Arrays, n: int = 14) -> Arrays:
    up, down = diff(f["high"]), -diff(f["low"])
    there = ~np.isnan(up)
    plus = np.where(there, np.where((up > down) & (up > 0), up, 0.0), np.nan)
    minus = np.where(np.isnan(down), np.nan, np.where((down > up) & (down > 0), down, 0.0))
    width = wilder(np.where(there, true_range(f), np.nan), n)
    p, m = ratio(100 * wilder(plus, n), width), ratio(100 * wilder(minus, n), width)
    return {f"adx_{n}": wilder(ratio(100 * np.abs(p - m), p + m), n), f"di_plus_{n}": p, f"di_minus_{n}": m}


def atr(f: Arrays, n: int = 14) -> Arrays:
    a = wilder(true_range(f), n)
    return {f"atr{n}": a, "atr_percent": a / f["close"]}


def squeeze(f: Arrays, n: int = 20, k: float = 2.0, narrow: float = 1.5, wide: float = 2.0, cap: int = 50) -> Arrays:
    """Whether the band of k deviations around the mean lies inside a channel around the smoothed price, how far it is compressed, since when, and whether it
    has just left."""
    close = f["close"]
    middle, dev = mean(close, n, n), std(close, n, n)
    base, reach = seeded(close, n), seeded(true_range(f), n)
    inside = lambda m: ((middle + k * dev < base + m * reach) & (middle - k * dev > base - m * reach)).astype(float)
    on, width, at = inside(narrow), 2 * narrow * reach, np.arange(len(close))
    since = at - np.maximum.accumulate(np.where(on == 0, at, -1)) if len(at) else at
    return {f"squeeze_on_{n}": on, f"squeeze_on_wide_{n}": inside(wide), f"squeeze_intensity_{n}": clip(ratio(width - 2 * k * dev, width), -1.0, 1.0), f"squeeze_release_{n}": ((lag(on) == 1) & (on == 0)).astype(float), f"days_in_squeeze_{n}": np.minimum(since, cap).astype(float)}


def divergences(f: Arrays, windows) -> Arrays:
    price, rsi_ = f["close"], f["rsi_14"]
    series = {"price": price, "rsi": rsi_, "macd": f["macd_histogram"], "trend": f["trend_score_sign"], "vol": f["vol_regime_ema10"]}
    apart = (diff(price) > 0).astype(float) - (diff(rsi_) > 0).astype(float)
    out = {}
    for w in windows:
        turn = {}
        for name, x in series.items():
            change = diff(x, w)
            turn[name] = np.tanh(change / np.maximum(std(change, 60, 20, 1), 1e-8))
        out |= {f"rsi_price_div_{w}d": turn["price"] - turn["rsi"], f"rsi_price_div_cum_{w}d": ewm(total(apart, w, w // 2), 5) / w, f"macd_price_div_{w}d": turn["price"] - turn["macd"], f"trend_rsi_div_{w}d": turn["trend"] - turn["rsi"], f"vol_trend_div_{w}d": turn["vol"] - turn["trend"]}
    return out


def gaps(f: Arrays) -> Arrays:
    percent = f["atr_percent"]
    return {"gap_atr_ratio": div(f["gap_pct"], percent), "gap_atr_ratio_raw": div(f["open"] - lag(f["close"]), f["atr14"]), "atr_percent_chg_5": div(diff(percent, 5), lag(percent, 5))}


# against benchmarks


def beta_alpha(y: np.ndarray, x: np.ndarray, w: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling beta of y on x and what it leaves, over rows where both are there."""
    n, product, square = moments(x, w, y)
    over = np.maximum(n - 1, 1)
    beta = np.where(n >= max(2, least), div(product / over, square / over), np.nan)
    return beta, y - beta * x


def relative_strength(a: np.ndarray, b: np.ndarray, name: str, norm: tuple[int, int], z: tuple[int, int]) -> Arrays:
    """Price by benchmark, against its own mean, its z-score by sample deviation and the slope of its log over ten rows."""
    rs = div(a, b)
    return {name: rs, f"{name}_norm": div(rs, mean(rs, *norm)) - 1, f"{name}_z{z[0]}": zscore(rs, *z, ddof=1), f"{name}_slope10": regularised_slope(log(rs), 10)}


def regularised_slope(x: np.ndarray, w: int, alpha: float = 0.01) -> np.ndarray:
    """Slope of x by place in the last w rows, with alpha added to the spread of the places; max(3, w / 2) values must be there."""
    k, n = np.arange(1, len(x) + 1, dtype=float), counts(x, w)
    sums = {c: total(v, w, 1) for c, v in {"x": x, "kx": k * x, "k": np.where(np.isnan(x), np.nan, k)}.items()}
    middle = k - (w - 1) / 2
    product = sums["kx"] - middle * sums["x"] - sums["x"] / np.where(n > 0, n, 1.0) * (sums["k"] - middle * n)
    return np.where(n >= max(3, w // 2), product / (w * (w * w - 1) / 12 + alpha), np.nan)


def strength_pass(f: Arrays) -> Arrays:
    """Relative strength index by exponential means and MACD histogram of each column."""
    steps = {c: diff(x) for c, x in f.items()}
    up, down = (ewms({c: np.where(s > 0, s, 0.0) for c, s in signed.items()}, 14, 14) for signed in (steps, {c: -s for c, s in steps.items()}))
    fast, slow = ewms(f, 12, 12), ewms(f, 26, 26)
    line = {c: fast[c] - slow[c] for c in f}
    mark, out = ewms(line, 9, 9), {}
    for c in f:
        out |= {f"{c}_rsi14": 100 - 100 / (1 + ratio(up[c], down[c])), f"{c}_macd_hist": line[c] - mark[c]}
    return out
