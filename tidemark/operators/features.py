"""Per-symbol feature blocks as plain row frames: one shuffle by symbol serves all blocks of a chain."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import by_symbol, clip, col, diff, div, high, lag, low, mean, rolled, running, std0, std1, total, zscore

MA = (10, 20, 30, 50, 75, 100, 150, 200)
#: Rows of a frame from which on running sums are worth their rounding.
LONG = 100


def returns(bars: DataFrame) -> DataFrame:
    """ret: difference of the log of the adjusted close."""
    log = F.when(F.col("adjclose") > 0, F.log("adjclose"))
    return bars.withColumn("ret", log - F.lag(log).over(by_symbol()))


def moving_averages(bars: DataFrame, periods=MA, price: str = "adjclose") -> DataFrame:
    """ma_{p} for each period. Short frames slide, which adds the same numbers in the same order; long ones are differences of running sums."""
    out = bars.withColumns({f"ma_{p}": mean(price, p, max(5, p // 2)) for p in periods if p < LONG})
    return running(out, price, {f"ma_{p}": ("mean", p, max(5, p // 2)) for p in periods if p >= LONG})


def trend(bars: DataFrame, periods=MA, slope: int = 20, eps: float = 1e-5) -> DataFrame:
    """Slopes of the moving averages, their signs, the mean sign and how far the signs agree."""
    out = moving_averages(bars, periods)
    out = out.withColumns({f"pct_slope_ma_{p}": div(f"ma_{p}", lag(f"ma_{p}", slope)) - 1 for p in periods})
    out = out.withColumns({f"sign_ma_{p}": F.when(F.col(f"pct_slope_ma_{p}") > eps, 1.0).when(F.col(f"pct_slope_ma_{p}") < -eps, -1.0).otherwise(0.0) for p in periods})
    signs = F.array(*(f"sign_ma_{p}" for p in periods))
    up = F.size(F.filter(signs, lambda s: s > 0))
    down = F.size(F.filter(signs, lambda s: s < 0))
    out = out.withColumns({"trend_score_granular": F.coalesce(div(up - down, up + down), F.lit(0.0)), "trend_alignment": div(up, up + down)})
    out = out.withColumn("trend_score_sign", F.signum("trend_score_granular"))
    return out.withColumn("trend_score_slope", diff("trend_score_granular"))


def volatility(bars: DataFrame) -> DataFrame:
    """Realised volatility at four scales, ratios, z-score, volatility of volatility and normalised slopes. Needs ret."""
    out = running(bars, "ret", {f"rv_{w}": ("dev", w, max(5, w // 3)) for w in (10, 20, 60, 100)})
    out = out.withColumns({"rv_ratio_10_60": div("rv_10", "rv_60"), "rv_ratio_20_100": div("rv_20", "rv_100"), "rv_z_60": zscore("rv_20", 60), "rv_step": diff("rv_20")})
    out = out.withColumns({"vol_regime": F.log1p("rv_ratio_20_100"), "rv_vol_of_vol_20d": std0("rv_step", 20, 5), "rv60_slope_norm": (div("rv_60", lag("rv_60", 20)) - 1) / 20, "rv100_slope_norm": (div("rv_100", lag("rv_100", 20)) - 1) / 20})
    return out.drop("rv_step")


def relative_volatility(table: DataFrame) -> DataFrame:
    """The median volatility ratio of each date, and each symbol's regime less it."""
    out = table.withColumn("vol_regime_cs_median", F.log1p(F.percentile("rv_ratio_20_100", 0.5).over(Window.partitionBy("date"))))
    return out.withColumn("vol_regime_rel", F.col("vol_regime") - F.col("vol_regime_cs_median"))


def quiet_trend(table: DataFrame, regime: str = "vol_regime") -> DataFrame:
    """The trend score where volatility is below its own median of a year, else 0."""
    frame = by_symbol().rowsBetween(-251, 0)
    middle = F.when(F.count(regime).over(frame) >= 50, F.percentile(regime, 0.5).over(frame))
    return table.withColumn("quiet_trend", F.when(F.col(regime) < middle, F.col("trend_score_granular")).otherwise(0.0))


def distance(bars: DataFrame) -> DataFrame:
    """Distance of the price to four moving averages, with z-scores, the least of them, and of the averages to each other."""
    windows = (20, 50, 100, 200)
    out = moving_averages(bars, windows)
    out = out.withColumns({f"pct_dist_ma_{w}": div(F.col("adjclose") - F.col(f"ma_{w}"), f"ma_{w}") for w in windows} | {"relative_dist_20_50": div(F.col("ma_20") - F.col("ma_50"), "ma_50")})
    out = rolled(out, {f"{c}_z": ("z", c, 60, 20) for c in [*(f"pct_dist_ma_{w}" for w in windows), "relative_dist_20_50"]})
    return out.withColumn("min_pct_dist_ma", F.array_min(F.array(*(F.abs(f"pct_dist_ma_{w}") for w in windows))))


def true_range(bars: DataFrame) -> DataFrame:
    before = lag("close")
    return bars.withColumn("true_range", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def range_breakout(bars: DataFrame, windows=(5, 10, 20)) -> DataFrame:
    """Ranges, gaps and breakouts; breakouts are 0 while there is nothing to break out of."""
    out = true_range(bars).withColumn("prev_close", lag("close"))
    gap = F.col("open") - F.col("prev_close")
    filled = F.when(gap > 1e-12, clip((F.col("open") - F.col("low")) / gap, 0.0, 1.0)).when(gap < -1e-12, clip((F.col("high") - F.col("open")) / -gap, 0.0, 1.0)).otherwise(0.0)
    out = out.withColumns({"hl_range": F.col("high") - F.col("low"), "gap_pct": div("close", "prev_close") - 1, "overnight_ret": div("open", "prev_close") - 1, "gap_fill_frac": filled, "tr_pct_close": div("true_range", "close")})
    out = out.withColumn("hl_range_pct_close", div("hl_range", "close"))
    out = rolled(out, {f"{w}d_{c}": (c, c, w, max(2, w // 3)) for w in windows for c in ("high", "low")} | {"__volume": ("mean", "volume", 20, 5)})
    out = out.withColumns({f"{w}d_range": F.col(f"{w}d_high") - F.col(f"{w}d_low") for w in windows})
    out = rolled(out, {f"__z{w}": ("z", f"{w}d_range", 60, 20) for w in windows})
    wide = {}
    for w in windows:
        wide |= {
            f"{w}d_range_pct_close": div(f"{w}d_range", "close"),
            f"pos_in_{w}d_range": div(F.col("close") - F.col(f"{w}d_low"), f"{w}d_range"),
            f"breakout_up_{w}d": F.coalesce((F.col("close") > lag(f"{w}d_high")).cast("double"), F.lit(0.0)),
            f"breakout_dn_{w}d": F.coalesce((F.col("close") < lag(f"{w}d_low")).cast("double"), F.lit(0.0)),
            f"range_expansion_{w}d": div(f"{w}d_range", lag(f"{w}d_range")) - 1,
            f"range_z_{w}d": clip(f"__z{w}", -10.0, 10.0),
        }
    wide["range_x_rvol20"] = div("hl_range_pct_close", div("volume", "__volume"))
    return out.withColumns(wide).drop("prev_close", "__volume", *(f"__z{w}" for w in windows))


def volume(bars: DataFrame) -> DataFrame:
    """Volume averages, z-scores, relative and dollar volume, on-balance volume, volatility of log volume, volume shock."""
    v = F.col("volume")
    out = bars.withColumns({"vol_ma_20": mean("volume", 20, 5), "vol_ma_50": mean("volume", 50, 10), "vol_z_20": zscore("volume", 20, 5), "vol_z_60": zscore("volume", 60, 15), "dollar": F.col("adjclose") * v, "step": F.coalesce(F.signum(diff("adjclose")), F.lit(0.0)) * v, "log_step": diff(F.when(v > 0, F.log(v))), "shock": zscore("volume", 20), "turn": F.signum(F.col("close") - lag("close", 10))})
    out = out.withColumns({"rvol_20": div(v, "vol_ma_20"), "rvol_50": div(v, "vol_ma_50"), "dollar_vol_ma_20": mean("dollar", 20, 5), "obv": F.sum("step").over(by_symbol().rowsBetween(Window.unboundedPreceding, 0)), "volume_vol_of_vol_20d": std0("log_step", 20, 5), "volshock_z": F.col("shock"), "volshock_dir": F.col("shock") * F.col("turn")})
    return out.withColumns({"rdollar_vol_20": div("dollar", "dollar_vol_ma_20"), "obv_z_60": zscore("obv", 60, 20)}).drop("dollar", "step", "log_step", "shock", "turn")


def liquidity(bars: DataFrame, windows=(5, 10, 20)) -> DataFrame:
    """Spread estimates from ranges and serial covariance, intraday structure, VWAP distance, illiquidity and its regime."""
    tiny = lambda x: F.greatest(col(x), F.lit(1e-8))
    spread = tiny(F.col("high") - F.col("low"))
    base = bars.withColumns({"prev": lag("close"), "hl": spread, "log_hl_sq": F.pow(F.log(F.col("high") / tiny("low")), 2), "h2": F.greatest("high", lag("high")), "l2": F.least("low", lag("low")), "dp": diff("close"), "tpv": (F.col("high") + F.col("low") + F.col("close")) / 3 * F.col("volume")})
    root = 3 - 2 * math.sqrt(2)
    beta = F.col("log_hl_sq") + lag("log_hl_sq")
    gamma = F.pow(F.log(F.col("h2") / tiny("l2")), 2)
    base = base.withColumns({"a": F.when(lag("close").isNotNull(), (F.sqrt(2 * beta) - F.sqrt(beta)) / root - F.sqrt(gamma / root)), "dp1": lag("dp"), "move": F.abs(F.col("open") - F.col("prev"))})
    frame = by_symbol().rowsBetween(-19, 0)
    both = F.when(F.col("dp").isNotNull() & F.col("dp1").isNotNull(), F.col("dp"))
    cov = F.when(F.count(both).over(frame) >= 10, F.covar_samp("dp", "dp1").over(frame))
    inside = F.abs(F.col("close") - F.col("open"))
    out = base.withColumns(
        {
            "hl_spread_proxy": F.col("hl") / F.col("close"),
            "cs_spread_est": F.when(F.col("a").isNotNull(), F.greatest(2 * (F.exp("a") - 1) / (1 + F.exp("a")), F.lit(0.0))),
            "roll_spread_est": F.when(cov.isNotNull(), 2 * F.sqrt(F.greatest(-cov, F.lit(0.0))) / tiny("close")),
            "overnight_ratio": F.col("move") / (F.col("move") + inside + 1e-8),
            "range_efficiency": F.least(inside / F.col("hl"), F.lit(1.0)),
            "upper_shadow_ratio": (F.col("high") - F.greatest("open", "close")) / F.col("hl"),
            "lower_shadow_ratio": (F.least("open", "close") - F.col("low")) / F.col("hl"),
            "volume_direction": F.signum(F.col("close") - F.col("open")) * F.col("volume"),
            "volume_trend_10d": mean("volume", 5, 2) / F.greatest(mean("volume", 20, 5), F.lit(1.0)),
            "pv_divergence_5d": (div("close", lag("close", 5)) - 1) - (div("volume", lag("volume", 5)) - 1),
            "illiq": F.abs(div("close", "prev") - 1) / F.greatest(F.col("close") * F.col("volume"), F.lit(1.0)) * 1e9,
            "zero_vol_pct_20d": mean((F.col("volume") == 0).cast("double"), 20, 10),
        }
        | {f"vwap_off_{w}": total("tpv", w, w // 2) / F.greatest(total("volume", w, w // 2), F.lit(1.0)) for w in windows}
        | {f"rel_volume_{w}d": F.col("volume") / F.greatest(mean("volume", w, w // 2), F.lit(1.0)) for w in windows}
    )
    out = out.withColumns({f"vwap_off_{w}": (F.col("close") - F.col(f"vwap_off_{w}")) / tiny(f"vwap_off_{w}") for w in windows} | {"amihud_illiq": mean("illiq", 5, 1)})
    out = out.withColumns({f"vwap_dist_{w}d": F.col(f"vwap_off_{w}") * 100 for w in windows} | {f"vwap_dist_{w}d_zscore": clip(F.col(f"vwap_off_{w}") / tiny(std1(f"vwap_off_{w}", 60, 20)), -5.0, 5.0) for w in windows} | {"amihud_illiq_ratio": F.col("amihud_illiq") / tiny(mean("amihud_illiq", 20, 10)), "sz": (F.col("hl_spread_proxy") - mean("hl_spread_proxy", 60, 20)) / tiny(std1("hl_spread_proxy", 60, 20)), "az": (F.col("amihud_illiq") - mean("amihud_illiq", 60, 20)) / tiny(std1("amihud_illiq", 60, 20))})
    out = out.withColumn("illiquidity_score", clip((F.col("sz") + F.col("az") - (F.col("rel_volume_20d") - 1)) / 3, -3.0, 3.0))
    level = mean("illiquidity_score", 20, 10)
    out = out.withColumn("liquidity_regime", F.when(level <= -0.5, 1.0).when(level <= 0.5, 2.0).when(level.isNotNull(), 3.0))
    return out.drop("prev", "hl", "log_hl_sq", "h2", "l2", "dp", "dp1", "tpv", "a", "move", "illiq", "sz", "az", *(f"vwap_off_{w}" for w in windows))


def runs(table: DataFrame, flag: str, name: str, cap: int | None = None) -> DataFrame:
    """name: consecutive rows for which flag is true, this one included, at most cap."""
    before = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    out = table.withColumn("__island", F.sum(F.when(F.col(flag), 0).otherwise(1)).over(before))
    held = F.sum(F.when(F.col(flag), 1).otherwise(0)).over(Window.partitionBy("symbol", "__island").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    held = F.when(F.col(flag), held).otherwise(0)
    return out.withColumn(name, F.least(held, F.lit(cap)) if cap else held).drop("__island")


def drawdown(bars: DataFrame, windows=(20, 60, 120), price: str = "close") -> DataFrame:
    """Drawdown and recovery at three scales with z-scores, rows since the high, velocity; all-time drawdown and a regime."""
    p = F.col(price)
    out = bars.withColumns({f"hi_{w}": high(price, w) for w in windows} | {f"lo_{w}": low(price, w) for w in windows} | {"top": F.max(price).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))})
    out = out.withColumns({f"drawdown_{w}d": div(p - F.col(f"hi_{w}"), f"hi_{w}") for w in windows} | {f"recovery_{w}d": div(p - F.col(f"lo_{w}"), f"lo_{w}") for w in windows} | {"__k": F.row_number().over(by_symbol())})
    # the row number at the last high; before the first there is row 1
    at = lambda w: F.max(F.when(p >= F.col(f"hi_{w}") - 1e-12, F.col("__k"))).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumns({f"at_{w}": at(w) for w in windows})
    out = out.withColumns({f"days_since_high_{w}d": (F.col("__k") - F.coalesce(f"at_{w}", F.lit(1))).cast("double") for w in windows})
    wide = {"drawdown_expanding": div(p - F.col("top"), "top"), "drawdown_regime": F.when(F.col("drawdown_60d") > -0.05, 0.0).when(F.col("drawdown_60d") > -0.15, 1.0).otherwise(2.0), "hl_range_position_60d": div(p - F.col("lo_60"), F.col("hi_60") - F.col("lo_60"))}
    for w in windows:
        for x in (f"drawdown_{w}d", f"recovery_{w}d"):
            out = running(out, x, {f"{x}_z": ("z", 252, 60)})
            wide[f"{x}_z"] = clip(f"{x}_z", -5.0, 5.0)
        wide |= {f"drawdown_velocity_{w}d": diff(f"drawdown_{w}d", 5), f"days_since_high_{w}d_norm": clip(F.col(f"days_since_high_{w}d") / w, 0.0, 1.0)}
    return out.withColumns(wide).drop("top", "__k", *(f"{x}_{w}" for w in windows for x in ("hi", "lo", "at")))


def direction_divergence(table: DataFrame, a: str, b: str, w: int, name: str) -> DataFrame:
    """tanh of a's change over w rows in units of its own deviation, less the same of b."""
    out = table.withColumns({"__a": diff(a, w), "__b": diff(b, w)})
    unit = lambda x: F.tanh(F.col(x) / F.greatest(std1(x, 60, 20), F.lit(1e-8)))
    return out.withColumn(name, unit("__a") - unit("__b")).drop("__a", "__b")


def cumulative_divergence(table: DataFrame, a: str, b: str, w: int, name: str) -> DataFrame:
    """Rolling count of rows on which a rose and b did not, less the opposite, by w; its smoothing is a kernel."""
    up = lambda x: F.coalesce((diff(x) > 0).cast("double"), F.lit(0.0))
    return table.withColumn("__d", up(a) - up(b)).withColumn(name, total("__d", w, w // 2) / w).drop("__d")


def bollinger(bars: DataFrame, w: int = 20, k: float = 2.0) -> DataFrame:
    """Width of the band of k deviations by its middle, and its z-score."""
    out = bars.withColumn("bb_width", div(2 * k * std0("close", w, w), mean("close", w, w)))
    return out.withColumn("bb_width_z60", zscore("bb_width", 60))


def choppiness(bars: DataFrame, w: int = 14) -> DataFrame:
    out = true_range(bars)
    spread = high("high", w, w) - low("low", w, w)
    return out.withColumn(f"chop_{w}", F.when(spread > 0, 100 * F.log10(total("true_range", w, w) / spread) / math.log10(w)))


def squeeze(bars: DataFrame, w: int = 20, k: float = 2.0, narrow: float = 1.5, wide: float = 2.0, cap: int = 50) -> DataFrame:
    """Whether the Bollinger band lies inside a channel of ATR multiples, how far, since when, and whether it has just left."""
    out = true_range(bars).withColumns({"__mid": mean("close", w, w), "__dev": std0("close", w, w)}).withColumn("__atr", mean("true_range", w, w))
    out = out.withColumns({"squeeze_on": F.coalesce(k * F.col("__dev") < narrow * F.col("__atr"), F.lit(False)), "squeeze_wide": F.coalesce(k * F.col("__dev") < wide * F.col("__atr"), F.lit(False)), "squeeze_intensity": div(k * F.col("__dev"), narrow * F.col("__atr"))})
    out = out.withColumn("squeeze_release", F.coalesce(lag("squeeze_on") & ~F.col("squeeze_on"), F.lit(False)))
    return runs(out, "squeeze_on", "squeeze_days", cap).drop("__mid", "__dev", "__atr")


def slope(table: DataFrame, x: str, w: int, name: str, least: int | None = None) -> DataFrame:
    """Least-squares slope of x by row over w rows."""
    out = table.withColumn("__n", F.row_number().over(by_symbol()).cast("double"))
    frame = by_symbol().rowsBetween(-(w - 1), 0)
    return out.withColumn(name, F.when(F.count(x).over(frame) >= (least or max(5, w // 3)), F.regr_slope(F.col(x), F.col("__n")).over(frame))).drop("__n")


def spread(table: DataFrame, x: str, prefix: str, windows=(20, 60, 120)) -> DataFrame:
    """Sums of a return spread over each window (a third of its rows must be there, at least 3), its z-score by sample deviation over the middle
    window (half, at least 10), and its slopes over the first two (half, at least 3)."""
    z = windows[1]
    out = table.withColumns({f"{prefix}_cum_{w}": total(x, w, max(3, w // 3)) for w in windows} | {f"{prefix}_z_{z}": zscore(x, z, min(z, max(10, z // 2)), sample=True)})
    for w in windows[:2]:
        out = slope(out, x, w, f"{prefix}_slope_{w}", min(w, max(3, w // 2)))
    return out


def prior_percentile(table: DataFrame, x: str, w: int, least: int, name: str) -> DataFrame:
    """Share of the w rows before that lie below x."""
    before = F.collect_list(x).over(by_symbol().rowsBetween(-w, -1))
    out = table.withColumn("__before", before)
    below = F.size(F.filter("__before", lambda v: v < F.col(x)))
    return out.withColumn(name, F.when(F.col(x).isNotNull() & (F.size("__before") >= least), below / F.size("__before") * 100)).drop("__before")


def lags(table: DataFrame, columns: list[str], days: list[int]) -> DataFrame:
    return table.withColumns({f"{c}_lag{k}d": lag(c, k) for c in columns for k in days})


def parse_lags(spec: str) -> list[int]:
    """"1,2,5-8" as a sorted list."""
    out: set[int] = set()
    for part in filter(None, (p.strip() for p in spec.split(","))):
        a, _, b = part.partition("-")
        out.update(range(int(a), int(b or a) + 1))
    return sorted(out)


def regularised_slope(table: DataFrame, x: str, w: int, name: str, alpha: float = 0.01) -> DataFrame:
    """Slope of x by place in the last w rows, with alpha added to the spread of the places. Places are centred on the whole window,
    values on those that are there; max(3, w / 2) must be."""
    frame = by_symbol().rowsBetween(-(w - 1), 0)
    at = F.row_number().over(by_symbol()).cast("double")
    out = table.withColumn("__k", at).withColumn("__kx", F.col("__k") * F.col(x)).withColumn("__kn", F.when(F.col(x).isNotNull(), F.col("__k")))
    sums = {"__c": F.count(x).over(frame), "__sx": F.sum(x).over(frame), "__skx": F.sum("__kx").over(frame), "__sk": F.sum("__kn").over(frame)}
    out = out.withColumns(sums)
    middle = F.col("__k") - (w - 1) / 2
    # sum of (k - middle) (x - mean x) over the rows that have x
    product = F.col("__skx") - middle * F.col("__sx") - F.col("__sx") / F.col("__c") * (F.col("__sk") - middle * F.col("__c"))
    return out.withColumn(name, F.when(F.col("__c") >= max(3, w // 2), product / (w * (w * w - 1) / 12 + alpha))).drop("__k", "__kx", "__kn", *sums)


def divergence(table: DataFrame, pairs: dict[str, tuple[str, str]], windows=(10, 20)) -> DataFrame:
    """name_div_{w}d for each pair of columns and window."""
    for name, (a, b) in pairs.items():
        for w in windows:
            table = direction_divergence(table, a, b, w, f"{name}_div_{w}d")
    return table


def residual_block(table: DataFrame, x: str, w: int, least: int | None = None) -> DataFrame:
    """Mean, sum and deviation of residuals over w rows."""
    least = least or max(5, w // 3)
    return table.withColumns({"residual_mean": mean(x, w, least), "residual_cumret": total(x, w, least), "residual_vol": std1(x, w, least)})
