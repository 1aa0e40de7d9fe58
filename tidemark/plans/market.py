"""Whole blocks of series that the market shares, daily and weekly: volatility indices, a volatility fund, cross-asset signals, published series.

A block is one row a date under the symbol ALL, so its windows run in one task whatever the number of symbols; only attached() meets the bars, under
a checked broadcast. Values that are missing or not positive are carried on from the last good one; before the first there are nulls."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import by_symbol, diff, div, forward_fill, lag, mean, zscore
from ..operators import features as ft
from ..operators import kernels as kn
from ..operators import macro as mc
from ..operators import panel as pn

# The funds that stand for each role, first choice first.
ROLES = {
    "equity": ("SPY",),
    "gold": ("GLD",),
    "silver": ("SLV",),
    "long_bond": ("TLT",),
    "short_bond": ("SHY", "IEF", "BIL", "VGSH"),
    "high_yield": ("HYG",),
    "inv_grade": ("LQD",),
    "oil": ("USO",),
    "copper": ("COPX",),
    "dollar": ("UUP", "USDU"),
    "tech": ("XLK",),
    "cyclical": ("XLY",),
    "defensive": ("XLP",),
    "utilities": ("XLU",),
    "financials": ("XLF",),
}

# Names under which the volatility indices and funds come.
INDICES = {"vix": ("^VIX", "VIX", "$VIX", "CBOE:VIX"), "vxn": ("^VXN",)}
FUNDS = {"vxx": ("VXX", "VIXY")}

# Ratios, their two roles, and the name of the z-score if they have one.
RATIOS = {
    "gold_spy_ratio": ("gold", "equity", "gold_spy_ratio_zscore"),
    "copper_gold_ratio": ("copper", "gold", "copper_gold_zscore"),
    "yield_curve_proxy": ("long_bond", "short_bond", "yield_curve_zscore"),
    "credit_spread_proxy": ("high_yield", "inv_grade", "credit_spread_zscore"),
    "cyclical_defensive_ratio": ("cyclical", "defensive", None),
    "tech_spy_ratio": ("tech", "equity", None),
    "financials_utilities_ratio": ("financials", "utilities", None),
}

# Published series, the rows by which they come late, and what is made of them.
PUBLISHED = {
    "bamlh0a0hym2": (1, ("level", "change_5d", "change_20d", "zscore_60d", "percentile_252d")),
    "bamlc0a4cbbb": (1, ("level", "change_5d", "zscore_60d")),
    "dgs10": (1, ("level", "change_5d", "change_20d", "zscore_60d", "percentile_252d")),
    "dgs2": (1, ("level", "change_5d", "change_20d")),
    "t10y2y": (1, ("level", "change_5d", "zscore_60d", "percentile_252d")),
    "t10y3m": (1, ("level", "zscore_60d")),
    "dfedtaru": (1, ("level", "change_20d")),
    "icsa": (5, ("level", "change_4w", "zscore_52w", "percentile_104w")),
    "ccsa": (12, ("level", "change_4w", "zscore_52w")),
    "nfci": (7, ("level", "change_4w", "zscore_52w")),
    "vixcls": (1, ("level", "change_5d", "zscore_60d", "percentile_252d")),
}


@dataclass(frozen=True)
class Calendar:
    """Rows of a frequency. percentile, z, average, smooth: rows and how many values must be there; changes: rows back and the names they go by."""

    percentile: tuple[int, int]
    z: tuple[int, int]
    average: tuple[int, int]
    smooth: tuple[int, int]
    changes: tuple[tuple[int, str], tuple[int, str]]
    names: tuple[str, str, str, str]
    correlation: tuple[int, int]
    ratio_z: tuple[int, int]
    momentum: int
    dollar: tuple[int, int] | None
    published: Mapping[str, tuple[str, int, int]]


DAILY = Calendar(
    (252, 50), (60, 20), (20, 10), (10, 5), ((5, "5d"), (20, "20d")), ("252d", "60d", "ma20", "ema10"), (60, 30), (60, 20), 20, (252, 50),
    {"change_5d": ("chg5d", 5, 0), "change_20d": ("chg20d", 20, 0), "change_4w": ("chg4w", 20, 0), "zscore_60d": ("z60", 60, 20), "zscore_52w": ("z52w", 252, 60), "percentile_252d": ("pct252", 252, 50), "percentile_104w": ("pct104w", 504, 100)},
)
WEEKLY = Calendar(
    (52, 12), (12, 4), (4, 2), (4, 2), ((1, "1w"), (4, "4w")), ("52w", "12w", "ma4", "ema4"), (12, 6), (12, 6), 4, None,
    {"change_5d": ("chg5d", 1, 0), "change_20d": ("chg20d", 4, 0), "change_4w": ("chg4w", 4, 0), "zscore_60d": ("z60", 12, 3), "zscore_52w": ("z52w", 52, 13), "percentile_252d": ("pct252", 52, 14), "percentile_104w": ("pct104w", 104, 27)},
)


def carried(bars: DataFrame, roles: Mapping[str, Iterable[str]], price: str = "close") -> DataFrame:
    """ALL, date and a column for each role: the price of the first of its names that has any, carried on over gaps. A role without prices has no column."""
    roles = {role: tuple(names) for role, names in roles.items()}
    priced = bars.where(F.col("symbol").isin(sorted({n for names in roles.values() for n in names})) & (F.col(price) > 0))
    have = {r[0] for r in priced.select("symbol").distinct().collect()}  # no more than the names asked for
    first = {role: next((n for n in names if n in have), None) for role, names in roles.items()}
    made = {role: F.max(F.when(F.col("symbol") == name, F.col(price))) for role, name in first.items() if name}
    wide = priced.groupBy("date").agg(F.count("*").alias("__n"), *(v.alias(k) for k, v in made.items())).drop("__n").withColumn("symbol", F.lit("ALL"))
    return wide.withColumns({c: forward_fill(c) for c in made}).select("symbol", "date", *made)


def weekly_last(table: DataFrame) -> DataFrame:
    """The last value of each column in each week, dated by its Friday."""
    columns = [c for c in table.columns if c not in {"symbol", "date"}]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date"))).alias(c) for c in columns]
    return table.groupBy("symbol", pn.week_end().alias("__week")).agg(*last).withColumnRenamed("__week", "date").select("symbol", "date", *columns)


def _percentile(table: DataFrame, x: str, w: int, least: int, name: str) -> DataFrame:
    """How much of the last w rows, this one not counted, lies below x; least values must be there, this one counted."""
    return ft.prior_percentile(table, x, w - 1, least - 1, name)


def volatility_indices(table: DataFrame, calendar: Calendar = DAILY) -> DataFrame:
    """The block of the index vix and, where the table has it, vxn: level, percentile, z-score, regime, ratio to the mean, changes, smoothed level, and
    spread, ratio and percentile of the second index."""
    percent, z, average, smooth = calendar.names
    out = _percentile(table, "vix", *calendar.percentile, f"vix_percentile_{percent}")
    made = {"vix_level": F.col("vix"), f"vix_zscore_{z}": zscore("vix", *calendar.z, sample=True), "vix_regime": mc.state("vix", mc.LEVELS), f"vix_{average}_ratio": div("vix", mean("vix", *calendar.average))}
    made |= {f"vix_change_{name}": div("vix", lag("vix", k)) - 1 for k, name in calendar.changes}
    if "vxn" in table.columns:
        out = _percentile(out, "vxn", *calendar.percentile, "vxn_percentile_252d")
        made |= {"vxn_level": F.col("vxn"), "vix_vxn_spread": F.col("vix") - F.col("vxn"), "vix_vxn_ratio": div("vix", "vxn")}
    span, least = calendar.smooth
    out = kn.grouped(out.withColumns(made), [(("vix",), (f"vix_{smooth}",), lambda f: [f["vix"].ewm(span=span, min_periods=least).mean()])])
    return out.drop("vix", "vxn")


def volatility_fund(table: DataFrame, x: str = "vxx", rsi: int = 14) -> DataFrame:
    """Returns over 5 and 20 rows and RSI by plain means of a fund; a row without one before it gains and loses nothing."""
    step = F.coalesce(diff(x), F.lit(0.0))
    out = table.withColumns({"__up": F.greatest(step, F.lit(0.0)), "__down": F.greatest(-step, F.lit(0.0))})
    ratio = div(mean("__up", rsi, rsi // 2), mean("__down", rsi, rsi // 2))
    out = out.withColumns({f"{x}_ret_5d": div(x, lag(x, 5)) - 1, f"{x}_ret_20d": div(x, lag(x, 20)) - 1, f"{x}_rsi_{rsi}": 100 - 100 / (1 + ratio)})
    return out.drop("__up", "__down", x)


def cross_assets(table: DataFrame, calendar: Calendar = DAILY, least_roles: int = 3) -> DataFrame:
    """Ratios of roles with z-scores, correlation of equity and bond returns, momentum of oil and the dollar, and the dollar's percentile; what lacks a
    role is left out, and with fewer than least_roles there is nothing but dates."""
    have = {c for c in table.columns if c in ROLES}
    if len(have) < least_roles:
        return table.select("symbol", "date")
    chosen = {n: (a, b, z) for n, (a, b, z) in RATIOS.items() if {a, b} <= have}
    out = table.withColumns({n: div(a, b) for n, (a, b, _) in chosen.items()})
    # the weekly block has no z-score of copper to gold
    scored = {z: n for n, (_, _, z) in chosen.items() if z and (calendar.dollar or n != "copper_gold_ratio")}
    rows = lambda n: (calendar.ratio_z[0], 4) if not calendar.dollar and n == "gold_spy_ratio" else calendar.ratio_z
    out = out.withColumns({z: zscore(n, *rows(n), sample=True) for z, n in scored.items()})
    made = [*chosen, *scored]
    if {"equity", "long_bond"} <= have:
        out = out.withColumns({"__e": div("equity", lag("equity")) - 1, "__b": div("long_bond", lag("long_bond")) - 1})
        out = mc.rolling_correlation(out, "__e", "__b", *calendar.correlation, "equity_bond_corr_60d")
        made.append("equity_bond_corr_60d")
    for role in ("oil", "dollar"):
        if role in have and (calendar.dollar or role == "dollar"):
            out = out.withColumn(f"{role}_momentum_20d", div(role, lag(role, calendar.momentum)) - 1)
            made.append(f"{role}_momentum_20d")
    if "dollar" in have and calendar.dollar:
        out = _percentile(out, "dollar", *calendar.dollar, "dollar_percentile_252d")
        made.append("dollar_percentile_252d")
    return out.select("symbol", "date", *made)


def published(table: DataFrame, config: Mapping[str, tuple[int, Iterable[str]]] = PUBLISHED, calendar: Calendar = DAILY, later: int = 0, prefix: str = "fred_") -> DataFrame:
    """What config asks to be made of each series the table has (columns by its lower-case name), each as many rows late as the series comes late, and
    later more. Weekly rows are all one row late."""
    out, late = table, {}
    for x, (delay, wanted) in config.items():
        if x not in table.columns:
            continue
        k = (1 if calendar is WEEKLY else delay) + later
        for how in wanted:
            if how == "level":
                late[f"{prefix}{x}"] = (F.col(x), k)
                continue
            tail, w, least = calendar.published[how]
            name = f"{prefix}{x}_{tail}"
            if how.startswith("percentile"):
                out = _percentile(out, x, w, least, name)
            else:
                out = out.withColumn(name, diff(x, w) if how.startswith("change") else zscore(x, w, least, sample=True))
            late[name] = (F.col(name), k)
    return out.select("symbol", "date", *(F.lag(v, k).over(by_symbol()).alias(name) if k else v.alias(name) for name, (v, k) in late.items()))


def attached(bars: DataFrame, block: DataFrame, k: int = 1, carry: bool = False, prefix: str = "") -> DataFrame:
    """bars with the block's columns, k rows of the symbol late; carry: each date takes the last row of the block at or before it, as weekly blocks need.
    Columns that bars have already stay as they are."""
    renamed = block.select("symbol", "date", *(F.col(c).alias(prefix + c) for c in block.columns if c not in {"symbol", "date"}))
    new = [c for c in renamed.columns if c not in bars.columns]
    if not new:
        return bars
    if carry:
        days = bars.select(F.lit("ALL").alias("symbol"), "date").distinct()
        renamed = pn.as_of(days, renamed, new, ["symbol"])
    return pn.attach_macro(bars, renamed, new, k)


def market_table(bars: DataFrame, series: DataFrame | None = None, weekly: bool = True, roles: Mapping[str, Iterable[str]] = ROLES, indices: Mapping[str, Iterable[str]] = INDICES, funds: Mapping[str, Iterable[str]] = FUNDS) -> DataFrame:
    """bars with all blocks, daily and (w_) weekly, one row late. bars hold the indices and funds as symbols; series (date and the published columns) may be missing."""
    blocks = []
    for calendar in (DAILY, WEEKLY) if weekly else (DAILY,):
        held = lambda names, c=calendar: carried(bars, names) if c is DAILY else weekly_last(carried(bars, names))
        index, assets = held(indices), held(roles)
        if "vix" in index.columns:
            blocks.append((calendar, volatility_indices(index, calendar)))
        blocks.append((calendar, cross_assets(assets, calendar)))
        if calendar is DAILY:
            fund = held(funds)
            blocks += [(calendar, volatility_fund(fund, x)) for x in funds if x in fund.columns]
        if series is not None:
            one = series.withColumn("symbol", F.lit("ALL"))
            blocks.append((calendar, published(one if calendar is DAILY else weekly_last(one), calendar=calendar)))
    out = bars
    for calendar, block in blocks:
        late = 0 if series is not None and any(c.startswith("fred_") for c in block.columns) else 1
        out = attached(out, block, late, calendar is WEEKLY, "w_" if calendar is WEEKLY else "")
    return out


def regime_names(x: str | Column, names: Iterable[str] = ("low", "normal", "elevated", "crisis")) -> Column:
    """The regime of a level by name."""
    return mc.state(x, mc.LEVELS, list(names))
