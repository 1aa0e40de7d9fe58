"""Cross-section drivers: the blocks that set a symbol against its date, its sector, its benchmarks and the macro series, by name, daily or weekly.

Side tables (sectors, benchmarks, macro series) are few rows a date; they are joined under a checked broadcast, so a driver shuffles by symbol, by
date where ranks and medians need a date together, and by symbol again for what is carried on from Fridays."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import by_date, dealt, div
from ..operators import factors as fc
from ..operators import frames as fr
from ..operators import kernels as kn
from ..operators import macro as mc
from ..operators import order
from ..operators import panel as pn
from .registry import DATE, PASS, Registry


@dataclass
class Sides:
    """What a driver sets symbols against. roles: market and others -> benchmark; mapping: symbol, bench of its best match (found when asked for); series:
    date and macro columns; levels: regimes of the first of them."""

    sectors: DataFrame
    bench: DataFrame
    roles: dict[str, str]
    mapping: DataFrame | None = None
    series: DataFrame | None = None
    columns: tuple[str, ...] = ()
    levels: tuple[float, ...] = mc.LEVELS
    pairs: dict[str, tuple[str, str | None]] = field(default_factory=dict)


@dataclass(frozen=True)
class Frame:
    """Windows of a frequency: regression, momentum of alpha (and the part of its rows that must be there), strength, lookbacks, spreads."""

    prefix: str
    beta: int
    beta_least: int
    alpha: tuple[int, ...]
    part: int
    norm: tuple[int, int]
    z: tuple[int, int]
    lookbacks: tuple[int, ...]
    unit: str
    spreads: tuple[int, ...]
    averages: tuple[int, int]
    spans: tuple[int, int]
    vol: tuple[int, int, int, int]


DAILY = Frame("", 60, 20, (20, 60, 120), 3, (60, 20), (20, 6), (5, 20, 60), "d", (20, 60, 120), (50, 200), (19, 39), (20, 6, 100, 33))
WEEKLY = Frame("", 12, 6, (4, 12, 24), 2, (12, 3), (12, 3), (1, 4, 13), "w", (4, 12, 24), (10, 40), (4, 8), (4, 2, 20, 10))


def cross_momentum(table: DataFrame, lookbacks: tuple[int, ...], unit: str, name: str = "xsec_mom", days: DataFrame | None = None) -> DataFrame:
    """For each lookback, z-scores over the date of the sum of returns over the last rows of the table's own calendar: plain, and less the sector's
    median. Needs sector. days: a table with the dates of the calendar, by default the table itself. The calendar is joined once; all sums, all medians of a date and all medians of a sector share a window each."""
    moms = [f"__mom{w}" for w in lookbacks]
    out = table if set(moms) <= set(table.columns) else momentum_sums(table, lookbacks, unit, days)
    # the date first: its exchange holds the sectors of a date together too
    out = out.withColumns({f"{name}_{w}{unit}_z": pn.median_z(f"__mom{w}") for w in lookbacks})
    in_sector = Window.partitionBy("date", "sector")
    out = out.withColumns({f"__mid{w}": F.when(F.count(f"__mom{w}").over(in_sector) >= 2, F.percentile(f"__mom{w}", 0.5).over(in_sector)) for w in lookbacks})
    out = out.withColumns({f"__neutral{w}": F.when(F.col("sector").isNotNull(), F.col(f"__mom{w}") - F.col(f"__mid{w}")) for w in lookbacks})
    made = {f"{name}_{w}{unit}_sect_neutral_z": pn.median_z(f"__neutral{w}") for w in lookbacks} | {f"mom_{w}{unit}": F.col(f"__mom{w}") for w in lookbacks}
    return out.withColumns(made).drop(*moms, *(f"__{c}{w}" for w in lookbacks for c in ("mid", "neutral")))


def momentum_sums(table: DataFrame, lookbacks: tuple[int, ...], unit: str, days: DataFrame | None = None) -> DataFrame:
    """__mom and the lookback: the sum of returns over the last rows of the calendar, for each lookback."""
    days = (table if days is None else days).select("date").distinct().withColumn("__k", F.row_number().over(Window.orderBy("date")))
    rows = Window.partitionBy("symbol").orderBy("__k")
    sums = {}
    for w in lookbacks:
        frame = rows.rangeBetween(-(w - 1), 0)
        enough = (F.count("ret").over(frame) >= (1 if w == 1 else min(w, max(2 if unit == "w" else 3, w // 3)))) & (F.col("__k") >= w)
        sums[f"__mom{w}"] = F.when(enough, F.sum("ret").over(frame))
    return table.join(pn.small(days), "date").withColumns(sums).drop("__k")


def cross_ranks(table: DataFrame, lookbacks: tuple[int, ...], unit: str, name: str = "xsec_pct") -> DataFrame:
    """Ordinal percentiles (0 to 100) of each momentum over the date and inside the sector; sectors with fewer than two values take the date's."""

    def ordinal(x: str, window) -> Column:
        n = F.count(x).over(window)
        place = F.row_number().over(window.orderBy(F.col(x).asc_nulls_last(), "symbol"))
        return F.when(F.col(x).isNotNull() & (n >= 2), (place - 1) / (n - 1) * 100)

    in_sector = Window.partitionBy("date", "sector")
    out = table.withColumns({f"__r{w}": F.round(f"mom_{w}{unit}", 9) for w in lookbacks})
    out = out.withColumns({f"{name}_{w}{unit}": ordinal(f"__r{w}", by_date()) for w in lookbacks} | {f"{name}_{w}{unit}_sect": ordinal(f"__r{w}", in_sector) for w in lookbacks})
    return out.withColumns({f"{name}_{w}{unit}_sect": F.coalesce(f"{name}_{w}{unit}_sect", f"{name}_{w}{unit}") for w in lookbacks}).drop(*(f"__r{w}" for w in lookbacks))


def registry(sides: Sides, frame: Frame = DAILY, base: DataFrame | None = None) -> Registry:
    """The blocks of a driver for tables of symbol, date, open, high, low, close, adjclose, volume, ret. base: the bars of the table before its blocks, from
    which calendars and breadth are taken; without it they are taken from the table, whose blocks are then made for each of them."""
    r, roles = Registry(), sides.roles

    def rows(name: str, fn, needs: list[str], makes: list[str]) -> None:
        r.add(name, fr.plain(makes, fn), needs, makes, PASS)

    whos = [*roles, "match", "combo", *(f"{k}_spread" for k in roles if k != "market")]
    found: list[DataFrame] = []

    def mapping(table: DataFrame) -> DataFrame:
        if not found:
            found.append(pn.best_match(table, sides.bench) if sides.mapping is None else sides.mapping)
        return found[0].select("symbol", F.col("bench").alias("best"))

    def vol_context(t: DataFrame) -> DataFrame:
        t = t.withColumn("vol_regime_cs_median", F.log1p(F.percentile("__rv_ratio", 0.5).over(Window.partitionBy("date"))))
        return t.withColumn("vol_regime_rel", F.log1p("__rv_ratio") - F.col("vol_regime_cs_median")).drop("__rv_ratio")

    def vol_ratio(t: DataFrame) -> DataFrame:
        a, a_least, b, b_least = frame.vol
        return t.withColumn("__rv_ratio", div(_dev(a, a_least), _dev(b, b_least)))

    def _dev(w: int, least: int) -> Column:
        window = Window.partitionBy("symbol").orderBy("date").rowsBetween(-(w - 1), 0)
        return F.when(F.count("ret").over(window) >= least, F.stddev_samp("ret").over(window))

    def joined(t: DataFrame) -> DataFrame:
        t = t.join(pn.small(mapping(t)), "symbol", "left")
        for role, bench in roles.items():
            t = pn.with_benchmark(t, sides.bench, bench, {"bench_ret": f"{role}_ret", "px": f"{role}_px"})
        return pn.with_benchmark(t, sides.bench, F.col("best"), {"bench_ret": "match_ret", "px": "match_px"})

    def alpha(f: fr.Arrays) -> fr.Arrays:
        out = {}
        for who in (*roles, "match"):
            out[f"{who}_beta"], out[f"{who}_alpha"] = fr.beta_alpha(f["ret"], f[f"{who}_ret"], frame.beta, frame.beta_least)
        out["combo_alpha"] = 0.5 * out["market_alpha"] + 0.5 * out["match_alpha"]
        out |= {f"{k}_spread_alpha": out[f"{k}_alpha"] - out["market_alpha"] for k in roles if k != "market"}
        return out | {f"{who}_mom_{w}": fr.total(out[f"{who}_alpha"], w, max(3, w // 3) if frame.part == 3 else w // frame.part) for who in whos for w in frame.alpha}

    smooth = [f"{who}_alpha" for who in whos] + [f"{who}_mom_{w}" for who in whos for w in frame.alpha]
    pairs = {f"rs_{who}": ("close", f"{who}_px") for who in (*roles, "match")} | {"rs_match_market": ("match_px", "market_px")} | {f"rs_{k}_market": (f"{k}_px", "market_px") for k in roles if k != "market"}

    def strength(f: fr.Arrays) -> fr.Arrays:
        return {k: v for name, (a, b) in pairs.items() for k, v in fr.relative_strength(f[a], f[b], name, frame.norm, frame.z).items()}

    def breadth(t: DataFrame) -> DataFrame:
        made = pn.breadth((t if base is None else base).select("symbol", "date", "close"), frame.averages, frame.spans)
        return t.join(pn.small(made), "date", "left")

    a, b = frame.averages
    keyed = ["symbol", "date", "ret"]
    r.add("sector", lambda t: t.join(pn.small(sides.sectors.select("symbol", "sector")), "symbol", "left"), ["symbol"], ["sector"], DATE)
    # what blocks over a date need of a symbol comes before the rows change hands
    r.add("volatility_ratio", vol_ratio, keyed, ["__rv_ratio"], DATE)
    sums = [f"__mom{w}" for w in frame.lookbacks]
    r.add("momentum_sums", lambda t: momentum_sums(t, frame.lookbacks, frame.unit, base), keyed, sums, DATE)
    r.add("volatility_context", vol_context, [*keyed, "__rv_ratio"], ["vol_regime_cs_median", "vol_regime_rel"], DATE)
    sides_made = ["best", *(f"{w}_{c}" for w in (*roles, "match") for c in ("ret", "px"))]
    r.add("sides", joined, keyed, sides_made)
    alphas = [*(f"{w}_beta" for w in (*roles, "match")), *(f"{w}_alpha" for w in whos), *(f"{who}_mom_{w}" for who in whos for w in frame.alpha)]
    rows("alpha_windows", alpha, ["ret", *(f"{w}_ret" for w in (*roles, "match"))], alphas)
    rows("alpha_smooth", lambda f: {f"{c}_ema10": x for c, x in fr.ewms(f, 10).items()}, smooth, [f"{c}_ema10" for c in smooth])
    rows("strength_windows", strength, ["close", *(f"{w}_px" for w in (*roles, "match"))], [c for n in pairs for c in (n, f"{n}_norm", f"{n}_z{frame.z[0]}", f"{n}_slope10")])
    rows("strength_pass", fr.strength_pass, list(pairs), [c for n in pairs for c in (f"{n}_rsi14", f"{n}_macd_hist")])
    breadth_made = ["advancers", "decliners", "net", "ad_line", f"above_ma{a}", f"above_ma{b}", "mcclellan_osc", "mcclellan_sum"]
    r.add("breadth", breadth, ["symbol", "date", "close"], breadth_made)
    moms = [c.format(w, frame.unit) for w in frame.lookbacks for c in ("mom_{}{}", "xsec_mom_{}{}_z", "xsec_mom_{}{}_sect_neutral_z")]
    r.add("momentum", lambda t: cross_momentum(t, frame.lookbacks, frame.unit, days=base), [*keyed, *sums, "sector"], moms, DATE)
    ranks = [c.format(w, frame.unit) for w in frame.lookbacks for c in ("xsec_pct_{}{}", "xsec_pct_{}{}_sect")]
    r.add("ranks", lambda t: cross_ranks(t, frame.lookbacks, frame.unit), [f"mom_{w}{frame.unit}" for w in frame.lookbacks] + ["sector"], ranks, DATE)
    if sides.pairs:
        spreads = [c for k in sides.pairs for c in (*(f"{k}_cum_{w}" for w in frame.spreads), f"{k}_z_{frame.spreads[1]}", *(f"{k}_slope_{w}" for w in frame.spreads[:2]))]

        def attach_spreads(t: DataFrame) -> DataFrame:
            names = sorted({x for pair in sides.pairs.values() for x in pair if x})
            wide = mc.wide_prices(sides.bench.withColumnRenamed("bench", "symbol"), names, "bench_ret")
            low = {k: tuple(x and x.lower() for x in pair) for k, pair in sides.pairs.items()}
            return pn.attach_macro(t, mc.global_spreads(wide, low, frame.spreads).drop("symbol"), spreads, 1)

        r.add("global_spreads", attach_spreads, ["symbol", "date"], spreads)
    if sides.series is not None:
        x = sides.columns[0]
        made = [f"{x}_pct", f"{x}_z", f"{x}_regime", f"{x}_ma20_ratio", f"{x}_chg5", f"{x}_chg20"]

        def regimes(t: DataFrame) -> DataFrame:
            one = sides.series.select(F.lit("ALL").alias("symbol"), "date", *sides.columns)
            return pn.attach_macro(t, mc.regime(one, x, sides.levels).drop("symbol"), [*sides.columns, *made], 1)

        r.add("macro_regime", regimes, ["symbol", "date"], [*sides.columns, *made])
    r.group("alpha", ["alpha_windows", "alpha_smooth"])
    r.group("strength", ["strength_windows", "strength_pass"])
    return r


def daily(features: DataFrame, sides: Sides, names: Iterable[str] | None = None) -> DataFrame:
    """features (symbol, date, bars, ret) with the asked blocks of the daily driver; all by default, and the joint factor regression, daily and weekly."""
    blocks = registry(sides, DAILY, features)
    if names is not None:
        return blocks.run(dealt(features), names)
    rows, last, kept = blocks.before_pass(dealt(features))
    factors = fc.joint_factors(features.select("symbol", "date", "ret"), sides.bench, sides.roles, mapping=sides.mapping)
    factors = factors.withColumnsRenamed({c: f"joint_{c}" for c in factors.columns if c not in {"symbol", "date"}})
    return kn.grouped(rows, last, factors).select(*features.columns, *kept, *(c for c in factors.columns if c not in {"symbol", "date"}))


def weekly(bars: DataFrame, sides: Sides, names: Iterable[str] | None = None) -> DataFrame:
    """bars with the asked blocks of the weekly driver (all by default), prefixed w_, on every day as of the last Friday that is not after it. sides are of
    days; benchmarks and series are taken to weeks here: last price, compounded return, last value."""
    week = pn.week_end()
    bench = fc.compounded(sides.bench.select("bench", "date", "bench_ret"), "bench", "bench_ret")
    px = sides.bench.groupBy("bench", week.alias("week")).agg(F.max_by("px", "date").alias("px")).withColumnRenamed("week", "date")
    series = None if sides.series is None else sides.series.groupBy(week.alias("week")).agg(*(F.max_by(c, "date").alias(c) for c in sides.columns)).withColumnRenamed("week", "date")
    coarse = Sides(sides.sectors, bench.join(px, ["bench", "date"]), sides.roles, sides.mapping, series, sides.columns, sides.levels, sides.pairs)
    weeks = order.held(pn.resample(bars))
    rows, last, kept = registry(coarse, WEEKLY, weeks).before_pass(dealt(weeks), names)
    return kn.grouped_as_of(bars, rows, last, {c: f"w_{c}" for c in kept})
