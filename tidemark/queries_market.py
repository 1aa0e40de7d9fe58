"""Registered queries of whole market blocks, mapping records, the sizing chain and weights per model."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import windows as wn
from .operators import evaluation as ev
from .operators import features as ft
from .operators import labels as lb
from .operators import mapping as mp
from .operators import panel as pn
from .operators import portfolio as pf
from .operators import selection as sl
from .operators import sizing as sz
from .operators.order import held
from .plans import market as mk
from .sources import panels as sp
from .queries import _EQ, _FIT, _H, _NEXT, ATR, BARS, BENCH, FRIDAY, MACRO, RET, SCORED, SECTORS, SIGNALS, SQL, WEEKLY, _SPANS, S, _spans, bars, chain, lagged, macro, out, over, query, roll, rw, sample_z, scored, sectors, shown, signals, stage, table

KEYS = ["symbol", "date"]


def filled(x: str) -> str:
    return f"last_value({x} IGNORE NULLS) OVER ({S} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def percent(x: str, w: int, least: int) -> str:
    """How much of the rows before, in the last w, lies below x."""
    before = f"(list({x}) FILTER (WHERE {x} IS NOT NULL) OVER ({S} ROWS BETWEEN {w - 1} PRECEDING AND 1 PRECEDING))"
    return f"CASE WHEN {x} IS NOT NULL AND len({before}) >= {least - 1} THEN len(list_filter({before}, lambda q: q < {x})) / len({before}) * 100 END"


def weighed(x: str, span: int, least: int) -> str:
    """An exponential mean whose weights are those of the values that are there."""
    before = f"(list({x}) OVER ({S} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"
    q = 1 - 2 / (span + 1)
    return f"CASE WHEN len({before}) >= {least} THEN list_sum(list_transform({before}, lambda v, i: v * pow({q}, len({before}) - i))) / list_sum(list_transform({before}, lambda v, i: pow({q}, len({before}) - i))) END"


def on_bars(columns: list[str], block: str, k: int = 1, digits: int = 5) -> str:
    """The block's columns on every bar of the same date, k rows late."""
    late = ", ".join(f"round(CAST(lag({c}, {k}) OVER (PARTITION BY b.symbol ORDER BY b.date) AS DOUBLE), {digits}) + 0.0 AS {c}" for c in columns)
    return f" SELECT b.symbol, b.date, {late} FROM bars b LEFT JOIN {block} w ON b.date = w.date"


def as_of_bars(columns: list[str], block: str, k: int = 1, digits: int = 5) -> str:
    late = ", ".join(f"round(CAST(lag({c}, {k}) OVER (PARTITION BY b.symbol ORDER BY b.date) AS DOUBLE), {digits}) + 0.0 AS w_{c}" for c in columns)
    return f" SELECT b.symbol, b.date, {late} FROM bars b ASOF LEFT JOIN {block} w ON b.date >= w.date"


def weeks(name: str, before: str, columns: list[str]) -> str:
    last = ", ".join(f"arg_max({c}, date) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in columns)
    return f"{name} AS (SELECT symbol, CAST({FRIDAY} AS DATE) AS date, {last} FROM {before} GROUP BY 1, 2)"


# volatility indices


def _indices(spark, sf_dir):
    """The flow of orders as two indices, the first without a value on every seventh day."""
    m = macro(spark, sf_dir)
    first = m.select(F.lit("VIX").alias("symbol"), "date", F.when(F.dayofyear("date") % 7 == 0, 0.0).otherwise(F.col("peak") / 1e4).alias("close"))
    return first.unionByName(m.select(F.lit("^VXN").alias("symbol"), "date", (F.col("flow") / 1e5).alias("close")))


_INDEX = [MACRO, "ix0 AS (SELECT 'ALL' AS symbol, date, CASE WHEN dayofyear(date) % 7 <> 0 THEN peak / 1e4 END AS v0, flow / 1e5 AS vxn FROM macro)", "ix AS (SELECT symbol, date, " + filled("v0") + " AS vix, vxn FROM ix0)"]
_REGIME = "CASE WHEN vix < 15 THEN 0 WHEN vix < 20 THEN 1 WHEN vix < 30 THEN 2 WHEN vix IS NOT NULL THEN 3 END"
_VD = ["vix_level", "vix_percentile_252d", "vix_zscore_60d", "vix_regime", "vix_ma20_ratio", "vix_change_5d", "vix_change_20d", "vix_ema10", "vxn_level", "vxn_percentile_252d", "vix_vxn_spread", "vix_vxn_ratio"]
_VW = ["vix_level", "vix_percentile_52w", "vix_zscore_12w", "vix_regime", "vix_ma4_ratio", "vix_change_1w", "vix_change_4w", "vix_ema4", "vxn_level", "vxn_percentile_252d", "vix_vxn_spread", "vix_vxn_ratio"]
_PAIR = {"vxn_level": "vxn", "vix_vxn_spread": "vix - vxn", "vix_vxn_ratio": over("vix", "vxn"), "vix_level": "vix", "vix_regime": _REGIME}


@query(chain(BARS, *_INDEX, stage("vd", "ix", _PAIR | {"vix_percentile_252d": percent("vix", 252, 50), "vix_zscore_60d": sample_z("vix", 60, 20), "vix_ma20_ratio": over("vix", f"({roll('avg', 'vix', 20, 10)})"), "vix_change_5d": over("vix", lagged("vix", 5)) + " - 1", "vix_change_20d": over("vix", lagged("vix", 20)) + " - 1", "vix_ema10": weighed("vix", 10, 5), "vxn_percentile_252d": percent("vxn", 252, 50)})) + on_bars(_VD, "vd", 1, 8))
def volatility_indices(spark, sf_dir):
    block = mk.volatility_indices(mk.carried(_indices(spark, sf_dir), mk.INDICES))
    return shown(mk.attached(bars(spark, sf_dir), block), KEYS, _VD, 8)


@query(chain(BARS, *_INDEX, weeks("iw", "ix", ["vix", "vxn"]), stage("vw", "iw", _PAIR | {"vix_percentile_52w": percent("vix", 52, 12), "vix_zscore_12w": sample_z("vix", 12, 4), "vix_ma4_ratio": over("vix", f"({roll('avg', 'vix', 4, 2)})"), "vix_change_1w": over("vix", lagged("vix", 1)) + " - 1", "vix_change_4w": over("vix", lagged("vix", 4)) + " - 1", "vix_ema4": weighed("vix", 4, 2), "vxn_percentile_252d": percent("vxn", 52, 12)})) + as_of_bars(_VW, "vw", 1, 8))
def weekly_volatility_indices(spark, sf_dir):
    block = mk.volatility_indices(mk.weekly_last(mk.carried(_indices(spark, sf_dir), mk.INDICES)), mk.WEEKLY)
    return shown(mk.attached(bars(spark, sf_dir), block, 1, True, "w_"), KEYS, [f"w_{c}" for c in _VW], 8)


_FUND = ["vxx_ret_5d", "vxx_ret_20d", "vxx_rsi_14"]


@query(chain(BARS, *_INDEX, stage("fu", "ix", {"st": f"coalesce(vix - {lagged('vix')}, 0.0)"}), stage("fv", "fu", {"up": "greatest(st, 0.0)", "dn": "greatest(-st, 0.0)"}), stage("fw", "fv", {"vxx_ret_5d": over("vix", lagged("vix", 5)) + " - 1", "vxx_ret_20d": over("vix", lagged("vix", 20)) + " - 1", "vxx_rsi_14": "100 - 100 / (1 + " + over(f"({roll('avg', 'up', 14, 7)})", f"({roll('avg', 'dn', 14, 7)})") + ")"})) + on_bars(_FUND, "fw"))
def volatility_fund(spark, sf_dir):
    table_ = mk.carried(_indices(spark, sf_dir), mk.INDICES).select(*KEYS, F.col("vix").alias("vxx"))
    return shown(mk.attached(bars(spark, sf_dir), mk.volatility_fund(table_)), KEYS, _FUND)


# cross-asset signals

_ROLES = {"equity": ("ALL",), "gold": ("ASIA",), "long_bond": ("EUROPE",), "short_bond": ("NONE", "AFRICA"), "high_yield": ("AMERICA",), "inv_grade": ("MIDDLE EAST",), "oil": ("AFRICA",), "copper": ("AMERICA",), "dollar": ("EUROPE",), "tech": ("ASIA",), "cyclical": ("AMERICA",), "defensive": ("EUROPE",), "utilities": ("ASIA",), "financials": ("AFRICA",), "silver": ("NONE",)}
_ROLE_SQL = [BARS, SECTORS, BENCH, "ro0 AS (SELECT 'ALL' AS symbol, date, " + ", ".join(f"max(CASE WHEN bench = '{names[-1]}' THEN px END) AS {role}" for role, names in _ROLES.items() if names[-1] != "NONE") + " FROM bench GROUP BY date)", "ro AS (SELECT symbol, date, " + ", ".join(f"{filled(role)} AS {role}" for role, names in _ROLES.items() if names[-1] != "NONE") + " FROM ro0)"]
_RATIO_SQL = {name: over(a, b) for name, (a, b, _) in mk.RATIOS.items()}
_RET_SQL = {"e": over("equity", lagged("equity")) + " - 1", "b": over("long_bond", lagged("long_bond")) + " - 1"}


def _corr_sql(w: int, least: int) -> str:
    return f"CASE WHEN count(x) OVER {rw(w)} >= {least} THEN {over(f'covar_samp(x, y) OVER {rw(w)}', f'stddev_samp(x) OVER {rw(w)} * stddev_samp(y) OVER {rw(w)}')} END"


_BOTH_SQL = {"x": "CASE WHEN e IS NOT NULL AND b IS NOT NULL THEN e END", "y": "CASE WHEN e IS NOT NULL AND b IS NOT NULL THEN b END"}
_CD = [*mk.RATIOS, "gold_spy_ratio_zscore", "copper_gold_zscore", "yield_curve_zscore", "credit_spread_zscore", "equity_bond_corr_60d", "oil_momentum_20d", "dollar_momentum_20d", "dollar_percentile_252d"]
_CW = [*mk.RATIOS, "gold_spy_ratio_zscore", "yield_curve_zscore", "credit_spread_zscore", "equity_bond_corr_60d", "dollar_momentum_20d"]
_Z = {z: n for n, (_, _, z) in mk.RATIOS.items() if z}


def _roles(spark, sf_dir):
    bench = pn.benchmarks(bars(spark, sf_dir), sectors(spark, sf_dir)).select(F.col("bench").alias("symbol"), "date", F.col("px").alias("close"))
    return mk.carried(bench, _ROLES)


@query(chain(*_ROLE_SQL, stage("ra", "ro", _RATIO_SQL | _RET_SQL), stage("rb", "ra", _BOTH_SQL | {z: sample_z(n, 60, 20) for z, n in _Z.items()}), stage("rc", "rb", {"equity_bond_corr_60d": _corr_sql(60, 30), "oil_momentum_20d": over("oil", lagged("oil", 20)) + " - 1", "dollar_momentum_20d": over("dollar", lagged("dollar", 20)) + " - 1", "dollar_percentile_252d": percent("dollar", 252, 50)})) + on_bars(_CD, "rc"))
def cross_asset_block(spark, sf_dir):
    return shown(mk.attached(bars(spark, sf_dir), mk.cross_assets(_roles(spark, sf_dir))), KEYS, _CD)


@query(chain(*_ROLE_SQL, weeks("ru", "ro", [r for r, names in _ROLES.items() if names[-1] != "NONE"]), stage("ra", "ru", _RATIO_SQL | _RET_SQL), stage("rb", "ra", _BOTH_SQL | {z: sample_z(n, 12, 4 if n == "gold_spy_ratio" else 6) for z, n in _Z.items()}), stage("rc", "rb", {"equity_bond_corr_60d": _corr_sql(12, 6), "dollar_momentum_20d": over("dollar", lagged("dollar", 4)) + " - 1"})) + as_of_bars(_CW, "rc"))
def weekly_cross_asset_block(spark, sf_dir):
    block = mk.cross_assets(mk.weekly_last(_roles(spark, sf_dir)), mk.WEEKLY)
    return shown(mk.attached(bars(spark, sf_dir), block, 1, True, "w_"), KEYS, [f"w_{c}" for c in _CW])


# published series

_MADE = {"flow": (1, ("level", "change_5d", "change_20d", "zscore_60d", "percentile_252d")), "peak": (5, ("level", "change_4w", "zscore_52w", "percentile_104w"))}
_PD = ["fred_flow", "fred_flow_chg5d", "fred_flow_chg20d", "fred_flow_z60", "fred_flow_pct252", "fred_peak", "fred_peak_chg4w", "fred_peak_z52w", "fred_peak_pct104w"]
_SERIES = [MACRO, "pu AS (SELECT 'ALL' AS symbol, date, flow / 1e6 AS flow, peak / 1e6 AS peak FROM macro)"]


def _published_sql(before: str, d5: int, d20: int, z60: tuple[int, int], p252: tuple[int, int], d4: int, z52: tuple[int, int], p104: tuple[int, int], k: int | None) -> list[str]:
    made = {"fred_flow": "flow", "fred_flow_chg5d": f"flow - {lagged('flow', d5)}", "fred_flow_chg20d": f"flow - {lagged('flow', d20)}", "fred_flow_z60": sample_z("flow", *z60), "fred_flow_pct252": percent("flow", *p252), "fred_peak": "peak", "fred_peak_chg4w": f"peak - {lagged('peak', d4)}", "fred_peak_z52w": sample_z("peak", *z52), "fred_peak_pct104w": percent("peak", *p104)}
    return [stage("pa", before, made), "pb AS (SELECT date, " + ", ".join(f"lag({c}, {k or (1 if 'flow' in c else 5)}) OVER ({S}) AS {c}" for c in made) + " FROM pa)"]


def _series(spark, sf_dir):
    return macro(spark, sf_dir).select(F.lit("ALL").alias("symbol"), "date", (F.col("flow") / 1e6).alias("flow"), (F.col("peak") / 1e6).alias("peak"))


@query(chain(BARS, *_SERIES, *_published_sql("pu", 5, 20, (60, 20), (252, 50), 20, (252, 60), (504, 100), None)) + on_bars(_PD, "pb", 0, 9))
def published_block(spark, sf_dir):
    return shown(mk.attached(bars(spark, sf_dir), mk.published(_series(spark, sf_dir), _MADE), 0), KEYS, _PD, 9)


@query(chain(BARS, *_SERIES, weeks("pw", "pu", ["flow", "peak"]), *_published_sql("pw", 1, 4, (12, 3), (52, 14), 4, (52, 13), (104, 27), 1)) + as_of_bars(_PD, "pb", 0, 9))
def weekly_published_block(spark, sf_dir):
    block = mk.published(mk.weekly_last(_series(spark, sf_dir)), _MADE, mk.WEEKLY)
    return shown(mk.attached(bars(spark, sf_dir), block, 0, True, "w_"), KEYS, [f"w_{c}" for c in _PD], 9)


# mapping records

_TO_BENCH = [("Africa", "AFRICA"), ("america", "AMERICA"), ("ASIA", "ASIA"), ("Europe", "EUROPE")]
_TO_EQUAL = [("ALL", "ASIA"), ("AFRICA", "EUROPE"), ("AMERICA", "MIDDLE EAST")]
_RECORD_SQL = [
    BARS, SECTORS, BENCH, RET, _FIT,
    "co AS (SELECT symbol, bench, c / (sqrt(v) * sqrt(u)) AS corr FROM fit WHERE n > 100)",
    "bm AS (SELECT symbol, bench FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(c * c / (v * u), 9) DESC, bench) AS k FROM fit WHERE n >= 100 AND bench <> 'ALL' AND c * c / (v * u) > 0) WHERE k = 1 AND CAST(substr(symbol, 2) AS BIGINT) % 3 <> 0)",
    "sb(sector, bench) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _TO_BENCH) + ")",
    "eb(bench, equal_bench) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _TO_EQUAL) + ")",
    "re0 AS (SELECT s.symbol, s.sector AS csv_sector, coalesce(sb.bench, 'ALL') AS sector_etf, bm.bench AS subsector_etf, abs(s_acctbal) AS market_cap FROM sectors s JOIN supplier p ON s.symbol = 'S' || p.s_suppkey LEFT JOIN sb ON lower(sb.sector) = lower(s.sector) LEFT JOIN bm ON bm.symbol = s.symbol)",
    "re1 AS (SELECT re0.*, equal_bench AS equal_weight_etf FROM re0 LEFT JOIN eb ON eb.bench = sector_etf)",
    "re2 AS (SELECT re1.*, a.corr AS market, b.corr AS market_ew, c.corr AS sector, d.corr AS sector_ew, e.corr AS subsector FROM re1 LEFT JOIN co a ON a.symbol = re1.symbol AND a.bench = 'ALL' LEFT JOIN co b ON b.symbol = re1.symbol AND b.bench = 'ASIA' LEFT JOIN co c ON c.symbol = re1.symbol AND c.bench = sector_etf LEFT JOIN co d ON d.symbol = re1.symbol AND d.bench = equal_weight_etf LEFT JOIN co e ON e.symbol = re1.symbol AND e.bench = subsector_etf)",
    "rec AS (SELECT *, CASE WHEN coalesce(sector, 0) > 0.6 THEN CASE WHEN subsector_etf IS NULL OR coalesce(subsector, 0) > coalesce(sector, 0) + 0.05 THEN 'high' ELSE 'medium' END WHEN coalesce(sector, 0) > 0.4 THEN 'medium' ELSE 'low' END AS confidence FROM re2)",
]


def _records(spark, sf_dir):
    b = ft.returns(bars(spark, sf_dir))
    bench = pn.benchmarks(b, sectors(spark, sf_dir))
    universe = sectors(spark, sf_dir).join(table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("symbol"), F.abs("s_acctbal").alias("market_cap")), "symbol")
    best = pn.best_match(b, bench.where("bench <> 'ALL'")).where(F.substring("symbol", 2, 20).cast("long") % 3 != 0).select("symbol", F.col("bench").alias("subsector"))
    to_bench, to_equal = spark.createDataFrame(_TO_BENCH, "sector string, bench string"), spark.createDataFrame(_TO_EQUAL, "bench string, equal_bench string")
    return mp.record(universe, to_bench, to_equal, best, pn.correlations(b, bench), "ALL", "ASIA")


_PARTS = ["market", "market_ew", "sector", "sector_ew", "subsector"]


@query(chain(*_RECORD_SQL) + f" SELECT symbol, csv_sector, sector_etf, equal_weight_etf, subsector_etf, confidence, {out([*_PARTS, 'market_cap'])} FROM rec")
def mapping_records(spark, sf_dir):
    r = _records(spark, sf_dir).select("*", "correlations.*")
    return shown(r, ["symbol", "csv_sector", "sector_etf", "equal_weight_etf", "subsector_etf", "confidence"], [*_PARTS, "market_cap"])


@query(chain(*_RECORD_SQL) + " SELECT CAST(count(*) AS BIGINT) AS n_symbols, CAST(count(*) FILTER (WHERE confidence = 'high') AS BIGINT) AS n_high, CAST(count(*) FILTER (WHERE confidence = 'medium') AS BIGINT) AS n_medium, CAST(count(*) FILTER (WHERE confidence = 'low') AS BIGINT) AS n_low, round(avg(coalesce(sector, 0)), 6) + 0.0 AS mean_sector_corr, round(count(equal_weight_etf) / count(*), 6) + 0.0 AS equal_weight_coverage, round(count(subsector_etf) / count(*), 6) + 0.0 AS subsector_coverage FROM rec")
def mapping_report(spark, sf_dir):
    return shown(mp.report(_records(spark, sf_dir)), ["n_symbols", "n_high", "n_medium", "n_low"], ["mean_sector_corr", "equal_weight_coverage", "subsector_coverage"], 6)


@query(chain(*_RECORD_SQL) + ", g AS (SELECT symbol, subsector_etf, coalesce(sector, 0) AS sector_corr, coalesce(subsector, 0) AS subsector_corr, coalesce(subsector, 0) - coalesce(sector, 0) AS improvement FROM rec) SELECT symbol, subsector_etf, round(sector_corr, 5) + 0.0 AS sector_corr, round(subsector_corr, 5) + 0.0 AS subsector_corr, round(improvement, 5) + 0.0 AS improvement FROM g WHERE improvement > 0.05 ORDER BY g.improvement DESC, symbol LIMIT 10")
def subsector_improvements(spark, sf_dir):
    return shown(mp.improvements(_records(spark, sf_dir)), ["symbol", "subsector_etf"], ["sector_corr", "subsector_corr", "improvement"])


# sizing

_SIZED = ["atr_percent", "adv_20d", "dollar_volume"]
_CUT = "1997-01-01"


def _clip_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, lo_{c}), hi_{c}) END"


_SIZING_SQL = [
    BARS, SECTORS, SIGNALS, ATR,
    stage("fe", "entries", {"atr_percent": "atr / close", "dollar_volume": "close * volume", "adv_20d": roll("avg", "volume", 20, 5)}),
    "si AS (SELECT s.symbol, s.week, s.probability, f.atr_percent, f.adv_20d, f.dollar_volume FROM signals s LEFT JOIN fe f ON f.symbol = s.symbol AND f.date = s.week)",
    f"cu AS (SELECT {', '.join(f'quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}' for c in _SIZED)} FROM si WHERE week < DATE '{_CUT}')",
    f"mo AS (SELECT {', '.join(f'avg({_clip_sql(c)}) AS m_{c}, stddev_samp({_clip_sql(c)}) AS d_{c}' for c in _SIZED)} FROM si, cu WHERE week < DATE '{_CUT}')",
    f"so AS (SELECT symbol, week, probability, {', '.join(f'CASE WHEN {c} IS NOT NULL THEN least(greatest((({_clip_sql(c)}) - m_{c}) / d_{c}, -3.0), 3.0) END AS {c}' for c in _SIZED)} FROM si, cu, mo WHERE week >= DATE '{_CUT}')",
]


def _sizing_sides(spark, sf_dir):
    features = lb.with_atr(bars(spark, sf_dir)).withColumns({"atr_percent": F.col("atr") / F.col("close"), "dollar_volume": F.col("close") * F.col("volume"), "adv_20d": wn.mean("volume", 20, 5)})
    # read for bounds, for moments and for what is shown
    return held(signals(spark, sf_dir).withColumnRenamed("week", "week_monday").drop("close", "volume")), held(features)


@query(chain(*_SIZING_SQL) + f" SELECT symbol, week, {out(_SIZED)} FROM so")
def sizing_chain(spark, sf_dir):
    s, features = _sizing_sides(spark, sf_dir)
    state = sz.fit(s.where(f"week_monday < date '{_CUT}'"), features)
    return shown(sz.transform(s.where(f"week_monday >= date '{_CUT}'"), state, features).withColumnRenamed("week_monday", "week"), ["symbol", "week"], _SIZED)


@query(chain(*_SIZING_SQL, *_INDEX, "vr AS (SELECT date, " + _REGIME + " AS vix_regime FROM ix)") + " SELECT si.symbol, si.week, CASE WHEN probability <= 0 THEN NULL WHEN probability <= 0.4 THEN 'very_low' WHEN probability <= 0.5 THEN 'low' WHEN probability <= 0.6 THEN 'medium' WHEN probability <= 0.7 THEN 'high' ELSE 'very_high' END AS confidence_regime, vr.vix_regime, round(coalesce(atr_percent, NULL), 6) + 0.0 AS volatility, round(adv_20d, 6) + 0.0 AS liquidity FROM si LEFT JOIN vr ON vr.date = si.week")
def sizing_regimes(spark, sf_dir):
    s, features = _sizing_sides(spark, sf_dir)
    block = mk.volatility_indices(mk.carried(_indices(spark, sf_dir), mk.INDICES))
    t = sz.with_measures(sz.regimes(sz.merged(s, features), block.select("date", "vix_regime"))).withColumnRenamed("week_monday", "week")
    return shown(t, ["symbol", "week", "confidence_regime", "vix_regime"], ["volatility", "liquidity"], 6)


# weights per model

_MODELS = {"even": (1.5, 1.5), "long": (3.0, 1.5)}


def _first_sql(model: str, up: float, down: float) -> str:
    at = lambda cond: f"coalesce(nullif(coalesce(list_position(list_transform(nx, lambda b: {cond}), true), 0), 0), {_H + 1})"
    return f"SELECT symbol, date, k, len(nx) AS n, '{model}' AS model, {at(f'b.h >= close + {up} * atr')} AS u, {at(f'b.l <= close - {down} * atr')} AS d FROM nk"


@query(
    chain(
        BARS, ATR, _NEXT,
        f"nk AS (SELECT * FROM (SELECT *, row_number() OVER ({S}) AS k, count(*) OVER (PARTITION BY symbol) AS nn FROM nx) WHERE close > 0 AND atr > 0 AND len(nx) > 0 AND nn >= 25)",
        "fi AS (" + " UNION ALL ".join(_first_sql(m, *b) for m, b in _MODELS.items()) + ")",
        f"la AS (SELECT symbol, date, model, k AS t0, CASE WHEN u > {_H} AND d > {_H} THEN 0 WHEN u <= d THEN 1 ELSE -1 END AS hit, CAST(CASE WHEN u > {_H} AND d > {_H} THEN n ELSE least(u, d) END AS BIGINT) AS h FROM fi)",
        "ov AS (SELECT a.symbol, a.date, a.model, a.hit, a.h, count(*) - 1 AS n_overlapping FROM la a JOIN la b ON a.symbol = b.symbol AND a.model = b.model AND b.t0 <= a.t0 + a.h AND b.t0 + b.h >= a.t0 GROUP BY ALL)",
        "cl AS (SELECT model, hit, count(*) AS c FROM ov GROUP BY 1, 2), cb AS (SELECT model, hit, sum(c) OVER (PARTITION BY model) / (count(*) OVER (PARTITION BY model) * c) AS b FROM cl)",
        "wt AS (SELECT ov.*, least(greatest(b / (n_overlapping + 0.5), 0.01), 10.0) AS w FROM ov JOIN cb USING (model, hit))",
        "wf AS (SELECT *, least(greatest(w / avg(w) OVER (PARTITION BY model), 0.01), 10.0) AS f FROM wt)",
    )
    + " SELECT symbol, date, model, CAST(hit AS INTEGER) AS hit, CAST(h AS INTEGER) AS h_used, CAST(n_overlapping AS BIGINT) AS n_overlapping, round(f, 6) + 0.0 AS weight_final FROM wf"
)
def model_weights(spark, sf_dir):
    t = lb.model_weights(lb.with_atr(bars(spark, sf_dir)), _MODELS, _H)
    return shown(t, ["symbol", "date", "model", "hit", "h_used", "n_overlapping"], ["weight_final"], 6)


# models and folds

_FOLDS = "fo AS (SELECT l_returnflag AS model, l_linenumber AS fold, 0.5 + avg(l_discount) AS auc, 0.3 + avg(l_tax) AS aupr, avg(l_quantity) / 250 AS brier, max(l_discount) * 5 AS top, avg(l_discount) * 5 AS bottom FROM lineitem GROUP BY 1, 2)"


@query(f"WITH {_FOLDS}, a AS (SELECT model, avg(auc) AS auc, stddev_pop(auc) AS dev, avg(aupr) AS aupr, avg(brier) AS brier, avg(top) AS t, avg(bottom) AS b FROM fo GROUP BY 1), s AS (SELECT *, least(greatest(1 - 5 * dev / (auc + 1e-8), 0.0), 1.0) AS stability FROM a) SELECT model, round(stability, 6) + 0.0 AS stability, round(0.2 * auc + 0.15 * aupr + 0.15 * (1 - brier / 0.25) + 0.2 * t + 0.1 * (t - b) + 0.2 * stability, 6) + 0.0 AS score FROM s")
def composite_score(spark, sf_dir):
    folds = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("fold")).agg((0.5 + F.avg("l_discount")).alias("auc"), (0.3 + F.avg("l_tax")).alias("aupr"), (F.avg("l_quantity") / 250).alias("brier"), (F.max("l_discount") * 5).alias("top"), (F.avg("l_discount") * 5).alias("bottom"))
    return shown(sl.composite_score(folds, ["model"]), ["model"], ["stability", "score"], 6)


@query("WITH s AS (SELECT l_returnflag || l_linestatus AS model, l_partkey AS feature, count(*) AS n FROM lineitem GROUP BY 1, 2), k AS (SELECT p_partkey AS feature FROM part WHERE p_size > 5) SELECT model, CAST(sum(n) AS BIGINT) AS n_total, CAST(count(*) AS BIGINT) AS n_unique, CAST(sum(n) - count(*) AS BIGINT) AS n_duplicates, CAST(count(*) FILTER (WHERE k.feature IS NULL) AS BIGINT) AS n_unknown, sum(n) = count(*) AND count(*) = count(k.feature) AS valid FROM s LEFT JOIN k ON k.feature = s.feature GROUP BY 1")
def feature_sets(spark, sf_dir):
    selected = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("model"), F.col("l_partkey").alias("feature"))
    return sl.feature_sets(selected, table(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("feature")))


@query(chain(BARS, RET, stage("le", "rets", {"late": lagged("close", 200)})) + ", sh AS (SELECT 'ret' AS feature, avg(CASE WHEN ret IS NULL THEN 1.0 ELSE 0.0 END) AS s FROM le UNION ALL SELECT 'late', avg(CASE WHEN late IS NULL THEN 1.0 ELSE 0.0 END) FROM le UNION ALL SELECT 'volume', avg(CASE WHEN volume IS NULL THEN 1.0 ELSE 0.0 END) FROM le), he(model, feature) AS (VALUES ('a', 'ret'), ('a', 'late'), ('a', 'gone'), ('b', 'volume'), ('b', 'late')) SELECT model, CAST(count(s) AS BIGINT) AS n_present, CAST(count(*) - count(s) AS BIGINT) AS n_missing, CAST(count(*) FILTER (WHERE s > 0.3) AS BIGINT) AS n_sparse FROM he LEFT JOIN sh ON sh.feature = he.feature GROUP BY 1")
def head_status(spark, sf_dir):
    rows = ft.returns(bars(spark, sf_dir)).withColumn("late", wn.lag("close", 200))
    heads = spark.createDataFrame([("a", "ret"), ("a", "late"), ("a", "gone"), ("b", "volume"), ("b", "late")], "model string, feature string")
    return sl.head_status(rows, heads)


@query(chain(BARS, SECTORS, SIGNALS, "sl AS (SELECT *, close * (1 + probability / 10) AS target, close * (1 - volume % 7 / 1000) AS stop FROM signals)") + " SELECT symbol, week, round((target / close - 1) / greatest(1 - stop / close, 0.001), 5) + 0.0 AS reward_risk FROM sl")
def signal_levels(spark, sf_dir):
    s = signals(spark, sf_dir).withColumns({"entry_price": F.col("close"), "target_price": F.col("close") * (1 + F.col("probability") / 10), "stop_price": F.col("close") * (1 - F.col("volume") % 7 / 1000)})
    return shown(sl.signal_levels(s), ["symbol", "week"], ["reward_risk"])


@query(chain(BARS, SECTORS, SIGNALS, _EQ) + ", wk AS (SELECT week, row_number() OVER (ORDER BY week) AS n FROM (SELECT DISTINCT week FROM eq)), a AS (SELECT n, symbol, weight FROM eq JOIN wk USING (week)), f AS (SELECT coalesce(a.n, b.n + 1) AS n, coalesce(a.symbol, b.symbol) AS symbol, abs(coalesce(a.weight, 0) - coalesce(b.weight, 0)) AS c FROM a FULL JOIN a b ON a.n = b.n + 1 AND a.symbol = b.symbol) SELECT week, symbol, round(c, 6) + 0.0 AS change FROM f JOIN wk USING (n)")
def turnover_by_symbol(spark, sf_dir):
    return shown(pf.turnover_by_symbol(pf.equal_top(signals(spark, sf_dir))), ["week", "symbol"], ["change"], 6)


@query(f"WITH {SCORED}, a AS ({SQL['auc_by_language']}), c AS (SELECT lang, CAST(count(*) AS BIGINT) AS n FROM scored WHERE lang IS NOT NULL GROUP BY 1) SELECT a.lang, a.auc, c.n FROM a JOIN c ON a.lang = c.lang WHERE c.n > 25")
def regime_auc(spark, sf_dir):
    return shown(ev.by_regime(scored(spark, sf_dir), "lang", least=25), ["lang", "n"], ["auc"], 6)


def _yearly(rows):
    """Folds of two test years: training rows end before the year."""
    parts = []
    for year in (1997, 1999):
        start = F.lit(f"{year}-01-01").cast("date")
        parts += [rows.where(F.year("entry") == year).withColumns({"fold": F.lit(year), "role": F.lit("test")}), rows.where(F.col("exit") < start).withColumns({"fold": F.lit(year), "role": F.lit("train")})]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(chain(*_SPANS, "e AS (SELECT CAST(t0 AS DATE) AS entry, CAST(t1 AS DATE) AS exit FROM sp), y(fold) AS (VALUES (1997), (1999)), te AS (SELECT fold, min(entry) AS test_start, max(entry) AS test_end, CAST(count(*) AS BIGINT) AS n_test FROM e JOIN y ON year(entry) = fold GROUP BY 1), tn AS (SELECT fold, min(entry) AS train_start, max(entry) AS train_end, CAST(count(*) AS BIGINT) AS n_train FROM e JOIN y ON exit < make_date(fold, 1, 1) GROUP BY 1), o AS (SELECT fold, CAST(count(*) AS BIGINT) AS n_train_original FROM te JOIN e ON entry < test_start GROUP BY 1)") + " SELECT CAST(fold AS INTEGER) AS fold, train_start, train_end, test_start, test_end, n_train_original, n_train, n_train_original - n_train AS n_purged, n_test, false AS has_leakage FROM te JOIN tn USING (fold) JOIN o USING (fold)")
def fold_info(spark, sf_dir):
    rows = held(_spans(spark, sf_dir).select("symbol", F.col("t0").alias("entry"), F.col("t1").alias("exit")))  # each fold takes its part of them
    return ev.fold_info(rows, _yearly(rows))


_NAMED = ["ret_lag1d", "ret_lag3d", "atr14_lag1d", "atr14_lag3d", "w_close_lag1w", "w_range_lag1w"]


@query(chain(BARS, RET, stage("na", "rets", {"week": "date_trunc('week', date + INTERVAL 2 DAY)", "rg": "high - low"}), "wl AS (SELECT symbol, week, arg_max(close, date) AS c, arg_max(rg, date) AS r FROM na GROUP BY 1, 2)", "wm AS (SELECT symbol, week, lag(c) OVER (PARTITION BY symbol ORDER BY week) AS w_close_lag1w, lag(r) OVER (PARTITION BY symbol ORDER BY week) AS w_range_lag1w FROM wl)", stage("nb", "na", {"ret_lag1d": lagged("ret"), "ret_lag3d": lagged("ret", 3), "atr14_lag1d": lagged("rg"), "atr14_lag3d": lagged("rg", 3)})) + f" SELECT nb.symbol, date, {out(_NAMED, 8)} FROM nb JOIN wm ON wm.symbol = nb.symbol AND wm.week = nb.week")
def named_lags(spark, sf_dir):
    t = ft.returns(bars(spark, sf_dir)).withColumns({"atr14": F.col("high") - F.col("low"), "w_close": F.col("close"), "w_range": F.col("high") - F.col("low")}).drop("volume", "adjclose", "high", "low", "open")
    return shown(pn.lags_by_name(t, [1, 3], [1]), KEYS, _NAMED, 8)


@query(chain(BARS, WEEKLY) + " SELECT symbol, date, round(open, 7) + 0.0 AS open, round(high, 7) + 0.0 AS high, round(close, 7) + 0.0 AS close, round(volume, 7) + 0.0 AS volume FROM weekly WHERE (CAST(substr(symbol, 2) AS BIGINT) % 2 = 0 OR symbol IN ('S1', 'S3')) AND symbol IN (SELECT symbol FROM weekly GROUP BY 1 HAVING count(*) >= 10)")
def weekly_panel(spark, sf_dir):
    b = bars(spark, sf_dir)
    stocks = sp.weekly_panel(b.where(F.substring("symbol", 2, 20).cast("long") % 2 == 0))
    return shown(sp.with_benchmarks(stocks, b, ["S1", "S2", "S3"]), KEYS, ["open", "high", "close", "volume"], 7)
