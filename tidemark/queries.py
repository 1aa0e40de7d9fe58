"""Registered queries of the panel operators and their SQL twins.

Bars come from lineitem, sectors from the supplier's region, macro series from orders, scores and labels of metrics from
documents. Doubles are rounded in both, since engines add in different orders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.windows import rounded
from .operators import evaluation as ev
from .operators import factors as fc
from .operators import features as ft
from .operators import kernels as kn
from .operators import labels as lb
from .operators import macro as mc
from .operators import mapping as mp
from .operators import panel as pn
from .operators import portfolio as pf
from .operators import quality as ql
from .operators import selection as sl
from .plans import daily as pl
from .sources import bars as src

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Register a query under its function's name, with its SQL twin."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.bars_from_lines(table(spark, sf_dir, "lineitem"))


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.concat(F.lit("S"), "s_suppkey").alias("symbol"), F.col("r_name").alias("sector"))


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("flow"), F.max("o_totalprice").alias("peak"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select("doc_id", "lang", ((F.col("n_chars") % 1000) / 1000).alias("p"), F.col("quality").alias("y"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last bar of each symbol and week with its later return: probability from momentum of the bar's range."""
    w = Window.partitionBy("symbol").orderBy("date")
    b = bars(spark, sf_dir)
    b = b.withColumns({"probability": F.round((F.col("volume") % 97) / 97, 4), "actual_return": F.round(F.least(F.greatest(F.lead("close", 2).over(w) / F.col("close") - 1, F.lit(-0.3)), F.lit(0.3)), 4), "week": F.date_trunc("week", "date").cast("date")})
    return b.where("actual_return is not null").withColumn("__k", F.row_number().over(Window.partitionBy("symbol", "week").orderBy(F.desc("date")))).where("__k = 1").join(sectors(spark, sf_dir), "symbol").select("symbol", "sector", "week", "probability", "actual_return", "close", "volume")


def shown(df: DataFrame, keys: list[str], columns: list[str], digits: int = 5) -> DataFrame:
    return df.select(*keys, *(rounded(F.col(c).cast("double"), digits).alias(c) for c in columns))


# SQL pieces

BARS = """bars AS (SELECT 'S' || l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date,
 first(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice / l_quantity) AS open,
 max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
 last(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice / l_quantity) AS close,
 sum(l_quantity) AS volume FROM lineitem GROUP BY ALL)"""
SECTORS = "sectors AS (SELECT 'S' || s_suppkey AS symbol, r_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
MACRO = "macro AS (SELECT CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS flow, max(o_totalprice) AS peak FROM orders GROUP BY 1)"
SCORED = "scored AS (SELECT doc_id, lang, (n_chars % 1000) / 1000 AS p, quality AS y FROM documents JOIN labels USING (doc_id))"
S = "PARTITION BY symbol ORDER BY date"
SIGNALS = f"""sig0 AS (SELECT *, round((volume % 97) / 97, 4) AS probability,
 round(least(greatest(lead(close, 2) OVER ({S}) / close - 1, -0.3), 0.3), 4) AS actual_return, CAST(date_trunc('week', date) AS DATE) AS week FROM bars),
signals AS (SELECT symbol, sector, week, probability, actual_return, close, volume FROM (SELECT *, row_number() OVER (PARTITION BY symbol, week ORDER BY date DESC) AS k
 FROM sig0 WHERE actual_return IS NOT NULL) JOIN sectors USING (symbol) WHERE k = 1)"""


def rw(w: int) -> str:
    return f"({S} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


def roll(fn: str, x: str, w: int, least: int) -> str:
    return f"CASE WHEN count({x}) OVER {rw(w)} >= {least} THEN {fn}({x}) OVER {rw(w)} END"


def mean(x: str, w: int, least: int | None = None) -> str:
    return roll("avg", x, w, least or max(5, w // 3))


def dev(x: str, w: int, least: int | None = None, fn: str = "stddev_pop") -> str:
    return roll(fn, x, w, least or max(5, w // 3))


def over(a: str, b: str) -> str:
    return f"(CASE WHEN abs({b}) > 1e-12 THEN ({a}) / ({b}) END)"


def z(x: str, w: int, least: int | None = None) -> str:
    return over(f"{x} - ({mean(x, w, least)})", f"({dev(x, w, least)})")


def sample_z(x: str, w: int, least: int) -> str:
    return over(f"{x} - ({mean(x, w, least)})", f"({dev(x, w, least, 'stddev_samp')})")


def lagged(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({S})"


def clipped(x: str, lo: float, hi: float) -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN greatest(least({x}, {hi}), {lo}) END)"


def out(columns: list[str], digits: int = 5) -> str:
    return ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}" for c in columns)


def stage(name: str, before: str, columns: dict[str, str]) -> str:
    return f"{name} AS (SELECT *, " + ", ".join(f"{x} AS {c}" for c, x in columns.items()) + f" FROM {before})"


def chain(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


RET = stage("rets", "bars", {"ret": f"ln(close) - ln({lagged('close')})"})

# sources and quality


@query(chain(BARS) + " SELECT symbol, date, " + out(["open", "high", "low", "close", "volume"], 7) + " FROM bars")
def daily_bars(spark, sf_dir):
    return shown(bars(spark, sf_dir), ["symbol", "date"], ["open", "high", "low", "close", "volume"], 7)


@query(chain(BARS) + " SELECT symbol, date, metric, round(value, 7) + 0.0 AS value FROM (UNPIVOT (SELECT symbol, date, open, high, low, close, close AS adjclose, volume FROM bars) ON open, high, low, close, adjclose, volume INTO NAME metric VALUE value)")
def bars_to_long(spark, sf_dir):
    return shown(src.to_long(bars(spark, sf_dir)), ["symbol", "date", "metric"], ["value"], 7)


@query(chain(BARS) + " SELECT symbol, date, " + out(["open", "high", "low", "close", "volume"], 7) + " FROM bars")
def long_to_wide(spark, sf_dir):
    return shown(src.to_wide(src.to_long(bars(spark, sf_dir))), ["symbol", "date"], ["open", "high", "low", "close", "volume"], 7)


@query(chain(BARS, RET) + " SELECT symbol, date, " + out(["ret"], 8) + " FROM rets")
def log_returns(spark, sf_dir):
    return shown(ft.returns(bars(spark, sf_dir)), ["symbol", "date"], ["ret"], 8)


@query("SELECT p_partkey, p_name FROM part WHERE NOT regexp_matches(p_name, '(?i)\\b(?:red|blue)\\b') AND NOT regexp_matches(p_type, '(?i)promo|brushed')")
def pattern_filter(spark, sf_dir):
    return ql.tradeable(table(spark, sf_dir, "part"), "p_name", "p_type", names=(r"(?i)\b(?:red|blue)\b",), words=(r"(?i)promo|brushed",)).select("p_partkey", "p_name")


@query(chain(BARS) + " SELECT symbol, CAST(count(*) AS BIGINT) AS n FROM bars WHERE symbol IN (SELECT symbol FROM bars GROUP BY 1 HAVING max(close) <= 90000 AND min(close) >= 0.01 AND max(close) / min(close) <= 4000) GROUP BY 1")
def suspicious_prices(spark, sf_dir):
    return ql.plausible_prices(bars(spark, sf_dir), most=90_000.0, ratio=4_000.0).groupBy("symbol").agg(F.count("*").alias("n"))


ATR = stage("tr", "bars", {"t": f"greatest(high - low, abs(high - {lagged('close')}), abs(low - {lagged('close')}))"}).replace("greatest(high - low, abs", f"CASE WHEN {lagged('close')} IS NULL THEN high - low ELSE greatest(high - low, abs").replace("AS t FROM", "END AS t FROM") + ",\n" + stage("entries", "tr", {"atr": roll("avg", "t", 14, 14)})


@query(chain(BARS, ATR) + " SELECT symbol, CAST(count(*) AS BIGINT) AS n, round(avg(atr), 5) + 0.0 AS mean_atr FROM entries WHERE close > 0 AND atr > 0 AND symbol IN (SELECT symbol FROM entries WHERE close > 0 AND atr > 0 GROUP BY 1 HAVING count(*) >= 25) GROUP BY 1")
def label_input(spark, sf_dir):
    return ql.label_input(lb.with_atr(bars(spark, sf_dir)), most=1e6, ratio=1e9).groupBy("symbol").agg(F.count("*").alias("n"), (F.round(F.avg("atr"), 5) + 0.0).alias("mean_atr"))


@query(chain(BARS, RET) + ", a AS (SELECT symbol, date, ret, avg(ret) OVER () AS m, stddev_samp(ret) OVER () AS s FROM rets WHERE abs(ret) <= 1) SELECT symbol, date, round(ret, 8) + 0.0 AS ret FROM a WHERE abs(ret - m) <= 2.5 * s")
def extreme_returns(spark, sf_dir):
    return shown(ql.extreme_returns(ft.returns(bars(spark, sf_dir)), ["ret"], z=2.5), ["symbol", "date"], ["ret"], 8)


@query(
    chain(BARS, "gaps AS (SELECT symbol, date, CASE WHEN (CAST(substr(symbol, 2) AS BIGINT) + dayofyear(date)) % 17 <> 0 THEN close END AS close FROM bars)")
    + f", f AS (SELECT *, last_value(close IGNORE NULLS) OVER b AS p, first_value(close IGNORE NULLS) OVER a AS n, last_value(CASE WHEN close IS NOT NULL THEN date END IGNORE NULLS) OVER b AS t, first_value(CASE WHEN close IS NOT NULL THEN date END IGNORE NULLS) OVER a AS u FROM gaps WINDOW b AS ({S} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS ({S} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
    + " SELECT symbol, date, round(coalesce(close, p + (n - p) * (date - t) / nullif(u - t, 0)), 7) + 0.0 AS close_filled FROM f"
)
def gap_fill(spark, sf_dir):
    b = bars(spark, sf_dir).withColumn("close", F.when((F.substring("symbol", 2, 20).cast("long") + F.dayofyear("date")) % 17 != 0, F.col("close")))
    return shown(ql.fill_gaps(b, "close"), ["symbol", "date"], ["close_filled"], 7)


@query(chain(BARS, RET) + " SELECT symbol, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(CASE WHEN ret IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null, round(1 - sum(CASE WHEN ret IS NULL THEN 1 ELSE 0 END) / (count(*) * 2), 6) + 0.0 AS completeness FROM rets GROUP BY 1")
def symbol_quality(spark, sf_dir):
    return shown(ql.symbol_quality(ft.returns(bars(spark, sf_dir)), ["close", "ret"]), ["symbol", "n_rows", "n_null"], ["completeness"], 6)


@query(chain(BARS, RET) + " SELECT 'ret' AS feature, round(avg(CASE WHEN ret IS NULL THEN 1.0 ELSE 0 END), 6) + 0.0 AS null_share, 'returns' AS category, 'healthy' AS state FROM rets UNION ALL SELECT 'volume', 0.0, 'volume', 'healthy'")
def null_profile(spark, sf_dir):
    return shown(ql.null_profile(ft.returns(bars(spark, sf_dir)), ["ret", "volume"], {"ret": "returns", "vol": "volume"}), ["feature", "category", "state"], ["null_share"], 6)


@query(chain(BARS) + ", s AS (SELECT date, count(close) / (SELECT count(DISTINCT symbol) FROM bars) AS share FROM bars GROUP BY 1) SELECT coalesce((SELECT max(date) FROM s WHERE share >= 0.4), (SELECT date FROM s ORDER BY share DESC, date DESC LIMIT 1)) AS date")
def latest_valid_date(spark, sf_dir):
    return ql.latest_valid_date(bars(spark, sf_dir), 0.4)


@query(chain(BARS) + " SELECT symbol, date, round(close, 5) + 0.0 AS close FROM bars WHERE date = (SELECT date FROM bars ORDER BY abs(date - DATE '1998-06-30'), date LIMIT 1)")
def snapshot_rows(spark, sf_dir):
    return shown(ql.snapshot(bars(spark, sf_dir), "1998-06-30"), ["symbol", "date"], ["close"])


@query(chain(BARS) + ", t AS (SELECT symbol FROM bars GROUP BY 1 HAVING count(*) >= 100 ORDER BY count(*) DESC, symbol LIMIT 20) SELECT symbol, CAST(count(*) AS BIGINT) AS n FROM bars WHERE symbol IN (SELECT symbol FROM t) GROUP BY 1")
def top_symbols(spark, sf_dir):
    return ql.top_symbols(bars(spark, sf_dir), 20, 100).groupBy("symbol").agg(F.count("*").alias("n"))


@query("SELECT CAST(count(*) FILTER (WHERE value IS NULL) AS BIGINT) AS null_probability, CAST(count(*) FILTER (WHERE value < 0 OR value > 1) AS BIGINT) AS probability_out_of_range, CAST(count(*) FILTER (WHERE value <= 0) AS BIGINT) AS price_not_positive, (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) FROM (SELECT count(*) AS c FROM events GROUP BY user_id, CAST(ts AS DATE) HAVING count(*) > 1)) AS duplicate_keys FROM events")
def signal_problems(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return ql.signal_problems(e.select(F.col("user_id").alias("symbol"), F.to_date("ts").alias("signal_date"), F.col("value").alias("probability"), F.col("value").alias("entry_price")))


# windows of one symbol

_MA = stage("m", "bars", {f"ma_{p}": roll("avg", "close", p, max(5, p // 2)) for p in ft.MA})
_SL = stage("s", "m", {f"pct_slope_ma_{p}": over(f"ma_{p}", lagged(f"ma_{p}", 20)) + " - 1" for p in ft.MA})
_SG = stage("g", "s", {f"sign_ma_{p}": f"CASE WHEN pct_slope_ma_{p} > 1e-5 THEN 1.0 WHEN pct_slope_ma_{p} < -1e-5 THEN -1.0 ELSE 0.0 END" for p in ft.MA})
_UP, _DN = (" + ".join(f"CASE WHEN sign_ma_{p} {o} 0 THEN 1 ELSE 0 END" for p in ft.MA) for o in "><")
_TS = stage("t", "g", {"up": _UP, "dn": _DN}) + ", " + stage("v", "t", {"trend_score_granular": "CASE WHEN up + dn > 0 THEN (up - dn) / (up + dn) ELSE 0.0 END", "trend_alignment": "CASE WHEN up + dn > 0 THEN up / (up + dn) END"})
_TREND = [*(f"ma_{p}" for p in (10, 50, 200)), *(f"pct_slope_ma_{p}" for p in (10, 50, 200)), "trend_score_granular", "trend_alignment", "trend_score_sign", "trend_score_slope"]


@query(chain(BARS, _MA, _SL, _SG, _TS, stage("w", "v", {"trend_score_sign": "sign(trend_score_granular)", "trend_score_slope": f"trend_score_granular - {lagged('trend_score_granular')}"})) + f" SELECT symbol, date, {out(_TREND)} FROM w")
def trend(spark, sf_dir):
    return shown(ft.trend(bars(spark, sf_dir)), ["symbol", "date"], _TREND)


_VOL = [*(f"rv_{w}" for w in (10, 20, 60, 100)), "rv_ratio_10_60", "rv_ratio_20_100", "rv_z_60", "vol_regime", "rv_vol_of_vol_20d", "rv60_slope_norm", "rv100_slope_norm"]
_VSQL = [BARS, RET, stage("v", "rets", {f"rv_{w}": dev("ret", w) for w in (10, 20, 60, 100)}), stage("w", "v", {"rv_ratio_10_60": over("rv_10", "rv_60"), "rv_ratio_20_100": over("rv_20", "rv_100"), "rv_z_60": z("rv_20", 60), "stp": f"rv_20 - {lagged('rv_20')}"}), stage("x", "w", {"vol_regime": "ln(1 + rv_ratio_20_100)", "rv_vol_of_vol_20d": dev("stp", 20, 5), "rv60_slope_norm": f"({over('rv_60', lagged('rv_60', 20))} - 1) / 20", "rv100_slope_norm": f"({over('rv_100', lagged('rv_100', 20))} - 1) / 20"})]


@query(chain(*_VSQL) + f" SELECT symbol, date, {out(_VOL)} FROM x")
def volatility(spark, sf_dir):
    return shown(ft.volatility(ft.returns(bars(spark, sf_dir))), ["symbol", "date"], _VOL)


@query(chain(*_VSQL, stage("y", "x", {"vol_regime_cs_median": "ln(1 + quantile_cont(rv_ratio_20_100, 0.5) OVER (PARTITION BY date))"})) + " SELECT symbol, date, round(vol_regime_cs_median, 5) + 0.0 AS vol_regime_cs_median, round(vol_regime - vol_regime_cs_median, 5) + 0.0 AS vol_regime_rel FROM y")
def relative_volatility(spark, sf_dir):
    return shown(ft.relative_volatility(ft.volatility(ft.returns(bars(spark, sf_dir)))), ["symbol", "date"], ["vol_regime_cs_median", "vol_regime_rel"])


_D = [f"pct_dist_ma_{w}" for w in (20, 50, 100, 200)] + ["relative_dist_20_50"]


@query(chain(BARS, stage("m", "bars", {f"ma_{w}": roll("avg", "close", w, max(5, w // 2)) for w in (20, 50, 100, 200)}), stage("d", "m", {f"pct_dist_ma_{w}": over(f"close - ma_{w}", f"ma_{w}") for w in (20, 50, 100, 200)} | {"relative_dist_20_50": over("ma_20 - ma_50", "ma_50")}), stage("e", "d", {f"{c}_z": z(c, 60) for c in _D} | {"min_pct_dist_ma": "least(" + ", ".join(f"abs({c})" for c in _D[:4]) + ")"})) + f" SELECT symbol, date, {out([*_D, *(f'{c}_z' for c in _D), 'min_pct_dist_ma'])} FROM e")
def distance_to_averages(spark, sf_dir):
    return shown(ft.distance(bars(spark, sf_dir)), ["symbol", "date"], [*_D, *(f"{c}_z" for c in _D), "min_pct_dist_ma"])


_TR = stage("b1", "bars", {"pc": lagged("close")}) + ", " + stage("b2", "b1", {"true_range": "CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END"})
_RB = ["gap_pct", "overnight_ret", "gap_fill_frac", "tr_pct_close", "hl_range_pct_close", "range_x_rvol20", *(c for w in (5, 10, 20) for c in (f"{w}d_range_pct_close", f"pos_in_{w}d_range", f"breakout_up_{w}d", f"breakout_dn_{w}d", f"range_expansion_{w}d", f"range_z_{w}d"))]


def _q(c: str) -> str:
    return f'"{c}"'


@query(
    chain(BARS, _TR, stage("c", "b2", {"hl_range": "high - low", "gap_pct": over("close", "pc") + " - 1", "overnight_ret": over("open", "pc") + " - 1", "gap_fill_frac": "CASE WHEN open - pc > 1e-12 THEN greatest(least((open - low) / (open - pc), 1.0), 0.0) WHEN open - pc < -1e-12 THEN greatest(least((high - open) / (pc - open), 1.0), 0.0) ELSE 0.0 END", "tr_pct_close": over("true_range", "close"), "hl_range_pct_close": over("high - low", "close")} | {f"h{w}": roll("max", "high", w, max(2, w // 3)) for w in (5, 10, 20)} | {f"l{w}": roll("min", "low", w, max(2, w // 3)) for w in (5, 10, 20)}), stage("d", "c", {f"r{w}": f"h{w} - l{w}" for w in (5, 10, 20)}), stage("e", "d", {"range_x_rvol20": over("hl_range_pct_close", over("volume", f"({mean('volume', 20, 5)})"))} | {k: v for w in (5, 10, 20) for k, v in {_q(f"{w}d_range_pct_close"): over(f"r{w}", "close"), f"pos_in_{w}d_range": over(f"close - l{w}", f"r{w}"), f"breakout_up_{w}d": f"CASE WHEN close > {lagged(f'h{w}')} THEN 1.0 ELSE 0.0 END", f"breakout_dn_{w}d": f"CASE WHEN close < {lagged(f'l{w}')} THEN 1.0 ELSE 0.0 END", f"range_expansion_{w}d": over(f"r{w}", lagged(f"r{w}")) + " - 1", f"range_z_{w}d": clipped(z(f"r{w}", 60, 20), -10.0, 10.0)}.items()}))
    + f" SELECT symbol, date, {out([_q(c) for c in _RB])} FROM e"
)
def range_breakout(spark, sf_dir):
    return shown(ft.range_breakout(bars(spark, sf_dir)), ["symbol", "date"], _RB)


_VO = ["vol_ma_20", "vol_ma_50", "vol_z_20", "vol_z_60", "rvol_20", "rvol_50", "obv", "obv_z_60", "volume_vol_of_vol_20d", "volshock_z", "volshock_dir", "rdollar_vol_20"]


@query(
    chain(BARS, stage("a", "bars", {"vol_ma_20": mean("volume", 20, 5), "vol_ma_50": mean("volume", 50, 10), "vol_z_20": z("volume", 20, 5), "vol_z_60": z("volume", 60, 15), "dollar": "close * volume", "stp": f"coalesce(sign(close - {lagged('close')}), 0.0) * volume", "ls": f"ln(volume) - ln({lagged('volume')})", "volshock_z": z("volume", 20), "turn": f"sign(close - {lagged('close', 10)})"}), stage("b", "a", {"rvol_20": over("volume", "vol_ma_20"), "rvol_50": over("volume", "vol_ma_50"), "dm": mean("dollar", 20, 5), "obv": f"sum(stp) OVER ({S} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "volume_vol_of_vol_20d": dev("ls", 20, 5), "volshock_dir": "volshock_z * turn"}), stage("c", "b", {"rdollar_vol_20": over("dollar", "dm"), "obv_z_60": z("obv", 60, 20)}))
    + f" SELECT symbol, date, {out(_VO)} FROM c"
)
def volume_block(spark, sf_dir):
    return shown(ft.volume(bars(spark, sf_dir)), ["symbol", "date"], _VO)


_LQ = ["hl_spread_proxy", "cs_spread_est", "roll_spread_est", "overnight_ratio", "upper_shadow_ratio", "volume_direction", "volume_trend_10d", "pv_divergence_5d", "vwap_dist_5d", "vwap_dist_20d", "rel_volume_10d", "zero_vol_pct_20d"]


@query(
    chain(BARS, stage("a", "bars", {"pc": lagged("close"), "hl": "greatest(high - low, 1e-8)", "lh": "power(ln(high / greatest(low, 1e-8)), 2)", "h2": f"greatest(high, coalesce({lagged('high')}, high))", "l2": f"least(low, coalesce({lagged('low')}, low))", "dp": f"close - {lagged('close')}", "tpv": "(high + low + close) / 3 * volume"}), stage("b", "a", {"beta": f"lh + {lagged('lh')}", "gamma": "power(ln(h2 / greatest(l2, 1e-8)), 2)", "dp1": lagged("dp"), "mv": "abs(open - pc)"}), stage("b3", "b", {"al": "(sqrt(2 * beta) - sqrt(beta)) / (3 - 2 * sqrt(2)) - sqrt(gamma / (3 - 2 * sqrt(2)))", "bth": "CASE WHEN dp1 IS NOT NULL THEN dp END"}), stage("c", "b3", {"hl_spread_proxy": "hl / close", "cs_spread_est": "CASE WHEN al IS NOT NULL THEN greatest(2 * (exp(al) - 1) / (1 + exp(al)), 0.0) END", "cv": f"CASE WHEN count(bth) OVER {rw(20)} >= 10 THEN covar_samp(dp, dp1) OVER {rw(20)} END", "overnight_ratio": "mv / (mv + abs(close - open) + 1e-8)", "upper_shadow_ratio": "(high - greatest(open, close)) / hl", "volume_direction": "sign(close - open) * volume", "volume_trend_10d": f"({mean('volume', 5, 2)}) / greatest({mean('volume', 20, 5)}, 1.0)", "pv_divergence_5d": f"({over('close', lagged('close', 5))} - 1) - ({over('volume', lagged('volume', 5))} - 1)", "rel_volume_10d": f"volume / greatest({mean('volume', 10, 5)}, 1.0)", "zero_vol_pct_20d": f"CASE WHEN count(*) OVER {rw(20)} >= 10 THEN avg(CASE WHEN volume = 0 THEN 1.0 ELSE 0.0 END) OVER {rw(20)} END"} | {f"vw{w}": f"({roll('sum', 'tpv', w, w // 2)}) / greatest({roll('sum', 'volume', w, w // 2)}, 1.0)" for w in (5, 20)}), stage("d", "c", {"roll_spread_est": "CASE WHEN cv IS NOT NULL THEN 2 * sqrt(greatest(-cv, 0.0)) / close END"} | {f"vwap_dist_{w}d": f"(close - vw{w}) / greatest(vw{w}, 1e-8) * 100" for w in (5, 20)}))
    + f" SELECT symbol, date, {out(_LQ, 7)} FROM d"
)
def liquidity_block(spark, sf_dir):
    return shown(ft.liquidity(bars(spark, sf_dir)), ["symbol", "date"], _LQ, 7)


_DD = ["drawdown_expanding", "drawdown_regime", "hl_range_position_60d", *(f"{a}_{w}d{b}" for w in (20, 60, 120) for a, b in (("drawdown", ""), ("recovery", ""), ("drawdown", "_z"), ("days_since_high", ""), ("drawdown_velocity", "")))]


@query(
    chain(BARS, stage("a", "bars", {f"hi{w}": roll("max", "close", w, max(2, w // 3)) for w in (20, 60, 120)} | {f"lo{w}": roll("min", "close", w, max(2, w // 3)) for w in (20, 60, 120)} | {"top": f"max(close) OVER ({S} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"}), stage("b", "a", {f"drawdown_{w}d": over(f"close - hi{w}", f"hi{w}") for w in (20, 60, 120)} | {f"recovery_{w}d": over(f"close - lo{w}", f"lo{w}") for w in (20, 60, 120)} | {f"at{w}": f"sum(CASE WHEN close >= hi{w} - 1e-12 THEN 1 ELSE 0 END) OVER ({S} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)" for w in (20, 60, 120)}), stage("c", "b", {"drawdown_expanding": over("close - top", "top"), "drawdown_regime": "CASE WHEN drawdown_60d > -0.05 THEN 0 WHEN drawdown_60d > -0.15 THEN 1 ELSE 2 END", "hl_range_position_60d": over("close - lo60", "hi60 - lo60")} | {k: v for w in (20, 60, 120) for k, v in {f"days_since_high_{w}d": f"row_number() OVER (PARTITION BY symbol, at{w} ORDER BY date) - 1", f"drawdown_{w}d_z": clipped(z(f"drawdown_{w}d", 252, 60), -5.0, 5.0), f"drawdown_velocity_{w}d": f"drawdown_{w}d - {lagged(f'drawdown_{w}d', 5)}"}.items()}))
    + f" SELECT symbol, date, {out(_DD)} FROM c"
)
def drawdown_block(spark, sf_dir):
    return shown(ft.drawdown(bars(spark, sf_dir)), ["symbol", "date"], _DD)


@query(chain(BARS, stage("a", "bars", {"bb_width": over(f"4.0 * ({roll('stddev_pop', 'close', 20, 20)})", f"({roll('avg', 'close', 20, 20)})")}), stage("b", "a", {"bb_width_z60": z("bb_width", 60)})) + f" SELECT symbol, date, {out(['bb_width', 'bb_width_z60'])} FROM b")
def bollinger(spark, sf_dir):
    return shown(ft.bollinger(bars(spark, sf_dir)), ["symbol", "date"], ["bb_width", "bb_width_z60"])


@query(chain(BARS, _TR, stage("c", "b2", {"sp": f"({roll('max', 'high', 14, 14)}) - ({roll('min', 'low', 14, 14)})", "sm": roll("sum", "true_range", 14, 14)})) + " SELECT symbol, date, round(CASE WHEN sp > 0 THEN 100 * log10(sm / sp) / log10(14) END, 5) + 0.0 AS chop_14 FROM c")
def choppiness(spark, sf_dir):
    return shown(ft.choppiness(bars(spark, sf_dir)), ["symbol", "date"], ["chop_14"])


@query(
    chain(BARS, _TR, stage("c", "b2", {"dv": roll("stddev_pop", "close", 20, 20), "ar": roll("avg", "true_range", 20, 20)}), stage("d", "c", {"so": "coalesce(2.0 * dv < 1.5 * ar, false)", "squeeze_intensity": over("2.0 * dv", "1.5 * ar")}), stage("e", "d", {"isl": f"sum(CASE WHEN so THEN 0 ELSE 1 END) OVER ({S} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "rel": f"coalesce(lag(so) OVER ({S}) AND NOT so, false)"}))
    + " SELECT symbol, date, so AS squeeze_on, rel AS squeeze_release, round(squeeze_intensity, 5) + 0.0 AS squeeze_intensity, CAST(CASE WHEN so THEN least(sum(CASE WHEN so THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, isl ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 50) ELSE 0 END AS BIGINT) AS squeeze_days FROM e"
)
def squeeze(spark, sf_dir):
    return shown(ft.squeeze(bars(spark, sf_dir)), ["symbol", "date", "squeeze_on", "squeeze_release", F.col("squeeze_days").cast("long").alias("squeeze_days")], ["squeeze_intensity"])


@query(chain(BARS, stage("a", "bars", {"n": f"CAST(row_number() OVER ({S}) AS DOUBLE)"})) + f" SELECT symbol, date, round(CASE WHEN count(close) OVER {rw(20)} >= 6 THEN regr_slope(close, n) OVER {rw(20)} END, 4) + 0.0 AS slope_20 FROM a")
def rolling_slope(spark, sf_dir):
    return shown(ft.slope(bars(spark, sf_dir), "close", 20, "slope_20"), ["symbol", "date"], ["slope_20"], 4)


@query(chain(BARS) + f" SELECT symbol, date, round(CASE WHEN count(*) OVER w >= 20 THEN len(list_filter(list(close) OVER w, lambda v: v < close)) / len(list(close) OVER w) * 100 END, 5) + 0.0 AS pct_60 FROM bars WINDOW w AS ({S} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)")
def prior_percentile(spark, sf_dir):
    return shown(ft.prior_percentile(bars(spark, sf_dir), "close", 60, 20, "pct_60"), ["symbol", "date"], ["pct_60"])


@query(chain(BARS) + f" SELECT symbol, date, round({lagged('close', 1)}, 7) + 0.0 AS close_lag1d, round({lagged('close', 2)}, 7) + 0.0 AS close_lag2d, round({lagged('close', 5)}, 7) + 0.0 AS close_lag5d FROM bars")
def daily_lags(spark, sf_dir):
    return shown(ft.lags(bars(spark, sf_dir), ["close"], ft.parse_lags("1-2,5")), ["symbol", "date"], ["close_lag1d", "close_lag2d", "close_lag5d"], 7)


def _fold(x: str, a: float, name: str) -> str:
    return f"list_reduce(list({x}) OVER ({S} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda p, q: p + {a} * (q - p)) AS {name}"


@query(chain(BARS) + f" SELECT symbol, date, round(e10, 6) + 0.0 AS ema_10, round(e39, 6) + 0.0 AS ema_39 FROM (SELECT *, {_fold('close', 2 / 11, 'e10')}, {_fold('close', 2 / 40, 'e39')} FROM bars)")
def exponential_means(spark, sf_dir):
    return shown(kn.recursive(bars(spark, sf_dir), ["ewm"]), ["symbol", "date"], ["ema_10", "ema_39"], 6)


@query(None)
def hurst_exponent(spark, sf_dir):
    return shown(kn.recursive(bars(spark, sf_dir), ["hurst"]), ["symbol", "date"], ["hurst_128", "hurst_128_ema5"])


# resampling, joins, benchmarks

FRIDAY = "date + CAST((12 - dayofweek(date)) % 7 AS INTEGER)"
WEEKLY = f"weekly AS (SELECT symbol, CAST({FRIDAY} AS DATE) AS date, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2)"


@query(chain(BARS, WEEKLY) + f" SELECT symbol, date, {out(['open', 'high', 'low', 'close', 'volume'], 7)}, round(ln(close) - ln({lagged('close')}), 8) + 0.0 AS ret FROM weekly")
def weekly_bars(spark, sf_dir):
    w = pn.resample(bars(spark, sf_dir)).withColumn("ret", F.round("ret", 8) + 0.0)
    return shown(w, ["symbol", "date", "ret"], ["open", "high", "low", "close", "volume"], 7)


@query(chain(BARS) + f", monthly AS (SELECT symbol, last_day(date) AS date, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2) SELECT symbol, date, {out(['open', 'high', 'low', 'close', 'volume'], 7)} FROM monthly")
def monthly_bars(spark, sf_dir):
    return shown(pn.resample(bars(spark, sf_dir), "month"), ["symbol", "date"], ["open", "high", "low", "close", "volume"], 7)


@query(chain(BARS, WEEKLY) + " SELECT date, CAST(count(*) AS BIGINT) AS n FROM weekly WHERE date <= DATE '1999-06-25' GROUP BY 1")
def complete_weeks(spark, sf_dir):
    return pn.complete_weeks(pn.resample(bars(spark, sf_dir)), "1999-06-30").groupBy("date").agg(F.count("*").alias("n"))


@query(chain(BARS, RET) + f" SELECT symbol, CAST({FRIDAY} AS DATE) AS week_end, round(exp(sum(ret)) - 1, 5) + 0.0 AS week_ret FROM rets GROUP BY 1, 2")
def compound_weekly(spark, sf_dir):
    return shown(pn.compound_weekly(ft.returns(bars(spark, sf_dir))), ["symbol", "week_end"], ["week_ret"])


@query(chain(BARS, WEEKLY) + " SELECT b.symbol, b.date, round(b.close, 7) + 0.0 AS close, round(w.close, 7) + 0.0 AS w_close, round(w.volume, 7) + 0.0 AS w_volume FROM bars b ASOF LEFT JOIN weekly w ON b.symbol = w.symbol AND b.date >= w.date")
def asof_weekly(spark, sf_dir):
    b = bars(spark, sf_dir)
    w = pn.resample(b).select("symbol", "date", F.col("close").alias("w_close"), F.col("volume").alias("w_volume"))
    return shown(pn.as_of(b, w, ["w_close", "w_volume"], ["symbol"]), ["symbol", "date"], ["close", "w_close", "w_volume"], 7)


@query(chain(BARS, MACRO) + f", j AS (SELECT symbol, b.date, flow, peak FROM bars b LEFT JOIN macro m ON b.date = m.date) SELECT symbol, date, round({lagged('flow')}, 3) + 0.0 AS flow, round({lagged('peak')}, 3) + 0.0 AS peak FROM j")
def macro_lagged(spark, sf_dir):
    return shown(pn.attach_macro(bars(spark, sf_dir), macro(spark, sf_dir), ["flow", "peak"]), ["symbol", "date"], ["flow", "peak"], 3)


@query("WITH s AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS k, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2), d AS (SELECT date, max(CASE WHEN k = '1-URGENT' THEN v END) AS urgent, max(CASE WHEN k = '2-HIGH' THEN v END) AS high FROM s GROUP BY 1) SELECT date, round(last_value(urgent IGNORE NULLS) OVER w, 3) + 0.0 AS urgent, round(last_value(high IGNORE NULLS) OVER w, 3) + 0.0 AS high FROM d WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def macro_series(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("series")).agg(F.sum("o_totalprice").alias("value"))
    m = src.macro_table(o, ["1-URGENT", "2-HIGH"]).withColumnsRenamed({"1-URGENT": "urgent", "2-HIGH": "high"})
    return shown(m, ["date"], ["urgent", "high"], 3)


BENCH = "both_b AS (SELECT b.date, b.close, unnest(['ALL', sector]) AS bench FROM bars b LEFT JOIN sectors USING (symbol)), px AS (SELECT bench, date, avg(close) AS px FROM both_b WHERE bench IS NOT NULL GROUP BY 1, 2), bench AS (SELECT *, ln(px) - ln(lag(px) OVER (PARTITION BY bench ORDER BY date)) AS bench_ret FROM px)"


@query(chain(BARS, SECTORS, BENCH) + " SELECT bench, date, round(px, 8) + 0.0 AS px, round(bench_ret, 7) + 0.0 AS bench_ret FROM bench")
def benchmark_series(spark, sf_dir):
    b = pn.benchmarks(bars(spark, sf_dir), sectors(spark, sf_dir)).withColumn("bench_ret", F.round("bench_ret", 7) + 0.0)
    return shown(b, ["bench", "date", "bench_ret"], ["px"], 8)


def _with_market(spark, sf_dir):
    b = ft.returns(bars(spark, sf_dir))
    m = pn.benchmarks(b, sectors(spark, sf_dir)).where("bench = 'ALL'").select("date", "px", "bench_ret")
    return b.join(pn.small(m), "date")


_BA = stage("ba", "j", {"y": "CASE WHEN ret IS NOT NULL AND bench_ret IS NOT NULL THEN ret END", "x": "CASE WHEN ret IS NOT NULL AND bench_ret IS NOT NULL THEN bench_ret END"})
_J = "j AS (SELECT r.*, px, bench_ret FROM rets r JOIN bench b ON b.bench = 'ALL' AND b.date = r.date)"


@query(chain(BARS, SECTORS, BENCH, RET, _J, _BA, stage("bb", "ba", {"beta": f"CASE WHEN count(x) OVER {rw(60)} >= 20 THEN {over(f'covar_samp(y, x) OVER {rw(60)}', f'var_samp(x) OVER {rw(60)}')} END"}), stage("bc", "bb", {"alpha": "ret - beta * bench_ret"}), stage("bd", "bc", {"mom_20": roll("sum", "alpha", 20, 6), "mom_60": roll("sum", "alpha", 60, 20)})) + f" SELECT symbol, date, {out(['beta', 'alpha', 'mom_20', 'mom_60'], 4)} FROM bd")
def beta_and_alpha(spark, sf_dir):
    t = pn.alpha_momentum(pn.beta_alpha(_with_market(spark, sf_dir), "ret", "bench_ret"), "alpha", "mom", (20, 60))
    return shown(t, ["symbol", "date"], ["beta", "alpha", "mom_20", "mom_60"], 4)


@query(chain(BARS, SECTORS, BENCH, RET, _J, stage("ra", "j", {"rs": over("close", "px")}), stage("rb", "ra", {"rs_norm": over("rs", f"({mean('rs', 60)})") + " - 1", "rs_z20": over(f"rs - ({mean('rs', 20)})", f"({dev('rs', 20, 6, 'stddev_samp')})")})) + f" SELECT symbol, date, {out(['rs', 'rs_norm', 'rs_z20'])} FROM rb")
def relative_strength(spark, sf_dir):
    return shown(pn.relative_strength(_with_market(spark, sf_dir), "close", "px"), ["symbol", "date"], ["rs", "rs_norm", "rs_z20"])


_FIT = "fit AS (SELECT symbol, bench, CAST(count(*) AS BIGINT) AS n, covar_samp(ret, bench_ret) AS c, var_samp(ret) AS v, var_samp(bench_ret) AS u FROM rets r JOIN bench USING (date) WHERE ret IS NOT NULL AND bench_ret IS NOT NULL GROUP BY 1, 2)"


@query(chain(BARS, SECTORS, BENCH, RET, _FIT) + ", q AS (SELECT *, c * c / (v * u) AS r2 FROM fit WHERE n >= 100) SELECT symbol, bench, n, round(r2, 6) + 0.0 AS r2 FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(r2, 9) DESC, bench) AS k FROM q WHERE r2 > 0) WHERE k = 1")
def best_match(spark, sf_dir):
    b = ft.returns(bars(spark, sf_dir))
    return shown(pn.best_match(b, pn.benchmarks(b, sectors(spark, sf_dir))), ["symbol", "bench", "n"], ["r2"], 6)


@query(chain(BARS, SECTORS, BENCH, RET, _FIT) + " SELECT symbol, bench, n, round(c / (sqrt(v) * sqrt(u)), 6) + 0.0 AS corr FROM fit WHERE n > 100")
def static_correlations(spark, sf_dir):
    b = ft.returns(bars(spark, sf_dir))
    return shown(pn.correlations(b, pn.benchmarks(b, sectors(spark, sf_dir))), ["symbol", "bench", "n"], ["corr"], 6)


def breadth_sql(before: str, a: int, b: int, spans: tuple[int, int]) -> str:
    """Common table expressions that end in bs: breadth of the bars in before, with the oscillator."""
    marked = stage("bm", before, {"up": f"sign(close - {lagged('close')})", "m_a": mean("close", a, a // 2), "m_b": mean("close", b, b // 2)})
    day = f"bd AS (SELECT date, CAST(coalesce(sum(CASE WHEN up > 0 THEN 1 ELSE 0 END) FILTER (WHERE up IS NOT NULL), 0) AS BIGINT) AS advancers, CAST(coalesce(sum(CASE WHEN up < 0 THEN 1 ELSE 0 END) FILTER (WHERE up IS NOT NULL), 0) AS BIGINT) AS decliners, avg(CASE WHEN m_a IS NULL THEN NULL WHEN close > m_a THEN 1.0 ELSE 0.0 END) AS above_ma{a}, avg(CASE WHEN m_b IS NULL THEN NULL WHEN close > m_b THEN 1.0 ELSE 0.0 END) AS above_ma{b} FROM bm GROUP BY 1)"
    fold = lambda span: f"list_reduce(list(CAST(net AS DOUBLE)) OVER w, lambda p, q: p + {2 / (span + 1)} * (q - p))"
    line = f"bo AS (SELECT *, CAST(sum(net) OVER w AS BIGINT) AS ad_line, {fold(spans[0])} - {fold(spans[1])} AS mcclellan_osc FROM (SELECT *, advancers - decliners AS net FROM bd) WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"
    return ", ".join((marked, day, line, "bs AS (SELECT *, sum(mcclellan_osc) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mcclellan_sum FROM bo)"))


@query(chain(BARS, breadth_sql("bars", 50, 200, (19, 39))) + f" SELECT date, advancers, decliners, net, ad_line, {out(['above_ma50', 'above_ma200', 'mcclellan_osc', 'mcclellan_sum'], 4)} FROM bs")
def breadth(spark, sf_dir):
    return shown(pn.breadth(bars(spark, sf_dir)), ["date", "advancers", "decliners", "net", "ad_line"], ["above_ma50", "above_ma200", "mcclellan_osc", "mcclellan_sum"], 4)


# cross-sections

CAL = "cal AS (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM bars))"


def calendar_sum(name: str, before: str, w: int, least: int) -> str:
    return f"{name} AS (SELECT r.*, CASE WHEN k >= {w} AND count(ret) OVER f >= {least} THEN sum(ret) OVER f END AS mom FROM {before} r JOIN cal USING (date) WINDOW f AS (PARTITION BY symbol ORDER BY k RANGE BETWEEN {w - 1} PRECEDING AND CURRENT ROW))"


_MOM = [BARS, SECTORS, RET, CAL, calendar_sum("mm", "rets", 20, 6), "js AS (SELECT mm.*, sector FROM mm LEFT JOIN sectors USING (symbol))", "ns AS (SELECT *, CASE WHEN sector IS NOT NULL AND count(mom) OVER (PARTITION BY date, sector) >= 2 THEN mom - quantile_cont(mom, 0.5) OVER (PARTITION BY date, sector) END AS mom_neutral FROM js)", "zs AS (SELECT *, CASE WHEN stddev_pop(mom) OVER (PARTITION BY date) > 1e-10 THEN (mom - quantile_cont(mom, 0.5) OVER (PARTITION BY date)) / stddev_pop(mom) OVER (PARTITION BY date) END AS mom_z, CASE WHEN stddev_pop(mom_neutral) OVER (PARTITION BY date) > 1e-10 THEN (mom_neutral - quantile_cont(mom_neutral, 0.5) OVER (PARTITION BY date)) / stddev_pop(mom_neutral) OVER (PARTITION BY date) END AS mom_neutral_z FROM ns)"]


@query(chain(*_MOM) + f" SELECT symbol, date, {out(['mom', 'mom_z', 'mom_neutral_z'])} FROM zs")
def neutral_momentum(spark, sf_dir):
    return shown(pn.neutral_momentum(ft.returns(bars(spark, sf_dir)), sectors(spark, sf_dir), 20), ["symbol", "date"], ["mom", "mom_z", "mom_neutral_z"])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = pn.neutral_momentum(ft.returns(bars(spark, sf_dir)), sectors(spark, sf_dir), 20)
    t = t.withColumn("score", F.round("mom_neutral_z", 5) + 0.0)
    return pn.top_of_date(t, "score", 10).select("date", "symbol", "sector", F.col("rank").cast("long").alias("rank"), "score")


@query(chain(*_MOM) + ", sc AS (SELECT date, symbol, sector, round(mom_neutral_z, 5) + 0.0 AS score FROM zs WHERE mom_neutral_z IS NOT NULL) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS BIGINT) AS rank FROM sc) WHERE rank <= 10")
def momentum_top10(spark, sf_dir):
    return flagship(spark, sf_dir)


@query(chain(BARS, SECTORS, "js AS (SELECT b.*, sector FROM bars b LEFT JOIN sectors USING (symbol))", "p AS (SELECT *, CASE WHEN count(volume) OVER (PARTITION BY date) >= 2 THEN (row_number() OVER (PARTITION BY date ORDER BY volume NULLS LAST, symbol) - 1) / (count(volume) OVER (PARTITION BY date) - 1) * 100 END AS pct, CASE WHEN count(volume) OVER (PARTITION BY date, sector) >= 2 THEN (row_number() OVER (PARTITION BY date, sector ORDER BY volume NULLS LAST, symbol) - 1) / (count(volume) OVER (PARTITION BY date, sector) - 1) * 100 END AS ps FROM js)") + " SELECT symbol, date, round(pct, 5) + 0.0 AS pct, round(coalesce(ps, pct), 5) + 0.0 AS pct_sector FROM p")
def cross_percentiles(spark, sf_dir):
    return shown(pn.cross_percentiles(bars(spark, sf_dir), "volume", sectors(spark, sf_dir)), ["symbol", "date"], ["pct", "pct_sector"])


@query(chain(BARS) + " SELECT symbol, date, round((rank() OVER (PARTITION BY date ORDER BY volume) + (count(*) OVER (PARTITION BY date, volume) - 1) / 2) / count(*) OVER (PARTITION BY date), 6) + 0.0 AS volume_rank FROM bars")
def date_rank(spark, sf_dir):
    return shown(pn.date_rank(bars(spark, sf_dir), "volume"), ["symbol", "date"], ["volume_rank"], 6)


@query(chain(BARS) + f", w AS (SELECT symbol, CAST({FRIDAY} AS DATE) AS wk, arg_max(close, date) AS v FROM bars GROUP BY 1, 2), m AS (SELECT symbol, wk, lag(v, 1) OVER (PARTITION BY symbol ORDER BY wk) AS a, lag(v, 4) OVER (PARTITION BY symbol ORDER BY wk) AS b FROM w) SELECT symbol, date, round(a, 7) + 0.0 AS close_lag1w, round(b, 7) + 0.0 AS close_lag4w FROM (SELECT *, CAST({FRIDAY} AS DATE) AS wk FROM bars) LEFT JOIN m USING (symbol, wk)")
def weekly_lags(spark, sf_dir):
    return shown(pn.weekly_lags(bars(spark, sf_dir), "close", [1, 4]), ["symbol", "date"], ["close_lag1w", "close_lag4w"], 7)


# labels

_H = 20
_NEXT = f"nx AS (SELECT *, list({{'h': high, 'l': low, 'c': close, 'd': date}}) OVER ({S} ROWS BETWEEN 1 FOLLOWING AND {_H} FOLLOWING) AS nx, close + 3.0 * atr AS top, close - 3.0 * atr AS bot FROM entries)"
_TOUCH = [BARS, ATR, _NEXT, f"ps AS (SELECT *, coalesce(nullif(coalesce(list_position(list_transform(nx, lambda b: b.h >= top), true), 0), 0), {_H + 1}) AS u, coalesce(nullif(coalesce(list_position(list_transform(nx, lambda b: b.l <= bot), true), 0), 0), {_H + 1}) AS d FROM nx WHERE close > 0 AND atr > 0 AND len(nx) > 0)", f"ht AS (SELECT *, CASE WHEN u > {_H} AND d > {_H} THEN 0 WHEN u <= d THEN 1 ELSE -1 END AS hit, CAST(CASE WHEN u > {_H} AND d > {_H} THEN len(nx) ELSE least(u, d) END AS BIGINT) AS h_used FROM ps)", "pr AS (SELECT *, CASE hit WHEN 1 THEN top WHEN -1 THEN bot ELSE nx[h_used].c END AS price_hit, nx[h_used].d AS t_hit FROM ht)"]


def _labels(spark, sf_dir):
    return lb.first_touch(lb.with_atr(bars(spark, sf_dir)), 3.0, 3.0, _H)


@query(chain(*_TOUCH) + " SELECT symbol, date, CAST(hit AS INTEGER) AS hit, h_used, t_hit, round(price_hit, 7) + 0.0 AS price_hit, round(CASE WHEN price_hit > 0 THEN ln(price_hit / close) END, 5) + 0.0 AS ret_from_entry FROM pr")
def triple_barrier(spark, sf_dir):
    t = _labels(spark, sf_dir).withColumn("price_hit", F.round("price_hit", 7) + 0.0)
    return shown(t, ["symbol", "date", "hit", F.col("h_used").cast("long").alias("h_used"), "t_hit", "price_hit"], ["ret_from_entry"])


@query(chain(*_TOUCH) + " SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE hit = 1) AS BIGINT) AS n_up, CAST(count(*) FILTER (WHERE hit = -1) AS BIGINT) AS n_down, CAST(count(DISTINCT symbol) AS BIGINT) AS n_symbols, round(avg(h_used), 5) + 0.0 AS mean_h FROM pr")
def label_summary(spark, sf_dir):
    s = _labels(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.col("hit") == 1).alias("n_up"), F.count_if(F.col("hit") == -1).alias("n_down"), F.countDistinct("symbol").alias("n_symbols"), F.avg("h_used").alias("mean_h"))
    return shown(s, ["n", "n_up", "n_down", "n_symbols"], ["mean_h"])


@query(chain(BARS, ATR, _NEXT) + f", v AS (SELECT * FROM nx WHERE close > 0 AND atr > 0 AND len(nx) > 0), m AS (SELECT symbol, date, {', '.join(f'coalesce(nullif(coalesce(list_position(list_transform(nx, lambda b: b.h >= close + {u} * atr), true), 0), 0), 21) AS u{k}, coalesce(nullif(coalesce(list_position(list_transform(nx, lambda b: b.l <= close - {d} * atr), true), 0), 0), 21) AS d{k}' for k, (u, d) in enumerate(((1.5, 1.5), (3.0, 1.5))))} FROM v) SELECT symbol, date, {', '.join(f'CAST(CASE WHEN u{k} > 20 AND d{k} > 20 THEN 0 WHEN u{k} <= d{k} THEN 1 ELSE -1 END AS INTEGER) AS hit_{n}' for k, n in enumerate(('even', 'long')))} FROM m")
def multi_barrier(spark, sf_dir):
    return lb.multi_touch(lb.with_atr(bars(spark, sf_dir)), {"even": (1.5, 1.5), "long": (3.0, 1.5)}, _H).select("symbol", "date", "hit_even", "hit_long")


def _spans(spark, sf_dir):
    return _labels(spark, sf_dir).select(F.concat_ws("|", "symbol", "date").alias("id"), "symbol", F.col("date").alias("t0"), F.col("t_hit").alias("t1"), "hit")


_SPANS = [*_TOUCH, "sp AS (SELECT symbol, date AS t0, t_hit AS t1, hit FROM pr)"]
_OVER = "ov AS (SELECT a.symbol, a.t0, a.hit, CAST(count(*) - 1 AS BIGINT) AS n_overlapping FROM sp a JOIN sp b ON a.symbol = b.symbol AND b.t0 <= a.t1 AND b.t1 >= a.t0 GROUP BY ALL)"


@query(chain(*_SPANS) + " SELECT symbol, CAST(t0 AS DATE) AS entry_date, CAST(t1 AS DATE) AS exit_date, CAST(hit AS INTEGER) AS hit, CAST(hit = 1 AS INTEGER) AS target FROM sp WHERE hit <> 0")
def training_targets(spark, sf_dir):
    return src.targets(_spans(spark, sf_dir).withColumnRenamed("t1", "t_hit")).select("symbol", "entry_date", "exit_date", F.col("hit").cast("int").alias("hit"), "target")


@query(chain(*_SPANS, _OVER) + " SELECT symbol, t0, n_overlapping FROM ov")
def overlap_counts(spark, sf_dir):
    return lb.overlaps(_spans(spark, sf_dir)).select("symbol", "t0", "n_overlapping")


@query(chain(*_SPANS, _OVER) + ", w AS (SELECT *, least(greatest(1 / (n_overlapping + 0.5) * (count(*) OVER ()) / ((SELECT count(DISTINCT hit) FROM ov) * count(*) OVER (PARTITION BY hit)), 0.01), 10) AS w FROM ov) SELECT symbol, t0, round(least(greatest(w / avg(w) OVER (), 0.01), 10), 6) + 0.0 AS weight_final FROM w")
def label_weights(spark, sf_dir):
    return shown(lb.weights(lb.overlaps(_spans(spark, sf_dir))), ["symbol", "t0"], ["weight_final"], 6)


@query(chain(*_SPANS) + ", e AS (SELECT t0 AS date, 1 AS d FROM sp UNION ALL SELECT t1 + 1, -1 FROM sp), g AS (SELECT CAST(date AS DATE) AS date, sum(d) AS d FROM e GROUP BY 1) SELECT date, CAST(sum(d) OVER (ORDER BY date) AS BIGINT) AS active FROM g")
def active_density(spark, sf_dir):
    return lb.active_density(_spans(spark, sf_dir))


@query(chain(*_SPANS) + ", c AS (SELECT symbol, count(*) AS k FROM sp WHERE hit = 1 GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY k DESC, symbol) AS dn, row_number() OVER (ORDER BY k, symbol) AS up FROM c) SELECT round(sum(CASE WHEN dn <= 10 THEN k ELSE 0 END) / sum(k), 6) + 0.0 AS top_share, round(2 * sum(up * k) / (count(*) * sum(k)) - (count(*) + 1) / count(*), 6) + 0.0 AS gini, CAST(count(*) AS BIGINT) AS n_symbols FROM r")
def label_concentration(spark, sf_dir):
    return shown(lb.concentration(_spans(spark, sf_dir)), ["n_symbols"], ["top_share", "gini"], 6)


@query(chain(BARS, ATR) + f", x AS (SELECT *, max(high) OVER a AS hh, min(low) OVER a AS ll FROM entries WINDOW a AS ({S} ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)), y AS (SELECT symbol, date, (hh - close) / atr AS mfe, (close - ll) / atr AS mae FROM x WHERE close > 0 AND atr > 0 AND hh IS NOT NULL) SELECT symbol, date, round(mfe, 5) + 0.0 AS mfe, round(mae, 5) + 0.0 AS mae FROM y WHERE abs(mfe) <= 50 AND abs(mae) <= 50")
def excursions(spark, sf_dir):
    return shown(lb.excursions(lb.with_atr(bars(spark, sf_dir)), 20), ["symbol", "date"], ["mfe", "mae"])


_CRIT = f"cr AS (SELECT *, coalesce((list_max(list_transform(CASE WHEN sd > 0 THEN nx[1:sd - 1] ELSE nx END, lambda b: b.h)) - close) / atr, 0.0) AS critical FROM (SELECT *, coalesce(list_position(list_transform(nx, lambda b: b.l <= close - 1.5 * atr), true), 0) AS sd FROM nx WHERE close > 0 AND atr > 0 AND len(nx) > 0))"


@query(chain(BARS, ATR, _NEXT, _CRIT) + " SELECT round(quantile_cont(critical, 0.75), 6) + 0.0 AS multiple, CAST(count(*) AS BIGINT) AS n FROM cr")
def calibrated_multiple(spark, sf_dir):
    return shown(lb.calibrated_multiple(lb.before_stop(lb.with_atr(bars(spark, sf_dir)), 1.5, 20), 0.25), ["n"], ["multiple"], 6)


@query(
    chain(*_TOUCH).replace("WITH ", "WITH RECURSIVE ", 1)
    + ", ps2 AS (SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) AS pos FROM bars), lb AS (SELECT pr.symbol, pr.date, pos, hit, h_used, pos + CASE WHEN hit <> 0 AND h_used < 5 THEN h_used ELSE 5 END AS due FROM pr JOIN ps2 USING (symbol, date)), nt AS (SELECT l.*, n.pos AS nxt FROM lb l ASOF LEFT JOIN lb n ON l.symbol = n.symbol AND l.due <= n.pos), w AS (SELECT symbol, pos, nxt FROM nt WHERE pos = (SELECT min(pos) FROM lb m WHERE m.symbol = nt.symbol) UNION ALL SELECT n.symbol, n.pos, n.nxt FROM w JOIN nt n ON n.symbol = w.symbol AND n.pos = w.nxt) SELECT lb.symbol, lb.date, CAST(lb.pos AS INTEGER) AS pos, CAST(hit AS INTEGER) AS hit, CAST(h_used AS INTEGER) AS h_used FROM lb JOIN w USING (symbol, pos)"
)
def sampled_entries(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("symbol").orderBy("date"))
    b = lb.with_atr(bars(spark, sf_dir)).withColumn("pos", n)
    return lb.sample_entries(lb.first_touch(b, 3.0, 3.0, _H), 5).select("symbol", "date", "pos", "hit", "h_used")


def ridge_sql(y: str, xs: list[str], w: int, alpha: float = 0.01) -> list[str]:
    """Stages r1 to r3 over j: ridge of y on two or three xs over whole windows, by determinants."""
    least, v = min(w, max(20, int(w * 0.33))), [*xs, y]
    ok = " AND ".join(f"{c} IS NOT NULL" for c in v)
    r1 = stage("r1", "j", {f"v{i}": f"CASE WHEN {ok} THEN {c} END" for i, c in enumerate(v)} | {"rn": f"row_number() OVER ({S})"})
    k = len(xs)
    cells = {f"c{i}{j}": f"covar_pop(v{i}, v{j}) OVER {rw(w)} * count(v0) OVER {rw(w)}" + (f" + {alpha}" if i == j else "") for i in range(k) for j in range(i, k + 1)}
    r2 = stage("r2", "r1", cells | {f"m{i}": f"avg(v{i}) OVER {rw(w)}" for i in range(k + 1)} | {"ok": f"rn >= {w} AND count(v0) OVER {rw(w)} >= {least}"})
    g = lambda i, j: f"c{min(i, j)}{max(i, j)}"

    def det(columns: list[list[str]]) -> str:
        if len(columns) == 2:
            (a, c), (b, d) = columns
            return f"({a} * {d} - {b} * {c})"
        (a, d, q), (b, e, h), (c, f, i) = columns
        return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {q}) + {c} * ({d} * {h} - {e} * {q}))"

    whole = [[g(i, j) for i in range(k)] for j in range(k)]
    right = [g(i, k) for i in range(k)]
    r3 = stage("r3", "r2", {f"b{j}": f"CASE WHEN ok THEN {det([right if q == j else whole[q] for q in range(k)])} / {det(whole)} END" for j in range(k)})
    r4 = stage("r4", "r3", {"alpha": f"m{k} - " + " - ".join(f"b{i} * m{i}" for i in range(k)), "resid": f"v{k} - (m{k} - " + " - ".join(f"b{i} * m{i}" for i in range(k)) + ") - " + " - ".join(f"b{i} * v{i}" for i in range(k))})
    return [r1, r2, r3, r4]


def _ridge(t, xs, w):
    t = fc.rolling_ridge(t.select("symbol", "date", "ret", *xs), "ret", xs, w)
    return shown(t, ["symbol", "date"], [*(f"beta_{x}" for x in xs), "ridge_resid"], 4)


@query(chain(BARS, SECTORS, BENCH, RET, _J, *ridge_sql("ret", ["bench_ret", "volume"], 60)) + " SELECT symbol, date, round(b0, 4) + 0.0 AS beta_bench_ret, round(b1, 4) + 0.0 AS beta_volume, round(resid, 4) + 0.0 AS ridge_resid FROM r4")
def rolling_ridge(spark, sf_dir):
    return _ridge(_with_market(spark, sf_dir), ["bench_ret", "volume"], 60)


@query(chain(BARS, SECTORS, BENCH, RET, _J.replace("j AS", "j0 AS", 1), stage("j", "j0", {"gap": f"ln(open) - ln({lagged('close')})"}), *ridge_sql("ret", ["bench_ret", "volume", "gap"], 12)) + " SELECT symbol, date, round(b0, 4) + 0.0 AS beta_bench_ret, round(b1, 4) + 0.0 AS beta_volume, round(b2, 4) + 0.0 AS beta_gap, round(resid, 4) + 0.0 AS ridge_resid FROM r4")
def short_ridge(spark, sf_dir):
    t = _with_market(spark, sf_dir)
    return _ridge(t.withColumn("gap", F.log("open") - F.log(F.lag("close").over(Window.partitionBy("symbol").orderBy("date")))), ["bench_ret", "volume", "gap"], 12)


# metrics, folds, transforms


@query(chain(SCORED) + ", r AS (SELECT lang, y, rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2 AS k FROM scored), s AS (SELECT lang, sum(CASE WHEN y = 1 THEN k ELSE 0 END) AS r, sum(y) AS pos, count(*) - sum(y) AS neg FROM r GROUP BY 1) SELECT lang, round(CASE WHEN pos * neg > 0 THEN (r - pos * (pos + 1) / 2) / (pos * neg) ELSE 0.5 END, 6) + 0.0 AS auc FROM s")
def auc_by_language(spark, sf_dir):
    return shown(ev.auc(scored(spark, sf_dir), ["lang"]), ["lang"], ["auc"], 6)


@query(chain(SCORED) + ", g AS (SELECT lang, p, count(*) AS n, sum(y) AS t FROM scored GROUP BY 1, 2), c AS (SELECT *, sum(t) OVER w AS tp, sum(n) OVER w AS seen FROM g WINDOW w AS (PARTITION BY lang ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT lang, round(sum(t * tp / seen) / sum(t), 6) + 0.0 AS average_precision FROM c GROUP BY 1")
def average_precision(spark, sf_dir):
    return shown(ev.average_precision(scored(spark, sf_dir), ["lang"]), ["lang"], ["average_precision"], 6)


@query(chain(SCORED) + " SELECT lang, round(avg(-(y * ln(greatest(least(p, 1 - 1e-15), 1e-15)) + (1 - y) * ln(1 - greatest(least(p, 1 - 1e-15), 1e-15)))), 5) + 0.0 AS log_loss, round(avg((p - y) * (p - y)), 6) + 0.0 AS brier, round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS hit_rate FROM scored GROUP BY 1")
def losses(spark, sf_dir):
    x = ev.losses(scored(spark, sf_dir), ["lang"]).withColumn("log_loss", F.round("log_loss", 5) + 0.0)
    return shown(x, ["lang", "log_loss"], ["brier", "hit_rate"], 6)


@query(chain(SCORED) + ", r AS (SELECT *, greatest(1, floor(count(*) OVER (PARTITION BY lang) * 0.1)) AS k, row_number() OVER (PARTITION BY lang ORDER BY p DESC, doc_id) AS u, row_number() OVER (PARTITION BY lang ORDER BY p, doc_id) AS d FROM scored), a AS (SELECT lang, avg(y) FILTER (WHERE u <= k) AS top, avg(y) FILTER (WHERE d <= k) AS bottom FROM r GROUP BY 1) SELECT lang, round(top, 6) + 0.0 AS top, round(bottom, 6) + 0.0 AS bottom, round(top - bottom, 6) + 0.0 AS spread FROM a")
def tail_precision(spark, sf_dir):
    return shown(ev.tail_precision(scored(spark, sf_dir), ["lang"], "doc_id"), ["lang"], ["top", "bottom", "spread"], 6)


@query(chain(SCORED) + ", b AS (SELECT lang, least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM scored GROUP BY 1, 2) SELECT lang, round(sum(abs(mp - my) * n) / sum(n), 6) + 0.0 AS ece, round(max(abs(mp - my)), 6) + 0.0 AS mce FROM b GROUP BY 1")
def calibration_error(spark, sf_dir):
    return shown(ev.calibration_error(scored(spark, sf_dir), ["lang"]), ["lang"], ["ece", "mce"], 6)


@query(chain(SCORED) + " SELECT lang, CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n, round(avg(p), 6) + 0.0 AS mean_p, round(avg(y), 6) + 0.0 AS mean_y FROM scored GROUP BY 1, 2")
def reliability_curve(spark, sf_dir):
    return shown(ev.reliability(scored(spark, sf_dir), ["lang"]), ["lang", "bin", "n"], ["mean_p", "mean_y"], 6)


@query(chain(SCORED) + ", r AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2 AS a, rank() OVER (PARTITION BY lang ORDER BY y) + (count(*) OVER (PARTITION BY lang, y) - 1) / 2 AS b FROM scored) SELECT lang, round(corr(a, b), 6) + 0.0 AS ic FROM r GROUP BY 1")
def information_coefficient(spark, sf_dir):
    return shown(ev.rank_correlation(scored(spark, sf_dir), ["lang"], "p", "y"), ["lang"], ["ic"], 6)


def _entries(spark, sf_dir):
    return _spans(spark, sf_dir).select("symbol", F.col("t0").alias("entry"), F.col("t1").alias("exit"), "hit")


_WF = [*_SPANS, "tg AS (SELECT *, CAST(date_trunc('week', t0) AS DATE) AS week FROM sp)", "wk AS (SELECT week, row_number() OVER (ORDER BY week) - 1 AS w FROM (SELECT DISTINCT week FROM tg))", "fd AS (SELECT CAST((w - 52) / 13 AS INTEGER) AS fold, w AS fst, week AS starts FROM wk WHERE w >= 52 AND (w - 52) % 13 = 0)", "mt AS (SELECT tg.*, w, fold, fst, starts FROM tg JOIN wk USING (week), fd)", "wf AS (SELECT fold, 'test' AS role, t0, t1 FROM mt WHERE w >= fst AND w < fst + 13 UNION ALL SELECT fold, 'train', t0, t1 FROM mt WHERE w < fst AND t1 < starts)"]


@query(chain(*_WF) + " SELECT fold, role, CAST(count(*) AS BIGINT) AS n, min(t0) AS first_entry, max(t0) AS last_entry, max(t1) AS last_exit FROM wf GROUP BY 1, 2")
def walk_forward_folds(spark, sf_dir):
    return ev.fold_summary(ev.walk_forward(_entries(spark, sf_dir), 52, 13))


@query(chain(*_WF) + ", q AS (SELECT fold, max(t1) FILTER (WHERE role = 'train') AS train_exit, min(t0) FILTER (WHERE role = 'test') AS test_entry FROM wf GROUP BY 1) SELECT *, coalesce(train_exit >= test_entry, false) AS leak FROM q")
def fold_leaks(spark, sf_dir):
    return ev.leaks(ev.walk_forward(_entries(spark, sf_dir), 52, 13))


@query(chain(*_SPANS) + ", n AS (SELECT *, row_number() OVER (ORDER BY t0, symbol) - 1 AS i, (SELECT count(*) FROM sp) AS c FROM sp), f AS (SELECT *, least(floor(i * 5 / c), 4) AS f FROM n), s AS (SELECT f AS fold, min(t0) AS lo, max(t1) AS hi, max(i) AS lst FROM f GROUP BY 1), r AS (SELECT CAST(fold AS INTEGER) AS fold, CASE WHEN f = fold THEN 'test' WHEN t1 < lo OR (t0 > hi AND i > lst + floor(c * 0.01)) THEN 'train' END AS role, t0, t1 FROM f, s) SELECT fold, role, CAST(count(*) AS BIGINT) AS n, min(t0) AS first_entry, max(t0) AS last_entry, max(t1) AS last_exit FROM r WHERE role IS NOT NULL GROUP BY 1, 2")
def purged_kfold(spark, sf_dir):
    return ev.fold_summary(ev.purged_kfold(_entries(spark, sf_dir), 5))


@query("SELECT o_orderkey, round(least(greatest((o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER (), -1.5), 1.5), 6) + 0.0 AS o_totalprice_z FROM orders")
def standardised(spark, sf_dir):
    return shown(ev.standardise(table(spark, sf_dir, "orders"), ["o_totalprice"], 1.5), ["o_orderkey"], ["o_totalprice_z"], 6)


@query("SELECT o_orderkey, round(least(greatest(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.01) FROM orders)), (SELECT quantile_cont(o_totalprice, 0.99) FROM orders)), 4) + 0.0 AS o_totalprice_w FROM orders")
def winsorised(spark, sf_dir):
    return shown(ev.winsorise(table(spark, sf_dir, "orders"), ["o_totalprice"]), ["o_orderkey"], ["o_totalprice_w"], 4)


@query("SELECT 'l_quantity' AS a, 'l_discount' AS b, round(corr(l_quantity, l_discount), 6) + 0.0 AS corr FROM lineitem UNION ALL SELECT 'l_quantity', 'l_extendedprice', round(corr(l_quantity, l_extendedprice), 6) + 0.0 FROM lineitem UNION ALL SELECT 'l_discount', 'l_extendedprice', round(corr(l_discount, l_extendedprice), 6) + 0.0 FROM lineitem")
def correlation_pairs(spark, sf_dir):
    return shown(ev.correlation_pairs(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_extendedprice"]), ["a", "b"], ["corr"], 6)


def _mi(c: str) -> str:
    return f"SELECT '{c}' AS feature, least(floor(({c} - (SELECT min({c}) FROM lineitem)) / ((SELECT max({c}) FROM lineitem) - (SELECT min({c}) FROM lineitem)) * 10), 9) AS bin, l_returnflag AS y FROM lineitem"


@query(f"WITH l AS ({_mi('l_extendedprice')} UNION ALL {_mi('l_tax')}), c AS (SELECT feature, bin, y, count(*) AS n FROM l GROUP BY ALL), p AS (SELECT *, sum(n) OVER (PARTITION BY feature, bin) AS nx, sum(n) OVER (PARTITION BY feature, y) AS ny, sum(n) OVER (PARTITION BY feature) AS nn FROM c) SELECT feature, round(sum(n / nn * ln(n * nn / (nx * ny))), 6) + 0.0 AS mi FROM p GROUP BY 1")
def mutual_information(spark, sf_dir):
    return shown(ev.mutual_information(table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_tax"], "l_returnflag"), ["feature"], ["mi"], 6)


# portfolios

_P = [BARS, SECTORS, SIGNALS]


@query(chain(*_P) + ", t AS (SELECT *, row_number() OVER (PARTITION BY week ORDER BY probability DESC, symbol) AS k FROM signals) SELECT symbol, week, round(least(1 / count(*) OVER (PARTITION BY week), 0.2), 6) + 0.0 AS weight FROM t WHERE k <= 10")
def equal_top(spark, sf_dir):
    return shown(pf.equal_top(signals(spark, sf_dir)), ["symbol", "week"], ["weight"], 6)


@query(chain(*_P) + ", t AS (SELECT *, row_number() OVER (PARTITION BY week ORDER BY probability DESC, symbol) AS k FROM signals), s AS (SELECT *, least(coalesce(probability / nullif(sum(probability) OVER (PARTITION BY week), 0), 0), 0.2) AS w FROM t WHERE k <= 10) SELECT symbol, week, round(coalesce(w / nullif(sum(w) OVER (PARTITION BY week), 0), 0), 6) + 0.0 AS weight FROM s")
def proportional_top(spark, sf_dir):
    return shown(pf.proportional_top(signals(spark, sf_dir)), ["symbol", "week"], ["weight"], 6)


@query(chain(*_P) + ", s AS (SELECT *, least(greatest(0.5 * (probability - 0.5), 0.0), 0.1) AS r FROM signals) SELECT symbol, week, round(CASE WHEN r >= 0.01 THEN r ELSE 0.0 END, 6) + 0.0 AS weight FROM s")
def monotone_weights(spark, sf_dir):
    return shown(pf.monotone(signals(spark, sf_dir)), ["symbol", "week"], ["weight"], 6)


@query(chain(*_P) + ", s AS (SELECT *, CAST(least(floor((row_number() OVER (PARTITION BY week ORDER BY probability DESC, symbol) - 1) * 3 / count(*) OVER (PARTITION BY week)), 2) AS INTEGER) AS bucket FROM signals) SELECT symbol, week, bucket, round([0.6, 0.3, 0.1][bucket + 1] / count(*) OVER (PARTITION BY week, bucket), 6) + 0.0 AS weight FROM s")
def rank_buckets(spark, sf_dir):
    return shown(pf.rank_buckets(signals(spark, sf_dir), [0.6, 0.3, 0.1]), ["symbol", "week", "bucket"], ["weight"], 6)


_EQ = "eq AS (SELECT *, least(1 / count(*) OVER (PARTITION BY week), 0.2) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY week ORDER BY probability DESC, symbol) AS k FROM signals) WHERE k <= 10)"
_TURN = "nw AS (SELECT week, row_number() OVER (ORDER BY week) AS n FROM (SELECT DISTINCT week FROM eq)), a AS (SELECT n, symbol, weight FROM eq JOIN nw USING (week)), tu AS (SELECT week, turnover FROM (SELECT coalesce(a.n, b.n + 1) AS n, sum(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0))) / 2 AS turnover FROM a FULL JOIN a b ON a.n = b.n + 1 AND a.symbol = b.symbol GROUP BY 1) JOIN nw USING (n))"


@query(chain(*_P, _EQ, _TURN) + " SELECT week, round(turnover, 6) + 0.0 AS turnover FROM tu")
def turnover(spark, sf_dir):
    return shown(pf.turnover(pf.equal_top(signals(spark, sf_dir))), ["week"], ["turnover"], 6)


@query(chain(*_P, _EQ) + ", r AS (SELECT *, row_number() OVER (PARTITION BY week ORDER BY weight DESC, symbol) AS q FROM eq) SELECT week, round(sum(weight * weight), 6) + 0.0 AS hhi, round(1 / sum(weight * weight), 6) + 0.0 AS effective_n, round(max(weight), 6) + 0.0 AS top1, round(sum(weight) FILTER (WHERE q <= 5), 6) + 0.0 AS top5, round(sum(abs(weight)), 6) + 0.0 AS gross, round(sum(weight), 6) + 0.0 AS net FROM r GROUP BY 1")
def weight_concentration(spark, sf_dir):
    return shown(pf.concentration(pf.equal_top(signals(spark, sf_dir))), ["week"], ["hhi", "effective_n", "top1", "top5", "gross", "net"], 6)


_WR = "wr AS (SELECT week, sum(weight * actual_return) AS ret, avg(CASE WHEN actual_return > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, sum(abs(weight)) AS exposure FROM eq GROUP BY 1)"


@query(chain(*_P, _EQ, _TURN, _WR) + " SELECT week, round(ret, 9) + 0.0 AS ret, round(hit_rate, 9) + 0.0 AS hit_rate, round(exposure, 9) + 0.0 AS exposure, round(turnover, 9) + 0.0 AS turnover, round(ret - 0.001 * turnover, 9) + 0.0 AS net_ret FROM wr JOIN tu USING (week)")
def weekly_returns(spark, sf_dir):
    return shown(pf.weekly_returns(pf.equal_top(signals(spark, sf_dir)), cost=0.001), ["week"], ["ret", "hit_rate", "exposure", "turnover", "net_ret"], 9)


_NAV = "nv AS (SELECT *, exp(sum(ln(1 + ret)) OVER (ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS nav FROM wr), dd AS (SELECT *, nav / greatest(max(nav) OVER (ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0) - 1 AS drawdown FROM nv)"


@query(chain(*_P, _EQ, _WR, _NAV) + ", p AS (SELECT CAST(count(*) AS BIGINT) AS n, exp(sum(ln(1 + ret))) - 1 AS total_return, avg(ret) AS m, stddev_samp(ret) * sqrt(52) AS volatility, sqrt(avg(power(least(ret, 0), 2)) * 52) AS downside, min(drawdown) AS max_drawdown, quantile_cont(ret, 0.05) AS var_95, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, sum(greatest(ret, 0)) AS won, sum(-least(ret, 0)) AS lost, max(ret) AS best, min(ret) AS worst FROM dd) SELECT n, round(volatility, 4) + 0.0 AS volatility, round(max_drawdown, 4) + 0.0 AS max_drawdown, round(var_95, 4) + 0.0 AS var_95, round(hit_rate, 4) + 0.0 AS hit_rate, round(m * 52 / volatility, 4) + 0.0 AS sharpe, round(m * 52 / downside, 4) + 0.0 AS sortino, round(won / lost, 4) + 0.0 AS profit_factor, round(best, 4) + 0.0 AS best, round(worst, 4) + 0.0 AS worst, round((SELECT avg(ret) FROM dd WHERE ret <= var_95), 4) + 0.0 AS cvar_95, round((SELECT avg(ret) FILTER (WHERE ret > 0) / abs(avg(ret) FILTER (WHERE ret < 0)) FROM dd), 4) + 0.0 AS win_loss FROM p")
def performance(spark, sf_dir):
    w = pf.weekly_returns(pf.equal_top(signals(spark, sf_dir)))
    return shown(pf.performance(w), ["n"], ["volatility", "max_drawdown", "var_95", "hit_rate", "sharpe", "sortino", "profit_factor", "best", "worst", "cvar_95", "win_loss"], 4)


@query(chain(*_P, _EQ, _WR, _NAV) + ", u AS (SELECT *, drawdown < -1e-12 AS under FROM dd), e AS (SELECT *, sum(CASE WHEN under THEN 0 ELSE 1 END) OVER (ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ep FROM u) SELECT min(week) AS first, max(week) AS last, round(min(drawdown), 5) + 0.0 AS depth, CAST(count(*) AS BIGINT) AS weeks FROM e WHERE under GROUP BY ep")
def drawdown_episodes(spark, sf_dir):
    w = pf.weekly_returns(pf.equal_top(signals(spark, sf_dir)))
    return shown(pf.drawdown_episodes(w), ["first", "last", "weeks"], ["depth"])


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * 5.0 / 1e4, 8) + 0.0 AS linear_cost, round(l_extendedprice * CASE WHEN l_quantity > 0 THEN least(0.1 * sqrt(l_extendedprice / l_quantity) * 1e4, 100.0) ELSE 50.0 END / 1e4, 8) + 0.0 AS impact_cost FROM lineitem")
def trade_costs(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("value"), F.col("l_quantity").alias("volume"))
    return shown(pf.costs(t), ["l_orderkey", "l_linenumber", "l_partkey"], ["linear_cost", "impact_cost"], 8)


# shared series, mapping, selection, plans, streams

_ONE = "flow1 AS (SELECT 'F' AS symbol, date, flow / 1e6 AS v FROM macro)"


def _flow(spark, sf_dir):
    return macro(spark, sf_dir).select(F.lit("F").alias("symbol"), "date", (F.col("flow") / 1e6).alias("v"))


@query(chain(MACRO, _ONE, stage("a", "flow1", {"v_z": sample_z("v", 60, 20), "v_ma20_ratio": over("v", f"({mean('v', 20, 10)})"), "v_chg5": over("v", lagged("v", 5)) + " - 1", "v_regime": "CASE WHEN v < 0.5 THEN 0 WHEN v < 0.8 THEN 1 WHEN v < 1.2 THEN 2 ELSE 3 END", "v_pct": f"CASE WHEN len(list(v) OVER ({S} ROWS BETWEEN 251 PRECEDING AND 1 PRECEDING)) >= 49 THEN len(list_filter(list(v) OVER ({S} ROWS BETWEEN 251 PRECEDING AND 1 PRECEDING), lambda q: q < v)) / len(list(v) OVER ({S} ROWS BETWEEN 251 PRECEDING AND 1 PRECEDING)) * 100 END"})) + f" SELECT date, {out(['v_z', 'v_ma20_ratio', 'v_chg5', 'v_regime', 'v_pct'])} FROM a")
def regime_block(spark, sf_dir):
    return shown(mc.regime(_flow(spark, sf_dir), "v", (0.5, 0.8, 1.2)), ["date"], ["v_z", "v_ma20_ratio", "v_chg5", "v_regime", "v_pct"])


@query(chain(MACRO, _ONE, stage("a", "flow1", {"c5": f"v - {lagged('v', 5)}", "z60": sample_z("v", 60, 20), "z252": sample_z("v", 252, 60)}), stage("b", "a", {"v_level": lagged("v", 3), "v_chg5": lagged("c5", 3), "v_z60": lagged("z60", 3), "v_z252": lagged("z252", 3)})) + f" SELECT date, {out(['v_level', 'v_chg5', 'v_z60', 'v_z252'], 8)} FROM b")
def published_series(spark, sf_dir):
    return shown(mc.published(_flow(spark, sf_dir), "v", 3), ["date"], ["v_level", "v_chg5", "v_z60", "v_z252"], 8)


_BW = "bw AS (SELECT 'ALL' AS symbol, date, max(CASE WHEN bench = 'ASIA' THEN px END) AS asia, max(CASE WHEN bench = 'EUROPE' THEN px END) AS europe, max(CASE WHEN bench = 'ALL' THEN px END) AS \"all\", max(CASE WHEN bench = 'ASIA' THEN bench_ret END) AS ra, max(CASE WHEN bench = 'EUROPE' THEN bench_ret END) AS re FROM bench GROUP BY date)"


def _bench_wide(spark, sf_dir, price):
    b = pn.benchmarks(bars(spark, sf_dir), sectors(spark, sf_dir)).withColumnRenamed("bench", "symbol")
    return mc.wide_prices(b, ["ASIA", "EUROPE", "ALL"], price)


@query(chain(BARS, SECTORS, BENCH, _BW, stage("r", "bw", {"ae": over("asia", "europe"), "aa": over("asia", '"all"')}), stage("q", "r", {"ae_z": sample_z("ae", 60, 20), "aa_z": sample_z("aa", 60, 20)})) + f" SELECT date, {out(['ae', 'aa', 'ae_z', 'aa_z'])} FROM q")
def cross_asset_ratios(spark, sf_dir):
    return shown(mc.ratios(_bench_wide(spark, sf_dir, "px"), {"ae": ("asia", "europe"), "aa": ("asia", "all")}), ["date"], ["ae", "aa", "ae_z", "aa_z"])


@query(chain(BARS, SECTORS, BENCH, _BW, stage("r", "bw", {"x": "CASE WHEN ra IS NOT NULL AND re IS NOT NULL THEN ra END", "y": "CASE WHEN ra IS NOT NULL AND re IS NOT NULL THEN re END"}), stage("q", "r", {"c": f"CASE WHEN count(x) OVER {rw(60)} >= 30 THEN {over(f'covar_samp(x, y) OVER {rw(60)}', f'stddev_samp(x) OVER {rw(60)} * stddev_samp(y) OVER {rw(60)}')} END"})) + " SELECT date, round(c, 5) + 0.0 AS corr FROM q")
def rolling_correlation(spark, sf_dir):
    return shown(mc.rolling_correlation(_bench_wide(spark, sf_dir, "bench_ret"), "asia", "europe"), ["date"], ["corr"])


@query(chain(BARS, SECTORS, BENCH, _BW, stage("r", "bw", {"s": "ra - re"}), stage("q", "r", {"ae_cum_20": roll("sum", "s", 20, 6), "ae_cum_60": roll("sum", "s", 60, 20), "ae_z_60": sample_z("s", 60, 30), "k": f"CAST(row_number() OVER ({S}) AS DOUBLE)"}), stage("t", "q", {"ae_slope_20": f"CASE WHEN count(s) OVER {rw(20)} >= 10 THEN regr_slope(s, k) OVER {rw(20)} END"})) + f" SELECT date, {out(['ae_cum_20', 'ae_cum_60', 'ae_z_60', 'ae_slope_20'])} FROM t")
def return_spreads(spark, sf_dir):
    return shown(mc.global_spreads(_bench_wide(spark, sf_dir, "bench_ret"), {"ae": ("asia", "europe")}), ["date"], ["ae_cum_20", "ae_cum_60", "ae_z_60", "ae_slope_20"])


@query(chain(BARS, stage("a", "bars", {"dp": f"close - {lagged('close', 10)}", "dv": f"volume - {lagged('volume', 10)}"}), stage("b", "a", {"x": f"tanh(dp / greatest({dev('dp', 60, 20, 'stddev_samp')}, 1e-8)) - tanh(dv / greatest({dev('dv', 60, 20, 'stddev_samp')}, 1e-8))"})) + f" SELECT symbol, date, round(CASE WHEN count(dp) OVER {rw(60)} >= 20 THEN x END, 5) + 0.0 AS div_10 FROM b")
def direction_divergence(spark, sf_dir):
    t = ft.direction_divergence(bars(spark, sf_dir), "close", "volume", 10, "div_10")
    t = t.withColumn("__d", F.col("close") - F.lag("close", 10).over(Window.partitionBy("symbol").orderBy("date")))
    t = t.withColumn("div_10", F.when(F.count("__d").over(Window.partitionBy("symbol").orderBy("date").rowsBetween(-59, 0)) >= 20, F.col("div_10")))
    return shown(t, ["symbol", "date"], ["div_10"])


@query(chain(BARS, stage("a", "bars", {"d": f"CASE WHEN close > {lagged('close')} THEN 1.0 ELSE 0.0 END - CASE WHEN volume > {lagged('volume')} THEN 1.0 ELSE 0.0 END"})) + f" SELECT symbol, date, round(({roll('sum', 'd', 20, 10)}) / 20, 5) + 0.0 AS cum_20 FROM a")
def cumulative_divergence(spark, sf_dir):
    return shown(ft.cumulative_divergence(bars(spark, sf_dir), "close", "volume", 20, "cum_20"), ["symbol", "date"], ["cum_20"])


@query(chain(BARS, SECTORS, BENCH, RET, _FIT) + ", co AS (SELECT symbol, bench, n, c / (sqrt(v) * sqrt(u)) AS corr FROM fit WHERE n > 100), m AS (SELECT *, CASE WHEN corr >= 0.6 AND n >= 500 THEN 'high' WHEN corr >= 0.3 AND n >= 100 THEN 'medium' ELSE 'low' END AS confidence FROM co) SELECT confidence, CAST(count(*) AS BIGINT) AS n_symbols, round(avg(corr), 6) + 0.0 AS mean_corr FROM m GROUP BY 1")
def mapping_confidence(spark, sf_dir):
    b = ft.returns(bars(spark, sf_dir))
    return shown(mp.validation(mp.confidence(pn.correlations(b, pn.benchmarks(b, sectors(spark, sf_dir))))), ["confidence", "n_symbols"], ["mean_corr"], 6)


@query("WITH k(grp, word, weight) AS (VALUES ('metal', 'bolt', 1.0), ('metal', 'gear', 1.0), ('finish', 'red', 1.5), ('finish', 'small', 0.5)), s AS (SELECT p_partkey AS symbol, grp, sum(weight) AS score FROM part JOIN k ON contains(lower(p_type || ' ' || p_name), word) GROUP BY 1, 2) SELECT symbol, \"group\", score FROM (SELECT symbol, grp AS \"group\", round(score, 3) + 0.0 AS score, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, grp) AS q FROM s) WHERE q = 1")
def keyword_mapping(spark, sf_dir):
    words = spark.createDataFrame([("metal", "bolt", 1.0), ("metal", "gear", 1.0), ("finish", "red", 1.5), ("finish", "small", 0.5)], "group string, word string, weight double")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol"), F.concat_ws(" ", "p_type", "p_name").alias("description"))
    return shown(mp.by_keyword(parts, words), ["symbol", "group"], ["score"], 3)


@query("WITH s AS (SELECT DISTINCT l_returnflag || l_linestatus AS model, l_partkey AS feature FROM lineitem), n AS (SELECT model, count(*) AS n FROM s GROUP BY 1) SELECT x.model AS a, y.model AS b, CAST(count(*) AS BIGINT) AS shared, round(count(*) / (max(p.n) + max(q.n) - count(*)), 6) + 0.0 AS jaccard FROM s x JOIN s y ON x.feature = y.feature AND x.model < y.model JOIN n p ON p.model = x.model JOIN n q ON q.model = y.model GROUP BY 1, 2")
def selection_overlap(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("model"), F.col("l_partkey").alias("feature"))
    return shown(sl.overlap_matrix(s), ["a", "b", "shared"], ["jaccard"], 6)


@query("WITH o AS (SELECT DISTINCT l_partkey AS feature FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01'), n AS (SELECT DISTINCT l_partkey AS feature FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01') SELECT coalesce(o.feature, n.feature) AS feature, CASE WHEN o.feature IS NULL THEN 'added' WHEN n.feature IS NULL THEN 'removed' ELSE 'unchanged' END AS change FROM o FULL JOIN n ON o.feature = n.feature")
def set_changes(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "feature")  # noqa: E741
    return sl.changes(l.where("l_shipdate < timestamp '1997-01-01'"), l.where("l_shipdate >= timestamp '2000-01-01'"))


@query(chain(*_P) + ", r AS (SELECT *, least(greatest(0.5 * (probability - 0.5), 0.0), 0.1) AS r FROM signals), w0 AS (SELECT *, CASE WHEN r >= 0.01 THEN r ELSE 0.0 END AS weight FROM r), c1 AS (SELECT *, least(weight, 0.1) AS w FROM w0), c2 AS (SELECT * REPLACE (CASE WHEN sum(w) OVER (PARTITION BY week, sector) > 0.3 THEN w * 0.3 / sum(w) OVER (PARTITION BY week, sector) ELSE w END AS w) FROM c1), c3 AS (SELECT *, row_number() OVER (PARTITION BY week ORDER BY round(w, 12) DESC, symbol) AS k FROM c2 WHERE w >= 0.005), c4 AS (SELECT *, sum(w) OVER (PARTITION BY week) AS g FROM c3 WHERE k <= 20) SELECT symbol, week, round(least(CASE WHEN g > 1 THEN w / g ELSE w END, 0.1), 6) + 0.0 AS weight FROM c4")
def constrained_weights(spark, sf_dir):
    return shown(pf.constrain(pf.monotone(signals(spark, sf_dir))), ["symbol", "week"], ["weight"], 6)


@query(chain(*_P, _EQ) + ", v AS (SELECT *, 0.1 + (volume % 7) / 20 AS sigma FROM eq), u AS (SELECT *, weight * coalesce(0.15 / nullif(sqrt(sum(power(weight * sigma, 2)) OVER (PARTITION BY week)), 0), 1) AS w FROM v), t AS (SELECT *, sum(abs(w)) OVER (PARTITION BY week) AS g FROM u) SELECT symbol, week, round(CASE WHEN g > 1 THEN w / g ELSE w END, 6) + 0.0 AS weight FROM t")
def volatility_targeted(spark, sf_dir):
    w = pf.equal_top(signals(spark, sf_dir)).withColumn("sigma", 0.1 + (F.col("volume") % 7) / 20)
    return shown(pf.target_volatility(w, "sigma"), ["symbol", "week"], ["weight"], 6)


@query(chain(BARS, RET) + ", u AS (SELECT symbol, 'ret' AS feature, ret AS v FROM rets UNION ALL SELECT symbol, 'close', close FROM rets UNION ALL SELECT symbol, 'volume', volume FROM rets) SELECT symbol, feature, CAST(count(v) AS BIGINT) AS n_valid, CAST(count(*) AS BIGINT) AS n_total, round(100 * (1 - count(v) / count(*)), 6) + 0.0 AS null_pct FROM u GROUP BY 1, 2")
def feature_coverage(spark, sf_dir):
    return shown(ql.coverage(ft.returns(bars(spark, sf_dir)), ["ret", "close", "volume"]), ["symbol", "feature", "n_valid", "n_total"], ["null_pct"], 6)


@query(chain(BARS, ATR) + " SELECT symbol, date, round((close + 3.0 * atr) / close * 100 - 100, 5) + 0.0 AS target_pct, round(100 - (close - 1.5 * atr) / close * 100, 5) + 0.0 AS stop_pct, round(1 / (1 + ((close + 3.0 * atr) / close - 1) / (1 - (close - 1.5 * atr) / close)), 5) + 0.0 AS break_even FROM entries WHERE atr > 0")
def price_levels(spark, sf_dir):
    return shown(sl.price_levels(lb.with_atr(bars(spark, sf_dir)).where("atr > 0"), 3.0, 1.5), ["symbol", "date"], ["target_pct", "stop_pct", "break_even"])


@query("SELECT user_id AS symbol, CAST(CAST(ts AS DATE) + CAST((12 - dayofweek(CAST(ts AS DATE))) % 7 AS INTEGER) AS DATE) AS date, round(arg_min(value, ts), 6) + 0.0 AS open, round(max(value), 6) + 0.0 AS high, round(min(value), 6) + 0.0 AS low, round(arg_max(value, ts), 6) + 0.0 AS close, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def streaming_weekly_bars(spark, sf_dir):
    from .streaming.bars import weekly_bars as weekly

    t = table(spark, sf_dir, "events").select(F.col("user_id").alias("symbol"), "ts", "value")
    return shown(weekly(t), ["symbol", "date", "n"], ["open", "high", "low", "close"], 6)


_PANEL_KERNELS = ["trend_persist_ema", "vol_regime_ema10", "quiet_trend", "volshock_ema", "squeeze_on_20", "squeeze_intensity_20", "days_in_squeeze_20", "gap_atr_ratio", "gap_atr_ratio_raw", "atr_percent_chg_5", "rsi_price_div_10d", "rsi_price_div_cum_20d", "macd_price_div_20d", "trend_rsi_div_10d", "vol_trend_div_20d", "macd_histogram", "rsi_14", "rsi_30", "atr14", "adx_14"]


@query(None)
def feature_panel(spark, sf_dir):
    """All fifteen blocks; the window blocks have twins of their own, these columns one in standard_blocks."""
    t = pl.feature_table(bars(spark, sf_dir))
    return shown(t, ["symbol", "date"], [c for c in t.columns if c not in {"symbol", "date"}])


def run_fold(x: str, n: float) -> str:
    """An exponential mean of span n: values before a gap weigh less by the rows of the gap."""
    k = 2 / (n + 1)
    step = f"CASE WHEN q.v IS NULL THEN struct_pack(v := p.v, w := p.w * {1 - k}) WHEN p.v IS NULL THEN struct_pack(v := q.v, w := 1::DOUBLE) ELSE struct_pack(v := (p.w * {1 - k} * p.v + {k} * q.v) / (p.w * {1 - k} + {k}), w := 1::DOUBLE) END"
    return f"list_reduce(list(struct_pack(v := CAST({x} AS DOUBLE), w := 1::DOUBLE)) OVER ({S} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda p, q: {step}).v"


def _wilder_list(x: str, n: int) -> str:
    return f"CASE WHEN len({x}) >= {n} THEN list_reduce({x}[{n + 1}:], lambda p, q: p + (q - p) / {n}.0, list_avg({x}[1:{n}])) END"


def _seeded_list(x: str, n: int) -> str:
    return f"CASE WHEN len({x}) >= {n} THEN list_reduce({x}[{n + 1}:], lambda p, q: p + {2 / (n + 1)} * (q - p), list_avg({x}[1:{n}])) END"


_ALL_BEFORE = f"({S} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


_RI = ["rsi_14", "rsi_21", "rsi_30", "macd", "macd_signal", "macd_histogram", "macd_hist_deriv_ema3", "atr14", "atr_percent", "adx_14", "di_plus_14", "di_minus_14"]
_RIS = [
    stage("i1", "bars", {"pc": lagged("close"), "nn": "count(close) OVER (PARTITION BY symbol)", "fast": run_fold("close", 12), "slow": run_fold("close", 26)}),
    stage("i2", "i1", {"d": "close - pc", "tr": "CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END", "hu": f"high - {lagged('high')}", "ld": f"{lagged('low')} - low", "line": "CASE WHEN nn >= 35 THEN fast - slow END"}),
    stage("i3", "i2", {"pdm": "CASE WHEN pc IS NULL THEN NULL WHEN hu > ld AND hu > 0 THEN hu ELSE 0.0 END", "mdm": "CASE WHEN pc IS NULL THEN NULL WHEN ld > hu AND ld > 0 THEN ld ELSE 0.0 END", "sig": run_fold("line", 9)}),
    stage("i4", "i3", {n: f"list({x}) FILTER (WHERE {c} IS NOT NULL) OVER {_ALL_BEFORE}" for n, x, c in (("ups", "greatest(d, 0.0)", "d"), ("downs", "greatest(-d, 0.0)", "d"), ("trs", "tr", "tr"), ("trd", "tr", "pc"), ("pl", "pdm", "pdm"), ("ml", "mdm", "mdm"))} | {"hist": "line - sig"}),
    stage("i5", "i4", {f"{n}{w}": _wilder_list(x, w) for n, x in (("u", "ups"), ("v", "downs")) for w in (14, 21, 30)} | {"atr": _wilder_list("trs", 14), "wd": _wilder_list("trd", 14), "pu": _wilder_list("pl", 14), "pm": _wilder_list("ml", 14), "hd": f"hist - {lagged('hist')}"}),
    stage("i6", "i5", {f"rsi_{w}": f"100 * u{w} / nullif(u{w} + v{w}, 0)" for w in (14, 21, 30)} | {"macd": "line", "macd_signal": "sig", "macd_histogram": "hist", "macd_hist_deriv_ema3": run_fold("hd", 3), "atr14": "atr", "atr_percent": "atr / close", "di_plus_14": "100 * pu / nullif(wd, 0)", "di_minus_14": "100 * pm / nullif(wd, 0)", "dx": "100 * abs(pu - pm) / nullif(pu + pm, 0)"}),
    stage("i7", "i6", {"dxl": f"list(dx) FILTER (WHERE dx IS NOT NULL) OVER {_ALL_BEFORE}"}),
    stage("i8", "i7", {"adx_14": _wilder_list("dxl", 14)}),
]


@query(chain(BARS, *_RIS) + f" SELECT symbol, date, {out(_RI, 4)} FROM i8")
def recursive_indicators(spark, sf_dir):
    return shown(kn.recursive(bars(spark, sf_dir), ["rsi", "macd", "atr", "adx"]), ["symbol", "date"], _RI, 4)


_KP = [
    stage("k1", "w", {"pc": lagged("close"), "r0": f"ln(close) - ln({lagged('close')})", "tsign": "sign(trend_score_granular)", "vsz": z("volume", 20), "vdir": f"sign(close - {lagged('close', 10)})"}),
    stage("k2", "k1", {"d": "close - pc", "tr": "CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END", "rv20": dev("r0", 20), "rv100": dev("r0", 100), "pdm": f"CASE WHEN pc IS NULL THEN NULL WHEN high - {lagged('high')} > {lagged('low')} - low AND high - {lagged('high')} > 0 THEN high - {lagged('high')} ELSE 0.0 END", "mdm": f"CASE WHEN pc IS NULL THEN NULL WHEN {lagged('low')} - low > high - {lagged('high')} AND {lagged('low')} - low > 0 THEN {lagged('low')} - low ELSE 0.0 END", "vsd": "vsz * vdir", "fast": run_fold("close", 12), "slow": run_fold("close", 26), "nn": "count(close) OVER (PARTITION BY symbol)", "gap": over("close", "pc") + " - 1"}),
    stage("k3", "k2", {"vreg": f"ln(1 + {over('rv20', 'rv100')})", "line": "CASE WHEN nn >= 35 THEN fast - slow END", "ups": f"list(greatest(d, 0.0)) FILTER (WHERE d IS NOT NULL) OVER {_ALL_BEFORE}", "downs": f"list(greatest(-d, 0.0)) FILTER (WHERE d IS NOT NULL) OVER {_ALL_BEFORE}", "trs": f"list(tr) OVER {_ALL_BEFORE}", "trd": f"list(tr) FILTER (WHERE pc IS NOT NULL) OVER {_ALL_BEFORE}", "ul": f"list(pdm) FILTER (WHERE pdm IS NOT NULL) OVER {_ALL_BEFORE}", "dl": f"list(mdm) FILTER (WHERE mdm IS NOT NULL) OVER {_ALL_BEFORE}", "cs": f"list(close) OVER {_ALL_BEFORE}", "bm": roll("avg", "close", 20, 20), "bd": roll("stddev_pop", "close", 20, 20), "tpe": run_fold("tsign", 10), "vse": run_fold("vsd", 10)}),
    stage("k4", "k3", {"vema": run_fold("vreg", 10), "sig": run_fold("line", 9), "u14": _wilder_list("ups", 14), "v14": _wilder_list("downs", 14), "u30": _wilder_list("ups", 30), "v30": _wilder_list("downs", 30), "atr": _wilder_list("trs", 14), "wd": _wilder_list("trd", 14), "pu": _wilder_list("ul", 14), "pd": _wilder_list("dl", 14), "kb": _seeded_list("cs", 20), "kr": _seeded_list("trs", 20)}),
    stage("k5", "k4", {"rsi14": f"100 * {over('u14', 'u14 + v14')}", "rsi30": f"100 * {over('u30', 'u30 + v30')}", "hist": "line - sig", "ap": over("atr", "close"), "dx": f"100 * {over('abs(pu - pd)', 'pu + pd')}", "vmed": f"CASE WHEN count(vema) OVER {rw(252)} >= 50 THEN quantile_cont(vema, 0.5) OVER {rw(252)} END", "son": "CASE WHEN bm + 2 * bd < kb + 1.5 * kr AND bm - 2 * bd > kb - 1.5 * kr THEN 1.0 ELSE 0.0 END"}),
    stage("k6", "k5", {"dxl": f"list(dx) FILTER (WHERE dx IS NOT NULL) OVER {_ALL_BEFORE}", "isl": f"sum(CASE WHEN son = 1 THEN 0 ELSE 1 END) OVER {_ALL_BEFORE}"} | {f"d{n}{w}": f"{x} - {lagged(x, w)}" for n, x in (("p", "close"), ("r", "rsi14"), ("m", "hist"), ("t", "tsign"), ("v", "vema")) for w in (10, 20)} | {"ap5": lagged("ap", 5), "apart": f"CAST(close - pc > 0 AND pc IS NOT NULL AS INTEGER)::DOUBLE - coalesce(CAST(rsi14 - {lagged('rsi14')} > 0 AS INTEGER), 0)::DOUBLE"}),
    stage("k7", "k6", {f"t{n}{w}": f"CASE WHEN count(d{n}{w}) OVER {rw(60)} >= 20 THEN tanh(d{n}{w} / greatest(stddev_samp(d{n}{w}) OVER {rw(60)}, 1e-8)) END" for n in "prmtv" for w in (10, 20)} | {"apart20": roll("sum", "apart", 20, 10)}),
    stage("k8", "k7", {"trend_persist_ema": "tpe", "vol_regime_ema10": "vema", "quiet_trend": "trend_score_granular * CASE WHEN vema < vmed THEN 1.0 ELSE 0.0 END", "volshock_ema": "vse", "squeeze_on_20": "son", "squeeze_intensity_20": clipped(over("3 * kr - 4 * bd", "3 * kr"), -1, 1), "days_in_squeeze_20": "least(sum(son) OVER (PARTITION BY symbol, isl ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 50)", "gap_atr_ratio": over("gap", "ap"), "gap_atr_ratio_raw": over("open - pc", "atr"), "atr_percent_chg_5": over("ap - ap5", "ap5"), "rsi_price_div_10d": "tp10 - tr10", "rsi_price_div_cum_20d": f"{run_fold('apart20', 5)} / 20", "macd_price_div_20d": "tp20 - tm20", "trend_rsi_div_10d": "tt10 - tr10", "vol_trend_div_20d": "tv20 - tt20", "macd_histogram": "hist", "rsi_14": "rsi14", "rsi_30": "rsi30", "atr14": "atr", "adx_14": _wilder_list("dxl", 14)}),
]


@query(chain(BARS, _MA, _SL, _SG, _TS, "w AS (SELECT * FROM v)", *_KP) + f" SELECT symbol, date, {out(_PANEL_KERNELS, 4)} FROM k8")
def standard_blocks(spark, sf_dir):
    return shown(pl.feature_table(bars(spark, sf_dir), _PANEL_KERNELS), ["symbol", "date"], _PANEL_KERNELS, 4)


@query(None)
def weekly_features_daily(spark, sf_dir):
    t = pl.higher_time_frame(bars(spark, sf_dir), pl.BLOCKS)
    return shown(t, ["symbol", "date"], [c for c in t.columns if c.startswith("w_")])


@query(None)
def boosted_trees_by_fold(spark, sf_dir):
    b = ft.returns(lb.with_atr(bars(spark, sf_dir))).withColumns({"rv": F.col("atr") / F.col("close"), "rel": F.col("close") / F.col("open")})
    t = lb.first_touch(b, 3.0, 3.0, _H).select("symbol", F.col("date").alias("entry"), F.col("t_hit").alias("exit"), (F.col("hit") == 1).cast("double").alias("y"), F.coalesce("ret", F.lit(0.0)).alias("ret"), "rv", "rel", "volume").persist()
    folds = ev.purged_kfold(t, 2)
    oof = sl.out_of_fold(folds, ["ret", "rv", "rel", "volume"], "y", maxIter=5, maxDepth=3)
    return shown(ev.auc(oof.withColumn("p", F.col("probability")), ["fold"]), ["fold"], ["auc"], 4)


# more labels, folds and portfolios


@query(chain(*_SPANS) + ", x AS (SELECT * FROM sp), q AS (SELECT *, t0 <= DATE '1998-12-31' AND t1 >= DATE '1998-01-01' AS purged, t0 > DATE '1998-12-31' AND t0 <= DATE '1998-12-31' + 30 AS embargoed FROM x) SELECT CAST(count(*) FILTER (WHERE purged) AS BIGINT) AS n_purged, CAST(count(*) FILTER (WHERE embargoed) AS BIGINT) AS n_embargoed, CAST(count(*) AS BIGINT) AS n FROM q")
def purge_and_embargo(spark, sf_dir):
    m = ev.purge_mask(_entries(spark, sf_dir), "1998-01-01", "1998-12-31", 30)
    return m.agg(F.count_if("purged").alias("n_purged"), F.count_if("embargoed").alias("n_embargoed"), F.count("*").alias("n"))


@query(chain(*_SPANS) + ", c AS (SELECT quantile_cont(date_diff('day', DATE '1970-01-01', t0), 0.8) AS c FROM sp) SELECT CASE WHEN date_diff('day', DATE '1970-01-01', t0) <= c THEN 'train' ELSE 'test' END AS role, CAST(count(*) AS BIGINT) AS n, max(t0) AS last_entry FROM sp, c GROUP BY 1")
def date_split(spark, sf_dir):
    return ev.date_split(_entries(spark, sf_dir)).groupBy("role").agg(F.count("*").alias("n"), F.max("entry").alias("last_entry"))


@query(chain(*_SPANS) + ", f AS (SELECT CAST(ntile(6) OVER (ORDER BY t0, symbol) - 1 AS INTEGER) AS fold, hit FROM sp) SELECT fold, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE hit = 1) AS BIGINT) AS n_positive, round(count(*) FILTER (WHERE hit = 1) / count(*), 6) + 0.0 AS prevalence FROM f GROUP BY 1")
def positives_by_fold(spark, sf_dir):
    return shown(ev.time_folds(_entries(spark, sf_dir), 6), ["fold", "n", "n_positive"], ["prevalence"], 6)


_EVS = "es AS (SELECT CAST(ts AS DATE) AS date, (event_id % 101) / 101 AS p, CASE WHEN value > 50 THEN 1 ELSE 0 END AS y FROM events)"


@query(f"WITH {_EVS}, d AS (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM es)), s AS (SELECT w.k, w.date, p, y FROM es JOIN d e USING (date) JOIN d w ON e.k BETWEEN w.k - 9 AND w.k), r AS (SELECT k, date, y, rank() OVER (PARTITION BY k ORDER BY p) + (count(*) OVER (PARTITION BY k, p) - 1) / 2 AS q FROM s), g AS (SELECT date, count(*) AS n, sum(y) AS t, sum(CASE WHEN y = 1 THEN q ELSE 0 END) AS r FROM r GROUP BY 1) SELECT date, CAST(n AS BIGINT) AS n, round((r - t * (t + 1) / 2) / (t * (n - t)), 6) + 0.0 AS auc FROM g WHERE n > 20 AND t > 0 AND t < n")
def rolling_auc(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("date"), ((F.col("event_id") % 101) / 101).alias("p"), (F.col("value") > 50).cast("int").alias("y"))
    return shown(ev.rolling_auc(e, 10, 20), ["date", "n"], ["auc"], 6)


@query(chain(*_TOUCH) + ", x AS (SELECT atr / close AS a FROM pr WHERE hit = 1) SELECT CAST(count(*) AS BIGINT) AS n, round(avg(a), 5) + 0.0 AS mean, round(quantile_cont(a, 0.5), 5) + 0.0 AS median, round(quantile_cont(a, 0.1), 5) + 0.0 AS p10, round(quantile_cont(a, 0.9), 5) + 0.0 AS p90, round(avg(CASE WHEN a > 0.05 THEN 1.0 ELSE 0.0 END), 5) + 0.0 AS share_wide FROM x")
def atr_of_positives(spark, sf_dir):
    return shown(lb.atr_spread(_labels(spark, sf_dir)), ["n"], ["mean", "median", "p10", "p90", "share_wide"])


_MULTI = SQL["multi_barrier"].replace(" SELECT symbol, date, CAST(CASE", ", mu AS (SELECT symbol, date, CAST(CASE", 1) + ")"


@query(_MULTI + ", u AS (SELECT 'even' AS model, hit_even AS hit FROM mu UNION ALL SELECT 'long', hit_long FROM mu), g AS (SELECT model, hit, count(*) AS n FROM u GROUP BY 1, 2) SELECT model, hit, CAST(n AS BIGINT) AS n, round(n / sum(n) OVER (PARTITION BY model), 6) + 0.0 AS share FROM g")
def outcome_shares(spark, sf_dir):
    m = lb.multi_touch(lb.with_atr(bars(spark, sf_dir)), {"even": (1.5, 1.5), "long": (3.0, 1.5)}, _H)
    return shown(lb.outcomes(m, ["even", "long"]), ["model", "hit", "n"], ["share"], 6)


@query(_MULTI + " SELECT symbol, date, 'even' AS model, CAST(hit_even = -1 AS INTEGER) AS y FROM mu WHERE hit_even <> 0 UNION ALL SELECT symbol, date, 'long', CAST(hit_long = 1 AS INTEGER) FROM mu WHERE hit_long <> 0")
def binary_labels(spark, sf_dir):
    m = lb.multi_touch(lb.with_atr(bars(spark, sf_dir)), {"even": (1.5, 1.5), "long": (3.0, 1.5)}, _H)
    return lb.binary(m, {"even": -1, "long": 1})


_RDD = "rd AS (SELECT *, row_number() OVER (ORDER BY week) AS k, list(nav) OVER (ORDER BY week ROWS BETWEEN 51 PRECEDING AND CURRENT ROW) AS l FROM nv), re AS (SELECT week, CASE WHEN k >= 52 THEN list_min(list_transform(range(1, 53), lambda i: list_min(l[i:]) / l[i] - 1)) END AS rdd FROM rd)"


@query(chain(*_P, _EQ, _WR, _NAV, _RDD) + ", r AS (SELECT week, CASE WHEN count(ret) OVER f >= 52 THEN exp(sum(ln(1 + ret)) OVER f) - 1 END AS roll_return, CASE WHEN count(ret) OVER f >= 52 THEN stddev_samp(ret) OVER f * sqrt(52) END AS roll_volatility, CASE WHEN count(ret) OVER f >= 52 THEN avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) OVER f END AS roll_hit_rate FROM wr WINDOW f AS (ORDER BY week ROWS BETWEEN 51 PRECEDING AND CURRENT ROW)) SELECT week, round(roll_return, 4) + 0.0 AS roll_return, round(roll_volatility, 4) + 0.0 AS roll_volatility, round(roll_hit_rate, 4) + 0.0 AS roll_hit_rate, round(rdd, 4) + 0.0 AS roll_max_drawdown FROM r JOIN re USING (week)")
def rolling_performance(spark, sf_dir):
    w = pf.weekly_returns(pf.equal_top(signals(spark, sf_dir)))
    return shown(pf.rolling_performance(w), ["week"], ["roll_return", "roll_volatility", "roll_hit_rate", "roll_max_drawdown"], 4)


@query(chain(*_P, _EQ, _WR, _NAV) + ", m AS (SELECT year(week) AS y, month(week) AS m, arg_max(nav, week) AS nav FROM nv GROUP BY 1, 2), r AS (SELECT y, m, nav / coalesce(lag(nav) OVER (ORDER BY y, m), 1.0) - 1 AS r FROM m) SELECT CAST(y AS INTEGER) AS year, round(max(CASE WHEN m = 1 THEN r END), 4) + 0.0 AS m01, round(max(CASE WHEN m = 6 THEN r END), 4) + 0.0 AS m06, round(max(CASE WHEN m = 12 THEN r END), 4) + 0.0 AS m12, round(exp(sum(ln(1 + r))) - 1, 4) + 0.0 AS total FROM r GROUP BY 1")
def monthly_returns(spark, sf_dir):
    w = pf.weekly_returns(pf.equal_top(signals(spark, sf_dir)))
    return shown(pf.monthly_matrix(w), ["year"], ["m01", "m06", "m12", "total"], 4)


@query(chain(*_P, _EQ) + ", s AS (SELECT *, sum(weight) OVER (PARTITION BY week, sector) AS sw FROM eq) SELECT week, max(weight) <= 0.1 + 1e-9 AS name_ok, max(sw) <= 0.3 + 1e-9 AS sector_ok, sum(abs(weight)) <= 1 + 1e-9 AS gross_ok FROM s GROUP BY 1")
def constraint_flags(spark, sf_dir):
    return pf.limits(pf.equal_top(signals(spark, sf_dir)))


@query(chain(BARS, SECTORS, SIGNALS) + " SELECT s.symbol, s.week, s.sector, round(s.probability, 4) + 0.0 AS probability, round(b.volume, 3) + 0.0 AS bar_volume FROM signals s LEFT JOIN (SELECT symbol, CAST(date_trunc('week', date) AS DATE) AS week, sum(volume) AS volume FROM bars GROUP BY 1, 2) b ON s.symbol = b.symbol AND s.week = b.week")
def sized_signals(spark, sf_dir):
    weekly = bars(spark, sf_dir).groupBy("symbol", F.date_trunc("week", "date").cast("date").alias("week")).agg(F.sum("volume").alias("bar_volume"))
    s = signals(spark, sf_dir).drop("volume").join(weekly, ["symbol", "week"], "left").withColumn("probability", F.round("probability", 4) + 0.0)
    return shown(s, ["symbol", "week", "sector", "probability"], ["bar_volume"], 3)


from . import queries_market, queries_more  # noqa: E402, F401 (register their queries)
