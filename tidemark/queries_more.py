"""More registered queries: tables and their reports, jobs around a model, weekly and benchmark-relative features."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from .operators import evaluation as ev
from .operators import factors as fc
from .operators import features as ft
from .operators import kernels as kn
from .operators import labels as lb
from .operators import macro as mc
from .operators import mapping as mp
from .operators import model as md
from .operators import order
from .operators import panel as pn
from .operators import portfolio as pf
from .operators import quality as ql
from .operators import selection as sl
from .operators import significance as sg
from .operators import tables as tb
from .operators import training as tr
from .functions import windows as wn
from .sources.stages import shared_path as stream_dir
from .streaming import stateful as sst
from .plans import cross_section as xs
from .queries import _EQ, _EVS, _FIT, _J, _NEXT, _P, _SPANS, _TOUCH, _WR, ATR, BARS, BENCH, FRIDAY, MACRO, RET, SCORED, SECTORS, WEEKLY, S, _entries, _flow, _H, _labels, _spans, bars, breadth_sql, calendar_sum, chain, dev, lagged, macro, mean, out, over, query, ridge_sql, roll, run_fold, rw, sample_z, scored, sectors, shown, signals, stage, table, z

KEYS = ["symbol", "date"]

# tables

_ADJ = "adj AS (SELECT symbol, date, open, high, low, close, close * (1 + (dayofyear(date) % 5) / 7) AS adjclose, volume FROM bars)"


def _with_adjclose(spark, sf_dir):
    return bars(spark, sf_dir).withColumn("adjclose", F.col("close") * (1 + (F.dayofyear("date") % 5) / 7))


@query(chain(BARS, _ADJ, stage("f", "adj", {"f": "CASE WHEN close <> 0 THEN adjclose / close ELSE 1.0 END"})) + " SELECT symbol, date, CAST(NULL AS DOUBLE) AS open, round(high * f, 7) + 0.0 AS high, round(low * f, 7) + 0.0 AS low, round(close * f, 7) + 0.0 AS close, round(volume, 7) + 0.0 AS volume FROM f")
def adjusted_bars(spark, sf_dir):
    return shown(tb.assembled(_with_adjclose(spark, sf_dir).drop("open")), KEYS, ["open", "high", "low", "close", "volume"], 7)


@query("SELECT p_partkey FROM (SELECT p_partkey, 'T' || p_partkey || ['.W', '-U', '/R', '.PRA', '.F', 'W', ''][p_partkey % 7 + 1] AS s, upper(p_name || [' acquisition corp', ' american depositary share', ' blank check', ' acquisitions'][p_partkey % 4 + 1]) AS d FROM part) WHERE NOT regexp_matches(s, '[.\\-/](WS?|U|R|PR?[A-Z]?|F)$') AND NOT regexp_matches(d, 'ACQUISITION\\s+(CORP|CO\\b|COMPANY|LIMITED|INC)|\\bADR\\b|AMERICAN DEPOSITARY|DEPOSITARY SHARE|DEPOSITARY RECEIPT|^ADS-|BLANK CHECK')")
def untradeable_filter(spark, sf_dir):
    k = F.col("p_partkey")
    ends = F.get(F.array(*map(F.lit, (".W", "-U", "/R", ".PRA", ".F", "W", ""))), k % 7)
    words = F.get(F.array(*map(F.lit, (" acquisition corp", " american depositary share", " blank check", " acquisitions"))), k % 4)
    return ql.tradeable(table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("T"), k.cast("string"), ends).alias("symbol"), F.concat("p_name", words).alias("description"))).select("p_partkey")


@query(chain(BARS, "old AS (SELECT *, 1 AS loaded, 'etfs' AS source FROM bars WHERE CAST(substr(symbol, 2) AS BIGINT) % 3 <> 0)", "new AS (SELECT *, 2 AS loaded, 'stocks' AS source FROM bars WHERE CAST(substr(symbol, 2) AS BIGINT) % 2 = 0)", "u AS (SELECT * FROM old UNION ALL SELECT * FROM new)") + " SELECT symbol, source, CAST(count(*) AS BIGINT) AS n FROM u WHERE loaded = (SELECT max(loaded) FROM u v WHERE v.symbol = u.symbol) GROUP BY 1, 2")
def newest_cache(spark, sf_dir):
    b = bars(spark, sf_dir)
    k = F.substring("symbol", 2, 20).cast("long")
    caches = {"etfs": b.where(k % 3 != 0).withColumn("loaded", F.lit(1)), "stocks": b.where(k % 2 == 0).withColumn("loaded", F.lit(2))}
    return tb.newest(caches).groupBy("symbol", "source").agg(F.count("*").alias("n"))


@query(chain(BARS, RET) + ", a AS MATERIALIZED (SELECT ret FROM rets WHERE abs(ret) <= 1), b AS MATERIALIZED (SELECT avg(ret) AS m, stddev_samp(ret) AS s FROM a), c AS (SELECT (SELECT count(*) FROM bars) AS n, (SELECT count(*) FROM a, b WHERE abs(ret - m) <= 2.5 * s) AS k) SELECT CAST(n AS BIGINT) AS n_before, CAST(k AS BIGINT) AS n_after, CAST(n - k AS BIGINT) AS n_removed FROM c")
def extreme_return_counts(spark, sf_dir):
    return tb.filter_counts(ft.returns(bars(spark, sf_dir)), ["ret"], z=2.5)


@query(chain(BARS) + " SELECT symbol, date, CAST(open AS FLOAT) AS open, CAST(close AS FLOAT) AS close FROM bars")
def downcast_bars(spark, sf_dir):
    return tb.kept(tb.downcast(bars(spark, sf_dir)), ["symbol", "date", "open", "high", "close"], ["high"])


def _profile(c: str) -> str:
    return f"SELECT '{c}' AS feature, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS null_share, min(CAST({c} AS DOUBLE)) AS least, max(CAST({c} AS DOUBLE)) AS greatest FROM x"


@query(chain(*_TOUCH, f"x AS (SELECT hit, h_used, ret, 1.0 AS same FROM (SELECT *, CASE WHEN h_used > 5 THEN ln(close) - ln({lagged('close')}) END AS ret FROM pr))") + ", p AS (" + " UNION ALL ".join(map(_profile, ("hit", "h_used", "same"))) + ") SELECT feature, round(null_share, 6) + 0.0 AS null_share, round(least, 5) + 0.0 AS least, round(greatest, 5) + 0.0 AS greatest, null_share > 0.5 OR least = greatest OR greatest(abs(least), abs(greatest)) > 1e6 AS anomaly FROM p")
def label_profile(spark, sf_dir):
    t = _labels(spark, sf_dir).withColumn("same", F.lit(1.0))
    p = tb.column_profile(t, ["hit", "h_used", "same"]).withColumn("null_share", F.round("null_share", 6) + 0.0)
    return shown(p, ["feature", "null_share", "anomaly"], ["least", "greatest"])


_REG = "reg(feature, category) AS (VALUES ('ret', 'returns'), ('close', 'price'), ('gone', 'price'))"


@query(chain(BARS, RET, _REG) + ", s AS (SELECT 'ret' AS feature, avg(CASE WHEN ret IS NULL THEN 1.0 ELSE 0 END) AS null_share FROM rets UNION ALL SELECT 'close', 0.0 UNION ALL SELECT 'volume', 0.0) SELECT coalesce(r.feature, s.feature) AS feature, category, round(null_share, 6) + 0.0 AS null_share, CASE WHEN null_share IS NULL THEN 'missing' WHEN category IS NULL THEN 'unregistered' WHEN null_share > 0.3 THEN 'sparse' ELSE 'valid' END AS state FROM reg r FULL JOIN s ON r.feature = s.feature")
def registry_report(spark, sf_dir):
    reg = spark.createDataFrame([("ret", "returns"), ("close", "price"), ("gone", "price")], "feature string, category string")
    return shown(tb.registry_report(ft.returns(bars(spark, sf_dir)).select(*KEYS, "ret", "close", "volume"), reg), ["feature", "category", "state"], ["null_share"], 6)


@query(chain(BARS, RET, _REG) + " SELECT category, CAST(count(*) FILTER (WHERE feature <> 'gone') AS BIGINT) AS n_present, CAST(count(*) FILTER (WHERE feature = 'gone') AS BIGINT) AS n_missing FROM reg WHERE (SELECT count(*) FROM rets) > 0 GROUP BY 1")
def candidate_coverage(spark, sf_dir):
    reg = spark.createDataFrame([("ret", "returns"), ("close", "price"), ("gone", "price")], "feature string, category string")
    return tb.coverage_by_category(tb.registry_report(ft.returns(bars(spark, sf_dir)).select(*KEYS, "ret", "close", "volume"), reg))


_COV = ", u AS (SELECT symbol, 'ret' AS feature, ret AS v FROM rets UNION ALL SELECT symbol, 'close', close FROM rets), cv AS (SELECT symbol, feature, 100 * (1 - count(v) / count(*)) AS p FROM u GROUP BY 1, 2)"


@query(chain(BARS, RET) + _COV + " SELECT feature, round(avg(p), 6) + 0.0 AS mean_null, round(max(p), 6) + 0.0 AS max_null, round(min(p), 6) + 0.0 AS min_null, CAST(count(*) AS BIGINT) AS n_symbols FROM cv GROUP BY 1")
def coverage_summary(spark, sf_dir):
    c = tb.coverage_summary(ql.coverage(ft.returns(bars(spark, sf_dir)), ["ret", "close"]))
    return shown(c, ["feature", "n_symbols"], ["mean_null", "max_null", "min_null"], 6)


@query(chain(BARS, RET) + ", d AS (SELECT date, count(close) AS n, avg((CASE WHEN ret IS NULL THEN 0.0 ELSE 1.0 END + CASE WHEN close IS NULL THEN 0.0 ELSE 1.0 END) / 2) AS a FROM rets GROUP BY 1) SELECT max(date) AS newest, CAST(date_diff('day', max(date), DATE '2005-01-01') AS INTEGER) AS days_ago, round(arg_max(a, date), 6) + 0.0 AS available FROM d WHERE n > 3")
def freshness(spark, sf_dir):
    return shown(tb.freshness(ft.returns(bars(spark, sf_dir)), ["ret", "close"], "2005-01-01", 3), ["newest", "days_ago"], ["available"], 6)


@query(chain(*_TOUCH) + " SELECT CAST(count(*) AS BIGINT) AS n_rows, 1 AS n_all_null, 1 AS n_constant, round(least(avg(CASE WHEN hit = 1 THEN 1.0 ELSE 0.0 END), 1 - avg(CASE WHEN hit = 1 THEN 1.0 ELSE 0.0 END)), 6) + 0.0 AS minority_share FROM pr")
def matrix_checks(spark, sf_dir):
    t = _labels(spark, sf_dir).withColumns({"none": F.lit(None).cast("double"), "one": F.lit(1.0)})
    return shown(tb.matrix_checks(t, ["close", "none", "one", "volume"], "hit"), ["n_rows", "n_all_null", "n_constant"], ["minority_share"], 6)


@query(chain(*_TOUCH, RET) + ", j AS (SELECT r.symbol, r.date, r.ret, pr.hit, count(*) OVER (PARTITION BY r.symbol) AS n FROM rets r JOIN pr ON r.symbol = pr.symbol AND r.date = pr.date), k AS (SELECT *, dense_rank() OVER (ORDER BY n DESC, symbol) AS q FROM j WHERE n >= 30) SELECT symbol, date, round(ret, 7) + 0.0 AS ret, CAST(hit AS INTEGER) AS hit FROM k WHERE q <= 10")
def tuning_data(spark, sf_dir):
    f = ft.returns(bars(spark, sf_dir)).select(*KEYS, "ret")
    return shown(ql.top_symbols(tb.features_with_labels(f, _labels(spark, sf_dir).select(*KEYS, "hit")), 10, 30), [*KEYS, "hit"], ["ret"], 7)


@query(chain(*_TOUCH) + " SELECT p.symbol, p.date AS signal_date, CAST(date_trunc('week', p.date) AS DATE) AS week_monday, p.t_hit AS actual_exit_date, CAST(p.h_used AS BIGINT) AS holding_days, round(b.volume % 97 / 97, 6) + 0.0 AS probability, round(CASE WHEN price_hit > 0 THEN ln(price_hit / p.close) END, 6) + 0.0 AS actual_return FROM pr p JOIN bars b USING (symbol, date)")
def signal_table(spark, sf_dir):
    p = bars(spark, sf_dir).select(*KEYS, ((F.col("volume") % 97) / 97).alias("prob"))
    t = tb.signal_table(p, _labels(spark, sf_dir).select(*KEYS, "t_hit", "price_hit", "h_used", "ret_from_entry"))
    return shown(t, ["symbol", "signal_date", "week_monday", "actual_exit_date", F.col("holding_days").cast("long").alias("holding_days")], ["probability", "actual_return"], 6)


@query(chain(BARS, RET) + " SELECT b.symbol, b.date, round(b.close, 7) + 0.0 AS close, round(r.close, 7) + 0.0 AS close_right, round(r.ret, 7) + 0.0 AS ret FROM bars b LEFT JOIN (SELECT * FROM rets WHERE ret > 0) r USING (symbol, date)")
def suffixed_join(spark, sf_dir):
    b = bars(spark, sf_dir)
    t = tb.suffixed_join(b.select(*KEYS, "close"), ft.returns(b).where("ret > 0").select(*KEYS, "close", "ret"), KEYS, "_right").withColumn("ret", F.round("ret", 7) + 0.0)
    return shown(t, [*KEYS, "ret"], ["close", "close_right"], 7)


@query(chain(*_P, MACRO) + ", w AS (SELECT CAST(date_trunc('week', date) AS DATE) AS week, arg_max(flow / 1e6, date) AS v FROM macro GROUP BY 1) SELECT symbol, s.week, CASE WHEN v < 0.5 THEN 'low' WHEN v < 1.0 THEN 'normal' WHEN v IS NOT NULL THEN 'high' END AS regime FROM signals s LEFT JOIN w ON s.week = w.week")
def regime_of_week(spark, sf_dir):
    return tb.regime_of_week(signals(spark, sf_dir), _flow(spark, sf_dir), "v", [0.5, 1.0], ["low", "normal", "high"]).select("symbol", "week", "regime")


@query("SELECT user_id, CAST(ts AS DATE) AS date, arg_min(event_id, event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2")
def deduplicated(spark, sf_dir):
    return tb.deduplicated(table(spark, sf_dir, "events").withColumn("date", F.to_date("ts")), ["user_id", "date"], "event_id").select("user_id", "date", "event_id", "value")


@query(chain(BARS, SECTORS) + " SELECT sector, md5(string_agg(symbol, ',' ORDER BY symbol)) AS signature, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT sector, symbol FROM bars JOIN sectors USING (symbol)) GROUP BY 1")
def universe_signatures(spark, sf_dir):
    return tb.signature(bars(spark, sf_dir).join(sectors(spark, sf_dir), "symbol"), ["sector"], "symbol")


@query("SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_settings(spark, sf_dir):
    return tb.settings(table(spark, sf_dir, "events").select("event_id", "props"), "props")


@query(chain(*_TOUCH, SECTORS) + " SELECT coalesce(sector, 'Unknown') AS sector, CAST(count(*) AS BIGINT) AS n FROM pr LEFT JOIN (SELECT * FROM sectors WHERE sector <> 'ASIA') USING (symbol) GROUP BY 1")
def labels_with_sector(spark, sf_dir):
    return tb.with_sector(_labels(spark, sf_dir), sectors(spark, sf_dir).where("sector <> 'ASIA'")).groupBy("sector").agg(F.count("*").alias("n"))


@query(chain(BARS, MACRO) + ", m AS (SELECT date, flow FROM macro WHERE date >= DATE '1998-01-01' AND dayofmonth(date) = 1) SELECT b.symbol, b.date, round(coalesce(m.flow, (SELECT arg_min(flow, date) FROM m)), 3) + 0.0 AS flow FROM bars b ASOF LEFT JOIN m ON b.date >= m.date")
def factor_alignment(spark, sf_dir):
    m = macro(spark, sf_dir).where("date >= date '1998-01-01' and dayofmonth(date) = 1")
    return shown(tb.filled_both_ways(bars(spark, sf_dir).select(*KEYS), m, "flow"), KEYS, ["flow"], 3)


# jobs around a model


@query(chain(*_TOUCH) + " SELECT CAST(count(*) FILTER (WHERE hit = 1) AS BIGINT) AS n_positive, CAST(count(*) FILTER (WHERE hit <> 1) AS BIGINT) AS n_negative, round(count(*) FILTER (WHERE hit <> 1) / count(*) FILTER (WHERE hit = 1), 6) + 0.0 AS ratio FROM pr")
def class_ratio(spark, sf_dir):
    return shown(tr.class_ratio(_labels(spark, sf_dir), "hit"), ["n_positive", "n_negative"], ["ratio"], 6)


_SW = ", x AS (SELECT symbol, date, ln(1 + greatest(close * volume, 0.0)) AS liq, 1 / greatest(atr / close, 0.005) AS inv, greatest(atr / close, 0.005) AS atp FROM pr), y AS (SELECT symbol, date, greatest(liq / (avg(liq) OVER () + 1e-10), 0.01) AS liq, greatest(inv / avg(inv) OVER (), 0.01) AS inv, greatest(atp / avg(atp) OVER (), 0.01) AS atp FROM x)"


@query(chain(*_TOUCH) + _SW + " SELECT symbol, date, round(liq / sum(liq) OVER () * count(*) OVER (), 6) + 0.0 AS w_liquidity, round(inv / sum(inv) OVER () * count(*) OVER (), 6) + 0.0 AS w_inverse, round(atp / sum(atp) OVER () * count(*) OVER (), 6) + 0.0 AS w_atr FROM y")
def sample_weights(spark, sf_dir):
    t = _labels(spark, sf_dir).select(*KEYS, (F.col("close") * F.col("volume")).alias("dollar"), (F.col("atr") / F.col("close")).alias("pct"))
    for scheme, x, name in (("liquidity", "dollar", "w_liquidity"), ("inverse_volatility", "pct", "w_inverse"), ("atr_percent", "pct", "w_atr")):
        t = tr.sample_weights(t, scheme, x).withColumnRenamed("weight", name)
    return shown(t, KEYS, ["w_liquidity", "w_inverse", "w_atr"], 6)


_SUM = "SELECT fold, role, CAST(count(*) AS BIGINT) AS n, min(t0) AS first_entry, max(t0) AS last_entry, max(t1) AS last_exit FROM f GROUP BY 1, 2"
_NUM = [*_SPANS, "nb AS (SELECT *, row_number() OVER (ORDER BY t0, symbol) - 1 AS i, count(*) OVER () AS c FROM sp)"]


@query(chain(*_NUM, "bd AS (SELECT DISTINCT CAST(k AS INTEGER) AS fold, c - (k + 1) * (c // 6) AS a, c // 6 AS sz FROM nb, range(5) r(k) WHERE c - (k + 1) * (c // 6) >= 100)", "st AS (SELECT fold, a, sz, t0 AS starts FROM bd JOIN nb ON nb.i = bd.a)", "f AS (SELECT fold, CASE WHEN i >= a THEN 'test' ELSE 'train' END AS role, t0, t1 FROM nb, st WHERE i < a + sz AND (i >= a OR t1 <= starts))") + " " + _SUM)
def row_folds(spark, sf_dir):
    return ev.fold_summary(tr.row_folds(_entries(spark, sf_dir), 5, 100))


def _gap_sql(train: int | None) -> str:
    start = f"greatest(0, a - 30 - {train})" if train else "0"
    return chain(*_NUM, f"bd AS (SELECT DISTINCT CAST(k AS INTEGER) AS fold, c - (4 - k) * 500 AS a FROM nb, range(4) r(k))", f"f AS (SELECT fold, CASE WHEN i >= a THEN 'test' ELSE 'train' END AS role, t0, t1 FROM nb, bd WHERE a - 30 - {start} >= 50 AND ((i >= a AND i < a + 500) OR (i >= {start} AND i < a - 30)))") + " " + _SUM


@query(_gap_sql(None))
def expanding_folds(spark, sf_dir):
    return ev.fold_summary(tr.gap_folds(_entries(spark, sf_dir), 4, 500, 20, 10, 50))


@query(_gap_sql(800))
def rolling_folds(spark, sf_dir):
    return ev.fold_summary(tr.gap_folds(_entries(spark, sf_dir), 4, 500, 20, 10, 50, train=800))


@query(chain(*_SPANS, "dn AS (SELECT t0, row_number() OVER (ORDER BY t0) - 1 AS k, count(*) OVER () AS c FROM (SELECT DISTINCT t0 FROM sp))", "bd AS (SELECT DISTINCT j, c - (j + 1) * ((c - 50) // 6) AS a, (c - 50) // 6 AS sz FROM dn, range(5) r(j))", "g AS (SELECT j, CASE WHEN k >= a THEN 'test' ELSE 'train' END AS role, t0, t1 FROM sp JOIN dn USING (t0), bd WHERE a - 20 - 1 >= 50 AND ((k >= a AND k < a + sz) OR k < a - 20))", "ok AS (SELECT j, row_number() OVER (ORDER BY j DESC) - 1 AS fold FROM (SELECT j FROM g GROUP BY 1 HAVING count(*) FILTER (WHERE role = 'train') >= 1000 AND count(*) FILTER (WHERE role = 'test') > 0))", "f AS (SELECT CAST(fold AS INTEGER) AS fold, role, t0, t1 FROM g JOIN ok USING (j))") + " " + _SUM)
def date_folds(spark, sf_dir):
    return ev.fold_summary(tr.date_folds(_entries(spark, sf_dir), 5, 20, 1000))


@query(chain(*_NUM, "bd AS (SELECT DISTINCT CAST(k AS INTEGER) AS fold, c - (4 - k) * 500 AS a FROM nb, range(4) r(k))", "t AS (SELECT fold, t0, symbol FROM nb, bd WHERE a - 30 >= 50 AND i < a - 30)", "p AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY fold ORDER BY t0, symbol) <= floor(count(*) OVER (PARTITION BY fold) * 0.85) THEN 'fit' ELSE 'stop' END AS part FROM t)") + " SELECT fold, part, CAST(count(*) AS BIGINT) AS n, max(t0) AS last_entry FROM p GROUP BY 1, 2")
def early_stop_split(spark, sf_dir):
    t = tr.early_stop_split(tr.gap_folds(_entries(spark, sf_dir), 4, 500, 20, 10, 50), features=["hit"])
    return t.groupBy("fold", "part").agg(F.count("*").alias("n"), F.max("entry").alias("last_entry"))


@query(chain(SCORED) + ", r AS (SELECT lang, y, p, doc_id, rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2 AS k, greatest(1, floor(count(*) OVER (PARTITION BY lang) * 0.1)) AS m, row_number() OVER (PARTITION BY lang ORDER BY p DESC, doc_id) AS u, row_number() OVER (PARTITION BY lang ORDER BY p, doc_id) AS d FROM scored) SELECT lang, round(CASE WHEN sum(y) * (count(*) - sum(y)) > 0 THEN (sum(CASE WHEN y = 1 THEN k ELSE 0 END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) ELSE 0.5 END, 6) + 0.0 AS auc, round(avg((p - y) * (p - y)), 6) + 0.0 AS brier, round(avg(y) FILTER (WHERE u <= m), 6) + 0.0 AS top, round(avg(y) FILTER (WHERE d <= m), 6) + 0.0 AS bottom FROM r GROUP BY 1")
def fold_metrics(spark, sf_dir):
    return shown(tr.fold_metrics(scored(spark, sf_dir), ["lang"], "doc_id"), ["lang"], ["auc", "brier", "top", "bottom"], 6)


_GAIN = "gn AS (SELECT 'F' || l_suppkey AS feature, year(l_shipdate) AS fold, sum(l_quantity) AS gain FROM lineitem GROUP BY 1, 2)"


def _gains(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("F"), "l_suppkey").alias("feature"), F.year("l_shipdate").alias("fold")).agg(F.sum("l_quantity").alias("gain"))


@query(f"WITH {_GAIN} SELECT feature, round(avg(gain), 5) + 0.0 AS mean, round(stddev_samp(gain), 5) + 0.0 AS dev, round(count(*) FILTER (WHERE gain > 0) / (SELECT count(DISTINCT fold) FROM gn), 5) + 0.0 AS share FROM gn GROUP BY 1")
def importance_summary(spark, sf_dir):
    return shown(tr.importance_summary(_gains(spark, sf_dir)), ["feature"], ["mean", "dev", "share"])


_DRIFT = "bs AS (SELECT feature, sum(gain) AS g FROM gn WHERE fold < 1998 GROUP BY 1), nw AS (SELECT feature, sum(gain) AS h FROM gn WHERE fold >= 1998 GROUP BY 1), df AS (SELECT corr(g, h) AS corr, count(*) AS n FROM bs JOIN nw USING (feature))"


def _drift(spark, sf_dir):
    g = _gains(spark, sf_dir)
    return tr.importance_drift(*(g.where(w).groupBy("feature").agg(F.sum("gain").alias("gain")) for w in ("fold < 1998", "fold >= 1998")))


@query(f"WITH {_GAIN}, {_DRIFT} SELECT round(corr, 6) + 0.0 AS corr, CAST(n AS BIGINT) AS n FROM df")
def importance_drift(spark, sf_dir):
    return shown(_drift(spark, sf_dir), ["n"], ["corr"], 6)


@query(chain(BARS, _GAIN, _DRIFT, _EVS) + ", au AS (SELECT date, avg(p) AS auc FROM es GROUP BY 1), l5 AS (SELECT * FROM au ORDER BY date DESC LIMIT 5), wo AS (SELECT max(auc) AS v, arg_max(auc, date) AS cur, count(*) AS n FROM l5), pm AS (SELECT abs(avg(p) - 0.5) / 0.15 AS v, avg(CASE WHEN p > 0.7 THEN 1.0 ELSE 0.0 END) AS s FROM es) SELECT 'age' AS \"check\", 20.0 AS value, 'warning' AS level UNION ALL SELECT 'auc', round(cur, 6) + 0.0, CASE WHEN n >= 5 AND v < 0.55 THEN 'critical' WHEN (n >= 5 AND v < 0.6) OR cur < 0.6 THEN 'warning' ELSE 'ok' END FROM wo UNION ALL SELECT 'importance', round(corr, 6) + 0.0, CASE WHEN corr < 0.8 THEN 'warning' ELSE 'ok' END FROM df WHERE n > 5 UNION ALL SELECT 'shift', round(v, 6) + 0.0, CASE WHEN v > 2 THEN 'warning' ELSE 'ok' END FROM pm UNION ALL SELECT 'conviction', round(s, 6) + 0.0, CASE WHEN s > 0.3 THEN 'warning' ELSE 'ok' END FROM pm")
def model_health(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("date"), ((F.col("event_id") % 101) / 101).alias("probability"))
    daily = e.groupBy("date").agg(F.avg("probability").alias("auc"))
    return shown(tr.health(daily, _drift(spark, sf_dir), e, "2004-12-12", "2005-01-01"), ["check", "level"], ["value"], 6)


@query(None)
def isotonic_calibration(spark, sf_dir):
    s = scored(spark, sf_dir)
    return shown(tr.calibrated(s, s), ["doc_id", "lang"], ["calibrated"])


@query(None)
def platt_calibration(spark, sf_dir):
    s = scored(spark, sf_dir)
    return shown(tr.calibrated(s, s, "platt"), ["doc_id", "lang"], ["calibrated"])


@query(chain(*_P, MACRO) + ", w AS (SELECT CAST(date_trunc('week', date) AS DATE) AS week, arg_max(flow / 1e6, date) AS v FROM macro GROUP BY 1), r AS (SELECT symbol, s.week, probability, CASE WHEN v < 0.5 THEN 'low' WHEN v < 1.0 THEN 'normal' WHEN v IS NOT NULL THEN 'high' END AS regime FROM signals s LEFT JOIN w ON s.week = w.week), x AS (SELECT *, CASE WHEN probability >= 0.5 THEN least(greatest(least(greatest((probability - 0.5) / 0.5, 0.0), 1.0) * 0.1 * CASE regime WHEN 'low' THEN 1.2 WHEN 'high' THEN 0.8 ELSE 1.0 END, 0.0), 0.1) ELSE 0.0 END AS w FROM r) SELECT symbol, week, round(CASE WHEN w >= 0.01 THEN w ELSE 0.0 END, 6) + 0.0 AS weight FROM x")
def threshold_weights(spark, sf_dir):
    s = tb.regime_of_week(signals(spark, sf_dir), _flow(spark, sf_dir), "v", [0.5, 1.0], ["low", "normal", "high"])
    return shown(tr.threshold_weights(s, {"low": 1.2, "normal": 1.0, "high": 0.8}), ["symbol", "week"], ["weight"], 6)


@query(chain(*_P, _EQ) + ", nk AS (SELECT week, row_number() OVER (ORDER BY week) AS n FROM (SELECT DISTINCT week FROM eq)), a AS (SELECT eq.symbol, eq.week, weight, n FROM eq JOIN nk USING (week)) SELECT a.symbol, a.week, round(CASE WHEN b.weight IS NOT NULL THEN 0.7 * a.weight + 0.3 * b.weight ELSE a.weight END, 6) + 0.0 AS weight FROM a LEFT JOIN a b ON a.symbol = b.symbol AND a.n = b.n + 1")
def turnover_blend(spark, sf_dir):
    return shown(tr.blended(pf.equal_top(signals(spark, sf_dir)), 0.3), ["symbol", "week"], ["weight"], 6)


@query(chain(*_P) + ", w AS (SELECT week, count(*) FILTER (WHERE probability >= 0.7) AS k FROM signals GROUP BY 1) SELECT round(avg(k), 6) + 0.0 AS per_week, CAST(min(k) AS BIGINT) AS least, CAST(max(k) AS BIGINT) AS most, CAST(count(*) AS BIGINT) AS n_weeks FROM w")
def expected_trades(spark, sf_dir):
    return shown(tr.expected_trades(signals(spark, sf_dir), 0.7), ["least", "most", "n_weeks"], ["per_week"], 6)


@query(chain(*_P) + ", x AS (SELECT symbol, week, least(greatest(probability - 0.4, 0.0), 0.1) AS w FROM signals) SELECT symbol, week, round(w / nullif(sum(w) OVER (PARTITION BY week), 0), 6) + 0.0 AS weight FROM x WHERE w > 0")
def user_sizing(spark, sf_dir):
    rule = F.least(F.greatest(F.col("probability") - 0.4, F.lit(0.0)), F.lit(0.1))
    return shown(pf.by_rule(signals(spark, sf_dir), rule), ["symbol", "week"], ["weight"], 6)


@query(chain(BARS, ATR) + ", p AS (SELECT symbol, date, (volume % 97) / 97 AS probability, ((close + 3.0 * atr) / close - 1) / (1 - (close - 1.5 * atr) / close) AS rr FROM entries WHERE atr > 0), q AS (SELECT *, round(probability - 1 / (1 + rr), 9) AS edge FROM p) SELECT symbol, date, round(edge, 6) + 0.0 AS edge FROM q WHERE edge >= 0.05 ORDER BY edge DESC, symbol, date LIMIT 25")
def candidate_screen(spark, sf_dir):
    c = sl.price_levels(lb.with_atr(bars(spark, sf_dir)).where("atr > 0"), 3.0, 1.5).withColumn("probability", (F.col("volume") % 97) / 97)
    c = c.withColumn("break_even", F.col("probability") - F.round(F.col("probability") - F.col("break_even"), 9))
    return shown(tr.screened(c.withColumn("reward_risk", F.round("reward_risk", 9)), 0.05, 1.5, 25), KEYS, ["edge"], 6)


@query(f"SELECT o_orderkey, round(least(greatest((w - avg(w) OVER ()) / stddev_samp(w) OVER (), -3.0), 3.0), 6) + 0.0 AS o_totalprice_wz FROM (SELECT o_orderkey, least(greatest(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.01) FROM orders)), (SELECT quantile_cont(o_totalprice, 0.99) FROM orders)) AS w FROM orders)")
def standard_chain(spark, sf_dir):
    return shown(tr.standard_chain(table(spark, sf_dir, "orders"), ["o_totalprice"]), ["o_orderkey"], ["o_totalprice_wz"], 6)


@query(f"WITH c AS (SELECT quantile_cont(o_totalprice, 0.01) AS lo, quantile_cont(o_totalprice, 0.99) AS hi FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'), s AS (SELECT lo, hi, avg(least(greatest(o_totalprice, lo), hi)) AS m, stddev_samp(least(greatest(o_totalprice, lo), hi)) AS d FROM orders, c WHERE o_orderdate < TIMESTAMP '1999-01-01' GROUP BY 1, 2) SELECT o_orderkey, round(least(greatest((least(greatest(o_totalprice, lo), hi) - m) / d, -3.0), 3.0), 6) + 0.0 AS o_totalprice_wz FROM orders, s WHERE o_orderdate >= TIMESTAMP '1999-01-01'")
def stored_chain(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    state = tr.fitted_state(o.where("o_orderdate < timestamp '1999-01-01'"), ["o_totalprice"])
    return shown(tr.apply_state(o.where("o_orderdate >= timestamp '1999-01-01'"), state, ["o_totalprice"]), ["o_orderkey"], ["o_totalprice_wz"], 6)


# selection


_SCORES = "sc AS (SELECT year(o_orderdate) AS fold, avg(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) / 1e5 AS b, avg(CASE WHEN o_orderpriority = '2-HIGH' THEN o_totalprice END) / 1e5 AS c FROM orders GROUP BY 1), gd AS (SELECT c - b AS g FROM sc WHERE b IS NOT NULL AND c IS NOT NULL)"


def _scores(spark, sf_dir, priority):
    return table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == priority).groupBy(F.year("o_orderdate").alias("fold")).agg((F.avg("o_totalprice") / 1e5).alias("score"))


@query(f"WITH {_SCORES} SELECT round(avg(g), 6) + 0.0 AS mean_gain, round(quantile_cont(g, 0.5), 6) + 0.0 AS median_gain, round(avg(CASE WHEN g >= 0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS share_up, round(min(g), 6) + 0.0 AS worst, avg(g) > 0 AND quantile_cont(g, 0.5) >= 0 AND avg(CASE WHEN g >= 0 THEN 1.0 ELSE 0.0 END) >= 0.6 AS accepted FROM gd")
def loose_acceptance(spark, sf_dir):
    return shown(sl.accepted(_scores(spark, sf_dir, "1-URGENT"), _scores(spark, sf_dir, "2-HIGH")), ["accepted"], ["mean_gain", "median_gain", "share_up", "worst"], 6)


@query(f"WITH {_SCORES} SELECT round(avg(CASE WHEN g >= 0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS share_up, round(greatest(-min(g), 0.0), 6) + 0.0 AS worst_fall, avg(CASE WHEN g >= 0 THEN 1.0 ELSE 0.0 END) >= 0.6 AS improves, greatest(-min(g), 0.0) > 0.01 AS harms FROM gd")
def fold_improvement(spark, sf_dir):
    return shown(tr.improvement(_scores(spark, sf_dir, "1-URGENT"), _scores(spark, sf_dir, "2-HIGH")), ["improves", "harms"], ["share_up", "worst_fall"], 6)


@query(f"WITH {_GAIN} SELECT feature, round(avg(gain), 5) + 0.0 AS mean, round(stddev_pop(gain), 5) + 0.0 AS dev, round(avg(gain) - 0.5 * stddev_pop(gain), 5) + 0.0 AS penalised FROM gn GROUP BY 1")
def penalised_scores(spark, sf_dir):
    return shown(sl.fold_score(_gains(spark, sf_dir).withColumnRenamed("gain", "score"), ["feature"], 0.5), ["feature"], ["mean", "dev", "penalised"])


_IMP = "im AS (SELECT 'M' || (l_suppkey % 25) AS feature, sum(power(l_quantity, l_suppkey % 25 / 8)) AS gain FROM lineitem GROUP BY 1)"


def _importance(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("M"), (F.col("l_suppkey") % 25).cast("string")).alias("feature")).agg(F.sum(F.pow("l_quantity", (F.col("l_suppkey") % 25) / 8)).alias("gain"))


@query(f"WITH {_IMP}, s AS (SELECT feature, gain / sum(gain) OVER () AS share, row_number() OVER (ORDER BY gain DESC, feature) AS rank FROM im) SELECT feature, CAST(rank AS INTEGER) AS rank, CASE WHEN share >= 0.05 THEN 'core' WHEN share >= 0.01 THEN 'borderline' ELSE 'low' END AS tier, round(share, 7) + 0.0 AS share FROM s")
def feature_tiers(spark, sf_dir):
    return shown(sl.tiers(_importance(spark, sf_dir)), ["feature", "rank", "tier"], ["share"], 7)


_PAIRS = "pr0 AS (SELECT x.feature AS a, y.feature AS b, sqrt(x.gain * y.gain) / 1e3 * CASE WHEN (contains(x.feature, 'M1') AND contains(y.feature, 'M2')) OR (contains(x.feature, 'M2') AND contains(y.feature, 'M1')) THEN 1.5 ELSE 1.0 END AS priority FROM im x JOIN im y ON x.feature < y.feature)"


def _pairs(spark, sf_dir):
    return sl.candidate_pairs(_importance(spark, sf_dir), [("M1", "M2")]).withColumn("priority", F.col("priority") / 1e3)


@query(f"WITH {_IMP}, {_PAIRS} SELECT a, b, round(priority, 5) + 0.0 AS priority FROM pr0")
def candidate_pairs(spark, sf_dir):
    return shown(_pairs(spark, sf_dir), ["a", "b"], ["priority"])


@query(f"WITH {_IMP}, {_PAIRS}, k AS (SELECT * FROM pr0 WHERE priority >= 1.0 AND a <> 'M3' AND b <> 'M3') SELECT a, b FROM k WHERE (contains(a, 'M1') AND contains(b, 'M2')) OR priority >= (SELECT quantile_cont(priority, 0.9) FROM k)")
def strong_pairs(spark, sf_dir):
    members = [f"M{k}" for k in range(25) if k != 3]
    return tr.strong_pairs(_pairs(spark, sf_dir), 1.0, members, F.col("a").contains("M1") & F.col("b").contains("M2")).select("a", "b")


@query("WITH m AS (SELECT quantile_cont(l_quantity, 0.5) AS q, quantile_cont(l_discount, 0.5) AS d FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity * l_discount, 6) + 0.0 AS l_quantity_x_l_discount, CAST(l_quantity > q AND l_discount > d AS DOUBLE) AS l_quantity_and_l_discount, round(CASE WHEN abs(l_discount) > 1e-12 THEN least(greatest(l_quantity / l_discount, -100.0), 100.0) END, 6) + 0.0 AS l_quantity_by_l_discount FROM lineitem, m")
def interaction_columns(spark, sf_dir):
    t = sl.interactions(table(spark, sf_dir, "lineitem"), [("l_quantity", "l_discount")])
    return shown(t, ["l_orderkey", "l_linenumber", "l_partkey"], ["l_quantity_x_l_discount", "l_quantity_and_l_discount", "l_quantity_by_l_discount"], 6)


@query("WITH s AS (SELECT DISTINCT l_returnflag || l_linestatus AS model, l_partkey AS feature FROM lineitem), g AS (SELECT feature, count(*) AS n FROM s GROUP BY 1) SELECT feature, CAST(n AS BIGINT) AS n_models, CASE WHEN n = (SELECT count(DISTINCT model) FROM s) THEN 'core' WHEN n = 1 THEN 'head' ELSE 'shared' END AS role FROM g")
def core_and_heads(spark, sf_dir):
    return sl.core_and_heads(table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("model"), F.col("l_partkey").alias("feature")))


@query(chain(BARS, RET) + ", x AS (SELECT ret, close, 1.0 AS same, CASE WHEN volume > 1e9 THEN volume END AS rare FROM rets), s AS (SELECT 'ret' AS feature, var_samp(ret) AS v, avg(CASE WHEN ret IS NULL THEN 1.0 ELSE 0 END) AS n FROM x UNION ALL SELECT 'same', var_samp(same), 0.0 FROM x UNION ALL SELECT 'rare', var_samp(rare), avg(CASE WHEN rare IS NULL THEN 1.0 ELSE 0 END) FROM x) SELECT feature, round(v, 6) + 0.0 AS variance, round(n, 6) + 0.0 AS null_share, coalesce(v > 1e-12 AND n <= 0.3, false) AS kept FROM s")
def feature_filters(spark, sf_dir):
    t = ft.returns(bars(spark, sf_dir)).select("ret", F.lit(1.0).alias("same"), F.when(F.col("volume") > 1e9, F.col("volume")).alias("rare"))
    return shown(ql.feature_stats(t, ["ret", "same", "rare"]), ["feature", "kept"], ["variance", "null_share"], 6)


@query(chain(BARS, RET, stage("e", "rets", {"l5": lagged("close", 5), "l9": lagged("close", 9)})) + " SELECT symbol, date FROM e WHERE (CASE WHEN ret IS NULL THEN 0 ELSE 1 END) + (CASE WHEN l5 IS NULL THEN 0 ELSE 1 END) + (CASE WHEN l9 IS NULL THEN 0 ELSE 1 END) >= 2")
def enough_features(spark, sf_dir):
    t = ft.lags(ft.returns(bars(spark, sf_dir)), ["close"], [5, 9])
    return ql.enough_features(t, ["ret", "close_lag5d", "close_lag9d"], 0.7).select(*KEYS)


@query("WITH c AS (SELECT corr(l_extendedprice, l_quantity * 2 + l_tax) AS a, corr(l_quantity, l_quantity * 2 + l_tax) AS b FROM lineitem) SELECT 'l_quantity' AS feature UNION ALL SELECT 'l_tax' UNION ALL SELECT 'twice' FROM c WHERE abs(b) <= 0.95")
def uncorrelated_features(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").withColumn("twice", F.col("l_quantity") * 2 + F.col("l_tax"))
    names = ev.drop_correlated(t, ["l_quantity", "l_tax", "twice"])
    return t.sparkSession.createDataFrame([(n,) for n in names], "feature string")


@query("WITH t AS (SELECT 'C' || c_custkey AS feature, (abs(c_acctbal) % 1000) / 1000 AS p FROM customer), k AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, feature) AS r, row_number() OVER (ORDER BY p, feature) AS o FROM t), q AS (SELECT feature, least(min(r) OVER (ORDER BY o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) AS q FROM k) SELECT feature, round(q, 6) + 0.0 AS q, q <= 0.05 AS found FROM q")
def discovery_rate(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("feature"), ((F.abs("c_acctbal") % 1000) / 1000).alias("p"))
    return shown(ev.benjamini_hochberg(c), ["feature", "found"], ["q"], 6)


# labels


@query(chain(BARS, ATR, _NEXT) + ", v AS (SELECT * FROM nx WHERE close > 0 AND atr > 0 AND len(nx) > 0), q AS (SELECT m, coalesce(nullif(coalesce(list_position(list_transform(nx, lambda b: b.h >= close + m * atr), true), 0), 0), 21) AS u, coalesce(nullif(coalesce(list_position(list_transform(nx, lambda b: b.l <= close - 1.5 * atr), true), 0), 0), 21) AS d FROM v, (VALUES (1.0), (2.0), (3.0)) g(m)) SELECT CAST(m AS VARCHAR) AS multiple, round(avg(CASE WHEN u <= 20 AND u <= d THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS rate FROM q GROUP BY 1")
def target_first_rates(spark, sf_dir):
    return shown(lb.target_first(lb.with_atr(bars(spark, sf_dir)), [1.0, 2.0, 3.0], 1.5, _H), ["multiple"], ["rate"], 6)


_EXC = f"xc AS (SELECT symbol, date, (hh - close) / atr AS mfe, (close - ll) / atr AS mae FROM (SELECT *, max(high) OVER a AS hh, min(low) OVER a AS ll FROM entries WINDOW a AS ({S} ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)) WHERE close > 0 AND atr > 0 AND hh IS NOT NULL)"


@query(chain(BARS, ATR, _EXC) + ", u AS (SELECT 'mfe' AS side, mfe AS x FROM xc WHERE abs(mfe) <= 50 AND abs(mae) <= 50 UNION ALL SELECT 'mae', mae FROM xc WHERE abs(mfe) <= 50 AND abs(mae) <= 50) SELECT side, CAST(count(*) AS BIGINT) AS n, round(avg(x), 5) + 0.0 AS mean, round(quantile_cont(x, 0.25), 5) + 0.0 AS p25, round(quantile_cont(x, 0.5), 5) + 0.0 AS p50, round(quantile_cont(x, 0.75), 5) + 0.0 AS p75, round(quantile_cont(x, 0.9), 5) + 0.0 AS p90 FROM u GROUP BY 1")
def excursion_report(spark, sf_dir):
    return shown(lb.excursion_report(lb.excursions(lb.with_atr(bars(spark, sf_dir)), 20)), ["side", "n"], ["mean", "p25", "p50", "p75", "p90"])


_MT = ", m AS (SELECT symbol, date, {}, {} FROM nx WHERE close > 0 AND atr > 0 AND len(nx) > 0)"


def _hit(up: float, down: float, name: str) -> str:
    u, d = (f"coalesce(nullif(coalesce(list_position(list_transform(nx, lambda b: b.{x}), true), 0), 0), 21)" for x in (f"h >= close + {up} * atr", f"l <= close - {down} * atr"))
    return f"CAST(CASE WHEN {u} > 20 AND {d} > 20 THEN 0 WHEN {u} <= {d} THEN 1 ELSE -1 END AS INTEGER) AS {name}"


@query(chain(BARS, ATR, _NEXT) + _MT.format(_hit(1.0, 1.0, "hit_a"), _hit(2.0, 1.0, "hit_b")) + " SELECT m.symbol, m.date, hit_a, hit_b FROM m JOIN bars USING (symbol, date) WHERE bars.close > bars.open")
def labels_at_entries(spark, sf_dir):
    b = bars(spark, sf_dir)
    return lb.labels_at(lb.with_atr(b), b.where("close > open"), {"a": (1.0, 1.0), "b": (2.0, 1.0)}, _H).select(*KEYS, "hit_a", "hit_b")


@query(chain(BARS, ATR, _NEXT) + _MT.format(_hit(5.0, 2.0, "hit_a"), _hit(4.0, 1.0, "hit_b")) + " SELECT symbol, date, 'a' AS model, hit_a AS hit FROM m UNION ALL SELECT symbol, date, 'b', hit_b FROM m")
def relabelled(spark, sf_dir):
    # thresholds from the regions table: two models, whose targets and stops follow the regions' keys
    r = table(spark, sf_dir, "region").where("r_regionkey < 2").select(F.when(F.col("r_regionkey") == 0, "a").otherwise("b").alias("model"), (5 - F.col("r_regionkey")).alias("up"), (2 - F.col("r_regionkey")).alias("down"))
    return lb.relabelled(lb.with_atr(bars(spark, sf_dir)), r, _H)


@query(chain(*_SPANS) + ", s AS (SELECT symbol || '|' || t0 AS id, t0, t1 FROM sp ORDER BY md5(symbol || '|' || t0), id LIMIT 200) SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON a.id < b.id AND a.t0 <= b.t1 AND a.t1 >= b.t0")
def overlap_pairs(spark, sf_dir):
    return lb.overlap_matrix(_spans(spark, sf_dir), 200)


# features


@query(chain(BARS, RET, stage("a", "rets", {"z20": over(f"close - ({roll('avg', 'close', 20, 6)})", f"({roll('stddev_samp', 'close', 20, 6)})")})) + " SELECT symbol, date, round(z20, 5) + 0.0 AS z20 FROM a")
def sample_zscore(spark, sf_dir):
    return shown(bars(spark, sf_dir).withColumn("z20", wn.zscore("close", 20, 6, sample=True)), KEYS, ["z20"])


@query(chain(BARS, stage("a", "bars", {"d": f"close - {lagged('close')}"}), stage("b", "a", {"u": roll("avg", "greatest(d, 0.0)", 14, 14).replace("count(greatest(d, 0.0))", "count(d)"), "v": roll("avg", "greatest(-d, 0.0)", 14, 14).replace("count(greatest(-d, 0.0))", "count(d)")})) + f" SELECT symbol, date, round(100 * {over('u', 'u + v')}, 5) + 0.0 AS close_rsi14 FROM b")
def simple_rsi(spark, sf_dir):
    return shown(mc.simple_rsi(bars(spark, sf_dir), "close"), KEYS, ["close_rsi14"])


@query(chain(BARS) + " SELECT date, round(arg_min(close, array_position(['S7', 'S3', 'S1'], symbol)), 7) + 0.0 AS close FROM bars WHERE symbol IN ('S7', 'S3', 'S1') GROUP BY 1")
def first_available(spark, sf_dir):
    return shown(mc.first_available(bars(spark, sf_dir), ["S7", "S3", "S1"]), ["date"], ["close"], 7)


@query(chain(BARS, RET, stage("a", "rets", {"v": dev("ret", 20)})) + " SELECT symbol, date, CASE WHEN ret IS NOT NULL AND v IS NOT NULL THEN (CASE WHEN ret < 0 THEN 'down' ELSE 'up' END) || '_' || (CASE WHEN v < 0.5 THEN 'quiet' WHEN v < 1.0 THEN 'normal' ELSE 'wild' END) END AS regime FROM a")
def combined_regimes(spark, sf_dir):
    t = ft.returns(bars(spark, sf_dir))
    t = t.withColumns({"trend": mc.state("ret", [0.0], ["down", "up"]), "v": wn.std0("ret", 20)})
    return mc.combined_state(t.withColumn("vol", mc.state("v", [0.5, 1.0], ["quiet", "normal", "wild"])), ["trend", "vol"], "regime").select(*KEYS, "regime")


def _fold(x: str, span: float) -> str:
    return f"list_reduce(list({x}) FILTER (WHERE {x} IS NOT NULL) OVER ({S} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda p, q: p + {2 / (span + 1)} * (q - p))"


@query(chain(BARS, SECTORS, BENCH, RET, _J, stage("a", "j", {"rs": over("close", "px")}), stage("b", "a", {"d": f"coalesce(rs - {lagged('rs')}, 0.0)", "k": f"row_number() OVER ({S})"}), stage("b2", "b", {"g": "greatest(d, 0.0)", "l": "greatest(-d, 0.0)"}), stage("c", "b2", {"u": _fold("g", 14), "v": _fold("l", 14)})) + f" SELECT symbol, date, round(CASE WHEN k >= 14 THEN 100 - 100 / (1 + {over('u', 'v')}) END, 4) + 0.0 AS rs_rsi14 FROM c")
def strength_rsi(spark, sf_dir):
    from .queries import _with_market

    t = pn.relative_strength(_with_market(spark, sf_dir), "close", "px")
    return shown(kn.smoothed_rsi(t.select(*KEYS, "rs"), "rs", 14, "rs_rsi14"), KEYS, ["rs_rsi14"], 4)


def _wilder(x: str, n: int) -> str:
    return f"CASE WHEN len({x}) >= {n} THEN list_reduce({x}[{n + 1}:], lambda p, q: p + (q - p) / {n}.0, list_avg({x}[1:{n}])) END"


@query(chain(BARS, stage("a", "bars", {"pc": lagged("close")}), stage("b", "a", {"d": "close - pc", "t": "CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END"}), f"c AS (SELECT *, list(greatest(d, 0.0)) FILTER (WHERE d IS NOT NULL) OVER w AS ups, list(greatest(-d, 0.0)) FILTER (WHERE d IS NOT NULL) OVER w AS downs, list(t) OVER w AS trs FROM b WINDOW w AS ({S} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))", stage("e", "c", {"u": _wilder("ups", 14), "v": _wilder("downs", 14), "atr14": _wilder("trs", 14)})) + f" SELECT symbol, date, round(100 * {over('u', 'u + v')}, 4) + 0.0 AS rsi_14, round(atr14, 4) + 0.0 AS atr14, round(atr14 / close, 6) + 0.0 AS atr_percent FROM e")
def wilder_indicators(spark, sf_dir):
    t = kn.recursive(bars(spark, sf_dir), ["rsi", "atr"]).withColumn("atr_percent", F.round("atr_percent", 6) + 0.0)
    return shown(t, [*KEYS, "atr_percent"], ["rsi_14", "atr14"], 4)


@query(chain(BARS, stage("a", "bars", {"line": f"{_fold('close', 12)} - {_fold('close', 26)}"}), stage("b", "a", {"signal": _fold("line", 9)})) + " SELECT symbol, date, round(line, 4) + 0.0 AS macd, round(signal, 4) + 0.0 AS macd_signal, round(line - signal, 4) + 0.0 AS macd_histogram FROM b")
def macd_lines(spark, sf_dir):
    return shown(kn.recursive(bars(spark, sf_dir), ["macd"]), KEYS, ["macd", "macd_signal", "macd_histogram"], 4)


@query(chain(BARS, SECTORS, BENCH, RET, _J, stage("a", "j", {"k": f"CAST(row_number() OVER ({S}) AS DOUBLE)", "x": "ln(close / px)"}), stage("b", "a", {"n": f"count(x) OVER {rw(10)}", "sx": f"sum(x) OVER {rw(10)}", "skx": f"sum((k - 1) * x) OVER {rw(10)}", "sk": f"sum(CASE WHEN x IS NOT NULL THEN k - 1 END) OVER {rw(10)}"})) + " SELECT symbol, date, round(CASE WHEN n >= 5 THEN (skx - (k - 1 - 4.5) * sx - sx / n * (sk - (k - 1 - 4.5) * n)) / (82.5 + 0.01) END, 5) + 0.0 AS rs_slope FROM b")
def strength_slope(spark, sf_dir):
    from .queries import _with_market

    t = _with_market(spark, sf_dir).withColumn("x", F.log(F.col("close") / F.col("px")))
    return shown(ft.regularised_slope(t, "x", 10, "rs_slope"), KEYS, ["rs_slope"])


_DRV = [BARS, SECTORS, BENCH, RET, "jd AS (SELECT r.*, s.sector, m.bench_ret AS market_ret, m.px AS market_px, b.bench_ret AS sector_ret, b.px AS sector_px FROM rets r LEFT JOIN sectors s USING (symbol) LEFT JOIN bench m ON m.bench = 'ALL' AND m.date = r.date LEFT JOIN bench b ON b.bench = s.sector AND b.date = r.date)"]


def _beta(x: str, w: int, least: int) -> dict[str, str]:
    both = f"ret IS NOT NULL AND {x}_ret IS NOT NULL"
    a, b = f"(CASE WHEN {both} THEN ret END)", f"(CASE WHEN {both} THEN {x}_ret END)"
    return {f"{x}_beta": f"CASE WHEN count({a}) OVER {rw(w)} >= {least} THEN {over(f'covar_samp({a}, {b}) OVER {rw(w)}', f'var_samp({b}) OVER {rw(w)}')} END"}


def _alpha_chain(before: str, w: int, least: int, windows: tuple[int, ...], part: int) -> list[str]:
    enough = lambda k: max(3, k // 3) if part == 3 else k // part
    one = stage("a1", before, _beta("market", w, least) | _beta("sector", w, least))
    two = stage("a2", "a1", {f"{x}_alpha": f"ret - {x}_beta * {x}_ret" for x in ("market", "sector")})
    three = stage("a3", "a2", {"combo_alpha": "0.5 * market_alpha + 0.5 * sector_alpha"})
    return [one, two, three, stage("a4", "a3", {f"{x}_mom_{k}": roll("sum", f"{x}_alpha", k, enough(k)) for x in ("market", "sector", "combo") for k in windows})]


_AL = ["market_beta", "sector_beta", "market_alpha", "sector_alpha", "combo_alpha", "market_mom_20", "sector_mom_20", "combo_mom_60"]


@query(chain(*_DRV, *_alpha_chain("jd", 60, 20, (20, 60), 3)) + f" SELECT symbol, date, {out(_AL, 4)} FROM a4")
def alpha_drivers(spark, sf_dir):
    b, s = ft.returns(bars(spark, sf_dir)), sectors(spark, sf_dir)
    return shown(pn.alpha_drivers(b, s, pn.benchmarks(b, s)), KEYS, _AL, 4)


@query(chain(*_DRV, *_alpha_chain("jd", 60, 20, (20, 60), 3), stage("r", "a4", {"residual_mean": roll("avg", "market_alpha", 60, 20), "residual_cumret": roll("sum", "market_alpha", 60, 20), "residual_vol": roll("stddev_samp", "market_alpha", 60, 20)})) + f" SELECT symbol, date, {out(['residual_mean', 'residual_cumret', 'residual_vol'], 4)} FROM r")
def residual_block(spark, sf_dir):
    b, s = order.held(ft.returns(bars(spark, sf_dir))), sectors(spark, sf_dir)
    return shown(ft.residual_block(pn.alpha_drivers(b, s, order.held(pn.benchmarks(b, s))), "market_alpha", 60, 20), KEYS, ["residual_mean", "residual_cumret", "residual_vol"], 4)


def _strength(norm: tuple[int, int], zw: tuple[int, int]) -> list[str]:
    pairs = {"rs_market": ("close", "market_px"), "rs_sector": ("close", "sector_px"), "rs_sector_market": ("sector_px", "market_px")}
    return [stage("r1", "jd", {n: over(a, b) for n, (a, b) in pairs.items()}), stage("r2", "r1", {f"{n}_norm": over(n, f"({roll('avg', n, *norm)})") + " - 1" for n in pairs} | {f"{n}_z{zw[0]}": over(f"{n} - ({roll('avg', n, *zw)})", f"({roll('stddev_samp', n, *zw)})") for n in pairs})]


_ST = [f"{n}{x}" for n in ("rs_market", "rs_sector", "rs_sector_market") for x in ("", "_norm", "_z20")]


@query(chain(*_DRV, *_strength((60, 20), (20, 6))) + f" SELECT symbol, date, {out(_ST, 4)} FROM r2")
def strength_drivers(spark, sf_dir):
    b, s = ft.returns(bars(spark, sf_dir)), sectors(spark, sf_dir)
    return shown(pn.strength_drivers(b, s, pn.benchmarks(b, s)), KEYS, _ST, 4)


_BM = "bm AS (SELECT symbol, bench AS best FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(c * c / (v * u), 9) DESC, bench) AS k FROM fit WHERE n >= 100 AND c * c / (v * u) > 0) WHERE k = 1)"
def spread_sql(name: str, before: str, x: str, prefix: str, windows) -> list[str]:
    """Stages that add the metrics of a spread."""
    m = windows[1]
    k = stage(f"{name}0", before, {"k": f"CAST(row_number() OVER ({S}) AS DOUBLE)"})
    made = {f"{prefix}_cum_{w}": roll("sum", x, w, max(3, w // 3)) for w in windows} | {f"{prefix}_z_{m}": sample_z(x, m, min(m, max(10, m // 2)))}
    made |= {f"{prefix}_slope_{w}": f"CASE WHEN count({x}) OVER {rw(w)} >= {min(w, max(3, w // 2))} THEN regr_slope({x}, k) OVER {rw(w)} END" for w in windows[:2]}
    return [k, stage(name, f"{name}0", made)]


def spread_columns(prefix: str, windows) -> list[str]:
    return [*(f"{prefix}_cum_{w}" for w in windows), f"{prefix}_z_{windows[1]}", *(f"{prefix}_slope_{w}" for w in windows[:2])]


_BJ = "bj AS (SELECT r.*, best, b.bench_ret - m.bench_ret AS sp FROM rets r JOIN bm USING (symbol) LEFT JOIN bench b ON b.bench = bm.best AND b.date = r.date LEFT JOIN bench m ON m.bench = '{}' AND m.date = r.date)"
_WEEKS = f"""wk AS (SELECT symbol, CAST({FRIDAY} AS DATE) AS date, product(1 + ret) - 1 AS ret FROM rets GROUP BY 1, 2),
wb AS (SELECT bench, CAST({FRIDAY} AS DATE) AS date, product(1 + bench_ret) - 1 AS bench_ret FROM bench GROUP BY 1, 2)"""
_BMS, _BMW = spread_columns("bm", (20, 60, 120)), spread_columns("wbm", (4, 12, 24))


def _matched(spark, sf_dir):
    b = order.held(ft.returns(bars(spark, sf_dir)))  # benchmarks, matches, calendars and the table itself read them
    bench = pn.benchmarks(b, sectors(spark, sf_dir)).persist()  # a row a date and benchmark, read by many joins
    return b, bench, pn.best_match(b, bench).persist()


@query(chain(BARS, SECTORS, BENCH, RET, _FIT, _BM, _BJ.format("ALL"), *spread_sql("s2", "bj", "sp", "bm", (20, 60, 120))) + f" SELECT symbol, date, {out(_BMS, 4)} FROM s2")
def best_match_spread(spark, sf_dir):
    return shown(fc.best_spread(*_matched(spark, sf_dir), "ALL", "bm"), KEYS, _BMS, 4)


_BMA = _BM.replace("FROM fit WHERE", "FROM fit WHERE bench <> 'ALL' AND")


@query(chain(BARS, SECTORS, BENCH, RET, _FIT, _BMA, _BJ.format("ASIA"), *spread_sql("s2", "bj", "sp", "bm", (20, 60, 120))) + f" SELECT symbol, date, best, {out(_BMS, 4)} FROM s2")
def equal_weight_spread(spark, sf_dir):
    b, bench, _ = _matched(spark, sf_dir)
    mapping = pn.best_match(b, bench.where("bench <> 'ALL'"))
    return shown(fc.best_spread(b, bench, mapping, "ASIA", "bm"), [*KEYS, "best"], _BMS, 4)


@query(chain(BARS, SECTORS, BENCH, RET, _FIT, _BM, _WEEKS, "bj AS (SELECT r.symbol, r.date, b.bench_ret - m.bench_ret AS sp FROM wk r JOIN bm USING (symbol) LEFT JOIN wb b ON b.bench = bm.best AND b.date = r.date LEFT JOIN wb m ON m.bench = 'ALL' AND m.date = r.date)", *spread_sql("s2", "bj", "sp", "wbm", (4, 12, 24))) + f" SELECT b.symbol, b.date, {', '.join(f'round(CAST(q.{c} AS DOUBLE), 4) + 0.0 AS {c}' for c in _BMW)} FROM bars b ASOF LEFT JOIN s2 q ON b.symbol = q.symbol AND b.date >= q.date")
def weekly_best_spread(spark, sf_dir):
    return shown(fc.weekly_best_spread(*_matched(spark, sf_dir), "ALL", "wbm"), KEYS, _BMW, 4)


# joint factor regression

_JF = ["beta_market", "beta_growth", "beta_bestmatch", "alpha", "ridge_resid", "residual_mean", "residual_cumret", "residual_vol"]
_JW = [*(f"w_{c}" for c in ("beta_market", "beta_growth", "beta_bestmatch", "alpha", "residual_vol")), *spread_columns("w_bestmatch_market", (4, 12, 24))]


def _fill_sql(name: str, bench: str, rows: str) -> str:
    return f"""{name}g AS (SELECT b.bench, d.date, x.bench_ret AS v FROM (SELECT DISTINCT bench FROM {bench}) b CROSS JOIN (SELECT date FROM {rows} UNION SELECT date FROM {bench}) d LEFT JOIN {bench} x ON x.bench = b.bench AND x.date = d.date),
{name}f AS (SELECT bench, date, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY bench ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(v IGNORE NULLS) OVER (PARTITION BY bench ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM {name}g),
j AS (SELECT r.symbol, r.date, r.ret, m.v AS market, g.v - m.v AS growth, b.v - m.v AS bestmatch FROM {rows} r LEFT JOIN bm USING (symbol) LEFT JOIN {name}f m ON m.bench = 'ALL' AND m.date = r.date LEFT JOIN {name}f g ON g.bench = 'ASIA' AND g.date = r.date LEFT JOIN {name}f b ON b.bench = bm.best AND b.date = r.date)"""


def _residual_sql(w: int) -> str:
    least = min(w, max(20, int(w * 0.33)))
    return stage("r5", "r4", {"beta_market": "b0", "beta_growth": "b1", "beta_bestmatch": "b2", "ridge_resid": "resid", "residual_mean": roll("avg", "resid", w, least), "residual_cumret": roll("sum", "resid", w, least), "residual_vol": roll("stddev_samp", "resid", w, least)})


def _joint(spark, sf_dir):
    b, bench, mapping = _matched(spark, sf_dir)
    return fc.joint_factors(b, bench, {"market": "ALL", "growth": "ASIA"}, mapping=mapping)


@query(chain(BARS, SECTORS, BENCH, RET, _FIT, _BM, _fill_sql("d", "bench", "rets"), *ridge_sql("ret", ["market", "growth", "bestmatch"], 60), _residual_sql(60)) + f" SELECT symbol, date, {out(_JF, 4)} FROM r5")
def joint_factors(spark, sf_dir):
    return shown(_joint(spark, sf_dir), KEYS, _JF, 4)


@query(chain(BARS, SECTORS, BENCH, RET, _FIT, _BM, _WEEKS, _fill_sql("w", "wb", "wk"), *ridge_sql("ret", ["market", "growth", "bestmatch"], 12), _residual_sql(12), *spread_sql("s2", "r5", "bestmatch", "w_bestmatch_market", (4, 12, 24)), "wq AS (SELECT *, beta_market AS w_beta_market, beta_growth AS w_beta_growth, beta_bestmatch AS w_beta_bestmatch, alpha AS w_alpha, residual_vol AS w_residual_vol FROM s2)") + f" SELECT b.symbol, b.date, {', '.join(f'round(CAST(q.{c} AS DOUBLE), 4) + 0.0 AS {c}' for c in _JW)} FROM bars b ASOF LEFT JOIN wq q ON b.symbol = q.symbol AND b.date >= q.date")
def weekly_joint_factors(spark, sf_dir):
    return shown(_joint(spark, sf_dir), KEYS, _JW, 4)


@query(chain(BARS, SECTORS, BENCH, RET, _FIT, _BM) + " SELECT bench, CAST(count(*) AS BIGINT) AS n FROM bench WHERE bench = 'ALL' OR bench IN (SELECT best FROM bm) GROUP BY 1")
def required_benchmarks(spark, sf_dir):
    b = ft.returns(bars(spark, sf_dir))
    bench = pn.benchmarks(b, sectors(spark, sf_dir))
    return pn.required_benchmarks(bench, pn.best_match(b, bench), ["ALL"]).groupBy("bench").agg(F.count("*").alias("n"))


@query(chain(BARS) + ", f AS (SELECT symbol FROM bars WHERE symbol IN ('S1', 'S2', 'S3', 'S4') GROUP BY 1 HAVING count(*) >= 50) SELECT symbol, CAST(count(*) AS BIGINT) AS n FROM bars WHERE symbol IN (SELECT symbol FROM f) AND (SELECT count(*) FROM f) >= 3 GROUP BY 1")
def sector_panel(spark, sf_dir):
    return pn.enough_members(bars(spark, sf_dir), ["S1", "S2", "S3", "S4"], 3).groupBy("symbol").agg(F.count("*").alias("n"))


# weekly features

_WRET = stage("wr", "weekly", {"ret": f"ln(close) - ln({lagged('close')})"})
_WBENCH = BENCH.replace("FROM bars b", "FROM weekly b")
_WDRV = [BARS, SECTORS, WEEKLY, _WBENCH, _WRET.replace("wr AS", "rets AS", 1), _DRV[4]]


def _weekly(spark, sf_dir):
    b, s = pn.resample(bars(spark, sf_dir)), sectors(spark, sf_dir)
    return b, s, pn.benchmarks(b, s)


_WA = ["market_beta", "sector_beta", "market_alpha", "market_mom_4", "combo_mom_12"]


@query(chain(*_WDRV, *_alpha_chain("jd", 12, 6, (4, 12, 24), 2)) + f" SELECT symbol, date, {out(_WA, 4)} FROM a4")
def weekly_alpha(spark, sf_dir):
    return shown(pn.alpha_drivers(*_weekly(spark, sf_dir), 12, 6, (4, 12, 24), 2), KEYS, _WA, 4)


_WST = [f"{n}{x}" for n in ("rs_market", "rs_sector") for x in ("", "_norm", "_z12")]


@query(chain(*_WDRV, *_strength((12, 3), (12, 3))) + f" SELECT symbol, date, {out(_WST, 4)} FROM r2")
def weekly_strength(spark, sf_dir):
    return shown(pn.strength_drivers(*_weekly(spark, sf_dir), (12, 3), (12, 3)), KEYS, _WST, 4)


_WCAL = "cal AS (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM weekly))"
_WMOM = [BARS, SECTORS, WEEKLY, _WRET, _WCAL, calendar_sum("mm", "wr", 4, 2), "js AS (SELECT mm.*, sector FROM mm LEFT JOIN sectors USING (symbol))", "ns AS (SELECT *, CASE WHEN sector IS NOT NULL AND count(mom) OVER (PARTITION BY date, sector) >= 2 THEN mom - quantile_cont(mom, 0.5) OVER (PARTITION BY date, sector) END AS mom_neutral FROM js)", "zs AS (SELECT *, CASE WHEN stddev_pop(mom) OVER (PARTITION BY date) > 1e-10 THEN (mom - quantile_cont(mom, 0.5) OVER (PARTITION BY date)) / stddev_pop(mom) OVER (PARTITION BY date) END AS mom_z, CASE WHEN stddev_pop(mom_neutral) OVER (PARTITION BY date) > 1e-10 THEN (mom_neutral - quantile_cont(mom_neutral, 0.5) OVER (PARTITION BY date)) / stddev_pop(mom_neutral) OVER (PARTITION BY date) END AS mom_neutral_z FROM ns)"]


@query(chain(*_WMOM) + f" SELECT b.symbol, b.date, round(q.mom_z, 4) + 0.0 AS mom_z, round(q.mom_neutral_z, 4) + 0.0 AS mom_neutral_z FROM bars b ASOF LEFT JOIN zs q ON b.symbol = q.symbol AND b.date >= q.date")
def weekly_momentum(spark, sf_dir):
    b = bars(spark, sf_dir)
    w = pn.neutral_momentum(pn.resample(b), sectors(spark, sf_dir), 4, 2)
    return shown(pn.as_of(b, w, ["mom_z", "mom_neutral_z"], ["symbol"]), KEYS, ["mom_z", "mom_neutral_z"], 4)


@query(chain(*_WMOM[:7], "rm AS (SELECT *, round(mom, 9) AS m9 FROM js)", "p AS (SELECT *, CASE WHEN count(m9) OVER (PARTITION BY date) >= 2 AND m9 IS NOT NULL THEN (row_number() OVER (PARTITION BY date ORDER BY m9 NULLS LAST, symbol) - 1) / (count(m9) OVER (PARTITION BY date) - 1) * 100 END AS pct, CASE WHEN count(m9) OVER (PARTITION BY date, sector) >= 2 AND m9 IS NOT NULL THEN (row_number() OVER (PARTITION BY date, sector ORDER BY m9 NULLS LAST, symbol) - 1) / (count(m9) OVER (PARTITION BY date, sector) - 1) * 100 END AS ps FROM rm)") + " SELECT symbol, date, round(pct, 4) + 0.0 AS pct, round(coalesce(ps, pct), 4) + 0.0 AS pct_sector FROM p")
def weekly_percentile(spark, sf_dir):
    w = pn.momentum(pn.resample(bars(spark, sf_dir)), 4, 2).withColumn("m9", F.round("mom", 9))
    return shown(pn.cross_percentiles(w, "m9", sectors(spark, sf_dir)), KEYS, ["pct", "pct_sector"], 4)


@query(chain(BARS, WEEKLY, _WRET, stage("v", "wr", {"a": roll("stddev_samp", "ret", 4, 2), "b": roll("stddev_samp", "ret", 20, 10)}), stage("w", "v", {"vol_regime": f"ln(1 + {over('a', 'b')})"}), "x AS (SELECT *, quantile_cont(vol_regime, 0.5) OVER (PARTITION BY date) AS med FROM w)") + " SELECT symbol, date, round(med, 4) + 0.0 AS vol_regime_cs_median, round(vol_regime - med, 4) + 0.0 AS vol_regime_rel FROM x")
def weekly_relative_volatility(spark, sf_dir):
    w = pn.resample(bars(spark, sf_dir)).withColumns({"a": wn.std1("ret", 4, 2), "b": wn.std1("ret", 20, 10)}).withColumn("vol_regime", F.log1p(wn.div("a", "b")))
    w = w.withColumn("vol_regime_cs_median", F.percentile("vol_regime", 0.5).over(Window.partitionBy("date"))).withColumn("vol_regime_rel", F.col("vol_regime") - F.col("vol_regime_cs_median"))
    return shown(w, KEYS, ["vol_regime_cs_median", "vol_regime_rel"], 4)


_WB = ["above_ma10", "above_ma40", "mcclellan_osc", "mcclellan_sum"]


@query(chain(BARS, WEEKLY, breadth_sql("weekly", 10, 40, (4, 8))) + f" SELECT date, advancers, decliners, net, ad_line, {out(_WB, 4)} FROM bs")
def weekly_breadth(spark, sf_dir):
    return shown(pn.breadth(pn.resample(bars(spark, sf_dir)), (10, 40), (4, 8)), ["date", "advancers", "decliners", "net", "ad_line"], _WB, 4)


@query(chain(BARS, WEEKLY, breadth_sql("weekly", 10, 40, (4, 8))) + " SELECT b.symbol, b.date, CAST(q.ad_line AS BIGINT) AS w_ad_line, round(q.mcclellan_osc, 4) + 0.0 AS w_mcclellan_osc FROM bars b ASOF LEFT JOIN bs q ON b.date >= q.date")
def breadth_attached(spark, sf_dir):
    b = bars(spark, sf_dir)
    w = tb.prefixed(pn.breadth(pn.resample(b), (10, 40), (4, 8)).select("date", "ad_line", "mcclellan_osc"), "w_", ["date"])
    days = pn.as_of(b.select("date").distinct().withColumn("one", F.lit(1)), w.withColumn("one", F.lit(1)), ["w_ad_line", "w_mcclellan_osc"], ["one"]).drop("one")
    return shown(b.join(pn.small(days), "date", "left"), [*KEYS, "w_ad_line"], ["w_mcclellan_osc"], 4)


_WM = f"wm AS (SELECT 'F' AS symbol, CAST({FRIDAY} AS DATE) AS date, arg_max(flow / 1e6, date) AS v FROM macro GROUP BY 2)"


def _weekly_flow(spark, sf_dir):
    return mc.weekly_series(_flow(spark, sf_dir), "v")


@query(chain(MACRO, _WM, stage("a", "wm", {"v_z12": over(f"v - ({roll('avg', 'v', 12, 4)})", f"({roll('stddev_samp', 'v', 12, 4)})"), "v_ma4_ratio": over("v", f"({roll('avg', 'v', 4, 2)})"), "v_chg1": over("v", lagged("v", 1)) + " - 1", "v_chg4": over("v", lagged("v", 4)) + " - 1", "v_pct52": f"CASE WHEN count(*) OVER w >= 11 THEN len(list_filter(list(v) OVER w, lambda q: q < v)) / len(list(v) OVER w) * 100 END"}) + "", ) .replace("FROM wm)", f"FROM wm WINDOW w AS ({S} ROWS BETWEEN 51 PRECEDING AND 1 PRECEDING))") + f" SELECT date, {out(['v_z12', 'v_ma4_ratio', 'v_chg1', 'v_chg4', 'v_pct52'], 4)} FROM a")
def weekly_regime(spark, sf_dir):
    return shown(mc.weekly_regime(_weekly_flow(spark, sf_dir), "v"), ["date"], ["v_z12", "v_ma4_ratio", "v_chg1", "v_chg4", "v_pct52"], 4)


@query(chain(MACRO, _WM, stage("a", "wm", {"v_chg4": f"v - {lagged('v', 4)}", "v_z52": sample_z("v", 52, 13)}), stage("b", "a", {"lv": lagged("v"), "lc": lagged("v_chg4"), "lz": lagged("v_z52")})) + " SELECT date, round(lv, 5) + 0.0 AS v_level, round(lc, 5) + 0.0 AS v_chg4, round(lz, 5) + 0.0 AS v_z52 FROM b")
def weekly_published(spark, sf_dir):
    return shown(mc.weekly_published(_weekly_flow(spark, sf_dir), "v"), ["date"], ["v_level", "v_chg4", "v_z52"])


_WBW = "bw AS (SELECT 'ALL' AS symbol, date, max(CASE WHEN bench = 'ASIA' THEN px END) AS asia, max(CASE WHEN bench = 'EUROPE' THEN px END) AS europe, max(CASE WHEN bench = 'ASIA' THEN bench_ret END) AS ra, max(CASE WHEN bench = 'EUROPE' THEN bench_ret END) AS re FROM bench GROUP BY date)"


@query(chain(BARS, SECTORS, WEEKLY, _WBENCH, _WBW, stage("r", "bw", {"ae": over("asia", "europe")}), stage("q", "r", {"ae_z": sample_z("ae", 12, 6)})) + f" SELECT date, {out(['ae', 'ae_z'])} FROM q")
def weekly_ratios(spark, sf_dir):
    b = _weekly(spark, sf_dir)[2].withColumnRenamed("bench", "symbol")
    return shown(mc.ratios(mc.wide_prices(b, ["ASIA", "EUROPE"], "px"), {"ae": ("asia", "europe")}, 12, 6), ["date"], ["ae", "ae_z"])


_WSP = spread_columns("ae", (4, 12, 24))


@query(chain(BARS, SECTORS, BENCH, RET, _WEEKS, "r AS (SELECT 'ALL' AS symbol, date, max(CASE WHEN bench = 'ASIA' THEN bench_ret END) - max(CASE WHEN bench = 'EUROPE' THEN bench_ret END) AS s FROM wb GROUP BY date)", *spread_sql("q", "r", "s", "ae", (4, 12, 24))) + f" SELECT date, {out(_WSP)} FROM q")
def weekly_spreads(spark, sf_dir):
    b = pn.benchmarks(bars(spark, sf_dir), sectors(spark, sf_dir))
    weeks = fc.compounded(b, "bench", "bench_ret").withColumnRenamed("bench", "symbol")
    return shown(mc.global_spreads(mc.wide_prices(weeks, ["ASIA", "EUROPE"], "bench_ret"), {"ae": ("asia", "europe")}, (4, 12, 24)), ["date"], _WSP)


@query(chain(*_DRV, stage("a", "jd", {"dp": f"close - {lagged('close', 10)}", "dv": f"volume - {lagged('volume', 10)}", "dr": f"market_px - {lagged('market_px', 10)}"}), stage("b", "a", {f"t{k}": f"CASE WHEN count(d{k}) OVER {rw(60)} >= 20 THEN tanh(d{k} / greatest(stddev_samp(d{k}) OVER {rw(60)}, 1e-8)) ELSE tanh(d{k} / 1e-8) END" for k in "pvr"})) + " SELECT symbol, date, round(tp - tv, 4) + 0.0 AS volume_price_div_10d, round(tr - tp, 4) + 0.0 AS price_market_div_10d FROM b")
def divergence_block(spark, sf_dir):
    b, s = ft.returns(bars(spark, sf_dir)), sectors(spark, sf_dir)
    t = pn.with_benchmark(b, pn.benchmarks(b, s), "ALL", {"px": "market_px"})
    t = ft.divergence(t, {"volume_price": ("close", "volume"), "price_market": ("market_px", "close")}, (10,))
    return shown(t, KEYS, ["volume_price_div_10d", "price_market_div_10d"], 4)


@query(chain(BARS, SECTORS, BENCH, RET, _FIT) + ", co AS (SELECT symbol, bench, n, c / (sqrt(v) * sqrt(u)) AS corr FROM fit WHERE n > 100), ow AS (SELECT co.symbol, corr AS own FROM co JOIN sectors s ON co.symbol = s.symbol AND co.bench = s.sector), g AS (SELECT symbol, bench, round(corr - own, 9) AS gain FROM co JOIN ow USING (symbol)), b3 AS (SELECT symbol, arg_max(bench, struct_pack(g := gain, b := bench)) AS best FROM g WHERE gain >= 0.03 GROUP BY 1) SELECT s.symbol, coalesce(b3.best, s.sector) AS subsector FROM sectors s LEFT JOIN b3 USING (symbol)")
def subsector_map(spark, sf_dir):
    b, s = ft.returns(bars(spark, sf_dir)), sectors(spark, sf_dir)
    g = mp.gains(pn.correlations(b, pn.benchmarks(b, s)), s).withColumn("gain", F.round("gain", 9))
    return mp.by_gain(s, g)


@query(chain(*_P, _EQ) + ", bw AS (SELECT week, symbol, 1 / count(*) OVER (PARTITION BY week) AS bench FROM signals), sg AS (SELECT symbol, stddev_samp(actual_return) AS sigma FROM signals GROUP BY 1) SELECT week, round(sqrt(sum(power((coalesce(weight, 0.0) - coalesce(bench, 0.0)) * sigma, 2))), 6) + 0.0 AS tracking_error FROM (SELECT week, symbol, weight, bench FROM (SELECT week, symbol, weight FROM eq) FULL JOIN bw USING (week, symbol)) JOIN sg USING (symbol) GROUP BY 1")
def tracking_error(spark, sf_dir):
    s = signals(spark, sf_dir)
    bench = s.select("week", "symbol", (1 / F.count("*").over(Window.partitionBy("week"))).alias("bench"))
    return shown(pf.tracking_error(pf.equal_top(s), bench, s.groupBy("symbol").agg(F.stddev_samp("actual_return").alias("sigma"))), ["week"], ["tracking_error"], 6)


_PP = _WR.replace("wr AS", "wp AS").replace("FROM eq", "FROM po")
_PO = "po AS (SELECT *, coalesce(w / nullif(sum(w) OVER (PARTITION BY week), 0), 0) AS weight FROM (SELECT *, least(coalesce(probability / nullif(sum(probability) OVER (PARTITION BY week), 0), 0), 0.2) AS w FROM (SELECT *, row_number() OVER (PARTITION BY week ORDER BY probability DESC, symbol) AS k FROM signals) WHERE k <= 10))"


@query(chain(*_P, _EQ, _PO, _WR, _PP) + ", u AS (SELECT 'equal' AS strategy, ret FROM wr UNION ALL SELECT 'proportional', ret FROM wp) SELECT strategy, CAST(count(*) AS BIGINT) AS n, round(stddev_samp(ret) * sqrt(52), 4) + 0.0 AS volatility, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END), 4) + 0.0 AS hit_rate, round(max(ret), 4) + 0.0 AS best FROM u GROUP BY 1")
def strategy_comparison(spark, sf_dir):
    s = signals(spark, sf_dir)
    t = pf.compare({"equal": pf.equal_top(s), "proportional": pf.proportional_top(s)})
    return shown(t, ["strategy", "n"], ["volatility", "hit_rate", "best"], 4)


@query(chain(BARS, RET, stage("v", "rets", {"a": dev("ret", 20), "b": dev("ret", 100), "t": f"close - {lagged('close', 20)}"}), stage("w", "v", {"vr": f"ln(1 + {over('a', 'b')})"}), f"x AS (SELECT *, CASE WHEN count(vr) OVER {rw(252)} >= 50 THEN quantile_cont(vr, 0.5) OVER {rw(252)} END AS med FROM w)") + " SELECT symbol, date, CAST(CASE WHEN vr < med THEN coalesce(sign(t), 0) ELSE 0 END AS DOUBLE) AS quiet_trend FROM x")
def quiet_trend(spark, sf_dir):
    t = ft.volatility(ft.returns(bars(spark, sf_dir))).withColumn("trend_score_granular", F.coalesce(F.signum(F.col("close") - F.lag("close", 20).over(Window.partitionBy("symbol").orderBy("date"))), F.lit(0.0)))
    return shown(ft.quiet_trend(t), KEYS, ["quiet_trend"])


# cross-section drivers

def _sides(spark, sf_dir):
    s = sectors(spark, sf_dir)
    b, bench, mapping = _matched(spark, sf_dir)
    flow = macro(spark, sf_dir).select("date", (F.col("flow") / 1e6).alias("flow"))
    return b, xs.Sides(s, bench, {"market": "ALL", "growth": "ASIA"}, mapping, flow, ("flow",), (15.0, 20.0, 30.0), {"ae": ("ASIA", "EUROPE"), "all": ("ALL", None)})


_XJ = "sj AS (SELECT r.*, sector, best, m.bench_ret AS market_ret, m.px AS market_px, g.bench_ret AS growth_ret, g.px AS growth_px, b.bench_ret AS match_ret, b.px AS match_px FROM {} r LEFT JOIN sectors USING (symbol) LEFT JOIN bm USING (symbol) LEFT JOIN {} m ON m.bench = 'ALL' AND m.date = r.date LEFT JOIN {} g ON g.bench = 'ASIA' AND g.date = r.date LEFT JOIN {} b ON b.bench = bm.best AND b.date = r.date)"


def _driver_sql(bench: str, f: xs.Frame) -> list[str]:
    """Stages x1 to x9 over sj: the columns that the driver's query shows."""
    ba = lambda who: f"CASE WHEN count(y_{who}) OVER {rw(f.beta)} >= {f.beta_least} THEN {over(f'covar_samp(y_{who}, x_{who}) OVER {rw(f.beta)}', f'var_samp(x_{who}) OVER {rw(f.beta)}')} END"
    whos, (a, a_least, b, b_least) = ("market", "growth", "match"), f.vol
    least = lambda w: max(3, w // 3) if f.part == 3 else w // f.part
    w1, w3 = f.alpha[0], f.lookbacks[1]
    return [
        stage("x1", "sj", {f"{c}_{who}": f"CASE WHEN ret IS NOT NULL AND {who}_ret IS NOT NULL THEN {v} END" for who in whos for c, v in (("y", "ret"), ("x", f"{who}_ret"))} | {"rs_growth": over("close", "growth_px"), "rs_match_market": over("match_px", "market_px"), "vr": over(f"({roll('stddev_samp', 'ret', a, a_least)})", f"({roll('stddev_samp', 'ret', b, b_least)})")}),
        stage("x2", "x1", {f"{who}_beta": ba(who) for who in whos} | {"rs_growth_norm": over("rs_growth", f"({mean('rs_growth', *f.norm)})") + " - 1", "rsg": f"rs_growth - {lagged('rs_growth')}"}),
        stage("x3", "x2", {f"{who}_alpha": f"ret - {who}_beta * {who}_ret" for who in whos} | {"gain": "CASE WHEN rsg > 0 THEN rsg ELSE 0.0 END", "loss": "CASE WHEN rsg < 0 THEN -rsg ELSE 0.0 END", "nrs": f"count(rs_growth) OVER ({S} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"}),
        stage("x4", "x3", {"combo_alpha": "0.5 * market_alpha + 0.5 * match_alpha", "growth_spread_alpha": "growth_alpha - market_alpha", "ug": run_fold("gain", 14), "ul": run_fold("loss", 14), "nr": f"row_number() OVER ({S})"}),
        stage("x5", "x4", {f"combo_mom_{w1}": roll("sum", "combo_alpha", w1, least(w1)), "growth_spread_alpha_ema10": run_fold("growth_spread_alpha", 10), "rs_growth_rsi14": f"CASE WHEN nr >= 14 THEN 100 - 100 / (1 + ug / nullif(ul, 0)) END"}),
        stage("x6", "x5", {f"combo_mom_{w1}_ema10": run_fold(f"combo_mom_{w1}", 10), "med": "quantile_cont(vr, 0.5) OVER (PARTITION BY date)"}),
        "cal AS (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM sj))",
        calendar_sum("mm", "x6", w3, min(w3, max(2 if f.unit == "w" else 3, w3 // 3))).replace("AS mom", "AS mom"),
    ]


_DD_COLUMNS = ["growth_beta", "match_alpha", "combo_mom_20", "combo_mom_20_ema10", "growth_spread_alpha_ema10", "rs_growth", "rs_growth_norm", "rs_growth_rsi14", "rs_match_market", "vol_regime_cs_median", "vol_regime_rel", "xsec_mom_20d_z", "xsec_mom_20d_sect_neutral_z", "xsec_pct_20d", "xsec_pct_20d_sect"]
_DW_COLUMNS = ["growth_beta", "match_alpha", "combo_mom_4", "combo_mom_4_ema10", "growth_spread_alpha_ema10", "rs_growth", "rs_growth_norm", "rs_growth_rsi14", "rs_match_market", "vol_regime_cs_median", "vol_regime_rel", "xsec_mom_4w_z", "xsec_mom_4w_sect_neutral_z", "xsec_pct_4w", "xsec_pct_4w_sect"]
_XEND = [
    "n1 AS (SELECT *, CASE WHEN sector IS NOT NULL AND count(mom) OVER (PARTITION BY date, sector) >= 2 THEN mom - quantile_cont(mom, 0.5) OVER (PARTITION BY date, sector) END AS neutral, round(mom, 9) AS m9 FROM mm)",
    "n2 AS (SELECT *, {}, CASE WHEN count(m9) OVER (PARTITION BY date) >= 2 AND m9 IS NOT NULL THEN (row_number() OVER (PARTITION BY date ORDER BY m9 NULLS LAST, symbol) - 1) / (count(m9) OVER (PARTITION BY date) - 1) * 100 END AS pct, CASE WHEN count(m9) OVER (PARTITION BY date, sector) >= 2 AND m9 IS NOT NULL THEN (row_number() OVER (PARTITION BY date, sector ORDER BY m9 NULLS LAST, symbol) - 1) / (count(m9) OVER (PARTITION BY date, sector) - 1) * 100 END AS ps FROM n1)".format(", ".join(f"CASE WHEN stddev_pop({x}) OVER (PARTITION BY date) > 1e-10 THEN ({x} - quantile_cont({x}, 0.5) OVER (PARTITION BY date)) / stddev_pop({x}) OVER (PARTITION BY date) END AS {n}" for x, n in (("mom", "zm"), ("neutral", "zn")))),
]


def _xend(w: str) -> list[str]:
    return [*_XEND, stage("n3", "n2", {"vol_regime_cs_median": "ln(1 + med)", "vol_regime_rel": "ln(1 + vr) - ln(1 + med)", f"xsec_mom_{w}_z": "zm", f"xsec_mom_{w}_sect_neutral_z": "zn", f"xsec_pct_{w}": "pct", f"xsec_pct_{w}_sect": "coalesce(ps, pct)"})]


@query(chain(BARS, SECTORS, BENCH, RET, _FIT, _BM, _XJ.format("rets", "bench", "bench", "bench"), *_driver_sql("bench", xs.DAILY), *_xend("20d")) + f" SELECT symbol, date, {out(_DD_COLUMNS, 4)} FROM n3")
def daily_driver(spark, sf_dir):
    b, sides = _sides(spark, sf_dir)
    return shown(xs.daily(b.select(*KEYS, "close", "ret"), sides, _DD_COLUMNS), KEYS, _DD_COLUMNS, 4)


_WPX = f"wpx AS (SELECT w.bench, w.date, w.bench_ret, p.px FROM wb w JOIN (SELECT bench, CAST({FRIDAY} AS DATE) AS date, arg_max(px, date) AS px FROM bench GROUP BY 1, 2) p USING (bench, date))"


@query(chain(BARS, SECTORS, BENCH, RET, _FIT, _BM, _WEEKS, _WPX, WEEKLY, _WRET, _XJ.format("wr", "wpx", "wpx", "wpx"), *_driver_sql("wpx", xs.WEEKLY), *_xend("4w")) + f" SELECT b.symbol, b.date, {', '.join(f'round(CAST(q.{c} AS DOUBLE), 4) + 0.0 AS w_{c}' for c in _DW_COLUMNS)} FROM bars b ASOF LEFT JOIN n3 q ON b.symbol = q.symbol AND b.date >= q.date")
def weekly_driver(spark, sf_dir):
    b, sides = _sides(spark, sf_dir)
    return shown(xs.weekly(b, sides, _DW_COLUMNS), KEYS, [f"w_{c}" for c in _DW_COLUMNS], 4)


@query(None)
def whole_driver(spark, sf_dir):
    """Every block of the daily driver with the joint factor regressions; parts have twins of their own."""
    b, sides = _sides(spark, sf_dir)
    t = xs.daily(b.select(*KEYS, "close", "ret"), sides)
    return shown(t, KEYS, [c for c, k in t.dtypes if c not in {*KEYS, *b.columns} and k != "string"], 4)


# streams that hold state, run to their end over a table

def _stream(spark, sf_dir, make, name):
    """The events as a stream of ticks of users, run once to its end into a stored table, which is read."""
    sst.use_state_store(spark)
    schema = table(spark, sf_dir, "events").schema
    ticks = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    ticks = ticks.select(F.col("user_id").cast("string").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.abs("value").alias("value"))
    path = f"{stream_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    out = make(ticks)
    out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/rows").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/rows")


_TK = "tk AS (SELECT CAST(user_id AS VARCHAR) AS symbol, ts, abs(value) AS value FROM events), wm AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY AS w FROM tk), td AS (SELECT symbol, ts, value FROM tk, wm WHERE ts <= w)"
_TO = "PARTITION BY symbol ORDER BY ts, value"


@query(f"WITH {_TK}, n AS (SELECT *, row_number() OVER ({_TO}) AS k, list(struct_pack(v := value, t := ts)) OVER ({_TO} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS nx FROM td), h AS (SELECT *, list_filter(nx, lambda b: b.t <= ts + INTERVAL 20 DAY) AS inside FROM n WHERE value > 0), t AS (SELECT *, coalesce(list_position(list_transform(inside, lambda b: b.v >= 1.5 * value OR b.v <= 0.5 * value), true), 0) AS p FROM h), r AS (SELECT *, CASE WHEN p > 0 THEN p WHEN len(inside) >= 5 THEN 5 ELSE len(inside) END AS used FROM t, wm WHERE p > 0 OR len(inside) >= 5 OR ts + INTERVAL 20 DAY <= w) SELECT symbol, ts AS entered, CAST(CASE WHEN p > 0 THEN CASE WHEN inside[p].v >= 1.5 * value THEN 1 ELSE -1 END ELSE 0 END AS INTEGER) AS hit, CAST(used AS INTEGER) AS used, CASE WHEN p > 0 THEN CASE WHEN inside[p].v >= 1.5 * value THEN 'upper' ELSE 'lower' END WHEN len(inside) >= 5 THEN 'horizon' ELSE 'expired' END AS reason FROM r")
def streaming_barriers(spark, sf_dir):
    entry = lambda t: t.select("symbol", "ts", *(F.col("value").alias(c) for c in ("high", "low", "close")), F.col("value").alias("atr"))
    t = _stream(spark, sf_dir, lambda t: sst.barriers(entry(t), 0.5, 0.5, 5, 20 * 86_400), "barriers")
    return t.select("symbol", F.col("entered").cast("timestamp_ntz").alias("entered"), "hit", "used", "reason")


@query(f"WITH {_TK}, l AS (SELECT *, list(value) OVER ({_TO} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS vs, value - lag(value) OVER ({_TO}) AS d FROM td), m AS (SELECT *, list(greatest(d, 0.0)) FILTER (WHERE d IS NOT NULL) OVER ({_TO} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ups, list(greatest(-d, 0.0)) FILTER (WHERE d IS NOT NULL) OVER ({_TO} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS downs FROM l), w AS (SELECT *, list_reduce(vs, lambda p, q: p + {2 / 11} * (q - p)) AS e, {_wilder('ups', 14)} AS u, {_wilder('downs', 14)} AS v FROM m) SELECT symbol, ts, round(e, 6) + 0.0 AS ema, round(100 * u / nullif(u + v, 0), 4) + 0.0 AS rsi FROM w")
def streaming_smoothing(spark, sf_dir):
    t = _stream(spark, sf_dir, lambda t: sst.smoothed(t, 10, 14), "smoothing")
    return t.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), (F.round("ema", 6) + 0.0).alias("ema"), (F.round("rsi", 4) + 0.0).alias("rsi"))


@query(f"WITH {_TK}, b AS (SELECT *, max(value) OVER w AS hi, min(value) OVER w AS lo FROM td WHERE CAST(symbol AS BIGINT) % 3 <> 0 WINDOW w AS ({_TO} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), o AS (SELECT *, max(CASE WHEN hi > 400 OR lo < 0.01 OR hi / lo > 500 THEN 1 ELSE 0 END) OVER ({_TO} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gone FROM b) SELECT symbol, ts, round(value, 6) + 0.0 AS value FROM o WHERE gone = 0")
def streaming_universe(spark, sf_dir):
    known = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("symbol")).where("cast(symbol as bigint) % 3 <> 0")
    t = _stream(spark, sf_dir, lambda t: sst.universe(t, known, 400.0, 0.01, 500.0), "universe")
    return t.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), (F.round("value", 6) + 0.0).alias("value"))


# permutations, portfolio variance, repeated keys, trading weeks, one model job

_PT = "pt AS (SELECT o_orderkey AS k, o_totalprice AS price, CAST(o_custkey % 7 AS DOUBLE) AS cust, CASE WHEN o_totalprice * (1 + o_orderkey % 3) > 400000 THEN 1 ELSE 0 END AS y FROM orders)"


def _pf(c: str) -> str:
    return f"SELECT '{c}' AS feature, k, y, CAST(least(floor(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) * 10), 9) AS INTEGER) AS bin FROM pt"


@query(f"WITH {_PT}, lg AS ({_pf('price')} UNION ALL {_pf('cust')}), pl AS (SELECT j, k, CAST('0x' || substr(md5('42:' || j || ':' || k), 1, 13) AS BIGINT) AS r, y FROM pt, range(19) q(j)), pr AS (SELECT j, k, CASE WHEN row_number() OVER (PARTITION BY j ORDER BY r) <= sum(y) OVER (PARTITION BY j) THEN 1 ELSE 0 END AS py FROM pl), al AS (SELECT feature, -1 AS j, bin, y FROM lg UNION ALL SELECT feature, pr.j, bin, py FROM lg JOIN pr USING (k)), c AS (SELECT feature, j, bin, y, count(*) AS n FROM al GROUP BY ALL), p AS (SELECT *, sum(n) OVER (PARTITION BY feature, j, bin) AS nx, sum(n) OVER (PARTITION BY feature, j, y) AS ny, sum(n) OVER (PARTITION BY feature, j) AS nn FROM c), m AS (SELECT feature, j, sum(n / nn * ln(n * nn / (nx * ny))) AS mi FROM p GROUP BY 1, 2), t AS (SELECT m.feature, max(o.mi) AS mi, avg(m.mi) AS rm, stddev_pop(m.mi) AS rs, (count(*) FILTER (WHERE m.mi >= o.mi - 1e-12) + 1) / 20 AS p FROM m JOIN m o ON m.feature = o.feature AND o.j = -1 WHERE m.j >= 0 GROUP BY 1), q AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, feature) AS raw FROM t) SELECT feature, round(mi, 6) + 0.0 AS mi, round(rm, 6) + 0.0 AS random_mean, round(rs, 6) + 0.0 AS random_dev, round(p, 6) + 0.0 AS p, round(least(min(raw) OVER (ORDER BY p, feature ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0), 6) + 0.0 AS q FROM q")
def permutation_significance(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"), (F.col("o_custkey") % 7).cast("double").alias("cust"), (F.col("o_totalprice") * (1 + F.col("o_orderkey") % 3) > 400000).cast("int").alias("y"))
    return shown(sg.permutation_test(rows, "k", ["price", "cust"], "y", n=19), ["feature"], ["mi", "random_mean", "random_dev", "p", "q"], 6)


@query(chain(*_P, _EQ) + ", sg AS (SELECT symbol, stddev_samp(actual_return) AS sigma FROM signals GROUP BY 1), rr AS (SELECT symbol, week, actual_return AS r FROM signals), co AS (SELECT x.symbol AS a, y.symbol AS b, corr(x.r, y.r) AS corr FROM rr x JOIN rr y ON x.week = y.week AND x.symbol < y.symbol GROUP BY 1, 2 HAVING count(*) >= 20), w AS (SELECT week, symbol, weight * sigma AS r FROM eq JOIN sg USING (symbol)), v AS (SELECT week, sum(r * r) AS v FROM w GROUP BY 1 UNION ALL SELECT x.week, 2 * sum(corr * x.r * y.r) FROM w x JOIN w y ON x.week = y.week AND x.symbol < y.symbol JOIN co ON co.a = x.symbol AND co.b = y.symbol WHERE isfinite(corr) GROUP BY 1) SELECT week, round(sum(v), 8) + 0.0 AS variance, round(sqrt(greatest(sum(v), 0)), 6) + 0.0 AS volatility FROM v GROUP BY 1")
def portfolio_variance(spark, sf_dir):
    s = signals(spark, sf_dir)
    r = s.select("symbol", "week", F.col("actual_return").alias("r"))
    top = pf.equal_top(s)
    v = pf.variance(top, s.groupBy("symbol").agg(F.stddev_samp("actual_return").alias("sigma")), pf.held_correlations(top, r))
    return v.select("week", (F.round("variance", 8) + 0.0).alias("variance"), (F.round("volatility", 6) + 0.0).alias("volatility"))


@query("WITH l AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, l_quantity, row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE) ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS k FROM lineitem), r AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, l_extendedprice AS price, row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE) ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS k FROM lineitem WHERE l_returnflag <> 'N') SELECT l_suppkey, day, CAST(k AS INTEGER) AS occurrence, l_quantity, round(price, 4) + 0.0 AS price FROM l JOIN r USING (l_suppkey, day, k)")
def repeated_keys_aligned(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    right = t.where("l_returnflag <> 'N'").select("l_suppkey", "day", F.col("l_extendedprice").alias("price"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"))
    got = tb.aligned(t, right, ["l_suppkey", "day"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], ["price", "o", "n"])
    return shown(got, ["l_suppkey", "day", "occurrence", "l_quantity"], ["price"], 4)


@query(chain(BARS, "d AS (SELECT DISTINCT date FROM bars WHERE symbol IN ('S1', 'S2'))", "w AS (SELECT CAST(date_trunc('week', date) AS DATE) AS week, min(date) AS first_day, max(date) AS last_day, CAST(count(*) AS BIGINT) AS n_days FROM d GROUP BY 1)") + " SELECT *, lead(first_day) OVER (ORDER BY week) AS next_first, lag(last_day) OVER (ORDER BY week) AS previous_last FROM w")
def trading_weeks(spark, sf_dir):
    return tb.trading_weeks(bars(spark, sf_dir).where("symbol in ('S1', 'S2')"))


@query(chain(BARS, "d AS (SELECT DISTINCT date FROM bars WHERE symbol IN ('S1', 'S2'))", "w AS (SELECT CAST(date_trunc('week', date) AS DATE) AS week, min(date) AS week_first, max(date) AS week_last FROM d GROUP BY 1)", "o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders)", "b AS (SELECT o.*, d.date AS on_or_before FROM o ASOF LEFT JOIN d ON o.day >= d.date)", "a AS (SELECT o.*, d.date AS on_or_after FROM o ASOF LEFT JOIN d ON o.day <= d.date)") + " SELECT b.o_orderkey, b.day, on_or_before, on_or_after, week_first, week_last FROM b JOIN a USING (o_orderkey) LEFT JOIN w ON w.week = CAST(date_trunc('week', b.day) AS DATE)")
def snapped_days(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return tb.snapped(o, "day", bars(spark, sf_dir).where("symbol in ('S1', 'S2')").select("date")).select("o_orderkey", "day", "on_or_before", "on_or_after", "week_first", "week_last")


@query(None)
def model_by_weekly_fold(spark, sf_dir):
    """Out-of-fold scores of boosted trees with isotonic calibration, measured by weekly fold."""
    b = ft.returns(lb.with_atr(bars(spark, sf_dir))).withColumns({"rv": F.col("atr") / F.col("close"), "rel": F.col("close") / F.col("open")})
    t = lb.first_touch(b, 3.0, 3.0, _H).select("symbol", F.col("date").alias("entry"), F.col("t_hit").alias("exit"), (F.col("hit") == 1).cast("double").alias("y"), F.coalesce("ret", F.lit(0.0)).alias("ret"), "rv", "rel", "volume").persist()
    folds = ev.walk_forward(t, 150, 100)
    _, metrics = md.out_of_fold(folds, ["ret", "rv", "rel", "volume"], "y", "entry", "symbol", maxIter=3, maxDepth=3)
    return shown(metrics, ["fold", "n", "train_n"], ["auc", "brier", "calibrated_brier", "top", "bottom"], 3)


# both sides of an entry

_BS = ["mfe_long", "mae_long", "mfe_short", "mae_short"]
_BSD = ["stop_day_long", "stop_day_short", "stop_first_long", "stop_first_short"]


@query(chain(BARS, ATR, _NEXT) + f", e AS (SELECT symbol, date, close, atr, nx, count(*) OVER ({S} ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING) AS more FROM nx), m AS (SELECT *, (list_max(list_transform(nx, lambda b: b.h)) - close) / atr AS up, (list_min(list_transform(nx, lambda b: b.l)) - close) / atr AS dn, {', '.join(f'coalesce(nullif(coalesce(list_position(list_transform(nx, lambda b: {t}), true), 0), 0) - 1, 21) AS {n}' for n, t in (('sl', 'b.l <= close - 1.0 * atr'), ('ss', 'b.h >= close + 1.0 * atr'), ('tl', 'b.h >= close + 1.5 * atr'), ('ts', 'b.l <= close - 1.5 * atr')))} FROM e WHERE close > 0 AND atr > 0 AND more > 20), f AS (SELECT *, up AS mfe_long, dn AS mae_long, -dn AS mfe_short, -up AS mae_short FROM m WHERE abs(up) <= 50 AND abs(dn) <= 50) SELECT symbol, date, {out(_BS)}, CAST(sl AS INTEGER) AS stop_day_long, CAST(ss AS INTEGER) AS stop_day_short, sl < tl AS stop_first_long, ss < ts AS stop_first_short FROM f")
def both_sides(spark, sf_dir):
    return shown(lb.both_sides(lb.with_atr(bars(spark, sf_dir))), [*KEYS, *_BSD], _BS)
