"""What position sizing takes in: features joined to signals, a transformation learnt on training signals alone, fallbacks for volatility and
liquidity, regimes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .training import apply_state, fitted_state

# Features that sizing looks for, the columns that measure volatility and liquidity, and the cuts of probability.
FEATURES = ("atr_percent", "volatility_21d", "volatility_63d", "trend_score", "trend_score_sign", "rsi_14", "volume_ratio_20d", "adv_20d", "dollar_volume", "alpha_mom_spy_20_ema10", "relative_strength_20d", "vix_regime", "vix_percentile_252d", "beta_market", "beta_spy_21d")
VOLATILITY, NO_VOLATILITY = ("atr_percent", "atr_pct"), 0.02
LIQUIDITY, NO_LIQUIDITY = ("adv_20d", "dollar_volume"), 1.0
CUTS = ((0.4, "very_low"), (0.5, "low"), (0.6, "medium"), (0.7, "high"), (1.0, "very_high"))


def merged(signals: DataFrame, features: DataFrame, names: Iterable[str] = FEATURES, date: str | None = None) -> DataFrame:
    """signals with those of the named columns that features have, of the same symbol and date; date: the signals' date column, week_monday or signal_date
    if not named. Columns that signals have too come as {name}_feat. Signals without a row keep nulls; features must be one row a symbol and date."""
    date = date or ("week_monday" if "week_monday" in signals.columns else "signal_date")
    taken = [n for n in names if n in features.columns]
    right = features.select(F.col("symbol").alias("__s"), F.col("date").alias("__d"), *(F.col(n).alias(f"{n}_feat" if n in signals.columns else n) for n in taken))
    return signals.join(right, (F.col("symbol") == F.col("__s")) & (F.col(date) == F.col("__d")), "left").drop("__s", "__d")


def fit(signals: DataFrame, features: DataFrame | None = None, names: Iterable[str] = FEATURES, date: str | None = None) -> DataFrame:
    """The state that transform takes, a row a feature: bounds at 1 and 99 per cent, mean and deviation within, of training signals alone. It can be
    written and read back. Features that the signals lack are not in it; without any it has no rows."""
    names = list(names)
    rows = signals if features is None else merged(signals, features, names, date)
    have = [n for n in names if n in rows.columns]
    if not have:
        return signals.sparkSession.createDataFrame([], "feature string, low double, high double, mean double, dev double")
    return fitted_state(rows, have)


def transform(signals: DataFrame, state: DataFrame, features: DataFrame | None = None, names: Iterable[str] = FEATURES, date: str | None = None, bound: float = 3.0) -> DataFrame:
    """signals whose sizing features are cut at the state's bounds and taken as z-scores within bound. A feature that was constant in training becomes 0
    where it has that value; one that the state lacks stays as it is."""
    names = list(names)
    rows = signals if features is None else merged(signals, features, names, date)
    known = {r[0] for r in state.select("feature").collect()}  # no more rows than names
    have = [n for n in names if n in rows.columns and n in known]
    if not have:
        return rows
    columns = rows.columns
    out = apply_state(rows, state.withColumn("dev", F.when(F.col("dev") != 0, F.col("dev")).otherwise(F.lit(1.0))), have, bound)
    return out.select(*(F.col(f"{c}_wz").alias(c) if c in have else F.col(c) for c in columns))


def sizing_features(signals: DataFrame, features: DataFrame, names: Iterable[str] = FEATURES, date: str | None = None) -> DataFrame:
    """Join, fit and transform in one call, for signals that serve as their own training rows."""
    rows = merged(signals, features, names, date)
    return transform(rows, fit(rows, names=names), names=names)


def _first(table: DataFrame, names: tuple[str, ...], default: float) -> Column:
    return next((F.col(n) for n in names if n in table.columns), F.lit(default))


def with_measures(table: DataFrame) -> DataFrame:
    """table with volatility and liquidity: the first column that measures it, else a constant (0.02 and 1)."""
    return table.withColumns({"volatility": _first(table, VOLATILITY, NO_VOLATILITY), "liquidity": _first(table, LIQUIDITY, NO_LIQUIDITY)})


def regimes(signals: DataFrame, series: DataFrame | None = None, date: str = "week_monday") -> DataFrame:
    """signals with the regimes that their columns allow: vix_regime of the same date from series (date, vix_regime) unless it is there, confidence_regime of
    the probability (a cut belongs to the interval below it; 0 and less have none), trend_regime of the sign of the trend."""
    from .panel import small

    out = signals
    if "vix_regime" not in out.columns and series is not None:
        out = out.join(small(series.select(F.col("date").alias("__d"), "vix_regime")), F.col(date) == F.col("__d"), "left").drop("__d")
    if "probability" in out.columns:
        p, named = F.col("probability"), F.lit(None).cast("string")
        for cut, name in reversed(CUTS):
            named = F.when(p <= cut, name).otherwise(named)
        out = out.withColumn("confidence_regime", F.when(p > 0, named))
    if "trend_score_sign" in out.columns:
        sign = F.col("trend_score_sign")
        out = out.withColumn("trend_regime", F.when(sign == -1, "bearish").when(sign == 0, "neutral").when(sign == 1, "bullish"))
    return out
