"""Series that all symbols share: volatility regimes, cross-asset ratios, spreads and published series with a lag.

They come as (symbol, date, ...) rows like bars, with the series' name for a symbol, so the same windows serve."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import by_symbol, col, diff, div, lag, mean, rows, std0, zscore
from .features import prior_percentile, spread

#: The levels that part volatility regimes.
LEVELS = (15.0, 20.0, 30.0)


def state(x: str | Column, levels: list[float] | tuple[float, ...], names: list | None = None) -> Column:
    """Which interval x lies in, counted from 0 or by name; a level belongs to the interval above it."""
    out = F.lit(names[-1] if names else len(levels))
    for k, level in reversed(list(enumerate(levels))):
        out = F.when(col(x) < level, F.lit(names[k] if names else k)).otherwise(out)
    return F.when(col(x).isNotNull(), out)


def regime(table: DataFrame, x: str, levels=LEVELS, w: int = 252) -> DataFrame:
    """Percentile in the last w rows, z-score of 60 by sample deviation, regime by level, ratio to the mean of 20, changes over 5 and 20 rows."""
    out = prior_percentile(table.withColumn(x, F.when(F.col(x) > 0, F.col(x))), x, w - 1, 49, f"{x}_pct")
    return out.withColumns({f"{x}_z": zscore(x, 60, 20, sample=True), f"{x}_regime": state(x, levels), f"{x}_ma20_ratio": div(x, mean(x, 20, 10)), f"{x}_chg5": div(x, lag(x, 5)) - 1, f"{x}_chg20": div(x, lag(x, 20)) - 1})


def wide_prices(bars: DataFrame, names: list[str], price: str = "close") -> DataFrame:
    """One row a date with a column for each name, as rows of the symbol 'ALL'."""
    wide = bars.where(F.col("symbol").isin(names)).groupBy("date").pivot("symbol", names).agg(F.first(price))
    return wide.select(F.lit("ALL").alias("symbol"), "date", *(F.col(n).alias(n.lower()) for n in names))


def first_available(bars: DataFrame, alternatives: list[str], price: str = "close") -> DataFrame:
    """date and the price of the first of the alternatives that has one there."""
    order = F.array_position(F.array(*map(F.lit, alternatives)), F.col("symbol"))
    return bars.where(F.col("symbol").isin(alternatives) & F.col(price).isNotNull()).groupBy("date").agg(F.min_by(price, order).alias(price))


def ratios(table: DataFrame, pairs: dict[str, tuple[str, str]], w: int = 60, least: int | None = None) -> DataFrame:
    """Ratios of columns and their z-scores by sample deviation."""
    out = table.withColumns({n: div(a, b) for n, (a, b) in pairs.items()})
    return out.withColumns({f"{n}_z": zscore(n, w, least, sample=True) for n in pairs})


def rolling_correlation(table: DataFrame, a: str, b: str, w: int = 60, least: int = 30, name: str = "corr") -> DataFrame:
    """Correlation of a and b over rows where both are there; null on a constant frame."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    out = table.withColumns({"__a": F.when(both, F.col(a)), "__b": F.when(both, F.col(b))})
    frame = rows(w)
    value = div(F.covar_samp("__a", "__b").over(frame), F.stddev_samp("__a").over(frame) * F.stddev_samp("__b").over(frame))
    return out.withColumn(name, F.when(F.count("__a").over(frame) >= least, value)).drop("__a", "__b")


def global_spreads(returns: DataFrame, pairs: dict[str, tuple[str, str | None]], windows=(20, 60, 120)) -> DataFrame:
    """Sums, z-score and slopes of differences of return columns; a pair without a second column is the first itself."""
    apart = lambda a, b: F.col(a) - F.col(b) if b else F.col(a)
    return reduce(lambda t, p: spread(t.withColumn(f"__{p[0]}", apart(*p[1])), f"__{p[0]}", p[0], windows).drop(f"__{p[0]}"), pairs.items(), returns)


def published(table: DataFrame, x: str, delay: int) -> DataFrame:
    """Level, differences and z-scores of a published series, delay rows of its own calendar late."""
    out = table.withColumns({f"{x}_level": F.col(x), f"{x}_chg5": diff(x, 5), f"{x}_chg20": diff(x, 20), f"{x}_z60": zscore(x, 60, 20, sample=True), f"{x}_z252": zscore(x, 252, 60, sample=True)})
    made = [f"{x}_level", f"{x}_chg5", f"{x}_chg20", f"{x}_z60", f"{x}_z252"]
    return out.withColumns({c: F.lag(c, delay).over(by_symbol()) for c in made}) if delay else out


def simple_rsi(table: DataFrame, x: str, w: int = 14) -> DataFrame:
    """RSI by plain means of gains and losses."""
    out = table.withColumn("__d", diff(x))
    up, down = mean(F.when(F.col("__d").isNotNull(), F.greatest("__d", F.lit(0.0))), w, w), mean(F.when(F.col("__d").isNotNull(), F.greatest(-F.col("__d"), F.lit(0.0))), w, w)
    return out.withColumns({"__u": up, "__v": down}).withColumn(f"{x}_rsi{w}", 100 * div("__u", F.col("__u") + F.col("__v"))).drop("__d", "__u", "__v")


def combined_state(table: DataFrame, parts: list[str], name: str) -> DataFrame:
    """Names of several states joined."""
    return table.withColumn(name, F.when(reduce(lambda a, b: a & b, [F.col(p).isNotNull() for p in parts]), F.concat_ws("_", *parts)))


def weekly_series(table: DataFrame, x: str) -> DataFrame:
    """symbol, date (the week's Friday) and the last value of x in the week."""
    from .panel import week_end

    return table.where(F.col(x).isNotNull()).groupBy("symbol", week_end().alias("week_end")).agg(F.max_by(x, "date").alias(x)).withColumnRenamed("week_end", "date")


def weekly_regime(weekly: DataFrame, x: str) -> DataFrame:
    """Percentile in 52 weeks, z-score of 12 by sample deviation, ratio to the mean of 4, changes over 1 and 4 weeks."""
    out = prior_percentile(weekly, x, 51, 11, f"{x}_pct52")
    return out.withColumns({f"{x}_z12": zscore(x, 12, 4, sample=True), f"{x}_ma4_ratio": div(x, mean(x, 4, 2)), f"{x}_chg1": div(x, lag(x, 1)) - 1, f"{x}_chg4": div(x, lag(x, 4)) - 1})


def weekly_published(weekly: DataFrame, x: str, delay: int = 1) -> DataFrame:
    """Level, difference over 4 weeks and z-score of 52, delay weeks late."""
    out = weekly.withColumns({f"{x}_level": F.col(x), f"{x}_chg4": diff(x, 4), f"{x}_z52": zscore(x, 52, 13, sample=True)})
    return out.withColumns({c: F.lag(c, delay).over(by_symbol()) for c in (f"{x}_level", f"{x}_chg4", f"{x}_z52")})
