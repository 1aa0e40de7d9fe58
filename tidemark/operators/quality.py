"""Filters, validity predicates and data-quality reports. Each is one or two aggregates over the table, never a loop over symbols."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import by_symbol, div, finite

#: Endings of symbols that aren't common shares (warrants, units, rights, preferred, foreign), each after a separator.
UNTRADEABLE = (r"[.\-/]W[S]?$", r"[.\-/]U$", r"[.\-/]R$", r"[.\-/]PR?[A-Z]?$", r"[.\-/]F$")
#: What their descriptions say (acquisition companies, depositary receipts, blank cheques).
DESCRIPTIONS = (r"ACQUISITION\s+(?:CORP|CO\b|COMPANY|LIMITED|INC)", r"\bADR\b|AMERICAN DEPOSITARY|DEPOSITARY SHARE|DEPOSITARY RECEIPT|^ADS-", r"BLANK CHECK")


def tradeable(universe: DataFrame, name: str = "symbol", about: str = "description", names=UNTRADEABLE, words=DESCRIPTIONS) -> DataFrame:
    """Rows whose symbol and description match none of the patterns, which are held against upper-case text."""
    bad = [F.coalesce(F.upper(F.col(c)).rlike(p), F.lit(False)) for c, patterns in ((name, names), (about, words)) for p in patterns]
    return universe.where(~reduce(Column.__or__, bad))


def plausible_prices(bars: DataFrame, price: str = "close", most: float = 50_000.0, least: float = 0.01, ratio: float = 1_000.0) -> DataFrame:
    """Rows of symbols whose prices stay within bounds."""
    span = bars.groupBy("symbol").agg(F.max(price).alias("hi"), F.min(price).alias("lo"))
    good = span.where((F.col("hi") <= most) & (F.col("lo") >= least) & (div("hi", "lo") <= ratio)).select("symbol")
    return bars.join(good, "symbol", "left_semi")


def valid_entry(close="close", atr="atr", least: float = 0.0) -> Column:
    return F.coalesce(finite(close).isNotNull() & finite(atr).isNotNull() & (F.col(close) > 0) & (F.col(atr) > least) & F.col("date").isNotNull(), F.lit(False))


def label_input(bars: DataFrame, least_rows: int = 25, most: float = 50_000.0, ratio: float = 1_000.0) -> DataFrame:
    """Rows fit for labelling: plausible symbols, valid rows, at least least_rows of them for a symbol."""
    rows = plausible_prices(bars, most=most, ratio=ratio).where(valid_entry())
    return rows.withColumn("__n", F.count("*").over(Window.partitionBy("symbol"))).where(F.col("__n") >= least_rows).drop("__n")


def extreme_returns(rows: DataFrame, columns: list[str], most: float = 1.0, z: float = 5.0, least: int = 10) -> DataFrame:
    """For each column in turn: drop non-finite values, then values beyond most, then beyond z deviations of what is left."""
    for c in columns:
        rows = rows.where(finite(c).isNotNull() & (F.abs(c) <= most))
        stats = rows.agg(F.avg(c).alias("__m"), F.stddev_samp(c).alias("__s"), F.count(c).alias("__n"))
        off = F.abs(F.col(c) - F.col("__m")) > z * F.col("__s")
        rows = rows.join(F.broadcast(stats)).where(~((F.col("__n") > least) & (F.col("__s") > 0) & off)).drop("__m", "__s", "__n")
    return rows


def enough_features(rows: DataFrame, features: list[str], ratio: float) -> DataFrame:
    return rows.dropna(thresh=int(len(features) * ratio), subset=features)


def fill_gaps(bars: DataFrame, x: str) -> DataFrame:
    """Interior gaps filled in a straight line over time; nothing is extrapolated."""
    before, after = by_symbol().rowsBetween(Window.unboundedPreceding, 0), by_symbol().rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(x).isNotNull(), F.col("date"))
    p, n = F.last(x, ignorenulls=True).over(before), F.first(x, ignorenulls=True).over(after)
    t, u = F.last(at, ignorenulls=True).over(before), F.first(at, ignorenulls=True).over(after)
    line = p + (n - p) * F.datediff("date", t) / F.nullif(F.datediff(u, t), F.lit(0))
    return bars.withColumn(f"{x}_filled", F.coalesce(F.col(x), line))


def symbol_quality(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Per symbol: rows, nulls, and the share of values that are there."""
    nulls = reduce(Column.__add__, [F.col(c).isNull().cast("int") for c in columns])
    out = rows.groupBy("symbol").agg(F.count("*").alias("n_rows"), F.sum(nulls).alias("n_null"))
    return out.withColumn("completeness", 1 - F.col("n_null") / (F.col("n_rows") * len(columns)))


def null_profile(rows: DataFrame, columns: list[str], categories: dict[str, str]) -> DataFrame:
    """Per feature: category by the first pattern that its name holds, null share and state; one pass over the rows."""
    shares = rows.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns)).unpivot([], columns, "feature", "null_share")
    category = F.lit("other")
    for pattern, name in reversed(list(categories.items())):
        category = F.when(F.col("feature").contains(pattern), name).otherwise(category)
    state = F.when(F.col("null_share") >= 0.9, "broken").when(F.col("null_share") < 0.5, "healthy").otherwise("sparse")
    return shares.withColumns({"category": category, "state": state})


def coverage(rows: DataFrame, features: list[str]) -> DataFrame:
    """Per symbol and feature: valid values, all values and null share in per cent."""
    long = rows.unpivot(["symbol"], features, "feature", "value")
    out = long.groupBy("symbol", "feature").agg(F.count("value").alias("n_valid"), F.count("*").alias("n_total"))
    return out.withColumn("null_pct", 100 * (1 - F.col("n_valid") / F.col("n_total")))


def latest_valid_date(bars: DataFrame, least: float = 0.8) -> DataFrame:
    """The newest date on which enough symbols have a close, else the date on which most have."""
    symbols = bars.select(F.countDistinct("symbol").alias("n"))
    share = bars.groupBy("date").agg(F.count("close").alias("k")).join(F.broadcast(symbols)).withColumn("share", F.col("k") / F.col("n"))
    return share.agg(F.coalesce(F.max(F.when(F.col("share") >= least, F.col("date"))), F.max_by("date", F.struct("share", "date"))).alias("date"))


def snapshot(bars: DataFrame, date) -> DataFrame:
    """Rows of the date nearest to the given one (the earlier of two), without null closes."""
    wanted = F.lit(date).cast("date")
    near = bars.agg(F.min_by("date", F.struct(F.abs(F.datediff("date", wanted)), F.col("date"))).alias("date"))
    return bars.join(F.broadcast(near), "date").where(F.col("close").isNotNull())


def signal_problems(signals: DataFrame) -> DataFrame:
    """How many rows break each rule of a signal table."""
    keys = signals.groupBy("symbol", "signal_date").count().where("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("duplicate_keys"))
    counts = signals.agg(F.count_if(F.col("probability").isNull()).alias("null_probability"), F.count_if((F.col("probability") < 0) | (F.col("probability") > 1)).alias("probability_out_of_range"), F.count_if(F.col("entry_price") <= 0).alias("price_not_positive"))
    return counts.join(F.broadcast(keys))


def top_symbols(rows: DataFrame, n: int, least: int) -> DataFrame:
    """Rows of the n symbols with the most rows, of those with at least least."""
    best = rows.groupBy("symbol").count().where(F.col("count") >= least).orderBy(F.desc("count"), "symbol").limit(n).select("symbol")
    return rows.join(F.broadcast(best), "symbol", "left_semi")


def feature_stats(rows: DataFrame, features: list[str]) -> DataFrame:
    """Per feature: variance, null share, and whether the usual filters keep it."""
    v = rows.agg(*(F.struct(F.var_samp(c).alias("variance"), F.avg(F.col(c).isNull().cast("double")).alias("null_share")).alias(c) for c in features))
    out = v.unpivot([], features, "feature", "s").select("feature", "s.variance", "s.null_share")
    return out.withColumn("kept", F.coalesce((F.col("variance") > 1e-12) & (F.col("null_share") <= 0.3), F.lit(False)))


def require_returns(rows: DataFrame, column: str = "ret") -> DataFrame:
    """rows as they are; an error if they have no such column or it isn't a number."""
    kind = dict(rows.dtypes).get(column)
    if kind is None:
        raise ValueError(f"no returns column {column} in {rows.columns}")
    if kind not in {"double", "float"} and not kind.startswith("decimal"):
        raise TypeError(f"returns column {column} is {kind}")
    return rows
