"""Putting tables together and telling what is in them: price adjustment, joins of features, labels and predictions, checks of
columns and keys, and reports on them. Reports are one aggregate over the rows, whatever the number of columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType

from .panel import small
from .quality import extreme_returns

METRICS = ("open", "high", "low", "close", "adjclose", "volume")


def adjusted(bars: DataFrame) -> DataFrame:
    """Open, high, low and close times adjclose / close; the factor is 1 where it can't be told. Volume stays."""
    good = (F.col("close") != 0) & F.col("close").isNotNull() & F.col("adjclose").isNotNull()
    factor = F.coalesce(F.when(good, F.col("adjclose") / F.col("close")), F.lit(1.0))
    return bars.withColumns({c: F.col(c) * factor for c in ("open", "high", "low", "close") if c in bars.columns})


def assembled(bars: DataFrame, adjust: bool = True) -> DataFrame:
    """Bars with all metrics, null where a source lacks one, adjusted."""
    whole = bars.withColumns({m: F.lit(None).cast("double") for m in METRICS if m not in bars.columns}) if set(METRICS) - set(bars.columns) else bars
    return adjusted(whole) if adjust else whole


def newest(caches: dict[str, DataFrame], loaded: str = "loaded") -> DataFrame:
    """The rows of each symbol from the cache that was loaded last, with the cache's name as source; of equals the first in the alphabet."""
    whole = reduce(DataFrame.unionByName, (t.withColumn("source", F.lit(n)) for n, t in caches.items()))
    each = whole.groupBy("symbol", "source").agg(F.max(loaded).alias("__l"))
    order = Window.partitionBy("symbol").orderBy(F.desc_nulls_last("__l"), "source")
    best = each.withColumn("__k", F.row_number().over(order)).where("__k = 1").select("symbol", "source")
    return whole.join(best, ["symbol", "source"], "left_semi")


def filter_counts(rows: DataFrame, columns: list[str], **options) -> DataFrame:
    """One row: how many rows the filter of extreme returns is given, keeps and removes."""
    before = rows.agg(F.count("*").alias("n_before"))
    after = extreme_returns(rows, columns, **options).agg(F.count("*").alias("n_after"))
    return before.join(F.broadcast(after)).withColumn("n_removed", F.col("n_before") - F.col("n_after"))


def deduplicated(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key without nulls: the first by order."""
    whole = rows.where(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys]))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return whole.withColumn("__k", place).where("__k = 1").drop("__k")


def kept(rows: DataFrame, keep: list[str], retired: list[str] = []) -> DataFrame:  # noqa: B006
    """The columns of keep that are there, in that order, without the retired ones."""
    return rows.select(*(c for c in keep if c in rows.columns and c not in retired))


def downcast(rows: DataFrame) -> DataFrame:
    """Doubles as floats, and longs as ints where all their values fit (one pass over the longs tells), for a sink."""
    longs = [f.name for f in rows.schema if isinstance(f.dataType, LongType)]
    fits = set()
    if longs:
        ends = rows.agg(*(f(c).alias(f"{a}{i}") for i, c in enumerate(longs) for a, f in (("l", F.min), ("h", F.max)))).first()
        fits = {c for i, c in enumerate(longs) if ends[f"l{i}"] is None or -(1 << 31) <= ends[f"l{i}"] and ends[f"h{i}"] < 1 << 31}
    kind = lambda f: "float" if isinstance(f.dataType, DoubleType) else "int" if f.name in fits else None
    return rows.select(*(F.col(f.name).cast(kind(f)).alias(f.name) if kind(f) else F.col(f.name) for f in rows.schema))


def schema_problems(rows: DataFrame, required: dict[str, type]) -> list[str]:
    """What the schema lacks: columns that are missing, or of another type than a number where one is asked for."""
    have = {f.name: f.dataType for f in rows.schema}
    numbers = (DoubleType, FloatType, IntegerType, LongType)
    return [f"{c} is missing" if c not in have else f"{c} is {have[c].simpleString()}" for c, t in required.items() if c not in have or t in numbers and not isinstance(have[c], numbers)]


def prefixed(rows: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    return rows.withColumnsRenamed({c: f"{prefix}{c}" for c in rows.columns if c not in keys})


def column_profile(rows: DataFrame, columns: list[str], most_null: float = 0.5, most: float = 1e6) -> DataFrame:
    """Per column: null share, least, greatest, and whether it looks wrong: mostly null, constant, or out of all bounds."""
    one = rows.agg(*(F.struct(F.avg(F.col(c).isNull().cast("double")).alias("null_share"), F.min(F.col(c).cast("double")).alias("least"), F.max(F.col(c).cast("double")).alias("greatest")).alias(c) for c in columns))
    out = one.unpivot([], columns, "feature", "s").select("feature", "s.null_share", "s.least", "s.greatest")
    odd = (F.col("null_share") > most_null) | (F.col("least") == F.col("greatest")) | (F.greatest(F.abs("least"), F.abs("greatest")) > most)
    return out.withColumn("anomaly", F.coalesce(odd, F.lit(True)))


def registry_report(rows: DataFrame, registry: DataFrame, sparse: float = 0.3) -> DataFrame:
    """registry (feature, category) against the columns of rows: state valid, sparse, missing, or unregistered, with the null share."""
    names = [c for c in rows.columns if c not in ("symbol", "date")]
    shares = rows.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in names)).unpivot([], names, "feature", "null_share")
    met = registry.join(shares, "feature", "full")
    state = F.when(F.col("null_share").isNull(), "missing").when(F.col("category").isNull(), "unregistered").when(F.col("null_share") > sparse, "sparse").otherwise("valid")
    return met.withColumn("state", state)


def coverage_by_category(report: DataFrame) -> DataFrame:
    """Per category of a registry report: features that are there and that are missing."""
    return report.where("category is not null").groupBy("category").agg(F.count_if(F.col("state") != "missing").alias("n_present"), F.count_if(F.col("state") == "missing").alias("n_missing"))


def coverage_summary(coverage: DataFrame) -> DataFrame:
    """coverage (symbol, feature, null_pct): mean, greatest and least null share of each feature over symbols."""
    return coverage.groupBy("feature").agg(F.avg("null_pct").alias("mean_null"), F.max("null_pct").alias("max_null"), F.min("null_pct").alias("min_null"), F.count("*").alias("n_symbols"))


def freshness(bars: DataFrame, features: list[str], today, least: int = 100) -> DataFrame:
    """One row: the newest date on which more than least symbols have a close, how many days ago it is, and the share of features there on it."""
    day = bars.groupBy("date").agg(F.count("close").alias("n"), F.avg(reduce(Column.__add__, [F.col(f).isNotNull().cast("double") for f in features]) / len(features)).alias("available"))
    good = F.col("n") > least
    return day.agg(F.max(F.when(good, F.col("date"))).alias("newest"), F.max_by(F.when(good, F.col("available")), F.when(good, F.col("date"))).alias("available")).withColumn("days_ago", F.datediff(F.lit(today).cast("date"), "newest"))


def matrix_checks(rows: DataFrame, features: list[str], label: str) -> DataFrame:
    """One row: rows, features that are all null, constant features, share of the rarer class."""
    null = [(F.count(f) == 0).cast("int") for f in features]
    same = [((F.count(f) > 0) & (F.min(f) == F.max(f))).cast("int") for f in features]
    share = F.avg((F.col(label) == 1).cast("double"))
    out = rows.agg(F.count("*").alias("n_rows"), reduce(Column.__add__, null).alias("n_all_null"), reduce(Column.__add__, same).alias("n_constant"), share.alias("__p"))
    return out.withColumn("minority_share", F.least("__p", 1 - F.col("__p"))).drop("__p")


def features_with_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Inner join on symbol and date; columns that both have come from the features."""
    fresh = [c for c in labels.columns if c not in features.columns]
    return features.join(labels.select("symbol", "date", *fresh), ["symbol", "date"])


def signal_table(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Predictions (symbol, date, prob) with what became of them, under the names of a signal table and with the Monday of their week."""
    both = predictions.withColumnRenamed("prob", "probability").join(labels, ["symbol", "date"])
    return both.withColumnsRenamed({"date": "signal_date", "t_hit": "actual_exit_date", "price_hit": "actual_exit_price", "ret_from_entry": "actual_return", "h_used": "holding_days"}).withColumn("week_monday", F.date_trunc("week", "signal_date").cast("date"))


def suffixed_join(left: DataFrame, right: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    """Left join; columns of right that left has too get a suffix."""
    return left.join(right.withColumnsRenamed({c: f"{c}{suffix}" for c in right.columns if c in left.columns and c not in keys}), keys, "left")


def weekly_last(series: DataFrame, x: str) -> DataFrame:
    """week (Monday) and the last value of x in it."""
    return series.where(F.col(x).isNotNull()).groupBy(F.date_trunc("week", "date").cast("date").alias("week")).agg(F.max_by(x, "date").alias(x))


def regime_of_week(signals: DataFrame, series: DataFrame, x: str, levels: list[float], names: list[str]) -> DataFrame:
    """signals with the state of a series in their week, which one row a week tells."""
    from .macro import state

    weekly = weekly_last(series, x).select("week", state(x, levels, names).alias("regime"))
    return signals.join(small(weekly), "week", "left")


def with_sector(rows: DataFrame, sectors: DataFrame) -> DataFrame:
    """rows with their sector, 'Unknown' where none is known."""
    return rows.join(small(sectors), "symbol", "left").withColumn("sector", F.coalesce("sector", F.lit("Unknown")))


def signature(rows: DataFrame, by: list[str], x: str) -> DataFrame:
    """md5 of the sorted distinct values of x in each group: equal for equal sets."""
    return rows.groupBy(*by).agg(F.md5(F.array_join(F.array_sort(F.collect_set(F.col(x).cast("string"))), ",")).alias("signature"), F.countDistinct(x).alias("n"))


def settings(rows: DataFrame, x: str, kind: str = "map<string,string>") -> DataFrame:
    """key and value of JSON objects."""
    return rows.select(*(c for c in rows.columns if c != x), F.explode(F.from_json(x, kind)).alias("key", "value"))


def filled_both_ways(left: DataFrame, series: DataFrame, x: str) -> DataFrame:
    """left with the last value of a series of one row a date at or before its date; before the first, the first."""
    from .panel import as_of

    keyed, one = left.withColumn("__one", F.lit(1)), series.where(F.col(x).isNotNull()).select("date", x).withColumn("__one", F.lit(1))
    first = one.agg(F.min_by(x, "date").alias("__first"))
    # the series is short; its last values by date serve all symbols
    days = as_of(keyed.select("__one", "date").distinct(), one, [x], ["__one"]).select("date", x)
    return left.join(small(days), "date", "left").join(F.broadcast(first)).withColumn(x, F.coalesce(x, "__first")).drop("__first")


def occurrences(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """occurrence: the number of a row among those that share its keys, from 1, in the given order; null keys are a key."""
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def aligned(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str], right_order: list[str], how: str = "inner") -> DataFrame:
    """Rows of both sides with equal keys, the first with the first, the second with the second: repeated keys pair up one to one instead of all with all. Null keys match.
    Columns of right that left has too are left out."""
    own = [c for c in right.columns if c not in left.columns]
    a = occurrences(left, keys, left_order)
    both = [*keys, "occurrence"]
    b = occurrences(right, keys, right_order).select(*(F.col(k).alias(f"__right_{k}") for k in both), *own)
    met = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in both])
    one = lambda k: F.coalesce(k, f"__right_{k}").alias(k)
    return a.join(b, met, how).select(*(one(k) if k in keys else F.col(k) for k in left.columns), one("occurrence"), *own)


def with_row_ids(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """row_id: a digest of keys and occurrence, unique and the same in every run, to carry labels and weights of a panel with repeated keys."""
    return occurrences(rows, keys, order).withColumn("row_id", F.sha2(F.to_json(F.struct(*keys, "occurrence")), 256)).drop("occurrence")


def trading_weeks(calendar: DataFrame) -> DataFrame:
    """calendar: date, the days that exist. A row a week (by its Monday) that has days: week, first_day, last_day, n_days, next_first (of the next week there is) and
    previous_last."""
    weeks = calendar.where("date is not null").groupBy(F.date_trunc("week", "date").cast("date").alias("week")).agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.countDistinct("date").alias("n_days"))
    order = Window.orderBy("week")  # one row a week
    return weeks.withColumns({"next_first": F.lead("first_day").over(order), "previous_last": F.lag("last_day").over(order)})


def snapped(rows: DataFrame, date: str, calendar: DataFrame) -> DataFrame:
    """rows with the days of the calendar that a date's week really has: on_or_after and on_or_before (the nearest existing days, in other weeks if need be), week_first and
    week_last (null for a week without days). Asked dates and days are one small table of a row a date."""
    days = calendar.where("date is not null").select("date").distinct()
    order = Window.orderBy("date")  # one row a day
    asked = rows.select(F.col(date).alias("date")).where("date is not null").distinct()
    both = days.withColumn("day", F.col("date")).unionByName(asked.withColumn("day", F.lit(None).cast("date"))).groupBy("date").agg(F.max("day").alias("day"))
    near = both.withColumns({"on_or_before": F.last("day", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "on_or_after": F.first("day", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))})
    weeks = trading_weeks(calendar).select("week", F.col("first_day").alias("week_first"), F.col("last_day").alias("week_last"))
    near = near.withColumn("week", F.date_trunc("week", "date").cast("date")).join(small(weeks), "week", "left").select(F.col("date").alias(date), "on_or_before", "on_or_after", "week_first", "week_last")
    return rows.join(small(near), date, "left")
