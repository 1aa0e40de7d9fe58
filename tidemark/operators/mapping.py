"""Which sector, subsector and benchmark a symbol belongs to, with how much confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import small


def by_keyword(universe: DataFrame, keywords: DataFrame, about: str = "description") -> DataFrame:
    """symbol, group, score: the group whose keywords' weights in the description add up to most. keywords: group, word, weight; it is a
    short list, checked before it is broadcast."""
    met = universe.join(small(keywords), F.lower(F.col(about)).contains(F.col("word")))
    score = met.groupBy("symbol", "group").agg(F.sum("weight").alias("score"))
    order = Window.partitionBy("symbol").orderBy(F.desc("score"), "group")
    return score.withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k")


def subsector(universe: DataFrame, explicit: DataFrame, keywords: DataFrame, gains: DataFrame) -> DataFrame:
    """symbol, subsector: from the explicit table, else by keyword, else where the correlation gain is at least 0.03."""
    best = gains.where("gain >= 0.03").groupBy("symbol").agg(F.max_by("group", F.struct("gain", "group")).alias("__c"))
    named = by_keyword(universe, keywords).select("symbol", F.col("group").alias("__b"))
    table = universe.select("symbol").join(small(explicit.select("symbol", F.col("group").alias("__a"))), "symbol", "left")
    return table.join(named, "symbol", "left").join(best, "symbol", "left").select("symbol", F.coalesce("__a", "__b", "__c").alias("subsector"))


def confidence(table: DataFrame, corr: str = "corr", n: str = "n") -> DataFrame:
    rule = F.when((F.col(corr) >= 0.6) & (F.col(n) >= 500), "high").when((F.col(corr) >= 0.3) & (F.col(n) >= 100), "medium").otherwise("low")
    return table.withColumn("confidence", rule)


def validation(table: DataFrame) -> DataFrame:
    """Per confidence: symbols and mean correlation."""
    return table.groupBy("confidence").agg(F.count("*").alias("n_symbols"), F.avg("corr").alias("mean_corr"))


def gains(correlations: DataFrame, sector_of: DataFrame) -> DataFrame:
    """symbol, group, gain: how much better each benchmark correlates than the symbol's own sector."""
    own = correlations.join(small(sector_of), "symbol").where(F.col("bench") == F.col("sector")).select("symbol", F.col("corr").alias("own"))
    return correlations.join(own, "symbol").select("symbol", F.col("bench").alias("group"), (F.col("corr") - F.col("own")).alias("gain"))


def by_gain(sector_of: DataFrame, gains: DataFrame, least: float = 0.03) -> DataFrame:
    """symbol, subsector: the benchmark that correlates better than the own sector by most, if by least at least; else the sector."""
    best = gains.where(F.col("gain") >= least).groupBy("symbol").agg(F.max_by("group", F.struct("gain", "group")).alias("__b"))
    return sector_of.join(small(best), "symbol", "left").select("symbol", F.coalesce("__b", "sector").alias("subsector"))


def record(universe: DataFrame, sector_bench: DataFrame, equal: DataFrame, subsectors: DataFrame, correlations: DataFrame, market: str = "SPY", market_equal: str = "RSP") -> DataFrame:
    """The whole mapping, one row a symbol of universe (symbol, sector, market_cap): csv_sector, sector_etf, equal_weight_etf, subsector_etf, correlations,
    confidence, market_cap.

    sector_bench: sector (any case), bench; equal: bench, equal_bench; subsectors: symbol, subsector (null or no row: none); correlations: symbol, bench,
    corr, as panel.correlations makes them. Sectors without a benchmark take the market; symbols without a sector are left out. correlations is a
    struct of market, market_ew, sector, sector_ew and subsector, each null where it could not be measured. A symbol's correlations become one map of
    as many entries as there are benchmarks, so there is one join by symbol for all five."""
    named = sector_bench.select(F.lower("sector").alias("__sector"), F.col("bench").alias("__bench"))
    rows = universe.where(F.col("sector").isNotNull()).withColumn("__sector", F.lower("sector")).join(small(named), "__sector", "left")
    rows = rows.withColumn("sector_etf", F.coalesce("__bench", F.lit(market))).drop("__sector", "__bench")
    rows = rows.join(small(equal.select(F.col("bench").alias("sector_etf"), F.col("equal_bench").alias("equal_weight_etf"))), "sector_etf", "left")
    rows = rows.join(subsectors.select("symbol", F.col("subsector").alias("subsector_etf")), "symbol", "left")
    held = correlations.where(F.col("corr").isNotNull()).groupBy("symbol").agg(F.map_from_entries(F.collect_set(F.struct("bench", "corr"))).alias("__of"))
    rows = rows.join(held, "symbol", "left")
    of = lambda bench: F.try_element_at("__of", bench)
    parts = {"market": of(F.lit(market)), "market_ew": of(F.lit(market_equal)), "sector": of(F.col("sector_etf")), "sector_ew": of(F.col("equal_weight_etf")), "subsector": of(F.col("subsector_etf"))}
    rows = rows.withColumn("correlations", F.struct(*(v.alias(k) for k, v in parts.items())))
    return rows.select("symbol", F.col("sector").alias("csv_sector"), "sector_etf", "equal_weight_etf", "subsector_etf", "correlations", _trust().alias("confidence"), F.coalesce(F.col("market_cap").cast("double"), F.lit(0.0)).alias("market_cap"))


def _of(name: str) -> Column:
    return F.coalesce(F.col("correlations")[name], F.lit(0.0))


def _trust() -> Column:
    """high: the sector explains the symbol well and a subsector, if any, does so better; medium: it explains it fairly; low: else."""
    better = F.col("subsector_etf").isNull() | (_of("subsector") > _of("sector") + 0.05)
    return F.when(_of("sector") > 0.6, F.when(better, "high").otherwise("medium")).when(_of("sector") > 0.4, "medium").otherwise("low")


def report(records: DataFrame) -> DataFrame:
    """One row of figures: symbols, how many of each confidence, mean sector correlation (unmeasured ones count as 0), shares with an equal-weight benchmark
    and with a subsector."""
    share = lambda c: F.avg(F.col(c).isNotNull().cast("double"))
    counts = [F.count(F.when(F.col("confidence") == level, 1)).alias(f"n_{level}") for level in ("high", "medium", "low")]
    return records.agg(F.count("*").alias("n_symbols"), *counts, F.avg(_of("sector")).alias("mean_sector_corr"), share("equal_weight_etf").alias("equal_weight_coverage"), share("subsector_etf").alias("subsector_coverage"))


def improvements(records: DataFrame, n: int = 10, least: float = 0.05) -> DataFrame:
    """The n symbols whose subsector correlates better than the sector by most, and by more than least; ties by symbol."""
    gain = _of("subsector") - _of("sector")
    rows = records.where(gain > least).select("symbol", "subsector_etf", _of("sector").alias("sector_corr"), _of("subsector").alias("subsector_corr"), gain.alias("improvement"))
    return rows.orderBy(F.desc("improvement"), "symbol").limit(n)


def reviews(records: DataFrame, n: int = 10, least: float = 0.1) -> DataFrame:
    """The n symbols whose sector correlates worse than the market by most, and by more than least; ties by symbol."""
    gap = _of("market") - _of("sector")
    rows = records.where(gap > least).select("symbol", "sector_etf", _of("sector").alias("sector_corr"), _of("market").alias("market_corr"), gap.alias("gap"))
    return rows.orderBy(F.desc("gap"), "symbol").limit(n)


def required(records: DataFrame, market: str = "SPY") -> DataFrame:
    """bench: every benchmark that the records or the market need."""
    each = records.select(F.explode(F.array(F.lit(market), "sector_etf", "subsector_etf")).alias("bench"))
    return each.where("bench is not null").distinct()
