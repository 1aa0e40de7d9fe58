"""Composed sources: the stock panel of a universe, weekly panels with their benchmarks, prepared bars, and named parameter tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import panel as pn
from ..operators import quality as ql
from ..operators import tables as tb
from .bars import newest, read_bars, read_universe, universe_symbols, upsert_missing


def stock_panel(spark: SparkSession, caches: list[str], universe: str, most: int | None = None, sectors: bool = False) -> DataFrame:
    """Bars of the newest of the caches, of the symbols that the universe CSV lists and that can be traded (the first most of its lines, if asked for),
    without symbols whose prices can't be right; sectors: with each symbol's sector, and only symbols that have one. None of the caches there: an error."""
    path = newest(spark, caches)
    if path is None:
        raise FileNotFoundError(f"none of {caches} is there")
    listed = universe_symbols(spark, universe, most)
    chosen = spark.createDataFrame([(s,) for s in listed], "symbol string")
    if sectors:
        named = read_universe(spark, universe).where(F.col("sector").isNotNull() & (F.col("sector") != "")).select("symbol", "sector")
        chosen = chosen.join(named, "symbol")
    return ql.plausible_prices(read_bars(spark, path).join(pn.small(chosen), "symbol"))


def weekly_panel(daily: DataFrame | None, weekly: DataFrame | None = None, symbols: Iterable[str] | None = None, least: int = 10) -> DataFrame:
    """Weekly bars of the symbols: the weekly table where there is one, else the daily one resampled to Fridays. Weeks without a price, and symbols of fewer than
    least weeks, are left out."""
    if weekly is None and daily is None:
        raise ValueError("neither daily nor weekly bars")
    source = daily if weekly is None else weekly
    if symbols is not None:
        source = source.where(F.col("symbol").isin(list(symbols)))
    table = pn.resample(source).drop("ret") if weekly is None else source
    table = table.where(F.coalesce("adjclose", "close").isNotNull())
    many = table.groupBy("symbol").agg(F.count("*").alias("__n")).where(F.col("__n") >= least)
    return table.join(many.select("symbol"), "symbol", "left_semi")


def with_benchmarks(weekly: DataFrame, daily: DataFrame, names: Iterable[str], least: int = 10) -> DataFrame:
    """A weekly panel with those of the named benchmarks that it lacks, resampled from daily bars."""
    return upsert_missing(weekly, weekly_panel(daily, symbols=names, least=least))


def prepared(stocks: DataFrame, funds: DataFrame | None = None, symbols: Iterable[str] | None = None, adjust: bool = True) -> DataFrame:
    """Bars of the symbols from stocks, and from funds those that stocks lack, with all metrics and prices adjusted."""
    table = stocks if funds is None else upsert_missing(stocks, funds)
    return tb.assembled(table if symbols is None else table.where(F.col("symbol").isin(list(symbols))), adjust)


def write_parameters(table: DataFrame, path: str, kind: str, as_of: str) -> None:
    """Calibrated thresholds, a mapping, or sizing parameters under their kind and date, as Parquet for jobs and JSON lines for people; latest is what was written
    last. Nested columns keep their form."""
    place = f"{path}/{kind}"
    table.write.mode("overwrite").parquet(f"{place}/{as_of}")
    written = table.sparkSession.read.parquet(f"{place}/{as_of}")
    written.write.mode("overwrite").parquet(f"{place}/latest")
    written.write.mode("overwrite").option("ignoreNullFields", False).json(f"{place}/json/{as_of}")


def read_parameters(spark: SparkSession, path: str, kind: str, as_of: str = "latest") -> DataFrame:
    return spark.read.parquet(f"{path}/{kind}/{as_of}")
