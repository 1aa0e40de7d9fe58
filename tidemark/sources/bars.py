"""Readers and writers of bars and the tables around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.windows import dealt

METRICS = ("open", "high", "low", "close", "adjclose", "volume")
#: Fixed value: the form of a tradeable symbol's name.
SYMBOL = r"^[A-Z\^][A-Z0-9\.]*$"


def bars_from_lines(lines: DataFrame) -> DataFrame:
    """Daily bars from order lines: a supplier is a symbol, extended price by quantity a trade. Lines are dealt by symbol, which bars and all windows over a symbol
    then share: a line is rarely one of many of its day, so a partial aggregate before a shuffle by day would sort all of them and shrink nothing."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", price)
    trades = lines.select(F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"), F.to_date("l_shipdate").alias("date"), price.alias("price"), order.alias("turn"), "l_quantity")
    bars = dealt(trades).groupBy("symbol", "date").agg(F.min_by("price", "turn").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "turn").alias("close"), F.sum("l_quantity").alias("volume"))
    return bars.select("symbol", "date", "open", "high", "low", "close", F.col("close").alias("adjclose"), "volume")


def to_long(bars: DataFrame) -> DataFrame:
    """Wide bars as (symbol, date, metric, value)."""
    return bars.unpivot(["symbol", "date"], [m for m in METRICS if m in bars.columns], "metric", "value").where("value is not null")


def to_wide(long: DataFrame) -> DataFrame:
    """(symbol, date, metric, value) as wide bars; the metrics are known, so no pass is spent on finding them."""
    return long.groupBy("symbol", "date").pivot("metric", list(METRICS)).agg(F.first("value", ignorenulls=True))


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars of either layout with lower-case names and valid symbols only."""
    table = spark.read.parquet(path)
    table = table.toDF(*(c.lower() for c in table.columns))
    if {"metric", "value"} <= set(table.columns):
        table = to_wide(table.withColumn("metric", F.lower("metric")))
    return table.where(F.col("symbol").rlike(SYMBOL))


def write_bars_long(bars: DataFrame, path: str) -> None:
    to_long(bars).write.mode("overwrite").parquet(path)


def write_by_symbol(table: DataFrame, path: str) -> None:
    """A folder for each symbol; rows are dealt by symbol first, so each folder gets few files."""
    table.repartition("symbol").sortWithinPartitions("symbol", "date").write.mode("overwrite").partitionBy("symbol").parquet(path)


def read_symbols(spark: SparkSession, path: str, symbols: list[str] | None = None) -> DataFrame:
    table = spark.read.parquet(path)
    return table.where(F.col("symbol").isin(symbols)) if symbols else table


def read_prices(spark: SparkSession, path: str, symbols: list[str] | None = None, start=None, end=None, columns: list[str] | None = None) -> DataFrame:
    """Filters and columns reach the scan."""
    table = read_symbols(spark, path, symbols)
    if start is not None:
        table = table.where(F.col("date") >= F.lit(start))
    if end is not None:
        table = table.where(F.col("date") <= F.lit(end))
    return table.select(*columns) if columns else table


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """symbol, description, sector of a universe CSV, columns found by their names."""
    table = spark.read.csv(path, header=True)
    found = {c.lower(): c for c in table.columns}
    pick = lambda name: F.trim(F.col(f"`{found[name]}`")) if name in found else F.lit(None).cast("string")
    return table.select(F.upper(pick("symbol")).alias("symbol"), pick("description").alias("description"), pick("sector").alias("sector")).where("symbol is not null").dropDuplicates(["symbol"])


def universe_symbols(spark: SparkSession, path: str, most: int | None = None, only_tradeable: bool = True) -> list[str]:
    """Symbols of a universe CSV in the order of its lines; most takes the first so many, as asked for."""
    from ..operators.quality import tradeable

    lines = spark.read.csv(path, header=True)
    column = lambda name: next((c for c in sorted(lines.columns, key=lambda c: c.lower() != name) if name in c.lower()), None)
    symbol, about = column("symbol"), column("description")
    if symbol is None:
        raise ValueError(f"no symbol column in {path}: {lines.columns}")
    table = lines.select(F.monotonically_increasing_id().alias("line"), F.col(f"`{symbol}`").alias("symbol"), (F.col(f"`{about}`") if about else F.lit(None).cast("string")).alias("description")).where("symbol is not null")
    table = (tradeable(table) if only_tradeable else table).orderBy("line")
    return [r[0] for r in (table.limit(most) if most else table).select("symbol").collect()]


def newest(spark: SparkSession, paths: list[str]) -> str | None:
    """The path that was written last, of those that exist; of equally old ones the last named. Any Hadoop store will do."""
    found = []
    for place, path in enumerate(paths):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if store.exists(at):
            found.append((store.getFileStatus(at).getModificationTime(), place, path))
    return max(found)[2] if found else None


def read_cached(spark: SparkSession, stocks: list[str], funds: str | None = None) -> DataFrame:
    """Bars of the newest stock table and of the funds, told apart by kind; of a table that isn't there, no rows."""
    chosen = [(newest(spark, stocks), "stock"), (newest(spark, [funds]) if funds else None, "fund")]
    tables = [read_bars(spark, path).withColumn("kind", F.lit(kind)) for path, kind in chosen if path]
    if not tables:
        return spark.createDataFrame([], "symbol string, date date, open double, high double, low double, close double, adjclose double, volume double, kind string")
    return tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1], allowMissingColumns=True)


def write_table(table: DataFrame, path: str) -> None:
    """Daily or weekly features, or weekly bars, of all symbols as one table, symbol as text and date as a date. Rows are dealt by ranges
    of symbol and date, so that a reader's filters on both skip row groups and a large symbol spans several files."""
    kept = table.withColumns({"symbol": F.col("symbol").cast("string"), "date": F.col("date").cast("date")})
    kept.repartitionByRange("symbol", "date").sortWithinPartitions("symbol", "date").write.mode("overwrite").parquet(path)


def targets(labels: DataFrame, neutral: bool = False) -> DataFrame:
    """Labels under the names of a training table, dates as dates, target 1 where the upper barrier was hit. Unless neutral is set, rows
    without a hit (0) go; rows whose hit is null stay, with target 0."""
    names = {"t0": "entry_date", "t_hit": "exit_date", "entry_px": "entry_price", "price_hit": "exit_price"}
    table = labels.withColumnsRenamed(names).withColumns({c: F.to_date(c) for c in ("entry_date", "exit_date")})
    table = table if neutral else table.where("hit is null or hit <> 0")
    return table.withColumn("target", F.coalesce((F.col("hit") == 1).cast("int"), F.lit(0)))


def read_targets(spark: SparkSession, path: str, neutral: bool = False) -> DataFrame:
    return targets(spark.read.parquet(path), neutral)


def upsert_missing(cached: DataFrame, new: DataFrame) -> DataFrame:
    """Cached rows plus the rows of symbols that the cache lacks."""
    return cached.unionByName(new.join(cached.select("symbol").distinct(), "symbol", "left_anti"), allowMissingColumns=True)


def macro_table(series: DataFrame, names: list[str]) -> DataFrame:
    """(date, series, value) as one row a date with gaps filled forward; a global order, one row a date."""
    from pyspark.sql import Window

    wide = series.groupBy("date").pivot("series", names).agg(F.first("value"))
    before = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return wide.select("date", *(F.last(n, ignorenulls=True).over(before).alias(n) for n in names))


def write_rankings(ranked: DataFrame, path: str, as_of: str) -> None:
    """Rankings as CSV and all predictions as Parquet, each under its date and under latest. Rows lie in files by ranges of rank, so a large table is written by many
    tasks and read in order; latest is copied from what was written, not computed again."""
    ordered = ranked.repartitionByRange("rank").sortWithinPartitions("rank")
    ordered.write.mode("overwrite").parquet(f"{path}/predictions/{as_of}")
    written = ranked.sparkSession.read.parquet(f"{path}/predictions/{as_of}")
    written.write.mode("overwrite").parquet(f"{path}/predictions/latest")
    for name in (as_of, "latest"):
        written.write.mode("overwrite").option("header", True).csv(f"{path}/rankings/{name}")


def read_predictions(spark: SparkSession, path: str, as_of: str = "latest") -> DataFrame:
    """Predictions of a date under the names of a signal table: prob as probability, symbols as text, dates as dates."""
    table = spark.read.parquet(f"{path}/predictions/{as_of}").withColumnsRenamed({"prob": "probability"})
    return table.withColumns({c: F.col(c).cast(t) for c, t in (("symbol", "string"), ("date", "date")) if c in table.columns})
