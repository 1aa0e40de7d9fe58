"""Resampling, as-of joins, benchmark-relative and cross-sectional operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import by_date, by_symbol, col, div, lag, mean, rows, total, zscore

#: Bytes of a benchmark, macro or mapping table that may be broadcast, by its rows and the width of its schema.
MOST_BROADCAST = 64 << 20


def small(table: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """table with a broadcast hint if a count of its rows, times the width of a row, proves that it is small; else as it is, for a shuffle join. Strings count
    20 bytes, as Spark has it."""
    rows = most // max(1, table._jdf.schema().defaultSize())
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def week_end(date: str | Column = "date") -> Column:
    """The Friday that ends the week of a date."""
    return F.next_day(F.date_sub(col(date), 1), "Fri")


def resample(bars: DataFrame, period: str = "week") -> DataFrame:
    """Weekly (to Friday) or monthly bars with a log return."""
    end = week_end() if period == "week" else F.last_day("date")
    out = bars.groupBy("symbol", end.alias("period_end")).agg(F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"), F.max_by("adjclose", "date").alias("adjclose"), F.sum("volume").alias("volume")).withColumnRenamed("period_end", "date")
    return out.withColumn("ret", F.log("adjclose") - F.log(lag("adjclose")))


def complete_weeks(weekly: DataFrame, as_of) -> DataFrame:
    """Without the week that as_of lies in, unless it is that week's Friday."""
    return weekly.where(F.col("date") <= F.date_sub(F.next_day(F.lit(as_of).cast("date"), "Fri"), 7))


def compound_weekly(series: DataFrame, x: str = "ret") -> DataFrame:
    return series.groupBy("symbol", week_end().alias("week_end")).agg((F.exp(F.sum(x)) - 1).alias("week_ret"))


def as_of(left: DataFrame, right: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """left with the columns of the last right row of the same key at or before its date.

    Both sides are one stream in date order, right before left on equal dates, and the last right row seen is carried on:
    one shuffle on the key and no range join. Left rows without a right row keep nulls."""
    payload = F.struct(*columns)
    a = left.withColumns({"__side": F.lit(1), "__p": F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType)})
    b = right.select(*by, "date", F.lit(0).alias("__side"), payload.alias("__p"))
    seen = F.last("__p", ignorenulls=True).over(Window.partitionBy(*by).orderBy("date", "__side").rowsBetween(Window.unboundedPreceding, 0))
    out = a.unionByName(b, allowMissingColumns=True).withColumn("__p", seen).where("__side = 1")
    return out.select(*left.columns, *(F.col(f"__p.{c}").alias(c) for c in columns))


def attach_macro(bars: DataFrame, macro: DataFrame, columns: list[str], k: int = 1) -> DataFrame:
    """Series of one row a date on every symbol, k rows of that symbol late."""
    out = bars.join(small(macro.select("date", *columns)), "date", "left")
    return out.withColumns({c: F.lag(c, k).over(by_symbol()) for c in columns}) if k else out


def benchmarks(bars: DataFrame, sectors: DataFrame) -> DataFrame:
    """bench, date, px, bench_ret: the mean close of all symbols and of each sector."""
    tagged = bars.join(small(sectors), "symbol", "left")
    both = tagged.select("date", "close", F.explode(F.array(F.lit("ALL"), F.col("sector"))).alias("bench")).where("bench is not null")
    px = both.groupBy("bench", "date").agg(F.avg("close").alias("px"))
    w = Window.partitionBy("bench").orderBy("date")
    return px.withColumn("bench_ret", F.log("px") - F.log(F.lag("px").over(w)))


def beta_alpha(table: DataFrame, y: str, x: str, w: int = 60, prefix: str = "", least: int | None = None) -> DataFrame:
    """Rolling beta of y on x and what it leaves, over rows where both are there."""
    both = F.col(y).isNotNull() & F.col(x).isNotNull()
    frame = rows(w)
    out = table.withColumns({"__y": F.when(both, F.col(y)), "__x": F.when(both, F.col(x))})
    enough = F.count("__x").over(frame) >= (least or max(20, w // 3))
    cov, var = F.covar_samp("__y", "__x").over(frame), F.var_samp("__x").over(frame)
    out = out.withColumn(f"{prefix}beta", F.when(enough, div(cov, var)))
    return out.withColumn(f"{prefix}alpha", F.col(y) - F.col(f"{prefix}beta") * F.col(x)).drop("__y", "__x")


def alpha_momentum(table: DataFrame, alpha: str, prefix: str, windows=(20, 60, 120), part: int = 3) -> DataFrame:
    """Sums of alpha over each window; a part of its rows must be there."""
    return table.withColumns({f"{prefix}_{w}": total(alpha, w, max(3, w // part) if part == 3 else w // part) for w in windows})


def relative_strength(table: DataFrame, price: str, bench: str, prefix: str = "rs", norm: tuple[int, int] = (60, 20), z: tuple[int, int] = (20, 6)) -> DataFrame:
    """Price by benchmark, against its own mean, and its z-score by sample deviation; norm, z: rows, and how many must be there."""
    out = table.withColumn(prefix, div(price, bench))
    return out.withColumns({f"{prefix}_norm": div(prefix, mean(prefix, *norm)) - 1, f"{prefix}_z{z[0]}": zscore(prefix, *z, sample=True)})


def with_benchmark(table: DataFrame, bench: DataFrame, of: Column | str, names: dict[str, str]) -> DataFrame:
    """table with columns of the benchmark of each row: of gives its name; names: benchmark column -> new name. Rows without one keep nulls."""
    right = bench.select(F.col("bench").alias("__b"), F.col("date").alias("__d"), *(F.col(k).alias(v) for k, v in names.items()))
    return table.withColumn("__of", of if isinstance(of, Column) else F.lit(of)).join(small(right), (F.col("__of") == F.col("__b")) & (F.col("date") == F.col("__d")), "left").drop("__of", "__b", "__d")


def alpha_drivers(bars: DataFrame, sectors: DataFrame, bench: DataFrame, w: int = 60, least: int | None = None, windows=(20, 60), part: int = 3) -> DataFrame:
    """Beta, alpha and alpha momentum of every symbol against the market and its sector, and the even mix of both alphas. bars have ret."""
    out = bars.join(small(sectors), "symbol", "left")
    out = with_benchmark(with_benchmark(out, bench, "ALL", {"bench_ret": "market_ret"}), bench, F.col("sector"), {"bench_ret": "sector_ret"})
    out = beta_alpha(beta_alpha(out, "ret", "market_ret", w, "market_", least), "ret", "sector_ret", w, "sector_", least)
    out = out.withColumn("combo_alpha", 0.5 * F.col("market_alpha") + 0.5 * F.col("sector_alpha"))
    for name in ("market", "sector", "combo"):
        out = alpha_momentum(out, f"{name}_alpha", f"{name}_mom", windows, part)
    return out


def strength_drivers(bars: DataFrame, sectors: DataFrame, bench: DataFrame, norm: tuple[int, int] = (60, 20), z: tuple[int, int] = (20, 6)) -> DataFrame:
    """Relative strength of every symbol against the market and its sector, and of the sector against the market."""
    out = bars.join(small(sectors), "symbol", "left")
    out = with_benchmark(with_benchmark(out, bench, "ALL", {"px": "market_px"}), bench, F.col("sector"), {"px": "sector_px"})
    out = relative_strength(out, "close", "market_px", "rs_market", norm, z)
    out = relative_strength(out, "close", "sector_px", "rs_sector", norm, z)
    return relative_strength(out, "sector_px", "market_px", "rs_sector_market", norm, z)


def required_benchmarks(bench: DataFrame, mapping: DataFrame, always: list[str]) -> DataFrame:
    """The rows of benchmarks that some symbol is mapped to, or that are always asked for."""
    asked = mapping.select("bench").distinct()
    named = F.col("bench").isin(always)
    return bench.where(named).unionByName(bench.where(~named).join(asked, "bench", "left_semi"))


def enough_members(bars: DataFrame, names: list[str], least: int, rows_: int = 50) -> DataFrame:
    """Rows of the named symbols that have at least rows_ rows each, or no rows if fewer than least of them do."""
    mine = bars.where(F.col("symbol").isin(names))
    full = mine.groupBy("symbol").agg(F.count("*").alias("__n")).where(F.col("__n") >= rows_)
    many = full.agg(F.count("*").alias("__m"))
    return mine.join(small(full.select("symbol")), "symbol", "left_semi").join(F.broadcast(many)).where(F.col("__m") >= least).drop("__m")


def best_match(bars: DataFrame, bench: DataFrame, least: int = 100) -> DataFrame:
    """For each symbol the benchmark that explains most of its returns. Benchmarks are few, so pairs grow as the rows."""
    pairs = bars.select("symbol", "date", "ret").where("ret is not null").join(small(bench.select("bench", "date", "bench_ret").where("bench_ret is not null")), "date")
    fit = pairs.groupBy("symbol", "bench").agg(F.count("*").alias("n"), F.covar_samp("ret", "bench_ret").alias("c"), F.var_samp("ret").alias("v"), F.var_samp("bench_ret").alias("u"))
    fit = fit.where(F.col("n") >= least).withColumn("r2", div(F.col("c") * F.col("c"), F.col("v") * F.col("u"))).where("r2 > 0")
    order = Window.partitionBy("symbol").orderBy(F.desc(F.round("r2", 9)), "bench")
    return fit.withColumn("__k", F.row_number().over(order)).where("__k = 1").select("symbol", "bench", "r2", "n")


def correlations(bars: DataFrame, bench: DataFrame, least: int = 100) -> DataFrame:
    """Correlation of each symbol's returns with each benchmark's."""
    pairs = bars.select("symbol", "date", "ret").where("ret is not null").join(small(bench.select("bench", "date", "bench_ret").where("bench_ret is not null")), "date")
    out = pairs.groupBy("symbol", "bench").agg(F.count("*").alias("n"), F.covar_samp("ret", "bench_ret").alias("c"), F.stddev_samp("ret").alias("s"), F.stddev_samp("bench_ret").alias("t"))
    return out.where(F.col("n") > least).select("symbol", "bench", "n", div("c", F.col("s") * F.col("t")).alias("corr"))


def breadth(bars: DataFrame, averages: tuple[int, int] = (50, 200), spans: tuple[int, int] = (19, 39)) -> DataFrame:
    """Per date: symbols that rose and fell, their difference and its running sum, shares above two averages, and the McClellan
    oscillator (two exponential means of the difference) with its running sum."""
    from .kernels import smoothed

    a, b = averages
    marked = bars.withColumns({"up": F.signum(F.col("close") - lag("close")), "ma_a": mean("close", a, a // 2), "ma_b": mean("close", b, b // 2)})
    day = marked.groupBy("date").agg(F.sum((F.col("up") > 0).cast("int")).alias("advancers"), F.sum((F.col("up") < 0).cast("int")).alias("decliners"), F.avg((F.col("close") > F.col("ma_a")).cast("double")).alias(f"above_ma{a}"), F.avg((F.col("close") > F.col("ma_b")).cast("double")).alias(f"above_ma{b}"))
    day = day.withColumns({"advancers": F.coalesce("advancers", F.lit(0)), "decliners": F.coalesce("decliners", F.lit(0))})
    order = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    day = day.withColumn("net", F.col("advancers") - F.col("decliners")).withColumn("ad_line", F.sum("net").over(order))
    # one row a date
    day = smoothed(day.withColumns({"symbol": F.lit("ALL"), "__net": F.col("net").cast("double")}), {"__fast": ("__net", spans[0], 1), "__slow": ("__net", spans[1], 1)})
    return day.withColumn("mcclellan_osc", F.col("__fast") - F.col("__slow")).withColumn("mcclellan_sum", F.sum("mcclellan_osc").over(order)).drop("symbol", "__net", "__fast", "__slow")


def momentum(bars: DataFrame, w: int, least: int | None = None) -> DataFrame:
    """mom: sum of ret over the last w dates of the whole table's calendar, from its w-th date on."""
    days = bars.select("date").distinct().withColumn("__k", F.row_number().over(Window.orderBy("date")))
    frame = Window.partitionBy("symbol").orderBy("__k").rangeBetween(-(w - 1), 0)
    enough = (F.count("ret").over(frame) >= (least or max(3, w // 3))) & (F.col("__k") >= w)
    return bars.join(small(days), "date").withColumn("mom", F.when(enough, F.sum("ret").over(frame))).drop("__k")


def median_z(x: str | Column, window=None) -> Column:
    """Distance to the median of the window in units of its population deviation."""
    window = window or by_date()
    dev = F.stddev_pop(col(x)).over(window)
    return F.when(dev > 1e-10, (col(x) - F.percentile(col(x), 0.5).over(window)) / dev)


def neutral_momentum(bars: DataFrame, sectors: DataFrame, w: int, least: int | None = None) -> DataFrame:
    """Momentum z-scores across each date, plain and less the sector's median."""
    out = momentum(bars, w, least).join(small(sectors), "symbol", "left")
    in_sector = Window.partitionBy("date", "sector")
    middle = F.when(F.count("mom").over(in_sector) >= 2, F.percentile("mom", 0.5).over(in_sector))
    out = out.withColumn("mom_neutral", F.when(F.col("sector").isNotNull(), F.col("mom") - middle))
    return out.withColumns({"mom_z": median_z("mom"), "mom_neutral_z": median_z("mom_neutral")})


def cross_percentiles(table: DataFrame, x: str, sectors: DataFrame) -> DataFrame:
    """Ordinal percentiles across the date and inside the sector; small sectors fall back on the date."""
    out = table.join(small(sectors), "symbol", "left")

    def ordinal(window) -> Column:
        n = F.count(x).over(window)
        place = F.row_number().over(window.orderBy(F.col(x).asc_nulls_last(), "symbol"))
        return F.when(F.col(x).isNotNull() & (n >= 2), (place - 1) / (n - 1) * 100)

    return out.withColumns({"pct": ordinal(by_date()), "pct_sector": ordinal(Window.partitionBy("date", "sector"))}).withColumn("pct_sector", F.coalesce("pct_sector", "pct"))


def date_rank(table: DataFrame, x: str) -> DataFrame:
    """x as its percentile rank inside each date, ties at their mean."""
    rows_ = table.where(F.col(x).isNotNull())
    first = F.rank().over(by_date().orderBy(x))
    ties = F.count("*").over(Window.partitionBy("date", x))
    return rows_.withColumn(f"{x}_rank", (first + (ties - 1) / 2) / F.count("*").over(by_date()))


def weekly_lags(table: DataFrame, x: str, weeks: list[int]) -> DataFrame:
    """The last value of x of the week k weeks of rows before, on every day of a week."""
    weekly = table.groupBy("symbol", week_end().alias("__week")).agg(F.max_by(x, "date").alias("__v"))
    order = Window.partitionBy("symbol").orderBy("__week")
    moved = weekly.select("symbol", "__week", *(F.lag("__v", k).over(order).alias(f"{x}_lag{k}w") for k in weeks))
    return table.withColumn("__week", week_end()).join(moved, ["symbol", "__week"], "left").drop("__week")


def top_of_date(table: DataFrame, score: str, n: int) -> DataFrame:
    order = by_date().orderBy(F.desc(score), "symbol")
    return table.where(F.col(score).isNotNull()).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


#: How names of daily features begin or end. Weekly ones begin with w_.
DAILY_NAMES = (
    r"^(ret|adjclose|volume|high|low|open)$",
    r"^(rsi|macd|ema|sma|ma_slope)_",
    r"^(hurst|vol_regime|distance|breakout|volshock)_",
    r"^(trend_|alpha_|relstr_)",
    r"^(breadth_|xsec_)",
    r"^atr\d+$",
    r"^(cci|stoch|williams)_",
    r"_(zscore|ema|ratio|momentum)$",
)


def classified(columns: list[str]) -> tuple[list[str], list[str]]:
    """The daily and the weekly features among names, in their order; keys and names of neither kind are in neither."""
    import re

    weekly = [c for c in columns if c.startswith("w_")]
    daily = [c for c in columns if c not in {"symbol", "date", *weekly} and any(re.search(p, c, re.IGNORECASE) for p in DAILY_NAMES)]
    return daily, weekly


def lags_by_name(table: DataFrame, days: list[int], weeks: list[int]) -> DataFrame:
    """table with {name}_lag{k}d of its daily features, k rows late, and {name}_lag{k}w of its weekly ones: their last value in the week k weeks of rows before.
    All weekly columns share one aggregate and one join."""
    daily, weekly = classified(table.columns)
    out = table.withColumns({f"{c}_lag{k}d": lag(c, k) for c in daily for k in days})
    if not (weekly and weeks):
        return out
    last = table.groupBy("symbol", week_end().alias("__week")).agg(*(F.max_by(c, "date").alias(c) for c in weekly))
    order = Window.partitionBy("symbol").orderBy("__week")
    moved = last.select("symbol", "__week", *(F.lag(c, k).over(order).alias(f"{c}_lag{k}w") for c in weekly for k in weeks))
    return out.withColumn("__week", week_end()).join(moved, ["symbol", "__week"], "left").drop("__week")
