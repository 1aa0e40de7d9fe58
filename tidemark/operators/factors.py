"""Regressions of a symbol's returns on several factors at once, daily and weekly.

The sums of products are differences of running sums, constant work a row whatever the window; the small systems are solved by elimination in
column expressions, so a regression is windows and projections and nothing leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import by_symbol, finite
from .features import residual_block, spread
from .panel import as_of, best_match, small, week_end, with_benchmark

#: Windows of joint regressions and of spreads.
DAILY, WEEKLY = (60,), (12,)
DAILY_SPREADS, WEEKLY_SPREADS = (20, 60, 120), (4, 12, 24)


def least_rows(w: int) -> int:
    """Rows of a window that must be whole: a third, at least 20, never more than the window."""
    return min(w, max(20, int(w * 0.33)))


def rolling_ridge(table: DataFrame, y: str, xs: list[str], w: int = 60, alpha: float = 0.01, least: int | None = None, suffix: str = "") -> DataFrame:
    """Ridge regression of y on xs over the last w rows: alpha (the intercept, not penalised), beta_x for each x, and ridge_resid, what the row's own y
    leaves. Rows in which y or an x is null, NaN or infinite don't count; the first w - 1 rows and windows with fewer than least whole rows give nulls."""
    least = least_rows(w) if least is None else least
    names, k = [*xs, y], len(xs)
    whole = reduce(lambda a, b: a & b, [finite(F.col(c).cast("double")).isNotNull() for c in names])
    out = table.withColumns({f"__v{i}": F.when(whole, F.col(c).cast("double")) for i, c in enumerate(names)})
    order = by_symbol()
    before = order.rowsBetween(Window.unboundedPreceding, 0)
    terms = {"n": F.count("__v0")} | {f"s{i}": F.sum(f"__v{i}") for i in range(k + 1)}
    terms |= {f"p{i}_{j}": F.sum(F.col(f"__v{i}") * F.col(f"__v{j}")) for i in range(k) for j in range(i, k + 1)}
    out = out.withColumns({f"__c{t}": F.coalesce(a.over(before), F.lit(0)) for t, a in terms.items()} | {"__row": F.row_number().over(order)})
    out = out.withColumns({f"__{t}": F.col(f"__c{t}") - F.coalesce(F.lag(f"__c{t}", w).over(order), F.lit(0)) for t in terms})
    ok = (F.col("__row") >= w) & (F.col("__n") >= least)
    out = out.withColumns({f"__m{i}": F.when(ok, F.col(f"__s{i}") / F.col("__n")) for i in range(k + 1)})
    gram = {f"__g{i}_{j}": F.col(f"__p{i}_{j}") - F.col(f"__s{i}") * F.col(f"__m{j}") + (alpha if i == j else 0.0) for i in range(k) for j in range(i, k + 1)}
    out = out.withColumns(gram)
    for i in range(k):  # rows below i lose their part along i; column k is the right side
        out = out.withColumn(f"__d{i}", F.when(F.abs(f"__g{i}_{i}") > 1e-300, 1 / F.col(f"__g{i}_{i}")))
        out = out.withColumns({f"__g{a}_{b}": F.col(f"__g{a}_{b}") - F.col(f"__g{i}_{a}") * F.col(f"__d{i}") * F.col(f"__g{i}_{b}") for a in range(i + 1, k) for b in range(a, k + 1)})
    for i in range(k - 1, -1, -1):
        rest = reduce(lambda a, b: a - b, [F.col(f"__g{i}_{j}") * F.col(f"__b{j}") for j in range(i + 1, k)], F.col(f"__g{i}_{k}"))
        out = out.withColumn(f"__b{i}", rest * F.col(f"__d{i}"))
    level = reduce(lambda a, b: a - b, [F.col(f"__b{i}") * F.col(f"__m{i}") for i in range(k)], F.col(f"__m{k}"))
    fitted = reduce(lambda a, b: a + b, [F.col(f"__b{i}") * F.col(f"__v{i}") for i in range(k)])
    out = out.withColumn("__a", level)
    made = {f"alpha{suffix}": F.col("__a"), **{f"beta_{x}{suffix}": F.col(f"__b{i}") for i, x in enumerate(xs)}, f"ridge_resid{suffix}": F.col(f"__v{k}") - F.col("__a") - fitted}
    return out.select(*(F.col(c) for c in table.columns), *(v.alias(c) for c, v in made.items()))


def compounded(returns: DataFrame, by: str, x: str) -> DataFrame:
    """Weekly returns (to Friday) of each key: the product of 1 + x, less 1. Weeks without a value are null."""
    return returns.groupBy(by, week_end().alias("week")).agg((F.product(1 + F.col(x)) - 1).alias(x)).withColumnRenamed("week", "date")


def filled_factors(bench: DataFrame, dates: DataFrame) -> DataFrame:
    """bench, date, bench_ret on every one of dates: the last return before it, before the first the first. Benchmarks and dates are few."""
    keys = bench.select("bench").distinct()
    named = small(keys).crossJoin(small(dates.select("date").distinct().unionByName(bench.select("date").distinct()).distinct()))
    rows = named.join(bench.select("bench", "date", "bench_ret"), ["bench", "date"], "left")
    w = Window.partitionBy("bench").orderBy("date")
    last = F.last("bench_ret", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("bench_ret", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumn("bench_ret", F.coalesce(last, first))


def _factors(table: DataFrame, bench: DataFrame, roles: dict[str, str], match: bool) -> DataFrame:
    """table (symbol, date, ret, best) with the market's return and, as differences to it, those of the other roles and of the best match."""
    rows = filled_factors(bench, table)
    wide = rows.groupBy("date").agg(*(F.max(F.when(F.col("bench") == name, F.col("bench_ret"))).alias(f"__{role}") for role, name in roles.items()))
    out = table.join(small(wide), "date", "left")
    if match:
        own = rows.select(F.col("bench").alias("best"), "date", F.col("bench_ret").alias("__bestmatch"))
        out = out.join(small(own), ["best", "date"], "left")
    others = [*(r for r in roles if r != "market"), *(["bestmatch"] if match else [])]
    return out.withColumns({"market": F.col("__market")} | {r: F.col(f"__{r}") - F.col("__market") for r in others}).drop(*(f"__{r}" for r in ("market", *others)))


def _block(table: DataFrame, xs: list[str], windows, spreads, prefix: str) -> DataFrame:
    """The columns that a frequency adds, behind the key."""
    out = table
    for w in windows:
        suffix = f"_{w}" if len(windows) > 1 else ""
        out = residual_block(rolling_ridge(out, "ret", xs, w, suffix=suffix), f"ridge_resid{suffix}", w, least_rows(w))
        out = out.withColumnsRenamed({c: f"{prefix}{c}{suffix}" for c in ("residual_mean", "residual_cumret", "residual_vol")} | {f"{c}{suffix}": f"{prefix}{c}{suffix}" for c in ("alpha", "ridge_resid", *(f"beta_{x}" for x in xs))})
    if "bestmatch" in xs:
        out = spread(out, "bestmatch", f"{prefix}bestmatch_market", spreads)
    return out.drop("ret", "best", *xs)


def joint_factors(returns: DataFrame, bench: DataFrame, roles: dict[str, str], daily=DAILY, weekly=WEEKLY, mapping: DataFrame | None = None) -> DataFrame:
    """returns: symbol, date, ret. bench: bench, date, bench_ret. roles: factor -> benchmark, with market; each other factor, and each symbol's
    best match, counts as its difference to the market. mapping: symbol, bench; by default the benchmark that explains most of the returns.

    Adds daily betas, alpha and residual statistics and the spread of the best match, and the same of compounded weekly returns, prefixed w_, on
    each day as of the last Friday that is not after it. Symbols without a best match have null betas, as their rows aren't whole."""
    mapping = best_match(returns, bench) if mapping is None else mapping
    named = small(mapping.select("symbol", F.col("bench").alias("best")))
    xs = ["market", *(r for r in roles if r != "market"), "bestmatch"]
    rows = returns.select("symbol", "date", "ret")
    days = _block(_factors(rows.join(named, "symbol", "left"), bench, roles, True), xs, daily, DAILY_SPREADS, "")
    weeks_bench = compounded(bench.select("bench", "date", "bench_ret"), "bench", "bench_ret")
    weeks = _block(_factors(compounded(rows, "symbol", "ret").join(named, "symbol", "left"), weeks_bench, roles, True), xs, weekly, WEEKLY_SPREADS, "w_")
    return as_of(days, weeks, [c for c in weeks.columns if c not in {"symbol", "date"}], ["symbol"])


def best_spread(returns: DataFrame, bench: DataFrame, mapping: DataFrame, against: str, prefix: str, windows=DAILY_SPREADS) -> DataFrame:
    """returns (symbol, date, ...) of mapped symbols with the return of their benchmark less that of another (spread_return) and its metrics. Equal-weight
    sets of benchmarks and weekly tables are other arguments."""
    named = returns.join(small(mapping.select("symbol", F.col("bench").alias("best"))), "symbol")
    out = with_benchmark(with_benchmark(named, bench, F.col("best"), {"bench_ret": "__own"}), bench, against, {"bench_ret": "__base"})
    return spread(out.withColumn("spread_return", F.col("__own") - F.col("__base")).drop("__own", "__base"), "spread_return", prefix, windows)


def weekly_best_spread(returns: DataFrame, bench: DataFrame, mapping: DataFrame, against: str, prefix: str, windows=WEEKLY_SPREADS) -> DataFrame:
    """returns on days with the weekly spread metrics of the last Friday that is not after them."""
    weeks = compounded(returns.select("symbol", "date", "ret"), "symbol", "ret")
    made = best_spread(weeks, compounded(bench.select("bench", "date", "bench_ret"), "bench", "bench_ret"), mapping, against, prefix, windows)
    return as_of(returns, made, [c for c in made.columns if c.startswith(f"{prefix}_")], ["symbol"])
