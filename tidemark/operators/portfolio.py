"""Weekly portfolio weights, constraints, costs and performance. All weeks at once; a week never sees another but the one before."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import div



def week():
    return Window.partitionBy("week")


def _clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def equal_top(signals: DataFrame, n: int = 10, cap: float = 0.2) -> DataFrame:
    order = week().orderBy(F.desc("probability"), "symbol")
    top = signals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return top.withColumn("weight", F.least(1 / F.count("*").over(week()), F.lit(cap)))


def proportional_top(signals: DataFrame, n: int = 10, cap: float = 0.2) -> DataFrame:
    order = week().orderBy(F.desc("probability"), "symbol")
    top = signals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    share = div("probability", F.sum("probability").over(week()))
    clipped = top.withColumn("__w", F.least(F.coalesce(share, F.lit(0.0)), F.lit(cap)))
    return clipped.withColumn("weight", F.coalesce(div("__w", F.sum("__w").over(week())), F.lit(0.0))).drop("__w")


def monotone(signals: DataFrame, slope: float = 0.5, base: float = 0.5, most: float = 0.1, least: float = 0.01) -> DataFrame:
    raw = _clip(slope * (F.col("probability") - base), 0.0, most)
    return signals.withColumn("weight", F.when(raw >= least, raw).otherwise(0.0))


def rank_buckets(signals: DataFrame, weights: list[float]) -> DataFrame:
    """Weeks are cut into len(weights) buckets by probability; a bucket's rows share its weight."""
    k = len(weights)
    place = F.row_number().over(week().orderBy(F.desc("probability"), "symbol")) - 1
    bucket = F.least(F.floor(place * k / F.count("*").over(week())), F.lit(k - 1)).cast("int")
    out = signals.withColumn("bucket", bucket)
    share = F.get(F.array(*map(F.lit, weights)), F.col("bucket"))
    return out.withColumn("weight", share / F.count("*").over(Window.partitionBy("week", "bucket")))


def target_volatility(weights: DataFrame, sigma: str, target: float = 0.15, gross: float = 1.0) -> DataFrame:
    """Weights of a week scaled to a volatility (uncorrelated), gross exposure capped."""
    vol = F.sqrt(F.sum(F.pow(F.col("weight") * F.col(sigma), 2)).over(week()))
    out = weights.withColumn("__w", F.col("weight") * F.coalesce(div(F.lit(target), vol), F.lit(1.0)))
    size = F.sum(F.abs("__w")).over(week())
    return out.withColumn("weight", F.when(size > gross, F.col("__w") * gross / size).otherwise(F.col("__w"))).drop("__w")


def constrain(weights: DataFrame, name: float = 0.1, sector: float = 0.3, least: float = 0.005, most: int = 20, gross: float = 1.0) -> DataFrame:
    """In order: cap names, scale sectors to their cap, drop small weights, keep the largest, scale to the gross cap, cap names."""
    out = weights.withColumn("w", F.least(F.col("weight"), F.lit(name)))
    held = F.sum("w").over(Window.partitionBy("week", "sector"))
    out = out.withColumn("w", F.when(held > sector, F.col("w") * sector / held).otherwise(F.col("w")))
    out = out.where(F.col("w") >= least).withColumn("__k", F.row_number().over(week().orderBy(F.desc(F.round("w", 12)), "symbol"))).where(F.col("__k") <= most)
    size = F.sum("w").over(week())
    out = out.withColumn("w", F.when(size > gross, F.col("w") * gross / size).otherwise(F.col("w")))
    return out.withColumn("weight", F.least(F.col("w"), F.lit(name))).drop("w", "__k")


def turnover(weights: DataFrame) -> DataFrame:
    """Per week: half the sum of absolute weight changes to the week before in the table; the first week has none before it."""
    weeks = weights.select("week").distinct().withColumn("n", F.row_number().over(Window.orderBy("week")))
    now = weights.join(F.broadcast(weeks), "week").select("n", "symbol", "weight")
    before = now.select((F.col("n") + 1).alias("n"), "symbol", F.col("weight").alias("old"))
    both = now.join(before, ["n", "symbol"], "full").withColumn("d", F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))
    return both.groupBy("n").agg((F.sum("d") / 2).alias("turnover")).join(F.broadcast(weeks), "n").select("week", "turnover")


def concentration(weights: DataFrame) -> DataFrame:
    """Per week: sum of squares, effective number, largest and five largest weights, gross and net."""
    out = weights.withColumn("__k", F.row_number().over(week().orderBy(F.desc("weight"), "symbol")))
    out = out.groupBy("week").agg(F.sum(F.pow("weight", 2)).alias("hhi"), F.max("weight").alias("top1"), F.sum(F.when(F.col("__k") <= 5, F.col("weight"))).alias("top5"), F.sum(F.abs("weight")).alias("gross"), F.sum("weight").alias("net"))
    return out.withColumn("effective_n", div(F.lit(1.0), "hhi"))


def weekly_returns(weights: DataFrame, ret: str = "actual_return", cost: float = 0.0) -> DataFrame:
    """Per week: weighted return, hit rate, exposure, and the return less a cost on turnover."""
    each = weights.groupBy("week").agg(F.sum(F.col("weight") * F.col(ret)).alias("ret"), F.avg((F.col(ret) > 0).cast("double")).alias("hit_rate"), F.sum(F.abs("weight")).alias("exposure"))
    return each.join(turnover(weights), "week").withColumn("net_ret", F.col("ret") - cost * F.col("turnover"))


def costs(trades: DataFrame, bps: float = 5.0, k: float = 0.1, cap: float = 100.0, unknown: float = 50.0) -> DataFrame:
    """Linear cost, square-root impact (capped, a fixed rate where volume is unknown) and their sum, in money."""
    value = F.abs("value")
    rate = F.when(F.col("volume") > 0, F.least(k * F.sqrt(value / F.col("volume")) * 1e4, F.lit(cap))).otherwise(unknown)
    out = trades.withColumns({"linear_cost": value * bps / 1e4, "impact_cost": value * rate / 1e4})
    return out.withColumn("total_cost", F.col("linear_cost") + F.col("impact_cost"))


def equity(weekly: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """nav from compounded returns and the drawdown from its running top."""
    order = Window.partitionBy(*by).orderBy("week") if by else Window.orderBy("week")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    out = weekly.withColumn("nav", F.exp(F.sum(F.log1p("ret")).over(run)))
    return out.withColumn("drawdown", F.col("nav") / F.greatest(F.max("nav").over(run), F.lit(1.0)) - 1)


def performance(weekly: DataFrame, periods: int = 52, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Return, volatility, ratios, drawdown, tail and hit statistics of weekly returns."""
    rows = equity(weekly, by)
    r = F.col("ret")
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), (F.exp(F.sum(F.log1p(r))) - 1).alias("total_return"), F.avg(r).alias("mean"), (F.stddev_samp(r) * math.sqrt(periods)).alias("volatility"), F.sqrt(F.avg(F.pow(F.least(r, F.lit(0.0)), 2)) * periods).alias("downside"), F.min("drawdown").alias("max_drawdown"), F.percentile("ret", 0.05).alias("var_95"), F.collect_list("ret").alias("__all"), F.avg((r > 0).cast("double")).alias("hit_rate"), F.sum(F.greatest(r, F.lit(0.0))).alias("won"), F.sum(-F.least(r, F.lit(0.0))).alias("lost"), F.avg(F.when(r > 0, r)).alias("avg_win"), F.avg(F.when(r < 0, r)).alias("avg_loss"), F.max(r).alias("best"), F.min(r).alias("worst"))
    tail = F.filter("__all", lambda x: x <= F.col("var_95"))
    out = out.withColumns({"cvar_95": F.aggregate(tail, F.lit(0.0), lambda a, x: a + x) / F.size(tail), "win_loss": div("avg_win", F.abs("avg_loss"))}).drop("__all")
    years = F.col("n") / periods
    out = out.withColumn("cagr", F.pow(1 + F.col("total_return"), 1 / years) - 1)
    return out.withColumns({"sharpe": div(F.col("mean") * periods, "volatility"), "sortino": div(F.col("mean") * periods, "downside"), "calmar": div("cagr", F.abs("max_drawdown")), "profit_factor": div("won", "lost")}).drop("won", "lost", "downside", "mean")


def drawdown_episodes(weekly: DataFrame) -> DataFrame:
    """Each stretch below the running top: first and last week, depth, length."""
    rows = equity(weekly).withColumn("under", F.col("drawdown") < -1e-12)
    run = Window.orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("episode", F.sum(F.when(F.col("under"), 0).otherwise(1)).over(run)).where("under")
    return rows.groupBy("episode").agg(F.min("week").alias("first"), F.max("week").alias("last"), F.min("drawdown").alias("depth"), F.count("*").alias("weeks")).drop("episode")


def monthly_matrix(weekly: DataFrame) -> DataFrame:
    """Year by month returns from the last nav of each month, and the year's."""
    nav = equity(weekly).groupBy(F.year("week").alias("year"), F.month("week").alias("month")).agg(F.max_by("nav", "week").alias("nav"))
    before = F.coalesce(F.lag("nav").over(Window.orderBy("year", "month")), F.lit(1.0))
    monthly = nav.withColumn("r", F.col("nav") / before - 1)
    wide = monthly.groupBy("year").pivot("month", list(range(1, 13))).agg(F.first("r"))
    whole = monthly.groupBy("year").agg((F.exp(F.sum(F.log1p("r"))) - 1).alias("total"))
    return wide.toDF("year", *(f"m{m:02d}" for m in range(1, 13))).join(whole, "year")


def rolling_drawdown(weekly: DataFrame, w: int = 52, by: list[str] = [], nav: str = "nav") -> DataFrame:  # noqa: B006
    """roll_max_drawdown: the greatest fall from a top to a later value among the last w rows, where w are there.

    A stretch is summed up by its top, its bottom and its greatest fall, and two neighbours join to one; stretches of doubling length and the parts of w in powers of
    two take about 2 log2(w) lags, whatever w is."""
    order = Window.partitionBy(*by).orderBy("week") if by else Window.orderBy("week")
    value = F.col(nav)

    def joined(early: Column, late: Column) -> Column:
        fall = F.least(early["fall"], late["fall"], late["bottom"] / early["top"] - 1)
        return F.when(early.isNotNull() & late.isNotNull(), F.struct(F.greatest(early["top"], late["top"]).alias("top"), F.least(early["bottom"], late["bottom"]).alias("bottom"), fall.alias("fall")))

    out = weekly.withColumn("__s0", F.when(value.isNotNull(), F.struct(value.alias("top"), value.alias("bottom"), F.lit(0.0).alias("fall"))))
    powers = [k for k in range(w.bit_length()) if w >> k & 1]
    for k in range(1, w.bit_length()):
        out = out.withColumn("__e", F.lag(f"__s{k - 1}", 1 << (k - 1)).over(order)).withColumn(f"__s{k}", joined(F.col("__e"), F.col(f"__s{k - 1}")))
    whole, length = F.col(f"__s{powers[0]}"), 1 << powers[0]
    out = out.withColumn("__w", whole)
    for k in powers[1:]:
        out = out.withColumn("__e", F.lag(f"__s{k}", length).over(order)).withColumn("__w", joined(F.col("__e"), F.col("__w")))
        length += 1 << k
    return out.withColumn("roll_max_drawdown", F.col("__w")["fall"]).drop("__w", "__e", *(f"__s{k}" for k in range(w.bit_length())))


def rolling_performance(weekly: DataFrame, w: int = 52) -> DataFrame:
    """Return, volatility, ratio, hit rate and greatest drawdown of the last w weeks."""
    frame = Window.orderBy("week").rowsBetween(-(w - 1), 0)
    full = F.count("ret").over(frame) >= w
    out = weekly.withColumns({"roll_return": F.when(full, F.exp(F.sum(F.log1p("ret")).over(frame)) - 1), "roll_volatility": F.when(full, F.stddev_samp("ret").over(frame) * math.sqrt(52)), "roll_mean": F.when(full, F.avg("ret").over(frame) * 52), "roll_hit_rate": F.when(full, F.avg((F.col("ret") > 0).cast("double")).over(frame))})
    out = out.withColumn("roll_sharpe", div("roll_mean", "roll_volatility")).drop("roll_mean")
    return rolling_drawdown(equity(out), w).drop("nav", "drawdown")


def variance(weights: DataFrame, sigma: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """week, variance and volatility of weights (week, symbol, weight): the sum over pairs of weight, deviation and correlation. sigma: symbol, sigma; pairs: a, b, corr, each
    pair once in either order; pairs that are missing, and all without the table, count as uncorrelated. Weights of symbols without a sigma count nothing.

    The pair table meets the weights of one side, then, by week, those of the other: work in proportion to the pairs that are held, and no matrix anywhere."""
    risk = weights.select("week", "symbol", "weight").join(sigma.select("symbol", "sigma"), "symbol").select("week", "symbol", (F.col("weight") * F.col("sigma")).alias("r"))
    own = risk.groupBy("week").agg(F.sum(F.col("r") * F.col("r")).alias("v"))
    if pairs is not None:
        once = pairs.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("corr").alias("corr"))
        left = once.join(risk.select("week", F.col("symbol").alias("a"), F.col("r").alias("ra")), "a")
        both = left.join(risk.select("week", F.col("symbol").alias("b"), F.col("r").alias("rb")), ["week", "b"])
        own = own.unionByName(both.groupBy("week").agg((2 * F.sum(F.col("corr") * F.col("ra") * F.col("rb"))).alias("v")))
    return own.groupBy("week").agg(F.sum("v").alias("variance")).withColumn("volatility", F.sqrt(F.greatest("variance", F.lit(0.0))))


def held_correlations(weights: DataFrame, returns: DataFrame, least: int = 20) -> DataFrame:
    """a, b, corr of every pair of symbols that weights (week, symbol) hold in the same week, over the weeks in which both have a return (r), of which there
    must be least. Only held pairs are made: as many as weeks times the square of the names held in one, whatever the number of symbols."""
    held = weights.select("week", "symbol").distinct()
    a, b = held.toDF("week", "a"), held.toDF("week", "b")
    asked = a.join(b, "week").where("a < b").select("a", "b").distinct()
    names = asked.select(F.explode(F.array("a", "b")).alias("symbol")).distinct()
    mine = returns.join(names, "symbol", "left_semi").select("symbol", "week", "r")
    met = asked.join(mine.toDF("a", "week", "ra"), "a").join(mine.toDF("b", "week", "rb"), ["b", "week"])
    out = met.groupBy("a", "b").agg(F.count("*").alias("__n"), F.corr("ra", "rb").alias("corr"))
    return out.where((F.col("__n") >= least) & F.col("corr").isNotNull() & ~F.isnan("corr")).drop("__n")


def compare(strategies: dict[str, DataFrame], cost: float = 0.0) -> DataFrame:
    """Weekly returns of several weightings of one signal table, one performance row each."""
    tables = [weekly_returns(w, cost=cost).withColumn("strategy", F.lit(name)) for name, w in strategies.items()]
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.unionByName(t)
    return performance(whole, by=["strategy"])


def tracking_error(weights: DataFrame, benchmark: DataFrame, sigma: DataFrame) -> DataFrame:
    """Per week: root of the summed squares of active weights times deviation. benchmark: week, symbol, bench; sigma: symbol, sigma."""
    both = weights.select("week", "symbol", "weight").join(benchmark, ["week", "symbol"], "full").join(sigma, "symbol")
    active = F.coalesce("weight", F.lit(0.0)) - F.coalesce("bench", F.lit(0.0))
    return both.groupBy("week").agg(F.sqrt(F.sum(F.pow(active * F.col("sigma"), 2))).alias("tracking_error"))


def limits(weights: DataFrame, name: float = 0.1, sector: float = 0.3, gross: float = 1.0) -> DataFrame:
    """Per week: does each constraint hold."""
    held = weights.withColumn("__s", F.sum("weight").over(Window.partitionBy("week", "sector")))
    return held.groupBy("week").agg((F.max("weight") <= name + 1e-9).alias("name_ok"), (F.max("__s") <= sector + 1e-9).alias("sector_ok"), (F.sum(F.abs("weight")) <= gross + 1e-9).alias("gross_ok"))


def by_rule(signals: DataFrame, rule) -> DataFrame:
    """Weights by a user's own expression, scaled to 1 in each week; signals that it gives nothing are out."""
    rows = signals.withColumn("weight", rule).where("weight > 0")
    return rows.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy("week")))


def turnover_by_symbol(weights: DataFrame) -> DataFrame:
    """week, symbol, change: the absolute weight change of each symbol to the week before in the table, symbols that left included. Half their sum a week is turnover."""
    from .panel import small

    weeks = small(weights.select("week").distinct().withColumn("__n", F.row_number().over(Window.orderBy("week"))))
    now = weights.join(weeks, "week").select("__n", "symbol", "weight")
    before = now.select((F.col("__n") + 1).alias("__n"), "symbol", F.col("weight").alias("__old"))
    both = now.join(before, ["__n", "symbol"], "full").withColumn("change", F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("__old", F.lit(0.0))))
    return both.join(weeks, "__n").select("week", "symbol", "change")
