"""Labels of entries by the first barrier that later bars touch, their overlaps and weights, and barrier calibration."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import by_symbol
from .order import held, quantile, quantiles
from .panel import small
from .quality import valid_entry


def with_atr(bars: DataFrame, w: int = 14) -> DataFrame:
    """bars with atr, the plain mean of the true range over w rows."""
    before = F.lag("close").over(by_symbol())
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    out = bars.withColumn("__tr", tr)
    frame = by_symbol().rowsBetween(-(w - 1), 0)
    return out.withColumn("atr", F.when(F.count("__tr").over(frame) >= w, F.avg("__tr").over(frame))).drop("__tr")


def first_touch(bars: DataFrame, up: float, down: float, horizon: int, tie: str = "upper") -> DataFrame:
    """For every valid row with at least one row after it: hit (1, -1, 0), h_used, price_hit and log return.

    A row looks at the next horizon rows of its symbol as an array, so no join is made. tie: upper, stop or none where one bar
    touches both."""
    ahead = by_symbol().rowsBetween(1, horizon)
    rows = bars.withColumn("__next", F.collect_list(F.struct("high", "low", "close", "date")).over(ahead))
    rows = rows.where(valid_entry() & (F.size("__next") > 0))
    top, bottom = F.col("close") + up * F.col("atr"), F.col("close") - down * F.col("atr")
    rows = rows.withColumns({"top": top, "bot": bottom})
    above = F.array_position(F.transform("__next", lambda b: b["high"] >= F.col("top")), True)
    below = F.array_position(F.transform("__next", lambda b: b["low"] <= F.col("bot")), True)
    rows = rows.withColumns({"__u": F.nullif(above, F.lit(0)), "__d": F.nullif(below, F.lit(0))})
    far = F.lit(horizon + 1)
    u, d = F.coalesce("__u", far), F.coalesce("__d", far)
    both = {"upper": 1, "stop": -1, "none": 0}[tie]
    hit = F.when((u == far) & (d == far), 0).when(u < d, 1).when(d < u, -1).otherwise(both)
    used = F.when((u == far) & (d == far), F.size("__next")).otherwise(F.least(u, d)).cast("int")
    rows = rows.withColumns({"hit": hit, "h_used": used})
    last = F.get("__next", F.col("h_used") - 1)
    price = F.when(F.col("hit") == 1, F.col("top")).when(F.col("hit") == -1, F.col("bot")).otherwise(last["close"])
    rows = rows.withColumns({"price_hit": price, "t_hit": last["date"]}).withColumn("ret_from_entry", F.when(F.col("price_hit") > 0, F.log(F.col("price_hit") / F.col("close"))))
    return rows.drop("__next", "__u", "__d")


def multi_touch(bars: DataFrame, models: dict[str, tuple[float, float]], horizon: int, keep: Column | None = None) -> DataFrame:
    """hit_<model> and h_used_<model> for several barrier pairs, from one look ahead; of the rows that keep names, if it is given."""
    ahead = by_symbol().rowsBetween(1, horizon)
    seen = F.collect_list(F.struct("high", "low")).over(ahead)
    rows = bars.withColumn("__next", seen).where(valid_entry() & (F.size("__next") > 0) & (F.lit(True) if keep is None else keep))
    out = {}
    for name, (up, down) in models.items():
        top, bottom = F.col("close") + up * F.col("atr"), F.col("close") - down * F.col("atr")
        u = F.array_position(F.transform("__next", _over("high", top)), True)
        d = F.array_position(F.transform("__next", _under("low", bottom)), True)
        u, d = F.coalesce(F.nullif(u, F.lit(0)), F.lit(horizon + 1)), F.coalesce(F.nullif(d, F.lit(0)), F.lit(horizon + 1))
        out[f"hit_{name}"] = F.when((u > horizon) & (d > horizon), 0).when(u <= d, 1).otherwise(-1)
        out[f"h_used_{name}"] = F.when((u > horizon) & (d > horizon), F.size("__next")).otherwise(F.least(u, d)).cast("int")
    return rows.withColumns(out).drop("__next")


def _over(field: str, level):
    return lambda b: b[field] >= level


def _under(field: str, level):
    return lambda b: b[field] <= level


def sample_entries(labelled: DataFrame, every: int) -> DataFrame:
    """Entries that a walk along each symbol takes: after one, on by h_used if it hit a barrier sooner than every, else by every.

    pos counts all of a symbol's rows; rows that are missing were not valid and are stepped over one by one. Only two integers
    of a row go through the kernel."""

    def walk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        at, taken = -1, []
        for pos, used, hit in zip(rows["pos"], rows["h_used"], rows["hit"], strict=True):
            if pos < at:
                continue
            taken.append(pos)
            at = pos + (used if hit != 0 and used < every else every)
        return pd.DataFrame({"symbol": key[0], "pos": taken})

    chosen = labelled.select("symbol", "pos", "h_used", "hit").groupBy("symbol").applyInPandas(walk, "symbol string, pos int")
    return labelled.join(chosen, ["symbol", "pos"], "left_semi")


def overlaps(spans: DataFrame, start: str = "t0", end: str = "t1", by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """spans with n_overlapping: how many other closed spans of the symbol (or of what by names) share a day with each.

    Spans that begin by my end, less spans that end before my start: two binary searches in the begins and ends of the group, so rows change hands once
    (not at all if they lie by symbol) and meet no other table. Nulls come before every day."""
    from pyspark.sql.types import LongType, StructField, StructType

    def count(rows: pa.Table) -> pa.Table:
        n = rows.num_rows
        days = pa.chunked_array([*rows[start].chunks, *rows[end].chunks])
        place = pc.rank(days, "ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        begins, ends = place[:n].astype("int64"), place[n:].astype("int64")
        shared = np.searchsorted(np.sort(begins), ends, "right") - np.searchsorted(np.sort(ends), begins, "left") - 1
        return rows.append_column("n_overlapping", pa.array(shared, pa.int64()))

    return spans.groupBy(*by).applyInArrow(count, StructType([*(StructField(f.name, f.dataType) for f in spans.schema), StructField("n_overlapping", LongType())]))


def weights(labels: DataFrame, low: float = 0.01, high: float = 10.0) -> DataFrame:
    """Overlap weight times class balance, clipped, scaled to a mean of 1, clipped again."""
    rows = held(labels).withColumn("w_overlap", 1 / (F.col("n_overlapping") + 0.5))
    classes = rows.groupBy("hit").agg(F.count("*").alias("k"))
    size = classes.agg(F.sum("k").alias("n"), F.count("*").alias("m"))
    balance = classes.join(F.broadcast(size)).select("hit", (F.col("n") / (F.col("m") * F.col("k"))).alias("w_class"))
    clip = lambda x: F.least(F.greatest(x, F.lit(low)), F.lit(high))
    rows = rows.join(F.broadcast(balance), "hit").withColumn("__w", clip(F.col("w_overlap") * F.col("w_class")))
    mean = rows.agg(F.avg("__w").alias("__m"))
    return rows.join(F.broadcast(mean)).withColumn("weight_final", clip(F.col("__w") / F.col("__m"))).drop("__w", "__m")


def model_weights(bars: DataFrame, models: dict[str, tuple[float, float]], horizon: int, low: float = 0.01, high: float = 10.0, least: int = 25) -> DataFrame:
    """symbol, date, model, hit, h_used, n_overlapping, weight_final: labels of every valid entry under each model's barriers, and weights per model.

    A trajectory is closed at both ends: the rows from an entry to the one that ends it. Overlap and class balance are of the model's own labels; weights
    are clipped, scaled to a mean of 1 in the model, and clipped again. Symbols of fewer than least rows take no part. All models share one look
    ahead and one stream of begin and end events."""
    rows = bars.withColumns({"__k": F.row_number().over(by_symbol()), "__n": F.count("*").over(Window.partitionBy("symbol"))}).where(F.col("__n") >= least).drop("__n")
    seen = multi_touch(rows, models, horizon)
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(f"hit_{m}").alias("hit"), F.col(f"h_used_{m}").alias("h_used")) for m in models)))
    spans = seen.select("symbol", "date", F.col("__k").alias("t0"), each.alias("m")).select("symbol", "date", "t0", "m.*")
    spans = spans.withColumns({"t1": F.col("t0") + F.col("h_used"), "id": F.col("t0")})
    out = held(overlaps(spans, by=("symbol", "model")))
    classes = out.groupBy("model", "hit").agg(F.count("*").alias("__c"))
    size = classes.groupBy("model").agg(F.sum("__c").alias("__all"), F.count("*").alias("__m"))
    # three rows a model at most
    balance = classes.join(F.broadcast(size), "model").select("model", "hit", (F.col("__all") / (F.col("__m") * F.col("__c"))).alias("__b"))
    clip = lambda x: F.least(F.greatest(x, F.lit(low)), F.lit(high))
    out = out.join(F.broadcast(balance), ["model", "hit"]).withColumn("__w", clip(F.col("__b") / (F.col("n_overlapping") + 0.5)))
    mean = out.groupBy("model").agg(F.avg("__w").alias("__mean"))
    return out.join(F.broadcast(mean), "model").select("symbol", "date", "model", "hit", "h_used", "n_overlapping", clip(F.col("__w") / F.col("__mean")).alias("weight_final"))


def excursions(bars: DataFrame, horizon: int) -> DataFrame:
    """Largest moves for and against each valid entry over the next horizon rows, in ATR."""
    ahead = by_symbol().rowsBetween(1, horizon)
    rows = bars.withColumns({"__h": F.max("high").over(ahead), "__l": F.min("low").over(ahead)}).where(valid_entry() & F.col("__h").isNotNull())
    return rows.withColumns({"mfe": (F.col("__h") - F.col("close")) / F.col("atr"), "mae": (F.col("close") - F.col("__l")) / F.col("atr")}).where("abs(mfe) <= 50 and abs(mae) <= 50").drop("__h", "__l")


def both_sides(bars: DataFrame, horizon: int = 20, stop: float = 1.0, target: float = 1.5, every: int | None = None) -> DataFrame:
    """For each valid entry with more than horizon rows after it, for long and short trades: mfe and mae (the largest moves for and, negative, against it, in
    ATR), stop_day (rows before the one that touches the stop, horizon + 1 if none does) and stop_first (the stop is touched on an earlier row than the
    target). Entries with a move beyond 50 ATR are left out. every: entries of a walk along each symbol, that many rows on after each."""
    ahead = by_symbol().rowsBetween(1, horizon)
    more = F.count("*").over(by_symbol().rowsBetween(1, horizon + 1))
    rows = bars.withColumns({"__next": F.collect_list(F.struct("high", "low")).over(ahead), "__more": more, "pos": F.row_number().over(by_symbol())})
    rows = rows.where(valid_entry() & (F.col("__more") > horizon))
    c, a = F.col("close"), F.col("atr")
    top, bottom = F.array_max(F.transform("__next", lambda b: b["high"])), F.array_min(F.transform("__next", lambda b: b["low"]))
    rows = rows.withColumns({"mfe_long": (top - c) / a, "mae_long": (bottom - c) / a})
    rows = rows.withColumns({"mfe_short": -F.col("mae_long"), "mae_short": -F.col("mfe_long")}).where("abs(mfe_long) <= 50 and abs(mae_long) <= 50")
    first = lambda test: F.coalesce(F.nullif(F.array_position(F.transform("__next", test), True), F.lit(0)) - 1, F.lit(horizon + 1)).cast("int")
    rows = rows.withColumns({"stop_day_long": first(_under("low", c - stop * a)), "stop_day_short": first(_over("high", c + stop * a)), "__tl": first(_over("high", c + target * a)), "__ts": first(_under("low", c - target * a))})
    rows = rows.withColumns({"stop_first_long": F.col("stop_day_long") < F.col("__tl"), "stop_first_short": F.col("stop_day_short") < F.col("__ts")}).drop("__next", "__more", "__tl", "__ts")
    if every is None:
        return rows.drop("pos")
    walked = sample_entries(rows.withColumns({"hit": F.lit(0), "h_used": F.lit(every)}), every)
    return walked.drop("hit", "h_used", "pos")


def before_stop(bars: DataFrame, stop: float, horizon: int) -> DataFrame:
    """critical: the largest favourable move, in ATR, that each valid entry sees on the bars before the one that touches its stop
    (on all horizon bars if none does); 0 if the first bar does. A target multiple up to it is reached before the stop."""
    ahead = by_symbol().rowsBetween(1, horizon)
    rows = bars.withColumn("__next", F.collect_list(F.struct("high", "low")).over(ahead)).where(valid_entry() & (F.size("__next") > 0))
    level = F.col("close") - stop * F.col("atr")
    rows = rows.withColumn("__d", F.array_position(F.transform("__next", _under("low", level)), True))
    seen = F.when(F.col("__d") > 0, F.slice("__next", F.lit(1), F.greatest(F.col("__d") - 1, F.lit(0)).cast("int"))).otherwise(F.col("__next"))
    best = F.array_max(F.transform(seen, lambda b: b["high"]))
    return rows.withColumn("critical", F.coalesce((best - F.col("close")) / F.col("atr"), F.lit(0.0))).drop("__next", "__d")


def calibrated_multiple(entries: DataFrame, prevalence: float) -> DataFrame:
    """The target multiple that the wanted share of entries reaches before its stop: a percentile of what each entry reaches until then."""
    return entries.agg(F.lit(quantile(entries, "critical", 1 - prevalence)).cast("double").alias("multiple"), F.count("*").alias("n"))


def excursion_report(entries: DataFrame) -> DataFrame:
    """side, n, mean and percentiles of the moves for and against an entry. entries: mfe, mae."""
    points = (25, 50, 75, 90)
    cuts = quantiles(entries, {c: [q / 100 for q in points] for c in ("mfe", "mae")})
    long = entries.unpivot([], ["mfe", "mae"], "side", "x")
    out = long.groupBy("side").agg(F.count("*").alias("n"), F.avg("x").alias("mean"))
    at = lambda i: F.when(F.col("side") == "mfe", F.lit(cuts["mfe"][i])).otherwise(F.lit(cuts["mae"][i])).cast("double")
    return out.withColumns({f"p{q}": at(i) for i, q in enumerate(points)})


def labels_at(bars: DataFrame, entries: DataFrame, models: dict[str, tuple[float, float]], horizon: int) -> DataFrame:
    """Labels of several barrier pairs at given entries (symbol, date) alone; bars after them are looked at as ever, barriers are tried at entries only."""
    marked = bars.join(small(entries.select("symbol", "date").distinct().withColumn("__asked", F.lit(True))), ["symbol", "date"], "left")
    return multi_touch(marked, models, horizon, F.col("__asked").isNotNull()).drop("__asked")


def relabelled(bars: DataFrame, thresholds: DataFrame, horizon: int) -> DataFrame:
    """symbol, date, model, hit for a table of thresholds (model, up, down), which has one row a model and is read by the driver."""
    models = {r["model"]: (float(r["up"]), float(r["down"])) for r in thresholds.orderBy("model").collect()}
    made = multi_touch(bars, models, horizon)
    return made.unpivot(["symbol", "date"], [f"hit_{m}" for m in models], "model", "hit").withColumn("model", F.regexp_replace("model", "^hit_", ""))


def overlap_matrix(spans: DataFrame, most: int = 1000, start: str = "t0", end: str = "t1") -> DataFrame:
    """a, b: ids of spans that share a day, of a sample of at most most spans by a hash of their id; the pairs are at most its square."""
    some = spans.orderBy(F.md5(F.col("id").cast("string")), "id").limit(most).select("id", F.col(start).alias("s"), F.col(end).alias("e"))
    x, y = F.broadcast(some.toDF("a", "sa", "ea")), some.toDF("b", "sb", "eb")
    return y.join(x, (F.col("a") < F.col("b")) & (F.col("sa") <= F.col("eb")) & (F.col("ea") >= F.col("sb"))).select("a", "b")


def active_density(spans: DataFrame, start: str = "t0", end: str = "t1") -> DataFrame:
    """How many spans cover each day on which that number changes: a running sum of what begins and ends."""
    steps = spans.select(F.explode(F.array(F.struct(F.col(start).alias("date"), F.lit(1).alias("d")), F.struct(F.date_add(end, 1).alias("date"), F.lit(-1).alias("d")))).alias("e")).groupBy("e.date").agg(F.sum("e.d").alias("d"))
    return steps.select("date", F.sum("d").over(Window.orderBy("date")).alias("active"))


def concentration(labels: DataFrame, n: int = 10) -> DataFrame:
    """Share of the n symbols with most positive labels, and the Gini coefficient of positives over symbols."""
    each = labels.where("hit = 1").groupBy("symbol").agg(F.count("*").alias("k"))
    ranked = each.withColumns({"down": F.row_number().over(Window.orderBy(F.desc("k"), "symbol")), "up": F.row_number().over(Window.orderBy("k", "symbol"))})
    out = ranked.agg(F.sum("k").alias("all"), F.sum(F.when(F.col("down") <= n, F.col("k")).otherwise(0)).alias("top"), F.sum(F.col("up") * F.col("k")).alias("weighted"), F.count("*").alias("m"))
    return out.select((F.col("top") / F.col("all")).alias("top_share"), (2 * F.col("weighted") / (F.col("m") * F.col("all")) - (F.col("m") + 1) / F.col("m")).alias("gini"), F.col("m").alias("n_symbols"))


def atr_spread(labels: DataFrame) -> DataFrame:
    """Distribution of ATR by close among positive labels."""
    x = labels.where("hit = 1").withColumn("a", F.col("atr") / F.col("close"))
    median, p10, p90 = (F.lit(v).cast("double") for v in quantiles(x, {"a": [0.5, 0.1, 0.9]})["a"])
    return x.agg(F.count("*").alias("n"), F.avg("a").alias("mean"), median.alias("median"), p10.alias("p10"), p90.alias("p90"), F.avg((F.col("a") > 0.05).cast("double")).alias("share_wide"))


def outcomes(labels: DataFrame, models: list[str]) -> DataFrame:
    """Per model and outcome: rows and share."""
    long = labels.unpivot([], [f"hit_{m}" for m in models], "model", "hit").where("hit is not null")
    out = long.groupBy(F.regexp_replace("model", "^hit_", "").alias("model"), "hit").agg(F.count("*").alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("model")))


def binary(labels: DataFrame, models: dict[str, int]) -> DataFrame:
    """symbol, date, model, y: whether each model's own side (1 or -1) was hit; timeouts are left out."""
    long = labels.unpivot(["symbol", "date"], [f"hit_{m}" for m in models], "model", "hit").where("hit <> 0")
    side = F.lit(0)
    for m, s in models.items():
        side = F.when(F.col("model") == f"hit_{m}", s).otherwise(side)
    return long.select("symbol", "date", F.regexp_replace("model", "^hit_", "").alias("model"), (F.col("hit") == side).cast("int").alias("y"))


def target_first(bars: DataFrame, multiples: list[float], stop: float, horizon: int) -> DataFrame:
    """Per multiple: share of valid entries that reach close + multiple x ATR before close - stop x ATR. The grid is a list of parameters."""
    made = multi_touch(bars, {f"m{k}": (m, stop) for k, m in enumerate(multiples)}, horizon)
    one = made.agg(*(F.avg((F.col(f"hit_m{k}") == 1).cast("double")).alias(str(m)) for k, m in enumerate(multiples)))
    return one.unpivot([], [f"`{m}`" for m in map(str, multiples)], "multiple", "rate")
