"""Jobs around a model: sample weights, folds, probability calibration, metric sets, importance and health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import evaluation as ev
from .order import held, quantile, quantiles
from .panel import small


def class_ratio(rows: DataFrame, label: str) -> DataFrame:
    """One row: negatives by positives, 1 if there is no positive."""
    return rows.agg(F.count_if(F.col(label) == 1).alias("n_positive"), F.count_if(F.col(label) != 1).alias("n_negative")).withColumn("ratio", F.when(F.col("n_positive") > 0, F.col("n_negative") / F.col("n_positive")).otherwise(1.0))


def sample_weights(rows: DataFrame, scheme: str, x: str | None = None, floor: float = 0.01) -> DataFrame:
    """weight by scheme: uniform, overlap (x as it is), liquidity (log1p), inverse_volatility or atr_percent (x at least 0.005, by the
    mean); nulls weigh 1, nothing less than floor, and the sum is the number of rows."""
    if scheme == "uniform":
        raw: Column = F.lit(1.0)
    elif scheme == "overlap":
        raw = F.col(x)
    elif scheme == "liquidity":
        raw = F.log1p(F.greatest(F.col(x), F.lit(0.0)))
    elif scheme == "inverse_volatility":
        raw = 1 / F.greatest(F.col(x), F.lit(0.005))
    elif scheme == "atr_percent":
        raw = F.greatest(F.col(x), F.lit(0.005))
    else:
        raise ValueError(scheme)
    out = held(rows).withColumn("__w", F.when(F.col(x).isNotNull(), raw) if x else raw)
    mean = out.agg(F.avg("__w").alias("__m"))
    scaled = F.col("__w") if scheme in ("uniform", "overlap") else F.col("__w") / (F.col("__m") + (1e-10 if scheme == "liquidity" else 0.0))
    out = out.join(F.broadcast(mean)).withColumn("__w", F.greatest(F.coalesce(scaled, F.lit(1.0)), F.lit(floor)))
    whole = out.agg(F.sum("__w").alias("__t"), F.count("*").alias("__n"))
    return out.join(F.broadcast(whole)).withColumn("weight", F.col("__w") / F.col("__t") * F.col("__n")).drop("__w", "__m", "__t", "__n")


def row_folds(rows: DataFrame, splits: int = 5, least: int = 500, tie: str = "symbol") -> DataFrame:
    """fold, role and row of folds of equally many rows, walking back from the end (fold 0 is the last); training rows come
    before the test and exit by its first entry. Folds with fewer training rows than least are out."""
    rows = held(rows)
    n = rows.count()
    size = n // (splits + 1)
    spans = [(k, n - (k + 1) * size) for k in range(splits) if size and n - (k + 1) * size >= least]
    return _cut_folds(rows, [(k, a, a + size, 0, a) for k, a in spans], least, tie, True)


def gap_folds(rows: DataFrame, splits: int, size: int, gap: int = 0, purge: int = 0, least: int = 1, train: int | None = None, tie: str = "symbol") -> DataFrame:
    """fold, role and row of the last splits blocks of size rows; training ends gap + purge rows before the test and is all that is
    earlier, or the last train rows of it."""
    rows = held(rows)
    n = rows.count()
    spans = []
    for k in range(splits):
        a = n - (splits - k) * size
        end = a - gap - purge
        start = max(0, end - train) if train else 0
        if end - start >= least and a < n:
            spans.append((k, a, min(a + size, n), start, end))
    return _cut_folds(rows, spans, least, tie, False)


def _cut_folds(rows: DataFrame, spans: list[tuple[int, int, int, int, int]], least: int, tie: str, purge: bool) -> DataFrame:
    """spans: fold, first and last (exclusive) test row, the same of training, by place in time."""
    placed = held(ev.numbered(rows, "entry", tie))
    i = F.col("__i")
    # the folds that a row belongs to: a short array from numbers known to the driver
    of = F.array(*(F.when((i >= a) & (i < b), F.struct(F.lit(k).alias("fold"), F.lit("test").alias("role"), F.lit(a).alias("at"))).when((i >= c) & (i < d), F.struct(F.lit(k).alias("fold"), F.lit("train").alias("role"), F.lit(a).alias("at"))) for k, a, b, c, d in spans)) if spans else F.array().cast("array<struct<fold:int,role:string,at:int>>")
    out = placed.withColumn("__f", F.explode(F.array_compact(of))).select(*rows.columns, "__i", "__f.fold", "__f.role", "__f.at")
    if purge:
        starts = out.where("role = 'test' and __i = at").select("fold", F.col("entry").alias("__starts"))
        out = out.join(small(starts), "fold").where((F.col("role") == "test") | (F.col("exit") <= F.col("__starts"))).drop("__starts")
    many = out.groupBy("fold").agg(F.count_if(F.col("role") == "train").alias("__n")).where(F.col("__n") >= least).select("fold")
    return out.join(small(many), "fold").drop("__i", "at")


def date_folds(rows: DataFrame, splits: int = 5, gap: int = 20, least: int = 3000, date: str = "entry") -> DataFrame:
    """fold (0 is the earliest), role and row of expanding folds over distinct dates; training ends gap dates before the test.
    Folds with fewer training rows than least are out."""
    rows = held(rows)
    days = rows.select(F.col(date).alias("__d")).distinct()
    n = days.count()
    first = max(least // 100, 50)
    size = (n - first) // (splits + 1)
    spans = [(k, n - (k + 1) * size, n - k * size, n - (k + 1) * size - gap) for k in range(splits)] if size > 0 else []
    spans = [s for s in spans if s[3] - 1 >= first]
    placed = days.withColumn("__k", F.row_number().over(Window.orderBy("__d")) - 1)
    k = F.col("__k")
    of = F.array(*(F.when((k >= a) & (k < b), F.struct(F.lit(f).alias("fold"), F.lit("test").alias("role"))).when(k < t, F.struct(F.lit(f).alias("fold"), F.lit("train").alias("role"))) for f, a, b, t in spans)) if spans else F.array().cast("array<struct<fold:int,role:string>>")
    out = rows.join(small(placed), F.col(date) == F.col("__d")).withColumn("__f", F.explode(F.array_compact(of))).select(*rows.columns, "__f.fold", "__f.role")
    sizes = out.groupBy("fold").agg(F.count_if(F.col("role") == "train").alias("a"), F.count_if(F.col("role") == "test").alias("b")).where((F.col("a") >= least) & (F.col("b") > 0))
    order = sizes.select(F.col("fold").alias("__g"), (F.row_number().over(Window.orderBy(F.desc("fold"))) - 1).alias("fold"))
    return out.withColumnRenamed("fold", "__g").join(small(order), "__g").drop("__g")


def early_stop_split(folds: DataFrame, share: float = 0.85, features: list[str] | None = None, tie: str = "symbol") -> DataFrame:
    """Training rows of each fold without nulls in features, in time order: part fit for the first share of them, stop for the rest."""
    train = folds.where("role = 'train'")
    train = train.dropna(subset=features) if features else train
    # places inside a fold from counts a date, so that no fold is ordered in one task
    day = train.groupBy("fold", "entry").agg(F.count("*").alias("__n"))
    order = Window.partitionBy("fold").orderBy("entry")
    day = day.select("fold", "entry", (F.sum("__n").over(order) - F.col("__n")).alias("__o"), F.sum("__n").over(Window.partitionBy("fold")).alias("__all"))
    inside = F.row_number().over(Window.partitionBy("fold", "entry").orderBy(tie)) - 1
    out = train.withColumn("__p", inside).join(day, ["fold", "entry"])
    return out.withColumn("part", F.when(F.col("__o") + F.col("__p") < F.floor(F.col("__all") * share), "fit").otherwise("stop")).drop("__o", "__all", "__p")


def fold_metrics(scored: DataFrame, by: list[str], tie: str) -> DataFrame:
    """Per group: AUC, average precision, log loss, Brier score, hit rate, precision of the tails, calibration errors."""
    parts = [ev.auc(scored, by), ev.average_precision(scored, by), ev.losses(scored, by), ev.tail_precision(scored, by, tie), ev.calibration_error(scored, by)]
    return reduce(lambda a, b: a.join(b, by, "left"), parts)


def importance_summary(gains: DataFrame) -> DataFrame:
    """gains (fold, feature, gain): mean, sample deviation and share of folds with any gain."""
    folds = gains.select(F.countDistinct("fold").alias("k"))
    out = gains.groupBy("feature").agg(F.avg("gain").alias("mean"), F.stddev_samp("gain").alias("dev"), F.count_if(F.col("gain") > 0).alias("n"))
    return out.join(F.broadcast(folds)).select("feature", "mean", "dev", (F.col("n") / F.col("k")).alias("share"))


def importance_drift(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """baseline, current (feature, gain): correlation over the features of both, and how many there are."""
    both = baseline.join(current.withColumnRenamed("gain", "now"), "feature")
    return both.agg(F.corr("gain", "now").alias("corr"), F.count("*").alias("n"))


#: Levels at which a model is found to have aged or drifted.
HEALTH = {"auc_critical": 0.55, "auc_warning": 0.60, "days": 5, "importance": 0.80, "shift": 2.0, "age_warning": 14, "age_critical": 30, "share": 0.3, "center": 0.5, "spread": 0.15}


def health(daily_auc: DataFrame, drift: DataFrame, predictions: DataFrame, trained, today, levels: dict[str, float] = HEALTH) -> DataFrame:
    """check, value, level (ok, warning, critical): age of the model, AUC of the last days, correlation of importances, shift of the mean
    prediction, share of predictions above 0.7. Each check is one aggregate."""
    age = predictions.agg(F.datediff(F.lit(today).cast("date"), F.lit(trained).cast("date")).cast("double").alias("value"))
    last = daily_auc.orderBy(F.desc("date")).limit(int(levels["days"]))
    worst = last.agg(F.max("auc").alias("value"), F.max_by("auc", "date").alias("__now"), F.count("*").alias("__n"))
    mean = predictions.agg((F.abs(F.avg("probability") - levels["center"]) / levels["spread"]).alias("value"), F.avg((F.col("probability") > 0.7).cast("double")).alias("__share"))
    level = lambda bad, odd: F.when(bad, "critical").when(odd, "warning").otherwise("ok")
    v = F.col("value")
    full = F.col("__n") >= levels["days"]
    parts = [
        age.select(F.lit("age").alias("check"), "value", level(v >= levels["age_critical"], v >= levels["age_warning"]).alias("level")),
        # below a level on all of the last days, or today below the higher one
        worst.select(F.lit("auc"), F.col("__now"), level(full & (v < levels["auc_critical"]), (full & (v < levels["auc_warning"])) | (F.col("__now") < levels["auc_warning"]))),
        drift.where("n > 5").select(F.lit("importance"), F.col("corr"), level(F.lit(False), F.col("corr") < levels["importance"])),
        mean.select(F.lit("shift"), v, level(F.lit(False), v > levels["shift"])),
        mean.select(F.lit("conviction"), F.col("__share"), level(F.lit(False), F.col("__share") > levels["share"])),
    ]
    return reduce(DataFrame.unionAll, parts)


def calibrated(train: DataFrame, rows: DataFrame, method: str = "isotonic", score: str = "p", label: str = "y") -> DataFrame:
    """rows with calibrated, fitted on train: a rising step function, or a logistic curve over the logit of the score (platt)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    if method == "isotonic":
        y = lambda t: t.withColumn("__y", F.col(label).cast("double"))
        pack = VectorAssembler(inputCols=[score], outputCol="__x", handleInvalid="skip")
        model = IsotonicRegression(featuresCol="__x", labelCol="__y", predictionCol="calibrated").fit(pack.transform(y(train)))
        return model.transform(pack.transform(rows)).drop("__x")
    p = F.least(F.greatest(F.col(score), F.lit(1e-6)), F.lit(1 - 1e-6))
    logit = lambda t: t.withColumns({"__l": F.log(p / (1 - p)), "__y": F.col(label).cast("double") if label in t.columns else F.lit(0.0)})
    pack = VectorAssembler(inputCols=["__l"], outputCol="__x", handleInvalid="skip")
    model = LogisticRegression(featuresCol="__x", labelCol="__y", probabilityCol="__p", predictionCol="__c", rawPredictionCol="__r").fit(pack.transform(logit(train)))
    return model.transform(pack.transform(logit(rows))).withColumn("calibrated", vector_to_array("__p")[1]).drop("__l", "__y", "__x", "__p", "__c", "__r")


def strong_pairs(strength: DataFrame, least: float, members: list[str] | None = None, named: Column | None = None, top: float = 0.9) -> DataFrame:
    """strength (a, b, priority): pairs of at least that priority whose features are members, and which are named or in the top tenth."""
    rows = strength.where(F.col("priority") >= least)
    if members is not None:
        rows = rows.where(F.col("a").isin(members) & F.col("b").isin(members))
    high = F.col("priority") >= F.lit(quantile(rows, "priority", top))
    return rows.where(high if named is None else named | high)


def improvement(base: DataFrame, candidate: DataFrame, ratio: float = 0.6, harm: float = 0.01) -> DataFrame:
    """base, candidate (fold, score): share of folds that don't fall, greatest fall, and whether the candidate improves enough folds and harms none."""
    gain = base.join(candidate.withColumnRenamed("score", "__c"), "fold").select((F.col("__c") - F.col("score")).alias("gain"))
    out = gain.agg(F.avg((F.col("gain") >= 0).cast("double")).alias("share_up"), F.greatest(-F.min("gain"), F.lit(0.0)).alias("worst_fall"))
    return out.withColumns({"improves": F.col("share_up") >= ratio, "harms": F.col("worst_fall") > harm})


def threshold_weights(signals: DataFrame, regimes: dict[str, float], entry: float = 0.5, scale: float = 1.0, most: float = 0.1, least: float = 0.01, regime: str = "regime") -> DataFrame:
    """weight from how far the probability exceeds the entry threshold, times what the regime asks for; within bounds."""
    sure = F.least(F.greatest((F.col("probability") - entry) / (1 - entry), F.lit(0.0)), F.lit(1.0))
    times = F.lit(1.0)
    for name, factor in regimes.items():
        times = F.when(F.col(regime) == name, factor).otherwise(times)
    raw = F.when(F.col("probability") >= entry, F.least(F.greatest(sure * scale * most * times, F.lit(0.0)), F.lit(most))).otherwise(0.0)
    return signals.withColumn("__w", raw).withColumn("weight", F.when(F.col("__w") >= least, F.col("__w")).otherwise(0.0)).drop("__w")


def blended(weights: DataFrame, penalty: float) -> DataFrame:
    """Weights of symbols that were held the week before, drawn to what they were then; new ones stay."""
    weeks = weights.select("week").distinct().withColumn("__n", F.row_number().over(Window.orderBy("week")))
    placed = weights.join(small(weeks), "week")
    before = placed.select((F.col("__n") + 1).alias("__n"), "symbol", F.col("weight").alias("__old"))
    mixed = F.when(F.col("__old").isNotNull(), (1 - penalty) * F.col("weight") + penalty * F.col("__old")).otherwise(F.col("weight"))
    return placed.join(before, ["__n", "symbol"], "left").withColumn("weight", mixed).drop("__n", "__old")


def expected_trades(signals: DataFrame, least: float) -> DataFrame:
    """Per week count of signals at or above a probability, and their mean over weeks, in one row."""
    weekly = signals.groupBy("week").agg(F.count_if(F.col("probability") >= least).alias("k"))
    return weekly.agg(F.avg("k").alias("per_week"), F.min("k").alias("least"), F.max("k").alias("most"), F.count("*").alias("n_weeks"))


def screened(candidates: DataFrame, edge: float, reward_risk: float, n: int, key: str = "edge") -> DataFrame:
    """The n best candidates by a key of those whose probability exceeds the break-even one by edge and whose reward is enough for the risk."""
    rows = candidates.withColumn("edge", F.col("probability") - F.col("break_even"))
    return rows.where((F.col("edge") >= edge) & (F.col("reward_risk") >= reward_risk)).orderBy(F.desc(key), "symbol", "date").limit(n)


def standard_chain(rows: DataFrame, columns: list[str], bound: float = 3.0) -> DataFrame:
    """Winsorised at 1 and 99 per cent, then as z-scores within bounds: {column}_wz."""
    clipped = ev.winsorise(rows, columns)
    scored = ev.standardise(clipped, [f"{c}_w" for c in columns], bound)
    return scored.withColumnsRenamed({f"{c}_w_z": f"{c}_wz" for c in columns})


def fitted_state(rows: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """What the chain learns, a row a column: column, low, high, mean and dev of the values within. It can be stored and applied later."""
    cuts = quantiles(rows, {c: [low, high] for c in columns})
    bound = {c: [F.lit(v).cast("double") for v in cuts[c]] for c in columns}
    held = {c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), bound[c][0]), bound[c][1])) for c in columns}
    one = rows.agg(*(F.struct(bound[c][0].alias("low"), bound[c][1].alias("high"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("dev")).alias(c) for c, v in held.items()))
    return one.unpivot([], columns, "feature", "s").select("feature", "s.low", "s.high", "s.mean", "s.dev")


def apply_state(rows: DataFrame, state: DataFrame, columns: list[str], bound: float = 3.0) -> DataFrame:
    """rows with {column}_wz by a stored state; null where the column is, or where it was constant."""
    wide = state.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("low", "high", "mean", "dev")))).alias("__s"))
    out = rows.join(F.broadcast(wide))
    for c in columns:
        s = F.col("__s")[c]
        z = (F.least(F.greatest(F.col(c), s["low"]), s["high"]) - s["mean"]) / F.nullif(s["dev"], F.lit(0.0))
        out = out.withColumn(f"{c}_wz", F.when(F.col(c).isNotNull() & z.isNotNull(), F.least(F.greatest(z, F.lit(-bound)), F.lit(bound))))
    return out.drop("__s")
