"""Tables of selected features and fold scores, and the tests and filters on them; and boosted trees per fold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import quantiles


def overlap_matrix(selected: DataFrame) -> DataFrame:
    """selected (model, feature): shared features and Jaccard similarity of every pair of models."""
    sizes = selected.groupBy("model").agg(F.countDistinct("feature").alias("n"))
    s = selected.distinct()
    both = s.alias("x").join(s.alias("y"), (F.col("x.feature") == F.col("y.feature")) & (F.col("x.model") < F.col("y.model"))).groupBy(F.col("x.model").alias("a"), F.col("y.model").alias("b")).agg(F.count("*").alias("shared"))
    n = lambda side: sizes.select(F.col("model").alias(side), F.col("n").alias(f"n_{side}"))
    out = both.join(n("a"), "a").join(n("b"), "b")
    return out.select("a", "b", "shared", (F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).alias("jaccard"))


def core_and_heads(selected: DataFrame) -> DataFrame:
    """Per feature: how many models take it, and whether all, one or some do."""
    models = selected.select(F.countDistinct("model").alias("m"))
    out = selected.groupBy("feature").agg(F.countDistinct("model").alias("n_models")).join(F.broadcast(models))
    return out.select("feature", "n_models", F.when(F.col("n_models") == F.col("m"), "core").when(F.col("n_models") == 1, "head").otherwise("shared").alias("role"))


def changes(old: DataFrame, new: DataFrame, key: str = "feature") -> DataFrame:
    """added, removed or unchanged for every key of either table."""
    a, b = old.select(key, F.lit(True).alias("__o")).distinct(), new.select(key, F.lit(True).alias("__n")).distinct()
    return a.join(b, key, "full").select(key, F.when(F.col("__o").isNull(), "added").when(F.col("__n").isNull(), "removed").otherwise("unchanged").alias("change"))


def accepted(base: DataFrame, candidate: DataFrame, share: float = 0.6) -> DataFrame:
    """base, candidate (fold, score): mean and median gain, share of folds that gain, and whether the candidate is accepted."""
    gain = base.join(candidate.withColumnRenamed("score", "__c"), "fold").select((F.col("__c") - F.col("score")).alias("gain"))
    out = gain.agg(F.avg("gain").alias("mean_gain"), F.percentile("gain", 0.5).alias("median_gain"), F.avg((F.col("gain") >= 0).cast("double")).alias("share_up"), F.min("gain").alias("worst"))
    return out.withColumn("accepted", (F.col("mean_gain") > 0) & (F.col("median_gain") >= 0) & (F.col("share_up") >= share))


def fold_score(scores: DataFrame, by: list[str], penalty: float = 1.0) -> DataFrame:
    return scores.groupBy(*by).agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("dev")).withColumn("penalised", F.col("mean") - penalty * F.col("dev"))


def tiers(importance: DataFrame, core: float = 0.05, low: float = 0.01) -> DataFrame:
    """importance (feature, gain): share of the sum, rank and tier."""
    whole = F.sum("gain").over(Window.partitionBy(F.lit(1)))
    out = importance.withColumn("share", F.col("gain") / whole)
    return out.withColumns({"rank": F.row_number().over(Window.orderBy(F.desc("gain"), "feature")), "tier": F.when(F.col("share") >= core, "core").when(F.col("share") >= low, "borderline").otherwise("low")})


def interactions(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Product, both above their medians, and clipped ratio of each pair of columns."""
    columns = sorted({c for p in pairs for c in p})
    medians = quantiles(rows, {c: [0.5] for c in columns})
    out = {}
    for a, b in pairs:
        out[f"{a}_x_{b}"] = F.col(a) * F.col(b)
        out[f"{a}_and_{b}"] = ((F.col(a) > F.lit(medians[a][0])) & (F.col(b) > F.lit(medians[b][0]))).cast("double")
        out[f"{a}_by_{b}"] = F.when(F.abs(b) > 1e-12, F.least(F.greatest(F.col(a) / F.col(b), F.lit(-100.0)), F.lit(100.0)))
    return rows.withColumns(out)


def candidate_pairs(importance: DataFrame, patterns: list[tuple[str, str]], boost: float = 1.5) -> DataFrame:
    """Pairs of features by the root of their gains' product, more for pairs that a pattern names. The table has one row a feature."""
    a, b = importance.toDF("a", "ga"), importance.toDF("b", "gb")
    named = reduce(lambda x, y: x | y, [(F.col("a").contains(p) & F.col("b").contains(q)) | (F.col("a").contains(q) & F.col("b").contains(p)) for p, q in patterns])
    met = a.join(b, F.col("a") < F.col("b"))
    return met.select("a", "b", (F.sqrt(F.col("ga") * F.col("gb")) * F.when(named, boost).otherwise(1.0)).alias("priority"))


def train_fold(train: DataFrame, features: list[str], label: str, weight: str | None = None, **options):
    """A boosted-tree pipeline fitted to one fold's training rows; nulls in features become 0."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import Imputer, VectorAssembler

    filled = [f"__{f}" for f in features]
    stages = [Imputer(inputCols=features, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="__x", handleInvalid="keep"), GBTClassifier(featuresCol="__x", labelCol=label, seed=7, **({"weightCol": weight} if weight else {}), **options)]
    return Pipeline(stages=stages).fit(train)


def out_of_fold(folds: DataFrame, features: list[str], label: str, **options) -> DataFrame:
    """fold, keys and probability of every test row, each from the model of its own fold. The loop is over folds, which are few."""
    from pyspark.ml.functions import vector_to_array

    out = []
    for fold in sorted(r["fold"] for r in folds.select("fold").distinct().collect()):
        here = folds.where(F.col("fold") == fold)
        # fitting reads its rows many times
        train = here.where("role = 'train'").select(*dict.fromkeys([*features, label, *([options["weight"]] if options.get("weight") else [])])).persist()
        model = train_fold(train, features, label, **options)
        train.unpersist()
        scored = model.transform(here.where("role = 'test'"))
        out.append(scored.withColumn("probability", vector_to_array("probability")[1]).select(*folds.columns, "probability"))
    return reduce(DataFrame.unionByName, out)


def price_levels(predictions: DataFrame, up: float, down: float) -> DataFrame:
    """Target and stop prices, their distances in per cent, reward by risk, and the break-even probability."""
    out = predictions.withColumns({"target_price": F.col("close") + up * F.col("atr"), "stop_price": F.col("close") - down * F.col("atr")})
    out = out.withColumns({"target_pct": (F.col("target_price") / F.col("close") - 1) * 100, "stop_pct": (1 - F.col("stop_price") / F.col("close")) * 100})
    out = out.withColumn("reward_risk", F.when(F.col("stop_pct") > 1e-12, F.col("target_pct") / F.col("stop_pct")))
    return out.withColumn("break_even", 1 / (1 + F.col("reward_risk")))


# Weights of the parts of the score that tuning maximises.
OBJECTIVE = {"auc": 0.20, "aupr": 0.15, "calibration": 0.15, "tail": 0.20, "spread": 0.10, "stability": 0.20}


def composite_score(folds: DataFrame, by: list[str], weights: dict[str, float] = OBJECTIVE) -> DataFrame:
    """by and score, from fold metrics auc, aupr, brier, top and bottom: weighed means of AUC, average precision, calibration (1 - Brier / 0.25), precision of the
    top, its distance to the bottom, and stability (1 - 5 times the relative deviation of AUC, within 0 and 1). A weight that is missing counts as 0."""
    w = {k: F.lit(float(weights.get(k, 0.0))) for k in OBJECTIVE}
    out = folds.groupBy(*by).agg(*(F.avg(c).alias(f"__{c}") for c in ("auc", "aupr", "brier", "top", "bottom")), F.stddev_pop("auc").alias("__dev"))
    stable = F.least(F.greatest(1 - 5 * F.col("__dev") / (F.col("__auc") + 1e-8), F.lit(0.0)), F.lit(1.0))
    score = w["auc"] * F.col("__auc") + w["aupr"] * F.col("__aupr") + w["calibration"] * (1 - F.col("__brier") / 0.25) + w["tail"] * F.col("__top") + w["spread"] * (F.col("__top") - F.col("__bottom")) + w["stability"] * stable
    return out.select(*by, stable.alias("stability"), score.alias("score"))


def feature_sets(selected: DataFrame, known: DataFrame) -> DataFrame:
    """Per model of selected (model, feature; a row for each mention): n_total, n_unique, n_duplicates, n_unknown (features that known lacks), valid. How much
    models share is overlap_matrix."""
    each = selected.groupBy("model", "feature").agg(F.count("*").alias("__n"))
    tagged = each.join(known.select("feature").distinct().withColumn("__known", F.lit(True)), "feature", "left")
    out = tagged.groupBy("model").agg(F.sum("__n").alias("n_total"), F.count("*").alias("n_unique"), F.sum(F.when(F.col("__known").isNull(), 1).otherwise(0)).cast("long").alias("n_unknown"))
    out = out.withColumn("n_duplicates", F.col("n_total") - F.col("n_unique"))
    return out.select("model", "n_total", "n_unique", "n_duplicates", "n_unknown", ((F.col("n_duplicates") == 0) & (F.col("n_unknown") == 0)).alias("valid"))


def head_status(rows: DataFrame, heads: DataFrame, most_null: float = 0.3) -> DataFrame:
    """Per model of heads (model, feature): n_present, n_missing and n_sparse (present, but null in more than most_null of rows). One aggregate over the columns
    that any model names."""
    from .panel import small

    named = [r[0] for r in heads.select("feature").distinct().collect() if r[0] in rows.columns]  # no more than columns
    schema = "feature string, null_share double"
    if named:
        share = rows.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in named)).unpivot([], named, "feature", "null_share")
    else:
        share = rows.sparkSession.createDataFrame([], schema)
    met = heads.dropDuplicates(["model", "feature"]).join(small(share.withColumn("__there", F.lit(1))), "feature", "left")
    return met.groupBy("model").agg(F.count("__there").alias("n_present"), F.count(F.when(F.col("__there").isNull(), 1)).alias("n_missing"), F.count(F.when(F.col("null_share") > most_null, 1)).alias("n_sparse"))


def signal_levels(signals: DataFrame, floor: float = 0.001) -> DataFrame:
    """signals (entry_price, target_price, stop_price) with reward_risk: what the target gains by what the stop loses, a loss of less than floor counting as floor;
    null without a positive entry price."""
    entry = F.when(F.col("entry_price") > 0, F.col("entry_price"))
    loss = 1 - F.col("stop_price") / entry
    return signals.withColumn("reward_risk", (F.col("target_price") / entry - 1) / F.when(loss.isNotNull(), F.greatest(loss, F.lit(floor))))
