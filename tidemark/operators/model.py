"""One job around a model: fit, calibrate on rows it hasn't seen, score, measure, and a stored job that another one loads."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .order import held, quantile
from .selection import train_fold
from .training import fold_metrics

KEPT = ("fit", "held_out", "auc", "brier", "top", "bottom", "calibrated_brier")


@dataclass
class Job:
    """A fitted model, what calibrates its probability, and how it came about (features, label, cut, method and the metrics of the rows held out)."""

    model: PipelineModel
    calibrator: PipelineModel
    settings: dict

    def score(self, rows: DataFrame) -> DataFrame:
        """rows with p and calibrated; columns of the model's own are left out."""
        out = _probability(self.model, rows)
        steps = [c for c in ("__l", "__x", "__p", "__r", "__c", "__s") if c not in rows.columns]
        made = self.calibrator.transform(out)
        value = F.col("__s") if self.settings["method"] == "isotonic" else vector_to_array("__p")[1]
        return made.withColumn("calibrated", value).drop(*steps)

    def ranked(self, rows: DataFrame, date: str, tie: str, n: int | None = None) -> DataFrame:
        """Scored rows with their rank in their date by calibrated probability, then p, then tie; the first n of each date if n is given."""
        order = Window.partitionBy(date).orderBy(F.desc("calibrated"), F.desc("p"), tie)
        out = self.score(rows).withColumn("rank", F.row_number().over(order))
        return out if n is None else out.where(F.col("rank") <= n)

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        self.calibrator.write().overwrite().save(f"{path}/calibrator")
        spark = SparkSession.active()
        kind = "features array<string>, label string, date string, method string, cut double, " + ", ".join(f"{k} double" for k in KEPT)
        spark.createDataFrame([self.settings], kind).write.mode("overwrite").json(f"{path}/settings")


def load(spark: SparkSession, path: str) -> Job:
    settings = spark.read.json(f"{path}/settings").first().asDict()
    return Job(PipelineModel.load(f"{path}/model"), PipelineModel.load(f"{path}/calibrator"), settings)


def _probability(model: PipelineModel, rows: DataFrame) -> DataFrame:
    made = model.transform(rows)
    return made.withColumn("p", vector_to_array("probability")[1]).select(*rows.columns, "p")


def calibration(method: str) -> Pipeline:
    """From p to __s (a rising step function) or __p (a logistic curve over the log odds)."""
    if method == "isotonic":
        return Pipeline(stages=[VectorAssembler(inputCols=["p"], outputCol="__x", handleInvalid="skip"), IsotonicRegression(featuresCol="__x", labelCol="__y", predictionCol="__s")])
    if method != "platt":
        raise ValueError(f"{method} is no way of calibration")
    odds = SQLTransformer(statement="SELECT *, ln(least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6))) AS __l FROM __THIS__")
    return Pipeline(stages=[odds, VectorAssembler(inputCols=["__l"], outputCol="__x", handleInvalid="skip"), LogisticRegression(featuresCol="__x", labelCol="__y", probabilityCol="__p", predictionCol="__c", rawPredictionCol="__r")])


def fit_job(rows: DataFrame, features: Sequence[str], label: str, date: str, tie: str, method: str = "isotonic", share: float = 0.85, weight: str | None = None, measured: bool = True, **options) -> Job:
    """Fit on the rows up to the date below which share of them lie, calibrate and measure on the later ones. Rows with a null label are left out; a part without rows or
    with one class is an error, as nothing can be learnt from it. Without measured, only the rows of both parts are counted."""
    needed = dict.fromkeys([*features, label, date, tie, *([weight] if weight else [])])
    known = rows.where(F.col(label).isNotNull()).select(*needed).withColumns({"__y": F.col(label).cast("double"), "__day": F.unix_date(F.col(date)).cast("double")})
    known.persist()  # fitting reads its rows many times
    try:
        return _fit(known, list(features), label, date, tie, method, share, weight, measured, **options)
    finally:
        known.unpersist()


def _fit(known: DataFrame, features: list[str], label: str, date: str, tie: str, method: str, share: float, weight: str | None, measured: bool, **options) -> Job:
    cut = quantile(known, "__day", share)
    parts = {"fit": known.where(F.col("__day") <= F.lit(cut)), "held out": known.where(F.col("__day") > F.lit(cut))}
    for name, part in parts.items():
        if part.select("__y").distinct().count() < 2:
            raise ValueError(f"the rows to be {name} need both classes")
    model = train_fold(parts["fit"], features, "__y", weight, **options)
    scored = _probability(model, parts["held out"])
    job = Job(model, calibration(method).fit(scored), {"features": features, "label": label, "date": date, "method": method, "cut": cut})
    job.settings |= {"fit": float(parts["fit"].count()), "held_out": float(parts["held out"].count())} | dict.fromkeys(KEPT[2:])
    if not measured:
        return job
    rows = job.score(parts["held out"]).select(F.lit(0).alias("g"), "p", "calibrated", F.col("__y").alias("y"), tie).persist()  # each metric reads them
    try:
        one = fold_metrics(rows, ["g"], tie).first()
        after = rows.agg(F.avg(F.pow(F.col("calibrated") - F.col("y"), 2))).first()[0]
    finally:
        rows.unpersist()
    job.settings |= {"calibrated_brier": after} | {k: None if one[k] is None else float(one[k]) for k in ("auc", "brier", "top", "bottom")}
    return job


def out_of_fold(folds: DataFrame, features: Sequence[str], label: str, date: str, tie: str, **options) -> tuple[DataFrame, DataFrame]:
    """folds: rows with fold and role (train, test). Each fold's test rows scored and calibrated by a job of its training rows alone, and a row of metrics a fold: fold, n,
    auc, brier, top, bottom, calibrated_brier, train_n. The loop is over folds, which are few; folds that can't be learnt from are left out."""
    scored, sizes = [], []
    for fold in sorted(r["fold"] for r in folds.select("fold").distinct().collect()):
        here = folds.where(F.col("fold") == fold)
        try:
            job = fit_job(here.where("role = 'train'"), features, label, date, tie, measured=False, **options)
        except ValueError:
            continue
        scored.append(job.score(here.where("role = 'test'")))
        sizes.append((fold, int(job.settings["fit"] + job.settings["held_out"])))
    if not scored:
        raise ValueError("no fold can be learnt from")
    table = reduce(DataFrame.unionByName, scored)
    rows = held(table.where(F.col(label).isNotNull()).select("fold", "p", "calibrated", F.col(label).cast("double").alias("y"), tie))  # scored once, read by each metric
    metrics = fold_metrics(rows, ["fold"], tie).join(rows.groupBy("fold").agg(F.count("*").alias("n"), F.avg(F.pow(F.col("calibrated") - F.col("y"), 2)).alias("calibrated_brier")), "fold")
    return table, metrics.join(F.broadcast(folds.sparkSession.createDataFrame(sizes, "fold int, train_n long")), "fold")
