"""Precision of the tails: the rows that a plain order of all of them takes, from counts a score and key."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import evaluation as ev


def plain(scored, by, key, share=0.1):
    w = Window.partitionBy(*by)
    size = F.greatest(F.lit(1), F.floor(F.count("*").over(w) * share))
    up, down = F.row_number().over(w.orderBy(F.desc("p"), key, "y")), F.row_number().over(w.orderBy(F.asc("p"), key, "y"))
    rows = scored.withColumns({"k": size, "u": up, "d": down})
    return rows.groupBy(*by).agg(F.avg(F.when(F.col("u") <= F.col("k"), F.col("y"))).alias("top"), F.avg(F.when(F.col("d") <= F.col("k"), F.col("y"))).alias("bottom"))


@pytest.mark.parametrize("share", [0.1, 0.37, 0.0])
def test_tails_of_ties_and_nulls(spark, share):
    rng = random.Random(3)
    some = lambda x: None if rng.random() < 0.05 else x
    rows = [(rng.choice(["a", "b", None]), some(rng.randrange(4) / 4), some(f"S{rng.randrange(6)}"), some(float(rng.randrange(3)))) for _ in range(700)]
    scored = spark.createDataFrame(rows, "g string, p double, s string, y double")
    got = {r.g: (r.top, r.bottom, r.spread) for r in ev.tail_precision(scored, ["g"], "s", share).collect()}
    want = {r.g: (r.top, r.bottom) for r in plain(scored, ["g"], "s", share).collect()}
    assert set(got) == set(want) == {"a", "b", None}
    for g, (top, bottom) in want.items():
        assert got[g][:2] == (pytest.approx(top) if top is not None else None, pytest.approx(bottom) if bottom is not None else None)


def test_no_order_of_all_rows(spark):
    """Many rows of few scores and symbols are counted before they change hands."""
    scored = spark.range(20_000, numPartitions=2).select((F.col("id") % 2).alias("g"), (F.col("id") % 3).alias("p"), (F.col("id") % 5).alias("s"), (F.col("id") % 7).alias("y"))
    text = ev.tail_precision(scored, ["g"], "s")._jdf.queryExecution().optimizedPlan().toString()
    for window in [x for x in text.split("\n") if "Window [" in x and "row_number" not in x]:
        assert "__n" in window  # counts


def test_folds_are_scored_once(spark):
    import datetime as dt

    from tidemark.operators import model as md

    rng = random.Random(1)
    rows = [(f"S{i % 5}", dt.date(2020, 1, 1) + dt.timedelta(days=i // 5), rng.random(), i % 2) for i in range(400)]
    t = spark.createDataFrame(rows, "symbol string, date date, a double, y int")
    early = F.col("date") < dt.date(2020, 3, 1)
    folds = t.withColumns({"fold": F.lit(0), "role": F.when(early, "train").otherwise("test")})
    _, metrics = md.out_of_fold(folds, ["a"], "y", "date", "symbol", maxIter=1, maxDepth=2)
    assert "InMemoryTableScan" in metrics._jdf.queryExecution().executedPlan().toString()
    job = md.fit_job(t, ["a"], "y", "date", "symbol", maxIter=1, measured=False)
    assert job.settings["auc"] is None and job.settings["fit"] + job.settings["held_out"] == 400
