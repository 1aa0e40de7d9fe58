"""Steps that many queries share: rows change hands once, and are made once."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation as ev
from tidemark.operators import features as ft
from tidemark.operators import labels as lb
from tidemark.operators import training as tr
from tidemark.sources import bars as src

START = dt.date(2024, 1, 1)


def plan(table):
    return table._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def counted(spark):
    """A table whose rows add to a counter each time they are made."""
    made = spark.sparkContext.accumulator(0)

    def table(rows, schema):
        def look(frames):
            for f in frames:
                made.add(len(f))
                yield f

        df = spark.createDataFrame(rows, schema)
        return df.mapInPandas(look, df.schema)

    return made, table


def _entries(n=400):
    return [(f"S{i % 7}", START + dt.timedelta(days=i // 2), START + dt.timedelta(days=i // 2 + i % 5), i % 3 - 1) for i in range(n)]


def test_bars_and_their_windows_share_an_exchange(spark, small):
    lines = spark.read.parquet(f"{small}/lineitem.parquet")
    assert plan(ft.returns(src.bars_from_lines(lines))).count("Exchange hashpartitioning") == 1


def test_overlaps_meet_no_other_table(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(300):
        a = int(rng.integers(0, 60))
        rows.append((i, f"S{i % 4}", None if i % 41 == 5 else START + dt.timedelta(days=a), None if i % 53 == 7 else START + dt.timedelta(days=a + int(rng.integers(0, 9)))))
    out = lb.overlaps(spark.createDataFrame(rows, "id int, symbol string, t0 date, t1 date"))
    assert "Join" not in plan(out)
    low = lambda d: d or dt.date.min
    want = {i: sum(x[1] == s and low(x[2]) <= low(b) for x in rows) - sum(x[1] == s and low(x[3]) < low(a) for x in rows) - 1 for i, s, a, b in rows}
    assert {r.id: r.n_overlapping for r in out.collect()} == want


def test_weights_make_their_labels_once(spark, counted):
    made, table = counted
    rows = [(i % 3 - 1, i % 6) for i in range(300)]
    got = lb.weights(table(rows, "hit int, n_overlapping long")).collect()
    assert len(got) == 300 and made.value == 300


@pytest.mark.parametrize(
    "job",
    [
        lambda t: tr.row_folds(t, 3, 10),
        lambda t: tr.early_stop_split(tr.gap_folds(t, 2, 60, 5, 5, 10), features=["hit"]),
        lambda t: tr.date_folds(t, 2, 5, 10),
        lambda t: ev.purged_kfold(t, 4),
        lambda t: tr.sample_weights(t.withColumn("x", F.col("hit") + 2.0), "atr_percent", "x"),
    ],
    ids=["row_folds", "early_stop_split", "date_folds", "purged_kfold", "sample_weights"],
)
def test_folds_and_weights_make_their_rows_once(spark, counted, job):
    made, table = counted
    assert job(table(_entries(), "symbol string, entry date, exit date, hit int")).count() > 0
    assert made.value == 400
