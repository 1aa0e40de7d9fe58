"""Rolling columns from stretches of rows, against sliding frames."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import windows as wn

LENGTHS = (1, 2, 5, 7, 20, 33)


def _table(spark):
    rng = np.random.default_rng(8)
    x = [None if rng.random() < 0.2 else float(v) for v in rng.normal(size=240)]
    return spark.createDataFrame([(f"S{i % 3}", dt.date(2024, 1, 1) + dt.timedelta(days=i), v, 1e9 if i < 30 else float(i % 4) * 1e-4) for i, v in enumerate(x)], "symbol string, date date, x double, big double")


def test_against_sliding_frames(spark):
    t = _table(spark)
    wanted, want = {}, {}
    for w in LENGTHS:
        least = max(1, w // 2)
        wanted |= {f"{kind}{w}": (kind, "x", w, least) for kind in ("mean", "sum", "dev", "dev1", "z", "z1", "high", "low")}
        want |= {f"mean{w}": wn.mean("x", w, least), f"sum{w}": wn.total("x", w, least), f"dev{w}": wn.std0("x", w, least), f"dev1{w}": wn.std1("x", w, least), f"z{w}": wn.zscore("x", w, least), f"z1{w}": wn.zscore("x", w, least, sample=True), f"high{w}": wn.high("x", w, least), f"low{w}": wn.low("x", w, least)}
    out = wn.rolled(t, wanted)
    assert out.columns == [*t.columns, *wanted]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "sliding" not in plan and "RowFrame, -32" not in plan
    a, b = out.orderBy("date").collect(), t.withColumns(want).orderBy("date").collect()
    for name in wanted:
        assert [r[name] for r in a] == [None if r[name] is None else pytest.approx(r[name], rel=1e-9, abs=1e-12) for r in b], name
        assert any(r[name] is not None for r in b) or name in ("z1", "z11", "dev11"), name


def test_small_deviations_after_large_values(spark):
    t = _table(spark)
    out = wn.rolled(t, {"d": ("dev", "big", 8, 8)}).where("date >= date '2024-03-15'").collect()
    same = t.withColumn("d", wn.std0("big", 8, 8)).where("date >= date '2024-03-15'").collect()
    assert [r.d for r in sorted(out, key=lambda r: r.date)] == pytest.approx([r.d for r in sorted(same, key=lambda r: r.date)], rel=1e-9)


def test_blocks_have_no_sliding_frames(spark):
    from tidemark.operators import features as ft

    b = _table(spark).select("symbol", "date", *(F.lit(1.0).alias(c) for c in ("open", "high", "low", "close", "adjclose", "volume")))
    for make in (ft.range_breakout, ft.distance):
        assert "RowFrame, -59" not in make(b)._jdf.queryExecution().executedPlan().toString()
