"""Streams against the same rows as a batch."""

import pandas as pd
from pyspark.sql import functions as F

from tidemark.streaming import bars as sb


def ticks(spark, small, tmp_path):
    rows = spark.read.parquet(f"{small}/events.parquet").select(F.col("user_id").cast("string").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.abs("value").alias("value"))
    path = str(tmp_path / "ticks")
    rows.orderBy("ts").coalesce(1).write.parquet(path)
    return rows, spark.readStream.schema(rows.schema).parquet(path)


def drain(stream, name, tmp_path, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
    query.processAllAvailable()
    query.stop()
    return stream.sparkSession.table(name)


def test_weekly_bars_are_final_when_the_week_has_passed(spark, small, tmp_path):
    rows, stream = ticks(spark, small, tmp_path)
    got = drain(sb.weekly_bars(stream), "weekly", tmp_path)
    whole = {(r.symbol, r.date): (r.open, r.high, r.low, r.close, r.n) for r in sb.weekly_bars(rows).collect()}
    last = rows.agg(F.max("ts")).first()[0]
    done = {(r.symbol, r.date): (r.open, r.high, r.low, r.close, r.n) for r in got.collect()}
    assert done and all(whole[k] == v for k, v in done.items())
    assert all(pd.Timestamp(d) <= pd.Timestamp(last) for _, d in done)
    assert all(d.weekday() == 4 for _, d in done)


def test_smoothing_state(spark, small, tmp_path):
    rows, stream = ticks(spark, small, tmp_path)
    got = drain(sb.smoothed(stream, 10), "smooth", tmp_path).toPandas().sort_values(["symbol", "ts"])
    for _, f in got.groupby("symbol"):
        want = f["value"].ewm(span=10, adjust=False).mean()
        assert abs(want - f["ema"]).max() < 1e-9
    assert len(got) == rows.count()


def test_barriers(spark, small, tmp_path):
    rows, stream = ticks(spark, small, tmp_path)
    got = drain(sb.barriers(stream, 0.5, 0.5, 5), "touch", tmp_path).toPandas()
    want = {}
    for s, f in rows.toPandas().sort_values("ts").groupby("symbol"):
        v, t = f["value"].tolist(), f["ts"].tolist()
        for i in range(len(v)):
            for k in range(1, 6):
                if i + k >= len(v):
                    break
                hit = 1 if v[i + k] >= 1.5 * v[i] else -1 if v[i + k] <= 0.5 * v[i] else 0
                if hit or k == 5:
                    want[(s, t[i])] = (hit, k)
                    break
    assert {(r.symbol, r.entered): (r.hit, r.used) for r in got.itertuples()} == want


def test_coverage(spark, small, tmp_path):
    _, stream = ticks(spark, small, tmp_path)
    assert drain(sb.coverage(stream), "cover", tmp_path).where("share < 0 or share > 1").count() == 0
