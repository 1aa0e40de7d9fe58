"""Stages are made again when what they rest on has changed, and only then."""

import json

from pyspark.sql import functions as F

from tidemark.sources.stages import Stages, fingerprint


def job(spark, path, source, made, factor=2, version="1"):
    stages = Stages(spark, path)
    stages.run("bars", lambda: (made.append("bars"), source.where("x > 0"))[1], [source], version="1")
    stages.run("features", lambda: (made.append("features"), spark.read.parquet(f"{path}/bars").withColumn("y", F.col("x") * factor))[1], after=["bars"], version=version)
    return stages, stages.run("ranks", lambda: (made.append("ranks"), spark.read.parquet(f"{path}/features").select("y"))[1], after=["features"])


def test_changes_run_what_rests_on_them(spark, tmp_path):
    path, source = str(tmp_path / "job"), spark.createDataFrame([(i, f"s{i % 3}") for i in range(-2, 8)], "x int, s string")
    made: list[str] = []
    stages, _ = job(spark, path, source, made)
    assert made == ["bars", "features", "ranks"]
    assert [(r.stage, r.place, r.rows) for r in stages.report().orderBy("place").collect()] == [("bars", 0, 7), ("features", 1, 7), ("ranks", 2, 7)]
    job(spark, path, source.orderBy(F.desc("x")).repartition(3), made)  # the same rows in another order
    assert made == ["bars", "features", "ranks"]
    _, got = job(spark, path, source, made, factor=3, version="2")
    assert made[3:] == ["features", "ranks"] and got.agg(F.max("y")).first()[0] == 21
    _, got = job(spark, path, source.unionByName(source.limit(0).union(spark.createDataFrame([(50, "s")], source.schema))), made, factor=3, version="2")
    assert made[5:] == ["bars", "features", "ranks"] and got.agg(F.max("y")).first()[0] == 150
    job(spark, path, source.where("x < 8").unionByName(spark.createDataFrame([(50, "s"), (-5, "s")], source.schema)), made, factor=3, version="2")
    assert made[8:] == ["bars"]  # the new row doesn't get past the first stage, so nothing else changes


def test_a_stage_without_its_record_is_made_again(spark, tmp_path):
    path, source = str(tmp_path / "job"), spark.createDataFrame([(1, "a")], "x int, s string")
    made: list[str] = []
    job(spark, path, source, made)
    record = tmp_path / "job" / "features.json"
    assert json.loads(record.read_text())["rows"] == 1
    (tmp_path / "job" / ".features.json.crc").unlink()
    record.write_text("{broken")
    job(spark, path, source, made)
    assert made[3:] == ["features"]


def test_fingerprints_see_rows_repeats_and_types(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "x int, s string")
    assert fingerprint(t) == fingerprint(t.orderBy(F.desc("x")))
    others = [t.union(t), t.withColumn("x", F.col("x").cast("long")), t.withColumn("s", F.lit("a")), t.limit(0), t.withColumn("s", F.lit(None).cast("string"))]
    assert len({fingerprint(x) for x in [t, *others]}) == 6
