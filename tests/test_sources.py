import datetime as dt
import os

from tidemark.sources import bars as src

DAY = dt.date(2024, 1, 5)


def _stock(spark, symbol, close=1.0):
    return spark.createDataFrame([(symbol, DAY, close)], "symbol string, date date, close double")


def test_universe_symbols(spark, tmp_path):
    file = tmp_path / "u.csv"
    file.write_text("Symbol,Description\nZZZ,Zed Inc\nAAA,Able Inc\nBBB/WS,Warrants\nAAA,Able Inc\n,Nothing\n")
    assert src.universe_symbols(spark, str(file)) == ["ZZZ", "AAA", "AAA"]
    assert src.universe_symbols(spark, str(file), most=1) == ["ZZZ"]
    assert src.universe_symbols(spark, str(file), only_tradeable=False) == ["ZZZ", "AAA", "BBB/WS", "AAA"]


def test_newest_cache_wins(spark, tmp_path):
    one, two, funds = (str(tmp_path / n) for n in ("one", "two", "funds"))
    assert src.newest(spark, [one, two]) is None
    assert src.read_cached(spark, [one, two], funds).count() == 0
    _stock(spark, "ONE").write.parquet(one)
    _stock(spark, "TWO").write.parquet(two)
    _stock(spark, "SPY").write.parquet(funds)
    os.utime(one, (2_000_000_000, 2_000_000_000))
    assert {tuple(r) for r in src.read_cached(spark, [one, two], funds).select("symbol", "kind").collect()} == {("ONE", "stock"), ("SPY", "fund")}
    os.utime(two, (2_000_000_100, 2_000_000_100))
    assert [r.symbol for r in src.read_cached(spark, [one, two]).collect()] == ["TWO"]


def test_weekly_table_grows_by_missing_symbols(spark, tmp_path):
    path = str(tmp_path / "weekly")
    src.write_table(_stock(spark, "A", 1.0), path)
    grown = src.upsert_missing(src.read_prices(spark, path), _stock(spark, "A", 2.0).unionAll(_stock(spark, "B", 3.0)))
    assert {(r.symbol, r.close) for r in grown.collect()} == {("A", 1.0), ("B", 3.0)}


def test_targets(spark, tmp_path):
    rows = [("A", "2024-01-05", "2024-01-09", 1), ("A", "2024-01-08", "2024-01-10", 0), ("B", "2024-01-08", None, -1), ("B", "2024-01-09", None, None)]
    path = str(tmp_path / "labels")
    spark.createDataFrame(rows, "symbol string, t0 string, t_hit string, hit int").write.parquet(path)
    got = {(r.symbol, r.entry_date.day, r.hit, r.target) for r in src.read_targets(spark, path).collect()}
    assert got == {("A", 5, 1, 1), ("B", 8, -1, 0), ("B", 9, None, 0)}
    assert src.read_targets(spark, path, neutral=True).count() == 4
    assert src.targets(spark.read.parquet(path).limit(0)).count() == 0
