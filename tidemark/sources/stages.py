"""Stages of a long job that know their input: each is written once with a record of what it was made from, and made again where that has changed."""

from __future__ import annotations

import functools
import hashlib
import json
import re
import tempfile
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.cache
def _own(application: str) -> str:
    return tempfile.mkdtemp(prefix="tidemark-")


def shared_path(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a folder of this machine in a local session without one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\[\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own(spark.sparkContext.applicationId)
    return base.rstrip("/")


def fingerprint(table: DataFrame) -> tuple[int, str]:
    """Rows of a table, and a signature of its schema and rows that doesn't depend on their order: sums of two hashes of each row, added as
    decimals, which can't overflow. Columns of maps can't be hashed."""
    names = table.columns
    x, y = F.xxhash64(*names), F.xxhash64(F.lit(7), *names)
    low = F.lit((1 << 31) - 1)
    sums = [F.sum(v.bitwiseAND(low).cast("decimal(12,0)")) for v in (x, F.shiftrightunsigned(x, 31).bitwiseAND(low), y)]
    row = table.agg(F.count("*").alias("n"), *(s.alias(f"s{i}") for i, s in enumerate(sums))).first()
    return row[0], hashlib.sha256(json.dumps([table.schema.jsonValue(), [str(v) for v in row]]).encode()).hexdigest()


class Stages:
    """Named stages in order. A stage is taken as it stands if its record names the same inputs (rows, schema, signature), the same version and, of the stages
    before it, the same records; else it and with it all that rest on it are made again. Records are JSON beside the data, written last."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.records: dict[str, dict] = {}

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}.json")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def record(self, name: str) -> dict | None:
        """The record of a stage, or None where there is none that is whole."""
        path, fs = self._file(name)
        if not fs.exists(path):
            return None
        try:
            return json.loads("".join(r[0] for r in self.spark.read.text(path.toString()).collect()))
        except ValueError:
            return None

    def _keep(self, name: str, record: dict) -> None:
        path, fs = self._file(name)
        out = fs.create(path, True)
        out.write(bytearray(json.dumps(record).encode()))
        out.close()

    def run(self, name: str, make: Callable[[], DataFrame], inputs: Iterable[DataFrame] = (), after: Iterable[str] = (), version: str = "") -> DataFrame:
        """The stage's table. inputs: source tables it reads; after: earlier stages it reads; version: changes when its code or settings do."""
        asked = {"version": version, "inputs": [list(fingerprint(t)) for t in inputs], "after": {n: self.records[n]["signature"] for n in after}}
        record = self.record(name)
        if record is None or record["asked"] != asked:
            path, fs = self._file(name)
            fs.delete(path, False)
            make().write.mode("overwrite").parquet(f"{self.path}/{name}")
            rows, signature = fingerprint(self.spark.read.parquet(f"{self.path}/{name}"))
            record = {"stage": name, "place": len(self.records), "asked": asked, "rows": rows, "signature": signature, "schema": self.spark.read.parquet(f"{self.path}/{name}").schema.jsonValue()}
            self._keep(name, record)
        self.records[name] = record
        return self.spark.read.parquet(f"{self.path}/{name}")

    def report(self) -> DataFrame:
        """stage, place, rows, signature, version of the stages run so far."""
        rows = [(r["stage"], r["place"], r["rows"], r["signature"], r["asked"]["version"]) for r in self.records.values()]
        return self.spark.createDataFrame(rows, "stage string, place int, rows long, signature string, version string")
