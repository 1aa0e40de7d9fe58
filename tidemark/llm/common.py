"""Helpers shared by the corpus operators: shared storage, batch slicing and byte-level word splitting."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step works on; bounds the scratch arrays of a task.
STEP_BYTES = 2 << 20
#: Rows of whole texts that go to a Python worker at a time; Spark's own 10,000 would stand in the JVM and the worker at once.
ROWS = 2_000
#: Options of a Parquet table whose rows are some MB each: every row is a row group. Writers look at the bytes of a group only after a hundred rows, and
#: readers take a group's rows, up to 4,096, at once.
EACH_ALONE = {"parquet.block.row.count.limit": "1"}


@functools.cache
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="tidemark-")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir. Where none is named, a folder of this machine serves a
    local session; a cluster is refused, as its executors could not read it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[[^\[\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_dir(context.applicationId)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands texts to Python workers ROWS rows at a time, or fewer if it does so already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS:
        spark.conf.set(key, str(ROWS))


def store(df: DataFrame, name: str, **options) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage."""
    small_batches(df.sparkSession)
    path = shared_dir(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table that store() wrote and that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that are done: it does so when the driver collects its garbage, which many short
    jobs in a row don't bring about."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def splits(df: DataFrame) -> int:
    """Partitions for a shuffle of whole rows: as many as the session asks for, at least as many as the input has."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: Calls that free what a worker keeps between tasks.
HELD: list[Callable[[], None]] = []


def steps(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP_BYTES, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each slice holds about limit bytes of column, or one row. Unless keep is set, what another
    operator's tasks have left in the worker is freed first."""
    if not keep:
        for free in HELD:
            free()
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = raw(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
        tidy()


@functools.cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return None


def tidy() -> None:
    """Give freed memory back to the system; workers live on after a task and would hold on to their largest batch."""
    pa.default_memory_pool().release_unused()
    if _trim() is not None:
        _trim()(0)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets of its rows; nulls are empty."""
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    width = np.int64 if large else np.int32
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column over data cut at offsets."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def table_of(allowed) -> np.ndarray:
    lut = np.zeros(256, bool)
    lut[list(allowed)] = True
    return lut


#: Bytes of words. Continuation and lead bytes of UTF-8 are 0x80 and up, so a class over code points is one over bytes here.
ALNUM = table_of([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
SPACED = table_of(set(range(256)) - {0x20, *range(0x09, 0x0E)})
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Words:
    """The words of a text column: codes into a dictionary of distinct words, and where each row's words begin.

    codes: int32 per word; distinct: binary array; rows: n + 1 offsets into codes; starts, ends: byte positions."""

    def __init__(self, column: pa.Array, allowed: np.ndarray, lower: bool, encode: bool = True):
        data, offsets = raw(column)
        if lower:
            data = LOWER[data]
        inside = np.zeros(len(data) + 1, bool)
        inside[:-1] = allowed[data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets[:-1]] = True
        opens = inside[:-1] & (~np.concatenate(([False], inside[:-2])) | first[:-1]) if len(data) else np.zeros(0, bool)
        closes = inside[:-1] & (~inside[1:] | first[1:]) if len(data) else np.zeros(0, bool)
        self.starts, self.ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.rows = np.searchsorted(self.starts, offsets)
        self.data, self.offsets = data, offsets
        self.inside = inside[:-1]
        if encode:
            coded = self.words.dictionary_encode()
            self.codes, self.distinct = coded.indices.to_numpy(), coded.dictionary

    @functools.cached_property
    def words(self) -> pa.Array:
        """The words, one after the other."""
        return binary(self.data[self.inside], np.concatenate(([0], np.cumsum(self.ends - self.starts))))

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word, for words that needn't be told by codes."""
        return span_hashes(self.data, self.starts, self.ends, seed)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of a word up to which it is hashed with the others, eight at a time; longer ones are hashed one by one.
LONG = 64
#: Masks that keep the first k bytes of eight.
FIRST = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes, as uint64; equal bytes have equal hashes, wherever they stand. Other seeds give independent ones."""
    size = ends - starts
    out = size.astype(np.uint64) * GOLDEN ^ np.uint64(seed)
    if not len(size):
        return out
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(data) + 1,), (1,), writeable=False)
    at, some = 0, np.flatnonzero(size <= LONG)
    while len(some):
        left = size[some] - at
        out[some] = mix(out[some] ^ (eight[starts[some] + at] & FIRST[np.minimum(left, 8)]))
        at += 8
        some = some[left > 8]
    long = np.flatnonzero(size > LONG)
    if len(long):
        from xxhash import xxh3_64_intdigest

        view = memoryview(np.ascontiguousarray(data))
        out[long] = np.fromiter((xxh3_64_intdigest(view[a:b], seed) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)), np.uint64, len(long))
    return out


def hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each binary value, as uint64."""
    data, offsets = raw(words)
    return span_hashes(data, offsets[:-1], offsets[1:], seed)


def runs(of: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash for each of the len(of) - k + 1 runs of k words, from the words' hashes."""
    n = len(of) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, factor = np.zeros(n, np.uint64), 1
    for i in range(k):
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
        out += of[i : i + n] * np.uint64(factor)
    return mix(out)


def shingles(codes: np.ndarray, word_hash: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash for each of the len(codes) - k + 1 runs of k words."""
    return runs(word_hash[codes], k)


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in ascending order, by sorting: np.unique hashes, which is slow where most values differ."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def pack_ints(values: np.ndarray) -> bytes:
    """64-bit integers as compressed byte planes."""
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_ints(data: bytes, kind=np.int64) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(kind).ravel()


def by_bucket(buckets: int, ids: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    """(bucket, packed ids, packed columns...) of rows dealt by a hash of their id."""
    bucket = (mix(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    columns = [x[order] for x in (ids, *columns)]
    return [(b, *(pack_ints(x[cuts[b] : cuts[b + 1]].astype(np.int64)) for x in columns)) for b in range(buckets) if cuts[b] < cuts[b + 1]]


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows (uid, text) whose uid ascends as doc_id does, and uid -> doc_id.

    Where doc_ids are whole and distinct they serve themselves, and the second is None. Else rows are numbered by doc_id
    (nulls first) and text, which costs one shuffle of the texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    if rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").isEmpty():
        return rows.select(F.col("doc_id").alias("uid"), "text"), None
    ordered = rows.repartitionByRange(splits(rows), "doc_id").sortWithinPartitions("doc_id", "text")
    held = store(ordered.select("doc_id", "text", F.monotonically_increasing_id().alias("uid")), "numbered", compression="zstd")
    return held.select("uid", "text"), held.select("uid", "doc_id")


#: Ids (8 bytes each) that may be broadcast to the scans; beyond that rows are joined.
MOST_IDS = 2_000_000
KEY = "__tidemark_key"


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column that tells its rows apart, and that column's name: doc_id where it is whole and distinct, else a stored row number."""
    small_batches(docs.sparkSession)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n"))
    if ids.where("n > 1 or doc_id is null").isEmpty():
        return docs, "doc_id"
    return store(docs.withColumn(KEY, F.monotonically_increasing_id()), "keyed"), KEY


def without(docs: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """docs but for the rows whose key is in the one column of ids; a helper column is dropped."""
    ids = store(ids.toDF("id").distinct(), "ids")
    if ids.count() > MOST_IDS:
        kept = docs.join(ids, docs[key].cast("long") == ids["id"], "left_anti")
        return kept.drop(KEY)
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(ids.toPandas()["id"].to_numpy(dtype=np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone = shared.value
        for batch in batches:
            at = batch.column(batch.schema.get_field_index(key)).cast(pa.int64()).to_numpy()
            yield batch.filter(pa.array(~np.isin(at, gone)))

    return docs.mapInArrow(run, docs.schema).drop(KEY)
