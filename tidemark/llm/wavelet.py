"""Token-id output as wavelet matrices: one compressed file of bit-planes for each shard of consecutive documents.

A shard holds a run of whole documents in ascending doc_id order, about shard_tokens ids. Its file stores the shard's
alphabet (the distinct ids, sorted), then one bit-plane for each bit of an alphabet index, most significant first. A
plane lists the bits of the sequence as ordered by the planes above: ids with a 0 come before those with a 1. Planes are
cut into blocks that are compressed apart, and a directory keeps the ones before each block, so access, rank and select
inflate one block for each plane. Files are rows of a Parquet table (shard_part, shard_seq, payload), so any Hadoop file system
serves them and Spark's commit protocol makes retries safe.

Nulls: a null text is an empty document (only the end id); a null doc_id sorts first. Documents that share a doc_id are
kept apart, in order of their texts. An empty table gives no shards. Columns other than the two used are ignored."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, splits, steps, text_or_empty
from .tokens import encoder, vocabulary

MAGIC = b"TMWM1\0\0\0"
#: Bits of a plane that are compressed as one block.
BLOCK = 1 << 18
SHARD_SCHEMA = "shard_part int, shard_seq int, n_docs int, n_tokens long, payload binary"
DOC_SCHEMA = "shard_part int, shard_seq int, ord int, doc_id long, shard_start long, n_tokens long, ids_crc32 long"


def _pack(arrays: list[bytes]) -> bytes:
    return b"".join(struct.pack("<Q", len(a)) + a for a in arrays)


def _unpack(data: memoryview) -> Iterator[memoryview]:
    at = 0
    while at < len(data):
        (n,) = struct.unpack_from("<Q", data, at)
        yield data[at + 8 : at + 8 + n]
        at += 8 + n


def write_shard(ids: np.ndarray, doc_ids: list[int | None], cuts: np.ndarray) -> bytes:
    """The file of one shard. cuts: n_docs + 1 offsets into ids."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    seen = np.zeros(int(ids.max()) + 1 if len(ids) else 0, bool)
    seen[ids] = True
    alphabet = np.flatnonzero(seen).astype(np.uint32)
    index = np.zeros(len(seen), np.uint32)
    index[alphabet] = np.arange(len(alphabet), dtype=np.uint32)
    levels = max(1, int(len(alphabet) - 1).bit_length()) if len(alphabet) else 0
    row = index[ids]
    if len(alphabet) <= 1 << 16:
        row = row.astype(np.uint16)
    n = len(row)
    blocks = -(-n // BLOCK)
    zeros, ones, sizes, payload = [], [], [], []
    for level in range(levels - 1, -1, -1):
        bit = row & row.dtype.type(1 << level) != 0
        for b in range(blocks):
            part = bit[b * BLOCK : (b + 1) * BLOCK]
            payload.append(squeeze(np.packbits(part, bitorder="little").tobytes()))
            sizes.append(len(payload[-1]))
            ones.append(np.count_nonzero(part))
        # places of set bits are found without a branch a bit, which a choice by the bits themselves takes
        low = np.flatnonzero(~bit)
        zeros.append(len(low))
        row = np.concatenate((row.take(low), row.take(np.flatnonzero(bit))))
    head = struct.pack("<QQQ", n, len(doc_ids), levels)
    null = np.array([d is None for d in doc_ids], np.uint8)
    ids64 = np.array([d or 0 for d in doc_ids], np.int64)
    return MAGIC + _pack([head, squeeze(null.tobytes()), squeeze(ids64.tobytes()), squeeze(np.diff(cuts).astype(np.int64).tobytes()), squeeze(alphabet.tobytes()), np.array(zeros, np.int64).tobytes(), np.array(ones, np.int64).tobytes(), np.array(sizes, np.int64).tobytes(), b"".join(payload)])


class Shard:
    """Reads one file: access, rank, select, count, occurrences and whole decoding, without inflating more than it needs."""

    def __init__(self, data: bytes):
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a wavelet shard")
        head, null, ids, sizes, alphabet, zeros, ones, spans, self.payload = _unpack(memoryview(data)[8:])
        self.n, self.n_docs, self.levels = struct.unpack("<QQQ", head)
        grow = lambda x, kind: np.frombuffer(zstandard.decompress(x), kind)
        self.doc_ids = [None if z else int(d) for z, d in zip(grow(null, np.uint8), grow(ids, np.int64), strict=True)]
        self.cuts = np.concatenate(([0], np.cumsum(grow(sizes, np.int64))))
        self.alphabet = grow(alphabet, np.uint32)
        self.zeros = np.frombuffer(zeros, np.int64)
        self.blocks = -(-self.n // BLOCK)
        self.ones = np.frombuffer(ones, np.int64).reshape(self.levels, self.blocks)
        self.before = np.concatenate((np.zeros((self.levels, 1), np.int64), np.cumsum(self.ones, axis=1)), axis=1)
        self.at = np.concatenate(([0], np.cumsum(np.frombuffer(spans, np.int64))))
        self.held: dict[int, np.ndarray] = {}

    def _bits(self, level: int, block: int) -> np.ndarray:
        k = level * self.blocks + block
        if k not in self.held:
            if len(self.held) > 64:
                self.held.clear()
            packed = np.frombuffer(zstandard.decompress(self.payload[self.at[k] : self.at[k + 1]]), np.uint8)
            self.held[k] = np.unpackbits(packed, count=min(BLOCK, self.n - block * BLOCK), bitorder="little")
        return self.held[k]

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block, rest = divmod(i, BLOCK)
        return int(self.before[level, block]) + (int(np.count_nonzero(self._bits(level, block)[:rest])) if rest else 0)

    def _select(self, level: int, bit: int, k: int) -> int:
        """Where the k-th (from 0) bit of this value is."""
        before = self.before[level] if bit else np.arange(self.blocks + 1) * BLOCK - self.before[level]
        if not bit:
            before[-1] = self.n - self.before[level, -1]
        block = int(np.searchsorted(before, k, side="right")) - 1
        return block * BLOCK + int(np.flatnonzero(self._bits(level, block) == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        symbol = 0
        for level in range(self.levels):
            block, rest = divmod(i, BLOCK)
            bit, ones = int(self._bits(level, block)[rest]), self._rank1(level, i)
            symbol, i = symbol * 2 + bit, int(self.zeros[level]) + ones if bit else i - ones
        return int(self.alphabet[symbol])

    def _index(self, token: int) -> int | None:
        k = int(np.searchsorted(self.alphabet, token))
        return k if k < len(self.alphabet) and self.alphabet[k] == token else None

    def rank(self, token: int, i: int) -> int:
        """How often token is among the first i ids."""
        if (symbol := self._index(token)) is None:
            return 0
        lo, hi = 0, i
        for level in range(self.levels):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            lo, hi = (int(self.zeros[level]) + a, int(self.zeros[level]) + b) if symbol >> (self.levels - 1 - level) & 1 else (lo - a, hi - b)
        return hi - lo

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        return self.rank(token, self.n if end is None else end) - self.rank(token, start)

    def select(self, token: int, k: int) -> int:
        """Where the k-th (from 0) occurrence of token is."""
        symbol = self._index(token)
        if symbol is None or not 0 <= k < self.count(token):
            raise IndexError(k)
        at = 0
        for level in range(self.levels):
            ones = self._rank1(level, at)
            at = int(self.zeros[level]) + ones if symbol >> (self.levels - 1 - level) & 1 else at - ones
        at += k
        for level in range(self.levels - 1, -1, -1):
            bit = symbol >> (self.levels - 1 - level) & 1
            at = self._select(level, bit, at - int(self.zeros[level]) * bit)
        return at

    def occurrences(self, token: int) -> Iterator[tuple[int | None, int]]:
        """(doc_id, place in the document) of each occurrence."""
        for k in range(self.count(token)):
            at = self.select(token, k)
            doc = int(np.searchsorted(self.cuts, at, side="right")) - 1
            yield self.doc_ids[doc], at - int(self.cuts[doc])

    def ids(self) -> np.ndarray:
        """All ids, rebuilt from the last plane to the first."""
        row = np.zeros(self.n, np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            packed = [np.unpackbits(np.frombuffer(zstandard.decompress(self.payload[self.at[k] : self.at[k + 1]]), np.uint8), count=min(BLOCK, self.n - b * BLOCK), bitorder="little") for b in range(self.blocks) for k in [level * self.blocks + b]]
            bit = (np.concatenate(packed) if packed else np.zeros(0, np.uint8)).astype(bool)
            up, zeros = np.empty_like(row), int(self.zeros[level])
            up[np.flatnonzero(~bit)] = row[:zeros]
            up[np.flatnonzero(bit)] = row[zeros:] | row.dtype.type(1 << (self.levels - 1 - level))
            row = up
        return self.alphabet[row]


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, shard_tokens: int = 2_000_000) -> None:
    """Encode every text and write shards under path, in ascending doc_id order over (shard_part, shard_seq)."""
    tokenizer = tokenizer or vocabulary()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode = TaskContext.get().partitionId(), encoder(tokenizer)
        seq, ids, docs_held, sizes, held = 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, ids, docs_held, sizes, held
            payload = write_shard(np.concatenate(ids), docs_held, np.concatenate(([0], np.cumsum(np.concatenate(sizes)))))
            out = pa.RecordBatch.from_pydict({"shard_part": pa.array([part], pa.int32()), "shard_seq": pa.array([seq], pa.int32()), "n_docs": pa.array([len(docs_held)], pa.int32()), "n_tokens": pa.array([held], pa.int64()), "payload": pa.array([payload], pa.binary())})
            seq, ids, docs_held, sizes, held = seq + 1, [], [], [], 0
            return out

        for batch in steps(batches, "text", keep=True):
            got, cuts = encode(batch.column("text"), end_id)
            ids.append(got)
            docs_held += batch.column("doc_id").to_pylist()
            sizes.append(np.diff(cuts))
            held += len(got)
            if held >= shard_tokens:
                yield flush()
        if docs_held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    ordered = rows.repartitionByRange(splits(rows), "doc_id").sortWithinPartitions("doc_id", "text")
    # the planes are compressed already
    ordered.mapInArrow(shards, SHARD_SCHEMA).write.option("compression", "none").parquet(path)


def read_documents(spark, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, payload in zip(batch["shard_part"].to_pylist(), batch["shard_seq"].to_pylist(), batch["payload"], strict=True):
                shard = Shard(payload.as_buffer())
                ids, cuts = shard.ids().astype("<u4", copy=False), shard.cuts
                view = memoryview(ids).cast("B") if len(ids) else memoryview(b"")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                n = shard.n_docs
                yield pa.RecordBatch.from_pydict({"shard_part": pa.array(np.full(n, part, np.int32)), "shard_seq": pa.array(np.full(n, seq, np.int32)), "ord": pa.array(np.arange(n, dtype=np.int32)), "doc_id": pa.array(shard.doc_ids, pa.int64()), "shard_start": pa.array(cuts[:-1]), "n_tokens": pa.array(np.diff(cuts)), "ids_crc32": pa.array(crc, pa.int64())})

    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    within = Window.partitionBy("shard_part").orderBy("shard_seq")
    totals = shards.groupBy("shard_part").agg(F.sum("n_tokens").alias("part_tokens"))
    parts = totals.select("shard_part", (F.sum("part_tokens").over(Window.orderBy("shard_part")) - F.col("part_tokens")).alias("part_start"))
    starts = shards.select("shard_part", "shard_seq", (F.sum("n_tokens").over(within) - F.col("n_tokens")).alias("seq_start")).join(parts, "shard_part")
    start = F.col("part_start") + F.col("seq_start") + F.col("shard_start")
    return shards.select("shard_part", "shard_seq", "payload").mapInArrow(documents, DOC_SCHEMA).join(starts, ["shard_part", "shard_seq"]).select("doc_id", start.alias("start"), "n_tokens", "ids_crc32", "shard_part", "shard_seq")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write the shards to the shared folder and return what the files say of each document."""
    path = shared_dir(docs.sparkSession, "wavelet")
    write(docs, path, **options)
    return read_documents(docs.sparkSession, path)
