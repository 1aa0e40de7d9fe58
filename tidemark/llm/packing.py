"""Packing: concatenate and cut. Texts are encoded once, every partition's token total gives its global offset by a
prefix sum over the totals, and the stream is cut at fixed windows; a document that crosses a cut leaves a piece on both
sides, which are its boundary records. Only the last sequence is padded.

Nulls: a null text is an empty document (only the end id). A null doc_id is kept. Repeated rows are packed as often as
they come. An empty table gives no pieces. Columns other than the two used are ignored."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import EACH_ALONE, STEP_BYTES, steps, store, text_or_empty
from .tokens import encoder, vocabulary

CODED = "part int, seq int, n_tokens long, doc_ids array<long>, sizes array<long>, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encode(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """A stored table with a row for each few MB of text: the documents' ids one after the other, and the row's token total."""
    tokenizer = tokenizer or vocabulary()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, run = TaskContext.get().partitionId(), encoder(tokenizer)
        for seq, batch in enumerate(steps(batches, "text", 2 * STEP_BYTES, keep=True)):
            ids, cuts = run(batch.column("text"), end_id)
            sizes = np.diff(cuts)
            one = np.array([0, len(sizes)], np.int32)
            narrow = not len(ids) or ids.max() < 1 << 16
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.ListArray.from_arrays(one, batch.column("doc_id")), pa.ListArray.from_arrays(one, pa.array(sizes)), pa.array([(b"\2" if narrow else b"\4") + ids.astype("<u2" if narrow else "<u4").tobytes()], pa.binary())],
                names=["part", "seq", "n_tokens", "doc_ids", "sizes", "ids"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return store(rows.mapInArrow(coded, CODED), "coded", compression="zstd", **EACH_ALONE)


def pack(docs: DataFrame, length: int = 1024, with_ids: bool = False, **options) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, as little-endian unsigned 32-bit)."""
    coded = encode(docs, **options)
    totals = coded.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    parts = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("part_start"))
    within = Window.partitionBy("part").orderBy("seq")
    starts = coded.select("part", "seq", (F.sum("n_tokens").over(within) - F.col("n_tokens")).alias("seq_start")).join(parts, "part")
    starts = starts.select("part", "seq", (F.col("part_start") + F.col("seq_start")).alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                buffer = batch["ids"][i].as_buffer()
                ids = np.frombuffer(buffer, "<u2" if buffer[0] == 2 else "<u4", offset=1).astype("<u4")
                at, sizes = batch["at"][i].as_py(), batch["sizes"][i].values.to_numpy()
                docs_here = batch["doc_ids"][i].values
                ends = np.concatenate(([0], np.cumsum(sizes)))
                inner = np.arange(-(-at // length) * length - at, len(ids), length)
                begins = np.union1d(ends[:-1], inner)
                stops = np.append(begins[1:], len(ids))
                doc = np.searchsorted(ends, begins, side="right") - 1
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begins.tolist(), stops.tolist(), strict=True)]
                out = {"doc_id": docs_here.take(pa.array(doc)), "start": pa.array(begins - ends[doc]), "length": pa.array(stops - begins), "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(sizes[doc]), "sequence_id": pa.array((at + begins) // length), "offset": pa.array((at + begins) % length)}
                if with_ids:
                    out["ids"] = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer((4 * np.append(begins, len(ids))).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_pydict(out)

    return coded.select("part", "seq", "doc_ids", "sizes", "ids").join(F.broadcast(starts) if _few(coded) else starts, ["part", "seq"]).mapInArrow(cut, PIECES + (", ids binary" if with_ids else ""))


#: Rows of the table of offsets that may be broadcast (24 bytes each); beyond that Spark shuffles the encoded rows.
MOST_OFFSETS = 200_000


def _few(coded: DataFrame) -> bool:
    return coded.select("part").limit(MOST_OFFSETS + 1).count() <= MOST_OFFSETS


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences from pieces with ids: sequence_id, n_tokens, ids and the boundary records in order. A sequence holds at most one window of tokens, which bounds the group."""
    record = F.struct("offset", "doc_id", "start", "length", "ids")
    rows = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(record)).alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda whole, part: F.concat(whole, part["ids"]))
    return rows.select("sequence_id", "n_tokens", ids.alias("ids"), F.transform("parts", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["offset"].alias("offset"), x["length"].alias("length"))).alias("boundaries"))
