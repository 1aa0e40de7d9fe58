"""Benchmark decontamination with a distributed positional inverted index.

build() cuts the documents into segments of a few MB and stores for each its terms, their counts and the positions of
every term, sorted by term and place; no term's postings are moved, so a frequent word burdens no task. A search goes
through the segments: each window of a test item starts from its rarest term there, and the candidates are intersected
with the position lists of the other terms, rarest first, after taking off their offsets in the window. What is left are
exact phrase matches; near() does the same with a distance in place of an offset. Test items are a query set: they are
taken to the segments in blocks of a bounded size.

Words: A-Z lower-cased, then runs of ASCII letters and digits and of characters beyond ASCII. Nulls: a null text has no
words; items whose id or text is null have no windows. Documents that share a doc_id are judged one by one, so repeated rows give
repeated results. An empty table gives no rows. Columns other than the ids and texts are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ALNUM, EACH_ALONE, STEP_BYTES, Words, distinct, keyed, steps, store, text_or_empty, without

INDEX = "part int, seq int, doc_ids array<long>, rows array<int>, terms array<binary>, counts array<int>, postings binary"
MATCHES = "part int, seq int, ord int, doc_id long, item_id string, first_word long, end_word long"
#: Bytes of test items that are taken to the segments at a time, and candidates that are intersected at a time.
BLOCK_BYTES, CANDIDATES = 4 << 20, 1 << 20


def build(docs: DataFrame) -> DataFrame:
    """The stored index of docs (doc_id, text)."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for seq, batch in enumerate(steps(batches, "text", 2 * STEP_BYTES)):
            words = Words(batch.column("text"), ALNUM, lower=True)
            order = np.argsort(words.codes, kind="stable").astype(np.int32)
            counts = np.bincount(words.codes, minlength=len(words.distinct)).astype(np.int32)
            heads = np.cumsum(counts) - counts
            deltas = np.diff(order, prepend=np.int32(0))
            deltas[heads] = order[heads]
            one = lambda values: pa.ListArray.from_arrays(np.array([0, len(values)], np.int32), values)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), one(batch.column("doc_id")), one(pa.array(words.rows.astype(np.int32))), one(words.distinct), one(pa.array(counts)), pa.array([deltas.tobytes()], pa.binary())], names=["part", "seq", "doc_ids", "rows", "terms", "counts", "postings"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return store(rows.mapInArrow(segments, INDEX), "postings", compression="zstd", **EACH_ALONE)


def documents(index: DataFrame) -> DataFrame:
    """part, seq, ord, doc_id, n_words of every document in the index."""
    rows = index.select("part", "seq", "rows", F.posexplode("doc_ids").alias("ord", "doc_id"))
    return rows.select("part", "seq", "ord", "doc_id", (F.col("rows")[F.col("ord") + 1] - F.col("rows")[F.col("ord")]).cast("long").alias("n_words"))


class Segment:
    """One row of the index, with its postings as keys (term, place) in ascending order."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        self.part, self.seq = batch["part"][i].as_py(), batch["seq"][i].as_py()
        self.doc_ids, self.terms = batch["doc_ids"][i].values, batch["terms"][i].values
        self.rows = batch["rows"][i].values.to_numpy().astype(np.int64)
        self.counts = batch["counts"][i].values.to_numpy().astype(np.int64)
        deltas = np.frombuffer(batch["postings"][i].as_buffer(), np.int32).astype(np.int64)
        self.heads = np.cumsum(self.counts) - self.counts
        running = np.cumsum(deltas)
        self.places = running - np.repeat(running[self.heads] - deltas[self.heads], self.counts) if len(deltas) else deltas
        self.width = np.int64(max(1, self.rows[-1]))
        self.keys = np.repeat(np.arange(len(self.counts)), self.counts) * self.width + self.places

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.rows, place, side="right") - 1

    def holds(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether term stands at place."""
        key = term * self.width + place
        return self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key

    def within(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether term stands somewhere from low to high."""
        at = np.searchsorted(self.keys, term * self.width + low)
        return self.keys[np.minimum(at, len(self.keys) - 1)] <= np.where(at < len(self.keys), term * self.width + high, -1)


class Queries:
    """A block of windows as a matrix of term numbers, -1 beyond a short window's end."""

    def __init__(self, items: list[tuple[str, str]], width: int | None):
        self.names = [name for name, _ in items]
        words = Words(pa.array([text for _, text in items], pa.string()), ALNUM, lower=True)
        self.terms = words.distinct
        windows, owners = [], []
        for k, (a, b) in enumerate(zip(words.rows[:-1].tolist(), words.rows[1:].tolist(), strict=True)):
            codes = words.codes[a:b]
            if width is None:
                codes = distinct(codes)
            size = width or len(codes)
            for at in range(max(1, len(codes) - size + 1) if len(codes) else 0):
                windows.append(codes[at : at + size])
                owners.append(k)
        self.owner = np.array(owners, np.int64)
        self.size = np.array([len(x) for x in windows], np.int64)
        self.matrix = np.full((len(windows), int(self.size.max()) if windows else 0), -1, np.int64)
        for k, x in enumerate(windows):
            self.matrix[k, : len(x)] = x

    def candidates(self, segment: Segment) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(window, its terms here, their order from the rarest, a place of its rarest term), some at a time; windows that lack a term here are out."""
        if not len(self.size) or not len(segment.keys):
            return
        here = pc.fill_null(pc.index_in(self.terms, value_set=segment.terms), -1).to_numpy().astype(np.int64)
        term = np.where(self.matrix >= 0, here[self.matrix], -2)
        live = np.flatnonzero((term != -1).all(axis=1))
        term = term[live]
        rare = np.argsort(np.where(term >= 0, segment.counts[np.maximum(term, 0)], np.iinfo(np.int64).max), axis=1, kind="stable")
        first = term[np.arange(len(live)), rare[:, 0]] if len(live) else np.zeros(0, np.int64)
        sizes = segment.counts[first]
        ends = np.cumsum(sizes)
        at = 0
        while at < len(live):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CANDIDATES, side="right")))
            some = np.repeat(np.arange(at, to), sizes[at:to])
            offset = np.arange(len(some)) - np.repeat(np.cumsum(sizes[at:to]) - sizes[at:to], sizes[at:to])
            yield live[some], term[some], rare[some], segment.places[segment.heads[first[some]] + offset]
            at = to

    def phrases(self, segment: Segment) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, first place, place after the last) of every occurrence of a window."""
        found = []
        for window, term, rare, place in self.candidates(segment):
            start = place - rare[:, 0]
            size = self.size[window]
            keep = np.flatnonzero((start >= 0) & (start + size <= segment.rows[-1]))
            keep = keep[segment.document(start[keep]) == segment.document(start[keep] + size[keep] - 1)]
            for step in range(1, term.shape[1]):
                if not len(keep):
                    break
                offset = rare[keep, step]
                wanted = term[keep, offset]
                keep = keep[(wanted < 0) | segment.holds(wanted, start[keep] + offset)]
            found.append((self.owner[window[keep]], start[keep], start[keep] + size[keep]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3

    def near(self, segment: Segment, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, low, high) around every place of an item's rarest term that has all its other terms within distance in the same document."""
        found = []
        for window, term, rare, place in self.candidates(segment):
            doc = segment.document(place)
            low = np.maximum(place - distance, segment.rows[doc])
            high = np.minimum(place + distance, segment.rows[doc + 1] - 1)
            keep = np.arange(len(place))
            for step in range(1, term.shape[1]):
                wanted = term[keep, rare[keep, step]]
                keep = keep[(wanted < 0) | segment.within(wanted, low[keep], high[keep])]
            found.append((self.owner[window[keep]], low[keep], high[keep] + 1))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def _merged(item: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Overlapping or touching spans of one item in one document become one."""
    order = np.lexsort((end, start, item, doc))
    item, start, end, doc = (x[order] for x in (item, start, end, doc))
    fresh = np.ones(len(item), bool)
    if len(item):
        # spans of one item and kind have one length, so their ends ascend as their starts do
        fresh[1:] = (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] > end[:-1])
    heads = np.flatnonzero(fresh)
    last = np.append(heads[1:], len(item)) - 1 if len(heads) else heads
    return item[heads], start[heads], end[last], doc[heads]


def _blocks(items: DataFrame, id_column: str) -> Iterator[list[tuple[str, str]]]:
    rows = items.select(F.col(id_column).cast("string"), F.col("text").cast("string")).where(F.col(id_column).isNotNull() & F.col("text").isNotNull())
    block, held = [], 0
    for name, text in rows.toLocalIterator():
        if held and held + len(text) > BLOCK_BYTES:
            yield block
            block, held = [], 0
        block.append((name, text))
        held += len(text)
    if block:
        yield block


def _search(index: DataFrame, items: DataFrame, id_column: str, width: int | None, distance: int | None) -> DataFrame:
    spark = index.sparkSession

    def matcher(shared):
        def matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries = shared.value
            for batch in batches:
                for i in range(batch.num_rows):
                    segment = Segment(batch, i)
                    item, start, end = queries.phrases(segment) if distance is None else queries.near(segment, distance)
                    item, start, end, doc = _merged(item, start, end, segment.document(start))
                    n, head = len(item), segment.rows[doc]
                    yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(n, segment.part, np.int32)), "seq": pa.array(np.full(n, segment.seq, np.int32)), "ord": pa.array(doc.astype(np.int32)), "doc_id": segment.doc_ids.take(pa.array(doc)), "item_id": pa.array([queries.names[k] for k in item.tolist()], pa.string()), "first_word": pa.array(start - head), "end_word": pa.array(end - head)})

        return matches

    found = [index.mapInArrow(matcher(spark.sparkContext.broadcast(Queries(block, width))), MATCHES) for block in _blocks(items, id_column)]
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], MATCHES)


def phrases(index: DataFrame, items: DataFrame, width: int = 10, id_column: str = "item_id") -> DataFrame:
    """Spans of words [first_word, end_word) of documents that windows of width words of an item cover; an item with fewer words is one window."""
    return _search(index, items, id_column, width, None)


def near(index: DataFrame, items: DataFrame, distance: int, id_column: str = "item_id") -> DataFrame:
    """Spans around an item's rarest term in which all terms of the item lie at most distance words from it."""
    return _search(index, items, id_column, None, distance)


def report(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and items (their ids as strings)."""
    index = build(docs)
    key = ["part", "seq", "ord"]
    found = phrases(index, items, width)
    earlier = Window.partitionBy(*key).orderBy("first_word", "end_word").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("end_word").over(earlier), F.lit(0))
    fresh = F.greatest(F.col("end_word") - F.greatest("first_word", reached), F.lit(0))
    hits = found.withColumn("fresh", fresh).groupBy(*key).agg(F.sum("fresh").alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("items"))
    items_here = F.coalesce("items", F.array().cast("array<string>"))
    rows = documents(index).join(hits, key, "left").withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "items": items_here})
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items", *key)


def clean(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """The rows of docs, with all their columns, that hold no window of an item."""
    rows, key = keyed(docs)
    found = phrases(build(rows.select(F.col(key).alias("doc_id"), "text")), items, width)
    return without(rows, key, found.select("doc_id"))
