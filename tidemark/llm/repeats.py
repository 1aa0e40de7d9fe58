"""Substring de-duplication with a log-structured fingerprint index.

A word is removed if a window of 20 words that covers it has stood earlier. Documents arrive in batches of ascending id.
Each batch's fingerprints are dealt to slices by value and merged there with the sorted, immutable runs of the history:
what is new makes one more run, what is known marks both places. Runs are merged into one when there are MOST_RUNS.

The index holds a winnowed set of window hashes: of the runs of 8 words in every window of 20, the one with the smallest
hash. Equal windows pick the same, so none is missed, and the index is a sixth of the size. Marked places are then
verified: all windows that picked a marked run of words are compared by a 128-bit digest of their words, and each that
isn't the first of its kind is a repeat. Copies inside one packed batch are settled there, so a slice gets a window once
from a batch at most, however common it is.

Nulls: a null text has no words. Null and repeated doc_ids are ordered as numbered() does, each row being a document of
its own. An empty table gives no rows. Other columns are ignored."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED, Words, by_bucket, distinct, hashes, numbered, pack_ints, shingles, splits, steps, store, unpack_ints

#: Words of a fingerprint inside a window, runs kept before they are merged, batches that a table is taken in.
INNER, MOST_RUNS, BATCHES = 8, 2, 3
#: Words that are packed together, words for each slice, documents whose ids may be broadcast (8 bytes each).
PACK, SLICE, MOST_BROADCAST = 3_000_000, 6_000_000, 2_000_000
#: kind 0: fingerprints of a batch; 1: of a run; 2: marks.
DEALT = "kind int, slice int, hashes binary, ids binary, places binary, many binary"


class Windows:
    """The windows of a batch of texts: row, start and the place of the run of words that each picks."""

    def __init__(self, texts: pa.Array, width: int):
        words = Words(texts, SPACED, lower=False)
        self.words, self.width = words, width
        self.word_hash = hashes(words.distinct)
        self.other_hash = hashes(words.distinct, 0x6A09E667F3BCC909)
        self.inner = shingles(words.codes, self.word_hash, INNER) >> np.uint64(16)
        row = np.repeat(np.arange(len(texts)), np.diff(words.rows))
        n = max(0, len(row) - width + 1)
        self.start = np.flatnonzero(row[:n] == row[width - 1 :])
        span = width - INNER + 1
        best, pick = self.inner[:n].copy(), np.zeros(n, np.int64)
        for j in range(1, span):
            less = self.inner[j : j + n] < best
            best[less] = self.inner[j : j + n][less]
            pick[less] = j
        self.pick = self.start + pick[self.start]
        self.row = row

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place in the row, fingerprint) of the picked runs."""
        at = distinct(self.pick)
        row = self.row[at]
        return row, at - self.words.rows[row], self.inner[at]

    def digests(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of the windows at which."""
        return shingles(self.words.codes, self.word_hash, self.width)[which], shingles(self.words.codes, self.other_hash, self.width)[which]


def _first(keys: list[np.ndarray], uid: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by keys, then uid and place; whether each in that order begins a group; the group of each."""
    order = np.lexsort((place, uid, *keys[::-1]))
    fresh = np.ones(len(order), bool)
    if len(order):
        differ = np.zeros(len(order) - 1, bool)
        for k in keys:
            k = k[order]
            differ |= k[1:] != k[:-1]
        fresh[1:] = differ
    return order, fresh, np.cumsum(fresh) - 1


def _deal(docs: DataFrame, width: int, slices: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        edges = np.array([-(-(s << 48) // slices) for s in range(slices + 1)], np.uint64)

        def flush(held: list) -> pa.RecordBatch:
            uid, place, h = (np.concatenate(x) for x in zip(*held, strict=True))
            order, fresh, group = _first([h], uid, place)
            uid, place, h = uid[order], place[order], h[order]
            many = np.bincount(group)[group] > 1
            rows = []
            again = many & ~fresh
            if again.any():
                rows.append((2, part % slices, None, pack_ints(uid[again]), pack_ints(place[again]), None))
            uid, place, h, many = uid[fresh], place[fresh], h[fresh], many[fresh]
            cuts = np.searchsorted(h, edges)
            for s in range(slices):
                a, b = cuts[s], cuts[s + 1]
                if a < b:
                    rows.append((0, s, pack_ints(np.diff(h[a:b], prepend=np.uint64(0))), pack_ints(uid[a:b]), pack_ints(place[a:b]), np.packbits(many[a:b]).tobytes()))
            return _dealt(rows)

        held, size = [], 0
        for batch in steps(batches, "text"):
            windows = Windows(batch.column("text"), width)
            row, place, h = windows.anchors()
            if len(h):
                held.append((batch.column("uid").to_numpy()[row], place, h))
            size += len(windows.row)
            if size >= PACK and held:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return docs.mapInArrow(run, DEALT)


def _dealt(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["kind", "slice", "hashes", "ids", "places", "many"])


def _rows(table: pa.Table) -> Iterator[tuple]:
    return zip(*(table.column(c).to_pylist() for c in ("kind", "slice", "hashes", "ids", "places", "many")), strict=True)


class FingerprintIndex:
    """Runs of fingerprints with the place that each was first seen at."""

    def __init__(self, slices: int, width: int = 20):
        self.slices, self.width, self.runs = slices, width, []

    def add(self, docs: DataFrame) -> DataFrame:
        """Take in documents (uid, text), all later than those before; returns marks (kind 2, by bucket of uid)."""
        slices = self.slices

        def merge(table: pa.Table) -> pa.Table:
            new, old, marks, at = [], [], [], 0
            for kind, at, h, ids, places, many in _rows(table):  # noqa: B007
                uid, place = unpack_ints(ids), unpack_ints(places)
                if kind == 2:
                    marks.append((uid, place))
                    continue
                h = np.cumsum(unpack_ints(h, np.uint64), dtype=np.uint64)
                if kind == 1:
                    old.append((h, uid, place))
                else:
                    new.append((h, uid, place, np.unpackbits(np.frombuffer(many, np.uint8), count=len(h)).astype(bool)))
            rows = []
            if new:
                h, uid, place, many = (np.concatenate(x) for x in zip(*new, strict=True))
                order, fresh, group = _first([h], uid, place)
                h, uid, place, many = h[order], uid[order], place[order], many[order]
                hit = np.bincount(group, weights=many) + np.bincount(group) > 1
                heads = np.flatnonzero(fresh)
                known = np.zeros(len(heads), bool)
                if old:
                    was, was_uid, was_place = (np.concatenate(x) for x in zip(*old, strict=True))
                    order = np.argsort(was, kind="stable")
                    was, was_uid, was_place = was[order], was_uid[order], was_place[order]
                    found = np.minimum(np.searchsorted(was, h[heads]), len(was) - 1)
                    known = was[found] == h[heads]
                    marks.append((was_uid[found[known]], was_place[found[known]]))
                hit |= known
                marks.append((uid[hit[group]], place[hit[group]]))
                add = heads[~known]
                if len(add):
                    rows.append((1, at, pack_ints(np.diff(h[add], prepend=np.uint64(0))), pack_ints(uid[add]), pack_ints(place[add]), None))
            if marks:
                uid, place = (np.concatenate(x) for x in zip(*marks, strict=True))
                rows += [(2, b, None, i, p, None) for b, i, p in by_bucket(slices, uid, place)]
            return pa.Table.from_batches([_dealt(rows)])

        dealt = _deal(docs, self.width, slices)
        for run in self.runs:
            dealt = dealt.unionAll(run)
        out = store(dealt.groupBy("slice").applyInArrow(merge, DEALT), "run")
        self.runs.append(out.where("kind = 1"))
        if len(self.runs) > MOST_RUNS:
            self.compact()
        return out.where("kind = 2")

    def compact(self) -> None:
        def whole(table: pa.Table) -> pa.Table:
            parts = [(np.cumsum(unpack_ints(h, np.uint64), dtype=np.uint64), unpack_ints(i), unpack_ints(p)) for _, _, h, i, p, _ in _rows(table)]
            h, uid, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            at = table.column("slice")[0].as_py()
            return pa.Table.from_batches([_dealt([(1, at, pack_ints(np.diff(h[order], prepend=np.uint64(0))), pack_ints(uid[order]), pack_ints(place[order]), None)])])

        runs = self.runs[0]
        for run in self.runs[1:]:
            runs = runs.unionAll(run)
        self.runs = [store(runs.groupBy("slice").applyInArrow(whole, DEALT), "run")]


def _gather(marks: DataFrame) -> DataFrame:
    """A stored table of uid and its marked places, packed in ascending order."""

    def per_document(table: pa.Table) -> pa.Table:
        uid, place = np.concatenate([unpack_ints(x) for x in table.column("ids").to_pylist()]), np.concatenate([unpack_ints(x) for x in table.column("places").to_pylist()])
        order = np.lexsort((place, uid))
        uid, place = uid[order], place[order]
        heads = np.flatnonzero(np.concatenate(([True], uid[1:] != uid[:-1])))
        ends = np.append(heads[1:], len(uid))
        return pa.table({"uid": pa.array(uid[heads]), "places": pa.array([pack_ints(distinct(place[a:b])) for a, b in zip(heads.tolist(), ends.tolist(), strict=True)], pa.binary())})

    return store(marks.groupBy("slice").applyInArrow(per_document, "uid long, places binary"), "places")


def _with_places(docs: DataFrame, places: DataFrame) -> DataFrame:
    """uid, text, places of the documents in places. Their ids go to the scans where they are few enough to broadcast."""
    if places.count() <= MOST_BROADCAST:
        keep = docs.sparkSession.sparkContext.broadcast(np.sort(places.select("uid").toPandas()["uid"].to_numpy(dtype=np.int64)))

        def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            among = keep.value
            for batch in batches:
                uid = batch.column("uid").to_numpy()
                if len(among):
                    yield batch.take(pa.array(np.flatnonzero(among[np.minimum(np.searchsorted(among, uid), len(among) - 1)] == uid)))

        docs = docs.mapInArrow(chosen, "uid long, text string")
    return docs.join(places, "uid")


def _repeats(marked: DataFrame, width: int, slices: int) -> DataFrame:
    """Marks (kind 2) of the starts of windows that have stood earlier."""
    schema = "slice int, one binary, two binary, ids binary, places binary"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        edges = np.array([-(-(s << 48) // slices) for s in range(slices)], np.uint64) << np.uint64(16)

        def flush(held: list) -> pa.RecordBatch:
            uid, place, one, two = (np.concatenate(x) for x in zip(*held, strict=True))
            order, fresh, _ = _first([one, two], uid, place)
            uid, place, one, two = uid[order], place[order], one[order], two[order]
            rows = [(part % slices, None, None, pack_ints(uid[~fresh]), pack_ints(place[~fresh]))] if not fresh.all() else []
            uid, place, one, two = uid[fresh], place[fresh], one[fresh], two[fresh]
            cuts = np.append(np.searchsorted(one, edges), len(one))
            for s in range(slices):
                a, b = cuts[s], cuts[s + 1]
                if a < b:
                    rows.append((s, pack_ints(np.diff(one[a:b], prepend=np.uint64(0))), two[a:b].tobytes(), pack_ints(uid[a:b]), pack_ints(place[a:b])))
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["slice", "one", "two", "ids", "places"])

        held, size = [], 0
        for batch in steps(batches, "text"):
            windows = Windows(batch.column("text"), width)
            heads = windows.words.rows[:-1]
            marked_places = [h + unpack_ints(p) for h, p in zip(heads.tolist(), batch.column("places").to_pylist(), strict=True)]
            flag = np.zeros(len(windows.row) + 1, bool)
            flag[np.concatenate(marked_places)] = True
            start = windows.start[flag[windows.pick]]
            if len(start):
                row = windows.row[start]
                held.append((batch.column("uid").to_numpy()[row], start - heads[row], *windows.digests(start)))
                size += len(start)
            if size >= PACK // 2:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    def meet(table: pa.Table) -> pa.Table:
        marks, parts = [], []
        for one, two, ids, places in zip(*(table.column(c).to_pylist() for c in ("one", "two", "ids", "places")), strict=True):
            if one is None:
                marks.append((unpack_ints(ids), unpack_ints(places)))
            else:
                parts.append((np.cumsum(unpack_ints(one, np.uint64), dtype=np.uint64), np.frombuffer(two, np.uint64), unpack_ints(ids), unpack_ints(places)))
        if parts:
            one, two, uid, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            order, fresh, _ = _first([one, two], uid, place)
            marks.append((uid[order][~fresh], place[order][~fresh]))
        uid, place = (np.concatenate(x) for x in zip(*marks, strict=True))
        return pa.Table.from_batches([_dealt([(2, b, None, i, p, None) for b, i, p in by_bucket(slices, uid, place)])])

    return marked.mapInArrow(deal, schema).groupBy("slice").applyInArrow(meet, DEALT)


def _kept(marked: DataFrame, width: int, with_text: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            words = Words(batch.column("text"), SPACED, lower=False, encode=False)
            removed, texts = [], []
            for a, b, starts in zip(words.rows[:-1].tolist(), words.rows[1:].tolist(), batch.column("places").to_pylist(), strict=True):
                change = np.zeros(b - a + 1, np.int64)
                at = unpack_ints(starts)
                np.add.at(change, at, 1)
                np.add.at(change, at + width, -1)
                covered = np.cumsum(change)[:-1] > 0
                removed.append(int(covered.sum()))
                texts.append(b" ".join(words.words.slice(a, b - a).filter(pa.array(~covered)).to_pylist()))
            out = {"uid": batch.column("uid"), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())}
            if with_text:
                out["kept"] = pa.array([t.decode(errors="replace") for t in texts], pa.string())
            yield pa.RecordBatch.from_pydict(out)

    return marked.mapInArrow(run, "uid long, n_removed long, kept_sha256 string" + (", kept string" if with_text else ""))


def _whole(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            words = Words(batch.column("text"), SPACED, lower=False, encode=False)
            data, cuts = words.words.buffers()[2], np.frombuffer(words.words.buffers()[1], np.int32)
            view = np.frombuffer(data, np.uint8) if len(words.words) else np.zeros(0, np.uint8)
            # a blank goes before each word, and the first of a row is left out
            joined = np.insert(view, cuts[:-1], 0x20)
            at = (cuts[words.rows] + words.rows).tolist()
            full = memoryview(joined)
            sha = [hashlib.sha256(full[a + 1 : b] if b > a else b"").hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(np.diff(words.rows)), pa.array(sha, pa.string())], names=["uid", "n_words", "whole_sha256"])

    return store(docs.mapInArrow(run, "uid long, n_words long, whole_sha256 string"), "whole")


def dedup(docs: DataFrame, width: int = 20, batches: int = BATCHES, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (and kept, the text that is left, null where nothing was removed)."""
    rows, ids = numbered(docs)
    whole = _whole(rows)
    total = whole.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    slices = max(splits(rows) if total > SLICE else 1, math.ceil(total / SLICE))
    edges = [e for e in whole.agg(F.percentile_approx("uid", [k / batches for k in range(1, batches)], 1000)).first()[0] or []] if batches > 1 else []
    index, marks = FingerprintIndex(slices, width), None
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        batch = rows.where((F.lit(True) if low is None else F.col("uid") > low) & (F.lit(True) if high is None else F.col("uid") <= high))
        found = index.add(batch)
        marks = found if marks is None else marks.unionAll(found)
    marked = _with_places(rows, _gather(marks))
    repeats = _gather(_repeats(marked, width, slices))
    left = _kept(_with_places(rows, repeats), width, with_text)
    out = whole.join(left, "uid", "left")
    if ids is not None:
        out = out.join(ids, "uid")
    doc_id = F.col("uid") if ids is None else F.col("doc_id")
    return out.select(doc_id.alias("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"), *(["kept"] if with_text else []))
