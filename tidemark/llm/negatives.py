"""Hard negatives by threshold joins with suffix-norm bounds.

Anchors, the stated query set, meet all rows in blocks. A search asks, for each anchor, for its best rows within a window of scores above a threshold. In
a task the rows of a batch are an inverted index over components, in an order fixed for the block: a row leaves out its first
components as far as their norm times the anchor's stays below the threshold, and rows are ordered by how many they leave out, so the
posting list of a component is a slice. Partial scores are summed from the last components on; pairs whose sum and remaining norms can't reach the
threshold are dropped, rows that no anchor needs any more are left out of what follows; the components left out are added for those that remain. Thresholds
start high and are lowered for the anchors whose windows aren't filled, until they are or nothing lies below.

Scores are exact integers (beyond a long: its nearest value). Rows with a null id, label or vector, or with a null or non-finite component take no part; missing
components of a shorter vector count as 0. Rows that share an id are rows of their own, repeated anchors give rows each. Equal scores go by the
smaller id. Anchors without another row of their label, and windows without rows, give none; so does an empty table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, store

SCALE = 256
#: Bytes of the vectors of a block of anchors, which bounds what is broadcast.
BLOCK_BYTES = 32 << 20
#: Anchors of a step in a task, and components that are summed between two prunings.
STEP, DIMS = 512, 16
#: Thresholds of positives, as parts of the anchor's squared norm, and depths into a window of negatives; each list ends with all there is.
FALLING = (0.6, 0.3, 0.15, 0.0)
DEEPER = (0.125, 0.5, 1.0)
#: Rows a task gathers before it keeps the best of each window only.
GATHER = 1 << 19
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
FOUND = "anchor int, slot int, score long, vec_id long"


def vectors(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of components as rows of scaled, floored doubles, short ones filled with zeros."""
    sizes = column.value_lengths().to_numpy()
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims))
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def prefix_norms(x: np.ndarray) -> np.ndarray:
    """Norms of the first 0, 1, ... components of each row."""
    return np.sqrt(np.concatenate((np.zeros((len(x), 1)), np.cumsum(x * x, axis=1)), axis=1))


def threshold_scores(x: np.ndarray, xn: np.ndarray, least: np.ndarray, y: np.ndarray, yn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of rows x against rows y that reach least (one of each x). Returns the y that may, their scores (x by y) and which pairs are sure to be
    whole; a pair that isn't can't reach its threshold. xn, yn: prefix norms."""
    dims = x.shape[1]
    slack = 1 + 1e-9 * np.abs(least)
    with np.errstate(divide="ignore", invalid="ignore"):
        reach = np.where(least > slack, (least - slack) / np.maximum(xn[:, -1], 1e-300), 0).min()
    out = (yn < reach).sum(axis=1)  # first components left out, plus 1 where any can be
    out = np.maximum(out - 1, 0)
    order = np.argsort(out, kind="stable")
    order = order[: np.searchsorted(out[order], dims)]  # the others can't reach any threshold
    y, yn, out = y[order], yn[order], out[order]
    indexed = np.where(np.arange(dims) >= out[:, None], y, 0)
    sums = np.zeros((len(x), len(y)))
    alive = np.ones((len(x), len(y)), bool)
    for upper in range(dims, 0, -DIMS):
        lower = max(0, upper - DIMS)
        listed = int(np.searchsorted(out, upper))
        sums[:, :listed] += x[:, lower:upper] @ indexed[:listed, lower:upper].T
        left = np.maximum(out, lower)
        alive &= sums + xn[:, left] * yn[np.arange(len(y)), left] >= (least - slack)[:, None]
        if not (needed := alive.any(axis=0)).all():
            order, y, yn, out, indexed, sums, alive = order[needed], y[needed], yn[needed], out[needed], indexed[needed], sums[:, needed], alive[:, needed]
    if out.any():
        sums += x @ (y - indexed).T
    return order, sums, alive


def exact_scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Scores too large for doubles, as long."""
    product = np.vectorize(int, otypes=[object])(x) @ np.vectorize(int, otypes=[object])(y).T
    return np.vectorize(lambda v: min(max(v, LOWEST), HIGHEST), otypes=[np.int64])(product) if product.size else product.astype(np.int64)


def best(found: np.ndarray, most: int) -> np.ndarray:
    """The first rows of each slot. found: columns slot, score, id."""
    found = found[:, np.lexsort((found[2], -np.maximum(found[1], LOWEST + 1), found[0]))]
    starts = np.flatnonzero(np.concatenate(([True], found[0, 1:] != found[0, :-1]))) if found.shape[1] else np.zeros(0, int)
    rank = np.arange(found.shape[1]) - np.repeat(starts, np.diff(np.append(starts, found.shape[1])))
    return found[:, rank < most]


def _search(batches: Iterator[pa.RecordBatch], block: dict, dims: int, most: int, same: bool) -> Iterator[pa.RecordBatch]:
    """block: x, label, rid of its anchors; slots as anchor, number, low, high. Yields the best rows of each slot in this task."""
    turned = np.argsort((block["x"] ** 2).sum(axis=0), kind="stable")
    slots = block["slots"]
    low = slots["low"].copy()
    anchors, first = np.unique(slots["anchor"], return_index=True)  # slots are ordered by anchor
    x = block["x"][anchors][:, turned]
    xn, largest = prefix_norms(x), np.abs(x).max(initial=0)
    gathered, size = [np.zeros((3, 0), np.int64)], 0

    def settle() -> None:
        nonlocal gathered, size
        kept = best(np.concatenate(gathered, axis=1), most)
        slot, start, n = np.unique(kept[0], return_index=True, return_counts=True)
        full = n == most
        low[slot[full]] = np.maximum(low[slot[full]], kept[1][start[full] + most - 1])  # rows below can't be among the best
        gathered, size = [kept], 0

    for batch in batches:
        ids, label, rid = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("vec_id", "label", "rid"))
        y = vectors(batch.column(batch.schema.get_field_index("embedding")), dims)[:, turned]
        yn = prefix_norms(y)
        double = largest * np.abs(y).max(initial=0) * dims < 1 << 53
        for at in range(0, len(anchors), STEP):
            some = slice(at, at + STEP)
            ends = np.append(first, len(low))
            least = np.minimum.reduceat(low[ends[at] : ends[min(at + STEP, len(anchors))]], first[some] - first[at])
            if double:
                order, scores, alive = threshold_scores(x[some], xn[some], least.astype(np.float64), y, yn)
                scores = np.where(alive, scores, 0).astype(np.int64)
            else:
                order, scores = np.arange(len(y)), exact_scores(x[some], y)
                alive = np.ones(scores.shape, bool)
            own = anchors[some]
            alive &= (block["label"][own][:, None] == label[order]) == same
            alive &= block["rid"][own][:, None] != rid[order]
            alive &= scores >= least[:, None]
            number = slots["number"][ends[at] : ends[min(at + STEP, len(anchors))]]
            for k in np.unique(number):
                slot = np.flatnonzero(number == k) + ends[at]
                row = np.searchsorted(own, slots["anchor"][slot])
                within = alive[row] & (scores[row] >= low[slot][:, None]) & (scores[row] <= slots["high"][slot][:, None])
                a, b = np.nonzero(within)
                if len(a):
                    gathered.append(best(np.stack((slot[a], scores[row[a], b], ids[order[b]])), most))
                    size += gathered[-1].shape[1]
            if size > GATHER:
                settle()
    settle()
    kept = gathered[0]
    if kept.shape[1]:
        columns = (slots["anchor"][kept[0]].astype(np.int32), slots["number"][kept[0]].astype(np.int32), kept[1], kept[2])
        yield pa.record_batch([pa.array(c) for c in columns], names=["anchor", "slot", "score", "vec_id"])


def _find(rows: DataFrame, block: dict, slots: np.ndarray, dims: int, most: int, same: bool):
    """The best rows of each slot over all rows, as a pandas table of most rows a slot: anchor, slot, score, vec_id, ordered."""
    shared = rows.sparkSession.sparkContext.broadcast(block | {"slots": slots})
    found = rows.mapInArrow(lambda batches: _search(batches, shared.value, dims, most, same), FOUND)
    place = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "vec_id"))
    out = found.withColumn("place", place).where(F.col("place") <= most).toArrow().to_pandas().sort_values(["anchor", "slot", "place"])
    shared.unpersist()
    return out


def _slots(anchor, number, low, high) -> np.ndarray:
    out = np.zeros(len(anchor), [("anchor", np.int64), ("number", np.int64), ("low", np.int64), ("high", np.int64)])
    out["anchor"], out["number"], out["low"], out["high"] = anchor, number, low, high
    return out[np.lexsort((out["number"], out["anchor"]))]


def _filled(rows: DataFrame, block: dict, dims: int, most: int, same: bool, slots: np.ndarray, lows: list[np.ndarray]):
    """Searches with lower and lower thresholds (lows: of each slot, for each round) until every slot holds most rows or the last round is over."""
    import pandas as pd

    held, left = [], np.arange(len(slots))
    for turn, low in enumerate(lows):
        if not len(left):
            break
        asked = slots[left].copy()
        asked["low"] = low[left]
        found = _find(rows, block, asked, dims, most, same)
        n = found.groupby(["anchor", "slot"]).size()
        full = np.array([n.get((a, k), 0) == most for a, k in zip(asked["anchor"], asked["number"], strict=True)], bool) | (turn == len(lows) - 1)
        done = pd.MultiIndex.from_arrays([asked["anchor"][full], asked["number"][full]])
        held.append(found[pd.MultiIndex.from_frame(found[["anchor", "slot"]]).isin(done)])
        left = left[~full]
    return pd.concat(held) if held else None


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """rows: vec_id, embedding, label. For each anchor and each of its best rows of the same label (positives), the best rows of other labels whose score
    is from low to high percent of the positive's: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A block of anchors and its windows, of bounded size, is with the driver at a time; rows stay where they are and are scanned for each block."""
    spark = rows.sparkSession
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * SCALE) == float("inf"))
    whole = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding", is_anchor.alias("asks")).where("vec_id is not null and label is not null and embedding is not null")
    held = store(whole.where(~F.exists("embedding", bad)).withColumn("rid", F.monotonically_increasing_id()), "vectors", compression="zstd")
    n, dims = held.where("asks").agg(F.count("*"), F.max(F.size("embedding"))).first()
    dims = max(dims or 0, held.agg(F.max(F.size("embedding"))).first()[0] or 0, 1)
    blocks = -(-n * dims * 8 // BLOCK_BYTES)
    anchors = held.where("asks").withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(max(1, blocks))))
    scanned = held.select("vec_id", "label", "embedding", "rid")
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    results = []
    for b in range(blocks):
        got = anchors.where(F.col("block") == b).orderBy("rid").toArrow().combine_chunks()
        if not got.num_rows:
            continue
        ids = got["vec_id"].to_numpy()
        block = {"x": vectors(got["embedding"].combine_chunks(), dims), "label": got["label"].to_numpy(), "rid": got["rid"].to_numpy()}
        square = (block["x"] ** 2).sum(axis=1)
        falls = [np.clip(np.floor(square * part), LOWEST, 2**62).astype(np.int64) for part in FALLING]
        zeros = np.zeros(len(ids), np.int64)
        near = _filled(scanned, block, dims, positives, True, _slots(np.arange(len(ids)), zeros, zeros, zeros + HIGHEST), [*falls, zeros + LOWEST])
        if near is None or not len(near):
            continue
        anchor, number, score, partner = (near[c].to_numpy() for c in ("anchor", "place", "score", "vec_id"))
        top = np.array([high * int(s) // 100 for s in score], np.int64)
        floor = np.array([-(-low * int(s) // 100) for s in score], np.int64)
        by = np.lexsort((number, anchor))
        anchor, number, score, partner, top, floor = (v[by] for v in (anchor, number, score, partner, top, floor))
        open_ = top >= floor
        slots = _slots(anchor[open_], number[open_], floor[open_], top[open_])
        lows = [np.where(part == 1, slots["low"], slots["high"] - ((slots["high"] - slots["low"]) * part).astype(np.int64)) for part in DEEPER]
        far = _filled(scanned, block, dims, negatives, False, slots, lows)
        if far is None or not len(far):
            continue
        at = np.searchsorted(anchor * (positives + 1) + number, far["anchor"].to_numpy() * (positives + 1) + far["slot"].to_numpy())
        table = pa.table({"anchor_id": ids[anchor[at]], "positive_id": partner[at], "rank": far["place"].to_numpy().astype(np.int32), "negative_id": far["vec_id"].to_numpy(), "positive_score": score[at], "negative_score": far["score"].to_numpy()})
        results.append(store(spark.createDataFrame(table, kind), "negatives", compression="zstd"))
    discard(held)
    out = spark.createDataFrame([], kind)
    for r in results:
        out = out.unionByName(r)
    return out


def mine_relabelled(rows: DataFrame, every: int = 50) -> DataFrame:
    """mine() with every 50th id as anchor; where 7 divides an id, the label is the next of ten instead, a known share of wrong labels."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % every == 0)
