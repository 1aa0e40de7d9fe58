"""Document scores by masked pseudo-likelihood.

A small network in numpy predicts every word from the two words on either side: their embeddings side by side, one hidden layer,
and a three-step softmax (a class of words, a group in the class, the word in its group). A document's score is the sum of the
log probabilities of its words, each given both sides.

The vocabulary is counted over all documents. A word has an id of its own if its count is LEAST at least and no less than the
square root of the corpus' words / PER_ROOT, so ids, classes and weights grow with that root. Rarer words share ids by a
hash of their ending, and the log share of the word among its id's words, from their counts, is added to the score. Training is
model averaging: in each round every task runs gradient descent with adaptive steps from the shared weights over its own
documents of that round, which a hash of the text deals out, so that every word of every document is learnt once. The weights
are averaged by number of examples, in two levels so that no task gathers from all.
Weights depend on how rows are dealt to tasks.

Nulls: a null or empty text has no words, the sum 0 and no mean; a null doc_id is kept. Repeated rows are scored one by one.
An empty table gives no rows. Other columns are ignored."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED, Words, hashes, mix, raw, splits, steps, store, text_or_empty

#: The smallest model has LEAST_SIDE classes of as many groups of as many words; at least one id in SPARE is for endings.
LEAST_SIDE, SPARE = 11, 4
SIZE = LEAST_SIDE**3
#: A word with an id of its own is counted LEAST times, and root(words of the corpus) / PER_ROOT times.
LEAST, PER_ROOT = 5, 16
WIDTH, HIDDEN, SIDES = 16, 32, (-2, -1, 1, 2)
#: Rows of a step of descent, a part in STEPS of a slice but within bounds; its rate, and what the sums of squares start from.
ROUNDS, BATCH, LEAST_BATCH, STEPS, RATE, START = 2, 16384, 256, 32, 0.2, 1.0
#: Rows of one class, or group, that a product of matrices takes at a time.
BLOCK = 16
#: Pieces that the weights are averaged in.
CHUNKS = 8

Weights = dict[str, np.ndarray]


def side(own: int) -> int:
    """Classes, groups in a class, and words in a group, of a model where own words have an id of their own."""
    wanted = own * SPARE // (SPARE - 1)
    n = max(LEAST_SIDE, round(wanted ** (1 / 3)))
    return n + (n**3 < wanted)


def shapes(n: int) -> dict[str, tuple[int, ...]]:
    """Shapes of the weights of a model of n classes; the last row of words is the edge of a text."""
    out: dict[str, tuple[int, ...]] = {"words": (n**3 + 1, WIDTH), "in": (len(SIDES) * WIDTH, HIDDEN), "in_bias": (HIDDEN,)}
    for name, of in LEVELS:
        out |= {name: (n**of, HIDDEN, n), f"{name}_bias": (n**of, n)}
    return out


#: A word's class, its group in the class, itself in the group: each a softmax of its own for each of n**k parents.
LEVELS = (("class", 0), ("group", 1), ("member", 2))


def fresh(seed: int = 7, n: int = LEAST_SIDE) -> Weights:
    rng = np.random.default_rng(seed)
    return {k: (rng.normal(0, 0.1, s) if not k.endswith("bias") else np.zeros(s)).astype(np.float32) for k, s in shapes(n).items()}


def flat(w: Weights) -> np.ndarray:
    return np.concatenate([x.ravel() for x in w.values()])


def shaped(x: np.ndarray, n: int) -> Weights:
    out, at = {}, 0
    for k, s in shapes(n).items():
        many = int(np.prod(s))
        out[k], at = x[at : at + many].reshape(s).astype(np.float32), at + many
    return out


class Descent:
    """Adaptive steps: each weight's gradient is divided by the root of the sum of its squares so far. It belongs to one task."""

    def __init__(self, w: Weights, rate: float):
        self.rate, self.seen = rate, {k: np.full(x.shape, START, np.float32) for k, x in w.items()}

    def step(self, w: Weights, name: str, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Take grad off w[name], or off those of its rows."""
        if rows is None:
            self.seen[name] += grad * grad
            w[name] -= self.rate * grad / np.sqrt(self.seen[name])
        else:
            seen = self.seen[name][rows]
            seen += grad * grad
            self.seen[name][rows] = seen
            np.sqrt(seen, out=seen)
            np.divide(grad, seen, out=seen)
            seen *= self.rate
            w[name][rows] -= seen


def _level(h: np.ndarray, parent: np.ndarray, target: np.ndarray, w: Weights, name: str, descent: Descent | None) -> tuple[np.ndarray, np.ndarray | None]:
    """log p(target | parent, h) of rows that ascend by parent; with a descent the parents' weights take a step, and what goes
    back to h comes with it. Rows of a parent are taken in blocks of one size, so that all blocks are one product."""
    weight, bias = w[name], w[f"{name}_bias"]
    n, width = len(h), weight.shape[2]
    size = BLOCK if len(weight) > 1 else n
    heads = np.flatnonzero(np.concatenate(([True], parent[1:] != parent[:-1])))
    rows = np.diff(np.append(heads, n))
    blocks = -(-rows // size)
    first = np.cumsum(blocks) - blocks
    slot = np.repeat(first * size - heads, rows) + np.arange(n)
    of = np.repeat(parent[heads], blocks)
    full = n == len(of) * size
    held = h if full else np.zeros((len(of) * size, HIDDEN), np.float32)
    if not full:
        held[slot] = h
    held = held.reshape(len(of), size, HIDDEN)
    mine = weight[of]
    x = held @ mine
    x += bias[of][:, None, :]
    x = x.reshape(-1, width)
    own, ones = x[slot, target], np.ones(width, np.float32)
    e = np.exp(x)
    total = e @ ones
    if not np.isfinite(total).all():
        top = x.max(axis=1, keepdims=True)
        own -= top[slot, 0]
        e = np.exp(x - top)
        total = e @ ones
    out = own - np.log(total[slot])
    if descent is None:
        return out, None
    x = np.divide(e, total[:, None], out=e)
    x[slot, target] -= 1
    if not full:
        empty = np.ones(len(x), bool)
        empty[slot] = False
        x[empty] = 0
    x = x.reshape(len(of), size, width)
    back = (x @ mine.transpose(0, 2, 1)).reshape(-1, HIDDEN)
    step, bias_step = held.transpose(0, 2, 1) @ x, x.sum(axis=1)
    if len(of) > len(heads):
        step, bias_step = np.add.reduceat(step, first, axis=0), np.add.reduceat(bias_step, first, axis=0)
    descent.step(w, name, step, parent[heads])
    descent.step(w, f"{name}_bias", bias_step, parent[heads])
    return out, back if full else back[slot]


def lookup(w: Weights) -> np.ndarray:
    """What each word adds to the hidden layer on each side; for weights that stay."""
    blocks = w["in"].reshape(len(SIDES), WIDTH, HIDDEN)
    return np.stack([w["words"] @ b for b in blocks])


def log_probability(w: Weights, around: np.ndarray, word: np.ndarray, descent: Descent | None = None, added: np.ndarray | None = None) -> np.ndarray:
    """log p(word | around) of each row, in natural units; with a descent the weights take a step. added: lookup(w)."""
    n, side = len(word), w["class_bias"].shape[1]
    # rows stand by word, so those of a class and of a group stand together
    order = np.argsort(word)
    word, around = word[order].astype(np.int64), around[order]
    if added is not None:
        h = np.take(added[0], around[:, 0], axis=0)
        for k in range(1, len(SIDES)):
            h += np.take(added[k], around[:, k], axis=0)
        h += w["in_bias"]
        np.tanh(h, out=h)
    else:
        x = np.take(w["words"], around, axis=0).reshape(n, -1)
        h = np.tanh(x @ w["in"] + w["in_bias"])
    log_p, grad = np.zeros(n, np.float32), np.zeros_like(h) if descent else None
    parent = word // side**3
    for k, (name, _) in enumerate(LEVELS):
        node = word // side ** (2 - k)
        got, back = _level(h, parent, node - parent * side, w, name, descent)
        log_p += got
        if descent:
            grad += back
        parent = node
    out = np.empty(n, np.float32)
    out[order] = log_p
    if descent:
        grad *= 1 - h * h
        grad_x = (grad @ w["in"].T).reshape(-1, WIDTH)
        descent.step(w, "in", x.T @ grad)
        descent.step(w, "in_bias", grad.sum(axis=0))
        # rows of the embedding table, summed by word
        ids = around.ravel()
        at = np.argsort(ids)
        ids = ids[at]
        heads = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        descent.step(w, "words", np.add.reduceat(grad_x[at], heads, axis=0), ids[heads])
    return out


def counted(rows: DataFrame) -> DataFrame:
    """A stored table: each word of all documents and its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            words = Words(batch.column("text"), SPACED, lower=True)
            yield pa.RecordBatch.from_arrays([words.distinct, pa.array(np.bincount(words.codes, minlength=len(words.distinct)).astype(np.int64))], names=["word", "n"])

    return store(rows.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


def threshold(counts: DataFrame) -> int:
    """The count from which on a word has an id of its own."""
    return max(LEAST, math.isqrt(counts.agg(F.sum("n")).first()[0] or 0) // PER_ROOT)


def vocabulary(rows: DataFrame, counts: DataFrame | None = None) -> dict[bytes, int]:
    """The words that have an id of their own, by count and then alphabet, with their ids."""
    counts = counted(rows) if counts is None else counts
    top = counts.where(F.col("n") >= threshold(counts)).orderBy(F.desc("n"), "word").toPandas()
    return {bytes(w): k for k, w in enumerate(top["word"])}


def shares(counts: DataFrame, known) -> DataFrame:
    """hash and log_share of every word that shares its id: the log of its part in the count of that id. known: broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(known.value)
        for batch in batches:
            words = batch.column("word")
            yield pa.RecordBatch.from_arrays([pa.array(hashes(words).view(np.int64)), pa.array(reader.by_ending(words)), batch.column("n")], names=["hash", "id", "n"])

    rare = store(counts.where(F.col("n") < threshold(counts)).mapInArrow(run, "hash long, id long, n long"), "rare")
    totals = rare.groupBy("id").agg(F.sum("n").alias("of"))
    return rare.join(F.broadcast(totals), "id").select("hash", F.log(F.col("n") / F.col("of")).alias("log_share"))


class Reader:
    """Texts as ids with their surroundings."""

    def __init__(self, known: dict[bytes, int]):
        self.known, self.own, self.size = known, len(known), side(len(known)) ** 3

    def by_ending(self, words: pa.Array) -> np.ndarray:
        """The id of each word if it has none of its own: a hash of its last three bytes."""
        data, cuts = raw(words)
        ends = cuts[1:]
        code = np.zeros(len(words), np.uint64)
        for k in (3, 2, 1):
            code = code * np.uint64(257) + np.where(ends - k >= cuts[:-1], data[np.maximum(ends - k, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
        return self.own + (mix(code) % np.uint64(self.size - self.own)).astype(np.int64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids around each word, its own id, and the n + 1 offsets of the rows."""
        return self.read(Words(texts, SPACED, lower=True))[:3]

    def read(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same of words, and which of their distinct ones share an id."""
        distinct = words.distinct.to_pylist()
        ids = np.fromiter((self.known.get(w, -1) for w in distinct), np.int64, len(distinct))
        shared = ids < 0
        if len(distinct):
            ids = np.where(shared, self.by_ending(words.distinct), ids)
        own = ids.astype(np.int32)[words.codes] if len(words.codes) else np.zeros(0, np.int32)
        # each row's words stand between edges, two on either side
        gap, n = len(SIDES) // 2, len(words.rows) - 1
        line = np.full(len(own) + gap * (n + 1), self.size, np.int32)
        place = np.arange(len(own), dtype=np.int32) + gap * (np.repeat(np.arange(n, dtype=np.int32), np.diff(words.rows)) + 1)
        line[place] = own
        around = np.empty((len(own), len(SIDES)), np.int32)
        for k, s in enumerate(SIDES):
            around[:, k] = line[place + s]
        return around, own, words.rows, shared


def train(rows: DataFrame, known: dict[bytes, int], rounds: int = ROUNDS) -> Weights:
    spark = rows.sparkSession
    shared, weights = spark.sparkContext.broadcast(known), fresh(n=side(len(known)))
    groups = max(1, int(splits(rows) ** 0.5))

    def trainer(start, turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            part, reader, n = TaskContext.get().partitionId(), Reader(shared.value), 0
            w = {k: v.copy() for k, v in start.value.items()}
            descent = Descent(w, RATE / (1 + turn) ** 0.5)
            for batch in steps(batches, "text"):
                around, own, _ = reader(batch.column("text"))
                # words of one document lie apart in the steps of descent
                pick = np.random.default_rng(len(own)).permutation(len(own))
                size = min(BATCH, max(LEAST_BATCH, len(pick) // STEPS))
                for at in range(0, len(pick), size):
                    some = pick[at : at + size]
                    log_probability(w, around[some], own[some], descent)
                n += len(own)
            if n:
                for c, x in enumerate(np.array_split(flat(w), CHUNKS)):
                    yield pa.RecordBatch.from_pydict({"chunk": pa.array([c], pa.int32()), "bucket": pa.array([part % groups], pa.int32()), "part": pa.array([part], pa.int32()), "n": pa.array([float(n)]), "x": pa.array([(x.astype(np.float64) * n).tobytes()], pa.binary())})

        return run

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        total = np.sum([np.frombuffer(x, np.float64) for x in table.column("x").to_pylist()], axis=0)
        return pa.table({"chunk": table.column("chunk")[:1], "bucket": table.column("bucket")[:1], "part": table.column("part")[:1], "n": pa.array([float(sum(table.column("n").to_pylist()))]), "x": pa.array([total.tobytes()], pa.binary())})

    schema = "chunk int, bucket int, part int, n double, x binary"
    for turn in range(rounds):
        # each document, with every word of it, in one round
        start = spark.sparkContext.broadcast(weights)
        mine = rows.select("text").where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == turn)
        sums = mine.mapInArrow(trainer(start, turn), schema).groupBy("chunk", "bucket").applyInArrow(add, schema).groupBy("chunk").applyInArrow(add, schema)
        got = {r["chunk"]: np.frombuffer(r["x"], np.float64) / r["n"] for r in sums.collect()}
        if got:
            weights = shaped(np.concatenate([got[c] for c in range(CHUNKS)]), side(len(known)))
    return weights


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Per document: doc_id, n_words, log_likelihood (the sum) and mean_log_probability."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    counts = counted(rows)
    known = vocabulary(rows, counts)
    share = rows.sparkSession.sparkContext.broadcast
    model = share((known, train(rows, known, rounds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, weights = model.value
        reader, added = Reader(ids), lookup(weights)
        for batch in steps(batches, "text"):
            words = Words(batch.column("text"), SPACED, lower=True)
            around, own, offsets, shared = reader.read(words)
            each = np.concatenate([np.zeros(0, np.float32), *(log_probability(weights, around[a : a + 65536], own[a : a + 65536], added=added) for a in range(0, len(own), 65536))]).astype(float)
            total = np.concatenate(([0.0], np.cumsum(each)))
            # the words that share an id, as hashes
            at = np.flatnonzero(shared[words.codes])
            code = np.zeros(len(shared), np.int64)
            code[shared] = hashes(words.distinct.filter(pa.array(shared))).view(np.int64)
            rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, offsets).astype(np.int32)), pa.array(code[words.codes[at]]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(total[offsets[1:]] - total[offsets[:-1]]), rare], names=["doc_id", "n_words", "log_likelihood", "rare"])

    scored = rows.mapInArrow(run, "doc_id long, n_words long, log_likelihood double, rare array<long>")
    scored = store(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    # no word that shares an id is frequent, so no key of this join is
    inside = scored.select("row", F.explode("rare").alias("hash")).join(shares(counts, share(known)), "hash")
    inside = inside.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_words"), F.col("log_share").alias("log_likelihood"))
    parts = scored.select("row", "doc_id", "n_words", "log_likelihood").unionByName(inside).groupBy("row")
    scored = parts.agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum("log_likelihood").alias("log_likelihood")).drop("row")
    return scored.withColumn("mean_log_probability", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))
