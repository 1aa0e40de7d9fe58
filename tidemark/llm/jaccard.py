"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds its distinct shingles of five words. Documents with equal sets are one class, so copies are never
paired. Two sets of similarity t or more share at least t of either one's shingles:

1. Screen. Shingle hashes are dealt to slices by value; a slice tells each document how many of its shingles another
   document has too. A document with fewer than t of its own has no partner and leaves.
2. Prefixes. The remaining classes' shingles are ordered from the rarest. Two partners that lengthen the plain prefix
   (n - ceil(t n) + 1 shingles) by l - 1 share at least l shingles of it. Each class takes the l whose estimated cost
   (postings read, and candidates verified, of which there are at most postings / l) is least; a pair is verified when it shares
   as many prefix shingles as the smaller l of the two asks.
3. Links. For the components alone most pairs are needless: a few rounds verify each class against the one pivot of its
   posting lists that it shares most with, which joins groups of near copies in linear work. Then the candidates that are
   still in different components are compared, so no link between components is missed: those of small clusters of posting
   lists as pairs, those of large clusters in blocks, the classes outside the largest component against all. Both take their
   candidates from the prefixes; a block returns a forest of its links, so no table of pairs or links grows with the square
   of a group.

Similarity is exact but for equal 64-bit hashes of different shingles. Nulls: a null text has no shingles and links with
nothing; a null doc_id has a component like any other, whose id is null if nothing else is in it. Repeated rows, and rows
that share a doc_id, are one row each in the result. An empty table gives no rows. Other columns are ignored."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED, Words, discard, distinct, keyed, mix, pack_ints, runs, splits, steps, store, sweep, text_or_empty, unpack_ints, without
from .graph import components

#: Stands for a null doc_id inside.
NONE = -(1 << 63)
#: Shingles in a slice and in a packed batch; documents whose ids may be broadcast (8 bytes each).
SLICE, PACK, MOST_BROADCAST = 3_000_000, 2_000_000, 2_000_000
#: Cost of verifying a candidate, in postings read; longest extension tried; pivot rounds at most.
VERIFY, MOST_MATCHES, ROUNDS = 20.0, 8, 3
#: Classes of a cluster that are paired at most, classes and shingles of a side of a block, shingles that a block counts at a time.
PAIRED, BLOCK, HELD, COUNTED = 256, 1024, 1_000_000, 4096


class Sets:
    """The shingle sets of a batch of texts: row and hash, sorted by row and then hash, distinct."""

    def __init__(self, texts: pa.Array, k: int):
        words = Words(texts, SPACED, lower=True, encode=False)
        of, n = words.hashes(), len(texts)
        h = runs(of, k)
        # windows within a row; a row of fewer words is one
        count = np.diff(words.rows)
        many = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
        cuts = np.concatenate(([0], np.cumsum(many)))
        row = np.repeat(np.arange(n), many)
        place = words.rows[:-1][row] + np.arange(cuts[-1]) - cuts[row]
        short = count[row] < k
        out = np.zeros(len(row), np.uint64)
        out[~short] = h[place[~short]]
        for i in np.flatnonzero(short).tolist():
            x = np.full(1, 0x51ED270B, np.uint64)
            for w in of[words.rows[row[i]] : words.rows[row[i] + 1]]:
                x = mix(x * np.uint64(31) + w)
            out[i] = x[0]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a > 1:
                out[a:b].sort()
        fresh = np.ones(len(out), bool)
        fresh[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
        self.hash, self.row = out[fresh], row[fresh]
        self.cuts = np.searchsorted(self.row, np.arange(len(texts) + 1))


def sets(docs: DataFrame, k: int) -> DataFrame:
    """A stored table: doc_id, n_shingles and a 128-bit digest of the set of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in steps(batches, "text"):
            got = Sets(batch.column("text"), k)
            view, cuts = memoryview(got.hash).cast("B") if len(got.hash) else memoryview(b""), got.cuts.tolist()
            digest = [xxh3_128_digest(view[8 * a : 8 * b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(got.cuts)), pa.array(digest, pa.binary())], names=["doc_id", "n_shingles", "digest"])

    return store(docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary"), "sets")


def shared_counts(docs: DataFrame, k: int, slices: int) -> DataFrame:
    """doc_id and shared: how many shingles of the document occur in another row too."""
    schema = "slice int, docs binary, hashes binary, many binary, counts binary"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            doc, h = (np.concatenate(x) for x in zip(*held, strict=True))
            h = h >> np.uint64(16)
            order = np.argsort(h, kind="stable")
            h, doc = h[order], doc[order]
            same = h[1:] == h[:-1]
            again = np.concatenate((same, [False])) | np.concatenate(([False], same))
            many = distinct(h[again])
            local, counts = np.unique(doc[again], return_counts=True)
            single, owner = h[~again], doc[~again]
            edges = np.array([-(-(s << 48) // slices) for s in range(slices + 1)], np.uint64)
            a, b = np.searchsorted(single, edges), np.searchsorted(many, edges)
            rows = []
            for s in range(slices):
                one, two = single[a[s] : a[s + 1]], many[b[s] : b[s + 1]]
                if len(one) or len(two):
                    rows.append((s, pack_ints(owner[a[s] : a[s + 1]]), pack_ints(np.diff(one, prepend=np.uint64(0))), pack_ints(np.diff(two, prepend=np.uint64(0))), None))
            if len(local):
                # what this batch knows already needs no slice of its own
                rows.append((part % slices, pack_ints(local), None, None, pack_ints(counts.astype(np.int64))))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["slice", "docs", "hashes", "many", "counts"])

        for batch in steps(batches, "text"):
            got = Sets(batch.column("text"), k)
            if len(got.hash):
                held.append((batch.column("doc_id").to_numpy()[got.row], got.hash))
                size += len(got.hash)
            if size >= PACK:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def meet(table: pa.Table) -> pa.Table:
        docs_found, counts_found, single, owner, many = [], [], [], [], []
        for d, h, m, c in zip(*(table.column(x).to_pylist() for x in ("docs", "hashes", "many", "counts")), strict=True):
            if c is not None:
                docs_found.append(unpack_ints(d))
                counts_found.append(unpack_ints(c))
            else:
                owner.append(unpack_ints(d))
                single.append(np.cumsum(unpack_ints(h, np.uint64), dtype=np.uint64))
                many.append(np.cumsum(unpack_ints(m, np.uint64), dtype=np.uint64))
        if single:
            one, two = np.concatenate(single), distinct(np.concatenate(many))
            order = np.argsort(one, kind="stable")
            ranked = one[order]
            same = ranked[1:] == ranked[:-1]
            again = np.zeros(len(one), bool)
            again[order] = np.concatenate((same, [False])) | np.concatenate(([False], same))
            if len(two):
                again |= two[np.minimum(np.searchsorted(two, one), len(two) - 1)] == one
            docs_found.append(np.concatenate(owner)[again])
            counts_found.append(np.ones(len(docs_found[-1]), np.int64))
        doc, at = np.unique(np.concatenate(docs_found), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(counts_found), minlength=len(doc)).astype(np.int64)
        bucket = (mix(doc.view(np.uint64)) % np.uint64(slices)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(slices + 1))
        full = [s for s in range(slices) if cuts[s] < cuts[s + 1]]
        part = lambda x: pa.array([pack_ints(x[order][cuts[s] : cuts[s + 1]]) for s in full], pa.binary())
        return pa.table({"bucket": pa.array(full, pa.int32()), "docs": part(doc), "counts": part(total)})

    def add(table: pa.Table) -> pa.Table:
        doc, at = np.unique(np.concatenate([unpack_ints(x) for x in table.column("docs").to_pylist()]), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([unpack_ints(x) for x in table.column("counts").to_pylist()]), minlength=len(doc))
        return pa.table({"doc_id": pa.array(doc), "shared": pa.array(total.astype(np.int64))})

    met = docs.mapInArrow(deal, schema).groupBy("slice").applyInArrow(meet, "bucket int, docs binary, counts binary")
    return met.groupBy("bucket").applyInArrow(add, "doc_id long, shared long")


def classes(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """A stored table of the sets of wanted (doc_id, digest): rid, digest, n, tokens."""
    spark = docs.sparkSession
    ids = wanted.select("doc_id").distinct()
    if wanted.count() <= MOST_BROADCAST:
        keep = spark.sparkContext.broadcast(np.sort(ids.toPandas()["doc_id"].to_numpy(dtype=np.int64)))

        def chosen(batch: pa.RecordBatch) -> pa.RecordBatch:
            doc, among = batch.column("doc_id").to_numpy(), keep.value
            return batch.take(pa.array(np.flatnonzero(among[np.minimum(np.searchsorted(among, doc), len(among) - 1)] == doc))) if len(among) else batch.slice(0, 0)

    else:
        docs = docs.join(ids, "doc_id", "left_semi")

        def chosen(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in steps(map(chosen, batches), "text"):
            got = Sets(batch.column("text"), k)
            view, cuts = memoryview(got.hash).cast("B") if len(got.hash) else memoryview(b""), got.cuts.tolist()
            digest = [xxh3_128_digest(view[8 * a : 8 * b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            tokens = pa.ListArray.from_arrays(pa.array(got.cuts.astype(np.int32)), pa.array(got.hash.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(digest, pa.binary()), tokens], names=["doc_id", "digest", "tokens"])

    # a doc_id that several rows share brings them all; the digest tells which is meant
    made = docs.mapInArrow(run, "doc_id long, digest binary, tokens array<long>").join(wanted, ["doc_id", "digest"], "left_semi").dropDuplicates(["digest"])
    return store(made.select(F.monotonically_increasing_id().alias("rid"), "digest", F.size("tokens").alias("n"), "tokens"), "classes")


def common_tokens(held: DataFrame, percent: int) -> DataFrame:
    """A stored table of rid, n and the shingles that other classes have too (df, the classes with each, and token, from the rarest); classes with too few of them are out."""
    tokens = held.select("rid", "n", F.explode("tokens").alias("token"))
    many = tokens.groupBy("token").agg(F.count("*").cast("int").alias("df")).where("df > 1")
    ranked = tokens.join(many, "token").groupBy("rid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("common"))
    ranked = ranked.where(F.size("common") * 100 >= F.col("n") * percent)
    return store(ranked.select("rid", "n", F.col("common.df").alias("df"), F.col("common.token").alias("tokens")), "common")


def prefixes(common: DataFrame, percent: int) -> DataFrame:
    """A stored table of prefix postings: token, rid, n, matches (the l that rid asks for)."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [], [])
            for rid, n, df, token in zip(batch["rid"].to_pylist(), batch["n"].to_pylist(), batch["df"], batch["tokens"], strict=True):
                df, token = df.values.to_numpy(), token.values.to_numpy()
                need = -(-n * percent // 100)
                asked = np.arange(1, MOST_MATCHES + 1)
                # shingles that no other class has come first and match nothing
                sizes = n - need + asked - (n - len(df))
                reads = np.concatenate(([0], np.cumsum(df.astype(np.int64))))[np.clip(sizes, 0, len(df))].astype(float)
                # a prefix can't be longer than the set, nor ask for more than partners must share
                cost = np.where((asked <= need) & (sizes <= len(df)), reads + VERIFY * reads / asked, np.inf)
                best = int(np.argmin(cost))
                size = int(sizes[best])
                if size >= asked[best]:
                    for column, value in zip(out, (token[:size], np.full(size, rid), np.full(size, n), np.full(size, asked[best])), strict=True):
                        column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], names=["token", "rid", "n", "matches"])

    return store(common.mapInArrow(choose, "token long, rid long, n long, matches long"), "prefixes")


def _of(common: DataFrame, ids: DataFrame) -> DataFrame:
    """rid, n, tokens of the classes in ids; a number of ids that may be broadcast keeps the others' shingles from being moved."""
    ids = ids.distinct()
    few = ids.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    return common.select("rid", "n", "tokens").join(F.broadcast(ids) if few else ids, "rid", "left_semi")


def verified(pairs: DataFrame, common: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. Shingles that one class alone has add to its size only."""
    a = _of(common, pairs.select(F.col("a").alias("rid"))).toDF("a", "na", "tokens_a")
    b = _of(common, pairs.select(F.col("b").alias("rid"))).toDF("b", "nb", "tokens_b")
    met = pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "na", "nb", F.size(F.array_intersect("tokens_a", "tokens_b")).alias("both"))
    return met.where(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent).select("a", "b")


def _fits(n: str, m: str, percent: int):
    return (F.col(n) * 100 >= F.col(m) * percent) & (F.col(m) * 100 >= F.col(n) * percent)


def _paired(lists: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs in different components that share as many prefix shingles as they must."""
    x = lists.select("token", F.col("rid").alias("a"), F.col("n").alias("na"), F.col("matches").alias("ma"), F.col("root").alias("ra"))
    y = lists.select("token", F.col("rid").alias("b"), F.col("n").alias("nb"), F.col("matches").alias("mb"), F.col("root").alias("rb"))
    met = x.join(y, "token").where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & _fits("na", "nb", percent))
    return met.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min(F.least("ma", "mb")).alias("asked")).where("shared >= asked").select("a", "b")


def _pivots(lists: DataFrame, turn: int, percent: int) -> DataFrame:
    """One pair for each class: with the pivot, of those of its posting lists in other components, that it shares most lists with."""
    draw = F.col("rid") if turn == 0 else F.xxhash64("rid", F.lit(turn))
    pivot = lists.groupBy("token").agg(F.min_by(F.struct("rid", "n", "root"), draw).alias("p")).select("token", F.col("p.rid").alias("b"), F.col("p.n").alias("nb"), F.col("p.root").alias("rb"))
    met = lists.join(pivot, "token").where((F.col("rid") != F.col("b")) & (F.col("root") != F.col("rb")) & _fits("n", "nb", percent))
    counts = met.groupBy("rid", "b").agg(F.count("*").alias("c"))
    return counts.groupBy("rid").agg(F.max_by("b", F.struct("c", -F.col("b"))).alias("b")).select(F.col("rid").alias("a"), "b")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few pairs as connect what the pairs (a, b) connect: each node but the least of its component with that least one."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        after = label.copy()
        # the label of each end's root falls to the least that an edge offers, then paths are shortened
        np.minimum.at(after, label[x], low)
        np.minimum.at(after, label[y], low)
        while (after[after] != after).any():
            after = after[after]
        after = after[label]
        if (after == label).all():
            break
        label = after
    rest = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[rest], nodes[label[rest]]


def _counts(q: np.ndarray, m: np.ndarray, flat: np.ndarray, owner: np.ndarray, row: np.ndarray, column: np.ndarray, asks: np.ndarray) -> np.ndarray:
    """How many tokens each of q shares with each of m, some tokens at a time."""
    both = np.zeros((len(q), len(m)), np.float32)
    seen = np.intersect1d(flat[asks], flat[~asks])
    for at in range(0, len(seen), COUNTED):
        part = seen[at : at + COUNTED]
        k = np.minimum(np.searchsorted(part, flat), len(part) - 1)
        hit = part[k] == flat
        left, right = np.zeros((len(q), len(part)), np.float32), np.zeros((len(m), len(part)), np.float32)
        left[row[owner[hit & asks]], k[hit & asks]] = 1
        right[column[owner[hit & ~asks]], k[hit & ~asks]] = 1
        both += left @ right.T
    return both


def _blocked(members: DataFrame, common: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of large clusters. members: cluster, rid, root, n, matches, prefix. Every class outside the cluster's largest component meets
    every class of the cluster, in blocks whose sides have at most about BLOCK classes and HELD shingles. In a block, too, candidates are the classes that share as
    many prefix shingles as they must; they are counted by matrix products, as no list of pairs is as large as a block. Of the links only a
    forest is returned, fewer than the block has components."""
    each = members.groupBy("cluster", "root").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    sizes = each.groupBy("cluster").agg(F.sum("c").alias("all"), F.sum("s").alias("whole"), F.max_by(F.struct("root", "c", "s"), F.struct("c", "root")).alias("main"))
    sides = lambda classes, shingles: F.ceil(F.greatest(classes / BLOCK, shingles / HELD)).cast("int")
    sizes = sizes.select("cluster", F.col("main.root").alias("main"), sides(F.col("all") - F.col("main.c"), F.col("whole") - F.col("main.s")).alias("across"), sides(F.col("all"), F.col("whole")).alias("along"))
    tagged = members.join(sizes, "cluster").withColumn("odd", F.col("root") != F.col("main")).drop("n")
    held = tagged.join(_of(common, members.select("rid")), "rid")
    place = lambda n, salt: F.pmod(F.xxhash64("rid", F.lit(salt)), F.col(n)).cast("int")
    columns = ["rid", "root", "n", "matches", "prefix", "tokens"]
    one = held.where("odd").select("cluster", place("across", 1).alias("x"), F.explode(F.sequence(F.lit(0), F.col("along") - 1)).alias("y"), F.lit(True).alias("query"), *columns)
    two = held.select("cluster", F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("x"), place("along", 2).alias("y"), F.lit(False).alias("query"), *columns)

    def compare(table: pa.Table) -> pa.Table:
        query = table.column("query").to_numpy(zero_copy_only=False).astype(bool)
        root, n, matches = (table.column(c).to_numpy().astype(np.int64) for c in ("root", "n", "matches"))
        q, m = np.flatnonzero(query), np.flatnonzero(~query)
        row, column = np.cumsum(query) - 1, np.cumsum(~query) - 1

        def shared(name: str, keep: np.ndarray) -> np.ndarray:
            """Counts of shared tokens; classes that keep leaves out share none."""
            lists = table.column(name).combine_chunks()
            cuts = lists.offsets.to_numpy().astype(np.int64)
            flat, owner = lists.values.to_numpy()[cuts[0] : cuts[-1]], np.repeat(np.arange(len(query)), np.diff(cuts))
            flat, owner = flat[keep[owner]], owner[keep[owner]]
            return _counts(q, m, flat, owner, row, column, query[owner])

        every = np.ones(len(query), bool)
        candidate = (shared("prefix", every) >= np.minimum(matches[q][:, None], matches[m][None, :])) & (root[q][:, None] != root[m][None, :])
        alive = np.zeros(len(query), bool)
        alive[q], alive[m] = candidate.any(axis=1), candidate.any(axis=0)
        both = shared("tokens", alive)
        linked = candidate & (both * 100 >= (n[q][:, None] + n[m][None, :] - both) * percent)
        a, b = np.nonzero(linked)
        a, b = forest(root[q[a]], root[m[b]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return one.unionAll(two).groupBy("cluster", "x", "y").applyInArrow(compare, "a long, b long")


def link_classes(held: DataFrame, percent: int) -> DataFrame:
    """rid and root, equal for classes that links connect; classes without a link may be missing."""
    spark = held.sparkSession
    common = common_tokens(held, percent)
    postings = prefixes(common, percent)
    roots = store(spark.createDataFrame([], "node long, root long"), "roots")
    size = postings.count()

    def settle(links: DataFrame) -> bool:
        """Take new links into roots."""
        nonlocal roots
        links = store(links, "links")
        if links.isEmpty():
            return False
        of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
        edges = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
        grown = components(edges)
        moved = roots.join(grown.withColumnRenamed("root", "top").withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        before, roots = roots, store(moved.unionAll(grown.join(roots.select("node"), "node", "left_anti").select("node", "root")), "roots")
        for table in (links, grown, before):
            discard(table)
        del edges, grown, moved, before
        sweep(spark)
        return True

    held_lists: list[DataFrame] = []

    def open_lists() -> tuple[DataFrame, float]:
        """Posting lists that hold several components, and how many pairs they make. They take the place of those before."""
        lists = store(postings.join(roots.withColumnRenamed("node", "rid"), "rid", "left").select("token", "rid", "n", "matches", F.coalesce("root", "rid").alias("root")), "lists")
        for table in held_lists:
            discard(table)
        held_lists[:] = [lists]
        groups = lists.groupBy("token", "root").agg(F.count("*").alias("c")).groupBy("token").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("own")).where("c * c > own")
        left = groups.agg(F.coalesce(F.sum((F.col("c").cast("double") * F.col("c") - F.col("own")) / 2), F.lit(0.0))).first()[0]
        return lists.join(groups.select("token"), "token", "left_semi"), left

    for turn in range(ROUNDS):
        lists, left = open_lists()
        if not left:
            return roots.withColumnRenamed("node", "rid")
        if left <= size or not settle(verified(_pivots(lists, turn, percent), common, percent)):
            break
    lists, left = open_lists()
    lists = store(lists, "open")
    least = lists.groupBy("token").agg(F.min("rid").alias("least"))
    clusters = components(lists.join(least, "token").where("rid <> least").select(F.col("rid").alias("a"), F.col("least").alias("b")).distinct()).withColumnsRenamed({"node": "rid", "root": "cluster"})
    large = clusters.groupBy("cluster").agg(F.count("*").alias("c")).where(F.col("c") > PAIRED).select("cluster")
    in_large = store(clusters.join(large, "cluster", "left_semi"), "large")
    links = verified(store(_paired(lists.join(in_large.select("rid"), "rid", "left_anti"), percent), "pairs"), common, percent)
    if not in_large.isEmpty():
        members = in_large.join(lists.groupBy("rid").agg(F.first("root").alias("root"), F.first("n").alias("n"), F.first("matches").alias("matches"), F.collect_list("token").alias("prefix")), "rid").select("cluster", "rid", "root", "n", "matches", "prefix")
        links = links.unionAll(_blocked(members, common, percent))
    settle(links)
    return roots.withColumnRenamed("node", "rid")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach, its own included)."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("doc_id"), text_or_empty().alias("text"))
    known = sets(rows, k)
    total = known.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    slices = max(splits(rows) if total > SLICE else 1, math.ceil(total / SLICE))
    shared = shared_counts(rows, k, slices)
    least = known.where("n_shingles > 0").groupBy("doc_id").agg(F.min("n_shingles").alias("least"))
    alive = shared.join(least, "doc_id").where(F.col("shared") * 100 >= F.col("least") * percent).select("doc_id")
    wanted = store(known.where("n_shingles > 0").join(alive, "doc_id", "left_semi").groupBy("digest").agg(F.min("doc_id").alias("doc_id")), "wanted")
    held = classes(rows, wanted, k)
    roots = link_classes(held, percent)
    # a class that is linked goes by its root's rid, another by its own digest
    tops = held.select("rid", "digest").join(roots, "rid").select("digest", F.col("root"))
    own = F.when(F.col("n_shingles") > 0, F.coalesce(F.concat(F.lit("r"), F.col("root").cast("string")), F.hex("digest")))
    named = known.join(tops, "digest", "left").withColumn("group", own)
    real = F.when(F.col("doc_id") != NONE, F.col("doc_id"))
    smallest = named.where("n_shingles > 0").groupBy("group").agg(F.min(real).alias("smallest"))
    out = named.join(smallest, "group", "left")
    return out.select(real.alias("doc_id"), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("smallest")).otherwise(real).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, but for all of a component except its smallest key."""
    rows, key = keyed(docs)
    found = near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"), k, percent)
    return without(rows, key, found.where("doc_id <> component_id").select("doc_id"))
