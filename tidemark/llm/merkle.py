"""Merkle manifest of a dataset by slot pivots.

Every row is hashed to a leaf; the leaves of a group stand in the order of their key, and every `fanout` consecutive nodes become
their parent, level by level, until one is left; the groups' roots likewise give the root of the dataset. A step deals nodes to
their ancestor `height` levels up and spreads them over columns, one a slot, by conditional aggregates: the columns of a parent
joined and hashed are the parent, the same columns without the own one are the siblings of a slot. Steps go up once, over tables that
shrink by fanout ** height, and down once, when each row hands its slots what stands above it. No group is gathered, however large.

Nulls are hashed as nulls; a null group is a group of its own, the first; rows with a null key come first. Rows that share a key stand in the
order of their leaves; repeated rows are leaves of their own. A group of one row has its leaf as root. An empty table gives no rows.
Columns that aren't named take no part, whatever they are called."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import splits, store

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:int,siblings:array<string>>>"
#: Levels of two that a step climbs, so slots of a step are 16.
HEIGHT = 4


def leaf_of(*fields: Column) -> Column:
    """The digest of a row's fields: '-' for a null, else the count of its UTF-8 bytes, ':' and the value."""
    text = [x.cast("string") for x in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in text)), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    joined = lambda x, start, n: F.array_join(F.slice(x, start, n), "")
    return F.aggregate(path, leaf, lambda acc, x: F.sha2(F.concat(joined(x.siblings, F.lit(1), x.left), acc, joined(x.siblings, x.left + 1, F.size(x.siblings))), 256))


def proof(path: Column) -> Column:
    """All siblings of a path, from the leaf's to the root's, left to right, as one string."""
    return F.array_join(F.flatten(F.transform(path, lambda x: x.siblings)), "")


def _placed(rows: DataFrame, order: Sequence[str], fanout: int, name: str) -> DataFrame:
    """rows: grp and what stands in order. Adds pos, the place in the group from 0, and depth, the levels above the group's leaves.

    Rows are dealt by ranges, so a large group has many; counts of each group in each range, a small table, give where a range begins."""
    keys = ["grp", *order, "__at"]
    held = store(
        rows.withColumn("__at", F.monotonically_increasing_id()).repartitionByRange(splits(rows), *keys).sortWithinPartitions(*keys).drop("__at").withColumn("at", F.monotonically_increasing_id()),
        name,
        compression="zstd",
    )
    part = F.shiftright("at", 33)
    runs = held.groupBy("grp", part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    group = Window.partitionBy("grp")
    before = F.coalesce(F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("grp", "part", "first", before.alias("before"), F.sum("n").over(group).alias("total"))
    powers = [fanout**k for k in range(64) if fanout**k < 1 << 62]
    depth = F.expr(" + ".join(f"CAST(total > {p} AS INT)" for p in powers))
    return held.withColumn("part", part).join(runs, ["grp", "part"]).withColumns({"pos": F.col("before") + F.col("at") - F.col("first"), "depth": depth}).drop("part", "first", "before", "total", "at")


def _slot(level: int, i: int) -> str:
    return f"s0_{i}.digest" if level == 0 else f"s{level}_{i}"


def _pivoted(nodes: DataFrame, fanout: int, height: int) -> DataFrame:
    """nodes: grp, pos, depth, node. A row for each ancestor height levels up: the nodes below it in columns, one a slot."""
    width = fanout**height
    spread = [F.expr(f"max(CASE WHEN pos % {width} = {i} THEN node END) AS s0_{i}") for i in range(width)]
    return store(nodes.groupBy("grp", F.expr(f"pos div {width} AS up")).agg(F.max("depth").alias("depth"), *spread), "merkle", compression="zstd")


def _climbed(slots: DataFrame, fanout: int, height: int) -> DataFrame:
    """Adds the nodes of each level up to the ancestor. Levels above the root of a group pass it on."""
    for t in range(height):
        level = []
        for j in range(fanout ** (height - t - 1)):
            kids = [_slot(t, j * fanout + k) for k in range(fanout)]
            joined = ", ".join(f"coalesce({k}, '')" for k in kids)
            level.append(f"CASE WHEN {kids[0]} IS NOT NULL THEN CASE WHEN depth > {t} THEN sha2(concat({joined}), 256) ELSE {kids[0]} END END AS s{t + 1}_{j}")
        slots = slots.selectExpr("*", *level)
    return slots


def _path(i: int, fanout: int, height: int) -> str:
    """What slot i meets on its way to the ancestor: at each level the slots of its parent but its own."""
    met = []
    for t in range(height):
        at = i // fanout**t
        others = ", ".join(_slot(t, at // fanout * fanout + k) for k in range(fanout) if k != at % fanout)
        met.append(f"CASE WHEN depth > {t} THEN named_struct('left', {at % fanout}, 'siblings', array_compact(array({others}))) END")
    return f"array_compact(array({', '.join(met)}))"


def _up(nodes: DataFrame, fanout: int, height: int) -> tuple[list[DataFrame], DataFrame]:
    """The pivots of all steps, lowest first, and the root of each group (grp, digest)."""
    depth = nodes.agg(F.max("depth")).first()[0] or 0
    pivots = []
    for _ in range(max(1, -(-depth // height))):
        pivots.append(_pivoted(nodes, fanout, height))
        nodes = _climbed(pivots[-1], fanout, height).select("grp", F.col("up").alias("pos"), F.greatest(F.col("depth") - height, F.lit(0)).alias("depth"), F.struct(F.col(f"s{height}_0").alias("digest")).alias("node"))
    return pivots, nodes.select("grp", F.col("node.digest").alias("digest"))


def _down(pivots: list[DataFrame], tops: DataFrame, fanout: int, height: int) -> DataFrame:
    """tops: grp, above (the path from the group's root), and columns for all rows of the group. Returns the nodes of the lowest step with theirs."""
    width, more = fanout**height, [c for c in tops.columns if c not in ("grp", "above")]
    now = tops.withColumn("up", F.lit(0).cast("long"))
    each = [f"CASE WHEN s0_{i}.digest IS NOT NULL THEN named_struct('up', up * {width} + {i}, 'node', s0_{i}, 'above', concat({_path(i, fanout, height)}, above)) END" for i in range(width)]
    for k in range(len(pivots) - 1, -1, -1):
        rows = _climbed(pivots[k], fanout, height).join(now, ["grp", "up"])
        now = rows.select("grp", *more, F.expr(f"explode(array_compact(array({', '.join(each)}))) AS x")).select("grp", *more, "x.*")
        if k:
            now = now.drop("node")
    return now


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", key: str = "doc_id", fanout: int = 2, also: dict[str, Column] | None = None) -> DataFrame:
    """One row a row of docs: key, leaf, the root of its group (subroot), the root of all (root), and path: from the leaf to the root, at each
    level the count of siblings on its left and all siblings. also: further columns over docs to be kept beside a leaf. fold(leaf, path)
    gives the root back; proof(path) is what a verifier is handed."""
    also = also or {}
    name = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))
    height = max(1, HEIGHT // max(1, (fanout - 1).bit_length()))
    leaves = docs.select(name.alias("grp"), F.col(key).alias("key"), leaf_of(*map(F.col, fields)).alias("leaf"), *(c.alias(f"also_{k}") for k, c in also.items()))
    leaves = _placed(store(leaves, "leaves", compression="zstd"), ("key", "leaf"), fanout, "ordered")
    kept = F.struct(F.col("leaf").alias("digest"), "key", *(f"also_{k}" for k in also))
    pivots, roots = _up(leaves.select("grp", "pos", "depth", kept.alias("node")), fanout, height)

    groups = _placed(roots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest"), ("name",), fanout, "groups")
    over, root = _up(groups.select("grp", "pos", "depth", F.struct("digest", "name").alias("node")), fanout, height)
    tops = _down(over, root.select("grp", F.array().cast(PATH).alias("above"), F.col("digest").alias("root")), fanout, height)
    tops = tops.select(F.col("node.name").alias("grp"), "above", F.col("node.digest").alias("subroot"), "root")
    rows = _down(pivots, tops, fanout, height)
    return rows.select(F.col("node.key").alias(key), F.col("node.digest").alias("leaf"), "subroot", "root", F.col("above").alias("path"), *(F.col(f"node.also_{k}").alias(k) for k in also))


def audit(docs: DataFrame) -> DataFrame:
    """The manifest of docs, and its proofs tried on rows of which some have been tampered with: where 7 divides the CRC-32 of the decimal doc_id,
    1 is added to n_chars (a null stays). Returns doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    more = F.try_add(F.col("n_chars"), F.lit(1))
    changed = leaf_of(*(more if c == "n_chars" else F.col(c) for c in FIELDS))
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    rows = manifest(docs, also={"tampered": F.when(hit, changed)})
    out = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), fold(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
