"""Whether a feature tells more of a label than chance: permutations of the label by seeded hash orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import div
from .evaluation import benjamini_hochberg
from .order import select_ranks


def place(key: Column, j: int, seed: int) -> Column:
    """Where permutation j puts a row: 52 bits of the MD5 of seed, j and key, which other engines can repeat and a double holds."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit(j), key.cast("string"))), 1, 13), 16, 10).cast("long")


def permutation_test(rows: DataFrame, key: str, features: list[str], label: str, n: int = 100, seed: int = 42, bins: int = 10, alpha: float = 0.05) -> DataFrame:
    """feature, mi, random_mean, random_dev, p, q, found. The statistic is the mutual information (nats) of equal-width bins of the feature with a 0/1 label;
    p = (k + 1) / (n + 1) for the k permutations that reach it, q is adjusted for the number of features.

    A permutation of 0s and 1s is a choice of the rows that get the 1s: those with the smallest places, as many as there are ones. The place of the last one is an
    exact order statistic, so no order is made, and one pass counts, for each bin, its rows, its ones and its ones in every permutation; features aren't copied.
    Rows with a null label or feature don't count for it; rows that share a key fall together."""
    held = rows.where(F.col(label).isNotNull())
    limits = held.agg(F.sum(F.col(label).cast("long")).alias("ones"), F.count("*").alias("n"), *(f(c).alias(f"{a}{i}") for i, c in enumerate(features) for a, f in (("l", F.min), ("h", F.max)))).first()
    kind = "feature string, mi double, random_mean double, random_dev double, p double"
    if not limits["n"] or not limits["ones"]:
        return benjamini_hochberg(rows.sparkSession.createDataFrame([], kind), alpha)
    ones = int(limits["ones"])
    placed = held.select(*(place(F.col(key), j, seed).cast("double").alias(f"__r{j}") for j in range(n)))
    cuts = select_ranks(placed, {f"__r{j}": [ones - 1] for j in range(n)})
    chosen = [(place(F.col(key), j, seed) <= F.lit(int(cuts[f"__r{j}"][ones - 1]))).cast("int") for j in range(n)]
    binned = [F.least(F.floor(div(F.col(c).cast("double") - F.lit(float(limits[f"l{i}"])), F.lit(float(limits[f"h{i}"]) - float(limits[f"l{i}"]))) * bins), F.lit(bins - 1)).cast("int") for i, c in enumerate(features)]
    long = held.select(F.col(label).cast("int").alias("y"), F.array(*chosen).alias("__c"), F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), b.alias("bin")) for c, b in zip(features, binned, strict=True))))).where("bin is not null")
    cells = long.groupBy("feature", "bin").agg(F.count("*").alias("nx"), F.sum("y").alias("t"), F.array(*(F.sum(F.col("__c")[j]) for j in range(n))).alias("r"))
    each = cells.select("feature", "nx", F.posexplode(F.concat(F.array("t"), "r")).alias("j", "ones"))
    whole = each.groupBy("feature", "j").agg(F.sum("nx").alias("n"), F.sum("ones").alias("n1"))
    term = lambda a, total: F.when(a > 0, a / F.col("n") * F.log(a * F.col("n") / (F.col("nx") * total))).otherwise(0.0)
    mi = each.join(whole, ["feature", "j"]).groupBy("feature", "j").agg(F.sum(term(F.col("ones"), F.col("n1")) + term(F.col("nx") - F.col("ones"), F.col("n") - F.col("n1"))).alias("mi"))
    seen = mi.where("j = 0").select("feature", F.col("mi").alias("true"))
    tests = mi.where("j > 0").join(seen, "feature").groupBy("feature").agg(F.max("true").alias("mi"), F.avg("mi").alias("random_mean"), F.stddev_pop("mi").alias("random_dev"), ((F.count_if(F.col("mi") >= F.col("true") - 1e-12) + 1) / (n + 1)).alias("p"))
    # one row a feature, read several times
    return benjamini_hochberg(tests.persist(), alpha)
