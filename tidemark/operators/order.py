"""Exact order statistics without a global sort: a sketch brackets each wanted rank, a second pass counts the values inside the brackets.

What reaches the driver is a bounded number of distinct values a bracket; a bracket that still holds more is bracketed again, ten thousand times
narrower each time. Every answer is checked against counts, so the sketch's error decides only how much is read."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct values of a bracket that the driver takes, and the sketch's accuracy (its error is one in so many rows).
MOST, ACCURACY = 20_000, 10_000


def select_ranks(rows: DataFrame, ranks: Mapping[str, Sequence[int]], most: int = MOST) -> dict[str, dict[int, float]]:
    """For each column of numbers the values at ranks (from 0, ascending, nulls left out)."""
    columns = [c for c, r in ranks.items() if r]
    if not columns:
        return {}
    n = rows.agg(*(F.count(c).alias(f"n{i}") for i, c in enumerate(columns))).first()
    sized = dict(zip(columns, n, strict=True))
    asked = [(c, k) for c in columns for k in sorted(set(ranks[c])) if 0 <= k < sized[c]]
    bracket = {a: (-math.inf, math.inf) for a in asked}
    large = [c for c in columns if sized[c] > most]
    if large:
        step = 2 / ACCURACY
        points = {c: [min(max(k / max(sized[c] - 1, 1) + s, 0.0), 1.0) for a, k in asked if a == c for s in (-step, step)] for c in large}
        cuts = rows.agg(*(F.percentile_approx(F.col(c).cast("double"), points[c], ACCURACY).alias(f"q{i}") for i, c in enumerate(large))).first()
        for i, c in enumerate(large):
            for j, k in enumerate(k for a, k in asked if a == c):
                bracket[c, k] = (cuts[i][2 * j], cuts[i][2 * j + 1])
    found: dict[str, dict[int, float]] = {c: {} for c in ranks}
    while asked:
        value = lambda c: F.col(c).cast("double")
        inside = lambda a: value(a[0]).isNotNull() & (value(a[0]) >= bracket[a][0]) & ((value(a[0]) <= bracket[a][1]) | F.lit(bracket[a][1] == math.inf))
        below = dict(zip(asked, rows.agg(*(F.count_if(value(a[0]) < bracket[a][0]).alias(f"b{i}") for i, a in enumerate(asked))).first(), strict=True))
        cells = rows.select(F.inline(F.array(*(F.struct(F.lit(i).alias("k"), F.when(inside(a), value(a[0])).alias("v")) for i, a in enumerate(asked))))).where("v is not null").groupBy("k", "v").agg(F.count("*").alias("n"))
        sizes = {r["k"]: (r["d"], r["n"]) for r in cells.groupBy("k").agg(F.count("*").alias("d"), F.sum("n").alias("n")).collect()}
        few = [i for i, a in enumerate(asked) if sizes.get(i, (0, 0))[0] <= most]
        held: dict[int, list] = {i: [] for i in few}
        for r in cells.where(F.col("k").isin(few)).collect() if few else []:
            held[r["k"]].append((r["v"], r["n"]))
        left = []
        for i, a in enumerate(asked):
            total = sizes.get(i, (0, 0))[1]
            if not below[a] <= a[1] < below[a] + total:
                bracket[a] = (-math.inf, math.inf)  # the sketch was off
                left.append(a)
            elif i in held:
                at = below[a]
                for v, m in sorted(held[i], key=lambda x: (x[0] != x[0], x[0])):
                    at += m
                    if a[1] < at:
                        found[a[0]][a[1]] = v
                        break
            else:
                part = rows.where(inside(a)).select(value(a[0]).alias("v"))
                p, step = (a[1] - below[a]) / max(total - 1, 1), 2 / ACCURACY
                low, high = part.agg(F.percentile_approx("v", [max(p - step, 0.0), min(p + step, 1.0)], ACCURACY)).first()[0]
                bracket[a] = (low, high)
                left.append(a)
        asked = left
    return found


def held(rows: DataFrame) -> DataFrame:
    """rows that a lazy result reads several times, made once: kept in memory and on disk unless they are kept already. They stay until the session lets go
    of them."""
    return rows.persist(StorageLevel.MEMORY_AND_DISK) if rows.storageLevel == StorageLevel.NONE else rows


def quantiles(rows: DataFrame, wanted: Mapping[str, Sequence[float]], most: int = MOST) -> dict[str, list[float | None]]:
    """For each column its percentiles (0 to 1), interpolated between neighbours; None for a column without values."""
    if not wanted:
        return {}
    # read some five times, made once
    held = rows.select(*wanted)
    own = held.storageLevel == StorageLevel.NONE
    if own:
        held.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _quantiles(held, wanted, most)
    finally:
        if own:
            held.unpersist()


def _quantiles(rows: DataFrame, wanted: Mapping[str, Sequence[float]], most: int) -> dict[str, list[float | None]]:
    n = dict(zip(wanted, rows.agg(*(F.count(c).alias(f"n{i}") for i, c in enumerate(wanted))).first(), strict=True))
    spots = {c: [p * (n[c] - 1) for p in ps] if n[c] else [] for c, ps in wanted.items()}
    got = select_ranks(rows, {c: [r for s in spots[c] for r in (math.floor(s), math.ceil(s))] for c in wanted}, most)
    out: dict[str, list[float | None]] = {}
    for c, ps in wanted.items():
        made = []
        for s in spots[c]:
            a, b = got[c][math.floor(s)], got[c][math.ceil(s)]
            share = s - math.floor(s)
            made.append(a if a == b else (1 - share) * a + share * b)
        out[c] = made or [None] * len(ps)
    return out


def quantile(rows: DataFrame, x: str, p: float) -> float | None:
    return quantiles(rows, {x: [p]})[x][0]
