"""Guarded window functions over a panel of (symbol, date) rows.

A rolling value is null until its frame holds enough non-null values; a division by (almost) nothing is null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Fn = Callable[[Column], Column]
EPS = 1e-12


def rounded(x: str | Column, digits: int) -> Column:
    """F.round(x, digits) + 0.0 of doubles, which Spark takes through a decimal of each value. Away from ties a whole number of the last digit, divided, is the
    same double; what lies within a thousandth of a tie, or has over twelve digits, goes through the decimal."""
    scale = 10.0**digits
    steps = col(x) * scale
    near = F.rint(steps)
    return F.when((F.abs(steps) < 1e12) & (F.abs(steps - near) < 0.499), near / scale).otherwise(F.round(col(x), digits)) + 0.0


#: Tasks a core that tables dealt by symbol are cut into at least.
TASKS = 4


def dealt(table: DataFrame) -> DataFrame:
    """table dealt by symbol into a set number of partitions, at least TASKS a core. Passes over a symbol cost far more than the bytes of its bars tell, by
    which Spark would put them into fewer tasks than there are cores."""
    session = table.sparkSession
    n = max(int(session.conf.get("spark.sql.shuffle.partitions")), TASKS * session.sparkContext.defaultParallelism)
    return table.repartition(n, "symbol")


def by_symbol():
    """The rows of a symbol by date. Made when asked for, as it takes a session."""
    return Window.partitionBy("symbol").orderBy("date")


def by_date():
    return Window.partitionBy("date")


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rows(w: int, window=None):
    return (window or by_symbol()).rowsBetween(-(w - 1), 0)


def rolling(fn: Fn, x: str | Column, w: int, least: int, window=None) -> Column:
    frame = rows(w, window)
    return F.when(F.count(col(x)).over(frame) >= least, fn(col(x)).over(frame))


def mean(x, w: int, least: int | None = None) -> Column:
    return rolling(F.avg, x, w, least or max(5, w // 3))


def std0(x, w: int, least: int | None = None) -> Column:
    return rolling(F.stddev_pop, x, w, least or max(5, w // 3))


def std1(x, w: int, least: int | None = None) -> Column:
    return rolling(F.stddev_samp, x, w, max(2, least or max(5, w // 3)))


def total(x, w: int, least: int) -> Column:
    return rolling(F.sum, x, w, least)


def high(x, w: int, least: int | None = None) -> Column:
    return rolling(F.max, x, w, least or max(2, w // 3))


def low(x, w: int, least: int | None = None) -> Column:
    return rolling(F.min, x, w, least or max(2, w // 3))


def let(body: Callable[[Column], Column], **values: Column) -> Column:
    """body of a struct of values. A window function that an expression names twice is computed twice; so it is named once here."""
    return F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), body)[0]


def div(a, b) -> Column:
    """a / b, null where b is null or within EPS of 0."""
    if isinstance(b, str):
        return F.when(F.abs(b) > EPS, col(a) / F.col(b))
    return let(lambda s: F.when(F.abs(s["b"]) > EPS, s["a"] / s["b"]), a=col(a).cast("double"), b=b.cast("double"))


def zscore(x, w: int, least: int | None = None, sample: bool = False) -> Column:
    """Distance of x to its rolling mean in units of its rolling deviation, from three window functions."""
    frame, least = rows(w), least or max(5, w // 3)
    x = col(x).cast("double")
    dev = (F.stddev_samp if sample else F.stddev_pop)(x).over(frame)
    return let(lambda s: F.when((s["n"] >= least) & (F.abs(s["s"]) > EPS), (s["x"] - s["m"]) / s["s"]), x=x, n=F.count(x).over(frame), m=F.avg(x).over(frame), s=dev)


def lag(x, k: int = 1) -> Column:
    return F.lag(col(x), k).over(by_symbol())


def diff(x, k: int = 1) -> Column:
    return col(x) - lag(x, k)


def clip(x, lo: float, hi: float) -> Column:
    """x within bounds; null stays null."""
    bound = lambda v: F.when(v.isNotNull(), F.greatest(F.least(v, F.lit(hi)), F.lit(lo)))
    return bound(F.col(x)) if isinstance(x, str) else let(lambda s: bound(s["x"]), x=x.cast("double"))


def forward_fill(x, window=None) -> Column:
    return F.last(col(x), ignorenulls=True).over((window or by_symbol()).rowsBetween(Window.unboundedPreceding, 0))


def finite(x) -> Column:
    """x, null where it is NaN or infinite."""
    return F.when(~F.isnan(col(x)) & (F.abs(col(x)) != float("inf")), col(x))


def running(table, x: str, wanted: dict[str, tuple[str, int, int]]):
    """table with rolling columns of x: name -> (mean, dev or z, rows, values that must be there).

    A sliding frame costs as many steps a row as it is long. Here each row takes the difference of two running sums, whatever
    the length; a deviation within rounding of 0 counts as 0."""
    order = by_symbol()
    before = order.rowsBetween(Window.unboundedPreceding, 0)
    v = F.col(x).cast("double")
    squares = any(kind != "mean" for kind, _, _ in wanted.values())
    sums = {"__c": F.count(v).over(before), "__s": F.coalesce(F.sum(v).over(before), F.lit(0.0))}
    if squares:
        sums["__q"] = F.coalesce(F.sum(v * v).over(before), F.lit(0.0))
    held = table.withColumns(sums)
    sizes = sorted({w for _, w, _ in wanted.values()})
    held = held.withColumns({f"{c}{w}": F.col(c) - F.lag(c, w, 0 if c == "__c" else 0.0).over(order) for w in sizes for c in sums})
    out = {}
    for name, (kind, w, least) in wanted.items():
        n, s = F.col(f"__c{w}"), F.col(f"__s{w}")
        if kind == "mean":
            out[name] = F.when(n >= least, s / n)
            continue
        square = F.col(f"__q{w}") / n
        spread = square - s / n * (s / n)
        dev = F.when(spread > 1e-13 * square, F.sqrt(spread)).otherwise(0.0)
        out[name] = F.when(n >= least, dev if kind == "dev" else F.when(dev > EPS, (v - s / n) / dev))
    return held.withColumns(out).drop(*sums, *(f"{c}{w}" for w in sizes for c in sums))


def _merged(a: list[Column], b: list[Column]) -> list[Column]:
    """Count, mean and sum of squared deviations of two stretches of rows together."""
    (n, m, q), (k, l, p) = a, b
    total, step = F.nullif(n + k, F.lit(0.0)), l - m
    return [n + k, F.when(k == 0, m).when(n == 0, l).otherwise(m + step * k / total), F.when((k == 0) | (n == 0), q + p).otherwise(q + p + step * step * n * k / total)]


def rolled(table, wanted: dict[str, tuple[str, str, int, int]]):
    """table with rolling columns: name -> (kind, x, rows, values that must be there). Kinds: mean, sum, dev (of the population), dev1 (of the sample), z and z1
    (distance to the mean in units of them), high, low.

    A sliding frame costs as many steps a row as it is long. Here stretches of 1, 2, 4 ... rows are put together from two halves each, and a frame from the
    stretches that its length is a sum of: some six lags for 60 rows, which all columns share. Only values of the frame are added, and deviations are those
    of its halves from its own means, so nothing that lies before the frame is left in it."""
    order = by_symbol()
    moments = {"mean", "sum", "dev", "dev1", "z", "z1"}
    xs = list(dict.fromkeys(x for _, x, _, _ in wanted.values()))
    at = {x: i for i, x in enumerate(xs)}
    tracks: dict[str, set[int]] = {}
    for kind, x, w, _ in wanted.values():
        for what in "m" if kind in moments else kind[0] + "c":
            tracks.setdefault(f"{what}{at[x]}", set()).add(w)
    squares = {f"m{at[x]}" for kind, x, _, _ in wanted.values() if kind in {"dev", "dev1", "z", "z1"}}
    parts = lambda t: ("n", "m", "q") if t in squares else ("n", "m") if t[0] == "m" else ("v",)

    def join(t: str, a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
        if t in squares:
            return dict(zip("nmq", _merged(list(a.values()), list(b.values())), strict=True))
        if t[0] == "m":  # the sum in place of the mean
            return {k: a[k] + b[k] for k in a}
        return {"v": a["v"] + b["v"] if t[0] == "c" else F.greatest(a["v"], b["v"]) if t[0] == "h" else F.least(a["v"], b["v"])}

    first = {}
    for t in tracks:
        v = F.col(xs[int(t[1:])]).cast("double")
        one = {"n": v.isNotNull().cast("double"), "m": F.coalesce(v, F.lit(0.0)), "q": F.lit(0.0), "v": v.isNotNull().cast("double") if t[0] == "c" else v}
        first |= {f"__b_{t}_{p}": one[p] for p in parts(t)}
    out, stretch, done = table.withColumns(first), 1, dict.fromkeys(((t, w) for t in tracks for w in tracks[t]), 0)
    longest = max(w for ws in tracks.values() for w in ws)
    while stretch <= longest:
        lags, made, old = {}, {}, []
        for t, ws in tracks.items():
            block = {p: F.col(f"__b_{t}_{p}") for p in parts(t)}
            late = lambda p, k: F.lag(block[p], k, None if t[0] in "hl" else 0.0).over(order)
            for w in ws:
                if not w & stretch:
                    continue
                k = done[t, w]
                mine = {p: F.col(f"__a_{t}_{w}_{p}") for p in block}
                if k:
                    lags |= {f"__g_{t}_{w}_{p}": late(p, k) for p in block}
                    made |= {f"__a_{t}_{w}_{p}": c for p, c in join(t, mine, {p: F.col(f"__g_{t}_{w}_{p}") for p in block}).items()}
                else:
                    made |= {f"__a_{t}_{w}_{p}": c for p, c in block.items()}
                done[t, w] = k + stretch
            if max(ws) >= 2 * stretch:
                lags |= {f"__l_{t}_{p}": late(p, stretch) for p in block}
                made |= {f"__b_{t}_{p}": c for p, c in join(t, block, {p: F.col(f"__l_{t}_{p}") for p in block}).items()}
            else:
                old += [f"__b_{t}_{p}" for p in block]
        out = (out.withColumns(lags) if lags else out).withColumns(made).drop(*lags, *old)
        stretch *= 2
    found = {}
    for name, (kind, x, w, least) in wanted.items():
        i = at[x]
        if kind in ("high", "low"):
            found[name] = F.when(F.col(f"__a_c{i}_{w}_v") >= least, F.col(f"__a_{kind[0]}{i}_{w}_v"))
            continue
        n, m = F.col(f"__a_m{i}_{w}_n"), F.col(f"__a_m{i}_{w}_m")
        if f"m{i}" in squares:
            mean_, sum_ = m, m * n
            q = F.col(f"__a_m{i}_{w}_q")
            dev = F.sqrt(q / F.nullif(n - 1 if kind in ("dev1", "z1") else n, F.lit(0.0)))
        else:
            mean_, sum_, dev = m / F.nullif(n, F.lit(0.0)), m, None
        if kind in ("dev", "dev1"):
            found[name] = F.when(n >= max(least, 1 + (kind == "dev1")), dev)
        elif kind in ("z", "z1"):
            found[name] = F.when((n >= max(least, 1 + (kind == "z1"))) & (dev > EPS), (F.col(xs[i]).cast("double") - mean_) / dev)
        else:
            found[name] = F.when(n >= least, mean_ if kind == "mean" else sum_)
    return out.withColumns(found).drop(*(f"__a_{t}_{w}_{p}" for t, ws in tracks.items() for w in ws for p in parts(t)))
