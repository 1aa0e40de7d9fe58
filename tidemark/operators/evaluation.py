"""Ranking and calibration metrics, folds and feature transforms, as aggregates and windows that any group key can carry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import clip, div
from .order import held, quantile, quantiles
from .panel import small


def _w(by: list[str]):
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))


def _grouped(table: DataFrame, by: list[str], *aggregates: Column) -> DataFrame:
    return table.groupBy(*by).agg(*aggregates)


def score_table(scored: DataFrame, by: list[str], score: str = "p", label: str = "y") -> DataFrame:
    """Per group and distinct score: how many rows and positives. What follows works on this table, whose size is that of
    the distinct scores, so a group of any size is first reduced on the map side."""
    return scored.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, F.col(score).alias("p")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("t"))


def auc(scored: DataFrame, by: list[str], score: str = "p", label: str = "y") -> DataFrame:
    """Area under the ROC curve by tied ranks; 0.5 where a class is missing."""
    table = score_table(scored, by, score, label)
    before = _w(by).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    ranked = table.withColumn("rank", F.coalesce(F.sum("n").over(before), F.lit(0)) + (F.col("n") + 1) / 2)
    sums = _grouped(ranked, by, F.sum(F.col("rank") * F.col("t")).alias("r"), F.sum("t").cast("double").alias("pos"), F.sum(F.col("n") - F.col("t")).cast("double").alias("neg"))
    value = F.coalesce(div(F.col("r") - F.col("pos") * (F.col("pos") + 1) / 2, F.col("pos") * F.col("neg")), F.lit(0.5))
    return sums.select(*by, value.alias("auc"))


def average_precision(scored: DataFrame, by: list[str], score: str = "p", label: str = "y") -> DataFrame:
    """Sum over distinct scores, from the highest, of the step in recall times the precision there."""
    table = score_table(scored, by, score, label)
    down = _w(by).orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    run = table.withColumns({"tp": F.sum("t").over(down), "seen": F.sum("n").over(down)})
    out = _grouped(run, by, F.sum(F.col("t") * F.col("tp") / F.col("seen")).alias("s"), F.sum("t").alias("pos"))
    return out.select(*by, div("s", "pos").alias("average_precision"))


def losses(scored: DataFrame, by: list[str], score: str = "p", label: str = "y", threshold: float = 0.5) -> DataFrame:
    """Log loss (clipped), Brier score, hit rate at a threshold."""
    p = F.least(F.greatest(F.col(score), F.lit(1e-15)), F.lit(1 - 1e-15))
    y = F.col(label)
    return _grouped(scored, by, F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"), F.avg((F.col(score) - y) * (F.col(score) - y)).alias("brier"), F.avg((y == (F.col(score) >= threshold).cast("int")).cast("double")).alias("hit_rate"))


def tail_precision(scored: DataFrame, by: list[str], key: str, share: float = 0.1, score: str = "p", label: str = "y") -> DataFrame:
    """Mean label of the top and the bottom share of rows by score, and their difference; rows of one score go by key, those of one key by label.

    Rows are first counted a score and key, so what is put in order is as long as there are of these; only the rows of the one score and key that a share
    ends in are looked at again."""
    group, value = [*by, "__p", "__key"], F.col(label).cast("double")
    rows = scored.select(*by, F.col(score).alias("__p"), F.col(key).alias("__key"), value.alias("__y"))
    cells = rows.groupBy(*group).agg(F.count("*").alias("__n"), F.count("__y").alias("__m"), F.sum("__y").alias("__s"))
    size = F.greatest(F.lit(1), F.floor(F.sum("__n").over(_w(by)) * share))
    before = lambda first: F.coalesce(F.sum("__n").over(_w(by).orderBy(first, "__key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = {f"__{side}": F.greatest(F.least(size - before(first), F.col("__n")), F.lit(0)) for side, first in (("u", F.desc("__p")), ("d", F.asc("__p")))}
    cells = cells.withColumns(taken)
    ends = cells.where("(__u > 0 and __u < __n) or (__d > 0 and __d < __n)").select(*(F.col(c).alias(f"__e_{c}") for c in group), "__n", "__u", "__d")
    inside = Window.partitionBy(*group).orderBy("__y")
    met = rows.join(ends, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__e_{c}")) for c in group])).withColumn("__i", F.row_number().over(inside))
    part = lambda side: (F.col("__i") <= F.col(f"__{side}")) & (F.col(f"__{side}") < F.col("__n"))
    whole = cells.select(*by, *(F.when(F.col(f"__{k}") == F.col("__n"), F.col(f"__{c}")).alias(f"__{c}{k}") for k in "ud" for c in "sm"))
    some = met.select(*by, *(F.when(part(k), F.col("__y") if c == "s" else F.col("__y").isNotNull().cast("long")).alias(f"__{c}{k}") for k in "ud" for c in "sm"))
    out = _grouped(whole.unionByName(some), by, *(F.try_divide(F.sum(f"__s{k}"), F.sum(f"__m{k}")).alias(name) for k, name in (("u", "top"), ("d", "bottom"))))
    return out.withColumn("spread", F.col("top") - F.col("bottom"))


def reliability(scored: DataFrame, by: list[str], bins: int = 10, score: str = "p", label: str = "y") -> DataFrame:
    """Per equal-width bin: rows, mean score, mean label."""
    bin_ = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return scored.groupBy(*by, bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_p"), F.avg(F.col(label).cast("double")).alias("mean_y"))


def calibration_error(scored: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Expected and largest calibration error."""
    table = reliability(scored, by, bins)
    gap = F.abs(F.col("mean_p") - F.col("mean_y"))
    return _grouped(table, by, (F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def rank_correlation(table: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Spearman correlation with ties at their mean rank."""
    mean_rank = lambda x: F.rank().over(_w(by).orderBy(x)) + (F.count("*").over(Window.partitionBy(*by, x)) - 1) / 2
    ranked = table.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumns({"__a": mean_rank(a), "__b": mean_rank(b)})
    out = _grouped(ranked, by, F.covar_pop("__a", "__b").alias("c"), F.stddev_pop("__a").alias("s"), F.stddev_pop("__b").alias("t"))
    return out.select(*by, div("c", F.col("s") * F.col("t")).alias("ic"))


def numbered(rows: DataFrame, date: str, tie: str, name: str = "__i") -> DataFrame:
    """rows with their place in the order of date and tie, from 0. Only a table of one row a date is ordered in one task."""
    each = rows.groupBy(date).agg(F.count("*").alias("__n"))
    offset = each.select(F.col(date).alias("__d"), (F.sum("__n").over(Window.orderBy(date)) - F.col("__n")).alias("__o"))
    inside = F.row_number().over(Window.partitionBy(date).orderBy(tie)) - 1
    return rows.withColumn("__p", inside).join(small(offset), F.col(date) == F.col("__d")).withColumn(name, F.col("__o") + F.col("__p")).drop("__p", "__d", "__o")


def walk_forward(rows: DataFrame, train: int, test: int, gap_weeks: int = 0) -> DataFrame:
    """fold, role and row of weekly folds: at least train weeks before, test weeks of test, and training rows whose exit lies before
    the test begins. The folds of a row follow from its week by arithmetic, so only rows of the result are made."""
    weeks = rows.select(F.date_trunc("week", "entry").cast("date").alias("week")).distinct()
    placed = weeks.withColumn("w", F.row_number().over(Window.orderBy("week")) - 1)
    folds = placed.where((F.col("w") >= train) & ((F.col("w") - train) % test == 0)).select(((F.col("w") - train) / test).cast("int").alias("fold"), F.col("week").alias("starts"))
    # one row: when each fold's test begins
    starts = folds.agg(F.transform(F.sort_array(F.collect_list(F.struct("fold", "starts"))), lambda x: x["starts"]).alias("__starts"))
    tagged = rows.withColumn("week", F.date_trunc("week", "entry").cast("date")).join(small(placed), "week").join(F.broadcast(starts))
    mine = F.floor((F.col("w") - train) / test).cast("int")
    test_rows = tagged.where((F.col("w") >= train) & (mine < F.size("__starts"))).withColumns({"fold": mine, "role": F.lit("test")})
    first = F.greatest(F.ceil((F.col("w") + gap_weeks + 1 - train) / test), F.lit(0)).cast("int")
    after = F.filter(F.sequence(first, F.size("__starts") - 1), lambda f: F.get(F.col("__starts"), f) > F.col("exit"))
    train_rows = tagged.where(first < F.size("__starts")).withColumn("fold", F.explode(after)).withColumn("role", F.lit("train"))
    return train_rows.unionByName(test_rows).withColumn("starts", F.get("__starts", F.col("fold"))).drop("w", "__starts")


def fold_summary(folds: DataFrame) -> DataFrame:
    return folds.groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("entry").alias("first_entry"), F.max("entry").alias("last_entry"), F.max("exit").alias("last_exit"))


def leaks(folds: DataFrame) -> DataFrame:
    """Per fold: does a training exit reach the first test entry."""
    return folds.groupBy("fold").agg(F.max(F.when(F.col("role") == "train", F.col("exit"))).alias("train_exit"), F.min(F.when(F.col("role") == "test", F.col("entry"))).alias("test_entry")).withColumn("leak", F.coalesce(F.col("train_exit") >= F.col("test_entry"), F.lit(False)))


def purged_kfold(rows: DataFrame, k: int, embargo: float = 0.01) -> DataFrame:
    """fold and role of k blocks in time order; training rows that touch a block's span or follow it within the embargo are out."""
    rows = held(rows)
    n = rows.count()
    placed = numbered(rows, "entry", "symbol").withColumn("__f", F.least(F.floor(F.col("__i") * k / F.lit(max(n, 1))), F.lit(k - 1)).cast("int"))
    spans = placed.groupBy(F.col("__f").alias("fold")).agg(F.min("entry").alias("lo"), F.max("exit").alias("hi"), F.max("__i").alias("last"))
    # k rows
    met = placed.join(F.broadcast(spans))
    clear = (F.col("exit") < F.col("lo")) | ((F.col("entry") > F.col("hi")) & (F.col("__i") > F.col("last") + int(n * embargo)))
    role = F.when(F.col("__f") == F.col("fold"), "test").when(clear, "train")
    return met.withColumn("role", role).where("role is not null").drop("__i", "__f", "lo", "hi", "last")


def standardise(rows: DataFrame, columns: list[str], bound: float = 3.0) -> DataFrame:
    """z-scores by mean and sample deviation, clipped; null where the column is, or where it is constant."""
    fit = rows.agg(*(F.avg(c).alias(f"__m_{c}") for c in columns), *(F.stddev_samp(c).alias(f"__s_{c}") for c in columns))
    z = {f"{c}_z": clip(div(F.col(c) - F.col(f"__m_{c}"), f"__s_{c}"), -bound, bound) for c in columns}
    return rows.join(F.broadcast(fit)).withColumns(z).drop(*fit.columns)


def winsorise(rows: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """{column}_w: within its own exact percentiles; null stays null."""
    cuts = quantiles(rows, {c: [low, high] for c in columns})
    return rows.withColumns({f"{c}_w": F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(cuts[c][0])), F.lit(cuts[c][1]))) for c in columns})


def correlation_pairs(rows: DataFrame, columns: list[str]) -> DataFrame:
    """a, b and the correlation of every pair of columns, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    both = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(a))
    one = lambda a, b: div(F.covar_pop(both(a, b), both(b, a)), F.stddev_pop(both(a, b)) * F.stddev_pop(both(b, a)))
    out = rows.agg(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), one(a, b).alias("corr")) for a, b in pairs)).alias("p"))
    return out.select(F.inline("p"))


def drop_correlated(rows: DataFrame, columns: list[str], most: float = 0.95) -> list[str]:
    """Columns kept when, in order, each that correlates too much with a kept one is left out; the small matrix is walked on the driver."""
    tied = {(r["a"], r["b"]) for r in correlation_pairs(rows, columns).where(F.abs("corr") > most).collect()}
    kept: list[str] = []
    for c in columns:
        if not any((k, c) in tied for k in kept):
            kept.append(c)
    return kept


def mutual_information(rows: DataFrame, features: list[str], label: str, bins: int = 10) -> DataFrame:
    """Per feature: mutual information, in nats, of its equal-width bins with the label."""
    fit = rows.agg(*(F.min(c).alias(f"__l_{c}") for c in features), *(F.max(c).alias(f"__h_{c}") for c in features))
    met = rows.join(F.broadcast(fit))
    binned = [F.least(F.floor(div(F.col(c) - F.col(f"__l_{c}"), F.col(f"__h_{c}") - F.col(f"__l_{c}")) * bins), F.lit(bins - 1)).cast("int").alias(c) for c in features]
    long = met.select(F.col(label).alias("y"), *binned).unpivot(["y"], features, "feature", "bin").where("bin is not null and y is not null")
    cells = long.groupBy("feature", "bin", "y").agg(F.count("*").alias("n"))
    f = Window.partitionBy("feature")
    parts = cells.withColumns({"nx": F.sum("n").over(Window.partitionBy("feature", "bin")), "ny": F.sum("n").over(Window.partitionBy("feature", "y")), "nn": F.sum("n").over(f)})
    return parts.groupBy("feature").agg(F.sum(F.col("n") / F.col("nn") * F.log(F.col("n") * F.col("nn") / (F.col("nx") * F.col("ny")))).alias("mi"))


#: Distinct p-values that a bucket of the adjustment holds, about.
BUCKET = 50_000


def benjamini_hochberg(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """tests (feature, p): adjusted p-values and which are found at alpha. Tests without a p count and are not found.

    Tied tests share their value, so ranks and minima are of distinct p-values. These are cut into buckets along a sketch; a bucket takes the rank before
    it and the least value behind it from a table of one row a bucket, so no task orders or scans all tests."""
    cells = tests.where(F.col("p").isNotNull()).groupBy("p").agg(F.count("*").alias("__c"))
    n, known, distinct = tests.agg(F.count("*"), F.count("p"), F.approx_count_distinct("p")).first()
    buckets = min(1 + distinct // BUCKET, 1_000)
    cuts = tests.agg(F.percentile_approx(F.col("p").cast("double"), [k / buckets for k in range(1, buckets)], 10_000)).first()[0] if buckets > 1 and known else []
    marks = F.array(*(F.lit(float(c)) for c in sorted(set(cuts)))) if cuts else None
    cells = cells.withColumn("__b", F.lit(0) if marks is None else F.size(F.filter(marks, lambda c: c < F.col("p"))))
    inside = Window.partitionBy("__b").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    sizes = cells.groupBy("__b").agg(F.sum("__c").alias("__m"))
    before = sizes.select("__b", (F.sum("__m").over(Window.orderBy("__b")) - F.col("__m")).alias("__o"))
    ranked = cells.join(F.broadcast(before), "__b").withColumn("__raw", F.col("p") * n / (F.col("__o") + F.sum("__c").over(inside)))
    least = ranked.groupBy("__b").agg(F.min("__raw").alias("__least"))
    down = Window.orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    behind = least.select("__b", F.min("__least").over(down).alias("__behind"))
    up = Window.partitionBy("__b").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    values = ranked.join(F.broadcast(behind), "__b").select(F.col("p").alias("__p"), F.least(F.min("__raw").over(up), F.col("__behind"), F.lit(1.0)).alias("q"))
    out = tests.join(values, F.col("p") == F.col("__p"), "left").drop("__p").withColumn("q", F.coalesce("q", F.lit(1.0)))
    return out.withColumn("found", F.col("q") <= alpha)


def purge_mask(rows: DataFrame, test_start, test_end, embargo_days: int = 0) -> DataFrame:
    """purged: the span [entry, exit] touches the test span; embargoed: it begins within embargo_days after it."""
    a, b = F.lit(test_start).cast("date"), F.lit(test_end).cast("date")
    return rows.withColumns({"purged": (F.col("entry") <= b) & (F.col("exit") >= a), "embargoed": (F.col("entry") > b) & (F.col("entry") <= F.date_add(b, embargo_days))})


def date_split(rows: DataFrame, share: float = 0.8, date: str = "entry") -> DataFrame:
    """role: train up to the date below which share of the rows lie, else test."""
    cut = quantile(rows.select(F.unix_date(date).alias("d")), "d", share)
    return rows.withColumn("role", F.when(F.unix_date(date) <= F.lit(cut), "train").otherwise("test"))


def time_folds(rows: DataFrame, k: int, label: str = "hit", date: str = "entry") -> DataFrame:
    """Per fold of equally many rows in time order (the first ones take what is left over): rows, positives, prevalence."""
    rows = held(rows)
    n = rows.count()
    size, more = divmod(n, k)
    i = F.col("__i")
    fold = F.when(i < more * (size + 1), F.floor(i / (size + 1))).otherwise(more + F.floor((i - more * (size + 1)) / max(size, 1))).cast("int")
    placed = numbered(rows, date, "symbol").withColumn("fold", fold)
    return placed.groupBy("fold").agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("n_positive")).withColumn("prevalence", F.col("n_positive") / F.col("n"))


def rolling_auc(scored: DataFrame, dates: int = 63, least: int = 100, score: str = "p", label: str = "y") -> DataFrame:
    """For each date the AUC over the rows of the last dates distinct dates, where there are more than least rows and both classes.
    Every row goes to the windows that hold it, at most dates of them."""
    days = scored.select("date").distinct().withColumn("k", F.row_number().over(Window.orderBy("date")))
    placed = scored.join(F.broadcast(days), "date")
    last = days.agg(F.max("k").alias("last"))
    spread = placed.join(F.broadcast(last)).select(F.explode(F.sequence(F.col("k"), F.least(F.col("k") + dates - 1, F.col("last")))).alias("k"), F.col(score).alias("p"), F.col(label).alias("y"))
    sizes = spread.groupBy("k").agg(F.count("*").alias("n"), F.sum("y").alias("t")).where((F.col("n") > least) & (F.col("t") > 0) & (F.col("t") < F.col("n")))
    return auc(spread, ["k"]).join(sizes, "k").join(F.broadcast(days), "k").select("date", "n", "auc")


def by_regime(scored: DataFrame, regime: str, metric=auc, least: int = 10, **options) -> DataFrame:
    """metric of the rows of each regime that has more than least of them."""
    sizes = scored.where(F.col(regime).isNotNull()).groupBy(regime).agg(F.count("*").alias("__n")).where(F.col("__n") > least)
    # a regime is a category, so few rows
    return metric(scored.join(sizes.select(regime), regime, "left_semi"), [regime], **options).join(sizes.withColumnRenamed("__n", "n"), regime)


def fold_info(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Per fold of rows (entry, exit): first and last entry of training and test, n_train_original (rows that enter before the test's first), n_train, n_purged
    (the difference), n_test, has_leakage (a training exit reaches the first test entry). Rows before each day come from one running count by day."""
    at = lambda role, f: f(F.when(F.col("role") == role, F.col("entry")))
    parts = folds.groupBy("fold").agg(at("train", F.min).alias("train_start"), at("train", F.max).alias("train_end"), at("test", F.min).alias("test_start"), at("test", F.max).alias("test_end"), F.count(F.when(F.col("role") == "train", 1)).alias("n_train"), F.count(F.when(F.col("role") == "test", 1)).alias("n_test"), F.max(F.when(F.col("role") == "train", F.col("exit"))).alias("__exit"))
    # one row a day, and one a fold
    daily = rows.groupBy(F.col("entry").alias("__t")).agg(F.count("*").alias("__c"))
    events = daily.select("__t", "__c", F.lit(None).cast(parts.schema["fold"].dataType).alias("fold")).unionByName(parts.where("test_start is not null").select(F.col("test_start").alias("__t"), F.lit(0).cast("long").alias("__c"), "fold"))
    before = F.sum("__c").over(Window.orderBy("__t").rangeBetween(Window.unboundedPreceding, 0)) - F.sum("__c").over(Window.partitionBy("__t"))
    earlier = events.withColumn("n_train_original", before).where("fold is not null").select("fold", "n_train_original")
    out = parts.join(earlier, "fold", "left").withColumns({"n_purged": F.col("n_train_original") - F.col("n_train"), "has_leakage": F.coalesce(F.col("__exit") >= F.col("test_start"), F.lit(False))})
    return out.select("fold", "train_start", "train_end", "test_start", "test_end", "n_train_original", "n_train", "n_purged", "n_test", "has_leakage")
