"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text is cut at white space and after every a, o, u, 0, 5 and every character outside ASCII. Where a cut lies so depends on
the characters there and not on a count from a word's start, in text without blanks too (a longer run of other characters is
cut by count, up to the next of these). Of the runs of K pieces (K - 1 marks stand before the first piece, so short texts have
runs too) those are anchors whose smallest inner run of S pieces, by hash, lies at an edge: about two in five.
Whether a run is an anchor depends on the run alone, so texts that share a passage share its
anchors wherever it stands: anchors() gives them with their positions for positional matching. A fingerprint keeps the
KEEP smallest of a text's distinct anchor hashes, and likeness estimates the Jaccard similarity of the anchor sets from
two fingerprints.

Nulls: a null text is an empty text; texts without a visible character have an empty fingerprint, and two such are alike.
A null doc_id comes before all others. Where rows share a doc_id, the next document is the one with the smallest text (for the
edit) or smallest fingerprint (for the likeness) of the next larger id. A table with one id has itself for its next. An
empty table gives no rows. Other columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store, text_or_empty

#: Pieces of a run and of an inner run, hashes of a fingerprint.
K, S, KEEP = 6, 2, 64
#: Visible ASCII characters that don't end a piece, and a piece: up to six of them and one more character.
OTHERS = r"[!-/1-46-9:-@B-NP-TV-Z\[-`b-np-tv-z{-~]"
PIECES = rf"(?U){OTHERS}{{1,6}}+\S?|\S"
#: Stands for a null doc_id inside.
NONE = -(1 << 63)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _inner(text: Column) -> Column:
    """Hashes of the text's runs of S pieces, the marks before it included."""
    pieces = F.transform(F.regexp_extract_all(text, F.lit(PIECES), F.lit(0)), lambda x: F.hash(x))
    marked = F.when(F.size(pieces) > 0, F.concat(F.array([F.lit(0)] * (K - 1)), pieces)).otherwise(F.array().cast("array<int>"))
    return _let(marked, lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - (S - 1), F.lit(0))), lambda x, i: F.hash(x, F.get(w, i + 1))))


def _runs(inner: Column) -> Column:
    """For each run of K pieces its 64-bit hash if it is a closed syncmer, else null. It has K - S + 1 = 5 inner runs."""

    def body(s):
        last = K - S
        return F.transform(F.slice(s, 1, F.greatest(F.size(s) - last, F.lit(0))), lambda x, i: F.when(F.least(x, F.get(s, i + last)) <= F.least(*(F.get(s, i + k) for k in range(1, last))), F.xxhash64(x, F.get(s, i + S), F.get(s, i + last))))

    return _let(inner, body)


def sketch(text: Column) -> Column:
    """The fingerprint as an array of longs in ascending order."""
    return F.slice(F.sort_array(F.array_distinct(F.array_compact(_runs(_inner(text))))), 1, KEEP)


def anchors(docs: DataFrame) -> DataFrame:
    """doc_id, position (of the run's last piece, from 0) and hash of every anchor."""
    runs = docs.select("doc_id", F.posexplode(_runs(_inner(text_or_empty()))).alias("position", "hash"))
    return runs.where(F.col("hash").isNotNull())


def written(sketched: Column) -> Column:
    """A fingerprint as text: sixteen hexadecimal digits for each hash."""
    return F.array_join(F.transform(sketched, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two texts' anchors, from their fingerprints."""
    joint = F.slice(F.sort_array(F.array_union(a, b)), 1, KEEP)
    return F.when(F.size(joint) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(a, b), joint)) / F.size(joint))


def following(ids: DataFrame) -> DataFrame:
    """ids: distinct doc_id and other columns. Adds next_id, the next larger one; after the last comes the first.

    Ids are dealt by range, the order inside a range is a window's, and only one row for each range is ordered in one place."""
    held = store(ids.repartitionByRange("doc_id").withColumn("range", F.spark_partition_id()), "ids")
    first = held.groupBy("range").agg(F.min("doc_id").alias("first"))
    order = Window.orderBy("range")
    after = first.select("range", F.coalesce(F.lead("first").over(order), F.min("first").over(Window.partitionBy(F.lit(0)))).alias("after"))
    inside = held.withColumn("lead", F.lead("doc_id").over(Window.partitionBy("range").orderBy("doc_id")))
    return inside.join(F.broadcast(after) if held.rdd.getNumPartitions() < 100_000 else after, "range").withColumn("next_id", F.coalesce("lead", "after")).drop("range", "lead", "after")


def compare_edited(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint, that of its text with the last quarter replaced by the next document's first characters, and its likeness to both."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("doc_id"), text_or_empty().alias("text"))
    quarter = F.floor(F.length("text") / 4).cast("int")
    chain = store(following(rows.groupBy("doc_id").agg(F.max(quarter).alias("need"))), "chain")
    given = chain.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("to_id"), "need")
    heads = rows.join(given, "doc_id").select("to_id", F.substring("text", F.lit(1), F.col("need")).alias("head")).groupBy("to_id").agg(F.min("head").alias("head"))
    joined = rows.join(heads.withColumnRenamed("to_id", "doc_id"), "doc_id")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - quarter), F.substring("head", F.lit(1), quarter))
    made = joined.select("doc_id", "text", edited.alias("edited"))
    both = store(made.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited"), 256).alias("edited_sha256"), sketch(F.col("text")).alias("own"), sketch(F.col("edited")).alias("changed")), "sketches")
    ahead = both.groupBy("doc_id").agg(F.min("own").alias("next")).join(given.select("doc_id", "to_id"), "doc_id").select(F.col("to_id").alias("doc_id"), "next")
    out = both.join(ahead, "doc_id")
    return out.select(F.when(F.col("doc_id") != NONE, F.col("doc_id")).alias("doc_id"), "n_chars", "edited_sha256", written(F.col("own")).alias("fingerprint"), written(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"))
