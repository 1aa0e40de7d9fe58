"""Personal data by patterns, and information-theoretic sanitisation of what gives it away; DataFrame functions only.

Patterns find e-mail addresses, IP addresses, card numbers and phone numbers with their places in code points. All other
words of a text (letters and digits, two at least, a letter among them) are candidates for disclosure: over the whole corpus, the documents that
hold a term and those that hold it together with a protected value give the share of the term's documents that the value
is in and their pointwise mutual information. A term that is met in MIN_SEEN documents of a value at least, with a share of
MIN_SHARE and MIN_BITS bits at least, lets a reader infer the value, so it becomes a span wherever it stands, in documents
without the value too. A document is a row: copies count, as they show the term with the value as often.
redact() generalises all spans: each is replaced by the name of its kind.

Nulls: a null text is empty and has no spans; a null doc_id is kept. Rows that share a doc_id are judged one by one; equal
rows get equal results. An empty table gives no rows. Other columns are kept by redact() and ignored by find()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store, text_or_empty
from .syncmers import NONE, _let

#: Fixed values, in the order in which kinds are listed. The lookbehind and \\G keep to places where a match can begin; the
#: possessive repeats match what the plain ones match, without a step back.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:(?<![0-9])|\G)[0-9]++(?:[\x20-][0-9]++)*+(?<=[0-9][\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that a text which has a match passes.
GUARDS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9][\x20().0-9-]"}
#: Words with a letter among them, two characters at least.
TERM = r"(?U)(?=[\p{N}\p{M}]*\p{L})[\p{L}\p{M}\p{N}]{2,}+"
MIN_SEEN, MIN_SHARE, MIN_BITS = 3, 0.5, 4.0
PLACES = "array<struct<start:int,end:int>>"
SPAN = "array<struct<start:int,order:int,end:int,value:string>>"


def _found(text: Column, pattern: str, order: int) -> Column:
    """start, order, end, value of each match: texts between the matches and the matches add up to the places."""

    def spans(between: Column, matches: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

        def add(state: Column, i: Column) -> Column:
            at = state["at"] + F.length(F.get(between, i))
            end = at + F.length(F.get(matches, i))
            one = F.struct(at.alias("start"), F.lit(order).alias("order"), end.alias("end"), F.get(matches, i).alias("value"))
            return F.struct(end.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

        places = F.filter(F.sequence(F.lit(0), F.size(matches)), lambda i: i < F.size(matches))
        return F.aggregate(places, start, add, lambda state: state["out"])

    return _let(F.split(text, pattern, -1), lambda between: _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda matches: spans(between, matches)))


def _luhn(digits: Column) -> Column:
    total = F.aggregate(F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int"))), F.lit(0), lambda a, b: a + b)
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda x: x.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])$"))
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All valid pattern matches, by start and then kind as listed."""
    none = F.array().cast(SPAN)

    def found(order: int, kind: str) -> Column:
        matches = F.filter(_found(text, PATTERNS[kind], order), lambda s: _valid(kind, s["value"]))
        return F.when(text.rlike(GUARDS[kind]), matches).otherwise(none)

    return F.sort_array(F.concat(*(found(n, k) for n, k in enumerate(KINDS))))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _places(text: Column, terms: Column) -> Column:
    """start and end of each word of text that is among terms."""

    def spans(between: Column, words: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(PLACES).alias("out"))

        def add(state: Column, i: Column) -> Column:
            at = state["at"] + F.length(F.get(between, i))
            end = at + F.length(F.get(words, i))
            hit = F.array_contains(terms, F.lower(F.get(words, i)))
            out = F.when(hit, F.concat(state["out"], F.array(F.struct(at.alias("start"), end.alias("end"))))).otherwise(state["out"])
            return F.struct(end.alias("at"), out.alias("out"))

        places = F.filter(F.sequence(F.lit(0), F.size(words)), lambda i: i < F.size(words))
        return F.aggregate(places, start, add, lambda state: state["out"])

    return _let(F.split(text, TERM, -1), lambda between: _let(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda words: spans(between, words)))


def _documents(docs: DataFrame) -> DataFrame:
    """A stored table: doc_id, digest, spans, and the distinct terms outside them."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("doc_id"), text_or_empty().alias("text"))
    found = rows.select("doc_id", F.xxhash64("text").alias("digest"), "text", base_spans(F.col("text")).alias("spans"))
    outside = F.when(F.size("spans") > 0, _cut(F.col("text"), F.col("spans"), [" "] * len(KINDS))).otherwise(F.col("text"))
    return store(found.select("doc_id", "digest", "spans", _terms(outside).alias("terms")), "personal")


def disclosing(docs: DataFrame, documents: DataFrame) -> DataFrame:
    """value and term of every pair whose share and mutual information exceed the thresholds."""
    holds = documents.where(F.size("spans") > 0).select("terms", F.explode(F.array_distinct(F.col("spans.value"))).alias("value"))
    # fewer documents than MIN_SEEN can't give that many together
    values = store(holds.groupBy("value").agg(F.count("*").alias("n_value")).where(F.col("n_value") >= MIN_SEEN), "values")
    met = holds.join(values, "value", "left_semi").select("value", F.explode("terms").alias("term"))
    pairs = store(met.groupBy("value", "term").agg(F.count("*").alias("together")).where(F.col("together") >= MIN_SEEN), "pairs")
    counts = documents.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_term")).where(F.col("n_term") >= MIN_SEEN)
    total = documents.count()
    rated = pairs.join(counts, "term").join(values, "value")
    share = F.col("together") / F.col("n_term")
    bits = F.log2(F.col("together") * F.lit(float(total)) / (F.col("n_term").cast("double") * F.col("n_value")))
    return rated.where((share >= MIN_SHARE) & (bits >= MIN_BITS)).select("value", "term")


def _all_spans(docs: DataFrame) -> DataFrame:
    """doc_id (null as NONE), digest, spans, added (start, end) of every row."""
    documents = _documents(docs)
    terms = store(disclosing(docs, documents).select("term").distinct(), "disclosing")
    met = documents.select("doc_id", "digest", F.explode("terms").alias("term")).join(terms, "term")
    hits = met.groupBy("doc_id", "digest").agg(F.collect_set("term").alias("hits"))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("doc_id"), F.xxhash64(text_or_empty()).alias("digest"), text_or_empty().alias("text"))
    marked = texts.join(hits, ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"]).select("doc_id", "digest", _places(F.col("text"), F.col("hits")).alias("places"))
    clear = F.filter("places", lambda t: ~F.exists("spans", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    joined = documents.select("doc_id", "digest", "spans").join(marked, ["doc_id", "digest"], "left")
    return joined.select("doc_id", "digest", "spans", F.coalesce(clear, F.array().cast(PLACES)).alias("added"))


def _listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in (*KINDS, "term")))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["order"]), s["start"], s["end"])), ",")


def _merged(spans: Column, added: Column) -> Column:
    kept = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end")))
    more = F.transform(added, lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("order"), s["end"].alias("end")))
    return F.sort_array(F.concat(kept, more))


def find(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end, the method's own of kind term), n_term."""
    rows = _all_spans(docs)
    count = lambda n: F.size(F.filter("spans", lambda s: s["order"] == n)).cast("long")
    counts = [count(n).alias(f"n_{k}") for n, k in enumerate(KINDS)]
    return rows.select(F.when(F.col("doc_id") != NONE, F.col("doc_id")).alias("doc_id"), *counts, F.sha2(_listed(F.col("spans")), 256).alias("base_sha256"), _listed(_merged(F.col("spans"), F.col("added"))).alias("spans"), F.size("added").cast("long").alias("n_term"))


def _cut(text: Column, spans: Column, names: list[str]) -> Column:
    """text with every span replaced by its kind's name; of spans that overlap the first names the place."""
    names = F.array(*(F.lit(k) for k in names))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def add(state: Column, s: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        name = F.when(s["start"] >= state["at"], F.get(names, s["order"])).otherwise("")
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], F.array(F.concat(gap, name))).alias("out"))

    return F.aggregate(spans, start, add, lambda state: F.concat(F.array_join(state["out"], ""), F.substring(text, state["at"] + 1, F.length(text))))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced; n_chars, where there is such a column, follows."""
    spans = _all_spans(docs).where((F.size("spans") > 0) | (F.size("added") > 0)).dropDuplicates(["doc_id", "digest"])
    spans = spans.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), _merged(F.col("spans"), F.col("added")).alias("__spans"))
    keyed = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)), "__digest": F.xxhash64(text_or_empty())})
    joined = keyed.join(spans, ["__id", "__digest"], "left")
    text = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(_cut(F.col("text"), F.col("__spans"), [f"<{k.upper()}>" for k in (*KINDS, "term")]))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
