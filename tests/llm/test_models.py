"""Operators that learn or estimate, and the native ones: brute force where there is one, else held-out accuracy and planted cases."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def docs(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(10_001, ""), (10_002, None), (10_003, " "), (10_004, "ab"), (None, "a text without an id")], "doc_id long, text string")
    return table.unionAll(more).withColumn("pos", F.lit("x")).cache()


def test_likelihood(docs):
    from tidemark.llm import likelihood as lk

    rows = {r.doc_id: r for r in lk.score(docs).collect()}
    assert len(rows) == docs.count()
    assert rows[10_002].log_likelihood == 0 and rows[10_002].mean_log_probability is None
    assert all(r.log_likelihood < 0 for r in rows.values() if r.n_words)
    assert lk.score(docs.limit(0)).count() == 0


def test_likelihood_learns_and_normalises(docs):
    import pyarrow as pa

    from tidemark.llm import likelihood as lk

    w = lk.fresh()
    around = np.random.default_rng(0).integers(0, lk.SIZE, (1, 4))
    every = lk.log_probability(w, np.repeat(around, lk.SIZE, axis=0), np.arange(lk.SIZE))
    assert abs(np.exp(every).sum() - 1) < 1e-4
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = lk.vocabulary(rows)
    read = lk.Reader(known)(pa.array([r.text for r in rows.collect()]))
    trained = lk.train(rows, known)
    assert lk.log_probability(trained, *read[:2]).mean() > lk.log_probability(w, *read[:2]).mean() + 0.5


def test_likelihood_learns_words_at_every_place(spark):
    import pyarrow as pa

    from tidemark.llm import likelihood as lk

    # a word that stands at one place of four only, in turn at each of them
    for place in range(4):
        lines = [" ".join("zorblatt" if k % 4 == place else f"plain{k % 4}" for k in range(400))] * 40
        rows = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id long, text string")
        known = lk.vocabulary(rows)
        around, own, _ = lk.Reader(known)(pa.array(lines[:1]))
        at = own == known[b"zorblatt"]
        before, after = (lk.log_probability(w, around[at], own[at]).mean() for w in (lk.fresh(), lk.train(rows, known)))
        assert after > before + 2, place


def test_likelihood_vocabulary_grows(spark):
    from tidemark.llm import likelihood as lk

    # 2,000 words of 10 each: more than any fixed table of 768
    lines = [(k, " ".join(f"w{(k * 20 + i) % 2000}x" for i in range(20))) for k in range(1000)]
    known = lk.vocabulary(spark.createDataFrame(lines, "doc_id long, text string"))
    assert len(known) == 2000
    reader = lk.Reader(known)
    assert reader.size > 2000 and set(known.values()) == set(range(2000))


def test_likelihood_tells_apart_words_that_share_an_id(spark):
    from tidemark.llm import likelihood as lk

    # four words of one ending below the threshold: one is met three times, the others once
    rows = [(k, "plain words here " * 20) for k in range(50)] + [(100 + k, f"plain {w}ending here") for k, w in enumerate(["aa", "aa", "aa", "bb", "cc", "dd"])]
    got = {r.doc_id: r for r in lk.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == 56 and all(got[k].n_words == 3 for k in range(100, 106))
    assert abs(got[100].log_likelihood - got[103].log_likelihood - np.log(3)) < 1e-4
    assert abs(got[103].log_likelihood - got[105].log_likelihood) < 1e-4


def test_syncmers(docs):
    from tidemark.llm import syncmers as sy

    rows = {r.doc_id: r for r in sy.compare_edited(docs).collect()}
    ordered = sorted(((-1 if r.doc_id is None else r.doc_id), r.text or "") for r in docs.collect())
    same = {}
    for k, (d, t) in enumerate(ordered):
        r, after, cut = rows[None if d == -1 else d], ordered[(k + 1) % len(ordered)][1], len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert same.setdefault(t, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    full = [r for r in rows.values() if r.n_chars > 100]
    assert np.mean([r.near_edited for r in full]) > 0.5 > 0.05 > np.mean([r.near_next for r in full])
    assert sy.compare_edited(docs.limit(0)).count() == 0


def test_syncmers_are_context_free(spark):
    from tidemark.llm import syncmers as sy

    words = " ".join(f"word{i}" for i in range(60))
    rows = sy.anchors(spark.createDataFrame([(1, words), (2, "some other words before it " + words)], "doc_id long, text string")).collect()
    a, b = ({r["hash"] for r in rows if r.doc_id == d and r.position >= sy.K - 1} for d in (1, 2))
    assert a and a <= b


def test_syncmers_by_brute_force(spark):
    """The anchors are the runs whose smallest inner run lies at an edge, pieces cut by plain rules."""
    from pyspark.sql import functions as F

    from tidemark.llm import syncmers as sy

    def cut(text):
        made, piece = [], ""
        for c in text + " ":
            if c.isspace():
                made, piece = made + [piece], ""
            elif c in "AOUaou05" or c > "~" or len(piece) == 6:
                made, piece = [*made, piece + c], ""
            else:
                piece += c
        return [p for p in made if p]

    texts = ["", "a", "  \t", "strengths of rhythms", "brrrrrrrrrrrra!", "naïve Ünïcode", "漢字かな交じり文です" * 5, "one two three four five six seven eight 1234567890 " * 4]
    random.seed(9)
    texts += ["".join(random.choice("abcdefgh 0123é漢") for _ in range(300)) for _ in range(10)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found: dict = {}
    for r in sy.anchors(table).collect():
        found.setdefault(r.doc_id, set()).add(r.position)
    for k, text in enumerate(texts):
        pieces = cut(text)
        if not pieces:
            assert k not in found
            continue
        made = spark.createDataFrame([(i, p) for i, p in enumerate(pieces)], "i int, p string").select("i", F.hash("p").alias("h")).orderBy("i").collect()
        marked = [0] * (sy.K - 1) + [r.h for r in made]
        inner = spark.createDataFrame([(i, *marked[i : i + sy.S]) for i in range(len(marked) - sy.S + 1)], "i int, " + ", ".join(f"h{j} int" for j in range(sy.S)))
        hashes = [r.h for r in inner.select("i", F.hash(*(f"h{j}" for j in range(sy.S))).alias("h")).orderBy("i").collect()]
        wide = sy.K - sy.S + 1
        want = {i for i in range(len(pieces)) if min(hashes[i : i + wide]) in (hashes[i], hashes[i + wide - 1])}
        assert found.get(k, set()) == want, text
        assert 0 in want


def test_syncmers_survive_a_character(spark):
    """One more character at the front or inside leaves most anchors, in text with and without blanks."""
    from tidemark.llm import syncmers as sy

    random.seed(4)
    wide = "".join(chr(random.randrange(0x4E00, 0x9FA5)) for _ in range(600))
    spaced = " ".join("".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(random.randint(2, 9))) for _ in range(200))
    for text in (wide, spaced, spaced.replace(" ", "")):
        table = spark.createDataFrame([(text, "x" + text, text[:300] + text[300] + text[300:])], "a string, b string, c string")
        own = table.select(*(sy.sketch(table[c]).alias(c) for c in "abc"))
        for got in own.select(sy.likeness(own.a, own.b), sy.likeness(own.a, own.c)).first():
            assert got >= 0.8


PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def test_pii_patterns(spark, docs):
    from tidemark.llm import pii

    random.seed(3)
    parts = ["a", "b@", "c.d", "@", "1", "12", ".", "255.", "300.", " ", "-", "+", "(4) ", "4111111111111111", "\n", "é", "x@y.z", "%", "😀"]
    odd = [(20_000 + i, "".join(random.choice(parts) for _ in range(random.randint(0, 40)))) for i in range(800)]
    odd.append((30_000, "1 " * 20_000 + "9" * 20_000 + "a@" * 5_000))
    table = docs.select("doc_id", "text").unionAll(spark.createDataFrame(odd, "doc_id long, text string"))
    texts = {r.doc_id: r.text or "" for r in table.collect()}
    rows = {r.doc_id: r for r in pii.find(table).collect()}
    assert set(rows) == set(texts)
    for d, t in texts.items():
        want = sorted((m.start(), n, m.end()) for n, (k, p) in enumerate(PATTERNS) for m in re.finditer(p, t) if valid(k, m[0]))
        listed = ",".join(f"{PATTERNS[n][0]}:{a}:{b}" for a, n, b in want)
        r = rows[d]
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), d
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(n == k for _, n, _ in want) for k in range(4)]
    assert pii.find(table.limit(0)).count() == 0


def test_pii_disclosure(spark):
    from tidemark.llm import pii

    rows = [(i, f"line {i} about Zorblatt please write to z@corp.example now {i}\nplain words follow") for i in range(6)]
    rows += [(100 + i, f"please write some plain words now and then {i}") for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    found = {r.doc_id: r for r in pii.find(table).collect()}
    assert all("term:" in found[i].spans and found[i].n_email == 1 for i in range(6))
    assert all(found[100 + i].n_term == 0 for i in range(200))
    clean = {r.doc_id: r for r in pii.redact(table).collect()}
    assert "<EMAIL>" in clean[0].text and "Zorblatt" not in clean[0].text and "<TERM>" in clean[0].text
    assert "please write" in clean[0].text and clean[100].text == rows[6][1]
    assert all(r.n_chars == len(r.text) for r in clean.values())


def test_pii_marks_disclosing_terms_everywhere(spark):
    from tidemark.llm import pii

    rows = [(i, f"Zorblatt\n\nline {i} please write to z@corp.example now") for i in range(6)]
    rows += [(50, "plain words about Zorblatt without the address")]
    rows += [(100 + i, f"please write some plain words now and then {i}") for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.redact(table).collect()}
    assert all("Zorblatt" not in clean[i] and clean[i].startswith("<TERM>") for i in range(6))
    assert clean[50] == "plain words about <TERM> without the address" and clean[100] == rows[7][1]


def test_pii_cooccurrence_over_whole_documents(spark):
    from tidemark.llm import pii

    # a name of two letters and an identifier, lines away; a contact line repeated word for word
    rows = [(i, f"Ng is agent x7\n{'some plain words ' * 20}\nplease write to n@corp.example") for i in range(5)]
    rows += [(10 + i, f"some plain words {i}\ncontact Quimby at q@corp.example please") for i in range(30)]
    rows += [(100 + i, f"please write some plain words is at to {i}") for i in range(600)]
    clean = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("Ng" not in clean[i] and "x7" not in clean[i] and "some plain words" in clean[i] for i in range(5))
    assert all("Quimby" not in clean[10 + i] and "please" in clean[10 + i] for i in range(30))
    assert clean[100] == rows[35][1]


def planted(spark):
    rng = random.Random(8)
    plain = ["the", "river", "runs", "over", "stone", "and", "field", "toward", "a", "quiet", "valley", "under", "stars"]
    bad, signs = ["grumbol", "snarfle", "wretchik"], str.maketrans("aeo", "430")
    rows, marks = [], []
    for i in range(1500):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(3):
                w = rng.choice(bad)
                words.insert(rng.randrange(len(words)), rng.choice([w, w.upper(), w.translate(signs), " ".join(w), w.replace("r", "rrrr")]))
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic), 1))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int, quality int")


def test_toxicity(spark):
    from tidemark.llm import toxicity as tx

    docs, labels = planted(spark)
    rows = tx.score(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (tx.fold(r.doc_id) == 0) for r in rows)
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.97
    assert all((r.score >= 0.5) == (r.predicted == 1) and 0 <= r.score <= 1 for r in rows)
    kept = tx.clean(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if not r.predicted}


def test_toxicity_ignores_held_out_labels(spark):
    from tidemark.llm import toxicity as tx

    docs, labels = planted(spark)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r.doc_id: r.score for r in tx.score(docs, labels).collect()}
    assert a == {r.doc_id: r.score for r in tx.score(docs, flipped).collect()}


def test_toxicity_edges(spark, docs, small):
    from tidemark.llm import toxicity as tx

    labels = spark.read.parquet(f"{small}/labels.parquet")
    rows = tx.score(docs, labels).collect()
    assert len(rows) == docs.count() and all(r.score is not None for r in rows)
    assert all(r.predicted == 0 for r in tx.score(docs, labels.limit(0)).collect())
    assert tx.score(docs.limit(0), labels).count() == 0


def test_letters_set_apart_are_read_whole(spark):
    import pyarrow as pa

    from tidemark.llm import toxicity as tx

    plain = "the quiet river runs over stone and field with a stupid asshole ass shit under stars"
    model = tx.language_model(spark.createDataFrame([(k, plain) for k in range(200)], "doc_id long, text string"))
    terms = lambda s: next(tx.Texts(pa.array([s]), tx.Reader(model)).terms())
    for text, word in (("s h ! t", "shit"), ("a $ $ h o l e", "asshole"), ("$ t u p i d", "stupid"), ("a s s", "ass")):
        assert word in terms(text), text
    # a word across what were cuts at 32 letters and at 64 characters
    long = "thequietriverrunsoverstoneand"
    assert "stupid" in terms(" ".join(long + "stupidfield"))
    assert "stupid" in tx.Reader(model).restored(("the-quiet-river-runs-over-stone-and-field-with-the-quiet-ri" + "ver-stuuuupid-field").encode())
    # linear in the run
    assert terms(" ".join(long * 300))


def test_restored_readings(docs):
    from tidemark.llm import toxicity as tx

    model = tx.language_model(docs.select(F.coalesce("text", F.lit("")).alias("text")))
    read = lambda s: tx.Reader(model).restored(s.encode())
    assert read("stuuuupid") == ["stupid"] and read("s t u p i d") == ["stupid"] and read("5tupid") == ["stupid"] and read("m0r0n") == ["moron"]
