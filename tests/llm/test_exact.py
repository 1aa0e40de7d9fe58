"""Corpus operators against brute force on whole small tables, with hard rows added."""

import collections
import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hash string, rid long, token string"


@pytest.fixture(scope="module")
def docs(spark, small):
    """The smallest table with empty, odd and very long texts, a null text, and columns whose names clash with inner ones."""
    table = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    odd = ["", " ", None, "a", "One two three four", "one TWO three four", "x" * 5000, "　  é÷× 12,3'4 <|endoftext|>", long, long + " tail", "same words here today now ok", "same words here today now ok"]
    more = spark.createDataFrame([(10_000 + i, t, None, "odd", None) for i, t in enumerate(odd)], "doc_id long, text string, lang string, source string, n_chars long")
    return table.unionByName(more).withColumns({"hash": F.lit("h"), "rid": F.lit(1).cast("long"), "token": F.lit(None).cast("string")}).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    from tidemark.llm.tokens import vocabulary

    return Tokenizer.from_file(vocabulary())


@pytest.fixture(scope="module")
def ids(texts, tokenizer):
    return {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for d, t in texts.items()}


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def test_pieces_of_text_encode_alike(tokenizer):
    import pyarrow as pa

    from tidemark.llm.tokens import Encoder, vocabulary

    random.seed(1)
    signs = "aBé×÷ñs 1|<>$ab \n\t\r .,'s!é　   x<|endoftext|>日"
    some = ["".join(random.choice(signs) for _ in range(random.randint(0, 30))) for _ in range(3000)]
    encode = Encoder(vocabulary(), cache=500)
    for at in range(0, 3000, 600):
        got, cuts = encode(pa.array(some[at : at + 600]), 0)
        for i, s in enumerate(some[at : at + 600]):
            assert tokenizer.encode(s, add_special_tokens=False).ids + [0] == got[cuts[i] : cuts[i + 1]].tolist()


def test_wavelet(docs, ids, empty):
    from tidemark.llm import wavelet

    got = {r.doc_id: r for r in wavelet.round_trip(docs, shard_tokens=5000).collect()}
    at = 0
    for d in sorted(ids):
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids[d]), crc(ids[d]))
        at += len(ids[d])
    assert wavelet.round_trip(empty).count() == 0


def test_wavelet_queries():
    from tidemark.llm.wavelet import BLOCK, Shard, write_shard

    rng = np.random.default_rng(5)
    row = np.concatenate((rng.zipf(1.3, BLOCK + 1000).clip(0, 50_000), [7, 7])).astype(np.uint32)
    shard = Shard(write_shard(row, [3, None], np.array([0, 1000, len(row)])))
    assert (shard.ids() == row).all()
    for i in (0, 1, 999, BLOCK - 1, BLOCK, len(row) - 1):
        assert shard.access(i) == row[i]
    for t in (1, 2, 7, 49_999, 60_000):
        where = np.flatnonzero(row == t)
        assert shard.count(t) == len(where) and shard.rank(t, 5000) == (where < 5000).sum()
        for k in (0, len(where) // 2, len(where) - 1):
            if len(where):
                assert shard.select(t, k) == where[k]
    assert [p for _, p in shard.occurrences(int(row[-3]))][:3] == [int(w if w < 1000 else w - 1000) for w in np.flatnonzero(row == row[-3])[:3]]
    with pytest.raises(IndexError):
        shard.select(60_000, 0)


def test_packing(docs, ids, empty):
    from tidemark.llm import packing

    pieces = packing.pack(docs, with_ids=True)
    rows = pieces.collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for d, want in ids.items():
        have = []
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == len(have) and r.ids_crc32 == zlib.crc32(r.ids) and r.doc_tokens == len(want)
            have += np.frombuffer(r.ids, "<u4").tolist()
        assert have == want
    for s, parts in by_sequence.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 1024 or s == max(by_sequence)
    whole = packing.sequences(pieces).collect()
    assert len(whole) == len(by_sequence) and all(len(r.ids) == 4 * r.n_tokens for r in whole)
    assert packing.pack(empty).count() == 0


def hits(texts, items, width=10):
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for name, t in items:
        w = words.findall(low(t))
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[i : i + width])].add(str(name))
    sizes = {len(k) for k in windows}
    out = {}
    for d, t in texts.items():
        w = words.findall(low(t))
        hit, found = [0] * len(w), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    found |= windows[k]
                    hit[i : i + n] = [1] * n
        out[d] = (len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), sum(hit) > 0)
    return out


def test_decontamination(spark, small, docs, texts, empty):
    from tidemark.llm import decontaminate as dc

    items = spark.read.parquet(f"{small}/benchmark.parquet").unionByName(spark.createDataFrame([(900, "same words HERE"), (901, ""), (902, None), (None, "a"), (903, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11")], "item_id long, text string"))
    want = hits(texts, [(r.item_id, r.text) for r in items.collect() if r.item_id is not None])
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in dc.report(docs, items).collect()}
    assert got == want
    assert dc.report(empty, items).count() == 0
    assert {r.contaminated for r in dc.report(docs, items.limit(0)).collect()} == {False}
    kept = dc.clean(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, v in want.items() if not v[4]}
    near = dc.near(dc.build(docs), items.where("item_id = 900"), 3).collect()
    assert {10_010, 10_011} <= {r.doc_id for r in near}


def linked(texts):
    words = re.compile(r"[^\x20\x09-\x0D]+")
    sets = {}
    for d, t in texts.items():
        w = words.findall(low(t))
        sets[d] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    where, root = collections.defaultdict(list), {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, s in sets.items():
        for o, k in collections.Counter(o for x in s for o in where[x]).items():
            if 100 * k >= 80 * (len(s) + len(sets[o]) - k):
                a, b = sorted((find(d), find(o)))
                root[b] = a
        for x in s:
            where[x].append(d)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_jaccard(spark, docs, texts, empty):
    from tidemark.llm import jaccard

    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert got == linked(texts)
    assert jaccard.near_duplicates(empty).count() == 0
    twice = docs.select("doc_id", "text").unionAll(docs.select("doc_id", "text"))
    kept = jaccard.one_of_each(twice.union(spark.createDataFrame([(None, "a null id but a text of its own")], twice.schema)))
    assert kept.where("doc_id is null").count() == 1
    assert kept.where("doc_id in (10010, 10011)").count() == 1


def test_jaccard_large_cluster(spark):
    """Near copies with few and with many edits: the blocked comparison of large clusters."""
    from tidemark.llm import jaccard

    rng = random.Random(4)
    base = [f"b{i}" for i in range(90)]
    texts = {}
    for d in range(420):
        w = list(base)
        for _ in range(rng.choice((0, 1, 2, 3, 5))):
            w[rng.randrange(90)] = f"e{rng.randrange(10**6)}"
        texts[d] = " ".join(w)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == linked(texts)


def removed(texts):
    words, seen, out = re.compile(r"[^\x20\x09-\x0D]+"), set(), {}
    for d in sorted(texts):
        w = words.findall(texts[d] or "")
        gone = [0] * len(w)
        for j in range(len(w) - 19):
            k = tuple(w[j : j + 20])
            if k in seen:
                gone[j : j + 20] = [1] * 20
            seen.add(k)
        out[d] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    return out


@pytest.mark.parametrize("batches", [1, 4])
def test_repeats(docs, texts, empty, batches):
    from tidemark.llm import repeats

    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.dedup(docs, batches=batches).collect()}
    assert got == removed(texts)
    assert repeats.dedup(empty).count() == 0


def test_repeats_repeated_ids(spark):
    from tidemark.llm import repeats

    text = " ".join(f"v{i}" for i in range(30))
    rows = repeats.dedup(spark.createDataFrame([(1, text), (1, text), (None, text), (2, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.n_words, r.n_removed) for r in rows) == [(False, 0, 0), (False, 30, 30), (False, 30, 30), (True, 30, 0)]


def test_piece_counts(docs, texts, empty):
    from tidemark.llm import pieces

    signs = pieces.byte_signs()
    vocabulary = {bytes(signs[c] for c in w) for w in json.load(open(pieces.vocabulary(), encoding="utf-8"))["model"]["vocab"] if all(c in signs for c in w)}
    longest, memo = max(map(len, vocabulary)), {}

    def greedy(word):
        if word not in memo:
            at = n = 0
            while at < len(word):
                size = min(longest, len(word) - at)
                while word[at : at + size] not in vocabulary:
                    size -= 1
                at, n = at + size, n + 1
            memo[word] = n
        return memo[word]

    for r in pieces.count(docs).collect():
        each = [greedy(b" " + w) for w in re.findall(rb"[^\x20\x09-\x0D]+", (texts[r.doc_id] or "").encode())]
        assert (r.n_words, r.n_pieces, r.most_pieces) == (len(each), sum(each), max(each, default=0))
    assert pieces.count(empty).count() == 0
