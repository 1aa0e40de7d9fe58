"""Merkle manifest, hard negatives and chat formatting against brute force, with the odd rows that tables hold."""

import glob
import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import chat, merkle, negatives, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    values = (row["doc_id"], row["source"], row["lang"], None if row["n_chars"] is None else row["n_chars"] + more, row["text"])
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(level, fanout=2):
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def siblings(levels, i, fanout):
    out = []
    for level in levels[:-1]:
        run = level[i // fanout * fanout : i // fanout * fanout + fanout]
        out.append((run[: i % fanout], run[i % fanout + 1 :]))
        i //= fanout
    return out


def brute_manifest(rows, fanout=2):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for name in names:
        groups[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = [tree([leaf(r) for r in groups[name]], fanout) for name in names]
    top = tree([t[-1][0] for t in trees], fanout)
    out = []
    for g, name in enumerate(names):
        for i, r in enumerate(groups[name]):
            path = siblings(trees[g], i, fanout) + siblings(top, g, fanout)
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            now = leaf(r, 1 if hit else 0)
            for left, right in path:
                now = h(*left, now, *right)
            out.append((r["doc_id"], leaf(r), trees[g][-1][0], top[-1][0], h(*(x for a, b in path for x in a + b)), now, now == top[-1][0]))
    return sorted(out, key=repr)


ODD = [
    (5, "five", "en", "a", 4), (5, "five", "en", "a", 4), (5, "other", "en", None, None), (None, None, "en", "a", 1), (None, "x", None, "a", 1), (7, "", "", "b", 0),
    (8, "é" * 40_000, "fr", "b", 40_000), (-3, "minus", "fr", "b", 5), (9, "nine", "de", "b", 9_223_372_036_854_775_806), *((100 + i, f"text {i}", "es", "c", i) for i in range(37)),
]


def test_manifest_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD, DOCS).withColumns({"grp": F.lit(1), "leaf": F.lit("x"), "pos": F.lit(2), "node": F.lit("y"), "path": F.lit(0)})
    got = sorted((tuple(r) for r in merkle.audit(docs).collect()), key=repr)
    assert got == brute_manifest([r.asDict() for r in docs.collect()])


@pytest.mark.parametrize("fanout", [3, 5])
def test_other_fanouts_lead_to_one_root(spark, fanout):
    docs = spark.createDataFrame(ODD, DOCS)
    got = merkle.manifest(docs, fanout=fanout)
    found = got.select("leaf", "root", merkle.fold(F.col("leaf"), F.col("path")).alias("again"), merkle.proof(F.col("path")).alias("proof")).collect()
    want = brute_manifest([r.asDict() for r in docs.collect()], fanout)
    assert sorted((r.leaf, r.root, h(r.proof)) for r in found) == sorted((w[1], w[3], w[4]) for w in want)
    assert all(r.again == r.root for r in found)


def test_manifest_of_nothing_and_of_one(spark):
    assert merkle.audit(spark.createDataFrame([], DOCS)).collect() == []
    row = merkle.audit(spark.createDataFrame([(1, "t", "en", "s", 1)], DOCS)).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == h()


def brute_negatives(rows, every=50):
    valid = [(i, (l + 1) % 10 if i % 7 == 0 else l, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]) for i, v, l in rows if i is not None and l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for n, (i, l, v) in enumerate(valid):
        if i % every:
            continue
        others = [(-score(v, w), j, m) for k, (j, m, w) in enumerate(valid) if k != n]
        for s, j, _ in sorted(x for x in others if x[2] == l)[:5]:
            fits = sorted(x for x in others if x[2] != l and 50 * -s <= 100 * -x[0] <= 95 * -s)[:3]
            out += [(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(fits)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int"


def planted(seed, n, dims, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, dims))
    rows = []
    for i in range(n):
        v = centres[i % 10] * (i % 3) + rng.normal(size=dims) * spread
        rows.append((i, [float(x) for x in v / np.linalg.norm(v)], i % 10))
    return rows


@pytest.mark.parametrize(("dims", "spread"), [(8, 0.5), (40, 2.0)])
def test_negatives(spark, monkeypatch, dims, spread):
    rows = planted(dims, 400, dims, spread)
    rows += [(1000 + i, rows[3][1], i % 4) for i in range(120)]  # one very common vector
    rows += [(2000, None, 1), (2001, [float("nan")] * dims, 1), (2002, [float("inf")] * dims, 1), (2003, [None] * dims, 1), (2050, rows[0][1], None), (None, rows[0][1], 1)]
    rows += [(2100, [], 1), (2150, [0.5, 0.5], 2), (50, rows[50][1], 0), (50, rows[50][1], 0)]
    docs = spark.createDataFrame(rows, VECTORS).withColumns({"rid": F.lit(1), "asks": F.lit(2), "block": F.lit(3), "score": F.lit(4)}).repartition(3)
    want = brute_negatives(rows)
    assert sorted(tuple(r) for r in negatives.mine_relabelled(docs).collect()) == want and len(want) > 30
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 5 * dims * 8)
    assert sorted(tuple(r) for r in negatives.mine_relabelled(docs).collect()) == want


def test_negatives_beyond_doubles(spark):
    rows = [(i, [x * 1e7 for x in v], l) for i, v, l in planted(5, 60, 6, 1.0)]
    got = sorted(tuple(r) for r in negatives.mine_relabelled(spark.createDataFrame(rows, VECTORS)).collect())
    assert got == brute_negatives(rows) and any(abs(r[4]) > 1 << 53 for r in got)


def test_negatives_of_nothing(spark):
    assert negatives.mine_relabelled(spark.createDataFrame([], VECTORS)).collect() == []
    assert negatives.mine_relabelled(spark.createDataFrame([(50, [1.0], 1), (100, [1.0], 2)], VECTORS)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 40), st.floats(-0.5, 1.0))
def test_pruning_loses_no_pair(seed, dims, part):
    rng = np.random.default_rng(seed)
    x, y = np.floor(100 * rng.normal(size=(7, dims))), np.floor(100 * rng.normal(size=(30, dims)) * rng.random((30, 1)))
    least = part * (x**2).sum(axis=1)
    order, scores, alive = negatives.threshold_scores(x, negatives.prefix_norms(x), least, y, negatives.prefix_norms(y))
    true = x @ y.T
    found = np.zeros(true.shape, bool)
    found[:, order] = alive
    assert not ((true >= least[:, None]) & ~found).any()
    assert (scores[alive] == true[:, order][alive]).all()


def test_high_thresholds_leave_rows_out():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(5, 32)), rng.normal(size=(500, 32))
    order, _, _ = negatives.threshold_scores(x, negatives.prefix_norms(x), 0.9 * (x**2).sum(axis=1), y, negatives.prefix_norms(y))
    assert len(order) < 50


MARKS = st.lists(st.sampled_from(["### ", "</turn>", "\\", "\n", ": ", "#", "a", "é", "</turn>\n", " "]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(MARKS, MARKS), max_size=4))
def test_turns_read_back(turns):
    rendered = [chat.render(role, text) for role, text in turns]
    assert chat.parse("".join(r[0] for r in rendered)) == turns
    for (whole, start, stop), (_, text) in zip(rendered, turns, strict=True):
        assert chat.read(whole[start:stop] + chat.CLOSE, 0, chat.CLOSE)[0] == text


def test_only_conflicts_are_escaped():
    assert chat.escaped("C:\\dir # <turn>", chat.CLOSE) == "C:\\dir # <turn>"
    assert chat.escaped("see </turn>", chat.CLOSE) == "see \\</turn>"
    assert chat.escaped("\\</turn>", chat.CLOSE) == "\\\\\\</turn>"


CONV = "conv_id long, turn long, role string, text string"


def brute_chat(rows):
    out, by = [], {}
    for r in rows:
        by.setdefault(r[0], []).append((r[1], r[2] or "", r[3] or ""))
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.md5(t[2].encode()).hexdigest()))
        learnt = [t[2] for t in turns if t[1] == "assistant"]
        out.append((conv, len(turns), h(*(f"{r}\n{t}\n" for _, r, t in turns)), sum(map(len, learnt)), h(*learnt), sum(len(chat.render(r, t)[0]) for _, r, t in turns)))
    return sorted(out, key=repr)


def test_chats_of_odd_rows(spark, monkeypatch):
    rows = [(1, 1, "assistant", "ok"), (1, 0, "user", None), (1, None, None, "first"), (2, 0, "user", "tie"), (2, 0, "user", "tie"), (2, 0, "assistant", "### "), (None, 0, "user", "no id"), (None, 1, "assistant", "\\")]
    rows += [(3, i, ("user", "assistant")[i % 2], f"turn {i} </turn> é " * (i % 5)) for i in range(900)]  # one very long conversation
    rows += [(4, 0, "a: b", "x" * 100_000), (4, 1, "assistant", "y " * 50_000), *((i, 0, "assistant", "single") for i in range(10, 60))]
    talk = spark.createDataFrame(rows, CONV).withColumns({"part": F.lit(1), "tie": F.lit("t"), "formatted": F.lit("f"), "loss": F.lit(0)}).repartition(5)
    monkeypatch.setattr(chat, "PART", 3_000)
    parts = chat.format_chats(talk)
    assert sorted((tuple(r) for r in chat.report(parts).collect()), key=repr) == brute_chat(rows)
    assert parts.where("conv_id = 3").count() > 4
    assert chat.turns(parts).count() == len(rows)


def test_no_chats(spark):
    assert chat.report(chat.format_chats(spark.createDataFrame([], CONV))).collect() == []


@pytest.mark.parametrize("name", ["op11_slot_pivot", "op12_threshold_join", "op13_grammar_round_trip"])
def test_twin(spark, small, name):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = queries.QUERIES[name](spark, small)
    columns = got.columns
    result = con.execute(queries.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r[names.index(c)] for c in columns) for r in result.fetchall())
