"""Growth and exactness of parts: links among near copies, decoding of lattices, the tokenizer's cache, hashes of words."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest


def copies(n: int) -> list[str]:
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    out = []
    for _ in range(n):
        text = list(base)
        for _ in range(2):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(text))
    return out


def test_forest():
    from tidemark.llm.jaccard import forest

    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(1, 40))
        a, b = rng.integers(0, 30, n), rng.integers(0, 30, n)
        root = list(range(30))

        def top(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = sorted((top(x), top(y)))
            root[y] = x
        got = dict(zip(*(x.tolist() for x in forest(a, b)), strict=True))
        assert got == {x: top(x) for x in {*a.tolist(), *b.tolist()} if top(x) != x}


@pytest.mark.parametrize("n", [400])
def test_links_of_near_copies_grow_in_proportion(spark, n):
    from tidemark.llm import jaccard as jc

    made = {}
    store = jc.store
    for size in (n, 2 * n):
        rows = spark.createDataFrame(list(enumerate(copies(size))), "doc_id long, text string")
        kept = []

        def watched(df, name, kept=kept, **options):
            out = store(df, name, **options)
            if name == "links":
                kept.append(out.count())
            return out

        jc.store = watched
        try:
            found = {r.doc_id: r.component_id for r in jc.near_duplicates(rows).collect()}
        finally:
            jc.store = store
        assert len(found) == size
        made[size] = sum(kept)
    assert made[2 * n] <= 2.5 * made[n] + 50 and made[2 * n] <= 4 * n * 2


def test_restore_against_every_reading():
    from tidemark.llm import toxicity as tx

    rng = np.random.default_rng(4)
    model = np.log(rng.dirichlet(np.ones(28), (28, 28)))
    line = model.ravel().tolist()

    def readings(odd):
        inner = [k for k, c in enumerate(odd) if c.isalnum()]
        for at, c in enumerate(odd):
            if c.isalpha() and c not in tx.LEET:
                each = [(c, 0.0)]
                if at and c == odd[at - 1]:
                    stretched = odd[max(0, at - 2) : at + 3].count(c) > 2
                    each.append(("", tx.SQUEEZE if stretched else 8 * tx.SQUEEZE))
            else:
                cheap = c in tx.SEPARATORS or not c.isalnum() and not (inner and inner[0] < at < inner[-1])
                each = [(x, tx.AS_LETTER) for x in tx.LEET.get(c, "")] + [(x, tx.PART if cheap else tx.DROP) for x in ("", " ")]
            yield each

    def value(path):
        a, b, total = 0, 0, 0.0
        for x, cost in path:
            total += cost
            if x and not (x == " " and b == 0):
                k = 0 if x == " " else ord(x) - 96
                total += model[a, b, k]
                a, b = b, k
        return total + (model[a, b, 0] if b else 0.0)

    random.seed(6)
    for _ in range(60):
        odd = "".join(random.choice("ab1c@-.3o") for _ in range(random.randint(1, 6)))
        best = max(value(p) for p in itertools.product(*readings(odd)))
        texts = {"".join(x for x, _ in p) for p in itertools.product(*readings(odd)) if value(p) > best - 1e-9}
        squeezed = {" ".join(t.split()) for t in texts}
        assert " ".join(tx.restore(odd, line).split()) in squeezed, odd


def test_odd_tokens_against_the_rule():
    import re

    from tidemark.llm import toxicity as tx
    from tidemark.llm.common import raw

    rule = re.compile(r"[^\W\d_][0-9@$!|+(€.\-_*~,']+[^\W\d_]|[0-9@$!|+(€][^\W\d_]|[^\W\d_][0-9@$!|+(€](?:[^!]|$)|([^\W\d_])\1\1")
    random.seed(7)
    words = ["".join(random.choice("aab1c@-.,3!€éßß中_") for _ in range(random.randint(1, 9))) for _ in range(4000)]
    data, cuts = raw(pa.array(words))
    got = tx.odd_tokens(data, cuts, tx.letters(data))
    assert [bool(rule.search(w)) for w in words] == got.tolist()


def test_hashes_tell_words_apart():
    from tidemark.llm.common import hashes, span_hashes

    random.seed(8)
    words = sorted({"".join(random.choice("ab\0c") for _ in range(random.randint(0, 90))) for _ in range(20_000)} | {"a" * k for k in range(100)})
    column = pa.array([w.encode() for w in words], pa.binary())
    a = hashes(column)
    assert len(set(a.tolist())) == len(words) and not set(a.tolist()) & set(hashes(column, 9).tolist())
    # wherever they stand
    data = np.frombuffer(b"xx" + "".join(words).encode() + b"yy", np.uint8)
    ends = 2 + np.cumsum([len(w) for w in words])
    assert (span_hashes(data, ends - [len(w) for w in words], ends) == a).all()


def test_encoder_with_a_small_cache():
    from tidemark.llm import tokens as tk

    random.seed(9)
    small, large = tk.Encoder(tk.vocabulary(), 30), tk.Encoder(tk.vocabulary())
    for _ in range(20):
        texts = pa.array([" ".join(random.choice(["the", "river", f"w{random.randrange(300)}", "über", "12,5"]) for _ in range(40)) for _ in range(5)])
        a, b = small(texts, 0), large(texts, 0)
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all()
