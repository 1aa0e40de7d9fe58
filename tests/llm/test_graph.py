import random


def test_components(spark):
    from tidemark.llm.graph import components

    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(200)] + [(1000 + rng.randrange(300), 1000 + rng.randrange(300)) for _ in range(200)] + [(5000, 5000 + k) for k in range(50)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {v: find(v) for e in edges if e[0] != e[1] for v in e}
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
