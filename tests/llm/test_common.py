import random

from pairsmith.llm.common import connected_components


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(40)] + [(2000, 2000 + k) for k in range(1, 60)] + [(5, 5)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    frame = spark.createDataFrame(edges, "src long, dst long")
    found = connected_components(frame).collect()
    assert len(found) == len(want) and {r.node: r.component for r in found} == want
    assert connected_components(frame.limit(0)).count() == 0
