import random

from cadenza.operators.graph import connected_components


def brute(edges):
    of = {x: x for e in edges for x in e}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        of[max(a, b)] = min(a, b)
    return {x: root(x) for x in of}


def test_chains_stars_and_nulls(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 240)] + [(7, 7)]
    edges += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    df = spark.createDataFrame(edges + [(None, 3), (4, None)], "a long, b long")
    assert {r.node: r.component for r in connected_components(df).collect()} == brute(edges)
    assert connected_components(df.limit(0)).count() == 0
