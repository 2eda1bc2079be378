import random

from ontoloom.operators.components import connected_components


def plain(edges):
    of = {}

    def find(x):
        while of.setdefault(x, x) != x:
            x = of[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            of[y] = x
    return {x: find(x) for x in list(of)}


def test_components_against_union_find(spark):
    rnd = random.Random(4)
    path = [(i, i + 1) for i in range(100, 130)]
    edges = path + [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(-5, 7), (7, -5), (9, 9), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["member"]: r["component"] for r in connected_components(df).collect()}
    assert got == plain(edges)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
