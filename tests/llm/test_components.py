import random

from tallyforge.llm.components import connected_components


def roots(edges):
    root = {x: x for e in edges for x in e if None not in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root if find(x) != x}


def check(spark, edges):
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == roots(edges) and len(got) == len(roots(edges))


def test_random_graphs(spark):
    rng = random.Random(41)
    check(spark, [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(5, 5), (None, 3), (7, None), (1, 2), (2, 1)])


def test_long_chain_and_star(spark):
    ids = list(range(1, 120))
    random.Random(1).shuffle(ids)
    check(spark, list(zip(ids, ids[1:])) + [(500, 501 + i) for i in range(50)])


def test_no_edges(spark):
    check(spark, [])
