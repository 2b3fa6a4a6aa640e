"""Components of random and star-shaped graphs against a union of sets."""

import random

from tidewater.llm.graph import connected_components, thinned


def plain(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {x: top(x) for x in up}


def graphs():
    rnd = random.Random(5)
    yield [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)]
    yield [(i, i + 1) for i in range(40)] + [(100 - i, 101 - i) for i in range(20)]
    yield [(lead, node) for node in range(50, 250) for lead in rnd.sample(range(50), 12)]
    yield [(1, 1), (None, 2), (3, None), (5, 4), (4, 5), (5, 4)]
    yield []


def test_components_equal_plain(spark):
    for edges in graphs():
        got = connected_components(spark.createDataFrame(edges, "a long, b long"))
        rows = got.collect()
        assert {r.node: r.component for r in rows} == plain(edges)
        assert len(rows) == len(plain(edges))


def test_thinned_keeps_what_is_connected_with_fewer_edges(spark):
    for edges in graphs():
        rows = [(r.u, r.v) for r in thinned(spark.createDataFrame(edges, "u long, v long")).collect()]
        assert plain(rows) == plain(edges)
        whole = {(max(e), min(e)) for e in edges if None not in e and e[0] != e[1]}
        assert len(rows) <= len(whole) and all(u > v for u, v in rows)
    stars = list(graphs())[2]
    assert thinned(spark.createDataFrame(stars, "u long, v long")).count() < len(stars) / 3
