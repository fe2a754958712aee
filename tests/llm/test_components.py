"""Components against a union-find."""

import random

import numpy as np
import pytest

from pairwright.llm import components
from pairwright.llm.components import connected, stars


def union_find(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = root(u), root(v)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


@pytest.mark.parametrize("combined", [3, 1_000_000])
def test_random_graphs_chains_and_hubs(spark, monkeypatch, combined):
    """Both star operations run, whatever the combiner has done before them."""
    ran = []
    for name in ("_large_star", "_small_star"):
        monkeypatch.setattr(components, name, lambda e, f=getattr(components, name), name=name: (ran.append(name), f(e))[1])
    r = random.Random(combined)
    edges = [(r.randrange(120), r.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 230)] + [(300, i) for i in range(301, 340)]
    edges += [(5, 5), (9, 8), (9, 8)]
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(edges, "u long, v long").repartition(5), combined).collect()}
    want = union_find([e for e in edges if e[0] != e[1]])
    assert got == want
    assert ran.count("_large_star") == ran.count("_small_star") >= 2


def test_star_operations_on_an_uncombined_chain(spark):
    """The operations alone shorten a chain of 64 nodes to a star in a few rounds."""
    edges, rounds = spark.createDataFrame([(i + 1, i) for i in range(64)], "u long, v long"), 0
    while {r["v"] for r in edges.collect()} != {0}:
        edges, rounds = components._small_star(components._large_star(edges)), rounds + 1
        edges = spark.createDataFrame(edges.collect(), "u long, v long")
    assert edges.count() == 64 and rounds <= 10


def test_no_edges(spark):
    assert connected(spark.createDataFrame([], "u long, v long")).count() == 0
    u, v = stars(np.array([4, 2, 9]), np.array([2, 1, 9]))
    assert (u.tolist(), v.tolist()) == ([2, 4], [1, 1])
