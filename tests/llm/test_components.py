import random

import pytest
from pricestrata.llm import common


def brute(edges):
    up = {}
    for a, b in edges:
        one, two = up.get(a, {a}), up.get(b, {b})
        for x in (both := one | two):
            up[x] = both
    return sorted({tuple(sorted(x)) for x in up.values() if len(x) > 1})


def graph():
    """A chain, a star, a dense group, pairs, a node with itself and repeated edges; both signs."""
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(-60, 60)] + [(1000, i) for i in range(1001, 1060)]
    edges += [(r.randint(2000, 2040), r.randint(2000, 2040)) for _ in range(300)] + [(3000 + 2 * i, 3001 + 2 * i) for i in range(40)]
    edges += [(5000, 5000), (-(1 << 63), (1 << 63) - 1), *edges[:50]]
    r.shuffle(edges)
    return edges


def groups(spark, edges, *few):
    by = {}
    for node, component in common.components(spark.createDataFrame(edges, "src long, dst long"), *few).collect():
        by.setdefault(component, []).append(node)
    assert all(c in nodes and len(set(nodes)) == len(nodes) for c, nodes in by.items())
    return sorted(tuple(sorted(x)) for x in by.values())


@pytest.mark.parametrize("few", [0, 5, 150, 4096])
def test_components_equal_brute_force_wherever_rounds_end(spark, few):
    assert groups(spark, graph(), few) == brute(graph())


def test_no_edges(spark):
    assert groups(spark, []) == groups(spark, [(7, 7)]) == []


def test_last_edges_take_one_table_and_not_rounds(spark, monkeypatch):
    """Rounds over the last few edges were most of the driver's tasks and plans."""
    made = []
    one = common.kept
    monkeypatch.setattr(common, "kept", lambda df: made.append(1) or one(df))
    assert groups(spark, graph()) == brute(graph())
    assert len(made) == 2
