"""Hard negatives against all products, for trees of several depths and on awkward tables."""

import random

import numpy as np
import pytest
from pricestrata.llm import hard_negatives as hn
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, block int, chunk int, score double"


def rows_of(n=400, width=6, seed=3):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(width)] for _ in range(4)]
    rows = [(i, [c + r.gauss(0, 0.4) for c in r.choice(centres)], 0 if i % 3 == 0 else r.randrange(4)) for i in range(n)]
    same = [0.5] * width
    rows += [(n + i, same, i % 3) for i in range(120)]  # one vector that many rows share
    return rows


def brute(rows, anchor, positives=5, negatives=3):
    best = {}
    for i, v, g in rows:
        if i is None or g is None or not v or any(x is None or x != x or abs(x) == float("inf") for x in v):
            continue
        x = [int(c) for c in np.floor(256 * np.array(v, dtype=np.float32).astype(float))]
        best[i] = min(best.get(i, (x, g)), (x, g))
    widths = [len(x) for x, _ in best.values()]
    width = max(set(widths), key=lambda w: (widths.count(w), w)) if widths else 0
    own = sorted((i, x, g) for i, (x, g) in best.items() if len(x) == width)
    out = []
    for a, q, g in own:
        if not anchor(a):
            continue
        near = sorted((-sum(p * c for p, c in zip(q, x)), i, h) for i, x, h in own if i != a)
        for s, p, _ in [n for n in near if n[2] == g][:positives]:
            fits = [n for n in near if n[2] != g and 50 * -s <= 100 * -n[0] <= 95 * -s][:negatives]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(fits)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, v, g, 1, 2, 3, 0.5) for i, v, g in rows], SCHEMA).repartition(3)


def found(df, every=10, **sizes):
    return sorted(map(tuple, hn.mined(df, F.col("label"), F.col("vec_id") % every == 0, **sizes).collect()))


@pytest.mark.parametrize("block", [4096, 100, 20])
def test_equals_all_products(spark, block):
    rows = rows_of()
    assert found(table(spark, rows), block=block, sample=200) == brute(rows, lambda i: i % 10 == 0)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(None, [1.0] * 6, 1), (1000, None, 1), (1010, [1.0] * 5 + [None], 1), (1020, [1.0] * 5 + [nan], 1), (1030, [inf] * 6, 1), (1040, [], 1), (1050, [1.0, 2.0], 1), (1060, [1.0] * 6, None)]
    odd += [(1070, [0.0] * 6, 1), (1080, [-0.1] * 6, 1), (0, [2.0] * 6, 2), (10, [0.1] * 6, 3), (10, [0.1] * 6, 3)]
    rows = rows_of(60) + odd
    assert found(table(spark, rows), block=32, sample=64) == brute(rows, lambda i: i % 10 == 0)


def test_few_or_no_rows(spark):
    assert found(table(spark, [])) == []
    assert found(table(spark, [(0, [1.0], 1)])) == []
    assert found(table(spark, [(1, [1.0], 1), (2, [1.0], 1)])) == []
    rows = [(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2), (3, [0.5], 2), (4, [0.4], 2)]
    assert found(table(spark, rows)) == brute(rows, lambda i: i % 10 == 0) == [(0, 1, 1, 2, 65536, 58880), (0, 1, 2, 3, 65536, 32768)]


def test_too_long_vectors_are_an_error(spark):
    with pytest.raises(ValueError, match="double"):
        found(table(spark, [(0, [1e7], 1), (1, [1e7], 1)]))


def test_chunks_are_bounded():
    counts = {0: 3, 1: 4, 2: 10, 3: 1, 4: 2, 5: 3}
    cut = hn.runs(counts, 5)
    held = {}
    for leaf, first, parts in cut:
        if parts == 1:
            held[first] = held.get(first, 0) + counts[leaf]
    assert max(held.values()) <= 5
    assert [p for leaf, _, p in cut if leaf == 2] == [2]


def test_a_near_anchor_meets_few_blocks(spark):
    """Where vectors have structure, an anchor's annulus touches a part of the leaves."""
    r = random.Random(1)
    centres = [[r.gauss(0, 1) for _ in range(4)] for _ in range(40)]
    rows = [(i, [c + r.gauss(0, 0.01) for c in centres[i % 40]], i // 40 % 3) for i in range(4000)]
    own = hn.prepared(table(spark, rows), F.col("label"))
    index = hn.Index(own, 6, block=100, sample=2000)
    x = np.floor(256 * np.array([rows[0][1]], dtype=np.float32).astype(float))
    _, most = index.tree.scores(x, index.near, index.far)
    all_scores = sorted((float(x[0] @ np.floor(256 * np.array(v, dtype=np.float32).astype(float))) for _, v, _ in rows), reverse=True)
    assert (most[0, index.leaf] >= all_scores[20]).mean() < 0.7
