import numpy as np
import pytest
from pricestrata.llm import hilbert_ann as ann
from pyspark.sql import functions as F


def brute(rows, k, every=20):
    own = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            own[i] = min(own.get(i, v), v)
    ids = np.array(sorted(own), dtype=np.int64)
    x = np.array([own[i] for i in ids], dtype=np.float64)
    out = {}
    for q in ids[ids % every == 0]:
        s = (x * x[ids == q][0]).sum(axis=1)
        s[ids == q] = -np.inf
        first = np.lexsort((ids, -s))[: min(k, len(ids) - 1)]
        out[int(q)] = [(int(ids[i]), float(s[i])) for i in first]
    return out


def found(df, **kw):
    out = {}
    for r in sorted(ann.neighbours(df, F.col("vec_id") % 20 == 0, **kw).collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 0.5) for i, v in rows], "vec_id long, embedding array<float>, label int, rank int, score double")


def test_odd_vectors_and_ties_are_exact_where_windows_hold_all(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARE", 1000.0)
    r = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=6) * r.uniform(0.1, 9)]) for i in range(200)]
    rows += [(200 + i, rows[3][1]) for i in range(60)] + [(20, rows[20][1]), (400 + 20, rows[40][1]), (400 + 40, rows[40][1])]
    rows += [(300, None), (320, [0.0] * 6), (340, [float("nan")] * 6), (360, [float("inf")] + [1.0] * 5), (380, [None] * 6), (None, [1.0] * 6)]
    assert found(table(spark, [*rows, (500, [1.0] * 5), (520, [1.0] * 7)])) == brute(rows, 20)


def recall(spark, rows):
    want, got = brute(rows, 20), found(table(spark, rows))
    assert got.keys() == want.keys()
    score = {q: dict(w) for q, w in brute(rows, len(rows)).items()}
    assert all(s == score[q][i] for q in got for i, s in got[q])
    return np.mean([len({i for i, _ in want[q]} & {i for i, _ in got[q]}) / 20 for q in want])


def test_clustered_vectors_and_a_common_one(spark):
    r = np.random.default_rng(4)
    centre = r.normal(size=(10, 32))
    rows = [(i, [float(np.float32(x)) for x in centre[i % 10] * 0.5 + r.normal(size=32)]) for i in range(3000)]
    assert recall(spark, rows + [(3000 + i, rows[0][1]) for i in range(1000)]) >= 0.9


@pytest.mark.parametrize("long", [1.0, 10.0, 1000.0])
def test_a_long_vector_costs_no_recall(spark, long):
    r = np.random.default_rng(5)
    x = r.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] *= long
    x[1000:] *= r.uniform(0.3, 1, (1000, 1))
    assert recall(spark, [(i, [float(np.float32(y)) for y in v]) for i, v in enumerate(x)]) >= 0.9


def test_products_fall_with_the_rows():
    for rows in (1, 30, 500, 10_000, 50_000, 10**9):
        size, halo = ann.windows_of(rows, ann.ORDERS)
        held = min(rows, size * (2 * halo + 1)) * ann.ORDERS / rows
        assert size <= ann.ROWS and held >= min(1.0, 0.9 * ann.SHARE * (500 / rows) ** ann.FALL)
    assert held < 0.2 and ann.ORDERS * 5 * ann.windows_of(50_000, ann.ORDERS)[0] < 0.8 * 50_000


def test_hilbert_keys_walk_the_grid():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    order = grid[np.argsort(ann.hilbert(grid, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_few_rows(spark):
    assert found(table(spark, [])) == {}
    assert found(table(spark, [(0, [1.0, 0.0])])) == {}
    assert found(table(spark, [(0, [1.0, 0.0]), (1, [-1.0, 0.0])])) == {0: [(1, -1.0)]}
