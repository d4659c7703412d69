"""Whitening against whole numbers worked out in Python."""

import random

import numpy as np
import pytest
from pricestrata.llm import whitening as w

SCHEMA = "vec_id long, embedding array<double>, label int, component int, n long, c string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, "x") for i, v in rows], SCHEMA).repartition(3)


def cloud(n=300, width=5, seed=2):
    r = random.Random(seed)
    return [(i, [r.gauss(0, 1) * (1 + k) + (k and r.gauss(0, 1)) for k in range(width)]) for i in range(n)]


def brute(rows, width):
    """(n, S, scatter, deviations) by Python's numbers."""
    x = [[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v in rows]
    n, s = len(x), [sum(c) for c in zip(*x)]
    m = [[n * sum(r[i] * r[j] for r in x) - s[i] * s[j] for j in range(width)] for i in range(width)]
    return n, s, m, [sum((n * c - t) ** 2 for c, t in zip(r, s)) for r in x], x


def test_equals_whole_numbers(spark):
    rows = cloud()
    n, s, m, deviations, x = brute(rows, 5)
    got = w.whitened(table(spark, rows), 3).collect()
    assert len(got) == 3 * n
    v = np.array([[b / (n * n) for b in a] for a in m])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    for r in got:
        i, k = r["vec_id"], r["component"] - 1
        assert r["deviation"] == deviations[i] and r["deviation_text"] == str(deviations[i]) and r["n"] == n
        want = (np.array(x[i]) - np.array(s) / n) @ u[:, k] / np.sqrt(e[k])
        assert abs(abs(r["whitened"]) - abs(want)) < 1e-9
        assert abs(r["explained"] - e[k] / e.sum()) < 1e-12
        assert r["identity_error"] < 1e-9
    whole = np.zeros((n, 3))
    for r in got:
        whole[r["vec_id"], r["component"] - 1] = r["whitened"]
    assert np.abs(np.cov(whole.T, bias=True) - np.eye(3)).max() < 1e-9  # and signs are the same for all rows


def test_result_does_not_depend_on_partitions(spark):
    rows = cloud(200)
    a, b = (sorted(map(tuple, w.whitened(table(spark, rows).repartition(n)).collect())) for n in (1, 7))
    assert a == b


def test_identity_error_does_not_depend_on_the_order_of_rows(spark):
    rows = cloud(200)
    orders = [rows, rows[::-1], *(random.Random(k).sample(rows, len(rows)) for k in range(3))]
    # coalesce() keeps the order of rows
    got = {w.whitened(spark.createDataFrame(o, "vec_id long, embedding array<double>").coalesce(1)).first()["identity_error"] for o in orders}
    assert len(got) == 1 and max(got) < 1e-12


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    fine = cloud(40)
    odd = [(100, None), (101, [1.0, 2.0]), (102, [1.0, None, 1.0, 1.0, 1.0]), (103, [nan] * 5), (104, [1.0, 1.0, 1.0, 1.0, -inf]), (105, []), (None, [1.0, -2.0, 3.0, 0.0, -0.0]), (3, [9.0] * 5), (3, [9.0] * 5)]
    rows = fine + [odd[6], odd[7], odd[8]]
    got = w.whitened(table(spark, fine + odd)).collect()
    assert len(got) == 5 * len(rows)
    deviations = brute(rows, 5)[3]
    assert sorted(r["deviation"] for r in got if r["component"] == 1) == sorted(deviations)
    assert {r["vec_id"] for r in got} == {i for i, _ in rows}


def test_fewer_dimensions_than_entries(spark):
    rows = [(i, [float(i % 7), 2.0 * (i % 7), 3.0]) for i in range(50)]
    got = w.whitened(table(spark, rows)).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in got)
    assert all(r["identity_error"] < 1e-9 for r in got)
    one = w.whitened(table(spark, rows[:1])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"]) for r in one] == [(1, 0, None, None)] * 3
    assert w.whitened(table(spark, [])).collect() == []
    assert w.whitened(table(spark, [(1, None)])).collect() == []


@pytest.mark.parametrize("size", [1e6, 1e12, 1e200])
def test_large_entries(spark, size):
    rows = [(i, [c * size for c in v]) for i, v in cloud(30)]
    got = w.whitened(table(spark, rows)).collect()
    assert all(r["identity_error"] < 1e-6 and abs(r["whitened"]) < 30 for r in got)
    if size > 1e12:
        assert all(r["deviation"] is None and int(r["deviation_text"]) > 2**63 for r in got)


def test_products_and_pieces_are_exact():
    r = random.Random(0)
    for high in (5, 2**20, 2**26, 2**60):
        y = np.array([[r.randint(-high, high) for _ in range(4)] for _ in range(50)], dtype=np.int64)
        want = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j])) for j in range(4)] for i in range(4)]
        assert w.products(y).tolist() == want
    whole = [0, 1, -1, 2**200 + 12345, -(2**95)]
    cells = [0] * len(whole)
    for c, place, v in zip(*w.pieces(whole)):
        cells[c] += v << w.PIECE * place
    assert cells == whole
