"""The quality classifier: features against a plain restatement, learning, held-out accuracy and awkward tables."""

import random
import re
import zlib

import fixtures as fx
import numpy as np
import pytest
from pricestrata.llm import quality as q
from pyspark.sql import functions as F


def plain(text):
    """Distinct n-grams as (order, parts)."""
    out = {(n, text[i : i + n]) for n in range(1, 5) for i in range(len(text) - n + 1)}
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    marked = [w if i == 0 or w != words[i - 1] else None for i, w in enumerate(words)]
    return out | {(5, w) for w in marked} | {(6, p) for p in zip(marked, marked[1:])}


@pytest.mark.parametrize("text", ["", " ", "a", "one two  two two\tthree\n", "É ẞ \U0001f600\U0001f600 x", "ab " * 50])
def test_a_bucket_for_each_ngram(text):
    n = len(plain(text))
    assert n - 2 <= len(q.features(text)) <= n


def test_pieces_change_nothing(monkeypatch):
    r = random.Random(1)
    text = " ".join("".join(r.choice("abcdeé") for _ in range(r.randrange(1, 9))) for _ in range(400))
    want = q.features(text)
    for piece in (5, 64, 1000):
        monkeypatch.setattr(q, "PIECE", piece)
        assert q.features(text).tolist() == want.tolist()
    assert q.features(None).tolist() == []


def test_descent_meets_the_conditions_of_the_best():
    """At the best place margins of free rows are 1, of rows at 0 more, of rows at the bound less."""
    r = np.random.default_rng(0)
    rows = [np.unique(r.integers(0, 40, 6)) + (0 if i % 2 else 20) for i in range(60)]
    good = np.arange(60) % 2 == 0
    ratio = q.ratios(rows, good)
    weights, constant = q.descent(rows, good, ratio, cost=0.05, passes=3000)
    w = np.divide(weights, ratio, out=np.zeros_like(weights), where=ratio != 0)
    primal = 0.5 * (w @ w + constant**2) + 0.05 * sum(max(0.0, 1 - (1 if g else -1) * (weights[x].sum() + constant)) for x, g in zip(rows, good))
    for other in r.normal(0, 0.01, (200, 41)):
        v, b = w.copy(), constant + other[40]
        v[:40] += other[:40]
        assert primal <= 0.5 * (v @ v + b**2) + 0.05 * sum(max(0.0, 1 - (1 if g else -1) * (sum(v[x] * ratio[x]) + b)) for x, g in zip(rows, good)) + 1e-6


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = [r for r in q.classified(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect() if r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.95
    bad = [r for r in held if labels[r["doc_id"]] == 0]
    assert np.mean([r["predicted"] == 0 for r in bad]) > 0.85


def test_held_out_labels_teach_nothing(spark):
    """Turning the held-out rows' labels, and texts' other columns, changes no score."""
    docs = fx.documents(spark)
    kinds = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    turned = kinds.withColumn("quality", F.when(rest, 1 - F.col("quality")).otherwise(F.col("quality")))
    others = docs.withColumns({"lang": F.lit("x"), "source": F.lit(None).cast("string")})
    a, b, c = (sorted(map(str, q.classified(d, k).collect())) for d, k in ((docs, kinds), (docs, turned), (others, kinds)))
    assert a == b == c


def test_awkward_tables(spark):
    docs = fx.documents(spark)
    kinds = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (4, 0, 0), (4, 1, 0), (5, None, 0), (None, 1, 0), (7, 5, 0), (8, 0, 0), (9, 1, 1)], "doc_id long, quality int, score int")
    got = q.classified(docs, kinds).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    by = {}
    for r, t in zip(sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)), sorted(fx.awkward(), key=lambda r: (r[0] is None, r[0] or 0))):
        by.setdefault(t[1] or "", set()).add(r["score"])
    assert all(len(s) == 1 for s in by.values())
    none = q.classified(docs, kinds.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert q.classified(docs.limit(0), kinds).collect() == []
    short = q.classified(docs, kinds, sample=2).collect()
    assert len(short) == docs.count()
