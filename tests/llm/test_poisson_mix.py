import hashlib
import math
from collections import Counter

import fixtures as fx
import pytest
from pricestrata.llm import poisson_mix as mix
from pyspark.sql import functions as F


def u(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2**52


def key(r):
    return hashlib.md5(f"{r['doc_id']}:{hashlib.md5((r['text'] or '').encode()).hexdigest()}".encode()).hexdigest()


def drawn(mean, at):
    n, p, c = 0, math.exp(-mean), math.exp(-mean)
    while c <= at:
        n += 1
        p *= mean / n
        c += p
    return n


def test_awkward_documents_equal_brute_force(spark):
    docs = fx.documents(spark)
    rows = docs.collect()
    size = Counter()
    for r in rows:
        size[r["source"]] += len((r["text"] or "").encode())
    weight = {s: b**0.5 for s, b in size.items() if b}
    rate = {s: w / sum(weight.values()) * sum(size[s] for s in weight) / size[s] for s, w in weight.items()}
    want = []
    for r in rows:
        if r["doc_id"] is not None:
            n = drawn(rate[r["source"]], u(key(r), mix.SEED, 0)) if r["source"] in rate else 0
            want += [(r["doc_id"], r["source"], n, k, hashlib.md5(f"order:{key(r)}:{mix.SEED}:{k}".encode()).hexdigest()) for k in range(1, n + 1)]
    out = mix.mixed(docs)
    got = [(r["doc_id"], r["source"], r["mix_copies"], r["mix_copy"], r["mix_key"]) for r in out.collect() if r["doc_id"] is not None]
    assert sorted(map(str, got)) == sorted(map(str, want))
    for part in out.select("mix_key").rdd.glom().collect():
        assert part == sorted(part)
    assert set(docs.columns) - {"mix_copy"} <= set(out.columns)


@pytest.mark.parametrize("mean", [0.01, 0.7, 3.0, 90.0, 255.0, 1000.0])
def test_counts_have_the_poisson_mean_and_spread(spark, mean):
    texts = [(i, "x" * 10, "en", "a") for i in range(3000)] + [(i, "x" * 10, "en", "b") for i in range(3000, 3003)]
    docs = fx.documents(spark, texts)
    by = mix.rates(docs, {"a": 1.0, "b": 1e-9})
    fixed = by.withColumn("mix_rate", F.lit(mean)).withColumn("mix_parts", F.lit(max(1, math.ceil(mean / mix.MEAN))))
    fixed = fixed.withColumn("mix_cdf", mix.cdf(F.col("mix_rate") / F.col("mix_parts")))
    original = mix.rates
    mix.rates = lambda *a: fixed
    try:
        n = [r["n"] for r in docs.join(mix.mixed(docs).groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").select(F.coalesce("n", F.lit(0)).alias("n")).collect()]
    finally:
        mix.rates = original
    m = sum(n) / len(n)
    v = sum((x - m) ** 2 for x in n) / len(n)
    assert abs(m - mean) < 5 * (mean / 3000) ** 0.5 and abs(v / mean - 1) < 5 * (1 / (3000 * mean) + 2 / 3000) ** 0.5  # the spread of a variance


def test_rows_without_an_id_or_of_a_shared_one_draw_for_themselves(spark):
    docs = fx.documents(spark, [(None, "the same", "en", "a")] * 1000 + [(7, f"text {i:4}", "en", "a") for i in range(1000)] + [(i + 10, "x" * 9, "en", "b") for i in range(1000)])
    out = mix.mixed(docs, {"a": 2.0, "b": 1.0}).cache()
    none, shared = (out.where(c) for c in ("doc_id is null", "doc_id = 7"))
    share = 1 - math.exp(-out.where("source = 'a'").first()["mix_rate"])
    assert abs(none.where("mix_copy = 1").count() / 1000 - share) < 0.08 and abs(shared.select("text").distinct().count() / 1000 - share) < 0.08
    assert out.select("mix_key").distinct().count() == out.count()


def test_given_weights_and_empty_tables(spark):
    docs = fx.documents(spark, [(i, "word " * 20, "en", "ab"[i % 2]) for i in range(4000)])
    n = {r["source"]: r["count"] for r in mix.mixed(docs, {"a": 3.0, "b": 1.0}).groupBy("source").count().collect()}
    assert abs(n["a"] / n["b"] - 3) < 0.4
    assert mix.mixed(docs, {"a": 1.0}).where("source = 'b'").count() == 0
    assert mix.mixed(fx.documents(spark, [])).count() == 0
