"""Places, sums and quantiles by range partitions; effects of trees; boosting that stops early."""

import random
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pricestrata.operators import models, serving, trees
from pricestrata.operators import ranges as G
from pyspark.sql import functions as F


def keyed(spark, n=500, seed=1):
    r = random.Random(seed)
    rows = [(r.choice(["hot", "hot", "hot", "a", "b", None]), r.choice([None, 1.0, 2.0, 2.5, float(r.randint(0, 50))]), i, r.randint(-5, 5)) for i in range(n)]
    return spark.createDataFrame(rows, "k string, v double, i long, w int").repartition(5), rows


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_places_and_sums_within_keys(spark, parts):
    df, rows = keyed(spark)
    got = {r["i"]: (r["place"], r["before_w"], r["before_v"]) for r in G.sequenced(df, ["k"], ["i"], ("w", "v"), parts=parts).collect()}
    for k in {x[0] for x in rows}:
        n = w = v = 0
        for x in sorted((x for x in rows if x[0] == k), key=lambda x: x[2]):
            n += 1
            place, before_w, before_v = got[x[2]]
            assert (place, before_w) == (n, w) and abs(before_v - v) < 1e-9
            w, v = w + x[3], v + (x[1] or 0)


def test_places_without_keys_and_of_nothing(spark):
    df, _ = keyed(spark, 50)
    assert sorted((r["place"], r["i"]) for r in G.sequenced(df, [], [F.desc("i")], parts=4).collect()) == [(i + 1, 49 - i) for i in range(50)]
    assert G.sequenced(df.limit(0), ["k"], ["i"], ("w",)).collect() == []


@pytest.mark.parametrize("parts", ["1", "8"])
def test_quantiles_equal_percentiles(spark, parts):
    df, _ = keyed(spark)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r["k"]: r for r in G.quantile_table(df, ["k"], {"v": F.col("v"), "w": F.col("w")}, {"low": 0.1, "median": 0.5, "top": 1.0}).collect()}
        want = {r["k"]: r for r in df.groupBy("k").agg(*(F.percentile(c, q).alias(f"{c}_{n}") for c in "vw" for n, q in (("low", 0.1), ("median", 0.5), ("top", 1.0)))).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert got.keys() == want.keys()
    for k, r in want.items():
        assert all(abs(got[k][c] - r[c]) < 1e-9 for c in r.asDict() if c != "k")
    one = G.with_quantiles(df.agg(F.count("*").alias("n")), df, [], {"v": F.col("v")}, {"q": 0.25}).first()
    assert one["n"] == 500 and one["v_q"] == df.agg(F.percentile("v", 0.25)).first()[0]


def test_no_group_is_held_in_a_buffer(spark):
    df, _ = keyed(spark)
    plan = G.quantile_table(df, ["k"], {"v": F.col("v")}, {"m": 0.5})._jdf.queryExecution().toString().lower()
    assert "percentile" not in plan and "median(" not in plan and "collect" not in plan


def forest(r, features, n_trees=4, depth=4):
    """Random trees as rows of the node table; a split in three is categorical."""
    rows = []
    for t in range(n_trees):
        todo, number = [(0, 0)], 1
        while todo:
            node, level = todo.pop()
            if level == depth or r.random() < 0.15 and level:
                rows.append((t, node, -1, None, None, -1, -1, r.uniform(-5, 5)))
                continue
            f, left, right = r.randrange(features), number, number + 1
            number += 2
            categories = sorted(r.sample([0.0, 1.0, 2.0, 3.0], 2)) if f % 3 == 2 else None
            rows.append((t, node, f, None if categories else r.uniform(0, 4), categories, left, right, None))
            todo += [(left, level + 1), (right, level + 1)]
    return rows


def predicted(rows, x):
    total = 0.0
    for t in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == t}
        at = own[0]
        while at[2] >= 0:
            left = x[at[2]] in at[4] if at[4] else x[at[2]] <= at[3]
            at = own[at[5] if left else at[6]]
        total += at[7]
    return total


@pytest.mark.parametrize(("features", "depth"), [(1, 2), (3, 4), (6, 5), (8, 6)])
def test_effects_equal_all_subsets(spark, features, depth):
    r = random.Random(features)
    nodes = forest(r, features, depth=depth)
    point = lambda: [float(r.randrange(4)) if f % 3 == 2 else r.uniform(0, 4) for f in range(features)]
    rows, ground = [point() for _ in range(6)], [point() for _ in range(5)]
    names = [f"f{i}" for i in range(features)]
    table = lambda xs: spark.createDataFrame(list(enumerate(xs)), "id long, features array<double>")
    got = trees.tree_effects(table(rows), "id", spark.createDataFrame(nodes, trees.NODE_SCHEMA), table(ground), names).collect()
    assert len(got) == 6 * features
    for g in got:
        x, i = rows[g["id"]], int(g["feature"][1:])
        want, others = 0.0, [j for j in range(features) if j != i]
        for k in range(features):
            for s in combinations(others, k):
                weight = factorial(k) * factorial(features - k - 1) / factorial(features)
                for b in ground:
                    mix = [x[j] if j in s else b[j] for j in range(features)]
                    want += weight * (predicted(nodes, [x[j] if j == i else v for j, v in enumerate(mix)]) - predicted(nodes, mix)) / len(ground)
        assert abs(g["effect"] - want) < 1e-9
        assert abs(g["base"] - np.mean([predicted(nodes, b) for b in ground])) < 1e-9 and abs(g["predicted"] - predicted(nodes, x)) < 1e-9


def listings(spark, n=300):
    r = random.Random(4)
    rows = [(i, f"g{i % 40}", float(r.randrange(100)), r.choice(["red", "red_ish", "blue", None]), 0.0) for i in range(n)]
    rows = [(i, g, a, c, 3 * a + (50.0 if c == "red" else 0.0) + r.gauss(0, 5)) for i, g, a, c, _ in rows]
    return spark.createDataFrame(rows, "id long, grp string, size double, colour string, price double")


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_effects_of_fitted_models_add_up_and_name_raw_features(spark, kind):
    rows = listings(spark)
    options = {"numTrees": 5, "maxDepth": 4} if kind == "forest" else {"maxIter": 5, "maxDepth": 3}
    bundle = serving.fitted(rows, ["size", "colour"], "price", kind, **options)
    got = trees.model_effects(bundle, rows, "id", rows.where("id < 25")).collect()
    assert {g["feature"] for g in got} == {"size", "colour"} and len(got) == 600
    own = {r["id"]: r["predicted"] for r in bundle.predict(rows).collect()}
    by = {}
    for g in got:
        by.setdefault(g["id"], [g["base"]]).append(g["effect"])
        assert abs(g["predicted"] - own[g["id"]]) < 1e-9
    assert all(abs(sum(v) - own[k]) < 1e-9 for k, v in by.items())
    with pytest.raises(ValueError, match="background"):
        trees.model_effects(bundle, rows, "id", rows.where("id < 0"))


def test_best_round():
    assert trees.best_round([5, 4, 3, 3, 4, 2], 2) == (3, True)
    assert trees.best_round([5, 4, 3, 3, 4, 2], 3) == (6, False)
    assert trees.best_round([], 3) == (1, False)
    assert trees.best_round([1.0], 1) == (1, False)


def test_boosting_stops_at_the_best_round_of_held_out_groups(spark):
    rows = listings(spark)
    found = trees.stopped_boosting(rows, ["size", "colour"], "price", "grp", rounds=24, patience=3, maxDepth=3, stepSize=0.5)
    split = models.inner_split(rows, "grp")
    groups = {k: {r[0] for r in split.where(F.col("inner") == k).select("grp").collect()} for k in ("fit", "stop")}
    assert not groups["fit"] & groups["stop"] and len(groups["fit"]) == 36
    label = lambda df: df.withColumn("__target", F.col("price"))
    fit, stop = (label(found.features(split.where(F.col("inner") == k))) for k in ("fit", "stop"))
    errors = list(models.estimator("boosted", maxIter=24, maxDepth=3, stepSize=0.5).fit(fit).evaluateEachIteration(stop, "absolute"))
    best, over = 0, None
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        if i - best >= 3:
            break
    assert found.rounds == best + 1 == found.model.getNumTrees
    assert np.allclose(found.errors, errors[: len(found.errors)])
    mine = found.model.transform(stop).agg(F.avg(F.abs(F.col("__prediction") - F.col("__target")))).first()[0]
    assert abs(mine - errors[best]) < 1e-9
