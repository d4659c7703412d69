"""Frozen levels, ordered target statistics, and ranks that no single task holds."""

import random

from pricestrata.operators import encoding, market, models, ranges, splits
from pyspark.sql import functions as F


def test_frozen_levels_survive_a_reload_and_unseen_ones_are_missing(spark, tmp_path):
    train = spark.createDataFrame([("b", "x"), ("a", "x"), (None, "y"), ("b", None)], "k string, m string")
    rows = spark.createDataFrame([(1, "a", "y"), (2, "b", "z"), (3, "c", None), (4, None, "x")], "i int, k string, m string")
    made = encoding.FrozenLevels.of(train, ["k", "m"])
    made.save(str(tmp_path / "levels"))
    for levels in (made, encoding.FrozenLevels.load(spark, str(tmp_path / "levels"))):
        got = {r["i"]: (r["k_code"], r["m_code"]) for r in levels(rows).collect()}
        assert got == {1: (0.0, 1.0), 2: (1.0, None), 3: (None, None), 4: (None, 0.0)}


def test_many_levels_are_a_table(spark):
    train = spark.range(200_000).select(F.format_string("level %07d", "id").alias("k"))
    levels = encoding.FrozenLevels.of(train, ["k"])
    plan = levels(train)._jdf.queryExecution().optimizedPlan().toString()
    assert " IN (" not in plan and "INSET" not in plan
    assert levels(train.limit(1000)).where("k_code is null or k_code <> cast(substring(k, 7) as double)").count() == 0


def listings(spark, n=240):
    r = random.Random(9)
    rows = [(i, f"g{i % 30}", r.choice(["hot"] * 4 + ["a", "b", None]), float(r.randrange(50)), 0.0) for i in range(n)]
    return spark.createDataFrame([(i, g, c, s, 2 * s + {"hot": 40.0, "a": 0.0, "b": 90.0, None: 10.0}[c]) for i, g, c, s, _ in rows], "id long, grp string, colour string, size double, price double").repartition(4)


def test_ordered_statistics_never_see_a_rows_own_target(spark):
    rows = listings(spark)
    got = {r["id"]: r["statistic"] for r in encoding.ordered_statistics(rows, "colour", "price", "id", 2.0).collect()}
    turned = rows.withColumn("price", F.when(F.col("id") == 7, 1e6).otherwise(F.col("price")))
    mean = [df.agg(F.avg("price")).first()[0] for df in (rows, turned)]
    other = {r["id"]: r["statistic"] for r in encoding.ordered_statistics(turned, "colour", "price", "id", 2.0).collect()}
    own = sorted(rows.withColumn("h", splits.hashed(F.col("id"))).collect(), key=lambda r: (r["h"], r["id"]))
    for df_mean, found, price in ((mean[0], got, None), (mean[1], other, 1e6)):
        held = {}
        for r in own:
            n, s = held.get(r["colour"], (0, 0.0))
            assert abs(found[r["id"]] - (s + 2 * df_mean) / (n + 2)) < 1e-6
            held[r["colour"]] = (n + 1, s + (price if price and r["id"] == 7 else r["price"]))


def test_ordered_boosting_learns_and_takes_unseen_levels(spark):
    rows = listings(spark)
    callback = encoding.ordered_fit_predict("price", "id", maxIter=10, maxDepth=3)
    out = models.grouped_cv(rows, "grp", ["colour", "size"], callback, 3)
    one = models.cv_summary(out).first()
    assert out.count() == 240 and one["r2_mean"] > 0.7
    strange = rows.limit(5).withColumn("colour", F.lit("never seen"))
    assert callback(rows, strange, ["colour", "size"]).where("predicted is null").count() == 0


def test_permuted_values_stay_in_their_groups_and_null_is_one(spark):
    rows = listings(spark)
    got = splits.permuted(rows, "price", "id", ["colour"])
    assert got.columns == rows.columns and got.count() == 240
    by = lambda df: {r["colour"]: sorted(r["p"]) for r in df.groupBy("colour").agg(F.collect_list("price").alias("p")).collect()}
    assert by(got) == by(rows)
    assert got.join(rows.select("id", F.col("price").alias("was")), "id").where("price <> was").count() > 100
    whole = models.shuffled_target(rows, "price", "id")
    assert sorted(r["price"] for r in whole.collect()) == sorted(r["price"] for r in rows.collect())


def test_dense_ranks(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 1.0), (4, None), (5, 9.0)], "i int, v double")
    got = {r["i"]: r["rank"] for r in ranges.dense_ranked(rows, {"rank": "v"}).collect()}
    assert got == {4: 1, 3: 2, 1: 3, 2: 3, 5: 4}


def test_comparable_range_of_a_hot_key_meets_the_nearest_rows(spark):
    """Many rows of one name and of few mileages: ties go by the order, and gaps come last."""
    r = random.Random(6)
    ref = [(i, "door", "x", r.choice([None, 10.0, 20.0, 20.0, 30.0, float(r.randrange(100))]), float(r.randrange(1000))) for i in range(700)]
    asked = [(i, "door", "x", m, 500.0) for i, m in enumerate([None, 0.0, 20.0, 20.5, 99.0, 1e9])]
    levels = (("part_name", "brand"), ("part_name",))
    frame = spark.createDataFrame(ref, "ref_id long, part_name string, brand string, mileage double, price double").repartition(5)
    got = {x["query_id"]: x for x in market.comparable_range(spark.createDataFrame(asked, "query_id long, part_name string, brand string, mileage double, prediction double"), frame, levels).collect()}
    for i, _, _, m, p in asked:
        order = sorted(ref, key=lambda x: ((m is None or x[3] is None), abs(m - x[3]) if m is not None and x[3] is not None else 0, x[0]))[:50]
        prices = sorted(x[4] for x in order)
        at = lambda q: prices[int(49 * q)] + (prices[min(49, int(49 * q) + 1)] - prices[int(49 * q)]) * (49 * q - int(49 * q))
        assert got[i]["comparables"] == 50 and abs(got[i]["low"] - max(0, min(at(0.1), p - 50))) < 1e-6 and abs(got[i]["high"] - max(at(0.9), p + 50)) < 1e-6
