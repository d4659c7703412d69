import pytest
from pricestrata.operators import models, selection
from pyspark.sql import functions as F


def test_cascades_never_take_a_key_twice(spark):
    df = spark.createDataFrame([(i // 2, float(i)) for i in range(20)], "id int, v double")
    got = selection.cascaded(df, "id", [("large", F.col("v") > 4, [F.desc("v")]), ("also", F.lit(True), [F.desc("v")]), ("small", F.lit(True), [F.asc("v")])], 2)
    assert {(r["selector"], r["place"]): r["id"] for r in got.collect()} == {("large", 1): 9, ("large", 2): 8, ("also", 1): 7, ("also", 2): 6, ("small", 1): 0, ("small", 2): 1}


def test_finalists_pruning_and_drivers(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 9.0), ("a", "x", 1.0)], "variant string, name string, mae double")
    assert [(r["variant"], r["name"]) for r in selection.finalists(df, "variant", "name", ["mae"], 3).collect()] == [("a", "x"), ("b", "x"), ("a", "y")]
    f = spark.createDataFrame([(c, float(i)) for i, c in enumerate("abcde")], "feature string, importance double")
    assert [r[0] for r in selection.least_important(f, "feature", "importance", 0.5).collect()] == ["a", "b"]
    assert {r["feature"]: r["importance"] for r in selection.top_drivers(f, "feature", "importance", 2).collect()} == {"e": 4, "d": 3, "other": 3}


def test_lists_and_verdicts():
    assert selection.variants(["a", "b"], {"all": set(), "same": {"z"}, "no_b": {"b"}}) == {"all": ["a", "b"], "no_b": ["a"]}
    assert selection.accounted(["a", "c"], ["a"])["missing"] == ["c"] and selection.token_groups(["first_date", "x"], {"date": ("date",)}) == {"date": ["first_date"]}
    assert [selection.verdict({"a": x, "b": "PASS"}) for x in ("PASS", "WARN", "FAIL")] == ["sound", "doubtful", "inflated"]


def test_ranges_of_three_trees(spark):
    df = spark.createDataFrame([(110.0, [100.0, 110.0, 120.0]), (1.0, [0.0, 1.0, 2.0])], "prediction double, trees array<double>")
    a, b = models.forest_ranges(df, "trees", "prediction", 10.0).collect()
    assert (a["ensemble_low"], a["ensemble_high"]) == pytest.approx((102, 118)) and a["calibrated_low"] == pytest.approx(93.55)
    assert a["calibrated_high"] - a["calibrated_low"] > a["ensemble_high"] - a["ensemble_low"] and b["calibrated_low"] == 0
    with pytest.raises(ValueError):
        models.forest_ranges(df, "trees", "prediction", 10.0, 0.9, 0.1)


def test_trees_average_to_the_forest(spark):
    rows = spark.createDataFrame([(i, float(i % 20), 5.0 * (i % 20)) for i in range(100)], "id int, x double, price double")
    made = models.Features(rows, ["x"])
    forest = models.estimator("forest", numTrees=4, maxDepth=4).fit(made(rows).withColumn("__target", F.col("price")))
    out = models.tree_predictions(forest.transform(made(rows)), forest)
    gap = out.select(F.max(F.abs(F.aggregate("trees", F.lit(0.0), lambda a, x: a + x) / 4 - F.col("__prediction")))).first()[0]
    assert gap < 1e-6
