import itertools

import pytest
from pricestrata.functions import text
from pricestrata.operators import aggregates, catalogue, explain, serving
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, float(i % 80) if i % 9 else None, "ab"[i % 2] if i % 7 else None, 10.0 * (i % 80) + 5) for i in range(160)], "id int, signal double, category string, price double")


@pytest.fixture(scope="module")
def bundle(rows):
    return serving.fitted(rows, ["signal", "category"], metrics={"validation_MAE": 2.0, "test_RMSE": 10.0}, name="one", numTrees=6, maxDepth=5)


def model(a, b, c):
    return 3.0 * a + a * b - (5.0 if c == "x" else 0.0)


def exact(x, grounds):
    """Shapley values of model by all orders of its three features."""
    out = [0.0] * 3
    cases = [(g, o) for g in grounds for o in itertools.permutations(range(3))]
    for g, o in cases:
        now = list(g)
        for i in o:
            before = model(*now)
            now[i] = x[i]
            out[i] += (model(*now) - before) / len(cases)
    return out


def test_effects_near_exact_values_and_adding_up(spark):
    data = [(1, 1.0, 2.0, "x"), (2, 0.0, 0.0, "y"), (3, -1.0, 4.0, None)]
    df = spark.createDataFrame(data, "id int, a double, b double, c string")
    predict = lambda d: d.withColumn("predicted", 3.0 * F.col("a") + F.col("a") * F.col("b") - F.when(F.col("c") == "x", 5.0).otherwise(0.0))
    grounds = [(0.5, 1.0, "y"), (2.0, -1.0, None)]
    background = spark.createDataFrame(grounds, "a double, b double, c string")
    got = explain.effects(df, "id", ["a", "b", "c"], background, predict, pairs=60).cache()
    by = {(r["id"], r["feature"]): r for r in got.collect()}
    assert len(by) == 9
    for i, *x in data:
        want = exact(x, grounds)
        assert [by[i, f]["effect"] for f in "abc"] == pytest.approx(want, abs=0.5)
        assert by[i, "a"]["base"] + sum(by[i, f]["effect"] for f in "abc") == pytest.approx(model(*x), abs=1e-9)
        assert by[i, "a"]["predicted"] == pytest.approx(model(*x)) and by[i, "a"]["base"] == pytest.approx(sum(model(*g) for g in grounds) / 2)
    assert explain.checked(got, "id").first()["sound"]
    long = explain.long_table(got, df, "id", ["a", "b", "c"])
    top = explain.local_table(long, "id", 3, 2).collect()
    assert [r["feature"] for r in top] == ["a", "c"] or [r["feature"] for r in top] == ["a", "b"]
    shares = explain.group_importances(got, catalogue.feature_groups(["a", "b", "c"])).collect()
    assert [(r["group"], round(r["share"], 6)) for r in shares] == [("other", 1.0)]


def test_unsound_and_empty_explanations(spark):
    kinds = "id int, feature string, effect double, base double, predicted double"
    for effect in (float("nan"), float("inf"), None, 1e7, 5.0):
        assert not explain.checked(spark.createDataFrame([(1, "a", effect, 0.0, 1.0)], kinds), "id").first()["sound"]
    assert not explain.checked(spark.createDataFrame([], kinds), "id").first()["sound"]
    df = spark.createDataFrame([], "id int, a double")
    assert explain.effects(df, "id", ["a"], spark.createDataFrame([(1.0,)], "a double"), lambda d: d.withColumn("predicted", F.col("a"))).count() == 0
    with pytest.raises(ValueError):
        explain.effects(df, "id", ["a"], df, lambda d: d)


def test_encoded_effects_sum_to_raw_features(spark):
    df = spark.createDataFrame([(1, "brand_a", 1.0), (1, "brand_b", -0.25), (1, "size", 2.0)], "id int, column string, effect double")
    raw = F.when(F.startswith("column", F.lit("brand_")), "brand").otherwise(F.col("column"))
    assert sorted(map(tuple, explain.raw_effects(df, "id", raw).collect())) == [(1, "brand", 0.75), (1, "size", 2.0)]


def test_bundle_reads_back_as_it_was(spark, rows, bundle, tmp_path):
    serving.save_bundle(bundle, str(tmp_path / "b"))
    back = serving.load_bundle(spark, str(tmp_path / "b"))
    assert back.metadata == bundle.metadata and back.reference.count() == 160
    a, b = (sorted(map(str, x.ranges(rows).collect())) for x in (bundle, back))
    assert a == b
    r = bundle.ranges(rows).where("signal = 40 and category is not null").first()
    assert r["ensemble_low"] <= r["predicted"] <= r["ensemble_high"] and r["calibrated_high"] == pytest.approx(r["predicted"] + 16.45)


def test_exported_bundles(spark, rows, tmp_path):
    train, validation, test = (rows.where(f"id % 4 in ({x})") for x in ("0, 1", "2", "3"))
    out = serving.export_bundles(train, validation, test, str(tmp_path), ["signal", "category"], kind="linear", metrics={"test_MAE": 4.0})
    assert [(k, v.metadata["split"], v.metadata["fit_rows"]) for k, v in out.items()] == [("development", serving.DEVELOPMENT, 120), ("full", serving.FULL, 160)]
    back = serving.load_bundle(spark, str(tmp_path / "development"))
    assert back.ranges(test).count() == 40


def test_service(bundle):
    assert serving.health(bundle) == {"status": "ok", "kind": "forest", "split": serving.FULL, "name": "one"}
    assert serving.model_info(bundle)["feature_count"] == 2
    code, out = serving.predict(bundle, {"rows": [{"signal": 70.0, "category": "a", "more": 1}, {"signal": None, "category": "new"}, {"signal": "1", "category": "b"}]})
    a, b, c = out["predictions"]
    assert code == 200 and a["predicted"] > b["predicted"] > c["predicted"] and set(a) == {"predicted", "calibrated_low", "calibrated_high", "range_width", "ensemble_low", "ensemble_high", "ensemble_width"}
    assert serving.predict(bundle, {"rows": [{"signal": 1.0}]})[0] == 400
    assert serving.predict(bundle, {"rows": [{"signal": "far", "category": "a"}]})[0] == 400
    assert serving.predict(bundle, {"rows": []})[0] == 400
    assert serving.predict(bundle, {"rows": [{"signal": 1.0, "category": "a"}], "lower_quantile": 0.5})[0] == 422


def test_catalogue():
    columns = ["product_id", "price", "part_name", "oem_number", "brand", "model_total_registered", "model_firstreg_peak_year", "model_ev_share", "times_observed", "first_seen_day_offset", "last_seen_day_offset", "last_seen_date", "own"]
    got = catalogue.catalogue(columns)
    assert list(got) == [f"{pool}{end}" for pool, ends in (("lifecycle", 2), ("extended", 2), ("chosen_safe", 2), ("safe", 4)) for end in list(catalogue.EXCLUSIONS)[:ends]]
    assert got["lifecycle"] == ["part_name", "oem_number", "brand", "model_total_registered", "model_firstreg_peak_year"]
    assert got["chosen_safe"] == [*got["lifecycle"], "model_ev_share", "first_seen_day_offset"]
    assert got["safe"] == [*got["chosen_safe"], "own"] and "own" in got["safe_without_offsets_or_oem"] and "oem_number" not in got["safe_without_offsets_or_oem"]
    assert list(catalogue.catalogue(["part_name"])) == ["lifecycle"] and catalogue.catalogue([]) == {}
    assert "times_observed" in catalogue.pools(columns)["usable"] and len(catalogue.LIFECYCLE) == 14
    assert catalogue.feature_groups(["brand", "brand_median_mileage", "mileage", "x"]) == {"brand": "vehicle_identity", "brand_median_mileage": "traficom_brand_context", "mileage": "vehicle_age_usage", "x": "other"}


def test_mutual_information_of_equal_and_independent_columns(spark):
    df = spark.createDataFrame([(i, i % 4, i // 4 % 4, None) for i in range(64)], "i int, a int, b int, c int")
    got = {r["feature"]: r["mutual_information"] for r in aggregates.mi_binned(df, {"a": F.col("a"), "b": F.col("b"), "c": F.col("c")}, F.col("a")).collect()}
    assert got == {"a": pytest.approx(1.3862943611), "b": pytest.approx(0.0, abs=1e-12)}


def test_feature_labels(spark):
    df = spark.createDataFrame([("year_mid", "2012.5"), ("mileage", "125000.0"), ("year_start", "2010.0"), ("part_name", "brake  disc - "), ("own_name", None), ("mileage", "nan"), (None, "x")], "f string, v string")
    got = [tuple(r) for r in df.select(text.feature_label(F.col("f")), text.feature_value(F.col("f"), F.col("v"))).collect()]
    assert got == [("Vehicle generation midpoint", "2012.5"), ("Mileage", "125 000 km"), ("Compatible year start", "2010"), ("Specific part label", "Brake disc"), ("Own name", "Missing"), ("Mileage", "Missing"), ("", "X")]
