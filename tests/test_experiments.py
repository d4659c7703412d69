import pytest
from pricestrata.functions import numeric
from pricestrata.operators import catalogue, experiments, explain
from pricestrata.operators.experiments import Config, Variant
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def splits(spark):
    rows = [(i, float(i % 7), "abc"[i % 3], 10.0 + 3 * (i % 7) + 5 * (i % 3)) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, size double, kind string, price double")
    return df.where("id % 3 = 0 or id % 5 = 0"), df.where("id % 5 = 1"), df.where("id % 5 = 2")


def test_grid_ranks_trusted_lists_first_and_reports_come_back(spark, splits, tmp_path):
    train, validation, test = splits
    leaky = [df.withColumn("twice", F.col("price") * 2) for df in splits]
    wanted = {"both": Variant(["size", "kind", "size", "gone"]), "size": Variant(["size"]), "again": Variant(["gone", "size"]), "none": Variant(["gone"]), "leak": Variant(["twice"], False)}
    configs = {"raw": Config("linear", min_frequency=1), "log": Config("linear", True, 1), "forest": Config("forest", options={"numTrees": 3})}
    out = experiments.grid(leaky[0], leaky[1], "price", wanted, configs)
    got = out.collect()
    assert len(got) == 9 and [r["place"] for r in got] == list(range(1, 10)) and {r["variant"] for r in got} == {"both", "size", "leak"}
    assert [r["trusted"] for r in got] == [True] * 6 + [False] * 3
    assert (got[0]["variant"], got[0]["config"], got[0]["missing"]) == ("both", "raw", ["gone"]) and got[0]["mae"] < 1e-6 and got[0]["selected"] and not got[1]["selected"]
    best = experiments.write_reports(out, out.select("variant", "config", "mae"), str(tmp_path))
    assert experiments.read_best(spark, str(tmp_path)) == best
    back = spark.read.option("header", True).csv(f"{tmp_path}/comparison").collect()
    assert len(back) == 9 and {r["features"] for r in back} == {'["size","kind"]', '["size"]', '["twice"]'}
    one = experiments.held_out(train, validation, test, "price", best).first()
    assert one["mae"] < 1e-6 and one["fit_rows"] == train.count() + validation.count() and one["test_rows"] == test.count() and one["feature_count"] == 2
    with pytest.raises(ValueError):
        experiments.held_out(train, validation, test, "price", best, "forest")


def test_grid_of_nothing_and_of_untrusted_lists(splits):
    train, validation, _ = splits
    with pytest.raises(ValueError):
        experiments.grid(train, validation, "price", {"x": Variant(["gone"])}, {"raw": Config("linear")})
    one = experiments.grid(train, validation, "price", {"x": Variant(["size"], False)}, {"raw": Config("linear")}).first()
    assert one["selected"] and not one["trusted"]


def test_audit_of_columns(spark):
    df = spark.createDataFrame([(1, None, "a", 2.0), (2, 3, None, 4.0)], "id int, n int, s string, price double")
    got = {r["feature"]: (r["status"], r["filled_share"]) for r in experiments.feature_audit(df, "price", ["n", "gone"], {"id": "a key"}, {"later": "leaks", "id": "leaks"}).collect()}
    assert got == {"id": ("excluded", 1.0), "later": ("leaking", None), "n": ("kept", 0.5), "s": ("new", 0.5), "gone": ("missing", None)}
    empty = experiments.feature_audit(df.limit(0), "price", [], {}, {}).collect()
    assert {r["filled_share"] for r in empty} == {None}


def test_families():
    columns = ["product_id", "price", "part_name", "oem_number", "brand", "model_total_registered", "model_firstreg_peak_year", "model_ev_share", "times_observed", "first_seen_day_offset", "last_seen_day_offset", "last_seen_date", "own"]
    boosted, forest = catalogue.family_catalogue(columns, "boosted"), catalogue.family_catalogue(columns, "forest")
    assert list(boosted) == list(catalogue.FAMILIES["boosted"]) and list(forest) == list(catalogue.FAMILIES["forest"])
    assert forest == catalogue.family_catalogue(columns, "linear")
    assert boosted["lifecycle_without_oem"] == ["part_name", "brand", "model_total_registered", "model_firstreg_peak_year"]
    assert not {"times_observed", "last_seen_day_offset", "last_seen_date", "price"} & {c for own in (*boosted.values(), *forest.values()) for c in own}
    assert forest["safe_without_offsets_or_oem"] == ["part_name", "brand", "model_total_registered", "model_firstreg_peak_year", "model_ev_share", "own"]
    assert list(catalogue.family_catalogue(["part_name"], "boosted")) == ["lifecycle"]
    with pytest.raises(ValueError):
        catalogue.family_catalogue(columns, "other")


def test_raw_features(spark):
    names = ["num__a_b", "cat__a_b_c", "cat__a_x", "cat__a", "cat__ab_x", "z", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(explain.raw_feature(F.col("n"), ["a", "a_b"])).collect()] == ["a_b", "a_b", "a", "a", "ab_x", "z", None]


def test_local_stamps(spark):
    df = spark.sql("SELECT * FROM VALUES (TIMESTAMP'2026-03-29 00:59:59.9'), (TIMESTAMP'2026-03-29 01:00:00'), (TIMESTAMP'2025-12-31 22:30:00'), (NULL) AS v(t)")
    assert [tuple(r) for r in df.select(*numeric.local_stamp(F.col("t"))).collect()] == [("2026-03-29", "2026-03-29T02:59:59+02:00"), ("2026-03-29", "2026-03-29T04:00:00+03:00"), ("2026-01-01", "2026-01-01T00:30:00+02:00"), (None, None)]
    assert df.select(numeric.local_stamp(F.col("t"), "America/St_Johns")[1]).first()[0] == "2026-03-28T22:29:59-02:30"
    assert df.select(numeric.local_stamp()[1]).first()[0][-6:] in ("+02:00", "+03:00")
