import pytest
from pricestrata.operators import aggregates, models
from pricestrata.sources import files
from pricestrata.streaming import history
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, i // 2, float(i % 80), "ab"[i % 2], 10.0 * (i % 80) + 5) for i in range(160)], "id int, product_id int, signal double, category string, price double")


def test_grouped_cv_keeps_groups_whole_and_shuffled_targets_are_worthless(spark, rows):
    run = models.fit_predict("forest", numTrees=8, maxDepth=6)
    out = models.grouped_cv(rows, "product_id", ["signal", "category"], run, 3).cache()
    assert out.count() == 160 and out.groupBy("product_id").agg(F.count_distinct("fold").alias("k")).where("k > 1").count() == 0
    real = models.cv_summary(out).first()["r2_mean"]
    train, rest = rows.where("product_id % 4 > 0"), rows.where("product_id % 4 = 0")
    wrong = run(models.shuffled_target(train, "price", "id"), rest, ["signal", "category"]).agg(*aggregates.regression_metrics()).first()["r2"]
    assert real > 0.9 and wrong < real - 0.5


def test_linear_and_boosted_models_and_permutation(spark, rows):
    line = models.fit_predict("linear", regParam=0.0)(rows, rows, ["signal", "category"]).agg(*aggregates.regression_metrics()).first()
    assert line["r2"] > 0.999
    run = models.fit_predict("boosted", maxIter=5)
    gain = models.permutation_importance(rows, ["signal", "category"], ["signal", "category"], "id", run, rows, ["category"])
    assert gain["signal"] > 50 > abs(gain["category"])


def test_unseen_and_rare_levels(spark):
    train = spark.createDataFrame([(float(i), "x" if i < 9 else "rare", 1.0) for i in range(10)], "n double, c string, price double")
    made = models.Features(train, ["n", "c"])
    assert made.levels == {"c": ["x"]}
    out = made(spark.createDataFrame([(None, "new"), (1.0, None)], "n double, c string")).select("features").collect()
    assert [v[0][0] for v in out] == [4.0, 1.0]


def test_searches_are_distinct_and_repeatable():
    a = models.log_uniform_search({"rate": (0.01, 0.3), "depth": [3, 4, 5]}, 12)
    assert a == models.log_uniform_search({"rate": (0.01, 0.3), "depth": [3, 4, 5]}, 12) and len(a) == 12


def test_snapshots_with_drifting_headers(spark, tmp_path):
    head = "part_name,price,quality_grade,year,oem_number,engine_code,mileage,brand,model,category,subcategory"
    line = '"Disc, front (left)",12.5,A1,2010-2015,X,Y,100,Toyota,Corolla,Brakes,Disc'
    (tmp_path / "golf").mkdir()
    (tmp_path / "merged").mkdir()
    (tmp_path / "a.csv").write_text(f"{head}\n{line}\n")
    (tmp_path / "golf" / "b.csv").write_text(f"roduct_id,{head},scrape_date\n7,{line},2026-02-03\n")
    (tmp_path / "c.csv").write_text("part_name,price\nx,1\n")
    (tmp_path / "merged" / "d.csv").write_text(f"{head}\n{line}\n")
    got = files.routed(files.read_snapshots(spark, str(tmp_path)), ("golf", "skoda", "toyota")).orderBy("product_id").collect()
    assert [(r["product_id"], r["part_name"], r["scrape_date"], r["route"]) for r in got] == [(None, "Disc, front (left)", None, None), ("7", "Disc, front (left)", "2026-02-03", "golf")]


def test_encodings_reports_and_round_trips(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes("ä".encode())
    (tmp_path / "l.csv").write_bytes("ä".encode("latin-1"))
    assert files.encoding_of(spark, str(tmp_path / "u.csv")) == "UTF-8" and files.encoding_of(spark, str(tmp_path / "l.csv")) == "ISO-8859-1"
    df = spark.range(5)
    assert files.round_trip(df, str(tmp_path / "t"))
    with pytest.raises(ValueError):
        files.read_splits(spark, [str(tmp_path / "t")] * 2)
    files.write_report(spark, {"mae": 2.0}, str(tmp_path / "r1"))
    files.write_report(spark, {"mae": 1.0}, str(tmp_path / "r2"))
    assert [r["mae"] for r in files.read_reports(spark, str(tmp_path / "r*"), ["mae"]).collect()] == [1.0, 2.0]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    events.write.parquet(str(tmp_path / "in"))
    stream = history.daily_summary(history.snapshots(spark, str(tmp_path / "in"), events.schema), "event_type", "ts", "value")
    q = stream.writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    want = events.groupBy(F.window("ts", "1 day").start.alias("start"), "event_type").agg(F.count("*").alias("n"))
    assert spark.table("daily").select("start", "event_type", "n").exceptAll(want).count() == 0 and spark.table("daily").count() == want.count()
