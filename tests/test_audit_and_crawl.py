"""Integrity checks, ablations, information by nearest neighbours, crawl rounds, streamed histories and guards."""

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pricestrata.operators import aggregates, audit, crawl, history, keys, quality
from pricestrata.streaming import history as streamed
from pyspark.sql import functions as F


def frames(spark):
    schema = "grp string, size double, colour string, price double"
    train = [(f"g{i}", float(i), "red", 2.0 * i + i % 3) for i in range(20)]
    validation = [("g1", 50.0, "blue", 1.0), (None, 51.0, None, 2.0), ("v", 3.0, "red", 6.0)]
    test = [(None, 51.0, None, 2.0), ("g1", 70.0, "red", 9.0), ("v", 3.0, "red", 6.0)]
    return {n: spark.createDataFrame(r, schema) for n, r in (("train", train), ("validation", validation), ("test", test))}


def test_integrity_counts_shared_groups_and_rows_by_pair(spark):
    own = frames(spark)
    got = {r["check"]: (r["status"], r["hits"], r["detail"]) for r in audit.integrity(own, ["size", "colour"], "price", "grp").collect()}
    # g1 is in three splits (three pairs), v in two; null groups are none, null colours are equal. Row 3 is in all three.
    assert got["group_overlap"] == ("FAIL", 4, "")
    assert got["cross_split_exact_duplicates"] == ("FAIL", 4, "")
    assert got["target_in_features"][0] == got["future_or_listing_history_columns"][0] == got["split_specific_preparation"][0] == "PASS"
    clean = {n: df.where("grp is not null").withColumn("grp", F.concat("grp", F.lit(n))).withColumn("size", F.rand(i)) for i, (n, df) in enumerate(own.items())}
    assert {r["status"] for r in audit.integrity(clean, ["size", "colour"], "price", "grp").collect()} == {"PASS"}
    wide = {n: df.withColumns({"twice": 2 * F.col("price") - 1, "same": F.lit(1.0), "times_observed": F.lit(1), "first_seen_day_offset": F.lit(2)}) for n, df in clean.items()}
    got = {r["check"]: (r["status"], r["hits"], r["detail"]) for r in audit.integrity(wide, ["twice", "same", "price", "times_observed", "first_seen_day_offset"], "price", "grp").collect()}
    assert got["target_in_features"] == ("FAIL", 1, "price") and got["deterministic_or_near_target_numeric_features"] == ("FAIL", 1, "twice")
    assert got["future_or_listing_history_columns"] == ("FAIL", 1, "times_observed") and got["split_specific_preparation"] == ("WARN", 1, "first_seen_day_offset")


def test_verdict():
    sound = {"a": "PASS"}
    assert audit.verdict({"a": "FAIL"}, 0.9)[0] == "inflated"
    assert audit.verdict(sound, 0.9, 0.41)[0] == "inflated" and audit.verdict(sound, 0.9, 0.39)[0] == "sound"
    assert audit.verdict(sound, 0.6, 0.26)[0] == "inflated" and audit.verdict(sound, 0.6, 0.24)[0] == "sound"
    assert audit.verdict({"a": "WARN"}, 0.9)[0] == audit.verdict(sound, 0.9, None, 0.91)[0] == audit.verdict(sound, 0.9, None, None, 1)[0] == "doubtful"
    assert audit.verdict(sound, 0.9, -0.2, 0.9)[0] == "sound"


def test_ablations_name_feature_lists(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, "x")], "part_name string, size double, old_age double, part_id string")
    got = audit.ablations(df, df.columns, {"id": ["part_id"], "none": []}, ["part_name", "size", "gone"])
    assert got["all"] == df.columns and got["without_id"] == ["part_name", "size", "old_age"] and got["baseline_only"] == ["part_name", "size"]
    assert got["baseline_and_id"] == ["part_name", "size", "part_id"] and got["id_only"] == ["part_id"] and "none_only" not in got
    assert got["categorical_only"] == ["part_name", "part_id"] and got["numeric_only"] == ["size", "old_age"]


def brute_information(x, y, k=3):
    n, total = len(x), 0.0
    psi = lambda m: -np.euler_gamma + sum(1 / i for i in range(1, m))
    for i in range(n):
        r = sorted(max(abs(x[i] - x[j]), abs(y[i] - y[j])) for j in range(n))[k]
        total += psi(max(1, sum(abs(x[i] - v) < r for v in x))) + psi(max(1, sum(abs(y[i] - v) < r for v in y)))
    return max(0.0, psi(n) + psi(k) - total / n)


def brute_labels(label, y, k=3):
    psi = lambda m: -np.euler_gamma + sum(1 / i for i in range(1, m))
    own = [(g, v) for g, v in zip(label, y) if list(label).count(g) > 1]
    total = 0.0
    for g, v in own:
        same = sorted(abs(v - w) for h, w in own if h == g)
        j = min(k, len(same) - 1)
        total += psi(j) - psi(len(same)) - psi(max(1, sum(abs(v - w) < same[j] for _, w in own)))
    return max(0.0, psi(len(own)) + total / len(own))


@pytest.mark.parametrize("n", [60, 500])
def test_information_equals_brute_force(spark, n):
    r = random.Random(n)
    y = [r.gauss(0, 1) for _ in range(n)]
    rows = [(i, v, v * v + r.gauss(0, 0.1), r.gauss(0, 1), "hot" if r.random() < 0.4 else f"c{int(v)}" if r.random() < 0.9 else f"only{i}") for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "i long, y double, tied double, free double, kind string").repartition(3)
    got = {g["feature"]: g["mutual_information"] for g in audit.mutual_information(df, {c: F.col(c) for c in ("tied", "free", "kind")}, F.col("y"), "i", noise=0.0).collect()}
    scaled = lambda i: (lambda v: v / v.std())(np.array([x[i] for x in rows]))
    assert abs(got["tied"] - brute_information(scaled(2), scaled(1))) < 1e-9 and abs(got["free"] - brute_information(scaled(3), scaled(1))) < 1e-9
    assert abs(got["kind"] - brute_labels([x[4] for x in rows], scaled(1))) < 1e-9
    assert n < 100 or got["tied"] > 0.5 > 0.2 > got["free"]


def test_information_of_gaps_ties_few_rows_and_a_bound(spark):
    rows = [(i, float(i % 4), None if i % 3 else 1.0, None) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, y double, x double, t string")
    both = {c: F.col(c) for c in ("x", "t")}
    a, b = (sorted(map(tuple, audit.mutual_information(df.repartition(n), both, F.col("y"), "i", rows=200).collect())) for n in (1, 5))
    assert a == b and all(r[1] == 200 and r[2] >= 0 for r in a)
    assert [r["mutual_information"] for r in audit.mutual_information(df.limit(2), both, F.col("y"), "i").collect()] == [0.0, 0.0]


def test_reached_equals_breadth_first_search(spark):
    r = random.Random(3)
    links = [(r.randrange(80), r.randrange(80)) for _ in range(110)] + [(5, None), (None, 6), (1, 1), (1, 1)]
    seeds = [1, 40, None, 1]
    table = spark.createDataFrame(links, "src long, dst long"), spark.createDataFrame([(s,) for s in seeds], "node long")
    for rounds in (0, 2, None):
        want, now, at = {1: 0, 40: 0}, {1, 40}, 0
        while now and (rounds is None or at < rounds):
            at += 1
            now = {d for s, d in links if s in now and d is not None and d not in want}
            want |= dict.fromkeys(now, at)
        got = crawl.reached(*table, rounds).collect()
        assert len(got) == len(want) and {g["node"]: g["round"] for g in got} == want
    assert crawl.reached(table[0], table[1].limit(0)).collect() == []


def test_a_stream_of_shuffled_files_ends_as_the_batch_does(spark, tmp_path):
    r = random.Random(8)
    rows = [(f"e{r.randrange(12)}", i, date(2024, 1, 1) + timedelta(days=r.randrange(40)), r.choice([None, 10.0, 12.0, 9.5])) for i in range(200)]
    schema = "entity string, row long, day date, price double"
    r.shuffle(rows)
    files, kept = str(tmp_path / "in"), str(tmp_path / "kept")
    want = {x["row"]: x.asDict() for x in history.point_in_time(spark.createDataFrame(rows, schema), "entity", "day", "price", "row").collect()}
    for k in range(4):  # more files land between the runs
        spark.createDataFrame(rows[k * 50 : k * 50 + 50], schema).repartition(2).write.mode("append").parquet(files)
        if k in (1, 3):
            stream = streamed.snapshots(spark, files, spark.createDataFrame([], schema).schema, 1)
            streamed.keep_histories(stream, kept, "entity", "day", "price", "row", buckets=4).awaitTermination()
    got = {x["row"]: x.asDict() for x in streamed.histories(spark, kept).collect()}
    assert got == want


def test_guards_of_joins_and_keys(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "id int, k string")
    right = spark.createDataFrame([("a", 10)], "k string, v int")
    joined = quality.lookup_join(left, right, ["k"], ["k"], marker="found")
    with pytest.raises(ValueError, match="b"):
        quality.require_matched(joined, "found", ["k"])
    assert quality.require_matched(joined.where("id = 1"), "found", ["k"]).columns == ["id", "k", "v"]
    makers = spark.createDataFrame([("bmw",)], "maker string")
    keyed = lambda rows: spark.createDataFrame(rows, "key_status string, key_brand string, key_model string")
    fine = keyed([(keys.STATUSES[1], "bmw", "x"), (keys.STATUSES[0], "other", "y")])
    assert keys.assert_clean(fine, makers).count() == 2
    for bad in ([(keys.STATUSES[1], "brake", "x")], [(keys.STATUSES[0], "bmw", keys.STATUSES[0])]):
        with pytest.raises(ValueError, match="contaminated"):
            keys.assert_clean(keyed(bad), makers)
    assert quality.same_columns(left, left.select("k", "id")) and not quality.same_columns(left, right)


def test_bands_empty_combinations_coverage_and_offsets(spark):
    rows = spark.createDataFrame([("low", 0.5, 1.0), ("low", 2.0, 1.0), ("high", 10.0, 12.0)], "b string, actual double, predicted double")
    got = {r["band"]: r for r in aggregates.error_bands(rows, F.col("b")).collect()}
    assert got["low"]["mape"] == 0.5 and got["low"]["mae"] == 0.75 and abs(got["high"]["mape"] - 0.2) < 1e-12
    counts = aggregates.with_empty(rows.groupBy("b").agg(F.count("*").alias("n")), {"b": ["low", "middle"]})
    assert sorted(map(tuple, counts.collect())) == [("high", 1), ("low", 2), ("middle", 0)]
    now, before = (quality.profile(spark.createDataFrame(x, "a int, c int")) for x in ([(1, None), (None, None)], [(1, 1), (2, None)]))
    assert sorted(map(tuple, quality.coverage_change(now, before).collect())) == [("a", 1, 50.0, 0, 50.0), ("c", 2, 100.0, 1, 50.0)]
    a = spark.createDataFrame([(date(2024, 1, 5), date(2024, 1, 9))], "first date, last date")
    b = spark.createDataFrame([(date(2024, 1, 2), date(2024, 1, 2))], "first date, last date")
    out = history.with_day_offsets({"train": a, "validation": b}, {"o_first": "first", "o_last": "last"}, "first")
    assert tuple(out["train"].first())[2:] == (3, 7) and tuple(out["validation"].first())[2:] == (0, 0)
