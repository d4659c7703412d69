"""The search for settings: its path by a seed, clamps, shared folds and the last fit."""

import json
import random

from pricestrata.operators import search
from pyspark.sql import functions as F

SPACE = {"regParam": (0.01, 100.0), "elasticNetParam": [0.0, 0.5, 1.0]}


def test_refinement_stays_in_range_and_comes_of_the_seed():
    config = {"regParam": 90.0, "elasticNetParam": 1.0}
    got = search.refined(config, SPACE, 20, 2.0)
    assert got == search.refined(config, SPACE, 20, 2.0) and got != search.refined(config, SPACE, 20, 2.0, seed=1)
    assert len(got) == 20 and config not in got and len({json.dumps(c, sort_keys=True) for c in got}) == 20
    assert all(0.01 <= c["regParam"] <= 100.0 and c["elasticNetParam"] in (0.5, 1.0) for c in got) and any(c["regParam"] == 100.0 for c in got)
    assert search.refined({"a": 1}, {"a": [1]}, 3) == []


def test_search_finds_the_features_that_matter_and_refits(spark):
    r = random.Random(2)
    rows = [(f"g{i % 20}", float(i % 37), r.gauss(0, 1), 3.0 * (i % 37) + r.gauss(0, 0.5)) for i in range(200)]
    df = spark.createDataFrame(rows, "grp string, size double, noise double, price double")
    train, rest = df.where("substring(grp, 2) % 5 > 0"), df.where("substring(grp, 2) % 5 = 0")
    calls = []

    def callback(options):
        def run(some, others, features):
            calls.append((options["w"], tuple(features)))
            return others.withColumns({"actual": F.col("price"), "predicted": F.col(features[0]) * options["w"]})

        return run

    variants = {"good": ["size"], "bad": ["noise"]}
    found = search.searched(train, rest, "grp", "price", variants, {"w": (1.0, 9.0)}, n=3, keep=2, near=2, k=3, callback=callback)
    screened, ranked = found.screened.collect(), found.ranked.collect()
    assert len(screened) == 3 * 2 + 2 * 2 and {x["round"] for x in screened} == {"screening", "refinement"}
    assert [x["variant"] for x in ranked] == ["good", "bad"] and found.winner["features"] == ["size"]
    assert found.winner["options"] == json.loads(min((x for x in screened if x["variant"] == "good"), key=lambda x: x["mae"])["options"])
    assert len(calls) == len(screened) + 3 * len(ranked)
    assert found.refit(train, rest).count() == rest.count()
