"""Small cases whose results are worked out by hand."""

import datetime as dt

import pytest
from pricestrata.functions import numeric as N
from pricestrata.functions import pages as P
from pricestrata.functions import text as X
from pricestrata.operators import aggregates as A
from pricestrata.operators import history as H
from pricestrata.operators import keys as K
from pricestrata.operators import market as M
from pricestrata.operators import quality as Q
from pricestrata.operators import splits as S
from pyspark.sql import functions as F


def one(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("c"))).collect()]


@pytest.mark.parametrize(("f", "given", "want"), [
    (N.to_number, ["1e3", " 5 ", "1_000", "abc", "5d", "0x10", None], [1000, 5, None, None, None, None, None]),
    (N.count_number, ["1 234", "1,5", "-", "x"], [1234, 1.5, None, None]),
    (X.key, ["a  b", " NaN ", "", "Ä  B"], ["a b", None, None, "ä b"]),
    (X.brand_key, ["VW", "Volkswagen, vw", "skida", "Audi"], ["volkswagen", "volkswagen", "skoda", "audi"]),
    (lambda c: F.concat_ws("|", *(F.coalesce(p, F.lit("null")) for p in X.split_range(c))), ["2019-2027", None, "2010"], ["2019|2027", "null|null", "2010|null"]),
    (lambda c: N.finnish_date(c).cast("string"), ["1.2.2020", "01.02.2020", "99.99.2020"], ["2020-02-01", "2020-02-01", None]),
    (lambda c: N.compact_date(c).cast("string"), ["20110000", "20110101.0", "20110101", "x"], ["2011-01-01"] * 3 + [None]),
    (X.is_total, ["ABC YHTEENSÄ", "abc", None], [True, False, False]),
    (lambda c: X.clean_part_name(c, F.lit("Toyota"), F.lit("Corolla, -e")), ["Toyota Corolla Brake (2010-2015) to", "toyota", None], ["Brake", "Unknown Part", "Unknown Part"]),
    (lambda c: F.concat_ws("|", *(F.coalesce(p, F.lit("-")) for p in X.side_and_position(c))), ["right rear", "Lamp (left)", "none"], ["Right|Rear", "Left|-", "-|-"]),
    (X.label_key, ["Disc [x] (y)", "Lamp"], ["disc", "lamp"]),
    (X.display_label, ["brake disc ,-", "either side"], ["Brake disc", "Either side"]),
    (lambda c: X.url_join("https://a.b/c/", c), ["/d", "e", "http://x"], ["https://a.b/d", "https://a.b/c/e", "http://x"]),
    (X.url_key, ["A%20B", "%zz"], ["a b", "%zz"]),
    (lambda c: X.without_prefix(c, F.lit("alfa romeo")), ["alfa-romeo 147", "alfa romeo", "alfa romeos"], ["147", None, "alfa romeos"]),
    (P.oem_number, ["oem no: AB12, PN: CD345678", "PN-123456"], ["CD345678", "123456"]),
    (P.engine_code, ["Moottorin koodi: 2019AB Engine code: 2ZR-FXE", "Engine code: abc"], ["2ZRFXE", None]),
    (P.mileage, ["Lukema (km): 123 456", "12.345 km", "none"], [123456, 12345, None]),
    (P.price, ['<script type="application/ld+json">{"offers": {"price": "12,5"}}</script>', "<p>"], [12.5, None]),
    (P.part_name, ["<h1> Disc &amp; pad </h1>", "<title>Lamp | Shop</title>", "<title>Lamp - Shop</title>", "x"], ["Disc & pad", "Lamp", "Lamp", None]),
    (P.years, ["x (2010 - 2015) y", "z"], ["2010-2015", None]),
    (P.wanted_category, [" brakes ", "Seats"], [True, False]),
])
def test_texts(spark, f, given, want):
    assert one(spark, given, f) == want


def test_numbers(spark):
    assert one(spark, [5.0, None, 20.0], lambda c: N.share(c > 10).over(__import__("pyspark").sql.Window.partitionBy()), "double")[0] == pytest.approx(1 / 3)
    assert one(spark, [0.125, 0.375], N.half_even, "double") == [0.12, 0.38]
    assert one(spark, [2004, 2005, 2009, 1949, 2030], N.year_band, "int") == ["pre_2005", "2005_2009", "2005_2009", "pre_2005", None]
    assert one(spark, [-1.0, 0.0, 25.0, 1000.0], lambda c: N.fixed_bins(c, [0, 25, 50, 1000, float("inf")], ["a", "b", "c", "d"], right=False), "double") == [None, "a", "b", "d"]
    assert one(spark, [float("nan"), 1.0], N.no_nan, "double") == [None, 1.0]
    assert one(spark, [float("nan"), -3.0, 7.0, float("inf")], lambda c: N.to_euros(c, False, 10.0), "double") == [0, 0, 7, 0]
    assert one(spark, [float("inf"), float("-inf"), 0.0], lambda c: N.to_euros(c, True, 10.0), "double") == pytest.approx([100, 1e-3, 1])
    edges = spark.createDataFrame([(float(x),) for x in (1, 1, 1, 2, 3, 4, 5, 6, 7, 8)], "x double").agg(N.quantile_edges(F.col("x"))).first()[0]
    assert edges == pytest.approx([1, 2.6, 4.4, 6.2, 8])
    assert one(spark, [1.0, 2.6, 2.7, 8.0], lambda c: N.bin_of(c, F.lit(edges)), "double") == [0, 0, 1, 3]


def test_identities_and_fingerprints(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), ("a|b", "c"), ("a", "b|c"), ("1:a", "")], "x string, y string")
    for f in (X.fingerprint, X.identity):
        assert df.select(f(F.col("x"), F.col("y")).alias("k")).distinct().count() == 5


def test_histories(spark):
    day = dt.date(2026, 2, 1)
    rows = [("p", i, day + dt.timedelta(days=i), v) for i, v in enumerate([None, 5.0, 5.0, None, 7.0])]
    df = spark.createDataFrame(rows, "id string, i int, d date, price double")
    got = H.point_in_time(df, "id", "d", "price", "i").orderBy("i").collect()
    assert [r["first_price"] for r in got] == [None, 5, 5, 5, 5] and [r["price_change_event"] for r in got] == [0] * 5
    whole = H.full_history(df, "id", "d", "price", "i").first()
    assert (whole["price_changes"], whole["first_price"], whole["last_price"], whole["span_days"], whole["percent_change"]) == (1, 5, 7, 4, 40)
    same_day = spark.createDataFrame([(1, 0, None, "a"), (1, 1, "x", "b"), (1, 2, "y", "c"), (2, 3, None, None)], "id int, i int, u string, v string")
    assert sorted(r["i"] for r in H.fullest_per_day(same_day, ["id"], "i").collect()) == [1, 3]


def test_lifecycles(spark):
    df = spark.createDataFrame([("a", 2016, 9), ("a", 2019, 9), ("a", 2022, 2), ("b", 2020, 0), (None, 2018, 1)], "brand string, y int, n int")
    got = {r["brand"]: r for r in A.lifecycle(df, ["brand"], "y", "n").collect()}
    assert (got["a"]["peak_year"], got["a"]["peak_count"], got["a"]["recent_share"], got["a"]["year_span"]) == (2016, 9, 0.1, 6)
    assert got["b"]["total"] == 0 and got["b"]["peak_year"] is None and got["b"]["mean_year"] is None and got[None]["old_share"] == 1


def test_group_modes_and_constant_correlation(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), (None, 2.0, 1.0)], "k string, x double, c double")
    assert A.group_summary(df, ["k"], ["x"]).count() == 2 and A.group_summary(df, ["k"], ["x"], keep_nulls=False).count() == 1
    assert A.correlations(df, ["x", "c"]).first()["correlation"] is None


def test_guards_and_joins(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, "b")], "id int, v string")
    for bad in (lambda: Q.require_unique(df, ["id"]), lambda: Q.require_no_nulls(df, ["v"]), lambda: Q.require_columns(df, ["id", "w"]), lambda: Q.lookup_join(df, df, ["id"], ["id"])):
        with pytest.raises(ValueError):
            bad()
    right = spark.createDataFrame([("a", 9), (None, 8)], "v string, z int")
    got = {(r["id"], r["v"]): (r["z"], r["m"]) for r in Q.lookup_join(df, right, ["v"], ["v"], marker="m").collect()}
    assert got == {(1, "a"): (9, "both"), (2, None): (None, "left_only"), (2, "b"): (None, "left_only")}
    train = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 10.0)], "k string, y double")
    seen = K.median_lookup(train, spark.createDataFrame([(None,), ("a",), ("z",)], "k string"), ["k"], "y").collect()
    assert {r["k"]: r["predicted"] for r in seen} == {None: 2.0, "a": 10.0, "z": 3.0}


def test_keys(spark):
    labels = spark.createDataFrame([("alfa romeo 147",), ("alfa romeos",), ("skoda",), ("x y",)], "label string")
    aliases = spark.createDataFrame([("alfa romeo", "alfa romeo"), ("alfa", "alfa"), ("skoda", "skoda")], "alias string, brand string")
    got = {r["label"]: (r["brand"], r["model"]) for r in K.longest_prefix(labels, "label", aliases).collect()}
    assert got == {"alfa romeo 147": ("alfa romeo", "147"), "alfa romeos": ("alfa", "romeos"), "skoda": ("skoda", None), "x y": (None, "x y")}
    pairs = spark.createDataFrame([("toyota", "corolla"), ("vw", "golf"), ("seat", "golf"), ("vw", "polo")], "brand string, model string")
    rows = spark.createDataFrame([(1, "toyota", "corolla"), (2, "corolla", "brakes"), (3, "golf", "brakes"), (4, "kia", "brake disc"), (5, "kia", "rio")], "i int, brand string, model string").withColumns({"category": F.lit("brakes"), "subcategory": F.lit("disc")})
    got = K.repaired(K.looks_like_taxonomy(rows, "model", "category", "subcategory"), pairs).orderBy("i").collect()
    assert tuple(r["key_status"] for r in got) == K.STATUSES and (got[1]["key_brand"], got[1]["key_model"]) == ("toyota", "corolla")


@pytest.mark.parametrize("k", [2, 3, 4, 5])
def test_splits_and_folds(spark, k):
    import random

    r = random.Random(k)
    sizes = {g: r.choice([1, 1, 1, 2, 3, 9, 40]) for g in range(57)}
    df = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "g int")
    load, want = [0] * k, {}
    for g in sorted(sizes, key=lambda g: (-sizes[g], g)):
        want[g] = load.index(min(load))
        load[want[g]] += sizes[g]
    assert {x["g"]: x["fold"] for x in S.group_folds(df, "g", k).collect()} == want
    split = S.group_split(spark.range(10).toDF("g"), "g").groupBy("split").count().collect()
    assert {x["split"]: x["count"] for x in split} == {"train": 7, "validation": 2, "test": 1}


REFERENCE = [
    (1, "Brake Caliper", "toyota", "rear", "A2", 100000, 200.0, 2010, 2015),
    (2, "Brake Caliper", "toyota", "rear", "A1", 120000, 220.0, 2010, 2015),
    (3, "Brake Disc", "toyota", "front", "B1", 80000, 150.0, 2012, 2018),
    (4, "Contact Roll Airbag", "toyota", "contact roll airbag", "A2", 90000, 180.0, 2010, 2015),
    (5, "Brake Caliper", "vw (golf)", "rear", "A2", 110000, 210.0, 2011, 2016),
    (6, "Brake Caliper", "toyota", "rear", "A3", 130000, 210.0, 2010, 2015),
    (7, "Brake Caliper", "toyota", "rear", "B1", 140000, 205.0, 2010, 2015),
    (8, "Brake Caliper", "toyota", "rear", "B2", 150000, 230.0, 2010, 2015),
]


def test_market(spark):
    ref = spark.createDataFrame(REFERENCE, "ref_id int, part_name string, brand string, subcategory string, quality_grade string, mileage int, price double, year_start int, year_end int").withColumns({"model": F.lit("corolla"), "category": F.lit("Brakes")})
    assert Q.equal_filters(ref, {"brand": "toyota", "model": "Any", "year_start": None}).count() == 7
    asked = spark.createDataFrame([(1, "Brake Caliper", "toyota", "", None, "rear", 125000, 215.0), (2, "Unknown", "kia", "", None, "x", 1000, 215.0)], "query_id int, part_name string, brand string, model string, quality_grade string, subcategory string, mileage int, prediction double")
    got = {r["query_id"]: r for r in M.comparable_range(asked, ref).collect()}
    assert got[1]["source"] == "comparable_rows" and got[1]["comparables"] == 5 and got[1]["low"] <= 215 <= got[1]["high"] and got[1]["high"] - got[1]["low"] >= 30
    assert (got[2]["low"], got[2]["high"], got[2]["comparables"]) == (140.0, 290.0, 0)
    full = M.completed_input(ref, {"brand": "toyota", "part_name": "Brake Disc", "year_start": 2010, "year_end": 2015}, "ref_id")
    assert full["year_span"] == 5 and full["year_mid"] == 2012.5 and full["mileage_missing_flag"] is False
    assert M.error_scale({"test_RMSE": 62.5, "validation_MAE": 1}) == 62.5 and M.error_scale({"validation_MAE": 18.0}) == 18.0
    with pytest.raises(ValueError):
        M.error_scale({})


def test_crawl_cap_and_links(spark):
    rows = spark.createDataFrame([(i, i % 12, "c", "s") for i in range(24)], "page_id int, product_id int, category string, subcategory string")
    assert sorted(r["product_id"] for r in P.capped_crawl(rows).collect()) == [0, 1, 2, 3, 4]
    html = spark.createDataFrame([(1, "u", '<a class="x" href="/car-parts/toyota/ID-77">a</a><a href="/car-parts/toyota/s12">b</a>'), (2, "u", "<a href='/ID-77'>c</a>")], "page_id int, url string, html string")
    links = P.links(html)
    assert [tuple(r) for r in P.product_links(links).collect()] == [("77", 1, "/car-parts/toyota/ID-77")]
    assert [r["href"] for r in P.category_links(links, "Toyota", "Corolla").collect()] == ["/car-parts/toyota/ID-77"]
