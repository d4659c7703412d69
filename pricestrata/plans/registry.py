"""All queries of the library over the driver's tables and their SQL, by name.

A name starts with the operators it shows. Doubles that come of sums are rounded to 4 places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import pages as P
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import audit as I
from ..operators import crawl as W
from ..operators import encoding as C
from ..operators import experiments as O
from ..operators import explain as E
from ..operators import history as H
from ..operators import keys as K
from ..operators import market as M
from ..operators import models as D
from ..operators import quality as Q
from ..operators import ranges as G
from ..operators import search as J
from ..operators import selection as L
from ..operators import serving as V
from ..operators import splits as S
from ..operators import trees as B
from ..sources import files as R
from ..sources import ladder as Y
from ..streaming import history as T

FLAGSHIP = "w1_w6_point_in_time"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        name = f.__name__
        _QUERIES[name] = lambda spark, sf_dir: f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def r4(c, name: str):
    return F.round(c, 4).alias(name)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 4).alias(c) if t == "double" else F.col(c).cast("string").alias(c) if t in ("date", "timestamp") else F.col(c) for c, t in df.dtypes))


# Projections, filters and predicates


@query("SELECT p_partkey AS part_id, p_name AS part_name, p_brand AS brand, p_retailprice AS price FROM part")
def p1_p4_prune_and_rename(t):
    return t("part").select("p_partkey", "p_name", "p_brand", "p_retailprice").withColumnsRenamed({"p_partkey": "part_id", "p_name": "part_name", "p_brand": "brand", "p_retailprice": "price"})


@query("SELECT p_brand, p_partkey, p_name, p_type, p_size FROM part")
def p2_p3_drop_and_reorder(t):
    return Q.reordered(t("part").drop("p_retailprice"), ["p_brand", "p_partkey"], ("p_type", "p_size"))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE lower(trim(c_mktsegment)) = 'building' AND c_acctbal BETWEEN 0 AND 5000")
def p5_p6_equal_and_between(t):
    return t("customer").where((F.lower(F.trim("c_mktsegment")) == "building") & F.col("c_acctbal").between(0, 5000)).select("c_custkey", "c_acctbal")


@query("SELECT s_suppkey, CASE WHEN s_acctbal BETWEEN 0 AND 5000 THEN s_acctbal END AS balance, CASE WHEN s_acctbal > 1000 THEN s_acctbal END AS large, CASE WHEN s_acctbal > 1000 THEN 0 ELSE 1 END AS large_missing FROM supplier")
def p7_p8_null_out_of_range(t):
    large = N.above(F.col("s_acctbal"), 1000)
    return t("supplier").select("s_suppkey", N.within(F.col("s_acctbal"), 0, 5000).alias("balance"), large.alias("large"), large.isNull().cast("int").alias("large_missing"))


@query("SELECT event_id, user_id FROM events WHERE value > 50")
def p9_p10_drop_nulls(t):
    return t("events").withColumn("v", N.above(F.col("value"), 50)).dropna(subset=["v"]).select("event_id", "user_id")


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-02-03' AND DATE '1995-02-18' AND o_custkey IS NOT NULL")
def p11_p12_date_window(t):
    day = F.col("o_orderdate").cast("date")
    return t("orders").where(day.between("1995-02-03", "1995-02-18") & F.col("o_custkey").isNotNull()).select("o_orderkey", day.cast("string").alias("day"))


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority IN ('1-URGENT', '2-HIGH')) AS urgent FROM customer")
def p13_p14_membership_flag(t):
    urgent = t("orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_custkey")
    return Q.member(t("customer").select("c_custkey"), ["c_custkey"], urgent, ["o_custkey"], "urgent")


@query("SELECT p_type, count(*) AS n FROM part WHERE regexp_matches(p_type, '(?i)econ|promo|standard') AND NOT regexp_matches(p_type, '(?i)dard$') GROUP BY p_type")
def p15_p16_pattern_search(t):
    return t("part").where(X.contains_word(F.col("p_type"), "econ|promo|standard") & ~X.is_total(F.col("p_type"), "dard")).groupBy("p_type").agg(F.count("*").alias("n"))


@query("SELECT p_partkey FROM part WHERE CAST(p_size AS VARCHAR) = '15'")
def p17_dynamic_filter(t):
    return Q.equal_filters(t("part"), {"p_size": 15, "p_brand": "Any", "p_type": None, "p_name": ""}).select("p_partkey")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 AND l_discount > 0.05 THEN 'bulk' WHEN l_returnflag = 'R' THEN 'returned' WHEN NOT (l_linestatus = 'O') THEN 'closed' ELSE 'open' END AS status FROM lineitem")
def p18_p19_p22_ordered_cases(t):
    status = F.when((F.col("l_quantity") > 40) & (F.col("l_discount") > 0.05), "bulk").when(F.col("l_returnflag") == "R", "returned").when(~(F.col("l_linestatus") == "O"), "closed").otherwise("open")
    return t("lineitem").select("l_orderkey", "l_linenumber", status.alias("status"))


@query("SELECT * FROM (VALUES ('p_partkey', 'numeric'), ('p_name', 'text'), ('p_brand', 'categorical'), ('p_size', 'numeric'), ('p_retailprice', 'numeric')) AS v(column_name, kind)")
def p20_p21_conceptual_types(t):
    own = t("part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    kinds = Q.conceptual_types(own)
    return own.sparkSession.createDataFrame(list(kinds.items()), "column_name string, kind string")


@query("SELECT p_brand, count(*) AS size FROM part GROUP BY p_brand HAVING count(*) > 1")
def p23_text_predicate(t):
    return t("part").groupBy("p_brand").agg(F.count("*").alias("size")).where("size > 1")


# Joins


@query("SELECT c_custkey, c_name, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def j1_many_to_one(t):
    return Q.lookup_join(t("customer"), t("nation"), ["c_nationkey"], ["n_nationkey"]).select("c_custkey", "c_name", "n_name")


@query("SELECT c_custkey, CASE WHEN o.k IS NULL THEN 'left_only' ELSE 'both' END AS merge_status, o.n FROM customer LEFT JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) o ON c_custkey = o.k")
def j2_j3_j4_marked_join(t):
    n = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return Q.lookup_join(t("customer"), n, ["c_custkey"], ["o_custkey"], unique_left=True, marker="merge_status").select("c_custkey", "merge_status", "n")


@query("SELECT p_brand, count(*) AS n, count(CASE WHEN p_size > 25 THEN 1 END) AS large, min(p_retailprice) AS least FROM part GROUP BY p_brand")
def j5_j7_one_aggregate_for_many(t):
    return t("part").groupBy("p_brand").agg(F.count("*").alias("n"), F.count(F.when(F.col("p_size") > 25, 1)).alias("large"), F.min("p_retailprice").alias("least"))


@query("SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def j6_lookup(t):
    return Q.lookup_join(t("nation"), t("region"), ["n_regionkey"], ["r_regionkey"]).select("n_name", "r_name")


@query(
    "WITH tr AS (SELECT * FROM part WHERE p_partkey % 3 <> 0), m AS (SELECT p_brand, p_size, median(p_retailprice) AS med FROM tr GROUP BY ALL) "
    "SELECT p_partkey, round(coalesce(med, (SELECT median(p_retailprice) FROM tr)), 4) AS predicted FROM part LEFT JOIN m USING (p_brand, p_size) WHERE p_partkey % 3 = 0"
)
def j8_median_lookup(t):
    part = t("part")
    out = K.median_lookup(part.where("p_partkey % 3 <> 0"), part.where("p_partkey % 3 = 0"), ["p_brand", "p_size"], "p_retailprice")
    return out.select("p_partkey", r4(F.col("predicted"), "predicted"))


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def j9_fan_out(t):
    return t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT 'o_custkey' AS \"column\", round(avg(CASE WHEN o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 4 <> 0) THEN 0.0 ELSE 1.0 END), 4) AS unseen_share FROM orders WHERE o_orderkey % 4 = 0")
def j10_unseen_share(t):
    o = t("orders")
    return K.unseen_share(o.where("o_orderkey % 4 <> 0"), o.where("o_orderkey % 4 = 0"), "o_custkey").select("column", r4(F.col("unseen_share"), "unseen_share"))


# Aggregates


@query(
    "SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 4) AS p_retailprice_mean, round(median(p_retailprice), 4) AS p_retailprice_median, round(avg(p_size), 4) AS p_size_mean, median(p_size) AS p_size_median, "
    "round(avg(CASE WHEN p_size > 25 THEN 1.0 ELSE 0.0 END), 4) AS large_share, round(avg(CASE WHEN regexp_matches(p_type, 'PROMO') THEN 1.0 ELSE 0.0 END), 4) AS promo_share FROM part GROUP BY p_brand"
)
def a1_a2_a3_group_summary(t):
    return rounded(A.group_summary(t("part"), ["p_brand"], ["p_retailprice", "p_size"], {"large_share": F.col("p_size") > 25, "promo_share": F.col("p_type").rlike("PROMO")}))


@query("SELECT p_brand, p_size, n, round(n / sum(n) OVER (), 6) AS share_of_total, round(n / sum(n) OVER (PARTITION BY p_brand), 6) AS share_of_parent FROM (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL)")
def a4_a5_w11_shares(t):
    out = A.with_shares(t("part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n")), "n", ["p_brand"])
    return out.select("p_brand", "p_size", "n", F.round("share_of_total", 6).alias("share_of_total"), F.round("share_of_parent", 6).alias("share_of_parent"))


@query(
    "WITH f AS (SELECT o_custkey % 50 AS brand, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL) SELECT brand, CAST(sum(n) AS BIGINT) AS total, round(coalesce(sum(n) FILTER (y BETWEEN 1996 AND 1998), 0) / sum(n), 4) AS recent_share, "
    "round(coalesce(sum(n) FILTER (y <= 1995), 0) / sum(n), 4) AS old_share, round(sum(n * y) / sum(n), 4) AS mean_year, CAST(max(y) FILTER (n > 0) - min(y) FILTER (n > 0) AS INT) AS year_span, CAST(-(max({'n': n, 'y': -y})).y AS INT) AS peak_year, max(n) AS peak_count FROM f GROUP BY brand"
)
def a6_d6_lifecycle(t):
    f = t("orders").groupBy((F.col("o_custkey") % 50).alias("brand"), F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    return rounded(A.lifecycle(f, ["brand"], "y", "n", (1996, 1998), 1995))


@query("SELECT count(DISTINCT p_brand) AS brands, count(DISTINCT p_type) AS types, percentile_cont(0.25) WITHIN GROUP (ORDER BY p_retailprice) AS q25, mode(p_size) FILTER (p_size = 7) AS size_mode FROM part")
def a7_a8_a25_distinct_quantile_mode(t):
    part = t("part")
    one = part.agg(F.count_distinct("p_brand").alias("brands"), F.count_distinct("p_type").alias("types"), F.mode(F.when(F.col("p_size") == 7, F.col("p_size")), True).alias("size_mode"))
    return G.with_quantiles(one, part, [], {"q": F.col("p_retailprice")}, {"25": 0.25}).select("brands", "types", F.col("q_25").alias("q25"), "size_mode")


@query(
    "SELECT count(l_extendedprice) AS count, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std, min(l_extendedprice) AS min, "
    + ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 4) AS p{round(100 * p)}" for p in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99))
    + ", max(l_extendedprice) AS max FROM lineitem"
)
def a9_described(t):
    return rounded(A.described(t("lineitem"), "l_extendedprice"))


@query("SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 10")
def a10_t7_top_values(t):
    return A.value_counts(t("part"), ["p_type"], 10)


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def a11_pair_counts(t):
    return A.value_counts(t("orders"), ["o_orderstatus", "o_orderpriority"], keep_nulls=False)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, round(avg(l_extendedprice), 4) AS mean, round(median(l_extendedprice), 4) AS median FROM lineitem GROUP BY ALL")
def a12_rows_distinct_mean_median(t):
    keys = ["l_returnflag", "l_linestatus"]
    by = t("lineitem").groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("suppliers"), r4(F.avg("l_extendedprice"), "mean"))
    out = G.with_quantiles(by, t("lineitem"), keys, {"price": F.col("l_extendedprice")}, {"median": 0.5})
    return out.select(*by.columns, r4(F.col("price_median"), "median"))


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS missing, 0.0::DOUBLE AS missing_percent, count(DISTINCT {c}) AS distinct, "
        + (f"min({c})::DOUBLE AS least, max({c})::DOUBLE AS largest, round(avg({c}), 4) AS mean, round(median({c})::DOUBLE, 4) AS median" if numeric else "NULL::DOUBLE AS least, NULL::DOUBLE AS largest, NULL::DOUBLE AS mean, NULL::DOUBLE AS median")
        + " FROM supplier"
        for c, numeric in (("s_suppkey", 1), ("s_name", 0), ("s_nationkey", 1), ("s_acctbal", 1))
    ).replace("AS rows", 'AS "rows"').replace("AS distinct", 'AS "distinct"')
)
def a13_a14_column_profile(t):
    return rounded(Q.profile(t("supplier")))


@query("SELECT a, b, round(c, 4) AS correlation FROM (SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, corr(l_quantity, l_extendedprice) AS c FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', corr(l_quantity, l_discount) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', corr(l_extendedprice, l_discount) FROM lineitem)")
def a15_correlations(t):
    return rounded(A.correlations(t("lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


_PREDICTED = "(SELECT l_suppkey, l_extendedprice AS actual, l_quantity * 1500 AS predicted FROM lineitem)"
_METRICS = (
    "count(*) AS n, round(avg(abs(actual - predicted)), 3) AS mae, round(sqrt(avg((actual - predicted) ** 2)), 3) AS rmse, round(1 - sum((actual - predicted) ** 2) / (var_pop(actual) * count(*)), 4) AS r2, round(median(abs(actual - predicted)), 3) AS median_ae, "
    "round(avg(abs(actual - predicted) / greatest(actual, 1.0)), 4) AS mape, round(avg(predicted - actual), 3) AS bias"
)


def _predicted(t):
    return t("lineitem").select("l_suppkey", F.col("l_extendedprice").alias("actual"), (F.col("l_quantity") * 1500).alias("predicted"))


def _metrics(df):
    return [F.round(c, 3).alias(c) if c in ("mae", "rmse", "median_ae", "bias") else F.round(c, 4).alias(c) for c in ("mae", "rmse", "r2", "median_ae", "mape", "bias")]


@query(f"SELECT {_METRICS} FROM {_PREDICTED}")
def a20_a21_regression_metrics(t):
    out = A.errors_by(_predicted(t), [])
    return out.select("n", *_metrics(out))


@query(f"SELECT l_suppkey, {_METRICS}, round(avg(CASE WHEN abs(actual - predicted) <= 10000 THEN 1.0 ELSE 0.0 END), 4) AS within_10000 FROM {_PREDICTED} GROUP BY l_suppkey HAVING count(*) >= 20")
def a16_a17_group_errors(t):
    out = A.group_errors(_predicted(t), "l_suppkey", "actual", "predicted", 20, (10000,))
    return out.select("l_suppkey", "n", *_metrics(out), r4(F.col("within_10000"), "within_10000"))


@query(
    f"SELECT band, count(*) AS n, round(avg(abs(actual - predicted)), 3) AS mae, round(avg(CASE WHEN actual > 1 THEN abs(actual - predicted) / actual END), 4) AS mape FROM (SELECT *, CASE WHEN actual >= 0 AND actual < 10000 THEN 'low' WHEN actual >= 10000 AND actual < 50000 THEN 'middle' WHEN actual >= 50000 AND actual < 1000000 THEN 'high' END AS band FROM {_PREDICTED}) GROUP BY band"
)
def a18_f45_error_bands(t):
    band = N.fixed_bins(F.col("actual"), [0, 10_000, 50_000, 1_000_000], ["low", "middle", "high"], right=False)
    return A.error_bands(_predicted(t), band).select("band", "n", F.round("mae", 3).alias("mae"), r4(F.col("mape"), "mape"))


@query(
    f"WITH p AS {_PREDICTED}, e AS (SELECT quantile_cont(actual, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q FROM p), c AS (SELECT CAST(greatest(len(list_filter(q, lambda x: x < actual)) - 1, 0) AS INT) AS bin, predicted > actual AS over, count(*) AS n FROM p, e WHERE actual > 5000 GROUP BY ALL) "
    "SELECT bin, over, coalesce(n, 0)::BIGINT AS n FROM (SELECT * FROM (SELECT unnest(range(6))::INT AS bin), (SELECT unnest([true, false]) AS over)) LEFT JOIN c USING (bin, over)"
)
def a19_f46_quantile_bands(t):
    """Every band in both directions, also those without rows."""
    own = _predicted(t)
    edges = G.edges(own, F.col("actual"))
    counts = own.where("actual > 5000").groupBy(N.bin_of(F.col("actual"), F.lit(edges)).alias("bin"), (F.col("predicted") > F.col("actual")).alias("over")).agg(F.count("*").alias("n"))
    return A.with_empty(counts, {"bin": list(range(6)), "over": [True, False]})


@query(f"SELECT round(avg(mae), 3) AS mae_mean, round(stddev_pop(mae), 3) AS mae_std, round(min(mae), 3) AS mae_min, round(max(mae), 3) AS mae_max FROM (SELECT l_suppkey % 4 AS fold, avg(abs(actual - predicted)) AS mae FROM {_PREDICTED} GROUP BY ALL)")
def a22_fold_summary(t):
    by = _predicted(t).groupBy((F.col("l_suppkey") % 4).alias("fold")).agg(*A.regression_metrics())
    out = A.fold_summary(by, ["mae"])
    return out.select(*(F.round(c, 3).alias(c) for c in out.columns))


@query("SELECT coalesce(nullif(lower(trim(event_type)), ''), '__missing__') AS v, count(*) AS n, round(avg(value), 4) AS mean, round(avg(abs(value)), 4) AS mean_abs FROM events GROUP BY 1 HAVING count(*) >= 15")
def a23_f12_category_effects(t):
    return t("events").groupBy(X.group_value(F.col("event_type")).alias("v")).agg(F.count("*").alias("n"), r4(F.avg("value"), "mean"), r4(F.avg(F.abs("value")), "mean_abs")).where("n >= 15")


@query(
    "SELECT g AS \"group\", round(sum(v), 3) AS v, round(sum(v) / sum(sum(v)) OVER (), 4) AS share FROM (SELECT CASE WHEN p_brand = 'Brand#11' THEN 'one' WHEN p_brand = 'Brand#12' THEN 'two' ELSE 'other' END AS g, p_retailprice AS v FROM part) GROUP BY g"
)
def a24_rolled_up_importance(t):
    out = A.rolled_up(t("part").select("p_brand", F.col("p_retailprice").alias("v")), "p_brand", {"Brand#11": "one", "Brand#12": "two"}, "v")
    return out.select("group", F.round("v", 3).alias("v"), r4(F.col("share"), "share"))


@query("SELECT round(stddev_pop(m), 4) AS spread FROM (SELECT median(p_retailprice) AS m FROM part GROUP BY p_brand)")
def a26_spread_of_medians(t):
    medians = G.quantile_table(t("part"), ["p_brand"], {"price": F.col("p_retailprice")}, {"median": 0.5})
    return medians.agg(r4(F.stddev_pop("price_median"), "spread"))


@query("SELECT round(avg(n), 4) AS mean, median(n) AS median, max(n) AS largest FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def a27_group_sizes(t):
    sizes = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    one = sizes.agg(r4(F.avg("n"), "mean"), F.max("n").alias("largest"))
    return G.with_quantiles(one, sizes, [], {"n": F.col("n")}, {"median": 0.5}).select("mean", F.col("n_median").alias("median"), "largest")


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS owners, CASE WHEN count(DISTINCT l_suppkey) = 1 THEN min(l_suppkey) END AS l_suppkey FROM lineitem GROUP BY l_partkey")
def a28_unambiguous_owner(t):
    return A.unambiguous(t("lineitem"), "l_partkey", "l_suppkey")


# Rows of groups, duplicates


@query("SELECT DISTINCT lower(trim(regexp_replace(p_type, '\\s+', ' ', 'g'))) AS p_type, p_brand FROM part")
def d1_f2_distinct_rows(t):
    return t("part").select(F.lower(X.strip(X.collapse(F.col("p_type")))).alias("p_type"), "p_brand").dropDuplicates()


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def d2_d3_keep_first(t):
    return Q.keep_first(t("orders"), ["o_custkey"], F.desc("o_totalprice"), "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY (CASE WHEN value > 50 THEN 1 ELSE 0 END) DESC, event_id) = 1")
def d4_fullest_per_day(t):
    own = t("events").select("event_id", "user_id", F.col("ts").cast("date").alias("day"), N.above(F.col("value"), 50).alias("v"))
    return H.fullest_per_day(own, ["user_id", "day"], "event_id").select("event_id", "user_id")


@query("SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_partkey, l_suppkey) > 1 AS repeated FROM lineitem")
def d5_repeats(t):
    return Q.repeats(t("lineitem"), ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "repeated")


@query("SELECT p_partkey, CASE WHEN (SELECT count(DISTINCT q.p_type) FROM part q WHERE q.p_brand = part.p_brand) > 1 THEN p_brand || ' [' || p_type || ']' ELSE p_brand END AS label FROM part")
def d11_distinct_labels(t):
    return Q.distinct_labels(t("part").withColumn("label", F.col("p_brand")), "label", "p_type").select("p_partkey", "label")


# Windows


@query(
    "WITH e AS (SELECT user_id, event_id, CAST(ts AS DATE) AS d, value, ts FROM events), w AS (SELECT *, row_number() OVER s AS observations_so_far, date_diff('day', min(d) OVER (PARTITION BY user_id), d) AS days_since_first_seen, first_value(value) OVER (PARTITION BY user_id ORDER BY d, event_id) AS first_price, "
    "CASE WHEN lag(value) OVER s <> value THEN 1 ELSE 0 END AS price_change_event FROM e WINDOW s AS (PARTITION BY user_id ORDER BY d, event_id)) "
    "SELECT event_id, user_id, CAST(observations_so_far AS INT) AS observations_so_far, CAST(days_since_first_seen AS INT) AS days_since_first_seen, first_price, price_change_event, CAST(sum(price_change_event) OVER (PARTITION BY user_id ORDER BY d, event_id) AS BIGINT) AS price_changes_so_far, "
    "round(value - first_price, 4) AS absolute_change_so_far, round(CASE WHEN first_price <> 0 THEN (value - first_price) / first_price * 100 END, 4) AS relative_change_so_far FROM w"
)
def w1_w6_point_in_time(t):
    own = t("events").select("user_id", "event_id", F.col("ts").cast("date").alias("d"), "value")
    return rounded(H.point_in_time(own, "user_id", "d", "value", "event_id").select("event_id", "user_id", "observations_so_far", "days_since_first_seen", "first_price", "price_change_event", "price_changes_so_far", "absolute_change_so_far", "relative_change_so_far"))


@query(
    "WITH e AS (SELECT user_id, event_id, CAST(ts AS DATE) AS d, CASE WHEN value > 20 THEN value END AS v FROM events), k AS (SELECT user_id, v, lag(v) OVER (PARTITION BY user_id ORDER BY d, event_id) AS b FROM e WHERE v IS NOT NULL), "
    "c AS (SELECT user_id, CAST(sum(CASE WHEN b <> v THEN 1 ELSE 0 END) AS BIGINT) AS price_changes FROM k GROUP BY user_id) "
    "SELECT user_id, count(*) AS times_observed, CAST(min(d) AS VARCHAR) AS first_seen, CAST(max(d) AS VARCHAR) AS last_seen, coalesce(max(price_changes), 0) AS price_changes, arg_min(v, {'d': d, 'e': event_id}) FILTER (v IS NOT NULL) AS first_price, arg_max(v, {'d': d, 'e': event_id}) FILTER (v IS NOT NULL) AS last_price, "
    "CAST(date_diff('day', min(d), max(d)) AS INT) AS span_days FROM e LEFT JOIN c USING (user_id) GROUP BY user_id"
)
def w7_w10_full_history(t):
    own = t("events").select("user_id", "event_id", F.col("ts").cast("date").alias("d"), N.above(F.col("value"), 20).alias("v"))
    return rounded(H.full_history(own, "user_id", "d", "v", "event_id").select("user_id", "times_observed", "first_seen", "last_seen", "price_changes", "first_price", "last_price", "span_days"))


@query(
    "WITH b AS (SELECT p_brand, avg(p_retailprice) AS mae, stddev_pop(p_retailprice) AS rmse FROM part GROUP BY p_brand) SELECT p_brand, CAST(dense_rank() OVER (ORDER BY mae) AS INT) AS mae_rank, CAST(dense_rank() OVER (ORDER BY rmse) AS INT) AS rmse_rank, round(mae - max(CASE WHEN p_brand = 'Brand#11' THEN mae END) OVER (), 4) AS mae_delta FROM b"
)
def w8_w9_ranks_and_deltas(t):
    b = t("part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("mae"), F.stddev_pop("p_retailprice").alias("rmse"))
    base = b.agg(F.max(F.when(F.col("p_brand") == "Brand#11", F.col("mae"))).alias("base"))
    ranked = G.dense_ranked(b, {"mae_rank": "mae", "rmse_rank": "rmse"}).join(F.broadcast(base))  # one row
    return ranked.select("p_brand", F.col("mae_rank").cast("int").alias("mae_rank"), F.col("rmse_rank").cast("int").alias("rmse_rank"), r4(F.col("mae") - F.col("base"), "mae_delta"))


# Sorting and sets


@query("SELECT p_partkey, p_brand, p_retailprice FROM part ORDER BY p_brand, p_retailprice DESC, p_partkey")
def t1_mixed_sort(t):
    return t("part").select("p_partkey", "p_brand", "p_retailprice").orderBy("p_brand", F.desc("p_retailprice"), "p_partkey")


@query("SELECT p_brand, p_type, mae FROM (SELECT p_brand, p_type, round(avg(p_retailprice), 4) AS mae, count(*) AS n FROM part GROUP BY ALL) ORDER BY mae, n, p_brand, p_type LIMIT 1")
def t2_best_row(t):
    return t("part").groupBy("p_brand", "p_type").agg(r4(F.avg("p_retailprice"), "mae"), F.count("*").alias("n")).orderBy("mae", "n", "p_brand", "p_type").limit(1).drop("n")


@query("SELECT l_orderkey, l_linenumber, round(abs(l_extendedprice - l_quantity * 1500), 4) AS error FROM lineitem ORDER BY abs(l_extendedprice - l_quantity * 1500) DESC, l_orderkey, l_linenumber LIMIT 40")
def t3_t4_worst_rows(t):
    e = F.abs(F.col("l_extendedprice") - F.col("l_quantity") * 1500)
    return t("lineitem").orderBy(e.desc(), "l_orderkey", "l_linenumber").limit(40).select("l_orderkey", "l_linenumber", r4(e, "error"))


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY abs(p_retailprice - 1200), p_partkey LIMIT 50")
def t5_t6_nearest(t):
    return K.nearest(t("part"), "p_retailprice", 1200, 50, "p_partkey").select("p_partkey", "p_retailprice")


@query("SELECT o_custkey AS k, 'orders' AS origin FROM orders UNION ALL SELECT c_custkey, 'customer' FROM customer")
def u1_u7_tagged_union(t):
    return t("orders").select(F.col("o_custkey").alias("k"), F.lit("orders").alias("origin")).unionByName(t("customer").select(F.lit("customer").alias("origin"), F.col("c_custkey").alias("k")))


@query("SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def u2_shared_keys(t):
    keys = lambda f: t("lineitem").where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("k"))
    return keys("R").intersect(keys("A"))


@query("SELECT md5(concat_ws(',', CASE WHEN v IS NULL THEN '-' ELSE length(v) || ':' || v END, length(user_id::VARCHAR) || ':' || user_id)) AS f FROM (SELECT user_id, CASE WHEN event_id % 5 > 0 THEN event_type END AS v FROM events)")
def u3_fingerprints(t):
    return t("events").select(X.fingerprint(F.when(F.col("event_id") % 5 > 0, F.col("event_type")), F.col("user_id")).alias("f"))


@query("SELECT p_brand AS term FROM part UNION SELECT p_type FROM part")
def u4_u5_term_set(t):
    return t("part").select(F.col("p_brand").alias("term")).union(t("part").select("p_type")).distinct()


# Texts, numbers, dates


@query("SELECT p_partkey, upper(trim(p_name)) AS upper_name, nullif(lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))), '') AS key, CASE WHEN lower(p_brand) = 'brand#11' THEN 'house' ELSE lower(p_brand) END AS alias, split_part(p_brand, '#', 2) AS code FROM part")
def f1_f4_keys_and_aliases(t):
    return t("part").select("p_partkey", F.upper(X.strip(F.col("p_name"))).alias("upper_name"), X.key(F.col("p_name")).alias("key"), X.replaced(F.lower("p_brand"), {"brand#11": "house"}).alias("alias"), F.get(F.split("p_brand", "#"), F.lit(1)).alias("code"))


@query("SELECT p_partkey, nullif(trim(CASE WHEN starts_with(p_name || ' ', split_part(p_name, ' ', 1) || ' ') THEN substr(p_name, length(split_part(p_name, ' ', 1)) + 1) END), '') AS rest FROM part")
def f5_f7_without_prefix(t):
    return t("part").select("p_partkey", X.without_prefix(F.col("p_name"), F.get(F.split("p_name", " "), F.lit(0))).alias("rest"))


@query("SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS low, nullif(split_part(o_orderpriority, '-', 2), '') AS high, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS padded FROM orders")
def f8_f10_split_and_pad(t):
    low, high = X.split_range(F.col("o_orderpriority"))
    return t("orders").select("o_orderkey", low.alias("low"), X.null_if(high, "").alias("high"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("padded"))


@query("SELECT event_id, TRY_CAST(replace(s, ',', '.') AS DOUBLE) AS n FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '-' WHEN 1 THEN replace(CAST(event_id AS VARCHAR) || '.5', '.', ',') WHEN 2 THEN 'abc' ELSE CAST(event_id AS VARCHAR) END AS s FROM events)")
def f9_f40_count_numbers(t):
    e = F.col("event_id")
    s = F.when(e % 4 == 0, "-").when(e % 4 == 1, F.concat(e.cast("string"), F.lit(",5"))).when(e % 4 == 2, "abc").otherwise(e.cast("string"))
    return t("events").select("event_id", N.count_number(s).alias("n"))


@query("SELECT p_partkey, concat_ws('|', lower(trim(p_name)), lower(trim(p_brand)), CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) ELSE '__missing__' END) AS identity FROM part")
def f11_g4_part_identity(t):
    return t("part").select("p_partkey", X.identity(F.col("p_name"), F.col("p_brand"), N.above(F.col("p_size"), 25)).alias("identity"))


@query("SELECT o_orderkey, year(o_orderdate) AS y, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INT) AS off, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS a, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS b FROM orders")
def f33_f38_dates(t):
    d = F.col("o_orderdate").cast("date")
    return t("orders").select("o_orderkey", F.year(d).alias("y"), N.day_offset(d, F.lit("1992-01-01").cast("date")).alias("off"), N.finnish_date(F.date_format(d, "d.M.yyyy")).cast("string").alias("a"), N.compact_date(F.concat(F.date_format(d, "yyyyMMdd"), F.lit(".0"))).cast("string").alias("b"))


@query("SELECT o_orderkey, CASE WHEN y <= 1996 THEN 'early' WHEN y <= 1998 THEN 'middle' ELSE 'late' END AS band, 2025 - y AS age FROM (SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y FROM orders)")
def f43_f44_bands_and_ages(t):
    y = F.year("o_orderdate")
    return t("orders").select("o_orderkey", N.fixed_bins(y, [1900, 1996, 1998, 2100], ["early", "middle", "late"]).alias("band"), (2025 - y).alias("age"))


@query("SELECT l_orderkey, l_linenumber, round(ln(l_extendedprice), 6) AS log_price, round(exp(least(greatest(ln(l_extendedprice), ln(1e-3)), ln(1000000.0))), 2) AS euros, round(CASE WHEN l_discount <> 0 THEN l_tax / l_discount END, 6) AS ratio, greatest(l_quantity - 1.645 * 10, 0) AS low FROM lineitem")
def f41_f42_f48_f51_numbers(t):
    low, _ = M.confidence_band(F.col("l_quantity"), 10)
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(F.ln("l_extendedprice"), 6).alias("log_price"), F.round(N.to_euros(F.ln("l_extendedprice"), True, 100_000.0), 2).alias("euros"), F.round(N.ratio(F.col("l_tax"), F.col("l_discount")), 6).alias("ratio"), low.alias("low"))


# Pages


@query()
def f23_f29_parsed_pages(t):
    return P.parsed(t("pages"))


@query("SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*href=[\"'']([^\"'']+)[\"'']', 1)) AS href FROM pages")
def f30_f31_links(t):
    return P.links(t("pages"))


# Keys


@query("WITH a AS (SELECT DISTINCT split_part(lower(p_name), ' ', 1) AS alias FROM part UNION SELECT DISTINCT split_part(lower(p_name), ' ', 1) || ' ' || split_part(lower(p_name), ' ', 2) FROM part) SELECT p_partkey, (SELECT upper(arg_max(alias, length(alias))) FROM a WHERE starts_with(lower(p_name) || ' ', alias || ' ')) AS brand, nullif(trim(substr(lower(p_name), 1 + (SELECT max(length(alias)) FROM a WHERE starts_with(lower(p_name) || ' ', alias || ' ')))), '') AS model FROM part")
def k1_longest_prefix(t):
    own = t("part").select("p_partkey", F.lower("p_name").alias("label"))
    first, second = F.get(F.split("label", " "), F.lit(0)), F.get(F.split("label", " "), F.lit(1))
    aliases = own.select(first.alias("alias")).union(own.select(F.concat_ws(" ", first, second))).distinct().withColumn("brand", F.upper("alias"))
    return K.longest_prefix(own, "label", aliases).select("p_partkey", "brand", "model")


@query(
    "WITH l AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'b' || (o_custkey % 20) WHEN 1 THEN 'm' || (o_custkey % 10) ELSE 'x' END AS brand, CASE o_orderkey % 2 WHEN 0 THEN 'm' || (o_custkey % 10) ELSE 'brake' END AS model FROM orders), "
    "pairs AS (SELECT DISTINCT 'b' || (c_custkey % 20) AS brand, 'm' || (CASE WHEN c_custkey % 20 < 5 THEN c_custkey % 20 ELSE c_custkey % 10 END) AS model FROM customer), o AS (SELECT model AS family, count(DISTINCT brand) AS owners, min(brand) AS owner FROM pairs GROUP BY model) "
    "SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM pairs p WHERE p.brand = l.brand AND p.model = l.model) THEN 'original_valid' WHEN owners = 1 AND l.model = 'brake' THEN 'repaired_from_brand_model_family' WHEN owners > 1 THEN 'ambiguous_unrepaired' WHEN l.model = 'brake' THEN 'invalid_part_taxonomy_in_model' ELSE 'unknown_brand_model' END AS key_status, "
    "CASE WHEN NOT EXISTS (SELECT 1 FROM pairs p WHERE p.brand = l.brand AND p.model = l.model) AND owners = 1 AND l.model = 'brake' THEN owner ELSE l.brand END AS key_brand FROM l LEFT JOIN o ON l.brand = o.family"
)
def k2_k3_key_repair(t):
    k = F.col("o_orderkey")
    b = lambda n: (F.col("o_custkey") % n).cast("string")
    own = t("orders").select("o_orderkey", F.when(k % 3 == 0, F.concat(F.lit("b"), b(20))).when(k % 3 == 1, F.concat(F.lit("m"), b(10))).otherwise("x").alias("brand"), F.when(k % 2 == 0, F.concat(F.lit("m"), b(10))).otherwise("brake").alias("model"), F.lit("Brakes").alias("category"), F.lit("brake").alias("subcategory"))
    c = F.col("c_custkey")
    pairs = t("customer").select(F.concat(F.lit("b"), (c % 20).cast("string")).alias("brand"), F.concat(F.lit("m"), F.when(c % 20 < 5, c % 20).otherwise(c % 10).cast("string")).alias("model"))
    return K.repaired(K.looks_like_taxonomy(own, "model", "category", "subcategory"), pairs).select("o_orderkey", "key_status", "key_brand")


@query("SELECT round(avg(CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END), 4) AS before, CAST(sum(CASE WHEN l_quantity < l_linenumber THEN 1 ELSE 0 END) AS BIGINT) AS illogical FROM lineitem")
def k5_k8_match_share_and_logic(t):
    return t("lineitem").agg(r4(K.match_share(F.col("l_quantity") > 25), "before"), F.sum((F.col("l_quantity") < F.col("l_linenumber")).cast("long")).alias("illogical"))


@query("SELECT c_nationkey, c_custkey FROM customer")
def k6_k7_k10_guards(t):
    own = Q.require_no_nulls(Q.require_unique(t("customer"), ["c_custkey"]), ["c_custkey", "c_nationkey"])
    return Q.require_columns(own, ["c_nationkey", "c_custkey"])


@query("SELECT p_partkey::DOUBLE AS p_partkey, p_name, p_brand, p_type, p_size::DOUBLE AS p_size, p_retailprice FROM part")
def k9_coerced(t):
    return Q.coerced(t("part"), ("price", "size", "key"), N.to_number)


# Splits


@query(
    "WITH g AS (SELECT c_nationkey * 1000 + c_custkey % 40 AS g FROM customer GROUP BY 1), r AS (SELECT g, row_number() OVER (ORDER BY md5(g || ':42'), g) AS k, count(*) OVER () AS n FROM g) SELECT g, CASE WHEN k <= round_even(n * 0.7, 0) THEN 'train' WHEN k <= round_even(n * 0.7, 0) + round_even(n * 0.15, 0) THEN 'validation' ELSE 'test' END AS split FROM r"
)
def g1_g3_group_split(t):
    return S.group_split(t("customer").select((F.col("c_nationkey") * 1000 + F.col("c_custkey") % 40).alias("g")), "g")


@query(
    "WITH RECURSIVE s AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, o_custkey) AS k FROM s), "
    "f(k, o_custkey, n, fold, loads) AS (SELECT 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::INT, [0, 0, 0, 0]::BIGINT[] UNION ALL "
    "SELECT r.k, r.o_custkey, r.n, (list_position(loads, list_min(loads)) - 1)::INT, list_transform(range(1, 5), lambda i: loads[i] + CASE WHEN i = list_position(loads, list_min(loads)) THEN r.n ELSE 0 END)::BIGINT[] FROM f JOIN r ON r.k = f.k + 1) "
    "SELECT o_custkey, n, fold FROM f WHERE k > 0"
)
def g2_group_folds(t):
    return S.group_folds(t("orders"), "o_custkey")


@query("SELECT (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_linenumber % 2) > 1)) AS group_overlap, (SELECT count(*) FROM (SELECT l_partkey, l_suppkey FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_linenumber % 2) > 1)) AS row_overlap, 'FAIL' AS group_check, 'WARN' AS row_check")
def g5_m25_fold_report(t):
    own = t("lineitem").select("l_orderkey", (F.col("l_linenumber") % 2).alias("fold"), X.fingerprint(F.col("l_partkey"), F.col("l_suppkey")).alias("row"))
    return S.fold_report(own, "fold", "l_orderkey", "row")


@query("SELECT c_custkey FROM customer ORDER BY md5(c_custkey || ':42'), c_custkey LIMIT 100")
def g6_sampled(t):
    return S.sampled(t("customer"), "c_custkey", 100).select("c_custkey")


@query(
    "WITH a AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders), b AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY md5(o_orderkey || ':42'), o_orderkey) AS k FROM orders) SELECT o_orderkey, o_custkey, o_totalprice FROM a JOIN b USING (o_custkey, k)"
)
def g7_permuted_within(t):
    return S.permuted(t("orders"), "o_totalprice", "o_orderkey", ["o_custkey"]).select("o_orderkey", "o_custkey", "o_totalprice")


# Serving


_LADDER = (("part_name", "brand", "model", "quality_grade"), ("part_name", "brand", "model"), ("part_name", "brand"), ("part_name",), ("subcategory", "brand"))
_LADDER_SQL = " UNION ALL ".join(
    f"SELECT query_id, {i} AS level, ref_id, r.price, abs(q.mileage - r.mileage) AS away FROM q JOIN r USING ({', '.join(keys)})" for i, keys in enumerate(_LADDER)
)


@query(
    "WITH r AS (SELECT p_partkey AS ref_id, lower(p_name) AS part_name, lower(p_brand) AS brand, lower(p_type) AS model, p_size % 3 AS quality_grade, split_part(lower(p_name), ' ', 2) AS subcategory, p_size AS mileage, p_retailprice AS price FROM part), "
    f"q AS (SELECT * RENAME (ref_id AS query_id) FROM r), f AS ({_LADDER_SQL}), "
    "l AS (SELECT query_id, min(level) AS level FROM (SELECT query_id, level FROM f GROUP BY ALL HAVING count(*) >= 5) GROUP BY query_id), "
    "n AS (SELECT f.* FROM f JOIN l USING (query_id, level) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY away, ref_id) <= 50), "
    "s AS (SELECT query_id, any_value(level) AS level, quantile_cont(price, 0.1) AS p10, quantile_cont(price, 0.9) AS p90, count(*) AS comparables FROM n GROUP BY query_id) "
    "SELECT query_id, round(CASE WHEN p10 IS NULL THEN 1125.0 ELSE least(p10, 1080.0) END, 4) AS low, round(CASE WHEN p10 IS NULL THEN 1275.0 ELSE greatest(p90, 1320.0) END, 4) AS high, coalesce(comparables, 0) AS comparables, "
    "CASE WHEN p10 IS NULL THEN 'fallback' ELSE 'comparable_rows' END AS source, CASE WHEN comparables >= 20 THEN 'Strong' WHEN comparables >= 8 THEN 'Moderate' ELSE 'Limited' END AS support FROM q LEFT JOIN s USING (query_id)"
)
def v1_v5_comparable_range(t):
    """Every part asks, over the whole ladder."""
    part = t("part").select(
        F.col("p_partkey").alias("ref_id"), F.col("p_name").alias("part_name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("model"), (F.col("p_size") % 3).alias("quality_grade"),
        F.get(F.split("p_name", " "), F.lit(1)).alias("subcategory"), F.col("p_size").alias("mileage"), F.col("p_retailprice").alias("price"))
    asked = part.drop("price").withColumnRenamed("ref_id", "query_id").withColumn("prediction", F.lit(1200.0))
    out = M.comparable_range(asked, part, _LADDER)
    return out.select("query_id", r4(F.col("low"), "low"), r4(F.col("high"), "high"), "comparables", "source", M.support_label(F.col("comparables")).alias("support"))


@query(
    "WITH a AS (SELECT DISTINCT split_part(lower(p_name), ' ', 1) AS alias FROM part), l AS (SELECT l_orderkey, l_linenumber, lower(p_name) AS label FROM lineitem LEFT JOIN part ON p_partkey = l_partkey) "
    "SELECT label, upper(alias) AS brand, trim(substr(label, length(alias) + 1)) AS model, count(*) AS n FROM l LEFT JOIN a ON starts_with(label || ' ', alias || ' ') GROUP BY ALL"
)
def k1_repeated_labels(t):
    """Rows that repeat keep their number."""
    labels = t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey"), "left").select(F.lower("p_name").alias("label"))
    aliases = t("part").select(F.get(F.split(F.lower("p_name"), " "), F.lit(0)).alias("alias")).distinct().withColumn("brand", F.upper("alias"))
    return K.longest_prefix(labels, "label", aliases).groupBy("label", "brand", "model").agg(F.count("*").alias("n"))


@query(
    "WITH m AS (SELECT l_returnflag, l_linestatus, l_linenumber, l_discount, median(l_quantity) AS y FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY ALL) "
    "SELECT l_linenumber, count(*) AS n, round(sum(coalesce(y, (SELECT median(l_quantity) FROM lineitem WHERE l_orderkey % 2 = 0))), 4) AS predicted FROM lineitem l LEFT JOIN m USING (l_returnflag, l_linestatus, l_linenumber, l_discount) WHERE l_orderkey % 2 = 1 GROUP BY l_linenumber"
)
def j8_four_key_lookup(t):
    """Odd orders by the medians of even ones, over four keys."""
    own = t("lineitem")
    out = K.median_lookup(own.where("l_orderkey % 2 = 0"), own.where("l_orderkey % 2 = 1"), ["l_returnflag", "l_linestatus", "l_linenumber", "l_discount"], "l_quantity")
    return out.groupBy("l_linenumber").agg(F.count("*").alias("n"), r4(F.sum("predicted"), "predicted"))


@query("SELECT o_orderkey, o_custkey, c.c_custkey AS c_custkey, o.o_comment AS name, c.c_name AS name_right FROM (SELECT o_orderkey, o_custkey, o_orderstatus AS o_comment FROM orders) o LEFT JOIN customer c ON c_custkey = o_custkey")
def j11_clashing_columns(t):
    """Both tables' columns of one name stay."""
    own = t("orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("name"))
    right = t("customer").select(F.col("c_custkey").alias("key"), "c_custkey", F.col("c_name").alias("name"))
    return Q.lookup_join(own, right, ["o_custkey"], ["key"]).select("o_orderkey", "o_custkey", "c_custkey", "name", "name_right")


@query("SELECT DISTINCT p_brand AS option FROM part WHERE trim(p_brand) <> '' ORDER BY 1")
def v3_options(t):
    return M.options(t("part"), "p_brand")


# Labels, files and choices


@query(
    "SELECT CASE WHEN p_partkey % 2 = 0 THEN p_partkey::VARCHAR END AS product_id, p_name AS part_name, p_size::VARCHAR AS price, p_brand AS brand, p_type AS category, "
    "NULL::VARCHAR AS scrape_date, CASE WHEN p_partkey % 2 = 0 THEN 'even' ELSE 'odd' END AS route FROM part"
)
def s1_s8_snapshots(t):
    """Files of two headers, one misspelt and one with a column too many and one too few, read as one table with the route of each row."""
    part = t("part")
    root = R.scratch_path(part.sparkSession)
    own = {"part_name": "p_name", "price": "p_size", "brand": "p_brand", "category": "p_type"}
    columns = [F.col(own[c]).alias(c) if c in own else F.lit("x").alias(c) for c in R.REQUIRED]
    titled = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("roduct_id"), *columns)
    titled.toDF(*(c.replace("_", " ").title() if c != "roduct_id" else c for c in titled.columns)).write.option("header", True).csv(f"{root}/even")
    part.where("p_partkey % 2 = 1").select(*columns, F.lit("more").alias("note")).write.option("header", True).csv(f"{root}/odd")
    out = R.routed(R.read_snapshots(part.sparkSession, root), ("/even/", "/odd/"))
    return out.select("product_id", "part_name", "price", "brand", "category", "scrape_date", F.btrim("route", F.lit("/")).alias("route"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def s9_s16_s17_split_tables(t):
    """A table written in two places, by status, and read as one."""
    own = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    root = R.scratch_path(own.sparkSession)
    paths = [f"{root}/{i}" for i in range(2)]
    for i, path in enumerate(paths):
        R.write_table(own.where(F.col("o_orderkey") % 2 == i).withColumn("status", F.col("o_orderstatus")), path, by=["status"])
    return R.read_splits(own.sparkSession, [f"{p}/status={s}" for p in paths for s in ("F", "O", "P")])


@query("SELECT o_orderstatus AS name, count(*) AS rows FROM orders GROUP BY o_orderstatus")
def s11_s12_s19_reports(t):
    """A report for each status of orders, written and read again."""
    spark = t("orders").sparkSession
    root = R.scratch_path(spark)
    for r in t("orders").groupBy("o_orderstatus").count().orderBy("o_orderstatus").collect():  # three statuses
        R.write_report(spark, {"name": r["o_orderstatus"], "rows": r["count"]}, f"{root}/{r['o_orderstatus']}")
    return R.read_reports(spark, f"{root}/*/*.txt", ["name"]).select("name", "rows")


@query("SELECT true AS same, count(*) AS rows FROM customer")
def s18_s21_round_trip(t):
    own = t("customer")
    return own.agg(F.lit(R.round_trip(own, R.scratch_path(own.sparkSession))).alias("same"), F.count("*").alias("rows"))



def _labels(t):
    k, name = F.col("p_partkey") % 6, F.col("p_name")
    label = F.when(k == 0, F.concat(name, F.lit(" - ,e-"))).when(k == 1, F.concat(F.lit(" "), name, F.lit(" -"))).when(k == 2, "ABS ").when(k == 3, "Left rear").when(k == 4, F.concat(name, F.lit("  x (left) [y]")))
    return t("part").select("p_partkey", "p_name", label.alias("label"))


@query(
    "SELECT p_partkey, CASE p_partkey % 6 WHEN 2 THEN 'ABS' WHEN 3 THEN 'Left Rear' WHEN 5 THEN '' ELSE upper(p_name[1]) || p_name[2:] || CASE p_partkey % 6 WHEN 4 THEN ' x (left) [y]' ELSE '' END END AS shown, "
    "CASE p_partkey % 6 WHEN 2 THEN 'abs' WHEN 3 THEN 'left rear' WHEN 5 THEN '' WHEN 4 THEN lower(p_name) || ' x' ELSE lower(p_name) END AS label_key FROM part"
)
def f15_f16_labels(t):
    return _labels(t).select("p_partkey", X.display_label(F.col("label")).alias("shown"), X.label_key(F.col("label")).alias("label_key"))


@query(
    "SELECT DISTINCT p_name AS raw_subcategory, label AS raw_part_name, CASE k WHEN 2 THEN 'ABS' WHEN 3 THEN 'Left Rear' WHEN 4 THEN upper(p_name[1]) || p_name[2:] || ' x [y]' ELSE upper(p_name[1]) || p_name[2:] END AS display_part_type, "
    "CASE WHEN k IN (3, 4) THEN 'Left' END AS display_side, CASE WHEN k = 3 THEN 'Rear' END AS display_position FROM (SELECT p_partkey % 6 AS k, p_name, CASE p_partkey % 6 WHEN 0 THEN p_name || ' - ,e-' WHEN 1 THEN ' ' || p_name || ' -' WHEN 2 THEN 'ABS ' WHEN 3 THEN 'Left rear' WHEN 4 THEN p_name || '  x (left) [y]' END AS label FROM part)"
)
def v3_f17_f18_part_options(t):
    return X.part_options(_labels(t).select(F.col("p_name").alias("subcategory"), F.col("label").alias("part_name")))


@query("SELECT o_orderstatus, count(*) AS rows, count(*) FILTER (WHERE d IS NULL) AS missing, min(d)::VARCHAR AS first, max(d)::VARCHAR AS last, count(DISTINCT d) AS days FROM (SELECT o_orderstatus, CASE WHEN o_orderkey % 7 > 0 THEN o_orderdate::DATE END AS d FROM orders) GROUP BY o_orderstatus")
def f35_f38_date_spans(t):
    day = F.when(F.col("o_orderkey") % 7 > 0, N.iso_date(F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("day")
    return rounded(Q.date_spans(t("orders").select("o_orderstatus", day), "o_orderstatus", "day"))


@query("SELECT page_id, lower(url_decode(url)) AS url_key, CASE WHEN page_id % 2 = 0 THEN 'https://a.example/x/' ELSE 'https://a.example/' END || 'p/' || page_id AS joined FROM pages")
def f21_f22_urls(t):
    href = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("p/"), F.col("page_id").cast("string"))).otherwise(F.concat(F.lit("/p/"), F.col("page_id").cast("string")))
    return t("pages").select("page_id", X.url_key(F.col("url")).alias("url_key"), X.url_join("https://a.example/x", href).alias("joined"))


@query("SELECT l_orderkey, l_linenumber, round_even(l_quantity / 4, 1) AS even FROM lineitem")
def f47_half_even(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", N.half_even(F.col("l_quantity") / 4, 1).alias("even"))


@query("SELECT o_custkey, round(quantile_cont(o_totalprice, 0.9), 4) AS q FROM orders GROUP BY o_custkey")
def f50_sorted_quantile(t):
    out = G.quantile_table(t("orders"), ["o_custkey"], {"price": F.col("o_totalprice")}, {"q": 0.9})
    return out.select("o_custkey", r4(F.col("price_q"), "q"))


@query("WITH r AS (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS k FROM part) SELECT p_brand, p_partkey, p_retailprice FROM r ORDER BY k > 1, p_retailprice, p_brand, p_partkey LIMIT 40")
def d7_finalists(t):
    return L.finalists(t("part").select("p_brand", "p_partkey", "p_retailprice"), "p_brand", "p_partkey", ["p_retailprice"], 40)


@query("SELECT p_partkey FROM part ORDER BY p_size, p_partkey DESC LIMIT (SELECT round_even(count(*) * 0.1, 0)::BIGINT FROM part)")
def t4_least_important(t):
    return L.least_important(t("part"), "p_partkey", "p_size", 0.1)


@query("WITH s AS (SELECT p_brand, sum(p_size) AS v FROM part GROUP BY p_brand), r AS (SELECT *, row_number() OVER (ORDER BY abs(v) DESC, p_brand) AS k FROM s) SELECT CASE WHEN k <= 6 THEN p_brand ELSE 'other' END AS p_brand, sum(v)::BIGINT AS v, min(k)::BIGINT AS place FROM r GROUP BY 1")
def v7_top_drivers(t):
    out = L.top_drivers(t("part").groupBy("p_brand").agg(F.sum("p_size").alias("v")), "p_brand", "v")
    return out.withColumn("place", F.col("place").cast("long"))


@query("SELECT p_partkey, p_size::BIGINT AS base, p_size + p_partkey % 3 AS other, p_partkey % 3 AS delta FROM part")
def m27_compared(t):
    size, k = F.col("p_size").cast("long"), F.col("p_partkey").cast("long")
    return L.compared(t("part").select("p_partkey", size.alias("m")), t("part").select("p_partkey", (size + k % 3).alias("m")), "p_partkey", "m")


# Models and their explanations


@query(
    "WITH a AS (SELECT p_partkey, p_retailprice AS y, f AS feature, x FROM (SELECT *, 'p_size' AS f, nullif(p_size, 7)::VARCHAR AS x FROM part UNION ALL SELECT *, 'p_name', p_name FROM part UNION ALL SELECT *, 'p_partkey', p_partkey::VARCHAR FROM part)), "
    "t AS (SELECT * FROM a WHERE p_partkey % 2 = 0), c AS (SELECT feature, x, count(*) AS n, median(y) AS m FROM t GROUP BY ALL), "
    "own AS (SELECT feature, count(x) AS unique_count, count(x) / sum(n) AS unique_ratio, coalesce(sum(n) FILTER (WHERE x IS NULL), 0) / sum(n) AS missing_fraction, CASE WHEN feature = 'p_name' THEN stddev_pop(m) END AS category_median_std FROM c GROUP BY feature), "
    "v AS (SELECT feature, avg(CASE WHEN x IN (SELECT x FROM t WHERE t.feature = a.feature AND x IS NOT NULL) THEN 0.0 ELSE 1.0 END) AS unseen FROM a WHERE p_partkey % 2 = 1 AND x IS NOT NULL GROUP BY feature), "
    "r AS (SELECT feature, abs(corr(x::DOUBLE, y)) AS r FROM t WHERE feature <> 'p_name' GROUP BY feature), "
    "j AS (SELECT feature, x, floor(y / 100) AS b, count(*) AS n FROM t WHERE x IS NOT NULL GROUP BY ALL), k AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature)::DOUBLE AS s, sum(n) OVER (PARTITION BY feature, x)::DOUBLE AS p, sum(n) OVER (PARTITION BY feature, b)::DOUBLE AS q FROM j), "
    "i AS (SELECT feature, greatest(sum(n / s * ln(n * s / (p * q))), 0) AS mi FROM k GROUP BY feature) "
    "SELECT feature, unique_count, round(unique_ratio, 4) AS unique_ratio, round(missing_fraction, 4) AS missing_fraction, round(category_median_std, 4) AS category_median_std, round(unseen, 4) AS validation_unseen_fraction, round(r, 4) AS abs_corr_with_target, round(mi, 4) AS mutual_information, "
    "concat_ws(';', CASE WHEN unique_ratio > 0.5 THEN 'very_high_cardinality' END, CASE WHEN r >= 0.95 THEN 'very_high_target_correlation' END, CASE WHEN mi >= 1 THEN 'high_mutual_information' END) AS suspicion_flags FROM own LEFT JOIN v USING (feature) LEFT JOIN r USING (feature) LEFT JOIN i USING (feature)"
)
def m24_suspicion(t):
    part = t("part").withColumn("p_size", F.nullif("p_size", F.lit(7)))
    even, odd = part.where("p_partkey % 2 = 0"), part.where("p_partkey % 2 = 1")
    return rounded(Q.suspicion(even, {"validation": odd}, ["p_size", "p_name", "p_partkey"], "p_retailprice", F.floor(F.col("p_retailprice") / 100)))



@query(
    "WITH n AS (SELECT f AS feature, x, floor(p_retailprice / 100)::INT AS y, count(*) AS n FROM (SELECT 'p_size' AS f, p_size::VARCHAR AS x, p_retailprice FROM part UNION ALL SELECT 'p_brand', p_brand, p_retailprice FROM part) GROUP BY ALL), "
    "s AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature)::DOUBLE AS t, sum(n) OVER (PARTITION BY feature, x)::DOUBLE AS a, sum(n) OVER (PARTITION BY feature, y)::DOUBLE AS b FROM n) SELECT feature, sum(n)::BIGINT AS rows, round(greatest(sum(n / t * ln(n * t / (a * b))), 0), 4) AS mutual_information FROM s GROUP BY feature"
)
def a29_mutual_information(t):
    out = A.mi_binned(t("part"), {"p_size": F.col("p_size"), "p_brand": F.col("p_brand")}, F.floor(F.col("p_retailprice") / 100))
    return out.select("feature", "rows", r4(F.col("mutual_information"), "mutual_information"))


@query(
    "SELECT p_partkey, 'year_start' AS feature, 'Compatible year start' AS label, (1950 + p_size)::VARCHAR AS shown FROM part UNION ALL "
    "SELECT p_partkey, 'year_mid', 'Vehicle generation midpoint', CASE WHEN p_size % 2 = 0 THEN (p_size // 2)::VARCHAR ELSE (p_size // 2)::VARCHAR || '.5' END FROM part UNION ALL "
    "SELECT p_partkey, 'mileage', 'Mileage', replace(format('{:,}', p_size * 12345), ',', ' ') || ' km' FROM part UNION ALL SELECT p_partkey, 'repair_status', 'Repair status', 'Missing' FROM part"
)
def f19_feature_labels(t):
    size = F.col("p_size")
    own = {"year_start": 1950 + size, "year_mid": size / 2, "mileage": size * 12345, "repair_status": F.lit(None)}
    rows = t("part").select("p_partkey", F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), v.cast("string").alias("value")) for k, v in own.items()))).alias("s")).select("p_partkey", "s.*")
    return rows.select("p_partkey", "feature", X.feature_label(F.col("feature")).alias("label"), X.feature_value(F.col("feature"), F.col("value")).alias("shown"))


_EFFECTS = (
    "WITH b AS (SELECT p_size AS s, p_retailprice AS p FROM part WHERE p_partkey <= 4), e AS (SELECT p_partkey, 'p_size' AS feature, avg((p_size - s) * (p_retailprice + p) / 2) AS effect, avg(s * p) AS base FROM part, b GROUP BY p_partkey "
    "UNION ALL SELECT p_partkey, 'p_retailprice', avg((p_retailprice - p) * (p_size + s) / 2), avg(s * p) FROM part, b GROUP BY p_partkey)"
)


def _product_effects(t):
    """Of a product of two features both orders are all there are, so the effects are exact."""
    part = t("part").withColumn("p_size", F.col("p_size").cast("double"))
    return E.effects(part, "p_partkey", ["p_size", "p_retailprice"], part.where("p_partkey <= 4"), lambda df: df.withColumn("predicted", F.col("p_size") * F.col("p_retailprice")), pairs=5)


@query(f"{_EFFECTS} SELECT e.p_partkey, feature, round(effect, 2) AS effect, round(base, 2) AS base, round(p_size * p_retailprice, 2) AS predicted FROM e JOIN part USING (p_partkey)")
def m28_effects(t):
    return _product_effects(t).select("p_partkey", "feature", *(F.round(c, 2).alias(c) for c in ("effect", "base", "predicted")))


@query("SELECT count(*) AS rows, 0::BIGINT AS not_finite, 0::BIGINT AS too_large, true AS sound FROM part")
def m29_checked_effects(t):
    return E.checked(_product_effects(t), "p_partkey").select("rows", "not_finite", "too_large", "sound")


@query(f"{_EFFECTS}, i AS (SELECT feature, avg(abs(effect)) AS a, avg(effect) AS m, median(abs(effect)) AS d FROM e GROUP BY feature) SELECT feature, round(a, 2) AS mean_abs, round(m, 2) AS mean, round(d, 2) AS median_abs, round(a / sum(a) OVER (), 4) AS share FROM i")
def m30_effect_importances(t):
    return E.importances(_product_effects(t)).select("feature", *(F.round(c, 2).alias(c) for c in ("mean_abs", "mean", "median_abs")), r4(F.col("share"), "share"))


_PART_FEATURES = ["p_size", "p_brand", "p_type"]


@query()
def m8_m21_forest_cv(t):
    """Out-of-fold errors by fold: forests depend on how rows are laid out, so there is no SQL for them."""
    out = D.grouped_cv(t("part"), "p_name", _PART_FEATURES, D.fit_predict("forest", "p_retailprice", numTrees=8, maxDepth=5), 3)
    return A.errors_by(out, ["fold"])


@query()
def m12_forest_ranges(t):
    bundle = V.fitted(t("part"), _PART_FEATURES, "p_retailprice", metrics={"test_RMSE": 10.0}, numTrees=8, maxDepth=5)
    return bundle.ranges(t("part"))


@query()
def m28_forest_effects(t):
    bundle = V.fitted(t("part"), _PART_FEATURES, "p_retailprice", numTrees=8, maxDepth=5)
    return E.effects(t("part"), "p_partkey", _PART_FEATURES, t("part").where("p_partkey <= 20"), bundle.predict, pairs=4)


# (tree, node, feature, threshold, left, right, value): two small trees over size, price and key.
_TREES = [
    (0, 0, 0, 20.0, 1, 2, None), (0, 1, 1, 1200.0, 3, 4, None), (0, 2, 0, 40.0, 5, 6, None), (0, 3, -1, None, -1, -1, 1.0), (0, 4, -1, None, -1, -1, 5.0), (0, 5, 1, 1500.0, 7, 8, None),
    (0, 6, -1, None, -1, -1, 10.0), (0, 7, -1, None, -1, -1, 2.0), (0, 8, -1, None, -1, -1, 3.0), (1, 0, 2, 50.0, 1, 2, None), (1, 1, -1, None, -1, -1, -4.0), (1, 2, 0, 30.0, 3, 4, None), (1, 3, -1, None, -1, -1, 0.5), (1, 4, -1, None, -1, -1, 7.0),
]
_TREE_SQL = [
    lambda s, p: f"(CASE WHEN {s} <= 20 THEN CASE WHEN {p} <= 1200 THEN 1.0 ELSE 5.0 END WHEN {s} <= 40 THEN CASE WHEN {p} <= 1500 THEN 2.0 ELSE 3.0 END ELSE 10.0 END)",
    lambda s, k: f"(CASE WHEN {k} <= 50 THEN -4.0 WHEN {s} <= 30 THEN 0.5 ELSE 7.0 END)",
]


def _pair_effect(tree, first: tuple[str, str], second: tuple[str, str], of_first: bool) -> str:
    """The Shapley value of one of two features, each given as (the row's value, the background's)."""
    (x, b), (y, c) = first, second
    return f"(({tree(x, c)} - {tree(b, c)} + {tree(x, y)} - {tree(b, y)}) / 2)" if of_first else f"(({tree(b, y)} - {tree(b, c)} + {tree(x, y)} - {tree(x, c)}) / 2)"


_S, _P, _K = ("r.p_size", "g.p_size"), ("r.p_retailprice", "g.p_retailprice"), ("r.p_partkey % 101", "g.p_partkey % 101")
_TREE_EFFECTS = [
    ("p_size", f"{_pair_effect(_TREE_SQL[0], _S, _P, True)} + {_pair_effect(_TREE_SQL[1], _S, _K, True)}"),
    ("p_retailprice", _pair_effect(_TREE_SQL[0], _S, _P, False)),
    ("key", _pair_effect(_TREE_SQL[1], _S, _K, False)),
]


@query(
    " UNION ALL ".join(
        f"SELECT r.p_partkey, '{name}' AS feature, round(avg(({effect})::DOUBLE), 4) + 0.0::DOUBLE AS effect, round(avg(({_TREE_SQL[0](_S[1], _P[1])} + {_TREE_SQL[1](_S[1], _K[1])})::DOUBLE), 4) AS base, "
        f"({_TREE_SQL[0](_S[0], _P[0])} + {_TREE_SQL[1](_S[0], _K[0])})::DOUBLE AS predicted FROM part r, (SELECT * FROM part WHERE p_partkey <= 30) g GROUP BY r.p_partkey, r.p_size, r.p_retailprice"
        for name, effect in _TREE_EFFECTS
    )
)
def m28_tree_effects(t):
    """Of two small trees: the path walk against the definition of Shapley values."""
    part = t("part")
    rows = part.select("p_partkey", F.array(F.col("p_size").cast("double"), F.col("p_retailprice").cast("double"), (F.col("p_partkey") % 101).cast("double")).alias("features"))
    nodes = part.sparkSession.createDataFrame([(a, b, c, d, None, e, f, g) for a, b, c, d, e, f, g in _TREES], B.NODE_SCHEMA)
    out = B.tree_effects(rows, "p_partkey", nodes, rows.where("p_partkey <= 30"), ["p_size", "p_retailprice", "key"])
    return rounded(out).withColumn("effect", F.col("effect") + 0.0)  # no negative zeros


@query("SELECT count(*) AS rows, 0::BIGINT AS not_finite, 0::BIGINT AS too_large, true AS sound, true AS exact FROM part")
def m28_m29_tree_explainer(t):
    """A fitted forest over encoded columns: its effects by raw feature add up to its own predictions."""
    part = t("part")
    bundle = V.fitted(part, _PART_FEATURES, "p_retailprice", numTrees=8, maxDepth=5)
    found = B.model_effects(bundle, part, "p_partkey", part.where("p_partkey <= 20"))
    own = bundle.predict(part).select("p_partkey", F.col("predicted").alias("own"))
    met = found.groupBy("p_partkey").agg((F.sum("effect") + F.first("base")).alias("rebuilt")).join(own, "p_partkey")
    exact = met.agg((F.max(F.abs(F.col("rebuilt") - F.col("own"))) < 1e-6).alias("exact"))
    return E.checked(found, "p_partkey").select("rows", "not_finite", "too_large", "sound").join(F.broadcast(exact))  # one row each


@query()
def m9_m21_stopped_boosting(t):
    """Out-of-fold errors by fold of boosting whose number of rounds groups held out of its training rows choose."""
    callback = B.stopped_fit_predict("p_retailprice", "p_name", rounds=12, patience=3, maxDepth=3)
    out = D.grouped_cv(t("part"), "p_name", ["p_size", "p_brand"], callback, 2)
    return A.errors_by(out, ["fold"])


@query(
    "WITH l AS (SELECT 'p_name' AS c, p_name AS v FROM part WHERE p_partkey % 2 = 0 UNION SELECT 'p_type', p_type FROM part WHERE p_partkey % 2 = 0), k AS (SELECT c, v, (row_number() OVER (PARTITION BY c ORDER BY v) - 1)::DOUBLE AS code FROM l) "
    "SELECT p_partkey, a.code AS p_name_code, b.code AS p_type_code FROM part LEFT JOIN (SELECT * FROM k WHERE c = 'p_name') a ON a.v = p_name LEFT JOIN (SELECT * FROM k WHERE c = 'p_type') b ON b.v = p_type"
)
def m6_frozen_levels(t):
    """Levels of even parts, saved and read again; those that only odd parts have are missing."""
    part = t("part")
    spark, path = part.sparkSession, R.scratch_path(part.sparkSession)
    C.FrozenLevels.of(part.where("p_partkey % 2 = 0"), ["p_name", "p_type"]).save(path)
    return C.FrozenLevels.load(spark, path)(part).select("p_partkey", "p_name_code", "p_type_code")


@query(
    "WITH a AS (SELECT *, avg(o_totalprice) OVER () AS m FROM orders), "
    "s AS (SELECT o_orderkey, m, sum(o_totalprice) OVER w AS s, count(*) OVER w AS n FROM a WINDOW w AS (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey || ':42'), o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) "
    "SELECT o_orderkey, round((coalesce(s, 0) + m) / (n + 1), 3) AS statistic FROM s"
)
def m10_ordered_statistics(t):
    """Of three states, each a third of all orders or more."""
    out = C.ordered_statistics(t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderstatus", "o_totalprice", "o_orderkey")
    return out.select("o_orderkey", F.round("statistic", 3).alias("statistic"))


@query()
def m10_m21_ordered_boosting(t):
    """Out-of-fold errors by fold of boosting over ordered target statistics."""
    callback = C.ordered_fit_predict("p_retailprice", "p_partkey", maxIter=6, maxDepth=3)
    return A.errors_by(D.grouped_cv(t("part"), "p_name", _PART_FEATURES, callback, 2), ["fold"])


# Audits, crawls and streams


@query(
    "WITH s AS (SELECT p_partkey % 3 AS k, p_name, p_size, p_brand, p_retailprice FROM part), g AS (SELECT count(DISTINCT k) AS k FROM s GROUP BY p_name), d AS (SELECT count(DISTINCT k) AS k FROM s GROUP BY p_size, p_brand, p_retailprice) "
    "SELECT 'group_overlap' AS \"check\", CASE WHEN sum(k * (k - 1) / 2) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, sum(k * (k - 1) / 2)::BIGINT AS hits, '' AS detail FROM g UNION ALL "
    "SELECT 'cross_split_exact_duplicates', CASE WHEN sum(k * (k - 1) / 2) > 0 THEN 'FAIL' ELSE 'PASS' END, sum(k * (k - 1) / 2)::BIGINT, '' FROM d UNION ALL SELECT 'target_in_features', 'PASS', 0, '' UNION ALL "
    "SELECT 'deterministic_or_near_target_numeric_features', 'FAIL', 1, 'twice' UNION ALL SELECT 'future_or_listing_history_columns', 'PASS', 0, '' UNION ALL SELECT 'split_specific_preparation', 'WARN', 1, 'first_seen_day_offset'"
)
def m25_integrity(t):
    """Three splits of parts that share names; one feature is twice the target, and one an offset of dates."""
    own = t("part").select("p_name", "p_size", "p_brand", "p_retailprice", (F.col("p_retailprice") * 2 + 1).alias("twice"), F.lit(3).alias("first_seen_day_offset"), (F.col("p_partkey") % 3).alias("k"))
    splits = {n: own.where(F.col("k") == i).drop("k") for i, n in enumerate(("train", "validation", "test"))}
    return I.integrity(splits, ["p_size", "p_brand", "twice", "first_seen_day_offset"], "p_retailprice", "p_name")


_NEAR_SQL = (
    "WITH h AS (SELECT i::BIGINT AS n, coalesce(sum(1.0::DOUBLE / i) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 0.5772156649015329 AS psi FROM range(1, 6001) r(i)), "
    "s AS (SELECT p_partkey AS k, sqrt(p_partkey) AS x, ln(p_retailprice) AS y, p_brand AS b FROM part ORDER BY md5(p_partkey || ':42'), p_partkey LIMIT 5000), "
    "z AS (SELECT k, b, x / (SELECT stddev_pop(x) FROM s) AS x, y / (SELECT stddev_pop(y) FROM s) AS y, count(*) OVER (PARTITION BY b) AS c FROM s), "
    "d AS (SELECT p.k, p.c, p.b = q.b AS same, abs(p.x - q.x) AS dx, abs(p.y - q.y) AS dy FROM z p, z q), "
    "r AS (SELECT k, any_value(c) AS c, (min(greatest(dx, dy), 4))[4] AS r, (min(dy, 4) FILTER (same))[least(4, any_value(c))] AS own FROM d GROUP BY k), "
    "m AS (SELECT d.k, any_value(r.c) AS c, greatest(count(*) FILTER (dx < r), 1) AS nx, greatest(count(*) FILTER (dy < r), 1) AS ny, greatest(count(*) FILTER (dy < own), 1) AS m FROM d JOIN r USING (k) GROUP BY d.k), "
    "one AS (SELECT count(*) AS n FROM s) "
)


@query(
    f"{_NEAR_SQL} SELECT 'root' AS feature, any_value(one.n) AS rows, round(greatest((SELECT psi FROM h WHERE h.n = any_value(one.n)) + (SELECT psi FROM h WHERE h.n = 3) - avg(a.psi) - avg(b.psi), 0), 3) AS mutual_information FROM m JOIN h a ON a.n = nx JOIN h b ON b.n = ny, one UNION ALL "
    "SELECT 'p_brand', any_value(one.n), round(greatest((SELECT psi FROM h WHERE h.n = any_value(one.n)) + avg(k.psi) - avg(c.psi) - avg(a.psi), 0), 3) FROM m JOIN h k ON k.n = least(3, c - 1) JOIN h c ON c.n = m.c JOIN h a ON a.n = m.m, one"
)
def a29_nearest_information(t):
    """By third neighbours, of a number and of a text with the price."""
    out = I.mutual_information(t("part"), {"root": F.sqrt("p_partkey"), "p_brand": F.col("p_brand")}, F.log("p_retailprice"), "p_partkey", noise=0.0)
    return out.select("feature", "rows", F.round("mutual_information", 3).alias("mutual_information"))


@query(
    "WITH RECURSIVE l AS (SELECT 'page ' || page_id AS p, unnest(regexp_extract_all(html, '<a\\s[^>]*href=[\"'']([^\"'']+)[\"'']', 1, 'is')) AS h FROM pages), e AS (SELECT p AS src, h AS dst FROM l UNION SELECT h, p FROM l), "
    "f(node, round) AS (SELECT 'page 0', 0 UNION SELECT dst, round + 1 FROM f JOIN e ON src = node WHERE round < 5) SELECT node, min(round)::INT AS round FROM f GROUP BY node"
)
def s15_frontier(t):
    """Pages are reached through links that they share; five rounds from one page."""
    found = P.links(t("pages")).select(F.concat(F.lit("page "), F.col("page_id")).alias("p"), F.col("href").alias("h"))
    links = found.select(F.col("p").alias("src"), F.col("h").alias("dst")).unionAll(found.select("h", "p"))
    return W.reached(links, t("pages").where("page_id = 0").select(F.concat(F.lit("page "), F.col("page_id")).alias("node")), 5)


@query(_SQL["w1_w6_point_in_time"])
def w2_w6_streamed_history(t):
    """Snapshots come in files that are out of order; what is kept in the end is what all rows at once give."""
    own = t("events").select("user_id", "event_id", F.col("ts").cast("date").alias("d"), "value")
    spark, root = own.sparkSession, R.scratch_path(own.sparkSession)
    own.repartition(6, F.md5(F.col("event_id").cast("string").cast("binary"))).write.parquet(f"{root}/in")
    stream = T.snapshots(spark, f"{root}/in", own.schema, 2)
    T.keep_histories(stream, f"{root}/kept", "user_id", "d", "value", "event_id", buckets=4).awaitTermination()
    return rounded(T.histories(spark, f"{root}/kept").select("event_id", "user_id", "observations_so_far", "days_since_first_seen", "first_price", "price_change_event", "price_changes_so_far", "absolute_change_so_far", "relative_change_so_far"))


@query()
def m22_ablations(t):
    """Errors of a linear model for each list of features."""
    own = t("part").withColumn("p_key_id", F.col("p_partkey"))
    features = ["p_size", "p_brand", "p_key_id"]
    groups = L.token_groups(features, {"id_like": ("_id",), "size": ("size",)})
    variants = I.ablations(own, features, groups, ["p_size", "p_brand"])
    return I.ablated(own.where("p_partkey % 4 > 0"), own.where("p_partkey % 4 = 0"), variants, D.fit_predict("linear", "p_retailprice", regParam=0.1))


@query()
def m18_m19_ranked_candidates(t):
    """Candidates by their errors over group folds."""
    candidates = [{"name": n, "kind": "linear", "features": f, "options": {"regParam": 0.1}} for n, f in (("size", ["p_size"]), ("key", ["p_partkey"]), ("both", ["p_size", "p_partkey"]))]
    found = D.ranked_candidates(t("part"), "p_name", "p_retailprice", candidates, 2)
    return t("part").sparkSession.createDataFrame([(i + 1, c["name"], c["mae"], c["rmse"]) for i, c in enumerate(found)], "place int, name string, mae double, rmse double")


@query()
def m26_pruning(t):
    """Errors without the least important features, by share left out."""
    part = t("part")
    weights = part.agg(*(F.abs(F.corr(c, "p_retailprice")).alias(c) for c in ("p_size", "p_partkey")))
    importances = weights.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("importance")) for c in ("p_size", "p_partkey")))).alias("s")).select("s.*")
    found = D.pruning_sweep(part, "p_name", ["p_size", "p_partkey"], importances, D.fit_predict("linear", "p_retailprice", regParam=0.1), (0.1, 0.5), 2)
    return part.sparkSession.createDataFrame([(c["share"], c["kept"], c["mae"]) for c in found], "share double, kept int, mae double")


@query(
    "SELECT s_suppkey::VARCHAR AS id, CASE s_suppkey % 3 WHEN 0 THEN s_name || ' dörr €' WHEN 1 THEN s_name || ' dörr' ELSE s_name || ' €' END AS name, CASE s_suppkey % 3 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'iso-8859-1' ELSE 'cp1252' END AS encoding, false AS broken FROM supplier UNION ALL "
    "SELECT NULL, s_suppkey || ',' || s_name || ',more', 'utf-8', true FROM supplier WHERE s_suppkey % 3 = 0"
)
def s2_s23_reading_ladder(t):
    """Suppliers in files of three encodings, one with lines of a field too many."""
    own = t("supplier").select(F.col("s_suppkey").cast("string").alias("id"), "s_name", (F.col("s_suppkey") % 3).alias("k"))
    spark, root = own.sparkSession, R.scratch_path(own.sparkSession)
    line = lambda *ends: F.concat("id", F.lit(","), "s_name", *map(F.lit, ends))
    latin = lambda *ends: F.encode(line(*ends), "ISO-8859-1").cast("string")
    for k, value in ((0, F.explode(F.array(line(" dörr €"), line(",more")))), (1, latin(" dörr")), (2, latin(" \x80"))):
        body = own.where(F.col("k") == k).select(F.lit(1).alias("o"), value.alias("value"))
        whole = spark.range(1).select(F.lit(0).alias("o"), F.lit("\ufeffId,Name" if k == 0 else "id,name").alias("value")).unionAll(body)
        whole.coalesce(1).sortWithinPartitions("o").select("value").write.text(f"{root}/{k}")
    read = Y.read_ladder(spark, f"{root}/*/*.txt")
    fine = read.rows.join(read.encodings, "source_file").select("id", "name", "encoding", F.lit(False).alias("broken"))
    return fine.unionAll(read.quarantine.select(F.lit(None).cast("string"), "text", "encoding", F.lit(True)))


@query()
def m16_m17_m18_search(t):
    """Screening, refinement and group folds of linear models over two lists of features: a row for each finalist."""
    part = t("part")
    found = J.searched(part.where("p_partkey % 4 > 0"), part.where("p_partkey % 4 = 0"), "p_name", "p_retailprice", {"key": ["p_partkey"], "both": ["p_partkey", "p_size"]}, {"regParam": (0.01, 10.0)}, "linear", 1, 2, 1, 2)
    return found.ranked


# Experiments on a fixed split


_LISTS = {"customer": O.Variant(["o_custkey", "o_absent"]), "order": O.Variant(["o_orderkey"]), "again": O.Variant(["o_custkey"]), "leak": O.Variant(["o_twice"], False)}
_SETTINGS = {"log": O.Config("linear", True), "raw": O.Config("linear", note="the price itself")}
_GRID = (
    "WITH o AS (SELECT o_orderkey % 5 AS k, o_totalprice AS y, o_custkey AS a, o_orderkey AS b, o_totalprice * 2 + 1 AS c FROM orders), "
    "l AS (SELECT k, y, unnest([1, 2, 3]) AS priority, unnest(['customer', 'order', 'leak']) AS variant, unnest([a, b, c])::DOUBLE AS x FROM o), "
    "s AS (SELECT *, CASE config WHEN 'log' THEN ln(y) ELSE y END AS z FROM l, (SELECT unnest(['log', 'raw']) AS config)), "
    "m AS (SELECT variant, config, regr_slope(z, x) AS u, regr_intercept(z, x) AS v, max(y) AS top FROM s WHERE k > 1 GROUP BY ALL), "
    "e AS (SELECT variant, config, priority, avg(abs(y - p)) AS mae, sqrt(avg((y - p) ** 2)) AS rmse, count(*) AS n FROM (SELECT s.*, CASE config WHEN 'log' THEN least(exp(u * x + v), 10 * top) ELSE greatest(u * x + v, 0) END AS p FROM s JOIN m USING (variant, config) WHERE k = 1) GROUP BY ALL), "
    "g AS (SELECT *, row_number() OVER (ORDER BY variant = 'leak', mae, rmse, priority, config) AS place FROM e) "
)


def _order_splits(t):
    own = t("orders").select("o_orderkey", "o_custkey", "o_totalprice", (F.col("o_totalprice") * 2 + 1).alias("o_twice"))
    k = F.col("o_orderkey") % 5
    return own.where(k > 1), own.where(k == 1), own.where(k == 0)


@query(_GRID + "SELECT variant, config, priority, variant <> 'leak' AS trusted, CASE variant WHEN 'customer' THEN 'o_absent' ELSE '' END AS missing, n AS rows, round(mae, 3) AS mae, round(rmse, 3) AS rmse, place::INT AS place, place = 1 AS selected FROM g")
def m33_experiment_grid(t):
    """Three lists of features, one of which holds the target and may not win, by two settings; a fourth list is the first one again."""
    train, validation, _ = _order_splits(t)
    out = O.grid(train, validation, "o_totalprice", _LISTS, _SETTINGS)
    return out.select("variant", "config", "priority", "trusted", F.concat_ws(",", "missing").alias("missing"), "rows", F.round("mae", 3).alias("mae"), F.round("rmse", 3).alias("rmse"), "place", "selected")


@query(
    _GRID + ", w AS (SELECT variant, config FROM g WHERE place = 1), h AS (SELECT * FROM s JOIN w USING (variant, config)), f AS (SELECT regr_slope(z, x) AS u, regr_intercept(z, x) AS v, count(*) AS fit_rows FROM h WHERE k > 0), "
    "d AS (SELECT y, CASE config WHEN 'log' THEN exp(u * x + v) ELSE greatest(u * x + v, 0) END AS p, fit_rows FROM h, f WHERE k = 0) "
    "SELECT any_value(w.variant) AS variant, any_value(w.config) AS config, 1 AS feature_count, any_value(fit_rows) AS fit_rows, count(*) AS test_rows, round(avg(abs(y - p)), 3) AS mae, round(sqrt(avg((y - p) ** 2)), 3) AS rmse, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 4) AS r2 FROM d, w"
)
def m32_s20_held_out(t):
    """The grid's reports are written, the best one is read again, fitted on both parts, and judged on the third."""
    train, validation, test = _order_splits(t)
    found = O.grid(train, validation, "o_totalprice", _LISTS, _SETTINGS)
    path = R.scratch_path(train.sparkSession)
    O.write_reports(found, found.select("variant", "config", F.lit(0).alias("fold"), "mae"), path)
    out = O.held_out(train, validation, test, "o_totalprice", O.read_best(train.sparkSession, path), "linear")
    return out.select("variant", "config", "feature_count", "fit_rows", "test_rows", F.round("mae", 3).alias("mae"), F.round("rmse", 3).alias("rmse"), r4(F.col("r2"), "r2"))


@query(
    "SELECT * FROM (SELECT 'o_orderkey' AS feature, 'excluded' AS status, 'a key' AS reason, 1.0 AS filled_share UNION ALL SELECT 'o_totalprice_later', 'leaking', 'of a later day', round(count(CASE WHEN o_totalprice > 100000 THEN 1 END) / count(*), 4) FROM orders "
    "UNION ALL SELECT 'o_custkey', 'kept', 'in the list before', 1.0 UNION ALL SELECT 'o_orderstatus', 'new', 'in the table and not in the list before', round(count(CASE WHEN o_orderstatus <> 'F' THEN 1 END) / count(*), 4) FROM orders UNION ALL SELECT 'o_absent', 'missing', 'in the list before and not in the table', NULL)"
)
def m34_feature_audit(t):
    own = t("orders").select("o_orderkey", "o_custkey", "o_totalprice", F.nullif("o_orderstatus", F.lit("F")).alias("o_orderstatus"), F.when(F.col("o_totalprice") > 100000, 1).alias("o_totalprice_later"))
    out = O.feature_audit(own, "o_totalprice", ["o_custkey", "o_absent"], {"o_orderkey": "a key"}, {"o_totalprice_later": "of a later day"})
    return out.withColumn("filled_share", r4(F.col("filled_share"), "filled_share"))


@query(
    "SELECT p_partkey, 'p_brand' AS feature, p_size + 1 AS effect FROM part UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'p_brand_group' ELSE 'p' END, p_size * 2 FROM part "
    "UNION ALL SELECT p_partkey, 'p_size', p_size * 3 FROM part UNION ALL SELECT p_partkey, 'own', p_size * 4 FROM part"
)
def f20_raw_features(t):
    """Effects of encoded columns by raw feature: names that begin other names, and levels that hold the mark between both."""
    levels = F.array(
        F.struct(F.concat(F.lit("cat__p_brand_"), F.translate("p_brand", "#", "_")).alias("encoded"), F.col("p_size").alias("effect")),
        F.struct(F.lit("cat__p_brand").alias("encoded"), F.lit(1).alias("effect")),
        F.struct(F.when(F.col("p_partkey") % 2 == 0, "cat__p_brand_group_a_b").otherwise("cat__p_x").alias("encoded"), (F.col("p_size") * 2).alias("effect")),
        F.struct(F.lit("num__p_size").alias("encoded"), (F.col("p_size") * 3).alias("effect")),
        F.struct(F.lit("own").alias("encoded"), (F.col("p_size") * 4).alias("effect")),
    )
    rows = t("part").select("p_partkey", F.explode(levels).alias("s")).select("p_partkey", "s.*")
    return E.raw_effects(rows, "p_partkey", E.raw_feature(F.col("encoded"), ["p", "p_brand", "p_brand_group", "p_size"]))


@query(
    "WITH e AS (SELECT event_id, date_trunc('second', ts::TIMESTAMP) AS u, timezone('Europe/Helsinki', timezone('UTC', date_trunc('second', ts::TIMESTAMP))) AS h FROM events) "
    "SELECT event_id, strftime(h, '%Y-%m-%d') AS scrape_date, strftime(h, '%Y-%m-%dT%H:%M:%S') || CASE date_diff('hour', u, h) WHEN 3 THEN '+03:00' ELSE '+02:00' END AS scrape_timestamp FROM e"
)
def f39_local_stamps(t):
    day, time = N.local_stamp(F.col("ts"))
    return t("events").select("event_id", day.alias("scrape_date"), time.alias("scrape_timestamp"))


@query(
    "SELECT 'semicolon' AS form, s_suppkey::VARCHAR AS id, s_name || ' ä;ö' AS name FROM supplier UNION ALL SELECT 'comma', s_suppkey::VARCHAR, s_name || ', \"left\"' FROM supplier"
)
def s1_s3_delimited(t):
    """Suppliers in a file of semicolons in ISO-8859-1, and in one of commas with blanks before quoted texts that hold commas and quotes."""
    own = t("supplier")
    spark, root = own.sparkSession, R.scratch_path(own.sparkSession)
    own.select(F.col("s_suppkey").alias("ID"), F.concat("s_name", F.lit(" ä;ö")).alias("Name")).write.options(header=True, sep=";", encoding="ISO-8859-1").csv(f"{root}/semicolon")
    line = F.concat_ws(", ", "s_suppkey", F.concat(F.lit('"'), "s_name", F.lit(', ""left"""')))
    titled = spark.range(1).select(F.lit(0).alias("o"), F.lit(" ID , Name ").alias("value")).unionAll(own.select(F.lit(1), line))
    titled.coalesce(1).sortWithinPartitions("o").select("value").write.text(f"{root}/comma")
    a = R.read_csv(spark, f"{root}/semicolon", ";", "ISO-8859-1")
    return a.select(F.lit("semicolon").alias("form"), "id", "name").unionAll(R.read_csv(spark, f"{root}/comma").select(F.lit("comma"), "id", "name"))
