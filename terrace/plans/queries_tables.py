"""Queries over DataFrame operators: scans, projections, joins, aggregates, windows, sets, functions, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions import scalars as S
from terrace.operators import aggregates as A
from terrace.operators import quality as Q
from terrace.operators import reports as R
from terrace.operators import transforms as P
from terrace.plans import medallion
from terrace.plans.catalogue import Tables, query
from terrace.sources import files

c = F.col
MONEY = "DECIMAL(18,2)"


def _long(*names: str) -> dict:
    return {n: c(n).cast("long") for n in names}


# -- scans -----------------------------------------------------------------


@query("scan_query_file_limit", "SELECT * FROM nation ORDER BY n_nationkey LIMIT 10")
def _(t: Tables) -> DataFrame:
    return files.query_file(t.spark, f"{t.folder}/nation.parquet", "parquet").orderBy("n_nationkey").limit(10)


@query("scan_read_any", "SELECT r_regionkey, r_name FROM region")
def _(t: Tables) -> DataFrame:
    return files.read_any(t.spark, f"{t.folder}/region.parquet")


@query("scan_file_metadata", "SELECT n_nationkey, 'nation.parquet' AS file_name, true AS has_size, true AS has_time FROM nation")
def _(t: Tables) -> DataFrame:
    return files.with_file_metadata(t.nation).select("n_nationkey", "file_name", (c("file_size") > 0).alias("has_size"), (c("file_modification_time") <= F.current_timestamp()).alias("has_time"))


@query("scan_values", "SELECT * FROM (VALUES (1, 'laptop', 1200.5), (2, 'mouse', 25.25)) v(id, name, price)")
def _(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(1, "laptop", 1200.5), (2, "mouse", 25.25)], "id int, name string, price double")


# -- projections and filters -----------------------------------------------


@query("bronze_ingest", "SELECT c_custkey, upper(trim(c_name)) AS c_name, c_nationkey, c_acctbal, upper(trim(c_mktsegment)) AS c_mktsegment, 'CUSTOMER' AS _source_path, 'BRONZE' AS _data_layer FROM customer")
def _(t: Tables) -> DataFrame:
    return medallion.bronze(t.customer, "customer").drop("_ingestion_timestamp", "_processing_date")


@query("bronze_clean_strings", "SELECT p_partkey, upper(trim(p_name)) AS p_name, p_brand, upper(trim(p_type)) AS p_type FROM part")
def _(t: Tables) -> DataFrame:
    return P.clean_strings(t.part.select("p_partkey", "p_name", "p_brand", "p_type"), ["p_name", "p_type"])


def _holes(t: Tables) -> DataFrame:
    """Customers with nulls put in."""
    return t.customer.select("c_custkey", F.when(c("c_custkey") % 7 != 0, c("c_acctbal")).alias("c_acctbal"), F.when(c("c_custkey") % 5 != 0, c("c_mktsegment")).alias("c_mktsegment"))


_HOLES = "(SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer) h"


@query("null_drop", f"SELECT * FROM {_HOLES} WHERE c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return P.handle_nulls(_holes(t), {"c_acctbal": "drop", "c_mktsegment": "drop"})


@query("null_fill_default", f"SELECT c_custkey, coalesce(c_acctbal, 0) AS c_acctbal, coalesce(c_mktsegment, 'UNKNOWN') AS c_mktsegment FROM {_HOLES}")
def _(t: Tables) -> DataFrame:
    return P.handle_nulls(_holes(t))


@query("null_fill_mean", f"SELECT c_custkey, round(coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM {_HOLES})), 4) AS c_acctbal FROM {_HOLES}")
def _(t: Tables) -> DataFrame:
    return P.handle_nulls(_holes(t), {"c_acctbal": "fill_mean"}).select("c_custkey", F.round("c_acctbal", 4).alias("c_acctbal"))


@query("null_fill_median", f"SELECT c_custkey, round(coalesce(c_acctbal, (SELECT quantile_cont(c_acctbal, 0.5) FROM {_HOLES})), 4) AS c_acctbal FROM {_HOLES}")
def _(t: Tables) -> DataFrame:
    return P.handle_nulls(_holes(t), {"c_acctbal": "fill_median"}).select("c_custkey", F.round("c_acctbal", 4).alias("c_acctbal"))


@query("cast_types", "SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey, try_cast(o_orderpriority AS DOUBLE) AS o_orderpriority, o_orderdate::DATE AS o_orderdate FROM orders")
def _(t: Tables) -> DataFrame:
    return P.convert_types(t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate"), {"o_orderkey": "string", "o_orderpriority": "double", "o_orderdate": "date", "o_custkey": "money", "gone": "date"})


@query("rename_select", "SELECT o_orderkey AS order_id, o_custkey AS customer_id FROM orders")
def _(t: Tables) -> DataFrame:
    return P.select_existing(P.rename(t.orders, {"o_orderkey": "order_id", "o_custkey": "customer_id"}), ["order_id", "customer_id", "gone"])


@query("select_except", "SELECT * EXCLUDE (o_orderpriority, o_orderdate) FROM orders")
def _(t: Tables) -> DataFrame:
    t.orders.createOrReplaceTempView("terrace_orders")
    return t.spark.sql("SELECT * EXCEPT (o_orderpriority, o_orderdate) FROM terrace_orders")


for _name, _conditions, _where in (
    ("filter_equals", {"o_orderstatus": {"equals": "F"}}, "o_orderstatus = 'F'"),
    ("filter_not_equals", {"o_orderstatus": {"not_equals": "F"}}, "o_orderstatus <> 'F'"),
    ("filter_gt_lt", {"o_totalprice": {"greater_than": 1000, "less_than": 50000}, "gone": {"equals": 1}}, "o_totalprice > 1000 AND o_totalprice < 50000"),
    ("filter_contains", {"o_orderpriority": {"contains": "URG"}}, "contains(o_orderpriority, 'URG')"),
    ("filter_not_contains", {"o_orderpriority": {"not_contains": "URG"}}, "NOT contains(o_orderpriority, 'URG')"),
):
    query(_name, f"SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE {_where}")(lambda t, k=_conditions: P.filter_data(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"), k))


@query("filter_optional", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber = 1")
def _(t: Tables) -> DataFrame:
    return P.optional_equals(P.optional_equals(t.lineitem, "l_linenumber", 1), "l_suppkey", None).select("l_orderkey", "l_linenumber")


@query("filter_date_range", "SELECT o_orderkey FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1995-01-01' AND DATE '1996-06-30'")
def _(t: Tables) -> DataFrame:
    return P.date_range(t.orders, "1995-01-01", "1996-06-30").select("o_orderkey")


@query("filter_between_in", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_brand NOT IN ('Brand#11', 'Brand#12') AND p_retailprice NOT BETWEEN 1000 AND 1100")
def _(t: Tables) -> DataFrame:
    return t.part.filter(c("p_size").between(10, 20) & ~c("p_brand").isin("Brand#11", "Brand#12") & ~c("p_retailprice").between(1000, 1100)).select("p_partkey")


@query("order_tiers", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'high_value' WHEN o_totalprice > 10000 THEN 'medium_value' ELSE 'low_value' END AS order_category FROM orders")
def _(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", P.tier(c("o_totalprice"), 100000, 10000).alias("order_category"))


@query("quality_flags", "SELECT p_partkey, CASE WHEN p_partkey IS NOT NULL AND p_name IS NOT NULL THEN 'valid' ELSE 'invalid' END AS data_quality_flag, CASE WHEN p_retailprice >= 0 THEN 'valid_price' ELSE 'invalid_price' END AS price_quality_flag FROM part")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", P.flag(c("p_partkey").isNotNull() & c("p_name").isNotNull()).alias("data_quality_flag"), P.flag(c("p_retailprice") >= 0, "valid_price", "invalid_price").alias("price_quality_flag"))


@query("severity_like", "SELECT p_partkey, CASE WHEN p_type LIKE '%BRASS%' OR p_type LIKE '%STEEL%' THEN 'high_severity' WHEN p_type LIKE '%COPPER%' OR p_type LIKE '%TIN%' THEN 'medium_severity' ELSE 'low_severity' END AS severity_level FROM part")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", P.severity(c("p_type"), ["BRASS", "STEEL"], ["COPPER", "TIN"]).alias("severity_level"))


@query("stay_category", "SELECT l_orderkey, l_linenumber, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS calculated_los, CASE WHEN date_diff('day', o_orderdate::DATE, l_shipdate::DATE) > 30 THEN 'long_stay' WHEN date_diff('day', o_orderdate::DATE, l_shipdate::DATE) > 7 THEN 'medium_stay' ELSE 'short_stay' END AS stay_category FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(t: Tables) -> DataFrame:
    days = F.datediff("l_shipdate", "o_orderdate").cast("long")
    return t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey")).select("l_orderkey", "l_linenumber", days.alias("calculated_los"), P.tier(days, 30, 7, ("long_stay", "medium_stay", "short_stay")).alias("stay_category"))


@query("volume_loyalty", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 20 THEN 'high_volume' WHEN l_quantity > 10 THEN 'medium_volume' ELSE 'low_volume' END AS purchase_volume, CASE WHEN l_linenumber >= 2 THEN 'high_value' WHEN l_linenumber >= 1 THEN 'medium_value' ELSE 'low_value' END AS customer_segment FROM lineitem")
def _(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", P.tier(c("l_quantity"), 20, 10, ("high_volume", "medium_volume", "low_volume")).alias("purchase_volume"), P.tier(c("l_linenumber"), 2, 1, inclusive=True).alias("customer_segment"))


@query("taxi_flags", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 1 THEN 'multi' ELSE 'single' END AS passenger_type, l_tax > 0 AS has_tolls, ceil(l_quantity / 3)::BIGINT AS distance_ceil FROM lineitem")
def _(t: Tables) -> DataFrame:
    return P.taxi_flags(t.lineitem.withColumn("d", c("l_quantity") / 3), "l_linenumber", "d", "l_tax").select("l_orderkey", "l_linenumber", "passenger_type", "has_tolls", "distance_ceil")


@query("taxi_invalid_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0 AND NOT (l_quantity < 5 AND l_extendedprice > 100)")
def _(t: Tables) -> DataFrame:
    return P.drop_anomalies(t.lineitem, "l_quantity", "l_extendedprice").select("l_orderkey", "l_linenumber")


@query("taxi_kpis", f"SELECT sum(l_extendedprice::{MONEY})::DOUBLE AS total_amount, round(avg(l_extendedprice), 4) AS avg_amount, count(*) AS n_rows FROM lineitem")
def _(t: Tables) -> DataFrame:
    return A.kpis(t.lineitem, "l_extendedprice")


@query("vendor_view", "SELECT * EXCLUDE (l_suppkey) FROM lineitem WHERE l_suppkey = 7")
def _(t: Tables) -> DataFrame:
    return P.optional_equals(t.lineitem, "l_suppkey", 7).drop("l_suppkey")


@query("silver_standard", """
    WITH f AS (SELECT o_orderkey, coalesce(CASE WHEN o_custkey % 11 <> 0 THEN o_totalprice END, 0) AS o_totalprice, o_orderdate::DATE AS o_orderdate, o_custkey, o_orderstatus FROM orders),
    g AS (SELECT * FROM f WHERE o_totalprice > 500),
    d AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM g)
    SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_totalprice, o_orderdate, 'bronze' AS _source_path, 'silver' AS _data_layer FROM d WHERE rn = 1""")
def _(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("o_totalprice", F.when(c("o_custkey") % 11 != 0, c("o_totalprice")))
    config = medallion.Silver(nulls={"o_totalprice": "fill_default"}, types={"o_orderdate": "date"}, filters={"o_totalprice": {"greater_than": 500}}, keys=["o_custkey"], order_by=[c("o_orderdate").desc(), c("o_orderkey")], rename={"o_orderkey": "order_id", "o_custkey": "customer_id"}, select=["order_id", "customer_id", "o_totalprice", "o_orderdate"])
    return medallion.silver(rows, config).drop("_ingestion_timestamp", "_processing_date")


# -- windows, sets, limits -------------------------------------------------

_LINE = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
_LINE_SQL = "l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"


@query("dedup_first", f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LINE_SQL}) AS rn FROM lineitem) WHERE rn = 1")
def _(t: Tables) -> DataFrame:
    return P.deduplicate(t.lineitem, ["l_orderkey", "l_linenumber"], _LINE)


@query("dedup_last", f"SELECT * EXCLUDE (rn, n) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, {_LINE_SQL}) AS rn, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE rn = n")
def _(t: Tables) -> DataFrame:
    return P.deduplicate(t.lineitem, ["l_orderkey"], ["l_linenumber", *_LINE], keep="last")


@query("dedup_latest", "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def _(t: Tables) -> DataFrame:
    return P.latest_by_key(t.orders, ["o_custkey"], "o_orderdate", ["o_orderkey"])


@query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def _(t: Tables) -> DataFrame:
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query("union_all", "SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def _(t: Tables) -> DataFrame:
    return t.customer.select(c("c_custkey").alias("k"), c("c_name").alias("name")).unionAll(t.supplier.select("s_suppkey", "s_name"))


@query("union_by_name", "SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, 'customer' AS source FROM customer UNION ALL BY NAME SELECT s_name AS name, s_acctbal AS balance, 'supplier' AS source FROM supplier")
def _(t: Tables) -> DataFrame:
    a = t.customer.select(c("c_name").alias("name"), c("c_acctbal").alias("balance"), c("c_mktsegment").alias("segment"), F.lit("customer").alias("source"))
    b = t.supplier.select(c("s_acctbal").alias("balance"), c("s_name").alias("name"), F.lit("supplier").alias("source"))
    return a.unionByName(b, allowMissingColumns=True)


@query("top_customers", f"SELECT o_custkey, sum(o_totalprice::{MONEY})::DOUBLE AS total_spend FROM orders GROUP BY 1 ORDER BY total_spend DESC, o_custkey LIMIT 10")
def _(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(A.money_sum(c("o_totalprice")).alias("total_spend")).orderBy(F.desc("total_spend"), "o_custkey").limit(10)


@query("latest_row", "SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def _(t: Tables) -> DataFrame:
    return t.orders.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(1)


@query("head_tail", "(SELECT o_orderkey, 'head' AS part FROM orders ORDER BY o_orderkey LIMIT 5) UNION ALL (SELECT o_orderkey, 'tail' AS part FROM orders ORDER BY o_orderkey DESC LIMIT 5)")
def _(t: Tables) -> DataFrame:
    k = t.orders.select("o_orderkey")
    return k.orderBy("o_orderkey").limit(5).withColumn("part", F.lit("head")).unionAll(k.orderBy(F.desc("o_orderkey")).limit(5).withColumn("part", F.lit("tail")))


@query("page_offset", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 20 OFFSET 40")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", "p_name").orderBy("p_partkey").offset(40).limit(20)


@query("order_multi_key", "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2 ORDER BY n DESC, p_brand, p_size")
def _(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_brand", "p_size")


@query("value_counts_top5", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5")
def _(t: Tables) -> DataFrame:
    return A.value_counts(t.orders, "o_orderpriority")


_SUM = "SELECT '{0}' AS column_name, count({0})::DOUBLE AS stat_count, round(min({0}), 4)::DOUBLE AS stat_min, round(quantile_cont({0}, 0.25), 4)::DOUBLE AS stat_q25, round(quantile_cont({0}, 0.5), 4)::DOUBLE AS stat_q50, round(quantile_cont({0}, 0.75), 4)::DOUBLE AS stat_q75, round(max({0}), 4)::DOUBLE AS stat_max FROM orders"


@query("summary_stats", _SUM.format("o_totalprice") + " UNION ALL " + _SUM.format("o_custkey"))
def _(t: Tables) -> DataFrame:
    return A.summary(t.orders, ["o_totalprice", "o_custkey"])


# -- aggregates ------------------------------------------------------------


def _sales(t: Tables) -> DataFrame:
    """Bronze to silver: one row for each line of an order, with flags and tiers."""
    return t.orders.join(t.lineitem, c("o_orderkey") == c("l_orderkey")).select(
        c("o_orderkey").alias("order_id"), c("o_custkey").alias("customer_id"), c("l_partkey").alias("product_id"), c("l_quantity").alias("quantity"), c("l_extendedprice").alias("total_amount"),
        F.to_date("o_orderdate").alias("order_date"), F.hour("o_orderdate").cast("long").alias("order_hour"),
        P.tier(c("l_extendedprice"), 10000, 1000).alias("order_category"), P.flag(c("o_orderkey").isNotNull() & c("o_custkey").isNotNull()).alias("data_quality_flag"))


_SALES = "(SELECT o_orderkey AS order_id, o_custkey AS customer_id, l_partkey AS product_id, l_quantity AS quantity, l_extendedprice AS total_amount, o_orderdate::DATE AS order_date, hour(o_orderdate) AS order_hour, CASE WHEN l_extendedprice > 10000 THEN 'high_value' WHEN l_extendedprice > 1000 THEN 'medium_value' ELSE 'low_value' END AS order_category, CASE WHEN o_orderkey IS NOT NULL AND o_custkey IS NOT NULL THEN 'valid' ELSE 'invalid' END AS data_quality_flag FROM orders JOIN lineitem ON o_orderkey = l_orderkey) s"


def _tiers(column: str, value: str | None = None) -> list:
    out = [A.count_where(c(column) == f"{k}_value").alias(f"{k}_value_orders") for k in ("high", "medium", "low")]
    return out + ([A.sum_where(c(column) == f"{k}_value", c(value)).alias(f"{k}_value_revenue") for k in ("high", "medium", "low")] if value else [])


_TIERS = ", ".join(f"count(CASE WHEN order_category = '{k}_value' THEN 1 END) AS {k}_value_orders" for k in ("high", "medium", "low"))
_TIER_SUMS = ", ".join(f"sum(CASE WHEN order_category = '{k}_value' THEN total_amount ELSE 0 END::{MONEY})::DOUBLE AS {k}_value_revenue" for k in ("high", "medium", "low"))
_VALIDITY = "count(CASE WHEN data_quality_flag = 'valid' THEN 1 END) AS valid_records, count(CASE WHEN data_quality_flag = 'invalid' THEN 1 END) AS invalid_records"
_MEASURES = f"count(*) AS total_orders, sum(total_amount::{MONEY})::DOUBLE AS total_spend, sum(total_amount::{MONEY})::DOUBLE / count(*) AS avg_order_value, max(total_amount) AS max_order_value, min(total_amount) AS min_order_value"


def _measures() -> list:
    total = A.money_sum(c("total_amount"))
    return [F.count(F.lit(1)).alias("total_orders"), total.alias("total_spend"), (total / F.count(F.lit(1))).alias("avg_order_value"), F.max("total_amount").alias("max_order_value"), F.min("total_amount").alias("min_order_value")]


def _validity() -> list:
    return [A.count_where(c("data_quality_flag") == "valid").alias("valid_records"), A.count_where(c("data_quality_flag") == "invalid").alias("invalid_records")]


@query("gold_sales_kpis", f"SELECT customer_id, product_id, order_date, {_MEASURES}, sum(quantity::{MONEY})::DOUBLE AS total_quantity_sold, {_TIERS}, {_VALIDITY} FROM {_SALES} GROUP BY 1, 2, 3")
def _(t: Tables) -> DataFrame:
    return _sales(t).groupBy("customer_id", "product_id", "order_date").agg(*_measures(), A.money_sum(c("quantity")).alias("total_quantity_sold"), *_tiers("order_category"), *_validity())


@query("gold_orders_analytics", f"SELECT order_date, order_hour, customer_id, product_id, order_category, {_MEASURES}, count(DISTINCT customer_id) AS unique_customers, {_TIERS}, {_TIER_SUMS} FROM {_SALES} GROUP BY 1, 2, 3, 4, 5")
def _(t: Tables) -> DataFrame:
    # grouped by customer, so the distinct count is one wherever there is a customer: no second shuffle
    unique = F.max(F.when(c("customer_id").isNotNull(), 1).otherwise(0)).cast("long")
    return _sales(t).groupBy("order_date", "order_hour", "customer_id", "product_id", "order_category").agg(*_measures(), unique.alias("unique_customers"), *_tiers("order_category", "total_amount"))


@query("gold_product_analytics", f"SELECT order_date, order_hour, product_id, order_category, {_MEASURES}, {_TIERS}, {_TIER_SUMS} FROM {_SALES} GROUP BY 1, 2, 3, 4")
def _(t: Tables) -> DataFrame:
    return _sales(t).groupBy("order_date", "order_hour", "product_id", "order_category").agg(*_measures(), *_tiers("order_category", "total_amount"))


@query("gold_generic", f"SELECT order_date, count(*) AS total_records, {_VALIDITY} FROM {_SALES} GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return _sales(t).groupBy("order_date").agg(F.count(F.lit(1)).alias("total_records"), *_validity())


@query("gold_patient_kpis", f"""
    WITH v AS (SELECT o_orderpriority AS hospital_ward, l_suppkey AS doctor_id, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS los, l_returnflag AS severity_level FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    s AS (SELECT *, CASE WHEN los > 30 THEN 'long_stay' WHEN los > 7 THEN 'medium_stay' ELSE 'short_stay' END AS stay_category FROM v)
    SELECT hospital_ward, doctor_id, stay_category, severity_level, count(*) AS total_patients, sum(los)::BIGINT AS total_bed_days, sum(los)::DOUBLE / count(los) AS avg_length_of_stay FROM s GROUP BY 1, 2, 3, 4""")
def _(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey")).select(c("o_orderpriority").alias("hospital_ward"), c("l_suppkey").alias("doctor_id"), F.datediff("l_shipdate", "o_orderdate").cast("long").alias("los"), c("l_returnflag").alias("severity_level"))
    rows = rows.withColumn("stay_category", P.tier(c("los"), 30, 7, ("long_stay", "medium_stay", "short_stay")))
    return rows.groupBy("hospital_ward", "doctor_id", "stay_category", "severity_level").agg(F.count(F.lit(1)).alias("total_patients"), F.sum("los").alias("total_bed_days"), (F.sum("los").cast("double") / F.count("los")).alias("avg_length_of_stay"))


def _geo(t: Tables) -> DataFrame:
    return t.customer.join(t.nation, c("c_nationkey") == c("n_nationkey")).join(t.region, c("n_regionkey") == c("r_regionkey"))


@query("gold_customer_kpis", f"SELECT n_name AS state, r_name AS region, c_mktsegment AS district, CASE WHEN c_acctbal > 5000 THEN 'high_volume' WHEN c_acctbal > 0 THEN 'medium_volume' ELSE 'low_volume' END AS purchase_volume, count(*) AS total_customers, sum(c_acctbal::{MONEY})::DOUBLE AS total_units_purchased, sum(c_acctbal::{MONEY})::DOUBLE / count(*) AS avg_units_purchased FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3, 4")
def _(t: Tables) -> DataFrame:
    volume = P.tier(c("c_acctbal"), 5000, 0, ("high_volume", "medium_volume", "low_volume"))
    total = A.money_sum(c("c_acctbal"))
    return _geo(t).groupBy(c("n_name").alias("state"), c("r_name").alias("region"), c("c_mktsegment").alias("district"), volume.alias("purchase_volume")).agg(F.count(F.lit(1)).alias("total_customers"), total.alias("total_units_purchased"), (total / F.count(F.lit(1))).alias("avg_units_purchased"))


@query("gold_group_agg", "SELECT o_orderstatus, max(o_totalprice) AS o_totalprice_max, min(o_totalprice) AS o_totalprice_min, count(o_orderkey) AS o_orderkey_count, count(DISTINCT o_custkey) AS o_custkey_count_distinct FROM orders GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return A.group_agg(t.orders, ["o_orderstatus"], {"o_totalprice": ["max", "min"], "o_orderkey": "count", "o_custkey": "count_distinct", "gone": "sum"})


@query("time_series_agg", f"SELECT date_trunc('month', o_orderdate)::DATE AS period, count(*) AS n, sum(o_totalprice::{MONEY})::DOUBLE AS total FROM orders WHERE o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return A.time_series(t.orders, "month", "o_orderdate", "1994-01-01", "1996-01-01", [F.count(F.lit(1)).alias("n"), A.money_sum(c("o_totalprice")).alias("total")])


@query("orders_by_date", "SELECT o_orderdate::DATE AS order_date, count(*) AS total_daily_orders FROM orders GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.to_date("o_orderdate").alias("order_date")).agg(F.count(F.lit(1)).alias("total_daily_orders"))


@query("customers_per_nation", "SELECT n_name, count(*) AS customer_count, 'today' AS updated_at FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.customer.join(t.nation, c("c_nationkey") == c("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("customer_count"), F.first(F.lit("today")).alias("updated_at"))


@query("daily_mean", "SELECT user_id, ts::DATE AS day, round(avg(value), 4) AS avg_value FROM events GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", F.date_trunc("DD", "ts").cast("date").alias("day")).agg(F.round(F.mean("value"), 4).alias("avg_value"))


_SEGMENT = "CASE WHEN sum(o_totalprice::{0}) >= 10000 THEN 'Premium' WHEN sum(o_totalprice::{0}) >= 5000 THEN 'Gold' WHEN sum(o_totalprice::{0}) >= 1000 THEN 'Silver' ELSE 'Bronze' END".format(MONEY)
_ANALYTICS = f"count(o_orderkey) AS total_orders, sum(o_totalprice::{MONEY})::DOUBLE AS total_spend, sum(o_totalprice::{MONEY})::DOUBLE / nullif(count(o_orderkey), 0) AS avg_order_value, max(o_orderdate)::DATE AS last_order_date, min(o_orderdate)::DATE AS first_order_date, date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) AS customer_lifetime_days, {_SEGMENT} AS customer_segment"


def _analytics() -> list:
    total = A.money_sum(c("o_totalprice"))
    return [F.count("o_orderkey").alias("total_orders"), total.alias("total_spend"), F.try_divide(total, F.count("o_orderkey")).alias("avg_order_value"), F.max("o_orderdate").cast("date").alias("last_order_date"), F.min("o_orderdate").cast("date").alias("first_order_date"), F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).cast("long").alias("customer_lifetime_days"), S.customer_segment(total).alias("customer_segment")]


@query("customer_analytics", f"SELECT c_custkey, c_name, n_name, {_ANALYTICS} FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON c_custkey = o_custkey WHERE o_orderdate BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1996-12-31' GROUP BY 1, 2, 3")
def _(t: Tables) -> DataFrame:
    orders = t.orders.filter(c("o_orderdate").between(F.lit("1994-01-01").cast("timestamp_ntz"), F.lit("1996-12-31").cast("timestamp_ntz")))
    # by the key alone first: names follow from it
    per = orders.groupBy("o_custkey").agg(*_analytics())
    return per.join(t.customer, c("o_custkey") == c("c_custkey")).join(t.nation, c("c_nationkey") == c("n_nationkey")).select("c_custkey", "c_name", "n_name", "total_orders", "total_spend", "avg_order_value", "last_order_date", "first_order_date", "customer_lifetime_days", "customer_segment")


@query("customer_analytics_left", f"SELECT c_custkey, {_ANALYTICS} FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, c("c_custkey") == c("o_custkey"), "left").groupBy("c_custkey").agg(*_analytics())


@query("sales_analytics", f"SELECT o_orderstatus, date_trunc('month', o_orderdate)::DATE AS month, count(DISTINCT o_orderkey) AS total_orders, count(DISTINCT o_custkey) AS unique_customers, sum(o_totalprice::{MONEY})::DOUBLE AS total_revenue, sum(o_totalprice::{MONEY})::DOUBLE / count(DISTINCT o_custkey) AS revenue_per_customer, count(o_orderkey)::DOUBLE / count(DISTINCT o_custkey) AS orders_per_customer FROM orders GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    month = F.date_trunc("month", "o_orderdate").cast("date").alias("month")
    per = t.orders.groupBy("o_orderstatus", month, "o_custkey").agg(F.countDistinct("o_orderkey").alias("d"), F.count("o_orderkey").alias("n"), F.sum(c("o_totalprice").cast("decimal(18,2)")).alias("total"))
    total, people = F.sum("total").cast("double"), F.count("o_custkey")
    return per.groupBy("o_orderstatus", "month").agg(F.sum("d").alias("total_orders"), people.alias("unique_customers"), total.alias("total_revenue"), (total / people).alias("revenue_per_customer"), (F.sum("n") / people).alias("orders_per_customer"))


@query("executive_summary", f"SELECT 'Executive Summary' AS report_type, '1998-01-01' AS report_date, count(DISTINCT o_custkey) AS total_customers, count(DISTINCT o_orderkey) AS total_orders, sum(o_totalprice::{MONEY})::DOUBLE AS total_revenue, count(DISTINCT CASE WHEN o_orderdate >= TIMESTAMP '1997-12-02' THEN o_custkey END) AS active_customers_30d, count(DISTINCT CASE WHEN o_orderdate >= TIMESTAMP '1997-10-03' THEN o_custkey END) AS active_customers_90d FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01'")
def _(t: Tables) -> DataFrame:
    # by customer first: what is distinct in all is then counted without another shuffle of rows
    day = F.lit("1998-01-01").cast("date")
    per = t.orders.filter(c("o_orderdate") <= day.cast("timestamp_ntz")).groupBy("o_custkey").agg(F.countDistinct("o_orderkey").alias("n"), F.sum(c("o_totalprice").cast("decimal(18,2)")).alias("total"), F.max("o_orderdate").alias("last"))
    active = lambda n: A.count_where(c("o_custkey").isNotNull() & (c("last") >= F.date_sub(day, n).cast("timestamp_ntz")))
    return per.agg(F.count("o_custkey").alias("total_customers"), F.sum("n").alias("total_orders"), F.sum("total").cast("double").alias("total_revenue"), active(30).alias("active_customers_30d"), active(90).alias("active_customers_90d")).withColumns({"report_type": F.lit("Executive Summary"), "report_date": F.lit("1998-01-01")})


@query("having_min_spend", f"SELECT o_custkey, sum(o_totalprice::{MONEY})::DOUBLE AS total_spend FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 1 HAVING total_spend > 100000")
def _(t: Tables) -> DataFrame:
    return t.orders.filter(c("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz")).groupBy("o_custkey").agg(A.money_sum(c("o_totalprice")).alias("total_spend")).filter("total_spend > 100000")


@query("no_duplicate_ids", "SELECT max(n) <= 1 AS at_most_one FROM (SELECT count(*) AS n FROM events GROUP BY event_id)")
def _(t: Tables) -> DataFrame:
    return A.at_most_one(t.events, ["event_id"])


@query("at_most_one_id", "SELECT max(n) <= 1 AS at_most_one FROM (SELECT count(*) AS n FROM events GROUP BY user_id)")
def _(t: Tables) -> DataFrame:
    return A.at_most_one(t.events, ["user_id"])


@query("dedup_group_max", "SELECT user_id, event_type, max(ts) AS last_ts, max(value) AS max_value FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return t.events.filter("user_id IS NOT NULL").groupBy("user_id", "event_type").agg(F.max("ts").alias("last_ts"), F.max("value").alias("max_value"))


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("pivot_quantity", "SELECT user_id, " + ", ".join(f"sum(value::{MONEY}) FILTER (event_type = '{x}')::DOUBLE AS {x}" for x in _TYPES) + " FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    rows = A.pivot_sum(t.events.withColumn("v", c("value").cast("decimal(18,2)")), ["user_id"], "event_type", _TYPES, "v")
    return rows.select("user_id", *[c(x).cast("double").alias(x) for x in _TYPES])


# -- joins -----------------------------------------------------------------


@query("join_inner_emails", "SELECT o_orderkey, c_custkey, lower(replace(c_name, '#', '')) || '@example.com' AS email FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'")
def _(t: Tables) -> DataFrame:
    email = F.concat(F.lower(F.replace(c("c_name"), F.lit("#"), F.lit(""))), F.lit("@example.com"))
    return t.orders.filter("o_orderstatus = 'F'").join(t.customer, c("o_custkey") == c("c_custkey")).select("o_orderkey", "c_custkey", email.alias("email"))


@query("join_status", "SELECT l.*, c_name FROM lineitem l JOIN (SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey) e ON l_orderkey = o_orderkey WHERE l_linestatus = 'O'")
def _(t: Tables) -> DataFrame:
    e = t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).select("o_orderkey", "c_name")
    return t.lineitem.filter("l_linestatus = 'O'").alias("l").join(e, c("l_orderkey") == c("o_orderkey")).select("l.*", "c_name")


# customers without and with orders, and orders whose shifted customer is unknown
for _how, _sql in (("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN")):
    query(f"join_{_how}", f"SELECT c_custkey, o_orderkey FROM customer {_sql} (SELECT o_orderkey, o_custkey + 100 AS k FROM orders) o ON c_custkey = k")(
        lambda t, how=_how: t.customer.join(t.orders.select("o_orderkey", (c("o_custkey") + 100).alias("k")), c("c_custkey") == c("k"), how).select("c_custkey", "o_orderkey")
    )


@query("join_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.filter("o_orderstatus = 'P'"), c("c_custkey") == c("o_custkey"), "left_semi").select("c_custkey")


@query("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, c("c_custkey") == c("o_custkey"), "left_anti").select("c_custkey")


@query("join_cross", "SELECT r_name, s FROM region CROSS JOIN (VALUES ('F'), ('O'), ('P')) v(s)")
def _(t: Tables) -> DataFrame:
    # a cross join against fixed values is one row to many: no join at all
    return t.region.select("r_name", F.explode(F.array(F.lit("F"), F.lit("O"), F.lit("P"))).alias("s"))


@query("referential_integrity", "SELECT count(*) AS orphan_count FROM (SELECT l_orderkey + CASE WHEN l_linenumber = 3 THEN 100000000 ELSE 0 END AS k FROM lineitem) l LEFT JOIN orders ON k = o_orderkey WHERE o_orderkey IS NULL")
def _(t: Tables) -> DataFrame:
    child = t.lineitem.select((c("l_orderkey") + F.when(c("l_linenumber") == 3, 100000000).otherwise(0)).alias("k"))
    return Q.referential_integrity(child, t.orders, "k", "o_orderkey")


# -- arrays, structs, JSON -------------------------------------------------


def _items(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("items"))


@query("explode_items", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem")
def _(t: Tables) -> DataFrame:
    return _items(t).select("l_orderkey", F.explode("items").alias("item")).select("l_orderkey", "item.*")


@query("join_nested_item", "SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey")
def _(t: Tables) -> DataFrame:
    return _items(t).select("l_orderkey", F.explode("items").alias("item")).join(t.part, c("item.l_partkey") == c("p_partkey")).select("l_orderkey", "item.l_linenumber", "p_name")


@query("array_size_filter", "SELECT l_orderkey, count(*) AS n_items FROM lineitem GROUP BY 1 HAVING count(*) > 5")
def _(t: Tables) -> DataFrame:
    return _items(t).select("l_orderkey", F.size("items").cast("long").alias("n_items")).filter("n_items > 5")


@query("collect_set_history", "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS history FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("history"))


@query("flatten_distinct", "SELECT l_suppkey, array_to_string(list_sort(list(DISTINCT l_partkey)), ',') AS parts FROM lineitem GROUP BY 1")
def _(t: Tables) -> DataFrame:
    pairs = t.lineitem.select("l_suppkey", "l_partkey").distinct()
    return pairs.groupBy("l_suppkey").agg(F.array_join(F.sort_array(F.collect_list("l_partkey")), ",").alias("parts"))


@query("map_lookup", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t: Tables) -> DataFrame:
    m = t.region.agg(F.map_from_arrays(F.collect_list("r_regionkey"), F.collect_list("r_name")).alias("m"))
    return t.nation.join(F.broadcast(m)).select("n_name", c("m")[c("n_regionkey")].alias("r_name"))  # m is one row


@query("json_path", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("json_from_struct", "SELECT (props->>'$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.events.select(F.from_json("props", "k BIGINT").alias("j")).select("j.*").groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("json_schema_infer", "SELECT 'STRUCT<k: BIGINT>' AS json_schema")
def _(t: Tables) -> DataFrame:
    return t.spark.range(1).select(F.schema_of_json(F.lit('{"k": 3}')).alias("json_schema"))


def _nested(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.struct(c("c_name").alias("name"), F.struct(c("c_nationkey").alias("nation"), c("c_acctbal").alias("balance")).alias("home")).alias("who"))


@query("flatten_struct_one", "SELECT c_custkey, c_name AS who_name, c_nationkey AS nation FROM customer")
def _(t: Tables) -> DataFrame:
    return P.flatten_struct(_nested(t), "who").select("c_custkey", "who_name", c("who_home.nation").alias("nation"))


@query("flatten_struct_deep", "SELECT c_custkey, c_name AS who_name, c_nationkey AS who_home_nation, c_acctbal AS who_home_balance FROM customer")
def _(t: Tables) -> DataFrame:
    return P.flatten_structs(_nested(t))


# -- functions -------------------------------------------------------------


@query("users_cleaning", """
    SELECT user_id, strftime(max(ts), '%H:%M:%S') AS last_time, max(ts)::DATE AS last_date, regexp_extract('u' || user_id || '@mail.example.com', '@(.*)', 0) AS email_domain
    FROM (SELECT DISTINCT user_id, ts FROM events WHERE user_id IS NOT NULL) GROUP BY user_id""")
def _(t: Tables) -> DataFrame:
    rows = t.events.filter("user_id IS NOT NULL").select("user_id", "ts").distinct().groupBy("user_id").agg(F.max("ts").alias("m"))
    email = F.concat(F.lit("u"), c("user_id").cast("string"), F.lit("@mail.example.com"))
    return rows.select("user_id", F.date_format("m", "HH:mm:ss").alias("last_time"), F.to_date("m").alias("last_date"), F.regexp_extract(email, "@(.*)", 0).alias("email_domain"))


@query("epoch_to_date", "SELECT event_id, ts::DATE AS day FROM events")
def _(t: Tables) -> DataFrame:
    micros = F.unix_micros(c("ts").cast("timestamp"))
    return t.events.select("event_id", F.timestamp_micros(micros).cast("date").alias("day"))


@query("date_parts", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, hour(o_orderdate) AS h, dayofweek(o_orderdate) + 1 AS dow, date_trunc('month', o_orderdate)::DATE AS first_of_month, strftime(o_orderdate, '%H:%M:%S') AS clock FROM orders")
def _(t: Tables) -> DataFrame:
    d = c("o_orderdate")
    return t.orders.select("o_orderkey", F.year(d).cast("long").alias("y"), F.month(d).cast("long").alias("m"), F.hour(d).cast("long").alias("h"), F.dayofweek(d).cast("long").alias("dow"), F.date_trunc("month", d).cast("date").alias("first_of_month"), F.date_format(d, "HH:mm:ss").alias("clock"))


@query("date_sub_window", "SELECT o_orderkey FROM orders WHERE o_orderdate::DATE >= DATE '1998-08-02' - 90")
def _(t: Tables) -> DataFrame:
    return t.orders.filter(F.to_date("o_orderdate") >= F.date_sub(F.lit("1998-08-02").cast("date"), 90)).select("o_orderkey")


_DAYS = "date_diff('day', o_orderdate::DATE, l_shipdate::DATE)"
_LO = "FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def _spans(t: Tables) -> DataFrame:
    return t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey"))


@query("business_days", f"SELECT l_orderkey, l_linenumber, trunc({_DAYS} - ({_DAYS} / 7) * 2 - CASE WHEN dayofweek(o_orderdate) = 0 THEN 1 ELSE 0 END - CASE WHEN dayofweek(l_shipdate) = 6 THEN 1 ELSE 0 END)::INTEGER AS business_days {_LO}")
def _(t: Tables) -> DataFrame:
    return _spans(t).select("l_orderkey", "l_linenumber", S.business_days_between(c("o_orderdate"), c("l_shipdate")).alias("business_days"))


@query("business_days_exact", f"SELECT l_orderkey, l_linenumber, (SELECT count(*) FROM range(0, greatest({_DAYS}, 0)) r(i) WHERE dayofweek(o_orderdate::DATE + i::INTEGER) BETWEEN 1 AND 5)::INTEGER AS business_days {_LO} WHERE {_DAYS} >= 0")
def _(t: Tables) -> DataFrame:
    return _spans(t).filter(F.datediff("l_shipdate", "o_orderdate") >= 0).select("l_orderkey", "l_linenumber", S.business_days_exact(c("o_orderdate"), c("l_shipdate")).alias("business_days"))


@query("is_weekend", "SELECT o_orderkey, dayofweek(o_orderdate) IN (0, 6) AS weekend FROM orders")
def _(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", S.is_weekend(c("o_orderdate")).alias("weekend"))


@query("age_in_days", "SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '2000-01-01') AS age FROM orders")
def _(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", S.age_in_days(c("o_orderdate"), F.lit("2000-01-01").cast("date")).cast("long").alias("age"))


@query("string_functions", "SELECT p_partkey, upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS cap, regexp_replace(p_brand, '[^0-9]', '', 'g') AS digits, length(p_name) AS len, replace(p_type, ' ', '_') AS snake, left(p_name, 3) || repeat('*', 3) AS masked FROM part")
def _(t: Tables) -> DataFrame:
    cap = F.concat(F.upper(F.left(c("p_type"), F.lit(1))), F.lower(F.substring("p_type", 2, 1000)))
    return t.part.select("p_partkey", cap.alias("cap"), F.regexp_replace("p_brand", "[^0-9]", "").alias("digits"), F.length("p_name").cast("long").alias("len"), F.replace(c("p_type"), F.lit(" "), F.lit("_")).alias("snake"), F.concat(F.left(c("p_name"), F.lit(3)), F.lit("***")).alias("masked"))


@query("math_functions", "SELECT o_orderkey, round(o_totalprice / 7, 2) AS r, ceil(o_totalprice / 7)::BIGINT AS up, CASE WHEN o_custkey % 4 <> 0 THEN round(o_totalprice / (o_custkey % 4), 4) END AS safe, coalesce(nullif(o_orderstatus, 'F'), 'none') AS s FROM orders")
def _(t: Tables) -> DataFrame:
    p = c("o_totalprice")
    return t.orders.select("o_orderkey", F.round(p / 7, 2).alias("r"), F.ceil(p / 7).alias("up"), F.round(F.try_divide(p, c("o_custkey") % 4), 4).alias("safe"), F.coalesce(F.nullif(c("o_orderstatus"), F.lit("F")), F.lit("none")).alias("s"))


_EMAIL_SQL = "(SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'a' || c_custkey || '@bXco' ELSE 'u.' || c_custkey || '@mail.example.org' END AS email FROM customer) e"
_EMAIL_RE = "'^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}$'"


def _emails(t: Tables) -> DataFrame:
    k = c("c_custkey").cast("string")
    return t.customer.select("c_custkey", F.when(c("c_custkey") % 4 == 0, None).when(c("c_custkey") % 4 == 1, F.concat(F.lit("a"), k, F.lit("@bXco"))).otherwise(F.concat(F.lit("u."), k, F.lit("@mail.example.org"))).alias("email"))


@query("udf_clean_string", "SELECT c_custkey, lower(regexp_replace(trim('  ' || c_name || '!@ '), '[^a-zA-Z0-9\\s]', '', 'g')) AS cleaned FROM customer")
def _(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", S.clean_string(F.concat(F.lit("  "), c("c_name"), F.lit("!@ ")), lower=True).alias("cleaned"))


@query("udf_validate_email", f"SELECT c_custkey, coalesce(regexp_matches(email, {_EMAIL_RE}), false) AS is_valid FROM {_EMAIL_SQL}")
def _(t: Tables) -> DataFrame:
    return _emails(t).select("c_custkey", S.validate_email(c("email")).alias("is_valid"))


@query("udf_extract_domain", f"SELECT c_custkey, CASE WHEN regexp_matches(email, {_EMAIL_RE}) THEN regexp_extract(email, '@([^@]+)$', 1) END AS domain FROM {_EMAIL_SQL}")
def _(t: Tables) -> DataFrame:
    return _emails(t).select("c_custkey", S.extract_domain(c("email")).alias("domain"))


@query("udf_percentage", "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN round(c_acctbal * 100.0::DOUBLE / (c_custkey % 3), 2) END AS pct FROM customer")
def _(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", S.percentage(c("c_acctbal"), c("c_custkey") % 3).alias("pct"))


@query("udf_safe_division", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE round(c_acctbal / (c_custkey % 3), 4) END::DOUBLE AS q FROM customer")
def _(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.round(S.safe_division(c("c_acctbal"), c("c_custkey") % 3, 0.0), 4).alias("q"))


@query("udf_in_range", "SELECT c_custkey, coalesce(c_acctbal BETWEEN 0 AND 1000, false) AS inside, c_custkey > 5 AND c_custkey < 10 AS strictly FROM customer")
def _(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", S.in_range(c("c_acctbal"), 0, 1000).alias("inside"), S.in_range(c("c_custkey"), 5, 10, inclusive=False).alias("strictly"))


@query("udf_quality_score", "SELECT 0.91::DOUBLE AS score")
def _(t: Tables) -> DataFrame:
    return t.spark.range(1).select(S.quality_score(F.lit(0.95), F.lit(0.90), F.lit(0.85), F.lit(0.92)).alias("score"))


@query("udf_null_pct", f"SELECT round(avg(CASE WHEN c_acctbal IS NULL THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS null_pct FROM {_HOLES}")
def _(t: Tables) -> DataFrame:
    return _holes(t).agg(F.round(F.avg(S.null_percentage(c("c_acctbal"))), 4).alias("null_pct"))


@query("udf_customer_segment", "SELECT c_custkey, CASE WHEN c_acctbal >= 10000 THEN 'Premium' WHEN c_acctbal >= 5000 THEN 'Gold' WHEN c_acctbal >= 1000 THEN 'Silver' ELSE 'Bronze' END AS segment FROM customer")
def _(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", S.customer_segment(c("c_acctbal")).alias("segment"))


@query("udf_order_status", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'Cancelled' WHEN o_orderkey % 3 = 0 THEN 'Delivered' WHEN o_orderkey % 2 = 0 THEN 'Shipped' ELSE 'Ordered' END AS status FROM orders")
def _(t: Tables) -> DataFrame:
    at = lambda n: F.when(c("o_orderkey") % n == 0, c("o_orderdate"))
    return t.orders.select("o_orderkey", S.order_status(c("o_orderdate"), at(2), at(3), at(5)).alias("status"))


@query("udf_mask", "SELECT c_custkey, left(c_name, 2) || repeat('*', length(c_name) - 2) AS masked FROM customer")
def _(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", S.mask(c("c_name")).alias("masked"))


@query("udf_sale_announcement", "SELECT p_partkey, 'The ' || p_name || ' is on sale for $' || round(p_retailprice * 0.8)::INTEGER AS message FROM part")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.concat(F.lit("The "), c("p_name"), F.lit(" is on sale for $"), S.sale_price(c("p_retailprice"))).alias("message"))


@query("udf_item_preference", "SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN 'first choice' WHEN p_retailprice > 1500 THEN 'wait until ' || p_name || ' costs ' || round(p_retailprice * 0.8)::INTEGER ELSE 'no need of ' || p_name END AS preference FROM part")
def _(t: Tables) -> DataFrame:
    rules = [(c("p_brand") == "Brand#11", F.lit("first choice")), (c("p_retailprice") > 1500, F.concat(F.lit("wait until "), c("p_name"), F.lit(" costs "), S.sale_price(c("p_retailprice"))))]
    return t.part.select("p_partkey", S.first_message(rules, F.concat(F.lit("no need of "), c("p_name"))).alias("preference"))


@query("udf_sql_functions", "SELECT c_custkey, CASE WHEN c_acctbal >= 10000 THEN 'Premium' WHEN c_acctbal >= 5000 THEN 'Gold' WHEN c_acctbal >= 1000 THEN 'Silver' ELSE 'Bronze' END AS segment, coalesce(c_acctbal BETWEEN 0 AND 500, false) AS small FROM customer")
def _(t: Tables) -> DataFrame:
    S.register(t.spark)
    return t.customer.select("c_custkey", F.expr("customer_segment(c_acctbal)").alias("segment"), F.expr("is_in_range(c_acctbal, 0D, 500D)").alias("small"))


# -- quality ---------------------------------------------------------------


def _share_sql(n: str, total: str) -> str:
    return f"round({n} * 100.0::DOUBLE / nullif({total}, 0), 2)"


@query("dq_null", f"SELECT 'c_acctbal' AS column_name, count(*) AS total_rows, count(c_acctbal) AS non_null_count, count(*) - count(c_acctbal) AS null_count, {_share_sql('count(c_acctbal)', 'count(*)')} AS completeness_percentage FROM {_HOLES}")
def _(t: Tables) -> DataFrame:
    return Q.null_check("c_acctbal").run(_holes(t))


_EMPTY = "count(CASE WHEN trim(s) = '' THEN 1 END)"


@query("dq_empty", f"SELECT 's' AS column_name, count(s) AS total_rows, {_EMPTY} AS empty_string_count, {_share_sql(_EMPTY, 'count(s)')} AS empty_string_percentage FROM (SELECT CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE c_name END AS s FROM customer)")
def _(t: Tables) -> DataFrame:
    return Q.empty_string_check("s").run(t.customer.select(F.when(c("c_custkey") % 5 == 0, None).when(c("c_custkey") % 5 == 1, "  ").otherwise(c("c_name")).alias("s")))


def _good_sql(column: str, good: str, names: tuple[str, str, str], table: str) -> str:
    yes, no = f"count(CASE WHEN {good} THEN 1 END)", f"count(CASE WHEN NOT ({good}) THEN 1 END)"
    return f"SELECT '{column}' AS column_name, count({column}) AS total_rows, {yes} AS {names[0]}, {no} AS {names[1]}, {_share_sql(yes, f'count({column})')} AS {names[2]} FROM {table}"


@query("dq_range", _good_sql("c_acctbal", "c_acctbal BETWEEN 0 AND 5000", ("in_range_count", "out_of_range_count", "accuracy_percentage"), _HOLES))
def _(t: Tables) -> DataFrame:
    return Q.range_check("c_acctbal", 0, 5000).run(_holes(t))


@query("dq_format", _good_sql("email", f"regexp_matches(email, {_EMAIL_RE})", ("valid_format_count", "invalid_format_count", "format_accuracy_percentage"), _EMAIL_SQL))
def _(t: Tables) -> DataFrame:
    return Q.format_check("email", P.EMAIL).run(_emails(t))


@query("dq_domain", _good_sql("o_orderstatus", "o_orderstatus IN ('F', 'O')", ("valid_count", "invalid_count", "validity_percentage"), "orders"))
def _(t: Tables) -> DataFrame:
    return Q.domain_check("o_orderstatus", ["F", "O"]).run(t.orders)


@query("dq_length", _good_sql("p_name", "length(p_name) BETWEEN 5 AND 12", ("valid_length_count", "invalid_length_count", "length_validity_percentage"), "part"))
def _(t: Tables) -> DataFrame:
    return Q.length_check("p_name", 5, 12).run(t.part)


@query("dq_case", "SELECT 'k' AS column_name, count(k) AS total_rows, count(DISTINCT k) AS unique_values, count(DISTINCT upper(k)) AS unique_upper_values, CASE WHEN count(DISTINCT k) = count(DISTINCT upper(k)) THEN 'consistent' ELSE 'inconsistent' END AS case_consistency FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS k FROM customer)")
def _(t: Tables) -> DataFrame:
    return Q.case_check("k").run(t.customer.select(F.when(c("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(c("c_mktsegment")).alias("k")))


@query("dq_type", "SELECT 'p_size' AS column_name, count(p_size) AS total_rows, count(CASE WHEN regexp_matches(p_size::VARCHAR, '^[0-9]+$') THEN 1 END) AS numeric_count, count(CASE WHEN NOT regexp_matches(p_size::VARCHAR, '^[0-9]+$') THEN 1 END) AS non_numeric_count, 'consistent' AS type_consistency FROM part")
def _(t: Tables) -> DataFrame:
    return Q.type_check("p_size").run(t.part)


@query("dq_pk", "SELECT 'o_orderkey' AS column_name, count(*) AS total_rows, count(DISTINCT o_orderkey) AS unique_values, count(*) - count(DISTINCT o_orderkey) AS duplicate_count, CASE WHEN count(*) = count(DISTINCT o_orderkey) THEN 'unique' ELSE 'duplicates' END AS uniqueness_status FROM orders")
def _(t: Tables) -> DataFrame:
    return Q.uniqueness_check(["o_orderkey"]).run(t.orders)


@query("dq_composite", "SELECT 'l_orderkey,l_linenumber' AS composite_key, count(*) AS total_rows, count(DISTINCT (l_orderkey, l_linenumber)) AS unique_combinations, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicate_count, CASE WHEN count(*) = count(DISTINCT (l_orderkey, l_linenumber)) THEN 'unique' ELSE 'duplicates' END AS uniqueness_status FROM lineitem")
def _(t: Tables) -> DataFrame:
    return Q.uniqueness_check(["l_orderkey", "l_linenumber"]).run(t.lineitem)


@query("dq_freshness", f"SELECT 'ts' AS timestamp_column, count(ts) AS total_rows, count(CASE WHEN ts >= TIMESTAMP '2024-01-15' THEN 1 END) AS fresh_count, count(CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 1 END) AS stale_count, {_share_sql('count(CASE WHEN ts >= TIMESTAMP ~2024-01-15~ THEN 1 END)'.replace('~', chr(39)), 'count(ts)')} AS freshness_percentage FROM events")
def _(t: Tables) -> DataFrame:
    return Q.freshness_check("ts", "2024-01-15").run(t.events)


@query("dq_update_freq", "SELECT 'ts' AS timestamp_column, count(ts) AS total_rows, max(ts) AS latest_update, min(ts) AS earliest_update, date_diff('day', min(ts)::DATE, max(ts)::DATE) AS days_span, round(count(ts)::DOUBLE / nullif(date_diff('day', min(ts)::DATE, max(ts)::DATE), 0), 4) AS avg_updates_per_day FROM events")
def _(t: Tables) -> DataFrame:
    return Q.update_frequency_check("ts").run(t.events)


@query("dq_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS occurrence_count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(t: Tables) -> DataFrame:
    return A.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("dq_row_valid", "SELECT p_partkey, p_brand, CASE WHEN regexp_matches(p_brand, '^Brand#[1-3]') THEN 'valid' ELSE 'invalid' END AS validation_result FROM part WHERE p_brand IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return Q.row_validity(t.part.select("p_partkey", "p_brand"), "p_brand", "^Brand#[1-3]")


@query("dq_business_rule", "SELECT 'ships after ordering' AS rule_description, count(CASE WHEN NOT coalesce(l_shipdate >= o_orderdate, false) THEN 1 END) AS violation_count FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(t: Tables) -> DataFrame:
    return Q.business_rule(_spans(t), "l_shipdate >= o_orderdate", "ships after ordering")


def _complete(column: str) -> str:
    return f"SELECT 'completeness' AS quality_dimension, '{column}' AS column_name, count(*) AS total_rows, count({column}) AS non_null_count, count(*) - count({column}) AS null_count, {_share_sql(f'count({column})', 'count(*)')} AS quality_score FROM {_HOLES}"


@query("dq_comprehensive", f"SELECT 'completeness' AS quality_dimension, 'total' AS column_name, count(*) AS total_rows, count(*) AS non_null_count, 0 AS null_count, 100.0::DOUBLE AS quality_score FROM {_HOLES} UNION ALL " + " UNION ALL ".join(_complete(x) for x in ("c_custkey", "c_acctbal", "c_mktsegment")) + f" UNION ALL SELECT 'uniqueness', 'c_custkey', count(*), count(DISTINCT c_custkey), count(*) - count(DISTINCT c_custkey), {_share_sql('count(DISTINCT c_custkey)', 'count(*)')} FROM {_HOLES}")
def _(t: Tables) -> DataFrame:
    return Q.comprehensive(_holes(t), "c_custkey", "c_acctbal", "c_mktsegment")


def _profile_sql(column: str, text: bool) -> str:
    empty = f"count(CASE WHEN trim({column}) = '' THEN 1 END)" if text else "0::BIGINT"
    return f"SELECT '{column}' AS column_name, count(*) AS total_rows, count(*) - count({column}) AS null_count, {_share_sql(f'(count(*) - count({column}))', 'count(*)')} AS null_percentage, count(DISTINCT {column}) AS distinct_count, {empty} AS empty_string_count FROM {_HOLES}"


@query("dq_profile", " UNION ALL ".join(_profile_sql(x, x == "c_mktsegment") for x in ("c_custkey", "c_acctbal", "c_mktsegment")))
def _(t: Tables) -> DataFrame:
    return Q.profile(_holes(t))


@query("dq_score", f"SELECT 100 - 10 * (count(*) - count(c_acctbal) > 0.1 * count(*))::INTEGER::BIGINT - 10 * (count(*) - count(c_mktsegment) > 0.1 * count(*))::INTEGER::BIGINT AS quality_score FROM {_HOLES}")
def _(t: Tables) -> DataFrame:
    return Q.quality_score(_holes(t))


@query("dq_grade", f"SELECT column_name, CASE WHEN null_percentage < 5 THEN 'excellent' WHEN null_percentage < 15 THEN 'good' ELSE 'poor' END AS grade FROM ({' UNION ALL '.join(_profile_sql(x, False) for x in ('c_custkey', 'c_acctbal', 'c_mktsegment'))})")
def _(t: Tables) -> DataFrame:
    return Q.profile(_holes(t)).select("column_name", Q.grade(c("null_percentage")).alias("grade"))


# -- charts and costs ------------------------------------------------------


@query("chart_histogram", "SELECT (floor(o_totalprice / 10000) * 10000)::DOUBLE AS bin_start, count(*) AS n FROM orders GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return R.histogram(t.orders, "o_totalprice", 10000)


@query("chart_pie", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return R.pie(t.orders, "o_orderpriority")


@query("chart_bar", f"SELECT p_brand, sum(p_retailprice::{MONEY})::DOUBLE AS total FROM part GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return R.bar(t.part, "p_brand", "p_retailprice")


@query("chart_line", f"SELECT o_orderdate::DATE AS day, sum(o_totalprice::{MONEY})::DOUBLE AS total FROM orders GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return R.line(t.orders, "o_orderdate", "o_totalprice")


@query("chart_box", "SELECT o_orderstatus, min(o_totalprice) AS low, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.5), 4) AS q2, round(quantile_cont(o_totalprice, 0.75), 4) AS q3, max(o_totalprice) AS high FROM orders GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return R.box(t.orders, "o_orderstatus", "o_totalprice")


def _bills(t: Tables) -> DataFrame:
    credit = F.array(F.struct(F.lit("DISCOUNT").alias("type"), (-c("o_orderkey") % 7).cast("decimal(18,2)").alias("amount")), F.struct(F.lit("PROMOTION").alias("type"), (-c("o_orderkey") % 3).cast("decimal(18,2)").alias("amount")))
    return t.orders.select(c("o_orderpriority").alias("service"), c("o_orderdate").alias("used_at"), c("o_totalprice").alias("cost"), credit.alias("credits"))


_BILLS = "(SELECT o_orderpriority AS service, o_orderdate AS used_at, o_totalprice AS cost, [{'type': 'DISCOUNT', 'amount': (-o_orderkey % 7)::DECIMAL(18,2)}, {'type': 'PROMOTION', 'amount': (-o_orderkey % 3)::DECIMAL(18,2)}] AS credits FROM orders) b"
_CREDITS = "list_sum(list_transform({0}, lambda x: x.amount))"


@query("billing_monthly", f"SELECT service, year(used_at) AS year, month(used_at) AS month, sum(cost::{MONEY})::DOUBLE AS total_cost, count(DISTINCT used_at::DATE) AS active_days, sum(cost::{MONEY})::DOUBLE / count(DISTINCT used_at::DATE) AS avg_daily_cost FROM {_BILLS} GROUP BY 1, 2, 3")
def _(t: Tables) -> DataFrame:
    return R.monthly_cost(_bills(t), "service", "used_at", "cost")


@query("billing_daily_savings", f"SELECT used_at::DATE AS day, sum(cost::{MONEY})::DOUBLE AS gross_cost, sum(({_CREDITS.format('list_filter(credits, lambda x: x.type = ~DISCOUNT~)')})::{MONEY})::DOUBLE AS discount, sum(({_CREDITS.format('credits')})::{MONEY})::DOUBLE AS all_credits, sum(cost::{MONEY} + ({_CREDITS.format('credits')})::{MONEY})::DOUBLE AS net_cost FROM {_BILLS} GROUP BY 1".replace("~", "'"))
def _(t: Tables) -> DataFrame:
    return R.daily_cost(_bills(t), None, "used_at", "cost", "credits")


@query("billing_threshold", f"SELECT service, total_cost, CASE WHEN total_cost >= 20000000 THEN 'alert' WHEN total_cost >= 16000000 THEN 'warning' ELSE 'ok' END AS alert FROM (SELECT service, sum(cost::{MONEY})::DOUBLE AS total_cost FROM {_BILLS} GROUP BY 1)")
def _(t: Tables) -> DataFrame:
    return R.threshold_alert(_bills(t).groupBy("service").agg(A.money_sum(c("cost")).alias("total_cost")), "total_cost", 20000000)


@query("billing_top10", f"SELECT service, year(used_at) AS year, month(used_at) AS month, sum(cost::{MONEY})::DOUBLE AS total_cost FROM {_BILLS} GROUP BY 1, 2, 3 ORDER BY total_cost DESC, service, year, month LIMIT 10")
def _(t: Tables) -> DataFrame:
    return R.monthly_cost(_bills(t), "service", "used_at", "cost").select("service", "year", "month", "total_cost").orderBy(F.desc("total_cost"), "service", "year", "month").limit(10)


# -- extensions ------------------------------------------------------------


@query("ext_tumbling", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return t.events.groupBy(F.window(c("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(c("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("ext_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def _(t: Tables) -> DataFrame:
    return t.orders.rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("ext_rank_lag", "SELECT o_orderkey, rank() OVER w AS r, lag(o_orderkey) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def _(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_orderkey", F.rank().over(w).cast("long").alias("r"), F.lag("o_orderkey").over(w).alias("before"))
