"""Queries that run readers, sinks, SQL scripts, layer chains, pipelines and upkeep from files to tables."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.functions import scalars as S
from terrace.operators import aggregates as A
from terrace.operators import governance as H
from terrace.operators import quality as Q
from terrace.operators import reports as R
from terrace.operators import transforms as P
from terrace.operators.tablestore import TableStore, merged
from terrace.plans import chains, library, medallion, sqlrunner
from terrace.plans.catalogue import Tables, query
from terrace.plans.queries_engine import workspace
from terrace.plans.sqltables import SqlTables, declare
from terrace.sources import files, sinks
from terrace.streaming import jobs
from terrace.streaming import pipeline as G

c = F.col
MONEY = "DECIMAL(18,2)"


def _land(t: Tables, df: DataFrame, fmt: str, **options: str) -> str:
    """Files of a fresh folder."""
    path = f"{workspace(t.spark)}/landing"
    df.write.format(fmt).options(**options).save(path)
    return path


def _name(t: Tables, stem: str) -> str:
    """A table name of this run's own."""
    return f"terrace_{stem}_{workspace(t.spark)[-12:]}"


# -- readers and sinks -----------------------------------------------------

_SUPPLIER = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"


@query("scan_csv_infer", _SUPPLIER)
def _(t: Tables) -> DataFrame:
    return files.read_any(t.spark, _land(t, t.supplier, "csv", header="true"), "csv")


@query("scan_csv_schema", _SUPPLIER)
def _(t: Tables) -> DataFrame:
    return files.read_any(t.spark, _land(t, t.supplier, "csv", header="true"), "csv", "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")


@query("scan_select_options", _SUPPLIER)
def _(t: Tables) -> DataFrame:
    path = _land(t, t.supplier, "csv", header="true", sep="|")
    for statement in files.select_all_sql(path, "csv", options={"header": "true", "delimiter": "|", "inferSchema": "true"}, name=_name(t, "options")):
        out = t.spark.sql(statement)
    return out


@query("scan_preview", "SELECT r_regionkey, r_name FROM region")
def _(t: Tables) -> DataFrame:
    return files.preview(t.spark, f"{t.folder}/region.parquet")


@query("scan_rescued", "SELECT s_suppkey, s_name, NULL AS rescued FROM supplier UNION ALL SELECT NULL, 'odd', 'not a number,odd'")
def _(t: Tables) -> DataFrame:
    odd = t.spark.createDataFrame([("not a number", "odd")], "s_suppkey string, s_name string")
    path = _land(t, t.supplier.select(c("s_suppkey").cast("string"), "s_name").unionAll(odd), "csv")
    return files.read_files(t.spark, path, "csv", "s_suppkey long, s_name string", rescue=True, header="false").withColumnRenamed(files.RESCUED, "rescued")


@query("scan_drop_malformed", "SELECT s_suppkey, s_name FROM supplier")
def _(t: Tables) -> DataFrame:
    odd = t.spark.createDataFrame([("not a number", "odd")], "s_suppkey string, s_name string")
    path = _land(t, t.supplier.select(c("s_suppkey").cast("string"), "s_name").unionAll(odd), "csv")
    return files.read_files(t.spark, path, "csv", "s_suppkey long, s_name string", mode="DROPMALFORMED", header="false")


@query("scan_input_file", "SELECT n_nationkey, 'nation.parquet' AS file FROM nation")
def _(t: Tables) -> DataFrame:
    return files.with_input_file(t.nation).select("n_nationkey", F.regexp_extract("source_file", "([^/]+\\.parquet)$", 1).alias("file"))


@query("scan_external_csv", _SUPPLIER)
def _(t: Tables) -> DataFrame:
    path = _land(t, t.supplier, "csv", header="true", sep="|")
    return files.external_csv_table(t.spark, _name(t, "external"), path, "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE")


@query("ingest_labelled", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, 'buyers' AS source, NULL AS extra FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, 'sellers', s_nationkey FROM supplier")
def _(t: Tables) -> DataFrame:
    buyers = _land(t, t.customer.select("c_custkey", "c_name", "c_acctbal"), "csv", header="true")
    sellers = _land(t, t.supplier.select("s_suppkey", "s_name", "s_acctbal", "s_nationkey"), "csv", header="true")
    names = {"c_custkey": "id", "s_suppkey": "id", "c_name": "name", "s_name": "name", "c_acctbal": "balance", "s_acctbal": "balance", "s_nationkey": "extra"}
    return files.ingest_labelled(t.spark, {"buyers": buyers, "sellers": sellers}, columns=names)


@query("sink_path", "SELECT * FROM region")
def _(t: Tables) -> DataFrame:
    path = f"{workspace(t.spark)}/out"
    for _ in range(2):
        sinks.write(t.region, path)
    return t.spark.read.parquet(path)


@query("sink_table", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(t: Tables) -> DataFrame:
    name = _name(t, "sink")
    sinks.write(t.nation, name)
    return t.spark.table(name)


@query("sink_create_table_as", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def _(t: Tables) -> DataFrame:
    name = _name(t, "ctas")
    sinks.create_table_as(t.nation, name)
    return sinks.create_table_as(t.nation.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n")), name)


@query("sink_export_csv", "SELECT p_partkey, p_brand, p_size FROM part")
def _(t: Tables) -> DataFrame:
    path = f"{workspace(t.spark)}/csv"
    sinks.export_csv(t.part.select("p_partkey", "p_brand", "p_size"), path)
    return files.read_any(t.spark, path, "csv")


@query("sink_drop", "SELECT true AS was_there, false AS is_there")
def _(t: Tables) -> DataFrame:
    name = _name(t, "drop")
    sinks.write(t.region, name)
    was = sinks.drop(t.spark, name)
    return t.spark.range(1).select(F.lit(was).alias("was_there"), F.lit(sinks.drop(t.spark, name)).alias("is_there"))


@query("list_files", "SELECT t AS name FROM (VALUES ('nation.parquet'), ('region.parquet')) v(t)")
def _(t: Tables) -> DataFrame:
    return files.list_datasets(t.spark, t.folder).select("name").filter(c("name").isin("nation.parquet", "region.parquet"))


@query("stream_schema_location", _SUPPLIER)
def _(t: Tables) -> DataFrame:
    path, home = _land(t, t.supplier, "csv", header="true"), workspace(t.spark)
    store = TableStore(t.spark, f"{home}/tables")
    for _ in range(2):  # the second takes the schema from where the first has kept it
        store.copy_into("s", path, "csv", schema_location=f"{home}/schema", max_files=1)
    return store.read("s")


@query("stream_string_types", "SELECT s_suppkey::VARCHAR AS s_suppkey, s_name FROM supplier")
def _(t: Tables) -> DataFrame:
    path = _land(t, t.supplier.select("s_suppkey", "s_name"), "csv", header="true")
    store = TableStore(t.spark, workspace(t.spark))
    store.copy_into("s", path, "csv", infer_types=False)
    return store.read("s")


# -- projections, functions, catalogue --------------------------------------


@query("audit_columns", "SELECT r_regionkey, r_name, 'files' AS _bronze_source_path, 'bronze' AS _bronze_data_layer, true AS stamped FROM region")
def _(t: Tables) -> DataFrame:
    rows = P.add_metadata(t.region, "files", "bronze", "_bronze_")
    return rows.select("r_regionkey", "r_name", "_bronze_source_path", "_bronze_data_layer", (c("_bronze_ingestion_timestamp").isNotNull() & (c("_bronze_processing_date") == c("_bronze_ingestion_timestamp").cast("date"))).alias("stamped"))


@query("custom_transformation", "SELECT o_orderkey, o_totalprice, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS size FROM orders")
def _(t: Tables) -> DataFrame:
    config = medallion.Silver(custom=lambda df: df.withColumn("size", P.flag(c("o_totalprice") > 100000, "big", "small")))
    return medallion.silver(t.orders, config).select("o_orderkey", "o_totalprice", "size")


@query("arithmetic_projection", f"SELECT l_orderkey, l_linenumber, (l_quantity::{MONEY} * l_extendedprice::{MONEY})::DOUBLE AS line_total FROM lineitem")
def _(t: Tables) -> DataFrame:
    money = lambda x: c(x).cast("decimal(18,2)")
    return t.lineitem.select("l_orderkey", "l_linenumber", (money("l_quantity") * money("l_extendedprice")).cast("double").alias("line_total"))


_EMAILS = "(SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'a@bXco' ELSE 'u' || c_custkey || '@mail.example.org' END AS email FROM customer) e"


@query("clean_email", f"SELECT c_custkey, CASE WHEN regexp_matches(email, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}$') THEN email END AS clean_email FROM {_EMAILS}")
def _(t: Tables) -> DataFrame:
    email = F.when(c("c_custkey") % 3 == 0, None).when(c("c_custkey") % 3 == 1, "a@bXco").otherwise(F.concat(F.lit("u"), c("c_custkey").cast("string"), F.lit("@mail.example.org")))
    return t.customer.withColumn("email", email).select("c_custkey", F.when(S.validate_email(c("email")), c("email")).alias("clean_email"))


@query("string_initcap", "SELECT p_partkey, array_to_string(list_transform(string_split(lower(trim(p_type)), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') AS title, upper(p_name) AS up, lower(p_brand) AS low FROM part")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.initcap(F.trim("p_type")).alias("title"), F.upper("p_name").alias("up"), F.lower("p_brand").alias("low"))


@query("binary_casts", "SELECT c_custkey, c_name AS text, octet_length(encode(c_name)) AS n_bytes, upper(hex(encode(c_name))) AS hex FROM customer")
def _(t: Tables) -> DataFrame:
    raw = c("c_name").cast("binary")
    return t.customer.select("c_custkey", raw.cast("string").alias("text"), F.octet_length(raw).alias("n_bytes"), F.hex(raw).alias("hex"))


@query("current_functions", "SELECT n_nationkey, true AS same_day, true AS same_time FROM nation")
def _(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", (F.current_date() == F.to_date(F.now())).alias("same_day"), (F.current_timestamp() == F.now()).alias("same_time"))


@query("date_formats", "SELECT o_orderkey, strftime(o_orderdate, '%b %-d, %Y') AS long_date, strftime(o_orderdate, '%H:%M:%S') AS clock, o_orderdate::DATE AS parsed FROM orders")
def _(t: Tables) -> DataFrame:
    text = F.date_format("o_orderdate", "yyyy/MM/dd")
    return t.orders.select("o_orderkey", F.date_format("o_orderdate", "MMM d, yyyy").alias("long_date"), F.date_format("o_orderdate", "HH:mm:ss").alias("clock"), F.to_date(text, "yyyy/MM/dd").alias("parsed"))


@query("identifier_clause", "SELECT n_name FROM nation")
def _(t: Tables) -> DataFrame:
    name = _name(t, "identifier")
    t.nation.createOrReplaceTempView(name)
    return t.spark.sql("SELECT IDENTIFIER('n_' || :what) AS n_name FROM IDENTIFIER('terrace_' || :view)", {"what": "name", "view": name.removeprefix("terrace_")})


@query("current_catalog_schema", "SELECT 'spark_catalog' AS catalog_name, 'default' AS schema_name, count(*) AS n FROM region")
def _(t: Tables) -> DataFrame:
    return t.region.groupBy(F.current_catalog().alias("catalog_name"), F.current_schema().alias("schema_name")).agg(F.count(F.lit(1)).alias("n"))


@query("describe_functions", "SELECT name FROM (VALUES ('customer_segment'), ('is_in_range'), ('mask_text')) v(name)")
def _(t: Tables) -> DataFrame:
    S.register(t.spark)
    told = [n for n in ("customer_segment", "is_in_range", "mask_text") if n in " ".join(r[0] for r in S.describe(t.spark, n).collect())]
    return S.user_functions(t.spark).filter(c("name").isin(told))


@query("sql_function_forms", "SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '2000-01-01') AS age, left(o_orderstatus || 'xyz', 2) || repeat('*', 2) AS masked, round(o_totalprice * 100 / 7, 1) AS pct, CASE WHEN o_custkey % 5 = 0 THEN 100.0 ELSE 0.0 END::DOUBLE AS null_pct FROM orders")
def _(t: Tables) -> DataFrame:
    S.register(t.spark)
    return t.orders.select("o_orderkey", F.expr("age_in_days(CAST(o_orderdate AS DATE), DATE'2000-01-01')").cast("long").alias("age"), F.expr("mask_text(concat(o_orderstatus, 'xyz'), 2)").alias("masked"), F.expr("calculate_percentage(o_totalprice, 7D, 1)").alias("pct"), F.expr("null_percentage(CASE WHEN o_custkey % 5 <> 0 THEN 'x' END)").alias("null_pct"))


@query("library_search", "SELECT name FROM (VALUES ('completeness_check'), ('primary_key_check'), ('composite_key_check')) v(name)")
def _(t: Tables) -> DataFrame:
    lib = library.default_library()
    found = [n for n in json.loads(lib.export()) if n in lib.list("check") or n in lib.search("nulls")]
    return t.spark.createDataFrame([(n,) for n in found if n in ("completeness_check", "primary_key_check", "composite_key_check")], "name string")


@query("library_gold_aggregation", f"SELECT o_orderstatus, count(*) AS n, sum(o_totalprice::{MONEY})::DOUBLE AS total FROM orders GROUP BY 1")
def _(t: Tables) -> DataFrame:
    name = _name(t, "gold")
    t.orders.createOrReplaceTempView(name)
    lib = library.default_library()
    return t.spark.sql(lib.render("gold_aggregation", keys=sqlrunner.Identifier("o_orderstatus"), aggregates=sqlrunner.Fragment("count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total"), source=sqlrunner.Identifier(name)))


@query("library_completeness", "SELECT count(*) AS total_rows, count(p_size) AS non_null_count, count(*) - count(p_size) AS null_count, 100.0::DOUBLE AS completeness_percentage FROM part")
def _(t: Tables) -> DataFrame:
    name = _name(t, "complete")
    t.part.createOrReplaceTempView(name)
    return t.spark.sql(library.default_library().render("completeness_check", column=sqlrunner.Identifier("p_size"), table=sqlrunner.Identifier(name)))


@query("data_cleaning_pattern", f"SELECT c_custkey, CASE WHEN regexp_matches(coalesce(email, ''), '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}$') THEN 'valid' ELSE 'invalid' END AS email_validity FROM {_EMAILS}")
def _(t: Tables) -> DataFrame:
    email = F.when(c("c_custkey") % 3 == 0, None).when(c("c_custkey") % 3 == 1, "a@bXco").otherwise(F.concat(F.lit("u"), c("c_custkey").cast("string"), F.lit("@mail.example.org")))
    return P.data_cleaning(t.customer.withColumn("email", email), "email").select("c_custkey", "email_validity")


@query("group_agg_many", f"SELECT l_returnflag, min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max, count(l_quantity) AS l_quantity_count, count(DISTINCT l_suppkey) AS l_suppkey_count_distinct FROM lineitem GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return A.group_agg(t.lineitem, ["l_returnflag"], {"l_quantity": ["min", "max", "count"], "l_suppkey": ["count_distinct"]})


@query("distinct_counts", "SELECT l_returnflag, count(DISTINCT l_partkey) AS l_partkey, count(DISTINCT l_suppkey) AS l_suppkey, count(DISTINCT l_shipdate) AS l_shipdate FROM lineitem GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return A.distinct_counts(t.lineitem, ["l_partkey", "l_suppkey", "l_shipdate"], ["l_returnflag"])


# -- quality ---------------------------------------------------------------


@query("dq_schema_info", "SELECT * FROM (VALUES (0, 'r_regionkey', 'int'), (1, 'r_name', 'string')) v(position, column_name, data_type)")
def _(t: Tables) -> DataFrame:
    return Q.schema_info(t.region).drop("nullable")


@query("dq_suite", "SELECT 'null_check' AS \"check\", true AS passed UNION ALL SELECT 'range_check', avg(CASE WHEN o_totalprice BETWEEN 0 AND 200000 THEN 1.0 ELSE 0 END) >= 0.95 FROM orders UNION ALL SELECT 'uniqueness_check', count(*) = count(DISTINCT o_orderkey) FROM orders UNION ALL SELECT 'domain_check', false")
def _(t: Tables) -> DataFrame:
    checks = [Q.null_check("o_orderkey"), Q.range_check("o_totalprice", 0, 200000), Q.uniqueness_check(["o_orderkey"]), Q.domain_check("o_orderstatus", ["F"])]
    return t.spark.createDataFrame([(r["check"], r["passed"]) for r in Q.run_suite(t.orders, checks)], "check string, passed boolean")


@query("dq_recommendations", "SELECT 'column c_acctbal has many nulls' AS advice UNION ALL SELECT 'check uniqueness_check failed' UNION ALL SELECT 'quality score 90 is under 95'")
def _(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", "c_nationkey", F.when(c("c_custkey") % 2 == 0, c("c_acctbal")).alias("c_acctbal"))
    found = Q.validate_layer(rows, "silver", checks=[Q.uniqueness_check(["c_nationkey"])])
    return t.spark.createDataFrame([(a,) for a in found.recommendations], "advice string")


@query("dq_layers", "SELECT * FROM (VALUES ('bronze', 100, 96.6667::DOUBLE), ('silver', 90, 96.6667::DOUBLE), ('gold', 100, 96.6667::DOUBLE)) v(layer, score, mean_score)")
def _(t: Tables) -> DataFrame:
    holes = t.customer.select("c_custkey", F.when(c("c_custkey") % 4 > 0, c("c_acctbal")).alias("c_acctbal"))
    found, mean = Q.validate_layers({"bronze": holes, "silver": holes, "gold": t.customer})
    return t.spark.createDataFrame([(v.layer, v.score, round(mean, 4)) for v in found], "layer string, score int, mean_score double")


@query("dq_metric_consistency", "SELECT count(*) AS total_rows, count(CASE WHEN o_orderkey % 10 = 0 THEN 1 END) AS inconsistent_rows FROM orders")
def _(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", c("o_totalprice").alias("total"), (c("o_totalprice") * 0.25).alias("a"), (c("o_totalprice") * 0.75 + F.when(c("o_orderkey") % 10 == 0, 1.0).otherwise(0.0)).alias("b"))
    return Q.metric_consistency(rows, "total", ["a", "b"])


@query("dq_aggregation_accuracy", "SELECT count(DISTINCT o_orderstatus) AS groups, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderstatus END) AS wrong_groups FROM orders")
def _(t: Tables) -> DataFrame:
    summary = t.orders.groupBy("o_orderstatus").agg((A.money_sum(c("o_totalprice")) + F.max(F.when(c("o_orderstatus") == "F", 5).otherwise(0))).alias("total"))
    return Q.aggregation_accuracy(t.orders, summary, ["o_orderstatus"], "o_totalprice", "total")


@query("dq_trend", "WITH m AS (SELECT year(o_orderdate)::INTEGER AS y, count(*) AS value FROM orders GROUP BY 1), n AS (SELECT *, lag(value) OVER (ORDER BY y) AS b FROM m) SELECT y, value, round((value - b)::DOUBLE / b, 4) AS change, coalesce(abs(round((value - b)::DOUBLE / b, 4)) > 0.3, false) AS anomaly FROM n")
def _(t: Tables) -> DataFrame:
    return Q.trend(t.orders.withColumn("y", F.year("o_orderdate")), "y", F.count(F.lit(1)), 0.3)


@query("dq_capped_profile", "WITH r AS (SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 1000) SELECT 'o_orderkey' AS column_name, count(*) AS total_rows, count(DISTINCT o_orderkey) AS distinct_count FROM r UNION ALL SELECT 'o_custkey', count(*), count(DISTINCT o_custkey) FROM r")
def _(t: Tables) -> DataFrame:
    return Q.capped_profile(t.orders.select("o_orderkey", "o_custkey"), ["o_orderkey"], 1000).select("column_name", "total_rows", "distinct_count")


@query("schema_and_required", "SELECT r_regionkey, r_name, true AS refused FROM region")
def _(t: Tables) -> DataFrame:
    refused = []
    for check in (lambda: P.require_columns(t.region, ["gone"]), lambda: P.validate_schema(t.region, t.nation.schema)):
        try:
            check()
            refused.append(False)
        except ValueError:
            refused.append(True)
    return P.validate_schema(P.require_columns(t.region, ["r_name"]), t.region.schema).withColumn("refused", F.lit(all(refused)))


@query("monitor_drift", "SELECT 'o_orderkey' AS column_name, count(*) AS rows_change, 0::BIGINT AS null_change, count(DISTINCT o_orderkey) AS distinct_change FROM orders UNION ALL SELECT 'o_custkey', count(*), count(CASE WHEN o_custkey % 2 = 0 THEN 1 END), 0 FROM orders")
def _(t: Tables) -> DataFrame:
    before = t.orders.select("o_orderkey", "o_custkey")
    more = before.select((-c("o_orderkey") - 1).alias("o_orderkey"), F.when(c("o_custkey") % 2 != 0, c("o_custkey")).alias("o_custkey"))
    return Q.drift(Q.snapshot(before, "t0"), Q.snapshot(before.unionAll(more), "t1"))


# -- versioned tables ------------------------------------------------------


def _store(t: Tables) -> TableStore:
    return TableStore(t.spark, workspace(t.spark))


_ODD = "SELECT CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey END AS k, o_totalprice AS v FROM orders"


@query("merge_null_keys", f"WITH o AS ({_ODD}) SELECT k, CASE WHEN k IS NOT NULL THEN v + 1 ELSE v END AS v FROM o UNION ALL SELECT k, v + 1 FROM o WHERE k IS NULL")
def _(t: Tables) -> DataFrame:
    rows = t.orders.select(F.when(c("o_orderkey") % 4 != 0, c("o_orderkey")).alias("k"), c("o_totalprice").alias("v"))
    store = _store(t)
    store.create("o", rows)
    store.merge("o", rows.withColumn("v", c("v") + 1), ["k"])
    return store.read("o")


@query("merge_insert_duplicates", "SELECT o_orderkey AS k, o_totalprice AS v FROM orders UNION ALL SELECT o_custkey + 1000000000, o_totalprice FROM orders")
def _(t: Tables) -> DataFrame:
    target = t.orders.select(c("o_orderkey").alias("k"), c("o_totalprice").alias("v"))
    source = t.orders.select((c("o_custkey") + 1000000000).alias("k"), c("o_totalprice").alias("v"))  # several rows of a key that is not there
    return merged(target, source, ["k"])


@query("merge_touched_files", "SELECT o_orderkey, CASE WHEN o_orderkey = (SELECT max(o_orderkey) FROM orders) THEN -1.0 ELSE o_totalprice END AS o_totalprice, true AS others_stay FROM orders")
def _(t: Tables) -> DataFrame:
    store = _store(t)
    store.create("o", t.orders.select("o_orderkey", "o_totalprice"))
    store.optimize("o", ["o_orderkey"], partitions=4)
    before = {f for x in store._files(store.entry("o")).values() for f in x}
    last = t.orders.agg(F.max("o_orderkey").alias("o_orderkey")).withColumn("o_totalprice", F.lit(-1.0))
    store.merge("o", last, ["o_orderkey"])
    after = {f for x in store._files(store.entry("o")).values() for f in x}
    return store.read("o").withColumn("others_stay", F.lit(len(before & after) == len(before) - 1))


@query("shallow_clone_after_drop", "SELECT r_regionkey, r_name FROM region")
def _(t: Tables) -> DataFrame:
    store = _store(t)
    store.create("r", t.region)
    store.clone("r", "copy")
    store.drop("r")
    return store.read("copy")


@query("optimize_zorder", "SELECT p_partkey, p_size, p_retailprice FROM part")
def _(t: Tables) -> DataFrame:
    store = _store(t)
    store.create("part", t.part.select("p_partkey", "p_size", "p_retailprice"))
    store.optimize("part", zorder_by=["p_size", "p_retailprice"], partitions=4)
    return store.read("part")


@query("time_travel_timestamp", "SELECT r_regionkey, r_name FROM region")
def _(t: Tables) -> DataFrame:
    store = _store(t)
    store.create("r", t.region)
    at = store.entry("r").at
    store.delete("r")
    return store.read("r", as_of=dt.datetime.fromtimestamp(at))


@query("vacuum_old_versions", "SELECT r_regionkey, r_name, 1 AS folders_gone FROM region WHERE r_regionkey > 0")
def _(t: Tables) -> DataFrame:
    store = _store(t)
    store.create("r", t.region)
    store.delete("r", c("r_regionkey") == 0)
    gone = store.vacuum("r")
    return store.read("r").withColumn("folders_gone", F.lit(gone))


@query("generated_on_append", "SELECT o_orderkey, o_orderdate, o_orderdate::DATE AS day, 'when it was made' AS told FROM orders UNION ALL SELECT -1, TIMESTAMP '2020-05-17 10:00:00', DATE '2020-05-17', 'when it was made'")
def _(t: Tables) -> DataFrame:
    store = _store(t)
    store.create("o", t.orders.select("o_orderkey", "o_orderdate"), constraints={"recent": "day > DATE '1900-01-01'"}, generated={"day": "to_date(o_orderdate)"}, comments={"": "orders", "day": "when it was made"})
    store.append("o", t.spark.createDataFrame([(-1, dt.datetime(2020, 5, 17, 10))], "o_orderkey long, o_orderdate timestamp_ntz"))
    told = {r.column_name: r.comment for r in store.describe("o").collect()}["day"]
    return store.read("o").withColumn("told", F.lit(told))


@query("log_inserts", "SELECT * FROM (VALUES ('vacuum', '{\"rows\": \"5\"}'), ('optimize', '{\"rows\": \"7\"}')) v(event, details)")
def _(t: Tables) -> DataFrame:
    store = _store(t)
    store.log_event("maintenance", "vacuum", rows=5)
    store.log_event("maintenance", "optimize", rows=7)
    return store.read("maintenance").select("event", "details")


@query("tables_modified_since", "SELECT * FROM (VALUES ('nation', 0::BIGINT), ('region', 1::BIGINT)) v(table_name, version)")
def _(t: Tables) -> DataFrame:
    store = _store(t)
    store.create("old", t.part.limit(1))
    mark = store.entry("old").at + 1e-6
    store.create("region", t.region)
    store.create("nation", t.nation)
    store.delete("region", c("r_regionkey") == 1)
    return H.modified_since(store, mark).select("table_name", "version")


@query("upgrade_tables", "SELECT r_regionkey, r_name, 'created,unchanged' AS steps FROM region")
def _(t: Tables) -> DataFrame:
    store, name = _store(t), _name(t, "legacy")
    t.region.createOrReplaceTempView(name)
    steps = [H.upgrade(t.spark, [name], store, how)[name] for how in ("copy", "sync")]
    return store.read(name).withColumn("steps", F.lit(",".join(steps)))


@query("table_discovery", "SELECT 'nation' AS stem, true AS is_temporary UNION ALL SELECT 'region', true")
def _(t: Tables) -> DataFrame:
    tag = workspace(t.spark)[-12:]
    for n, df in (("nation", t.nation), ("region", t.region), ("zzz", t.region)):
        df.createOrReplaceTempView(f"found_{tag}_{n}")
    found = H.list_tables(t.spark, max_tables=2, like=f"found_{tag}_*")
    return found.select(F.element_at(F.split("table_name", "_"), -1).alias("stem"), "is_temporary")


@query("list_columns", "SELECT * FROM (VALUES (0, 'r_regionkey', 'int', 'default'), (1, 'r_name', 'string', 'default')) v(position, column_name, data_type, schema_name)")
def _(t: Tables) -> DataFrame:
    name = _name(t, "columns")
    t.region.createOrReplaceTempView(name)
    schemas = [r.schema_name for r in H.list_schemas(t.spark).collect()]
    return H.list_columns(t.spark, name).drop("nullable").withColumn("schema_name", F.lit("default" if "default" in schemas else ""))


@query("named_masks", "SELECT c_custkey, CASE WHEN c_nationkey < 10 THEN 'REDACTED' END AS record, c_nationkey FROM customer WHERE c_nationkey < 10")
def _(t: Tables) -> DataFrame:
    who, p = H.Principal("ann", frozenset({"analysts"})), H.Policies()
    p.set_mask("customer", "record", H.mrn_mask)
    p.set_row_filter("customer", lambda x: H.device_filter(c("c_nationkey"), x, 10))
    return p.secure("customer", t.customer.select("c_custkey", c("c_name").alias("record"), "c_nationkey"), who)


# -- SQL scripts on versioned tables -----------------------------------------


@query("sql_merge", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 1 THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 3 <> 2 UNION ALL SELECT o_orderkey + 1000000000, o_totalprice FROM orders WHERE o_orderkey % 3 = 0")
def _(t: Tables) -> DataFrame:
    orders = _name(t, "orders")
    t.orders.createOrReplaceTempView(orders)
    return SqlTables(_store(t), {"orders": sqlrunner.Identifier(orders)}).run("""
        CREATE TABLE target AS SELECT o_orderkey AS k, o_totalprice AS v FROM ${orders};
        CREATE TABLE changes AS SELECT IF(o_orderkey % 3 = 0, o_orderkey + 1000000000, o_orderkey) AS k, o_totalprice + IF(o_orderkey % 3 = 1, 1, 0) AS v, CASE o_orderkey % 3 WHEN 2 THEN 'delete' ELSE 'put' END AS op FROM ${orders};
        MERGE INTO target a USING changes b ON a.k = b.k
        WHEN MATCHED AND b.op = 'delete' THEN DELETE
        WHEN MATCHED THEN UPDATE SET v = b.v
        WHEN NOT MATCHED AND b.op <> 'delete' THEN INSERT (k, v) VALUES (b.k, b.v);
        SELECT * FROM target""")


@query("sql_insert_only_merge", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey + 10, r_name FROM region WHERE r_regionkey > 1")
def _(t: Tables) -> DataFrame:
    region = _name(t, "region")
    t.region.createOrReplaceTempView(region)
    return SqlTables(_store(t), {"region": sqlrunner.Identifier(region)}).run("""
        CREATE TABLE r AS SELECT * FROM ${region};
        MERGE INTO r USING (SELECT r_regionkey + 10 AS r_regionkey, r_name FROM ${region} UNION ALL SELECT * FROM ${region}) s ON r.r_regionkey = s.r_regionkey
        WHEN NOT MATCHED AND (s.r_regionkey > 11 OR s.r_regionkey < 5) THEN INSERT *;
        SELECT * FROM r""")


@query("sql_history", "SELECT * FROM (VALUES (0::BIGINT, 'CREATE'), (1::BIGINT, 'APPEND'), (2::BIGINT, 'UPDATE'), (3::BIGINT, 'DELETE'), (4::BIGINT, 'OPTIMIZE'), (5::BIGINT, 'RESTORE')) h(version, operation)")
def _(t: Tables) -> DataFrame:
    return SqlTables(_store(t)).run("""
        CREATE TABLE IF NOT EXISTS s (id INT, name STRING COMMENT 'the name', CONSTRAINT positive CHECK (id > 0));
        INSERT INTO s VALUES (1, 'a'), (2, 'it''s; b');
        UPDATE s SET name = 'c' WHERE id = 1;
        DELETE FROM s WHERE name LIKE '%;%';
        OPTIMIZE s ZORDER BY (id);
        RESTORE TABLE s TO VERSION AS OF 1;
        DESCRIBE HISTORY s""").select("version", "operation")


@query("sql_time_travel", "SELECT r_regionkey, r_name, 'then' AS moment FROM region UNION ALL SELECT r_regionkey, r_name, 'now' FROM region WHERE r_regionkey > 2")
def _(t: Tables) -> DataFrame:
    region = _name(t, "region")
    t.region.createOrReplaceTempView(region)
    return SqlTables(_store(t), {"region": sqlrunner.Identifier(region)}).run("""
        CREATE OR REPLACE TABLE r AS SELECT /*+ COALESCE(1) */ * FROM ${region};
        DELETE FROM r WHERE r_regionkey <= 2;
        (SELECT *, 'then' AS moment FROM r VERSION AS OF 0) UNION ALL SELECT *, 'now' FROM r""")


@query("sql_copy_into", "SELECT event_id, upper(event_type) AS kind FROM events")
def _(t: Tables) -> DataFrame:
    path = _land(t, t.events.select("event_id", "event_type"), "parquet")
    return SqlTables(_store(t), {"path": path}).run("""
        CREATE TABLE e;
        COPY INTO e FROM (SELECT event_id, upper(event_type) AS kind FROM ${path}) FILEFORMAT = PARQUET COPY_OPTIONS ('mergeSchema' = 'true');
        COPY INTO e FROM (SELECT event_id, upper(event_type) AS kind FROM ${path}) FILEFORMAT = PARQUET COPY_OPTIONS ('mergeSchema' = 'true');
        SELECT * FROM e""".replace("${path}", f"'{path}'"))


@query("sql_clone_and_comment", "SELECT n_nationkey, n_name, 'kept for tests' AS told FROM nation")
def _(t: Tables) -> DataFrame:
    nation, store = _name(t, "nation"), _store(t)
    t.nation.createOrReplaceTempView(nation)
    out = SqlTables(store, {"nation": sqlrunner.Identifier(nation)}).run("""
        CREATE TABLE n AS SELECT n_nationkey, n_name FROM ${nation};
        COMMENT ON TABLE n IS 'kept for tests';
        CREATE TABLE copy SHALLOW CLONE n;
        DROP TABLE n;
        SELECT * FROM copy""")
    return out.withColumn("told", F.lit({r.table_name: r.comment for r in store.detail().collect()}["copy"]))


@query("sql_analyze", "SELECT 'r_name' AS column_name, count(*) AS total_rows, count(DISTINCT r_name) AS distinct_count FROM region UNION ALL SELECT 'r_regionkey', count(*), count(DISTINCT r_regionkey) FROM region")
def _(t: Tables) -> DataFrame:
    region = _name(t, "region")
    t.region.createOrReplaceTempView(region)
    return SqlTables(_store(t), {"region": sqlrunner.Identifier(region)}).run("CREATE TABLE r AS SELECT * FROM ${region}; ANALYZE TABLE r COMPUTE STATISTICS FOR ALL COLUMNS").select("column_name", "total_rows", "distinct_count")


@query("sql_bronze_to_silver", "SELECT o_orderkey, o_totalprice, 'silver' AS table_name, count(*) OVER () AS logged_rows FROM orders WHERE o_totalprice > 1000")
def _(t: Tables) -> DataFrame:
    orders, store = _name(t, "orders"), _store(t)
    t.orders.createOrReplaceTempView(orders)
    select = library.default_library().render("bronze_to_silver", columns=sqlrunner.Fragment("o_orderkey, o_totalprice"), source=sqlrunner.Identifier(orders), condition=sqlrunner.Fragment("o_totalprice > 1000"))
    stats = SqlTables(store).run(f"CREATE OR REPLACE TABLE silver AS {select}; ANALYZE TABLE silver COMPUTE STATISTICS FOR ALL COLUMNS")
    store.log_event("pipeline_log", "silver", rows=stats.first().total_rows)
    log = store.read("pipeline_log").select(c("event").alias("table_name"), F.get_json_object("details", "$.rows").cast("long").alias("logged_rows"))
    return store.read("silver").select("o_orderkey", "o_totalprice").join(F.broadcast(log))  # the log has one row


# -- layer chains ------------------------------------------------------------


def _ecommerce(t: Tables) -> DataFrame:
    k = c("o_orderkey")
    return t.orders.select(k.alias("order_id"), c("o_custkey").alias("customer_id"), (k % 50).alias("product_id"), (k % 7 + 1).alias("quantity"), c("o_totalprice").alias("unit_price"), c("o_totalprice").alias("total_amount"), F.to_date("o_orderdate").alias("order_date"), c("o_orderstatus").alias("status"))


@query("chain_ecommerce", f"SELECT o_custkey AS customer_id, o_orderkey % 50 AS product_id, count(*) AS total_orders, sum(o_totalprice::{MONEY})::DOUBLE AS total_spend, max(o_totalprice::{MONEY})::DOUBLE AS max_order_value, min(o_totalprice::{MONEY})::DOUBLE AS min_order_value, sum(o_orderkey % 7 + 1)::BIGINT AS total_quantity_sold, count(CASE WHEN o_totalprice > 1000 THEN 1 END) AS high_value_orders, count(CASE WHEN o_totalprice > 500 AND o_totalprice <= 1000 THEN 1 END) AS medium_value_orders, count(CASE WHEN o_totalprice <= 500 THEN 1 END) AS low_value_orders, count(CASE WHEN o_orderstatus IN ('F', 'O', 'P') THEN 1 END) AS valid_records, count(CASE WHEN o_orderstatus NOT IN ('F', 'O', 'P') THEN 1 END) AS invalid_records FROM orders WHERE o_totalprice > 0 GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    path = _land(t, _ecommerce(t), "csv", header="true")
    return chains.run(chains.CHAINS["ecommerce"], _store(t), f"read_files('{path}', format => 'csv', schema => 'order_id BIGINT, customer_id BIGINT, product_id BIGINT, quantity BIGINT, unit_price DOUBLE, total_amount DOUBLE, order_date DATE, status STRING')")


_STAY = "(l_orderkey % 45)"
_ILL = "CASE l_partkey % 3 WHEN 0 THEN 'an acute case' WHEN 1 THEN 'a chronic one' ELSE 'other' END"


@query("chain_healthcare", f"WITH s AS (SELECT l_shipdate, l_returnflag AS hospital_ward, l_suppkey AS doctor_id, {_STAY} AS stay, CASE WHEN {_STAY} > 30 THEN 'long_stay' WHEN {_STAY} > 7 THEN 'medium_stay' ELSE 'short_stay' END AS stay_category, CASE l_partkey % 3 WHEN 0 THEN 'high_severity' WHEN 1 THEN 'medium_severity' ELSE 'low_severity' END AS severity_level, l_partkey % 130 AS age FROM lineitem) SELECT hospital_ward, doctor_id, stay_category, severity_level, count(*) AS total_patients, sum(stay)::BIGINT AS total_bed_days, max(stay)::BIGINT AS longest_stay, round(avg(age), 4) AS average_age, count(CASE WHEN age <= 120 THEN 1 END) AS valid_records, count(CASE WHEN age > 120 THEN 1 END) AS invalid_records FROM s GROUP BY 1, 2, 3, 4")
def _(t: Tables) -> DataFrame:
    day = F.to_date("l_shipdate")
    rows = t.lineitem.select(c("l_orderkey").alias("patient_id"), (c("l_partkey") % 130).alias("age"), F.expr(_ILL).alias("diagnosis"), day.alias("admission_date"), F.date_add(day, (c("l_orderkey") % 45).cast("int")).alias("discharge_date"), c("l_returnflag").alias("hospital_ward"), c("l_suppkey").alias("doctor_id"))
    path = _land(t, rows, "parquet")
    out = chains.run(chains.CHAINS["healthcare"], _store(t), f"read_files('{path}', format => 'parquet')")
    return out.withColumn("longest_stay", c("longest_stay").cast("long"))


@query("chain_retail", f"WITH s AS (SELECT n_name AS state, r_name AS region, CASE WHEN c_acctbal > 5000 THEN 'high_volume' WHEN c_acctbal > 0 THEN 'medium_volume' ELSE 'low_volume' END AS purchase_volume, CASE WHEN c_custkey % 4 >= 3 THEN 'high_value' WHEN c_custkey % 4 >= 2 THEN 'medium_value' ELSE 'low_value' END AS customer_segment, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT state, region, purchase_volume, customer_segment, count(*) AS total_customers, sum(c_acctbal::{MONEY})::DOUBLE AS total_units_purchased, max(c_acctbal::{MONEY})::DOUBLE AS most_units, count(*) AS valid_records, 0::BIGINT AS invalid_records FROM s GROUP BY 1, 2, 3, 4")
def _(t: Tables) -> DataFrame:
    geo = t.customer.join(t.nation, c("c_nationkey") == c("n_nationkey")).join(t.region, c("n_regionkey") == c("r_regionkey"))
    rows = geo.select(c("c_custkey").alias("customer_id"), c("c_name").alias("customer_name"), c("n_name").alias("state"), c("r_name").alias("region"), c("c_acctbal").alias("units_purchased"), (c("c_custkey") % 4).alias("loyalty_segment"))
    return chains.run(chains.CHAINS["retail"], _store(t), f"read_files('{_land(t, rows, 'json')}', format => 'json')")


_MADE = "(DATE '2020-12-01' + (p_partkey % 90)::INTEGER)"


def _products(t: Tables) -> DataFrame:
    made = F.date_format(F.date_add(F.lit("2020-12-01").cast("date"), (c("p_partkey") % 90).cast("int")), "yyyy-MM-dd")
    return t.part.select(c("p_partkey").alias("id"), c("p_name").alias("name"), c("p_retailprice").alias("price"), c("p_brand").alias("category"), made.alias("made"))


_SIMPLE = f"SELECT {_MADE}::DATE AS made_on, p_brand AS category, CASE WHEN p_retailprice >= 1500 THEN 'high_value' WHEN p_retailprice >= 1200 THEN 'medium_value' ELSE 'low_value' END AS product_category, count(*) AS total_products, sum(p_retailprice::DECIMAL(10,2))::DOUBLE AS total_revenue, max(p_retailprice::DECIMAL(10,2))::DOUBLE AS max_price, min(p_retailprice::DECIMAL(10,2))::DOUBLE AS min_price, count(*) AS valid_price_products FROM part WHERE {_MADE}::DATE > DATE '2021-01-01' GROUP BY 1, 2, 3"


@query("chain_simple", _SIMPLE)
def _(t: Tables) -> DataFrame:
    path = _land(t, _products(t), "json")
    return chains.run(chains.CHAINS["simple"], _store(t), f"read_files('{path}', format => 'json', schema => 'id BIGINT, name STRING, price DOUBLE, category STRING, made STRING')")


@query("chain_streaming", _SIMPLE)
def _(t: Tables) -> DataFrame:
    path = _land(t, _products(t), "json")
    p = chains.stream(chains.CHAINS["simple"], G.Pipeline(t.spark, workspace(t.spark)), path, "json", "id BIGINT, name STRING, price DOUBLE, category STRING, made STRING")
    p.update()
    return p.read("simple_gold")


@query("chain_standard", f"SELECT o_custkey AS customer_id, CASE WHEN o_totalprice >= 100000 THEN 'high_value' WHEN o_totalprice >= 10000 THEN 'medium_value' ELSE 'low_value' END AS order_category, count(*) AS total_orders, count(CASE WHEN o_orderkey % 3 > 0 THEN 1 END) AS orders_with_email, sum(o_totalprice::DECIMAL(10,2))::DOUBLE AS total_revenue, max(o_totalprice::DECIMAL(10,2))::DOUBLE AS max_order_value, count(CASE WHEN o_orderdate::DATE > DATE '1993-01-01' THEN 1 END) AS valid_date_orders FROM orders GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    email = F.when(c("o_orderkey") % 3 > 0, F.concat(F.lit("c"), c("o_custkey").cast("string"), F.lit("@shop.example.org"))).otherwise(F.lit("nobody@nowhere"))
    rows = t.orders.select(c("o_orderkey").alias("id"), c("o_custkey").alias("customer_id"), c("o_totalprice").alias("amount"), F.to_date("o_orderdate").alias("ordered_on"), email.alias("email"))
    return chains.run(chains.CHAINS["standard"], _store(t), f"read_files('{_land(t, rows, 'parquet')}', format => 'parquet')")


@query("chain_bronze_layers", "SELECT 'ecommerce' AS chain, count(*) AS n, true AS stamped FROM orders UNION ALL SELECT 'retail', count(*), true FROM customer UNION ALL SELECT 'healthcare', count(*), true FROM lineitem")
def _(t: Tables) -> DataFrame:
    store, out = _store(t), None
    for name, df in (("ecommerce", t.orders), ("retail", t.customer), ("healthcare", t.lineitem)):
        values = {"bronze": sqlrunner.Identifier(f"{name}_bronze"), "source": sqlrunner.Fragment(f"read_files('{_land(t, df, 'parquet')}', format => 'parquet')")}
        SqlTables(store, values).run(chains.CHAINS[name].bronze_sql())
        one = store.read(f"{name}_bronze").agg(F.count(F.lit(1)).alias("n"), (F.count("ingested_at") == F.count(F.lit(1))).alias("stamped")).select(F.lit(name).alias("chain"), "n", "stamped")
        out = one if out is None else out.unionAll(one)
    return out


@query("chain_taxi", f"SELECT count(*) AS n_rows, sum(l_extendedprice::{MONEY})::DOUBLE AS total_amount, round(avg(l_extendedprice), 4) AS avg_amount, count(CASE WHEN l_linenumber > 1 THEN 1 END) AS multi, count(CASE WHEN l_tax > 0 THEN 1 END) AS with_tolls FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 0 AND l_extendedprice > 0 AND NOT (l_quantity < 5 AND l_extendedprice > 100)")
def _(t: Tables) -> DataFrame:
    own = {"vendor": c("l_returnflag"), "pickup_datetime": c("l_shipdate").cast("timestamp"), "passenger_count": c("l_linenumber"), "trip_distance": c("l_quantity"), "tolls_amount": c("l_tax"), "total_amount": c("l_extendedprice")}
    rows = t.lineitem.select(*[own.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in files.TAXI])
    trips = files.read_taxi(t.spark, _land(t, rows, "csv", header="true"))
    store = _store(t)
    store.create("bronze", P.add_metadata(trips, "files", "bronze"))
    store.create("silver", P.drop_anomalies(P.taxi_flags(store.read("bronze"), "passenger_count", "trip_distance", "tolls_amount"), "trip_distance", "total_amount"))
    one = P.optional_equals(store.read("silver"), "vendor", "A")
    store.create("gold", one.agg(F.count(F.lit(1)).alias("n_rows"), A.money_sum(c("total_amount")).alias("total_amount"), F.round(F.avg("total_amount"), 4).alias("avg_amount"), A.count_where(c("passenger_type") == "multi").alias("multi"), A.count_where(c("has_tolls")).alias("with_tolls")))
    return store.read("gold")


@query("chain_configured", f"SELECT upper(p_brand) AS p_brand, sum(p_retailprice::{MONEY})::DOUBLE AS p_retailprice_sum, count(p_partkey) AS p_partkey_count, 'gold' AS _data_layer, count(*) AS n FROM part WHERE p_size > 5 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    name = _name(t, "shop")
    m = medallion.Medallion(t.spark, medallion.Naming(name, "test"))
    path = _land(t, t.part.select("p_partkey", "p_brand", "p_size", c("p_retailprice").cast("decimal(18,2)").alias("p_retailprice")), "parquet")
    m.run("parts", path, medallion.Silver(nulls={"p_size": "fill_default"}, filters={"p_size": {"greater_than": 5}}, keys=["p_partkey"], order_by=["p_size"]), medallion.Gold(["p_brand"], {"p_retailprice": "sum", "p_partkey": ["count"]}))
    gold = t.spark.table(m.naming.table("parts", "gold"))
    return gold.select("p_brand", c("p_retailprice_sum").cast("double").alias("p_retailprice_sum"), "p_partkey_count", "_data_layer", c("p_partkey_count").alias("n"))


@query("medallion_layers", "SELECT 'bronze' AS layer, count(*) AS row_count FROM nation UNION ALL SELECT 'silver', count(*) FROM nation UNION ALL SELECT 'gold', count(DISTINCT n_regionkey) FROM nation")
def _(t: Tables) -> DataFrame:
    m = medallion.Medallion(t.spark, medallion.Naming(_name(t, "layers")))
    out = m.run("nation", f"{t.folder}/nation.parquet", medallion.Silver(), medallion.Gold(["n_regionkey"], {"n_nationkey": "count"}))
    return t.spark.createDataFrame([(k, out[k]["row_count"]) for k in ("bronze", "silver", "gold")], "layer string, row_count long")


@query("documented_medallion", f"SELECT event_type AS category, sum(value::{MONEY})::DOUBLE AS total, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def _(t: Tables) -> DataFrame:
    silver = t.events.withColumn("valid", P.flag(c("value").isNotNull())).filter(c("value").isNotNull())
    return silver.groupBy(c("event_type").alias("category")).agg(A.money_sum(c("value")).alias("total"), F.count(F.lit(1)).alias("n"))


# -- pipelines in SQL --------------------------------------------------------


def _orders_json(t: Tables) -> str:
    rows = t.orders.select(c("o_orderkey").alias("order_id"), c("o_custkey").alias("customer_id"), F.when(c("o_orderkey") % 2 == 0, "Y").otherwise("N").alias("notifications"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("ordered"))
    return _land(t, rows, "json")


_ORDERS_SQL = """
    CREATE OR REFRESH STREAMING TABLE orders_bronze COMMENT "as they come"
    AS SELECT *, current_timestamp() AS processed, _metadata.file_name AS source_file
    FROM cloud_files(${orders}, "json", map("cloudFiles.inferColumnTypes", "true"));
    CREATE OR REFRESH STREAMING TABLE orders_silver
      (CONSTRAINT valid_date EXPECT (order_timestamp > "1990-01-01") ON VIOLATION FAIL UPDATE)
      COMMENT "with times" TBLPROPERTIES ("quality" = "silver")
    AS SELECT CAST(ordered AS TIMESTAMP) AS order_timestamp, * EXCEPT (ordered, source_file) FROM STREAM(LIVE.orders_bronze);
    CREATE OR REFRESH LIVE TABLE orders_by_date
    AS SELECT date(order_timestamp) AS order_date, count(*) AS total_daily_orders FROM LIVE.orders_silver GROUP BY date(order_timestamp);
"""


@query("sql_stream_orders", "SELECT o_orderdate::DATE AS order_date, count(*) AS total_daily_orders FROM orders GROUP BY 1")
def _(t: Tables) -> DataFrame:
    p = declare(G.Pipeline(t.spark, workspace(t.spark)), _ORDERS_SQL, {"orders": _orders_json(t)})
    p.update()
    p.update()
    return p.read("orders_by_date")


_FEED_SQL = """
    CREATE OR REFRESH STREAMING TABLE customers_bronze AS SELECT * FROM STREAM read_files(${feed}, format => 'json', schema => 'customer_id BIGINT, name STRING, email STRING, operation STRING, seq BIGINT');
    CREATE STREAMING TABLE customers_clean (
      CONSTRAINT valid_id EXPECT (customer_id IS NOT NULL) ON VIOLATION FAIL UPDATE,
      CONSTRAINT valid_operation EXPECT (operation IS NOT NULL) ON VIOLATION DROP ROW,
      CONSTRAINT valid_name EXPECT (name IS NOT NULL OR operation = "DELETE"),
      CONSTRAINT valid_email EXPECT (rlike(email, '^[^@ ]+@[^@ ]+[.][a-z]+$') OR operation = "DELETE") ON VIOLATION DROP ROW)
    AS SELECT * FROM STREAM(LIVE.customers_bronze);
    CREATE OR REFRESH STREAMING TABLE customers_silver;
    APPLY CHANGES INTO LIVE.customers_silver FROM STREAM(LIVE.customers_clean) KEYS (customer_id)
      APPLY AS DELETE WHEN operation = "DELETE" SEQUENCE BY seq COLUMNS * EXCEPT (operation);
"""


def _feed_json(t: Tables) -> str:
    """A feed of customers: all are new, every fifth then moves, every seventh is deleted."""
    k, s = c("c_custkey"), c("c_custkey").cast("string")
    mail = lambda at: F.concat(F.lit("u"), s, F.lit(at))
    row = lambda name, email, op, seq: t.customer.select(k.alias("customer_id"), name.alias("name"), email.alias("email"), F.lit(op).alias("operation"), F.lit(seq).cast("long").alias("seq"))
    new = row(c("c_name"), F.when(k % 11 == 0, F.lit("bad")).otherwise(mail("@old.example")), "NEW", 1)
    moved = row(c("c_name"), mail("@new.example"), "UPDATE", 2).filter("customer_id % 5 = 0")
    gone = row(F.lit(None).cast("string"), F.lit(None).cast("string"), "DELETE", 3).filter("customer_id % 7 = 0")
    return _land(t, new.unionAll(moved).unionAll(gone), "json")


_CUSTOMERS = "(SELECT c_custkey AS customer_id, c_name AS name, 'u' || c_custkey || CASE WHEN c_custkey % 5 = 0 THEN '@new.example' ELSE '@old.example' END AS email, CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE 1 END::BIGINT AS seq FROM customer WHERE c_custkey % 7 <> 0 AND (c_custkey % 11 <> 0 OR c_custkey % 5 = 0)) cs"


@query("sql_cdc_customers", f"SELECT * FROM {_CUSTOMERS}")
def _(t: Tables) -> DataFrame:
    p = declare(G.Pipeline(t.spark, workspace(t.spark)), _FEED_SQL, {"feed": _feed_json(t)})
    p.update()
    return p.read("customers_silver")


@query("sql_stream_static_join", f"SELECT customer_id, o_orderkey AS order_id, email FROM orders JOIN {_CUSTOMERS} ON customer_id = o_custkey WHERE o_orderkey % 2 = 0")
def _(t: Tables) -> DataFrame:
    script = f"""{_ORDERS_SQL}{_FEED_SQL}
        CREATE LIVE VIEW subscribed_v AS SELECT a.customer_id, a.order_id, b.email FROM LIVE.orders_silver a INNER JOIN LIVE.customers_silver b ON a.customer_id = b.customer_id WHERE notifications = 'Y';
        CREATE OR REFRESH MATERIALIZED VIEW subscribed AS SELECT * FROM LIVE.subscribed_v;"""
    p = declare(G.Pipeline(t.spark, workspace(t.spark)), script, {"orders": _orders_json(t), "feed": _feed_json(t)})
    p.update()
    return p.read("subscribed")


@query("sql_expectation_metrics", "SELECT 'customers_clean' AS dataset, name, passing_records, failing_records FROM (SELECT 'valid_id' AS name, n AS passing_records, 0::BIGINT AS failing_records FROM x UNION ALL SELECT 'valid_operation', n, 0 FROM x UNION ALL SELECT 'valid_name', n, 0 FROM x UNION ALL SELECT 'valid_email', n - bad, bad FROM x) CROSS JOIN (SELECT 1)".replace("FROM x", "FROM (SELECT (count(*) + count(CASE WHEN c_custkey % 5 = 0 THEN 1 END) + count(CASE WHEN c_custkey % 7 = 0 THEN 1 END))::BIGINT AS n, count(CASE WHEN c_custkey % 11 = 0 THEN 1 END) AS bad FROM customer) x"))
def _(t: Tables) -> DataFrame:
    p = declare(G.Pipeline(t.spark, workspace(t.spark)), _FEED_SQL, {"feed": _feed_json(t)})
    p.update()
    return G.quality_from_log(p.event_log()).filter("dataset = 'customers_clean'")


@query("pipeline_validate", "SELECT * FROM (VALUES ('orders_by_date', 'order_date,total_daily_orders'), ('orders_silver', 'customer_id,notifications,order_id,order_timestamp,processed')) v(dataset, columns)")
def _(t: Tables) -> DataFrame:
    p = declare(G.Pipeline(t.spark, workspace(t.spark)), _ORDERS_SQL, {"orders": _orders_json(t)})
    found = p.validate()  # before any update
    return t.spark.createDataFrame([(n, ",".join(sorted(found[n]))) for n in ("orders_by_date", "orders_silver")], "dataset string, columns string")


@query("pipeline_comments", "SELECT * FROM (VALUES ('orders_bronze', 'streaming_table', 'as they come', '{}'), ('orders_by_date', 'materialized_view', '', '{}'), ('orders_silver', 'streaming_table', 'with times', '{\"quality\": \"silver\"}')) v(name, kind, comment, properties)")
def _(t: Tables) -> DataFrame:
    p = declare(G.Pipeline(t.spark, workspace(t.spark)), _ORDERS_SQL, {"orders": _orders_json(t)})
    p.update()
    return p.describe()


def _counted(t: Tables) -> tuple[G.Pipeline, str]:
    """A pipeline over events as they land."""
    p = G.Pipeline(t.spark, workspace(t.spark))
    path, schema = f"{p.root}/landing", t.events.schema

    @p.streaming_table("raw")
    def raw(p):
        return p.spark.readStream.schema(schema).parquet(path)

    @p.temporary_view("large", reads=("raw",))
    def large(p):
        return p.read("raw").filter("value > 10")

    @p.materialized_view("by_type", reads=("large",))
    def by_type(p):
        return p.read("large").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))

    return p, path


_BY_TYPE = "SELECT event_type, count(*) AS n FROM events WHERE value > 10 GROUP BY 1"


@query("pipeline_view", _BY_TYPE)
def _(t: Tables) -> DataFrame:
    p, path = _counted(t)
    t.events.write.parquet(path)
    p.update()
    return p.read("by_type")


@query("pipeline_empty_source", _BY_TYPE)
def _(t: Tables) -> DataFrame:
    p, path = _counted(t)
    p.store._fs.mkdirs(p.store._path(path))
    p.update()  # nothing has landed yet
    t.events.write.mode("append").parquet(path)
    p.update()
    return p.read("by_type")


@query("pipeline_full_refresh", _BY_TYPE)
def _(t: Tables) -> DataFrame:
    p, path = _counted(t)
    t.events.write.parquet(path)
    p.update()
    p.update(full_refresh=True)
    return p.read("by_type")


@query("pipeline_continuous", "SELECT event_id, event_type FROM events")
def _(t: Tables) -> DataFrame:
    p, path = _counted(t)
    t.events.filter("event_id % 2 = 0").write.parquet(path)
    p.update(continuous="0 seconds")
    t.events.filter("event_id % 2 = 1").write.mode("append").parquet(path)  # while it runs
    p.stop()
    return p.read("raw").select("event_id", "event_type")


# -- jobs and reports --------------------------------------------------------


@query("job_graph", "SELECT * FROM (VALUES ('load', 'success', '5'), ('check', 'failed', NULL), ('publish', 'skipped', NULL), ('alarm', 'success', 'told'), ('child', 'success', '{\"count\": 25}')) v(task, status, value)")
def _(t: Tables) -> DataFrame:
    def broken(p, v):
        raise RuntimeError("no")

    inner = jobs.Job("inner", [jobs.Task("count", lambda p, v: t.nation.count() * p["factor"])], {"factor": 1})
    job = jobs.Job("outer", [jobs.Task("load", lambda p, v: t.region.count()), jobs.Task("check", broken, ("load",)), jobs.Task("publish", lambda p, v: 1, ("check",)), jobs.Task("alarm", lambda p, v: "told", ("check",), run_if="at_least_one_failed"), inner.as_task("child", depends_on=("load",))])
    run = job.run(workers=2)
    show = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
    return t.spark.createDataFrame([(n, run.status[n], show(run.values.get(n))) for n in job.order], "task string, status string, value string")


@query("job_schedule", "SELECT * FROM (VALUES ('2024-01-01 06:00'), ('2024-01-02 06:00'), ('2024-01-03 06:00')) v(ran_at)")
def _(t: Tables) -> DataFrame:
    now = [dt.datetime(2023, 12, 31, 12)]  # Sunday
    ran: list[tuple[str]] = []

    def sleep(seconds: float) -> None:
        now[0] += dt.timedelta(seconds=seconds)

    job = jobs.Job("daily", [jobs.Task("note", lambda p, v: ran.append((now[0].strftime("%Y-%m-%d %H:%M"),)))])
    jobs.Schedule(job, cron="0 6 * * 1-5", clock=lambda: now[0], sleep=sleep).run(3)
    return t.spark.createDataFrame(ran, "ran_at string")


@query("chart_suggestions", "SELECT * FROM (VALUES ('o_custkey', 'numeric'), ('o_orderdate', 'date'), ('o_orderkey', 'numeric'), ('o_orderpriority', 'category'), ('o_orderstatus', 'category'), ('o_totalprice', 'numeric')) v(column_name, kind)")
def _(t: Tables) -> DataFrame:
    return R.charts(t.orders)


@query("chart_scatter", "SELECT p_size, p_retailprice FROM part ORDER BY p_size, p_retailprice LIMIT 1000")
def _(t: Tables) -> DataFrame:
    return R.scatter(t.part, "p_size", "p_retailprice")


def _bills(t: Tables) -> DataFrame:
    credit = F.array(F.struct(F.lit("DISCOUNT").alias("type"), (-c("o_orderkey") % 7).cast("decimal(18,2)").alias("amount")))
    return t.orders.select(c("o_orderpriority").alias("service"), c("o_orderdate").alias("used_at"), c("o_totalprice").alias("cost"), credit.alias("credits"))


@query("billing_service_30d", f"SELECT o_orderdate::DATE AS day, sum(o_totalprice::{MONEY})::DOUBLE AS gross_cost, sum((-o_orderkey % 7)::{MONEY})::DOUBLE AS discount, sum((-o_orderkey % 7)::{MONEY})::DOUBLE AS all_credits, sum(o_totalprice::{MONEY} + (-o_orderkey % 7)::{MONEY})::DOUBLE AS net_cost FROM orders WHERE o_orderpriority = (SELECT min(o_orderpriority) FROM orders) AND o_orderdate::DATE >= DATE '1997-06-01' GROUP BY 1")
def _(t: Tables) -> DataFrame:
    first = t.orders.agg(F.min("o_orderpriority")).first()[0]
    return R.daily_cost(_bills(t), first, "used_at", "cost", "credits", since="1997-06-01")


@query("billing_current_month", f"SELECT o_orderpriority AS service, sum(o_totalprice::{MONEY})::DOUBLE AS total_cost FROM orders WHERE date_trunc('month', o_orderdate) = TIMESTAMP '1996-03-01' GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return R.current_month(_bills(t), "service", "used_at", "cost", "1996-03-15")
