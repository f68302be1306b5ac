"""Queries over versioned tables, governance, SQL files and declarative pipelines."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.operators import governance as H
from terrace.operators.tablestore import TableStore, merged
from terrace.operators.transforms import latest_by_key
from terrace.plans import sqlrunner
from terrace.plans.catalogue import Tables, query
from terrace.streaming import pipeline as G

c = F.col


def workspace(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        base = tempfile.mkdtemp(prefix="terrace-")
    return f"{base.rstrip('/')}/work-{uuid.uuid4().hex[:12]}"


def _store(t: Tables) -> TableStore:
    return TableStore(t.spark, workspace(t.spark))


def _orders(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")


# all orders, and changes to all of them, every second of which has a key that is new
_TARGET = "(SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders)"
_SOURCE = "(SELECT o_orderkey + CASE WHEN o_orderkey % 2 = 0 THEN 1000000000 ELSE 0 END AS o_orderkey, 'N' AS o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders)"
_FULL = f"FROM {_TARGET} t FULL JOIN {_SOURCE} s ON t.o_orderkey = s.o_orderkey"


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    o = _orders(t)
    key = (c("o_orderkey") + F.when(c("o_orderkey") % 2 == 0, 1000000000).otherwise(0)).alias("o_orderkey")
    return o, o.select(key, F.lit("N").alias("o_orderstatus"), (c("o_totalprice") + 1).alias("o_totalprice"))


@query("merge_upsert", f"SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey, coalesce(s.o_orderstatus, t.o_orderstatus) AS o_orderstatus, coalesce(s.o_totalprice, t.o_totalprice) AS o_totalprice {_FULL}")
def _(t: Tables) -> DataFrame:
    target, source = _sides(t)
    store = _store(t)
    store.create("orders", target)
    store.merge("orders", source, ["o_orderkey"])
    return store.read("orders")


@query("merge_insert_only", f"SELECT coalesce(t.o_orderkey, s.o_orderkey) AS o_orderkey, coalesce(t.o_orderstatus, s.o_orderstatus) AS o_orderstatus, coalesce(t.o_totalprice, s.o_totalprice) AS o_totalprice {_FULL} WHERE t.o_orderkey IS NOT NULL OR s.o_totalprice > 1000")
def _(t: Tables) -> DataFrame:
    return merged(*_sides(t), ["o_orderkey"], matched=None, insert_if=c("s.o_totalprice") > 1000)


@query("merge_full", f"SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey, coalesce(s.o_orderstatus, t.o_orderstatus) AS o_orderstatus, coalesce(s.o_totalprice, t.o_totalprice) AS o_totalprice {_FULL} WHERE NOT (t.o_orderkey IS NOT NULL AND s.o_orderkey IS NOT NULL AND s.o_orderkey % 5 = 0)")
def _(t: Tables) -> DataFrame:
    return merged(*_sides(t), ["o_orderkey"], delete_if=c("s.o_orderkey") % 5 == 0)


@query("merge_accumulate", f"SELECT coalesce(t.o_orderkey, s.o_orderkey) AS o_orderkey, coalesce(t.o_orderstatus, s.o_orderstatus) AS o_orderstatus, round(CASE WHEN t.o_orderkey IS NULL THEN s.o_totalprice WHEN s.o_orderkey IS NULL THEN t.o_totalprice ELSE t.o_totalprice + s.o_totalprice END, 2) AS o_totalprice {_FULL} WHERE t.o_orderkey IS NOT NULL OR s.o_totalprice > 500")
def _(t: Tables) -> DataFrame:
    out = merged(*_sides(t), ["o_orderkey"], matched={"o_totalprice": c("t.o_totalprice") + c("s.o_totalprice")}, insert_if=c("s.o_totalprice") > 500)
    return out.withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("merge_incremental", """
    WITH seen AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'), old AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM seen) WHERE rn = 1),
    new AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) FROM old)) WHERE rn = 1)
    SELECT * FROM new UNION ALL SELECT * FROM old WHERE o_custkey NOT IN (SELECT o_custkey FROM new)""")
def _(t: Tables) -> DataFrame:
    newest = lambda df: latest_by_key(df, ["o_custkey"], "o_orderdate", ["o_orderkey"])
    old = newest(t.orders.filter(c("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")))
    mark = old.agg(F.max("o_orderdate").alias("mark"))
    new = newest(t.orders.join(F.broadcast(mark), c("o_orderdate") > c("mark")).drop("mark"))  # the mark is one row
    return merged(old, new, ["o_custkey"])


@query("update_where", "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice * 2, 2) ELSE o_totalprice END AS o_totalprice FROM orders")
def _(t: Tables) -> DataFrame:
    store = _store(t)
    store.create("orders", _orders(t))
    store.update("orders", c("o_orderstatus") == "F", {"o_totalprice": F.round(c("o_totalprice") * 2, 2)})
    return store.read("orders")


@query("delete_where", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE NOT coalesce(CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END < 50000, false)")
def _(t: Tables) -> DataFrame:
    store = _store(t)
    store.create("orders", _orders(t))
    store.delete("orders", F.when(c("o_orderkey") % 7 != 0, c("o_totalprice")) < 50000)
    return store.read("orders")


@query("insert_append", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders UNION ALL SELECT -1, 'X', 0.5")
def _(t: Tables) -> DataFrame:
    store = _store(t)
    store.create("orders", _orders(t))
    store.append("orders", t.spark.createDataFrame([(-1, "X", 0.5)], "o_orderkey long, o_orderstatus string, o_totalprice double"))
    return store.read("orders")


@query("insert_overwrite", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'P'")
def _(t: Tables) -> DataFrame:
    store = _store(t)
    store.create("orders", _orders(t))
    store.overwrite("orders", store.read("orders").filter("o_orderstatus = 'P'"))
    return store.read("orders")


@query("time_travel", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def _(t: Tables) -> DataFrame:
    store = _store(t)
    store.create("orders", _orders(t))
    store.delete("orders", c("o_orderstatus") == "O")
    return store.read("orders", version=0)


@query("restore", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def _(t: Tables) -> DataFrame:
    store = _store(t)
    store.create("orders", _orders(t))
    store.delete("orders")
    store.restore("orders", 0)
    return store.read("orders")


@query("history", "SELECT * FROM (VALUES (0::BIGINT, 'CREATE'), (1::BIGINT, 'UPDATE'), (2::BIGINT, 'DELETE'), (3::BIGINT, 'RESTORE')) h(version, operation)")
def _(t: Tables) -> DataFrame:
    store = _store(t)
    store.create("r", t.region)
    store.update("r", c("r_regionkey") == 1, {"r_name": F.lit("x")})
    store.delete("r", c("r_regionkey") == 2)
    store.restore("r", 0)
    return store.history("r").select("version", "operation")


@query("clone", "SELECT r_regionkey, r_name, 'deep' AS kind FROM region UNION ALL SELECT r_regionkey, r_name, 'shallow' FROM region")
def _(t: Tables) -> DataFrame:
    store = _store(t)
    store.create("r", t.region)
    store.clone("r", "deep", deep=True)
    store.clone("r", "shallow")
    store.delete("r")
    return store.read("deep").withColumn("kind", F.lit("deep")).unionAll(store.read("shallow").withColumn("kind", F.lit("shallow")))


@query("optimize_clustered", "SELECT p_partkey, p_brand FROM part")
def _(t: Tables) -> DataFrame:
    store = _store(t)
    store.create("part", t.part.select("p_partkey", "p_brand"))
    store.optimize("part", ["p_brand"])
    return store.read("part")


@query("retention_archive", "SELECT o_orderkey, o_orderdate, CASE WHEN o_orderdate < TIMESTAMP '1995-01-01' THEN 'archive' ELSE 'live' END AS place FROM orders")
def _(t: Tables) -> DataFrame:
    store = _store(t)
    store.create("orders", t.orders.select("o_orderkey", "o_orderdate"))
    store.retain("orders", "archive", c("o_orderdate") < F.lit("1995-01-01").cast("timestamp_ntz"))
    return store.read("orders").withColumn("place", F.lit("live")).unionAll(store.read("archive").withColumn("place", F.lit("archive")))


@query("generated_column", "SELECT o_orderkey, o_orderdate, o_orderdate::DATE AS day FROM orders")
def _(t: Tables) -> DataFrame:
    store = _store(t)
    store.create("orders", t.orders.select("o_orderkey", "o_orderdate"), constraints={"recent": "day > DATE '1900-01-01'"}, generated={"day": "to_date(o_orderdate)"})
    return store.read("orders")


@query("copy_into", "SELECT event_id, event_type FROM events")
def _(t: Tables) -> DataFrame:
    store = _store(t)
    drop = f"{store.root}/landing"
    t.events.select("event_id", "event_type").write.parquet(drop)
    for _ in range(2):  # the second finds nothing new
        store.copy_into("events", drop, "parquet", "event_id long, event_type string")
    return store.read("events")


# -- governance ------------------------------------------------------------

_ANALYST = H.Principal("ann", frozenset({"analysts"}))


@query("mask_column", "SELECT c_custkey, left(c_name, 2) || repeat('*', length(c_name) - 2) AS c_name, c_acctbal FROM customer")
def _(t: Tables) -> DataFrame:
    from terrace.functions.scalars import mask

    p = H.Policies()
    p.set_mask("customer", "c_name", lambda col, who: F.when(who.is_member("admins"), col).otherwise(mask(col)))
    return p.secure("customer", t.customer.select("c_custkey", "c_name", "c_acctbal"), _ANALYST)


@query("row_filter", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey < 10")
def _(t: Tables) -> DataFrame:
    p = H.Policies()
    p.set_row_filter("customer", lambda who: who.is_member("admins") | (c("c_nationkey") < 10))
    return p.secure("customer", t.customer.select("c_custkey", "c_nationkey"), _ANALYST)


@query("dynamic_view", "SELECT c_custkey, 'REDACTED' AS c_name, c_acctbal FROM customer WHERE c_acctbal < 5000")
def _(t: Tables) -> DataFrame:
    who = _ANALYST
    rows = t.customer.filter(F.when(who.is_member("admins"), True).otherwise(c("c_acctbal") < 5000))
    return rows.select("c_custkey", F.when(who.is_member("admins"), c("c_name")).otherwise("REDACTED").alias("c_name"), "c_acctbal")


@query("grants", "SELECT * FROM (VALUES ('SELECT', 'main.sales', 'analysts'), ('USE', 'main', 'analysts')) g(privilege, securable, principal)")
def _(t: Tables) -> DataFrame:
    p = H.Policies()
    p.grant("USE", "main", "analysts")
    p.grant("SELECT", "main.sales", "analysts")
    p.grant("MODIFY", "main.sales.orders", "bob")
    p.revoke("MODIFY", "main.sales.orders", "bob")
    return p.show_grants(t.spark)


@query("information_schema", "SELECT * FROM (VALUES ('terrace_nation', true), ('terrace_region', true)) t(table_name, is_temporary)")
def _(t: Tables) -> DataFrame:
    t.nation.createOrReplaceTempView("terrace_nation")
    t.region.createOrReplaceTempView("terrace_region")
    return H.list_tables(t.spark).select("table_name", "is_temporary").filter(c("table_name").isin("terrace_nation", "terrace_region"))


# -- SQL files -------------------------------------------------------------


@query("sql_file_pipeline", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 1000 AND o_orderpriority <> 'it''s;' GROUP BY 1")
def _(t: Tables) -> DataFrame:
    t.orders.createOrReplaceTempView("terrace_orders")
    steps = [sqlrunner.Step("silver", "-- valid orders; only\nSELECT * FROM ${source} WHERE o_totalprice > ${least} AND o_orderpriority <> ${text};", "view", "terrace_silver"), sqlrunner.Step("gold", "SELECT o_orderstatus, count(*) AS n FROM terrace_silver ${where} GROUP BY o_orderstatus")]
    values = {"source": sqlrunner.Identifier("terrace_orders"), "least": 1000, "text": "it's;", "where": sqlrunner.Fragment("")}
    return sqlrunner.SqlRunner(t.spark, values).run(steps)["gold"]


# -- declarative pipelines -------------------------------------------------


def _landed(t: Tables, p: G.Pipeline) -> str:
    """Events as files that land in two batches."""
    path = f"{p.root}/landing"
    t.events.filter("event_id % 2 = 0").write.parquet(path)
    t.events.filter("event_id % 2 = 1").write.mode("append").parquet(path)
    return path


def _pipeline(t: Tables) -> G.Pipeline:
    p = G.Pipeline(t.spark, workspace(t.spark))
    path = _landed(t, p)
    schema = t.events.schema

    @p.streaming_table("events_bronze", comment="raw events")
    def bronze(p):
        return p.spark.readStream.schema(schema).parquet(path)

    @p.streaming_table("events_silver", reads=("events_bronze",), expectations=[G.Expectation("has_user", "user_id IS NOT NULL", "fail"), G.Expectation("high", "value > 10", "drop"), G.Expectation("no_errors", "event_type <> 'error'")])
    def silver(p):
        return p.read_stream("LIVE.events_bronze")

    @p.materialized_view("events_by_type", reads=("events_silver",))
    def gold(p):
        return p.read("LIVE.events_silver").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))

    return p


@query("stream_bronze_silver", "SELECT event_id, user_id, event_type, value FROM events WHERE value > 10")
def _(t: Tables) -> DataFrame:
    p = _pipeline(t)
    p.update()
    p.update()  # finds nothing new
    return p.read("events_silver").select("event_id", "user_id", "event_type", "value")


@query("mv_events_by_type", "SELECT event_type, count(*) AS n FROM events WHERE value > 10 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    p = _pipeline(t)
    p.update()
    return p.read("events_by_type")


@query("expect_drop", "SELECT event_id FROM events WHERE coalesce(CASE WHEN event_id % 9 <> 0 THEN value END > 10, false)")
def _(t: Tables) -> DataFrame:
    rows = t.events.withColumn("value", F.when(c("event_id") % 9 != 0, c("value")))
    return G.drop_violations(rows, [G.Expectation("high", "value > 10", "drop")]).select("event_id")


@query("expect_warn_metrics", "SELECT 'events' AS dataset, 'high' AS name, count(CASE WHEN value > 10 THEN 1 END) AS passed_records, count(CASE WHEN NOT coalesce(value > 10, false) THEN 1 END) AS failed_records FROM events UNION ALL SELECT 'events', 'no_errors', count(CASE WHEN event_type <> 'error' THEN 1 END), count(CASE WHEN event_type = 'error' THEN 1 END) FROM events")
def _(t: Tables) -> DataFrame:
    return G.expectation_metrics(t.events, [G.Expectation("high", "value > 10"), G.Expectation("no_errors", "event_type <> 'error'")], "events")


@query("event_log_quality", "SELECT 'events_silver' AS dataset, name, passing_records, failing_records FROM (SELECT 'has_user' AS name, count(*) AS passing_records, 0::BIGINT AS failing_records FROM events UNION ALL SELECT 'high', count(CASE WHEN value > 10 THEN 1 END), count(CASE WHEN NOT value > 10 THEN 1 END) FROM events UNION ALL SELECT 'no_errors', count(CASE WHEN event_type <> 'error' THEN 1 END), count(CASE WHEN event_type = 'error' THEN 1 END) FROM events)")
def _(t: Tables) -> DataFrame:
    p = _pipeline(t)
    p.update()
    return G.quality_from_log(p.event_log())


@query("event_log_lineage", "SELECT * FROM (VALUES ('events_bronze', NULL), ('events_silver', 'events_bronze'), ('events_by_type', 'events_silver')) l(output_dataset, input_dataset)")
def _(t: Tables) -> DataFrame:
    p = _pipeline(t)
    p.update()
    return G.lineage_from_log(p.event_log())


_CDC = "(SELECT user_id AS customer_id, event_id AS seq, value, event_type AS operation FROM events)"


def _feed(t: Tables) -> DataFrame:
    return t.events.select(c("user_id").alias("customer_id"), c("event_id").alias("seq"), "value", c("event_type").alias("operation"))


@query("cdc_scd1", f"SELECT customer_id, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY seq DESC) AS rn FROM {_CDC}) WHERE rn = 1 AND operation <> 'error'")
def _(t: Tables) -> DataFrame:
    return G.apply_changes(_feed(t), ["customer_id"], ["seq"], "operation = 'error'", ["operation"])


@query("cdc_out_of_order", f"SELECT customer_id, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY seq DESC) AS rn FROM {_CDC}) WHERE rn = 1 AND operation <> 'error'")
def _(t: Tables) -> DataFrame:
    p = G.Pipeline(t.spark, workspace(t.spark))
    feed, path = _feed(t), f"{p.root}/landing"

    @p.streaming_table("feed")
    def raw(p):
        return p.spark.readStream.schema(feed.schema).parquet(path)

    p.changes("customers", "feed", ["customer_id"], ["seq"], "operation = 'error'", ["operation"])
    feed.filter("seq % 3 <> 0").write.parquet(path)
    p.update()
    feed.filter("seq % 3 = 0").write.mode("append").parquet(path)  # older and newer than what is there
    p.update()
    return p.read("customers")
