"""SQL scripts on versioned tables and pipelines, and what tables and jobs guarantee."""

import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from terrace.functions import scalars as S
from terrace.operators import aggregates, governance, quality, transforms
from terrace.operators.tablestore import CommitConflict, Entry, TableStore, merged
from terrace.plans import sqlrunner
from terrace.plans.sqltables import SqlTables, bind, declare, masked, split_list
from terrace.sources import files
from terrace.streaming import pipeline as G
from terrace.streaming.jobs import Job, Schedule, Task, cron_times

c = F.col


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path / "store"))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_statements_keep_hints_and_see_queries():
    assert sqlrunner.split("SELECT /*+ BROADCAST(a) */ 1 /* gone */; -- x") == ["SELECT /*+ BROADCAST(a) */ 1"]
    assert sqlrunner.is_query("(SELECT 1) UNION ALL SELECT 2") and sqlrunner.is_query("SELECT(1)") and not sqlrunner.is_query("UPDATE t SET a = 1")
    assert split_list("a, f(b, c), 'd, e'") == ["a", "f(b, c)", "'d, e'"]
    assert masked("a 'b.c' \"d\"") == "a '   ' \" \""


def test_names_in_quotes_are_not_bound(spark):
    seen = []

    def resolve(name, stream, version, moment):
        seen.append((name, stream, version, moment))
        return spark.range(1) if name == "t" else None

    out = bind("SELECT 'FROM t' AS a, x.id FROM t VERSION AS OF 3 x JOIN other o ON x.id = o.id WHERE b = 'JOIN t'", resolve)
    assert seen == [("t", False, "3", None), ("other", False, None, None)] and "'FROM t'" in out and "JOIN other o" in out


def test_script(spark, store):
    sql = SqlTables(store)
    sql.run("""
        CREATE TABLE people (id INT, name STRING COMMENT 'as told', born DATE, age INT GENERATED ALWAYS AS (year(born) - 1900), CONSTRAINT some CHECK (id > 0)) COMMENT 'all; people';
        INSERT INTO people VALUES (1, 'Ada', DATE '1915-12-10'), (2, 'Bo; b', DATE '1950-01-02');
        INSERT INTO people (born, id, name) SELECT DATE '1999-09-09', 3, 'Cy'""")
    assert rows(sql.run("SELECT id, name, age FROM people")) == [(1, "Ada", 15), (2, "Bo; b", 50), (3, "Cy", 99)]
    with pytest.raises(ValueError, match="some"):
        sql.run("INSERT INTO people VALUES (0, 'x', DATE '2000-01-01')")
    assert {r.column_name: r.comment for r in sql.run("DESCRIBE people").collect()}["name"] == "as told"
    assert sql.run("SHOW TABLES").first().comment == "all; people"
    sql.run("UPDATE people SET name = concat(name, '!'), born = born WHERE id >= 2; DELETE FROM people WHERE name = 'Bo; b!'")
    assert rows(sql.run("SELECT p.name FROM people p WHERE p.id > 1")) == [("Cy!",)]
    assert sql.run("SELECT * FROM people VERSION AS OF 1").count() == 2
    with pytest.raises(FileExistsError):
        sql.run("CREATE TABLE people AS SELECT 1 AS a")
    sql.run("CREATE OR REPLACE TABLE copy DEEP CLONE people VERSION AS OF 1; INSERT OVERWRITE copy SELECT id, name, born, age FROM people WHERE id = 1")
    assert rows(sql.run("SELECT id FROM copy")) == [(1,)]
    sql.run("ALTER TABLE copy ADD CONSTRAINT one CHECK (id = 1); VACUUM copy RETAIN 1 VERSIONS; DROP TABLE IF EXISTS gone; DROP TABLE copy")
    with pytest.raises(KeyError):
        sql.run("DROP TABLE copy")


def test_merge_statement(spark, store):
    sql = SqlTables(store)
    sql.run("""
        CREATE TABLE t AS SELECT * FROM VALUES (1, 'a', 1.0D), (2, 'b', 2.0D), (3, 'c', 3.0D) AS v(k, name, n);
        MERGE INTO t AS target USING (SELECT * FROM VALUES (2, 'x', 5.0D), (3, 'delete me; now', 0.0D), (4, 'y', 6.0D), (NULL, 'z', 7.0D) AS v(k, name, n)) AS source
        ON target.k = source.k
        WHEN MATCHED AND source.name LIKE 'delete%;%' THEN DELETE
        WHEN MATCHED AND source.n > target.n THEN UPDATE SET n = target.n + source.n
        WHEN NOT MATCHED THEN INSERT *""")
    assert sorted(((r.k or 0), r.name, r.n) for r in sql.run("SELECT * FROM t").collect()) == [(0, "z", 7.0), (1, "a", 1.0), (2, "b", 7.0), (4, "y", 6.0)]
    with pytest.raises(ValueError, match="equal columns"):
        sql.run("MERGE INTO t USING t s ON t.k > s.k WHEN MATCHED THEN DELETE")


def test_copy_into_with_options(spark, store, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    (land / "a.csv").write_text("id|name\n1|x\n")
    sql = SqlTables(store)
    script = f"COPY INTO t FROM '{land}' FILEFORMAT = CSV FORMAT_OPTIONS ('header' = 'true', 'delimiter' = '|', 'inferSchema' = 'true') COPY_OPTIONS ('mergeSchema' = 'true')"
    sql.run(script)
    sql.run(script)
    (land / "b.csv").write_text("id|name\n2|y\n")
    sql.run(script)
    assert rows(sql.run("SELECT id, name FROM t")) == [(1, "x"), (2, "y")]


def test_merge_semantics(spark):
    t = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    s = spark.createDataFrame([(None, "p"), (None, "q"), (7, "r"), (7, "s"), (1, "b")], "k int, v string")
    assert sorted((r.k or 0, r.v) for r in merged(t, s, ["k"]).collect()) == [(0, "n"), (0, "p"), (0, "q"), (1, "b"), (7, "r"), (7, "s")]
    assert sorted((r.k or 0, r.v) for r in merged(t, s.union(s), ["k"], matched=None, insert_if=c("s.k") > 1).collect()) == [(0, "n"), (1, "a"), *[(7, x) for x in "rrss"]]


def test_changes_rewrite_touched_files_only(spark, store):
    store.create("t", spark.range(100).withColumn("v", c("id") * 2))
    store.optimize("t", ["id"], partitions=5)
    names = lambda: {f.rsplit("/", 1)[1] for x in store._files(store.entry("t")).values() for f in x}
    first = names()
    store.update("t", c("id") == 3, {"v": F.lit(-1).cast("long")})
    second = names()
    assert len(first & second) == 4
    store.delete("t", c("id") == 99)
    third = names()
    assert len(second & third) == 4 and store.read("t").count() == 99
    store.merge("t", spark.createDataFrame([(50, 7), (200, 8)], "id long, v long"), ["id"])
    assert len(third & names()) == 4 and store.read("t").count() == 100
    same = names()
    store.delete("t", c("id") == 12345)
    store.merge("t", spark.createDataFrame([(300, 1)], "id long, v long"), ["id"], matched=None)
    assert same < names() and {r.id: r.v for r in store.read("t").collect()}[3] == -1


def test_log_survives_writers_that_die(spark, store):
    store.create("t", spark.range(2))
    store._put(f"{store.root}/t/_log/1.lock", "x", False)
    store._put(f"{store.root}/t/_log/1.abc.tmp", "{", False)
    assert store.version("t") == 0 and store.read("t").count() == 2
    with pytest.raises(CommitConflict):
        store.delete("t")
    store._fs.setTimes(store._path(f"{store.root}/t/_log/1.lock"), int((time.time() - 3600) * 1000), -1)
    assert store.delete("t") == 1
    with pytest.raises(KeyError):
        store.entry("t", 9)
    assert Entry(**json.loads(json.dumps({"version": 3}))).version == 3


def test_clones_and_vacuum(spark, store):
    store.create("t", spark.range(3))
    store.clone("t", "c")
    store.delete("t", c("id") == 0)
    assert store.vacuum("t") == 0 and store.read("c").count() == 3  # the clone still needs the first folder
    store.drop("t")
    assert not store.exists("t") and store.read("c").count() == 3 and store.tables() == ["c"]
    with pytest.raises(KeyError):
        store.read("c", as_of=0)


def test_z_order_keeps_near_values_together(spark, store):
    store.create("t", spark.range(4000).select((c("id") % 64).alias("x"), F.floor(c("id") / 64).alias("y")))
    store.optimize("t", zorder_by=["x", "y"], partitions=16)
    spans = store._with_file(store.entry("t")).groupBy("_file").agg((F.max("x") - F.min("x")).alias("x"), (F.max("y") - F.min("y")).alias("y")).collect()
    assert sum(r.x < 48 and r.y < 48 for r in spans) >= 12


def test_declared_pipeline(spark, tmp_path):
    land = str(tmp_path / "land")
    spark.createDataFrame([(1, 2.0, "x*y"), (2, -1.0, "b"), (3, None, "c")], "id int, v double, s string").write.json(land)
    p = declare(
        G.Pipeline(spark, str(tmp_path / "p")),
        """
        CREATE OR REFRESH STREAMING TABLE raw COMMENT 'it''s; raw' AS SELECT *, id * 2 AS twice, _metadata.file_size > 0 AS sized FROM STREAM read_files(${land}, format => 'json');
        CREATE OR REFRESH STREAMING TABLE good (CONSTRAINT positive EXPECT (v > 0 AND s LIKE '%*%') ON VIOLATION DROP ROW, CONSTRAINT known EXPECT (id IS NOT NULL)) TBLPROPERTIES ('a' = 'b') AS SELECT * EXCEPT (sized) FROM STREAM(LIVE.raw);
        CREATE TEMPORARY LIVE VIEW some AS SELECT * FROM LIVE.good WHERE id < 10;
        CREATE OR REFRESH MATERIALIZED VIEW total AS SELECT count(*) AS n FROM (SELECT * FROM LIVE.some) x;
        """,
        {"land": land},
    )
    assert p.order() == ["raw", "good", "some", "total"] and p.validate()["raw"] == ["id", "s", "v", "twice", "sized"]
    p.update()
    assert p.read("total").first().n == 1 and rows(p.read("good").select("id", "twice")) == [(1, 2)]
    assert {r.name: r.comment for r in p.describe().collect()}["raw"] == "it's; raw"
    log = p.event_log()
    assert log.select("update_id").distinct().count() == 1 and len(log.inputFiles()) == 1
    with pytest.raises(ValueError):
        declare(p, "DROP TABLE x")


def test_equal_sequences_do_not_depend_on_batches(spark, tmp_path):
    schema, found = "id int, v string, seq int", []
    for k, batches in enumerate(([[(1, "a", 1)], [(1, "b", 1)]], [[(1, "b", 1)], [(1, "a", 1)]], [[(1, "a", 1), (1, "b", 1)]])):
        land, p = str(tmp_path / f"land{k}"), G.Pipeline(spark, str(tmp_path / f"p{k}"))
        p.streaming_table("feed")(lambda p, land=land: p.spark.readStream.schema(schema).parquet(land))
        p.changes("t", "feed", ["id"], ["seq"])
        for b in batches:
            spark.createDataFrame(b, schema).write.mode("append").parquet(land)
            p.update()
        found.append(rows(p.read("t")))
    assert found[0] == found[1] == found[2]


def test_schedules():
    at = lambda *x: dt.datetime(*x)
    times = cron_times("*/30 8-9 * * 1,3", at(2024, 1, 1, 8, 10))  # a Monday
    assert [next(times) for _ in range(4)] == [at(2024, 1, 1, 8, 30), at(2024, 1, 1, 9, 0), at(2024, 1, 1, 9, 30), at(2024, 1, 3, 8, 0)]
    listing, seen = [{"a"}, {"a"}, {"a", "b"}, {"a", "b", "c"}], []
    job = Job("j", [Task("t", lambda p, v: seen.append(p["new_files"]))])
    Schedule(job, files=lambda: listing.pop(0) if len(listing) > 1 else listing[0], sleep=lambda s: None).run(2)
    assert seen == [["b"], ["c"]]
    order = []
    both = Job("k", [Task("a", lambda p, v: order.append("a")), Task("b", lambda p, v: order.append("b")), Task("c", lambda p, v: order.append("c"), ("a", "b"))])
    both.run(workers=2)
    assert sorted(order[:2]) == ["a", "b"] and order[2] == "c"
    assert [r.status["t"] for r in Schedule(Job("x", [Task("t", lambda p, v: 1)])).run(2)] == ["success"] * 2


def test_schema_location_outlives_files(spark, tmp_path):
    land, home = tmp_path / "land", str(tmp_path / "home")
    land.mkdir()
    (land / "a.json").write_text('{"a": 1}\n')
    first = files.stream_files(spark, str(land), "json", schema_location=home)
    (land / "a.json").write_text('{"b": "x"}\n')
    assert files.stream_files(spark, str(land), "json", schema_location=home).columns == first.columns == ["a"]
    assert dict(files.stream_files(spark, str(land), "json", infer_types=False).dtypes) == {"b": "string"}


def test_layers_and_reconciliation(spark):
    df = spark.createDataFrame([(1, None), (2, 1.0)], "k int, v double")
    found, mean = quality.validate_layers({"bronze": df, "gold": df})
    assert [v.score for v in found] == [100, 90] and mean == 95
    none, empty = quality.validate_layers({})
    assert none == [] and empty == 0
    assert quality.metric_consistency(spark.createDataFrame([(3.0, 1.0, 2.0), (None, 1.0, 2.0), (3.0, None, 3.0)], "t double, a double, b double"), "t", ["a", "b"]).first()[:] == (3, 1)
    assert rows(quality.profile(df, approximate=True).select("column_name", "distinct_count")) == [("k", 2), ("v", 1)]
    assert rows(quality.profile(df.limit(0)).select("column_name", "total_rows", "distinct_count")) == [("k", 0, 0), ("v", 0, 0)]
    assert aggregates.distinct_counts(df, ["k", "v"]).first()[:] == (2, 1)


def test_dedup_by_names_agrees_with_windows(spark):
    df = spark.createDataFrame([(1, 3, None), (1, None, "b"), (1, 3, "a"), (2, 5, "x"), (None, 1, "y"), (None, 2, "z")], "k int, n int, s string")
    for keep in ("first", "last"):
        by_name = transforms.deduplicate(df, ["k"], ["n", "s"], keep)
        by_window = transforms.deduplicate(df, ["k"], [c("n"), c("s")], keep)
        assert {tuple(r) for r in by_name.collect()} == {tuple(r) for r in by_window.collect()} and by_name.columns == df.columns
    assert transforms.deduplicate(df.select("k"), ["k"], ["k"]).count() == 3


def test_messages_and_function_catalogue(spark):
    df = spark.createDataFrame([("a", 10.0), ("b", None), (None, 3.0)], "s string, p double")
    rule = S.first_message([(c("s") == "a", "first"), (c("p") > 1, F.concat(F.lit("costs "), S.sale_price(c("p"))))], "none")
    assert [r[0] for r in df.select(rule).collect()] == ["first", "none", "costs 2"]
    S.register(spark)
    assert spark.sql("SELECT calculate_percentage(-1D, 3D, 1), calculate_percentage(2D, 3D), sale_price(10D, 0.25D)").first()[:] == (-33.3, 66.67, "3")
    assert governance.list_tables(spark, max_tables=0).count() == 0
