"""Declarative pipelines: streaming tables, materialized views, expectations, CDC, event log."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.operators.tablestore import TableStore


class ExpectationFailed(RuntimeError):
    """Rows break a FAIL expectation; nothing of the update was committed."""


@dataclass(frozen=True)
class Expectation:
    """Holds for a row only where its condition is true. on: warn, drop or fail."""

    name: str
    condition: str
    on: str = "warn"

    def __post_init__(self):
        if self.on not in ("warn", "drop", "fail"):
            raise ValueError(self.on)

    def holds(self) -> Column:
        return F.coalesce(F.expr(self.condition), F.lit(False))


def drop_violations(df: DataFrame, expectations: Sequence[Expectation]) -> DataFrame:
    for e in expectations:
        if e.on == "drop":
            df = df.filter(e.holds())
    return df


def expectation_metrics(df: DataFrame, expectations: Sequence[Expectation], dataset: str) -> DataFrame:
    """dataset, name, passed_records, failed_records: one aggregate for all."""
    rows = [F.struct(F.lit(dataset).alias("dataset"), F.lit(e.name).alias("name"), F.count(F.when(e.holds(), 1)).alias("passed_records"), F.count(F.when(~e.holds(), 1)).alias("failed_records")) for e in expectations]
    return df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def apply_changes(changes: DataFrame, keys: Sequence[str], sequence_by: Sequence[str], delete_when: str | None = None, except_columns: Sequence[str] = ()) -> DataFrame:
    """The last state of each key (SCD 1) of a whole change feed; keys whose last change deletes are gone."""
    return live(latest_changes(changes, keys, sequence_by, delete_when), except_columns)


def latest_changes(changes: DataFrame, keys: Sequence[str], sequence_by: Sequence[str], delete_when: str | None) -> DataFrame:
    """The last change of each key, with ``_seq`` and ``_deleted``; partly aggregated before the shuffle.

    Of changes with one sequence number, the one whose hash is greatest is
    last, however they are dealt out over batches.
    """
    gone = F.coalesce(F.expr(delete_when), F.lit(False)) if delete_when else F.lit(False)
    rows = changes.withColumns({"_deleted": gone, "_seq": F.struct(F.struct(*sequence_by).alias("at"), F.xxhash64(*changes.columns).alias("tie"))})
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_seq").alias("_last"))
    return last.select(*keys, "_last.*")


def live(state: DataFrame, except_columns: Sequence[str] = ()) -> DataFrame:
    return state.filter(~F.col("_deleted")).drop("_deleted", "_seq", *except_columns)


@dataclass
class Node:
    name: str
    kind: str  # streaming_table, materialized_view, view, changes
    query: Callable
    expectations: list[Expectation] = field(default_factory=list)
    comment: str = ""
    properties: dict[str, str] = field(default_factory=dict)
    reads: tuple[str, ...] = ()
    cdc: dict = field(default_factory=dict)


class Pipeline:
    """A graph of named datasets; ``update`` brings them up to date in order.

    Streaming nodes get ``read_stream(name)`` and process each input row once;
    views and materialized views get ``read(name)`` and are computed anew.
    """

    def __init__(self, spark: SparkSession, root: str, name: str = "pipeline"):
        self.spark, self.root, self.name = spark, root.rstrip("/"), name
        self.store = TableStore(spark, f"{self.root}/tables")
        self.nodes: dict[str, Node] = {}
        self.running: list = []
        self._events: list[dict] = []
        self._every: str | None = None

    def _add(self, kind: str, name: str | None, **more) -> Callable:
        def deco(f: Callable) -> Callable:
            label = name or f.__name__
            if label in self.nodes:
                raise ValueError(f"declared twice: {label}")
            self.nodes[label] = Node(label, kind, f, **more)
            return f

        return deco

    def streaming_table(self, name: str | None = None, **more) -> Callable:
        return self._add("streaming_table", name, **more)

    def materialized_view(self, name: str | None = None, **more) -> Callable:
        return self._add("materialized_view", name, **more)

    def temporary_view(self, name: str | None = None, **more) -> Callable:
        return self._add("view", name, **more)

    def changes(self, name: str, source: str, keys: Sequence[str], sequence_by: Sequence[str], delete_when: str | None = None, except_columns: Sequence[str] = (), **more) -> None:
        """APPLY CHANGES INTO: ``name`` follows the change feed of ``source``."""
        cdc = {"keys": list(keys), "sequence_by": list(sequence_by), "delete_when": delete_when, "except_columns": list(except_columns)}
        self._add("changes", name, reads=(source,), cdc=cdc, **more)(lambda p: p.read_stream(source))

    # -- reading -----------------------------------------------------------

    def read(self, name: str) -> DataFrame:
        node = self.nodes[name.removeprefix("LIVE.")]
        if node.kind == "view":
            return drop_violations(node.query(self), node.expectations)
        if node.kind == "changes":
            return live(self.store.read(node.name), node.cdc["except_columns"])
        if node.kind == "streaming_table":
            return self._landed(node, self.spark.read)
        return self.store.read(node.name)

    def _schema(self, node: Node) -> T.StructType:
        """The columns of a streaming table: what it wrote last, or what its query says."""
        path = f"{self.root}/streams/{node.name}.schema"
        if self.store._fs.exists(self.store._path(path)):
            return T.StructType.fromJson(json.loads(self.spark.read.text(path, wholetext=True).first()[0]))
        return node.query(self).schema

    def _landed(self, node: Node, reader) -> DataFrame:
        """A streaming table's rows, without the batch that brought them."""
        path, schema = f"{self.root}/streams/{node.name}", self._schema(node)
        self.store._fs.mkdirs(self.store._path(path))
        return reader.schema(T.StructType([*schema.fields, T.StructField("_batch", T.LongType())])).parquet(path).drop("_batch")

    def read_stream(self, name: str) -> DataFrame:
        node = self.nodes[name.removeprefix("LIVE.")]
        if node.kind != "streaming_table":
            raise ValueError(f"{name} is no streaming table")
        return self._landed(node, self.spark.readStream)

    # -- graph -------------------------------------------------------------

    def order(self) -> list[str]:
        """Names after what they read; a cycle or an unknown name raises."""
        done: list[str] = []
        open_: set[str] = set()

        def visit(n: str) -> None:
            n = n.removeprefix("LIVE.")
            if n in done:
                return
            if n not in self.nodes:
                raise KeyError(f"unknown dataset: {n}")
            if n in open_:
                raise ValueError(f"cycle at {n}")
            open_.add(n)
            for r in self.nodes[n].reads:
                visit(r)
            open_.discard(n)
            done.append(n)

        for n in self.nodes:
            visit(n)
        return done

    def validate(self) -> dict[str, list[str]]:
        """Checks the graph and each dataset's query and expectations; returns their columns. No rows are read.

        A dataset that reads tables which no update has made yet cannot be
        analysed beyond the graph and has no columns here.
        """
        out: dict[str, list[str]] = {}
        for n in self.order():
            node = self.nodes[n]
            made = all(self.nodes[r.removeprefix("LIVE.")].kind in ("view", "streaming_table") or self.store.exists(r.removeprefix("LIVE.")) for r in node.reads)
            if made:
                df = node.query(self)
                for e in node.expectations:
                    df.filter(e.holds())
                out[n] = df.columns
            else:
                out[n] = []
        return out

    def describe(self) -> DataFrame:
        """name, kind, comment and properties of all datasets, from the table that updates keep."""
        return self.store.read("_datasets")

    # -- updating ----------------------------------------------------------

    def update(self, full_refresh: bool = False, continuous: str | None = None) -> str:
        """One update of all datasets; returns its id.

        With ``continuous``, a trigger interval, streaming tables and change
        feeds are left running and taken up again at that interval, until
        ``stop``; materialized views are computed once, after them.
        """
        update_id = uuid.uuid4().hex
        order = self.order()
        self._every = continuous
        try:
            return self._update(update_id, order, full_refresh)
        finally:
            self._flush(update_id)

    def stop(self) -> None:
        """Ends what a continuous update has left running, after the rows that have arrived."""
        for query in self.running:
            query.processAllAvailable()
            query.stop()
        self.running.clear()
        self._flush("continuous")

    def _update(self, update_id: str, order: list[str], full_refresh: bool) -> str:
        self._note_datasets()
        self._log(update_id, "user_action", {"user_action": {"action": "FULL_REFRESH" if full_refresh else "REFRESH"}})
        self._log(update_id, "create_update", {"create_update": {"full_refresh": full_refresh}})
        for n in order:
            node = self.nodes[n]
            self._log(update_id, "flow_definition", {"flow_definition": {"output_dataset": n, "input_datasets": list(node.reads), "flow_type": node.kind}})
        for n in order:
            node = self.nodes[n]
            if full_refresh:
                self._reset(node)
            if node.kind == "streaming_table":
                self._stream(node, update_id)
            elif node.kind == "changes":
                self._cdc(node, update_id)
            elif node.kind == "materialized_view":
                self._view(node, update_id)
        return update_id

    def _reset(self, node: Node) -> None:
        fs, path = self.store._fs, self.store._path
        for p in (f"{self.root}/streams/{node.name}", f"{self.root}/streams/{node.name}.schema", f"{self.root}/checkpoints/{node.name}"):
            fs.delete(path(p), True)
        if node.kind == "changes" and self.store.exists(node.name):
            self.store.drop(node.name)

    def _guarded(self, node: Node, df: DataFrame, write: Callable[[DataFrame], None], update_id: str) -> None:
        """Measures expectations in the pass that writes; a FAIL expectation stops that pass before its commit."""
        checks = node.expectations
        fatal = [e for e in checks if e.on == "fail"]
        for e in fatal:
            df = df.filter(F.when(e.holds(), True).otherwise(F.raise_error(F.lit(f"expectation {e.name} failed")).cast("boolean")))
        seen = Observation(f"{node.name}-{uuid.uuid4().hex[:6]}")
        if checks:
            df = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count(F.when(e.holds(), 1)).alias(f"ok_{k}") for k, e in enumerate(checks)])
        try:
            write(drop_violations(df, checks))
        except Exception as e:
            if any(f"expectation {x.name} failed" in str(e) for x in fatal):
                self._log(update_id, "flow_progress", {"flow_progress": {"status": "FAILED", "dataset": node.name}})
                raise ExpectationFailed(f"{node.name}: {[x.name for x in fatal]}") from e
            raise
        quality = []
        if checks:
            got = seen.get
            quality = [{"name": e.name, "dataset": node.name, "passed_records": got[f"ok_{k}"], "failed_records": got["rows"] - got[f"ok_{k}"]} for k, e in enumerate(checks)]
        self._log(update_id, "flow_progress", {"flow_progress": {"status": "COMPLETED", "dataset": node.name, "data_quality": {"expectations": quality}}})

    def _run(self, node: Node, df: DataFrame, batch: Callable[[DataFrame, int], None]) -> None:
        writer = df.writeStream.foreachBatch(batch).option("checkpointLocation", f"{self.root}/checkpoints/{node.name}")
        if self._every:
            query = writer.trigger(processingTime=self._every).start()
            query.processAllAvailable()
            self.running.append(query)
            return
        query = writer.trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except Exception as e:
            if "ExpectationFailed" in str(e):
                raise ExpectationFailed(f"{node.name}: {[x.name for x in node.expectations if x.on == 'fail']}") from e
            raise

    def _stream(self, node: Node, update_id: str) -> None:
        path = f"{self.root}/streams/{node.name}"

        def batch(df: DataFrame, number: int) -> None:
            # a batch has a folder of its own, so doing it again replaces what it wrote
            self._guarded(node, df, lambda out: out.write.mode("overwrite").parquet(f"{path}/_batch={number}"), update_id)

        df = node.query(self)
        self.store._put(f"{path}.schema", df.schema.json(), True)
        self._run(node, df, batch)

    def _cdc(self, node: Node, update_id: str) -> None:
        c = node.cdc

        def batch(df: DataFrame, number: int) -> None:
            def write(out: DataFrame) -> None:
                new = latest_changes(out, c["keys"], c["sequence_by"], c["delete_when"])
                if self.store.exists(node.name):
                    newer = F.col("s._seq") > F.col("t._seq")
                    self.store.merge(node.name, new, c["keys"], matched_if=newer)
                else:
                    self.store.create(node.name, new)

            self._guarded(node, df, write, update_id)

        self._run(node, node.query(self), batch)

    def _view(self, node: Node, update_id: str) -> None:
        def write(out: DataFrame) -> None:
            if self.store.exists(node.name):
                self.store.overwrite(node.name, out, overwrite_schema=True)
            else:
                self.store.create(node.name, out)

        self._guarded(node, node.query(self), write, update_id)

    # -- event log ---------------------------------------------------------

    def _note_datasets(self) -> None:
        """Comments and properties in a table of their own, written where they have changed."""
        rows = sorted((n.name, n.kind, n.comment, json.dumps(n.properties, sort_keys=True)) for n in self.nodes.values())
        if self.store.exists("_datasets"):
            if sorted(tuple(r) for r in self.store.read("_datasets").collect()) != rows:
                self.store.overwrite("_datasets", self.spark.createDataFrame(rows, DATASETS))
        elif rows:
            self.store.create("_datasets", self.spark.createDataFrame(rows, DATASETS))

    def _log(self, update_id: str, event_type: str, details: dict) -> None:
        self._events.append({"id": uuid.uuid4().hex, "event_type": event_type, "timestamp": dt.datetime.now(dt.timezone.utc).isoformat(), "update_id": update_id, "details": json.dumps(details)})

    def _flush(self, update_id: str) -> None:
        """All events of an update as one file, also where it failed."""
        events, self._events = self._events, []
        if events:
            self.store._put(f"{self.root}/event_log/{update_id}-{uuid.uuid4().hex[:8]}.json", "\n".join(map(json.dumps, events)) + "\n", False)

    def event_log(self) -> DataFrame:
        return self.spark.read.schema(EVENT_LOG).json(f"{self.root}/event_log")


DATASETS = "name string, kind string, comment string, properties string"
EVENT_LOG = "id string, event_type string, timestamp timestamp, update_id string, details string"
QUALITY = "STRUCT<flow_progress: STRUCT<data_quality: STRUCT<expectations: ARRAY<STRUCT<name: STRING, dataset: STRING, passed_records: BIGINT, failed_records: BIGINT>>>>>"


def quality_from_log(log: DataFrame) -> DataFrame:
    """Passed and failed rows of each expectation."""
    rows = log.filter("event_type = 'flow_progress'").select(F.explode(F.from_json("details", QUALITY)["flow_progress"]["data_quality"]["expectations"]).alias("e"))
    return rows.groupBy(F.col("e.dataset").alias("dataset"), F.col("e.name").alias("name")).agg(F.sum("e.passed_records").alias("passing_records"), F.sum("e.failed_records").alias("failing_records"))


def lineage_from_log(log: DataFrame) -> DataFrame:
    """What each dataset reads."""
    d = F.from_json("details", "STRUCT<flow_definition: STRUCT<output_dataset: STRING, input_datasets: ARRAY<STRING>>>")["flow_definition"]
    return log.filter("event_type = 'flow_definition'").select(d["output_dataset"].alias("output_dataset"), F.explode_outer(d["input_datasets"]).alias("input_dataset")).distinct()


def latest_update(log: DataFrame) -> DataFrame:
    return log.filter("event_type = 'create_update'").orderBy(F.desc("timestamp")).select("update_id").limit(1)
