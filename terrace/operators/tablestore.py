"""Versioned tables on Parquet: merge, update, delete, time travel, restore, clone, optimize, vacuum.

A table is a folder with data folders and a log. A commit writes new data,
takes the next version's lock exclusively (of two writers of one version, one
fails), writes its log entry aside and renames it, so an entry is whole or
absent. Readers take the newest entry, so a table can be overwritten by what
is read from it. Changes rewrite only the files that hold rows they touch.
"""

from __future__ import annotations

import datetime as dt
import json
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace
from functools import reduce
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Seconds after which a lock without a log entry counts as left behind by a writer that died.
STALE = 600
#: Bytes of one file after ``optimize``.
FILE_SIZE = 128 << 20


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Entry:
    """One version: its files and what holds for its rows."""

    version: int = -1
    operation: str = ""
    paths: list[str] = field(default_factory=list)
    schema: str = '{"type": "struct", "fields": []}'
    at: float = 0.0
    parameters: dict = field(default_factory=dict)
    constraints: dict = field(default_factory=dict)
    generated: dict = field(default_factory=dict)
    comments: dict = field(default_factory=dict)
    loaded: dict = field(default_factory=dict)
    metrics: dict = field(default_factory=dict)

    @property
    def struct(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema))


def _plain(path: str) -> str:
    return urlparse(unquote(path)).path


class TableStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- files and log -------------------------------------------------------

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def _list(self, folder: str) -> list:
        return list(self._fs.listStatus(self._path(folder))) if self._fs.exists(self._path(folder)) else []

    def _put(self, path: str, text: str, overwrite: bool) -> None:
        out = self._fs.create(self._path(path), overwrite)
        out.write(bytearray(text.encode()))
        out.close()

    def _versions(self, name: str) -> list[int]:
        found = (s.getPath().getName() for s in self._list(f"{self.root}/{name}/_log"))
        return sorted(int(n[:-5]) for n in found if n.endswith(".json"))

    def tables(self) -> list[str]:
        return sorted(n for s in self._list(self.root) if s.isDirectory() and self._versions(n := s.getPath().getName()))

    def exists(self, name: str) -> bool:
        return bool(self._versions(name))

    def version(self, name: str) -> int:
        if not (found := self._versions(name)):
            raise KeyError(name)
        return found[-1]

    def entry(self, name: str, version: int | None = None) -> Entry:
        version = self.version(name) if version is None else version
        path = self._path(f"{self.root}/{name}/_log/{version}.json")
        if not self._fs.exists(path):
            raise KeyError(f"{name} version {version}")
        stream = self._fs.open(path)
        text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return Entry(**json.loads(text))

    def _commit(self, name: str, entry: Entry) -> int:
        """Commits ``entry`` as its version. What it says of constraints and the like is its own."""
        base = f"{self.root}/{name}/_log/{entry.version}"
        lock = self._path(f"{base}.lock")
        if self._fs.exists(self._path(f"{base}.json")):
            raise CommitConflict(f"{name} version {entry.version}")
        if self._fs.exists(lock) and time.time() - self._fs.getFileStatus(lock).getModificationTime() / 1000 > STALE:
            self._fs.delete(lock, False)
        try:
            self._put(f"{base}.lock", uuid.uuid4().hex, False)
        except Exception as e:
            raise CommitConflict(f"{name} version {entry.version}") from e
        aside = f"{base}.{uuid.uuid4().hex[:8]}.tmp"
        self._put(aside, json.dumps(asdict(entry)), False)
        if not self._fs.rename(self._path(aside), self._path(f"{base}.json")):
            raise CommitConflict(f"{name} version {entry.version}")
        return entry.version

    def _next(self, e: Entry, operation: str, paths: Sequence[str], schema: T.StructType | None = None, changes: Mapping[str, object] | None = None, **parameters: object) -> Entry:
        text = {k: str(v) for k, v in parameters.items()}
        return replace(e, version=e.version + 1, operation=operation, paths=list(paths), schema=schema.json() if schema else e.schema, at=time.time(), parameters=text, metrics={}, **(changes or {}))

    def _data(self, name: str, version: int, df: DataFrame, constraints: Mapping[str, str]) -> str:
        """Writes rows; a broken constraint stops the pass that writes them."""
        for label, condition in constraints.items():
            df = df.filter(F.when(F.coalesce(F.expr(condition), F.lit(True)), True).otherwise(F.raise_error(F.lit(f"constraint <{label}> violated")).cast("boolean")))
        path = f"{self.root}/{name}/data-{version}-{uuid.uuid4().hex[:8]}"
        try:
            df.write.parquet(path)
        except Exception as e:
            self._fs.delete(self._path(path), True)
            if broken := [k for k in constraints if f"constraint <{k}> violated" in str(e)]:
                raise ValueError(f"constraints violated: {broken}") from e
            raise
        return path

    def _write(self, name: str, e: Entry, df: DataFrame, operation: str, keep: Sequence[str] = (), changes: Mapping[str, object] | None = None, **parameters: object) -> int:
        new = self._next(e, operation, (), df.schema, changes, **parameters)
        if not df.columns:  # a table whose columns come with its first rows
            return self._commit(name, new)
        path = self._data(name, new.version, df, new.constraints)
        return self._commit(name, replace(new, paths=[*keep, path]))

    def _files(self, e: Entry) -> dict[str, list[str]]:
        """The data files of each of an entry's paths."""
        out = {}
        for p in e.paths:
            inside = [s.getPath().toString() for s in self._list(p) if s.getPath().getName()[0] not in "_."] if self._fs.getFileStatus(self._path(p)).isDirectory() else [p]
            out[p] = inside
        return out

    def _scan(self, schema: T.StructType, paths: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _split(self, e: Entry, rows: DataFrame) -> tuple[list[str], list[str]]:
        """An entry's paths without, and its files with, the rows that ``rows`` has left of its scan."""
        touched = {_plain(r[0]) for r in rows.select("_file").distinct().collect()}  # names of files to rewrite
        keep, change = [], []
        for p, inside in self._files(e).items():
            hit = [f for f in inside if _plain(f) in touched]
            change += hit
            keep += [p] if not hit else [f for f in inside if _plain(f) not in touched]
        return keep, change

    def _with_file(self, e: Entry) -> DataFrame:
        return self._scan(e.struct, e.paths).withColumn("_file", F.col("_metadata.file_path"))

    # -- reading -------------------------------------------------------------

    def read(self, name: str, version: int | None = None, as_of: float | dt.datetime | None = None) -> DataFrame:
        """The newest version, a stated one, or the newest at a time."""
        if as_of is not None:
            at = as_of.timestamp() if isinstance(as_of, dt.datetime) else as_of
            before = [v for v in self._versions(name) if self.entry(name, v).at < at + 1e-6]  # times are told to the microsecond
            if not before:
                raise KeyError(f"{name} has no version at {as_of}")
            version = before[-1]
        e = self.entry(name, version)
        return self._scan(e.struct, e.paths)

    def history(self, name: str) -> DataFrame:
        rows = [(e.version, e.operation, json.dumps(e.parameters), e.at) for e in (self.entry(name, v) for v in reversed(self._versions(name)))]
        return self.spark.createDataFrame(rows, "version long, operation string, parameters string, committed_at double")

    def describe(self, name: str) -> DataFrame:
        """column_name, data_type, comment, generated_as."""
        e = self.entry(name)
        return self.spark.createDataFrame([(f.name, f.dataType.simpleString(), e.comments.get(f.name), e.generated.get(f.name)) for f in e.struct], "column_name string, data_type string, comment string, generated_as string")

    def detail(self) -> DataFrame:
        """Of each table: its version, operation, files, comment and time of change."""
        found = [(n, self.entry(n)) for n in self.tables()]
        rows = [(n, e.version, e.operation, sum(map(len, self._files(e).values())), e.comments.get(""), e.at) for n, e in found]
        return self.spark.createDataFrame(rows, "table_name string, version long, operation string, n_files long, comment string, modified_at double")

    # -- writing -------------------------------------------------------------

    @staticmethod
    def _generate(df: DataFrame, generated: Mapping[str, str]) -> DataFrame:
        return df.withColumns({c: F.expr(e) for c, e in generated.items()}) if generated else df

    def create(self, name: str, df: DataFrame, constraints: Mapping[str, str] | None = None, generated: Mapping[str, str] | None = None, if_exists: str = "error", comments: Mapping[str, str] | None = None) -> int:
        """A table from a DataFrame. ``generated`` columns are expressions of the others; ``constraints`` hold at each write."""
        there = self._versions(name)
        if there and if_exists == "ignore":
            return there[-1]
        if there and if_exists != "overwrite":
            raise FileExistsError(name)
        own = {"constraints": dict(constraints or {}), "generated": dict(generated or {}), "comments": dict(comments or {})}
        return self._write(name, Entry(version=there[-1] if there else -1), self._generate(df, own["generated"]), "CREATE", changes=own)

    def overwrite(self, name: str, df: DataFrame, overwrite_schema: bool = False) -> int:
        e = self.entry(name)
        df = self._generate(df, e.generated)
        if not overwrite_schema and [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in e.struct]:
            raise ValueError("schema differs; pass overwrite_schema=True")
        return self._write(name, e, df, "OVERWRITE")

    def append(self, name: str, df: DataFrame, merge_schema: bool = False, operation: str = "APPEND", changes: Mapping[str, object] | None = None, **parameters: object) -> int:
        """Adds rows; old files stay. With ``merge_schema``, new columns are null in old rows. Generated columns are computed."""
        e = self.entry(name)
        df, want = self._generate(df, e.generated), e.struct
        new = [f for f in df.schema if f.name not in want.names]
        if new and not merge_schema:
            raise ValueError(f"new columns: {[f.name for f in new]}; pass merge_schema=True")
        schema = T.StructType([*want.fields, *[T.StructField(f.name, f.dataType, True) for f in new]])
        df = df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
        return self._write(name, e, df, operation, e.paths, changes, **parameters)

    def update(self, name: str, where: Column, values: Mapping[str, Column]) -> int:
        """Rewrites the files that hold rows for which ``where`` is true."""
        e, hit = self.entry(name), F.coalesce(where, F.lit(False))
        keep, change = self._split(e, self._with_file(e).filter(hit))
        if not change:
            return self._commit(name, self._next(e, "UPDATE", e.paths))
        df = self._scan(e.struct, change)
        out = df.select(*[(F.when(hit, values[f.name]).otherwise(F.col(f.name)).cast(f.dataType) if f.name in values else F.col(f.name)).alias(f.name) for f in df.schema])
        return self._write(name, e, out, "UPDATE", keep)

    def delete(self, name: str, where: Column | None = None) -> int:
        """Rewrites the files that hold rows for which ``where`` is true; without it, all rows go."""
        e = self.entry(name)
        if where is None:
            return self._commit(name, self._next(e, "DELETE", []))
        hit = F.coalesce(where, F.lit(False))
        keep, change = self._split(e, self._with_file(e).filter(hit))
        if not change:
            return self._commit(name, self._next(e, "DELETE", e.paths))
        return self._write(name, e, self._scan(e.struct, change).filter(~hit), "DELETE", keep)

    def merge(self, name: str, source: DataFrame, keys: Sequence[str], matched: Mapping[str, Column] | str | None = "all", matched_if: Column | None = None, delete_if: Column | None = None, insert: Mapping[str, Column] | str | None = "all", insert_if: Column | None = None) -> int:
        """MERGE. Conditions and values see target columns as ``t.x`` and source columns as ``s.x``.

        A scan of the target's keys finds the files that hold matches; only
        those are read and rewritten. Without changes to matched rows, the
        inserts are appended and no file is rewritten.
        """
        e = self.entry(name)
        wanted = source.select(*keys).distinct()
        if matched is None and delete_if is None:
            seen = self._scan(e.struct, e.paths).join(wanted, list(keys), "left_semi")
            return self._write(name, e, _inserts(e.struct, seen, source, keys, insert, insert_if), "MERGE", e.paths, keys=list(keys))
        keep, change = self._split(e, self._with_file(e).select("_file", *keys).join(wanted, list(keys), "left_semi"))
        out = merged(self._scan(e.struct, change), source, keys, matched, matched_if, delete_if, insert, insert_if)
        return self._write(name, e, out, "MERGE", keep, keys=list(keys))

    def restore(self, name: str, version: int) -> int:
        """The state of an old version as a new one; no data moves."""
        old, now = self.entry(name, version), self.entry(name)
        return self._commit(name, self._next(replace(old, version=now.version), "RESTORE", old.paths, to=version))

    def clone(self, name: str, to: str, deep: bool = False, version: int | None = None) -> int:
        """A deep clone copies rows; a shallow one refers to the same files."""
        e = self.entry(name, version)
        if deep:
            return self.create(to, self.read(name, version), e.constraints, comments=e.comments)
        return self._commit(to, self._next(replace(e, version=-1), "SHALLOW CLONE", e.paths, source=name))

    # -- upkeep --------------------------------------------------------------

    def optimize(self, name: str, cluster_by: Sequence[str] = (), partitions: int | None = None, zorder_by: Sequence[str] = ()) -> int:
        """Rewrites into fewer files: range-clustered, or along a curve through several columns, so that statistics prune scans."""
        e, df = self.entry(name), self.read(name)
        size = sum(self._fs.getFileStatus(self._path(f)).getLen() for x in self._files(e).values() for f in x)
        n = partitions or 1 + size // FILE_SIZE
        if zorder_by:
            df = df.withColumn("_z", z_value(df, zorder_by)).repartitionByRange(n, "_z").sortWithinPartitions("_z").drop("_z")
        elif cluster_by:
            df = df.repartitionByRange(n, *cluster_by).sortWithinPartitions(*cluster_by)
        else:
            df = df.repartition(n)
        return self._write(name, e, df, "OPTIMIZE", cluster_by=list(cluster_by), zorder_by=list(zorder_by))

    def retain(self, name: str, archive: str, expired: Column) -> tuple[int, int]:
        """Moves expired rows to an archive table, then deletes them."""
        gone = self.read(name).filter(F.coalesce(expired, F.lit(False)))
        a = self.append(archive, gone) if self.exists(archive) else self.create(archive, gone)
        return a, self.delete(name, expired)

    def _referred(self, without: str | None = None) -> set[str]:
        return {_plain(p) for n in self.tables() if n != without for v in self._versions(n) for p in self.entry(n, v).paths}

    def vacuum(self, name: str, keep_versions: int = 1) -> int:
        """Deletes log entries but the last ones, and data that no entry of any table refers to; how many folders went."""
        versions = self._versions(name)
        for v in versions[: len(versions) - max(1, keep_versions)]:
            for end in ("json", "lock"):
                self._fs.delete(self._path(f"{self.root}/{name}/_log/{v}.{end}"), False)
        used, gone = self._referred(), 0
        for s in self._list(f"{self.root}/{name}"):
            folder = _plain(s.getPath().toString())
            if s.getPath().getName().startswith("data-") and not any(p == folder or p.startswith(f"{folder}/") for p in used):
                self._fs.delete(s.getPath(), True)
                gone += 1
        return gone

    def add_constraint(self, name: str, label: str, condition: str) -> int:
        e = self.entry(name)
        if self.read(name).filter(~F.coalesce(F.expr(condition), F.lit(True))).limit(1).count():
            raise ValueError(f"constraints violated: {[label]}")
        return self._commit(name, self._next(e, "ADD CONSTRAINT", e.paths, changes={"constraints": e.constraints | {label: condition}}))

    def comment(self, name: str, text: str | None = None, columns: Mapping[str, str] | None = None) -> int:
        """Comments of the table and of columns."""
        e = self.entry(name)
        new = e.comments | dict(columns or {}) | ({"": text} if text is not None else {})
        return self._commit(name, self._next(e, "COMMENT", e.paths, changes={"comments": new}))

    def drop(self, name: str) -> bool:
        """Drops a table. Data that shallow clones refer to stays for them."""
        if not self.exists(name):
            return False
        here = f"{_plain(self.root)}/{name}/"
        shared = any(p.startswith(here) for p in self._referred(without=name))
        return bool(self._fs.delete(self._path(f"{self.root}/{name}/_log" if shared else f"{self.root}/{name}"), True))

    def log_event(self, log: str, event: str, **values: object) -> int:
        """Appends to a log table."""
        row = self.spark.createDataFrame([(event, json.dumps({k: str(v) for k, v in values.items()}), time.time())], "event string, details string, logged_at double")
        return self.append(log, row) if self.exists(log) else self.create(log, row)

    def copy_into(self, name: str, path: str, fmt: str, schema: T.StructType | str | None = None, merge_schema: bool = False, transform=None, **options: str) -> int:
        """Loads files that have not been loaded; the source's checkpoint is the ledger.

        Loading a batch again after a failure adds nothing: each version says
        which batch of which path it has loaded last.
        """
        from terrace.sources.files import stream_files

        def load(batch: DataFrame, number: int) -> None:
            batch = transform(batch) if transform else batch
            if not self.exists(name):
                self._write(name, Entry(), batch, "COPY INTO", changes={"loaded": {path: number}})
            elif (loaded := self.entry(name).loaded).get(path, -1) < number:
                self.append(name, batch, merge_schema, "COPY INTO", {"loaded": loaded | {path: number}}, path=path)

        query = stream_files(self.spark, path, fmt, schema, **options).writeStream.foreachBatch(load).option("checkpointLocation", f"{self.root}/_copy/{name}").trigger(availableNow=True).start()
        query.awaitTermination()
        return self.version(name)


def _not_above(value: Column) -> Callable[[Column], Column]:
    return lambda cut: cut <= value


def z_value(df: DataFrame, columns: Sequence[str], bits: int = 8) -> Column:
    """Interleaved bits of each column's rank among its quantiles, of which there are 2**bits - 1."""
    cuts = [k / 2**bits for k in range(1, 2**bits)]
    number = {x: F.col(x).cast("double") if isinstance(df.schema[x].dataType, T.NumericType) else F.xxhash64(x).cast("double") if isinstance(df.schema[x].dataType, T.StringType) else F.unix_seconds(F.col(x).cast("timestamp")).cast("double") for x in columns}
    at = df.agg(*[F.percentile_approx(v, cuts, 10_000).alias(f"q{k}") for k, v in enumerate(number.values())]).first()
    out = F.lit(0).cast("long")
    for k, v in enumerate(number.values()):
        found = F.array(*map(F.lit, at[k] or []))
        rank = F.size(F.filter(found, _not_above(v))).cast("long") if at[k] else F.lit(0).cast("long")
        for b in range(bits):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(rank, b).bitwiseAND(F.lit(1).cast("long")), b * len(columns) + k))
    return out


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _put(f: T.StructField, insert: Mapping[str, Column] | str | None, names: set[str]) -> Column:
    """What an inserted row has in a column."""
    return F.col(f"s.{f.name}") if insert == "all" and f.name in names else F.lit(None) if insert == "all" else (insert or {}).get(f.name, F.lit(None))


def _yes(condition: Column | None) -> Column:
    return F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))


def _inserts(schema: T.StructType, target: DataFrame, source: DataFrame, keys: Sequence[str], insert: Mapping[str, Column] | str | None, insert_if: Column | None) -> DataFrame:
    """Source rows whose keys the target does not have. Null keys are never had."""
    there = target.select(*keys).alias("t")
    on = _all([F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys])
    new = source.alias("s").filter(_yes(insert_if) if insert is not None else F.lit(False)).join(there, on, "left_anti")
    return new.select(*[_put(f, insert, set(source.columns)).cast(f.dataType).alias(f.name) for f in schema])


def merged(target: DataFrame, source: DataFrame, keys: Sequence[str], matched: Mapping[str, Column] | str | None = "all", matched_if: Column | None = None, delete_if: Column | None = None, insert: Mapping[str, Column] | str | None = "all", insert_if: Column | None = None) -> DataFrame:
    """The target after a MERGE: one full join over the rows with keys.

    Several source rows that match one target row fail the query; several
    that match none are all inserted, and so are rows with null keys, which
    match nothing.
    """
    if matched is None and delete_if is None:
        return target.unionByName(_inserts(target.schema, target, source, keys, insert, insert_if))
    has = _all([F.col(k).isNotNull() for k in keys])
    counted = source.filter(has).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    t, s = target.filter(has).withColumn("_here", F.lit(True)).alias("t"), counted.alias("s")
    both = t.join(s, _all([F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys]), "full")
    here, there = F.col("t._here").isNotNull(), F.col("s._n").isNotNull()
    gone = here & there & (F.lit(False) if delete_if is None else _yes(delete_if))
    change = here & there & (F.lit(False) if matched is None else _yes(matched_if))
    add = ~here & there & (F.lit(False) if insert is None else _yes(insert_if))
    once = F.when(here & (F.col("s._n") > 1), F.raise_error(F.lit("several source rows match one target row")).cast("boolean")).otherwise(True)
    names = set(source.columns)

    def value(f: T.StructField) -> Column:
        old, new = F.col(f"t.{f.name}"), F.col(f"s.{f.name}") if f.name in names else F.lit(None)
        up = (new if f.name in names else old) if matched == "all" else (matched or {}).get(f.name, old)
        return F.when(add, _put(f, insert, names)).when(change, up).otherwise(old).cast(f.dataType).alias(f.name)

    out = both.filter(once & (here | add) & ~gone).select(*[value(f) for f in target.schema])
    out = out.unionAll(target.filter(~has))
    if insert is not None:
        loose = source.filter(~has).alias("s").filter(_yes(insert_if))
        out = out.unionAll(loose.select(*[_put(f, insert, names).cast(f.dataType).alias(f.name) for f in target.schema]))
    return out
