"""Grants, column masks, row filters and dynamic views for a principal."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Principal:
    user: str
    groups: frozenset[str] = frozenset()

    def is_member(self, group: str) -> Column:
        return F.lit(group in self.groups)


@dataclass
class Policies:
    """Masks, filters and grants by name; applied where a table is read."""

    masks: dict[tuple[str, str], Callable[[Column, Principal], Column]] = field(default_factory=dict)
    filters: dict[str, Callable[[Principal], Column]] = field(default_factory=dict)
    grants: set[tuple[str, str, str]] = field(default_factory=set)

    def set_mask(self, table: str, column: str, mask: Callable[[Column, Principal], Column]) -> None:
        self.masks[table, column] = mask

    def drop_mask(self, table: str, column: str) -> None:
        self.masks.pop((table, column), None)

    def set_row_filter(self, table: str, keep: Callable[[Principal], Column]) -> None:
        self.filters[table] = keep

    def drop_row_filter(self, table: str) -> None:
        self.filters.pop(table, None)

    def grant(self, privilege: str, securable: str, to: str) -> None:
        self.grants.add((privilege.upper(), securable, to))

    def revoke(self, privilege: str, securable: str, of: str) -> None:
        self.grants.discard((privilege.upper(), securable, of))

    def allowed(self, who: Principal, privilege: str, securable: str) -> bool:
        """On a securable or any that holds it: catalog, catalog.schema, catalog.schema.table."""
        parts = securable.split(".")
        above = [".".join(parts[: k + 1]) for k in range(len(parts))]
        names = {who.user, *who.groups}
        return any((p, s, n) in self.grants for p in (privilege.upper(), "ALL PRIVILEGES") for s in above for n in names)

    def show_grants(self, spark: SparkSession, securable: str | None = None) -> DataFrame:
        rows = sorted(g for g in self.grants if securable in (None, g[1]))
        return spark.createDataFrame(rows, "privilege string, securable string, principal string")

    def secure(self, table: str, df: DataFrame, who: Principal) -> DataFrame:
        """The row filter sees true values; masks come after it."""
        if table in self.filters:
            df = df.filter(F.coalesce(self.filters[table](who), F.lit(False)))
        masks: Mapping[str, Column] = {c: m(F.col(c), who) for (t, c), m in self.masks.items() if t == table}
        return df.select(*[masks.get(c, F.col(c)).alias(c) for c in df.columns])

    def read(self, spark: SparkSession, table: str, who: Principal) -> DataFrame:
        if not self.allowed(who, "SELECT", table):
            raise PermissionError(f"{who.user} has no SELECT on {table}")
        return self.secure(table, spark.table(table), who)


def list_tables(spark: SparkSession, schema: str | None = None, max_tables: int | None = None, like: str | None = None) -> DataFrame:
    """An information-schema view of the session's tables and views, by name, up to a number of them."""
    found = sorted((t.catalog or "", (t.namespace or [""])[0], t.name, t.tableType, t.isTemporary) for t in spark.catalog.listTables(schema, like))
    return spark.createDataFrame(found[:max_tables], "table_catalog string, table_schema string, table_name string, table_type string, is_temporary boolean")


def list_schemas(spark: SparkSession) -> DataFrame:
    rows = sorted((d.catalog or "", d.name) for d in spark.catalog.listDatabases())
    return spark.createDataFrame(rows, "catalog_name string, schema_name string")


def list_columns(spark: SparkSession, table: str) -> DataFrame:
    rows = [(k, x.name, x.dataType, x.nullable) for k, x in enumerate(spark.catalog.listColumns(table))]
    return spark.createDataFrame(rows, "position int, column_name string, data_type string, nullable boolean")


def modified_since(store, since: float) -> DataFrame:
    """Versioned tables that were changed at a time or after it."""
    return store.detail().filter(F.col("modified_at") >= since)


def upgrade(spark: SparkSession, names: Sequence[str], store, how: str = "copy") -> dict[str, str]:
    """Brings session tables into a store: ``copy`` writes them, ``sync`` only those whose rows differ in number or columns."""
    done = {}
    for n in names:
        df = spark.table(n)
        short = n.rpartition(".")[2]
        if store.exists(short):
            have = store.read(short)
            if how == "sync" and have.columns == df.columns and have.count() == df.count():
                done[n] = "unchanged"
                continue
            store.overwrite(short, df, overwrite_schema=True)
            done[n] = "replaced"
        else:
            store.create(short, df)
            done[n] = "created"
    return done


def mrn_mask(column: Column, who: Principal, group: str = "admins") -> Column:
    """Record numbers are shown to one group's members alone."""
    return F.when(who.is_member(group), column.cast("string")).otherwise("REDACTED")


def device_filter(column: Column, who: Principal, below: int = 30, group: str = "admins") -> Column:
    """Members of one group see all devices, others those under a number."""
    return who.is_member(group) | (column < below)
