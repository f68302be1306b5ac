"""Sinks."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame


class IfExists(str, Enum):
    """What a write does with what is there."""

    FAIL = "error"
    OVERWRITE = "overwrite"
    APPEND = "append"
    IGNORE = "ignore"


def write(df: DataFrame, target: str, fmt: str = "parquet", if_exists: IfExists | str = IfExists.OVERWRITE, partition_by: list[str] | None = None) -> None:
    """To a path where ``target`` has a slash, else to a table."""
    writer = df.write.format(fmt).mode(IfExists(if_exists).value)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(target) if "/" in target else writer.saveAsTable(target)


def create_table_as(df: DataFrame, name: str, replace: bool = True, fmt: str = "parquet") -> DataFrame:
    """CREATE [OR REPLACE] TABLE AS SELECT."""
    write(df, name, fmt, IfExists.OVERWRITE if replace else IfExists.FAIL)
    return df.sparkSession.table(name)


def deliver(df: DataFrame, kind: str, name: str | None = None) -> DataFrame:
    """A result as a temp view, a table, or itself."""
    if kind == "view":
        df.createOrReplaceTempView(name)
    elif kind == "table":
        return create_table_as(df, name)
    elif kind != "dataframe":
        raise ValueError(f"unknown sink: {kind}")
    return df


def export_csv(df: DataFrame, path: str, if_exists: IfExists | str = IfExists.OVERWRITE) -> None:
    df.write.mode(IfExists(if_exists).value).option("header", "true").csv(path)


def drop(spark, name: str, kind: str = "TABLE") -> bool:
    """Drops a table, view or schema if it is there; whether it was."""
    there = spark.catalog.databaseExists(name) if kind.upper() == "SCHEMA" else spark.catalog.tableExists(name)
    spark.sql(f"DROP {kind} IF EXISTS {name}" + (" CASCADE" if kind.upper() == "SCHEMA" else ""))
    return there
