"""Bronze, silver and gold layers from configuration."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from terrace.operators import aggregates, quality, transforms
from terrace.sources import files, sinks


@dataclass(frozen=True)
class Naming:
    """{project}_{environment}_{dataset}_{layer}"""

    project: str
    environment: str = "dev"

    def table(self, dataset: str, layer: str) -> str:
        return f"{self.project}_{self.environment}_{dataset}_{layer}"


@dataclass
class Silver:
    nulls: Mapping[str, str] | None = None
    types: Mapping[str, str] = field(default_factory=dict)
    filters: Mapping[str, Mapping[str, object]] = field(default_factory=dict)
    keys: Sequence[str] = ()
    order_by: Sequence[Column] = ()
    keep: str = "first"
    rename: Mapping[str, str] = field(default_factory=dict)
    select: Sequence[str] = ()
    custom: Callable[[DataFrame], DataFrame] | None = None


@dataclass
class Gold:
    group_by: Sequence[str]
    aggregations: Mapping[str, str]


def bronze(df: DataFrame, source: str) -> DataFrame:
    """Audit columns, then trimmed upper case, audit columns included."""
    return transforms.clean_strings(transforms.add_metadata(df, source, "bronze"))


def silver(df: DataFrame, c: Silver, source: str = "bronze") -> DataFrame:
    """Nulls, types, filters, duplicates, names, columns, audit columns, in this order."""
    if c.nulls is not None:
        df = transforms.handle_nulls(df, c.nulls)
    df = transforms.filter_data(transforms.convert_types(df, c.types), c.filters)
    if c.keys:
        df = transforms.deduplicate(df, c.keys, c.order_by, c.keep)
    if c.custom:
        df = df.transform(c.custom)
    df = transforms.rename(df, c.rename)
    if c.select:
        df = transforms.select_existing(df, c.select)
    return transforms.add_metadata(df, source, "silver")


def gold(df: DataFrame, c: Gold, source: str = "silver") -> DataFrame:
    return transforms.add_metadata(aggregates.group_agg(df, c.group_by, c.aggregations), source, "gold")


class Medallion:
    """Runs the three layers into tables; failures raise. Rows are counted by the write itself."""

    def __init__(self, spark: SparkSession, naming: Naming, if_exists: str = "overwrite", strict: bool = False):
        self.spark, self.naming, self.if_exists, self.strict = spark, naming, if_exists, strict

    def _put(self, df: DataFrame, dataset: str, layer: str) -> dict:
        table = self.naming.table(dataset, layer)
        seen = Observation(f"{table}-rows")
        sinks.write(df.observe(seen, F.count(F.lit(1)).alias("n")), table, if_exists=self.if_exists)
        report = quality.validate_layer(self.spark.table(table), layer, strict=self.strict)
        return {"table": table, "row_count": seen.get["n"], "validation_results": report}

    def run_bronze(self, dataset: str, source: str, fmt: str | None = None) -> dict:
        return self._put(bronze(files.read_any(self.spark, source, fmt), source), dataset, "bronze")

    def run_silver(self, dataset: str, config: Silver) -> dict:
        return self._put(silver(self.spark.table(self.naming.table(dataset, "bronze")), config), dataset, "silver")

    def run_gold(self, dataset: str, config: Gold) -> dict:
        return self._put(gold(self.spark.table(self.naming.table(dataset, "silver")), config), dataset, "gold")

    def run(self, dataset: str, source: str, silver_config: Silver, gold_config: Gold) -> dict:
        layers = {"bronze": self.run_bronze(dataset, source), "silver": self.run_silver(dataset, silver_config), "gold": self.run_gold(dataset, gold_config)}
        return layers | {"total_rows_processed": sum(x["row_count"] for x in layers.values())}
