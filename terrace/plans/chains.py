"""Named layer chains: files to a bronze, a silver and a gold table, as SQL scripts.

A chain says what its silver table derives and keeps and by what its gold
table groups; the three statements follow from that.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from terrace.operators.tablestore import TableStore
from terrace.plans import sqlrunner
from terrace.plans.sqltables import SqlTables, declare
from terrace.streaming.pipeline import Pipeline

EMAIL = r"'^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}$'"


def tiers(column: str, limits: Sequence[tuple[float, str]], lowest: str, operator: str = ">=") -> str:
    """A CASE over falling limits."""
    return "CASE " + " ".join(f"WHEN {column} {operator} {v:g} THEN '{label}'" for v, label in limits) + f" ELSE '{lowest}' END"


def flag(condition: str, yes: str = "valid", no: str = "invalid") -> str:
    return f"CASE WHEN {condition} THEN '{yes}' ELSE '{no}' END"


def counts(column: str, labels: Mapping[str, str]) -> dict[str, str]:
    """Numbers of rows with each label."""
    return {name: f"count_if({column} = '{label}')" for label, name in labels.items()}


def measures(column: str, kind: str, names: Mapping[str, str]) -> dict[str, str]:
    """sum, avg, max and min of a column, cast for exact sums."""
    return {name: f"CAST({f}(CAST({column} AS {kind})) AS DOUBLE)" for f, name in names.items()}


@dataclass(frozen=True)
class Chain:
    name: str
    silver: Mapping[str, str]
    keep: str
    keys: Mapping[str, str]
    gold: Mapping[str, str]
    expectations: Mapping[str, str] = field(default_factory=dict)

    def bronze_sql(self) -> str:
        return "CREATE OR REPLACE TABLE ${bronze} AS SELECT *, current_timestamp() AS ingested_at, 'files' AS source_kind FROM ${source}"

    def silver_sql(self, source: str = "${bronze}") -> str:
        return f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in self.silver.items())}, current_timestamp() AS cleaned_at FROM {source} WHERE {self.keep}"

    def gold_sql(self, source: str = "${silver}") -> str:
        columns = ", ".join(f"{e} AS {n}" for n, e in {**self.keys, **self.gold}.items())
        return f"SELECT {columns} FROM {source} GROUP BY {', '.join(self.keys.values())}"

    def script(self) -> str:
        """Tables made once from files."""
        return f"{self.bronze_sql()};\nCREATE OR REPLACE TABLE ${{silver}} AS {self.silver_sql()};\nCREATE OR REPLACE TABLE ${{gold}} AS {self.gold_sql()};\nSELECT * FROM ${{gold}}"

    def streaming_script(self, fmt: str) -> str:
        """Streaming bronze and silver tables and a materialized gold view."""
        checks = ", ".join(f"CONSTRAINT {n} EXPECT ({c}) ON VIOLATION DROP ROW" for n, c in self.expectations.items())
        return (
            f"CREATE OR REFRESH STREAMING TABLE {self.name}_bronze COMMENT 'rows as they come' TBLPROPERTIES ('layer' = 'bronze') AS SELECT *, _metadata.file_name AS source_file FROM STREAM read_files(${{path}}, format => '{fmt}', schema => ${{schema}});\n"
            f"CREATE OR REFRESH STREAMING TABLE {self.name}_silver {f'({checks})' if checks else ''} COMMENT 'checked rows' AS {self.silver_sql(f'STREAM(LIVE.{self.name}_bronze)')};\n"
            f"CREATE OR REFRESH MATERIALIZED VIEW {self.name}_gold COMMENT 'figures' AS {self.gold_sql(f'LIVE.{self.name}_silver')}"
        )


def run(chain: Chain, store: TableStore, source: str) -> DataFrame:
    """Runs a chain's script over files or a session's view; the gold table's rows."""
    names = {layer: sqlrunner.Identifier(f"{chain.name}_{layer}") for layer in ("bronze", "silver", "gold")}
    return SqlTables(store, names | {"source": sqlrunner.Fragment(source)}).run(chain.script())


def stream(chain: Chain, p: Pipeline, path: str, fmt: str, schema: str) -> Pipeline:
    return declare(p, chain.streaming_script(fmt), {"path": path, "schema": schema})


_SIZES = {"high_value": "high", "medium_value": "medium", "low_value": "low"}

#: The chains, by name.
CHAINS = {
    c.name: c
    for c in (
        Chain(
            "ecommerce",
            {"line_total": "quantity * unit_price", "order_category": tiers("total_amount", [(1000, "high_value"), (500, "medium_value")], "low_value", ">"), "data_quality_flag": flag("status IN ('F', 'O', 'P')")},
            "total_amount > 0 AND customer_id IS NOT NULL",
            {"customer_id": "customer_id", "product_id": "product_id"},
            {"total_orders": "count(*)"} | measures("total_amount", "DECIMAL(18,2)", {"sum": "total_spend", "max": "max_order_value", "min": "min_order_value"}) | {"total_quantity_sold": "sum(quantity)"} | counts("order_category", {k: f"{v}_value_orders" for k, v in _SIZES.items()}) | counts("data_quality_flag", {"valid": "valid_records", "invalid": "invalid_records"}),
        ),
        Chain(
            "healthcare",
            {"stay_days": "datediff(discharge_date, admission_date)", "stay_category": tiers("datediff(discharge_date, admission_date)", [(30, "long_stay"), (7, "medium_stay")], "short_stay", ">"), "severity_level": "CASE WHEN diagnosis LIKE '%acute%' THEN 'high_severity' WHEN diagnosis LIKE '%chronic%' THEN 'medium_severity' ELSE 'low_severity' END", "data_quality_flag": flag("age BETWEEN 0 AND 120")},
            "patient_id IS NOT NULL AND admission_date IS NOT NULL",
            {"hospital_ward": "hospital_ward", "doctor_id": "doctor_id", "stay_category": "stay_category", "severity_level": "severity_level"},
            {"total_patients": "count(*)", "total_bed_days": "sum(stay_days)", "longest_stay": "max(stay_days)", "average_age": "round(avg(age), 4)"} | counts("data_quality_flag", {"valid": "valid_records", "invalid": "invalid_records"}),
        ),
        Chain(
            "retail",
            {"purchase_volume": tiers("units_purchased", [(5000, "high_volume"), (0, "medium_volume")], "low_volume", ">"), "customer_segment": tiers("loyalty_segment", [(3, "high_value"), (2, "medium_value")], "low_value"), "data_quality_flag": flag("state IS NOT NULL AND region IS NOT NULL")},
            "customer_id IS NOT NULL",
            {"state": "state", "region": "region", "purchase_volume": "purchase_volume", "customer_segment": "customer_segment"},
            {"total_customers": "count(*)"} | measures("units_purchased", "DECIMAL(18,2)", {"sum": "total_units_purchased", "max": "most_units"}) | counts("data_quality_flag", {"valid": "valid_records", "invalid": "invalid_records"}),
        ),
        Chain(
            "simple",
            {"made_at": "CAST(made AS TIMESTAMP_NTZ)", "clean_price": "CAST(price AS DECIMAL(10,2))", "product_category": tiers("price", [(1500, "high_value"), (1200, "medium_value")], "low_value"), "price_quality_flag": flag("price >= 0")},
            "made > '2021-01-01' AND price >= 0 AND id IS NOT NULL",
            {"made_on": "to_date(made_at)", "category": "category", "product_category": "product_category"},
            {"total_products": "count(*)"} | measures("clean_price", "DECIMAL(18,2)", {"sum": "total_revenue", "max": "max_price", "min": "min_price"}) | counts("price_quality_flag", {"valid": "valid_price_products"}),
            {"has_id": "id IS NOT NULL", "priced": "price >= 0"},
        ),
        Chain(
            "standard",
            {"clean_email": f"CASE WHEN email RLIKE {EMAIL} THEN email END", "clean_amount": "CAST(amount AS DECIMAL(10,2))", "order_category": tiers("amount", [(100000, "high_value"), (10000, "medium_value")], "low_value"), "date_quality_flag": flag("ordered_on > DATE '1993-01-01'")},
            "amount >= 0 AND customer_id IS NOT NULL",
            {"customer_id": "customer_id", "order_category": "order_category"},
            {"total_orders": "count(*)", "orders_with_email": "count(clean_email)"} | measures("clean_amount", "DECIMAL(18,2)", {"sum": "total_revenue", "max": "max_order_value"}) | counts("date_quality_flag", {"valid": "valid_date_orders"}),
            {"has_customer": "customer_id IS NOT NULL", "positive": "amount >= 0"},
        ),
    )
}
