"""A registry of SQL patterns, templates, checks and functions: find, render, export."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from terrace.functions import scalars
from terrace.plans import sqlrunner


@dataclass(frozen=True)
class Item:
    name: str
    kind: str  # pattern, template, check or function
    category: str
    description: str
    sql: str
    parameters: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    examples: tuple[dict, ...] = ()


@dataclass
class Library:
    items: dict[str, Item] = field(default_factory=dict)

    def register(self, item: Item) -> None:
        self.items[item.name] = item

    def get(self, name: str) -> Item:
        return self.items[name]

    def list(self, kind: str | None = None, category: str | None = None) -> list[str]:
        return sorted(n for n, i in self.items.items() if kind in (None, i.kind) and category in (None, i.category))

    def search(self, text: str) -> list[str]:
        t = text.lower()
        return sorted(n for n, i in self.items.items() if t in " ".join([i.name, i.description, *i.tags]).lower())

    def render(self, name: str, **parameters: object) -> str:
        item = self.get(name)
        if missing := sorted(set(item.parameters) - set(parameters)):
            raise ValueError(f"missing parameters: {missing}")
        return sqlrunner.render(item.sql, parameters)

    def export(self) -> str:
        return json.dumps({n: asdict(i) for n, i in sorted(self.items.items())}, indent=1)


def default_library() -> Library:
    lib = Library()

    def add(kind: str, category: str, name: str, description: str, sql: str, *tags: str) -> None:
        import re

        lib.register(Item(name, kind, category, description, sql, tuple(dict.fromkeys(re.findall(r"\$\{(\w+)\}", sql))), tags))

    add("pattern", "ingestion", "bronze_ingestion", "Files to a bronze view with audit columns", "SELECT *, current_timestamp() AS ingestion_timestamp, input_file_name() AS source_file FROM ${source}", "bronze", "audit")
    add("pattern", "ingestion", "incremental_load", "Rows newer than the target, newest of each key", "SELECT * EXCEPT (rn) FROM (SELECT *, row_number() OVER (PARTITION BY ${key} ORDER BY ${timestamp} DESC) AS rn FROM ${source} WHERE ${timestamp} > (SELECT coalesce(max(${timestamp}), TIMESTAMP '1900-01-01') FROM ${target})) WHERE rn = 1", "incremental", "merge")
    add("pattern", "transformation", "silver_transformation", "Non-null keys with an audit column", "SELECT *, current_timestamp() AS transformation_timestamp FROM ${source} WHERE ${key} IS NOT NULL", "silver")
    add("pattern", "transformation", "data_cleaning", "Trimmed, normalised contact columns", "SELECT ${key}, trim(${name}) AS name, lower(trim(${email})) AS email, regexp_replace(${phone}, '[^0-9]', '') AS phone_clean, ${email} RLIKE '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\\\.[A-Za-z]{2,}$' AS email_valid FROM ${source}", "cleaning")
    add("pattern", "quality", "completeness_check", "Nulls of a column", "SELECT count(*) AS total_rows, count(${column}) AS non_null_count, count(*) - count(${column}) AS null_count, round(try_divide(count(${column}) * 100D, count(*)), 2) AS completeness_percentage FROM ${table}", "nulls")
    add("pattern", "quality", "uniqueness_check", "Values that occur more than once", "SELECT ${column}, count(*) AS occurrence_count FROM ${table} GROUP BY ${column} HAVING count(*) > 1 ORDER BY occurrence_count DESC", "duplicates")
    add("pattern", "quality", "data_type_check", "Rows by whether a column has a form", "SELECT ${column}, CASE WHEN ${column} RLIKE ${pattern} THEN 'valid' ELSE 'invalid' END AS validation_result FROM ${table} WHERE ${column} IS NOT NULL", "regex")
    add("pattern", "aggregation", "gold_aggregation", "Aggregates by keys", "SELECT ${keys}, ${aggregates} FROM ${source} GROUP BY ${keys}", "gold")
    add("pattern", "aggregation", "time_series", "Aggregates by truncated time", "SELECT date_trunc(${unit}, ${timestamp}) AS period, ${aggregates} FROM ${source} WHERE ${timestamp} >= ${start} AND ${timestamp} < ${stop} GROUP BY 1 ORDER BY 1", "time")
    add("pattern", "validation", "business_rule_validation", "Rows that break a rule", "SELECT ${description} AS rule_description, count(*) AS violation_count FROM ${table} WHERE NOT coalesce(${rule}, FALSE)", "rule")
    add("pattern", "validation", "referential_integrity", "Rows without a parent", "SELECT count(*) AS orphan_count FROM ${child} c LEFT ANTI JOIN ${parent} p ON c.${child_key} = p.${parent_key}", "foreign key")
    add("template", "etl", "bronze_to_silver", "A silver table from a filtered bronze table", "SELECT ${columns}, current_timestamp() AS processed_at FROM ${source} WHERE ${condition}", "silver")
    add("template", "etl", "incremental_merge", "What an incremental merge takes", "SELECT * EXCEPT (rn) FROM (SELECT *, row_number() OVER (PARTITION BY ${key} ORDER BY ${timestamp} DESC) AS rn FROM ${source}) WHERE rn = 1", "merge")
    add("template", "analytics", "customer_analytics", "Customers with orders of a period", "SELECT c.${key}, count(*) AS total_orders, sum(o.${amount}) AS total_spend, customer_segment(sum(o.${amount})) AS segment FROM ${customers} c JOIN ${orders} o ON c.${key} = o.${key} WHERE o.${date} BETWEEN ${start} AND ${stop} GROUP BY c.${key}", "customers")
    add("template", "analytics", "sales_analytics", "Sales by keys and month", "SELECT ${keys}, date_trunc('month', ${date}) AS month, count(DISTINCT ${order}) AS total_orders, sum(${amount}) AS total_revenue FROM ${orders} WHERE ${date} BETWEEN ${start} AND ${stop} GROUP BY ${keys}, month ORDER BY month", "sales")
    add("template", "quality", "comprehensive_quality_check", "Completeness and uniqueness in one pass", "SELECT count(*) AS total_rows, count(${key}) AS key_count, count(DISTINCT ${key}) AS key_distinct, count(${number}) AS number_count, count(${text}) AS text_count FROM ${table}", "report")
    add("template", "reporting", "executive_summary", "Headline figures at a date", "SELECT ${report_date} AS report_date, count(DISTINCT ${customer}) AS total_customers, count(DISTINCT ${order}) AS total_orders, sum(${amount}) AS total_revenue, count(DISTINCT CASE WHEN ${date} >= date_sub(${report_date}, 30) THEN ${customer} END) AS active_30d FROM ${orders} WHERE ${date} <= ${report_date}", "report")
    add("template", "maintenance", "table_statistics", "Fresh statistics of a table", "ANALYZE TABLE ${table} COMPUTE STATISTICS FOR ALL COLUMNS", "maintenance")
    add("template", "maintenance", "data_retention", "Rows past their keeping time", "SELECT * FROM ${table} WHERE ${date} < date_sub(current_date(), ${days})", "retention")
    for name, column in (("null_check", "${column} IS NOT NULL"), ("empty_string_check", "trim(${column}) <> ''"), ("range_check", "${column} BETWEEN ${low} AND ${high}"), ("format_check", "${column} RLIKE ${pattern}"), ("domain_check", "${column} IN (${domain})"), ("length_check", "length(${column}) BETWEEN ${low} AND ${high}"), ("type_check", "${column} RLIKE '^[0-9]+$'"), ("case_check", "${column} = upper(${column})"), ("freshness_check", "${column} >= ${since}")):
        add("check", "quality", name, f"Share of rows for which {column} holds", f"SELECT count(*) AS total_rows, count_if({column}) AS good_rows, round(try_divide(count_if({column}) * 100D, count(*)), 2) AS percentage FROM ${{table}}", "check")
    add("check", "quality", "primary_key_check", "Whether a key is unique", "SELECT count(*) AS total_rows, count(DISTINCT ${column}) AS unique_values FROM ${table}", "key")
    add("check", "quality", "composite_key_check", "Whether a tuple of columns is unique", "SELECT count(*) AS total_rows, count(DISTINCT struct(${columns})) AS unique_combinations FROM ${table}", "key")
    add("check", "quality", "update_frequency_check", "Rows for each day of the span", "SELECT count(*) AS total_rows, try_divide(count(*), datediff(max(${column}), min(${column}))) AS avg_updates_per_day FROM ${table}", "time")
    for name, (params, kind, body) in scalars.SQL_FUNCTIONS.items():
        lib.register(Item(name, "function", "scalar", f"{name}({params}) returns {kind}", f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body}"))
    return lib
