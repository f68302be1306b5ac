"""Data-quality checks: declared, then measured together in one aggregate."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _share(n: Column, total: Column) -> Column:
    return F.round(F.try_divide(n * F.lit(100.0), total), 2)


def _n(condition: Column | None = None) -> Column:
    return F.count(F.lit(1)) if condition is None else F.count(F.when(condition, 1))


@dataclass(frozen=True)
class Check:
    """One check: its label, its output columns as aggregates, and when it passes."""

    name: str
    label: tuple[str, str]
    metrics: dict[str, Column]
    passes: Callable[[dict], bool] = field(default=lambda r: True)

    def run(self, df: DataFrame) -> DataFrame:
        """One row: the label and the metrics."""
        return df.agg(*[m.alias(k) for k, m in self.metrics.items()]).select(F.lit(self.label[1]).alias(self.label[0]), *self.metrics)


def _at_least(metric: str, bound: float) -> Callable[[dict], bool]:
    return lambda r: r[metric] is not None and r[metric] >= bound


def null_check(column: str, least: float = 95) -> Check:
    c = F.col(column)
    return Check("null_check", ("column_name", column), {"total_rows": _n(), "non_null_count": F.count(c), "null_count": _n() - F.count(c), "completeness_percentage": _share(F.count(c), _n())}, _at_least("completeness_percentage", least))


def _over_non_null(name: str, column: str, good: Column, names: tuple[str, str, str], least: float) -> Check:
    c = F.col(column)
    return Check(name, ("column_name", column), {"total_rows": F.count(c), names[0]: _n(good), names[1]: _n(~good), names[2]: _share(_n(good), F.count(c))}, _at_least(names[2], least))


def empty_string_check(column: str, most: float = 5) -> Check:
    c = F.col(column)
    empty = F.trim(c) == ""
    return Check("empty_string_check", ("column_name", column), {"total_rows": F.count(c), "empty_string_count": _n(empty), "empty_string_percentage": _share(_n(empty), F.count(c))}, lambda r: (r["empty_string_percentage"] or 0) <= most)


def range_check(column: str, low: object, high: object, least: float = 95) -> Check:
    return _over_non_null("range_check", column, F.col(column).between(low, high), ("in_range_count", "out_of_range_count", "accuracy_percentage"), least)


def format_check(column: str, pattern: str, least: float = 95) -> Check:
    return _over_non_null("format_check", column, F.col(column).rlike(pattern), ("valid_format_count", "invalid_format_count", "format_accuracy_percentage"), least)


def domain_check(column: str, values: Sequence[object], least: float = 95) -> Check:
    return _over_non_null("domain_check", column, F.col(column).isin(*values), ("valid_count", "invalid_count", "validity_percentage"), least)


def length_check(column: str, low: int, high: int, least: float = 90) -> Check:
    return _over_non_null("length_check", column, F.length(column).between(low, high), ("valid_length_count", "invalid_length_count", "length_validity_percentage"), least)


def freshness_check(column: str, since: str, least: float = 80) -> Check:
    c, at = F.col(column), F.lit(since).cast("timestamp_ntz")
    return Check("freshness_check", ("timestamp_column", column), {"total_rows": F.count(c), "fresh_count": _n(c >= at), "stale_count": _n(c < at), "freshness_percentage": _share(_n(c >= at), F.count(c))}, _at_least("freshness_percentage", least))


def update_frequency_check(column: str, least: float = 1) -> Check:
    c = F.col(column)
    span = F.datediff(F.max(c), F.min(c)).cast("long")
    return Check("update_frequency_check", ("timestamp_column", column), {"total_rows": F.count(c), "latest_update": F.max(c), "earliest_update": F.min(c), "days_span": span, "avg_updates_per_day": F.round(F.try_divide(F.count(c), span), 4)}, _at_least("avg_updates_per_day", least))


def case_check(column: str) -> Check:
    c = F.col(column)
    same = F.countDistinct(c) == F.countDistinct(F.upper(c))
    return Check("case_check", ("column_name", column), {"total_rows": F.count(c), "unique_values": F.countDistinct(c), "unique_upper_values": F.countDistinct(F.upper(c)), "case_consistency": F.when(same, "consistent").otherwise("inconsistent")}, lambda r: r["case_consistency"] == "consistent")


def type_check(column: str) -> Check:
    c = F.col(column).cast("string")
    digits = c.rlike("^[0-9]+$")
    return Check("type_check", ("column_name", column), {"total_rows": F.count(c), "numeric_count": _n(digits), "non_numeric_count": _n(~digits), "type_consistency": F.when(_n(digits) == F.count(c), "consistent").otherwise("inconsistent")}, lambda r: r["type_consistency"] == "consistent")


def uniqueness_check(columns: Sequence[str]) -> Check:
    """Of one key column or several; several are compared as a tuple, so no joined text can collide."""
    key = F.col(columns[0]) if len(columns) == 1 else F.struct(*columns)
    label, unique = (("column_name", columns[0]), "unique_values") if len(columns) == 1 else (("composite_key", ",".join(columns)), "unique_combinations")
    distinct = F.countDistinct(key)
    return Check("uniqueness_check", label, {"total_rows": _n(), unique: distinct, "duplicate_count": _n() - distinct, "uniqueness_status": F.when(distinct == _n(), "unique").otherwise("duplicates")}, lambda r: r["uniqueness_status"] == "unique")


def business_rule(df: DataFrame, rule: str, description: str) -> DataFrame:
    """How many rows break a rule; a rule that is null is broken."""
    return df.agg(_n(~F.coalesce(F.expr(rule), F.lit(False))).alias("violation_count")).select(F.lit(description).alias("rule_description"), "violation_count")


def referential_integrity(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """How many child rows have no parent."""
    keys = parent.select(F.col(parent_key).alias("_parent")).distinct()
    return child.join(keys, F.col(child_key) == F.col("_parent"), "left_anti").agg(_n().alias("orphan_count"))


def row_validity(df: DataFrame, column: str, pattern: str) -> DataFrame:
    c = F.col(column).cast("string")
    return df.filter(c.isNotNull()).withColumn("validation_result", F.when(c.rlike(pattern), "valid").otherwise("invalid"))


def run_suite(df: DataFrame, checks: Sequence[Check]) -> list[dict]:
    """All checks in one pass; each with its metrics and whether it passes."""
    metrics = [m.alias(f"{k}|{name}") for k, c in enumerate(checks) for name, m in c.metrics.items()]
    one = df.agg(*metrics).first().asDict()
    out = []
    for k, c in enumerate(checks):
        row = {name: one[f"{k}|{name}"] for name in c.metrics}
        out.append({"check": c.name, c.label[0]: c.label[1], **row, "passed": bool(c.passes(row))})
    return out


def profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Of each column: rows, nulls and their share, distinct values, empty strings.

    One aggregate for all but the distinct values, which are counted from
    pairs of column and value; with ``approximate`` those come from sketches,
    in the same aggregate.
    """
    names = [f"`{f.name}`" for f in df.schema]
    aggs = []
    for k, f in enumerate(df.schema):
        c = F.col(names[k])
        empty = _n(F.trim(c) == "") if isinstance(f.dataType, T.StringType) else F.lit(0).cast("long")
        distinct = F.approx_count_distinct(c) if approximate else F.lit(None).cast("long")
        aggs.append(F.struct(F.lit(f.name).alias("column_name"), _n().alias("total_rows"), (_n() - F.count(c)).alias("null_count"), _share(_n() - F.count(c), _n()).alias("null_percentage"), distinct.alias("distinct_count"), empty.alias("empty_string_count")))
    out = df.agg(F.array(*aggs).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    if approximate:
        return out
    pairs = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(f.name).alias("column_name"), F.xxhash64(c).alias("a"), F.xxhash64(F.lit(1), F.col(c)).alias("b"))) for c, f in zip(names, df.schema)]))
    counts = df.select(F.explode(pairs).alias("p")).select("p.*").distinct().groupBy("column_name").agg(_n().alias("d"))
    return out.join(counts, "column_name", "left").select(*[F.coalesce("d", F.lit(0)).alias(c) if c == "distinct_count" else F.col(c) for c in out.columns])


def capped_profile(df: DataFrame, order_by: Sequence[str], max_rows: int = 10_000) -> DataFrame:
    """A profile of the first rows in a stated order."""
    return profile(df.orderBy(*order_by).limit(max_rows))


def schema_info(df: DataFrame) -> DataFrame:
    """position, column_name, data_type and nullable of all columns; no rows are read."""
    return df.sparkSession.createDataFrame([(k, f.name, f.dataType.simpleString(), f.nullable) for k, f in enumerate(df.schema)], "position int, column_name string, data_type string, nullable boolean")


def null_profile(df: DataFrame, threshold: float = 0.1) -> DataFrame:
    """As ``profile`` without distinct counts, and whether a column's nulls exceed the threshold."""
    aggs = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        empty = _n(F.trim(c) == "") if isinstance(f.dataType, T.StringType) else F.lit(0).cast("long")
        aggs.append(F.struct(F.lit(f.name).alias("column_name"), (_n() - F.count(c)).alias("null_count"), empty.alias("empty_string_count"), F.coalesce(F.try_divide(_n() - F.count(c), _n()) > threshold, F.lit(False)).alias("over_threshold")))
    return df.agg(F.array(*aggs).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def quality_score(df: DataFrame, threshold: float = 0.1) -> DataFrame:
    """100, less 10 for each column with too many nulls and 5 for each with empty strings; at least 0."""
    p = null_profile(df, threshold)
    score = 100 - 10 * _n(F.col("over_threshold")) - 5 * _n(F.col("empty_string_count") > 0)
    return p.agg(F.greatest(score, F.lit(0)).cast("long").alias("quality_score"))


def grade(null_percent: Column) -> Column:
    return F.when(null_percent < 5, "excellent").when(null_percent < 15, "good").otherwise("poor")


def freshness_grade(hours: Column) -> Column:
    return F.when(hours <= 6, "healthy").when(hours <= 12, "warning").otherwise("stale")


@dataclass
class Validation:
    """What a layer's validator found. ``strict`` raises where the score is under the threshold."""

    layer: str
    columns: list[dict]
    score: int
    recommendations: list[str]


def validate_layer(df: DataFrame, layer: str, threshold: float = 0.1, quality_threshold: float = 0.95, strict: bool = False, checks: Sequence[Check] = ()) -> Validation:
    columns = [r.asDict() for r in null_profile(df, threshold).collect()]
    score = max(0, 100 - 10 * sum(c["over_threshold"] for c in columns) - 5 * sum(c["empty_string_count"] > 0 for c in columns))
    advice = [f"column {c['column_name']} has many nulls" for c in columns if c["over_threshold"]] + [f"column {c['column_name']} has empty strings" for c in columns if c["empty_string_count"]]
    if checks:
        advice += [f"check {r['check']} failed" for r in run_suite(df, checks) if not r["passed"]]
    if score < quality_threshold * 100:
        advice.append(f"quality score {score} is under {quality_threshold * 100:g}")
        if strict:
            raise ValueError(f"{layer}: {'; '.join(advice)}")
    return Validation(layer, columns, score, advice)


def comprehensive(df: DataFrame, key: str, number: str, text: str) -> DataFrame:
    """Completeness of the table and three columns, and uniqueness of the key: five rows, one aggregate."""
    total = _n()

    def row(dimension: str, name: str, non_null: Column, score: Column) -> Column:
        return F.struct(F.lit(dimension).alias("quality_dimension"), F.lit(name).alias("column_name"), total.alias("total_rows"), non_null.alias("non_null_count"), (total - non_null).alias("null_count"), score.alias("quality_score"))

    rows = [row("completeness", "total", total, F.lit(100.0))]
    rows += [row("completeness", c, F.count(c), _share(F.count(c), total)) for c in (key, number, text)]
    rows.append(row("uniqueness", key, F.countDistinct(key), _share(F.countDistinct(key), total)))
    return df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def snapshot(df: DataFrame, at: str) -> DataFrame:
    """A profile stamped with its time, for monitoring across refreshes."""
    return profile(df).withColumn("snapshot_at", F.lit(at))


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes between two snapshots, by column."""
    a, b = before.alias("a"), after.alias("b")
    return a.join(b, "column_name", "full").select("column_name", (F.col("b.total_rows") - F.col("a.total_rows")).alias("rows_change"), (F.col("b.null_count") - F.col("a.null_count")).alias("null_change"), (F.col("b.distinct_count") - F.col("a.distinct_count")).alias("distinct_change"))


#: What each layer's validator wants: the share of nulls that a column may have, and the least score.
LAYERS = {"bronze": (0.5, 0.80), "silver": (0.1, 0.95), "gold": (0.0, 0.95)}


def validate_layers(tables: dict[str, DataFrame], checks: dict[str, Sequence[Check]] | None = None) -> tuple[list[Validation], float]:
    """Each layer by its own bounds, and the mean score."""
    found = [validate_layer(df, layer, *LAYERS[layer], checks=(checks or {}).get(layer, ())) for layer, df in tables.items()]
    return found, sum(v.score for v in found) / len(found) if found else 0.0


def metric_consistency(df: DataFrame, total: str, parts: Sequence[str], tolerance: float = 0.01) -> DataFrame:
    """Rows whose parts do not add up to their total."""
    whole = sum((F.coalesce(F.col(p), F.lit(0)) for p in parts[1:]), F.coalesce(F.col(parts[0]), F.lit(0)))
    return df.agg(_n().alias("total_rows"), _n(~F.coalesce(F.abs(F.col(total) - whole) <= tolerance, F.lit(False))).alias("inconsistent_rows"))


def aggregation_accuracy(detail: DataFrame, summary: DataFrame, keys: Sequence[str], value: str, total: str, tolerance: float = 0.01) -> DataFrame:
    """Groups of a summary that differ from, or are missing against, the detail's sums."""
    want = detail.groupBy(*keys).agg(F.sum(F.col(value).cast("decimal(28,6)")).cast("double").alias("_want"))
    both = want.join(summary.select(*keys, F.col(total).alias("_have")), list(keys), "full")
    good = F.coalesce(F.abs(F.col("_want") - F.col("_have")) <= tolerance, F.lit(False))
    return both.agg(_n().alias("groups"), _n(~good).alias("wrong_groups"))


def trend(df: DataFrame, period: str, value: Column, limit: float = 0.5) -> DataFrame:
    """Of each period: its value, the share by which it differs from the one before, and whether that exceeds the limit."""
    rows = df.groupBy(period).agg(value.alias("value"))
    before = F.lag("value").over(Window.orderBy(period))  # one row for each period
    change = F.round(F.try_divide(F.col("value") - F.col("before"), F.col("before")), 4)
    return rows.withColumn("before", before).select(period, "value", change.alias("change"), F.coalesce(F.abs(change) > limit, F.lit(False)).alias("anomaly"))
