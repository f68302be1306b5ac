"""Aggregations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FUNCTIONS = {"sum": F.sum, "avg": F.avg, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count, "count_distinct": F.countDistinct}


def money_sum(column: Column) -> Column:
    """An exact sum of amounts with two decimals, the same however rows are dealt out.

    Cents are summed as two whole numbers, the upper bits and the lower 20:
    sums of 64-bit numbers take a fraction of the time that wide decimals do,
    and neither part overflows before 2**43 rows.
    """
    cents = F.rint(column.cast("double") * 100).cast("long")
    high, low = F.sum(F.shiftright(cents, 20)), F.sum(cents.bitwiseAND(F.lit((1 << 20) - 1).cast("long")))
    return ((high.cast("decimal(20,0)") * F.lit(1 << 20).cast("decimal(7,0)") + low.cast("decimal(20,0)")) * F.lit("0.01").cast("decimal(2,2)")).cast("double")


def group_agg(df: DataFrame, group_by: Sequence[str], aggregations: Mapping[str, str | Sequence[str]]) -> DataFrame:
    """{column}_{function} for each of a column's functions; missing columns are skipped; without aggregations the input passes."""
    wanted = [(c, f) for c, fs in aggregations.items() if c in df.columns for f in ([fs] if isinstance(fs, str) else fs)]
    aggs = [_FUNCTIONS[f](F.col(c)).alias(f"{c}_{f}") for c, f in wanted]
    return df.groupBy(*group_by).agg(*aggs) if aggs else df


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def sum_where(condition: Column, value: Column) -> Column:
    return money_sum(F.when(condition, value).otherwise(0))


def kpis(df: DataFrame, amount: str) -> DataFrame:
    return df.agg(money_sum(F.col(amount)).alias("total_amount"), F.round(F.avg(amount), 4).alias("avg_amount"), F.count(F.lit(1)).alias("n_rows"))


def value_kpis(value: str, prefix: str = "") -> list[Column]:
    c = F.col(value)
    return [F.count(F.lit(1)).alias(f"{prefix}total"), money_sum(c).alias(f"{prefix}sum"), F.round(money_sum(c) / F.count(c), 4).alias(f"{prefix}avg"), F.max(c).alias(f"{prefix}max"), F.min(c).alias(f"{prefix}min")]


def time_series(df: DataFrame, unit: str, timestamp: str, start: str, end: str, aggs: Sequence[Column]) -> DataFrame:
    """Aggregates by truncated time over [start, end)."""
    t = F.col(timestamp)
    inside = df.filter((t >= F.lit(start).cast("timestamp_ntz")) & (t < F.lit(end).cast("timestamp_ntz")))
    return inside.groupBy(F.to_date(F.date_trunc(unit, t)).alias("period")).agg(*aggs)


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrence_count")).filter("occurrence_count > 1")


def at_most_one(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg((F.max("n") <= 1).alias("at_most_one"))


def value_counts(df: DataFrame, column: str, top: int = 5) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(column)).limit(top)


def pivot_sum(df: DataFrame, by: Sequence[str], on: str, values: Sequence[str], value: str) -> DataFrame:
    """The values are given, so no pass looks for them."""
    return df.groupBy(*by).pivot(on, list(values)).agg(F.sum(value))


def summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, min, quartiles and max of each column, one row each, from one aggregate."""
    stats = {"count": F.count, "min": F.min, "q25": lambda c: F.percentile(c, F.lit(0.25)), "q50": lambda c: F.percentile(c, F.lit(0.5)), "q75": lambda c: F.percentile(c, F.lit(0.75)), "max": F.max}
    one = df.agg(*[f(c).cast("double").alias(f"{c}|{s}") for c in columns for s, f in stats.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.round(F.col(f"`{c}|{s}`"), 4).alias(f"stat_{s}") for s in stats]) for c in columns])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def distinct_counts(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """How many distinct values each column has, by keys or in all.

    Rows become (column, hash) pairs, of which each is counted once: several
    distinct counts in one aggregate would shuffle whole rows once for each.
    128 bits tell values apart.
    """
    pairs = F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(k).alias("k"), F.xxhash64(c).alias("a"), F.xxhash64(F.lit(1), F.col(c)).alias("b"))) for k, c in enumerate(columns)])
    each = df.select(*keys, F.explode(F.array_compact(pairs)).alias("p")).select(*keys, "p.*").distinct()
    out = each.groupBy(*keys).agg(*[F.count(F.when(F.col("k") == k, 1)).alias(c) for k, c in enumerate(columns)])
    return out
