"""Projections, filters, set operations and deduplication, as functions of a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CASTS = {"string": "string", "integer": "int", "double": "double", "timestamp": "timestamp", "date": "date"}
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"


def _named(df: DataFrame, exprs: Mapping[str, Column]) -> DataFrame:
    """Replaces columns in one projection."""
    return df.select(*[exprs.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns])


def add_metadata(df: DataFrame, source: str, layer: str, prefix: str = "_") -> DataFrame:
    now = F.current_timestamp()
    return df.withColumns({f"{prefix}ingestion_timestamp": now, f"{prefix}source_path": F.lit(source), f"{prefix}data_layer": F.lit(layer), f"{prefix}processing_date": now.cast("date")})


def clean_strings(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Trims and upper-cases string columns."""
    wanted = {f.name for f in df.schema if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns)}
    return _named(df, {c: F.trim(F.upper(F.col(f"`{c}`"))) for c in wanted})


def handle_nulls(df: DataFrame, strategy: Mapping[str, str] | None = None) -> DataFrame:
    """drop, fill_default, fill_mean or fill_median for each column; defaults fill all where none is given.

    Means and medians come from one aggregate over the input.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    if strategy is None:
        strategy = {c: "fill_default" for c, t in kinds.items() if isinstance(t, (T.StringType, T.NumericType))}
    unknown = {s for s in strategy.values()} - {"drop", "fill_default", "fill_mean", "fill_median"}
    if unknown:
        raise ValueError(f"unknown strategies: {sorted(unknown)}")
    strategy = {c: s for c, s in strategy.items() if c in kinds}
    stats = {c: (F.avg(c) if s == "fill_mean" else F.percentile(c, F.lit(0.5))).alias(c) for c, s in strategy.items() if s in ("fill_mean", "fill_median")}
    fills: dict[str, Column] = {}
    if stats:
        one = df.agg(*stats.values()).first()
        fills = {c: F.coalesce(F.col(c), F.lit(one[c]).cast("double")) if one[c] is not None else F.col(c) for c in stats}
    for c, s in strategy.items():
        if s == "fill_default":
            if isinstance(kinds[c], T.StringType):
                fills[c] = F.coalesce(F.col(c), F.lit("UNKNOWN"))
            elif isinstance(kinds[c], T.NumericType):
                fills[c] = F.coalesce(F.col(c), F.lit(0).cast(kinds[c]))
            else:
                raise TypeError(f"no default for {c}: {kinds[c].simpleString()}")
    drops = [c for c, s in strategy.items() if s == "drop"]
    return _named(df.na.drop(subset=drops) if drops else df, fills)


def convert_types(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Casts what can be cast, null otherwise; unknown types and columns are skipped."""
    return _named(df, {c: F.col(c).try_cast(_CASTS[t]) for c, t in mapping.items() if c in df.columns and t in _CASTS})


def filter_data(df: DataFrame, conditions: Mapping[str, Mapping[str, object]]) -> DataFrame:
    """All conditions hold; rows for which one is null go; unknown columns are ignored."""
    ops: dict[str, Callable[[Column, object], Column]] = {
        "equals": lambda c, v: c == v,
        "not_equals": lambda c, v: c != v,
        "greater_than": lambda c, v: c > v,
        "less_than": lambda c, v: c < v,
        "contains": lambda c, v: c.contains(v),
        "not_contains": lambda c, v: ~c.contains(v),
    }
    for column, tests in conditions.items():
        if column in df.columns:
            for op, value in tests.items():
                df = df.filter(ops[op](F.col(column), value))
    return df


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def select_existing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing columns: {missing}")
    return df


def optional_equals(df: DataFrame, column: str, value: object | None) -> DataFrame:
    """Filters only where a value is given; 0 is one."""
    return df if value is None else df.filter(F.col(column) == F.lit(value))


def date_range(df: DataFrame, start: str, end: str) -> DataFrame:
    """Filters on the first date or timestamp column, if there is one."""
    kinds = (T.DateType, T.TimestampType, T.TimestampNTZType)
    found = next((f.name for f in df.schema if isinstance(f.dataType, kinds)), None)
    return df if found is None else df.filter(F.col(found).cast("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def tier(column: Column, high: float, medium: float, labels: tuple[str, str, str] = ("high_value", "medium_value", "low_value"), inclusive: bool = False) -> Column:
    at = (lambda v: column >= v) if inclusive else (lambda v: column > v)
    return F.when(at(high), labels[0]).when(at(medium), labels[1]).otherwise(labels[2])


def flag(condition: Column, yes: str = "valid", no: str = "invalid") -> Column:
    return F.when(condition, yes).otherwise(no)


def severity(column: Column, high: Sequence[str], medium: Sequence[str]) -> Column:
    """LIKE-based classes."""
    has = lambda words: F.greatest(*[column.contains(w) for w in words]) if len(words) > 1 else column.contains(words[0])
    return F.when(has(high), "high_severity").when(has(medium), "medium_severity").otherwise("low_severity")


def taxi_flags(df: DataFrame, passengers: str, distance: str, tolls: str) -> DataFrame:
    return df.withColumns({"passenger_type": F.when(F.col(passengers) > 1, "multi").otherwise("single"), "has_tolls": F.col(tolls) > 0, "distance_ceil": F.ceil(distance)})


def drop_anomalies(df: DataFrame, distance: str, amount: str) -> DataFrame:
    d, a = F.col(distance), F.col(amount)
    return df.filter((d > 0) & (a > 0) & ~((d < 5) & (a > 100)))


def deduplicate(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column | str], keep: str = "first") -> DataFrame:
    """One row of each key: the first or last in a stated order, so that reruns agree.

    One window, of which the filter on its row number keeps one row of each
    key before the shuffle too. Names mean rising order, and the last row is
    the first in falling order.
    """
    if keep not in ("first", "last"):
        raise ValueError(keep)
    if not order_by:
        raise ValueError("order_by is needed: without it the row that stays is left to chance")
    order, by = list(order_by), Window.partitionBy(*keys)
    if keep == "last" and all(isinstance(o, str) for o in order):
        order = [F.col(o).desc_nulls_last() for o in order]
    elif keep == "last":
        return df.withColumn("_rn", F.row_number().over(by.orderBy(*order))).withColumn("_n", F.count(F.lit(1)).over(by)).filter("_rn = _n").drop("_rn", "_n")
    return df.withColumn("_rn", F.row_number().over(by.orderBy(*order))).filter("_rn = 1").drop("_rn")


def _extreme(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], pick: Callable) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    one = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order_by)).alias("_row"))
    return one.select(*[F.col(f"`{c}`") if c in keys else F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def latest_by_key(df: DataFrame, keys: Sequence[str], timestamp: str, tiebreak: Sequence[str] = ()) -> DataFrame:
    """The newest row of each key, aggregated before the shuffle; rows without a time are the oldest."""
    return _extreme(df, keys, [timestamp, *tiebreak], F.max_by)


def data_cleaning(df: DataFrame, email: str) -> DataFrame:
    return df.withColumn("email_validity", flag(F.coalesce(F.col(email).rlike(EMAIL), F.lit(False))))


def flatten_struct(df: DataFrame, column: str) -> DataFrame:
    """Replaces one struct column by its fields, named column_field."""
    fields = df.schema[column].dataType.fieldNames()
    return df.select(*[c for c in df.columns if c != column], *[F.col(f"{column}.{f}").alias(f"{column}_{f}") for f in fields])


def flatten_structs(df: DataFrame) -> DataFrame:
    """Replaces all struct columns, however deep, in one projection."""
    out: list[Column] = []

    def walk(kind: T.StructType, path: list[str]) -> None:
        for f in kind:
            here = [*path, f.name]
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, here)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in here)).alias("_".join(here)))

    walk(df.schema, [])
    return df.select(*out)


def validate_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    have = [(f.name, f.dataType) for f in df.schema]
    want = [(f.name, f.dataType) for f in expected]
    if have != want:
        raise ValueError(f"schema differs: {have} is not {want}")
    return df
