"""Chart data and cost reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def column_kinds(df: DataFrame) -> dict[str, list[str]]:
    """Numeric, date and category columns, by schema."""
    out: dict[str, list[str]] = {"numeric": [], "date": [], "category": []}
    for f in df.schema:
        kind = "numeric" if isinstance(f.dataType, T.NumericType) else "date" if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "category"
        out[kind].append(f.name)
    return out


def suggest_charts(df: DataFrame) -> list[str]:
    k = column_kinds(df)
    found = []
    if k["date"] and k["numeric"]:
        found.append("line")
    if k["category"] and k["numeric"]:
        found += ["bar", "box"]
    if len(k["numeric"]) > 1:
        found.append("scatter")
    if k["numeric"]:
        found.append("histogram")
    if k["category"]:
        found.append("pie")
    return found


def histogram(df: DataFrame, column: str, width: float) -> DataFrame:
    return df.groupBy((F.floor(F.col(column) / width) * width).cast("double").alias("bin_start")).agg(F.count(F.lit(1)).alias("n"))


def pie(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def bar(df: DataFrame, category: str, value: str) -> DataFrame:
    return df.groupBy(category).agg(F.sum(F.col(value).cast("decimal(18,2)")).cast("double").alias("total"))


def box(df: DataFrame, by: str, column: str) -> DataFrame:
    q = lambda p: F.round(F.percentile(column, F.lit(p)), 4)
    return df.groupBy(by).agg(F.min(column).alias("low"), q(0.25).alias("q1"), q(0.5).alias("q2"), q(0.75).alias("q3"), F.max(column).alias("high"))


def line(df: DataFrame, date: str, value: str) -> DataFrame:
    return df.groupBy(F.to_date(date).alias("day")).agg(F.sum(F.col(value).cast("decimal(18,2)")).cast("double").alias("total"))


def scatter(df: DataFrame, x: str, y: str, most: int = 1000) -> DataFrame:
    """Points for a plot; the bound is the chart's."""
    return df.select(x, y).orderBy(x, y).limit(most)


def monthly_cost(df: DataFrame, service: str, at: str, cost: str) -> DataFrame:
    c = F.sum(F.col(cost).cast("decimal(18,2)"))
    days = F.countDistinct(F.to_date(at))
    return df.groupBy(F.col(service).alias("service"), F.year(at).cast("long").alias("year"), F.month(at).cast("long").alias("month")).agg(c.cast("double").alias("total_cost"), days.alias("active_days"), (c.cast("double") / days).alias("avg_daily_cost"))


def credit_sum(credits: Column, kinds: list[str] | None = None) -> Column:
    """The sum of a row's credits, or of those of some types; no join, no unnesting."""
    chosen = F.filter(credits, lambda x: x["type"].isin(*kinds)) if kinds else credits
    return F.aggregate(chosen, F.lit(0).cast("decimal(18,2)"), lambda acc, x: (acc + F.coalesce(x["amount"].cast("decimal(18,2)"), F.lit(0))).cast("decimal(18,2)"))


def daily_cost(df: DataFrame, service: str | None, at: str, cost: str, credits: str, since: str | None = None) -> DataFrame:
    """Costs, discounts and savings by day, of one service or all, from a day on or ever."""
    rows = df
    if service is not None:
        rows = rows.filter(F.col("service") == service)
    if since is not None:
        rows = rows.filter(F.to_date(at) >= F.lit(since).cast("date"))
    total = lambda c: F.sum(c).cast("double")
    gross, discount, saved = F.col(cost).cast("decimal(18,2)"), credit_sum(F.col(credits), ["DISCOUNT"]), credit_sum(F.col(credits))
    return rows.groupBy(F.to_date(at).alias("day")).agg(total(gross).alias("gross_cost"), total(discount).alias("discount"), total(saved).alias("all_credits"), total(gross + saved).alias("net_cost"))


def threshold_alert(df: DataFrame, cost: str, limit: float, early: float = 0.8) -> DataFrame:
    """alert at the limit, warning at a share of it, else ok."""
    c = F.col(cost)
    return df.withColumn("alert", F.when(c >= limit, "alert").when(c >= early * limit, "warning").otherwise("ok"))


def current_month(df: DataFrame, service: str, at: str, cost: str, today: str | None = None) -> DataFrame:
    """Costs by service in the month of a day, today where none is given."""
    day = F.current_date() if today is None else F.lit(today).cast("date")
    inside = df.filter(F.date_trunc("month", at).cast("date") == F.date_trunc("month", day).cast("date"))
    return inside.groupBy(F.col(service).alias("service")).agg(F.sum(F.col(cost).cast("decimal(18,2)")).cast("double").alias("total_cost"))


def charts(df: DataFrame) -> DataFrame:
    """column_name and kind of all columns."""
    rows = sorted((c, k) for k, cs in column_kinds(df).items() for c in cs)
    return df.sparkSession.createDataFrame(rows, "column_name string, kind string")
