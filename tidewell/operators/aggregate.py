"""Distributions, shares, coverage and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distribution(df: DataFrame, column: Column | str, default: str = "unknown", keys: list[str] = ()) -> DataFrame:
    """(keys, value, n): counts by value, null and blank as the default."""
    c = F.col(column) if isinstance(column, str) else column
    value = F.when(c.isNull() | (F.trim(c.cast("string")) == ""), default).otherwise(c.cast("string"))
    return df.groupBy(*keys, value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def element_distribution(df: DataFrame, column: str, keys: list[str] = ()) -> DataFrame:
    """(keys, value, n): counts of array elements."""
    return df.select(*keys, F.explode(column).alias("value")).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))


def global_and_groups(df: DataFrame, group: str, value: str) -> DataFrame:
    """(grp, value, n): counts by value over everything (grp null) and in each group, in one pass."""
    return df.groupingSets([[value], [group, value]], group, value).agg(F.grouping(group).alias("is_total"), F.count(F.lit(1)).alias("n")).select(F.col("is_total").cast("int").alias("is_total"), F.col(group).alias("grp"), F.col(value).alias("value"), "n")


def most_common(df: DataFrame, keys: list[str], value: str, ordinal: str) -> DataFrame:
    """(keys, value, n): the commonest value of each key; ties to the one seen first."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(ordinal).alias("__first"))
    best = F.min_by(F.struct(F.col(value).alias("value"), "n"), F.struct(-F.col("n"), "__first", F.col(value)))
    return counts.groupBy(*keys).agg(best.alias("r")).select(*keys, "r.*")


def describe(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, low, median, mean, high), 4 places."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("low"), F.round(F.percentile(value, 0.5), 4).alias("median"), F.round(F.avg(value), 4).alias("mean"), F.max(value).alias("high"))


def rate(cond: Column, places: int = 4) -> Column:
    """Share of rows where the condition holds; 0.0 without rows."""
    return F.coalesce(F.round(F.avg(F.when(F.coalesce(cond, F.lit(False)), 1.0).otherwise(0.0)), places), F.lit(0.0))


def shares(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, n, share) within each group; totals from a second aggregation, not from a window over rows."""
    n = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy(F.col(group).alias("__g")).agg(F.sum("n").alias("__total"))
    return n.join(total, n[group].eqNullSafe(total["__g"])).select(group, value, "n", F.round(F.col("n") / F.col("__total"), 4).alias("share"))


def surplus(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, surplus): rows beyond the distinct values, where there are any."""
    return df.groupBy(*keys).agg((F.count(value) - F.countDistinct(value)).alias("surplus")).where("surplus > 0")


def coverage(df: DataFrame, key: str, stakeholders: str, stances: str, stage: str, source: str, url: str, expected_stages: int = 3, neutral: str = "中立") -> DataFrame:
    """Coverage of each event: distinct labels, official and interaction sources, traceability, redundancy and gate."""
    out = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(stakeholders).alias("n_stakeholders"), F.countDistinct(stances).alias("n_stances"),
        F.countDistinct(F.when(F.col(stances) != neutral, F.col(stances))).alias("n_pointed_stances"), F.countDistinct(stage).alias("n_stages"),
        F.coalesce(F.bool_or(F.col(source) == "official"), F.lit(False)).alias("has_official"), F.coalesce(F.bool_or(F.col(source) == "public_interaction"), F.lit(False)).alias("has_interaction"),
        F.round(F.avg(F.when(F.col(url).isNotNull(), 1.0).otherwise(0.0)), 4).alias("traceability"), F.round(1 - F.countDistinct(url) / F.greatest(F.count(url), F.lit(1)), 4).alias("redundancy"),
    )
    ok = (F.col("n_stakeholders") >= 2) & (F.col("n_stances") >= 2) & (F.col("n_pointed_stances") >= 1) & (F.col("n_stages") >= expected_stages) & F.col("has_official") & F.col("has_interaction")
    return out.withColumn("covered", ok)
