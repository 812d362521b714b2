"""Profiles of a collection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def crosstab_with_totals(df: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    """E1. Counts by row and column value, with the row total (values without a column too), share of all, and a ``TOTAL`` row."""
    cells = [F.count_if(F.col(col) == v).alias(v) for v in values]
    table = df.rollup(row).agg(F.grouping(row).alias("_all"), *cells, F.count("*").alias("total"))
    return table.withColumn("share", F.try_divide(100.0 * F.col("total"), F.lit(df.count()))).withColumn(row, F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col(row))).drop("_all")


def group_profile(df: DataFrame, keys: Sequence[str], distinct: str) -> DataFrame:
    """E2. Rows and distinct values of a column for each group."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(distinct).alias("n_distinct"))


def value_counts(df: DataFrame, *keys: str) -> DataFrame:
    """E3. Rows for each combination."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def per_group_summary(counts: DataFrame, key: str) -> DataFrame:
    """E3. Groups, total and mean of a count table."""
    return counts.groupBy(key).agg(F.count("*").alias("groups"), F.sum("n").alias("total"), F.avg("n").alias("mean"))


def counts_with_total(df: DataFrame, key: str) -> DataFrame:
    """E4. Rows for each value and a ``TOTAL`` row."""
    table = df.rollup(key).agg(F.grouping(key).alias("_all"), F.count("*").alias("n"))
    return table.select(F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col(key)).alias(key), "n")


def shares(df: DataFrame, key: str) -> DataFrame:
    """E5. Rows for each value and their percentage."""
    return df.groupBy(key).agg(F.count("*").alias("n")).withColumn("percent", F.try_divide(100.0 * F.col("n"), F.lit(df.count())))


def top_values(df: DataFrame, key: str, n: int = 20) -> DataFrame:
    """E6. The commonest values, ties by name."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)


def wrong_rate(df: DataFrame, key: str, wrong: Column) -> DataFrame:
    """E7. Wrong rows, all rows and percentage of each group."""
    hit = F.coalesce(wrong, F.lit(False))
    return df.groupBy(key).agg(F.count_if(hit).alias("wrong"), F.count("*").alias("total")).withColumn("percent", 100.0 * F.col("wrong") / F.col("total"))


def year_histogram(original: DataFrame, quota: DataFrame, kept: DataFrame, year: str, current: int) -> DataFrame:
    """E8. Rows, quota and kept rows of each year, a null year counted as the current one; ``rising`` if kept does not fall."""
    count = lambda df, n: df.groupBy(F.coalesce(year, F.lit(current)).alias(year)).agg(F.count("*").alias(n))
    table = count(original, "original").join(quota.groupBy(year).agg(F.sum("quota").alias("quota")), year, "full").join(count(kept, "kept"), year, "full").na.fill(0, ["original", "quota", "kept"])
    return table.withColumn("rising", F.coalesce(F.col("kept") >= F.lag("kept").over(Window.orderBy(year)), F.lit(True)))


def coverage_summary(df: DataFrame, **conditions: Column) -> DataFrame:
    """E9. One row: all rows, and those for which each condition holds."""
    return df.agg(F.count("*").alias("total"), *(F.count_if(c).alias(n) for n, c in conditions.items()))


def outcome_counts(df: DataFrame, outcome: Column) -> DataFrame:
    """E23, E24. Rows by what happened to them."""
    return df.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))
