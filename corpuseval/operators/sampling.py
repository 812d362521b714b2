"""Reproducible samples: rows in the order of md5(seed:key), the same in any partitioning."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuseval.operators.reshape import number_rows


def draw(seed: int, *keys: str | Column) -> Column:
    """The key of a uniform order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys)))


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return df.withColumn("_nth", nth).where(F.col("_nth") <= n).drop("_nth")


def balance_random(df: DataFrame, groups: Sequence[str], n: int, seed: int, key: str) -> DataFrame:
    """F2. At most ``n`` random rows of each class."""
    return top_per_group(df, groups, [draw(seed, key), F.col(key)], n)


def balance_recent(df: DataFrame, groups: Sequence[str], n: int, year: str, key: str) -> DataFrame:
    """F3. At most ``n`` rows of each class, newest first; a year that cannot be read counts as -1."""
    return top_per_group(df, groups, [F.coalesce(F.col(year).cast("string").try_cast("int"), F.lit(-1)).desc(), F.col(key)], n)


def seeded_shuffle(df: DataFrame, seed: int, key: str) -> DataFrame:
    """F4. All rows in a random order."""
    return df.orderBy(draw(seed, key), key)


def mark_fraction(df: DataFrame, hit: Column, fraction: float, column: str, value: str, seed: int, key: str) -> DataFrame:
    """F5. Exactly floor(n x fraction) of the n matching rows get a new value.

    Matching rows are numbered by ranges of the random order, so no task ranks them all.
    """
    if not 0 < fraction <= 1:
        raise ValueError("fraction is over 0 and at most 1")
    hit = F.coalesce(hit, F.lit(False))
    numbered = number_rows(df.where(hit).withColumn("_draw", draw(seed, key)), "_draw", key)
    chosen = F.col("row_no") <= math.floor(df.where(hit).count() * fraction)
    marked = numbered.withColumn(column, F.when(chosen, F.lit(value)).otherwise(F.col(column))).select(*df.columns)
    return df.where(~hit).unionByName(marked)


def top_up_split(df: DataFrame, groups: Sequence[str], n: int, seed: int, key: str, split: str = "split", strict: bool = True) -> DataFrame:
    """F6. Each group's validate rows filled up to ``n``, all others train; ``strict`` raises where a group is too small.

    Only the first ``n`` candidates of a group are ranked; the rows that are promoted are joined back by ``key``.
    """
    is_validate = F.coalesce(F.col(split) == "validate", F.lit(False))
    counts = df.groupBy(*groups).agg(F.count_if(is_validate).alias("_have"), F.count("*").alias("_all"))
    if strict and counts.where(F.col("_all") < n).take(1):
        raise ValueError("a group has fewer rows than are asked for")
    order = Window.partitionBy(*groups).orderBy(draw(seed, key), key)
    ranked = df.where(~is_validate).select(*groups, key).withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= n)
    promoted = ranked.join(counts, list(groups)).where(F.col("_nth") <= n - F.col("_have")).select(key, F.lit(True).alias("_up"))
    new = F.when(is_validate | F.col("_up"), "validate").otherwise("train")
    return df.join(promoted, key, "left").withColumn(split, new).select(*df.columns)


def sample_by_quota(df: DataFrame, quotas: DataFrame, keys: Sequence[str], seed: int, key: str) -> DataFrame:
    """F11. As many random rows of each group as its ``quota`` says."""
    most = quotas.agg(F.max("quota")).first()[0] or 0  # a literal bound lets each task cut its groups before the shuffle
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(draw(seed, key), key))
    rows = df.join(quotas.select(*keys, "quota"), list(keys)).withColumn("_nth", nth)
    return rows.where((F.col("_nth") <= int(most)) & (F.col("_nth") <= F.col("quota"))).drop("_nth", "quota")


def cap_sample(df: DataFrame, cap: int, seed: int, key: str) -> DataFrame:
    """F12. A random sample of ``cap`` rows, or all if there are fewer; ``key`` names a row.

    Only the random order is numbered, by ranges; the row in place ``cap`` bounds the sample.
    """
    order = F.struct(draw(seed, key).alias("_draw"), F.col(key).alias("_key"))
    last = number_rows(df.select(order.alias("_order")).select("_order.*"), "_draw", "_key").where(F.col("row_no") == cap).first()
    if cap < 1:
        return df.limit(0)
    return df if last is None else df.where((draw(seed, key) < last["_draw"]) | ((draw(seed, key) == last["_draw"]) & (F.coalesce(F.col(key) <= F.lit(last["_key"]), F.lit(True)))))


def mark_kept(df: DataFrame, kept: DataFrame, key: str, scope: Column, flag: str = "abort") -> DataFrame:
    """F13. In scope, rows that were kept clear the flag and all others set it."""
    rows = df.join(kept.select(key).distinct().withColumn("_kept", F.lit(True)), key, "left")
    return rows.withColumn(flag, F.when(F.coalesce(scope, F.lit(False)), F.col("_kept").isNull()).otherwise(F.col(flag))).drop("_kept")


def best_candidate(df: DataFrame, group: str, candidate: str, score: str) -> DataFrame:
    """F16. The candidate of the highest score, the smallest of several."""
    return df.groupBy(group).agg(F.max_by(candidate, F.struct(F.col(score), -F.col(candidate))).alias(candidate), F.max(score).alias(score))
