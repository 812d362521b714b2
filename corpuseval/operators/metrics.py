"""Classification, pairwise and leaderboard metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuseval.functions.labels import TIERS


def _div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def accuracy_top(df: DataFrame, keys: Sequence[str], truth: str, top1: str, top2: str) -> DataFrame:
    """E10. Shares of all rows whose truth text contains the first, or the first or second, prediction, in any case."""
    inside = lambda p: F.coalesce((F.col(p) != "") & F.lower(F.col(truth)).contains(F.lower(F.col(p))), F.lit(False))
    return df.groupBy(*keys).agg(F.avg(inside(top1).cast("int")).alias("accuracy_top1"), F.avg((inside(top1) | inside(top2)).cast("int")).alias("accuracy_top1_or_top2"))


def accuracy_match(df: DataFrame, keys: Sequence[str], is_match: str, average: str) -> DataFrame:
    """E11, E12. Share of true match flags over all rows, and the mean of the averages that are there."""
    return df.groupBy(*keys).agg(F.avg(F.coalesce(F.col(is_match), F.lit(False)).cast("int")).alias("accuracy_text_match"), F.avg(average).alias("accuracy_avg"))


def mode_select(df: DataFrame, keys: Sequence[str], average: str, top1: str, is_match: str) -> DataFrame:
    """E13. How a set is scored: by averages if any row has one, else by scores, else by match flags."""
    has = lambda c: F.coalesce(F.bool_or(F.col(c).isNotNull()), F.lit(False))
    return df.groupBy(*keys).agg(F.when(has(average), "avg").when(has(top1), "logp").when(has(is_match), "text").otherwise("none").alias("mode"))


def label_prf(df: DataFrame, keys: Sequence[str], truth: str, prediction: str, labels: Sequence[str] = TIERS) -> DataFrame:
    """E14. Precision, recall, F1 and support of each label; rows without a prediction are skipped. Truth and prediction count in any case."""
    each = df.where(F.col(prediction).isNotNull() & (F.col(prediction) != "")).withColumn("label", F.explode(F.array(*map(F.lit, labels))))
    is_true, is_pred = F.coalesce(F.lower(F.col(truth)) == F.col("label"), F.lit(False)), F.lower(F.col(prediction)) == F.col("label")
    sums = each.groupBy(*keys, "label").agg(F.count_if(is_true & is_pred).cast("double").alias("tp"), F.count_if(~is_true & is_pred).cast("double").alias("fp"), F.count_if(is_true & ~is_pred).cast("double").alias("fn"))
    return _prf(sums, keys)


def label_prf_soft(df: DataFrame, keys: Sequence[str], truth: str, votes: str, labels: Sequence[str] = TIERS) -> DataFrame:
    """E15. As E14, each vote adding its share of all votes that are there; an item without votes is one miss of its label. The truth counts in any case, votes as they are."""
    given = F.filter(F.col(votes), lambda v: F.coalesce(v != "", F.lit(False)))
    each = df.withColumn("_votes", given).withColumn("label", F.explode(F.array(*map(F.lit, labels))))
    share = _div(F.size(F.filter("_votes", lambda v: v == F.col("label"))).cast("double"), F.size("_votes"))
    is_true = F.coalesce(F.lower(F.col(truth)) == F.col("label"), F.lit(False))
    sums = each.groupBy(*keys, "label").agg(F.sum(F.when(is_true, share).otherwise(0.0)).alias("tp"), F.sum(F.when(~is_true, share).otherwise(0.0)).alias("fp"), F.sum(F.when(is_true, 1 - share).otherwise(0.0)).alias("fn"))
    return _prf(sums, keys)


def _prf(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    p, r = _div(F.col("tp"), F.col("tp") + F.col("fp")), _div(F.col("tp"), F.col("tp") + F.col("fn"))
    rows = sums.withColumn("precision", p).withColumn("recall", r)
    f1 = _div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return rows.select(*keys, "label", "precision", "recall", f1.alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def macro(prf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """E16. Mean recall and mean F1 over labels with support."""
    there = F.col("support") > 0
    return prf.groupBy(*keys).agg(F.coalesce(F.avg(F.when(there, F.col("recall"))), F.lit(0.0)).alias("balanced_accuracy"), F.coalesce(F.avg(F.when(there, F.col("f1"))), F.lit(0.0)).alias("macro_f1"))


def confusion_matrix(df: DataFrame, truth: str, prediction: str, labels: Sequence[str] = TIERS) -> DataFrame:
    """E17. Counts of predictions (columns) for each true label."""
    return df.where(F.col(truth).isNotNull()).groupBy(truth).pivot(prediction, list(labels)).agg(F.count(F.lit(1))).na.fill(0)


def leaderboard(df: DataFrame, subject: str, model: str, truth: str, label: str, source: str, labels: Sequence[str] = TIERS) -> DataFrame:
    """E18. Rows, accuracy and macro F1 (percent, over all labels) and the commonest source of each subject and model."""
    # Conditions of the sums, not a filter: that would be pushed below the parsing of labels and parse each row twice.
    known, told = F.col(truth).isin(*labels), F.col(label).isNotNull()
    counts = [f(t).alias(f"{n}_{k}") for k, t in enumerate(labels) for n, f in (("tp", lambda t: F.count_if((F.col(truth) == t) & (F.col(label) == t))), ("t", lambda t: F.count_if((F.col(truth) == t) & told)), ("p", lambda t: F.count_if(known & (F.col(label) == t))))]
    sums = df.groupBy(subject, model).agg(F.count_if(known & told).alias("n"), F.count_if(known & (F.col(truth) == F.col(label))).alias("right"), F.mode(F.when(known & told, F.col(source)), True).alias("source"), *counts).where("n > 0")
    f1 = sum((_div(2.0 * F.col(f"tp_{k}"), F.col(f"t_{k}") + F.col(f"p_{k}")) for k in range(len(labels))), F.lit(0.0)) / len(labels)
    return sums.select(subject, model, "n", (100.0 * F.col("right") / F.col("n")).alias("accuracy"), (100.0 * f1).alias("macro_f1"), "source").orderBy(F.desc("macro_f1"), F.desc("accuracy"), model)


def pair_metrics(df: DataFrame, pair_type: str, is_correct: str, alignment_fail: str) -> DataFrame:
    """E22. Judged pairs, accuracy and failures of each pair type, with an ``overall`` row of the pooled accuracy and the plain mean of types."""
    fail = F.coalesce(F.col(alignment_fail), F.lit(False))
    types = df.groupBy(pair_type).agg(F.count_if(~fail).alias("n"), F.count_if(~fail & F.col(is_correct)).alias("correct"), F.count_if(fail).alias("failed"))
    types = types.withColumn("accuracy", F.try_divide(F.col("correct"), F.col("n")))
    overall = types.agg(F.lit("overall").alias(pair_type), F.sum("n").alias("n"), F.sum("correct").alias("correct"), F.sum("failed").alias("failed"), _div(F.sum("correct"), F.sum("n")).alias("accuracy"), F.coalesce(F.avg("accuracy"), F.lit(0.0)).alias("weighted_accuracy"))
    return types.where("n > 0").withColumn("weighted_accuracy", F.lit(None).cast("double")).unionByName(overall)
