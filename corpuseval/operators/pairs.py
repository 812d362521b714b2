"""Pairs of items of different tiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuseval.functions.labels import TIERS, parse_reasoning_and_final, tier_distance
from corpuseval.operators.reshape import number_rows
from corpuseval.operators.sampling import draw, top_per_group
from corpuseval.operators.scoring import score_once
from corpuseval.sources.shared import stored

PAIR_TYPES = tuple((a, b) for i, b in enumerate(TIERS) for a in TIERS[i + 1 :])  # lower tier first


def sample_pairs(items: DataFrame, n: int, seed: int, key: str, tier: str) -> DataFrame:
    """D9, F14. Up to ``n`` random pairs of each pair type, as (pair_type, key_a, key_b), the lower tier first.

    The product of two tiers is never formed. Items are numbered within their tier, pairs are numbered by the two numbers, and a few
    times n pair numbers are drawn by md5 and made distinct, or all of them if there are not more; the first n in a random order are joined
    with the items. Every set of n pairs is equally likely.
    """
    spark, draws = items.sparkSession, 4 * n + 64
    known = items.where(F.col(tier).isin(*TIERS)).select(F.col(key).alias("key"), F.col(tier).alias("tier"))
    numbered = number_rows(known, "tier", "key")
    sizes = numbered.groupBy("tier").agg(F.min("row_no").alias("start"), F.count("*").alias("size"))
    placed = numbered.join(sizes, "tier").select("tier", "key", (F.col("row_no") - F.col("start")).alias("at"))
    types = spark.createDataFrame([(f"{a}_{b}", a, b) for a, b in PAIR_TYPES], "pair_type string, a string, b string")
    side = lambda t: sizes.select(F.col("tier").alias(t), F.col("size").alias(f"n_{t}"))
    each = types.join(side("a"), "a").join(side("b"), "b").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    product = F.col("n_a") * F.col("n_b")
    drawn = F.conv(F.substring(draw(seed, "pair_type", "j"), 1, 15), 16, 10).cast("long") % product
    numbers = each.where((product > draws) | (F.col("j") < product)).select("pair_type", "a", "b", "n_b", F.when(product > draws, drawn).otherwise(F.col("j")).alias("number")).distinct()
    chosen = top_per_group(numbers, ["pair_type"], [draw(seed, "pair_type", "number"), F.col("number")], n)
    asked = chosen.select("pair_type", "a", "b", F.floor(F.col("number") / F.col("n_b")).alias("at_a"), (F.col("number") % F.col("n_b")).alias("at_b"))
    of = lambda t: placed.select(F.col("tier").alias(t), F.col("at").alias(f"at_{t}"), F.col("key").alias(f"key_{t}"))
    return asked.join(of("a"), ["a", "at_a"]).join(of("b"), ["b", "at_b"]).select("pair_type", "key_a", "key_b")


def assign_position(pairs: DataFrame, seed: int, a: str = "key_a", b: str = "key_b") -> DataFrame:
    """F15. A fair coin of each pair decides who comes first; ``correct_position`` is that of the higher tier (the second key)."""
    heads = F.substring(draw(seed + 1, a, b), 1, 1) < "8"
    return pairs.withColumn("first", F.when(heads, F.col(a)).otherwise(F.col(b))).withColumn("second", F.when(heads, F.col(b)).otherwise(F.col(a))).withColumn("correct_position", F.when(heads, "second").otherwise("first"))


def attach_texts(pairs: DataFrame, items: DataFrame, key: str, text: str, tier: str) -> DataFrame:
    """Texts and tiers of both items; pairs that lack a text go."""
    side = lambda n: items.where(F.trim(F.col(text)) != "").select(F.col(key).alias(n), F.trim(F.col(text)).alias(f"text_{n}"), F.col(tier).alias(f"rank_{n}"))
    return pairs.join(side("first"), "first").join(side("second"), "second").withColumn("distance", tier_distance("rank_first", "rank_second"))


def pair_messages(df: DataFrame, prompt: str, first: str = "text_first", second: str = "text_second") -> DataFrame:
    """I6. Chat messages that ask which of two texts is of the higher tier."""
    asked = F.concat(F.lit("RQ1: "), F.trim(F.col(first)), F.lit("\n\nRQ2: "), F.trim(F.col(second)))
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return df.withColumn("messages", F.array(message("system", F.lit(prompt)), message("user", asked)))


def judge_pairs(df: DataFrame, answer: str = "prediction") -> DataFrame:
    """J5. Whether each answer names the right position; anything but first or second is an alignment failure."""
    told = F.lower(F.trim(F.col(answer)))
    fail = ~F.coalesce(told.isin("first", "second"), F.lit(False))
    return df.withColumn("alignment_fail", fail).withColumn("is_correct", ~fail & (told == F.col("correct_position")))



#: Seconds that one pair may take.
PAIR_SECONDS = 300.0


def pair_job(items: DataFrame, model: Callable, key: str, tier: str, text: str, prompt: str, n: int, seed: int, path: str | None = None, timeout: float | None = PAIR_SECONDS, **options) -> DataFrame:
    """J5. Sampled pairs in drawn positions, asked, and judged: one row for each pair that was answered.

    ``path`` keeps the answers by ordered pair (``first``, ``second``): a run appends to it as tasks end, takes from it what earlier runs have brought,
    and asks only for pairs that are missing there, those that failed or ran out of time among them.  Pairs that lack a text are not asked.
    """
    drawn = attach_texts(assign_position(sample_pairs(items, n, seed, key, tier), seed), items, key, text, tier)
    asked = stored(pair_messages(drawn, prompt).select("pair_type", "distance", "first", "second", "rank_first", "rank_second", "correct_position", "messages"), "pairs")
    answers = score_once(asked, model, ["first", "second"], path, timeout=timeout, **options).where("error is null")
    answers = answers.select("first", "second", F.trim("response_text").alias("raw_response"), parse_reasoning_and_final("response_text", ("first", "second"))["label"].alias("prediction"))
    return judge_pairs(asked.drop("messages").join(answers, ["first", "second"]))
