"""Chat-format training and evaluation sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuseval.functions.labels import render_label
from corpuseval.operators.sampling import balance_random, balance_recent, seeded_shuffle

MESSAGES = "array<struct<role:string,content:string>>"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def to_messages(text: Column | str, label: Column | str, prompt: Column | str) -> Column:
    """I1. System prompt, trimmed text, and the label as the answer."""
    prompt = F.lit(prompt) if isinstance(prompt, str) else prompt
    return F.array(message("system", prompt), message("user", F.trim(_col(text))), message("assistant", render_label(label)))


def build_training_set(df: DataFrame, text: str, label: str, prompt: str, per_class: int | None = None, order: str = "random", year: str | None = None, key: str = "id", seed: int = 32, shuffle: bool = False) -> DataFrame:
    """I2. Rows with a text and a label as messages, balanced and shuffled on request."""
    rows = df.where((F.trim(F.col(text)) != "") & (F.trim(F.col(label)) != "")).withColumn("_class", render_label(label))
    if per_class is not None:
        rows = balance_random(rows, ["_class"], per_class, seed, key) if order == "random" else balance_recent(rows, ["_class"], per_class, year, key)
    if shuffle:
        rows = seeded_shuffle(rows, seed, key)
    return rows.select(key, to_messages(text, label, prompt).alias("messages"))


def build_counters(df: DataFrame, text: str, label: str) -> DataFrame:
    """E23. Rows that a training set takes, and those it skips and why."""
    no_text = ~F.coalesce(F.trim(F.col(text)) != "", F.lit(False))
    no_label = ~no_text & ~F.coalesce(F.trim(F.col(label)) != "", F.lit(False))
    return df.agg(F.count("*").alias("total"), F.count_if(~no_text & ~no_label).alias("valid"), F.count_if(no_text).alias("skipped_text"), F.count_if(no_label).alias("skipped_label"))


def to_prompt_completion(messages: Column | str, template: str = "<|{role}|>\n{content}\n", tail: str = "<|assistant|>\n") -> Column:
    """I3. ``struct<prompt, completion>``: all messages but the last by the template, and the content of the last."""
    messages = _col(messages)
    shown = lambda m: F.replace(F.replace(F.lit(template), F.lit("{role}"), m["role"]), F.lit("{content}"), m["content"])
    before = F.array_join(F.transform(F.slice(messages, F.lit(1), F.greatest(F.size(messages) - 1, F.lit(0))), shown), "")
    return F.struct(F.concat(before, F.lit(tail)).alias("prompt"), F.try_element_at(messages, F.lit(-1))["content"].alias("completion"))


def pick_payload(df: DataFrame) -> DataFrame:
    """I4. Messages alone if there are any, else the text alone, else the whole row."""
    return df.select("messages") if "messages" in df.columns else df.select("text") if "text" in df.columns else df


def eval_messages(text: Column | str, title: Column | str, prompt: str) -> Column:
    """I5. System prompt and text, or title where there is no text; null if both are empty."""
    asked = F.coalesce(F.nullif(F.trim(_col(text)), F.lit("")), F.nullif(F.trim(_col(title)), F.lit("")))
    return F.when(asked.isNotNull(), F.array(message("system", F.lit(prompt)), message("user", asked)))


def prompts(spark: SparkSession, texts: Mapping[str, str]) -> DataFrame:
    """I7. Named prompts as a table."""
    return spark.createDataFrame(sorted(texts.items()), "prompt_name string, prompt string")


def with_prompt(df: DataFrame, table: DataFrame, name: str = "prompt_name") -> DataFrame:
    return df.join(table, name, "left")


def extraction_messages(content: Column | str, fields: Sequence[str]) -> Column:
    """I8. A request for named summary fields of a text."""
    ask = f"Return one JSON object with the fields {', '.join(fields)}."
    return F.array(message("system", F.lit(ask)), message("user", _col(content)))


def flatten_messages(messages: Column | str) -> Column:
    """I10. ``[ROLE]`` blocks joined by blank lines; messages without content are skipped."""
    kept = F.filter(_col(messages), lambda m: F.coalesce(F.trim(m["content"]) != "", F.lit(False)))
    return F.array_join(F.transform(kept, lambda m: F.concat(F.lit("["), F.upper(m["role"]), F.lit("]\n"), m["content"])), "\n\n")


def split_system(messages: Column | str) -> Column:
    """I11. ``struct<instruction, input, error>``: system contents, all others, and an error if those are blank."""
    messages = _col(messages)
    of = lambda *roles: F.array_join(F.transform(F.filter(messages, lambda m: m["role"].isin(*roles)), lambda m: m["content"]), "\n\n")
    asked = of("user", "assistant", "model")
    blank = F.trim(asked) == ""
    return F.struct(of("system").alias("instruction"), F.when(~blank, asked).alias("input"), F.when(blank, "no input").alias("error"))
