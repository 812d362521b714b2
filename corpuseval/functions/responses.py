"""Stored model responses: answer text, reasoning, and token scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuseval.functions.labels import TIERS, _col, token_to_label

_TOKEN = "struct<token:string,logprob:double,top_logprobs:array<struct<token:string,logprob:double>>>"
CHAT = f"struct<choices:array<struct<text:string,message:struct<content:string>,logprobs:struct<content:array<{_TOKEN}>>>>>"
RESPONSE = "struct<model:string,output:array<struct<type:string,content:array<struct<type:string,text:string>>,summary:array<struct<text:string>>,encrypted_content:string>>,usage:struct<output_tokens_details:struct<reasoning_tokens:long>>>"
CANDIDATES = "struct<candidates:array<struct<content:struct<parts:array<struct<text:string,thought:boolean>>>>>>"



def parsed(text: Column | str, kind: str) -> Column:
    """The response as a struct, or null fields where it is not of this form."""
    return F.from_json(_col(text), {"chat": CHAT, "response": RESPONSE, "candidates": CANDIDATES}[kind])


def first_position_logp(response: Column, labels: Sequence[str] = TIERS) -> Column:
    """C10. Label -> score of the first candidate for it at the first token."""
    tops = F.get(F.get(response["choices"], F.lit(0))["logprobs"]["content"], F.lit(0))["top_logprobs"]
    named = F.transform(tops, lambda t: F.struct(token_to_label(t["token"], labels).alias("label"), t["logprob"].alias("logp")))
    of = lambda x: F.get(F.filter(named, lambda t: t["label"] == x), F.lit(0))["logp"]
    return F.map_filter(F.create_map(*(c for x in labels for c in (F.lit(x), of(x)))), lambda _, v: v.isNotNull())


def max_position_logp(response: Column, labels: Sequence[str] = TIERS) -> Column:
    """C11. Label -> greatest score at any token, chosen or candidate."""
    tokens = F.get(response["choices"], F.lit(0))["logprobs"]["content"]
    pair = lambda t: F.struct(token_to_label(t["token"], labels).alias("label"), t["logprob"].alias("logp"))
    named = F.flatten(F.transform(tokens, lambda t: F.concat(F.array(pair(t)), F.coalesce(F.transform(t["top_logprobs"], pair), F.array()))))
    of = lambda x: F.array_max(F.transform(F.filter(named, lambda t: t["label"] == x), lambda t: t["logp"]))
    return F.map_filter(F.create_map(*(c for x in labels for c in (F.lit(x), of(x)))), lambda _, v: v.isNotNull())


def chat_text(response: Column) -> Column:
    """C12, chat form."""
    first = F.get(response["choices"], F.lit(0))
    return F.coalesce(first["message"]["content"], first["text"])


def output_text(response: Column) -> Column:
    """C12, response form: text parts of message items joined by newlines."""
    items = F.filter(response["output"], lambda o: o["type"] == "message")
    parts = F.flatten(F.transform(items, lambda o: F.transform(F.filter(o["content"], lambda c: c["type"] == "output_text"), lambda c: c["text"])))
    return F.array_join(parts, "\n")


def reasoning_meta(response: Column) -> Column:
    """C13. What is known of the reasoning; of several reasoning items the last counts."""
    items = F.filter(response["output"], lambda o: o["type"] == "reasoning")
    last = F.try_element_at(items, F.lit(-1))
    return F.struct(
        (F.coalesce(F.size(items), F.lit(0)) > 0).alias("has_reasoning"),
        F.coalesce(F.when(last["summary"].isNotNull(), F.size(last["summary"])), F.lit(0)).alias("summary_count"),
        (F.coalesce(last["encrypted_content"], F.lit("")) != "").alias("encrypted"),
        response["usage"]["output_tokens_details"]["reasoning_tokens"].alias("reasoning_tokens"),
        response["model"].alias("model"),
    )


def split_thought_parts(response: Column) -> Column:
    """C14. Thought parts joined; with thoughts the answer is the last text part, else all of them joined."""
    parts = F.get(response["candidates"], F.lit(0))["content"]["parts"]
    thoughts = F.transform(F.filter(parts, lambda p: F.coalesce(p["thought"], F.lit(False))), lambda p: p["text"])
    texts = F.transform(F.filter(parts, lambda p: ~F.coalesce(p["thought"], F.lit(False))), lambda p: p["text"])
    return F.struct(F.nullif(F.array_join(thoughts, "\n"), F.lit("")).alias("reasoning"), F.when(F.size(thoughts) > 0, F.try_element_at(texts, F.lit(-1))).otherwise(F.array_join(texts, "\n")).alias("answer"))


def parse_json_answer(text: Column | str, fields: Sequence[str]) -> Column:
    """C23. Named fields of a lenient JSON answer; null where it cannot be read."""
    options = {"allowComments": "true", "allowSingleQuotes": "true", "allowUnquotedFieldNames": "true"}
    inner = F.regexp_extract(_col(text), r"(?s)(\{.*\})", 1)
    return F.from_json(F.nullif(inner, F.lit("")), ", ".join(f"`{f}` string" for f in fields), options)
