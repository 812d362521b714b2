"""Nested model outcomes: ``map<entry, map<model, outcome>>``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuseval.functions.labels import TIERS, logp_argmax_alpha, majority_vote, normalize_label_plain, parse_reasoning_and_final

#: H9. One model's outcome.
OUTCOME = (
    "struct<logp:map<string,double>,response_text:string,prediction:string,is_match:boolean,reasoning_content:string,reasoning_meta:string,"
    "error:string,avg_accuracy:double,vote_n:int,vote_valid_n:int,vote_counts:map<string,int>,vote_is_tie:boolean,vote_tied:array<string>,vote_predictions:array<string>>"
)


def outcome_struct(**fields: Column) -> Column:
    """H9. An outcome of the fields given, all others null."""
    kinds = T.StructType.fromDDL(OUTCOME.removeprefix("struct<").removesuffix(">"))
    if unknown := set(fields).difference(kinds.names):
        raise ValueError(f"an outcome has no {sorted(unknown)}")
    return F.struct(*(fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds))


def fold_outcomes(long: DataFrame, key: str, entry: Column, model: str, outcome: Column, *keep: str) -> DataFrame:
    """Long rows as one nested map for each key; a key holds as many outcomes as there are models."""
    inner = long.withColumn("_entry", entry).groupBy(key, *keep, "_entry").agg(F.map_from_entries(F.collect_list(F.struct(F.col(model), outcome.alias("v")))).alias("m"))
    return inner.groupBy(key, *keep).agg(F.map_from_entries(F.collect_list(F.struct("_entry", "m"))).alias("val_outcome"))


def explode_outcomes(df: DataFrame, col: str, entry: str, *keep: str) -> DataFrame:
    """H1. (kept columns, ``model``, ``outcome``) of one entry; null outcomes are skipped."""
    rows = df.select(*keep, F.explode(F.try_element_at(F.col(col), F.lit(entry))).alias("model", "outcome"))
    return rows.where("outcome is not null")


def get_outcome(col: Column | str, entry: str, model: str) -> Column:
    """H2."""
    col = F.col(col) if isinstance(col, str) else col
    return F.try_element_at(F.try_element_at(col, F.lit(entry)), F.lit(model))


def put_outcome(col: Column | str, entry: str, model: str, outcome: Column) -> Column:
    """H3. One (entry, model) set, all others kept."""
    col = F.col(col) if isinstance(col, str) else col
    empty = F.map_filter(F.create_map(F.lit(model), outcome), lambda k, _: F.lit(False))
    others = F.map_filter(F.coalesce(F.try_element_at(col, F.lit(entry)), empty), lambda k, _: k != model)
    inner = F.map_concat(others, F.create_map(F.lit(model), outcome))
    return F.map_concat(F.map_filter(col, lambda k, _: k != entry), F.create_map(F.lit(entry), inner))


def keep_models(df: DataFrame, col: str, entry: str, models: Sequence[str]) -> DataFrame:
    """H4. Chosen models of one entry; rows left without any go."""
    kept = F.map_filter(F.try_element_at(F.col(col), F.lit(entry)), lambda k, _: k.isin(*models))
    return df.withColumn(col, F.create_map(F.lit(entry), kept)).where(F.size(F.try_element_at(F.col(col), F.lit(entry))) > 0)


def remove_models(col: Column | str, models: Sequence[str]) -> Column:
    """H5. Models dropped from every entry, then empty entries, then the empty map."""
    col = F.col(col) if isinstance(col, str) else col
    less = F.map_filter(F.transform_values(col, lambda _, m: F.map_filter(m, lambda k, __: ~k.isin(*models))), lambda _, m: F.size(m) > 0)
    return F.when(F.size(less) > 0, less)


def resolve_prediction(prediction: Column, votes: Column, response_text: Column, logp: Column, labels: Sequence[str] = TIERS) -> Column:
    """H6. ``struct<label, source>`` of the first that gives a label: prediction, votes, answer text, token scores."""
    found = (
        ("prediction", normalize_label_plain(prediction, labels)),
        ("vote_predictions", majority_vote(votes, labels)["winner"]),
        ("response_text", parse_reasoning_and_final(response_text, labels)["label"]),
        ("logp", logp_argmax_alpha(logp, labels)),
    )
    # Source and label travel as one text and are bound once, so that each parse runs once and only until one gives a label.
    first = F.coalesce(*(F.concat(F.lit(f"{n}:"), c) for n, c in found))
    named = lambda x: F.when(x.isNotNull(), F.struct(F.get(F.split(x, ":", 2), F.lit(1)).alias("label"), F.substring_index(x, ":", 1).alias("source")))
    return F.get(F.transform(F.array(first), named), F.lit(0))


def outcome_is_valid(outcome: Column, logp_mode: bool, need_all_votes: bool = False) -> Column:
    """H7. Whether an earlier outcome can be used again; in text mode one with a prediction, a match flag or a text, be it empty."""
    if logp_mode:
        return F.coalesce(F.size(outcome["logp"]) > 0, F.lit(False))
    some = outcome["prediction"].isNotNull() | outcome["is_match"].isNotNull() | outcome["response_text"].isNotNull()
    gaps = F.coalesce(F.exists(outcome["vote_predictions"], lambda v: v.isNull()), F.lit(False))
    return some & ~gaps if need_all_votes else some


def fill_null_votes(votes: DataFrame, scored: DataFrame, keys: Sequence[str], slot: str = "slot", vote: str = "vote") -> DataFrame:
    """H8. Null slots take the new vote, all others stay; one ordered list for each key."""
    new = scored.select(*keys, slot, F.col(vote).alias("_new"))
    merged = votes.join(new, [*keys, slot], "left").withColumn(vote, F.coalesce(vote, "_new"))
    ordered = F.array_sort(F.collect_list(F.struct(slot, vote)))
    return merged.groupBy(*keys).agg(F.transform(ordered, lambda s: s[vote]).alias("vote_predictions"))
