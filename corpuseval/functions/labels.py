"""Quality tiers: normalisation of labels, model answers and token scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuseval.functions.textkeys import LINE_BREAK, stripped

# The canonical tiers in their order, and the aliases of each.
TIERS = ("exceptional", "strong", "fair", "limited")
ALIASES = {
    "exceptional": ("exceptional", "excellent", "top", "tier1", "a", "a*", "best", "ex"),
    "strong": ("strong", "good", "tier2", "b", "above_average"),
    "fair": ("fair", "average", "tier3", "c", "moderate"),
    "limited": ("limited", "poor", "weak", "low", "tier4", "d"),
}
_LOWEST = float("-inf")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(mapping: dict, key: Column) -> Column:
    """Value of a literal map, or null."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair)), key)


def normalize_rank(value: Column | str, numeric: bool = False) -> Column:
    """C1. The tier of an alias, trimmed and in any case; ``numeric`` reads 4 to 1, cut to an integer."""
    value = _col(value)
    if numeric:
        return lookup(dict(zip((4, 3, 2, 1), TIERS, strict=True)), value.cast("int"))
    return lookup({a: tier for tier, names in ALIASES.items() for a in names}, F.lower(F.trim(value.cast("string"))))


def normalize_label(text: Column | str, labels: Sequence[str] = TIERS) -> Column:
    """C2. The answer without marks of emphasis and punctuation, if it is exactly a label."""
    plain = F.lower(F.trim(F.regexp_replace(_col(text), r"[*_#`.,!?\n\r]", "")))
    return F.when(plain.isin(*labels), plain)


def normalize_label_plain(text: Column | str, labels: Sequence[str] = TIERS) -> Column:
    """C3. Trimmed and lower-cased, if it is a label."""
    plain = F.lower(F.trim(_col(text)))
    return F.when(plain.isin(*labels), plain)


def parse_reasoning_and_final(text: Column | str, labels: Sequence[str] = TIERS) -> Column:
    """C4. ``struct<reasoning, label>``: tagged parts if there are any, empty ones too, else the last line as it stands is the answer.

    A tag that is there decides: an empty ``<final>`` is no label, and an empty ``<reasoning>`` is an empty reasoning.
    """
    text = _col(text)

    def tag(name: str) -> Column:
        form = rf"(?is)<{name}>\s*(.*?)\s*</{name}>"
        return F.when(text.rlike(form), F.regexp_extract(text, form, 1))

    lines = F.filter(F.transform(F.split(text, LINE_BREAK), stripped), lambda x: x != "")
    final, reasoning = tag("final"), F.coalesce(tag("reasoning"), tag("think"))
    answer = F.coalesce(final, F.try_element_at(lines, F.lit(-1)))
    before = F.nullif(F.array_join(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), "\n"), F.lit(""))
    return F.struct(F.coalesce(reasoning, F.when(final.isNull(), before)).alias("reasoning"), normalize_label(answer, labels).alias("label"))


def _ranked(scores: Column, labels: Sequence[str]) -> Column:
    """All labels as (negative score, place in the order), best first; a missing score is the lowest."""
    rows = [F.struct((-F.coalesce(F.try_element_at(scores, F.lit(x)), F.lit(_LOWEST))).alias("cost"), F.lit(k).alias("at"), F.lit(x).alias("label")) for k, x in enumerate(labels)]
    return F.array_sort(F.array(*rows))


def logp_top2(scores: Column | str, labels: Sequence[str] = TIERS) -> Column:
    """C5. Best and second label with scores, ties in canonical order; an empty map gives nulls."""
    scores = _col(scores)
    ranked = _ranked(scores, labels)
    any_score = F.coalesce(F.size(F.map_keys(scores)) > 0, F.lit(False))
    fields = []
    for k in (0, 1):
        at = F.get(ranked, F.lit(k))
        fields += [F.when(any_score, at["label"]).alias(f"top{k + 1}"), F.when(any_score & (at["cost"] != -_LOWEST), -at["cost"]).alias(f"top{k + 1}_logp")]
    return F.struct(*fields)


def logp_argmax(scores: Column | str, labels: Sequence[str] = TIERS) -> Column:
    """C6. Best label in canonical order, null if none has a score."""
    best = F.get(_ranked(_col(scores), labels), F.lit(0))
    return F.when(best["cost"] != -_LOWEST, best["label"])


def logp_sorted_pairs(scores: Column | str, labels: Sequence[str] = TIERS) -> Column:
    """C7. Labels with a score and their scores, best first."""
    kept = F.filter(_ranked(_col(scores), labels), lambda x: x["cost"] != -_LOWEST)
    return F.transform(kept, lambda x: F.struct(x["label"].alias("label"), (-x["cost"]).alias("logp")))


def logp_argmax_alpha(scores: Column | str, labels: Sequence[str] = TIERS) -> Column:
    """C8. Best label of normalised keys, ties in alphabetical order."""
    rows = F.transform(F.map_entries(_col(scores)), lambda e: F.struct((-e["value"]).alias("cost"), normalize_label_plain(e["key"], labels).alias("label")))
    return F.get(F.array_sort(F.filter(rows, lambda x: x["label"].isNotNull() & x["cost"].isNotNull())), F.lit(0))["label"]


def token_to_label(token: Column | str, labels: Sequence[str] = TIERS) -> Column:
    """C9. The label of a token; any token that holds ``except`` is the first tier."""
    plain = F.lower(F.trim(_col(token)))
    return F.when(plain.isin(*labels), plain).when(plain.contains("except"), labels[0])


def tier_number(tier: Column | str) -> Column:
    return lookup({t: k for k, t in enumerate(reversed(TIERS), 1)}, F.lower(F.trim(_col(tier))))


def tier_distance(a: Column | str, b: Column | str) -> Column:
    """C20. Steps between two tiers, null if one is unknown."""
    return F.abs(tier_number(a) - tier_number(b))


def render_label(raw: Column | str) -> Column:
    """C29. The tier with a capital, else the trimmed text."""
    return F.coalesce(F.initcap(normalize_rank(raw)), F.trim(_col(raw)))


def majority_vote(votes: Column | str, labels: Sequence[str] = TIERS) -> Column:
    """E20. Winner of an ordered list of votes: counts, ties (alphabetical), and the place of its first vote."""
    votes = _col(votes)
    count = lambda x: F.size(F.filter(votes, lambda v: v == x))
    rows = F.array_sort(F.array(*(F.struct((-count(x)).alias("cost"), F.lit(x).alias("label")) for x in labels)))
    best = F.get(rows, F.lit(0))
    tied = F.transform(F.filter(rows, lambda r: (r["cost"] == best["cost"]) & (r["cost"] < 0)), lambda r: r["label"])
    won = F.when(best["cost"] < 0, best["label"])
    return F.struct(won.alias("winner"), (F.size(tied) > 1).alias("is_tie"), F.when(F.size(tied) > 1, tied).alias("tied"), F.nullif(F.array_position(votes, won), F.lit(0)).alias("pick"))


def vote_stats(votes: Column | str, truth: Column | str, labels: Sequence[str] = TIERS) -> Column:
    """E21. Slots, valid votes, and the share of all slots that hit the truth."""
    votes, truth = _col(votes), _col(truth)
    valid = F.filter(votes, lambda v: F.coalesce(v.isin(*labels), F.lit(False)))
    hits = F.size(F.filter(votes, lambda v: F.coalesce(v == truth, F.lit(False))))
    return F.struct(F.size(votes).alias("n"), F.size(valid).alias("valid_n"), F.try_divide(hits, F.size(votes)).alias("avg_accuracy"))
