"""Keys and clean forms of text.

NFKC has no built-in function; the one Python function here gets texts outside ASCII, and null for all others.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


#: White space of all scripts as a class of a pattern and as its characters, and what ends a line.
SPACE = r"[\x09-\x0d\x1c-\x1f\x85\p{Z}]"
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
LINE_BREAK = r"\r\n|[\x0a-\x0d\x1c-\x1e\x85\u2028\u2029]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stripped(text: Column | str) -> Column:
    """The text without white space at both ends, that of all scripts."""
    return F.btrim(_col(text), F.lit(SPACES))


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column | str, ascii_only: bool = False) -> Column:
    """J9. NFKC form; ``ascii_only`` states that all texts are ASCII and leaves the function out of the plan."""
    text = _col(text)
    return text if ascii_only else F.coalesce(_nfkc(F.when(~text.rlike(r"\A[\x00-\x7F]*\z"), text)), text)


def journal_key(text: Column | str, ascii_only: bool = False) -> Column:
    """C15. Lower case, ``&`` as "and", no word "the", only letters and digits, single spaces."""
    t = F.regexp_replace(F.lower(nfkc(text, ascii_only)), "&", " and ")
    t = F.regexp_replace(F.regexp_replace(t, r"\?", " "), r"\bthe\b", " ")
    return F.trim(F.regexp_replace(t, r"[^a-z0-9]+", " "))


def alnum_key(text: Column | str, ascii_only: bool = False) -> Column:
    """C16. ASCII letters and digits alone, lower case."""
    return F.regexp_replace(F.lower(nfkc(text, ascii_only)), r"[^a-z0-9]", "")


def identifier_key(text: Column | str, ascii_only: bool = False) -> Column:
    """C17. Lower case without spaces and a leading ``/doi/``."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(nfkc(text, ascii_only))), " ", ""), "^/doi/", "")


def title_tokens(text: Column | str) -> Column:
    """C18. Distinct lower-case words."""
    return F.array_remove(F.array_distinct(F.split(F.regexp_replace(F.lower(_col(text)), r"(?U)[^\w\s]", " "), r"(?U)\s+")), "")


def token_f1(a: Column | str, b: Column | str) -> Column:
    """C19. F1 of two token sets, 0 if one is empty."""
    a, b = _col(a), _col(b)
    return F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)), F.lit(0.0))


def pair_key(a: Column | str, b: Column | str) -> Column:
    """C21. An ordered pair of trimmed texts."""
    return F.struct(*(F.trim(F.coalesce(_col(c), F.lit(""))).alias(n) for c, n in ((a, "first"), (b, "second"))))


#: Words of an answer that stand for nothing.
NULL_WORDS = ("null", "None", "N/A")


def null_words(text: Column | str) -> Column:
    """C22. Null for blank texts and words that stand for nothing, as they are spelt."""
    t = stripped(text)
    return F.when(t.isin("", *NULL_WORDS), None).otherwise(t)


def safe_file_key(text: Column | str, longest: int = 255, nameless: str = "unnamed") -> Column:
    """C24. A file name without illegal and control characters, cut so that its extension stays; ``nameless`` where nothing is left."""
    t = F.regexp_replace(F.regexp_replace(_col(text), r'[<>:"/\\|?*]', "_"), r"[\x00-\x1f\x7f]", "")
    t = F.regexp_replace(t, r"\A[. ]+|[. ]+\z", "")
    dot = F.regexp_extract(t, r"(\.[^.]*)\z", 1)
    stem, room = F.length(t) - F.length(dot), longest - F.length(dot)
    kept = F.when(room >= 0, room).otherwise(F.greatest(stem + room, F.lit(0)))  # an extension over the limit takes its excess from the stem
    cut = F.concat(F.substring(t, F.lit(1), F.least(kept, stem)), dot)
    return F.when(t == "", nameless).when(F.length(t) > longest, cut).otherwise(t)


def join_context(*parts: Column | str) -> Column:
    """C25. Parts that are not empty, joined by newlines."""
    return F.concat_ws("\n", *(F.nullif(_col(p), F.lit("")) for p in parts))


def path_name(path: Column | str) -> Column:
    """C26. What follows the last slash."""
    return F.element_at(F.split(_col(path), "/"), -1)


def path_stem(path: Column | str) -> Column:
    return F.regexp_replace(path_name(path), r"\.[^.]*$", "")


def clean_text(text: Column | str) -> Column:
    """C27. Unix newlines (a lone carriage return is one), no NUL, at most one blank line, trimmed."""
    t = F.translate(F.replace(_col(text), F.lit("\r\n"), F.lit("\n")), "\r\x00", "\n")
    return stripped(F.regexp_replace(t, "\n{3,}", "\n\n"))


def upper_key(text: Column | str) -> Column:
    """C28. Trimmed and upper-cased, null if blank."""
    return F.nullif(F.upper(F.trim(_col(text))), F.lit(""))


def first_text(*named: tuple[str, Column | str]) -> Column:
    """B28. ``struct<field, text>`` of the first part with text."""
    return F.coalesce(*(F.when(F.trim(_col(c)) != "", F.struct(F.lit(n).alias("field"), F.trim(_col(c)).alias("text"))) for n, c in named))
