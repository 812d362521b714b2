"""Filters with exact rules for missing values."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuseval.operators.reshape import number_rows


#: Rows up to which a page is cut from the first rows.
SHALLOW = 10_000


@dataclass(frozen=True)
class Filter:
    """A condition on one field: eq, ne, in, nin, gt, gte, lt, lte, contains or regex."""

    field: str
    op: str
    value: Any


def condition(f: Filter, dialect: str = "local") -> Column:
    """B1-B10. A condition that is never null: ne and nin pass a missing value, all others fail it.

    ``contains`` is a case-sensitive substring in the local dialect and a case-insensitive regular expression in the
    store dialect; ``regex`` is an unanchored search in both.
    """
    col, v = F.col(f.field), f.value
    if f.op == "eq":
        return col.eqNullSafe(v)
    if f.op == "ne":
        return ~col.eqNullSafe(v)
    if f.op in ("in", "nin"):
        known = [x for x in v if x is not None]
        found = F.coalesce(col.isin(known), F.lit(False)) if known else F.lit(False)
        found = found | col.isNull() if None in v else found
        return found if f.op == "in" else ~found
    if f.op == "contains" and dialect == "local":
        return F.coalesce(col.cast("string").contains(v) & (col.cast("string") != ""), F.lit(False))
    if f.op in ("contains", "regex"):
        return F.coalesce(col.cast("string").rlike(f"(?i){v}" if f.op == "contains" else v), F.lit(False))
    compare = {"gt": col > v, "gte": col >= v, "lt": col < v, "lte": col <= v}
    return F.coalesce(compare[f.op], F.lit(False))


def all_of(filters: Iterable[Filter], dialect: str = "local") -> Column:
    """B11. All conditions; several on one field all hold."""
    return reduce(lambda a, b: a & b, (condition(f, dialect) for f in filters), F.lit(True))


@dataclass(frozen=True)
class CorpusFilter:
    """B12. The usual fields of the collection; what is None does not filter."""

    split: str | None = None
    subject: tuple[str, ...] | None = None
    published_year: tuple[int, ...] | None = None
    rank: tuple[str, ...] | None = None
    type: tuple[str, ...] | None = None

    def build(self, given: Iterable[Filter] = ()) -> list[Filter]:
        given = list(given)
        taken = {f.field for f in given}
        own = [Filter("split", "eq", self.split)] if self.split is not None else []
        own += [Filter(n, "in", v) for n in ("subject", "published_year", "rank", "type") if (v := getattr(self, n)) is not None]
        return given + [f for f in own if f.field not in taken]


def has_text(col: Column | str) -> Column:
    """B13. True where a character other than white space stands."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col.rlike(r"\S"), F.lit(False))


def missing_or(col: str, *values: Any) -> Column:
    """B14. True where the value is null or one of those given."""
    return F.col(col).isNull() | F.col(col).isin(*values)


def filtered_count(df: DataFrame, cond: Column) -> DataFrame:
    """B17."""
    return df.agg(F.count_if(cond).alias("n"))


def find_one(df: DataFrame, id_field: str, value: Any, order: str) -> DataFrame:
    """B18. The first row of an id."""
    return df.where(F.col(id_field).eqNullSafe(value)).orderBy(order).limit(1)


def paginate(df: DataFrame, page: int, size: int, *order: str) -> DataFrame:
    """B19. One page of sorted rows; a page holds 1 to 100 rows.

    The first ``SHALLOW`` rows are a top-k; for a page beyond them rows are numbered by ranges, so that no task holds all before it.
    """
    if page < 1 or not 1 <= size <= 100:
        raise ValueError("page starts at 1 and size is 1 to 100")
    if page * size <= SHALLOW:
        return df.orderBy(*order).offset((page - 1) * size).limit(size)
    return number_rows(df, *order).where(F.col("row_no").between((page - 1) * size + 1, page * size)).orderBy("row_no").drop("row_no")


def page_count(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.ceil(F.count("*") / size).alias("total_pages"))


def update_where(df: DataFrame, cond: Column, **values: Any) -> DataFrame:
    """B29. Columns set on the rows that the condition holds for; a null condition changes nothing."""
    hit = F.coalesce(cond, F.lit(False))
    return df.withColumns({c: F.when(hit, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def update_by_ids(df: DataFrame, ids: DataFrame, key: str, inside: bool = True, **values: Any) -> DataFrame:
    """D12. ``update_where`` for rows whose key is in (or not in) a list of ids."""
    flagged = df.join(ids.select(key).distinct().withColumn("_in", F.lit(True)), key, "left")
    hit = F.coalesce(F.col("_in"), F.lit(False))
    return update_where(flagged, hit if inside else ~hit, **values).drop("_in").select(*df.columns)
