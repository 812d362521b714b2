"""Reshaping of records, maps and nested values."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuseval.sources.shared import stored


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def project(df: DataFrame, fields: Mapping[str, Column | str], **constants) -> DataFrame:
    """B15. Chosen fields under new names, in the order given, and constants after them."""
    return df.select(*(_col(c).alias(n) for n, c in fields.items()), *(F.lit(v).alias(n) for n, v in constants.items()))


def json_safe(df: DataFrame) -> DataFrame:
    """B16. Dates and times as ISO text and binary as base64, at every depth."""

    def safe(c: Column, t: T.DataType) -> Column:
        if isinstance(t, T.TimestampType | T.TimestampNTZType):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        if isinstance(t, T.DateType):
            return F.date_format(c, "yyyy-MM-dd")
        if isinstance(t, T.BinaryType):
            return F.base64(c)
        if isinstance(t, T.ArrayType):
            return F.transform(c, lambda x: safe(x, t.elementType))
        if isinstance(t, T.MapType):
            return F.transform_values(c, lambda _, v: safe(v, t.valueType))
        if isinstance(t, T.StructType):
            return F.when(c.isNotNull(), F.struct(*(safe(c[f.name], f.dataType).alias(f.name) for f in t)))
        return c

    return df.select(*(safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema))


def batch_id(df: DataFrame, size: int, *order: str) -> DataFrame:
    """B20. ``batch``: consecutive groups of ``size`` sorted rows, the tail kept."""
    return number_rows(df, *order).withColumn("batch", F.floor((F.col("row_no") - 1) / size)).drop("row_no")


def number_rows(df: DataFrame, *order: str | Column) -> DataFrame:
    """F1. ``row_no`` from 1 in sorted order over the whole table.

    Rows are range-partitioned by the order and written; each range counts its own rows and starts after those before it,
    so no task sorts the whole table. The order must be total for the numbers to be reproducible.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.withColumn("_own", own).join(starts, "_part").withColumn("row_no", F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


def rename_fields(df: DataFrame, by_name: Mapping[str, str], by_position: Mapping[int, str] | None = None, extra: Mapping[str, str] | None = None) -> DataFrame:
    """B21. New names by old name, else by position, else from ``extra``, else unchanged."""
    names = {c: by_name.get(c) or (by_position or {}).get(k) or (extra or {}).get(c) or c for k, c in enumerate(df.columns)}
    return df.withColumnsRenamed({a: b for a, b in names.items() if a != b})


def rename_nested_keys(c: Column | str, names: Mapping[str, str]) -> Column:
    """B22. Keys of a map under new names."""
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.transform_keys(_col(c), lambda k, _: F.coalesce(F.try_element_at(table, k), k))


def drop_null_fields(c: Column | str) -> Column:
    """B23. A map without its null values."""
    return F.map_filter(_col(c), lambda _, v: v.isNotNull())


def nest_dotted(df: DataFrame) -> DataFrame:
    """B24. Columns named ``a.b.c`` as nested structs."""

    def build(names: list[tuple[list[str], str]]) -> list[Column]:
        groups: dict[str, list] = {}
        for path, full in names:
            groups.setdefault(path[0], []).append((path[1:], full))
        out = []
        for head, rest in groups.items():
            deeper = [(p, f) for p, f in rest if p]
            out.append((F.struct(*build(deeper)) if deeper else F.col(f"`{rest[0][1]}`")).alias(head))
        return out

    return df.select(*build([(c.split("."), c) for c in df.columns]))


def merge_missing(target: Column | str, source: Column | str) -> Column:
    """B25. A map filled from another where a value is absent, null or empty."""
    return F.map_zip_with(_col(target), _col(source), lambda _, a, b: F.coalesce(F.nullif(a, F.lit("")), b, a))


def map_update(left: Column | str, right: Column | str) -> Column:
    """B26. The right map wins for each of its keys, null values included."""
    left, right = _col(left), _col(right)
    return F.map_zip_with(left, right, lambda k, a, b: F.when(F.map_contains_key(right, k), b).otherwise(a))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """B27. Values that are neither null nor blank."""
    return df.where(F.trim(F.col(col)) != "").select(col).distinct()


def repair_from(df: DataFrame, target: str, source: Column | str, key: Callable[[Column], Column] | None = None, scope: Column | None = None) -> DataFrame:
    """B30. ``target`` set from ``source`` where they differ under ``key``; ``repaired`` tells which rows."""
    source, key = _col(source), key or (lambda c: c)
    differs = F.coalesce(F.trim(source) != "", F.lit(False)) & ~key(F.col(target)).eqNullSafe(key(source))
    hit = differs if scope is None else differs & F.coalesce(scope, F.lit(False))
    return df.withColumn("repaired", hit).withColumn(target, F.when(F.col("repaired"), source).otherwise(F.col(target)))


def select_order(df: DataFrame, order: Sequence[str], limit: int | None = None, ascending: bool | list[bool] = True) -> DataFrame:
    """F17, F18. Sorted rows, and the first of them."""
    out = df.orderBy(*order, ascending=ascending)
    return out if limit is None else out.limit(limit)
