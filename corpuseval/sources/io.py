"""Readers and writers of JSONL, JSON arrays, Parquet, CSV, text and file catalogs, and merging by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuseval.functions.textkeys import identifier_key, path_name
from corpuseval.sources.shared import stored

def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType | str, strict: bool = False) -> DataFrame:
    """A1, A3. One object for each line; blank lines are skipped, and lines that are no JSON too, unless ``strict``, which raises.

    The text is parsed in two steps so that a value of another type is a null and not a lost row.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    sound = F.try_parse_json("value").isNotNull()
    if strict:
        value = F.when(sound, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not JSON: "), F.substring("value", 1, 100))).cast("string"))
        lines = lines.select(value.alias("value"))
    else:
        lines = lines.where(sound)
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def read_collection(spark: SparkSession, path: str, cond: Column | None = None, fmt: str = "parquet", **options) -> DataFrame:
    """A2. A stored collection, the filter pushed to the source."""
    df = spark.read.format(fmt).options(**options).load(path)
    return df if cond is None else df.where(cond)


def _before(pieces: DataFrame, value: Column) -> tuple[DataFrame, Column]:
    """The sum of ``value`` over all pieces of a file before each: within its split, and over the splits before."""
    own = F.coalesce(F.sum(value).over(Window.partitionBy("file", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = pieces.groupBy("file", "block").agg(F.sum(value).alias("_all"))
    earlier = F.coalesce(F.sum("_all").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return pieces.join(splits.select("file", "block", earlier.alias("_earlier")), ["file", "block"]), own + F.col("_earlier")


def read_json_array(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """A4. Objects of files that each hold one array, or one object; a large file is read by many tasks.

    A file is cut at every closing brace, by splits that know nothing of each other.  What a piece means follows from sums over the pieces
    before it: an odd number of quotes means that it begins within a string; then its brackets outside strings are counted, and a
    brace that brings the depth back to that of the array ends an object.  Sums run within a split and over the totals of splits, so
    no task sees a whole file; pieces meet by object.  Elements that are no objects, and blank files, give no rows.
    """
    text = spark.read.option("lineSep", "}").text(path)
    pieces = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    plain = F.regexp_replace("value", r"(?s)\\.", "")  # without escaped characters
    count = lambda c, x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))

    def brackets(inside: bool) -> Column:
        outside = F.regexp_replace(F.concat(F.lit('"'), plain) if inside else plain, '"[^"]*("|\\z)', "")
        return count(outside, "{") + count(outside, "[") - count(outside, "]")

    first = F.substring(F.regexp_replace("value", r"\A[\s\ufeff]+", ""), 1, 1)
    pieces = stored(pieces.select("*", count(plain, '"').alias("quotes"), brackets(False).alias("outside"), brackets(True).alias("inside"), first.alias("first")), "pieces")
    base = pieces.where("first <> ''").groupBy("file").agg(F.min_by("first", F.struct("block", "id")).alias("first")).select("file", (F.col("first") == "[").cast("int").alias("base"))
    marks, quotes = _before(pieces.select("file", "block", "id", "quotes", "outside", "inside"), F.col("quotes"))
    marks = marks.withColumn("begins", quotes % 2).drop("_earlier")
    closes = 1 - (F.col("begins") + F.col("quotes")) % 2  # the brace after the piece is no part of a string
    marks = marks.select("file", "block", "id", closes.alias("closes"), F.when(F.col("begins") == 1, F.col("inside")).otherwise(F.col("outside")).alias("delta"))
    marks, depth = _before(marks, F.col("delta") - F.col("closes"))
    marks = marks.withColumn("depth", depth + F.col("delta") - F.col("closes")).drop("_earlier").join(base, "file")
    marks = marks.select("file", "block", "id", ((F.col("closes") == 1) & (F.col("depth") == F.col("base"))).cast("int").alias("ends"))
    marks, element = _before(marks, F.col("ends"))
    marks = marks.select("file", "block", "id", element.alias("element"), "ends")
    whole = pieces.select("file", "block", "id", "value").join(marks, ["file", "block", "id"]).groupBy("file", "element")
    found = whole.agg(F.array_sort(F.collect_list(F.struct("block", "id", "value"))).alias("parts"), F.max("ends").alias("ends")).where("ends = 1")
    value = F.concat(F.array_join(F.transform("parts", lambda x: x["value"]), "}"), F.lit("}"))
    value = F.regexp_replace(value, r"\A[\s\ufeff]*[\[,]?\s*", "")
    last = F.try_element_at(F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>"), F.lit(-1))  # elements that are no objects stand before it
    return found.select(F.from_json(F.when(value.startswith("{"), value).otherwise(last), schema).alias("r")).select("r.*")


def read_lines(spark: SparkSession, path: str | list[str], name: str = "value") -> DataFrame:
    """A5. Trimmed lines that are not blank."""
    return spark.read.text(path).select(F.trim("value").alias(name)).where(F.col(name) != "")


def read_file_catalog(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """A6. Files below a folder, each one row: ``path``, ``name_key`` and ``stem_key`` (identifier keys), ``subject`` (its folder, upper case)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path")
    name = path_name("path")
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    subject = F.upper(F.element_at(F.split("path", "/"), -2))
    return files.select("path", identifier_key(name).alias("name_key"), identifier_key(stem).alias("stem_key"), subject.alias("subject"))


def file_index(catalog: DataFrame) -> DataFrame:
    """A6. (kind, key, path): the four indexes of a catalog, of files with one key the first path.

    Kinds are ``name`` and ``stem`` over all files, and ``subject_name`` and ``subject_stem`` with keys ``subject:key``, so that each
    subject has its own copy of a name that several have.
    """
    plain = [F.struct(F.lit(kind).alias("kind"), F.col(f"{kind}_key").alias("key")) for kind in ("name", "stem")]
    scoped = [F.struct(F.lit(f"subject_{kind}").alias("kind"), F.concat(F.nullif(F.col("subject"), F.lit("")), F.lit(":"), F.nullif(F.col(f"{kind}_key"), F.lit(""))).alias("key")) for kind in ("name", "stem")]
    rows = catalog.select("path", F.inline(F.array(*plain, *scoped))).where(F.col("key") != "")
    return rows.groupBy("kind", "key").agg(F.min("path").alias("path"))


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    """A7. UTF-8 with null fields kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_parquet(df: DataFrame, path: str, records_per_file: int = 10_000, mode: str = "error") -> None:
    """A8."""
    df.write.mode(mode).option("maxRecordsPerFile", records_per_file).parquet(path)


def fixed(df: DataFrame, decimals: int = 2) -> DataFrame:
    """Doubles as text with a fixed number of decimals."""
    return df.select(*(F.format_string(f"%.{decimals}f", F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType | T.FloatType) else F.col(f.name) for f in df.schema))


def write_csv(df: DataFrame, path: str, decimals: int = 2, mode: str = "error") -> None:
    """A9. A report with a header."""
    fixed(df, decimals).write.mode(mode).option("header", True).csv(path)


def report_lines(df: DataFrame, group: str, columns: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """A10. Markdown lines, a table for each group, with ``group`` and ``seq`` to sort by."""
    cells = lambda xs: F.concat(F.lit("| "), F.concat_ws(" | ", *xs), F.lit(" |"))
    rows = df.withColumn("seq", F.row_number().over(Window.partitionBy(group).orderBy(*order)) + 2).select(group, "seq", cells([F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("line"))
    head = df.select(group).distinct().select(group, F.inline(F.array(*(F.struct(F.lit(k).alias("seq"), c.alias("line")) for k, c in enumerate((F.concat(F.lit("## "), F.col(group)), cells([F.lit(c) for c in columns]), cells([F.lit("---")] * len(columns))))))))
    return head.unionByName(rows)


def upsert(old: DataFrame, new: DataFrame, key: str, order: str | None = None, mode: str = "replace") -> DataFrame:
    """A14. Merge by key: the new row wins, of several the last by ``order``, or in the order they are read; rows without a key are kept.

    ``replace`` takes the new row whole; ``patch`` takes its values that are not null.
    """
    last = new.where(F.col(key).isNotNull()).withColumn("_at", F.col(order) if order else F.monotonically_increasing_id())
    last = last.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_at")))).where("_nth = 1").drop("_nth", "_at")
    nameless = old.where(F.col(key).isNull()).unionByName(new.where(F.col(key).isNull()), allowMissingColumns=True)
    named = old.where(F.col(key).isNotNull())
    if mode == "replace":
        return named.join(last.select(key), key, "left_anti").unionByName(last, allowMissingColumns=True).unionByName(nameless, allowMissingColumns=True)
    both = named.alias("o").join(last.alias("n"), key, "full")
    pick = lambda c: F.coalesce(*([F.col(f"n.{c}")] if c in new.columns else []), *([F.col(f"o.{c}")] if c in old.columns else [])).alias(c)
    columns = [*old.columns, *(c for c in new.columns if c not in old.columns)]
    return both.select(*(F.col(key) if c == key else pick(c) for c in columns)).unionByName(nameless, allowMissingColumns=True)


def replace_scope(old: DataFrame, new: DataFrame, scope: Column, same: str) -> DataFrame:
    """A15. Rows in scope replaced by new ones, which must all have one value of ``same``, else it raises."""
    guard = new.agg(F.count_distinct(F.coalesce(F.col(same).cast("string"), F.lit("")))).first()[0]
    if guard > 1:
        raise ValueError(f"new rows have {guard} values of {same}")
    return old.where(~F.coalesce(scope, F.lit(False))).unionByName(new)


def copy_with_links(source: DataFrame, cond: Column, linked: DataFrame, link: str, key: str, status: str, limit: int | None = None, order: str = "id") -> tuple[DataFrame, DataFrame]:
    """A16. Filtered rows with a new status, and the distinct linked rows that they name."""
    rows = source.where(cond)
    rows = rows if limit is None else rows.orderBy(order).limit(limit)
    rows = rows.withColumn("status", F.lit(status))
    return rows, linked.join(rows.select(F.col(link).alias(key)).distinct(), key, "left_semi")


def last_results(results: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """A17. Of appended results the last of each key."""
    return results.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_nth = 1").drop("_nth")


def save_results(metrics: DataFrame, results: DataFrame, path: str) -> None:
    """A20. Results as JSONL and tidy metrics as JSON."""
    write_jsonl(results, f"{path}/results")
    write_jsonl(metrics, f"{path}/metrics")
