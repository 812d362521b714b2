"""Sharding by a two-pass external shuffle, with DataFrame functions only.

Pass one scatters whole records into buckets of about ``bucket_bytes`` by a seeded hash.  Pass two puts each
bucket, which fits in memory, into a fixed order, applies Fisher-Yates (``shuffle`` with a seed) and writes
it.  The buckets one after another are one random order of all records, and shards are equal ranges of that order: their
sizes in rows differ by at most one and slots are gapless (the law ``rows``), and a bucket is a file of one shard or
of two neighbours.

Buckets grow with the input from 32 MB to 128 MB, so that files are large and few where the input is large.  Where each bucket
starts is counted first and travels to it as a row of its own, so nothing is broadcast or joined.

The hash takes every column, so a hot source, key or text does not make a bucket large; only records equal in
all columns meet in one bucket.  The order depends on the records and seed alone, not on partitions, so a
task that runs again after a lost executor deals the same rows.

Null and empty texts have size 16.  An empty table gives no rows.  Columns of any names and types are carried along, maps too; the
four that are added (``shard``, ``slot``, ``size``, ``text_crc32``) replace columns of the same names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuseval.llm._session import scratch

SHARDS = 40
#: Bytes of a bucket at least and at most, and the number of buckets from which on they grow.
BUCKET_BYTES, MOST_BYTES, BUCKETS = 32 << 20, 128 << 20, 512
#: Bytes that a record counts besides its text.
OVERHEAD = 16
_ADDED = ("shard", "slot", "size", "text_crc32")


def record_size(text: F.Column) -> F.Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def _hashable(c: F.Column, kind: T.DataType) -> F.Column:
    """The value with every map in it as its entries in order of keys, values hashed."""
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.struct(e["key"], F.xxhash64(_hashable(e["value"], kind.valueType))))
        return F.array_sort(entries)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _hashable(x, kind.elementType)) if _holds_map(kind) else c
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(_hashable(c[f.name], f.dataType).alias(f.name) for f in kind))) if _holds_map(kind) else c
    return c


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _holds_map(kind.elementType)


def shuffle_shards(docs: DataFrame, shards: int = SHARDS, seed: int = 42, bucket_bytes: int | None = None, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard)."""
    kept = [f for f in docs.schema if f.name not in _ADDED]
    total, n = docs.agg(F.coalesce(F.sum(record_size(F.col(text_col))), F.lit(0)), F.count("*")).first()
    bucket_bytes = bucket_bytes or min(max(BUCKET_BYTES, total // BUCKETS), MOST_BYTES)
    buckets = max(1, -(-total // bucket_bytes))
    record = [F.col(f"`{f.name}`") for f in kept]
    plain = [_hashable(c, f.dataType) for c, f in zip(record, kept, strict=True)]
    order = F.struct(F.xxhash64(F.lit(seed + 1), *plain).alias("first"), F.xxhash64(F.lit(seed + 2), *plain).alias("second"))
    dealt = docs.select(F.pmod(F.xxhash64(F.lit(seed), *plain), F.lit(buckets)).cast("int").alias("bucket"), F.struct(order.alias("order"), F.struct(*record).alias("record")).alias("row"))
    sizes = dealt.groupBy("bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("bucket", before.alias("start"))  # a row for each bucket
    # One bucket for each partition: the seed of a partition is then that of its bucket.
    mixed = dealt.unionByName(starts, allowMissingColumns=True).repartitionById(buckets, F.col("bucket"))
    mixed = mixed.groupBy("bucket").agg(F.max("start").alias("start"), F.collect_list("row").alias("rows"))
    ranks = F.shuffle(F.array_sort(F.transform("rows", lambda r, k: F.struct(r["order"], k.alias("at")))), seed)
    placed = mixed.select("start", "rows", ranks.alias("ranks")).select("start", F.posexplode(F.transform("ranks", lambda k: F.get("rows", k["at"])["record"])).alias("at", "record"))
    place = F.col("start") + F.col("at")
    size, longer = divmod(n, shards)  # the first shards hold one row more
    split = longer * (size + 1)
    shard = F.when(place < split, F.floor(place / (size + 1))).otherwise(longer + F.floor((place - split) / max(size, 1)))
    slot = F.when(place < split, place % (size + 1)).otherwise((place - split) % max(size, 1))
    return placed.select("record.*", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard; rows stand in slot order within a file, and files of a shard hold slots one after another."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows written; ``schema`` is that of the sharded rows, so that an empty table can be read too."""
    return spark.read.schema(schema).parquet(path)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shuffle_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    path = scratch(spark, "shards")
    write_shards(sharded, path)
    text = F.coalesce(F.col("text"), F.lit(""))
    return read_shards(spark, path, sharded.schema).select(
        "doc_id",
        record_size(F.col("text")).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard"),
        F.col("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
