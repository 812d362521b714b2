"""A corpus pipeline of five stages over ``documents``; each stage works on all that the one before has kept.

Null ids and texts pass as the operators define them: quality scores a null text like an empty one, rows of a null id are
neither copies nor repeats of others, and only the first stage reads labels.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuseval.llm import byte_bpe, decontaminate, quality, simhash, substring_dedup
from corpuseval.llm._session import BATCH, configure, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> list[str]:
    return [c for c in COLUMNS if c in docs.columns]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted quality is 1; the others go."""
    configure(spark)
    columns = _columns(docs)
    scored = quality.score(docs, quality.train_on_tables(spark, sf_dir), tuple(c for c in columns if c != "text"), keep_text=True)
    return scored.where("predicted = 1").select(*columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, Jaccard similarity of 0.8 or more): that of the smallest id.

    Rows equal in all columns count once; rows of the kept id and text that differ elsewhere stay, and so do rows of a null id.
    """
    configure(spark)
    columns = _columns(docs)
    found = stored(simhash.similar_texts(docs), "similar")
    kept = found.where("doc_id = first_id and code = first_code").select(F.col("doc_id").alias("_id"), F.col("code").alias("_kept"), F.col("rows").alias("_rows"))
    named = docs.where("doc_id is not null").select(*columns, simhash.text_code().alias("_code"))
    rest = named.join(kept, (F.col("doc_id") == F.col("_id")) & (F.col("_code") == F.col("_kept")))
    if kept.where("_rows > 1").take(1):
        rest = rest.where("_rows = 1").select(*columns).unionByName(rest.where("_rows > 1").select(*columns).distinct())
    return rest.select(*columns).unionByName(docs.where("doc_id is null").select(*columns))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document holds; texts without such passages stay as they are."""
    configure(spark)
    columns = _columns(docs)
    kept = substring_dedup.remove_repeats(docs, keep_unchanged=True, carry=tuple(c for c in columns if c not in ("doc_id", "text", "n_chars")))
    return kept.withColumn("n_chars", F.length("kept").cast("long")).withColumnRenamed("kept", "text").select(*columns)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of benchmark windows."""
    configure(spark)
    columns = _columns(docs)
    found = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), clean=True, carry=tuple(c for c in columns if c not in ("doc_id", "text", "n_chars")))
    return found.withColumn("n_chars", F.length("cleaned").cast("long")).withColumnRenamed("cleaned", "text").select(*columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the digests of ids and of the text decoded from them."""
    configure(spark)
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    done = byte_bpe.decode(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, split_at_spaces=True), ranks)
    return done.select("doc_id", "ids", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", cut_benchmark),
    ("byte-level BPE", encode),
]

#: Kernel scores and XXH64 fingerprints are beyond SQL; tests hold the stages against plain Python versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the session's size of Arrow batches is the caller's again afterwards."""
    docs, rows = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.conf.get(BATCH)
    try:
        for name, stage in STAGES:
            docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    finally:
        spark.conf.set(BATCH, rows)
    return docs
