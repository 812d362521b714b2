"""Shared folders for intermediate tables, and scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuseval.sources.shared import scratch, stored

__all__ = ["configure", "read_texts", "refuse_clash", "scratch", "spread", "stored", "valid_text"]

BATCH, TEXT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000


def configure(spark: SparkSession) -> None:
    """The session setting of a job over whole texts: at most ``TEXT_ROWS`` rows are sent to Python at once.

    Registered queries and stages of the pipeline are such jobs.  Operators leave the session alone: there the byte bound
    of Arrow batches holds, 64 MB by default, which takes some 300 MB more of an executor.
    """
    if int(spark.conf.get(BATCH)) > TEXT_ROWS:
        spark.conf.set(BATCH, str(TEXT_ROWS))


def spread(scan: DataFrame) -> DataFrame:
    """A scan of fewer partitions than the cluster has cores, dealt out evenly; any larger scan as it is, without a shuffle."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def valid_text(column: str) -> F.Column:
    """A column as text; bytes that are no UTF-8 become U+FFFD."""
    return F.make_valid_utf8(F.col(f"`{column}`").cast("string"))


def refuse_clash(columns, taken) -> None:
    """Raises where columns to be carried along have the names of columns that are added."""
    if clash := set(taken).intersection(columns):
        raise ValueError(f"these names are taken: {sorted(clash)}")


def read_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and whole texts of ``documents``, in a session that is set for them."""
    configure(spark)
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
