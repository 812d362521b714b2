"""Tables between jobs, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_named: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``; only a local session may lack that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
    _named.append(path := f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return path


def _at(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder stands at the path."""
    system, path = _at(spark, path)
    return system.exists(path)


def files(spark: SparkSession, folder: str) -> list[str]:
    """Data files of a folder, by name."""
    system, path = _at(spark, folder)
    return sorted(str(f.getPath()) for f in system.listStatus(path) if f.isFile() and f.getPath().getName()[0] not in "_.") if system.exists(path) else []


def delete(spark: SparkSession, path: str) -> None:
    system, path = _at(spark, path)
    system.delete(path, True)


def clear(spark: SparkSession) -> None:
    """Deletes what stands at the paths that ``scratch`` has named in this process; results that read from there are lost."""
    while _named:
        delete(spark, _named.pop())


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows computed once and written: later reads see the same rows and partitions' values."""
    df.write.parquet(path := scratch(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)
