"""Incremental jobs: new files once, status machines, and merging results."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuseval.sources.io import upsert
from corpuseval.sources.shared import delete, exists, files, stored


def ingest_stream(spark: SparkSession, path: str, schema: str, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """L1. JSONL files that have not been taken yet, filtered and transformed, appended as Parquet."""
    rows = spark.readStream.schema(schema).json(path)
    transform(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def claim(df: DataFrame, status: str = "status", trials: str = "trial_count", to: str = "processing") -> DataFrame:
    """L2. A claimed row: status set and one more trial."""
    return df.withColumn(status, F.lit(to)).withColumn(trials, F.coalesce(F.col(trials), F.lit(0)) + 1)


def advance_status(df: DataFrame, ok: Column, done: str, retrying: str, failed: str, limit: int = 3, status: str = "status", trials: str = "trial_count") -> DataFrame:
    """L2. After work: done with no trials, retrying below the limit, else failed."""
    good = F.coalesce(ok, F.lit(False))
    return df.withColumn(status, F.when(good, done).when(F.col(trials) < limit, retrying).otherwise(failed)).withColumn(trials, F.when(good, 0).otherwise(F.col(trials)))


def eligible(df: DataFrame, new: str, retrying: str, limit: int = 3, status: str = "status", trials: str = "trial_count") -> DataFrame:
    """L3. Rows that a stage may take."""
    return df.where((F.col(status) == new) | ((F.col(status) == retrying) & (F.coalesce(F.col(trials), F.lit(0)) < limit)))


#: Parts of a table that ``upsert_stream`` keeps, by a hash of the key, and files of its log that make a snapshot.
PARTS, SNAPSHOT = 64, 32
#: A line of the log: the batch that a writer has merged, and the slot of a part from the version ``seq`` on.
LOG = "writer string, batch long, seq long, part int, slot int"


@dataclass(frozen=True)
class Versions:
    """What the log says: the last batch of each writer, the next version, and the current version and slot of each part."""

    last: dict[str, int]
    seq: int
    parts: dict[int, tuple[int, int]]

    def slots(self, parts=None) -> dict[int, int]:
        return {k: slot for k, (_, slot) in self.parts.items() if parts is None or k in parts}


def versions(spark: SparkSession, table: str) -> Versions:
    """The state of a table.  The log has at most a line for each part in each of its files, whose number ``snapshot`` bounds."""
    last: dict[str, int] = {}
    parts: dict[int, tuple[int, int]] = {}
    if exists(spark, f"{table}/log"):
        for r in spark.read.schema(LOG).json(f"{table}/log").collect():
            if r["writer"] is not None:
                last[r["writer"]] = max(last.get(r["writer"], -1), r["batch"])
            if r["part"] is not None:
                parts[r["part"]] = max(parts.get(r["part"], (-1, 0)), (r["seq"], r["slot"]))
    return Versions(last, 1 + max((seq for seq, _ in parts.values()), default=-1), parts)


def snapshot(spark: SparkSession, table: str, every: int = SNAPSHOT) -> None:
    """Once the log has more than ``every`` files, one file of the state in place of all.

    The state is written before the files that it stands for are deleted.  It has their batches and versions, so a crash between the two, or within the
    deletion, leaves a log that says the same.
    """
    old = files(spark, f"{table}/log")
    if len(old) <= every:
        return
    now = versions(spark, table)
    lines = [(w, n, None, None, None) for w, n in now.last.items()] + [(None, None, seq, k, slot) for k, (seq, slot) in now.parts.items()]
    spark.createDataFrame(lines, LOG).coalesce(1).write.mode("append").json(f"{table}/log")
    for path in old:
        delete(spark, path)


def _stored_parts(spark: SparkSession, table: str, schema, slots: dict[int, int]) -> DataFrame:
    """Rows of the parts given, each from its current slot."""
    paths = [f"{table}/slot={slot}/_part={part}" for part, slot in sorted(slots.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _part(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def merge(batch: DataFrame, table: str, key: str, writer: str, n: int, order: str | None = None, parts: int = PARTS, every: int = SNAPSHOT) -> None:
    """Batch ``n`` of a writer merged into a table of ``parts`` parts by a hash of the key; one job at a time may merge.

    Only the parts that the batch touches are read and written, each into the one of its two slots that is not current, so at most two
    versions of a part exist.  A line of ``table/log`` for each part makes them current at once; a batch that comes again after
    that is skipped, one that comes again before it writes the same slots.
    """
    session, schema = batch.sparkSession, batch.schema
    state = versions(session, table)
    if n <= state.last.get(writer, -1):
        return
    part = _part(key, parts)
    touched = [r[0] for r in batch.select(part).distinct().collect()]
    if not touched:
        return
    old = _stored_parts(session, table, schema, state.slots(touched))
    if order:  # of old and new rows the last counts, and the new one of equals, in whatever order files come
        ranked = lambda df, new: df.withColumn("_rank", F.struct(F.col(order), F.lit(new)))
        both = ranked(old, 0).unionByName(ranked(batch, 1))
        merged = upsert(both.limit(0), both, key, "_rank").drop("_rank")
    else:
        merged = upsert(old, batch, key)
    merged = merged.withColumn("_part", part)
    slots = state.slots()
    target = {k: 1 - slots.get(k, 1) for k in touched}
    for slot in sorted(set(target.values())):
        own = merged.where(F.col("_part").isin([k for k in touched if target[k] == slot]))
        own.repartition(F.col("_part")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(f"{table}/slot={slot}")
    session.createDataFrame([(writer, n, state.seq, k, s) for k, s in target.items()], LOG).coalesce(1).write.mode("append").json(f"{table}/log")
    snapshot(session, table, every)


def upsert_stream(rows: DataFrame, table: str, key: str, checkpoint: str, order: str | None = None, parts: int = PARTS, writer: str = "stream", every: int = SNAPSHOT) -> None:
    """L4. Every micro-batch merged into a table (see ``merge``); ``writer`` names the stream in the table's log."""
    run = lambda batch, n: merge(batch, table, key, writer, n, order, parts, every)
    rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, table: str, schema) -> DataFrame:
    """The current rows of a table of ``upsert_stream``."""
    return _stored_parts(spark, table, schema, versions(spark, table).slots())


# ---- L6: a table of rows with a status, moved on by one streaming step after another


@dataclass(frozen=True)
class Stage:
    """A step from one status to the next; ``work`` gives the claimed rows with whatever it changes and a boolean ``ok``."""

    source: str
    target: str
    work: Callable[[DataFrame], DataFrame]


def enqueue(rows: DataFrame, table: str, key: str, parts: int = PARTS) -> None:
    """New rows (with ``status`` and ``trial_count``) put into the table and signalled to all steps; keys that it has stay as they are."""
    spark = rows.sparkSession
    n = versions(spark, table).last.get("enqueue", -1) + 1
    fresh = stored(rows.join(latest(spark, table, rows.schema).select(key), key, "left_anti"), "fresh")
    merge(fresh, table, key, "enqueue", n, parts=parts)
    rows.select(key).write.mode("overwrite").parquet(f"{table}/signals/enqueue-{n}")


def stage_step(spark: SparkSession, table: str, schema: T.StructType, key: str, stage: Stage, checkpoint: str, limit: int = 3, parts: int = PARTS) -> None:
    """One step over all rows that were signalled since its last run.

    A signal is a key; the table says whether its row is eligible.  Rows are claimed in the table (one more trial), worked on, and put
    back as done with no trials, retrying, or failed; then they are signalled, so the next step takes them in the same run and this one
    takes those that retry in its next run.  Each of the three writes is of a batch that a log or a path names: a batch that comes again after
    a crash goes on with the rows that it has claimed, without another trial.
    """
    signals = spark.readStream.schema(T.StructType([schema[key]])).option("recursiveFileLookup", True).parquet(f"{table}/signals")
    retrying, claimed_as = f"{stage.target}_retrying", f"{stage.target}_processing"

    def run(batch: DataFrame, n: int) -> None:
        session = batch.sparkSession
        keys = batch.select(key).distinct()
        state = versions(session, table)
        touched = {r[0] for r in keys.select(_part(key, parts)).distinct().collect()}
        current = _stored_parts(session, table, schema, state.slots(touched)).join(keys, key, "left_semi")
        done = state.last.get(stage.target, -1)
        if done < 2 * n:  # numbers of a claim are even, of its result odd
            merge(stored(claim(eligible(current, stage.source, retrying, limit), to=claimed_as).select(schema.names), "claimed"), table, key, stage.target, 2 * n, parts=parts)
            current = _stored_parts(session, table, schema, versions(session, table).slots(touched)).join(keys, key, "left_semi")
        if done < 2 * n + 1:
            worked = advance_status(stage.work(current.where(F.col("status") == claimed_as)), F.col("ok"), stage.target, retrying, f"{stage.target}_failed", limit)
            worked = stored(worked.select(schema.names), "worked")
            worked.select(key).write.mode("overwrite").parquet(f"{table}/signals/{stage.target}-{n}")
            merge(worked, table, key, stage.target, 2 * n + 1, parts=parts)

    signals.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stage_chain(spark: SparkSession, table: str, schema: T.StructType, key: str, stages: list[Stage], checkpoints: str, limit: int = 3, parts: int = PARTS) -> None:
    """L6. All steps in turn, each with its own checkpoint; a row goes through as many as succeed."""
    for stage in stages:
        stage_step(spark, table, schema, key, stage, f"{checkpoints}/{stage.target}", limit, parts)
