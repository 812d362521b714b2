"""Tables of merged micro-batches, their logs, and steps of a status table."""

import pytest
from pyspark.sql import functions as F

from corpuseval.sources import shared
from corpuseval.sources.shared import scratch
from corpuseval.streaming import jobs


def batch(spark, rows):
    return spark.createDataFrame(rows, "k int, v int")


def rows_of(spark, table):
    return {r.k: r.v for r in jobs.latest(spark, table, "k int, v int").collect()}


def lines(spark, table):
    return spark.read.schema(jobs.LOG).json(f"{table}/log").count()


def test_the_log_stays_short_and_survives_a_crash_within_its_snapshot(spark, monkeypatch):
    table, want = scratch(spark, "log"), {}

    def merge(n):
        rows = [(k, n) for k in range(n % 3, 9, 2)]
        jobs.merge(batch(spark, rows), table, "k", "w", n, parts=3, every=4)
        want.update(rows)
        assert rows_of(spark, table) == want

    for n in range(4):
        merge(n)
    assert len(shared.files(spark, f"{table}/log")) == 4
    kept, deleted = jobs.delete, []

    def dies(session, path):
        if len(deleted) == 2:
            raise RuntimeError("killed")
        deleted.append(path)
        kept(session, path)

    monkeypatch.setattr(jobs, "delete", dies)
    with pytest.raises(RuntimeError, match="killed"):
        jobs.merge(batch(spark, [(1, 100)]), table, "k", "w", 4, parts=3, every=4)
    want[1] = 100
    state = jobs.versions(spark, table)
    assert rows_of(spark, table) == want and state.last == {"w": 4}
    monkeypatch.setattr(jobs, "delete", kept)
    jobs.merge(batch(spark, [(1, -1)]), table, "k", "w", 4, parts=3, every=4)  # the batch comes again: it has been merged
    assert rows_of(spark, table) == want and jobs.versions(spark, table) == state
    for n in range(5, 12):
        merge(n)
        assert lines(spark, table) <= (4 + 1) * (3 + 1) and len(shared.files(spark, f"{table}/log")) <= 5
    jobs.merge(batch(spark, [(1, 7)]), table, "k", "other", 0, parts=3, every=4)  # writers count for themselves
    assert rows_of(spark, table)[1] == 7 and jobs.versions(spark, table).last == {"w": 11, "other": 0}


def flaky(df):
    return df.withColumn("ok", F.col("fails") == 0).withColumn("fails", F.greatest(F.col("fails") - 1, F.lit(0)))


SCHEMA = "id int, status string, trial_count int, fails int"


def test_three_runs_bring_a_row_that_fails_to_its_last_status(spark):
    table = scratch(spark, "stages")
    done = lambda df: df.withColumn("ok", F.lit(True))
    stages = [jobs.Stage("created", "parsed", done), jobs.Stage("parsed", "read", flaky), jobs.Stage("read", "ended", done)]
    rows = spark.createDataFrame([(k, "created", 0, k) for k in range(4)] + [(9, "elsewhere", 0, 0)], SCHEMA)
    jobs.enqueue(rows, table, "id", parts=2)
    jobs.enqueue(rows.withColumn("fails", F.lit(99)), table, "id", parts=2)  # keys that are there stay as they are
    seen = []
    for _ in range(4):
        jobs.stage_chain(spark, table, rows.schema, "id", stages, f"{table}-checkpoints", parts=2)
        seen.append({r.id: (r.status, r.trial_count) for r in jobs.latest(spark, table, SCHEMA).collect()})
    other = {9: ("elsewhere", 0)}
    assert seen[0] == {0: ("ended", 0), **{k: ("read_retrying", 1) for k in (1, 2, 3)}} | other
    assert seen[1] == {0: ("ended", 0), 1: ("ended", 0), 2: ("read_retrying", 2), 3: ("read_retrying", 2)} | other
    assert seen[2] == {k: ("ended", 0) for k in (0, 1, 2)} | {3: ("read_failed", 3)} | other
    assert seen[3] == seen[2]
    more = spark.createDataFrame([(20, "created", 0, 0)], SCHEMA)
    jobs.enqueue(more, table, "id", parts=2)
    jobs.stage_chain(spark, table, rows.schema, "id", stages, f"{table}-checkpoints", parts=2)
    assert {r.id: (r.status, r.trial_count) for r in jobs.latest(spark, table, SCHEMA).collect()} == seen[2] | {20: ("ended", 0)}


def test_a_step_that_dies_after_its_claim_goes_on_without_another_trial(spark):
    table = scratch(spark, "claims")
    rows = spark.createDataFrame([(1, "created", 0, 0)], SCHEMA)
    jobs.enqueue(rows, table, "id", parts=2)

    def dies(df):
        raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        jobs.stage_step(spark, table, rows.schema, "id", jobs.Stage("created", "parsed", dies), f"{table}-checkpoint", parts=2)
    assert [tuple(r) for r in jobs.latest(spark, table, SCHEMA).collect()] == [(1, "parsed_processing", 1, 0)]
    fails = jobs.Stage("created", "parsed", lambda df: df.withColumn("ok", F.lit(False)))
    jobs.stage_step(spark, table, rows.schema, "id", fails, f"{table}-checkpoint", parts=2)
    assert [tuple(r) for r in jobs.latest(spark, table, SCHEMA).collect()] == [(1, "parsed_retrying", 1, 0)]
