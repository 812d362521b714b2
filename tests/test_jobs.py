"""Scoring jobs: deadlines, earlier outcomes, caches, and runs that are killed half way."""

import glob
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from corpuseval.functions import labels as lb
from corpuseval.operators import outcomes as oc
from corpuseval.operators import pairs as pr
from corpuseval.operators import scoring as sc
from corpuseval.sources.shared import scratch

ASKED = "id int, messages array<struct<role:string,content:string>>"


def asked(spark, texts):
    return spark.createDataFrame([(k, [("user", t)]) for k, t in texts.items()], ASKED)


def counting(folder, answer):
    """A model that leaves a file for each call."""

    def model(messages, sample):
        with open(f"{folder}/{os.getpid()}-{time.time_ns()}-{sample}", "w") as f:
            f.write(messages[-1]["content"])
        return answer(messages[-1]["content"], sample)

    return model


def calls(folder):
    return sorted(open(p).read() for p in glob.glob(f"{folder}/*"))


def test_calls_end_in_any_order_and_late_ones_are_given_up():
    def call(x):
        time.sleep(x)
        return x * 10

    began = time.monotonic()
    ends = [e for e in sc.finished(iter([0.4, 30, 0.1, 0.0, 31]), call, lambda x: "late", 2, 1.0) if e is not None]
    assert time.monotonic() - began < 10 and sorted(map(str, ends)) == sorted(map(str, [(0.4, 4.0), (30, "late"), (0.1, 1.0), (0.0, 0.0), (31, "late")]))
    with pytest.raises(SystemExit):
        list(sc.finished(iter([1]), lambda x: exec("raise SystemExit"), lambda x: None, 2))


def test_threads_take_call_after_call(monkeypatch):
    """Two threads for 200 calls, and one more for each that hangs."""
    started = []
    monkeypatch.setattr(sc, "Thread", lambda real=sc.Thread, **k: (started.append(1), real(**k))[1])
    hang = lambda x: time.sleep(20) if x in (50, 51, 120) else x
    ends = [e for e in sc.finished(iter(range(200)), hang, lambda x: "late", 2, 0.5) if e is not None]
    assert sorted(ends) == [(x, "late" if x in (50, 51, 120) else x) for x in range(200)] and len(started) <= 5


def test_keys_that_no_double_holds_come_back_beside_null_keys(spark):
    rows = spark.createDataFrame([(2**53 + 1, [("user", "a")]), (None, [("user", "b")])], "id long, messages array<struct<role:string,content:string>>").coalesce(1)
    assert {(r.id, r.response_text) for r in sc.score(rows, lambda m, k: m[0]["content"], ["id"]).collect()} == {(2**53 + 1, "a"), (None, "b")}


def test_a_report_reads_its_results_once(spark):
    """However many figures it has: what comes before is one scan, not one for each."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    outcome = oc.outcome_struct(avg_accuracy=F.lit(1.0), vote_predictions=F.array(F.lit("fair")))
    results = spark.range(5).mapInArrow(count, "id long").select("id", F.lit("fair").alias("truth"), outcome.alias("outcome"))
    got = {(r.metric, r.label): r.value for r in sc.validation_report(results, "truth").collect()}
    assert got["accuracy_avg", None] == 1.0 and got["recall", "fair"] == 1.0 and seen.value == 5


def test_a_hanging_call_is_one_error_row(spark):
    def model(messages, sample):
        if messages[-1]["content"] == "hang":
            time.sleep(600)
        return "fair"

    rows = asked(spark, {k: "hang" if k == 3 else f"t{k}" for k in range(20)}).coalesce(1)
    began = time.monotonic()
    got = {r.id: (r.response_text, r.error) for r in sc.score(rows, model, ["id"], threads=2, timeout=3).collect()}
    assert time.monotonic() - began < 60
    assert got.pop(3) == (None, "timeout") and len(got) == 19 and set(got.values()) == {("fair", None)}


def test_null_keys_and_whole_responses(spark):
    rows = spark.createDataFrame([(1, None, [("user", "a")]), (None, "k", [("user", "b")])], "id int, k string, messages array<struct<role:string,content:string>>")
    response = {"choices": [{"message": {"content": "Fair"}, "logprobs": {"content": [{"token": "Fair", "logprob": -0.1, "top_logprobs": [{"token": "Fair", "logprob": -0.1}]}]}}]}
    got = sorted(map(tuple, sc.score(rows, lambda m, k: response, ["id", "k"]).collect()), key=str)
    assert [g[:3] for g in got] == [(1, None, "Fair"), (None, "k", "Fair")] and json.loads(got[0][3]) == response


def test_validation_uses_what_is_there(spark, tmp_path):
    """A first run asks all, a second one nothing, and one with two null votes exactly twice."""
    texts = {k: f"text {k}" for k in range(6)}
    items = asked(spark, texts).withColumn("truth", F.lit("Strong"))
    model = counting(tmp_path, lambda text, k: "Strong" if k < 2 else "fair")
    first = sc.validate_job(items, model, "id", "messages", "truth", "m", "e", n=4, refill=True)
    assert len(calls(tmp_path)) == 24 and first.dead.count() == 0 and first.distilled.count() == 24
    o = {r.id: r.o for r in first.items.select("id", oc.get_outcome("val_outcome", "e", "m").alias("o")).collect()}
    assert all((v.vote_predictions, v.avg_accuracy, v.vote_counts, v.vote_is_tie, v.vote_tied, v.response_text) == (["strong", "strong", "fair", "fair"], 0.5, {"fair": 2, "strong": 2}, True, ["fair", "strong"], "fair") for v in o.values())
    items = spark.createDataFrame(first.items.collect(), first.items.schema)
    second = sc.validate_job(items, model, "id", "messages", "truth", "m", "e", n=4, refill=True)
    assert second.scored.count() == 0 and len(calls(tmp_path)) == 24 and {r.reused for r in second.results.collect()} == {True} and second.results.count() == 6
    gaps = F.when(F.col("id") == 2, F.array(F.lit("strong"), F.lit(None), F.lit("fair"), F.lit(None)).cast("array<string>"))
    broken = items.withColumn("val_outcome", F.when(F.col("id") == 2, oc.put_outcome("val_outcome", "e", "m", oc.outcome_struct(response_text=F.lit("kept"), vote_predictions=gaps))).otherwise(F.col("val_outcome")))
    third = sc.validate_job(broken, model, "id", "messages", "truth", "m", "e", n=4, refill=True)
    assert len(calls(tmp_path)) == 26
    own = third.items.where("id = 2").select(oc.get_outcome("val_outcome", "e", "m").alias("o")).first().o
    assert own.vote_predictions == ["strong", "strong", "fair", "fair"] and own.response_text == "kept" and own.avg_accuracy == 0.5
    assert sc.validate_job(broken, model, "id", "messages", "truth", "m", "e", n=4).scored.count() == 0  # without refill an outcome with gaps is used
    report = {(r.metric, r.label): r.value for r in sc.validation_report(third.results, "truth").collect()}
    assert report["accuracy_avg", None] == 0.5 and report["recall", "strong"] == 0.5 and report["support", "strong"] == 6.0
    assert sc.validation_report(third.results.limit(0), "truth").where("metric = 'accuracy_avg'").count() == 0


def test_validation_failures_and_scores(spark):
    def model(messages, sample):
        text = messages[-1]["content"]
        if text == "down" and sample == 1:
            raise RuntimeError("down")
        tops = [{"token": "Fair", "logprob": -0.2}, {"token": "Strong", "logprob": -1.5}] if text != "odd" else [{"token": "?", "logprob": -0.2}]
        return {"choices": [{"message": {"content": "Fair"}, "logprobs": {"content": [{"token": "Fair", "logprob": -0.2, "top_logprobs": tops}]}}]}

    rows = [(1, [("user", "good")], "fair"), (2, [("user", "down")], "fair"), (3, [], "fair"), (4, None, None), (None, [("user", "x")], "fair"), (5, [("user", "odd")], "strong")]
    items = spark.createDataFrame(rows, "id int, messages array<struct<role:string,content:string>>, truth string")
    run = sc.validate_job(items, model, "id", "messages", "truth", "m", "e", n=2, retries=0)
    assert [(r.id, r["sample"]) for r in run.dead.collect()] == [(2, 1)] and run.distilled.count() == 5
    assert sorted(r.id for r in run.results.collect()) == [1, 5] and run.items.count() == 6
    assert {r.id for r in run.items.where("val_outcome is not null").collect()} == {1, 5}
    scores = sc.validate_job(items, model, "id", "messages", "truth", "m", "e", logp=True, retries=0)
    assert {r.id: r.outcome.logp for r in scores.results.collect()} == {1: {"fair": -0.2, "strong": -1.5}, 2: {"fair": -0.2, "strong": -1.5}}
    assert {(r.metric, r.label): r.value for r in sc.validation_report(scores.results, "truth").collect()}["accuracy_top1", None] == 1.0


def test_a_killed_run_leaves_what_its_tasks_have_finished(spark, tmp_path):
    """The first run dies on one row; the second asks only for rows of tasks that had not ended."""
    done, path = tmp_path / "calls", scratch(spark, "resume")
    done.mkdir()
    rows = asked(spark, {k: f"t{k}" for k in range(64)}).repartition(8, "id")

    def dies(text, sample):
        if text == "t50":
            time.sleep(3)
            raise SystemExit
        return "fair"

    with pytest.raises(Exception):  # noqa: B017  what Spark raises for a dead task
        sc.score_once(rows, counting(done, dies), ["id"], path, threads=2)
    kept = spark.read.parquet(path)
    finished = {r.id for r in kept.collect()}
    assert 0 < len(finished) < 64
    before = len(calls(done))
    got = sc.score_once(rows, counting(done, lambda text, k: "fair"), ["id"], path)
    assert sorted(calls(done)) and len(calls(done)) - before == 64 - len(finished)
    assert sorted(r.id for r in got.collect()) == list(range(64)) and got.where("error is not null").count() == 0
    sc.score_once(rows, counting(done, lambda text, k: "fair"), ["id"], path)
    assert len(calls(done)) - before == 64 - len(finished)


def test_failed_rows_are_tried_again(spark):
    path, rows = scratch(spark, "again"), asked(spark, {1: "a", 2: "b"})

    def model(messages, sample):
        if messages[-1]["content"] == "b":
            raise ValueError("no")
        return "fair"

    assert {r.id: r.error for r in sc.score_once(rows, model, ["id"], path, retries=0).collect()} == {1: None, 2: "ValueError: no"}
    assert {r.id: r.response_text for r in sc.score_once(rows, lambda m, k: "strong", ["id"], path).collect()} == {1: "fair", 2: "strong"}


def test_pairs_are_asked_once(spark, tmp_path):
    items = spark.createDataFrame([(k, lb.TIERS[k % 4], f"text {k}" if k != 5 else " ") for k in range(24)], "id int, tier string, text string")
    path, folder = scratch(spark, "pairs"), str(tmp_path)

    def answer(text, sample):
        if len(os.listdir(folder)) == 30:
            raise TimeoutError("gone")
        return "<think>x</think>\nFirst" if "2" in text else "none of them"

    runs = [pr.pair_job(items, counting(tmp_path, answer), "id", "tier", "text", "p", 8, 3, path, retries=0, tasks=2).collect() for _ in range(3)]
    questions = calls(tmp_path)
    assert len(runs[2]) == len(set(questions)) and len(questions) - len(set(questions)) <= 2
    assert len(runs[1]) == len(runs[2]) and sorted(map(str, runs[1])) == sorted(map(str, runs[2]))
    for r in runs[2]:
        higher = "first" if lb.TIERS.index(r.rank_first) < lb.TIERS.index(r.rank_second) else "second"
        assert r.correct_position == higher and r.alignment_fail == (r.prediction is None) and r.is_correct == (r.prediction == higher)
        assert r.distance == abs(lb.TIERS.index(r.rank_first) - lb.TIERS.index(r.rank_second)) and 5 not in (r.first, r.second)


def test_entries_are_retried_up_to_the_limit(spark):
    def model(messages, sample):
        if messages[-1]["content"] == "bad":
            raise RuntimeError("down")
        return '{"a": " x ", "b": "None", "c": "none"}'

    rows = [(1, "ok", 2), (2, "bad", 1), (3, "bad", 3), (4, " ", 0), (5, "bad", None), (6, None, 1)]
    df = spark.createDataFrame(rows, "id int, text string, trial_count int").withColumn("entries", F.lit(None).cast("map<string,string>"))
    got = {r.id: (r.status, r.trial_count, r.entries) for r in sc.generate_entries_job(df, model, "id", "text", ["a", "b", "c"], "p", limit=3, retries=0).collect()}
    assert got == {1: ("entries_parsed", 0, {"a": "x", "b": None, "c": "none"}), 2: ("entries_retrying", 1, None), 3: ("entries_failed", 3, None), 4: ("entries_failed", 0, None), 5: ("entries_retrying", None, None), 6: ("entries_failed", 1, None)}
