"""Scoring jobs with a pluggable model function."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from queue import Empty, SimpleQueue
from threading import Thread
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuseval.functions.labels import TIERS, logp_top2, majority_vote, normalize_label, parse_reasoning_and_final, vote_stats
from corpuseval.functions.responses import first_position_logp, parse_json_answer, parsed
from corpuseval.functions.textkeys import first_text, null_words
from corpuseval.operators import metrics
from corpuseval.operators.outcomes import OUTCOME, get_outcome, outcome_is_valid, outcome_struct, put_outcome
from corpuseval.operators.reshape import map_update
from corpuseval.sources.io import last_results
from corpuseval.sources.shared import exists, stored

SCORED = "response_text string, response_json string, attempts int, error string"


def stub_model(messages: list[dict[str, str]], sample: int = 0) -> str:
    """A label that depends on a hash of the last message alone."""
    digest = hashlib.md5(f"{sample}:{messages[-1]['content'] if messages else ''}".encode()).hexdigest()
    return TIERS[int(digest[0], 16) % 4]


def stub_answer(content: Column, sample: Column) -> Column:
    """``stub_model`` as a column."""
    digit = F.conv(F.substring(F.md5(F.concat(sample.cast("string"), F.lit(":"), content)), 1, 1), 16, 10).cast("int") % 4
    return F.element_at(F.array(*map(F.lit, TIERS)), digit + 1)


Asked, Found = TypeVar("Asked"), TypeVar("Found")
#: Answers that leave a task together at most, and seconds until fewer do.
FLUSH, TICK = 256, 1.0


def finished(asked: Iterator[Asked], call: Callable[[Asked], Found], late: Callable[[Asked], Found], threads: int, timeout: float | None = None) -> Iterator[tuple[Asked, Found] | None]:
    """Each of ``asked`` with its answer as calls end, at most ``threads`` at once; None where nothing ended for a while.

    A call that is not done after ``timeout`` seconds is given up: ``late`` answers for it and its place is free.  Its thread is a
    daemon, is replaced, and what it brings later is dropped; all others take call after call.  An error that is no ``Exception`` ends everything.
    """
    done: SimpleQueue = SimpleQueue()
    todo: SimpleQueue = SimpleQueue()
    given_up: set[int] = set()
    running: dict[int, tuple[Asked, float]] = {}
    number, workers, started, more = 0, 0, 0, True

    def work() -> None:
        while (job := todo.get()) is not None:
            n, item = job
            try:
                done.put((n, call(item), None))
            except BaseException as e:  # noqa: BLE001  raised again by the task
                done.put((n, None, e))
            if n in given_up:
                return

    try:
        while True:
            while more and len(running) < threads:
                try:
                    item = next(asked)
                except StopIteration:
                    more = False
                    break
                running[number] = item, time.monotonic() + timeout if timeout else float("inf")
                if workers < len(running):
                    Thread(target=work, daemon=True).start()
                    workers, started = workers + 1, started + 1
                todo.put((number, item))
                number += 1
            if not running:
                return
            try:
                n, result, error = done.get(timeout=max(0.0, min(TICK, min(t for _, t in running.values()) - time.monotonic())))
            except Empty:
                over = [n for n, (_, t) in running.items() if t <= time.monotonic()]
                for n in over:
                    given_up.add(n)
                    workers -= 1
                    item, _ = running.pop(n)
                    yield item, late(item)
                if not over:
                    yield None
                continue
            if error is not None:
                raise error
            if n in running:
                item, _ = running.pop(n)
                yield item, result
    finally:
        for _ in range(started):
            todo.put(None)


def _texts(answer: str | dict | None) -> tuple[str | None, str | None]:
    """Text and JSON of an answer: a text, or a whole response in chat form."""
    if isinstance(answer, dict):
        first = (answer.get("choices") or [{}])[0]
        return (first.get("message") or {}).get("content") or first.get("text"), json.dumps(answer, ensure_ascii=False)
    return answer, json.dumps({"choices": [{"message": {"content": answer}}]}, ensure_ascii=False)


def score(df: DataFrame, model: Callable[[list[dict], int], str | dict], keys: Sequence[str], messages: str = "messages", sample: str | None = None, tasks: int | None = None, threads: int = 8, retries: int = 3, wait: float = 1.0, timeout: float | None = None) -> DataFrame:
    """J1, J3. ``model`` on every row's messages; errors stay with their row after ``retries`` more tries (waits double).

    Calls at once: tasks x threads.  A row that takes more than ``timeout`` seconds with all its tries is given up with the error
    ``timeout``, and the others go on.  Answers leave the task as they come, and the keys alone come back with them.
    The model gives a text, or a response in chat form as a dictionary.
    """
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[tuple[int, int], int] = {}

        def rows() -> Iterator[tuple[pa.RecordBatch, int, int, list[dict], int]]:
            for number, batch in enumerate(batches):
                own = batch.select(keys)
                for at, (asked, place) in enumerate(zip(batch.column("_messages").to_pylist(), batch.column("_sample").to_pylist())):
                    yield own, number, at, asked, place

        def call(row: tuple[pa.RecordBatch, int, int, list[dict], int]) -> tuple[str | None, str | None, int, str | None]:
            _, number, at, asked, place = row
            error = None
            for attempt in range(retries + 1):
                tries[number, at] = attempt + 1
                try:
                    answer = model([dict(m) for m in asked], place)
                    return *_texts(answer), attempt + 1, None
                except Exception as e:  # noqa: BLE001  the model is the caller's: its error is a result
                    error = f"{type(e).__name__}: {e}"
                    if attempt < retries and wait:
                        time.sleep(wait * 2**attempt)
            return None, None, retries + 1, error

        def late(row: tuple[pa.RecordBatch, int, int, list[dict], int]) -> tuple[str | None, str | None, int, str | None]:
            return None, None, tries.get(row[1:3], 0), "timeout"

        def frames(ready: list) -> Iterator[pa.RecordBatch]:
            by_batch: dict[int, list] = {}
            for (own, number, at, *_), result in ready:
                by_batch.setdefault(number, []).append((own, at, result))
            for found in by_batch.values():
                own = found[0][0].take(pa.array([at for _, at, _ in found]))
                results = [pa.array(c, kind) for c, kind in zip(zip(*(r for *_, r in found)), (pa.string(), pa.string(), pa.int32(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*own.columns, *results], names=[*keys, "response_text", "response_json", "attempts", "error"])

        ready, since = [], time.monotonic()
        for end in finished(rows(), call, late, threads, timeout):
            if end is not None:
                tries.pop(end[0][1:3], None)
                ready.append(end)
            if ready and (len(ready) >= FLUSH or time.monotonic() - since > TICK):
                yield from frames(ready)
                ready, since = [], time.monotonic()
        yield from frames(ready)

    rows = df.select(*keys, F.coalesce(F.col(messages), F.array().cast("array<struct<role:string,content:string>>")).alias("_messages"), (F.col(sample) if sample else F.lit(0)).cast("int").alias("_sample"))
    rows = rows.repartition(tasks) if tasks else rows
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(run, f"{kinds}, {SCORED}")


def resume(df: DataFrame, keys: Sequence[str], path: str, work: Callable[[DataFrame], DataFrame], schema: T.StructType) -> DataFrame:
    """L5. Rows of ``work`` for ``df`` by ``keys`` (not null), of which those that ``path`` holds without an error are not done again.

    New rows are appended while the job runs: each task commits its own file as it ends (version 2 of the file committer), so what finished
    tasks of a killed job have brought is there for the next run.  Rows have ``error`` and get ``run``, the number of the run; of a key
    that was done more than once (a task that ran again, a failure that was tried anew) the last good row counts.
    """
    spark, keys = df.sparkSession, list(keys)
    kinds = T.StructType([*schema, T.StructField("run", T.IntegerType())])
    read = lambda: spark.read.schema(kinds).parquet(path) if exists(spark, path) else spark.createDataFrame([], kinds)
    earlier = read()
    run = (earlier.agg(F.max("run")).first()[0] or 0) + 1
    pending = df.join(earlier.where("error is null").select(*keys).distinct(), keys, "left_anti")
    work(pending).withColumn("run", F.lit(run)).write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)
    order = read().withColumn("_order", F.struct(F.col("error").isNull(), "run"))
    return last_results(order, keys, "_order").drop("_order", "run").join(df.select(*keys).distinct(), keys, "left_semi")


def score_once(df: DataFrame, model: Callable, keys: Sequence[str], path: str | None = None, **options) -> DataFrame:
    """J1 written once: at ``path``, where what earlier runs have brought is kept (L5), or in a scratch table."""
    if path is None:
        return stored(score(df, model, keys, **options), "scored")
    schema = T.StructType([*(df.schema[k] for k in keys), *T.StructType.fromDDL(SCORED)])
    return resume(df, keys, path, lambda rows: score(rows, model, keys, **options), schema)


def sample_n(df: DataFrame, n: int) -> DataFrame:
    """J2. Each row n times, with ``sample`` from 0."""
    return df.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def vote_rows(scored: DataFrame, key: str, truth: str, labels: Sequence[str] = TIERS) -> DataFrame:
    """Parsed answers of each item as ordered votes with the winner and statistics; unparsed answers are ``alignment_fail``."""
    vote = F.coalesce(parse_reasoning_and_final("response_text", labels)["label"], F.lit("alignment_fail"))
    listed = scored.groupBy(key, truth).agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", vote.alias("vote")))), lambda s: s["vote"]).alias("votes"))
    return listed.withColumn("vote", majority_vote("votes", labels)).withColumn("stats", vote_stats("votes", truth, labels))


@dataclass(frozen=True)
class Validation:
    """What a run gives: items with their outcomes put back, one result for each item (``reused`` or new), all calls, and what they are split into."""

    items: DataFrame
    results: DataFrame
    scored: DataFrame
    distilled: DataFrame
    dead: DataFrame


def _empty_outcomes() -> Column:
    return F.lit(None).cast(f"map<string,map<string,{OUTCOME}>>")


def validate_job(items: DataFrame, model: Callable, key: str, messages: str, truth: str, name: str, entry: str, outcomes: str = "val_outcome", n: int = 8, logp: bool = False, refill: bool = False, labels: Sequence[str] = TIERS, path: str | None = None, **options) -> Validation:
    """J4. Items of a model and an entry: earlier outcomes are used again where they are valid (H7), all others are scored, in one pass.

    In text mode an item is asked ``n`` times and its answers are votes; with ``refill`` an earlier outcome that lacks votes keeps
    those that it has, and only its null slots are asked (H8).  In ``logp`` mode it is asked once, and its scores are those of the first token.
    Calls are written once (see ``score_once`` for ``path``) and split: ``distilled`` holds those that were answered, ``dead`` those that
    failed.  An item that has a failed call gets no outcome; one without scores in logp mode gets none either.  Items without
    a key or without messages are left as they are and have no result.
    """
    if outcomes not in items.columns:
        items = items.withColumn(outcomes, _empty_outcomes())
    earlier = get_outcome(outcomes, entry, name)
    valid = F.coalesce(outcome_is_valid(earlier, logp, refill), F.lit(False))
    known = items.where(F.col(key).isNotNull()).select(key, truth, messages, earlier.alias("earlier"), valid.alias("valid"))
    votes = F.col("earlier.vote_predictions")
    gaps = F.filter(F.transform(votes, lambda v, k: F.when(v.isNull(), k)), lambda k: k.isNotNull())
    gaps = F.when(F.lit(refill and not logp) & (F.size(gaps) > 0), gaps)
    pending = known.where(~F.col("valid") & (F.size(messages) > 0)).select(key, truth, messages, "earlier", gaps.alias("gaps"))
    slots = F.coalesce("gaps", F.sequence(F.lit(0), F.lit(0 if logp else n - 1)))
    scored = score_once(pending.select(key, messages, F.explode(slots).alias("sample")), model, [key, "sample"], path, messages=messages, sample="sample", **options)
    scored = scored.withColumn("tag", F.when(F.col("error").isNull(), "answered").otherwise("failed"))
    answered, dead = scored.where("tag = 'answered'"), scored.where("tag = 'failed'")
    answer = parse_reasoning_and_final("response_text", labels)
    vote = F.coalesce(answer["label"], F.lit("alignment_fail")).alias("vote")
    scores = first_position_logp(parsed("response_json", "chat"), labels).alias("logp")
    call = F.struct("sample", vote, "response_text", answer["reasoning"].alias("reasoning"), scores if logp else F.lit(None).cast("map<string,double>").alias("logp"))
    of = scored.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("tag") == "answered", call)), lambda a, b: a["sample"] - b["sample"]).alias("calls"), F.bool_or(F.col("tag") == "failed").alias("failed"))
    of = of.where("not failed").select(key, "calls")
    rows = pending.select(key, truth, "earlier", "gaps").join(of, key)
    if logp:
        rows = rows.withColumn("logp", F.map_filter(F.get("calls", F.lit(0))["logp"], lambda _, v: v.isNotNull())).where(F.size("logp") > 0)
        outcome = outcome_struct(logp=F.col("logp"))
    else:
        new = lambda k: F.get(F.filter("calls", lambda c: c["sample"] == k), F.lit(0))["vote"]
        filled = F.when(F.col("gaps").isNotNull(), F.transform(votes, lambda v, k: F.coalesce(v, new(k)))).otherwise(F.transform("calls", lambda c: c["vote"]))
        rows = rows.withColumn("votes", filled)
        rows = rows.withColumns({"vote": majority_vote("votes", labels), "stats": vote_stats("votes", normalize_label(truth, labels), labels)})
        chosen = F.get("calls", F.coalesce(F.col("vote.pick").cast("int"), F.lit(1)) - 1)
        kept = lambda c: F.when(F.col("gaps").isNotNull(), F.col(f"earlier.{c[0]}")).otherwise(chosen[c[1]])
        count = lambda x: F.size(F.filter("votes", lambda v: v == x))
        counts = F.map_filter(F.create_map(*(c for x in labels for c in (F.lit(x), count(x)))), lambda _, k: k > 0)
        tie = F.col("vote.is_tie")
        outcome = outcome_struct(response_text=kept(("response_text", "response_text")), reasoning_content=kept(("reasoning_content", "reasoning")), avg_accuracy=F.col("stats.avg_accuracy"), vote_n=F.col("stats.n"), vote_valid_n=F.col("stats.valid_n"), vote_counts=counts, vote_is_tie=tie, vote_tied=F.col("vote.tied"), vote_predictions=F.col("votes"))
    done = stored(rows.select(key, F.col(truth).alias("_truth"), outcome.alias("_outcome")), "outcomes")
    put = put_outcome(F.coalesce(outcomes, F.create_map().cast(items.schema[outcomes].dataType)), entry, name, F.col("_outcome"))
    written = items.join(done.select(key, "_outcome"), key, "left").withColumn(outcomes, F.when(F.col("_outcome").isNotNull(), put).otherwise(F.col(outcomes))).select(*items.columns)
    reused = known.where("valid").select(key, truth, F.col("earlier").cast(OUTCOME).alias("outcome"), F.lit(True).alias("reused"))
    results = reused.unionByName(done.select(key, F.col("_truth").alias(truth), F.col("_outcome").alias("outcome"), F.lit(False).alias("reused")))
    return Validation(written, results, scored, distill_rows(items, answered, key, truth, messages), dead)


def validation_report(results: DataFrame, truth: str, labels: Sequence[str] = TIERS) -> DataFrame:
    """(metric, label, value) of the results of ``validate_job``: accuracy, balanced accuracy, macro F1, and precision, recall, F1 and support of each label.

    Averages of votes count if any result has one, else scores, else predictions (E13); no results give no rows.
    """
    flat = results.select(F.lit(1).alias("k"), F.col(truth).alias("truth"), "outcome.avg_accuracy", "outcome.vote_predictions", "outcome.is_match", F.lower("outcome.prediction").alias("prediction"), logp_top2(F.col("outcome.logp"), labels).alias("top")).select("*", "top.*").drop("top")
    flat = stored(flat, "flat")
    first = metrics.mode_select(flat, ["k"], "avg_accuracy", "top1", "is_match").first()
    mode = first["mode"] if first else "none"
    if mode == "avg":
        prf, shares = metrics.label_prf_soft(flat, ["k"], "truth", "vote_predictions", labels), metrics.accuracy_match(flat, ["k"], "is_match", "avg_accuracy").select("k", "accuracy_avg")
    elif mode == "logp":
        prf, shares = metrics.label_prf(flat, ["k"], "truth", "top1", labels), metrics.accuracy_top(flat, ["k"], "truth", "top1", "top2")
    else:
        prf, shares = metrics.label_prf(flat, ["k"], "truth", "prediction", labels), metrics.accuracy_match(flat, ["k"], "is_match", "avg_accuracy").select("k", "accuracy_text_match")
    tall = lambda df, label, names: df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("metric"), label.alias("label"), F.col(c).cast("double").alias("value")) for c in names))))
    none, prf = F.lit(None).cast("string"), stored(prf, "prf")
    whole = tall(shares, none, [c for c in shares.columns if c != "k"]).unionByName(tall(metrics.macro(prf, ["k"]), none, ["balanced_accuracy", "macro_f1"]))
    return whole.unionByName(tall(prf, F.col("label"), ["precision", "recall", "f1", "support"]))


def distill_rows(items: DataFrame, scored: DataFrame, key: str, truth: str, messages: str = "messages") -> DataFrame:
    """A18. One request and response for each call."""
    return items.select(key, truth, messages).join(scored, key).select(F.col(key).alias("item_id"), F.col(truth).alias("ground_truth"), messages, "response_text", F.col("response_json").alias("full_response"))


def dead_letters(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A19. Rows that were answered, and rows that failed after all tries."""
    return scored.where("error is null"), scored.where("error is not null")


def _asked(text: Column, prompt: str) -> Column:
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.when(text.isNotNull(), F.array(message("system", F.lit(prompt)), message("user", text)))


def generate_entries_job(items: DataFrame, model: Callable, key: str, text: str, fields: Sequence[str], prompt: str, entries: str = "entries", trials: str = "trial_count", limit: int = 1, **options) -> DataFrame:
    """J6. ``entries`` with the fields of the model's JSON answer to the text, ``status`` and ``trials``.

    Fields that are blank or say nothing (``NULL_WORDS``) are null; they replace what ``entries`` holds, and the row is ``entries_parsed`` with no
    trials. Rows whose call fails or whose answer cannot be read keep their entries; they are ``entries_retrying`` while their trials, this
    one included (see ``claim``), are under ``limit``, then ``entries_failed``. Rows without a text fail at once. Without a column of trials each row is at its first.
    """
    if trials not in items.columns:
        items = items.withColumn(trials, F.lit(1))
    asked = items.withColumn("_messages", _asked(F.when(F.trim(F.col(text)) != "", F.trim(F.col(text))), prompt))
    scored = score(asked.where("_messages is not null").select(key, "_messages"), model, [key], "_messages", **options)
    answers = scored.select(key, parse_json_answer("response_text", fields).alias("_answer"))
    new = F.create_map(*(c for f in fields for c in (F.lit(f), null_words(F.col(f"_answer.{f}")))))
    joined = items.join(answers, key, "left")
    read = F.col("_answer").isNotNull()
    merged = F.when(read, map_update(F.coalesce(entries, F.create_map().cast("map<string,string>")), new)).otherwise(F.col(entries))
    again = (F.trim(F.col(text)) != "") & (F.coalesce(F.col(trials), F.lit(0)) < limit)
    status = F.when(read, "entries_parsed").when(again, "entries_retrying").otherwise("entries_failed")
    return joined.withColumns({entries: merged, "status": status, trials: F.when(read, 0).otherwise(F.col(trials))}).drop("_answer")


def classify_type_job(items: DataFrame, model: Callable, key: str, texts: Sequence[tuple[str, str]], prompt: str, kind: str = "type", **options) -> DataFrame:
    """J7. ``kind`` from the model's JSON answer to the first of ``texts`` (name, column) with text; ``failed`` without text or answer."""
    found = items.select(key, first_text(*texts)["text"].alias("_text"))
    asked = found.where("_text is not null").select(key, _asked(F.col("_text"), prompt).alias("_messages"))
    scored = score(asked, model, [key], "_messages", **options)
    answers = scored.select(key, F.nullif(F.trim(parse_json_answer("response_text", ["type"])["type"]), F.lit("")).alias("_kind"))
    return items.join(answers, key, "left").withColumn(kind, F.coalesce("_kind", F.lit("failed"))).drop("_kind")


#: J8. Named transforms, for ``df.transform(TRANSFORMS[name])``.
TRANSFORMS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register(name: str) -> Callable:
    def put(f: Callable[[DataFrame], DataFrame]) -> Callable:
        if name in TRANSFORMS:
            raise ValueError(f"{name} is registered")
        TRANSFORMS[name] = f
        return f

    return put
