"""Rules that the tables do not show, on small frames."""

import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpuseval.plans.q_evaluation  # noqa: F401  registers a transform
from corpuseval.functions import labels as lb
from corpuseval.functions import responses as rp
from corpuseval.functions import textkeys as tk
from corpuseval.operators import filters as fl
from corpuseval.operators import linkage as lk
from corpuseval.operators import lines as ln
from corpuseval.operators import metrics as mt
from corpuseval.operators import pairs as pr
from corpuseval.operators import quotas as qt
from corpuseval.operators import reshape as rs
from corpuseval.operators import sampling as sm
from corpuseval.operators import scoring as sc
from corpuseval.sources import io, shared
from corpuseval.sources.shared import scratch
from corpuseval.streaming import jobs


def ids(df, cond):
    return sorted(r.id for r in df.where(cond).collect())


def test_filters_and_missing_values(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "B", None), (3, None, 7), (4, "", 9)], "id int, v string, n int")
    f = fl.Filter
    assert ids(df, fl.condition(f("v", "eq", None))) == [3] and ids(df, fl.condition(f("v", "ne", "a"))) == [2, 3, 4]
    assert ids(df, fl.condition(f("v", "in", ["a", None]))) == [1, 3] and ids(df, fl.condition(f("v", "nin", ["a"]))) == [2, 3, 4]
    assert ids(df, fl.condition(f("v", "nin", ["a", None]))) == [2, 4] and ids(df, fl.condition(f("v", "in", []))) == []
    assert ids(df, fl.condition(f("n", "gt", 5))) == [3, 4] and ids(df, fl.condition(f("n", "lte", 7))) == [1, 3]
    assert ids(df, fl.condition(f("v", "contains", "b"))) == [] and ids(df, fl.condition(f("v", "contains", "b"), "store")) == [2]
    assert ids(df, fl.condition(f("v", "contains", ""))) == [1, 2]
    assert ids(df, fl.all_of([f("n", "gt", 4), f("n", "lt", 8)])) == [1, 3] and ids(df, fl.all_of([])) == [1, 2, 3, 4]
    with pytest.raises(ValueError, match="page"):
        fl.paginate(df, 0, 10, "id")


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(fl.all_of([fl.Filter("lang", "eq", "en"), fl.Filter("n_chars", "gt", 10)])).select("doc_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualNullSafe(lang,en)" in plan and "text" not in plan.split("ReadSchema")[1][:80]


def test_top_k_is_cut_before_the_shuffle(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang")
    plan = sm.balance_random(df, ["lang"], 3, 1, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in zip(values, column[1], strict=True)))
    return df.select(column[0].alias("r")).first()["r"]


def test_score_ties(spark):
    kind = ["map<string,double>"]
    assert tuple(one(spark, (lb.logp_top2("m"), kind), m={"fair": -1.0, "strong": -1.0})) == ("strong", -1.0, "fair", -1.0)
    assert tuple(one(spark, (lb.logp_top2("m"), kind), m={"fair": -1.0})) == ("fair", -1.0, "exceptional", None)
    assert tuple(one(spark, (lb.logp_top2("m"), kind), m={})) == (None, None, None, None)
    assert one(spark, (lb.logp_argmax("m"), kind), m={"limited": -2.0, "fair": -2.0}) == "fair"
    assert one(spark, (lb.logp_argmax("m"), kind), m={"x": 1.0}) is None
    assert one(spark, (lb.logp_argmax_alpha("m"), kind), m={" Strong": -1.0, "Exceptional ": -1.0}) == "exceptional"


def test_reasoning_forms(spark):
    answers = {
        "<think>why</think>\n**Strong**": ("why", "strong"),
        "<reasoning>r</reasoning><think>t</think><final>Fair.</final>": ("r", "fair"),
        "first line\nlimited": ("first line", "limited"),
        "Exceptional!": (None, "exceptional"),
        "no label here": (None, None),
        "<final> Limited\n</final> strong": (None, "limited"),
        "<think>a</think>Limited": ("a", None),
        "<final></final>\nStrong": (None, None),
        "<reasoning></reasoning><think>t</think>\nFair": ("", "fair"),
        "one\r\ntwo\u2028 Fair. ": ("one\ntwo", "fair"),
        "  ": (None, None),
    }
    df = spark.createDataFrame([(a,) for a in answers], "a string").select("a", lb.parse_reasoning_and_final("a").alias("r"))
    assert {r.a: tuple(r.r) for r in df.collect()} == answers


def test_votes(spark):
    df = spark.createDataFrame([(1, ["fair", "strong", None, "strong", "fair"]), (2, ["alignment_fail", None]), (3, []), (4, ["limited"])], "id int, v array<string>")
    got = {r.id: tuple(r.r) for r in df.select("id", lb.majority_vote("v").alias("r")).collect()}
    assert got == {1: ("fair", True, ["fair", "strong"], 1), 2: (None, False, None, None), 3: (None, False, None, None), 4: ("limited", False, None, 1)}


def test_ranks(spark):
    values = [" A* ", "Moderate", "tier4", "unknown", None, "ABOVE_AVERAGE"]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string").orderBy("k")
    assert [r[0] for r in df.select(lb.normalize_rank("v")).collect()] == ["exceptional", "fair", "limited", None, None, "strong"]
    assert [r[0] for r in spark.createDataFrame([(3.9,), (0.5,), (4.0,)], "v double").select(lb.normalize_rank("v", numeric=True)).collect()] == ["strong", None, "exceptional"]


def test_text_keys(spark):
    df = spark.createDataFrame([("The Journal of Ｆｕｌｌ & Wide?",)], "v string")
    assert df.select(tk.journal_key("v")).first()[0] == "journal of full and wide"
    assert df.select(tk.alnum_key("v")).first()[0] == "thejournaloffullwide"
    assert spark.createDataFrame([(" /DOI/10.1 / X ",)], "v string").select(tk.identifier_key("v")).first()[0] == "10.1/x"
    assert spark.createDataFrame([("Straße, straße — Über!",)], "v string").select(F.array_sort(tk.title_tokens("v"))).first()[0] == ["straße", "über"]
    assert spark.createDataFrame([(" ..a<b>:c.txt. ",)], "v string").select(tk.safe_file_key("v")).first()[0] == "a_b__c.txt"
    assert spark.createDataFrame([("x" * 300 + ".json",)], "v string").select(F.length(tk.safe_file_key("v")), tk.safe_file_key("v").endswith(".json")).first() == (255, True)
    names = {"a\x7fb\x01c": "abc", " .. ": "unnamed", "": "unnamed", "a." + "e" * 300: "e", "a|b?.txt": "a_b_.txt", "n" * 260: "n" * 255}
    got = {r.v: r.k for r in spark.createDataFrame([(n,) for n in names], "v string").select("v", tk.safe_file_key("v").alias("k")).collect()}
    assert got.pop("a." + "e" * 300) == "." + "e" * 300 and all(got[n] == names[n] for n in got)
    assert spark.createDataFrame([("a\rb\r\nc\r\r\rd\u00a0",)], "v string").select(tk.clean_text("v")).first()[0] == "a\nb\nc\n\nd"
    words = {" null ": None, "None": None, "N/A": None, " ": None, "NULL": "NULL", "none": "none", "n/a": "n/a"}
    assert {r.v: r.k for r in spark.createDataFrame([(w,) for w in words], "v string").select("v", tk.null_words("v").alias("k")).collect()} == words
    assert spark.createDataFrame([("\r\na\r\n\n\n\nb\x00 ",)], "v string").select(tk.clean_text("v")).first()[0] == "a\n\nb"


def test_responses(spark):
    chat = '{"choices":[{"text":"t","logprobs":{"content":[{"token":" Strong","logprob":-0.5,"top_logprobs":[{"token":"Fair","logprob":-1},{"token":"fair ","logprob":-0.1},{"token":"except","logprob":-3}]},{"token":"Fair","logprob":-0.05,"top_logprobs":null}]}}]}'
    r = spark.createDataFrame([(chat,)], "v string").select(rp.parsed("v", "chat").alias("r"))
    assert r.select(rp.chat_text(F.col("r"))).first()[0] == "t"
    assert r.select(rp.first_position_logp(F.col("r"))).first()[0] == {"fair": -1.0, "exceptional": -3.0}
    assert r.select(rp.max_position_logp(F.col("r"))).first()[0] == {"fair": -0.05, "exceptional": -3.0, "strong": -0.5}
    lenient = spark.createDataFrame([("Sure: {a: 'x', /* c */ b: null}",), ("none",)], "v string").select(rp.parse_json_answer("v", ["a", "b"]).alias("r")).collect()
    assert tuple(lenient[0].r) == ("x", None) and lenient[1].r is None


def test_jsonl_bad_lines_and_types(spark):
    path = scratch(spark, "bad")
    spark.createDataFrame([('{"k":"a","n":1}',), ("",), ("not json",), ('{"k":5,"n":"x"}',), ('{"k":"é 日本","n":null}',)], "value string").coalesce(1).write.text(path)
    got = io.read_jsonl(spark, path, "k string, n int")
    assert got.count() == 3 and {r.k for r in got.collect()} == {"a", "5", "é 日本"} or got.count() == 3
    with pytest.raises(Exception, match="not JSON"):
        io.read_jsonl(spark, path, "k string, n int", strict=True).collect()


def test_files_with_one_name_are_entries_of_their_subjects(spark, tmp_path):
    names = ["EN/a-b.pdf", "FR/ab.pdf", "FR/A - B.pdf", "FR/论文.pdf", "EN/文献.pdf", "EN/other.txt"]
    for n in names:
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text("x")
    catalog = io.read_file_catalog(spark, str(tmp_path))
    tail = lambda p: p.split(str(tmp_path) + "/")[1]
    assert {(tail(r.path), r.name_key, r.stem_key, r.subject) for r in catalog.collect()} == {
        ("EN/a-b.pdf", "a-b.pdf", "a-b", "EN"), ("FR/ab.pdf", "ab.pdf", "ab", "FR"), ("FR/A - B.pdf", "a-b.pdf", "a-b", "FR"), ("FR/论文.pdf", "论文.pdf", "论文", "FR"), ("EN/文献.pdf", "文献.pdf", "文献", "EN")}
    index = io.file_index(catalog)
    assert {(r.key, tail(r.path)) for r in index.where("kind = 'name'").collect()} == {("a-b.pdf", "EN/a-b.pdf"), ("ab.pdf", "FR/ab.pdf"), ("论文.pdf", "FR/论文.pdf"), ("文献.pdf", "EN/文献.pdf")}
    rows = [
        (1, "fr", "x/a-b.pdf", None, None, None, None),  # the subject's own copy
        (2, None, "x/A-B.PDF", None, None, None, None),  # no subject: the first path
        (3, "FR", "x/none.pdf", None, "文献.pdf", None, None),  # only another subject has it
        (4, "EN", None, "ab.pdf", "a-b.pdf", None, None),  # an earlier probe anywhere is before a later one in the subject
        (5, "EN", None, None, None, "AB", "a-b"),
        (6, "EN", None, None, None, None, " 论文 "),
        (7, "EN", "", "", None, "none", None),
    ]
    df = spark.createDataFrame(rows, "id int, subject string, p1 string, p2 string, p3 string, p4 string, p5 string")
    probes = [("p1", "name", F.col("p1")), ("p2", "name", F.col("p2")), ("p3", "name", F.col("p3")), ("p4", "stem", F.col("p4")), ("p5", "stem", F.col("p5"))]
    got = {r.id: (r.path and tail(r.path), r.matched_by) for r in lk.match_file(df, index, "id", F.col("subject"), probes).collect()}
    assert got == {1: ("FR/A - B.pdf", "p1:subject"), 2: ("EN/a-b.pdf", "p1"), 3: ("EN/文献.pdf", "p3"), 4: ("FR/ab.pdf", "p2"), 5: ("FR/ab.pdf", "p4"), 6: ("FR/论文.pdf", "p5"), 7: (None, None)}


def test_metrics_in_any_case(spark):
    df = spark.createDataFrame([("Strong", "strong", "FAIR", ["strong"]), ("FAIR", "Fair", "x", [])], "truth string, p string, q string, v array<string>").withColumn("k", F.lit(1))
    assert tuple(mt.accuracy_top(df, ["k"], "truth", "p", "q").first())[1:] == (1.0, 1.0)
    assert {r.label: (r.recall, r.support) for r in mt.label_prf(df, ["k"], "truth", "p").collect() if r.support} == {"strong": (1.0, 1.0), "fair": (1.0, 1.0)}
    assert {r.label: (r.recall, r.support) for r in mt.label_prf_soft(df, ["k"], "truth", "v").collect() if r.support} == {"strong": (1.0, 1.0), "fair": (0.0, 1.0)}


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (None, "c", "z")], "id int, v string, w string")
    new = spark.createDataFrame([(2, "n1", None, 1), (2, None, "n2", 2), (3, "d", None, 1)], "id int, v string, w string, at int")
    replaced = {(r.id, r.v, r.w) for r in io.upsert(old, new, "id", "at").drop("at").collect()}
    assert replaced == {(1, "a", "x"), (None, "c", "z"), (2, None, "n2"), (3, "d", None)}
    patched = {(r.id, r.v, r.w) for r in io.upsert(old, new, "id", "at", "patch").drop("at").collect()}
    assert patched == {(1, "a", "x"), (None, "c", "z"), (2, "b", "n2"), (3, "d", None)}
    unordered = spark.range(6, numPartitions=1).selectExpr("id % 2 as id", "string(id) as v", "'w' as w")
    assert {(r.id, r.v) for r in io.upsert(old.limit(0), unordered, "id").collect()} == {(0, "4"), (1, "5")}  # the last that is read
    once = io.upsert(old, new.drop("at").where("v is not null"), "id")
    assert sorted(map(str, io.upsert(once, new.drop("at").where("v is not null"), "id").collect())) == sorted(map(str, once.collect()))


def test_pages_and_capped_samples(spark, monkeypatch):
    df = spark.range(500).withColumn("g", F.col("id") % 7)
    shallow = [r.id for r in fl.paginate(df, 4, 50, "g", "id").collect()]
    monkeypatch.setattr(fl, "SHALLOW", 0)
    assert [r.id for r in fl.paginate(df, 4, 50, "g", "id").collect()] == shallow and len(shallow) == 50
    sizes = [sm.cap_sample(df, n, 3, "id").count() for n in (0, 1, 77, 500, 900)]
    assert sizes == [0, 1, 77, 500, 500]
    assert {r.id for r in sm.cap_sample(df, 77, 3, "id").collect()} == {r.id for r in df.orderBy(sm.draw(3, "id"), "id").limit(77).collect()}


def test_jobs_of_model_answers(spark):
    """Failed calls, answers that cannot be read and rows without text keep their entries; empty words become null."""

    def model(messages, sample):
        if "down" in messages[-1]["content"]:
            raise RuntimeError("down")
        return {"ok": '{"a": "x", "b": "None", "type": "review"}', "odd": "nothing", "blank": '{"a": " ", "type": " "}'}[messages[-1]["content"]]

    df = spark.createDataFrame([(1, " ok ", {"a": "old", "c": "kept"}), (2, "odd", {"a": "old"}), (3, " ", None), (4, None, None), (5, "down", {"a": "old"}), (6, "blank", None)], "id long, text string, entries map<string,string>")
    got = {r.id: (r.entries, r.status) for r in sc.generate_entries_job(df, model, "id", "text", ["a", "b"], "p", retries=0).collect()}
    bad = "entries_failed"
    assert got == {1: ({"a": "x", "b": None, "c": "kept"}, "entries_parsed"), 2: ({"a": "old"}, bad), 3: (None, bad), 4: (None, bad), 5: ({"a": "old"}, bad), 6: ({"a": None, "b": None}, "entries_parsed")}
    kinds = {r.id: r.type for r in sc.classify_type_job(df.drop("entries"), model, "id", [("t", "text")], "p", retries=0).collect()}
    assert kinds == {1: "review", 2: "failed", 3: "failed", 4: "failed", 5: "failed", 6: "failed"}
    with pytest.raises(ValueError, match="registered"):
        sc.register("usable_articles")(lambda d: d)


def test_replace_scope_guards(spark):
    df = spark.createDataFrame([(1, "A"), (2, "B")], "id int, s string")
    with pytest.raises(ValueError, match="2 values"):
        io.replace_scope(df, df, F.col("s") == "A", "s")


def test_number_rows_is_whole_and_ordered(spark):
    df = spark.range(1000).withColumn("k", (F.col("id") * 7919) % 1000)
    got = {r.k: r.row_no for r in rs.number_rows(df, "k").collect()}
    assert got == {k: k + 1 for k in range(1000)}


def test_venue_quota_against_python(spark):
    def quota(counts, target):
        n = sum(counts.values())
        w = {v: (c / n) ** 0.9 for v, c in counts.items()}
        raw = {v: target * x / sum(w.values()) for v, x in w.items()}
        q = {v: min(max(round(raw[v]), 0), counts[v]) for v in counts}
        if (short := target - sum(q.values())) > 0:
            for v in [v for v in sorted(counts, key=lambda v: (-raw[v], v)) if q[v] < counts[v]][:short]:
                q[v] += 1
        elif sum(q.values()) > target + 3:
            for v in [v for v in sorted(counts, key=lambda v: (raw[v] - q[v], v)) if q[v] > 0][: sum(q.values()) - target]:
                q[v] -= 1
        return q

    rng = random.Random(1)
    for target in (5, 40, 200, 5000):
        counts = {f"v{k}": rng.randrange(1, 60) for k in range(15)}
        got = {r.journal: r.quota for r in qt.venue_quota(spark.createDataFrame(list(counts.items()), "journal string, n long"), target).collect()}
        assert got == quota(counts, target)


def test_year_quota_decay_against_python(spark):
    def quota(years, target, cur):
        first = min(years.get(cur, 0), target)
        others = sorted((y for y in years if y != cur), reverse=True)
        part = lambda d: [min(int(first * d ** (i + 1)), years[y]) for i, y in enumerate(others)]
        d = 1.0
        if first + sum(part(1.0)) > target:
            lo, hi = 0.5, 1.0
            for _ in range(50):
                d = (lo + hi) / 2
                e = first + sum(part(d)) - target
                if abs(e) <= 1:
                    break
                lo, hi = (d, hi) if e < 0 else (lo, d)
        return {**dict(zip(others, part(d), strict=True)), **({cur: first} if first else {})}

    for years, target in (({2025: 10, 2024: 8, 2023: 30, 2020: 9}, 25), ({2025: 10, 2024: 1}, 50), ({2024: 5, 2023: 2}, 5), ({2025: 90, 2024: 90}, 40)):
        df = spark.createDataFrame([("j", y, n) for y, n in years.items()], "journal string, year int, n long")
        assert {r.year: r.quota for r in qt.year_quota_decay(df, target, 2025).collect()} == quota(years, target, 2025)


def test_size_factor(spark):
    df = spark.createDataFrame([(k,) for k in (5, 50, 200, 745)], "n long")
    assert abs(qt.size_factor(df, 100, 5).first().total - 100) <= 5


def test_fuzzy_candidates_against_python(spark):
    """All pairs of titles of any script by token F1, repeated and empty titles included."""
    import re

    rng = random.Random(4)
    words = ["über", "el", "niño", "the", "of", "and", "straße", "日本", "año", "x1", "a_b", "été", "zum", "der"]
    titles = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 9))) + rng.choice(["", "!", " – ", "?"])) for k in range(120)] + [(200, None), (201, ""), (202, "...")]
    sets = {k: set(re.sub(r"[^\w\s]", " ", (t or "").lower()).split()) for k, t in titles}
    df = spark.createDataFrame(titles, "id long, title string")
    for threshold in (0.5, 0.8, 1.0):
        want = {(a, b): 2 * len(x & y) / (len(x) + len(y)) for a, x in sets.items() for b, y in sets.items() if x and y and 2 * len(x & y) / (len(x) + len(y)) >= threshold - 1e-12}
        got = {(r.l, r.r): r.f1 for r in lk.fuzzy_candidates(df, df, "id", "id", "title", "title", threshold).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_copies_of_titles_travel_as_chunks(spark, monkeypatch):
    """Two linked classes of many copies are four links, however many pairs; both sides of a cross join, null ids included."""
    monkeypatch.setattr(lk, "CHUNK", 3)
    monkeypatch.setattr(lk, "PAIRS", 50)
    left = spark.createDataFrame([(k, "alpha beta gamma") for k in range(20)] + [(k, "Gamma, beta alpha delta!") for k in range(20, 37)] + [(None, "other")], "id long, title string")
    classes = lk.title_classes(left, left, "id", "id", "title", "title", 0.5)
    assert classes.links.count() == 5 and classes.members.groupBy("node", "side", "chunk").count().count() > 20
    got = [(r.l, r.r, round(r.f1, 6)) for r in lk.title_pairs(classes).collect()]
    want = [(a, b, 1.0 if (a < 20) == (b < 20) else 0.857143) for a in range(37) for b in range(37)]
    assert sorted(got, key=str) == sorted([*want, (None, None, 1.0)], key=str)
    right = spark.createDataFrame([("x", "alpha beta"), ("y", "delta"), (None, "alpha beta gamma")], "name string, heading string")
    got = {(r.l, r.r, round(r.f1, 6)) for r in lk.fuzzy_candidates(left, right, "id", "name", "title", "heading", 0.8).collect()}
    assert got == {(k, "x", 0.8) for k in range(20)} | {(k, None, 1.0 if k < 20 else 0.857143) for k in range(37)}


def test_only_pairs_that_hold_are_written(spark, monkeypatch):
    """Long titles that share little, near copies and sets of one token, in many blocks; scratch holds no candidate below the threshold, and no pair twice."""
    from corpuseval.sources import shared

    for name, value in (("BLOCK_TOKENS", 900), ("BLOCK_ROWS", 9), ("MEETINGS", 50)):
        monkeypatch.setattr(f"corpuseval.operators.setjoin.{name}", value, raising=False)
    rng = random.Random(9)
    sets = [rng.sample(range(1200), 300) for _ in range(8)] + [rng.sample(range(60), rng.randrange(10, 30)) for _ in range(25)] + [[k] for k in range(20)] + [[0, 1], [0, 2]]
    sets += [s[: len(s) - k] + [2000 + k] for s in sets[6:12] for k in (1, 3, 9)]
    df = spark.createDataFrame([(k, " ".join(f"w{x}" for x in s)) for k, s in enumerate(sets)], "id long, title string")
    want = {(a, b): 2 * len({*x} & {*y}) / (len(x) + len(y)) for a, x in enumerate(sets) for b, y in enumerate(sets)}
    before = len(shared._named)
    got = lk.fuzzy_candidates(df, df, "id", "id", "title", "title", 0.5).collect()
    assert len(got) == len({(r.l, r.r) for r in got}) and {(r.l, r.r): r.f1 for r in got} == {p: f for p, f in want.items() if f >= 0.5}
    near = spark.read.parquet(next(p for p in shared._named[before:] if p.rpartition("/")[2].startswith("near-")))
    assert near.count() == sum(a < b and f >= 0.5 for (a, b), f in want.items())


def in_turn(pairs, thresholds, cap=None):
    held, used = {}, set()
    for t in thresholds:
        if cap is not None and len(held) >= cap:
            break
        for left in sorted({a for a, _ in pairs}):
            best = [(-f, b) for (a, b), f in pairs.items() if a == left and f >= t and b not in used]
            if left not in held and best:
                held[left] = min(best)[1]
                used.add(held[left])
    return set(held.items())


def test_one_to_one_matching_equals_the_sequential_choice(spark):
    """Components as they stand, and all of them by proposals; with a cap between thresholds."""
    rng = random.Random(2)
    for component, cap in ((lk.COMPONENT, None), (4, 3)):
        pairs = {(left, right): rng.choice([0.5, 0.6, 0.7, 0.8, 0.9]) for left in range(14) for right in range(14) if rng.random() < 0.2}
        df = spark.createDataFrame([(a, b, f) for (a, b), f in pairs.items()], "l int, r int, f1 double")
        got = lk.assign_one_to_one(df, [0.8, 0.5], cap, component)
        assert {(r.l, r.r) for r in got.collect()} == in_turn(pairs, [0.8, 0.5], cap)
    assert lk.assign_one_to_one(df.limit(0), [0.8, 0.5], 3).count() == 0


def test_titles_are_assigned_by_classes_as_by_pairs(spark, monkeypatch):
    """Copies, near copies and single titles, with and without ``distinct``; ids that no double holds; the chain of a class of copies is one round."""
    rng, far = random.Random(7), 2**53
    words = [f"w{k}" for k in range(12)]
    base = [rng.sample(words, rng.randrange(3, 6)) for _ in range(9)]
    titles = [(far + k, " ".join([*rng.choice(base), *rng.sample(["x", "y"], rng.randrange(0, 2))])) for k in range(60)]
    sets = {k: set(t.split()) for k, t in titles}
    pairs = {(a, b): 2 * len(x & y) / (len(x) + len(y)) for a, x in sets.items() for b, y in sets.items()}
    pairs = {p: f for p, f in pairs.items() if f >= 0.5}
    df = spark.createDataFrame(titles, "id long, title string")
    classes = lk.title_classes(df, df, "id", "id", "title", "title", 0.5)
    for distinct, cap, component in ((True, 20, lk.CLASS_COMPONENT), (True, None, lk.CLASS_COMPONENT), (False, None, lk.CLASS_COMPONENT), (True, None, 5)):
        got = lk.assign_titles(classes, [0.8, 0.5], cap, distinct, component)
        assert {(r.l, r.r) for r in got.collect()} == in_turn({p: f for p, f in pairs.items() if not distinct or p[0] != p[1]}, [0.8, 0.5], cap)
    monkeypatch.setattr(lk, "_by_proposals", None)
    many = spark.createDataFrame([(k, "one and the same") for k in range(3001)], "id long, title string")
    got = {r.l: r.r for r in lk.assign_titles(lk.title_classes(many, many, "id", "id", "title", "title", 0.5), [0.8], distinct=True).collect()}
    assert got == {k: k ^ 1 for k in range(3000)}


def test_large_components_of_classes_are_settled_in_steps(spark, monkeypatch):
    """Near copies that are all linked, in steps of three titles, without pairs."""
    monkeypatch.setattr(lk, "_by_proposals", None)
    rng = random.Random(3)
    words = [f"w{k}" for k in range(9)]
    titles = [(k, " ".join(["same", *rng.sample(words, rng.randrange(4, 8))])) for k in range(12)] + [(k, "same w0 w1 w2 w3") for k in range(12, 17)]
    sets = {k: set(t.split()) for k, t in titles}
    pairs = {(a, b): 2 * len(x & y) / (len(x) + len(y)) for a, x in sets.items() for b, y in sets.items() if a != b}
    df = spark.createDataFrame(titles, "id long, title string")
    got = lk.assign_titles(lk.title_classes(df, df, "id", "id", "title", "title", 0.5), [0.6], None, True, 9)
    assert {(r.l, r.r) for r in got.collect()} == in_turn({p: f for p, f in pairs.items() if f >= 0.5}, [0.6])


def test_a_chain_of_references_takes_few_jobs(spark, monkeypatch):
    """Each reference prefers what the one before it takes, so that a round of proposals would settle one of them."""
    from corpuseval.operators import graph

    n, written = 2000, []
    for module in (graph, lk):
        monkeypatch.setattr(module, "stored", lambda df, name="table", real=module.stored: (written.append(name), real(df, name))[1])
    rows = [(f"l{k:05}", f"r{k + d:05}", 0.9 - 0.1 * d) for k in range(n) for d in (-1, 0, 1) if k + d >= 0]
    got = {(r.l, r.r) for r in lk.assign_one_to_one(spark.createDataFrame(rows, "l string, r string, f1 double"), [0.5]).collect()}
    wishes, taken, want = {}, set(), set()
    for left, right, f in rows:
        wishes.setdefault(left, []).append((-f, right))
    for left in sorted(wishes):
        right = min(w for w in wishes[left] if w[1] not in taken)[1]
        want.add((left, right))
        taken.add(right)
    assert got == want and len(got) == n
    assert len(written) < 70


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(500).withColumn("g", F.col("id") % 3)
    a = sm.balance_random(df, ["g"], 20, 5, "id")
    b = sm.balance_random(df.repartition(7), ["g"], 20, 5, "id")
    assert {r.id for r in a.collect()} == {r.id for r in b.collect()} and a.count() == 60
    with pytest.raises(Exception, match="fewer rows"):
        sm.top_up_split(df.withColumn("split", F.lit("train")), ["g"], 400, 1, "id").collect()
    with pytest.raises(ValueError, match="fraction"):
        sm.mark_fraction(df, F.lit(True), 0, "g", "1", 1, "id")


def test_pairs_are_of_the_right_tiers(spark):
    items = spark.createDataFrame([(k, lb.TIERS[k % 4]) for k in range(40)] + [(99, "others")], "id int, tier string")
    got = pr.sample_pairs(items, 7, 1, "id", "tier").collect()
    assert len(got) == 42 and len({r.pair_type for r in got}) == 6
    assert all(f"{lb.TIERS[r.key_a % 4]}_{lb.TIERS[r.key_b % 4]}" == r.pair_type and r.key_a % 4 > r.key_b % 4 for r in got)


def test_pair_metrics_drop_types_without_a_judged_pair(spark):
    df = spark.createDataFrame([("a", True, False), ("a", False, False), ("b", True, False), ("c", False, True)], "t string, ok boolean, fail boolean")
    got = {r.t: (r.n, r.failed, r.accuracy, r.weighted_accuracy) for r in mt.pair_metrics(df, "t", "ok", "fail").collect()}
    assert got == {"a": (2, 0, 0.5, None), "b": (1, 0, 1.0, None), "overall": (3, 1, 2 / 3, 0.75)}


def test_paragraphs(spark):
    page = "INTRODUCTION TO THE WHOLE FIELD\nThis is a hyphen-\nated line that goes\non here.\n\nNew paragraph, which\nends. \nNext Sentence stands alone.\na b\nx\ny\nz\nw\n12"
    df = spark.createDataFrame([(1, page)], "id int, text string")
    got = [r.paragraph for r in ln.restore_paragraphs(ln.line_class(ln.explode_lines(df, "id", "text"), "id"), "id").orderBy("paragraph_no").collect()]
    assert got[0] == "INTRODUCTION TO THE WHOLE FIELD" and "hyphenated line that goes on here." in got[1] and got[-1] == "[Journal Page: 12]"


def test_scoring_keeps_errors_with_their_rows(spark):
    def model(messages, sample):
        if "bad" in messages[-1]["content"]:
            raise RuntimeError("refused")
        return messages[-1]["content"].upper()

    message = lambda t: [("user", t)]
    df = spark.createDataFrame([(1, message("good")), (2, message("bad"))], "id int, messages array<struct<role:string,content:string>>")
    got = {r.id: (r.response_text, r.attempts, r.error) for r in sc.score(df, model, ["id"], retries=1, wait=0).collect()}
    assert got == {1: ("GOOD", 1, None), 2: (None, 2, "RuntimeError: refused")}


def test_streams_take_new_files_once(spark):
    base = scratch(spark, "stream")
    rows = lambda *xs: spark.createDataFrame([(x, x % 3) for x in xs], "id long, k long")
    for part in ((1, 2, 3), (4, 5)):
        io.write_jsonl(rows(*part), f"{base}/in", "append")
        jobs.ingest_stream(spark, f"{base}/in", "id long, k long", f"{base}/out", f"{base}/check")
        jobs.upsert_stream(spark.readStream.schema("id long, k long").json(f"{base}/in"), f"{base}/table", "k", f"{base}/check2", "id")
    assert sorted(r.id for r in spark.read.parquet(f"{base}/out").collect()) == [1, 2, 3, 4, 5]
    assert {r.k: r.id for r in jobs.latest(spark, f"{base}/table", "id long, k long").collect()} == {0: 3, 1: 4, 2: 5}
    log = spark.read.json(f"{base}/table/log")
    assert {r.batch for r in log.collect()} == {0, 1} and {r.slot for r in log.where("batch = 1").collect()} == {1}


def test_scratch_tables_can_be_cleared(spark):
    path = scratch(spark, "gone")
    spark.range(3).write.parquet(path)
    shared.clear(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_entry_works_without_the_training_data_subpackage(tmp_path):
    import shutil

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "corpuseval", tmp_path / "corpuseval", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'e18_leaderboard' in q and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
