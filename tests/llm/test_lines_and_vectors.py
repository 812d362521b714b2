"""Line dedup, whitening and hard negatives against plain versions, with nulls, empty tables, ties, repeated rows and clashing columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuseval.llm import hard_negatives, line_dedup, whitening

SPACE, UPPER = " \t\n\v\f\r", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(SPACE).translate(UPPER)


def dropped_lines(docs, min_chars=40, min_docs=5):
    """(id, lines, dropped, kept) of each (id, text)."""
    holders = {}
    for i, text in docs:
        for line in (text or "").split("\n") if i is not None else ():
            holders.setdefault(key(line), set()).add(i)
    gone = lambda i, line: i is not None and len(key(line)) >= min_chars and len(holders[key(line)]) >= min_docs and i != max(holders[key(line)])
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not gone(i, x)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def line_docs(seed, n=300):
    rng = random.Random(seed)
    pool = [f"{'Line'} {k} " + "abcdé日 "[k % 7] * rng.randrange(25, 60) for k in range(40)] + ["short", "", " ", "x" * 39, "y" * 40, "ÀÉ" * 20]
    dress = lambda x: rng.choice(["", " ", "\t\v", "\r"]) + (x.upper() if rng.random() < 0.2 and x.isascii() else x) + rng.choice(["", "\r", "  \f", " "])
    docs = [(rng.randrange(10_000), "\n".join(dress(rng.choice(pool)) for _ in range(rng.randrange(0, 14)))) for _ in range(n)]
    docs += [(k, pool[0] + "\n" + pool[0]) for k in range(20_000, 20_150)]  # a line of a third of all documents
    docs += [(50, None), (51, ""), (52, "\n\n"), (None, pool[0]), (None, None), docs[0], docs[0], (docs[1][0], pool[3]), (53, "\n".join(pool * 60))]
    return docs


@pytest.mark.parametrize("batches", [1, 4, 9])
def test_lines(spark, batches):
    docs = line_docs(batches)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"kept": F.lit("old"), "n_lines": F.lit("old"), "h": F.lit(1), "drop": F.lit(2)})
    got = line_dedup.drop_repeated_lines(df, batches=batches)
    assert {c for c in got.columns} == {"doc_id", "text", "kept", "n_lines", "n_dropped", "h", "drop"}
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got.collect()), key=str) == dropped_lines(docs)


def test_lines_of_other_ids_and_of_no_rows(spark):
    docs = [(f"d{k % 9}", f"{'z' * 45}\nown {k}") for k in range(30)]
    df = spark.createDataFrame(docs, "doc_id string, text string")
    got = line_dedup.drop_repeated_lines(df, min_docs=3, batches=3)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got.collect()), key=str) == dropped_lines(docs, min_docs=3)
    assert line_dedup.drop_repeated_lines(df.limit(0)).count() == 0
    assert spark.catalog.listTables() == [] or not any(t.name.startswith("line_run") for t in spark.catalog.listTables())


def test_runs_take_batches_in_any_order_and_stay_few(spark):
    """Counts and largest ids of all keys, settled ones no larger than they are, after each of 14 batches."""
    rng = random.Random(3)
    index, seen = line_dedup.LineRuns(spark, min_docs=3, fan=3), {}
    for batch in rng.sample(range(14), 14):
        rows = [(100 * batch + rng.randrange(100), h, h + 1) for h in [rng.randrange(30) for _ in range(60)] + [7] * 20]
        index.add(spark.createDataFrame(rows, "id long, h long, g long"))
        for i, h, _ in rows:
            seen.setdefault(h, set()).add(i)
        assert len(index.runs) <= 2 * len(index.levels)
    assert len(index.levels) >= 3
    assert {r.h: r["last"] for r in index.frequent().collect()} == {h: max(ids) for h, ids in seen.items() if len(ids) >= 3}
    index.forget()


def test_a_new_batch_is_joined_with_the_runs_where_they_lie(spark):
    """The runs are bucketed: they are merge-joined without being shuffled."""
    index = line_dedup.LineRuns(spark, min_docs=1)
    index.add(spark.range(1000).selectExpr("id", "id as h", "id as g"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        name, _ = index.runs[0]
        new = spark.range(2000).selectExpr("id", "id as h", "id as g").groupBy("h", "g").agg(F.max("id").alias("last"))
        plan = new.join(spark.table(name).toDF("_h", "_g", "_docs", "_last"), (F.col("h") == F.col("_h")) & (F.col("g") == F.col("_g")), "left_anti")
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange") == 1 and "SortMergeJoin" in text and "Bucketed: true" in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        index.forget()


def test_eigenvectors_by_spectral_division():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 40, 90):
        turn = np.linalg.qr(rng.standard_normal((n, n)))[0]
        for values in (rng.uniform(0, 1, n), 10.0 ** rng.uniform(-9, 0, n), np.repeat(rng.uniform(0, 1, -(-n // 3)), 3)[:n], np.zeros(n), np.ones(n)):
            a = (turn * values) @ turn.T
            a = (a + a.T) / 2
            found, vectors = whitening.eigen(a, 16)
            want = np.linalg.eigvalsh(a)[::-1]
            k, size = min(16, n), max(np.abs(want).max(), 1e-300)
            assert len(found) >= k and np.abs(found[:k] - want[:k]).max() <= 1e-13 * size
            assert np.abs(vectors.T @ vectors - np.eye(vectors.shape[1])).max() < 1e-13
            assert np.abs(a @ vectors[:, :k] - vectors[:, :k] * found[:k]).max() <= 1e-13 * size
    u = whitening.polar(np.diag([3.0, 1e-9, -2.0, -1e-9]))
    assert np.allclose(u, np.diag([1, 1, -1, -1]), atol=1e-6)


def vectors(seed, n, d=6):
    rng = np.random.default_rng(seed)
    rows = [(int(k), rng.normal(size=d).tolist(), int(rng.integers(3))) for k in range(n)]
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [1.0, None] + [0.0] * (d - 2), 1), (n + 3, [float("nan")] * d, 1), (n + 4, [float("inf")] * d, 1), (n + 5, [1.0] * (d - 1), 1), (None, rows[0][1], 1), (3, rows[3][1], rows[3][2]), (n + 6, rows[4][1], None)]
    return rows


KIND = "vec_id long, embedding array<double>, label int"


def test_whitening(spark):
    rows = vectors(2, 120)
    df = spark.createDataFrame(rows, KIND).withColumns({"whitened": F.lit("old"), "x": F.lit(0), "z": F.lit(1)})
    got = whitening.whiten(df, 4).collect()
    fit = [(i, v) for i, v, _ in rows if v is not None and len(v) == 6 and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in fit], dtype=np.int64)
    once = np.unique(x, axis=0)
    n, sums = len(once), once.sum(axis=0)
    c = (n * once - sums) / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1][:4], axes[:, ::-1][:, :4]
    z, deviation = (x - sums / n) @ axes / np.sqrt(values), ((n * x - sums) ** 2).sum(axis=1)
    assert len(got) == 4 * len(fit) and all(r.n == n and r.identity_error < 1e-9 and r.z == 1 for r in got)
    by_row = sorted((str(i), int(d), tuple(np.round(np.abs(w), 9))) for (i, _), d, w in zip(fit, deviation, z, strict=True))
    mine = {}
    for r in got:
        mine.setdefault((str(r.vec_id), r.deviation), {}).setdefault(r.component, []).append(r.whitened)
    assert sorted((i, d, tuple(np.round([abs(w[k][j]) for k in (1, 2, 3, 4)], 9))) for (i, d), w in mine.items() for j in range(len(w[1]))) == by_row
    signs = np.sign(np.array([[w[k][0] for k in (1, 2, 3, 4)] for w in [mine["5", int(deviation[5])], mine["6", int(deviation[6])]]]) * z[5:7])
    assert (signs[0] == signs[1]).all()
    trace = float(np.trace(c.T @ c / n))
    assert all(abs(r.explained - values[r.component - 1] / trace) < 1e-12 for r in got)


def test_whitening_without_variance(spark):
    df = spark.createDataFrame([(k, [1.0, 2.0], 0) for k in range(5)], KIND)
    assert whitening.whiten(df).count() == 0 and whitening.whiten(df.limit(1)).count() == 0 and whitening.whiten(df.limit(0)).count() == 0
    flat = spark.createDataFrame([(k, [float(k), 2.0, 1e300], 0) for k in range(9)], KIND)
    assert {r.component for r in whitening.whiten(flat).collect()} == {1}  # one direction; huge values are held
    with pytest.raises(ValueError, match="at most"):
        whitening.whiten(spark.createDataFrame([(1, [0.0] * (whitening.MAX_LENGTH + 1), 0)], KIND))


def test_exact_deviations():
    model = whitening.Whitening(3, (3 << 40, 0), np.zeros((2, 0)), np.zeros(0), 1.0)
    big = model.moved(np.array([[1 << 40, 5], [-(1 << 40), 7]], dtype=np.int64))
    assert whitening.deviations(big) == [225, None]
    far = whitening.Whitening(1 << 40, (0, 0), np.zeros((2, 0)), np.zeros(0), 1.0)
    assert far.moved(np.array([[1 << 30, 1]], dtype=np.int64)).tolist() == [[1 << 70, 1 << 40]]


def mined(rows, positives=5, negatives=10):
    d = 6
    fit = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and len(v) == d and all(c is not None and np.isfinite(c) for c in v):
            x = [int(np.floor(256 * c)) for c in v]
            fit[i] = min(fit.get(i, (label, x)), (label, x))
    out = set()
    for a in (i for i in fit if i % 10 == 0):
        score = {i: sum(p * q for p, q in zip(fit[a][1], x, strict=True)) for i, (_, x) in fit.items() if i != a}
        best = sorted((-s, i) for i, s in score.items() if fit[i][0] == fit[a][0])[:positives]
        for s, p in best:
            hits = sorted((-t, i) for i, t in score.items() if fit[i][0] != fit[a][0] and 30 * -s <= 100 * t <= 90 * -s)[:negatives]
            out |= {(a, p, k + 1, i, -s, -t) for k, (t, i) in enumerate(hits)}
    return out


@pytest.mark.parametrize("block", [1024, 4])
def test_hard_negatives(spark, block):
    rows = vectors(4, 260)
    rows += [(300 + k, rows[0][1], k % 3) for k in range(30)] + [(400 + 10 * k, [0.0] * 6, 1) for k in range(3)] + [(7, [9.0] * 6, 2), (500, [0.01] * 6, 9)]
    df = spark.createDataFrame(rows, KIND).withColumns({"x": F.lit("clash"), "score": F.lit(1), "block": F.lit(2)})
    got = hard_negatives.hard_negatives(df.repartition(5), F.col("id") % 10 == 0, block=block)
    assert {tuple(r) for r in got.collect()} == mined(rows) and got.count() == len(mined(rows))
    assert hard_negatives.hard_negatives(df.limit(0), F.col("id") % 10 == 0).count() == 0
    assert hard_negatives.hard_negatives(df, F.col("id") < 0).count() == 0
    with pytest.raises(TypeError, match="whole numbers"):
        hard_negatives.hard_negatives(df.withColumn("vec_id", F.lit("a")), F.lit(True))


def test_bounds_of_near_anchors_spare_scores():
    """Clusters far apart: rows of other clusters are bounded by the tree and not scored; the best are found all the same."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 16)) * 400
    group = rng.integers(6, size=3000)
    y = np.floor(centres[group] + rng.normal(size=(3000, 16)))
    points = np.floor(centres[np.arange(60) % 6] + rng.normal(size=(60, 16)))
    ids = np.arange(3000)
    block = hard_negatives.Block(np.arange(10_000, 10_060), [0] * 60, points, *hard_negatives.spanning_tree(points), [[(-1, -np.inf, np.inf)]] * 60, False, 10)
    best = [[hard_negatives.Best(w, 10) for w in windows] for windows in block.windows]
    taken = sum(hard_negatives.scan(block, best, ids[k : k + 500], np.full(500, -1), y[k : k + 500]) for k in range(0, 3000, 500))
    for a in range(60):
        scores = y @ points[a]
        want = sorted(zip(-scores, ids, strict=True))[:10]
        assert [(-s, i) for s, i in zip(best[a][0].scores, best[a][0].ids, strict=True)] == [(s, i) for s, i in want]
    assert taken < 0.6 * 60 * 3000
    order, parent, edge = hard_negatives.spanning_tree(points)
    assert sorted(order) == list(range(60)) and all(parent[k] in order[: list(order).index(k)] for k in order[1:]) and edge[order[1:]].min() > 0
