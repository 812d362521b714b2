"""The pipeline's stages against plain Python versions, each on its own input."""

import brute
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from corpuseval.llm import quality
    from corpuseval.llm._session import stored

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = list(corpus_pipeline.COLUMNS)
    done = [stored(docs.select(*columns), "docs")]
    for _, stage in corpus_pipeline.STAGES:
        done.append(stored(stage(spark, done[-1], SF), "stage"))
    assert all(d.columns == columns for d in done[:-1])
    kept = {r.doc_id for r in quality.score(docs, quality.train_on_tables(spark, SF)).where("predicted = 1").collect()}
    rows = [{r.doc_id: r.text for r in d.collect()} for d in done[:-1]]
    assert set(rows[1]) == kept and all(rows[1][i] == rows[0][i] for i in kept)
    assert set(rows[2]) == set(brute.similar(list(rows[1].items())).values())
    repeats = brute.repeats(list(rows[2].items()))
    assert rows[3] == {i: (t if not repeats[i][1] else repeats[i][2]) for i, t in rows[2].items()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hit = brute.contamination(list(rows[3].items()), items)
    assert set(rows[4]) == set(rows[3]) and all((rows[4][i] == rows[3][i]) == (hit[i][1] == 0) for i in rows[3])
    assert not any(h for _, h, _ in brute.contamination([(i, t) for i, t in rows[4].items() if hit[i][1] and hit[i][1] == hit[i][0]], items).values())
    last = {r.doc_id: r for r in done[-1].collect()}
    assert all(last[i].decoded_sha256 == brute.sha256(t or "") for i, t in rows[4].items())


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, "a b", "en", "s", 3), (1, "", None, "s", 0), (1, "", None, "s", 0), (2, "one two three four", "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit(1))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        stage(spark, docs, SF).collect()


def test_near_duplicates_by_row(spark):
    """Repeated ids: a copy goes whatever its id, rows equal in all columns count once, other rows of one id and text stay."""
    text, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"u{i}" for i in range(40))
    rows = [(1, text, "en", "a"), (3, text + " more", "en", "a"), (3, other, "en", "a"), (5, "same", "en", "x"), (5, "same", "fr", "y"), (5, "same", "fr", "y"), (7, "SAME", "en", "x"), (None, text, "en", "a"), (None, text, "en", "a")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id or 0, r.text, r.lang) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect())
    assert got == sorted([(0, text, "en"), (0, text, "en"), (1, text, "en"), (3, other, "en"), (5, "same", "en"), (5, "same", "fr")])


def test_run_hands_the_session_back(spark, monkeypatch):
    from corpuseval.llm._session import BATCH, configure

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", lambda s, docs, d: (configure(s), docs.limit(1))[1])])
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, "7777")
    try:
        assert corpus_pipeline.run(spark, SF).count() == 1 and spark.conf.get(BATCH) == "7777"
    finally:
        spark.conf.set(BATCH, before)
