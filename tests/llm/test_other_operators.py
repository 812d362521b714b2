"""Models, embeddings, urls, archives and tokens."""

import random
import re
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuseval.llm import byte_bpe, embedding_dedup, language_id, quality, url_filter, warc
from corpuseval.llm._components import components
from corpuseval.llm._session import scratch


def test_components(spark):
    rng = random.Random(1)
    for n, m in ((300, 200), (300, 500), (200, 199)):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] if m != 199 else [(i, i + 1) for i in range(m)]
        got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
        want = brute.roots(range(n), links)
        linked = {x for a, b in links if a != b for x in (a, b)}
        assert got == {x: want[x] for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("per_pivot", "block"), [(4096, 4096), (20, 30)])
def test_embeddings(spark, monkeypatch, per_pivot, block):
    monkeypatch.setattr(embedding_dedup, "PER_PIVOT", per_pivot)
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 8))
    rows = [(k, [float(x) for x in np.float32(centres[rng.integers(20)] + rng.normal(size=8) * rng.choice([0, 0.05, 0.15]))], int(rng.integers(2))) for k in range(400)]
    rows += [(500, None, 1), (501, [0.0] * 8, 1), (502, [float("nan")] * 8, 1), (503, [None, 1.0], 0), (504, [], 1), (505, rows[0][1], None), (506, [1.0, 1.0], 0), (507, [2.0, 2.1], 0), (508, [float("inf")] * 8, 0)]
    want = brute.embeddings(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, node int")
    got = embedding_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows) and max(r.n_links for r in got) > 5
    assert all((r.n_links, r.component) == want[r.vec_id] and r.kept == (r.component == r.vec_id) for r in got)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
    odd = embedding_dedup.near_duplicates(spark.createDataFrame([(1, [1.0], 0), (1, [1.0], 0), (None, [1.0], 0)], "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r.vec_id or 0, r.n_links) for r in odd) == [(0, 0), (1, 1), (1, 1)]


def test_embeddings_of_many_cells(spark, monkeypatch):
    """Links planted at 64 dimensions, near the bound and across cells; pivots keep cells apart."""
    for name, value in (("PER_PIVOT", 60), ("BLOCK", 100), ("TILE", 30)):
        monkeypatch.setattr(embedding_dedup, name, value)
    rng = np.random.default_rng(7)
    rows = []
    for k in range(1500):
        v = rng.normal(size=64)
        if k % 3 and rows:  # a copy at an angle around the bound
            u = np.array(rows[rng.integers(max(0, len(rows) - 200), len(rows))][1])
            w = v - u * (v @ u) / (u @ u)
            angle = np.arccos(0.98) * rng.choice([0.3, 0.8, 0.99, 1.01, 1.5])
            v = u / np.linalg.norm(u) * np.cos(angle) + w / np.linalg.norm(w) * np.sin(angle)
        rows.append((k, [float(x) for x in v * rng.uniform(0.5, 2)], int(k % 700 == 0)))
    want = brute.embeddings(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = embedding_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows) and sum(r.n_links for r in got) > 500
    assert all((r.n_links, r.component) == want[r.vec_id] for r in got)


def test_visits_lose_no_link():
    """Of two vectors within the radius one visits the other's cell, and far cells are not visited."""
    rng = np.random.default_rng(3)
    for dim in (3, 64):
        x = rng.normal(size=(4000, dim))
        y = x + 0.03 * rng.normal(size=x.shape) * np.linalg.norm(x, axis=1, keepdims=True) / np.sqrt(dim / 8)
        x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
        radius, pivots = float(np.sqrt(2 - 2 * 0.98)), x[:20]
        far_x, far_y = (embedding_dedup.distances(v, pivots) for v in (x, y))
        reach = np.zeros(20)
        for f in (far_x, far_y):
            np.maximum.at(reach, f.argmin(axis=1), f.min(axis=1))
        between = embedding_dedup.distances(pivots, pivots)
        home_x, home_y = far_x.argmin(axis=1), far_y.argmin(axis=1)
        linked = ((x * y).sum(axis=1) >= 0.98) & (home_x != home_y)
        vx, vy = (embedding_dedup.visits(f, between, reach, radius) for f in (far_x, far_y))
        at = np.arange(len(x))
        assert linked.sum() > 100 and (vx[at, home_y] | vy[at, home_x])[linked].all()
        assert vx.sum() / len(x) < (1.5 if dim == 3 else 8)


def test_automaton_phrases():
    table = language_id.automaton([2, 3, 2, 2, 3], 5)
    sample, rng = "babba", random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("abc") for _ in range(20))
        state = phrases = 0
        for ch in text:
            move = int(table[state, {"b": 2, "a": 3, "c": 4}[ch]])
            phrases, state = phrases + (move & 3), move >> 2
        want, at = 0, 0
        while at < len(text):  # longest matches, one after another
            size = 1
            while at + size < len(text) and text[at : at + size + 1] in sample:
                size += 1
            want += 1
            at += size
        assert phrases + (state > 0) == want


@pytest.mark.parametrize("cells", [1 << 25, 0])
def test_phrases_of_whole_texts(monkeypatch, cells):
    """Longest matches of texts of many runs, also where text and sample repeat themselves and parses never meet."""
    monkeypatch.setattr(language_id, "DENSE_CELLS", cells)
    rng = random.Random(8)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(2, 7)))
    samples = {"aa": " ".join(word("abcde") for _ in range(300)), "bb": " ".join(word("cdefg") for _ in range(300)), "cc": "ab" * 700, "dd": "abc" * 500}
    model = language_id.Model({k: [v] for k, v in samples.items()})
    texts = [" ".join(word("abcdefgz") for _ in range(n)) for n in (1, 40, 300, 900)] + ["ab" * 1000, "b" + "ab" * 777, samples["aa"][100:1400], "x" * 600, "abc" * 400 + "q" + "ab" * 300, "a" * 256, "a" * 257, "a"]
    parts = [model.squeeze(model.symbols[language_id._codes(t.encode())]) for t in texts]
    got = model.phrases(np.concatenate(parts), np.array([len(p) for p in parts]))
    for k, text in enumerate(texts):
        for j, sample in enumerate(samples.values()):
            want, at = 0, 0
            while at < len(text):
                size = 1
                while at + size < len(text) and text[at : at + size + 1] in sample:
                    size += 1
                want, at = want + 1, at + size
            assert got[k][j] == want, (k, j)


def test_language(spark):
    words = {"xx": ["kalo", "mira", "tenu", "soli"], "yy": ["brug", "stad", "wolk", "zeep"]}
    rng = random.Random(1)
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(k, text(lang, 30), lang) for k in range(40) for lang in words]
    train = spark.createDataFrame([*rows, (900, None, "xx"), (901, "zzz", None), (902, "", "zz")], "doc_id long, text string, lang string")
    model = language_id.train(train)
    tests = [(1, text("xx", 20), "yy"), (2, text("yy", 5000), None), (3, None, "xx"), (4, "", "xx"), (5, "12 !? 34", "xx"), (6, "MIRA Tenu", "yy"), (7, "\U0001F600 日本", None)]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(tests, train.schema), model).collect()}
    assert [got[k].lang_pred for k in range(1, 7)] == ["xx", "yy", "und", "und", "und", "xx"]
    assert [got[k].score for k in (3, 4, 5)] == [0, 0, 0] and got[1].score > 0.9 and got[2].score > 0.9
    assert got[7].lang_pred == "xx" and got[7].score == 0.5  # letters that no sample holds: a tie, and the first language
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language_id.identify(train, language_id.train(train.limit(0))).collect()} == {"und"}


def test_language_letters_of_all_scripts(monkeypatch):
    rng = random.Random(4)
    scripts = {"ja": "あいうえおかきくけこ", "ko": "가나다라마바사아자차", "zh": [chr(0x4E00 + 3 * k) + chr(0x4E01 + 3 * k) + chr(0x4E02 + 3 * k) for k in range(200)], "en": "abcdefghij"}
    text = lambda lang, n: "".join(rng.choice(scripts[lang]) for _ in range(n))
    samples = {lang: [text(lang, 400) for _ in range(5)] for lang in scripts}
    tests = [text(lang, 50) for lang in scripts] + ["\U0001F600 \U0001F680", "。、「」", "\u3000", "12 !?", text("ko", 3000) + "zq 日" + text("zh", 700)]
    data = "".join(tests).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in tests)])
    got = []
    for cells in (1 << 25, 0):
        monkeypatch.setattr(language_id, "DENSE_CELLS", cells)
        got.append(language_id.Model(samples).predict(np.frombuffer(data, np.uint8), offsets))
    assert got[0][0] == [*scripts, "und", "und", "und", "und", "ko"] and (got[0][1][4:8] == 0).all()
    assert got[1][0] == got[0][0] and (got[1][1] == got[0][1]).all()


def test_quality(spark):
    rng = random.Random(2)
    good = lambda: " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(60)) + "."
    bad = lambda: " ".join(w.upper() + "!!" for w in good().split())
    rows = [(k, good() if k % 3 else bad()) for k in range(600)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(0, 600, 2)] + [(1, None)], "doc_id long, quality int")
    docs = spark.createDataFrame([*rows, (700, None), (701, ""), (702, good() * 3000)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.score(docs, quality.train(docs, labels)).collect()}
    held = [k for k in range(1, 600, 2)]
    assert sum(got[k].predicted == int(k % 3 > 0) for k in held) >= 0.97 * len(held)
    assert len(got) == 603 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    flat = quality.score(docs, quality.train(docs, labels.where("quality = 1"))).collect()
    assert {r.score for r in flat} == {1.0}
    assert {r.score for r in quality.score(docs, quality.train(docs, labels.limit(0))).collect()} == {0.5}
    assert quality.score(docs.limit(0), quality.train(docs, labels)).count() == 0


def plain_statistics(text):
    """One text's statistics, byte by byte and word by word."""
    raw = text.encode()
    words, lines = [w for w in re.split(rb"[ \t-\r]+", raw) if w], raw.count(b"\n") + 1
    classes = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".,;:'\"-()?", b"!", b"|", b"*#$%&@^~=_+<>/\\[]{}`")
    share = lambda x, n: (x / max(n, 1)) ** 0.5
    sizes = np.array([len(w) for w in words] or [0])
    letter = lambda b: chr(b).isascii() and chr(b).isalpha() or b > 127
    return [
        *(share(sum(b in c for b in raw), len(raw)) for c in classes),
        np.log1p(len(raw)) / 4,
        np.log1p(sizes.mean()),
        np.log1p(sizes.std()),
        share(sum(w[-1] in classes[-1] for w in words), len(words)),
        share(sum(not letter(w[-1]) for w in words), len(words)),
        share(sum(len(w) == 1 for w in words), len(words)),
        share(len(words) - len(set(words)), len(words)),
        np.log1p(len(words) / lines) / 2,
    ]


def test_quality_statistics_and_normal_equations(spark):
    rng = random.Random(5)
    texts = ["", "a", "  \n ", "Ab! cd| 12\n\nab ab é#", "x" * 300] + ["".join(rng.choice("abc AB1.\n!|#é") for _ in range(rng.randrange(200))) for _ in range(60)]
    raw = [t.encode() for t in texts]
    stats = quality.statistics(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert np.allclose(stats, [plain_statistics(t) for t in texts], atol=1e-7)
    labels = [k % 2 for k in range(len(texts))]
    model = quality.Model(stats.mean(axis=0), stats.std(axis=0), 1, features=20)
    rows = spark.createDataFrame([(y, [float(v) for v in x]) for x, y in zip(stats, labels)], "label int, stats array<double>").repartition(7)
    sums, n = quality._normal_equations(rows, model)
    scaled = np.clip((stats - model.mean) / model.spread, -8, 8)
    z = np.array([[*(np.cos(x @ model.directions + model.phases) * (2 / 20) ** 0.5), 1, y] for x, y in zip(scaled, labels)])
    assert n == len(texts) and np.allclose(sums, z.T @ z)


def test_held_out_quality_and_language(spark):
    """What was not learnt from: area under the curve and accuracy of quality, accuracy of languages, at sf0.01."""
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in quality.op3_quality(spark, sf).collect() if r.held_out and r.doc_id in labels]
    good, bad = ([r.score for r in held if labels[r.doc_id] == k] for k in (1, 0))
    assert len(good) > 20 and len(bad) > 3
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.97
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    told = [(r.lang_pred, langs[r.doc_id]) for r in language_id.op1_language_id(spark, sf).collect() if r.held_out and langs[r.doc_id] and r.lang_pred != "und"]
    assert len(told) > 200 and np.mean([a == b for a, b in told]) > 0.99


def test_isotonic():
    fit = quality.isotonic(np.array([1.0, 0, 3, 2, 5]), np.array([2.0, 2, 4, 4, 5]))
    assert (np.diff(fit) >= 0).all() and np.allclose(fit, [0.25, 0.25, 0.625, 0.625, 1.0])


def test_urls(spark):
    urls = ["http://a.com/x", "http://www.example.com/en/1?q#f", "http://b.example.com/en/", "https://X.NET/es/1", "http://x.net/fr/2#t", "http://x.net/en/3", "nourl", None, "http://com", "http://notcom/", "ftp://h?x=/en/", "http://net/es/"]
    df = spark.createDataFrame([(k, u, "c") for k, u in enumerate(urls)], "page_id long, url string, template string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert len(got) == len(urls)
    assert got[0] == ("a.com", "/x", "com/", "allow")
    assert got[1] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[2] == ("b.example.com", "/en/", "example.com/en/", "block")
    assert got[3] == ("x.net", "/es/1", "net/es/", "block") and got[4][2:] == ("net/fr/", "block") and got[11][2] == "net/es/"
    assert got[6][:3] == got[7][:3] == ("", "", None) and got[8][:3] == ("com", "", None) and got[9][:3] == ("notcom", "/", None) and got[10][:3] == ("h", "", None)
    assert all(v[3] in ("allow", "block") for v in got.values())
    assert url_filter.judge(df.limit(0)).count() == 0


def test_url_tree(spark):
    """Templates, merges and purities as a plain tree finds them."""
    rng = random.Random(6)
    rules = [("block", "spam.net", "/"), ("block", "bad.net", "/p/"), ("block", "h.org", "/x/"), ("allow", "h.org", "/y/"), ("allow", "h.org", "/z/1"), ("block", "h.org", "/z/2"), ("allow", "shop.com", "/a/b/c/d/e/1"), ("block", "shop.com", "/a/b/c/d/f")]
    urls = [f"http://{rng.choice(['spam.net', 'm.spam.net'])}/{rng.choice('ab')}/{k}" for k in range(60)]
    urls += [f"http://bad.net/{rng.choice('pq')}/{k}" for k in range(80)]
    urls += [f"http://h.org/{rng.choice('xyzuvw')}/{rng.choice('123456')}{rng.choice(['', '/p', f'/{k}'])}" for k in range(600)]
    urls += [f"https://shop.com/a/b/c/d/{rng.choice('efg')}/{rng.randrange(40)}/t" for k in range(300)]
    urls += [f"http://h{k % 9}.com/{rng.choice(['*', 'a|b', 'c'])}/{k}" for k in range(200)] + ["http://h.org", "http://h.org/", "nourl", None, ""]
    df = spark.createDataFrame([(k, u, "c") for k, u in enumerate(urls)], "page_id long, url string, template string")
    got = {r.page_id: r for r in url_filter.judge(df, rules).collect()}
    action = {h + p: a for a, h, p in rules}
    label = {k: None if r.rule is None else int(action[r.rule] == "block") for k, r in got.items()}
    want = brute.url_tree([(got[k].host, got[k].path, label[k]) for k in range(len(urls))], url_filter.MIN_SHARE, url_filter.MIN_URLS, url_filter.SIMILAR, url_filter.PRIOR)
    for k in range(len(urls)):
        assert got[k].template == want[k][0] and got[k].n_labels == want[k][1] and abs(got[k].purity - want[k][2]) < 1e-9, urls[k]
        assert got[k].verdict == (action[got[k].rule] if got[k].rule else "block" if want[k][1] and want[k][2] >= url_filter.REJECT else "allow")
    templates = {(r.host, r.template) for r in got.values()}
    assert any("|" in t for _, t in templates) and any(t.count("/") > 5 for _, t in templates)
    assert all(r.n_labels for r in got.values() if r.rule is None and r.verdict == "block")


def test_url_templates(spark):
    rows = [(k, f"http://h/spam/{k}") for k in range(40)] + [(100 + k, f"http://h/news/{k}") for k in range(40)]
    rules = [("block", "h", f"/spam/{d}") for d in "1234"] + [("allow", "h", f"/news/{d}") for d in "1234"]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()
    free = {(r.template, r.verdict) for r in got if r.rule is None}
    assert free == {("/spam/*", "block"), ("/news/*", "allow")}


def test_url_branches_without_labels_are_not_judged_by_their_siblings(spark):
    """A host whose labels are all of blocked branches, and paths far deeper than any rule looks."""
    rows = [(k, f"http://x.net/{('es', 'fr', 'en', 'de')[k % 4]}/{k}") for k in range(200)] + [(1000 + k, "http://deep.org/" + "/".join("abcdefghijklmnop") + f"/{'pq'[k % 2]}/{k}") for k in range(80)]
    rules = [*url_filter.RULES, *(("block", "deep.org", "/" + "/".join("abcdefghijklmnop") + f"/q/{d}") for d in "1234")]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    free = [r for r in got.values() if r.rule is None]
    assert {(r.template, r.verdict) for r in free if r.host == "x.net"} == {("/en/*", "allow"), ("/de/*", "allow")}
    deep = {(r.template.count("/"), r.template.split("/")[17], r.verdict) for r in free if r.host == "deep.org"}
    assert deep == {(18, "p", "allow"), (18, "q", "block")}


def test_warc(spark):
    big = "x" * 100_000
    rows = [(1, "u", big), (2, "u\r\nWARC/1.1\r\n", "\r\n\r\nWARC/1.1\r\nWARC-Type: x\r\n\r\n"), (3, None, None), (4, "", ""), (5, "a", big), (5, "a", big), (None, "b", big), (6, "é", "é\U0001F600" * 9000), (7, "q", "WARC/1.1\r\n" * 3000), (8, "q", "\r\n" * 40_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    for segment in (1009, warc.SEGMENT_CHARS):
        warc.write_warc(warc.records(df, segment_chars=segment), path := scratch(spark, "warc"))
        got = warc.read_warc(spark, path).collect()
        payloads = sorted(r.payload.decode() for r in got if r.record_type == "response")
        assert payloads == sorted([rows[1][2], "", big, big, rows[7][2], rows[8][2], rows[9][2]])
        assert sorted(r.payload_bytes for r in got) == sorted(len((r[2] or "").encode()) for r in rows)
        assert sum(r.record_type == "revisit" for r in got) == 3
    warc.write_warc(warc.records(df, min_revisit_bytes=1), path := scratch(spark, "warc"))
    assert warc.read_warc(spark, path).where("record_type = 'revisit'").count() == 2
    warc.write_warc(warc.records(df.limit(0)), path := scratch(spark, "warc"))
    assert warc.read_warc(spark, path).count() == 0


def test_warc_hostile_urls(spark):
    """Version marks, line breaks of any kind and headers in urls and ids."""
    urls = ["http://a.com/WARC/1.1", "x\u2028Content-Length: 5", "x\u2029WARC-Type: revisit", "x\u0085Content-Length: 5", "x\r\n\r\nWARC/1.1\r\n", "\x00\x1f\x7f a\tb", "é\U0001F600", " ", "WARC/1.1", "a%20b"]
    rows = [(f"{u}:{k}", u, f"<p>{k}</p>\u2028WARC/1.1\r\nContent-Length: 1") for k, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    warc.write_warc(warc.records(df, segment_chars=40), path := scratch(spark, "warc"))
    got = warc.read_warc(spark, path).collect()
    assert sorted(r.payload.decode() for r in got) == sorted(r[2] for r in rows) and {r.record_type for r in got} == {"response"}
    named = {r.payload.decode(): r.url for r in got}
    assert [named[r[2]] for r in rows] == ["http://a.com/WARC/1.%31", "x%E2%80%A8Content-Length:%205", "x%E2%80%A9WARC-Type:%20revisit", "x%C2%85Content-Length:%205", "x%0D%0A%0D%0AWARC/1.1%0D%0A", "%00%1F%7F%20a%09b", "é\U0001F600", "%20", "WARC/1.%31", "a%20b"]


def test_warc_records_are_complete(spark):
    """Each record states type, id, date and length; other letter cases of header names are read; broken UTF-8 is replaced."""
    df = spark.sql("select 1L as page_id, 'u' as url, 'y' as html union all select 2, 'v', cast(x'61FF62' as string)")
    heads = [r.record.split("\r\n\r\n")[0] for r in warc.records(df).collect()]
    assert all(any(line.startswith(f"{k}: ") for line in h.split("\r\n")) for h in heads for k in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"))
    lower = warc.records(df).select(F.replace("record", F.lit("WARC-Payload-Digest"), F.lit("warc-payload-digest")).alias("record"))
    warc.write_warc(lower, path := scratch(spark, "warc"))
    assert sorted(r.payload.decode() for r in warc.read_warc(spark, path).collect()) == ["a\ufffdb", "y"]


def test_warc_missing_segment_raises(spark):
    df = spark.createDataFrame([(1, "u", "y" * 5000)], "page_id long, url string, html string")
    cut = warc.records(df, segment_chars=1000).where("record not like '%WARC-Segment-Number: 3%'")
    warc.write_warc(cut, path := scratch(spark, "warc"))
    with pytest.raises(Exception, match="segments missing"):
        warc.read_warc(spark, path).collect()


def test_byte_bpe(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    tokens = byte_bpe.read_ranks(ranks)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})
    rng = random.Random(7)
    chars = [*map(chr, range(32, 127)), *" \n\t \x1c\x0b\xa0\x85éñß日本\U0001F600"]
    rows = [(k, "".join(rng.choice(chars) for _ in range(rng.randrange(80)))) for k in range(400)]
    rows += [(900, None), (901, ""), (902, "a" * 20_000 + " " * 500 + "ñ" * 900), (903, "it's   two  spaces"), (None, "x y"), (None, "x y")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ids int")
    for split in (True, False):
        got = byte_bpe.decode(byte_bpe.encode(df, ranks, public_tokenizers.PATTERN, split_at_spaces=split), ranks).collect()
        assert len(got) == len(rows)
        for r, (i, t) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id)), sorted(rows, key=lambda r: (r[0] is None, r[0])), strict=True):
            want = own.encode_ordinary(t or "")
            assert r.doc_id == i and np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want) and r.decoded == (t or "").encode()
    assert byte_bpe.encode(df.limit(0), ranks, public_tokenizers.PATTERN).count() == 0


def test_crc32_folds_match_sql(spark):
    ids = [0, 1, 57, 123456]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select(quality.learnt_fold().alias("f")).collect()
    assert [r.f for r in got] == [zlib.crc32(str(i).encode()) % 4 != 2 for i in ids]
