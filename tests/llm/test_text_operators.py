"""Operators on words against plain Python versions, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from corpuseval.llm._session import scratch
from corpuseval.llm import decontaminate, sharding, simhash, substring_dedup

DOCS = "doc_id long, text string"


def texts(seed, n=250, letters="ab", base=2500):
    rng = random.Random(seed)
    words = [rng.choice(letters) for _ in range(base)]
    out = []
    for i in range(n):
        at = rng.randrange(base - 100)
        out.append((i, " ".join(words[at : at + rng.randrange(2, 90)] + [rng.choice("xyzé") for _ in range(rng.randrange(25))])))
    out[3], out[4], out[5] = (3, None), (4, ""), (5, " \t\n ")
    out[6] = (6, " ".join(words * 6))
    out[7], out[8] = (7, out[9][1]), (8, out[9][1])
    return out


@pytest.mark.parametrize("pack", [400_000, 500])
def test_substring_dedup(spark, monkeypatch, pack):
    monkeypatch.setattr(substring_dedup, "_PACK", pack)
    docs = [(i - 20, t) for i, t in texts(1)]
    want = brute.repeats(docs)
    got = substring_dedup.remove_repeats(spark.createDataFrame(docs, DOCS)).collect()
    assert len(got) == len(docs) and sum(r.n_removed for r in got) > 0
    assert all((r.n_words, r.n_removed, r.kept) == want[r.doc_id] for r in got)


def test_substring_dedup_edges(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    rows = [(1, passage, 9), (1, passage, 9), (2, f"a\n{passage}", 9), (None, passage, 9), (None, None, 9), (3, None, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tags int")
    got = sorted((r.doc_id or 0, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(df).collect())
    assert got == sorted([(1, 0, passage), (1, 0, passage), (2, 20, "a"), (0, 0, passage), (0, 0, ""), (3, 0, "")])
    same = substring_dedup.remove_repeats(df, keep_unchanged=True, carry=("tags",)).collect()
    assert {(r.doc_id, r.kept, r.tags) for r in same} == {(1, passage, 9), (2, "a", 9), (None, passage, 9), (None, None, 9), (3, None, 9)}
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0


def test_cover_meets_every_pair_of_positions():
    c, v = substring_dedup.COVER, substring_dedup.PERIOD
    assert all(any((i + s) % v in c and (j + s) % v in c for s in range(v)) for i in range(v) for j in range(v))
    assert substring_dedup.ANCHOR + v - 1 == substring_dedup.WINDOW


def test_simhash(spark):
    rng = random.Random(5)
    docs = texts(2)
    long = [f"w{rng.randrange(5000)}" for _ in range(600)]
    for k in range(60):  # near copies, a few words changed
        words = list(long)
        for _ in range(k % 4):
            words[rng.randrange(600)] = "changed"
        docs.append((1000 + k, " ".join(words).upper() if k % 5 == 0 else " ".join(words)))
    want = brute.simhash(docs)
    got = simhash.near_duplicates(spark.createDataFrame([(i, t, 1) for i, t in docs], DOCS + ", fp int")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fp"), "component").collect()
    assert len(got) == len(docs) and all((r.fp, r.component) == want[r.doc_id] for r in got)
    assert len({r.component for r in got if r.doc_id >= 1000}) < 20
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_golay_code():
    import numpy as np

    tables = simhash._golay()
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 3000)
    index = simhash.golay_index(words, tables)
    code = (index << 11) | tables[0][index]
    assert (np.bitwise_count(words ^ code) <= 3).all()
    for length in (21, 22):
        short = rng.integers(0, 1 << length, 500)
        keys, fresh = simhash.golay_keys(short, length, tables)
        assert fresh.sum(axis=1).max() <= 6
        near = short ^ (1 << rng.integers(0, length, 500))
        assert all(simhash.golay_index(near[k : k + 1], tables)[0] in keys[k] for k in range(500))


def test_keys_find_all_pairs_within_three_bits():
    import numpy as np

    rng = np.random.default_rng(2)
    a = rng.integers(-(1 << 63), (1 << 63) - 1, 300)
    flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in a]
    b = (a.view(np.uint64) ^ np.array(flips, dtype=np.uint64)).view(np.int64)
    tables = simhash._golay()
    wa, ka = simhash._expand(a, tables)
    wb, kb = simhash._expand(b, tables)
    asked = {(int(w), int(k) >> 1) for w, k in zip(wa, ka) if k & 1}
    assert len(asked) == 3 * 300  # the own keys alone ask
    met = {int(w) for w, k in zip(wb, kb) if (int(w), int(k) >> 1) in asked}
    assert met == set(range(300))


def test_all_near_keys_find_all_pairs_within_five_bits():
    import numpy as np

    rng = np.random.default_rng(3)
    a = rng.integers(-(1 << 63), (1 << 63) - 1, 300)
    flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in a]
    b = (a.view(np.uint64) ^ np.array(flips, dtype=np.uint64)).view(np.int64)
    tables = simhash._golay()
    keys = [{(int(w), int(k)) for w, k in zip(*simhash._expand(x, tables, True))} for x in (a, b)]
    assert {w for w, _ in keys[0] & keys[1]} == set(range(300))


@pytest.mark.parametrize("large", [40, 1000])
@pytest.mark.parametrize("asking", [1, 3, 127])
def test_links_of_large_keys(spark, large, asking):
    """Links of rows that ask, whether a key is compared at once or in blocks, and whatever the batches."""
    base = 0x123456789ABCDEF
    fps = [base ^ (1 << k) for k in range(64)] + [base ^ (1 << k) ^ (1 << (k + 1)) for k in range(63)]
    fps = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    asks = {f: k % (128 // asking) == 0 for k, f in enumerate(fps)}
    rows = [(14 | asks[f], f) for f in fps] + [(16, 1), (17, 3), (19, 1)]
    keyed = spark.createDataFrame(rows, "key long, fp long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        links = simhash._links(keyed, (3,), large).cache()
        left = links.where("key is not null")
        assert left.count() == (127 if large == 40 else 0)
        edges = [(r.a, r.b) for r in links.where("key is null").collect()] + [(r.a, r.b) for r in simhash._links_of_blocks(left, (3,), large).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (asks[a] or asks[b]) and bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 3] + [(1, 3)]
    nodes = sorted({*fps, 1, 3})
    assert brute.roots(nodes, edges) == brute.roots(nodes, want)


def edited(words, rng, share):
    return [rng.choice("pqrst") + str(rng.randrange(99)) if rng.random() < share else w for w in words]


def test_similar_texts(spark, monkeypatch):
    """Chains and stars of edited copies in blocks, against all pairs; the pipeline's test has groups of one block."""
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", 2000)
    rng = random.Random(9)
    vocabulary = [f"{rng.choice('abcdefgh')}{k}" for k in range(2000)]
    docs = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 300)))) for k in range(150)]
    for k in range(120):
        docs.append((1000 + k, " ".join(edited((docs[k % 7] if k < 60 else docs[rng.randrange(len(docs))])[1].split(), rng, rng.choice([0, 0.01, 0.02, 0.04])))))
    docs += [(3000, None), (3001, ""), (3002, " \n"), (3003, "one two"), (3004, "ONE  two"), (3005, "one two three"), (3006, "a " * 9), (3007, "a " * 7), (3008, docs[3][1].upper()), (3009, (docs[5][1] + " ") * 200), (3010, (docs[5][1] + " ") * 210)]
    rng.shuffle(docs)
    want = brute.similar(docs)
    df = spark.createDataFrame([*((i, t, 1) for i, t in docs), (docs[0][0], docs[0][1], 2), (None, docs[0][1], 1), (None, None, 1)], DOCS + ", node int")
    got = simhash.similar_texts(df).collect()
    assert len(got) == len(docs) and {r.doc_id: r.first_id for r in got} == want
    assert {r.doc_id for r in got if r.rows == 2} == {docs[0][0]}
    assert len(set(want.values())) < 200
    assert simhash.similar_texts(df.limit(0)).count() == 0


ITEMS = [(1, "The quick brown fox jumps over the lazy dog again and again, until Dawn!"), (2, "short item"), (3, None), (4, ""), (5, "Über éclair naïve café déjà vu garçon señor piñata über straße"), (6, "short item"), (None, "a b c")]


def contaminated_docs():
    rng = random.Random(3)
    pool = " ".join(t or "" for _, t in ITEMS).split()
    docs = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(60)))) for i in range(150)]
    for i, (_, t) in enumerate(ITEMS):
        docs.append((1000 + i, f"before {t} after"))
        docs.append((2000 + i, (t or "").upper().replace(" ", "  --\n")))
    return [*docs, (3000, None), (3001, ""), (3002, "SHORT,item" * 3000), (3003, " ".join(ITEMS[0][1].split()[:9]))]


def test_decontaminate(spark):
    docs = contaminated_docs()
    want = brute.contamination(docs, ITEMS)
    df, bench = spark.createDataFrame([(i, t, 1) for i, t in docs], DOCS + ", hits int"), spark.createDataFrame(ITEMS, "item_id long, text string")
    for limit in (decontaminate.MAX_WINDOWS, 5):
        got = decontaminate.find_contamination(df, bench, max_windows=limit, max_hashes=10).collect()
        assert len(got) == len(docs)
        for r in got:
            assert (r.n_words, sum(h["last"] - h["first"] + 1 for h in r.hits), r["items"]) == want[r.doc_id]
    assert decontaminate.find_contamination(df, bench.limit(0)).where(F.size("hits") > 0).count() == 0


def test_decontaminate_cleans(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = spark.createDataFrame([(1, f"keep this. {ITEMS[0][1]} And this."), (2, "clean  text"), (3, None)], DOCS)
    got = {r.doc_id: r.cleaned for r in decontaminate.find_contamination(df, bench, clean=True).collect()}
    assert got == {1: "keep this. ! And this.", 2: "clean  text", 3: None}


def test_decontaminate_blocks_give_the_same_rows(spark):
    """Repeated and null ids, one window of many items, cleaned texts and carried columns, whatever the number of blocks."""
    docs = contaminated_docs()
    docs += [(1000, "no hit at all"), (1000, f"again {ITEMS[0][1]}"), (None, ITEMS[4][1]), (None, "short item and more"), (None, None), (1000, "no hit at all")]
    bench = spark.createDataFrame([*ITEMS, *((100 + k, "short item") for k in range(20))], "item_id long, text string")
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(docs)], DOCS + ", tag int")
    got = [sorted(map(repr, decontaminate.find_contamination(df, bench, clean=True, max_windows=m, max_hashes=7 * m, carry=("tag",)).collect())) for m in (decontaminate.MAX_WINDOWS, 15, 5, 1)]
    assert len(got[0]) == len(docs) and sum("hits=[]" not in r for r in got[0]) > 20
    assert all(g == got[0] for g in got[1:])
    plain = [sorted(map(repr, decontaminate.find_contamination(df.select("doc_id", "text"), bench, max_windows=m, max_hashes=20).collect())) for m in (decontaminate.MAX_WINDOWS, 5)]
    assert plain[0] == plain[1] and len(plain[0]) == len(docs)


def test_sharding(spark):
    docs = texts(4, 333)
    df = spark.createDataFrame([(i, t, 1, "hot") for i, t in docs] + [(None, "x", 1, "hot")] * 3, "doc_id long, text string, slot int, source string")
    for bucket in (1 << 25, 1000):
        got = sharding.shuffle_shards(df, shards=7, bucket_bytes=bucket).collect()
        assert sorted((r.doc_id or -1, r.text or "") for r in got) == sorted((r.doc_id or -1, r.text or "") for r in df.collect())
        slots = {}
        for r in got:
            slots.setdefault(r.shard, []).append(r.slot)
        assert {len(v) for v in slots.values()} <= {336 // 7, 336 // 7 + 1} and len(slots) == 7
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    again = sharding.shuffle_shards(df.repartition(5), shards=7, bucket_bytes=1000)
    assert sorted((r.doc_id or -1, r.shard, r.slot) for r in again.collect() if r.doc_id is not None) == sorted((r.doc_id or -1, r.shard, r.slot) for r in got if r.doc_id is not None)
    assert sharding.shuffle_shards(df.limit(0)).count() == 0
    few = sharding.shuffle_shards(df.where("doc_id < 3"), shards=7).collect()
    assert sorted((r.shard, r.slot) for r in few) == [(0, 0), (1, 0), (2, 0)]


def fisher_yates(rows, seed):
    """The inside-out shuffle by the Mersenne twister that Spark's ``shuffle`` is, in plain Python."""
    import numpy as np

    twister, order = np.random.MT19937(), []
    twister._legacy_seeding([seed >> 32 & 0xFFFFFFFF, seed & 0xFFFFFFFF])

    def below(n):
        while True:
            bits = int(twister.random_raw()) >> 1
            if n & -n == n:
                return n * bits >> 31
            if bits - bits % n + n - 1 < 1 << 31:
                return bits % n

    for i in range(len(rows)):
        j = below(i + 1)
        order.append(i)
        if i != j:
            order[i] = order[j]
        order[j] = i
    return [rows[k] for k in order]


def test_sharding_order(spark):
    """Buckets are ranges of the order, each in the order that Fisher-Yates gives its sorted records; the order is near uniform."""
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("some text of one length").alias("text"))
    total = 4000 * (23 + sharding.OVERHEAD)
    orders = []
    for seed in (1, 2):
        got = sharding.shuffle_shards(df, shards=1, seed=seed, bucket_bytes=total // 8).orderBy("slot").collect()
        orders.append([r.doc_id for r in got])
        buckets = 1 + (total - 1) // (total // 8)
        own = {r[0]: r[1] for r in df.select("doc_id", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(buckets))).collect()}
        key = {r[0]: r[1] for r in df.select("doc_id", F.xxhash64(F.lit(seed + 1), "doc_id", "text")).collect()}
        want = [i for b in range(buckets) for i in fisher_yates(sorted((i for i in own if own[i] == b), key=key.get), seed + b)]
        assert orders[-1] == want
    assert orders[0] != orders[1] and sorted(orders[0]) == list(range(4000))
    quarters = [sum(i < 1000 for i in orders[0][k : k + 1000]) for k in range(0, 4000, 1000)]
    assert all(190 < q < 310 for q in quarters)


def test_shards_of_any_columns_written_and_read(spark):
    """Maps at any depth and columns named like those added; files hold the slots of a shard in order."""
    df = spark.range(500).selectExpr("id as doc_id", "case when id % 9 = 0 then null else repeat('x', cast(id as int)) end as text", "map('b', id, 'a', null) as m", "array(named_struct('k', map(id, map('z', 1)))) as deep", "named_struct('n', cast(null as map<string,int>)) as n", "id as size")
    sharded = sharding.shuffle_shards(df, shards=3, bucket_bytes=20_000)
    sharding.write_shards(sharded, path := scratch(spark, "shards"))
    back = sharding.read_shards(spark, path, sharded.schema)
    assert sorted(map(repr, back.select(*sharded.columns).collect())) == sorted(map(repr, sharded.collect())) and back.count() == 500
    files = back.withColumn("file", F.input_file_name()).select("file", "shard", "slot").collect()
    held = {}
    for r in files:
        held.setdefault((r.shard, r.file), []).append(r.slot)
    assert all(v == list(range(v[0], v[0] + len(v))) for v in held.values())
    assert len(held) <= 3 + 2 * (1 + 500 * 300 // 20_000)


def test_long_texts_in_runs_give_the_same_rows(spark, monkeypatch):
    """Each operator with runs of 64 bytes or words, inside the driver and in tasks, against texts in one piece."""
    import numpy as np

    from corpuseval.llm import _text, quality, simhash

    rng = random.Random(8)
    words = ["a", "Bb", "cc!", "ddd", "é", "日本語", "x" * 90, "9"]
    passage = " ".join(rng.choice(words) for _ in range(30))
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 400))) + rng.choice(["", f" {passage} ", "\n\n"]) + " ".join(rng.choice(words) for _ in range(50)) for _ in range(40)]
    items = decontaminate._Windows([("i", " ".join(decontaminate_words(passage)[:10])), ("j", "a bb")])

    def results():
        out = []
        for t in texts:
            data = np.frombuffer(t.encode(), np.uint8)
            offsets = np.array([0, len(data)])
            lower = _text.lower_ascii()[data]
            found = _text.words(lower, offsets, _text.alphanumeric())
            own = substring_dedup._Words(data, offsets, _text.not_space())
            hit, named = items.scan(lower, offsets, *found)
            out.append((quality.statistics(data, offsets).tolist(), [x.tolist() for x in own.anchors()], [x.tolist() for x in own.windows(np.arange(0, max(len(own.hashes) - 12, 0), 3))], hit.tolist(), named, simhash._fingerprint(t.encode(), 3), [x.tolist() for pair in simhash._shingle_sets(lower, offsets, 5) for x in pair]))
        return out

    whole = results()
    monkeypatch.setattr(_text, "RUN", 64)
    assert results() == whole


def decontaminate_words(text):
    return [w for w in "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower()).split() if w]


def test_invalid_utf8_and_clashing_names(spark):
    """A row whose text is no UTF-8 passes every operator over texts; its bad bytes are U+FFFD in what comes out."""
    from pyspark.sql import functions as F

    from corpuseval.llm import byte_bpe, language_id, line_dedup, quality, sharding, simhash

    df = spark.sql("select 1L as doc_id, cast(x'61626320FFFE20646566' as string) as text, 'en' as lang union all select 2, 'plain text of words', 'en' union all select 3, null, null")
    good = "abc �� def"
    assert substring_dedup.remove_repeats(df).where("doc_id = 1").first().kept == good
    bench = spark.createDataFrame([(1, "def plain")], "item_id int, text string")
    assert decontaminate.find_contamination(df, bench, clean=True).where("doc_id = 1").first().cleaned == good
    ranks = b"".join(__import__("base64").b64encode(bytes([b])) + b" %d\n" % b for b in range(256))
    done = byte_bpe.decode(byte_bpe.encode(df, ranks, r"\S+|\s+"), ranks)
    assert bytes(done.where("doc_id = 1").first().decoded) == good.encode()
    assert line_dedup.drop_repeated_lines(df.select("doc_id", "text")).where("doc_id = 1").first().kept == good
    assert language_id.identify(df, language_id.train(df)).count() == 3
    assert quality.score(df, quality.train(df, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))).count() == 3
    assert simhash.near_duplicates(df).count() == 3 and simhash.similar_texts(df).count() >= 2
    assert sharding.shuffle_shards(df, 2).count() == 3
    for refuse in (
        lambda: decontaminate.find_contamination(df.withColumn("items", F.lit(1)), bench, carry=("items",)),
        lambda: language_id.identify(df.withColumn("score", F.lit(1)), language_id.Model({}), ("doc_id", "score")),
        lambda: quality.score(df.withColumn("score", F.lit(1)), None, ("doc_id", "score")),
        lambda: substring_dedup.remove_repeats(df, carry=("kept",)),
    ):
        with pytest.raises(ValueError, match="names are taken"):
            refuse()
    with pytest.raises(TypeError, match="whole numbers"):
        substring_dedup.remove_repeats(df.withColumn("doc_id", F.lit("x")))
    with pytest.raises(ValueError, match="pre-token"):
        byte_bpe.encode(df, ranks, r"\S+\s*", split_at_spaces=True)
