"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints: a text is lower-cased (A-Z) and cut into words ``[^\\x20\\x09-\\x0D]+``; each run of ``shingle`` words,
joined by a space and repeats included, is hashed by XXH64 (seed 42).  A bit of the fingerprint is 1 if it is set in
over half of the hashes.  Fewer words than a shingle are one shingle; no words (null and empty texts too) give zero,
which is linked like any other fingerprint.

Keys: the 64 bits are three segments of at most 22 bits, each read as a word of the perfect binary Golay code
(23, 12, 7).  A segment's near keys are the codewords (by index) nearest to it and to each word one bit away: one key, or
six; the first of them, its own key, is the codeword nearest to the segment itself.  If two fingerprints differ in three bits or
fewer, at least two segments differ in one bit or none (pigeonhole), and there the own keys of one are near keys of the
other; so every fingerprint is found by its own keys under some pair of segments, and only own keys ask.  If they differ in
five bits or fewer, at least two segments differ in two bits or fewer, and their near keys meet; so beyond three bits all
near keys ask.  Whoever meets is compared bit by bit.

Equal fingerprints are one node from the start, and within one key only a spanning forest of the true links is
kept, so groups of copies never expand into pairs.  A key of more than ``LARGE`` fingerprints is passed on as it comes and
split into blocks, and each pair of blocks is compared in a group of its own: nothing is capped, dropped or held whole.

``near_duplicates`` links fingerprints alone.  ``similar_texts`` takes what Golay keys bring together as candidates and
links texts by the Jaccard similarity of their sets of shingles.

Components are those of ``_components``.  Rows keep their number; repeated rows and ids are judged alike.  An empty
table gives no rows.  Only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuseval.llm import _text
from corpuseval.llm._components import components
from corpuseval.llm._session import read_texts, spread, stored

SHINGLE = 3
MAX_BITS = 3
#: Fingerprints that one group compares.
LARGE = 30_000
#: ``similar_texts``: words of a shingle and similarity; bits in which candidates may differ, in the fingerprints of words and shingles.
SHINGLE_WORDS, SIMILARITY = 5, 0.8
CANDIDATE_BITS = (10, 16)
#: Shingles of the texts that one group compares.
BLOCK_SHINGLES = 400_000
_SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and length
_PAIRS = ((0, 1), (0, 2), (1, 2))
_GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of 64-bit hashes, as a signed integer."""
    lanes = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def _fingerprint(text: bytes, shingle: int) -> int:
    text = text.lower()
    if len(text) <= _text.RUN:
        words = text.split()
        return majority(_shingle_hashes(words, shingle)) if words else 0
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = _text.words(data, np.array([0, len(data)]), _text.not_space())
    step, found = 1 << 16, [np.zeros(0, np.uint64)]
    for low in range(0, max(len(starts) - shingle + 1, min(len(starts), 1)), step):  # runs of shingles, of words that overlap
        run = slice(low, low + step + shingle - 1)
        found.append(_shingle_hashes([text[a:b] for a, b in zip(starts[run].tolist(), ends[run].tolist(), strict=True)], shingle))
    return majority(np.concatenate(found)) if len(starts) else 0


def _shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    joined, last = b" ".join(words), ends[min(shingle, len(words)) - 1 :].tolist()
    return np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts.tolist(), last, strict=False)], dtype=np.uint64)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``fp``, the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in _text.spans(batch.column(1)):
                part = batch.slice(low, high - low)
                texts = pc.cast(pc.fill_null(part.column(1), ""), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_fingerprint(t.as_py(), shingle) for t in texts], pa.int64())], names=[id_col, "fp"])

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp long")


def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Check bits of each 12-bit message, and the error of at most three bits for each syndrome."""
    check = np.arange(4096, dtype=np.int64) << 11
    for bit in range(22, 10, -1):
        check ^= np.where(check >> bit & 1, _GENERATOR << (bit - 11), 0)
    errors = np.zeros(2048, dtype=np.int64)
    one = [1 << k for k in range(23)]
    for error in [*one, *(a | b for a in one for b in one if a < b), *(a | b | c for a in one for b in one for c in one if a < b < c)]:
        errors[check[error >> 11] ^ (error & 2047)] = error
    return check, errors


def golay_index(words: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Index (12 bits) of the only codeword within three bits of each 23-bit word."""
    check, errors = tables
    return (words ^ errors[check[words >> 11] ^ (words & 2047)]) >> 11


def golay_keys(words: np.ndarray, length: int, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Indices for each word and all words one bit away (rows: words), and which of them are the first of their value."""
    near = np.concatenate(([0], 1 << np.arange(length)))
    keys = np.sort(golay_index(words[:, None] ^ near, tables), axis=1)
    fresh = np.ones(keys.shape, dtype=bool)
    fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return keys, fresh


def _expand(fps: np.ndarray, tables: tuple[np.ndarray, np.ndarray], all_ask: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All near keys of the fingerprints: index of the fingerprint, and twice the key, plus one where it asks."""
    raw = fps.view(np.uint64)
    six, own = [], []
    for first, length in _SEGMENTS:
        words = ((raw >> np.uint64(first)) & np.uint64((1 << length) - 1)).astype(np.int64)
        keys, fresh = golay_keys(words, length, tables)
        order = np.argsort(~fresh, axis=1, kind="stable")[:, :6]
        six.append((np.take_along_axis(keys, order, 1), np.take_along_axis(fresh, order, 1)))
        own.append(golay_index(words, tables))
    who, out = [], []
    for kind, (i, j) in enumerate(_PAIRS):
        a, b = six[i][0][:, :, None], six[j][0][:, None, :]
        asks = np.ones((1, 1, 1), bool) if all_ask else (a == own[i][:, None, None]) & (b == own[j][:, None, None])
        key = (((kind << 24) | (a << 12) | b) << 1) | asks
        at = np.nonzero(six[i][1][:, :, None] & six[j][1][:, None, :])
        who.append(at[0])
        out.append(key[at])
    return np.concatenate(who), np.concatenate(out)


def _keyed(nodes: DataFrame, marks: tuple[str, ...], all_ask: bool) -> DataFrame:
    """``key`` and ``marks`` of each node; keys are those of the first mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _golay()
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            for low in range(0, len(batch), 2000):
                part = [c[low : low + 2000] for c in columns]
                who, keys = _expand(part[0], tables, all_ask)
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(c[who]) for c in part)], names=["key", *marks])

    return spread(nodes.select(*marks)).mapInArrow(run, "key long" + "".join(f", {m} long" for m in marks))


Near = Callable[[int, np.ndarray], np.ndarray]


def near_bits(marks: list[np.ndarray], limits: tuple[int, ...]) -> Near:
    """Which of some rows differ from a row in no more bits than ``limits`` in each mark."""
    raw = [m.view(np.uint64) for m in marks]
    return lambda at, rest: np.logical_and.reduce([np.bitwise_count(m[rest] ^ m[at]) <= n for m, n in zip(raw, limits, strict=True)])


def spanning_links(asks: np.ndarray, near: Near) -> list[tuple[int, np.ndarray]]:
    """Links (row, rows) that connect whatever the links between an asking row and any row connect.

    Breadth first: each row is reached once, and a row that does not ask is compared with asking rows only.
    """
    out, rest, queue = [], np.arange(len(asks)), []
    seeds = iter(np.flatnonzero(asks))
    open_ = np.ones(len(asks), bool)
    while True:
        if not queue:
            start = next((s for s in seeds if open_[s]), None)
            if start is None:
                return out
            open_[start] = False
            queue = [int(start)]
        at = queue.pop()
        rest = rest[open_[rest]]
        if not len(rest):
            return out
        met = rest if asks[at] else rest[asks[rest]]
        found = met[near(at, met)]
        if len(found):
            open_[found] = False
            out.append((at, found))
            queue.extend(found.tolist())


def _names(marks: list[np.ndarray]) -> np.ndarray:
    """The mark itself where there is one, else a hash of all."""
    if len(marks) == 1:
        return marks[0]
    return (_text.mix(marks[0].view(np.uint64)) ^ marks[1].view(np.uint64)).view(np.int64)


def _links_of_sorted(keys: np.ndarray, marks: list[np.ndarray], limits: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Linked rows within the runs of equal keys; within a run asking rows are last."""
    base, asks = keys >> 1, (keys & 1).astype(bool)
    bounds = np.concatenate(([0], np.flatnonzero(np.diff(base)) + 1, [len(base)]))
    sizes = np.diff(bounds)
    run = np.repeat(np.arange(len(sizes)), sizes)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at = np.flatnonzero(np.repeat(sizes <= 16, sizes))
    for step in range(1, 16):
        at = at[at + step < len(keys)]
        at = at[run[at] == run[at + step]]
        if not len(at):
            break
        close = asks[at + step]
        for m, n in zip(marks, limits, strict=True):
            close = close & (np.bitwise_count((m[at] ^ m[at + step]).view(np.uint64)) <= n)
        a.append(at[close])
        b.append(at[close] + step)
    for k in np.flatnonzero(sizes > 16):
        own = slice(bounds[k], bounds[k + 1])
        for x, found in spanning_links(asks[own], near_bits([m[own] for m in marks], limits)):
            a.append(np.full(len(found), bounds[k] + x))
            b.append(bounds[k] + found)
    return np.concatenate(a), np.concatenate(b)


def _links(keyed: DataFrame, limits: tuple[int, ...], large: int = LARGE) -> DataFrame:
    """``a``, ``b``: linked names.  Rows of keys that more than ``large`` share come back with their ``key`` and marks."""
    marks = keyed.columns[1:]
    schema = pa.schema([(c, pa.int64()) for c in ("a", "b", "key", *marks)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(keys: np.ndarray, parts: list[np.ndarray]) -> pa.RecordBatch:
            i, j = _links_of_sorted(keys, parts, limits)
            names = _names(parts)
            empty = pa.nulls(len(i), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(names[i]), pa.array(names[j]), empty, *(empty for _ in marks)], schema=schema)

        def passed_on(keys: np.ndarray, parts: list[np.ndarray]) -> pa.RecordBatch:
            empty = pa.nulls(len(keys), pa.int64())
            return pa.RecordBatch.from_arrays([empty, empty, pa.array(keys), *map(pa.array, parts)], schema=schema)

        held, hot = [np.zeros(0, np.int64)] * (1 + len(marks)), -1  # rows of the last key, which may go on; a key that is passed on
        for batch in batches:
            held = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns, strict=True)]
            if not len(held[0]):
                continue
            base = held[0] >> 1
            if base[0] == hot:
                n = int(np.searchsorted(base, hot, "right"))
                yield passed_on(held[0][:n], [h[:n] for h in held[1:]])
                held = [h[n:] for h in held]
                if not len(held[0]):
                    continue
                base = base[n:]
            bounds = np.concatenate(([0], np.flatnonzero(np.diff(base)) + 1, [len(base)]))
            sizes = np.diff(bounds)
            over = np.repeat(sizes > large, sizes)
            done = over | (np.arange(len(base)) < bounds[-2])
            if over.any():
                yield passed_on(held[0][over], [h[over] for h in held[1:]])
            if sizes[-1] > large:
                hot = int(base[-1])
            yield found(*(lambda x: (x[0], x[1:]))([h[done & ~over] for h in held]))
            held = [h[~done] for h in held]
        yield found(held[0], held[1:])

    dealt = keyed.repartition(F.shiftright("key", 1)).sortWithinPartitions("key")
    return dealt.mapInArrow(run, ", ".join(f"{f.name} long" for f in schema))


def _links_of_blocks(left: DataFrame, limits: tuple[int, ...], large: int = LARGE) -> DataFrame:
    """Links within keys that very many fingerprints share: a group for each pair of blocks."""
    marks = [c for c in left.columns if c not in ("a", "b", "key")]
    rows = left.select(F.shiftright("key", 1).alias("base"), F.expr("(key & 1) = 1").alias("asks"), *marks)
    blocks = rows.groupBy("base").agg(F.ceil(F.count("*") * 2 / large).cast("int").alias("blocks"))
    rows = rows.join(blocks, "base").withColumn("own", F.pmod(F.xxhash64(*marks), "blocks").cast("int"))
    pairs = rows.select("base", "asks", *marks, "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = pairs.select("base", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "asks", *marks)

    def run(table):
        columns = [table[m].to_numpy() for m in marks]
        return _pairs(_names(columns), spanning_links(table["asks"].to_numpy(), near_bits(columns, limits)))

    return pairs.repartition("base", "i", "j").groupBy("base", "i", "j").applyInArrow(run, "a long, b long")


def _pairs(names: np.ndarray, found: list[tuple[int, np.ndarray]]) -> pa.Table:
    empty = np.zeros(0, np.int64)
    a, b = ([empty, *(np.full(len(y), names[x]) for x, y in found)], [empty, *(names[y] for _, y in found)])
    return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})


def _candidates(nodes: DataFrame, marks: tuple[str, ...], limits: tuple[int, ...], all_ask: bool) -> DataFrame:
    """``a``, ``b``: links between names of nodes."""
    links = stored(_links(_keyed(nodes, marks, all_ask), limits), "candidates")
    edges = links.where("key is null").select("a", "b")
    if (left := links.where("key is not null")).take(1):
        edges = edges.unionByName(_links_of_blocks(left, limits))
    return edges


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``fp`` and ``component``: the smallest id reachable over links of at most ``bits`` (0 to 5) differing bits."""
    if not 0 <= bits <= 5:
        raise ValueError("pairs of Golay keys find all links of at most five bits")
    marked = stored(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    nodes = stored(marked.groupBy("fp").agg(F.min(id_col).alias("least")), "nodes")
    roots = components(_candidates(nodes, ("fp",), (bits,), bits > MAX_BITS))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = stored(rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component")), "root").select("fp", "component"), "components")
    return marked.join(names, "fp").select(id_col, "fp", "component")


# ---- texts by the similarity of their sets of shingles


def _distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes; the array given is sorted too."""
    hashes.sort()
    new = np.ones(len(hashes), dtype=bool)
    np.not_equal(hashes[1:], hashes[:-1], out=new[1:])
    return hashes[new]


def _content(text: bytes, xxh3_128) -> bytes:
    """The digest of a text's words joined by one space; runs of a longer text at a time."""
    if len(text) <= _text.RUN:
        return xxh3_128(b" ".join(text.split())).digest()
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = _text.words(data, np.array([0, len(data)]), _text.not_space())
    digest, step = xxh3_128(), 1 << 16
    for low in range(0, len(starts), step):
        words = [text[a:b] for a, b in zip(starts[low : low + step].tolist(), ends[low : low + step].tolist(), strict=True)]
        digest.update((b" " if low else b"") + b" ".join(words))
    return digest.digest()


def _shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its word hashes in order and its sorted distinct shingle hashes; fewer words are one shingle."""
    starts, ends, first = _text.words(data, offsets, _text.not_space())
    hashes = _text.word_hashes(data, starts, ends)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        own = hashes[a:b]
        yield own, _distinct(_text.window_hashes(own, min(shingle, len(own)))) if len(own) else own


def _sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """``id`` and ``code`` of each row of (id, code, text) with its ``content``, a 128-bit hash of its words, and its marks.

    ``words`` and ``shingles`` are the fingerprints of its distinct words and shingles, ``name`` a hash of both; null where
    there are fewer words than a shingle, so that no text of other words can be similar.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128

        lower = _text.lower_ascii()
        for batch in batches:
            for low, high, data, offsets in _text.slices(batch.column(2)):
                data, rows = lower[data], []
                for k, (words, found) in enumerate(_shingle_sets(data, offsets, shingle)):
                    content = _content(data[offsets[k] : offsets[k + 1]].tobytes(), xxh3_128)
                    rows.append((content, len(words) < shingle, *((majority(_distinct(words.copy())), majority(found)) if len(words) else (0, 0))))
                content, short, *marks = zip(*rows, strict=True)
                marks = [np.array(m, np.int64) for m in marks]
                marks = [pa.array(m, mask=np.array(short)) for m in (*marks, _names(marks))]
                yield pa.RecordBatch.from_arrays([*(c.slice(low, high - low) for c in batch.columns[:2]), pa.array(content, pa.binary()), *marks], names=["id", "code", "content", "words", "shingles", "name"])

    return docs.mapInArrow(run, "id long, code long, content binary, words long, shingles long, name long")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """The rows with ``shingles``, the set of shingle hashes, in place of the last column, the text."""
    kept = texts.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower = _text.lower_ascii()
        for batch in batches:
            for low, high, data, offsets in _text.slices(batch.column(len(kept))):
                found = [s.view(np.int64) for _, s in _shingle_sets(lower[data], offsets, shingle)]
                at = np.concatenate(([0], np.cumsum([len(s) for s in found]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(c.slice(low, high - low) for c in batch.columns[:-1]), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(found)))], names=[*kept, "shingles"])

    return texts.mapInArrow(run, ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in kept) + ", shingles array<long>")


def near_sets(sets: list[np.ndarray], similarity: float) -> Near:
    """Which of some rows have a Jaccard similarity of at least ``similarity`` to a row."""
    sizes = np.array([len(s) for s in sets], np.int64)
    _, number = np.unique(np.concatenate([np.zeros(0, np.int64), *sets]), return_inverse=True)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    mark = np.zeros(int(number.max(initial=0)) + 1, bool)

    def near(at: int, rest: np.ndarray) -> np.ndarray:
        n = sizes[at]
        fit = (sizes[rest] >= similarity * n - 1e-9) & (similarity * sizes[rest] <= n + 1e-9)
        out, own = np.zeros(len(rest), bool), number[bounds[at] : bounds[at + 1]]
        mark[own] = True
        some = rest[fit]
        if len(some):
            starts = np.cumsum(sizes[some]) - sizes[some]
            flat = number[np.arange(sizes[some].sum()) + np.repeat(bounds[some] - starts, sizes[some])]
            shared = np.add.reduceat(mark[flat].astype(np.int64), starts)
            out[fit] = shared >= similarity * (n + sizes[some] - shared) - 1e-9
        mark[own] = False
        return out

    return near


def _similar(members: DataFrame, similarity: float) -> DataFrame:
    """``a``, ``b``: links between members (``group``, ``node``, ``degree``, ``shingles``) of one group that connect what is similar.

    First every member is compared with its group's centre, the one of most candidates.  Those that are not similar to it are
    compared with all members of the group, in blocks of bounded size; only a spanning forest is kept.
    """
    order = F.struct("degree", -F.col("node"))
    centres = members.groupBy("group").agg(F.max_by(F.struct("node", "shingles"), order).alias("centre"))
    shared = F.size(F.array_intersect("shingles", "centre.shingles"))
    alike = shared >= similarity * (F.size("shingles") + F.size("centre.shingles") - shared) - 1e-9
    size = F.size("shingles").alias("size")
    judged = stored(members.join(centres, "group").select("group", "node", size, F.col("centre.node").alias("centre"), alike.alias("alike")), "judged")
    direct = judged.where("alike and node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b"))
    blocks = lambda cond: F.ceil((F.sum(F.when(cond, F.col("size"))) + 1) / BLOCK_SHINGLES).cast("int")
    sizes = judged.groupBy("group").agg(blocks(~F.col("alike")).alias("asking"), blocks(F.lit(True)).alias("all")).where("asking is not null")
    sized = members.select("node", "shingles").join(judged.join(sizes, "group").select("group", "node", "alike", "asking", "all"), "node")
    own = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asks = sized.where("not alike").select("group", "node", "shingles", F.lit(True).alias("asks"), own(F.col("asking")).alias("i"), every(F.col("all")).alias("j"))
    answers = sized.select("group", "node", "shingles", F.lit(False).alias("asks"), every(F.col("asking")).alias("i"), own(F.col("all")).alias("j"))

    def run(table):
        asking, node, sets = table["asks"].to_numpy(), table["node"].to_numpy(), table["shingles"].combine_chunks()
        order = np.argsort(~asking, kind="stable")
        order = order[np.sort(np.unique(node[order], return_index=True)[1])]  # who asks is also among the answers
        bounds, values = sets.offsets.to_numpy(), sets.values.to_numpy()
        found = spanning_links(asking[order], near_sets([values[bounds[k] : bounds[k + 1]] for k in order], similarity))
        return _pairs(node[order], found)

    paired = asks.unionByName(answers).repartition("group", "i", "j").groupBy("group", "i", "j")
    return direct.unionByName(paired.applyInArrow(run, "a long, b long"))


def text_code(text_col: str = "text") -> F.Column:
    """A 64-bit hash of the text as it is; with the id it names a row."""
    return F.xxhash64(F.col(text_col).cast("string"))


def similar_texts(docs: DataFrame, shingle: int = SHINGLE_WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``code``, ``rows``, ``first_id`` and ``first_code`` of each distinct (id, ``text_code``) with an id; ids are integers.

    Texts of equal words (A-Z lower-cased) are one node.  Nodes are linked where the Jaccard similarity of their sets of
    ``shingle``-word shingles is at least ``similarity``; ``first_id`` and ``first_code`` name the smallest row of the component.
    Candidates are the components of fingerprints of distinct words that share a pair of Golay keys and differ in at most
    ``CANDIDATE_BITS``; texts without words are copies of each other.  ``rows`` counts the rows of that name.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be of whole numbers")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_code(text_col).alias("code"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    marked = stored(_sketches(rows, shingle), "sketches")
    first = F.min(F.struct("id", "code")).alias("first")
    nodes = marked.groupBy("content").agg(first, *(F.first(c).alias(c) for c in ("words", "shingles", "name"))).withColumn("node", F.monotonically_increasing_id())
    nodes = stored(nodes, "nodes")
    fit = nodes.where("name is not null")
    links = stored(_candidates(stored(fit.select("words", "shingles").distinct(), "marks"), ("words", "shingles"), CANDIDATE_BITS, True).distinct(), "links")
    roots = components(links).withColumnRenamed("node", "name")
    degrees = links.select(F.col("a").alias("name")).unionAll(links.select("b")).groupBy("name").agg(F.count("*").alias("degree"))
    grouped = fit.join(roots, "name", "left").join(degrees, "name", "left").select("node", F.coalesce("root", "name").alias("group"), F.coalesce("degree", F.lit(0)).alias("degree"), "first.id", "first.code")
    grouped = stored(grouped, "groups")
    members = grouped.join(grouped.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group"), "group")
    texts = rows.join(members, ["id", "code"]).select("node", "group", "degree", "text")
    sets = stored(_sets(texts, shingle).dropDuplicates(["node"]), "sets")
    merged = components(_similar(sets, similarity))
    named = nodes.join(merged.withColumnRenamed("node", "at"), F.col("node") == F.col("at"), "left").select("content", "first", F.coalesce("root", "node").alias("root"))
    named = named.join(named.groupBy("root").agg(F.min("first").alias("least")), "root").select("content", "least")
    found = marked.groupBy("content", "id", "code").agg(F.count("*").alias("rows")).join(named, "content")
    return found.select(F.col("id").alias(id_col), "code", "rows", F.col("least.id").alias("first_id"), F.col("least.code").alias("first_code"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_texts(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
