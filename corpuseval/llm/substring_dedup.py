"""Repeated passages: exact word windows found by difference-cover anchors.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  A window is ``WINDOW`` consecutive words of one document; each word
covered by a window whose word sequence also starts in a document with a smaller id is removed.

Anchors: {0, 1, 3} is a difference cover of the residues mod 7, so of any two positions some shift below 7 brings both
to cover positions.  Runs of 7 words are hashed at cover positions only, and two equal windows of 13 words always share
an aligned anchor.  One shuffle finds the anchors that stand in two documents or more.  Extension: every window around
such an anchor gets a 96-bit hash, and a second shuffle finds the smallest document of each; documents are then
cut by the windows that are theirs to lose.  Both passes judge the text as it was read.

Both shuffles deal the hashes by value, packed into rows of many.  What documents of one batch share is settled in that batch,
and only its smallest document goes on, so a passage that a third of all documents hold is a row for each batch in one
task and not one for each document.

A text longer than a slice is worked on alone, runs of its words at a time: what stays in memory are its bytes, and places and hashes of its words.

Null text has no words.  Bytes that are no UTF-8 become U+FFFD.  Ids are whole numbers, others raise.  Rows of a null id neither remove words nor lose any.  Rows that share an id are one document
for the rule, each with its own words.  An empty table gives no rows.  Only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuseval.llm import _text
from corpuseval.llm._session import read_texts, refuse_clash, valid_text

WINDOW = 13
PERIOD = 7
COVER = (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
#: Hashes that are packed together, and bytes of hashes that a task of a shuffle should hold.
_PACK = 400_000
_TASK_BYTES = 32 << 20
_PACKED = "deal int, settled boolean, docs binary, tags binary"


class _Words:
    """Words, rows and hashes of a slice of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        self.starts, self.ends, self.first = _text.words(data, offsets, table)
        self.hashes = _text.word_hashes(data, self.starts, self.ends)
        self.rows = _text.row_of(self.first)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions of anchors that windows can hold, and their hashes; runs of words at a time."""
        places, hashes, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], np.diff(self.first)
        for low in range(0, len(self.hashes) - ANCHOR + 1, _text.RUN):
            run = slice(low, low + _text.RUN + ANCHOR - 1)
            found, rows = _text.window_hashes(self.hashes[run], ANCHOR), self.rows[run]
            own = rows[: len(found)]
            place = (np.arange(low, low + len(found)) - self.first[own]) % PERIOD
            at = np.flatnonzero(_text.inside_rows(rows, ANCHOR) & np.isin(place, COVER) & (sizes[own] >= WINDOW))
            places.append(at + low)
            hashes.append(found[at])
        return np.concatenate(places), np.concatenate(hashes)

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the windows that start at ``at``, which rises; runs of words at a time."""
        first, second = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for low in range(0, len(self.hashes) - WINDOW + 1, _text.RUN):
            own = at[np.searchsorted(at, low) : np.searchsorted(at, low + _text.RUN)] - low
            if len(own):
                hashes = self.hashes[low : low + _text.RUN + WINDOW - 1]
                first.append(_text.window_hashes(hashes, WINDOW)[own])
                second.append(_text.window_hashes(_text.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), WINDOW, 0x9FB21C651E98DF25)[own])
        return np.concatenate(first), np.concatenate(second)


class _Packer:
    """Collects (document, hash) and gives them out as packed rows, settled in part."""

    def __init__(self, deals: int, keep_smallest: bool, pack: int):
        self.deals, self.keep_smallest, self.pack, self.parts, self.n = deals, keep_smallest, pack, [], 0

    def add(self, docs: np.ndarray, low: np.ndarray, high: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        self.parts.append((docs, low, np.zeros(len(low), np.uint64) if high is None else high))
        self.n += len(low)
        if self.n >= self.pack:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        docs, low, high = (np.concatenate([p[k] for p in self.parts]) if self.parts else np.zeros(0, np.int64 if k == 0 else np.uint64) for k in range(3))
        self.parts, self.n = [], 0
        order = np.lexsort((docs, high, low))
        docs, low, high = docs[order], low[order], high[order]
        new_hash = np.ones(len(docs), bool)
        new_hash[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        fresh = new_hash.copy()
        fresh[1:] |= docs[1:] != docs[:-1]
        docs, low, high, new_hash = docs[fresh], low[fresh], high[fresh], new_hash[fresh]
        group = np.cumsum(new_hash) - 1
        settled = ~new_hash if self.keep_smallest else np.bincount(group, minlength=1)[group] > 1 if len(docs) else new_hash
        deal = ((low >> np.uint64(32)) * np.uint64(self.deals) >> np.uint64(32)).astype(np.int64)
        rows = [self._rows(docs[new_hash], low[new_hash], high[new_hash], deal[new_hash], False)]
        if settled.any():
            rows.append(self._rows(docs[settled], low[settled], high[settled], np.full(int(settled.sum()), int(_spread(docs[settled][:1], self.deals)[0])), True))
        return pa.Table.from_batches(rows).combine_chunks().to_batches()[0] if sum(map(len, rows)) else rows[0]

    def _rows(self, docs, low, high, deal, settled) -> pa.RecordBatch:
        order = np.lexsort((docs, deal))
        docs, deal = docs[order], deal[order]
        at = np.concatenate(([0], np.flatnonzero(np.diff(deal)) + 1, [len(deal)])) if len(deal) else np.zeros(1, np.int64)
        wide = self.keep_smallest
        tags = pack(low[order], high[order]) if wide else pack(low[order])
        rows = [deal[at[:-1]], len(at) - 1]
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array([settled] * rows[1], pa.bool_()), slabs(docs.astype("<i8").tobytes(), at * 8), slabs(tags, at * (12 if wide else 6))], names=["deal", "settled", "docs", "tags"])


def pack(low: np.ndarray, high: np.ndarray | None = None) -> bytes:
    """Six bytes of each hash, or twelve of a pair."""
    six = low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6] if high is None else None
    if high is None:
        return np.ascontiguousarray(six).tobytes()
    out = np.empty((len(low), 12), np.uint8)
    out[:, :8] = low.astype("<u8").view(np.uint8).reshape(-1, 8)
    out[:, 8:] = high.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :4]
    return out.tobytes()


def unpack(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The first eight bytes (or six) of each hash, and the four after them (or zero)."""
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    low, high = np.zeros((len(raw), 8), np.uint8), np.zeros((len(raw), 8), np.uint8)
    low[:, : min(8, width)] = raw[:, : min(8, width)]
    high[:, : max(0, width - 8)] = raw[:, 8:]
    return low.view("<u8").ravel(), high.view("<u8").ravel()


def slabs(data: bytes, bounds: np.ndarray) -> pa.Array:
    """A binary column of the parts of ``data``."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(data)])


def _spread(docs: np.ndarray, deals: int) -> np.ndarray:
    return (_text.mix(docs.astype(np.uint64) + np.uint64(1)) % np.uint64(deals)).astype(np.int64)


def _settle(packed: DataFrame, deals: int, width: int, keep_smallest: bool) -> DataFrame:
    """``doc`` and ``tags``: hashes that stand in two documents or more; with ``keep_smallest`` not those of the smallest.

    What is found goes back by document, again packed into rows of many, and is gathered into a row for each document.
    Within one document shorter tags will do: four bytes to look around an anchor, eight to cut.
    """
    back = 8 if keep_smallest else 4

    def by_document(docs: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
        deal = _spread(docs, deals)
        order = np.lexsort((docs, deal))
        docs, deal, low = docs[order], deal[order], low[order]
        at = np.concatenate(([0], np.flatnonzero(np.diff(deal)) + 1, [len(deal)])) if len(deal) else np.zeros(1, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(deal[at[:-1]], pa.int32()), slabs(docs.astype("<i8").tobytes(), at * 8), slabs(low.astype(f"<u{back}").tobytes(), at * back)], names=["deal", "docs", "tags"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, tags, done_docs, done_tags, n = [], [], [], [], 0
        for batch in batches:
            for done, d, t in zip(*(batch.column(c).to_pylist() for c in ("settled", "docs", "tags")), strict=True):
                if not done:
                    docs.append(d)
                    tags.append(t)
                    continue
                done_docs.append(d)
                done_tags.append(t)
                n += len(d) // 8
                if n >= _PACK:
                    yield by_document(np.frombuffer(b"".join(done_docs), "<i8"), unpack(b"".join(done_tags), width)[0])
                    done_docs, done_tags, n = [], [], 0
        found, low, high = np.frombuffer(b"".join(docs), "<i8"), *unpack(b"".join(tags), width)
        del docs, tags
        order = np.lexsort((found, high, low)) if keep_smallest else np.argsort(low, kind="stable")
        found, low, high = found[order], low[order], high[order]
        new = np.ones(len(found) + 1, bool)
        new[1:-1] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        if keep_smallest:
            mine = found > found[np.flatnonzero(new[:-1])][np.cumsum(new[:-1]) - 1] if len(found) else new[:-1]
        else:
            mine = ~(new[:-1] & new[1:])
        yield by_document(np.concatenate([found[mine], np.frombuffer(b"".join(done_docs), "<i8")]), np.concatenate([low[mine], unpack(b"".join(done_tags), width)[0]]))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(d, t) for batch in batches for d, t in zip(*(batch.column(c).to_pylist() for c in ("docs", "tags")), strict=True)]
        docs, low = np.frombuffer(b"".join(d for d, _ in rows), "<i8"), np.frombuffer(b"".join(t for _, t in rows), f"<u{back}")
        del rows
        order = np.argsort(docs, kind="stable")
        docs, low = docs[order], low[order]
        at = np.concatenate(([0], np.flatnonzero(np.diff(docs)) + 1, [len(docs)])) if len(docs) else np.zeros(1, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(docs[at[:-1]], pa.int64()), slabs(low.tobytes(), at * back)], names=["_doc", "_tags"])

    found = packed.repartition(deals, "deal").select("settled", "docs", "tags").mapInArrow(run, "deal int, docs binary, tags binary")
    return found.repartition(deals, "deal").select("docs", "tags").mapInArrow(gather, "_doc long, _tags binary")


def _anchors(texts: DataFrame, deals: int) -> DataFrame:
    size = _PACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, packer = _text.not_space(), _Packer(deals, False, size)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for low, high, data, offsets in _text.slices(batch.column(1)):
                found = _Words(data, offsets, table)
                at, hashes = found.anchors()
                yield from packer.add(ids[low:high][found.rows[at]], hashes)
        yield packer.flush()

    return texts.mapInArrow(run, _PACKED)


def _windows(flagged: DataFrame, deals: int) -> DataFrame:
    """Packed windows of documents around the anchors that others share."""
    size = _PACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, packer = _text.not_space(), _Packer(deals, True, size)
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            for low, high, data, offsets in _text.slices(batch.column(1)):
                found = _Words(data, offsets, table)
                at, hashes = found.anchors()
                hashes &= np.uint64(0xFFFFFFFF)
                shared = np.zeros(len(found.rows) + 1, np.int32)
                bounds = np.searchsorted(at, found.first)
                for k in range(high - low):
                    own = slice(bounds[k], bounds[k + 1])
                    shared[at[own]] = np.isin(hashes[own], np.frombuffer(tags[low + k].as_py(), "<u4"))
                near = np.concatenate((np.zeros(1, np.int32), np.cumsum(shared, dtype=np.int32)))
                fit = _text.inside_rows(found.rows, WINDOW)
                n = len(fit)
                chosen = np.flatnonzero(fit & (near[PERIOD : PERIOD + n] > near[:n]))
                yield from packer.add(ids[low:high][found.rows[chosen]], *found.windows(chosen))
        yield packer.flush()

    return flagged.mapInArrow(run, _PACKED)


def _joined(text: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words of a text at these places, joined by one space; runs of words at a time."""
    step = 1 << 16
    runs = (slice(low, low + step) for low in range(0, len(starts), step))
    return b" ".join(b" ".join([text[a:b] for a, b in zip(starts[r].tolist(), ends[r].tolist(), strict=True)]) for r in runs)


def _cut(flagged: DataFrame, carry: tuple[str, ...], keep_unchanged: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _text.not_space()
        for batch in batches:
            tags, valid = batch.column(2), batch.column(1).is_valid().to_pylist()
            for low, high, data, offsets in _text.slices(batch.column(1)):
                starts, ends, first = _text.words(data, offsets, table)
                counts, kept, removed = np.diff(first), [], []
                own = tags.slice(low, high - low)
                hashes = _text.window_hashes(_text.word_hashes(data, starts, ends), WINDOW) if own.null_count < len(own) else None
                for k, mine in enumerate(own.to_pylist()):
                    text, lost, stay = data[offsets[k] : offsets[k + 1]].tobytes(), 0, np.arange(first[k], first[k + 1], dtype=starts.dtype)
                    if mine:
                        at = hashes[first[k] : max(first[k], first[k + 1] - WINDOW + 1)]
                        gone = _text.cover(np.isin(at, np.frombuffer(mine, "<u8")), WINDOW, len(stay))
                        lost = int(gone.sum())
                        stay = stay[~gone]
                    removed.append(lost)
                    kept.append(_joined(text, starts[stay] - offsets[k], ends[stay] - offsets[k]) if lost or not keep_unchanged else text if valid[low + k] else None)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), *(c.slice(low, high - low) for c in batch.columns[3:])], names=["id", "n_words", "n_removed", "kept", *carry])

    carried = "".join(f", `{c}` {flagged.schema[c].dataType.simpleString()}" for c in carry)
    return flagged.select("_id", "_text", "_tags", *carry).mapInArrow(run, f"id long, n_words long, n_removed long, kept string{carried}")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_unchanged: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``n_words``, ``n_removed`` and ``kept`` (the words that stay, joined by one space) of every row.

    ``keep_unchanged`` leaves texts that lose nothing as they are; the columns ``carry`` come along.
    """
    refuse_clash(carry, {id_col, "id", "n_words", "n_removed", "kept"})
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be of whole numbers")
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), valid_text(text_col).alias("_text"), *carry)
    total = texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    deals = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // _TASK_BYTES + 1)
    named = texts.where("_id is not null")
    anchors = _settle(_anchors(named.select("_id", "_text"), deals), deals, 6, False)
    dealt = named.repartition(deals, "_id")  # one shuffle of the texts serves both joins
    flagged = dealt.select("_id", "_text").join(anchors, F.col("_id") == F.col("_doc")).select("_id", "_text", "_tags")
    windows = _settle(_windows(flagged, deals), deals, 12, True)
    marked = dealt.join(windows, F.col("_id") == F.col("_doc"), "left").select("_id", "_text", "_tags", *carry)
    nameless = texts.where("_id is null").select("_id", "_text", F.lit(None).cast("binary").alias("_tags"), *carry)
    return _cut(marked.unionByName(nameless), carry, keep_unchanged).withColumnRenamed("id", id_col)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(read_texts(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = r"""
with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
starts as (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from w where len(ws) >= 13),
windows as (select doc_id, i, array_to_string(ws[i:i + 12], ' ') as k from starts),
least_doc as (select k, min(doc_id) as d from windows group by k),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as j from windows join least_doc using (k) where d < doc_id),
words as (select doc_id, ws[j] as word, j from (select doc_id, ws, unnest(range(1, len(ws) + 1)) as j from w)),
kept as (select doc_id, string_agg(word, ' ' order by j) as t from words anti join gone using (doc_id, j) group by doc_id),
lost as (select doc_id, count(*) as n from gone group by doc_id)
select doc_id, len(ws)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from w left join lost using (doc_id) left join kept using (doc_id)
"""
