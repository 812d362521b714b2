"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against every training window.

Texts are lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  A window is ``width``
consecutive words of a benchmark item; an item of fewer words, but not none, is one shorter window.  Each
document is scanned once: its windows are hashed, those in the set are compared word by word with the item's
window, and the words inside any true occurrence are hit.

The benchmark's windows are collected only after their size has been counted.  Beyond ``max_windows`` the rows get
numbers and are written once, and hashes of distinct windows are broadcast in place of the windows, in blocks of about ``max_hashes``, each
one scan of the rows.  A scan gives the words of every window whose hash is in the set; these are joined with the
benchmark's windows as texts, which verifies them, and then go back to the rows by number.  Neither windows nor items are broadcast there.
Any size of benchmark gives the same rows, whatever ids repeat or are null.

Null text has no words, and an item of null text no windows.  Items of a null id hit like all others; together they are one
item without a name, null and last among the items found.  Items with equal words each count.  Repeated rows are judged
alike.  Only the columns named are read; carried columns with the name of an added one raise.  Bytes that are no UTF-8 become U+FFFD.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuseval.llm import _text
from corpuseval.llm._session import read_texts, refuse_clash, scratch, stored, valid_text

WIDTH = 10
#: Windows that are broadcast at once: about 200 bytes each.
MAX_WINDOWS = 200_000
#: Hashes that are broadcast at once for larger benchmarks: 8 bytes each.
MAX_HASHES = 4_000_000
_SPANS = "array<struct<first:int,last:int>>"
_FILTER_BITS = 20
_ROW, _FOUND = "__row", "__found"  # columns of a benchmark of several blocks


def normalised_words(column: F.Column) -> F.Column:
    """The words of a text as an array."""
    lower = F.translate(F.coalesce(column, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (``item``, ``window``), a window being its words joined by spaces."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), normalised_words(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - width, F.lit(0)))
    return items.select("item", F.explode(F.transform(starts, lambda k: F.array_join(F.slice("words", k + 1, width), " "))).alias("window")).distinct()


class _Windows:
    """The windows of one block by width and hash."""

    def __init__(self, found: list[tuple[str, str]]):
        self.items = sorted({i for i, _ in found}, key=lambda i: (i is None, i))
        number = {item: k for k, item in enumerate(self.items)}
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray, dict[int, list]]] = {}
        by_width: dict[int, dict[bytes, list[int]]] = {}
        for item, window in found:
            by_width.setdefault(window.count(" ") + 1, {}).setdefault(window.encode(), []).append(number[item])
        table = _text.alphanumeric()
        for width, windows in by_width.items():
            column = pa.array(list(windows), pa.binary())
            data, offsets = _text.buffers(column)
            starts, ends, first = _text.words(data, offsets, table)
            hashes = _text.window_hashes(_text.word_hashes(data, starts, ends), width)[first[:-1]]
            lookup: dict[int, list] = {}
            for value, window in zip(hashes.tolist(), windows, strict=True):
                lookup.setdefault(value, []).append((window, windows[window]))
            bits = np.zeros(1 << _FILTER_BITS, dtype=bool)
            bits[hashes >> np.uint64(64 - _FILTER_BITS)] = True
            self.by_width[width] = np.unique(hashes), bits, lookup

    def scan(self, data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, dict[int, set[int]]]:
        """Which words are hit, and for each row the numbers of the items found."""
        hashes = _text.word_hashes(data, starts, ends)
        hit, items = np.zeros(len(starts), dtype=bool), {}
        row = lambda at: np.searchsorted(first, at, "right") - 1
        for width, (values, bits, lookup) in self.by_width.items():
            for low in range(0, len(hashes) - width + 1, _text.RUN):
                windows = _text.window_hashes(hashes[low : low + _text.RUN + width - 1], width)
                at = np.flatnonzero(bits[windows >> np.uint64(64 - _FILTER_BITS)])
                at = at[values[np.minimum(np.searchsorted(values, windows[at]), len(values) - 1)] == windows[at]]
                at = at[row(at + low) == row(at + low + width - 1)]
                for k in at.tolist():
                    words = b" ".join(data[starts[j] : ends[j]].tobytes() for j in range(low + k, low + k + width))
                    for window, numbers in lookup[int(windows[k])]:
                        if words == window:
                            hit[low + k : low + k + width] = True
                            items.setdefault(int(row(low + k)), set()).update(numbers)
        return hit, items


def _runs(hit: np.ndarray) -> list[dict[str, int]]:
    """First and last word of each run of hit words."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return [{"first": int(a), "last": int(b) - 1} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _without(text: bytes, starts: np.ndarray, ends: np.ndarray, hit: np.ndarray) -> bytes:
    """The text without the hit words and what stands between hit words that follow each other."""
    parts, low = [], 0
    for run in _runs(hit):
        parts.append(text[low : starts[run["first"]]])
        low = int(ends[run["last"]])
    return b"".join([*parts, text[low:]])


def _marked(columns: list[pa.Array], names: list[str], texts: pa.Array, raw: np.ndarray, offsets: np.ndarray, words: tuple, hit: np.ndarray, items: list[list[str]], clean: bool) -> pa.RecordBatch:
    """The rows of a slice with ``n_words``, ``hits``, ``items`` and perhaps ``cleaned``."""
    starts, ends, first = words
    touched = set((np.searchsorted(first, np.flatnonzero(hit), "right") - 1).tolist())
    runs = [_runs(hit[first[k] : first[k + 1]]) if k in touched else [] for k in range(len(texts))]
    spans = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    columns = [*columns, pa.array(np.diff(first), pa.int32()), pa.array(runs, spans), pa.array(items, pa.list_(pa.string()))]
    names = [*names, "n_words", "hits", "items"]
    if clean:
        kept, valid = texts, texts.is_valid().to_pylist()
        if touched:
            whole = [raw[offsets[k] : offsets[k + 1]].tobytes() if valid[k] else None for k in range(len(texts))]
            for k in touched:
                at = slice(first[k], first[k + 1])
                whole[k] = _without(whole[k], starts[at] - offsets[k], ends[at] - offsets[k], hit[at])
            kept = pa.array(whole, pa.binary()).cast(texts.type)
        columns.append(kept)
        names.append("cleaned")
    return pa.RecordBatch.from_arrays(columns, names=names)


def _schema(docs: DataFrame, keys: list[str], clean: bool) -> str:
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return f"{kinds}, n_words int, hits {_SPANS}, items array<string>" + (", cleaned string" if clean else "")


def _scan(docs: DataFrame, shared, keys: list[str], text_col: str, clean: bool) -> DataFrame:
    """Every row marked by the windows that ``shared`` broadcasts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table, lower = shared.value, _text.alphanumeric(), _text.lower_ascii()
        for batch in batches:
            texts = batch.column(len(keys))
            for low, high, raw, offsets in _text.slices(texts):
                data = lower[raw]
                words = _text.words(data, offsets, table)
                hit, items = known.scan(data, offsets, *words)
                found = [[known.items[i] for i in sorted(items.get(k, ()))] for k in range(high - low)]
                yield _marked([c.slice(low, high - low) for c in batch.columns[: len(keys)]], keys, texts.slice(low, high - low), raw, offsets, words, hit, found, clean)

    return docs.select(*keys, valid_text(text_col)).mapInArrow(run, _schema(docs, keys, clean))


def _hashed(windows: DataFrame) -> DataFrame:
    """``window``, its number of words ``width``, and its ``hash``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _text.alphanumeric()
        for batch in batches:
            for low, high, data, offsets in _text.slices(batch.column(0)):
                starts, ends, first = _text.words(data, offsets, table)
                hashes, widths = _text.word_hashes(data, starts, ends), np.diff(first)
                found = np.zeros(high - low, np.uint64)
                for width in np.unique(widths):
                    of = np.flatnonzero(widths == width)
                    found[of] = _text.window_hashes(hashes, int(width))[first[of]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(widths.astype(np.int32)), pa.array(found.view(np.int64))], names=["window", "width", "hash"])

    return windows.mapInArrow(run, "window string, width int, hash long")


def _scan_blocks(rows: DataFrame, windows: DataFrame, blocks: int, text_col: str) -> DataFrame:
    """``_ROW``, ``first`` and ``last`` word, and ``window`` of every window of the rows whose hash a benchmark window has."""
    spark, path = rows.sparkSession, scratch(rows.sparkSession, "marks")
    hashed = stored(_hashed(windows).select("width", "hash").distinct().withColumn("block", F.pmod(F.xxhash64("hash"), F.lit(blocks))), "hashes")
    schema = f"{_ROW} long, first int, last int, window string"
    for k in range(blocks):
        block = hashed.where(F.col("block") == k).select("width", "hash").toPandas()
        by_width = {int(w): np.sort(own.to_numpy(np.int64).view(np.uint64)) for w, own in block.groupby("width")["hash"]}
        shared = spark.sparkContext.broadcast(by_width)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known, table, lower = shared.value, _text.alphanumeric(), _text.lower_ascii()
            for batch in batches:
                numbers = batch.column(0).to_numpy(zero_copy_only=False)
                for low, high, raw, offsets in _text.slices(batch.column(1)):
                    data = lower[raw]
                    starts, ends, first = _text.words(data, offsets, table)
                    hashes = _text.word_hashes(data, starts, ends)
                    for width, values in known.items():
                        for at in range(0, len(hashes) - width + 1, _text.RUN):
                            windows = _text.window_hashes(hashes[at : at + _text.RUN + width - 1], width)
                            hits = np.flatnonzero(values[np.minimum(np.searchsorted(values, windows), len(values) - 1)] == windows) + at
                            row = np.searchsorted(first, hits, "right") - 1
                            inside = hits + width <= first[row + 1]
                            hits, row = hits[inside], row[inside]
                            words = [b" ".join(data[starts[j] : ends[j]].tobytes() for j in range(h, h + width)).decode() for h in hits.tolist()]
                            own = (hits - first[row]).astype(np.int32)
                            yield pa.RecordBatch.from_arrays([pa.array(numbers[low:high][row]), pa.array(own), pa.array(own + np.int32(width - 1)), pa.array(words, pa.string())], names=[_ROW, "first", "last", "window"])

        rows.select(_ROW, valid_text(text_col)).mapInArrow(run, schema).write.mode("append").parquet(path)
        shared.destroy()
    return spark.read.schema(schema).parquet(path)


def _join_marks(rows: DataFrame, keys: list[str], text_col: str, clean: bool) -> DataFrame:
    """Every row marked by the spans ``_FOUND`` of all blocks and its ``items``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, lower = _text.alphanumeric(), _text.lower_ascii()
        for batch in batches:
            texts, found, items = batch.columns[len(keys) :]
            for low, high, raw, offsets in _text.slices(texts):
                words = _text.words(lower[raw], offsets, table)
                hit = np.zeros(len(words[0]), dtype=bool)
                for k, spans in enumerate(found.slice(low, high - low).to_pylist()):
                    for span in spans:
                        hit[words[2][k] + span["first"] : words[2][k] + span["last"] + 1] = True
                yield _marked([c.slice(low, high - low) for c in batch.columns[: len(keys)]], keys, texts.slice(low, high - low), raw, offsets, words, hit, items.slice(low, high - low).to_pylist(), clean)

    return rows.select(*keys, valid_text(text_col), _FOUND, "items").mapInArrow(run, _schema(rows, keys, clean))


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", clean: bool = False, max_windows: int = MAX_WINDOWS, max_hashes: int = MAX_HASHES, carry: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``n_words``, ``hits`` (runs of hit words: first and last word, from 0) and ``items`` (found item ids, sorted).

    ``clean`` adds ``cleaned``, the text without the hit words; ``carry`` names columns that are passed on.
    """
    refuse_clash(carry, {id_col, text_col, "n_words", "hits", "items", "cleaned", _ROW, _FOUND})
    spark, keys = docs.sparkSession, [id_col, *carry]
    windows = benchmark_windows(benchmark, width, item_col, item_text_col)
    if windows.count() <= max_windows:
        return _scan(docs, spark.sparkContext.broadcast(_Windows([tuple(r) for r in windows.collect()])), keys, text_col, clean)
    whole = stored(windows.select("window").distinct().withColumn("number", F.monotonically_increasing_id()), "windows")
    items = stored(windows.join(whole, "window").select("number", F.struct("item").alias("name")), "items")
    blocks = -(-whole.count() // max_hashes)
    rows = stored(docs.select(*keys, text_col).withColumn(_ROW, F.monotonically_increasing_id()), "rows")
    marks = stored(_scan_blocks(rows, whole.select("window"), blocks, text_col).join(whole, "window").select(_ROW, "first", "last", "number"), "found")
    spans = marks.groupBy(_ROW).agg(F.collect_set(F.struct("first", "last")).alias(_FOUND))
    named = marks.select(_ROW, "number").distinct().join(items, "number")
    named = named.groupBy(_ROW).agg(F.array_sort(F.transform(F.collect_set("name"), lambda n: n["item"])).alias("items"))
    found = rows.join(spans.join(named, _ROW), _ROW, "left")
    return _join_marks(found.withColumn(_FOUND, F.coalesce(_FOUND, F.array().cast(_SPANS))).withColumn("items", F.coalesce("items", F.array().cast("array<string>"))), keys, text_col, clean)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(read_texts(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, run: n + run["last"] - run["first"] + 1)
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def _words_sql(table: str, key: str) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"select {key} as id, list_filter(regexp_split_to_array({lower}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as ws from {table}"


OP8_SQL = f"""
with d as ({_words_sql("documents", "doc_id")}), b as ({_words_sql("benchmark", "item_id")}),
items as (select distinct id as item, least(10, len(ws)) as size, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') as k from (select id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) as i from b where len(ws) > 0)),
sizes as (select distinct size from items),
windows as (select id, i, size, array_to_string(ws[i:i + size - 1], ' ') as k from (select id, ws, size, unnest(range(1, len(ws) - size + 2)) as i from d cross join sizes where len(ws) >= size)),
found as (select windows.id, windows.i, windows.size, items.item from windows join items on items.size = windows.size and items.k = windows.k),
hit as (select id, count(distinct j) as n from (select id, unnest(range(i, i + size)) as j from found) group by id),
named as (select id, count(*) as n, string_agg(name, ',' order by name) as names from (select distinct id, cast(item as varchar) as name from found) group by id)
select d.id as doc_id, len(ws)::bigint as n_words, coalesce(hit.n, 0)::bigint as n_hit, coalesce(named.n, 0)::bigint as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(hit.n, 0) > 0 as contaminated
from d left join hit on hit.id = d.id left join named on named.id = d.id
"""
