"""Dropping lines that many documents repeat, over levelled sorted runs of line hashes; DataFrame functions only.

The key of a line is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, with A-Z lower-cased.  A key of at least
``MIN_CHARS`` code points that at least ``MIN_DOCS`` documents hold loses its lines in all of them but the one of the largest id,
which keeps all that it has.

``LineRuns`` is an index that batches of documents are added to.  A run is a table of (128-bit hash, documents, largest id), one row
for each key, bucketed and sorted by the hash, so that it is merge-joined in place, without a shuffle.  A new batch is aggregated to
such rows, then anti-joined with each run: a key that a run already shows in enough documents, with an id that is no smaller, is
settled and adds nothing.  What is left becomes a run of level 0.  As soon as a level has ``FAN`` runs they are merged to one of the next
level, so there are at most ``FAN`` times log(batches) runs.  Keys of one line in a third of all documents stop adding rows as soon as
they are settled; before that they are counted by (key, document) first.

``drop_repeated_lines`` adds a table in ``BATCHES`` ranges of falling ids, so that an id that is met first is the largest.  Hashes and
positions of long lines are written once; texts are read for that and once more, when positions to drop are joined to them.

Nulls and empty texts are one empty line.  Rows that share an id are one document.  A row of null id is no document: it counts nowhere and keeps
all of its lines.  Bytes that are no UTF-8 become U+FFFD.  An empty table gives no rows.  All columns are carried along; ``kept``, ``n_lines``
and ``n_dropped`` replace columns of these names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuseval.llm._session import scratch, stored

MIN_CHARS, MIN_DOCS = 40, 5
#: Batches of a table, and runs of a level that are merged.
BATCHES, FAN = 4, 3
#: Frequent keys that are broadcast at most; of more the lines are joined by hash.
BROADCAST_KEYS = 1_000_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
_HASH = ("h", "g")


def line_key(line: F.Column) -> F.Column:
    return F.translate(F.btrim(line, F.lit(_SPACE)), _UPPER, _UPPER.lower())


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``id, code, at, h, g`` of every line with a long key; ``docs`` has ``id``, ``text`` and ``code``."""
    lines = docs.select("id", "code", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    keys = lines.select("id", "code", "at", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keys.select("id", "code", "at", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"))


class LineRuns:
    """The index; batches may come in any order, but no document may come in two of them."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fan: int = FAN):
        self.spark, self.min_docs, self.fan = spark, min_docs, fan
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = [[]]  # name and path of each run

    @property
    def runs(self) -> list[tuple[str, str]]:
        return [run for level in self.levels for run in level]

    def add(self, lines: DataFrame) -> None:
        """A batch of ``id, h, g``."""
        new = lines.groupBy(*_HASH).agg(F.count_distinct("id").alias("docs"), F.max("id").alias("last"))
        for name, _ in self.runs:
            settled = self.spark.table(name).where(F.col("docs") >= self.min_docs).select(*(F.col(c).alias(f"_{c}") for c in (*_HASH, "last")))
            new = new.join(settled, (F.col("h") == F.col("_h")) & (F.col("g") == F.col("_g")) & (F.col("last") <= F.col("_last")), "left_anti")
        self.levels[0].append(self._write(new))
        self._compact()

    def frequent(self) -> DataFrame:
        """``h, g, last`` of the keys in at least ``min_docs`` documents, from all runs."""
        return self._merged(self.runs).where(F.col("docs") >= self.min_docs).drop("docs")

    def forget(self) -> None:
        """Takes the runs out of the catalog; their files stay with the other scratch tables."""
        for name, _ in self.runs:
            self.spark.sql(f"drop table {name}")
        self.levels = [[]]

    def _compact(self) -> None:
        k = 0
        while k < len(self.levels) and len(self.levels[k]) >= self.fan:
            done, self.levels[k] = self.levels[k], []
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(self._write(self._merged(done)))
            for name, _ in done:
                self.spark.sql(f"drop table {name}")
            k += 1

    def _merged(self, runs: list[tuple[str, str]]) -> DataFrame:
        """One row for each key.  Runs are read by path, as plain files: a union of bucketed tables (Spark 4.1.2) is grouped without a shuffle, wrongly."""
        rows = self.spark.read.schema(self.spark.table(runs[0][0]).schema).parquet(*(path for _, path in runs))
        return rows.groupBy(*_HASH).agg(F.sum("docs").alias("docs"), F.max("last").alias("last"))

    def _write(self, rows: DataFrame) -> tuple[str, str]:
        name, path = f"line_run_{uuid.uuid4().hex}", scratch(self.spark, "run")
        rows.write.format("parquet").bucketBy(self.buckets, *_HASH).sortBy(*_HASH).option("path", path).saveAsTable(name)
        return name, path


def _batch(docs: DataFrame, batches: int) -> F.Column:
    """The number of the batch of an id: ranges of falling ids, or by a hash of ids that are no numbers."""
    if not isinstance(docs.schema["id"].dataType, T.NumericType):
        return F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int")
    place = F.col("id").cast("double")
    cuts = docs.agg(F.percentile_approx(place, [k / batches for k in range(1, batches)])).first()[0] or []
    out = F.lit(0)
    for cut in sorted(set(cuts)):
        out = out + F.when(place <= cut, 1).otherwise(0)
    return out.cast("int")


def _without(text: F.Column, drop: F.Column) -> F.Column:
    """The text without the lines at the places ``drop``: a mark is sorted before each of them, in one pass over both."""
    item = lambda at, is_line, line: F.struct(at.cast("int").alias("at"), is_line.alias("is_line"), line.alias("line"))
    lines = F.transform(F.split(text, "\n"), lambda x, k: item(k, F.lit(1), x))
    marks = F.transform(drop, lambda k: item(k, F.lit(0), F.lit("")))
    return F.array_sort(F.concat(lines, marks))


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``kept`` (the text of the lines that stay), ``n_lines`` and ``n_dropped``."""
    spark, added = docs.sparkSession, ("kept", "n_lines", "n_dropped")
    text = F.make_valid_utf8(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    record = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in added))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), record.alias("record")).withColumn("code", F.xxhash64("text"))
    named = rows.where("id is not null")
    lines = hashed_lines(named.select("id", "code", "text"), min_chars).withColumn("batch", _batch(named.select("id"), batches))
    lines.write.partitionBy("batch").parquet(path := scratch(spark, "lines"))
    lines = spark.read.schema(lines.schema).parquet(path)
    index = LineRuns(spark, min_docs)
    for k in range(batches):
        index.add(lines.where(F.col("batch") == k).select("id", *_HASH))
    frequent = stored(index.frequent(), "frequent")
    index.forget()
    hits = lines.join(F.broadcast(frequent) if frequent.count() <= BROADCAST_KEYS else frequent, list(_HASH)).where("id <> last")
    drops = hits.groupBy("id", "code").agg(F.collect_set("at").alias("drop"))
    found = named.join(drops, ["id", "code"], "left").select("record", "text", "drop")
    every = found.unionByName(rows.where("id is null").select("record", "text", F.lit(None).cast("array<int>").alias("drop")))
    marked = every.withColumn("both", F.when(F.col("drop").isNotNull(), _without(F.col("text"), F.col("drop"))))
    stays = lambda x, k: (x["is_line"] == 1) & ((k == 0) | (F.get("both", k - 1)["is_line"] == 1))
    kept = F.when(F.col("both").isNull(), F.col("text")).otherwise(F.array_join(F.transform(F.filter("both", stays), lambda x: x["line"]), "\n"))
    n_dropped = F.coalesce(F.size("drop"), F.lit(0)) if spark.conf.get("spark.sql.legacy.sizeOfNull") == "false" else F.greatest(F.size("drop"), F.lit(0))
    return marked.select("record.*", kept.alias("kept"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = drop_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


#: For texts that are valid UTF-8 and ids that are not null.
OP11_SQL = """
with lines as (select doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as nth from documents),
keyed as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
frequent as (select key, max(doc_id) as last from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
judged as (select k.*, f.key is not null and k.doc_id <> f.last as gone from keyed k left join frequent f on k.key = f.key)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by nth) filter (where not gone), '')) as kept_sha256
from judged group by doc_id, text
"""
