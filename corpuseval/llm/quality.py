"""Text quality by kernel ridge regression on document statistics.

Each whole text is reduced to a few statistics (shares of kinds of characters, word and line shapes, repetition).
Random Fourier features of the standardised statistics approximate a Gaussian kernel; each task sums the normal equations
of its labelled rows, the sums are added in two rounds, and the ridge weights follow from one small system.  Raw
predictions of rows kept out of the fit are calibrated by isotonic regression on binned counts, which gives a probability.

Null and empty texts have the statistics of no text and get a score like any other.  Rows without a label do not
teach; without both labels every score is the share of label 1, or 0.5.  Labels that repeat for an id count as often as they
are there.  Repeated rows are scored alike; labels, sources and ids are never inputs; only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuseval.llm import _text
from corpuseval.llm._session import read_texts, refuse_clash, stored

FEATURES = 192
WIDTH = 2.5  # of the kernel, in standard deviations
RIDGE = 1e-3  # for each row
BINS = 500
THRESHOLD = 0.7
#: Of 10 parts of the labelled rows, those that calibrate.
CALIBRATE = 3
_GROUPS = 32
_CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".,;:'\"-()?", b"!", b"|", b"*#$%&@^~=_+<>/\\[]{}`")
STATISTICS = len(_CLASSES) + 8


def _class_tables() -> np.ndarray:
    out = np.zeros((len(_CLASSES), 256), dtype=bool)
    for k, chars in enumerate(_CLASSES):
        out[k, list(chars)] = True
    return out


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    if len(values) > _text.RUN:
        return np.array([values[a:b].sum(dtype=np.int64) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], dtype=np.int64)
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _again(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each row how many of its words stand in it before."""
    if len(first) == 2:
        found = np.sort(hashes)
        return np.array([np.count_nonzero(found[1:] == found[:-1])])
    rows = _text.row_of(first)
    order = np.lexsort((hashes, rows))
    found, of = hashes[order], rows[order]
    return np.bincount(of[1:][(found[1:] == found[:-1]) & (of[1:] == of[:-1])], minlength=len(first) - 1)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of statistics for each text of a slice; shares are square roots, sizes logarithms."""
    size = np.diff(offsets)
    counts = [_sums(table[data], offsets) for table in _class_tables()]
    starts, ends, first = _text.words(data, offsets, _text.not_space())
    words = np.diff(first)
    lengths = ends - starts
    last = data[ends - 1] if len(ends) else data[:0]
    letters = np.zeros(256, bool)
    letters[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
    odd = np.zeros(256, bool)
    odd[list(_CLASSES[-1])] = True
    hashes = _text.word_hashes(data, starts, ends)
    again = _again(hashes, first)
    share = lambda x, n: np.sqrt(x / np.maximum(n, 1))
    word_total = _sums(lengths, first)
    word_square = _sums(lengths.astype(np.int64) ** 2, first)
    mean = word_total / np.maximum(words, 1)
    lines = counts[3] + 1
    columns = [
        *(share(c, size) for c in counts),
        np.log1p(size) / 4,
        np.log1p(mean),
        np.log1p(np.sqrt(np.maximum(0, word_square / np.maximum(words, 1) - mean**2))),
        share(_sums(odd[last], first), words),
        share(_sums(~letters[last], first), words),
        share(_sums(lengths == 1, first), words),
        share(again, words),
        np.log1p(words / lines) / 2,
    ]
    return np.stack(columns, axis=1).astype(np.float64)


def _statistics_of(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in _text.slices(batch.column(len(keep))):
                found = statistics(data, offsets)
                yield pa.RecordBatch.from_arrays([*(c.slice(low, high - low) for c in batch.columns[: len(keep)]), _rows(found)], names=[*keep, "stats"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*keep, F.col(text_col).cast("string")).mapInArrow(run, f"{kinds}stats array<double>")


def _rows(matrix: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]), pa.array(matrix.ravel()))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


class Model:
    """Scaling, features, weights and calibration."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int, features: int = FEATURES, width: float = WIDTH):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1)
        self.directions = rng.normal(size=(len(mean), features)) / width
        self.phases = rng.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.knots, self.values = np.array([0.0]), np.array([0.5])

    def features(self, stats: np.ndarray) -> np.ndarray:
        scaled = np.clip((stats - self.mean) / self.spread, -8, 8)
        waves = np.cos(scaled @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.concatenate([waves, np.ones((len(stats), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.values), 0, 1)


def isotonic(positive: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Non-decreasing fit to shares of ordered bins, weighted by their totals (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for p, n in zip(positive.tolist(), total.tolist(), strict=True):
        blocks.append([p, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p2, n2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + p2, blocks[-1][1] + n2, blocks[-1][2] + k2]
    return np.concatenate([np.full(int(k), p / n) for p, n, k in blocks]) if blocks else np.zeros(0)


def _normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, int]:
    """Sum over all rows of z z' with z = (features, 1, label), added in each task, then in groups of tasks."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    size = len(model.weights) + 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total, n = shared.value, np.zeros((size, size)), 0
        for batch in batches:
            if len(batch):
                z = np.concatenate([known.features(_matrix(batch.column(1), STATISTICS)), np.asarray(batch.column(0), dtype=np.float64)[:, None]], axis=1)
                total += z.T @ z
                n += len(batch)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["sums", "n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((size, size)), 0
        for batch in batches:
            for sums, k in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                total += np.frombuffer(sums.as_py(), np.float64).reshape(size, size)
                n += k
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["sums", "n"])

    parts = rows.select("label", "stats").mapInArrow(add, "sums binary, n long")
    merged = parts.repartition(_GROUPS).mapInArrow(merge, "sums binary, n long").collect()
    return sum((np.frombuffer(r[0], np.float64).reshape(size, size) for r in merged), np.zeros((size, size))), sum(r[1] for r in merged)


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "quality", id_col: str = "doc_id", seed: int = 42) -> Model:
    """A model of all documents that ``labels`` (id, 0 or 1) marks; the id also parts fit and calibration.

    Only statistics are joined with labels, never texts.
    """
    marks = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    stats = _statistics_of(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), ["id"], "text")
    part = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(10)).alias("part")
    rows = stored(stats.join(marks, "id").select("label", part, "stats"), "statistics")
    moments = [f(F.col("stats")[k]) for f in (F.avg, F.stddev_pop) for k in range(STATISTICS)]
    n, ones, *found = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0)), *moments).first()
    if not n:
        return Model(np.zeros(STATISTICS), np.ones(STATISTICS), seed)
    model = Model(np.array(found[:STATISTICS]), np.array(found[STATISTICS:]), seed)
    model.values = np.array([ones / n])
    if ones in (0, n):
        return model
    sums, n_fit = _normal_equations(rows.where(F.col("part") >= CALIBRATE), model)
    if not n_fit:
        return model
    model.weights = np.linalg.solve(sums[:-1, :-1] + RIDGE * n_fit * np.eye(len(sums) - 1), sums[:-1, -1])
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = shared.value.raw(_matrix(batch.column(1), STATISTICS)) if len(batch) else np.zeros(0)
            bins = np.clip(np.floor((raw + 0.5) * BINS / 2), 0, BINS - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bins.astype(np.int32))], names=["label", "bin"])

    kept_out = rows.where(F.col("part") < CALIBRATE).select("label", "stats").mapInArrow(predict, "label int, bin int")
    bins = kept_out.groupBy("bin").agg(F.sum("label"), F.count("*")).orderBy("bin").collect()
    if bins:
        at, positive, total = (np.array(x, dtype=np.float64) for x in zip(*bins, strict=True))
        model.knots, model.values = (at + 0.5) * 2 / BINS - 0.5, isotonic(positive, total)
    return model


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """The columns ``keep``, and the text if asked for, with ``score`` (0 to 1) and ``predicted`` (1 from ``THRESHOLD`` on)."""
    refuse_clash(keep, {text_col, "score", "predicted"})
    sent, names = len(keep) + 1, [*keep, *([text_col] if keep_text else [])]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in _text.slices(batch.column(sent - 1)):
                yield pa.RecordBatch.from_arrays([*(c.slice(low, high - low) for c in batch.columns[: len(names)]), pa.array(shared.value.score(statistics(data, offsets)))], names=[*names, "score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    scored = docs.select(*keep, F.col(text_col).cast("string")).mapInArrow(run, f"{kinds}, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def learnt_fold(id_col: str = "doc_id") -> F.Column:
    """Rows that may teach: crc32 of the id as text, mod 4, is not 2."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 != 2


def train_on_tables(spark: SparkSession, sf_dir: str) -> Model:
    """A model of the labelled documents of the folds that may teach."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").where(learnt_fold())
    docs = read_texts(spark, sf_dir).where(learnt_fold())
    return train(docs, labels)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_texts(spark, sf_dir).withColumn("held_out", ~learnt_fold())
    return score(docs, train_on_tables(spark, sf_dir), ("doc_id", "held_out"))
