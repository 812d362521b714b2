"""Hard negatives of anchors, by score bounds along a spanning tree of the anchors.

Vectors become whole numbers, floor(``SCALE`` * value), and a score is the inner product with the anchor: exact, since values are held within
+-sqrt(2^53 / length).  An anchor's positives are its ``POSITIVES`` best other rows of the same label; for each positive the
``NEGATIVES`` best rows of other labels are returned whose score lies within ``LOW`` to ``HIGH`` per cent of the positive's.

Anchors are ordered by label and place along a seeded direction and dealt to blocks of ``BLOCK``.  A block is joined to a
minimum spanning tree of distances and broadcast, and all rows are scanned where they lie, a run of them at a time: the root is scored for every row; for
a child c of parent p, |c.y - p.y| <= |c - p| |y|, so bounds of the parent's score give bounds of the child's.  Only rows whose bounds meet
the child's window are scored for it and become exact bounds again; a window's lower end rises to the worst score that is still among
the best.  The same scan finds positives first (all scores are their window) and negatives after.  A task keeps the best of each window, and the
best of all tasks are ranked last.

Rows of a null id or label, and vectors that are null, empty, of null or non-finite values, or of another length than most, take
no part.  Rows that share an id are one row, that of the smallest label, then vector.  Ties go to the smaller id.  An anchor
without other rows of its label, and one whose windows are empty (a positive below zero), gives no rows; so does an empty table.  Only the
columns named are read.  Ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuseval.llm._session import scratch, spread, stored
from corpuseval.llm._vectors import matrix, scaled, sound, usual_length
from corpuseval.operators.reshape import number_rows

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 10, 30, 90
#: Anchors of a block, which is broadcast, and rows that are bounded at once inside a task.
BLOCK, STEP = 1_024, 2_048

#: A window of an anchor: the positive that it belongs to, its least and its greatest score.
Wanted = tuple[int, float, float]


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the points with parents first, the parent of each point (-1 for the first), and its distance to it."""
    n = len(points)
    parent, edge = np.full(n, -1), np.zeros(n)
    order, nearest, open_ = [0], np.full(n, np.inf), np.ones(n, bool)
    open_[0] = False
    while len(order) < n:
        last = order[-1]
        far = np.sqrt(((points - points[last]) ** 2).sum(axis=1))
        closer = open_ & (far < nearest)
        nearest[closer], parent[closer] = far[closer], last
        nxt = int(np.where(open_, nearest, np.inf).argmin())
        edge[nxt], open_[nxt] = nearest[nxt], False
        order.append(nxt)
    return np.array(order), parent, edge


@dataclass(frozen=True)
class Block:
    """Anchors of a block, their tree, and what is wanted of each."""

    ids: np.ndarray
    labels: list
    points: np.ndarray
    order: np.ndarray
    parent: np.ndarray
    edge: np.ndarray
    windows: list[list[Wanted]]
    same_label: bool
    k: int


class Best:
    """The ``k`` best (score, id) of a window."""

    def __init__(self, wanted: Wanted, k: int):
        self.positive, self.low, self.high = wanted
        self.k, self.scores, self.ids = k, np.zeros(0), np.zeros(0, np.int64)

    @property
    def floor(self) -> float:
        return max(self.low, self.scores[-1]) if len(self.scores) == self.k else self.low

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        fit = (scores >= self.floor) & (scores <= self.high)
        if fit.any():
            s, i = np.concatenate([self.scores, scores[fit]]), np.concatenate([self.ids, ids[fit]])
            first = np.lexsort((i, -s))[: self.k]
            self.scores, self.ids = s[first], i[first]


def scan(block: Block, best: list[list[Best]], ids: np.ndarray, labels: np.ndarray, y: np.ndarray) -> int:
    """Adds a run of rows to the best of each window; labels are places in the block's list of labels.  Returns how many scores it took."""
    codes = {label: k for k, label in enumerate(dict.fromkeys(block.labels))}
    norms, taken = np.sqrt((y * y).sum(axis=1)), 0
    low, high = np.empty((2, len(block.ids), len(y)))
    for a in block.order:
        p = block.parent[a]
        if p < 0:
            low[a] = high[a] = y @ block.points[a]
            taken += len(y)
        else:
            reach = block.edge[a] * norms * (1 + 1e-9) + 1e-3  # scores are whole numbers, distances are rounded
            low[a], high[a] = low[p] - reach, high[p] + reach
        if not best[a]:
            continue
        fits = labels == codes[block.labels[a]]
        fits = fits & (ids != block.ids[a]) if block.same_label else ~fits
        least, most = min(b.floor for b in best[a]), max(b.high for b in best[a])
        rows = np.flatnonzero(fits & (high[a] >= least) & (low[a] <= most))
        if p >= 0 and len(rows):
            low[a, rows] = high[a, rows] = y[rows] @ block.points[a]
            taken += len(rows)
        for b in best[a]:
            b.add(low[a, rows], ids[rows])
    return taken


def _scanned(rows: DataFrame, block: Block) -> DataFrame:
    """``anchor_id, positive_id, id, score``: the best of every window, ranked over all tasks; ``rank`` from 1."""
    shared, length = rows.sparkSession.sparkContext.broadcast(block), block.points.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        best = [[Best(w, known.k) for w in windows] for windows in known.windows]
        values = list(dict.fromkeys(known.labels))
        for batch in batches:
            for start in range(0, len(batch), STEP):
                part = batch.slice(start, STEP)
                label = part.column("label")
                codes = pc.fill_null(pc.index_in(label, value_set=pa.array(values, label.type)), -1).to_numpy(zero_copy_only=False)
                scan(known, best, part.column("id").to_numpy(zero_copy_only=False), codes, matrix(part.column("x"), length).astype(np.float64))
        every = [(int(known.ids[a]), b.positive, i, s) for a, found in enumerate(best) for b in found for i, s in zip(b.ids.tolist(), b.scores.tolist(), strict=True)]
        for start in range(0, len(every), 10_000):
            columns = zip(*every[start : start + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([int(v) for v in c], pa.int64()) for c in columns], names=["anchor_id", "positive_id", "id", "score"])

    found = rows.select("id", "label", "x").mapInArrow(run, "anchor_id long, positive_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= block.k)


def prepared(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, int]:
    """Written ``id, label, x`` of the rows that take part, and the length of ``x``."""
    if not isinstance(vectors.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be of whole numbers")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & sound(F.col("v")))
    length = usual_length(rows, "v")
    bound = int(np.sqrt(2**53 / max(length, 1)))
    rows = rows.where(F.size("v") == length).select("id", "label", scaled(F.col("v"), SCALE, bound).alias("x"))
    once = rows.groupBy("id").agg(F.min(F.struct("label", "x")).alias("row"))
    return stored(once.select("id", "row.label", "row.x"), "vectors"), length


def hard_negatives(vectors: DataFrame, is_anchor: F.Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", seed: int = 42, block: int = BLOCK) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``; ``is_anchor`` is a condition on ``id``."""
    spark = vectors.sparkSession
    rows, length = prepared(vectors, id_col, vector_col, label_col)
    direction = np.random.default_rng(seed).standard_normal(length).tolist()
    place = F.aggregate(F.zip_with("x", F.array(*map(F.lit, direction)) if direction else F.array().cast("array<double>"), lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)
    anchors = rows.where(is_anchor).withColumn("place", place)
    numbered = stored(number_rows(anchors, "label", "place", "id").withColumn("block", F.floor((F.col("row_no") - 1) / block)), "anchors")
    blocks, rows, path = (numbered.agg(F.max("block")).first()[0] or 0) + 1, spread(rows), scratch(spark, "negatives")
    columns = [F.col("anchor_id"), F.col("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score")]
    schema = "anchor_id long, positive_id long, rank int, negative_id long, negative_score long, positive_score long"
    for k in range(blocks):
        own = numbered.where(F.col("block") == k).orderBy("row_no").select("id", "label", "x").collect()
        if not own:
            continue
        ids, labels, points = np.array([r["id"] for r in own]), [r["label"] for r in own], np.array([r["x"] for r in own], dtype=np.float64)
        tree = spanning_tree(points)
        best = _scanned(rows.where(F.col("label").isin(list(dict.fromkeys(labels)))), Block(ids, labels, points, *tree, [[(-1, -np.inf, np.inf)]] * len(ids), True, positives))
        scores = {(r["anchor_id"], r["id"]): r["score"] for r in best.collect()}  # at most ``positives`` for each anchor of the block
        wanted: dict[int, list[Wanted]] = {}
        for (a, positive), score in scores.items():
            if score >= 0:
                wanted.setdefault(a, []).append((positive, -(-low * score // 100), high * score // 100))
        found = _scanned(rows, Block(ids, labels, points, *tree, [wanted.get(int(a), []) for a in ids], False, negatives)).select(*columns)
        known = spark.createDataFrame([(a, p, s) for (a, p), s in scores.items()], "anchor_id long, positive_id long, positive_score long")
        found.join(F.broadcast(known), ["anchor_id", "positive_id"]).write.mode("append").parquet(path)
    done = spark.read.schema(schema).parquet(path) if blocks and numbered.take(1) else spark.createDataFrame([], schema)
    return done.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(moved, F.col("id") % 100 == 0)


#: For vectors of one length without null or non-finite components and with different ids.
OP13_SQL = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda c: floor(256 * cast(c as double))) as x from embeddings where label is not null and embedding is not null),
scored as (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, cast(list_dot_product(a.x, b.x) as bigint) as score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
positives as (select anchor_id, id as positive_id, score as positive_score from scored where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select p.anchor_id, p.positive_id, cast(row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.id) as int) as rank, s.id as negative_id, p.positive_score, s.score as negative_score
from positives p join scored s on p.anchor_id = s.anchor_id and not s.same and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score
qualify rank <= 10
"""
