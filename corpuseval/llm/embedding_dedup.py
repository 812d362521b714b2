"""Near-duplicate embeddings by an exact metric range join over pivot cells.

On unit vectors cosine >= c is distance <= r = sqrt(2 - 2c).  Labels of many vectors get pivots of their own, a bounded seeded
sample; a vector's home is the cell of its nearest pivot p.  Of two linked vectors of different homes one visits the other's
cell, the one of the lower cell the higher, so each pair meets once.  A vector x visits cell q only if all of these hold, each
a consequence of the triangle inequality for any y of that cell within r of x:

* d(x, q) <= d(x, p) + 2r, since q is the nearest pivot of y;
* d(x, q) <= R + r, where R is the greatest distance of the cell's own vectors to q;
* (d(x, q)^2 - d(x, s)^2) / (2 d(q, s)) <= r for other pivots s, the distance of x to the bisector that y lies behind.

How many pivots a label gets follows from the visits that a sample shows: more pivots mean fewer comparisons but more visits;
where pivots keep almost nothing apart the label is one cell.  Cells are cut into blocks of at most ``BLOCK`` rows, each pair of
blocks a group of its own, so a hot cell spreads over tasks with nothing dropped.  Within a group rows are sorted by their
distance to the pivot, and tiles whose distances differ by more than r are skipped.

A group counts links by matrix products in double precision and keeps a spanning forest of them for each tile; pairs are never
written out.  Equal vectors are one node with a multiplicity.

A vector that is null, empty, zero, or holds null or non-finite components links with nothing, as does one of null label
or null id, and none links across labels or lengths.  Rows that share an id are one node of the links.  Rows keep their
number; an empty table gives no rows; only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuseval.llm._components import components
from corpuseval.llm._session import spread, stored

COSINE = 0.98
#: Vectors of a label for each pivot, at least; a label of fewer vectors is one cell.
PER_PIVOT = 2_048
#: Labels with pivots, the most pivots of one, and values of all sampled vectors: these are all that is collected and broadcast.
MAX_LABELS, MAX_PIVOTS, SAMPLE_VALUES = 1_024, 256, 1_000_000
#: Cells whose sizes are broadcast.
MAX_CELLS = 100_000
#: Rows of a group's side, and of a tile.
BLOCK, TILE = 8_192, 1_024
#: Comparisons that cost as much as a row that is moved.
ROW_COST = 1_000
_SLACK = 1e-6  # distances are rounded; cells get a little more than they need
_NEAREST = 8  # pivots whose bisectors are tried

Key = tuple  # (label, length)


def distances(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * units @ pivots.T))


def visits(far: np.ndarray, between: np.ndarray, reach: np.ndarray, radius: float) -> np.ndarray:
    """Which later cells each vector visits: distances to the pivots, distances between these, the cells' own radii."""
    home = far.argmin(axis=1)
    nearest = far[np.arange(len(far)), home][:, None]
    out = (far <= nearest + 2 * radius + _SLACK) & (far <= reach + radius + _SLACK) & (np.arange(far.shape[1]) > home[:, None])
    for k in np.argsort(far, axis=1)[:, :_NEAREST].T:
        apart = between[k]
        out &= far**2 - np.take_along_axis(far, k[:, None], 1) ** 2 <= 2 * apart * radius + _SLACK
    return out


def choose(sample: np.ndarray, n: int, radius: float) -> np.ndarray:
    """Pivots of a label of ``n`` vectors from its sample: as many as cost least, or none if they keep nothing apart."""
    fewest, options = -(-n // PER_PIVOT), []
    for k in (fewest, 2 * fewest, 4 * fewest):
        k = min(k, MAX_PIVOTS, len(sample) // 2)
        if k < 2:
            continue
        pivots, others = sample[:k], sample[k:]
        far = distances(others, pivots)
        reach = np.zeros(k)
        np.maximum.at(reach, far.argmin(axis=1), far.min(axis=1))
        copies = 1 + visits(far, distances(pivots, pivots), reach, radius).sum(axis=1).mean()
        if copies - 1 < 0.9 * (k - 1) / 2:
            options.append((copies * (ROW_COST + n / k), k))
    return sample[: min(options)[1]] if options else sample[:0]


def units(packed: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors in double precision of packed vectors of one length."""
    found = np.frombuffer(b"".join(packed), kind).astype(np.float64).reshape(len(packed), -1)
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def _packed_kind(vectors: DataFrame) -> str:
    """The type that vectors travel in: floats as they are, all else as doubles."""
    return "<f4" if vectors.schema["embedding"].dataType.elementType == T.FloatType() else "<f8"


def _homes(nodes: DataFrame, pivots: dict[Key, np.ndarray]) -> DataFrame:
    """Each node's packed vector, home cell and distance to its pivot; where there are no pivots the home is 0."""
    shared, dtype = nodes.sparkSession.sparkContext.broadcast(pivots), _packed_kind(nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for low in range(0, len(batch), 2000):
                part = batch.slice(low, 2000)
                packed, labels = [np.array(x, dtype).tobytes() for x in part.column("embedding").to_pylist()], part.column("label").to_pylist()
                lengths = [len(x) // np.dtype(dtype).itemsize for x in packed]
                home, far = np.zeros(len(packed), np.int32), np.zeros(len(packed))
                groups: dict[Key, list[int]] = {}
                for k, key in enumerate(zip(labels, lengths, strict=True)):
                    if key in known:
                        groups.setdefault(key, []).append(k)
                for key, rows in groups.items():
                    d = distances(units([packed[k] for k in rows], dtype), known[key])
                    home[rows], far[rows] = d.argmin(axis=1), d.min(axis=1)
                columns = [*(part.column(c) for c in ("node", "label", "n")), pa.array(packed, pa.binary()), pa.array(lengths, pa.int32()), pa.array(home), pa.array(far)]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "label", "n", "packed", "length", "cell", "far"])

    kind = nodes.schema["label"].dataType.simpleString()
    return nodes.select("node", "label", "n", "embedding").mapInArrow(run, f"node long, label {kind}, n long, packed binary, length int, cell int, far double")


def _visitors(homes: DataFrame, dtype: str, pivots: dict[Key, np.ndarray], reach: dict[Key, np.ndarray], radius: float) -> DataFrame:
    """A row for each node and later cell that it visits, ``far`` its distance to that cell's pivot."""
    shared = homes.sparkSession.sparkContext.broadcast((pivots, {k: distances(p, p) for k, p in pivots.items()}, reach))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, between, radii = shared.value
        for batch in batches:
            groups: dict[Key, list[int]] = {}
            for k, key in enumerate(zip(batch.column("label").to_pylist(), batch.column("length").to_pylist(), strict=True)):
                if key in known:
                    groups.setdefault(key, []).append(k)
            packed = batch.column("packed")
            for key, every in groups.items():
                for low in range(0, len(every), 2000):
                    rows = np.array(every[low : low + 2000])
                    far = distances(units([packed[int(k)].as_py() for k in rows], dtype), known[key])
                    i, j = np.nonzero(visits(far, between[key], radii[key], radius))
                    take = pa.array(rows[i])
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("node", "label", "n", "packed", "length")), pa.array(j.astype(np.int32)), pa.array(far[i, j])], names=["node", "label", "n", "packed", "length", "cell", "far"])

    return homes.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in homes.schema))


def spanning_links(near: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a link matrix that connect whatever its links connect."""
    rows, columns, turned, out = np.ones(near.shape[0], bool), np.ones(near.shape[1], bool), near.T.copy(), []
    for start in np.flatnonzero(near.any(axis=1)):
        if not rows[start]:
            continue
        rows[start], queue = False, [(True, start)]
        while queue:
            is_row, k = queue.pop()
            fresh = np.flatnonzero(near[k] & columns if is_row else turned[k] & rows)
            (columns if is_row else rows)[fresh] = False
            out += [(k, x) if is_row else (x, k) for x in fresh]
            queue += [(not is_row, x) for x in fresh]
    return out


def _group(cosine: float, dtype: str):
    radius = float(np.sqrt(2 - 2 * cosine))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = {"node": [np.zeros(0, np.int64)], "to": [np.zeros(0, np.int64)], "links": [np.zeros(0, np.int64)]}

        def put(node, to, links):
            for k, v in zip(out, (node, to, links), strict=True):
                out[k].append(np.asarray(v, np.int64))

        def compare(a: tuple, b: tuple, same: bool) -> None:
            (x, ids, far, weight), (y, others, far_b, weight_b) = a, b
            back = np.zeros(len(y), np.int64)
            for low in range(0, len(x), TILE):
                own = slice(low, low + TILE)
                some = slice(np.searchsorted(far_b, far[own][0] - radius - _SLACK), np.searchsorted(far_b, far[own][-1] + radius + _SLACK, "right"))
                near = (x[own] @ y[some].T >= cosine) & (ids[own][:, None] != others[some])
                counts = near @ weight_b[some]
                if counts.any():
                    linked = np.flatnonzero(counts)
                    put(ids[own][linked], ids[own][linked], counts[linked])
                    back[some] += near.T @ weight[own]
                    forest = spanning_links(near)
                    put(ids[own][[i for i, _ in forest]], others[some][[j for _, j in forest]], np.zeros(len(forest)))
            if not same:
                linked = np.flatnonzero(back)
                put(others[linked], others[linked], back[linked])

        pdf = pdf.sort_values("far")
        left, right = ((units(list(s["packed"]), dtype), s["node"].to_numpy(), s["far"].to_numpy(), s["n"].to_numpy()) if len(s) else None for s in (pdf[pdf["left"]], pdf[~pdf["left"]]))
        if right and pdf["inner"].iloc[0]:
            compare(right, right, True)
        if left and right:
            compare(left, right, False)
        return pd.DataFrame({k: np.concatenate(v) for k, v in out.items()})

    return run


def _links(homes: DataFrame, visitors: DataFrame, cosine: float, dtype: str) -> DataFrame:
    """``node``, ``to``, ``links``: counts (node = to) and forests of the links of all cells.

    A cell has blocks of homes and blocks of guests.  A group (i, i) holds the homes of block i and the first guests; all other pairs of
    blocks of homes, and of further guests and homes, are groups of two blocks.
    """
    key = ["label", "length", "cell"]
    rows = homes.withColumn("left", F.lit(False)).unionByName(visitors.withColumn("left", F.lit(True)))
    blocks = lambda cond: F.ceil(F.count_if(cond) / BLOCK).cast("int")
    sizes = stored(rows.groupBy(*key).agg(blocks(~F.col("left")).alias("homes"), blocks(F.col("left")).alias("guests")).where("homes > 0"), "sizes")
    sized = rows.join(F.broadcast(sizes) if sizes.count() <= MAX_CELLS else sizes, key)  # many cells: joined by key
    own = F.pmod(F.xxhash64("node"), F.when(F.col("left"), F.col("guests")).otherwise(F.col("homes"))).cast("int")
    group = lambda i, j, guest, inner, left: F.struct(i.alias("i"), j.alias("j"), guest.alias("guest"), inner.alias("inner"), left.alias("left"))
    each = lambda n, f: F.transform(F.sequence(F.lit(0), n - 1), f)
    no, yes = F.lit(False), F.lit(True)
    o = F.col("own")
    home = F.concat(
        each(F.col("homes"), lambda k: group(F.least(o, k), F.greatest(o, k), no, o == k, o < k)),
        F.when(F.col("guests") > 1, F.transform(F.sequence(F.lit(1), F.col("guests") - 1), lambda g: group(o, g, yes, no, no))).otherwise(F.array().cast("array<struct<i:int,j:int,guest:boolean,inner:boolean,left:boolean>>")),
    )
    guest = each(F.col("homes"), lambda k: F.when(o == 0, group(k, k, no, yes, yes)).otherwise(group(k, o, yes, no, yes)))
    placed = sized.withColumn("own", own).select("node", "n", "packed", "far", *key, F.inline(F.when(F.col("left"), guest).otherwise(home)))
    pairs = placed.repartition(*key, "i", "j", "guest")  # a cell's blocks are not one task
    return pairs.groupBy(*key, "i", "j", "guest").applyInPandas(_group(cosine, dtype), "node long, to long, links long")


def _pivots(nodes: DataFrame, radius: float, seed: int) -> dict[Key, np.ndarray]:
    """Pivots of the labels (and lengths) that have the most vectors."""
    sizes = nodes.groupBy("label", F.size("embedding").alias("length")).agg(F.count("*").alias("total")).where(F.col("total") > PER_PIVOT)
    large = sizes.orderBy(F.desc("total"), "length").limit(MAX_LABELS)
    totals = {(r["label"], r["length"]): r["total"] for r in large.collect()}
    if not totals:
        return {}
    each = min(4 * MAX_PIVOTS, SAMPLE_VALUES // (len(totals) * max(n for _, n in totals)))
    first = F.row_number().over(Window.partitionBy("label", "length").orderBy(F.xxhash64(F.lit(seed), "embedding"), "node"))
    rows = nodes.withColumn("length", F.size("embedding")).join(F.broadcast(large), ["label", "length"]).withColumn("nth", first).where(F.col("nth") <= each)
    samples: dict[Key, list] = {}
    for r in rows.orderBy("label", "length", "nth").select("label", "length", "embedding").collect():
        samples.setdefault((r[0], r[1]), []).append(r[2])
    out = {}
    for key, vectors in samples.items():
        units = np.array(vectors, dtype=np.float64)
        chosen = choose(units / np.linalg.norm(units, axis=1, keepdims=True), totals[key], radius)
        if len(chosen):
            out[key] = chosen
    return out


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", seed: int = 42) -> DataFrame:
    """``id_col``, ``n_links``, ``component`` and ``kept`` of every row."""
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be over 0")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    fit = rows.where(F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & sound, F.lit(False)))
    nodes = stored(fit.groupBy("label", "embedding").agg(F.min("id").alias("node"), F.count("*").alias("n")), "nodes")
    radius = float(np.sqrt(2 - 2 * cosine))
    pivots = _pivots(nodes, radius, seed)
    homes = stored(_homes(spread(nodes), pivots), "homes")
    visitors = homes.limit(0)
    if pivots:
        reach = {k: np.full(len(p), -np.inf) for k, p in pivots.items()}
        for r in homes.groupBy("label", "length", "cell").agg(F.max("far").alias("far")).join(F.broadcast(_table(homes, pivots)), ["label", "length"], "left_semi").collect():
            reach[r["label"], r["length"]][r["cell"]] = r["far"]
        visitors = stored(_visitors(homes, _packed_kind(nodes), pivots, reach, radius), "visitors")
    found = stored(_links(homes, visitors, cosine, _packed_kind(nodes)), "links")
    counts = found.where("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("node <> to").select(F.col("node").alias("a"), F.col("to").alias("b")))
    named = nodes.join(counts, "node", "left").join(roots.withColumnRenamed("node", "at"), F.col("node") == F.col("at"), "left")
    named = named.select("label", "embedding", F.coalesce("links", F.lit(0)).alias("links"), "n", F.coalesce("root", "node").alias("root"))
    joined = rows.join(named, ["label", "embedding"], "left")
    root = F.coalesce(F.when(F.col("id").isNotNull(), F.col("root")), F.col("id"))
    n_links = F.when(F.col("id").isNotNull() & F.col("root").isNotNull(), F.col("links") + F.col("n") - 1).otherwise(0)
    return joined.select(F.col("id").alias(id_col), n_links.cast("long").alias("n_links"), root.alias("component"), F.col("id").eqNullSafe(root).alias("kept"))


def _table(homes: DataFrame, pivots: dict[Key, np.ndarray]) -> DataFrame:
    """The labels and lengths that have pivots."""
    return homes.sparkSession.createDataFrame(list(pivots), homes.select("label", "length").schema)


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("component", "component_id")


#: For vectors without null or non-finite components and with different ids.
OP2_SQL = """
with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings where label is not null and embedding is not null and list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.98),
reach as (select distinct a as node, a as other from links union select reach.node, links.b from reach join links on links.a = reach.other),
counts as (select a, count(*) as n from links group by a), roots as (select node, min(other) as root from reach group by node)
select e.vec_id, coalesce(n, 0)::bigint as n_links, coalesce(root, e.vec_id) as component_id, coalesce(root, e.vec_id) = e.vec_id as kept
from embeddings e left join counts on counts.a = e.vec_id left join roots on roots.node = e.vec_id
"""
