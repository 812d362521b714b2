"""Connected components of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuseval.llm._session import stored

#: Links that one task takes; few links are not dealt out to all of a cluster's tasks in every step.
TASK_LINKS = 500_000


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root``, the smallest node reachable, for every node that has a link to another.

    Large-star and small-star steps (Kiveris et al., 2014) in turn until the links stop changing.  Each node's least
    neighbour is pre-aggregated and written before it is joined, so that a node with very many links is a skewed join
    that adaptive execution splits.  Links and components stay distributed; only a count and a checksum reach the driver.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    edges = stored(links.select(F.greatest(x, y).alias("v"), F.least(x, y).alias("u")).where("v <> u").distinct(), "links")
    seen = _mark(edges)
    while seen[0]:
        tasks = -(-2 * seen[0] // TASK_LINKS)  # steps never add links
        few = lambda df: df.coalesce(tasks)  # noqa: E731, B023
        edges = few(edges)
        both = edges.select(F.col("v").alias("n"), F.col("u").alias("m")).unionAll(edges.select("u", "v"))
        least = stored(few(both.groupBy("n").agg(F.min("m").alias("least")).select("n", F.least("n", "least").alias("least"))), "least")
        large = few(both.join(least, "n").where("m > n").select(F.col("m").alias("v"), F.col("least").alias("u")))
        large = stored(few(large.distinct()), "large")
        least = stored(few(large.groupBy("v").agg(F.min("u").alias("least"))), "least")
        small = few(large.join(least, "v").where("u <> least").select(F.col("u").alias("v"), F.col("least").alias("u"))).unionAll(least.toDF("v", "u"))
        edges = stored(few(small.distinct()), "links")
        if (now := _mark(edges)) == seen:
            break
        seen = now
    roots = edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionAll(roots)


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Number and order-independent checksum of the links."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
    return row[0], int(row[1] or 0)
