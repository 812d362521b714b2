"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuseval.sources.shared import stored


def _state(edges: DataFrame) -> tuple[int, int]:
    """Number of links, and a checksum that does not depend on their order."""
    n, total = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
    return n, int(total or 0)


def _least(edges: DataFrame, node: str, other: str) -> DataFrame:
    """Each node's smallest neighbour, or itself if that is smaller; summed up before anything is joined to it."""
    return stored(edges.groupBy(F.col(node).alias("n")).agg(F.min(other).alias("m")).select("n", F.least("n", "m").alias("m")), "least")


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node that links reach, for both ends (longs ``a`` and ``b``) of every link.

    Stars are contracted in turns (Kiveris et al., 2014): first each node ties its larger neighbours to the smallest, then the smaller
    ones to the smallest of these, until nothing changes.  The number of links never grows, and that of turns grows with the logarithm of
    the longest chain.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v <> u").distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.select(F.col("v").alias("n"), F.col("u").alias("o")).unionAll(edges.select("u", "v"))
        larger = both.join(_least(both, "n", "o"), "n").where("o > n").select(F.col("o").alias("v"), F.col("m").alias("u"))
        larger = stored(larger.distinct(), "links")
        least = _least(larger, "v", "u")
        smaller = larger.join(least, larger["v"] == least["n"]).where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        edges = stored(smaller.unionAll(least.toDF("v", "u")).distinct(), "links")
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionAll(roots)
