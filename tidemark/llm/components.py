"""Connected components of a large edge table, by large-star and small-star rounds.

Kiveris et al. 2014, "Connected components in MapReduce and beyond".  Edges and
labels stay distributed.  Each round is written to the shared folder; what the
driver learns of a round is one row, taken while it is written: whether any edge changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import BROADCAST_ROWS, Durable, seen, sizes


def _near(least: DataFrame, edges: int, store: Durable) -> DataFrame:
    """The least neighbours, broadcast where there are few edges; else stored, so that the join has plain shuffles on both sides and a node with many edges can be split."""
    return F.broadcast(least) if 2 * edges <= BROADCAST_ROWS else store.write(least, "least").hint("merge")


def _large_star(edges: DataFrame, n: int, store: Durable) -> DataFrame:
    """Links each node's larger neighbours to the least of it and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(_near(least, n, store), "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()


def _small_star(edges: DataFrame, n: int, store: Durable) -> DataFrame:
    """Links each node and its smaller neighbours to the least of these."""
    down = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))  # a > b
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(_near(least, n, store), "a").select("m", "b").union(least.select("m", F.col("a").alias("b")))
    return moved.select(F.col("m").alias("a"), "b").filter("a < b").distinct()


def components(edges: DataFrame, store: Durable) -> DataFrame:
    """node and component, the least node that it reaches, of each node with an edge; edges are two longs a and b."""
    digest = {"n": F.count(F.lit(1)), "bits": F.bit_xor(F.xxhash64("a", "b")), "total": F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))}
    edges = store.write(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges", **digest)
    while True:
        n = seen(edges)["n"]
        large = _large_star(edges, n, store)
        if 2 * n > BROADCAST_ROWS:  # read twice in the next step
            large = store.write(large, "large")
        after = store.write(_small_star(large, n, store), "edges", **digest)
        same = seen(after) == seen(edges)
        store.drop(edges)
        edges = after
        if same:
            labels = edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
            return store.write(labels, "labels", **sizes(labels))
