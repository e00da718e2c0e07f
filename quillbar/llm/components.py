"""Connected components of a graph given as a DataFrame of links, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbar.llm.common import materialize


LINKS_IN_TASK = 100_000
#: Links of a round whose minima (16 bytes a node) may be broadcast.
MOST_BROADCAST = 250_000


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). (node, root) of every node that has a link, root being the smallest node of
    its component. Each round links the larger neighbours of a node to its smallest neighbour, then the
    smaller ones. Minima meet in partial sums and are broadcast, or written, so that a join with them can split
    the links of a node that has very many: it is no single task's."""
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    mark = lambda e: e.select(F.xxhash64("a", "b").alias("h")).agg(F.count("h").alias("n"), F.expr("bit_xor(h)").alias("x")).first()
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = mark(edges)
    while True:
        around = both(edges)
        apart = F.broadcast if before["n"] <= MOST_BROADCAST else (lambda df: materialize(df, "minima"))
        least = apart(around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        low = apart(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        # As many tasks as there are links write the round: their number does not grow.
        edges = materialize(small.coalesce(1 + before["n"] // LINKS_IN_TASK), "links")
        now = mark(edges)
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
