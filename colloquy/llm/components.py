"""Connected components of links between documents, by joins and grouping only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


#: Links up to which a step is one task's work: so few rows cost less than dealing them out anew at each join.
FEW = 200_000


def components(edges: DataFrame) -> DataFrame:
    """For edges (a, b) of orderable ids: node and component, the smallest id that links lead to.

    Alternates two steps until nothing changes: every node's larger neighbours are linked to its smallest neighbour,
    then its smaller ones are. The number of rounds grows with the logarithm of the longest chain. A node's
    neighbours are never gathered: its smallest one is a grouped minimum, joined back. Up to ``FEW`` links (there are never more
    than at first) are read as one partition, which needs no shuffle; more are dealt by node.
    """
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    n, state = now.count(), None
    if not n:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    read = (lambda df: df.coalesce(1)) if n <= FEW else (lambda df: df)
    while True:
        links = read(now)
        both = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("x"), "m"), F.struct(F.col("a").alias("x"), "m"))).alias("e")).select("e.*")
        last, now = now, materialize(linked.filter("x <> m").select(F.greatest("x", "m").alias("a"), F.least("x", "m").alias("b")).distinct(), "links")
        discard(last)
        seen = read(now).agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    # Every edge now leads to the smallest node of its component.
    roots = read(now).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return roots.unionByName(roots.select(F.col("component").alias("node"), "component").distinct())
