"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.shared import discard, materialize


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id that has an edge; component is the smallest id reachable.

    Alternating large-star and small-star steps: each round is two grouped minima and two
    joins over the edge table, written to the shared folder, and the number of rounds grows
    with the logarithm of a component's size.  Nothing is collected.  Self-loops and
    repeated or reversed edges are allowed.  Edges with a null end are ignored.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") != F.col("v")).distinct()
    e = materialize(e, "cc")
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low2.select("u", F.col("m").alias("v")))
        small = small.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        new = materialize(small, "cc")
        # done when every id has one edge only, to the least of its component, which itself has no lesser neighbour
        state = new.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v"))
        open_ = state.where("n > 1").limit(1).unionByName(state.join(new.select(F.col("u").alias("v")), "v", "left_semi").select("u", "n", "v").limit(1))
        done = open_.limit(1).count() == 0
        discard(e)
        e = new
        if done:
            break
    else:
        raise RuntimeError("connected_components: no convergence; raise max_rounds")
    roots = e.select(F.col("v").alias("id")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
