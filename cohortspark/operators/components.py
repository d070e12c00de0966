"""Connected components of a large edge table (G3), as an iterative DataFrame job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.session import cut_with_digest


def connected_components(edges: DataFrame, part: Sequence[str] = (), max_rounds: int = 60) -> DataFrame:
    """Smallest node id of the component of every node that has an edge: (part, node, component).

    ``edges`` has columns ``part``, ``a``, ``b``; direction and duplicates do not matter. Alternates two star steps
    until the edge set stops changing: link every larger neighbour to the smallest neighbour, then every smaller one.
    Each step is a combining ``min`` per node joined back to the edges, so a hub with very many edges is a skewed join
    (one row against many, split by AQE), never a collected list. The edge table cannot grow. Each
    round's table is written to the shared folder, which ends the lineage, and compared by a digest taken on the way.
    """
    part = list(part)
    e = edges.where("a <> b").select(*part, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, before = cut_with_digest(e, *part, "a", "b")
    for _ in range(max_rounds):
        # larger neighbours of u go to the smallest node among u and its neighbours
        both = e.unionByName(e.select(*part, F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(*part, "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.join(low, [*part, "a"]).where("b > a")
                 .select(*part, F.col("b").alias("a"), F.col("m").alias("b")))
        large = large.where("a <> b")
        # smaller neighbours of u, and u itself, go to the smallest of them
        low = large.groupBy(*part, "a").agg(F.min("b").alias("m"))
        small = large.join(low, [*part, "a"])
        small = (small.select(*part, F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select(*part, "a", F.col("m").alias("b"))))
        e, after = cut_with_digest(small.where("a <> b").distinct(), *part, "a", "b")
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = e.select(*part, F.col("a").alias("node"), F.col("b").alias("component"))
    roots = e.select(*part, F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return members.unionByName(roots)
