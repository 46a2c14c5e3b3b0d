"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.session import materialize, release


def _forest(batches):
    """Reduce the links of one task to links from each node to its local root."""
    for b in batches:
        a, c = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        nodes, codes = np.unique(np.concatenate([a, c]), return_inverse=True)
        parent = list(range(len(nodes)))

        def root(x, parent=parent):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        n = len(a)
        for x, y in zip(codes[:n].tolist(), codes[n:].tolist()):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        roots = np.array([root(x) for x in range(len(nodes))], dtype=np.int64)
        keep = roots != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(nodes[roots[keep]])], names=["u", "v"])


def connected_components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """node, component (the least node) of every node that has a link to another.

    Rows with a null end and links of a node to itself are ignored; repeated links count once;
    an empty table gives an empty table. Each round points every node's larger neighbours, then
    its smaller ones, at the least neighbour, so the depth of a component is halved about once a round
    and no neighbourhood is gathered in one place: minima are pre-aggregated and joined.
    """
    edges = (
        links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
        .where("u is not null and v is not null and u <> v")
        .mapInArrow(_forest, "u long, v long")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    edges, mark = materialize(edges, "links"), None
    for _ in range(most_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        new = materialize(small.distinct(), "links")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        release(edges)
        edges = new
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
