"""Connected components by joins: smallest neighbour label, then the label of the label, until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Of undirected edges: (node, root), root being the smallest node that can be reached.  Every join is of two keyed
    tables and every grouping is a minimum, so a hub is pre-aggregated or split.  No edges give no rows."""
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    e = written(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    now = written(e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        near = e.join(now, e.b == now.node).groupBy("a").agg(F.min("root").alias("m"))
        hooked = now.join(near, now.node == near.a).select("node", F.least("root", "m").alias("root"), F.col("root").alias("was"))
        up = now.select(F.col("node").alias("p"), F.col("root").alias("q"))
        new = hooked.join(up, hooked.root == up.p).select("node", F.least("root", "q").alias("root"), "was")
        new = written(new, "labels")
        now = new.select("node", "root")
        if not new.filter("root <> was").limit(1).count():
            return now
