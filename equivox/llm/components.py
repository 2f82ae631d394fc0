"""Connected components of an edge table, by contraction.

Each round every node takes the smallest label among itself and its neighbours, labels are followed to
their ends (the distance doubles each time, so long chains need few steps), and the edges are renamed and
thinned.  At least half of the nodes of each component vanish in a round; nothing is collected.  Each round's
tables are written to the shared folder and read again: a lost executor costs one round at most, and plans do not
grow (a checkpoint would carry on what the optimizer inferred, and that multiplies from round to round).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equivox.llm.session import written


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) of longs -> (node, root): root is the smallest node reachable.

    Self edges and repeated edges are harmless; null ends are dropped; nodes without a proper edge
    do not appear; an empty table gives an empty result.
    """
    edges = written(edges.where("u is not null and v is not null and u != v").distinct())
    labels = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p"))
        while True:
            far = step.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            step = written(step.join(far, "p").select("u", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")))
            if step.where("moved").isEmpty():
                break
        step = step.drop("moved")
        if labels is None:
            labels = step.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            moved = step.select(F.col("u").alias("root"), "p")
            labels = written(labels.join(moved, "root", "left").select("node", F.coalesce("p", "root").alias("root")))
        left = edges.join(step, "u").select(F.col("p").alias("a"), "v")
        right = left.join(step.select(F.col("u").alias("v"), F.col("p").alias("b")), "v")
        edges = right.where("a != b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        edges = written(edges)
        if edges.isEmpty():
            return labels
