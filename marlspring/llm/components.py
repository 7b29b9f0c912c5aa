"""Connected components of a distributed list of edges, by contraction to least neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlspring.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """key, root (the least key reachable) for every end of edges (a, b: long, not null; a table that is cheap to read again).

    Each round maps every vertex to its least neighbour, follows those pointers, and contracts the
    edges; a round at least halves the vertices of a component. Edges that repeat change no least
    neighbour, and the first round's pointers name every vertex, so they are the first labels. Frames are
    written between rounds, so a lost executor repeats one round only. Nothing is gathered by component: a
    hub is one row of ``least`` whose join Spark may split.
    """
    edges, labels = edges.where("a <> b").select("a", "b"), None
    while labels is None or not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).groupBy("a").agg(F.min("b").alias("m"))
        least = written(both.select(F.col("a").alias("key"), F.least("a", "m").alias("root")))
        for _ in range(2):
            further = least.select(F.col("key").alias("root"), F.col("root").alias("beyond"))
            least = written(least.join(further, "root").select("key", F.col("beyond").alias("root")))
        if labels is None:
            labels = least
        else:
            to = least.select(F.col("key").alias("root"), F.col("root").alias("to"))
            labels = written(labels.join(to, "root", "left").select("key", F.coalesce("to", "root").alias("root")))
        at_a, at_b = (least.select(F.col("key").alias(c), F.col("root").alias(f"{c}_to")) for c in "ab")
        edges = written(edges.join(at_a, "a").join(at_b, "b").where("a_to <> b_to").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct())
    return labels
