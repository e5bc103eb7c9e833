"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shipgauge.llm.frames import Stored, materialize


def components(edges: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) of every node of ``edges`` (a, b).

    Each round every node takes the smallest of its neighbours and itself, twice over,
    and edges are drawn anew between what has been taken, until none is left; stars end
    in one round. The rounds' tables, each smaller than the one before, are joined at
    the end.
    """
    left, rounds = Stored(edges.where("a != b").select("a", "b"), "edges"), []
    while True:
        step = (
            left.df.union(left.df.select("b", "a")).groupBy("a").agg(F.min("b").alias("b"))
            .select(F.col("a").alias("node"), F.least("a", "b").alias("root")))
        first = Stored(step, "step")
        up = first.df.select(F.col("node").alias("root"), F.col("root").alias("up"))
        taken = materialize(first.df.join(up, "root").select("node", F.col("up").alias("root")), "roots")
        first.drop()
        rounds.append(taken)
        drawn = left.df
        for end in ("a", "b"):
            drawn = drawn.join(taken.select(F.col("node").alias(end), F.col("root").alias("to")), end).withColumn(end, F.col("to")).drop("to")
        after = Stored(drawn.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        left.drop()
        left = after
        if left.df.isEmpty():
            break
    left.drop()
    whole = rounds[0]
    for taken in rounds[1:]:
        whole = whole.join(taken.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return whole
