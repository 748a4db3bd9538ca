"""Connected components by contraction, in Spark, in logarithmically many rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, shared_table


def _hooks(edges: DataFrame, order: Column, twice: bool) -> DataFrame:
    """a, to: a node's first neighbour by order, or that one's; of two that choose each other the smaller one stays."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    chosen = shared_table(both.groupBy("a").agg(F.min(F.struct(order.alias("o"), "b"))["b"].alias("to")))
    back = chosen.select(F.col("a").alias("to"), F.col("to").alias("back"))
    stays = (F.col("back") == F.col("a")) & (F.col("a") < F.col("to"))
    hooks = shared_table(chosen.join(back, "to").select("a", F.when(stays, F.col("a")).otherwise(F.col("to")).alias("to")))
    if not twice:
        forget(chosen)
        return hooks
    further = hooks.select(F.col("a").alias("to"), F.col("to").alias("far"))
    step = shared_table(hooks.join(further, "to").select("a", F.col("far").alias("to")))
    forget(chosen, hooks)
    return step


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of all nodes with an edge to another; edges: a, b (long).

    In a round every node hooks to one neighbour (after the first round, and to that one's), and the edges are
    contracted. All nodes of a star meet in its centre at once; as the order of neighbours is another hash each round, chains shrink by a constant
    factor too, whatever their ids, so a component of n nodes takes about log2(n) rounds at most. Hot nodes only meet
    partial minima and joins whose other side has unique keys. An empty table gives no rows; null ends are no edge.
    """
    edges = shared_table(edges.where("a <> b").distinct())
    labels, seed = None, 0
    while True:
        step = _hooks(edges, F.xxhash64(F.lit(seed), F.col("b")), seed > 0)
        seed += 1
        if labels is None:
            found = step.select(F.col("a").alias("node"), F.col("to").alias("root"))
        else:
            found = labels.join(step, labels["root"] == step["a"], "left")
            found = found.select("node", F.coalesce("to", "root").alias("root"))
        found = shared_table(found)
        left, right = step.toDF("a", "ta"), step.toDF("b", "tb")
        rest = edges.join(left, "a").join(right, "b").where("ta <> tb")
        rest = shared_table(rest.select(F.col("ta").alias("a"), F.col("tb").alias("b")).distinct())
        forget(edges, step, *([labels] if labels is not None else []))
        edges, labels = rest, found
        if edges.isEmpty():
            break
    least = shared_table(labels.groupBy("root").agg(F.min("node").alias("component")))
    out = shared_table(labels.join(least, "root").select("node", "component"))
    forget(edges, labels, least)
    return out
