"""Connected components by contraction, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm._shared import durable


def follow(moves: DataFrame) -> DataFrame:
    """``moves`` (a, to) followed to their ends. Each pass doubles the steps, so a chain takes the logarithm of its length."""
    while True:
        further = moves.where("to != a").select(F.col("a").alias("to"), F.col("to").alias("_up"))
        moves = durable(moves.join(further, "to", "left").select("a", F.coalesce("_up", "to").alias("to"), F.col("_up").isNotNull().alias("_moved")))
        if moves.where("_moved").isEmpty():
            return moves.drop("_moved")
        moves = moves.drop("_moved")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): the label is the smallest node that it is connected to.

    In each round every node moves to its smallest neighbour, from there to where that one moves and so on; edges follow, and what has
    become one node goes. A component of stars is done in a round or two. Minima are taken before the shuffle, so a hub of very many
    edges sends one row a task.
    """
    edges = durable(edges.where("a != b").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moves = follow(durable(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to"))))
        if labels is None:
            labels = moves.toDF("node", "label")
        else:
            labels = durable(labels.join(moves.toDF("label", "_to"), "label", "left").select("node", F.coalesce("_to", "label").alias("label")))
        edges = edges.join(moves.toDF("a", "_a"), "a").join(moves.toDF("b", "_b"), "b")
        edges = durable(edges.select(F.col("_a").alias("a"), F.col("_b").alias("b")).where("a != b").distinct())
    if labels is None:
        return edges.toDF("node", "label")
    return labels
