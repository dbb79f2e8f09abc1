"""Bounded path graphs over citation edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.session import materialise


def _distances(edges: DataFrame, start: int, hops: int, src: str, dst: str) -> DataFrame:
    """(node, d): least number of edges from ``start`` within ``hops``; each round reads only the new frontier."""
    spark = edges.sparkSession
    reached = spark.createDataFrame([(start, 0)], "node bigint, d int")
    frontier = reached
    for step in range(1, hops + 1):
        out = edges.join(F.broadcast(frontier.select(F.col("node").alias(src))) if step == 1 else frontier.select(F.col("node").alias(src)), src).select(F.col(dst).alias("node")).distinct()
        frontier = materialise(out.join(reached, "node", "left_anti").select("node", F.lit(step).alias("d")), "frontier")
        reached = reached.unionByName(frontier)
    return reached


def path_nodes(edges: DataFrame, start: int, end: int, hops: int, most: int | None = None) -> DataFrame:
    """(node, before, after): nodes on some path of at most ``hops`` edges from ``start`` to ``end``.

    More than ``most`` nodes is an error, not a cut.
    """
    fore = _distances(edges, start, hops, "src", "dst").withColumnRenamed("d", "before")
    back = _distances(edges, end, hops, "dst", "src").withColumnRenamed("d", "after")
    nodes = fore.join(back, "node").where(F.col("before") + F.col("after") <= hops)
    if most is not None and nodes.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} nodes")
    return nodes


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between the given nodes."""
    n = nodes.select("node")
    return edges.join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi")


def as_json(edges: DataFrame) -> DataFrame:
    """(node, in_degree, json): neighbours of each node that is cited."""
    g = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"), F.array_sort(F.collect_set("src")).alias("cited_by"))
    return g.select("node", "in_degree", F.to_json(F.struct("node", "in_degree", "cited_by")).alias("json"))
