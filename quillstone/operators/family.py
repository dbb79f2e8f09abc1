"""Parent-child search: parents by their children, children by their parents, best children of each parent.

All joins are equi-joins on the parent key, so tables bucketed by it join
without a shuffle; filters are applied to both sides before the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def has_child(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, condition: Column | None = None, score: Column | None = None) -> DataFrame:
    """Parents with a matching child; with ``score`` the largest score of a parent's children becomes child_score."""
    kids = children if condition is None else children.where(condition)
    if score is None:
        return parents.join(kids.select(F.col(child_key).alias(parent_key)), parent_key, "left_semi")
    best = kids.groupBy(F.col(child_key).alias(parent_key)).agg(F.max(score).alias("child_score"))
    return parents.join(best, parent_key)


def has_parent(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str, condition: Column) -> DataFrame:
    """Children whose parent matches."""
    return children.join(parents.where(condition).select(F.col(parent_key).alias(child_key)), child_key, "left_semi")


def best_children(children: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` children of each parent, with child_rank and whether more remain (child_remaining).

    One child more than ``n`` is ranked, which is what tells that some remain; the rank limit keeps the rest out of the shuffle.
    """
    w = Window.partitionBy(key)
    ranked = children.withColumn("child_rank", F.row_number().over(w.orderBy(*order))).where(F.col("child_rank") <= n + 1)
    flagged = ranked.withColumn("child_remaining", F.max("child_rank").over(w) > n)
    return flagged.where(F.col("child_rank") <= n)


def collapse(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The best row of each key."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__rn = 1").drop("__rn")


def family_search(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, child_text: Column, parent_text: Column, child_filter: Column, parent_filter: Column) -> DataFrame:
    """Parents where (child text and child filter and parent filter) or (parent text and parent filter and some child passes its filter)."""
    kept = parents.where(parent_filter)
    by_child = has_child(kept, children, parent_key, child_key, child_text & child_filter)
    by_parent = has_child(kept.where(parent_text), children, parent_key, child_key, child_filter)
    return by_child.unionByName(by_parent).dropDuplicates([parent_key])
