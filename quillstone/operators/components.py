"""Connected classes and set similarity without pairwise groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.session import discard, materialise


def classes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, cls) of connected classes over edges (a, b): cls is the least id.

    Labels spread over written tables, with pointer jumping, until none
    changes; the rounds grow with the logarithm of a class's width. An isolated
    node is its own class.
    """
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    label = written = materialise(nodes.select("id", F.col("id").alias("cls")), "labels")
    while True:
        seen = both.join(label.select(F.col("id").alias("b"), "cls"), "b").groupBy(F.col("a").alias("id")).agg(F.min("cls").alias("m"))
        hop = label.join(seen, "id", "left").select("id", F.col("cls").alias("old"), F.least("cls", F.coalesce("m", "cls")).alias("cls"))
        jump = label.select(F.col("id").alias("cls"), F.col("cls").alias("up"))
        new = materialise(hop.join(jump, "cls", "left").select("id", "old", F.least("cls", F.coalesce("up", "cls")).alias("cls")), "labels")
        same = not new.where("cls <> old").limit(1).count()
        discard(written)
        written = new
        if same:
            discard(both)
            return new.select("id", "cls")
        label = new.select("id", "cls")


def similar_sets(df: DataFrame, key: str, group: str, items: str, least: float) -> DataFrame:
    """(a, b, jaccard): pairs of one group whose sets have at least this Jaccard similarity.

    Prefix filter, exact: with items ordered from rare to common, two such sets
    share an item among the first n - ceil(least * n) + 1 of each. Rows with
    equal sets are folded to one representative first and joined to it by
    links, so copies are never paired with each other.
    """
    rows = df.select(F.col(key).alias("k"), F.col(group).alias("g"), F.array_sort(F.array_distinct(F.col(items))).alias("s")).where(F.size("s") > 0)
    reps = materialise(rows.groupBy("g", "s").agg(F.min("k").alias("k")), "sets")
    copies = rows.join(reps.withColumnRenamed("k", "rep"), ["g", "s"]).where(F.col("k") != F.col("rep")).select(F.col("rep").alias("a"), F.col("k").alias("b"), F.lit(1.0).alias("jaccard"))
    each = reps.select("g", "k", F.explode("s").alias("i"))
    common = each.groupBy("i").agg(F.count("*").alias("n"))
    ranked = each.join(common, "i").groupBy("g", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "i"))), lambda x: x["i"]).alias("o"))
    head = ranked.select("g", "k", "o", F.explode(F.slice("o", F.lit(1), (F.size("o") - F.ceil(F.size("o") * least - 1e-9) + 1).cast("int"))).alias("i"))
    l, r = head.select("g", "i", F.col("k").alias("a"), F.col("o").alias("x")), head.select("g", "i", F.col("k").alias("b"), F.col("o").alias("y"))
    cand = l.join(r, ["g", "i"]).where((F.col("a") < F.col("b")) & (F.size("x") >= least * F.size("y")) & (F.size("y") >= least * F.size("x"))).dropDuplicates(["a", "b"])
    shared = F.size(F.array_intersect("x", "y"))
    jac = shared / (F.size("x") + F.size("y") - shared)
    return cand.select("a", "b", jac.alias("jaccard")).where(F.col("jaccard") >= least).unionByName(copies)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both)
