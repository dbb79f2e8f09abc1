"""Full hierarchies from parent-child rows of unknown depth.

Tree contraction. Rows (node, next, steps) are spread over tasks so that many
parent links stay inside one task; each task contracts its chains to fragment
exits, the first ancestor that lies in another task, and notes the trail of
nodes in between. Only nodes that are an exit of somebody go on: the quotient
forest. It is solved the same way, recursively, and the fragments are expanded
on the way back by one join, steps and trails alike. A loop inside a task is
found there; a loop through several tasks shrinks level by level until one task
holds it whole. The recursion ends where a quotient has ``LAST_ROWS`` links or
fewer; the rows themselves always go through fragments.

Placement: nodes get a random colour at each level, and a node of colour 0 is
placed with its parent of colour 1, so a level resolves at least about a
quarter of the links whatever the number of tasks. Children of a parent with
very many children are placed by their own hash instead, so no task receives a
hot group; being many, they are mostly leaves, which leave the recursion. As
every level drops leaves and contracts chains, the number of levels grows with
the logarithm of the rows.

Descendants are read off the paths: every node on a node's path is its
ancestor. No closure is joined, and the descendants of asked roots are a filter.

Defined results. NULL or blank ids are no nodes. Rows repeated with one id
count once, with the smallest non-blank parent. A NULL or blank parent, or one
that names no row, makes a root (depth 0, root itself). Rows on or below a
loop get root '', depth -1 and a NULL path. An empty table gives an empty
table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.session import discard, materialise

#: Links that one task of a level may hold (about 100 bytes each, and the trails where paths are asked for).
TASK_ROWS = 400_000
#: Links of a quotient that one task solves whole, and least number of tasks of a level.
LAST_ROWS, LEAST_TASKS = 1_000, 8
#: Children of one parent that may be placed with it.
MATE_CHILDREN = 1_000


def _chase(nodes: np.ndarray, nxt: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each link the first ancestor that is no node here, the steps to it, and whether it runs into a loop."""
    at = pd.Index(nodes).get_indexer(nxt)
    target, total, jump = nxt.copy(), steps.astype(np.int64), at.copy()
    for _ in range(int(np.ceil(np.log2(len(nodes) + 1))) + 1):
        live = np.flatnonzero(jump >= 0)
        if not len(live):
            break
        to = jump[live]
        total[live] = np.minimum(total[live] + total[to], 2**40)
        target[live] = target[to]
        jump[live] = jump[to]
    return target, total, jump >= 0


def _trails(at: np.ndarray, hops: np.ndarray, loop: np.ndarray, own: list) -> list:
    """Trail of each link to its exit; those nearer the exit are ready first."""
    done: list = list(own)
    for i in np.argsort(hops, kind="stable").tolist():
        if loop[i]:
            done[i] = None
        elif at[i] >= 0:
            done[i] = [*own[i], *done[at[i]]]
    return done


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = list(batches)
    if not parts:
        return
    b = pd.concat(parts, ignore_index=True)
    if b.empty:
        return
    node, nxt = b["node"].to_numpy(object), b["next"].to_numpy(object)
    target, total, loop = _chase(node, nxt, b["steps"].to_numpy())
    out = {"node": b["node"], "next": target, "steps": np.where(loop, -1, total), "loop": loop}
    if "trail" in b:
        _, hops, _ = _chase(node, nxt, np.ones(len(b)))
        out["trail"] = _trails(pd.Index(node).get_indexer(nxt), hops, loop, [list(t) for t in b["trail"]])
    yield pd.DataFrame(out)


def _solve(links: DataFrame, level: int, task_rows: int, last_rows: int, written: list[DataFrame]) -> DataFrame:
    """(node, root, depth[, trail]) of every link (node, next, steps[, trail]); nodes that aren't in ``links`` are roots."""
    n = links.count()
    trail = ["trail"] if "trail" in links.columns else []
    schema = "node string, next string, steps bigint, loop boolean" + ", trail array<string>" * len(trail)
    if n == 0 or level and n <= last_rows:
        done = links.repartition(1).mapInPandas(_contract, schema)
        return done.select(
            "node",
            F.when(F.col("loop"), "").otherwise(F.col("next")).alias("root"),
            F.when(F.col("loop"), -1).otherwise(F.col("steps")).alias("depth"),
            *trail,
        )
    colour = lambda c: F.pmod(F.xxhash64(c, F.lit(level)), F.lit(2))
    crowd = links.groupBy("next").count().where(F.col("count") > MATE_CHILDREN).select("next", F.lit(True).alias("crowded"))
    placed = links.join(crowd, "next", "left").withColumn(
        "at", F.when(F.col("crowded").isNull() & (colour(F.col("node")) == 0) & (colour(F.col("next")) == 1), F.col("next")).otherwise(F.col("node"))
    )
    parts = max(LEAST_TASKS, -(-2 * n // task_rows))
    out = materialise(placed.select("node", "next", "steps", "at", *trail).repartition(parts, "at").drop("at").mapInPandas(_contract, schema), f"fragments-{level}")
    exits = out.where(~F.col("loop")).select(F.col("next").alias("node")).distinct()
    # A loop found here goes on as a link to itself where others lead into it.
    own = lambda c, x: F.when(F.col("loop"), x).otherwise(F.col(c)).alias(c)
    onward = out.select("node", own("next", F.col("node")), own("steps", F.lit(1).cast("bigint")), *[own(c, F.array().cast("array<string>")) for c in trail])
    rest = materialise(onward.join(exits, "node", "left_semi"), f"quotient-{level}")
    written += [out, rest]
    none = [F.lit(None).cast("array<string>").alias(c) for c in trail]
    looped = out.where("loop").select("node", F.lit("").alias("root"), F.lit(-1).cast("bigint").alias("depth"), *none)
    solved = _solve(rest, level + 1, task_rows, last_rows, written)
    top = solved.select(F.col("node").alias("next"), "root", F.col("depth").alias("up"), *[F.col(c).alias("above") for c in trail])
    wide = out.where(~F.col("loop")).join(top, "next", "left")
    longer = [F.when(F.col("up") < 0, None).otherwise(F.concat("trail", F.coalesce("above", F.array().cast("array<string>")))).alias(c) for c in trail]
    return wide.select(
        "node",
        F.coalesce("root", "next").alias("root"),
        F.when(F.col("up") < 0, -1).otherwise(F.col("steps") + F.coalesce("up", F.lit(0))).alias("depth"),
        *longer,
    ).unionByName(looped)


def trimmed_lower(c: Column) -> Column:
    return F.lower(F.regexp_replace(c.cast("string"), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def links_of(df: DataFrame, node: str, parent: str, norm: Callable[[Column], Column] = trimmed_lower) -> DataFrame:
    """(node, parent, given) with one row for each id; parent is NULL where blank."""
    rows = df.select(norm(F.col(f"`{node}`")).alias("node"), norm(F.col(f"`{parent}`")).alias("parent"), F.col(f"`{node}`").cast("string").alias("given"))
    rows = rows.where(F.length("node") > 0).withColumn("parent", F.when(F.length("parent") > 0, F.col("parent")))
    return rows.groupBy("node").agg(F.min("parent").alias("parent"), F.min("given").alias("given"))


def resolve_hierarchy(
    df: DataFrame, node: str, parent: str, norm: Callable[[Column], Column] = trimmed_lower, task_rows: int = TASK_ROWS, last_rows: int = LAST_ROWS, with_path: bool = False
) -> DataFrame:
    """(node, parent, root, depth[, path]) of every row; parent is the value as typed after ``norm``.

    node, root and the ids of path, which leads from the root down to the node, are spelled as in the id column.
    """
    rows = materialise(links_of(df, node, parent, norm), "hierarchy")
    known = rows.select(F.col("node").alias("parent"), F.array("given").alias("trail"))
    links = materialise(rows.join(known, "parent").select("node", F.col("parent").alias("next"), F.lit(1).cast("bigint").alias("steps"), *(["trail"] if with_path else [])), "links")
    written = [rows, links]
    solved = _solve(links, 0, task_rows, last_rows, written)
    out = rows.join(solved, "node", "left").withColumn("root", F.coalesce("root", "node"))
    spelled = rows.select(F.col("node").alias("root"), F.col("given").alias("root_given"))
    path = [F.when(F.coalesce("depth", F.lit(0)) >= 0, F.reverse(F.concat(F.array("given"), F.coalesce("trail", F.array().cast("array<string>"))))).alias("path")] if with_path else []
    got = materialise(
        out.join(spelled, "root", "left").select(
            F.col("given").alias("node"), "parent", F.coalesce("root_given", F.lit("")).alias("root"), F.coalesce("depth", F.lit(0)).cast("int").alias("depth"), *path
        ),
        "resolved",
    )
    discard(*written)
    return got


def ancestor_pairs(df: DataFrame, node: str, parent: str, norm: Callable[[Column], Column] = trimmed_lower, roots: list[str] | None = None) -> DataFrame:
    """(ancestor, descendant, distance), each node's own pair (distance 0) included, for nodes outside loops.

    With ``roots`` only the pairs of these ancestors (ids after ``norm``): their branches are filtered before any pair is made.
    """
    p = paths(df, node, parent, norm).withColumnRenamed("node", "descendant")
    asked = lambda x: norm(x).isin(*roots)
    if roots is not None:
        p = p.where(F.exists("path", asked))
    pairs = p.select("descendant", F.size("path").alias("n"), F.posexplode("path").alias("at", "ancestor"))
    if roots is not None:
        pairs = pairs.where(asked(F.col("ancestor")))
    return pairs.select("ancestor", "descendant", (F.col("n") - F.col("at") - 1).alias("distance"))


def paths(df: DataFrame, node: str, parent: str, norm: Callable[[Column], Column] = trimmed_lower) -> DataFrame:
    """(node, path): ids from the root down to the node; nodes on or below a loop have no path."""
    return resolve_hierarchy(df, node, parent, norm, with_path=True).where("path IS NOT NULL").select("node", "path")
