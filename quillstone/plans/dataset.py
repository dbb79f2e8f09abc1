"""Queries of the general dataset problems: redelivery, packed fields, hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.hierarchy import ancestor_pairs, paths, resolve_hierarchy
from quillstone.operators.packed import explode_packed
from quillstone.operators.redelivery import RedeliveryFilter
from quillstone.plans.registry import Registry
from quillstone.sources.tables import path_of, table

R = Registry()

_KEYED = """WITH k AS (SELECT *, lower(regexp_replace(regexp_replace(mail_message_id, '^[\\s<>]+', ''), '[\\s<>]+$', '')) AS key FROM court_emails),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY receipt_timestamp ASC NULLS LAST, delivery_id ASC NULLS LAST) AS rn FROM k)
"""


def _emails(spark: SparkSession, d: str) -> RedeliveryFilter:
    return RedeliveryFilter(spark, path_of(d, "court_emails"), "mail_message_id", "receipt_timestamp", "delivery_id")


@R.add("p1_found", _KEYED + "SELECT delivery_id FROM r WHERE key IS NOT NULL AND key <> '' AND rn > 1")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _emails(spark, d).surplus(["delivery_id"])


@R.add("p1_kept", _KEYED + "SELECT r.* EXCLUDE (key, rn) FROM r WHERE key IS NULL OR key = '' OR rn = 1")
def p1_kept(spark: SparkSession, d: str) -> DataFrame:
    return _emails(spark, d).kept()


def _judges(spark: SparkSession, d: str, least: int) -> DataFrame:
    parts = []
    for src in ("opinion_clusters", "audio"):
        rows = table(spark, d, src).select("id", "judges").dropDuplicates(["id"])
        parts.append(explode_packed(rows, "judges", ["id"], "judge", "pos", least).select(F.lit(src).alias("src"), F.col("id").alias("row_id"), "pos", "judge"))
    return parts[0].unionByName(parts[1])


@R.add("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _judges(spark, d, 2)


@R.add("p2_panel_sizes")
def p2_panel_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many fields hold how many judges."""
    return _judges(spark, d, 1).groupBy("src", "row_id").count().groupBy("src", F.col("count").alias("judges")).agg(F.count("*").alias("fields"))


def _trees(spark: SparkSession, d: str) -> list[tuple[str, DataFrame, str]]:
    return [("courts", table(spark, d, "courts"), "parent_court_id"), ("people", table(spark, d, "people"), "is_alias_of_id")]


_TRIM = "regexp_replace(lower({}), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
_WALK = f"""
WITH RECURSIVE t AS (
  SELECT 'courts' AS kind, {_TRIM.format('id')} AS node, min(nullif({_TRIM.format('parent_court_id')}, '')) AS parent, min(id) AS given FROM courts WHERE trim(id) <> '' GROUP BY ALL
  UNION ALL
  SELECT 'people', CAST(id AS VARCHAR), min(CAST(is_alias_of_id AS VARCHAR)), min(CAST(id AS VARCHAR)) FROM people WHERE id IS NOT NULL GROUP BY id),
r AS (SELECT kind, node, min(parent) AS parent, min(given) AS given FROM t GROUP BY kind, node),
w AS (
  SELECT r.kind, r.node, r.given, r.given AS path, 0 AS depth FROM r LEFT JOIN r p ON p.kind = r.kind AND p.node = r.parent WHERE p.node IS NULL
  UNION ALL
  SELECT c.kind, c.node, c.given, w.path || ' > ' || c.given, w.depth + 1 FROM r c JOIN w ON w.kind = c.kind AND w.node = c.parent)
"""


@R.add(
    "p6_found",
    _WALK + "SELECT r.kind AS node_kind, r.given AS node_id, coalesce(split_part(w.path, ' > ', 1), '') AS root_id, coalesce(w.depth, -1) AS depth FROM r LEFT JOIN w ON w.kind = r.kind AND w.node = r.node WHERE r.parent IS NOT NULL",
)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        resolve_hierarchy(df, "id", parent).where(F.col("parent").isNotNull()).select(F.lit(kind).alias("node_kind"), F.col("node").alias("node_id"), F.col("root").alias("root_id"), "depth")
        for kind, df, parent in _trees(spark, d)
    ]
    return parts[0].unionByName(parts[1])


@R.add(
    "p6_descendants",
    _WALK + ", up AS (SELECT kind, node, node AS top, given AS top_given, 0 AS distance FROM w UNION ALL SELECT up.kind, c.node, up.top, up.top_given, up.distance + 1 FROM up JOIN r c ON c.kind = up.kind AND c.parent = up.node) SELECT up.kind AS node_kind, up.top_given AS ancestor, r.given AS descendant, up.distance FROM up JOIN r ON r.kind = up.kind AND r.node = up.node WHERE up.distance > 0",
)
def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    parts = [ancestor_pairs(df, "id", parent).where("distance > 0").select(F.lit(kind).alias("node_kind"), "ancestor", "descendant", "distance") for kind, df, parent in _trees(spark, d)]
    return parts[0].unionByName(parts[1])


@R.add("p6_paths", _WALK + "SELECT kind AS node_kind, given AS node_id, path, depth FROM w")
def p6_paths(spark: SparkSession, d: str) -> DataFrame:
    """The full path of every row outside loops, from its root down."""
    parts = [paths(df, "id", parent).select(F.lit(kind).alias("node_kind"), F.col("node").alias("node_id"), F.array_join("path", " > ").alias("path"), (F.size("path") - 1).alias("depth")) for kind, df, parent in _trees(spark, d)]
    return parts[0].unionByName(parts[1])
