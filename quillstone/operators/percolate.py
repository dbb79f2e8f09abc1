"""Stored queries run against documents.

A stored query is an OR of ANDs given as clauses (alert_id, branch, field, value).
Documents are turned into (field, value) features; a branch matches where all
its clauses are met. This is an equi-join on (field, value), so the alerts side
may be as large as the documents; it is broadcast only within a checked size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.session import BROADCAST_BYTES


def features(df: DataFrame, key: str, keyword_fields: list[str], text_fields: list[str]) -> DataFrame:
    """(key, field, value): the values of keyword fields and the words of text fields."""
    parts = [df.select(key, F.lit(f).alias("field"), F.lower(F.col(f).cast("string")).alias("value")) for f in keyword_fields]
    parts += [df.select(key, F.lit(f).alias("field"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(f)), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))).alias("value")) for f in text_fields]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("value").isNotNull())


def percolate(feats: DataFrame, clauses: DataFrame, key: str) -> DataFrame:
    """(alert_id, key): alerts met by each document."""
    q = clauses.select("alert_id", "branch", "field", F.lower("value").alias("value")).distinct()
    need = q.groupBy("alert_id", "branch").agg(F.count("*").alias("need"))
    if q.count() * 200 <= BROADCAST_BYTES:
        q, need = F.broadcast(q), F.broadcast(need)
    met = feats.join(q, ["field", "value"]).groupBy(key, "alert_id", "branch").agg(F.count_distinct("field", "value").alias("met"))
    return met.join(need, ["alert_id", "branch"]).where("met = need").select("alert_id", key).distinct()


def unseen(hits: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Hits whose keys were not recorded before."""
    return hits.join(seen.select(*keys), keys, "left_anti").dropDuplicates(keys)


def capped(hits: DataFrame, alert: str, parent: str, child: str, most_children: int, most_parents: int) -> DataFrame:
    """Hits within the limit of children for each parent (checked first) and of parents for each alert.

    The limits are the digest's feature; what lies beyond is reported by the flag remaining of the parent's rows.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(alert, parent)
    a = hits.withColumn("__c", F.row_number().over(w.orderBy(child))).withColumn("remaining", F.max("__c").over(w) > most_children).where(F.col("__c") <= most_children)
    p = a.withColumn("__p", F.dense_rank().over(Window.partitionBy(alert).orderBy(parent))).where(F.col("__p") <= most_parents)
    return p.drop("__c", "__p")
