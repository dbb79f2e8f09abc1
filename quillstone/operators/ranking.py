"""Relevance: BM25 over postings, more-like-this, recency, vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Letters, digits and underscore of any script.
TOKEN = r"([\p{L}\p{N}_]+)"


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(1))


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, positions, dl): one row for each term of each document."""
    t = df.select(key, tokens(F.col(text)).alias("__t")).where(F.size("__t") > 0)
    each = t.select(key, F.size("__t").alias("dl"), F.posexplode("__t").alias("pos", "term"))
    return each.groupBy(key, "term", "dl").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def _times(word: str) -> Column:
    return F.size(F.filter("__t", lambda x: x == word))


def bm25(df: DataFrame, key: str, text: str, query: list[str], k1: float = 1.2, b: float = 0.75, need_all: bool = False) -> DataFrame:
    """(key, score) of the documents that hold a query term (every term with ``need_all``).

    Only the query's terms leave the scan: their frequencies are counted in place, so nothing is shuffled but two small aggregates and the matches.
    """
    words = list(dict.fromkeys(w.lower() for w in query))
    t = df.select(key, tokens(F.col(text)).alias("__t")).where(F.size("__t") > 0)
    counted = t.select(key, F.size("__t").alias("dl"), *[_times(w).alias(f"tf{i}") for i, w in enumerate(words)])
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))]).first()  # one row
    score = F.lit(0.0)
    for i in range(len(words)):
        tf, d = F.col(f"tf{i}"), stats[f"df{i}"]
        idf = math.log(1 + (stats["n"] - d + 0.5) / (d + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / (stats["avgdl"] or 1.0)))
    some = F.lit(need_all)
    for i in range(len(words)):
        some = some & (F.col(f"tf{i}") > 0) if need_all else some | (F.col(f"tf{i}") > 0)
    return counted.where(some).select(key, score.alias("score"))


def best_fields(scores: list[Column], tie: float = 0.3) -> Column:
    """The best field's score and a share of the others'."""
    best = F.greatest(*scores)
    return best + tie * (sum(scores[1:], scores[0]) - best)


def phrase(df: DataFrame, text: str, words: list[str], slop: int = 0) -> DataFrame:
    """Documents that hold the words in order within ``slop`` extra places."""
    t = tokens(F.col(text))

    def places(w: str) -> Column:
        return F.filter(F.transform(t, lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull())

    def follow(state: Column, nxt: Column) -> Column:
        step = F.transform(state, lambda st: F.struct(st["s"].alias("s"), F.array_min(F.filter(nxt, lambda q: q > st["p"])).alias("p")))
        return F.filter(step, lambda st: st["p"].isNotNull())

    state = F.transform(places(words[0].lower()), lambda p: F.struct(p.alias("s"), p.alias("p")))
    for w in words[1:]:
        state = follow(state, places(w.lower()))
    span = len(words) - 1 + slop
    return df.where(F.exists(state, lambda st: st["p"] - st["s"] <= span))


def more_like_this(df: DataFrame, key: str, text: str, ids: list[int], terms: int = 7, min_tf: int = 2, max_df: int = 700, min_len: int = 3, min_match: int = 3) -> DataFrame:
    """(key, matched): documents sharing the most telling terms of the given ones."""
    posted = postings(df, key, text).where(F.length("term") >= min_len)
    source = posted.where(F.col(key).isin(ids)).groupBy("term").agg(F.sum("tf").alias("tf")).where(F.col("tf") >= min_tf)
    freq = posted.join(F.broadcast(source.select("term")), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") <= max_df)
    n = df.count()
    pick = source.join(freq, "term").withColumn("w", F.col("tf") * F.log(F.lit(float(n)) / F.col("df"))).orderBy(F.desc("w"), "term").limit(terms)
    return posted.where(~F.col(key).isin(ids)).join(F.broadcast(pick.select("term")), "term").groupBy(key).agg(F.count("*").alias("matched")).where(F.col("matched") >= min_match)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest(df: DataFrame, key: str, vector: str, query: list[float], k: int, least: float | None = None, condition: Column | None = None) -> DataFrame:
    """(key, score): the k vectors of largest dot product; filters hold before the ranking."""
    kept = df if condition is None else df.where(condition)
    scored = kept.select(key, dot(F.col(vector), F.array(*[F.lit(float(x)) for x in query])).alias("score"))
    if least is not None:
        scored = scored.where(F.col("score") >= least)
    return scored.orderBy(F.desc("score"), key).limit(k)


def top_per_group(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)
