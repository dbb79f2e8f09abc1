"""Citations: extraction from text, resolution to cases, edges and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Reporters of the court tables.
REPORTERS = ("Ard. 2d", "App. Rep.", "Prov. Ct.", "Fed. Dec.", "Belm. 3d")


def _pattern(reporters: Sequence[str]) -> str:
    names = "|".join(r.replace(".", r"\.").replace(" ", r"\s+") for r in reporters)
    return rf"\b(\d{{1,4}})\s+({names})\s+(\d{{1,5}})\b"


def _found(df: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, seq, pos, cite): every match in order; pos is the number of words before it."""
    pieces = F.split(F.regexp_replace(F.col(text), pattern, "\u0001$0"), "\u0001")
    words = F.transform(pieces, lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w != "")))
    each = df.select(key, F.posexplode(F.slice(F.zip_with(pieces, words, lambda p, n: F.struct(p.alias("piece"), n.alias("n"))), 2, 1_000_000_000)).alias("seq", "m"), F.get(words, F.lit(0)).alias("first"), words.alias("words"))
    before = F.aggregate(F.slice("words", F.lit(1), F.col("seq") + 1), F.lit(0), lambda s, x: s + x)
    return each.select(key, "seq", before.alias("pos"), F.regexp_extract("m.piece", f"^{pattern}", 0).alias("cite"))


def extract(df: DataFrame, key: str, text: str, reporters: Sequence[str] = REPORTERS) -> DataFrame:
    """(key, seq, pos, volume, reporter, page): every full citation of a text, in order, and the number of words before it. JVM expressions only."""
    p = _pattern(reporters)
    part = lambda i: F.regexp_extract("cite", p, i)
    return _found(df, key, text, p).select(key, "seq", "pos", part(1).cast("int").alias("volume"), F.regexp_replace(part(2), r"\s+", " ").alias("reporter"), part(3).cast("int").alias("page"))


def extract_short(df: DataFrame, key: str, text: str, reporters: Sequence[str] = REPORTERS) -> DataFrame:
    """(key, seq, pos, volume, reporter, pin): every short citation "410 Ard. 2d at 12" of a text."""
    names = "|".join(r.replace(".", r"\.").replace(" ", r"\s+") for r in reporters)
    p = rf"\b(\d{{1,4}})\s+({names}),?\s+at\s+(\d{{1,5}})\b"
    part = lambda i: F.regexp_extract("cite", p, i)
    return _found(df, key, text, p).select(key, "seq", "pos", part(1).cast("int").alias("volume"), F.regexp_replace(part(2), r"\s+", " ").alias("reporter"), part(3).cast("int").alias("pin"))


def extract_supra(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, seq, pos, name): every "Name, supra" of a text with the antecedent name before it."""
    p = r"\b([A-Z][\w'’\-]+),?\s+supra\b"
    return _found(df, key, text, p).select(key, "seq", "pos", F.regexp_extract("cite", p, 1).alias("name"))


def resolve_supra(supras: DataFrame, full: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Supra citations by the cases cited in full in the same document whose name holds the antecedent, only where one fits; ``names`` has case_id and case_name."""
    cited = full.where("status = 'matched'").select(key, "case_id").distinct().join(names, "case_id")
    fits = supras.join(cited, key).where(F.array_contains(F.split(F.lower("case_name"), r"[^\p{L}\p{N}'’\-]+"), F.lower("name")))
    one = fits.groupBy(key, "seq").agg(F.count_distinct("case_id").alias("n"), F.min("case_id").alias("case_id")).where("n = 1").drop("n")
    return supras.join(one, [key, "seq"], "left")


def resolve(cites: DataFrame, cases: DataFrame, own: str | None = None) -> DataFrame:
    """Each citation with status 'matched' (one case), 'ambiguous' (several) or 'unmatched', and the case.

    ``cases`` has volume, reporter, page and case_id. With ``own`` the case of
    the citing document, citations of itself are left out.
    """
    known = cases.groupBy("volume", "reporter", "page").agg(F.count_distinct("case_id").alias("n"), F.min("case_id").alias("case_id"))
    got = cites.join(known, ["volume", "reporter", "page"], "left")
    if own:
        got = got.where(F.col("case_id").isNull() | (F.col("n") > 1) | (F.col("case_id") != F.col(own)))
    status = F.when(F.col("n") == 1, "matched").when(F.col("n") > 1, "ambiguous").otherwise("unmatched")
    return got.select(*cites.columns, status.alias("status"), F.when(F.col("n") == 1, F.col("case_id")).alias("case_id"))


def resolve_short(shorts: DataFrame, full: DataFrame, key: str) -> DataFrame:
    """Short citations (key, volume, reporter) by the full ones resolved in the same document: only where one case fits."""
    one = full.where("status = 'matched'").groupBy(key, "volume", "reporter").agg(F.count_distinct("case_id").alias("n"), F.min("case_id").alias("case_id"))
    return shorts.join(one.where("n = 1").drop("n"), [key, "volume", "reporter"], "left")


def edges(resolved: DataFrame, citing: str) -> DataFrame:
    """(citing, cited, depth): how often one document cites a case."""
    return resolved.where("status = 'matched'").groupBy(F.col(citing).alias("citing"), F.col("case_id").alias("cited")).agg(F.count("*").alias("depth"))


def parallel_runs(cites: DataFrame, key: str, position: str, distance: int) -> DataFrame:
    """(key, run, cites): runs of two or more citations whose places lie less than ``distance`` apart; a run whose reverse was seen before is left out."""
    from quillstone.operators.sequence import position_sessions

    label = F.concat_ws(" ", "volume", "reporter", "page")
    runs = position_sessions(cites.withColumn("__c", label), key, position, distance)
    listed = runs.groupBy(key, "run").agg(F.transform(F.array_sort(F.collect_list(F.struct(position, "__c"))), lambda x: x["__c"]).alias("cites")).where(F.size("cites") > 1)
    canon = F.least(F.array_join("cites", "|"), F.array_join(F.reverse("cites"), "|"))
    w = Window.partitionBy(canon).orderBy(key, "run")
    return listed.withColumn("__first", F.first(F.array_join("cites", "|")).over(w)).where(F.col("__first") == F.array_join("cites", "|")).drop("__first")


def annotate(df: DataFrame, text: str, link: str = "/c/{r}/{v}/{p}/", reporters: Sequence[str] = REPORTERS) -> Column:
    """The text with every full citation wrapped in a link."""
    href = link.replace("{v}", "$1").replace("{r}", "$2").replace("{p}", "$3")
    return F.regexp_replace(F.col(text), _pattern(reporters), f'<a href="{href}">$0</a>')


def lookup_status(cites: DataFrame, cases: DataFrame, reporters: Sequence[str] = REPORTERS) -> DataFrame:
    """Status codes of asked citations: 200 one case, 300 several, 404 none, 400 unknown reporter."""
    got = resolve(cites, cases)
    code = F.when(~F.col("reporter").isin(list(reporters)), 400).when(F.col("status") == "matched", 200).when(F.col("status") == "ambiguous", 300).otherwise(404)
    return got.select(*cites.columns, code.alias("code"))
