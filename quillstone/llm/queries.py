"""Queries of the training-data problems that belong to this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.abuse import CUT, score_documents
from quillstone.llm.encode import encode_corpus, roundtrip, tokenizer_path
from quillstone.llm.leakage import find_leaks
from quillstone.llm.linkage import link_dockets
from quillstone.llm.names import attorney_classes, class_pairs, link_judges
from quillstone.llm.pii import find_pii, firm_words, given_names, redact_column
from quillstone.llm.scannoise import find_noise, repair_sources
from quillstone.operators.packed import explode_packed
from quillstone.plans.registry import Registry
from quillstone.sources.tables import table

R = Registry()


@R.add("p8_ids")
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"), "doc_id", "text", tokenizer_path())


@R.add("p8_roundtrip")
def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Texts by number of ids and whether decoding gives them back."""
    rows = roundtrip(table(spark, d, "documents"), "doc_id", "text", tokenizer_path())
    return rows.groupBy("same").agg(F.count("*").alias("texts"), F.sum("tokens").alias("tokens"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    held_out = table(spark, d, "eval_items").where(F.lower(F.trim("split_name")).isin("validation", "test"))
    return find_leaks(table(spark, d, "documents"), held_out)


@R.add("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


@R.add("p9_items")
def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """How many documents each item leaked into, and the largest share of it that one document holds."""
    return _leaks(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("share").alias("largest_share"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return score_documents(docs, table(spark, d, "content_labels"), extra=("source",))


@R.add("p10_found")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where(F.col("score") >= CUT).select("doc_id")


@R.add("p10_scores")
def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("doc_id", F.round("score", 6).alias("score"), "worst", "sentences")


@R.add("p10_rates")
def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of offensive documents of each source."""
    source = F.lower(F.trim(F.coalesce("source", F.lit("")))).alias("source")
    bad = F.col("score") >= CUT
    return _scored(spark, d).groupBy(source).agg(F.count("*").alias("documents"), F.count_if(bad).alias("offensive"), F.round(F.avg(bad.cast("int")), 6).alias("rate"))


@R.add("p7_found")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return find_noise({n: (table(spark, d, n), "id", "plain_text") for n in ("recap_documents", "opinions")})


@R.add("p7_repaired")
def p7_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Every document and opinion as continuous paragraphs."""
    return repair_sources({n: (table(spark, d, n), "id", "plain_text") for n in ("recap_documents", "opinions")}).dropDuplicates(["src", "row_id"])


@R.add("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    given, firms = given_names(table(spark, d, "people"), "name_first"), firm_words(table(spark, d, "dockets"), "case_name")
    docs = find_pii(table(spark, d, "recap_documents"), "recap_documents", "id", "plain_text", given, firms=firms)
    contacts = find_pii(table(spark, d, "attorneys"), "attorneys", "id", "contact_raw", given, contact=True, firms=firms)
    return docs.unionByName(contacts).select("src", "row_id", "pii_kind", "start_pos")


@R.add("p5_redacted")
def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Documents and contact blocks with typed placeholders, every row."""
    given, firms = given_names(table(spark, d, "people"), "name_first"), firm_words(table(spark, d, "dockets"), "case_name")
    docs = redact_column(table(spark, d, "recap_documents"), "id", "plain_text", given, firms=firms)
    contacts = redact_column(table(spark, d, "attorneys"), "id", "contact_raw", given, contact=True, firms=firms)
    src = lambda df, name: df.select(F.lit(name).alias("src"), "row_id", "redacted")
    return src(docs, "recap_documents").unionByName(src(contacts, "attorneys"))


@R.add("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return link_dockets(table(spark, d, "free_document_rows"), table(spark, d, "dockets")).select("docket_id", "row_id")


@R.add("p4_confidence")
def p4_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Matched rows by confidence in tenths."""
    linked = link_dockets(table(spark, d, "free_document_rows"), table(spark, d, "dockets"))
    return linked.groupBy(F.floor(F.col("confidence") * 10).alias("tenth")).agg(F.count("*").alias("matches"))


def _typed_judges(spark: SparkSession, d: str) -> DataFrame:
    dockets = table(spark, d, "dockets").dropDuplicates(["id"])
    one = dockets.select(F.lit("dockets").alias("src"), F.col("id").alias("row_id"), "court_id", F.col("assigned_to_str").alias("name"), F.col("date_filed").alias("date"))
    clusters = table(spark, d, "opinion_clusters").dropDuplicates(["id"])
    panel = explode_packed(clusters, "judges", ["id", "docket_id", "date_filed"], "name", "pos", 1)
    many = panel.join(dockets.select(F.col("id").alias("docket_id"), "court_id"), "docket_id").select(F.lit("opinion_clusters").alias("src"), F.col("id").alias("row_id"), "court_id", "name", F.col("date_filed").alias("date"))
    return one.unionByName(many)


@R.add("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "people")
    judges = link_judges(_typed_judges(spark, d), people).select("src", F.col("row_id").alias("id_a"), F.col("person_id").alias("id_b"))
    pairs = class_pairs(attorney_classes(table(spark, d, "attorneys"), people))
    return judges.unionByName(pairs.select(F.lit("attorneys").alias("src"), "id_a", "id_b"))


@R.add("p3_attorney_classes")
def p3_attorney_classes(spark: SparkSession, d: str) -> DataFrame:
    """How many people or organisations stand in how many rows."""
    sizes = attorney_classes(table(spark, d, "attorneys"), table(spark, d, "people")).groupBy("cls").count()
    return sizes.groupBy(F.col("count").alias("rows")).agg(F.count("*").alias("entities"))
