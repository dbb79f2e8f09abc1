"""Relational queries over the court tables: scans, filters, joins, aggregates, windows, order, sets.

Queries whose text is the same in both dialects are registered by ``both``;
the others name their DataFrame plan and its SQL twin side by side.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import dockets as D
from quillstone.operators import family, paging, predicates, ranking, sequence
from quillstone.operators.hierarchy import ancestor_pairs
from quillstone.plans.registry import Registry
from quillstone.sources.tables import table, views

R = Registry()
c = F.col


def both(name: str, tables: str, sql: str, twin: str | None = None) -> None:
    """A query given in Spark SQL; ``twin`` is the other dialect's text where it differs."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        views(spark, d, *tables.split())
        return spark.sql(sql)

    R.add(name, twin or sql)(run)


#: One row for each id; a column that a query doesn't use is pruned with its aggregate, down to the scan.
DOCS = "(SELECT id, max(docket_id) AS docket_id, max(court_id) AS court_id, max(entry_number) AS entry_number, max(entry_date_filed) AS entry_date_filed, max(document_number) AS document_number, max(attachment_number) AS attachment_number, max(document_type) AS document_type, max(is_available) AS is_available, max(page_count) AS page_count, max(pacer_doc_id) AS pacer_doc_id, max(ocr_status) AS ocr_status, max(date_upload) AS date_upload, max(description) AS description FROM recap_documents GROUP BY id)"
OPS = "(SELECT id, max(cluster_id) AS cluster_id, max(opinion_type) AS opinion_type, max(author_id) AS author_id, max(sha1) AS sha1, max(extracted_by_ocr) AS extracted_by_ocr, max(page_count) AS page_count, max(ordering_key) AS ordering_key FROM opinions GROUP BY id)"
PPL = "(SELECT DISTINCT * FROM people)"
AUD = "(SELECT DISTINCT * FROM audio)"


def docs(spark: SparkSession, d: str) -> DataFrame:
    kept = ("docket_id", "court_id", "entry_number", "entry_date_filed", "document_number", "attachment_number", "document_type", "is_available", "page_count", "pacer_doc_id", "date_upload", "description")
    return table(spark, d, "recap_documents").groupBy("id").agg(*[F.max(k).alias(k) for k in kept])


# Scans -----------------------------------------------------------------------------------------------------------


@R.add("src01_keyset_scan", "SELECT id, case_name FROM dockets WHERE court_id = 'arsd' AND id > 100 ORDER BY id LIMIT 50")
def src01(spark, d):
    return paging.keyset_batch(table(spark, d, "dockets").where("court_id = 'arsd'").select("id", "case_name"), "id", 100, 50)


both("src02_entity_counts", "opinions opinion_clusters dockets people", f"SELECT (SELECT count(*) FROM dockets) AS dockets, (SELECT count(DISTINCT o.id) FROM opinions o JOIN opinion_clusters k ON o.cluster_id = k.id WHERE k.precedential_status = 'Published') AS published, (SELECT count(*) FROM opinion_clusters WHERE source_code LIKE '%R%') AS from_r, (SELECT count(*) FROM {PPL} p WHERE position('a' IN name_first) = 0) AS no_a")
both("src06_available_share", "recap_documents", f"SELECT count(*) AS n, sum(CASE WHEN is_available THEN 1 ELSE 0 END) AS available FROM {DOCS} x")
both("src14_crosswalk", "dockets free_document_rows", "SELECT f.id AS row_id, k.id AS docket_id FROM free_document_rows f JOIN dockets k ON concat(f.court_id, '/', f.docket_number) = concat(k.court_id, '/', k.docket_number)")


@R.add("src03_sample")
def src03(spark, d):
    """A tenth of the available documents, at random but repeatable (sampling is the feature)."""
    return table(spark, d, "recap_documents").where("is_available").select("id").sample(0.1, seed=7)


@R.add("src05_footer_rows")
def src05(spark, d):
    """Row counts as the Parquet metadata gives them; no data page is read."""
    parts = [table(spark, d, t).agg(F.count("*").alias("rows")).select(F.lit(t).alias("name"), "rows") for t in ("dockets", "opinions", "audio")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


both("snk01_flat_export", "dockets recap_documents", f"SELECT r.id, r.document_number, k.court_id, k.case_name FROM {DOCS} r JOIN dockets k ON r.docket_id = k.id ORDER BY r.id LIMIT 250")
both("snk10_monthly_coverage", "recap_documents", f"SELECT year(date_upload) AS y, month(date_upload) AS m, count(*) AS n FROM {DOCS} x WHERE date_upload IS NOT NULL GROUP BY year(date_upload), month(date_upload)")
both("snk11_feed", "dockets", "SELECT id, case_name, date_filed FROM dockets WHERE date_filed IS NOT NULL ORDER BY date_filed DESC, id DESC LIMIT 20")
both("snk12_court_feed", "dockets", "SELECT id, case_name, date_filed FROM dockets WHERE date_filed IS NOT NULL AND court_id = 'arsd' ORDER BY date_filed DESC, id DESC LIMIT 20")

# Projections -------------------------------------------------------------------------------------------------------

both("prj05_hits_with_docket_fields", "opinion_clusters dockets", "SELECT k.id, k.case_name, d.court_id, d.docket_number FROM opinion_clusters k LEFT JOIN dockets d ON k.docket_id = d.id")
both("prj07_court_citations", "dockets courts", "SELECT d.id, c.citation_string FROM dockets d LEFT JOIN courts c ON d.court_id = c.id")


@R.add("prj09_docket_attorneys", "SELECT docket_id, list(DISTINCT attorney_name ORDER BY attorney_name) AS names FROM attorneys WHERE attorney_name IS NOT NULL GROUP BY docket_id")
def prj09(spark, d):
    return table(spark, d, "attorneys").groupBy("docket_id").agg(F.array_sort(F.collect_set("attorney_name")).alias("names")).where(F.size("names") > 0)


both("prj10_flat_children", "recap_documents dockets", f"SELECT r.id, r.entry_number, d.case_name, d.date_filed, d.nature_of_suit FROM {DOCS} r JOIN dockets d ON r.docket_id = d.id")
both("prj12_sparse_fields", "opinion_clusters", "SELECT id, case_name FROM opinion_clusters")
both("prj06_positions", "people", "SELECT court_id, count(*) AS people, min(date_start) AS first_start, max(date_termination) AS last_end FROM (SELECT DISTINCT id, court_id, date_start, date_termination FROM people) p WHERE court_id IS NOT NULL GROUP BY court_id")

# Filters -----------------------------------------------------------------------------------------------------------


@R.add("flt01_terms", "SELECT id FROM dockets WHERE court_id IN ('arsd','kesd') AND nature_of_suit = '830 Patent'")
def flt01(spark, d):
    return predicates.all_of(table(spark, d, "dockets"), predicates.term("court_id", ["arsd", "", "kesd"]), predicates.term("nature_of_suit", "830 Patent"), predicates.term("cause", "")).select("id")


@R.add("flt03_number_range", "SELECT id FROM opinion_clusters WHERE citation_count BETWEEN 2 AND 8")
def flt03(spark, d):
    return predicates.all_of(table(spark, d, "opinion_clusters"), predicates.number_range("citation_count", 2, 8), predicates.number_range("docket_id", 0, None)).select("id")


@R.add("flt04_date_range", "SELECT id FROM dockets WHERE date_filed >= DATE '2010-01-01' AND date_filed <= DATE '2012-06-30'")
def flt04(spark, d):
    return predicates.all_of(table(spark, d, "dockets"), predicates.date_range("date_filed", "2010-01-01", "2012-06-30")).select("id")


@R.add("flt05_relative_date", "SELECT id FROM dockets WHERE date_filed >= DATE '2024-01-01' - 730")
def flt05(spark, d):
    return predicates.all_of(table(spark, d, "dockets"), predicates.date_range("date_filed", "past 2 years", None, dt.date(2024, 1, 1))).select("id")


@R.add("flt07_text_filter", "SELECT id FROM dockets WHERE list_contains(regexp_extract_all(lower(case_name), '[\\p{L}\\p{N}_]+'), 'united') AND list_contains(regexp_extract_all(lower(case_name), '[\\p{L}\\p{N}_]+'), 'states')")
def flt07(spark, d):
    t = ranking.tokens(c("case_name"))
    return table(spark, d, "dockets").where(F.array_contains(t, "united") & F.array_contains(t, "states")).select("id")


both("flt08_plain_filters", "audio", f"SELECT id FROM {AUD} a WHERE duration > 1200 AND date_argued >= DATE '2005-01-01' AND case_name LIKE '%Group%'")
both("flt09_parent_filters", "opinion_clusters dockets", "SELECT k.id FROM opinion_clusters k JOIN dockets d ON k.docket_id = d.id WHERE d.court_id = 'arsd' AND k.precedential_status = 'Published' AND k.citation_count >= 1 AND k.date_filed > DATE '2004-12-31'")
both("flt10_child_filters", "recap_documents", f"SELECT id FROM {DOCS} r WHERE is_available AND document_type = 2 AND attachment_number <= 3 AND description LIKE 'ORDER%'")
both("flt11_exists", "dockets", "SELECT id FROM dockets WHERE date_terminated IS NOT NULL")


@R.add("flt12_courts_with_descendants", "WITH RECURSIVE t AS (SELECT id FROM courts WHERE id IN ('cosup','zesup') UNION SELECT k.id FROM courts k JOIN t ON lower(trim(k.parent_court_id)) = t.id) SELECT count(*) AS n FROM dockets WHERE court_id IN (SELECT id FROM t)")
def flt12(spark, d):
    below = ancestor_pairs(table(spark, d, "courts"), "id", "parent_court_id", roots=["cosup", "zesup"]).select(c("descendant").alias("court_id"))
    return table(spark, d, "dockets").join(F.broadcast(below.distinct()), "court_id", "left_semi").agg(F.count("*").alias("n"))


@R.add("flt13_descendants", "WITH RECURSIVE t AS (SELECT id FROM courts WHERE id IN ('cosup','zesup') UNION SELECT k.id FROM courts k JOIN t ON lower(trim(k.parent_court_id)) = t.id) SELECT id FROM t WHERE id NOT IN ('cosup','zesup')")
def flt13(spark, d):
    return ancestor_pairs(table(spark, d, "courts"), "id", "parent_court_id", roots=["cosup", "zesup"]).where(c("distance") > 0).select(c("descendant").alias("id")).distinct()


@R.add("flt16_lookups", "SELECT id FROM dockets WHERE date_filed BETWEEN DATE '2005-01-01' AND DATE '2015-12-31' AND month(date_filed) = 6 AND lower(case_name) LIKE 'united%' AND id > 10")
def flt16(spark, d):
    return predicates.lookups(table(spark, d, "dockets"), ["date_filed", "case_name", "id"], date_filed__range=(dt.date(2005, 1, 1), dt.date(2015, 12, 31)), date_filed__month=6, case_name__istartswith="United", id__gt=10).select("id")


both("flt17_related_filter", "opinion_clusters dockets courts", "SELECT k.id FROM opinion_clusters k WHERE EXISTS (SELECT 1 FROM dockets d WHERE d.id = k.docket_id AND EXISTS (SELECT 1 FROM courts c WHERE c.id = d.court_id AND c.jurisdiction = 'FB'))")
both("flt18_opinion_filters", "opinions opinion_clusters", f"SELECT o.id FROM {OPS} o WHERE o.page_count > 2 AND EXISTS (SELECT 1 FROM opinion_clusters k WHERE k.id = o.cluster_id AND k.precedential_status <> 'Unpublished')")
both("flt19_people_filters", "people courts", f"SELECT p.id FROM {PPL} p WHERE p.gender = 'f' AND year(p.date_dob) < 1950 AND EXISTS (SELECT 1 FROM courts c WHERE c.id = p.court_id AND c.in_use)")
both("flt22_filtered_members", "attorneys dockets", "SELECT d.id, count(a.id) AS named FROM dockets d JOIN attorneys a ON a.docket_id = d.id WHERE a.attorney_name LIKE '%LLP%' GROUP BY d.id")


@R.add("flt25_prefix_any", "SELECT DISTINCT id FROM people WHERE lower(coalesce(name_first,'')) LIKE 'al%' OR lower(coalesce(name_middle,'')) LIKE 'al%' OR lower(coalesce(name_last,'')) LIKE 'al%' OR lower(coalesce(name_first,'')) LIKE 'wo%' OR lower(coalesce(name_middle,'')) LIKE 'wo%' OR lower(coalesce(name_last,'')) LIKE 'wo%'")
def flt25(spark, d):
    return table(spark, d, "people").where(predicates.prefix_any(["name_first", "name_middle", "name_last"], ["Al", "Wo"])).select("id").distinct()


# Scores ------------------------------------------------------------------------------------------------------------


@R.add("scr01_recency_score", "SELECT id, round((1 - 0.5) + (0.1 + 0.9 * exp(ln(0.2) / (50 * 365.0) * abs(date_diff('day', coalesce(date_filed, DATE '1600-01-01'), DATE '2024-01-01')))) * 0.5, 6) AS score FROM dockets")
def scr01(spark, d):
    return table(spark, d, "dockets").select("id", F.round(D.recency_factor(c("date_filed"), F.lit("2024-01-01").cast("date"), 50, 0.2, 0.1, 0.5), 6).alias("score"))


@R.add("scr03_date_score", "SELECT id, CASE WHEN date_filed IS NULL THEN 0 ELSE epoch_ms(date_filed::TIMESTAMP) + 11676096000000 END AS newest, CASE WHEN date_filed IS NULL OR date_filed > DATE '2024-01-01' THEN 0 ELSE epoch_ms(DATE '2024-01-01'::TIMESTAMP) - epoch_ms(date_filed::TIMESTAMP) END AS oldest FROM dockets")
def scr03(spark, d):
    ms = F.unix_millis(c("date_filed").cast("timestamp"))
    now = F.unix_millis(F.lit("2024-01-01").cast("timestamp"))
    return table(spark, d, "dockets").select("id", F.when(c("date_filed").isNull(), 0).otherwise(ms + 11676096000000).alias("newest"), F.when(c("date_filed").isNull() | (now < ms), 0).otherwise(now - ms).alias("oldest"))


@R.add("scr04_no_score", "SELECT id, 0.0::DOUBLE AS score FROM dockets")
def scr04(spark, d):
    return table(spark, d, "dockets").select("id", F.lit(0.0).alias("score"))


_Q = [round(0.125 * (1 if i % 3 else -1), 3) for i in range(64)]
_DOT = "list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * " + str(_Q) + "[i]))"


@R.add("scr08_nearest", f"SELECT vec_id, round({_DOT}, 6) AS score FROM embeddings WHERE label <> 3 ORDER BY {_DOT} DESC, vec_id LIMIT 5")
def scr08(spark, d):
    return ranking.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", _Q, 5, None, c("label") != 3).select("vec_id", F.round("score", 6).alias("score"))


@R.add("scr11_best_chunk", f"SELECT label, arg_max(vec_id, (s, -vec_id)) AS vec_id, round(max(s), 6) AS score FROM (SELECT *, {_DOT} AS s FROM embeddings) GROUP BY label")
def scr11(spark, d):
    s = table(spark, d, "embeddings").select("label", "vec_id", ranking.dot(c("embedding"), F.array(*[F.lit(x) for x in _Q])).alias("s"))
    return s.groupBy("label").agg(F.max_by("vec_id", F.struct("s", -c("vec_id"))).alias("vec_id"), F.round(F.max("s"), 6).alias("score"))


@R.add("scr13_bm25", r"""WITH t AS (SELECT id, regexp_extract_all(lower(case_name), '[\p{L}\p{N}_]+') AS w FROM dockets WHERE len(regexp_extract_all(lower(case_name), '[\p{L}\p{N}_]+')) > 0),
k AS (SELECT id, len(w) AS dl, len(list_filter(w, lambda x: x = 'united')) AS a, len(list_filter(w, lambda x: x = 'kestrel')) AS b FROM t),
s AS (SELECT count(*) AS n, avg(dl) AS av, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM k)
SELECT id, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / av)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / av)), 6) AS score FROM k, s WHERE a > 0 OR b > 0""")
def scr13(spark, d):
    return ranking.bm25(table(spark, d, "dockets"), "id", "case_name", ["united", "kestrel"]).select("id", F.round("score", 6).alias("score"))


@R.add("scr06_more_like_this")
def scr06(spark, d):
    return ranking.more_like_this(table(spark, d, "documents").where("text IS NOT NULL"), "doc_id", "text", [1, 2, 3])


@R.add("flt02_phrase", "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])motion[^\\p{L}\\p{N}_]+for[^\\p{L}\\p{N}_]+summary[^\\p{L}\\p{N}_]+judgment([^\\p{L}\\p{N}_]|$)')")
def flt02(spark, d):
    return ranking.phrase(table(spark, d, "documents"), "text", ["motion", "for", "summary", "judgment"]).select("doc_id")


both("scr19_authority_order", "lineitem", "SELECT l_partkey AS authority, count(DISTINCT l_orderkey) AS filings, sum(l_linenumber) AS depth FROM lineitem GROUP BY l_partkey ORDER BY filings DESC, depth DESC, authority LIMIT 50")

# Joins ---------------------------------------------------------------------------------------------------------------


@R.add("jon01_has_child", f"SELECT d.id, max(r.page_count) AS child_score FROM dockets d JOIN {DOCS} r ON r.docket_id = d.id WHERE r.is_available AND r.page_count IS NOT NULL GROUP BY d.id")
def jon01(spark, d):
    return family.has_child(table(spark, d, "dockets").select("id"), docs(spark, d), "id", "docket_id", c("is_available") & c("page_count").isNotNull(), c("page_count"))


@R.add("jon02_inner_hits", f"SELECT docket_id, id, rn AS child_rank FROM (SELECT *, row_number() OVER (PARTITION BY docket_id ORDER BY page_count DESC NULLS LAST, document_number ASC NULLS LAST, attachment_number ASC NULLS LAST, id) AS rn FROM {DOCS}) WHERE rn <= 3")
def jon02(spark, d):
    return family.best_children(docs(spark, d), "docket_id", [c("page_count").desc_nulls_last(), c("document_number").asc_nulls_last(), c("attachment_number").asc_nulls_last(), c("id").asc()], 3).select("docket_id", "id", "child_rank")


@R.add("jon07_child_remaining", f"SELECT docket_id, count(*) > 3 AS child_remaining FROM {DOCS} GROUP BY docket_id")
def jon07(spark, d):
    return family.best_children(docs(spark, d), "docket_id", [c("id").asc()], 3).groupBy("docket_id").agg(F.max("child_remaining").alias("child_remaining"))


@R.add("jon03_has_parent", f"SELECT r.id FROM {DOCS} r WHERE r.docket_id IN (SELECT docket_id FROM attorneys WHERE attorney_name LIKE '%LLP%')")
def jon03(spark, d):
    return family.has_parent(docs(spark, d), table(spark, d, "attorneys"), "docket_id", "docket_id", c("attorney_name").like("%LLP%")).select("id")


@R.add("jon04_family_search", f"SELECT DISTINCT d.id FROM dockets d WHERE d.court_id = 'arsd' AND (EXISTS (SELECT 1 FROM {DOCS} r WHERE r.docket_id = d.id AND r.description LIKE 'MOTION%' AND r.is_available) OR (d.case_name LIKE '%Freight%' AND EXISTS (SELECT 1 FROM {DOCS} r WHERE r.docket_id = d.id AND r.is_available)))")
def jon04(spark, d):
    return family.family_search(table(spark, d, "dockets").select("id", "court_id", "case_name"), docs(spark, d), "id", "docket_id", c("description").like("MOTION%"), c("case_name").like("%Freight%"), c("is_available"), c("court_id") == "arsd").select("id")


both("jon05_match_all", "dockets recap_documents", f"SELECT d.id, count(r.id) AS children FROM dockets d LEFT JOIN {DOCS} r ON r.docket_id = d.id GROUP BY d.id")
both("jon06_children_of_parents", "dockets recap_documents", f"SELECT r.id FROM {DOCS} r WHERE EXISTS (SELECT 1 FROM dockets d WHERE d.id = r.docket_id AND d.cause = '42:1983') AND r.entry_date_filed IS NOT NULL")
both("jon09_inner_join", "opinions opinion_clusters", f"SELECT o.id, k.case_name FROM {OPS} o JOIN opinion_clusters k ON o.cluster_id = k.id WHERE k.citation_count > 3")
both("jon10_distinct_join", "people dockets", f"SELECT DISTINCT p.id FROM {PPL} p JOIN dockets d ON p.court_id = d.court_id WHERE d.nature_of_suit = '830 Patent'")
both("jon11_exists_flag", "opinion_clusters opinions", f"SELECT k.id, EXISTS (SELECT 1 FROM {OPS} o WHERE o.cluster_id = k.id AND o.author_id IS NOT NULL) AS authored FROM opinion_clusters k", None)
both("jon12_exists_filter", "people opinions", f"SELECT p.id FROM {PPL} p WHERE p.is_alias_of_id IS NULL AND EXISTS (SELECT 1 FROM {OPS} o WHERE o.author_id = p.id)")
both("jon13_exclusion", "dockets free_document_rows", "SELECT d.id FROM dockets d WHERE NOT EXISTS (SELECT 1 FROM free_document_rows f WHERE f.court_id = d.court_id AND f.error_msg = 'timeout')")
both("jon14_in_and_group", "dockets recap_documents", f"SELECT d.court_id, count(*) AS n FROM dockets d WHERE d.id IN (SELECT docket_id FROM {DOCS} r WHERE r.page_count > 10) GROUP BY d.court_id")
both("jon15_changed_slug", "people", "SELECT id, count(DISTINCT slug) AS slugs FROM people GROUP BY id HAVING count(DISTINCT slug) > 1 OR max(slug) <> concat(lower(max(name_first)), '-', lower(max(name_last)))")
both("jon16_computed_key", "dockets events", "SELECT d.id, e.views FROM dockets d LEFT JOIN (SELECT concat('d.', cast(user_id AS varchar(20)), ':view') AS k, count(*) AS views FROM events GROUP BY user_id) e ON e.k = concat('d.', cast(d.id AS varchar(20)), ':view')")
both("jon17_default_subquery", "dockets audio", f"SELECT d.id, coalesce(a.n, 0) AS arguments FROM dockets d LEFT JOIN (SELECT docket_id, count(*) AS n FROM {AUD} x GROUP BY docket_id) a ON a.docket_id = d.id")
both("jon18_recount", "opinion_clusters opinions", f"SELECT k.id, coalesce(n.n, 0) AS opinions FROM opinion_clusters k LEFT JOIN (SELECT cluster_id, count(*) AS n FROM {OPS} o GROUP BY cluster_id) n ON n.cluster_id = k.id")
both("jon23_shared_state", "people courts", f"SELECT DISTINCT p.dob_state, c.jurisdiction FROM {PPL} p JOIN courts c ON p.court_id = c.id WHERE p.dob_state <> ''")
both("jon24_depth_between", "lineitem", "SELECT a.l_suppkey AS citing, b.l_suppkey AS cited, sum(a.l_linenumber) AS depth FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_orderkey WHERE a.l_suppkey <> b.l_suppkey GROUP BY a.l_suppkey, b.l_suppkey")
both("jon26_citing_top", "orders lineitem", "SELECT o.o_orderkey FROM orders o WHERE o.o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey IN (1, 2, 3)) ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 20")
both("jon28_comparable", "dockets", "SELECT a.id AS a, b.id AS b FROM dockets a JOIN dockets b ON a.court_id = b.court_id AND a.case_name = b.case_name AND a.id < b.id WHERE a.case_name <> ''")


@R.add("jon19_preceding_page", "WITH c AS (SELECT DISTINCT l_suppkey AS vol, l_partkey AS page FROM lineitem), q AS (SELECT o_orderkey AS q, o_custkey % 10 + 1 AS vol, o_orderkey % 2000 AS page FROM orders) SELECT q.q, max(c.page) AS found FROM q LEFT JOIN c ON c.vol = q.vol AND c.page <= q.page GROUP BY q.q")
def jon19(spark, d):
    """As-of look-up: the entry at or before each asked page, by one pass over the union of both sides."""
    have = table(spark, d, "lineitem").select(c("l_suppkey").alias("vol"), c("l_partkey").alias("page"), F.lit(None).cast("bigint").alias("q"), c("l_partkey").alias("have")).distinct()
    ask = table(spark, d, "orders").select((c("o_custkey") % 10 + 1).alias("vol"), (c("o_orderkey") % 2000).alias("page"), c("o_orderkey").alias("q"), F.lit(None).cast("bigint").alias("have"))
    w = Window.partitionBy("vol").orderBy(c("page"), c("q").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return have.unionByName(ask).withColumn("found", F.last("have", ignorenulls=True).over(w)).where("q IS NOT NULL").select("q", "found")


both("jon20_unique_judge", "people dockets", f"SELECT id, person FROM (SELECT d.id, max(p.id) AS person, count(DISTINCT p.id) AS n FROM dockets d JOIN {PPL} p ON p.court_id = d.court_id AND lower(d.assigned_to_str) = concat(lower(p.name_first), ' ', lower(p.name_last)) WHERE (p.date_start IS NULL OR d.date_filed >= p.date_start) AND (p.date_termination IS NULL OR d.date_filed <= p.date_termination) GROUP BY d.id) x WHERE n = 1")
both("jon22_docket_identity", "free_document_rows dockets", "SELECT f.id, coalesce(a.id, b.id) AS docket FROM free_document_rows f LEFT JOIN (SELECT court_id, docket_number, case_name, min(id) AS id FROM dockets GROUP BY court_id, docket_number, case_name) a ON a.court_id = f.court_id AND a.docket_number = f.docket_number AND a.case_name = f.case_name LEFT JOIN (SELECT court_id, docket_number, min(id) AS id FROM dockets GROUP BY court_id, docket_number) b ON b.court_id = f.court_id AND b.docket_number = f.docket_number")

# Aggregates ------------------------------------------------------------------------------------------------------------

both("agg01_distinct", "recap_documents", "SELECT count(DISTINCT docket_id) AS dockets FROM recap_documents")


@R.add("agg01_approximate")
def agg01(spark, d):
    return table(spark, d, "recap_documents").agg(F.approx_count_distinct("docket_id", 0.02).alias("dockets"))


both("agg02_collapsed_count", "opinions", "SELECT count(DISTINCT cluster_id) AS clusters FROM opinions WHERE page_count > 3")


@R.add("agg03_two_digits", "SELECT court_id, CAST(floor(count(*) / power(10, greatest(length(count(*)::VARCHAR) - 2, 0))) * power(10, greatest(length(count(*)::VARCHAR) - 2, 0)) AS BIGINT) AS about FROM recap_documents GROUP BY court_id")
def agg03(spark, d):
    return table(spark, d, "recap_documents").groupBy("court_id").agg(F.count("*").alias("n")).select("court_id", paging.two_digits(c("n")).alias("about"))


both("agg04_status_facets", "opinion_clusters", "SELECT precedential_status, count(*) AS n FROM opinion_clusters WHERE citation_count >= 1 GROUP BY precedential_status")
both("agg05_by_court", "opinion_clusters dockets", "SELECT d.court_id, count(*) AS n FROM opinion_clusters k JOIN dockets d ON k.docket_id = d.id GROUP BY d.court_id")


@R.add("agg06_yearly_histogram", "SELECT y.y AS y, coalesce(n.n, 0) AS n FROM (SELECT unnest(range(min(year(date_filed)), max(year(date_filed)) + 1)) AS y FROM opinion_clusters) y LEFT JOIN (SELECT year(date_filed) AS y, count(*) AS n FROM opinion_clusters GROUP BY 1) n ON n.y = y.y")
def agg06(spark, d):
    k = table(spark, d, "opinion_clusters").select(F.year("date_filed").alias("y")).where("y IS NOT NULL")
    years = k.agg(F.explode(F.sequence(F.min("y"), F.max("y"))).alias("y"))
    return years.join(k.groupBy("y").agg(F.count("*").alias("n")), "y", "left").select("y", F.coalesce("n", F.lit(0)).alias("n"))


both("agg07_date_stats", "opinion_clusters dockets", "SELECT d.court_id, count(k.date_filed) AS n, min(k.date_filed) AS first_filed, max(k.date_filed) AS last_filed FROM opinion_clusters k JOIN dockets d ON k.docket_id = d.id GROUP BY d.court_id")
both("agg08_chart", "courts dockets", "SELECT c.jurisdiction, count(*) AS n, min(d.date_created) AS since, max(d.date_created) AS until FROM courts c JOIN dockets d ON d.court_id = c.id GROUP BY c.jurisdiction")


@R.add("agg09_grouped_hits", f"SELECT docket_id, id, rank, best FROM (SELECT docket_id, id, row_number() OVER (PARTITION BY docket_id ORDER BY page_count DESC NULLS LAST, id) AS rank, max(page_count) OVER (PARTITION BY docket_id) AS best FROM {DOCS}) WHERE rank <= 5")
def agg09(spark, d):
    best = Window.partitionBy("docket_id")
    return ranking.top_per_group(docs(spark, d).withColumn("best", F.max("page_count").over(best)), "docket_id", [c("page_count").desc_nulls_last(), c("id").asc()], 5).select("docket_id", "id", "rank", "best")


both("agg10_conditional_counts", "dockets recap_documents", f"SELECT d.id, count(r.id) AS docs, count(CASE WHEN r.is_available THEN 1 END) AS available, count(CASE WHEN r.document_type = 1 THEN 1 END) AS main, count(CASE WHEN r.document_type = 2 THEN 1 END) AS attachments, count(CASE WHEN r.page_count > 10 THEN 1 END) AS long FROM dockets d JOIN {DOCS} r ON r.docket_id = d.id GROUP BY d.id")
both("agg11_composite_page", "recap_documents", f"SELECT docket_id, document_type, count(*) AS n, count(CASE WHEN is_available THEN 1 END) AS available FROM {DOCS} r WHERE docket_id > 500 GROUP BY docket_id, document_type ORDER BY docket_id, document_type LIMIT 100")
both("agg12_same_key_other_hash", "opinions", "SELECT cluster_id, count(*) AS n, count(DISTINCT sha1) AS hashes FROM opinions GROUP BY cluster_id HAVING count(*) >= 2 AND count(DISTINCT sha1) >= 2")
both("agg13_same_hash", "opinions", "SELECT sha1, count(*) AS n FROM opinions WHERE sha1 <> '' GROUP BY sha1 HAVING count(*) >= 2")
both("agg14_duplicate_documents", "recap_documents", f"SELECT docket_id, pacer_doc_id, count(*) AS n FROM {DOCS} r WHERE pacer_doc_id <> '' GROUP BY docket_id, pacer_doc_id HAVING count(*) > 1")
both("agg15_busy_attorneys", "attorneys", "SELECT attorney_name, count(DISTINCT docket_id) AS dockets FROM attorneys WHERE attorney_name <> '' GROUP BY attorney_name HAVING count(DISTINCT docket_id) > 1")
both("agg16_authority", "lineitem", "SELECT l_partkey, count(DISTINCT l_orderkey) AS filings, sum(l_linenumber) AS depth FROM lineitem GROUP BY l_partkey")
both("agg17_source_rollup", "opinion_clusters", "SELECT sum(CASE WHEN source_code LIKE '%C%' THEN n ELSE 0 END) AS c, sum(CASE WHEN source_code LIKE '%R%' THEN n ELSE 0 END) AS r, sum(CASE WHEN source_code LIKE '%Z%' THEN n ELSE 0 END) AS z FROM (SELECT source_code, count(*) AS n FROM opinion_clusters GROUP BY source_code) x")
both("agg18_minutes", "audio", f"SELECT floor(coalesce(sum(duration), 0) / 60.0) AS minutes FROM {AUD} a")
both("agg21_counts_for_ids", "recap_documents", f"SELECT docket_id, count(*) AS n FROM {DOCS} r WHERE docket_id IN (1, 2, 3, 5, 8, 13, 21, 34) GROUP BY docket_id")
both("agg22_stale_courts", "courts dockets", "SELECT c.id FROM courts c LEFT JOIN (SELECT court_id, max(date_created) AS latest FROM dockets GROUP BY court_id) d ON d.court_id = c.id WHERE d.latest IS NULL OR d.latest < TIMESTAMP '2020-01-01 00:00:00'")
both("agg23_earliest", "dockets", "SELECT assigned_to_str, court_id, min(date_filed) AS earliest FROM dockets WHERE assigned_to_str <> '' GROUP BY assigned_to_str, court_id")
both("agg24_two_rates", "events", "SELECT user_id, count(CASE WHEN event_type = 'view' THEN 1 END) AS views, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS purchases FROM events GROUP BY user_id")
both("agg25_usage_log", "events", "SELECT user_id, cast(ts AS date) AS day, count(*) AS n FROM events GROUP BY user_id, cast(ts AS date)")
both("agg26_span", "events", "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-12 00:00:00' GROUP BY event_type")
both("agg27_mean_timing", "court_emails", "SELECT court_id, round(sum(processing_time_millis) * 1.0 / count(processing_time_millis), 4) AS mean_ms FROM court_emails GROUP BY court_id HAVING count(processing_time_millis) > 0")
both("agg28_users", "events", "SELECT DISTINCT user_id FROM events WHERE ts < TIMESTAMP '2024-01-10 00:00:00'")
both("agg29_trailing_days", "events", "SELECT sum(CASE WHEN cast(ts AS date) > DATE '2024-01-23' THEN 1 ELSE 0 END) AS last_week FROM events")
both("agg30_tally", "events", "SELECT event_type, cast(ts AS date) AS day, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type, cast(ts AS date)")
both("agg32_alert_estimate", "dockets recap_documents", f"SELECT greatest((SELECT count(*) FROM dockets WHERE date_created >= TIMESTAMP '2015-01-01 00:00:00'), (SELECT count(DISTINCT docket_id) FROM {DOCS} r WHERE date_upload >= TIMESTAMP '2015-01-01 00:00:00')) AS cases")
both("agg36_max_lag", "court_emails", "SELECT court_id, max(processing_time_millis) AS worst FROM court_emails GROUP BY court_id")
both("agg37_rollup", "dockets", "SELECT court_id, source_code, count(*) AS n FROM dockets GROUP BY ROLLUP (court_id, source_code)")
both("agg37_cube", "dockets", "SELECT jury_demand, source_code, count(*) AS n FROM dockets GROUP BY CUBE (jury_demand, source_code)")


@R.add("agg31_mean_words", "SELECT round(avg(len(string_split(text, ' '))), 4) AS mean_words, CAST(round(avg(len(string_split(text, ' '))) * (SELECT count(*) FROM documents)) AS BIGINT) AS all_words FROM documents WHERE text <> ''")
def agg31(spark, d):
    t = table(spark, d, "documents")
    words = F.when(c("text") != "", F.size(F.split("text", " ")))
    return t.agg(F.round(F.avg(words), 4).alias("mean_words"), F.round(F.avg(words) * F.count("*")).cast("bigint").alias("all_words"))


_YEARS = list(range(2018, 2024))


@R.add("agg35_pivot", "SELECT court_id, " + ", ".join(f"count(*) FILTER (WHERE year(date_filed) = {y}) AS y{y}" for y in _YEARS) + ", count(*) AS total FROM dockets WHERE year(date_filed) BETWEEN 2018 AND 2023 GROUP BY court_id")
def agg35(spark, d):
    t = table(spark, d, "dockets").withColumn("y", F.concat(F.lit("y"), F.year("date_filed"))).where(F.year("date_filed").between(2018, 2023))
    p = t.groupBy("court_id").pivot("y", [f"y{y}" for y in _YEARS]).count().na.fill(0)
    return p.withColumn("total", sum((c(f"y{y}") for y in _YEARS[1:]), c(f"y{_YEARS[0]}")))


# Windows ---------------------------------------------------------------------------------------------------------------


@R.add("win01_round_robin", "SELECT id, court_id, row_number() OVER (PARTITION BY court_id ORDER BY id) AS cycle FROM dockets")
def win01(spark, d):
    return sequence.interleave(table(spark, d, "dockets").select("id", "court_id"), "court_id", "id")


@R.add("win02_round_robin_filtered", "SELECT id, court_id, row_number() OVER (PARTITION BY court_id ORDER BY id) AS cycle FROM dockets WHERE nature_of_suit LIKE '5%' AND date_terminated IS NULL")
def win02(spark, d):
    return sequence.interleave(table(spark, d, "dockets").where("nature_of_suit LIKE '5%' AND date_terminated IS NULL").select("id", "court_id"), "court_id", "id")


both("win03_cycle_restart", "dockets", "SELECT id, cycle, cycle <> coalesce(lag(cycle) OVER (ORDER BY cycle, court_id, id), 0) AS restart FROM (SELECT id, court_id, row_number() OVER (PARTITION BY court_id ORDER BY id) AS cycle FROM dockets) x")


@R.add("win04_entry_sequence", "WITH e AS (SELECT DISTINCT id, docket_id, entry_number, entry_date_filed FROM recap_documents WHERE entry_date_filed IS NOT NULL AND document_type = 1), n AS (SELECT *, lead(entry_number) OVER (PARTITION BY docket_id ORDER BY id) AS nx FROM e), t AS (SELECT docket_id, arg_min(entry_number > nx, id) AS turn FROM n WHERE entry_number <> nx GROUP BY docket_id), p AS (SELECT e.*, CASE WHEN coalesce(t.turn, FALSE) THEN -e.id ELSE e.id END AS pos FROM e LEFT JOIN t USING (docket_id)), f AS (SELECT *, CASE WHEN lag(entry_date_filed) OVER (PARTITION BY docket_id ORDER BY pos) IS NOT DISTINCT FROM entry_date_filed THEN 0 ELSE 1 END AS fresh FROM p), g AS (SELECT *, sum(fresh) OVER (PARTITION BY docket_id ORDER BY pos) AS run FROM f) SELECT id, strftime(entry_date_filed, '%Y-%m-%d') || '.' || printf('%03d', row_number() OVER (PARTITION BY docket_id, run ORDER BY pos)) AS sequence_number FROM g")
def win04(spark, d):
    e = table(spark, d, "recap_documents").where("entry_date_filed IS NOT NULL AND document_type = 1").select("id", "docket_id", "entry_number", "entry_date_filed").distinct()
    return sequence.entry_sequence(e, "docket_id", "id", c("entry_date_filed"), c("entry_number")).select("id", "sequence_number")


both("win08_neighbours", "dockets", "SELECT id, lag(id) OVER (PARTITION BY court_id ORDER BY id) AS before, lead(id) OVER (PARTITION BY court_id ORDER BY id) AS after FROM dockets")
both("win09_latest_document", "recap_documents", f"SELECT docket_id, id FROM (SELECT docket_id, id, row_number() OVER (PARTITION BY docket_id ORDER BY CASE WHEN is_available THEN 0 ELSE 1 END, date_upload DESC NULLS LAST, id) AS rn FROM {DOCS} r) x WHERE rn = 1")
both("win10_best_per_docket", "opinion_clusters", "SELECT docket_id, id FROM (SELECT docket_id, id, row_number() OVER (PARTITION BY docket_id ORDER BY citation_count DESC NULLS LAST, id) AS rn FROM opinion_clusters) x WHERE rn = 1")
both("win11_lead_opinion", "opinions", f"SELECT cluster_id, id FROM (SELECT cluster_id, id, row_number() OVER (PARTITION BY cluster_id ORDER BY ordering_key ASC NULLS LAST, id) AS rn FROM {OPS} o) x WHERE rn = 1")
both("win12_newest_of_hash", "opinions", "SELECT id, sha1, first_value(id) OVER (PARTITION BY sha1 ORDER BY id DESC) AS newest FROM (SELECT DISTINCT id, sha1 FROM opinions WHERE sha1 <> '') o")
both("win13_opinion_order", "opinions", f"SELECT id, row_number() OVER (PARTITION BY cluster_id ORDER BY opinion_type, id) AS ordering FROM {OPS} o")


@R.add("win14_first_gap", "WITH e AS (SELECT docket_id, entry_number, min(entry_date_filed) AS d FROM recap_documents WHERE entry_number > 0 GROUP BY ALL), n AS (SELECT *, lead(entry_number) OVER (PARTITION BY docket_id ORDER BY entry_number) AS nx FROM e), g AS (SELECT docket_id, arg_min(d, entry_number) FILTER (WHERE d IS NOT NULL OR TRUE) AS d FROM n WHERE nx IS NULL OR nx <> entry_number + 1 GROUP BY docket_id), b AS (SELECT docket_id, min(entry_number) AS k FROM n WHERE nx IS NULL OR nx <> entry_number + 1 GROUP BY docket_id), l AS (SELECT docket_id, min(entry_number) AS low FROM e GROUP BY docket_id) SELECT a.docket_id, coalesce(CASE WHEN l.low > 1 THEN DATE '1960-01-01' ELSE e.d END, DATE '1960-01-01') AS start FROM (SELECT DISTINCT docket_id FROM recap_documents) a LEFT JOIN l USING (docket_id) LEFT JOIN b USING (docket_id) LEFT JOIN e ON e.docket_id = a.docket_id AND e.entry_number = b.k")
def win14(spark, d):
    return sequence.first_gap_date(table(spark, d, "recap_documents"), "docket_id", "entry_number", "entry_date_filed")


@R.add("win15_history", "SELECT user_id, event_type, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM (SELECT user_id, event_id, event_type, ts FROM events)) WHERE p IS DISTINCT FROM event_type")
def win15(spark, d):
    e = table(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    return sequence.history(e, "user_id", "at", ["event_type"]).select("user_id", "event_type", c("valid_from.ts").alias("valid_from"), c("valid_to.ts").alias("valid_to"))


# Order and paging --------------------------------------------------------------------------------------------------------

both("srt01_two_keys", "people", f"SELECT id FROM {PPL} p ORDER BY date_dob DESC NULLS LAST, name_last ASC, id LIMIT 40")


@R.add("srt02_seeded_random", "SELECT id, ((id # 42) >> 32 # (id # 42)) & 4294967295 AS place FROM dockets".replace("(id # 42) >> 32 # (id # 42)", "xor(xor(id, 42) >> 32, xor(id, 42))"))
def srt02(spark, d):
    return table(spark, d, "dockets").select("id", paging.seeded_order(c("id"), 42).alias("place"))


@R.add("srt05_offset_page", "SELECT id FROM dockets ORDER BY date_filed DESC NULLS LAST, id LIMIT 20 OFFSET 40")
def srt05(spark, d):
    return paging.offset_page(table(spark, d, "dockets").select("id", "date_filed"), [c("date_filed").desc_nulls_last(), c("id").asc()], 3, 20).select("id")


@R.add("srt07_search_after", "SELECT id FROM dockets WHERE date_filed < DATE '2015-06-01' OR (date_filed = DATE '2015-06-01' AND id < 900) ORDER BY date_filed DESC NULLS LAST, id DESC LIMIT 21")
def srt07(spark, d):
    return paging.search_after(table(spark, d, "dockets").select("id", "date_filed"), "date_filed", "id", 20, (dt.date(2015, 6, 1), 900)).select("id")


@R.add("srt09_previous_page", "SELECT id FROM (SELECT id, date_filed FROM dockets WHERE date_filed > DATE '2015-06-01' OR (date_filed = DATE '2015-06-01' AND id > 900) ORDER BY date_filed ASC NULLS LAST, id ASC LIMIT 21)")
def srt09(spark, d):
    return paging.search_after(table(spark, d, "dockets").select("id", "date_filed"), "date_filed", "id", 20, (dt.date(2015, 6, 1), 900), backward=True).select("id")


@R.add("srt13_natural_key", "SELECT id, CAST(row_number() OVER (ORDER BY array_to_string(list_transform(regexp_extract_all(docket_number, '(\\d+|\\D+)'), lambda p: CASE WHEN regexp_matches(p, '^\\d') THEN lpad(regexp_replace(p, '^0+', ''), 12, '0') ELSE p END), ''), id) AS INT) AS place FROM dockets WHERE court_id = 'arsd'")
def srt13(spark, d):
    from quillstone.functions.text import natural_key

    t = table(spark, d, "dockets").where("court_id = 'arsd'").select("id", natural_key(c("docket_number")).alias("k"))
    return t.select("id", F.row_number().over(Window.orderBy("k", "id")).alias("place"))


both("srt14_custom_order", "opinions", f"SELECT opinion_type, CASE WHEN opinion_type LIKE '%lead%' THEN 1 WHEN opinion_type LIKE '%concur%' THEN 2 WHEN opinion_type LIKE '%dissent%' THEN 3 ELSE 4 END AS place, count(*) AS n FROM {OPS} o GROUP BY opinion_type")
both("srt15_jurisdictions", "courts", "SELECT id FROM courts ORDER BY CASE jurisdiction WHEN 'F' THEN 0 WHEN 'FD' THEN 1 WHEN 'FB' THEN 2 WHEN 'S' THEN 3 ELSE 4 END, sort_position, id LIMIT 60")
both("srt16_most_wanted", "recap_documents", f"SELECT id FROM {DOCS} r WHERE NOT is_available ORDER BY date_upload ASC NULLS LAST, page_count DESC NULLS FIRST, id LIMIT 50")
both("srt18_sitemap", "opinion_clusters", "SELECT id FROM opinion_clusters WHERE citation_count > 5 ORDER BY citation_count DESC, id")
both("srt17_authorities", "lineitem", "SELECT l_partkey, sum(l_linenumber) AS depth FROM lineitem GROUP BY l_partkey ORDER BY depth DESC, l_partkey")

# Sets --------------------------------------------------------------------------------------------------------------------

both("set01_union", "dockets opinion_clusters audio", "SELECT case_name FROM dockets UNION SELECT case_name FROM opinion_clusters UNION SELECT case_name FROM audio")
both("set02_variants", "opinion_clusters", "SELECT id FROM opinion_clusters WHERE source_code = 'C' UNION SELECT id FROM opinion_clusters WHERE source_code = 'Z'")
both("set03_difference", "dockets opinion_clusters", "SELECT id FROM dockets EXCEPT SELECT docket_id FROM opinion_clusters")
both("set04_intersection", "dockets audio", "SELECT id FROM dockets INTERSECT SELECT docket_id FROM audio")
both("set05_distinct_rows", "people", "SELECT DISTINCT name_first, name_last, court_id FROM people")


@R.add("set06_distinct_items", "SELECT doc_id, len(list_distinct(string_split(lower(text), ' '))) AS words FROM documents WHERE text IS NOT NULL")
def set06(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(F.array_distinct(F.split(F.lower("text"), " "))).alias("words"))


both("set08_stale_members", "attorneys dockets", "SELECT DISTINCT a.id FROM attorneys a LEFT JOIN dockets d ON a.docket_id = d.id AND d.date_terminated IS NULL WHERE d.id IS NULL")
