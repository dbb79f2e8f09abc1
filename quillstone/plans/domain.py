"""Citations, graphs, similarity, merging, stored queries and batch jobs over the court tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import citations as C
from quillstone.operators import components, family, graph, language, percolate, similarity
from quillstone.plans.registry import Registry
from quillstone.plans.relational import AUD, DOCS, OPS, PPL
from quillstone.sources.tables import table, views

R = Registry()
c = F.col


def both(name: str, tables: str, sql: str, twin: str | None = None) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        views(spark, d, *tables.split())
        return spark.sql(sql)

    R.add(name, twin or sql)(run)


# Citations -------------------------------------------------------------------------------------------------------------

_RX = r"\b(\d{1,4})\s+(Ard\.\s+2d|App\.\s+Rep\.|Prov\.\s+Ct\.|Fed\.\s+Dec\.|Belm\.\s+3d)\s+(\d{1,5})\b"
_CITES = f"(SELECT id, CAST(regexp_extract(x, '{_RX}', 1) AS INT) AS volume, regexp_replace(regexp_extract(x, '{_RX}', 2), '\\s+', ' ', 'g') AS reporter, CAST(regexp_extract(x, '{_RX}', 3) AS INT) AS page FROM (SELECT id, unnest(regexp_extract_all(plain_text, '{_RX}')) AS x FROM (SELECT DISTINCT id, plain_text FROM opinions)))"
_CASES = "(SELECT id % 900 + 1 AS volume, ['Ard. 2d','App. Rep.','Prov. Ct.','Fed. Dec.','Belm. 3d'][(id % 5 + 1)::INT] AS reporter, id * 7 % 1400 + 1 AS page, id AS case_id FROM opinion_clusters)"


def _cites(spark, d):
    return C.extract(table(spark, d, "opinions"), "id", "plain_text").dropDuplicates(["id", "seq"])  # a repeated row repeats its places


def _cases(spark, d):
    """A citation for every cluster, made from its id (the tables hold none)."""
    names = F.array(*[F.lit(r) for r in C.REPORTERS])
    return table(spark, d, "opinion_clusters").select((c("id") % 900 + 1).cast("int").alias("volume"), F.get(names, (c("id") % 5).cast("int")).alias("reporter"), (c("id") * 7 % 1400 + 1).cast("int").alias("page"), c("id").alias("case_id"))


@R.add("cit01_extracted", f"SELECT id, volume, reporter, page FROM {_CITES}")
def cit01(spark, d):
    return _cites(spark, d).select("id", "volume", "reporter", "page")


@R.add("cit03_resolved", f"SELECT c.id, c.volume, c.reporter, c.page, CASE WHEN k.n = 1 THEN 'matched' WHEN k.n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS status FROM {_CITES} c LEFT JOIN (SELECT volume, reporter, page, count(DISTINCT case_id) AS n FROM {_CASES} GROUP BY ALL) k ON k.volume = c.volume AND k.reporter = c.reporter AND k.page = c.page")
def cit03(spark, d):
    return C.resolve(_cites(spark, d), _cases(spark, d)).select("id", "volume", "reporter", "page", "status")


@R.add("cit13_edges", f"SELECT c.id AS citing, k.case_id AS cited, count(*) AS depth FROM {_CITES} c JOIN (SELECT volume, reporter, page, count(DISTINCT case_id) AS n, min(case_id) AS case_id FROM {_CASES} GROUP BY ALL) k ON k.volume = c.volume AND k.reporter = c.reporter AND k.page = c.page WHERE k.n = 1 GROUP BY ALL")
def cit13(spark, d):
    return C.edges(C.resolve(_cites(spark, d), _cases(spark, d)), "id")


@R.add("cit17_unmatched", f"SELECT DISTINCT c.volume, c.reporter, c.page FROM {_CITES} c LEFT JOIN {_CASES} k ON k.volume = c.volume AND k.reporter = c.reporter AND k.page = c.page WHERE k.case_id IS NULL")
def cit17(spark, d):
    return C.resolve(_cites(spark, d), _cases(spark, d)).where("status = 'unmatched'").select("volume", "reporter", "page").distinct()


@R.add("cit21_lookup", f"SELECT c.volume, c.reporter, c.page, CASE WHEN k.n = 1 THEN 200 WHEN k.n > 1 THEN 300 ELSE 404 END AS code FROM (SELECT DISTINCT volume, reporter, page FROM {_CITES}) c LEFT JOIN (SELECT volume, reporter, page, count(DISTINCT case_id) AS n FROM {_CASES} GROUP BY ALL) k ON k.volume = c.volume AND k.reporter = c.reporter AND k.page = c.page")
def cit21(spark, d):
    return C.lookup_status(_cites(spark, d).select("volume", "reporter", "page").distinct(), _cases(spark, d))


@R.add("cit22_reporter_counts", f"SELECT reporter, count(*) AS n, count(DISTINCT id) AS opinions FROM {_CITES} GROUP BY reporter")
def cit22(spark, d):
    return _cites(spark, d).groupBy("reporter").agg(F.count("*").alias("n"), F.count_distinct("id").alias("opinions"))


@R.add("cit12_parallel_runs")
def cit12(spark, d):
    return C.parallel_runs(_cites(spark, d), "id", "pos", 6).select("id", "run", F.array_join("cites", "; ").alias("cites"))


@R.add("cit19_annotated", f"SELECT DISTINCT id, regexp_replace(plain_text, '{_RX}', '<a href=\"/c/\\2/\\1/\\3/\">\\0</a>', 'g') AS html FROM opinions")
def cit19(spark, d):
    o = table(spark, d, "opinions").select("id", "plain_text").distinct()
    return o.select("id", C.annotate(o, "plain_text").alias("html"))


both("cit07_year_window", "opinion_clusters dockets", "SELECT k.id, min(o.id) AS other FROM opinion_clusters k JOIN opinion_clusters o ON o.case_name = k.case_name AND o.id <> k.id AND year(o.date_filed) BETWEEN year(k.date_filed) - 3 AND year(k.date_filed) + 3 GROUP BY k.id")
both("cit14_new_edges", "lineitem", "SELECT DISTINCT l_orderkey AS citing, l_partkey AS cited FROM lineitem WHERE l_returnflag = 'N' EXCEPT SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R'")

# Groups of similar texts ---------------------------------------------------------------------------------------------------


def _descriptions(spark, d):
    t = table(spark, d, "recap_documents").select("id", "docket_id", "description").distinct().where("length(description) > 0")
    words = F.filter(F.array_distinct(F.split(F.lower(F.regexp_replace("description", "[^A-Za-z ]", "")), " +")), lambda w: F.length(w) > 2)
    return t.select("id", "docket_id", words.alias("w"))


_SETS = "(SELECT id, docket_id, list_filter(list_distinct(regexp_split_to_array(lower(regexp_replace(description, '[^A-Za-z ]', '', 'g')), ' +')), lambda w: length(w) > 2) AS w FROM (SELECT DISTINCT id, docket_id, description FROM recap_documents WHERE length(description) > 0))"


@R.add(
    "par02_groups",
    f"WITH RECURSIVE s AS (SELECT * FROM {_SETS} WHERE len(w) > 0), e AS (SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON a.docket_id = b.docket_id AND a.id <> b.id AND len(list_intersect(a.w, b.w)) >= 0.5 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))), r AS (SELECT id AS node, id AS root FROM s UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node) SELECT node AS id, min(root) AS cls FROM r GROUP BY node",
)
def par02(spark, d):
    s = _descriptions(spark, d).where(F.size("w") > 0)
    return components.classes(s.select("id"), components.similar_sets(s, "id", "docket_id", "w", 0.5).select("a", "b"))


@R.add("par05_group_scores")
def par05(spark, d):
    """Score of a group: its best usefulness times its share of the docket's descriptions."""
    s = _descriptions(spark, d).where(F.size("w") > 0)
    cls = components.classes(s.select("id"), components.similar_sets(s, "id", "docket_id", "w", 0.5).select("a", "b"))
    g = s.join(cls, "id").groupBy("docket_id", "cls").agg(F.count("*").alias("size"), F.max(F.size("w")).alias("top"))
    from pyspark.sql import Window

    return g.withColumn("score", F.round(c("top") * c("size") / F.sum("size").over(Window.partitionBy("docket_id")), 6)).select("docket_id", "cls", "size", "score")


# Duplicates and merging --------------------------------------------------------------------------------------------------------

both("dup02_length_gate", "opinion_clusters", "SELECT id, least(length(case_name), length(case_name_full)) * 1.0 / greatest(length(case_name), length(case_name_full), 1) >= 0.7 AS alike FROM opinion_clusters WHERE case_name_full <> ''")
both("dup03_same_source", "opinions", "SELECT a.id AS older, b.id AS newer FROM (SELECT DISTINCT id, cluster_id, opinion_type FROM opinions) a JOIN (SELECT DISTINCT id, cluster_id, opinion_type FROM opinions) b ON a.cluster_id = b.cluster_id AND a.opinion_type = b.opinion_type AND a.id < b.id")


@R.add("dup01_version_similarity")
def dup01(spark, d):
    """How alike the texts of two opinions of one cluster are; texts whose lengths differ too much are not compared."""
    o = table(spark, d, "opinions").select("id", "cluster_id", "plain_text").dropDuplicates(["id"]).where("length(plain_text) > 0")
    pairs = o.join(o.select(c("id").alias("other"), "cluster_id", c("plain_text").alias("text")), "cluster_id").where("id < other")
    near = pairs.where(similarity.length_ratio(c("plain_text"), c("text")) >= 0.7)
    return near.select("id", "other", F.round(similarity.sequence_ratio("plain_text", "text"), 4).alias("ratio"))


@R.add("dup07_merged_names", "SELECT id, CASE WHEN length(coalesce(s,'')) > length(coalesce(f,'')) THEN f ELSE s END AS short, CASE WHEN length(coalesce(s,'')) > length(coalesce(f,'')) THEN s ELSE f END AS \"full\" FROM (SELECT k.id, CASE WHEN length(coalesce(d.case_name_short,'')) > length(coalesce(k.case_name_short,'')) THEN d.case_name_short ELSE k.case_name_short END AS s, CASE WHEN length(coalesce(d.case_name_full,'')) > length(coalesce(k.case_name_full,'')) THEN d.case_name_full ELSE k.case_name_full END AS f FROM opinion_clusters k JOIN dockets d ON k.docket_id = d.id)")
def dup07(spark, d):
    k = table(spark, d, "opinion_clusters").select("id", "docket_id", c("case_name_short").alias("s"), c("case_name_full").alias("f"))
    e = table(spark, d, "dockets").select(c("id").alias("docket_id"), "case_name_short", "case_name_full")
    return k.join(e, "docket_id").select("id", similarity.merged_case_names(c("s"), c("f"), c("case_name_short"), c("case_name_full")).alias("m")).select("id", "m.short", "m.full")


both("dup11_coalesced_fields", "opinion_clusters dockets", "SELECT k.id, coalesce(nullif(k.case_name, ''), d.case_name) AS case_name, coalesce(k.date_filed, d.date_filed) AS date_filed, least(k.date_filed, d.date_filed) AS earliest FROM opinion_clusters k JOIN dockets d ON k.docket_id = d.id")
both("dup13_three_ways", "free_document_rows dockets", "SELECT f.id, CASE WHEN count(d.id) = 0 THEN 'create' WHEN count(d.id) = 1 THEN 'merge' ELSE 'compare' END AS action FROM free_document_rows f LEFT JOIN dockets d ON d.court_id = f.court_id AND d.docket_number = f.docket_number GROUP BY f.id")
both("dup16_known_pairs", "lineitem", "SELECT DISTINCT l_orderkey, l_partkey FROM lineitem a WHERE l_shipdate > TIMESTAMP '2000-01-01 00:00:00' AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_partkey = a.l_partkey AND b.l_shipdate <= TIMESTAMP '2000-01-01 00:00:00')")
both("dup17_existing_docket", "free_document_rows dockets", "SELECT f.id, min(d.id) AS docket FROM free_document_rows f JOIN dockets d ON d.court_id = f.court_id AND (d.docket_number = f.docket_number OR concat(d.docket_number, ';') = f.docket_number) GROUP BY f.id")


@R.add("dup18_suspect_transcripts", f"SELECT a.id, a.duration >= 500 AND len(list_distinct(regexp_split_to_array(lower(coalesce(a.case_name,'')), '\\s+'))) <= 0.5 * (376 + 0.435 * a.duration) AS suspect FROM {AUD} a")
def dup18(spark, d):
    return table(spark, d, "audio").distinct().select("id", similarity.transcript_suspect(c("duration"), F.coalesce("case_name", F.lit(""))).alias("suspect"))


@R.add("dup19_token_batches")
def dup19(spark, d):
    t = table(spark, d, "documents").where("text <> ''").select("doc_id", F.coalesce("court_id", F.lit("")).alias("court_id"), F.size(F.split("text", r"\s+")).alias("tokens"))
    return similarity.token_batches(t, "doc_id", "tokens", 2000, 5, "court_id")


both("mrg03_untagged", "dockets audio", f"SELECT d.id FROM dockets d WHERE NOT EXISTS (SELECT 1 FROM {AUD} a WHERE a.docket_id = d.id AND a.source_code = 'C')")
both("mrg04_filled_key", "free_document_rows dockets", "SELECT f.id, coalesce(a.id, b.id) AS docket FROM free_document_rows f LEFT JOIN (SELECT court_id, docket_number, min(id) AS id FROM dockets GROUP BY court_id, docket_number) a ON a.court_id = f.court_id AND a.docket_number = f.docket_number LEFT JOIN (SELECT court_id, case_name, min(id) AS id FROM dockets WHERE case_name <> '' GROUP BY court_id, case_name) b ON b.court_id = f.court_id AND b.case_name = f.case_name")
both(
    "mrg05_duplicate_entries", "recap_documents",
    f"WITH k AS (SELECT * FROM {DOCS} r), odd AS (SELECT * FROM k WHERE entry_number IS NULL OR entry_number > 10000000), "
    "by_doc AS (SELECT o.id, min(m.id) AS twin FROM odd o JOIN k m ON m.docket_id = o.docket_id AND m.pacer_doc_id = o.pacer_doc_id AND m.id <> o.id WHERE o.pacer_doc_id <> '' AND m.entry_number <= 10000000 GROUP BY o.id), "
    "by_text AS (SELECT o.id, min(m.id) AS twin FROM odd o JOIN k m ON m.docket_id = o.docket_id AND m.description = o.description AND m.entry_date_filed = o.entry_date_filed AND m.id <> o.id WHERE o.description <> '' AND m.entry_number <= 10000000 AND o.id NOT IN (SELECT id FROM by_doc) GROUP BY o.id) "
    "SELECT o.id, coalesce(d.twin, t.twin) AS twin, CASE WHEN d.twin IS NOT NULL THEN 'document' WHEN t.twin IS NOT NULL THEN 'text' ELSE 'none' END AS how FROM odd o LEFT JOIN by_doc d ON d.id = o.id LEFT JOIN by_text t ON t.id = o.id",
)


@R.add("mrg06_upsert", f"SELECT coalesce(o.docket_id, n.docket_id) AS docket_id, coalesce(o.entry_number, n.entry_number) AS entry_number, CASE WHEN o.docket_id IS NULL THEN 'insert' WHEN n.docket_id IS NULL THEN 'keep' ELSE 'update' END AS action FROM (SELECT DISTINCT docket_id, entry_number FROM recap_documents WHERE date_upload < TIMESTAMPTZ '2015-01-01 00:00:00+00' AND entry_number IS NOT NULL) o FULL JOIN (SELECT DISTINCT docket_id, entry_number FROM recap_documents WHERE date_upload >= TIMESTAMPTZ '2015-01-01 00:00:00+00' AND entry_number IS NOT NULL) n ON o.docket_id = n.docket_id AND o.entry_number = n.entry_number")
def mrg06(spark, d):
    t = table(spark, d, "recap_documents").where("entry_number IS NOT NULL")
    cut = F.lit("2015-01-01").cast("timestamp")
    old = t.where(c("date_upload") < cut).select("docket_id", "entry_number").distinct().withColumn("o", F.lit(1))
    new = t.where(c("date_upload") >= cut).select("docket_id", "entry_number").distinct().withColumn("n", F.lit(1))
    return old.join(new, ["docket_id", "entry_number"], "full").select("docket_id", "entry_number", F.when(c("o").isNull(), "insert").when(c("n").isNull(), "keep").otherwise("update").alias("action"))


# Graphs ----------------------------------------------------------------------------------------------------------------------------

_EDGES = "(SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem)"


def _edges(spark, d):
    return table(spark, d, "lineitem").select(c("l_orderkey").alias("src"), c("l_partkey").alias("dst")).distinct()


@R.add("grf01_path_nodes", f"WITH RECURSIVE f(node, d) AS (SELECT 1::BIGINT, 0 UNION SELECT e.dst, f.d + 1 FROM f JOIN {_EDGES} e ON e.src = f.node WHERE f.d < 3), b(node, d) AS (SELECT 7::BIGINT, 0 UNION SELECT e.src, b.d + 1 FROM b JOIN {_EDGES} e ON e.dst = b.node WHERE b.d < 3) SELECT f.node, min(f.d) AS before, min(b.d) AS after FROM f JOIN b ON f.node = b.node GROUP BY f.node HAVING min(f.d) + min(b.d) <= 3")
def grf01(spark, d):
    return graph.path_nodes(_edges(spark, d), 1, 7, 3)


@R.add("grf04_in_degree", f"SELECT dst AS node, count(*) AS in_degree FROM {_EDGES} GROUP BY dst")
def grf04(spark, d):
    return graph.as_json(_edges(spark, d)).select("node", "in_degree")


# Stored queries and alerts ---------------------------------------------------------------------------------------------------------

_CLAUSES = [(1, 1, "court_id", "arsd"), (1, 1, "description", "motion"), (2, 1, "description", "order"), (2, 1, "description", "judgment"), (2, 2, "court_id", "kesd"), (3, 1, "document_type", "1"), (3, 1, "description", "exhibit")]
_W = "list_contains(regexp_extract_all(lower(description), '[\\p{L}\\p{N}_]+'), '%s')"


def _hits(spark, d):
    docs = table(spark, d, "recap_documents").select("id", "court_id", "document_type", "description").distinct()
    feats = percolate.features(docs, "id", ["court_id", "document_type"], ["description"])
    return percolate.percolate(feats, spark.createDataFrame(_CLAUSES, "alert_id int, branch int, field string, value string"), "id")


_PERC = f"SELECT 1 AS alert_id, id FROM {DOCS} r WHERE court_id = 'arsd' AND {_W % 'motion'} UNION SELECT 2, id FROM {DOCS} r WHERE ({_W % 'order'} AND {_W % 'judgment'}) OR court_id = 'kesd' UNION SELECT 3, id FROM {DOCS} r WHERE document_type = 1 AND {_W % 'exhibit'}"


@R.add("stm07_percolated", _PERC)
def stm07(spark, d):
    return _hits(spark, d)


@R.add("stm15_unseen_hits", f"SELECT h.alert_id, h.id FROM ({_PERC}) h JOIN {DOCS} r ON r.id = h.id WHERE r.date_upload IS NULL OR r.date_upload >= TIMESTAMPTZ '2015-01-01 00:00:00+00'")
def stm15(spark, d):
    """Hits that were not recorded when their document was first uploaded (before 2015)."""
    hits = _hits(spark, d)
    early = table(spark, d, "recap_documents").where(c("date_upload") < F.lit("2015-01-01").cast("timestamp")).select("id").distinct()
    return percolate.unseen(hits, hits.join(early, "id", "left_semi"), ["alert_id", "id"])


@R.add("stm17_capped_hits", f"SELECT alert_id, docket_id, id FROM (SELECT *, dense_rank() OVER (PARTITION BY alert_id ORDER BY docket_id) AS p FROM (SELECT h.alert_id, r.docket_id, r.id, row_number() OVER (PARTITION BY h.alert_id, r.docket_id ORDER BY r.id) AS k FROM ({_PERC}) h JOIN {DOCS} r ON r.id = h.id) WHERE k <= 3) WHERE p <= 30")
def stm17(spark, d):
    hits = _hits(spark, d).join(table(spark, d, "recap_documents").select("id", "docket_id").distinct(), "id")
    return percolate.capped(hits, "alert_id", "docket_id", "id", 3, 30).select("alert_id", "docket_id", "id")


@R.add("stm02_changed_fields", "SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM event_type AS changed FROM events")
def stm02(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", (~F.lag("event_type").over(w).eqNullSafe(c("event_type"))).alias("changed"))


both("stm03_fan_out", "dockets recap_documents", f"SELECT r.id FROM {DOCS} r JOIN dockets d ON r.docket_id = d.id WHERE d.date_modified >= TIMESTAMP '2020-01-01 00:00:00'")
both("stm12_cross_object", "dockets recap_documents", f"SELECT x.id FROM (SELECT d.id, CASE WHEN d.case_name LIKE '%Freight%' THEN 1 ELSE 0 END AS in_docket, max(CASE WHEN r.description LIKE '%motion%' THEN 1 ELSE 0 END) AS in_document FROM dockets d JOIN {DOCS} r ON r.docket_id = d.id GROUP BY d.id, d.case_name) x WHERE NOT (in_docket = 1 AND in_document = 0)")
both("stm18_daily_set", "dockets recap_documents", f"SELECT id FROM dockets WHERE cast(date_modified AS date) = DATE '2015-06-10' UNION SELECT docket_id FROM {DOCS} r WHERE cast(date_upload AS date) = DATE '2015-06-10'")


@R.add("stm22_digests", "SELECT user_id, CAST(time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS TIMESTAMP) AS week, count(*) AS hits FROM events GROUP BY ALL")
def stm22(spark, d):
    e = table(spark, d, "events").select("user_id", "ts")
    return e.groupBy("user_id", F.window("ts", "7 days")).agg(F.count("*").alias("hits")).select("user_id", c("window.start").alias("week"), "hits")


both("stm23_merged_children", "recap_documents", f"SELECT docket_id, least(count(*), 5) AS shown, count(*) > 5 AS remaining FROM {DOCS} r GROUP BY docket_id")
both("stm24_retention", "events", "SELECT count(*) AS kept FROM events WHERE ts >= TIMESTAMP '2024-01-16 00:00:00'")
both("stm25_cutoff", "events", "SELECT event_id FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-20 00:00:00'")
both("stm32_recipients", "attorneys dockets", "SELECT docket_id, attorney_name AS who FROM attorneys WHERE attorney_name <> '' UNION SELECT id, assigned_to_str FROM dockets WHERE assigned_to_str <> ''")
both("stm33_age_buckets", "dockets", "SELECT id, CASE WHEN datediff(DATE '2024-01-01', date_filed) BETWEEN 90 AND 96 THEN 'warn' WHEN datediff(DATE '2024-01-01', date_filed) BETWEEN 180 AND 186 THEN 'last warning' WHEN datediff(DATE '2024-01-01', date_filed) >= 187 THEN 'disable' ELSE 'keep' END AS action FROM dockets WHERE date_filed IS NOT NULL", "SELECT id, CASE WHEN DATE '2024-01-01' - date_filed BETWEEN 90 AND 96 THEN 'warn' WHEN DATE '2024-01-01' - date_filed BETWEEN 180 AND 186 THEN 'last warning' WHEN DATE '2024-01-01' - date_filed >= 187 THEN 'disable' ELSE 'keep' END AS action FROM dockets WHERE date_filed IS NOT NULL")
both("stm28_staleness", "court_emails", "SELECT court_id, max(receipt_timestamp) AS latest, max(receipt_timestamp) < TIMESTAMP '2023-12-01 00:00:00' AS stale FROM court_emails GROUP BY court_id")
both("stm34_quota", "events", "SELECT user_id, count(*) > 12 AS over_quota FROM events WHERE event_type = 'signup' GROUP BY user_id")

# Query language ----------------------------------------------------------------------------------------------------------------------


@R.add("qry13_boolean", f"SELECT id FROM {DOCS} r WHERE {_W % 'motion'} AND ({_W % 'dismiss'} OR regexp_matches(lower(description), '(^|[^\\p{{L}}\\p{{N}}_])reh[\\p{{L}}\\p{{N}}_]*')) AND NOT {_W % 'notice'}")
def qry13(spark, d):
    docs = table(spark, d, "recap_documents").select("id", "description").distinct()
    tree = language.parse(language.cleaned("motion (dismiss OR reh*) NOT notice"))
    return docs.where(language.compile_query(tree, ["description"])).select("id")


@R.add("qry01_field_phrase", "SELECT id FROM dockets WHERE court_id = 'arsd' AND regexp_matches(lower(case_name), '(^|[^\\p{L}\\p{N}_])united[^\\p{L}\\p{N}_]+states([^\\p{L}\\p{N}_]|$)')")
def qry01(spark, d):
    tree = language.parse('court_id:arsd case_name:"United States"')
    return table(spark, d, "dockets").where(language.compile_query(tree, ["case_name"], ("court_id",))).select("id")


# Batch jobs --------------------------------------------------------------------------------------------------------------------------

both("job06_due_retries", "court_emails", "SELECT delivery_id FROM court_emails WHERE spam_verdict IS NULL AND processing_time_millis > 1000")
both("job07_missing_duration", "audio", f"SELECT id FROM {AUD} a WHERE coalesce(duration, 0) = 0")
both("job23_missing_ids", "recap_documents", f"SELECT id FROM {DOCS} r WHERE pacer_doc_id IS NULL OR trim(pacer_doc_id) = ''")
both("job37_missing_opinions", "dockets opinion_clusters recap_documents", f"SELECT DISTINCT r.docket_id FROM {DOCS} r WHERE r.description LIKE '%OPINION%' AND NOT EXISTS (SELECT 1 FROM opinion_clusters k WHERE k.docket_id = r.docket_id)")
both("job49_picked_dockets", "dockets recap_documents audio", f"SELECT id FROM dockets WHERE date_terminated IS NULL AND source_code = 3 UNION SELECT docket_id FROM {DOCS} r WHERE date_upload > TIMESTAMP '2022-01-01 00:00:00' UNION SELECT docket_id FROM {AUD} a")
both("job54_version_groups", "opinions", f"SELECT cluster_id, count(*) AS versions FROM {OPS} o GROUP BY cluster_id HAVING count(*) > 1")
both("job59_old_rows", "events", "SELECT count(*) AS gone FROM events WHERE ts < TIMESTAMP '2024-01-08 00:00:00'")
both("job62_since", "recap_documents", f"SELECT id FROM {DOCS} r WHERE date_upload >= TIMESTAMP '2023-01-01 00:00:00' AND NOT is_available")
both("job72_backfilled", "dockets", "SELECT id, CASE WHEN coalesce(case_name_short, '') = '' THEN case_name ELSE case_name_short END AS short FROM dockets")
both("job74_presence_diff", "dockets opinion_clusters", "SELECT docket_id FROM opinion_clusters EXCEPT SELECT id FROM dockets")
both("job76_last_user", "events", "SELECT event_type, max(user_id) AS user_id FROM (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) x WHERE rn = 1 GROUP BY event_type")
both("job79_stale_people", "people", f"SELECT id FROM {PPL} p WHERE fjc_id IS NULL AND date_created < TIMESTAMP '2019-01-01 00:00:00'")
both("slice_parent_search", "dockets recap_documents", f"SELECT d.id FROM dockets d WHERE EXISTS (SELECT 1 FROM {DOCS} r WHERE r.docket_id = d.id AND r.page_count >= 8)")


def parent_search(spark: SparkSession, d: str, page: int = 20) -> DataFrame:
    """Dockets by their best document and age: each with its three best documents, one page of the ranking."""
    from quillstone.functions.dockets import recency_factor

    dockets = table(spark, d, "dockets").select("id", "court_id", "case_name", "date_filed")
    docs = table(spark, d, "recap_documents").select("id", "docket_id", "page_count", "is_available", "description").distinct().where("is_available AND page_count IS NOT NULL")
    scored = family.has_child(dockets, docs, "id", "docket_id", None, c("page_count"))
    ranked = scored.withColumn("score", F.round(c("child_score") * recency_factor(c("date_filed"), F.lit("2024-01-01").cast("date"), 50, 0.2, 0.1, 1.0), 6)).orderBy(F.desc("score"), "id").limit(page)
    best = family.best_children(docs.join(F.broadcast(ranked.select(c("id").alias("docket_id"))), "docket_id", "left_semi"), "docket_id", [c("page_count").desc(), c("id").asc()], 3)
    return ranked.join(best.select("docket_id", c("id").alias("document_id"), "child_rank", "child_remaining"), ranked["id"] == c("docket_id")).select("docket_id", "case_name", "score", "document_id", "child_rank", "child_remaining")


R.add(
    "flagship_parent_search",
    f"WITH r AS (SELECT DISTINCT id, docket_id, page_count FROM recap_documents WHERE is_available AND page_count IS NOT NULL), s AS (SELECT d.id AS docket_id, d.case_name, round(max(r.page_count) * (0.1 + 0.9 * exp(ln(0.2) / (50 * 365.0) * abs(date_diff('day', coalesce(d.date_filed, DATE '1600-01-01'), DATE '2024-01-01')))), 6) AS score FROM dockets d JOIN r ON r.docket_id = d.id GROUP BY d.id, d.case_name, d.date_filed ORDER BY score DESC, d.id LIMIT 20), k AS (SELECT docket_id, id AS document_id, row_number() OVER (PARTITION BY docket_id ORDER BY page_count DESC, id) AS child_rank, count(*) OVER (PARTITION BY docket_id) > 3 AS child_remaining FROM r) SELECT s.docket_id, s.case_name, s.score, k.document_id, k.child_rank, k.child_remaining FROM s JOIN k USING (docket_id) WHERE k.child_rank <= 3",
)(parent_search)
