"""Batch-job shapes and the remaining record, citation and alert queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import dockets as D
from quillstone.functions import records as N
from quillstone.functions import text as T
from quillstone.operators import citations as C
from quillstone.operators import components, graph, language, percolate, ranking, similarity
from quillstone.operators.paging import keyset_batch
from quillstone.plans.domain import _CASES, _CITES, _PERC, _W, _cases, _cites, _descriptions, _edges, _hits
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


def shown(query: str, source: str, key: str, sql: str | None = None, frm: str | None = None, /, **cols):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return table(spark, d, source).dropDuplicates([key]).select(key, *[v().alias(k) for k, v in cols.items()])

    R.add(query, f"SELECT DISTINCT {key}, {sql} FROM {frm or source}" if sql else None)(run)


# Sources and views ---------------------------------------------------------------------------------------------------


@R.add("src04_opinion_sample")
def src04(spark, d):
    """A twentieth of the opinions, at random but repeatable (sampling is the feature)."""
    return table(spark, d, "opinions").select("id").sample(0.05, seed=11)


both("src16_changed_feeds", "court_emails", "SELECT court_id, max(mail_sent_at) AS built, count(DISTINCT mail_subject) AS subjects, max(mail_sent_at) < TIMESTAMP '2023-12-01 00:00:00' AS stale FROM court_emails GROUP BY court_id")
both("src17_enriched", "opinion_clusters dockets", "SELECT k.id, d.docket_number, d.cause FROM opinion_clusters k LEFT JOIN dockets d ON d.id = k.docket_id AND d.case_name = k.case_name AND d.date_filed <= k.date_filed")
both("snk07_routed_children", "recap_documents", f"SELECT docket_id AS routing, concat('doc_', cast(id AS varchar(20))) AS child FROM {DOCS} r")
both("snk09_parent_and_children", "dockets recap_documents", f"SELECT concat('d', cast(id AS varchar(20))) AS doc, id AS parent FROM dockets UNION ALL SELECT concat('r', cast(id AS varchar(20))), docket_id FROM {DOCS} r")
both("prj11_mapped_fields", "recap_documents", f"SELECT id, court_id, description, document_type FROM {DOCS} r")
both("prj13_requested_columns", "dockets", "SELECT id, date_filed FROM dockets")
both("flt20_several_sets", "audio dockets courts", f"SELECT a.id FROM {AUD} a JOIN dockets d ON a.docket_id = d.id JOIN courts c ON c.id = d.court_id WHERE a.duration BETWEEN 600 AND 2000 AND d.date_filed >= DATE '2005-01-01' AND c.in_use")


@R.add("flt15_cleaned_form", "SELECT id FROM opinion_clusters WHERE precedential_status = 'Published' AND date_filed BETWEEN DATE '2001-01-01' AND DATE '2010-12-31'")
def flt15(spark, d):
    """A form with its dates the wrong way round and no status: dates are swapped, the status is Published."""
    after, before = sorted(["2010-12-31", "2001-01-01"])
    return table(spark, d, "opinion_clusters").where((c("precedential_status") == "Published") & c("date_filed").between(F.lit(after).cast("date"), F.lit(before).cast("date"))).select("id")


@R.add("flt14_child_courts", "WITH RECURSIVE t AS (SELECT id FROM courts WHERE id = 'cosup' UNION SELECT k.id FROM courts k JOIN t ON lower(trim(k.parent_court_id)) = t.id) SELECT id FROM courts WHERE id IN (SELECT id FROM t)")
def flt14(spark, d):
    from quillstone.operators.hierarchy import ancestor_pairs

    below = ancestor_pairs(table(spark, d, "courts"), "id", "parent_court_id", roots=["cosup"]).where("distance > 0").select("descendant")
    q = language.with_child_courts("court_id:cosup", {"cosup": [r[0] for r in below.collect()]})  # children of one court of a fixed table
    return table(spark, d, "courts").select(c("id").alias("court_id")).where(language.compile_query(language.parse(q), ["court_id"], ("court_id",))).select(c("court_id").alias("id"))


@R.add("qry12_boosted_fields")
def qry12(spark, d):
    """Best field of two with boosts, the other field's share added."""
    docs = table(spark, d, "dockets").select("id", "case_name", "nature_of_suit")
    a = ranking.bm25(docs, "id", "case_name", ["foods"]).withColumnRenamed("score", "a")
    b = ranking.bm25(docs, "id", "nature_of_suit", ["contract"]).withColumnRenamed("score", "b")
    both_ = a.join(b, "id", "full").na.fill(0.0)
    return both_.select("id", F.round(ranking.best_fields([c("a") * 4, c("b")]), 6).alias("score"))


both("scr05_replace_or_multiply", "opinion_clusters", "SELECT id, CASE WHEN case_name LIKE '%Freight%' THEN 2.0 * (citation_count + 1) ELSE 1.0 * (citation_count + 1) END AS score FROM opinion_clusters")
both("agg20_lifetime", "events", "SELECT count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds FROM events")
both("srt04_child_sort_key", "dockets recap_documents", f"SELECT d.id FROM dockets d JOIN (SELECT docket_id, max(entry_date_filed) AS latest FROM {DOCS} r GROUP BY docket_id) e ON e.docket_id = d.id WHERE e.latest IS NOT NULL ORDER BY e.latest DESC, d.id LIMIT 30")
both("srt11_count_only", "opinions", "SELECT count(DISTINCT id) AS n FROM opinions WHERE extracted_by_ocr")
both("srt12_slice", "audio", f"SELECT id FROM {AUD} a ORDER BY id LIMIT 10 OFFSET 20")
both("win07_state_sequence", "dockets", "SELECT id, row_number() OVER (PARTITION BY court_id, date_filed ORDER BY docket_number, id) AS idx FROM dockets WHERE court_id LIKE '%sup' OR court_id LIKE '%app' OR court_id LIKE '%d'")

# Scalars ----------------------------------------------------------------------------------------------------------------

shown("str20_generic_format", "free_document_rows", "id", "regexp_matches(trim(docket_number), '^(?:\\d{1,2}-\\d{1,6}|\\d{1,2}-\\d{1,6}-[a-zA-Z]{2})$') AS generic", generic=lambda: F.trim("docket_number").rlike(r"^(?:\d{1,2}-\d{1,6}|\d{1,2}-\d{1,6}-[a-zA-Z]{2})$"))
shown("str21_joined_numbers", "free_document_rows", "id", "upper(array_to_string(list_transform(regexp_extract_all(docket_number, '\\d{1,2}-\\d{1,6}'), lambda x: lpad(string_split(x, '-')[1], 2, '0') || '-' || string_split(x, '-')[2]), '; ')) AS numbers", numbers=lambda: F.upper(F.array_join(F.transform(F.regexp_extract_all("docket_number", F.lit(r"(\d{1,2}-\d{1,6})"), F.lit(1)), lambda x: F.concat(F.lpad(F.split_part(x, F.lit("-"), F.lit(1)), 2, "0"), F.lit("-"), F.split_part(x, F.lit("-"), F.lit(2)))), "; ")))
shown("str22_number_or_queue", "free_document_rows", "id", "CASE WHEN docket_number IS NULL OR trim(docket_number) = '' THEN 'none' WHEN regexp_matches(trim(docket_number), '^\\d{1,2}-\\d{1,6}$') THEN 'clean' ELSE 'queue' END AS way", way=lambda: F.when(c("docket_number").isNull() | (F.trim("docket_number") == ""), "none").when(F.trim("docket_number").rlike(r"^\d{1,2}-\d{1,6}$"), "clean").otherwise("queue"))
shown("str17_supreme_core", "free_document_rows", "id", core=lambda: F.regexp_replace(D.supreme_number(c("docket_number")), r"^(\d\d)[-a](\d+)$", "$1$2"))
shown("str26_descriptive", "opinion_clusters", "id", "NOT regexp_matches(lower(coalesce(syllabus,'')), '^(?:see|citing|quoting|same|en banc|per curiam|table|emphasis)\\b|^\\s*$') AS descriptive", descriptive=lambda: ~F.lower(F.coalesce("syllabus", F.lit(""))).rlike(r"^(?:see|citing|quoting|same|en banc|per curiam|table|emphasis)\b|^\s*$"))
shown("str29_bare_phrase", "dockets", "id", "regexp_replace(regexp_replace(lower(case_name), '\\b(the|of|and|inc|llc|co)\\b', '', 'g'), '[^a-z0-9]', '', 'g') AS bare", bare=lambda: F.regexp_replace(F.regexp_replace(F.lower("case_name"), r"\b(the|of|and|inc|llc|co)\b", ""), "[^a-z0-9]", ""))
shown("str30_informative_words", "dockets", "id", words=lambda: F.array_join(T.informative_words(F.coalesce("case_name", F.lit(""))), " "))
shown("str31_names_match", "dockets", "id", "strpos(lower(coalesce(case_name_full,'')), lower(string_split(coalesce(case_name,''), ' v. ')[1])) > 0 AS first_party_there", first_party_there=lambda: F.instr(F.lower(F.coalesce("case_name_full", F.lit(""))), F.lower(F.split_part(F.coalesce("case_name", F.lit("")), F.lit(" v. "), F.lit(1)))) > 0)
shown("str36_canonical_court", "free_document_rows", "id", "CASE lower(court_id) WHEN 'arsd' THEN 'S.D. Ard.' WHEN 'kesd' THEN 'S.D. Kes.' ELSE court_id END AS shown", shown=lambda: F.when(F.lower("court_id") == "arsd", "S.D. Ard.").when(F.lower("court_id") == "kesd", "S.D. Kes.").otherwise(c("court_id")))
shown("str35_slug", "courts", "id", "trim(regexp_replace(lower(citation_string), '[^a-z0-9]+', '-', 'g'), '-') AS slug", slug=lambda: F.expr("trim(BOTH '-' FROM regexp_replace(lower(citation_string), '[^a-z0-9]+', '-'))"))
shown("dat03_local_split", "dockets", "id", "CAST(date_created AT TIME ZONE 'America/Chicago' AS DATE) AS day, strftime(date_created AT TIME ZONE 'America/Chicago', '%H:%M:%S') AS clock", day=lambda: N.local_day(c("date_created"), "America/Chicago"), clock=lambda: N.local_time(c("date_created"), "America/Chicago"))
shown("jsn01_revived_dates", "dockets", "id", "date_filed AS revived", revived=lambda: F.from_json(F.to_json(F.struct("date_filed")), "date_filed date")["date_filed"])
shown("msc05_state_code", "people", "id", "CASE WHEN regexp_matches(dob_state, '^[A-Za-z]{2}$') THEN upper(dob_state) ELSE '' END AS state", state=lambda: F.when(c("dob_state").rlike("^[A-Za-z]{2}$"), F.upper("dob_state")).otherwise(""))
shown("msc10_roles", "attorneys", "id", "list_filter(['LEAD ATTORNEY','ATTORNEY TO BE NOTICED','PRO HAC VICE'], lambda r: strpos(contact_raw, r) > 0) AS roles", roles=lambda: F.filter(F.array(F.lit("LEAD ATTORNEY"), F.lit("ATTORNEY TO BE NOTICED"), F.lit("PRO HAC VICE")), lambda r: F.instr(c("contact_raw"), r) > 0))
shown("cit11_name_parameter", "dockets", "id", "len(list_filter(string_split(trim(regexp_replace(regexp_replace(coalesce(case_name,''), '[^A-Za-z0-9 ]', '', 'g'), ' +', ' ', 'g')), ' '), lambda w: w <> '')) AS words", words=lambda: F.size(F.filter(F.split(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("case_name", F.lit("")), "[^A-Za-z0-9 ]", ""), " +", " ")), " "), lambda w: w != "")))
shown("dup08_longest", "dockets", "id", "CASE WHEN length(coalesce(case_name_full,'')) > length(coalesce(case_name,'')) THEN case_name_full ELSE case_name END AS kept", kept=lambda: similarity.longer(c("case_name"), c("case_name_full")))
shown("dup09_long_field", "dockets", "id", kept=lambda: F.when(T.bag_cosine(F.coalesce("case_name", F.lit("")), F.coalesce("case_name_full", F.lit(""))) < 0.9, similarity.longer(c("case_name"), c("case_name_full"))).otherwise(c("case_name")))
shown("dup05_content_rule", "dockets", "id", differs=lambda: (T.bag_cosine(F.coalesce("case_name", F.lit("")), F.coalesce("case_name_full", F.lit(""))) < 0.5) & (similarity.length_ratio(F.coalesce("case_name", F.lit("")), F.coalesce("case_name_full", F.lit(""))) < 0.7))
shown("dup20_merged_fields", "dockets", "id", "coalesce(nullif(case_name,''), case_name_full) AS name, least(date_filed, date_terminated) AS earliest, greatest(date_created, date_modified) AS latest", name=lambda: F.coalesce(F.nullif("case_name", F.lit("")), c("case_name_full")), earliest=lambda: F.least("date_filed", "date_terminated"), latest=lambda: F.greatest("date_created", "date_modified"))
@R.add("dup12_judge_merge")
def dup12(spark, d):
    """Clusters whose judges change by the audio of their docket."""
    from quillstone.plans.records import two_sources

    return two_sources(spark, d).select("id", "audio_id", N.merged_judges(c("new"), c("kept")).alias("merged")).where("merged IS NOT NULL")


@R.add("str40_or_join", "SELECT docket_id, string_agg(CAST(id AS VARCHAR), ' OR ' ORDER BY id) AS ids FROM opinion_clusters GROUP BY docket_id")
def str40(spark, d):
    return table(spark, d, "opinion_clusters").groupBy("docket_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), " OR ").alias("ids"))


@R.add("arr03_court_columns", "SELECT id, ntile(4) OVER (ORDER BY sort_position, id) AS col FROM courts")
def arr03(spark, d):
    return table(spark, d, "courts").select("id", F.ntile(4).over(Window.orderBy("sort_position", "id")).alias("col"))


@R.add("mth07_best_match")
def mth07(spark, d):
    """For each audio row the docket's name form it is most like."""
    a = table(spark, d, "audio").dropDuplicates(["id"]).select("id", "docket_id", c("case_name").alias("x"))
    k = table(spark, d, "dockets").select(c("id").alias("docket_id"), F.explode(F.array("case_name", "case_name_full", "case_name_short")).alias("y"))
    scored = a.join(k, "docket_id").withColumn("ratio", similarity.sequence_ratio("x", "y"))
    return scored.groupBy("id").agg(F.max_by("y", F.struct("ratio", "y")).alias("best"), F.round(F.max("ratio"), 4).alias("ratio"))


# Citations ------------------------------------------------------------------------------------------------------------------


@R.add("cit02_document_totals", f"SELECT c.id, count(*) AS cites, count(*) FILTER (WHERE k.n = 1) AS matched FROM {_CITES} c LEFT JOIN (SELECT volume, reporter, page, count(DISTINCT case_id) AS n FROM {_CASES} GROUP BY ALL) k ON k.volume = c.volume AND k.reporter = c.reporter AND k.page = c.page GROUP BY c.id")
def cit02(spark, d):
    return C.resolve(_cites(spark, d), _cases(spark, d)).groupBy("id").agg(F.count("*").alias("cites"), F.count_if(c("status") == "matched").alias("matched"))


@R.add("cit04_short_citations")
def cit04(spark, d):
    """Short citations of a text ("410 Ard. 2d at 12") by the full ones resolved in it."""
    full = C.resolve(_cites(spark, d), _cases(spark, d))
    short = C.extract_short(table(spark, d, "opinions"), "id", "plain_text").dropDuplicates(["id", "seq"])
    return C.resolve_short(short, full, "id")


@R.add("cit15_filing_edges")
def cit15(spark, d):
    cites = C.extract(table(spark, d, "recap_documents"), "id", "plain_text").dropDuplicates(["id", "seq"])
    return C.edges(C.resolve(cites, _cases(spark, d)), "id")


@R.add("cit16_valid_unmatched", f"SELECT DISTINCT c.id, c.volume, c.reporter, c.page FROM {_CITES} c LEFT JOIN {_CASES} k ON k.volume = c.volume AND k.reporter = c.reporter AND k.page = c.page WHERE k.case_id IS NULL AND c.volume > 0 AND c.page > 0")
def cit16(spark, d):
    return C.resolve(_cites(spark, d), _cases(spark, d)).where("status = 'unmatched' AND volume > 0 AND page > 0").select("id", "volume", "reporter", "page").distinct()


@R.add("cit18_status_counts", f"SELECT CASE WHEN k.n = 1 THEN 'matched' WHEN k.n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS status, count(*) AS n FROM {_CITES} c LEFT JOIN (SELECT volume, reporter, page, count(DISTINCT case_id) AS n FROM {_CASES} GROUP BY ALL) k ON k.volume = c.volume AND k.reporter = c.reporter AND k.page = c.page GROUP BY ALL")
def cit18(spark, d):
    return C.resolve(_cites(spark, d), _cases(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


@R.add("cit05_antecedents", f"SELECT o.id, k.id AS cluster FROM {OPS} o JOIN opinion_clusters k ON k.id = o.cluster_id WHERE strpos(lower(k.case_name), lower(string_split(k.case_name_full, ' ')[1])) > 0 AND k.case_name_full <> ''")
def cit05(spark, d):
    """Antecedent names found in the resolved case's name."""
    o = table(spark, d, "opinions").select("id", "cluster_id").distinct()
    k = table(spark, d, "opinion_clusters").where("case_name_full <> ''").select(c("id").alias("cluster"), "case_name", F.split_part("case_name_full", F.lit(" "), F.lit(1)).alias("guess"))
    return o.join(k, o["cluster_id"] == k["cluster"]).where(F.instr(F.lower("case_name"), F.lower("guess")) > 0).select("id", "cluster")


@R.add("cit08_most_words")
def cit08(spark, d):
    """For each listed row the dockets of its court that share the most words of its name."""
    f = table(spark, d, "free_document_rows").select("id", "court_id", "date_filed", T.informative_words(F.coalesce("case_name", F.lit(""))).alias("a"))
    k = table(spark, d, "dockets").select(c("id").alias("docket_id"), "court_id", "date_filed", T.informative_words(F.coalesce("case_name", F.lit(""))).alias("b"))
    hit = f.join(k, ["court_id", "date_filed"]).withColumn("n", F.size(F.array_intersect("a", "b"))).where("n > 0")
    return hit.withColumn("best", F.max("n").over(Window.partitionBy("id"))).where("n = best").select("id", "docket_id", "n")


both("cit06_antecedent_filter", "opinion_clusters", "SELECT id FROM opinion_clusters WHERE position(lower(case_name_short) in lower(case_name)) > 0 AND case_name_short <> ''")

# Groups and graphs ------------------------------------------------------------------------------------------------------------


@R.add("par01_token_sets")
def par01(spark, d):
    return _descriptions(spark, d).select("id", F.array_join("w", " ").alias("tokens"))


@R.add("par03_neighbours")
def par03(spark, d):
    """Neighbours of each description in its docket; copies hang on one representative."""
    pairs = components.similar_sets(_descriptions(spark, d).where(F.size("w") > 0), "id", "docket_id", "w", 0.5)
    return pairs.select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@R.add("par04_components", "WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS a, l_partkey + 100000000 AS b FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS root FROM u UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node) SELECT node AS id, min(root) AS cls FROM r GROUP BY node")
def par04(spark, d):
    """Connected classes of orders and parts over large returned items."""
    e = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity > 49").select(c("l_orderkey").alias("a"), (c("l_partkey") + 100000000).alias("b")).distinct()
    nodes = e.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return components.classes(nodes, e)


@R.add("grf03_hops", "WITH RECURSIVE f(node, d) AS (SELECT 1::BIGINT, 0 UNION SELECT e.dst, f.d + 1 FROM f JOIN (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem) e ON e.src = f.node WHERE f.d < 2) SELECT node, min(d) AS d FROM f GROUP BY node")
def grf03(spark, d):
    return graph._distances(_edges(spark, d), 1, 2, "src", "dst")


both("emb02_main_versions", "embeddings", "SELECT label, count(*) AS n, min(vec_id) AS main FROM embeddings GROUP BY label")

# Alerts -----------------------------------------------------------------------------------------------------------------------


@R.add("stm10_compiled_alert", f"SELECT id FROM {DOCS} r WHERE {_W % 'exhibit'} AND court_id = 'arsd'")
def stm10(spark, d):
    q = language.parse("court_id:arsd exhibit")
    return table(spark, d, "recap_documents").select("id", "court_id", "description").distinct().where(language.compile_query(q, ["description"], ("court_id",))).select("id")


@R.add("stm21_unseen_children", f"SELECT DISTINCT h.alert_id, h.id FROM ({_PERC}) h JOIN {DOCS} r ON r.id = h.id WHERE r.is_available")
def stm21(spark, d):
    docs = table(spark, d, "recap_documents").where("is_available").select("id").distinct()
    return _hits(spark, d).join(docs, "id", "left_semi").select("alert_id", "id")


@R.add("stm19_sweep_counts", f"SELECT alert_id, count(*) AS hits FROM ({_PERC}) GROUP BY alert_id")
def stm19(spark, d):
    return _hits(spark, d).groupBy("alert_id").agg(F.count("*").alias("hits"))


both("stm06_refreshed_counts", "lineitem", "SELECT l_partkey AS cluster, count(DISTINCT l_orderkey) AS citation_count FROM lineitem GROUP BY l_partkey")
both("stm11_three_views", "dockets recap_documents", f"SELECT 'parent' AS v, count(*) AS n FROM dockets UNION ALL SELECT 'child', count(*) FROM {DOCS} r UNION ALL SELECT 'full', count(*) FROM {DOCS} r JOIN dockets d ON d.id = r.docket_id")
both("stm14_route", "events", "SELECT event_id, CASE event_type WHEN 'error' THEN 'now' WHEN 'purchase' THEN 'daily' ELSE 'weekly' END AS way FROM events")
both("stm16_seen_set", "events", "SELECT DISTINCT user_id, event_type FROM events")
both("stm20_touched_today", "dockets", "SELECT id FROM dockets WHERE cast(date_modified AS date) = DATE '2015-06-10'")
both("stm31_sweep_resume", "recap_documents", f"SELECT id FROM {DOCS} r WHERE id > 1000 ORDER BY id LIMIT 200")
both("stm35_query_log", "events", "SELECT event_type, count(*) AS asked, round(avg(value), 4) AS mean_value FROM events GROUP BY event_type")

# Jobs -----------------------------------------------------------------------------------------------------------------------------

both("job04_digests", "events", "SELECT user_id, cast(ts AS date) AS day, count(*) AS hits FROM events WHERE event_type <> 'view' GROUP BY user_id, cast(ts AS date)")
both("job09_recounted", "lineitem part", "SELECT p.p_partkey, coalesce(e.n, 0) AS citing FROM part p LEFT JOIN (SELECT l_partkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY l_partkey) e ON e.l_partkey = p.p_partkey")


@R.add("job10_citation_counts", f"SELECT id, count(*) AS cites FROM {_CITES} GROUP BY id")
def job10(spark, d):
    return _cites(spark, d).groupBy("id").agg(F.count("*").alias("cites"))


@R.add("job11_filing_citations")
def job11(spark, d):
    cites = C.extract(table(spark, d, "recap_documents"), "id", "plain_text").dropDuplicates(["id", "seq"])
    return cites.groupBy("reporter").agg(F.count("*").alias("cites"), F.count_distinct("id").alias("filings"))


both("job12_missing_rows", "free_document_rows dockets", "SELECT f.id FROM free_document_rows f LEFT JOIN dockets d ON d.court_id = f.court_id AND d.docket_number = f.docket_number WHERE d.id IS NULL")


@R.add("job14_to_run_again", f"SELECT DISTINCT c.id FROM {_CITES} c LEFT JOIN {_CASES} k ON k.volume = c.volume AND k.reporter = c.reporter AND k.page = c.page WHERE k.case_id IS NULL")
def job14(spark, d):
    return C.resolve(_cites(spark, d), _cases(spark, d)).where("status = 'unmatched'").select("id").distinct()


@R.add("job20_masked_texts", "SELECT DISTINCT id, regexp_replace(plain_text, '\\b\\d{3}-\\d{2}-\\d{4}\\b', 'XXX-XX-XXXX', 'g') AS masked FROM recap_documents WHERE plain_text IS NOT NULL")
def job20(spark, d):
    t = table(spark, d, "recap_documents").where("plain_text IS NOT NULL").select("id", "plain_text").dropDuplicates(["id"])
    return t.select("id", F.regexp_replace("plain_text", r"\b\d{3}-\d{2}-\d{4}\b", "XXX-XX-XXXX").alias("masked"))


@R.add("job29_manifest_batch", "SELECT id FROM opinion_clusters WHERE id > 50 ORDER BY id LIMIT 100")
def job29(spark, d):
    return keyset_batch(table(spark, d, "opinion_clusters").select("id"), "id", 50, 100)


both("job34_probes", "courts", "SELECT id, cast(power(2, length(id) % 6) AS bigint) AS step FROM courts")
both("job38_stale_courts", "courts dockets", "SELECT c.id, d.latest FROM courts c LEFT JOIN (SELECT court_id, max(date_filed) AS latest FROM dockets GROUP BY court_id) d ON d.court_id = c.id WHERE d.latest IS NULL OR d.latest < DATE '2023-01-01'")
both("job43_shared_attorneys", "attorneys", "SELECT email, count(DISTINCT docket_id) AS dockets FROM attorneys WHERE email <> '' GROUP BY email HAVING count(DISTINCT docket_id) > 1")
both("job44_by_year", "dockets", "SELECT assigned_to_str, count(CASE WHEN year(date_filed) = 2019 THEN 1 END) AS y2019, count(CASE WHEN year(date_filed) = 2020 THEN 1 END) AS y2020, count(*) AS total FROM dockets WHERE assigned_to_str <> '' GROUP BY assigned_to_str")
both("job46_exact_judges", "dockets people", f"SELECT d.id, min(p.id) AS person FROM dockets d JOIN {PPL} p ON p.court_id = d.court_id AND lower(trim(d.assigned_to_str)) = lower(concat(p.name_last, ', ', p.name_first)) GROUP BY d.id")
both("job48_three_ways", "free_document_rows dockets", "SELECT action, count(*) AS n FROM (SELECT f.id, CASE WHEN count(d.id) = 0 THEN 'create' WHEN count(d.id) = 1 THEN 'merge' ELSE 'compare' END AS action FROM free_document_rows f LEFT JOIN dockets d ON d.court_id = f.court_id AND d.docket_number = f.docket_number GROUP BY f.id) x GROUP BY action")
both("job50_renumbered", "recap_documents", f"SELECT a.id FROM {DOCS} a WHERE a.entry_number > 100 AND EXISTS (SELECT 1 FROM {DOCS} b WHERE b.docket_id = a.docket_id AND b.pacer_doc_id = a.pacer_doc_id AND b.id < a.id)")
both("job53_same_hash", "opinions", "SELECT sha1, min(id) AS kept, count(DISTINCT id) - 1 AS surplus FROM opinions WHERE sha1 <> '' GROUP BY sha1 HAVING count(DISTINCT id) > 1")
both("job55_status_view", "dockets", "SELECT court_id, max(date_created) AS latest, count(*) AS n FROM dockets GROUP BY court_id")
both("job57_from_text", "opinions", "SELECT DISTINCT id, regexp_extract(plain_text, 'No\\\\. ([0-9:a-z-]+)', 1) AS number FROM opinions WHERE plain_text IS NOT NULL", "SELECT DISTINCT id, regexp_extract(plain_text, 'No\\. ([0-9:a-z-]+)', 1) AS number FROM opinions WHERE plain_text IS NOT NULL")
both("job65_coverage", "recap_documents", f"SELECT court_id, year(entry_date_filed) AS y, count(*) AS n, count(CASE WHEN is_available THEN 1 END) AS available FROM {DOCS} r WHERE entry_date_filed IS NOT NULL GROUP BY court_id, year(entry_date_filed)")
both("job66_changed_slugs", "people", "SELECT id FROM people GROUP BY id, slug HAVING slug <> concat(lower(min(name_first)), '-', lower(min(name_last)))")
both("job67_crosswalk", "opinion_clusters dockets", "SELECT k.id, concat_ws('/', d.court_id, cast(year(k.date_filed) AS varchar(4)), cast(k.id AS varchar(20))) AS path FROM opinion_clusters k JOIN dockets d ON d.id = k.docket_id")
both("job70_number_queue", "free_document_rows", "SELECT id FROM free_document_rows WHERE docket_number IS NOT NULL AND trim(docket_number) <> '' AND NOT docket_number LIKE '_:__-__-_____'")
both("job71_fair_fetch", "recap_documents", f"SELECT id, court_id FROM (SELECT id, court_id, row_number() OVER (PARTITION BY court_id ORDER BY id) AS rn FROM {DOCS} r WHERE NOT is_available) x WHERE rn <= 2")
both("job75_sitemap_page", "dockets", "SELECT id FROM dockets WHERE id > 500 ORDER BY id LIMIT 100")
both("job77_worst_lag", "court_emails", "SELECT max(processing_time_millis) AS overall FROM court_emails")
both("job78_since_yesterday", "events", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-29 00:00:00' AND event_type NOT IN ('view', 'click')")
