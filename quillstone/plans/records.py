"""More court-record queries: text thinness, zones, fragments, judges, contacts, rankings, matching and job shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import records as N
from quillstone.operators import components, family, paging, ranking, sequence, similarity
from quillstone.operators.hierarchy import ancestor_pairs, paths
from quillstone.plans.domain import _descriptions
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


def shown(name: str, source: str, key: str, sql: str | None = None, /, **cols):
    """A projection of distinct rows; ``sql`` gives the twin's columns."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return table(spark, d, source).dropDuplicates([key]).select(key, *[v().alias(k) for k, v in cols.items()])

    R.add(name, f"SELECT DISTINCT {key}, {sql} FROM {source}" if sql else None)(run)


shown("str05_left_margin", "recap_documents", "id", plain=lambda: N.without_left_margin(c("plain_text")))
shown("str27_needs_ocr", "recap_documents", "id", thin=lambda: N.needs_ocr(c("plain_text"), c("page_count")))
shown("str18_texas_number", "free_document_rows", "id", number=lambda: N.texas_number(c("docket_number")))
shown("str32_judge_surnames", "opinion_clusters", "id", names=lambda: F.array_join(N.judge_surnames(c("judges")), "|"))
shown("str33_just_names", "audio", "id", name=lambda: N.just_name(c("judges")))


def two_sources(spark, d):
    """Judges as the audio of a docket has them beside those of its clusters."""
    a = table(spark, d, "audio").dropDuplicates(["id"]).where("judges IS NOT NULL").select("docket_id", c("id").alias("audio_id"), c("judges").alias("new"))
    k = table(spark, d, "opinion_clusters").dropDuplicates(["id"]).where("judges IS NOT NULL").select("docket_id", "id", c("judges").alias("kept"))
    return a.join(k, "docket_id")


@R.add("str34_merged_judges")
def str34(spark, d):
    return two_sources(spark, d).select("audio_id", "id", N.merged_judges(c("new"), c("kept")).alias("merged"))


shown("msc07_tidy_address", "attorneys", "id", tidy=lambda: N.tidy_address(c("contact_raw")))
shown("msc08_contact_parts", "attorneys", "id", name=lambda: N.contact_parts(c("contact_raw"))["name"], street=lambda: N.contact_parts(c("contact_raw"))["street"], zip=lambda: N.contact_parts(c("contact_raw"))["zip"])
shown("scr14_fragment", "documents", "doc_id", hit=lambda: N.fragment(c("text"), ["motion", "judgment"], 120))
shown("dat01_zone_midnight", "dockets", "id", "CAST(date_filed AS TIMESTAMP) AT TIME ZONE 'America/Los_Angeles' AS instant", instant=lambda: N.utc_midnight(c("date_filed")))
shown("dat02_local_day", "dockets", "id", "CAST(date_created AT TIME ZONE 'America/New_York' AS DATE) AS day, strftime(date_created AT TIME ZONE 'America/New_York', '%H:%M:%S') AS clock", day=lambda: N.local_day(c("date_created"), "America/New_York"), clock=lambda: N.local_time(c("date_created"), "America/New_York"))
shown("mth03_mean_of_list", "embeddings", "vec_id", "round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / len(embedding), 6) AS mean", mean=lambda: F.round(N.mean(F.transform("embedding", lambda x: x.cast("double"))), 6))
shown("arr02_in_rows", "embeddings", "vec_id", "len(embedding[1:22]) AS first_row, len(embedding[45:66]) AS last_row", first_row=lambda: F.size(F.element_at(N.in_rows(c("embedding"), 3), 1)), last_row=lambda: F.size(F.element_at(N.in_rows(c("embedding"), 3), 3)))
shown("dup10_longer_number", "dockets", "id", "CASE WHEN length(coalesce(docket_number,'')) > length(coalesce(cause,'')) THEN docket_number ELSE cause END AS kept", kept=lambda: similarity.longer(c("cause"), c("docket_number")))
shown("prj14_marked_field", "dockets", "id", "regexp_replace(case_name, '(?i)\\b(freight|foods)\\b', '<mark>\\1</mark>', 'g') AS case_name", case_name=lambda: F.regexp_replace("case_name", r"(?i)\b(freight|foods)\b", "<mark>$1</mark>"))


@R.add("grf05_descendant_counts", "WITH RECURSIVE t(top, id) AS (SELECT id, id FROM courts UNION SELECT t.top, k.id FROM courts k JOIN t ON lower(trim(k.parent_court_id)) = t.id), l AS (SELECT DISTINCT a.id FROM t a JOIN courts k ON k.id = a.id JOIN t b ON b.top = a.id AND b.id = lower(trim(k.parent_court_id))), bad AS (SELECT DISTINCT t.id FROM t WHERE t.top IN (SELECT id FROM l)) SELECT top AS ancestor, count(*) - 1 AS below FROM t WHERE top NOT IN (SELECT id FROM bad) AND id NOT IN (SELECT id FROM bad) GROUP BY top")
def grf05(spark, d):
    """Number of courts below each court outside loops."""
    return ancestor_pairs(table(spark, d, "courts"), "id", "parent_court_id").groupBy("ancestor").agg((F.count("*") - 1).alias("below"))


@R.add("flt13_paths")
def flt13_paths(spark, d):
    return paths(table(spark, d, "courts"), "id", "parent_court_id").select("node", F.array_join("path", " > ").alias("path"))


@R.add("par06_representatives")
def par06(spark, d):
    """The most connected of the best fifth of each group of descriptions."""
    s = _descriptions(spark, d).where(F.size("w") > 0)
    pairs = components.similar_sets(s, "id", "docket_id", "w", 0.5)
    cls = components.classes(s.select("id"), pairs.select("a", "b"))
    degree = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    rows = s.join(cls, "id").join(degree, "id", "left").withColumn("score", F.size("w"))
    w = Window.partitionBy("cls")
    ranked = rows.withColumn("rn", F.row_number().over(w.orderBy(F.desc("score"), "id"))).withColumn("n", F.count("*").over(w)).where(c("rn") <= F.ceil(c("n") * 0.2))
    return family.collapse(ranked.select("cls", "id", F.coalesce("degree", F.lit(0)).alias("degree")), "cls", [c("degree").desc(), c("id").asc()])


@R.add("scr07_related_clusters")
def scr07(spark, d):
    """Documents most like three given ones, the best of each kind."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    like = ranking.more_like_this(docs, "doc_id", "text", [1, 2, 3], min_match=2)
    return family.collapse(like.join(docs.select("doc_id", "doc_kind"), "doc_id"), "doc_kind", [c("matched").desc(), c("doc_id").asc()])


@R.add("mth06_sequence_ratio")
def mth06(spark, d):
    return table(spark, d, "dockets").dropDuplicates(["id"]).select("id", F.round(similarity.sequence_ratio("case_name", "case_name_full"), 4).alias("ratio"))


@R.add("mth08_overlap")
def mth08(spark, d):
    return table(spark, d, "dockets").dropDuplicates(["id"]).select("id", F.round(similarity.overlap_percent("case_name", "case_name_full"), 3).alias("percent"))


@R.add("mth09_tfidf_cosine")
def mth09(spark, d):
    """TF-IDF cosine of the case names of a cluster and of its docket."""
    k = table(spark, d, "opinion_clusters").select("id", "docket_id", ranking.tokens(F.coalesce("case_name", F.lit(""))).alias("a"))
    e = table(spark, d, "dockets").select(c("id").alias("docket_id"), ranking.tokens(F.coalesce("case_name", F.lit(""))).alias("b"))
    pairs = k.join(e, "docket_id").select("id", "a", "b")
    n = pairs.count()
    df = pairs.select("id", F.explode(F.array_distinct("a")).alias("w")).groupBy("w").agg(F.log((n + 1) / (F.count("*") + 1)).alias("idf"))
    side = lambda x: pairs.select("id", F.explode(x).alias("w")).groupBy("id", "w").agg(F.count("*").alias("tf")).join(df, "w").select("id", "w", (c("tf") * c("idf")).alias("v"))
    x, y = side("a"), side("b").withColumnRenamed("v", "u")
    dot = x.join(y, ["id", "w"]).groupBy("id").agg(F.sum(c("v") * c("u")).alias("dot"))
    norm = lambda s, v: s.groupBy("id").agg(F.sqrt(F.sum(c(v) * c(v))).alias(f"n{v}"))
    return dot.join(norm(x, "v"), "id").join(norm(y, "u"), "id").select("id", F.round(c("dot") / F.nullif(c("nv") * c("nu"), F.lit(0.0)), 5).alias("cosine"))


@R.add("dup14_heuristic_match")
def dup14(spark, d):
    """For each listed row the docket of its court and number whose name is most alike, above 0.65."""
    f = table(spark, d, "free_document_rows").select("id", "court_id", "docket_number", F.lower(F.substring(F.coalesce("case_name", F.lit("")), 1, 30)).alias("x"))
    k = table(spark, d, "dockets").select(c("id").alias("docket_id"), "court_id", "docket_number", F.lower(F.substring(F.coalesce("case_name", F.lit("")), 1, 30)).alias("y"))
    scored = f.join(k, ["court_id", "docket_number"]).withColumn("ratio", similarity.sequence_ratio("x", "y")).where("ratio > 0.65")
    return scored.groupBy("id").agg(F.max_by("docket_id", F.struct("ratio", -c("docket_id"))).alias("docket_id"), F.round(F.max("ratio"), 4).alias("ratio"))


@R.add("dup04_record_linkage")
def dup04(spark, d):
    """Listed rows and dockets of one court and day whose names share half their words and lie within length bounds."""
    from quillstone.functions.text import informative_words

    f = table(spark, d, "free_document_rows").select("id", F.lower("court_id").alias("court_id"), "date_filed", "case_name", informative_words(F.coalesce("case_name", F.lit(""))).alias("a"))
    k = table(spark, d, "dockets").select(c("id").alias("docket_id"), "court_id", "date_filed", c("case_name").alias("name"), informative_words(F.coalesce("case_name", F.lit(""))).alias("b"))
    near = f.join(k, ["court_id", "date_filed"])
    share = F.size(F.array_intersect("a", "b")) / F.greatest(F.least(F.size("a"), F.size("b")), F.lit(1))
    return near.where((share >= 0.5) & similarity.length_ratio(c("case_name"), c("name")).between(0.3, 1.0)).select("id", "docket_id")


@R.add("win05_list_direction", "WITH e AS (SELECT DISTINCT id, docket_id, entry_number FROM recap_documents WHERE document_type = 1), n AS (SELECT *, lead(entry_number) OVER (PARTITION BY docket_id ORDER BY id) AS nx FROM e) SELECT docket_id, CASE WHEN arg_min(entry_number > nx, id) THEN 'desc' ELSE 'asc' END AS direction FROM n WHERE entry_number <> nx GROUP BY docket_id")
def win05(spark, d):
    e = table(spark, d, "recap_documents").where("document_type = 1").select("id", "docket_id", "entry_number").distinct()
    n = e.withColumn("nx", F.lead("entry_number").over(Window.partitionBy("docket_id").orderBy("id"))).where("entry_number <> nx")
    return n.groupBy("docket_id").agg(F.when(F.min_by(c("entry_number") > c("nx"), "id"), "desc").otherwise("asc").alias("direction"))


@R.add("win06_sequence_label", "SELECT id, strftime(date_filed, '%Y-%m-%d') || '.' || printf('%03d', row_number() OVER (PARTITION BY court_id, date_filed ORDER BY id)) AS label FROM dockets WHERE date_filed IS NOT NULL")
def win06(spark, d):
    w = Window.partitionBy("court_id", "date_filed").orderBy("id")
    return table(spark, d, "dockets").where("date_filed IS NOT NULL").select("id", F.format_string("%s.%03d", c("date_filed").cast("string"), F.row_number().over(w)).alias("label"))


@R.add("cit12_sessions", "WITH e AS (SELECT user_id, event_id, CAST(epoch(ts) AS BIGINT) AS s FROM events), f AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) >= 86400 THEN 1 ELSE 0 END AS far FROM e) SELECT event_id, sum(far) OVER (PARTITION BY user_id ORDER BY s, event_id) AS run FROM f")
def cit12_sessions(spark, d):
    """Runs of events less than a day apart: the positional session that parallel citations use."""
    e = table(spark, d, "events").select("user_id", "event_id", F.unix_seconds(c("ts").cast("timestamp")).alias("s"))
    w = Window.partitionBy("user_id").orderBy("s", "event_id")
    return e.withColumn("far", F.coalesce((c("s") - F.lag("s").over(w) >= 86400).cast("int"), F.lit(0))).select("event_id", F.sum("far").over(w).alias("run"))


@R.add("srt08_sort_pair", "SELECT id FROM opinion_clusters ORDER BY citation_count DESC NULLS LAST, id DESC LIMIT 25")
def srt08(spark, d):
    return paging.search_after(table(spark, d, "opinion_clusters").select("id", "citation_count"), "citation_count", "id", 24).select("id")


@R.add("agg33_counts_in_one_pass", f"SELECT count(*) AS docs, count(*) FILTER (WHERE is_available) AS available, count(DISTINCT docket_id) AS dockets, max(page_count) AS longest FROM {DOCS}")
def agg33(spark, d):
    """Several counts of one result in a single scan."""
    t = table(spark, d, "recap_documents").select("id", "docket_id", "court_id", "entry_number", "entry_date_filed", "document_number", "attachment_number", "document_type", "is_available", "page_count", "pacer_doc_id", "ocr_status", "date_upload", "description").distinct()
    return t.agg(F.count("*").alias("docs"), F.count_if("is_available").alias("available"), F.count_distinct("docket_id").alias("dockets"), F.max("page_count").alias("longest"))


both("agg34_count_form", "dockets", "SELECT count(*) AS n FROM dockets WHERE court_id = 'arsd' AND case_name LIKE '%Freight%'")
both("jon21_last_name", "people dockets", f"SELECT d.id, count(DISTINCT p.id) AS candidates FROM dockets d JOIN {PPL} p ON p.court_id = d.court_id AND lower(d.assigned_to_str) LIKE concat('%', lower(p.name_last), '%') WHERE length(p.name_last) > 3 GROUP BY d.id")
both("jon25_depth_column", "lineitem orders", "SELECT o.o_orderkey, coalesce(e.depth, 0) AS depth FROM orders o LEFT JOIN (SELECT l_orderkey, sum(l_linenumber) AS depth FROM lineitem WHERE l_partkey = 7 GROUP BY l_orderkey) e ON e.l_orderkey = o.o_orderkey")
both("jon27_possible_matches", "free_document_rows dockets", "SELECT f.id, d.id AS docket FROM free_document_rows f JOIN dockets d ON f.court_id = d.court_id AND f.date_filed = d.date_filed AND lower(substring(f.case_name, 1, 6)) = lower(substring(d.case_name, 1, 6))")
both("jon08_child_limits", "recap_documents", f"SELECT docket_id, count(*) AS kept FROM (SELECT docket_id, document_type, row_number() OVER (PARTITION BY docket_id, document_type ORDER BY id) AS rn FROM {DOCS} r) x WHERE rn <= CASE WHEN document_type = 1 THEN 3 ELSE 1 END GROUP BY docket_id")
both(
    "scr02_scale_by_kind", "opinion_clusters dockets courts",
    "SELECT k.id, round(CASE WHEN t.jurisdiction IN ('F', 'S') THEN 0.8 WHEN t.jurisdiction IN ('FD', 'SA') THEN 0.6 WHEN t.jurisdiction IN ('FB', 'ST') THEN 0.4 ELSE 1.0 END * (k.citation_count + 1), 4) AS score FROM opinion_clusters k JOIN dockets d ON k.docket_id = d.id LEFT JOIN (SELECT id, max(jurisdiction) AS jurisdiction FROM courts GROUP BY id) t ON t.id = d.court_id",
)
both("scr12_top_child_score", "recap_documents", f"SELECT docket_id, max(page_count) AS top FROM {DOCS} r GROUP BY docket_id")
both("mrg01_numbered_or_not", "recap_documents", f"SELECT docket_id, count(CASE WHEN entry_number IS NOT NULL THEN 1 END) AS numbered, count(CASE WHEN entry_number IS NULL THEN 1 END) AS unnumbered FROM {DOCS} r GROUP BY docket_id")
both("mrg02_by_description", "recap_documents", f"SELECT a.id AS a, b.id AS b FROM {DOCS} a JOIN {DOCS} b ON a.docket_id = b.docket_id AND a.description = b.description AND a.entry_date_filed = b.entry_date_filed AND a.id < b.id WHERE a.entry_number IS NULL")
both("set07_merged_outcomes", "dockets", "SELECT kind, count(*) AS n FROM (SELECT 'created' AS kind, id FROM dockets WHERE date_created = date_modified UNION ALL SELECT 'updated', id FROM dockets WHERE date_created <> date_modified) x GROUP BY kind")
both("job05_age_report", "dockets", "SELECT source_code, count(CASE WHEN date_terminated IS NULL THEN 1 END) AS open, count(CASE WHEN date_terminated IS NOT NULL THEN 1 END) AS closed FROM dockets GROUP BY source_code")
both("job13_cite_arrays", "lineitem", "SELECT l_orderkey, count(DISTINCT l_partkey) AS cites, min(l_partkey) AS lowest FROM lineitem GROUP BY l_orderkey")
both("job16_interleaved", "dockets", "SELECT id, court_id FROM (SELECT id, court_id, row_number() OVER (PARTITION BY court_id ORDER BY id) AS rn FROM dockets) x WHERE rn <= 3")
both("job18_mismatched_numbers", "free_document_rows dockets", "SELECT f.id FROM free_document_rows f JOIN dockets d ON f.court_id = d.court_id AND f.case_name = d.case_name AND f.date_filed = d.date_filed WHERE f.docket_number <> d.docket_number")
both("job22_filled_transfer", "opinion_clusters dockets", "SELECT k.id, coalesce(d.court_id, 'unknown') AS court FROM opinion_clusters k LEFT JOIN dockets d ON d.id = k.docket_id")
both("job31_author_rows", "opinions people", f"SELECT o.id, p.name_last FROM {OPS} o JOIN (SELECT id, min(name_last) AS name_last FROM people GROUP BY id) p ON p.id = o.author_id")
both("job33_by_nature", "dockets", "SELECT id FROM dockets WHERE nature_of_suit LIKE '8%'")
both("job40_order_keys", "opinions", f"SELECT cluster_id, count(*) AS opinions, count(ordering_key) AS keyed FROM {OPS} o GROUP BY cluster_id HAVING count(*) > 1")
both("job63_removed", "recap_documents", f"SELECT count(*) AS left_over FROM {DOCS} r WHERE NOT (court_id = 'arsd' AND is_available)")
both("job73_sealed_flags", "recap_documents dockets", f"SELECT r.id, CASE WHEN d.nature_of_suit LIKE '5%' THEN TRUE ELSE FALSE END AS sealed FROM {DOCS} r JOIN dockets d ON d.id = r.docket_id")
both("job80_old_mail", "court_emails", "SELECT count(*) AS gone FROM court_emails WHERE receipt_timestamp < TIMESTAMP '2022-06-01 00:00:00'")
