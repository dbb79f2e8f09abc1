"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import dockets as D
from quillstone.functions import text as T
from quillstone.plans.registry import Registry
from quillstone.sources.tables import table

R = Registry()
c = F.col


def _of(name: str, source: str, sql_cols: str, frm: str | None = None, **cols):
    """Register a projection of ``source`` (distinct rows) with an id and the given columns."""
    key = {"documents": "doc_id", "courts": "id"}.get(source, "id")

    def run(spark: SparkSession, d: str) -> DataFrame:
        return table(spark, d, source).dropDuplicates([key]).select(c(key), *[v().alias(k) for k, v in cols.items()])

    R.add(name, f"SELECT DISTINCT {key}, {sql_cols} FROM {frm or source}")(run)


_of("prj03_best_case_name", "dockets", "coalesce(nullif(case_name,''), nullif(case_name_full,''), case_name_short) AS best", best=lambda: F.coalesce(F.nullif("case_name", F.lit("")), F.nullif("case_name_full", F.lit("")), c("case_name_short")))
_of("prj01_best_text", "opinions", "coalesce(nullif(plain_text,''), sha1) AS body, CASE WHEN length(plain_text)>0 THEN 'plain_text' WHEN length(sha1)>0 THEN 'sha1' END AS body_source", body=lambda: F.coalesce(F.nullif("plain_text", F.lit("")), c("sha1")), body_source=lambda: T.filled_source(plain_text=c("plain_text"), sha1=c("sha1")))
_of("prj04_snippet", "opinions", "substr(coalesce(nullif(plain_text,''), ''), 1, 500) AS snippet", snippet=lambda: F.substring(F.coalesce(F.nullif("plain_text", F.lit("")), F.lit("")), 1, 500))
_of("prj08_date_of_text", "dockets", "strftime(date_filed, '%Y-%m-%d') AS shown, CAST(strftime(date_filed, '%Y-%m-%d') AS DATE) AS revived", shown=lambda: F.date_format("date_filed", "yyyy-MM-dd"), revived=lambda: F.to_date(F.date_format("date_filed", "yyyy-MM-dd")))
_of("str01_truncated", "dockets", "CASE WHEN length(case_name) <= 30 THEN case_name WHEN strpos(substr(case_name,1,28),' ')>0 THEN regexp_extract(substr(case_name,1,28), '(?s)^(.*) ', 1) || '...' ELSE substr(case_name,1,27) || '...' END AS short", short=lambda: T.truncated(c("case_name"), 30, "..."))
_of("str03_snake_case", "courts", "lower(regexp_replace(full_name, '([a-z])([A-Z])', '\\1_\\2', 'g')) AS snake", snake=lambda: T.snake_case(c("full_name")))
_of("str07_dashes", "free_document_rows", "regexp_replace(docket_number, '[-–—‐‑‒―]+', '-', 'g') AS number", number=lambda: T.hyphenated(c("docket_number")))
_of("str09_masked", "attorneys", "regexp_replace(regexp_replace(regexp_replace(contact_raw, '\\b\\d{3}-\\d{2}-\\d{4}\\b', 'XXX-XX-XXXX', 'g'), '\\b\\d{2}-\\d{7}\\b', 'XX-XXXXXXX', 'g'), '\\bA\\d{8,9}\\b', 'AXXXXXXXX', 'g') AS masked", masked=lambda: T.masked_identifiers(c("contact_raw")))
_of("str11_parties", "dockets", "CASE WHEN strpos(case_name,' v. ')>0 THEN substr(case_name,1,strpos(case_name,' v. ')-1) || '|' || substr(case_name,strpos(case_name,' v. ')+4) WHEN strpos(case_name,' v ')>0 THEN substr(case_name,1,strpos(case_name,' v ')-1) || '|' || substr(case_name,strpos(case_name,' v ')+3) WHEN strpos(case_name,' vs. ')>0 THEN substr(case_name,1,strpos(case_name,' vs. ')-1) || '|' || substr(case_name,strpos(case_name,' vs. ')+5) WHEN strpos(case_name,' vs ')>0 THEN substr(case_name,1,strpos(case_name,' vs ')-1) || '|' || substr(case_name,strpos(case_name,' vs ')+4) WHEN case_name IS NULL THEN '' ELSE '' END AS both", both=lambda: F.array_join(T.parties(c("case_name")), "|"))
_of(
    "str12_bankruptcy_parties", "free_document_rows",
    "CASE WHEN regexp_matches(case_name, '(?i)^(in re|in the matter of|unknown case title)') THEN 0 WHEN strpos(case_name,' v. ')>0 OR strpos(case_name,' v ')>0 OR strpos(case_name,' vs. ')>0 OR strpos(case_name,' vs ')>0 OR strpos(case_name,' and ')>0 THEN 2 WHEN case_name IS NULL THEN NULL ELSE 1 END AS n_parties",
    n_parties=lambda: F.when(c("case_name").isNotNull(), F.least(F.size(T.bankruptcy_parties(c("case_name"))), F.lit(2))),
)
_of("str13_is_number", "free_document_rows", "regexp_matches(docket_number, '^(?:(?:\\d:)?\\d\\d-[a-zA-Z]{1,5}-\\d+|\\d\\d-\\d+)') AS is_number", is_number=lambda: D.looks_like_number(c("docket_number")))
_S = "lower(regexp_replace(coalesce(docket_number,''), '[-–—‐‑‒―]+', '-', 'g'))"
_B = f"regexp_extract_all({_S}, '(?:^|[ ,])(\\d\\d-\\d+)', 1)"
_A = f"regexp_extract_all({_S}, '\\b((?:\\d:)?\\d\\d-[a-z]{{1,5}}-\\d+)', 1)"
_CLEAN = f"CASE WHEN len({_A}) = 1 THEN {_A}[1] WHEN len({_B}) = 1 THEN {_B}[1] ELSE '' END"
_of("str14_clean_number", "free_document_rows", f"{_CLEAN} AS cleaned", cleaned=lambda: D.clean_number(c("docket_number")))
R.add(
    "str16_number_core",
    f"SELECT DISTINCT id, CASE WHEN regexp_matches(k, '\\d\\d-[a-z]{{1,5}}-\\d+') THEN regexp_extract(k, '(\\d\\d)-[a-z]{{1,5}}-(\\d+)', 1) || printf('%05d', CAST(regexp_extract(k, '(\\d\\d)-[a-z]{{1,5}}-(\\d+)', 2) AS BIGINT)) WHEN regexp_matches(k, '\\d\\d-\\d+') THEN regexp_extract(k, '(\\d\\d)-(\\d+)', 1) || printf('%06d', CAST(regexp_extract(k, '(\\d\\d)-(\\d+)', 2) AS BIGINT)) ELSE '' END AS core FROM (SELECT id, {_CLEAN} AS k FROM free_document_rows)",
)(lambda spark, d: table(spark, d, "free_document_rows").dropDuplicates(["id"]).select("id", D.number_core(c("docket_number")).alias("core")))
_of("str15_supreme_number", "free_document_rows", f"coalesce(list_min(regexp_extract_all({_S}, '(?:^|[ ,(])(\\d\\d-\\d+)', 1)), list_min(regexp_extract_all({_S}, '\\b(\\d{{2}}a\\d{{1,5}})\\b', 1)), '') AS number", number=lambda: D.supreme_number(c("docket_number")))
_of("str19_federal_appellate", "free_document_rows", "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(docket_number, '[-–—‐‑‒―]+', '-', 'g')), '\\s*-\\s*', '-', 'g'), '_\\d+$', ''), '^-+|-+$', '', 'g'), '\\.+$', ''), '(?i)^(?:No\\.?|Case No\\.?|Docket No\\.?|Docket|Case)\\s+', '') AS number", number=lambda: D.federal_appellate(c("docket_number")))
_of("str23_digits", "free_document_rows", "regexp_replace(docket_number, '[^0-9]', '', 'g') AS digits", digits=lambda: D.digits_only(c("docket_number")))
_of("str24_entry_text", "recap_documents", "regexp_replace(regexp_replace(description || ' [12] (Entered: 01/01/2014)', '^(.*) \\(Entered: .*\\)$', '\\1'), '\\[(\\d+)\\]', '\\1', 'g') AS entry", entry=lambda: D.entry_text(F.concat("description", F.lit(" [12] (Entered: 01/01/2014)"))))
_of("str28_body", "documents", "regexp_replace(lower(regexp_replace(text, '<[^>]+>', '', 'g')), '[^a-z0-9 ]', '', 'g') AS body", body=lambda: F.regexp_replace(F.lower(F.regexp_replace("text", "<[^>]+>", "")), "[^a-z0-9 ]", ""))
_of("str25_parenthetical", "documents", "regexp_replace(regexp_replace(regexp_replace(text, '\\* ?\\d+', ' ', 'g'), ' [_-]{4,} ', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g') AS cleaned", cleaned=lambda: F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"\* ?\d+", " "), " [_-]{4,} ", " "), r"[ \t\n\r\f\u000B]+", " "))
_of("str38_squeezed", "attorneys", "trim(regexp_replace(contact_raw, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS flat", flat=lambda: F.trim(F.regexp_replace("contact_raw", r"[ \t\n\r\f\u000B]+", " ")))
_of("str37_chunks", "opinions", "CAST(ceil(length(plain_text) / 1000.0) AS INT) AS pieces, CASE WHEN length(plain_text) > 0 THEN substr(plain_text, CAST((ceil(length(plain_text) / 1000.0) - 1) * 1000 + 1 AS INT), 1000) END AS last_piece", pieces=lambda: F.ceil(F.length("plain_text") / 1000).cast("int"), last_piece=lambda: F.when(F.length("plain_text") > 0, F.element_at(T.chunks(c("plain_text"), 1000), -1)))
_of("str41_filters", "dockets", "replace(replace(case_name, ' v. ', ' <em>v.</em> '), ' ', '_') AS shown", shown=lambda: F.replace(F.replace("case_name", F.lit(" v. "), F.lit(" <em>v.</em> ")), F.lit(" "), F.lit("_")))
_of("str06_unrepeated_lines", "recap_documents", "array_to_string(list_filter(string_split(plain_text, chr(10)), lambda x, i: x <> CASE WHEN i = 1 THEN '' ELSE string_split(plain_text, chr(10))[i - 1] END), chr(10)) AS lines", lines=lambda: T.unrepeated_lines(c("plain_text")))
_of("scr16_highlighted", "documents", "regexp_replace(text, '(?i)\\b(motion|judgment)\\b', '<mark>\\1</mark>', 'g') AS shown", shown=lambda: T.highlighted(c("text"), ["motion", "judgment"]))
_of("msc01_humanized", "opinion_clusters", "CASE WHEN (id*100+7) >= 1e9 THEN printf('%.1fB', (id*100+7)/1e9) WHEN (id*100+7) >= 1e6 THEN printf('%.1fM', (id*100+7)/1e6) WHEN (id*100+7) >= 1e3 THEN printf('%.1fK', (id*100+7)/1e3) ELSE CAST((id*100+7) AS VARCHAR) END AS shown", shown=lambda: T.humanized(c("id") * 100 + 7))
_of("msc02_price", "recap_documents", "round(CASE WHEN is_available THEN 0.0 WHEN page_count > 0 THEN least(3.0, page_count * 0.1) ELSE 0.91 END, 2) AS price", price=lambda: F.round(D.document_price(c("is_available"), c("page_count")), 2))
_of("msc03_role", "attorneys", "CASE WHEN regexp_matches(lower(contact_raw), '^(bar status|designation)') THEN NULL WHEN strpos(lower(contact_raw),'to be noticed')>0 THEN 'notice' WHEN strpos(lower(contact_raw),'lead attorney')>0 THEN 'lead' WHEN strpos(lower(contact_raw),'sealed group')>0 THEN 'sealed group' WHEN strpos(lower(contact_raw),'pro hac vice')>0 THEN 'pro hac vice' END AS role", role=lambda: D.attorney_role(c("contact_raw")))
_PH = "regexp_replace(phone, '[()\\s]+', '', 'g')"
_RX = "'(\\d{3})[^0-9]{0,2}(\\d{3})[^0-9]{0,2}(\\d{4})'"
_of("msc04_phone", "attorneys", f"CASE WHEN phone IS NULL THEN NULL WHEN regexp_extract({_PH}, {_RX}, 1) = '' THEN '' ELSE '(' || regexp_extract({_PH}, {_RX}, 1) || ') ' || regexp_extract({_PH}, {_RX}, 2) || '-' || regexp_extract({_PH}, {_RX}, 3) END AS number", number=lambda: T.us_phone(c("phone")))
_of("msc06_address_key", "attorneys", "regexp_replace(lower(regexp_replace(regexp_replace(contact_raw, '(?i)\\bllp\\b', '', 'g'), '(?i)\\bboulevard\\b', 'blvd', 'g')), '[^a-z0-9]', '', 'g') AS key", key=lambda: F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace("contact_raw", r"(?i)\bllp\b", ""), r"(?i)\bboulevard\b", "blvd")), "[^a-z0-9]", ""))
_of("dat04_quarter", "dockets", "CAST(date_trunc('quarter', date_filed) AS DATE) AS quarter", quarter=lambda: F.trunc("date_filed", "quarter"))
_of("dat06_partial_date", "people", "CASE WHEN date_granularity_dob = '%Y' THEN strftime(date_dob, '%Y') WHEN date_granularity_dob = '%Y-%m' THEN strftime(date_dob, '%B, %Y') ELSE strftime(date_dob, '%B %-d, %Y') END AS born", born=lambda: D.partial_date(c("date_dob"), c("date_granularity_dob")))
_of("dat07_duration", "audio", "CASE WHEN duration IS NOT NULL THEN ltrim(printf('%d:%02d:%02d:%02d', duration // 86400, (duration // 3600) % 24, (duration // 60) % 60, duration % 60), '0:') END AS length", length=lambda: F.when(c("duration").isNotNull(), F.ltrim(F.format_string("%d:%02d:%02d:%02d", (c("duration") / 86400).cast("int"), (c("duration") / 3600).cast("int") % 24, (c("duration") / 60).cast("int") % 60, c("duration") % 60), F.lit("0:"))))
_of("dat08_cutoffs", "dockets", "date_filed - 1 AS daily, date_filed - 7 AS weekly, CAST(date_trunc('month', date_filed - 28) AS DATE) AS monthly", daily=lambda: F.date_sub("date_filed", 1), weekly=lambda: F.date_sub("date_filed", 7), monthly=lambda: F.trunc(F.date_sub("date_filed", 28), "month"))
_of("dat09_millis", "dockets", "epoch_ms(date_filed::TIMESTAMP) AS ms", ms=lambda: F.unix_millis(c("date_filed").cast("timestamp")))
_of("dat11_retry_schedule", "audio", "date_argued + CAST(power(2, duration % 5) AS INT) AS retry_on", retry_on=lambda: F.date_add("date_argued", F.pow(F.lit(2), c("duration") % 5).cast("int")))
_of("mth01_probe", "audio", "CAST(CASE WHEN id % 20 <= 5 THEN power(2, id % 20) ELSE 32 * (id % 20 - 4) END AS BIGINT) AS probe", probe=lambda: F.when(c("id") % 20 <= 5, F.pow(F.lit(2.0), c("id") % 20)).otherwise(32 * (c("id") % 20 - 4)).cast("bigint"))
_of("mth02_backoff", "audio", "CAST(30 * power(2, id % 8) AS BIGINT) AS wait, CAST(30 * (power(2, id % 8 + 1) - 1) AS BIGINT) AS total", wait=lambda: (30 * F.pow(F.lit(2.0), c("id") % 8)).cast("bigint"), total=lambda: (30 * (F.pow(F.lit(2.0), c("id") % 8 + 1) - 1)).cast("bigint"))
_of("arr01_field_values", "dockets", "list_filter([nullif(case_name,''), nullif(case_name_full,''), nullif(case_name_short,'')], lambda x: x IS NOT NULL) AS names", names=lambda: F.filter(F.array(F.nullif("case_name", F.lit("")), F.nullif("case_name_full", F.lit("")), F.nullif("case_name_short", F.lit(""))), lambda x: x.isNotNull()))
_of("jsn02_item_hash", "audio", "sha256(coalesce(case_name,'') || '|' || coalesce(sha1,'')) AS hash", hash=lambda: F.sha2(F.concat(F.coalesce("case_name", F.lit("")), F.lit("|"), F.coalesce("sha1", F.lit(""))), 256))
_of("dup15_captions_differ", "dockets", "len(list_intersect(a, b)) / greatest(least(len(a), len(b)), 1) < 0.5 AS differs", frm="(SELECT id, list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(coalesce(case_name,'')), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), ' '), lambda w: length(w) > 1 AND NOT list_contains(" + str(list(T.COMMON_CAPTION_WORDS)) + ", w))) AS a, list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(coalesce(case_name_full,'')), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), ' '), lambda w: length(w) > 1 AND NOT list_contains(" + str(list(T.COMMON_CAPTION_WORDS)) + ", w))) AS b FROM dockets)", differs=lambda: T.captions_too_different(F.coalesce("case_name", F.lit("")), F.coalesce("case_name_full", F.lit(""))))
_of(
    "scr18_usefulness", "opinion_clusters",
    "round(greatest(0.0, least(1.0, (500 + bonus + 25 * log10(greatest(coalesce(citation_count, 0), 1)) - CASE WHEN n BETWEEN 15 AND 25 THEN 0 WHEN n < 15 THEN power(20 - n, 2) ELSE power(n - 20, 1.5) END) / 1000)), 6) AS score",
    frm="(SELECT *, CASE WHEN v AND that THEN 400 WHEN that THEN 300 WHEN v THEN 300 WHEN ing AND n > 10 THEN 200 ELSE 0 END AS bonus FROM (SELECT *, len(string_split(coalesce(syllabus, ''), ' ')) AS n, regexp_matches(coalesce(syllabus, ''), '^(holding|deciding|ruling|recognizing|concluding)', 'i') AS v, regexp_matches(coalesce(syllabus, ''), '^\\S+ing that', 'i') AS that, regexp_matches(coalesce(syllabus, ''), '^\\S+ing', 'i') AS ing FROM opinion_clusters))",
    score=lambda: F.round(D.usefulness(F.coalesce("syllabus", F.lit("")), c("citation_count")), 6),
)
_of("scr17_hit_count", "people", "CAST(name_first ILIKE '%an%' AS INT) + CAST(coalesce(name_middle,'') ILIKE '%an%' AS INT) + CAST(name_last ILIKE '%an%' AS INT) + CAST(coalesce(name_suffix,'') ILIKE '%an%' AS INT) AS hits", hits=lambda: sum((F.coalesce(c(f"name_{p}"), F.lit("")).ilike("%an%").cast("int") for p in ("middle", "last", "suffix")), c("name_first").ilike("%an%").cast("int")))
_of("qry06_unbalanced_parens", "documents", "length(text) - length(replace(text,'(','')) <> length(text) - length(replace(text,')','')) AS unbalanced", unbalanced=lambda: F.length(F.replace("text", F.lit("("), F.lit(""))) != F.length(F.replace("text", F.lit(")"), F.lit(""))))
_of("qry07_unbalanced_quotes", "documents", "len(regexp_extract_all(text, '[“”\"]')) % 2 <> 0 AS unbalanced", unbalanced=lambda: F.regexp_count("text", F.lit('[“”"]')) % 2 != 0)
_of("qry08_proximity_tokens", "free_document_rows", "regexp_matches(case_name, '/[sp](\\W|$)') AS has_token", has_token=lambda: c("case_name").rlike(r"/[sp](\W|$)"))
_of("qry11_case_name_like", "dockets", "regexp_matches(lower(case_name), ' v\\.? | vs\\.? |^(in re|matter of|ex parte)') AS is_case", is_case=lambda: F.lower("case_name").rlike(r" v\.? | vs\.? |^(in re|matter of|ex parte)"))
_of("flt24_bare_url", "opinions", "regexp_replace('https://example.test/' || id, '^https?', '') AS url", url=lambda: F.regexp_replace(F.concat(F.lit("https://example.test/"), "id"), "^https?", ""))
_of("src10_normalised", "dockets", "TRY_CAST(nullif(trim(jury_demand), '-8') AS INT) AS jury_no, nullif(trim(cause), '') AS cause_text, strftime(date_filed, '%m/%d/%Y') AS us_date", jury_no=lambda: F.expr("try_cast(nullif(trim(jury_demand), '-8') AS int)"), cause_text=lambda: F.nullif(F.trim("cause"), F.lit("")), us_date=lambda: F.date_format("date_filed", "MM/dd/yyyy"))
_of("src15_build_date", "dockets", "regexp_extract('<lastBuildDate>' || strftime(date_modified, '%Y-%m-%d') || '</lastBuildDate>', '<lastBuildDate>([^<]*)<', 1) AS built", built=lambda: F.regexp_extract(F.concat(F.lit("<lastBuildDate>"), F.date_format("date_modified", "yyyy-MM-dd"), F.lit("</lastBuildDate>")), "<lastBuildDate>([^<]*)<", 1))


@R.add("mth05_word_counts", "SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM documents) GROUP BY w HAVING count(*) > 50")
def mth05(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9_]+)"), F.lit(1))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where("n > 50")


@R.add("mth04_cosine")
def mth04(spark: SparkSession, d: str) -> DataFrame:
    """Bag-of-words cosine of every docket's two case names."""
    return table(spark, d, "dockets").dropDuplicates(["id"]).select("id", F.round(T.bag_cosine(F.coalesce("case_name", F.lit("")), F.coalesce("case_name_full", F.lit(""))), 6).alias("cosine"))


@R.add("dat05_date_list", "SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-03-31', INTERVAL 1 DAY)) AS DATE) AS day")
def dat05(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-03-31").cast("date"))).alias("day"))


@R.add("str39_oxford", "SELECT court_id, CASE WHEN len(k) = 1 THEN k[1] WHEN len(k) = 2 THEN k[1] || ' and ' || k[2] ELSE array_to_string(k[1:len(k)-1], ', ') || ', and ' || k[len(k)] END AS causes, array_to_string(k, ' OR ') AS either FROM (SELECT court_id, list(DISTINCT cause ORDER BY cause) AS k FROM dockets WHERE cause <> '' GROUP BY court_id)")
def str39(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "dockets").where("cause <> ''").groupBy("court_id").agg(F.array_sort(F.collect_set("cause")).alias("k"))
    return g.select("court_id", T.oxford(c("k")).alias("causes"), F.array_join("k", " OR ").alias("either"))


@R.add("jsn03_params", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def jsn03(spark: SparkSession, d: str) -> DataFrame:
    """Typed access to a JSON column."""
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@R.add("str02_wrapped")
def str02(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dockets").dropDuplicates(["id"]).select("id", T.wrapped(c("case_name"), 25).alias("wrapped"))


@R.add("prj02_without_tags")
def prj02(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.without_tags(c("text")).alias("clean"))


@R.add("str04_xml_safe")
def str04(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.xml_safe(c("text")).alias("clean"))
