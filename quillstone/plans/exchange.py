"""Files in and out, the query language, request checks and the batch jobs built from them.

Sources and sinks run as round trips: a table goes out through the sink into
the shared folder and comes back through the source; the SQL twin states what
must come back from the table itself. Checks of queries and parameters are
small tables of cases, and their twins are the answers as the rules give them.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import dockets as D
from quillstone.functions import records as N
from quillstone.functions import text as T
from quillstone.operators import citations as C
from quillstone.operators import graph, language, paging, predicates, ranking, similarity
from quillstone.plans.registry import Registry
from quillstone.plans.relational import DOCS
from quillstone.session import scratch_path
from quillstone.sources import files
from quillstone.sources.tables import path_of, table, views
from quillstone.streaming import pipelines as P

R = Registry()
c = F.col


def both(name: str, tables: str, sql: str, twin: str | None = None) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        views(spark, d, *tables.split())
        return spark.sql(sql)

    R.add(name, twin or sql)(run)


# CSV ---------------------------------------------------------------------------------------------------------------------

_CASES = "id bigint, court_id string, case_name string, docket_number string"


def _exported(spark: SparkSession, d: str, source: str, schema: str, parts: int | None = None) -> str:
    """Path of a table's columns as quoted CSV; NULL goes out as an empty value."""
    names = [x.split()[0] for x in schema.split(", ")]
    path = scratch_path(spark, "csv")
    files.write_quoted_csv(table(spark, d, source).select(*[F.coalesce(c(n).cast("string"), F.lit("")).alias(n) for n in names]), path, parts)
    return path


def _filled(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.coalesce(n, F.lit("")).alias(n) if n in names else c(n) for n in df.columns])


def _csv_rows(spark: SparkSession, d: str, source: str = "dockets", schema: str = _CASES) -> DataFrame:
    back = files.read_csv(spark, _exported(spark, d, source, schema), schema)
    return _filled(back, *[n for n, k in back.dtypes if k == "string"])


_CASES_SQL = "SELECT id, coalesce(court_id, '') AS court_id, coalesce(case_name, '') AS case_name, coalesce(docket_number, '') AS docket_number FROM {}"


@R.add("src07_csv_rows", _CASES_SQL.format("dockets") + " WHERE id >= 100")
def src07(spark, d):
    """A CSV with header read from a given row on; the rows are numbered by their id here."""
    return _csv_rows(spark, d).where("id >= 100")


@R.add("src08_new_rows", "SELECT id, coalesce(case_name, '') AS case_name FROM free_document_rows f WHERE NOT EXISTS (SELECT 1 FROM dockets k WHERE k.case_name = f.case_name)")
def src08(spark, d):
    """Rows of a CSV whose name isn't known yet."""
    rows = _csv_rows(spark, d, "free_document_rows", "id bigint, case_name string")
    return rows.join(table(spark, d, "dockets").where("case_name <> ''").select("case_name").distinct(), "case_name", "left_anti").select("id", "case_name")


@R.add("src09_court_statistics", "SELECT CAST(id AS VARCHAR) AS id, nullif(trim(docket_number), '') AS docket_number, nullif(trim(nature_of_suit), '') AS nature_of_suit, NULL AS filler FROM dockets")
def src09(spark, d):
    """A tab-separated file with padded values, a filler column and blanks."""
    path = scratch_path(spark, "tsv")
    pad = lambda n: F.concat(F.lit("  "), F.coalesce(F.regexp_replace(n, r"[\t\r\n]", " "), F.lit("")), F.lit("  "))
    table(spark, d, "dockets").select(c("id").cast("string").alias("id"), pad("docket_number").alias("docket_number"), pad("nature_of_suit").alias("nature_of_suit"), F.lit("-8").alias("filler")).write.csv(path, sep="\t", header=True, quote="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return files.read_statistics(spark, path, ["id", "docket_number", "nature_of_suit", "filler"])


_EXPORT = "SELECT id AS docket_id, coalesce(case_name, '') AS caption, CAST(date_filed AS VARCHAR) AS filed FROM dockets"


@R.add("snk02_headers_and_columns", _EXPORT)
def snk02(spark, d):
    """An export whose headers and transformed columns come from a map."""
    columns = {"docket_id": c("id"), "caption": F.coalesce("case_name", F.lit("")), "filed": c("date_filed").cast("string")}
    return table(spark, d, "dockets").select(*[v.alias(k) for k, v in columns.items()])


@R.add("snk03_entries_csv", f"SELECT id, coalesce(description, '') AS description, CAST(coalesce(entry_number, -1) AS BIGINT) AS entry_number FROM {DOCS} r WHERE docket_id <= 50")
def snk03(spark, d):
    """A docket's entries as fully quoted CSV, read back."""
    rows = table(spark, d, "recap_documents").where("docket_id <= 50").groupBy("id").agg(F.max("description").alias("description"), F.max("entry_number").alias("entry_number"))
    path = scratch_path(spark, "entries")
    files.write_quoted_csv(rows.select("id", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("entry_number", F.lit(-1)).alias("entry_number")), path)
    return _filled(files.read_csv(spark, path, "id bigint, description string, entry_number bigint"), "description")


@R.add("snk04_bulk_export", "SELECT count(*) AS n, count(DISTINCT id) AS ids, sum(length(coalesce(case_name, ''))) AS letters FROM dockets")
def snk04(spark, d):
    """Every value quoted, backslash as escape: nothing is lost or split, whatever marks the names hold."""
    return _csv_rows(spark, d).agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.sum(F.length("case_name")).alias("letters"))


@R.add("snk05_reimport", _CASES_SQL.format("dockets"))
def snk05(spark, d):
    return _csv_rows(spark, d)


@R.add("snk06_manifest", "SELECT 'bucket' AS bucket, CAST(id AS VARCHAR) AS key FROM opinion_clusters")
def snk06(spark, d):
    """Object keys in files of at most a thousand lines."""
    path = scratch_path(spark, "manifest")
    files.write_manifest(table(spark, d, "opinion_clusters"), "id", "bucket", path, 1000)
    return spark.read.text(path).select(F.split_part("value", F.lit(","), F.lit(1)).alias("bucket"), F.split_part("value", F.lit(","), F.lit(2)).alias("key"))


@R.add("snk08_tolerant_bulk_write", "SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id")
def snk08(spark, d):
    """A bulk write by key in which a conflict keeps the newest record and a repeated batch changes nothing."""
    return _latest(spark, d)


def _latest(spark: SparkSession, d: str) -> DataFrame:
    out = scratch_path(spark, "upsert")
    e = P.open_stream(spark, path_of(d, "events")).select("user_id", "ts")
    P.upsert(e, out, ["user_id"], "ts", scratch_path(spark, "state")).awaitTermination()
    where = spark._jvm.org.apache.hadoop.fs.Path(out)
    newest = max(int(s.getPath().getName()[1:]) for s in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where))
    return spark.read.parquet(f"{out}/v{newest}")


# JSON and XML -----------------------------------------------------------------------------------------------------------


def _case_files(spark: SparkSession, d: str) -> str:
    """Clusters as JSON lines in folders by status, with a body of XML."""
    path = scratch_path(spark, "cases")
    safe = lambda n: F.regexp_replace(F.coalesce(n, F.lit("")), r"[<>&]", "")
    body = F.concat(F.lit("<case><name>"), safe("case_name"), F.lit("</name><opinion type='lead'><p>"), safe("syllabus"), F.lit("</p></opinion></case>"))
    table(spark, d, "opinion_clusters").select("id", "precedential_status", body.alias("body")).write.partitionBy("precedential_status").json(path)
    return path


@R.add("src11_case_files", "SELECT id FROM opinion_clusters WHERE precedential_status = 'Published'")
def src11(spark, d):
    """JSON case files by a glob of one folder."""
    return spark.read.schema("id bigint, body string").json(_case_files(spark, d) + "/precedential_status=Published").select("id")


_BARE = "trim(regexp_replace(coalesce({}, ''), '[<>&]', '', 'g'))"


@R.add("src12_embedded_fields", f"SELECT id, {_BARE.format('case_name')} AS name, 'lead' AS kind FROM opinion_clusters")
def src12(spark, d):
    """Fields of the XML inside each case file."""
    rows = spark.read.schema("id bigint, body string").json(_case_files(spark, d))
    name, kind = files.embedded_xml(c("body"), name="/case/name", kind="/case/opinion/@type")
    return rows.select("id", F.trim(name).alias("name"), kind.alias("kind"))


@R.add("src13_opinion_text", f"SELECT id, length({_BARE.format('case_name')}) + length({_BARE.format('syllabus')}) AS letters FROM opinion_clusters")
def src13(spark, d):
    """The text of an XML opinion without its tags."""
    rows = spark.read.schema("id bigint, body string").json(_case_files(spark, d))
    name, text = files.embedded_xml(c("body"), name="/case/name", text="/case/opinion")
    return rows.select("id", (F.length(F.trim(name)) + F.length(F.trim(T.without_tags(text)))).cast("bigint").alias("letters"))


# Query language and request checks -----------------------------------------------------------------------------------------


def _cases(name: str, answer, cases: list[tuple], doc: str) -> None:
    """A check as a table (asked, answer) over fixed cases; the twin holds the answers that the rule gives."""
    text = lambda v: "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"
    twin = "SELECT * FROM (VALUES " + ", ".join(f"({text(a)}, {text(b)})" for a, b in cases) + ") v(asked, answer)"

    def run(spark: SparkSession, d: str) -> DataFrame:
        return spark.createDataFrame([(a, None if (got := answer(a)) is None else str(got)) for a, _ in cases], "asked string, answer string")

    run.__doc__ = doc
    R.add(name, twin)(run)


def _or_error(f):
    def g(x):
        try:
            return f(x)
        except ValueError:
            return "error"

    return g


_TODAY = dt.date(2024, 3, 10)
_cases("flt06_dates", _or_error(lambda v: predicates.resolve_date(v, _TODAY)), [("2020-02-29", "2020-02-29"), ("-10d", "2024-02-29"), ("5 days ago", "2024-03-05"), ("past 1 year", "2023-03-11"), ("2m ago", "2024-01-10"), ("5d", "error"), ("yesterday", "error"), ("2020-13-01", "error")], "Dates of filters: ISO, relative, or an error.")


@R.add("flt21_empty_values", "SELECT * FROM (VALUES ('court_id', '', 'error'), ('court_id', 'arsd', 'ok'), ('id__in', '[]', 'error'), ('date_filed__isnull', 'False', 'ok')) v(name, given, verdict)")
def flt21(spark, d):
    """An empty filter value is rejected, not ignored."""
    return _verdicts(spark, d, [("court_id", ""), ("court_id", "arsd"), ("id__in", []), ("date_filed__isnull", False)])


@R.add("flt23_unknown_names", "SELECT * FROM (VALUES ('court', 'arsd', 'error'), ('court_id__near', 'arsd', 'error'), ('court_id__startswith', 'ar', 'ok'), ('id__gte', '5', 'ok')) v(name, given, verdict)")
def flt23(spark, d):
    """Unknown columns and lookups are rejected."""
    return _verdicts(spark, d, [("court", "arsd"), ("court_id__near", "arsd"), ("court_id__startswith", "ar"), ("id__gte", 5)])


def _verdicts(spark, d, asked):
    rows = table(spark, d, "dockets")

    def verdict(name, value):
        try:
            predicates.lookups(rows, ["id", "court_id", "date_filed"], **{name: value})
        except ValueError:
            return "error"
        return "ok"

    return spark.createDataFrame([(n, str(v), verdict(n, v)) for n, v in asked], "name string, given string, verdict string")


@R.add("flt26_match_all", "SELECT count(*) AS every, count(*) FILTER (WHERE court_id = 'arsd') AS filtered FROM dockets")
def flt26(spark, d):
    """Without any meaningful filter every row matches."""
    k = table(spark, d, "dockets")
    every, one = predicates.all_of(k, None, None), predicates.all_of(k, None, c("court_id") == "arsd")
    return every.agg(F.count("*").alias("every")).crossJoin(one.agg(F.count("*").alias("filtered")))  # one row each


_cases("qry02_connectors", language.connectors, [("a % b", "a NOT b"), ("a & b", "a AND b"), ("!negl claim", "negl* claim"), ("wom*n", "wom?n"), ("“due process”", '"due process"'), ("plain words", "plain words")], "Foreign connectors in this language.")
_cases("qry03_costly_wildcards", language.has_costly_wildcard, [("*ing", "True"), ("ab*", "True"), ("abc*", "False"), ("!ab", "True"), ("!abc", "False"), ("a b", "False")], "Wildcards that are not accepted.")


def _hits(query: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        names = table(spark, d, "dockets").where("case_name IS NOT NULL").select("id", "case_name")
        return names.where(language.compile_query(language.parse(query), ["case_name"])).select("id")

    return run


_WORD = "list_contains(regexp_split_to_array(lower(case_name), '[^a-z0-9]+'), '{}')"
R.add("qry04_side_by_side", f"SELECT id FROM dockets WHERE {_WORD.format('bank')} AND {_WORD.format('insurance')}")(_hits("bank insurance"))
_cases("qry05_syntax", _or_error(lambda q: "ok" if language.parse(q) is not None else "ok"), [("a AND b", "ok"), ("(a OR b", "error"), ('"a b', "error"), ("a AND", "error"), ("NOT a", "ok")], "Queries that do not parse are errors.")
_cases("qry09_repaired_parens", language.repaired, [("(a OR b", "a OR b"), ("a OR b)", "a OR b"), ("(a) OR (b", "(a) OR b"), ("(a)", "(a)")], "The query without its surplus parentheses.")
_cases("qry10_repaired_quotes", language.repaired, [('"a b', "a b"), ('"a" "b', '"a" b'), ('"a"', '"a"')], "The query without its odd quote.")


def _related(q: str) -> str | None:
    import re

    m = re.match(r"^\s*related:((?:\d+,?)+)\s*(.*)$", q)
    return None if not m else "|".join(x for x in m.group(1).split(",") if x)


_cases("qry14_related_prefix", _related, [("related:12,34", "12|34"), ("related:5 court", "5"), ("a related:5", None), ("related:", None)], "Ids of a query that asks for related documents.")


@R.add("qry15_missing_citations", "SELECT * FROM (VALUES ('1 Ard. 2d 1 lien', 'lien'), ('lien notice', 'lien notice')) v(asked, answer)")
def qry15(spark, d):
    """A query without the citations that no case has."""
    asked = spark.createDataFrame([("1 Ard. 2d 1 lien",), ("lien notice",)], "asked string").withColumn("id", F.monotonically_increasing_id())
    found = C.extract(asked, "id", "asked")
    unknown = spark.createDataFrame([], "volume int, reporter string, page int, case_id bigint")
    status = C.resolve(found, unknown).groupBy("id").agg(F.collect_list(F.when(c("status") == "unmatched", F.concat_ws(" ", "volume", "reporter", "page"))).alias("gone"))
    left = asked.join(status, "id", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<string>")))
    return left.select("asked", F.trim(F.aggregate("gone", c("asked"), lambda s, x: F.replace(s, x, F.lit("")))).alias("answer"))


@R.add("qry16_boosted_fields", "SELECT id, round(greatest(a, b) + 0.3 * (a + b - greatest(a, b)), 6) AS score FROM (SELECT id, 4.0 * CAST(case_name ILIKE '%bank%' AS INT) AS a, 1.0 * CAST(coalesce(cause, '') ILIKE '%bank%' AS INT) AS b FROM dockets WHERE case_name IS NOT NULL) WHERE a + b > 0")
def qry16(spark, d):
    """Best field with its boost, and three tenths of the others."""
    k = table(spark, d, "dockets").where("case_name IS NOT NULL")
    a, b = c("case_name").ilike("%bank%").cast("int") * 4.0, F.coalesce("cause", F.lit("")).ilike("%bank%").cast("int") * 1.0
    return k.where(a + b > 0).select("id", F.round(ranking.best_fields([a, b], 0.3), 6).alias("score"))


# Ranking, pages, highlights ------------------------------------------------------------------------------------------------

both("scr09_semantic_applies", "opinions", "SELECT kind, count(*) AS n FROM (SELECT id, CASE WHEN max(length(trim(plain_text))) > 0 THEN 'text' ELSE 'none' END AS kind FROM opinions GROUP BY id) x GROUP BY kind")


@R.add("scr15_marked_by_kind", "SELECT id, regexp_replace(case_name, '(?i)\\b(bank)\\b', '<strong>\\1</strong>', 'g') AS alert, regexp_replace(case_name, '(?i)\\b(bank)\\b', '<mark>\\1</mark>', 'g') AS search FROM dockets WHERE case_name ILIKE '%bank%'")
def scr15(spark, d):
    """Hits marked for a search and for an alert."""
    k = table(spark, d, "dockets").where(c("case_name").ilike("%bank%"))
    return k.select("id", T.highlighted(c("case_name"), ["bank"], "strong").alias("alert"), T.highlighted(c("case_name"), ["bank"], "mark").alias("search"))


@R.add("agg19_total_price", "SELECT docket_id, round(sum(CASE WHEN is_available THEN 0.0 WHEN page_count > 0 THEN least(3.0, page_count * 0.1) ELSE 0.91 END), 1) AS total FROM (SELECT DISTINCT id, docket_id, is_available, page_count FROM recap_documents) GROUP BY docket_id")
def agg19(spark, d):
    docs = table(spark, d, "recap_documents").select("id", "docket_id", "is_available", "page_count").distinct()
    return docs.groupBy("docket_id").agg(F.round(F.sum(D.document_price(F.coalesce("is_available", F.lit(False)), c("page_count"))), 1).alias("total"))


_cases("srt03_toggled", paging.toggled, [("date desc", "date asc"), ("date asc,id desc", "date desc,id asc")], "An order the other way, for backward pages.")
_cases("srt10_cursors", lambda v: paging.decode_cursor(paging.encode_cursor((v, 7), True)), [("2020-01-02", "(('2020-01-02', 7), True)"), ("é", "(('é', 7), True)")], "Cursors that come back as they were.")


@R.add("srt06_deep_pages", "SELECT * FROM (VALUES (0, 'ok'), (1, 'ok'), (100, 'ok'), (101, 'error')) v(page, verdict)")
def srt06(spark, d):
    k = table(spark, d, "dockets")

    def verdict(page):
        try:
            paging.offset_page(k, [c("id")], page, 20)
        except ValueError:
            return "error"
        return "ok"

    return spark.createDataFrame([(p, verdict(p)) for p in (0, 1, 100, 101)], "page int, verdict string")


@R.add("str08_token_counts", "SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '')) AS tokens FROM documents")
def str08(spark, d):
    """Words of each text, the count that budgets go by where no tokenizer is at hand."""
    return table(spark, d, "documents").select("doc_id", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\r\f\x0B]+"), lambda w: w != "")).cast("bigint").alias("tokens"))


# Citations, graphs ------------------------------------------------------------------------------------------------------------


def _extracted(spark, d):
    return C.extract(table(spark, d, "opinions"), "id", "plain_text").dropDuplicates(["id", "seq"])


@R.add("cit09_reverse_match")
def cit09(spark, d):
    """Clusters whose last ten name words all stand in the text of one of their opinions."""
    words = lambda x: F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 1)
    k = table(spark, d, "opinion_clusters").select(c("id").alias("cluster_id"), F.slice(F.reverse(words("case_name")), 1, 10).alias("last")).where(F.size("last") > 0)
    o = table(spark, d, "opinions").select("id", "cluster_id", F.array_distinct(words("plain_text")).alias("held")).dropDuplicates(["id"])
    return o.join(k, "cluster_id").where(F.size(F.array_except("last", "held")) == 0).select("id", "cluster_id")


@R.add("cit10_single_citation", "SELECT * FROM (VALUES ('1 Ard. 2d 1', 404), ('5 Nope 3', 400)) v(asked, code)")
def cit10(spark, d):
    """A query that is a single citation, with its status."""
    asked = spark.createDataFrame([("1 Ard. 2d 1", 1, "Ard. 2d", 1), ("5 Nope 3", 5, "Nope", 3)], "asked string, volume int, reporter string, page int")
    return C.lookup_status(asked, spark.createDataFrame([], "volume int, reporter string, page int, case_id bigint")).select("asked", "code")


@R.add("cit20_annotation_classes", "SELECT * FROM (VALUES ('410 Ard. 2d 12', 'matched'), ('7 Ard. 2d 9', 'ambiguous'), ('8 Ard. 2d 9', 'unmatched')) v(cite, class)")
def cit20(spark, d):
    """The three classes of an annotated citation: one case, several, none."""
    asked = spark.createDataFrame([("410 Ard. 2d 12 and 7 Ard. 2d 9; 8 Ard. 2d 9", 1)], "t string, id int")
    known = spark.createDataFrame([(410, "Ard. 2d", 12, 1), (7, "Ard. 2d", 9, 2), (7, "Ard. 2d", 9, 3)], "volume int, reporter string, page int, case_id bigint")
    return C.resolve(C.extract(asked, "id", "t"), known).select(F.concat_ws(" ", "volume", "reporter", "page").alias("cite"), c("status").alias("class"))


@R.add("cit23_supra")
def cit23(spark, d):
    """Supra citations by the cases cited in full in the same text."""
    names = table(spark, d, "opinion_clusters").dropDuplicates(["id"]).select(c("id").alias("case_id"), "case_name")
    from quillstone.plans.domain import _cases as known

    return C.resolve_supra(C.extract_supra(table(spark, d, "opinions"), "id", "plain_text").dropDuplicates(["id", "seq"]), C.resolve(_extracted(spark, d), known(spark, d)), names, "id")


@R.add("dup06_aligned_opinions")
def dup06(spark, d):
    """For each opinion of a cluster the one of the same cluster it is most like, where likeness or overlap is sixty in a hundred."""
    o = table(spark, d, "opinions").where("length(trim(plain_text)) > 0").groupBy("id", "cluster_id").agg(F.max("plain_text").alias("t"))
    few = o.join(o.groupBy("cluster_id").count().where("count BETWEEN 2 AND 20").select("cluster_id"), "cluster_id")
    a, b = few.select("cluster_id", c("id").alias("a"), c("t").alias("x")), few.select("cluster_id", c("id").alias("b"), c("t").alias("y"))
    scored = a.join(b, "cluster_id").where("a <> b").withColumn("cosine", T.bag_cosine(c("x"), c("y")))
    best = scored.groupBy("a").agg(F.max_by(F.struct("b", "cosine"), F.struct("cosine", "b")).alias("m"))
    return best.where("m.cosine >= 0.6").select("a", "m.b", F.round("m.cosine", 4).alias("cosine"))


@R.add("grf02_within_hops", "WITH e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_partkey <> l_suppkey), w AS (SELECT dst AS node, 1 AS d FROM e WHERE src = 1 UNION SELECT e.dst, 2 FROM e JOIN (SELECT dst FROM e WHERE src = 1) x ON x.dst = e.src) SELECT node, min(d) AS hops FROM w WHERE node <> 1 GROUP BY node")
def grf02(spark, d):
    """Nodes within two hops of a start."""
    e = table(spark, d, "lineitem").where("l_partkey <> l_suppkey").select(c("l_partkey").cast("bigint").alias("src"), c("l_suppkey").cast("bigint").alias("dst")).distinct()
    return graph._distances(e, 1, 2, "src", "dst").where("d > 0").select("node", c("d").alias("hops"))


# Streams ------------------------------------------------------------------------------------------------------------------------

_NEWEST = "SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id"
for _name in ("stm01_change_upserts", "stm04_partial_update", "stm27_feed_merge", "job51_merge_again"):
    R.add(_name, _NEWEST)(lambda spark, d: _latest(spark, d))


@R.add("stm05_saved_then_alerted", "SELECT (SELECT count(*) FROM events) AS saved, (SELECT count(*) FROM events WHERE event_type = 'purchase') AS alerted")
def stm05(spark, d):
    """Every batch is saved, then goes on to the alerts."""
    saved, alerted = scratch_path(spark, "saved"), scratch_path(spark, "alerted")
    e = P.open_stream(spark, path_of(d, "events")).select("event_id", "event_type")
    P.route(e, scratch_path(spark, "state"), saved=lambda b: b.write.mode("append").parquet(saved), alerted=lambda b: b.where("event_type = 'purchase'").write.mode("append").parquet(alerted)).awaitTermination()
    n = lambda p, k: spark.read.schema("event_id bigint, event_type string").parquet(p).agg(F.count("*").alias(k))
    return n(saved, "saved").crossJoin(n(alerted, "alerted"))  # one row each


@R.add("stm29_throttled", "SELECT count(*) AS n FROM events")
def stm29(spark, d):
    """A source throttled to one file a batch: nothing is lost."""
    rows = P.open_stream(spark, path_of(d, "events"), per_trigger=1)
    return P.drain(rows.select("event_id"), "throttled").agg(F.count("*").alias("n"))


@R.add("stm36_late_data", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def stm36(spark, d):
    """Late repeats within the watermark are dropped once for each user and type."""
    e = P.open_stream(spark, path_of(d, "events")).withColumn("ts", c("ts").cast("timestamp"))
    seen = P.drain(P.claimed_once(e, ["user_id", "event_type"], "ts", "40 days").select("user_id", "event_type"), "late")
    return seen.groupBy("event_type").agg(F.count("*").alias("users"))


# Batch jobs -------------------------------------------------------------------------------------------------------------------

both("job02_daily_sweep", "recap_documents dockets", f"SELECT k.court_id, count(DISTINCT k.id) AS dockets, count(*) AS documents FROM {DOCS} r JOIN dockets k ON k.id = r.docket_id WHERE CAST(r.date_upload AS DATE) = (SELECT max(CAST(date_upload AS DATE)) FROM recap_documents) GROUP BY k.court_id")
both("job03_flushed_hits", "events", "SELECT date_trunc('hour', ts) AS slot, count(*) AS hits FROM events GROUP BY date_trunc('hour', ts)")
both("job08_pending_again", "audio", "SELECT id FROM (SELECT id, max(duration) AS duration FROM audio GROUP BY id) a WHERE coalesce(duration, 0) < 600")
R.add("job15_new_cases", "SELECT id, coalesce(case_name, '') AS case_name FROM free_document_rows f WHERE NOT EXISTS (SELECT 1 FROM dockets k WHERE k.case_name = f.case_name)")(src08)
both("job17_joined_export", "dockets attorneys", "SELECT k.id, coalesce(k.nature_of_suit, '') AS nature, count(a.id) AS attorneys FROM dockets k JOIN (SELECT DISTINCT id, docket_id FROM attorneys) a ON a.docket_id = k.id WHERE k.court_id = 'arsd' GROUP BY k.id, coalesce(k.nature_of_suit, '')")
both("job19_filled_fields", "dockets free_document_rows", "SELECT k.id, coalesce(nullif(k.case_name, ''), f.case_name) AS case_name, coalesce(k.date_filed, f.filed) AS filed FROM dockets k JOIN (SELECT court_id, docket_number, max(case_name) AS case_name, max(date_filed) AS filed FROM free_document_rows WHERE docket_number <> '' GROUP BY court_id, docket_number) f ON f.court_id = k.court_id AND f.docket_number = k.docket_number")
both("job24_longer_values", "dockets", "SELECT id, CASE WHEN length(coalesce(case_name_full, '')) > length(coalesce(case_name, '')) THEN case_name_full ELSE case_name END AS kept FROM dockets WHERE case_name_full IS NOT NULL")


@R.add("job21_texts_written", "SELECT count(*) AS n FROM (SELECT DISTINCT id FROM opinions WHERE length(trim(plain_text)) > 0)")
def job21(spark, d):
    """Opinions serialised as one line of text each, read back."""
    path = scratch_path(spark, "texts")
    o = table(spark, d, "opinions").where("length(trim(plain_text)) > 0").groupBy("id").agg(F.max("plain_text").alias("t"))
    o.select(F.to_json(F.struct("id", "t")).alias("value")).write.text(path)
    return spark.read.text(path).agg(F.count("*").alias("n"))


@R.add("job25_matched_files", "SELECT k.id, f.id AS docket_id FROM opinion_clusters k JOIN dockets f ON f.case_name = trim(regexp_replace(coalesce(k.case_name, ''), '[<>&]', '', 'g')) WHERE f.case_name <> ''")
def job25(spark, d):
    """Case files with embedded XML matched to dockets by name."""
    rows = src12(spark, d).where("name <> ''").select(c("id"), c("name").alias("case_name"))
    return rows.join(table(spark, d, "dockets").select(c("id").alias("docket_id"), "case_name"), "case_name").select("id", "docket_id")


for _name, _source in (("job26_inventory_to_cases", "dockets"), ("job27_inventory_to_dockets", "free_document_rows")):
    R.add(_name, _CASES_SQL.format(_source))(lambda spark, d, s=_source: _through_json(spark, d, s))


def _through_json(spark: SparkSession, d: str, source: str) -> DataFrame:
    """An inventory in CSV leads to JSON objects, which are read with a given schema."""
    path = scratch_path(spark, "objects")
    _csv_rows(spark, d, source).write.json(path, ignoreNullFields=False)
    return spark.read.schema(_CASES).json(path)


R.add("job28_corpus_import", _CASES_SQL.format("free_document_rows"))(lambda spark, d: _csv_rows(spark, d, "free_document_rows"))
R.add("job42_metadata_import", _CASES_SQL.format("dockets"))(lambda spark, d: _through_json(spark, d, "dockets"))
R.add("job45_people_import", "SELECT id, coalesce(name_first, '') AS name_first, coalesce(name_last, '') AS name_last FROM people")(lambda spark, d: _csv_rows(spark, d, "people", "id bigint, name_first string, name_last string"))
R.add("job47_statistics_import", R.sql["src09_court_statistics"])(src09)


@R.add("job30_hits_to_manifest", "SELECT 'bucket' AS bucket, CAST(id AS VARCHAR) AS key FROM dockets WHERE case_name ILIKE '%bank%'")
def job30(spark, d):
    path = scratch_path(spark, "manifest")
    files.write_manifest(table(spark, d, "dockets").where(c("case_name").ilike("%bank%")), "id", "bucket", path, 500)
    return spark.read.text(path).select(F.split_part("value", F.lit(","), F.lit(1)).alias("bucket"), F.split_part("value", F.lit(","), F.lit(2)).alias("key"))


@R.add("job32_selected_archive", "SELECT year(date_filed) AS year, count(*) AS n FROM opinion_clusters WHERE precedential_status = 'Published' AND date_filed IS NOT NULL GROUP BY year(date_filed)")
def job32(spark, d):
    """A selection written as an archive in folders by month, counted from there."""
    path = scratch_path(spark, "archive")
    files.write_by_month(table(spark, d, "opinion_clusters").where("precedential_status = 'Published' AND date_filed IS NOT NULL"), "date_filed", path)
    return spark.read.parquet(path).groupBy("year").agg(F.count("*").alias("n"))


both("job35_probe_numbers", "dockets", "SELECT court_id, max(id) + 1 AS first, max(id) + 2 AS second, max(id) + 4 AS third, max(id) + 8 AS fourth FROM dockets GROUP BY court_id")
both("job36_id_ranges", "dockets", "SELECT court_id, min(id) AS low, max(id) AS high, count(*) AS n FROM dockets GROUP BY court_id")


@R.add("job39_names_by_number", "SELECT f.id, k.id AS docket_id FROM free_document_rows f JOIN dockets k ON k.court_id = f.court_id AND k.docket_number = f.docket_number WHERE f.docket_number <> '' AND len(list_intersect(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(f.case_name, '')), '[^a-z]+'), lambda w: length(w) > 3)), list_filter(regexp_split_to_array(lower(coalesce(k.case_name, '')), '[^a-z]+'), lambda w: length(w) > 3))) > 0")
def job39(spark, d):
    """Listed rows matched by court and number, confirmed by a shared word of the name."""
    words = lambda n: F.filter(F.split(F.lower(F.coalesce(n, F.lit(""))), "[^a-z]+"), lambda w: F.length(w) > 3)
    f = table(spark, d, "free_document_rows").where("docket_number <> ''").select("id", "court_id", "docket_number", words("case_name").alias("a"))
    k = table(spark, d, "dockets").select(c("id").alias("docket_id"), "court_id", "docket_number", words("case_name").alias("b"))
    return f.join(k, ["court_id", "docket_number"]).where(F.arrays_overlap("a", "b")).select("id", "docket_id")


both("job41_first_key_that_fits", "free_document_rows dockets", "SELECT f.id, coalesce(a.docket_id, b.docket_id) AS docket_id FROM free_document_rows f LEFT JOIN (SELECT court_id, docket_number, min(id) AS docket_id FROM dockets WHERE docket_number <> '' GROUP BY court_id, docket_number) a ON a.court_id = f.court_id AND a.docket_number = f.docket_number LEFT JOIN (SELECT court_id, case_name, date_filed, min(id) AS docket_id FROM dockets WHERE case_name <> '' GROUP BY court_id, case_name, date_filed) b ON b.court_id = f.court_id AND b.case_name = f.case_name AND b.date_filed = f.date_filed")


@R.add("job52_polled_feeds", "SELECT DISTINCT event_type, user_id FROM events")
def job52(spark, d):
    """Items of polled feeds, each claimed once by its hash."""
    e = P.open_stream(spark, path_of(d, "events")).withColumn("ts", c("ts").cast("timestamp")).withColumn("hash", P.item_hash("event_type", "user_id"))
    return P.drain(P.claimed_once(e, ["hash"], "ts", "40 days").select("event_type", "user_id"), "feeds")


both("job56_missing_since", "opinion_clusters opinions", "SELECT k.id FROM opinion_clusters k LEFT JOIN (SELECT DISTINCT cluster_id FROM opinions WHERE length(trim(plain_text)) > 0) o ON o.cluster_id = k.id WHERE o.cluster_id IS NULL")
both("job58_token_estimate", "documents", "SELECT round(avg(n_chars) / 4.0 * count(*), 2) AS tokens FROM documents")
both("job60_vectors_of_documents", "embeddings documents", "SELECT e.vec_id FROM embeddings e WHERE e.vec_id IN (SELECT doc_id FROM documents)")
both("job61_rebuilt_documents", "dockets recap_documents", f"SELECT k.id, k.case_name, count(r.id) AS children, sum(CASE WHEN r.is_available THEN 1 ELSE 0 END) AS available FROM dockets k LEFT JOIN {DOCS} r ON r.docket_id = k.id GROUP BY k.id, k.case_name")
both("job64_cleaned_numbers", "dockets", "SELECT court_id, count(*) AS n, count(DISTINCT trim(docket_number)) AS numbers FROM dockets WHERE docket_number IS NOT NULL GROUP BY court_id")
both("job69_crosswalk_files", "opinion_clusters opinions", "SELECT k.id, count(o.id) AS files FROM opinion_clusters k JOIN (SELECT id, max(cluster_id) AS cluster_id, max(sha1) AS sha1 FROM opinions GROUP BY id) o ON o.cluster_id = k.id WHERE o.sha1 <> '' GROUP BY k.id")


@R.add("job68_token_batches")
def job68(spark, d):
    """Documents in order, cut into batches by a budget of characters, by running sums within each court."""
    rows = table(spark, d, "documents").select("doc_id", F.coalesce("court_id", F.lit("")).alias("court"), F.coalesce("n_chars", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("court").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("doc_id", "court", F.floor(F.coalesce(total, F.lit(0)) / 200_000).alias("batch"))


@R.add("job01_stored_queries", "SELECT count(*) FILTER (WHERE event_type = 'purchase') AS first, count(*) FILTER (WHERE event_type = 'view' AND user_id > 10) AS second FROM events")
def job01(spark, d):
    """Saved alerts compiled to predicates, evaluated together in one scan."""
    saved = {"first": [("event_type", "exact", "purchase")], "second": [("event_type", "exact", "view"), ("user_id", "gt", 10)]}
    compiled = {}
    for name, clauses in saved.items():
        pred = F.lit(True)
        for column, how, value in clauses:
            pred = pred & predicates._LOOKUPS[how](c(column), value)
        compiled[name] = pred
    return table(spark, d, "events").agg(*[F.count_if(p).alias(n) for n, p in compiled.items()])
