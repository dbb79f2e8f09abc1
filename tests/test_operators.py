import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillstone.functions import dockets as D
from quillstone.functions import text as T
from quillstone.operators import citations, components, family, graph, language, paging, percolate, predicates, ranking, sequence, similarity
from quillstone.sources import files
from quillstone.streaming import pipelines


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "f, value, want",
    [
        (lambda c: T.truncated(c, 12, "..."), "alpha beta gamma", "alpha..."),
        (lambda c: T.truncated(c, 50), "alpha beta", "alpha beta"),
        (lambda c: T.truncated(c, 4), "alphabet", "alph"),
        (lambda c: T.wrapped(c, 10), "one two three four five", "one two three"),
        (T.snake_case, "dateFiledMax", "date_filed_max"),
        (T.hyphenated, "1:20—cv–—7", "1:20-cv-7"),
        (T.unrepeated_lines, "a\na\nb\na", "a\nb\na"),
        (T.masked_identifiers, "123-45-6789 12-3456789 A12345678", "XXX-XX-XXXX XX-XXXXXXX AXXXXXXXX"),
        (T.us_phone, "tel (404) 555-0100 x2", "(404) 555-0100"),
        (T.us_phone, "none", ""),
        (T.parties, "Ames v. Bell v. Cole", ["Ames", "Bell v. Cole"]),
        (T.parties, "In re Ames", []),
        (T.bankruptcy_parties, "In re Ames", []),
        (T.bankruptcy_parties, "Ames v. Bell (closed)", ["Ames", "Bell"]),
        (lambda c: T.oxford(F.split(c, ",")), "a,b,c", "a, b, and c"),
        (lambda c: T.chunks(c, 3), "abcdefgh", ["abc", "def", "gh"]),
        (T.xml_safe, "a\x00b\x0bc\n", "abc\n"),
        (T.without_tags, "<p>Hi <b>you</b></p><script>x()</script>", "Hi you"),
        (D.clean_number, "CIVIL ACTION NO. 7:17-CV-00426", "7:17-cv-00426"),
        (D.clean_number, "Nos. 17-11426, 15-11166", ""),
        (D.clean_number, "No. 17-1142", "17-1142"),
        (D.number_core, "2:12-cv-01032", "1201032"),
        (D.number_core, "12-332", "12000332"),
        (D.number_core, None, ""),
        (D.supreme_number, "No. 01A576 (01-8099)", "01-8099"),
        (D.supreme_number, "01A576", "01a576"),
        (D.federal_appellate, "Case No. 12 – 345.", "12-345"),
        (D.entry_text, "ORDER [12] granting (Entered: 01/02/2014)", "ORDER 12 granting"),
        (D.attorney_role, "LEAD ATTORNEY; ATTORNEY TO BE NOTICED", "notice"),
    ],
)
def test_functions(spark, f, value, want):
    assert one(spark, value, f) == want


def test_natural_key_orders_by_value(spark):
    got = [r["x"] for r in spark.createDataFrame([("a10",), ("a9",), ("a010b",)], "x string").orderBy(T.natural_key(F.col("x"))).collect()]
    assert got[0] == "a9"


def test_cosine(spark):
    df = spark.createDataFrame([("a b", "b a"), ("a", "b"), ("", "b"), ("a a b", "a b b")], "x string, y string")
    assert [round(r["c"], 3) for r in df.select(T.bag_cosine(F.col("x"), F.col("y")).alias("c")).collect()] == [1.0, 0.0, 0.0, 0.8]


def test_usefulness_prefers_holdings(spark):
    df = spark.createDataFrame([("holding that the clause was void because nobody had signed it and it was late by ten days", 10), ("see below", 10)], "t string, n int")
    a, b = [r["s"] for r in df.select(D.usefulness(F.col("t"), F.col("n")).alias("s")).collect()]
    assert a > 0.8 > b


def test_predicates(spark):
    df = spark.createDataFrame([(1, "a", dt.date(2024, 1, 5)), (2, "b", None)], "n int, s string, d date")
    assert predicates.term("s", "") is None and predicates.term("s", ["", ""]) is None and predicates.number_range("n", 0, 0) is None
    assert predicates.all_of(df, predicates.term("s", ["a", ""]), predicates.date_range("d", "2024-01-05", "2024-01-05")).count() == 1
    assert predicates.resolve_date("past 2 months", dt.date(2024, 3, 1)) == dt.date(2024, 1, 1)
    assert predicates.resolve_date("-1y", dt.date(2024, 1, 1)) == dt.date(2023, 1, 1)
    for bad in ("5d", "soon"):
        with pytest.raises(ValueError):
            predicates.resolve_date(bad)
    with pytest.raises(ValueError):
        predicates.lookups(df, ["n"], s="a")
    with pytest.raises(ValueError):
        predicates.lookups(df, ["n"], n="")
    assert predicates.lookups(df, ["n", "d"], n__lte=2, d__isnull=True).count() == 1


def test_family(spark):
    p = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "id int, name string")
    k = spark.createDataFrame([(10, 1, 5), (11, 1, 7), (12, 2, 1), (13, 1, 6)], "kid int, pid int, s int")
    assert {tuple(r) for r in family.has_child(p, k, "id", "pid", None, F.col("s")).select("id", "child_score").collect()} == {(1, 7), (2, 1)}
    best = family.best_children(k, "pid", [F.col("s").desc()], 2).collect()
    assert [(r["kid"], r["child_remaining"]) for r in sorted(best, key=lambda r: (r["pid"], r["child_rank"]))] == [(11, True), (13, True), (12, False)]
    assert family.family_search(p, k, "id", "pid", F.col("s") > 6, F.col("name") == "y", F.lit(True), F.lit(True)).count() == 2


def test_entry_sequence_is_by_run(spark):
    rows = [(1, 1, "2014-01-03", 4), (1, 2, "2014-01-02", 3), (1, 3, "2014-01-03", 2), (1, 4, "2014-01-03", 1), (2, 1, "2014-01-01", None)]
    df = spark.createDataFrame(rows, "g int, p int, d string, n int")
    got = {(r["g"], r["p"]): r["sequence_number"] for r in sequence.entry_sequence(df, "g", "p", F.to_date("d"), F.col("n")).collect()}
    assert got == {(1, 4): "2014-01-03.001", (1, 3): "2014-01-03.002", (1, 2): "2014-01-02.001", (1, 1): "2014-01-03.001", (2, 1): "2014-01-01.001"}


def test_first_gap(spark):
    d = dt.date
    rows = [(1, 1, d(2020, 1, 1)), (1, 2, d(2020, 1, 2)), (1, 4, d(2020, 1, 4)), (2, 2, d(2020, 1, 1)), (3, None, d(2020, 1, 1)), (4, 1, d(2021, 1, 1))]
    df = spark.createDataFrame(rows, "g int, n int, d date")
    assert {r["g"]: r["start"] for r in sequence.first_gap_date(df, "g", "n", "d").collect()} == {1: d(2020, 1, 2), 2: d(1960, 1, 1), 3: d(1960, 1, 1), 4: d(2021, 1, 1)}


def test_paging(spark):
    df = spark.createDataFrame([(i, i // 3) for i in range(20)], "id int, s int")
    first = [r["id"] for r in paging.search_after(df, "s", "id", 5).collect()]
    second = [r["id"] for r in paging.search_after(df, "s", "id", 5, (5, 15)).collect()]
    assert first == [19, 18, 17, 16, 15, 14] and second[0] == 14
    assert [r["id"] for r in paging.search_after(df, "s", "id", 2, (5, 15), backward=True).collect()] == [18, 17, 16]
    assert paging.decode_cursor(paging.encode_cursor((3, "x"), True)) == ((3, "x"), True)
    assert paging.toggled("a asc,b desc") == "a desc,b asc"
    with pytest.raises(ValueError):
        paging.offset_page(df, [F.col("id")], 101, 5)
    assert [r["n"] for r in spark.createDataFrame([(7,), (45,), (1234,)], "x bigint").select(paging.two_digits(F.col("x")).alias("n")).collect()] == [7, 45, 1200]


def test_ranking(spark):
    df = spark.createDataFrame([(1, "motion to dismiss the motion"), (2, "order on the motion"), (3, "brief"), (4, None), (5, "")], "id int, t string")
    got = {r["id"]: r["score"] for r in ranking.bm25(df, "id", "t", ["motion", "dismiss"]).collect()}
    assert set(got) == {1, 2} and got[1] > got[2]
    assert [r["id"] for r in ranking.bm25(df, "id", "t", ["motion", "dismiss"], need_all=True).collect()] == [1]
    assert [r["id"] for r in ranking.phrase(df, "t", ["motion", "dismiss"], 1).collect()] == [1]
    assert ranking.phrase(df, "t", ["motion", "dismiss"]).count() == 0
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8])], "id int, e array<float>")
    assert [r["id"] for r in ranking.nearest(v, "id", "e", [0.0, 1.0], 2, 0.5).collect()] == [2]


def test_components_and_similar_sets(spark):
    nodes = spark.range(1, 9).withColumnRenamed("id", "id")
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (6, 7)], "a bigint, b bigint")
    assert {r["id"]: r["cls"] for r in components.classes(nodes, edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8}
    rows = [(i, 1, list(w)) for i, w in enumerate(["abcd", "abce", "xyz", "abcd", "wxyz", ""])]
    got = {(r["a"], r["b"]) for r in components.similar_sets(spark.createDataFrame(rows, "k int, g int, s array<string>"), "k", "g", "s", 0.5).collect()}
    assert got == {(0, 1), (0, 3), (2, 4)}


def test_citations(spark):
    df = spark.createDataFrame([(1, "See 12 Ard. 2d 34 (1990); 12 Ard.\n2d 34; 5 Prov. Ct. 6."), (2, None)], "id int, t string")
    cases = spark.createDataFrame([(12, "Ard. 2d", 34, 100), (5, "Prov. Ct.", 6, 7), (5, "Prov. Ct.", 6, 8)], "volume int, reporter string, page int, case_id int")
    got = citations.resolve(citations.extract(df, "id", "t"), cases)
    assert sorted((r["seq"], r["status"]) for r in got.collect()) == [(0, "matched"), (1, "matched"), (2, "ambiguous")]
    assert [tuple(r) for r in citations.edges(got, "id").collect()] == [(1, 100, 2)]
    assert citations.resolve(citations.extract(df, "id", "t"), cases.withColumn("case_id", F.lit(1)), "id").where("case_id = 1").count() == 0
    short = spark.createDataFrame([(1, 12, "Ard. 2d"), (1, 99, "Ard. 2d")], "id int, volume int, reporter string")
    assert {r["volume"]: r["case_id"] for r in citations.resolve_short(short, got, "id").collect()} == {12: 100, 99: None}


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 4), (4, 5), (2, 9)], "src bigint, dst bigint")
    assert {r["node"] for r in graph.path_nodes(e, 1, 4, 3).collect()} == {1, 2, 3, 4}
    assert {r["node"] for r in graph.path_nodes(e, 1, 4, 1).collect()} == {1, 4}
    with pytest.raises(ValueError):
        graph.path_nodes(e, 1, 4, 3, most=3)


def test_language(spark):
    assert language.connectors("a & b % c !run wo*d") == "a AND b NOT c run* wo?d"
    assert language.repaired('((a) “b') == "(a) b"
    assert language.unbalanced_quotes('“a"b"') and language.has_proximity_token("a /s b") and not language.has_proximity_token("a /sb")
    assert language.cleaned("1:20-cv-00042 12") == 'docket_number:"1:20-cv-00042"~1 "12"'
    assert language.with_child_courts("court_id:a x", {"a": ["b"]}) == "court_id:(a OR b) x"
    for bad in ("*ing", "a* b", "!ab c"):
        with pytest.raises(language.QueryError):
            language.cleaned(bad)
    for bad in ("(a", '"a', "a OR", "", "a /p b", ")a("):
        with pytest.raises(language.QueryError):
            language.parse(bad)
    df = spark.createDataFrame([(1, "Motion to dismiss", "x"), (2, "Order on motion", "y"), (3, "Dismissal order", "x"), (4, None, "x")], "id int, t string, c string")
    ask = lambda q: {r["id"] for r in df.where(language.compile_query(language.parse(q), ["t"], ("c",))).collect()}
    assert ask("motion") == {1, 2} and ask("motion NOT order") == {1} and ask("dismiss* c:x") == {1, 3}
    assert ask('"order on motion" OR c:(x) dismissal') == {2, 3} and ask('"motion dismiss"~1') == {1} and ask("mo?ion order") == {2}


def test_percolate(spark):
    docs = spark.createDataFrame([(1, "arsd", "the motion"), (2, "kesd", "an order")], "id int, court string, t string")
    q = spark.createDataFrame([(7, 1, "court", "ARSD"), (7, 1, "t", "motion"), (8, 1, "t", "order"), (8, 2, "court", "arsd"), (9, 1, "t", "none")], "alert_id int, branch int, field string, value string")
    hits = percolate.percolate(percolate.features(docs, "id", ["court"], ["t"]), q, "id")
    assert {tuple(r) for r in hits.collect()} == {(7, 1), (8, 1), (8, 2)}
    assert percolate.unseen(hits, hits.where("id = 1"), ["alert_id", "id"]).count() == 1


def test_similarity(spark):
    df = spark.createDataFrame([("the court finds", "the court find"), ("abc", "xyz"), (None, "")], "a string, b string")
    r = [x["r"] for x in df.select(similarity.sequence_ratio("a", "b").alias("r")).collect()]
    assert r[0] > 0.9 and r[1] == 0 and r[2] == 1
    t = spark.createDataFrame([("g", i, n) for i, n in enumerate([3, 4, 5, 9, 1, 6])], "g string, k int, n int")
    assert {x["k"]: x["batch"] for x in similarity.token_batches(t, "k", "n", 8, 2, "g").collect()} == {0: 1, 1: 1, 2: 2, 5: 3}


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", b'), (2, "line\nbreak"), (3, None)], "id int, t string")
    files.write_quoted_csv(df, str(tmp_path / "csv"))
    back = files.read_csv(spark, str(tmp_path / "csv"), "id int, t string")
    assert {(r["id"], r["t"] or None) for r in back.collect()} == {(1, 'a "quoted", b'), (2, "line\nbreak"), (3, None)}
    (tmp_path / "s.tsv").write_text("A\tB\n 5 \t-8\n\t01/02/2020\n")
    s = files.read_statistics(spark, str(tmp_path / "s.tsv"), ["A", "B"])
    assert s.select(files.as_int(F.col("A")), files.as_us_date(F.col("B"))).collect() == [(5, None), (None, dt.date(2020, 1, 2))]
    files.write_by_month(spark.createDataFrame([(dt.date(2020, 1, 5),), (dt.date(2020, 2, 5),)], "d date"), "d", str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).where("year = 2020 AND month = 2").count() == 1
    files.write_manifest(df, "id", "bucket", str(tmp_path / "man"), 2)
    assert spark.read.text(str(tmp_path / "man")).count() == 3
    (tmp_path / "c.json").write_text('{"name": "x", "xml": "<a><b>7</b></a>"}')
    case = files.read_cases(spark, str(tmp_path / "c.json"), "name string, xml string")
    assert case.select(*files.embedded_xml(F.col("xml"), b="/a/b")).first()["b"] == "7"
    kid = spark.createDataFrame([(1, "kid")], "id int, t string").withColumn("own", F.lit(1))
    assert files.flattened(kid, df, "id").first()["t"] == 'a "quoted", b'
    assert "<title>1</title>" in files.write_feed(df, "id", "t", "t")


def test_streams(spark, tmp_path):
    rows = [(i % 3, i % 5, dt.datetime(2024, 1, 1 + i % 4)) for i in range(40)]
    spark.createDataFrame(rows, "alert bigint, doc bigint, at timestamp").write.parquet(str(tmp_path / "in"))
    s = lambda: pipelines.open_stream(spark, str(tmp_path / "in"))
    assert pipelines.drain(pipelines.alert_hits(s(), "alert", "doc", "at"), "h").select("alert", "doc").distinct().count() == 15
    assert pipelines.drain(pipelines.alert_hits(s(), "alert", "doc", "at", most=2), "h2").count() == 6
    assert pipelines.drain(pipelines.claimed_once(s(), ["alert"], "at", "30 days"), "c").count() == 3
    assert pipelines.drain(pipelines.tally(s(), "at", ["alert"]), "t", "complete").agg(F.sum("n")).first()[0] == 40
    q = pipelines.upsert(s(), str(tmp_path / "table"), ["alert"], "at", str(tmp_path / "ck"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "table" / "v0")).count() == 3


# Citations by place ------------------------------------------------------------------------------------------------------


def test_citations_know_their_place(spark):
    """Positions count the words before; short and supra citations lead to the one case cited in full."""
    from quillstone.operators import citations as C

    text = "See Ames v. Bell, 410 Ard. 2d 12, 7 Fed. Dec. 9. Later, 410 Ard. 2d at 15 and Ames, supra, hold. Cole, supra, does not."
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "none here")], "id int, t string").withColumn("pos", F.lit("clash"))
    full = C.extract(df.select("id", "t"), "id", "t")
    assert [(r["pos"], r["volume"], r["reporter"], r["page"]) for r in full.orderBy("seq").collect()] == [(4, 410, "Ard. 2d", 12), (8, 7, "Fed. Dec.", 9)]
    cases = spark.createDataFrame([(410, "Ard. 2d", 12, 70)], "volume int, reporter string, page int, case_id bigint")
    done = C.resolve(full, cases)
    short = C.resolve_short(C.extract_short(df, "id", "t"), done, "id").collect()
    assert [(r["volume"], r["pin"], r["case_id"]) for r in short] == [(410, 15, 70)]
    names = spark.createDataFrame([(70, "Ames v. Bell"), (71, "Cole v. Dunn")], "case_id bigint, case_name string")
    supra = C.resolve_supra(C.extract_supra(df, "id", "t"), done, names, "id").collect()
    assert {(r["name"], r["case_id"]) for r in supra} == {("Ames", 70), ("Cole", None)}
    runs = C.parallel_runs(full, "id", "pos", 6).collect()
    assert [list(r["cites"]) for r in runs] == [["410 Ard. 2d 12", "7 Fed. Dec. 9"]]
    assert C.parallel_runs(full, "id", "pos", 3).count() == 0


@pytest.mark.parametrize(
    "text, cites, want",
    [
        ("holding that the stay was lifted by the court below on the merits of the long case", 1, 0.9),
        ("recognizing that rule", 10, (500 + 400 + 25 - 17**2) / 1000),
        ("Finding that the rule had been met on all of the counts that were pleaded in the case", 0, 0.8),
        ("relying on the common law of the state as it stood then", 0, (500 + 200 - 8**2) / 1000),
        ("relying on common law", 0, (500 - 16**2) / 1000),
        ("", None, (500 - 19**2) / 1000),
    ],
)
def test_usefulness(spark, text, cites, want):
    from quillstone.functions.dockets import usefulness

    got = spark.createDataFrame([(text, cites)], "t string, n int").select(usefulness(F.col("t"), F.col("n")).alias("s")).first()["s"]
    assert abs(got - want) < 1e-9


def test_judges_of_two_sources(spark):
    from quillstone.functions import records as N

    rows = [("Judge Ames, De Bell and Cole Jr.", "Ames"), ("Per Curiam", "Ames"), ("Ames", "Ames"), ("Ames, Dunn", "BELL, COLE"), ("Dunn, Ames", "Bell, Cole"), (None, None)]
    got = spark.createDataFrame(rows, "a string, b string").select(N.judge_surnames(F.col("a")).alias("names"), N.just_name(F.col("a")).alias("one"), N.merged_judges(F.col("a"), F.col("b")).alias("merged")).collect()
    assert list(got[0]["names"]) == ["Ames", "Cole Jr.", "De Bell"] and got[0]["merged"] == "Ames, Cole Jr., De Bell"
    assert list(got[1]["names"]) == ["PER CURIAM"] and got[1]["one"] == "PER CURIAM"
    assert got[2]["merged"] is None and got[3]["merged"] == "Ames, Dunn" and got[4]["merged"] is None and got[5]["merged"] is None and list(got[5]["names"]) == []


def test_quoted_csv_keeps_every_value(spark, tmp_path):
    from quillstone.sources import files

    rows = [(1, ' padded "quoted", \\ and\nbroken '), (2, ""), (3, "plain")]
    path = str(tmp_path / "c")
    files.write_quoted_csv(spark.createDataFrame(rows, "id int, t string"), path)
    back = {r["id"]: r["t"] or "" for r in files.read_csv(spark, path, "id int, t string").collect()}
    assert back == {i: t for i, t in rows}


def test_written_tables_go(spark):
    from quillstone import session

    t = session.materialise(spark.range(10), "gone")
    assert session.written_bytes(t) > 0 and session.broadcast_if_small(t).count() == 10
    session.discard(t)
    import os

    assert not os.path.exists(t._quillstone_path.removeprefix("file:"))
