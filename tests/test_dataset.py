import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import hierarchy
from quillstone.operators.packed import explode_packed, split_packed
from quillstone.operators.redelivery import RedeliveryFilter

T = dt.datetime


# Redelivery -----------------------------------------------------------------------------------------------------------


def _mails(spark, tmp_path, rows, parts=2):
    path = str(tmp_path / "mails")
    spark.createDataFrame(rows, "n bigint, m string, at timestamp, k string").repartition(parts).write.parquet(path)
    return RedeliveryFilter(spark, path, "m", "at", "n")


def _brute(rows):
    best = {}
    for n, m, at, _ in rows:
        key = (m or "").strip(" \t\n\r<>").lower()
        if key:
            o = (at is None, at or T(1, 1, 1), n)
            best[key] = min(best.get(key, o), o)
    return {n for n, m, at, _ in rows if (k := (m or "").strip(" \t\n\r<>").lower()) and (at is None, at or T(1, 1, 1), n) != best[k]}


def test_redelivery_against_brute_force(spark, tmp_path):
    r = random.Random(1)
    ids = ["<a@x>", " A@x ", "a@X\n", "b", "B", None, "", " <> ", "hot", "hot", "hot"]
    rows = [(i, r.choice(ids), None if r.random() < 0.2 else T(2024, 1, 1 + r.randrange(5)), "x") for i in range(400)]
    f = _mails(spark, tmp_path, rows, 5)
    surplus = {x["n"] for x in f.surplus(["n"]).collect()}
    assert surplus == _brute(rows)
    kept = [x["n"] for x in f.kept().collect()]
    assert sorted(kept + list(surplus)) == list(range(400))
    assert f.kept().columns == ["n", "m", "at", "k"]


def test_redelivery_by_file_gives_the_same(spark, tmp_path, monkeypatch):
    import quillstone.operators.redelivery as m

    rows = [(i, f"id{i % 7}", T(2024, 1, 1), "x") for i in range(100)]
    f = _mails(spark, tmp_path, rows, 4)
    want = {x["n"] for x in f.surplus(["n"]).collect()}
    monkeypatch.setattr(m, "BROADCAST_BYTES", -1)
    assert {x["n"] for x in f.surplus(["n"]).collect()} == want == _brute(rows)


def test_redelivery_of_an_empty_table(spark, tmp_path):
    f = _mails(spark, tmp_path, [], 1)
    assert f.kept().count() == 0 and f.surplus().count() == 0


# Packed fields --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "field, want",
    [
        (None, []),
        ("  ", []),
        (";;,", []),
        ("Ames", ["Ames"]),
        ("Ames, Jr.", ["Ames, Jr."]),
        ("Ames, Bell and Cole", ["Ames", "Bell", "Cole"]),
        ("Ames, Sr., B. Bell, III, & Cole", ["Ames, Sr.", "B. Bell, III", "Cole"]),
        ("Ames, Ann; Bell, Bo, Jr.;", ["Ames, Ann", "Bell, Bo, Jr."]),
        ('"Ames, Ann", Bell, "Cole"', ["Ames, Ann", "Bell", "Cole"]),
        ("['Ames', 'O''Neil', \"D'Arcy\"]", ["Ames", "O''Neil", "D'Arcy"]),
        ("O'Brien, D'Arcy", ["O'Brien", "D'Arcy"]),
        ("“Ames, Ann”,“Bell”", ["Ames, Ann", "Bell"]),
        ("Ames / Bell | Cole & Dorn", ["Ames", "Bell", "Cole", "Dorn"]),
        ("Ames\tBell\r\nCole", ["Ames", "Bell", "Cole"]),
        ("Ames,, Bell,, Cole", ["Ames", "Bell", "Cole"]),
        ('"Ames', ['"Ames']),
        ("Sandy Andrews and Anders", ["Sandy Andrews", "Anders"]),
        ("Ames (sitting by order; again), Bell", ["Ames (sitting by order; again)", "Bell"]),
        ("Ames\\, Ann, Bell", ["Ames, Ann", "Bell"]),
    ],
)
def test_split_packed(field, want):
    assert split_packed(field) == want


def test_split_of_a_long_field():
    assert split_packed(", ".join(f"Name{i}" for i in range(20_000)))[-1] == "Name19999"


def test_explode_packed(spark):
    df = spark.createDataFrame([(1, "A; B", "x"), (2, None, "x"), (3, "C", "x"), (1, "A; B", "x")], "id int, pos string, judge string")
    got = sorted(map(tuple, explode_packed(df, "pos", ["id"], "judge", "pos").collect()))
    assert got == [(1, 1, "A"), (1, 1, "A"), (1, 2, "B"), (1, 2, "B"), (3, 1, "C")]
    assert explode_packed(df, "pos", ["id"], least=2).where("id = 3").count() == 0
    assert explode_packed(df.limit(0), "pos", ["id"]).count() == 0


# Hierarchies ----------------------------------------------------------------------------------------------------------


def _walk(parent):
    out = {}
    for n in parent:
        path, x = [], n
        while x in parent and parent[x] in parent and x not in path:
            path.append(x)
            x = parent[x]
        out[n] = ("", -1) if x in path else (x, len(path))
    return out


@pytest.mark.parametrize("seed, task_rows", [(1, 400_000), (2, 12), (3, 5)])
def test_hierarchy_against_walking(spark, seed, task_rows):
    r = random.Random(seed)
    n = 120
    parent = {f"n{i}": (f"n{r.randrange(n)}" if r.random() < 0.35 else f"n{max(0, i - 1)}" if r.random() < 0.8 else None) for i in range(n)}
    parent |= {"x": "absent", "self": "self", "hot": None} | {f"kid{i}": "hot" for i in range(60)}
    want = _walk({k: v for k, v in parent.items()})
    df = spark.createDataFrame([(k, v) for k, v in parent.items()], "id string, up string")
    got = {x["node"]: (x["root"], x["depth"]) for x in hierarchy.resolve_hierarchy(df, "id", "up", task_rows=task_rows, last_rows=task_rows // 4).collect()}
    assert got == want


def test_long_chain(spark):
    n = 3000
    df = spark.range(n).selectExpr("id", "CASE WHEN id > 0 THEN id - 1 END AS up")
    got = hierarchy.resolve_hierarchy(df, "id", "up", task_rows=500, last_rows=100)
    assert got.where("root <> '0' OR depth <> cast(node as int)").count() == 0 and got.count() == n


def test_hierarchy_edges(spark):
    rows = [("A ", None), ("b", " a"), ("B", "A"), ("c", "  "), (None, "a"), ("", "a"), ("d", "nobody")]
    df = spark.createDataFrame(rows, "id string, up string").withColumn("node", F.lit(1)).withColumn("root", F.lit(2))
    got = {x["node"].strip().lower(): (x["root"], x["depth"]) for x in hierarchy.resolve_hierarchy(df, "id", "up").collect()}
    assert got == {"a": ("A ", 0), "b": ("A ", 1), "c": ("c", 0), "d": ("d", 0)}
    assert hierarchy.resolve_hierarchy(df.limit(0), "id", "up").count() == 0


def test_closure_and_paths(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "d"), ("l", "m"), ("m", "l")], "id string, up string")
    pairs = {(x["ancestor"], x["descendant"]): x["distance"] for x in hierarchy.ancestor_pairs(df, "id", "up").collect()}
    assert pairs[("a", "e")] == 4 and pairs[("b", "d")] == 2 and len(pairs) == 15
    assert {x["node"]: x["path"] for x in hierarchy.paths(df, "id", "up").collect()}["e"] == ["a", "b", "c", "d", "e"]
    below = {(x["ancestor"], x["descendant"]) for x in hierarchy.ancestor_pairs(df, "id", "up", roots=["c", "l"]).collect()}
    assert below == {("c", "c"), ("c", "d"), ("c", "e")}


def test_contraction_runs_through_several_levels(spark, monkeypatch):
    """Chains into a loop, a wide parent and random trees, over many small tasks and more than two levels: roots, depths and paths as by walking."""
    r = random.Random(11)
    parent = {f"n{i}": (f"n{r.randrange(i)}" if i % 50 else None) for i in range(1, 400)} | {"n0": None}
    parent |= {"loop": "loop", "c0": "loop"} | {f"c{i}": f"c{i - 1}" for i in range(1, 40)} | {f"k{i}": "n7" for i in range(50)} | {"q0": "q2", "q1": "q0", "q2": "q1"}
    seen = []
    solve = hierarchy._solve
    monkeypatch.setattr(hierarchy, "_solve", lambda links, level, *more: seen.append(level) or solve(links, level, *more))
    df = spark.createDataFrame(list(parent.items()), "id string, up string")
    got = {x["node"]: x for x in hierarchy.resolve_hierarchy(df, "id", "up", task_rows=40, last_rows=5, with_path=True).collect()}
    want = _walk(dict(parent))
    assert {k: (v["root"], v["depth"]) for k, v in got.items()} == want and max(seen) >= 3
    for k, (_, depth) in want.items():
        path, at = [k], k
        while depth >= 0 and parent.get(at) in parent:
            at = parent[at]
            path.insert(0, at)
        assert got[k]["path"] == (path if depth >= 0 else None)
