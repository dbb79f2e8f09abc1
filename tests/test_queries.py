import pytest

from tests.twins import connect, rows_of

import __spark_entry__ as entry

CORE = [n for n, f in sorted(entry.queries().items()) if not n.startswith(tuple(f"p{k}_" for k in (3, 4, 5, 7, 8, 9, 10)))]
TWINS = [n for n in CORE if n in entry.oracle_sql()]


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", TWINS)
def test_equals_its_sql(spark, data, con, name):
    got = entry.queries()[name](spark, data).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


#: Queries whose cases need not stand in the smallest tables; unit tests hold them.
MAY_BE_EMPTY = {"cit04_short_citations", "cit12_parallel_runs", "cit15_filing_edges", "cit23_supra"}


@pytest.mark.parametrize("name", [n for n in CORE if n not in TWINS])
def test_runs(spark, data, name):
    df = entry.queries()[name](spark, data)
    assert df.columns and (name in MAY_BE_EMPTY or df.count() > 0)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
