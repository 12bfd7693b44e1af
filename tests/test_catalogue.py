"""Every query of the catalogue against its SQL, at the smallest scale."""

import signal

import duckdb
import pytest

from quillspark.plans import catalogue, literal_queries, profile_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(r[i] for i in order) for r in found), key=lambda r: tuple(map(repr, r)))


@pytest.fixture(autouse=True)
def limited():
    """One query that never ends must not take the others with it."""

    def stop(*_):
        raise TimeoutError("the query took more than 180 seconds")

    before = signal.signal(signal.SIGALRM, stop)
    signal.alarm(180)
    yield
    signal.alarm(0)
    signal.signal(signal.SIGALRM, before)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = df.collect()
    assert got
    if name in catalogue.SQL:
        rel = con.sql(catalogue.SQL[name])
        assert sorted(df.columns) == sorted(rel.columns)
        assert rows(df.columns, got) == rows(rel.columns, rel.fetchall())


def test_the_entry_without_the_training_data_package():
    import subprocess
    import sys

    code = "import sys; sys.modules['quillspark.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'bm25_pool' in q and 'op1_simhash' not in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests", 1)[0])
