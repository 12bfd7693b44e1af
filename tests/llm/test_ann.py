import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import ann

DIVISIBLE = "id % 20 = 0"


def brute(rows, k=20):
    out = []
    for i, v in rows:
        if i % 20 == 0:
            scored = []
            for j, w in rows:
                if i != j:
                    s = 0.0
                    for a, b in zip(v, w):
                        s += a * b
                    scored.append((-s, j))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("cells", [(1 << 20, 1 << 17), (500, 60)])
def test_search_is_exact(spark, monkeypatch, cells):
    monkeypatch.setattr(ann, "CANDIDATE_CELLS", cells[0])
    monkeypatch.setattr(ann, "QUERY_CELLS", cells[1])
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 10.0 ** (i % 5 - 2)) for _ in range(8)]) for i in range(300)]
    rows += [(300 + i, rows[40][1]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = sorted(map(tuple, ann.search(df, F.expr(DIVISIBLE)).collect()))
    assert got == brute(rows)


def test_query_equals_sql(spark):
    from quillspark.llm.queries import op5_ann

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    rel = con.sql(ann.SQL)
    df = op5_ann(spark, sf)
    assert df.columns == rel.columns
    assert sorted(map(tuple, df.collect())) == sorted(rel.fetchall())


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (None, [1.0, 1.0]), (7, [1.0, 2.0, 3.0]), (20, [1e-320, 0.0]), (40, [2.0, 1.0]), (40, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, ann.search(df, F.expr(DIVISIBLE)).collect()))
    assert [g[:3] for g in got if g[0] == 0] == [(0, 1, 40), (0, 2, 40), (0, 3, 20)]
    assert len([g for g in got if g[0] == 40]) == 6 and not [g for g in got if g[0] == 7]
    assert ann.search(df.limit(0), F.expr(DIVISIBLE)).count() == 0


def test_bounds_hold():
    x = np.random.default_rng(1).normal(size=(50, 16)) * 10.0 ** np.arange(50)[:, None].clip(0, 9)
    codes, scale, error = ann.quantised(x)
    assert np.allclose(np.linalg.norm(x - codes * scale[:, None], axis=1), error)
    assert (error <= scale * 2.001).all()


def test_products_that_overflow(spark):
    rows = [(i, [float(v), 1.0]) for i, v in enumerate([1e200, 1e200, -1e200, 1.0, 1e300, -1e300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(ann.search(df, F.col("id") == 0).collect(), key=lambda r: r.rank):
        got[r.vec_id] = r.score
    assert list(got)[:3] == [1, 4, 3] and got[1] == got[4] == float("inf") and got[2] == got[5] == float("-inf") and len(got) == 5
