import math
from collections import Counter

import duckdb
import pytest

from quillspark.llm import lm

SF = "/root/testdata/sf0.001"


def brute(texts):
    tokens = [(t or "").encode().lower().split() for t in texts]
    single, double = Counter(w for ws in tokens for w in ws), Counter(p for ws in tokens for p in zip(ws, ws[1:]))
    total, out = sum(single.values()), []
    for ws in tokens:
        one, two, s = Counter(ws), Counter(zip(ws, ws[1:])), 0.0
        for i, w in enumerate(ws):
            n = single[w] - one[w]
            share = math.log(n / (total - len(ws))) if n else math.log(0.4 / (total - len(ws) + 1))
            pair = (ws[i - 1], w)
            if i and double[pair] - two[pair]:
                s += math.log((double[pair] - two[pair]) / (single[pair[0]] - one[pair[0]]))
            else:
                s += share + (math.log(0.4) if i else 0)
        out.append((len(ws), s))
    return out


@pytest.mark.parametrize("size", [2_000_000, 40])
def test_scores_equal_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(lm, "CHUNK_TOKENS", size)
    texts = [None, "", "a", "a b a b a", "A B c", "the the the the", "x y z é É", "a b c d e f " * 30, "a b a b a", " \n\x1c q"] * 2
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(texts)], "doc_id long, text string, score double").repartition(3)
    got = {r.doc_id: r for r in lm.score(docs).collect()}
    for i, (n, s) in enumerate(brute(texts)):
        assert got[i].n_tokens == n and abs(got[i].logprob - s) < 1e-3, texts[i]
        assert (got[i].score is None) == (n == 0)


def test_query_equals_sql(spark):
    from quillspark.llm.queries import op3_lm

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rel = con.sql(lm.SQL)
    df = op3_lm(spark, SF)
    assert df.columns == rel.columns
    assert sorted(map(tuple, df.collect())) == sorted(rel.fetchall())


def test_edges(spark):
    odd = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_tokens) for r in lm.score(odd).collect())
    assert got == [(0, 2), (1, 2), (1, 2), (2, 0)]
    assert lm.score(odd.limit(0)).count() == 0
    assert lm.score(odd.where("doc_id = 2")).collect()[0].n_tokens == 0


def test_a_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_TOKENS", 1000)
    texts = ["a b c " * 20_000, "a b d", "c a", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score(docs).collect()}
    for i, (n, s) in enumerate(brute(texts)):
        assert got[i].n_tokens == n and abs(got[i].logprob - s) < 1e-3 * max(1, n)
