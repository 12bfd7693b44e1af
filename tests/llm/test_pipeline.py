import re
from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import common, quality
from tests.llm.test_packing import check
from tests.llm.test_quality import brute as statistics
from tests.llm.test_secrets import brute as secret_spans

SF = "/root/testdata/sf0.01"


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}

    docs = corpus_pipeline.quality_rules(spark, docs, SF)
    after = {r.doc_id: r for r in docs.collect()}
    failed = {d for d, r in before.items() if (s := statistics(r.text))[0] < 20 or 100 * s[4] > 30 * s[0]}
    assert docs.columns == columns and set(after) == set(before) - failed
    assert all(r.n_chars == len(r.text) and set(r.text.split("\n")) <= set(before[d].text.split("\n")) for d, r in after.items())

    before, docs = after, corpus_pipeline.language_id(spark, docs, SF)
    after = {r.doc_id: r for r in docs.collect()}
    assert docs.columns == columns and set(after) == {d for d, r in before.items() if re.search(r"[^\W\d_]", r.text)}

    before, docs = after, corpus_pipeline.near_dedup(spark, docs, SF)
    after = {r.doc_id: r for r in docs.collect()}
    assert docs.columns == columns and len({r.text for r in after.values()}) == len(after)
    by_shingle, pairs = defaultdict(list), set()
    sets = {d: shingles(r.text) for d, r in before.items()}
    for d, s in sets.items():
        for x in s:
            by_shingle[x].append(d)
    for ds in by_shingle.values():
        pairs |= {(ds[0], d) for d in ds[1:]}
    near = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.85 * len(sets[a] | sets[b])]
    assert sum(not (a in after and b in after) for a, b in near) >= 0.9 * len(near)
    alone = set(before) - {d for a, b in pairs for d in (a, b) if len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    assert alone <= set(after)

    before, docs = after, corpus_pipeline.secret_scan(spark, docs, SF)
    after = {r.doc_id: r for r in docs.collect()}
    assert docs.columns == columns and set(after) == set(before)
    for d, r in after.items():
        assert not secret_spans(r.text)
        assert (r.text == before[d].text) == (not secret_spans(before[d].text))

    rows = corpus_pipeline.pack(spark, docs, SF).collect()
    assert {r.doc_id for r in rows} == set(after)
    assert check(rows) <= sum(r.length for r in rows) / 1024 * 1.005 + 1


def test_run(spark):
    before = common.written()
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert len(common.written()) == len(before) + 1
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.count() > 0 and len(corpus_pipeline.STAGES) == 5


def test_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, SF).count() == 0
    assert quality.rules(docs).count() == 0


def test_odd_rows_and_names_that_clash(spark, tmp_path):
    own = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first = own.where("doc_id = (SELECT 3)").first()
    odd = [(None, first.text, "en", "src0", 1), (9001, None, "en", None, 0), (9002, "", None, "src0", 0), (first.doc_id, first.text, first.lang, first.source, first.n_chars), (9003, " ".join(f"word{i} the of and" for i in range(30_000)), None, None, 3), (9004, "AKIA" + "A" * 400, "en", "src1", 404)]
    names = ["_text", "row", "id", "hash", "host", "new", "kept", "cuts", "removed", "t", "h", "b_id", "uid", "sequence_id"]
    docs = own.unionByName(spark.createDataFrame(odd, own.schema)).withColumns({n: F.col("lang") for n in names})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, docs, "")
        assert after.columns == docs.columns, name
        after = spark.createDataFrame(after.collect(), docs.schema)
        assert all(after.where(~F.col(n).eqNullSafe(F.col("lang"))).count() == 0 for n in names), name
        docs = after
    left = [r.doc_id for r in docs.collect()]
    assert {9001, 9002, 9004}.isdisjoint(left) and 9003 in left and left.count(first.doc_id) <= 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(left) and check(got) > 0
