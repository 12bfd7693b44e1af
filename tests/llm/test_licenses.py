import random

from quillspark.llm import licenses

LINES = {"Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache", "This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "All rights reserved.": "proprietary"}


def results(spark, texts):
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, license int")
    return {r.doc_id: r for r in licenses.scan(docs).collect()}


def test_held_out_accuracy(spark):
    rows = licenses._variants(random.Random(99), 5)
    found = results(spark, [t for t, _ in rows])
    right = sum((found[i].license or None) == (licenses.FAMILIES[label] if label < len(licenses.FAMILIES) else None) for i, (_, label) in enumerate(rows))
    assert right / len(rows) > 0.93


def test_query_finds_every_notice_and_no_other(spark):
    from quillspark.llm.queries import op10_licenses

    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op10_licenses(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = sorted({f for line, f in LINES.items() if line in docs[r.doc_id].split("\n")})
        assert r.licenses == ",".join(want) and (r.license in want if want else r.license is None)
        assert r.confirmed == bool(want)


def test_unknown_and_edges(spark):
    texts = [None, "", "license", "This is licensed under the Frobnicate Public License, version 7, by its owners", "x\n" * 5000 + "Released under the MIT License.", "Released under the MIT License.\nLicensed under CC BY-NC 4.0.", "ordinary words only"]
    got = results(spark, texts)
    assert [got[i].license for i in (0, 1, 6)] == [None] * 3
    assert got[4].license == "mit" and got[5].licenses == "cc-by-nc,mit" and got[5].n_notices == 2
    assert got[3].license in ("unknown", None)
    odd = spark.createDataFrame([(None, "Released under the MIT License."), (1, None), (1, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.license or "") for r in licenses.scan(odd).collect()) == [(0, "mit"), (1, ""), (1, "")]
    assert licenses.scan(odd.limit(0)).count() == 0
