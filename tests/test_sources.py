import json

import pytest
from pyspark.sql import functions as F

from quillspark.sources import files, store


def test_scan_elements_and_metadata(spark, tmp_path):
    (tmp_path / "history").mkdir()
    (tmp_path / "history" / "Book 7 класс.txt").write_text("  One\r\n\r\n\r\n\r\nTwo\t\t words  ")
    (tmp_path / "empty.md").write_text(" \n ")
    (tmp_path / "skipped.bin").write_text("x")
    found = files.scan(spark, str(tmp_path))
    assert found.count() == 2
    rows = files.text_elements(found).collect()
    assert [r.content for r in rows] == ["One\n\nTwo words"]
    told = {r.path.rsplit("/", 1)[-1]: r for r in files.path_metadata(found, str(tmp_path)).collect()}
    assert told["empty.md"].subject_hint is None and any(r.subject_hint == "history" and r.grade == 7 for r in told.values())
    with pytest.raises(files.IngestLimitError):
        files.scan(spark, str(tmp_path), max_files=1)


def test_parser_output(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"elements": [{"type": "text", "content": "x", "page_idx": 0}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"type": "table", "text": "y"}, {"text": ""}]))
    rows = files.parsed_elements(spark, f"{tmp_path}/*.json").collect()
    assert sorted((r.type or "", r.content or r.text) for r in rows) == [("", ""), ("table", "y"), ("text", "x")]
    out = [("d1", "p/1.json", "json", b"{broken"), ("d1", "p/2.json", "json", b'{"a": 1}'), ("d1", "p/0.md", "md", b"text"), ("d2", "q/1.txt", "txt", b" "), ("d2", "q/2.md", "md", b"words"), ("d3", "r/1.txt", "txt", b"")]
    df = spark.createDataFrame([(a, b, c, bytearray(d)) for a, b, c, d in out], "doc string, path string, extension string, content binary")
    assert {r.doc: (r.path, r.content) for r in files.preferred_artifacts(df, "doc").collect()} == {"d1": ("p/2.json", '{"a": 1}'), "d2": ("q/2.md", "words")}


def test_settings_files(spark, tmp_path):
    (tmp_path / "hints.yaml").write_text("# subjects\nhistory:\n  - war\n  - 'cold war'\n")
    got = sorted(map(tuple, files.subject_hints(spark, str(tmp_path / "hints.yaml"), {"history": ["old"], "maths": ["sum"]}).collect()))
    assert got == [("history", "cold war"), ("history", "war"), ("maths", "sum")]
    (tmp_path / "set.json").write_text(json.dumps([{"query": "q", "expected_pages": [1]}, {"query": "n", "is_negative": True}]))
    assert [(r.query, r.is_negative) for r in files.evaluation_set(spark, str(tmp_path / "set.json")).orderBy("query").collect()] == [("n", True), ("q", False)]


def test_sampled_pages(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 7, 10, 100)], "n int").select("n", files.sampled_pages(F.col("n"), 5).alias("p"))
    assert {r.n: r.p for r in df.collect()} == {n: files.ocr_sample(n, 5) for n in (0, 1, 2, 3, 7, 10, 100)}


def test_reembed_and_restore(spark, tmp_path):
    old = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "id int, v array<double>")
    new = spark.createDataFrame([(1, [9.0, 9.0])], old.schema)
    back = store.reembed(old, new, "id", "v", 2, str(tmp_path / "vectors"))
    assert {r.id: r.v for r in back.collect()} == {1: [9.0, 9.0], 2: [3.0, 4.0]}
    with pytest.raises(ValueError):
        store.reembed(old, spark.createDataFrame([(1, [9.0])], old.schema), "id", "v", 2, str(tmp_path / "bad"))
    assert {r.id: r.v for r in store.restore(back, old.where("id = 1"), "id", "v").collect()} == {1: [1.0, 2.0], 2: [3.0, 4.0]}
