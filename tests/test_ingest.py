import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import chunking, expansion, matching, recall, scoring
from quillspark.plans import ingest, retrieve
from quillspark.sources import embed, files

LONG = "Слово о полку. " * 90


def test_files_to_hits_and_again(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "out")
    (root / "a").mkdir(parents=True)
    (root / "a" / "one.md").write_text("# Photosynthesis\n\nPlants turn light into sugar with chlorophyll in their leaves.\n\n" + "Light reactions come first, and the dark ones follow after them. " * 20)
    (root / "two.txt").write_text("Volcanoes throw lava and ash from deep below the ground.\r\n\r\n\r\n" + "Magma rises where plates part or meet each other slowly. " * 20)
    (root / "three.pdf").write_bytes(b"%PDF")
    found = files.scan(spark, str(root))
    pdf = [r.path for r in found.collect() if r.path.endswith("pdf")][0]
    artifacts = spark.createDataFrame([(pdf, "x/three.json", json.dumps([{"type": "text", "content": "Glaciers carve valleys while they slide slowly downhill over rock.", "page_idx": 0}, {"type": "odd", "content": " "}]))], "source string, path string, content string")
    by = embed.stand_in(8)
    told = ingest.ingest(spark, str(root), "school", by, out, artifacts)
    now = ingest.current(spark, out)
    assert told["documents"] == now["documents"].count() == 3 and told["fragments"] == now["fragments"].count() and told["vectors"] == now["vectors"].count() >= told["fragments"]
    assert {r.parse_mode for r in now["documents"].select("meta.parse_mode").collect()} == {"fallback", "parser"}
    embed.validate(now["documents"].select("doc_id", F.col("meta.embedding_fingerprint").alias("fingerprint")), now["documents"].select("doc_id"), by.fingerprint)
    with pytest.raises(ValueError, match="another encoder"):
        embed.validate(now["documents"].select("doc_id", F.col("meta.embedding_fingerprint").alias("fingerprint")), now["documents"].select("doc_id"), "sha256:other")
    queries = spark.createDataFrame([(1, "chlorophyll leaves sugar", ["green plants"]), (2, "glaciers carve valleys", None)], "query_id int, query string, variants array<string>")
    fragments = now["fragments"].select("fragment_id", "source", "text", "page")
    hits, debug = retrieve.with_debug(queries, fragments)
    best = {r.query_id: r.source for r in hits.where("rank = 1").collect()}
    assert best[1].endswith("one.md") and best[2].endswith("three.pdf")
    assert all(r.pool >= r.after_threshold >= r.after_adaptive >= r.after_mmr >= 1 and len(r.top_scores) == r.after_mmr for r in debug.collect())
    only = retrieve.retrieve(queries.drop("variants"), fragments, sources=[best[2]]).collect()
    assert {r.source for r in only} == {best[2]}

    (root / "two.txt").write_text("Earthquakes shake the crust along faults. " * 30)
    (root / "a" / "one.md").unlink()
    ingest.ingest(spark, str(root), "school", by, out, artifacts)
    after = ingest.current(spark, out)
    texts = " ".join(r.text for r in after["fragments"].collect())
    assert "Earthquakes" in texts and "Magma" not in texts and "chlorophyll" in texts and after["documents"].count() == 3
    same = ingest.ingest(spark, str(root), "school", by, out, artifacts, reindex=False)
    again = ingest.current(spark, out)
    assert again["fragments"].count() == after["fragments"].count() and same["documents"] == 2
    gone = ingest.deleted(again, best[2])
    assert gone["documents"].count() == 2 and gone["vectors"].where(F.col("source") == best[2]).count() == 0
    n, first = ingest.preview(ingest.parsed(spark, files.scan(spark, str(root)), artifacts), 1)
    assert n == 2 and first.count() == 1


def test_embedding(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "i int, t string")
    by = embed.Embedder(2, "f", lambda texts: [[3.0, 4.0] if t == "a" else [0.0, 0.0] for t in texts], batch=2)
    assert [list(r.embedding) for r in embed.embedded(rows, "t", by).orderBy("i").collect()] == [[0.6, 0.8], [0.0, 0.0], [0.0, 0.0]]
    with pytest.raises(Exception, match="numbers, not 3"):
        embed.embedded(rows, "t", embed.Embedder(3, "f", by.encode)).collect()
    (tmp_path / "config.json").write_text('{"_name_or_path": "M"}')
    (tmp_path / "model.safetensors").write_bytes(b"x" * (3 << 20))
    one = embed.model_fingerprint(str(tmp_path), 8)
    (tmp_path / "model.safetensors").write_bytes(b"x" * (3 << 20) + b"y")
    assert one != embed.model_fingerprint(str(tmp_path), 8) != embed.model_fingerprint(str(tmp_path), 9) and embed.model_fingerprint("A ", 3) == embed.model_fingerprint("a", 3)
    fragments = spark.createDataFrame([("f1", "d1", "x"), ("f2", "d2", "y")], "fragment_id string, doc_id string, text string")
    documents = spark.createDataFrame([("d1", "c"), ("d2", "other"), ("d3", "c")], "doc_id string, collection string")
    held, own = embed.index_rows(documents, fragments, spark.createDataFrame([("f1", 1), ("f2", 1)], "fragment_id string, n int"), "c")
    assert [r.fragment_id for r in held.collect()] == ["f1"] and [r.doc_id for r in own.collect()] == ["d1"]
    pairs = spark.createDataFrame([("q", "text")], "query string, text string")
    assert scoring.rescored(pairs, lambda q, t: [float(len(x)) for x in t]).first().rerank_raw == 4.0 and scoring.rescored(pairs, None).first().rerank_raw is None


def test_expansion(spark):
    assert expansion.merged({"A": [" x ", ""]}, {"a": ["X", "y"], " ": ["z"]}) == {"a": ["x", "y"]}
    rows = [("реформы петра",), ("причины войны 1812 года",), ("почему идет дождь",), ("один два три четыре пять шесть",), ("цель похода",)]
    df = spark.createDataFrame(rows, "q string")
    synonyms, topics = {"реформы": ["преобразования", "1700 годы"]}, {"войны": ["сражение"]}
    got = [r.v for r in df.select(expansion.variants(F.col("q"), synonyms, topics, subject=F.when(F.col("q").contains("войны"), "history")).alias("v")).collect()]
    assert got[0] == ["реформы петра", "реформы петра преобразования 1700 годы", "реформы петра 1700 годы"]
    assert got[1] == ["причины войны 1812 года", "войны предпосылки кризис недовольство оппозиция обусловлено", "причины войны 1812 года сражение"]
    assert got[2] == ["почему идет дождь", "идет дождь причина объясняется связано обусловлено"]
    assert got[3] == [rows[3][0]] and got[4] == ["цель похода", "похода цели задачи намерения стремились направлены"]
    marks = df.limit(1).select(expansion.topic_markers(F.col("q"), {"петра": ["Реформатор"]}).alias("m"), expansion.subject_words(F.col("q"), F.array(F.lit("history"), F.lit("math")), {"history": {"реформа": ["Указы  царя"]}, "physics": {"реформа": ["x"]}}).alias("s")).first()
    assert marks.m == ["петра", "рефор", "реформатор", "реформы"] and marks.s == ["указы царя"]
    hosts = spark.createDataFrame([(["https://u@A.example.org:80/x", "b.example.net/y", " ", None],)], "s array<string>").select(expansion.domains(F.col("s")).alias("d")).first().d
    assert hosts == ["a.example.org", "b.example.net"]


def test_small_operators(spark):
    one = spark.range(1)
    value = lambda e: one.select(e.alias("x")).first().x
    assert value(chunking.words_packed(F.lit("aa bb  cc dddddddd e"), 5)) == ["aa bb", "cc", "dddddddd", "e"] and value(chunking.words_packed(F.lit(" "), 5)) == [" "]
    assert value(chunking.snippet(F.lit("a  b" * 500), 0, 10)) == "a ba ba ba" and value(chunking.snippet(F.lit("abcdef"), 4, 2)) == "abcd"
    assert value(matching.required_text(F.lit("Пере-\n нос, «Ёж»­!"))) == "перенос еж" and value(matching.required_tokens(F.lit("А-б 12"))) == ["а", "б", "12"]
    assert value(matching.evidence_text(F.lit("One two."), F.lit("one  two"), F.lit(None).cast("string"), F.lit("Three"))) == "One two. Three"
    assert value(F.rlike(F.lit("старые реформами края"), matching.token_pattern(F.lit("реформа")))) and not value(F.rlike(F.lit("x1812y"), matching.token_pattern(F.lit("1812"))))
    v = lambda *xs: F.array(*map(F.lit, xs))
    assert value(recall.profile_similarity(v(1.0, 0.0), v(0.0, 1.0, 5.0))) == 0.5 and value(recall.profile_similarity(v(1.0), F.lit(None).cast("array<double>"))) == 0.0
    assert value(scoring.subject_score(F.lit(0.5), F.lit(0.12))) == 0.12 and value(scoring.subject_score(F.lit(0.9), F.lit(0.12))) == 0.9
