from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import matching
from quillspark.plans import retrieve

FILL = "The village lies near a river and its people live from fishing and from trade with the towns along the coast. "


def test_retrieve_finds_the_answer_and_nothing_for_nonsense(spark):
    rows = [(i, f"s{i % 4}", f"Story {i}. " + FILL * 2 + f"Number {i} of the series ends here.") for i in range(30)]
    rows += [(100, "s1", "Photosynthesis converts sunlight into chemical energy. " + FILL + "Plants need photosynthesis and sunlight to grow well every day.")]
    fragments = spark.createDataFrame(rows, "fragment_id long, source string, text string")
    queries = spark.createDataFrame([(1, "photosynthesis sunlight chemical energy"), (2, "quantum chromodynamics lattice"), (3, "")], "query_id long, query string")
    hits = retrieve.retrieve(queries, fragments, k=3).orderBy("query_id", "rank").collect()
    assert hits and {h.query_id for h in hits} == {1} and hits[0].fragment_id == 100 and hits[0]["rank"] == 1
    assert all(0.35 <= h.final <= 1 for h in hits) and "Photosynthesis" in hits[0].snippet


def values(spark, query, text, *columns):
    df = spark.createDataFrame([(query, text)], "query string, text string").withColumns({"qs": tx.tokens(F.col("query")), "ts": tx.tokens(F.col("text")), "terms": tx.query_terms(F.col("query"))})
    return df.withColumn("st", matching.stems(F.col("ts"))).withColumn("an", matching.anchors(F.col("qs"))).select(*columns).first()


def test_modifiers(spark):
    col = matching.modifier_match(F.col("an"), F.col("ts"), F.col("st"), F.lit(0.5)).alias("m")
    assert tuple(values(spark, "Henry 8 wives", "King Henry 8 had six wives", col).m) == (0.75, False, False)
    assert tuple(values(spark, "Henry 8 wives", "King Henry 7 had one wife", col).m) == (0.2, True, True)
    assert tuple(values(spark, "Henry 8 wives", "King Charles had one wife", col).m) == (0.2, True, False)
    assert tuple(values(spark, "kings and wives", "King Charles", col).m) == (0.5, False, False)


def test_required_terms(spark):
    col = matching.required_term_match(F.array(F.lit("chemical energy")), F.col("ts"), F.col("st")).alias("m")
    got = [values(spark, "q", t, col).m.match for t in ("Chemical energy is", "the chemical energy", "energy that is chemical", "only energy", "nothing")]
    assert got == ["full_phrase_prefix", "full_phrase", "all_terms", "partial", "none"]


def test_alignment(spark):
    col = matching.alignment(F.lit("cause"), F.col("terms"), F.col("ts")).alias("a")
    assert values(spark, "причины войны", "причина войны ясна", col).a == 1.0
    assert values(spark, "причины войны", "причина " + "слово " * 20 + "войны", col).a == 0.4
    assert values(spark, "причины войны", "война вызвала кризис", col).a == 0.0
    assert values(spark, "причины войны", "ничего", col).a == 0.0


def test_sections_and_boundaries(spark):
    col = matching.section_score(F.col("terms"), matching.phrases(F.col("qs")), F.lit("Chemical energy")).alias("s")
    assert values(spark, "chemical energy today", "", col).s >= 0.75
    plan = matching.boundary_penalty(F.array(F.lit("plan word")), F.col("text"), F.col("st"), F.lit("schema_or_plan")).alias("p")
    assert round(values(spark, "q", "plan word a b c d e plan word", plan).p, 2) == 0.14
    assert values(spark, "q", "plan word 1. a 2. b 3. c", plan).p == 0.0


def test_a_union_of_windows_groups_once(spark):
    from pyspark.sql import functions as F

    from quillspark.operators import recall
    from quillspark.session import prepared

    rows = prepared(spark).range(4000).select((F.col("id") % 40).alias("query_id"), F.col("id").alias("fragment_id"), F.rand(1).alias("a"), F.rand(2).alias("b"))
    one, two = (recall.top(rows.select("query_id", "fragment_id", x), 60, F.col(x)).select("query_id", "fragment_id", "rank") for x in "ab")
    fused = recall.rrf(one.unionByName(two)).join(recall.merge(one.withColumn("s", F.lit(1.0)), two.withColumn("s", F.lit(0.5)), scores=["s"]), ["query_id", "fragment_id"])
    assert fused.count() == fused.select("query_id", "fragment_id").distinct().count()


def test_dense_recall_equals_brute_force(spark, monkeypatch):
    import numpy as np

    from quillspark.operators import recall

    monkeypatch.setattr(recall, "QUERY_BLOCK", 7)
    monkeypatch.setattr(recall, "_SLACK", 0)
    rng = np.random.default_rng(3)
    rows = [(i, i // 3, f"g{i % 5}", [float(x) for x in rng.integers(-2, 3, 4 if i % 10 else 3)]) for i in range(400)] + [(900, 300, "g0", None), (901, 301, "g1", [0.0] * 4)]
    vectors = spark.createDataFrame(rows, "subchunk_id long, fragment_id long, label string, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(i, r[3]) for i, r in enumerate(rows[:30])], "query_id int, query_vector array<double>")

    def cosine(a, b):
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return float(np.dot(a, b) / n) if n else 0.0

    got, near = {}, {}
    for r in recall.dense(queries, vectors, 5, 3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.fragment_id, round(r.distance, 9)))
    for r in recall.nearest_of(queries, vectors, "label").collect():
        near.setdefault(r.query_id, {})[r.label] = round(r.distance, 9)
    for q, row in enumerate(rows[:30]):
        all_ = sorted((round(1 - cosine(row[3], v), 9), s, f, g) for s, f, g, v in rows if v is not None and len(v) == len(row[3]))
        best = {}
        for d, s, f, _ in all_[:15]:
            best.setdefault(f, d)
        want = sorted((d, f) for f, d in best.items())[:5]
        assert sorted(got[q]) == [(n + 1, f, d) for n, (d, f) in enumerate(want)] or [d for _, _, d in sorted(got[q])] == [d for d, _ in want]
        assert near[q] == {g: min(d for d, _, _, h in all_ if h == g) for g in {x[3] for x in all_}}


def test_retrieval_with_vectors(spark):
    fragments = spark.createDataFrame([(1, "a", "Plants turn light into sugar in their leaves every day of the year."), (2, "b", "Volcanoes throw lava and ash from deep below the ground at times."), (3, "a", "Leaves of plants fall in autumn when light grows short and cold.")], "fragment_id long, source string, text string")
    vectors = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 2, [0.0, 1.0]), (3, 3, [0.9, 0.1])], "subchunk_id long, fragment_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, "plants light leaves", [1.0, 0.05], ["green sugar"])], "query_id int, query string, query_vector array<double>, variants array<string>")
    hits = retrieve.retrieve(queries, fragments, vectors=vectors).orderBy("rank").collect()
    assert [h.fragment_id for h in hits][:1] in ([1], [3]) and all(h.source == "a" for h in hits)


def test_selection_and_shaping(spark, tmp_path):
    from quillspark.sources import store

    texts = ["Plants turn light into sugar in their leaves every day of the year, and store it in roots.", "Volcanoes throw lava and ash from deep below the ground at times, and people flee from them.", "Light falls on leaves of plants in spring, when days grow long and warm and rain is frequent."]
    fragments = spark.createDataFrame([(i, "a" if i < 9 else "b", t, i, "s", None) for i, t in enumerate(texts * 3)], "fragment_id long, source string, text string, element_index long, section string, page int")
    queries = spark.createDataFrame([(1, "plants light leaves")], "query_id int, query string")
    rows = retrieve.assessed(queries, fragments)
    final = retrieve.select_final(rows, 2, 0.0).collect()
    assert len(final) == 2 and {r.rank for r in final} == {1, 2} and not retrieve.select_final(rows, 2, 1.1).count()
    shaped = retrieve.as_hits(retrieve.chosen(rows, 2), fragments, True, True).collect()
    assert shaped and all(r.text in texts and r.text[:40] in r.context and r.context_size >= 2 for r in shaped)
    ranked = retrieve.by_relevance(retrieve.matched(pool(spark, queries, fragments))).orderBy("rank").collect()
    assert [r.final for r in ranked] == sorted((r.final for r in ranked), reverse=True) and len(ranked) == 6
    vectors = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "id int, v array<double>")
    kept = store.backed_up(vectors, "id", "v", str(tmp_path / "backup"))
    assert sorted(map(tuple, store.restore(vectors.withColumn("v", F.lit(None).cast("array<double>")), kept, "id", "v").collect())) == [(1, [1.0]), (2, [2.0])]


def pool(spark, queries, fragments):
    from quillspark.operators import classify, recall

    asked = classify.analyzed(queries)
    found = recall.balanced(retrieve.candidates(asked, fragments, retrieve.terms_of(fragments)), 12)
    return found.join(fragments.withColumn("title", F.lit(None).cast("string")), "fragment_id").join(asked.select("query_id", "normalized", "key_terms", "query_type", "answer_focus", "entities"), "query_id")
