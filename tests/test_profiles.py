from pyspark.sql import functions as F

from quillspark.operators import evaluate, profiles

TITLES = [
    ("", None, "empty"),
    ("Глава 3 Причины войны\nТекст главы", "Глава 3 Причины войны", "first_line"),
    ("## Energy balance\nThe sum stays the same.", "Energy balance", "first_line"),
    ("12 34, 56", None, "numeric_or_punctuation"),
    ("Порядок разбора глагола 45", "Порядок разбора глагола", "first_line"),
    ("Energy balance of the closed systems that we study here: the sum of all parts stays the same", None, "too_many_words"),
    ("Photosynthesis in plants and in several other small organisms. It needs light and water to work at all in nature", None, "too_many_words"),
    ("Energy of closed systems. It stays the same over all the time that anyone may care to look at it", "Energy of closed systems", "inline_heading"),
    ("12. См. разбор выше", None, "plan_step"),
]


def test_section_titles(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(TITLES)], "i int, text string")
    got = {r.i: (r.section_title, r.section_title_reason) for r in profiles.section_titles(df, ["i"]).collect()}
    assert got == {i: x[1:] for i, x in enumerate(TITLES)}
    stored = spark.createDataFrame([(1, "Body text", ["Part one", "Chapter two"]), (2, "Body text", ["123", "456"]), (3, None, None)], "i int, text string, path array<string>")
    got = {r.i: (r.section_title, r.section_title_reason) for r in profiles.section_titles(stored, ["i"], headings="path").collect()}
    assert got == {1: ("Chapter two", "meta"), 2: ("Body text", "first_line"), 3: (None, "empty")}


def test_document_profile(spark):
    rows = [("школа/Учебник 7 класс", 0, "История войны и причины её начала"), ("школа/Учебник 7 класс", 1, "Война закончилась, войны помнят"), ("empty", 0, None)]
    got = {r.source: r for r in profiles.document_profiles(spark.createDataFrame(rows, "source string, element_index int, content string")).collect()}
    one = got["школа/Учебник 7 класс"]
    assert (one.doc_type, one.language, one.grade) == ("textbook", "ru", 7) and one.keywords[0] == "войн"
    assert (got["empty"].doc_type, got["empty"].language, got["empty"].grade, got["empty"].keywords) == ("unknown", "unknown", None, [])


def test_small_expressions(spark):
    one = spark.range(1).select(
        profiles.required_text(F.lit("Хими-\n ческая  энергия — Ёлка­!")).alias("t"),
        profiles.domain(F.lit("user@Example.org:80/x")).alias("a"),
        profiles.domain(F.lit("https://a.b.c/x?y")).alias("b"),
        profiles.domain(F.lit("")).alias("c"),
        F.array_join(profiles.recall_terms(F.array(*map(F.lit, "a iv 7 ab abc x".split()))), " ").alias("r"),
    ).first()
    assert tuple(one) == ("химическая энергия елка", "example.org", "a.b.c", None, "7 ab abc")
    none = F.array().cast("array<long>"), F.array().cast("array<string>")
    page = F.array(F.struct(F.lit(1).cast("long").alias("page"), F.lit("Some TEXT").alias("text")))
    checks = [evaluate.matches_evidence(page, *none), evaluate.matches_evidence(page, F.array(F.lit(1).cast("long")), none[1]), evaluate.matches_evidence(page, none[0], F.array(F.lit("text"))), evaluate.matches_evidence(page, F.array(F.lit(2).cast("long")), F.array(F.lit("text")))]
    assert list(spark.range(1).select(*(x.alias(f"c{i}") for i, x in enumerate(checks))).first()) == [False, True, True, False]


def test_evidence_metrics(spark):
    rows = [(1, 1, False, False), (1, 2, True, True), (2, 1, False, True), (3, 7, True, True)]
    got = {r.query_id: (r.recall, round(r.ndcg, 4), r.mrr, r.top1_source) for r in evaluate.evidence_metrics(spark.createDataFrame(rows, "query_id int, rank int, evidence boolean, right_source boolean"), 5).collect()}
    assert got == {1: (1.0, 0.6309, 0.5, False), 2: (0.0, 0.0, 0.0, True), 3: (0.0, 0.0, 0.0, False)}


def test_long_candidates_are_not_looked_at_closely(spark, monkeypatch):
    from quillspark.operators import classify, profiles

    given = []

    def kept(df, text, *more, prepared=classify.prepared):
        given.append(df.where(f"length({text}) > 180"))
        return prepared(df, text, *more)

    monkeypatch.setattr(classify, "prepared", kept)
    long = "word " * 400
    rows = spark.createDataFrame([(1, long + "end. Next one: more " + long), (2, "A short title\n" + long), (3, "( " + long), (4, None)], "k int, text string")
    got = {r.k: (r.section_title, r.section_title_reason) for r in profiles.section_titles(rows, ["k"]).collect()}
    assert got[2] == ("A short title", "first_line") and got[1] == (None, "too_long") and got[3] == (None, "unclosed_parenthetical") and got[4] == (None, "empty")
    assert given and all(df.count() == 0 for df in given)


def test_white_space_and_hyphens_as_by_the_plain_expressions(spark):
    import random

    from pyspark.sql import functions as F

    from quillspark.functions import text as tx

    rng = random.Random(6)
    rows = [("".join(rng.choice("aя-- \t\n  \u0085.B") for _ in range(rng.randrange(40))),) for _ in range(3000)]
    t = spark.createDataFrame(rows, "t string")
    clean = F.trim(F.regexp_replace("t", r"(?U)\s+", " "))
    norm = F.regexp_replace(F.translate(F.lower("t"), "ё", "е"), r"(?<=[a-zа-я])-\s+(?=[a-zа-я])", "")
    assert t.where((clean != tx.clean(F.col("t"))) | (norm != tx.norm(F.col("t")))).count() == 0
