"""Queries over literal Cyrillic rows, which the given tables lack.

Where SQL says the same, it does so in its own way; elsewhere the SQL states the results that the definitions give for these rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark import fixed_values as fixed
from quillspark.functions import text as tx
from quillspark.operators import classify, matching, similar
from quillspark.plans.catalogue import _norm, _stem, _tok, query, read

c = F.col


def _values(rows: list[tuple], names: str) -> str:
    def one(v) -> str:
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else "'" + v.replace("'", "''") + "'"

    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({names})"


def _table(spark, rows: list[tuple], names: str):
    return spark.sql(f"SELECT * FROM {_values(rows, names)}")


def _numbered(rows: list) -> list[tuple]:
    return [(n, *(r if isinstance(r, tuple) else (r,))) for n, r in enumerate(rows)]


_WORDS = _numbered("глаголами история синтаксического реформы дом дома дождь ученикам её предложениями объектов линия большая вода году xiv class 1812 походов".split())
_BY_CASES = " ".join(f"WHEN w LIKE '%{s}' AND length(w) >= {len(s) + 4} THEN left(w, length(w) - {len(s)})" for s in fixed.SUFFIXES)


@query(f"SELECT id, CASE WHEN length(w) < 5 THEN w {_BY_CASES} ELSE w END AS stem FROM (SELECT id, replace(word, 'ё', 'е') AS w FROM {_values(_WORDS, 'id, word')})")
def literal_stems(spark, sf_dir):
    return _table(spark, _WORDS, "id, word").select("id", tx.stem(tx.norm(c("word"))).alias("stem"))


_QUERIES = _numbered(["Какие были причины войны 1812 года?", "Что такое Глагол", "в чём отличие и сходство", "Пере-\nнос слова, о б 7", "", "ЁЛКА у дома"])
_STOPS = "(" + ", ".join(f"'{w}'" for w in fixed.QUERY_STOPWORDS) + ")"


@query(f"SELECT id, coalesce(array_to_string(list_sort(list_distinct(list_filter({_tok('q')}, lambda x: x NOT IN {_STOPS} AND NOT (length(x) = 1 AND x NOT BETWEEN '0' AND '9')))), ' '), '') AS terms FROM {_values(_QUERIES, 'id, q')}")
def literal_query_terms(spark, sf_dir):
    return _table(spark, _QUERIES, "id, q").select("id", F.array_join(F.array_sort(tx.query_terms(c("q"))), " ").alias("terms"))


_PAIRS = _numbered([("реформы александра", "Реформа царя Александра была нужна"), ("виды глаголов", "Глаголы бывают разных видов"), ("река волга", "Озеро Байкал"), ("", "текст"), ("слово", "")])


@query(f"""WITH t AS (SELECT id, list_distinct({_tok('q')}) AS q, {_tok('x')} AS x FROM {_values(_PAIRS, 'id, q, x')}),
f AS (SELECT id, q, flatten(list_transform(x, lambda w: [w, {_stem('w')}])) AS fs FROM t)
SELECT id, CASE WHEN len(q) = 0 THEN 0.0 ELSE len(list_filter(q, lambda w: list_contains(fs, w) OR list_contains(fs, {_stem('w')}))) / CAST(len(q) AS DOUBLE) END AS overlap FROM f""")
def literal_overlap(spark, sf_dir):
    return _table(spark, _PAIRS, "id, q, x").select("id", tx.overlap(tx.query_terms(c("q")), tx.tokens(c("x"))).alias("overlap"))


_NAMES = _numbered(["Рабочая тетрадь 5 класс", "uchebnik istorija 7", "Методические указания", "Сборник задач, 11 класс", "Задачник", "klass 12", "13 класс", "russkij_jazyk-6", "роман"])


@query(f"""SELECT id, CASE WHEN contains(n, 'рабочая тетрадь') OR contains(n, 'workbook') OR contains(n, 'тетрадь') THEN 'workbook' WHEN contains(n, 'учебник') OR contains(n, 'textbook') OR contains(n, 'uchebnik') THEN 'textbook'
WHEN contains(n, 'пособие') OR contains(n, 'руководство') OR contains(n, 'manual') OR contains(n, 'методич') THEN 'manual' WHEN contains(n, 'сборник') OR contains(n, 'задачник') OR contains(n, 'хрестоматия') THEN 'collection' ELSE 'unknown' END AS kind,
CASE id WHEN 0 THEN 5 WHEN 1 THEN 7 WHEN 3 THEN 11 WHEN 7 THEN 6 END AS grade FROM (SELECT id, {_norm('name')} AS n FROM {_values(_NAMES, 'id, name')})""")
def literal_document_kinds(spark, sf_dir):
    return _table(spark, _NAMES, "id, name").select("id", tx.document_type(c("name")).alias("kind"), tx.grade(c("name")).alias("grade"))


_TYPES = _numbered([
    ("найдите упражнение", "exercise_lookup", "none"), ("решите уравнение", "problem_solving", "none"), ("правописание корней", "rule_lookup", "none"), ("почему идет дождь", "explanation", "cause"),
    ("что такое глагол", "definition", "none"), ("столица франции", "concept_lookup", "none"), ("", "unknown", "none"), ("где находится река", "explanation", "none"),
    ("в чем состоит главный итог всей долгой северной войны", "explanation", "consequence"), ("карта полезных ископаемых сибири урала кавказа", "unknown", "none"), ("тема: цель похода", "explanation", "goal"),
])


@query(f"SELECT id, query_type, answer_focus FROM {_values(_TYPES, 'id, query, query_type, answer_focus')}")
def literal_query_types(spark, sf_dir):
    return classify.analyzed(_table(spark, [(i, q) for i, q, *_ in _TYPES], "id, query")).select("id", "query_type", "answer_focus")


_ENTITIES = _numbered([
    ("Когда Пётр I основал Петербург и СССР", "Пётр I|Петербург|СССР", "ссср", True, "пётр i"), ("О и ЁЕ после шипящих", "ЁЕ", "ее", False, "о и ее"), ("мчс россии", "", "", False, ""), ("Закон 1812 года", "Закон 1812", "", False, "закон 1812 года"),
])


@query(f"SELECT id, entities, abbreviations, ruler, translate(exact, 'ё', 'е') AS exact FROM {_values([(i, q, e, a, r, x if i != 0 else 'пётр i|ссср') for i, q, e, a, r, x in _ENTITIES], 'id, q, entities, abbreviations, ruler, exact')}")
def literal_entities(spark, sf_dir):
    listed = lambda x: F.array_join(x, "|")
    t = _table(spark, [(i, q) for i, q, *_ in _ENTITIES], "id, q")
    return t.select("id", listed(classify.entities(c("q"))).alias("entities"), listed(classify.abbreviations(c("q"))).alias("abbreviations"), classify.names_a_ruler(c("q")).alias("ruler"), listed(classify.exact_phrases(c("q"))).alias("exact"))


#: query, text, share of phrases, anchor, topic, phrase after modifiers, missing, wrong
_MATCHES = _numbered([
    ("реформы александра ii", "Реформы Александра II изменили страну", 1.0, 1.0, 1.0, 1.0, False, False),
    ("реформы александра ii", "Реформы Александра III были иными", 0.5, 0.0, 0.5, 0.2, True, True),
    ("закон 1812 года", "Закон был принят. Указ от 1812 г. вышел", 0.5, 0.0, 1.0, 0.75, False, False),
    ("правление николая i", "Царствование Николая I принесло реформы", 0.5, 1.0, 0.8, 0.89, False, False),
    ("часть речи", "Члены предложения", 0.0, 0.0, 0.0, 0.0, False, False),
    ("людовик xiv", "Людовик людовика отца", 0.0, 0.0, 0.0, 0.0, True, True),
])


@query(f"SELECT id, share, anchor, topic, phrase, missing, wrong FROM {_values(_MATCHES, 'id, q, x, share, anchor, topic, phrase, missing, wrong')}")
def literal_matching(spark, sf_dir):
    t = _table(spark, [r[:3] for r in _MATCHES], "id, q, x").select("id", tx.tokens(c("q")).alias("q"), tx.query_terms(c("q")).alias("terms"), tx.tokens(c("x")).alias("ts"))
    t = t.withColumns({"st": matching.stems(c("ts")), "anchors": matching.anchors(c("q")), "phrases": matching.phrases(c("q")), "exact": matching.exact_phrases(c("q"))})
    t = t.withColumns({"share": matching.share(c("phrases"), c("st")), "anchor": matching.share(c("anchors"), c("st")), "topic": matching.topic_score(c("terms"), c("anchors"), c("phrases"), c("st"))})
    before = F.greatest("share", matching.weighted(c("anchor"), c("topic"), F.size("anchors") > 0, F.size("terms") > 0))
    t = t.withColumn("m", matching.modifier_match(c("exact"), c("ts"), c("st"), before))
    return t.select("id", "share", "anchor", F.round("topic", 6).alias("topic"), F.round("m.phrase", 6).alias("phrase"), "m.missing", "m.wrong")


_ALIGNED = _numbered([
    ("причины войны", "Война началась вследствие спора", 1.0), ("причины войны", "Событие вызвало кризис, а война шла", 0.0), ("почему", "Потому что так", 0.25),
    ("цель похода", "Поход длился пять лет и шесть месяцев, при том его задача была взять город", 0.75), ("столица", "Причина войны", 0.0),
])


@query(f"SELECT id, alignment FROM {_values(_ALIGNED, 'id, q, x, alignment')}")
def literal_alignment(spark, sf_dir):
    t = _table(spark, [r[:3] for r in _ALIGNED], "id, q, x")
    return t.select("id", matching.alignment(classify.answer_focus(tx.norm(c("q"))), tx.query_terms(c("q")), tx.tokens(c("x"))).alias("alignment"))


_CHUNKS = _numbered([
    ("", "unknown", "empty_text"), ("Правило: частица не пишется раздельно с глаголами.", "rule", "rule_marker"), ("Глагол — часть речи, которая означает действие предмета.", "definition", "dash_definition"),
    ("Выполните задание 5 и запишите ответ.", "exercise", "exercise_command"), ("Например, вода кипит.", "example", "example_marker"), ("Оглавление Глава 1 Глава 2", "navigation_index", "navigation_titles_with_page_numbers"),
    ("просто слова", "unknown", "no_chunk_type_signal"), ("План разбора слова. 1) Найти корень. 2) Указать приставку.", "schema_or_plan", "schema_markers_with_steps"), ("А1. Выберите верный ответ. 1) да 2) нет", "test_question", "test_labels_or_answer_options"),
])


@query(f"SELECT id, chunk_type, chunk_type_reason FROM {_values(_CHUNKS, 'id, x, chunk_type, chunk_type_reason')}")
def literal_chunk_types(spark, sf_dir):
    return classify.classified(_table(spark, [r[:2] for r in _CHUNKS], "id, x"), "x").select("id", "chunk_type", "chunk_type_reason")


_SECTIONS = _numbered([("морфологический разбор", "Морфологический разбор глагола", 1.0, "full_phrase_prefix", 1.0), ("разбор слова", "Разбор", 0.55, "partial", 0.125), ("виды глаголов", "О глаголах и их видах", 0.55, "partial", 0.125), ("формы глаголов", "О глаголах и их формах", 1.0, "all_terms", 0.8), ("виды глаголов", "", 0.0, "none", 0.0)])


@query(f"SELECT id, section, how, required FROM {_values(_SECTIONS, 'id, q, x, section, how, required')}")
def literal_sections(spark, sf_dir):
    t = _table(spark, [r[:3] for r in _SECTIONS], "id, q, x").select("id", "x", tx.tokens(c("q")).alias("q"), tx.query_terms(c("q")).alias("terms"), tx.tokens(c("x")).alias("ts"))
    wanted = matching.required_terms(c("terms"), F.lit("concept_lookup"), matching.exact_phrases(c("q")))
    t = t.select("id", matching.section_score(c("terms"), matching.phrases(c("q")), c("x")).alias("section"), matching.required_term_match(wanted, c("ts"), matching.stems(c("ts"))).alias("m"))
    return t.select("id", "section", c("m.match").alias("how"), c("m.score").alias("required"))


@query(f"""WITH t AS (SELECT doc_id, list_sort(list_distinct({_tok('text')})) AS f FROM documents), s AS (SELECT f, min(doc_id) AS class_id FROM t GROUP BY f), e AS (SELECT class_id, len(f) AS n, unnest(f) AS w FROM s),
p AS (SELECT a.class_id AS a, b.class_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM e a JOIN e b ON a.w = b.w AND a.class_id <> b.class_id AND least(a.n, b.n) >= 0.82 * greatest(a.n, b.n) GROUP BY ALL HAVING count(*) >= 0.82 * (a.n + b.n - count(*)) - 1e-9)
SELECT doc_id, class_id, coalesce(links, 0) AS links FROM t JOIN s USING (f) LEFT JOIN (SELECT a AS class_id, count(*) AS links FROM p GROUP BY a) USING (class_id)""")
def jaccard_pairs(spark, sf_dir):
    """Documents by their sets of word forms: classes of equal sets, and how many other classes have a similarity of 0.82 or more."""
    return similar.similar_texts(read(spark, sf_dir, "documents"), "doc_id", "text")
