"""More of the operators as queries with their SQL: profiles, query understanding, quality, evidence. They join the catalogue's."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark import fixed_values as fixed
from quillspark.functions import text as tx
from quillspark.operators import classify, evaluate, profiles
from quillspark.operators.recall import top
from quillspark.plans.catalogue import _METRICS, _PROFILE_STOP, _STOP, _norm, _stem, _tok, bench_terms, components, metrics, query, read, _AS
from quillspark.sources import files

_PLAIN = "[^a-zа-я0-9]"
_ORDERED = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_TERMS = f"(SELECT item_id AS query_id, list_filter({_ORDERED.format('ts')}, lambda x: x NOT IN {_STOP} AND NOT (length(x) = 1 AND NOT regexp_matches(x, '[0-9]'))) AS q, ts FROM (SELECT item_id, {_tok('text')} AS ts FROM benchmark))"


@query(f"SELECT query_id, array_to_string(list_filter(q, lambda t: regexp_matches(t, '[0-9]') OR length(t) >= 3 OR (length(t) = 2 AND NOT regexp_matches(t, '^[ivxlcdm]+$')))[1:8], ' ') AS terms FROM {_TERMS}")
def keyword_recall_terms(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.array_join(profiles.recall_terms(tx.query_terms(F.col("text"))), " ").alias("terms"))


@query(f"""SELECT query_id, array_to_string({_ORDERED.format('p')}, ',') AS phrases FROM (SELECT query_id, list_filter(list_transform(range(1, len(ts)), lambda i: CASE WHEN (regexp_matches(ts[i + 1], '^[0-9]+$|^[ivxlcdm]+$') AND NOT (length(ts[i]) = 1 AND NOT regexp_matches(ts[i], '[0-9]')))
OR (length(ts[i]) >= 4 AND ts[i] NOT IN {_PROFILE_STOP} AND length(ts[i + 1]) >= 4 AND ts[i + 1] NOT IN {_PROFILE_STOP}) THEN ts[i] || ' ' || ts[i + 1] END), lambda x: x IS NOT NULL) AS p FROM {_TERMS})""")
def query_phrases(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.array_join(classify.phrases(F.col("text")), ",").alias("phrases"))


@query(f"""WITH h AS (SELECT term AS hint, 's' || (row_number() OVER (ORDER BY n DESC, term) % 4) AS subject FROM (SELECT term, count(*) AS n FROM (SELECT unnest(q) AS term FROM {_TERMS}) GROUP BY 1 ORDER BY n DESC, term LIMIT 24)),
x AS (SELECT query_id, ' ' || array_to_string(ts, ' ') || ' ' AS t FROM {_TERMS}),
s AS (SELECT query_id, subject, CAST(round(least(0.98, 0.55 + 0.16 * count(*)), 6) AS DOUBLE) AS confidence FROM x JOIN h ON contains(t, ' ' || hint || ' ') GROUP BY ALL)
SELECT query_id, subject, confidence, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, subject) AS rank FROM s""")
def detected_subjects(spark, sf_dir):
    hints = bench_terms(spark, sf_dir).groupBy(F.col("term").alias("hint")).count().orderBy(F.desc("count"), "hint").limit(24).collect()  # two dozen hints, as from a file of settings
    hints = spark.createDataFrame([(f"s{(i + 1) % 4}", r.hint) for i, r in enumerate(hints)], "subject string, hint string")
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return classify.subjects(b, hints).withColumn("confidence", F.round("confidence", 6))


@query(rf"""SELECT doc_id, md5(trim(regexp_replace(t, '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))) AS digest FROM (SELECT doc_id, {"regexp_replace(" * 3}translate(lower(coalesce(text, '')), 'ё' || chr(173), 'е'){r", '([\p{L}\p{N}_])-\s+([\p{L}\p{N}_])', '\1\2', 'g')" * 3} AS t FROM documents)""")
def required_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(profiles.required_text(F.col("text"))).alias("digest"))


@query(r"""SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n ', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM pages""")
def document_text_normalize(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.md5(files.normalized_text(F.col("html"))).alias("digest"))


@query(r"SELECT page_id, nullif(lower(regexp_extract(url, '^[^:/?#]+://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS domain FROM pages")
def source_domains(spark, sf_dir):
    """Half of the addresses without their scheme."""
    bare = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "^[a-z]+://", "")).otherwise(F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", profiles.domain(bare).alias("domain"))


@query("""SELECT conv_id, array_to_string(list_sort(list_distinct(list_transform(range(c), lambda i: CASE WHEN c > 1 THEN CAST(round_even(i * (n - 1) / (c - 1.0)::DOUBLE, 0) AS INTEGER) ELSE 0 END))), ',') AS pages
FROM (SELECT conv_id, count(*) AS n, least(3, count(*)) AS c FROM conversations GROUP BY 1)""")
def ocr_sample_pages(spark, sf_dir):
    n = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return n.select("conv_id", F.array_join(files.sampled_pages(F.col("n"), 3).cast("array<string>"), ",").alias("pages"))


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN l_orderkey % 3 = 0 OR l_partkey % 4 = 3 THEN 0.5 WHEN l_partkey % 4 = 0 THEN greatest(0.8, l_discount * 9.5) WHEN l_partkey % 4 = 1 THEN greatest(0.8, l_tax * 5) WHEN l_discount * 9.5 >= 0.65 THEN 0.12 ELSE 0.35 END, 6) AS score FROM lineitem""")
def profile_subject_score(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    kind = "array<struct<subject:string,confidence:double>>"
    found = F.array(*(F.struct(F.lit(s).alias("subject"), v.alias("confidence")) for s, v in (("a", F.col("l_discount") * 9.5), ("b", F.col("l_tax") * 5))))
    detected = F.when(F.col("l_orderkey") % 3 == 0, F.array().cast(kind)).otherwise(found)
    subject = F.get(F.array(*map(F.lit, ("a", "b", "c", "unknown"))), (F.col("l_partkey") % 4).cast("int"))
    return lines.select("l_orderkey", "l_linenumber", F.round(profiles.subject_score(subject, detected), 6).alias("score"))


_PROFILE = f"""p AS (SELECT source, stem FROM (SELECT source, {_stem('term')} AS stem, count(DISTINCT term) AS n FROM (SELECT source, unnest({_tok('text')}) AS term FROM documents) WHERE term NOT IN {_PROFILE_STOP} AND length(term) >= 4 AND regexp_matches(term, '[^0-9]') GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, stem) <= 60)"""


@query(f"WITH {_PROFILE}, w AS (SELECT query_id, {_stem('term')} AS stem, m FROM (SELECT query_id, unnest(q) AS term, len(q) AS m FROM {_TERMS})) SELECT query_id, source, round(count(*) / CAST(max(m) AS DOUBLE), 6) AS lexical FROM w JOIN p USING (stem) GROUP BY query_id, source")
def profile_lexical_score(spark, sf_dir):
    from quillspark.plans.catalogue import keyword_profile

    scored = profiles.lexical_scores(bench_terms(spark, sf_dir), keyword_profile(spark, sf_dir).select("source", "stem"))
    return scored.withColumn("lexical", F.round("lexical", 6))


_ASKS = "query_type IN ('rule_lookup', 'explanation', 'definition', 'concept_lookup')"


@query(f"""WITH c AS (SELECT {_AS} FROM lineitem) SELECT query_id, fragment_id, concat_ws(',', CASE WHEN is_toc THEN 'toc_penalty' END, CASE WHEN low_quality THEN 'low_text_quality_penalty' END, CASE WHEN wrong_modifier THEN 'wrong_entity_modifier_penalty' END,
CASE WHEN missing_phrase THEN 'missing_required_modifier_penalty' END, CASE WHEN {_ASKS} AND chunk_type = 'exercise' THEN 'exercise_intent_penalty' END, CASE WHEN {_ASKS} AND chunk_type = 'test_question' THEN 'test_question_intent_penalty' END,
CASE WHEN query_type = 'concept_lookup' AND NOT full_phrase AND required < 0.8 THEN 'required_term_penalty' END, CASE WHEN entity <= 0 THEN 'missing_required_entity_penalty' END, CASE WHEN subject_confidence >= 0.65 AND subject <= 0.25 THEN 'subject_mismatch_penalty' END) AS penalties FROM c""")
def penalties_applied(spark, sf_dir):
    return components(spark, sf_dir).select("query_id", "fragment_id", F.array_join(profiles.penalties(), ",").alias("penalties"))


_NOW = {"chunk_type": "CASE l_partkey % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'toc' WHEN 2 THEN 'rule' ELSE 'definition' END", "quality_score": "CASE WHEN l_partkey % 3 = 0 THEN 0.5 ELSE 1.0 END"}
_OLD = {"chunk_type": "CASE l_suppkey % 4 WHEN 0 THEN 'index' WHEN 1 THEN 'rule' WHEN 2 THEN 'explanatory' END", "quality_score": "CASE WHEN l_suppkey % 5 < 3 THEN 0.25 + 0.25 * (l_suppkey % 3) END", "is_navigation_index": "l_suppkey % 7 = 0"}
_NOW |= {k: f"l_partkey % {n} = 0" for k, n in zip(profiles.FLAGS, (11, 13, 17, 5, 6, 7, 8, 19))}
_OLD |= {k: f"CASE WHEN l_orderkey % 3 > 0 THEN l_suppkey % {n} = 0 END" for k, n in zip(profiles.FLAGS, (13, 17, 11, 3, 4, 5, 6, 9))}
_EITHER = "({0}_chunk_type IN ('navigation_index', 'toc', 'index', 'bibliography') OR {0}_is_toc OR {0}_is_index OR {0}_is_bibliography{1})"


@query(f"""WITH a AS (SELECT l_orderkey, l_linenumber, {', '.join(f'{v} AS n_{k}' for k, v in _NOW.items())}, {', '.join(f'{v} AS o_{k}' for k, v in _OLD.items())} FROM lineitem),
b AS (SELECT *, coalesce({_EITHER.format('o', ' OR o_is_navigation_index')}, false) AND NOT {_EITHER.format('n', '')} AND n_chunk_type <> 'unknown' AS stale FROM a),
d AS (SELECT *, {', '.join(f"n_{k} OR (coalesce(o_{k}, false){' AND NOT stale' if k in (*profiles.HARD_FLAGS, 'low_text_quality') else ''}) AS {k}" for k in profiles.FLAGS)},
CASE WHEN n_chunk_type = 'toc' OR stale THEN n_chunk_type ELSE coalesce(o_chunk_type, n_chunk_type) END AS chunk_type, CASE WHEN stale THEN n_quality_score ELSE least(n_quality_score, coalesce(o_quality_score, 9)) END AS q FROM b)
SELECT l_orderkey, l_linenumber, chunk_type, {', '.join(profiles.FLAGS)}, chunk_type = 'navigation_index' OR (o_is_navigation_index AND NOT stale) AS is_navigation_index, CAST(CASE WHEN low_text_quality THEN least(q, 0.25) ELSE q END AS DOUBLE) AS quality_score FROM d""")
def candidate_quality(spark, sf_dir):
    side = lambda of: F.struct(*(F.expr(f"CAST({v} AS DOUBLE)" if k == "quality_score" else v).alias(k) for k, v in of.items()))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", side(_NOW).alias("now"), side(_OLD).alias("old"))
    return rows.select("l_orderkey", "l_linenumber", profiles.current_quality(F.col("now"), F.col("old")).alias("q")).select("l_orderkey", "l_linenumber", "q.*")


@query("SELECT conv_id, bool_or(turn IN (0, 2) AND contains(lower(text), 'a') AND contains(lower(text), 'the')) AS evidence FROM conversations GROUP BY 1")
def evidence_match(spark, sf_dir):
    one = F.array(F.struct(F.col("turn").alias("page"), F.col("text")))
    found = evaluate.matches_evidence(one, F.array(F.lit(0).cast("long"), F.lit(2).cast("long")), F.array(F.lit("A"), F.lit("the")))
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.bool_or(found).alias("evidence"))


_ACCEPTANCE = """h AS (SELECT source AS query_id, lang = 'en' AS right_source, coalesce(quality = 1, false) AS evidence, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents LEFT JOIN labels USING (doc_id)),
m AS (SELECT query_id, min(rank) FILTER (evidence AND rank <= 5) AS f, coalesce(bool_or(right_source AND rank = 1), false) AS top1_source FROM h WHERE rank <= 10 GROUP BY 1)"""


@query(f"WITH {_ACCEPTANCE} SELECT query_id, CASE WHEN f IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS recall, round(coalesce(1 / log2(f + 1.0), 0), 6) AS ndcg, round(coalesce(1.0::DOUBLE / f, 0), 6) AS mrr, top1_source FROM m")
def acceptance_metrics(spark, sf_dir):
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    hits = top(d.select(F.col("source").alias("query_id"), "doc_id", "n_chars", (F.col("lang") == "en").alias("right_source"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("evidence")), 10, F.desc("n_chars"), F.col("doc_id"))
    return evaluate.evidence_metrics(hits, 5).withColumns({"ndcg": F.round("ndcg", 6), "mrr": F.round("mrr", 6)})


@query("SELECT doc_id, concat_ws(',', CASE WHEN NOT contains(lower(text), 'the ') AND NOT contains(lower(text), ' le ') THEN 'no_expected_terms' END, CASE WHEN contains(lower(source), 'src1') THEN 'forbidden_source_term' END) AS warnings FROM documents")
def hit_warnings(spark, sf_dir):
    told = evaluate.warnings(F.array(F.lit("The "), F.lit(" le ")), F.array(F.lit("SRC1")), F.col("text"), F.col("source"))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(told, ",").alias("warnings"))


@query(f"WITH {_METRICS}, a AS (SELECT avg(recall) AS recall, avg(ndcg) AS ndcg, avg(mrr) AS mrr FROM met) SELECT unnest(['recall', 'ndcg', 'mrr']) AS metric, unnest([recall >= 0.9, ndcg >= 0.2, mrr <= 0.9]) AS passed FROM a")
def threshold_gate(spark, sf_dir):
    means = metrics(spark, sf_dir).agg(*(F.avg(m).alias(m) for m in ("recall", "ndcg", "mrr")))
    return evaluate.gate(means, {"recall": 0.9, "ndcg": 0.2}, {"mrr": 0.9}).select("metric", "passed")


_KINDS = " ".join(f"WHEN regexp_matches(n, '{'|'.join(words)}') THEN '{kind}'" for kind, words in fixed.DOCUMENT_KINDS.items())


@query(f"""WITH e AS (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents),
f AS (SELECT source, string_agg(text, ' ' ORDER BY rank) AS t FROM e WHERE rank <= 8 GROUP BY 1),
g AS (SELECT source, {_norm("source || ' ' || t")} AS n, length(regexp_replace(t, '[^а-яёА-ЯЁ]', '', 'g')) AS c, length(regexp_replace(t, '[^a-zA-Z]', '', 'g')) AS l FROM f),
k AS (SELECT source, string_agg(stem, ' ' ORDER BY r) AS keywords FROM (SELECT source, stem, row_number() OVER (PARTITION BY source ORDER BY n DESC, stem) AS r FROM (SELECT source, {_stem('term')} AS stem, count(DISTINCT term) AS n
  FROM (SELECT source, unnest({_tok('text')}) AS term FROM e WHERE rank <= 30) WHERE term NOT IN {_PROFILE_STOP} AND length(term) >= 4 AND regexp_matches(term, '[^0-9]') GROUP BY ALL) QUALIFY r <= 50) GROUP BY 1)
SELECT source, CASE {_KINDS} ELSE 'unknown' END AS doc_type, CASE WHEN c > l * 1.5 AND c > 20 THEN 'ru' WHEN l > c * 1.5 AND l > 20 THEN 'en' ELSE 'unknown' END AS language, coalesce(keywords, '') AS keywords FROM g LEFT JOIN k USING (source)""")
def document_profiles(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("element_index"), F.col("text").alias("content"))
    return profiles.document_profiles(d).select("source", "doc_type", "language", F.array_join("keywords", " ").alias("keywords"))


@query()
def section_titles(spark, sf_dir):
    return profiles.section_titles(read(spark, sf_dir, "documents"), ["doc_id"])
