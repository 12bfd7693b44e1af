"""Every operator as a query over the given tables, with the SQL that says the same."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark import fixed_values as fixed
from quillspark.functions import text as tx
from quillspark.operators import chunking, classify, evaluate, matching, recall, scoring
from quillspark.plans import retrieve
from quillspark.session import prepared
from quillspark.sources import files, store
from quillspark.sources.scratch import written
from quillspark.streaming import telemetry

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        @wraps(f)
        def run(spark, sf_dir):
            return f(prepared(spark), sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return run

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- the same helpers in SQL -------------------------------------------------------------------------------------------


def _norm(x: str) -> str:
    out = f"translate(lower(coalesce({x}, '')), 'ё', 'е')"
    for _ in range(6):
        out = f"regexp_replace({out}, '([a-zа-я])-\\s+([a-zа-я])', '\\1\\2', 'g')"
    return out


def _tok(x: str) -> str:
    return f"regexp_extract_all({_norm(x)}, '[0-9a-zа-я]+')"


def _clean(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"


def _stem(t: str) -> str:
    return f"regexp_replace({t}, '^(.{{4,}}?)(?:{'|'.join(fixed.SUFFIXES)})$', '\\1')"


def _cut(x: str, size: int) -> str:
    return f"(CASE WHEN length({_clean(x)}) <= {size} THEN {_clean(x)} ELSE trim(regexp_replace(substr({_clean(x)}, 1, {size}), ' [^ ]*$', '')) END)"


_STOP = "(" + ", ".join(f"'{w}'" for w in fixed.QUERY_STOPWORDS) + ")"
_PROFILE_STOP = "(" + ", ".join(f"'{w}'" for w in fixed.STOPWORDS) + ")"
_WEAK = "(length(term) = 1 AND NOT regexp_matches(term, '[0-9]'))"
_DT = f"dt AS (SELECT doc_id, source, term, count(*) AS tf FROM (SELECT doc_id, source, unnest({_tok('text')}) AS term FROM documents) GROUP BY ALL)"
_QT = f"qt AS (SELECT query_id, term FROM (SELECT item_id AS query_id, unnest(list_distinct({_tok('text')})) AS term FROM benchmark) WHERE term NOT IN {_STOP} AND NOT {_WEAK})"
_KW = f"""{_DT}, {_QT},
kw AS (SELECT query_id, doc_id AS fragment_id, sum(tf) AS n, sum(tf) / (sum(tf) + 5.0) AS lexical_score, row_number() OVER (PARTITION BY query_id ORDER BY sum(tf) DESC, doc_id) AS rank
  FROM dt JOIN qt USING (term) GROUP BY query_id, doc_id QUALIFY rank <= 60)"""
#: A second list: the share of a query's terms that a document has, among the first sixty.
_CV = f"""{_KW},
cv AS (SELECT query_id, doc_id AS fragment_id, count(*) / CAST(max(m) AS DOUBLE) AS overlap, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, doc_id) AS rank
  FROM dt JOIN (SELECT *, count(*) OVER (PARTITION BY query_id) AS m FROM qt) USING (term) GROUP BY query_id, doc_id QUALIFY rank <= 60)"""
_RRF = """s AS (SELECT query_id, fragment_id, sum(1.0 / CAST(60 + rank AS DOUBLE)) AS s FROM (SELECT query_id, fragment_id, rank FROM kw UNION ALL SELECT query_id, fragment_id, rank FROM cv) GROUP BY ALL),
r AS (SELECT query_id, fragment_id, s / max(s) OVER (PARTITION BY query_id) AS rrf_score FROM s)"""


def doc_tokens(spark, sf_dir) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "source", F.explode(tx.tokens(F.col("text"))).alias("term"))
    return d.groupBy("doc_id", "source", "term").agg(F.count("*").alias("tf")).withColumnRenamed("doc_id", "fragment_id")


def bench_terms(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(tx.query_terms(F.col("text"))).alias("term"))


def doc_texts(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("fragment_id"), "source", tx.tokens(F.col("text")).alias("ts"))


def met_terms(spark, sf_dir) -> DataFrame:
    """What documents have of queries, written: the best of each query by both counts at least."""
    met = recall.counted(bench_terms(spark, sf_dir), doc_texts(spark, sf_dir))
    return written(met.groupBy("query_id", "fragment_id").agg(F.sum("n").alias("n"), F.sum("c").alias("c")), "met")


def by_count(met: DataFrame) -> DataFrame:
    return recall.top(met.select("query_id", "fragment_id", "n"), 60, F.desc("n"), F.col("fragment_id")).withColumn("lexical_score", F.col("n") / (F.col("n") + 5.0))


def keyword_list(spark, sf_dir) -> DataFrame:
    return by_count(met_terms(spark, sf_dir))


def both_lists(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The list by counts of query words and the one by the share of the query's words, from one written table of what documents have of queries."""
    met = met_terms(spark, sf_dir)
    terms = bench_terms(spark, sf_dir).groupBy("query_id").agg(F.count("*").alias("m"))
    by_share = recall.top(met.select("query_id", "fragment_id", "c"), 60, F.desc("c"), F.col("fragment_id")).join(terms, "query_id")
    return by_count(met), by_share.select("query_id", "fragment_id", (F.col("c") / F.col("m")).alias("overlap"), "rank")


# --- ingestion ---------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, substr(sha256(concat_ws('|', source, CAST(doc_id * 10000 AS VARCHAR), substr({_clean('text')}, 1, 512))), 1, 32) AS fragment_id FROM documents")
def fragment_ids(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", tx.fragment_id(F.col("source"), F.col("doc_id") * 10000, F.col("text")).alias("fragment_id"))


@query("""SELECT doc_id, CAST(i AS INTEGER) AS index, CAST(i * 850 AS INTEGER) AS start, CAST(length(substr(text, i * 850 + 1, 1000)) AS INTEGER) AS n
FROM (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= 1000 THEN 1 ELSE 1 + CAST(ceil((length(text) - 1000) / 850.0) AS INTEGER) END)) AS i FROM documents)""")
def subchunk_windows(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.explode(chunking.subchunks(F.col("text"))).alias("w"))
    return d.select("doc_id", "w.index", "w.start", F.length("w.text").alias("n"))


@query(f"SELECT doc_id, {_cut('text', 450)} AS snippet FROM documents")
def snippet_450(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", tx.cut_at_word(F.col("text"), 450).alias("snippet"))


@query(f"""SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, len(list_filter(t, lambda x: length(x) = 1 AND NOT regexp_matches(x, '[0-9]'))) AS n_weak,
len(list_filter(t, lambda x: regexp_matches(x, '^[ivxlcdm]+$'))) AS n_roman FROM (SELECT doc_id, {_tok('text')} AS t FROM documents)""")
def token_stats(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", tx.tokens(F.col("text")).alias("t"))
    n = lambda x: F.size(x).cast("long")
    return d.select("doc_id", n("t").alias("n_tokens"), n(F.array_distinct("t")).alias("n_distinct"), n(F.filter("t", tx.is_weak)).alias("n_weak"), n(F.filter("t", tx.is_roman)).alias("n_roman"))


@query(f"""SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, stem) AS rank FROM (SELECT source, {_stem('term')} AS stem, count(DISTINCT term) AS n
FROM (SELECT source, unnest({_tok('text')}) AS term FROM documents) WHERE term NOT IN {_PROFILE_STOP} AND length(term) >= 4 AND regexp_matches(term, '[^0-9]') GROUP BY ALL) QUALIFY rank <= 60""")
def keyword_profile(spark, sf_dir):
    t = read(spark, sf_dir, "documents").select("source", F.explode(tx.tokens(F.col("text"))).alias("term"))
    t = t.where(~F.col("term").isin(*fixed.STOPWORDS) & (F.length("term") >= 4) & F.col("term").rlike("[^0-9]")).distinct()
    n = t.groupBy("source", tx.stem(F.col("term")).alias("stem")).agg(F.count("*").alias("n"))
    return recall.top(n, 60, F.desc("n"), F.col("stem"), by="source")


@query("""SELECT doc_id, lang, CASE WHEN c > l * 1.5 AND c > 20 THEN 'ru' WHEN l > c * 1.5 AND l > 20 THEN 'en' ELSE 'unknown' END AS script
FROM (SELECT doc_id, lang, length(regexp_replace(text, '[^а-яёА-ЯЁ]', '', 'g')) AS c, length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS l FROM documents)""")
def language_by_script(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "lang", tx.language(F.col("text")).alias("script"))


_KIND_SQL = " ".join(f"WHEN regexp_matches({_norm('html')}, '{'|'.join(words)}') THEN '{kind}'" for kind, words in fixed.DOCUMENT_KINDS.items())


@query(f"SELECT page_id, CASE {_KIND_SQL} ELSE 'unknown' END AS doc_type FROM pages")
def doc_type_hints(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", tx.document_type(F.col("html")).alias("doc_type"))


@query(f"""SELECT conv_id, turn, n < 180 OR k < 22 AS too_short, coalesce(regexp_matches(a, '[a-zа-яё]'), false) AS mid_word, coalesce(regexp_matches(a, '[a-zа-яё]'), false) OR dots >= 2 AS fragmented
FROM (SELECT conv_id, turn, length(t) AS n, len({_tok('t')}) AS k, nullif(regexp_extract(t, '[A-Za-zА-Яа-яЁё]'), '') AS a, (length(t) - length(replace(t, '...', ''))) // 3 AS dots FROM (SELECT conv_id, turn, {_clean('text')} AS t FROM conversations))""")
def short_or_fragmented(spark, sf_dir):
    d = read(spark, sf_dir, "conversations").select("conv_id", "turn", tx.clean(F.col("text")).alias("t"))
    first = F.regexp_extract("t", "[A-Za-zА-Яа-яЁё]", 0)
    mid = first.rlike("[a-zа-яё]")
    dots = (F.length("t") - F.length(F.replace("t", F.lit("..."), F.lit("")))) / 3
    broken = mid | (dots >= 2) | F.col("t").rlike(r"^[а-яё]+[.)]\s+[А-ЯЁ]|^[а-яё]+[,.!?;:]\s+")
    return d.select("conv_id", "turn", ((F.length("t") < 180) | (F.size(tx.tokens(F.col("t"))) < 22)).alias("too_short"), mid.alias("mid_word"), broken.alias("fragmented"))


@query("""SELECT host, pages, text_pages, chars, NOT (text_pages >= greatest(1, pages // 2) AND chars / CAST(pages AS DOUBLE) >= 80) AS needs_ocr FROM (SELECT regexp_extract(url, '://([^/?#:]+)', 1) AS host, count(*) AS pages,
count(*) FILTER (length(trim(html)) >= 20) AS text_pages, CAST(sum(length(trim(html))) AS BIGINT) AS chars FROM pages GROUP BY 1)""")
def ocr_probe(spark, sf_dir):
    p = read(spark, sf_dir, "pages").withColumn("host", F.regexp_extract("url", "://([^/?#:]+)", 1))
    return files.needs_ocr(p, "host", "html")


@query("""WITH e AS (SELECT event_id, (['page', 'page_number', 'page_no', 'page_idx', 'page_index'])[1 + event_id % 5] AS k, CAST(json_extract_string(props, '$.k') AS INTEGER) AS n FROM events)
SELECT event_id, CASE WHEN n < 0 THEN NULL WHEN k LIKE '%idx' OR k LIKE '%index' THEN n + 1 WHEN n = 0 THEN 1 ELSE n END AS page FROM e""")
def page_number_coercion(spark, sf_dir):
    keys = F.array(*map(F.lit, ("page", "page_number", "page_no", "page_idx", "page_index")))
    key = F.get(keys, (F.col("event_id") % 5).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", chunking.page_number(F.replace("props", F.lit('"k"'), F.concat(F.lit('"'), key, F.lit('"')))).alias("page"))


@query("""SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'table' ELSE 'text' END AS type, length(text) AS n FROM conversations WHERE trim(text) <> ''""")
def element_normalize(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumn("type", F.when(F.col("role") == "system", "TABLE").otherwise(F.col("role"))).withColumn("content", F.lit(None).cast("string"))
    return chunking.normalize_elements(c).select("conv_id", "turn", "type", F.length("content").cast("long").alias("n"))


@query("""SELECT min(doc_id) AS doc_id, md5(text) AS key FROM documents WHERE lang <> 'en' AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE lang = 'en') GROUP BY 2""")
def insert_if_absent(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", F.md5("text").alias("key"))
    return store.insert_absent(d.where("lang = 'en'"), d.where("lang <> 'en'"), "key", F.col("doc_id")).select("doc_id", "key")


@query("""WITH n AS (SELECT lang, source, max(doc_id) AS doc_id FROM documents WHERE doc_id % 2 = 0 GROUP BY ALL), o AS (SELECT lang, source, max(doc_id) AS doc_id FROM documents WHERE doc_id % 3 = 0 GROUP BY ALL)
SELECT lang, source, doc_id FROM o ANTI JOIN n USING (lang, source) UNION ALL SELECT lang, source, doc_id FROM n""")
def upsert_documents(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("lang", "source", "doc_id")
    old = d.where("doc_id % 3 = 0").groupBy("lang", "source").agg(F.max("doc_id").alias("doc_id"))
    return store.upsert(old, d.where("doc_id % 2 = 0"), ["lang", "source"], F.desc("doc_id"))


@query("SELECT DISTINCT source AS source_uri, lang AS title FROM documents")
def list_sources(spark, sf_dir):
    return store.sources(read(spark, sf_dir, "documents").select(F.col("source").alias("source_uri"), F.col("lang").alias("title")))


@query("""WITH h AS (SELECT doc_id, lang FROM documents SEMI JOIN embeddings ON doc_id = vec_id) SELECT count(*) AS documents, count(*) FILTER (lang IS DISTINCT FROM 'en') AS mismatched,
(SELECT string_agg(doc_id, ',' ORDER BY doc_id) FROM (SELECT doc_id FROM h WHERE lang IS DISTINCT FROM 'en' ORDER BY doc_id LIMIT 20)) AS examples FROM h""")
def embedding_compatibility(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("fingerprint"))
    return store.compatibility(d, read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "en")


@query("""SELECT count(*) AS expected, count(*) AS updated, count(*) FILTER (len(embedding) = 64) AS right_size, count(*) = count(*) FILTER (len(embedding) = 64) AS ok FROM embeddings""")
def reembed_swap_check(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings")
    return store.swap_check(v, v.withColumn("embedding", F.transform("embedding", lambda x: x * 2)), "vec_id", "embedding", 64)


# --- recall and fusion -------------------------------------------------------------------------------------------------

_DENSE = """v AS (SELECT vec_id, vec_id // 4 AS fragment_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS sub, c.fragment_id, c.label, 1 - list_cosine_similarity(q.e, c.e) AS d FROM (SELECT * FROM v WHERE vec_id % 20 = 0) q CROSS JOIN v c)"""


def _vectors(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("subchunk_id"), F.floor(F.col("vec_id") / 4).alias("fragment_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    return v, v.where("subchunk_id % 20 = 0").select(F.col("subchunk_id").alias("query_id"), F.col("embedding").alias("query_vector"))


@query(f"""WITH {_DENSE}, n AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, sub) <= 180), f AS (SELECT query_id, fragment_id, min(d) AS d FROM n GROUP BY ALL)
SELECT query_id, fragment_id, round(greatest(0.0, least(1.0, 1 - d)), 6) AS dense_score, row_number() OVER (PARTITION BY query_id ORDER BY d, fragment_id) AS rank FROM f QUALIFY rank <= 60""")
def dense_topk(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    return recall.dense(q, v).select("query_id", "fragment_id", F.round("dense_score", 6).alias("dense_score"), "rank")


@query(f"""WITH {_DENSE} SELECT query_id, label, round(min(d), 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY min(d), label) AS rank FROM p GROUP BY query_id, label QUALIFY rank <= 8""")
def dense_doc_recall(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    near = recall.nearest_of(q, v, "label", 8)
    return recall.top(near, 8, F.col("distance"), F.col("label")).select("query_id", "label", F.round("distance", 6).alias("distance"), "rank")


@query(f"WITH {_KW} SELECT query_id, fragment_id, CAST(n AS BIGINT) AS n, round(lexical_score, 6) AS lexical_score, rank FROM kw")
def keyword_topk(spark, sf_dir):
    return keyword_list(spark, sf_dir).select("query_id", "fragment_id", "n", F.round("lexical_score", 6).alias("lexical_score"), "rank")


@query(f"WITH {_DT}, {_QT} SELECT query_id, source, CAST(sum(least(tf, 1)) AS BIGINT) AS hits, row_number() OVER (PARTITION BY query_id ORDER BY sum(least(tf, 1)) DESC, source) AS rank FROM dt JOIN qt USING (term) GROUP BY query_id, source QUALIFY rank <= 8")
def keyword_doc_recall(spark, sf_dir):
    hits = doc_tokens(spark, sf_dir).join(bench_terms(spark, sf_dir), "term").groupBy("query_id", "source").agg(F.count("*").alias("hits"))
    return recall.top(hits, 8, F.desc("hits"), F.col("source"))


@query(f"""WITH {_DT}, {_QT}, l AS (SELECT query_id, source, count(DISTINCT term) / CAST(max(m) AS DOUBLE) AS lexical FROM dt JOIN (SELECT *, count(*) OVER (PARTITION BY query_id) AS m FROM qt) USING (term) GROUP BY ALL),
c AS (SELECT *, lexical / 2 AS embedding, CASE WHEN source IN ('src1', 'src2') THEN 0.12 ELSE 0.5 END AS subject, query_id % 2 = 0 AS sure FROM l),
s AS (SELECT *, least(1.0, 0.35 * (0.55 * lexical + 0.45 * embedding) + 0.30 * lexical + 0.20 * subject + 0.15 * embedding) AS score FROM c),
r AS (SELECT *, CASE WHEN sure AND subject <= 0.25 AND lexical < 0.35 THEN 'subject_mismatch' WHEN score < 0.12 AND lexical <= 0 THEN 'low_document_score' END AS reason FROM s),
k AS (SELECT query_id, source, reason, CASE WHEN reason = 'subject_mismatch' THEN score * 0.25 ELSE score END AS score FROM r)
SELECT query_id, source, reason, round(score, 6) AS score, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY query_id ORDER BY reason IS NOT NULL, round(score, 9) DESC, source) END AS rank FROM k QUALIFY reason IS NOT NULL OR rank <= 8""")
def document_route(spark, sf_dir):
    wanted = bench_terms(spark, sf_dir).withColumn("m", F.count("*").over(Window.partitionBy("query_id")))
    vocabulary = doc_tokens(spark, sf_dir).select("source", "term").distinct()
    lexical = vocabulary.join(wanted, "term").groupBy("query_id", "source").agg((F.count("*") / F.max("m")).alias("lexical"))
    subject = F.when(F.col("source").isin("src1", "src2"), 0.12).otherwise(0.5)
    routed = recall.route(lexical.withColumn("embedding", F.col("lexical") / 2).withColumn("subject", subject).withColumn("sure", F.col("query_id") % 2 == 0))
    return routed.select("query_id", "source", "reason", F.round("score", 6).alias("score"), "rank")


_FORMS = f"list_distinct([x, {_stem('x')}])"
_BM25 = f"""pt AS (SELECT query_id, fragment_id, term, count(*) AS tf FROM (SELECT query_id, fragment_id, unnest(flatten(list_transform({_tok("concat_ws(' ', source, text)")}, lambda x: {_FORMS}))) AS term
  FROM (SELECT query_id, fragment_id FROM kw WHERE rank <= 12) JOIN documents ON fragment_id = doc_id) GROUP BY ALL),
qf AS (SELECT query_id, x AS word, unnest({_FORMS}) AS term FROM (SELECT query_id, term AS x FROM qt)),
pl AS (SELECT query_id, fragment_id, sum(tf) AS len, count(*) OVER (PARTITION BY query_id) AS n, avg(sum(tf)) OVER (PARTITION BY query_id) AS a FROM pt GROUP BY query_id, fragment_id),
ph AS (SELECT pt.*, count(*) OVER (PARTITION BY query_id, term) AS df FROM pt JOIN (SELECT DISTINCT query_id, term FROM qf) USING (query_id, term)),
pw AS (SELECT query_id, fragment_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / a))) AS raw FROM ph JOIN pl USING (query_id, fragment_id) GROUP BY ALL),
pc AS (SELECT query_id, fragment_id, count(DISTINCT word) / CAST(max(words) AS DOUBLE) AS coverage FROM pt JOIN qf USING (query_id, term) JOIN (SELECT query_id, count(DISTINCT word) AS words FROM qf GROUP BY 1) USING (query_id) GROUP BY ALL)"""


@query(f"WITH {_KW}, {_BM25} SELECT query_id, fragment_id, round(coverage * raw / max(raw) OVER (PARTITION BY query_id), 6) AS bm25 FROM pw JOIN pc USING (query_id, fragment_id)")
def bm25_pool(spark, sf_dir):
    """BM25 of every benchmark item's twelve best documents by words: over the pool's best, and then by the share of the item's words."""
    pool = written(keyword_list(spark, sf_dir).where("rank <= 12").select("query_id", "fragment_id"), "pool")
    texts = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("fragment_id"), F.concat_ws(" ", "source", "text").alias("t"))
    forms = spread(pool.join(recall.of_ids(texts, pool), "fragment_id")).select("query_id", "fragment_id", F.explode(tx.all_forms(tx.tokens(F.col("t")))).alias("term"))
    words = bench_terms(spark, sf_dir).select("query_id", F.col("term").alias("word"), F.explode(tx.forms(F.col("term"))).alias("term"))
    forms = written(forms.groupBy("query_id", "fragment_id", "term").agg(F.count("*").alias("tf")), "forms")
    scored = recall.bm25(words, forms)
    return scored.select("query_id", "fragment_id", F.round("bm25", 6).alias("bm25"))


@query(f"WITH {_CV}, {_RRF} SELECT query_id, fragment_id, round(rrf_score, 6) AS rrf_score FROM r")
def rrf_fusion(spark, sf_dir):
    kw, cv = both_lists(spark, sf_dir)
    return recall.rrf(kw.select("query_id", "fragment_id", "rank").unionByName(cv.select("query_id", "fragment_id", "rank"))).select("query_id", "fragment_id", F.round("rrf_score", 6).alias("rrf_score"))


_MERGE = """m AS (SELECT query_id, fragment_id, min(l) AS first_list, max(lexical_score) AS lexical_score, max(overlap) AS overlap FROM
(SELECT query_id, fragment_id, 0 AS l, lexical_score, 0.0 AS overlap FROM kw UNION ALL SELECT query_id, fragment_id, 1, 0.0, overlap FROM cv) GROUP BY ALL)"""


@query(f"WITH {_CV}, {_MERGE} SELECT query_id, fragment_id, first_list, round(lexical_score, 6) AS lexical_score, round(overlap, 6) AS overlap FROM m")
def merge_candidates(spark, sf_dir):
    m = recall.merge(*both_lists(spark, sf_dir), scores=["lexical_score", "overlap"])
    return m.select("query_id", "fragment_id", "first_list", F.round("lexical_score", 6).alias("lexical_score"), F.round("overlap", 6).alias("overlap"))


@query(f"""WITH {_CV}, d AS (SELECT query_id, fragment_id, 60 / (60 + rank - 1.0) AS d FROM cv), w AS (SELECT query_id, fragment_id, 60 / (60 + rank - 1.0) AS w FROM kw)
SELECT query_id, fragment_id AS source, round(CASE WHEN coalesce(w, 0) > 0 THEN 0.3 * coalesce(d, 0) + 0.7 * w ELSE least(0.3 * d, 0.15) END, 6) AS document_score FROM d FULL JOIN w USING (query_id, fragment_id)""")
def document_level_scores(spark, sf_dir):
    w, d = both_lists(spark, sf_dir)
    return recall.document_scores(d.withColumnRenamed("fragment_id", "source"), w.withColumnRenamed("fragment_id", "source")).withColumn("document_score", F.round("document_score", 6))


@query(f"WITH {_CV} SELECT query_id, fragment_id, round(max(s), 6) AS score FROM (SELECT query_id, fragment_id, lexical_score AS s FROM kw UNION ALL SELECT query_id, fragment_id, overlap * 0.9 FROM cv) GROUP BY ALL")
def multi_query_max(spark, sf_dir):
    kw, cv = both_lists(spark, sf_dir)
    return recall.weighted_max(kw.select("query_id", "fragment_id", F.col("lexical_score").alias("score")), cv.select("query_id", "fragment_id", F.col("overlap").alias("score"))).withColumn("score", F.round("score", 6))


def candidates(spark, sf_dir) -> DataFrame:
    """Both lists fused, with the columns that preranking needs."""
    kw, cv = both_lists(spark, sf_dir)
    fused = recall.rrf(kw.select("query_id", "fragment_id", "rank").unionByName(cv.select("query_id", "fragment_id", "rank")))
    merged = recall.merge(kw, cv, scores=["lexical_score", "overlap"]).join(fused, ["query_id", "fragment_id"])
    zero = {c: F.lit(v) for c, v in (("dense_score", 0.0), ("document_score", 0.0), ("subject_score", 0.5))}
    return merged.withColumns({"lexical_score": F.round("lexical_score", 9), "overlap": F.round("overlap", 9), "rrf_score": F.round("rrf_score", 9), **zero})


_PRE = f"""{_CV}, {_RRF}, {_MERGE}, x AS (SELECT query_id, fragment_id, round(lexical_score, 9) AS lexical_score, round(overlap, 9) AS overlap, round(rrf_score, 9) AS rrf_score FROM m JOIN r USING (query_id, fragment_id)),
y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(0.45 * rrf_score + 0.15 * lexical_score + 0.025, 9) DESC, fragment_id) AS combined FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY combined <= 6, overlap DESC, lexical_score DESC, rrf_score DESC, fragment_id) AS wordy FROM y),
pool AS (SELECT query_id, fragment_id, lexical_score, overlap, rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY combined <= 6 DESC, CASE WHEN combined <= 6 THEN combined ELSE wordy END) AS position FROM z QUALIFY position <= 12)"""


def spread(rows: DataFrame) -> DataFrame:
    """Few rows that each need much work, dealt out to all cores."""
    return rows.repartition(max(8, rows.sparkSession.sparkContext.defaultParallelism))


def pool(spark, sf_dir) -> DataFrame:
    return recall.balanced(candidates(spark, sf_dir))


@query(f"WITH {_PRE} SELECT query_id, fragment_id, position FROM pool")
def balanced_prerank(spark, sf_dir):
    return pool(spark, sf_dir).select("query_id", "fragment_id", "position")


# --- matching ----------------------------------------------------------------------------------------------------------


def pool_texts(spark, sf_dir) -> DataFrame:
    d, b = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    p = written(pool(spark, sf_dir), "pool")
    p = p.join(recall.of_ids(d.select(F.col("doc_id").alias("fragment_id"), "text", "source"), p), "fragment_id")
    return spread(p.join(b.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), "query_id"))


_PT = f"{_PRE}, t AS (SELECT query_id, fragment_id, {_tok('d.text')} AS t, list_filter(list_distinct({_tok('b.text')}), lambda x: x NOT IN {_STOP} AND NOT (length(x) = 1 AND NOT regexp_matches(x, '[0-9]'))) AS q, {_tok('b.text')} AS qa, d.text AS dtext, d.source FROM pool JOIN documents d ON fragment_id = d.doc_id JOIN benchmark b ON query_id = b.item_id)"


@query(f"WITH {_PT} SELECT query_id, fragment_id, round(len(list_intersect(q, t)) / CAST(len(q) AS DOUBLE), 6) AS overlap FROM t")
def lexical_overlap(spark, sf_dir):
    p = pool_texts(spark, sf_dir)
    return p.select("query_id", "fragment_id", F.round(tx.overlap(tx.query_terms(F.col("query")), tx.tokens(F.col("text"))), 6).alias("overlap"))


_IS_PLAIN = "length({0}) >= 4 AND {0} NOT IN " + _STOP
_PHRASES = f"""list_distinct(list_filter(list_transform(range(1, len(qa)), lambda i: CASE WHEN (regexp_matches(qa[i + 1], '^([0-9]+|[ivxlcdm]+)$') AND qa[i] NOT IN {_STOP} AND NOT (length(qa[i]) = 1 AND NOT regexp_matches(qa[i], '[0-9]')))
OR ({_IS_PLAIN.format('qa[i]')} AND {_IS_PLAIN.format('qa[i + 1]')}) THEN {_stem('qa[i]')} || ' ' || {_stem('qa[i + 1]')} END), lambda x: x IS NOT NULL))"""


@query(f"""WITH {_PT}, g AS (SELECT query_id, fragment_id, {_PHRASES} AS p, ' ' || array_to_string(list_transform(t, lambda x: {_stem('x')}), ' ') || ' ' AS s FROM t)
SELECT query_id, fragment_id, CASE WHEN len(p) = 0 THEN 0.0 ELSE round(len(list_filter(p, lambda x: contains(s, ' ' || x || ' '))) / CAST(len(p) AS DOUBLE), 6) END AS phrase FROM g""")
def phrase_match(spark, sf_dir):
    """The share of a query's phrases that each document of its pool has."""
    p = pool_texts(spark, sf_dir).select("query_id", "fragment_id", matching.phrases(tx.tokens(F.col("query"))).alias("p"), matching.stems(tx.tokens(F.col("text"))).alias("s"))
    return p.select("query_id", "fragment_id", F.round(matching.share(F.col("p"), F.col("s")), 6).alias("phrase"))


@query(f"""WITH c AS (SELECT conv_id, turn, list_distinct({_tok('text')}) AS t, lag(list_distinct({_tok('text')})) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)
SELECT conv_id, turn, round(CASE WHEN len(t) > 0 AND len(b) > 0 THEN len(list_intersect(t, b)) / CAST(len(list_distinct(list_concat(t, b))) AS DOUBLE) ELSE 0.0 END, 6) AS similarity FROM c WHERE b IS NOT NULL""")
def turn_similarity(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", tx.tokens(F.col("text")).alias("t"))
    c = c.withColumn("b", F.lag("t").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b IS NOT NULL")
    return c.select("conv_id", "turn", F.round(tx.jaccard(F.col("t"), F.col("b")), 6).alias("similarity"))


# --- scoring: order lines stand for candidates, their numbers for the components --------------------------------------

_COMPONENTS = {
    "query_id": "l_orderkey", "fragment_id": "l_linenumber", "dense": "l_discount * 10", "lexical": "greatest(l_quantity - 20, 0) / 30", "overlap": "greatest(l_quantity - 25, 0) / 25", "phrase": "CASE WHEN l_suppkey % 3 = 0 THEN l_tax * 10 ELSE 0.0 END",
    "section": "l_tax * 5", "anchor": "CASE WHEN l_partkey % 3 = 0 THEN 0.5 ELSE 0.0 END", "topic": "CASE WHEN l_partkey % 4 = 0 THEN 0.6 ELSE 0.0 END", "subject": "CASE WHEN l_partkey % 7 = 0 THEN 0.12 ELSE 0.5 END",
    "subject_confidence": "CASE WHEN l_orderkey % 2 = 0 THEN 0.7 ELSE 0.1 END", "has_anchor": "l_partkey % 2 = 0", "has_topic": "l_partkey % 5 <> 0", "has_phrases": "l_suppkey % 2 = 0", "missing_phrase": "l_partkey % 11 = 0", "hard_missing": "l_partkey % 22 = 0",
    "wrong_modifier": "l_partkey % 13 = 0", "is_toc": "l_partkey % 17 = 0", "low_quality": "l_partkey % 19 = 0", "too_short": "l_partkey % 5 = 1", "quality": "CASE WHEN l_partkey % 19 = 0 THEN 0.25 ELSE 1.0 END", "rerank": "CASE WHEN l_linenumber <> 4 THEN l_discount * 9.5 END",
    "rrf": "1.0 / l_linenumber", "document": "l_discount * 8", "n_terms": "CAST(l_orderkey % 5 AS INTEGER)", "unknown_subject": "l_orderkey % 9 = 0",
    "query_type": "CASE l_orderkey % 5 WHEN 0 THEN 'concept_lookup' WHEN 1 THEN 'rule_lookup' WHEN 2 THEN 'exercise_lookup' WHEN 3 THEN 'definition' ELSE 'unknown' END",
    "chunk_type": "CASE l_partkey % 6 WHEN 0 THEN 'schema_or_plan' WHEN 1 THEN 'definition' WHEN 2 THEN 'exercise' WHEN 3 THEN 'test_question' WHEN 4 THEN 'explanatory' ELSE 'unknown' END",
    "alignment": "l_tax * 4", "entity": "CASE WHEN l_suppkey % 4 <> 0 THEN CAST(l_suppkey % 4 - 1 AS DOUBLE) / 2 END", "full_phrase": "l_suppkey % 5 = 0", "title_prefix": "l_suppkey % 2 = 1", "required": "CASE WHEN l_suppkey % 3 > 0 THEN CASE WHEN l_suppkey % 3 = 1 THEN 0.5 ELSE 1.0 END END",
    "boundary": "CASE WHEN l_partkey % 6 = 0 THEN 0.08 ELSE 0.0 END", "schema_phrase": "l_suppkey % 7 < 4", "anchor_hit": "l_partkey % 10 = 0",
}
_DOUBLES = {"dense", "lexical", "overlap", "phrase", "section", "anchor", "topic", "subject", "subject_confidence", "quality", "rerank", "rrf", "document", "alignment", "entity", "required", "boundary"}
_AS = ", ".join(f"CAST({v} AS DOUBLE) AS {k}" if k in _DOUBLES else f"{v} AS {k}" for k, v in _COMPONENTS.items())
_WORDS = "greatest(lexical, overlap, phrase, topic * 0.8::DOUBLE)"


def components(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr(*[f"CAST({v} AS DOUBLE) AS {k}" if k in _DOUBLES else f"{v} AS {k}" for k, v in _COMPONENTS.items()])


def _clamp(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"


_FINAL = f"""c AS (SELECT {_AS} FROM lineitem),
f0 AS (SELECT *, {_WORDS} AS w, {_clamp('phrase')} AS ph, coalesce(rerank, 0.0::DOUBLE) AS rr FROM c),
f1 AS (SELECT *, {_clamp('''(0.25::DOUBLE * dense + 0.25::DOUBLE * w + 0.15::DOUBLE * ph + 0.15::DOUBLE * section + 0.05::DOUBLE * rrf + 0.10::DOUBLE * document + 0.10::DOUBLE * subject + 0.05::DOUBLE * quality + coalesce(0.15::DOUBLE * rerank, 0)) / CASE WHEN rerank IS NULL THEN 1.1::DOUBLE ELSE 1.25::DOUBLE END''')} AS x0 FROM f0),
f2 AS (SELECT *, CASE WHEN w <= 0 AND ph <= 0 THEN CASE WHEN dense < 0.9 AND rr < 0.92 THEN least(x0 * 0.25::DOUBLE, 0.24::DOUBLE) ELSE least(x0 * 0.6::DOUBLE, 0.5::DOUBLE) END ELSE x0 END AS x1 FROM f1),
f3 AS (SELECT *, CASE WHEN w <= 0 AND ph <= 0 AND document < 0.45 THEN least(x1, 0.18::DOUBLE) ELSE x1 END AS x2 FROM f2),
f4 AS (SELECT *, CASE WHEN has_anchor AND has_topic AND anchor > 0 AND topic <= 0 THEN least(x2, 0.18::DOUBLE) ELSE x2 END
  * CASE WHEN missing_phrase THEN 0.5::DOUBLE ELSE 1 END * CASE WHEN wrong_modifier THEN 0.25::DOUBLE ELSE 1 END * CASE WHEN subject_confidence >= 0.65 AND subject <= 0.25 THEN 0.25::DOUBLE ELSE 1 END * CASE WHEN overlap <= 0 AND ph <= 0 THEN 0.5::DOUBLE ELSE 1 END AS x3 FROM f3),
f5 AS (SELECT *, round(1e-10::DOUBLE + {_clamp('(CASE WHEN is_toc THEN least(x3 * 0.55::DOUBLE, 0.45::DOUBLE) ELSE x3 END) * CASE WHEN low_quality THEN 0.3::DOUBLE ELSE 1 END')}, 6) AS final FROM f4)"""


def scored(spark, sf_dir) -> DataFrame:
    return components(spark, sf_dir).withColumn("final", F.round(scoring.final_score() + 1e-10, 6))  # ties of exact decimals fall the same way everywhere


@query(f"WITH {_FINAL} SELECT query_id, fragment_id, final FROM f5")
def final_score(spark, sf_dir):
    return scored(spark, sf_dir).select("query_id", "fragment_id", "final")


_NOISE = """CASE WHEN n_terms <= 0 THEN NULL
WHEN unknown_subject AND n_terms >= 3 AND overlap < 0.34 AND phrase < 0.2 AND anchor < 0.34 AND topic < 0.34 THEN 'out_of_domain_low_evidence'
WHEN subject_confidence >= 0.65 AND subject <= 0.25 THEN 'subject_mismatch' WHEN wrong_modifier AND final < 0.35 THEN 'wrong_entity_modifier' WHEN is_toc AND final < 0.35 THEN 'table_of_contents'
WHEN hard_missing AND phrase <= 0.2 THEN 'missing_required_modifier' WHEN document < 0.45 AND greatest(lexical, overlap, phrase) <= 0 AND rr < 0.92 THEN 'low_document_score'
WHEN missing_phrase AND phrase <= 0.2 AND topic <= 0 AND dense < 0.9 AND rr < 0.92 THEN 'missing_required_modifier'
WHEN has_phrases AND phrase <= 0 AND overlap < 0.67 AND NOT (has_anchor AND has_topic AND topic > 0) AND dense < 0.9 AND rr < 0.92 THEN 'low_phrase_match'
WHEN (n_terms >= 3 AND overlap < 0.34 AND document < 0.45 AND dense < 0.9 AND rr < 0.92) OR (greatest(lexical, overlap, phrase) <= 0 AND dense < 0.9) OR (overlap <= 0.01 AND lexical <= 0.02 AND phrase <= 0.02 AND dense < 0.72)
  OR (overlap = 0 AND lexical = 0 AND phrase = 0 AND dense < 0.88) THEN 'low_lexical_overlap' WHEN final <= 0 THEN 'zero_final_score' END"""


@query(f"WITH {_FINAL} SELECT query_id, fragment_id, {_NOISE} AS reason FROM f5")
def noise_reason(spark, sf_dir):
    return scored(spark, sf_dir).select("query_id", "fragment_id", scoring.noise_reason().alias("reason"))


_REFERENCE = "chunk_type IN ('schema_or_plan', 'definition', 'rule', 'explanatory')"
_ASKS = "query_type IN ('rule_lookup', 'explanation', 'definition')"


@query(f"""WITH {_FINAL},
i0 AS (SELECT *, {_clamp('final + 0.14::DOUBLE * alignment - coalesce(CASE WHEN entity <= 0 THEN final * 0.5::DOUBLE WHEN entity < 1 THEN 0.15::DOUBLE * final * (1 - entity) ELSE 0 END, 0)')} AS x FROM f5),
i1 AS (SELECT *, CASE WHEN full_phrase THEN (0.25::DOUBLE + CASE WHEN title_prefix THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN {_REFERENCE} THEN 0.1::DOUBLE ELSE 0 END) * greatest(0, 1 - x) * 1.2::DOUBLE ELSE 0 END AS boost,
  least(0.12::DOUBLE, (1 - quality) * 0.07::DOUBLE + CASE WHEN too_short THEN 0.03::DOUBLE ELSE 0 END + CASE WHEN low_quality THEN 0.02::DOUBLE ELSE 0 END) AS poor,
  CASE WHEN NOT (full_phrase AND {_REFERENCE}) AND required < 0.8 THEN 0.3::DOUBLE ELSE 0 END AS lacking, CASE chunk_type WHEN 'exercise' THEN 0.25::DOUBLE WHEN 'test_question' THEN 0.35::DOUBLE ELSE 0 END AS kind FROM i0)
SELECT query_id, fragment_id, round(1e-9::DOUBLE + CASE WHEN query_type = 'concept_lookup' THEN greatest(0.0::DOUBLE, least(0.99::DOUBLE, x + boost - poor - lacking - boundary - kind)) ELSE {_clamp(f'''x * CASE
WHEN {_ASKS} AND chunk_type = 'schema_or_plan' THEN CASE WHEN coalesce(required >= 0.8, true) AND schema_phrase THEN 1.25::DOUBLE ELSE 1 END WHEN {_ASKS} AND {_REFERENCE} THEN CASE WHEN coalesce(required >= 0.8, true) THEN 1.15::DOUBLE ELSE 1 END
WHEN {_ASKS} AND chunk_type = 'exercise' THEN 0.55::DOUBLE WHEN {_ASKS} AND chunk_type = 'test_question' THEN 0.35::DOUBLE WHEN query_type IN ('exercise_lookup', 'problem_solving') AND chunk_type IN ('exercise', 'test_question') THEN 1.35::DOUBLE ELSE 1 END''')} END, 5) AS score FROM i1""")
def intent_adjust(spark, sf_dir):
    return scored(spark, sf_dir).select("query_id", "fragment_id", F.round(scoring.intent_score() + 1e-9, 5).alias("score"))


@query(f"""WITH c AS (SELECT {_AS} FROM lineitem) SELECT query_id, fragment_id, round(CASE WHEN overlap <= 0 AND phrase <= 0 THEN least(d, 0.15::DOUBLE) WHEN has_anchor AND has_topic AND anchor > 0 AND topic <= 0 THEN least(d, 0.35::DOUBLE)
WHEN has_phrases AND phrase <= 0 AND overlap < 0.67 AND NOT (has_anchor AND has_topic AND topic > 0) THEN least(d, 0.15::DOUBLE) WHEN overlap < 0.5 AND phrase <= 0 THEN least(d, 0.35::DOUBLE) ELSE d END, 6) AS document_score FROM (SELECT *, {_clamp('document')} AS d FROM c)""")
def effective_document_score(spark, sf_dir):
    return components(spark, sf_dir).select("query_id", "fragment_id", F.round(scoring.effective_document_score(), 6).alias("document_score"))


@query(f"""WITH c AS (SELECT {_AS} FROM lineitem) SELECT query_id, fragment_id, round(CASE WHEN rerank IS NULL THEN NULL WHEN hi - lo > 1e-9 THEN (rerank - lo) / (hi - lo) ELSE 0.5 END, 6) AS rerank
FROM (SELECT *, min(rerank) OVER (PARTITION BY query_id) AS lo, max(rerank) OVER (PARTITION BY query_id) AS hi FROM c)""")
def rerank_minmax(spark, sf_dir):
    return components(spark, sf_dir).select("query_id", "fragment_id", F.round(scoring.rerank_minmax(F.col("rerank")), 6).alias("rerank"))


@query(f"""WITH {_FINAL}, a AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, first_value(final) OVER o AS t, lag(final) OVER o AS b FROM f5 WINDOW o AS (PARTITION BY query_id ORDER BY final DESC, fragment_id))
SELECT query_id, fragment_id, final FROM a WHERE n <= 2 OR b IS NULL OR anchor_hit OR NOT (final < 0.55::DOUBLE * t OR (b - final >= 0.18::DOUBLE AND final < 0.75::DOUBLE * t))""")
def adaptive_threshold(spark, sf_dir):
    return scoring.adaptive(scored(spark, sf_dir)).select("query_id", "fragment_id", "final")


@query()
def mmr_select(spark, sf_dir):
    p = pool_texts(spark, sf_dir)
    hits = p.select("query_id", "fragment_id", F.col("rrf_score").alias("final"), "overlap", F.array_distinct(tx.tokens(F.col("text"))).alias("forms"))
    return scoring.mmr(hits, 5).select("query_id", "fragment_id", "final", "rank")


# --- context and answers -----------------------------------------------------------------------------------------------


@query(f"""WITH w AS (SELECT conv_id, turn, role, list({{'s': role, 't': text}}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM conversations),
u AS (SELECT conv_id, turn, CASE WHEN len(list_filter(near, lambda x: x.s = role)) >= 2 THEN list_filter(near, lambda x: x.s = role) ELSE near END AS used FROM w),
j AS (SELECT conv_id, turn, len(used) AS n, array_to_string(list_transform(used, lambda x: x.t), ' ') AS c FROM u) SELECT conv_id, turn, CAST(n AS INTEGER) AS context_size, {_cut('c', 1800)} AS context FROM j""")
def context_window(spark, sf_dir):
    return scoring.context_window(read(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text").select("conv_id", "turn", "context_size", "context")


@query(f"""WITH {_PT}, h AS (SELECT query_id, position AS rank, source, {_cut('dtext', 450)} AS snippet FROM t JOIN pool USING (query_id, fragment_id) WHERE position <= 5)
SELECT query_id, 'Found in the sources:' || chr(10) || string_agg('[' || rank || '] ' || snippet, chr(10) ORDER BY rank) FILTER (rank <= 3) AS answer, string_agg(rank || ':' || source, ',' ORDER BY rank) AS sources FROM h GROUP BY query_id""")
def grounded_answer(spark, sf_dir):
    p = pool_texts(spark, sf_dir).select("query_id", F.col("position").alias("rank"), "source", tx.cut_at_word(F.col("text"), 450).alias("snippet"))
    return scoring.answers(p)


# --- evaluation --------------------------------------------------------------------------------------------------------

_METRICS = """rk AS (SELECT source AS query_id, d.doc_id AS item, lang, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents d),
rel AS (SELECT source AS query_id, doc_id AS item, 1.0 + quality AS gain FROM labels JOIN documents USING (doc_id) WHERE toxic = 0),
ideal AS (SELECT query_id, count(*) AS n, sum(CASE WHEN r <= 10 THEN (pow(2, gain) - 1) / log2(r + 1.0) ELSE 0 END) AS best FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, item) AS r FROM rel) GROUP BY 1),
hit AS (SELECT query_id, count(*) AS found, sum((pow(2, gain) - 1) / log2(rank + 1.0)) AS dcg, min(rank) AS first FROM rk JOIN rel USING (query_id, item) WHERE rank <= 10 GROUP BY 1),
met AS (SELECT query_id, coalesce(found, 0) / CAST(n AS DOUBLE) AS recall, coalesce(dcg, 0) / best AS ndcg, coalesce(1.0 / first, 0) AS mrr FROM ideal LEFT JOIN hit USING (query_id))"""


def metrics(spark, sf_dir) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("item"), "n_chars")
    ranked = recall.top(d, 10, F.desc("n_chars"), F.col("item"))
    labels = read(spark, sf_dir, "labels").where("toxic = 0").select(F.col("doc_id").alias("item"), (1.0 + F.col("quality")).alias("gain"))
    return evaluate.ranking_metrics(ranked, d.join(labels, "item").select("query_id", "item", "gain"), 10)


@query(f"WITH {_METRICS} SELECT query_id, round(recall, 6) AS recall, round(ndcg, 6) AS ndcg, round(mrr, 6) AS mrr FROM met")
def recall_ndcg_mrr(spark, sf_dir):
    return metrics(spark, sf_dir).select("query_id", *(F.round(c, 6).alias(c) for c in ("recall", "ndcg", "mrr")))


@query(f"""WITH {_METRICS}, e AS (SELECT *, CAST(regexp_extract(query_id, '[0-9]+') AS INTEGER) % 5 = 4 AS is_negative, CAST(regexp_extract(query_id, '[0-9]+') AS INTEGER) % 2 AS n_hits, substr(query_id, 1, 4) AS category FROM met)
SELECT category, count(*) AS n, count(*) FILTER (is_negative) AS n_negative, round(avg(recall) FILTER (NOT is_negative), 6) AS recall, round(avg(ndcg) FILTER (NOT is_negative), 6) AS ndcg, round(avg(mrr) FILTER (NOT is_negative), 6) AS mrr,
round(avg(CASE WHEN n_hits = 0 THEN 1.0 ELSE 0.0 END) FILTER (is_negative), 6) AS abstention FROM e GROUP BY ROLLUP (category)""")
def category_rollup(spark, sf_dir):
    number = F.regexp_extract("query_id", "[0-9]+", 0).cast("int")
    rows = metrics(spark, sf_dir).withColumn("is_negative", number % 5 == 4).withColumn("n_hits", number % 2).withColumn("category", F.substring("query_id", 1, 4))
    out = evaluate.summary(rows, "category")
    return out.select("category", "n", "n_negative", *(F.round(c, 6).alias(c) for c in ("recall", "ndcg", "mrr", "abstention")))


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS worst FROM events GROUP BY 1")
def latency_percentiles(spark, sf_dir):
    return evaluate.nearest_ranks(read(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query("""WITH g AS (SELECT * FROM range(1, 4) a(i) CROSS JOIN range(1, 4) b(j) CROSS JOIN range(1, 4) c(k)), p AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank FROM embeddings)
SELECT CAST(i AS INTEGER) AS pool, CAST(j AS INTEGER) AS step, CAST(k AS INTEGER) AS shift, count(*) FILTER (rank <= 10 * i AND (vec_id + k) % (j + 1) = 0) / CAST(count(*) AS DOUBLE) AS share,
row_number() OVER (ORDER BY count(*) FILTER (rank <= 10 * i AND (vec_id + k) % (j + 1) = 0) DESC, i, j, k) AS rank FROM g CROSS JOIN p GROUP BY i, j, k""")
def tuner_grid(spark, sf_dir):
    axis = lambda n: spark.range(1, 4).select(F.col("id").cast("int").alias(n))
    settings = evaluate.grid(axis("pool"), axis("step"), axis("shift"))
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("r"))
    hit = (F.col("r") <= 10 * F.col("pool")) & ((F.col("vec_id") + F.col("shift")) % (F.col("step") + 1) == 0)
    found = e.crossJoin(F.broadcast(settings)).groupBy("pool", "step", "shift").agg(F.count_if(hit).alias("h"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.orderBy(F.desc("h"), "pool", "step", "shift"))
    return found.select("pool", "step", "shift", (F.col("h") / F.col("n")).alias("share"), rank.alias("rank"))


# --- telemetry ---------------------------------------------------------------------------------------------------------


@query("SELECT requests, vs[1 + CAST(round_even(0.95::DOUBLE * (requests - 1), 0) AS INTEGER)] AS p95, vs[1 + CAST(round_even(0.99::DOUBLE * (requests - 1), 0) AS INTEGER)] AS p99, round(e, 6) AS error_rate FROM (SELECT count(*) AS requests, list_sort(list(value)) AS vs, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS e FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 5000))")
def slo_snapshot(spark, sf_dir):
    return telemetry.slo(read(spark, sf_dir, "events"), failed=F.col("event_type") == "error").withColumn("error_rate", F.round("error_rate", 6))


@query("SELECT window_start, key, calls, greatest(0, calls - 2) AS rejected FROM (SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, user_id % 10 AS key, count(*) AS calls FROM events GROUP BY 1, 2)")
def rate_limit_tumbling(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("key", F.col("user_id") % 10)
    return telemetry.tumbling(e, 2, seconds=3600)


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id % 10 ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS in_window FROM events")
def rate_limit_sliding(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("key", F.col("user_id") % 10)
    return telemetry.sliding(e, 3600).select("event_id", "in_window")


@query()
def rate_limit_sliding_exact(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("key", F.col("user_id") % 10)
    return telemetry.sliding_exact(e, 2, 3600)


@query("WITH b AS (SELECT unnest([1.0, 2.5, 5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 'inf'::DOUBLE]::DOUBLE[]) AS le) SELECT event_type, le, count(*) FILTER (value <= le OR le = 'inf'::DOUBLE) AS requests FROM events CROSS JOIN b GROUP BY ALL")
def latency_histogram(spark, sf_dir):
    return telemetry.histogram(read(spark, sf_dir, "events"), "event_type")


# --- folds without a counterpart in SQL --------------------------------------------------------------------------------


@query()
def structured_chunks(spark, sf_dir):
    return chunking.chunks(read(spark, sf_dir, "documents"))


@query()
def coalesced_elements(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("element_index"), F.when(F.col("role") == "system", "table").otherwise("text").alias("type"), F.col("text").alias("content"), F.floor(F.col("turn") / 4).alias("page"))
    return chunking.coalesce_elements(c, "conv_id")


@query()
def hash_embedding(spark, sf_dir):
    return store.embed_hashed(read(spark, sf_dir, "benchmark"), "text", 16)


@query()
def chunk_types(spark, sf_dir):
    """Type and quality flags of every conversation turn."""
    return classify.classified(read(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text").drop("text")


@query()
def query_analysis(spark, sf_dir):
    return classify.analyzed(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")))


@query()
def retrieve_end_to_end(spark, sf_dir):
    """Every benchmark item as a query against all documents."""
    queries = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    fragments = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("fragment_id"), "source", "text")
    return retrieve.retrieve(queries, fragments)
