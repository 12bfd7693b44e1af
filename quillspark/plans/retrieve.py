"""Retrieval from end to end: a table of queries against a table of fragments, all queries at once.

Routing keeps a query's best sources; two recalls (words, and vectors if there are any) are fused for each variant of a query and merged; a pool
of bounded size is matched and scored, noise and the tail are dropped, and unlike hits are chosen. Only the pool meets texts: what is joined
before are ids, terms and counts. The pool, its features and its scores are written: each step then plans over plain columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.config import DEFAULT, Settings
from quillspark.functions import text as tx
from quillspark.operators import classify, matching, recall, scoring
from quillspark.sources.scratch import written

c = F.col

#: What a later variant's fused score counts.
VARIANT_WEIGHT = 0.9


def stemmed(fragments: DataFrame) -> DataFrame:
    """(fragment_id, source, ts) with the stems of all tokens of a text; only Cyrillic words have stems of their own."""
    tokens = fragments.select("fragment_id", "source", tx.tokens(c("text")).alias("ts")).withColumn("line", tx.padded("ts"))
    stems = F.filter(F.split(tx.stems_of_line(c("line")), " "), lambda t: t != "")
    return tokens.select("fragment_id", "source", F.when(c("line").rlike("[а-я]"), stems).otherwise(c("ts")).alias("ts"))


def terms_of(fragments: DataFrame) -> DataFrame:
    """(fragment_id, source, term, tf) of every fragment: the inverted table, to be written once and read by every batch of queries."""
    each = stemmed(fragments).select("fragment_id", "source", F.explode("ts").alias("term"))
    return each.groupBy("fragment_id", "source", "term").agg(F.count("*").alias("tf"))


def profiles(terms: DataFrame, wanted: DataFrame, subject_of: DataFrame | None = None) -> DataFrame:
    """What routing looks at, for each query and source that shares a term with it."""
    counted = wanted.withColumn("m", F.count("*").over(Window.partitionBy("query_id")))
    lexical = terms.select("source", "term").distinct().join(counted, "term").groupBy("query_id", "source").agg((F.count("*") / F.max("m")).alias("lexical"))
    if subject_of is not None:
        lexical = lexical.join(subject_of, ["query_id", "source"], "left")
    else:
        lexical = lexical.withColumns({"subject": F.lit(0.5), "sure": F.lit(False)})
    return lexical.select("query_id", "source", "lexical", F.lit(0.0).alias("embedding"), F.coalesce("subject", F.lit(0.5)).alias("subject"), F.coalesce("sure", F.lit(False)).alias("sure"))


def candidates(asked: DataFrame, fragments: DataFrame, terms: DataFrame | None, vectors: DataFrame | None = None, settings: Settings = DEFAULT, subject_of: DataFrame | None = None) -> DataFrame:
    """(query_id, fragment_id, scores, overlap) of both recalls, fused. ``asked`` has query_id and key_terms (and query_vector with ``vectors``).

    Without ``terms`` the texts are read twice, once for routing and once for counting, and no inverted table is made.
    """
    wanted = asked.select("query_id", F.explode(F.array_distinct(F.transform("key_terms", tx.stem))).alias("term"))
    wanted, texts = written(wanted, "wanted"), stemmed(fragments)
    vocabulary = recall.known(texts, wanted) if terms is None else terms
    routed = recall.route(profiles(vocabulary, wanted, subject_of), settings.routed).where("reason IS NULL").select("query_id", "source", c("score").alias("document_score"), c("subject").alias("subject_score"))
    routed = written(routed, "routed")
    if terms is None:
        met = recall.counted(wanted, texts, settings.recall, routed.select("query_id", "source"))
    else:
        met = terms.join(wanted, "term").select("query_id", "fragment_id", "source", c("tf").alias("n"), F.lit(1).alias("c"))
    hits = met.join(routed, ["query_id", "source"]).groupBy("query_id", "fragment_id").agg(F.sum("n").alias("n"), F.sum("c").alias("found"), F.max("document_score").alias("document_score"), F.max("subject_score").alias("subject_score"))
    words = recall.top(hits, settings.recall, F.desc("n"), c("fragment_id")).withColumn("lexical_score", c("n") / (c("n") + 5.0))
    lists = [words.select("query_id", "fragment_id", "rank", "lexical_score", "document_score", "subject_score", "found")]
    if vectors is not None:
        near = recall.dense(asked, vectors, settings.recall, settings.oversample)
        own = near.join(fragments.select("fragment_id", "source"), "fragment_id").join(routed, ["query_id", "source"])
        # how many terms a near fragment has, also where words alone did not recall it
        own = written(own, "near")
        terms = terms_of(recall.of_ids(fragments, own)) if terms is None else terms
        met = own.select("query_id", "fragment_id").join(terms, "fragment_id").join(wanted, ["query_id", "term"]).groupBy("query_id", "fragment_id").agg(F.count("*").alias("found"))
        own = own.join(met, ["query_id", "fragment_id"], "left")
        lists.append(own.select("query_id", "fragment_id", "rank", "dense_score", "document_score", "subject_score", F.coalesce("found", F.lit(0)).alias("found")))
    ranks = lists[0].select("query_id", "fragment_id", "rank")
    for x in lists[1:]:
        ranks = ranks.unionByName(x.select("query_id", "fragment_id", "rank"))
    merged = recall.merge(*lists, scores=["dense_score", "lexical_score", "document_score", "subject_score", "found"]).join(recall.rrf(ranks, settings.rrf_k), ["query_id", "fragment_id"])
    n = asked.select("query_id", F.greatest(F.size(F.array_distinct(F.transform("key_terms", tx.stem))), F.lit(1)).alias("terms"))
    return merged.join(n, "query_id").withColumn("overlap", c("found") / c("terms")).drop("found", "terms", "first_list")


def merged_variants(found: DataFrame) -> DataFrame:
    """Candidates of all variants of a query as one list: the largest of every score, later variants' fused score counting less.

    ``found.query_id`` is a struct of query_id and variant (from 0).
    """
    weight = F.when(c("query_id.variant") > 0, VARIANT_WEIGHT).otherwise(1.0)
    scores = ["dense_score", "lexical_score", "document_score", "subject_score", "overlap"]
    own = found.select(c("query_id.query_id").alias("q"), "fragment_id", *scores, (c("rrf_score") * weight).alias("rrf_score"))
    return own.groupBy("q", "fragment_id").agg(*(F.max(s).alias(s) for s in [*scores, "rrf_score"])).withColumnRenamed("q", "query_id")


def assessed(queries: DataFrame, fragments: DataFrame, k: int = 5, vectors: DataFrame | None = None, settings: Settings = DEFAULT, subject_of: DataFrame | None = None, terms: DataFrame | None = None,
             sources: list[str] | None = None, include: tuple[str, ...] = ()) -> DataFrame:
    """Every row of every query's pool with its texts, components, final score and the reason for its rejection (null if it is accepted).

    ``queries``: query_id, query; with ``vectors`` query_vector; optionally variants (an array of further wordings, for recall only). ``fragments``:
    fragment_id, source, text, and optionally title, section and page. ``terms``: the result of ``terms_of``, if it was written before. ``sources``
    restricts the search, and then overrides what the subject says. ``include`` may name toc, low_quality and navigation, which are rejected else.
    Queries without terms, and those that routing sends nowhere, have no rows.
    """
    if sources is not None:
        fragments = fragments.where(c("source").isin(*sources))
        terms = terms.where(c("source").isin(*sources)) if terms is not None else None
    asked = classify.analyzed(queries)
    if "variants" in queries.columns:
        each = queries.select(*(x for x in queries.columns if x not in ("variants", "query")), F.posexplode(F.array_distinct(F.concat(F.array("query"), F.coalesce("variants", F.array().cast("array<string>"))))).alias("variant", "query"))
        each = each.withColumn("query_id", F.struct("query_id", "variant")).drop("variant").withColumn("key_terms", tx.query_terms(classify.normalize_query(c("query"))))
        merged = merged_variants(candidates(each, fragments, terms, vectors, settings, subject_of))
    else:
        merged = candidates(asked, fragments, terms, vectors, settings, subject_of)
    pool = written(recall.balanced(merged, max(k, settings.pool)), "chosen")
    extra = [x if x in fragments.columns else F.lit(None).cast(t).alias(x) for x, t in (("title", "string"), ("section", "string"), ("page", "int"))]
    own = pool.join(recall.of_ids(fragments.select("fragment_id", "source", "text", *extra), pool), "fragment_id")
    own = own.join(asked.select("query_id", "normalized", "key_terms", "query_type", "answer_focus", "entities"), "query_id")
    # few rows but much work for each, since long texts have most words in common with a query: every core gets some
    own = written(own.repartition(max(8, queries.sparkSession.sparkContext.defaultParallelism)), "pool")
    return scored(matched(own), settings, scoped=sources is not None, include=include)


def matched(pool: DataFrame) -> DataFrame:
    """The pool with everything that texts say, as plain columns."""
    forms = pool.select("query_id", "fragment_id", F.explode(tx.all_forms(tx.tokens(F.concat_ws(" ", "title", "source", "text")))).alias("term"))
    forms = written(forms.groupBy("query_id", "fragment_id", "term").agg(F.count("*").alias("tf")), "forms")
    words = pool.select("query_id", "key_terms").dropDuplicates(["query_id"]).select("query_id", F.explode("key_terms").alias("word"))
    bm25 = recall.bm25(words.select("query_id", "word", F.explode(tx.forms(c("word"))).alias("term")), forms)
    own = classify.classified(pool, "text", "page")
    own = own.withColumns({"ts": tx.tokens(F.concat_ws(" ", "title", "source", "section", "text")), "qs": tx.tokens(c("normalized"))})
    own = own.withColumns({"st": matching.stems(c("ts")), "anchors": matching.anchors(c("qs")), "wanted_phrases": matching.phrases(c("qs")), "exact": matching.exact_phrases(c("qs"))})
    own = own.withColumns({
        "raw_phrase": matching.share(c("wanted_phrases"), c("st")), "anchor": matching.share(c("anchors"), c("st")), "topic": matching.topic_score(c("key_terms"), c("anchors"), c("wanted_phrases"), c("st")),
        "section_hit": matching.section_score(c("key_terms"), c("wanted_phrases"), c("section")), "required_terms": matching.required_terms(c("key_terms"), c("query_type"), c("exact")),
    })
    before = F.greatest("raw_phrase", matching.weighted(c("anchor"), c("topic"), F.size("anchors") > 0, F.size("key_terms") > 0), 0.85 * c("section_hit"))
    own = own.withColumn("modifier", matching.modifier_match(c("exact"), c("ts"), c("st"), before)).withColumn("term_match", matching.required_term_match(c("required_terms"), F.slice("ts", 1, 1 << 30), c("st")))
    told = own.select(
        "query_id", "fragment_id", "source", "text", "section", "position", "overlap", "chunk_type", "chunk_type_reason", "is_toc", "rrf_score", "dense_score", "lexical_score", "document_score", "subject_score", "query_type", "raw_phrase", "anchor", "topic", "section_hit",
        c("modifier.phrase").alias("phrase"), c("modifier.missing").alias("missing_phrase"), (c("modifier.missing") & F.exists("exact", lambda a: a.rlike("[0-9]"))).alias("hard_missing"), c("modifier.wrong").alias("wrong_modifier"),
        (F.size("anchors") > 0).alias("has_anchor"), (F.size("key_terms") > 0).alias("has_topic"), (F.size("wanted_phrases") > 0).alias("has_phrases"), F.size("key_terms").alias("n_terms"),
        c("low_text_quality").alias("low_quality"), c("low_text_quality_reason").alias("quality_reason"), c("quality_score").alias("quality"), c("is_too_short").alias("too_short"),
        matching.alignment(c("answer_focus"), c("key_terms"), c("ts")).alias("alignment"), c("term_match.match").isin("full_phrase", "full_phrase_prefix").alias("full_phrase"),
        F.coalesce(matching.title_prefix(c("required_terms"), F.array("section")), F.lit(False)).alias("title_prefix"), F.when(F.size("required_terms") > 0, c("term_match.score")).alias("required"),
        F.when((c("answer_focus") != "none") & (F.size("entities") > 0), matching.entity_score(c("entities"), c("st"))).alias("entity"), matching.boundary_penalty(c("required_terms"), c("text"), c("st"), c("chunk_type")).alias("boundary"),
        F.array_distinct(tx.all_forms(tx.tokens(c("text")))).alias("forms"),
    )
    return written(told.join(bm25, ["query_id", "fragment_id"], "left"), "matched")


def scored(rows: DataFrame, s: Settings = DEFAULT, scoped: bool = False, include: tuple[str, ...] = ()) -> DataFrame:
    """``matched`` rows with the final score and the reason for rejection."""
    task = c("chunk_type").isin("exercise", "test_question")
    spared = task & c("quality_reason").eqNullSafe("toc")
    own = rows.withColumns({
        "dense": c("dense_score"), "lexical": F.greatest("lexical_score", F.coalesce("bm25", F.lit(0.0))), "section": c("section_hit"), "subject": c("subject_score"), "rrf": tx.clamp(c("rrf_score")), "rerank": F.lit(None).cast("double"),
        "subject_confidence": F.lit(0.0), "unknown_subject": F.lit(not scoped), "is_toc": c("is_toc") & ~task, "low_quality": c("low_quality") & ~spared, "quality": F.when(spared, F.greatest("quality", F.lit(0.75))).otherwise(c("quality")),
        "schema_phrase": (c("chunk_type") == "schema_or_plan") & ((c("raw_phrase") > 0) | (c("section_hit") >= 0.8) | F.coalesce(c("required") >= 0.8, F.lit(False))), "document": c("document_score"),
    })
    own = own.withColumn("document", scoring.effective_document_score())
    own = own.withColumn("final", scoring.final_score(s)).withColumn("final", scoring.intent_score()).withColumn("reason", scoring.noise_reason(s))
    barred = F.coalesce(*(F.when(when, F.lit(told)) for when, told, name in ((c("is_toc"), "toc_filtered", "toc"), (c("low_quality"), "low_text_quality_filtered", "low_quality"), (c("chunk_type") == "navigation_index", "navigation_filtered", "navigation")) if name not in include), F.lit(None).cast("string"))
    own = own.withColumn("reason", F.coalesce("reason", barred, F.when(c("final") < s.min_score, "below_min_score")))
    strong = (c("overlap") >= 0.8) & (c("lexical") >= 0.7) & (c("phrase") >= 0.55) & (F.coalesce("rerank", F.lit(0.0)) >= 0.4)
    named = (c("full_phrase") | (c("required") >= 0.8) | ((c("phrase") >= 0.9) & (c("overlap") >= 0.67))) & ~c("chunk_type").isin("exercise", "test_question", "navigation_index", "toc")
    return written(own.withColumn("anchor_hit", F.coalesce(strong | named, F.lit(False))).drop("section_hit"), "scored")


def chosen(rows: DataFrame, k: int, s: Settings = DEFAULT) -> DataFrame:
    """The accepted rows without the tail, k unlike ones of each query, with rank and snippet."""
    kept = scoring.adaptive(rows.where("reason IS NULL"), s)
    slim = kept.select("query_id", "fragment_id", "source", "final", "overlap", "chunk_type", c("quality").alias("quality_score"), tx.cut_at_word(c("text"), s.snippet).alias("snippet"), "forms")
    return scoring.mmr(slim, k, s).drop("forms")


def by_relevance(rows: DataFrame) -> DataFrame:
    """``matched`` rows ranked by their final score alone, rejected ones too."""
    return recall.top(scored(rows).drop("reason"), 1 << 30, F.desc("final"), c("fragment_id"))


def select_final(rows: DataFrame, k: int, min_score: float, include: tuple[str, ...] = (), s: Settings = DEFAULT) -> DataFrame:
    """k unlike rows of each query out of ``scored`` ones, whatever noise rules say: above ``min_score``, of the kinds allowed, without the tail."""
    barred = {"toc": c("is_toc"), "low_quality": c("low_quality"), "navigation": c("chunk_type") == "navigation_index"}
    own = rows.where(c("final") >= min_score)
    for name, when in barred.items():
        own = own if name in include else own.where(~when)
    return chosen(own.withColumns({"reason": F.lit(None).cast("string"), "overlap": F.lit(0.0)}), k, s)


def as_hits(hits: DataFrame, fragments: DataFrame, return_text: bool = False, return_context: bool = False, neighbours: int = DEFAULT.neighbours) -> DataFrame:
    """Hits as they are handed out: query_id, rank, fragment_id, source, score, snippet, and the text and the context (with its neighbours) where asked for.

    ``fragments`` needs element_index and section for the context. Only fragments of sources that have hits are looked at.
    """
    out = hits.select("query_id", "rank", "fragment_id", "source", F.round("final", 6).alias("score"), "chunk_type", "snippet")
    if return_text:
        out = out.join(fragments.select("fragment_id", "text"), "fragment_id")
    if return_context:
        near = fragments.join(hits.select("source").distinct(), "source", "left_semi")
        around = scoring.context_window(near, "source", "element_index", "section", "text", neighbours)
        out = out.join(around.select("fragment_id", "context_size", "context"), "fragment_id")
    return out


def retrieve(queries: DataFrame, fragments: DataFrame, k: int = 5, vectors: DataFrame | None = None, settings: Settings = DEFAULT, subject_of: DataFrame | None = None, terms: DataFrame | None = None, **options) -> DataFrame:
    """(query_id, fragment_id, source, final, overlap, chunk_type, quality_score, snippet, rank) of the k best fragments of each query; ``assessed`` says what the parameters are."""
    return chosen(assessed(queries, fragments, k, vectors, settings, subject_of, terms, **options), k, settings)


def with_debug(queries: DataFrame, fragments: DataFrame, k: int = 5, settings: Settings = DEFAULT, **options) -> tuple[DataFrame, DataFrame]:
    """(hits, debug). debug has for each query the size of its pool, how many rows each step left, its rejected rows with reasons, and its five best scores."""
    rows = assessed(queries, fragments, k, settings=settings, **options)
    hits = written(chosen(rows, k, settings), "hits")
    tail = scoring.adaptive(rows.where("reason IS NULL"), settings).select("query_id", "fragment_id", F.lit(True).alias("stays"))
    told = rows.join(tail, ["query_id", "fragment_id"], "left").join(hits.select("query_id", "fragment_id", "rank"), ["query_id", "fragment_id"], "left")
    told = told.withColumn("reason", F.coalesce("reason", F.when(c("stays").isNull(), "adaptive_tail_cut")))
    rejected = F.sort_array(F.collect_list(F.when(c("reason").isNotNull(), F.struct("fragment_id", "reason", F.round("final", 4).alias("final")))))
    best = F.slice(F.transform(F.sort_array(F.collect_list(F.when(c("rank").isNotNull(), F.struct("rank", F.round("final", 4).alias("final"))))), lambda x: x["final"]), 1, 5)
    debug = told.groupBy("query_id").agg(F.count("*").alias("pool"), F.count_if(c("reason").isNull() | (c("reason") == "adaptive_tail_cut")).alias("after_threshold"), F.count("stays").alias("after_adaptive"), F.count("rank").alias("after_mmr"), rejected.alias("rejected"), best.alias("top_scores"))
    return hits, debug
