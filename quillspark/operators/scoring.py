"""Final scores, reasons for rejection, thresholds, diversity, context and answers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.config import DEFAULT, Settings
from quillspark.functions.text import clamp, cut_at_word

c = F.col


def rerank_minmax(raw: Column, by: str = "query_id") -> Column:
    """Raw scores spread over 0 to 1 within a query; 0.5 where all are equal; null stays null."""
    w = Window.partitionBy(by)
    low, high = F.min(raw).over(w), F.max(raw).over(w)
    return F.when(raw.isNotNull(), F.when(high - low > 1e-9, (raw - low) / (high - low)).otherwise(0.5))


def effective_document_score() -> Column:
    score, anchored = clamp(c("document")), c("has_anchor") & c("has_topic")
    cap = F.when((c("overlap") <= 0) & (c("phrase") <= 0), 0.15)
    cap = cap.when(anchored & (c("anchor") > 0) & (c("topic") <= 0), 0.35)
    cap = cap.when(c("has_phrases") & (c("phrase") <= 0) & (c("overlap") < 0.67) & ~(anchored & (c("topic") > 0)), 0.15)
    return F.least(score, cap.when((c("overlap") < 0.5) & (c("phrase") <= 0), 0.35).otherwise(1.0))


def final_score(s: Settings = DEFAULT) -> Column:
    """The weighted mean of the components (rerank only where there is one), then caps and penalties in their order."""
    words, phrase, rerank = F.greatest("lexical", "overlap", "phrase", c("topic") * 0.8), clamp(c("phrase")), F.coalesce("rerank", F.lit(0.0))
    parts = {"dense": c("dense"), "lexical": words, "phrase": phrase, "section": c("section"), "rrf": c("rrf"), "document": c("document"), "subject": c("subject"), "quality": c("quality")}
    own = sum(s.weights[k] for k in parts)
    mean = (sum((s.weights[k] * v for k, v in parts.items()), F.lit(0.0)) + F.coalesce(s.weights["rerank"] * c("rerank"), F.lit(0.0))) / F.when(c("rerank").isNull(), own).otherwise(own + s.weights["rerank"])
    x, silent = clamp(mean), (words <= 0) & (phrase <= 0)
    strong = (c("dense") >= s.extreme_dense) | (rerank >= s.extreme_rerank)
    x = F.when(silent & ~strong, F.least(x * 0.25, F.lit(0.24))).when(silent, F.least(x * 0.6, F.lit(0.5))).otherwise(x)
    x = F.when(silent & (c("document") < s.document_gate), F.least(x, F.lit(0.18))).otherwise(x)
    x = F.when(c("has_anchor") & c("has_topic") & (c("anchor") > 0) & (c("topic") <= 0), F.least(x, F.lit(0.18))).otherwise(x)
    for when, factor in (
        (c("missing_phrase"), 0.5),
        (c("wrong_modifier"), 0.25),
        ((c("subject_confidence") >= s.subject_sure) & (c("subject") <= s.subject_mismatch), s.subject_penalty),
        ((c("overlap") <= 0) & (phrase <= 0), 0.5),
    ):
        x = x * F.when(when, factor).otherwise(1.0)
    x = F.when(c("is_toc"), F.least(x * s.toc_penalty, F.lit(0.45))).otherwise(x)
    return clamp(x * F.when(c("low_quality"), s.low_quality_penalty).otherwise(1.0))


def subject_score(row_score: Column, stored: Column) -> Column:
    """A candidate's own subject score, or, where routing left it open (0.5), what its stored subject says."""
    return F.when(F.abs(row_score - 0.5) > 1e-9, clamp(row_score)).otherwise(F.coalesce(stored, F.lit(0.5)))


def rescored(candidates: DataFrame, scorer, query: str = "query", text: str = "text") -> DataFrame:
    """``candidates`` with rerank_raw: what a re-ranker says of each (query, text) pair, batch by batch. Without a re-ranker (None) it is null.

    ``scorer`` is a function from two lists of strings to a list of numbers; it is sent to the workers.
    """
    if scorer is None:
        return candidates.withColumn("rerank_raw", F.lit(None).cast("double"))

    @F.pandas_udf("double")
    def said(queries: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series(scorer(queries.fillna("").tolist(), texts.fillna("").tolist()), dtype="float64")

    return candidates.withColumn("rerank_raw", said(c(query), c(text)))


def noise_reason(s: Settings = DEFAULT) -> Column:
    """Why a candidate is rejected, the first rule that holds; null if none does or the query has no terms."""
    words, rerank = F.greatest("lexical", "overlap", "phrase"), F.coalesce("rerank", F.lit(0.0))
    weak_dense, weak_rerank = c("dense") < s.extreme_dense, rerank < s.extreme_rerank
    poor, gated = c("final") < s.min_score, c("document") < s.document_gate
    rules = (
        ("out_of_domain_low_evidence", c("unknown_subject") & (c("n_terms") >= 3) & (c("overlap") < 0.34) & (c("phrase") < 0.2) & (c("anchor") < 0.34) & (c("topic") < 0.34)),
        ("subject_mismatch", (c("subject_confidence") >= s.subject_sure) & (c("subject") <= s.subject_mismatch)),
        ("wrong_entity_modifier", c("wrong_modifier") & poor),
        ("table_of_contents", c("is_toc") & poor),
        ("missing_required_modifier", c("hard_missing") & (c("phrase") <= 0.2)),
        ("low_document_score", gated & (words <= 0) & weak_rerank),
        ("missing_required_modifier", c("missing_phrase") & (c("phrase") <= 0.2) & (c("topic") <= 0) & weak_dense & weak_rerank),
        ("low_phrase_match", c("has_phrases") & (c("phrase") <= 0) & (c("overlap") < 0.67) & ~(c("has_anchor") & c("has_topic") & (c("topic") > 0)) & weak_dense & weak_rerank),
        ("low_lexical_overlap", (c("n_terms") >= 3) & (c("overlap") < 0.34) & gated & weak_dense & weak_rerank),
        ("low_lexical_overlap", (words <= 0) & weak_dense),
        ("low_lexical_overlap", (c("overlap") <= s.min_overlap) & (c("lexical") <= 0.02) & (c("phrase") <= 0.02) & (c("dense") < s.dense_floor)),
        ("low_lexical_overlap", (c("overlap") == 0) & (c("lexical") == 0) & (c("phrase") == 0) & (c("dense") < s.dense_strict)),
        ("zero_final_score", c("final") <= 0),
    )
    return F.when(c("n_terms") > 0, F.coalesce(*(F.when(rule, F.lit(reason)) for reason, rule in rules)))


def intent_score() -> Column:
    """The final score adjusted to what the query asks for and what kind of chunk it is.

    Needs final, query_type, chunk_type, alignment, entity (null if none required), full_phrase, title_prefix, required (null if no term is
    required), quality, too_short, low_quality, boundary, schema_phrase.
    """
    start = clamp(c("final"))
    entity = F.when(c("entity") <= 0, start * 0.5).when(c("entity") < 1, 0.15 * start * (1 - c("entity"))).otherwise(0.0)
    x = clamp(start + 0.14 * c("alignment") - F.coalesce(entity, F.lit(0.0)))
    reference = c("chunk_type").isin("schema_or_plan", "definition", "rule", "explanatory")
    boost = (F.lit(0.25) + F.when(c("title_prefix"), 0.15).otherwise(0.0) + F.when(reference, 0.10).otherwise(0.0)) * F.greatest(F.lit(0.0), 1 - x) * 1.2
    lacking = F.when(~(c("full_phrase") & reference) & (c("required") < 0.8), 0.30).otherwise(0.0)
    poor = F.least(F.lit(0.12), (1 - clamp(c("quality"))) * 0.07 + F.when(c("too_short"), 0.03).otherwise(0.0) + F.when(c("low_quality"), 0.02).otherwise(0.0))
    kind = F.when(c("chunk_type") == "exercise", 0.25).when(c("chunk_type") == "test_question", 0.35).otherwise(0.0)
    concept = F.greatest(F.lit(0.0), F.least(F.lit(0.99), x + F.when(c("full_phrase"), boost).otherwise(0.0) - poor - lacking - c("boundary") - kind))
    asks, enough = c("query_type").isin("rule_lookup", "explanation", "definition"), F.coalesce(c("required") >= 0.8, F.lit(True))
    factor = F.when(asks & (c("chunk_type") == "schema_or_plan"), F.when(enough & c("schema_phrase"), 1.25).otherwise(1.0))
    factor = factor.when(asks & reference, F.when(enough, 1.15).otherwise(1.0)).when(asks & (c("chunk_type") == "exercise"), 0.55).when(asks & (c("chunk_type") == "test_question"), 0.35)
    factor = factor.when(c("query_type").isin("exercise_lookup", "problem_solving") & c("chunk_type").isin("exercise", "test_question"), 1.35)
    return F.when(c("query_type") == "concept_lookup", concept).otherwise(clamp(x * factor.otherwise(1.0)))


def adaptive(hits: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Hits without the tail: far below the best, or below a gap. At most two hits all stay; anchors (a boolean column) always do.

    Where a fragment_id comes twice with the same score, an anchor goes first, so that what stays never hangs on the order of rows.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("final"), "fragment_id", F.desc("anchor_hit"))
    told = hits.withColumn("_n", F.count("*").over(Window.partitionBy("query_id"))).withColumn("_top", F.first("final").over(order)).withColumn("_before", F.lag("final").over(order))
    tail = (c("final") < s.adaptive_floor * c("_top")) | ((c("_before") - c("final") >= s.adaptive_gap) & (c("final") < 0.75 * c("_top")))
    return told.where((c("_n") <= 2) | c("_before").isNull() | c("anchor_hit") | ~tail).drop("_n", "_top", "_before")


def mmr(hits: DataFrame, k: int, s: Settings = DEFAULT) -> DataFrame:
    """The k hits of each query that are good and unlike each other, with their rank.

    A greedy choice over a query's pool, which the stages before bound by ``Settings.pool``; needs final, overlap and forms (array of strings).
    """
    schema = hits.withColumn("rank", F.lit(0)).schema

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["final", "fragment_id"], ascending=[False, True], ignore_index=True)
        sets, score, bonus = [set(f) for f in rows["forms"]], rows["final"].tolist(), rows["overlap"].tolist()
        chosen, near = [], [0.0] * len(rows)
        while len(chosen) < min(k, len(rows)):
            best, value = -1, -1.0
            for i in range(len(rows)):
                if i not in chosen:
                    v = score[i] if not chosen else (0.5 * score[i] if near[i] >= s.mmr_similar else s.mmr_lambda * score[i] - (1 - s.mmr_lambda) * near[i]) + 0.02 * bonus[i]
                    if v > value:
                        best, value = i, v
            chosen.append(best)
            near = [max(n, len(a & sets[best]) / len(a | sets[best]) if a and sets[best] else 0.0) for n, a in zip(near, sets)]
        return rows.iloc[chosen].assign(rank=range(1, len(chosen) + 1)).astype({"rank": "int32"})

    return hits.groupBy("query_id").applyInPandas(choose, schema)


def context_window(fragments: DataFrame, doc: str, index: str, scope: str, text: str, n: int = DEFAULT.neighbours, size: int = DEFAULT.context_chars) -> DataFrame:
    """Each fragment with its neighbours: those of its own scope if there are two or more, else all, joined and cut at a word."""
    w = Window.partitionBy(doc).orderBy(index).rowsBetween(-n, n)
    near = fragments.withColumn("near", F.collect_list(F.struct(F.col(index).alias("i"), F.col(scope).alias("s"), F.col(text).alias("t"))).over(w))
    same = F.filter("near", lambda x: x["s"].eqNullSafe(F.col(scope)))
    used = F.when(F.size(same) >= 2, same).otherwise(F.col("near"))
    joined = F.array_join(F.transform(used, lambda x: x["t"]), " ")
    return near.withColumn("context_size", F.size(used)).withColumn("context", cut_at_word(joined, size)).drop("near")


def answers(hits: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(query_id, answer, sources) from ranked hits with snippet and source: the first three snippets, numbered."""
    numbered = hits.where(c("rank") <= s.final).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "snippet", "source"))).alias("h"))
    lines = F.transform(F.slice("h", 1, 3), lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["snippet"]))
    sources = F.array_join(F.transform("h", lambda x: F.concat(x["rank"].cast("string"), F.lit(":"), x["source"])), ",")
    return numbered.select("query_id", F.concat(F.lit("Found in the sources:\n"), F.array_join(lines, "\n")).alias("answer"), sources.alias("sources"))
