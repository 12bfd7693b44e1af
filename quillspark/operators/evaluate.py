"""How good ranked results are: by labelled items, by evidence, by category, and how long they took."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, ndcg, mrr) at k for every query with relevant items.

    ``ranked`` has query_id, item, rank; ``relevant`` query_id, item, gain. The ideal order is cut at k as well.
    """
    ideal = relevant.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain"), "item")))
    worth = lambda gain, rank: (F.pow(F.lit(2.0), gain) - 1) / F.log2(rank + 1.0)
    ideal = ideal.groupBy("query_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("r") <= k, worth(F.col("gain"), F.col("r"))).otherwise(0.0)).alias("best"))
    hits = ranked.where(F.col("rank") <= k).join(relevant, ["query_id", "item"]).groupBy("query_id")
    hits = hits.agg(F.count("*").alias("found"), F.sum(worth(F.col("gain"), F.col("rank"))).alias("dcg"), F.min("rank").alias("first"))
    out = ideal.join(hits, "query_id", "left")
    ndcg = F.when(F.col("best") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("best")).otherwise(0.0)
    return out.select("query_id", (F.coalesce("found", F.lit(0)) / F.col("n")).alias("recall"), ndcg.alias("ndcg"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"))


def summary(results: DataFrame, by: str | None = None) -> DataFrame:
    """Means over positive queries, abstention over negative ones; null where there are none. With ``by`` also one row for each category.

    ``results`` has is_negative, n_hits, recall, ndcg, mrr; the overall row has a null category.
    """
    positive = lambda c: F.avg(F.when(~F.col("is_negative"), F.col(c))).alias(c)
    measures = [
        F.count("*").alias("n"),
        F.count_if("is_negative").alias("n_negative"),
        *map(positive, ("recall", "ndcg", "mrr")),
        F.avg(F.when(F.col("is_negative"), (F.col("n_hits") == 0).cast("double"))).alias("abstention"),
    ]
    return results.rollup(by).agg(*measures) if by else results.agg(*measures)


def matches_evidence(fragments: Column, pages: Column, terms: Column) -> Column:
    """Whether one fragment is on an expected page and has all expected terms (no pages or no terms: any; neither: no evidence)."""
    right_page = lambda f: (F.size(pages) == 0) | F.coalesce(F.array_contains(pages, f["page"]), F.lit(False))
    asked = (F.size(pages) > 0) | (F.size(terms) > 0)
    return asked & F.exists(fragments, lambda f: right_page(f) & F.forall(terms, lambda t: F.contains(F.lower(f["text"]), F.lower(t))))


def evidence_metrics(hits: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, ndcg, mrr, top1_source) at k from ranked hits with evidence and right_source (booleans): the first evidence counts."""
    first = F.min(F.when(F.col("evidence") & (F.col("rank") <= k), F.col("rank")))
    told = hits.groupBy("query_id").agg(first.alias("first"), F.coalesce(F.bool_or(F.col("right_source") & (F.col("rank") == 1)), F.lit(False)).alias("top1_source"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return told.select("query_id", F.col("first").isNotNull().cast("double").alias("recall"), zero(1 / F.log2(F.col("first") + 1.0)).alias("ndcg"), zero(1.0 / F.col("first")).alias("mrr"), "top1_source")


def nearest_rank(column: str, p: float) -> Column:
    """The value at place ceil(p * n), which is what a discrete percentile is."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")


def nearest_ranks(rows: DataFrame, by: list[str], value: str, places: dict[str, float]) -> DataFrame:
    """(by, one column for each of ``places``): the same over large groups. Equal values are counted before the shuffle, and no group is held in a buffer."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    ordered = Window.partitionBy(*by).orderBy("v")
    seen = counts.withColumn("seen", F.sum("n").over(ordered)).withColumn("all", F.sum("n").over(Window.partitionBy(*by)))
    return seen.groupBy(*by).agg(*(F.min(F.when(F.col("seen") >= F.ceil(p * F.col("all") - 1e-9), F.col("v"))).alias(name) for name, p in places.items()), F.max("v").alias("worst"))


def grid(*axes: DataFrame) -> DataFrame:
    """All combinations of a few short lists of settings."""
    out = axes[0]
    for a in axes[1:]:
        out = out.crossJoin(a)
    return out


def warnings(terms: Column, forbidden: Column, text: Column, source: Column) -> Column:
    """What is suspicious about a hit: none of the expected terms, or a source it shouldn't come from."""
    low = F.lower(text)
    none = (F.size(terms) > 0) & ~F.exists(terms, lambda t: F.contains(low, F.lower(t)))
    bad = F.exists(forbidden, lambda t: F.contains(F.lower(source), F.lower(t)))
    return F.array_compact(F.array(F.when(none, F.lit("no_expected_terms")), F.when(bad, F.lit("forbidden_source_term"))))


def gate(metrics: DataFrame, least: dict[str, float], most: dict[str, float]) -> DataFrame:
    """One row for each threshold: metric, value, passed. A null value doesn't pass."""
    values = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.coalesce(F.col(m) >= v, F.lit(False)).alias("passed")) for m, v in least.items()]
    values += [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.coalesce(F.col(m) <= v, F.lit(False)).alias("passed")) for m, v in most.items()]
    return metrics.select(F.inline(F.array(*values)))
