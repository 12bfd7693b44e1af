"""Tables of documents, fragments and vectors on Parquet: upserts, inserts, re-embedding and its checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same keys; of repeated new keys the first by ``order``."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")
    return old.join(first.select(*keys), keys, "left_anti").unionByName(first)


def insert_absent(target: DataFrame, rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The rows to append: the first by ``order`` of each key that ``target`` doesn't have."""
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
    return first.join(target.select(key), key, "left_anti")


def sources(documents: DataFrame, collection: str | None = None) -> DataFrame:
    """The sources of a collection with their titles, in order."""
    own = documents if collection is None else documents.where(F.col("collection") == collection)
    return own.select("source_uri", "title").distinct().orderBy("source_uri", "title")


def compatibility(documents: DataFrame, vectors: DataFrame, fingerprint: str, samples: int = 20) -> DataFrame:
    """(documents, mismatched, examples): documents that have vectors and another fingerprint (null is another)."""
    held = documents.join(vectors.select("doc_id"), "doc_id", "left_semi")
    other = ~F.col("fingerprint").eqNullSafe(F.lit(fingerprint))
    first = held.where(other).orderBy("doc_id").limit(samples).agg(F.array_join(F.sort_array(F.collect_list("doc_id")).cast("array<string>"), ",").alias("examples"))
    return held.agg(F.count("*").alias("documents"), F.count_if(other).alias("mismatched")).crossJoin(first)


def swap_check(before: DataFrame, after: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(expected, updated, right_size, ok): whether every vector was replaced by one of the right size."""
    both = before.select(key).join(after.select(key, F.size(vector).alias("_d")), key, "left")
    told = both.agg(F.count("*").alias("expected"), F.count("_d").alias("updated"), F.count_if(F.col("_d") == dim).alias("right_size"))
    return told.withColumn("ok", (F.col("expected") == F.col("updated")) & (F.col("expected") == F.col("right_size")))


def reembed(vectors: DataFrame, encoded: DataFrame, key: str, vector: str, dim: int, path: str) -> DataFrame:
    """Write ``vectors`` with the encoded ones to a new place, check it, and return what is there; the old table stays as the backup."""
    fresh = vectors.join(encoded.select(key, F.col(vector).alias("_new")), key, "left")
    fresh.withColumn(vector, F.coalesce("_new", vector)).drop("_new").write.mode("errorifexists").parquet(path)
    back = vectors.sparkSession.read.parquet(path)
    told = swap_check(vectors, back, key, vector, dim).first()
    if not told.ok:
        raise ValueError(f"{told.expected} vectors, {told.updated} written, {told.right_size} of the right size")
    return back


def backed_up(vectors: DataFrame, key: str, vector: str, path: str) -> DataFrame:
    """A copy of the vectors by their keys at a new place, checked by its rows and a checksum over keys and vectors; what ``restore`` takes."""
    own = vectors.select(key, vector)
    own.write.mode("errorifexists").parquet(path)
    back = vectors.sparkSession.read.parquet(path)
    told = [df.agg(F.count("*"), F.sum(F.xxhash64(key, vector).cast("decimal(38,0)"))).first() for df in (own, back)]
    if told[0] != told[1]:
        raise ValueError(f"{told[0][0]} vectors, {told[1][0]} in the backup, or others")
    return back


def restore(current: DataFrame, backup: DataFrame, key: str, vector: str) -> DataFrame:
    """``current`` with the backup's vectors where there are any."""
    old = backup.select(key, F.col(vector).alias("_old"))
    return current.join(old, key, "left").withColumn(vector, F.coalesce("_old", vector)).drop("_old")


def hash_vector(text: str, dim: int) -> list[float]:
    """A vector that stands in where there is no model: uniform numbers seeded by the text's hash."""
    import hashlib
    import random

    rng = random.Random(int(hashlib.sha256(text.encode()).hexdigest(), 16) % 2**32)
    return [rng.uniform(-1.0, 1.0) for _ in range(dim)]


def embed_hashed(rows: DataFrame, text: str, dim: int) -> DataFrame:
    """``rows`` with an ``embedding`` by ``hash_vector``, batch by batch."""

    @F.pandas_udf("array<double>")
    def vectors(texts):
        return texts.fillna("").map(lambda t: hash_vector(t, dim))

    return rows.withColumn("embedding", vectors(text))
