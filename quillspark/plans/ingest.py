"""Ingestion from end to end: files to elements, chunks, types, sub-chunks and vectors, and the tables they are stored in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.config import DEFAULT, Settings
from quillspark.functions import text as tx
from quillspark.operators import chunking, classify, profiles
from quillspark.sources import files, store
from quillspark.sources.embed import Embedder, embedded, with_embedding
from quillspark.sources.scratch import written

c = F.col


def parsed(spark: SparkSession, found: DataFrame, artifacts: DataFrame | None = None) -> DataFrame:
    """(source, element_index, type, content, page, mode) of scanned files.

    Text and markdown are read as they are (mode fallback). For other files ``artifacts`` (source, path, content: what ``files.preferred_artifacts`` chose of a
    layout parser's or an OCR's output, with ``source`` the path of the file it is of) has their elements (mode parser); files without any have no rows.
    """
    own = files.text_elements(found).withColumn("mode", F.lit("fallback"))
    if artifacts is None:
        return own
    kind = "array<struct<type:string,content:string,text:string,page:int,page_idx:int>>"
    listed = F.coalesce(F.from_json(F.get_json_object("content", "$.elements"), kind), F.from_json("content", kind))
    plain = F.array(F.struct(F.lit("text").alias("type"), files.normalized_text(c("content")).alias("content"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("page_idx")))
    each = artifacts.select("source", F.posexplode(F.coalesce(F.when(c("path").endswith(".json"), listed), plain)).alias("element_index", "e")).select("source", "element_index", "e.*")
    each = each.withColumn("page", F.coalesce("page", c("page_idx") + 1))
    return own.unionByName(chunking.normalize_elements(each).select("source", "element_index", "type", "content", "page", F.lit("parser").alias("mode")))


def preview(elements: DataFrame, limit: int = 5) -> tuple[int, DataFrame]:
    """How many elements there are, and the beginnings of the first ones."""
    return elements.count(), elements.orderBy("source", "element_index").limit(limit).select("source", "element_index", "type", F.substring("content", 1, 300).alias("preview"))


def fragments_of(elements: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(fragment_id, source, element_index, text, heading_path, chunk_type, ...): elements coalesced, cut into chunks and classified."""
    joined = chunking.coalesce_elements(elements.select(c("source").alias("doc_id"), c("element_index").cast("long").alias("element_index"), "type", "content", c("page").cast("long").alias("page")), settings=settings)
    # an element's chunks are numbered after it, so that ids are stable when others change
    keyed = joined.select(F.struct("doc_id", "element_index", "page").alias("k"), c("content").alias("text"))
    cut = chunking.chunks(keyed, "k", "text", settings).select("k.doc_id", "k.page", (c("k.element_index") * 10_000 + c("chunk_index")).alias("element_index"), "text", "heading_path")
    told = classify.classified(cut, "text", "page")
    return told.select(tx.fragment_id(c("doc_id"), c("element_index"), c("text")).alias("fragment_id"), c("doc_id").alias("source"), *(x for x in told.columns if x != "doc_id"), chunking.snippet(c("text")).alias("snippet"))


def ingest(spark: SparkSession, root: str, collection: str, embedder: Embedder, out: str, artifacts: DataFrame | None = None, reindex: bool = True, settings: Settings = DEFAULT) -> dict[str, int]:
    """Read the files under ``root`` into the tables documents, fragments and vectors under ``out``, and say how many of each there are of them.

    With ``reindex`` the fragments and vectors of files that were there before go; without, only new fragments are added. The tables are written to
    new places (``out``/name/run number) and ``out``/current names the last complete run, so that readers never see half of one.
    """
    elements = written(parsed(spark, files.scan(spark, root), artifacts), "elements")
    fresh = written(fragments_of(elements, settings).withColumn("collection", F.lit(collection)), "fragments")
    profiled = embedded(profiles.document_profiles(elements), "profile_text", embedder, "summary_embedding")
    mode = elements.groupBy("source").agg(F.max("mode").alias("parse_mode"))
    meta = with_embedding(F.struct("parse_mode", "doc_type", "language", "grade", "keywords"), c("summary_embedding"), embedder.fingerprint)
    documents = profiled.join(mode, "source").select(F.substring(F.sha2(F.concat_ws("|", F.lit(collection), "source"), 256), 1, 32).alias("doc_id"), c("source").alias("source_uri"), F.regexp_extract("source", "[^/]*$", 0).alias("title"), F.lit(collection).alias("collection"), meta.alias("meta"))
    parts = fresh.select("fragment_id", "source", F.explode(chunking.subchunks(c("text"), settings.chunk_size, settings.chunk_overlap)).alias("w"))
    vectors = embedded(parts.select("fragment_id", "source", c("w.index").alias("subchunk_index"), c("w.text").alias("text")), "text", embedder).drop("text")
    before = current(spark, out)
    tables = {"documents": documents, "fragments": fresh, "vectors": vectors}
    if before:
        sources, known = fresh.select("source").distinct(), before["fragments"].select("fragment_id")
        for name in ("fragments", "vectors"):
            tables[name] = before[name].join(sources, "source", "left_anti").unionByName(tables[name]) if reindex else before[name].unionByName(tables[name].join(known, "fragment_id", "left_anti"))
        tables["documents"] = store.upsert(before["documents"], documents, ["collection", "source_uri"], c("doc_id"))
    run = _run(spark, out) + 1
    for name, df in tables.items():
        df.write.parquet(f"{out}/{name}/{run}")
    spark.createDataFrame([(run,)], "run int").write.mode("append").json(f"{out}/current")
    return {"documents": documents.count(), "fragments": fresh.count(), "vectors": parts.count()}


def _run(spark: SparkSession, out: str) -> int:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/current")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return 0
    return spark.read.schema("run int").json(f"{out}/current").agg(F.max("run")).first()[0] or 0


def current(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The tables of the last complete run; none before the first."""
    run = _run(spark, out)
    return {name: spark.read.parquet(f"{out}/{name}/{run}") for name in ("documents", "fragments", "vectors")} if run else {}


def deleted(tables: dict[str, DataFrame], source: str) -> dict[str, DataFrame]:
    """The tables without a source: its fragments and vectors go with the document."""
    return {name: df.where(c("source_uri" if name == "documents" else "source") != source) for name, df in tables.items()}
