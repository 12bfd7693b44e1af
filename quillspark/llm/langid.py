"""Language identification by Bayesian fusion of evidence.

What a text's characters say (trigram likelihoods, trained here on a bounded sample of labelled rows), what its markup
or record declares, the suffix of its address, and what its host usually has. How far declarations and suffixes can be trusted,
and the host priors, are counted over all rows by grouped aggregation; host priors are smoothed towards their suffix's and these towards the whole's.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import boxed, materialize, text_or_empty, tidy

#: Labelled rows that a language's model is trained on, at most, and characters of each.
TRAIN_ROWS, TRAIN_CHARS = 400, 4000
#: Languages told apart at most, the most frequent labels: a bound on the model's size. Rows that declare another are kept as what they declare.
LANGUAGES = 256
BUCKETS = 1 << 15
#: Trigrams that count in full: more of them add less and less, since they aren't independent.
FULL = 40
#: Pseudo-counts of a host's prior, of a suffix's, and of a reliability table.
HOST_WEIGHT, SUFFIX_WEIGHT, TABLE_WEIGHT = 20.0, 20.0, 1.0
#: Address suffixes with a reliability of their own, the most frequent; all others share one. There are fewer in use.
SUFFIXES = 4096
#: A row is rejected when no language reaches this posterior.
ACCEPT = 0.5
UNKNOWN = "und"
#: A host with more than one in HOT of all rows is hot: there are at most HOT of these, and their priors are broadcast.
HOT = 1000


@lru_cache(1)
def _letters() -> np.ndarray:
    """Lower-cased letters by code point; everything else is a space."""
    table = np.full(0x110000, 32, dtype=np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] in "LM":
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def trigrams(text: str, size: int = 1 << 20):
    """Bucket numbers of the trigrams of letters and single spaces, stretch by stretch; trigrams around a space between spaces are left out."""
    table = _letters()
    for at in range(0, max(1, len(text)), size):
        points = table[np.frombuffer(text[max(0, at - 2) : at + size].encode("utf-32-le"), dtype=np.uint32)].astype(np.uint64)
        if at == 0:
            points = np.concatenate([np.array([32], dtype=np.uint64), points])
        keep = np.ones(len(points), dtype=bool)
        keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
        p = points[keep]
        if len(p) >= 3:
            h = (p[:-2] * np.uint64(0x9E3779B1) ^ p[1:-1] * np.uint64(0x85EBCA77) ^ p[2:] * np.uint64(0xC2B2AE3D)) * np.uint64(0x9E3779B97F4A7C15)
            yield (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def train(rows: list[tuple[str, str]], languages: list[str]) -> np.ndarray:
    """Log probabilities by bucket and language; the last column stands for no language."""
    counts = np.zeros((BUCKETS, len(languages)))
    for label, text in rows:
        for h in trigrams(text):
            counts[:, languages.index(label)] += np.bincount(h, minlength=BUCKETS)
    table = np.log((counts + 0.1) / (counts.sum(axis=0) + 0.1 * BUCKETS))
    return np.concatenate([table, np.full((BUCKETS, 1), -np.log(BUCKETS))], axis=1).astype(np.float32)


def likelihoods(text: str, table: np.ndarray) -> list[float]:
    """Log likelihood for each language, with the weight of at most a few times FULL trigrams; all 0 without letters."""
    total, n = np.zeros(table.shape[1]), 0
    for h in trigrams(text):
        total += table[h].sum(axis=0, dtype=np.float64)
        n += len(h)
    return (total / (1 + n / FULL)).tolist()


def sampled(docs: DataFrame, label: str, text: str) -> tuple[list[tuple[str, str]], list[str]]:
    """A bounded sample of labelled rows, by the order of a hash, and the languages in it. Copies are one row.

    A row is drawn by its text's hash, with a chance that leaves rather more than TRAIN_ROWS texts of its label; of these the first by hash are taken.
    """
    counts = docs.where(F.col(label).isNotNull()).groupBy(label).agg(F.approx_count_distinct(F.xxhash64(text)).alias("n"), F.count("*").alias("rows"))
    number = {r[0]: max(1, r[1]) for r in counts.orderBy(F.desc("rows"), label).limit(LANGUAGES).collect()}
    if not number:
        return [], []
    whole = 1 << 30
    chance = F.create_map(*(F.lit(x) for l, n in number.items() for x in (l, min(whole, whole * 3 * TRAIN_ROWS // (2 * n)))))
    hashed = docs.where(F.col(label).isin(list(number))).select(F.col(label).alias("l"), F.xxhash64(text).alias("h"), F.substring(text, 1, TRAIN_CHARS).alias("t"))
    drawn = hashed.where(F.pmod("h", F.lit(whole)) < chance[F.col("l")]).groupBy("l", "h").agg(F.min("t").alias("t"))
    drawn = drawn.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h"))).where(f"r <= {TRAIN_ROWS}")
    rows = [(r.l, r.t) for r in sorted(drawn.collect(), key=lambda r: (r.l, r.h))]
    return rows, sorted({l for l, _ in rows})


def _log_table(rows, languages: list[str], values: list[str]) -> dict[str, list[float]]:
    """log P(value | language) for each value from (value, language, n) rows; values beyond the list share one cell."""
    counts = {v: np.full(len(languages), TABLE_WEIGHT) for v in [*values, None]}
    for value, language, n in rows:
        counts[value if value in counts else None][languages.index(language)] += n
    total = sum(counts.values())
    return {v: np.log(c / total).tolist() for v, c in counts.items()}


def identify(docs: DataFrame, keys: list[str], text: str = "text", declared: str | None = "lang", host: str | None = "source", suffix: str | None = None) -> DataFrame:
    """keys, lang, confidence, kept: one row for each row of ``docs``.

    ``declared``, ``host`` and ``suffix`` name columns with that evidence, or None. A null in one of them is no evidence. Texts that
    are null, empty or without letters, and texts that fit no language better than noise, are ``und`` and rejected (kept false); a text with letters that declares a
    language without a model is kept as that, with confidence 0. With no labelled rows at all everything is ``und``. Of languages that are equally likely the first
    by name is taken. Repeated and null keys keep their rows; very long texts are read whole; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    column = lambda c: (F.col(c) if c else F.lit(None)).cast("string")
    base = docs.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], text_or_empty(text).alias("_t"), column(declared).alias("_d"), column(host).alias("_h"), column(suffix).alias("_s"))
    rows, languages = sampled(base, "_d", "_t")
    own = [f"_k{i}" for i in range(len(keys))]
    if not languages:
        return docs.select(*keys, F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("confidence"), F.lit(False).alias("kept"))
    table, many = train(rows, languages), len(languages)
    schema = T.StructType([*(base.schema[c] for c in own), *(T.StructField(c, T.StringType()) for c in ("_d", "_h", "_s")), T.StructField("ll", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for b in batches:
            found = pa.array([likelihoods(t.as_py(), table) for t in b.column(len(own))], type=pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(own)], *b.columns[len(own) + 1 :], found], names=schema.names)

    told, _ = materialize(base.mapInArrow(tidy(run), schema), "langid")
    first = F.array_position(F.slice("ll", 1, many), F.array_max(F.slice("ll", 1, many))).cast("int")
    sure = told.withColumn("best", first).where(F.array_max(F.slice("ll", 1, many)) > F.get("ll", F.lit(many)))

    def reliability(c: str, most: int):
        n = sure.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(most)
        values = [r[0] for r in n.collect()]
        counted = sure.where(F.col(c).isin(values)).groupBy(c, "best").count().collect() if values else []
        return _log_table([(r[0], languages[r[1] - 1], r[2]) for r in counted], languages, values)

    def with_logs(rows: DataFrame, c: str, of: dict[str, list[float]], name: str) -> DataFrame:
        """``rows`` with the log table's row for column ``c``; the table has no more rows than the values that ``reliability`` lists."""
        known = spark.createDataFrame([(v, logs) for v, logs in of.items() if v is not None], f"{name}_v string, {name} array<double>")
        rest = F.when(F.col(c).isNull(), F.array_repeat(F.lit(0.0), many)).otherwise(F.array(*map(F.lit, of[None])))
        return rows.join(F.broadcast(known), F.col(c) == F.col(f"{name}_v"), "left").withColumn(name, F.coalesce(name, rest)).drop(f"{name}_v")

    by_declared = reliability("_d", LANGUAGES)
    by_suffix = reliability("_s", SUFFIXES) if suffix else {None: [0.0] * many}
    # priors: the whole, each suffix smoothed towards it, each host towards its suffix
    each = [F.count_if(F.col("best") == i + 1).cast("double").alias(f"n{i}") for i in range(many)]
    whole = sure.agg(*each).first()
    rows_known = float(sum(whole))
    whole = (np.array([whole[i] for i in range(many)]) + 1) / (sum(whole) + many)
    total = sum((F.col(f"n{j}") for j in range(many)), F.lit(0.0))
    smooth = lambda n, weight, parent: (F.col(n) + weight * parent) / (F.col("n") + weight)
    hosts = sure.where("_h IS NOT NULL").groupBy("_h").agg(F.max("_s").alias("_s"), *each).withColumn("n", total)
    if suffix:
        parents = sure.where("_s IS NOT NULL").groupBy("_s").agg(*each).withColumn("n", total).select("_s", *(smooth(f"n{i}", SUFFIX_WEIGHT, float(whole[i])).alias(f"p{i}") for i in range(many)))
        hosts = hosts.join(parents, "_s", "left")
        parent = [F.coalesce(f"p{i}", F.lit(float(whole[i]))) for i in range(many)]
    else:
        parent = [F.lit(float(p)) for p in whole]
    priors = hosts.select("_h", "n", F.array(*(F.log(smooth(f"n{i}", HOST_WEIGHT, parent[i])) for i in range(many))).alias("prior"))
    # a host may have a third of all rows: the priors of hot hosts, which are few by definition, are broadcast, and their rows stay where they are
    priors, _ = materialize(priors, "priors")
    hot = F.broadcast(priors.where(F.col("n") * HOT > rows_known).select("_h", "prior"))
    cold = priors.where(F.col("n") * HOT <= rows_known).select("_h", "prior")
    none = told.where(F.col("_h").isNull()).withColumn("prior", F.lit(None).cast("array<double>"))
    named = told.where(F.col("_h").isNotNull())
    known = named.join(hot, "_h").unionByName(named.join(hot, "_h", "left_anti").join(cold, "_h", "left")).unionByName(none)
    prior = F.coalesce("prior", F.array(*(F.lit(float(np.log(p))) for p in whole)))
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    known = with_logs(with_logs(known, "_d", by_declared, "said"), "_s", by_suffix, "placed").withColumn("prior", prior)
    score = plus(plus(plus(F.slice("ll", 1, many), F.col("prior")), F.col("said")), F.col("placed"))
    # no language competes by likelihood alone, at the price of the best language's other evidence
    noise = F.get("ll", F.lit(many)) + F.array_max(plus(F.col("prior"), F.col("said")))
    scored = known.withColumn("score", score).withColumn("noise", noise).withColumn("lettered", F.get("ll", F.lit(many)) != 0).withColumn("top", F.array_max("score"))
    total = F.aggregate("score", F.exp(F.least(F.col("noise") - F.col("top"), F.lit(300.0))), lambda a, x: a + F.exp(x - F.col("top")))
    sure_of = F.when(F.col("lettered"), F.round(1 / total, 6)).otherwise(0.0)
    name = F.get(F.array(*map(F.lit, languages)), F.array_position("score", F.col("top")).cast("int") - 1)
    out = scored.withColumn("confidence", sure_of)
    other = F.col("lettered") & F.col("_d").isNotNull() & ~F.col("_d").isin(languages)
    lang = F.when(other, F.col("_d")).when(F.col("confidence") >= ACCEPT, name).otherwise(UNKNOWN)
    sure_enough = F.when(other, 0.0).otherwise(F.col("confidence"))
    return out.select(*(F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)), lang.alias("lang"), sure_enough.alias("confidence"), (other | (F.col("confidence") >= ACCEPT)).alias("kept"))


_TAGS = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>|&[a-z]+;"


def evidence(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with text, declared, host and suffix read from markup and address; what is missing is null."""
    html, url = F.coalesce(F.col(html_col), F.lit("")), F.col(url_col)
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    filled = lambda c: F.when(c != "", c)
    declared = F.lower(F.regexp_extract(html, r"""(?i)<html[^>]*\slang\s*=\s*["']?([A-Za-z]{2,3})""", 1))
    code = F.lower(F.regexp_extract(url, r"^[^?#]*?://[^/?#]+/([A-Za-z]{2})(?:/|$)", 1))
    suffix = F.concat_ws("/", filled(F.regexp_extract(host, r"\.([a-z]+)$", 1)), filled(code))
    return pages.select("*", F.regexp_replace(html, _TAGS, " ").alias("_text"), filled(declared).alias("_declared"), filled(host).alias("_host"), filled(suffix).alias("_suffix"))


def identify_pages(pages: DataFrame, keys: list[str], url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``identify`` for web pages."""
    own = pages.select(F.struct(*keys).alias("k"), F.col(url_col).alias("u"), F.col(html_col).alias("m"))
    return identify(evidence(own, "u", "m"), ["k"], "_text", "_declared", "_host", "_suffix").select("k.*", "lang", "confidence", "kept")


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: str = "lang", host: str = "source") -> DataFrame:
    """``docs`` without the rejected rows; rows that are alike in id and text are judged alike. Columns of any names are passed on; for the rest see ``identify``."""
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("hash"), F.col(text_col).alias("t"), F.col(declared).alias("d"), F.col(host).alias("h"))
    bad = identify(own, ["id", "hash"], "t", "d", "h").where("NOT kept").select(F.col("id").alias("b_id"), F.col("hash").alias("b_hash")).distinct()
    bad, _ = materialize(bad, "rejected")
    keyed = boxed(docs, id=F.col(id_col), hash=F.xxhash64(text_or_empty(text_col)))
    return keyed.join(bad, F.col("id").eqNullSafe(F.col("b_id")) & (F.col("hash") == F.col("b_hash")), "left_anti").select("row.*")
