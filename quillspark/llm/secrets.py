"""Secrets in texts, with DataFrame functions only.

Each kind's matches are located by splitting a text at them: the lengths of gaps and matches, summed in order by a window, are positions.
Fixed kinds (always reported once their length check passes): assign, access, hex. Weak candidates (short assigned
values, mixed-character blobs, account names, endpoints) are linked with what complements them by an interval join: within SCOPE
code points a secret needs an identifier, an identifier a secret, and an endpoint both. The join goes through buckets that
hold only the smallest and largest start of each role, so that crowded texts make no pairs of all with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import boxed, materialize, text_or_empty
from quillspark.llm.quality import bind

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "short", "blob", "account", "endpoint")
#: Code points within which parts of one credential must start.
SCOPE = 400
#: Characters of an assigned value from which it is reported by itself, and from which it is a weak candidate.
VALUE, SHORT_VALUE = 12, 6

_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kind, pattern, and the group whose length counts.
PATTERNS = [
    ("assign", _ASSIGN, 2),
    ("access", r"AKIA[A-Z0-9]+", 0),
    ("hex", r"[0-9a-f]{16,}", 0),
    ("blob", r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}+={0,2}", 0),
    ("account", r"""(?<![A-Za-z0-9])(?i:client_id|account_id|access_key_id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", 0),
    ("endpoint", r"""(?i:https?|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[^\x00-\x20"'<>]+""", 0),
]


def _matches(text: Column, kind: str, pattern: str, group: int) -> Column:
    """Of every match, in order: the length of the gap before it, its own, and that of the group; blobs also need all three sorts of characters."""

    def parts(found):
        gaps = F.split(text, pattern, -1)
        groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found

        def each(gaps_):
            def one(groups_):
                def at(i):
                    size = F.length(F.get(groups_, i))
                    if kind == "blob":
                        m = F.get(found, i)
                        size = F.when(m.rlike("[A-Z]") & m.rlike("[a-z]") & m.rlike("[0-9]"), size).otherwise(0)
                    return F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(gaps_, i)).alias("gap"), F.length(F.get(found, i)).alias("size"), size.alias("value"))

                return F.transform(F.sequence(F.lit(0), F.size(found) - 1), at)

            return bind(groups, one)

        return F.when(F.size(found) > 0, bind(gaps, each))

    return bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), parts)


def _located(rows: DataFrame) -> DataFrame:
    """(uid, kind, start, end, value) of every match in ``parts``."""
    each = rows.select("uid", F.explode("parts").alias("p")).select("uid", "p.*")
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("uid", "kind").orderBy("i"))
    return each.withColumn("end", end.cast("int")).select("uid", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "value")


def _linked(found: DataFrame) -> DataFrame:
    """The strong parts, and the weak ones whose complements start within SCOPE."""
    kind = F.when((F.col("kind") == "assign") & (F.col("value") < VALUE), "short").otherwise(F.col("kind"))
    least = F.when(F.col("kind") == "short", SHORT_VALUE).when(F.col("kind") == "access", 18).when(F.col("kind") == "blob", 1).otherwise(0)
    parts = found.withColumn("kind", kind).where(F.col("value") >= least)
    role = F.when(F.col("kind").isin("access", "account"), "id").when(F.col("kind") == "endpoint", "place").otherwise("secret")
    parts = parts.withColumn("role", role).withColumn("bucket", F.floor(F.col("start") / SCOPE).cast("int"))
    sides = [f(F.when(F.col("role") == r, F.col("start"))).alias(f"{r}_{n}") for r in ("id", "secret") for n, f in (("min", F.min), ("max", F.max))]
    buckets = parts.where("role <> 'place'").groupBy("uid", "bucket").agg(*sides)
    weak = parts.where(~F.col("kind").isin(*BASE))
    tried = weak.withColumn("step", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("bucket", F.col("bucket") + F.col("step"))
    near = lambda r: F.when(F.col("step") == -1, F.col(f"{r}_max") >= F.col("start") - SCOPE).when(F.col("step") == 1, F.col(f"{r}_min") <= F.col("start") + SCOPE).otherwise(F.col(f"{r}_min").isNotNull())
    met = tried.join(buckets, ["uid", "bucket"]).groupBy("uid", "kind", "role", "start", "end").agg(F.coalesce(F.bool_or(near("id")), F.lit(False)).alias("has_id"), F.coalesce(F.bool_or(near("secret")), F.lit(False)).alias("has_secret"))
    complete = F.when(F.col("role") == "secret", F.col("has_id")).when(F.col("role") == "id", F.col("has_secret")).otherwise(F.col("has_id") & F.col("has_secret"))
    return parts.where(F.col("kind").isin(*BASE)).select("uid", "kind", "start", "end").unionByName(met.where(complete).select("uid", "kind", "start", "end"))


def _scanned(docs: DataFrame, keys: list[Column], text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows' keys with a uid, and the reported spans by uid; texts are read once and stay out of every shuffle."""
    text = text_or_empty(text_col)
    parts = F.flatten(F.array_compact(F.array(*(_matches(text, *p) for p in PATTERNS))))
    rows, _ = materialize(docs.select(*keys, F.monotonically_increasing_id().alias("uid"), parts.alias("parts")), "secrets")
    return rows, _linked(_located(rows.where(F.size("parts") > 0)))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans): one row for each row of ``docs``; spans by start and then kind, in code points, end exclusive.

    Null and empty texts have no spans; null and repeated ids keep their rows, each with the spans of its own text; very long texts are
    scanned whole; spans that start together are in the order of KINDS; other columns are ignored; an empty table gives an empty result.
    """
    rows, found = _scanned(docs, [F.col(id_col).alias("_id")], text_col)
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    listed = found.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("start", order.alias("order"), "kind", "end"))).alias("s"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    shaped = F.transform("s", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.select("_id", "uid").join(listed, "uid", "left").select(F.col("_id").alias(id_col), F.coalesce(shaped, none).alias("spans"))


def listed(column: str) -> Column:
    return F.concat_ws(",", F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_assign, n_access, n_hex, base_sha256, spans, n_all) from a table of spans; n_all counts all of them."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    own = found.withColumn("base", F.filter("spans", lambda s: s["kind"].isin(*BASE)))
    return own.select(id_col, *map(count, BASE), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"), F.size("spans").cast("long").alias("n_all"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported span replaced by ``mark`` (spans that overlap or touch by one); ``chars_col``, if there is one, follows the text.

    Only texts with a match of some pattern meet the spans in a join; the others, null and empty ones too, pass by unchanged. Rows that repeat id and text are
    alike and get the same text; very long texts are treated whole; columns of any names are passed on; an empty table gives an empty result.
    """
    any_match = text_or_empty(text_col).rlike("|".join(f"(?:{p})" for _, p, _ in PATTERNS))
    suspects = boxed(docs.where(any_match), id=F.col(id_col), hash=F.xxhash64(text_or_empty(text_col)), t=F.col(text_col).cast("string"))
    rows, found = _scanned(suspects, [F.col("id"), F.col("hash")], "t")
    before = Window.partitionBy("uid").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce((F.col("start") > F.max("end").over(before)).cast("int"), F.lit(1))
    run = F.sum("fresh").over(Window.partitionBy("uid").orderBy("start", "end"))
    merged = found.withColumn("fresh", fresh).withColumn("run", run).groupBy("uid", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cuts = merged.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    cuts = rows.join(cuts, "uid").groupBy("id", "hash").agg(F.min("cuts").alias("cuts")).select(F.col("id").alias("c_id"), F.col("hash").alias("c_hash"), "cuts")
    joined = suspects.join(cuts, F.col("id").eqNullSafe(F.col("c_id")) & (F.col("hash") == F.col("c_hash")), "left")
    gap = lambda i: F.substring(F.col("t"), F.coalesce(F.get("cuts", i - 1)["end"], F.lit(0)) + 1, F.coalesce(F.get("cuts", i)["start"], F.length("t")) - F.coalesce(F.get("cuts", i - 1)["end"], F.lit(0)))
    changed = joined.withColumn("new", F.when(F.col("cuts").isNull(), F.col("t")).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.size("cuts")), gap), mark)))
    own = {text_col: F.col("new")}
    if chars_col in docs.columns:
        own[chars_col] = F.when(F.col("cuts").isNull(), F.col("row").getField(chars_col)).otherwise(F.length("new").cast(docs.schema[chars_col].dataType))
    return docs.where(~any_match).unionByName(changed.select(*(own.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns)))
