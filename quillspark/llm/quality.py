"""Quality rules: statistics of each document, and lines that too many documents of a host share.

All of it is DataFrame expressions. Arrays of words stay inside a row, so that statistics need no shuffle. Only (host, line
hash) rows are shuffled for the line frequencies. Different documents of a host are counted for each line: copies are one document, and near copies,
which share all but a few of their words, are one document too, so that a group of copies doesn't make its own lines frequent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import SPACES, boxed, materialize, text_or_empty

#: A line is removed when more otherwise different documents of its host have it.
LINE_LIMIT = 20
#: A document is depleted when removed lines hold more than this percentage of its words.
DEPLETED = 80
#: Documents that share all but one in so many of their words have a similarity of 0.8 or more, as near copies do.
OWN_SHARE = 9
MIN_WORDS, MAX_REPEATED = 20, 30
WINDOW = 8
_SYMBOLS = "[#*$%&|<>]"


def bind(value: Column, f) -> Column:
    """f(value) with ``value`` evaluated once, also where f uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), f), 1)


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACES}]+"))


def repeated_words(own: Column) -> Column:
    """How many of the words stand in a window of WINDOW words that occurs twice or more."""

    def windows(h):
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))

    def covered(found):
        ordered = F.array_sort(F.arrays_zip(found.alias("h"), F.sequence(F.lit(0), F.size(found) - 1).alias("p")))

        def starts(s):
            same = lambda i, k: F.coalesce(F.get(s, i)["h"] == F.get(s, i + k)["h"], F.lit(False))
            hit = F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.when((i > 0) & same(i, -1) | same(i, 1), F.get(s, i)["p"]))
            return F.array_sort(F.filter(hit, lambda p: p.isNotNull()))

        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda acc, p: F.struct((p + WINDOW).alias("end"), (acc["n"] + p + WINDOW - F.greatest(acc["end"], p)).alias("n"))
        return F.aggregate(bind(ordered, starts), zero, step, lambda acc: acc["n"])

    counted = lambda found: F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(covered(found))
    return F.when(F.size(own) < WINDOW, F.lit(0)).otherwise(bind(bind(F.transform(own, lambda w: F.xxhash64(w)), windows), counted))


def lines(text: Column) -> Column:
    """The lines that have a word, as they stand."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACES}]"))


def line_hash(line: Column) -> Column:
    """The hash of a line, white space collapsed and in lower case."""
    return F.substring(F.md5(F.lower(F.regexp_replace(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), f"[{SPACES}]+", " "))), 1, 16)


def statistics(docs: DataFrame, text_col: str = "text") -> list[Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of ``text_col`` (null: no text)."""
    text = text_or_empty(text_col)
    return [
        bind(words(text), lambda own: F.struct(F.size(own).cast("long").alias("n_words"), F.length(F.array_join(own, "")).cast("long").alias("word_chars"), repeated_words(own).cast("long").alias("n_repeat_words"))).alias("_w"),
        F.regexp_count(text, F.lit(_SYMBOLS)).cast("long").alias("n_symbols"),
        bind(lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ]


def frequent_lines(rows: DataFrame, line_limit: int = LINE_LIMIT) -> DataFrame:
    """(host, h): the lines that more than ``line_limit`` different documents of their host have. ``rows`` has host, hash (of the text), lines.

    Exact copies are one document. Of a document, lines that at most ``line_limit`` texts of the host have are its own; it is told from others by the
    smallest hash of these, or, if they hold no more than one in OWN_SHARE of its words (a near copy), by the rarest line that it shares.
    """
    each = rows.select("host", "hash", F.explode("lines").alias("x")).select("host", "hash", "x.h", "x.n")
    shared = each.select("host", "h", "hash").distinct().groupBy("host", "h").agg(F.count("*").alias("docs")).where(f"docs > {line_limit}")
    shared, _ = materialize(shared, "shared")
    own = F.col("docs").isNull()
    found = each.join(shared, ["host", "h"], "left").groupBy("host", "hash").agg(
        (OWN_SHARE * F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)) > F.sum("n")).alias("differs"),
        F.min(F.when(own, F.col("h"))).alias("own"),
        F.min(F.when(~own, F.concat(F.lpad(F.col("docs").cast("string"), 20, "0"), "h"))).alias("rarest"),
    )
    signs = found.where("rarest IS NOT NULL").select("host", "hash", "differs", F.when(F.col("differs"), F.col("own")).otherwise(F.col("rarest")).alias("sign"))
    hits = each.join(shared, ["host", "h"]).select("host", "h", "hash").distinct().join(signs, ["host", "hash"])
    return hits.select("host", "h", "differs", "sign").distinct().groupBy("host", "h").count().where(f"count > {line_limit}").select("host", "h")


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", line_limit: int = LINE_LIMIT) -> DataFrame:
    """(id, hash, host, alike, the statistics, removed_words, removed, base_failed, kept): one row for the rows of ``docs`` that are alike in id, text and host.

    ``alike`` says how many they are, ``removed`` has the hashes of the lines to be taken out (null if none). Null texts have no words and fail; null hosts are
    one host, the same as an empty name; rows that repeat an id are judged each by its own text; very long texts are judged whole; ties have no part in it. An
    empty table gives an empty result; other columns, whatever their names, are ignored.
    """
    hashed = lambda x: F.struct(line_hash(x).alias("h"), F.size(words(x)).alias("n"))
    text = text_or_empty(text_col)
    host = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), host.alias("host"), *statistics(docs, text_col), F.transform(lines(text), hashed).alias("lines"))
    rows, path = materialize(rows.select("id", "hash", "host", "_w.*", "n_symbols", "n_dup_lines", "lines"), "quality")
    frequent, _ = materialize(frequent_lines(rows, line_limit), "frequent")
    each = rows.select("id", "hash", "host", F.explode("lines").alias("x")).select("id", "hash", "host", "x.h", "x.n")
    removed = each.join(frequent, ["host", "h"]).groupBy("id", "hash", "host", "h").agg(F.sum("n").alias("n")).groupBy("id", "hash", "host").agg(F.sum("n").alias("n"), F.collect_list("h").alias("removed"))
    removed, _ = materialize(removed.select(F.col("id").alias("r_id"), F.col("hash").alias("r_hash"), F.col("host").alias("r_host"), "n", "removed"), "removed")
    # rows that are alike were summed together: each of them has its share
    alike = rows.groupBy("id", "hash", "host").agg(F.count("*").alias("alike"), *(F.min(c).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")))
    on = F.col("id").eqNullSafe(F.col("r_id")) & (F.col("hash") == F.col("r_hash")) & (F.col("host") == F.col("r_host"))
    out = alike.join(removed, on, "left").withColumn("removed_words", F.coalesce(F.col("n") / F.col("alike"), F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & (100 * F.col("removed_words") <= DEPLETED * F.col("n_words")))
    return out.drop("n", "r_id", "r_hash", "r_host")


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words, kept): one row for each row of ``docs``."""
    found = verdicts(docs, id_col, text_col, host_col).withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("alike").cast("int"))))
    return found.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept")


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` without the rejected rows and without the lines that are too frequent in their host; ``chars_col``, if there is one, follows the text.

    Nulls, repeats, long texts and empty tables are treated as ``verdicts`` says; columns of any names are passed on.
    """
    found = verdicts(docs, id_col, text_col, host_col).where("NOT kept OR removed IS NOT NULL")
    # only the rows that go or change are joined: the documents move in a shuffle only if these are many
    judged, _ = materialize(found.select(F.col("id").alias("k_id"), F.col("hash").alias("k_hash"), F.col("host").alias("k_host"), "kept", "removed"), "judged")
    keyed = boxed(docs, id=F.col(id_col), hash=F.xxhash64(text_or_empty(text_col)), host=F.coalesce(F.col(host_col).cast("string"), F.lit("")))
    on = F.col("id").eqNullSafe(F.col("k_id")) & (F.col("hash") == F.col("k_hash")) & (F.col("host") == F.col("k_host"))
    left = keyed.join(judged, on, "left").where("kept IS NULL OR kept")
    text, whole = F.col("row").getField(text_col), F.col("removed").isNull()
    rest = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~(x.rlike(f"[^{SPACES}]") & F.array_contains("removed", line_hash(x)))), "\n")
    left = left.withColumn("new", F.when(whole, text).otherwise(rest))
    own = {text_col: F.col("new")}
    if chars_col in docs.columns:
        own[chars_col] = F.when(whole, F.col("row").getField(chars_col)).otherwise(F.length("new").cast(docs.schema[chars_col].dataType))
    return left.select(*(own.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


_WORD = r"[^\x20\x09-\x0D]"
_BASE = rf"""
d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_WORD}+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM d),
g AS (SELECT doc_id, unnest(range(1, len(words) - {WINDOW - 2})) AS i, words FROM w WHERE len(words) >= {WINDOW}),
g8 AS (SELECT doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS s FROM g),
hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g8) WHERE c > 1),
rep AS (SELECT doc_id, sum(least({WINDOW}, coalesce(i - before, {WINDOW}))) AS n FROM hit GROUP BY doc_id),
e AS (SELECT doc_id, host, substr(md5(lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g')))), 1, 16) AS h, len(regexp_extract_all(x, '{_WORD}+')) AS n FROM (SELECT doc_id, host, unnest(ls) AS x FROM w)),
x AS (SELECT doc_id, md5(t) AS th FROM w),
l AS (SELECT doc_id, e.host, th, h, n FROM e JOIN x USING (doc_id)),
once AS (SELECT DISTINCT host, th, h FROM l),
sh AS (SELECT host, h, count(*) AS docs FROM once GROUP BY ALL HAVING count(*) > {LINE_LIMIT}),
found AS (SELECT host, th, {OWN_SHARE} * coalesce(sum(n) FILTER (docs IS NULL), 0) > sum(n) AS differs, min(h) FILTER (docs IS NULL) AS own, min(lpad(CAST(docs AS VARCHAR), 20, '0') || h) FILTER (docs IS NOT NULL) AS rarest
  FROM l LEFT JOIN sh USING (host, h) GROUP BY host, th),
s AS (SELECT host, th, differs, CASE WHEN differs THEN own ELSE rarest END AS sign FROM found WHERE rarest IS NOT NULL),
f AS (SELECT host, h FROM (SELECT DISTINCT host, h, differs, sign FROM once JOIN sh USING (host, h) JOIN s USING (host, th)) GROUP BY host, h HAVING count(*) > {LINE_LIMIT}),
gone AS (SELECT doc_id, sum(n) AS n FROM e SEMI JOIN f USING (host, h) GROUP BY doc_id),
r AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '{_SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS removed_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))"""

SQL = f"""WITH {_BASE}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed, removed_words,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AND 100 * removed_words <= {DEPLETED} * n_words AS kept
FROM r"""
