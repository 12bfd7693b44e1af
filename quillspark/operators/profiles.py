"""Profiles of documents, titles of sections, and what is told of a candidate: subject, penalties, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark import fixed_values as fixed
from quillspark.config import DEFAULT, Settings
from quillspark.functions import text as tx
from quillspark.operators import classify
from quillspark.operators.recall import top

c = F.col

#: Kinds of chunk that are never an answer, and flags that metadata may keep for a chunk (fixed values).
HARD = ("navigation_index", "toc", "index", "bibliography")
HARD_FLAGS = ("is_toc", "is_index", "is_bibliography")
FLAGS = (*HARD_FLAGS, "is_caption", "is_fragmented", "is_too_short", "starts_mid_word", "low_text_quality")


def recall_terms(terms: Column, most: int = 8) -> Column:
    """The first query terms that are worth a lookup: with a digit, of three letters, or of two that are no Roman numeral."""
    worth = lambda t: t.rlike("[0-9]") | (F.length(t) >= 3) | ((F.length(t) == 2) & ~tx.is_roman(t))
    return F.slice(F.filter(terms, worth), 1, most)


def required_text(text: Column) -> Column:
    """Words only: lower case, soft hyphens dropped, words joined that a hyphen broke, everything else a single space."""
    low = F.translate(F.lower(F.coalesce(text, F.lit(""))), "ё­", "е")
    whole = F.regexp_replace(low, r"(?<=[\p{L}\p{N}_])-\s+(?=[\p{L}\p{N}_])", "")
    return F.trim(F.regexp_replace(whole, r"[^\p{L}\p{N}_]+", " "))


def domain(uri: Column) -> Column:
    """The host of an address, with or without a scheme; null if there is none."""
    full = F.when(F.contains(uri, F.lit("://")), uri).otherwise(F.concat(F.lit("https://"), uri))
    host = F.lower(F.regexp_extract(full, r"^[^:/?#]+://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def subject_score(subject: Column, detected: Column, s: Settings = DEFAULT) -> Column:
    """How a document's subject fits those found in the query (subject, confidence), the likeliest first; 0.5 where one side is unknown."""
    own = F.filter(detected, lambda d: d["subject"] == subject)
    first = lambda found: F.get(found, F.lit(0))["confidence"]
    unknown = (F.size(detected) == 0) | subject.isNull() | subject.isin("unknown", "")
    return F.when(unknown, 0.5).when(F.size(own) > 0, F.greatest(F.lit(0.8), first(own))).when(first(detected) >= s.subject_sure, 0.12).otherwise(0.35)


def lexical_scores(wanted: DataFrame, profile: DataFrame) -> DataFrame:
    """(query_id, source, lexical): the share of a query's terms of which a source's profile has the stem; sources that share none have no row.

    ``wanted`` has query_id and term, ``profile`` source and stem (distinct); an equi-join on the stem, counted map-side.
    """
    stems = wanted.select("query_id", tx.stem(c("term")).alias("stem"))
    many = wanted.groupBy("query_id").agg(F.count("*").alias("m"))
    hits = stems.join(profile, "stem").groupBy("query_id", "source").agg(F.count("*").alias("hits"))
    return hits.join(many, "query_id").select("query_id", "source", (c("hits") / c("m")).alias("lexical"))


def penalties(s: Settings = DEFAULT) -> Column:
    """The names of all penalties that hold for a scored candidate."""
    asks = c("query_type").isin("rule_lookup", "explanation", "definition", "concept_lookup")
    named = {
        "toc_penalty": c("is_toc"),
        "low_text_quality_penalty": c("low_quality"),
        "wrong_entity_modifier_penalty": c("wrong_modifier"),
        "missing_required_modifier_penalty": c("missing_phrase"),
        "exercise_intent_penalty": asks & (c("chunk_type") == "exercise"),
        "test_question_intent_penalty": asks & (c("chunk_type") == "test_question"),
        "required_term_penalty": (c("query_type") == "concept_lookup") & ~c("full_phrase") & (c("required") < 0.8),
        "missing_required_entity_penalty": c("entity") <= 0,
        "subject_mismatch_penalty": (c("subject_confidence") >= s.subject_sure) & (c("subject") <= s.subject_mismatch),
    }
    return F.array_compact(F.array(*(F.when(holds, F.lit(name)) for name, holds in named.items())))


def current_quality(now: Column, old: Column) -> Column:
    """What holds of a candidate, from its text just looked at (``now``) and its stored metadata (``old``, any field may be null).

    Both have chunk_type, quality_score and FLAGS, ``old`` also is_navigation_index. Stored flags add to those found, but a stored kind that
    is never an answer is stale where the text is clearly of another kind; its flags and score then don't count.
    """
    yes = lambda x: F.coalesce(x, F.lit(False))
    either = lambda of: yes(of["chunk_type"].isin(*HARD)) | F.greatest(*(yes(of[k]) for k in HARD_FLAGS))
    stale = (either(old) | yes(old["is_navigation_index"])) & ~either(now) & (now["chunk_type"] != "unknown")
    flags = {k: now[k] | (yes(old[k]) & (~stale if k in (*HARD_FLAGS, "low_text_quality") else F.lit(True))) for k in FLAGS}
    kind = F.when(now["chunk_type"].isin(*HARD) | stale, now["chunk_type"]).otherwise(F.coalesce(old["chunk_type"], now["chunk_type"]))
    score = F.when(stale, now["quality_score"]).otherwise(F.least(now["quality_score"], old["quality_score"]))
    score = F.when(flags["low_text_quality"], F.least(score, F.lit(0.25))).otherwise(score)
    index = (kind == "navigation_index") | (yes(old["is_navigation_index"]) & ~stale)
    return F.struct(kind.alias("chunk_type"), *(v.alias(k) for k, v in flags.items()), index.alias("is_navigation_index"), score.alias("quality_score"))


# --- titles ------------------------------------------------------------------------------------------------------------

_STEP = r"(?:[IVXLCDM]+|[1-9]\d*)\s*[.)]\s+"
_NO_TITLES = ("exercise", "test_question", "navigation_index", "toc", "index")


#: A title's longest length; what is longer is no title for this reason at the latest.
_LONGEST = 180


def _title_problems() -> tuple[Column, Column]:
    """Why a candidate is no title, the first reason that holds, null if it is one: by the columns of ``classify.worded``, up to its length, and by those of ``classify.prepared``."""
    flat, n = c("_flat"), F.size(F.split("_flat", " "))
    known = c("_norm").rlike(r"^(?:глава|раздел|параграф|урок|тема)\s+\S|(?<![а-я])(?:план|схема|алгоритм|формула|правило|теорема|закон)(?![а-я])")
    orders = c("_norm").rlike("(?<![а-я])(?:укажите|выберите|найдите|сравните|объясните|докажите)(?![а-я])")
    for command in fixed.EXERCISE_COMMANDS:
        orders = orders | F.contains("_s", F.lit(f" {classify.stem_of(command)} "))
    open_marks = F.regexp_count(flat, F.lit(r"\(")) > F.regexp_count(flat, F.lit(r"\)"))
    reasons = {
        "empty": flat == "",
        "numeric_or_punctuation": flat.rlike(r"^[\d\s.,;:()]+$"),
        "plan_step": flat.rlike(rf"(?i)^{_STEP}"),
        "numeric_plan_step": flat.rlike(r"^\d+(?:\s*[,;]\s*\d+)*\s*\.\s"),
        "test_question_label": flat.rlike(r"^[АAВB]\d{1,2}\s*[.)]\s") | classify._test_question(),
        "navigation_reference": classify._navigation_reference(),
        "cross_reference": c("_norm").rlike(r"(?<![а-я])п\.\s"),
        "unclosed_parenthetical": open_marks,
        "too_long": F.length(flat) > _LONGEST,
        "definition_like": flat.rlike(r"\s[—-]\s") & (n > 3),
        "too_many_words": (n > 7) & ~known,
        "instruction_like": orders,
        "sentence_like": flat.rlike("[.,;]$") & (n > 5),
        "too_short": (n <= 1) & (F.length(flat) <= 3),
        "navigation_index": classify._navigation_index() & ~flat.rlike(r"^.{4,120}?\s[1-9]\d{0,2}$"),
    }
    told, split = [F.when(holds, F.lit(reason)) for reason, holds in reasons.items()], list(reasons).index("too_long") + 1
    return F.coalesce(*told[:split]), F.coalesce(*told[split:])


def without_page_number(title: Column) -> Column:
    """A title without the page number at its end; numbers of chapters and years stay."""
    cut = F.btrim(F.regexp_extract(title, r"^(.{4,120}?)\s+[1-9]\d{0,2}$", 1), F.lit(" .:-"))
    stays = tx.norm(cut).rlike("^(?:глава|параграф|раздел|урок)(?![а-я])|(?<![а-я])(?:год|года|году|век|века)(?![а-я])")
    return F.when((cut != "") & ~stays, cut).otherwise(title)


def section_titles(rows: DataFrame, keys: list[str], text: str = "text", headings: str | None = None) -> DataFrame:
    """keys, section_title, section_title_reason: the first candidate that can be a title, or why the last one tried can't.

    Candidates are the stored headings (an array column, the innermost last), the first line, the start before a full stop, before a numbered
    step and before a colon. Only these short strings are looked at and aggregated; texts stay out of the shuffle. ``keys`` tell rows apart.
    """
    first = F.regexp_replace(F.trim(F.regexp_extract(F.trim(c(text)), r"^[^\n\r]*", 0)), r"^#{1,6}\s*", "")
    rows = rows.withColumn("_line", tx.clean(c(text)))
    flat = c("_line")
    tried = [
        ("first_line", first),
        ("inline_heading", F.regexp_extract(flat, rf"^(.{{6,140}}?)\.\s+(?:{_STEP}|[А-ЯЁA-Z])", 1)),
        ("before_step_marker", F.regexp_extract(flat, rf"^(.*?)\s{_STEP}", 1)),
        ("before_colon", F.regexp_extract(flat, r"^([^:]{8,140}):\s+\S", 1)),
    ]
    own = [F.struct(F.lit(how).alias("how"), F.when((text_ != "") | F.lit(how == "first_line"), F.coalesce(text_, F.lit(""))).alias("t")) for how, text_ in tried]
    stored = F.transform(F.reverse(F.coalesce(c(headings), F.array().cast("array<string>"))), lambda h: F.struct(F.lit("meta").alias("how"), h.alias("t"))) if headings else F.array().cast("array<struct<how:string,t:string>>")
    each = rows.select(*keys, F.posexplode(F.concat(stored, F.array(*own))).alias("at", "x")).select(*keys, "at", "x.how", F.col("x.t").alias("candidate")).where("candidate IS NOT NULL")
    early, late = _title_problems()
    # long candidates are told from their words; only short ones are looked at more closely
    told = classify.worded(each, "candidate").select(*keys, "at", "how", early.alias("early"), c("_raw").alias("candidate"))
    told = classify.prepared(told.withColumn("candidate", F.when(c("early").isNull(), c("candidate"))), "candidate")
    told = told.withColumn("problem", F.coalesce("early", late, F.when(classify.chunk_type()["chunk_type"].isin(*_NO_TITLES), F.lit("not_a_heading"))))
    title = F.when(c("problem").isNull(), F.substring(without_page_number(c("_flat")), 1, _LONGEST))
    found = told.select(*keys, "at", "how", "problem", title.alias("title"))
    good = F.min(F.when(c("problem").isNull(), F.struct("at", "how", "title")))
    by = found.groupBy(*keys).agg(good.alias("good"), F.max(F.struct("at", "problem")).alias("last"))
    return by.select(*keys, c("good.title").alias("section_title"), F.coalesce("good.how", "last.problem").alias("section_title_reason"))


# --- documents ---------------------------------------------------------------------------------------------------------


def document_profiles(elements: DataFrame, source: str = "source", index: str = "element_index", content: str = "content", first: int = 8, sample: int = 30, keywords: int = 50) -> DataFrame:
    """(source, doc_type, language, grade, keywords, profile_text) of each source, from its first elements.

    No more than ``sample`` elements of a source are gathered, however many it has (the limit is pushed below the shuffle).
    """
    early = top(elements.select(source, index, content), sample, c(index), c(content), by=source)
    joined = lambda n: F.concat_ws(" ", F.transform(F.filter(F.sort_array(F.collect_list(F.struct("rank", content))), lambda e: e["rank"] <= n), lambda e: e[content]))
    texts = early.groupBy(source).agg(joined(first).alias("_first"), joined(sample).alias("_sample"))
    named = F.concat_ws(" ", source, "_first")
    terms = early.select(source, F.explode(tx.tokens(c(content))).alias("term")).where(~c("term").isin(*fixed.STOPWORDS) & (F.length("term") >= 4) & c("term").rlike("[^0-9]")).distinct()
    counted = top(terms.groupBy(source, tx.stem(c("term")).alias("stem")).agg(F.count("*").alias("n")), keywords, F.desc("n"), c("stem"), by=source)
    words = counted.groupBy(source).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "stem"))), lambda x: x["stem"]).alias("keywords"))
    out = texts.join(words, source, "left").select(source, tx.document_type(named).alias("doc_type"), tx.language(c("_first")).alias("language"), tx.grade(named).alias("grade"), F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))
    return out.withColumn("profile_text", F.substring(tx.clean(F.concat_ws(" ", source, "doc_type", F.array_join("keywords", " "))), 1, 4000))
