"""Further wordings of a query: synonyms, topics and subjects from tables of settings, and words for what is asked after."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark import fixed_values as fixed
from quillspark.functions import text as tx
from quillspark.operators import classify

Words = dict[str, list[str]]


def merged(base: Words, *more: Words) -> Words:
    """Settings of words joined: keys in lower case, values trimmed and added once whatever their case, empty ones left out."""
    out = {k.lower(): [v.strip() for v in vs if v and v.strip()] for k, vs in base.items()}
    for words in more:
        for key, values in words.items():
            if key := (key or "").strip().lower():
                held = out.setdefault(key, [])
                for v in ((v or "").strip() for v in values):
                    if v and v.lower() not in {h.lower() for h in held}:
                        held.append(v)
    return out


def domains(sources: Column) -> Column:
    """The hosts of an array of addresses, with or without a scheme."""
    plain = F.transform(sources, lambda s: F.lower(F.trim(F.coalesce(s, F.lit("")))))
    host = lambda s: F.btrim(F.regexp_extract(F.regexp_replace(s, "^[a-z][a-z0-9+.-]*://", ""), r"^(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("."))
    return F.array_distinct(F.filter(F.transform(plain, host), lambda h: h != ""))


def _array(words) -> Column:
    return F.array(*map(F.lit, words)).cast("array<string>")


def _listed(when: Column, words) -> Column:
    return F.when(when, _array(words)).otherwise(F.array().cast("array<string>"))


def subject_words(normalized: Column, subjects: Column, by_subject: dict[str, Words]) -> Column:
    """Words of the first two subjects (an array) for the keys that a query has as phrases."""
    stems = tx.padded_stems(tx.tokens(normalized))
    has = lambda key: F.contains(stems, tx.padded_stems(tx.tokens(F.lit(key))))
    out = []
    for subject, words in by_subject.items():
        asked = F.array_contains(F.slice(subjects, 1, 2), subject)
        out += [_listed(asked & has(key), [" ".join(v.lower().split()) for v in values]) for key, values in words.items()]
    return F.array_distinct(F.flatten(F.array(*out))) if out else F.array().cast("array<string>")


def topic_markers(normalized: Column, topics: Words) -> Column:
    """The first five letters of longer terms, long terms whole, and the words of the topics that a query names; sorted."""
    terms = tx.query_terms(normalized)
    short = F.transform(F.filter(terms, lambda t: F.length(t) >= 4), lambda t: F.substring(t, 1, 5))
    named = [_listed(F.contains(normalized, F.lit(k)), [v.lower() for v in vs]) for k, vs in topics.items()]
    every = F.flatten(F.array(short, F.filter(terms, lambda t: F.length(t) >= 6), *named))
    return F.array_sort(F.array_distinct(F.filter(every, lambda m: F.length(m) >= 4)))


def variants(normalized: Column, synonyms: Words, topics: Words, subject_expansions: Column | None = None, subject: Column | None = None) -> Column:
    """A query's wordings, the query first: with words for what it asks after, with synonyms and words of topics and subjects, and with their dates.

    Queries of more than four terms that ask after nothing in particular and have no subject words stay alone.
    """
    extra_subject = F.array().cast("array<string>") if subject_expansions is None else subject_expansions
    history = F.lit(False) if subject is None else subject == "history"
    terms, focus = tx.query_terms(normalized), classify.answer_focus(normalized)
    by_term = [_listed(F.array_contains(terms, k), v) for k, v in synonyms.items()]
    by_topic = [_listed(F.contains(normalized, F.lit(k)), v) for k, v in topics.items()]
    extra = F.flatten(F.array(*by_term, *by_topic, extra_subject))
    cause = F.when(history, _array(fixed.FOCUS_EXPANSIONS["cause"])).otherwise(_array(fixed.PLAIN_CAUSE_EXPANSIONS))
    words = F.when(focus == "goal", _array(fixed.FOCUS_EXPANSIONS["goal"])).when(focus == "consequence", _array(fixed.FOCUS_EXPANSIONS["consequence"]))
    words = words.when((focus == "cause") & ~((F.size(extra_subject) > 0) & ~history), cause)
    asks = F
    for name, stems in fixed.FOCUS_STEMS.items():
        asks = asks.when(focus == name, F.lit("^(?:" + "|".join(x for x in stems if "-" not in x) + ")"))
    topic = F.filter(terms, lambda t: ~t.rlike("^[0-9]+$") & ~t.isin("год", "года", "году", "годы") & ~F.rlike(t, F.coalesce(asks.otherwise(None), F.lit("^$"))))
    focused = F.when(words.isNotNull() & (F.size(topic) > 0), F.array_join(F.concat(topic, words), " "))

    def built(more: Column) -> Column:
        dated = F.filter(more, lambda w: w.rlike("[0-9]"))
        joined = lambda ws: F.when(F.size(ws) > 0, F.concat_ws(" ", normalized, F.array_join(ws, " ")))
        each = F.array_compact(F.array(normalized, focused, joined(more), F.when(F.size(terms) <= 3, joined(dated))))
        return F.array_distinct(F.filter(F.transform(each, lambda v: F.trim(F.regexp_replace(v, r"\s+", " "))), lambda v: v != ""))

    alone = (F.size(terms) > 4) & (focus == "none") & (F.size(extra_subject) == 0)
    return F.when(alone, F.array(normalized)).otherwise(F.element_at(F.transform(F.array(extra), built), 1))
