"""Personal data in texts: regular expressions propose, checksums confirm, context words adjust the score.

Kinds with a fixed definition (always reported once their check passes): email, ip, card, phone. The method
adds iban (mod-97), national (telephone numbers without a country prefix) and ssn; words near them decide whether their scores reach THRESHOLD.
All patterns work in linear time: a run that can't begin a match is consumed whole, so no text makes them backtrack.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "national", "ssn")
#: A span that the method adds is reported from this score on.
THRESHOLD = 0.5
#: Characters on either side in which context words count.
CONTEXT = 48

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))

# A run of local-part characters, or of digits, is consumed even where what must follow is missing.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)?")
_IP = re.compile(r"[0-9]++(\.[0-9]++\.[0-9]++\.[0-9]++)?")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NATIONAL = re.compile(r"\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")

_IBAN_LENGTH = dict(AT=20, BE=16, BG=22, CH=21, CY=28, CZ=24, DE=22, DK=18, EE=20, ES=24, FI=18, FR=27, GB=22, GR=27, HR=21, HU=28, IE=22, IS=26, IT=27, LI=21, LT=20, LU=20, LV=21, MC=27, MT=31, NL=18, NO=15, PL=28, PT=25, RO=24, SE=24, SI=19, SK=24)
_BY_LENGTH = {n: "|".join(c for c, m in _IBAN_LENGTH.items() if m == n) for n in sorted(set(_IBAN_LENGTH.values()))}
_IBAN = re.compile("(?<![A-Za-z0-9])(?:" + "|".join(f"(?:{c})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in _BY_LENGTH.items()) + ")")

#: Words near a span that raise its score, and words that lower it: whole words, a phrase with its spaces.
_WORDS = {
    "email": ("mail", "email", "e-mail", "contact", "write"),
    "ip": ("address", "host", "server", "client"),
    "card": ("card", "visa", "credit", "debit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "fax", "mobile", "telefon", "cell"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "national": ("phone", "call", "tel", "fax", "mobile", "telefon", "cell"),
    "ssn": ("ssn", "social security", "taxpayer"),
}
_AGAINST = ("part", "item", "order", "serial", "version", "model", "sku", "isbn", "checksum")
_PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.8, "iban": 0.75, "national": 0.6, "ssn": 0.3}
#: What a word for or against a span adds to its prior or takes from it. Only spans that the method adds can fall below THRESHOLD.
RAISED, LOWERED = 0.3, 0.3
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    rest = 0
    for c in iban[4:] + iban[:4]:
        rest = (rest * (10 if c.isdigit() else 100) + int(c, 36)) % 97
    return rest == 1


def _octet(digits: str) -> bool:
    return len(d := digits.lstrip("0")) <= 3 and int(d or "0") <= 255


def _proposed(text: str):
    """(kind, start, end) of every proposal that its validator confirms."""
    if "@" in text:
        for m in _EMAIL.finditer(text):
            if m[1]:
                yield "email", m.start(), m.end()
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if m[1] and all(map(_octet, m[0].split("."))):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    phones = []
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                phones.append((m.start(), m.end()))
                yield "phone", m.start(), m.end()
    m = _IBAN.search(text)
    while m:
        good = mod97(m[0].replace(" ", ""))
        if good:
            yield "iban", m.start(), m.end()
        m = _IBAN.search(text, m.end() if good else m.start() + 1)
    if "(" in text:
        known = iter([*phones, (len(text) + 1, len(text) + 1)])
        now = next(known)
        for m in _NATIONAL.finditer(text):
            while now[1] <= m.start():
                now = next(known)
            if m.end() <= now[0]:
                yield "national", m.start(), m.end()
    if "-" in text:
        for m in _SSN.finditer(text):
            yield "ssn", m.start(), m.end()


def _near(text: str, start: int, end: int) -> str:
    """The words up to CONTEXT characters before and after a span, in lower case and between spaces; words that are cut there are left out."""
    a, e = max(0, start - CONTEXT), min(len(text), end + CONTEXT)
    while 0 < a < start and text[a - 1].isalpha() and text[a].isalpha():
        a += 1
    while end < e < len(text) and text[e - 1].isalpha() and text[e].isalpha():
        e -= 1
    return f" {' '.join(_WORD.findall(text[a:start].lower()))} | {' '.join(_WORD.findall(text[end:e].lower()))} "


def find(text: str | None) -> list[dict]:
    """The spans of one text, by start and then kind; code points, end exclusive."""
    text, found = text or "", []
    for kind, start, end in _proposed(text):
        near = _near(text, start, end)
        score = _PRIOR[kind] + RAISED * any(f" {w} " in near for w in _WORDS[kind]) - LOWERED * any(f" {w} " in near for w in _AGAINST)
        score = min(1.0, max(0.0, score))
        if kind in BASE or score >= THRESHOLD:
            found.append({"kind": kind, "start": start, "end": end, "score": round(score, 3)})
    return sorted(found, key=lambda s: (s["start"], KINDS.index(s["kind"])))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans): one row for each row of ``docs``.

    Null and empty texts have no spans; very long texts are scanned whole, in linear time; spans that start together are in the order of KINDS; null and repeated
    ids keep their rows; other columns are ignored; an empty table gives an empty result.
    """
    schema = T.StructType([docs.schema[id_col], T.StructField("spans", SPANS)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([find(t.as_py()) for t in b.column(1)], type=kind)], names=[id_col, "spans"])

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def listed(column: str):
    """The spans of a column as kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digest(found: DataFrame, base: tuple[str, ...], id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_<kind>, base_sha256, spans, n_all, scores) from a table of spans; n_all counts all of them and scores lists theirs in the same order."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    own = found.withColumn("base", F.filter("spans", lambda s: s["kind"].isin(*base)))
    scores = F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",")
    return own.select(id_col, *map(count, base), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"), F.size("spans").cast("long").alias("n_all"), scores.alias("scores"))
