import hashlib
import re

from quillspark.llm import pii


def brute(text):
    """The definitions as they stand, by plain regular expressions."""
    text, out = text or "", []
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = digits(m[0])
        total = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1]))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(digits(m[0])) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


HARD = [
    None,
    "",
    "a@b.com.@c.org a@b@c.de x..y@z-1.a.b..c",
    "1.2.3.4.5.6.7.8 1.2.3.256 01.002.0003.4 1.2.3.4.5",
    "4111 1111 1111 1111 4111-1111-1111-1112 12345678901234 0" + "0" * 13,
    "+1 (988) 555-2485 +49 30 1234567 +1(((((((( +123456789 +1 2",
    "né +1 (724) 555-7058 4111111111111111 é@x.y b@é.z 𝔸 a@b.cd 9.9.9.9",
    "x" * 3000 + "@" + "1" * 3000,
    "1234.5678@a.b 1.1.1.1@a.b.c",
]


def test_base_spans_equal_definitions():
    import random

    rng = random.Random(3)
    for text in HARD + ["".join(rng.choices("0123456789.+-() @ab%", k=80)) for _ in range(4000)]:
        got = [f"{s['kind']}:{s['start']}:{s['end']}" for s in pii.find(text) if s["kind"] in pii.BASE]
        assert got == brute(text), text


def test_validators_and_context():
    assert [s["kind"] for s in pii.find("pay DE89 3704 0044 0532 0130 00 now")] == ["iban"]
    assert not pii.find("pay DE88 3704 0044 0532 0130 00 now")
    assert not pii.find("part 123-45-6789 of it")
    assert [s["kind"] for s in pii.find("his SSN 123-45-6789 of it")] == ["ssn"]
    assert [s["kind"] for s in pii.find("at (499) 555-6503%% or +1 (499) 555-6503")] == ["national", "phone"]


def test_context_decides_for_added_kinds():
    kinds = lambda t: [s["kind"] for s in pii.find(t)]
    assert kinds("DE89370400440532013000 GB29NWBK60161331926819") == ["iban", "iban"]
    assert kinds("DE89 37040044 0532013000GB29 NWBK60161331926819 end") == ["iban"] and kinds("NO00 NO9386011117947") == ["iban"]
    assert kinds("serial GB29NWBK60161331926819") == [] and kinds("bank serial GB29NWBK60161331926819") == ["iban"]
    assert kinds("item (499) 555-6503 of it") == [] and kinds("phone item (499) 555-6503 of it") == ["national"]
    assert kinds("the ssns 123-45-6789 of it") == [] and kinds("social security: 123-45-6789") == ["ssn"]
    score = lambda t: pii.find(t)[0]["score"]
    assert score("the hotel +49 30 1234567") == score("+49 30 1234567") < score("the tel +49 30 1234567")
    assert score("x" * 40 + "ho" + "tel" + "." * (pii.CONTEXT - 3) + "+49 30 1234567") == score("+49 30 1234567")


def test_linear_time():
    import time

    began = time.time()
    for text in ("1" * 300_000, "a" * 300_000, "1." * 150_000, "+1" + "(" * 300_000, "1 " * 150_000, "@" * 300_000, "A1" * 150_000, "AB12 " * 60_000):
        pii.find(text)
    assert time.time() - began < 20


def test_query_on_documents(spark):
    from quillspark.llm.queries import op2_pii

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op2_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in pii.BASE]
        assert set(want) <= set(r.spans.split(","))
    odd = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "a@b.c", 3), (1, "a@b.c", 3)], "doc_id long, text string, spans int")
    got = sorted((r.doc_id or 0, r.n_email, r.spans) for r in pii.digest(pii.spans(odd), pii.BASE).collect())
    assert got == [(0, 0, ""), (1, 0, ""), (1, 1, "email:0:5"), (1, 1, "email:0:5")]
    assert pii.spans(odd.limit(0)).count() == 0
