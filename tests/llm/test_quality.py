import re
from collections import Counter

import duckdb
import pytest

from quillspark.llm import quality

COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)]


def test_statistics(spark):
    block = "a b c d e f g h i"
    texts = [None, "", " \n\t ", "one", f"{block} x {block}", f"{block} {block} {block}", "w " * 5000, "é\x0b𝔸\x0c#\x1c# |x|\n\nq\nq\n q", "same line here\nother\nsame line here\n\n", " a b c d e f g h", "x y " * 4]
    docs = spark.createDataFrame([(i, t, "h", 1) for i, t in enumerate(texts)], "doc_id long, text string, source string, kept int")
    got = {r.doc_id: [r[c] for c in COLUMNS] for r in quality.rules(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql_and_brute_force(spark, sf):
    from quillspark.llm.queries import op9_quality

    sf = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rel = con.sql(quality.SQL)
    want = sorted(map(tuple, rel.fetchall()))
    df = op9_quality(spark, sf)
    assert df.columns == rel.columns
    assert sorted(tuple(r) for r in df.collect()) == want
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all([r[c] for c in COLUMNS] == brute(texts[r.doc_id]) for r in df.collect())


def test_frequent_lines_deplete_but_copies_do_not(spark):
    footer = "All rights of this page are reserved by the people who made it for all of us today and in the years to come"
    own = lambda i: " ".join(f"word{i}x{k}" for k in range(30))
    rows = [(i, own(i) + "\n" + footer, "a") for i in range(30)]
    rows += [(100 + i, footer + "\n" + f"short{i} tail", "a") for i in range(5)]
    rows += [(200 + i, "\n".join(own(1000 + k) for k in range(12)) + (f"\nedit{i}" if i else ""), "b") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in quality.rules(docs).collect()}
    assert all(kept[d] == (not 100 <= d < 105) for d in kept)
    cleaned = {r.doc_id: r.text for r in quality.clean(docs).collect()}
    assert cleaned == {d: t.replace("\n" + footer, "") for d, t, _ in rows if kept[d]}


def test_edges(spark):
    rows = [(None, "a b " * 10, None, 3), (None, None, None, 0), (1, "q " * 7, "h", 0), (1, "q " * 7, "h", 0), (1, "r", "h", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    got = sorted((r.doc_id or 0, r.n_words, r.kept) for r in quality.rules(docs).collect())
    assert got == [(0, 0, False), (0, 20, False), (1, 1, False), (1, 7, False), (1, 7, False)]
    assert quality.rules(docs.limit(0)).count() == 0 and quality.clean(docs).count() == 0
    fine = spark.createDataFrame([(None, " ".join(f"w{i}" for i in range(25)), None, 3)] * 2, docs.schema)
    assert quality.clean(fine).collect() == fine.collect()


def test_several_shared_lines_are_all_removed(spark):
    line = lambda name: " ".join(f"{name}x{k}" for k in range(30))
    rows, boilerplate = [], set()
    for host, (shared, own) in enumerate([(1, 1), (5, 1), (10, 5), (20, 20), (5, 3), (3, 3)]):
        common = [line(f"h{host}s{k}") for k in range(shared)]
        boilerplate |= set(common)
        rows += [(len(rows) + i, "\n".join([*common, *(line(f"h{host}d{i}o{k}") for k in range(own))]), f"h{host}") for i in range(25)]
    # copies, and near copies with a changed line, also beside boilerplate, take nothing from one another
    for i in range(60):
        copy = [line(f"c{k}") if k != i % 40 else line(f"edit{i}") for k in range(40)]
        rows.append((len(rows), "\n".join([*sorted(boilerplate)[:1], *copy]), "near"))
        rows.append((len(rows), "\n".join(line(f"e{k}") for k in range(3)), "exact"))
    for i in range(20):
        rows.append((len(rows), "\n".join([line("rare"), line(f"few{i}")]), "few"))
    by_line = {}
    for d, t, host in rows:
        for x in set(t.split("\n")):
            by_line.setdefault((host, x), set()).add(t)
    gone = {k for k, texts in by_line.items() if len(texts) > 20 and k[0] != "near"}
    assert {x for _, x in gone} == boilerplate
    want = {d: "\n".join(x for x in t.split("\n") if (host, x) not in gone) for d, t, host in rows if host != "h1"}
    got = {r.doc_id: r.text for r in quality.clean(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    # five shared lines and one own: the documents are depleted
    assert got == want


def test_the_query_removes_all_of_several_shared_lines(spark):
    line = lambda name: " ".join(f"{name}x{k}" for k in range(10))
    rows = [(i, "\n".join([line("a"), line("b"), line("c"), *(line(f"d{i}o{k}") for k in range(3))]), "h") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.removed_words for r in quality.rules(docs).collect()} == {30}
    con = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841
    con.register("documents", documents)
    assert sorted(con.sql(quality.SQL).fetchall()) == sorted(map(tuple, quality.rules(docs).collect()))


def test_names_that_clash(spark):
    footer, names = "one footer of many words that all pages of this host have in common", ["id", "hash", "host", "row", "removed", "kept", "new", "_text", "k_id", "lines", "h", "n"]
    own = lambda i: " ".join(f"word{i}x{k}" for k in range(30))
    rows = [(i, own(i) + "\n" + footer, "a", *[f"v{i}"] * len(names)) for i in range(25)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long, text string, source string", *(f"{n} string" for n in names)]))
    got = quality.clean(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [(i, own(i), *r) for i, _, *r in rows]
    assert quality.rules(docs).count() == 25
