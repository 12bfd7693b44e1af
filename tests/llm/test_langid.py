import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import langid

SF = "/root/testdata/sf0.01"


def test_trigrams_do_not_depend_on_the_stretch():
    text = "Où est-ce  que l'été commence 123 ! Straße " * 40
    whole = np.concatenate(list(langid.trigrams(text)))
    for size in (7, 50, 331):
        parts = np.concatenate(list(langid.trigrams(text, size)))
        assert abs(len(parts) - len(whole)) <= len(text) / size + 1
    assert list(langid.trigrams("")) == [] and list(langid.trigrams("12 !")) == []


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, languages = langid.sampled(docs, "lang", "text")
    train, held = rows[::2], rows[1::2]
    table = langid.train(train, languages)
    right = sum(languages[int(np.argmax(langid.likelihoods(t, table)[:-1]))] == l for l, t in held)
    assert right / len(held) > 0.97


def test_query(spark):
    from quillspark.llm.queries import op7_language_id

    rows = op7_language_id(spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert set(found) == set(docs) and sum(r.page_id is not None for r in rows) == 250
    assert sum(found[d].lang == docs[d].lang for d in docs) / len(docs) > 0.98
    assert all(r.kept for r in found.values())


def test_evidence_outweighs_and_noise_is_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = [(9001, "zxqj vkwq xxqz jjqk wvzx qqkz xzjw kqvj " * 20, "en", "src0"), (9002, "", "en", "src0"), (9003, None, None, None), (9004, "12 34 !!", "de", "src0"), (9005, "the", None, "src1"), (None, "the", None, None)]
    got = {r.doc_id: r for r in langid.identify(docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("kept", F.lit(1)), ["doc_id"]).collect()}
    assert [got[i].lang for i in (9001, 9002, 9003, 9004)] == ["und"] * 4 and not got[9001].kept
    assert got[9005].lang == "en"
    kept = langid.keep(docs.unionByName(spark.createDataFrame(odd, docs.schema)))
    assert kept.columns == docs.columns and kept.count() == docs.count() + 2
    assert langid.identify(docs.limit(0), ["doc_id"]).count() == 0


def test_page_evidence(spark):
    rows = [(1, "https://user@www.Host.example.fr:80/fr/x?y", "<!DOCTYPE html><html class=a lang='fr-FR'><body>un <script>var a</script>deux</body></html>"), (2, "nonsense", None), (3, None, "<p>x</p>")]
    got = {r.page_id: r for r in langid.evidence(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[1]._declared, got[1]._host, got[1]._suffix, got[1]._text.split()) == ("fr", "www.host.example.fr", "fr/fr", ["un", "deux"])
    assert (got[2]._declared, got[2]._host, got[2]._suffix) == (None, None, None)
    assert got[3]._text.split() == ["x"] and got[3]._host is None


def posterior(rows, languages, table):
    """The same fusion in NumPy, row by row: rows are (text, declared, host)."""
    many = len(languages)
    lls = [np.array(langid.likelihoods(t or "", table)) for t, _, _ in rows]
    best = [int(np.argmax(l[:-1])) if l[:-1].max() > l[-1] else None for l in lls]
    whole = (np.array([best.count(i) for i in range(many)]) + 1) / (sum(b is not None for b in best) + many)
    said = {d: np.full(many, langid.TABLE_WEIGHT) for d in {d for (_, d, _), b in zip(rows, best) if d is not None and b is not None} | {None}}
    hosts = {}
    for (_, d, h), b in zip(rows, best):
        if b is not None and d is not None:
            said[d][b] += 1
        if b is not None and h is not None:
            hosts.setdefault(h, np.zeros(many))[b] += 1
    every, out = sum(said.values()), []
    for (_, d, h), l in zip(rows, lls):
        prior = np.log((hosts[h] + langid.HOST_WEIGHT * whole) / (hosts[h].sum() + langid.HOST_WEIGHT)) if h in hosts else np.log(whole)
        told = np.zeros(many) if d is None else np.log(said[d if d in said else None] / every)
        score, noise = l[:-1] + prior + told, l[-1] + (prior + told).max()
        total = np.exp(score - score.max()).sum() + np.exp(min(300.0, noise - score.max()))
        out.append((languages[int(np.argmax(score))], 0.0 if l[-1] == 0 else 1 / total))
    return out


def test_fusion_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = [(9001, "zxqj vkwq xxqz jjqk wvzx qqkz xzjw kqvj " * 20, "en", "src0"), (9002, "", "en", None), (9003, None, None, "lone"), (9004, "le la les des une est dans pour " * 3, "de", "src0"), (9005, "und die der " * 4000, None, "lone")]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    train, languages = langid.sampled(docs.select(F.col("lang").alias("_d"), F.coalesce("text", F.lit("")).alias("_t")), "_d", "_t")
    want = posterior([(r.text, r.lang, r.source) for r in rows], languages, langid.train(train, languages))
    got = sorted(langid.identify(docs, ["doc_id"]).collect(), key=lambda r: r.doc_id)
    for g, (lang, sure) in zip(got, want, strict=True):
        assert abs(g.confidence - sure) < 2e-6 and g.kept == (sure >= langid.ACCEPT) and g.lang == (lang if g.kept else "und")


def test_accuracy_without_the_declared_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    hidden = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    asked = docs.withColumn("said", F.when(~hidden, F.col("lang")))
    truth = {r.doc_id: r.lang for r in docs.where(hidden).collect()}
    got = {r.doc_id: r.lang for r in langid.identify(asked, ["doc_id"], declared="said").collect() if r.doc_id in truth}
    assert sum(got[d] == truth[d] for d in truth) / len(truth) > 0.97


def test_rare_languages_copies_and_names_that_clash(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = [(9000 + i, "dette er en helt almindelig sætning om vejret og om de mennesker der bor her ved havet", "da", "src0") for i in range(500)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    clash = docs.withColumns({n: F.col("source") for n in ("_text", "_host", "_d", "_t", "ll", "hash", "id", "row", "prior")})
    kept = langid.keep(clash)
    assert kept.columns == clash.columns and kept.where("lang = 'da' AND _text = source AND prior = source").count() == 500
    assert {r.lang for r in langid.identify(docs, ["doc_id"]).where("doc_id >= 9000").collect()} == {"da"}
