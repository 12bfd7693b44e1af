"""The queries of this package and their SQL; ``__spark_entry__`` adds them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from quillspark.llm import ann, bpe, langid, licenses, lm, packing, pii, quality, secrets, simhash
from quillspark.llm.common import table


def op1_simhash(spark, sf_dir):
    return simhash.components(table(spark, sf_dir, "documents"))


def op2_pii(spark, sf_dir):
    return pii.digest(pii.spans(table(spark, sf_dir, "documents")), pii.BASE)


def op3_lm(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents"))


def op4_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_ann(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op6_bpe(spark, sf_dir):
    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op7_language_id(spark, sf_dir):
    """All documents (declared language and source) and all pages (markup, address and host)."""
    documents = langid.identify(table(spark, sf_dir, "documents"), ["doc_id"])
    pages = langid.identify_pages(table(spark, sf_dir, "pages"), ["page_id"])
    return documents.unionByName(pages, allowMissingColumns=True).select("doc_id", "page_id", "lang", "confidence", "kept")


def op8_secrets(spark, sf_dir):
    return secrets.digest(secrets.spans(table(spark, sf_dir, "documents")))


def op9_quality(spark, sf_dir):
    return quality.rules(table(spark, sf_dir, "documents"))


def op10_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


QUERIES = {"op1_simhash": op1_simhash, "op2_pii": op2_pii, "op3_lm": op3_lm, "op4_packing": op4_packing, "op5_ann": op5_ann, "op6_bpe": op6_bpe, "op7_language_id": op7_language_id, "op8_secrets": op8_secrets, "op9_quality": op9_quality, "op10_licenses": op10_licenses}

ORACLE: dict[str, str] = {"op3_lm": lm.SQL, "op5_ann": ann.SQL, "op9_quality": quality.SQL}
