import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import regex
import tiktoken
from tokenizers import Tokenizer

from quillspark.llm import bpe, pretokens

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = ["'", "s", "t", "r", "e", "l", "d", "v", "m", "S", " ", "  ", "\n", "\t", "a", "é", "1", "²", "!", "#", " ", "　", "中", "𝔸", "\x1c", "\x85", "<|endoftext|>"]


def library(path=RANKS):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_equal_the_pattern(monkeypatch):
    rng, pattern = random.Random(1), regex.compile(P.PATTERN)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 40))) for _ in range(20000)]
    assert list(pretokens.pieces(texts)) == [pattern.findall(t) for t in texts]
    monkeypatch.setattr(pretokens, "STRETCH", 64)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(200, 900))) for _ in range(500)] + [" " * 1000 + "a", "'" * 500 + "s" + "x" * 300, "a" * 999]
    assert [next(pretokens.pieces([t])) for t in texts] == [pattern.findall(t) for t in texts]


def test_ids_equal_the_library():
    rng, enc, own = random.Random(2), library(), bpe.from_ranks(RANKS)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 60))) for _ in range(5000)] + ["a" * 5000, "ab" * 4000, "\n" * 3000, "中文" * 500]
    for text, (pieces, ids, _) in zip(texts, bpe.encoded(texts, own)):
        assert ids.tolist() == enc.encode_ordinary(text)
        assert b"".join(own.decode(pa.array(ids)).to_pylist()) == text.encode() and "".join(pieces) == text


def test_json_ids_equal_the_library():
    rng, path = random.Random(3), P.path("byte_bpe_50k.json")
    tok, own = Tokenizer.from_file(path), bpe.from_json(path)
    tok.encode_special_tokens = True
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 60))) for _ in range(3000)] + ["a" * 3000, "Thntblere of then, edtioner in inea"]
    for text, (_, ids, _) in zip(texts, bpe.encoded(texts, own)):
        assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_every_code_point():
    enc, own = library(), bpe.from_ranks(RANKS)
    texts = ["".join(f"x{chr(c)}1{chr(c)}!" for c in range(a, a + 256) if not 0xD800 <= c < 0xE000) for a in range(0, 0x33500, 256)]
    for text, (_, ids, _) in zip(texts, bpe.encoded(texts, own)):
        assert ids.tolist() == enc.encode_ordinary(text)


def test_query_and_edges(spark):
    from quillspark.llm.queries import op6_bpe

    sf, enc = "/root/testdata/sf0.001", library()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op6_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    odd = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "it's  ok", 3), (1, "it's  ok", 3)], "doc_id long, text string, ids int")
    got = bpe.decode(bpe.encode(odd, RANKS), RANKS).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded).decode()) for r in got) == [(0, ""), (1, ""), (1, "it's  ok"), (1, "it's  ok")]
    last = [r for r in got if r.ids][0]
    assert last.offsets == [0, 2, 4, 5] and sum(last.counts) == len(last.ids)
    assert bpe.encode(odd.limit(0), RANKS).count() == 0


def test_offsets_guard_decoding_and_batches_are_bounded(spark, monkeypatch):
    import pytest

    own = bpe.from_ranks(RANKS)
    pieces, ids, counts = bpe.encoded(["né 𝔸 it's 12 中文 "], own)[0]
    assert bpe.decoded(ids, bpe.starts(pieces), counts, own).decode() == "né 𝔸 it's 12 中文 "
    with pytest.raises(ValueError):
        bpe.decoded(ids, bpe.starts(pieces) + 1, counts, own)
    assert bpe.decoded(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32), own) == b""
    monkeypatch.setattr(bpe, "BATCH_CHARS", 10)
    assert list(bpe.batches_of(["abc", "defghij", "k", "x" * 50, "", "y"])) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert list(bpe.batches_of([])) == []
    assert bpe.digest(spark.createDataFrame([], "doc_id long, text string"), RANKS).count() == 0
