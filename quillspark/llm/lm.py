"""Stupid-backoff scores of documents by a word-pair model of the whole corpus, each document left out of its own counts.

Three relations are joined by hash. ``chunks``: a few million tokens of documents in one row, with a word list. ``wanted``: each chunk's different
n-grams with their counts in it, sorted by hash and cut into buckets; a bucket of all chunks is one partition of the
n-gram count table. ``answers``: for each n-gram that a chunk asked for, how often all other chunks have it. Rows hold packed
arrays, so that an n-gram costs a few bytes of shuffle once for each chunk that has it, however often it occurs, and no n-gram is hot. A chunk has a row for
each bucket in which it has an n-gram, so never more rows than different n-grams. By estimate one row for each n-gram instead would shuffle about four times the input.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import partial
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import materialize

#: Tokens in a chunk (a longer document is a chunk of its own), and documents at most.
CHUNK_TOKENS, CHUNK_DOCS = 2_000_000, 65_536
#: Buckets at least; with more chunks there is one for each chunk, so that a bucket's size stays the same.
BUCKETS = 48
BACKOFF = 0.4


def _squeezed(x: np.ndarray) -> bytes:
    """Integers as compressed planes of bytes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def _opened(b: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Chunk:
    """The tokens of some documents, numbered by a word list, and their n-grams in the order of their hashes."""

    def __init__(self, sizes: bytes, tokens: bytes, words: bytes):
        self.sizes, self.tokens, self.words = _opened(sizes, np.int32).astype(np.int64), _opened(tokens, np.int32).astype(np.int64), np.frombuffer(words, dtype=np.uint64)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.second = np.flatnonzero(self.doc[1:] == self.doc[:-1]) + 1  # tokens that have one before them
        pairs, self.pair = np.unique(self.tokens[self.second - 1] << 32 | self.tokens[self.second], return_inverse=True)
        hashes = np.concatenate([_mixed(self.words), _mixed(self.words[pairs >> 32] * np.uint64(0x9E3779B97F4A7C15) + (self.words[pairs & 0xFFFFFFFF] ^ np.uint64(0xD6E8FEB86659FD93)))])
        counts = np.concatenate([np.bincount(self.tokens, minlength=len(self.words)), np.bincount(self.pair, minlength=len(pairs))])
        self.order = np.argsort(hashes, kind="stable")
        self.hashes, self.counts = hashes[self.order], counts[self.order]

    def scores(self, others: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, sum of log scores) of each document. ``others``: counts in all other chunks, in the order of ``hashes``."""
        every = np.empty(len(self.order), dtype=np.int64)
        every[self.order] = others + self.counts
        single, double = every[: len(self.words)], every[len(self.words) :]

        def left_out(counts, of, docs):
            _, at, n = np.unique(docs * len(counts) + of, return_inverse=True, return_counts=True) if len(of) else (None, np.zeros(0, int), np.zeros(0, int))
            return counts[of] - n[at]

        rest = (total - self.sizes)[self.doc]
        words = left_out(single, self.tokens, self.doc)
        pairs = left_out(double, self.pair, self.doc[self.second])
        log = lambda x: np.log(np.maximum(x, 1))
        value = np.where(words > 0, log(words) - log(rest), math.log(BACKOFF) - np.log(rest + 1.0))
        value[self.second] = np.where(pairs > 0, log(pairs) - log(words[self.second - 1]), math.log(BACKOFF) + value[self.second])
        return self.sizes, np.bincount(self.doc, weights=value, minlength=len(self.sizes))


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(chunk, n, ids, sizes, tokens, words): documents packed together, words lower-cased (A-Z) and separated by U+0020 and U+0009 to U+000D."""

    def run(batches):
        base, number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, count()
        word, ids, sizes, tokens = None, [], [], []

        def flushed():
            flat = np.concatenate([np.zeros(0, np.int64), *tokens])
            words = list(word)
            often = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")  # frequent words get small numbers
            rank = np.empty(len(words), dtype=np.int32)
            rank[often] = np.arange(len(words), dtype=np.int32)
            hashed = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), words), dtype=np.uint64, count=len(words))[often]
            row = (base | next(number), len(flat), ids, _squeezed(np.array(sizes, dtype=np.int32)), _squeezed(rank[flat] if len(flat) else np.zeros(0, np.int32)), hashed.tobytes())
            return pa.RecordBatch.from_pylist([dict(zip(names, row))], schema=pa.schema(list(zip(names, (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary())))))

        names, held = ["chunk", "n", "ids", "sizes", "tokens", "words"], 0
        for b in batches:
            for i, t in zip(b.column(0), b.column(1)):
                if word is None:
                    word, ids, sizes, tokens, held = defaultdict(count().__next__), [], [], [], 0
                own = (t.as_py() or "").encode().lower().split()
                ids.append(i.as_py())
                sizes.append(len(own))
                tokens.append(np.fromiter(map(word.__getitem__, own), dtype=np.int64, count=len(own)))
                held += len(own)
                if held >= CHUNK_TOKENS or len(ids) >= CHUNK_DOCS:
                    yield flushed()
                    word = None
        if word is not None:
            yield flushed()

    return docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(run, "chunk long, n long, ids array<string>, sizes binary, tokens binary, words binary")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, logprob, score): the sum of log stupid-backoff scores of each document's tokens, and their mean.

    A pair of words that other documents have scores its count there over the first word's; else BACKOFF times the second word's share;
    else, where no other document has the word, BACKOFF squared over the number of tokens. A first word starts from its share. Null and empty texts have
    no tokens, logprob 0 and score null; very long texts are scored whole (such a text is a chunk of its own); null and repeated ids keep their rows; other columns
    are ignored; an empty table gives an empty result.
    """
    held, _ = materialize(chunks(docs, id_col, text_col), "chunks")
    total, number = held.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    buckets = max(BUCKETS, number)
    cut = lambda hashes: np.searchsorted(hashes >> np.uint64(32), (np.arange(buckets + 1, dtype=np.float64) * 2.0**32 / buckets).astype(np.uint64))

    def wanted(batches):
        for b in batches:
            for row in b.to_pylist():
                c = Chunk(row["sizes"], row["tokens"], row["words"])
                ends = cut(c.hashes)
                parts = [(k, row["chunk"], c.hashes[a:e], c.counts[a:e].astype(np.int32)) for k, (a, e) in enumerate(zip(ends, ends[1:])) if e > a]
                gaps = [np.diff(h, prepend=np.uint64(0)) for _, _, h, _ in parts]
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.int64()), pa.array([_squeezed(g) for g in gaps], pa.binary()), pa.array([_squeezed(p[3]) for p in parts], pa.binary())], names=["bucket", "chunk", "gaps", "counts"])

    def answers(key, rows: pd.DataFrame) -> pd.DataFrame:
        hashes = [np.cumsum(_opened(g, np.uint64), dtype=np.uint64) for g in rows["gaps"]]
        counts = np.concatenate([_opened(c, np.int32) for c in rows["counts"]]).astype(np.int64)
        distinct, at = np.unique(np.concatenate(hashes), return_inverse=True)
        sums = np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64)  # this partition of the count table
        others, ends = sums[at] - counts, np.cumsum([0, *map(len, hashes)])
        return pd.DataFrame({"chunk": rows["chunk"], "bucket": key[0], "others": [_squeezed(others[a:e]) for a, e in zip(ends, ends[1:])]})

    def scored(key, rows: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        row = rows.iloc[0]
        others = [_opened(o, np.int64) for o in got.sort_values("bucket")["others"]]
        n, value = Chunk(row["sizes"], row["tokens"], row["words"]).scores(np.concatenate([np.zeros(0, np.int64), *others]), total)
        return pd.DataFrame({"id": list(row["ids"]), "n_tokens": n, "logprob": value})

    tables = held.mapInArrow(wanted, "bucket int, chunk long, gaps binary, counts binary").groupBy("bucket").applyInPandas(answers, "chunk long, bucket int, others binary")
    out = held.groupBy("chunk").cogroup(tables.groupBy("chunk")).applyInPandas(scored, "id string, n_tokens long, logprob double")
    mean = F.when(F.col("n_tokens") > 0, F.round(F.col("logprob") / F.col("n_tokens"), 6))
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_tokens", F.round("logprob", 4).alias("logprob"), mean.alias("score"))


SQL = f"""
WITH t AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents)),
b AS (SELECT doc_id, i, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM t),
c AS (SELECT doc_id, i, w, v, count(*) OVER () AS n, count(*) OVER (PARTITION BY doc_id) AS nd,
  count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY doc_id, w) AS cw,
  count(*) OVER (PARTITION BY v, w) - count(*) OVER (PARTITION BY doc_id, v, w) AS cvw FROM b),
d AS (SELECT *, lag(cw) OVER (PARTITION BY doc_id ORDER BY i) AS cv, CASE WHEN cw > 0 THEN ln(cw) - ln(greatest(n - nd, 1)) ELSE ln({BACKOFF}) - ln(n - nd + 1.0) END AS one FROM c),
s AS (SELECT doc_id, count(*) AS n_tokens, sum(CASE WHEN v IS NULL THEN one WHEN cvw > 0 THEN ln(cvw) - ln(cv) ELSE ln({BACKOFF}) + one END) AS l FROM d GROUP BY doc_id)
SELECT doc_id, coalesce(n_tokens, 0) AS n_tokens, round(coalesce(l, 0.0), 4) AS logprob, round(l / n_tokens, 6) AS score FROM documents LEFT JOIN s USING (doc_id)"""
