"""Nearest neighbours by a block matrix join over int8 tiles.

Rows are dealt into blocks; each block is one row of packed arrays: vectors, int8 codes with a scale for each vector, and the
norms of what the codes leave out. A tile multiplies the codes of a query block and a candidate block (exact in single precision,
so a fast matrix product does it) and bounds every inner product from both sides. Pairs that may be among the best k
survive, are recomputed in double precision, and the tiles' lists of each query are merged by a heap. The result is exact.
"""

from __future__ import annotations

import heapq
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import materialize

#: Numbers in a block of candidates and in one of queries, whatever the dimension.
CANDIDATE_CELLS, QUERY_CELLS = 1 << 20, 1 << 17
#: Queries of a tile that are worked on at a time.
_STRIP = 128

_PACKED = "dim int, block int, n int, uids binary, ids binary, vectors binary, codes binary, scales binary, errors binary"


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(uid, id, dim, v) of the rows that take part: neither id nor vector null, all components finite, not all zero."""
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    return rows.select(F.monotonically_increasing_id().alias("uid"), "id", F.size("v").alias("dim"), "v")


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, a scale for each row, and the norm of each row's quantisation error."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = np.finfo(float).tiny  # a component below the smallest quotient
    codes = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    return codes, scale, np.linalg.norm(x - scale[:, None] * codes, axis=1)


def _packed(key, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("uid")
    x = np.array(rows["v"].tolist(), dtype=np.float64).reshape(len(rows), -1)
    codes, scale, error = quantised(x)
    blobs = (rows["uid"].to_numpy(np.int64), rows["id"].to_numpy(np.int64), x, codes, scale, error)
    return pd.DataFrame([(key[0], key[1], len(rows), *(b.tobytes() for b in blobs))], columns=[c.split()[0] for c in _PACKED.split(", ")])


def _opened(row, side: str):
    n = getattr(row, f"{side}n")
    read = lambda name, kind: np.frombuffer(getattr(row, side + name), dtype=kind)
    return read("uids", np.int64), read("ids", np.int64), read("vectors", np.float64).reshape(n, -1), read("codes", np.int8).reshape(n, -1), read("scales", np.float64), read("errors", np.float64)


def tile(query, candidate, k: int):
    """(query uid, query id, ids, scores) of each query of a block: its k best of the candidate block, nearest first, ties to the smaller id."""
    quid, qid, q, qcodes, qscale, qerror = query
    cuid, cid, c, ccodes, cscale, cerror = candidate
    cpoints, cnorm = ccodes.astype(np.float32).T.copy(), np.linalg.norm(c, axis=1)
    slack = 1e-9 * np.linalg.norm(q, axis=1)
    for at in range(0, len(q), _STRIP):
        s = slice(at, at + _STRIP)
        with np.errstate(over="ignore", invalid="ignore"):
            near = (qcodes[s].astype(np.float32) @ cpoints).astype(np.float64) * qscale[s, None] * cscale
            rounded = qscale[s] * np.linalg.norm(qcodes[s].astype(np.float64), axis=1)
            error = rounded[:, None] * cerror + (qerror[s] + slack[s])[:, None] * cnorm
            own, low, high = quid[s, None] == cuid, near - error, near + error
            low = np.where(own | ~np.isfinite(low), -np.inf, low)
            least = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(low), -np.inf)
            row, column = np.nonzero(((high >= least[:, None]) | np.isnan(high)) & ~own)  # a bound that overflows excludes nothing
            score = np.zeros(len(row))
            for d in range(q.shape[1]):
                score += q[at + row, d] * c[column, d]
        order = np.lexsort((cid[column], -score, row))
        row, column, score = row[order], column[order], score[order]
        ends = np.searchsorted(row, np.arange(len(low) + 1))
        for i, (a, e) in enumerate(zip(ends, ends[1:])):
            e = min(e, a + k)
            if e > a:
                yield int(quid[at + i]), int(qid[at + i]), cid[column[a:e]], score[a:e]


def search(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which ``is_query`` (a condition on column ``id``) holds, its k nearest other rows.

    Nearness is the inner product in double precision; ties go to the smaller id; fewer than k candidates are all returned. Rows with a null id
    or an unusable vector take no part; vectors are compared with those of their own dimension. A row is no candidate of its own, but
    rows that repeat an id are rows of their own, as queries and as candidates. Products that overflow are infinite, or no number and then last. Other columns are
    ignored. An empty table gives an empty result. A joined row holds two blocks, about 10 MB; Spark passes rows to Python in batches of
    ``spark.sql.execution.arrow.maxBytesPerBatch`` (64 MB unless set), which bounds a task's memory.
    """
    rows, _ = materialize(usable(vectors, id_col, vec_col), "vectors")
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(is_query).alias("q"))
    per = lambda cells: F.greatest(F.lit(1), F.floor(F.lit(cells) / F.col("dim")))
    sizes = sizes.select("dim", F.ceil(F.col("n") / per(CANDIDATE_CELLS)).cast("int").alias("blocks"), F.ceil(F.col("q") / per(QUERY_CELLS)).cast("int").alias("query_blocks"))
    dealt = rows.join(sizes, "dim")
    number = lambda of: F.pmod(F.xxhash64("uid", "id"), F.col(of)).cast("int")
    candidates = dealt.withColumn("block", number("blocks")).groupBy("dim", "block").applyInPandas(_packed, _PACKED)
    queries = dealt.where(is_query).withColumn("block", number("query_blocks")).groupBy("dim", "block").applyInPandas(_packed, _PACKED)
    names = [c.split()[0] for c in _PACKED.split(", ")][2:]
    queries = queries.select("dim", *(F.col(c).alias(f"q_{c}") for c in names)).join(sizes, "dim")
    queries = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = queries.join(candidates.select("dim", "block", *(F.col(c).alias(f"c_{c}") for c in names)), ["dim", "block"])

    def products(batches):
        for b in batches:
            for row in b.itertuples():
                found = list(tile(_opened(row, "q_"), _opened(row, "c_"), k))
                yield pd.DataFrame(found, columns=["uid", "query_id", "ids", "scores"])

    def merged(batches):
        def every():
            for b in batches:
                yield from b.itertuples(index=False)

        out = []
        for _, lists in groupby(every(), key=lambda r: r.uid):
            lists = list(lists)
            best = heapq.merge(*(zip(-np.nan_to_num(np.asarray(r.scores), nan=-np.inf, posinf=np.inf, neginf=-np.inf), r.ids) for r in lists))
            out += [(lists[0].query_id, n + 1, i, -s) for n, (s, i) in zip(range(k), best)]
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])
                out = []
        yield pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])

    lists = tiles.select([f"q_{c}" for c in names] + [f"c_{c}" for c in names]).mapInPandas(products, "uid long, query_id long, ids array<long>, scores array<double>")
    return lists.repartition("uid").sortWithinPartitions("uid").mapInPandas(merged, "query_id long, rank int, vec_id long, score double")


SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY rank <= 20"""
