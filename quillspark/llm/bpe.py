"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, and decoding.

``pretokens`` locates the pieces; each different piece is merged once per worker (a bounded cache) and its ids are
reused. The offsets of the pieces are retained, and decoding places each piece's bytes by them.
"""

from __future__ import annotations

import base64
import heapq
import json
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import pretokens

#: Pieces that a worker remembers; when there are more it starts afresh.
CACHE = 200_000
#: Texts that are encoded or decoded together: this many, and no more characters than that (or one longer text).
BATCH, BATCH_CHARS = 512, 1 << 20
#: Pieces longer than this many bytes are merged with a heap and not remembered.
LONG = 64
#: The rank of a pair that doesn't merge.
NEVER = np.int32(2**31 - 1)


class Vocabulary:
    """The tokens' bytes, the ids of single bytes, and the rank and result of every mergeable pair of ids."""

    def __init__(self, tokens: dict[int, bytes], pairs: dict[tuple[int, int], tuple[int, int]], whole: dict[bytes, int] | None):
        self.tokens, self.pairs, self.whole = tokens, pairs, whole
        # a piece's number, and by number where its ids start in the flat table and how many they are
        self.cache, self.used = {}, 0
        self.flat, self.counts, self.starts = np.empty(1024, dtype=np.int32), np.empty(1024, dtype=np.int64), np.empty(1024, dtype=np.int64)
        by_bytes = {b: i for i, b in tokens.items() if len(b) == 1}
        self.single = [by_bytes[bytes([b])] for b in range(256)]
        self.bytes = pa.array([tokens.get(i, b"") for i in range(max(tokens) + 1)], type=pa.binary())
        self.singles = np.array(self.single, dtype=np.int32)
        keys = sorted(pairs)
        self.keys = np.array([a << 20 | b for a, b in keys], dtype=np.int64)
        self.ranks = np.array([pairs[k][0] for k in keys], dtype=np.int32)
        self.made = np.array([pairs[k][1] for k in keys], dtype=np.int32)
        every = np.arange(256)
        self.byte_ranks = self.rank_of(self.singles[np.repeat(every, 256)], self.singles[np.tile(every, 256)]).reshape(256, 256).astype(np.int32)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one piece: the pair of lowest rank is merged, the leftmost of equals first, until none is left."""
        if self.whole is not None and (known := self.whole.get(piece)) is not None:
            return (known,)
        ids = [self.single[b] for b in piece]
        if len(ids) > LONG:
            return self._merge_long(ids)
        pairs, none = self.pairs, (1 << 60, -1)
        found = [pairs.get(p, none) for p in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best is none or best[1] < 0:
                break
            i = found.index(best)
            ids[i : i + 2] = [best[1]]
            del found[i]
            if i < len(found):
                found[i] = pairs.get((ids[i], ids[i + 1]), none)
            if i:
                found[i - 1] = pairs.get((ids[i - 1], ids[i]), none)
        return tuple(ids)

    def _merge_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same with a heap over a linked list: n log n steps for a piece of n bytes."""
        pairs, n = self.pairs, len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(p[0], i, ids[i], ids[i + 1], p[1]) for i in range(n - 1) if (p := pairs.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] >= 0 and (p := pairs.get((ids[x], ids[after[x]]))):
                    heapq.heappush(heap, (p[0], x, ids[x], ids[after[x]], p[1]))
        return tuple(x for x in ids if x >= 0)

    def remember(self, pieces: list[str]) -> None:
        """Merge new pieces side by side and file their ids: in each round every piece merges its best pair.

        Pieces of similar length share a matrix of ids and one of the ranks of neighbouring pairs.
        """
        raw = [p.encode() for p in pieces]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        blob, starts = np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum(sizes) - sizes
        width = -(-sizes // 4) * 4
        width[sizes > LONG] = 0
        if self.whole is not None:
            known = np.fromiter((self.whole.get(r, -1) for r in raw), dtype=np.int64, count=len(raw))
            width[known >= 0] = -1
        for w in np.unique(width).tolist():
            members = np.flatnonzero(width == w)
            for at in range(0, len(members), 8192):
                part = members[at : at + 8192]
                if w == -1:
                    ids, counts = known[part], np.ones(len(part), dtype=np.int64)
                elif w == 0:
                    merged = [self.merge(raw[n]) for n in part]
                    ids, counts = np.fromiter(chain.from_iterable(merged), dtype=np.int64), np.fromiter(map(len, merged), dtype=np.int64)
                else:
                    counts, place = sizes[part], np.arange(w)
                    rows = self._merge_rows(blob[np.minimum(starts[part, None] + place, len(blob) - 1)], counts)
                    ids = rows[place < counts[:, None]]
                self._file([pieces[n] for n in part], ids, counts)

    def _file(self, pieces: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        """Give pieces the next numbers, and their ids the next places of the flat table."""
        first, used = len(self.cache), self.used
        while used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while first + len(counts) > len(self.counts):
            self.counts, self.starts = (np.concatenate([x, np.empty_like(x)]) for x in (self.counts, self.starts))
        self.flat[used : used + len(ids)] = ids
        self.counts[first : first + len(counts)] = counts
        self.starts[first : first + len(counts)] = used + np.cumsum(counts) - counts
        self.used = used + len(ids)
        self.cache.update(zip(pieces, range(first, first + len(pieces))))

    def _merge_rows(self, raw: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Ids of the rows of bytes, in place of the first ``sizes`` entries; ``sizes`` shrinks as pairs merge."""
        width, place = raw.shape[1], np.arange(raw.shape[1])
        all_ids = self.singles[raw]
        ranks = self.byte_ranks[raw[:, :-1], raw[:, 1:]]
        ranks[place[None, 1:] >= sizes[:, None]] = NEVER
        rows, ids = np.arange(len(raw)), all_ids.copy()
        while len(rows):
            best = ranks.argmin(axis=1)
            each = np.arange(len(rows))
            live = ranks[each, best] < NEVER
            if not live.all():
                all_ids[rows[~live]] = ids[~live]
                rows, ids, ranks, best = rows[live], ids[live], ranks[live], best[live]
                each = each[: len(rows)]
                if not len(rows):
                    break
            made = self.made_of(ids[each, best], ids[each, best + 1])
            ids = np.take_along_axis(ids, np.minimum(place + (place > best[:, None]), width - 1), axis=1)
            ids[each, best] = made
            sizes[rows] -= 1
            ranks = np.take_along_axis(ranks, np.minimum(place[:-1] + (place[:-1] > best[:, None]), width - 2), axis=1)
            ranks[:, -1] = NEVER
            now = sizes[rows]
            right = best + 1 < now
            ranks[each[~right], np.minimum(best[~right], width - 2)] = NEVER
            ranks[each[right], best[right]] = self.rank_of(ids[each[right], best[right]], ids[each[right], best[right] + 1])
            left = best > 0
            ranks[each[left], best[left] - 1] = self.rank_of(ids[each[left], best[left] - 1], ids[each[left], best[left]])
        return all_ids

    def _at(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return at, self.keys[at] == key

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at, known = self._at(a, b)
        return np.where(known, self.ranks[at], NEVER)

    def made_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.made[self._at(a, b)[0]]

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts): the ids of all pieces in order, and how many each has. Pieces not remembered are merged together."""
        if len(self.cache) > CACHE or self.used > 16 * CACHE:
            self.cache, self.used, self.flat, self.counts, self.starts = {}, 0, self.flat[:1024], self.counts[:1024], self.starts[:1024]
        numbers = list(map(self.cache.get, pieces))
        if None in numbers:
            missing = [i for i, n in enumerate(numbers) if n is None]
            self.remember(list({pieces[i] for i in missing}))
            for i in missing:
                numbers[i] = self.cache[pieces[i]]
        numbers = np.array(numbers, dtype=np.int64)
        counts = self.counts[numbers]
        ends = np.cumsum(counts)
        return self.flat[np.repeat(self.starts[numbers] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)], counts

    def decode(self, ids: pa.Array) -> pa.Array:
        """The bytes of each id; an id without a token is an error."""
        if len(ids) and (pc.min(ids).as_py() < 0 or pc.max(ids).as_py() >= len(self.bytes)):
            raise ValueError("an id is not in the vocabulary")
        return self.bytes.take(ids)


@lru_cache(4)
def from_ranks(path: str) -> Vocabulary:
    """A vocabulary of lines with base64 bytes and a rank; the rank is the id, and a pair's rank that of its bytes together."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    pairs = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                pairs[a, b] = (rank, rank)
    return Vocabulary({i: b for b, i in ranks.items()}, pairs, ranks)


@lru_cache(4)
def from_json(path: str) -> Vocabulary:
    """A vocabulary with an ordered list of merges, its tokens written in the usual printable stand-ins for bytes."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    vocab = model["vocab"]
    pairs = {}
    for rank, pair in enumerate(model["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
    tokens = {i: bytes(back[c] for c in t) for t, i in vocab.items() if all(c in back for c in t)}
    return Vocabulary(tokens, pairs, None)


@lru_cache(4)
def added_tokens(path: str) -> dict[str, int]:
    """The tokens that a vocabulary file adds to its model and that are sought in texts as they stand."""
    with open(path, encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


def batches_of(texts: list[str]):
    """(from, to) of stretches of texts that are worked on together."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if i > start and (i - start >= BATCH or held + len(t) > BATCH_CHARS):
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def encoded(texts: list[str], vocabulary: Vocabulary):
    """For each text its pieces, all their ids, and how many each piece has."""
    pieces = list(pretokens.pieces(texts))
    ids, counts = vocabulary.encode(list(chain.from_iterable(pieces)))
    piece_ends = np.cumsum([0, *map(len, pieces)])
    id_ends = np.concatenate([[0], np.cumsum(counts)])[piece_ends]
    return [(p, ids[a:b], counts[c:d]) for p, a, b, c, d in zip(pieces, id_ends, id_ends[1:], piece_ends, piece_ends[1:])]


def starts(pieces: list[str]) -> np.ndarray:
    """Where each piece starts in its text, in code points."""
    return np.cumsum([0, *map(len, pieces)])[:-1]


def decoded(ids: np.ndarray, offsets: np.ndarray, counts: np.ndarray, vocabulary: Vocabulary) -> bytes:
    """The bytes of a text from its ids: each piece's must begin at the code point that was retained for it, or the row is damaged."""
    found = vocabulary.decode(pa.array(ids, type=pa.int32()))
    ends = np.frombuffer(found.buffers()[1], dtype=np.int32)[: len(found) + 1] if len(found) else np.zeros(1, np.int32)
    blob = found.buffers()[2].to_pybytes()[: ends[-1]] if len(found) else b""
    if len(counts):
        points = np.concatenate([[0], np.cumsum((np.frombuffer(blob, dtype=np.uint8) & 0xC0) != 0x80)])
        begins = ends[np.cumsum(counts) - counts]
        if not np.array_equal(points[begins], offsets):
            raise ValueError("ids and offsets do not belong together")
    return blob


def _lists(parts) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int32))).cast(pa.list_(pa.int32()))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids, offsets, counts): the ids of every whole text by the ranks in the file at ``path``.

    offsets holds where each piece starts in the text (code points) and counts how many ids it has. Null and empty texts have no ids; very long texts are encoded
    whole; null and repeated ids keep their rows; other columns are ignored; an empty table gives an empty result. ``path`` must exist on every executor.
    """
    schema = T.StructType([docs.schema[id_col], *(T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("ids", "offsets", "counts"))])

    def run(batches):
        vocabulary = from_ranks(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for a, e in batches_of(texts):
                found = encoded(texts[a:e], vocabulary)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, e - a), _lists([ids for _, ids, _ in found]), _lists([starts(p) for p, _, _ in found]), _lists([n for _, _, n in found])], names=schema.names)

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """``tokens`` with a binary column ``decoded``: the bytes that its columns ids, offsets and counts stand for.

    Offsets place each piece: ids that do not fit them are an error, as is an id that the vocabulary has not.
    """
    schema = T.StructType([*tokens.schema.fields, T.StructField("decoded", T.BinaryType())])
    at = [tokens.columns.index(c) for c in ("ids", "offsets", "counts")]

    def run(batches):
        vocabulary = from_ranks(path)
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                b = whole.slice(start, BATCH)
                numbers = lambda x: np.asarray(x.values, dtype=np.int32)
                rows = zip(*(map(numbers, b.column(i)) for i in at))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([decoded(*r, vocabulary) for r in rows], type=pa.binary())], names=schema.names)

    return tokens.mapInArrow(run, schema)


def digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_pieces) of a round trip: encoding, and decoding of the ids by the offsets that were retained.

    Both ends of the trip run in one worker, so that only digests are passed on. Rows are treated as ``encode`` says.
    """
    schema = T.StructType([docs.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("n_pieces", T.LongType())])

    def run(batches):
        vocabulary = from_ranks(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for a, e in batches_of(texts):
                out = []
                for pieces, ids, counts in encoded(texts[a:e], vocabulary):
                    back = decoded(ids, starts(pieces), counts, vocabulary)
                    out.append((len(ids), sha256(",".join(map(str, ids.tolist())).encode()).hexdigest(), sha256(back).hexdigest(), len(pieces)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, e - a), *map(pa.array, zip(*out))], names=schema.names)

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)
