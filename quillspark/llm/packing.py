"""Packing documents into sequences of bounded length by a distributed grouping genetic algorithm.

Pieces are dealt at random to islands of bounded size. Each island evolves packings of its own pieces: a crossover
injects whole well-filled sequences of one parent into the other, removes duplicates, and best-fits the displaced
pieces. Between epochs every island sends its elite's well-filled sequences (as lists of lengths) to the next, which rebuilds
them from pieces of its own. In the end the badly filled sequences of neighbouring islands are emptied and packed together,
round by round; an island passes on no more pieces than its share of one island, the worst filled first, so that no group grows. Evolution ends where
a packing has as few sequences as a lower bound allows, or after generations without a better one.
"""

from __future__ import annotations

import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import bpe
from quillspark.llm.common import drop, materialize, tidy

#: Pieces an island holds, about.
ISLAND = 16_384
#: Islands whose leftovers meet in one round.
FAN_IN = 16
#: A sequence below this share of the capacity is emptied and packed again with its neighbours'.
WELL_FILLED = 0.98
#: Longer texts are encoded without a pattern engine.
LONG_TEXT = 1 << 20
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
POPULATION, EPOCHS = 4, 2
#: Crossovers of an island: at least the first number, and so many that about the second number of pieces are placed, but not more than the third.
GENERATIONS, PLACED, MOST_GENERATIONS = 6, 100_000, 60


def fewest(lengths: list[int], capacity: int) -> int:
    """A lower bound of the number of sequences (Martello and Toth's L2): for each k, pieces over capacity - k share with none of k or more."""
    counts = np.bincount(np.asarray(lengths, dtype=np.int64), minlength=capacity + 1)
    number, weight = np.cumsum(counts), np.cumsum(counts * np.arange(capacity + 1))
    half = capacity // 2
    k = np.arange(1, half + 1)
    alone = number[capacity] - number[capacity - k]
    large, large_weight = number[capacity - k] - number[half], weight[capacity - k] - weight[half]
    small_weight = weight[half] - weight[k - 1]
    more = -(-np.maximum(0, small_weight - (large * capacity - large_weight)) // capacity)
    return int(max(-(-weight[capacity] // capacity), (alone + large + more).max(initial=0)))


class Packing:
    """Bins of item numbers with their fills; ``place`` is best fit with one list of bins for each free length."""

    def __init__(self, capacity: int):
        self.capacity, self.bins, self.fill = capacity, [], []
        self.levels, self.mask = {}, 0

    def add(self, items: list[int], fill: int) -> None:
        self._file(len(self.bins), self.capacity - fill)
        self.bins.append(items)
        self.fill.append(fill)

    def _file(self, b: int, free: int) -> None:
        if free:
            self.levels.setdefault(free, []).append(b)
            self.mask |= 1 << free

    def place(self, order, lengths) -> None:
        for i in order:
            size = lengths[i]
            fits = self.mask >> size
            if not fits:
                self.add([i], size)
                continue
            free = size + (fits & -fits).bit_length() - 1
            level = self.levels[free]
            b = level.pop()
            if not level:
                self.mask ^= 1 << free
            self.bins[b].append(i)
            self.fill[b] += size
            self._file(b, free - size)

    def fitness(self):
        return -len(self.bins), sum(f * f for f in self.fill)


def _of(bins: list[list[int]], lengths, capacity: int) -> Packing:
    p = Packing(capacity)
    for b in bins:
        p.add(list(b), sum(lengths[i] for i in b))
    return p


def exact_fill(lengths: list[int], capacity: int, descending: list[int]) -> Packing:
    """A packing that opens each bin with the largest item left and looks for one, two or three items that fill it exactly.

    Of two items it takes the most alike, so that small ones stay for later bins; where nothing fits exactly, the largest that fits.
    """
    by_length: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in descending:
        by_length[lengths[i]].append(i)
    there = np.array([bool(b) for b in by_length])
    out, size = Packing(capacity), capacity

    def take(n: int) -> int:
        i = by_length[n].pop()
        there[n] = bool(by_length[n])
        return i

    def two(free: int) -> tuple[int, int] | None:
        half = np.flatnonzero(there[1 : free // 2 + 1] & there[free - 1 : free - free // 2 - 1 : -1]) + 1 if free > 1 else ()
        if len(half) and 2 * half[-1] == free and len(by_length[half[-1]]) < 2:
            half = half[:-1]
        return (int(half[-1]), free - int(half[-1])) if len(half) else None

    while size > 0:
        while size > 0 and not by_length[size]:
            size -= 1
        if not size:
            break
        items, free = [take(size)], capacity - size
        while free > 0:
            if by_length[free]:
                items.append(take(free))
                free = 0
            elif pair := two(free):
                items += [take(n) for n in pair]
                free = 0
            else:
                fitting = np.flatnonzero(there[1:free]) + 1
                if not len(fitting):
                    break
                best = next((n for n in fitting[:-9:-1].tolist() if (p := two(free - n)) and n not in p), int(fitting[-1]))
                items.append(take(best))
                free -= best
        out.add(items, capacity - free)
    if by_length[0]:
        out.place(by_length[0], lengths)
    return out


def crossover(one: Packing, other: Packing, lengths, descending: list[int], rng: random.Random) -> Packing:
    """A child with a random half of ``one``'s well-filled bins whole, ``other``'s bins without duplicates, and the rest by best fit."""
    capacity, child = one.capacity, Packing(one.capacity)
    taken = set()
    for b, fill in zip(one.bins, one.fill):
        if fill >= WELL_FILLED * capacity and rng.random() < 0.5:
            child.add(list(b), fill)
            taken.update(b)
    for b, fill in zip(other.bins, other.fill):
        if fill >= WELL_FILLED * capacity and taken.isdisjoint(b):
            child.add(list(b), fill)
            taken.update(b)
    child.place([i for i in descending if i not in taken], lengths)
    return child


def settle(migrants: list[tuple[int, ...]], lengths, descending: list[int], capacity: int) -> Packing:
    """A packing that rebuilds the migrants' bins from items of the same lengths, as far as there are any, and best-fits the rest."""
    by_length: dict[int, list[int]] = {}
    for i in descending:
        by_length.setdefault(lengths[i], []).append(i)
    child, taken = Packing(capacity), set()
    for pattern in migrants:
        items = []
        for size in pattern:
            if not by_length.get(size):
                break
            items.append(by_length[size].pop())
        if len(items) == len(pattern):
            child.add(items, sum(pattern))
            taken.update(items)
        else:
            for i in items:
                by_length[lengths[i]].append(i)
    child.place([i for i in descending if i not in taken], lengths)
    return child


def evolve(lengths: list[int], capacity: int, elite: list[list[int]] | None = None, migrants: list[tuple[int, ...]] = (), seed: int = 0) -> list[list[int]]:
    """Bins of item numbers. Stops as soon as no packing can have fewer bins."""
    if not lengths:
        return []
    least, rng = fewest(lengths, capacity), random.Random(seed)
    descending = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    greedy = Packing(capacity)
    greedy.place(descending, lengths)
    people = [greedy]
    if len(greedy.bins) > least:
        people.append(exact_fill(lengths, capacity, descending))
    if elite:
        people.append(_of(elite, lengths, capacity))
    if migrants and min(len(p.bins) for p in people) > least:
        people.append(settle(migrants, lengths, descending, capacity))
    if min(len(p.bins) for p in people) > least:
        while len(people) < POPULATION:
            noisy = Packing(capacity)
            noisy.place(sorted(descending, key=lambda i: -lengths[i] * rng.uniform(0.8, 1.0)), lengths)
            people.append(noisy)
        for _ in range(max(GENERATIONS, min(MOST_GENERATIONS, PLACED // len(lengths)))):
            people.sort(key=Packing.fitness, reverse=True)
            if len(people[0].bins) <= least:
                break
            one, other = people[0], rng.choice(people[1:])
            if rng.random() < 0.5:
                one, other = other, one
            people = [*people[: POPULATION - 1], crossover(one, other, lengths, descending, rng)]
    return max(people, key=Packing.fitness).bins


@lru_cache(2)
def encoder(path: str):
    """A function from a text to its ids (unsigned 32-bit) in the vocabulary at ``path``; the file's added tokens are found in texts, none is added.

    The same ids as the library that the file is for gives, by another that is three times as fast on the same ranks; its
    pattern engine may give up on enormous runs, so very long texts are cut into pieces by ``pretokens``.
    """
    own, special = bpe.from_json(path), bpe.added_tokens(path)
    fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={b: i for i, b in own.tokens.items() if i not in special.values()}, special_tokens=special)
    apart = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def ids(text: str) -> np.ndarray:
        if len(text) <= LONG_TEXT:
            return fast.encode_to_numpy(text, allowed_special="all")
        parts = apart.split(text) if apart else [text]
        found = [np.array([special[p]], dtype="<u4") if p in special else bpe.encoded([p], own)[0][1].astype("<u4") for p in parts]
        return np.concatenate([np.zeros(0, dtype="<u4"), *found])

    return ids


def pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, uid): each document's ids and then ``end_id``, cut where longer than ``capacity``.

    The pieces of a cut document are full but for the first. Null texts are empty and still have their end id. ``path``
    is a vocabulary file with merges, present on every executor; uid is different for every row of the result.
    """
    schema = T.StructType([docs.schema[id_col], T.StructField("piece", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "uid"))])

    def run(batches):
        ids_of, uid = encoder(path), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b, row, out = whole.slice(at, 512), [], []
                for n, text in enumerate(b.column(1).to_pylist()):
                    ids = np.append(ids_of(text or ""), np.array([end_id], dtype="<u4"))
                    cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                    for p, (a, e) in enumerate(zip(cuts, cuts[1:])):
                        row.append(n)
                        out.append((p, a, e - a, zlib.crc32(ids[a:e].tobytes()), uid))
                        uid += 1
                columns = np.array(out, dtype=np.int64).reshape(-1, 5)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, type=pa.int64())), pa.array(columns[:, 0].astype(np.int32)), *(pa.array(columns[:, i]) for i in range(1, 5))], names=[f.name for f in schema])

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(tidy(run), schema)


def pack(items: DataFrame, capacity: int = 1024, length_col: str = "length", uid_col: str = "uid") -> DataFrame:
    """``items`` with sequence_id and offset: every item in one sequence, gapless from 0, no sequence longer than ``capacity``.

    ``uid_col`` must differ in every row; lengths must be from 0 to ``capacity``. Items of full length are sequences of their own.
    No task ever holds more than about two islands, whatever the lengths. An empty table gives an empty result.
    """
    spark, columns = items.sparkSession, items.columns
    alone = items.where(F.col(length_col) >= capacity).withColumn("sequence_id", -1 - F.col(uid_col)).withColumn("offset", F.lit(0).cast("long"))
    rest = items.where(F.col(length_col) < capacity)
    islands = -(-rest.count() // ISLAND)
    if not islands:
        return alone
    schema = T.StructType([*rest.schema.fields, *(T.StructField(n, T.LongType()) for n in ("island", "bin", "offset"))])

    def placed(rows: pd.DataFrame, bins: list[list[int]], island: int) -> pd.DataFrame:
        lengths, where, offset = rows[length_col].to_numpy(), np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
        for n, b in enumerate(bins):
            where[b] = n
            offset[b] = np.cumsum(lengths[b]) - lengths[b]
        return rows.assign(island=np.int64(island), bin=where, offset=offset)[schema.names]

    def epoch(key, rows: pd.DataFrame, guests: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(uid_col, ignore_index=True)
        elite = [list(v) for v in rows.groupby("bin").indices.values()] if "bin" in rows and len(rows) else None
        migrants = sorted(tuple(map(int, p)) for p in guests["lengths"])
        return placed(rows, evolve(rows[length_col].tolist(), capacity, elite, migrants, seed=int(key[0])), int(key[0]))

    def together(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(uid_col, ignore_index=True)
        elite = [list(v) for v in rows.groupby(["island", "bin"]).indices.values()]
        return placed(rows, evolve(rows[length_col].tolist(), capacity, elite, seed=int(key[0])), int(key[0]))

    dealt = rest.withColumn("island", F.pmod(F.xxhash64(uid_col), F.lit(islands)).cast("long"))
    none = spark.createDataFrame([], "island long, lengths array<long>")
    now, path = materialize(dealt.groupBy("island").cogroup(none.groupBy("island")).applyInPandas(epoch, schema), "islands")
    for _ in range(EPOCHS - 1 if islands > 1 else 0):
        filled = now.groupBy("island", "bin").agg(F.sort_array(F.collect_list(length_col), asc=False).alias("lengths"), F.sum(length_col).alias("fill"))
        sent = filled.where(F.col("fill") >= WELL_FILLED * capacity).select(F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), "lengths")
        new, new_path = materialize(now.drop("offset").groupBy("island").cogroup(sent.groupBy("island")).applyInPandas(epoch, schema), "islands")
        drop(spark, path)
        now, path = new, new_path
    settled, level, open_items = [], 0, now
    while True:
        number = (F.lit(level).cast("long") * (1 << 56)) + F.col("island") * (1 << 24) + F.col("bin")
        if islands == 1:
            settled.append(open_items.withColumn("sequence_id", number))
            break
        # the worst filled sequences of each island go on, as many as together have no more than an island's pieces in a region
        bins = open_items.groupBy("island", "bin").agg(F.sum(length_col).alias("fill"), F.count("*").alias("held")).where(F.col("fill") < WELL_FILLED * capacity)
        pieces_before = F.sum("held").over(Window.partitionBy("island").orderBy("fill", "bin"))
        going = bins.where(F.col("held") <= ISLAND // FAN_IN).withColumn("before", pieces_before).where(F.col("before") <= ISLAND // FAN_IN).select("island", "bin")
        going, _ = materialize(going, "going")
        settled.append(open_items.join(going, ["island", "bin"], "left_anti").withColumn("sequence_id", number))
        left = open_items.join(going, ["island", "bin"], "left_semi").drop("offset").withColumn("region", F.floor(F.col("island") / FAN_IN))
        open_items, _ = materialize(left.groupBy("region").applyInPandas(together, schema), "regions")
        islands, level = -(-islands // FAN_IN), level + 1
    out = alone
    for s in settled:
        out = out.unionByName(s.select(*columns, "sequence_id", "offset"))
    return out


def packed(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset) of all documents; repeated rows are packed as often as they occur, other columns are ignored."""
    cut, _ = materialize(pieces(docs, path, capacity, end_id, id_col, text_col), "pieces")
    return pack(cut, capacity).drop("uid")
