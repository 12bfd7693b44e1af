"""SimHash near-duplicates found by multi-index hashing.

A fingerprint is one or more 64-bit words of majority bits over the hashes of a text's word shingles.
Equal fingerprints are one class from the start, so that copies cost one row however many they are.

Exact linking (``link_exact``): a 64-bit fingerprint has two segments of 32 bits. Two fingerprints at two or fewer differing bits differ in at most
one bit of one segment. A table holds each fingerprint under both segments; each fingerprint enumerates the ball of radius one in each segment,
fetches the table's matches, and their complete distances are verified. A segment's value that more than CROWD fingerprints have is not
fetched: its members and those that ask for it meet by the balls of radius one round their whole words, of which a group never holds more than 65.

Linking by sets (``link_sets``) is for similarities well below one. It searches in the same way (``matches``): a table holds the fingerprint of each set under
its segments, each set enumerates the ball of radius one in each segment and fetches the table's matches, and complete distances over 256 bits are verified.
At a Jaccard similarity of 0.8 a fingerprint differs in every seventh bit, so segments find only some of the pairs (97 % of them would cost some 300 keys a
text). The rest is found exactly, over the sets of shingles themselves: all shingles are put in one order, by how common they are; texts of a similarity t
share one of the first n - ceil(t n) + 1 of their n shingles, some 100 keys for an average text, so texts that share none, or the first one too late in the
order, are never compared. Each text is compared with the nearest of its matches and with the hubs of its keys; members of a key that are not connected
by this are compared with one another, in blocks. However a pair was found, complete distances pass it on, and its similarity is computed from both sets.
"""

from __future__ import annotations

import math
from functools import partial, reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import boxed, drop, materialize, tidy
from quillspark.llm.components import connected_components

_CHUNK = 1 << 16
_MASK = (1 << 64) - 1
#: Counts, by the highest bits of a shingle's hash, that put shingles in order: a table of fixed size, whose errors cost time but no pair.
ORDER_BITS = 18
#: Bits that are kept of the hashes of a set: two hashes of a set of 20000 are alike with a chance of one in ten thousand.
HASH_BITS = 40
#: Bits of a segment.
SEGMENT = 32
#: Fingerprints of one segment value from which on it is split by whole words.
CROWD = 64
#: Words of the fingerprints of sets, and the distance up to which a pair is passed on. At a similarity of 0.8 the distance is 39 on average with a
#: deviation of 6, so a pair is lost with a chance below 1e-7. Sets of fewer than SMALL shingles, whose bits are coarser, are all passed on.
SET_WORDS, FAR, SMALL = 4, 72, 64
#: The same for the first word alone, which pairs are tried by as they are made: 10 on average with a deviation of 3.
FAR_WORD = 28
#: Words of these fingerprints whose segments are looked up, and sets that the table holds of one segment value at most: others are found by their shingles.
SEGMENT_WORDS, HELD = 2, 16
#: Members of a key that are compared with others as one block.
BLOCK = 256
#: Rows that a worker treats together.
SLICE = 512
#: Bits of a bitmap at most (8 MB): beyond some millions of hashes it lets more and more others pass.
MOST_BITS = 26


def _mixed(h: np.ndarray, word: int) -> np.ndarray:
    """An independent hash from ``h`` for each further word (the finaliser of splitmix64)."""
    if not word:
        return h
    x = h + np.uint64(word * 0x9E3779B97F4A7C15 & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(text: str | None, shingle: int, seed: int):
    """The number of shingles of a text and their hashes, chunk by chunk."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0, iter(())
    n = max(1, len(tokens) - shingle + 1)
    joined = map(b" ".join, zip(*(islice(tokens, i, None) for i in range(shingle)))) if len(tokens) >= shingle else iter([b" ".join(tokens)])
    hashed = map(partial(xxhash.xxh64_intdigest, seed=seed), joined)
    return n, (np.fromiter(islice(hashed, _CHUNK), dtype=np.uint64, count=min(_CHUNK, n - at)) for at in range(0, n, _CHUNK))


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42, words: int = 1) -> list[int]:
    """The fingerprint words of one text as signed 64-bit integers.

    Words are runs of other characters than U+0020 and U+0009 to U+000D, A-Z lower-cased. A text
    with fewer words than a shingle is one shingle; null or without words it has all bits 0. Texts
    are worked through in chunks, so memory beyond the words themselves is constant.
    """
    n, hashed = _hashes(text, shingle, seed)
    if not n:
        return [0] * words
    counts = np.zeros((words, 64), dtype=np.int64)
    for h in hashed:
        for w in range(words):
            counts[w] += np.unpackbits(_mixed(h, w).astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > n, axis=1, bitorder="little").view("<i8").ravel().tolist()


def shingle_set(text: str | None, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """The different hashes of the shingles of one text in rising order; none without words."""
    return reduce(np.union1d, _hashes(text, shingle, seed)[1], np.empty(0, dtype=np.uint64))


def fingerprints(docs: DataFrame, keys: list[str], text_col: str = "text", shingle: int = 3, seed: int = 42, words: int = 1) -> DataFrame:
    """(keys, f0, f1, ...): one row for each row of ``docs``, with its fingerprint words."""
    made = [f"f{w}" for w in range(words)]
    schema, n = T.StructType([*(docs.schema[k] for k in keys), *(T.StructField(c, T.LongType()) for c in made)]), len(keys)

    def run(batches):
        for b in batches:
            found = np.array([fingerprint(t.as_py(), shingle, seed, words) for t in b.column(n)], dtype=np.int64).reshape(-1, len(made))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *(pa.array(found[:, w]) for w in range(len(made)))], names=[f.name for f in schema])

    return docs.select(*keys, F.col(text_col).cast("string").alias("_t")).mapInArrow(tidy(run), schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _numbered(x):
    """A segment's value and number as one long."""
    return F.shiftleft(F.col("s").cast("long"), 40).bitwiseOR(x)


def _segments(prints: DataFrame, words: list[str]) -> DataFrame:
    """(u, s, x): the number and value of each 32-bit segment of the given words of each row."""
    low = F.lit((1 << SEGMENT) - 1)
    halves = [h for w in words for h in (F.col(w).bitwiseAND(low), F.shiftrightunsigned(w, SEGMENT))]
    segments = F.array(*(F.struct(F.lit(s).alias("s"), x.alias("x")) for s, x in enumerate(halves)))
    return prints.select("u", F.explode(segments).alias("g")).select("u", F.col("g.s").alias("s"), F.col("g.x").alias("x"))


def _table(split: DataFrame) -> DataFrame:
    """(key, v): each row under its segments."""
    return split.select(_numbered(F.col("x")).alias("key"), F.col("u").alias("v"))


def _asked(split: DataFrame) -> DataFrame:
    """(u, key): the balls of radius one round the segments, of which only values with one bit more are asked for: who has one less asks itself."""
    bits = F.array(*(F.lit(1 << b) for b in range(SEGMENT)))
    missing = F.filter(bits, lambda b: F.col("x").bitwiseAND(b) == 0)
    ball = F.concat(F.array(F.col("x")), F.transform(missing, lambda b: F.col("x").bitwiseOR(b)))
    return split.select("u", "s", F.explode(ball).alias("y")).select("u", _numbered(F.col("y")).alias("key"))


def link_exact(classes: DataFrame, column: str = "f0") -> DataFrame:
    """Edges (u, v) that connect exactly the different fingerprints at two or fewer bits. ``classes`` has each fingerprint once.

    Of two fingerprints that differ in one bit of a segment only the one that lacks the bit asks for it.
    """
    split = _segments(classes.select(F.col(column).alias("u")), ["u"])
    table, asked = _table(split), _asked(split)
    crowded, _ = materialize(table.groupBy("key").count().where(F.col("count") > CROWD).select("key"), "crowded")
    near = (F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2)
    edges = asked.join(table.join(crowded, "key", "left_anti"), "key").where(near).select("u", "v")
    # what a crowded value has or is asked by meets by whole words
    flips = F.array(*(F.lit(_signed(x)) for x in [0, *(1 << b for b in range(64))]))
    many = asked.join(crowded, "key", "left_semi").select("u").distinct()
    words = many.select("u", F.explode(flips).alias("flip")).select("u", F.col("u").bitwiseXOR(F.col("flip")).alias("key"))
    chained = words.select("u", F.lag("u").over(Window.partitionBy("key").orderBy("u")).alias("v")).where(F.col("v").isNotNull() & near)
    return edges.unionByName(chained)


def set_fingerprint(hashes: np.ndarray) -> list[int]:
    """SET_WORDS words of majority bits over the hashes of a set."""
    counts = [np.unpackbits(_mixed(hashes, w).astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for w in range(SET_WORDS)]
    return np.packbits(np.array(counts) * 2 > len(hashes), axis=1, bitorder="little").view("<i8").ravel().tolist()


def _sliced(batches):
    """Batches of no more than SLICE rows, so that a worker holds few sets at a time."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


_PRINT = [f"p{w}" for w in range(SET_WORDS)]


def shingle_sets(docs: DataFrame, keys: list[str], text_col: str = "text", shingle: int = 5, seed: int = 42) -> DataFrame:
    """(keys, d, n, hashes, p0, ...): the shingle set of each row of ``docs`` (40 bits of each hash, packed), its size, a digest d that tells sets apart, and its fingerprint."""
    added = [T.StructField("d", T.LongType()), T.StructField("n", T.LongType()), T.StructField("hashes", T.BinaryType()), *(T.StructField(p, T.LongType()) for p in _PRINT)]
    schema, n = T.StructType([*(docs.schema[k] for k in keys), *added]), len(keys)

    def run(batches):
        for b in _sliced(batches):
            sets = [shingle_set(t.as_py(), shingle, seed) for t in b.column(n)]
            digest = np.array([_mixed(x, 1).sum(dtype=np.uint64) for x in sets], dtype=np.uint64).view(np.int64)
            size = np.array([len(x) for x in sets], dtype=np.int64)
            prints = np.array([set_fingerprint(x) for x in sets], dtype=np.int64).reshape(-1, SET_WORDS)
            packed = [(x >> np.uint64(64 - HASH_BITS)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : HASH_BITS // 8].tobytes() for x in sets]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(digest), pa.array(size), pa.array(packed, type=pa.binary()), *(pa.array(prints[:, w]) for w in range(SET_WORDS))], names=[f.name for f in schema])

    return docs.select(*keys, F.col(text_col).cast("string").alias("_t")).mapInArrow(tidy(run), schema)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return hashes >> HASH_BITS - ORDER_BITS


def _values(column) -> np.ndarray:
    """The hashes of all sets of a packed column, one after the other."""
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    if not len(column) or ends[0] == ends[-1]:
        return np.zeros(0, dtype=np.int64)
    raw = np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].reshape(-1, HASH_BITS // 8)
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, : raw.shape[1]] = raw
    return out.view("<i8").ravel()


def _common(sets: DataFrame) -> np.ndarray:
    """How many shingles of all sets fall into each bucket."""

    def run(batches):
        counts = np.zeros(1 << ORDER_BITS, dtype=np.int64)
        for b in batches:
            counts += np.bincount(_bucket(_values(b.column(0))), minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["at", "c"])

    found = sets.select("hashes").mapInArrow(tidy(run), "at long, c long").groupBy("at").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(1 << ORDER_BITS, dtype=np.int64)
    out[found["at"].to_numpy()] = found["c"].to_numpy()
    return out


def marked(rows: DataFrame, h: str, hashes: DataFrame) -> DataFrame:
    """``rows`` with a boolean ``found``: true where the long in column ``h`` is one of ``hashes.h``, and for few others.

    The hashes are set as bits of a map of at most 2**MOST_BITS bits, of which the words that are not zero are broadcast: no more than 2**(MOST_BITS - 6) rows,
    16 MB, whatever the data. So the rows that can't match need no shuffle.
    """
    bits = min(MOST_BITS, max(16, (16 * hashes.count()).bit_length()))
    place = lambda c: F.shiftrightunsigned(c, 64 - bits)
    bit = lambda c: F.expr(f"CAST(shiftrightunsigned({c}, {64 - bits}) & 63 AS INT)")
    words = hashes.select(F.shiftright(place("h"), 6).alias("map_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit("h")).alias("m")).groupBy("map_word").agg(F.bit_or("m").alias("map_bits"))
    words, _ = materialize(words, "words")
    met = rows.join(F.broadcast(words), F.shiftright(place(h), 6) == F.col("map_word"), "left")
    found = F.coalesce(F.call_function("shiftright", F.col("map_bits"), bit(h)).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return met.withColumn("found", found).drop("map_word", "map_bits")


def _only(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(d, n, h) of the rows of ``sets`` that some pair needs, and of few others, so that the rest isn't shuffled. h has 32 bits of each hash."""

    def run(batches):
        for b in _sliced(batches):
            ends, values = np.append(0, np.cumsum(b.column(1).to_numpy())).astype(np.int32), _values(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.uint32).view(np.int32)))], names=["d", "n", "h"])

    own = sets.select("d", "n", "hashes", F.xxhash64("d").alias("place"))
    wanted = pairs.select(F.xxhash64("u").alias("h")).unionByName(pairs.select(F.xxhash64("v").alias("h")))
    return marked(own, "place", wanted).where("found").select("d", "n", "hashes").mapInArrow(tidy(run), "d long, n long, h array<int>")


def _prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """(u, w, key): for each set the first of its shingles, rarest first, of which sets of this similarity share one. A task tells equal sets once.

    w holds the set's size (high half) and how many of its shingles come from this one on (low half).
    """
    common = _common(sets)

    def run(batches):
        told = set()
        for b in _sliced(batches):
            values, size, names = _values(b.column(2)), b.column(1).to_numpy(), b.column(0).to_numpy()
            ends, keys, taken = np.cumsum(size), [np.empty(0, dtype=np.int64)], []
            for end, n, d in zip(ends, size, names.tolist()):
                if d in told:
                    taken.append(0)
                    continue
                told.add(d)
                x = values[end - n : end]
                keys.append(x[np.argsort(common[_bucket(x)], kind="stable")[: n - math.ceil(similarity * n - 1e-9) + 1]])
                taken.append(len(keys[-1]))
            counts = np.array(taken, dtype=np.int64)
            place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            whole = np.repeat(size, counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, counts)), pa.array(whole << 32 | whole - place), pa.array(np.concatenate(keys))], names=["u", "w", "key"])

    return sets.select("d", "n", "hashes").where("n > 0").mapInArrow(tidy(run), "u long, w long, key long")


def _possible(a, b, similarity: float):
    """Whether two sets, by their w at the first key that they share, have enough left in common: what comes before a first shared key is not shared."""
    left = lambda w: w.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.least(left(a), left(b)) >= similarity / (1 + similarity) * (F.shiftright(a, 32) + F.shiftright(b, 32)) - 1e-6


def _by_distance(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v, distance): the pairs (u, v), each once, whose fingerprints are near enough by their complete distance."""
    prints = sets.select("d", "n", *_PRINT).dropDuplicates(["d"])
    distance = sum((F.bit_count(F.col(f"u_{p}").bitwiseXOR(F.col(f"v_{p}"))) for p in _PRINT), F.lit(0))
    met = pairs.select("u", "v").distinct().join(_side(prints, "u"), "u").join(_side(prints, "v"), "v")
    return met.withColumn("distance", distance).where((F.col("distance") <= FAR) | (F.least("u_n", "v_n") < SMALL)).select("u", "v", "distance")


def _side(t: DataFrame, name: str) -> DataFrame:
    return t.select(*(F.col(x).alias(name if x == "d" else f"{name}_{x}") for x in t.columns))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets have a Jaccard similarity of ``similarity`` or more.

    First the fingerprints of both are compared; then only the sets of pairs that are left are shuffled, 32 bits of each hash.
    """
    spark = sets.sparkSession
    pairs, path = materialize(_by_distance(pairs, sets).select("u", "v"), "pairs")
    whole = _only(sets, pairs).groupBy("d").agg(F.first("n").alias("n"), F.first("h").alias("h"))
    both = F.size(F.array_intersect("u_h", "v_h"))
    near = both >= similarity * (F.col("u_n") + F.col("v_n") - both) - 1e-9
    found, _ = materialize(pairs.join(_side(whole, "u"), "u").join(_side(whole, "v"), "v").where(near).select("u", "v"), "near")
    drop(spark, path)
    return found


def matches(sets: DataFrame) -> DataFrame:
    """(u, v, distance): pairs of sets, u below v, by multi-index hashing of their fingerprints.

    A table holds the sets under the segments of their first SEGMENT_WORDS words, no more than HELD under one value; each set enumerates the ball of
    radius one in each of its segments, fetches what the table holds there, and complete distances decide. Sets without shingles are left out.
    """
    split = _segments(sets.where("n > 0").select(F.col("d").alias("u"), *_PRINT[:SEGMENT_WORDS]).dropDuplicates(["u"]), _PRINT[:SEGMENT_WORDS])
    place = F.row_number().over(Window.partitionBy("key").orderBy("v"))
    table = _table(split).withColumn("place", place).where(F.col("place") <= HELD).drop("place")
    pairs = _asked(split).join(table, "key").where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return _by_distance(pairs, sets)


def _nearest_matches(sets: DataFrame) -> DataFrame:
    """(u, v): each set that has matches, with the nearest of them, so that a large group doesn't cost all its pairs."""
    found = matches(sets)
    both = found.select("distance", F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x"))
    nearest = both.groupBy("x.u").agg(F.min(F.struct("distance", "x.v")).alias("m"))
    return nearest.select("u", F.col("m.v").alias("v"))


def link_sets(sets: DataFrame, similarity: float) -> DataFrame:
    """(node, component) of the sets, by d, that pairs of ``similarity`` or more connect with others.

    Each set is first compared with the nearest of its ``matches`` in the segment tables, and with the hubs of its keys: the member of a key that shares its
    keys with most others, which in a group of copies is the text that all are near. Two members of a key that are in one component by then need not be compared;
    all others are, so only a key that very many sets share of which no two are near costs all its pairs.
    """
    spark, by_key = sets.sparkSession, Window.partitionBy("key")
    met = _prefixes(sets, similarity).select("key", "u", "w", F.lag("u").over(by_key.orderBy("u")).alias("before"), F.min("u").over(by_key).alias("least"), F.max("u").over(by_key).alias("most"), F.count("*").over(by_key).alias("m"))
    met = met.where("most <> least AND (before IS NULL OR before <> u)").groupBy("u").agg(F.sum("m").alias("weight"), F.collect_list(F.struct("key", "w")).alias("items"))
    # one row for each set with its shared keys, no more than its prefix has
    met, met_path = materialize(met.join(sets.select(F.col("d").alias("u"), "p0").dropDuplicates(["u"]), "u"), "met")
    each = lambda t, *more: t.select("u", "p0", *more, F.explode("items").alias("i")).select(F.col("i.key").alias("key"), F.struct("u", F.col("i.w").alias("w"), "p0", *more).alias("x"))

    def possible(x, y):
        near = F.bit_count(x["p0"].bitwiseXOR(y["p0"])) <= FAR_WORD
        small = F.least(F.shiftright(x["w"], 32), F.shiftright(y["w"], 32)) < SMALL
        return (x["u"] != y["u"]) & _possible(x["w"], y["w"], similarity) & (near | small)

    hub = F.max(F.struct(F.col("x.weight"), F.col("x"))).over(by_key)["x"]
    hubs = each(met, "weight").withColumn("hub", hub).where(possible(F.col("x"), F.col("hub"))).select(F.col("x.u").alias("u"), F.col("hub.u").alias("v"))
    first = _nearest_matches(sets).unionByName(hubs).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    near = _verified(first, sets, similarity)
    linked, _ = materialize(connected_components(near), "linked")
    rest = each(met.join(linked, met["u"] == linked["node"], "left").withColumn("c", F.coalesce("component", "u")), "c")
    rest = rest.withColumns({"least": F.min("x.c").over(by_key), "most": F.max("x.c").over(by_key), "m": F.count("*").over(by_key)}).where("least <> most")
    # everything from here to the pairs stays where the keys are; a crowded key meets itself block by block
    blocks = rest.withColumn("block", F.pmod(F.xxhash64("x.u"), F.ceil(F.col("m") / BLOCK))).groupBy("key", "block").agg(F.collect_list("x").alias("ys"))
    others = F.filter("ys", lambda y: (F.col("x.c") < y["c"]) & possible(F.col("x"), y))
    pairs = rest.select("key", "x").join(blocks, "key").select("x", F.explode(others).alias("y"))
    more = _verified(pairs.select(F.least("x.u", "y.u").alias("u"), F.greatest("x.u", "y.u").alias("v")), sets, similarity)
    name = linked.select("node", "component")
    named = lambda c: F.coalesce(F.col(f"{c}_c"), F.col(c)).alias(c)
    more = more.join(name.toDF("u", "u_c"), "u", "left").join(name.toDF("v", "v_c"), "v", "left").select(named("u"), named("v"))
    joined, _ = materialize(connected_components(more), "joined")
    drop(spark, met_path)
    known = linked.join(joined.toDF("component", "whole"), "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    return known.unionByName(joined.join(linked.select("node"), "node", "left_anti"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``: fingerprints link at two or fewer differing bits.

    component_id is the smallest id reachable, a document itself included. Null and wordless texts
    have fingerprint zero and link like any other; very long texts count whole. Repeated ids give repeated rows; a null id has a row but
    never names a component (a component of null ids alone has component_id null). Other columns are ignored; an empty table gives an empty result.
    """
    prints, _ = materialize(fingerprints(docs, [id_col], text_col, shingle, seed), "simhash")
    classes = prints.groupBy("f0").agg(F.min(id_col).alias("rep"))
    linked = connected_components(link_exact(classes))
    roots = linked.join(classes, linked["node"] == classes["f0"], "inner").select("node", "component", "rep")
    named = roots.groupBy("component").agg(F.min("rep").alias("least"))
    member = roots.join(named, "component").select(F.col("node").alias("f0"), "least")
    # written, so that the last join deals out both sides itself and a class with very many copies can be split
    by_class, _ = materialize(classes.join(member, "f0", "left").select("f0", F.coalesce("least", "rep").alias("component_id")), "members")
    out = prints.join(by_class, "f0")
    return out.select(F.col(id_col), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def groups(docs: DataFrame, keys: list[str], text_col: str = "text", shingle: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """(keys, component, component_id): groups of near-duplicates by shingles of five words and a Jaccard similarity of 0.8 or more.

    Equal sets are one class from the start; texts without words (null or empty) are one class; very long texts count whole. component_id is the
    smallest first key of the group (a long); rows whose first key is null are left out. Repeated rows keep their rows; an empty table gives none.
    """
    sets, path = materialize(shingle_sets(docs.where(F.col(keys[0]).isNotNull()), keys, text_col, shingle, seed), "sets")
    linked, _ = materialize(link_sets(sets, similarity), "links")
    slim, _ = materialize(sets.select(*keys, "d"), "digests")
    drop(docs.sparkSession, path)
    classes = slim.groupBy("d").agg(F.min(keys[0]).cast("long").alias("rep"))
    joined = classes.join(linked, classes["d"] == linked["node"], "left").select("d", "rep", F.coalesce("component", "d").alias("component"))
    # a group with very many sets is aggregated before the shuffle, and only sets with a link meet the names of their groups
    least = joined.where("component <> d").groupBy("component").agg(F.min("rep").alias("rep"))
    least = least.join(classes.withColumnRenamed("rep", "own"), least["component"] == classes["d"]).select("component", F.least("rep", "own").alias("least"))
    by_class = joined.join(least, "component", "left").select("d", "component", F.coalesce("least", "rep").alias("component_id"))
    by_class, _ = materialize(by_class, "classes")
    return slim.join(by_class, "d").select(*keys, "component", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest id (and then text hash). Rows alike in id and text are one row.

    Rows with a null id all stay. Null and empty texts are one group; very long texts are compared whole; an empty table gives an empty result; other
    columns, whatever their names, are passed on. Only documents that may go, by a bitmap of bounded size, are shuffled to meet the keys of those that do.
    """
    keyed = boxed(docs, id=F.col(id_col), hash=F.xxhash64(F.col(text_col).cast("string")))
    found, _ = materialize(groups(keyed.select("id", "hash", F.col(f"row.{text_col}").alias("text")), ["id", "hash"], "text", **options), "groups")
    keys = found.groupBy("component", "component_id", "id", "hash").count()
    # only rows with the group's smallest id can stay: they are few in a group, however large it is
    head = keys.where(F.col("id").cast("long") == F.col("component_id"))
    first = head.groupBy("component").agg(F.min("hash").alias("least"))
    head = head.join(first, "component").withColumn("stays", F.col("hash") == F.col("least"))
    others = keys.where(F.col("id").cast("long") != F.col("component_id")).select("id", "hash")
    gone, _ = materialize(others.unionByName(head.where("NOT stays OR count > 1").select("id", "hash")).distinct(), "gone")
    repeated, _ = materialize(head.where("stays AND count > 1").select("id", "hash"), "repeated")
    told = marked(keyed.withColumn("place", F.xxhash64("id", "hash")), "place", gone.select(F.xxhash64("id", "hash").alias("h")))
    single = told.where("found").join(gone, ["id", "hash"], "left_anti")
    merged = told.where("found").join(repeated, ["id", "hash"], "left_semi").dropDuplicates(["id", "hash"])
    return told.where("NOT found").select("row.*").unionByName(single.select("row.*")).unionByName(merged.select("row.*"))
