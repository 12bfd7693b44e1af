import random
import zlib
from array import array
from collections import defaultdict

import public_tokenizers as P
from pyspark.accumulators import AccumulatorParam
from tokenizers import Tokenizer

from quillspark.llm import packing

PATH = P.path("byte_bpe_50k.json")


class Largest(AccumulatorParam):
    def zero(self, value):
        return 0

    def addInPlace(self, a, b):
        return max(a, b)


def check(rows, capacity=1024):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_query_on_documents(spark):
    from quillspark.llm.queries import op4_packing

    sf, tok = "/root/testdata/sf0.001", Tokenizer.from_file(PATH)
    rows = op4_packing(spark, sf).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert set(by) == set(texts)
    for d, text in texts.items():
        ids, at = tok.encode(text, add_special_tokens=False).ids + [2], 0
        for n, r in enumerate(sorted(by[d], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (n, at)
            assert r.ids_crc32 == zlib.crc32(array("I", ids[at : at + r.length]).tobytes())
            at += r.length
            assert r.length == 1024 or n == 0
        assert at == len(ids)
    total = sum(r.length for r in rows)
    assert check(rows) <= -(-total // 1024) + 1


def test_ids_equal_the_library(monkeypatch):
    rng, tok = random.Random(6), Tokenizer.from_file(PATH)
    parts = ["'s", "'", " ", "  ", "\n", "a", "The", "é", "12", "!?", "<|endoftext|>", "中", "\t"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 50))) for _ in range(2000)] + [" " * 5000 + "x", "ab" * 5000]
    for limit in (packing.LONG_TEXT, 0):
        monkeypatch.setattr(packing, "LONG_TEXT", limit)
        assert all(packing.encoder(PATH)(t).tolist() == tok.encode(t, add_special_tokens=False).ids for t in texts)


def test_islands_migrate_and_merge(spark, monkeypatch):
    monkeypatch.setattr(packing, "ISLAND", 200)
    monkeypatch.setattr(packing, "FAN_IN", 3)
    rng = random.Random(4)
    lengths = [rng.choice([rng.randint(1, 1023), rng.randint(300, 600)]) for _ in range(3000)] + [1024] * 7
    items = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "uid long, length long")
    rows = packing.pack(items).collect()
    assert sorted(r.uid for r in rows) == list(range(len(lengths)))
    best_fit = packing.Packing(1024)
    best_fit.place(sorted(range(len(lengths)), key=lambda i: -lengths[i]), lengths)
    assert check(rows) <= len(best_fit.bins) * 1.01


def test_evolution():
    rng = random.Random(2)
    for lengths in ([], [5], [1023] * 5, [512] * 8, [rng.randint(1, 1000) for _ in range(500)], [400, 300, 324] * 40):
        bins = packing.evolve(lengths, 1024, seed=1)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= 1024 for b in bins)
    lengths = [400, 300, 324] * 40
    assert len(packing.evolve(lengths, 1024, migrants=[(400, 324, 300)] * 50)) == 40


def test_bound():
    rng = random.Random(9)
    assert packing.fewest([], 1024) == 0 and packing.fewest([520, 600, 1000], 1024) == 3 and packing.fewest([512] * 8, 1024) == 4
    for _ in range(300):
        lengths = [rng.choice([rng.randint(1, 10), rng.randint(300, 800)]) for _ in range(rng.randint(1, 9))]
        best = len(lengths)

        def go(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(lengths):
                best = len(bins)
                return
            for b in range(len(bins)):
                if bins[b] + lengths[i] <= 1024:
                    go(i + 1, [*bins[:b], bins[b] + lengths[i], *bins[b + 1 :]])
            go(i + 1, [*bins, lengths[i]])

        go(0, [])
        assert packing.fewest(lengths, 1024) <= best <= len(packing.evolve(lengths, 1024))


def test_no_group_grows_where_no_sequence_can_be_filled(spark, monkeypatch):
    monkeypatch.setattr(packing, "ISLAND", 160)
    monkeypatch.setattr(packing, "FAN_IN", 4)
    rng, largest, evolve = random.Random(5), spark.sparkContext.accumulator(0, Largest()), packing.evolve

    def watched(lengths, *args, **kwargs):
        largest.add(len(lengths))
        return evolve(lengths, *args, **kwargs)

    monkeypatch.setattr(packing, "evolve", watched)
    for low, high in ((520, 1000), (1, 700)):
        lengths = [rng.randint(low, high) for _ in range(4000)]
        rows = packing.pack(spark.createDataFrame(list(enumerate(lengths)), "uid long, length long")).collect()
        assert len(rows) == 4000 and packing.fewest(lengths, 1024) <= check(rows) <= packing.fewest(lengths, 1024) * 1.02
    assert 0 < largest.value < 2 * 160


def test_edges(spark):
    odd = spark.createDataFrame([(None, None, 1), (1, "", 2), (3, "a b", 3), (3, "a b", 3), (4, "word " * 3000, 0)], "doc_id long, text string, piece int")
    rows = packing.packed(odd, PATH).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows if r.doc_id != 4) == [(0, 1), (1, 1), (3, 3), (3, 3)]
    assert sum(r.length for r in rows if r.doc_id == 4) == 3002 and check(rows) == 3
    assert packing.packed(odd.limit(0), PATH).count() == 0
    assert packing.packed(odd.limit(0), PATH).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
