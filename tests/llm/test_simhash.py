import random

import xxhash

from quillspark.llm import simhash

SF = "/root/testdata/sf0.001"


def brute(text, k=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(prints, limit=2):
    ids, root = sorted(prints), {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if bin(prints[a] ^ prints[b]).count("1") <= limit:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {d: find(d) for d in ids}


def test_fingerprint_matches_brute_force():
    for text in (None, "", " \t\n", "One", "a b", "A b c", "x " * 500, "éa b c d ÀB c e"):
        assert simhash.fingerprint(text)[0] & (1 << 64) - 1 == brute(text), text


def test_components_on_documents(spark):
    from quillspark.llm.queries import op1_simhash

    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = closure(prints := {r.doc_id: brute(r.text) for r in rows})
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op1_simhash(spark, SF).collect()}
    assert got == {d: (f"{prints[d]:016x}", want[d]) for d in prints}


def test_links_chains_and_edge_cases(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = {}
    for b in base:
        for _ in range(12):
            prints[len(prints)] = b
            for bit in rng.sample(range(64), rng.randint(0, 2)):
                b ^= 1 << bit
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    classes = spark.createDataFrame([(signed(v),) for v in sorted(set(prints.values()))], "f0 long")
    found = {r.node: r.component for r in simhash.connected_components(simhash.link_exact(classes)).collect()}
    want, by_root = closure(prints), {}
    for d, p in prints.items():
        by_root.setdefault(want[d], set()).add(signed(p))
    for members in by_root.values():
        assert {found.get(m, m) for m in members} == {min(members)}

    rows = [(1, None, "x"), (2, "", "x"), (None, "a b c d", "y"), (4, "a b c d", "y"), (4, "a b c d", "y"), (7, "long " * 50000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.components(docs).collect())
    assert got == [(-1, 4), (1, 1), (2, 1), (4, 4), (4, 4), (7, 7)]
    assert simhash.components(docs.limit(0)).count() == 0


def test_groups_find_near_copies(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, truth = [], {}
    for g in range(40):
        words = rng.choices(vocabulary, k=300)
        for c in range(3):
            copy = list(words)
            for _ in range(c):
                copy[rng.randrange(300)] = rng.choice(vocabulary)
            truth[len(rows)] = g
            rows.append((len(rows), " ".join(copy), "s"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id: r.component_id for r in simhash.groups(docs, ["doc_id"]).collect()}
    assert found == {d: 3 * g for d, g in truth.items()}
    kept = simhash.deduplicate(docs.unionByName(docs.limit(1)))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 120, 3))
    odd = spark.createDataFrame([(None, rows[0][1], "s"), (None, None, "s"), (5, rows[9][1], "a"), (5, rows[30][1], "b"), (5, rows[30][1], "b"), (5, None, "c")], docs.schema)
    kept = simhash.deduplicate(docs.unionByName(odd))
    assert sorted((r.doc_id or -1, len(r.text or "") > 0) for r in kept.collect() if r.doc_id in (None, 5, 9, 30)) == [(-1, False), (-1, True), (5, False), (5, True), (5, True)]
    assert simhash.deduplicate(docs.limit(0)).count() == 0


def jaccard_closure(texts):
    sets, root = {d: {tuple((w := t.split())[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for d, t in texts.items()}, {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                ra, rb = sorted((find(a), find(b)))
                root[rb] = ra
    return {d: find(d) for d in texts}


def found(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r.doc_id: r.component_id for r in simhash.groups(docs, ["doc_id"]).collect()}


def test_groups_are_exact_at_the_similarity(spark):
    rng = random.Random(2)
    texts = {}
    for g in range(60):
        n = rng.choice([4, 8, 12, 40, 150, 300])
        words = [f"g{g}w{i}" for i in range(n)]
        texts[len(texts)] = " ".join(words)
        for share in (0.01, 0.05, 0.09, 0.1, 0.11, 0.12, 0.15):
            texts[len(texts)] = " ".join(words[: n - round(n * share)] + [f"x{len(texts)}y{i}" for i in range(round(n * share))])
    assert found(spark, texts) == jaccard_closure(texts)


def test_a_crowded_key_loses_no_pair(spark):
    texts = []
    for g in range(4):
        for c in range(24):
            # a family shares many keys; only two that differ from it at the same place are near each other
            words, at = [f"g{g}w{i}" for i in range(300)], 24 * (c // 2)
            words[at : at + 16] = [f"c{g}x{c}y{i}" for i in range(16)]
            texts.append(" ".join(words))
    random.Random(3).shuffle(texts)
    texts = dict(enumerate(texts))
    assert found(spark, texts) == jaccard_closure(texts)


def copies(rng, families=40):
    """Families of a text of 300 words and copies of it, by how many words at its end differ."""
    texts = {}
    for g in range(families):
        words = [f"g{g}w{i}" for i in range(300)]
        for n in (0, 0, 1, 4, 12, 40):
            texts[len(texts)] = " ".join(words[: 300 - n] + [f"x{len(texts)}y{i}" for i in range(n)])
    return texts


def test_matches_are_those_of_the_segment_tables(spark):
    texts = copies(random.Random(6)) | {9000: "", 9001: " \n", 9002: "one word", 9003: "one word"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets = simhash.shingle_sets(docs, ["doc_id"])
    prints = {r.d: [r[p] & (1 << 64) - 1 for p in ("p0", "p1", "p2", "p3")] for r in sets.where("n > 0").collect()}
    halves = {d: [x for w in p[: simhash.SEGMENT_WORDS] for x in (w & (1 << 32) - 1, w >> 32)] for d, p in prints.items()}
    want = {}
    for a in prints:
        for b in prints:
            distance = sum((x ^ y).bit_count() for x, y in zip(prints[a], prints[b]))
            if a < b and distance <= simhash.FAR and any((x ^ y).bit_count() <= 1 for x, y in zip(halves[a], halves[b])):
                want[a, b] = distance
    got = [((r.u, r.v), r.distance) for r in simhash.matches(sets).collect()]
    assert len(want) > 100 and dict(got) == want and len(got) == len(want)


def test_segments_link_near_copies_without_the_shingles_keys(spark, monkeypatch):
    texts = copies(random.Random(7))
    want = jaccard_closure(texts)
    monkeypatch.setattr(simhash, "_prefixes", lambda sets, similarity: sets.select(sets.d.alias("u"), sets.d.alias("w"), sets.d.alias("key")).limit(0))
    got = found(spark, texts)
    # each family's first text, its equal and those with one and four other words
    near = [d for d in texts if d % 6 in (2, 3)]
    assert sum(got[d] == want[d] for d in near) >= 0.8 * len(near)
    assert all(want[got[d]] == want[d] for d in texts)
    monkeypatch.undo()
    assert found(spark, texts) == want


def test_a_crowded_segment_loses_no_pair(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HELD", 2)
    texts = {n: " ".join([f"w{i}" for i in range(300 - n)] + [f"x{n}y{i}" for i in range(n)]) for n in range(60)}
    assert found(spark, texts) == jaccard_closure(texts)
