import random

import numpy as np
import xxhash

from lakequarry.llm import simhash as S

from .fixtures import documents, table


def brute_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs):
    root = list(range(len(pairs)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(pairs)):
        for j in range(i):
            if bin(pairs[i][1] ^ pairs[j][1]).count("1") <= 2:
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, (doc_id, _) in enumerate(pairs):
        if doc_id is not None:
            groups[find(i)] = min(groups.get(find(i), doc_id), doc_id)
    return [groups.get(find(i)) for i in range(len(pairs))]


def test_query_matches_brute_force(spark, tmp_path):
    d = table(spark, tmp_path, "documents", documents(spark))
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = sorted((a is None, a, f"{f:016x}", c is None, c) for (a, f), c in zip(rows, brute_components(rows), strict=True))
    got = sorted((r.doc_id is None, r.doc_id, r.fingerprint, r.component_id is None, r.component_id) for r in S.op7_simhash(spark, d).collect())
    assert got == want


def planted():
    rng = random.Random(3)
    values = []
    for _ in range(25):
        v = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 6, 30])):
            values.append(v)
            v ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3])))
    return list(dict.fromkeys(values))


def test_links_in_both_ways_match_brute_force(spark):
    values = planted()
    want = brute_components(list(enumerate(values)))
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    for most in (1024, 3, 1):
        found = {r.node: r.root for r in S.components(S.links(df, most)).collect()}
        groups = {}
        for i, v in enumerate(signed):
            groups.setdefault(found.get(v, v), []).append(i)
        got = [0] * len(values)
        for own in groups.values():
            for i in own:
                got[i] = min(own)
        assert got == want, most


def test_bit_sliced_distances():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 2**63, 200, dtype=np.uint64)
    values[1::2] = values[::2] ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64))
    planes = S.planes_of(values)
    for block in range(4):
        found = S.near(values, planes, np.full(200, block), np.full(200, 0xFFFFFFFFFFFFFFFF, np.uint64))
        for q in range(200):
            for i in range(64):
                if block * 64 + i < 200:
                    assert bool(found[q] >> np.uint64(i) & np.uint64(1)) == (bin(int(values[q]) ^ int(values[block * 64 + i])).count("1") <= 2)


def test_empty_table(spark, tmp_path):
    assert S.op7_simhash(spark, table(spark, tmp_path, "documents", documents(spark).limit(0))).count() == 0


def components_of(links, nodes):
    found = {r.node: r.root for r in S.components(links).collect()}
    return [found.get(n, n) for n in nodes]


def test_components_never_depend_on_the_size_of_buckets(spark):
    """A tight core in one half of the fingerprint, and members that are near one member of the core only."""
    rng = random.Random(8)
    radius = S.radius_for(0.8)[0]
    base, core, lone = rng.getrandbits(256), [], []
    flip = lambda v, bits: v ^ sum(1 << b for b in bits)
    while len(core) < 1200:
        core.append(flip(base, rng.sample(range(128), rng.randrange(radius // 2))))
    for k in range(150):
        lone.append(flip(core[k], rng.sample(range(128), radius)))
    values = list(dict.fromkeys(core + lone))
    words = [np.frombuffer(v.to_bytes(32, "little"), "<u8") for v in values]
    df = spark.createDataFrame([(i, bytearray(w.tobytes()), bytearray(b"one band")) for i, w in enumerate(words)], "node long, fp binary, bands binary").repartition(4)
    everything = [components_of(S.similar_links(df, most_in_bucket=most), range(len(values))) for most in (10**9, 1024, 128)]
    assert everything[0] == everything[1] == everything[2]
    assert len(set(everything[0])) < len(values)


def test_asked_links_match_brute_force():
    rng = np.random.default_rng(4)
    values = rng.integers(0, 2**63, (300, 1), dtype=np.uint64)
    values[1::2] = values[::2] ^ (np.uint64(1) << rng.integers(0, 64, (150, 1)).astype(np.uint64))
    labels, asks = rng.integers(0, 200, 300), rng.random(300) < 0.4
    low, high = S.asked_links(values, labels, asks, 2)
    pairs = [(i, j) for i in np.flatnonzero(asks) for j in np.flatnonzero(~asks) if bin(int(values[i, 0] ^ values[j, 0])).count("1") <= 2]

    def parts(links):
        root = {i: i for i in labels.tolist()}
        find = lambda x: x if root[x] == x else find(root[x])
        for i, j in links:
            a, b = find(int(labels[i])), find(int(labels[j]))
            root[max(a, b)] = min(a, b)
        return [find(x) for x in labels.tolist()]

    assert parts(zip(low.tolist(), high.tolist(), strict=True)) == parts(pairs)


def test_long_texts_are_hashed_in_runs():
    rng = random.Random(2)
    text = "".join(rng.choice("abAB é\t\n  ") for _ in range(3000)) + "x" * 500 + " a b"
    for shingle in (1, 3, 5):
        whole = np.concatenate(list(S.shingle_runs(text, shingle)))
        for most in (1, 7, 64, 501):
            assert (np.concatenate(list(S.shingle_runs(text, shingle, most))) == whole).all()
    assert [len(r) for r in S.shingle_runs("a b", 3, 1)] == [1] and not list(S.shingle_runs(" \n", 3)) and not list(S.shingle_runs(None, 3))
    assert (np.concatenate(list(S.shingle_runs("a b", 3, 1))) == [xxhash.xxh64_intdigest(b"a b", seed=42)]).all()


def test_clashing_columns_come_back_as_they_were(spark):
    rows = [(1, "a b c d e f", 7, "r", 1, 2), (2, "a b c d e f", 8, "s", 3, 4), (3, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row long, row string, node long, key long")
    assert sorted(map(tuple, S.drop_near_duplicates(df).collect())) == [rows[0], rows[2]]


def test_bands_find_similar_sets_whatever_else_there_is():
    """1,000 pairs of each similarity, of sets of 9 to 900 hashes: how many share a band."""
    rng = np.random.default_rng(9)

    def share(both, own, n=1000):
        met = 0
        for _ in range(n):
            hashes = rng.integers(0, 1 << 64, both + 2 * own, dtype=np.uint64)
            a, b = (np.frombuffer(S.bands_of(np.sort(np.concatenate([hashes[:both], hashes[both + k * own : both + (k + 1) * own]]))), "<u8") for k in range(2))
            met += bool((a == b).any())
        return met / n

    for both, own in ((8, 1), (80, 10), (720, 90)):  # just 0.8
        assert share(both, own) >= 0.985
    assert share(95, 5) == 1.0 and share(60, 40) < 0.2 and share(20, 80) == 0.0
    assert S.bands_of(np.empty(0, np.uint64)) == b"" and len(S.bands_of(np.array([5], np.uint64))) == 8 * S.BANDS
