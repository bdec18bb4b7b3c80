import itertools
import random
from collections import Counter

import numpy as np
import xxhash

from attestry.llm import simhash


def brute_fingerprint(text):
    w = [x for x in (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()]
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    hs = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, radius=2):
    label = {f: f for f in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= radius:
            ra, rb = sorted((root(a), root(b)))
            label[rb] = ra
    return {f: root(f) for f in fps}


def check(df):
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in df.select("doc_id", "text").collect()]
    comp = brute_components(sorted({f for _, f in rows}))
    least = {}
    for i, f in rows:
        if i is not None:
            least[comp[f]] = min(i, least.get(comp[f], i))
    want = Counter((i, f"{f:016x}", least.get(comp[f])) for i, f in rows)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()) == want


def test_equals_brute_force(spark, documents, odd, empty):
    check(documents)
    check(odd)
    assert simhash.near_duplicates(empty).count() == 0


def clouds(rng, n=60):
    out = []
    for _ in range(n):
        x = rng.getrandbits(64)
        out.append(x)
        for _ in range(rng.randrange(12)):
            for _ in range(rng.randrange(1, 3)):
                x ^= 1 << rng.randrange(64)
            out.append(x)
    return sorted(set(out))


def test_bit_slices_count_distances():
    fps = np.array(clouds(random.Random(2)), dtype=np.uint64)
    planes = simhash.bit_planes(fps)
    for radius in (0, 1, 2, 3, 5, 12):
        near = np.unpackbits(simhash.within(planes, fps, radius).view(np.uint8), axis=1, bitorder="little")[:, : len(fps)]
        assert (near == (np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius)).all()


def test_links_keep_every_component_also_in_hot_buckets(spark, monkeypatch):
    ball = [0] + [1 << i for i in range(24)] + [1 << i | 1 << j for i in range(24) for j in range(i)]
    fps = sorted({*clouds(random.Random(3)), *ball})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = brute_components(fps)
    groups = Counter(frozenset(f for f in fps if want[f] == r) for r in set(want.values()))
    for limit in (4096, 16):
        monkeypatch.setattr(simhash, "BUCKET_ROWS", limit)
        root = {r.u & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in simhash.components(simhash.links(df)).collect()}
        got = Counter(frozenset(f for f in fps if root.get(f, f) == r) for r in {root.get(f, f) for f in fps})
        assert got == groups


def test_long_chains_become_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(5, 5), (900, 901)], "u long, v long")
    got = {r.u: r.root for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {901: 900}
    assert simhash.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_of_each(spark, odd, empty):
    got = simhash.one_of_each(odd)
    ids = sorted((r.doc_id for r in got.collect()), key=str)
    comp = {(r.doc_id): r.component_id for r in simhash.near_duplicates(odd).collect() if r.doc_id is not None}
    assert got.columns == odd.columns and ids.count(None) == 2 and {1, 4, 5, 6, 8, 9} - set(ids) == {i for i in (1, 4, 5, 6, 8, 9) if comp[i] != i}
    assert 2 not in ids and 7 not in ids and ids.count(9) == 1 and simhash.one_of_each(empty).count() == 0
