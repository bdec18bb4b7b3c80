import itertools
import random
from collections import Counter

import corpus_pipeline
import numpy as np

from attestry.llm import shingle_pairs, simhash


def brute(rows):
    def words(t):
        return (t or "").encode().lower().split()

    def grams(w):
        k = min(5, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    nodes = sorted({tuple(words(t)) for _, t in rows})
    sets, label = [grams(n) for n in nodes], list(range(len(nodes)))
    for a, b in itertools.combinations(range(len(nodes)), 2):
        both = len(sets[a] & sets[b])
        if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
            old, new = label[b], label[a]
            label = [new if x == old else x for x in label]
    of, least = dict(zip(nodes, label, strict=True)), {}
    for i, t in rows:
        if i is not None:
            g = of[tuple(words(t))]
            least[g] = min(i, least.get(g, i))
    return Counter((i, least.get(of[tuple(words(t))])) for i, t in rows)


def check(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert Counter(map(tuple, shingle_pairs.near_groups(df).collect())) == brute(rows)


def edited(rng, n=60):
    """Texts, and copies of them with words replaced at one end or spread, on both sides of the bound; some in chains."""
    rows = []
    for g in range(n):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 6, 20, 60, 200]))]
        for _ in range(rng.randrange(1, 7)):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            for _ in range(rng.randrange(1, 2 + len(words) // 25)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(5000)}"
            if rng.random() < 0.3:
                words += [f"y{rng.randrange(9)}" for _ in range(len(words) // 8)]
    return rows


def test_equals_brute_force(spark, documents, odd, empty, monkeypatch):
    check(documents)
    check(odd)
    assert shingle_pairs.near_groups(empty).count() == 0
    df = spark.createDataFrame(edited(random.Random(3)), "doc_id long, text string")
    check(df)
    monkeypatch.setattr(shingle_pairs, "SAMPLE", 1)
    monkeypatch.setattr(shingle_pairs, "COMMON", 2)
    check(df)


def test_stage_merges_what_a_radius_of_two_keeps(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(9000)}" for _ in range(200)]
    near = [*base[:100], "other", *base[101:], "tail", "end"]
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base[::-1]))], "doc_id long, text string")
    assert simhash.one_of_each(df).count() == 3
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, df, "").collect()) == [1, 3]


def near_one_text(rng, n):
    """Copies of one text with one to four words replaced, near the bound from each other."""
    base = [f"w{rng.randrange(9000)}" for _ in range(150)]
    rows = []
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(150), rng.randrange(1, 5)):
            words[at] = f"x{rng.randrange(9000)}"
        rows.append((i, " ".join(words)))
    return rows


def test_a_large_group_of_near_copies_is_not_expanded_into_pairs(spark, monkeypatch):
    asked, confirm = [], shingle_pairs.verified

    def counted(pairs, sets):
        pairs = shingle_pairs.written(pairs, "counted")
        asked.append(pairs.count())
        return confirm(pairs, sets)

    monkeypatch.setattr(shingle_pairs, "verified", counted)
    df = spark.createDataFrame(near_one_text(random.Random(5), 500), "doc_id long, text string")
    check(df)
    assert sum(asked) < 10 * 500


def test_large_buckets_and_their_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(shingle_pairs, "PAIRED", 3)
    monkeypatch.setattr(shingle_pairs, "BLOCK_ROWS", 5)
    monkeypatch.setattr(shingle_pairs, "WORDS", 64)
    rng = random.Random(6)
    rows = near_one_text(rng, 40) + edited(rng, 30)
    check(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string"))


def test_parity_bits_pass_every_alike_pair():
    rng = np.random.default_rng(7)
    base, sets = rng.integers(-(2**63), 2**63, 600), []
    for _ in range(120):
        start, size = 100 * rng.integers(0, 6), rng.integers(60, 100)
        kept = rng.permutation(base[start : start + size])
        sets.append(np.unique(np.r_[kept[rng.integers(0, 12) :], rng.integers(-(2**63), 2**63, rng.integers(0, 8))]))
    n, root = np.array([len(s) for s in sets]), rng.integers(0, 90, len(sets))
    common = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    alike = {(a, b) for a, b in zip(*np.nonzero((9 * common >= 4 * (n[:, None] + n)) & (root[:, None] != root)), strict=True) if a < b}
    bits = [shingle_pairs.parity_bits(s) for s in sets]
    assert len({len(b) for b in bits}) > 1 and len(alike) > 10
    every = {tuple(sorted(p)) for p in shingle_pairs.foreign_pairs(bits, n, root, every=True)}
    assert alike <= every and len(every) < 3 * len(alike)
    few = shingle_pairs.foreign_pairs(bits, n, root, every=False)
    assert len(few) < len(set(root.tolist())) and {tuple(sorted(p)) for p in few} <= every
