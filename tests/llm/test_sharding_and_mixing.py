import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry.llm import mixing, sharding
from attestry.llm.common import running_totals


def words(t):
    return (t or "").encode().split()


@pytest.mark.parametrize(("d", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_each_cell_once_and_moves_by_one(d, bits):
    grid = np.stack(np.meshgrid(*[np.arange(2**bits)] * d, indexing="ij"), axis=-1).reshape(-1, d)
    at = sharding.hilbert_index(grid, bits)
    order = grid[np.argsort(at)]
    assert sorted(at) == list(range(len(grid))) and (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def check_plan(rows, texts, shards=16):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    sizes = [len(by[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values()) and {r.law for r in rows} <= {"rows"}


def test_shards(spark, documents, odd, empty):
    check_plan(sharding.shard_plan(documents).collect(), [(r.doc_id, r.text) for r in documents.collect()])
    check_plan(sharding.shard_plan(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert sharding.shard_plan(empty).count() == 0


def test_written_shards_prune(spark, odd, documents, tmp_path):
    whole = sharding.write_shards(documents, str(tmp_path / "a")).collect()
    assert sum(r.n_rows for r in whole) == documents.count() and len(whole) == 16

    def opened(ranges):
        return sum(a <= s <= z for a, z in ranges for s in [f"src{i}" for i in range(20)])

    by_id = sorted((r.doc_id, r.source) for r in documents.collect())
    runs = [[s for _, s in by_id[i * len(by_id) // 16 : (i + 1) * len(by_id) // 16]] for i in range(16)]
    assert opened([(r.source_min, r.source_max) for r in whole]) < 0.7 * opened([(min(x), max(x)) for x in runs])
    assert sum(r.n_rows for r in sharding.write_shards(odd, str(tmp_path / "b"), 3).collect()) == odd.count()


def brute_mix(rows):
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    sources = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = sum(weight[s] for s in sources if s not in capped)
        rest = total - sum(3 * sizes[s] for s in capped)
        over = {s for s in sources if s not in capped and left and weight[s] * rest >= 3 * sizes[s] * left}
        if not over:
            break
        capped |= over
    target = {s: float(3 * sizes[s]) if s in capped else weight[s] * rest / left for s in sources}
    out = Counter()
    for s in sources:
        budget, at = round(target[s]), 0
        whole, rest_ = divmod(budget, sizes[s]) if sizes[s] else (0, 0)
        mine = sorted((hashlib.md5(f"20:{'null' if i is None else i}".encode()).hexdigest(), i is not None, i or 0, n) for i, ss, n in rows if ss == s)
        for _, _, i, n in mine:
            out[(i, s, n, whole * n + max(0, min(n, rest_ - at)))] += 1
            at += n
    return out, target


def check_mix(df):
    rows = [(r.doc_id, r.source, len(words(r.text))) for r in df.select("doc_id", "source", "text").collect()]
    got = mixing.mix(df).collect()
    want, target = brute_mix(rows)
    assert Counter((r.doc_id or 0, r.source, r.size, r.taken) for r in got) == want
    assert all(abs(r.target - target[r.source]) < 1e-6 for r in got)
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())


def test_mix(spark, documents, odd, empty):
    check_mix(documents)
    check_mix(odd)
    assert mixing.mix(empty).count() == 0


def test_a_small_source_stops_at_three_times(spark):
    rows = [(i, "a b c d e f g h", "big") for i in range(20)] + [(100, "x y", "c"), (101, "z", "c")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.target for r in got if r.source == "c"} == {9.0} and sum(r.taken for r in got) == 163


def check_mixed(df):
    """Each source has the words that mix() takes of it, and no row more than three times its own."""
    want, have, most = Counter(), Counter(), Counter()
    for r in mixing.mix(df).collect():
        want[r.source] += r.taken
    for r in df.collect():
        most[(r.doc_id, r.source)] += 3 * len(words(r.text))
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns
    rows = Counter()
    for r in got.collect():
        have[r.source] += len(words(r.text))
        rows[(r.doc_id, r.source)] += len(words(r.text))
    assert +have == +want
    assert all(n <= most[k] for k, n in rows.items())
    return sum(have.values())


def test_mixed_documents_have_what_was_taken(spark, documents, odd, empty):
    check_mixed(documents)
    check_mixed(odd)
    check_mixed(odd.withColumns({c: F.lit(1) for c in ("src", "key", "hash", "whole", "rest", "end")}))
    assert mixing.mixed_documents(empty).count() == 0
    nulls = spark.createDataFrame([(None, f"w {i % 2} " * 15, "a") for i in range(20)] + [(1, "x " * 9, "b")] * 4, "doc_id long, text string, source string")
    assert check_mixed(nulls) == 20 * 30 + 36


def test_mixed_documents_equal_mix_row_by_row(spark, documents):
    want = Counter({r.doc_id: r.taken for r in mixing.mix(documents).collect()})
    have = Counter()
    for r in mixing.mixed_documents(documents).collect():
        have[r.doc_id] += len(words(r.text))
    assert +have == +want


def test_targets_of_many_sources(spark):
    rng = random.Random(4)
    sizes = [(f"0s{i:03}", rng.choice([1, 5, 1000, rng.randint(1, 10**6)])) for i in range(300)]
    got = {r.src: r.target for r in mixing.source_targets(spark.createDataFrame(sizes, "src string, source_size long")).collect()}
    weight, size = {s: i % 3 + 1 for i, (s, _) in enumerate(sizes)}, dict(sizes)
    capped, total = set(), sum(size.values())
    while True:
        left, rest = sum(weight[s] for s in size if s not in capped), total - sum(3 * size[s] for s in capped)
        over = {s for s in size if s not in capped and weight[s] * rest >= 3 * size[s] * left}
        if not over:
            break
        capped |= over
    assert 0 < len(capped) < 300
    assert all(abs(got[s] - (3 * size[s] if s in capped else weight[s] * rest / left)) < 1e-6 * got[s] for s in size)


def test_running_totals_carry_over_tasks(spark):
    df = spark.createDataFrame([(k, f"g{k % 3}", k % 7) for k in range(500)], "k long, g string, w int")
    got = {r.k: r.before for r in running_totals(df, ["g", "k"], "w", by="g").collect()}
    for g in range(3):
        at = 0
        for k in range(g, 500, 3):
            assert got[k] == at
            at += k % 7
