import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from attestry.llm import bloom_lookup as bl
from attestry.llm import sentencepiece_viterbi as sp


def pieces(text):
    """The paragraphs of a text, each with how often it came before."""
    out, seen = set(), Counter()
    for line in (text or "").split("\n"):
        w = list(re.finditer(r"[^\x20\x09-\x0D]+", line))
        for i in range(0, len(w), bl.PIECE_WORDS):
            part = w[i : i + bl.PIECE_WORDS]
            p = line[part[0].start() : part[-1].end()]
            out.add((p, seen[p]))
            seen[p] += 1
    return out


def likeness(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def xxhash64(text):
    return int.from_bytes(xxhash.xxh64_digest(text.encode(), 42), "big", signed=True)


def check(df):
    rows = sorted(df.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, xxhash64(r.text or ""), r.text or ""))
    want = Counter()
    for i, r in enumerate(rows):
        t, n = r.text or "", rows[(i + 1) % len(rows)].text or ""
        h = len(t) // 2
        e = t[: len(t) - h] + n[:h]
        want[(r.doc_id, len(t), hashlib.sha256(e.encode()).hexdigest(), round(likeness(pieces(t), pieces(e)), 9), round(likeness(pieces(t), pieces(n)), 9))] += 1
    got = bl.fingerprints_and_edits(df).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want
    return got, rows


def test_equals_brute_force(spark, documents, odd, empty):
    got, rows = check(documents)
    text = {r.doc_id: r.text for r in rows}
    prints = {}
    for r in got:
        assert prints.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint
    assert len(set(prints.values())) == len(prints)
    check(odd)
    assert bl.fingerprints_and_edits(empty).count() == 0
    check(documents.limit(1))


def test_repeats_and_white_space_at_ends(spark):
    texts = ["a b c\t\nd e", "a b c\nd e", "a b c\r\nd e\r\n", "a b c\nd e\nd e", "d e\na b c", "a b c\nd e\nd e\nd e \x0b", "a\tb c\nd e"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got, _ = check(df)
    prints = {r.doc_id: r.fingerprint for r in got}
    assert prints[0] == prints[1] == prints[2] == prints[4] and len(set(prints.values())) == 4
    assert next(r for r in got if r.doc_id == 2).near_next == 2 / 3


def test_rows_that_share_an_id_in_many_shares(spark, monkeypatch):
    monkeypatch.setattr(bl, "SHARE_ROWS", 7)
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i % 40, f"text {i % 61}\nof {i % 7}") for i in range(200)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_two_strings_are_enough_to_peel_what_they_hold(spark, documents):
    found = bl.fingerprints_and_edits(documents).select("doc_id", "near_edited", bl.read_sketch(F.col("fingerprint")).alias("s"), bl.read_sketch(F.col("edited_fingerprint")).alias("e"))
    n = lambda c: F.aggregate(F.slice(c, 1, bl.BASE_WIDTH), F.lit(0), lambda a, x: a + x["c"])
    rows = found.select("near_edited", bl.base_difference(F.col("s"), F.col("e")).alias("d"), (n("s") + n("e")).alias("n")).collect()
    held = [r for r in rows if r.d is not None]
    assert len(held) > 10 and all(abs((r.n - r.d) / (r.n + r.d) - r.near_edited) < 1e-9 for r in held if r.n)


def test_peeling_recovers_the_digests_also_of_large_differences(spark):
    rng = random.Random(1)
    long = lambda n: [rng.getrandbits(63) for _ in range(n)]
    pairs = []
    for g, (both, a, b) in enumerate([(0, 0, 0), (5, 0, 0), (50, 1, 0), (50, 3, 4), (10, 300, 200), (0, 1000, 1000), (3000, 40, 1)]):
        shared = long(both)
        pairs.append((g, shared + long(a), shared + long(b)))
    df = spark.createDataFrame(pairs, "g long, a array<long>, b array<long>")
    got = {r.g: (r.only_a, r.only_b) for r in bl.differences(df).collect()}
    assert got == {g: (len(set(a) - set(b)), len(set(b) - set(a))) for g, a, b in pairs}
    found = bl.peeled(df.where("g = 3"), 3).collect()
    assert not any(r.left for r in found) and {r.digest for r in found if r.sign == 1} == set(pairs[3][1]) - set(pairs[3][2])


def test_failed_tables_are_retried_larger(spark, monkeypatch):
    rng = random.Random(2)
    df = spark.createDataFrame([(g, [rng.getrandbits(63) for _ in range(200)], [rng.getrandbits(63) for _ in range(200)]) for g in range(5)], "g long, a array<long>, b array<long>")
    monkeypatch.setattr(bl, "WIDTH", 0.1)
    assert {(r.only_a, r.only_b) for r in bl.differences(df).collect()} == {(200, 200)}
    monkeypatch.setattr(bl, "LEVELS", 1)
    assert {(r.only_a, r.only_b) for r in bl.differences(df).collect()} == {(200, 200)}


def test_no_python_on_the_main_path(spark, documents):
    plan = bl.fingerprints_and_edits(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_pipeline_stages(spark):
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, ids = docs.columns, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.collect()}
        docs = stage(spark, docs, data).cache()
        assert docs.columns == columns, name
        ids = {r.doc_id for r in docs.collect()}
        assert ids <= before and ids
    library = sentencepiece.SentencePieceProcessor(model_file=sp.model_path())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()
    assert Counter((r.doc_id, tuple(r.token_ids)) for r in last) == Counter((r.doc_id, tuple(library.encode(r.text))) for r in docs.collect())
    whole = corpus_pipeline.run(spark, data).select("doc_id", "ids_crc32").collect()
    assert Counter(map(tuple, whole)) == Counter((r.doc_id, r.ids_crc32) for r in last)


def test_pipeline_stages_on_odd_and_empty_tables(spark, odd, empty):
    data = "/root/testdata/sf0.001"
    texts = Counter(r.text for r in odd.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, data)
        assert got.columns == odd.columns, name
        rows = got.collect()
        if name != "source mix":
            assert not Counter(r.text for r in rows) - texts, name
        assert stage(spark, empty, data).count() == 0, name
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, odd, data).count() == odd.count() and last(spark, empty, data).count() == 0
    kept = corpus_pipeline.near_copies(spark, odd, data).collect()
    assert Counter(r.doc_id for r in kept if r.doc_id is not None) == Counter([1, 4, 5, 6, 9])
