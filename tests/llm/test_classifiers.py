import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attestry.llm import decision_lists as dl
from attestry.llm import toxicity as tx


def brute_stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    triples = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if triples[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(lines)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.none(), st.text(alphabet="ab #|\n\t é漢\x0b<", max_size=60)))
def test_counts_equal_brute_force(text):
    assert dl.text_stats(text) == brute_stats(text)


def test_counts_of_documents(documents):
    for r in documents.collect():
        assert dl.text_stats(r.text) == brute_stats(r.text)


def test_a_list_is_learned_and_emitted_as_sql(spark):
    rng = np.random.default_rng(1)
    n = 3000
    x = {k: rng.random(n) * 10 for k in dl.FEATURES}
    bad = ((x["symbols_per_word"] > 7) & (x["repeat_share"] > 2)) | (x["dup_line_share"] > 9)
    train, test = np.arange(n) < 2000, np.arange(n) >= 2000
    rules = dl.learn({k: v[train] for k, v in x.items()}, bad[train])
    hit = np.zeros(n, bool)
    for r in rules:
        hit |= dl.covers(r, x)
    assert 1 < len(rules) <= dl.MAX_RULES and (hit == bad)[test].mean() > 0.97
    sql = dl.kept_sql(rules)
    assert sql.startswith("case when") and sql.count("then false") == len(rules) and dl.kept_sql([]) == "true"
    assert dl.learn(x, np.zeros(n, bool)) == []


def test_quality_query_rejects_junk_and_keeps_clean_rows(spark, documents, table):
    got = {r.doc_id: r for r in dl.judge(documents, table("labels")).collect()}
    for r in documents.collect():
        want = brute_stats(r.text)
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.n_lines) == want
        assert g.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (g.base_failed and g.kept)
    labels = {r.doc_id: r.quality for r in table("labels").collect()}
    assert np.mean([got[i].kept for i, q in labels.items() if q == 1 and not got[i].base_failed]) > 0.97
    kept = dl.kept_documents(documents, table("labels"))
    assert kept.columns == documents.columns and {r.doc_id for r in kept.collect()} == {i for i, g in got.items() if g.kept}


def test_quality_of_odd_rows(spark, odd, empty, labels):
    got = dl.judge(odd, labels).collect()
    assert Counter((r.doc_id, r.n_words) for r in got) == Counter((r.doc_id, brute_stats(r.text)[0]) for r in odd.collect())
    assert dl.kept_documents(odd, labels).columns == odd.columns and dl.judge(empty, labels).count() == 0
    assert dl.judge(odd, labels.where("doc_id = -1")).count() == len(got)


def made(spark, n, seed):
    """Texts in two invented tongues; toxic ones have an insult, or many words with one stem; labels for all."""
    rng = np.random.default_rng(seed)
    rows, marks = [], []
    for i in range(n):
        words = [f"{a}{b}" for a, b in zip(rng.choice(list("bdfgklmn"), 60), rng.integers(0, 90, 60), strict=True)]
        words = ["".join(chr(97 + int(d)) if d.isdigit() else d for d in w) for w in words]
        toxic = i % 6 == 0
        if toxic and i % 12:
            words[rng.integers(60)] = rng.choice(["nasty", "vile", "awful###"])
        elif toxic:
            for k in rng.choice(60, 6, replace=False):
                words[k] = "grumpel" + "".join(rng.choice(list("aeiou"), 3))
        elif i % 5 == 0:
            words[3] = "grumpelaaa"
        rows.append((i, " ".join(words)))
        marks.append((i, int(rng.random() > 0.2), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), {i for i, _, t in marks if t}


def test_held_out_accuracy_of_the_chain(spark):
    docs, labels, toxic = made(spark, 1500, 4)
    got = {r.doc_id: r for r in tx.judge(docs, labels.where("doc_id < 1000")).collect()}
    flagged = {i for i, r in got.items() if r.toxic and i >= 1000}
    real = {i for i in toxic if i >= 1000}
    assert len(flagged & real) / len(real) > 0.95 and len(flagged - real) <= 5 and all(r.kept != r.toxic for r in got.values())
    kept = {r.doc_id for r in tx.kept_documents(docs, labels.where("doc_id < 1000")).collect()}
    assert kept == {i for i, r in got.items() if r.kept}


def test_flags_are_alike_with_the_bound_active_and_inactive(spark):
    """A word of which a tenth is toxic is not flagged, whatever the mix that is fitted on."""
    name = lambda i: "".join(chr(97 + int(d)) for d in str(i))
    kinds = [("sure", 1)] * 100 + [("odd", 1)] * 60 + [("odd", 0)] * 540 + [("", 1)] * 40 + [("", 0)] * 1260
    docs = spark.createDataFrame([(i, f"{w} u{name(i)}") for i, (w, _) in enumerate(kinds)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, t) for i, (_, t) in enumerate(kinds)], "doc_id long, quality int, toxic int")
    for rows in (tx.LABELLED_ROWS, 400):
        assert {r.doc_id for r in tx.judge(docs, labels, rows=rows).where("toxic").collect()} == set(range(100)), rows


def test_later_models_use_earlier_probabilities():
    rng = np.random.default_rng(0)
    n = 800
    a = rng.random(n) < 0.4
    x = tx.Sparse(np.flatnonzero(a), np.zeros(a.sum(), np.int64), n, 1)
    y = np.c_[a, a & (rng.random(n) < 0.95)].astype(int)
    chain = tx.fit_chain(["first", "second"], {b"w": 0}, x, y, np.arange(n) % tx.FOLDS)
    p = chain.predict(x)
    assert len(chain.weights[1]) == 3 and ((p[:, 1] > 0.5) == a).all() and abs(p[a, 0].mean() - 1) < 0.1


def test_odd_rows_are_scored(spark, odd, empty, labels):
    got = tx.judge(odd, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in odd.collect())
    assert tx.judge(odd, labels.where("doc_id = -1")).where("toxic").count() == 0 and tx.judge(empty, labels).count() == 0
    assert tx.kept_documents(odd, labels).columns == odd.columns


@pytest.mark.parametrize(("text", "want"), [("Trash### trash, TRASH", {b"trash"}), (None, set()), ("réeux ", {"réeux".encode()})])
def test_words(text, want):
    assert tx.word_set(text) == want


def plain_features(text):
    """Words, and stems that two or four of the text's different words share, by the definition."""
    words = set(re.sub(rb"[^A-Za-z\x80-\xff]", b" ", (text or "").encode()).lower().split())
    out = set(words)
    for w in words:
        for k in range(4, 9):
            if len(w) >= k:
                n = sum(1 for v in words if len(v) >= k and v[:k] == w[:k])
                out |= {bytes([m]) + w[:k] for m in (2, 4) if n >= m}
    return out


@pytest.mark.parametrize("penalty", [tx.PENALTY, 8.0])
def test_fit_is_optimal(penalty):
    """The subgradient of the penalised log-likelihood is zero: nothing but the optimum has that."""
    rng = np.random.default_rng(2)
    n, cols = 400, 12
    dense = rng.random((n, cols)) < 0.2
    y = (rng.random(n) < 1 / (1 + np.exp(-(2.0 * dense[:, 0] - 1.5 * dense[:, 1] - 0.5)))).astype(float)
    row, col = np.nonzero(dense)
    use = rng.choice([0.0, 1.0, 2.5], n)
    extra = np.c_[rng.normal(size=n), np.ones(n)]
    w = tx.fit(tx.Sparse(row, col, n, cols), extra, y, use, penalty)
    x = np.c_[dense, extra].astype(float)
    g = x.T @ (use * (1 / (1 + np.exp(-(x @ w))) - y))
    for j in range(len(w) - 1):
        assert abs(g[j] + penalty * np.sign(w[j])) < 0.5 if w[j] else abs(g[j]) < penalty + 0.5
    assert abs(g[-1]) < 0.5 and w[0] > 0.5 and (w == 0).any() == (penalty > 1)


def test_the_chain_equals_a_plain_one(spark, documents, table):
    """Features, folds, out-of-fold probabilities, cuts and predictions of the query, by plain loops over its own sample."""
    labels = table("labels")
    names = list(tx.CATEGORIES)
    chain = tx.train(documents, labels, {k: tx.F.expr(v) for k, v in tx.CATEGORIES.items()}, "toxic")
    text = {r.doc_id: r.text for r in documents.collect()}
    marks = {r.doc_id: [int(r.quality == 0), int(r.toxic == 1), int(r.toxic == 1 and r.quality == 0)] for r in labels.collect() if r.doc_id in text}
    ids = sorted(marks)
    assert set(chain.words) <= set().union(*[plain_features(text[i]) for i in ids])

    def matrix(ids):
        x = np.zeros((len(ids), len(chain.words)))
        for n, i in enumerate(ids):
            for w in plain_features(text[i]) & chain.words.keys():
                x[n, chain.words[w]] = 1
        return x

    import xxhash

    x, y = matrix(ids), np.array([marks[i] for i in ids])
    fold = np.array([xxhash.xxh64_intdigest(text[i].encode(), tx.SEED) % tx.FOLDS for i in ids])
    row, col = np.nonzero(x)
    sparse, before = tx.Sparse(row, col, len(ids), x.shape[1]), np.zeros((len(ids), 0))
    for k in range(len(names)):
        extra = np.c_[tx.logit(before), np.ones(len(ids))]
        whole = tx.fit(sparse, extra, y[:, k].astype(float), np.ones(len(ids)))
        assert np.allclose(whole, chain.weights[k], atol=1e-6), names[k]
        p = np.zeros(len(ids))
        for f in range(tx.FOLDS):
            w = tx.fit(sparse, extra, y[:, k].astype(float), (fold != f).astype(float))
            p[fold == f] = (1 / (1 + np.exp(-np.clip(np.c_[x, extra] @ w, -30, 30))))[fold == f]
        assert abs(tx.cut_of(p, y[:, k], np.ones(len(ids))) - chain.cuts[k]) < 1e-9
        before = np.c_[before, p]
    every = sorted(text)
    x, told = matrix(every), np.zeros((len(every), 0))
    for w in chain.weights:
        told = np.c_[told, 1 / (1 + np.exp(-np.clip(np.c_[x, tx.logit(told), np.ones(len(every))] @ w, -30, 30)))]
    got = {r.doc_id: r for r in tx.judge(documents, labels).collect()}
    for i, p in zip(every, told, strict=True):
        assert np.allclose([got[i].p_low_quality, got[i].p_toxic, got[i].p_toxic_junk], p, atol=1e-6)
        assert got[i].toxic == (p[1] >= chain.cuts[1]) or abs(p[1] - chain.cuts[1]) < 1e-6


def test_kept_equals_the_emitted_sql(spark, documents, table):
    """The learned list as the SQL that it emits, run by another engine on counts made by brute force."""
    import duckdb
    import pandas as pd

    rule = dl.learned(documents, table("labels"))
    stats = pd.DataFrame([(r.doc_id, *brute_stats(r.text)) for r in documents.collect()], columns=[f.split()[0] for f in dl.STATS.split(", ")])
    con = duckdb.connect()
    con.register("stats", stats)
    sql = re.sub(r"(?<=[0-9])D\b", "", rule)
    want = dict(con.sql(f"select doc_id, n_words >= 50 and 100 * n_repeat_words <= 50 * n_words and ({sql}) from stats").fetchall())
    assert rule.startswith("case") and {r.doc_id: r.kept for r in dl.judge(documents, table("labels")).collect()} == want


def test_the_sample_is_bounded_with_repeated_ids(spark):
    docs = spark.createDataFrame([(i % 4, f"word{i} and some more of it") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(4)] * 9, "doc_id long, quality int, toxic int")
    known = tx.known_labels(labels, {"toxic": tx.F.expr("toxic = 1")})
    got = tx.training_rows(docs, known, "toxic", 2, 1).collect()
    assert len(got) == 2 and len({r.doc_id for r in got}) == 2
    assert dl.judge(docs, labels, rows=3).count() == 400
