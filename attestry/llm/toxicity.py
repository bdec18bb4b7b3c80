"""Toxicity by a classifier chain: each category's linear model also sees the probabilities of the categories before."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, written

#: Labelled rows that a model is fitted on, at most: half with the decisive category, half without, by least md5; each
#: half is weighted back to its share of all labels.
LABELLED_ROWS = 20_000
#: Words that each category puts into the vocabulary: those with the largest likelihood ratio.
WORDS = 400
LEAST_DOCUMENTS = 3
#: No cut is set lower than this, however few rows were labelled.
LEAST_CUT = 0.3
FOLDS = 5
#: On the absolute weights, in log-likelihood.
PENALTY = 0.7
SWEEPS = 60
SEED = 5
#: Everything but ASCII letters and bytes of other scripts separates words; case goes.
LETTERS = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


#: Beginnings of words, in bytes, and in how many different words of a text one has to stand to be a feature of it.
STEMS = range(4, 9)
TIERS = (2, 4)


def word_set(text: str | None) -> set[bytes]:
    return set((text or "").encode("utf-8", "surrogatepass").translate(LETTERS).split())


def features(text: str | None) -> set[bytes]:
    """A text's words, and for each tier n the stems that n or more of them share, as byte n and the stem."""
    words = word_set(text)
    stems = Counter(w[:k] for w in words for k in STEMS if len(w) >= k)
    return words | {bytes([n]) + x for x, m in stems.items() if m >= TIERS[0] for n in TIERS if m >= n}


@dataclass
class Sparse:
    """Rows of a 0/1 matrix: row and column of each one."""

    row: np.ndarray
    col: np.ndarray
    rows: int
    cols: int

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.rows)

    def transposed_times(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, r[self.row], self.cols)


def fit(x: Sparse, extra: np.ndarray, y: np.ndarray, use: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Logistic regression by coordinate descent; weights of words, then of extra columns, the last of them constant.

    The penalty is on absolute weights: a word that only comes along with telling ones (in copies of a text) gets none.
    """
    order = np.argsort(x.col, kind="stable")
    rows_of = np.split(x.row[order], np.searchsorted(x.col[order], np.arange(1, x.cols)))
    w, z = np.zeros(x.cols + extra.shape[1]), np.zeros(x.rows)
    active = list(range(len(w)))
    for sweep in range(SWEEPS):
        most = 0.0
        for j in active:
            dense = j >= x.cols
            at = slice(None) if dense else rows_of[j]
            value = extra[:, j - x.cols] if dense else 1.0
            p = 1 / (1 + np.exp(-z[at]))
            g = float(np.sum(use[at] * (p - y[at]) * value))
            h = float(np.sum(use[at] * p * (1 - p) * value**2)) + 1e-3
            to, least = w[j] - g / h, 0.0 if j == len(w) - 1 else penalty / h
            step = float(np.clip(np.sign(to) * max(abs(to) - least, 0) - w[j], -2, 2))
            if step:
                w[j] += step
                z[at] = np.clip(z[at] + step * value, -30, 30)
                most = max(most, abs(step))
        if most < 0.02:
            if len(active) == len(w):
                break
            active = list(range(len(w)))
        elif sweep % 10 != 9:
            active = [j for j in range(len(w)) if w[j] or j >= x.cols]
        else:
            active = list(range(len(w)))
    return w


@dataclass
class Chain:
    categories: list[str]
    words: dict[bytes, int] = field(default_factory=dict)
    weights: list[np.ndarray] = field(default_factory=list)
    cuts: list[float] = field(default_factory=list)

    def predict(self, x: Sparse) -> np.ndarray:
        """Probability of each category, one after the other: (rows x categories)."""
        before = np.zeros((x.rows, 0))
        for w in self.weights:
            z = x.times(w[: x.cols]) + np.c_[logit(before), np.ones(x.rows)] @ w[x.cols :]
            before = np.c_[before, 1 / (1 + np.exp(-np.clip(z, -30, 30)))]
        return before

    def rows(self, texts: list[str | None]) -> Sparse:
        stems = {w[1:] for w in self.words if w[0] in TIERS}
        lengths = sorted({len(x) for x in stems})
        hits = []
        for t in texts:
            words = word_set(t)
            shared = Counter(x for k in lengths for x in [w[:k] for w in words] if len(x) == k and x in stems)
            names = words | {bytes([n]) + x for x, m in shared.items() for n in TIERS if m >= n}
            hits.append(sorted(self.words[w] for w in self.words.keys() & names))
        return Sparse(np.repeat(np.arange(len(hits)), [len(h) for h in hits]), np.array([c for h in hits for c in h], dtype=np.int64), len(hits), len(self.words))


def logit(p: np.ndarray) -> np.ndarray:
    q = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(q / (1 - q))


def cut_of(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The cut with the best F1 of the weighted rows on out-of-fold probabilities, halfway (in log odds) to the next row below."""
    if not y.any() or y.all():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits, called = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    ends = np.flatnonzero(np.r_[p[order][1:] != p[order][:-1], True])
    f1 = 2 * hits[ends] / (called[ends] + (weight * y).sum())
    at = ends[int(np.argmax(f1))]
    here = logit(p[order][at])
    below = logit(p[order][at + 1]) if at + 1 < len(p) else here - 2
    return max(LEAST_CUT, float(1 / (1 + np.exp(-(here + below) / 2))))


def fit_chain(categories: list[str], words: dict[bytes, int], x: Sparse, y: np.ndarray, fold: np.ndarray, weight: np.ndarray | None = None) -> Chain:
    """Models in order. What a later one sees of an earlier one in training are predictions of models that did not see the row."""
    chain, held_out = Chain(categories, words), np.zeros((x.rows, 0))
    weight = np.ones(x.rows) if weight is None else weight
    for k in range(len(categories)):
        extra = np.c_[logit(held_out), np.ones(x.rows)]
        target, p = y[:, k].astype(float), np.zeros(x.rows)
        for f in range(FOLDS):
            w = fit(x, extra, target, weight * (fold != f))
            z = x.times(w[: x.cols]) + extra @ w[x.cols :]
            p = np.where(fold == f, 1 / (1 + np.exp(-np.clip(z, -30, 30))), p)
        chain.weights.append(fit(x, extra, target, weight))
        chain.cuts.append(cut_of(p, y[:, k], weight))
        held_out = np.c_[held_out, p]
    return chain


def known_labels(labels: DataFrame, categories: dict[str, Column]) -> DataFrame:
    """(doc_id, one 0/1 column for each category), a row for each labelled id."""
    return labels.where("doc_id is not null").select("doc_id", *[F.coalesce(c, F.lit(False)).cast("int").alias(k) for k, c in categories.items()]).groupBy("doc_id").agg(*[F.max(k).alias(k) for k in categories])


def training_rows(documents: DataFrame, known: DataFrame, decisive: str, rows: int, seed: int) -> DataFrame:
    """(doc_id, text, one 0/1 column for each category) of a bounded sample of labels, half of them with the decisive category.

    One row for each label at most: of documents that share its id the one with the least hash of its text.
    """
    order = [F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"))), F.col("doc_id")]
    half = [known.where(F.col(decisive) == v).orderBy(*order).limit(rows // 2) for v in (1, 0)]
    picked = F.broadcast(half[0].unionByName(half[1]))  # of `rows` rows at most
    names = [c for c in known.columns if c != "doc_id"]
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(picked, "doc_id")
    return texts.groupBy("doc_id", *names).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("doc_id", "text", *names)


def class_weights(known: DataFrame, decisive: str, rows: int) -> np.ndarray:
    """What a sampled row without and with the decisive category counts, so that both have their share of all labels; 1 on the mean."""
    counts = {r[0]: r[1] for r in known.groupBy(decisive).count().collect()}
    every = np.array([counts.get(v, 0) for v in (0, 1)], float)
    picked = np.minimum(every, rows // 2)
    return every / np.maximum(picked, 1) * picked.sum() / max(every.sum(), 1)


def train(documents: DataFrame, labels: DataFrame, categories: dict[str, Column], decisive: str, rows: int = LABELLED_ROWS, words: int = WORDS, seed: int = SEED) -> Chain:
    """A chain over `categories` (conditions on labels, in order)."""
    names = list(categories)
    known = known_labels(labels, categories)
    sample = written(training_rows(documents, known, decisive, rows, seed), "labelled")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counter() for _ in range(len(names) + 1)]
        for b in batches:
            flags = [b.column(n).to_pylist() for n in names]
            for i, t in enumerate(b.column("text").to_pylist()):
                found = features(t)
                counts[-1].update(found)
                for k, f in enumerate(flags):
                    if f[i]:
                        counts[k].update(found)
        keys = list(counts[-1])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *[pa.array([c[w] for w in keys], pa.int64()) for c in counts]], names=["word", *[f"n{k}" for k in range(len(names) + 1)]])

    n = len(names)
    per_word = map_batches(sample, counted, "word binary, " + ", ".join(f"n{k} long" for k in range(n + 1))).groupBy("word").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(n + 1)]).where(F.col(f"n{n}") >= LEAST_DOCUMENTS)
    per_word = written(per_word, "words")
    totals = sample.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(c), F.lit(0)) for c in names]).first()
    chosen: dict[bytes, int] = {}
    for k in range(n):
        if 0 < totals[k + 1] < totals[0]:
            a, b, all_a, all_b = F.col(f"n{k}") + 0.5, F.col(f"n{n}") - F.col(f"n{k}") + 0.5, float(totals[k + 1] + 1), float(totals[0] - totals[k + 1] + 1)
            expected = (a + b) / (all_a + all_b)
            worth = F.round(a * F.log(a / (expected * all_a)) + b * F.log(b / (expected * all_b)), 6)
            for r in per_word.select("word", worth.alias("w")).orderBy(F.desc("w"), "word").limit(words).collect():
                chosen.setdefault(bytes(r.word), len(chosen))
    chain = Chain(names, chosen)

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            texts = b.column("text").to_pylist()
            x = chain.rows(texts)
            at = np.searchsorted(x.row, np.arange(x.rows + 1)).astype(np.int32)
            cols = pa.ListArray.from_arrays(pa.array(at), pa.array(x.col, pa.int64()))
            fold = [xxhash.xxh64_intdigest((t or "").encode("utf-8", "surrogatepass"), seed) % FOLDS for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), cols, pa.array(fold, pa.int64()), *[pa.array(b.column(c)) for c in names]], names=["doc_id", "cols", "fold", *names])

    if not chosen:
        return chain
    rows_of = map_batches(sample, matrix, "doc_id long, cols array<long>, fold long, " + ", ".join(f"`{c}` int" for c in names)).toPandas().sort_values("doc_id")  # `rows` rows at most
    sizes = rows_of["cols"].map(len).to_numpy()
    x = Sparse(np.repeat(np.arange(len(rows_of)), sizes), np.concatenate(rows_of["cols"].to_numpy()).astype(np.int64), len(rows_of), len(chosen))
    return fit_chain(names, chosen, x, rows_of[names].to_numpy(), rows_of["fold"].to_numpy(), class_weights(known, decisive, rows)[rows_of[decisive].to_numpy()])


def score(documents: DataFrame, chain: Chain, decisive: str, whole: bool = False) -> DataFrame:
    """(doc_id, p_<category>..., toxic, kept): each whole text in one pass; toxic by the decisive category's cut. whole: with the row itself as struct `row` in place of doc_id."""
    at, key = chain.categories.index(decisive), "row" if whole else "doc_id"
    rows = documents.select(F.struct(*documents.columns).alias("row") if whole else "doc_id", F.col("text").alias("__text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = chain.predict(chain.rows(b.column("__text").to_pylist())) if chain.weights else np.zeros((b.num_rows, len(chain.categories)))
            toxic = p[:, at] >= chain.cuts[at] if chain.weights else np.zeros(b.num_rows, bool)
            yield pa.RecordBatch.from_arrays([b.column(key), *[pa.array(np.round(p[:, k], 9)) for k in range(p.shape[1])], pa.array(toxic), pa.array(~toxic)], names=[key, *[f"p_{c}" for c in chain.categories], "toxic", "kept"])

    return map_batches(rows, each, f"{key} {rows.schema[key].dataType.simpleString()}, " + ", ".join(f"p_{c} double" for c in chain.categories) + ", toxic boolean, kept boolean")


#: The categories of the labels table, in the order of the chain.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1", "toxic_junk": "toxic = 1 and quality = 0"}


def judge(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """documents(doc_id, text, ...), labels(doc_id, quality, toxic) -> (doc_id, p_low_quality, p_toxic, p_toxic_junk, toxic, kept), a row for each row.

    Nulls: a null text has no words and gets the base rates; a null label counts as not given for its categories.
    Equal texts get equal results, and fall into one fold in training; without labels of both kinds nothing is toxic.
    An empty table gives no rows. Further columns are ignored.
    """
    chain = train(documents, labels, {k: F.expr(v) for k, v in CATEGORIES.items()}, "toxic", **options)
    return score(documents, chain, "toxic")


def kept_documents(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows that judge() does not call toxic, with all their columns.

    Nulls, equal texts and tables without labels as in judge(): a row without a text is judged by the base rates. Rows
    with null, equal or repeated ids are judged one by one by their own text; an empty table gives no rows.
    """
    chain = train(documents, labels, {k: F.expr(v) for k, v in CATEGORIES.items()}, "toxic", **options)
    return score(documents, chain, "toxic", whole=True).where("kept").select("row.*")
