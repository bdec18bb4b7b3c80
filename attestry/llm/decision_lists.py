"""Quality rules: a decision list learned by sequential covering, emitted as an ordered Spark conditional expression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches

SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\r\x0b\x0c"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: The learner sees this many labelled rows at most, those with the least md5 of seed and id.
LABELLED_ROWS = 20_000
#: Thresholds tried for each feature: quantiles of the sample.
CUTS = 48
MAX_RULES = 12
MAX_CONDITIONS = 4
#: A rule is kept if at least this share of what it covers in the pruning set is of low quality.
LEAST_PRECISION = 0.9
LEAST_COVER = 3
SEED = 9
STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
#: What thresholds are put on, over the counts above.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def text_stats(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word) of a whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeats = 0
    if len(words) > 3:
        seen: dict[bytes, int] = {}
        code = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
        size = len(seen)
        pair = code[:-1] * size + code[1:]
        if size > 2_000_000:
            pair = np.unique(pair, return_inverse=True)[1]
        _, which, times = np.unique(pair[: len(code) - 2] * size + code[2:], return_inverse=True, return_counts=True)
        twice = times[which] > 1
        if twice.any():
            covered = np.zeros(len(words), bool)
            for k in range(3):
                covered[k : k + len(twice)] |= twice
            repeats = int(covered.sum())
    white = len(raw) - len(raw.translate(None, WHITE))
    return len(words), len(text) - white, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeats, len(lines)


def document_stats(documents: DataFrame, whole: bool = False) -> DataFrame:
    """(doc_id, the counts of text_stats) of each row; a null text has no words. whole: with the row itself as struct `row`."""
    names = [f.split()[0] for f in STATS.split(", ")][1:]
    kept = "row" if whole else "doc_id"
    rows = documents.select(F.struct(*documents.columns).alias("row") if whole else "doc_id", F.col("text").alias("__text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = np.array([text_stats(t) for t in b.column("__text").to_pylist()], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([b.column(kept), *[pa.array(stats[:, k]) for k in range(len(names))]], names=[kept, *names])

    return map_batches(rows, each, f"{kept} {rows.schema[kept].dataType.simpleString()}, " + STATS.partition(", ")[2])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.cut if self.above else x[self.feature] <= self.cut

    def sql(self) -> str:
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} {self.cut!r}D"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def grown(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Adds the condition with the most information gain until no good row is covered."""
    rule: Rule = ()
    live = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS and (~bad & live).any() and (bad & live).any():
        p, n = (bad & live).sum(), (~bad & live).sum()
        now, best, most = np.log2(p / (p + n)), None, 1e-9
        for name, values in x.items():
            cuts = np.unique(np.quantile(values[live], np.linspace(0, 1, CUTS + 2)[1:-1]))
            edges = np.unique(values[live & bad])
            middle = [(values[live & ~bad & (values < e)].max(initial=-np.inf) + e) / 2 for e in edges[:1]] + [(values[live & ~bad & (values > e)].min(initial=np.inf) + e) / 2 for e in edges[-1:]]
            for cut in [*[m for m in middle if np.isfinite(m)], *cuts]:  # of equal gains the one in the middle of a gap
                up = values > cut
                for above, hit in ((True, up & live), (False, ~up & live)):
                    p1, n1 = (hit & bad).sum(), (hit & ~bad).sum()
                    if p1 and (gain := p1 * (np.log2(p1 / (p1 + n1)) - now)) > most:
                        best, most = Condition(name, above, float(cut)), gain
        if best is None:
            break
        rule, live = (*rule, best), live & best.holds(x)
    return rule


def pruned(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, float, int]:
    """The beginning of the rule that does best on the pruning set, its precision there and the low-quality rows it covers."""
    best: tuple[float, Rule, float, int] | None = None
    for k in range(1, len(rule) + 1):
        hit = covers(rule[:k], x)
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        worth = (p - n) / max(1, p + n)
        if best is None or worth > best[0]:
            best = (worth, rule[:k], p / max(1, p + n), p)
    return (best[1], best[2], best[3]) if best else ((), 0.0, 0)


def learn(x: dict[str, np.ndarray], bad: np.ndarray, seed: int = SEED) -> list[Rule]:
    """Ordered rules, each of which rejects; what none of them covers is kept."""
    rng, rules = np.random.default_rng(seed), []
    while len(rules) < MAX_RULES and bad.sum() >= LEAST_COVER:
        part = rng.permutation(len(bad)) % 3 != 0
        rule = grown({k: v[part] for k, v in x.items()}, bad[part])
        rule, precision, hits = pruned(rule, {k: v[~part] for k, v in x.items()}, bad[~part])
        hit = covers(rule, x) if rule else np.zeros(len(bad), bool)
        if not rule or precision < LEAST_PRECISION or (hit & bad).sum() < LEAST_COVER:
            break
        rules.append(rule)
        x, bad = {k: v[~hit] for k, v in x.items()}, bad[~hit]
    return rules


def kept_sql(rules: list[Rule]) -> str:
    """The list as one conditional expression over the counts of document_stats."""
    if not rules:
        return "true"
    return "case " + " ".join(f"when {' and '.join(c.sql() for c in r)} then false" for r in rules) + " else true end"


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def learned(documents: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS, seed: int = SEED) -> str:
    """The decision list as SQL, from the labelled documents among the `rows` ids with the least hash that pass the base rule; quality 0 is what it rejects."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    picked = known.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"))), "doc_id").limit(rows)
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")  # of `rows` rows at most
    # one row for each label: of documents that share its id the one with the least hash of its text
    texts = texts.groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    sample = document_stats(texts, whole=True).where(~base_failed()).select("row.doc_id", "row.quality", *[F.expr(e).alias(k) for k, e in FEATURES.items()]).toPandas().sort_values("doc_id")
    bad = (sample["quality"] == 0).to_numpy()
    return kept_sql(learn({k: sample[k].to_numpy(float) for k in FEATURES}, bad, seed) if len(bad) else [])


def judge(documents: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS, seed: int = SEED) -> DataFrame:
    """documents(doc_id, text, ...), labels(doc_id, quality) -> (doc_id, the counts, base_failed, kept), a row for each row.

    Nulls: a null text has no words and fails the base rule; labels with a null are not used; without labels of both
    kinds only the base rule decides. Equal rows and ids are judged alike; an empty table gives no rows. Further columns
    are ignored.
    """
    rule = learned(documents, labels, rows, seed)
    return document_stats(documents).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.expr(rule))


def kept_documents(documents: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS, seed: int = SEED) -> DataFrame:
    """The rows that judge() keeps, with all their columns, in one pass.

    Nulls and tables without labels as in judge(): a row without a text fails the base rule and goes. Rows with null,
    equal or repeated ids are judged one by one by their own text; an empty table gives no rows.
    """
    rule = learned(documents, labels, rows, seed)
    return document_stats(documents, whole=True).where(~base_failed() & F.expr(rule)).select("row.*")
