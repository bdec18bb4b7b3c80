"""A corpus pipeline of five stages: quality rules, toxicity, near-duplicates, source mix, token ids.

Each stage takes any documents(doc_id, text, source, ...): further columns stay as they are, an empty table gives no rows,
and rows with null, equal or repeated ids are rows of their own. What nulls, empty texts and ties come to is said at each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attestry.llm import decision_lists, mixing, sentencepiece_viterbi, shingle_pairs, simhash, toxicity
from attestry.llm.common import read_table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rule or the learned decision list rejects; a null or empty text fails the base rule. Equal texts fare alike."""
    return decision_lists.kept_documents(docs, read_table(spark, sf_dir, "labels"))


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier chain calls toxic; a null or empty text has no words and stays. Equal texts fare alike."""
    return toxicity.kept_documents(docs, read_table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each group of near copies: 5-word shingles alike to 0.8 or more.

    SimHash of these shingles, compared bit-sliced, finds the nearest; what a radius can't promise the prefix filter finds.
    Texts without words are one group. Of rows that share the kept id the one with the least text stays; rows without an
    id can't be named by the decision, and stay.
    """
    return simhash.first_of_each(docs, shingle_pairs.near_groups(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that a document is taken; a source's last document ends where its budget does.

    A null source is a source of its own. Documents without words are never taken; ties are broken by text and row.
    """
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, token_ids and their digests of each row; a null or empty text has no ids."""
    return sentencepiece_viterbi.encode(docs, keep=["doc_id", "source"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_documents),
    ("simhash near-dedup", near_copies),
    ("source mix", source_mix),
    ("sentencepiece ids", token_ids),
]

#: SQL has neither the classifiers nor XXH64 nor the encoder: the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each is written and read again, so that no stage repeats another's work."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
