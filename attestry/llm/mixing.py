"""Mixing sources to target weights: hash-random order, distributed prefix sums, an exact cut, repeated epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, running_totals, small, written

#: No source, and so no document, is taken more often than this.
MAX_EPOCHS = 3
#: Weights of the sources in code-point order, repeated as often as needed.
WEIGHTS = (1, 2, 3)
SEED = 20


def words(text: Column) -> Column:
    """Number of words; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes(src, source_size) -> (src, source_size, target): shares by weight of the sum of all sizes.

    A target above max_epochs times its source stops there; the excess goes to the others by weight, until none is
    above. Sources stop in the order of that bound for each unit of weight, so the sums of bounds and weights before a
    source in this order say whether it stops: two prefix sums over a row for each source, however many there are.
    """
    ranked = running_totals(sizes.withColumn("one", F.lit(1)), ["src"], "one", name="sources")
    shares = F.array(*[F.lit(w) for w in weights])
    ranked = ranked.select("src", "source_size", F.element_at(shares, (F.col("before") % len(weights) + 1).cast("int")).cast("long").alias("weight"), (F.col("source_size") * max_epochs).alias("most"))
    placed = running_totals(ranked.withColumn("ratio", F.col("most") / F.col("weight")), ["ratio", "src"], "most", name="stops", weight_before="weight").withColumnRenamed("before", "most_before")
    total, all_weights = placed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    exact = lambda c: c.cast("decimal(19,0)")
    stops = exact(F.col("most")) * exact(F.lit(all_weights) - F.col("weight_before")) <= exact(F.col("weight")) * exact(F.lit(total) - F.col("most_before"))
    placed = placed.withColumn("stops", stops)
    given, gone = placed.where("stops").agg(F.coalesce(F.sum("most"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    rest, left = total - given, all_weights - gone
    shared = F.col("weight") * F.lit(float(rest)) / F.lit(float(left or 1))
    return placed.select("src", "source_size", F.when(F.col("stops"), F.col("most").cast("double")).otherwise(shared).alias("target"))


def source_key() -> Column:
    """Sources in order, null last, as a string without nulls."""
    return F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))


def random_key(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def placed_in_sources(rows: DataFrame, ties: list[str], weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """rows(src, key, doc_id, size, ...) with before, source_size, target, whole (epochs) and rest (words of the last, partial epoch)."""
    placed = running_totals(rows, ["src", "key", "doc_id", "size", *ties], "size", by="src", name="mix")
    targets = source_targets(placed.groupBy("src").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as long) div source_size")).otherwise(F.lit(0))
    targets = targets.withColumn("whole", whole).withColumn("rest", F.round("target").cast("long") - F.col("whole") * F.col("source_size"))
    return placed.join(small(targets), "src")


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """documents(doc_id, text, source, ...) -> the decision on each row: doc_id, source, size, source_size, target, taken.

    Each source's rows are sorted by md5(seed:doc_id); the words before each row are a distributed prefix sum; whole
    epochs of the source are taken first, then rows up to the exact budget (the target, rounded), the last one in part.
    Nulls: a null text has no words, a null source is a source of its own and the last one, a null doc_id sorts by its
    own hash. Equal rows and ids stay separate rows; an empty table gives none. Further columns of documents are
    ignored.
    """
    rows = written(documents.select("doc_id", "source", source_key().alias("src"), words(F.col("text")).alias("size"), random_key(seed).alias("key")), "sizes")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return placed_in_sources(rows, [], weights, max_epochs).select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + part).cast("long").alias("taken"))


def mixed_documents(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself, with the columns of documents: a row for each time that a document is taken.

    Each source gives exactly its budget of words: of the one document at which it ends, the last copy has only the words
    that fit. Documents without words are never taken. Nulls as in mix(); rows with null, equal or repeated ids are
    decided one by one, and an empty table gives no rows. Texts are not shuffled: in the order of mix() (equal keys by
    text, then by a row number) each source ends at one row, and every row is compared with it.
    """
    keyed = documents.withColumns({"__src": source_key(), "__size": words(F.col("text")), "__key": random_key(seed), "__hash": F.xxhash64("text"), "__row": F.monotonically_increasing_id()})
    rows = written(keyed.where("__size > 0"), "sized")
    slim = rows.select("doc_id", *[F.col(f"__{c}").alias(c) for c in ("src", "size", "key", "hash", "row")])
    place = F.struct("key", "doc_id", "size", "hash", "row")
    placed = placed_in_sources(slim, ["hash", "row"], weights, max_epochs)
    end = F.max(F.when(F.col("before") < F.col("rest"), F.struct(place.alias("place"), (F.col("rest") - F.col("before")).alias("words"))))
    ends = placed.groupBy("src", "whole", "rest").agg(end.alias("__end")).select(F.col("src").alias("__of"), F.col("whole").alias("__whole"), "__end")
    joined = rows.join(small(ends), F.col("__src") == F.col("__of"))
    own = F.struct(F.col("__key").alias("key"), F.col("doc_id").alias("doc_id"), F.col("__size").alias("size"), F.col("__hash").alias("hash"), F.col("__row").alias("row"))
    part = F.when(F.col("__end").isNull() | (own > F.col("__end.place")), F.lit(0)).when(own == F.col("__end.place"), F.least(F.col("__size"), F.col("__end.words"))).otherwise(F.col("__size"))
    taken = joined.withColumn("__taken", (F.col("__whole") * F.col("__size") + part).cast("long")).where("__taken > 0")
    copies = taken.withColumn("__copy", F.explode(F.expr("sequence(0L, (__taken - 1) div __size)")))
    fits = F.expr("least(__size, __taken - __copy * __size)")
    begun = F.array_join(F.slice(F.regexp_extract_all(F.col("text"), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), fits.cast("int")), "")
    out = copies.withColumn("__fits", fits).withColumn("text", F.when(F.col("__fits") < F.col("__size"), begun).otherwise(F.col("text")))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.col("__fits") < F.col("__size"), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*documents.columns)


ORACLE_SQL = f"""
with docs as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size,
    md5('{SEED}:' || coalesce(doc_id::varchar, 'null')) as key from documents
), sources as (
  select source, sum(size)::bigint as source_size, (row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)} + 1 as weight from docs group by 1
), stops as (
  select *, {MAX_EPOCHS} * source_size as most, sum(source_size) over () as total, sum(weight) over () as weights,
    coalesce(sum({MAX_EPOCHS} * source_size) over w, 0) as most_before, coalesce(sum(weight) over w, 0) as weight_before
  from sources window w as (order by {MAX_EPOCHS} * source_size / weight::double, source nulls last rows between unbounded preceding and 1 preceding)
), capped as (
  select *, most * (weights - weight_before) <= weight * (total - most_before) as stopped from stops
), line as (
  select coalesce(sum(most) filter (stopped), 0) as given, coalesce(sum(weight) filter (stopped), 0) as gone from capped
), targets as (
  select source, source_size, case when stopped then most::double else weight::double * (total - given)::double / (weights - gone)::double end as target from capped, line
), placed as (
  select d.*, t.source_size, t.target, round(t.target)::bigint as budget,
    coalesce(sum(d.size) over (partition by d.source order by d.key, d.doc_id nulls first, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as before_
  from docs d join targets t on d.source is not distinct from t.source
)
select doc_id, size, source_size, target, (case when source_size > 0 then budget // source_size * size
  + greatest(0, least(size, budget - budget // source_size * source_size - before_)) else 0 end)::bigint as taken from placed
"""
