"""Frequent combinations of up to three codes that set a tradition apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.operators.rules import Admission, lift, training
from attestry.operators.stages import settled

def pairs_of(codes: Column, base: int) -> Column:
    """array<long>: each pair i < j of the sorted numbers of a record, as i + base * j."""
    after = lambda i: F.slice(codes, i + 2, F.greatest(F.size(codes) - i - 1, F.lit(0)))
    return F.flatten(F.transform(codes, lambda x, i: F.transform(after(i), lambda y: x + base * y)))


def triples_of(pairs: Column, base: int) -> Column:
    """array<long>: each i < j < k of which all three pairs are there, as i + base * j + base**2 * k."""

    def third(p: Column) -> Column:
        x, y = F.pmod(p, F.lit(base)), F.floor(p / base).cast("long")
        follows = F.filter(pairs, lambda q: (F.pmod(q, F.lit(base)) == y) & F.array_contains(pairs, x + base * F.floor(q / base).cast("long")))
        return F.transform(follows, lambda q: p + base * base * F.floor(q / base).cast("long"))

    return F.flatten(F.transform(pairs, third))


def combinations(codes: Column) -> Column:
    """array<array<string>>: the pairs of the sorted, distinct codes of a record."""
    c = F.array_sort(F.array_distinct(codes))
    after = lambda i: F.slice(c, i + 2, F.greatest(F.size(c) - i - 1, F.lit(0)))
    return F.flatten(F.transform(c, lambda x, i: F.transform(after(i), lambda y: F.array(x, y))))


def mine(records: DataFrame, admission: Admission = Admission(), top: int = 30, allow_unsplit: bool = False) -> DataFrame:
    """(scholar_key, combo, size, n, n_inside, n_out, n_outside, lift, place): the best combinations of each tradition.

    Level by level: codes that no tradition has in enough papers go first, then pairs; a triple is only made of pairs
    that are all left, so a record of any number of codes makes as many rows as can pass. Codes are numbered, and a
    combination is one number. They are counted by tradition and period, so that outside support is a total less the
    inside one. An empty period counts as one here. Ties: lift, n, then smaller, then alphabetical.
    """
    a, train = admission, training(records, allow_unsplit)
    sizes = train.groupBy("scholar_key").agg(F.count(F.lit(1)).alias("n_inside"))
    total = sizes.agg(F.sum("n_inside").alias("n_all"))
    often = train.select("scholar_key", F.explode(F.array_distinct("codes")).alias("code")).groupBy("scholar_key", "code").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= a.min_papers)
    names = sorted(r.code for r in often.select("code").distinct().collect())  # codes of the codebook
    base = len(names) + 1
    known = F.array(*[F.lit(x) for x in names]).cast("array<string>")
    numbers = F.array_sort(F.filter(F.transform(F.array_distinct("codes"), lambda c: F.array_position(known, c).cast("long")), lambda i: i > 0))
    rows = settled(train.select("scholar_key", F.coalesce("period", F.lit("")).alias("period"), numbers.alias("codes")).where(F.size("codes") > 0))

    def counted(combos: Column) -> DataFrame:
        return rows.select("scholar_key", "period", F.explode(combos).alias("combo")).groupBy("combo", "scholar_key", "period").agg(F.count(F.lit(1)).alias("n"))

    small = settled(counted(F.concat("codes", pairs_of(F.col("codes"), base))))
    left = small.where(F.col("combo") >= base).groupBy("combo", "scholar_key").agg(F.sum("n").alias("n")).where(F.col("n") >= a.min_papers).select("combo").distinct()
    kept = F.broadcast(left.agg(F.collect_set("combo").alias("left")))  # pairs of codes of the codebook
    rows = rows.join(kept).withColumn("pairs", F.array_intersect(pairs_of(F.col("codes"), base), F.col("left")))
    counts = small.unionByName(counted(triples_of(F.col("pairs"), base)))
    per = counts.groupBy("combo", "scholar_key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_periods"))
    everywhere = per.withColumn("n_total", F.sum("n").over(Window.partitionBy("combo")))  # a row for each tradition
    found = everywhere.where((F.col("n") >= a.min_papers) & (F.col("n_periods") >= a.min_periods)).join(F.broadcast(sizes), "scholar_key").join(F.broadcast(total)).where(F.col("n_inside") >= a.min_papers)
    found = found.withColumns({"n_out": F.col("n_total") - F.col("n"), "n_outside": F.col("n_all") - F.col("n_inside")})
    found = found.withColumn("lift", lift(F.col("n"), F.col("n_inside"), F.col("n_out"), F.col("n_outside"))).where(F.col("lift") >= a.min_lift)
    digits = F.filter(F.array(*[F.floor(F.col("combo") / base**k).cast("long") % base for k in range(3)]), lambda i: i > 0)
    found = found.withColumn("combo", F.transform(digits, lambda i: F.get(known, i.cast("int") - 1))).withColumn("size", F.size("combo").cast("long"))
    place = F.row_number().over(Window.partitionBy("scholar_key").orderBy(F.desc("lift"), F.desc("n"), "size", F.array_join("combo", " + ")))
    return found.withColumn("place", place).where(F.col("place") <= top).select("scholar_key", "combo", "size", "n", "n_inside", "n_out", "n_outside", "lift", "place")
