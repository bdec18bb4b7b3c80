"""Agreement and comparison statistics. Undefined results are null."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from attestry.functions.md5 import drawn_means
from attestry.operators.stages import numbered, settled

#: Values of a bootstrap's units that go into one row.
CHUNK = 16_384


def cohen_kappa(pairs: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """(by..., n, p_observed, kappa) over rows of two ratings, from the table of pairs alone."""
    by = by or []
    cells = pairs.groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("c"))
    both = cells.select(*by, F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("c").alias("ca"), F.lit(0).alias("cb")), F.struct(F.col("b").alias("v"), F.lit(0).alias("ca"), F.col("c").alias("cb")))).alias("x")).groupBy(*by, "x.v").agg(F.sum("x.ca").alias("ca"), F.sum("x.cb").alias("cb"))
    chance = both.groupBy(*by).agg(F.sum(F.col("ca").cast("double") * F.col("cb")).alias("same"))
    seen = cells.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("a").eqNullSafe(F.col("b")), F.col("c")).otherwise(0)).alias("agreed"))
    out = seen.join(chance, by) if by else seen.join(F.broadcast(chance))  # one row each
    po, pe = F.col("agreed") / F.col("n"), F.col("same") / (F.col("n").cast("double") * F.col("n"))
    kappa = F.when(pe < 1, (po - pe) / (1 - pe)).when(po >= 1, 1.0)
    return out.select(*by, "n", po.alias("p_observed"), kappa.alias("kappa"))


def family_kappa(first: DataFrame, second: DataFrame, codes: DataFrame, flag_below: float = 0.6) -> DataFrame:
    """first, second(paper_id, codes array), codes(code, family) -> (family, n, p_observed, kappa, flagged).

    A unit is a paper that both have, times a code of the family. Absent codes are counted, not listed: only the cells
    with a code on either side become rows.
    """
    both = first.select("paper_id", F.col("codes").alias("x")).join(second.select("paper_id", F.col("codes").alias("y")), "paper_id")
    sizes = codes.groupBy("family").agg(F.count(F.lit(1)).alias("size"))
    n_papers = both.agg(F.count(F.lit(1)).alias("papers"))
    marked = both.select(F.explode(F.array_union("x", "y")).alias("code"), "x", "y").select("code", F.array_contains("x", F.col("code")).alias("a"), F.array_contains("y", F.col("code")).alias("b")).join(F.broadcast(codes.select("code", "family")), "code")  # the codebook
    seen = marked.groupBy("family").agg(F.count_if(F.col("a") & F.col("b")).alias("yy"), F.count_if(F.col("a") & ~F.col("b")).alias("yn"), F.count_if(~F.col("a") & F.col("b")).alias("ny"))
    t = sizes.join(seen, "family", "left").fillna(0).join(F.broadcast(n_papers)).withColumn("n", F.col("size") * F.col("papers"))
    n, yy, yn, ny = (F.col(c).cast("double") for c in ("n", "yy", "yn", "ny"))
    nn = n - yy - yn - ny
    po = F.when(n > 0, (yy + nn) / n)
    pe = ((yy + yn) * (yy + ny) + (nn + ny) * (nn + yn)) / (n * n)
    kappa = F.when((n > 0) & (pe < 1), (po - pe) / (1 - pe)).when((n > 0) & (po >= 1), 1.0)
    return t.select("family", F.col("n").cast("long").alias("n"), po.alias("p_observed"), kappa.alias("kappa")).withColumn("flagged", F.coalesce(F.col("kappa") < flag_below, F.lit(False)))


def krippendorff_alpha(ratings: DataFrame, unit: list[str], value: str, level: str = "interval", by: list[str] | None = None) -> DataFrame:
    """(by..., n_units, n_values, alpha) of ratings with one row for each unit and coder; nulls are missing.

    Within a unit of m values the pairs' distances have closed sums, so no pair is ever formed: m*Σx² - (Σx)² for
    squared distances, m² - Σ(count of each value)² for unequal ones. Units with one value don't count.
    """
    by = by or []
    rows = ratings.where(F.col(value).isNotNull()).withColumn("x", F.col(value).cast("double") if level == "interval" else F.col(value))
    per = rows.groupBy(*by, *unit, "x").agg(F.count(F.lit(1)).alias("c"))
    dbl = F.col("c").cast("double")
    if level == "interval":
        units = per.groupBy(*by, *unit).agg(F.sum("c").alias("m"), F.sum(dbl * F.col("x")).alias("s1"), F.sum(dbl * F.col("x") * F.col("x")).alias("s2"))
        apart = 2 * (F.col("m") * F.col("s2") - F.col("s1") * F.col("s1"))
        sums = units.where("m > 1").groupBy(*by).agg(F.count(F.lit(1)).alias("n_units"), F.sum("m").alias("n"), F.sum(apart / (F.col("m") - 1)).alias("o"), F.sum("s1").alias("t1"), F.sum("s2").alias("t2"))
        expected = 2 * (F.col("n") * F.col("t2") - F.col("t1") * F.col("t1"))
    else:
        m = F.sum("c").over(Window.partitionBy(*by, *unit))
        paired = per.withColumn("m", m).where("m > 1")
        units = paired.groupBy(*by, *unit).agg(F.max("m").alias("m"), F.sum(dbl * dbl).alias("sq"))
        sums = units.groupBy(*by).agg(F.count(F.lit(1)).alias("n_units"), F.sum("m").alias("n"), F.sum((F.col("m") * F.col("m") - F.col("sq")) / (F.col("m") - 1)).alias("o"))
        totals = paired.groupBy(*by, "x").agg(F.sum("c").alias("k")).groupBy(*by).agg(F.sum(F.col("k").cast("double") * F.col("k")).alias("ksq"))
        sums = sums.join(totals, by) if by else sums.join(F.broadcast(totals))
        expected = F.col("n").cast("double") * F.col("n") - F.col("ksq")
    do, de = F.col("o") / F.col("n"), expected / (F.col("n").cast("double") * (F.col("n") - 1))
    alpha = F.when(de != 0, 1 - do / de).when((de == 0) & (do == 0), 1.0)
    return sums.select(*by, "n_units", F.col("n").alias("n_values"), alpha.alias("alpha"))


def bootstrap(diffs: DataFrame, value: str, key: list[str], by: list[str] | None = None, n_boot: int = 5000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """(by..., n, mean, lo, hi): mean of paired differences with a percentile interval.

    Draw b, place i takes the row number hash(seed, b, i) mod n, in the order of `key`: the same in any engine and
    partitioning. Nulls are dropped. Rows of one `by` are paired units (papers, items), numbered within it by range;
    their values are broadcast in chunks, 8 bytes for each, and every task hashes whole arrays of places for its draws.
    """
    by, spark = by or [], diffs.sparkSession
    rows = numbered(diffs.where(F.col(value).isNotNull()).select(*by, *key, F.col(value).cast("double").alias("x")), by, [*key, "x"], "__i")
    rows = settled(rows.select(*by, F.floor((F.col("__i") - 1) / CHUNK).alias("chunk"), "__i", "x").groupBy(*by, "chunk").agg(F.array_sort(F.collect_list(F.struct("__i", "x"))).alias("all")).select(*by, "chunk", F.transform("all", lambda u: u["x"]).alias("xs")))
    parts = rows.select(*by, F.size("xs").cast("long").alias("n"), F.aggregate("xs", F.lit(0.0), lambda a, x: a + x).alias("s"))
    sizes = parts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("s").alias("s")).select(*by, "n", (F.col("s") / F.col("n")).alias("mean"))
    tasks = min(n_boot, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = spark.range(0, tasks, 1, tasks).select(F.col("id").alias("task")).join(F.broadcast(rows))  # 8 bytes for each unit

    types = [to_arrow_type(rows.schema[c].dataType) for c in by]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict = {}
        for batch in batches:
            for at, of in enumerate(zip(*[batch.column(c).to_pylist() for c in ("task", *by, "chunk")], strict=True)):
                groups.setdefault(of[:-1], []).append((of[-1], batch.column("xs")[at].values.to_numpy().copy()))
        for (task, *of), chunks in groups.items():
            begin, end = n_boot * task // tasks, n_boot * (task + 1) // tasks
            xs = np.concatenate([x for _, x in sorted(chunks, key=lambda c: c[0])])
            chunks.clear()
            means = drawn_means(xs, begin, end, seed)
            yield pa.RecordBatch.from_arrays([*[pa.array([v] * len(means), t) for t, v in zip(types, of, strict=True)], pa.array(means)], names=[*by, "m"])

    means = dealt.mapInArrow(draw, StructType([*[rows.schema[c] for c in by], StructField("m", DoubleType())]))
    lo, hi = max(0, int(alpha / 2 * n_boot // 1)), min(n_boot - 1, -int(-(1 - alpha / 2) * n_boot // 1) - 1)
    sorted_means = means.groupBy(*by).agg(F.array_sort(F.collect_list("m")).alias("all"))  # n_boot numbers
    picked = sorted_means.select(*by, F.get("all", F.lit(lo)).alias("lo"), F.get("all", F.lit(hi)).alias("hi"))
    return (sizes.join(picked, by) if by else sizes.join(F.broadcast(picked))).select(*by, "n", "mean", "lo", "hi")


def set_f1(pred: Column, gold: Column) -> Column:
    """F1 of two sets; null if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(pred, gold))
    a, b = F.size(F.array_distinct(pred)), F.size(F.array_distinct(gold))
    return F.when((a == 0) & (b == 0), None).when(both == 0, 0.0).otherwise(2.0 * both / (a + b))
