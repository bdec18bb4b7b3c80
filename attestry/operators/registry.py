"""The paper registry: selection, import without duplicates, stable ids, sticky splits, status, acquisition plan."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.text import title_key
from attestry.operators.stages import numbered
from attestry.schemas import PAPER_COLUMNS, VERIFIED, period_index

ID_PATTERN = r"^([A-Z]+)-(\d{4})-(\d{2,})$"


def select_rows(papers: DataFrame, ids: str | None = None, scholar: str | None = None, split: str | None = None) -> DataFrame:
    """Rows that meet every filter given. ids: comma separated."""
    if ids:
        papers = papers.where(F.col("paper_id").isin([x.strip() for x in ids.split(",") if x.strip()]))
    if scholar:
        papers = papers.where(F.col("scholar_key") == scholar)
    return papers.where(F.col("split") == split) if split else papers


def hash_rank(seed: int, key: Column) -> Column:
    """A random but repeatable order: sha256("seed:key") in hex."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string")), 256)


def first_by_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key, the first in order. A partial aggregate in each task first, so copies don't travel."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("__r")).select("__r.*")


def import_rows(papers: DataFrame, new: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to add, counts(added, duplicates)): new rows whose title key is neither in the registry nor earlier in the file."""
    keyed = new.withColumn("__key", title_key(F.col("title")))
    fresh = first_by_key(keyed, "__key", order).join(papers.select(title_key(F.col("title")).alias("__key")).distinct(), "__key", "left_anti").drop("__key")
    counts = new.agg(F.count(F.lit(1)).alias("total")).crossJoin(fresh.agg(F.count(F.lit(1)).alias("added"))).select("added", (F.col("total") - F.col("added")).alias("duplicates"))  # one row each
    return fresh, counts


def assign_ids(papers: DataFrame) -> DataFrame:
    """Rows without an id get KEY-YEAR-NN, counting on from the largest NN of their key and year; NN has two digits or more."""
    year = F.when(F.substring("year", 1, 4) == "", "0000").otherwise(F.substring("year", 1, 4))
    has = F.coalesce(F.col("paper_id"), F.lit("")) != ""
    used = papers.where(has).select(F.regexp_extract("paper_id", ID_PATTERN, 1).alias("__k"), F.regexp_extract("paper_id", ID_PATTERN, 2).alias("__y"), F.regexp_extract("paper_id", ID_PATTERN, 3).alias("n")).where("n <> ''").groupBy("__k", "__y").agg(F.max(F.col("n").cast("int")).alias("__most"))
    fresh = numbered(papers.where(~has).withColumn("__y", year), ["scholar_key", "__y"], ["year", "title"], "__n").withColumn("__k", F.col("scholar_key")).join(used, ["__k", "__y"], "left")
    number = F.coalesce("__most", F.lit(0)) + F.col("__n")
    name = F.concat_ws("-", "scholar_key", "__y", F.lpad(number.cast("string"), F.greatest(F.lit(2), F.length(number.cast("string"))), F.lit("0")))
    return papers.where(has).unionByName(fresh.withColumn("paper_id", name).select(*papers.columns))


def first_by_hash(rows: DataFrame, by: str, rank: str, quota: str, digits: int = 3) -> DataFrame:
    """Adds `chosen`: whether a row is among the first `quota` of its `by` in the order of `rank` (hex digits, no ties).

    Rows are counted by the first digits of rank; only the one slice that the quota cuts is sorted. So a group of any
    size is never brought into one task.
    """
    sliced = rows.withColumn("__slice", F.substring(rank, 1, digits))
    counts = sliced.groupBy(by, "__slice").agg(F.count(F.lit(1)).alias("__n"), F.max(quota).alias("__q"))  # 16**digits rows for each group at most
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = counts.withColumn("__before", before).select(F.col(by).alias("__by"), F.col("__slice").alias("__s"), "__before", (F.col("__q") >= F.col("__before") + F.col("__n")).alias("__all"), (F.col("__q") <= F.col("__before")).alias("__none"))
    joined = sliced.join(cut, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__slice") == F.col("__s")))
    split = ~F.col("__all") & ~F.col("__none")
    # rows of a slice that isn't cut need no place: they are spread by further digits
    place = F.row_number().over(Window.partitionBy(by, "__slice", F.when(split, F.lit("")).otherwise(F.substring(rank, digits + 1, 5))).orderBy(rank))
    return joined.withColumn("chosen", F.when(F.col("__all"), True).when(F.col("__none"), False).otherwise(F.col("__before") + place <= F.col(quota))).drop("__slice", "__by", "__s", "__before", "__all", "__none")


def assign_split(papers: DataFrame, ratio: float = 0.2, seed: int = 2026, by: str = "scholar_key", key: str = "paper_id") -> DataFrame:
    """Sticky held-out split for each `by`: seed sources are train, splits given stay, the rest fills held-out up to the
    share (half-even rounded) in hash order, then train."""
    now = F.when(F.col("seed_source") == "1", "train").otherwise(F.coalesce("split", F.lit("")))
    rows = papers.withColumn("split", now)
    totals = rows.groupBy(by).agg(F.greatest(F.bround(F.count(F.lit(1)) * ratio, 0) - F.count_if(F.col("split") == "heldout"), F.lit(0)).cast("long").alias("__quota"))
    open_rows = rows.where("split = ''").join(totals, by).withColumn("__rank", hash_rank(seed, F.col(key)))
    dealt = first_by_hash(open_rows, by, "__rank", "__quota").withColumn("split", F.when(F.col("chosen"), "heldout").otherwise("train"))
    return rows.where("split <> ''").unionByName(dealt.select(*rows.columns))


def split_counts(papers: DataFrame) -> DataFrame:
    return papers.groupBy("scholar_key", "split").agg(F.count(F.lit(1)).alias("n"))


def status_table(papers: DataFrame, texts: DataFrame, annotated: DataFrame) -> DataFrame:
    """For each scholar: papers, verified, partly verified, with text, annotated, train, held out, unsplit, periods in order."""
    rows = papers.join(texts.select("paper_id").distinct().withColumn("__t", F.lit(1)), "paper_id", "left").join(annotated.select("paper_id").distinct().withColumn("__a", F.lit(1)), "paper_id", "left")
    periods = F.transform(F.array_sort(F.collect_set(F.when(F.col("period") != "", F.struct(period_index(F.col("period")).alias("i"), "period")))), lambda x: x["period"])
    return rows.groupBy("scholar_key").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("verify_status").isin(*VERIFIED)).alias("verified"), F.count_if(F.col("verify_status") == "partial").alias("partly"), F.count("__t").alias("with_text"), F.count("__a").alias("annotated"),
        F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "heldout").alias("heldout"), F.count_if(~F.col("split").isin("train", "heldout")).alias("unsplit"), F.array_join(periods, "、").alias("periods"),
    )


def acquisition_plan(papers: DataFrame, texts: DataFrame, per_scholar: int = 15) -> DataFrame:
    """Papers to obtain first, ranked within each scholar: all held out by id, then greedily the best of the rest.

    Held-out papers are only numbered and counted, however many there are. Each further choice depends on the periods
    and types chosen before, so it is a loop over one scholar's pool; of papers that no choice can tell apart only the
    per_scholar with the smallest ids are in it.
    """
    rows = papers.join(texts.select("paper_id").distinct().withColumn("have_fulltext", F.lit("yes")), "paper_id", "left").fillna({"have_fulltext": ""})
    flags = {"f_seed": F.col("seed_source") == "1", "f_verified": F.col("verify_status").isin(*VERIFIED), "f_open": F.coalesce("oa_url", F.lit("")) != "", "f_author": F.col("author_role").isin("sole", "first"), "f_held": F.col("split") == "heldout"}
    rows = rows.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})
    out = ("scholar_key", "rank", "paper_id", "split", "title", "journal", "year", "issue", "paper_type", "period", "oa_url", "have_fulltext", "why")
    columns = [F.col(c).cast("string").alias(c) for c in out if c in PAPER_COLUMNS and c != "scholar_key"]
    reasons = (("f_held", "held out for evaluation"), ("f_seed", "source of a seed rule"), ("f_open", "legally open access"))
    why = F.array_join(F.filter(F.array(*[F.when(F.col(k), F.lit(text)) for k, text in reasons]), lambda x: x.isNotNull()), "; ")
    rows = rows.select("scholar_key", *columns, "have_fulltext", *flags, why.alias("why"))

    held = numbered(rows.where("f_held"), ["scholar_key"], ["paper_id"], "rank").withColumn("rank", F.col("rank").cast("int"))
    taken = held.groupBy("scholar_key", "period", "paper_type").agg(F.count(F.lit(1)).alias("n")).groupBy("scholar_key").agg(F.sum("n").alias("n_held"), F.collect_list(F.struct("period", "paper_type", "n")).alias("held"))
    alike = Window.partitionBy("scholar_key", "period", "paper_type", *[f for f in flags if f != "f_held"]).orderBy("paper_id")
    pool = rows.where("not f_held").withColumn("__n", F.row_number().over(alike)).where(F.col("__n") <= per_scholar).drop("__n")

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("paper_id", kind="stable").reset_index(drop=True)
        known = group["held"].iloc[0]
        known = [] if known is None else list(known)
        at = int(group["n_held"].fillna(0).iloc[0])
        periods: Counter = Counter()
        types = {x["paper_type"] for x in known}
        for x in known:
            periods[x["period"]] += x["n"]
        left, chosen = group.to_dict("records"), []
        while left and at + len(chosen) < per_scholar:
            best = max(range(len(left)), key=lambda i: (left[i]["f_seed"], not periods[left[i]["period"]], left[i]["paper_type"] not in types, left[i]["f_verified"], left[i]["f_open"], left[i]["f_author"], -periods[left[i]["period"]], -i))
            row = left.pop(best)
            chosen.append(row | {"rank": at + len(chosen) + 1})
            periods[row["period"]] += 1
            types.add(row["paper_type"])
        return pd.DataFrame(chosen, columns=list(out))

    schema = ", ".join("rank int" if c == "rank" else f"{c} string" for c in out)
    more = pool.join(taken, "scholar_key", "left").groupBy("scholar_key").applyInPandas(choose, schema)
    return held.select(*out).unionByName(more)


def plan_summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("scholar_key").agg(F.count(F.lit(1)).alias("planned"), F.count_if(F.col("oa_url") != "").alias("open_access"), F.count_if(F.col("have_fulltext") == "yes").alias("with_text"))
