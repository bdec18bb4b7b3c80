"""Rules over coded records: the clause language, support, lift, admission."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.schemas import period_index

FIELD_PREFIX = "field:"


@dataclass(frozen=True)
class Admission:
    min_papers: int = 3
    min_periods: int = 2
    min_lift: float = 1.5
    shared_min_scholar_share: float = 0.6
    min_annotated_for_rejection: int = 10


@dataclass(frozen=True)
class Rule:
    rule_id: str
    lens: str
    layer: str
    requires: tuple[str, ...]
    status: str = "seed"
    keys: tuple[str, ...] = ()
    candidate_sources: tuple[str, ...] = field(default=())


def any_starts(codes: Column, start: str) -> Column:
    return F.exists(codes, lambda c: c.startswith(start))


def clause(text: str, codes: Column, fields: Column) -> Column:
    """`field:NAME`, taken literally, or alternatives `CODE|FAMILY-*`."""
    if text.startswith(FIELD_PREFIX):
        return F.array_contains(fields, text[len(FIELD_PREFIX) :])
    exact: list[str] = []
    out = F.lit(False)
    for alternative in (a.strip() for a in text.split("|")):
        if alternative.endswith("-*"):
            out = out | any_starts(codes, alternative[:-1])
        else:
            exact.append(alternative)
    return out | F.arrays_overlap(codes, F.array(*[F.lit(x) for x in exact])) if exact else out


def satisfied(requires: tuple[str, ...] | list[str], codes: Column, fields: Column) -> Column:
    """All clauses hold; an empty rule never does."""
    out = F.lit(bool(requires))
    for c in requires:
        out = out & F.coalesce(clause(c, codes, fields), F.lit(False))
    return out


def lift(s_in: Column, n_in: Column, s_out: Column, n_out: Column) -> Column:
    """Ratio of the smoothed rates inside and outside; null if either side is empty."""
    return F.when((n_in > 0) & (n_out > 0), ((s_in + 0.5) / (n_in + 1)) / ((s_out + 0.5) / (n_out + 1)))


def training(records: DataFrame, allow_unsplit: bool = False) -> DataFrame:
    """All records that aren't held out; one without a split fails the job that reads it, unless allowed. No pass of its own."""
    split = F.coalesce("split", F.lit(""))
    if allow_unsplit:
        return records.where(split != "heldout")
    broken = F.raise_error(F.concat(F.lit("records without a split, e.g. "), F.coalesce(F.col("paper_id").cast("string"), F.lit("null")))).cast("boolean")
    return records.where(F.when(split == "train", True).when(split == "heldout", False).otherwise(broken))


def satisfied_counts(train: DataFrame, rules: list[Rule]) -> DataFrame:
    """(scholar_key, period, n, one count for each rule `s0`...): every rule in one pass over the records, a row for each group and task."""
    hits = [F.count_if(satisfied(r.requires, F.col("codes"), F.col("fields"))).alias(f"s{i}") for i, r in enumerate(rules)]
    return train.groupBy("scholar_key", "period").agg(F.count(F.lit(1)).alias("n"), *hits)


def rule_counts(train: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, scholar_key, period, n, s) in long form."""
    counts = satisfied_counts(train, rules)
    pairs = F.array(*[F.struct(F.lit(i).alias("rule"), F.col(f"s{i}").alias("s")) for i in range(len(rules))])
    return counts.select("scholar_key", "period", "n", F.explode(pairs).alias("x")).select("x.rule", "scholar_key", "period", "n", "x.s")


def support(records: DataFrame, rules: list[Rule], admission: Admission = Admission(), allow_unsplit: bool = False) -> DataFrame:
    """A row for each rule: support, periods, comparison, what failed, and what to do with its status.

    Shared rules are judged by papers and the share of traditions; the others by papers, periods and lift of their own
    traditions (keys) against all others. Lift and share are compared unrounded.
    """
    spark, a = records.sparkSession, admission
    counts = rule_counts(training(records, allow_unsplit), rules)
    rows = [(i, r.rule_id, r.lens, r.layer, r.status, list(r.keys)) for i, r in enumerate(rules)]
    known = spark.createDataFrame(rows, "rule int, rule_id string, lens string, layer string, status string, keys array<string>")  # the registry
    own = (F.col("layer") == "shared") | F.array_contains("keys", F.col("scholar_key"))
    seen = F.when(own & (F.col("s") > 0) & (F.coalesce("period", F.lit("")) != ""), F.col("period"))
    # a rule without a single record still gets its row
    per = known.join(counts, "rule", "left").fillna(0, ["n", "s"]).groupBy("rule", "rule_id", "lens", "layer", "status").agg(
        F.sum(F.when(own, F.col("s")).otherwise(0)).alias("n_support"), F.sum(F.when(own, F.col("n")).otherwise(0)).alias("n_annotated"),
        F.sum(F.when(own, 0).otherwise(F.col("s"))).alias("n_other_support"), F.sum(F.when(own, 0).otherwise(F.col("n"))).alias("n_other"),
        F.collect_set(seen).alias("seen"), F.count_distinct(F.when(F.col("s") > 0, F.col("scholar_key"))).alias("with_support"), F.count_distinct("scholar_key").alias("traditions"),
    )
    shared = F.col("layer") == "shared"
    out = per.withColumn("n_periods", F.size("seen").cast("long")).withColumn("share", F.when(shared, F.when(F.col("traditions") > 0, F.col("with_support") / F.col("traditions")).otherwise(0.0)))
    out = out.withColumn("lift", F.when(~shared, lift(F.col("n_support"), F.col("n_annotated"), F.col("n_other_support"), F.col("n_other"))))
    why = F.array(
        F.when(F.col("n_support") < a.min_papers, "papers"), F.when(shared & (F.col("share") < a.shared_min_scholar_share), "share"),
        F.when(~shared & (F.col("n_periods") < a.min_periods), "periods"), F.when(~shared & F.col("lift").isNull(), "no comparison"), F.when(~shared & (F.col("lift") < a.min_lift), "lift"),
    )
    out = out.withColumn("reasons", F.filter(why, lambda x: x.isNotNull())).withColumn("passed", F.size("reasons") == 0)
    told = F.when(F.col("passed"), F.when(F.col("status") == "seed", "candidate").otherwise(F.col("status"))).when(F.col("n_annotated") >= a.min_annotated_for_rejection, "rejected").otherwise("insufficient_data")
    ordered = F.array_sort(F.transform("seen", lambda p: F.struct(period_index(p).alias("i"), p.alias("p"))))
    return out.withColumn("suggestion", told).withColumn("periods", F.transform(ordered, lambda x: x["p"])).select("rule_id", "lens", "layer", "status", "n_support", "n_annotated", "n_other_support", "n_other", "n_periods", "periods", "share", "lift", "passed", "suggestion", "reasons")


def support_papers(records: DataFrame, rules: list[Rule], allow_unsplit: bool = False) -> DataFrame:
    """(rule_id, paper_id): the papers behind n_support."""
    hits = F.array(*[F.when(satisfied(r.requires, F.col("codes"), F.col("fields")) & (F.lit(r.layer == "shared") | F.col("scholar_key").isin(*(r.keys or ("",)))), F.lit(r.rule_id)) for r in rules])
    return training(records, allow_unsplit).select("paper_id", F.explode(hits).alias("rule_id")).where("rule_id is not null").select("rule_id", "paper_id")


def candidate_hits(records: DataFrame, rules: list[Rule], allow_unsplit: bool = False) -> DataFrame:
    """(rule_id, candidate_annotated, candidate_hits): how many of the papers named beforehand were annotated, and how many support the rule."""
    named = F.broadcast(records.sparkSession.createDataFrame([(r.rule_id, p) for r in rules for p in set(r.candidate_sources)], "rule_id string, paper_id string"))  # the registry
    train = training(records, allow_unsplit).select("paper_id", "codes", "fields", "scholar_key").join(named.select("paper_id").distinct(), "paper_id", "left_semi")
    papers = support_papers(train.withColumn("split", F.lit("train")), rules).withColumn("hit", F.lit(1))
    return named.join(train.select("paper_id", F.lit(1).alias("there")), "paper_id", "left").join(papers, ["rule_id", "paper_id"], "left").groupBy("rule_id").agg(F.count("there").alias("candidate_annotated"), F.count("hit").alias("candidate_hits"))


def code_matrix(records: DataFrame, keys: list[str] | None = None, allow_unsplit: bool = False) -> DataFrame:
    """(code, a column for each tradition): papers of the training part that have the code."""
    long = training(records, allow_unsplit).select("scholar_key", F.explode(F.array_distinct("codes")).alias("code"))
    counts = long.groupBy("code", "scholar_key").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("code").pivot("scholar_key", keys).agg(F.sum("n")).fillna(0)


def covering_rules(combos: DataFrame, rules: list[Rule]) -> DataFrame:
    """combos(scholar_key, combo array) -> with `covered`: rules of the tradition that the combination alone satisfies."""
    none = F.array().cast("array<string>")
    hits = [F.when(satisfied(r.requires, F.col("combo"), none) & F.col("scholar_key").isin(*(r.keys or ("",))), F.lit(r.rule_id)) for r in rules]
    return combos.withColumn("covered", F.filter(F.array(*hits), lambda x: x.isNotNull()) if hits else none)


def contamination(allow_unverified: bool, allow_unsplit: bool) -> list[str]:
    """Which gates were passed by, for the report."""
    return [name for name, on in (("unverified annotations", allow_unverified), ("papers without a split", allow_unsplit)) if on]


