"""Held-out structure prediction: gold sets, trivial predictors, model predictors, scores and contrasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.replies import reply_json
from attestry.functions.text import once
from attestry.operators.agreement import bootstrap, set_f1

# Families that are predicted, prompt variants, and the contrasts of interest.
FAMILIES = ("PZ", "GAP", "CON", "MECH", "CTR")
VARIANTS = ("baseline", "rules", "rules_named")
CONTRASTS = (("rules", "baseline"), ("rules", "majority"), ("baseline", "majority"), ("rules_named", "rules"))
DRAWS = 20
#: Tries of a random draw beyond the number of codes, for places that come twice.
SPARE = 8
MOST_CODES = 3


def gold_sets(records: DataFrame, codes: DataFrame, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """(paper_id, split, family, gold): a row for each paper and family, also for empty sets."""
    of = codes.where(F.col("family").isin(*families)).groupBy("family").agg(F.collect_set("code").alias("known"))  # the codebook
    known = records.sparkSession.createDataFrame([(f,) for f in families], "family string").distinct().join(of, "family", "left")
    none = F.array().cast("array<string>")
    rows = records.select("paper_id", "split", F.coalesce("codes", none).alias("codes")).join(F.broadcast(known))
    return rows.select("paper_id", "split", "family", F.array_sort(F.array_intersect("codes", F.coalesce("known", none))).alias("gold"))


def code_frequencies(gold: DataFrame) -> DataFrame:
    """(family, code, n) of the training part, in the strict sense here."""
    return gold.where("split = 'train'").select("family", F.explode("gold").alias("code")).groupBy("family", "code").agg(F.count(F.lit(1)).alias("n"))


def set_sizes(gold: DataFrame) -> DataFrame:
    """(family, k): half-even rounded median size of the training sets, one at least, also without data."""
    sizes = gold.withColumn("size", F.when(F.col("split") == "train", F.size("gold")))
    return sizes.groupBy("family").agg(F.greatest(F.lit(1), F.coalesce(F.bround(F.median("size"), 0).cast("int"), F.lit(1))).alias("k"))


def majority(gold: DataFrame) -> DataFrame:
    """(family, pred): the k most frequent codes; ties by code."""
    place = F.row_number().over(Window.partitionBy("family").orderBy(F.desc("n"), "code"))
    top = code_frequencies(gold).withColumn("place", place).join(F.broadcast(set_sizes(gold)), "family").where("place <= k")
    return top.groupBy("family").agg(F.array_sort(F.collect_list("code")).alias("pred"))


def random_scores(gold: DataFrame, draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """(paper_id, score): mean over draws of a paper's score for k codes drawn, without replacement, from the multiset of
    training codes. Draws are made within a row.

    A draw takes the first k different places of hash(seed, paper, draw, family, try) mod the size of the multiset; if
    k + SPARE tries give fewer, the first places that are still free. A place belongs to a code by running counts in the
    order of codes. So a draw costs k + SPARE hashes, whatever the counts, and has k places, or all if there are fewer.
    """
    held = gold.where("split = 'heldout'").select("paper_id", "family", "gold")
    ends = F.sum("n").over(Window.partitionBy("family").orderBy("code").rowsBetween(Window.unboundedPreceding, 0))  # a family of the codebook
    pool = code_frequencies(gold).withColumn("end", ends).join(F.broadcast(set_sizes(gold)), "family").groupBy("family", "k").agg(F.array_sort(F.collect_list(F.struct("end", "code"))).alias("pool"), F.sum("n").alias("all"))
    rows = held.join(F.broadcast(pool), "family", "left")

    def place(draw: Column, i: Column) -> Column:
        word = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("paper_id").cast("string"), draw.cast("string"), F.col("family"), i.cast("string")))
        return F.conv(F.substring(word, 1, 8), 16, 10).cast("long") % F.col("all")

    def tries(draw: Column, begin: Column, end: Column) -> Column:
        return F.transform(F.sequence(begin, end), lambda i: place(draw, i))

    def drawn(draw: Column) -> Column:
        # most draws have k different places in k tries; only the others go on
        first = once(F.array_distinct(tries(draw, F.lit(1), F.col("k"))), lambda f: F.when(F.size(f) == F.col("k"), f).otherwise(F.slice(F.array_union(F.array_union(f, tries(draw, F.col("k") + 1, F.col("k") + SPARE)) if SPARE else f, free), F.lit(1), F.col("k"))))
        return F.array_distinct(F.transform(first, lambda p: F.get(F.filter("pool", lambda c: c["end"] > p), F.lit(0))["code"]))

    free = F.sequence(F.lit(0).cast("long"), F.least(F.col("k"), F.col("all")) - 1)
    none = F.array().cast("array<string>")
    f1s = F.transform(F.sequence(F.lit(1), F.lit(draws)), lambda d: once(F.when(F.col("all").isNull(), none).otherwise(drawn(d)), lambda pred: set_f1(pred, F.col("gold"))))
    # whether a family's F1 is defined doesn't depend on the draw, so means of families can be taken last
    scored = rows.select("paper_id", (F.aggregate(f1s, F.lit(0.0), lambda a, x: a + x) / draws).alias("f1"))
    return scored.groupBy("paper_id").agg(F.avg("f1").alias("score"))


def scores(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """predictions(paper_id, system, family, pred) -> (paper_id, system, score): mean of the families' F1 that are defined."""
    held = gold.where("split = 'heldout'").select("paper_id", "family", "gold")
    none = F.array().cast("array<string>")
    given = predictions.groupBy("paper_id").agg(F.collect_list(F.struct("system", "family", "pred")).alias("given"))  # a paper's families, for each system
    rows = held.groupBy("paper_id").agg(F.collect_list(F.struct("family", "gold")).alias("held")).join(given, "paper_id")
    rows = rows.select("paper_id", "held", "given", F.explode(F.array_distinct(F.transform("given", lambda g: g["system"]))).alias("system"))
    own = rows.select("paper_id", "system", "held", F.filter("given", lambda g: g["system"] == F.col("system")).alias("given"))

    def f1s(h: Column) -> Column:
        found = F.filter("given", lambda g: g["family"] == h["family"])
        return F.transform(F.when(F.size(found) > 0, F.transform(found, lambda g: F.coalesce(g["pred"], none))).otherwise(F.array(none)), lambda pred: set_f1(pred, h["gold"]))

    f1 = own.select("paper_id", "system", F.filter(F.flatten(F.transform("held", f1s)), lambda x: x.isNotNull()).alias("f1"))
    return f1.select("paper_id", "system", F.when(F.size("f1") > 0, F.aggregate("f1", F.lit(0.0), lambda a, x: a + x) / F.size("f1")).alias("score"))


def parsed_predictions(replies: DataFrame, codes: DataFrame, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """replies(paper_id, system, reply) -> (paper_id, system, family, pred): the first three codes of the right family; none if it can't be read."""
    found = F.from_json(reply_json(F.col("reply")), ", ".join(f"{f} array<string>" for f in families))
    rows = replies.withColumn("o", found).select("paper_id", "system", F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.col(f"o.{f}").alias("given")) for f in families])).alias("x")).select("paper_id", "system", "x.family", "x.given")
    known = F.broadcast(codes.groupBy("family").agg(F.collect_set("code").alias("codes")))  # the codebook
    none = F.array().cast("array<string>")
    return rows.join(known, "family", "left").select("paper_id", "system", "family", F.array_distinct(F.slice(F.filter(F.coalesce("given", none), lambda c: F.array_contains("codes", c)), 1, MOST_CODES)).alias("pred"))


def summary(per_paper: DataFrame) -> DataFrame:
    """(system, mean_f1, n)."""
    return per_paper.where("score is not null").groupBy("system").agg(F.bround(F.avg("score"), 4).alias("mean_f1"), F.count(F.lit(1)).alias("n"))


def contrasts(per_paper: DataFrame, pairs: tuple[tuple[str, str], ...] = CONTRASTS, n_boot: int = 5000, seed: int = 0) -> DataFrame:
    """(contrast, n, mean, lo, hi) of paired differences; n also counts pairs with an undefined score, which the interval drops."""
    a = per_paper.select("paper_id", F.col("system").alias("sa"), F.col("score").alias("xa"))
    b = per_paper.select("paper_id", F.col("system").alias("sb"), F.col("score").alias("xb"))
    wanted = F.broadcast(per_paper.sparkSession.createDataFrame([(x, y) for x, y in pairs], "sa string, sb string"))
    diffs = a.join(wanted, "sa").join(b, ["paper_id", "sb"]).select(F.concat_ws(" - ", "sa", "sb").alias("contrast"), "paper_id", (F.col("xa") - F.col("xb")).alias("d"))
    counted = diffs.groupBy("contrast").agg(F.count(F.lit(1)).alias("n_pairs"))
    boot = bootstrap(diffs, "d", ["paper_id"], ["contrast"], n_boot, seed)
    return counted.join(boot, "contrast", "left").select("contrast", F.col("n_pairs").alias("n"), F.bround("mean", 4).alias("mean"), F.bround("lo", 4).alias("lo"), F.bround("hi", 4).alias("hi"))


def evidence_text(value: Column, none: str = "(not stated)") -> Column:
    """The evidence design: an array's parts joined, a string as it is, else a placeholder. value: JSON text or plain text."""
    parts = F.from_json(value, "array<string>")
    return F.coalesce(F.when(value.startswith("["), F.array_join(parts, "；")), F.nullif(value, F.lit("")), F.lit(none))


def rules_block(rules: DataFrame, lenses: DataFrame, named: bool) -> str:
    """The rules that a prompt variant shows: shared and panel lenses, every rule that isn't rejected. A registry is small; it is rendered on the driver."""
    kept = rules.where("status <> 'rejected'").join(F.broadcast(lenses.where("panel or lens = 'SH'")), "lens").select("lens", "name", "scholars", "questions", "rule_id", "trigger", "action").orderBy("lens", "rule_id").collect()
    out: list[str] = []
    for i, r in enumerate(kept):
        if not i or kept[i - 1].lens != r.lens:
            out += ["", f"## {r.lens} {r.name}" + (f" (after {', '.join(r.scholars)})" if named and r.scholars else ""), *[f"- Ask: {q}" for q in r.questions or []]]
        out.append(f"- {r.rule_id}: when {(r.trigger or '').rstrip('。.')}, {r.action}")
    return "\n".join(out).strip()


def prompts(held: DataFrame, template: str, codebook: str, blocks: dict[str, str]) -> DataFrame:
    """held(paper_id, title, abstract, evidence) -> (paper_id, system, prompt) for each variant."""
    from attestry.functions.text import filled, first_half

    rows = held.withColumn("x", F.explode(F.array(*[F.struct(F.lit(k).alias("system"), F.lit(v).alias("rules")) for k, v in blocks.items()])))
    text = filled(F.lit(template), {"RULES": F.col("x.rules"), "CODEBOOK": F.lit(codebook), "TITLE": F.col("title"), "ABSTRACT_HALF": first_half(F.col("abstract")), "EVIDENCE": evidence_text(F.col("evidence"))})
    return rows.select("paper_id", "x.system", text.alias("prompt"))
