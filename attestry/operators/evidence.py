"""Verbatim evidence: does a quote stand in its text, where it is said to stand?"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from attestry.functions import text as tx
from attestry.functions.fuzzy import fuzzy_ratio
from attestry.operators.stages import settled
from attestry.schemas import FIELDS

MIN_CHARS = 6
MAX_CHARS = 150
MIN_HIT_RATE = 0.9
#: Characters of all quotes that go into one automaton (about 100 bytes each).
AUTOMATON_CHARS = 1_000_000
#: Grams of quotes are broadcast if a count proves them no more than this (12 characters each).
BROADCAST_GRAMS = 500_000


def prepared_texts(texts: DataFrame, pars: Column | None = None, form=tx.normalize) -> DataFrame:  # noqa: ANN001
    """texts(paper_id, text) -> (paper_id, pars: normal form of each paragraph, whole: all of them, fulltext_sha256), once for all quotes.

    Paragraphs are joined with a mark that the normal form drops nowhere, so the one UDF sees a text once. Each step is a
    column of its own, which the next one names: put together into one expression a text would be split a dozen times.
    """
    split = pars if pars is not None else tx.paragraphs(F.col("text"))
    mark = "\uE000"
    joined = texts.select("paper_id", "text", F.array_join(F.transform(split, lambda p: F.replace(p, F.lit(mark), F.lit(""))), mark).alias("joined"))
    normal = joined.select("paper_id", "text", form(F.col("joined")).alias("normal"))
    return normal.select("paper_id", F.split("normal", mark).alias("pars"), F.replace("normal", F.lit(mark), F.lit("")).alias("whole"), F.sha2(F.col("text").cast("binary"), 256).alias("fulltext_sha256"))


def check_quotes(quotes: DataFrame, prepared: DataFrame, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS, fuzzy: float | None = None, form=tx.normalize) -> DataFrame:  # noqa: ANN001
    """quotes(paper_id, quote, loc, ...) -> with status and ratio.

    too_long, too_short, exact (in the paragraphs of a valid locator, or anywhere without one), loc_mismatch (elsewhere
    in the text), fuzzy (nearly, if asked for), miss. Quotes of a paper without a text are misses.
    """
    rows = quotes.join(prepared.select("paper_id", "pars", F.col("whole").alias("__all")), "paper_id", "left").withColumn("__q", form(F.coalesce("quote", F.lit(""))))
    pars = F.coalesce("pars", F.array().cast("array<string>"))
    rows = rows.withColumn("__at", F.filter(tx.located(F.col("loc")), lambda i: (i >= 1) & (i <= F.size(pars))))
    local = F.array_join(F.transform("__at", lambda i: F.get(pars, i.cast("int") - 1)), "")
    status = (
        F.when(F.length(F.coalesce("quote", F.lit(""))) > max_chars, "too_long").when(F.length("__q") < min_chars, "too_short")
        .when((F.size("__at") > 0) & local.contains(F.col("__q")), "exact").when(F.col("__all").contains(F.col("__q")), F.when(F.size("__at") > 0, "loc_mismatch").otherwise("exact")).otherwise("miss")
    )
    rows = rows.withColumn("status", status)
    sure = F.when(F.col("status").isin("exact", "loc_mismatch"), 1.0).otherwise(0.0)
    if fuzzy is None:
        return rows.withColumn("ratio", sure).drop("__q", "__at", "__all", "pars")
    # only misses go to the UDF with their texts
    miss = F.col("status") == "miss"
    ratio = fuzzy_ratio(F.when(miss, F.col("__q")), F.when(miss, F.col("__all")))
    rows = rows.withColumn("ratio", F.when(miss, ratio).otherwise(sure))
    return rows.withColumn("status", F.when(miss & (F.col("ratio") >= fuzzy), "fuzzy").otherwise(F.col("status"))).drop("__q", "__at", "__all", "pars")


def find_quotes(quotes: DataFrame, texts: DataFrame, gram: int = 12, form=tx.normalize) -> DataFrame:  # noqa: ANN001
    """(quote_id, paper_id): every text that contains a quote, without a key to join on.

    quotes(quote_id, quote) are few; texts(paper_id, text) many. Quotes of AUTOMATON_CHARS in all, by count, go into one
    automaton that reads each text once. With more of them: a text that holds a quote holds all its grams, so any one of
    them finds it: each quote is indexed by the gram that the fewest texts hold, and a text meets it only there. Gram
    counts are taken only for grams of quotes. Quotes shorter than a gram always go into the automaton.
    """
    q = settled(quotes.select("quote_id", form(F.col("quote")).alias("q")).where("q <> ''").distinct())
    t = texts.select("paper_id", form(F.col("text")).alias("t"))
    if (q.agg(F.sum(F.length("q"))).first()[0] or 0) <= AUTOMATON_CHARS:
        return by_automaton(q, t).distinct()
    every = F.lit(f"(?s)(?=(.{{{gram}}}))")  # each place is read once, whatever the length
    grams = q.select("quote_id", F.explode(F.regexp_extract_all("q", every, F.lit(1))).alias("g")).distinct()
    known = grams.select("g").distinct()
    known = F.broadcast(known) if known.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS else known
    held = settled(t.select("paper_id", F.explode(F.regexp_extract_all("t", every, F.lit(1))).alias("g")).join(known, "g", "left_semi").distinct())
    counts = held.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    rare = grams.join(counts, "g").groupBy("quote_id").agg(F.min_by("g", F.struct("n", "g")).alias("g"))
    met = held.join(rare, "g").select("quote_id", "paper_id").distinct()
    found = met.join(q, "quote_id").join(t, "paper_id").where(F.col("t").contains(F.col("q"))).select("quote_id", "paper_id")
    n = F.length("q") - gram + 1
    return found.unionByName(by_automaton(q.where(n <= 0), t)).distinct()


def by_automaton(q: DataFrame, t: DataFrame) -> DataFrame:
    """q(quote_id, q), t(paper_id, t) -> (quote_id, paper_id), from one pass over the texts."""
    spark = q.sparkSession
    told = q.groupBy("q").agg(F.collect_list("quote_id").alias("ids")).collect()
    known = spark.sparkContext.broadcast([(r.q, list(r.ids)) for r in told])
    types = {c: d[c].dataType for d, c in ((q.schema, "quote_id"), (t.schema, "paper_id"))}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        found = ahocorasick.Automaton()
        for text, ids in known.value:
            found.add_word(text, ids)
        found.make_automaton()
        for b in batches:
            pairs = [(i, paper) for paper, text in zip(b.column("paper_id").to_pylist(), b.column("t").to_pylist(), strict=True) if text for ids in {id(x): x for _, x in found.iter(text)}.values() for i in ids]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], to_arrow_type(types[c])) for k, c in enumerate(types)], names=list(types))

    if not told:
        return q.select("quote_id").join(t.select("paper_id"), F.lit(False))
    return t.mapInArrow(each, ", ".join(f"{c} {d.simpleString()}" for c, d in types.items()))


def evidence_rows(annotations: DataFrame, codes: DataFrame) -> DataFrame:
    """(paper_id, kind move/field, key, quote, loc): what has to be verified. Moves with unknown codes and fields that are not present have none."""
    moves = annotations.select("paper_id", F.explode_outer("moves").alias("m")).select("paper_id", F.lit("move").alias("kind"), F.coalesce("m.code", F.lit("")).alias("key"), F.explode_outer("m.evidence").alias("e"))
    moves = moves.join(F.broadcast(codes.select(F.col("code").alias("key"))), "key", "left_semi")  # a codebook
    fields = annotations.select("paper_id", F.explode("fields").alias("key", "f")).where((F.col("f.status") == "present") & F.col("key").isin(*FIELDS)).select("paper_id", F.lit("field").alias("kind"), "key", F.explode_outer("f.evidence").alias("e"))
    return moves.unionByName(fields, allowMissingColumns=True).select("paper_id", "kind", "key", F.col("e").isNotNull().alias("given"), F.coalesce("e.quote", F.lit("")).alias("quote"), F.coalesce("e.loc", F.lit("")).alias("loc"))


def hit_rate(ok: Column, n: Column) -> Column:
    """Share of quotes found; 0 without quotes. Exact, loc_mismatch and fuzzy all count."""
    return F.when(n > 0, ok / n).otherwise(F.lit(0.0))


def verify(annotations: DataFrame, prepared: DataFrame, codes: DataFrame, errors: DataFrame, fuzzy: float | None = None, accept_fuzzy: bool = False, min_hit_rate: float = MIN_HIT_RATE) -> DataFrame:
    """One verification row for each annotation: counts, verified and unsupported moves and fields, misses, the gate.

    errors(paper_id, schema_errors) comes from the schema check.
    """
    checked = check_quotes(evidence_rows(annotations, codes), prepared, fuzzy=fuzzy)
    good = ["exact", "loc_mismatch"] + (["fuzzy"] if accept_fuzzy else [])
    checked = checked.withColumn("ok", F.col("given") & F.col("status").isin(*good))
    per_key = checked.groupBy("paper_id", "kind", "key").agg(F.max("ok").alias("ok"))

    def keys(kind: str, ok: bool) -> Column:
        return F.array_sort(F.collect_set(F.when((F.col("kind") == kind) & (F.col("ok") == ok), F.col("key"))))

    sets = per_key.groupBy("paper_id").agg(keys("move", True).alias("verified_moves"), keys("move", False).alias("unsupported_moves"), keys("field", True).alias("verified_fields"), keys("field", False).alias("unsupported_fields"))
    statuses = ("exact", "loc_mismatch", "fuzzy", "miss", "too_short", "too_long")
    given = checked.where("given")
    misses = F.collect_list(F.when(~F.col("ok"), F.struct(F.concat_ws(":", "kind", "key").alias("where"), "status", F.substring("quote", 1, 80).alias("quote"))))
    counts = given.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_quotes"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in statuses], F.array_sort(misses).alias("misses"))
    unknown = annotations.select("paper_id", F.explode("moves").alias("m")).select("paper_id", F.coalesce("m.code", F.lit("")).alias("code")).join(F.broadcast(codes.select("code")), "code", "left_anti").groupBy("paper_id").agg(F.array_sort(F.collect_list("code")).alias("unknown_codes"))
    none = F.array().cast("array<string>")
    out = annotations.select("paper_id").join(errors, "paper_id", "left").join(unknown, "paper_id", "left").join(counts, "paper_id", "left").join(sets, "paper_id", "left").join(prepared.select("paper_id", "fulltext_sha256"), "paper_id", "left")
    out = out.fillna(0, ["n_quotes", *[f"n_{s}" for s in statuses]]).withColumns({c: F.coalesce(c, none) for c in ("schema_errors", "unknown_codes", "verified_moves", "unsupported_moves", "verified_fields", "unsupported_fields")})
    rate = hit_rate(F.col("n_exact") + F.col("n_loc_mismatch") + F.col("n_fuzzy"), F.col("n_quotes"))
    out = out.withColumn("hit_rate", rate).withColumn("has_text", F.col("fulltext_sha256").isNotNull())
    return out.withColumn("passed", gate(F.size("schema_errors"), F.size("unknown_codes"), F.col("n_quotes"), F.col("hit_rate"), min_hit_rate))


def gate(n_errors: Column, n_unknown: Column, n_quotes: Column, rate: Column, min_hit_rate: float = MIN_HIT_RATE) -> Column:
    return (n_errors == 0) & (n_unknown == 0) & (n_quotes > 0) & (rate >= min_hit_rate)


def stamps(verified: DataFrame, codebook_version: str, checked_at: str, accept_fuzzy: bool = False, min_hit_rate: float = MIN_HIT_RATE) -> DataFrame:
    """The provenance record of each verification, as a table keyed by paper; input files stay as they are."""
    counts = F.map_filter(F.create_map(*[x for s in ("exact", "loc_mismatch", "fuzzy", "miss", "too_short", "too_long") for x in (F.lit(s), F.col(f"n_{s}"))]), lambda _, n: n > 0)
    return verified.select("paper_id", F.lit(checked_at).alias("checked_at"), F.lit(codebook_version).alias("codebook_version"), "fulltext_sha256", F.lit(accept_fuzzy).alias("accept_fuzzy"), F.lit(min_hit_rate).alias("min_hit_rate"), F.bround("hit_rate", 4).alias("hit_rate"), counts.alias("counts"), "passed", "verified_moves", "verified_fields", "unsupported_moves", "unsupported_fields")


def verdicts(verified: DataFrame) -> DataFrame:
    """What the validate command tells of each annotation: NO-TEXT, PASS or FAIL."""
    return verified.select("paper_id", F.when(~F.col("has_text"), "NO-TEXT").when(F.col("passed"), "PASS").otherwise("FAIL").alias("verdict"), "n_quotes", "hit_rate", F.size("schema_errors").alias("n_schema_errors"), F.size("unknown_codes").alias("n_unknown_codes"))
