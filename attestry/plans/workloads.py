"""The operators bound to the driver's tables: one query for each operator or family, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestry import schemas
from attestry.functions import text as tx
from attestry.functions.fuzzy import fuzzy_ratio
from attestry.functions.replies import reply_json
from attestry.operators import agreement, annotations, blind, comments, evidence, holdout, integrity, mining, registry, rules
from attestry.operators.stages import settled
from attestry.sources import bibliography, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Year ends and labels for the order dates.
PERIOD_ENDS = ((1996, "1"), (1998, "2"), (2000, "3"))
LAST_PERIOD = "4"
FAMILIES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
#: (rule, tradition or None for a shared rule, requires). The data are random, so lifts lie near 1.
RULES = (
    ("SH-1", None, ("ECONOMY-*",)), ("SH-2", None, ("PROMO-0", "LARGE-0", "SMALL-0")), ("SH-3", None, ("field:returned", "STANDARD-*|MEDIUM-*")),
    ("AU-1", "AUTOMOBILE", ("ECONOMY-0|ECONOMY-1", "PROMO-*")), ("AU-2", "AUTOMOBILE", ("field:urgent",)), ("AU-3", "AUTOMOBILE", ("STANDARD-2",)),
    ("BU-1", "BUILDING", ("LARGE-1", "field:returned")), ("BU-2", "BUILDING", ("MEDIUM-*|SMALL-*", "LARGE-3|LARGE-4")), ("FU-1", "FURNITURE", ("SMALL-2|SMALL-3|SMALL-4",)),
    ("FU-2", "FURNITURE", ("PROMO-9",)), ("HO-1", "HOUSEHOLD", ("ECONOMY-*", "LARGE-*", "field:urgent")), ("MA-1", "MACHINERY", ("STANDARD-0", "STANDARD-1")), ("MA-2", "MACHINERY", ()),
)
ADMISSION = rules.Admission(min_papers=3, min_periods=2, min_lift=1.02)
RATIO, SEED = 0.2, 2026


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long_count(c: Column) -> Column:
    return c.cast("long")


def rule_list() -> list[rules.Rule]:
    return [rules.Rule(i, "SH" if k is None else k[:2], "shared" if k is None else "archetype", r, keys=() if k is None else (k,)) for i, k, r in RULES]


def period(date: Column) -> Column:
    return schemas.period_of(F.year(date).cast("string"), tuple(end for end, _ in PERIOD_ENDS), (*[label for _, label in PERIOD_ENDS], LAST_PERIOD))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as papers: paper_id, scholar_key, period, seed_source, split (empty), urgent."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("paper_id"), F.col("c_mktsegment").alias("scholar_key"), period(F.col("o_orderdate")).alias("period"), F.when(F.col("o_orderkey") % 97 == 0, "1").otherwise("0").alias("seed_source"), F.lit("").alias("split"), F.col("o_orderpriority").startswith("1").alias("urgent"))


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paper_id, codes, returned): the codes of an order's lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("-", "p_type", F.expr("cast((p_size - 1) div 10 as string)")).alias("code"))
    # an order's lines meet before they are grouped: sets of one line each would travel otherwise
    coded = lines.join(parts, lines.l_partkey == parts.p_partkey).repartition("l_orderkey")
    return coded.groupBy(F.col("l_orderkey").alias("paper_id")).agg(F.array_sort(F.collect_set("code")).alias("codes"), F.max(F.col("l_returnflag") == "R").alias("returned"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis records: orders with lines, split by hash within their segment."""
    split = registry.assign_split(orders(spark, sf_dir), RATIO, SEED)
    facts = F.array(F.when(F.col("returned"), "returned"), F.when(F.col("urgent"), "urgent"))
    return split.join(baskets(spark, sf_dir), "paper_id").select("paper_id", "scholar_key", "period", "split", "codes", F.filter(facts, lambda x: x.isNotNull()).alias("fields"))


def code_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("family"), F.concat_ws("-", "p_type", F.expr("cast((p_size - 1) div 10 as string)")).alias("code")).distinct()


# Rules.


def support_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.support(records(spark, sf_dir), rule_list(), ADMISSION)


@query
def rule_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = support_table(spark, sf_dir).where("layer <> 'shared'")
    return s.select("rule_id", "lens", "n_support", "n_annotated", "n_other_support", "n_other", "n_periods", F.array_join("periods", ",").alias("periods"), F.round("lift", 6).alias("lift"), "passed", "suggestion", F.array_join("reasons", ",").alias("reasons"))


@query
def rule_support_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = support_table(spark, sf_dir).where("layer = 'shared'")
    return s.select("rule_id", "n_support", "n_annotated", "n_periods", F.round("share", 6).alias("share"), "passed", "suggestion", F.array_join("reasons", ",").alias("reasons"))


@query
def candidate_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = [rules.Rule(r.rule_id, r.lens, r.layer, r.requires, keys=r.keys, candidate_sources=tuple(range(1, 400))) for r in rule_list()]
    known = records(spark, sf_dir).withColumn("paper_id", F.col("paper_id").cast("string"))
    found = rules.candidate_hits(known, [rules.Rule(r.rule_id, r.lens, r.layer, r.requires, keys=r.keys, candidate_sources=tuple(str(x) for x in r.candidate_sources)) for r in named])
    return found.select("rule_id", "candidate_annotated", "candidate_hits")


@query
def code_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.code_matrix(records(spark, sf_dir), list(SEGMENTS))


@query
def mine_combos(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mining.mine(settled(records(spark, sf_dir)), rules.Admission(min_lift=1.5))
    return found.select("scholar_key", F.array_join("combo", " + ").alias("combo"), "size", "n", "n_inside", "n_out", "n_outside", F.round("lift", 6).alias("lift"), long_count(F.col("place")).alias("place"))


@query
def rule_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = records(spark, sf_dir).select("scholar_key", F.explode(mining.combinations(F.col("codes"))).alias("combo")).distinct()
    return rules.covering_rules(pairs, rule_list()).select("scholar_key", F.array_join("combo", " + ").alias("combo"), F.array_join("covered", ",").alias("covered"))


# Registry.


@query
def select_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = orders(spark, sf_dir).withColumn("split", F.lit("train"))
    return registry.select_rows(papers, "1, 2,3,4,5,6,7,8,9,10,11,12", None, "train").select("paper_id", "scholar_key", "period")


@query
def period_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).groupBy("scholar_key", "period").agg(F.count(F.lit(1)).alias("n"))


@query
def corpus_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    papers = d.select(F.col("doc_id").alias("paper_id"), F.col("source").alias("scholar_key"), F.concat(F.lit("p"), (F.col("doc_id") % 4).cast("string")).alias("period"), F.when(F.col("doc_id") % 3 == 0, "verified").when(F.col("doc_id") % 3 == 1, "partial").otherwise("").alias("verify_status"), F.when(F.col("doc_id") % 5 == 0, "heldout").when(F.col("doc_id") % 5 == 1, "").otherwise("train").alias("split"))
    texts = d.where(F.length("text") >= 1000).select(F.col("doc_id").alias("paper_id"))
    s = registry.status_table(papers, texts, labels.select(F.col("doc_id").alias("paper_id")))
    return s.select("scholar_key", "n", "verified", "partly", "with_text", "annotated", "train", "heldout", "unsplit", "periods")


@query
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    key, year = F.substring("c_mktsegment", 1, 2), F.year("o_orderdate").cast("string")
    papers = o.select(F.when(F.col("o_orderkey") <= 40, F.concat_ws("-", key, year, F.lpad(F.col("o_orderkey").cast("string"), 2, "0"))).otherwise("").alias("paper_id"), key.alias("scholar_key"), year.alias("year"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("title"))
    return registry.assign_ids(papers)


@query
def hash_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", registry.hash_rank(SEED, F.col("doc_id")).alias("rank"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def document_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), F.col("source").alias("scholar_key"), F.when(F.col("doc_id") % 31 == 0, "1").otherwise("0").alias("seed_source"), F.lit("").alias("split"))


@query
def sticky_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.assign_split(document_papers(spark, sf_dir), RATIO, SEED).select("paper_id", "scholar_key", "split")


@query
def split_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The even ids are split first; then all, with what was given staying."""
    papers = document_papers(spark, sf_dir)
    first = registry.assign_split(papers.where("paper_id % 2 = 0"), RATIO, SEED)
    return registry.assign_split(first.unionByName(papers.where("paper_id % 2 <> 0")), 0.3, SEED).select("paper_id", "scholar_key", "split")


@query
def dedupe_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", tx.ascii_fold(F.coalesce("text", F.lit(""))).alias("key"))
    return registry.first_by_key(d.withColumn("key", F.sha2(F.col("key").cast("binary"), 256)), "key", ["doc_id"]).select("doc_id", "key")


@query
def acquire_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    num = lambda e: F.expr(e).cast("string")
    papers = d.select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("paper_id"), F.col("source").alias("scholar_key"), F.col("lang").alias("paper_type"), num("n_chars % 5").alias("period"), F.when(F.col("doc_id") % 17 == 0, "heldout").otherwise("train").alias("split"), F.when(F.col("doc_id") % 13 == 0, "1").otherwise("0").alias("seed_source"), F.when(F.col("doc_id") % 3 == 0, "verified").otherwise("").alias("verify_status"), F.when(F.col("doc_id") % 7 == 0, "x").otherwise("").alias("oa_url"), F.when(F.col("doc_id") % 2 == 0, "first").otherwise("co").alias("author_role"), *[F.lit("").alias(c) for c in ("title", "journal", "year", "issue")])
    texts = papers.where(F.col("split") == "heldout").select("paper_id")
    return registry.acquisition_plan(papers, texts).select("scholar_key", long_count(F.col("rank")).alias("rank"), "paper_id", "split", "period", "why")


# Text.


@query
def fold_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full normal form, NFKC included: no SQL engine at hand has it."""
    n = tx.normalize(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(n.cast("binary"), 256).alias("folded_sha256"))


@query
def fold_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tx.ascii_fold(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(f.cast("binary"), 256).alias("folded_sha256"), F.length(f).cast("long").alias("n"))


@query
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as blocks, as the driver's texts have no blank lines; long texts of few lines count as hard-wrapped."""
    found = tx.paragraphs(F.col("text"), "\n", ends=(".",))
    pars = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(found).alias("i", "p"))
    return pars.select("doc_id", (F.col("i") + 1).cast("long").alias("p_no"), F.length("p").cast("long").alias("n_chars"), F.md5(F.col("p").cast("binary")).alias("p_md5"))


@query
def numbered_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.numbered(tx.blocks(F.col("text"), "\n")).cast("binary")).alias("numbered_md5"))


@query
def hard_wrapped_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines run on until one ends in a full stop."""
    pars = tx.hard_wrapped(F.col("text"), (".",))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(pars).cast("long").alias("n"), F.md5(F.array_join(pars, "\n").cast("binary")).alias("pars_md5"))


@query
def cjk_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(tx.cjk_heavy(F.col("text"))).alias("heavy"), F.count(F.lit(1)).alias("n"))


@query
def locator_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    loc = F.concat(F.lit("P"), (F.col("doc_id") % 50 + 1).cast("string"), F.lit("-P"), (F.col("n_chars") % 90 + 1).cast("string"))
    return d.select("doc_id", loc.alias("loc"), F.array_join(tx.located(loc), ",").alias("located"))


def with_marks(text: Column) -> Column:
    """A paper's front page: a text between the marks of its abstract and its keywords."""
    return F.concat(F.lit("题目\n内容摘 要："), text, F.lit("\n关键词：河流；山路"))


@query
def abstract_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.abstract(with_marks(F.substring("text", 1, 400))).alias("abstract"))


@query
def stored_abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored abstract for each third document, the text's own for the others, none without a text."""
    d = table(spark, sf_dir, "documents")
    papers = d.select(F.col("doc_id").alias("paper_id"))
    stored = d.where("doc_id % 3 = 0").select(F.col("doc_id").alias("stem"), F.concat(F.lit("  stored "), F.col("doc_id").cast("string"), F.lit("\n")).alias("text"))
    full = d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("paper_id"), with_marks(F.substring("text", 1, 60)).alias("text"))
    return tables.abstracts(papers, stored, full).select("paper_id", "abstract")


@query
def full_text_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers with a file of their name in one or two forms, or with a named file, which may be missing."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("stem"), F.substring("text", 1, 200).alias("text"))
    named = F.when(F.col("doc_id") % 5 == 0, F.concat("stem", F.when(F.col("doc_id") % 2 == 0, ".md").otherwise(".gone"))).otherwise("")
    papers = d.select(F.col("stem").alias("paper_id"), named.alias("fulltext"))
    ext = F.explode(F.when(F.col("doc_id") % 4 == 0, F.array(F.lit(".md"))).when(F.col("doc_id") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit(".md"), F.lit(".txt")))).alias("ext")
    texts = d.select("stem", "text", ext).select("stem", "ext", F.concat(F.lit("file:/t/"), "stem", "ext").alias("path"), F.concat("ext", F.lit(" "), "text").alias("text"))
    return tables.full_texts(papers, texts).select("paper_id", "path", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query
def half_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.first_half(F.col("text")).cast("binary")).alias("half_md5"))


@query
def template_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = tx.without_leading_comment(F.lit("<!-- v1 -->\nItem {{ID}}: {{TEXT}} ({{ID}})"))
    return table(spark, sf_dir, "benchmark").select("item_id", tx.filled(template, {"ID": F.col("item_id").cast("string"), "TEXT": F.col("text")}).alias("prompt"))


@query
def comment_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(tx.without_comments(F.col("html")).cast("binary")).alias("bare_md5"))


# Evidence.


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of each document as quotes of itself, some with a wrong place, some altered, too short or too long."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    k = F.explode(F.array(*[F.lit(i) for i in range(6)])).alias("k")
    rows = d.select("doc_id", "text", k)
    line = F.get(tx.blocks(F.col("text"), "\n"), F.lit(0))
    quote = F.when(F.col("k") == 0, F.substring(line, 1, 60)).when(F.col("k") == 1, F.substring("text", 20, 80)).when(F.col("k") == 2, F.concat(F.substring(line, 1, 30), F.lit("zzqx"))).when(F.col("k") == 3, F.substring("text", 1, 4)).when(F.col("k") == 4, F.substring("text", 1, 151)).otherwise(F.substring(line, 1, 40))
    loc = F.when(F.col("k") == 0, "P1").when(F.col("k") == 5, "P2-P3").when(F.col("k") == 1, "n/a").otherwise("P1")
    return rows.select(F.col("doc_id").alias("paper_id"), F.col("k").cast("long").alias("k"), F.coalesce(quote, F.lit("")).alias("quote"), loc.alias("loc"))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), "text")
    return evidence.prepared_texts(texts, tx.blocks(F.col("text"), "\n"), tx.ascii_fold)


@query
def quote_check_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.check_quotes(quotes(spark, sf_dir), prepared(spark, sf_dir), form=tx.ascii_fold).select("paper_id", "k", "status")


@query
def quote_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.substring("text", 1, 100).alias("quote"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), "text")
    return evidence.find_quotes(b, d, form=tx.ascii_fold)


@query
def hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = quote_check_keyed(spark, sf_dir).groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_quotes"), F.count_if(F.col("status").isin("exact", "loc_mismatch", "fuzzy")).alias("ok"))
    return checked.select("paper_id", "n_quotes", F.round(evidence.hit_rate(F.col("ok"), F.col("n_quotes")), 6).alias("hit_rate"))


@query
def evidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = F.when(F.col("paper_id") % 11 == 0, 1).otherwise(0)
    return hit_rate(spark, sf_dir).select("paper_id", evidence.gate(errors, F.lit(0), F.col("n_quotes"), F.col("hit_rate"), 0.5).alias("passed"))


@query
def fuzzy_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", tx.ascii_fold(F.coalesce("text", F.lit(""))).alias("t"))
    q = F.concat(F.substring("t", 11, 20), F.lit("zz"), F.substring("t", 33, 20))
    return d.select("doc_id", F.round(fuzzy_ratio(q, F.col("t")), 6).alias("ratio"))


LABEL_CODES = ("Q-0", "Q-1", "T-0", "T-1")


def label_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label as annotations in two folders: the first is verified if its quality is 1, the second always; and one of a paper that no registry has."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", F.explode(F.array(F.lit(0), F.lit(1))).alias("dir_ord"))
    labels = labels.unionByName(labels.where("dir_ord = 0").withColumn("doc_id", -F.col("doc_id") - 1))
    codes = F.array(F.concat(F.lit("Q-"), F.col("quality").cast("string")), F.concat(F.lit("T-"), F.col("toxic").cast("string")))
    passed = (F.col("dir_ord") == 1) | (F.col("quality") == 1)
    none = F.array().cast("array<string>")
    v = F.to_json(F.struct(passed.alias("passed"), F.when(F.col("dir_ord") == 0, codes).otherwise(F.slice(codes, 2, 1)).alias("verified_moves"), F.when(F.col("toxic") == 1, F.array(F.lit("puzzle"))).otherwise(none).alias("verified_fields")))
    meta = F.from_json(F.concat(F.lit('{"verification": '), v, F.lit("}")), schemas.META)
    nothing = F.from_json(F.lit("{}"), schemas.ANNOTATION)
    return labels.select(F.col("doc_id").alias("paper_id"), nothing["moves"].alias("moves"), nothing["fields"].alias("fields"), meta.alias("meta"), "dir_ord", F.concat(F.col("doc_id").cast("string"), F.lit(".json")).alias("file"))


def loaded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), F.col("source").alias("scholar_key"), F.col("lang").alias("period"), F.when(F.col("doc_id") % 2 == 0, "train").alias("split"))
    return annotations.load_records(label_annotations(spark, sf_dir), d)


@query
def load_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a document's annotations in two folders the first accepted one wins."""
    return loaded(spark, sf_dir)[0].select("paper_id", "scholar_key", "period", "split", F.array_join("codes", ",").alias("codes"), F.array_join("fields", ",").alias("fields"))


@query
def record_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded(spark, sf_dir)[1].select("paper_id", "file", "reason")


def made_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations of documents as they are read from JSON files, with one fault or none, by doc_id % 8."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 8).alias("k"))
    quote = lambda q, loc="n/a": F.struct(q.alias("quote"), F.lit(loc).alias("loc"))
    own, foreign = F.substring(F.coalesce("text", F.lit("")), 1, 60), F.concat(F.lit("zzqx"), F.col("doc_id").cast("string"), F.lit("zzqx"))
    absent = F.lit('{"status": "absent"}')
    fields = [F.concat(F.lit(f'"{n}": '), absent) for n in schemas.FIELDS if n not in ("puzzle", "actors")]
    puzzle = F.when(F.col("k") == 3, F.lit('"x": {"status": "absent"}')).when(F.col("k") == 4, F.lit('"puzzle": {"status": "present", "value": "v"}')).otherwise(F.lit('"puzzle": {"status": "unclear", "value": ["a"]}'))
    actors = F.concat(F.lit('"actors": '), F.to_json(F.struct(F.lit("present").alias("status"), F.lit("v").alias("value"), F.array(quote(own)).alias("evidence"))))
    code = F.when(F.col("k") == 6, F.lit("low-case")).otherwise(F.lit("Q-1"))
    second = F.when(F.col("k") == 5, F.lit("q")).otherwise(foreign)
    moves = F.to_json(F.array(F.struct(code.alias("code"), F.array(quote(own)).alias("evidence")), F.struct(F.lit("T-0").alias("code"), F.array(quote(second)).alias("evidence"))))
    version, kind = F.when(F.col("k") == 1, "1.3.0").otherwise("0.3.0"), F.when(F.col("k") == 2, "essay").otherwise("mixed")
    text = F.concat(F.lit('{"paper_id": "'), F.col("doc_id").cast("string"), F.lit('", "codebook_version": "'), version, F.lit('", "paper_type": "'), kind, F.lit('"'), F.when(F.col("k") == 7, ', "colour": 1').otherwise(""), F.lit(', "fields": {'), F.concat_ws(", ", *fields, puzzle, actors), F.lit('}, "moves": '), moves, F.lit("}"))
    return d.select(F.from_json(text, schemas.ANNOTATION).alias("a"), tables.unknown_properties(text).alias("unknown")).select("a.*", "unknown")


@query
def schema_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations.schema_errors(made_annotations(spark, sf_dir)).select("paper_id", F.array_join("schema_errors", "; ").alias("schema_errors"))


def verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = made_annotations(spark, sf_dir)
    texts = evidence.prepared_texts(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), F.coalesce("text", F.lit("")).alias("text")))
    codes = spark.createDataFrame([(c,) for c in LABEL_CODES], "code string")
    return evidence.verify(found, texts, codes, annotations.schema_errors(found), min_hit_rate=0.5)


@query
def verify_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of annotations whose first quotes are slices of their texts and whose last one is not."""
    v = evidence.verdicts(verified(spark, sf_dir))
    return v.select("paper_id", "verdict", long_count(F.col("n_quotes")).alias("n_quotes"), F.round("hit_rate", 6).alias("hit_rate"), long_count(F.col("n_schema_errors")).alias("n_schema_errors"), long_count(F.col("n_unknown_codes")).alias("n_unknown_codes"))


@query
def verification_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evidence.stamps(verified(spark, sf_dir), "0.3.0", "2026-01-01T00:00:00", False, 0.5)
    return s.select("paper_id", "passed", "fulltext_sha256", F.array_join("verified_moves", ",").alias("verified_moves"), F.array_join("unsupported_moves", ",").alias("unsupported_moves"), F.array_join("verified_fields", ",").alias("verified_fields"), *[long_count(F.coalesce(F.col("counts")[c], F.lit(0))).alias(c) for c in ("exact", "miss")])


@query
def prompt_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts over numbered lines; texts above 4,000 characters are too long, each ninth document has none, and each fourth was done with the same text."""
    d = table(spark, sf_dir, "documents")
    papers = d.select(F.col("doc_id").alias("paper_id"), F.concat(F.lit("Title "), F.col("doc_id").cast("string")).alias("title"))
    texts = d.where("doc_id % 9 <> 0").select(F.col("doc_id").alias("paper_id"), "text")
    made = annotations.prompts(papers, texts, "{{TITLE}}\n{{TEXT}}", "0.3.0", {"TITLE": F.col("title")}, tx.numbered(tx.blocks(F.col("text"), "\n")), max_chars=4000)
    done = made.where("paper_id % 4 = 0").select("paper_id", "prompt_sha256", "text_sha256")
    left = annotations.pending(made.where("status = 'ready'"), done).select("paper_id", F.lit(True).alias("pending"))
    return made.join(left, "paper_id", "left").select("paper_id", "status", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"), "prompt_sha256", F.coalesce("pending", F.lit(False)).alias("pending"))


# Agreement.


@query
def kappa_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = agreement.cohen_kappa(table(spark, sf_dir, "labels").select("quality", "toxic"), "quality", "toxic")
    return k.select("n", F.round("p_observed", 6).alias("p_observed"), F.round("kappa", 6).alias("kappa"))


@query
def kappa_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return agreement.cohen_kappa(rows, "quality", "toxic", ["source"]).select("source", "n", F.round("p_observed", 6).alias("p_observed"), F.round("kappa", 6).alias("kappa"))


@query
def kappa_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two annotators of an order: the codes of its first lines, and of all but its first line."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("-", "p_type", F.expr("cast((p_size - 1) div 10 as string)")).alias("code")), F.col("l_partkey") == F.col("p_partkey"))
    sets = lines.groupBy(F.col("l_orderkey").alias("paper_id")).agg(F.collect_set(F.when(F.col("l_linenumber") <= 2, F.col("code"))).alias("x"), F.collect_set(F.when(F.col("l_linenumber") >= 2, F.col("code"))).alias("y"))
    k = agreement.family_kappa(sets.select("paper_id", F.col("x").alias("codes")), sets.select("paper_id", F.col("y").alias("codes")), code_dimension(spark, sf_dir))
    return k.select("family", "n", F.round("p_observed", 6).alias("p_observed"), F.round("kappa", 6).alias("kappa"), "flagged")


def event_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ratings: item (hour of the month), system (event type), rater, value 1 to 5, fabrications, advisor."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    score = (F.floor("value") % 5 + 1).cast("double")
    return e.select("event_id", F.date_format("ts", "dd").alias("item_id"), F.col("event_type").alias("system"), (F.col("user_id") % 3).cast("string").alias("rater"), score.alias("value"), F.when(F.col("value") > 60, 1).otherwise(0).cast("long").alias("n"))


@query
def kripp_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = agreement.krippendorff_alpha(event_ratings(spark, sf_dir).withColumn("unit", F.expr("event_id div 4")), ["unit"], "value", "interval", ["rater"])
    return a.select("rater", "n_units", "n_values", F.round("alpha", 6).alias("alpha"))


@query
def kripp_nominal(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = agreement.krippendorff_alpha(event_ratings(spark, sf_dir).withColumn("unit", F.expr("event_id div 4")), ["unit"], "system", "nominal", ["rater"])
    return a.select("rater", "n_units", "n_values", F.round("alpha", 6).alias("alpha"))


#: Resamples, as the operators and the command line have them.
BOOT = 5000


@query
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = event_ratings(spark, sf_dir).groupBy("item_id").agg(F.avg("value").alias("m"))
    return agreement.bootstrap(means, "m", ["item_id"], n_boot=BOOT).select("n", F.round("mean", 6).alias("mean"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query
def set_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = baskets(spark, sf_dir)
    gold = F.array(F.lit("ECONOMY-0"), F.lit("LARGE-1"), F.lit("PROMO-2"))
    return sets.select("paper_id", F.round(agreement.set_f1(gold, F.col("codes")), 6).alias("f1"))


# Held-out prediction.


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holdout.gold_sets(settled(records(spark, sf_dir).select("paper_id", "split", "codes")), code_dimension(spark, sf_dir), FAMILIES)


@query
def gold_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold(spark, sf_dir).select("paper_id", "split", "family", F.array_join("gold", ",").alias("gold"))


@query
def majority_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gold(spark, sf_dir)
    return holdout.majority(g).join(holdout.set_sizes(g), "family").select("family", long_count(F.col("k")).alias("k"), F.array_join("pred", ",").alias("pred"))


def predictor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Majority, and the codes of a fixed guess, for each held-out order."""
    g = gold(spark, sf_dir)
    held = g.where("split = 'heldout'").select("paper_id", "family")
    best = held.join(F.broadcast(holdout.majority(g)), "family").withColumn("system", F.lit("majority"))  # a row for each family
    fixed = held.withColumn("pred", F.array(F.concat(F.col("family"), F.lit("-1")))).withColumn("system", F.lit("fixed"))
    return holdout.scores(best.unionByName(fixed), g)


@query
def holdout_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictor_scores(spark, sf_dir).select("paper_id", "system", F.round("score", 6).alias("score"))


@query
def holdout_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holdout.summary(predictor_scores(spark, sf_dir))


@query
def holdout_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contrast of two predictors with each held-out paper as a unit."""
    c = holdout.contrasts(settled(predictor_scores(spark, sf_dir)), (("majority", "fixed"),), BOOT)
    return c.select("contrast", "n", F.round("mean", 3).alias("mean"), F.round("lo", 3).alias("lo"), F.round("hi", 3).alias("hi"))


@query
def model_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a model, some without JSON, with unknown codes and more than three, for orders."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    given = F.concat(F.lit('{"ECONOMY": ["ECONOMY-0", "none", "ECONOMY-'), (k % 6).cast("string"), F.lit('", "PROMO-1", "ECONOMY-2", "ECONOMY-3"], "PROMO": '), F.when(k % 3 == 0, "null").otherwise('["PROMO-1"]'), F.lit("}"))
    reply = F.when(k % 5 == 0, "I can't tell").otherwise(F.concat(F.lit("<think>{</think>```json\n"), given, F.lit("\n```")))
    replies = o.select(k.alias("paper_id"), F.lit("rules").alias("system"), reply.alias("reply"))
    return holdout.parsed_predictions(replies, code_dimension(spark, sf_dir), FAMILIES).select("paper_id", "system", "family", F.array_join("pred", ",").alias("pred"))


@query
def holdout_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    evidence_ = F.when(F.col("doc_id") % 3 == 0, '["cases", "records"]').when(F.col("doc_id") % 3 == 1, "a survey")
    held = d.select(F.col("doc_id").alias("paper_id"), F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("title"), F.substring("text", 1, 101).alias("abstract"), evidence_.alias("evidence"))
    made = holdout.prompts(held, "{{RULES}}|{{CODEBOOK}}|{{TITLE}}|{{ABSTRACT_HALF}}|{{EVIDENCE}}", "book", {"baseline": "", "rules": "R1"})
    return made.select("paper_id", "system", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


@query
def code_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = holdout.code_frequencies(gold(spark, sf_dir))
    return f.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("family")), 6)).select("family", "code", "n", "share")


@query
def random_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holdout.random_scores(gold(spark, sf_dir)).select("paper_id", F.round("score", 6).alias("score"))


# Blind rating and comments.


@query
def blind_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    systems = F.map_from_entries(F.array(*[F.struct(F.lit(s), F.lit("x")) for s in ("click", "error", "purchase", "signup", "view")]))
    items = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("item_id")).distinct().withColumn("outputs", systems)
    return blind.blind_key(items)


def score_sheets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Filled sheets of three raters over conversations' items, with blanks, and their key."""
    key = blind_key(spark, sf_dir)
    rated = key.withColumn("rater", F.explode(F.array(*[F.lit(f"R{i}") for i in (1, 2, 3)])))
    word = lambda d: F.conv(F.substring(F.md5(F.concat_ws(":", "item_id", "system", "rater", F.lit(d))), 1, 4), 16, 10).cast("long")
    cells = [F.when(word(d) % 7 == 0, " ").otherwise((word(d) % 5 + 1).cast("string")).alias(d) for d in blind.DIMENSIONS]
    return rated.select("item_id", "label", "rater", *cells, F.when(word("f") % 9 == 0, "").otherwise((word("f") % 3).cast("string")).alias("fabrications")), key


@query
def sheet_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratings, _ = blind.load_ratings(*score_sheets(spark, sf_dir))
    return ratings.groupBy("system", "dim", "rater").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query
def sheet_fabrications(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, fab = blind.load_ratings(*score_sheets(spark, sf_dir))
    return fab.groupBy("system", "rater").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("n").alias("total"))


@query
def blind_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two raters get of the conversations' first turns by two systems."""
    first = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("draft"))
    outputs = F.map_from_entries(F.array(*[F.struct(F.lit(s), F.concat(F.lit(f"{s}:"), F.substring("draft", 1, 20))) for s in ("one", "two")]))
    items = first.select(F.col("conv_id").cast("string").alias("item_id"), F.coalesce("draft", F.lit("")).alias("draft")).withColumn("outputs", outputs)
    p = blind.packets(items, blind.blind_key(items), 2)
    return p.select("rater", F.substring("place", 1, 12).alias("place"), "item_id", "label", F.md5(F.col("output").cast("binary")).alias("output_md5"))


@query
def blind_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = blind.system_means(event_ratings(spark, sf_dir).withColumn("dim", F.concat(F.lit("D"), (F.col("event_id") % 8 + 1).cast("string"))))
    return m.select("system", "dim", F.round("mean", 6).alias("mean"))


@query
def blind_vs_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = blind.versus_baseline(event_ratings(spark, sf_dir).withColumn("dim", F.concat(F.lit("D"), (F.col("event_id") % 2 + 6).cast("string"))), "view", n_boot=BOOT)
    return v.select("system", "dim", "n", F.round("mean", 6).alias("mean"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "noninferior")


@query
def fabrication_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = event_ratings(spark, sf_dir)
    rates = blind.fabrication_rates(f).select("system", F.round("rate", 6).alias("rate"), "n")
    gate = blind.fabrication_versus_baseline(f, "view", n_boot=BOOT).select("system", F.round("mean", 6).alias("diff"), "noninferior")
    return rates.join(gate, "system", "left")


@query
def alpha_by_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = blind.alpha_by_dimension(event_ratings(spark, sf_dir).withColumn("dim", F.concat(F.lit("D"), (F.col("event_id") % 8 + 1).cast("string"))))
    return a.select("dim", "n_units", "n_values", F.round("alpha", 6).alias("alpha"))


@query
def comment_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "props")
    general = F.get_json_object("props", "$.k").cast("int") % 2 == 0
    rows = e.select((F.col("user_id") % 7).cast("string").alias("advisor"), F.date_format("ts", "yyyy-MM-dd").alias("draft_id"), F.array("event_type").alias("defect_codes"), F.array(F.concat(F.lit("M-"), "event_type")).alias("move_codes"), general.alias("generalizable"))
    return comments.aggregate(rows).select("advisor", "code", "n", "n_drafts", F.round("share", 6).alias("share"), "candidate")


# Sources and housekeeping.


def export_files(spark: SparkSession, sf_dir: str, opens: str, tag: Callable[[str], str], end: str) -> DataFrame:
    """Each conversation as an export file: a user's turn opens a record, the others are its authors."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    t = F.col("turn").cast("string")
    line = lambda name, value: F.concat(F.lit(tag(name)), value)
    lines = F.when(F.col("role") == "user", F.concat_ws("\n", F.lit(end), F.lit(opens), line("title", F.concat(F.lit("Turn "), t)), line("issue", F.concat(F.lit("0"), t)), line("year", F.concat((F.col("conv_id") % 30 + 1995).cast("string"), F.lit("/07"))))).otherwise(line("author", F.concat("role", t)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", lines.alias("x")))), lambda x: x["x"]), "\n")
    return c.groupBy(F.col("conv_id").alias("file")).agg(text.alias("text"))  # the turns of one conversation


@query
def import_ris(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"title": "TI", "issue": "IS", "year": "PY", "author": "AU"}
    files = export_files(spark, sf_dir, "TY  - JOUR", lambda n: f"{names[n]}  - ", "ER  - ")
    return bibliography.paper_rows(bibliography.parse_ris(files), "ris", "A", "assistant1").select("file", "title", "authors", "issue", "year", "period", "author_role")


@query
def import_endnote(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"title": "T", "issue": "N", "year": "D", "author": "A"}
    files = export_files(spark, sf_dir, "%0 Journal Article", lambda n: f"%{names[n]} ", "")
    return bibliography.paper_rows(bibliography.parse_endnote(files), "enw", "A", "assistant1").select("file", "title", "authors", "issue", "year", "period", "author_role")


@query
def import_new_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of odd documents that neither the even ones nor an earlier odd one has; quotes, case and white space don't count."""
    d = table(spark, sf_dir, "documents")
    title = F.concat(F.when(F.col("doc_id") % 3 == 0, "The 'River' ").otherwise("the river"), F.substring(F.md5((F.col("doc_id") % 400).cast("string")), 1, 4))
    papers = d.select(F.col("doc_id").alias("paper_id"), title.alias("title"))
    fresh, _ = registry.import_rows(papers.where("paper_id % 2 = 0"), papers.where("paper_id % 2 <> 0"), ["paper_id"])
    return fresh.select("paper_id", "title")


@query
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.concat(F.lit("<think>a { b</think>Here it is:\n```json\n"), F.col("props"), F.lit("\n```\nDone }"))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(reply_json(reply), "$.k").cast("long").alias("k"))


@query
def ref_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label, and labels whose value changed, as a keyed difference."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), (F.col("doc_id") % 2).cast("int").alias("v"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.col("quality").alias("v"))
    return integrity.keyed_difference(d, labels, "key", "v")


@query
def mention_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links in pages' menus against the words that documents' languages and sources use as names."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), F.col("html").alias("text"))
    present = table(spark, sf_dir, "documents").select(F.lower(F.regexp_extract("text", r"^[A-Za-z]+", 0)).alias("name")).where("name <> ''").distinct()
    return integrity.mentions(pages, present, r'<a href="/([a-z]+)">')
