"""Annotations: the schema gate, what is left to annotate, prompts, and the records that analysis starts from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry import schemas
from attestry.functions.text import filled

# Forms and lengths that the annotation schema asks for.
VERSION_FORM = r"^0\.[23]\."
CODE_FORM = r"^[A-Z]+-[A-Z0-9-]+$"
QUOTE_CHARS = (4, 200)
LOC_CHARS = 2


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def schema_errors(annotations: DataFrame) -> DataFrame:
    """(paper_id, schema_errors): one strict rule set, compiled into column predicates; messages sorted. Column `unknown`, if there, names properties that may not be."""
    field = lambda n: F.col("fields")[n]
    bad = lambda e: blank(e["quote"]) | blank(e["loc"]) | ~F.length(e["quote"]).between(*QUOTE_CHARS) | (F.length(e["loc"]) < LOC_CHARS)
    told = f"needs a quote of {QUOTE_CHARS[0]} to {QUOTE_CHARS[1]} characters and a loc of {LOC_CHARS} or more"
    checks = [F.when(blank(F.col(c)), F.lit(f"{c}: missing")) for c in ("paper_id", "codebook_version", "paper_type")]
    checks += [F.when(F.col(c).isNull(), F.lit(f"{c}: missing")) for c in ("fields", "moves")]
    checks += [F.when(~blank(F.col("codebook_version")) & ~F.col("codebook_version").rlike(VERSION_FORM), F.lit("codebook_version: form"))]
    checks += [F.when(~blank(F.col("paper_type")) & ~F.col("paper_type").isin(*schemas.PAPER_TYPES), F.lit("paper_type: unknown value"))]
    for n in schemas.FIELDS:
        f = field(n)
        present = f["status"] == "present"
        items = F.from_json(F.when(f["value"].startswith("["), f["value"]), "array<string>")
        checks += [F.when((f["value"] == "") | (F.size(items) == 0) | F.exists(items, blank), F.lit(f"fields/{n}/value: empty"))]
        checks += [F.when(f.isNull(), F.lit(f"fields/{n}: missing"))]
        checks += [F.when(f.isNotNull() & (f["status"].isNull() | ~f["status"].isin(*schemas.FIELD_STATUSES)), F.lit(f"fields/{n}/status: unknown value"))]
        checks += [F.when(present & (blank(f["value"]) | f["value"].isin("[]", "null") | (F.coalesce(F.size(f["evidence"]), F.lit(0)) <= 0)), F.lit(f"fields/{n}: present without value and evidence"))]
        checks += [F.when(F.exists(F.coalesce(f["evidence"], F.array().cast(schemas.EVIDENCE)), bad), F.lit(f"fields/{n}/evidence: {told}"))]
    extra = F.array_sort(F.array_except(F.map_keys(F.coalesce("fields", F.create_map().cast("map<string,struct<status:string,value:string,evidence:array<struct<quote:string,loc:string>>>>"))), F.array(*[F.lit(n) for n in schemas.FIELDS])))
    checks += [F.when(F.size(extra) > 0, F.concat(F.lit("fields: unexpected "), F.array_join(extra, ", ")))]
    moves = F.transform(F.coalesce("moves", F.array().cast("array<struct<code:string,evidence:array<struct<quote:string,loc:string>>,note:string>>")), lambda m, i: F.when(m.isNull() | blank(m["code"]) | ~F.coalesce(m["code"].rlike(CODE_FORM), F.lit(False)) | (F.coalesce(F.size(m["evidence"]), F.lit(0)) <= 0), F.concat(F.lit("moves/"), i.cast("string"), F.lit(": needs a code and evidence"))).when(F.exists(m["evidence"], bad), F.concat(F.lit("moves/"), i.cast("string"), F.lit(f"/evidence: {told}"))))
    if "unknown" in annotations.columns:
        checks += [F.when(F.size("unknown") > 0, F.concat(F.lit("unknown properties: "), F.array_join("unknown", ", ")))]
    return annotations.select("paper_id", F.array_sort(F.filter(F.concat(F.array(*checks), moves), lambda e: e.isNotNull())).alias("schema_errors"))


def rendered_codebook(families: DataFrame, moves: DataFrame, only: list[str] | None = None) -> DataFrame:
    """(ord, family, text): a section for each family with a line for each code."""
    line = F.concat(F.lit("- "), F.col("code"), F.lit(" "), F.coalesce(F.col("m.label"), F.lit("")), F.lit(": "), F.coalesce("definition", F.lit("")), F.when(~blank(F.col("include")), F.concat(F.lit(" Include: "), "include")).otherwise(""), F.when(~blank(F.col("exclude")), F.concat(F.lit(" Exclude: "), "exclude")).otherwise(""))
    rows = moves.alias("m").join(F.broadcast(families.alias("f")), "family")
    rows = rows.where(F.col("family").isin(only)) if only else rows
    return rows.groupBy("ord", "family", F.col("f.label").alias("label")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("code", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines")).select("ord", "family", F.concat(F.lit("## "), "family", F.lit(" "), F.coalesce("label", F.lit("")), F.lit("\n"), "lines").alias("text"))


def prompts(papers: DataFrame, texts: DataFrame, template: str, codebook_version: str, values: dict[str, Column], numbered: Column, max_chars: int = 60_000, truncate: bool = False) -> DataFrame:
    """(paper_id, status, prompt, prompt_sha256, text_sha256): ready, no_text or too_long; a long text is cut only if asked."""
    rows = papers.join(texts.select("paper_id", "text"), "paper_id", "left")
    size = F.length("text")
    used = F.when(size > max_chars, F.substring("text", 1, max_chars)).otherwise(F.col("text")) if truncate else F.col("text")
    rows = rows.withColumn("status", F.when(blank(F.col("text")), "no_text").when((size > max_chars) & F.lit(not truncate), "too_long").otherwise("ready")).withColumn("text", used)
    prompt = filled(F.lit(template), values | {"TEXT": numbered})
    return rows.select("paper_id", "status", F.when(F.col("status") == "ready", prompt).alias("prompt"), F.sha2(F.lit(f"{template}\n{codebook_version}").cast("binary"), 256).alias("prompt_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def pending(ready: DataFrame, done: DataFrame) -> DataFrame:
    """Prompts whose paper has no annotation of the same prompt and text."""
    return ready.join(done.select("paper_id", "prompt_sha256", "text_sha256"), ["paper_id", "prompt_sha256", "text_sha256"], "left_anti")


def load_records(annotations: DataFrame, papers: DataFrame, stamps: DataFrame | None = None, require_verified: bool = True) -> tuple[DataFrame, DataFrame]:
    """(records, problems). The first accepted annotation of a paper wins, by folder and file; the gate comes before.

    records: paper_id, scholar_key, period, split, codes, fields. problems: paper_id, file, reason.
    """
    none = F.array().cast("array<string>")
    stamp = annotations.select("*", F.col("meta.verification").alias("v")) if stamps is None else annotations.join(stamps.select("paper_id", F.struct(*[c for c in stamps.columns if c != "paper_id"]).alias("v")), "paper_id", "left")
    rows = stamp.join(papers.select("paper_id", "scholar_key", "period", "split", F.lit(1).alias("known")), "paper_id", "left")
    raw_codes = F.array_distinct(F.filter(F.transform(F.coalesce("moves", F.array().cast("array<struct<code:string,evidence:array<struct<quote:string,loc:string>>,note:string>>")), lambda m: m["code"]), lambda c: c.isNotNull()))
    raw_fields = F.map_keys(F.map_filter(F.coalesce("fields", F.create_map().cast("map<string,struct<status:string,value:string,evidence:array<struct<quote:string,loc:string>>>>")), lambda _, f: f["status"] == "present"))
    reason = F.when(F.col("known").isNull(), "not in the registry")
    if require_verified:
        reason = reason.when(F.col("v").isNull(), "not verified yet").when(~F.coalesce("v.passed", F.lit(False)), "verification failed")
    rows = rows.withColumn("reason", reason)
    rows = rows.withColumn("codes", F.when(F.col("v").isNull(), raw_codes).otherwise(F.coalesce("v.verified_moves", none))).withColumn("have", F.when(F.col("v").isNull(), raw_fields).otherwise(F.coalesce("v.verified_fields", none)))
    good = rows.where("reason is null")
    first = good.groupBy("paper_id").agg(F.min_by(F.struct("scholar_key", "period", "split", "codes", F.col("have").alias("fields"), "dir_ord", "file"), F.struct("dir_ord", "file")).alias("r"))
    records = first.select("paper_id", "r.scholar_key", "r.period", F.coalesce("r.split", F.lit("")).alias("split"), F.array_distinct("r.codes").alias("codes"), F.array_distinct("r.fields").alias("fields"))
    later = good.join(first.select("paper_id", F.col("r.dir_ord").alias("d"), F.col("r.file").alias("f")), "paper_id").where("not (dir_ord <=> d and file <=> f)").select("paper_id", "file", F.lit("another annotation came first").alias("reason"))
    return records, rows.where("reason is not null").select("paper_id", "file", "reason").unionByName(later)
