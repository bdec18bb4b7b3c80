"""RIS and EndNote exports: tagged lines become records by gaps and islands within each file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions.text import stripped
from attestry.schemas import period_of

#: For each format the tags of each field, in order of preference.
RIS = {"title": ("TI", "T1"), "authors": ("AU", "A1"), "journal": ("T2", "JO", "JF", "JA"), "year": ("PY", "Y1", "DA"), "issue": ("IS",), "first": ("SP",), "last": ("EP",), "abstract": ("AB", "N2")}
ENW = {"title": ("T",), "authors": ("A",), "journal": ("J", "B"), "year": ("D",), "issue": ("N",), "pages": ("P",), "abstract": ("X",)}
RIS_LINE = r"^([A-Z][A-Z0-9])  - ?(.*)$"
ENW_LINE = r"^%(\S)\s+(.*)$"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of export files."""
    from attestry.sources.tables import decoded

    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), decoded("content").alias("text"))


def tag_lists(files: DataFrame, line: str, opens: str, closes: str | None, blank_closes: bool, keep_unclosed: bool) -> DataFrame:
    """files(file, text) -> (file, rec, tags map<string, array<string>>), one row for each record in order of the file.

    The whole file is one row, so the fold stays within it: a record boundary raises a counter, tags collect under it.
    """
    lines = F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")
    rows = files.select("file", F.posexplode(lines).alias("pos", "raw")).withColumn("raw", F.rtrim("raw"))
    tagged = rows.select("file", "pos", F.regexp_extract("raw", line, 1).alias("tag"), F.trim(F.regexp_extract("raw", line, 2)).alias("value"), (F.trim("raw") == "").alias("blank")).where((F.col("tag") != "") | F.lit(blank_closes) & F.col("blank"))
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy("pos")
    begins = (F.col("tag") == opens).cast("int")
    after = F.lag(((F.col("tag") == closes) if closes else F.col("blank")).cast("int"), 1, 0).over(w)
    rec = F.sum(begins + after).over(w)
    real = tagged.withColumn("rec", rec).where((F.col("tag") != "") & (F.col("tag") != (closes or "")))
    if not keep_unclosed and closes:
        ended = tagged.withColumn("rec", rec).where(F.col("tag") == closes).select("file", "rec")
        last = tagged.withColumn("rec", rec).groupBy("file").agg(F.max("rec").alias("rec"))
        real = real.join(ended.unionByName(last).distinct(), ["file", "rec"], "left_semi")
    per_tag = real.groupBy("file", "rec", "tag").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("values"))
    return per_tag.groupBy("file", "rec").agg(F.map_from_entries(F.collect_list(F.struct("tag", "values"))).alias("tags"))


def parse_ris(files: DataFrame, keep_unclosed: bool = True) -> DataFrame:
    """Records from TY to ER. keep_unclosed: also those that the next TY cuts off (False loses them, as strict readers do)."""
    return tag_lists(files, RIS_LINE, "TY", "ER", False, keep_unclosed)


def parse_endnote(files: DataFrame) -> DataFrame:
    """Records that a blank line or a %0 line ends."""
    return tag_lists(files, ENW_LINE, "0", None, True, True)


def first_of(tags: tuple[str, ...]) -> Column:
    """The first value of the first tag that has any, even an empty one."""
    return F.coalesce(*[F.element_at(F.col("tags")[t], 1) for t in tags], F.lit(""))


def author_names(values: Column, whole: bool = False) -> Column:
    """Distinct names in order. whole: keep `Surname, Given` together (a comma splits otherwise)."""
    parts = F.flatten(F.transform(values, lambda v: F.split(v, "[;；]" if whole else "[;；,，]")))
    return F.array_distinct(F.filter(F.transform(parts, stripped), lambda x: x != ""))


def paper_rows(records: DataFrame, fmt: str, scholar: str, scholar_name: str = "", whole_names: bool = False) -> DataFrame:
    """records(file, rec, tags) of fmt "ris" or "enw" -> registry rows with rec as their order; records without a title are dropped."""
    use = RIS if fmt == "ris" else ENW
    none = F.array().cast("array<string>")
    names = author_names(F.concat(*[F.coalesce(F.col("tags")[t], none) for t in use["authors"]]), whole_names)
    issue = first_of(use["issue"])
    pages = F.concat(first_of(use["first"]), F.lit("-"), first_of(use["last"])) if fmt == "ris" else first_of(use["pages"])
    first_page = first_of(use["first"]) if fmt == "ris" else F.substring_index(first_of(use["pages"]), "-", 1)
    rows = records.select("file", "rec", first_of(use["title"]).alias("title"), names.alias("names"), first_of(use["journal"]).alias("journal"), F.substring(first_of(use["year"]), 1, 4).alias("year"), F.coalesce(F.nullif(F.ltrim(issue, F.lit("0")), F.lit("")), issue).alias("issue"), F.when(first_page != "", F.regexp_replace(pages, "^-+|-+$", "")).otherwise("").alias("pages"), first_of(use["abstract"]).alias("abstract"))
    me = F.lit(scholar_name)
    role = F.when((me == "") | (F.size("names") == 0), "").when((F.size("names") == 1) & (F.col("names")[0] == me), "sole").when(F.col("names")[0] == me, "first").when(F.array_contains("names", scholar_name), "co").otherwise("")
    return rows.where("title <> ''").select("file", "rec", F.lit(scholar).alias("scholar_key"), F.array_join("names", "、").alias("authors"), "title", "journal", "year", "issue", "pages", role.alias("author_role"), period_of(F.col("year")).alias("period"), F.lit("db-export").alias("verify_status"), F.lit("title;author;journal;year;issue").alias("verified_fields"), F.lit("0").alias("seed_source"), "abstract")
