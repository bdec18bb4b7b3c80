"""Reading and writing tables: CSV registries, JSON and JSON-lines records, YAML dimensions, texts, reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry import schemas
from attestry.operators.integrity import require, require_known, require_unique


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """The registry: all columns text, absent ones and nulls empty; a missing file is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schemas.PAPER)
    found = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", True).option("escape", '"').csv(path)
    return found.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if c in found.columns else F.lit("").alias(c) for c in schemas.PAPER_COLUMNS])


def write_papers(papers: DataFrame, path: str) -> None:
    """Fixed column order. The rows are written beside the old registry, which only then gives way: papers may be read from it."""
    put_in_place(papers.sparkSession, path, lambda new: papers.select(*schemas.PAPER_COLUMNS).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(new))


def put_in_place(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """write(folder) to a new folder beside path, then renames: a failed write leaves what is at path, and so does a lost driver."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    mark = uuid.uuid4().hex[:8]
    target, new, old = (hadoop.Path(path.rstrip("/") + end) for end in ("", f".new-{mark}", f".old-{mark}"))
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    write(new.toString())
    had = files.exists(target)
    if had and not files.rename(target, old):
        raise OSError(f"{path} can't be moved aside; the new rows are in {new.toString()}")
    if not files.rename(new, target):
        if had:
            files.rename(old, target)
        raise OSError(f"{path} can't be replaced; the new rows are in {new.toString()}")
    if had:
        files.delete(old, True)


def read_annotations(spark: SparkSession, folders: list[str]) -> DataFrame:
    """One JSON file each, with dir_ord and file, by which `first` is defined, and `unknown`: paths of properties that the
    schema doesn't have. Names that start with _ are left out by Spark; a file that is no JSON gives nulls."""
    out = None
    for i, folder in enumerate(folders):
        one = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json")
        one = one.select(F.from_json("value", schemas.ANNOTATION).alias("a"), unknown_properties(F.col("value")).alias("unknown"), F.lit(i).alias("dir_ord"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"))
        one = one.select("a.*", "dir_ord", "file", "unknown")
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = spark.createDataFrame([], T.StructType([*schemas.ANNOTATION.fields, T.StructField("dir_ord", T.IntegerType()), T.StructField("file", T.StringType()), T.StructField("unknown", T.ArrayType(T.StringType()))]))
    return out.withColumn("paper_id", F.coalesce("paper_id", F.regexp_replace("file", "\\.json$", "")))


def unknown_properties(text: Column) -> Column:
    """Paths of the properties of an annotation's JSON text that the published schema doesn't allow, sorted."""
    none = F.array().cast("array<string>")

    def beyond(json: Column, known: tuple[str, ...], at: Column) -> Column:
        found = F.array_except(F.coalesce(F.json_object_keys(json), none), F.array(*[F.lit(k) for k in known]))
        return F.transform(found, lambda k: F.concat(at, k))

    def listed(json: Column) -> Column:
        return F.coalesce(F.from_json(json, "array<string>"), none)

    def evidence(json: Column, at: Column) -> Column:
        return F.flatten(F.transform(listed(F.get_json_object(json, "$.evidence")), lambda e: beyond(e, ("quote", "loc"), F.concat(at, F.lit("/evidence/")))))

    fields = F.map_entries(F.coalesce(F.from_json(F.get_json_object(text, "$.fields"), "map<string,string>"), F.create_map().cast("map<string,string>")))
    in_field = lambda e: F.concat(beyond(e["value"], ("status", "value", "evidence"), F.concat(F.lit("fields/"), e["key"], F.lit("/"))), evidence(e["value"], F.concat(F.lit("fields/"), e["key"])))
    in_move = lambda m: F.concat(beyond(m, ("code", "evidence", "note"), F.lit("moves/")), evidence(m, F.lit("moves")))
    top = beyond(text, tuple(schemas.ANNOTATION.names), F.lit(""))
    return F.array_sort(F.array_distinct(F.concat(top, F.flatten(F.transform(fields, in_field)), F.flatten(F.transform(listed(F.get_json_object(text, "$.moves")), in_move)))))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Blank lines are skipped; a line that is no JSON object fails the read, with its file and number.

    A file is one row until its lines are numbered, so it may have 2 GB at most: split larger exports into files.
    """
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    rows = files.where(F.trim("line") != "")
    # a later filter may be evaluated first, so that blank lines are told apart here too
    checked = F.when(F.trim("line") == "", F.lit(None)).when(F.json_object_keys("line").isNull(), F.raise_error(F.concat("file", F.lit(":"), (F.col("at") + 1).cast("string"), F.lit(": not a JSON object")))).otherwise(F.col("line"))
    return rows.select(F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("x")).select("x.*")


def read_comments(spark: SparkSession, path: str) -> DataFrame:
    return read_json_lines(spark, path, schemas.COMMENT)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Blind items; each needs an id and two outputs or more, and all the same systems."""
    items = read_json_lines(spark, path, schemas.ITEM)
    require(items.where((F.coalesce("item_id", F.lit("")) == "") | F.coalesce(F.size("outputs") < 2, F.lit(True))), "items without item_id or with fewer than two outputs")
    if items.select(F.array_join(F.array_sort(F.map_keys("outputs")), "\x00").alias("s")).distinct().limit(2).count() > 1:
        raise ValueError("all items must have outputs of the same systems")
    return items


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """Score sheets scores_<rater>.csv with the rater from the file's name; all columns text."""
    found = spark.read.option("header", True).csv(path, pathGlobFilter="scores_*.csv")
    return found.withColumn("rater", F.regexp_extract(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"^scores_(.*)\.csv$", 1))


def load_yaml(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def codebook(spark: SparkSession, data: dict) -> tuple[DataFrame, DataFrame]:
    """(families, moves) of a loaded codebook; duplicate codes and unknown families raise."""
    families = data["families"]
    rows = [(i, f["id"] if "id" in f else f["code"], f.get("label"), f.get("question")) for i, f in enumerate(families)] if isinstance(families, list) else [(i, k, (v or {}).get("label") if isinstance(v, dict) else v, (v or {}).get("question") if isinstance(v, dict) else None) for i, (k, v) in enumerate(families.items())]
    fam = spark.createDataFrame(rows, "ord int, family string, label string, question string")
    keys = ("code", "family", "label", "definition", "include", "exclude", "example")
    moves = spark.createDataFrame([tuple(None if m.get(k) is None else str(m[k]) for k in keys) for m in data["moves"]], ", ".join(f"{k} string" for k in keys))
    require_unique(moves, ["code"])
    require_known(moves, fam, "family")
    return fam, moves


def rule_registry(spark: SparkSession, data: dict) -> tuple[DataFrame, DataFrame, dict]:
    """(lenses, rules, admission) of a loaded registry; duplicate ids, unknown lenses and statuses raise."""
    lenses = spark.createDataFrame([(x["id"], x.get("name"), bool(x.get("panel")), list(map(str, x.get("tradition", {}).get("keys") or [])), list(map(str, x.get("tradition", {}).get("scholars") or [])), list(map(str, x.get("questions") or []))) for x in data["lenses"]], "lens string, name string, panel boolean, keys array<string>, scholars array<string>, questions array<string>")
    rules = spark.createDataFrame([(r["id"], r["lens"], r["layer"], r["status"], list(r.get("requires") or []), r.get("trigger"), r.get("action"), list(r.get("candidate_sources") or [])) for r in data["rules"]], "rule_id string, lens string, layer string, status string, requires array<string>, trigger string, action string, candidate_sources array<string>")
    require_unique(rules, ["rule_id"])
    require_known(rules, lenses, "lens")
    require(rules.where(~F.col("status").isin(*schemas.RULE_STATUSES)), "rules with an unknown status")
    return lenses, rules, data["admission"]


@F.pandas_udf(T.StringType())
def decoded(contents):  # noqa: ANN001, ANN201  a series of bytes
    """UTF-8 with or without a byte-order mark; what can't be decoded is replaced."""
    return contents.map(lambda b: None if b is None else bytes(b).decode("utf-8-sig", "replace"))


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, ext, path, text, file_sha256) of .txt and .md files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,md}").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("ext"), "path", decoded("content").alias("text"), F.sha2("content", 256).alias("file_sha256"))


def full_texts(papers: DataFrame, texts: DataFrame, extensions: tuple[str, ...] = (".txt", ".md", ".pdf")) -> DataFrame:
    """(paper_id, path, text): a named file, with nothing in its place if it is missing, else the first extension that exists."""
    rank = F.array_position(F.array(*[F.lit(e) for e in extensions]), F.col("ext"))
    named = papers.where("coalesce(fulltext, '') <> ''").join(texts, F.expr("endswith(path, fulltext)") & (F.element_at(F.split("fulltext", "/"), -1) == F.concat("stem", "ext")), "left").groupBy("paper_id").agg(F.min("path").alias("path"), F.min_by("text", "path").alias("text"))
    found = papers.where("coalesce(fulltext, '') = ''").join(texts, F.col("paper_id") == F.col("stem")).groupBy("paper_id").agg(F.min_by("path", rank).alias("path"), F.min_by("text", rank).alias("text"))
    return named.where("path is not null").unionByName(found)


def abstracts(papers: DataFrame, stored: DataFrame, full: DataFrame) -> DataFrame:
    """(paper_id, abstract): the stored one, else what the text has between its marks, else ""."""
    from attestry.functions.text import abstract, stripped

    s = stored.select(F.col("stem").alias("paper_id"), stripped(F.col("text")).alias("stored"))
    return papers.select("paper_id").join(s, "paper_id", "left").join(full.select("paper_id", "text"), "paper_id", "left").select("paper_id", F.coalesce("stored", abstract(F.col("text")), F.lit("")).alias("abstract"))


def text_sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def write_report(path: str, content: str) -> None:
    """A small driver-side report, put in place at once."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_suffix(target.suffix + ".part")
    part.write_text(content, encoding="utf-8")
    part.replace(target)
