"""Assertions on tables, and the difference of two keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class IntegrityError(ValueError):
    """A table breaks a rule that everything after it relies on."""


def require(broken: DataFrame, what: str) -> None:
    rows = broken.limit(3).collect()
    if rows:
        raise IntegrityError(f"{what}: e.g. {rows}")


def require_unique(df: DataFrame, keys: list[str]) -> None:
    require(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"duplicates of {keys}")


def require_known(df: DataFrame, dimension: DataFrame, key: str) -> None:
    require(df.select(key).join(dimension.select(key), key, "left_anti"), f"unknown {key}")


def keyed_difference(expected: DataFrame, current: DataFrame, key: str, value: str) -> DataFrame:
    """(key, state): `missing` from current, `extra` in it, or `stale`; equal rows are left out."""
    a, b = expected.select(key, F.col(value).alias("__a"), F.lit(1).alias("__x")), current.select(key, F.col(value).alias("__b"), F.lit(1).alias("__y"))
    state = F.when(F.col("__y").isNull(), "missing").when(F.col("__x").isNull(), "extra").when(~F.col("__a").eqNullSafe(F.col("__b")), "stale")
    return a.join(b, key, "full_outer").select(key, state.alias("state")).where("state is not null")


def mentions(documents: DataFrame, present: DataFrame, pattern: str) -> DataFrame:
    """documents(path, text), present(name) -> (name, state): names matched in a text but absent (`missing`), or present and never mentioned (`unused`)."""
    named = documents.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("name")).distinct()
    missing = named.join(present, "name", "left_anti").select("name", F.lit("missing").alias("state"))
    return missing.unionByName(present.join(named, "name", "left_anti").select("name", F.lit("unused").alias("state")))


# Files of a bundle, what its front matter and texts have to hold, and their largest sizes.
MAIN_FILE = "SKILL.md"
POINTER = r"references/([A-Za-z0-9_\-]+\.md)"
PLACEHOLDER = r"\b(?:TODO|TBD|XXX)\b|待补充"
NAME_FORM = r"^[a-z0-9][a-z0-9-]{0,62}[a-z0-9]$"
DESCRIPTION_CHARS, TRIGGER, TRIGGER_SCRIPT = (80, 1024), "Use when", "[一-鿿]"
BODY_LINES, LONG_LINES, CONTENTS, CONTENTS_WITHIN = 500, 100, "## 目录", 25


def bundle_errors(files: DataFrame, forbidden: list[str]) -> DataFrame:
    """files(path as bundle/SKILL.md or bundle/references/x.md, text) -> (path, error), a row for each fault.

    Of main files the front matter (name, description, license), the size, and pointers against the files that are
    there, both ways; of all files forbidden names and placeholders; of references nested pointers and long texts
    without contents. Null texts are empty; a bundle without a main file is a fault of its own.
    """
    rows = files.select("path", F.coalesce("text", F.lit("")).alias("text"), F.substring_index("path", "/", 1).alias("bundle"), F.substring_index("path", "/", -1).alias("file"))
    bundles = rows.groupBy("bundle").agg(F.collect_set(F.when(F.col("path").contains("/references/"), F.col("file"))).alias("present"), F.max(F.col("path") == F.concat("bundle", F.lit(f"/{MAIN_FILE}"))).alias("has_main"))
    rows = rows.join(bundles, "bundle")
    matter, body = (F.regexp_extract("text", r"(?s)^---\n(.*?)\n---\n(.*)$", g) for g in (1, 2))
    entry = lambda k: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(matter, rf"(?m)^{k}:[ \t]*[>|]?[-+]?[ \t]*((?:.*)(?:\n[ \t]+.*)*)", 1), r"\s+", " "), r"^ ?['\"]|['\"] ?$", ""))
    name, description = entry("name"), entry("description")
    n_lines = lambda t: F.size(F.split(F.regexp_replace(t, "\n$", ""), "\n"))
    none = F.array().cast("array<string>")
    mentioned = F.array_distinct(F.regexp_extract_all(body, F.lit(POINTER), F.lit(1)))
    least, most = DESCRIPTION_CHARS
    main = [
        F.when(name != F.col("bundle"), "name differs from its folder"), F.when(~name.rlike(NAME_FORM), "name is not in kebab case"), F.when(description == "", "no description").when(~F.length(description).between(least, most), f"description outside {least} to {most} characters"),
        F.when((description != "") & ~description.contains(TRIGGER), f"description without {TRIGGER!r}"), F.when((description != "") & ~description.rlike(TRIGGER_SCRIPT), "description without Chinese phrases"), F.when(entry("license") == "", "no license"), F.when(n_lines(body) > BODY_LINES, f"more than {BODY_LINES} lines"),
    ]
    told = lambda found, what: F.transform(found, lambda x: F.concat(F.lit(what), x))
    of_main = F.when(matter == "", F.array(F.lit("no front matter"))).otherwise(F.concat(F.array(*main), told(F.array_except(mentioned, "present"), "points to missing "), told(F.array_except("present", mentioned), "never mentions ")))
    early = F.array_join(F.slice(F.split("text", "\n"), 1, CONTENTS_WITHIN), "\n")
    bare = F.regexp_replace("text", "(?s)<!--.*?-->", "")
    of_reference = F.array(F.when(bare.rlike(POINTER), "points to a further reference"), F.when((n_lines(F.col("text")) > LONG_LINES) & ~early.contains(CONTENTS), f"over {LONG_LINES} lines without contents"))
    of_all = F.array(*[F.when(F.col("text").contains(n), F.lit(f"has the name {n}")) for n in forbidden], F.when(F.col("text").rlike(PLACEHOLDER), "has a placeholder"))
    is_main, is_reference = F.col("path") == F.concat("bundle", F.lit(f"/{MAIN_FILE}")), F.col("path").contains("/references/")
    found = rows.select("path", F.explode(F.filter(F.concat(of_all, F.when(is_main, of_main).otherwise(none), F.when(is_reference, of_reference).otherwise(none)), lambda e: e.isNotNull())).alias("error"))
    return found.unionByName(bundles.where("not has_main").select(F.col("bundle").alias("path"), F.lit(f"no {MAIN_FILE}").alias("error")))
