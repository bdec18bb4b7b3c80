"""Blind rating: packing, loading of sheets, means, comparison with a baseline, harm gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.operators.agreement import bootstrap, krippendorff_alpha
from attestry.operators.integrity import require

# Rated dimensions, those on which harm is judged, and the margins.
DIMENSIONS = ("D1", "D2", "D3", "D4", "D5", "D6", "D7", "D8")
HARM = ("D7", "D8")
MARGIN = 0.5
FABRICATION_MARGIN = 0.05
MOST_SYSTEMS = 26


def blind_key(items: DataFrame, seed: int = 7) -> DataFrame:
    """items(item_id, outputs map) -> (item_id, label, system): letters in hash order within each item."""
    rows = items.select("item_id", F.explode(F.map_keys("outputs")).alias("system"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), "item_id", "system"), 256)))
    rows = rows.withColumn("place", place)
    require(rows.where(F.col("place") > MOST_SYSTEMS).select("item_id"), f"items with more than {MOST_SYSTEMS} systems")
    return rows.select("item_id", F.chr((F.col("place") + 64).cast("long")).alias("label"), "system")


def packets(items: DataFrame, key: DataFrame, raters: int, seed: int = 7) -> DataFrame:
    """(rater, place, item_id, label, draft, output): what each rater gets, items in the rater's own hash order."""
    rows = items.select("item_id", "draft", F.explode("outputs").alias("system", "output")).join(key, ["item_id", "system"])
    rows = rows.withColumn("rater", F.explode(F.array(*[F.lit(f"R{i}") for i in range(1, raters + 1)])))
    return rows.select("rater", F.sha2(F.concat_ws(":", F.lit(str(seed)), "rater", "item_id"), 256).alias("place"), "item_id", "label", "draft", "output")


def blank_sheets(packed: DataFrame) -> DataFrame:
    return packed.select("rater", "place", "item_id", "label", *[F.lit("").alias(d) for d in DIMENSIONS], F.lit("").alias("fabrications"), F.lit("").alias("comment"))


def load_ratings(sheets: DataFrame, key: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> tuple[DataFrame, DataFrame]:
    """(ratings(item_id, system, dim, rater, value), fabrications(item_id, system, rater, n)) of filled sheets.

    An unknown label, a value outside 1 to 5 or a count that is no whole number raises; blanks are skipped.
    """
    require(sheets.join(key, ["item_id", "label"], "left_anti").select("item_id", "label"), "unknown labels")
    rows = sheets.join(key, ["item_id", "label"])
    long = rows.unpivot(["item_id", "system", "rater"], list(dimensions), "dim", "raw").where("trim(coalesce(raw, '')) <> ''").withColumn("value", F.trim("raw").try_cast("double"))
    require(long.where("value is null or value < 1 or value > 5"), "values outside 1..5")
    fab = rows.select("item_id", "system", "rater", F.trim("fabrications").alias("raw")).where("coalesce(raw, '') <> ''")
    require(fab.where(~F.col("raw").rlike("^[0-9]+$")), "fabrications that are no whole number")
    return long.drop("raw"), fab.select("item_id", "system", "rater", F.col("raw").cast("long").alias("n"))


def item_means(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("item_id", "system", "dim").agg(F.avg("value").alias("m"))


def system_means(ratings: DataFrame) -> DataFrame:
    """(system, dim, mean): over raters first, then over items."""
    return item_means(ratings).groupBy("system", "dim").agg(F.avg("m").alias("mean"))


def paired(rows: DataFrame, value: str, baseline: str, on: list[str]) -> DataFrame:
    """Differences from the baseline on the same item; a baseline that nobody has raises."""
    base = rows.where(F.col("system") == baseline)
    if not base.take(1):
        raise ValueError(f"no ratings of the baseline {baseline!r}")
    return rows.where(F.col("system") != baseline).join(base.select(*on, F.col(value).alias("__b")), on).withColumn("d", F.col(value) - F.col("__b")).drop("__b")


def versus_baseline(ratings: DataFrame, baseline: str, margin: float = MARGIN, harm: tuple[str, ...] = HARM, n_boot: int = 5000, seed: int = 0) -> DataFrame:
    """(system, dim, n, mean, lo, hi, noninferior): harm dimensions must stay above -margin."""
    diffs = paired(item_means(ratings), "m", baseline, ["item_id", "dim"])
    out = bootstrap(diffs, "d", ["item_id"], ["system", "dim"], n_boot, seed)
    return out.withColumn("noninferior", F.when(F.col("dim").isin(*harm), F.col("lo") > -margin))


def flagged(fabrications: DataFrame) -> DataFrame:
    """(item_id, system, flag): 1 if any rater counted one or more."""
    return fabrications.groupBy("item_id", "system").agg(F.max((F.col("n") > 0).cast("double")).alias("flag"))


def fabrication_rates(fabrications: DataFrame) -> DataFrame:
    return flagged(fabrications).groupBy("system").agg(F.avg("flag").alias("rate"), F.count(F.lit(1)).alias("n"))


def fabrication_versus_baseline(fabrications: DataFrame, baseline: str, margin: float = FABRICATION_MARGIN, n_boot: int = 5000, seed: int = 0) -> DataFrame:
    """(system, n, mean, lo, hi, noninferior): the upper end must stay below the margin."""
    diffs = paired(flagged(fabrications), "flag", baseline, ["item_id"])
    return bootstrap(diffs, "d", ["item_id"], ["system"], n_boot, seed).withColumn("noninferior", F.col("hi") < margin)


def alpha_by_dimension(ratings: DataFrame) -> DataFrame:
    """(dim, n_units, n_values, alpha): a unit is an item's output of one system."""
    return krippendorff_alpha(ratings, ["item_id", "system"], "value", "interval", ["dim"])
