"""Results that several later steps read, computed once."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """df written to the reliable checkpoint folder: its lineage ends there, and lost executors cost nothing.

    The folder is spark.checkpoint.dir; only in local mode one of our own is made where that is unset, and the session's
    setting is set to it. The context's checkpoint folder becomes this one.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="attestry-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    return df.checkpoint()


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Adds `name`: the number of a row within its `by`, from 1, in `order`; ties are numbered in any order.

    Rows are dealt out by range of (by, order), so that a group of any size fills many tasks; a window numbers each
    task's part of a group, and one count for each task and group is added up afterwards.
    """
    ranged = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, *order)
    placed = settled(ranged.withColumn("__task", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    local = F.row_number().over(Window.partitionBy("__task", *by).orderBy(*order, "__at"))
    counts = placed.groupBy("__task", *by).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("__task").alias("__t"), *[F.col(c).alias(f"__by{k}") for k, c in enumerate(by)], before.alias("__before"))
    on = F.col("__task") == F.col("__t")
    for k, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"__by{k}"))
    found = placed.withColumn("__local", local).join(starts, on)
    return found.withColumn(name, (F.col("__before") + F.col("__local")).cast("long")).select(*rows.columns, name)
