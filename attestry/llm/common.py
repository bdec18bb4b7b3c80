"""Plumbing that the corpus operators share: written intermediate tables, checked broadcasts, running totals."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side is broadcast only if it was counted and has no more rows and bytes than these.
BROADCAST_ROWS = 20_000
BROADCAST_BYTES = 32 << 20
#: Rows in one Arrow batch of an operator that handles whole texts.
TEXT_BATCH_ROWS = 512
#: The six ASCII white-space bytes, which separate words; bytes.split() uses the same.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a folder of our own, which the session's setting then names."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="attestry-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/attestry-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The rows as a Parquet table in the shared folder: later steps survive lost executors and don't repeat the work."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession) -> None:
    """Bounds an Arrow batch of texts to TEXT_BATCH_ROWS, for the whole session; it never raises a limit that the session has."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > TEXT_BATCH_ROWS:
        spark.conf.set(key, str(TEXT_BATCH_ROWS))


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether df has no more rows and bytes (written as JSON) than these; at most one row more is read of each partition."""
    n, held = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0))).first()
    return n <= rows and held <= size


def small(df: DataFrame) -> DataFrame:
    """df marked for broadcast if its rows and bytes are counted and prove it small, else as it is, for a shuffled join."""
    return F.broadcast(df) if fits_broadcast(df) else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_batches(df: DataFrame, each: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow with batches of bounded size (see text_batches)."""
    text_batches(df.sparkSession)
    return df.mapInArrow(each, schema)


def running_totals(df: DataFrame, order: list, weight: str, by: str | None = None, name: str = "ranged", **more: str) -> DataFrame:
    """Adds `before`: the sum of `weight` over all rows that precede this one in `order` (within its `by`); more: further result=weight.

    Rows are dealt out by range of `order`, so that equal leading keys spread over as many tasks as they fill; each task
    sums its own run while it is written, and only one total for each task and `by` is added up afterwards. `by` must be
    a string without nulls and lead the order. No task holds more than one batch.
    """
    spark, sums = df.sparkSession, {"before": weight, **more}
    weighed = df.withColumns({f"__w{k}": F.col(w).cast("long") for k, w in enumerate(sums.values())})
    ranged = weighed.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).withColumn("__pid", F.spark_partition_id())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, last = [0] * len(sums), None
        for b in batches:
            if not b.num_rows:
                continue
            n, first_end = b.num_rows, b.num_rows
            starts, same, ending = np.zeros(1, np.int64), True, None
            if by is not None:
                runs = b.column(by).dictionary_encode()
                codes = runs.indices.to_numpy(zero_copy_only=False)
                starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
                first_end = starts[1] if len(starts) > 1 else n
                same, ending = runs.dictionary[int(codes[0])].as_py() == last, runs.dictionary[int(codes[-1])].as_py()
            added = []
            for k in range(len(sums)):
                w = b.column(f"__w{k}").to_numpy(zero_copy_only=False).astype(np.int64)
                local = np.cumsum(w) - w
                local -= np.repeat(local[starts], np.diff(np.r_[starts, n]))
                if same:
                    local[:first_end] += carry[k]
                carry[k] = int(local[-1] + w[-1])
                added.append(pa.array(local, pa.int64()))
            last = ending
            yield pa.RecordBatch.from_arrays([*b.columns, *added], names=[*b.schema.names, *[f"__l{k}" for k in range(len(sums))]])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields)
    table = written(ranged.mapInArrow(add, f"{fields}, " + ", ".join(f"__l{k} long" for k in range(len(sums)))), name)
    keys = ["__pid"] + ([by] if by else [])
    totals = table.groupBy(*keys).agg(*[F.sum(f"__w{k}").alias(f"__s{k}") for k in range(len(sums))])
    w = (Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, *[F.coalesce(F.sum(f"__s{k}").over(w), F.lit(0)).alias(f"__o{k}") for k in range(len(sums))])
    found = table.join(small(offsets), keys).withColumns({x: F.col(f"__l{k}") + F.col(f"__o{k}") for k, x in enumerate(sums)})
    return found.drop("__pid", *[f"__{x}{k}" for x in "wlo" for k in range(len(sums))])
