"""Sharding by a Hilbert curve through quantised metadata, cut into runs of equal row counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running_totals, shuffle_partitions, small

SHARDS = 16
#: Bits for each dimension: 32 steps.
BITS = 5


def hilbert_index(coords: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of coords (n rows, d dimensions, values below 2**bits).

    The transpose form of J. Skilling, "Programming the Hilbert curve" (2004), on whole columns.
    """
    x = coords.astype(np.int64).T.copy()
    d = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = np.int64(1) << level, (np.int64(1) << level) - 1
        for i in range(d):
            on = (x[i] & bit) != 0
            x[0] = np.where(on, x[0] ^ low, x[0])
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= swap
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip = np.where(x[d - 1] & (np.int64(1) << level), flip ^ ((np.int64(1) << level) - 1), flip)
    x ^= flip
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[i] >> level) & 1)
    return out


def numeric_code(df: DataFrame, column: str, bits: int = BITS) -> Column:
    """Equal-depth step of a number; its cuts are quantiles of all rows, nulls get step 0."""
    steps = 2**bits
    cuts = sorted(set(df.agg(F.percentile_approx(column, [i / steps for i in range(1, steps)], 10_000)).first()[0] or []))
    return sum((F.coalesce((F.col(column) > c).cast("int"), F.lit(0)) for c in cuts), F.lit(0))


def category_codes(df: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """(column, code): steps in the order of the values, each of about the same number of rows. Nulls come first."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    before = running_totals(counts, [F.col(column).asc_nulls_first()], "n", name="codes")
    total = df.count()
    return before.select(F.col(column).alias("__value"), F.least(F.lit(2**bits - 1), F.floor(F.col("before") * 2**bits / F.lit(max(1, total)))).cast("int").alias("code"))


def hilbert_order(df: DataFrame, numbers: list[str], categories: list[str], bits: int = BITS) -> DataFrame:
    """Adds `curve`, the position on the Hilbert curve through the quantised dimensions (categories first)."""
    dims = [f"__d{i}" for i in range(len(categories) + len(numbers))]
    out = df
    for name, column in zip(dims, categories, strict=False):
        codes = category_codes(df, column, bits).withColumnRenamed("code", name).withColumnRenamed("__value", f"{name}v")
        out = out.join(small(codes), F.col(column).eqNullSafe(F.col(f"{name}v"))).drop(f"{name}v")
    for name, column in zip(dims[len(categories) :], numbers, strict=True):
        out = out.withColumn(name, numeric_code(df, column, bits))

    def curve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = hilbert_index(np.stack([b.column(x).to_numpy(zero_copy_only=False) for x in dims], axis=1), bits) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64())], names=[*b.schema.names, "curve"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
    return out.mapInArrow(curve, f"{fields}, curve long").drop(*dims)


def placed_rows(documents: DataFrame, shards: int, bits: int, whole: bool) -> DataFrame:
    """Each row with its curve, shard and slot; whole: with the row itself as struct `row`."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    row = [F.struct(*documents.columns).alias("row")] if whole else []
    rows = documents.select("doc_id", "source", "lang", (F.octet_length(text) + 1).cast("long").alias("__size"), F.crc32(text).alias("__crc"), F.lit(1).alias("__one"), *row)
    curved = hilbert_order(rows, ["__size"], ["source", "lang"], bits)
    placed = running_totals(curved, ["curve", "__crc", "doc_id", "__size"], "__one", name="shards")
    placed = placed.withColumn("__n", F.lit(documents.count()).cast("long")).withColumn("shard", F.expr(f"before * {shards} div __n"))
    return placed.withColumn("slot", F.col("before") - F.expr(f"(shard * __n + {shards - 1}) div {shards}"))


def shard_plan(documents: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """documents(doc_id, text, lang, source, ...) -> where each row goes: doc_id, size, text_crc32, law, shard, slot, grown_shard, curve.

    Law `rows`: rows in curve order are cut into runs whose counts differ by one at most; equal texts of one cell stay
    side by side. Dimensions: source, lang, bytes. Nulls: a null text has 0 bytes and checksum 0; a null source or lang
    is a value of its own and the first. Equal rows and ids are separate rows; an empty table gives no rows. A shard may
    be empty if there are fewer rows than shards. Further columns are ignored.
    """
    return placed_rows(documents, shards, bits, False).select("doc_id", F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), "curve", "source", "lang")


def write_shards(documents: DataFrame, path: str, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """Writes documents as path/shard=N/, sorted along the curve, and returns the manifest: for each shard its rows, bytes and the range of each dimension, by which a reader skips whole shards.

    Columns of documents named shard or n_bytes are replaced. As shard_plan() otherwise.
    """
    placed = placed_rows(documents, shards, bits, True)
    tasks = max(shards, shuffle_partitions(documents.sparkSession))  # a shard is as many files as tasks that its rows fill
    placed.repartitionByRange(tasks, "shard", "slot").sortWithinPartitions("shard", "slot").select(*[f"row.`{c}`" for c in documents.columns if c not in ("shard", "n_bytes")], F.col("__size").alias("n_bytes"), "shard").write.partitionBy("shard").parquet(path)
    back = documents.sparkSession.read.parquet(path)
    return back.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_bytes").alias("bytes"), *[f(c).alias(f"{c}_{f.__name__}") for c in ("source", "lang", "n_bytes") for f in (F.min, F.max)])
