"""Comment aggregation over a stream: an extension beside the batch operator, not a parity claim."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(comments: DataFrame, time: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window, advisor, code, n, n_drafts, share): per event-time window; state ends with the watermark, so late rows beyond it are dropped by the stream, as streams do.

    Distinct drafts are counted approximately: exact distinct sets would keep state without a bound.
    """
    rows = comments.withWatermark(time, late)
    none = F.array().cast("array<string>")
    long = rows.select(F.window(time, window).alias("window"), F.coalesce("advisor", F.lit("unknown")).alias("advisor"), F.coalesce("draft_id", F.lit("")).alias("draft_id"), F.coalesce("generalizable", F.lit(False)).alias("generalizable"), F.explode(F.concat(F.coalesce("defect_codes", none), F.coalesce("move_codes", none))).alias("code"))
    return long.groupBy("window", "advisor", "code").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("draft_id").alias("n_drafts"), F.avg(F.col("generalizable").cast("double")).alias("share"))
