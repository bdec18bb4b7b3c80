"""Advisers' comments by adviser and code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFECT_FORM = r"^[QLCMETNP][0-9]$"


def coded(comments: DataFrame) -> DataFrame:
    """(advisor, draft_id, code, generalizable): a row for each code of each comment; repeated codes count again."""
    none = F.array().cast("array<string>")
    return comments.select(F.coalesce("advisor", F.lit("unknown")).alias("advisor"), F.coalesce("draft_id", F.lit("")).alias("draft_id"), F.coalesce("generalizable", F.lit(False)).alias("generalizable"), F.explode(F.concat(F.coalesce("defect_codes", none), F.coalesce("move_codes", none))).alias("code"))


def aggregate(comments: DataFrame, min_comments: int = 3, min_drafts: int = 2, min_share: float = 0.5) -> DataFrame:
    """(advisor, code, n, n_drafts, share, candidate); a missing draft counts as one draft."""
    out = coded(comments).groupBy("advisor", "code").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("draft_id").alias("n_drafts"), F.avg(F.col("generalizable").cast("double")).alias("share"))
    return out.withColumn("candidate", (F.col("n") >= min_comments) & (F.col("n_drafts") >= min_drafts) & (F.col("share") >= min_share))


def invalid(comments: DataFrame) -> DataFrame:
    """(comment_id, problem): rows that break the comment schema."""
    need = [F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(f"{c}: missing")) for c in ("comment_id", "advisor", "draft_id", "comment_text")]
    need += [F.when(F.col(c).isNull(), F.lit(f"{c}: missing")) for c in ("defect_codes", "generalizable")]
    form = F.when(F.exists(F.coalesce("defect_codes", F.array().cast("array<string>")), lambda c: ~c.rlike(DEFECT_FORM)), F.lit("defect_codes: form"))
    return comments.select("comment_id", F.explode(F.filter(F.array(*need, form), lambda p: p.isNotNull())).alias("problem"))
