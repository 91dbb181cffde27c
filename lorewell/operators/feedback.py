"""Answer ratings and the golden set made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell import constants as K


def append_feedback(feedback: DataFrame, new: DataFrame) -> DataFrame:
    """Ratings plus new ones; the tools of a new rating are kept as JSON text."""
    made = new.withColumn("tools_used", F.to_json("tools_used")) if dict(new.dtypes).get("tools_used", "").startswith(
        ("array", "struct", "map")
    ) else new
    return feedback.unionByName(made, allowMissingColumns=True)


def latest_feedback(feedback: DataFrame, limit: int | None = None) -> DataFrame:
    """The ratings, newest first; `limit` keeps the newest ones, planned as a top-n, not a full sort."""
    ordered = feedback.orderBy(F.col("timestamp").desc(), "id")
    return ordered if limit is None else ordered.limit(limit)


def export_golden(feedback: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(input, actual_output, expected_output, feedback_type): praised and corrected answers after the old set."""
    na = lambda c: F.coalesce(F.when(F.length(c) > 0, F.col(c)), F.lit("N/A"))
    praised = F.col("score") == 1
    corrected = (F.col("score") == -1) & F.col("user_correction").isNotNull()
    made = feedback.filter(praised | corrected).select(
        na("user_prompt").alias("input"),
        na("ai_response").alias("actual_output"),
        F.when(praised, na("ai_response"))
        .otherwise(F.concat(F.lit(K.CORRECTED_PREFIX), "user_correction"))
        .alias("expected_output"),
        F.when(praised, "positive").otherwise("correction").alias("feedback_type"),
    )
    return made if existing is None else existing.unionByName(made, allowMissingColumns=True)
