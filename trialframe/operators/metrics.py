"""Quality metrics of criteria."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _any(severity: str) -> Column:
    return F.exists("validation_issues", lambda x: x["severity"] == severity)


def _measures() -> list[Column]:
    return [
        F.count("criterion_id").alias("criteria"),
        F.count_if(F.col("criterion_type") == "inclusion").alias("inclusion"),
        F.count_if(F.col("criterion_type") == "exclusion").alias("exclusion"),
        F.count_if(_any("error")).alias("with_errors"),
        F.count_if(_any("warning")).alias("with_warnings"),
        F.avg("extraction_confidence").alias("mean_confidence"),
    ]


def quality_rollup(criteria: DataFrame, trials: DataFrame | None = None) -> DataFrame:
    """The metrics of each trial and, with a null trial_id, of all.

    Trials of ``trials`` (trial_id) without criteria are kept, with a null mean.
    """
    if trials is not None:
        criteria = trials.select("trial_id").distinct().join(criteria, "trial_id", "left")
    rolled = criteria.rollup("trial_id").agg(F.grouping("trial_id").alias("overall"), F.count_distinct("trial_id").alias("trials"), *_measures())
    return rolled


def issue_histogram(criteria: DataFrame) -> DataFrame:
    """(code, severity, n): how often each issue occurs, the most frequent first."""
    found = criteria.select(F.explode("validation_issues").alias("i")).groupBy(F.col("i.code").alias("code"), F.col("i.severity").alias("severity")).agg(F.count("*").alias("n"))
    return found.orderBy(F.col("n").desc(), "code", "severity")
