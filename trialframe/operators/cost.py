"""Costs of model calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """``usage`` (model, input_tokens, output_tokens, ...) with its cost; unknown models cost nothing.

    ``prices`` is (model, input_per_1m, output_per_1m). Spark broadcasts it while it is small.
    """
    found = usage.join(prices, "model", "left")
    each = lambda tokens, price: F.col(tokens) * F.coalesce(F.col(price), F.lit(0.0)) / 1e6
    return found.withColumn("cost", each("input_tokens", "input_per_1m") + each("output_tokens", "output_per_1m")).drop("input_per_1m", "output_per_1m")


def cost_summary(events: DataFrame, warn_at: float) -> DataFrame:
    """Per model: calls, tokens, cost to 6 digits, and whether it reached ``warn_at``."""
    sums = events.groupBy("model").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost"))
    return sums.withColumn("warn", F.col("cost") >= warn_at).withColumn("cost", F.round("cost", 6))


def running_cost(events: DataFrame, limit: float) -> DataFrame:
    """Per run (run_id) the first event, by seq, after which the running cost exceeds ``limit``."""
    order = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = events.withColumn("spent", F.sum("cost").over(order)).filter(F.col("spent") > limit)
    return over.groupBy("run_id").agg(F.min("seq").alias("seq"), F.min_by("spent", "seq").alias("spent"))
