"""Cohorts: manifests, pending work, retries and recent jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import missing, strip


def manifest_trials(entries: DataFrame) -> DataFrame:
    """(trial_id, pos) of the active entries (pos, trial_id, enabled, status), each trial at its first place."""
    placeholder = (~F.coalesce(F.col("enabled"), F.lit(True))) | F.upper(F.coalesce(F.col("status"), F.lit(""))).isin("TBD", "PLACEHOLDER")
    active = entries.filter(~(missing("trial_id") & placeholder))
    return active.groupBy(F.upper(strip("trial_id")).alias("trial_id")).agg(F.min("pos").alias("pos"))


def blank_slots(entries: DataFrame) -> DataFrame:
    """Entries without an id that are not placeholders: errors of the manifest."""
    placeholder = (~F.coalesce(F.col("enabled"), F.lit(True))) | F.upper(F.coalesce(F.col("status"), F.lit(""))).isin("TBD", "PLACEHOLDER")
    return entries.filter(missing("trial_id") & ~placeholder)


def profile(entries: DataFrame) -> DataFrame:
    """Per cohort: slots, active ones, blank ones, distinct trials and repeated ones."""
    ident = F.when(~missing("trial_id"), F.upper(strip("trial_id")))
    return entries.groupBy("cohort").agg(F.count("*").alias("slots"), F.count(ident).alias("active"), (F.count("*") - F.count(ident)).alias("blank"), F.count_distinct(ident).alias("trials"), (F.count(ident) - F.count_distinct(ident)).alias("repeated"))


def pending(manifest: DataFrame, state: DataFrame) -> DataFrame:
    """Trials of the manifest that have not completed."""
    done = state.filter("status = 'completed'").select("trial_id")
    return manifest.join(done, "trial_id", "left_anti")


def not_in(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of trials that are not in the manifest; a subset's are none."""
    return rows.join(manifest.select("trial_id"), "trial_id", "left_anti")


def study_protocols(manifest: DataFrame, studies: DataFrame) -> DataFrame:
    """The studies of the manifest's trials."""
    return studies.join(manifest, "trial_id")


def retry_actions(attempts: DataFrame, retry_limit: int = 2) -> DataFrame:
    """(trial_id, failures, next_action) from (trial_id, failed, error).

    Trials without a failure are done; those without criteria are never retried; others are retried until they
    have failed more than ``retry_limit`` times.
    """
    terminal = F.coalesce(F.lower("error").contains("no criteria segmented"), F.lit(False))
    counted = attempts.groupBy("trial_id").agg(F.count_if("failed").alias("failures"), F.coalesce(F.bool_or(terminal & F.col("failed")), F.lit(False)).alias("terminal"))
    action = F.when(F.col("failures") == 0, "done").when(F.col("terminal") | (F.col("failures") > retry_limit), "stop").otherwise("retry")
    return counted.select("trial_id", "failures", action.alias("next_action"))


def latest_status(events: DataFrame) -> DataFrame:
    """The last event (by ts, then seq) of each job."""
    return events.groupBy("job_id").agg(F.max_by(F.struct("ts", "stage", "seq"), F.struct("ts", "seq")).alias("e"), F.count("*").alias("events")).select("job_id", F.col("e.ts").alias("ts"), F.col("e.stage").alias("stage"), "events")


#: What a list of jobs shows of each.
SUMMARY = "job_id trial_id protocol_id source_version input_mode status stage progress created_at updated_at error".split()


def recent_jobs(jobs: DataFrame, limit: int = 100) -> DataFrame:
    """The summaries of the most recently updated jobs, absent columns null; a top-k, without a full sort."""
    shown = [F.col(c) if c in jobs.columns else F.lit(None).cast("string").alias(c) for c in SUMMARY]
    return jobs.orderBy(F.col("updated_at").desc(), "job_id").limit(limit).select(*shown)


def jobs_in_order(manifest: DataFrame, jobs: DataFrame) -> DataFrame:
    """The manifest's jobs with their place; trials without a job are left out."""
    return jobs.join(manifest, "trial_id").orderBy("pos", "job_id")


def completed_jobs(manifest: DataFrame, jobs: DataFrame) -> DataFrame:
    return jobs.filter("status = 'completed'").join(manifest.select("trial_id"), "trial_id", "left_semi")


def renormalizable(jobs: DataFrame) -> DataFrame:
    """Completed jobs that kept their proposals."""
    return jobs.filter("status = 'completed' and size(checkpoint_rows) > 0")


def renormalize_summary(jobs: DataFrame, criteria: DataFrame) -> DataFrame:
    """One row: jobs and rows renormalized, jobs skipped."""
    done = criteria.agg(F.count_distinct("job_id").alias("jobs"), F.count("*").alias("rows"))
    skipped = jobs.join(renormalizable(jobs).select("job_id"), "job_id", "left_anti").agg(F.count("*").alias("skipped"))
    one = F.lit(1)
    return done.withColumn("k", one).join(skipped.withColumn("k", one), "k").drop("k")


def batches(items: DataFrame, size: int = 20) -> DataFrame:
    """Items with the number of their batch in their protocol."""
    order = Window.partitionBy("protocol_id").orderBy("item_no")
    return items.withColumn("batch", F.floor((F.row_number().over(order) - 1) / size).cast("long"))
