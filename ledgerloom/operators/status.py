"""Job and block states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def block_key(screen: str, test: str, index: str) -> Column:
    """Identity of a block: its screen, else its test, else its place."""
    filled = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return F.coalesce(F.concat(F.lit("screen:"), filled(screen)), F.concat(F.lit("test:"), filled(test)), F.concat(F.lit("index:"), F.col(index).cast("string")))


def interrupt_queued(blocks: DataFrame, failed_jobs: DataFrame, job: str, reason: str) -> DataFrame:
    """Blocks still queued in a failed job become interrupted, with the reason."""
    flagged = blocks.join(failed_jobs.select(job).distinct().withColumn("_failed", F.lit(True)), job, "left")
    hit = F.coalesce("_failed", F.lit(False)) & (F.col("status") == "queued")
    return flagged.withColumns({"error": F.when(hit, F.lit(reason)).otherwise(F.col("error")), "status": F.when(hit, F.lit("interrupted")).otherwise(F.col("status"))}).drop("_failed")


def cover_status(old_number: str, new_number: str, old_title: str, new_title: str, edits: str, error: str) -> Column:
    """failed, updated, partial or unchanged, from what was to change and what did."""
    wants = (F.when(~F.col(old_number).eqNullSafe(F.col(new_number)), 1).otherwise(0) + F.when(~F.col(old_title).eqNullSafe(F.col(new_title)), 1).otherwise(0)).cast("int")
    done = F.coalesce(F.col(edits), F.lit(0))
    return F.when(F.coalesce(error, F.lit("")) != "", "failed").when(wants == 0, "unchanged").when(done >= wants, "updated").when(done > 0, "partial").otherwise("unchanged")
