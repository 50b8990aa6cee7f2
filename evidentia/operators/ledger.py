"""Run ledger: event logs, work queues with leases, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def current_state(events: DataFrame, run: str, seq: str, state: Column) -> DataFrame:
    """The last event of each run, with its sequence and the number of events."""
    return events.groupBy(run).agg(F.max_by(state, F.col(seq)).alias("state"), F.max(seq).alias("last_event"), F.count("*").alias("n_events"))


def unique_work(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Idempotent enqueueing: of rows with one natural key the first stays."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_n", n).filter("_n = 1").drop("_n")


def claim_next(items: DataFrame, run: str, now: Column, order: list[str]) -> DataFrame:
    """The next item of each run: queued, or claimed with a lease that has run out."""
    free = (F.col("status") == "queued") | ((F.col("status") == "claimed") & (F.col("lease_until") < now))
    n = F.row_number().over(Window.partitionBy(run).orderBy(*order))
    return items.filter(free).withColumn("_n", n).filter("_n = 1").drop("_n")


def retained(files: DataFrame, group: str, age_days: str, size: str, order: list, most_days: int, most_bytes: int) -> DataFrame:
    """Not older than `most_days`, and within `most_bytes` counted from the newest."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return files.filter(F.col(age_days) <= most_days).withColumn("running", F.sum(size).over(w)).filter(F.col("running") <= most_bytes)
