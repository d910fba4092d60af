"""Batches of a stream of changes: by table, by size, and the newest message of each partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.fold import CDC


def by_table(events: DataFrame) -> DataFrame:
    return events.groupBy("table").agg(F.count(F.lit(1)).alias("n"))


def stats(changes: DataFrame, pk: list[str], size: int = 500) -> DataFrame:
    """``batch, n_events, n_keys`` when dense sequence numbers are cut every ``size``; keys are what a fold of the batch leaves."""
    rows = changes.select(F.floor(F.col(f"{CDC}.seq") / size).cast("long").alias("batch"), *pk)
    per_key = rows.groupBy("batch", *pk).agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy("batch").agg(F.sum("n").cast("long").alias("n_events"), F.count(F.lit(1)).alias("n_keys"))


def high_water(messages: DataFrame, partition: str, offset: str) -> DataFrame:
    """The newest message of each partition."""
    others = [c for c in messages.columns if c not in (partition, offset)]
    return messages.groupBy(partition).agg(F.max(offset).alias(offset), *(F.max_by(c, offset).alias(c) for c in others))
