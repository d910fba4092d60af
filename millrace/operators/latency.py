"""Commit-to-apply latency of the rows of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.merge import APPLIED_AT, COMMIT_TS


def _counts(since: Column | None, table: DataFrame) -> DataFrame:
    """``minute, us, n``: how many rows of a minute took so many microseconds. All figures come from these counts."""
    rows = table.filter(F.col(COMMIT_TS).isNotNull() & F.col(APPLIED_AT).isNotNull())
    if since is not None:
        rows = rows.filter(F.col(APPLIED_AT) >= since)
    took = F.unix_micros(F.col(APPLIED_AT).cast("timestamp")) - F.unix_micros(F.col(COMMIT_TS).cast("timestamp"))
    return rows.groupBy(F.date_trunc("minute", F.col(APPLIED_AT)).cast("timestamp_ntz").alias("minute"), took.alias("us")).agg(F.count(F.lit(1)).alias("n"))


def _percentile(counts: DataFrame, key: str, q: float, name: str) -> DataFrame:
    """``key, name``: the exact interpolated percentile, in seconds, of each key.

    Values are numbered by running sums of their counts, first over ranges of about a second, then within the one or two ranges that hold the
    percentile. So a window has as many rows as seconds or as microseconds of a range, however many rows there are."""
    ranges = counts.groupBy(key, F.shiftright("us", 20).alias("r")).agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(key).orderBy("r"))
    total = F.sum("n").over(Window.partitionBy(key))
    at = q * (F.col("total") - 1)
    low, high = F.floor(at), F.ceil(at)
    placed = ranges.select(key, "r", (upto - F.col("n")).alias("before"), upto.alias("upto"), total.alias("total"))
    held = placed.filter(((F.col("before") <= low) & (low < F.col("upto"))) | ((F.col("before") <= high) & (high < F.col("upto"))))
    few = counts.groupBy(key, "us").agg(F.sum("n").alias("n")).withColumn("r", F.shiftright("us", 20))
    fine = few.join(held.select(F.col(key).alias("__key"), F.col("r").alias("__r"), "before", "total"), (F.col(key) == F.col("__key")) & (F.col("r") == F.col("__r")))
    numbered = fine.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy(key, "r").orderBy("us")))
    found = numbered.groupBy(key).agg(F.min(F.when(F.col("upto") > low, F.col("us"))).alias("a"), F.min(F.when(F.col("upto") > high, F.col("us"))).alias("b"), F.first(at - low).alias("part"))
    return found.select(key, ((F.col("a") + (F.col("b") - F.col("a")) * F.col("part")) / F.lit(1e6)).alias(name))


def by_minute(table: DataFrame, since: Column | None = None) -> DataFrame:
    """``minute, row_count, avg_latency_s, p95_latency_s, max_latency_s`` of each minute in which rows were applied."""
    counts = _counts(since, table)
    plain = counts.groupBy("minute").agg(F.sum("n").alias("row_count"), (F.sum(F.col("us") * F.col("n")) / F.sum("n") / F.lit(1e6)).alias("avg_latency_s"), (F.max("us") / F.lit(1e6)).alias("max_latency_s"))
    return plain.join(_percentile(counts, "minute", 0.95, "p95_latency_s"), "minute").select("minute", "row_count", "avg_latency_s", "p95_latency_s", "max_latency_s")


def overall(table: DataFrame, since: Column | None = None) -> DataFrame:
    """One row: all rows, the average over them, the largest of the minutes' 95th percentiles, the true one, and the largest latency."""
    minutes = by_minute(table, since).agg(
        F.sum("row_count").cast("long").alias("row_count"), (F.sum(F.col("avg_latency_s") * F.col("row_count")) / F.sum("row_count")).alias("avg_latency_s"), F.max("p95_latency_s").alias("p95_max_bucket_s"), F.max("max_latency_s").alias("max_latency_s")
    )
    true = _percentile(_counts(since, table).withColumn("all", F.lit(0)), "all", 0.95, "p95_true_s")
    return minutes.withColumn("p95_true_s", true.select("p95_true_s").scalar())


def csv_rows(minutes: DataFrame) -> DataFrame:
    """The minutes as text, as the CSV file has them: three decimals, halves (to a millionth) up."""
    three = [F.format_string("%.3f", F.round(c, 6) + 1e-9).alias(c) for c in ("avg_latency_s", "p95_latency_s", "max_latency_s")]
    return minutes.select(F.date_format("minute", "yyyy-MM-dd HH:mm:ss").alias("minute"), F.col("row_count").cast("string").alias("row_count"), *three)


def write_csv(minutes: DataFrame, path: str) -> None:
    """One file with a header, a row for each minute in order."""
    csv_rows(minutes).orderBy("minute").coalesce(1).write.mode("overwrite").csv(path, header=True)
