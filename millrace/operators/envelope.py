"""The change event as it travels: a self-describing JSON document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.types import from_text
from millrace.operators.fold import cdc

OPS = ("c", "u", "d", "r")
SCHEMA = "op STRING, `table` STRING, lsn DECIMAL(20,0), commit_ts TIMESTAMP, pk MAP<STRING,STRING>, after MAP<STRING,STRING>, unchanged ARRAY<STRING>, types MAP<STRING,STRING>, moved_from MAP<STRING,STRING>"
FIELDS = ("op", "table", "lsn", "commit_ts", "pk", "after", "unchanged", "types", "moved_from")


def canonical(m: Column) -> Column:
    """JSON of a map with sorted keys; null values stay."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def message_key(table: Column, pk: Column) -> Column:
    """Key of a message: the same for every change of a row, so that they stay in order."""
    return F.concat(table, F.lit(":"), canonical(pk))


def encode(events: DataFrame) -> DataFrame:
    """``key, value`` of each event. Map values that are null stay in the JSON, null fields don't."""
    fields = [f for f in FIELDS if f in events.columns]
    return events.select(message_key(F.col("table"), F.col("pk")).alias("key"), F.to_json(F.struct(*fields)).alias("value"))


def decode(values: DataFrame, column: str = "value", on_error: str = "fail") -> DataFrame:
    """Events of JSON documents; other columns stay. Malformed ones, and those without op or table or with an unknown op, raise (``fail``),
    go (``drop``) or stay with a column ``error`` (``keep``). Numbers of any length keep their digits."""
    parsed = values.withColumn("__e", F.from_json(column, SCHEMA, {"mode": "PERMISSIVE"}))
    error = (
        F.when(F.coalesce(F.col("__e.op"), F.lit("")) == "", "no op")
        .when(F.coalesce(F.col("__e.table"), F.lit("")) == "", "no table")
        .when(~F.col("__e.op").isin(*OPS), "unknown op")
    )
    out = parsed.withColumn("error", error)
    if on_error == "drop":
        out = out.filter("error IS NULL").drop("error")
    elif on_error == "fail":
        out = out.withColumn("__e", F.when(F.col("error").isNull(), F.col("__e")).otherwise(F.raise_error(F.concat(F.lit("bad event, "), "error", F.lit(": "), F.coalesce(F.col(column), F.lit("null")))))).drop("error")
    more = [c for c in out.columns if c not in ("__e", column)]
    return out.select(*more, *(F.col(f"__e.`{f}`").alias(f) for f in FIELDS))


def canonical_columns(pk: list[str], types: dict[str, str]) -> list[str]:
    """Key columns sorted, then the others sorted."""
    return sorted(pk) + sorted(set(types) - set(pk))


def stage(events: DataFrame, pk: list[str], types: dict[str, str], seq: str = "seq") -> DataFrame:
    """Events of one table as typed changes. A key value comes from ``pk``; a column that ``after`` lacks is null and not present."""
    cols = [c for c in canonical_columns(pk, types) if c not in pk]
    key = [from_text(F.try_element_at("pk", F.lit(c)), types[c]).alias(c) for c in sorted(pk)]
    rest = [F.when(F.col("op") != "d", from_text(F.try_element_at("after", F.lit(c)), types[c])).alias(c) for c in cols]
    return events.select(*key, *rest, cdc(F.col("op"), F.col(seq), F.col("lsn"), F.col("commit_ts"), F.col("unchanged"), F.map_keys("after"), F.col("moved_from") if "moved_from" in events.columns else None))


def batch_shape(events: DataFrame, seq: str = "seq") -> DataFrame:
    """``table, types``: the widest column set of a batch for each table, the first of equals."""
    return events.groupBy("table").agg(F.max_by("types", F.struct(F.size("types"), -F.col(seq))).alias("types"))
