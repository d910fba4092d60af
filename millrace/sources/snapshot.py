"""Snapshots (backfill): rows of a table as ``r`` events on the same path as live changes, and its catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Type name of a Spark type in events.
NAMES = {"boolean": "boolean", "bigint": "bigint", "smallint": "smallint", "int": "integer", "float": "real", "double": "double precision", "date": "date", "timestamp_ntz": "timestamp", "timestamp": "timestamptz"}


def event_types(df: DataFrame) -> dict[str, str]:
    return {n: "numeric" if t.startswith("decimal") else NAMES.get(t, "text") for n, t in df.dtypes}


def events(df: DataFrame, table: str, pk: list[str], started: Column) -> DataFrame:
    """Each row with all its values as text; position 0 and one start time for all. Tables need a schema in their name and a key."""
    if "." not in table:
        raise ValueError(f"table {table!r} has no schema")
    if not pk:
        raise ValueError(f"table {table!r} has no key")
    types = event_types(df)

    def as_map(names: list[str], values: list[Column]) -> Column:
        return F.map_from_arrays(F.array(*(F.lit(n) for n in names)), F.array(*values))

    text = {c: F.col(f"`{c}`").cast("string") for c in df.columns}
    return df.select(
        F.lit("r").alias("op"), F.lit(table).alias("table"), F.lit(0).cast("decimal(20,0)").alias("lsn"), started.cast("timestamp").alias("commit_ts"),
        as_map(pk, [text[c] for c in pk]).alias("pk"), as_map(df.columns, list(text.values())).alias("after"), F.array().cast("array<string>").alias("unchanged"),
        as_map(list(types), [F.lit(t) for t in types.values()]).alias("types"),
    )


def read(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The snapshot's rows: Parquet splits are read in parallel; only the columns asked for."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def catalog(attributes: DataFrame, indexes: DataFrame) -> DataFrame:
    """``table, column, type, is_key, place`` from attribute rows (table, num, column, type, dropped) and primary indexes (table, keys):
    key columns first, both parts in order of name. Dropped columns and system columns (num below 1) go."""
    live = attributes.filter("num > 0 AND NOT dropped")
    keyed = live.join(indexes.select(F.col("table").alias("__t"), "keys"), F.col("table") == F.col("__t"), "left")
    is_key = F.coalesce(F.array_contains("keys", F.col("num")), F.lit(False))
    rows = keyed.select("table", "column", "type", is_key.alias("is_key"))
    return rows.selectExpr("*", "row_number() OVER (PARTITION BY table ORDER BY NOT is_key, column) AS place")


def published(publications: DataFrame, name: str) -> DataFrame:
    """``table``: the tables of a publication, with their schema, from rows (publication, schema, table). In order where they are listed."""
    return publications.filter(F.col("publication") == name).select(F.concat_ws(".", "schema", "table").alias("table")).distinct()


def key_columns(attributes: DataFrame, indexes: DataFrame) -> DataFrame:
    """``table, column, place``: the key columns of each table in the order of its primary index, from rows as for ``catalog``."""
    joined = attributes.join(indexes.select(F.col("table").alias("__t"), "keys"), (F.col("table") == F.col("__t")) & F.array_contains("keys", F.col("num")))
    return joined.filter("num > 0 AND NOT dropped").select("table", "column", F.array_position("keys", F.col("num")).alias("place"))


def shape(attributes: DataFrame, indexes: DataFrame) -> DataFrame:
    """``table, pk, columns``: key columns in the order of the index, and the others in order of name."""
    keys = key_columns(attributes, indexes).groupBy("table").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "column"))), lambda x: x["column"]).alias("pk"))
    live = attributes.filter("num > 0 AND NOT dropped").groupBy("table").agg(F.array_sort(F.collect_list("column")).alias("all"))
    return keys.join(live, "table").select("table", "pk", F.array_except("all", "pk").alias("columns"))
