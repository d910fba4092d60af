"""Verification: a count and a digest of a table, and what differs between two.

The digest doesn't depend on partitioning and never gathers a table in one task: rows are hashed, their hashes strung together in key
order in chunks (by the first hex digits of the key's MD5), and the chunks' digests strung together in turn, level by level.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.digest import key_text, row_text
from millrace.functions.names import col


#: Rows of a chunk, about, and hex digits of a level: 256 chunks make one of the level above.
CHUNK_ROWS, LEVEL = 1 << 16, 2


def _digits(n: int) -> int:
    """Digits of the finest chunks of a table of so many rows: a multiple of a level."""
    digits = LEVEL
    while n > CHUNK_ROWS * 16**digits:
        digits += LEVEL
    return digits


def checksum(df: DataFrame, pk: list[str], digits: int | None = None) -> DataFrame:
    """One row: ``count, digest``; an empty table has 0 and the empty string. The finest chunks have ``digits`` hex digits of the key's MD5, as
    many as the number of rows asks for; level by level, 256 digests make one. So no group has more than a chunk's rows."""
    finest = _digits(df.count()) if digits is None else digits
    cols = [*pk, *sorted(c for c in df.columns if c not in pk)]
    key = key_text(df, pk)
    rows = df.select(key.alias("k"), F.substring(F.md5(key.cast("binary")), 1, finest).alias("chunk"), F.md5(row_text(df, cols).cast("binary")).alias("h"))

    def strung(of: str, by: str) -> Column:
        """Digests in order of a column, strung together."""
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, of))), lambda x: x[of]), "")

    level = rows.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.md5(strung("h", "k").cast("binary")).alias("d"))
    for have in range(finest - LEVEL, 0, -LEVEL):
        level = level.groupBy(F.substring("chunk", 1, have).alias("up")).agg(F.sum("n").alias("n"), F.md5(strung("d", "chunk").cast("binary")).alias("d")).withColumnRenamed("up", "chunk")
    total = level.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("count"), strung("d", "chunk").alias("all"))
    return total.select("count", F.when(F.col("count") > 0, F.md5(F.col("all").cast("binary"))).otherwise("").alias("digest"))


def compare(source: dict[str, DataFrame], copy: dict[str, DataFrame], keys: dict[str, list[str]]) -> DataFrame:
    """``table, source_count, copy_count, source_digest, copy_digest, match`` of each published table; one without a copy doesn't match."""
    if not source:
        raise ValueError("no tables are published")
    out = None
    for name in sorted(source):
        a = checksum(source[name], keys[name]).select(F.lit(name).alias("table"), F.col("count").alias("source_count"), F.col("digest").alias("source_digest"))
        if name in copy:
            b = checksum(copy[name], keys[name]).select(F.lit(name).alias("table"), F.col("count").alias("copy_count"), F.col("digest").alias("copy_digest"))
        else:
            b = source[name].sparkSession.createDataFrame([], "table string, copy_count long, copy_digest string")
        row = a.join(b, "table", "left").select("table", "source_count", "copy_count", "source_digest", "copy_digest", (F.col("source_count").eqNullSafe(F.col("copy_count")) & F.col("source_digest").eqNullSafe(F.col("copy_digest"))).alias("match"))
        out = row if out is None else out.unionByName(row)
    return out


def report(compared: DataFrame) -> DataFrame:
    """One line for each table, digests in eight characters."""
    side = lambda s: F.concat_ws(" ", F.coalesce(F.col(f"{s}_count").cast("string"), F.lit("-")), F.substring(F.coalesce(f"{s}_digest", F.lit("-")), 1, 8))
    return compared.select("table", F.concat(F.when(F.col("match"), "MATCH ").otherwise("MISMATCH "), F.col("table"), F.lit(": "), side("source"), F.lit(" / "), side("copy")).alias("line"))


def row_diff(source: DataFrame, copy: DataFrame, pk: list[str]) -> DataFrame:
    """Keys that differ: ``missing`` in the copy, ``extra`` there, or ``changed``."""
    cols = [*pk, *sorted(c for c in source.columns if c not in pk)]
    a = source.select(*(col(k).alias(f"__a{i}") for i, k in enumerate(pk)), F.md5(row_text(source, cols).cast("binary")).alias("__ha"))
    b = copy.select(*(col(k).alias(f"__b{i}") for i, k in enumerate(pk)), F.md5(row_text(copy, cols).cast("binary")).alias("__hb"))
    joined = a.join(b, [F.col(f"__a{i}") == F.col(f"__b{i}") for i in range(len(pk))], "full_outer")
    kind = F.when(F.col("__hb").isNull(), "missing").when(F.col("__ha").isNull(), "extra").when(F.col("__ha") != F.col("__hb"), "changed")
    return joined.select(*(F.coalesce(f"__a{i}", f"__b{i}").alias(k) for i, k in enumerate(pk)), kind.alias("diff")).filter("diff IS NOT NULL")


def converge(spark: SparkSession, tables: Callable[[], tuple[dict, dict]], keys: dict[str, list[str]], timeout: float = 30.0, pause: float = 2.0) -> DataFrame:
    """Compare again and again until all match; raises with the report when time is over."""
    end = time.time() + timeout
    while True:
        rows = compare(*tables(), keys).collect()
        out = spark.createDataFrame(rows, "table string, source_count long, copy_count long, source_digest string, copy_digest string, match boolean")
        if all(r["match"] for r in rows):
            return out
        if time.time() >= end:
            raise TimeoutError("; ".join(r["line"] for r in report(out).collect()))
        time.sleep(pause)
