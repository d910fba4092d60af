"""Canonical text of a row, and digests that don't depend on how a table is partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.names import col


def field_text(df: DataFrame, name: str) -> Column:
    """Text of a value: null is ``\\N``; backslash and bar are escaped; doubles are written with six decimals."""
    kind = dict(df.dtypes)[name]
    c = col(name)
    if kind in ("double", "float"):
        c = F.when(F.isnan(c), F.lit("NaN")).otherwise(F.coalesce(c.try_cast("decimal(38,6)").cast("string"), c.cast("string")))
    else:
        c = c.cast("string")
    return F.coalesce(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\\N"))


def row_text(df: DataFrame, cols: list[str]) -> Column:
    return F.concat_ws("|", *(field_text(df, c) for c in cols))


def key_text(df: DataFrame, pk: list[str]) -> Column:
    return F.concat_ws("|", *(field_text(df, c) for c in pk))
