"""Types of the source database and how their text becomes Spark values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Object ids of the source's built-in types, and their names. Any other id is text.
TYPE_NAMES = {
    16: "boolean",
    20: "bigint",
    21: "smallint",
    23: "integer",
    25: "text",
    700: "real",
    701: "double precision",
    1042: "text",
    1043: "text",
    1082: "date",
    1114: "timestamp",
    1184: "timestamptz",
    1700: "numeric",
    2950: "uuid",
    3802: "jsonb",
}
#: Spark type of a type name; numeric without a declared precision and types without a Spark counterpart stay text.
SPARK_TYPES = {
    "boolean": "boolean",
    "bigint": "bigint",
    "smallint": "smallint",
    "integer": "int",
    "real": "float",
    "double precision": "double",
    "date": "date",
    "timestamp": "timestamp_ntz",
    "timestamptz": "timestamp",
}


def type_name(oid: Column) -> Column:
    """Type name of an object id, ``text`` for any unknown one (enums and the like: right as data, lossy as DDL)."""
    known = F.create_map(*(F.lit(x) for pair in TYPE_NAMES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, oid), F.lit("text"))


def dest_type(name: Column) -> Column:
    """Type of the destination column: the name itself if it is a known one, else ``text``."""
    return F.when(name.isin(sorted(set(TYPE_NAMES.values()))), name).otherwise(F.lit("text"))


def spark_type(name: str, precision: tuple[int, int] | None = None) -> str:
    if name == "numeric" and precision:
        return f"decimal({precision[0]},{precision[1]})"
    return SPARK_TYPES.get(name, "string")


def from_text(text: Column, name: str, precision: tuple[int, int] | None = None) -> Column:
    """Value of a text. Malformed numbers raise; booleans may be ``t``/``f`` (live changes) or ``true``/``false`` (snapshots)."""
    return text.cast(spark_type(name, precision))
