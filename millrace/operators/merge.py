"""Merge: a folded batch into a keyed table.

Matched deletes remove the row, other matched states update it (columns still unchanged keep the row's value), unmatched states other
than deletes insert, unmatched deletes do nothing. Null keys match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.names import col
from millrace.operators.fold import CDC, columns

COMMIT_TS, APPLIED_AT = "_cdc_commit_ts", "_cdc_applied_at"


def widen(table: DataFrame, like: DataFrame) -> DataFrame:
    """``table`` with the columns that ``like`` has besides, null: additive schema evolution."""
    more = [f for f in like.schema.fields if f.name not in table.columns and f.name != CDC]
    return table.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in more)) if more else table


#: Bytes of a batch that is broadcast: well below what an executor holds besides.
SMALL_BYTES = 64 << 20


def is_small(folded: DataFrame, limit: int = SMALL_BYTES) -> bool:
    """Whether a folded batch may be broadcast, by the size of its rows as text. It reads the batch once, so keep that at hand."""
    return (folded.agg(F.sum(F.octet_length(F.to_json(F.struct(*(col(c) for c in folded.columns)))))).first()[0] or 0) <= limit


def merge(target: DataFrame, folded: DataFrame, pk: list[str], applied_at: Column | None = None, small_batch: bool = False, action: str | None = None) -> DataFrame:
    """The table after the batch. With ``applied_at`` it has the two metadata columns, too; ``action`` names a column of what was done.

    One full outer join on the key. ``small_batch`` says that the caller has checked the batch's size (``is_small``): then the batch is broadcast
    instead, once to the rows of the table and once against its keys, and the table isn't shuffled.
    """
    target = widen(target, folded)
    cols = [c for c in target.columns if c not in (*pk, COMMIT_TS, APPLIED_AT)]
    own = set(columns(folded, pk))
    meta = applied_at is not None
    t = target.select(*(col(c).alias(f"__t{i}") for i, c in enumerate([*pk, *cols])), *((F.col(c) if c in target.columns else F.lit(None).cast("timestamp")).alias(f"__t_{c}") for c in (COMMIT_TS, APPLIED_AT)), F.lit(True).alias("__in_t"))
    s = folded.select(*((col(c) if c in own or c in pk else F.lit(None)).alias(f"__s{i}") for i, c in enumerate([*pk, *cols])), F.col(CDC).alias("__cdc"), F.lit(True).alias("__in_s"))
    on = [F.col(f"__t{i}") == F.col(f"__s{i}") for i in range(len(pk))]
    if small_batch:
        s = F.broadcast(s)
        held = t.join(s, on, "left")
        new = s.join(t.select(*(f"__t{i}" for i in range(len(pk)))), on, "left_anti")  # the table streams past the batch's keys
        both = held.unionByName(new, allowMissingColumns=True)
    else:
        both = t.join(s, on, "full_outer")
    in_t, in_s = F.col("__in_t").isNotNull(), F.col("__in_s").isNotNull()
    both = both.filter(~in_s | (F.col("__cdc.op") != "d"))
    out = []
    for i, c in enumerate([*pk, *cols]):
        old, new = F.col(f"__t{i}"), F.col(f"__s{i}")
        if i >= len(pk):
            kept = F.array_contains("__cdc.unchanged", c) if c in own else F.lit(True)
            new = F.when(in_t & kept, old).otherwise(new)
        out.append(F.when(in_s, new).otherwise(old).alias(c))
    if meta or COMMIT_TS in target.columns:
        out.append(F.when(in_s, F.col("__cdc.commit_ts")).otherwise(F.col(f"__t_{COMMIT_TS}")).alias(COMMIT_TS))
        out.append(F.when(in_s, applied_at if meta else F.lit(None).cast("timestamp")).otherwise(F.col(f"__t_{APPLIED_AT}")).alias(APPLIED_AT))
    if action:
        out.append(F.when(~in_s, "keep").when(in_t, "update").otherwise("insert").alias(action))
    return both.select(*out)


def classify(target: DataFrame, folded: DataFrame, pk: list[str]) -> DataFrame:
    """What a merge does for each key of the batch: ``insert``, ``update``, ``delete`` or ``nothing`` (a delete without a row)."""
    keys = target.select(*(col(k).alias(f"__t{i}") for i, k in enumerate(pk)), F.lit(True).alias("__in_t"))
    joined = folded.join(keys, [col(k) == F.col(f"__t{i}") for i, k in enumerate(pk)], "left")
    gone, found = F.col(f"{CDC}.op") == "d", F.col("__in_t").isNotNull()
    return joined.select(*(col(k) for k in pk), F.when(gone & found, "delete").when(gone, "nothing").when(found, "update").otherwise("insert").alias("action"))
