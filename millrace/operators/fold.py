"""Fold: the ordered changes of a batch to one final state for each key.

A change is a row with the key columns, the other columns and a struct ``_cdc`` (op, seq, lsn, commit_ts, unchanged, present). The
struct keeps user columns free of names. ``unchanged`` lists columns that an update didn't carry; ``present`` the columns it did (null:
all others); ``moved_from`` is the old key of a row whose key changed. The rule needs no sequential pass. Let L be a key's last change. For each column let E be the last change that is not a
delete and has the column not unchanged. The column's value is E's, if E comes after the last delete; it is unknown (still unchanged)
if there is no such E, or if E lacks the column and isn't L. So one pre-aggregated grouping by key does it, and a key with very many
changes is reduced before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.names import col, quoted

CDC = "_cdc"


def cdc(op: Column, seq: Column, lsn: Column | None = None, commit_ts: Column | None = None, unchanged: Column | None = None, present: Column | None = None, moved_from: Column | None = None) -> Column:
    """The bookkeeping struct of a change."""
    none = F.lit(None)
    return F.struct(
        op.cast("string").alias("op"),
        seq.cast("bigint").alias("seq"),
        (none if lsn is None else lsn).cast("decimal(20,0)").alias("lsn"),
        (none if commit_ts is None else commit_ts).cast("timestamp").alias("commit_ts"),
        F.coalesce((none if unchanged is None else unchanged).cast("array<string>"), F.array().cast("array<string>")).alias("unchanged"),
        (none if present is None else present).cast("array<string>").alias("present"),
        (none if moved_from is None else moved_from).cast("map<string,string>").alias("moved_from"),
    ).alias(CDC)


def columns(changes: DataFrame, pk: list[str]) -> list[str]:
    return [c for c in changes.columns if c not in pk and c != CDC]


def fold(changes: DataFrame, pk: list[str]) -> DataFrame:
    """One row for each key, with the shape of ``changes``. Ties in ``seq`` are not legal. An empty batch folds to nothing."""
    cols = columns(changes, pk)
    op, seq = F.col(f"{CDC}.op"), F.col(f"{CDC}.seq")
    live = op != "d"

    def last(c: str) -> Column:
        known = live & ~F.array_contains(F.coalesce(f"{CDC}.unchanged", F.array().cast("array<string>")), c)
        has = F.col(f"{CDC}.present").isNull() | F.array_contains(f"{CDC}.present", c)
        return F.max_by(F.struct(col(c).alias("v"), F.coalesce(has, F.lit(True)).alias("has"), seq.alias("seq")), F.when(known, seq))

    grouped = changes.groupBy(*(col(k) for k in pk)).agg(
        F.max_by(CDC, seq).alias("__last"),
        F.max(F.when(~live, seq)).alias("__deleted"),
        *(last(c).alias(f"__e{i}") for i, c in enumerate(cols)),
    )
    out, unknown = [], []
    for i, c in enumerate(cols):
        e = F.col(f"__e{i}")
        known = F.coalesce(e["seq"].isNotNull() & (e["seq"] > F.coalesce("__deleted", F.lit(-(1 << 63)))) & (e["has"] | (e["seq"] == F.col("__last.seq"))), F.lit(False))
        gone = F.col("__last.op") == "d"
        out.append(F.when(known & ~gone & e["has"], e["v"]).alias(c))
        unknown.append(F.when(~known & ~gone, F.lit(c)))
    unchanged = F.array_compact(F.array(*unknown)) if unknown else F.array().cast("array<string>")
    state = cdc(F.col("__last.op"), F.col("__last.seq"), F.col("__last.lsn"), F.col("__last.commit_ts"), unchanged)
    return grouped.select(*(col(k) for k in pk), *out, state)


def materialize(folded: DataFrame) -> DataFrame:
    """The rows that are left when a fold is the whole history."""
    return folded.filter(F.col(f"{CDC}.op") != "d").drop(CDC)


def as_snapshot(table: DataFrame, seq: int = -(1 << 62), commit_ts: Column | None = None) -> DataFrame:
    """A table as a changelog of ``r`` rows, before all other changes."""
    return table.select("*", cdc(F.lit("r"), F.lit(seq), F.lit(0), commit_ts))


def _open(changes: DataFrame) -> Column:
    """Inserts after a change of key that still lack values."""
    return (F.col(f"{CDC}.op") == "c") & F.col(f"{CDC}.moved_from").isNotNull() & (F.size(f"{CDC}.unchanged") > 0)


def carry(changes: DataFrame, target: DataFrame | None, pk: list[str]) -> DataFrame:
    """Fill what an insert after a change of key left unchanged from the old key's row, as it was just before.

    That row's history is the table's row and the batch's earlier changes of the old key. A key that changed again and again takes a step for
    each change, until nothing more is found; what isn't found stays unchanged. A batch without such inserts costs one pass over it.
    """

    def missing(df: DataFrame) -> int:
        return df.filter(_open(df)).agg(F.coalesce(F.sum(F.size(f"{CDC}.unchanged")), F.lit(0))).first()[0]

    left = missing(changes)
    while left:
        now = _carry_step(changes, target, pk).persist()
        still = missing(now)
        if still == left:
            now.unpersist()
            break
        left, changes = still, now
    return changes


def _carry_step(changes: DataFrame, target: DataFrame | None, pk: list[str]) -> DataFrame:
    """One step back for every such insert, by the text of the key; of the table only the asked rows are joined."""
    cols = columns(changes, pk)
    moved = changes.filter(_open(changes))
    old = F.array(*(F.try_element_at(F.col(f"{CDC}.moved_from"), F.lit(k)) for k in pk))
    ids = [f"__m{i}" for i in range(len(pk))]
    asked = moved.select(*(col(k).alias(i) for k, i in zip(pk, ids, strict=True)), F.col(f"{CDC}.seq").alias("__mseq"), old.alias("__old"))
    here = F.array(*(col(k).cast("string") for k in pk))
    known = changes.withColumn("__key", here)
    if target is not None:
        rows = target.select(*(col(c) for c in [*pk, *cols] if c in target.columns)).withColumn("__key", here)
        asked_rows = rows.join(asked.select(F.col("__old").alias("__key")).distinct(), "__key", "left_semi")
        known = known.unionByName(as_snapshot(asked_rows), allowMissingColumns=True)
    seq = F.col(f"{CDC}.seq")
    past = known.join(asked, (F.col("__key") == F.col("__old")) & (seq < F.col("__mseq")) & ~((F.col(f"{CDC}.op") == "d") & (seq == F.col("__mseq") - 1)))
    state = fold(past.select(*ids, "__mseq", *(col(c) for c in cols), CDC), [*ids, "__mseq"])
    found = state.filter(F.col(f"{CDC}.op") != "d").select(*ids, "__mseq", F.struct(*(col(c) for c in cols)).alias("__v"), F.col(f"{CDC}.unchanged").alias("__still"))
    rows = changes.join(found, [*(col(k) == F.col(i) for k, i in zip(pk, ids, strict=True)), seq == F.col("__mseq")], "left")
    open_ = F.col(f"{CDC}.unchanged")
    filled = F.when(F.col("__v").isNotNull(), F.array_except(open_, F.col("__still"))).otherwise(F.array().cast("array<string>"))
    out = [F.when(F.array_contains(filled, c), F.col(f"__v.{quoted(c)}")).otherwise(col(c)).alias(c) for c in cols]
    present = F.when(F.col(f"{CDC}.present").isNotNull(), F.array_union(f"{CDC}.present", filled))
    book = cdc(F.col(f"{CDC}.op"), seq, F.col(f"{CDC}.lsn"), F.col(f"{CDC}.commit_ts"), F.array_except(open_, filled), present, F.col(f"{CDC}.moved_from"))
    return rows.select(*(col(k) for k in pk), *out, book)
