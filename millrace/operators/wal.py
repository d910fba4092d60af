"""Write-ahead-log messages to change events.

A message has a position ``pos``, a ``kind`` (R relation, B begin, I insert, U update, D delete, C commit; others are ignored), a
relation id, and for rows the ``new`` and ``old`` tuples: arrays of (kind, data), kind ``t`` text, ``n`` null, ``u`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from millrace.functions.types import type_name

TUPLE = "array<struct<kind: string, data: string>>"
MESSAGE = f"pos bigint, kind string, rel_id int, `table` string, columns array<struct<name: string, oid: int, is_key: boolean>>, lsn decimal(20,0), commit_ts timestamp, new {TUPLE}, old {TUPLE}"


#: Positions of a segment: a segment has as many rows at most. And segments that are carried over in one window.
SEGMENT, FAN = 1 << 14, 1 << 12


def _so_far(*partition: str, order: str) -> WindowSpec:
    return Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def _from_here(*partition: str, order: str) -> WindowSpec:
    """From a row to the end, as a running frame over the reverse order: a frame that ends at the last row would be summed anew for each row."""
    return Window.partitionBy(*partition).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)


def _carried(summary: DataFrame, fan: int) -> DataFrame:
    """For each segment (seg, b, c) the last ``b`` of the segments before it and the first ``c`` of those behind it. Windows run over ``fan``
    segments at most, and one over a row for each ``fan`` segments."""
    s = summary.withColumn("up", F.floor(F.col("seg") / fan))
    near = s.select(
        "seg", "up",
        F.last("b", True).over(Window.partitionBy("up").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)).alias("b1"),
        F.last("c", True).over(Window.partitionBy("up").orderBy(F.desc("seg")).rowsBetween(Window.unboundedPreceding, -1)).alias("c1"),
    )
    far = s.groupBy("up").agg(F.max("b").alias("b"), F.min("c").alias("c")).select(
        F.col("up").alias("far"),
        F.last("b", True).over(Window.orderBy("up").rowsBetween(Window.unboundedPreceding, -1)).alias("b2"),
        F.last("c", True).over(Window.orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)).alias("c2"),
    )
    joined = near.join(far, F.col("up") == F.col("far"))
    return joined.select(F.col("seg").alias("__seg"), F.coalesce("b1", "b2").alias("__cb"), F.coalesce("c1", "c2").alias("__cc"))


def assemble(wal: DataFrame, segment: int = SEGMENT, fan: int = FAN) -> DataFrame:
    """Row messages of committed transactions with ``txn`` (position of the begin), ``lsn`` and ``commit_ts`` of the commit.

    A row is committed if the next begin or commit behind it is a commit. The log is scanned in segments of positions: each on its own,
    and what stands open at a border comes from one summary row for each segment.
    """
    control = F.when(F.col("kind").isin("B", "C"), F.struct("pos", "kind", "lsn", "commit_ts"))
    begin = F.when(F.col("kind") == "B", F.col("pos"))
    m = wal.withColumn("seg", F.floor(F.col("pos") / segment))
    here = m.withColumn("__b", F.last(begin, True).over(_so_far("seg", order="pos"))).withColumn("__c", F.last(control, True).over(_from_here("seg", order="pos"))).filter(F.col("kind").isin("I", "U", "D"))
    summary = m.groupBy("seg").agg(F.max(begin).alias("b"), F.min(control).alias("c"))
    full = here.join(_carried(summary, fan), F.col("seg") == F.col("__seg"))
    full = full.withColumn("txn", F.coalesce("__b", "__cb")).withColumn("__end", F.coalesce("__c", "__cc"))
    done = full.filter((F.col("__end.kind") == "C") & F.col("txn").isNotNull())
    return done.withColumn("lsn", F.col("__end.lsn")).withColumn("commit_ts", F.col("__end.commit_ts")).drop("__b", "__c", "__cb", "__cc", "__seg", "__end", "seg")


def still_open(wal: DataFrame) -> DataFrame:
    """Messages that later ones can still need: all after the last commit, the last begin, and of each relation the version of then."""
    ends = wal.agg(F.max(F.when(F.col("kind") == "C", F.col("pos"))).alias("c"), F.max(F.when(F.col("kind") == "B", F.col("pos"))).alias("b")).first()
    done = F.lit(ends["c"]).cast("long")
    late = done.isNull() | (F.col("pos") > done)
    version = F.max(F.when(~late, F.col("pos"))).over(Window.partitionBy("rel_id"))
    relations = wal.filter("kind = 'R'").withColumn("__version", version).filter(late | (F.col("pos") == F.col("__version"))).drop("__version").dropDuplicates(["rel_id", "pos"])
    rest = wal.filter((F.col("kind").isin("I", "U", "D") & late) | ((F.col("kind") == "B") & (late | F.col("pos").eqNullSafe(F.lit(ends["b"]).cast("long")))))
    return relations.unionByName(rest)


def with_relation(rows: DataFrame, wal: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Each row message with the latest earlier relation of its id (``rel``) and its number (``version``); none is an error.

    A running last over relations and rows together, by relation id and segment; what stands at a segment's border comes from one row for
    each id and segment. So a busy table is dealt over tasks, and many versions of a relation cost no more than few.
    """
    known = wal.filter("kind = 'R'").select("rel_id", "pos", F.struct("table", "columns", F.row_number().over(Window.partitionBy("rel_id").orderBy("pos")).alias("version")).alias("__rel"))
    both = rows.drop("table", "columns").withColumn("__row", F.lit(True)).unionByName(known, allowMissingColumns=True).withColumn("__seg", F.floor(F.col("pos") / segment))
    seen = both.withColumn("__here", F.last("__rel", True).over(_so_far("rel_id", "__seg", order="pos")))
    ends = both.groupBy("rel_id", "__seg").agg(F.max(F.when(F.col("__rel").isNotNull(), F.struct("pos", "__rel"))).getField("__rel").alias("__last"))
    before = ends.select(
        F.col("rel_id").alias("__id"), F.col("__seg").alias("__s"), F.last("__last", True).over(Window.partitionBy("rel_id").orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)).alias("__before")
    )
    out = seen.filter("__row").join(before, F.col("rel_id").eqNullSafe(F.col("__id")) & (F.col("__seg") == F.col("__s")), "left")
    lost = F.raise_error(F.concat(F.lit("unknown relation id "), F.coalesce(F.col("rel_id").cast("string"), F.lit("null"))))
    rel = F.coalesce("__here", "__before")
    found = out.withColumn("rel", F.when(rel.isNotNull(), rel).otherwise(lost))
    return found.withColumn("version", F.col("rel.version")).drop("__row", "__rel", "__here", "__last", "__before", "__id", "__s", "__seg")


def _check(bad: Column, text: str, value: Column) -> Column:
    return F.when(bad, F.raise_error(F.lit(text))).otherwise(value)


def decode(rows: DataFrame, split_keys: bool = True) -> DataFrame:
    """Change events of row messages with ``rel``: op, table, lsn, commit_ts, pk, after, unchanged, types, seq, moved_from.

    Raises on: tuples of another length than the relation, unchanged values in an insert, relations without a key, deletes without
    an old tuple, unknown kinds. An update that changes the key becomes a delete of the old and an insert of the new (``split_keys``).
    """
    cols, new, old, kind = F.col("rel.columns"), F.col("new"), F.col("old"), F.col("kind")

    def zipped(t: Column) -> Column:
        return F.transform(F.arrays_zip(cols.alias("c"), t.alias("t")), lambda z: F.struct(z["c"]["name"].alias("name"), z["c"]["is_key"].alias("is_key"), z["t"]["kind"].alias("kind"), z["t"]["data"].alias("data")))

    def entries(z: Column) -> Column:
        return F.map_from_entries(F.transform(z, lambda x: F.struct(x["name"].alias("key"), F.when(x["kind"] == "t", x["data"]).alias("value"))))

    new_z, old_z = F.col("__new"), F.col("__old")
    used = F.when(kind == "D", old).otherwise(new)
    arity = (used.isNotNull() & (F.size(used) != F.size(cols))) | (old.isNotNull() & (F.size(old) != F.size(cols)))
    checked = rows.withColumn(
        "rel",
        _check(~F.exists(cols, lambda c: c["is_key"]), "relation has no key",
        _check((kind == "D") & old.isNull(), "delete without old tuple",
        _check(arity, "tuple and relation differ in length",
        _check(F.exists(F.coalesce(used, F.array().cast(TUPLE)), lambda x: ~x["kind"].isin("t", "n", "u")), "unknown kind of tuple value",
        _check((kind == "I") & F.exists(F.coalesce(new, F.array().cast(TUPLE)), lambda x: x["kind"] == "u"), "unchanged value in an insert", F.col("rel")))))),
    )
    z = checked.withColumn("__new", F.when(kind != "D", zipped(new))).withColumn("__old", F.when(old.isNotNull(), zipped(old)))
    keys = lambda x: F.filter(x, lambda v: v["is_key"])
    present = lambda x: F.filter(x, lambda v: v["kind"] != "u")
    pk_new, pk_old = entries(keys(new_z)), entries(keys(old_z))
    moved = (kind == "U") & old.isNotNull() & (F.to_json(pk_old) != F.to_json(pk_new))
    unchanged = F.transform(F.filter(new_z, lambda v: v["kind"] == "u"), lambda v: v["name"])
    nothing = F.lit(None)
    map_t, list_t = "map<string,string>", "array<string>"

    def event(op: Column, pk: Column, after: Column, kept: Column, sub: int, moved_from: Column) -> Column:
        return F.struct(op.alias("op"), pk.cast(map_t).alias("pk"), after.cast(map_t).alias("after"), kept.cast(list_t).alias("unchanged"), F.lit(sub).alias("sub"), moved_from.cast(map_t).alias("moved_from"))

    delete = event(F.lit("d"), pk_old, nothing, nothing, 0, nothing)
    plain = event(F.when(kind == "I", "c").otherwise("u"), pk_new, entries(present(new_z)), unchanged, 1, nothing)
    insert = event(F.lit("c"), pk_new, entries(present(new_z)), unchanged, 1, pk_old)
    events = F.when(kind == "D", F.array(delete)).when(moved & F.lit(split_keys), F.array(delete, insert)).otherwise(F.array(plain))
    types = F.map_from_entries(F.transform(cols, lambda c: F.struct(c["name"].alias("key"), type_name(c["oid"]).alias("value"))))
    out = z.withColumn("types", types).withColumn("e", F.explode(events))
    return out.select(
        F.col("e.op").alias("op"), F.col("rel.table").alias("table"), "lsn", "commit_ts", F.col("e.pk").alias("pk"), F.col("e.after").alias("after"), F.coalesce("e.unchanged", F.array().cast(list_t)).alias("unchanged"), "types", (2 * F.col("pos") + F.col("e.sub")).alias("seq"), "txn", F.col("e.moved_from").alias("moved_from"),
    )



def events(wal: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """All change events of committed transactions."""
    return decode(with_relation(assemble(wal, segment), wal, segment))
