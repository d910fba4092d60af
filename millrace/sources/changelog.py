"""Deterministic changelogs made of the test tables: legal streams for folds, merges and the log decoder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.fold import cdc
from millrace.operators.wal import TUPLE

#: Iterations of the load generator in one task: about 80 MB of notes.
ITERATIONS = 8192


def _steps(*steps: tuple) -> Column:
    """Operations of a row, as an array of (sub, op, on)."""
    return F.array(*(F.struct(F.lit(sub).alias("sub"), F.lit(op).alias("op"), F.coalesce(on, F.lit(False)).alias("on")) for sub, op, on in steps))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chg_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of users: an error deletes, the next event creates again, views don't carry ``props``."""
    prev = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    e = table(spark, sf_dir, "events").withColumn("prev", prev)
    fresh = F.col("prev").isNull() | (F.col("prev") == "error")
    e = e.filter(~((F.col("event_type") == "error") & fresh))
    op = F.when(F.col("event_type") == "error", "d").when(fresh, "c").otherwise("u")
    kept = F.when((op == "u") & (F.col("event_type") == "view"), F.array(F.lit("props"))).otherwise(F.array().cast("array<string>"))
    return e.select("user_id", "event_type", "value", F.when(F.size(kept) == 0, F.col("props")).alias("props"), cdc(op, F.col("event_id"), F.col("event_id"), F.col("ts"), kept))


def chg_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_shipdate", "l_partkey", "l_suppkey")
    li = table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(w))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", cdc(F.lit("r"), F.col("n")))


def orders_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order changes with a sub-sequence: snapshot, update without priority, delete, insert again, change of key."""
    k = F.col("o_orderkey")
    ops = _steps((0, "r", F.lit(True)), (1, "u", k % 3 == 0), (2, "d", k % 7 == 0), (3, "c", k % 21 == 0), (4, "k", (k % 11 == 0) & (k % 7 != 0)))
    return table(spark, sf_dir, "orders").withColumn("x", F.explode(ops)).filter("x.on")


def chg_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as legal changes: a change of key is a delete of the old and an insert of the new one."""
    o = orders_parts(spark, sf_dir)
    part = lambda op, add, n: F.struct(op.alias("op"), F.lit(add).alias("add"), n.alias("n"))
    moved = F.array(part(F.lit("d"), 0, F.lit(4)), part(F.lit("c"), 10_000_000, F.lit(5)))
    twice = F.when(F.col("x.op") == "k", moved).otherwise(F.array(part(F.col("x.op"), 0, F.col("x.sub"))))
    o = o.withColumn("y", F.explode(twice))
    kept = F.when(F.col("y.op") == "u", F.array(F.lit("o_orderpriority"))).otherwise(F.array().cast("array<string>"))
    return o.select(
        (F.col("o_orderkey") + F.col("y.add")).alias("o_orderkey"), "o_custkey", F.when(F.col("y.op") == "u", "F").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(F.col("y.op") != "u", F.col("o_orderpriority")).alias("o_orderpriority"), cdc(F.col("y.op"), F.col("y.n"), None, None, kept),
    )


def chg_moved_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eleventh order moves by ten million twice, each time as a delete and an insert that doesn't have the priority again."""
    move = lambda step, op: F.struct(F.lit(2 * step + (op == "c")).alias("seq"), F.lit(op).alias("op"), F.lit(10_000_000 * (step + (op == "c"))).alias("add"), (F.lit(10_000_000 * step) if op == "c" else F.lit(None).cast("int")).alias("was"))
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 11 = 0").withColumn("x", F.explode(F.array(*(move(step, op) for step in (0, 1) for op in "dc"))))
    kept = F.when(F.col("x.op") == "c", F.array(F.lit("o_orderpriority"))).otherwise(F.array().cast("array<string>"))
    was = F.when(F.col("x.op") == "c", F.create_map(F.lit("o_orderkey"), (F.col("o_orderkey") + F.col("x.was")).cast("string")))
    status = F.when(F.col("x.op") == "c", F.concat("o_orderstatus", F.lit("/"), F.col("x.seq")))
    return o.select((F.col("o_orderkey") + F.col("x.add")).alias("o_orderkey"), status.alias("o_orderstatus"), F.lit(None).cast("string").alias("o_orderpriority"), cdc(F.col("x.op"), F.col("x.seq"), None, None, kept, None, was))


def chg_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot, an update that leaves long texts unchanged, deletes."""
    d = F.col("doc_id")
    ops = _steps((0, "r", F.lit(True)), (1, "u", d % 2 == 0), (2, "d", d % 5 == 0))
    x = table(spark, sf_dir, "documents").withColumn("x", F.explode(ops)).filter("x.on")
    kept = F.when((F.col("x.op") == "u") & (F.col("n_chars") > 2000), F.array(F.lit("text"))).otherwise(F.array().cast("array<string>"))
    return x.select("doc_id", F.when(F.size(kept) == 0, F.col("text")).alias("text"), F.when(F.col("x.op") == "u", "updated").otherwise(F.col("source")).alias("source"), cdc(F.col("x.op"), F.col("x.sub"), None, None, kept))


def wal_msgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of inserts: five events a transaction, every thirteenth never committed, a second schema version half way."""
    e = table(spark, sf_dir, "events").withColumn("txn", F.floor(F.col("event_id") / 5).cast("long"))
    half = F.floor((F.lit(e.agg(F.max("txn")).first()[0]) + 1) / 2).cast("long")
    none = lambda t: F.lit(None).cast(t)

    def message(df: DataFrame, pos, kind, columns=None, lsn=None, ts=None, new=None) -> DataFrame:
        cols = "array<struct<name: string, oid: int, is_key: boolean>>"
        return df.select(
            pos.cast("long").alias("pos"), F.lit(kind).alias("kind"), F.lit(1).alias("rel_id"), F.lit("public.events").alias("table"), (none(cols) if columns is None else columns.cast(cols)).alias("columns"),
            (none("int") if lsn is None else lsn).cast("decimal(20,0)").alias("lsn"), (none("timestamp") if ts is None else ts).cast("timestamp").alias("commit_ts"), (none(TUPLE) if new is None else new.cast(TUPLE)).alias("new"), none(TUPLE).alias("old"),
        )

    def col(name: str, oid: int, key: bool = False):
        return F.struct(F.lit(name).alias("name"), F.lit(oid).alias("oid"), F.lit(key).alias("is_key"))

    v1 = [col("event_id", 20, True), col("user_id", 20), col("event_type", 25), col("value", 701)]
    one = spark.range(1)
    position = F.col("txn") * 10 + 1 + F.col("event_id") % 5
    text = lambda c: F.struct(F.when(F.col(c).isNull(), "n").otherwise("t").alias("kind"), F.col(c).cast("string").alias("data"))
    new1 = F.array(*(text(c) for c in ("event_id", "user_id", "event_type", "value")))
    new2 = F.array(*(text(c) for c in ("event_id", "user_id", "event_type", "value", "props")))
    ends = e.groupBy("txn").agg(F.max("ts").alias("ts"))
    parts = [
        message(one, F.lit(-1), "R", F.array(*v1)),
        message(one, 10 * half - 1, "R", F.array(*v1, col("props", 25))),
        message(ends, F.col("txn") * 10, "B"),
        message(ends.filter("txn % 13 <> 0"), F.col("txn") * 10 + 9, "C", None, F.col("txn") * 100 + 99, F.col("ts")),
        message(e.filter(F.col("txn") < half), position, "I", None, None, None, new1),
        message(e.filter(F.col("txn") >= half), position, "I", None, None, None, new2),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def customer_dest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy of ``customer`` with rows missing, changed and extra."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    kept = c.filter(k % 97 != 0).withColumn("c_acctbal", F.when(k % 101 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return kept.unionByName(c.filter(k % 211 == 0).withColumn("c_custkey", k + 1_000_000))


def latency_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    applied = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + (F.round(F.col("value") * 1000) * 1000).cast("long"))
    return e.select("event_id", F.when(F.col("event_id") % 50 != 0, F.col("ts").cast("timestamp")).alias("_cdc_commit_ts"), applied.alias("_cdc_applied_at"))


def load_changelog(spark: SparkSession, n: int) -> DataFrame:
    """The load generator: for each i an animal and an observation with large notes, an update of the animal, one of the observation that
    leaves the notes unchanged, and every third time the deletion of both rows of i - 1. One table, keyed by kind and id. The number of tasks
    follows n: Spark would deal any range to as many as there are cores."""
    notes = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(300)), lambda j: F.md5(F.concat_ws("-", F.col("id"), j).cast("binary"))), "")
    none = F.array().cast("array<string>")
    step = lambda sub, kind, back, op, status, value, kept, on: F.struct(F.lit(sub).alias("sub"), F.lit(kind).alias("kind"), F.lit(back).alias("back"), F.lit(op).alias("op"), F.lit(status).alias("status"), value.cast("string").alias("notes"), kept.alias("kept"), on.alias("on"))
    yes, third, nil = F.lit(True), F.col("id") % 3 == 0, F.lit(None)
    ops = F.array(
        step(0, "animal", 0, "c", "newborn", nil, none, yes), step(1, "observation", 0, "c", "seen", notes, none, yes), step(2, "animal", 0, "u", "adult", nil, none, yes),
        step(3, "observation", 0, "u", "moved", nil, F.array(F.lit("notes")), yes), step(4, "observation", 1, "d", None, nil, none, third), step(5, "animal", 1, "d", None, nil, none, third),
    )
    tasks = max(spark.sparkContext.defaultParallelism, -(-n // ITERATIONS))
    x = spark.range(1, n + 1, 1, tasks).withColumn("x", F.explode(ops)).filter("x.on")
    return x.select(F.col("x.kind").alias("kind"), (F.col("id") - F.col("x.back")).alias("id"), F.col("x.status").alias("status"), F.col("x.notes").alias("notes"), cdc(F.col("x.op"), F.col("id") * 10 + F.col("x.sub"), None, None, F.col("x.kept")))
