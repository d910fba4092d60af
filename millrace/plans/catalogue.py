"""The registered queries of the change-data-capture engine, and their SQL over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import types
from millrace.operators import batch, envelope, latency, verify, wal
from millrace.operators.fold import CDC, as_snapshot, carry, fold, materialize
from millrace.operators.merge import APPLIED_AT, COMMIT_TS, classify, is_small, merge
from millrace.plans.oracle import SQL
from millrace.sources import changelog as log
from millrace.sources import snapshot
from millrace.streaming.apply import step

USER = ["user_id"]
ORDER = ["o_orderkey"]
STARTED = "2024-01-01 00:00:00"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of every user after all changes, with values carried over updates that didn't send them."""
    return fold_toast(spark, sf_dir)


def _state(df: DataFrame) -> DataFrame:
    return df.select("user_id", "event_type", "value", "props")


# ---- fold ---------------------------------------------------------------------------------------


def fold_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold(log.chg_events(spark, sf_dir), USER).select("user_id", F.col(f"{CDC}.seq").alias("seq"), F.col(f"{CDC}.op").alias("op"), "event_type")


def fold_toast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(materialize(fold(log.chg_events(spark, sf_dir), USER)))


def fold_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold(log.chg_events(spark, sf_dir), USER).filter(F.col(f"{CDC}.op") == "d").select("user_id", F.col(f"{CDC}.seq").alias("seq"))


def fold_composite_pk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(fold(log.chg_lineitem(spark, sf_dir), ["l_orderkey", "l_linenumber"]))


def batch_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = log.table(spark, sf_dir, "events").select(F.lit("public.events").alias("table")).unionByName(log.table(spark, sf_dir, "orders").select(F.lit("public.orders").alias("table")))
    return batch.by_table(names)


def batch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.stats(log.chg_events(spark, sf_dir), USER)


def batch_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, started = log.table(spark, sf_dir, "documents"), F.lit(STARTED)
    narrow = snapshot.events(docs.filter("doc_id % 2 = 0").select("doc_id", "lang"), "public.documents", ["doc_id"], started)
    wide = snapshot.events(docs.filter("doc_id % 2 = 1"), "public.documents", ["doc_id"], started)
    both = narrow.unionByName(wide).withColumn("seq", F.element_at("pk", "doc_id").cast("long"))
    return envelope.batch_shape(both).select("table", F.array_join(F.array_sort(F.map_keys("types")), ",").alias("columns"), F.size("types").cast("long").alias("n_columns"))


def partition_high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = log.table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("part"), "event_id", "event_type", "user_id")
    return batch.high_water(m, "part", "event_id")


# ---- merge --------------------------------------------------------------------------------------


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The table after the first half of the log, and the folded second half."""
    changes = log.chg_events(spark, sf_dir)
    cut = (log.table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] + 1) // 2
    first, second = (fold(changes.filter(x), USER) for x in (F.col(f"{CDC}.seq") < cut, F.col(f"{CDC}.seq") >= cut))
    return first, second


def _class(spark: SparkSession, sf_dir: str, action: str) -> DataFrame:
    first, second = _halves(spark, sf_dir)
    return classify(materialize(first), second, USER).filter(F.col("action") == action)


def merge_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _class(spark, sf_dir, "insert")


def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _class(spark, sf_dir, "update")


def merge_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _class(spark, sf_dir, "delete")


def merge_upsert_toast(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = log.chg_documents(spark, sf_dir)
    target = materialize(fold(changes.filter(F.col(f"{CDC}.op") == "r"), ["doc_id"]))
    after = merge(target, fold(changes.filter(F.col(f"{CDC}.op") != "r"), ["doc_id"]), ["doc_id"])
    return after.select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def merge_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = _halves(spark, sf_dir)
    return _state(merge(materialize(first), second, USER))


def merge_small_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merge that broadcasts its batch if the batch's bytes allow it."""
    first, second = _halves(spark, sf_dir)
    second = second.persist()
    return _state(merge(materialize(first), second, USER, small_batch=is_small(second)))


def merge_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = _halves(spark, sf_dir)
    empty = materialize(first).limit(0)
    one = merge(empty, first, USER, F.lit("2030-01-01 00:00:00").cast("timestamp"))
    two = merge(one, second, USER, F.lit("2030-01-02 00:00:00").cast("timestamp"))
    return two.select("user_id", F.col(COMMIT_TS).cast("timestamp_ntz").alias("commit_ts"), F.col(APPLIED_AT).cast("timestamp_ntz").alias("applied_at"))


def replay_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = _halves(spark, sf_dir)
    return _state(merge(merge(materialize(first), second, USER), second, USER))


def split_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = log.chg_events(spark, sf_dir)
    n = log.table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] + 1
    state = materialize(fold(changes, USER)).limit(0)
    for i in range(4):
        part = changes.filter((F.col(f"{CDC}.seq") >= n * i // 4) & (F.col(f"{CDC}.seq") < n * (i + 1) // 4))
        state = merge(state, fold(part, USER), USER)
    return _state(state)


# ---- snapshots and logs -------------------------------------------------------------------------


def backfill_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = snapshot.events(log.table(spark, sf_dir, "orders"), "public.orders", ORDER, F.lit(STARTED))
    at = lambda m, k: F.element_at(m, k)
    return e.select("op", "table", F.col("lsn").cast("long").alias("lsn"), at("pk", "o_orderkey").alias("key"), at("after", "o_custkey").alias("o_custkey"), at("after", "o_orderstatus").alias("o_orderstatus"), at("after", "o_orderdate").alias("o_orderdate"), at("types", "o_custkey").alias("custkey_type"), at("types", "o_orderdate").alias("orderdate_type"))


def backfill_then_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = log.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    live = log.chg_orders(spark, sf_dir).filter(F.col(f"{CDC}.op") != "r")
    return materialize(fold(as_snapshot(orders).unionByName(live), ORDER))


def key_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose key changes twice in a batch, without their priority: it comes from the table, two steps back."""
    orders = log.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    changes = log.chg_moved_twice(spark, sf_dir)
    return merge(orders, fold(carry(changes, orders, ORDER), ORDER), ORDER).select("o_orderkey", "o_orderstatus", "o_orderpriority")


def wal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log decoded in two parts, cut inside a transaction; what is open there is handed on."""
    m = log.wal_msgs(spark, sf_dir)
    last = m.agg(F.max("pos")).first()[0]
    cuts = [-2, last // 20 * 10 + 3, last]
    out, waiting = None, None
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        events, left = step(m.filter((F.col("pos") > a) & (F.col("pos") <= b)), waiting)
        out, waiting = (events if out is None else out.unionByName(events)), left.persist()  # a few rows
    return _decoded(out)


def wal_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(wal.events(log.wal_msgs(spark, sf_dir)))


def _decoded(e: DataFrame) -> DataFrame:
    return e.select("op", "table", F.element_at("pk", "event_id").cast("long").alias("event_id"), F.element_at("after", "event_type").alias("event_type"), F.try_element_at("after", F.lit("props")).alias("props"), F.size("after").cast("long").alias("n_after"), F.element_at("types", "event_id").alias("key_type"))


def txn_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wal.assemble(log.wal_msgs(spark, sf_dir)).select("txn", "pos", F.element_at("new", 1)["data"].cast("long").alias("event_id"))


def txn_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wal.assemble(log.wal_msgs(spark, sf_dir)).groupBy("txn").agg(F.count(F.lit(1)).alias("n"))


def txn_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wal.assemble(log.wal_msgs(spark, sf_dir)).select("pos", F.col("lsn").cast("long").alias("lsn"), F.col("commit_ts").cast("timestamp_ntz").alias("commit_ts"))


def asof_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = log.wal_msgs(spark, sf_dir)
    return wal.with_relation(m.filter("kind = 'I'"), m).select("pos", F.col("version").cast("long").alias("version"), F.size("rel.columns").cast("long").alias("n_columns"))


def _row(df: DataFrame, kind: str, name: str, cols: list[tuple[str, int, bool]], new, old=None) -> DataFrame:
    """Row messages with their relation, for the decoder."""
    rel = F.struct(F.lit(name).alias("table"), F.array(*(F.struct(F.lit(n).alias("name"), F.lit(o).alias("oid"), F.lit(k).alias("is_key")) for n, o, k in cols)).alias("columns"))
    nil = F.lit(None).cast(wal.TUPLE)
    return df.select(F.lit(1).cast("long").alias("pos"), F.lit(kind).alias("kind"), rel.alias("rel"), F.lit(1).cast("decimal(20,0)").alias("lsn"), F.lit(STARTED).cast("timestamp").alias("commit_ts"), new.cast(wal.TUPLE).alias("new"), (nil if old is None else old.cast(wal.TUPLE)).alias("old"), F.lit(0).cast("long").alias("txn"))


def _value(c, kind: str = "t"):
    return F.struct(F.lit(kind).alias("kind"), c.cast("string").alias("data"))


def pk_change_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = log.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    to = F.when((k % 11 == 0) & (k % 7 != 0), k + 10_000_000).otherwise(k)
    nul = F.struct(F.lit("n").alias("kind"), F.lit(None).cast("string").alias("data"))
    rows = _row(o, "U", "public.orders", [("o_orderkey", 20, True), ("o_orderstatus", 25, False)], F.array(_value(to), _value(F.col("o_orderstatus"))), F.array(_value(k), nul))
    e = wal.decode(rows)
    return e.select("op", F.element_at("pk", "o_orderkey").cast("long").alias("o_orderkey"), F.try_element_at("after", F.lit("o_orderstatus")).alias("o_orderstatus"), (F.col("seq") % 2).alias("sub"))


def toast_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = log.table(spark, sf_dir, "documents")
    text = F.when(F.col("n_chars") > 2000, F.struct(F.lit("u").alias("kind"), F.lit(None).cast("string").alias("data"))).otherwise(_value(F.col("text")))
    e = wal.decode(_row(d, "U", "public.documents", [("doc_id", 20, True), ("text", 25, False)], F.array(_value(F.col("doc_id")), text)))
    return e.select(F.element_at("pk", "doc_id").cast("long").alias("doc_id"), F.array_join("unchanged", ",").alias("unchanged"), F.size("after").cast("long").alias("n_after"))


# ---- envelope and types -------------------------------------------------------------------------


def event_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = snapshot.events(log.table(spark, sf_dir, "customer"), "public.customer", ["c_custkey"], F.lit(STARTED))
    li = log.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    both = c.select("table", "pk").unionByName(snapshot.events(li, "public.lineitem", ["l_orderkey", "l_linenumber"], F.lit(STARTED)).select("table", "pk"))
    return both.select(envelope.message_key(F.col("table"), F.col("pk")).alias("key"))


def envelope_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = log.table(spark, sf_dir, "customer").select((F.col("c_custkey") + F.lit(9007199254740993)).alias("c_custkey"), "c_name", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    e = envelope.decode(envelope.encode(snapshot.events(big, "public.customer", ["c_custkey"], F.lit(STARTED))))
    return e.select("op", "table", F.element_at("pk", "c_custkey").cast("long").alias("c_custkey"), F.element_at("after", "c_name").alias("c_name"), F.element_at("after", "c_mktsegment").alias("c_mktsegment"), F.size("after").cast("long").alias("n_after"))


def envelope_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    value = F.when(k % 10 == 0, "not json").when(k % 10 == 1, F.lit('{"table":"t"}')).when(k % 10 == 2, F.lit('{"op":"u","table":""}')).when(k % 10 == 3, F.lit('{"op":"x","table":"t"}')).otherwise(F.lit('{"op":"u","table":"t","pk":{"id":1}}'))
    e = envelope.decode(log.table(spark, sf_dir, "events").select(value.alias("value")), on_error="keep")
    return e.groupBy(F.coalesce("error", F.lit("good")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def type_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.createDataFrame([(i,) for i in (*types.TYPE_NAMES, 24754, 17)], "oid int")
    return ids.select("oid", types.type_name(F.col("oid")).alias("name"), types.dest_type(types.type_name(F.col("oid"))).alias("dest"))


def pg_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "9007199254740993", "t", "2024-02-29", "1.5", "7"), (2, "-1", "false", "1999-12-31", "NaN", "-32768")], "id int, i8 string, b string, d string, f8 string, i2 string")
    t = types.from_text
    return rows.select("id", t(F.col("i8"), "bigint").alias("i8"), t(F.col("b"), "boolean").alias("b"), t(F.col("d"), "date").cast("string").alias("d"), t(F.col("f8"), "double precision").cast("string").alias("f8"), t(F.col("i2"), "smallint").cast("int").alias("i2"))


def staging_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = log.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    e = snapshot.events(o, "public.orders", ORDER, F.lit(STARTED)).withColumn("seq", F.element_at("pk", "o_orderkey").cast("long"))
    gone = F.col("seq") % 7 == 0
    e = e.withColumn("op", F.when(gone, "d").otherwise("u")).withColumn("after", F.when(~gone, F.map_filter("after", lambda k, v: k != "o_custkey"))).withColumn("unchanged", F.when(~gone, F.array(F.lit("o_custkey"))))
    s = envelope.stage(e, ORDER, snapshot.event_types(o))
    return s.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", F.col(f"{CDC}.op").alias("op"), F.array_join(f"{CDC}.unchanged", ",").alias("unchanged"))


def _catalogue(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Attributes and primary indexes of two tables; the second one's index has its columns in another order than the table."""
    a = spark.createDataFrame([("public.t", 1, "zeta", "text", False), ("public.t", 2, "id", "bigint", False), ("public.t", 3, "alpha", "text", False), ("public.t", 4, "mid", "text", False), ("public.t", 5, "old", "text", True), ("public.t", -1, "ctid", "tid", False), ("public.u", 1, "b", "int", False), ("public.u", 2, "a", "int", False)], "table string, num int, column string, type string, dropped boolean")
    return a, spark.createDataFrame([("public.t", [2]), ("public.u", [1, 2])], "table string, keys array<int>")


def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.catalog(*_catalogue(spark)).withColumn("place", F.col("place").cast("long"))


def index_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.key_columns(*_catalogue(spark))


def table_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.shape(*_catalogue(spark)).select("table", F.array_join("pk", ",").alias("pk"), F.array_join("columns", ",").alias("columns"))


def published_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a made-up catalogue: the tables of nations of even key are published by region, some of them twice."""
    n = log.table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0")
    rows = n.select(F.concat(F.lit("region_"), "n_regionkey").alias("publication"), F.lit("public").alias("schema"), F.lower("n_name").alias("table"))
    return snapshot.published(rows.unionByName(rows.filter("table < 'f'")), "region_1")


# ---- verification -------------------------------------------------------------------------------


def _checksum(name: str, pk: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: verify.checksum(log.table(spark, sf_dir, name), pk)


def checksum_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.checksum(log.table(spark, sf_dir, "nation").filter("false"), ["n_nationkey"])


def _compared(spark: SparkSession, sf_dir: str, same: bool) -> DataFrame:
    c = log.table(spark, sf_dir, "customer")
    nation = log.table(spark, sf_dir, "nation")
    return verify.compare({"public.customer": c, "public.nation": nation}, {"public.customer": c if same else log.customer_dest(spark, sf_dir), "public.nation": nation}, {"public.customer": ["c_custkey"], "public.nation": ["n_nationkey"]})


def verify_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir, True)


def verify_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir, False)


def verify_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.report(_compared(spark, sf_dir, False))


def verify_row_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.row_diff(log.table(spark, sf_dir, "customer"), log.customer_dest(spark, sf_dir), ["c_custkey"])


def replica_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = log.table(spark, sf_dir, "customer").select(F.lit("source").alias("side")).unionByName(log.customer_dest(spark, sf_dir).select(F.lit("copy").alias("side")))
    return sides.groupBy("side").agg(F.count(F.lit(1)).alias("n"))


# ---- latency ------------------------------------------------------------------------------------


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def latency_by_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(latency.by_minute(log.latency_events(spark, sf_dir)))


def latency_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = log.latency_events(spark, sf_dir)
    newest = e.agg(F.date_format(F.max(APPLIED_AT), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]
    return _rounded(latency.by_minute(e, F.lit(newest).cast("timestamp") - F.expr("INTERVAL 1 DAY")))


def latency_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(latency.overall(log.latency_events(spark, sf_dir)))


def latency_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latency.csv_rows(latency.by_minute(log.latency_events(spark, sf_dir)))


def _load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generated load, an iteration for each customer."""
    return log.load_changelog(spark, log.table(spark, sf_dir, "customer").count())


def load_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _load(spark, sf_dir).groupBy("kind", F.col(f"{CDC}.op").alias("op")).agg(F.count(F.lit(1)).alias("n"))


def load_changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the load, with length and digest of the notes. A fold picks values and never looks into them, so it gets the length and
    digest of each of the changes' notes, and their 9,600 bytes are neither sorted nor shuffled."""
    digest = F.when(F.col("notes").isNotNull(), F.struct(F.length("notes").cast("long").alias("n"), F.md5(F.col("notes").cast("binary")).alias("md5")))
    state = materialize(fold(_load(spark, sf_dir).withColumn("notes", digest), ["kind", "id"]))
    return state.select("kind", "id", "status", F.coalesce("notes.n", F.lit(0).cast("long")).alias("n_notes"), F.coalesce("notes.md5", F.md5(F.lit("").cast("binary"))).alias("notes_md5"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = (
        fold_last, fold_toast, fold_delete, fold_composite_pk, batch_by_table, batch_stats, batch_schema, partition_high_water, merge_insert, merge_upsert, merge_delete, merge_upsert_toast, merge_full,
        merge_small_batch, merge_metadata, replay_idempotent, split_equivalence, backfill_orders, backfill_then_stream, key_chain, wal_decode, wal_split, txn_assemble, txn_stats, txn_stamp, asof_schema, pk_change_split, toast_marker,
        event_key, envelope_roundtrip, envelope_reject, type_map, pg_cast, staging_rows, catalog_columns, index_keys, table_shapes, published_tables, checksum_empty, verify_match, verify_mismatch, verify_report, verify_row_diff, replica_counts,
        latency_by_minute, latency_since, latency_overall, latency_csv, load_changelog, load_counts,
    )
    sums = {f"checksum_{t}": _checksum(t, pk) for t, pk in (("customer", ["c_custkey"]), ("orders", ORDER), ("nation", ["n_nationkey"]))}
    return {f.__name__: f for f in plain} | sums


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
