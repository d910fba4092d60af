"""Streams: log messages to events, events to keyed tables.

Delivery is at least once and merges are harmless when repeated, so tables end up as if each change had been applied once. A batch is
bounded by files or offsets for each trigger (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``) and by time.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators import envelope, wal
from millrace.operators.merge import APPLIED_AT, COMMIT_TS
from millrace.sources import snapshot
from millrace.streaming.table import KeyedTable, file_system, names, read_text, write_text


@dataclass
class TableSpec:
    """A published table: key, and types of its columns so far."""

    pk: list[str]
    types: dict[str, str] = field(default_factory=dict)


def capture(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of log messages from JSON files as they arrive."""
    return spark.readStream.schema(wal.MESSAGE).option("maxFilesPerTrigger", files_per_trigger).json(path)


def published(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """The stream of events that ``start_capture`` writes. Files of a batch hold different keys and batches come in order, so a key's changes do, too."""
    stream = spark.readStream.schema("key string, value string, seq long").option("recursiveFileLookup", "true")
    return stream.option("maxFilesPerTrigger", files_per_trigger).json(path)


def step(part: DataFrame, waiting: DataFrame | None, relations: DataFrame | None = None, after: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Events of the transactions that a part of the log commits, and what later parts still need: messages of open transactions and
    relations. ``waiting`` is that of the parts before. Transactions committed up to ``after`` have no events: a snapshot has them."""
    log = part if waiting is None else part.unionByName(waiting)
    known = (log if relations is None else relations.unionByName(log, allowMissingColumns=True)).filter("kind = 'R'").dropDuplicates(["rel_id", "pos"])
    rows = wal.assemble(log)
    if after is not None:
        rows = rows.filter(F.col("lsn") > F.lit(after))
    return wal.decode(wal.with_relation(rows, known)), wal.still_open(log)


def start_capture(messages: DataFrame, relations: DataFrame, out: str, checkpoint: str, once: bool = True, after: int | None = None, trigger: str = "2 seconds") -> StreamingQuery:
    """Write the events of each batch of messages as JSON documents, by key in order. ``relations`` are those known before, newer ones
    come with the messages. Batches follow each other in position. A transaction is written with the batch of its commit: what is open at
    the end of a batch, and relations, wait in a table beside the checkpoint, by batch id. ``after`` is the position of the snapshot (``pin``)."""
    folder = f"{checkpoint.rstrip('/')}_open"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = [i for i in sorted(map(int, names(spark, folder))) if i < batch_id]
        part = batch.persist()
        try:
            events, left = step(part, spark.read.schema(wal.MESSAGE).parquet(f"{folder}/{earlier[-1]}") if earlier else None, relations, after)
            keyed = events.select(envelope.message_key(F.col("table"), F.col("pk")).alias("key"), F.to_json(F.struct(*envelope.FIELDS)).alias("value"), "seq")
            keyed.repartition("key").sortWithinPartitions("key", "seq").write.mode("overwrite").json(f"{out}/batch={batch_id}")
            left.write.mode("overwrite").parquet(f"{folder}/{batch_id}")
        finally:
            part.unpersist()
        for i in earlier[:-1]:  # only the last batch can be run again
            fs, p = file_system(spark, f"{folder}/{i}")
            fs.delete(p, True)

    return _start(messages, write, checkpoint, once, trigger)


def start_apply(events: DataFrame, tables: dict[str, TableSpec], root: str, checkpoint: str, once: bool = True, trigger: str = "2 seconds", on_error: str = "fail", buckets: int = 32) -> StreamingQuery:
    """Apply a stream of (value JSON, seq) to the keyed tables under ``root``. Each batch is folded and merged table by table.

    New columns in a batch's types widen the table; a column's first type stays. Events of tables without a spec raise.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        decoded = envelope.decode(batch, on_error=on_error).persist()
        try:
            shapes = {r["table"]: r["types"] for r in envelope.batch_shape(decoded).collect()}
            for name in sorted(shapes):
                if name not in tables:
                    raise KeyError(f"table {name} isn't published")
                spec = tables[name]
                spec.types = {**(shapes[name] or {}), **spec.types}
                changes = envelope.stage(decoded.filter(F.col("table") == name), spec.pk, spec.types)
                KeyedTable(batch.sparkSession, f"{root}/{name}", spec.pk, buckets).apply(changes, batch_id)
        finally:
            decoded.unpersist()

    return _start(events, write, checkpoint, once, trigger)


def _start(stream: DataFrame, write, checkpoint: str, once: bool, trigger: str = "2 seconds") -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=trigger)).start()


def pin(spark: SparkSession, path: str, position: int, version: str) -> tuple[dict, bool]:
    """Create or resume: the position of the log and the version of the snapshot that belong together, and whether they are new.

    The first call writes both in one file, which is never replaced; later calls, after a restart, get what was pinned. A snapshot at that
    version and the transactions behind that position are the whole."""
    fresh = write_text(spark, path, json.dumps({"position": position, "version": version}))
    return json.loads(read_text(spark, path)), fresh


def backfill(table: KeyedTable, source: DataFrame, started: str) -> bool:
    """Copy a pinned snapshot as version 0 of the table. A crash before the end leaves no marker, so the next start does it again."""
    m = table.manifest()
    if m is not None and m.get("backfill_done"):
        return False
    when = F.lit(started).cast("timestamp")
    table.commit(source.withColumn(COMMIT_TS, when).withColumn(APPLIED_AT, F.current_timestamp()), -1, backfill_done=True)
    return True


def snapshot_events(source: DataFrame, name: str, pk: list[str], started: str) -> DataFrame:
    """The snapshot as JSON documents for the same path as live changes."""
    e = snapshot.events(source, name, pk, F.lit(started))
    return envelope.encode(e).withColumn("seq", F.lit(-1).cast("long"))
