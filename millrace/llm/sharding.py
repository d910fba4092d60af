"""Sharding by histogram sort.

Documents are ordered by (hash of the text, hash of the id), so that copies stand together. Each round broadcasts a few hundred
candidate boundaries, every partition counts exactly the bytes below each, and the driver narrows the interval of each splitter to
the two probes around its target, until the splitter meets the tolerance. Only those counts reach the driver: their number is the
number of probes. A text that alone outweighs the tolerance is split by the second hash. Then rows are exchanged once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import checkpointed

LOW, HIGH = -(1 << 63), (1 << 63) - 1


def _histogram(rows: DataFrame, value: str, probes: list[int]) -> dict[int, tuple[int, int, int]]:
    """Exact bytes, smallest and largest ``value`` between neighbouring probes; partitions count on their own, a sum joins the counts."""
    edges = np.array(probes, np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(edges) + 1
        total, low, high = np.zeros(n, np.int64), np.full(n, HIGH, np.int64), np.full(n, LOW, np.int64)
        for b in batches:
            v = b.column(0).to_numpy(zero_copy_only=False)
            at = np.searchsorted(edges, v, side="right")
            np.add.at(total, at, b.column(1).to_numpy(zero_copy_only=False))
            np.minimum.at(low, at, v)
            np.maximum.at(high, at, v)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(x[used], pa.int64()) for x in (np.arange(n), total, low, high)], ["slot", "bytes", "low", "high"])

    counted = rows.select(value, "size").mapInArrow(count, "slot long, bytes long, low long, high long")
    return {r[0]: (r[1], r[2], r[3]) for r in counted.groupBy("slot").agg(F.sum("bytes"), F.min("low"), F.max("high")).collect()}


def _refine(rows: DataFrame, value: str, goals: list[float], whole: int, slack: float, width: int) -> list[tuple[int, int, int, int]]:
    """For each goal the last interval (low, bytes below it, high, bytes below it) of key values whose ends enclose the goal."""
    state = [(LOW, 0, HIGH, whole) for _ in goals]
    while True:
        probes: set[int] = set()
        for (lo, a, hi, b), goal in zip(state, goals, strict=True):
            if hi - lo > 1 and min(abs(a - goal), abs(b - goal)) > slack:
                step = max(1, (hi - lo) // (width + 1))
                probes.update(range(lo, hi, step), [hi])
        if not probes:
            return state
        below, found = 0, sorted(_histogram(rows, value, sorted(probes)).items())
        for _, (n, low, high) in found:
            for i, goal in enumerate(goals):
                lo, a, hi, b = state[i]
                if hi - lo > 1 and below <= goal <= below + n and a <= below and below + n <= b:
                    state[i] = (low, below, min(high + 1, HIGH), below + n)
            below += n


def splitters(rows: DataFrame, n_shards: int, tolerance: float = 0.001, width: int = 64) -> list[tuple[int, int]]:
    """Boundaries (h, h2) of ``n_shards`` ranges of near-equal bytes over columns ``h, h2, size``; a row at or above goes right."""
    whole = rows.agg(F.sum("size")).first()[0] or 0
    goals, slack = [whole * i / n_shards for i in range(1, n_shards)], tolerance * whole / n_shards
    out = []
    for (lo, a, hi, b), goal in zip(_refine(rows, "h", goals, whole, slack, width), goals, strict=True):
        if min(abs(a - goal), abs(b - goal)) <= slack or b - a <= slack or hi - lo > 1:
            out.append((lo, LOW) if abs(a - goal) <= abs(b - goal) else (hi, LOW))
            continue
        # all rows between the ends share one hash: a group of copies (or one large text), split by the id's hash
        part = rows.filter(F.col("h") == lo)
        lo2, a2, hi2, b2 = _refine(part, "h2", [goal - a], b - a, slack, width)[0]
        out.append((lo, lo2) if abs(a2 - (goal - a)) <= abs(b2 - (goal - a)) else (lo, hi2) if b2 < b - a else (hi, LOW))
    return sorted(out)


def shard(docs: DataFrame, n_shards: int = 8, tolerance: float = 0.001, segment_rows: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard, segment``.

    The law is ``bytes``: shards are ranges of near-equal size, within ``tolerance`` of a shard or half a document, whichever is
    larger. A shard is dealt in segments of about ``segment_rows`` rows (chosen by the id's hash, so that copies spread), each
    sorted by key; ``slot`` numbers a shard's rows without gaps, segment after segment.

    Null text is empty (size 1, crc 0). A null id is an id like any other. Repeated rows share their key and hence their shard, with
    slots of their own. An empty table gives an empty result. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = checkpointed(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
            F.xxhash64(F.lit(7), F.col(id_col)).alias("h2"),
        )
    )
    right = [F.when((F.col("h") > F.lit(h)) | ((F.col("h") == F.lit(h)) & (F.col("h2") >= F.lit(h2))), 1).otherwise(0) for h, h2 in splitters(rows, n_shards, tolerance)]
    n_segments = max(1, -(-rows.count() // (n_shards * segment_rows)))
    dealt = rows.withColumn("shard", sum(right, F.lit(0)).cast("int")).withColumn("segment", F.pmod(F.xxhash64("h2"), F.lit(n_segments)).cast("int"))
    counts = dealt.groupBy("shard", "segment").agg(F.count(F.lit(1)).alias("n")).collect()  # n_shards * n_segments rows
    before, seen = [], {}
    for s, g, n in sorted(counts):
        before.append((s, g, seen.get(s, 0)))
        seen[s] = seen.get(s, 0) + n
    starts = F.broadcast(docs.sparkSession.createDataFrame(before, "shard int, segment int, start long"))
    numbered = dealt.selectExpr("*", "row_number() OVER (PARTITION BY shard, segment ORDER BY h, h2, doc_id) - 1 AS k").join(starts, ["shard", "segment"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("k")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "segment"
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, id_col: str = "doc_id", **options) -> DataFrame:
    """Write ``docs`` as Parquet, a folder for each shard and a file for each segment in slot order; returns the assignment.

    Ids must be unique here, since rows find their shard by id.
    """
    placed = checkpointed(shard(docs, n_shards, id_col=id_col, **options))
    key = placed.select(F.col("doc_id").alias("__id"), F.col("shard").alias("__shard"), F.col("segment").alias("__segment"), F.col("slot").alias("__slot"))
    out = docs.join(key, F.col(id_col).eqNullSafe(F.col("__id"))).drop("__id")
    out.repartition("__shard", "__segment").sortWithinPartitions("__shard", "__segment", "__slot").write.partitionBy("__shard").parquet(path)
    return placed
