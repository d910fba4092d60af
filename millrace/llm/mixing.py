"""Mixing sources to target weights by cube-method balanced sampling.

Each source gets a target of words. A document of a source is taken ``floor(r)`` times, ``r`` being target over size of the source,
and once more with inclusion probability ``r - floor(r)``. The cube method moves the vector of probabilities through the null-space
of two constraints, the expected words and the expected number of documents, until all but two entries of a block are 0 or 1. Blocks
of documents do this on their own; what stays fractional meets in larger blocks, level by level, until one small block for each
source is left, where the last documents are landed on the corner nearest to the target.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import WORD, checkpointed, small

FLIGHT = "source_ix long, doc_id {id}, size long, mark long, p double"


def plan(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """``source_ix, source, source_size, target, base, p, n`` for a table of sources (source, s, n).

    Sources by code point, null last, weigh as ``weights`` say, over and over; the whole is shared by weight, no target is above ``cap`` times
    the size, and what a cap cuts goes to the others by weight. As caps are met, the share of a weight only grows, so one number tells which
    sources are capped, and the driver holds nothing but it.
    """
    ranged = checkpointed(sizes.repartitionByRange(F.col("source").asc_nulls_last()).select("*", F.spark_partition_id().alias("part")))
    seen, before = 0, []
    for r in ranged.groupBy("part").agg(F.count(F.lit(1)).alias("k")).orderBy("part").collect():  # a row for each partition
        before.append((r["part"], seen))
        seen += r["k"]
    start = F.broadcast(sizes.sparkSession.createDataFrame(before, "part int, start long"))
    number = F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = ranged.join(start, "part").select("source", "s", "n", number.alias("source_ix"))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("source_ix") % len(weights) + 1).cast("int"))
    table = checkpointed(ranked.withColumn("w", w))
    limit = F.col("s") * float(cap)
    whole, unit, capped = float(table.agg(F.sum("s")).first()[0] or 0), 0.0, -1
    while True:
        over = F.col("w") * unit > limit
        now = table.agg(F.count(F.when(over, 1)).alias("k"), F.coalesce(F.sum(F.when(over, limit)), F.lit(0.0)).alias("done"), F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0.0)).alias("free")).first()
        if now["k"] == capped or not now["free"]:
            break
        capped, unit = now["k"], (whole - now["done"]) / now["free"]
    target = F.least(F.col("w") * unit, limit)
    ratio = F.when(F.col("s") > 0, F.least(F.lit(float(cap)), target / F.col("s"))).otherwise(0.0)
    base = F.floor(ratio + 1e-12).cast("int")
    return table.select("source_ix", "source", F.col("s").alias("source_size"), target.alias("target"), base.alias("base"), F.greatest(F.lit(0.0), ratio - base).alias("p"), "n")


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The flight phase on one block: sums of ``p`` and of ``p * size`` stay, at most two entries stay strictly between 0 and 1."""
    p = p.astype(float)
    todo = [i for i in range(len(p)) if 0 < p[i] < 1]
    draw = iter(rng.random(2 * len(todo) + 8))
    active: list[int] = []
    todo.reverse()
    while True:
        while todo and len(active) < 3:
            active.append(todo.pop())
        z = [float(size[i]) for i in active]
        if len(active) == 3:
            u = [z[1] - z[2], z[2] - z[0], z[0] - z[1]]
            if not any(u):
                u = [1.0, -1.0, 0.0]
        elif len(active) == 2 and z[0] == z[1]:
            u = [1.0, -1.0]
        else:
            return p
        up = min(((1 - p[i]) / x if x > 0 else -p[i] / x) for i, x in zip(active, u, strict=True) if x)
        down = min((p[i] / x if x > 0 else (p[i] - 1) / x) for i, x in zip(active, u, strict=True) if x)
        move = up if next(draw) * (up + down) < down else -down
        for i, x in zip(active, u, strict=True):
            q = p[i] + move * x
            p[i] = 0.0 if q < 1e-9 else 1.0 if q > 1 - 1e-9 else q
        active = [i for i in active if 0 < p[i] < 1]


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Round what a flight left (two entries at most) to the corner whose words, then whose count, are nearest to the expected."""
    left = np.flatnonzero((p > 0) & (p < 1))
    if len(left):
        words, docs = float((p[left] * size[left]).sum()), float(p[left].sum())
        p = p.copy()
        p[left] = min(itertools.product((0.0, 1.0), repeat=len(left)), key=lambda c: (abs(np.dot(c, size[left]) - words), abs(sum(c) - docs), c))
    return p


def settle(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, heavy: float = 4.0) -> np.ndarray:
    """Flight and landing of a source's last block: first the documents over ``heavy`` times the mean size, then the others, whose
    probabilities first take up the words by which the heavy ones were landed off. So the error is at most about half a light document."""
    out, big = p.astype(float), size > heavy * max(1.0, size.mean() if len(size) else 1.0)
    if big.any():
        expected = float((out[big] * size[big]).sum())
        out[big] = land(flight(out[big], size[big], rng), size[big])
        free = ~big & (out > 0) & (out < 1)
        words = float(size[free].sum())
        if words:
            out[free] = np.clip(out[free] + (expected - float((out[big] * size[big]).sum())) / words, 0.0, 1.0)
    out[~big] = land(flight(out[~big], size[~big], rng), size[~big])
    return out


def _flier(seed: int, level: int, last: bool) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Flight of one block of one source, and its landing on the last level."""

    def fly(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "size", "mark"], kind="stable", na_position="last")
        size = pdf["size"].to_numpy(np.int64)
        move = settle if last else flight
        return pdf.assign(p=move(pdf["p"].to_numpy(float), size, np.random.default_rng([seed, level, int(key[0]), int(key[1])])))[["source_ix", "doc_id", "size", "mark", "p"]]

    return fly


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 17, block_rows: int = 4000, broadcast_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each input row: ``doc_id, size, source_size, target, taken, source, copies``.

    Sources may be as many as documents; their table is broadcast up to ``broadcast_bytes`` and shuffled beyond.

    Null text has size 0, and documents without words are never taken. Null is a source of its own, last in order. Repeated rows
    are documents of their own; a null id is an id like any other. An empty table gives an empty result. Other columns are ignored.
    Reruns agree: blocks and random draws follow from ``seed``, ids and texts alone.
    """
    rows = checkpointed(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(text_col).alias("mark")))
    sources = checkpointed(plan(rows.groupBy("source").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")), weights, float(cap)))
    kind = dict(rows.dtypes)["doc_id"]
    named = small(sources.withColumn("name", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source", "source_size", "target", "base"), "name", limit=broadcast_bytes)
    now = rows.withColumn("name", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).join(named, "name").select("source_ix", "doc_id", "size", "mark", F.when(F.col("size") == 0, 0.0).otherwise(F.col("p")).alias("p"), "n")
    half = block_rows // 2

    def drawn(n: int) -> Column:
        return F.xxhash64(F.lit(seed + n), F.col("doc_id"), F.col("mark"))

    held = F.pmod(drawn(-1), F.ceil(F.col("n") / F.lit(half)).cast("long")) == 0
    done, level = [], 0
    reserve, now = now.filter(held), now.filter(~held)  # the reserve, about half a block of each source, waits for the last block
    most = sources.agg(F.max("n")).first()[0] or 0
    while most > half:
        # a source's blocks: about block_rows documents each, by a hash of id and text that differs from level to level
        blocks = F.ceil(F.col("n") / F.lit(block_rows)).cast("long")
        dealt = now.withColumn("block", F.pmod(drawn(level), blocks).cast("int"))
        moved = checkpointed(dealt.groupBy("source_ix", "block").applyInPandas(_flier(seed, level, False), FLIGHT.format(id=kind)))
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(moved.filter(~open_))
        left = moved.filter(open_)
        counts = checkpointed(left.groupBy("source_ix").agg(F.count(F.lit(1)).alias("n")))  # as many rows as sources
        now = left.join(small(counts, "source_ix", limit=broadcast_bytes), "source_ix").select("source_ix", "doc_id", "size", "mark", "p", "n")
        most, level = counts.agg(F.max("n")).first()[0] or 0, level + 1
    last = now.unionByName(reserve).withColumn("block", F.lit(0))
    done.append(last.groupBy("source_ix", "block").applyInPandas(_flier(seed, level, True), FLIGHT.format(id=kind)))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("base") + F.col("x")).cast("int")
    told = small(sources.drop("p", "n"), "source", limit=broadcast_bytes)
    return out.withColumnRenamed("p", "x").join(told, "source_ix").select("doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), "source", copies.alias("copies"))
