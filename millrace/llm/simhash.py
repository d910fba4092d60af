"""SimHash near-dedup with vantage-point trees.

Of two 64-bit fingerprints within 3 bits of each other at least one of four quarters is the same, and the Hamming distance of a quarter
is a metric of its own. So each quarter has a vantage-point tree: a node holds a vantage point and a radius, and parts fingerprints by
their distance to it. A query needs a side only if the triangle inequality leaves room there; near the border it needs both. As the
radius of a query is ``bits // 4``, for up to 3 bits there is no border, and each fingerprint goes to four shards, however deep the trees
are. (A tree over halves has radius 1: each level copies the band along its border, 27 % of random points at the median distance, and the
copies double with every third level. A tree over all 64 bits has radius 3 and prunes almost nothing.)

The upper levels are built from a bounded sample and deal distinct fingerprints to shards: each goes to its home shard and, as a query, to
every shard whose border it overlaps. A shard with far more than its share (one quarter that very many have) is dealt once more, by trees
over the two halves of the other 48 bits, where radius 1 is enough. A shard carries its tree on by itself, compares what is left exactly,
and returns a spanning forest, never all pairs. Stars of all shards are joined to components by rounds of joins.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import checkpointed, mix64

PARTS, WIDTH = 4, 16
QUARTERS = tuple(np.uint64(0xFFFF << WIDTH * i) for i in range(PARTS))
PIECE = 1 << 16


def halves(quarter: int) -> tuple[np.uint64, np.uint64]:
    """Masks of the two halves of the bits outside a quarter."""
    rest = [i for i in range(64) if i // WIDTH != quarter]
    return tuple(np.uint64(sum(1 << i for i in part)) for part in (rest[:24], rest[24:]))


def fingerprint(raw: bytes, shingle: int = 3) -> int:
    """SimHash of a UTF-8 text: majority of the bits of the XXH64 of its word shingles, repeats included."""
    words = raw.lower().split()
    if not words:
        return 0
    grams = iter([b" ".join(words)]) if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    total, ones = 0, np.zeros(64, np.int64)
    while len(h := np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in itertools.islice(grams, PIECE)), np.uint64)):
        total += len(h)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", text_key: bool = False) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long) of whole texts; null text counts as empty. With ``text_key`` the SHA-256 of the text too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint((t.as_py() or "").encode(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), *b.columns[2:]], ["doc_id", "fp", *["text_key"] * text_key])

    more = [F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256).alias("text_key")] * text_key
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *more)
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, fp long{', text_key string' * text_key}")


# ---- the tree -----------------------------------------------------------------------------------


def _distance(x: np.ndarray, point: np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((x ^ point) & mask)


def build(sample: np.ndarray, mask: np.uint64, depth: int, tries: int = 8) -> dict | None:
    """Upper levels of a tree: of a few vantage points the one that leaves the fewest points near its border. None is a leaf."""
    if depth == 0 or len(sample) < 4:
        return None
    best = None
    for point in sample[:: max(1, len(sample) // tries)][:tries]:
        d = _distance(sample, point, mask)
        radius = int(np.partition(d, len(d) // 2)[len(d) // 2])
        for r in (radius - 1, radius):
            near = int((d <= r).sum())
            if 0 < near < len(d):
                cost = max(near, len(d) - near) + int(((d == r) | (d == r + 1)).sum())
                if best is None or cost < best[0]:
                    best = (cost, point, r, d)
    if best is None:
        return None
    _, point, r, d = best
    return {"point": point, "radius": r, "near": build(sample[d <= r], mask, depth - 1, tries), "far": build(sample[d > r], mask, depth - 1, tries)}


def deal(node: dict | None, x: np.ndarray, mask: np.uint64, reach: int, at: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Leaves with the indices of ``x`` that need them, and whether each is at home there."""

    def walk(node: dict | None, idx: np.ndarray, home: np.ndarray, at: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if not len(idx):
            return
        if node is None:
            yield at, idx, home
            return
        d = _distance(x[idx], node["point"], mask).astype(np.int16)
        r = node["radius"]
        for side, needs, own in (("near", d - reach <= r, d <= r), ("far", d + reach > r, d > r)):
            yield from walk(node[side], idx[needs], (home & own)[needs], 2 * at + (side == "far"))

    yield from walk(node, np.arange(len(x)), np.ones(len(x), bool), at)


class Forest:
    """Union of vectors of pairs, by labels that only fall."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.label[a], self.label[b]
            open_ = x != y
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while (self.label != self.label[self.label]).any():
                self.label = self.label[self.label]


def link(x: np.ndarray, home: np.ndarray, metrics: list[tuple[tuple[np.uint64, ...], int]], bits: int, leaf: int = 1 << 10) -> np.ndarray:
    """Label of each point of a shard after all its exact links between a home point and any point.

    ``metrics`` are tried in turn: masks with the radius at which one of them at least finds each link. The tree goes on down to leaves; where
    a mask no longer parts its points, the next metric does."""
    forest = Forest(len(x))

    def compare(q: np.ndarray, h: np.ndarray) -> None:
        step = max(1, (1 << 20) // max(1, len(h)))
        for i in range(0, len(q), step):
            a, b = np.nonzero(np.bitwise_count(x[q[i : i + step]][:, None] ^ x[h][None, :]) <= bits)
            forest.join(q[i : i + step][a], h[b])

    def walk(q: np.ndarray, h: np.ndarray, mask: np.uint64, level: int, depth: int) -> None:
        node = build(x[h[mix64(x[h]).argsort()[:256]]], mask, 1) if len(h) > leaf and depth < 40 else None
        if node is None:
            if len(h) > leaf and level + 1 < len(metrics):
                for further in metrics[level + 1][0]:
                    walk(q, h, further, level + 1, 0)
            else:
                compare(q, h)
            return
        reach, r = metrics[level][1], node["radius"]
        dq, dh = (_distance(x[i], node["point"], mask).astype(np.int16) for i in (q, h))
        walk(q[dq - reach <= r], h[dh <= r], mask, level, depth + 1)
        walk(q[dq + reach > r], h[dh > r], mask, level, depth + 1)

    for mask in metrics[0][0]:
        walk(np.arange(len(x)), np.flatnonzero(home), mask, 0, 0)
    return forest.label


def _sampled(nodes: DataFrame, n: int) -> np.ndarray:
    """At most ``n`` fingerprints, chosen by hash."""
    return np.array([r[0] for r in nodes.orderBy(F.xxhash64("fp"), "fp").limit(n).collect()], np.int64).view(np.uint64)


def leaves(tree: dict | None, quarter: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the tree of a quarter does with each of its 65,536 values: where its row starts, and leaves and whether they are its home."""
    found = list(deal(tree, np.arange(1 << WIDTH, dtype=np.uint64) << np.uint64(WIDTH * quarter), QUARTERS[quarter], reach))
    value = np.concatenate([i for _, i, _ in found])
    leaf, home = np.repeat([at for at, _, _ in found], [len(i) for _, i, _ in found]), np.concatenate([h for _, _, h in found])
    order = value.argsort(kind="stable")
    return np.searchsorted(value[order], np.arange((1 << WIDTH) + 1)), leaf[order].astype(np.int32), home[order]


def _depth(count: int, shard_points: int, deepest: int) -> int:
    return min(deepest, max(0, int(np.ceil(np.log2(max(1, count / shard_points))))))


def edges(nodes: DataFrame, count: int, bits: int = 3, shard_points: int = 20_000, deepest: int = 14, sample_per_shard: int = 16, hot: int = 4) -> DataFrame:
    """Stars ``u, v`` (v < u as labels of a shard) that connect exactly the fingerprints of ``nodes`` (column ``fp``) linked within ``bits``.

    The driver holds samples of at most ``sample_per_shard << deepest`` fingerprints, the trees made of them, and a row for each shard with
    more than ``hot * shard_points`` fingerprints. From ``shard_points << deepest`` fingerprints on (328 million), shards grow with the data,
    at 9 bytes for each of their fingerprints in memory.
    """
    depth = _depth(count, shard_points, deepest)
    sample, reach = _sampled(nodes, sample_per_shard << depth), bits // PARTS
    dealt = [leaves(build(sample, mask, depth), i, reach) for i, mask in enumerate(QUARTERS)]

    def to_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for quarter, (start, leaf, home) in enumerate(dealt):
                value = ((x >> np.uint64(WIDTH * quarter)) & np.uint64(0xFFFF)).astype(np.int64)
                n = start[value + 1] - start[value]
                place = np.arange(n.sum()) + np.repeat(start[value] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
                kinds = (np.full(len(place), quarter, np.int32), leaf[place], np.repeat(x, n).view(np.int64), home[place])
                yield pa.RecordBatch.from_arrays([pa.array(k) for k in kinds], ["quarter", "shard", "fp", "home"])

    def star(x: np.ndarray, home: np.ndarray, metrics: list) -> pa.Table:
        order = x.argsort()
        x, home = x[order], home[order]
        label = link(x, home, metrics, bits)
        moved = np.flatnonzero(label != np.arange(len(x)))
        return pa.table({"u": pa.array(x[moved].view(np.int64)), "v": pa.array(x[label[moved]].view(np.int64))})

    def search(table: pa.Table) -> pa.Table:
        quarter = table["quarter"][0].as_py()
        return star(table["fp"].to_numpy().view(np.uint64), table["home"].to_numpy(), [((QUARTERS[quarter],), reach), (halves(quarter), bits // 2)])

    placed = nodes.select("fp").mapInArrow(to_shards, "quarter int, shard int, fp long, home boolean")
    crowded = placed.groupBy("quarter", "shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot * shard_points).collect()
    if not crowded:
        return placed.groupBy("quarter", "shard").applyInArrow(search, "u long, v long")
    names = F.broadcast(nodes.sparkSession.createDataFrame([(r["quarter"], r["shard"]) for r in crowded], "quarter int, shard int"))
    again = _depth(max(r["n"] for r in crowded), shard_points, deepest)
    inside = placed.join(names, ["quarter", "shard"], "left_semi")
    trees = {}
    for quarter in {r["quarter"] for r in crowded}:
        sample = _sampled(inside.filter(F.col("quarter") == quarter), sample_per_shard << again)
        trees[quarter] = [(mask, build(sample, mask, again)) for mask in halves(quarter)]

    def to_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            quarter, shard, fp, home = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            for q in np.unique(quarter).tolist():
                mine = np.flatnonzero(quarter == q)
                for half, (mask, tree) in enumerate(trees[q]):
                    for at, idx, near in deal(tree, fp[mine].view(np.uint64), mask, bits // 2):
                        i = mine[idx]
                        kinds = (quarter[i], shard[i], np.full(len(i), half, np.int32), np.full(len(i), at, np.int32), fp[i], near & home[i])
                        yield pa.RecordBatch.from_arrays([pa.array(k) for k in kinds], ["quarter", "shard", "half", "part", "fp", "home"])

    def search_part(table: pa.Table) -> pa.Table:
        mask = halves(table["quarter"][0].as_py())[table["half"][0].as_py()]
        return star(table["fp"].to_numpy().view(np.uint64), table["home"].to_numpy(), [((mask,), bits // 2)])

    parts = inside.select("quarter", "shard", "fp", "home").mapInArrow(to_parts, "quarter int, shard int, half int, part int, fp long, home boolean")
    calm = placed.join(names, ["quarter", "shard"], "left_anti")
    found = calm.groupBy("quarter", "shard").applyInArrow(search, "u long, v long")
    return found.unionByName(parts.groupBy("quarter", "shard", "half", "part").applyInArrow(search_part, "u long, v long"))


def components(pairs: DataFrame) -> DataFrame:
    """``u, root`` for every node of ``pairs`` (u, v) but the roots: the smallest node of its component, by alternating large and small stars.

    Each round is one join on pre-aggregated minima; a hub's rows are split by the adaptive skew join.
    """
    now = checkpointed(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"))
        large = both.filter("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        joined = large.join(low, F.col("u") == F.col("k")).select("u", "v", "m")
        small = joined.select("u", F.col("m").alias("v")).unionByName(joined.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        now = checkpointed(small.distinct())
        # done when all are stars: no node has two parents and no parent has one
        roots = now.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("u").unionByName(now.select("u").join(now.select(F.col("v").alias("p")), F.col("u") == F.col("p"), "left_semi"))
        if roots.isEmpty():
            return now.select("u", F.col("v").alias("root"))


def near_dedup(docs: DataFrame, bits: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", **tree) -> DataFrame:
    """One row for each input row: ``doc_id, fingerprint, component_id`` (smallest id reachable over links of at most ``bits``).

    Null and empty texts and texts of white space have fingerprint zero and link like any other. Null ids never name a component
    unless all its ids are null. Repeated rows share a fingerprint and so a component. An empty table gives an empty result. Other
    columns are ignored.
    """
    rows = _members(fingerprints(docs, shingle, id_col, text_col), bits, **tree)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_keepers(docs: DataFrame, bits: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", **tree) -> DataFrame:
    """One row ``keep_id, keep_key`` (SHA-256 of the text, null as empty) for each component: of the texts with its smallest id that with
    the smallest key. Components of the same smallest id, or of null ids only, each have their row."""
    rows = _members(fingerprints(docs, shingle, id_col, text_col, True), bits, **tree)
    first = rows.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("text_key", "doc_id")).alias("first"))
    return first.select(F.col("first.doc_id").alias("keep_id"), F.col("first.text_key").alias("keep_key"))


def _members(fps: DataFrame, bits: int, **tree) -> DataFrame:
    """Rows of ``fps`` with the ``root`` (a fingerprint) of their component and its smallest id."""
    fps = checkpointed(fps)
    nodes = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    linked = components(edges(nodes, nodes.count(), bits, **tree))
    rooted = nodes.join(linked, F.col("fp") == F.col("u"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    member = rooted.join(least, "root").select(F.col("fp").alias("own"), "root", "component_id")
    return fps.join(member, F.col("fp") == F.col("own"))
