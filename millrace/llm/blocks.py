"""Blocks of documents and compact messages between them.

Both kinds of substring dedup work in rounds. Documents stand in blocks (by a hash of the id, a few megabytes of text each). In a
round every block sends sorted arrays of hashes to ranges of the hash space, one row for each range that it has something for; a
range merges what blocks sent and answers each block. Texts travel as compressed pages and arrays as compressed binary, so that a round costs a few bytes for each
hash. All rounds are one plan: the exchange that deals texts to blocks is made once and reused.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from millrace.llm.common import layout, mix64

LAST = (1 << 63) - 1
BUFFER = 1 << 17


PAGES = "block int, ids binary, langs array<string>, sizes binary, texts binary"


def to_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (block, id, language, text) as compressed pages of one block each; a task holds at most 32 MB of them."""
    held: dict[int, list[tuple]] = defaultdict(list)
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for block, rows in held.items():
            raw = [r[2] for r in rows]
            ids, sizes = np.array([r[0] for r in rows], np.int64).view(np.uint64), np.array([len(x) for x in raw], np.uint64)
            page = zstandard.ZstdCompressor(level=3).compress(b"".join(raw))
            columns = [pa.array([block], pa.int32()), pa.array([pack(ids)]), pa.array([[r[1] for r in rows]], pa.list_(pa.string())), pa.array([pack(sizes)]), pa.array([page])]
            yield pa.RecordBatch.from_arrays(columns, ["block", "ids", "langs", "sizes", "texts"])
        held.clear()

    for b in batches:
        for block, key, lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            held[block].append((LAST if key is None else key, lang, raw))
            size += len(raw) + 32
            if size >= 32 << 20:
                yield from flush()
                size = 0
    yield from flush()


def pages(table: pa.Table) -> Iterator[tuple[np.ndarray, list[str | None], list[bytes]]]:
    """Ids (a null one as LAST), languages and texts of each page of a block."""
    for ids, langs, sizes, page in zip(table["ids"], table["langs"], table["sizes"], table["texts"], strict=True):
        ends = np.cumsum(unpack(sizes.as_py()), dtype=np.uint64).tolist()
        raw = zstandard.ZstdDecompressor().decompress(page.as_py())
        yield unpack(ids.as_py(), np.int64), langs.as_py(), [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def block_table(table: pa.Table) -> pa.Table:
    """``doc_id, text`` (as bytes) of all pages of a block."""
    found = list(pages(table))
    ids = np.concatenate([np.zeros(0, np.int64), *(i for i, _, _ in found)])
    return pa.table({"doc_id": pa.array(ids, mask=ids == LAST), "text": pa.array([t for _, _, raws in found for t in raws], pa.large_binary())})


def by_block(docs: DataFrame, block_bytes: int, id_col: str, text_col: str) -> tuple[DataFrame, int, int, int]:
    """Pages of blocks, the number of blocks, the bytes of all texts, and the number of ranges that blocks talk to. Null text becomes empty.
    The block depends on the id and on the text, so that different texts of one id, or without id, spread."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n, ranges = layout(docs.sparkSession, size, block_bytes)
    rows = docs.select(F.pmod(F.xxhash64(id_col, text_col), F.lit(n)).cast("int").alias("block"), F.col(id_col).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInArrow(to_pages, PAGES), n, size, ranges


def gathered(df: DataFrame, key: str, n: int, *more: str) -> GroupedData:
    """Groups of ``key`` (0 to n - 1), a task for each: hashing so few keys would put several of them in one task."""
    return df.repartitionById(n, key).groupBy(key, *more)


def ids_of(table: pa.Table) -> np.ndarray:
    """Ids as numbers; a null id stands behind all others."""
    return table["doc_id"].combine_chunks().fill_null(LAST).to_numpy(zero_copy_only=False)


def buffers(table: pa.Table) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a block in groups of about a megabyte, with the index of the first."""
    start, held, out = 0, 0, []
    for i, text in enumerate(table["text"]):
        out.append(raw := text.as_buffer().to_pybytes())
        held += len(raw) + 1
        if held >= BUFFER:
            yield start, out
            start, held, out = i + 1, 0, []
    if out:
        yield start, out


def pack(a: np.ndarray) -> bytes:
    """An array as compressed byte planes: planes of sorted or small numbers nearly vanish."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"")


def unpack(data: bytes, kind: type = np.uint64) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel() if len(raw) else np.zeros(0, kind)


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def runs(a: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values."""
    return np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)


def lowest(key: np.ndarray, second: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, second), sorted, with the smallest doc of each; and for each input the index of its pair."""
    order = key.argsort()
    k, s = key[order], second[order]
    same = k[1:] == k[:-1]
    mixed = same & (s[1:] != s[:-1])
    if mixed.any():  # only keys that stand with different seconds need the second sort
        group = np.cumsum(np.concatenate([[0], ~same]))
        hit = np.zeros(group[-1] + 1, bool)
        hit[group[1:][mixed]] = True
        at = np.flatnonzero(hit[group])
        part = order[at]
        order[at] = part[np.lexsort((second[part], key[part]))]
        s = second[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])]) if len(k) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    back = np.empty(len(k), np.int64)
    back[order] = np.cumsum(new) - 1
    return k[first], s[first], np.minimum.reduceat(doc[order], first) if len(first) else doc[:0], back


def find_pairs(key: np.ndarray, second: np.ndarray, k: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Index of each pair (k, s) in the sorted distinct pairs (key, second), -1 where it isn't there."""
    out = np.full(len(k), -1, np.int64)
    if not len(key):
        return out
    at = np.minimum(np.searchsorted(key, k), len(key) - 1)
    i = np.flatnonzero(key[at] == k)
    at = at[i]
    while len(i):  # more than one step only where two pairs share a 64-bit key
        hit = second[at] == s[i]
        out[i[hit]] = at[hit]
        i, at = i[~hit], at[~hit] + 1
        more = at < len(key)
        more[more] = key[at[more]] == k[i[more]]
        i, at = i[more], at[more]
    return out


class Cells:
    """Cells of counters over hashes: ``rows`` independent rows of ``2**bits`` cells, in ``stripes`` ranges."""

    def __init__(self, bits: int, rows: int, stripes: int) -> None:
        self.bits, self.rows, self.stripes = bits, rows, stripes
        self.width = -(-(1 << bits) // stripes)

    def cell(self, key: np.ndarray, row: int) -> np.ndarray:
        return mix64(key + np.uint64(0x9E3779B97F4A7C15 * (row + 1) & LAST)) >> np.uint64(64 - self.bits)

    def sketch(self, key: np.ndarray, doc: np.ndarray, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Cells that a block touches, sorted, and whether it counts more than one there. A key counts once for each document."""
        order = key.argsort()
        first = runs(key[order])
        if not len(first):
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        many = np.minimum.reduceat(doc[order], first) != np.maximum.reduceat(doc[order], first)
        cells = self.cell(key[order][first], row)
        order = cells.argsort()
        start = runs(cells[order])
        return cells[order][start], np.add.reduceat(1 + many[order].astype(np.int64), start) > 1

    def send(self, block: int, key: np.ndarray, doc: np.ndarray) -> pa.Table:
        out = {n: [] for n in ("stripe", "line", "block", "cells", "many")}
        for row in range(self.rows):
            cells, many = self.sketch(key, doc, row)
            for stripe, a, b in self.ranges(cells):
                for n, v in zip(out, (stripe, row, block, pack_sorted(cells[a:b]), np.packbits(many[a:b]).tobytes()), strict=True):
                    out[n].append(v)
        return pa.table(out, schema=pa.schema([("stripe", pa.int32()), ("line", pa.int32()), ("block", pa.int32()), ("cells", pa.binary()), ("many", pa.binary())]))

    def ranges(self, cells: np.ndarray) -> Iterator[tuple[int, int, int]]:
        cut = np.searchsorted(cells, np.arange(self.stripes + 1, dtype=np.uint64) * np.uint64(self.width))
        return ((s, a, b) for s, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if b > a)

    SENT = "stripe int, line int, block int, cells binary, many binary"
    ANSWER = "block int, line int, stripe int, hot binary"

    @staticmethod
    def merge(table: pa.Table) -> pa.Table:
        """Counts of one stripe of one row over all blocks; each block learns which of its cells count more than one."""
        sent = [unpack_sorted(c.as_py()) for c in table["cells"]]
        many = [np.unpackbits(np.frombuffer(m.as_py(), np.uint8), count=len(c)) for m, c in zip(table["many"], sent, strict=True)]
        cells, counts = np.concatenate(sent), 1 + np.concatenate(many)
        order = cells.argsort()
        first = runs(cells[order])
        hot = cells[order][first][np.add.reduceat(counts[order].astype(np.int64), first) > 1]
        found = []
        for c in sent:
            at = np.minimum(np.searchsorted(hot, c), max(0, len(hot) - 1))
            found.append(np.packbits(hot[at] == c if len(hot) else np.zeros(len(c), bool)).tobytes())
        return pa.table({"block": table["block"], "line": table["line"], "stripe": table["stripe"], "hot": pa.array(found, pa.binary())})

    def repeated(self, key: np.ndarray, answer: pa.Table) -> np.ndarray:
        """For each key whether its smallest counter is above one."""
        told = {(r["line"], r["stripe"]): r["hot"] for r in answer.select(["line", "stripe", "hot"]).to_pylist()}
        out = np.ones(len(key), bool)
        for row in range(self.rows):
            cells = self.cell(key, row)
            order = cells.argsort()
            start = runs(cells[order])
            cells = cells[order][start]
            hot = np.zeros(len(cells), bool)
            for stripe, a, b in self.ranges(cells):
                hot[a:b] = np.unpackbits(np.frombuffer(told[row, stripe], np.uint8), count=b - a)
            out[order] &= np.repeat(hot, np.diff(np.append(start, len(key))))
        return out


PAIRS = "bucket int, block int, k binary, s binary, doc binary"
VERDICTS = "block int, kind int, k binary, s binary"
_VERDICTS = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("k", pa.binary()), ("s", pa.binary())])
REMOVE, REFINE = 1, 2


def send_pairs(block: int, k: np.ndarray, s: np.ndarray, doc: np.ndarray, buckets: int) -> pa.Table:
    """Sorted distinct pairs of a block with their smallest doc, a row for each range of ``k``."""
    step = (1 << 64) // buckets + 1
    cut = [*np.searchsorted(k, np.array([i * step for i in range(buckets)], np.uint64)).tolist(), len(k)]
    rows = [(i, block, pack_sorted(k[a:b]), pack(s[a:b]), pack(doc[a:b].view(np.uint64))) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["bucket", "block", "k", "s", "doc"])


def judge(table: pa.Table, refine: bool) -> pa.Table:
    """Verdicts on the pairs of a range: REMOVE for a block's pair if another block has it in a smaller document.

    With ``refine``, REFINE for the pair in the smallest document if its ``k`` also stands with another ``s``.
    """
    ks = [unpack_sorted(x.as_py()) for x in table["k"]]
    ss = [unpack(x.as_py()) for x in table["s"]]
    docs = [unpack(x.as_py(), np.int64) for x in table["doc"]]
    k, s, least, back = lowest(np.concatenate(ks), np.concatenate(ss), np.concatenate(docs))
    first = runs(k)
    several = np.repeat(np.diff(np.append(first, len(k))) > 1, np.diff(np.append(first, len(k))))
    out, at = [], 0
    for block, bk, bs, bd in zip(table["block"].to_pylist(), ks, ss, docs, strict=True):
        group = back[at : at + len(bk)]
        at += len(bk)
        above = bd > least[group]
        for kind, chosen in ((REMOVE, above), (REFINE, ~above & several[group] if refine else None)):
            if chosen is not None and chosen.any():
                out.append({"block": block, "kind": kind, "k": pack_sorted(bk[chosen]), "s": pack(bs[chosen])})
    return pa.Table.from_pylist(out, schema=_VERDICTS)


def told(answer: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of one kind of verdict, sorted by key."""
    rows = [r for r in answer.to_pylist() if r["kind"] == kind]
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    k, s = np.concatenate([unpack_sorted(r["k"]) for r in rows]), np.concatenate([unpack(r["s"]) for r in rows])
    order = k.argsort()
    return k[order], s[order]
