"""Substring dedup over bytes by bucket-pointer refinement of suffixes.

Only the order of suffixes to a depth of ``length`` bytes matters, so no bucket is refined further. To keep what is sorted small, the
suffixes of a document are taken in runs: a neighbourhood of suffixes whose lowest q-gram (by hash; q is half the depth) is the same one,
which depends on the bytes of each suffix alone.

1. Initial buckets, by q-gram: blocks of documents count their lowest q-grams in counters; a bucket with one document is done.
2. Members of the other buckets are sorted by bucket and by the identifier of the whole run, down to its last offset. A run that also
   stands in a smaller document is settled with all its suffixes. One that is alone in its bucket has no partner.
3. Only where a bucket still holds different runs, the refinement goes on to single suffixes, for the smallest document of each run: they
   are sorted by the identifier of all their ``length`` bytes, and that settles them.
4. Blocks remove the bytes covered by suffixes with a partner in a smaller document.

The identifier of a bucket at full depth is the BLAKE2b digest of its bytes, not its place in a sorted array: a place would have to be asked
for, suffix by suffix, from the range that sorted it, and sent back, which is several times the input at each round. Rolling hashes only
choose the buckets that are looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from millrace.llm.blocks import BUFFER, PAIRS, REFINE, REMOVE, VERDICTS, Cells, block_table, by_block, find_pairs, gathered, ids_of, judge, lowest, send_pairs, told
from millrace.llm.common import Rolling, byte_table, digests, mix64

#: Low bits of a sliding minimum hold the place in a buffer (of at most 4 MB), the others the hash. Always as many, so that ties fall alike.
PLACE = np.uint64((1 << 22) - 1)
ALL = (1 << 64) - 1


@dataclass
class Part:
    """A buffer of pieces of documents, and its runs of suffixes: first and last one, document, hash of the lowest q-gram."""

    pieces: list[tuple[int, int, int]]  # document, offset in it, bytes
    raw: bytes
    first: np.ndarray
    last: np.ndarray
    doc: np.ndarray
    low: np.ndarray


class Suffixes:
    """Suffixes of a block. ``mask`` thins the hash of a bucket (tests force collisions with it)."""

    def __init__(self, length: int, mask: int = ALL) -> None:
        self.length, self.q, self.mask = length, -(-length // 2), np.uint64(mask)
        self.reach, self.bytes, self.roll = length - self.q, byte_table(23), Rolling(0x9E3779B97F4A7C15)

    def parts(self, table: pa.Table) -> list[Part]:
        """Buffers; a longer text comes in pieces that overlap by a suffix's depth less one."""
        return list(self._parts(table))

    def _parts(self, table: pa.Table) -> Iterator[Part]:
        held: list[tuple[int, int, bytes]] = []
        size = 0
        for i, text in enumerate(table["text"]):
            raw = text.as_buffer().to_pybytes()
            for at in range(0, max(1, len(raw) - self.length + 1), BUFFER):
                piece = raw[at : at + BUFFER + self.length - 1] if len(raw) > BUFFER + self.length - 1 else raw
                held.append((i, at, piece))
                size += len(piece)
                if size >= BUFFER:
                    yield self.part(held)
                    held, size = [], 0
                if piece is raw:
                    break
        if held:
            yield self.part(held)

    def part(self, held: list[tuple[int, int, bytes]]) -> Part:
        pieces = [(i, at, len(b)) for i, at, b in held]
        joined = b"".join(b for _, _, b in held)
        raw = np.frombuffer(joined, np.uint8)
        n = len(raw) - self.length + 1
        none = np.zeros(0, np.int32)
        if n <= 0:
            return Part(pieces, joined, none, none, none, none.astype(np.uint64))
        gram = self.roll.windows(self.bytes[raw], self.q)
        low = (gram & ~PLACE) | np.arange(len(gram), dtype=np.uint64)
        span, width = 1, self.reach + 1
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[: span - width], low[width - span :])
        low = (low & PLACE).astype(np.int64)
        lens = np.array([p[2] for p in pieces])
        stop = np.repeat(np.cumsum(lens), lens)[:n]  # end of the piece that a suffix starts in
        owner = np.repeat(np.arange(len(pieces)), lens)[:n]
        ok = np.arange(n) + self.length <= stop
        edge = np.concatenate([[True], (low[1:] != low[:-1]) | (owner[1:] != owner[:-1]) | (ok[1:] != ok[:-1]), [True]])
        at = np.flatnonzero(edge)
        first, last = at[:-1], at[1:] - 1
        use = ok[first]
        first, last = first[use], last[use]
        doc = np.array([p[0] for p in pieces], np.int32)[owner[first]]
        # mixed again, as minima crowd near zero
        return Part(pieces, joined, first.astype(np.int32), last.astype(np.int32), doc, mix64(gram[low[first]]) & self.mask)


def _joined(parts: list[Part], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document id of every run of a block."""
    low = np.concatenate([np.zeros(0, np.uint64), *(p.low for p in parts)])
    doc = np.concatenate([np.zeros(0, np.int32), *(p.doc for p in parts)])
    return low, ids[doc] if len(doc) else np.zeros(0, np.int64)


def _runs(parts: list[Part], chosen: np.ndarray, length: int) -> np.ndarray:
    """Identifiers of the chosen runs of a block, from all their bytes."""
    out, at = [np.zeros(0, np.uint64)], 0
    for p in parts:
        i = np.flatnonzero(chosen[at : at + len(p.low)])
        at += len(p.low)
        out.append(digests(p.raw, p.first[i], p.last[i] + length)[0])
    return np.concatenate(out)


def _suffixes(parts: list[Part], chosen: np.ndarray, ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Identifiers (104 bits in two numbers) and document ids of all suffixes in the chosen runs of a block, in order."""
    k, t, d, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for p in parts:
        i = np.flatnonzero(chosen[at : at + len(p.low)])
        at += len(p.low)
        if len(i):
            place = spread(p.first[i], p.last[i])
            one, two = digests(p.raw, place, place + length)
            k.append(one)
            t.append(two >> np.uint64(24))
            d.append(np.repeat(ids[p.doc[i]], p.last[i] - p.first[i] + 1))
    return np.concatenate(k), np.concatenate(t), np.concatenate(d)


def spread(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All places from each first to its last."""
    n = last - first + 1
    return np.arange(n.sum()) + np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n)


def _settled(parts: list[Part], ids: np.ndarray, right: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run of a block whether it goes as a whole, and whether its suffixes are to be refined.

    Only runs of a bucket that was told of, or has several documents of the block, get an identifier."""
    low, d = _joined(parts, ids)
    remove, refine = told(right, REMOVE), told(right, REFINE)
    heard = np.unique(np.concatenate([remove[0], refine[0]]))
    some = np.zeros(len(low), bool)
    if len(heard):
        some = heard[np.minimum(np.searchsorted(heard, low), len(heard) - 1)] == low
    if len(low):
        order = low.argsort()
        first = np.flatnonzero(np.concatenate([[True], low[order][1:] != low[order][:-1]]))
        several = np.minimum.reduceat(d[order], first) != np.maximum.reduceat(d[order], first)
        some[order] |= np.repeat(several, np.diff(np.append(first, len(low))))
    one, two, least, back = lowest(low[some], _runs(parts, some, length), d[some])
    gone, open_ = np.zeros(len(low), bool), np.zeros(len(low), bool)
    gone[some] = (find_pairs(*remove, one, two) >= 0)[back] | (least[back] < d[some])
    open_[some] = (find_pairs(*refine, one, two) >= 0)[back]
    return gone, open_ & ~gone


def dedup_bytes(docs: DataFrame, length: int = 50, cells_per_byte: float = 0.6, block_bytes: int = 4 << 20, with_bytes: bool = False, id_col: str = "doc_id", text_col: str = "text", mask: int = ALL) -> DataFrame:
    """One row for each input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked for, ``spans`` and ``kept``.

    A byte goes if a string of ``length`` bytes covers it that also starts in a document with a smaller id; strings are judged on the
    input and never cross documents. ``spans`` are the removed ranges (start, end), ``kept`` the bytes that stay. ``mask`` thins the hash of
    buckets: it changes what is compared, not the result.

    Null and empty texts and texts shorter than ``length`` keep all. Repeated rows of one id don't remove each other. A null id
    stands behind all others. An empty table gives an empty result. Other columns are ignored. Ids must be whole numbers.
    """
    placed, n_blocks, total, n_buckets = by_block(docs, block_bytes, id_col, text_col)
    cells = Cells(max(16, int(np.ceil(np.log2(max(1.0, total * cells_per_byte))))), 1, n_buckets)

    def initial(key: tuple, table: pa.Table) -> pa.Table:
        table = block_table(table)
        low, d = _joined(Suffixes(length, mask).parts(table), ids_of(table))
        return cells.send(key[0].as_py(), low, d)

    def members(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        table = block_table(left)
        parts = Suffixes(length, mask).parts(table)
        low, d = _joined(parts, ids_of(table))
        many = cells.repeated(low, right)
        k, r, d, _ = lowest(low[many], _runs(parts, many, length), d[many])
        return send_pairs(key[0].as_py(), k, r, d, n_buckets)

    def refined(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        table = block_table(left)
        parts, ids = Suffixes(length, mask).parts(table), ids_of(table)
        _, refine = _settled(parts, ids, right, length)
        k, t, d, _ = lowest(*_suffixes(parts, refine, ids, length))
        return send_pairs(key[0].as_py(), k, t, d, n_buckets)

    def block(df: DataFrame) -> GroupedData:
        return gathered(df, "block", n_blocks)

    counted = gathered(block(placed).applyInArrow(initial, Cells.SENT), "stripe", n_buckets, "line").applyInArrow(Cells.merge, Cells.ANSWER)
    by_run = gathered(block(placed).cogroup(block(counted)).applyInArrow(members, PAIRS), "bucket", n_buckets).applyInArrow(lambda t: judge(t, True), VERDICTS)
    by_suffix = gathered(block(placed).cogroup(block(by_run)).applyInArrow(refined, PAIRS), "bucket", n_buckets).applyInArrow(lambda t: judge(t, False), VERDICTS)
    verdicts = by_run.withColumn("depth", F.lit(1)).unionByName(by_suffix.withColumn("depth", F.lit(2)))
    kept = f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string{', spans array<struct<start: long, end: long>>, kept binary' if with_bytes else ''}"
    return block(placed).cogroup(block(verdicts)).applyInArrow(_remover(length, mask, with_bytes), kept)


def _remover(length: int, mask: int, with_bytes: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        left = block_table(left)
        parts, ids = Suffixes(length, mask).parts(left), ids_of(left)
        depth = right["depth"].to_numpy() if right.num_rows else np.zeros(0, int)
        gone, refine = _settled(parts, ids, right.filter(pa.array(depth == 1)), length)
        k, t, d = _suffixes(parts, refine, ids, length)
        one, two, least, back = lowest(k, t, d)
        single = (find_pairs(*told(right.filter(pa.array(depth == 2)), REMOVE), one, two) >= 0)[back] | (least[back] < d)
        masks: dict[int, np.ndarray] = {}
        texts = left["text"]
        out: list[tuple | None] = [None] * left.num_rows
        at = at_single = 0

        def finish(i: int, raw: np.ndarray, hidden: np.ndarray) -> None:
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hidden.view(np.int8), [0]])))
            stay = raw[~hidden].tobytes() if len(edge) else raw.tobytes()
            row = (len(raw), len(raw) - len(stay), len(edge) // 2, hashlib.sha256(stay).hexdigest())
            out[i] = (*row, [{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)], stay) if with_bytes else row

        for p in parts:
            raw = np.frombuffer(p.raw, np.uint8)
            n = len(p.low)
            whole, some = gone[at : at + n], refine[at : at + n]
            at += n
            cover = np.zeros(len(raw) + 1, np.int64)
            np.add.at(cover, p.first[whole], 1)
            np.add.at(cover, p.last[whole] + length, -1)
            place = spread(p.first[some], p.last[some]) if some.any() else p.first[:0]
            hit = place[single[at_single : at_single + len(place)]]
            at_single += len(place)
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + length, -1)
            hidden = np.cumsum(cover[:-1]) > 0
            start = 0
            for i, offset, size in p.pieces:
                whole_size = texts[i].as_buffer().size
                if size == whole_size:
                    finish(i, raw[start : start + size], hidden[start : start + size])
                else:
                    m = masks.setdefault(i, np.zeros(whole_size, bool))
                    m[offset : offset + size] |= hidden[start : start + size]
                start += size
        for i, hidden in masks.items():
            finish(i, np.frombuffer(texts[i].as_buffer(), np.uint8), hidden)
        cols = list(zip(*out, strict=True)) if out else [()] * (4 + 2 * with_bytes)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
        return pa.table([left["doc_id"].combine_chunks(), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=False))], names=names[: 5 + 2 * with_bytes])

    return remove
