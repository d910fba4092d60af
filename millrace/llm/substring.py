"""Substring dedup over windows of words, with a count-min prefilter.

First round: each block of documents makes a count-min sketch of its windows, by a rolling hash; partition sketches are merged stripe by
stripe and answered with the cells that count more than one. A count-min estimate is never below the true count, so no repeated window
is lost. Second round: only windows that are estimated repeated are grouped exactly, by the BLAKE2b digest of their bytes (words joined by
one space), with the smallest document of each. Third round: blocks remove the words covered by windows that also start in a smaller
document. Rolling hashes only choose what is looked at; what is equal is told by the digest, of which 104 bits travel.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData

from millrace.llm.blocks import BUFFER, PAIRS, REMOVE, VERDICTS, Cells, block_table, buffers, by_block, find_pairs, gathered, ids_of, judge, lowest, send_pairs, told
from millrace.llm.common import Rolling, byte_table, digests, mix64, word_bounds

_GAP = re.compile(rb"[\x20\x09-\x0D]")
#: High bits of a pair's key are of the rolling hash (to sort and to choose by), low ones of the digest.
LOW = 40
ALL = (1 << 64) - 1


@dataclass
class Part:
    """A buffer of documents, one behind the other, words joined by one space: ends of documents; of each word its document; of each window
    its first word, bytes, document and hash."""

    raw: bytes
    stops: list[int]
    owner: np.ndarray
    word: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray


class Windows:
    """Windows of words of a block. ``mask`` thins the rolling hash (tests force collisions with it)."""

    def __init__(self, size: int, mask: int = ALL) -> None:
        self.size, self.bytes, self.mask = size, byte_table(11), np.uint64(mask)
        self.roll, self.one = Rolling(0xD1342543DE82EF95), Rolling(0x9E3779B97F4A7C15)

    def words(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and hash of each word, a piece at a time, cut at white space."""
        none = np.zeros(0, np.int64)
        found, at = [(none, none, none.astype(np.uint64))], 0
        while at < len(raw):
            gap = _GAP.search(raw, min(len(raw), at + BUFFER))
            end = gap.start() + 1 if gap else len(raw)
            part = np.frombuffer(raw, np.uint8, end - at, at)
            a, b = word_bounds(part)
            found.append((a + at, b + at, self.roll.ranges(self.roll.prefix(self.bytes[part]), a, b)))
            at = end
        return tuple(np.concatenate([x[i] for x in found]) for i in range(3))

    def parts(self, table: pa.Table) -> list[Part]:
        """All buffers of a block; ``doc`` counts the rows of the block, ``owner`` those of the buffer."""
        out = []
        for first, texts in buffers(table):
            texts = [b" ".join(t.split()) for t in texts]
            raw, stops = b"\n".join(texts), np.cumsum([len(t) + 1 for t in texts])
            a, b, h = self.words(raw)
            owner = np.searchsorted(stops, a, side="right")
            n = max(0, len(h) - self.size + 1)
            ok = np.flatnonzero(owner[:n] == owner[self.size - 1 :]) if n else np.zeros(0, np.int64)
            out.append(Part(raw, (stops - 1).tolist(), owner.astype(np.int32), ok.astype(np.int32), a[ok].astype(np.int32), b[ok + self.size - 1].astype(np.int32), (owner[ok] + first).astype(np.int32), self.one.windows(h, self.size)[ok] & self.mask))
        return out


def _joined(parts: list[Part], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hash and document id of every window of a block."""
    h = np.concatenate([np.zeros(0, np.uint64), *(p.hash for p in parts)])
    doc = np.concatenate([np.zeros(0, np.int32), *(p.doc for p in parts)])
    return h, ids[doc] if len(doc) else np.zeros(0, np.int64)


def _pairs(parts: list[Part], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The exact names (key, second) of the chosen windows of a block, in order."""
    k, s, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], 0
    for p in parts:
        i = np.flatnonzero(chosen[at : at + len(p.hash)])
        at += len(p.hash)
        one, two = digests(p.raw, p.start[i], p.end[i])
        k.append((p.hash[i] >> np.uint64(LOW) << np.uint64(LOW)) | (two & np.uint64((1 << LOW) - 1)))
        s.append(one)
    return np.concatenate(k), np.concatenate(s)


def dedup_windows(docs: DataFrame, window: int = 13, rows: int = 2, cells_per_byte: float = 1.25, block_bytes: int = 4 << 20, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text", mask: int = ALL) -> DataFrame:
    """One row for each input row: ``doc_id, n_words, n_removed, kept_sha256`` and, if asked for, ``kept_text``.

    A word goes if a window of ``window`` consecutive words covers it whose words also start in a document with a smaller id; windows
    are judged on the input. ``cells_per_byte`` sizes a row of the sketch by the bytes of all texts, so its load is the same at any size.
    ``mask`` thins the rolling hash: it changes what is compared, not the result.

    Null, empty and short texts have no window and keep all their words. Repeated rows of one id don't remove each other. A null id
    stands behind all others. An empty table gives an empty result. Other columns are ignored. Ids must be whole numbers.
    """
    placed, n_blocks, total, n_ranges = by_block(docs, block_bytes, id_col, text_col)
    cells = Cells(max(16, int(np.ceil(np.log2(max(1.0, total * cells_per_byte))))), rows, n_ranges)

    def sketch(key: tuple, table: pa.Table) -> pa.Table:
        table = block_table(table)
        h, d = _joined(Windows(window, mask).parts(table), ids_of(table))
        return cells.send(key[0].as_py(), h, d)

    def candidates(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        table = block_table(left)
        parts = Windows(window, mask).parts(table)
        h, d = _joined(parts, ids_of(table))
        hot = cells.repeated(h, right)
        k, s, d, _ = lowest(*_pairs(parts, hot), d[hot])
        return send_pairs(key[0].as_py(), k, s, d, n_ranges)

    def block(df: DataFrame) -> GroupedData:
        return gathered(df, "block", n_blocks)

    sketches = block(placed).applyInArrow(sketch, Cells.SENT)
    answers = gathered(sketches, "stripe", n_ranges, "line").applyInArrow(Cells.merge, Cells.ANSWER)
    pairs = block(placed).cogroup(block(answers)).applyInArrow(candidates, PAIRS)
    verdicts = gathered(pairs, "bucket", n_ranges).applyInArrow(lambda t: judge(t, False), VERDICTS)
    kept = f"doc_id long, n_words long, n_removed long, kept_sha256 string{', kept_text string' if with_text else ''}"
    return block(placed).cogroup(block(verdicts)).applyInArrow(_remover(window, mask, with_text), kept)


def _gone(parts: list[Part], ids: np.ndarray, right: pa.Table) -> np.ndarray:
    """Whether each window of a block goes: another block, or this one, has it in a smaller document.

    Only windows whose rolling hash was told of, or stands in several documents of the block, are named exactly."""
    h, d = _joined(parts, ids)
    gone_k, gone_s = told(right, REMOVE)
    heard = np.zeros(1 << 64 - LOW, bool)
    heard[gone_k >> np.uint64(LOW)] = True
    some = heard[h >> np.uint64(LOW)]
    order = h.argsort()
    first = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]])) if len(h) else np.zeros(0, np.int64)
    if len(first):
        several = np.minimum.reduceat(d[order], first) != np.maximum.reduceat(d[order], first)
        some[order] |= np.repeat(several, np.diff(np.append(first, len(h))))
    one, two, least, back = lowest(*_pairs(parts, some), d[some])
    gone = np.zeros(len(h), bool)
    gone[some] = (find_pairs(gone_k, gone_s, one, two) >= 0)[back] | (least[back] < d[some])
    return gone


def _remover(window: int, mask: int, with_text: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        out, left = [], block_table(left)
        parts = Windows(window, mask).parts(left)
        gone, at = _gone(parts, ids_of(left), right), 0
        for p in parts:
            cover = np.zeros(len(p.owner) + 1, np.int64)
            hit = p.word[gone[at : at + len(p.hash)]]
            at += len(p.hash)
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + window, -1)
            keep = np.cumsum(cover[:-1]) == 0
            first = np.searchsorted(p.owner, np.arange(len(p.stops) + 1))
            for i, (a, b) in enumerate(zip([0, *(x + 1 for x in p.stops[:-1])], p.stops, strict=True)):
                text, stay, n = p.raw[a:b], keep[first[i] : first[i + 1]], int(first[i + 1] - first[i])
                left_out = n - int(stay.sum())
                if left_out:
                    text = b" ".join(itertools.compress(text.split(), stay.tolist()))
                out.append((n, left_out, hashlib.sha256(text).hexdigest(), *([text.decode()] if with_text else [])))
        cols = list(zip(*out, strict=True)) if out else [()] * (3 + with_text)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
        return pa.table([left["doc_id"].combine_chunks(), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=False))], names=names[: 4 + with_text])

    return remove
