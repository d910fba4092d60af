"""Progressive JPEG in numpy, many pictures at a time.

A picture is three components with 4:2:0 sampling. Its coefficients travel in seven scans: DC with one bit held back, luma AC in two
spectral bands, the upper one with a bit held back, chroma AC, and then refinements of DC and of the upper luma band. Restart
intervals are short, so that a batch of pictures offers thousands of independent bit streams, which are read in lockstep.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: (components, first and last coefficient, bits held back before and after)
SCANS = (
    ((0, 1, 2), 0, 0, 0, 1),
    ((0,), 1, 5, 0, 0),
    ((0,), 6, 63, 0, 1),
    ((1,), 1, 63, 0, 0),
    ((2,), 1, 63, 0, 0),
    ((0, 1, 2), 0, 0, 1, 0),
    ((0,), 6, 63, 1, 0),
)
#: Blocks (AC) or units of six blocks (DC) in a restart interval.
INTERVAL = 4
SAMPLING = ((2, 2), (1, 1), (1, 1))


def _zigzag() -> np.ndarray:
    """Row-major place of each coefficient in zigzag order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


SCALE = 1 << 13


@lru_cache(maxsize=1)
def basis() -> np.ndarray:
    """Inverse transform from zigzag coefficients to pixels in whole numbers over SCALE: sums in doubles are exact in any order."""
    k = np.arange(8)
    c = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, np.sqrt(0.125), 0.5)[:, None]
    return np.rint(np.einsum("ux,vy->uvxy", c, c).reshape(64, 64)[_zigzag()] * SCALE)


class Huffman:
    """A canonical code given by the length of each symbol's word."""

    def __init__(self, lengths: dict[int, int]) -> None:
        self.symbols = sorted(lengths, key=lambda s: lengths[s])
        self.counts = [sum(n == i for n in lengths.values()) for i in range(1, 17)]
        self.code, self.length = np.zeros(256, np.uint64), np.zeros(256, np.int64)
        self.look, word, last = np.zeros((2, 1 << 16), np.uint8), 0, 0
        for s in self.symbols:
            word <<= lengths[s] - last
            last = lengths[s]
            self.code[s], self.length[s] = word, last
            self.look[:, word << (16 - last) : (word + 1) << (16 - last)] = [[s], [last]]
            word += 1

    @classmethod
    def read(cls, counts: bytes, symbols: bytes) -> Huffman:
        lengths = np.repeat(np.arange(1, 17), np.frombuffer(counts, np.uint8))
        return cls(dict(zip(symbols, lengths.tolist(), strict=True)))

    def segment(self, kind: int) -> bytes:
        body = bytes([kind, *self.counts, *self.symbols])
        return b"\xff\xc4" + struct.pack(">H", len(body) + 2) + body


@lru_cache(maxsize=1)
def tables() -> tuple[Huffman, Huffman, Huffman]:
    """Codes for DC, for first AC scans (dense bytes of text: no runs, four to six bits) and for refinements (mostly nothing new)."""
    dc = Huffman(dict.fromkeys(range(12), 4))
    common = {0x04: 1, 0x03: 2, 0x06: 3, 0x02: 4, 0x05: 6, 0x01: 7, 0x07: 7}
    ac = Huffman(common | {s: 13 for s in [0x00, 0xF0, *(16 * r + n for r in range(16) for n in range(1, 11))] if s not in common})
    return dc, ac, Huffman({0x00: 1, 0x01: 2} | {s: 8 for s in [0xF0, *(16 * r + 1 for r in range(1, 16))]})


@lru_cache(maxsize=4096)
def unit_order(wide: int, high: int) -> np.ndarray:
    """Blocks of a picture of ``wide`` x ``high`` units, as the interleaved DC scans visit them. Blocks are numbered luma first."""
    y, x = np.divmod(np.arange(wide * high), wide)
    luma = [(2 * y + a) * 2 * wide + 2 * x + b for a in (0, 1) for b in (0, 1)]
    return np.stack([*luma, 4 * wide * high + y * wide + x, 5 * wide * high + y * wide + x], axis=1).ravel()


@dataclass
class Layout:
    """Where the blocks of the pictures of a batch stand, and the visits of a scan: block, and restart interval of each visit."""

    wide: np.ndarray
    high: np.ndarray

    def __post_init__(self) -> None:
        self.units = self.wide * self.high
        self.base = 6 * np.concatenate([[0], np.cumsum(self.units)])

    def visits(self, parts: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Block and interval of each visit, and the number of intervals of each picture."""
        if len(parts) > 1:
            blocks = np.concatenate([b + unit_order(w, h) for b, w, h in zip(self.base.tolist(), self.wide.tolist(), self.high.tolist(), strict=False)])
            each, span = 6 * self.units, 6 * INTERVAL
        else:
            each, span = self.units * (4 if parts[0] == 0 else 1), INTERVAL
            start = self.base[:-1] + self.units * (0, 4, 5)[parts[0]]
            blocks = _within(each) + np.repeat(start, each)
        n = -(-each // span)
        return blocks, _within(each) // span + np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), each), n


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of consecutive groups."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _size(v: np.ndarray) -> np.ndarray:
    """Bits of the magnitude."""
    return np.frexp(np.abs(v).astype(np.float32))[1].astype(np.int64)


def _amplitude(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (1 << size) - 1, v).astype(np.uint64)


def _held_back(v: np.ndarray, bits: int) -> np.ndarray:
    """Towards zero without the last bits, as AC scans have it."""
    return np.sign(v) * (np.abs(v) >> bits)


# ---- writing ------------------------------------------------------------------------------------


def _dc_first(c: np.ndarray, interval: np.ndarray, table: Huffman, low: int) -> tuple[np.ndarray, ...]:
    v = (c[:, 0] >> low).reshape(-1, 6)
    new = np.concatenate([[True], interval[6::6] != interval[:-6:6]])
    diff = np.empty_like(v)
    diff[:, 1:4] = v[:, 1:4] - v[:, :3]  # luma follows luma, chroma the unit before
    before = np.vstack([np.zeros((1, 6), v.dtype), v[:-1]])
    before[new] = 0
    diff[:, 0], diff[:, 4:] = v[:, 0] - before[:, 3], v[:, 4:] - before[:, 4:]
    diff = diff.ravel().astype(np.int64)
    size = _size(diff)
    return (table.code[size] << size.astype(np.uint64)) | _amplitude(diff, size), table.length[size] + size, interval


def _ac_first(c: np.ndarray, interval: np.ndarray, table: Huffman, first: int, last: int, low: int) -> tuple[np.ndarray, ...]:
    v = _held_back(c[:, first : last + 1], low)
    width = last - first + 1
    block, k = np.nonzero(v)
    end = np.full(len(v), -1)
    end[block] = k  # the last one stays
    closed = np.flatnonzero(end < width - 1)
    run = k - np.concatenate([[-1], np.where(block[1:] == block[:-1], k[:-1], -1)]) - 1 if len(k) else k
    x = v[block, k].astype(np.int64)
    size = _size(x)
    symbol = 16 * (run & 15) + size
    code, length = (table.code[symbol] << size.astype(np.uint64)) | _amplitude(x, size), table.length[symbol] + size
    skips = run >> 4  # runs of sixteen zeros before
    place = np.concatenate([block * 66 + k + 1, np.repeat(block * 66 + k + 1, skips), closed * 66 + 65])
    kind = np.concatenate([np.ones(len(k), np.int64), np.zeros(skips.sum(), np.int64), np.zeros(len(closed), np.int64)])
    order = np.argsort(2 * place + kind, kind="stable")
    more = [np.full(skips.sum(), 0xF0), np.full(len(closed), 0x00)]
    code = np.concatenate([code, *(table.code[m] for m in more)])[order]
    length = np.concatenate([length, *(table.length[m] for m in more)])[order]
    return code, length, interval[place[order] // 66]


def _ac_refine(c: np.ndarray, interval: np.ndarray, table: Huffman, first: int, last: int, low: int) -> tuple[np.ndarray, ...]:
    v = c[:, first : last + 1]
    a = np.abs(v) >> low
    known, fresh = a > 1, a == 1
    some = np.flatnonzero(fresh.any(axis=1))  # the other blocks are an end of block and their corrections
    w, f, nothing = v[some], fresh[some], np.zeros((len(some), 1), np.int64)

    def before(x: np.ndarray) -> np.ndarray:
        return np.concatenate([nothing, x[:, :-1]], axis=1)

    zero = a[some] == 0
    zeros = np.cumsum(zero, axis=1)
    mark = np.maximum.accumulate(np.where(f, zeros, 0), axis=1)
    run, ahead = zeros - mark, before(zeros) - before(mark)  # zeros since the last new one, with and without this place
    later = np.cumsum(f[:, ::-1], axis=1)[:, ::-1] > 0
    stop = f | (zero & (run % 16 == 0) & (run > 0) & later)
    segment = np.cumsum(stop, axis=1) - stop
    rank = np.cumsum(known[some], axis=1)
    begin = np.maximum.accumulate(before(np.where(stop, rank, 0)), axis=1)
    closing = ~stop[:, -1]  # whatever follows the last symbol is closed by an end of block

    corrections, symbols = known.sum(axis=1), np.ones(len(v), np.int64)
    symbols[some] = stop.sum(axis=1) + closing
    base = np.cumsum(corrections + symbols) - corrections - symbols
    ahead_of = np.ones(v.shape, np.int8)  # symbols before a correction, in its block
    ahead_of[some] = segment + 1
    code, length = np.zeros(int((corrections + symbols).sum()), np.uint64), np.ones(int((corrections + symbols).sum()), np.int64)
    at = np.arange(corrections.sum()) + np.repeat(np.cumsum(symbols) - symbols, corrections) + ahead_of[known]
    code[at] = (a[known] & 1).astype(np.uint64)

    plain = np.ones(len(v), bool)
    plain[some] = False
    at = np.concatenate([base[plain], (base[some] + begin[:, -1] + segment[:, -1])[closing]])
    code[at], length[at] = table.code[0], table.length[0]
    b, k = np.nonzero(stop)
    new = f[b, k].astype(np.int64)
    symbol = np.where(new == 1, 16 * (ahead[b, k] & 15) + 1, 0xF0)
    at = base[some][b] + begin[b, k] + segment[b, k]
    code[at] = (table.code[symbol] << new.astype(np.uint64)) | ((w[b, k] > 0) & (new == 1)).astype(np.uint64)
    length[at] = table.length[symbol] + new
    return code, length, np.repeat(interval, corrections + symbols)


def _streams(code: np.ndarray, length: np.ndarray, interval: np.ndarray, per_picture: np.ndarray) -> list[bytes]:
    """Bits of each interval, filled with ones to a byte, with stuffing and restart markers; one string for each picture."""
    n = int(per_picture.sum())
    bits = np.bincount(interval, length, n).astype(np.int64)
    size = (bits + 7) // 8
    start = np.cumsum(size) - size
    at = np.cumsum(length) - length
    at += 8 * start[interval] - (np.cumsum(bits) - bits)[interval]
    shifted = code << (64 - length - (at & 31)).astype(np.uint64)
    words = int(size.sum()) // 4 + 3
    acc = np.bincount(at >> 5, (shifted >> np.uint64(32)).astype(float), words) + np.bincount((at >> 5) + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(float), words)
    data = acc.astype(np.uint32).astype(">u4").view(np.uint8)[: size.sum()]
    data[start + size - 1] |= ((1 << (8 * size - bits)) - 1).astype(np.uint8)
    full = data == 0xFF
    number = _within(per_picture)
    final = np.cumsum(per_picture) - 1
    marked = np.ones(n, bool)
    marked[final] = False
    gaps = np.repeat(np.cumsum(2 * marked) - 2 * marked, size)
    place = np.arange(len(data)) + np.cumsum(full) - full + gaps
    out = np.zeros(len(data) + int(full.sum()) + 2 * int(marked.sum()), np.uint8)
    out[place] = data
    after = (place[start + size - 1] + 1 + full[start + size - 1])[marked]
    out[after], out[after + 1] = 0xFF, 0xD0 + number[marked] % 8
    ends = place[start + size - 1][final] + 1 + full[start + size - 1][final]
    return [out[a:b].tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def write(coefficients: np.ndarray, wide: np.ndarray, high: np.ndarray, notes: list[bytes] | None = None) -> list[bytes]:
    """Pictures from their coefficients (blocks x 64 in zigzag order; luma, then both chroma, picture after picture), with a comment each."""
    dc, ac, refine = tables()
    layout, c = Layout(wide, high), coefficients.astype(np.int16)
    fixed = b"\xff\xd8\xff\xdb" + struct.pack(">HB", 67, 0) + b"\x01" * 64
    codes = dc.segment(0x00) + ac.segment(0x10) + refine.segment(0x11)
    heads = [fixed + b"\xff\xc2" + struct.pack(">HBHHB", 17, 8, 16 * h, 16 * w, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]) + codes + struct.pack(">HHH", 0xFFDD, 4, INTERVAL) for w, h in zip(wide.tolist(), high.tolist(), strict=True)]
    out = [[h, *([b"\xff\xfe" + struct.pack(">H", 2 + len(n)) + n] if n else [])] for h, n in zip(heads, notes or [b""] * len(heads), strict=True)]
    for parts, first, last, above, low in SCANS:
        blocks, interval, per = layout.visits(parts)
        x = c[blocks]
        if last == 0:
            items = (((x[:, 0] >> low) & 1).astype(np.uint64), np.ones(len(x), np.int64), interval) if above else _dc_first(x, interval, dc, low)
        else:
            items = _ac_refine(x, interval, refine, first, last, low) if above else _ac_first(x, interval, ac, first, last, low)
        head = b"\xff\xda" + struct.pack(">HB", 6 + 2 * len(parts), len(parts)) + b"".join(bytes([p + 1, 0x01 if above else 0x00]) for p in parts) + bytes([first, last, 16 * above + low])
        for o, data in zip(out, _streams(*items, per), strict=True):
            o += (head, data)
    return [b"".join([*o, b"\xff\xd9"]) for o in out]


# ---- reading ------------------------------------------------------------------------------------

_MARKER = re.compile(rb"\xff[\x01-\xcf\xd8-\xfe]")


def parse(data: bytes) -> tuple[int, int, dict[int, Huffman], list[tuple[tuple, bytes]], bytes]:
    """Width and height in units, codes, the scans (components, band, bits held back before and after) with their data, and the comment."""
    at, codes, scans, wide, high, note = 2, {}, [], 0, 0, b""
    while data[at : at + 2] != b"\xff\xd9":
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC2:
            _, h, w, n = struct.unpack_from(">BHHB", body)
            if (n, body[7::3]) != (3, bytes(16 * a + b for a, b in SAMPLING)) or h % 16 or w % 16:
                raise ValueError("only whole units of 4:2:0 are read")
            wide, high = w // 16, h // 16
        elif marker == 0xC4:
            codes[body[0]] = _code(body)
        elif marker == 0xFE:
            note = body
        elif marker == 0xDD and struct.unpack(">H", body)[0] != INTERVAL:
            raise ValueError("another restart interval")
        elif marker == 0xDA:
            n = body[0]
            parts = tuple(body[1 + 2 * i] - 1 for i in range(n))
            end = _MARKER.search(data, at).start()
            scans.append(((parts, body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15, body[2] & 15), data[at:end]))
            at = end
    return wide, high, codes, scans, note


@lru_cache(maxsize=64)
def _code(body: bytes) -> Huffman:
    return Huffman.read(body[1:17], body[17:])


class Bits:
    """The bit streams of a scan of a batch, without stuffing and markers; all are read in lockstep."""

    def __init__(self, data: list[bytes]) -> None:
        raw = np.frombuffer(b"".join(data), np.uint8)
        begins = np.concatenate([[0], np.cumsum([len(d) for d in data])[:-1]])
        at = np.flatnonzero(raw == 0xFF)
        follow = raw[np.minimum(at + 1, len(raw) - 1)]
        marks = at[(follow >= 0xD0) & (follow <= 0xD7)]
        drop = np.zeros(len(raw) + 1, bool)
        drop[at[follow == 0] + 1] = True
        drop[marks], drop[marks + 1] = True, True
        drop = drop[:-1]
        clean = np.concatenate([raw[~drop], np.zeros(8, np.uint8)]).astype(np.uint64)
        moved = np.cumsum(~drop) - ~drop
        starts = np.sort(np.concatenate([begins, marks + 2]))
        self.start = 8 * moved[starts]
        #: Five bytes from each byte on.
        self.word = sum(clean[i : len(clean) - 4 + i] << np.uint64(32 - 8 * i) for i in range(5))

    def peek(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """The next n (at most 32) bits."""
        return (self.word[at >> 3] >> (40 - (at & 7) - n).astype(np.uint64)).astype(np.int64) & ((1 << n) - 1)


def _extend(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((size > 0) & (bits < (1 << np.maximum(size - 1, 0))), bits - (1 << size) + 1, bits)


def _read_dc(bits: Bits, c: np.ndarray, blocks: np.ndarray, first: np.ndarray, count: np.ndarray, table: Huffman, low: int) -> None:
    at, live, pred = bits.start.copy(), np.arange(len(first)), np.zeros((len(first), 3), np.int64)
    for i in range(int(count.max(initial=0))):
        live = live[i < count[live]]
        word = bits.peek(at[live], 16)
        size, used = table.look[0, word].astype(np.int64), table.look[1, word].astype(np.int64)
        part = max(0, i % 6 - 3)
        pred[live, part] += _extend(bits.peek(at[live] + used, size), size)
        at[live] += used + size
        c[blocks[first[live] + i], 0] = pred[live, part] << low


def _read_ac(bits: Bits, c: np.ndarray, blocks: np.ndarray, first: np.ndarray, count: np.ndarray, table: Huffman, lo: int, hi: int, low: int) -> None:
    at, here, left, k = bits.start.copy(), first.copy(), count.copy(), np.full(len(first), lo)
    flat = c.reshape(-1)
    while len(at):
        word = bits.peek(at, 16)
        symbol, used = table.look[0, word].astype(np.int64), table.look[1, word].astype(np.int64)
        run, size = symbol >> 4, symbol & 15
        value = _extend(bits.peek(at + used, size), size) << low
        at = at + used + size
        k = k + run
        some = size > 0
        flat[blocks[here[some]] * 64 + k[some]] = value[some]
        k = np.where(some | (run == 15), k + 1, hi + 1)
        over = k > hi
        if over.any():
            here, left, k = here + over, left - over, np.where(over, lo, k)
            if (left == 0).any():
                keep = left > 0
                at, here, left, k = at[keep], here[keep], left[keep], k[keep]


def _refine_ac(bits: Bits, c: np.ndarray, blocks: np.ndarray, first: np.ndarray, count: np.ndarray, table: Huffman, lo: int, hi: int, low: int) -> None:
    """Symbols in lockstep; the correction bits between them are read all at once afterwards."""
    x = c[blocks]
    known = x[:, lo : hi + 1] != 0
    width = hi - lo + 1
    rank = np.concatenate([np.zeros((len(x), 1), np.int64), np.cumsum(known, axis=1)], axis=1)  # known ones before each place
    zeros = np.arange(width + 1) - rank
    place = np.full((len(x), width + 1), width)  # of the n-th zero
    b, k = np.nonzero(~known)
    place[b, zeros[b, k]] = k
    origin = np.zeros((len(x), width), np.int64)  # where a stretch of places begins: bit of its first correction, less the rank
    begins = np.zeros((len(x), width), bool)
    fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at, here, left, k = bits.start.copy(), first.copy(), count.copy(), np.zeros(len(first), np.int64)
    while len(at):
        word = bits.peek(at, 16)
        symbol, used = table.look[0, word].astype(np.int64), table.look[1, word].astype(np.int64)
        run, new = symbol >> 4, (symbol & 15) == 1
        sign = bits.peek(at + used, 1)
        at = at + used + new
        goal = zeros[here, k] + run
        stop = np.where(new | (run == 15), place[here, np.minimum(goal, width)], width)
        origin[here, k], begins[here, k] = at - rank[here, k], True
        at = at + rank[here, stop] - rank[here, k]
        fresh.append((here[new], stop[new], np.where(sign[new] == 1, 1, -1)))
        k = stop + 1
        over = k >= width
        here, left, k = here + over, left - over, np.where(over, 0, k)
        if (left == 0).any():
            keep = left > 0
            at, here, left, k = at[keep], here[keep], left[keep], k[keep]
    b, k = np.nonzero(known)
    since = np.maximum.accumulate(np.where(begins, np.arange(width), 0), axis=1)[b, k]
    bit = bits.peek(origin[b, since] + rank[b, k], 1)
    v = x[b, k + lo]
    x[b, k + lo] = v + np.sign(v) * (bit << low)
    for b, k, v in fresh:
        x[b, k + lo] = v << low
    c[blocks] = x


def read(pictures: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Coefficients (accumulated over all scans), width and height in units, and comments of pictures with equal scripts and codes."""
    parsed = [parse(p) for p in pictures]
    wide, high = (np.array([p[i] for p in parsed], np.int64) for i in (0, 1))
    layout = Layout(wide, high)
    c = np.zeros((int(layout.base[-1]), 64), np.int16)
    codes = parsed[0][2]
    for j, (script, _) in enumerate(parsed[0][3]):
        if any(p[3][j][0] != script or p[2] != codes for p in parsed):
            raise ValueError("pictures of a batch differ in their scans")
        parts, lo, hi, above, low, table = script
        blocks, interval, _ = layout.visits(parts)
        first = np.flatnonzero(np.concatenate([[True], interval[1:] != interval[:-1]]))
        count = np.diff(np.append(first, len(blocks)))
        bits = Bits([p[3][j][1] for p in parsed])
        if hi == 0 and above:
            c[blocks, 0] |= (bits.peek(bits.start[interval] + _within(count), 1) << low).astype(np.int16)
        elif hi == 0:
            _read_dc(bits, c, blocks, first, count, codes[0x00], low)
        elif above:
            _refine_ac(bits, c, blocks, first, count, codes[0x10 + table], lo, hi, low)
        else:
            _read_ac(bits, c, blocks, first, count, codes[0x10 + table], lo, hi, low)
    return c, wide, high, [p[4] for p in parsed]


def tensors(c: np.ndarray, wide: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    """Full-resolution RGB (height x width x 3) of each picture: inverse transform of all blocks, chroma doubled both ways."""
    pixels = np.clip((c.astype(float) @ basis() + SCALE / 2) // SCALE + 128, 0, 255).astype(np.int32).reshape(-1, 8, 8)
    out, at = [], 0
    for w, h in zip(wide.tolist(), high.tolist(), strict=True):
        n = w * h
        y, cb, cr = (_plane(pixels[at + a * n : at + b * n], f * w, f * h) for a, b, f in ((0, 4, 2), (4, 5, 1), (5, 6, 1)))
        cb, cr = (np.repeat(np.repeat(p - 128, 2, axis=0), 2, axis=1) for p in (cb, cr))
        # ITU-R BT.601 in 16 bits of fraction
        rgb = np.stack([y + ((91881 * cr + 32768) >> 16), y - ((22554 * cb + 46802 * cr + 32768) >> 16), y + ((116130 * cb + 32768) >> 16)], axis=2)
        out.append(np.clip(rgb, 0, 255).astype(np.uint8))
        at += 6 * n
    return out


def _plane(blocks: np.ndarray, wide: int, high: int) -> np.ndarray:
    return blocks.reshape(high, wide, 8, 8).transpose(0, 2, 1, 3).reshape(8 * high, 8 * wide)
