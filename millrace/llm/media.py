"""Media columns: payloads kept as progressive JPEG, read back as RGB tensors.

The unit of the format that is stored without loss is the coefficient: byte ``b`` of a payload is coefficient ``b - 128`` of an 8 x 8
block whose quantisers are all 1. A payload longer than a picture may hold becomes several pictures, one after the other.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import progressive_jpeg as jpeg

PAD = 576
UNIT = 384
#: Bytes of a payload in one picture, a multiple of PAD and UNIT; and bytes of payload worked on at once.
PICTURE = 1152 * 512
BATCH = 600_000


def payload(raw: bytes) -> bytes:
    """The bytes and bytes 255 up to a positive multiple of 576."""
    return raw + b"\xff" * (PAD - len(raw) % PAD if len(raw) % PAD or not raw else 0)


def pictures(parts: list[bytes]) -> list[bytes]:
    """A progressive JPEG for each payload; its comment holds the payload's length."""
    units = [-(-len(p) // UNIT) for p in parts]
    wide = [int(np.ceil(np.sqrt(u))) for u in units]
    high = [-(-u // w) for u, w in zip(units, wide, strict=True)]
    filled = b"".join(p + b"\x80" * (UNIT * w * h - len(p)) for p, w, h in zip(parts, wide, high, strict=True))
    c = np.frombuffer(filled, np.uint8).astype(np.int16) - 128
    return jpeg.write(c.reshape(-1, 64), np.array(wide), np.array(high), [struct.pack(">Q", len(p)) for p in parts])


def contents(data: list[bytes]) -> tuple[list[bytes], list[np.ndarray]]:
    """Payload and RGB tensor of each picture, from its bytes alone."""
    c, wide, high, notes = jpeg.read(data)
    raw, at, out = (c + 128).astype(np.uint8).tobytes(), 0, []
    for w, h, note in zip(wide.tolist(), high.tolist(), notes, strict=True):
        out.append(raw[at : at + struct.unpack(">Q", note)[0]])
        at += UNIT * w * h
    return out, jpeg.tensors(c, wide, high)


def _batches(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], list[tuple[int, bytes]]]]:
    """Rows (id, bytes) as they come, and with them the pieces (row, payload) of about half a megabyte; a long row has several pieces."""
    heads: list[tuple] = []
    pieces: list[tuple[int, bytes]] = []
    size = 0
    for b in rows:
        for i in range(b.num_rows):
            raw = (b.column(1)[i].as_py() or "").encode()
            whole = payload(raw)
            heads.append((b.column(0)[i], len(raw), whole[-32:]))
            for at in range(0, len(whole), PICTURE):
                pieces.append((len(heads) - 1, whole[at : at + PICTURE]))
                size += len(pieces[-1][1])
                if size >= BATCH:
                    yield heads, pieces
                    pieces, size = [], 0
    if pieces:
        yield heads, pieces


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """One row for each input row: ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature``
    and, if asked for, ``media`` (the pictures' bytes, one after the other).

    What is described of a payload was read back from the stored pictures. The feature has the number of pixels and the sums of red,
    green and blue over the RGB tensors.

    Null and empty texts have a payload of 576 bytes 255. Equal texts have equal values. Repeated rows and null ids are rows like any
    other. An empty table gives an empty result. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kinds = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    kinds += [("media", pa.binary())] * with_media

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, state, out = 0, None, []

        def flush() -> pa.RecordBatch:
            cols = [pa.array([r[0].as_py() for r in out], out[0][0].type), *(pa.array([r[i + 1] for r in out], t) for i, (_, t) in enumerate(kinds))]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", *(n for n, _ in kinds)])

        def close() -> None:
            key, n, size, digest, tail, stored, media_digest, pixels, sums, media = state
            feature = f"pixels={pixels} red={sums[0]} green={sums[1]} blue={sums[2]}"
            out.append((key, n, size, digest.hexdigest(), zlib.crc32(tail), stored, media_digest.hexdigest(), feature, b"".join(media)))

        for heads, pieces in _batches(batches):
            stored = pictures([p for _, p in pieces])
            back, tensors = contents(stored)
            for (row, _), file, raw, rgb in zip(pieces, stored, back, tensors, strict=True):
                if state is None or row != done:
                    if state is not None:
                        close()
                    done, state = row, [heads[row][0], heads[row][1], 0, hashlib.sha256(), b"", 0, hashlib.sha256(), 0, np.zeros(3, np.int64), []]
                    heads[row] = None
                state[2] += len(raw)
                state[3].update(raw)
                state[4] = (state[4] + raw[-32:])[-32:]
                state[5] += len(file)
                state[6].update(file)
                state[7] += rgb.shape[0] * rgb.shape[1]
                state[8] = state[8] + rgb.sum(axis=(0, 1), dtype=np.int64)
                if with_media:
                    state[9].append(file)
            if out:
                yield flush()
                out.clear()
        if state is not None:
            close()
        if out:
            yield flush()

    spark_kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, " + ", ".join(f"{n} {spark_kinds[t]}" for n, t in kinds))


def load(media: DataFrame, media_col: str = "media", id_col: str = "doc_id") -> DataFrame:
    """The tensors of a media column: ``doc_id, part, height, width, rgb`` (bytes, row after row), one row for each picture; null media has none."""
    rows = media.filter(F.col(media_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                for part, file in enumerate(split(b.column(1)[i].as_py())):
                    (rgb,) = contents([file])[1]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([part], pa.int32()), pa.array([rgb.shape[0]], pa.int32()), pa.array([rgb.shape[1]], pa.int32()), pa.array([rgb.tobytes()])], ["doc_id", "part", "height", "width", "rgb"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, part int, height int, width int, rgb binary")


def split(media: bytes) -> list[bytes]:
    """The pictures of a media value: each ends with the marker FF D9, which entropy-coded data never hold."""
    out, at = [], 0
    while at < len(media):
        last = media.find(b"\xff\xd9\xff\xd8", at)
        end = len(media) if last < 0 else last + 2
        out.append(media[at:end])
        at = end
    return out
