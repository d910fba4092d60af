"""SentencePiece encoding and decoding; giant texts by a max-plus scan over chunks.

Byte-pair segmentations have a local test: a sequence of pieces is the encoding of its text if and only if each two neighbours are
the encoding of theirs. So the encoding is the one path of weight 0 through a graph over positions where a forbidden neighbourhood
weighs minus infinity, and paths compose in the (max, +) semiring. A giant text is cut at fixed places. The state at a cut is the
piece that reaches over it. Each chunk gives, on its own, the matrix of best weights from states at its left cut to states at its
right cut; products of matrices, taken group by group and then over the groups, are associative and give the states on the best
path. Between two known states each chunk is then encoded independently.

Texts up to a chunk long are encoded in one piece, without shuffling. Giant texts are keyed by their SHA-256, so that copies are
encoded once.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import written

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NEVER = float("-inf")


@lru_cache(maxsize=4)
def whole(model: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=model)


class Inner:
    """The model without its prefix space, for pieces of text from the middle of a document."""

    def __init__(self, model: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(model, "rb") as f:
            proto.ParseFromString(f.read())
        self.prefix = SPACE if proto.normalizer_spec.add_dummy_prefix else ""
        if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("the model rewrites its input; chunks need one that does not")
        if any(p.type == 4 for p in proto.pieces):
            raise ValueError("the model has user-defined pieces, which are cut out before all others; chunks need one without")
        proto.normalizer_spec.add_dummy_prefix = False
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.pieces = {p.piece for p in proto.pieces if p.type == 1}
        self.reach = max(map(len, self.pieces))
        #: A space after another character always starts a piece if no piece has one there.
        self.seams = not any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        self.spans = lru_cache(maxsize=1 << 16)(self._spans)

    def ids(self, text: str) -> list[int]:
        return self.sp.encode(text)

    def _spans(self, text: str) -> tuple[int, ...]:
        """Ends of the pieces of a short text, in code points; the bytes of an unknown character are one piece."""
        pieces = self.sp.encode(text, return_type="proto").pieces
        return tuple(itertools.accumulate(len(p.surface) for p in pieces if p.surface))

    def states(self, text: str, cut: int) -> list[tuple[int, int]]:
        """All (start, end) with start < cut <= end that can be a piece."""
        out = []
        for a in range(max(0, cut - self.reach), cut):
            for e in range(cut, min(len(text), a + self.reach) + 1):
                piece = text[a:e]
                if e == a + 1 or piece in self.pieces and self.spans(piece) == (len(piece),):
                    out.append((a, e))
        return out

    def seam(self, text: str, start: int, stop: int, step: int) -> int | None:
        """The first sure piece start in a range."""
        if self.seams:
            for i in range(start, stop, step):
                if 0 < i < len(text) and text[i] == SPACE != text[i - 1]:
                    return i
        return None

    def fits(self, left: str, right: str) -> bool:
        return self.spans(left + right) == (len(left), len(left) + len(right))


@lru_cache(maxsize=4)
def inner(model: str) -> Inner:
    return Inner(model)


def transfer(sp: Inner, text: str, left: int | None, right: int | None) -> tuple[list, list, np.ndarray]:
    """States at both cuts of a chunk and the matrix between them. None: the text begins or ends there."""
    start = [(0, 0)] if left is None else sp.states(text, left)
    stop = [(len(text), len(text))] if right is None else sp.states(text, right)
    m = np.full((len(start), len(stop)), NEVER)
    lo, hi = (0 if left is None else left + sp.reach), (len(text) if right is None else right - sp.reach)
    first = sp.seam(text, lo, hi, 1)
    last = sp.seam(text, hi - 1, lo - 1, -1) if first is not None else None

    def begins(s: tuple[int, int], end: int) -> bool:
        a, e = s
        if a == e or e >= end:
            return True
        return sp.fits(text[a:e], text[e : e + sp.spans(text[e:end])[0]])

    def ends(begin: int, s: tuple[int, int]) -> bool:
        a, e = s
        if a == e:
            return True
        found = sp.spans(text[begin:e])
        return (found[-2] if len(found) > 1 else 0) == a - begin

    if first is not None and last is not None:
        # with a sure piece start inside, the matrix is the outer sum of a column and a row
        u = np.array([0.0 if begins(s, first) else NEVER for s in start])
        v = np.array([0.0 if ends(last, s) else NEVER for s in stop])
        return start, stop, u[:, None] + v[None, :]
    for i, s in enumerate(start):
        for j, t in enumerate(stop):
            if s[1] < t[1] and (t[0] == t[1] or s[1] <= t[0]) and begins(s, t[1]) and ends(s[1], t):
                m[i, j] = 0.0
            elif s == t or t[0] == t[1] == s[1]:
                m[i, j] = 0.0  # one piece reaches over both cuts, or over the left one to the end of the text
    return start, stop, m


def maxplus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of two matrices over (max, +)."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1) if a.size and b.size else np.full((a.shape[0], b.shape[1]), NEVER)


def path(matrices: list[np.ndarray], first: int, last: int) -> list[int]:
    """States on the best path from state ``first`` of the first matrix to state ``last`` of the last one."""
    forward = [np.where(np.arange(matrices[0].shape[0]) == first, 0.0, NEVER)]
    for m in matrices:
        forward.append((forward[-1][:, None] + m).max(axis=0))
    if forward[-1][last] == NEVER:
        raise ValueError("no path between the cuts")
    out = [last]
    for k in range(len(matrices) - 1, -1, -1):
        out.append(int((forward[k] + matrices[k][:, out[-1]]).argmax()))
    return out[::-1]


def _unpack(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [np.array(m, float).reshape(n, -1) if len(m) else np.full((n, 0), NEVER) for m, n in zip(pdf["m"], pdf["n_left"], strict=True)]


def _digest(ids: list[int], text: str | None, out: str) -> tuple:
    return len(ids), hashlib.sha256(np.asarray(ids, "<i4").tobytes()).hexdigest(), hashlib.sha256(out.encode()).hexdigest(), out == (text or "")


def encode(docs: DataFrame, model: str = MODEL, chunk: int = 1 << 15, group: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: ``doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip, n_chunks, ids``.

    ``ids`` are those of the library for the whole text; the digest is over them as little-endian 32-bit integers. ``decoded_sha256``
    is of the text decoded from them, ``round_trip`` whether that is the text (it is not where a text has U+2581, which stands for a space).

    A model that rewrites its input, or has user-defined pieces, is an error.

    Null text is encoded as empty: no ids, and the round trip gives the empty text. Repeated rows and null ids are rows like any
    other. An empty table gives an empty result. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = dict(rows.dtypes)["doc_id"]
    size = F.coalesce(F.length("text"), F.lit(0))
    out_schema = "n_tokens int, ids_sha256 string, decoded_sha256 string, round_trip boolean, n_chunks int, ids array<int>"
    names = ["n_tokens", "ids_sha256", "decoded_sha256", "round_trip", "n_chunks", "ids"]

    def finish(ids: list[list[int]], texts: list[str | None], chunks: list[int]) -> list[pa.Array]:
        found = [_digest(i, t, o) for i, t, o in zip(ids, texts, whole(model).decode(ids, num_threads=1) if ids else [], strict=True)]
        cols = list(zip(*found, strict=True)) if found else [(), (), (), ()]
        kinds = (pa.int32(), pa.string(), pa.string(), pa.bool_())
        return [*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), pa.array(chunks, pa.int32()), pa.array(ids, pa.list_(pa.int32()))]

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, start, held = b.column(1).to_pylist(), 0, 0
            for i in range(1, len(texts) + 1):
                held += len(texts[i - 1] or "")
                if held >= 1 << 19 or i == len(texts):  # half a megabyte at a time, whatever the batch
                    part = texts[start:i]
                    ids = whole(model).encode([t or "" for t in part], num_threads=1)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(start, i - start), *finish(ids, part, [1] * len(part))], ["doc_id", *names])
                    start, held = i, 0

    direct = rows.filter(size <= chunk).mapInArrow(short, f"doc_id {id_type}, {out_schema}")

    giants = rows.filter(size > chunk).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("uid"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = inner(model)
        for b in batches:
            for uid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = sp.prefix + text.replace(" ", SPACE)
                n = -(-len(t) // chunk)
                for k in range(n):
                    lo, hi = max(0, k * chunk - sp.reach), min(len(t), (k + 1) * chunk + sp.reach)
                    left, right = k * chunk - lo if k else -1, (k + 1) * chunk - lo if k < n - 1 else -1
                    # a chunk with the reach of a piece on either side; cuts are places in it, -1 at the ends of the text
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (uid, k, n, left, right, t[lo:hi])], ["uid", "part", "parts", "left", "right", "piece"])

    distinct = giants.groupBy("uid").agg(F.first("text").alias("text"))
    chunks = written(distinct.mapInArrow(cut, "uid string, part long, parts long, left long, right long, piece string"))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = inner(model)
        for b in batches:
            for r in b.to_pylist():
                start, stop, m = transfer(sp, r["piece"], None if r["left"] < 0 else r["left"], None if r["right"] < 0 else r["right"])
                lo = r["part"] * chunk - max(0, r["left"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x]) for x in (r["uid"], r["part"], r["part"] // group, len(start))] + [pa.array([x], pa.list_(pa.float64())) for x in (m.ravel().tolist(),)] + [pa.array([[lo + e for _, e in s]], pa.list_(pa.int64())) for s in (start, stop)],
                    ["uid", "part", "grp", "n_left", "m", "starts", "stops"],
                )

    spread = chunks.repartition("uid", "part")
    steps = written(spread.mapInArrow(matrices, "uid string, part long, grp long, n_left long, m array<double>, starts array<long>, stops array<long>"))

    def product(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out, *rest = _unpack(pdf.sort_values("part"))
        for m in rest:
            out = maxplus(out, m)
        return pd.DataFrame({"uid": [key[0]], "grp": [key[1]], "n_left": [out.shape[0]], "m": [out.ravel().tolist()]})

    def over_groups(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("grp")
        states = path(_unpack(pdf), 0, 0)
        return pd.DataFrame({"uid": key[0], "grp": pdf["grp"].to_numpy(), "enter": states[:-1], "leave": states[1:]})

    def within(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("part")
        states = path(_unpack(left), int(right["enter"].iloc[0]), int(right["leave"].iloc[0]))
        begin = [s[i] for s, i in zip(left["starts"], states[:-1], strict=True)]
        end = [s[i] for s, i in zip(left["stops"], states[1:], strict=True)]
        return pd.DataFrame({"uid": key[0], "part": left["part"].to_numpy(), "begin": begin, "end": end})

    products = steps.groupBy("uid", "grp").applyInPandas(product, "uid string, grp long, n_left long, m array<double>")
    entered = products.groupBy("uid").applyInPandas(over_groups, "uid string, grp long, enter long, leave long")
    ends = steps.groupBy("uid", "grp").cogroup(entered.groupBy("uid", "grp")).applyInPandas(within, "uid string, part long, begin long, end long")

    def backtrace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = inner(model)
        for b in batches:
            for r in b.to_pylist():
                lo = r["part"] * chunk - max(0, r["left"])
                ids = sp.ids(r["piece"][r["begin"] - lo : r["end"] - lo]) if r["end"] > r["begin"] else []
                yield pa.RecordBatch.from_arrays([pa.array([r["uid"]]), pa.array([r["part"]]), pa.array([ids], pa.list_(pa.int32()))], ["uid", "part", "ids"])

    traced = chunks.join(ends, ["uid", "part"]).select("uid", "part", "left", "piece", "begin", "end").mapInArrow(backtrace, "uid string, part long, ids array<int>")
    joined = traced.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("part", "ids"))).alias("all"))
    encoded = joined.select(F.col("uid").alias("own"), F.flatten(F.transform("all", lambda x: x["ids"])).alias("ids"), F.size("all").alias("n_chunks"))

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1)
                ids = r.column(3).to_pylist()
                yield pa.RecordBatch.from_arrays([r.column(0), *finish(ids, r.column(1).to_pylist(), r.column(2).to_pylist())], ["doc_id", *names])

    scanned = giants.join(encoded, F.col("uid") == F.col("own")).select("doc_id", "text", "n_chunks", "ids").mapInArrow(long, f"doc_id {id_type}, {out_schema}")
    return direct.unionByName(scanned)


def decode(rows: DataFrame, model: str = MODEL, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """``rows`` with the text of a column of ids; null ids give null text."""
    from pyspark.sql import types as T

    schema = T.StructType([f for f in rows.schema.fields if f.name != out_col] + [T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(b.schema.get_field_index(ids_col)).to_pylist()
            texts = [None if i is None else whole(model).decode(i) for i in ids]
            cols = {n: b.column(k) for k, n in enumerate(b.schema.names) if n != out_col} | {out_col: pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return rows.mapInArrow(run, schema)
