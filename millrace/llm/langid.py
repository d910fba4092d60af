"""Language identification with hyperdimensional profiles.

A letter is a random vector of +1 and -1, drawn from its code point. A trigram is bound from its letters, each rotated by its place,
and multiplied. A document is the bundle (sum) of its trigrams; a language's prototype is the bundle of its training documents.
A document gets the language whose prototype has the largest cosine to it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import checkpointed, mix64, written

CODE_POINTS = 0x110000
UNKNOWN = "und"


class Space:
    """Vectors of letters and, cached in a worker, of the trigrams met so far."""

    _letters: np.ndarray | None = None

    def __init__(self, dims: int, cache: int = 1 << 16) -> None:
        self.dims = dims
        self.rows = np.empty((4096, dims), np.int8)
        self.codes, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.vectors = np.empty((max(cache, len(self.rows)), dims), np.int8)

    @classmethod
    def letters(cls) -> np.ndarray:
        """For each code point whether it is a letter."""
        if cls._letters is None:
            cls._letters = np.fromiter((chr(i).isalpha() for i in range(CODE_POINTS)), bool, CODE_POINTS)
        return cls._letters

    def letter(self, points: np.ndarray) -> np.ndarray:
        """A row of +1 and -1 for each code point (0, the gap between words, among them)."""
        words = points.astype(np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(1, self.dims // 64 + 1, dtype=np.uint64)
        bits = np.unpackbits(mix64(mix64(words)).view(np.uint8), axis=1, bitorder="little")
        return (2 * bits.astype(np.int8) - 1).astype(np.int8)

    def bind(self, codes: np.ndarray) -> np.ndarray:
        out = np.ones((len(codes), self.dims), np.int8)
        for place, shift in enumerate((42, 21, 0)):
            points, back = np.unique((codes >> np.uint64(shift)) & np.uint64(0x1FFFFF), return_inverse=True)
            out *= np.roll(self.letter(points), 2 - place, axis=1)[back]
        return out

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the vectors of sorted, distinct trigrams, each times its count; exact while the counts add up to less than 2**24."""
        out, step = np.zeros(self.dims, np.float32), len(self.rows)
        for i in range(0, len(codes), step):
            at = self.places(codes[i : i + step])
            rows = self.rows[: len(at)]
            self.vectors.take(at, axis=0, out=rows, mode="clip")
            out += counts[i : i + step].astype(np.float32) @ rows
        return out

    def places(self, codes: np.ndarray) -> np.ndarray:
        """Rows of sorted, distinct trigrams in the cache. It only saves time: where it is full it starts anew."""
        at = np.searchsorted(self.codes, codes)
        known = at < len(self.codes)
        known[known] = self.codes[at[known]] == codes[known]
        if not known.all():
            fresh = codes[~known]
            if len(self.codes) + len(fresh) > len(self.vectors):
                self.codes, self.slots, fresh = self.codes[:0], self.slots[:0], codes
            used = len(self.codes)
            self.vectors[used : used + len(fresh)] = self.bind(fresh)
            at = np.searchsorted(self.codes, fresh)
            self.codes = np.insert(self.codes, at, fresh)
            self.slots = np.insert(self.slots, at, np.arange(used, used + len(fresh)))
            at = np.searchsorted(self.codes, codes)
        return self.slots[at]


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of a whole text (letters in lower case, all else one gap) and their counts; none without a letter."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if not text:
        return none
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(Space.letters()[points], points, 0)
    points = np.concatenate([[0], points, [0]]).astype(np.uint64)
    points = points[np.concatenate([[True], (points[1:] != 0) | (points[:-1] != 0)])]
    if len(points) < 3:
        return none
    return np.unique((points[:-2] << np.uint64(42)) | (points[1:-1] << np.uint64(21)) | points[2:], return_counts=True)


def _sum(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of distinct trigrams over several texts."""
    codes, counts = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    order = codes.argsort()
    codes = codes[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(counts[order], first)


@dataclass(frozen=True)
class Model:
    """Sums of the languages' vectors (lang, i, v), ``dims`` rows for each language. Predictions take them in blocks of languages."""

    sums: DataFrame
    dims: int
    block: int

    def blocks(self) -> Iterator[tuple[tuple[str, ...], np.ndarray]]:
        """Languages in order of code points, ``block`` at a time, and their prototypes of length 1. The driver holds one block."""
        last = None
        while True:
            ahead = self.sums.filter("i = 0").select("lang")
            names = [r[0] for r in (ahead if last is None else ahead.filter(F.col("lang") > last)).orderBy("lang").limit(self.block).collect()]
            if not names:
                return
            table = self.sums.filter((F.col("lang") >= names[0]) & (F.col("lang") <= names[-1])).toArrow()
            out, place = np.zeros((len(names), self.dims)), {n: i for i, n in enumerate(names)}
            found = table["lang"].combine_chunks().dictionary_encode()
            row = np.array([place[n] for n in found.dictionary.to_pylist()])[found.indices.to_numpy()]
            out[row, table["i"].to_numpy()] = table["v"].to_numpy()
            yield tuple(names), out / np.maximum(1e-300, np.linalg.norm(out, axis=1, keepdims=True))
            if len(names) < self.block:
                return
            last = names[-1]


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def learn(docs: DataFrame, dims: int = 1024, block: int = 512, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Prototypes from the rows with a language and a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, held = Space(dims), defaultdict(list)
        size = 0
        for b in batches:
            for text, lang in zip(b.column(0), b.column(1), strict=True):
                if len((found := trigrams(text.as_py()))[0]):
                    held[lang.as_py()].append(found)
                    size += len(found[0])
            if size > 1 << 21:
                held = defaultdict(list, {lang: [_sum(x)] for lang, x in held.items()})
                size = sum(len(x[0][0]) for x in held.values()) // 2
        for lang, x in held.items():
            codes, counts = _sum(x)
            v = sum((counts[i : i + 256] @ space.bind(codes[i : i + 256]).astype(np.int64) for i in range(0, len(codes), 256)), np.zeros(dims, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dims), pa.array(np.arange(dims, dtype=np.int32)), pa.array(v)], ["lang", "i", "v"])

    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return Model(checkpointed(rows.mapInArrow(run, "lang string, i int, v long").groupBy("lang", "i").agg(F.sum("v").alias("v"))), dims, block)


def predict(docs: DataFrame, model: Model, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with two more columns; rows and other columns stay as they are. One pass over the texts for each block of languages, each
    pass but the last written to the shared folder."""
    out, waiting = docs.withColumns({pred_col: F.lit(UNKNOWN), score_col: F.lit(None).cast("double")}), None
    for languages, prototypes in model.blocks():
        out, waiting = (out if waiting is None else written(waiting)), None
        waiting = _pass(out, languages, prototypes.astype(np.float32), text_col, pred_col, score_col)
    found = out if waiting is None else waiting
    return found.withColumn(score_col, F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(score_col))), F.lit(0.0)))


def _pass(docs: DataFrame, languages: tuple[str, ...], prototypes: np.ndarray, text_col: str, pred_col: str, score_col: str) -> DataFrame:
    """The better of what is known of each document and of a block of languages; equal cosines leave what is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space(prototypes.shape[1])
        for b in batches:
            at = {n: b.schema.get_field_index(n) for n in (text_col, pred_col, score_col)}
            pred, score = [], []
            for text, best, cosine in zip(b.column(at[text_col]), b.column(at[pred_col]).to_pylist(), b.column(at[score_col]).to_pylist(), strict=True):
                codes, counts = trigrams(text.as_py())
                if len(codes):
                    v = space.bundle(codes, counts)
                    cos = (prototypes @ v) / max(float(np.linalg.norm(v)), 1e-30)
                    k = int(cos.argmax())
                    if cosine is None or cos[k] > cosine:
                        best, cosine = languages[k], float(cos[k])
                pred.append(best)
                score.append(cosine)
            new = {pred_col: pa.array(pred, pa.string()), score_col: pa.array(score, pa.float64())}
            yield pa.RecordBatch.from_arrays([new.get(n, b.column(i)) for i, n in enumerate(b.schema.names)], b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, dims: int = 1024, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", block: int = 512) -> DataFrame:
    """One row for each input row: ``doc_id, held_out, lang_pred, score``.

    Prototypes come from the rows that are not held out; languages, sources and ids are no input of a prediction. Null text, text
    without letters and any text where nothing could be learned give ``und`` and score 0. Equal cosines go to the first language by
    code point. Null ids count as the empty id, repeated rows as documents of their own. An empty table gives an empty result. Other
    columns are ignored.
    """
    model = learn(docs.filter(~held_out(id_col)), dims, block, text_col=text_col, lang_col=lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return predict(rows, model).drop("text")
