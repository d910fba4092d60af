"""Quality classifier: an interpolated modified Kneser-Ney model over characters, trained on trusted text.

Documents stand in blocks, compressed. Each block sends its distinct n-grams, with their counts in trusted text, to shards by hash; a
shard sums them. The tables of all orders follow by joins: continuation counts by suffix, sums and numbers of followers by context,
the next lower order by suffix. Shards answer each block with the probabilities of its n-grams, and blocks score their documents. A
document stays if its perplexity is within a quantile, for its language, of trusted text that the model was not trained on, and if so
is its share of repeated words: to any n-gram model, a common word over and over is likely text.

All up to the scores is one plan; the exchanges of blocks, of messages and of the summed n-grams are made once and reused. What travels are distinct
n-grams of a block, so it grows with the corpus until a language's n-grams are all known.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.blocks import BUFFER, LAST, PAGES, gathered, pack, pack_sorted, pages, to_pages, unpack, unpack_sorted
from millrace.llm.common import checkpointed, layout, mix64, small

BITS = 12
#: Symbols: a code point below WIDE is one, any other is two, a lead and a trail. So each text has its own symbols, and each fits 12 bits.
WIDE, LEAD, TRAIL, BEGIN, END, GAP = 1920, 1920, 1920 + 1088, 4032, 4033, 4034
_SMALL = np.arange(WIDE)
_SMALL[[0x20, *range(0x09, 0x0E)]] = GAP


def grams(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """n-grams that end at each symbol and at the end of each text, and the text they belong to; runs of white space are one gap."""
    pad = "\x00" * (order - 1)
    point = np.frombuffer("".join(f"{pad}{t}\x00" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sizes = np.array([len(t) for t in texts]) + order
    ends = np.cumsum(sizes)
    wide = point >= WIDE
    s = np.where(wide, LEAD + (point >> 10), _SMALL[np.where(wide, 0, point)])
    s[np.concatenate([ends - sizes + i for i in range(order - 1)])] = BEGIN
    s[ends - 1] = END
    text = np.repeat(np.arange(len(texts)), sizes)
    if wide.any():
        n = 1 + wide
        second = (np.cumsum(n) - 1)[wide]
        s, text = np.repeat(s, n), np.repeat(text, n)
        s[second] = TRAIL + (point[wide] & 1023)
    keep = np.concatenate([[True], (s[1:] != GAP) | (s[:-1] != GAP)])
    s, text = s[keep].astype(np.uint64), text[keep]
    n = len(s) - order + 1
    code = np.zeros(n, np.uint64)
    for i in range(order):
        code = (code << np.uint64(BITS)) | s[i : i + n]
    ok = text[:n] == text[order - 1 :]
    return code[ok], text[:n][ok]


def characters(code: np.ndarray) -> np.ndarray:
    """Whether each n-gram is the last one of a character (or of the end of a text): it doesn't end between a lead and its trail."""
    last = code & np.uint64((1 << BITS) - 1)
    return (last < LEAD) | (last >= TRAIL)


def repeated(texts: list[str], reach: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and how many of them repeat: the word before, or with it the two words a phrase of at most ``reach`` words back."""
    known: dict[bytes, int] = {}
    cut = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    n = np.array([len(w) for w in cut], np.int64)
    word = np.fromiter((known.setdefault(x, len(known)) for w in cut for x in w), np.int64, n.sum())
    text = np.repeat(np.arange(len(texts)), n)
    again = np.zeros(len(word), bool)
    for back in range(1, reach + 1):
        same = (word[back:] == word[:-back]) & (text[back:] == text[:-back])
        if back == 1:
            again[1:] |= same
        else:
            again[back + 1 :] |= same[1:] & same[:-1]
    return n, np.bincount(text[again], minlength=len(texts))


def _texts(table: pa.Table) -> Iterator[tuple[np.ndarray, list[str | None], list[str]]]:
    """Ids, languages and lower-cased texts of a block, about a megabyte at a time."""
    for ids, langs, raws in pages(table):
        start, held = 0, 0
        for i, raw in enumerate(raws):
            held += len(raw)
            if held >= BUFFER or i == len(raws) - 1:
                yield ids[start : i + 1], langs[start : i + 1], [r.decode().lower() for r in raws[start : i + 1]]
                start, held = i + 1, 0


class _Sum:
    """Counts by n-gram, merged now and then so that they stay small."""

    def __init__(self) -> None:
        self.key, self.count, self.new = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

    def add(self, key: np.ndarray, count: np.ndarray) -> None:
        self.new.append((key, count))
        if sum(len(k) for k, _ in self.new) > 1 << 20:
            self.merge()

    def merge(self) -> None:
        key = np.concatenate([self.key, *(k for k, _ in self.new)])
        count = np.concatenate([self.count, *(c for _, c in self.new)])
        order = key.argsort()
        key, count = key[order], count[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.key, self.count, self.new = key[first], np.add.reduceat(count, first) if len(first) else count, []


def _shard_cuts(key: np.ndarray, shards: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order of n-grams by the shard of their hash, and the shards' ranges in it."""
    shard = (mix64(key) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[order], np.arange(shards + 1)).tolist()
    return order, [(s, a, b) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]


# ---- the model ----------------------------------------------------------------------------------


def _discounts(level: DataFrame) -> Column:
    """A scalar: the three modified Kneser-Ney discounts of an order, from its counts of counts; 0.5 where counts are too few to tell."""
    n = [F.sum((F.col("c") == i).cast("long")) for i in range(1, 5)]
    row = level.agg(*(x.alias(f"n{i}") for i, x in enumerate(n, 1)))
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))

    def of(i: int) -> Column:
        d = F.lit(float(i)) - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}"))
        return F.when((d > 0) & (d <= i), d).otherwise(F.lit(0.5)).alias(f"d{i}")

    return row.select(F.struct(*(of(i) for i in (1, 2, 3)))).scalar()


def probabilities(counts: DataFrame, order: int) -> DataFrame:
    """``g, p``: interpolated modified Kneser-Ney probability of the last symbol of every n-gram in ``counts`` (g, c), c = 0 included.

    Orders below the highest count the distinct symbols before a gram. A context never seen falls back on the next order.
    """
    levels = {order: counts}
    for k in range(order - 1, 0, -1):
        suffix = F.col("g").bitwiseAND(F.lit((1 << BITS * k) - 1))
        levels[k] = levels[k + 1].groupBy(suffix.alias("g")).agg(F.sum((F.col("c") > 0).cast("long")).alias("c"))
    kinds = levels[1].agg(F.count(F.lit(1)).cast("double")).scalar()
    lower = None
    for k in range(1, order + 1):
        by = Window.partitionBy("h")
        d = F.when(F.col("c") == 0, 0.0).when(F.col("c") == 1, F.col("d.d1")).when(F.col("c") == 2, F.col("d.d2")).otherwise(F.col("d.d3"))
        rows = (
            levels[k]
            .withColumn("d", _discounts(levels[k]))
            .withColumn("h", F.shiftright("g", BITS))
            .withColumn("s", F.sum("c").over(by))
            .withColumn("held", F.sum(d).over(by))
            .withColumn("top", F.when(F.col("s") > 0, (F.col("c") - d) / F.col("s")).otherwise(0.0))
            .withColumn("rest", F.when(F.col("s") > 0, F.col("held") / F.col("s")).otherwise(1.0))
        )
        if lower is None:
            lower = rows.select("g", (F.col("top") + F.col("rest") / kinds).alias("p"))
        else:
            low = lower.select(F.col("g").alias("suffix"), F.col("p").alias("q"))
            joined = rows.withColumn("suffix", F.col("g").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1))).join(low, "suffix")
            lower = joined.select("g", (F.col("top") + F.col("rest") * F.col("q")).alias("p"))
    return lower


# ---- the operator -------------------------------------------------------------------------------


def classify(docs: DataFrame, labels: DataFrame, order: int = 5, quantile: float = 0.995, calibrate: int = 5, slack: float = 2.0, share_slack: float = 1.0, block_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each input row: ``doc_id, lang, trusted, n_symbols, perplexity, threshold, repeats, most_repeats, kept``.

    Trusted are documents that ``labels`` (doc_id, quality, toxic) has as quality 1 and never as toxic 1. Of these, ids that hash to 0
    modulo ``calibrate`` are not trained on: ``quantile`` of their perplexities is the threshold of their language, or of all
    languages where a language has none. Perplexity is per character, the end of the text included. ``order`` counts symbols, at most 5: a
    character from U+0780 on is two of them, so the model looks back less far there, and no two characters are ever alike to it. The mean over
    a short text says little, so ``slack / sqrt(n_symbols)`` is allowed on its logarithm, in calibration as in the decision.
    ``repeats`` is the share of words that repeat what stands just before (``repeated``); its threshold ``most_repeats`` is that quantile of
    the same documents, at least 0, with ``share_slack / sqrt(words)`` allowed. Both count lower-cased text.

    Null, empty and blank texts have no perplexity and aren't kept. Without trusted text to calibrate on, thresholds are null and all
    documents with text are kept. A null language is a language of its own. Repeated rows are documents of their own; a null id is
    never trusted. Empty tables give an empty result. Other columns are ignored. Ids must be whole numbers.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n_blocks, shards = layout(spark, total, block_bytes)

    def block(key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int").alias("block")

    # documents without an id are never trusted, so any block will do: their text deals them
    dealt = F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text_col))
    paged = docs.select(block(dealt), F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(to_pages, PAGES)
    good = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    trusted = good.filter("quality = 1 AND toxic <> 1 AND doc_id IS NOT NULL").select(block(F.col("doc_id").cast("long")), F.col("doc_id").cast("long"), (F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(calibrate)) == 0).alias("held"))

    def known(right: pa.Table, held: bool) -> np.ndarray:
        return np.sort(right.filter(right["held"] if held else pc.invert(right["held"]))["doc_id"].to_numpy())

    def message(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"shard": pa.array([], pa.int32()), "block": pa.array([], pa.int32()), "g": pa.array([], pa.binary()), "c": pa.array([], pa.binary())})
        train, found = known(right, False), _Sum()
        for ids, _, texts in _texts(left):
            code, text = grams(texts, order)
            mine = np.isin(ids, train)[text]
            k, c = np.unique(code[mine], return_counts=True)
            found.add(k, c)
            k = np.unique(code[~mine])
            found.add(k, np.zeros(len(k), np.int64))
        found.merge()
        order_, cuts = _shard_cuts(found.key, shards)
        g, c = found.key[order_], found.count[order_].astype(np.uint64)
        return pa.table({"shard": pa.array([s for s, _, _ in cuts], pa.int32()), "block": pa.array([key[0].as_py()] * len(cuts), pa.int32()), "g": pa.array([pack_sorted(g[a:b]) for _, a, b in cuts], pa.binary()), "c": pa.array([pack(c[a:b]) for _, a, b in cuts], pa.binary())})

    def summed(table: pa.Table) -> pa.Table:
        found = _Sum()
        for g, c in zip(table["g"], table["c"], strict=True):
            found.add(unpack_sorted(g.as_py()), unpack(c.as_py(), np.int64))
        found.merge()
        return pa.table({"g": pa.array(found.key.view(np.int64)), "c": pa.array(found.count)})

    def answer(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        g = right["g"].to_numpy().view(np.uint64)
        o = g.argsort()
        g, p = g[o], np.log(right["p"].to_numpy())[o].astype(np.float32)
        out = [pack(p[np.searchsorted(g, unpack_sorted(x.as_py()))].view(np.uint32)) for x in left["g"]]
        return pa.table({"block": left["block"], "shard": left["shard"], "g": left["g"], "p": pa.array(out, pa.binary())})

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        told = [(unpack_sorted(r["g"]), unpack(r["p"], np.float32)) for r in right.filter(pc.is_valid(right["g"])).to_pylist()]
        g, p = (np.concatenate([x[i] for x in told]) if told else np.zeros(0) for i in (0, 1))
        o = g.argsort()
        g, p = g[o], p[o].astype(float)
        flags = right.filter(pc.is_valid(right["doc_id"]))
        train, held = known(flags, False), known(flags, True)
        cols = [[] for _ in range(7)]
        for ids, langs, texts in _texts(left):
            code, text = grams(texts, order)
            n = np.bincount(text[characters(code)], minlength=len(texts))
            total = np.bincount(text, p[np.searchsorted(g, code)], len(texts))
            words, again = repeated(texts)
            blank = np.array([not t.strip(" \t\n\r\x0b\x0c") for t in texts])
            cols[0] += [None if i == LAST else i for i in ids.tolist()]
            cols[1] += langs
            cols[2] += np.where(np.isin(ids, train), 1, np.where(np.isin(ids, held), 2, 0)).tolist()
            cols[3] += np.where(blank, 0, n).tolist()
            cols[4] += [None if b else x for b, x in zip(blank.tolist(), (-total / n).tolist(), strict=True)]
            cols[5] += words.tolist()
            cols[6] += again.tolist()
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "lang", "role", "n_symbols", "entropy", "n_words", "n_repeated"])

    messages = gathered(paged, "block", n_blocks).cogroup(gathered(trusted, "block", n_blocks)).applyInArrow(message, "shard int, block int, g binary, c binary")
    counts = gathered(messages, "shard", shards).applyInArrow(summed, "g long, c long").repartition(shards, "g")
    sharded = probabilities(counts, order).mapInArrow(_with_shard(shards), "shard int, g long, p double")
    answers = gathered(messages, "shard", shards).cogroup(gathered(sharded, "shard", shards)).applyInArrow(answer, "block int, shard int, g binary, p binary")
    told = answers.select("block", "g", "p", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held")).unionByName(trusted.select("block", F.lit(None).cast("binary").alias("g"), F.lit(None).cast("binary").alias("p"), "doc_id", "held"))
    scored = gathered(paged, "block", n_blocks).cogroup(gathered(told, "block", n_blocks)).applyInArrow(score, "doc_id long, lang string, role int, n_symbols long, entropy double, n_words long, n_repeated long")
    return _judge(checkpointed(scored), quantile, slack, share_slack)


def _with_shard(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((mix64(g) % np.uint64(shards)).astype(np.int32)), b.column(0), b.column(1)], ["shard", "g", "p"])

    return run


def _judge(scored: DataFrame, quantile: float, slack: float, share_slack: float) -> DataFrame:
    """Thresholds from the held-out trusted documents: the quantiles of entropies and of shares of repeated words in steps of a
    thousandth, over all of them."""
    scored = scored.withColumn("sure", F.col("entropy") - slack / F.sqrt("n_symbols")).withColumn("repeats", F.when(F.col("entropy").isNotNull(), F.try_divide("n_repeated", "n_words")))
    scored = scored.withColumn("sure_repeats", F.col("repeats") - share_slack / F.sqrt("n_words"))
    # steps are few, so the buffer of a language is, too; it is filled before the shuffle
    most = F.expr(f"percentile_disc({quantile}) WITHIN GROUP (ORDER BY step)") / 1000
    rows = scored
    for name in ("sure", "sure_repeats"):
        steps = scored.filter("role = 2 AND entropy IS NOT NULL").select("lang", F.ceil(F.col(name) * 1000).cast("long").alias("step"))
        own = small(checkpointed(steps.groupBy(F.col("lang").alias("of")).agg(most.alias("own"))), "of")
        whole = steps.agg(most.alias("most")).scalar()
        rows = rows.join(own, F.col("lang").eqNullSafe(F.col("of")), "left").withColumn(f"most_{name}", F.coalesce("own", whole)).drop("own", "of")
    limit, share = F.col("most_sure"), F.when(F.col("most_sure_repeats").isNotNull(), F.greatest("most_sure_repeats", F.lit(0.0)))
    within = (F.col("sure") <= F.coalesce(limit, F.col("sure"))) & (F.col("sure_repeats") <= F.coalesce(share, F.col("sure_repeats")))
    return rows.select(
        "doc_id", "lang", (F.col("role") > 0).alias("trusted"), "n_symbols", F.exp("entropy").alias("perplexity"), F.exp(limit).alias("threshold"),
        "repeats", share.alias("most_repeats"), (F.col("entropy").isNotNull() & within).alias("kept"),
    )
