"""SentencePiece, sharding, mixing, language ID, quality, media, pipeline."""

import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import sentencepiece
import xxhash
from millrace.llm import common, langid, media, mixing, progressive_jpeg, quality
from millrace.llm import sentencepiece_codec as codec
from millrace.llm.sharding import shard, write_shards
from pyspark.sql import functions as F

# ---- 1 ------------------------------------------------------------------------------------------


def scan(text, chunk):
    """The operator's steps for one text, without Spark."""
    sp = codec.inner(codec.MODEL)
    t = sp.prefix + text.replace(" ", codec.SPACE)
    n, m, starts, stops = -(-len(t) // chunk), [], [], []
    for k in range(n):
        lo, hi = max(0, k * chunk - sp.reach), min(len(t), (k + 1) * chunk + sp.reach)
        a, b, x = codec.transfer(sp, t[lo:hi], k * chunk - lo if k else None, (k + 1) * chunk - lo if k < n - 1 else None)
        m.append(x)
        starts.append([lo + e for _, e in a])
        stops.append([lo + e for _, e in b])
    states = codec.path(m, 0, 0)
    return [i for k in range(n) for i in sp.ids(t[starts[k][states[k]] : stops[k][states[k + 1]]])]


def test_scan_equals_the_library():
    rng, full = random.Random(3), codec.whole(codec.MODEL)
    for _ in range(200):
        letters = rng.choice([" a", "the in ing ation", "ab ", "a", " é中x \n\t▁﷽", "Hello World 12345 ==== ----"])
        text = "".join(rng.choice(letters) for _ in range(rng.choice([40, 90, 200])))
        assert scan(text, rng.choice([16, 17, 33, 64])) == full.encode(text), text


def test_products_are_associative():
    rng = np.random.default_rng(1)
    a, b, c = (np.where(rng.random((4, 4)) < 0.4, codec.NEVER, rng.integers(0, 9, (4, 4))) for _ in range(3))
    assert (codec.maxplus(codec.maxplus(a, b), c) == codec.maxplus(a, codec.maxplus(b, c))).all()


@pytest.mark.parametrize("chunk,group", [(1 << 15, 64), (100, 3)])
def test_encode(edges, docs, chunk, group):
    df = edges.select("doc_id", "text").unionByName(docs.select((F.col("doc_id") + 100).alias("doc_id"), "text").limit(20 if chunk == 100 else 200))
    sp = sentencepiece.SentencePieceProcessor(model_file=codec.MODEL)
    want = sorted((-1 if r[0] is None else r[0], tuple(sp.encode(r[1] or ""))) for r in df.collect())
    rows = codec.encode(df, chunk=chunk, group=group).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], tuple(r["ids"])) for r in rows) == want
    for r in rows:
        assert r["ids_sha256"] == hashlib.sha256(np.asarray(r["ids"], "<i4").tobytes()).hexdigest() and r["n_tokens"] == len(r["ids"])
        assert r["round_trip"] == (r["doc_id"] != 12)  # U+2581 stands for a space


def test_decode(spark):
    df = spark.createDataFrame([(1, codec.whole(codec.MODEL).encode("a  b\n")), (2, None)], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in codec.decode(df).collect()} == {1: "a  b\n", 2: None}


# ---- 4 ------------------------------------------------------------------------------------------


def check_shards(rows, df, n, tolerance=0.001):
    assert len(rows) == df.count()
    size = {(r["doc_id"], r["text"]): len((r["text"] or "").encode()) + 1 for r in df.select("doc_id", "text").collect()}
    assert Counter((r["size"], r["text_crc32"]) for r in rows) == Counter((size[r["doc_id"], r["text"]], zlib.crc32((r["text"] or "").encode())) for r in df.select("doc_id", "text").collect())
    bytes_, slots = Counter(), {}
    for r in rows:
        bytes_[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    whole = sum(bytes_.values())
    # a boundary misses its goal by the tolerance or half a document, whichever is larger; a shard has two
    assert all(abs(bytes_[i] - whole / n) <= 2 * max(tolerance * whole / n, max(r["size"] for r in rows) / 2) for i in range(n))


@pytest.mark.parametrize("n,segment", [(8, 1 << 20), (3, 7), (1, 50)])
def test_shards(docs, n, segment):
    check_shards(shard(docs, n, segment_rows=segment).collect(), docs, n)


def slow_shards(rows, n, tolerance):
    """Each row's possible shards: rows in order of (hash of text, hash of id), cut where a cut is within the tolerance of its goal, or nearest to it."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    seven = xxhash.xxh64_intdigest((7).to_bytes(4, "little"), 42)
    keyed = sorted((signed(xxhash.xxh64_intdigest((t or "").encode(), 42)), signed(xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), seven)), i, len((t or "").encode()) + 1) for i, t in rows)
    whole, at, cuts = sum(k[3] for k in keyed), 0, [(0, None)]
    for k in keyed:
        at += k[3]
        cuts.append((at, k[2]))
    goals = [whole * i / n for i in range(1, n)]
    best = [min(abs(c - g) for c, _ in cuts) for g in goals]
    slack = tolerance * whole / n
    return keyed, cuts, [[c for c, _ in cuts if abs(c - g) <= max(b, slack)] for g, b in zip(goals, best, strict=True)]


@pytest.mark.parametrize("n", [8, 3])
def test_shards_equal_brute_force(docs, n):
    keyed, _, allowed = slow_shards([(r["doc_id"], r["text"]) for r in docs.collect()], n, 0.001)
    shard_of = {r["doc_id"]: (r["shard"], r["slot"]) for r in shard(docs, n).collect()}
    placed = [shard_of[i][0] for _, _, i, _ in keyed]
    assert placed == sorted(placed)
    size = Counter()
    for (_, _, i, z), s in zip(keyed, placed, strict=True):
        size[s] += z
    below = list(itertools.accumulate(size[i] for i in range(n)))
    assert all(below[i] in allowed[i] for i in range(n - 1))


def test_shards_of_edges_and_of_one_hot_text(spark, edges, empty):
    check_shards(shard(edges, 8).collect(), edges, 8)
    assert shard(empty, 8).collect() == []
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    check_shards(shard(hot, 8).collect(), hot, 8)


def test_write_shards(docs, tmp_path):
    placed = write_shards(docs, str(tmp_path / "s"), 4)
    back = docs.sparkSession.read.parquet(str(tmp_path / "s"))
    assert {(r["doc_id"], r["shard"]) for r in placed.collect()} == {(r["doc_id"], r["__shard"]) for r in back.collect()}


# ---- 5 ------------------------------------------------------------------------------------------


def slow_targets(sizes, cap=3):
    """Shares by weight, one cap after the other, in fractions."""
    names = sorted(sizes, key=lambda x: (x is None, [ord(c) for c in x or ""]))
    w = {x: i % 3 + 1 for i, x in enumerate(names)}
    left, free, out = Fraction(sum(sizes.values())), set(names), {}
    while free:
        unit = left / sum(w[x] for x in free)
        over = {x for x in free if unit * w[x] > cap * sizes[x]}
        if not over:
            return out | {x: unit * w[x] for x in free}
        out |= {x: Fraction(cap * sizes[x]) for x in over}
        left, free = left - sum(cap * sizes[x] for x in over), free - over
    return out


def test_plan_of_sources(spark):
    rng = random.Random(2)
    for sizes in ({"a": 100, "b": 100, "c": 100}, {"a": 1000, "b": 10, "c": 1, None: 50}, {}, {"a": 0}, {"é": 5, "z": 0, "Z": 7, "": 2}, {f"{i}": int(10 ** rng.uniform(0, 5)) for i in range(500)}):
        rows = mixing.plan(spark.createDataFrame([(k, v, 1) for k, v in sizes.items()], "source string, s long, n long").repartition(5)).collect()
        want = slow_targets(sizes)
        assert {r["source"] for r in rows} == set(want) and sorted(r["source_ix"] for r in rows) == list(range(len(want)))
        assert all(math.isclose(r["target"], want[r["source"]], abs_tol=1e-9) and r["base"] + r["p"] <= 3 for r in rows)
        assert all(math.isclose(r["base"] + r["p"], r["target"] / r["source_size"]) for r in rows if r["source_size"])


def test_flight_keeps_both_sums():
    rng = np.random.default_rng(0)
    size, p = rng.integers(0, 50, 500), rng.random(500)
    out = mixing.flight(p, size, rng)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert math.isclose(out.sum(), p.sum(), rel_tol=1e-6) and math.isclose((out * size).sum(), (p * size).sum(), rel_tol=1e-6)


def test_flight_is_unbiased():
    size, p = np.array([3, 1, 4, 1, 5, 9, 2, 6]), np.full(8, 0.4)
    mean = np.mean([mixing.flight(p, size, np.random.default_rng(s)) for s in range(4000)], axis=0)
    assert np.abs(mean - p).max() < 0.04


@pytest.mark.parametrize("block_rows", [4000, 20])
def test_mix(docs, edges, block_rows):
    df = docs.select("doc_id", "text", "source").unionByName(edges.select("doc_id", "text", "source"))
    out = mixing.mix(df, block_rows=block_rows)
    rows = out.collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in rows) == Counter((r["doc_id"], size(r["text"]), r["source"]) for r in df.collect())
    sizes = Counter()
    for r in df.collect():
        sizes[r["source"]] += size(r["text"])
    want = slow_targets(sizes)
    for s, t in want.items():
        mine = [r for r in rows if r["source"] == s]
        assert all(math.isclose(r["target"], t, abs_tol=1e-9) and r["source_size"] == sizes[s] for r in mine) and all(r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"]) for r in mine)
        assert abs(sum(r["taken"] for r in mine) - t) <= max(r["size"] for r in mine)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(df.repartition(5), block_rows=block_rows).collect()))


def test_mix_of_nothing_and_of_as_many_sources_as_documents(empty, docs):
    assert mixing.mix(empty).collect() == []
    each = docs.withColumn("source", F.concat(F.lit("s"), "doc_id"))
    wide, narrow = (sorted(map(str, mixing.mix(each, broadcast_bytes=n).collect())) for n in (0, 1 << 30))
    assert wide == narrow and len(wide) == docs.count()


# ---- 8 ------------------------------------------------------------------------------------------


def test_language_id(docs, edges, empty):
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    out = {r["doc_id"]: r for r in langid.identify(edges).collect()}
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (3, 4, 5)) and all(0 <= r["score"] <= 1 for r in out.values())
    assert langid.identify(empty).collect() == []
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_trigrams_and_vectors():
    codes, counts = langid.trigrams("Ab, ab!")
    assert counts.sum() == 5 and dict(Counter(counts.tolist())) == {2: 2, 1: 1}
    space = langid.Space(1024)
    a, b, c = (space.letter(np.array([ord(x)]))[0].astype(int) for x in "abc")
    code = np.array([(ord("a") << 42) | (ord("b") << 21) | ord("c")], np.uint64)
    assert (space.bundle(code, np.array([1])) == np.roll(a, 2) * np.roll(b, 1) * c).all()
    space.vectors = space.vectors[:40]  # a cache that is soon full
    for word in ("abcdefgh", "ijklmnop", "qrstuvwxyz", "abcdefgh"):
        codes, counts = langid.trigrams(word * 2)
        assert (space.bundle(codes, counts) == counts @ space.bind(codes)).all()
    many, counts = langid.trigrams("and a longer text")
    assert (space.bundle(many, counts) == langid.Space(1024).bundle(many, counts)).all()
    assert (space.bundle(many, counts) == counts @ space.bind(many)).all()


def slow_language(rows):
    """Prototypes and cosines, one letter after the other."""
    space = langid.Space(1024)

    def vector(text):
        out = np.zeros(1024, np.int64)
        s = re.sub(r"\x00+", "\x00", "".join(c if c.isalpha() else "\x00" for c in f"\x00{text.lower()}\x00"))
        for k in range(len(s) - 2):
            x, y, z = (space.letter(np.array([ord(c)]))[0].astype(np.int64) for c in s[k : k + 3])
            out += np.roll(x, 2) * np.roll(y, 1) * z
        return out

    learned = {}
    for i, text, lang in rows:
        if text and lang is not None and zlib.crc32(str(i).encode()) % 3 != 1 and any(c.isalpha() for c in text):
            learned[lang] = learned.get(lang, 0) + vector(text)
    for i, text, _ in rows:
        if not text or not any(c.isalpha() for c in text) or not learned:
            yield i, "und", 0.0
            continue
        v = vector(text)
        cos = {n: float(v @ p) / np.linalg.norm(v) / np.linalg.norm(p) for n, p in learned.items()}
        best = max(sorted(cos), key=lambda n: cos[n])
        yield i, best, min(1.0, max(0.0, cos[best]))


@pytest.mark.parametrize("block", [512, 2, 1])
def test_language_id_equals_brute_force(docs, spark, block):
    few = docs.select("doc_id", F.substring("text", 1, 300).alias("text"), "lang").orderBy("doc_id").limit(60)
    few = few.unionByName(spark.createDataFrame([(10**6, None, "en"), (10**6 + 1, "12 :-)", "en"), (10**6 + 2, "漢字 zz", "zz")], few.schema))
    rows = few.collect()
    got = {r["doc_id"]: r for r in langid.identify(few, block=block).collect()}
    for i, lang, score in slow_language(rows):
        assert got[i]["lang_pred"] == lang and math.isclose(got[i]["score"], score, abs_tol=1e-5)
    assert len({r["lang"] for r in rows}) > 3 and len(got) == len(rows)


# ---- 9 ------------------------------------------------------------------------------------------


def slow_model(train, seen, order):
    counts = {order: Counter(g for s in train for g in s)}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    kinds = len({g[-1] for s in seen for g in s})
    cut, total, held = {}, {}, {}
    for k, c in counts.items():
        n = [sum(v == i for v in c.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0
        d = [0] + [i - (i + 1) * y * n[i + 1] / n[i] if n[i] and n[1] + 2 * n[2] else 0.5 for i in (1, 2, 3)]
        cut[k] = [0] + [x if 0 < x <= i else 0.5 for i, x in enumerate(d[1:], 1)]
        total[k], held[k] = Counter(), Counter()
        for g, v in c.items():
            total[k][g[:-1]] += v
            held[k][g[:-1]] += cut[k][min(v, 3)]

    def p(g):
        k = len(g)
        if not k:
            return 1 / kinds
        if not total[k][g[:-1]]:
            return p(g[1:])
        v = counts[k].get(g, 0)
        return (v - cut[k][min(v, 3)]) / total[k][g[:-1]] + held[k][g[:-1]] / total[k][g[:-1]] * p(g[1:])

    return p


SCRIPTS = ["漢字の文章と、ひらがな。", "人人生而自由,在尊严和权利上一律平等。", "सभी मनुष्यों को गौरव और अधिकारों के मामले में", "มนุษย์ทั้งหลายเกิดมามีอิสระและเสมอภาคกัน", "ߞߏ ހުރިހާ 😀😁 \x00\x01\x02 Ünï"]


def test_symbols_are_distinct():
    """Each code point has its own symbols, so no two texts are alike to the model but for white space."""
    points = [p for p in range(0x110000) if p not in (0x20, *range(0x09, 0x0E))]
    code, text = quality.grams([chr(p) for p in points], 2)
    code &= np.uint64((1 << quality.BITS) - 1)
    two = np.bincount(text) == 3  # lead, trail and end
    assert two.sum() == 0x110000 - quality.WIDE
    first, second = code[np.searchsorted(text, np.arange(len(points)))], code[np.searchsorted(text, np.arange(len(points))) + 1]
    assert len(set(zip(first.tolist(), np.where(two, second, 0).tolist(), strict=True))) == len(points)
    assert quality.characters(code).sum() == 2 * len(points)


def test_quality_equals_a_plain_model(spark, docs):
    rng = random.Random(8)
    other = spark.createDataFrame([(10**6 + i, "".join(rng.choice(SCRIPTS)[rng.randint(0, 3) :] + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(1, 6))), "xx") for i in range(40)], "doc_id long, text string, lang string")
    small = docs.select("doc_id", "text", "lang").limit(60).unionByName(other)
    labels = small.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).filter("doc_id % 3 <> 0")
    rows = {r["doc_id"]: r for r in quality.classify(small, labels, order=4).collect()}
    held = {r[0] for r in labels.filter(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(5)) == 0).select("doc_id").collect()}
    trusted = {r["doc_id"] for r in labels.collect()}

    def symbols(t):
        """The stated symbols, one character after the other."""
        for c in re.sub(r"[\x20\x09-\x0D]+", " ", t.lower()):
            yield from [(c,)] if ord(c) < 0x780 else [("lead", ord(c) // 1024), ("trail", ord(c) % 1024)]

    def cut(t):
        s = ["begin"] * 3 + list(symbols(t)) + ["end"]
        return [tuple(s[i : i + 4]) for i in range(len(s) - 3)]

    seqs = {r["doc_id"]: cut(r["text"]) for r in small.collect()}
    p = slow_model([s for i, s in seqs.items() if i in trusted - held], list(seqs.values()), 4)
    for i, s in itertools.chain(itertools.islice(seqs.items(), 25), list(seqs.items())[60:]):
        n = sum(g[-1][0] != "lead" for g in s)
        want = math.exp(-sum(math.log(p(g)) for g in s) / n)
        assert rows[i]["n_symbols"] == n and math.isclose(rows[i]["perplexity"], want, rel_tol=1e-5) and rows[i]["trusted"] == (i in trusted)


def test_quality_of_test_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).join(labels.select(F.col("doc_id").alias("k"), "quality"), F.col("doc_id") == F.col("k")).collect()
    good, bad = ([r["kept"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2


def test_repeated_words():
    n, again = quality.repeated(["the the  The", "", "a b a b a b", "a b c a d", "the", "the x " + "y z " * 2])
    assert n.tolist() == [3, 0, 6, 5, 1, 6] and again.tolist() == [1, 0, 3, 0, 0, 1]


def junk(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if any(len(list(g)) >= 5 for _, g in itertools.groupby(words)):
        return "repeated"
    if re.search(r"%%%|&&&|\*\*\*|###|\$\$\$", text):
        return "symbols"
    return "table" if text.count(" | ") > 5 else "capitals" if text.count("!!") > 3 else "other"


def test_quality_finds_each_kind_of_junk(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    told = labels.groupBy(F.col("doc_id").alias("k")).agg(F.max("quality").alias("quality"))
    text = docs.select(F.col("doc_id").alias("j"), "text")
    rows = quality.classify(docs, labels).join(told, F.col("doc_id") == F.col("k")).join(text, F.col("doc_id") == F.col("j")).select("text", "quality", "kept", "trusted").collect()
    kept = {}
    for r in rows:
        kept.setdefault(junk(r["text"] or "") if r["quality"] == 0 else "trusted" if r["trusted"] else "toxic", []).append(r["kept"])
    print({k: (sum(v), len(v)) for k, v in kept.items()})
    assert all(len(kept[k]) > 100 and np.mean(kept[k]) < 0.05 for k in ("repeated", "symbols", "table", "capitals")) and np.mean(kept["trusted"]) > 0.99


def test_quality_edges(spark, edges, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in quality.classify(edges, none).collect()}
    assert len(rows) == 13 and all(rows[i]["perplexity"] is None and not rows[i]["kept"] for i in (3, 4, 5)) and rows[1]["kept"] and rows[1]["threshold"] is None
    assert quality.classify(empty, none).collect() == []
    labels = spark.createDataFrame([(1, 1, None), (1, 1, 0), (2, 1, 1), (2, 1, 0), (None, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int")
    assert {r["doc_id"] for r in quality.classify(edges, labels).collect() if r["trusted"]} == {1}


# ---- 10 -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("density", [1.0, 0.3, 0.03, 0.0])
def test_jpeg_keeps_coefficients(density):
    rng = np.random.default_rng(int(100 * density))
    wide, high = np.array([1, 2, 3, 1, 5]), np.array([1, 2, 1, 4, 3])
    n = 6 * int((wide * high).sum())
    for top in (2, 4, 128):
        c = (rng.random((n, 64)) < density) * rng.integers(-top, top, (n, 64))
        back, w, h, notes = progressive_jpeg.read(progressive_jpeg.write(c, wide, high, [b"x"] * 5))
        assert (back == c).all() and (w == wide).all() and (h == high).all() and notes == [b"x"] * 5


def test_inverse_transform():
    c = np.zeros((6, 64))
    c[:4, 0], c[4, 0], c[5, 0] = 80, 16, -16
    (rgb,) = progressive_jpeg.tensors(c, np.array([1]), np.array([1]))
    y, cb, cr = 138, 2, -2
    assert rgb.shape == (16, 16, 3) and (abs(rgb[0, 0].astype(int) - [y + 1.402 * cr, y - 0.344 * cb - 0.714 * cr, y + 1.772 * cb]) <= 1).all()
    k = np.arange(8)
    one = np.zeros((6, 64))
    one[0, 2] = 100  # zigzag place 2 is the first vertical frequency
    want = 100 * np.sqrt(1 / 8) * 0.5 * np.cos((2 * k + 1) * np.pi / 16) + 128
    (rgb,) = progressive_jpeg.tensors(one, np.array([1]), np.array([1]))
    assert np.abs(rgb[:8, 0, 0] - want).max() <= 1 and (rgb[:8, :8, 0] == rgb[:8, :1, 0]).all()


def test_media(edges, docs, empty):
    df = edges.select("doc_id", "text").unionByName(docs.select("doc_id", "text").limit(50))
    out = media.describe(df, with_media=True)
    want = Counter()
    for r in df.collect():
        raw = (r["text"] or "").encode()
        p = raw + b"\xff" * (-len(raw) % 576 or 576 * (not raw))
        want[r["doc_id"], len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])] += 1
    rows = out.collect()
    assert Counter(tuple(r)[:5] for r in rows) == want
    assert all((r["media_bytes"], r["media_sha256"]) == (len(r["media"]), hashlib.sha256(r["media"]).hexdigest()) for r in rows)
    assert len({(r["feature"], r["media_sha256"]) for r in rows if not r["n_bytes"]}) == 1
    loaded = media.load(out.filter("doc_id = 10")).collect()
    assert all(len(r["rgb"]) == 3 * r["height"] * r["width"] for r in loaded)
    assert media.describe(empty).collect() == []


def test_long_payload_has_several_pictures(spark, monkeypatch):
    text = "é" * 700_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = media.describe(df, with_media=True).first()
    files = media.split(r["media"])
    assert len(files) == 3 and b"".join(media.contents([f])[0][0] for f in files) == media.payload(text.encode())


# ---- pipeline -----------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as pipe
    from millrace.llm.exact_dedup import exact_dedup
    from millrace.llm.simhash import near_dedup

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(spark.createDataFrame([(10**6, None, None, None, 0), (10**6 + 1, "12 34", "en", "a", 5)], "doc_id long, text string, lang string, source string, n_chars long"))
    before = docs
    for i, (_, stage) in enumerate(pipe.STAGES):
        out = stage(spark, before, sf)
        if i < 4:
            assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / str(i)))
            out = spark.read.parquet(str(tmp_path / str(i)))
        ids = Counter(r["doc_id"] for r in out.select("doc_id").collect())
        if i == 0:
            assert set(ids) == {r["doc_id"] for r in docs.collect()} - {10**6, 10**6 + 1}
        elif i == 1:
            assert set(ids) == {r["doc_id"] for r in exact_dedup(before).filter("kept").collect()}
        elif i == 2:
            assert set(ids) == {r["component_id"] for r in near_dedup(before).collect()}
        elif i == 3:
            assert ids == {r["doc_id"]: r["copies"] for r in mixing.mix(before).filter("copies > 0").collect()}
        else:
            sp = codec.whole(codec.MODEL)
            text = {r["doc_id"]: r["text"] for r in before.collect()}
            assert all(r["ids"] == sp.encode(text[r["doc_id"]]) for r in out.collect()) and sum(ids.values()) == before.count()
        before = out
    assert pipe.run(spark, sf).count() > 0


def test_pipeline_keeps_the_language_that_was_found(spark):
    import corpus_pipeline as pipe

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs).collect()}
    assert all(r["lang"] == found[r["doc_id"]] for r in pipe.language_id(spark, docs, "").collect())


def test_run_leaves_one_table(spark, tmp_path):
    """Tables of finished stages are removed; the last one is read by the result."""
    import corpus_pipeline as pipe

    made, plain = [], common.written

    def note(df):
        made.append(plain(df))
        return made[-1]

    with pytest.MonkeyPatch.context() as m:
        m.setattr(pipe, "written", note)
        n = pipe.run(spark, "/root/testdata/sf0.001").count()
    folders = [next(iter(df.inputFiles())).removeprefix("file://").rsplit("/", 1)[0] for df in made]
    assert n > 0 and [os.path.exists(f) for f in folders] == [False] * (len(folders) - 1) + [True]


ROWS = [
    (3, "one two three four five"), (5, "one two three four  five"), (5, "a wholly different text of its own"), (5, "a wholly different text of its own"), (None, "null ids keep this text"),
    (None, "and this other one as well"), (None, "and this other one as well"), (None, None), (7, ""), (8, "same letters"), (8, "sameletters"), (None, "one two three four five"),
]


@pytest.fixture(scope="session")
def repeats(spark):
    return spark.createDataFrame([(i, t, "en", "ab"[n % 2], 0) for n, (i, t) in enumerate(ROWS)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_dedup_stages_decide_by_row(spark, repeats):
    import corpus_pipeline as pipe
    from test_dedup import closure, slow_fingerprint

    groups = {}
    for i, t in ROWS:
        groups.setdefault(re.sub(r"\s", "", t or ""), []).append((-len(t or ""), i is None, i or 0, t or ""))
    exact = Counter((None if g[1] else g[2], g[3]) for g in map(min, groups.values()))
    assert Counter((r["doc_id"], r["text"] or "") for r in pipe.exact(spark, repeats, "").collect()) == exact
    fp = [slow_fingerprint(t or "") for _, t in ROWS]
    root = closure(fp, [(a, b) for a in range(len(fp)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 3])
    least = {r: min((ROWS[k][0] is None, ROWS[k][0] or 0) for k in range(len(ROWS)) if root[k] == r) for r in root}
    got = [(r["doc_id"], r["text"] or "") for r in pipe.near(spark, repeats, "").collect()]
    home = {(i, t or ""): r for (i, t), r in zip(ROWS, root, strict=True)}
    assert sorted(home[x] for x in got) == sorted(least) and all((i is None, i or 0) == least[home[i, t]] for i, t in got)


def test_mixing_takes_each_row_as_often_as_the_mix_says(spark, repeats, docs):
    import corpus_pipeline as pipe

    many = repeats.unionByName(docs.select("doc_id", "text", "lang", "source", "n_chars").limit(60)).unionByName(docs.limit(90).select(F.lit(None).cast("long").alias("doc_id"), "text", "lang", "source", "n_chars"))
    many = common.checkpointed(many)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = Counter()
    for r in mixing.mix(many).collect():
        want[r["doc_id"], r["source"], r["size"]] += r["copies"]
    out = pipe.mixing(spark, many, "").collect()
    assert Counter((r["doc_id"], r["source"], size(r["text"])) for r in out) == +want
    own, got = Counter(map(tuple, many.collect())), Counter(map(tuple, out))
    assert all(n <= 3 * own[r] for r, n in got.items())
