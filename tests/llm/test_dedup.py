"""Exact, near and substring dedup against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from millrace.llm import simhash
from millrace.llm.exact_dedup import exact_dedup
from millrace.llm.substring import dedup_windows
from millrace.llm.suffix import dedup_bytes
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
LAST = (1 << 63) - 1
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def rows_of(df):
    return [(LAST if r[0] is None else r[0], r[1] or "") for r in df.select("doc_id", "text").collect()]


def both(edges, docs):
    return edges.select("doc_id", "text").unionByName(docs.select((F.col("doc_id") + 100).alias("doc_id"), "text"))


def slow_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i))
    return sorted((i, min(g)[1], len(g), i == min(g)[1], hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g)


def test_exact(edges, docs):
    df = both(edges, docs)
    got = sorted(tuple(LAST if x is None else x for x in r) for r in exact_dedup(df).collect())
    assert got == slow_exact(rows_of(df))


def test_exact_is_native(docs):
    plan = exact_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def slow_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t.translate({i: i + 32 for i in range(65, 91)}))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ([" ".join(w)] if len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(keys, linked):
    parent = list(range(len(keys)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return [find(i) for i in range(len(keys))]


@pytest.mark.parametrize("bits,tree", [(3, {}), (3, {"shard_points": 16}), (3, {"shard_points": 16, "hot": 1, "deepest": 3}), (5, {"shard_points": 16, "hot": 1})])
def test_near(edges, docs, bits, tree):
    df = both(edges, docs)
    rows = rows_of(df)
    fp = [slow_fingerprint(t) for _, t in rows]
    root = closure(fp, [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= bits])
    least = {r: min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root)}
    want = sorted((i, f"{f:016x}", least[r]) for (i, _), f, r in zip(rows, fp, root, strict=True))
    got = sorted((LAST if r[0] is None else r[0], r[1], r[2]) for r in simhash.near_dedup(df, bits, **tree).collect())
    assert got == want


def test_tree_finds_all_links_in_random_and_clustered_points():
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    x = np.repeat(centres, 100)
    for _ in range(4):
        x = x ^ np.where(rng.random(len(x)) < 0.5, np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64), np.uint64(0))
    x = np.unique(np.concatenate([x, rng.integers(0, 1 << 63, 3000, dtype=np.uint64)]))
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 3
    for quarter in range(4):
        for mask, reach in ((simhash.QUARTERS[quarter], 0), *((m, 1) for m in simhash.halves(quarter))):
            tree = simhash.build(x[::9], mask, 3)
            seen = np.zeros((len(x), len(x)), bool)
            homes = np.zeros(len(x), int)
            for _, idx, home in simhash.deal(tree, x, mask, reach):
                homes[idx[home]] += 1
                seen[np.ix_(idx, idx[home])] = True
            assert (homes == 1).all()
            close = np.bitwise_count((x[:, None] ^ x[None, :]) & mask) <= reach
            assert seen[near & close].all()
        start, leaf, home = simhash.leaves(simhash.build(x[::9], simhash.QUARTERS[quarter], 5), quarter, 0)
        assert (np.diff(start) == 1).all() and home.all() and len(set(leaf.tolist())) > 8
    want = closure(list(x), list(zip(*np.nonzero(near), strict=True)))
    forest = simhash.Forest(len(x))
    for quarter in range(4):
        metrics = [((simhash.QUARTERS[quarter],), 0), (simhash.halves(quarter), 1)]
        forest.join(np.arange(len(x)), simhash.link(x, np.ones(len(x), bool), metrics, 3, leaf=64))
        y = (x & ~simhash.QUARTERS[quarter]) | np.uint64(0xABCD << 16 * quarter)  # one value of the quarter for all
        label = simhash.link(y, np.ones(len(y), bool), metrics, 3, leaf=64)
        near_y = np.bitwise_count(y[:, None] ^ y[None, :]) <= 3
        plain = closure(list(y), list(zip(*np.nonzero(near_y), strict=True)))
        assert [list(label).index(v) for v in label] == [plain.index(v) for v in plain]
    same = lambda a: [list(a).index(v) for v in a]
    assert same(forest.label) == same(want)


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 40)]
    got = {r["u"]: r["root"] for r in simhash.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 51)} | {1000 + i: 1000 for i in range(1, 40)}


def slow_windows(rows, units, n, join):
    cut, least = [units(t) for _, t in rows], {}
    for (i, _), u in zip(rows, cut, strict=True):
        for k in range(len(u) - n + 1):
            w = join(u[k : k + n])
            least[w] = min(i, least.get(w, i))
    for (i, _), u in zip(rows, cut, strict=True):
        gone = bytearray(len(u))
        for k in range(len(u) - n + 1):
            if least[join(u[k : k + n])] < i:
                gone[k : k + n] = b"\x01" * n
        kept = join([u[k : k + 1] if isinstance(u, bytes) else u[k] for k in range(len(u)) if not gone[k]])
        yield i, len(u), sum(gone), len(re.findall(rb"\x01+", gone)), hashlib.sha256(kept).hexdigest()


#: Masks of the rolling hashes: a few bits only force collisions everywhere.
MASKS = [(1 << 64) - 1, 0x3, 0xF << 60]


@pytest.mark.parametrize("size,mask", [(3, MASKS[0]), *((13, m) for m in MASKS)])
def test_word_windows(edges, docs, size, mask):
    df = both(edges, docs)
    want = sorted((a, b, c, e) for a, b, c, _, e in slow_windows(rows_of(df), lambda t: WORDS.findall(t.encode()), size, b" ".join))
    got = sorted((LAST if r[0] is None else r[0], *r[1:]) for r in dedup_windows(df, size, block_bytes=1 << 17, mask=mask).collect())
    assert got == want


@pytest.mark.parametrize("length,mask", [(9, MASKS[0]), *((50, m) for m in MASKS)])
def test_suffixes(edges, docs, length, mask):
    df = both(edges, docs)
    want = sorted(slow_windows(rows_of(df), lambda t: t.encode(), length, lambda u: u if isinstance(u, bytes) else b"".join(u)))
    got = sorted((LAST if r[0] is None else r[0], *r[1:]) for r in dedup_bytes(df, length, block_bytes=1 << 17, mask=mask).collect())
    assert got == want


def test_long_texts_in_pieces_give_spans(spark, monkeypatch):
    from millrace.llm import blocks, suffix

    body = "".join(chr(97 + i * i % 23) for i in range(5000))
    df = spark.createDataFrame([(2, body), (1, body[3000:3200])], "doc_id long, text string")
    table = df.select("doc_id", "text").toArrow()
    monkeypatch.setattr(suffix, "BUFFER", 512)
    monkeypatch.setattr(blocks, "BUFFER", 512)
    parts = suffix.Suffixes(50).parts(table)
    assert len(parts) > 5 and sum(int((p.last - p.first + 1).sum()) for p in parts) == (5000 - 49) + (200 - 49)
    row = dedup_bytes(df, with_bytes=True).filter("doc_id = 2").first()
    raw = body.encode()
    assert b"".join(raw[a:b] for a, b in zip([0, *(s["end"] for s in row["spans"])], [*(s["start"] for s in row["spans"]), len(raw)], strict=True)) == row["kept"]
    assert row["n_removed"] >= 200


def test_kept_text(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (2, "x a b c y")], "doc_id long, text string")
    assert {r["doc_id"]: r["kept_text"] for r in dedup_windows(df, 3, with_text=True).collect()} == {1: "a b c d e", 2: "x y"}


@pytest.mark.parametrize("op", [exact_dedup, simhash.near_dedup, dedup_windows, dedup_bytes])
def test_empty_table(empty, op):
    assert op(empty).collect() == []


def test_queries_equal_their_sql(spark):
    import duckdb

    from millrace.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, SF)
        ran = con.execute(sql)
        names = [d[0] for d in ran.description]
        assert sorted(map(str, df.select(*sorted(names)).collect()[0])) and sorted(names) == sorted(df.columns)
        assert sorted(tuple(r[n] for n in names) for r in df.collect()) == sorted(ran.fetchall()), name
