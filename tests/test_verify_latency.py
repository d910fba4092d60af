import pytest
from pyspark.sql import functions as F

from millrace.operators import latency, verify

T = "id int, s string, d double"


def test_digest_tells_null_empty_and_quotes_apart(spark):
    seen = set()
    for rows in ([(1, None, 1.0)], [(1, "", 1.0)], [(1, "\\N", 1.0)], [(1, "a|b", 1.0)], [(1, "a\\|b", 1.0)], [(1, "a", float("nan"))], [(1, "a", None)]):
        seen.add(verify.checksum(spark.createDataFrame(rows, T), ["id"]).first()["digest"])
    assert len(seen) == 7


def test_digest_ignores_partitioning_and_row_order(spark):
    df = spark.range(1000).select("id", (F.col("id") * 7 % 13).alias("v"))
    digests = {verify.checksum(x, ["id"]).first()["digest"] for x in (df, df.repartition(7), df.orderBy(F.desc("id")))}
    assert len(digests) == 1
    assert verify.checksum(df, ["id"], digits=4).first()["count"] == 1000


def test_digest_of_more_levels(spark, monkeypatch):
    import hashlib

    df = spark.range(3000).select(F.col("id"), (F.col("id") * 7 % 13).alias("v"))
    monkeypatch.setattr(verify, "CHUNK_ROWS", 8)  # 3000 rows then ask for 4 digits
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()

    def slow(prefix, rows):
        if len(prefix) == 4:
            return md5("".join(h for _, h in sorted(rows)))
        parts = {}
        for k, h in rows:
            parts.setdefault(md5(k)[: len(prefix) + 2], []).append((k, h))
        return md5("".join(slow(p, r) for p, r in sorted(parts.items())))

    assert tuple(verify.checksum(df, ["id"]).first()) == (3000, slow("", [(str(i), md5(f"{i}|{i * 7 % 13}")) for i in range(3000)]))


def test_compare_and_report(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], T)
    out = {r["table"]: r["match"] for r in verify.compare({"a": df, "b": df, "c": df}, {"a": df, "b": df.filter("id = 1")}, dict.fromkeys("abc", ["id"])).collect()}
    assert out == {"a": True, "b": False, "c": False}
    with pytest.raises(ValueError, match="no tables"):
        verify.compare({}, {}, {})


def test_converge_waits_and_gives_up(spark):
    df, tries = spark.createDataFrame([(1, "a", 1.0)], T), []

    def tables():
        tries.append(1)
        return {"a": df}, {"a": df if len(tries) > 2 else df.limit(0)}

    assert verify.converge(spark, tables, {"a": ["id"]}, timeout=60, pause=0.01).first()["match"]
    with pytest.raises(TimeoutError, match="MISMATCH"):
        verify.converge(spark, lambda: ({"a": df}, {}), {"a": ["id"]}, timeout=0, pause=0.01)


def test_row_diff(spark):
    a = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, None, 3.0)], T)
    b = spark.createDataFrame([(1, "a", 1.0), (2, "c", 2.0), (4, "d", 3.0)], T)
    assert {(r["id"], r["diff"]) for r in verify.row_diff(a, b, ["id"]).collect()} == {(2, "changed"), (3, "missing"), (4, "extra")}


def test_latency(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "2024-01-01 00:00:01"), ("2024-01-01 00:00:00", "2024-01-01 00:00:03"), ("2024-01-01 00:00:58", "2024-01-01 00:01:00.5"), (None, "2024-01-01 00:01:00")]
    df = spark.createDataFrame(rows, "c string, a string").select(F.col("c").cast("timestamp").alias("_cdc_commit_ts"), F.col("a").cast("timestamp").alias("_cdc_applied_at"))
    got = [(r["row_count"], r["avg_latency_s"], r["max_latency_s"]) for r in latency.by_minute(df).orderBy("minute").collect()]
    assert got == [(2, 2.0, 3.0), (1, 2.5, 2.5)]
    total = latency.overall(df).first()
    assert (total["row_count"], round(total["avg_latency_s"], 6), round(total["p95_max_bucket_s"], 6)) == (3, round(6.5 / 3, 6), 2.9)
    latency.write_csv(latency.by_minute(df), str(tmp_path / "out"))
    (file,) = (tmp_path / "out").glob("*.csv")
    assert file.read_text().splitlines()[:2] == ["minute,row_count,avg_latency_s,p95_latency_s,max_latency_s", "2024-01-01 00:00:00,2,2.000,2.900,3.000"]


def test_percentile_over_ranges(spark):
    """Exact over few and many rows, over one and several ranges of a second."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(i % 3, int(us)) for i, us in enumerate(rng.choice([10, 10**4, 10**6, 5 * 10**7], 700) * rng.random(700))] + [(7, 5), (8, 1), (8, 4 * 10**6)]
    df = spark.createDataFrame(rows, "k int, us long")
    counts = df.groupBy("k", "us").agg(F.count(F.lit(1)).alias("n"))
    for q in (0.0, 0.5, 0.95, 1.0):
        got = {r["k"]: r["p"] for r in latency._percentile(counts, "k", q, "p").collect()}
        for k in {k for k, _ in rows}:
            assert abs(got[k] - np.quantile([u for j, u in rows if j == k], q) / 1e6) < 1e-9


def test_latency_of_nothing(spark):
    df = spark.createDataFrame([], "_cdc_commit_ts timestamp, _cdc_applied_at timestamp")
    assert latency.by_minute(df).count() == 0 and latency.overall(df).first()["p95_true_s"] is None
