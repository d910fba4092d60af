"""Envelope, types, log decoder."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import types
from millrace.operators import envelope, wal
from millrace.sources import snapshot

COLS = [("id", 20, True), ("name", 25, False), ("alive", 16, False), ("notes", 25, False)]


def rows(spark, kind, new, old=None, cols=COLS):
    data = [(1, kind, 7, [tuple(c) for c in cols], new, old)]
    df = spark.createDataFrame(data, "pos long, kind string, rel_id int, cols array<struct<name: string, oid: int, is_key: boolean>>, new " + wal.TUPLE + ", old " + wal.TUPLE)
    return df.select("*", F.struct(F.lit("public.animals").alias("table"), F.col("cols").alias("columns")).alias("rel"), F.lit(5).cast("decimal(20,0)").alias("lsn"), F.lit("2026-09-08T18:04:11Z").cast("timestamp").alias("commit_ts"), F.lit(0).cast("long").alias("txn"))


T = lambda *v: [("u", None) if x is Ellipsis else ("n", None) if x is None else ("t", x) for x in v]


def test_create(spark):
    r = wal.decode(rows(spark, "I", T("42", "Testo", "t", None))).first()
    assert (r["op"], r["pk"], r["after"]["alive"], r["after"]["notes"], r["types"]["id"]) == ("c", {"id": "42"}, "t", None, "bigint")
    assert "notes" in r["after"]


def test_unchanged_update(spark):
    r = wal.decode(rows(spark, "U", T("42", "Renamed", "t", ...))).first()
    assert r["unchanged"] == ["notes"] and "notes" not in r["after"]


def test_delete(spark):
    r = wal.decode(rows(spark, "D", None, T("42", None, None, None))).first()
    assert (r["op"], r["pk"], r["after"]) == ("d", {"id": "42"}, None)


@pytest.mark.parametrize(
    "kind,new,old,cols,text",
    [
        ("I", T("1"), None, COLS, "length"),
        ("I", T("1", "a", "t", ...), None, COLS, "unchanged value"),
        ("I", T("x"), None, [("x", 25, False)], "no key"),
        ("D", None, None, COLS, "old tuple"),
        ("I", [("t", "1"), ("z", "a"), ("n", None), ("n", None)], None, COLS, "unknown kind"),
        ("U", T("1", "a", "t", "n"), T("1"), COLS, "length"),
    ],
)
def test_bad_messages_raise(spark, kind, new, old, cols, text):
    with pytest.raises(Exception, match=text):
        wal.decode(rows(spark, kind, new, old, cols)).collect()


def test_key_change_is_delete_and_insert(spark):
    got = wal.decode(rows(spark, "U", T("43", "a", "t", "n"), T("42", None, None, None))).orderBy("seq").collect()
    assert [(r["op"], r["pk"]["id"]) for r in got] == [("d", "42"), ("c", "43")]
    same = wal.decode(rows(spark, "U", T("42", "a", "t", "n"), T("42", None, None, None))).collect()
    assert [r["op"] for r in same] == ["u"]


def test_unknown_relation_raises(spark):
    m = spark.createDataFrame([(1, "I", 999)], "pos long, kind string, rel_id int").select("*", F.lit(None).cast("string").alias("table"), F.lit(None).cast("array<struct<name: string, oid: int, is_key: boolean>>").alias("columns"))
    with pytest.raises(Exception, match="unknown relation id 999"):
        wal.with_relation(m, m).collect()


def test_transactions_over_segment_borders(spark):
    kinds = "BII" + "BIC" + "IB" + "BIIIIIC" + "BI"
    m = spark.createDataFrame([(i, k, i, "2024-01-01") for i, k in enumerate(kinds)], "pos long, kind string, lsn int, ts string").select("pos", "kind", F.col("lsn").cast("decimal(20,0)").alias("lsn"), F.col("ts").cast("timestamp").alias("commit_ts"))
    want = [(4, 3, 5)] + [(i, 8, 14) for i in range(9, 14)]
    for segment, fan in ((1, 2), (2, 3), (3, 1), (100, 8), (wal.SEGMENT, wal.FAN)):
        got = sorted((r["pos"], r["txn"], int(r["lsn"])) for r in wal.assemble(m, segment, fan).collect())
        assert got == want, segment


def test_relations_over_segment_borders(spark):
    rng = random.Random(4)
    rows, want, now = [], {}, {}
    for pos in range(300):
        rel = rng.randint(1, 3)
        if rel not in now or rng.random() < 0.1:
            now[rel] = now.get(rel, 0) + 1
            rows.append((pos, "R", rel, f"t{rel}.{now[rel]}"))
        else:
            rows.append((pos, "I", rel, None))
            want[pos] = (now[rel], f"t{rel}.{now[rel]}")
    m = spark.createDataFrame(rows, "pos long, kind string, rel_id int, `table` string").withColumn("columns", F.lit(None).cast("array<struct<name: string, oid: int, is_key: boolean>>"))
    for segment in (1, 7, 64, wal.SEGMENT):
        got = {r["pos"]: (r["version"], r["rel"]["table"]) for r in wal.with_relation(m.filter("kind = 'I'"), m, segment).collect()}
        assert got == want, segment


def test_decoder_scans_a_segment_once(spark):
    """Both look-back and look-ahead are running frames: none reaches to the end of its partition."""
    plan = wal.assemble(spark.createDataFrame([], wal.MESSAGE))._jdf.queryExecution().analyzed().toString()
    assert "unboundedfollowing" not in plan and "currentrow" in plan


def test_envelope_round_trip_and_rejection(spark):
    e = spark.createDataFrame([("u", "public.t", {"id": "9007199254740993"}, {"id": "9007199254740993", "x": None}, ["big"], {"id": "bigint"})], "op string, `table` string, pk map<string,string>, after map<string,string>, unchanged array<string>, types map<string,string>")
    e = e.withColumn("lsn", F.lit("18446744073709551615").cast("decimal(20,0)")).withColumn("commit_ts", F.lit("2026-09-08T18:04:11Z").cast("timestamp"))
    coded = envelope.encode(e)
    back = envelope.decode(coded).first()
    assert back["pk"] == {"id": "9007199254740993"} and back["after"] == {"id": "9007199254740993", "x": None} and str(back["lsn"]) == "18446744073709551615"
    assert coded.first()["key"] == 'public.t:{"id":"9007199254740993"}'
    bad = spark.createDataFrame([('{"table":""}',), ("not json",), ('{"op":"z","table":"t"}',), (None,)], "value string")
    with pytest.raises(Exception, match="bad event"):
        envelope.decode(bad).collect()
    assert envelope.decode(bad, on_error="drop").count() == 0
    assert [r["error"] for r in envelope.decode(bad, on_error="keep").collect()] == ["no op", "no op", "unknown op", "no op"]


def test_key_is_stable_and_sorted(spark):
    d = spark.createDataFrame([({"b": "2", "a": "1"},), ({"a": "1", "b": "2"},)], "pk map<string,string>")
    assert {r[0] for r in d.select(envelope.message_key(F.lit("t"), F.col("pk"))).collect()} == {'t:{"a":"1","b":"2"}'}


def test_column_order():
    assert envelope.canonical_columns(["id"], {"zeta": "text", "id": "bigint", "alpha": "text", "mid": "text"}) == ["id", "alpha", "mid", "zeta"]


def test_casts(spark):
    d = spark.createDataFrame([("t", "+02")], "b string, z string")
    assert d.select(types.from_text(F.col("b"), "boolean")).first()[0] is True
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        spark.createDataFrame([("1x",)], "v string").select(types.from_text(F.col("v"), "integer")).collect()
    assert types.spark_type("numeric") == "string" and types.spark_type("numeric", (10, 2)) == "decimal(10,2)"


def test_snapshot_needs_schema_and_key(spark):
    df = spark.range(1)
    with pytest.raises(ValueError, match="no schema"):
        snapshot.events(df, "t", ["id"], F.lit("2024-01-01"))
    with pytest.raises(ValueError, match="no key"):
        snapshot.events(df, "public.t", [], F.lit("2024-01-01"))


def test_records_of_a_topic_and_back(spark):
    from millrace.sources import topic

    e = spark.createDataFrame([("t:1", '{"op":"c"}'), ("t:2", "é")], "key string, value string")
    sent = topic.records(e)
    assert dict(sent.dtypes) == {"key": "binary", "value": "binary"}
    got = topic.messages(sent.withColumn("partition", F.lit(0)).withColumn("offset", F.monotonically_increasing_id()))
    assert {(r["key"], r["value"]) for r in got.collect()} == {("t:1", '{"op":"c"}'), ("t:2", "é")} and dict(got.dtypes)["seq"] == "bigint"
