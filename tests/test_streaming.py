"""Keyed tables and streams, with crashes between their steps."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import verify
from millrace.operators.fold import cdc
from millrace.sources import changelog
from millrace.streaming.apply import TableSpec, backfill, start_apply, start_capture
from millrace.streaming import table as table_module
from millrace.streaming.table import KeyedTable


def changes(spark, rows):
    df = spark.createDataFrame(rows, "id int, name string, op string, seq long")
    return df.select("id", "name", cdc(F.col("op"), F.col("seq")))


def state(table):
    return {(r["id"], r["name"]) for r in table.read().collect()}


def test_redelivery_is_skipped_and_crashes_leave_the_old_version(spark, tmp_path, monkeypatch):
    t = KeyedTable(spark, str(tmp_path / "t"), ["id"])
    assert t.apply(changes(spark, [(1, "a", "c", 1), (2, "b", "c", 2)]), 0)
    assert not t.apply(changes(spark, [(9, "z", "c", 1)]), 0)
    with monkeypatch.context() as m:
        m.setattr(table_module, "write_text", lambda *_: (_ for _ in ()).throw(RuntimeError("crash")))
        with pytest.raises(RuntimeError, match="crash"):
            t.apply(changes(spark, [(1, None, "d", 3)]), 1)
        m.setattr(table_module, "write_text", lambda *_: False)
        with pytest.raises(RuntimeError, match="another writer"):
            t.apply(changes(spark, [(1, None, "d", 3)]), 1)
    assert state(t) == {(1, "a"), (2, "b")}
    assert t.apply(changes(spark, [(1, None, "d", 3)]), 1)
    assert state(t) == {(2, "b")} and t.versions() == [0, 1]
    t.vacuum(keep=1)
    assert t.versions() == [1] and state(t) == {(2, "b")}


def test_a_batch_writes_the_buckets_of_its_keys_only(spark, tmp_path):
    import os

    t = KeyedTable(spark, str(tmp_path / "t"), ["id"], buckets=16)
    t.commit(spark.range(400).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("v"), "id").alias("name")), -1)
    before = t.manifest()["where"]
    assert len(before) == 16
    t.apply(changes(spark, [(7, "seven", "u", 1), (1000, "new", "c", 2), (9, None, "d", 3)]), 0)
    hit = {r[0] for r in spark.createDataFrame([(7,), (1000,), (9,)], "id int").select(t.bucket([F.col("id")])).collect()}
    files = {name for name in os.listdir(tmp_path / "t/data/v=1") if name.startswith("_bucket")}
    assert 1 <= len(hit) <= 3 and files == {f"_bucket={b}" for b in hit}
    after = t.manifest()["where"]
    assert {b for b in after if after[b] != before.get(b)} == {str(b) for b in hit}
    want = {(i, f"v{i}") for i in range(400) if i not in (7, 9)} | {(7, "seven"), (1000, "new")}
    assert state(t) == want and {(r["id"], r["name"]) for r in t.read(0).collect()} == {(i, f"v{i}") for i in range(400)}
    t.apply(changes(spark, [(7, None, "d", 4)]), 1)
    t.vacuum(keep=1)
    assert state(t) == want - {(7, "seven")} and t.versions() == [2]


def test_emptied_table_is_empty(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["id"])
    t.apply(changes(spark, [(1, "a", "c", 1)]), 0)
    t.apply(changes(spark, [(1, None, "d", 2)]), 1)
    assert state(t) == set() and t.manifest()["where"] == {}
    t.apply(changes(spark, [(1, "b", "c", 3)]), 2)
    assert state(t) == {(1, "b")}


def test_key_moves_between_buckets(spark, tmp_path):
    """The row of a new key takes what it lacks from the bucket of the old one, over two changes of key."""
    t = KeyedTable(spark, str(tmp_path / "t"), ["id"], buckets=64)
    t.commit(spark.createDataFrame([(i, f"n{i}", f"big {i}") for i in range(20)], "id int, name string, notes string"), -1)
    rows = [(3, None, "d", 1, [], None), (103, "x", "c", 2, ["notes"], {"id": "3"}), (103, None, "d", 3, [], None), (203, "y", "c", 4, ["notes"], {"id": "103"})]
    df = spark.createDataFrame(rows, "id int, name string, op string, seq long, kept array<string>, old map<string,string>").withColumn("notes", F.lit(None).cast("string"))
    t.apply(df.select("id", "name", "notes", cdc(F.col("op"), F.col("seq"), None, None, F.col("kept"), None, F.col("old"))), 0)
    got = {r["id"]: (r["name"], r["notes"]) for r in t.read().collect()}
    assert got == {i: (f"n{i}", f"big {i}") for i in range(20) if i != 3} | {203: ("y", "big 3")}


def test_new_column_widens_the_table(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["id"])
    t.apply(changes(spark, [(1, "a", "c", 1)]), 0)
    more = spark.createDataFrame([(2, "b", "x")], "id int, name string, extra string").select("*", cdc(F.lit("c"), F.lit(2)))
    t.apply(more, 1)
    assert {(r["id"], r["extra"]) for r in t.read().collect()} == {(1, None), (2, "x")}


def test_backfill_is_marked(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["id"])
    src = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    assert backfill(t, src, "2024-01-01 00:00:00") and not backfill(t, src, "2024-01-01 00:00:00")
    t.apply(changes(spark, [(2, "live", "u", 1)]), 0)
    assert state(t) == {(1, "a"), (2, "live")}


def test_stream_of_files_equals_the_batch(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    wal = changelog.wal_msgs(spark, sf)
    cut = 10 * 100
    for i, part in enumerate((wal.filter(F.col("pos") < cut), wal.filter(F.col("pos") >= cut))):
        files = tmp_path / "wal"
        files.mkdir(exist_ok=True)
        rows = part.toJSON().collect()
        (files / f"{i}.json").write_text("\n".join(rows))
    from millrace.streaming.apply import capture

    none = wal.limit(0)
    first = wal.filter("kind = 'R'").limit(2)
    out, ck = str(tmp_path / "events"), str(tmp_path / "ck1")
    start_capture(capture(spark, str(tmp_path / "wal")), first.unionByName(none), out, ck).awaitTermination()
    stream = spark.readStream.schema("key string, value string, seq long").option("recursiveFileLookup", "true").json(out)
    specs = {"public.events": TableSpec(["event_id"])}
    start_apply(stream, specs, str(tmp_path / "tables"), str(tmp_path / "ck2")).awaitTermination()
    got = KeyedTable(spark, str(tmp_path / "tables/public.events"), ["event_id"]).read()
    e = changelog.table(spark, sf, "events").filter("event_id div 5 % 13 <> 0").select("event_id", "event_type", "user_id", "value")
    assert verify.row_diff(e, got.select(*e.columns), ["event_id"]).count() == 0
    # a restart finds nothing new
    start_apply(stream, specs, str(tmp_path / "tables"), str(tmp_path / "ck2")).awaitTermination()
    assert json.loads(json.dumps(KeyedTable(spark, str(tmp_path / "tables/public.events"), ["event_id"]).versions())) == [0]


def test_transactions_and_relations_cross_files(spark, tmp_path):
    from millrace.operators import wal as log
    from millrace.streaming.apply import capture

    wal = changelog.wal_msgs(spark, "/root/testdata/sf0.001").filter("pos < 3000").persist()
    begin = wal.filter("kind = 'B' AND pos > 900").agg(F.min("pos")).first()[0]
    end = wal.filter(f"kind = 'C' AND pos > {begin}").agg(F.min("pos")).first()[0]
    rows = sorted(r[0] for r in wal.filter(f"kind IN ('I', 'U', 'D') AND pos BETWEEN {begin} AND {end}").select("pos").collect())
    assert len(rows) > 2
    cuts = [-(10**9), rows[0], rows[1], end, 10**9]  # the first file ends after a row, the second holds one row, the third has the commit
    (tmp_path / "wal").mkdir()
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        (tmp_path / f"wal/{i}.json").write_text("\n".join(wal.filter((F.col("pos") > a) & (F.col("pos") <= b)).toJSON().collect()))
    for _ in range(2):  # the second start finds nothing new
        start_capture(capture(spark, str(tmp_path / "wal")), wal.filter("kind = 'R'").limit(0), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.schema("key string, value string, seq long").option("recursiveFileLookup", "true").json(str(tmp_path / "out"))
    want = [r[0] for r in log.events(wal).select("seq").collect()]
    assert sorted(r[0] for r in got.select("seq").collect()) == sorted(want) and {2 * p for p in rows} & {s - s % 2 for s in want}


def split_log(spark):
    """A small log: open, empty and broken-off transactions, and two versions of a relation."""
    cols = lambda *names: [(n, 20 if n == "id" else 25, n == "id") for n in names]
    kinds = ["R1", "B", "I", "I", "C", "B", "C", "B", "I", "R2", "I", "C", "B", "I", "B", "I", "C", "B", "I"]
    rows = []
    for i, k in enumerate(kinds):
        wide = "R2" in kinds[:i]
        new = [("t", str(i)), ("t", f"a{i}")] + ([("t", f"b{i}")] if wide else []) if k == "I" else None
        rows.append((i, k[0], 1, "public.t" if k[0] == "R" else None, cols("id", "a") if k == "R1" else cols("id", "a", "b") if k == "R2" else None, i if k == "C" else None, new))
    df = spark.createDataFrame(rows, "pos long, kind string, rel_id int, `table` string, columns array<struct<name: string, oid: int, is_key: boolean>>, n int, new array<struct<kind: string, data: string>>")
    return df.select("pos", "kind", "rel_id", "table", "columns", F.col("n").cast("decimal(20,0)").alias("lsn"), F.lit("2024-01-01").cast("timestamp").alias("commit_ts"), "new", F.lit(None).cast("array<struct<kind: string, data: string>>").alias("old")).repartition(1).persist()


def test_log_cut_at_every_message(spark):
    from millrace.operators import wal as log
    from millrace.streaming.apply import step

    m = split_log(spark)
    key = lambda df: sorted((r["seq"], r["op"], int(r["lsn"]), sorted(r["after"].items())) for r in df.collect())
    want = key(log.events(m))
    assert [s // 2 for s, *_ in want] == [2, 3, 8, 10, 15] and [len(a) for *_, a in want] == [2, 2, 2, 3, 3]
    got, waiting = [], None
    for i in range(m.count()):
        events, left = step(m.filter(F.col("pos") == i), waiting)
        got += key(events)
        rows, schema = left.collect(), left.schema
        waiting = spark.createDataFrame(rows, schema)
        assert len(rows) <= 6  # only what is open, and relations
    assert sorted(got) == want
    assert key(step(m, None, after=4)[0]) == [r for r in want if r[2] > 4]


def test_pin_is_made_once(spark, tmp_path):
    from millrace.streaming.apply import pin

    assert pin(spark, str(tmp_path / "slot.json"), 7, "v1") == ({"position": 7, "version": "v1"}, True)
    assert pin(spark, str(tmp_path / "slot.json"), 9, "v2") == ({"position": 7, "version": "v1"}, False)


def test_reader_and_writer_commands(spark, tmp_path, monkeypatch):
    """A snapshot at a position, the log before and behind it, and a second start after more log."""
    from millrace import cli

    m, src = split_log(spark), tmp_path / "src"
    (src / "log").mkdir(parents=True)
    (src / "publication.json").write_text(json.dumps({"publication": "all_tables", "schema": "public", "table": "t", "pk": ["id"]}))
    spark.createDataFrame([(2, "a2"), (3, "a3 in the snapshot")], "id long, a string").write.parquet(str(src / "snapshot/public.t"))
    for k, v in {"SOURCE": src, "DESTINATION": tmp_path / "dst", "TOPIC": tmp_path / "topic", "CHECKPOINT": tmp_path / "ck", "SNAPSHOT_POSITION": 6, "BUCKETS": 4}.items():
        monkeypatch.setenv(f"MILLRACE_{k}", str(v))
    (tmp_path / "ck").mkdir()
    t = KeyedTable(spark, str(tmp_path / "dst/public.t"), ["id"])
    for i, (a, b) in enumerate(((-1, 9), (9, 18))):
        (src / f"log/{i}.json").write_text("\n".join(m.filter((F.col("pos") > a) & (F.col("pos") <= b)).toJSON().collect()))
        assert cli.main(["reader", "--once"]) == 0 and cli.main(["writer", "--once"]) == 0
        got = {r["id"]: r["a"] for r in t.read().collect()}
        assert got == {2: "a2", 3: "a3 in the snapshot"} | ({8: "a8", 10: "a10", 15: "a15"} if i else {})
    assert {r["id"]: r["b"] for r in t.read().collect()} == {2: None, 3: None, 8: None, 10: "b10", 15: "b15"}


def test_poison_stops_or_is_dropped(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    good = {"op": "c", "table": "t", "lsn": 1, "pk": {"id": "1"}, "after": {"id": "1", "x": "a"}, "types": {"id": "bigint", "x": "text"}}
    (d / "a.json").write_text("\n".join(json.dumps({"value": v, "seq": i}) for i, v in enumerate((json.dumps(good), "not json"))))
    stream = spark.readStream.schema("value string, seq long").json(str(d))
    with pytest.raises(Exception, match="bad event"):
        start_apply(stream, {"t": TableSpec(["id"])}, str(tmp_path / "a"), str(tmp_path / "c1")).awaitTermination()
    start_apply(stream, {"t": TableSpec(["id"])}, str(tmp_path / "a"), str(tmp_path / "c2"), on_error="drop").awaitTermination()
    assert KeyedTable(spark, str(tmp_path / "a/t"), ["id"]).read().count() == 1
