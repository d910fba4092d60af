"""The fold against the sequential rule, and the merge's promises."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators.fold import as_snapshot, carry, cdc, fold, materialize
from millrace.operators.merge import classify, merge, widen

COLS = ("name", "notes")


def frame(spark, rows):
    """rows: (batch, id, op, seq, {column: value}, [unchanged])"""
    data = [(b, i, v.get("name"), v.get("notes"), op, seq, keep, None if op == "d" else [c for c in COLS if c in v]) for b, i, op, seq, v, keep in rows]
    df = spark.createDataFrame(data, "batch int, id int, name string, notes string, op string, seq long, kept array<string>, present array<string>")
    return df.select("batch", "id", "name", "notes", cdc(F.col("op"), F.col("seq"), None, None, F.col("kept"), F.col("present")))


def sequential(events):
    """The rule, one event after the other."""
    state = {}
    for key, op, values, keep in events:
        prev = state.get(key)
        values, keep = dict(values), list(keep)
        if prev is not None and op != "d" and prev[0] != "d":
            for c in list(keep):
                if c in prev[1]:
                    values[c] = prev[1][c]
                    keep.remove(c)
        state[key] = (op, values, keep)
    return state


def random_batches(n, seed, legal=False):
    rng, rows = random.Random(seed), []
    for b in range(n):
        alive = set()
        for seq in range(rng.randint(1, 7)):
            i = rng.randint(1, 2)
            if legal:
                op = rng.choice("ud") if i in alive else "c"
            else:
                op = rng.choice("cudr")
            (alive.discard if op == "d" else alive.add)(i)
            keep = [c for c in COLS if op == "u" and rng.random() < 0.5]
            values = {} if op == "d" else {c: rng.choice(["x", "y", None]) for c in COLS if c not in keep and (legal or rng.random() < 0.9)}
            rows.append((b, i, op, seq, values, keep))
    return rows


def test_fold_equals_the_sequential_rule(spark):
    rows = random_batches(400, 1)
    got = {(r["batch"], r["id"]): r for r in fold(frame(spark, rows), ["batch", "id"]).collect()}
    want = sequential([((b, i), op, v, k) for b, i, op, _, v, k in rows])
    assert got.keys() == want.keys()
    for key, (op, values, keep) in want.items():
        r = got[key]
        if op == "d":
            assert r["_cdc"]["op"] == "d"
            continue
        assert (r["_cdc"]["op"], sorted(r["_cdc"]["unchanged"])) == (op, sorted(keep))
        for c in COLS:
            assert c in keep or r[c] == values.get(c)


def test_splits_and_replays_of_legal_streams_agree(spark):
    rows = random_batches(200, 2, legal=True)
    pk = ["batch", "id"]
    df = frame(spark, rows)
    key = lambda d: sorted((r["batch"], r["id"], r["name"], r["notes"]) for r in d.select("batch", "id", *COLS).collect())
    whole = key(materialize(fold(df, pk)))
    first, second = (fold(df.filter(x), pk) for x in ("_cdc.seq < 3", "_cdc.seq >= 3"))
    target = materialize(first)
    assert key(merge(target, second, pk)) == whole
    assert key(merge(merge(target, second, pk), second, pk)) == whole
    assert key(merge(target, second, pk, small_batch=True)) == whole
    assert key(materialize(fold(as_snapshot(target).unionByName(df.filter("_cdc.seq >= 3")), pk))) == whole


@pytest.mark.parametrize("small", [False, True])
def test_merge_worked_example(spark, small):
    target = spark.createDataFrame([(77, "a", "big"), (55, "b", "n"), (None, "no key", "n")], "id int, name string, notes string")
    batch = fold(frame(spark, [(0, 101, "c", 1, {"name": "new", "notes": None}, []), (0, 77, "u", 2, {"name": "renamed"}, ["notes"]), (0, 55, "d", 3, {}, []), (0, 9, "d", 4, {}, [])]).drop("batch"), ["id"])
    got = {(r["id"], r["name"], r["notes"]) for r in merge(target, batch, ["id"], small_batch=small).collect()}
    assert got == {(77, "renamed", "big"), (101, "new", None), (None, "no key", "n")}
    assert {(r["id"], r["action"]) for r in classify(target, batch, ["id"]).collect()} == {(101, "insert"), (77, "update"), (55, "delete"), (9, "nothing")}


def test_merge_metadata_and_new_columns(spark):
    target = spark.createDataFrame([(1, "a")], "id int, name string")
    batch = fold(frame(spark, [(0, 1, "u", 1, {"notes": "n"}, ["name"]), (0, 2, "c", 2, {"name": "b", "notes": "m"}, [])]).drop("batch"), ["id"])
    assert widen(target, batch).columns == ["id", "name", "notes"]
    rows = merge(target, batch, ["id"], F.lit("2030-01-01").cast("timestamp")).collect()
    assert {(r["id"], r["name"], r["notes"], str(r["_cdc_applied_at"])[:10]) for r in rows} == {(1, "a", "n", "2030-01-01"), (2, "b", "m", "2030-01-01")}


def test_user_columns_may_have_any_name(spark):
    df = spark.createDataFrame([(1, "x", "y")], "id int, op string, seq string").select("*", cdc(F.lit("c"), F.lit(1)))
    assert materialize(fold(df, ["id"])).first().asDict() == {"id": 1, "op": "x", "seq": "y"}


def test_fold_plans_one_shuffle(spark):
    df = frame(spark, [(0, 1, "c", 1, {"name": "a", "notes": "b"}, [])])
    plan = fold(df, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_change_of_key_carries_what_was_not_sent(spark):
    """From the table's row (1 to 11), from a change in the same batch (2 to 12), and nothing for a key nobody has seen (3 to 13)."""
    target = spark.createDataFrame([(1, "a", "big one"), (2, "b", "old two")], "id int, name string, notes string")
    rows = [(1, None, "d", 10, [], None), (11, "a", "c", 11, ["notes"], {"id": "1"}), (2, "b", "u", 12, [], None), (2, None, "d", 14, [], None), (12, "b", "c", 15, ["notes"], {"id": "2"}), (3, None, "d", 16, [], None), (13, "c", "c", 17, ["notes"], {"id": "3"})]
    df = spark.createDataFrame(rows, "id int, name string, op string, seq long, kept array<string>, old map<string,string>")
    df = df.select("id", "name", F.when(F.col("seq") == 12, "new two").alias("notes"), cdc(F.col("op"), F.col("seq"), None, None, F.col("kept"), None, F.col("old")))
    after = merge(target, fold(carry(df, target, ["id"]), ["id"]), ["id"])
    assert {tuple(r) for r in after.collect()} == {(11, "a", "big one"), (12, "b", "new two"), (13, "c", None)}


def test_keys_that_change_again_and_again(spark):
    """Four changes of key in a batch: each column comes from the last row of the chain that had it."""
    target = spark.createDataFrame([(1, "a", "big one")], "id int, name string, notes string")
    rows, key = [], 1
    for n, new in enumerate((11, 21, 31, 41)):
        rows += [(key, None, "d", 10 * n, [], None), (new, None, "c", 10 * n + 1, ["name", "notes"], {"id": str(key)})]
        if new == 21:
            rows.append((new, "renamed", "u", 10 * n + 2, ["notes"], None))
        key = new
    df = spark.createDataFrame(rows, "id int, name string, op string, seq long, kept array<string>, old map<string,string>").withColumn("notes", F.lit(None).cast("string"))
    df = df.select("id", "name", "notes", cdc(F.col("op"), F.col("seq"), None, None, F.col("kept"), None, F.col("old")))
    after = merge(target, fold(carry(df, target, ["id"]), ["id"]), ["id"])
    assert {tuple(r) for r in after.collect()} == {(41, "renamed", "big one")}


def test_names_with_backticks_and_dots(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "`a``b` int, `c.d ``` string").select("*", cdc(F.lit("c"), F.lit(1)))
    folded = fold(df, ["a`b"])
    got = merge(materialize(folded), folded, ["a`b"])
    assert {tuple(r) for r in got.collect()} == {(1, "x"), (2, "y")} and got.columns == ["a`b", "c.d `"]
    assert {r["action"] for r in classify(materialize(folded), folded, ["a`b"]).collect()} == {"update"}
