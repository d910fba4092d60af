"""Every registered query of the engine against its SQL, on the smallest tables."""

import hashlib
import os

import duckdb
import pytest

from millrace.plans import catalogue
from millrace.sources import changelog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def text(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(tuple(str(plain(r[i])) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query_equals_its_sql(spark, db, name):
    df = catalogue.queries()[name](spark, SF)
    ran = db.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in ran.description]
    assert sorted(names) == sorted(df.columns)
    assert text(df.collect(), df.columns) == text(ran.fetchall(), names)


def test_load_has_more_tasks_for_more_iterations(spark):
    for n in (0, 1, 100_000, 1_000_000):
        assert changelog.load_changelog(spark, n).rdd.getNumPartitions() >= n / 10_000


def test_load_folds_digests_and_not_notes(spark):
    """Nothing is digested above the grouping, so no notes are sorted or shuffled."""
    df = catalogue.load_changelog(spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    top = next(i for i, line in enumerate(plan) if "Aggregate" in line)
    assert not any("md5(" in line for line in plan[: top + 1]) and any("md5(" in line for line in plan[top + 1 :])


def test_load_over_many_tasks(spark, tmp_path, monkeypatch):
    """Cuts between tasks separate creation and deletion of a row."""
    monkeypatch.setattr(changelog, "ITERATIONS", 2)
    n = 25
    spark.range(n).withColumnRenamed("id", "c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    expected = set()
    for i in range(1, n + 1):
        if (i + 1) % 3 or i == n:
            notes = "".join(md5(f"{i}-{j}") for j in range(1, 301))
            expected |= {("animal", i, "adult", 0, md5("")), ("observation", i, "moved", 9600, md5(notes))}
    got = catalogue.load_changelog(spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)
    assert changelog.load_changelog(spark, n).rdd.getNumPartitions() == 13


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_a_library_of_the_training_data_operators():
    """What cannot be imported is left out; the engine's own queries stay."""
    import subprocess
    import sys

    code = "import sys, warnings; warnings.simplefilter('ignore'); sys.modules['pyarrow'] = None; import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(*q)"
    run = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    names = run.stdout.split()
    assert set(catalogue.queries()) <= set(names) and not any(n.startswith("op9") or n == "pipeline" for n in names)
