"""A keyed table of Parquet files in hash buckets, with atomic commits.

Rows stand in buckets by a hash of the key. A commit writes only the buckets that it touches, as ``data/v=N/_bucket=B``, and then
``manifest/N.json``: key, batch, schema, and for each bucket the commit that has its rows. A manifest is created, never replaced, through the
file system that Spark itself uses, so readers see a commit whole or not at all. A batch that was applied before is skipped, which makes
redelivery harmless.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.functions.names import col
from millrace.operators.fold import CDC, carry, fold
from millrace.operators.merge import is_small, merge, widen

BUCKET = "_bucket"


def file_system(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The file system of a path, and the path for it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    fs, folder = file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as a whole, read by the driver."""
    fs, p = file_system(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file in one step; False, and nothing done, if there is one."""
    fs, p = file_system(spark, path)
    tmp = file_system(spark, f"{path}.{uuid.uuid4().hex}.tmp")[1]
    out = fs.create(tmp, False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(p) or not fs.rename(tmp, p):
        fs.delete(tmp, False)
        return False
    return True


class KeyedTable:
    """``buckets`` is that of a new table; choose it so that a bucket is about a file (128 MB), and well above the keys of a batch."""

    def __init__(self, spark: SparkSession, path: str, pk: list[str], buckets: int = 32) -> None:
        if not pk:
            raise ValueError("a keyed table needs a key")
        self.spark, self.path, self.pk, self.buckets = spark, path.rstrip("/"), pk, buckets

    # ---- files ----------------------------------------------------------------------------------

    def _fs(self, path: str) -> tuple[Any, Any]:
        return file_system(self.spark, path)

    def _names(self, path: str) -> list[str]:
        return names(self.spark, path)

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names(f"{self.path}/manifest") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict | None:
        known = self.versions()
        if not known:
            return None
        n = known[-1] if version is None else version
        return json.loads(read_text(self.spark, f"{self.path}/manifest/{n}.json"))

    def read(self, version: int | None = None, only: set[int] | None = None) -> DataFrame | None:
        """The newest version or the one asked for, or some buckets of it; None before the first."""
        m = self.manifest(version)
        if m is None:
            return None
        schema = StructType.fromJson(m["schema"])
        folders = [f"{self.path}/data/v={v}/{BUCKET}={b}" for b, v in m["where"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def bucket(self, values: list[Column]) -> Column:
        """The bucket of a key, by the text of its values."""
        last = self.manifest()
        return F.pmod(F.xxhash64(*(v.cast("string") for v in values)), F.lit(last["buckets"] if last else self.buckets)).cast("int")

    def commit(self, df: DataFrame, batch_id: int | None = None, touched: set[int] | None = None, **more: Any) -> int:
        """Write the rows of the ``touched`` buckets (of all, if None) and make them visible. Files of a commit that didn't get as far are
        overwritten."""
        known, last = self.versions(), self.manifest() or {}
        n = known[-1] + 1 if known else 0
        rows = df.withColumn(BUCKET, self.bucket([col(k) for k in self.pk]))
        rows.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/data/v={n}")
        made = {name.split("=")[1]: n for name in self._names(f"{self.path}/data/v={n}") if name.startswith(f"{BUCKET}=")}
        kept = {} if touched is None else {b: v for b, v in last.get("where", {}).items() if int(b) not in touched}
        body = {"version": n, "pk": self.pk, "buckets": last.get("buckets", self.buckets), "where": kept | made, "schema": df.schema.jsonValue(), "last_batch_id": last.get("last_batch_id", -1) if batch_id is None else batch_id, "backfill_done": last.get("backfill_done", False)} | more
        if not write_text(self.spark, f"{self.path}/manifest/{n}.json", json.dumps(body)):
            raise RuntimeError(f"version {n} of {self.path} was committed by another writer")
        return n

    def vacuum(self, keep: int = 2) -> None:
        """Drop all but the newest versions: manifests first, then buckets that no other one names."""
        known = self.versions()
        needed = {(v, int(b)) for n in known[-keep:] for b, v in self.manifest(n)["where"].items()}
        for n in known[:-keep]:
            fs, p = self._fs(f"{self.path}/manifest/{n}.json")
            fs.delete(p, True)
        for n in known:
            for name in self._names(f"{self.path}/data/v={n}"):
                if name.startswith(f"{BUCKET}=") and (n, int(name.split("=")[1])) not in needed:
                    fs, p = self._fs(f"{self.path}/data/v={n}/{name}")
                    fs.delete(p, True)

    # ---- changes --------------------------------------------------------------------------------

    def apply(self, changes: DataFrame, batch_id: int, applied_at: Column | None = None) -> bool:
        """Fold a batch of typed changes and merge it; False if the batch was applied before. New columns widen the table. Only buckets that
        hold a key of the batch, or the former key of a row, are read, and only the former are written."""
        m = self.manifest()
        if m is not None and m["last_batch_id"] >= batch_id:
            return False
        changes = changes.persist()
        try:
            kinds, moved = dict(changes.dtypes), F.col(f"{CDC}.moved_from")
            old = [F.try_element_at(moved, F.lit(k)).cast(kinds[k]) for k in self.pk]
            # sets of buckets, at most all of them
            found = changes.agg(F.collect_set(self.bucket([col(k) for k in self.pk])), F.collect_set(F.when(moved.isNotNull(), self.bucket(old)))).first()
            keys, former = set(found[0]), set(found[1])
            carried = carry(changes, self.read(only=keys | former), self.pk) if former else changes
            folded = fold(carried, self.pk).persist()
            now = self.read(only=keys)
            if now is None:
                now = folded.drop(CDC).limit(0)
            when = F.current_timestamp() if applied_at is None else applied_at
            self.commit(merge(widen(now, folded), folded, self.pk, when, small_batch=is_small(folded)), batch_id, keys)
            folded.unpersist()
        finally:
            changes.unpersist()
        return True
