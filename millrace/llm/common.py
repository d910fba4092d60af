"""Small helpers that the operators share."""

from __future__ import annotations

import math
import tempfile
import uuid
from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words in every operator: U+0020 and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and driver and executors are one process (tests) a fresh temporary folder is made; elsewhere that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir is not set: it names a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="millrace-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of a narrow table through a reliable checkpoint in the shared folder. ``spark.cleaner.referenceTracking.cleanCheckpoints``
    lets Spark remove it when the frame is no longer in use."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same for wide tables: Parquet files in the shared folder, read again."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a ``written`` table that nothing will read again."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(table: DataFrame, name: str, limit: int = 8 << 20) -> DataFrame:
    """The table, broadcast if its rows, with the text of a column, are within the limit; else Spark joins it by a shuffle, splitting hot keys."""
    size = table.agg(F.sum(F.coalesce(F.octet_length(F.col(name).cast("string")), F.lit(0)) + 64)).first()[0] or 0
    return F.broadcast(table) if size <= limit else table


#: Bytes of text in the largest block. An executor's memory for a task is to be some twenty times as much.
LARGEST = 32 << 20


def layout(spark: SparkSession, n_bytes: int, block_bytes: int, largest: int = LARGEST) -> tuple[int, int]:
    """Numbers of hash blocks and of ranges for so many bytes of text, each at least that of shuffle partitions.

    A block holds ``block_bytes`` of text in small tables and then grows as the square root of the data, up to ``largest``; a range takes
    what four blocks send. So messages (blocks times ranges at most) grow no faster than the data until blocks are ``largest``.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = max(block_bytes, min(largest, math.isqrt(int(n_bytes) * block_bytes) >> 4))
    return max(tasks, -(-int(n_bytes) // size), 1), max(tasks, -(-int(n_bytes) // (4 * size)), 1)


# ---- vectorised hashing -------------------------------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


class Rolling:
    """Polynomial hashes modulo 2**64 of any ranges of a sequence of 64-bit values.

    The prefix sums hold ``sum(v[i] * base**-i)``; a range's hash is a difference of two of them, times ``base**start``. All
    arithmetic wraps, so a hash depends only on the range's content, not on where it stands.
    """

    def __init__(self, base: int, capacity: int = 0) -> None:
        self.base = base | 1
        self._up = self._down = np.ones(1, np.uint64)
        self._grow(capacity)

    def _grow(self, n: int) -> None:
        if len(self._up) <= n:
            n = max(n + 1, 2 * len(self._up))
            for name, b in (("_up", self.base), ("_down", pow(self.base, -1, 1 << 64))):
                x = np.full(n, b, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self._grow(len(values))
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self._down[: len(values)], out=out[1:])
        return out

    def windows(self, values: np.ndarray, size: int) -> np.ndarray:
        """Hash of every run of ``size`` values, mixed."""
        if len(values) < size:
            return np.zeros(0, np.uint64)
        s = self.prefix(values)
        return mix64((s[size:] - s[:-size]) * self._up[: len(values) - size + 1])

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each half-open range, mixed with its length."""
        return mix64((prefix[end] - prefix[start]) * self._up[start] + (end - start).astype(np.uint64))


def byte_table(seed: int) -> np.ndarray:
    """A random odd 64-bit value for each byte."""
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word of a UTF-8 text."""
    edge = np.empty(len(raw) + 2, np.int8)
    edge[0] = edge[-1] = 0
    edge[1:-1] = ~_IS_SPACE[raw]
    step = np.diff(edge)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def digests(raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of the BLAKE2b digest of each range of bytes."""
    found = b"".join([blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    both = np.frombuffer(found, np.uint64).reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])
