"""Helpers shared by the operators: shared folder, packed arrays, tables."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.session import ship

#: Words of every operator that counts words: runs without ASCII white space.
#: ``bytes.split()`` cuts at exactly these characters.
WORD_REGEX = r"[^\x20\x09-\x0D]+"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is read from ``spark.checkpoint.dir``.  Where nobody set one, a session
    on a single machine (as in tests) gets a temporary folder; on a cluster that
    is an error, as no other machine would see that folder.
    """
    root = spark.sparkContext.getConf().get(_CHECKPOINT_DIR) or spark.conf.get(_CHECKPOINT_DIR, None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="quarryline-")
        spark.conf.set(_CHECKPOINT_DIR, root)
    return root.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and reread it.

    The table cuts lineage without local state: a lost executor costs only
    the tasks that were running.  Shuffle files of the write are removed once
    the table stands, so disk holds the table and not its making.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/quarryline/{name}-{uuid.uuid4().hex}"
    with _cleaned(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_LOCK = threading.Lock()
_WRITERS = {"n": 0, "before": "false"}


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go with their query while any thread writes a table; the
    setting is put back when the last one is done."""
    with _LOCK:
        if _WRITERS["n"] == 0:
            _WRITERS["before"] = spark.conf.get(_CLEANUP, "false")
            spark.conf.set(_CLEANUP, "true")
        _WRITERS["n"] += 1
    try:
        yield
    finally:
        with _LOCK:
            _WRITERS["n"] -= 1
            if _WRITERS["n"] == 0:
                spark.conf.set(_CLEANUP, _WRITERS["before"])


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partition_keys(n: int, each: int = 1) -> np.ndarray:
    """Integers that ``repartition(n, key)`` deals evenly, ``each`` to every
    partition: Spark places an int by its Murmur3 hash (seed 42) modulo n.
    Key i and key i + n go to the same partition."""

    def rotated(x, r):
        return x << np.uint32(r) | x >> np.uint32(32 - r)

    found: list[list[int]] = [[] for _ in range(n)]
    missing, start = n * each, 0
    while missing:
        k = np.arange(start, start + 4 * n + 1024, dtype=np.uint32)
        start += len(k)
        h = rotated(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593) ^ np.uint32(42)
        h = rotated(h, 13) * np.uint32(5) + np.uint32(0xE6546B64) ^ np.uint32(4)
        h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
        h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
        at = (h ^ h >> np.uint32(16)).astype(np.int32).astype(np.int64) % n
        for key, p in zip(k.tolist(), at.tolist(), strict=True):
            if len(found[p]) < each:
                found[p].append(key)
                missing -= 1
    return np.array(found, dtype=np.int64).T.reshape(-1)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def text_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes; null counts as empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator, rows: int = 256) -> Iterator:
    """Arrow batches in parts small enough to become Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Exclusive prefix sums, one longer than ``lengths``."""
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every bit of 64-bit hashes."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
