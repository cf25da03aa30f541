"""Operator 2: exact deduplication over an extendible-hash index.

The index lives in tables of the shared folder.  Keys are 64-bit hashes of
whole texts.  A directory maps a prefix of the key to a bucket; a bucket that
holds more keys than its capacity splits, and the directory doubles whenever
the split needs one more bit than it has.  The directory is built from a
histogram of at most ``2**MAX_DEPTH`` prefix counts, so what reaches the driver
is bounded whatever the corpus; the capacity follows the number of keys, so
that even keys never need more depth than that.  Buckets of uneven keys that
are still overfull there grow longer chains: owners stream them in key order,
so nothing is dropped.

Page builders combine equal texts of their part of the input (a bounded
number of bytes at a time) before anything moves; a text that makes up a third
of all rows therefore travels once per builder.  Owner tasks take key ranges
in key order, chain the entries that share a key and compare their bytes.
Rows then find their class through a join that carries digests, not texts.

Defined results: a null text counts as empty and so equals every other empty
text.  Of equal texts the largest doc_id stays; rows that repeat a doc_id with
the same text each count in ``group_size``, and of those that carry the kept
doc_id all are marked kept (they are the same row).  A null doc_id is smaller
than any other.  Extra columns are left out of the result; an empty table
gives an empty result.  Very long texts are hashed and compared whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import materialise, partitions, slices, starts_of

#: Most bits of a key that the directory looks at.
MAX_DEPTH = 18
#: Keys that a bucket holds at least before it splits.
CAPACITY = 1024
#: Bytes of text that a page builder combines before it passes them on.
PAGE_BYTES = 16 << 20


class Directory:
    """The directory of an extendible hash: prefix of the key to bucket."""

    def __init__(self, counts: dict[int, int], capacity: int, max_depth: int = MAX_DEPTH):
        """``counts``: keys by their first ``max_depth`` bits."""
        prefixes = np.array(sorted(counts), dtype=np.int64)
        sums = starts_of(np.array([counts[p] for p in prefixes.tolist()], dtype=np.int64))

        def held(prefix: int, local: int) -> int:
            a, b = np.searchsorted(prefixes, [prefix << max_depth - local, prefix + 1 << max_depth - local])
            return int(sums[b] - sums[a])

        self.local: list[int] = []  # depth of each bucket, in key order
        todo = [(0, 0)]
        while todo:
            prefix, local = todo.pop()
            if local < max_depth and held(prefix, local) > capacity:
                todo += [(2 * prefix + 1, local + 1), (2 * prefix, local + 1)]
            else:
                self.local.append(local)
        self.depth = max(self.local)
        #: Bucket of each slot; a bucket of lesser depth fills several slots.
        self.slots = np.repeat(np.arange(len(self.local)), 1 << self.depth - np.array(self.local)).tolist()

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        """Buckets of 64-bit keys."""
        if not self.depth:
            return np.zeros(len(keys), dtype=np.int64)
        return np.array(self.slots)[(keys.view(np.uint64) >> np.uint64(64 - self.depth)).astype(np.int64)]


def _pages(shared):
    """Combine equal texts of a bounded stretch of the input, by bucket."""
    import pyarrow as pa

    def page(held, directory):
        keys = list(held)
        key = np.array([k[0] for k in keys], dtype=np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(directory.bucket(key).astype(np.int32)),
                pa.array(key),
                pa.array([k[1] for k in keys], pa.large_binary()).cast(pa.binary()),
                pa.array([held[k][0] for k in keys], pa.int64()),
                pa.array([held[k][1] for k in keys], pa.int64()),
            ],
            names=["bucket", "key", "text", "keep_id", "n"],
        )

    def run(batches: Iterator) -> Iterator:
        directory = shared.value
        held: dict[tuple, tuple] = {}
        size = 0
        for batch in slices(batches):
            for key, text, doc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                entry = (key, text)
                before = held.get(entry)
                if before is None:
                    size += len(text) + 200
                    held[entry] = (doc, 1)
                else:
                    ids = [x for x in (doc, before[0]) if x is not None]
                    held[entry] = (max(ids, default=None), before[1] + 1)
                if size > PAGE_BYTES:
                    yield page(held, directory)
                    held, size = {}, 0
        if held:
            yield page(held, directory)

    return run


def _owners(batches: Iterator) -> Iterator:
    """Walk a key range in key order; chain entries of a key, compare bytes."""
    import pyarrow as pa

    done: list[tuple] = []
    chain: list[list] = []
    at: tuple | None = None

    def flush():
        cols = list(zip(*done, strict=True))
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["key", "sha", "keep_id", "group_size"])

    def close():
        shas = set()
        for text, keep, n in chain:
            sha = hashlib.sha256(text).digest()
            if sha in shas:
                raise ValueError("two different texts have the same SHA-256")
            shas.add(sha)
            done.append((at[1], sha, keep, n))
        chain.clear()

    for batch in slices(batches):
        for bucket, key, text, keep, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (bucket, key) != at:
                if at is not None:
                    close()
                at = (bucket, key)
            for link in chain:
                if link[0] == text:
                    link[1] = max((x for x in (link[1], keep) if x is not None), default=None)
                    link[2] += n
                    break
            else:
                chain.append([text, keep, n])
        if len(done) >= 4096:
            yield flush()
    if at is not None:
        close()
    if done:
        yield flush()


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None, max_depth: int = MAX_DEPTH, key: Callable = F.xxhash64) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    ``key`` makes the 64-bit key of a text column; a poor one only makes
    longer chains.  A bucket holds ``capacity`` keys, by default ``CAPACITY`` or
    so many more that the directory stays within its depth.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", key(F.col("text")).cast("long"))
    entries = materialise(rows.select("doc_id", "key", F.unhex(F.sha2("text", 256)).alias("sha")), "dedup-entries")

    prefix = F.shiftrightunsigned("key", 64 - max_depth).alias("prefix")
    counts = {r[0]: r[1] for r in entries.select("key").distinct().groupBy(prefix).count().collect()}  # at most 2**max_depth
    capacity = capacity or max(CAPACITY, sum(counts.values()) >> max_depth - 3)
    directory = spark.sparkContext.broadcast(Directory(counts, capacity, max_depth))

    pages = rows.select("key", F.col("text").cast("binary").alias("text"), "doc_id")
    pages = pages.mapInArrow(_pages(directory), "bucket int, key long, text binary, keep_id long, n long")
    ranges = pages.repartition(n, "bucket").sortWithinPartitions("bucket", "key")
    classes = ranges.mapInArrow(_owners, "key long, sha binary, keep_id long, group_size long")
    classes = materialise(classes.filter("group_size > 1"), "dedup-classes")

    classes = classes.withColumnsRenamed({"key": "class_key", "sha": "class_sha"})
    found = entries.join(classes, (F.col("key") == F.col("class_key")) & (F.col("sha") == F.col("class_sha")), "left")
    grouped = F.col("group_size").isNotNull()
    keep = F.when(grouped, F.col("keep_id")).otherwise(F.col("doc_id"))
    return found.select(
        F.col("doc_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
