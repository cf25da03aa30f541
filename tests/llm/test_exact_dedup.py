import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.llm import exact_dedup

ROWS = [(1, "a"), (5, "a"), (2, "b"), (3, None), (4, ""), (9, "x" * 100_000), (8, "x" * 100_000), (7, "A"), (5, "a"), (None, "b"), (6, "a ")]


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    out = []
    for d, t in rows:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        out.append((d, keep, len(g), d == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("key", [F.xxhash64, lambda c: F.length(c).cast("long"), lambda c: F.lit(-1).cast("long")])
@pytest.mark.parametrize("capacity", [1, 1000])
def test_against_brute_force(spark, key, capacity):
    docs = spark.createDataFrame([(d, t, 1) for d, t in ROWS], "doc_id long, text string, keep_id int").repartition(3)
    assert result(exact_dedup.dedup(docs, capacity=capacity, max_depth=6, key=key)) == brute(ROWS)


def test_hot_group(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 50}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(exact_dedup.dedup(docs, capacity=4)) == brute(rows)


def test_empty(spark):
    assert exact_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_directory_doubles_only_where_needed():
    d = exact_dedup.Directory({0b0000: 5, 0b0001: 5, 0b1000: 1}, 5, 4)
    assert d.depth == 4
    assert len(set(d.slots)) < 2**4
    assert d.slots[0b0000] != d.slots[0b0001]
    assert len(set(d.slots[8:])) == 1  # the upper half never split
    whole = exact_dedup.Directory({}, 5, 4)
    assert (whole.depth, whole.slots) == (0, [0])
    full = exact_dedup.Directory({3: 100}, 5, 2)  # cannot split further: a longer chain
    assert full.depth == 2


def test_deep_directories_take_seconds():
    import time

    draw = np.random.default_rng(0)
    counts = {int(p): 8 for p in draw.permutation(1 << 18)[:200_000]}
    began = time.process_time()
    d = exact_dedup.Directory(counts, 8)
    assert d.depth == 18 and len(d.slots) == 1 << 18
    assert time.process_time() - began < 30
    keys = draw.integers(-(1 << 63), 1 << 63, 1000)
    assert d.bucket(keys).tolist() == [d.slots[(int(k) & (1 << 64) - 1) >> 46] for k in keys]


def test_capacity_follows_the_number_of_keys(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "CAPACITY", 2)
    rows = [(i, f"t{i % 90}") for i in range(200)] + [(None, None), (3, "long " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(exact_dedup.dedup(docs, max_depth=4)) == brute(rows)
