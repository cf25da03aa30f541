import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from quarryline.llm import vector_codes


def brute(rows, entries=256, rounds=4, parts=4, scale=1024):
    """Plain Python integers, one row after the other."""
    kept = [(i, label, [math.floor(scale * x) if math.isfinite(scale * x) else int(x) * scale for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    cut = [[v[p * len(v) // parts : (p + 1) * len(v) // parts] for p in range(parts)] for _, _, v in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for c in cut:
                own.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(x) // len(own[e]) for x in zip(*own[e], strict=True)] if e in own else c for e, c in enumerate(books[p])]
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = {}
    for (_, label, _), f in zip(kept, found, strict=True):
        errors[label] = errors.get(label, 0) + sum(d for d, _ in f)
    text = ",".join(str(x) for book in books for c in book for x in c)
    return sorted((str(i), bytes(e for _, e in f).hex(), sum(d for d, _ in f), errors[label]) for (i, label, _), f in zip(kept, found, strict=True)), hashlib.sha256(text.encode()).hexdigest()


def corpus(n=300, dims=8, size=1.0, seed=1):
    draw = random.Random(seed)
    near = [[draw.uniform(-size, size) for _ in range(dims)] for _ in range(20)]
    rows = [(i, [x + draw.gauss(0, size / 10) for x in draw.choice(near)], draw.choice([1, 1, 1, 2, None])) for i in draw.sample(range(5000), n)]
    return rows


SCHEMA = "vec_id long, embedding array<double>, label int"


def result(found):
    return sorted((str(r.vec_id), bytes(r.code).hex(), r.error, r.label_error) for r in found.collect())


def test_against_plain_integers(spark):
    rows = corpus()
    hot = rows[3]
    rows += [(6000 + i, hot[1], 7) for i in range(120)] + [rows[5], (None, rows[9][1], 1)]
    odd = [(7000, None, 1), (7001, [None] * 8, 1), (7002, [math.nan] + [0.0] * 7, 1), (-5, [math.inf] + [0.0] * 7, 1), (7003, [1.0] * 4, 1), (7004, [], 2), (7005, [1.0] * 7, 2)]
    frame = spark.createDataFrame([(*r, "x", 5) for r in rows + odd], SCHEMA + ", code string, n int").repartition(6)
    found, books = vector_codes.compress(frame)
    want, digest = brute(rows)
    assert result(found) == want
    assert books.sha256() == digest


def test_fewer_vectors_than_entries_and_ties(spark):
    rows = [(i, [0.5, 0.25, -0.5, 0.0] if i % 3 else [-0.001, 0.0, 0.0, 1.0], i % 2) for i in range(30)]
    found, books = vector_codes.compress(spark.createDataFrame(rows, SCHEMA))
    want, digest = brute(rows)
    assert result(found) == want and books.sha256() == digest
    assert books.entries.shape == (4, 30, 1)


@pytest.mark.parametrize("size", [1e3, 1e12])
def test_large_components_stay_exact(spark, size):
    """Beyond int64, sums and distances are still exact; errors must fit."""
    rows = [(i, [size * (1 + i % 7)] * 4 + [i / 64, -i / 64, 0.0, -1e-9], i % 2) for i in range(40)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found, books = vector_codes.compress(frame, entries=8)
    want, digest = brute(rows, entries=8)
    assert result(found) == want and books.sha256() == digest
    assert (books.entries.dtype == object) == (size > 1e6)


def test_single_precision_as_given(spark):
    """floor(1024 * x) of the float's exact value; and decoding."""
    frame = spark.createDataFrame(corpus(80), SCHEMA).withColumn("embedding", F.col("embedding").cast("array<float>"))
    rows = [tuple(r) for r in frame.collect()]
    found, books = vector_codes.compress(frame, entries=256)
    want, digest = brute(rows)
    assert result(found) == want and books.sha256() == digest
    back = vector_codes.decode(found, books).select("vec_id", "decoded", "error").collect()
    vectors = {r[0]: r[1] for r in rows}
    for r in back:
        assert sum((math.floor(1024 * a) - 1024 * b) ** 2 for a, b in zip(vectors[r.vec_id], r.decoded, strict=True)) == r.error


def test_empty_table(spark):
    found, books = vector_codes.compress(spark.createDataFrame([(1, None, 2)], SCHEMA))
    assert found.collect() == [] and books.text() == ""
    assert set(found.columns) >= {"vec_id", "code", "error", "label_error"}
