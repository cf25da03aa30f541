import math
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quarryline.llm import simhash
from quarryline.llm.queries import op10_simhash


def fingerprint(text, size=3, seed=42):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) > size else ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, seed) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def components(values, radius):
    forest = simhash.Forest(len(values))
    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= radius:
                forest.join(i, j)
    return [forest.root(i) for i in range(len(values))]


@pytest.mark.parametrize(("words", "radius"), [(1, 0), (1, 1), (1, 2), (1, 3), (1, 7), (4, 46)])
def test_links_give_the_components_of_all_pairs(words, radius):
    draw = random.Random(radius)
    for _ in range(8):
        base = [draw.getrandbits(64 * words) for _ in range(5)]
        values = [draw.choice(base) ^ sum(1 << b for b in draw.sample(range(64 * words), draw.randint(0, radius + 2))) for _ in range(draw.randint(1, 90))]
        rows = np.array([[v >> 64 * w & (1 << 64) - 1 for w in range(words)] for v in values], dtype=np.uint64)
        forest = simhash.Forest(len(values))
        for a, b in simhash.links(rows, np.zeros(len(values), dtype=int), radius):
            forest.join(a, b)
        assert [forest.root(i) for i in range(len(values))] == components(values, radius)


@pytest.mark.parametrize("bands", [simhash.even_bands(3), simhash.paired_bands(3)])
def test_bands_miss_no_pair(bands):
    draw = random.Random(0)
    for _ in range(3000):
        differ = set(draw.sample(range(64), 3))
        assert any(not differ & set(b) for b in bands)


@pytest.mark.parametrize("tile", [3, 8192])
def test_rows_against_brute_force(spark, tile):
    draw = random.Random(7)
    base = [" ".join(draw.choice("abcdefgh") * draw.randint(1, 3) for _ in range(80)) for _ in range(4)]
    rows = [(None, "null id"), (3, None), (4, ""), (5, " \n"), (6, "One"), (7, "one"), (8, "one two"), (9, "one two three"), (9, "one two three")]
    for i in range(60):
        w = draw.choice(base).split()
        for _ in range(draw.randint(0, 2)):
            w[draw.randrange(len(w))] = "new"
        rows.append((100 + i * 7 % 60, " ".join(w)))
    rows.append((999, "long " * 50_000))
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fp string").repartition(3)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, tile=tile).collect()), key=str)
    prints = [fingerprint(t) for _, t in rows]
    roots = components(prints, 3)
    least = {r: min((d for (d, _), q in zip(rows, roots, strict=True) if q == r and d is not None), default=None) for r in roots}
    assert got == sorted(((d, f"{p:016x}", least[r]) for (d, _), p, r in zip(rows, prints, roots, strict=True)), key=str)


def test_wide_fingerprints_use_more_seeds(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "zz yy xx")], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in simhash.near_duplicates(docs, shingle=5, words=4, radius=46, bands=simhash.sampled_bands(8, 16, 256)).collect()}
    assert got[1] == "".join(f"{fingerprint('a b c d e f g', 5, 42 + w):016x}" for w in range(4))


def test_chains_and_stars(spark):
    def key(i):
        return i.to_bytes(8, "big")

    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (200, 300), (250, 300)]
    draw = random.Random(2)
    draw.shuffle(pairs)
    edges = spark.createDataFrame([(key(a), key(b)) for a, b in pairs], "a binary, b binary")
    got = {int.from_bytes(r.node, "big"): int.from_bytes(r.root, "big") for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 250: 200, 300: 200}


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_dense_bucket_takes_seconds():
    """8,192 near copies: their tree, not their 33 million pairs."""
    import time

    draw = random.Random(3)
    rows = np.array([[sum(1 << b for b in draw.sample(range(64), draw.randint(0, 1)))] for _ in range(8192)], dtype=np.uint64)
    began = time.process_time()
    assert len(simhash.links(rows, np.zeros(8192, dtype=int), 3)) == 8191
    assert time.process_time() - began < 20


@pytest.mark.parametrize(("hot", "how"), [(1, "inner"), (3, "left"), (1000, "inner")])
def test_hot_join(spark, monkeypatch, hot, how):
    monkeypatch.setattr(simhash, "HOT_ROWS", hot)
    rows = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(60)] + [(None, 1)], "k int, v int")
    table = rows.filter("k < 5").groupBy(F.col("k").alias("c")).agg(F.max("v").alias("m"), F.count("*").alias("rows"))
    got = simhash.hot_join(rows, "k", table, 61, how)
    want = rows.join(table.drop("rows"), F.col("k") == F.col("c"), how).select("k", "v", "m")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    prints = [fingerprint(r.text) for r in docs]
    roots = components(prints, 3)
    least = {q: min(r.doc_id for r, x in zip(docs, roots, strict=True) if x == q) for q in set(roots)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op10_simhash(spark, sf_dir).collect()}
    assert got == {r.doc_id: (f"{p:016x}", least[q]) for r, p, q in zip(docs, prints, roots, strict=True)}


def units(buckets, crossed=False):
    """Rows of ``_compare``: buckets of (fingerprint, size), one unit each."""
    rows = [(0, k, 0, int(crossed), i % 2, v.to_bytes(32, "big"), n) for k, bucket in enumerate(buckets) for i, (v, n) in enumerate(bucket)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["band", "key", "ta", "tb", "tile", "fp", "n"])


@pytest.mark.parametrize(("threshold", "most"), [((), 171), (((4, 5),), 60)])
def test_middling_buckets_share_passes(monkeypatch, threshold, most):
    """Buckets of 172 unrelated rows, as bands of 14 bits have at 6 GB: one
    pass for each offset in all of them, or for each that sizes allow."""
    draw, passes, within = random.Random(0), [], simhash.within
    monkeypatch.setattr(simhash, "within", lambda *a: passes.append(a) or within(*a))
    batch = units([[(draw.getrandbits(256), int(draw.lognormvariate(5.5, 1.1)) + 1) for _ in range(172)] for _ in range(20)])
    assert not list(simhash._compare(4, 64, *threshold)(iter([batch if threshold else batch.drop_columns(["n"])])))
    assert 0 < len(passes) <= most


@pytest.mark.parametrize("crossed", [False, True])
@pytest.mark.parametrize("block", [8, 200, 16_384])
def test_sizes_leave_out_only_pairs_that_cannot_be_alike(monkeypatch, block, crossed):
    monkeypatch.setattr(simhash, "BLOCK", block)
    draw, buckets, want = random.Random(1), [], simhash.Forest(500)
    for size in (1, 2, 30, 90, 60):
        base = [draw.getrandbits(256) for _ in range(1 + size // 8)]
        near = [draw.choice(base) ^ sum(1 << b for b in draw.sample(range(256), draw.randint(0, 40))) for _ in range(size)]
        buckets.append([(v, draw.choice((0, 1, 4, 5, 79, 80, 99, 100, 101, 125, 126))) for v in near])
    number = {v: i for i, v in enumerate(v for bucket in buckets for v, _ in bucket)}
    for bucket in buckets:
        for i, (a, n) in enumerate(bucket):
            for j, (b, m) in enumerate(bucket[:i]):
                if (a ^ b).bit_count() <= 64 and 5 * min(n, m) >= 4 * max(n, m) and not (crossed and (i - j) % 2 == 0):
                    want.join(number[a], number[b])
    got = simhash.Forest(500)
    for out in simhash._compare(4, 64, (4, 5))(iter([units(buckets, crossed)])):
        for a, b in zip(*(c.to_pylist() for c in out.columns), strict=True):
            got.join(number[int.from_bytes(a, "big")], number[int.from_bytes(b, "big")])
    assert [got.root(i) for i in range(500)] == [want.root(i) for i in range(500)]
    assert len({want.root(i) for i in range(183)}) not in (1, 183)


def test_bands_fit_the_number_of_fingerprints():
    """Buckets stay near one size and recall near its goal at any input."""
    before = 0
    for nodes in (10, 10_000, 235_000, 2_800_000, 470_000_000, 50_000_000_000):
        bands = simhash.fitting_bands(nodes, 256, (4, 5))
        width, agree = len(bands[0]), 1 - math.acos(1.6 / 1.8) / math.pi
        assert width >= before and nodes / 2**width <= 128
        assert width == 8 or nodes / 2**width > 60
        assert 0.999 <= 1 - (1 - agree**width) ** len(bands) < 0.9999
        before = width


def families(draw, sizes):
    """Sets of several texts with their edited copies, some of them bridges."""
    sets = []
    for size in sizes:
        base = draw.sample(range(1 << 40), 60)
        for _ in range(size):
            own = set(base)
            for x in draw.sample(base, draw.randint(0, 9)):
                own.remove(x)
            own |= set(draw.sample(range(1 << 40), draw.randint(0, 4)))
            sets.append(np.array(sorted(own), dtype=np.uint64))
    return sets


def similar(a, b):
    both = len(np.intersect1d(a, b))
    return 5 * both >= 4 * (len(a) + len(b) - both)


@pytest.mark.parametrize("leaders", [0, 1, 16])
@pytest.mark.parametrize("sizes", [[90], [40, 40, 3, 1, 1], [1] * 30])
def test_tiles_of_a_group_give_its_components(spark, monkeypatch, leaders, sizes):
    monkeypatch.setattr(simhash, "LEADERS", leaders)
    draw = random.Random(sum(sizes) + leaders)
    sets = families(draw, sizes)
    want = simhash.Forest(len(sets))
    for i, a in enumerate(sets):
        for j in range(i):
            if similar(a, sets[j]):
                want.join(i, j)
    tiles = 7
    rows = [(bytes([i]), b"g", draw.randrange(tiles), tiles, s.tobytes()) for i, s in enumerate(sets)] + [(b"x1", b"h", 0, 1, sets[0].tobytes()), (b"x2", b"h", 0, 1, sets[0].tobytes())]
    frame = spark.createDataFrame(rows, "sha binary, grp binary, tile int, tiles int, hashes binary").repartition(3)
    got = simhash.Forest(len(sets))
    edges = simhash.verified(frame, (4, 5), 4).collect()
    assert sum(bytes(e.a)[:1] == b"x" for e in edges) == 1
    for e in edges:
        if bytes(e.a)[:1] != b"x":
            assert similar(sets[e.a[0]], sets[e.b[0]])
            got.join(e.a[0], e.b[0])
    assert [got.root(i) for i in range(len(sets))] == [want.root(i) for i in range(len(sets))]


def test_one_tree_ends_the_comparison(monkeypatch):
    """A tile of copies of one text, and a leader: one pass each, not all."""
    calls, count = [], np.bincount
    monkeypatch.setattr(simhash.np, "bincount", lambda *a, **k: calls.append(1) or count(*a, **k))
    base = np.arange(100, dtype=np.uint64)
    sets = [np.append(base, np.uint64(1000 + i)) for i in range(500)]
    assert len(simhash.alike(sets, (4, 5))) == 499 and len(calls) == 2
    assert simhash.alike(sets, (4, 5), labels=["a"] * 500) == [] and len(calls) == 2
    assert len(simhash.alike(sets, (4, 5), labels=["a"] * 499 + ["b"], probes=[499])) == 1
