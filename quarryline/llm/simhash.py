"""Operator 10: SimHash near-duplicates by bit-sliced comparison.

A document's fingerprint takes the majority of each bit over the XXH64 hashes
of its word shingles.  Documents with equal fingerprints are one node from
the start (a grouped minimum with map-side combining).  Nodes are dealt to
tables by bands of fingerprint bits; any two fingerprints within the radius
share a band when there are more bands than the radius, which is the exact
scheme.  For a wide radius ``sampled_bands`` draws bands of random bits
instead, with a recall that its docstring states.

Within a band's bucket, comparison is bit-sliced.  Bit plane k holds bit k of
every row as one long integer.  Shifting a plane by d lines row i up with row
i + d, so one pass over the planes counts the distances of all pairs at that
offset together, in carry-save counters of a few planes.  A pass is abandoned
as soon as every pair of the block exceeds the radius.  Buckets larger than
``TILE`` rows are split into pairs of tiles, each its own unit of work.  A
bucket gives out a spanning forest of its links, never all pairs.  Where links
are verified by similarity afterwards, rows of a bucket are sorted by the
number of their shingles and compared only while that similarity is possible.

Verification goes by groups of candidates, cut into tiles.  A few leaders of a
large group join each of its tiles, so a group of copies of one text becomes one
tree at once, each set moving once.  Only sets that the group's largest tree
does not hold then meet the rest of the group, tile by tile, until all are one
tree or all pairs have been compared.

Components come from alternating large-star and small-star rounds over tables
in the shared folder until the edges no longer change.  Keys that many rows
share (the centre of a star, a fingerprint of a third of all rows) are joined
where the rows are, by a broadcast of at most ``HOT_KEYS`` of them.

Defined results: a null text counts as empty; a document without words has
fingerprint zero and links like any other; with fewer words than a shingle,
the whole sequence is the one shingle.  Rows that repeat a doc_id are each
fingerprinted.  Ties of a bit (set in exactly half) give 0.  Extra columns are
left out; an empty table gives an empty result.  Very long texts are hashed
whole, some of their shingles at a time being summed.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm.common import materialise, partitions, slices, text_bytes

#: Rows of a bucket that are compared in one unit.
TILE = 8192
#: Rows of buckets that share one bit-sliced block; a bucket with more than a
#: quarter of them has its own.
BLOCK = 16_384
#: Shingle sets, and hashes in them, of a tile, and sets of a large group that
#: each of its tiles is compared with.
SET_TILE, SET_HASHES, LEADERS = 256, 2_000_000, 16
#: Fingerprints that a bucket of a band shall hold, and the share of pairs at the
#: threshold that bands shall find.
BUCKET, RECALL = 128, 0.999
#: Sets of up to so many shingles also meet by shared shingles, within a radius
#: in 256 bits that tells unrelated texts (128) from near ones (48 or less).
SHORT, SHORT_RADIUS = 40, 96

Bands = list[list[int]]


def even_bands(radius: int, bits: int = 64) -> Bands:
    """``radius + 1`` bands of consecutive bits: exact, as one band of any
    pair within the radius has no differing bit."""
    cuts = [bits * i // (radius + 1) for i in range(radius + 2)]
    return [list(range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]


def paired_bands(radius: int, bits: int = 64) -> Bands:
    """``radius + 2`` parts, a band for each two of them: exact, as at least
    two parts of any pair within the radius agree.  Longer keys than
    ``even_bands`` and so far smaller buckets, for more tables."""
    cuts = [bits * i // (radius + 2) for i in range(radius + 3)]
    parts = [list(range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [p + q for i, p in enumerate(parts) for q in parts[:i]]


def sampled_bands(count: int, width: int, bits: int, seed: int = 0) -> Bands:
    """``count`` bands of ``width`` random bits.  A pair whose bits agree with
    probability p is found with probability 1 - (1 - p**width)**count."""
    draw = random.Random(seed)
    return [sorted(draw.sample(range(bits), width)) for _ in range(count)]


def fitting_bands(nodes: int, bits: int, threshold: tuple[int, int], recall: float = RECALL, bucket: int = BUCKET) -> Bands:
    """Sampled bands whose width follows the number of fingerprints, so that a
    bucket holds about ``bucket`` of unrelated texts at any size of the input,
    and whose count gives the wanted recall at that width.

    Bits of two sets agree with probability 1 - arccos(c) / pi, c being their
    cosine, 2 s / (1 + s) for sets of one size with similarity s."""
    s = threshold[0] / threshold[1]
    agree = 1 - math.acos(2 * s / (1 + s)) / math.pi
    width = min(62, bits, max(8, math.ceil(math.log2(max(nodes, 1) / bucket))))
    return sampled_bands(max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree**width))), width, bits)


def shingle_hashes(text: bytes, size: int, words: int, distinct: bool = False) -> np.ndarray:
    """XXH64 hashes of a text's shingles, seeds 42, 43, ...: shape (n, words).
    Repeated shingles count each time unless ``distinct``."""
    from xxhash import xxh64_intdigest

    tokens = text.lower().split()
    if not tokens:
        return np.zeros((0, words), dtype=np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= size:
        shingles = [joined]
    else:
        ends = list(accumulate(len(t) + 1 for t in tokens))
        starts = [0, *ends]
        shingles = [joined[a : b - 1] for a, b in zip(starts, ends[size - 1 :], strict=False)]
    if distinct:
        shingles = list(dict.fromkeys(shingles))
    out = np.empty((len(shingles), words), dtype=np.uint64)
    for w in range(words):
        seed = 42 + w
        out[:, w] = [xxh64_intdigest(s, seed) for s in shingles]
    return out


def majority(hashes: np.ndarray) -> np.ndarray:
    """The bits that over half of the rows set, as ``words`` integers."""
    n, words = hashes.shape
    if n == 0:
        return np.zeros(words, dtype=np.uint64)
    total = np.zeros(64 * words, dtype=np.int64)
    for at in range(0, n, 65_536):
        part = np.ascontiguousarray(hashes[at : at + 65_536]).astype("<u8").view(np.uint8).reshape(-1, 8 * words)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64 if len(part) > 65_535 else np.uint16)
    return np.packbits(2 * total > n, bitorder="little").view("<u8").astype(np.uint64)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, words: int = 1) -> DataFrame:
    """``doc_id`` and ``fp``: the fingerprint as ``8 * words`` big-endian bytes."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            fps = []
            for text in text_bytes(batch.column(1)):
                fps.append(majority(shingle_hashes(text, shingle, words)).astype(">u8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary())], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp binary")


# Bit-sliced comparison


def planes_of(fps: np.ndarray) -> list[int]:
    """Bit planes of fingerprints (n, words): plane k has bit k of row i at bit i."""
    bits = np.unpackbits(np.ascontiguousarray(fps).astype("<u8").view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")
    rows = np.packbits(bits.T, axis=1, bitorder="little")
    return [int.from_bytes(r.tobytes(), "little") for r in rows]


def within(planes: list[int], offset: int, lanes: int, radius: int) -> int:
    """Lanes i (of ``lanes``) whose rows i and i + offset differ in at most
    ``radius`` bits.  Counters are carry-save: counter[j] holds bit j of every
    lane's count, started so that they overflow just beyond the radius."""
    size = radius.bit_length()
    first = (1 << size) - radius - 1
    counters = [lanes if first >> j & 1 else 0 for j in range(size)]
    alive = lanes
    for plane in planes:
        carry = (plane ^ plane >> offset) & alive
        for j in range(size):
            if not carry:
                break
            both = counters[j] & carry
            counters[j] ^= carry
            carry = both
        else:
            alive &= ~carry
            if not alive:
                return 0
    return alive


class Forest:
    """Union-find over row numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def reach_of(runs: np.ndarray, sizes: np.ndarray | None = None, threshold: tuple[int, int] = (0, 1)) -> np.ndarray:
    """How far behind each row the last one is that it can link to: the last
    of its run or, where rows of a run are sorted by the sizes of their sets, the
    last whose size still allows a Jaccard similarity of ``threshold``, as two
    sets are at most as similar as the lesser size is to the larger."""
    at = np.arange(len(runs))
    run = np.cumsum(np.diff(runs, prepend=runs[:1]) != 0)
    if sizes is None:
        return np.searchsorted(run, run, "right") - 1 - at
    (over, under), span = threshold, int(sizes.max(initial=0)) + 1
    most = np.minimum(sizes.astype(np.int64) * under // over, span - 1)
    return np.searchsorted(run * span + sizes, run * span + most, "right") - 1 - at


def links(fps: np.ndarray, runs: np.ndarray, radius: int, tile_of: np.ndarray | None = None, reach: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs within the radius, within runs of rows.
    Pairs of one tree are masked out, and nothing is compared once each run is
    one tree: a dense bucket gives out its tree and not its pairs.

    ``runs`` numbers the run of each row; rows of a run are adjacent.  With
    ``tile_of``, pairs within one tile are left to the unit of that tile; with
    ``reach``, a row is compared with so many rows behind it.
    """
    n = len(fps)
    planes = planes_of(fps)
    forest, out = Forest(n), []
    label = np.arange(n)  # of the tree that a row is in
    reach = reach_of(runs) if reach is None else reach
    trees = n - len(np.unique(runs))  # edges until every run is one tree
    for d in range(1, int(reach.max(initial=0)) + 1):
        if len(out) == trees:
            break
        open_ = (reach[:-d] >= d) & (label[d:] != label[:-d])
        if tile_of is not None:
            open_ &= tile_of[d:] != tile_of[:-d]
        if not open_.any():
            continue
        lanes = int.from_bytes(np.packbits(open_, bitorder="little").tobytes(), "little")
        near = within(planes, d, lanes, radius)
        while near:
            low = near & -near
            i = low.bit_length() - 1
            near ^= low
            if forest.join(i, i + d):
                out.append((i, i + d))
                a, b = label[i], label[i + d]
                label[label == max(a, b)] = min(a, b)
    return out


def _compare(words: int, radius: int, threshold: tuple[int, int] | None = None):
    """Units of work in, edges out.  Rows come sorted by unit; with a
    ``threshold`` they end in the size of their sets."""

    def edges(rows: list[tuple], runs: list[int], crossed: bool = False) -> list[tuple[bytes, bytes]]:
        run, reach = np.array(runs), None
        if threshold:
            sizes = np.array([r[2] for r in rows], dtype=np.int64)
            order = np.lexsort((sizes, run))
            rows, run = [rows[i] for i in order.tolist()], run[order]
            reach = reach_of(run, sizes[order], threshold)
        tiles = np.array([r[0] for r in rows]) if crossed else None
        fps = [r[1] for r in rows]
        bits = np.frombuffer(b"".join(fps), dtype=">u8").reshape(len(fps), words).astype(np.uint64)
        return [(fps[i], fps[j]) for i, j in links(bits, run, radius, tiles, reach)]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out(pairs):
            return pa.RecordBatch.from_arrays([pa.array([min(p) for p in pairs], pa.binary()), pa.array([max(p) for p in pairs], pa.binary())], names=["a", "b"])

        unit, number = None, -1
        held: list[tuple] = []
        small: list[tuple] = []
        runs: list[int] = []

        def close():
            """Take the unit that ended: small ones share a block."""
            nonlocal small, runs
            pairs = []
            if len(held) > 1:
                if unit[2] != unit[3] or len(held) > BLOCK // 4:
                    pairs += edges(held, [0] * len(held), unit[2] != unit[3])
                else:
                    small += held
                    runs += [number] * len(held)
            if len(small) >= BLOCK:
                pairs += edges(small, runs)
                small, runs = [], []
            return pairs

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            pairs = []
            for row in zip(*cols, strict=True):
                if row[:4] != unit:
                    pairs += close()
                    unit, number = row[:4], number + 1
                    held = []
                held.append(row[4:])
            if pairs:
                yield out(pairs)
        pairs = close()
        if small:
            pairs += edges(small, runs)
        if pairs:
            yield out(pairs)

    return run


def _keys(bands: Bands):
    """Each fingerprint's key in each band, with the other columns."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fps, *more = (c.slice(at, 4096) for c in batch.columns)
                raw = fps.to_pylist()
                if not raw:
                    continue
                rows = np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(len(raw), -1)
                bits = np.unpackbits(rows, axis=1)[:, ::-1]  # bit 0 is the last of the big-endian bytes
                words = bits.shape[1] // 64
                bits = bits.reshape(len(raw), words, 64)[:, ::-1].reshape(len(raw), -1)  # word 0 first, as in planes_of
                for b, band in enumerate(bands):
                    key = bits[:, band].astype(np.int64) @ (1 << np.arange(len(band), dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(raw), b, np.int32)), pa.array(key), fps, *more], names=["band", "key", *batch.schema.names])

    return run


def near_edges(nodes: DataFrame, *, radius: int, bands: Bands, words: int = 1, tile: int = TILE) -> DataFrame:
    """Edges (a, b) that link the distinct fingerprints ``fp`` of ``nodes``:
    the same components as all pairs within the radius that share a band."""
    keyed = nodes.select("fp").mapInArrow(_keys(bands), "band int, key long, fp binary")
    return keyed_edges(materialise(keyed, "simhash-keyed"), radius=radius, words=words, tile=tile)


def keyed_edges(keyed: DataFrame, *, radius: int, words: int = 1, tile: int = TILE, threshold: tuple[int, int] | None = None) -> DataFrame:
    """Edges (a, b) between rows (band, key, fp) of one band and key: the same
    components as all of their pairs within the radius.  With a ``threshold``,
    rows carry the size ``n`` of their sets, and only pairs count whose sizes
    allow this Jaccard similarity."""
    spark = keyed.sparkSession
    large = keyed.groupBy("band", "key").count().filter(F.col("count") > tile).select(F.col("band").alias("lb"), F.col("key").alias("lk"), F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    large = materialise(large, "simhash-large")
    dealt = keyed.withColumns({"ta": F.lit(0), "tb": F.lit(0), "tile": F.lit(0)})
    if not large.isEmpty():
        dealt = keyed.join(large, (F.col("band") == F.col("lb")) & (F.col("key") == F.col("lk")), "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("fp"), "tiles").cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        dealt = dealt.withColumns({"ta": F.least("tile", "other"), "tb": F.greatest("tile", "other")})
    columns = ["band", "key", "ta", "tb", "tile", "fp", *(["n"] if threshold else [])]
    dealt = dealt.select(*columns).repartition(partitions(spark), "band", "key", "ta", "tb").sortWithinPartitions(*columns)
    return materialise(dealt.mapInArrow(_compare(words, radius, threshold), "a binary, b binary").distinct(), "simhash-edges")


#: At most so many keys are hot: those that more than this share of all rows
#: has, and more than ``HOT_ROWS`` rows.
HOT_KEYS, HOT_ROWS = 1000, 256


def hot_join(rows: DataFrame, key: str, table: DataFrame, total: int, how: str = "inner") -> DataFrame:
    """Rows with the columns of a table that has one row for each key ``c`` and
    the number of ``rows`` with it.  Rows of hot keys do not move: there are at
    most ``HOT_KEYS`` such keys (they share twice ``total`` rows at most), which
    are broadcast.  The others meet in a join, where no key has more than its
    bounded share."""
    most = max(HOT_ROWS, 2 * total // HOT_KEYS)
    payload = [c for c in table.columns if c not in ("c", "rows")]
    hot = table.filter(F.col("rows") > most).select(F.col("c").alias("_hc"), F.lit(True).alias("_hot"), *(F.col(c).alias(f"_h_{c}") for c in payload))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("_hc"), "left")
    here = marked.filter("_hot is not null").select(*rows.columns, *(F.col(f"_h_{c}").alias(c) for c in payload))
    cold = table.filter(F.col("rows") <= most).drop("rows")
    rest = marked.filter("_hot is null").select(*rows.columns).join(cold, F.col(key) == F.col("c"), how).select(*rows.columns, *payload)
    return here.unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """Components of edges (a, b): rows (node, root) for every node with an
    edge, root being the smallest node of the component.

    Alternates large-star and small-star.  Each round is a table in the
    shared folder; rounds stop when no edge changes, which they do after a
    number of them that grows with the logarithm of a component.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialise(edges, "star")
    before = None
    while True:
        n = edges.count()
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"), "rows")
        least = materialise(least, "star-least")
        large = hot_join(both.filter("v > u"), "u", least, n).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.filter("u <> v").distinct(), "star")
        least = materialise(large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"), F.count("*").alias("rows")), "star-least")
        small = hot_join(large, "u", least, large.count())
        moved = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = materialise(moved.filter("u <> v").distinct(), "star")
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, words: int = 1, radius: int = 3, bands: Bands | None = None, tile: int = TILE) -> DataFrame:
    """One row per input row: id, ``fingerprint`` (hex) and ``component_id``,
    the smallest id reachable over links of at most ``radius`` bits."""
    bands = bands or paired_bands(radius, 64 * words)
    fps = materialise(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle, words=words), "simhash-fp")
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("rows")), "simhash-nodes")
    edges = near_edges(nodes, radius=radius, bands=bands, words=words, tile=tile)
    member = materialise(components(edges), "simhash-members")
    named = member.join(nodes, F.col("node") == F.col("fp"), "left").groupBy(F.col("root").alias("c")).agg(F.min("least_id").alias("component"), F.count("*").alias("rows"))
    linked = hot_join(member, "root", materialise(named, "simhash-named"), member.count()).select("node", "component")
    alone = nodes.join(linked, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("c"), F.coalesce("component", "least_id").alias("component_id"), "rows")
    found = hot_join(fps, "fp", materialise(alone, "simhash-components"), fps.count())
    return found.select(F.col("doc_id").alias(id_col), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


# Verified near copies


def alike(sets: list[np.ndarray], threshold: tuple[int, int], labels: list | None = None, probes: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets (distinct hashes) whose Jaccard
    similarity is at least the fraction ``threshold``.  Sets of one label (that
    is not null) are known to be one tree.  With ``probes``, only pairs with one
    of these rows are compared.  Ends when all sets are one tree."""
    n, (over, under) = len(sets), threshold
    forest, out, first_of = Forest(n), [], {}
    trees = n
    for i, label in enumerate(labels or ()):
        if label is not None:
            trees -= forest.join(first_of.setdefault(label, i), i)
    if trees == 1:
        return out
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    ends = np.cumsum(sizes)
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    holders = np.repeat(np.arange(n), sizes)[np.argsort(ids, kind="stable")]
    starts = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=len(values)))])
    for i in range(n) if probes is None else probes:
        own = ids[ends[i] - sizes[i] : ends[i]]
        first, count = starts[own], starts[own + 1] - starts[own]
        at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        shared = np.bincount(holders[at], minlength=n)
        near = under * shared >= over * (sizes[i] + sizes - shared)
        if probes is None:
            near[: i + 1] = False
        new = [(i, j) for j in np.flatnonzero(near).tolist() if forest.join(i, j)]
        out += new
        trees -= len(new)
        if trees == 1:
            break
    return out


def prefix(hashes: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """The least hashes of a set, so many that two sets as similar as the
    threshold share one of them: such sets share at least ``threshold`` of
    either's hashes."""
    n, (over, under) = len(hashes), threshold
    return np.sort(hashes)[: n + (-n * over // under) + 1]


def _prints(shingle: int, words: int, threshold: tuple[int, int] = (4, 5), short: int = SHORT):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            fps, sizes, keys = [], [], []
            for text in text_bytes(batch.column(2)):
                hashes = shingle_hashes(text, shingle, words, distinct=True)
                fps.append(majority(hashes).astype(">u8").tobytes())
                sizes.append(len(hashes))
                keys.append(prefix(hashes[:, 0], threshold).view(np.int64) if 0 < len(hashes) <= short else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.binary()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "sha", "fp", "n", "keys"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            sets = [np.unique(shingle_hashes(text, shingle, 1)[:, 0]).tobytes() for text in text_bytes(batch.column(4))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sets, pa.binary())], names=["sha", "grp", "tile", "tiles", "hashes"])

    return run


def _verify(threshold: tuple[int, int]):
    """Units of work in, verified edges out.  Rows (grp, ta, tb, probe, label,
    sha, hashes) come sorted by unit; where some are probes, only pairs with
    one of them are compared."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        unit, probes, labels, shas, sets = None, [], [], [], []

        def edges():
            if len(sets) < 2:
                return []
            some = [i for i, p in enumerate(probes) if p]
            return [(shas[i], shas[j]) for i, j in alike(sets, threshold, labels, some or None)]

        def out(pairs):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*pairs, strict=True)], names=["a", "b"])

        for batch in slices(batches):
            pairs = []
            for *key, probe, label, sha, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != unit:
                    pairs += edges()
                    unit, probes, labels, shas, sets = key, [], [], [], []
                probes.append(probe)
                labels.append(label)
                shas.append(sha)
                sets.append(np.frombuffer(hashes, dtype=np.uint64))
            if pairs:
                yield out(pairs)
        if pairs := edges():
            yield out(pairs)

    return run


def _units(rows: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    columns = ["grp", "ta", "tb", "probe", "label", "sha", "hashes"]
    dealt = rows.select(*columns).repartition(partitions(rows.sparkSession), "grp", "ta", "tb").sortWithinPartitions("grp", "ta", "tb")
    return materialise(dealt.mapInArrow(_verify(threshold), "a binary, b binary"), "simhash-verified")


def _alone(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"probe": F.lit(False), "label": F.lit(None).cast("binary")})


def verified(sets: DataFrame, threshold: tuple[int, int], set_tile: int) -> DataFrame:
    """Edges (a, b) of sets (sha, grp, tile, tiles, hashes), a table with the
    groups' tiles: the same components as all similar pairs of each group."""
    own = _alone(sets.select("sha", "grp", F.col("tile").alias("ta"), F.lit(0).alias("tb"), "hashes"))
    large = sets.filter("tiles > 1")
    if large.isEmpty():
        return _units(own, threshold)
    order = Window.partitionBy("grp").orderBy(F.xxhash64("sha"), "sha")
    leaders = large.select("sha", "grp", "tile", "tiles").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= LEADERS)
    leaders = materialise(leaders.select(F.col("sha").alias("s"), F.col("tile").alias("home"), "tiles").withColumn("ta", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).filter("ta <> home").select("s", "ta"), "simhash-leaders")
    guests = _alone(large.join(leaders, F.col("sha") == F.col("s")).select("sha", "grp", "ta", F.lit(0).alias("tb"), "hashes"))
    edges = _units(own.unionByName(guests), threshold)

    # Sets that are not in the largest tree of their group, against all of it.
    trees = large.select("sha", "grp", F.octet_length("hashes").alias("size")).join(components(edges), F.col("sha") == F.col("node"), "left")
    trees = materialise(trees.select("sha", "grp", "size", F.coalesce("root", "sha").alias("label")), "simhash-trees")
    by_tree = trees.groupBy("grp", "label").agg(F.count("*").alias("count"), F.sum("size").alias("bytes"))
    by_group = by_tree.groupBy("grp").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count("*").alias("trees"), F.sum("count").alias("rows"), (F.sum("count") - F.max("count")).alias("rest"), F.sum("bytes").alias("bytes"))
    parts = lambda n: F.greatest(F.ceil(n / (4 * set_tile)), F.ceil(F.col("bytes") / (8 * SET_HASHES))).cast("int")
    open_ = materialise(by_group.filter("trees > 1").select(F.col("grp").alias("c"), "main", parts(F.col("rest")).alias("probed"), parts(F.col("rows")).alias("met"), "rows"), "simhash-open")
    if open_.isEmpty():
        return edges
    told = hot_join(trees.select("sha", "grp", "label"), "grp", open_, trees.count())
    told = told.select(F.col("sha").alias("s"), "label", "main", "probed", "met", F.xxhash64("sha").alias("h"))
    told = large.select("sha", "grp", "hashes").join(told, F.col("sha") == F.col("s"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    probing = told.filter("label <> main").select("grp", F.pmod(F.col("h"), F.col("probed")).cast("int").alias("ta"), every("met").alias("tb"), F.lit(True).alias("probe"), "label", "sha", "hashes")
    meeting = told.select("grp", every("probed").alias("ta"), F.pmod(F.col("h"), F.col("met")).cast("int").alias("tb"), F.lit(False).alias("probe"), "label", "sha", "hashes")
    return edges.unionByName(_units(probing.unionByName(meeting), threshold))


def near_copies(docs: DataFrame, *, threshold: tuple[int, int], shingle: int, words: int, radius: int, bands: Bands | None = None, exact: bool = False, tile: int = TILE, set_tile: int = SET_TILE) -> DataFrame:
    """One row per input row: ``doc_id``, ``text_sha256``, ``component_id`` (the
    smallest id of the component) and ``kept``, which one row of a component is.

    Components are those of the pairs whose shingle sets have a Jaccard
    similarity of at least ``threshold``, a fraction.  SimHash, here over each
    text's distinct shingles, only proposes groups: fingerprints linked within
    the radius in a band, and those of short texts that share a hash of their
    ``prefix``, in both where the sizes of the sets allow the similarity.  With ``exact`` texts of every length meet by their prefixes, at
    any distance of fingerprints, so that no pair is missed.  Without ``bands``
    they fit the number of fingerprints.  In each group shingle sets, as 64-bit
    hashes, are compared until the group is one tree or no pair is left.
    Rows without an id are kept.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("sha"), text.alias("text"))
    fps = materialise(rows.mapInArrow(_prints(shingle, words, threshold, 1 << 62 if exact else SHORT), "doc_id long, sha binary, fp binary, n int, keys array<long>"), "simhash-fp")
    nodes = materialise(fps.select("fp", "n").distinct(), "simhash-nodes")
    bands = bands or fitting_bands(nodes.count(), 64 * words, threshold)
    banded = nodes.mapInArrow(_keys(bands), "band int, key long, fp binary, n int")  # not kept: wider than the texts
    near = keyed_edges(banded, radius=radius, words=words, tile=tile, threshold=threshold)
    short = fps.select(F.lit(-1).alias("band"), F.explode("keys").alias("key"), "fp", "n").distinct()
    near = near.unionByName(keyed_edges(short, radius=64 * words if exact else SHORT_RADIUS * words // 4, words=words, tile=tile, threshold=threshold))
    groups = materialise(components(near), "simhash-groups")

    texts = fps.select("sha", "fp", "n").distinct().join(groups, F.col("fp") == F.col("node"), "left").select("sha", "n", F.coalesce("root", "fp").alias("grp"))
    texts = materialise(texts, "simhash-texts")
    sizes = texts.groupBy("grp").agg(F.count("*").alias("count"), F.sum("n").alias("hashes")).filter("count > 1")
    tiles = F.greatest(F.ceil(F.col("count") / set_tile), F.ceil(F.col("hashes") / SET_HASHES)).cast("int")
    sizes = materialise(sizes.select(F.col("grp").alias("c"), tiles.alias("tiles"), F.col("count").alias("rows")), "simhash-sizes")
    chosen = hot_join(texts, "grp", sizes, texts.count()).withColumn("tile", F.pmod(F.xxhash64("sha"), "tiles").cast("int"))
    chosen = materialise(chosen.select(F.col("sha").alias("s"), "grp", "tile", "tiles"), "simhash-chosen")
    sets = rows.select("sha", "text").join(chosen, F.col("sha") == F.col("s")).dropDuplicates(["sha"]).select("sha", "grp", "tile", "tiles", "text")
    sets = materialise(sets.mapInArrow(_sets(shingle), "sha binary, grp binary, tile int, tiles int, hashes binary"), "simhash-sets")
    edges = verified(sets, threshold, set_tile)

    member = materialise(components(edges), "simhash-members")
    found = fps.join(member, F.col("sha") == F.col("node"), "left").select("doc_id", "sha", F.coalesce("root", "sha").alias("root"))
    found = materialise(found, "simhash-found")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "sha")))
    least = found.groupBy(F.col("root").alias("c")).agg(first.alias("least"), F.count("*").alias("rows"))
    found = hot_join(found, "root", materialise(least, "simhash-least"), found.count())
    kept = F.col("doc_id").isNull() | ((F.col("doc_id") == F.col("least.doc_id")) & (F.col("sha") == F.col("least.sha")))
    return found.select("doc_id", F.lower(F.hex("sha")).alias("text_sha256"), F.col("least.doc_id").alias("component_id"), kept.alias("kept"))
